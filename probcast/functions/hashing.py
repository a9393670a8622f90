"""Stable ids: sha256 over JSON text with sorted keys and ASCII escapes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values: short escapes used by JSON text ------------------------------------------
SHORT_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t",
                 "\b": "\\b", "\f": "\\f"}


def json_string(text: Column) -> Column:
    """JSON string literal, ASCII only (others as ``\\uXXXX``, pairs above the basic plane)."""

    def escape(char: Column) -> Column:
        # UTF-16 code units: two or four hex digits pairs per character.
        units = F.hex(F.encode(char, "UTF-16BE"))
        wide = F.length(units) > 4
        escaped = F.when(
            wide,
            F.concat(F.lit("\\u"), F.lower(F.substring(units, 1, 4)),
                     F.lit("\\u"), F.lower(F.substring(units, 5, 4))),
        ).otherwise(F.concat(F.lit("\\u"), F.lower(units)))
        result = F.when(char == '"', SHORT_ESCAPES['"'])
        for plain, short in SHORT_ESCAPES.items():
            if plain != '"':
                result = result.when(char == plain, short)
        code = F.ascii(char)
        return result.when((code < 32) | (code > 126), escaped).otherwise(char)

    characters = F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))
    plain = text.rlike(r'^[\x20-\x21\x23-\x5b\x5d-\x7e]*$')
    body = F.when(plain, text).otherwise(F.array_join(F.transform(characters, escape), ""))
    return F.concat(F.lit('"'), body, F.lit('"'))


def json_object(**fields: Column) -> Column:
    """JSON object text, keys sorted, separators ``", "`` and ``": "``."""
    parts = []
    for key in sorted(fields):
        parts.append(F.concat(F.lit(f'"{key}": '), json_string(fields[key])))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def object_id(**fields: Column) -> Column:
    return F.sha2(json_object(**fields), 256)


def sample_order(key: Column, seed: int | str) -> Column:
    """Deterministic random order of rows: md5 over key and seed."""
    return F.md5(F.concat(key, F.lit(f"#{seed}")))
