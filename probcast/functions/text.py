"""Text column functions: templates, model names, facets, file names."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def fill_template(template: Column, **values: Column) -> Column:
    """Replace each ``{name}`` of a template; other fields stay as they are."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def check_template(template: str, fields: set[str]) -> None:
    """Fields named in a prompt template and the values given must be the same set."""
    named = set(re.findall(r"(?<!\{)\{([a-z_]+)\}(?!\})", template))
    if named != fields:
        raise ValueError(f"template fields {sorted(named)} differ from values {sorted(fields)}")


# Parts of a displayed model name.
PROMPTS = ("scratchpad", "zero shot", "superforecaster")
NEWS, FREEZE = "news", "freeze values"
NO_LABEL = "--"


def _sentence(text: Column) -> Column:
    """First letter in upper case, or the mark for no label."""
    return F.when(text == "", NO_LABEL).otherwise(
        F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1000)))


def _first_of(names: tuple[str, ...], text: Column) -> Column:
    """First of the names that the text contains, null without one."""
    return F.get(F.filter(F.array(*map(F.lit, names)), lambda name: F.contains(text, name)), F.lit(0))


def _smallest(text: Column, pattern: str, group: int) -> Column:
    return F.coalesce(F.array_min(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))), F.lit(""))


def information_provided(model: Column) -> Column:
    given = [F.when(F.contains(F.lower(model), F.lit(name)), name) for name in (NEWS, FREEZE)]
    return _sentence(F.concat_ws(" with ", *given))


def prompt_type(model: Column) -> Column:
    """Label of the prompt; superforecaster prompts stand in brackets and carry their number."""
    name = F.lower(model)
    bracketed = F.when(F.contains(name, F.lit("(" + PROMPTS[2])), F.concat(
        F.lit(PROMPTS[2] + " "), _smallest(name, "[123]", 0)))
    return _sentence(F.coalesce(_first_of(PROMPTS[:2], name), bracketed, F.lit("")))


def model_facets(model: Column) -> Column:
    """STRUCT<prompt, freeze_values, news, base_model> of a displayed model name."""
    prompt, news = F.coalesce(_first_of(PROMPTS, model), F.lit("?")), F.contains(model, F.lit(NEWS))
    number = F.rtrim(F.concat(F.lit(" "), _smallest(model, NEWS + " ([123])", 1)))
    return F.struct(
        F.concat(prompt, F.when(prompt == PROMPTS[2], number).otherwise("")).alias("prompt"),
        F.contains(model, F.lit(FREEZE)).alias("freeze_values"),
        news.alias("news"),
        F.regexp_replace(model, r" \(.*?\)", "").alias("base_model"),
    )


def display_model_name(slug: Column, variant: Column) -> Column:
    return (
        F.when(variant == "zero-shot", slug)
        .when(variant == "zero-shot-with-freeze-values", F.concat(slug, F.lit("†")))
        .otherwise(F.concat(slug, F.lit("-"), variant))
    )


def file_model_name(slug: Column, variant: Column) -> Column:
    return F.when(variant == "zero-shot", slug).otherwise(F.concat(slug, F.lit("-"), variant))


def forecast_file_name(due: Column, organization: Column, model: Column,
                       test: bool = False) -> Column:
    """``{date}.{organization}.{model}.json``, model in lower case with dashes."""
    slug = F.regexp_replace(F.lower(model), r"\s+", "-")
    prefix = "TEST." if test else ""
    return F.concat(F.lit(prefix), F.concat_ws(
        ".", F.date_format(due, "yyyy-MM-dd"), organization, slug, F.lit("json")))


def run_file_name(due: Column, organization: Column, provider: Column, lab: Column,
                  run_key: Column, variant: Column, test: bool = False) -> Column:
    prefix = "TEST." if test else ""
    return F.concat(F.lit(prefix), F.concat_ws(
        ".", F.date_format(due, "yyyy-MM-dd"), organization, provider, lab,
        F.concat(run_key, F.lit("-"), variant), F.lit("json")))


def anonymous_team_number(team: Column) -> Column:
    """Number of an 'Anonymous N' team (1 or more), else null."""
    number = F.regexp_extract(F.trim(team), r"(?i)^anonymous\s+(\d+)$", 1).try_cast("int")
    return F.when(number >= 1, number)


def object_label(identifier: Column) -> Column:
    """Series id as used in file names: slashes become underscores."""
    return F.replace(identifier, F.lit("/"), F.lit("_"))


def yes_index(outcomes_json: Column) -> Column:
    """Zero-based position of the yes outcome in a two-outcome JSON text."""
    outcomes = F.from_json(outcomes_json, "array<string>")
    return F.when(F.lower(F.try_element_at(outcomes, F.lit(1))) == "yes", 0).otherwise(1)


def yes_item(outcomes_json: Column, items_json: Column) -> Column:
    """Entry for the yes outcome in a parallel JSON text array (prices, tokens)."""
    items = F.from_json(items_json, "array<string>")
    return F.try_element_at(items, yes_index(outcomes_json) + F.lit(1))
