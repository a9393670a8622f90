"""Token ids of whole texts by the tokenizers library, with each distinct chunk encoded once.

Both vocabularies cut a text before every change from non-space to space and between a letter and a
mark, whatever stands around, so the ids of a text are the ids of its chunks in order. Special strings
such as ``<|endoftext|>`` that a text quotes get their one id, as from the library, so each is a chunk of
its own. A task looks distinct chunks up in a bounded cache, encodes the new ones in one batch and
gathers ids with numpy.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from probcast.llm.common import _LOWER, _SPACE, gather_ranges, text_bytes

CACHE_CHUNKS = 400_000
JOINED = 64  # chunks that are encoded as one text

# Last bytes that a white space character of several bytes can have.
_LATE_SPACE = np.zeros(256, dtype=bool)
_LATE_SPACE[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _mark_cuts(data: np.ndarray) -> np.ndarray:
    """Places of an ASCII mark right after a letter (ASCII or from the Latin-1 block)."""
    cut = np.zeros(len(data), dtype=bool)
    if len(data):
        letter = _LETTER[data[:-1]]
        latin = (data[1:-1] >= 0x80) & (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
        letter[1:] |= latin
        cut[1:] = _MARK[data[1:]] & letter
    return cut


def _as_runs(data: np.ndarray, first: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    offsets = np.append(first, len(data)).astype(np.int32)
    chunks = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets),
                                                             pa.py_buffer(np.ascontiguousarray(data))])
    return chunks, np.searchsorted(first, bounds)


def special_spans(data: np.ndarray, bounds: np.ndarray, special: re.Pattern | None) -> np.ndarray:
    """Start and end of each special string, one row each; none goes across the bounds."""
    found = [m.span() for m in special.finditer(memoryview(np.ascontiguousarray(data)))] if special else []
    spans = np.array(found, np.int64).reshape(-1, 2)
    row = np.searchsorted(bounds, spans[:, 0], side="right")
    return spans[spans[:, 1] <= bounds[np.minimum(row, len(bounds) - 1)]]


def _keep_whole(cut: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Cut around special strings and not inside them; returns the places inside."""
    inside = gather_ranges(spans[:, 0], spans[:, 1] - spans[:, 0])
    cut[inside] = False
    cut[spans[:, 0]] = True
    cut[spans[spans[:, 1] < len(cut), 1]] = True
    return inside


def spaced_chunks(data: np.ndarray, bounds: np.ndarray, special: re.Pattern | None = None) -> tuple[pa.Array, np.ndarray]:
    """Chunks that keep the white space before them.

    Cuts stand before a space or line end that follows a byte which surely ends a non-space character,
    between a letter and a mark, and around special strings. Fewer cuts only make longer chunks.
    """
    n = len(data)
    cut = _mark_cuts(data)
    if n:
        before = data[:-1]
        plain = (before > 0x20) & (before < 0x7F)
        late = (before >= 0x80) & ~_LATE_SPACE[before]
        late[1:] |= (before[1:] >= 0x80) & (before[:-1] == 0xC3)
        cut[1:] |= ((data[1:] == 0x20) | (data[1:] == 0x0A)) & (plain | late)
        _keep_whole(cut, special_spans(data, bounds, special))
        cut[bounds[:-1][bounds[:-1] < n]] = True
    return _as_runs(data, np.flatnonzero(cut), bounds)


def bare_chunks(data: np.ndarray, bounds: np.ndarray, special: re.Pattern | None = None) -> tuple[pa.Array, np.ndarray]:
    """Chunks without white space, in ASCII lower case (the vocabulary lowers all letters anyway) but
    for special strings."""
    keep = ~_SPACE[data]
    cut = _mark_cuts(data)
    lower = _LOWER[data]
    if len(data):
        cut[1:] |= ~keep[:-1]
        inside = _keep_whole(cut, special_spans(data, bounds, special))
        keep[inside], lower[inside] = True, data[inside]
        cut[bounds[:-1][bounds[:-1] < len(data)]] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    return _as_runs(lower[keep], place[np.flatnonzero(cut & keep)], place[bounds])


def special_pattern(tokenizer) -> re.Pattern | None:
    """The vocabulary's special strings, which the library finds before it does anything else."""
    added = list(tokenizer.get_added_tokens_decoder().values())
    if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
        raise ValueError("only special strings that match literally are supported")
    names = sorted((t.content.encode() for t in added), key=len, reverse=True)
    return re.compile(b"|".join(map(re.escape, names))) if names else None


class TextEncoder:
    """Ids of texts; ``keep_spaces`` for vocabularies whose tokens contain the space before a word."""

    def __init__(self, path: str, keep_spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = special_pattern(self.tokenizer)
        self.quoted = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep_spaces = keep_spaces
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # both alphabets have a letter per byte
        self.bytes[list(vocabulary.values())] = [len(t.removesuffix("</w>")) for t in vocabulary]
        self._reset()

    def _reset(self) -> None:
        self.known = pa.array([], pa.binary())
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _shrink(self) -> None:
        """Keep chunks that came back, at most half of the cache, those used most."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > CACHE_CHUNKS // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[:CACHE_CHUNKS // 2]])
        sizes = self.lengths[kept]
        self.known = self.known.take(pa.array(kept))
        self.pool = self.pool[gather_ranges(self.starts[kept], sizes)]
        self.starts, self.lengths, self.uses = np.cumsum(sizes) - sizes, sizes, np.ones(len(kept), np.int64)

    def _lookup(self, chunks: pa.Array) -> np.ndarray:
        """Place in the cache of every chunk. Known chunks and these are numbered in one pass of the
        dictionary encoder, known ones first, so that what comes after them is new."""
        if len(self.known) > CACHE_CHUNKS:
            self._shrink()
        before = len(self.known)
        encoded = pa.concat_arrays([self.known, chunks]).dictionary_encode()
        at = np.asarray(encoded.indices)[before:]
        if len(encoded.dictionary) > before:
            self.known = encoded.dictionary
            sizes, flat = self._encode_new(self.known.slice(before))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
            self.lengths = np.concatenate([self.lengths, sizes])
            self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int64)])
            self.pool = np.concatenate([self.pool, flat])
        self.uses += np.bincount(at, minlength=len(self.uses))
        return at

    def _encode_new(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes, flat = [], []
        joinable = self._joinable(chunks)
        order = np.concatenate([np.flatnonzero(joinable), np.flatnonzero(~joinable)])
        joined = int(joinable.sum())
        chunks = chunks.take(pa.array(order))
        for first, last, encode in ((0, joined, self._encode_joined), (joined, len(chunks), self._encode_single)):
            for at in range(first, last, 8192):
                n, ids = encode(chunks.slice(at, min(8192, last - at)))
                sizes.append(n)
                flat.append(ids)
        found, ids = np.concatenate(sizes), np.concatenate(flat)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return found[back], ids[gather_ranges((np.cumsum(found) - found)[back], found[back])]

    def _joinable(self, chunks: pa.Array) -> np.ndarray:
        """Chunks that the library would cut from each other in one text, and whose tokens' bytes are
        their own bytes: with spaces, those that start with a space or line end and end with an ASCII
        letter, digit or mark; without, those in ASCII and letters from the Latin-1 block, which lower case
        and composition leave as long as they are, put next to each other with a space between."""
        data, bounds = text_bytes(chunks.view(pa.string()))
        first, last = data[bounds[:-1]], data[bounds[1:] - 1]
        if self.keep_spaces:
            return ((first == 0x20) | (first == 0x0A)) & (last > 0x20) & (last < 0x7F)
        wide = np.concatenate([[0], np.cumsum((data >= 0xC0) & (data != 0xC3))])
        quoted = np.asarray(pc.is_in(chunks, value_set=pa.array(self.quoted, pa.binary())))
        return (wide[bounds[1:]] == wide[bounds[:-1]]) & ~quoted

    def _encode_single(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(
            chunks.view(pa.string()).to_pylist(), add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))

    def _encode_joined(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Some chunks to a text; where one ends is found by the bytes of the tokens. If a chunk's end is
        not a token's end, all are encoded one by one."""
        glue = "" if self.keep_spaces else " "
        texts = chunks.view(pa.string()).to_pylist()
        found = self.tokenizer.encode_batch_fast(
            [glue.join(texts[i:i + JOINED]) for i in range(0, len(texts), JOINED)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        reached = np.cumsum(self.bytes[ids])
        ends = np.cumsum(np.diff(text_bytes(chunks.view(pa.string()))[1]))
        last = np.searchsorted(reached, ends)
        if last[-1] != len(ids) - 1 or (reached[last] != ends).any():
            return self._encode_single(chunks)
        return np.diff(last, prepend=-1), ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in one array, and the row bounds in it; null counts as empty."""
        data, bounds = text_bytes(texts)
        runs, rows = (spaced_chunks if self.keep_spaces else bare_chunks)(data, bounds, self.special)
        entry = self._lookup(runs)
        sizes = self.lengths[entry]
        ids = self.pool[gather_ranges(self.starts[entry], sizes)]
        return ids, np.concatenate([[0], np.cumsum(sizes)])[rows]


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Every row's ids followed by the end id."""
    return np.insert(ids, bounds[1:], np.uint32(end)), bounds + np.arange(len(bounds))
