"""Sampled segmentations over the piece lattice of a SentencePiece vocabulary, and lossless decoding.

Every text spans a lattice whose edges are the pieces that match at each place; an edge weighs
``(rank + smoothing) ** -sharpness``, rank being its place in the vocabulary, so frequent pieces are
likelier. A forward pass sums the weights of all paths to each node, and a backward pass samples one
path with its exact probability (forward filtering, backward sampling). Random numbers come from the
row's key, the chunk's number in the row and the step, so a row's segmentation never depends on how
the table is cut into tasks.

Pieces contain a space only at their start, so the lattice falls apart before every space that
follows another character, and around line ends; forward sums are made once for each distinct chunk
of a slice and all occurrences are sampled together. Characters without a piece, and the space mark
itself, become their UTF-8 bytes; nothing is normalised, so decoding gives back the text.

Defined cases: null and empty texts have no tokens and decode to an empty text; equal keys with equal
texts get equal segmentations; a null key is a key of its own; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from probcast.llm.common import bounded_batches, gather_ranges, mix, text_bytes, text_slices

MARK = 0x2581  # stands for a space in pieces
NO_CHAR = 0x110000
STEP = np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = 21


@dataclass(frozen=True)
class SamplingOptions:
    sharpness: float = 1.0
    smoothing: float = 10.0
    seed: int = 0


class PieceVocabulary:
    """Piece weights, a hash table from character runs to pieces, and the bytes of each piece."""

    def __init__(self, path: str, options: SamplingOptions):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * size
        self.byte_piece = np.zeros(256, np.int64)
        normal = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_piece[value] = i
                self.bytes[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal.append(i)
                self.bytes[i] = piece.replace("▁", " ").encode()
        order = sorted(normal, key=lambda i: -model.get_score(i))
        self.weight = np.zeros(size)
        self.weight[order] = -options.sharpness * np.log(np.arange(len(order)) + options.smoothing)
        self.unknown_weight = -options.sharpness * np.log(size + options.smoothing)
        pieces = [model.id_to_piece(i) for i in normal]
        self.longest = max(map(len, pieces))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4").astype(np.uint64)
        ends = np.cumsum(lengths)
        hashes = np.zeros(len(pieces), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.longest):
                at = np.flatnonzero(lengths > k)
                hashes[at] = hashes[at] * STEP + points[(ends - lengths)[at] + k] + np.uint64(1)
        hashes = mix(hashes)
        self._first, self._second = np.full(1 << TABLE_BITS, -1, np.int32), np.full(1 << TABLE_BITS, -1, np.int32)
        self._hash, self._piece = hashes, np.array(normal, np.int32)
        mask = np.uint64((1 << TABLE_BITS) - 1)
        self._mask = mask
        for k, h in enumerate(hashes):
            low, high = int(h & mask), int(h >> np.uint64(40) & mask)
            if self._first[low] < 0:
                self._first[low] = k
            elif self._second[high] < 0:
                self._second[high] = k
            else:
                raise ValueError("two pieces share both places of the hash table")
        sizes = np.fromiter(map(len, self.bytes), np.int64, size)
        self._starts, self._sizes = np.cumsum(sizes) - sizes, sizes
        self._pool = np.frombuffer(b"".join(self.bytes), np.uint8)

    def lookup(self, rolled: np.ndarray) -> np.ndarray:
        """Piece of each rolled hash, -1 where there is none."""
        h = mix(rolled)
        found = np.full(len(h), -1, np.int32)
        for table, place in ((self._first, h & self._mask), (self._second, h >> np.uint64(40) & self._mask)):
            k = table[place.astype(np.int64)]
            hit = (k >= 0) & (self._hash[k] == h)
            found[hit] = self._piece[k[hit]]
        return found

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all rows, and the row bounds in them."""
        sizes = self._sizes[ids]
        data = self._pool[gather_ranges(self._starts[ids], sizes)]
        return data, np.concatenate([[0], np.cumsum(sizes)])[bounds]


@dataclass
class Lattice:
    """Backward tables of distinct chunks: nodes are (chunk, end place), edges sorted by end node."""

    last_node: np.ndarray
    cumulative: np.ndarray  # node number + cumulative probability of its incoming edges
    edge_end: np.ndarray
    edge_length: np.ndarray
    edge_piece: np.ndarray  # beyond the vocabulary: characters without a piece
    unknown: np.ndarray


def chunk_bounds(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First bytes of chunks: row starts, spaces after other bytes, line ends, and what follows them."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n:
        line = data == 0x0A
        cut[1:] = ((data[1:] == 0x20) & (data[:-1] != 0x20)) | line[1:] | line[:-1]
        cut[bounds[:-1][bounds[:-1] < n]] = True
    return np.flatnonzero(cut)


def build_lattice(chunks: list[bytes], vocabulary: PieceVocabulary) -> Lattice:
    """Forward sums of all chunks at once, place by place."""
    texts = [c.decode("utf-8", "surrogatepass") for c in chunks]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    points = np.where(points == MARK, NO_CHAR, np.where(points == 0x20, MARK, points))
    total = len(points)
    ends = np.cumsum(lengths)
    chunk = np.repeat(np.arange(len(texts)), lengths)
    left = ends[chunk] - np.arange(total)  # characters from here to the chunk's end
    first_node = ends - lengths + np.arange(len(texts))
    node = np.arange(total) + chunk  # node before each character
    starts, sizes, pieces = [], [], []
    rolled = np.zeros(total, np.uint64)
    at = np.arange(total)
    with np.errstate(over="ignore"):
        for length in range(1, vocabulary.longest + 1):
            at = at[left[at] >= length]
            if not len(at):
                break
            rolled[at] = rolled[at] * STEP + points[at + length - 1].astype(np.uint64) + np.uint64(1)
            found = vocabulary.lookup(rolled[at])
            hit = found >= 0
            starts.append(at[hit])
            sizes.append(np.full(int(hit.sum()), length))
            pieces.append(found[hit].astype(np.int64))
            if length == 1:
                alone = at[~hit]
                unknown, code = np.unique(points[alone], return_inverse=True)
                starts.append(alone)
                sizes.append(np.ones(len(alone), np.int64))
                pieces.append(code + len(vocabulary.bytes))
    start, size, piece = np.concatenate(starts), np.concatenate(sizes), np.concatenate(pieces)
    begin = node[start]
    end = begin + size
    place = start - (ends - lengths)[chunk[start]] + size
    order = np.lexsort((end, place))
    begin, end, size, piece, place = begin[order], end[order], size[order], piece[order], place[order]
    weight = np.where(piece < len(vocabulary.bytes), vocabulary.weight[np.minimum(piece, len(vocabulary.bytes) - 1)],
                      vocabulary.unknown_weight)
    alpha = np.full(total + len(texts), -np.inf)
    alpha[first_node] = 0.0
    value = np.empty(len(begin))
    steps = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
    for a, b in zip(steps[:-1], steps[1:]):
        v = alpha[begin[a:b]] + weight[a:b]
        value[a:b] = v
        group = np.flatnonzero(np.r_[True, end[a + 1:b] != end[a:b - 1]])
        top = np.maximum.reduceat(v, group)
        nodes = end[a:b][group]
        span = np.diff(np.r_[group, b - a])
        alpha[nodes] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, span)), group))
    order = np.argsort(end, kind="stable")
    end, size, piece = end[order], size[order], piece[order]
    share = np.exp(value[order] - alpha[end])
    running = np.cumsum(share)
    group = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
    span = np.diff(np.r_[group, len(end)])
    base = np.repeat(running[group] - share[group], span)
    cumulative = end + np.minimum(running - base, 1.0)
    cumulative[np.r_[group[1:], len(end)] - 1] = end[np.r_[group[1:], len(end)] - 1] + 1.0
    return Lattice(first_node + lengths, cumulative, end, size, piece, unknown)


def sample_ids(texts: pa.Array, keys: list, vocabulary: PieceVocabulary,
               options: SamplingOptions) -> tuple[np.ndarray, np.ndarray]:
    """Ids of one sampled segmentation of each row, and the row bounds in them."""
    data, bounds = text_bytes(texts)
    first = chunk_bounds(data, bounds)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    offsets = np.append(first, len(data)).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets),
                                                           pa.py_buffer(np.ascontiguousarray(data))])
    encoded = runs.dictionary_encode()
    rows = np.searchsorted(first, bounds)
    lattice = build_lattice(encoded.dictionary.to_pylist(), vocabulary)
    kind = np.asarray(encoded.indices)
    count = np.diff(rows)
    number = np.arange(len(kind)) - np.repeat(rows[:-1], count)
    seeds = np.fromiter((xxhash.xxh3_64_intdigest(repr(k), seed=options.seed) for k in keys), np.uint64, len(keys))
    stream = mix(np.repeat(seeds, count) + mix(number.astype(np.uint64)))
    node = lattice.last_node[kind]
    stop = node - np.diff(np.r_[-1, lattice.last_node])[kind] + 1
    active = np.arange(len(kind))
    taken_at, taken_piece, step, depth = [], [], 0, np.zeros(len(kind), np.int64)
    with np.errstate(over="ignore"):
        while len(active):
            bits = mix(stream[active] + np.uint64(step) * STEP)
            u = (bits >> np.uint64(12)).astype(np.float64) * 2.0 ** -52
            here = node[active]
            edge = np.searchsorted(lattice.cumulative, here + u, side="right")
            edge = np.minimum(edge, len(lattice.cumulative) - 1)
            edge = np.where(lattice.edge_end[edge] == here, edge, edge - 1)
            taken_at.append(active)
            taken_piece.append(lattice.edge_piece[edge])
            node[active] = here - lattice.edge_length[edge]
            depth[active] += 1
            active = active[node[active] > stop[active]]
            step += 1
    offset = np.cumsum(depth)
    ids = np.empty(int(offset[-1]), np.int64)
    for s, (at, piece) in enumerate(zip(taken_at, taken_piece)):
        ids[offset[at] - 1 - s] = piece
    ends = np.concatenate([[0], offset])[rows]
    size = len(vocabulary.bytes)
    strange = ids >= size
    if strange.any():
        own = [vocabulary.byte_piece[list(("▁" if c == NO_CHAR else chr(c)).encode("utf-8", "surrogatepass"))]
               for c in lattice.unknown.tolist()]
        widths = np.ones(len(ids), np.int64)
        widths[strange] = np.array(list(map(len, own)))[ids[strange] - size]
        pool = np.concatenate([np.arange(size), *own])
        starts = np.concatenate([np.arange(size), size + np.cumsum(list(map(len, own))) - list(map(len, own))])
        ids = pool[gather_ranges(starts[ids].astype(np.int64), widths)]
        ends = np.concatenate([[0], np.cumsum(widths)])[ends]
    return ids, ends


def sample_segmentations(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
                         options: SamplingOptions = SamplingOptions(), keep_ids: bool = True) -> DataFrame:
    """``id``, ``n_tokens``, ``ids_crc32``, ``lossless`` (the ids decode to the text) and ``ids``."""
    bounded_batches(docs.sparkSession)
    schema = docs.select(F.col(key).alias("id")).schema
    for name, kind in (("n_tokens", "long"), ("ids_crc32", "long"), ("lossless", "boolean")):
        schema = schema.add(name, kind)
    if keep_ids:
        schema = schema.add("ids", "binary")

    def run(batches):
        vocabulary = PieceVocabulary(path, options)
        for part in text_slices(batches, "_text"):
            ids, bounds = sample_ids(part.column("_text"), part.column("id").to_pylist(), vocabulary, options)
            data, edges = text_bytes(part.column("_text"))
            back, places = vocabulary.decode(ids, bounds)
            if len(back) == len(data) and np.array_equal(places, edges) and np.array_equal(back, data):
                same = np.ones(len(part), bool)
            else:
                same = np.array([np.array_equal(back[a:b], data[c:d]) for a, b, c, d in
                                 zip(places[:-1], places[1:], edges[:-1], edges[1:])], bool)
            raw = memoryview(ids.astype("<u4").tobytes())
            cuts = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
            columns = [part.column("id"), pa.array(np.diff(bounds)),
                       pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in cuts], pa.int64()), pa.array(same)]
            names = ["id", "n_tokens", "ids_crc32", "lossless"]
            if keep_ids:
                columns.append(pa.array([bytes(raw[4 * a:4 * b]) for a, b in cuts], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(key).alias("id"), F.col(text).alias("_text")).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns with the decoded ``text``; null ids decode to an empty text."""
    schema = rows.drop("text").schema.add("text", "string")

    def run(batches):
        vocabulary = PieceVocabulary(path, SamplingOptions())
        for batch in batches:
            texts = [b"".join(vocabulary.bytes[i] for i in np.frombuffer(x or b"", "<u4").tolist()).decode("utf-8", "replace")
                     for x in batch.column(ids).to_pylist()]
            yield batch.append_column("text", pa.array(texts, pa.string()))

    return rows.drop("text").mapInArrow(run, schema)
