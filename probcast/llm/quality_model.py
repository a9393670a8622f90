"""Quality by logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

A text's tokens are its runs of letters and digits (lower-cased) and its runs of other visible
characters. Next to each word stands its class: all capitals, capital first, plain, number or marks,
or "echo" for a word equal to the one before it. Features are hashed 1- to ``order``-grams of words, the
same of classes, and the share of words that occur before in the text; a text's vector is the count of
each feature over the number of words. The score is the logistic function of a sparse dot product.

Training takes a bounded sample of labelled texts; updates are per coordinate
(follow-the-regularised-leader, L1 and L2). Scoring takes every whole text.

Defined cases: null and empty texts have no features and score by the intercept; null labels are not
learned from; without labels every score is 0.5, and with one class the intercept alone speaks;
repeated rows count as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from probcast.llm.common import bounded_batches, mix, sample_labelled, text_bytes, text_slices

CLASSES = ("mark", "number", "plain", "first capital", "capitals", "echo")


@dataclass(frozen=True)
class QualityOptions:
    """``low_rows`` and ``high_rows`` bound the labelled texts that are learned from."""

    low_rows: int = 3000
    high_rows: int = 6000
    order: int = 2
    buckets_log2: int = 18
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-3
    scale: float = 8.0
    seed: int = 11


_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[[0x20, *range(0x09, 0x0E)]] = True
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Tokens of each row: codes, row bounds, distinct tokens (bytes, case kept)."""
    data, bounds = text_bytes(texts)
    kind = np.where(_VISIBLE[data], 0, np.where(_WORD_BYTE[data], 1, 2)).astype(np.uint8)
    starts = kind > 0
    if len(data):
        starts[1:] &= kind[1:] != kind[:-1]
        edges = bounds[:-1][bounds[:-1] < len(data)]
        starts[edges] = kind[edges] > 0
    keep = kind > 0
    first = np.flatnonzero(starts)
    place = np.concatenate([[0], np.cumsum(keep)]).astype(np.int64)
    body = np.ascontiguousarray(data[keep])
    offsets = np.append(place[first], len(body)).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    encoded = runs.dictionary_encode()
    return np.asarray(encoded.indices), np.searchsorted(first, bounds), encoded.dictionary


def _word_class(word: bytes) -> int:
    first = word[0]
    if not (_WORD_BYTE[first]):
        return 0
    if 48 <= first <= 57:
        return 1
    text = word.decode("utf-8", "replace")
    if text.isupper() and len(text) > 1:
        return 4
    return 3 if text[:1].isupper() else 2


def ngram_features(texts: pa.Array, options: QualityOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of the features of each row (a feature may come in several entries)."""
    codes, bounds, distinct = tokens(texts)
    words = distinct.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) for w in words), np.uint64, len(words))
    kinds = np.fromiter(map(_word_class, words), np.int64, len(words))
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    word, kind = hashes[codes], kinds[codes]
    seen = np.zeros(len(codes), bool)
    if len(codes):
        same = np.zeros(len(codes), bool)
        same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
        kind = np.where(same, 5, kind)
        order = np.lexsort((word, row))
        again = (word[order][1:] == word[order][:-1]) & (row[order][1:] == row[order][:-1])
        seen[order[1:]] = again
    shape = mix(kind.astype(np.uint64) + np.uint64(0xA5A5))
    mask = np.uint64((1 << options.buckets_log2) - 1)
    step = np.uint64(0x9E3779B97F4A7C15)
    size = np.maximum(np.diff(bounds), 1).astype(np.float64)
    rows, buckets, values = [], [], []

    def add(r, h, weight=1.0):
        rows.append(r)
        buckets.append((mix(h) & mask).astype(np.int64))
        values.append(weight / size[r])

    with np.errstate(over="ignore"):
        for base, salt in ((word, 1), (shape, 2)):
            rolled = np.full(len(base), np.uint64(salt))
            for n in range(1, options.order + 1):
                if len(base) < n:
                    break
                rolled = rolled[:len(base) - n + 1] * step + base[n - 1:]
                inside = row[:len(base) - n + 1] == row[n - 1:]
                add(row[:len(base) - n + 1][inside], rolled[inside])
        mark = np.full(int(seen.sum()), np.uint64(3))
        add(row[seen], mark)
    return np.concatenate(rows), np.concatenate(buckets), np.concatenate(values)


def _merged(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, rows: int, log2: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their summed values, row by row."""
    key, inverse = np.unique(row << log2 | bucket, return_inverse=True)
    total = np.bincount(inverse, value, minlength=len(key))
    cuts = np.searchsorted(key, np.arange(rows + 1) << log2)
    buckets = key & ((1 << log2) - 1)
    return [(buckets[a:b], total[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def train_ftrl(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray,
               options: QualityOptions) -> tuple[np.ndarray, float]:
    """Weights and intercept after FTRL-proximal updates in a seeded order."""
    size = 1 << options.buckets_log2
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    bias = bias_n = 0.0
    generator = np.random.default_rng(options.seed)
    for _ in range(options.epochs):
        for i in generator.permutation(len(examples)):
            at, x = examples[i]
            x = x * options.scale
            p = 1 / (1 + np.exp(-np.clip(float(w[at] @ x) + bias, -30, 30)))
            error = (p - labels[i]) * weights[i]
            g = error * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / options.alpha
            z[at] += g - sigma * w[at]
            n[at] += g * g
            shrunk = np.maximum(np.abs(z[at]) - options.l1, 0) * np.sign(z[at])
            w[at] = -shrunk / ((options.beta + np.sqrt(n[at])) / options.alpha + options.l2)
            bias_n += error * error
            bias -= 0.1 * error / (1 + np.sqrt(bias_n))
    return (w * options.scale).astype(np.float32), float(bias)


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    options: QualityOptions


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id",
                options: QualityOptions = QualityOptions()) -> QualityModel:
    """Learn from a bounded sample of labelled texts; their feature rows are made by Spark tasks."""
    bounded_batches(docs.sparkSession)
    sample, sizes = sample_labelled(docs, labels, label, {0: options.low_rows, 1: options.high_rows}, key)

    def run(batches):
        for part in text_slices(batches):
            merged = _merged(*ngram_features(part.column("text"), options), len(part), options.buckets_log2)
            yield pa.RecordBatch.from_arrays(
                [part.column("y"), pa.array([b.astype("<u4").tobytes() for b, _ in merged], pa.binary()),
                 pa.array([v.astype("<f4").tobytes() for _, v in merged], pa.binary())], names=["y", "b", "v"])

    rows = sample.mapInArrow(run, "y int, b binary, v binary").collect()
    rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(bytes(r["b"])), r["y"]))
    if not rows:
        return QualityModel(np.zeros(1 << options.buckets_log2, np.float32), 0.0, options)
    examples = [(np.frombuffer(r["b"], "<u4").astype(np.int64), np.frombuffer(r["v"], "<f4").astype(float)) for r in rows]
    y = np.array([r["y"] for r in rows], float)
    taken = {0: max((y == 0).sum(), 1), 1: max((y == 1).sum(), 1)}
    total = sum(sizes.values())
    weight = np.where(y > 0, sizes.get(1, 0) / total / taken[1], sizes.get(0, 0) / total / taken[0]) * len(y)
    return QualityModel(*train_ftrl(examples, y, np.clip(weight, 0.25, 4), options), options)


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns with ``score`` (0 to 1) of every whole text."""
    bounded_batches(docs.sparkSession)
    schema = docs.select(*keep).schema.add("score", "double")

    def run(batches):
        for part in text_slices(batches, "_text", 4 << 20):
            row, bucket, value = ngram_features(part.column("_text"), model.options)
            z = model.bias + np.bincount(row, model.weights[bucket] * value, minlength=len(part))
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[part.column(f"_k{i}") for i in range(len(keep))], pa.array(score)],
                                             names=[*keep, "score"])

    source = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    return source.mapInArrow(run, schema)
