"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

A sentence is a bag of units: its lower-cased words, and runs of three or more single-character
words joined ("i d i o t"). The kernel of two units sums, over all character triples, the products
of their occurrence weights; an occurrence that spans ``s`` characters weighs ``decay ** s``, with
spans up to seven; the unit's start and end count as characters. Inserted characters and gaps so lower the similarity only a little; characters
other than letters and digits take up room but never match. The kernel is normalised to 1.

Landmark units define Nystroem features, a linear machine with squared hinge loss is trained on
them, and a sentence is as toxic as its worst unit (multiple-instance learning: in each toxic text
the worst units are the witnesses, all units of other texts are negative). Since the machine is
linear in triples, it folds into one weight per triple, and scoring a unit sums these weights.
A text's score is a logistic function of its three worst margins, the number of units
above the machine's boundary, and the number of units.

Defined cases: null and empty texts and texts without units have the margin floor (no evidence);
null labels are not learned from; without both classes every score is the share of toxic labels (0
without labels) and learning is skipped; repeated rows and clashing extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from probcast.llm.common import bounded_batches, sample_labelled, split_words, stored, text_slices

SPAN = 7
DECAY = 0.5
ALPHABET_BITS = 7
PATTERNS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
CACHE_UNITS = 300_000


@dataclass(frozen=True)
class ToxicityOptions:
    """Bounds of what the driver learns from; none of them limits what is scored."""

    toxic_rows: int = 3000
    other_rows: int = 6000
    positives: int = 3000
    negatives: int = 12000
    landmarks: int = 96
    rounds: int = 3
    hard_negatives: int = 2000
    lift: float = 4.0
    witnesses: int = 3
    cost: float = 10.0
    seed: int = 7


@dataclass
class ToxicityModel:
    codes: np.ndarray
    weights: np.ndarray
    bias: float
    calibration: tuple[float, ...]


def _alphabet(points: np.ndarray) -> np.ndarray:
    """Small code of each code point: letters and digits from 1, everything else 0."""
    out = np.zeros(len(points), np.int32)
    small = (points >= 97) & (points <= 122)
    out[small] = points[small] - 96
    digit = (points >= 48) & (points <= 57)
    out[digit] = points[digit] - 21
    other = points >= 0xAA
    out[other] = 37 + points[other] % 88
    return out


START, END = 126, 127


def unit_triples(units: list[str]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """For each gap pattern its weight, and the unit number and triple code of every occurrence."""
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    number = np.repeat(np.arange(len(units), dtype=np.int32), lengths + 2)
    ends = np.cumsum(lengths + 2)
    chars = np.zeros(len(number), np.int32)
    inner = np.ones(len(number), bool)
    inner[ends - 1] = inner[ends - lengths - 2] = False
    chars[inner] = _alphabet(points)
    chars[ends - lengths - 2], chars[ends - 1] = START, END
    for a, b in PATTERNS:
        if len(chars) <= b:
            continue
        first, last = chars[:-b], chars[b:]
        middle = chars[a:len(chars) - b + a]
        good = (number[:-b] == number[b:]) & (first > 0) & (middle > 0) & (last > 0)
        at = np.flatnonzero(good)
        code = (first[at] << (2 * ALPHABET_BITS)) | (middle[at] << ALPHABET_BITS) | last[at]
        yield DECAY ** (b + 1), number[at], code


def unit_features(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted sparse feature rows: unit number, triple code, weight normalised to length 1."""
    parts = [(n.astype(np.int64) << (3 * ALPHABET_BITS) | c, np.full(len(c), w, np.float64))
             for w, n, c in unit_triples(units)]
    if not parts or not sum(len(p[0]) for p in parts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    weight = np.bincount(inverse, np.concatenate([p[1] for p in parts]))
    unit = keys >> (3 * ALPHABET_BITS)
    norm = np.sqrt(np.bincount(unit, weight * weight, minlength=len(units)))
    return unit, keys & ((1 << (3 * ALPHABET_BITS)) - 1), weight / norm[unit]


def kernel_with(landmarks: list[str], units: list[str], block: int = 2000) -> np.ndarray:
    """Normalised kernel values, one row per unit and one column per landmark."""
    lu, lc, lw = unit_features(landmarks)
    codes, place = np.unique(lc, return_inverse=True)
    dense = np.zeros((len(codes), len(landmarks)))
    dense[place, lu] = lw
    out = np.zeros((len(units), len(landmarks)))
    for start in range(0, len(units), block):
        part = units[start:start + block]
        u, c, w = unit_features(part)
        at = np.searchsorted(codes, c)
        hit = (at < len(codes)) & (codes[np.minimum(at, len(codes) - 1)] == c) if len(codes) else np.zeros(len(c), bool)
        u, at, w = u[hit], at[hit], w[hit]
        if len(u):
            first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
            out[start + u[first]] = np.add.reduceat(dense[at] * w[:, None], first, axis=0)
    return out


def _pick_landmarks(units: list[str], weight: np.ndarray, count: int) -> list[str]:
    """Greedy landmarks (pivoted Cholesky): always the unit with the largest weighted residual."""
    residual = np.ones(len(units))
    factors = np.zeros((len(units), 0))
    chosen: list[int] = []
    for _ in range(min(count, len(units))):
        best = int(np.argmax(residual * weight))
        if residual[best] < 1e-6:
            break
        column = kernel_with([units[best]], units)[:, 0]
        column = (column - factors @ factors[best]) / np.sqrt(residual[best])
        factors = np.column_stack([factors, column])
        residual = np.maximum(residual - column * column, 0)
        residual[best] = 0
        chosen.append(best)
    return [units[i] for i in chosen]


def _train_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> np.ndarray:
    """Squared-hinge support vector machine by Newton steps; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-3
    for _ in range(30):
        gap = 1 - y * (x @ w)
        active = gap > 0
        xa, wa = x[active], weight[active] * cost
        gradient = ridge * w - xa.T @ (wa * y[active] * gap[active])
        step = np.linalg.solve(np.diag(ridge) + (xa * wa[:, None]).T @ xa, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _fit_units(positive: list[str], support: np.ndarray, negative: list[str],
               options: ToxicityOptions) -> tuple[np.ndarray, np.ndarray, float]:
    """Triple weights and bias of the machine for given positive and negative units."""
    half = options.landmarks // 2
    landmarks = list(dict.fromkeys(
        _pick_landmarks(positive, np.sqrt(support), options.landmarks - half)
        + _pick_landmarks(negative[-options.hard_negatives:], np.ones(len(negative[-options.hard_negatives:])), half)))
    values, vectors = np.linalg.eigh(kernel_with(landmarks, landmarks))
    good = values > 1e-8
    root = vectors[:, good] / np.sqrt(values[good])
    x = kernel_with(landmarks, positive + negative) @ root
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    weight = np.r_[support / support.sum() * len(negative), np.ones(len(negative))] / len(negative)
    w = _train_machine(x, y, weight * 100, options.cost)
    lu, lc, lw = unit_features(landmarks)
    codes, place = np.unique(lc, return_inverse=True)
    return codes, np.bincount(place, lw * (root @ w[:-1])[lu]), float(w[-1])


class UnitScorer:
    """Margins of units, with a bounded cache of units seen before by this task."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, bias: float):
        self.table = np.zeros(1 << (3 * ALPHABET_BITS), np.float32)
        self.table[codes] = weights
        self.bias = bias
        self.cache: dict[bytes, float] = {}

    def margins(self, units: list[str]) -> np.ndarray:
        """Margin of each unit; units without positive evidence share the floor, the bias."""
        raw = np.zeros(len(units))
        for w, number, code in unit_triples(units):
            value = self.table[code]
            hit = value != 0
            raw += w * np.bincount(number[hit], value[hit], minlength=len(units))
        out = np.full(len(units), self.bias)
        above = np.flatnonzero(raw > 0)
        for start in range(0, len(above), 20000):
            part = above[start:start + 20000]
            out[part] += raw[part] / self._norms([units[i] for i in part])
        return out

    @staticmethod
    def _norms(units: list[str]) -> np.ndarray:
        keys, weights = [], []
        for w, n, c in unit_triples(units):
            keys.append(n.astype(np.int64) << (3 * ALPHABET_BITS) | c)
            weights.append(np.full(len(c), w))
        keys, weights = np.concatenate(keys), np.concatenate(weights)
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        total = np.add.reduceat(weights, first)
        return np.sqrt(np.bincount(keys[first] >> (3 * ALPHABET_BITS), total * total, minlength=len(units)))

    def of_words(self, words: pa.Array) -> np.ndarray:
        """Margins of distinct words given as bytes."""
        cache = self.cache
        if len(cache) > CACHE_UNITS:
            cache.clear()
        keys = words.to_pylist()
        new = [k for k in keys if k not in cache]
        if new:
            for start in range(0, len(new), 50000):
                part = new[start:start + 50000]
                found = self.margins([k.decode("utf-8", "replace").lower() for k in part])
                cache.update(zip(part, found.tolist()))
        return np.fromiter(map(cache.__getitem__, keys), np.float64, len(keys))


def _spelled_runs(codes: np.ndarray, bounds: np.ndarray, words: pa.Array) -> tuple[list[str], np.ndarray]:
    """Runs of three or more single-character words, joined, with the row of each."""
    keys = words.to_pylist() if len(words) < 2000 else None
    sizes = np.asarray(pc.binary_length(words)) if len(words) else np.zeros(0, np.int64)
    short = np.flatnonzero(sizes <= 4)
    single = np.zeros(len(words), bool)
    text: dict[int, str] = {}
    for i in short.tolist():
        s = (keys[i] if keys else words[i].as_py()).decode("utf-8", "replace")
        if len(s) == 1:
            single[i] = True
            text[i] = s.lower()
    flag = single[codes]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = flag.copy()
    start[1:] &= ~flag[:-1] | (row[1:] != row[:-1])
    first = np.flatnonzero(start)
    stop = flag.copy()
    stop[:-1] &= ~flag[1:] | (row[1:] != row[:-1])
    last = np.flatnonzero(stop) + 1
    long = last - first >= 3
    runs = ["".join(text[c] for c in codes[a:b].tolist()) for a, b in zip(first[long], last[long])]
    return runs, row[first[long]]


def text_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Units of each row: code and row of each unit, and the distinct units as bytes."""
    codes, bounds, words = split_words(texts, lower=True)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    runs, at = _spelled_runs(codes, bounds, words)
    if runs:
        extra = pa.array([r.encode("utf-8", "replace") for r in runs], pa.binary())
        codes = np.concatenate([codes, len(words) + np.arange(len(runs))])
        row = np.concatenate([row, at])
        words = pa.concat_arrays([words, extra])
    return codes, row, words


def text_evidence(margin: np.ndarray, row: np.ndarray, rows: int, floor: float) -> np.ndarray:
    """Per row: the three largest margins (missing ones are the floor), log counts of units above
    the boundary and of all units."""
    out = np.full((rows, 5), floor)
    out[:, 3] = np.log1p(np.bincount(row[margin > 0], minlength=rows))
    out[:, 4] = np.log1p(np.bincount(row, minlength=rows))
    keep = margin > floor
    margin, row = margin[keep], row[keep]
    order = np.lexsort((-margin, row))
    margin, row = margin[order], row[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    top = place < 3
    out[row[top], place[top]] = margin[top]
    return out


EVIDENCE = ("m1", "m2", "m3", "hits", "units")


def text_margins(docs: DataFrame, codes: np.ndarray, weights: np.ndarray, bias: float,
                 keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns with the evidence (see ``text_evidence``) of each whole text."""
    bounded_batches(docs.sparkSession)
    schema = docs.select(*keep).schema
    for name in EVIDENCE:
        schema = schema.add(f"_{name}", "double")

    def run(batches):
        scorer = UnitScorer(codes, weights, bias)
        for part in text_slices(batches, "_text"):
            unit, row, words = text_units(part.column("_text"))
            margin = scorer.of_words(words)[unit]
            found = text_evidence(margin, row, len(part), bias)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(f"_k{i}") for i in range(len(keep))], *map(pa.array, found.T.copy())],
                names=[*keep, *[f"_{n}" for n in EVIDENCE]])

    source = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    return source.mapInArrow(run, schema)


def _unit_counts(rows: DataFrame) -> DataFrame:
    """Texts of either label that contain each unit: unit, pos, neg."""

    def run(batches):
        for part in text_slices(batches):
            unit, row, words = text_units(part.column("text"))
            toxic = np.asarray(part.column("y").to_numpy(zero_copy_only=False)) > 0
            pair = np.unique(unit.astype(np.int64) * len(part) + row)
            u, y = pair // max(len(part), 1), toxic[pair % max(len(part), 1)]
            pos = np.bincount(u[y], minlength=len(words))
            neg = np.bincount(u[~y], minlength=len(words))
            yield pa.RecordBatch.from_arrays([words, pa.array(pos), pa.array(neg)], names=["unit", "pos", "neg"])

    counts = rows.select("text", "y").mapInArrow(run, "unit binary, pos long, neg long")
    return counts.groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _score_units(units: DataFrame, fitted: tuple) -> DataFrame:
    codes, weights, bias = fitted

    def run(batches):
        scorer = UnitScorer(codes, weights, bias)
        for b in batches:
            margin = scorer.margins([u.decode("utf-8", "replace").lower() for u in b.column("unit").to_pylist()])
            yield b.append_column("margin", pa.array(margin))

    return units.mapInArrow(run, "unit binary, pos long, neg long, lift double, margin double")


def _units(rows, name: str = "unit") -> list[str]:
    return [bytes(r[name]).decode("utf-8", "replace").lower() for r in rows]


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id",
                 options: ToxicityOptions = ToxicityOptions()) -> ToxicityModel:
    """Learn from a bounded sample of labelled texts (``toxic_rows`` and ``other_rows``)."""
    sample, sizes = sample_labelled(docs, labels, label, {0: options.other_rows, 1: options.toxic_rows}, key)
    sample = stored(sample)
    share = min(max(sizes.get(1, 0) / max(sum(sizes.values()), 1), 1e-4), 1 - 1e-4)
    taken = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    no_model = ToxicityModel(np.zeros(0, np.int64), np.zeros(0), 0.0,
                             (float(np.log(share / (1 - share))), *[0.0] * len(EVIDENCE)))
    if len(taken) < 2:
        return no_model
    counts = stored(_unit_counts(sample))
    odds = taken[1] / taken[0]
    counts = counts.withColumn("lift", F.col("pos") / (odds * (F.col("neg") + 0.5)))
    surprise = (F.col("pos") - odds * F.col("neg")) / F.sqrt(F.col("pos") + odds * F.col("neg"))
    only = (counts.filter(F.col("lift") >= options.lift).orderBy(F.desc(surprise), "unit")
            .limit(options.positives).collect())
    plain = (counts.filter(F.col("lift") < options.lift / 2).orderBy(F.xxhash64("unit"), "unit")
             .limit(options.negatives).collect())
    positive, support = _units(only), np.array([r["pos"] for r in only], float)
    negative = _units(plain)
    if not positive or not negative:
        return no_model
    fitted = _fit_units(positive, support, negative, options)
    hard: list[str] = []
    for _ in range(options.rounds):
        scored = stored(_score_units(counts, fitted))
        worst = scored.filter(F.col("lift") < options.lift / 2).orderBy(F.desc("margin"), "unit").limit(options.hard_negatives).collect()
        hard = list(dict.fromkeys(hard + _units(worst)))
        witnesses = _witnesses(sample, scored, fitted, options)
        if witnesses:
            positive, support = list(witnesses), np.array(list(witnesses.values()), float)
        fitted = _fit_units(positive, support, negative + hard, options)
    margins = text_margins(sample, *fitted, keep=["y"]).collect()
    x = np.array([(1.0, *(r[f"_{n}"] for n in EVIDENCE)) for r in margins])
    y = np.array([r["y"] for r in margins], float)
    weight = np.where(y > 0, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
    return ToxicityModel(*fitted, tuple(_logistic(x, y, weight / weight.mean())))


def _witnesses(sample: DataFrame, scored: DataFrame, fitted: tuple, options: ToxicityOptions) -> dict[str, int]:
    """The worst units of each toxic text, with the number of texts they speak for."""
    codes, weights, bias = fitted

    def run(batches):
        scorer = UnitScorer(codes, weights, bias)
        for part in text_slices(batches):
            unit, row, words = text_units(part.column("text"))
            margin = scorer.of_words(words)
            pair = np.unique(row * np.int64(max(len(words), 1)) + unit)
            r, u = pair // max(len(words), 1), pair % max(len(words), 1)
            order = np.lexsort((-margin[u], r))
            r, u = r[order], u[order]
            start = np.searchsorted(r, r, side="left")
            top = (np.arange(len(r)) - start < options.witnesses) & (margin[u] > bias)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(u[top]))], names=["unit"])

    found = (sample.filter("y = 1").select("text").mapInArrow(run, "unit binary")
             .groupBy("unit").agg(F.count("*").alias("n"))
             .join(scored.filter(F.col("lift") >= options.lift / 2).select("unit", "margin"), "unit")
             .orderBy(F.desc("n"), F.desc("margin"), "unit").limit(options.positives).collect())
    out: dict[str, int] = {}
    for unit, n in zip(_units(found), [r["n"] for r in found]):
        out[unit] = out.get(unit, 0) + n
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = penalty * w + x.T @ (weight * (p - y))
        hessian = np.diag(penalty) + (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns with ``score`` (0 to 1) of every whole text."""
    scored = text_margins(docs, model.codes, model.weights, model.bias, keep, text)
    z = F.lit(float(model.calibration[0]))
    for name, weight in zip(EVIDENCE, model.calibration[1:]):
        z = z + float(weight) * F.col(f"_{name}")
    return scored.withColumn("score", 1 / (1 + F.exp(-z))).drop(*[f"_{n}" for n in EVIDENCE])
