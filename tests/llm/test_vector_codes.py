"""Vector codes against plain loops over exact integers, and odd tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from probcast.llm import vector_codes
from probcast.llm.vector_codes import CodeOptions

SCHEMA = "vec_id long, embedding array<float>, label string, code int, row string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, 5, "clash") for i, v, c in rows], SCHEMA)


def codes_by_hand(rows, options):
    """Every distance in every round, in Python integers."""
    kept = [(i, [math.floor(options.scale * float(np.float32(x))) for x in v], c) for i, v, c in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    d = len(kept[0][1]) // options.parts
    books, codes = [], [[] for _ in kept]
    for p in range(options.parts):
        points = [v[p * d:(p + 1) * d] for _, v, _ in kept]
        book = [list(x) for x in points[:options.entries]]

        def assign():
            return [min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book)) for x in points]

        for _ in range(options.rounds):
            groups = defaultdict(list)
            for x, (_, k) in zip(points, assign()):
                groups[k].append(x)
            for k, own in groups.items():
                book[k] = [sum(col) // len(own) for col in zip(*own)]
        for code, best in zip(codes, assign()):
            code.append(best)
        books.append(book)
    errors = [sum(x for x, _ in c) for c in codes]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    return [(i, "".join(f"{k:02x}" for _, k in c), e, by_label[label])
            for (i, _, label), c, e in zip(kept, codes, errors)], books


def check(spark, rows, options):
    got = vector_codes.encode_vectors(frame(spark, rows), options)
    want, books = codes_by_hand(rows, options)
    found = [(r["key"], r["code"], r["error"], r["label_error"]) for r in got.with_label_error().collect()]
    assert Counter(found) == Counter(want)
    text = ",".join(str(x) for b in books for e in b for x in e)
    assert got.digest() == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("seed,size,options", [
    (1, 8, CodeOptions(entries=16, block=8)), (2, 12, CodeOptions(entries=5, rounds=2, block=64)),
    (3, 4, CodeOptions(entries=7, block=1)), (4, 16, CodeOptions(entries=256))])
def test_codes_equal_plain_loops(spark, seed, size, options):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.5) for _ in range(size)] for _ in range(6)]
    rows = [(i, [rng.gauss(m, 0.05) for m in rng.choice(centres)], rng.choice(["a", "b", None])) for i in range(150)]
    rows += [(200 + i, list(rows[0][1]), "a") for i in range(40)]  # copies
    rows += [(300, None, "a"), (301, [None] + [0.0] * (size - 1), "a"), (302, [math.nan] * size, "b"),
             (303, [math.inf] + [0.0] * (size - 1), None), (None, [0.25] * size, "b"), (None, [0.5] * size, None)]
    rows += [(7, [round(rng.gauss(0, 1)) * 0.5 for _ in range(size)], "b") for _ in range(3)]  # ties, equal ids
    rng.shuffle(rows)
    check(spark, rows, options)


def test_large_components_use_whole_numbers(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-60000, 60000) for _ in range(8)], "a") for i in range(60)]
    check(spark, rows, CodeOptions(entries=9, block=16))
    with pytest.raises(Exception, match="65,536"):
        vector_codes.encode_vectors(frame(spark, [(1, [1e9] * 4, "a")]))


@pytest.mark.parametrize("rows", [[], [(1, None, "a")], [(1, [0.1, -0.2, 0.3, 0.4], None)] * 3])
def test_small_tables(spark, rows):
    check(spark, rows, CodeOptions())


def test_other_lengths_are_dropped_and_parts_must_fit(spark):
    rows = [(1, [0.5] * 8, "a"), (2, [0.5] * 4, "a"), (3, [], "a")]
    got = vector_codes.encode_vectors(frame(spark, rows)).rows.collect()
    assert [r["key"] for r in got] == [1]
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.encode_vectors(frame(spark, [(1, [0.5] * 6, "a")]))


@pytest.mark.parametrize("dimensions,bits", [(2, 4), (3, 3), (5, 2), (4, 1)])
def test_hilbert_keys_walk_through_neighbours(dimensions, bits):
    """The curve meets every cell once, and each step changes one coordinate by one."""
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    keys = vector_codes.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shortlists_hold_the_nearest_entries():
    rng = np.random.default_rng(6)
    for _ in range(50):
        entries = rng.integers(-20, 20, (30, 3))
        points = rng.integers(-20, 20, 3) + rng.integers(0, 6, (25, 3))
        keep = vector_codes.shortlists(points.min(0)[None], points.max(0)[None], entries)[0]
        distance = ((points[:, None] - entries[None]) ** 2).sum(2)
        tied = distance == distance.min(1, keepdims=True)
        assert keep[tied.any(0)].all()
        for exact in (True, False):
            best, least = vector_codes.nearest(points, entries, exact)
            assert (best == distance.argmin(1)).all() and (least == distance.min(1)).all()
