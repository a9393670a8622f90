"""The source mix: targets by resharing in rounds, whole schedules, and odd tables."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from probcast.llm import source_mix
from probcast.llm.source_mix import MixOptions

SCHEMA = "doc_id long, text string, source string, size string, start int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 7) for i, t, s in rows], SCHEMA)


def targets_by_rounds(sizes, weights, total, repeats):
    """Give by weight, stop what is above its limit, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, out = set(), {}
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(repeats * sizes[s] for s in full)
        unit = rest / sum(weight[s] for s in free) if free else 0
        out = {s: repeats * sizes[s] if s in full else unit * weight[s] for s in order}
        above = {s for s in free if out[s] > repeats * sizes[s]}
        if not above:
            return out
        full |= above


def words(n):
    return " ".join("w" * (1 + i % 5) for i in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_taken_words(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "B", "é", "z\U0001F600", "z￿", "tiny"]
    rows = [(i, words(rng.choice([0, 1, 3, 40, 700])), rng.choice(names[:-1] if i % 3 else ["a"])) for i in range(300)]
    rows += [(1000, "one", "tiny"), (1001, None, "nothing"), (1002, words(9000), "B")]
    options = MixOptions(block=64, seed=seed)
    mix = source_mix.mix_sources(frame(spark, rows), options)
    got = mix.taken().collect()
    assert Counter(r["key"] for r in got) == Counter(i for i, _, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = targets_by_rounds(sizes, options.weights, sum(sizes.values()), options.repeats)
    source = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        assert r["size"] == len((next(t for i, t, _ in rows if i == r["key"]) or "").split())
        assert r["source_size"] == sizes[source[r["key"]]]
        assert r["target"] == pytest.approx(want[source[r["key"]]], rel=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["key"]]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5
    again = source_mix.mix_sources(frame(spark, rows[::-1]), options).taken()
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_schedule_interleaves_and_pieces_fill_blocks(spark):
    rows = [(i, words(50), "a" if i % 2 else "b") for i in range(400)]
    mix = source_mix.mix_sources(frame(spark, rows), MixOptions(weights=(3, 1), block=100))
    slots = sorted(mix.schedule.collect(), key=lambda r: r["slot"])
    need = {r["source_id"]: r["slots"] for r in mix.sources.collect()}
    assert Counter(r["source_id"] for r in slots) == Counter(need)
    n = len(slots)
    for end in range(20, n, 20):  # every beginning of the schedule is near the weights
        got = Counter(r["source_id"] for r in slots[:end])
        assert all(abs(got[s] - end * need[s] / n) <= 4 for s in need)
    by_source = defaultdict(list)
    for r in slots:
        by_source[r["source_id"]].append((r["pass"], r["block"]))
    assert all(x == sorted(x) and len(set(x)) == len(x) for x in by_source.values())
    held = Counter()
    for r in mix.pieces().collect():
        assert 0 <= r["first"] < r["last"] <= 50
        held[r["slot"]] += r["last"] - r["first"]
    assert set(held) == {r["slot"] for r in slots} and max(held.values()) == 100


def test_golden_points_meet_every_share(spark):
    for n in (1, 2, 7, 1000, 65_537):
        hits = spark.range(2 * n).select(source_mix.golden_points(F.col("id"), n).alias("p")).distinct().count()
        assert hits == n
    far = spark.range(1 << 40, (1 << 40) + 3).select(source_mix.golden_points(F.col("id"), 1 << 20).alias("p"))
    want = [(i * source_mix.GOLDEN % source_mix.MODULUS) * (1 << 20) // source_mix.MODULUS for i in range(1 << 40, (1 << 40) + 3)]
    assert [r["p"] for r in far.collect()] == want


@pytest.mark.parametrize("rows", [
    [], [(1, None, None)], [(None, "", "a"), (None, None, "a"), (None, " ", "a"), (None, " ", "a")],
    [(5, "x y", "a")] * 7 + [(None, "x", None)] * 5, [(1, "x", "a"), (1, "x", "b"), (1, "y z", "a")]])
def test_odd_tables_keep_every_row(spark, rows):
    got = source_mix.mix_sources(frame(spark, rows), MixOptions(block=3)).taken().collect()
    assert Counter((r["key"], r["size"]) for r in got) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    total = sum(len((t or "").split()) for _, t, _ in rows)
    assert sum(r["taken"] for r in got) == total and all(r["taken"] <= 3 * r["size"] for r in got)
