"""Blocks of a bucket: which pairs they pass on, and how often."""

import numpy as np
import pandas as pd
import pyarrow as pa

from probcast.llm import shingle_join as J

PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _cell(sets, buckets, bucket=7, outside=None):
    """One cell whose outsiders and members are all the sets, each a component of its own."""
    outside = [True] * len(sets) if outside is None else outside
    rows = [(bucket, 0, 0, side, i, len(s), i, outside[i], J.parity_sketch(s), np.array(buckets[i]))
            for side in (0, 1) for i, s in enumerate(sets) if side or outside[i]]
    frame = pd.DataFrame(rows, columns=["bucket", "i", "j", "side", "id", "n", "label", "outside", "sketch", "buckets"])
    return J._compare_cells(frame, frame[["bucket", "i", "j"]].to_numpy(), 85, PAIRS).to_pylist()


def _random_sets(sizes):
    rng = np.random.default_rng(3)
    return [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in sizes]


def test_a_small_set_in_a_block_does_not_let_far_pairs_pass():
    sets = _random_sets([20] + [3000] * 12)
    sets.append(np.unique(np.r_[sets[1][:-9], _random_sets([9])[0]]))  # near sets[1]
    assert _cell(sets, [[7]] * len(sets)) == [{"a": 1, "b": 13}]


def test_a_pair_is_made_in_its_least_shared_bucket_once():
    own = _random_sets([300])[0]
    sets = [own[:-1], own, own[1:]]
    pairs = [{"a": 0, "b": 1}, {"a": 0, "b": 2}, {"a": 1, "b": 2}]
    assert _cell(sets, [[7, 9]] * 3) == pairs
    assert _cell(sets, [[7, 9]] * 3, bucket=9) == []
    assert _cell(sets, [[3, 9], [3, 9], [9, 11]], bucket=9) == pairs[1:]
    got = _cell(sets, [[7]] * 3, outside=[False, False, True])
    assert sorted(got, key=str) == pairs[1:]


def test_blocks_find_all_links_between_components(spark, monkeypatch):
    """A bucket beyond ``small_bucket``: every pair of unlabelled near copies, none of it twice."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 10_000, 300)]
    rows = []
    for i in range(40):
        words = list(base)
        for place in rng.integers(0, 300, rng.integers(0, 8)):
            words[place] = f"x{i}_{place}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = []
    compare = J._cross_pairs
    monkeypatch.setattr(J, "_cross_pairs", lambda *a: made.append(compare(*a)) or made[-1])
    got = {r["id"]: r["component"] for r in J.jaccard_components(docs, options=J.JoinOptions(small_bucket=2)).collect()}
    flat, bounds = J.shingle_sets(pa.array([t for _, t in rows]), 4)
    sets = [set(flat[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    root = list(range(40))
    for _ in range(40):
        for i in range(40):
            for k in range(40):
                if 100 * len(sets[i] & sets[k]) >= 85 * len(sets[i] | sets[k]):
                    root[i] = root[k] = min(root[i], root[k])
    assert got == dict(enumerate(root))
    assert made[0].count() == made[0].distinct().count()
