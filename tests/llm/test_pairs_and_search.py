"""Similarity join, components and search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from probcast.llm import bm25_search, shingle_join
from probcast.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def components_by_hand(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = frozenset(tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(rng, n):
    vocabulary = [f"w{k}" for k in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "É a b c"), (8, "é a b c")]
    for i in range(10, n):
        kind = rng.random()
        if kind < 0.5 and len(rows) > 12:
            words = (rng.choice(rows)[1] or "x y z q r").split()
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(words) + 1)
                words[at:at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
        elif kind < 0.7:
            words = passage + [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 7, 9, 12, 14, 40, 150]))]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("words,percent,small_bucket", [(4, 85, 16), (5, 80, 2), (2, 85, 3)])
def test_components_equal_brute_force(spark, words, percent, small_bucket):
    rows = near_copies(random.Random(words), 160)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    options = shingle_join.JoinOptions(words=words, percent=percent, small_bucket=small_bucket, block=4,
                                       pairs_per_task=5, sample_one_in=2, frequent_in_sample=3)
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in
           shingle_join.jaccard_components(df, options=options).collect()}
    assert got == components_by_hand(rows, words, percent)


def test_light_sets_equal_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    base = [[f"v{rng.randrange(14)}" for _ in range(rng.randint(4, 14))] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(100 + i, " ".join(w + ["tail"])) for i, w in enumerate(base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = components_by_hand(rows, 1, 85)
    for boundary in (0, 6, 13):
        monkeypatch.setattr(shingle_join, "light_boundary", lambda sizes, options, b=boundary: b)
        found = shingle_join.jaccard_components(df, options=shingle_join.JoinOptions(words=1)).collect()
        assert {r["id"]: (r["n_shingles"], r["component"]) for r in found} == want


@pytest.mark.parametrize("hub", [0, 1500, 9000])
def test_groups_of_pairs_are_bounded_around_a_hub(spark, monkeypatch, hub):
    texts = [(i, " ".join(f"w{k}" for k in range(40)) + f" t{i % 7}") for i in [*range(1, 1400), hub]]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    ends = [(min(i, hub), max(i, hub)) for i, _ in texts if i != hub] + [(i, i + 1) for i in range(1, 1399)]
    pairs = spark.createDataFrame(ends, "a long, b long")
    placed, stored = [], shingle_join.stored

    def watch(df):
        placed.extend([stored(df)] if {"g", "a", "b"} <= set(df.columns) else [])
        return stored(df)

    monkeypatch.setattr(shingle_join, "stored", watch)
    options = shingle_join.JoinOptions(pairs_per_task=64)
    links = shingle_join.verified(pairs, docs, "doc_id", "text", options).collect()
    assert sorted(map(tuple, links)) == sorted(ends)  # all pairs link: one of 39 shingles differs
    groups = Counter(r["g"] for r in placed[0].collect())
    assert sum(groups.values()) == len(ends) and max(groups.values()) <= options.pairs_per_task
    copies = {r["g"] for r in placed[0].collect() if hub in (r["a"], r["b"])}
    assert len(copies) <= 4 * len(ends) / options.pairs_per_task


def test_join_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shingle_join.jaccard_components(empty).count() == 0
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (3, "a b c d e"), (9, "z " * 30_000)]
    got = shingle_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["id"] or -1, r["n_shingles"], r["component"] or -1) for r in got) == [
        (-1, 2, -1), (3, 2, 3), (7, 2, 3), (7, 2, 3), (9, 1, 9)]


def test_size_bounds():
    for a in range(1, 40):
        for b in range(1, 40):
            for common in range(0, min(a, b) + 1):
                links = 100 * common >= 85 * (a + b - common)
                assert links == (common >= shingle_join.needed(a, b, 85))
                if links:
                    assert b in shingle_join.partner_sizes(a, 85)
                    assert common >= a - shingle_join.prefix_length(a, 85) + 1


def test_sketch_distance_never_exceeds_set_distance():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64) * np.uint64(2654435761))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 1 << 60, rng.integers(0, 50)).astype(np.uint64)]))
        if not len(b):
            continue
        x, y = (np.frombuffer(shingle_join.parity_sketch(s), np.uint8) for s in (a, b))
        size = min(len(x), len(y))
        apart = np.bitwise_count(shingle_join.fold_sketch(x, size) ^ shingle_join.fold_sketch(y, size)).sum()
        assert apart <= len(np.setxor1d(a, b))


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges + [(None, 3), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in nodes}
    assert connected_components(df.limit(0)).count() == 0


def bm25_by_hand(rows, queries, k, k1=1.2, b=0.75):
    docs = {i: Counter(WORD.findall(lower(t or ""))) for i, t in rows}
    df = Counter(t for d in docs.values() for t in d)
    size = {i: sum(d.values()) for i, d in docs.items()}
    mean = sum(size.values()) / len(rows)
    out = {}
    for q in queries:
        scores = {}
        for i, d in docs.items():
            s = 0.0
            for t, n in docs[q].items():
                if t in d:
                    idf = math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5))
                    s += n * idf * d[t] * (k1 + 1) / (d[t] + k1 * (1 - b + b * size[i] / mean))
            if s > 0:
                scores[i] = s
        out[q] = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return out


@pytest.mark.parametrize("shard_rows,block_rows", [(8192, 64), (37, 4), (10, 3)])
def test_search_equals_brute_force(spark, shard_rows, block_rows):
    rng = random.Random(4)
    vocabulary = [f"t{int(rng.paretovariate(0.7))}" for _ in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))) for i in range(200)]
    rows += [(300 + i, rows[20][1]) for i in range(15)] + [(400, None), (420, ""), (440, "T1 " * 2000)]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "id long, text string, score double").repartition(3)
    options = bm25_search.SearchOptions(k=5, shard_rows=shard_rows, block_rows=block_rows, queries_per_block=3)
    got = {}
    for r in bm25_search.top_k(df, F.col("id") % 20 == 0, "id", options=options).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["key"], round(r["score"], 6), r["rank"]))
    want = bm25_by_hand(rows, [i for i, _ in rows if i % 20 == 0], 5)
    for q, best in want.items():
        assert [(k, s) for k, s, _ in got.get(q, [])] == [(i, round(s, 6)) for i, s in best], q
        assert [r for _, _, r in got.get(q, [])] == list(range(1, len(best) + 1))


def test_blocks_are_skipped():
    rows, rng = 6400, np.random.default_rng(1)
    parts = [(np.arange(rows), np.zeros(rows, np.int64), np.ones(rows, np.int64), rng.integers(50, 60, rows))]
    parts[0] = (np.append(parts[0][0], 5), np.append(parts[0][1], 1), np.append(parts[0][2], 9), parts[0][3])
    import io
    options = bm25_search.SearchOptions(k=1)
    shard = dict(np.load(io.BytesIO(bm25_search._pack_shard(parts, 55.0, options))))
    best, score, opened = bm25_search.search_shard(shard, np.array([0, 1]), np.array([0.1, 5.0]), 1, 64, np.arange(rows))
    assert best.tolist() == [5] and opened < 20


def test_search_edges(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert bm25_search.top_k(empty, F.lit(True), "id").count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "id long, text string")
    assert bm25_search.top_k(only, F.lit(True), "id").count() == 0


def test_registered_search_takes_whole_documents(spark):
    pytest.importorskip("public_tokenizers")
    from probcast.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {}
    for r in QUERIES["op5_block_max_search"](spark, folder).orderBy("query_doc_id", "rank").collect():
        got.setdefault(r["query_doc_id"], []).append((r["doc_id"], round(r["score"], 6)))
    want = bm25_by_hand(rows, [i for i, _ in rows if i % 20 == 0], 10)
    assert got == {q: [(i, round(s, 6)) for i, s in best] for q, best in want.items() if best}
