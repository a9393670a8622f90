"""Tree search against scores of every document, and odd tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from probcast.llm import tree_search
from probcast.llm.tree_search import SearchOptions

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = SearchOptions(leaf=3, tree_documents=40, tree_terms=300, sample=30)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def search_by_hand(docs, items, best=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    used = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, total = len(used), sum(n for _, _, n in used)
    df = Counter(t for _, b, _ in used for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag, n in used:
            m = 75 + 25 * n * n_docs // total
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * bag[t] // (1000 * bag[t] + 12 * m))
                    for t, k in Counter(terms(text)).items() if t in bag)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, r[3], -r[0]) for rank, r in enumerate(sorted(scored, key=lambda r: r[:3])[:best], 1)]
    return out


def run(spark, docs, items, options=SMALL):
    d = spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], "doc_id long, text string, key int, score string")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    return [tuple(r) for r in tree_search.search(d, q, options).collect()]


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_scores_of_every_document(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["ÄRGER", "ärger", "naïve", "ſ", "K", "x_y", "A-b", "９"]
    weights = [1 / (1 + i) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 5, 30, 200])))) for i in range(260)]
    docs += [(1000 + i, docs[3][1] + " w40 w41 w59") for i in range(70)]  # a family of copies
    docs += [(5, "w50 w51"), (5, "w50 w51"), (None, "w50 w51"), (None, None), (-4, "w50 w51"), (2000, " .. \x00\x7f"),
             (2001, "w1 " * 20_000 + "w58")]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 25])))) for i in range(25)]
    items += [(90, "W50! w51,w51"), (90, "W50! w51,w51"), (91, None), (92, ""), (93, "unseen"), (None, "w59 w59 W1")]
    assert Counter(run(spark, docs, items)) == Counter(search_by_hand(docs, items))


def test_blocks_of_items_give_the_same_rows(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choices("abcdefghij", k=12))) for i in range(120)]
    items = [(i, " ".join(rng.choices("abcdefghijk", k=4))) for i in range(30)]
    some = SearchOptions(best=5, leaf=4, item_bytes=80)
    assert Counter(run(spark, docs, items, some)) == Counter(search_by_hand(docs, items, 5))


@pytest.mark.parametrize("docs,items", [
    ([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None), (2, "..")], [(1, "a")]), ([(1, "a")], [(1, None)])])
def test_empty_tables(spark, docs, items):
    assert run(spark, docs, items) == search_by_hand(docs, items)


def tree_of(rng, n, leaf):
    paths = sorted(tuple(sorted(rng.sample(range(12), rng.randint(1, 6)))) for _ in range(n))
    bounds = np.cumsum([0, *map(len, paths)])
    counts = np.array([rng.randint(1, 9) for _ in range(bounds[-1])])
    m = np.array([rng.randint(75, 400) for _ in paths])
    return tree_search.Tree(pa.array(range(n), pa.int64()), m, np.array([t for p in paths for t in p]), bounds, counts, leaf)


@pytest.mark.parametrize("seed", range(5))
def test_node_bounds_cover_all_documents_below(seed):
    rng = random.Random(seed)
    options = SearchOptions()
    tree = tree_of(rng, 200, leaf=rng.choice([1, 4, 16]))
    leaves = [i for i, c in enumerate(tree.children) if not c]
    covered = sorted((tree.first[i], tree.last[i]) for i in leaves)
    assert covered[0][0] == 0 and covered[-1][1] == 200 and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
    own = np.array(sorted(rng.sample(range(14), 5)))
    weights = np.array([rng.randint(0, 5000) for _ in own])
    by_rank = np.zeros(14, np.int64)
    by_rank[own] = weights
    bound = tree.node_bounds(own, weights, options)
    for node, children in enumerate(tree.children):
        assert all(tree.first[node] <= tree.first[c] < tree.last[c] <= tree.last[node] for c in children)
        assert bound[node] >= tree.scores(node, by_rank, options).max()
        assert all(bound[c] <= bound[node] for c in children)


def test_search_cuts_off_what_cannot_reach_a_place():
    rng = random.Random(11)
    tree = tree_of(rng, 600, leaf=4)
    own, weights = np.array([10, 11]), np.array([9000, 9000])
    by_rank = np.zeros(12, np.int64)
    by_rank[own] = weights
    places = tree_search.Places(3)
    opened = tree_search.search_tree(tree, own, weights, by_rank, places, SearchOptions())
    assert len(places.score) == 3 and opened < sum(not c for c in tree.children) / 2


def test_terms(spark):
    texts = ["Ab9_c", None, "", "É-é \x7fZ\U0001F600z", "a\x00b"]
    words, rows = tree_search.terms_of(pa.array(texts, pa.string()))
    flat = [x.decode() for x in words.to_pylist()]
    assert [flat[a:b] for a, b in zip(rows[:-1], rows[1:])] == [terms(t) for t in texts]
