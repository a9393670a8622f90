"""Ranked lexical search of whole documents with a frequency-ordered term tree.

Documents are restricted to the terms of the items and written as paths, most frequent term first, so
that documents with common beginnings share a path from the root of a tree. Sorted paths are dealt by
range and every task builds trees over consecutive documents. Each node keeps the greatest count of
every term below it and the least length factor ``m``: a term's gain grows with its count and falls
with ``m``, so both bound the score of all documents below. For an item, the tree is searched depth
first, children of greater bound first; what is bounded below the item's last place so far is cut off,
and the documents of a leaf are scored exactly. A task carries each item's best documents from tree to
tree and returns them; places of equal score go to smaller keys, so nodes that only reach the last
place are still opened. A sample of documents is searched first; its last place is a floor for all
tasks. Results do not depend on the sample, on tree size or on the tasks.

Items are taken in blocks of about ``item_bytes`` of text; vocabulary, weights and items of a block are
what travels to the tasks and to the driver.

Defined cases: null texts and texts without terms are not in N and match nothing; items without terms
have no rows; repeated documents are results each, in any order; repeated items are ranked each, with
their own rows; null keys come last among equal scores; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from probcast.llm.common import gather_ranges, split_runs, stored, text_bytes, text_slices
from probcast.operators.skew import keep_first_n

SAMPLE_TASKS = 4  # for the documents searched first, whose number is bounded

SEPARATORS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


@dataclass(frozen=True)
class SearchOptions:
    best: int = 20
    item_bytes: int = 8 << 20  # text of one block of items
    leaf: int = 32  # documents of a leaf
    tree_documents: int = 8192
    tree_terms: int = 1 << 20
    sample: int = 20_000  # documents searched first
    gain: int = 1_000_000_000
    count_factor: int = 1000
    length_factor: int = 12
    length_percent: int = 25


@dataclass
class Corpus:
    """What the search needs of a block's vocabulary: path rank and weight of each term; N and L."""

    rank: np.ndarray
    weight: np.ndarray  # by rank
    documents: int
    terms: int


def terms_of(array: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-cased terms of all rows, and row bounds counted in terms."""
    data, bounds = text_bytes(array)
    runs, rows = split_runs(data, bounds, SEPARATORS, lower=True)
    return runs.dictionary_encode(), rows


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value per row from four-byte numbers and row bounds."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [
        None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(array: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(array.buffers()[1], np.int32)[array.offset:array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    if data is None or raw[-1] == raw[0]:
        return np.zeros(0, kind), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[raw[0]:raw[-1]].view(kind), (raw - raw[0]) // 4


def restrict(docs: DataFrame, vocabulary: pa.Array, key: str, text: str) -> DataFrame:
    """Stored rows (key, n, terms, counts): a document's length and its terms of the vocabulary."""
    size = max(1, len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words, rows = terms_of(batch.column("text"))
            known = np.asarray(pc.index_in(words.dictionary, value_set=vocabulary).fill_null(-1))
            ids = known[np.asarray(words.indices)] if len(words) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(batch)), np.diff(rows))
            pair, count = np.unique(row[ids >= 0] * size + ids[ids >= 0], return_counts=True)
            bounds = np.searchsorted(pair, np.arange(len(batch) + 1) * size)
            yield pa.record_batch([
                batch.column("key"), pa.array(np.diff(rows).astype(np.int64)),
                _binary((pair % size).astype(np.int32), bounds), _binary(count.astype(np.int32), bounds),
            ], ["key", "n", "terms", "counts"])

    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return stored(source.mapInArrow(run, "key long, n long, terms binary, counts binary"))


def _corpus(vectors: DataFrame, size: int) -> Corpus:
    """Counts over all documents: N, L, and of each term the documents that hold it."""

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for batch in batches:
            found += np.bincount(_numbers(batch.column("terms"), np.int32)[0], minlength=size)
        term = np.flatnonzero(found)
        yield pa.record_batch([pa.array(term.astype(np.int32)), pa.array(found[term])], ["term", "df"])

    documents, terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(size, np.int64)
    if size:
        for r in vectors.select("terms").mapInArrow(holders, "term int, df long").groupBy("term").agg(
                F.sum("df").alias("df")).collect():
            df[r["term"]] = r["df"]
    order = np.argsort(-df, kind="stable")
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df[order]], np.int64)
    return Corpus(rank, weight, documents, terms)


def sorted_paths(vectors: DataFrame, corpus: Corpus, options: SearchOptions) -> DataFrame:
    """Rows (key, m, path, counts) in order of path; a path has the ranks of its terms, highest byte first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, bounds = _numbers(batch.column("terms"), np.int32)
            counts, _ = _numbers(batch.column("counts"), np.int32)
            rank = corpus.rank[terms]
            order = np.lexsort((rank, np.repeat(np.arange(len(batch)), np.diff(bounds))))
            n = np.asarray(batch.column("n"))
            if options.length_percent * int(n.max(initial=0)) * corpus.documents >= 1 << 63:
                n = n.astype(object)
            m = 100 - options.length_percent + options.length_percent * n * corpus.documents // max(1, corpus.terms)
            yield pa.record_batch([batch.column("key"), pa.array(m.astype(np.int64)), _binary(rank[order].astype(">u4"), bounds),
                                   _binary(counts[order], bounds)], ["key", "m", "path", "counts"])

    paths = vectors.filter(F.length("terms") > 0).mapInArrow(run, "key long, m long, path binary, counts binary")
    begin = F.substring("path", 1, 64)
    return paths.repartitionByRange(begin, "key").sortWithinPartitions("path", "key")


class Tree:
    """Trie over documents in order of path, as flat arrays. Nodes are numbered before their children."""

    def __init__(self, keys: pa.Array, m: np.ndarray, terms: np.ndarray, bounds: np.ndarray, counts: np.ndarray, leaf: int):
        self.keys, self.m, self.terms, self.bounds, self.counts = keys, m, terms, bounds, counts
        self.document = np.repeat(np.arange(len(m)), np.diff(bounds))
        self.first: list[int] = []
        self.last: list[int] = []
        self.children: list[list[int]] = []
        self._grow(self._shared(), leaf)
        self.least_m = np.array([m[a:b].min() for a, b in zip(self.first, self.last)])
        self._maxima()

    def _shared(self) -> np.ndarray:
        """Number of terms that neighbouring paths share from the root."""
        out = np.zeros(max(0, len(self.m) - 1), np.int64)
        edge = self.bounds.tolist()
        for i in range(len(out)):
            a, b, c = edge[i:i + 3]
            k = min(b - a, c - b)
            differ = self.terms[a:a + k] != self.terms[b:b + k]
            out[i] = differ.argmax() if differ.any() else k
        return out

    def _grow(self, shared: np.ndarray, leaf: int) -> None:
        """Split ranges where paths part; small neighbours below one node stay together as one leaf."""
        todo = [(0, len(self.m), -1)]
        while todo:
            a, b, parent = todo.pop()
            node = len(self.first)
            self.first.append(a)
            self.last.append(b)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if b - a <= leaf:
                continue
            inside = shared[a:b - 1]
            depth = inside.min()
            if depth == self.bounds[a + 1] - self.bounds[a] == self.bounds[b] - self.bounds[b - 1]:
                continue  # equal paths
            edges = [a, *(a + 1 + np.flatnonzero(inside == depth)).tolist(), b]
            start, parts = a, []
            for left, right in zip(edges[1:], edges[2:] + [b]):
                if left < b and right - start > leaf:
                    parts.append((start, left, node))
                    start = left
            todo += [*parts, (start, b, node)]

    def _maxima(self) -> None:
        """Greatest count of each term below each node, gathered from the leaves up, in order of term."""
        found: list = [None] * len(self.first)
        for node in range(len(self.first) - 1, -1, -1):
            if self.children[node]:
                term = np.concatenate([found[c][0] for c in self.children[node]])
                most = np.concatenate([found[c][1] for c in self.children[node]])
            else:
                a, b = self.bounds[self.first[node]], self.bounds[self.last[node]]
                term, most = self.terms[a:b], self.counts[a:b]
            order = np.argsort(term, kind="stable")
            term, at = np.unique(term[order], return_index=True)
            found[node] = term, np.maximum.reduceat(most[order], at)
        term = np.concatenate([f[0] for f in found])
        order = np.argsort(term, kind="stable")
        self.nodes = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])[order]
        self.most = np.concatenate([f[1] for f in found])[order].astype(np.int64)
        self.held, self.starts = np.unique(term[order], return_index=True)
        self.sizes = np.diff(np.append(self.starts, len(order)))

    def node_bounds(self, terms: np.ndarray, weights: np.ndarray, options: SearchOptions) -> np.ndarray:
        """No document below a node scores more than this."""
        at = np.minimum(np.searchsorted(self.held, terms), len(self.held) - 1)
        there = self.held[at] == terms
        places = gather_ranges(self.starts[at[there]], self.sizes[at[there]])
        nodes = self.nodes[places]
        gains = np.repeat(weights[there], self.sizes[at[there]]) * gain(self.most[places], self.least_m[nodes], options)
        out = np.zeros(len(self.first), np.int64)
        np.add.at(out, nodes, gains)
        return out

    def scores(self, node: int, weights: np.ndarray, options: SearchOptions) -> np.ndarray:
        """Exact scores of the documents of a leaf. ``weights``: by rank, 0 for other terms."""
        a, b = self.bounds[self.first[node]], self.bounds[self.last[node]]
        w = weights[self.terms[a:b]]
        hit = np.flatnonzero(w) + a
        document = self.document[hit]
        out = np.zeros(self.last[node] - self.first[node], np.int64)
        np.add.at(out, document - self.first[node],
                  w[hit - a] * gain(self.counts[hit].astype(np.int64), self.m[document], options))
        return out


def gain(count: np.ndarray, m: np.ndarray, options: SearchOptions) -> np.ndarray:
    return options.gain * count // (options.count_factor * count + options.length_factor * m)


class Places:
    """The best documents of one item so far: score, null key, key. A document must reach ``floor``,
    and at equal score come no later than the document ``last`` that has it."""

    def __init__(self, size: int, floor: tuple[int, bool, int] = (1, True, 0)):
        self.size = size
        self.floor, self.last = floor[0], floor[1:]
        self.score, self.null, self.key = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, null: np.ndarray, key: np.ndarray) -> None:
        level = score == self.floor
        before = (null < self.last[0]) | (null == self.last[0]) & (key <= self.last[1])
        good = (score > self.floor) | level & before
        if not good.any():
            return
        score, null, key = (np.concatenate([x, y[good]]) for x, y in ((self.score, score), (self.null, null), (self.key, key)))
        order = np.lexsort((key, null, -score))[:self.size]
        self.score, self.null, self.key = score[order], null[order], key[order]
        if len(order) == self.size:
            self.floor, self.last = int(self.score[-1]), (bool(self.null[-1]), int(self.key[-1]))


def search_tree(tree: Tree, terms: np.ndarray, weights: np.ndarray, by_rank: np.ndarray, places: Places, options: SearchOptions) -> int:
    """Depth-first branch and bound; returns the number of leaves opened."""
    bound = tree.node_bounds(terms, weights, options)
    todo, opened = [0], 0
    while todo:
        node = todo.pop()
        if bound[node] < places.floor:
            continue
        if tree.children[node]:
            todo += sorted(tree.children[node], key=bound.__getitem__)
            continue
        opened += 1
        own = tree.keys.slice(tree.first[node], tree.last[node] - tree.first[node])
        places.add(tree.scores(node, by_rank, options), np.asarray(own.is_null()), np.asarray(own.fill_null(0)))
    return opened


def search_paths(paths: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], floors: dict[int, tuple],
                 corpus: Corpus, options: SearchOptions) -> DataFrame:
    """The best documents of every task for every item: (item, key, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [Places(options.best, floors.get(q, (1, True, 0))) for q, _, _ in queries]
        by_rank = np.zeros(len(corpus.weight), np.int64)
        held: list[pa.RecordBatch] = []
        size = [0, 0]

        def search() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            key, m, path, counts = (table.column(c).chunk(0) for c in ("key", "m", "path", "counts"))
            terms, bounds = _numbers(path, ">u4")
            tree = Tree(key, np.asarray(m), terms.astype(np.int64), bounds, _numbers(counts, np.int32)[0], options.leaf)
            for (_, own, weights), best in zip(queries, places):
                by_rank[own] = weights
                search_tree(tree, own, weights, by_rank, best, options)
                by_rank[own] = 0
            held.clear()
            size[:] = 0, 0

        for batch in batches:
            ends = np.cumsum(np.asarray(pc.binary_length(batch.column("path")), np.int64)) // 4
            at = 0
            while at < len(batch):
                before = ends[at - 1] if at else 0
                stop = int(np.searchsorted(ends, before + options.tree_terms - size[1], side="right"))
                stop = min(stop, at + options.tree_documents - size[0], len(batch))
                stop = max(stop, at + (not held))
                if stop > at:
                    held.append(batch.slice(at, stop - at))
                    size[0] += stop - at
                    size[1] += int(ends[stop - 1] - before)
                    at = stop
                if at < len(batch):
                    search()
        if held:
            search()
        for (item, _, _), best in zip(queries, places):
            if len(best.score):
                yield pa.record_batch([pa.array(np.full(len(best.score), item)), pa.array(best.key, mask=best.null),
                                       pa.array(best.score)], ["item", "key", "score"])

    return paths.mapInArrow(run, "item long, key long, score long")


def _search_block(docs: DataFrame, items: list, key: str, text: str, options: SearchOptions) -> DataFrame:
    """All documents for one block of items."""
    words, rows = terms_of(pa.array([r["text"] for r in items], pa.string()))
    vocabulary = words.dictionary
    vectors = restrict(docs, vocabulary, key, text)
    corpus = _corpus(vectors, len(vocabulary))
    ranks = corpus.rank[np.asarray(words.indices)] if len(words) else np.zeros(0, np.int64)
    queries = []
    for r, a, b in zip(items, rows[:-1], rows[1:]):
        own, repeats = np.unique(ranks[a:b], return_counts=True)
        if len(own):
            queries.append((r["item"], own, corpus.weight[own] * repeats))
    floors: dict[int, tuple] = {}
    if corpus.documents > 2 * options.sample:
        some = vectors.filter(F.pmod(F.xxhash64("key", "n"), F.lit(corpus.documents)) < options.sample)
        few = sorted_paths(some, corpus, options).coalesce(SAMPLE_TASKS)
        last = _ranked(search_paths(few, queries, {}, corpus, options), options)
        floors = {r["item"]: (r["score"], r["key"] is None, r["key"] or 0) for r in last.filter(F.col("rank") == options.best).collect()}
    return stored(search_paths(sorted_paths(vectors, corpus, options), queries, floors, corpus, options))


def _ranked(found: DataFrame, options: SearchOptions) -> DataFrame:
    order = [F.col("score").desc(), F.col("key").asc_nulls_last()]
    return keep_first_n(found, ["item"], order, F.lit(options.best), salt_on=["key"], rank_name="rank")


def search(docs: DataFrame, items: DataFrame, options: SearchOptions = SearchOptions(), key: str = "doc_id",
           item_key: str = "item_id", text: str = "text") -> DataFrame:
    """The ``best`` documents of every item: (item key, rank, key, score)."""
    named = stored(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_key).alias("item_key"),
                                F.coalesce(text, F.lit("")).alias("text")))
    total = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // options.item_bytes))
    found = None
    for b in range(blocks):
        own = named.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "text").collect()
        part = _search_block(docs, own, key, text, options)
        found = part if found is None else found.unionByName(part)
    best = _ranked(found, options)
    return best.join(named.select("item", "item_key"), "item").select(
        F.col("item_key").alias(item_key), "rank", F.col("key").alias(key), "score")


def search_sql(options: SearchOptions = SearchOptions()) -> str:
    """DuckDB SQL of the query: every score of every pair that shares a term."""
    upper = "".join(map(chr, range(65, 91)))
    split = f"unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
    o = options
    return f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, {split} AS term FROM doc) GROUP BY r, term),
size AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, total GROUP BY term, docs),
item AS (
  SELECT i, item_id, term, count(*) AS k FROM (
    SELECT i, item_id, {split} AS term FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)) GROUP BY i, item_id, term),
score AS (
  SELECT i, item_id, r, CAST(sum(k * w * (({o.gain} * tf) // ({o.count_factor} * tf
           + {o.length_factor} * ({100 - o.length_percent} + ({o.length_percent} * n * docs) // terms)))) AS BIGINT) AS score
  FROM item JOIN weight USING (term) JOIN tf USING (term) JOIN size USING (r), total GROUP BY i, item_id, r),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM score JOIN doc USING (r) WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {o.best}
"""
