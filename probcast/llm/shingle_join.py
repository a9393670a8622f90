"""Exact Jaccard self-join of texts on word shingles: a size-aware heavy-light join.

A text's set holds the 64-bit hashes of its distinct shingles. Texts with equal sets form one class.
Classes link when their similarity reaches the threshold, and links give components.

Small (light) classes enumerate their subsets of every size that a link with some partner size
needs in common: two linked small sets share such a subset. Large (heavy) classes scan inverted lists:
shingles have one global order, frequent ones (estimated on a sample; the order changes cost, never
results) last, and two linked sets share a shingle among the first ``n - need + 1`` of each. The
boundary is the size that minimises the cost summed over the histogram of set sizes.

A bucket (subset or list) never expands into all pairs. First each member is compared with its
neighbour in size order and with the bucket's first member; links found are contracted into
components. Then only pairs between different components of a bucket are compared, in blocks of
bounded size: parity sketches (their distance is at most that of the sets, so no link is lost)
remove most pairs and exact set intersections decide the rest.

Defined cases: null and empty texts and texts without words have an empty set and link with
nothing; a text with fewer words than a shingle is one shingle; rows with equal id are one document
in components, and a row with null id has no component; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from probcast.llm.common import bounded_batches, give_back_memory, mix, split_words, stored, text_slices
from probcast.llm.components import connected_components
from probcast.operators.skew import salted_join


@dataclass(frozen=True)
class JoinOptions:
    words: int = 4
    percent: int = 85  # links when 100 * intersection >= percent * union
    sample_one_in: int = 16
    frequent_in_sample: int = 4
    frequent_limit: int = 100_000  # of the order's hot shingles; the rest keeps hash order
    block: int = 1024  # members of a large bucket that one task compares with as many others
    small_bucket: int = 16
    pairs_per_task: int = 512
    largest_light: int = 13
    bitmap_log2: int = 23  # bits of the filter on wanted ids; a full filter costs time, not results


def needed(a: int, b: int, percent: int) -> int:
    """Smallest intersection of linked sets with ``a`` and ``b`` elements."""
    return -(-percent * (a + b) // (100 + percent))


def partner_sizes(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def subset_sizes(n: int, percent: int) -> list[int]:
    return sorted({c for m in partner_sizes(n, percent) if (c := needed(n, m, percent)) <= min(n, m)})


def subset_count(n: int, percent: int) -> int:
    return sum(math.comb(n, c) for c in subset_sizes(n, percent))


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, and the row bounds."""
    codes, bounds, distinct = split_words(texts, lower=True)
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))[codes]
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(word) - words + 1, 0), np.uint64)
        for i in range(words):
            rolled = rolled * step + word[i:i + len(rolled)]
        rolled = mix(rolled)
        parts, sizes = [], np.zeros(len(bounds) - 1, np.int64)
        for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if b - a >= words:
                found = np.unique(rolled[a:b - words + 1])
            elif b > a:
                h = np.uint64(b - a)
                for x in word[a:b]:
                    h = h * step + x
                found = mix(np.array([h ^ np.uint64(0x5851F42D4C957F2D)], np.uint64))
            else:
                continue
            parts.append(found)
            sizes[row] = len(found)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def _sketch_bits(n: int) -> int:
    return 1 << max(6, (2 * n - 1).bit_length())


def parity_sketch(values: np.ndarray) -> bytes:
    """Parity of the elements in each of 2^k cells: the XOR of two sketches never has more bits than
    the sets differ in elements."""
    bits = _sketch_bits(len(values))
    cell = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(cell.astype(np.uint8), bitorder="little").tobytes()


def fold_sketch(sketch: np.ndarray, size: int) -> np.ndarray:
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def _sketches_allow(a: bytes, b: bytes, na: int, nb: int, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    apart = int(np.bitwise_count(fold_sketch(x, size) ^ fold_sketch(y, size)).sum())
    return apart <= na + nb - 2 * needed(na, nb, percent)


def frequent_shingles(docs: DataFrame, key: str, text: str, options: JoinOptions) -> np.ndarray:
    """Shingles found often in a sample of texts, at most ``frequent_limit``."""
    words = options.words

    def run(batches):
        for part in text_slices(batches, "_text", 2 << 20):
            flat, _ = shingle_sets(part.column("_text"), words)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], names=["h"])

    sample = docs.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(options.sample_one_in)) == 0)
    counted = (sample.select(F.col(text).alias("_text")).mapInArrow(run, "h long").groupBy("h")
               .agg(F.count("*").alias("n")).filter(F.col("n") >= options.frequent_in_sample)
               .orderBy(F.desc("n"), "h").limit(options.frequent_limit).select("h").toPandas())
    return np.sort(counted["h"].to_numpy(np.int64).view(np.uint64))


def describe_sets(docs: DataFrame, key: str, text: str, options: JoinOptions,
                  frequent: np.ndarray) -> DataFrame:
    """id, n, set hash (two longs), sketch and the prefix in the global order of each row."""
    words, percent = options.words, options.percent
    schema = docs.select(F.col(key).alias("id")).schema
    for name, kind in (("n", "long"), ("s1", "long"), ("s2", "long"), ("sketch", "binary"), ("prefix", ArrayType(LongType()))):
        schema = schema.add(name, kind)

    def run(batches):
        for part in text_slices(batches, "_text", 2 << 20):
            flat, bounds = shingle_sets(part.column("_text"), words)
            hot = np.zeros(len(flat), bool)
            if len(frequent) and len(flat):
                at = np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)
                hot = frequent[at] == flat
            n, s1, s2, sketch, prefix = [], [], [], [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                own, mine = flat[a:b], hot[a:b]
                n.append(b - a)
                if a == b:
                    s1.append(0), s2.append(0), sketch.append(None), prefix.append([])
                    continue
                raw = own.tobytes()
                s1.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                s2.append(xxhash.xxh3_64_intdigest(raw, seed=1) - (1 << 63))
                sketch.append(parity_sketch(own))
                length = prefix_length(b - a, percent)
                first = own[~mine][:length]
                if len(first) < length:
                    first = np.concatenate([first, own[mine][:length - len(first)]])
                prefix.append(first.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                 pa.array(sketch, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))],
                names=["id", "n", "s1", "s2", "sketch", "prefix"])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("_text")).mapInArrow(run, schema)


def light_boundary(sizes: list[tuple[int, int]], options: JoinOptions, list_cost: float = 3.0) -> int:
    """Largest light size: the cut that minimises subsets below it plus list entries above it.

    ``list_cost`` is the cost of a list entry (write, sort, verify what it finds) in subset keys.
    """
    best, at = None, 0
    for cut in range(0, options.largest_light + 1):
        cost = sum(count * (subset_count(n, options.percent) if n <= cut
                            else list_cost * prefix_length(n, options.percent)) for n, count in sizes)
        if best is None or cost < best:
            best, at = cost, cut
    return at


def bucket_members(classes: DataFrame, light: DataFrame, boundary: int, options: JoinOptions) -> DataFrame:
    """``bucket``, ``id``, ``n`` and ``m`` (the bucket's size) in buckets with two members or more, with the
    member before in size order (``x``, ``xn``) and the first one (``y``, ``yn``).

    Light sets enter by their subsets; heavy ones, and light ones with heavy partners, by prefix. Members
    travel once: counts and neighbours come from one order of each bucket.
    """
    percent = options.percent
    crossing = F.floor(100 * F.col("n") / percent) > boundary
    heavy = (classes.filter((F.col("n") > boundary) | crossing)
             .select(F.explode("prefix").alias("bucket"), "id", "n"))

    def run(batches):
        from itertools import combinations

        for batch in batches:
            bucket, ids, ns = [], [], []
            for i, n, raw in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(),
                                 batch.column("elements").to_pylist()):
                own = np.frombuffer(raw, np.uint64)
                for c in subset_sizes(n, percent):
                    for subset in combinations(range(n), c):
                        bucket.append(xxhash.xxh3_64_intdigest(own[list(subset)].tobytes(), seed=c + 2) - (1 << 63))
                        ids.append(i)
                        ns.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int64()), pa.array(ids, batch.schema.field("id").type), pa.array(ns, pa.int64())],
                names=["bucket", "id", "n"])

    members = heavy
    if boundary > 0:
        members = heavy.unionByName(light.mapInArrow(run, heavy.schema))
    whole = Window.partitionBy("bucket")
    order = whole.orderBy("n", "id")
    return members.select("bucket", "id", "n", F.count("*").over(whole).alias("m"), F.lag("id").over(order).alias("x"),
                          F.lag("n").over(order).alias("xn"), F.first("id").over(order).alias("y"),
                          F.first("n").over(order).alias("yn")).filter("m > 1")


def _id_hash(column: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << bits))


def id_bitmap(wanted: DataFrame, bits: int) -> np.ndarray:
    """One bit per hash of the wanted ids: ``2 ** bits`` bits, however many ids there are."""
    place = _id_hash("id", bits)
    rows = wanted.select(place.alias("h")).groupBy(F.shiftright("h", 15).alias("w")).agg(
        F.bitmap_construct_agg(F.col("h") % 32768).alias("m")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        out[r["w"] * 4096:(r["w"] + 1) * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def sets_of(docs: DataFrame, key: str, text: str, wanted: DataFrame, options: JoinOptions) -> DataFrame:
    """``id``, ``elements`` (sorted shingle hashes as bytes) of the wanted ids, and of few others.

    Texts are not shuffled: a bitmap of fixed size drops nearly all unwanted rows where they are read;
    the caller's join on the id drops the rest.
    """
    words = options.words
    bitmap = id_bitmap(wanted, options.bitmap_log2)
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("_text")).filter("id IS NOT NULL").withColumn(
        "_h", _id_hash("id", options.bitmap_log2))

    def run(batches):
        def chosen():
            for batch in batches:
                h = np.asarray(batch.column("_h").to_numpy(zero_copy_only=False), np.int64)
                yield batch.filter(pa.array(bitmap[h >> 3] >> (h & 7).astype(np.uint8) & 1 > 0, pa.bool_()))

        for part in text_slices(chosen(), "_text", 2 << 20):
            flat, bounds = shingle_sets(part.column("_text"), words)
            sets = [flat[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], names=["id", "elements"])

    schema = source.select("id").schema.add("elements", "binary")
    return source.mapInArrow(run, schema)


def _by_size(a: str, b: str, percent: int) -> Column:
    """Whether the sizes allow a link."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _sketch_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` whose sketches allow a link."""
    own = classes.select("id", "n", "sketch")
    joined = pairs.select("a", "b").join(own.toDF("a", "na", "ka"), "a").join(own.toDF("b", "nb", "kb"), "b")

    def run(batches):
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(2, 6)]
            ok = pa.array([_sketches_allow(k, l, m, n, percent) for m, k, n, l in zip(*columns)], pa.bool_())
            yield batch.select(["a", "b"]).filter(ok)

    return joined.select("a", "b", "na", "ka", "nb", "kb").mapInArrow(run, pairs.select("a", "b").schema)


def pair_groups(pairs: DataFrame, options: JoinOptions) -> DataFrame:
    """``g``, ``a``, ``b``: pairs in groups of about half of ``pairs_per_task``.

    The end with more pairs is the hub of a pair. A group belongs to one hub, or to that hub's own best
    hub where it has few pairs, and holds a hashed part of the other ends: a hub's set travels once per
    part, however many partners it has on either side of its id.
    """
    block = options.pairs_per_task
    degree = pairs.select(F.col("a").alias("x")).union(pairs.select(F.col("b").alias("x"))).groupBy("x").agg(
        F.count("*").alias("d"))
    ends = salted_join(pairs.select("a", "b"), degree.toDF("a", "da"), ["a"], ["b"])
    ends = salted_join(ends, degree.toDF("b", "db"), ["b"], ["a"])
    first = F.col("da") >= F.col("db")
    turned = stored(ends.select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"),
                                F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"),
                                F.greatest("da", "db").alias("d")))
    best = turned.groupBy(F.col("v").alias("u")).agg(F.min(F.struct(-F.col("d"), "u"))["u"].alias("up"))
    own = turned.groupBy("u").agg(F.count("*").alias("own"))
    roots = own.join(best, "u", "left").select("u", F.when(
        F.col("own") > max(1, block // 8), F.col("u")).otherwise(F.coalesce("up", "u")).alias("r"), "own")
    parts = roots.groupBy("r").agg(F.ceil(2 * F.sum("own") / block).cast("int").alias("parts"))
    placed = salted_join(turned, roots.select("u", "r").join(parts, "r"), ["u"], ["v"])
    other = F.when(F.col("u") == F.col("r"), F.col("v")).otherwise(F.col("u"))
    return placed.select(F.xxhash64("r", F.pmod(F.xxhash64(other), F.col("parts"))).alias("g"), "a", "b")


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, options: JoinOptions) -> DataFrame:
    """Pairs whose sets reach the threshold exactly.

    Pairs go to tasks in groups of bounded size, so that a set travels once per group and not once per
    pair.
    """
    percent = options.percent
    placed = stored(pair_groups(pairs, options))
    need = placed.select("g", F.col("a").alias("id")).union(placed.select("g", F.col("b").alias("id"))).distinct()
    sets = sets_of(docs, key, text, need, options)
    id_type = pairs.schema["a"].dataType
    rows = need.join(sets, "id").select(
        "g", F.lit(0).alias("side"), F.col("id").alias("a"), F.lit(None).cast(id_type).alias("b"), "elements").unionByName(
        placed.select("g", F.lit(1).alias("side"), "a", "b", F.lit(None).cast("binary").alias("elements")))
    rows = rows.repartition("g").sortWithinPartitions("g", "side")

    def run(batches):
        group, sets = None, {}
        for batch in batches:
            ok = []
            for g, side, a, b, raw in zip(*(batch.column(c).to_pylist() for c in ("g", "side", "a", "b")),
                                          batch.column("elements")):
                if g != group:
                    group, sets = g, {}
                if side == 0:
                    own = np.frombuffer(raw.as_py(), np.uint64)
                    sets[a] = own if a not in sets else np.union1d(sets[a], own)
                    ok.append(False)
                    continue
                x, y = sets[a], sets[b]
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        sets.clear()
        give_back_memory()

    return rows.mapInArrow(run, pairs.select("a", "b").schema)


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _near_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Each member with its predecessor in size order and with the first member of its bucket."""
    both = members.select("id", "n", "x", "xn").union(members.select("id", "n", "y", "yn"))
    return both.filter("x IS NOT NULL AND x <> id").filter(_by_size("n", "xn", percent)).select(*_ordered("id", "x")).distinct()


def _cross_pairs(members: DataFrame, labels: DataFrame, classes: DataFrame, tested: DataFrame,
                 options: JoinOptions) -> DataFrame:
    """Untested pairs of different components that share a bucket and whose sketches allow a link.

    In each bucket only members outside its largest component ("outsiders") meet the others: in
    buckets of at most ``small_bucket`` members by a join, in larger ones block by block, where a task
    holds at most two blocks of sketches. A pair that shares several larger buckets is made in the least
    of them only.
    """
    percent, block = options.percent, options.block
    labelled = members.select("bucket", "id", "n", "m").join(labels.toDF("id", "label"), "id", "left").withColumn(
        "label", F.coalesce("label", "id"))
    largest = F.max(F.struct("c", "label")).over(Window.partitionBy("bucket"))
    rows = stored(labelled.withColumn("c", F.count("*").over(Window.partitionBy("bucket", "label"))).withColumn("x", largest)
                  .filter(F.col("x.c") < F.col("m")).select(
                      "bucket", "id", "n", "label", "m", F.col("x.label").alias("main"), (F.col("m") - F.col("x.c")).alias("out")))
    few = rows.filter(F.col("m") <= options.small_bucket).groupBy("bucket", "main").agg(
        F.collect_list(F.struct("id", "n", "label")).alias("all"))
    direct = (few.select("main", "all", F.explode("all").alias("u")).filter("u.label <> main")
              .select("u", F.explode("all").alias("v")).filter("u.label <> v.label")
              .select(F.col("u.id").alias("id"), F.col("u.n").alias("n"), F.col("v.id").alias("x"), F.col("v.n").alias("k"))
              .filter(_by_size("n", "k", percent)).select(*_ordered("id", "x")).distinct())
    direct = _sketch_filter(direct.join(tested, ["a", "b"], "left_anti"), classes, percent)
    rows = rows.filter(F.col("m") > options.small_bucket)
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    parts = lambda size: F.greatest(F.lit(1), F.ceil(F.col(size) / block)).cast("int")
    rows = rows.withColumn("outside", F.col("label") != F.col("main"))
    left = (rows.filter("outside").withColumn("i", (spread % parts("out")).cast("int"))
            .withColumn("j", F.explode(F.sequence(F.lit(0), parts("m") - 1))).withColumn("side", F.lit(0)))
    right = (rows.withColumn("j", (spread % parts("m")).cast("int"))
             .withColumn("i", F.explode(F.sequence(F.lit(0), parts("out") - 1))).withColumn("side", F.lit(1)))
    columns = ["bucket", "i", "j", "side", "id", "n", "label", "outside"]
    shared = rows.groupBy("id").agg(F.collect_set("bucket").alias("buckets"))
    cells = left.select(*columns).unionByName(right.select(*columns)).join(
        classes.select("id", "sketch").join(shared, "id"), "id")
    cells = cells.select(*columns, "sketch", "buckets").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")

    def run(batches):
        carry = None
        for batch in batches:
            frame = batch.to_pandas()
            if carry is not None:
                frame = pd.concat([carry, frame], ignore_index=True)
            keys = frame[["bucket", "i", "j"]].to_numpy()
            last = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            carry = frame.iloc[cut:]
            if cut:
                yield _compare_cells(frame.iloc[:cut], keys[:cut], percent, pairs_schema)
        if carry is not None:
            yield _compare_cells(carry, carry[["bucket", "i", "j"]].to_numpy(), percent, pairs_schema)

    id_type = members.schema["id"].dataType
    spark_schema = StructType([StructField("a", id_type), StructField("b", id_type)])
    pairs_schema = to_arrow_schema(spark_schema)
    blocked = cells.mapInArrow(run, spark_schema).distinct().join(tested, ["a", "b"], "left_anti")
    return direct.union(blocked).distinct()


def _by_length(sketches: np.ndarray) -> list[tuple[np.ndarray, dict[int, np.ndarray]]]:
    """Places of the sketches of each length, with their matrix by folded length."""
    length = np.array([len(x) for x in sketches])
    return [(at := np.flatnonzero(length == size), {size: np.stack([np.frombuffer(sketches[k], np.uint8) for k in at])})
            for size in np.unique(length).tolist()]


def _near_sketches(own: np.ndarray, there: list[tuple[np.ndarray, dict[int, np.ndarray]]], ok: np.ndarray,
                   most: np.ndarray) -> list[int]:
    """Places that are ``ok`` and whose sketches differ from ``own`` in ``most`` bits at most.

    Each pair is compared at the length of its own shorter sketch: folded to the shortest of a block,
    sketches of large sets would lose the bits that tell them apart.
    """
    found: list[int] = []
    for at, folded in there:
        chosen = np.flatnonzero(ok[at])
        if not len(chosen):
            continue
        full = next(iter(folded))
        size = min(full, len(own))
        if size not in folded:
            folded[size] = np.stack([fold_sketch(x, size) for x in folded[full]])
        apart = np.bitwise_count(folded[size][chosen] ^ fold_sketch(own, size)).sum(axis=1, dtype=np.int64)
        found += at[chosen[apart <= most[at[chosen]]]].tolist()
    return found


def _compare_cells(frame: pd.DataFrame, keys: np.ndarray, percent: int, schema: pa.Schema) -> pa.RecordBatch:
    """Pairs (outsider, member) of each cell whose components differ and whose sketches allow a link.

    Left out are pairs that share a bucket below the cell's, and the second turn of two outsiders.
    """
    out_a: list = []
    out_b: list = []
    edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
    side, ids, ns = frame["side"].to_numpy(), frame["id"].to_numpy(), frame["n"].to_numpy()
    labels, sketches = frame["label"].to_numpy(), frame["sketch"].to_numpy()
    outside, buckets = frame["outside"].to_numpy(), frame["buckets"].to_numpy()
    for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
        middle = start + int(np.searchsorted(side[start:stop], 1))
        if middle == start or middle == stop:
            continue
        large = (middle - start) * (stop - middle) > 64
        if large:
            there = _by_length(sketches[middle:stop])
        below = [x[x < keys[start, 0]].tolist() for x in buckets[start:stop]]
        for x in range(start, middle):
            n, m = int(ns[x]), ns[middle:stop]
            least = -(-percent * (n + m) // (100 + percent))
            ok = (labels[middle:stop] != labels[x]) & (least <= np.minimum(n, m))
            if large:
                at = _near_sketches(np.frombuffer(sketches[x], np.uint8), there, ok, n + m - 2 * least)
            else:
                at = [k for k in np.flatnonzero(ok).tolist()
                      if _sketches_allow(sketches[x], sketches[middle + k], n, int(m[k]), percent)]
            lower = set(below[x - start])
            for k in at:
                y = ids[middle + k]
                if outside[middle + k] and not ids[x] < y or not lower.isdisjoint(below[middle + k - start]):
                    continue
                out_a.append(min(ids[x], y))
                out_b.append(max(ids[x], y))
    return pa.RecordBatch.from_pydict({"a": out_a, "b": out_b}, schema=schema)


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text",
                       options: JoinOptions = JoinOptions()) -> DataFrame:
    """One row per input row: ``id``, ``n_shingles``, ``component`` (smallest id reachable)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(key, text)
    frequent = frequent_shingles(docs, key, text, options)
    described = stored(describe_sets(docs, key, text, options, frequent))
    known = described.filter("id IS NOT NULL")
    classes = stored(known.filter("n > 0").groupBy("s1", "s2", "n").agg(
        F.min("id").alias("id"), F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix")))
    sizes = [(r["n"], r["c"]) for r in classes.filter(F.col("n") <= 2 * options.largest_light)
             .groupBy("n").agg(F.count("*").alias("c")).collect()]
    boundary = light_boundary(sizes, options)
    small = classes.filter(F.col("n") <= boundary).select("id", "n")
    light = sets_of(docs, key, text, small, options).join(small, "id").filter(
        F.length("elements") == 8 * F.col("n")).select("id", "n", "elements")
    members = stored(bucket_members(classes.select("id", "n", "prefix"), light, boundary, options))
    paired = stored(classes.select("id", "n", "sketch").join(members.select("id").distinct(), "id", "left_semi"))
    near = stored(_sketch_filter(_near_pairs(members, options.percent), paired, options.percent))
    links = stored(verified(near, docs, key, text, options))
    labels = connected_components(links)
    cross = stored(_cross_pairs(members, labels, paired, near, options))
    more = verified(cross, docs, key, text, options)
    copies = known.filter("n > 0").join(
        classes.select("s1", "s2", F.col("n"), F.col("id").alias("rep")), ["s1", "s2", "n"])
    final = connected_components(links.union(more).union(
        copies.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("a", "b")))
    classes_of = classes.join(final.toDF("id", "component"), "id", "left").select(
        "s1", "s2", "n", F.coalesce("component", "id").alias("component"))
    return described.join(classes_of, ["s1", "s2", "n"], "left").select(
        "id", F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))
