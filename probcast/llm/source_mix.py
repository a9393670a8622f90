"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Sources share the words of the mix by weight; a target stops at ``repeats`` times its source's size and
the excess goes to the others by weight. Each source's documents are shuffled by hash, laid end to end
and cut into blocks of equal word counts. A golden-ratio sequence, mapped through the cumulative
numbers of blocks that the targets need, says from which source each slot of the mix is; the slots of
a source, ranked, take its blocks in order, again and again where the target exceeds the source.

With ``n`` needed blocks, ``2 n`` points are made: the widest gap of ``2 n`` golden-ratio points is
below ``1 / n``, so every source meets all its slots however small its share. A document's words are
taken at most once in a pass, so never more than ``repeats`` times.

Defined cases: a null text has no words; a null source is a source, last in order; documents without
words are returned and give nothing; rows equal in key, text and source are counted once and laid side
by side; without words all targets are 0; an empty table gives empty results. Only one row of totals
reaches the driver. Windows hold one row per source, or about the square root of a source's rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from probcast.llm.common import stored

SPACES = " \t\n\u000b\f\r"
WORD = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"
MODULUS = 1 << 41
GOLDEN = int((math.sqrt(5) - 1) / 2 * MODULUS) | 1
HALF_BITS = 20
HALF = 1 << HALF_BITS  # the product of a slot and GOLDEN is taken in two halves, each below 2^62
CELLS = 1024


@dataclass(frozen=True)
class MixOptions:
    weights: tuple[int, ...] = (5, 2, 1)  # of the sources by code point, repeating
    percent: float = 100.0  # words of the mix, in hundredths of all words
    repeats: int = 3  # a target stops at this many times its source's size
    block: int = 4096  # words of a block
    seed: int = 0  # of the shuffle


@dataclass(frozen=True)
class Mix:
    """``sources``: one row each with target and slots. ``documents``: every row of the input with its
    place in its source. ``schedule``: the slots of the mix in order, with the block each one takes."""

    sources: DataFrame
    documents: DataFrame
    schedule: DataFrame
    options: MixOptions

    def pieces(self) -> DataFrame:
        """The mix: for each slot the documents in it, in order of ``at``, and the words
        ``first`` to ``last`` (not included) that they give."""
        b = self.options.block
        cut = self.documents.filter("size > 0").withColumn(
            "block", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")))
        begin = F.greatest("start", F.col("block") * b)
        end = F.least(F.col("start") + F.col("size"), F.col("stop"))
        return cut.join(self.schedule, ["source_id", "block"]).filter(end > begin).select(
            "slot", begin.alias("at"), "key", "source_id", "start", (begin - F.col("start")).alias("first"),
            (end - F.col("start")).alias("last"))

    def taken(self) -> DataFrame:
        """Every document with the number of its words in the mix, repeats counted."""
        sums = self.pieces().groupBy("source_id", F.col("start").alias("_at")).agg(
            F.sum(F.col("last") - F.col("first")).alias("_taken"))
        rows = self.documents.withColumn("_at", F.expr("if(size > 0, start, NULL)"))
        return rows.join(sums, ["source_id", "_at"], "left").select(
            "key", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).alias("taken"))


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, without building them."""
    return F.coalesce(F.length(F.regexp_replace(F.rtrim(text, F.lit(SPACES)), WORD, "x")), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, options: MixOptions) -> DataFrame:
    """Target, blocks and slots of every source from its ``source_size``.

    The resharing has a closed form: sources reach their limit in order of limit by weight. Seen at a
    source, the level is what is left for it and the later ones by unit of weight; it rises while
    sources are full and falls afterwards, so the final level is the greatest.
    """
    whole = Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("_ratio", "source_id").rowsBetween(Window.unboundedPreceding, -1)
    numbered = totals.withColumn("source_id", F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())))
    weights = F.array(*[F.lit(w) for w in options.weights])
    filled = numbered.withColumn(
        "weight", F.element_at(weights, F.pmod(F.col("source_id") - 1, F.lit(len(options.weights))) + 1)
    ).withColumn("_limit", F.col("source_size") * options.repeats).withColumn(
        "_ratio", F.col("_limit") / F.col("weight"))
    level = ((F.sum("source_size").over(whole) * F.lit(options.percent) / 100
              - F.coalesce(F.sum("_limit").over(earlier), F.lit(0)))
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))))
    b = options.block
    return filled.withColumn("_level", level).withColumn("_level", F.max("_level").over(whole)).withColumn(
        "target", F.least(F.col("_limit").cast("double"), F.col("weight") * F.col("_level"))
    ).withColumn("goal", F.floor(F.col("target") + 0.5)).selectExpr(
        "source_id", "source", "source_size", "rows", "weight", "target",
        f"(source_size + {b - 1}) div {b} AS blocks",
        "coalesce(goal div nullif(source_size, 0), 0) AS passes",
        "coalesce(goal % nullif(source_size, 0), 0) AS rest",
    ).selectExpr("*", f"passes * blocks + (rest + {b - 1}) div {b} AS slots").withColumn(
        "first_slot", F.coalesce(F.sum("slots").over(
            whole.orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _running(rows: DataFrame, group: list[str], part: str, order: list[str], amount: Column, name: str) -> DataFrame:
    """Sum of ``amount`` over the earlier rows of a group, in two levels: over whole parts, then inside
    a part. ``part`` must not fall along ``order``."""
    before = (Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, part).agg(F.sum(amount).alias("_sum"))
    parts = sums.select(*group, part, F.coalesce(F.sum("_sum").over(
        Window.partitionBy(*group).orderBy(part).rowsBetween(*before)), F.lit(0)).alias("_base"))
    inside = F.sum(amount).over(Window.partitionBy(*group, part).orderBy(*order).rowsBetween(*before))
    return rows.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(parts, [*group, part]).withColumn(
        name, F.col("_base") + F.col("_inside")).drop("_base", "_inside")


def golden_points(slot: Column, n: int) -> Column:
    """Golden-ratio point of a slot, as a whole number below ``n``."""
    high = F.pmod(F.shiftright(slot, HALF_BITS) * F.lit(GOLDEN), F.lit(MODULUS)) * HALF
    u = F.pmod(high + F.pmod(slot, F.lit(HALF)) * F.lit(GOLDEN), F.lit(MODULUS))
    return F.floor(u / F.lit(float(MODULUS)) * F.lit(float(n))).cast("long")


def slot_schedule(sources: DataFrame, n: int, options: MixOptions) -> DataFrame:
    """The slots of the mix: source, pass, block and the end of the words to take from it.

    Points meet the sources' ranges by cells of equal width, so the join is on equality.
    """
    width, part = max(1, -(-n // CELLS)), max(1024, math.isqrt(2 * n))
    points = sources.sparkSession.range(2 * n).select(F.col("id").alias("slot")).withColumn(
        "point", golden_points(F.col("slot"), max(n, 1))).withColumn("cell", F.expr(f"point div {width}"))
    ranges = sources.filter("slots > 0").withColumn("cell", F.explode(F.expr(
        f"sequence(first_slot div {width}, (first_slot + slots - 1) div {width})")))
    hits = points.join(ranges, "cell").filter("point >= first_slot AND point < first_slot + slots").withColumn(
        "_part", F.expr(f"slot div {part}"))
    ranked = _running(hits, ["source_id"], "_part", ["slot"], F.lit(1), "turn").filter("turn < slots")
    b = options.block
    return ranked.selectExpr(
        "slot", "source_id", "turn div blocks AS pass", "turn % blocks AS block",
        f"least((turn % blocks + 1) * {b}, if(turn div blocks < passes, source_size, rest)) AS stop")


def mix_sources(docs: DataFrame, options: MixOptions = MixOptions(), key: str = "doc_id", text: str = "text",
                source: str = "source") -> Mix:
    """Shuffle, cut and schedule all documents. See the module for the method and the defined cases."""
    name = F.concat_ws(":", F.lit(str(options.seed)), F.coalesce(F.col(key).cast("string"), F.lit("")),
                       F.coalesce(F.col(text), F.lit("")))
    rows = stored(docs.select(F.col(key).alias("key"), F.col(source).alias("source"),
                              word_count(F.col(text)).alias("size"), F.md5(name).alias("hash"))
                  .groupBy("key", "source", "size", "hash").agg(F.count(F.lit(1)).alias("copies")))
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"),
                                        F.count(F.lit(1)).alias("rows"))
    sources = stored(source_targets(totals, options))
    n, count = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    schedule = slot_schedule(sources, n, options)
    parts = max(1, math.isqrt(count))
    known = sources.select("source_id", F.col("source").alias("_source"), "source_size", "target")
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn(
        "_part", F.expr(f"(conv(substr(hash, 1, 8), 16, 10)::long * {parts}) div {1 << 32}"))
    placed = _running(rows, ["source_id"], "_part", ["hash", "key", "size"], F.col("size") * F.col("copies"), "start")
    documents = placed.withColumn("_copy", F.explode(F.expr("sequence(0L, copies - 1)"))).select(
        "key", "source", "source_id", "size", "source_size", "target",
        (F.col("start") + F.col("_copy") * F.col("size")).alias("start"))
    return Mix(sources, documents, schedule, options)


def mix_sql(options: MixOptions = MixOptions()) -> str:
    """DuckDB SQL of the query: the same mix with plain windows."""
    b, r = options.block, options.repeats
    weights = ", ".join(map(str, options.weights))
    return f"""
WITH doc AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('{options.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS hash
  FROM documents),
total AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM doc GROUP BY source),
weighed AS (
  SELECT *, ([{weights}])[(source_id - 1) % {len(options.weights)} + 1] AS weight FROM (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_id FROM total)),
levels AS (
  SELECT *, (sum(source_size) OVER () * {options.percent} / 100
             - coalesce(sum({r} * source_size) OVER earlier, 0))
          / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
  FROM weighed WINDOW earlier AS (ORDER BY {r} * source_size / weight, source_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aimed AS (
  SELECT *, least(CAST({r} * source_size AS DOUBLE), weight * max(level) OVER ()) AS target FROM levels),
need AS (
  SELECT source, source_id, source_size, target, (source_size + {b - 1}) // {b} AS blocks,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS passes,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) % source_size ELSE 0 END AS rest
  FROM aimed),
slotted AS (SELECT *, passes * blocks + (rest + {b - 1}) // {b} AS slots FROM need),
ranges AS (
  SELECT *, coalesce(sum(slots) OVER (ORDER BY source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_slot
  FROM slotted),
n AS (SELECT CAST(sum(slots) AS BIGINT) AS n FROM ranges),
points AS (
  SELECT slot, floor(CAST((((slot // {HALF}) * {GOLDEN} % {MODULUS}) * {HALF} + (slot % {HALF}) * {GOLDEN}) % {MODULUS} AS DOUBLE)
                     / CAST({MODULUS} AS DOUBLE) * CAST(n AS DOUBLE)) AS point
  FROM (SELECT unnest(range(0, (SELECT 2 * n FROM n))) AS slot), n),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY slot) - 1 AS turn
  FROM points JOIN ranges ON point >= first_slot AND point < first_slot + slots),
schedule AS (
  SELECT source_id, turn % blocks AS block,
         least((turn % blocks + 1) * {b}, CASE WHEN turn // blocks < passes THEN source_size ELSE rest END) AS stop
  FROM turns WHERE turn < slots),
placed AS (
  SELECT doc_id, size, source_id, source_size, target, row_number() OVER () AS row,
         coalesce(sum(size) OVER (PARTITION BY source_id ORDER BY hash, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM doc JOIN ranges ON doc.source IS NOT DISTINCT FROM ranges.source),
cut AS (
  SELECT row, source_id, start, size, unnest(range(CAST(start // {b} AS BIGINT), CAST((start + size - 1) // {b} + 1 AS BIGINT))) AS block
  FROM placed WHERE size > 0),
given AS (
  SELECT row, sum(greatest(0, least(start + size, stop) - greatest(start, block * {b}))) AS taken
  FROM cut JOIN schedule USING (source_id, block) GROUP BY row)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM placed LEFT JOIN given USING (row)
"""
