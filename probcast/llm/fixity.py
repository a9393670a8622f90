"""Fixity audit of WARC records by Merkle trees over offset ranges.

Records are hashed (SHA-256 of their stored bytes). The leaves of a file's tree are its records by
offset; a node covers a range of ``leaf_bytes * fanout ** level`` bytes of offsets and hashes the
(offset, length, hash) list of its records or the (number, hash) list of its children; a file's root
covers the whole file, and one root covers all files. Replicas are compared from the root down: only
children of nodes that differ are read at the next level, down to single records. Above the files the
same fan-out groups file numbers.

Each level is a group-by on the node number, so a node's list holds at most ``fanout`` children, or the
records of ``leaf_bytes`` bytes. Files are independent, and no node depends on the size of the set.

Defined cases: a null payload is a record of its header alone; a record that only one replica has is
"missing" or "extra", other differences are "changed"; records that share file and offset form one
leaf hashed in payload order; an empty replica differs from any other at the root; two empty ones agree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from probcast.llm.common import stored


def warc_record(uri: Column, body: Column) -> Column:
    """Stored bytes of a response record: header, body, and the blank lines that end a record."""
    body = F.encode(F.coalesce(body, F.lit("")), "UTF-8")
    header = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")),
                      F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(header, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def lay_out(rows: DataFrame, file: Column, order: Sequence[str], record: Column) -> DataFrame:
    """``file``, ``offset``, ``length``, ``hash`` of records laid one after another in each file.

    Only lengths and hashes are sorted, not records; a file is bounded by whoever numbers files.
    """
    names = [f"_o{i}" for i in range(len(order))]
    slim = (rows.withColumn("_record", record)
            .select(file.alias("file"), *[F.col(c).alias(n) for c, n in zip(order, names)],
                    F.octet_length("_record").cast("long").alias("length"), F.sha2("_record", 256).alias("hash")))
    before = Window.partitionBy("file").orderBy(*names, "hash").rowsBetween(Window.unboundedPreceding, -1)
    return slim.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(
        *names, "file", "offset", "length", "hash")


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(",", *[p.cast("string") for p in parts]), 256)


Step = Callable[[], tuple[Column, Column]]


def tree_steps(longest: int, files: int, leaf_bytes: int, fanout: int) -> list[Step]:
    """How a node finds its parent, level by level, up to one root: first inside files, then over
    file numbers. ``longest`` is the largest offset, ``files`` the largest file number."""
    steps: list[Step] = [lambda: (F.col("file"), F.floor(F.col("node") / leaf_bytes))]
    nodes = longest // leaf_bytes + 1
    while nodes > 1:
        steps.append(lambda: (F.col("file"), F.floor(F.col("node") / fanout)))
        nodes = -(-nodes // fanout)
    count = files + 1
    while count > 1:
        steps.append(lambda: (F.floor(F.col("file") / fanout), F.col("node")))
        count = -(-count // fanout)
    return steps


def merkle_levels(records: DataFrame, steps: Sequence[Step]) -> list[DataFrame]:
    """Node tables ``file``, ``node``, ``hash`` from single records (with ``length``) to the root."""
    leaves = records.groupBy("file", F.col("offset").alias("node")).agg(
        F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("length", "hash"))).alias("_x"))
    levels = [stored(leaves.select("file", "node", "length", _digest(F.col("node"), F.to_json("_x")).alias("hash")))]
    for step in steps:
        file, node = step()
        grouped = (levels[-1].select(file.alias("_f"), node.alias("_n"), F.struct("file", "node", "hash").alias("_c"))
                   .groupBy("_f", "_n").agg(F.array_sort(F.collect_list("_c")).alias("_x")))
        levels.append(stored(grouped.select(F.col("_f").alias("file"), F.col("_n").alias("node"),
                                            _digest(F.to_json("_x")).alias("hash"))))
    return levels


def _steps_for(tables: Sequence[DataFrame], leaf_bytes: int, fanout: int) -> list[Step]:
    ends = [t.agg(F.max("offset"), F.max("file")).first() for t in tables]
    return tree_steps(max((e[0] or 0) for e in ends), max((e[1] or 0) for e in ends), leaf_bytes, fanout)


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    a = left.select("file", "node", F.col("hash").alias("ha"))
    b = right.select("file", "node", F.col("hash").alias("hb"))
    return a.join(b, ["file", "node"], "full_outer").filter(~F.col("ha").eqNullSafe(F.col("hb")))


def audit(original: DataFrame, replica: DataFrame, leaf_bytes: int = 1 << 14, fanout: int = 16) -> DataFrame:
    """Records in which two replicas differ: file, offset, length, kind.

    Both inputs have ``file`` (an integer from 0), ``offset``, ``length``, ``hash`` (see ``lay_out``).
    """
    steps = _steps_for([original, replica], leaf_bytes, fanout)
    ours, theirs = merkle_levels(original, steps), merkle_levels(replica, steps)
    suspects = stored(_differing(ours[-1], theirs[-1]).select("file", "node"))
    for level in range(len(steps) - 1, -1, -1):
        file, node = steps[level]()
        marked = suspects.select(F.col("file").alias("_f"), F.col("node").alias("_n"))

        def below(table: DataFrame) -> DataFrame:
            return table.withColumns({"_f": file, "_n": node}).join(marked, ["_f", "_n"], "left_semi")

        suspects = stored(_differing(below(ours[level]), below(theirs[level])).select("file", "node"))
    mine = ours[0].join(suspects, ["file", "node"], "left_semi").select("file", "node", F.col("length").alias("la"))
    other = theirs[0].join(suspects, ["file", "node"], "left_semi").select("file", "node", F.col("length").alias("lb"))
    kind = F.when(F.col("lb").isNull(), "missing").when(F.col("la").isNull(), "extra").otherwise("changed")
    return mine.join(other, ["file", "node"], "full_outer").select(
        "file", F.col("node").alias("offset"), F.coalesce("la", "lb").alias("length"), kind.alias("kind"))


def root_hash(records: DataFrame, leaf_bytes: int = 1 << 14, fanout: int = 16) -> list[str]:
    """Hash of the root (no hash when there are no records)."""
    root = merkle_levels(records, _steps_for([records], leaf_bytes, fanout))[-1]
    return [r["hash"] for r in root.orderBy("file", "node").collect()]
