"""Large panels, joins by measured skew, bounded samples, stored tables that touch few files."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from probcast.operators import sampling as P, series as S, skew, two_way
from probcast.sources.store import KeyedStore
from tests.conftest import day, rows


# --- two-way fits ----------------------------------------------------------------------------

def random_panel(rng, questions, models, most):
    """Rows (models, counts) of an unbalanced, connected panel; model 0 answers everything."""
    out = []
    for _ in range(questions):
        own = np.unique(np.append(rng.choice(models, rng.integers(1, most), replace=False), 0))
        out.append((own.tolist(), rng.integers(1, 4, len(own)).astype(float).tolist()))
    return out


def dense_solution(panel, weights, residual, models):
    gram = np.zeros((models, models))
    for (idx, nf), w in zip(panel, weights):
        n = np.zeros(models)
        n[idx] = nf
        gram += w * (np.diag(n) - np.outer(n, n) / n.sum())
    used = np.flatnonzero(np.diag(gram) > 1e-12)
    out = np.zeros(models)
    out[used[1:]] = np.linalg.lstsq(gram[np.ix_(used[1:], used[1:])], residual[used[1:]], rcond=None)[0]
    return out


@pytest.mark.parametrize("models,questions,replicates,cells", [(40, 90, 7, 1 << 21), (150, 60, 3, 200), (5, 30, 1, 50)])
def test_conjugate_gradients_equal_a_dense_solve(spark, monkeypatch, models, questions, replicates, cells):
    monkeypatch.setattr(two_way, "CELLS", cells)
    rng = np.random.default_rng(models)
    panel = random_panel(rng, questions, models, min(models, 12))
    weights = rng.integers(0, 4, (questions, replicates)).astype(float)
    diagonal, residual = np.zeros((models, replicates)), np.zeros((models, replicates))
    for (idx, nf), w in zip(panel, weights):
        y = rng.random(len(idx)) * nf
        diagonal[idx] += np.outer(nf, w)
        residual[idx] += np.outer(y - np.array(nf) * y.sum() / np.sum(nf), w)
    df = spark.createDataFrame([(i, n, w.tolist()) for (i, n), w in zip(panel, weights)],
                               "idx ARRAY<INT>, nf ARRAY<DOUBLE>, w ARRAY<DOUBLE>").repartition(3)
    got = two_way.solve(df, diagonal, residual)
    for k in range(replicates):
        assert got[:, k] == pytest.approx(dense_solution(panel, weights[:, k], residual[:, k], models), abs=1e-8)
    assert two_way.parts(df) == 1


def test_a_chain_of_models_takes_as_many_passes_as_models(spark):
    """Each question links two neighbours: the worst shape for the iteration."""
    models = 25
    true = np.cumsum(np.random.default_rng(3).normal(size=models))
    diagonal, residual = np.zeros((models, 1)), np.zeros((models, 1))
    for i in range(models - 1):
        half = (true[i] - true[i + 1]) / 2
        diagonal[[i, i + 1], 0] += 1
        residual[[i, i + 1], 0] += half, -half
    df = spark.createDataFrame([([i, i + 1], [1.0, 1.0], [1.0]) for i in range(models - 1)],
                               "idx ARRAY<INT>, nf ARRAY<DOUBLE>, w ARRAY<DOUBLE>").coalesce(1)
    assert two_way.solve(df, diagonal, residual)[:, 0] == pytest.approx(true - true[0], abs=1e-8)
    with pytest.raises(ValueError, match="not solved"):
        two_way.solve(df, diagonal, residual, passes=3)
    assert two_way.parts(df) == 1
    assert two_way.parts(df.filter("idx[0] <> 12")) == 2


# --- skew ------------------------------------------------------------------------------------

def test_no_task_gets_a_third_of_the_rows(spark):
    """One key and the nulls hold a third each; partitions of the salted join are even."""
    left = spark.range(90_000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(
        F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 5000)).alias("key"))
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(5000)], "key STRING, v INT")
    saved = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions",
                                            "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        joined = skew.skew_join(left, right, ["key"], ["id"], "left")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 16 and max(sizes) <= 2 * sorted(sizes)[8] and sum(sizes) == 90_000
        plain = left.join(right, "key", "left")
        for df in (joined, plain):
            assert df.agg(F.sum("v"), F.count("v"), F.count("*")).first() == plain.agg(F.sum("v"), F.count("v"), F.count("*")).first()
        for how in ("inner", "left_semi", "left_anti"):
            assert skew.skew_join(left, right, ["key"], ["id"], how).count() == left.join(right, "key", how).count()
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert set(skew.hot_keys(left, ["key"], 16)) == {left.filter("key = 'hot'").select(F.xxhash64("key")).first()[0]}
    assert skew.hot_keys(left.filter("key is null"), ["key"], 16) == {}
    with pytest.raises(ValueError):
        skew.skew_join(left, right, ["key"], ["id"], "full")


def dropouts_by_hand(items, pages):
    out = []
    for page, item in {(p, i) for p, i, _ in items}:
        own = sorted(d for p, i, d in items if (p, i) == (page, item))
        dates = sorted(d for p, d in pages if p == page)
        after = [d for d in dates if d > own[-1]]
        end = after[0] if after else own[-1]
        out += [(page, item, d) for d in dates if own[0] < d <= end and d not in own]
    return sorted(out)


@pytest.mark.parametrize("start", [None, day("2024-01-08")])
def test_dropouts_of_a_page_that_holds_most_items(spark, start):
    rng = np.random.default_rng(8)
    pages = [(p, day("2024-01-01") + np.timedelta64(int(k), "D").astype(object)) for p, step in (("big", 1), ("rare", 3))
             for k in range(0, 20, step)]
    items = []
    for page, count in (("big", 60), ("rare", 4)):
        dates = [d for p, d in pages if p == page]
        for i in range(count):
            items += [(page, f"i{i}", dates[k]) for k in sorted(rng.choice(len(dates), rng.integers(1, 5), replace=False))]
    frame = spark.createDataFrame([(p, i, d, "x") for p, i, d in items], "page STRING, item STRING, date DATE, value STRING")
    known = spark.createDataFrame(pages, "page STRING, date DATE")
    got = S.mark_dropouts(frame, known, storage_start=start)
    marked = got.filter("value is null")
    usable = [(p, d) for p, d in pages if start is None or d >= start]
    assert rows(marked, "page", "item", "date") == sorted(dropouts_by_hand(items, usable), key=repr)
    assert got.count() == len(items) + marked.count()


# --- samples ---------------------------------------------------------------------------------

@pytest.mark.parametrize("size,quota", [(4000, 50), (30, 29), (30, 30), (30, 90), (200, 0)])
def test_bounded_samples_are_exact(spark, size, quota):
    df = spark.range(size).select(F.concat(F.lit("k"), "id").alias("id"), F.lit("s").alias("bin"), (F.col("id") % 3).alias("quota_"))
    quotas = spark.createDataFrame([("s", quota), ("absent", 5)], "bin STRING, quota BIGINT")
    got = P.sample_strata(df, quotas, ["bin"], 7)
    order = lambda i: hashlib.md5(f"{i}#7".encode()).hexdigest()
    want = sorted((f"k{i}" for i in range(size)), key=order)[:quota]
    assert sorted(r.id for r in got.collect()) == sorted(want)
    assert got.columns == ["bin", "id", "quota_"]


def test_a_stratum_whose_hashes_are_uneven_is_widened_until_whole(spark):
    """All rows share one id, whose hash lies anywhere: counts notice and the bound grows."""
    df = spark.createDataFrame([("same", "s", k) for k in range(500)], "id STRING, bin STRING, k INT")
    quotas = spark.createDataFrame([("s", 3)], "bin STRING, quota BIGINT")
    assert P.sample_strata(df, quotas, ["bin"], 1).count() == 3


# --- stored tables ---------------------------------------------------------------------------

def files_of(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path)
            for f in names if f.endswith(".parquet")}


SERIES = "source STRING, id STRING, date DATE, value DOUBLE"


def series_rows(source, ids, days=3, value=1.0):
    return [(source, i, day(f"2024-01-0{1 + k}"), value + k) for i in ids for k in range(days)]


def test_store_reads_only_the_folders_of_the_wanted_keys(spark, tmp_path):
    store = KeyedStore(str(tmp_path / "s"), SERIES, ("id", "date"), by=("source",), buckets=32)
    assert store.read(spark).count() == 0
    ids = [f"q{i}" for i in range(200)]
    store.create(spark.createDataFrame(series_rows("fred", ids) + series_rows("acled / x=1", ids), SERIES))
    wanted = spark.createDataFrame([("fred", "q7"), ("fred", "q150"), ("fred", "none")], "source STRING, id STRING")
    got = store.read_keys(wanted)
    assert rows(got, "source", "id", "date", "value") == sorted(series_rows("fred", ["q7", "q150"]), key=repr)
    scanned = store.folders_of(wanted).select("_metadata.file_path").distinct().count()
    assert scanned <= 3 < len(files_of(store.path)) / 8
    assert store.keys(spark).count() == 400


def test_upsert_keeps_the_files_of_untouched_folders(spark, tmp_path):
    store = KeyedStore(str(tmp_path / "s"), SERIES, ("id", "date"), by=("source",), buckets=16)
    ids = [f"q{i}" for i in range(100)]
    store.create(spark.createDataFrame(series_rows("fred", ids) + series_rows("yfinance", ids), SERIES))
    before = files_of(store.path)
    new = spark.createDataFrame(series_rows("fred", ["q1", "fresh"], 4, 10.0), SERIES)
    store.upsert(new)
    after = files_of(store.path)
    kept = set(before) & set(after)
    assert len(kept) >= len(before) - 2 and all(before[f] == after[f] for f in kept)
    want = [r for r in series_rows("fred", ids) if r[1] != "q1"] + series_rows("fred", ["q1", "fresh"], 4, 10.0) + series_rows("yfinance", ids)
    assert rows(store.read(spark), "source", "id", "date", "value") == sorted(want, key=repr)
    store.upsert(new)
    assert rows(store.read(spark), "source", "id", "date", "value") == sorted(want, key=repr)
    store.upsert(new.limit(0))
    store.replace_groups(spark.createDataFrame(series_rows("yfinance", ["only"]), SERIES))
    assert rows(store.read(spark).filter("source = 'yfinance'"), "id").count(("only",)) == 3
    assert store.read(spark).filter("source = 'fred'").count() == 305 and store.read(spark).count() == 308
