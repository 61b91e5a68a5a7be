"""The routes of large tables against those of small ones, with the size from which they count as large set to nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import stats
from lumenfold.operators import clean, gate


@pytest.fixture
def rows(spark):
    """Three samples of very different size, with ties, a null sample, null values."""
    rng = np.random.default_rng(7)
    out = [("a", i, float(rng.normal()), float(rng.integers(5))) for i in range(300_000)] + [("b", i, float(i % 3), float(i)) for i in range(120_000)]
    out += [("c", 1, 5.0, None), ("c", 2, None, None), (None, 3, 7.0, 1.0), (None, 4, 9.0, 2.0), ("d", 5, None, None)]
    return spark.createDataFrame(out, "sample string, event_id long, v double, w double").repartition(6).cache()


def large(monkeypatch):
    monkeypatch.setattr(stats, "LARGE", -1)


def by_key(df):
    return {r[0]: r[1:] for r in df.collect()}


def test_median_and_mad_of_large_tables(spark, rows, monkeypatch):
    """brackets by the size of the files read, and a null key is a key."""
    small = by_key(stats.with_mad(rows, ["sample"], "v"))
    assert set(small) == {"a", "b", "c", "d", None} and small[None][0] == 8.0 and small["d"] == (None, None)
    large(monkeypatch)
    df = stats.with_mad(rows, ["sample"], "v")
    assert "percentile(" not in df._jdf.queryExecution().optimizedPlan().toString()  # no task counts all values of a key
    got = by_key(df)
    assert set(got) == set(small)
    for k in small:
        assert got[k] == pytest.approx(small[k], rel=1e-12) if small[k][0] is not None else got[k] == small[k]
    many = by_key(stats.column_quantiles(rows, ["sample"], ["v", "w"], [0.0, 0.2, 0.2004, 0.5, 1.0]))
    few = by_key(stats.column_quantiles(rows, ["sample"], ["v", "w"], [0.0, 0.2, 0.2004, 0.5, 1.0], False))
    for k in few:
        for g, w in zip(many[k], few[k], strict=True):
            assert (w is None or w[0] is None) == (g is None or g[0] is None) and (w is None or w[0] is None or np.allclose(g, w, rtol=1e-12, atol=0)), k


def test_size_is_that_of_the_files_read(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows.write.parquet(path)
    df = spark.read.parquet(path)
    assert not stats.is_large(df)
    monkeypatch.setattr(stats, "LARGE", 1 << 10)
    assert stats.is_large(df.select("v")) and not stats.is_large(rows.sparkSession.range(3).select(F.lit(1.0)))
    assert not stats.is_large(df, 2 << 30) and not stats.is_large(df.join(df.withColumnRenamed("v", "u"), "event_id"), 2 << 30)


def test_ratio_limits_of_large_tables_are_settled_once(rows, monkeypatch):
    """the second filter does not find the first one's quantile again."""
    df = rows.withColumn("h", F.lit(2.0)).withColumn("h2", F.col("w") + 1)
    pairs = [("v", "h", 0.85), ("v", "h2", 0.975)]
    want = sorted(clean.singlets(df, ["sample"], pairs).select("sample", "event_id").collect())
    large(monkeypatch)
    monkeypatch.setattr(clean, "is_large", lambda df: True)
    got = clean.singlets(df, ["sample"], pairs)
    assert sorted(got.select("sample", "event_id").collect()) == want and len(want) > 300_000
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_bins_without_a_price(spark, sf, tmp_path, monkeypatch):
    """both routes give the same bins; a line without a price is in the first, as in the SQL; an empty table has none."""
    from lumenfold.plans import stat_queries

    li = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("l_extendedprice", F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")))
    li.write.parquet(str(tmp_path / "lineitem.parquet"))
    small = sorted(stat_queries.quantile_bin_median(spark, str(tmp_path)).collect())
    assert sum(r["n"] for r in small) == li.count() and [r["bin"] for r in small] == [1, 2, 3, 4, 5] and small[0]["n"] > small[1]["n"]
    large(monkeypatch)
    df = stat_queries.quantile_bin_median(spark, str(tmp_path))
    assert "percentile(" not in df._jdf.queryExecution().optimizedPlan().toString() and sorted(df.collect()) == small
    li.limit(0).write.mode("overwrite").parquet(str(tmp_path / "none" / "lineitem.parquet"))
    assert stat_queries.quantile_bin_median(spark, str(tmp_path / "none")).count() == 0


def test_brightest_of_large_samples(rows, monkeypatch):
    """more than a thousand rows a sample, without sorting a sample in one task; ties go by id, nulls come last."""
    want = {v: sorted(clean.top(rows, v, 2000, ["sample"]).select("event_id").collect()) for v in ("v", "w")}
    monkeypatch.setattr(clean, "is_large", lambda df: True)
    for v in want:
        got = clean.top(rows, v, 2000, ["sample"])
        assert sorted(got.select("event_id").collect()) == want[v]
    kept = {r[0]: r[1] for r in clean.candidates(rows, "v", 2000, ["sample"]).groupBy("sample").count().collect()}
    assert 2000 <= kept["a"] < 10_000 and kept["b"] == 40_000 and kept["c"] == 2


def test_gates_of_large_tables(spark, monkeypatch):
    """large and small tables have the same gate; few peaks bound a peak's cell; hulls lose no corner; nulls are outside."""
    rng = np.random.default_rng(3)
    at = np.vstack([rng.normal((50, 40), (5, 4), (3000, 2)), rng.normal((90, 75), (3, 3), (800, 2))])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in at] + [(None, 1.0), (2.0, None)], "x double, y double").repartition(3)
    small = gate.find_gate(df, "x", "y", (0.0, 0.0), (120.0, 120.0), 40)
    monkeypatch.setattr(gate, "is_large", lambda df: True)
    large(monkeypatch)
    assert np.allclose(gate.find_gate(df, "x", "y", (0.0, 0.0), (120.0, 120.0), 40), small, rtol=1e-12)
    assert sorted(gate.inside(df, "x", "y", small).collect()) == sorted(df.where(gate.in_polygon(F.col("x"), F.col("y"), small)).collect())
    for points in (at, np.round(at), at[:5], np.repeat(at[:1], 100, 0), np.stack([at[:, 0], at[:, 0]], 1)):
        assert gate.hull(gate.outermost(points)) == gate.hull(points)
    peaks = [(float(i), float(j)) for i in range(0, 120, 12) for j in range(0, 120, 12)]
    assert 8 <= len(gate.rivals(peaks, 55, (0.0, 0.0), (120.0, 120.0))) <= 24
    cells = gate.voronoi(df.dropna(), "x", "y", peaks).groupBy("peak").count().collect()
    for r in sorted(cells, key=lambda r: -r["count"])[:4]:
        assert gate.nearest_to(df.dropna(), "x", "y", peaks, r["peak"], (0.0, 0.0), (120.0, 120.0)).count() == r["count"]
