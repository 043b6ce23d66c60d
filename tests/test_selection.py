"""Exact order statistics, quantiles and the ordered cut against sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.operators import selection, split as sp


def test_kth_values_equal_sorting(spark, monkeypatch):
    monkeypatch.setattr(selection, "BINS", 16)  # several passes
    rng = np.random.default_rng(0)
    groups = {
        "normal": rng.normal(size=700), "heavy": np.exp(rng.normal(scale=9, size=700)), "few": rng.integers(0, 3, 700).astype(float),
        "one": np.array([5.0]), "same": np.full(50, -2.5), "wide": np.array([-1.7e308, 1.7e308, 0.0, 1e-300, -1e-300, 5.0]),
        "infinite": np.array([float("-inf"), 1.0, 2.0, 3.0]), None: rng.normal(size=40) * 1e12}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("normal", None), ("few", float("nan")), ("empty", None)]
    wants, want = [], {}
    for g, xs in groups.items():
        for need in sorted({1, 2, len(xs) // 3 + 1, len(xs)}):
            if need <= len(xs):
                wants.append((f"{g}/{need}", g, need))
                v = float(np.sort(xs)[need - 1])
                want[f"{g}/{need}"] = (v, need - int((xs < v).sum()))
    wants += [("beyond", "one", 2), ("below", "one", 0), ("none", "empty", 1)]
    got = selection.kth_values(spark.createDataFrame(rows, "g string, x double").repartition(5), spark.createDataFrame(wants, "w string, g string, need long"))
    assert {r["w"]: (r["value"], r["rest"]) for r in got.collect()} == want


def test_kth_values_of_large_integers(spark, monkeypatch):
    x = [2**60 + i * 7 for i in range(500)] + [2**60] * 3  # doubles cannot tell these apart
    df = spark.createDataFrame([("g", v) for v in x], "g string, x long")
    monkeypatch.setattr(selection, "MAX_PASSES", 6)
    got = selection.kth_values(df, spark.createDataFrame([(n, "g", n) for n in (1, 3, 250, 503)], "w int, g string, need int"))
    assert {r["w"]: r["value"] for r in got.collect()} == {n: sorted(x)[n - 1] for n in (1, 3, 250, 503)}


def test_quantiles_are_exact_beyond_a_sketch(spark):
    df = spark.range(1_500_000).select(((F.col("id") * 7919) % 1_500_000).cast("double").alias("a"), F.exp((F.col("id") % 1000) / 50.0).alias("b"),
                                       F.lit(None).cast("double").alias("c"))
    got = {(r["feature"], r["prob"]): r["value"] for r in selection.exact_quantiles(df, ["a", "b", "c"], (0.0, 0.25, 0.5, 0.999999, 1.0)).collect()}
    assert [got["a", p] for p in (0.0, 0.25, 0.5, 0.999999, 1.0)] == [0.0, 374_999.0, 749_999.0, 1_499_998.0, 1_499_999.0]
    assert got["b", 0.5] == pytest.approx(np.exp(499 / 50.0)) and got["c", 0.5] is None and len(got) == 15


def test_ordered_cut_equals_ordered_split(spark):
    rng = np.random.default_rng(1)
    rows = [(i, ["hot", "hot", "hot", "b", None][i % 5], int(rng.integers(0, 40)) if i % 11 else None) for i in rng.permutation(600).tolist()]
    rows += [(1000, "single", 3), (1001, "ties", 9), (1002, "ties", 9), (1003, "ties", 9), (1004, "ties", 9), (1005, "ties", 9)]
    df = spark.createDataFrame(rows, "row_key long, source_file string, t int").withColumn("ts", F.timestamp_seconds("t")).repartition(4)
    want = {r["row_key"]: r["split"] for r in sp.ordered_split(df, "source_file", ["ts", "row_key"], 0.8).collect()}
    cut = sp.ordered_cut(df, "source_file", "ts", "row_key", 0.8)
    assert cut.columns == [*df.columns, "split"] and {r["row_key"]: r["split"] for r in cut.collect()} == want
    by_number = sp.ordered_cut(df, "source_file", "t", "row_key", 0.8)
    assert {r["row_key"]: r["split"] for r in by_number.collect()} == want
    assert sp.ordered_cut(df.limit(0)).count() == 0
    plan = cut._jdf.queryExecution().executedPlan().toString()  # the rows are neither stored, sorted nor shuffled
    assert "hashpartitioning" not in plan.split("RoundRobin")[0] and "rangepartitioning" not in plan and "Sort" not in plan


def test_null_class_has_its_own_quota(spark):
    df = spark.range(100).select(F.col("id").alias("row_key"), F.when(F.col("id") < 30, F.lit(None).cast("int")).otherwise((F.col("id") % 2).cast("int")).alias("binary_target"))
    got = {(r["binary_target"], r["split"]): r["count"] for r in sp.stratified_split(df).groupBy("binary_target", "split").count().collect()}
    assert got == {(None, "test"): 6, (None, "train"): 24, (0, "test"): 7, (0, "train"): 28, (1, "test"): 7, (1, "train"): 28}
