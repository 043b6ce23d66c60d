"""The join by cells against blocks of all pairs, which other tests hold against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.operators import cells, folds, knn


@pytest.fixture(autouse=True)
def small_cells(monkeypatch):
    monkeypatch.setattr(cells, "LEAF_ROWS", 64)
    monkeypatch.setattr(cells, "QUERY_ROWS", 100)


def table(spark, n, seed, shift=0.0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n) * 8, rng.integers(0, 12, n), rng.lognormal(size=n) + shift]).astype("float32").astype(float)
    x[: n // 8] = np.round(x[: n // 8])  # ties
    x[n // 8: n // 4] = [1.0, 2.0, 3.0 + shift]  # one point that many rows share
    rows = [(i, "xxxxy"[i % 5] if i % 11 else None, *map(float, v), int(rng.integers(0, 2))) for i, v in enumerate(x)]
    rows[5] = (5, "x", None, 0.0, 0.0, 1)
    rows[6] = (6, "x", float("nan"), 0.0, 0.0, 1)
    rows += rows[40:60]  # rows that come twice
    return spark.createDataFrame(rows, "row_key long, g string, a double, b double, c double, label int").repartition(4)


def both(monkeypatch, run):
    out = []
    for limit in (1e18, 0):
        monkeypatch.setattr(knn, "CELL_PAIRS", limit)
        df = run()
        plan = df._jdf.queryExecution().toString()
        assert ("_far" in plan) == (limit == 0)
        out.append(sorted(map(str, df.collect())))
    assert out[0] == out[1] and out[0]


@pytest.mark.parametrize("shift", [0.0, 1e6])
@pytest.mark.parametrize("group", [None, "g"])
def test_other_rows(spark, monkeypatch, group, shift):
    refs, queries = table(spark, 2400, 1, shift), table(spark, 700, 2, shift)
    both(monkeypatch, lambda: knn.knn_join(queries, refs, ["a", "b", "c"], 5, carry=["label"], group_col=group).drop("label"))


@pytest.mark.parametrize("group", [None, "g"])
def test_the_own_row_is_left_out(spark, monkeypatch, group):
    refs = table(spark, 1500, 3)
    both(monkeypatch, lambda: knn.knn_join(refs, refs, ["a", "b", "c"], 5, exclude_self=True, group_col=group))


def test_few_references_and_none(spark, monkeypatch):
    refs, queries = table(spark, 1200, 4), table(spark, 100, 5).dropDuplicates(["row_key"])
    both(monkeypatch, lambda: knn.knn_join(queries, refs.where("row_key < 3"), ["a", "b"], 5))
    monkeypatch.setattr(knn, "CELL_PAIRS", -1)
    assert knn.knn_join(queries, refs.limit(0), ["a", "b"], 5).count() == 0
    assert knn.knn_join(queries.limit(0), refs, ["a", "b"], 5).count() == 0


@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("chosen", [None, "same", "own"])
def test_folds(spark, monkeypatch, chosen, apart):
    rows = table(spark, 1600, 6)
    if apart:  # most cells hold one group only
        rows = rows.withColumn("a", F.col("a") + F.when(F.col("g") == "x", 1000.0).when(F.col("g") == "y", -500.0).otherwise(0.0))
    picks = {"same": [(g, f) for g in ("x", "y", None) for f in "ab"], "own": [("x", "a"), ("x", "b"), ("y", "a"), (None, "b"), (None, "c")]}
    selected = spark.createDataFrame(picks[chosen], "fold string, feature string") if chosen else None
    both(monkeypatch, lambda: folds.holdout_knn(rows, ["a", "b", "c"], "g", "label", selected=selected)[0])


def test_work_grows_with_the_rows(spark, monkeypatch):
    """A query meets a few cells, not all references."""
    monkeypatch.setattr(knn, "CELL_PAIRS", 0)
    met = []
    for n in (2000, 8000):
        df = spark.range(n).select(F.col("id").alias("row_key"), F.rand(1).alias("a"), F.rand(2).alias("b"))
        seen = spark.sparkContext.accumulator(0)

        def kernel(d, k, exclude_self, plain=knn.tile_kernel, seen=seen):
            best = plain(d, k, exclude_self)

            def counted(q, qid, r, rid, centre):
                seen.add(len(q) * len(r))
                return best(q, qid, r, rid, centre)
            return counted

        with monkeypatch.context() as m:
            m.setattr(knn, "tile_kernel", kernel)
            assert knn.knn_join(df, df, ["a", "b"], 3, exclude_self=True).count() == 3 * n
        met.append(seen.value)
    assert met[1] < 6 * met[0] and met[1] < 8000 * 8000 / 10
