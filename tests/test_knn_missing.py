"""One null, NaN or infinite component among many good rows costs only its own row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.operators import knn
from flowlab.operators.smote import smote


def test_bad_components_cost_only_their_row(spark):
    x = np.random.default_rng(4).normal(size=(60, 2)).tolist()
    bad = [(100, None, 0.0), (101, float("nan"), 0.0), (102, 0.0, float("inf")), (103, float("-inf"), None)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(x)] + bad, "row_key long, a double, b double")
    got = {}
    for r in knn.knn_join(df, df, ["a", "b"], 3, exclude_self=True).collect():
        got.setdefault(r["qid"], {})[r["nn_rank"]] = r["rid"]
    want = {i: dict(enumerate([j for _, j in sorted((math.dist(v, w), j) for j, w in enumerate(x) if j != i)[:3]], 1)) for i, v in enumerate(x)}
    assert got == want


def test_smote_balances_with_bad_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(size=2)), 0) for i in range(20)] + [(100 + i, *map(float, rng.normal(size=2)), 1) for i in range(100)]
    for i, bad in enumerate([None, float("nan"), float("inf"), None, None]):
        rows[i] = (i, bad, 0.0, 0)
    df = spark.createDataFrame(rows, "row_key long, a double, b double, binary_target int")
    out = smote(df, ["a", "b"], k=5).cache()
    counts = {(r.binary_target, r.is_synthetic): r["count"] for r in out.groupBy("binary_target", "is_synthetic").count().collect()}
    assert counts == {(0, False): 20, (0, True): 80, (1, False): 100}
    assert all(math.isfinite(r.a) and math.isfinite(r.b) and r.base_key >= 5 and r.nn_key >= 5 for r in out.where("is_synthetic").collect())
    out.unpersist()
    with pytest.raises(ValueError, match="finite"):
        smote(df.where("row_key >= 100 or row_key < 10"), ["a", "b"], k=5)
    with pytest.raises(ValueError, match="null"):
        smote(df.withColumn("binary_target", F.when(F.col("row_key") == 7, None).otherwise(F.col("binary_target"))), ["a", "b"], k=5)
