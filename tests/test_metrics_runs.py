"""Metrics with zero division and absent classes; AUC vs brute force; run summaries and change arithmetic."""

import math

import numpy as np
from pyspark.sql import functions as F

from flowlab.operators import metrics as met
from flowlab.operators import runs


def test_zero_division_and_absent_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "actual INT, predicted INT")  # no positive predicted
    m = met.binary_metrics(df).first()
    assert (m.tn, m.fp, m.fn, m.tp) == (2, 0, 1, 0)
    assert m.precision == 0.0 and m.recall == 0.0 and m.f1 == 0.0
    assert math.isclose(m.accuracy, 2 / 3, rel_tol=1e-15)
    rep = {r["class"]: r for r in met.classification_report(df, names=met.BINARY_NAMES).collect()}
    assert rep["attack"].precision == 0.0 and rep["attack"].support == 1
    assert math.isclose(rep["accuracy"].f1, 2 / 3, rel_tol=1e-15)


def test_confusion_long_zero_filled(spark):
    df = spark.createDataFrame([(1, 1)], "actual INT, predicted INT")
    cells = {(r.actual, r.predicted): r.n for r in met.confusion_long(df).collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 1}


def _auc_brute(y, s):
    pos = [si for yi, si in zip(y, s) if yi == 1]
    neg = [si for yi, si in zip(y, s) if yi == 0]
    num = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return num / (len(pos) * len(neg))


def _ap_brute(y, s):
    order = sorted(set(s), reverse=True)
    P = sum(y)
    ap, prev_r = 0.0, 0.0
    for t in order:
        tp = sum(1 for yi, si in zip(y, s) if si >= t and yi == 1)
        fp = sum(1 for yi, si in zip(y, s) if si >= t and yi == 0)
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


def test_auc_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400).tolist()
    s = (np.round(rng.random(400), 2)).tolist()  # many ties
    df = spark.createDataFrame(list(zip(y, s)), "actual INT, score DOUBLE")
    r = met.roc_pr_auc(df).first()
    assert math.isclose(r.roc_auc, _auc_brute(y, s), abs_tol=1e-12)
    assert math.isclose(r.pr_auc, _ap_brute(y, s), abs_tol=1e-12)


def test_summary_rules_one_and_three_runs(spark):
    long = spark.createDataFrame([("a", 1, "t", 5.0), ("b", 1, "t", 1.0), ("b", 2, "t", 2.0), ("b", 3, "t", 4.0)],
                                 "experiment STRING, run INT, metric STRING, value DOUBLE")
    pop = {r.experiment: r for r in runs.summary_pop(long, ["experiment", "metric"]).collect()}
    assert pop["a"].std == 0.0 and pop["a"].mean == 5.0
    assert math.isclose(pop["b"].std, np.std([1, 2, 4]), rel_tol=1e-12)
    smp = {r.experiment: r for r in runs.summary_sample(long, ["experiment", "metric"], "run").collect()}
    assert smp["a"].run_values == [5.0] and smp["b"].run_values == [1.0, 2.0, 4.0]
    none = runs.summary_sample(long.withColumn("value", F.lit(None).cast("double")), ["experiment"], "run").first()
    assert (none.n, none.reported_value, none.reported_value_kind, none.run_values) == (0, None, runs.NOT_MEASURED, [])
    assert smp["a"].reported_value_kind == "single_measured_run" and smp["a"].mean is None
    assert smp["a"].standard_deviation is None and smp["a"].reported_value == 5.0
    assert math.isclose(smp["b"].standard_deviation, np.std([1, 2, 4], ddof=1), rel_tol=1e-12)


def test_direction_change_golden(spark):
    # published comparison: training time 256.461498 s -> 104.741095 s
    df = spark.createDataFrame([(256.46149799996056, 104.74109458294697), (115.0, 20.0), (0.0, 1.0), (2.0, 2.0)],
                               "ref DOUBLE, cmp DOUBLE")
    cols = runs.direction_change(F.col("ref"), F.col("cmp"))
    rows = df.select(*[v.alias(k) for k, v in cols.items()]).collect()
    assert math.isclose(rows[0].signed_percent_change, -59.15913484098768, rel_tol=1e-12)
    assert rows[0].direction == "reduction" and math.isclose(rows[0].reduction_percent, 59.15913484098768)
    assert math.isclose(rows[1].reduction_percent, 82.6086956521739) and rows[1].increase_percent is None
    assert rows[2].signed_percent_change is None and rows[2].direction == "increase"
    assert rows[3].direction == "no_change" and rows[3].reduction_percent == 0.0


def test_fingerprint_order_free(spark):
    a = spark.createDataFrame([(i, i % 2) for i in range(100)], "k BIGINT, y INT")
    b = a.orderBy(F.desc("k")).repartition(5)
    fa, fb = runs.fingerprint(a, "k", "y").first(), runs.fingerprint(b, "k", "y").first()
    assert fa == fb
    c = a.withColumn("y", F.when(F.col("k") == 3, 0).otherwise(F.col("y")))
    assert runs.fingerprint(c, "k", "y").first() != fa
