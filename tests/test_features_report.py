"""Fold importance by subtraction equals direct computation; multiclass report equals NumPy."""

import numpy as np
from pyspark.sql import functions as F

from flowlab.operators import features as feat
from flowlab.operators import metrics as met


def test_holdout_importance_equals_direct(spark):
    rng = np.random.default_rng(6)
    n = 900
    g = rng.integers(1, 5, n)
    y = rng.integers(0, 2, n)
    X = rng.normal(size=(n, 3)) + y[:, None] * np.array([1.0, 0.2, 0.0])
    rows = [(i, int(g[i]), int(y[i]), *map(float, X[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "row_key BIGINT, grp INT, binary_target INT, a DOUBLE, b DOUBLE, c DOUBLE")
    fold = {(r.fold, r.feature): r.importance for r in
            feat.holdout_importance(df, ["a", "b", "c"], "binary_target", "grp").collect()}
    for k in range(1, 5):
        direct = {r.feature: r.importance for r in
                  feat.feature_importance(df.filter(F.col("grp") != k), ["a", "b", "c"]).collect()}
        for f, v in direct.items():
            assert abs(fold[(k, f)] - v) < 1e-9 * max(1.0, abs(v))
    ranked = feat.rank_features(feat.feature_importance(df, ["a", "b", "c"]), top_n=1).collect()
    assert [r.feature for r in sorted(ranked, key=lambda r: r.rank)][0] == "a"


def test_multiclass_report_equals_numpy(spark):
    rng = np.random.default_rng(8)
    a = rng.integers(0, 4, 500)
    p = np.where(rng.random(500) < 0.6, a, rng.integers(0, 5, 500))  # label 4 only ever predicted
    df = spark.createDataFrame([(int(x), int(z)) for x, z in zip(a, p)], "actual INT, predicted INT")
    rep = {r["class"]: r for r in met.classification_report(df).collect()}
    labels = sorted(set(a) | set(p))
    prec, rec, f1, sup = [], [], [], []
    for c in labels:
        tp = int(((a == c) & (p == c)).sum())
        pp, s = int((p == c).sum()), int((a == c).sum())
        pr = tp / pp if pp else 0.0
        rc = tp / s if s else 0.0
        ff = 2 * pr * rc / (pr + rc) if pr + rc else 0.0
        prec.append(pr), rec.append(rc), f1.append(ff), sup.append(s)
        r = rep[str(c)]
        assert np.allclose((r.precision, r.recall, r.f1), (pr, rc, ff), rtol=1e-14) and r.support == s
    assert np.isclose(rep["macro avg"].f1, np.mean(f1), rtol=1e-14)
    assert np.isclose(rep["weighted avg"].recall, np.dot(rec, sup) / np.sum(sup), rtol=1e-14)
    assert np.isclose(rep["accuracy"].f1, (a == p).mean(), rtol=1e-14)
