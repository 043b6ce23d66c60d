"""kNN join equals brute force (ties, duplicates, many blocks); vote rules; SMOTE invariants."""

import numpy as np
import pytest

from flowlab.operators import knn
from flowlab.operators.smote import smote


def _frame(spark, X, y=None, start=0):
    rows = [(start + i, *map(float, x), int(y[i]) if y is not None else 0) for i, x in enumerate(X)]
    cols = ", ".join(f"f{j} DOUBLE" for j in range(X.shape[1]))
    return spark.createDataFrame(rows, f"row_key BIGINT, {cols}, label INT")


def _brute(Q, R, qids, rids, k, exclude_self=False):
    out = {}
    for i, q in enumerate(Q):
        d = np.sqrt(((R - q) ** 2).sum(axis=1))
        cand = [(d[j], rids[j]) for j in range(len(R)) if not (exclude_self and rids[j] == qids[i])]
        cand.sort()
        out[qids[i]] = [r for _, r in cand[:k]]
    return out


def test_knn_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(0)
    R = rng.integers(0, 4, size=(300, 3)).astype(float)  # many exact ties and duplicates
    Q = rng.integers(0, 4, size=(70, 3)).astype(float)
    feats = ["f0", "f1", "f2"]
    refs = _frame(spark, R, start=1000)
    qs = _frame(spark, Q)
    got = knn.knn_join(qs, refs, feats, k=5, block_rows=64).collect()
    g = {}
    for r in sorted(got, key=lambda r: (r.qid, r.nn_rank)):
        g.setdefault(r.qid, []).append(r.rid)
    exp = _brute(Q, R, list(range(70)), list(range(1000, 1300)), 5)
    assert g == exp


def test_knn_self_join_excludes_self(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(120, 4))
    X[5] = X[6]  # exact duplicate pair: distance 0 to the other one
    df = _frame(spark, X)
    got = knn.knn_join(df, df, [f"f{j}" for j in range(4)], k=3, exclude_self=True, block_rows=50).collect()
    assert all(r.qid != r.rid for r in got)
    g = {}
    for r in sorted(got, key=lambda r: (r.qid, r.nn_rank)):
        g.setdefault(r.qid, []).append(r.rid)
    assert g == _brute(X, X, list(range(120)), list(range(120)), 3, exclude_self=True)
    assert g[5][0] == 6


def test_weighted_vote_zero_distance_and_tie(spark):
    neigh = spark.createDataFrame(
        [(1, 10, 0.0, 0), (1, 11, 0.5, 1), (1, 12, 0.6, 1),        # zero distance wins alone
         (2, 20, 1.0, 0), (2, 21, 1.0, 1),                          # equal weights -> smaller label
         (3, 30, 1.0, 1), (3, 31, 2.0, 0), (3, 32, 2.0, 0), (3, 33, 2.0, 0)],  # 1 vs 1.5 -> label 0
        "qid BIGINT, rid BIGINT, dist DOUBLE, label INT")
    got = {r.qid: r.predicted for r in knn.weighted_vote(neigh, "label").collect()}
    assert got == {1: 0, 2: 0, 3: 0}


def test_smote_rows_on_segments_and_balanced(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(40, 3))
    y = np.array([0] * 8 + [1] * 32)
    df = _frame(spark, X, y).withColumnRenamed("label", "binary_target")
    feats = ["f0", "f1", "f2"]
    out = smote(df, feats, "binary_target", "row_key", k=5, seed=7).cache()
    counts = {(r.binary_target, r.is_synthetic): r["count"] for r in out.groupBy("binary_target", "is_synthetic").count().collect()}
    assert counts[(0, False)] + counts[(0, True)] == 32 and counts[(1, False)] == 32
    syn = out.filter("is_synthetic").collect()
    for r in syn:
        base, nn = X[r.base_key], X[r.nn_key]
        assert y[r.base_key] == 0 and y[r.nn_key] == 0 and r.base_key != r.nn_key
        assert 0.0 <= r.step < 1.0
        assert np.allclose([r.f0, r.f1, r.f2], base + r.step * (nn - base))


def test_smote_minimum_class_size(spark):
    X = np.arange(30, dtype=float).reshape(10, 3)
    ok = _frame(spark, X, np.array([0] * 6 + [1] * 4)).withColumnRenamed("label", "binary_target")
    smote(ok, ["f0", "f1", "f2"], "binary_target", "row_key", k=3).count()  # 4 > 3: fine
    bad = _frame(spark, X, np.array([0] * 5 + [1] * 5 + [])).withColumnRenamed("label", "binary_target")
    bad = bad.union(_frame(spark, X[:1] + 100, np.array([0]), start=50).withColumnRenamed("label", "binary_target"))
    with pytest.raises(ValueError):
        smote(bad, ["f0", "f1", "f2"], "binary_target", "row_key", k=5)  # class 1 has 5 rows, k=5


def test_forest_independent_of_input_layout(spark):
    from flowlab.operators import models

    rng = np.random.default_rng(4)
    X = rng.normal(size=(600, 3))
    y = (X[:, 0] + 0.3 * rng.normal(size=600) > 0).astype(int)
    base = _frame(spark, X, y).withColumnRenamed("label", "binary_target")
    feats = ["f0", "f1", "f2"]
    preds = []
    for parts in (2, 7):
        m = models.fit_random_forest(base.repartition(parts), feats, numTrees=10, maxDepth=6)
        p = models.predict(m, base, feats).select("row_key", "predicted").toPandas().sort_values("row_key")
        preds.append(p["predicted"].to_numpy())
    assert np.array_equal(preds[0], preds[1])
    assert (preds[0] == y).mean() > 0.9


@pytest.mark.parametrize("shift", [0.0, 1e6, 1e9])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_knn_equals_brute_force_at_any_offset(spark, exclude_self, shift):
    rng = np.random.default_rng(9)
    R = rng.normal(scale=8.0, size=(500, 3)) + shift
    R[:200] = np.round(R[:200])  # duplicates and exact ties
    Q = R[::3] + (0 if exclude_self else 0.25)
    feats = ["f0", "f1", "f2"]
    refs = _frame(spark, R)
    qs = refs if exclude_self else _frame(spark, Q, start=10_000)
    got = sorted((r.qid, r.nn_rank, r.rid) for r in knn.knn_join(qs, refs, feats, k=5, exclude_self=exclude_self, block_rows=128).collect())
    X = R if exclude_self else Q
    want = []
    for i, x in enumerate(X):
        acc = np.zeros(len(R))
        for f in range(3):
            acc += (x[f] - R[:, f]) * (x[f] - R[:, f])
        order = [j for j in np.lexsort((np.arange(len(R)), np.sqrt(acc))) if not (exclude_self and j == i)][:5]
        want += [(i if exclude_self else 10_000 + i, n + 1, j) for n, j in enumerate(order)]
    assert got == sorted(want)


def test_equal_rows_stay_within_memory():
    import resource

    import pandas as pd

    fn = knn._kernel(["f0", "f1"], 5, False, [], 4096)
    q = pd.DataFrame({"_qid": range(2000), "f0": 1.0, "f1": 2.0})
    r = pd.DataFrame({"_rid": range(50_000), "f0": 1.0, "f1": 2.0})
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = fn(q, r)
    assert len(out) == 10_000 and set(out["rid"]) == set(range(5))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_500_000  # KiB


def test_wide_block_stays_within_memory():
    """A block of 64 features: the kernel holds one tile and the best so far, and blocks are bounded by their bytes."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(1)
    feats = [f"f{j}" for j in range(64)]
    Q, R = rng.normal(size=(5000, 64)), rng.normal(size=(9000, 64))
    q = pd.DataFrame(Q, columns=feats).assign(_qid=np.arange(5000))
    r = pd.DataFrame(R, columns=feats).assign(_rid=np.arange(9000), label=np.arange(9000) % 7)
    tracemalloc.start()
    out = knn._kernel(feats, 5, False, ["label"], 4096)(q, r)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20
    assert len(out) == 25_000 and (out["label"] == out["rid"] % 7).all()
    for i in (0, 1023, 1024, 4999):
        want = np.argsort(((R - Q[i]) ** 2).sum(axis=1), kind="stable")[:5]
        assert out[out["qid"] == i].sort_values("dist")["rid"].tolist() == want.tolist()
    for d, k in ((2, 5), (64, 5), (1000, 5), (4, 4000)):
        nq, nr = knn.block_side(d, k)
        assert nr * d <= knn.BLOCK_VALUES and nq <= nr and (nq * k <= knn.BLOCK_OUT or nq == knn.QUERY_TILE)
