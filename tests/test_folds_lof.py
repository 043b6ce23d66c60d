"""Grouped kNN, all folds in one plan, and LOF against reference rows, against brute force."""

import numpy as np
import pytest

from flowlab.operators import folds, knn


def rows_of(rng, n, groups):
    return [(i, groups[i % len(groups)], float(rng.normal()), float(rng.integers(0, 4)), int(rng.integers(0, 2))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_key long, device string, a double, b double, binary_target int")


def nearest(q, refs, k, skip=None):
    d = sorted((float(np.sqrt((q[2] - r[2]) ** 2 + (q[3] - r[3]) ** 2)), r[0]) for r in refs if r[0] != skip)
    return d[:k]


@pytest.mark.parametrize("block", [16, 4096])
def test_grouped_join_equals_brute_force(spark, block):
    rng = np.random.default_rng(0)
    rows = rows_of(rng, 240, ["x", "x", "x", "x", "x", "y", None])  # one group holds most of the rows
    df = frame(spark, rows)
    got = {}
    for r in knn.knn_join(df, df, ["a", "b"], 3, exclude_self=True, group_col="device", block_rows=block).collect():
        got.setdefault((r["device"], r["qid"]), {})[r["nn_rank"]] = (r["rid"], round(r["dist"], 9))
    want = {}
    for q in rows:
        best = nearest(q, [r for r in rows if r[1] == q[1]], 3, q[0])
        want[q[1], q[0]] = {n + 1: (j, round(d, 9)) for n, (d, j) in enumerate(best)}
    assert got == want


def test_a_group_with_most_rows_is_cut_into_blocks(spark):
    df = spark.range(3000).selectExpr("id as row_key", "if(id < 2700, 'hot', 'cold') as _g", "cast(id as double) a")
    plan, pairs = knn.group_blocks(df, df, 4, 256)
    blocks = {r["_g"]: (r["bq"], r["br"]) for r in plan.collect()}
    assert blocks == {"hot": (11, 11), "cold": (2, 2)} and pairs == 125


def test_folds_equal_a_loop_over_groups(spark):
    rng = np.random.default_rng(3)
    rows = rows_of(rng, 160, ["p", "q", "q", "q", None])
    rows[7] = (7, "p", None, 1.0, 1)
    pred, scalers = folds.holdout_knn(frame(spark, rows), ["a", "b"], "device", k=3)
    got = {(r["fold"], r["row_key"]): r["predicted"] for r in pred.collect()}
    sizes = {r["fold"]: (r["test_rows"], r["train_rows"], r["m0"], r["s0"]) for r in scalers.collect()}
    assert len(got) == 160 and got["p", 7 if rows[7][1] == "p" else 0] is None
    for g in ("p", "q", None):
        train, test = [r for r in rows if r[1] != g], [r for r in rows if r[1] == g]
        x = np.array([[np.nan if v is None else np.float32(v) for v in r[2:4]] for r in train], float)
        raw = np.array([[np.nan if v is None else v for v in r[2:4]] for r in train], float)
        mean, std = np.nanmean(raw, 0), np.nanstd(raw, 0)
        assert sizes[g][:2] == (len(test), len(train)) and np.allclose(sizes[g][2:], (mean[0], std[0]))
        z = (x - mean) / std
        for t in test:
            if t[2] is None:
                assert got[g, t[0]] is None
                continue
            d = np.sqrt(((z - (np.array([np.float32(t[2]), np.float32(t[3])], float) - mean) / std) ** 2).sum(1))
            best = [i for i in np.lexsort(([r[0] for r in train], d)) if not np.isnan(d[i])][:3]
            zero = [i for i in best if d[i] == 0]
            weight = {0: 0.0, 1: 0.0}
            for i in zero or best:
                weight[train[i][4]] += 1.0 if zero else 1 / d[i]
            assert got[g, t[0]] == (1 if weight[1] > weight[0] else 0)


def test_selected_features_and_some_folds(spark):
    rng = np.random.default_rng(5)
    df = frame(spark, rows_of(rng, 120, ["p", "q", "r"]))
    chosen = spark.createDataFrame([("p", "a"), ("q", "b"), ("r", "a")], "fold string, feature string")
    pred, scalers = folds.holdout_knn(df, ["a", "b"], "device", k=3, folds=["p", "q"], selected=chosen)
    alone = {f: folds.holdout_knn(df, [c], "device", k=3, folds=[f])[0] for f, c in (("p", "a"), ("q", "b"))}
    want = {(r["fold"], r["row_key"]): r["predicted"] for f in alone.values() for r in f.collect()}
    assert {(r["fold"], r["row_key"]): r["predicted"] for r in pred.collect()} == want
    counts = {r["fold"]: r for r in folds.fold_counts(pred, scalers).collect()}
    assert set(counts) == {"p", "q"} and all(r.tn + r.fp + r.fn + r.tp == r.test_rows == 40 and r.train_rows == 80 for r in counts.values())


def test_fold_plan_does_not_grow_with_the_groups(spark):
    def nodes(n):
        df = spark.range(400).selectExpr("id as row_key", f"id % {n} as device", "cast(id as double) a", "cast(id * id % 17 as double) b", "cast(id % 2 as int) binary_target")
        pred, _ = folds.holdout_knn(df, ["a", "b"], "device", k=2)
        return pred._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert nodes(3) == nodes(12)


def plain_lof(refs, queries, k):
    far, dens = {}, {}
    near = {r[0]: nearest(r, [x for x in refs if x[1] == r[1]], k, r[0]) for r in refs}
    far = {i: d[-1][0] for i, d in near.items() if d}
    lrd = lambda ds: (lambda m: 1 / m if m > 0 else float("inf"))(float(np.mean([max(far[j], d) for d, j in ds])))
    dens = {i: lrd(d) for i, d in near.items() if d}
    out = {}
    for q in queries:
        ds = [] if q[2] is None else nearest(q, [x for x in refs if x[1] == q[1]], k, q[0])
        ds = [x for x in ds if x[1] in far]
        if not ds:
            out[q[0]] = None
            continue
        own, around = lrd(ds), float(np.mean([dens[j] for _, j in ds]))
        inf = float("inf")
        out[q[0]] = 1.0 if own == around == inf else 0.0 if own == inf else around / own
    return out


def test_lof_of_reference_rows_per_group(spark):
    rng = np.random.default_rng(8)
    rows = rows_of(rng, 150, ["p", "p", "p", "q", None])
    rows += [(500 + i, "same", 1.0, 2.0, 0) for i in range(8)] + [(600, "same", 1.0, 2.0, 1), (601, "same", 9.0, 2.0, 1), (602, "q", None, 0.0, 1), (603, "alone", 1.0, 1.0, 1)]
    refs, k = [r for r in rows if r[4] == 0], 4
    df = frame(spark, rows)
    got = {r["row_key"]: r["lof"] for r in knn.novelty_lof(df.where("binary_target = 0"), df, ["a", "b"], k, group_col="device").collect()}
    want = plain_lof(refs, rows, k)
    assert set(got) == set(want)
    for i, v in want.items():
        assert got[i] is None if v is None else got[i] == pytest.approx(v, rel=1e-9)
    assert got[500] == got[600] == 1.0 and got[601] == float("inf") and got[602] is None and got[603] is None


def test_lof_of_equal_rows_is_a_number(spark):
    df = spark.createDataFrame([(i, 1.0, 1.0) for i in range(10)] + [(50, 1.0, 2.0), (51, None, 2.0)], "row_key long, a double, b double")
    got = {r["row_key"]: r["lof"] for r in knn.local_outlier_factor(df, ["a", "b"], 3).collect()}
    assert [got[i] for i in range(10)] == [1.0] * 10 and got[50] == float("inf") and got[51] is None
