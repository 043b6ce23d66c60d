"""Isolation forest: outliers score highest, sample sizes bounded by psi, reproducible."""

import numpy as np

from flowlab.operators import iforest


def test_outliers_rank_first_and_reproducible(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(2000, 2))
    X[:10] = 8.0 + rng.normal(scale=0.1, size=(10, 2))
    rows = [(i, "a" if i % 2 else "b", float(x[0]), float(x[1])) for i, x in enumerate(X)]
    df = spark.createDataFrame(rows, "row_key BIGINT, g STRING, f0 DOUBLE, f1 DOUBLE")
    forest = iforest.fit_isolation_forest(df, ["f0", "f1"], "row_key", "g", n_trees=50, psi=128, seed=3).cache()
    assert forest.groupBy("g", "tree").agg({"sample_size": "max"}).filter("`max(sample_size)` > 128").count() == 0
    assert forest.filter("node = 0 AND sample_size = 128").count() == 100
    s1 = iforest.score_isolation_forest(df, forest, ["f0", "f1"], "row_key", "g", psi=128).toPandas()
    top = set(s1.sort_values("score", ascending=False).head(10)["row_key"])
    assert top == set(range(10))
    f2 = iforest.fit_isolation_forest(df, ["f0", "f1"], "row_key", "g", n_trees=50, psi=128, seed=3)
    s2 = iforest.score_isolation_forest(df, f2, ["f0", "f1"], "row_key", "g", psi=128).toPandas()
    a = s1.set_index("row_key")["score"].sort_index().to_numpy()
    b = s2.set_index("row_key")["score"].sort_index().to_numpy()
    assert np.array_equal(a, b)


def test_c_factor():
    assert iforest.c_factor([1])[0] == 0.0 and iforest.c_factor([2])[0] == 1.0
    assert abs(iforest.c_factor([256])[0] - 10.244770920) < 1e-6


def test_small_group_does_not_blow_up_the_others(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "small" if i < 40 else "large", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(20_040, 2)))]
    rows += [(90_000, "none", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "row_key BIGINT, g STRING, f0 DOUBLE, f1 DOUBLE")
    forest = iforest.fit_isolation_forest(df.filter("g <> 'none'"), ["f0", "f1"], "row_key", "g", n_trees=20, psi=32, seed=1)
    assert forest.filter("node = 0").groupBy("g").count().filter("count = 20").count() == 2
    out = iforest.score_isolation_forest(df, forest, ["f0", "f1"], "row_key", "g", psi=32).collect()
    assert len(out) == len(rows) and [r.row_key for r in out if r.score is None or r.score != r.score] == [90_000]
