"""Approximate kNN join: recall against the exact one, few pairs, an exact way for queries that find too little."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlab.operators import knn, knn_lsh


def clustered(spark, rng, n, start=0):
    centre = rng.normal(scale=20, size=(40, 3))
    x = centre[rng.integers(0, 40, n)] + rng.normal(size=(n, 3))
    return spark.createDataFrame([(start + i, *map(float, v)) for i, v in enumerate(x)], "row_key long, a double, b double, c double")


def test_recall_and_pairs(spark):
    rng = np.random.default_rng(0)
    refs, queries = clustered(spark, rng, 4000), clustered(spark, np.random.default_rng(0), 400, 10_000)
    feats = ["a", "b", "c"]
    approx, model = knn_lsh.approx_knn_join(queries, refs, feats, 5)
    exact = knn.knn_join(queries, refs, feats, 5)
    out = knn_lsh.recall(approx, exact).first()
    assert out["exact_pairs"] == 2000 and out["recall"] >= 0.9
    assert approx.groupBy("qid").count().where("count = 5").count() == 400
    assert knn_lsh.bucket_pairs(model, queries, refs, feats) < 0.2 * 400 * 4000
    true = {(r["qid"], r["rid"]): r["dist"] for r in knn.knn_join(queries, refs, feats, 4000).where("qid < 10010").collect()}
    assert all(abs(true[r["qid"], r["rid"]] - r["dist"]) < 1e-9 for r in approx.where("qid < 10010").collect())


def test_far_queries_equal_rows_and_bad_rows(spark):
    rng = np.random.default_rng(2)
    refs = clustered(spark, rng, 600)
    far = spark.createDataFrame([(9000, 500.0, 0.0, 0.0), (9001, None, 0.0, 0.0), (9002, float("nan"), 0.0, 0.0)], refs.schema)
    approx, _ = knn_lsh.approx_knn_join(refs.unionByName(far), refs, ["a", "b", "c"], 3, exclude_self=True)
    n = {r["qid"]: r["count"] for r in approx.groupBy("qid").count().collect()}
    assert n == {**{i: 3 for i in range(600)}, 9000: 3}
    got = sorted(r["rid"] for r in approx.where("qid = 9000").collect())
    assert got == sorted(r["rid"] for r in knn.knn_join(far, refs, ["a", "b", "c"], 3).where("qid = 9000").collect())
    same = refs.withColumns({c: F.lit(1.0) for c in "abc"})
    approx, model = knn_lsh.approx_knn_join(same, same, ["a", "b", "c"], 2, exclude_self=True)
    assert model is None and approx.count() == 1200
    assert knn_lsh.approx_knn_join(refs.limit(0), refs, ["a"], 2)[0].count() == 0


def test_a_full_bucket_lists_no_pairs(spark):
    rng = np.random.default_rng(5)
    refs, queries = clustered(spark, rng, 3000), clustered(spark, np.random.default_rng(6), 300, 10_000)
    feats = ["a", "b", "c"]
    model = knn_lsh.fit_projections(refs, feats, 40.0)
    met, reach = knn_lsh.bucket_pairs(model, queries, refs, feats), 8.0
    q, r = queries.withColumnRenamed("row_key", "qid"), refs.withColumnRenamed("row_key", "rid")
    listed = knn_lsh.bucket_neighbours(model, q.unionByName(q), r.unionByName(r), feats, 4, False)  # rows that come twice count once
    assert listed.count() <= 300 * 4 * knn_lsh.TABLES < met / 10
    pairs = model.approxSimilarityJoin(knn_lsh.assemble(q, feats), knn_lsh.assemble(r, feats), reach, "dist")
    best = lambda df: {(x["qid"], x["rid"]): x["dist"] for x in df.withColumn("rank", F.row_number().over(
        Window.partitionBy("qid").orderBy("dist", "rid"))).where("rank <= 4").collect()}
    want = best(pairs.select("datasetA.qid", "datasetB.rid", "dist"))
    assert want and best(listed.where(F.col("dist") < reach)) == want
