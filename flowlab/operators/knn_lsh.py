"""Approximate k-nearest-neighbour join by bucketed random projections (J9, approximate mode).

The bucket length is set from the distance spread: the exact k-th distances of
a bounded sample of the queries give the reach that a query's neighbours need,
and buckets are that long. Rows meet where a projection puts them into one
bucket; pairs within the reach are ranked per query. Queries with fewer than k
pairs within the reach are joined exactly, so every query gets its k rows.

A bucket holds a share of all rows, so its pairs are not listed: per projection,
the grouped kNN join finds the k nearest references of every query in its
bucket. The k nearest of these are those of all pairs that meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.operators.knn import DEFAULT_BLOCK_ROWS, is_finite, knn_join
from flowlab.operators.models import assemble
from flowlab.session import cut_lineage

SAMPLE = 512  # queries whose exact neighbours set the reach
SHARE = 0.95  # of the sampled k-th distances lie within the reach
TABLES = 3
WIDTH = 0.6  # bucket length in reaches


def sample_reach(queries: DataFrame, refs: DataFrame, features: list[str], k: int, q_key: str, r_key: str, exclude_self: bool = False) -> float:
    """The ``SHARE`` quantile of the k-th distance over the ``SAMPLE`` queries of smallest hash; 0 without any."""
    some = cut_lineage(queries.orderBy(F.xxhash64(q_key), q_key).limit(SAMPLE))
    # few queries: all pairs in blocks just under the size from which cells are built for the whole table
    near = knn_join(some, refs, features, k, q_key, r_key, exclude_self=exclude_self, block_rows=DEFAULT_BLOCK_ROWS - 1)
    last = near.groupBy("qid").agg(F.max("dist").alias("d"))
    return float(last.agg(F.percentile("d", F.lit(SHARE))).first()[0] or 0.0)


def fit_projections(refs: DataFrame, features: list[str], reach: float, tables: int = TABLES, seed: int = 42) -> BucketedRandomProjectionLSHModel:
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=max(WIDTH * reach, 1e-9), numHashTables=tables, seed=seed)
    return lsh.fit(assemble(refs.limit(1), features))  # the projections only need the number of features


def buckets(model: BucketedRandomProjectionLSHModel) -> Column:
    """The buckets of a row that the model has hashed, one of every table."""
    return F.array(*[F.get(vector_to_array(F.get("hashes", F.lit(t))), F.lit(0)) for t in range(model.getNumHashTables())])


def bucket_neighbours(model: BucketedRandomProjectionLSHModel, queries: DataFrame, refs: DataFrame, features: list[str], k: int, exclude_self: bool) -> DataFrame:
    """(qid, rid, dist) of the pairs that meet in a bucket, those of the k nearest references of a query and table among them."""
    def hashed(df: DataFrame, key: str) -> DataFrame:
        out = model.transform(assemble(df.distinct(), features))
        return cut_lineage(out.select(key, *features, buckets(model).alias("_h")))  # read by every table

    q, r = hashed(queries, "qid"), hashed(refs, "rid")
    parts = []
    for t in range(model.getNumHashTables()):
        a, b = (df.withColumn("_bucket", F.get("_h", F.lit(t))).drop("_h") for df in (q, r))
        near = knn_join(a, b, features, k, "qid", "rid", exclude_self=exclude_self, group_col="_bucket")
        parts.append(cut_lineage(near.select("qid", "rid", "dist")))
    return reduce(DataFrame.unionByName, parts).distinct()


def bucket_pairs(model: BucketedRandomProjectionLSHModel, queries: DataFrame, refs: DataFrame, features: list[str]) -> int:
    """How many (query, reference) pairs meet in a bucket, over all tables."""
    def sizes(df: DataFrame, name: str) -> DataFrame:
        hashed = model.transform(assemble(df.select(*features), features))
        return hashed.select(F.posexplode(buckets(model)).alias("t", "h")).groupBy("t", "h").agg(F.count(F.lit(1)).alias(name))

    both = sizes(queries, "a").join(sizes(refs, "b"), ["t", "h"])
    return int(both.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0)


def approx_knn_join(queries: DataFrame, refs: DataFrame, features: list[str], k: int = 5, q_key: str = "row_key", r_key: str = "row_key",
                    exclude_self: bool = False, tables: int = TABLES, seed: int = 42) -> tuple[DataFrame, BucketedRandomProjectionLSHModel | None]:
    """((qid, rid, dist, nn_rank), projections): about the k nearest references of every query.

    Rows with a null, NaN or infinite feature take no part, as in the exact
    join. Where all sampled k-th distances are 0, or there are no queries, the
    exact join does all the work and there are no projections.
    """
    q = cut_lineage(queries.where(is_finite(features)).select(F.col(q_key).cast("bigint").alias("qid"), *[F.col(f).cast("double") for f in features]))
    r = cut_lineage(refs.where(is_finite(features)).select(F.col(r_key).cast("bigint").alias("rid"), *[F.col(f).cast("double") for f in features]))
    reach = sample_reach(q, r, features, k, "qid", "rid", exclude_self)
    if reach <= 0:
        return knn_join(q, r, features, k, "qid", "rid", exclude_self=exclude_self), None
    model = fit_projections(r, features, reach, tables, seed)
    found = bucket_neighbours(model, q, r, features, k, exclude_self).where(F.col("dist") < reach * (1 + 1e-9))
    best = Window.partitionBy("qid").orderBy("dist", "rid")
    found = cut_lineage(found.withColumn("nn_rank", F.row_number().over(best)).where(F.col("nn_rank") <= k))
    full = found.where(F.col("nn_rank") == k).select("qid")
    rest = knn_join(q.join(full, "qid", "left_anti"), r, features, k, "qid", "rid", exclude_self=exclude_self)
    return found.join(full, "qid", "left_semi").select("qid", "rid", "dist", "nn_rank").unionByName(rest.select("qid", "rid", "dist", "nn_rank")), model


def recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (exact_pairs, found_pairs, recall): share of the exact pairs that the approximate join found.

    A pair at the distance of the exact k-th neighbour counts as found: it is as near.
    """
    last = exact.groupBy("qid").agg(F.max("dist").alias("far"), F.count(F.lit(1)).alias("n"))
    hits = approx.join(last, "qid").where(F.col("dist") <= F.col("far") * (1 + 1e-9) + 1e-12).groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    total = last.join(hits, "qid", "left").agg(F.sum("n").alias("exact_pairs"), F.sum(F.least(F.coalesce("hits", F.lit(0)), F.col("n"))).alias("found_pairs"))
    return total.withColumn("recall", F.col("found_pairs") / F.col("exact_pairs"))
