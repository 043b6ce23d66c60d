"""SMOTE oversampling (M5, U3), train rows only.

For every class c below the largest class count, ``need = n_max - n_c``
synthetic rows are made. Synthetic row j draws u1(j), u2(j) (seeded md5):
r = floor(u1 * n_c * k), base = r div k (dense index of a minority row),
slot = r mod k + 1 (its slot-th nearest other minority row), and the new row
is x_base + u2 * (x_nn - x_base). ``spark.range(need)`` drives the work in
parallel; everything else is equi-joins on integer keys, so nothing depends
on one task holding a class. Requires n_c > k (as the reference library).

Rows with a null, NaN or infinite feature stay in the output but are neither
bases nor neighbours: n_c of the draws counts the others, and these must be
more than k. The classes still end up equal in size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.functions.rand import uniform52
from flowlab.operators.knn import is_finite, knn_join
from flowlab.operators.position import positions_within


def smote(train: DataFrame, features: list[str], label_col: str = "binary_target", key_col: str = "row_key",
          k: int = 5, seed: int = 42, keep_original: bool = True) -> DataFrame:
    """Balanced train set: originals (is_synthetic=false, syn_id null) + synthetic rows.

    Output columns: key_col, syn_id, label_col, is_synthetic, base_key, nn_key, step, *features.
    """
    spark = train.sparkSession
    sizes = train.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_finite(features)).alias("n_finite"))
    counts = {r[0]: (r["n"], r["n_finite"]) for r in sizes.collect()}  # one row per class
    if None in counts:
        raise ValueError("SMOTE needs a class for every row; some labels are null")
    n_max = max((n for n, _ in counts.values()), default=0)
    parts = []
    if keep_original:
        parts.append(train.select(
            F.col(key_col).cast("bigint").alias(key_col), F.lit(None).cast("bigint").alias("syn_id"),
            F.col(label_col), F.lit(False).alias("is_synthetic"), F.lit(None).cast("bigint").alias("base_key"),
            F.lit(None).cast("bigint").alias("nn_key"), F.lit(None).cast("double").alias("step"),
            *[F.col(f).cast("double").alias(f) for f in features]))
    for cls in sorted(counts):
        need, n_c = n_max - counts[cls][0], counts[cls][1]
        if need <= 0:
            continue
        if n_c <= k:
            raise ValueError(f"SMOTE needs more than k={k} rows with finite features in class {cls!r}; found {n_c}")
        mino = train.filter((F.col(label_col) == F.lit(cls)) & is_finite(features)).select(
            F.col(key_col).cast("bigint").alias("_key"), *[F.col(f).cast("double").alias(f) for f in features])
        idx = positions_within(mino, [], ["_key"], pos_col="_pos")
        neigh = knn_join(mino, mino, features, k, "_key", "_key", exclude_self=True)
        salt = f"smote:{cls}"
        synth = spark.range(need).select(
            F.col("id").alias("syn_id"),
            F.floor(uniform52(seed, salt + ":base", "id") * F.lit(n_c) * F.lit(k)).cast("bigint").alias("_r"),
            uniform52(seed, salt + ":step", "id").alias("step"))
        synth = synth.select("syn_id", "step", F.floor(F.col("_r") / k).cast("bigint").alias("_pos"),
                             (F.col("_r") % k + 1).cast("int").alias("nn_rank"))
        base = idx.select("_pos", F.col("_key").alias("base_key"), *[F.col(f).alias("_b_" + f) for f in features])
        nn = neigh.select(F.col("qid").alias("base_key"), "nn_rank", F.col("rid").alias("nn_key"))
        other = mino.select(F.col("_key").alias("nn_key"), *[F.col(f).alias("_n_" + f) for f in features])
        made = synth.join(base, "_pos").join(nn, ["base_key", "nn_rank"]).join(other, "nn_key")
        parts.append(made.select(
            F.lit(None).cast("bigint").alias(key_col), "syn_id", F.lit(cls).cast(train.schema[label_col].dataType)
            .alias(label_col), F.lit(True).alias("is_synthetic"), "base_key", "nn_key", "step",
            *[(F.col("_b_" + f) + F.col("step") * (F.col("_n_" + f) - F.col("_b_" + f))).alias(f) for f in features]))
    if not parts:
        raise ValueError("SMOTE has nothing to return: no rows, or no originals asked for and no class below the largest")
    return reduce(DataFrame.unionByName, parts)
