"""Leave-one-group-out in one plan (M8, M9, X9): the fold is a join key, not a loop.

Every row is a query in the fold that holds its group out and a reference in
all other folds. The scaler of a fold follows from per-group moments: total
minus the held-out group, one pass over the rows. One grouped kNN join serves
all folds; its plan does not grow with the number of groups. Large joins go by
cells of the unscaled features, so that one copy of the references serves all
folds.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.operators import knn
from flowlab.operators.cells import Scaler, cells_join, group_key
from flowlab.session import broadcast_if_small, cut_lineage


def fold_scalers(df: DataFrame, features: list[str], fold_col: str) -> DataFrame:
    """(fold, test_rows, train_rows, m<i>, s<i>): mean and population std of feature i over all rows outside the fold.

    Null features do not count. A std of 0 (or no rows) becomes 1, a mean
    without rows 0. A null group is a fold like any other. Sums are centred:
    deviations of a group from its own mean, and of the group means.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        aggs += [F.count(x).cast("double").alias(f"c{i}"), F.coalesce(F.avg(x), F.lit(0.0)).alias(f"m{i}"),
                 F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias(f"v{i}")]
    per = df.groupBy(F.col(fold_col).alias("fold")).agg(*aggs)
    every = Window.partitionBy()  # one row per group
    for i in range(len(features)):
        c, m = F.col(f"c{i}"), F.col(f"m{i}")
        per = per.withColumns({f"C{i}_": F.sum(c).over(every), f"M{i}_": F.try_divide(F.sum(c * m).over(every), F.sum(c).over(every))})
        off = m - F.col(f"M{i}_")
        per = per.withColumn(f"V{i}_", F.sum(F.col(f"v{i}") + c * off * off).over(every))
    out = []
    for i in range(len(features)):
        c, m, total, mean = F.col(f"c{i}"), F.col(f"m{i}"), F.col(f"C{i}_"), F.col(f"M{i}_")
        rest = total - c
        centre = F.coalesce(F.try_divide(total * mean - c * m, rest), F.lit(0.0))
        moved = F.coalesce(F.try_divide(c * rest, total), F.lit(0.0)) * (m - centre) * (m - centre)
        std = F.sqrt(F.greatest(F.coalesce(F.try_divide(F.col(f"V{i}_") - F.col(f"v{i}") - moved, rest), F.lit(0.0)), F.lit(0.0)))
        out += [centre.alias(f"m{i}"), F.when(std > 0, std).otherwise(1.0).alias(f"s{i}")]
    return per.select("fold", F.col("n").alias("test_rows"), (F.sum("n").over(every) - F.col("n")).alias("train_rows"), *out)


def holdout_knn(df: DataFrame, features: list[str], fold_col: str, label_col: str = "binary_target", key_col: str = "row_key",
                k: int = 5, folds: list | None = None, selected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(predictions (fold, key, actual, predicted), scalers): kNN of every row on the rows of all other groups.

    ``folds`` limits the held-out groups (the others are references in every
    fold). ``selected`` (fold, feature) limits the features of a fold; a feature
    that is not selected is 0 on both sides. Rows with a null, NaN or infinite
    feature get a null prediction and are nobody's reference.
    """
    # the narrow rows are stored once: the moments, both sides of the join and the result read them
    rows = cut_lineage(df.select(F.col(fold_col).alias("_own"), F.col(key_col), F.col(label_col).alias("actual"), *features))
    scalers = cut_lineage(fold_scalers(rows, features, "_own"))  # one row per group
    ids = [r[0] for r in scalers.select("fold").collect()]
    kind = df.schema[fold_col].dataType
    wanted = F.array(*[F.lit(v).cast(kind) for v in ids if folds is None or v in folds]).cast(f"array<{kind.simpleString()}>")
    params = scalers
    if selected is not None:
        uses = [F.max((F.col("feature") == f).cast("int")).alias(f"w{i}") for i, f in enumerate(features)]
        chosen = selected.groupBy(F.col("fold").alias("_sel")).agg(*uses)
        params = scalers.join(chosen, F.col("fold").eqNullSafe(F.col("_sel"))).drop("_sel")
    params = broadcast_if_small(params.withColumnRenamed("fold", "_fold"))

    def scaled(part: DataFrame) -> DataFrame:
        joined = part.join(params, F.col("fold").eqNullSafe(F.col("_fold")))
        cols = []
        for i, f in enumerate(features):
            z = (F.col(f).cast("float").cast("double") - F.col(f"m{i}")) / F.col(f"s{i}")
            cols.append((F.when(F.col(f"w{i}") == 1, z).otherwise(0.0) if selected is not None else z).alias(f))
        return joined.select("fold", key_col, "actual", *cols)

    queries = scaled(rows.withColumn("fold", F.col("_own")).where(F.exists(wanted, lambda v: v.eqNullSafe(F.col("_own")))))
    refs = scaled(rows.withColumn("fold", F.explode(F.filter(wanted, lambda v: ~v.eqNullSafe(F.col("_own"))))))
    sizes = scalers.where("train_rows > 0").select(F.col("fold").alias("_g"), F.col("test_rows").alias("nq"), F.col("train_rows").alias("nr"))
    pairs = sizes.agg(F.sum(F.col("nq").cast("double") * F.col("nr"))).first()[0] or 0
    used = _used_features(params, features, selected is not None)
    if pairs > knn.CELL_PAIRS and all(0 < len(u) <= knn.CELL_DIMS for u in used):
        neigh = _cells_of_folds(rows.where(F.exists(wanted, lambda v: v.eqNullSafe(F.col("_own")))), rows, key_col, used, k)
    else:
        neigh = knn.knn_join(queries, refs, features, k, key_col, key_col, carry=["actual"], group_col="fold", group_sizes=sizes)
    votes = knn.weighted_vote(neigh, "actual", ["fold"]).withColumnsRenamed({"fold": "_vf", "qid": "_vq"})
    asked = queries.select("fold", F.col(key_col), "actual")
    pred = asked.join(votes, F.col("fold").eqNullSafe(F.col("_vf")) & (F.col(key_col) == F.col("_vq")), "left")
    return pred.select("fold", key_col, "actual", "predicted"), scalers


def _used_features(params: DataFrame, features: list[str], selected: bool) -> dict[tuple[str, ...], dict[str, Scaler]]:
    """The scalers of the folds (fold as text) by the features that the folds use."""
    used: dict[tuple[str, ...], dict[str, Scaler]] = {}
    for p in params.withColumn("_gk", group_key(F.col("_fold"))).collect():  # one row per group
        at = [i for i in range(len(features)) if not selected or p[f"w{i}"] == 1]
        scaler = Scaler(np.array([p[f"m{i}"] for i in at]), np.array([p[f"s{i}"] for i in at]))
        used.setdefault(tuple(features[i] for i in at), {})[p["_gk"]] = scaler
    return used


def _cells_of_folds(queries: DataFrame, refs: DataFrame, key_col: str, used: dict[tuple[str, ...], dict[str, Scaler]], k: int) -> DataFrame:
    """The k nearest rows outside the own group of every row, by cells: (fold, qid, rid, dist, actual, nn_rank)."""
    parts = []
    for cols, scalers in used.items():  # one join for the folds that use the same features
        def side(df: DataFrame, key: str, *more: str) -> DataFrame:
            x = [F.col(f).cast("float").cast("double").alias(f) for f in cols]
            return df.select(F.col(key_col).cast("bigint").alias(key), group_key(F.col("_own")).alias("_gk"), *more, *x).where(knn.is_finite(list(cols)))

        q = side(queries.withColumn("_g", F.col("_own")), "_qid", "_g")
        if len(used) > 1:
            q = q.where(F.col("_gk").isin(list(scalers)))
        parts.append(cells_join(q, side(refs, "_rid", "actual"), list(cols), k, False, ["actual"], knn.tile_kernel(len(cols), k, False), scalers))
    return knn.ranked(reduce(DataFrame.unionByName, parts), k, "fold")


def fold_counts(pred: DataFrame, scalers: DataFrame) -> DataFrame:
    """(fold, tn, fp, fn, tp, test_rows, train_rows) of the predictions, one row per fold that was held out."""
    a, p = F.col("actual"), F.col("predicted")
    cells = pred.groupBy("fold").agg(*[F.count_if((a == i) & (p == j)).alias(n) for n, i, j in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])
    sizes = scalers.select(F.col("fold").alias("_fold"), "test_rows", "train_rows")
    return cells.join(sizes, F.col("fold").eqNullSafe(F.col("_fold"))).drop("_fold")
