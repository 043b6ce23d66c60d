"""Feature ranking and selection.

Importance score (stand-in for forest impurity importance where a SQL twin is
wanted): the share of a feature's variance explained by the class means,
sum_c n_c (mean_c - mean)^2 / (n var). It is computed from sufficient
statistics (count, mean, squared deviations per class) gathered in one grouped
pass, so per-fold scores for leave-one-group-out are "all minus one group":
no rescans, no replicated rows. Tree importances from Spark ML are exposed by
``flowlab.operators.models``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.functions.exprs import stacked

META_COLUMNS = ["binary_label", "binary_target", "source_file"]


def class_stats(df: DataFrame, features: list[str], label_col: str, classes: list[int],
                group_cols: list[str] | None = None) -> DataFrame:
    """(group..., feature, source_column_index, n<c>, m<c>, v<c> per class): count, mean and squared deviations.

    One pass with centred moments, so features with a large mean lose no
    digits; the output is small.
    """
    aggs = []
    for c in classes:
        is_c = F.col(label_col) == F.lit(c)
        for i, f in enumerate(features):
            x = F.when(is_c, F.col(f).cast("double"))
            aggs += [F.count(x).cast("double").alias(f"n{c}_{i}"), F.coalesce(F.avg(x), F.lit(0.0)).alias(f"m{c}_{i}"),
                     F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias(f"v{c}_{i}")]
    wide = df.groupBy(*(group_cols or [])).agg(*aggs)
    return stacked(wide, [[F.lit(f).alias("feature"), F.lit(i).alias("source_column_index"),
                           *[F.col(f"{k}{c}_{i}").alias(f"{k}{c}") for c in classes for k in ("n", "m", "v")]]
                          for i, f in enumerate(features)], group_cols)


def importance_expr(classes: list[int]) -> Column:
    """Between-class share of the squared deviations."""
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    n = add([F.col(f"n{c}") for c in classes])
    mean = add([F.col(f"n{c}") * F.col(f"m{c}") for c in classes]) / n
    between = add([F.col(f"n{c}") * (F.col(f"m{c}") - mean) * (F.col(f"m{c}") - mean) for c in classes])
    total = between + add([F.col(f"v{c}") for c in classes])
    return F.when((n > 0) & (total > 0), between / total).otherwise(F.lit(0.0))


def feature_importance(df: DataFrame, features: list[str], label_col: str = "binary_target",
                       classes: list[int] | None = None) -> DataFrame:
    classes = classes or [0, 1]
    st = class_stats(df, features, label_col, classes)
    return st.select("feature", "source_column_index", importance_expr(classes).alias("importance"))


def rank_features(importance: DataFrame, group_cols: list[str] | None = None, top_n: int | None = None) -> DataFrame:
    """W1 (+ W2 flag): 1-based rank by importance desc, ties by source column index."""
    group_cols = group_cols or []
    w = Window.partitionBy(*group_cols).orderBy(F.desc("importance"), F.asc("source_column_index"))
    out = importance.withColumn("rank", F.row_number().over(w))
    if top_n is not None:
        out = out.withColumn("selected", F.col("rank") <= top_n)
    return out


def holdout_importance(df: DataFrame, features: list[str], label_col: str, fold_col: str,
                       classes: list[int] | None = None) -> DataFrame:
    """Per fold (held-out value of ``fold_col``): importance over all rows except that fold."""
    classes = classes or [0, 1]
    per = class_stats(df, features, label_col, classes, [fold_col])
    w = Window.partitionBy("feature")
    cols = []
    for c in classes:
        n, m, v = F.col(f"n{c}"), F.col(f"m{c}"), F.col(f"v{c}")
        n_all = F.sum(n).over(w)
        mean = F.coalesce(F.try_divide(F.sum(n * m).over(w), n_all), F.lit(0.0))
        v_all = F.sum(v).over(w)
        cols += [n_all.alias(f"all_n{c}"), mean.alias(f"all_m{c}"), v_all.alias(f"all_v{c}")]
    j = per.select("*", *cols)
    for c in classes:  # deviations of the fold means from the overall mean complete the total
        d = F.col(f"m{c}") - F.col(f"all_m{c}")
        j = j.withColumn(f"all_v{c}", F.col(f"all_v{c}") + F.sum(F.col(f"n{c}") * d * d).over(w))
    rest = []
    for c in classes:
        n, m, v = F.col(f"all_n{c}") - F.col(f"n{c}"), F.col(f"m{c}"), F.col(f"v{c}")
        mean = F.coalesce(F.try_divide(F.col(f"all_n{c}") * F.col(f"all_m{c}") - F.col(f"n{c}") * m, n), F.lit(0.0))
        moved = F.coalesce(F.try_divide(F.col(f"n{c}") * n, F.col(f"all_n{c}")), F.lit(0.0)) * (m - mean) * (m - mean)
        rest += [n.alias(f"n{c}"), mean.alias(f"m{c}"),
                 F.when(n > 0, F.greatest(F.col(f"all_v{c}") - v - moved, F.lit(0.0))).otherwise(0.0).alias(f"v{c}")]
    rest = j.select(F.col(fold_col).alias("fold"), "feature", "source_column_index", *rest)
    return rest.select("fold", "feature", "source_column_index", importance_expr(classes).alias("importance"))


def select_top(df: DataFrame, ranked: list[str], canonical: list[str], n: int, order: str = "canonical",
               keep: list[str] | None = None) -> DataFrame:
    """Keep metadata columns plus the top-n features, in canonical or rank order."""
    keep = keep or []
    top = ranked[:n]
    cols = [c for c in canonical if c in set(top)] if order == "canonical" else top
    return df.select(*keep, *cols)


def feature_stability(fold_ranks: DataFrame, top_n: int) -> DataFrame:
    """Per feature, folds where it was selected, mean / best / worst rank."""
    sel = fold_ranks.filter(F.col("rank") <= top_n)
    return sel.groupBy("feature").agg(F.count_distinct("fold").alias("folds_selected"),
                                      F.avg("rank").alias("mean_rank"), F.min("rank").alias("best_rank"),
                                      F.max("rank").alias("worst_rank"))


def rank_pivot(fold_ranks: DataFrame, folds: list, top_n: int) -> DataFrame:
    """rows = rank, columns = fold, cell = feature name."""
    sel = fold_ranks.filter(F.col("rank") <= top_n)
    return sel.groupBy("rank").pivot("fold", folds).agg(F.first("feature"))
