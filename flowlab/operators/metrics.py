"""Evaluation over a (truth, prediction) pair on the same row.

Every metric is computed from one small aggregation (counts per
(actual, predicted) cell); ratios use try_divide with 0 for an empty
denominator (zero_division = 0). Nothing is rounded here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.functions.exprs import safe_ratio
from flowlab.session import cut_lineage

# Fixed class names of the binary task, in label order 0, 1.
BINARY_NAMES = {0: "benign", 1: "attack"}


def confusion_counts(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """A5 (wide): one row tn, fp, fn, tp over labels [0, 1] (absent cells are 0)."""
    a, p = F.col(actual), F.col(predicted)
    return df.agg(
        F.count_if((a == 0) & (p == 0)).alias("tn"),
        F.count_if((a == 0) & (p == 1)).alias("fp"),
        F.count_if((a == 1) & (p == 0)).alias("fn"),
        F.count_if((a == 1) & (p == 1)).alias("tp"),
    )


def confusion_long(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                   group_cols: list[str] | None = None) -> DataFrame:
    """A5 (long): (actual, predicted, n) over the fixed grid [0,1] x [0,1]."""
    group_cols = group_cols or []
    a, p = F.col(actual), F.col(predicted)
    wide = df.groupBy(*group_cols).agg(*[
        F.count_if((a == i) & (p == j)).alias(f"c{i}{j}") for i in (0, 1) for j in (0, 1)])
    stack = "stack(4, 0, 0, c00, 0, 1, c01, 1, 0, c10, 1, 1, c11) AS (actual, predicted, n)"
    return wide.selectExpr(*group_cols, stack)


def metrics_from_counts(counts: DataFrame) -> DataFrame:
    """A6 from tn/fp/fn/tp columns: accuracy, attack precision/recall/F1, benign recall."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    prec = safe_ratio(tp, tp + fp)
    rec = safe_ratio(tp, tp + fn)
    f1 = safe_ratio(2 * tp, 2 * tp + fp + fn)
    prec0 = safe_ratio(tn, tn + fn)
    rec0 = safe_ratio(tn, tn + fp)
    f10 = safe_ratio(2 * tn, 2 * tn + fn + fp)
    return counts.withColumns({
        "n_rows": total,
        "accuracy": safe_ratio(tp + tn, total),
        "precision": prec,
        "recall": rec,
        "f1": f1,
        "benign_precision": prec0,
        "benign_recall": rec0,
        "benign_f1": f10,
        "macro_precision": (prec + prec0) / 2,
        "macro_recall": (rec + rec0) / 2,
        "macro_f1": (f1 + f10) / 2,
        "false_positive_rate": safe_ratio(fp, fp + tn),
    })


def binary_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                   group_cols: list[str] | None = None) -> DataFrame:
    """A5 + A6 + A7 (+ FPR of X6) in one aggregation; optionally per group (per fold)."""
    group_cols = group_cols or []
    a, p = F.col(actual), F.col(predicted)
    counts = df.groupBy(*group_cols).agg(
        F.count_if((a == 0) & (p == 0)).alias("tn"),
        F.count_if((a == 0) & (p == 1)).alias("fp"),
        F.count_if((a == 1) & (p == 0)).alias("fn"),
        F.count_if((a == 1) & (p == 1)).alias("tp"))
    return metrics_from_counts(counts)


def classification_report(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                          names: dict | None = None) -> DataFrame:
    """Per-class precision, recall, F1, support + accuracy, macro and weighted rows.

    Works for any label set; the classes are the union of actual and predicted
    labels. Computed from the (actual, predicted) cell counts (at most L^2 rows).
    """
    cells = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    cells = cut_lineage(cells)  # at most L^2 rows, read three times
    sup = cells.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("support"))
    pred = cells.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("predicted_n"))
    hit = cells.filter(F.col("a") == F.col("p")).select(F.col("a").alias("label"), F.col("n").alias("tp"))
    per = (sup.join(pred, "label", "full_outer").join(hit, "label", "left")
           .select("label",
                   F.coalesce("support", F.lit(0)).cast("bigint").alias("support"),
                   F.coalesce("predicted_n", F.lit(0)).cast("bigint").alias("predicted_n"),
                   F.coalesce("tp", F.lit(0)).cast("bigint").alias("tp")))
    per = per.withColumns({
        "precision": safe_ratio("tp", "predicted_n"),
        "recall": safe_ratio("tp", "support"),
    }).withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    if names:
        name_expr = F.coalesce(F.element_at(F.create_map(*[x for k, v in names.items()
                                                            for x in (F.lit(k), F.lit(v))]), F.col("label")),
                               F.col("label").cast("string"))
    else:
        name_expr = F.col("label").cast("string")
    per = cut_lineage(per.withColumn("class", name_expr))
    totals = per.agg(F.sum("support").alias("N"), F.sum("tp").alias("hits"), F.count(F.lit(1)).alias("L"),
                     F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                     safe_ratio(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
                     safe_ratio(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
                     safe_ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"))
    rows = [
        per.select("class", F.col("label").cast("int").alias("label"), F.col("precision").alias("precision"),
                   F.col("recall").alias("recall"), F.col("f1").alias("f1"), "support"),
        totals.select(F.lit("accuracy").alias("class"), F.lit(None).cast("int").alias("label"),
                      F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"),
                      safe_ratio("hits", "N").alias("f1"), F.col("N").cast("bigint").alias("support")),
        totals.select(F.lit("macro avg").alias("class"), F.lit(None).cast("int").alias("label"),
                      F.col("mp").alias("precision"), F.col("mr").alias("recall"), F.col("mf").alias("f1"),
                      F.col("N").cast("bigint").alias("support")),
        totals.select(F.lit("weighted avg").alias("class"), F.lit(None).cast("int").alias("label"),
                      F.col("wp").alias("precision"), F.col("wr").alias("recall"), F.col("wf").alias("f1"),
                      F.col("N").cast("bigint").alias("support")),
    ]
    return reduce(DataFrame.unionByName, rows)


def pooled_metrics(fold_counts: DataFrame) -> DataFrame:
    """Sum tn/fp/fn/tp over folds, then ratios; plus the mean of per-fold metrics
    (unrounded)."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    acc = safe_ratio(tp + tn, tn + fp + fn + tp)
    f1 = safe_ratio(2 * tp, 2 * tp + fp + fn)
    f10 = safe_ratio(2 * tn, 2 * tn + fn + fp)
    pooled = fold_counts.agg(*[F.sum(c).cast("bigint").alias(c) for c in ("tn", "fp", "fn", "tp")],
                             F.avg(acc).alias("mean_fold_accuracy"),
                             F.avg(safe_ratio(tp, tp + fn)).alias("mean_fold_recall"),
                             F.avg(safe_ratio(tn, tn + fp)).alias("mean_fold_benign_recall"),
                             F.avg((f1 + f10) / 2).alias("mean_fold_macro_f1"),
                             F.count(F.lit(1)).alias("n_folds"))
    return metrics_from_counts(pooled)


def hardest_groups(fold_metrics: DataFrame, group_col: str, k: int = 3) -> DataFrame:
    """K lowest attack recall (tie: most FN) and k lowest benign recall (tie: most FP)."""
    w_a = Window.orderBy(F.asc("recall"), F.desc("fn"), F.asc(group_col))
    w_b = Window.orderBy(F.asc("benign_recall"), F.desc("fp"), F.asc(group_col))
    a = (fold_metrics.withColumn("rank", F.row_number().over(w_a)).filter(F.col("rank") <= k)
         .select(F.lit("attack_recall").alias("criterion"), "rank", group_col,
                 F.col("recall").alias("recall_value"), F.col("fn").alias("errors")))
    b = (fold_metrics.withColumn("rank", F.row_number().over(w_b)).filter(F.col("rank") <= k)
         .select(F.lit("benign_recall").alias("criterion"), "rank", group_col,
                 F.col("benign_recall").alias("recall_value"), F.col("fp").alias("errors")))
    return a.unionByName(b)


def roc_pr_auc(scored: DataFrame, actual: str = "actual", score: str = "score") -> DataFrame:
    """Exact ROC-AUC (rank-sum, ties count one half) and PR-AUC (average precision).

    Rows are first aggregated per distinct score; running totals over the
    distinct scores come from :func:`flowlab.operators.position.running_totals`
    (range-partitioned, no single-task window).
    """
    from flowlab.operators.position import running_totals

    # one row per distinct score; stored once so the totals and the running sums do not
    # recompute the scoring plan (e.g. a kNN join) behind it
    per = cut_lineage(scored.groupBy(F.col(score).alias("_s")).agg(
        F.count_if(F.col(actual) == 1).cast("double").alias("npos"),
        F.count_if(F.col(actual) == 0).cast("double").alias("nneg")))
    cum = running_totals(per, "_s", ["npos", "nneg"])
    tot = per.agg(F.sum("npos").alias("P"), F.sum("nneg").alias("N"))
    tot_row = tot.first()
    P, N = float(tot_row["P"] or 0.0), float(tot_row["N"] or 0.0)
    tp = F.lit(P) - F.col("below_npos")
    fp = F.lit(N) - F.col("below_nneg")
    agg = cum.agg(
        F.sum(F.col("npos") * (F.col("below_nneg") + 0.5 * F.col("nneg"))).alias("_auc_num"),
        F.sum(F.col("npos") * tp / (tp + fp)).alias("_ap_num"),
        F.count(F.lit(1)).alias("distinct_scores"))
    return agg.select(
        F.lit(int(P)).cast("bigint").alias("positives"), F.lit(int(N)).cast("bigint").alias("negatives"),
        "distinct_scores",
        F.try_divide(F.col("_auc_num"), F.lit(P * N)).alias("roc_auc"),
        F.try_divide(F.col("_ap_num"), F.lit(P)).alias("pr_auc"))
