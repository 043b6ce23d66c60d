"""V1 / V2 / V5: checks of a run and across runs, as (check, passed) rows that can fail.

The measures of a run come from the tables it worked on; what it reports comes
from outside (a stored result, or another way of computing it), so a wrong
report, a lost row or a touched label turns a check false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.functions.exprs import safe_ratio, stacked
from flowlab.operators import metrics as met
from flowlab.operators import runs as runs_op
from flowlab.operators.quality import checks_table

CLOSE = 1e-12  # reported ratios may differ from the counts by so much


def _measures(df: DataFrame, **named: Column) -> DataFrame:
    wide = df.agg(*[expr.cast("double").alias(k) for k, expr in named.items()])  # one aggregation per frame
    return stacked(wide, [[F.lit(k).alias("measure"), F.col(k).alias("value")] for k in named])


def run_checks(inputs: DataFrame, split: DataFrame, pred: DataFrame, reported: DataFrame, balanced: DataFrame | None = None,
               key_col: str = "row_key", label_col: str = "binary_target", predicted_col: str = "predicted") -> DataFrame:
    """V1 for one binary run.

    ``inputs``: rows before the split; ``split``: rows with their split; ``pred``:
    test rows with label and prediction; ``reported``: one row with accuracy,
    precision, recall, f1, benign_support, attack_support as the run reports them;
    ``balanced``: the rows the model was fitted on after oversampling.
    """
    test = split.where(F.col("split") == "test")
    counts = met.confusion_counts(pred, label_col, predicted_col)
    tn, fp, fn, tp = (F.first(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    prints = [runs_op.ordered_digest(df, [key_col], label_col).select(F.lit(n).alias("stage"), "digest", "rows")
              for n, df in (("test", test), ("pred", pred))]
    frames = [
        _measures(inputs, input_rows=F.count(F.lit(1))),
        _measures(split, split_rows=F.count(F.lit(1)), outside=F.count_if(~F.coalesce(F.col("split").isin("train", "test"), F.lit(False)))),
        _measures(test, test_rows=F.count(F.lit(1)), test_benign=F.count_if(F.col(label_col) == 0), test_attack=F.count_if(F.col(label_col) == 1)),
        _measures(counts, c_total=tn + fp + fn + tp, c_benign=tn + fp, c_attack=fn + tp, c_accuracy=safe_ratio(tp + tn, tn + fp + fn + tp),
                  c_precision=safe_ratio(tp, tp + fp), c_recall=safe_ratio(tp, tp + fn), c_f1=safe_ratio(2 * tp, 2 * tp + fp + fn)),
        _measures(pred, unpredicted=F.count_if(F.col(predicted_col).isNull()), non_binary=F.count_if(~F.col(predicted_col).isin(0, 1))),
        _measures(reduce(DataFrame.union, prints), digests=F.count_distinct("digest")),
        _measures(reported, **{f"r_{c}": F.first(c) for c in ("accuracy", "precision", "recall", "f1", "benign_support", "attack_support")}),
    ]
    names = ["input_rows", "split_rows", "outside", "test_rows", "test_benign", "test_attack", "c_total", "c_benign", "c_attack", "c_accuracy", "c_precision",
             "c_recall", "c_f1", "unpredicted", "non_binary", "digests", "r_accuracy", "r_precision", "r_recall", "r_f1", "r_benign_support", "r_attack_support"]
    if balanced is not None:
        sizes = balanced.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
        frames.append(_measures(sizes, least=F.min("n"), most=F.max("n")))
        names += ["least", "most"]
    one = reduce(DataFrame.unionByName, frames).groupBy().pivot("measure", names).agg(F.first("value"))
    c = F.col
    near = lambda name: F.coalesce(F.abs(c(f"c_{name}") - c(f"r_{name}")) <= CLOSE, F.lit(False))
    named = {
        "split_rows_agree": (c("input_rows") == c("split_rows")) & (c("outside") == 0),
        "confusion_covers_test_rows": c("c_total") == c("test_rows"),
        "benign_support_agrees": (c("c_benign") == c("test_benign")) & (c("r_benign_support") == c("test_benign")),
        "attack_support_agrees": (c("c_attack") == c("test_attack")) & (c("r_attack_support") == c("test_attack")),
        "test_labels_unchanged": c("digests") == 1,
        "every_test_row_predicted": c("unpredicted") == 0,
        "predictions_binary": c("non_binary") == 0,
        **{f"{n}_follows_from_counts": near(n) for n in ("accuracy", "precision", "recall", "f1")},
    }
    if balanced is not None:
        named["classes_balanced_after_smote"] = c("least") == c("most")
    return stacked(one, [[F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("passed")] for k, v in named.items()])


def reported_metrics(report: DataFrame) -> DataFrame:
    """The row :func:`run_checks` takes as reported, from a classification report with the classes benign and attack."""
    at = lambda cls, col: F.max(F.when(F.col("class") == cls, F.col(col)))
    return report.agg(at("accuracy", "f1").alias("accuracy"), at("attack", "precision").alias("precision"), at("attack", "recall").alias("recall"),
                      at("attack", "f1").alias("f1"), F.coalesce(at("benign", "support"), F.lit(0)).alias("benign_support"),
                      F.coalesce(at("attack", "support"), F.lit(0)).alias("attack_support"))


def cross_run_checks(runs: DataFrame, n_all: int, n_top: int) -> DataFrame:
    """V2 over run records (config, n_features, features, train_rows, test_source, test_labels, tn, fp, fn, tp).

    ``features``: the model's columns in order, joined by spaces; ``test_labels``: a digest of the test labels.
    """
    full, smote = F.col("config") == "all_features", F.col("config").endswith("_smote")
    return checks_table({
        "three_runs": F.count(F.lit(1)) == 3,
        "feature_counts": (F.count_if(full & (F.col("n_features") == n_all)) == 1) & (F.count_if(~full & (F.col("n_features") == n_top)) == 2),
        "features_are_as_many_as_counted": F.count_if(F.size(F.array_distinct(F.split("features", " "))) != F.col("n_features")) == 0,
        "top_runs_share_features_and_order": F.count_distinct(F.when(~full, F.col("features"))) == 1,
        "one_test_source": F.count_distinct("test_source") == 1,
        "same_test_labels": F.count_distinct("test_labels") == 1,
        "same_test_rows": F.count_distinct(F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")) == 1,
        "same_test_attack_rows": F.count_distinct(F.col("fn") + F.col("tp")) == 1,
        "smote_run_has_more_train_rows": F.max(F.when(smote, F.col("train_rows"))) > F.max(F.when(full, F.col("train_rows"))),
    }, runs)


def fold_checks(folds: DataFrame, expected: DataFrame, features: list[str], top_n: int) -> DataFrame:
    """V5: (fold, check, passed) over fold records (fold, selected, tn, fp, fn, tp, test_rows, train_rows, train_folds).

    ``expected``: one row (fold, n) per group that must be held out; ``train_folds``: the groups the fold trained on.
    """
    names = F.split("selected", " ")
    known = F.array(*[F.lit(f) for f in features])
    j = expected.select(F.col("fold").alias("_e"), "n").join(folds, F.col("_e").eqNullSafe(F.col("fold")), "full_outer")
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    named = {
        "fold_was_run": F.col("fold").isNotNull() & F.col("n").isNotNull(),
        "confusion_covers_group": total == F.col("n"),
        "features_distinct": (F.size(F.array_distinct(names)) == top_n) & (F.size(names) == top_n),
        "features_known": F.size(F.array_except(names, known)) == 0,
        "held_out_not_in_train": ~F.array_contains("train_folds", F.col("_e")),
        "train_and_test_are_all_rows": F.col("train_rows") + F.col("test_rows") == F.sum("n").over(Window.partitionBy()),
    }
    return stacked(j.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in named.items()}),
                   [[F.lit(k).alias("check"), F.col(k).alias("passed")] for k in named], keep=["_e"]).withColumnRenamed("_e", "fold")
