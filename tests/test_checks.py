"""Every check turns false where it should."""

import pytest
from pyspark.sql import functions as F

from flowlab.operators import checks
from flowlab.operators import metrics as met


@pytest.fixture()
def run(spark):
    data = spark.range(200).selectExpr("id as row_key", "cast(id % 4 = 0 as int) binary_target", "if(id % 5 = 0, 'test', 'train') split")
    pred = data.where("split = 'test'").withColumn("predicted", F.when(F.col("row_key") % 7 == 0, 1 - F.col("binary_target")).otherwise(F.col("binary_target")))
    report = checks.reported_metrics(met.classification_report(pred, "binary_target", "predicted", met.BINARY_NAMES))
    balanced = data.where("split = 'train'").withColumn("binary_target", (F.col("row_key") % 2).cast("int"))
    return {"inputs": data, "split": data, "pred": pred, "reported": report, "balanced": balanced}


def failed(run, **change):
    return {r["check"] for r in checks.run_checks(**{**run, **change}).collect() if not r["passed"]}


def test_a_right_run_passes(run):
    assert failed(run) == set()
    assert len(checks.run_checks(**run).collect()) == 12


def test_each_run_check_can_fail(run):
    split, pred, rep = run["split"], run["pred"], run["reported"]
    assert failed(run, split=split.where("row_key <> 1")) == {"split_rows_agree"}
    assert failed(run, split=split.withColumn("split", F.when(F.col("row_key") == 1, None).otherwise(F.col("split")))) == {"split_rows_agree"}
    assert "confusion_covers_test_rows" in failed(run, pred=pred.where("row_key <> 5"))
    assert "every_test_row_predicted" in failed(run, pred=pred.withColumn("predicted", F.when(F.col("row_key") == 5, None).otherwise(F.col("predicted"))))
    assert "predictions_binary" in failed(run, pred=pred.withColumn("predicted", F.when(F.col("row_key") == 5, 2).otherwise(F.col("predicted"))))
    swapped = pred.withColumn("binary_target", F.when(F.col("row_key").isin(0, 5), 1 - F.col("binary_target")).otherwise(F.col("binary_target")))
    assert "test_labels_unchanged" in failed(run, pred=swapped)
    for name in ("accuracy", "precision", "recall", "f1"):
        assert failed(run, reported=rep.withColumn(name, F.col(name) + 1e-9)) == {f"{name}_follows_from_counts"}
    assert failed(run, reported=rep.withColumn("benign_support", F.col("benign_support") - 1)) == {"benign_support_agrees"}
    assert failed(run, reported=rep.withColumn("attack_support", F.lit(0))) == {"attack_support_agrees"}
    assert failed(run, balanced=run["balanced"].where("row_key <> 3")) == {"classes_balanced_after_smote"}


def test_cross_run_checks_can_fail(spark):
    rows = [("all_features", 4, "a b c d", 80, "s", "h", 5, 1, 2, 12), ("top2", 2, "a b", 80, "s", "h", 4, 2, 1, 13), ("top2_smote", 2, "a b", 120, "s", "h", 5, 1, 4, 10)]
    kind = "config string, n_features int, features string, train_rows long, test_source string, test_labels string, tn long, fp long, fn long, tp long"

    def bad(i=None, **change):
        names = [c.split()[0] for c in kind.split(", ")]
        some = [tuple(change.get(n, v) if j == i else v for n, v in zip(names, r)) for j, r in enumerate(rows)]
        return {r["check"] for r in checks.cross_run_checks(spark.createDataFrame(some, kind), 4, 2).collect() if not r["passed"]}

    assert bad() == set()
    assert bad(2, features="b a") == {"top_runs_share_features_and_order"}
    assert bad(1, features="a a") == {"top_runs_share_features_and_order", "features_are_as_many_as_counted"}
    assert bad(0, test_source="t") == {"one_test_source"} and bad(1, test_labels="g") == {"same_test_labels"}
    assert bad(1, tn=5, fp=2) == {"same_test_rows"} and bad(1, tn=3, fn=2) == {"same_test_attack_rows"}
    assert bad(2, train_rows=80) == {"smote_run_has_more_train_rows"} and "feature_counts" in bad(1, n_features=4)


def test_fold_checks_can_fail(spark):
    kind = "fold int, selected string, tn long, fp long, fn long, tp long, test_rows long, train_rows long, train_folds array<int>"
    rows = [(1, "a b", 2, 1, 1, 6, 10, 20, [2, 3]), (2, "b c", 5, 0, 0, 5, 10, 20, [1, 3]), (3, "a c", 1, 1, 1, 7, 10, 20, [1, 2])]
    groups = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "fold int, n long")

    def bad(records):
        out = checks.fold_checks(spark.createDataFrame(records, kind), groups, ["a", "b", "c"], 2).collect()
        assert len(out) == 18
        return {(r["fold"], r["check"]) for r in out if not r["passed"]}

    assert bad(rows) == set()
    assert {c for f, c in bad(rows[:2]) if f == 3} >= {"fold_was_run", "confusion_covers_group"}
    assert bad([(1, "a a", *rows[0][2:]), *rows[1:]]) == {(1, "features_distinct")}
    assert bad([(1, "a z", *rows[0][2:]), *rows[1:]]) == {(1, "features_known")}
    assert bad([(1, "a b", 9, *rows[0][3:]), *rows[1:]]) == {(1, "confusion_covers_group")}
    assert bad([(*rows[0][:8], [1, 2, 3]), *rows[1:]]) == {(1, "held_out_not_in_train")}
    assert bad([(*rows[0][:7], 19, [2, 3]), *rows[1:]]) == {(1, "train_and_test_are_all_rows")}
