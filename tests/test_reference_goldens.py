"""Published leave-one-device-out results of the reference: per-fold counts -> its reported metrics."""

import pytest

from flowlab.operators import metrics as met

# The reference's published per-fold confusion counts (held-out device: tn, fp, fn, tp)
# and its reported attack/benign metrics for the same folds.
FOLD_COUNTS = {
    1: (49548, 0, 0, 968750),
    2: (13112, 1, 0, 822763),
    3: (39082, 18, 0, 316400),
    4: (175220, 20, 0, 923437),
    5: (62154, 0, 20, 766086),
    6: (98509, 5, 0, 738377),
    7: (52144, 6, 0, 323072),
    8: (46176, 409, 1, 816470),
    9: (19524, 4, 10, 831288),
}
REPORTED = {  # accuracy, attack precision, attack recall, attack F1, benign precision, benign recall, benign F1, macro F1
    2: (0.9999988036503022, 0.999998784584644, 1.0, 0.9999993922919527, 1.0, 0.9999237398001983, 0.9999618684461392,
        0.9999806303690459),
    5: (0.9999758529930215, 1.0, 0.9999738939520119, 0.9999869468056223, 0.9996783221282208, 1.0, 0.9998391351907857,
        0.999913040998204),
    8: (0.9995249439202091, 0.9994993138518679, 0.9999987752167561, 0.9997489821532434, 0.9999783441973277,
        0.9912203498980359, 0.9955800866734223, 0.9976645344133328),
    9: (0.9999835454017625, 0.9999951882130467, 0.9999879706194409, 0.9999915794032203, 0.9994880720794512,
        0.9997951659156084, 0.9996415954124213, 0.9998165874078208),
}
POOLED = {"accuracy": 0.999930, "recall": 0.999995, "benign_recall": 0.999167, "fp": 463, "fn": 31,
          "mean_fold_accuracy": 0.999932, "mean_fold_recall": 0.999996, "mean_fold_benign_recall": 0.998911,
          "mean_fold_macro_f1": 0.999685, "rows": 7062606}


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame([(d, *c) for d, c in FOLD_COUNTS.items()],
                                 "device_id INT, tn BIGINT, fp BIGINT, fn BIGINT, tp BIGINT")


def test_fold_metrics_match_published(counts):
    got = {r.device_id: r for r in met.metrics_from_counts(counts).collect()}
    names = ["accuracy", "precision", "recall", "f1", "benign_precision", "benign_recall", "benign_f1", "macro_f1"]
    for d, vals in REPORTED.items():
        for name, v in zip(names, vals):
            assert abs(got[d][name] - v) < 1e-14, (d, name)


def test_pooled_metrics_match_published(counts):
    p = met.pooled_metrics(counts).first()
    assert p.fp == POOLED["fp"] and p.fn == POOLED["fn"] and p.n_rows == POOLED["rows"]
    for name in ("accuracy", "recall", "benign_recall", "mean_fold_accuracy", "mean_fold_recall",
                 "mean_fold_benign_recall", "mean_fold_macro_f1"):
        assert round(p[name], 6) == POOLED[name], name


def test_hardest_devices_match_published(counts):
    m = met.metrics_from_counts(counts)
    got = {}
    for r in met.hardest_groups(m, "device_id", 3).collect():
        got.setdefault(r.criterion, []).append((r.rank, r.device_id, r.errors))
    # published: lowest attack recall 5, 9, 8 (FN 20, 10, 1); lowest benign recall 8, 3, 9 (FP 409, 18, 4)
    assert sorted(got["attack_recall"]) == [(1, 5, 20), (2, 9, 10), (3, 8, 1)]
    assert sorted(got["benign_recall"]) == [(1, 8, 409), (2, 3, 18), (3, 9, 4)]


def test_knn_report_counts_match_published(spark):
    # published device-1 kNN run: tn 9907, fp 3, fn 10, tp 193740 -> accuracy 0.999936, attack P/R/F1
    # 0.999985 / 0.999948 / 0.999966, supports 9910 / 193750 / 203660
    cells = [(0, 0, 9907), (0, 1, 3), (1, 0, 10), (1, 1, 193740)]
    rows = [(a, p) for a, p, n in cells for _ in range(n)]
    df = spark.createDataFrame(rows, "actual INT, predicted INT")
    m = met.binary_metrics(df).first()
    assert tuple(round(x, 6) for x in (m.accuracy, m.precision, m.recall, m.f1)) == (0.999936, 0.999985, 0.999948, 0.999966)
    rep = {r["class"]: r for r in met.classification_report(df, names=met.BINARY_NAMES).collect()}
    assert rep["benign"].support == 9910 and rep["attack"].support == 193750
    assert rep["accuracy"].support == 203660 and round(rep["macro avg"].f1, 2) == 1.0


def test_publication_confusions_give_published_accuracy(spark):
    # Published TN / FP / FN / TP and accuracy of the three configurations
    runs = [("rf_115", 111185, 1, 0, 1301335, 0.999999292), ("rf_top20", 111184, 2, 1, 1301334, 0.999997876),
            ("rf_top20_smote", 111185, 1, 1, 1301334, 0.999998584)]
    df = spark.createDataFrame([r[:5] for r in runs], "run STRING, tn BIGINT, fp BIGINT, fn BIGINT, tp BIGINT")
    got = {r.run: r.accuracy for r in met.metrics_from_counts(df).collect()}
    for run, *_, acc in runs:
        assert round(got[run], 9) == acc  # 0.999999292 and 0.999998584 stay apart
