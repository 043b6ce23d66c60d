"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver tables at ``sf_dir`` (whole tables) and runs the
library's operators on them; ``flowlab.plans.oracle`` holds the DuckDB twin of
each one that has a SQL form. Metrics are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlab.functions.exprs import clean_nonfinite, nonfinite_to_null, pct_of_total, r6
from flowlab.operators import checks
from flowlab.operators import features as feat
from flowlab.operators import folds
from flowlab.plans import experiments as exp
from flowlab.operators import iforest
from flowlab.operators import knn, knn_lsh
from flowlab.operators import label as lab
from flowlab.operators import leakage
from flowlab.operators import metrics as met
from flowlab.operators import quality as qual
from flowlab.operators import runs as runs_op
from flowlab.operators import scale as sc
from flowlab.operators import smote as smote_op
from flowlab.operators import split as sp
from flowlab.session import broadcast_if_small, cut_lineage, read_table, remove_folder, scratch_folder
from flowlab.sources import ingest
from flowlab.sources.adapters import (TRAFFIC_FEATURES, embedding_features, embeddings_as_rows,
                                      events_as_traffic)

SEED = 42
TEST_FRACTION = 0.2


# ------------------------------------------------------------------ shared inputs
def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labeled traffic rows from ``events`` (adapter + P1-P3 + X2)."""
    return lab.label_traffic(events_as_traffic(read_table(spark, sf_dir, "events")))


def traffic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4 stratified split of the labeled traffic (seed 42, test 20 %)."""
    return sp.stratified_split(traffic(spark, sf_dir), "binary_target", "row_key", TEST_FRACTION, SEED)


def device_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device dimension stand-in: nation key + 1 -> device id, nation name -> device name."""
    n = read_table(spark, sf_dir, "nation")
    return n.select((F.col("n_nationkey") + 1).cast("int").alias("device_id"), F.col("n_name").alias("device_name"))


def rounded(df: DataFrame) -> DataFrame:
    """Every DOUBLE column rounded to 6 decimals: the output form of the registered metric queries."""
    return df.select(*[r6(f"`{c}`").alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


# ------------------------------------------------------------------ labeling
def q_label_events(spark, sf_dir):
    """Device, binary label/target, family, type, multiclass label per row."""
    return traffic(spark, sf_dir).select("row_key", "source_file", "device_id", "binary_label", "binary_target",
                                         "family", "attack_type", "multiclass_label")


def q_class_distribution(spark, sf_dir):
    """A1, A2, P10: class counts zero-filled over {0, 1} with percent, for all rows / train / test.

    One pass over the split rows (counts per split stage); the 'all' stage sums that small result.
    """
    t = F.col("binary_target")
    per = traffic_split(spark, sf_dir).groupBy(F.col("split").alias("stage")).agg(
        F.count_if(t == 0).alias("n0"), F.count_if(t == 1).alias("n1"))
    per = cut_lineage(per)  # one row per stage
    both = per.unionByName(per.agg(F.lit("all").alias("stage"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    stages = spark.createDataFrame([("all",), (sp.TRAIN,), (sp.TEST,)], "stage STRING")  # fixed stage list
    wide = stages.join(both, "stage", "left").select(
        "stage", F.coalesce("n0", F.lit(0)).cast("bigint").alias("n0"), F.coalesce("n1", F.lit(0)).cast("bigint").alias("n1"))
    out = wide.selectExpr("stage", "stack(2, 0, 'benign', n0, 1, 'attack', n1) AS (binary_target, binary_label, n)")
    return out.withColumn("pct", r6(pct_of_total("n", ["stage"])))


def q_device_summary(spark, sf_dir):
    """A3 + J1: per device rows, benign/attack counts and percents, device name by lookup."""
    t = traffic(spark, sf_dir)
    per = t.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("binary_target") == 0).alias("benign_rows"),
        F.count_if(F.col("binary_target") == 1).alias("attack_rows"))
    dim = broadcast_if_small(device_dim(spark, sf_dir))
    return (per.join(dim, "device_id", "left")
            .withColumn("benign_pct", r6(F.col("benign_rows") * 100.0 / F.col("rows")))
            .withColumn("attack_pct", r6(F.col("attack_rows") * 100.0 / F.col("rows"))))


def q_label_consistency(spark, sf_dir):
    """Per device, rows whose target disagrees with the label map."""
    return lab.label_consistency(traffic(spark, sf_dir), "device_id")


# ------------------------------------------------------------------ splits
def q_ordered_split(spark, sf_dir):
    """First floor(0.8 n) rows of every source file (in capture order) are train."""
    s = sp.ordered_split(traffic(spark, sf_dir), "source_file", ["ts", "row_key"], 0.8)
    return s.select("row_key", "source_file", "row_pos", "split")


def q_split_summary(spark, sf_dir):
    """A4: per source total/train/test rows and label of the ordered split."""
    s = sp.ordered_cut(traffic(spark, sf_dir), "source_file", "ts", "row_key", 0.8)
    return sp.source_split_summary(s, "source_file")


def q_ordered_cut(spark, sf_dir):
    """W3 by cut values: the ordered split of every row without positions."""
    s = sp.ordered_cut(traffic(spark, sf_dir), "source_file", "ts", "row_key", 0.8)
    return s.select("row_key", "source_file", "split")


def q_stratified_split(spark, sf_dir):
    """Exact per-class quota round(0.2 n_c), seeded uniform choice."""
    return traffic_split(spark, sf_dir).select("row_key", "binary_target", "split")


def q_library_split(spark, sf_dir):
    """Test size ceil(0.2 N), class seats by largest remainder."""
    s = sp.library_split(traffic(spark, sf_dir), "binary_target", "row_key", TEST_FRACTION, SEED)
    return s.select("row_key", "binary_target", "split")


def q_split_disjoint(spark, sf_dir):
    """The stratified split is complete and disjoint."""
    t = traffic(spark, sf_dir)
    return sp.split_check(sp.stratified_split(t, "binary_target", "row_key", TEST_FRACTION, SEED), t)


# ------------------------------------------------------------------ scaling
def _fit_scaler(spark, sf_dir, kind="standard"):
    split = traffic_split(spark, sf_dir)
    train = split.filter(F.col("split") == sp.TRAIN)
    model = sc.fit_standard(train, TRAFFIC_FEATURES) if kind == "standard" else sc.fit_minmax(train, TRAFFIC_FEATURES)
    return split, model


def q_scaler_params(spark, sf_dir):
    """M4: mean and population std per feature, fitted on the train split only."""
    _, model = _fit_scaler(spark, sf_dir)
    p = model.params(spark)
    return p.select("position", "feature", r6("center").alias("mean"), r6("scale").alias("std"))


def q_scale_apply(spark, sf_dir):
    """P8 + P9: float32 features standardised with train statistics, train and test rows."""
    split, model = _fit_scaler(spark, sf_dir)
    out = model.transform(sc.narrow_to_float(split, TRAFFIC_FEATURES))
    return out.select("row_key", "split", *[r6(f).alias(f) for f in TRAFFIC_FEATURES])


def q_minmax(spark, sf_dir):
    """Min-max scaling fitted on train, applied to all rows."""
    split, model = _fit_scaler(spark, sf_dir, "minmax")
    out = model.transform(split)
    return out.select("row_key", "split", *[r6(f).alias(f) for f in TRAFFIC_FEATURES])


# ------------------------------------------------------------------ kNN, SMOTE, evaluation
K = 5


def scaled_traffic_split(spark, sf_dir) -> DataFrame:
    """Stratified split with features standardised by train-only statistics."""
    split, model = _fit_scaler(spark, sf_dir)
    return model.transform(sc.narrow_to_float(split, TRAFFIC_FEATURES))


def stored_split(spark, sf_dir) -> DataFrame:
    """Keys, labels and scaled features of the split; the split is stored once for plans that read it several times."""
    raw = cut_lineage(traffic_split(spark, sf_dir).select("row_key", "binary_target", "split", *TRAFFIC_FEATURES))
    model = sc.fit_standard(raw.filter(F.col("split") == sp.TRAIN), TRAFFIC_FEATURES)
    return model.transform(sc.narrow_to_float(raw, TRAFFIC_FEATURES))


def knn_predictions(spark, sf_dir, data: DataFrame | None = None) -> DataFrame:
    """Flagship chain: label -> stratified split -> train-only scaling -> 5-NN (distance weights)."""
    data = stored_split(spark, sf_dir) if data is None else data
    train = data.filter(F.col("split") == sp.TRAIN)
    test = data.filter(F.col("split") == sp.TEST)
    return knn.knn_classify(train, test, TRAFFIC_FEATURES, K, "binary_target", "row_key")


def q_knn_join(spark, sf_dir):
    """Exact 5 nearest other embeddings of every embedding (Euclidean, ties by id)."""
    e = embeddings_as_rows(read_table(spark, sf_dir, "embeddings"))
    nn = knn.knn_join(e, e, embedding_features(), K, "row_key", "row_key", exclude_self=True)
    return nn.select("qid", "rid", "nn_rank", r6("dist").alias("dist"))


def q_knn_classify(spark, sf_dir):
    """M6: distance-weighted 5-NN prediction and attack score of every test row."""
    p = knn_predictions(spark, sf_dir)
    return p.select("row_key", F.col("binary_target").alias("actual"), "predicted", r6("score").alias("score"))


def q_confusion(spark, sf_dir):
    """A5: 2x2 confusion matrix (long form) of the kNN predictions."""
    p = knn_predictions(spark, sf_dir)
    return met.confusion_long(p, "binary_target", "predicted")


def q_binary_metrics(spark, sf_dir):
    """A5 + A6 + A7: counts, accuracy, attack/benign precision, recall, F1, macro averages, FPR."""
    p = knn_predictions(spark, sf_dir)
    return rounded(met.binary_metrics(p, "binary_target", "predicted"))


def q_classification_report(spark, sf_dir):
    """10-class report (per class, accuracy, macro, weighted) of 5-NN on embeddings."""
    e = embeddings_as_rows(read_table(spark, sf_dir, "embeddings"))
    s = sp.stratified_split(e, "class_label", "row_key", TEST_FRACTION, SEED)
    feats = embedding_features()
    model = sc.fit_standard(s.filter(F.col("split") == sp.TRAIN), feats)
    z = model.transform(s)
    pred = knn.knn_classify(z.filter(F.col("split") == sp.TRAIN), z.filter(F.col("split") == sp.TEST),
                            feats, K, "class_label", "row_key")
    return rounded(met.classification_report(pred, "class_label", "predicted").drop("label"))


def _fold_knn(train: DataFrame, test: DataFrame, sizes: tuple[int, int] | None = None) -> DataFrame:
    model = sc.fit_standard(train, TRAFFIC_FEATURES)
    tr = model.transform(sc.narrow_to_float(train, TRAFFIC_FEATURES))
    te = model.transform(sc.narrow_to_float(test, TRAFFIC_FEATURES))
    return knn.knn_classify(tr, te, TRAFFIC_FEATURES, K, "binary_target", "row_key", sizes=sizes)


def lodo_fold_counts(spark, sf_dir) -> DataFrame:
    """M8 with 5-NN: per held-out device, scaler and references from the other devices only; all folds in one plan."""
    pred, scalers = folds.holdout_knn(traffic(spark, sf_dir), TRAFFIC_FEATURES, "device_id", k=K)
    return folds.fold_counts(pred, scalers).select(F.col("fold").cast("int").alias("device_id"), "tn", "fp", "fn", "tp",
                                                   F.col("train_rows").cast("bigint").alias("train_rows"))


def _lodo_selected(spark, sf_dir, selected: DataFrame | None, everywhere: list[str] | None) -> DataFrame:
    """Per held-out device, 5-NN on the fold's selected (fold, feature) rows, or on one list in every fold."""
    t = traffic(spark, sf_dir)
    if selected is None:
        ids = t.select(F.col("device_id").alias("fold")).distinct()
        selected = ids.select("fold", F.explode(F.lit(everywhere)).alias("feature"))
    selected = cut_lineage(selected)  # folds x top-n rows
    pred, scalers = folds.holdout_knn(t, TRAFFIC_FEATURES, "device_id", k=K, selected=selected)
    place = {f: i for i, f in enumerate(TRAFFIC_FEATURES)}
    order = F.from_json(F.lit(json.dumps(place)), "map<string,int>")
    lists = selected.groupBy(F.col("fold").alias("_sel")).agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce(F.element_at(order, F.col("feature")), F.lit(len(place))), "feature"))).alias("l"))
    names = lists.select("_sel", F.transform("l", lambda x: x["feature"]).alias("names"))
    m = met.metrics_from_counts(folds.fold_counts(pred, scalers)).join(names, F.col("fold").eqNullSafe(F.col("_sel")))
    known = F.array(*[F.lit(f) for f in TRAFFIC_FEATURES])
    return m.select(F.col("fold").cast("int").alias("device_id"), F.array_join("names", " ").alias("selected"), "tn", "fp", "fn", "tp",
                    *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "macro_f1")],
                    (F.col("n_rows") == F.col("test_rows")).alias("v_confusion_total"),
                    (F.size(F.array_distinct("names")) == TOP_N).alias("v_unique_features"),
                    (F.size(F.array_except("names", known)) == 0).alias("v_subset_of_all"))


def q_lodo_knn_global_top(spark, sf_dir):
    """M8 as the reference runs it: one global top-2 list (ranked on the stratified train split, which
    includes every device, so it is leaky), then a 5-NN per held-out device."""
    ranked, _ = _train_rank(spark, sf_dir)
    top = {r[0] for r in ranked.filter(F.col("selected")).select("feature").collect()}
    return _lodo_selected(spark, sf_dir, None, [f for f in TRAFFIC_FEATURES if f in top])


def q_nested_lodo_knn(spark, sf_dir):
    """M9 + V5: per held-out device, top-2 ranked on the other devices only (leak-free), scaler on the
    other devices, 5-NN on the held-out device; validation flags per fold."""
    ranks = feat.rank_features(feat.holdout_importance(traffic(spark, sf_dir), TRAFFIC_FEATURES, "binary_target", "device_id"), ["fold"])
    return _lodo_selected(spark, sf_dir, ranks.filter(F.col("rank") <= TOP_N).select("fold", "feature"), None)


def q_lodo_knn(spark, sf_dir):
    """M8 + R3: one metrics row per held-out device."""
    return rounded(met.metrics_from_counts(lodo_fold_counts(spark, sf_dir)).drop("n_rows")).orderBy("device_id")


def q_lodo_pooled(spark, sf_dir):
    """Pooled counts over folds, ratios from the pooled counts, mean fold metrics."""
    return rounded(met.pooled_metrics(lodo_fold_counts(spark, sf_dir)).drop("n_rows"))


def q_hardest_devices(spark, sf_dir):
    """Three lowest attack-recall folds (tie: most FN) and three lowest benign-recall (tie: most FP)."""
    m = met.metrics_from_counts(lodo_fold_counts(spark, sf_dir))
    out = rounded(met.hardest_groups(m, "device_id", 3))
    return out.orderBy(*out.columns)


def transfer_parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The ordered-split train part of device 1, and every row of device 2."""
    t = traffic(spark, sf_dir)
    train = sp.ordered_cut(t.filter(F.col("device_id") == 1), "source_file", "ts", "row_key", 0.8)
    return train.filter(F.col("split") == sp.TRAIN), t.filter(F.col("device_id") == 2)


def q_transfer_knn(spark, sf_dir):
    """Train on the ordered-split train part of device 1, test on every row of device 2."""
    train, test = transfer_parts(spark, sf_dir)
    return rounded(met.binary_metrics(_fold_knn(train, test), "binary_target", "predicted").drop("n_rows"))


def q_family_holdout(spark, sf_dir):
    """Hold out one attack family at a time; 5-NN trained on all other rows; all folds in one plan."""
    t = traffic(spark, sf_dir)
    fams = [r[0] for r in t.filter(F.col("binary_target") == 1).select("family").distinct().collect()]
    pred, scalers = folds.holdout_knn(t, TRAFFIC_FEATURES, "family", k=K, folds=fams)
    m = met.metrics_from_counts(folds.fold_counts(pred, scalers).drop("test_rows", "train_rows")).drop("n_rows")
    return rounded(m.withColumnRenamed("fold", "held_out_family"))


def q_attack_type_holdout(spark, sf_dir):
    """X9 by attack type: hold out one (family, type) at a time; 5-NN trained on all other rows; all folds in one plan."""
    t = traffic(spark, sf_dir)
    kinds = [r[0] for r in t.filter(F.col("attack_type").isNotNull()).select("multiclass_label").distinct().collect()]
    pred, scalers = folds.holdout_knn(t, TRAFFIC_FEATURES, "multiclass_label", k=K, folds=kinds)
    m = met.metrics_from_counts(folds.fold_counts(pred, scalers))
    out = m.select(F.col("fold").alias("held_out_type"), "tn", "fp", "fn", "tp", "recall", F.col("train_rows").cast("bigint").alias("train_rows"))
    return rounded(out).orderBy("held_out_type")


def _smote_train(spark, sf_dir, data: DataFrame | None = None) -> DataFrame:
    data = stored_split(spark, sf_dir) if data is None else data
    train = data.filter(F.col("split") == sp.TRAIN).drop("split")
    return smote_op.smote(train, TRAFFIC_FEATURES, "binary_target", "row_key", K, SEED)


def q_smote(spark, sf_dir):
    """M5: SMOTE rows (k=5, seed 42) that bring the scaled train minority up to the majority count."""
    out = _smote_train(spark, sf_dir).filter(F.col("is_synthetic"))
    return out.select("syn_id", "binary_target", "base_key", "nn_key", r6("step").alias("step"),
                      *[r6(f).alias(f) for f in TRAFFIC_FEATURES])


def q_smote_balanced(spark, sf_dir):
    """U3 + V1 check: class counts of originals and synthetic rows after the union."""
    out = _smote_train(spark, sf_dir)
    return out.groupBy("binary_target", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


FAMILIES = ["benign", "signup", "click", "error", "purchase"]  # class codes of the multiclass experiment, in this order


def _family_split(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with their family as a class code, stratified by family, scaled by the train rows."""
    code = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")).cast("int") - 1
    rows = traffic(spark, sf_dir).withColumn("family_code", code).select("row_key", "family_code", *TRAFFIC_FEATURES)
    s = sp.stratified_split(rows, "family_code", "row_key", TEST_FRACTION, SEED)
    model = sc.fit_standard(s.filter(F.col("split") == sp.TRAIN), TRAFFIC_FEATURES)
    z = model.transform(sc.narrow_to_float(s, TRAFFIC_FEATURES))
    train, test = (cut_lineage(z.filter(F.col("split") == part).drop("split")) for part in (sp.TRAIN, sp.TEST))
    return train, test


def q_multiclass_smote(spark, sf_dir):
    """M5 + X5 over families: SMOTE brings every family to the size of the largest; rows per family, made and given."""
    train, _ = _family_split(spark, sf_dir)
    out = smote_op.smote(train, TRAFFIC_FEATURES, "family_code", "row_key", K, SEED)
    return out.groupBy("family_code", "is_synthetic").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("base_key"), F.lit(0)).cast("bigint").alias("base_keys"),
                                                          F.coalesce(F.sum("nn_key"), F.lit(0)).cast("bigint").alias("nn_keys"))


def q_multiclass_report(spark, sf_dir):
    """M7 over families: report of 5-NN on the SMOTE-balanced train rows, per family, accuracy, macro and weighted."""
    train, test = _family_split(spark, sf_dir)
    bal = smote_op.smote(train, TRAFFIC_FEATURES, "family_code", "row_key", K, SEED)
    # made rows of different families share numbers: the class goes into their key
    bal = cut_lineage(bal.withColumn("row_key", F.coalesce(F.col("row_key"), -1 - (F.col("syn_id") * len(FAMILIES) + F.col("family_code")))))
    pred = knn.knn_classify(bal, test, TRAFFIC_FEATURES, K, "family_code", "row_key")
    names = dict(enumerate(FAMILIES))
    return rounded(met.classification_report(pred, "family_code", "predicted", names).drop("label"))


def q_auc(spark, sf_dir):
    """ROC-AUC and PR-AUC of the kNN attack score."""
    p = knn_predictions(spark, sf_dir)
    return rounded(met.roc_pr_auc(p, "binary_target", "score"))


def q_lof(spark, sf_dir):
    """Local outlier factor (k=5) of every embedding."""
    e = embeddings_as_rows(read_table(spark, sf_dir, "embeddings"))
    out = knn.local_outlier_factor(e, embedding_features(), K, "row_key")
    return out.select("row_key", r6("k_distance").alias("k_distance"), r6("lrd").alias("lrd"), r6("lof").alias("lof"))


def q_lof_benign(spark, sf_dir):
    """LOF (k=5) of every row against the benign rows of its device, features scaled by these rows."""
    t = traffic(spark, sf_dir)
    benign = t.filter(F.col("binary_target") == 0)
    stats = benign.groupBy(F.col("device_id").alias("_d")).agg(*[a for i, f in enumerate(TRAFFIC_FEATURES) for a in (
        F.avg(F.col(f).cast("double")).alias(f"m{i}"), F.stddev_pop(F.col(f).cast("double")).alias(f"s{i}"))])
    stats = broadcast_if_small(stats)  # one row per device
    z = t.join(stats, F.col("device_id").eqNullSafe(F.col("_d"))).select("row_key", "device_id", "binary_target", *[
        ((F.col(f).cast("double") - F.col(f"m{i}")) / F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(1.0)).alias(f)
        for i, f in enumerate(TRAFFIC_FEATURES)])
    out = knn.novelty_lof(z.filter(F.col("binary_target") == 0), z, TRAFFIC_FEATURES, K, "row_key", "device_id")
    return out.select("row_key", "device_id", r6("k_distance").alias("k_distance"), r6("lrd").alias("lrd"), r6("lof").alias("lof"))


def q_knn_approx(spark, sf_dir):
    """J9, approximate mode: random projections against the exact join on the scaled split, as checked rows."""
    data = stored_split(spark, sf_dir)
    test, train = data.filter(F.col("split") == sp.TEST), data.filter(F.col("split") == sp.TRAIN)
    approx, model = knn_lsh.approx_knn_join(test, train, TRAFFIC_FEATURES, K)
    exact = knn.knn_join(test, train, TRAFFIC_FEATURES, K)
    approx, exact = cut_lineage(approx), cut_lineage(exact)
    met_pairs = knn_lsh.bucket_pairs(model, test, train, TRAFFIC_FEATURES) if model else 0
    one = knn_lsh.recall(approx, exact)
    all_pairs = test.count() * train.count()
    named = {
        "recall_at_least_0.9": F.first("recall") >= 0.9,
        "every_query_has_k_rows": F.first("exact_pairs") == F.lit(approx.count()),
        "few_pairs_meet": F.lit(met_pairs < 0.4 * all_pairs),
    }
    return qual.checks_table(named, one)


# ------------------------------------------------------------------ run records and result tables
RUN_METRICS = ["n_orders", "total_price", "mean_price", "max_price", "open_share"]
BASELINE_EXPERIMENT = "1-URGENT"


def run_table(spark, sf_dir) -> DataFrame:
    """Run records stand-in: one run per (order priority = experiment, order month = run)."""
    o = read_table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("experiment"),
                     F.date_format("o_orderdate", "yyyy-MM").alias("run_id")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total_price"),
        F.avg("o_totalprice").alias("mean_price"), F.max("o_totalprice").alias("max_price"),
        (F.count_if(F.col("o_orderstatus") == "O") / F.count(F.lit(1))).alias("open_share"))


def _runs_long(spark, sf_dir) -> DataFrame:
    return runs_op.runs_long(run_table(spark, sf_dir), ["experiment", "run_id"], RUN_METRICS)


def q_run_summary_pop(spark, sf_dir):
    """Per experiment and metric: runs, mean, min, max, population std."""
    return rounded(runs_op.summary_pop(_runs_long(spark, sf_dir), ["experiment", "metric"]))


def q_run_summary_sample(spark, sf_dir):
    """Per experiment, year and metric: n, reported value and kind, mean, sample std, min, max."""
    long = _runs_long(spark, sf_dir).withColumn("year", F.substring("run_id", 1, 4))
    out = runs_op.summary_sample(long, ["experiment", "year", "metric"], "run_id")
    # as text for the whole numbers only: the last digit of a mean depends on the order of its sum
    values = F.array_join(F.transform("run_values", lambda v: v.cast("long").cast("string")), ";")
    return rounded(out.withColumns({"run_values": F.when(F.col("metric") == "n_orders", values), "n_values": F.size("run_values")}))


def q_change_table(spark, sf_dir):
    """J5 + P13-P15: every experiment's mean metrics against the baseline experiment."""
    summ = runs_op.summary_pop(_runs_long(spark, sf_dir), ["experiment", "metric"])
    out = runs_op.compare_to_baseline(summ, "experiment", BASELINE_EXPERIMENT, "mean")
    # a hundred times a difference of prices: two digits less are certain whatever the order of the sums
    return rounded(out.withColumn("percentage_point_difference", F.round("percentage_point_difference", 4)))


def q_run_vs_prior(spark, sf_dir):
    """Runs of the latest year left-joined to the same experiment and month a year before."""
    r = run_table(spark, sf_dir).withColumns({"year": F.substring("run_id", 1, 4).cast("int"),
                                              "month": F.substring("run_id", 6, 2).cast("int")})
    last = r.agg(F.max("year")).first()[0]
    cur = r.filter(F.col("year") == last)
    prior = r.filter(F.col("year") == last - 1)
    j = runs_op.pair_with_prior(cur, prior, ["experiment", "month"], ["n_orders", "total_price"])
    ch = runs_op.direction_change(F.col("prior_n_orders").cast("double"), F.col("n_orders").cast("double"))
    # prior values are null for months without a prior run; DOUBLE keeps nulls representable everywhere
    return j.select("experiment", "month", "n_orders", F.col("prior_n_orders").cast("double").alias("prior_n_orders"),
                    r6("total_price").alias("total_price"),
                    r6("prior_total_price").alias("prior_total_price"),
                    r6(ch["signed_percent_change"]).alias("signed_percent_change"), ch["direction"].alias("direction"))


def q_golden_match(spark, sf_dir):
    """5-NN confusion matrix against the stored 3-NN one; per cell and overall match.

    The golden matrix is written as a wide CSV and read back with its checks. One kNN join serves both: the three nearest are the first ranks of the five.
    """
    data = stored_split(spark, sf_dir)
    train, test = data.filter(F.col("split") == sp.TRAIN), data.filter(F.col("split") == sp.TEST)
    neigh = cut_lineage(knn.knn_join(test, train, TRAFFIC_FEATURES, K, carry=["binary_target"]))
    labels = test.select("row_key", "binary_target")
    cells = []
    for k in (K, 3):
        votes = knn.weighted_vote(neigh.filter(F.col("nn_rank") <= k), "binary_target").withColumnRenamed("qid", "row_key")
        cells.append(met.confusion_long(labels.join(votes, "row_key", "left"), "binary_target", "predicted"))
    names = F.array(F.lit("benign"), F.lit("attack"))
    named = [c.select(F.get(names, F.col("actual")).alias("actual"), F.get(names, F.col("predicted")).alias("predicted"), "n") for c in cells]
    place = scratch_folder(spark, "golden")
    ingest.write_matrix(named[1], f"{place}/matrix", ["benign", "attack"])
    golden = cut_lineage(ingest.read_matrix(spark, f"{place}/matrix", ["benign", "attack"]))
    remove_folder(spark, place)
    out = runs_op.golden_match(named[0], golden, ["actual", "predicted"], "n")
    code = lambda c: (F.array_position(names, F.col(c)) - 1).cast("int").alias(c)
    return out.select(code("actual"), code("predicted"), "run_n", "golden_n", "match", "all_match")


def q_snapshot_diff(spark, sf_dir):
    """Rows created, removed and changed between two train tables: the stratified one with binary labels,
    and the ordered one with multiclass labels (benign rows in both are unchanged and left out)."""
    t = traffic(spark, sf_dir)
    before = sp.stratified_split(t, "binary_target", "row_key", TEST_FRACTION, SEED).filter(F.col("split") == sp.TRAIN)
    after = sp.ordered_cut(t, "source_file", "ts", "row_key", 0.8).filter(F.col("split") == sp.TRAIN)
    diff, _ = runs_op.bucketed_diff(before.select("row_key", "source_file", F.col("binary_label").alias("label")),
                                    after.select("row_key", "source_file", F.col("multiclass_label").alias("label")), "row_key", ["source_file", "label"])
    return diff


def q_label_digest(spark, sf_dir):
    """Digest of the ordered test labels after the split, as carried through prediction, and of the predictions."""
    data = stored_split(spark, sf_dir)
    test = data.filter(F.col("split") == sp.TEST)
    pred = cut_lineage(knn_predictions(spark, sf_dir, data).select("row_key", "binary_target", "predicted"))
    stages = [("split_test", test, "binary_target"), ("carried", pred, "binary_target"), ("predicted", pred, "predicted")]
    return reduce(DataFrame.unionByName, [
        runs_op.ordered_digest(df, ["row_key"], col).select(F.lit(n).alias("stage"), "rows", "digest") for n, df, col in stages])


def q_leakage_check(spark, sf_dir):
    """Per scope and part, rows whose feature tuple (and label) also stands in another part of the split or fold."""
    t = traffic(spark, sf_dir)
    scopes = [
        ("stratified_split", sp.stratified_split(t, "binary_target", "row_key", TEST_FRACTION, SEED), F.col("split")),
        ("ordered_split", sp.ordered_cut(t, "source_file", "ts", "row_key", 0.8), F.col("split")),
        ("device_folds", t, F.col("device_id").cast("string")),
    ]
    cols = [*TRAFFIC_FEATURES, "binary_target"]
    out = []
    for name, df, part in scopes:
        c = leakage.copies_across(df.select(*cols, part.alias("part")), cols, "part")
        out.append(c.select(F.lit(name).alias("scope"), "*", (F.col("copied_rows") == 0).alias("clean")))
    e = embeddings_as_rows(read_table(spark, sf_dir, "embeddings"))
    rough = [F.round(F.col(f), 0).alias(f) for f in embedding_features()[:2]]  # two rounded dimensions: copies do occur
    s = sp.stratified_split(e, "class_label", "row_key", TEST_FRACTION, SEED)
    c = leakage.copies_across(s.select(*rough, "split"), embedding_features()[:2], "split")
    out.append(c.select(F.lit("rounded_embeddings").alias("scope"), "*", (F.col("copied_rows") == 0).alias("clean")))
    return reduce(DataFrame.unionByName, out)


def q_fingerprint(spark, sf_dir):
    """Test-label fingerprint after the split and after prediction (must be equal)."""
    data = stored_split(spark, sf_dir)
    test = data.filter(F.col("split") == sp.TEST)
    pred = knn.knn_classify(data.filter(F.col("split") == sp.TRAIN), test, TRAFFIC_FEATURES, K)
    a = runs_op.fingerprint(test, "row_key", "binary_target").select(F.lit("split_test").alias("stage"), "*")
    b = runs_op.fingerprint(pred, "row_key", "binary_target").select(F.lit("predicted").alias("stage"), "*")
    return a.unionByName(b)


def q_runtime_table(spark, sf_dir):
    """One row per experiment, one column per metric (mean over runs)."""
    summ = runs_op.summary_pop(_runs_long(spark, sf_dir), ["experiment", "metric"])
    return rounded(runs_op.pivot_table(summ, "experiment", "metric", "mean", RUN_METRICS))


def q_summary_table(spark, sf_dir):
    """R2: per experiment, value / std / min / max of every metric as columns, counts as BIGINT."""
    summ = runs_op.summary_pop(_runs_long(spark, sf_dir), ["experiment", "metric"])
    wide = summ.groupBy("experiment").pivot("metric", RUN_METRICS).agg(
        F.first("mean").alias("value"), F.first("std").alias("std"), F.first("min").alias("min"),
        F.first("max").alias("max"))
    runs = summ.groupBy("experiment").agg(F.max("runs").cast("bigint").alias("runs"))
    return rounded(wide.join(runs, "experiment"))


def q_experiment_table(spark, sf_dir):
    """R3 + J1: leave-one-device-out fold results with device names, row counts and metrics."""
    counts = lodo_fold_counts(spark, sf_dir)
    m = met.metrics_from_counts(counts).withColumnRenamed("n_rows", "test_rows")
    dim = broadcast_if_small(device_dim(spark, sf_dir))
    return m.join(dim, "device_id", "left").select("device_id", "device_name", "train_rows", "test_rows", "tn", "fp",
                                                   "fn", "tp", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "macro_f1")])


def q_run_checks(spark, sf_dir):
    """V1: checks of the flagship run: rows, supports, labels, predictions, and the report's ratios against the counts."""
    t = traffic(spark, sf_dir)
    data = stored_split(spark, sf_dir)
    pred = cut_lineage(knn_predictions(spark, sf_dir, data).select("row_key", "binary_target", "predicted"))
    report = checks.reported_metrics(met.classification_report(pred, "binary_target", "predicted", met.BINARY_NAMES))
    return checks.run_checks(t, data, pred, report, _smote_train(spark, sf_dir, data))


def q_cross_run_checks(spark, sf_dir):
    """V2: checks across the run table: equal run counts and run ids per experiment, no missing metric."""
    r = run_table(spark, sf_dir)
    per = r.groupBy("experiment").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum(F.xxhash64("run_id").cast("decimal(20,0)")).alias("run_set"),
        F.count_if(reduce(lambda a, b: a | b, [F.col(m).isNull() for m in RUN_METRICS])).alias("missing"))
    named = {
        "same_run_count": F.count_distinct("runs") == 1,
        "same_run_ids": F.count_distinct("run_set") == 1,
        "no_missing_metrics": F.sum("missing") == 0,
        "several_experiments": F.count(F.lit(1)) > 1,
    }
    return qual.checks_table(named, per)


# ------------------------------------------------------------------ quality / EDA
def q_eda_counts(spark, sf_dir):
    """GROUPING SETS ((), (device), (label), (device, label)) row counts."""
    return qual.eda_counts(traffic(spark, sf_dir), "device_id", "binary_label")


def q_eda_features(spark, sf_dir):
    """Per feature count, nulls, mean, sample std, min, max."""
    return rounded(qual.eda_features(traffic(spark, sf_dir), TRAFFIC_FEATURES))


def q_eda_quantiles(spark, sf_dir):
    """25/50/75/90 % quantiles of every traffic feature."""
    return rounded(qual.eda_quantiles(traffic(spark, sf_dir), TRAFFIC_FEATURES))


def q_quality(spark, sf_dir):
    """Per feature null / NaN / inf counts of the traffic features."""
    return qual.nonfinite_counts(traffic(spark, sf_dir), TRAFFIC_FEATURES)


def q_duplicates(spark, sf_dir):
    """Exact duplicates of lineitem over whole rows."""
    rows = read_table(spark, sf_dir, "lineitem")
    return qual.duplicate_summary(rows, rows.columns)


def q_regex_timing(spark, sf_dir):
    """Numbers pulled from whole document texts by regex; missing -> null."""
    d = read_table(spark, sf_dir, "documents")
    ver = F.regexp_extract("text", r"Version ([0-9]+(\.[0-9]+)?)", 1)
    first = F.regexp_extract("text", r"([0-9]+(\.[0-9]+)?)", 1)
    return d.select("doc_id",
                    F.nullif(ver, F.lit("")).try_cast("double").alias("license_version"),
                    F.nullif(first, F.lit("")).try_cast("double").alias("first_number"),
                    F.regexp_count("text", F.lit("[0-9]+")).cast("bigint").alias("n_numbers"))


def q_row_expectation(spark, sf_dir):
    """V7: per source, the rows of the raw table vs rows after labeling and the ordered split, and expected split sizes.

    The expectation is counted on the raw events by device, type and family, before any traffic operator.
    """
    raw = read_table(spark, sf_dir, "events")
    parts = raw.groupBy((F.col("user_id") % 9 + 1).alias("d"), "event_type", (F.floor(F.col("user_id") / 9) % 2).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    name = F.concat(F.col("d").cast("string"), F.when(F.col("event_type") == "view", ".benign").when(F.col("event_type") == "signup", ".signup").otherwise(
        F.concat(F.lit("."), "event_type", F.when(F.col("k") == 0, ".scan").otherwise(".flood"))), F.lit(".csv"))
    summary = parts.groupBy(name.alias("source_file")).agg(F.sum("n").alias("expected_rows"))
    s = sp.source_split_summary(sp.ordered_cut(traffic(spark, sf_dir), "source_file", "ts", "row_key", 0.8), "source_file")
    j = summary.join(s, "source_file", "full_outer")
    exp_train = F.floor(F.col("expected_rows").cast("double") * F.lit(0.8)).cast("bigint")
    ok = F.coalesce((F.col("expected_rows") == F.col("total_rows")) & (exp_train == F.col("train_rows")), F.lit(False))
    return j.select("source_file", "expected_rows", F.col("total_rows").alias("observed_rows"),
                    exp_train.alias("expected_train"), F.col("train_rows").alias("observed_train"), ok.alias("ok"))


TOP_N = 2


def _train_rank(spark, sf_dir):
    split = traffic_split(spark, sf_dir)
    train = split.filter(F.col("split") == sp.TRAIN)
    return feat.rank_features(feat.feature_importance(train, TRAFFIC_FEATURES, "binary_target"), top_n=TOP_N), split


def q_feature_rank(spark, sf_dir):
    """W1 + W2: features ranked by class-mean variance share on the train split, top-2 flag."""
    ranked, _ = _train_rank(spark, sf_dir)
    return ranked.select("rank", "feature", r6("importance").alias("importance"), "source_column_index", "selected").orderBy("rank")


WIDE_TOP = 20


def q_feature_rank_wide(spark, sf_dir):
    """W1 + W2 at the reference's width: top 20 of the 64 embedding columns on the stratified train rows."""
    e = embeddings_as_rows(read_table(spark, sf_dir, "embeddings"))
    s = sp.stratified_split(e, "binary_target", "row_key", TEST_FRACTION, SEED)
    ranked = feat.rank_features(feat.feature_importance(s.filter(F.col("split") == sp.TRAIN), embedding_features(), "binary_target"), top_n=WIDE_TOP)
    return ranked.select("rank", "feature", r6("importance").alias("importance"), "source_column_index", "selected").orderBy("rank")


def q_wide_three_config(spark, sf_dir):
    """M7 at the reference's width, without SMOTE: 5-NN on all 64 embedding columns, and on the top 20 in canonical and in rank order."""
    e = embeddings_as_rows(read_table(spark, sf_dir, "embeddings"))
    s = cut_lineage(sp.stratified_split(e, "binary_target", "row_key", TEST_FRACTION, SEED))
    train, test = s.filter(F.col("split") == sp.TRAIN), s.filter(F.col("split") == sp.TEST)
    feats = embedding_features()
    ranked = feat.rank_features(feat.feature_importance(train, feats, "binary_target"), top_n=WIDE_TOP)
    top = [r[0] for r in ranked.filter(F.col("selected")).orderBy("rank").select("feature").collect()]
    model = sc.fit_standard(train, feats)
    z_train, z_test = cut_lineage(model.transform(train)), cut_lineage(model.transform(test))
    rows = []
    for name, order in (("all_features", None), ("top20", "canonical"), ("top20_ranked", "rank")):
        keep = ["row_key", "binary_target"]
        cols = feats if order is None else [c for c in feat.select_top(z_train, top, feats, WIDE_TOP, order, keep).columns if c not in keep]
        pred = knn.knn_classify(z_train, z_test, cols, K, "binary_target", "row_key")
        m = met.binary_metrics(pred, "binary_target", "predicted")
        rows.append(m.select(F.lit(name).alias("config"), F.lit(len(cols)).alias("n_features"), "tn", "fp", "fn", "tp", "accuracy", "macro_f1"))
    return rounded(reduce(DataFrame.unionByName, rows))


def q_feature_sets(spark, sf_dir):
    """J3 + J4 + U4: selected features (semi join), model positions in canonical order, set checks."""
    ranked, _ = _train_rank(spark, sf_dir)
    sel = ranked.filter(F.col("selected"))
    w = Window.orderBy("source_column_index")
    pos = sel.withColumn("model_position", F.row_number().over(w) - 1)
    by_rank = F.array_sort(F.collect_list(F.struct("rank", "feature")).over(Window.partitionBy()))
    by_pos = F.array_sort(F.collect_list(F.struct("model_position", "feature")).over(Window.partitionBy()))
    pos = pos.withColumn("_ranked", F.transform(by_rank, lambda x: x["feature"])) \
             .withColumn("_canon", F.transform(by_pos, lambda x: x["feature"]))
    cmp = qual.list_set_compare(F.col("_ranked"), F.col("_canon"))
    return pos.select("feature", "rank", "source_column_index", "model_position",
                      cmp["same_set"].alias("same_set"), (F.col("_ranked") == F.col("_canon")).alias("same_order"))


def q_select_top(spark, sf_dir):
    """Train rows projected to the top-2 features (long form: row, feature, value)."""
    ranked, split = _train_rank(spark, sf_dir)
    top = [r[0] for r in ranked.filter(F.col("selected")).orderBy("rank").select("feature").collect()]
    proj = feat.select_top(split.filter(F.col("split") == sp.TRAIN), top, TRAFFIC_FEATURES, TOP_N, "canonical",
                           keep=["row_key"])
    cols = [c for c in proj.columns if c != "row_key"]
    return proj.unpivot(["row_key"], [F.col(c).cast("double").alias(c) for c in cols], "feature", "value") \
        .withColumn("value", r6("value"))


def q_fold_stats(spark, sf_dir):
    """A10: mean, sample std, min, max of every metric over the leave-one-device-out folds."""
    m = met.metrics_from_counts(lodo_fold_counts(spark, sf_dir))
    names = ["accuracy", "precision", "recall", "f1", "benign_recall", "macro_f1"]
    long = m.unpivot(["device_id"], [F.col(c).cast("double").alias(c) for c in names], "metric", "value")
    return long.groupBy("metric").agg(r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("std"),
                                      r6(F.min("value")).alias("min"), r6(F.max("value")).alias("max"))


def _fold_ranks(spark, sf_dir):
    t = traffic(spark, sf_dir)
    imp = feat.holdout_importance(t, TRAFFIC_FEATURES, "binary_target", "device_id")
    return feat.rank_features(imp, ["fold"])


def q_feature_stability(spark, sf_dir):
    """Per feature, folds where it is in the fold's top 2, mean / best / worst rank."""
    st = feat.feature_stability(_fold_ranks(spark, sf_dir), TOP_N)
    return st.withColumn("mean_rank", r6("mean_rank"))


def q_rank_pivot(spark, sf_dir):
    """Top-2 rank x held-out device -> feature name."""
    folds = [r[0] for r in traffic(spark, sf_dir).select("device_id").distinct().orderBy("device_id").collect()]
    return feat.rank_pivot(_fold_ranks(spark, sf_dir), folds, TOP_N).orderBy("rank")


def q_union_sources(spark, sf_dir):
    """Union by name of the train and test parts equals the input, per source file."""
    t = traffic(spark, sf_dir)
    s = sp.stratified_split(t, "binary_target", "row_key", TEST_FRACTION, SEED)
    u = ingest.union_sources([s.filter(F.col("split") == sp.TRAIN), s.filter(F.col("split") == sp.TEST)])
    a = u.groupBy("source_file").agg(F.count(F.lit(1)).alias("union_rows"))
    b = t.groupBy("source_file").agg(F.count(F.lit(1)).alias("input_rows"))
    return a.join(b, "source_file", "full_outer").withColumn("equal", F.col("union_rows") == F.col("input_rows"))


def q_nonfinite_null(spark, sf_dir):
    """1/discount and sqrt(tax - 0.04) with inf and NaN turned into null (whole lineitem)."""
    li = read_table(spark, sf_dir, "lineitem")
    inv = F.pow(F.col("l_discount"), F.lit(-1.0))
    sq = F.sqrt(F.col("l_tax") - F.lit(0.04))
    return li.select("l_orderkey", "l_linenumber", r6(nonfinite_to_null(inv)).alias("inv_discount"),
                     r6(nonfinite_to_null(sq)).alias("sqrt_tax"))


def q_list_strings(spark, sf_dir):
    """Per held-out device the train-device list as '1 2 3' and its length read back."""
    devs = traffic(spark, sf_dir).select("device_id").distinct()
    alld = F.array_sort(F.collect_set("device_id").over(Window.partitionBy()))
    d = devs.withColumn("_all", alld)
    s = F.array_join(F.filter("_all", lambda x: x != F.col("device_id")), " ")
    return d.select("device_id", s.alias("train_devices"),
                    F.size(F.split(s, " ")).alias("n_train_devices"))


def knn_three_config(train_raw: DataFrame, test_raw: DataFrame, source: str = "events") -> DataFrame:
    """M7 / M10 with the kNN classifier: all features / top-2 / top-2 + SMOTE, one run record each.

    Ranking, scaling and SMOTE are fitted on the train rows only; test rows are only transformed.
    """
    ranked = feat.rank_features(feat.feature_importance(train_raw, TRAFFIC_FEATURES, "binary_target"), top_n=TOP_N)
    top = [r[0] for r in ranked.filter(F.col("selected")).orderBy("rank").select("feature").collect()]
    sel = [f for f in TRAFFIC_FEATURES if f in set(top)]
    model = sc.fit_standard(train_raw, TRAFFIC_FEATURES)
    keep = ["row_key", "binary_target", *TRAFFIC_FEATURES]
    train = cut_lineage(model.transform(sc.narrow_to_float(train_raw, TRAFFIC_FEATURES)).select(*keep))
    test = cut_lineage(model.transform(sc.narrow_to_float(test_raw, TRAFFIC_FEATURES)).select(*keep))
    bal = smote_op.smote(train, sel, "binary_target", "row_key", K, SEED)
    bal = cut_lineage(bal.withColumn("row_key", F.coalesce(F.col("row_key"), -1 - F.col("syn_id"))))
    configs = [("all_features", TRAFFIC_FEATURES, train), (f"top{TOP_N}", sel, train),
               (f"top{TOP_N}_smote", sel, bal)]
    rows = []
    for name, feats, refs in configs:
        n_refs = refs.count()
        pred = cut_lineage(knn.knn_classify(refs, test, feats, K, "binary_target", "row_key", sizes=(test.count(), n_refs))
                           .select("row_key", "binary_target", "predicted"))
        m = met.binary_metrics(pred, "binary_target", "predicted")
        digest = runs_op.ordered_digest(pred, ["row_key"], "binary_target").first()["digest"]
        rows.append(m.select(F.lit(name).alias("config"), F.lit(len(feats)).alias("n_features"), F.lit(" ".join(feats)).alias("features"),
                             F.lit(n_refs).cast("bigint").alias("train_rows"), F.lit(source).alias("test_source"), F.lit(digest).alias("test_labels"),
                             "tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1", "macro_f1"))
    return reduce(DataFrame.unionByName, rows)


def _three_split(spark, sf_dir) -> DataFrame:
    split = traffic_split(spark, sf_dir)
    return knn_three_config(split.filter(F.col("split") == sp.TRAIN), split.filter(F.col("split") == sp.TEST))


def q_knn_three_config(spark, sf_dir):
    """M7 with the kNN classifier on the stratified split: all features / top-2 / top-2 + SMOTE."""
    return rounded(_three_split(spark, sf_dir).drop("features", "test_source", "test_labels"))


def q_experiment_run_checks(spark, sf_dir):
    """V2 over the three-configuration runs: features and their order, one test source, one label digest, rows and counts."""
    return checks.cross_run_checks(_three_split(spark, sf_dir), len(TRAFFIC_FEATURES), TOP_N)


def q_transfer_three_config(spark, sf_dir):
    """M10, three variants: train on device 1's ordered-train part, test on all of device 2."""
    return rounded(knn_three_config(*transfer_parts(spark, sf_dir)).drop("features", "test_source", "test_labels"))


def q_nested_lodo_checks(spark, sf_dir):
    """V5 of the leak-free leave-one-device-out runs: every device held out once, its rows all scored, distinct known features."""
    t = traffic(spark, sf_dir)
    ranks = feat.rank_features(feat.holdout_importance(t, TRAFFIC_FEATURES, "binary_target", "device_id"), ["fold"])
    chosen = cut_lineage(ranks.filter(F.col("rank") <= TOP_N).select("fold", "feature"))
    pred, scalers = folds.holdout_knn(t, TRAFFIC_FEATURES, "device_id", k=K, selected=chosen)
    names = chosen.groupBy("fold").agg(F.array_join(F.sort_array(F.collect_list("feature")), " ").alias("selected"))
    sizes = t.groupBy(F.col("device_id").alias("fold")).agg(F.count(F.lit(1)).alias("n"))
    ids = [r["fold"] for r in sizes.select("fold").collect()]  # one row per device
    trained = sizes.select("fold", F.filter(F.lit(ids), lambda o: o != F.col("fold")).alias("train_folds"))
    records = folds.fold_counts(pred, scalers).join(names, "fold").join(trained, "fold")
    return checks.fold_checks(records, sizes, TRAFFIC_FEATURES, TOP_N).withColumn("fold", F.col("fold").cast("int"))


# ------------------------------------------------------------------ models (rows-only checks)
def q_rf_importance(spark, sf_dir):
    """M1 + M3 + W1: forest impurity importances of the traffic features (train split)."""
    train = traffic_split(spark, sf_dir).filter(F.col("split") == sp.TRAIN)
    return exp.rf_importance(train, TRAFFIC_FEATURES)


def q_rf_three_config(spark, sf_dir):
    """M7 (+ M1, M2, M4, M5): all features / top-2 / top-2 + scaling + SMOTE, forest metrics each."""
    s = traffic_split(spark, sf_dir)
    return rounded(exp.three_config(s.filter(F.col("split") == sp.TRAIN), s.filter(F.col("split") == sp.TEST),
                                    TRAFFIC_FEATURES, TOP_N, SEED))


def q_transfer_rf(spark, sf_dir):
    """M10 with forests, three variants, top features in rank order: device 1's ordered-train part against device 2."""
    train, test = transfer_parts(spark, sf_dir)
    return rounded(exp.three_config(train, test, TRAFFIC_FEATURES, TOP_N, SEED, order="rank"))


def q_transfer_rf_supports(spark, sf_dir):
    """M10 with forests, the rows SQL can check: features, train rows and class supports of the three variants."""
    train, test = transfer_parts(spark, sf_dir)
    out = exp.three_config(train, test, TRAFFIC_FEATURES, TOP_N, SEED, order="rank")
    return out.select("config", "n_features", F.col("train_rows").cast("bigint").alias("train_rows"),
                      (F.col("tn") + F.col("fp")).alias("benign_support"), (F.col("fn") + F.col("tp")).alias("attack_support"))


def q_lodo_rf(spark, sf_dir):
    """M8: leave-one-device-out forests on a global top-2 list ranked on all rows (leaky, as the reference)."""
    return exp.lodo_rf(traffic(spark, sf_dir), TRAFFIC_FEATURES, "device_id", top_n=TOP_N)


def q_nested_lodo(spark, sf_dir):
    """M9 + V5: leak-free leave-one-device-out with a per-fold selector forest (top 2)."""
    return exp.nested_lodo(traffic(spark, sf_dir), TRAFFIC_FEATURES, TOP_N, "device_id")


def q_other_models(spark, sf_dir):
    """Logistic regression, linear SVM, GBT and MLP on the stratified split."""
    s = cut_lineage(traffic_split(spark, sf_dir).select("row_key", "binary_target", "split", *TRAFFIC_FEATURES))  # read by scaler, fits, scores
    return exp.other_models(s.filter(F.col("split") == sp.TRAIN), s.filter(F.col("split") == sp.TEST),
                            TRAFFIC_FEATURES, SEED)


def q_isolation_forest(spark, sf_dir):
    """Isolation forest per device fitted on benign rows (100 trees, 256 samples), every row scored."""
    t = cut_lineage(traffic(spark, sf_dir).select("row_key", "device_id", "binary_target", *TRAFFIC_FEATURES))
    forest = iforest.fit_isolation_forest(t.filter(F.col("binary_target") == 0), TRAFFIC_FEATURES, "row_key",
                                          "device_id", n_trees=100, psi=256, seed=SEED)
    scored = iforest.score_isolation_forest(t, forest, TRAFFIC_FEATURES, "row_key", "device_id", psi=256,
                                           carry=["binary_target"])
    return scored.select(
        "row_key", "device_id", "binary_target", r6("mean_path").alias("mean_path"), r6("score").alias("score"))


# ------------------------------------------------------------------ stored tables
def q_roundtrip_partitions(spark, sf_dir):
    """S6 + S7: labeled rows written by device, device 3 replaced by its attack rows, and read back partition by partition.

    ``pruned``: the scan of one device reads that partition only. The folder is removed afterwards.
    """
    t = traffic(spark, sf_dir).select("row_key", "device_id", "binary_label", *TRAFFIC_FEATURES)
    place = scratch_folder(spark, "labeled")
    ingest.write_labeled(t, place)
    ingest.replace_partitions(t.filter((F.col("device_id") == 3) & (F.col("binary_label") == "attack")), place, "device_id")
    back = spark.read.parquet(place)
    three = back.filter(F.col("device_id") == 3)
    pruned = F.lit(ingest.is_pruned(three, "device_id") and not ingest.is_pruned(back, "device_id"))
    out = back.groupBy(F.col("device_id").cast("int").alias("device_id"), "binary_label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("row_key").cast("bigint").alias("keys"), r6(F.sum(F.col("value").cast("double"))).alias("value"))
    out = cut_lineage(out.withColumn("pruned", pruned))
    remove_folder(spark, place)
    return out


def q_roundtrip_json(spark, sf_dir):
    """S9 + S11: run records with nested structs, lists and maps as JSON and back, then as a CSV result and back."""
    runs = run_table(spark, sf_dir).withColumns({
        "counts": F.struct(F.col("n_orders").alias("orders"), F.struct(F.col("open_share").alias("open")).alias("share")),
        "prices": F.array("mean_price", "max_price"),
        "by_name": F.create_map(F.lit("total"), F.col("total_price"), F.lit("mean"), F.col("mean_price"))})
    record = runs.select("experiment", "run_id", "counts", "prices", "by_name")
    place = scratch_folder(spark, "records")
    ingest.write_run_records(record, f"{place}/json")
    back = spark.read.schema(record.schema).json(f"{place}/json")
    flat = back.select("experiment", "run_id", F.col("counts.orders").alias("orders"), r6("counts.share.open").alias("open_share"),
                       r6(F.get("prices", F.lit(1))).alias("max_price"), r6(F.element_at("by_name", "total")).alias("total_price"),
                       F.size("by_name").alias("n_names"))
    ingest.write_result_csv(flat, f"{place}/csv")
    out = cut_lineage(spark.read.schema(flat.schema).option("header", True).csv(f"{place}/csv"))
    remove_folder(spark, place)
    return out


def q_nonfinite_nested(spark, sf_dir):
    """P12 on nested columns: 1/discount and sqrt(tax - 0.04) inside a struct, an array and a map of lineitem rows."""
    li = read_table(spark, sf_dir, "lineitem")
    inv, sq = F.pow(F.col("l_discount"), F.lit(-1.0)), F.sqrt(F.col("l_tax") - F.lit(0.04))
    nested = li.select("l_orderkey", "l_linenumber",
                       F.struct(F.col("l_quantity").alias("quantity"), F.struct(inv.alias("inv"), F.array(sq, inv).alias("both")).alias("inner")).alias("rec"),
                       F.create_map(F.lit("inv"), inv, F.lit("sqrt"), sq).alias("by"))
    c = clean_nonfinite(nested)
    return c.select("l_orderkey", "l_linenumber", r6("rec.quantity").alias("quantity"), r6("rec.inner.inv").alias("inv"),
                    r6(F.get("rec.inner.both", F.lit(0))).alias("first"), r6(F.get("rec.inner.both", F.lit(1))).alias("second"),
                    F.size("rec.inner.both").alias("n_both"), r6(F.element_at("by", "inv")).alias("by_inv"), r6(F.element_at("by", "sqrt")).alias("by_sqrt"))


# ------------------------------------------------------------------ streaming
def q_stream_counts(spark, sf_dir):
    """Structured-streaming labeling of the events files with running counts per device and label."""
    from flowlab.streaming.label_stream import run_label_stream
    return run_label_stream(spark, sf_dir)


# ------------------------------------------------------------------ registry
QUERIES = {
    "label_events": q_label_events,
    "class_distribution": q_class_distribution,
    "device_summary": q_device_summary,
    "label_consistency": q_label_consistency,
    "ordered_split": q_ordered_split,
    "ordered_cut": q_ordered_cut,
    "split_summary": q_split_summary,
    "stratified_split": q_stratified_split,
    "library_split": q_library_split,
    "split_disjoint": q_split_disjoint,
    "scaler_params": q_scaler_params,
    "scale_apply": q_scale_apply,
    "minmax": q_minmax,
    "knn_join": q_knn_join,
    "knn_classify": q_knn_classify,
    "confusion": q_confusion,
    "binary_metrics": q_binary_metrics,
    "classification_report": q_classification_report,
    "lodo_knn": q_lodo_knn,
    "lodo_knn_global_top": q_lodo_knn_global_top,
    "nested_lodo_knn": q_nested_lodo_knn,
    "lodo_pooled": q_lodo_pooled,
    "hardest_devices": q_hardest_devices,
    "transfer_knn": q_transfer_knn,
    "family_holdout": q_family_holdout,
    "attack_type_holdout": q_attack_type_holdout,
    "smote": q_smote,
    "smote_balanced": q_smote_balanced,
    "multiclass_smote": q_multiclass_smote,
    "multiclass_report": q_multiclass_report,
    "auc": q_auc,
    "lof": q_lof,
    "lof_benign": q_lof_benign,
    "knn_approx": q_knn_approx,
    "run_summary_pop": q_run_summary_pop,
    "run_summary_sample": q_run_summary_sample,
    "change_table": q_change_table,
    "run_vs_prior": q_run_vs_prior,
    "golden_match": q_golden_match,
    "snapshot_diff": q_snapshot_diff,
    "fingerprint": q_fingerprint,
    "label_digest": q_label_digest,
    "leakage_check": q_leakage_check,
    "runtime_table": q_runtime_table,
    "summary_table": q_summary_table,
    "experiment_table": q_experiment_table,
    "run_checks": q_run_checks,
    "cross_run_checks": q_cross_run_checks,
    "eda_counts": q_eda_counts,
    "eda_features": q_eda_features,
    "eda_quantiles": q_eda_quantiles,
    "quality": q_quality,
    "duplicates": q_duplicates,
    "regex_timing": q_regex_timing,
    "row_expectation": q_row_expectation,
    "feature_rank": q_feature_rank,
    "feature_rank_wide": q_feature_rank_wide,
    "wide_three_config": q_wide_three_config,
    "feature_sets": q_feature_sets,
    "select_top": q_select_top,
    "fold_stats": q_fold_stats,
    "feature_stability": q_feature_stability,
    "rank_pivot": q_rank_pivot,
    "union_sources": q_union_sources,
    "nonfinite_null": q_nonfinite_null,
    "list_strings": q_list_strings,
    "knn_three_config": q_knn_three_config,
    "transfer_three_config": q_transfer_three_config,
    "experiment_run_checks": q_experiment_run_checks,
    "nested_lodo_checks": q_nested_lodo_checks,
    "roundtrip_partitions": q_roundtrip_partitions,
    "roundtrip_json": q_roundtrip_json,
    "nonfinite_nested": q_nonfinite_nested,
    "rf_importance": q_rf_importance,
    "rf_three_config": q_rf_three_config,
    "transfer_rf": q_transfer_rf,
    "transfer_rf_supports": q_transfer_rf_supports,
    "lodo_rf": q_lodo_rf,
    "nested_lodo": q_nested_lodo,
    "other_models": q_other_models,
    "stream_counts": q_stream_counts,
    "isolation_forest": q_isolation_forest,
}

FLAGSHIP = q_binary_metrics
