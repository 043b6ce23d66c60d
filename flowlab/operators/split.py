"""Train/test splits (W3, W4, W5), hold-out folds (P17, J2, X9) and split checks.

All splits add a ``split`` column ('train' | 'test') to the input rows, so the
pair stays one table (write it with ``partitionBy('split')``).

W4 / W5 select, per class, the ``q_c`` rows with the smallest seeded hash
``h = md5(seed:salt:key)`` (ties by key): a uniformly random subset of exact
size, independent of partitioning. The selection does not rank a whole class
in one task: rows are counted per (class, top bits of h); that one table gives
the class sizes, the quotas and, by prefix sums, the bucket holding the cut of
every class; rows below it are test, rows above it train, and only the rows in
the cut bucket (about n_c / 2^bits) are ranked. Rows with a null class are a
class of their own with its quota.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.functions.rand import hash32
from flowlab.operators.position import positions_within
from flowlab.operators.selection import kth_values
from flowlab.session import broadcast_if_small, cut_lineage

TRAIN = "train"
TEST = "test"


# ---------------------------------------------------------------- quotas (small tables)
def per_class_round_quota(counts: DataFrame, class_col: str, test_fraction: float) -> DataFrame:
    """W4 rule: q_c = round-half-even(n_c * f) for each class."""
    return counts.select(class_col, "n",
                         F.bround(F.col("n").cast("double") * F.lit(float(test_fraction)), 0)
                         .cast("bigint").alias("q"))


def largest_remainder_quota(counts: DataFrame, class_col: str, test_fraction: float) -> DataFrame:
    """W5 rule: n_test = ceil(N f); train seats by largest remainder; q_c = n_c - train_c.

    Equal remainders are resolved by class value ascending (deterministic).
    """
    w_all = Window.partitionBy()
    c = counts.withColumn("_total", F.sum("n").over(w_all))
    c = c.withColumn("n_test", F.ceil(F.col("_total").cast("double") * F.lit(float(test_fraction))).cast("bigint"))
    c = c.withColumn("n_train", F.col("_total") - F.col("n_test"))
    c = c.withColumn("cont", F.col("n").cast("double") * F.col("n_train") / F.col("_total"))
    c = c.withColumn("fl", F.floor("cont").cast("bigint"))
    c = c.withColumn("rem", F.col("cont") - F.col("fl"))
    c = c.withColumn("short", F.col("n_train") - F.sum("fl").over(w_all))
    c = c.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("rem"), F.asc(class_col))))
    c = c.withColumn("train_c", F.col("fl") + F.when(F.col("rk") <= F.col("short"), 1).otherwise(0))
    return c.select(class_col, "n", (F.col("n") - F.col("train_c")).cast("bigint").alias("q"))


BITS = 18  # top bits of the draw that the rows are counted by


def quota_split(df: DataFrame, class_col: str, key_col: str, test_fraction: float = 0.2,
                seed: int = 42, rule: str = "per_class_round", salt: str = "split") -> DataFrame:
    """Exact-quota stratified split (W4 with rule='per_class_round', W5 with 'largest_remainder')."""
    hashed = df.withColumn("_h", hash32(seed, salt, key_col)).withColumn("_b", F.shiftright("_h", 32 - BITS))
    hist = cut_lineage(hashed.groupBy(F.col(class_col).alias("_cls"), "_b").agg(F.count(F.lit(1)).alias("_nb")))
    counts = hist.groupBy(F.col("_cls").alias(class_col)).agg(F.sum("_nb").alias("n"))
    if rule == "per_class_round":
        quotas = per_class_round_quota(counts, class_col, test_fraction)
    elif rule == "largest_remainder":
        quotas = largest_remainder_quota(counts, class_col, test_fraction)
    else:
        raise ValueError(f"unknown quota rule {rule!r}")

    upto = Window.partitionBy("_cls").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("_cum", F.sum("_nb").over(upto))
    cut = (cum.join(broadcast_if_small(quotas), F.col("_cls").eqNullSafe(F.col(class_col)))
           .filter(F.col("_cum") >= F.col("q"))
           .groupBy("_cls")
           .agg(F.min_by(F.struct("_b", (F.col("q") - F.col("_cum") + F.col("_nb")).alias("_need")), "_b")
                .alias("_c"))
           .select("_cls", F.col("_c._b").alias("_cut"), F.col("_c._need").alias("_need")))
    cut = broadcast_if_small(cut)  # one row per class

    joined = hashed.join(cut, hashed[class_col].eqNullSafe(cut["_cls"])).drop("_cls")
    rest = (joined.filter(F.col("_b") != F.col("_cut"))
            .withColumn("split", F.when(F.col("_b") < F.col("_cut"), F.lit(TEST)).otherwise(F.lit(TRAIN))))
    in_cut = joined.filter(F.col("_b") == F.col("_cut"))
    rn = F.row_number().over(Window.partitionBy(class_col).orderBy("_h", key_col))
    in_cut = in_cut.withColumn("split", F.when(rn <= F.col("_need"), F.lit(TEST)).otherwise(F.lit(TRAIN)))
    return rest.unionByName(in_cut).drop("_h", "_b", "_cut", "_need")


def stratified_split(df: DataFrame, class_col: str = "binary_target", key_col: str = "row_key",
                     test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Per-class quota round(n_c * f), uniformly random rows per class."""
    return quota_split(df, class_col, key_col, test_fraction, seed, "per_class_round")


def library_split(df: DataFrame, class_col: str = "binary_target", key_col: str = "row_key",
                  test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Test size ceil(N f), class seats by largest remainder."""
    return quota_split(df, class_col, key_col, test_fraction, seed, "largest_remainder")


def ordered_split(df: DataFrame, group_col: str = "source_file", order_cols: list[str] | None = None,
                  train_ratio: float = 0.8) -> DataFrame:
    """Per source, the first floor(n * ratio) rows in source order are train, the rest test."""
    order_cols = order_cols or ["ts", "row_key"]
    pos = positions_within(df, [group_col], order_cols, pos_col="row_pos", size_col="_n")
    cut = F.floor(F.col("_n").cast("double") * F.lit(float(train_ratio)))
    return (pos.withColumn("split", F.when(F.col("row_pos") < cut, F.lit(TRAIN)).otherwise(F.lit(TEST)))
            .drop("_n"))


def ordered_cut(df: DataFrame, group_col: str = "source_file", time_col: str = "ts", key_col: str = "row_key",
                train_ratio: float = 0.8) -> DataFrame:
    """W3 without positions: the same split as :func:`ordered_split` over (time, key), by two cut values per source.

    The floor(n * ratio)-th row of a source in the order of (time, key) is found
    by refined histograms (:func:`flowlab.operators.selection.kth_values`): first
    the time at the cut, then, among the rows of that time, the key. Only (source,
    time, key) are read by the counting passes, no data is sorted, shuffled or
    stored, and a hot source is counted where its rows are. A row is train if
    its (time, key) does not lie behind the cut.

    Times are timestamps or numbers, keys are integers, unique within a source
    and time. A null time stands in front; a null source is a source.
    """
    timed = dict(df.dtypes)[time_col] in ("timestamp", "timestamp_ntz", "date")
    t = F.unix_micros(F.col(time_col).cast("timestamp")) if timed else F.col(time_col)
    whole = timed or dict(df.dtypes)[time_col] in ("tinyint", "smallint", "int", "bigint")
    kind = "long" if whole else "double"
    first = F.lit(-(1 << 62)).cast("long") if whole else F.lit(float("-inf"))
    rows = df.select(F.col(group_col).alias("g"), F.coalesce(t.cast(kind), first).alias("x"), F.col(key_col).cast("long").alias("_key"))
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    wants = sizes.select(F.lit(0).alias("w"), "g", F.floor(F.col("n").cast("double") * F.lit(float(train_ratio))).cast("long").alias("need"))
    times = broadcast_if_small(kth_values(rows.select("g", "x"), wants.where("need > 0")).select(F.col("g").alias("_tg"), F.col("value").alias("_t"), "rest"))
    at = rows.join(times, F.col("g").eqNullSafe(F.col("_tg"))).where(F.col("x") == F.col("_t"))
    keys = kth_values(at.select("g", F.col("_key").alias("x")), times.select(F.lit(0).alias("w"), F.col("_tg").alias("g"), F.col("rest").alias("need")))
    cuts = times.join(keys.select(F.col("g").alias("_kg"), F.col("value").alias("_k")), F.col("_tg").eqNullSafe(F.col("_kg"))).select("_tg", "_t", "_k")
    out = df.withColumn("_x", F.coalesce(t.cast(kind), first)).join(broadcast_if_small(cuts), F.col(group_col).eqNullSafe(F.col("_tg")), "left")
    train = (F.col("_x") < F.col("_t")) | ((F.col("_x") == F.col("_t")) & (F.col(key_col) <= F.col("_k")))
    return out.withColumn("split", F.when(F.coalesce(train, F.lit(False)), F.lit(TRAIN)).otherwise(F.lit(TEST))).drop("_x", "_tg", "_t", "_k")


def ordered_split_by_position(df: DataFrame, group_col: str = "source_file", pos_col: str = "row_pos",
                              train_ratio: float = 0.8) -> DataFrame:
    """W3 when positions were stored at ingest: no sort, no window.

    The split is a filter against per-source row counts: one aggregation whose
    result has one row per source (size-checked broadcast) and one narrow pass.
    """
    sizes = broadcast_if_small(df.groupBy(F.col(group_col).alias("_grp")).agg(F.count(F.lit(1)).alias("_n")))
    cut = F.floor(F.col("_n").cast("double") * F.lit(float(train_ratio)))
    return (df.join(sizes, df[group_col].eqNullSafe(sizes["_grp"])).drop("_grp")
            .withColumn("split", F.when(F.col(pos_col) < cut, F.lit(TRAIN)).otherwise(F.lit(TEST)))
            .drop("_n"))


def source_split_summary(split_df: DataFrame, group_col: str = "source_file") -> DataFrame:
    """A4: per source total / train / test rows and its label."""
    return (split_df.groupBy(group_col)
            .agg(F.count(F.lit(1)).alias("total_rows"),
                 F.count_if(F.col("split") == TRAIN).alias("train_rows"),
                 F.count_if(F.col("split") == TEST).alias("test_rows"),
                 F.min("binary_label").alias("binary_label")))


def holdout_fold(df: DataFrame, fold_col: str, fold_value) -> tuple[DataFrame, DataFrame]:
    """(train = rows of every other group, test = rows of the held-out group)."""
    train = df.filter(~F.col(fold_col).eqNullSafe(F.lit(fold_value)))
    test = df.filter(F.col(fold_col).eqNullSafe(F.lit(fold_value)))
    return train, test


def split_check(split_df: DataFrame, input_df: DataFrame, key_col: str = "row_key") -> DataFrame:
    """Train and test are disjoint and together equal the input (one row of counts).

    One keyed full outer join of per-key split counts with the input keys, then
    one aggregation; both sides are shuffled on the key only.
    """
    per_key = (split_df.groupBy(key_col)
               .agg(F.count_if(F.col("split") == TRAIN).alias("_tr"),
                    F.count_if(F.col("split") == TEST).alias("_te")))
    inp = input_df.groupBy(key_col).agg(F.count(F.lit(1)).alias("_in"))
    j = per_key.join(inp, key_col, "full_outer")
    out = j.agg(
        F.coalesce(F.sum("_tr"), F.lit(0)).cast("bigint").alias("train_rows"),
        F.coalesce(F.sum("_te"), F.lit(0)).cast("bigint").alias("test_rows"),
        F.coalesce(F.sum("_in"), F.lit(0)).cast("bigint").alias("input_rows"),
        F.count_if((F.col("_tr") > 0) & (F.col("_te") > 0)).alias("overlap"),
        F.count_if(F.col("_in").isNotNull() & F.col("_tr").isNull()).alias("missing"),
        F.count_if(F.col("_in").isNull()).alias("extra"),
        F.count_if((F.col("_tr") + F.col("_te")) > 1).alias("duplicated"),
    )
    return out.withColumn("ok", (F.col("overlap") == 0) & (F.col("missing") == 0) & (F.col("extra") == 0)
                          & (F.col("duplicated") == 0)
                          & (F.col("train_rows") + F.col("test_rows") == F.col("input_rows")))
