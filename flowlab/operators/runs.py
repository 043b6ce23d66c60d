"""Run records, summaries, comparisons and result tables.

A run table has one row per (experiment, run) with numeric metric columns.
``runs_long`` unpivots it to (experiment, run, metric, value); every summary
is a groupBy over that long table, every comparison a keyed join on it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.functions.rand import hash32
from flowlab.operators.position import positions_within
from flowlab.session import broadcast_if_small, cut_lineage


def runs_long(runs: DataFrame, id_cols: list[str], metric_cols: list[str]) -> DataFrame:
    return runs.unpivot(id_cols, [F.col(c).cast("double").alias(c) for c in metric_cols], "metric", "value")


def summary_pop(long: DataFrame, group_cols: list[str]) -> DataFrame:
    """Runs, mean, min, max and population std (0 for a single run)."""
    return long.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("runs"), F.avg("value").alias("mean"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("std"))


# How a reported value came about.
NOT_MEASURED, SINGLE_RUN, MEAN_OF_RUNS = "not_measured_or_not_applicable", "single_measured_run", "arithmetic_mean"


def summary_sample(long: DataFrame, group_cols: list[str], run_col: str | None = None) -> DataFrame:
    """N non-null; one run -> reported = that value, mean/std null; more -> mean and sample std.

    With ``run_col`` also ``run_values``: the non-null values in the order of the
    runs (all of them null: the empty list). A group has as many as it has runs.
    """
    n = F.count("value")
    kind = F.when(n == 0, F.lit(NOT_MEASURED)).when(n == 1, F.lit(SINGLE_RUN)).otherwise(F.lit(MEAN_OF_RUNS))
    extra = []
    if run_col:
        each = F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct(F.col(run_col).alias("r"), F.col("value").alias("v")))))
        extra = [F.transform(each, lambda x: x["v"]).alias("run_values")]
    return long.groupBy(*group_cols).agg(
        n.alias("n"),
        F.when(n == 1, F.max("value")).when(n > 1, F.avg("value")).alias("reported_value"),
        kind.alias("reported_value_kind"),
        F.when(n > 1, F.avg("value")).alias("mean"),
        F.when(n > 1, F.stddev_samp("value")).alias("standard_deviation"),
        F.min("value").alias("minimum"), F.max("value").alias("maximum"), *extra)


def direction_change(ref: Column, cmp: Column) -> dict[str, Column]:
    """Absolute and signed percent change with direction; reference 0 -> percent null."""
    diff = cmp - ref
    signed = F.when(ref != 0, diff / ref * 100.0)
    direction = (F.when(diff < 0, F.lit("reduction")).when(diff > 0, F.lit("increase"))
                 .otherwise(F.lit("no_change")))
    return {
        "absolute_change": diff,
        "signed_percent_change": signed,
        "direction": direction,
        "reduction_percent": F.when(diff < 0, -signed).when(diff == 0, F.lit(0.0)),
        "increase_percent": F.when(diff > 0, signed).when(diff == 0, F.lit(0.0)),
    }


def metric_difference(ref: Column, cmp: Column) -> dict[str, Column]:
    """Absolute difference, percentage points, increase/decrease/no_change."""
    diff = cmp - ref
    return {
        "absolute_metric_difference": diff,
        "percentage_point_difference": diff * 100.0,
        "metric_direction": F.when(diff > 0, F.lit("increase")).when(diff < 0, F.lit("decrease"))
        .otherwise(F.lit("no_change")),
    }


def reduction_percent(base: Column, comp: Column) -> Column:
    """(b - c) / b * 100, 0 when b is 0."""
    return F.when(base != 0, (base - comp) / base * 100.0).otherwise(F.lit(0.0))


def speed_ratio(base: Column, comp: Column) -> dict[str, Column]:
    ratio = F.try_divide(base, comp)
    return {
        "ratio": ratio,
        "speed_direction": F.when(ratio > 1, F.lit("speedup")).when(ratio < 1, F.lit("slowdown")).otherwise(F.lit("same")),
    }


def compare_to_baseline(summary: DataFrame, exp_col: str, baseline: str, value_col: str = "value") -> DataFrame:
    """J5 + P13-P15: pair every candidate experiment with the baseline on the metric name."""
    base = summary.filter(F.col(exp_col) == baseline).select("metric", F.col(value_col).alias("reference_value"))
    cand = summary.filter(F.col(exp_col) != baseline).select(exp_col, "metric", F.col(value_col).alias("comparison_value"))
    j = cand.join(base, "metric")
    ref, cmp = F.col("reference_value"), F.col("comparison_value")
    cols = {**direction_change(ref, cmp), **metric_difference(ref, cmp),
            "reduction_pct": reduction_percent(ref, cmp), **speed_ratio(ref, cmp)}
    return j.withColumns(cols)


def pair_with_prior(current: DataFrame, prior: DataFrame, keys: list[str], value_cols: list[str]) -> DataFrame:
    """Left join of the new runs to the prior runs on the key; missing prior -> nulls."""
    p = prior.select(*keys, *[F.col(c).alias("prior_" + c) for c in value_cols])
    return current.select(*keys, *value_cols).join(p, keys, "left")


def golden_match(run_cells: DataFrame, golden_cells: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Full outer join of two confusion matrices; per cell match flag and overall exact flag."""
    a = run_cells.select(*keys, F.col(value).alias("run_n"))
    b = golden_cells.select(*keys, F.col(value).alias("golden_n"))
    j = a.join(b, keys, "full_outer").withColumn("match", F.col("run_n").eqNullSafe(F.col("golden_n")))
    return j.withColumn("all_match", F.bool_and("match").over(Window.partitionBy()))


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Created / removed / changed / unchanged keys between two states."""
    a = before.select(*keys, F.col(value).alias("before_value"), F.lit(True).alias("_in_before"))
    b = after.select(*keys, F.col(value).alias("after_value"), F.lit(True).alias("_in_after"))
    j = a.join(b, keys, "full_outer")
    status = (F.when(F.col("_in_before").isNull(), F.lit("created"))
              .when(F.col("_in_after").isNull(), F.lit("removed"))
              .when(F.col("before_value").eqNullSafe(F.col("after_value")), F.lit("unchanged"))
              .otherwise(F.lit("changed")))
    return j.withColumn("status", status).drop("_in_after", "_in_before")


def pivot_table(long: DataFrame, row_col: str, pivot_col: str, value_col: str, values: list[str]) -> DataFrame:
    """One row per experiment, one column per metric (pivot values given, so no extra pass)."""
    return long.groupBy(row_col).pivot(pivot_col, values).agg(F.first(value_col, ignorenulls=True))


def fingerprint(df: DataFrame, key_col: str, label_col: str, salt: str = "fp") -> DataFrame:
    """Order-free fingerprint of (key, label): rows, sum (modulo 2^62) and xor of a 32-bit hash per row."""
    h = hash32(0, salt, key_col, label_col)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.pmod(F.sum(h.cast("decimal(20,0)")), F.lit(1 << 62).cast("decimal(20,0)")).cast("bigint").alias("hash_sum"),
                  F.bit_xor(h).alias("hash_xor"))


def ordered_digest(df: DataFrame, order_cols: list[str], value_col: str, chunk: int = 4096) -> DataFrame:
    """SHA-256 of the values in order, as a tree: one row (rows, levels, digest).

    Rows get their position (:func:`positions_within`; the order must be total).
    The values of ``chunk`` positions in a row, joined by commas (null: the empty
    text), give a digest; the digests of ``chunk`` chunks in a row give the next
    level's, until one is left. No task orders more than a chunk. Any changed,
    swapped, added or lost value changes the digest; the layout of the rows does
    not. No rows: the digest of the empty text, no level.
    """
    rows = positions_within(df.select(*order_cols, F.col(value_col).cast("string").alias("_v")), [], order_cols, pos_col="_pos").select("_pos", "_v")
    n, levels = rows.count(), 0
    level, size = rows, n
    while size > 1 or levels == 0:
        part = F.expr(f"_pos div {chunk}").alias("_pos")
        values = F.transform(F.sort_array(F.collect_list(F.struct("_pos", F.coalesce("_v", F.lit("")).alias("_v")))), lambda x: x["_v"])
        level = cut_lineage(level.groupBy(part.alias("_part")).agg(values.alias("_l")).select(
            F.col("_part").alias("_pos"), F.sha2(F.array_join("_l", ",").cast("binary"), 256).alias("_v")))
        size, levels = -(-size // chunk), levels + 1
        if not n:
            break
    empty = hashlib.sha256(b"").hexdigest()
    return level.agg(F.coalesce(F.max("_v"), F.lit(empty)).alias("digest")).select(
        F.lit(n).cast("long").alias("rows"), F.lit(levels if n else 0).alias("levels"), "digest")


def bucketed_diff(before: DataFrame, after: DataFrame, key_col: str, value_cols: list[str], rows_per_bucket: int = 1000) -> tuple[DataFrame, DataFrame]:
    """J8 over whole tables: (differences (key, status, before_*, after_*), buckets that differ).

    Rows are dealt to buckets by a hash of the key. A bucket's digest is its row
    count and the sum and exclusive or of row hashes, one aggregation per state
    that shuffles one row per bucket and task. Only the rows of buckets whose
    digests differ are shuffled and joined by key; equal rows among them are left
    out. Keys are unique in a state; a null key is a key. Values compare with null
    equal to null; status is created, removed or changed.
    """
    n = max(before.count(), after.count())
    buckets = max(1, -(-n // rows_per_bucket))
    row = F.struct(key_col, *value_cols)

    def dealt(df: DataFrame) -> DataFrame:
        return df.select(key_col, *value_cols, F.pmod(F.xxhash64(key_col), F.lit(buckets)).alias("_bucket"))

    def digest(df: DataFrame, name: str) -> DataFrame:
        h = [F.xxhash64(row), F.xxhash64(F.lit("second"), row)]
        return df.groupBy(F.col("_bucket").alias(f"_{name}")).agg(
            F.struct(F.count(F.lit(1)).alias("n"), F.sum(h[0].cast("decimal(38,0)")).alias("s"), F.bit_xor(h[1]).alias("x")).alias(name))

    before, after = dealt(before), dealt(after)
    pair = digest(before, "b").join(digest(after, "a"), F.col("_b") == F.col("_a"), "full_outer")
    differing = broadcast_if_small(pair.where(~F.col("b").eqNullSafe(F.col("a"))).select(F.coalesce("_b", "_a").alias("_bucket")))
    sides = []
    for df, name in ((before, "before"), (after, "after")):
        sides.append(df.join(differing, "_bucket", "left_semi").select(F.struct(F.col(key_col).alias("k")).alias(f"_{name}"), *[F.col(c).alias(f"{name}_{c}") for c in value_cols]))
    j = sides[0].join(sides[1], F.col("_before.k").eqNullSafe(F.col("_after.k")), "full_outer")
    same = F.lit(True)
    for c in value_cols:
        same = same & F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}"))
    status = F.when(F.col("_before").isNull(), "created").when(F.col("_after").isNull(), "removed").when(~same, "changed")
    out = j.withColumn("status", status).where("status is not null")
    key = F.when(F.col("_before").isNull(), F.col("_after.k")).otherwise(F.col("_before.k")).alias(key_col)
    return out.select(key, "status", *[f"{side}_{c}" for side in ("before", "after") for c in value_cols]), differing
