"""Skew-safe 0-based row position within a group, in a given order.

``row_number() over (partition by g order by o)`` sends a whole group to one
task; if one group holds a third of all rows, that task holds a third of the
data. Here the rows are range-partitioned on (g, o) instead, so a hot group is
cut across many partitions by the sampled range bounds. Within a partition,
``monotonically_increasing_id`` numbers rows in sorted order; a small
per-(partition, group) table of counts turns that into a global position
through a prefix sum. The order columns must make the order total (include a
unique key). The tagged rows are checkpointed (reliable checkpoint in
``spark.checkpoint.dir``) so that every reader, and every retry after an
executor loss, sees the same ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.session import broadcast_if_small, cut_lineage

_LOW33 = (1 << 33) - 1


def positions_within(df: DataFrame, group_cols: list[str], order_cols: list[str],
                     pos_col: str = "pos", n_partitions: int | None = None,
                     size_col: str | None = None) -> DataFrame:
    """Add ``pos_col`` (0-based position in the group); with ``size_col`` also the group size."""
    spark = df.sparkSession
    n_parts = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group_cols, *order_cols]
    tagged = (df.repartitionByRange(n_parts, *keys)
              .sortWithinPartitions(*keys)
              .withColumn("_mid", F.monotonically_increasing_id())
              .withColumn("_pid", F.shiftright("_mid", 33))
              .withColumn("_i", F.col("_mid").bitwiseAND(F.lit(_LOW33))))
    # The ids are read by two branches (stats and rows). Each branch would sample
    # its own range bounds, so the tagged rows are written once to the shared
    # checkpoint folder and both branches (and any retry) read the same ids.
    tagged = cut_lineage(tagged)
    stats = (tagged.groupBy("_pid", *group_cols)
             .agg(F.min("_i").alias("_i0"), F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_n").over(Window.partitionBy(*group_cols)).alias(size_col)] if size_col else []
    stats = stats.select("_pid", *group_cols, "_i0",
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), *extra)
    # At most (partitions + groups) rows: sorted ranges give each partition a run of groups.
    stats = broadcast_if_small(stats.select(*[F.col(c).alias("_s_" + c) for c in stats.columns]))
    cond = [tagged["_pid"] == stats["_s__pid"]] + [tagged[g].eqNullSafe(stats["_s_" + g]) for g in group_cols]
    out = tagged.join(stats, cond).withColumn(pos_col, F.col("_s__off") + F.col("_i") - F.col("_s__i0"))
    if size_col:
        out = out.withColumnRenamed("_s_" + size_col, size_col)
    return out.drop("_mid", "_pid", "_i", *[c for c in out.columns if c.startswith("_s_")])


def running_totals(df: DataFrame, order_col: str, value_cols: list[str], prefix: str = "below_",
                   n_partitions: int | None = None) -> DataFrame:
    """Exclusive running sums of ``value_cols`` in ascending ``order_col`` (unique values).

    No global window: rows are range-partitioned and sorted, each partition
    computes its local cumulative sums (Arrow batches, ``mapInPandas``), and a
    broadcast table of per-partition totals (one row per partition) supplies the
    offsets. Adds ``prefix + col`` = sum of the column over all rows ordered before.
    """
    from pyspark.sql import types as T

    spark = df.sparkSession
    n_parts = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n_parts, order_col).sortWithinPartitions(order_col)
              .withColumn("_pid", F.spark_partition_id()))
    ranged = cut_lineage(ranged)
    totals = ranged.groupBy("_pid").agg(*[F.sum(c).alias("_t_" + c) for c in value_cols])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = broadcast_if_small(totals.select(
        "_pid", *[F.coalesce(F.sum("_t_" + c).over(before), F.lit(0)).alias("_o_" + c) for c in value_cols]))
    out_fields = list(ranged.schema.fields) + [T.StructField("_l_" + c, T.DoubleType()) for c in value_cols]
    schema = T.StructType(out_fields)

    def local(it):
        carry = {c: 0.0 for c in value_cols}
        pid = None
        for pdf in it:
            if pdf.empty:
                continue
            if pid is None or pdf["_pid"].iloc[0] != pid:
                pid = pdf["_pid"].iloc[0]
                carry = {c: 0.0 for c in value_cols}
            for c in value_cols:
                v = pdf[c].astype("float64")
                cs = v.cumsum()
                pdf["_l_" + c] = cs - v + carry[c]
                carry[c] += float(v.sum())
            yield pdf

    loc = ranged.mapInPandas(local, schema)
    out = loc.join(offsets, "_pid")
    for c in value_cols:
        out = out.withColumn(prefix + c, F.col("_o_" + c).cast("double") + F.col("_l_" + c))
    return out.drop("_pid", *["_o_" + c for c in value_cols], *["_l_" + c for c in value_cols])
