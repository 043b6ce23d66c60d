"""Rows of one part (split or fold) whose whole feature tuple also stands in another part.

1. Two 64-bit hashes of the feature tuple are grouped, with a flag per part;
   only hashes that stand in several parts go on. This shuffles hashes, not rows.
2. The rows behind them are grouped by the features themselves, so a collision
   of hashes is no leak. Both groupings combine before the shuffle, so many
   copies of one row cost one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.session import broadcast_if_small


def copies_across(df: DataFrame, features: list[str], part_col: str) -> DataFrame:
    """(part, rows, copied_rows, copied_tuples), one row per part.

    ``copied_rows``: rows of the part whose feature tuple equals that of a row of
    another part (null equals null, NaN equals NaN, 0.0 equals -0.0);
    ``copied_tuples``: distinct such tuples. A null part is a part.
    """
    h: list[Column] = [F.xxhash64(*features), F.xxhash64(F.lit("second"), *features)]
    rows = df.select(F.struct(F.col(part_col).alias("part")).alias("_p"), *features, h[0].alias("_h1"), h[1].alias("_h2"))
    spread = rows.groupBy("_h1", "_h2").agg(F.min("_p").alias("a"), F.max("_p").alias("b")).where(~F.col("a").eqNullSafe(F.col("b")))
    suspects = rows.join(broadcast_if_small(spread.select("_h1", "_h2")), ["_h1", "_h2"], "left_semi")
    per = suspects.groupBy(*features, "_p").agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("parts", F.count(F.lit(1)).over(Window.partitionBy(*features)))  # at most one row per part and tuple
    copied = per.where("parts > 1").groupBy("_p").agg(F.sum("n").alias("copied_rows"), F.count(F.lit(1)).alias("copied_tuples"))
    total = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("rows"))
    zero = F.lit(0).cast("long")
    return total.join(copied.withColumnRenamed("_p", "_q"), F.col("_p").eqNullSafe(F.col("_q")), "left").select(
        F.col("_p.part").alias("part"), "rows", F.coalesce("copied_rows", zero).alias("copied_rows"), F.coalesce("copied_tuples", zero).alias("copied_tuples"))
