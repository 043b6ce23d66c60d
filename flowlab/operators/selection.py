"""Exact order statistics by refined histograms (W3 cut points, X1 quantiles): counting passes instead of a sort.

A wanted rank starts with the range of all values of its group. Each pass
counts the rows of the live ranges in ``BINS`` equal bins (one aggregation for
all groups and ranks), keeps the bin that holds the rank and tightens the range
to the smallest and largest value in it. A range of one value is the answer.
Ranges shrink by the number of bins or faster, so a few passes over the narrow
(group, value) rows suffice; the tables between the passes have one row per
wanted rank. Nothing is sorted, and memory does not depend on the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.session import broadcast_if_small, cut_lineage

BINS = 4096
MAX_PASSES = 400  # a pass gains a factor of BINS, so doubles of any spread need far fewer


def kth_values(rows: DataFrame, wants: DataFrame) -> DataFrame:
    """(w, g, need) wants over rows (g, x) -> (w, g, value, rest): the need-th smallest x of group g, counted from 1.

    ``rest`` is the rank among the rows equal to ``value``. x is numeric and not
    null or NaN (such rows are left out); integers of a group span less than 2^63.
    Groups match with null equal to null.
    A want below 1 or beyond the rows of its group has no row.
    """
    kind = rows.schema["x"].dataType.simpleString()
    live_rows = rows.where(F.col("x").isNotNull() & ~F.isnan(F.col("x").cast("double")))
    size = live_rows.groupBy(F.col("g").alias("_g")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("_n"))
    state = (wants.select("w", "g", F.col("need").cast("long").alias("need"))
             .join(broadcast_if_small(size), F.col("g").eqNullSafe(F.col("_g"))).where("need between 1 and _n").select("w", "g", "need", "lo", "hi"))
    state = cut_lineage(state)
    for _ in range(MAX_PASSES):
        live = state.where("lo < hi")
        if live.isEmpty():
            return state.select("w", "g", F.col("lo").alias("value"), F.col("need").alias("rest"))
        spans = broadcast_if_small(live.select(F.col("g").alias("_g"), "lo", "hi").distinct())
        if kind in ("tinyint", "smallint", "int", "bigint"):  # differences of integers are exact
            far, width = (F.col("x").cast("long") - F.col("lo").cast("long")).cast("double"), (F.col("hi").cast("long") - F.col("lo").cast("long")).cast("double") / BINS
        else:  # in halves, so that a range over all doubles does not overflow
            far, width = F.col("x").cast("double") / 2 - F.col("lo").cast("double") / 2, (F.col("hi").cast("double") / 2 - F.col("lo").cast("double") / 2) / BINS
        place = F.floor(F.nanvl(far / F.when(width > 0, width).otherwise(F.lit(1.0)), F.lit(0.0)))
        found = live_rows.join(spans, F.col("g").eqNullSafe(F.col("_g"))).where("x between lo and hi")
        # the ends have bins of their own: an infinite end, or one far from all others, goes in one pass
        bins = found.select("_g", "lo", "hi", "x", F.when(F.col("x") == F.col("hi"), F.lit(BINS)).when(F.col("x") == F.col("lo"), F.lit(-1)).otherwise(
            F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1))).cast("int").alias("bin"))
        hist = bins.groupBy("_g", "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
        upto = Window.partitionBy("_g", "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("upto", F.sum("n").over(upto)).withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
        same = F.col("g").eqNullSafe(F.col("_g")) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi"))
        step = live.join(hist, same).where("need > upto - n and need <= upto").select(
            "w", "g", (F.col("need") - F.col("upto") + F.col("n")).alias("need"), F.col("a").cast(kind).alias("lo"), F.col("b").cast(kind).alias("hi"))
        state = cut_lineage(state.where("lo >= hi").unionByName(step))
    raise RuntimeError(f"order statistics: ranges did not close in {MAX_PASSES} passes")


def exact_quantiles(df: DataFrame, features: list[str], probs: tuple[float, ...]) -> DataFrame:
    """(feature, prob, value): the ceil(p n)-th smallest value (the first for p = 0) of every feature, exact at any size.

    Null and NaN values do not count; a feature without values has null.
    """
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("g"), F.col(f).cast("double").alias("x")) for f in features])).alias("r")).select("r.g", "r.x")
    sizes = rows.where(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]))
    wants = sizes.select("g", "n", asked.alias("q")).select(
        F.concat_ws("/", "g", F.col("q.i").cast("string")).alias("w"), "g", F.greatest(F.ceil(F.col("n") * F.col("q.p")), F.lit(1)).alias("need"))
    found = kth_values(rows, wants).select("w", "value")
    every = [F.struct(F.lit(f).alias("feature"), F.lit(float(p)).alias("prob"), F.lit(f"{f}/{i}").alias("w")) for f in features for i, p in enumerate(probs)]
    grid = df.sparkSession.range(1).select(F.explode(F.array(*every)).alias("e")).select("e.*")
    return grid.join(found, "w", "left").select("feature", "prob", "value")
