"""Data-quality and EDA operators.

All of them are aggregations; duplicates are found by grouping on the full
feature tuple (map-side partial aggregation keeps a hot duplicate group from
landing whole in one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.functions.exprs import stacked
from flowlab.operators.selection import exact_quantiles


def eda_counts(df: DataFrame, group_a: str, group_b: str) -> DataFrame:
    """Row counts for GROUPING SETS ((), (a), (b), (a, b)); rolled-up keys shown as 'ALL', null keys as null."""
    g = df.groupingSets([[], [group_a], [group_b], [group_a, group_b]], group_a, group_b)
    out = g.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"),
                F.grouping(group_a).alias("_ga"), F.grouping(group_b).alias("_gb"))
    return out.select(F.when(F.col("_ga") == 1, F.lit("ALL")).otherwise(F.col(group_a).cast("string")).alias(group_a),
                      F.when(F.col("_gb") == 1, F.lit("ALL")).otherwise(F.col(group_b).cast("string")).alias(group_b),
                      "level", "n")


def eda_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Per feature count, nulls, mean, sample std, min, max (one pass, unpivoted)."""
    aggs = []
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        aggs += [F.count(x).alias(f"c{i}"), F.count_if(x.isNull()).alias(f"z{i}"), F.avg(x).alias(f"m{i}"),
                 F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    wide = df.agg(*aggs)
    return stacked(wide, [[F.lit(f).alias("feature"), F.col(f"c{i}").alias("n"), F.col(f"z{i}").alias("n_null"),
                           F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"),
                           F.col(f"hi{i}").alias("max")] for i, f in enumerate(features)])


def nonfinite_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """Per feature nulls, NaN and +/-inf counts (one pass)."""
    aggs = []
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        aggs += [F.count_if(x.isNull()).alias(f"z{i}"), F.count_if(F.isnan(x)).alias(f"nan{i}"),
                 F.count_if(F.abs(x) == F.lit(float("inf"))).alias(f"inf{i}")]
    wide = df.agg(*aggs)
    return stacked(wide, [[F.lit(f).alias("feature"), F.col(f"z{i}").alias("n_null"), F.col(f"nan{i}").alias("n_nan"),
                           F.col(f"inf{i}").alias("n_inf")] for i, f in enumerate(features)])


def duplicate_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exact duplicate rows over ``cols``: groups with copies, surplus copies, total rows."""
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.sum("_n").cast("bigint").alias("rows"),
                 F.count(F.lit(1)).alias("distinct_rows"),
                 F.count_if(F.col("_n") > 1).alias("duplicate_groups"),
                 F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).cast("bigint").alias("surplus_rows"))


def checks_table(named: dict[str, Column], source: DataFrame) -> DataFrame:
    """V1 / V2: named boolean checks evaluated in one aggregation, returned as (check, passed) rows."""
    wide = source.agg(*[expr.alias(f"_c{i}") for i, expr in enumerate(named.values())])
    return stacked(wide, [[F.lit(name).alias("check"), F.col(f"_c{i}").alias("passed")] for i, name in enumerate(named)])


def list_set_compare(a: Column, b: Column) -> dict[str, Column]:
    """U4: set equality and subset relations of two string arrays."""
    return {
        "a_minus_b": F.size(F.array_except(a, b)),
        "b_minus_a": F.size(F.array_except(b, a)),
        "same_set": (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0),
        "a_subset_of_b": F.size(F.array_except(a, b)) == 0,
    }


def eda_quantiles(df: DataFrame, features: list[str], probs: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Exact quantiles per feature (the ceil(p n)-th smallest value), one column per probability, at any size."""
    names = [f"q{int(round(p * 100))}" for p in probs]
    long = exact_quantiles(df, features, probs)
    cols = [F.max(F.when(F.col("prob") == float(p), F.col("value"))).alias(n) for p, n in zip(probs, names)]
    return long.groupBy("feature").agg(*cols)
