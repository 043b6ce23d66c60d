"""Scalar helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def safe_ratio(num, den) -> Column:
    """num / den, or 0.0 when den is 0 or null (zero_division=0 semantics)."""
    return F.coalesce(F.try_divide(F.col(num) if isinstance(num, str) else num,
                                   F.col(den) if isinstance(den, str) else den).cast("double"), F.lit(0.0))


def pct_of_total(col: str, partition_cols: list[str] | None = None) -> Column:
    """P10: value * 100 / sum(value) over the partition (whole result by default).

    The window runs over an aggregated (small) result, never over raw rows.
    """
    w = Window.partitionBy(*partition_cols) if partition_cols else Window.partitionBy()
    return safe_ratio(F.col(col).cast("double") * 100.0, F.sum(col).over(w))


def stacked(wide: DataFrame, rows: list[list[Column]], keep: list[str] | None = None) -> DataFrame:
    """Turns each row of ``wide`` into len(rows) rows (named, equally typed columns), reading ``wide`` once."""
    keep = keep or []
    return (wide.select(*keep, F.explode(F.array(*[F.struct(*r) for r in rows])).alias("_row"))
            .select(*keep, "_row.*"))


def nonfinite_to_null(c) -> Column:
    """NaN and +/-inf become null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def nonfinite_to_null_deep(value: Column, kind: T.DataType) -> Column:
    """P12 on any type: every float inside structs, arrays and map values; all else, nulls included, stays as it is."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return nonfinite_to_null(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: nonfinite_to_null_deep(x, kind.elementType)) if _has_floats(kind.elementType) else value
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: nonfinite_to_null_deep(v, kind.valueType)) if _has_floats(kind.valueType) else value
    if isinstance(kind, T.StructType) and _has_floats(kind):
        fields = [nonfinite_to_null_deep(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _has_floats(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_floats(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_floats(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_has_floats(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.FloatType, T.DoubleType))


def clean_nonfinite(df: DataFrame) -> DataFrame:
    """Every column of the table, nested values included; names and types stay."""
    return df.select(*[nonfinite_to_null_deep(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def r6(c) -> Column:
    """Round a metric to 6 decimals as DOUBLE (shared output convention)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)
