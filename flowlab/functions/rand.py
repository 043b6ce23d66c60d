"""Seeded, partition-independent random draws as plain column expressions.

Every draw is a function of (seed, salt, key): the first 32 bits of
md5('seed:salt:key'). The value does not depend on partitioning, task order,
retries or the engine (the same expression runs in DuckDB), which makes
splits and SMOTE reproducible and checkable against SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0
TWO_52 = 4503599627370496.0


def _as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def hash32(seed: int, salt: str, *keys) -> Column:
    """Unsigned 32-bit integer (as BIGINT) from md5 of 'seed:salt:key...'."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(salt), *[_as_col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int, salt: str, *keys) -> Column:
    """Uniform draw in [0, 1)."""
    return hash32(seed, salt, *keys) / F.lit(TWO_32)


def uniform52(seed: int, salt: str, *keys) -> Column:
    """Uniform draw in [0, 1) of 52 bits, for picking among more than some hundred million rows."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(salt), *[_as_col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(TWO_52)


def hash32_sql(seed: int, salt: str, *key_sql: str) -> str:
    """DuckDB text of :func:`hash32` (used by the oracle queries)."""
    keys = ", ".join(key_sql)
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', '{salt}', {keys})), 1, 8))::BIGINT"


def uniform_sql(seed: int, salt: str, *key_sql: str) -> str:
    return f"({hash32_sql(seed, salt, *key_sql)} / 4294967296.0)"


def uniform52_sql(seed: int, salt: str, *key_sql: str) -> str:
    """DuckDB text of :func:`uniform52`."""
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', '{salt}', {', '.join(key_sql)})), 1, 13))::BIGINT / 4503599627370496.0)"
