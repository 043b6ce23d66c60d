"""Labels derived from traffic file names.

File names look like ``<device>.<family>[.<type>].csv``: the first dot token
is the device id, the second the traffic family. Family ``benign`` is class 0
("benign"), anything else class 1 ("attack").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the labeling rule.
BENIGN_FAMILY = "benign"
BENIGN_LABEL = "benign"
ATTACK_LABEL = "attack"
BENIGN_TARGET = 0
ATTACK_TARGET = 1


def device_id_from_name(name: Column) -> Column:
    """Digits before the first dot, as INT (null when the name has none)."""
    return F.regexp_extract(name, r"^(\d+)\.", 1).try_cast("int")


def family_from_name(name: Column) -> Column:
    return F.split_part(name, F.lit("."), F.lit(2))


def attack_type_from_name(name: Column) -> Column:
    """Third token when the name has four tokens (device.family.type.csv)."""
    n_tokens = F.size(F.split(name, r"\."))
    return F.when(n_tokens == 4, F.split_part(name, F.lit("."), F.lit(3)))


def label_traffic(df: DataFrame, name_col: str = "source_file") -> DataFrame:
    """P1 + P2 + P3 + X2: attach device, binary label/target and multiclass label."""
    name = F.col(name_col)
    fam = family_from_name(name)
    is_benign = fam == F.lit(BENIGN_FAMILY)
    atype = attack_type_from_name(name)
    return df.withColumns({
        "device_id": device_id_from_name(name),
        "binary_label": F.when(is_benign, F.lit(BENIGN_LABEL)).otherwise(F.lit(ATTACK_LABEL)),
        "binary_target": F.when(is_benign, F.lit(BENIGN_TARGET)).otherwise(F.lit(ATTACK_TARGET)),
        "family": fam,
        "attack_type": atype,
        "multiclass_label": F.when(is_benign | atype.isNull(), fam).otherwise(F.concat_ws("_", fam, atype)),
    })


def label_mismatches(df: DataFrame) -> DataFrame:
    """Rows whose target disagrees with the label map or lies outside {0, 1}."""
    expected = (F.when(F.col("binary_label") == BENIGN_LABEL, F.lit(BENIGN_TARGET))
                .when(F.col("binary_label") == ATTACK_LABEL, F.lit(ATTACK_TARGET)))
    bad = (~expected.eqNullSafe(F.col("binary_target"))) | ~F.col("binary_target").isin(0, 1)
    return df.filter(bad)


def label_consistency(df: DataFrame, group_col: str = "device_id") -> DataFrame:
    """P4 per group: rows, rows with a bad target, distinct labels, consistent flag."""
    expected = (F.when(F.col("binary_label") == BENIGN_LABEL, F.lit(BENIGN_TARGET))
                .when(F.col("binary_label") == ATTACK_LABEL, F.lit(ATTACK_TARGET)))
    bad = (~expected.eqNullSafe(F.col("binary_target"))) | ~F.col("binary_target").isin(0, 1)
    return (df.groupBy(group_col)
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(bad).alias("n_bad"),
                 F.count_distinct("binary_target").alias("n_targets"),
                 F.min("binary_target").alias("min_target"),
                 F.max("binary_target").alias("max_target"))
            .withColumn("consistent", F.col("n_bad") == 0))
