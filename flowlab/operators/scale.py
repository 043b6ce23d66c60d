"""Train-only scaling.

Fit is one aggregation pass over the train rows producing one parameter row
per feature; apply is a projection with the parameters as literals (the
parameter table is bounded by the number of features), so the scaled columns
stay inside whole-stage codegen. Fit on train, apply to train and test (M11).

Standard scaling uses the *population* standard deviation, and a zero
deviation is replaced by 1 (``pyspark.ml.feature.StandardScaler`` would use
the sample deviation).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def narrow_to_float(df: DataFrame, features: list[str]) -> DataFrame:
    """Cast the feature columns to FLOAT (float32)."""
    return df.withColumns({c: F.col(c).cast("float") for c in features})


@dataclass
class ScalerModel:
    kind: str                      # "standard" | "minmax"
    features: list[str]
    center: dict[str, float]       # mean (standard) or min (minmax)
    scale: dict[str, float]        # std (standard) or max - min (minmax), zero -> 1

    def params(self, spark) -> DataFrame:
        rows = [(i, f, float(self.center[f]), float(self.scale[f])) for i, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "position INT, feature STRING, center DOUBLE, scale DOUBLE")

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """(x - center) / scale in double precision."""
        return df.withColumns({
            f + suffix: (F.col(f).cast("double") - F.lit(self.center[f])) / F.lit(self.scale[f])
            for f in self.features
        })


def fit_standard(train: DataFrame, features: list[str]) -> ScalerModel:
    """M4: mean and population std per feature in one pass (std 0 -> 1)."""
    aggs = []
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = train.agg(*aggs).first()
    center = {f: float(row[f"m{i}"]) for i, f in enumerate(features)}
    scale = {f: (float(row[f"s{i}"]) if row[f"s{i}"] else 1.0) for i, f in enumerate(features)}
    return ScalerModel("standard", list(features), center, scale)


def fit_minmax(train: DataFrame, features: list[str]) -> ScalerModel:
    """Min and range per feature (range 0 -> 1); apply maps train into [0, 1]."""
    aggs = []
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = train.agg(*aggs).first()
    center = {f: float(row[f"lo{i}"]) for i, f in enumerate(features)}
    scale = {}
    for i, f in enumerate(features):
        rng = float(row[f"hi{i}"]) - float(row[f"lo{i}"])
        scale[f] = rng if rng != 0 else 1.0
    return ScalerModel("minmax", list(features), center, scale)
