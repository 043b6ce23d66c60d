"""Driver tables -> the shapes the traffic operators expect.

The adapters only rename, cast and derive the columns of a labeled traffic
table; all work (labeling, splitting, scaling, kNN, ...) happens in the
operators. They read the given tables, so their cost grows with them.

* ``events`` -> raw traffic rows: ``row_key`` (unique), ``ts`` (capture order),
  ``source_file`` named ``<device>.<family>[.<type>].csv`` and four numeric features.
  The stand-in rule: event_type 'view' is benign traffic, every other type is
  an attack family; device = user_id % 9 + 1. Families but 'signup' have an attack
  type: 'scan' or 'flood' by the next digit of the user id to the base 9.
* ``embeddings`` -> wide numeric rows with a class label (label 0 is the
  minority class in the binary view).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Numeric feature columns of the events stand-in, in canonical (source) order.
TRAFFIC_FEATURES = ["value", "k", "tod", "dom"]
N_DEVICES = 9


def events_as_traffic(events: DataFrame) -> DataFrame:
    family = F.when(F.col("event_type") == "view", F.lit("benign")).otherwise(F.col("event_type"))
    device = (F.col("user_id") % N_DEVICES + 1).cast("string")
    typed = ~F.col("event_type").isin("view", "signup")
    kind = F.when(typed, F.when(F.floor(F.col("user_id") / N_DEVICES) % 2 == 0, F.lit("scan")).otherwise(F.lit("flood")))
    return events.select(
        F.col("event_id").alias("row_key"),
        F.col("ts"),
        F.concat_ws(".", device, family, kind, F.lit("csv")).alias("source_file"),
        F.col("value").cast("float").alias("value"),
        F.get_json_object("props", "$.k").cast("float").alias("k"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) % F.lit(86_400_000_000)) / F.lit(1e6))
        .cast("float").alias("tod"),
        F.dayofmonth("ts").cast("float").alias("dom"),
    )


EVENTS_AS_TRAFFIC_SQL = """
SELECT event_id AS row_key, ts,
       concat_ws('.', CAST(user_id % 9 + 1 AS VARCHAR),
                 CASE WHEN event_type = 'view' THEN 'benign' ELSE event_type END,
                 CASE WHEN event_type IN ('view', 'signup') THEN NULL WHEN (user_id // 9) % 2 = 0 THEN 'scan' ELSE 'flood' END, 'csv') AS source_file,
       CAST(value AS FLOAT) AS value,
       CAST(json_extract_string(props, '$.k') AS FLOAT) AS k,
       CAST((epoch_us(ts) % 86400000000) / 1e6 AS FLOAT) AS tod,
       CAST(dayofmonth(ts) AS FLOAT) AS dom
FROM events
"""


def embeddings_as_rows(embeddings: DataFrame, dims: int = 64) -> DataFrame:
    """One float column per embedding dimension (e0..e{dims-1}) + binary target."""
    cols = [F.col("embedding")[i].alias(f"e{i}") for i in range(dims)]
    return embeddings.select(
        F.col("vec_id").alias("row_key"),
        F.col("label").alias("class_label"),
        F.when(F.col("label") == 0, F.lit(0)).otherwise(F.lit(1)).alias("binary_target"),
        *cols,
    )


def embedding_features(dims: int = 64) -> list[str]:
    return [f"e{i}" for i in range(dims)]


def embeddings_as_rows_sql(dims: int = 64) -> str:
    cols = ", ".join(f"embedding[{i + 1}] AS e{i}" for i in range(dims))
    return (f"SELECT vec_id AS row_key, label AS class_label, "
            f"CASE WHEN label = 0 THEN 0 ELSE 1 END AS binary_target, {cols} FROM embeddings")
