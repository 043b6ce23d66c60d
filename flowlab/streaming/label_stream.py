"""Incremental labeling of newly arrived traffic files with running class counts.

File source with a fixed schema -> adapter -> labels (P1-P3) -> stateful
count per (device, label), complete output mode. ``availableNow`` processes
whatever is present and stops; a later run with the same checkpoint picks up
only new files. The sink overwrites a Parquet table with the current counts
on every micro-batch (the state is bounded by devices x labels).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.operators.label import label_traffic
from flowlab.session import ensure_checkpoint_dir
from flowlab.sources.adapters import events_as_traffic


def running_class_counts(stream: DataFrame) -> DataFrame:
    t = label_traffic(events_as_traffic(stream))
    return t.groupBy("device_id", "binary_label").agg(F.count(F.lit(1)).alias("n"))


def run_label_stream(spark: SparkSession, source_dir: str, out_dir: str | None = None,
                     checkpoint: str | None = None, file_glob: str = "events*.parquet") -> DataFrame:
    """Run the stream until every available file is processed; return the counts table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = uuid.uuid4().hex[:12]
    checkpoint = checkpoint or f"{base}/stream-{run}/checkpoint"
    out_dir = out_dir or f"{base}/stream-{run}/counts"
    schema = spark.read.parquet(f"{source_dir.rstrip('/')}/events.parquet").schema
    # a glob of paths, so that a table that is a folder of part files is read as well as a single file
    stream = spark.readStream.schema(schema).parquet(f"{source_dir.rstrip('/')}/{file_glob}")
    counts = running_class_counts(stream)

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out_dir)

    q = (counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
         .foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_dir)


def run_traffic_csv_stream(spark: SparkSession, source_dir: str, features: list[str], out_dir: str,
                           checkpoint: str, glob: str = "[0-9]*.*.csv") -> DataFrame:
    """T1 on raw captures: newly arrived device CSV files -> labels from the file name -> running counts."""
    from flowlab.sources.ingest import feature_schema, safe_name

    stream = (spark.readStream.schema(feature_schema(features)).option("header", True)
              .option("enforceSchema", False).option("mode", "FAILFAST").option("pathGlobFilter", glob).csv(source_dir))
    named = stream.select(*[F.col(f"`{c}`").alias(safe_name(c)) for c in features],
                          F.col("_metadata.file_name").alias("source_file"))
    counts = label_traffic(named).groupBy("device_id", "binary_label").agg(F.count(F.lit(1)).alias("n"))

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out_dir)

    q = (counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
         .foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_dir)
