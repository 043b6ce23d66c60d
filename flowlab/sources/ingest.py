"""Scans, typed reads, schema checks and sinks for traffic tables.

Raw traffic files are CSV named ``<device>.<family>[.<type>].csv`` with a
header of numeric features. One multi-file scan reads them all; the file name
comes from ``_metadata.file_name`` and the labels from
:func:`flowlab.operators.label.label_traffic`. Feature names may contain dots
(``HH_L0.1_mean``); they are renamed ``.`` -> ``_`` on ingest with a mapping
table, since a dot means struct access in Spark column paths.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.operators.label import label_traffic
from flowlab.operators.position import positions_within

# Fixed file-name pattern of device traffic files: first dot token is digits.
DEVICE_FILE_GLOB = "[0-9]*.*.csv"
METADATA_COLUMNS = ["binary_label", "binary_target", "source_file"]


def safe_name(name: str) -> str:
    return name.replace(".", "_")


def feature_schema(names: list[str]) -> T.StructType:
    """S3: explicit schema, every feature FLOAT (float32)."""
    return T.StructType([T.StructField(n, T.FloatType(), True) for n in names])


def header_columns(spark: SparkSession, path: str) -> list[str]:
    """The header of one CSV file (reads only the first line)."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"empty file {path}")
    return [c.strip() for c in first[0][0].split(",")]


def check_feature_header(columns: list[str], expected_count: int | None = None) -> list[str]:
    """Unique names, no metadata column among the features, optional exact count."""
    if len(set(columns)) != len(columns):
        raise ValueError("duplicate feature names in header")
    meta = set(columns) & set(METADATA_COLUMNS)
    if meta:
        raise ValueError(f"metadata columns among features: {sorted(meta)}")
    if expected_count is not None and len(columns) != expected_count:
        raise ValueError(f"expected {expected_count} features, found {len(columns)}")
    renamed = [safe_name(c) for c in columns]
    if len(set(renamed)) != len(renamed):
        raise ValueError("feature names collide after renaming '.' -> '_'")
    return columns


def rename_map(spark: SparkSession, columns: list[str]) -> DataFrame:
    """Reversible mapping table original -> safe name with source column index."""
    return spark.createDataFrame([(i, c, safe_name(c)) for i, c in enumerate(columns)],
                                 "source_column_index INT, original_name STRING, name STRING")


def scan_traffic(spark: SparkSession, directory: str, features: list[str],
                 glob: str = DEVICE_FILE_GLOB, with_position: bool = False) -> DataFrame:
    """S1 + S2 + S3 + P1-P3: one typed scan of every device file, labeled from its file name.

    The header of every file must equal ``features`` in order, and a value that
    does not parse as a number fails the read: no column is bound by position
    alone and no text turns into null.
    Files not matching the device pattern (metadata CSVs) are skipped by the
    glob. Input splits bound the memory per task (the chunked read of the
    reference). With ``with_position`` every row gets ``row_pos``, its 0-based
    line position inside its file (capture order, needed by the ordered split):
    rows are numbered in read order inside each input split and the splits of a
    file are ordered by their byte offset, so the pair (split start, read index)
    orders a file's rows; :func:`positions_within` turns it into positions
    without putting a whole file in one task.
    """
    schema = feature_schema(features)
    raw = (spark.read.schema(schema).option("header", True).option("pathGlobFilter", glob)
           .option("enforceSchema", False).option("mode", "FAILFAST")
           .option("ignoreLeadingWhiteSpace", True).csv(directory))
    named = raw.select(*[F.col(f"`{c}`").alias(safe_name(c)) for c in features],
                       F.col("_metadata.file_name").alias("source_file"),
                       F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_read"))
    if with_position:
        named = positions_within(named, ["source_file"], ["_block", "_read"], pos_col="row_pos")
    return label_traffic(named).drop("_block", "_read")


def read_features_target(df: DataFrame, features: list[str], target: str = "binary_target") -> DataFrame:
    """Projected, typed (float32 features, int target) view; Parquet prunes the rest."""
    return df.select(*[F.col(c).cast("float").alias(c) for c in features], F.col(target).cast("int").alias(target))


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """Union by name; all parts must share the same column set."""
    cols = [sorted(p.columns) for p in parts]
    if any(c != cols[0] for c in cols):
        raise ValueError("sources do not share one schema")
    return reduce(lambda a, b: a.unionByName(b), parts)


def write_labeled(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One dataset partitioned by device (per-device and combined views are partition filters)."""
    w = df.write.mode("overwrite").partitionBy("device_id")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def write_split(df: DataFrame, path: str) -> None:
    """The split pair as one dataset partitioned by ``split``."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_result_csv(df: DataFrame, path: str) -> None:
    """Small result table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    """Multi-line JSON run records; malformed files land in ``_corrupt_record``."""
    return (spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def write_run_records(df: DataFrame, path: str) -> None:
    """Run records as JSON lines."""
    df.write.mode("overwrite").json(path)


def parse_report_timings(spark: SparkSession, path: str, labels: list[str]) -> DataFrame:
    """Pull '<label>: <number>' values out of text reports; missing -> null. One row per file."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    cols = []
    for lab in labels:
        pat = lab.replace(" ", r"\s+") + r":\s*([0-9]+(?:\.[0-9]+)?)"
        cols.append(F.nullif(F.regexp_extract("value", pat, 1), F.lit("")).try_cast("double")
                    .alias(lab.lower().replace(" ", "_")))
    return text.select("file", *cols)


def dumps_record(record: dict) -> str:
    """JSON text of one run record with non-finite numbers as null (P12 on the Python side)."""
    def clean(v):
        if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
            return None
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [clean(x) for x in v]
        return v
    return json.dumps(clean(record), indent=2, sort_keys=True)


def read_file_summary(spark: SparkSession, path: str) -> DataFrame:
    """File summary table (file name, row count, feature count); the header has spaces after commas."""
    schema = T.StructType([T.StructField("file_name", T.StringType()), T.StructField("data_count", T.LongType()),
                           T.StructField("feature_count", T.IntegerType())])
    return (spark.read.schema(schema).option("header", True).option("ignoreLeadingWhiteSpace", True)
            .option("ignoreTrailingWhiteSpace", True).csv(path))


def read_device_info(spark: SparkSession, path: str) -> DataFrame:
    """Device dimension (id, name); ids must be unique."""
    schema = T.StructType([T.StructField("device_id", T.IntegerType()), T.StructField("device_name", T.StringType())])
    df = (spark.read.schema(schema).option("header", True).option("ignoreLeadingWhiteSpace", True)
          .option("ignoreTrailingWhiteSpace", True).csv(path))
    dup = df.groupBy("device_id").count().filter("count > 1").count()
    if dup:
        raise ValueError(f"{dup} duplicated device ids in {path}")
    return df


def row_expectation(scanned: DataFrame, summary: DataFrame, train_ratio: float = 0.8) -> DataFrame:
    """V7: observed rows per source file against the file summary, with the expected ordered-split sizes."""
    obs = scanned.groupBy("source_file").agg(F.count(F.lit(1)).alias("observed_rows"))
    exp = summary.select(F.col("file_name").alias("source_file"), F.col("data_count").alias("expected_rows"))
    j = exp.join(obs, "source_file", "full_outer")
    return j.withColumns({
        "expected_train": F.floor(F.col("expected_rows").cast("double") * F.lit(float(train_ratio))).cast("bigint"),
        "ok": F.coalesce(F.col("expected_rows") == F.col("observed_rows"), F.lit(False)),
    })


def read_matrix(spark: SparkSession, path: str, classes: list[str] | None = None) -> DataFrame:
    """A stored confusion matrix (wide CSV) as cells (actual, predicted, n).

    The file has an unnamed first column with ``actual_<class>`` and one column
    ``predicted_<class>`` per class. Row and column classes must be the same set
    without repeats (and ``classes``, if given), every cell a whole number;
    anything else raises.
    """
    columns = header_columns(spark, path)
    names = [c.removeprefix("predicted_") for c in columns[1:]]
    if any(not c.startswith("predicted_") for c in columns[1:]) or len(set(names)) != len(names):
        raise ValueError(f"columns are not distinct predicted classes: {columns[1:]}")
    schema = T.StructType([T.StructField("_row", T.StringType()), *[T.StructField(n, T.LongType()) for n in names]])
    wide = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", True).csv(path)
    rows = [r[0] for r in wide.select("_row").collect()]  # one row per class
    found = [(r or "").removeprefix("actual_") for r in rows]
    if any(not (r or "").startswith("actual_") for r in rows) or sorted(found) != sorted(set(names)):
        raise ValueError(f"rows {rows} do not name the classes of the columns {names}")
    if classes is not None and sorted(found) != sorted(classes):
        raise ValueError(f"classes are {sorted(found)}, expected {sorted(classes)}")
    cells = wide.select(F.regexp_replace("_row", "^actual_", "").alias("actual"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("predicted"), F.col(f"`{n}`").alias("n")) for n in names])).alias("c")).select("actual", "c.*")
    if cells.where("n is null or n < 0").count():
        raise ValueError(f"{path} has cells that are no counts")
    return cells


def write_matrix(cells: DataFrame, path: str, classes: list[str]) -> None:
    """Cells (actual, predicted, n) as the wide CSV that :func:`read_matrix` reads; absent cells are 0."""
    wide = cells.groupBy("actual").pivot("predicted", classes).agg(F.first("n"))
    order = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("actual"))
    out = wide.orderBy(order).select(F.concat(F.lit("actual_"), "actual").alias(" "), *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"predicted_{c}") for c in classes])
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_importances(spark: SparkSession, path: str, top: int | None = None) -> DataFrame:
    """A stored importance table (CSV with columns feature, importance), ranked by importance, file order on ties.

    Features are distinct and importances finite numbers of at least 0; ``top`` keeps the first ranks.
    """
    columns = header_columns(spark, path)
    if not {"feature", "importance"} <= set(columns):
        raise ValueError(f"{path} needs the columns feature and importance, has {columns}")
    schema = T.StructType([T.StructField(c, T.DoubleType() if c == "importance" else T.StringType()) for c in columns])
    rows = (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
            .select("feature", "importance", F.monotonically_increasing_id().alias("_line")))
    bad = rows.where("feature is null or importance is null or isnan(importance) or importance < 0 or importance = double('infinity')").count()
    if bad or rows.count() != rows.select("feature").distinct().count():
        raise ValueError(f"{path} has repeated features or values that are no importances")
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "_line")))  # one row per feature
    return ranked.where(F.col("rank") <= top).drop("_line") if top else ranked.drop("_line")


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Writes only the partitions that ``df`` holds; the others stay (dynamic partition overwrite)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def is_pruned(df: DataFrame, column: str) -> bool:
    """Whether the scan of ``df`` is limited to partitions by a filter on ``column``."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    return bool(found) and all(re.search(rf"\b{re.escape(column)}#", f) for f in found)
