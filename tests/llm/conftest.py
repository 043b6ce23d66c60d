import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from flowlab.session import build_session

    return build_session(master="local[4]", shuffle_partitions=4, app_name="flowlab-tests")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture()
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and a clashing extra column."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, "a", "x"), (2, "", "a", "x"), (None, "one two three four", None, "x"), (4, long, "b", None), (5, long, "b", "y"),
            (6, "same words here today", "a", "z"), (6, "same words here today", "a", "z"), (7, " \n\t ", None, "z"), (8, "é ß 漢字 😀 x", "ü", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, count string")
    for name in ("id", "fp", "component", "score", "size", "position", "words", "rank", "value", "kind"):
        df = df.withColumn(name, F.lit("clash"))
    return df
