"""The streaming label counter processes new files only and ends equal to the batch counts."""

import os
import shutil
import tempfile

import pytest

from flowlab.operators.label import label_traffic
from flowlab.sources.adapters import events_as_traffic
from flowlab.streaming.label_stream import run_label_stream

SRC = "/root/testdata/sf0.001/events.parquet"


@pytest.mark.skipif(not os.path.exists(SRC), reason="driver test data not present")
def test_incremental_stream_counts(spark):
    src = tempfile.mkdtemp(prefix="flowlab-stream-src-")
    state = tempfile.mkdtemp(prefix="flowlab-stream-state-")
    shutil.copy(SRC, os.path.join(src, "events.parquet"))
    ck, out = os.path.join(state, "ck"), os.path.join(state, "out")
    first = {(r.device_id, r.binary_label): r.n for r in run_label_stream(spark, src, out, ck).collect()}
    batch = label_traffic(events_as_traffic(spark.read.parquet(SRC))).groupBy("device_id", "binary_label").count()
    expect = {(r.device_id, r.binary_label): r["count"] for r in batch.collect()}
    assert first == expect
    shutil.copy(SRC, os.path.join(src, "events_2.parquet"))  # a newly arrived file
    second = {(r.device_id, r.binary_label): r.n for r in run_label_stream(spark, src, out, ck).collect()}
    assert second == {k: 2 * v for k, v in expect.items()}
    third = {(r.device_id, r.binary_label): r.n for r in run_label_stream(spark, src, out, ck).collect()}
    assert third == second  # nothing new: state unchanged
