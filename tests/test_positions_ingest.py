"""Skew-safe positions equal row_number; ingest scan, labels and schema checks on written files."""

import os
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlab.operators.label import label_traffic
from flowlab.operators.position import positions_within, running_totals
from flowlab.sources import ingest


def test_positions_equal_row_number_under_skew(spark):
    rows = [(i, "hot" if i % 10 < 7 else f"g{i % 13}", (i * 7919) % 1000) for i in range(3000)]
    df = spark.createDataFrame(rows, "k BIGINT, g STRING, o BIGINT")
    got = positions_within(df, ["g"], ["o", "k"], n_partitions=6)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("o", "k")) - 1)
    a = {r.k: r.pos for r in got.collect()}
    b = {r.k: r.rn for r in ref.collect()}
    assert a == b


def test_running_totals(spark):
    df = spark.createDataFrame([(float(i), float(i % 3)) for i in range(200)], "s DOUBLE, v DOUBLE")
    got = {r.s: r.below_v for r in running_totals(df, "s", ["v"], n_partitions=5).collect()}
    acc = 0.0
    for i in range(200):
        assert got[float(i)] == acc
        acc += i % 3


def test_label_rules(spark):
    names = ["1.benign.csv", "2.gafgyt.combo.csv", "9.mirai.udpplain.csv", "x.benign.csv"]
    df = spark.createDataFrame([(n,) for n in names], "source_file STRING")
    got = {r.source_file: r for r in label_traffic(df).collect()}
    assert got["1.benign.csv"].binary_target == 0 and got["1.benign.csv"].device_id == 1
    assert got["2.gafgyt.combo.csv"].binary_label == "attack" and got["2.gafgyt.combo.csv"].multiclass_label == "gafgyt_combo"
    assert got["9.mirai.udpplain.csv"].attack_type == "udpplain"
    assert got["x.benign.csv"].device_id is None


def test_scan_skips_metadata_and_labels(spark):
    d = tempfile.mkdtemp(prefix="flowlab-ingest-")
    header = "MI_dir_L0.1_weight,H_L5_mean\n"
    for name, rows in [("1.benign.csv", 3), ("1.gafgyt.scan.csv", 2), ("2.mirai.syn.csv", 4)]:
        with open(os.path.join(d, name), "w") as fh:
            fh.write(header + "".join(f"{i}.5,{i}\n" for i in range(rows)))
    for meta in ("device_info.csv", "features.csv", "data_summary.csv"):
        with open(os.path.join(d, meta), "w") as fh:
            fh.write("a,b\n1,2\n")
    cols = ingest.check_feature_header(ingest.header_columns(spark, os.path.join(d, "1.benign.csv")), 2)
    df = ingest.scan_traffic(spark, d, cols)
    counts = {(r.source_file, r.binary_target): r["count"] for r in df.groupBy("source_file", "binary_target").count().collect()}
    assert counts == {("1.benign.csv", 0): 3, ("1.gafgyt.scan.csv", 1): 2, ("2.mirai.syn.csv", 1): 4}
    assert "MI_dir_L0_1_weight" in df.columns
    with pytest.raises(ValueError):
        ingest.check_feature_header(["a", "a"])
    with pytest.raises(ValueError):
        ingest.check_feature_header(["a", "binary_target"])


def test_run_record_json_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="flowlab-json-")
    with open(os.path.join(d, "good.json"), "w") as fh:
        fh.write(ingest.dumps_record({"model": "rf", "fit_seconds": float("nan"), "features": ["a", "b"]}))
    with open(os.path.join(d, "bad.json"), "w") as fh:
        fh.write('{"model": "rf",\n "fit_seconds": 1.0,,\n}')
    df = ingest.read_run_records(spark, d).cache()
    assert df.filter(F.col("model") == "rf").filter(F.col("fit_seconds").isNull()).count() == 1
    assert "_corrupt_record" in df.columns and df.filter(F.col("_corrupt_record").isNotNull()).count() == 1


def test_scan_positions_follow_file_order_and_sinks(spark):
    from flowlab.operators import split as sp

    d = tempfile.mkdtemp(prefix="flowlab-order-")
    sizes = {"1.benign.csv": 5, "1.mirai.ack.csv": 11, "2.gafgyt.tcp.csv": 4}
    for name, n in sizes.items():
        with open(os.path.join(d, name), "w") as fh:
            fh.write("x,y\n" + "".join(f"{i},{100 - i}\n" for i in range(n)))
    df = ingest.scan_traffic(spark, d, ["x", "y"], with_position=True).cache()
    assert df.filter(F.col("row_pos") != F.col("x").cast("long")).count() == 0  # x holds the line index
    s = sp.ordered_split_by_position(df, "source_file", "row_pos", 0.8)
    got = {r.source_file: r.train_rows for r in sp.source_split_summary(s).collect()}
    assert got == {"1.benign.csv": 4, "1.mirai.ack.csv": 8, "2.gafgyt.tcp.csv": 3}
    assert s.filter((F.col("split") == "train") != (F.col("x") < F.floor(F.lit(0.8) * F.when(
        F.col("source_file") == "1.benign.csv", 5).when(F.col("source_file") == "1.mirai.ack.csv", 11).otherwise(4)))).count() == 0
    s2 = sp.ordered_split(df.withColumn("row_key", F.monotonically_increasing_id()), "source_file", ["row_pos"], 0.8)
    assert {r.source_file: r.train_rows for r in sp.source_split_summary(s2).collect()} == got
    out = tempfile.mkdtemp(prefix="flowlab-sink-")
    ingest.write_labeled(df, out + "/labeled")
    back = spark.read.parquet(out + "/labeled")
    assert {r.device_id: r["count"] for r in back.groupBy("device_id").count().collect()} == {1: 16, 2: 4}
    ingest.write_split(s, out + "/split")
    assert spark.read.parquet(out + "/split").filter(F.col("split") == "test").count() == 5
    ingest.write_result_csv(sp.source_split_summary(s), out + "/summary")
    assert spark.read.option("header", True).csv(out + "/summary").count() == 3


def test_scan_positions_across_input_splits(spark):
    d = tempfile.mkdtemp(prefix="flowlab-splits-")
    with open(os.path.join(d, "3.mirai.syn.csv"), "w") as fh:
        fh.write("x,y\n" + "".join(f"{i},{i % 7}\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        raw = ingest.scan_traffic(spark, d, ["x", "y"], with_position=False)
        assert raw.rdd.getNumPartitions() > 5
        df = ingest.scan_traffic(spark, d, ["x", "y"], with_position=True)
        assert df.filter(F.col("row_pos") != F.col("x").cast("long")).count() == 0
        assert df.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_metadata_tables_and_row_expectation(spark):
    d = tempfile.mkdtemp(prefix="flowlab-meta-")
    with open(os.path.join(d, "data_summary.csv"), "w") as fh:
        fh.write("File Name, Data Count, Feature Count\n1.benign.csv, 3, 2\n1.gafgyt.scan.csv, 2, 2\n2.mirai.syn.csv, 5, 2\n")
    with open(os.path.join(d, "device_info.csv"), "w") as fh:
        fh.write("DeviceID,DeviceName\n1,Doorbell_A\n2,Thermostat_B\n")
    caps = tempfile.mkdtemp(prefix="flowlab-caps-")
    for name, n in [("1.benign.csv", 3), ("1.gafgyt.scan.csv", 2), ("2.mirai.syn.csv", 4)]:
        with open(os.path.join(caps, name), "w") as fh:
            fh.write("a,b\n" + "".join(f"{i},{i}\n" for i in range(n)))
    summary = ingest.read_file_summary(spark, os.path.join(d, "data_summary.csv"))
    assert {r.file_name: r.data_count for r in summary.collect()} == {"1.benign.csv": 3, "1.gafgyt.scan.csv": 2,
                                                                       "2.mirai.syn.csv": 5}
    devices = ingest.read_device_info(spark, os.path.join(d, "device_info.csv"))
    assert devices.count() == 2
    chk = {r.source_file: r.ok for r in ingest.row_expectation(ingest.scan_traffic(spark, caps, ["a", "b"]), summary).collect()}
    assert chk == {"1.benign.csv": True, "1.gafgyt.scan.csv": True, "2.mirai.syn.csv": False}


def test_csv_stream_counts_new_files(spark):
    from flowlab.streaming.label_stream import run_traffic_csv_stream

    src = tempfile.mkdtemp(prefix="flowlab-csvstream-")
    state = tempfile.mkdtemp(prefix="flowlab-csvstate-")
    for name, n in [("1.benign.csv", 3), ("3.mirai.ack.csv", 2)]:
        with open(os.path.join(src, name), "w") as fh:
            fh.write("x.1,y\n" + "".join(f"{i},{i}\n" for i in range(n)))
    with open(os.path.join(src, "features.csv"), "w") as fh:
        fh.write("a,b\n1,2\n")
    out, ck = os.path.join(state, "out"), os.path.join(state, "ck")
    first = {(r.device_id, r.binary_label): r.n for r in run_traffic_csv_stream(spark, src, ["x.1", "y"], out, ck).collect()}
    assert first == {(1, "benign"): 3, (3, "attack"): 2}
    with open(os.path.join(src, "3.gafgyt.udp.csv"), "w") as fh:
        fh.write("x.1,y\n1,1\n2,2\n")
    second = {(r.device_id, r.binary_label): r.n for r in run_traffic_csv_stream(spark, src, ["x.1", "y"], out, ck).collect()}
    assert second == {(1, "benign"): 3, (3, "attack"): 4}


def test_positions_keep_null_groups(spark):
    rows = [(i, None if i % 4 == 0 else f"g{i % 3}", i) for i in range(60)]
    df = spark.createDataFrame(rows, "k BIGINT, g STRING, o BIGINT")
    got = positions_within(df, ["g"], ["o", "k"], n_partitions=3, size_col="n")
    assert got.count() == 60
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("o", "k")) - 1)
    assert {r.k: r.pos for r in got.collect()} == {r.k: r.rn for r in ref.collect()}
    assert {r.k: r.n for r in got.collect()}[0] == 15


def test_report_timings_and_typed_read(spark):
    d = tempfile.mkdtemp(prefix="flowlab-reports-")
    with open(os.path.join(d, "baseline.txt"), "w") as fh:
        fh.write("Timing\n------\nRead train seconds: 30.49\nTrain seconds: 418.56\nPredict seconds: 1.05\n")
    with open(os.path.join(d, "smote.txt"), "w") as fh:
        fh.write("Train seconds: 260.80\nSMOTE seconds: 110.73\n")
    got = {r.file: r for r in ingest.parse_report_timings(spark, d, ["Train seconds", "Predict seconds",
                                                                      "SMOTE seconds"]).collect()}
    assert got["baseline.txt"].train_seconds == 418.56 and got["baseline.txt"].predict_seconds == 1.05
    assert got["baseline.txt"].smote_seconds is None and got["smote.txt"].smote_seconds == 110.73
    names = ["MI_dir_L0.1_weight", "H_L5_mean", "HH_L0.01_radius"]
    m = {r.original_name: r.name for r in ingest.rename_map(spark, names).collect()}
    assert m["HH_L0.01_radius"] == "HH_L0_01_radius"
    df = spark.createDataFrame([(1.5, 2.5, 3.5, 1)], "MI_dir_L0_1_weight DOUBLE, H_L5_mean DOUBLE, "
                                                     "HH_L0_01_radius DOUBLE, binary_target BIGINT")
    typed = ingest.read_features_target(df, [m[n] for n in names])
    assert [f.dataType.simpleString() for f in typed.schema.fields] == ["float", "float", "float", "int"]


def test_broadcast_only_below_the_checked_bound(spark):
    from flowlab.session import broadcast_if_small

    big = spark.range(2000).withColumnRenamed("id", "k")
    side = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small_join = big.join(broadcast_if_small(side, max_rows=100), "k")
    large_join = big.join(broadcast_if_small(side, max_rows=10), "k")
    assert "BroadcastHashJoin" in small_join._jdf.queryExecution().executedPlan().toString()
    hinted = large_join._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in hinted and "broadcast" not in hinted.lower()
    assert sorted(r.v for r in small_join.collect()) == sorted(r.v for r in large_join.collect())


def test_swapped_header_and_bad_values_fail(spark):
    d = tempfile.mkdtemp(prefix="flowlab-csv-")
    with open(os.path.join(d, "1.benign.csv"), "w") as fh:
        fh.write("x,y\n1,2\n")
    assert ingest.scan_traffic(spark, d, ["x", "y"]).select("x", "y").collect() == [(1.0, 2.0)]
    with open(os.path.join(d, "2.benign.csv"), "w") as fh:
        fh.write("y,x\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        ingest.scan_traffic(spark, d, ["x", "y"]).select("x", "y").collect()
    e = tempfile.mkdtemp(prefix="flowlab-csv-")
    with open(os.path.join(e, "1.benign.csv"), "w") as fh:
        fh.write("x,y\n1,foo\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        ingest.scan_traffic(spark, e, ["x", "y"]).select("x", "y").collect()
