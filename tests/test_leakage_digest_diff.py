"""Copies across parts, ordered digests, bucketed differences, nested cleaning, stored matrices, round trips."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from flowlab.functions.exprs import clean_nonfinite
from flowlab.operators import leakage, runs
from flowlab.session import remove_folder, scratch_folder
from flowlab.sources import ingest


def test_planted_copies_are_found(spark):
    rows = [(float(i), i % 7, "train" if i % 5 else "test") for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b int, split string")
    clean = {r["part"]: r for r in leakage.copies_across(df, ["a", "b"], "split").collect()}
    assert {p: (r["rows"], r["copied_rows"]) for p, r in clean.items()} == {"train": (160, 0), "test": (40, 0)}
    extra = [(1.0, 1, "test"), (1.0, 1, "test"), (None, None, "train"), (None, None, "test"), (float("nan"), 0, "train"), (float("nan"), 0, None),
             (0.0, 9, "train"), (-0.0, 9, "test"), (3.0, 99, "test"), (3.0, 99, "test")]
    got = {r["part"]: (r["copied_rows"], r["copied_tuples"]) for r in leakage.copies_across(
        df.union(spark.createDataFrame(extra, df.schema)), ["a", "b"], "split").collect()}
    assert got == {"train": (4, 4), "test": (4, 3), None: (1, 1)}


def test_a_hot_copy_is_counted(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 1.0, cast(id as double)) a", "if(id % 2 = 0, 'x', 'y') part")
    got = {r["part"]: (r["copied_rows"], r["copied_tuples"]) for r in leakage.copies_across(df, ["a"], "part").collect()}
    assert got == {"x": (834, 1), "y": (834, 1)}  # 1667 rows of the hot value, and row 1 itself


def plain_digest(values, chunk):
    level = ["" if v is None else str(v) for v in values]
    while True:
        level = [hashlib.sha256(",".join(level[i:i + chunk]).encode()).hexdigest() for i in range(0, len(level), chunk)]
        if len(level) == 1:
            return level[0]


@pytest.mark.parametrize("chunk", [4096, 10, 3])
def test_digest_of_ordered_labels(spark, chunk):
    rows = [(i, None if i % 17 == 0 else i % 3) for i in range(157)]
    df = spark.createDataFrame(rows, "k long, y int")
    base = runs.ordered_digest(df, ["k"], "y", chunk).first()
    assert (base["rows"], base["digest"]) == (157, plain_digest([y for _, y in rows], chunk))
    assert runs.ordered_digest(df.orderBy(F.desc("k")).repartition(7), ["k"], "y", chunk).first() == base
    change = lambda y: df.withColumn("y", y)
    others = [change(F.when(F.col("k") == 100, 5).otherwise(F.col("y"))), change(F.when(F.col("k") == 1, 2).when(F.col("k") == 2, 1).otherwise(F.col("y"))),
              df.where("k <> 156"), df.union(spark.createDataFrame([(200, 0)], df.schema)), change(F.coalesce("y", F.lit(0)))]
    assert all(runs.ordered_digest(o, ["k"], "y", chunk).first()["digest"] != base["digest"] for o in others)


def test_digest_of_no_and_one_row(spark):
    df = spark.createDataFrame([(1, 7)], "k long, y int")
    assert tuple(runs.ordered_digest(df, ["k"], "y").first()) == (1, 1, hashlib.sha256(b"7").hexdigest())
    assert tuple(runs.ordered_digest(df.limit(0), ["k"], "y").first()) == (0, 0, hashlib.sha256(b"").hexdigest())


def test_bucketed_differences(spark):
    rows = [(i, f"v{i % 10}", float(i)) for i in range(5000)]
    before = spark.createDataFrame(rows, "k long, v string, x double")
    after = before.where("k <> 17").withColumn("v", F.when(F.col("k") == 40, "new").when(F.col("k") == 41, None).otherwise(F.col("v")))
    after = after.union(spark.createDataFrame([(9000, "v", 1.0), (None, "n", None)], after.schema)).repartition(3)
    out, differing = runs.bucketed_diff(before, after, "k", ["v", "x"], rows_per_bucket=10)
    got = {r["k"]: (r["status"], r["before_v"], r["after_v"]) for r in out.collect()}
    assert got == {17: ("removed", "v7", None), 40: ("changed", "v0", "new"), 41: ("changed", "v1", None), 9000: ("created", None, "v"), None: ("created", None, "n")}
    assert 1 <= differing.count() <= 5  # of 501 buckets: the others are not looked at row by row
    same, none = runs.bucketed_diff(before, before.repartition(9), "k", ["v", "x"])
    assert same.count() == 0 and none.count() == 0
    assert runs.bucketed_diff(before.limit(0), before.limit(3), "k", ["v"])[0].count() == 3


def test_floats_inside_nested_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, (nan, [1.0, inf], {"a": [-inf, 2.0]}, "s"), [(inf, 1)], {1.5: nan}), (2, None, None, None), (3, (1.0, None, {}, None), [], {})],
                               "k int, s struct<x: double, l: array<float>, m: map<string, array<double>>, t: string>, a array<struct<y: float, i: int>>, m map<double, double>")
    out = clean_nonfinite(df)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in df.schema]
    rows = {r["k"]: r for r in out.collect()}
    assert rows[1]["s"].asDict() == {"x": None, "l": [1.0, None], "m": {"a": [None, 2.0]}, "t": "s"}
    assert rows[1]["a"][0].asDict() == {"y": None, "i": 1} and rows[1]["m"] == {1.5: None}
    assert rows[2]["s"] is None and rows[2]["a"] is None and rows[3]["s"].asDict() == {"x": 1.0, "l": None, "m": {}, "t": None}


def write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def test_stored_matrix(spark, tmp_path):
    # the shape of a stored matrix: fixed values
    stored = write(tmp_path / "m.csv", ",predicted_benign,predicted_attack\nactual_benign,9910,0\nactual_attack,3,193747\n")
    cells = ingest.read_matrix(spark, stored, ["benign", "attack"])
    assert {(r["actual"], r["predicted"]): r["n"] for r in cells.collect()} == {
        ("benign", "benign"): 9910, ("benign", "attack"): 0, ("attack", "benign"): 3, ("attack", "attack"): 193747}
    run = spark.createDataFrame([("benign", "benign", 9910), ("benign", "attack", 0), ("attack", "benign", 3), ("attack", "attack", 193746)], cells.schema)
    match = {(r["actual"], r["predicted"]): (r["match"], r["all_match"]) for r in runs.golden_match(run, cells, ["actual", "predicted"]).collect()}
    assert match["attack", "attack"] == (False, False) and match["benign", "benign"] == (True, False)
    ingest.write_matrix(cells, str(tmp_path / "again"), ["benign", "attack"])
    assert sorted(map(tuple, ingest.read_matrix(spark, str(tmp_path / "again")).collect())) == sorted(map(tuple, cells.collect()))


@pytest.mark.parametrize("text", [
    ",predicted_a,predicted_b\nactual_a,1,2\n", ",predicted_a,predicted_a\nactual_a,1,2\nactual_a,1,2\n", ",a,b\nactual_a,1,2\nactual_b,1,2\n",
    ",predicted_a,predicted_b\nactual_a,1,x\nactual_b,1,2\n", ",predicted_a,predicted_b\nactual_a,1,-2\nactual_b,1,2\n",
    ",predicted_a,predicted_b\nactual_a,1,2\nactual_c,1,2\n", ",predicted_a,predicted_b\nactual_a,1,\nactual_b,1,2\n"])
def test_broken_matrices_raise(spark, tmp_path, text):
    with pytest.raises(Exception):  # noqa: B017 - a ValueError, or Spark's own for a cell that is no number
        ingest.read_matrix(spark, write(tmp_path / "m.csv", text)).collect()


def test_stored_importances(spark, tmp_path):
    path = write(tmp_path / "i.csv", "feature,importance\nHH_L0.1_mean,0.2\nMI_weight,0.5\nH_x,0.2\nz,0.1\n")
    got = [(r["rank"], r["feature"]) for r in ingest.read_importances(spark, path, top=3).orderBy("rank").collect()]
    assert got == [(1, "MI_weight"), (2, "HH_L0.1_mean"), (3, "H_x")]
    for bad in ("feature,importance\na,0.2\na,0.1\n", "feature,importance\na,-1\n", "name,importance\na,1\n", "feature,importance\na,NaN\n"):
        with pytest.raises(Exception):  # noqa: B017
            ingest.read_importances(spark, write(tmp_path / "b.csv", bad)).collect()


def test_partitions_are_replaced_and_pruned_and_folders_go(spark):
    place = scratch_folder(spark, "test")
    df = spark.range(90).selectExpr("id", "cast(id % 3 as int) device_id")
    ingest.write_labeled(df, place)
    ingest.replace_partitions(df.where("device_id = 1 and id > 80"), place, "device_id")
    back = spark.read.parquet(place)
    assert {r["device_id"]: r["count"] for r in back.groupBy("device_id").count().collect()} == {0: 30, 1: 3, 2: 30}
    assert ingest.is_pruned(back.where("device_id = 2"), "device_id") and not ingest.is_pruned(back, "device_id") and not ingest.is_pruned(back.where("id = 2"), "device_id")
    local = place.removeprefix("file:")
    assert os.path.isdir(local) and remove_folder(spark, place) and not os.path.exists(local) and not remove_folder(spark, place)
    with pytest.raises(ValueError):
        remove_folder(spark, "/tmp")
