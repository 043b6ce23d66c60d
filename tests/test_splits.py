"""Split operators: goldens from the published counts, exact quotas, completeness, layout independence."""

from pyspark.sql import functions as F

from flowlab.operators import split as sp

# Device 1 per-file row counts of the reference data set (file summary table).
DEVICE1_FILES = {
    "1.benign.csv": 49548, "1.gafgyt.combo.csv": 59718, "1.gafgyt.junk.csv": 29068,
    "1.gafgyt.scan.csv": 29849, "1.gafgyt.tcp.csv": 92141, "1.gafgyt.udp.csv": 105874,
    "1.mirai.ack.csv": 102195, "1.mirai.scan.csv": 107685, "1.mirai.syn.csv": 122573,
    "1.mirai.udp.csv": 237665, "1.mirai.udpplain.csv": 81982,
}


def _counts(spark, pairs):
    return spark.createDataFrame(pairs, "binary_target INT, n BIGINT")


def test_per_class_round_quota_golden(spark):
    # all devices: benign 555,932 / attack 6,506,674 -> test 111,186 / 1,301,335
    q = sp.per_class_round_quota(_counts(spark, [(0, 555932), (1, 6506674)]), "binary_target", 0.2)
    got = {r.binary_target: r.q for r in q.collect()}
    assert got == {0: 111186, 1: 1301335}


def test_largest_remainder_quota_golden(spark):
    # device 1: 1,018,298 rows, library split test size 203,660
    benign = DEVICE1_FILES["1.benign.csv"]
    total = sum(DEVICE1_FILES.values())
    q = sp.largest_remainder_quota(_counts(spark, [(0, benign), (1, total - benign)]), "binary_target", 0.2)
    assert sum(r.q for r in q.collect()) == 203660


def test_quota_rules_small(spark):
    c = _counts(spark, [(0, 13), (1, 87)])
    a = {r.binary_target: r.q for r in sp.per_class_round_quota(c, "binary_target", 0.2).collect()}
    b = {r.binary_target: r.q for r in sp.largest_remainder_quota(c, "binary_target", 0.2).collect()}
    assert a == {0: 3, 1: 17} and b == {0: 3, 1: 17}
    # half case: 5 * 0.5 = 2.5 rounds half to even
    h = {r.binary_target: r.q for r in sp.per_class_round_quota(_counts(spark, [(0, 5), (1, 7)]), "binary_target", 0.5).collect()}
    assert h == {0: 2, 1: 4}


def test_ordered_split_golden_device1(spark):
    n_train = sum(int(n * 0.8) for n in DEVICE1_FILES.values())
    assert n_train == 814635  # published ordered split of device 1
    sizes = spark.createDataFrame([(k, v) for k, v in DEVICE1_FILES.items()], "source_file STRING, n BIGINT")
    got = sizes.select(F.sum(F.floor(F.col("n").cast("double") * F.lit(0.8))).alias("t")).first().t
    assert got == 814635


def _rows(spark, groups):
    data = []
    key = 0
    for g, n in groups.items():
        for i in range(n):
            data.append((key, g, i, "benign" if g.endswith("benign.csv") else "attack"))
            key += 1
    return spark.createDataFrame(data, "row_key BIGINT, source_file STRING, ts BIGINT, binary_label STRING")


def test_ordered_split_small_groups(spark):
    df = _rows(spark, {"1.a.csv": 1, "1.b.csv": 4, "1.c.csv": 5, "1.d.csv": 11})
    s = sp.ordered_split(df, "source_file", ["ts", "row_key"], 0.8)
    summ = {r.source_file: r.train_rows for r in sp.source_split_summary(s).collect()}
    assert summ == {"1.a.csv": 0, "1.b.csv": 3, "1.c.csv": 4, "1.d.csv": 8}
    # train rows are exactly the first rows in order
    bad = s.filter(((F.col("split") == "train") & (F.col("ts") >= F.floor(F.lit(0.8) * 11)))
                   & (F.col("source_file") == "1.d.csv")).count()
    assert bad == 0


def _labeled(spark, n0, n1, parts):
    rows = [(i, 0 if i < n0 else 1) for i in range(n0 + n1)]
    return spark.createDataFrame(rows, "row_key BIGINT, binary_target INT").repartition(parts)


def test_stratified_split_exact_and_layout_free(spark):
    a = sp.stratified_split(_labeled(spark, 130, 870, 3))
    b = sp.stratified_split(_labeled(spark, 130, 870, 7))
    ca = {(r.binary_target, r.split): r["count"] for r in a.groupBy("binary_target", "split").count().collect()}
    assert ca[(0, "test")] == 26 and ca[(1, "test")] == 174
    ka = {r.row_key: r.split for r in a.collect()}
    kb = {r.row_key: r.split for r in b.collect()}
    assert ka == kb
    chk = sp.split_check(a, _labeled(spark, 130, 870, 2)).first()
    assert chk.ok and chk.train_rows + chk.test_rows == 1000


def test_stratified_split_matches_rank_definition(spark):
    """The bucketed cut equals 'the q smallest (hash, key) per class' computed by a plain window."""
    from pyspark.sql import Window

    from flowlab.functions.rand import hash32

    df = _labeled(spark, 300, 700, 5)
    s = sp.stratified_split(df)
    w = Window.partitionBy("binary_target").orderBy(hash32(42, "split", "row_key"), "row_key")
    ref = df.withColumn("rn", F.row_number().over(w)).withColumn(
        "split", F.when(F.col("rn") <= F.when(F.col("binary_target") == 0, 60).otherwise(140), "test").otherwise("train"))
    assert {r.row_key: r.split for r in s.collect()} == {r.row_key: r.split for r in ref.collect()}
