"""Mixing sources to target weights along a time-varying curriculum.

A source's share of the mix is its target: the demand is dealt to the sources
by weight, a target stops at ``max_epochs`` times its source's size, and the
excess is dealt to the others by weight until none is above its cap.

Training time runs from 0 to 1. Each source has a weight schedule, a piecewise
linear rate over time, scaled so that its integral over the whole run is the
target. A document's words take the next words of its source's demand, in a
seeded hash order, once per epoch; inverting the integrated rate at the word
count in front of a copy gives the copy's training position. Sorting by
position is a range sort.

Word counts in front of a document are prefix sums within its source. A source
is cut into about sqrt(rows) hash buckets: sums per bucket, a running sum over
buckets, and a running sum inside each bucket, so no task meets a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlab.llm.common import cut_lineage, n_words, table, words

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
# (time, rate) knots of the schedules, dealt to the sources in turn: flat, falling, rising, peaked late.
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 2.0), (0.5, 1.0), (1.0, 0.25)),
    ((0.0, 0.25), (0.5, 1.0), (1.0, 2.0)),
    ((0.0, 0.5), (0.7, 0.5), (0.8, 2.0), (1.0, 2.0)),
)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) one row per source -> adds rank, weight and target words.

    Caps bind in ascending order of cap / weight, so the sources at their cap
    are a prefix of that order: k sources are capped while the words left to
    the rest, dealt by weight, exceed the next cap. One row per source is
    ordered here, never one row per document.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = (sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", w.cast("long"))
         .withColumn("cap", F.col("source_size") * max_epochs))
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = (s.withColumn("left_words", F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("left_weight", F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
         .withColumn("share", F.col("left_words").cast("double") / F.col("left_weight").cast("double")))
    s = s.withColumn("capped", F.col("cap").cast("double") < F.col("share") * F.col("weight"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("share")))
                  ).over(W.partitionBy())["share"]
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return s.select("source", "source_size", "rank", "weight", target.alias("target"))


def word_positions(docs: DataFrame) -> DataFrame:
    """(source, size, draw, ...) -> adds ``start``: words of the source in front of the row, in draw order."""
    n = docs.groupBy("source").agg(F.ceil(F.sqrt(F.count("*"))).cast("long").alias("buckets"))
    same = lambda a, b, *cols: [a[c].eqNullSafe(b[c]) for c in cols]  # noqa: E731 - a null source is a source
    slot = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    cut = docs.alias("d").join(n.alias("n"), F.expr("d.source <=> n.source")).select("d.*", "n.buckets")
    cut = cut.withColumn("bucket", F.floor(slot * F.col("buckets") / F.lit(4294967296)).cast("long")).drop("buckets")
    sums = cut.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    run = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    front = sums.select("source", "bucket", F.coalesce(F.sum("sum").over(run), F.lit(0)).alias("front"))
    within = W.partitionBy("source", "bucket").orderBy("draw", "size").rowsBetween(W.unboundedPreceding, -1)
    inner = cut.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return (inner.join(front, same(inner, front, "source", "bucket"))
            .select(*[inner[c] for c in docs.columns], (front["front"] + inner["inner"]).alias("start")))


def demand_time(done: Column, rank: Column, schedules: tuple = SCHEDULES) -> Column:
    """Inverse of a source's integrated schedule: the time at which the share ``done`` (0 to 1) of it is reached."""

    def inverse(knots):
        area, total = [], 0.0
        for (t0, a), (t1, b) in zip(knots, knots[1:]):
            area.append((total, t0, t1, a, b))
            total += (a + b) / 2 * (t1 - t0)
        want, out = done * total, None
        for at, t0, t1, a, b in area:
            slope = (b - a) / (t1 - t0)
            rest = F.greatest(want - at, F.lit(0.0))
            # a x + slope x^2 / 2 = rest, in the form that stays exact for a small slope
            x = 2 * rest / (F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * rest, F.lit(0.0))))
            piece = F.lit(t0) + F.least(x, F.lit(t1 - t0))
            out = piece if out is None else F.when(want > at, piece).otherwise(out)
        return out

    pick = rank % len(schedules)
    out = inverse(schedules[0])
    for i, knots in enumerate(schedules[1:], 1):
        out = F.when(pick == i, inverse(knots)).otherwise(out)
    return out


def plan_mix(docs: DataFrame, keep: tuple[str, ...] = (), weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS,
             schedules: tuple = SCHEDULES, seed: str = SEED) -> DataFrame:
    """Plan over ``docs`` (doc_id, source, text): one row per document.

    Columns: doc_id, source, draw, size, source_size, target, epochs (whole
    passes over the source), taken, and ``positions``: the training time of
    each copy, in order. A document is taken whole in every whole pass; in the
    last, partial pass it is taken while words are left, and only the document
    at the cut gives part of its words. Sizes that add up to zero, and empty
    texts, take nothing and have no position. Null texts have size 0, a null
    source is a source of its own, repeated rows count each, a null doc_id is
    ordered like an id of its own. The draw takes id and text, so rows of one id,
    or without one, spread like others. ``keep`` names further columns to carry.
    """
    doc = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                      F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"),
                                     F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary")).alias("draw"), *keep)
    doc = cut_lineage(doc)  # sizes only: the texts are read once
    sizes = doc.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = source_targets(sizes, weights, max_epochs)
    at = word_positions(doc).alias("d").join(goal.alias("g"), F.expr("d.source <=> g.source"))
    want = F.least(F.round("target").cast("long"), F.col("source_size") * max_epochs)
    at = at.select("d.*", "g.source_size", "g.target", "g.rank", want.alias("want"))
    at = at.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("want div source_size")).otherwise(F.lit(0).cast("long")))
    rest = F.col("want") - F.col("epochs") * F.col("source_size") - F.col("start")
    part = F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    at = at.withColumn("part", part).withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
    copies = F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)
    rank = F.col("rank")
    spots = F.when((F.col("taken") > 0) & (copies > 0), F.transform(
        F.sequence(F.lit(0).cast("long"), copies - 1),
        lambda e: demand_time(F.least((e * F.col("source_size") + F.col("start")) / F.col("want"), F.lit(1.0)),
                              rank, schedules))).otherwise(F.array().cast("array<double>"))
    return at.select("doc_id", "source", "draw", "size", "source_size", "target", "epochs", "part", "taken",
                     spots.alias("positions"), *keep)


def training_order(plan: DataFrame) -> DataFrame:
    """One row per copy of a taken document, range-sorted by training position.

    ``copy`` counts from 0, ``words`` is what the copy gives.
    """
    one = plan.select("*", F.posexplode("positions").alias("copy", "position")).drop("positions")
    return (one.withColumn("words", F.when(F.col("copy") < F.col("epochs"), F.col("size")).otherwise(F.col("part")))
            .orderBy("position", "draw", "copy"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: one row per taken copy of a document, range-sorted by training position.

    The columns of ``docs`` come first, then copy, words and position (which
    replace columns of these names). The last
    copy of the document at a source's cut holds its first words only, joined
    by one space. The plan is made without the texts; they are shuffled once
    for the join with it and once for the sort.
    """
    key = "__text_key"
    keyed = docs.withColumn(key, F.xxhash64("text"))
    copies = (plan_mix(keyed, keep=(key,), **options).select("doc_id", key, "draw", "size", "epochs", "part", F.posexplode("positions").alias("copy", "position"))
              .withColumn("words", F.when(F.col("copy") < F.col("epochs"), F.col("size")).otherwise(F.col("part"))))
    rows = keyed.dropDuplicates(["doc_id", key]).alias("d").join(
        copies.alias("c"), F.expr(f"d.doc_id <=> c.doc_id and d.{key} = c.{key}"))
    text = F.when(F.col("c.words") < F.col("c.size"), F.concat_ws(" ", F.slice(words(F.col("d.text")), 1, F.col("c.words").cast("int")))).otherwise(F.col("d.text"))
    own = [text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns if c not in ("copy", "words", "position")]
    return (rows.select(*own, *[F.col(f"c.{c}").alias(f"__{c}") for c in ("copy", "words", "position", "draw")])
            .orderBy("__position", "__draw", "__copy").drop("__draw")
            .withColumnsRenamed({f"__{c}": c for c in ("copy", "words", "position")}))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all ``documents``; one row per document, range-sorted by first training position (untaken last)."""
    plan = plan_mix(table(spark, sf_dir, "documents"))
    first = F.when(F.size("positions") > 0, F.element_at("positions", 1))
    return (plan.select("doc_id", "size", "source_size", "target", "taken", "draw", F.round(first, 9).alias("position"))
            .orderBy(F.col("position").asc_nulls_last(), "draw").drop("draw"))
