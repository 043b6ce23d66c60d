"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact weighted-shingle similarity.

A document is contaminated by an item of n words when one of its windows of n
words has a weighted-shingle similarity of at least ``SIMILARITY`` with it:
sum of the smaller over sum of the larger count of every five-word shingle.
A document of fewer words than the item is one window: its whole text.

1. Spots. A window of w shingles and similarity s to an item of m shingles
   shares at least (m + w) s / (1 + s) of them. So only windows over that many
   shingles of an item need a fingerprint; this loses nothing. The shingles of
   all texts are looked up once in the table of benchmark shingles.
2. Fingerprints. Bit counters roll over the starts of a document: one shingle
   enters, one leaves, and every window gets its 64-bit SimHash.
3. Blocks. The fingerprint of an item is filed under every value within
   ``radius // BLOCKS`` bits of each of its ``BLOCKS`` blocks. Two fingerprints
   within the radius agree that closely in some block, so a look-up of a
   window's blocks finds all items within the radius. The radius follows from
   the threshold (``radius_of``): shingles that occur once make independent
   bits, which differ with probability arccos(2 s / (1 + s)) / pi; the radius
   lies ``SPREAD`` deviations above their mean number (about one miss in 10^5
   at the threshold itself, none to speak of above it).
4. That needs shingles that occur once. Where the item or the stretch of the
   document repeats a shingle, heavy shingles make the bits dependent, and all
   windows of step 1 go to step 5: an exact way for the rest.
5. Exact similarity. The j-th occurrence of a shingle that the item holds c
   times counts for the starts from which fewer than c occurrences come before
   it: an interval of starts. Running sums over the ends of these intervals give
   the similarity of every candidate in linear time.

Only DataFrame expressions are used. Benchmark-sized tables are broadcast
below a checked row count and joined by shuffle above it; a document's rows
for one item are the largest group.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlab.llm.common import ascii_lower, cut_lineage, table, words
from flowlab.session import broadcast_if_small

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = 8
WIDTH = 64 // BLOCKS
SPREAD = 4.75
PIECE = 256  # starts of a document that one row rolls over
PAIR = (1 << 32) + 1  # two counters in a number: bit b and bit b + 32


def radius_of(similarity: float) -> int:
    """Bits within which the fingerprints of windows of that similarity lie, but for about one in 10^5."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return min(64, math.floor(64 * p + SPREAD * math.sqrt(64 * p * (1 - p))))


def word_hashes(text: Column) -> Column:
    return F.transform(words(ascii_lower(text)), lambda w: F.xxhash64(w))


def shingles(hashes: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order; empty if there are fewer words."""
    n = F.size(hashes)
    run = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(F.lit(k), *[F.get(hashes, i + j) for j in range(k)]))
    return F.when(n >= k, run).otherwise(F.array().cast("array<bigint>"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shifted(h: Column, b: Column) -> Column:
    return F.call_function("shiftrightunsigned", h, b)


def counters(hashes: Column) -> Column:
    """32 numbers: how many of the hashes have bit b and bit b + 32."""
    return F.array(*[F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(PAIR)))  # noqa: B023
                     for b in range(32)])


def majority(count: Column, n: Column) -> Column:
    """Fingerprint of counters over n hashes: a bit is set if it is in over half of them."""
    def bit(x: Column, b: Column) -> Column:
        low = F.when(2 * x.bitwiseAND(F.lit((1 << 32) - 1)) > n, F.call_function("shiftleft", F.lit(1).cast("long"), b))
        high = F.when(2 * F.shiftrightunsigned(x, 32) > n, F.call_function("shiftleft", F.lit(1).cast("long"), b + 32))
        zero = F.lit(0).cast("long")
        return F.coalesce(low, zero).bitwiseOR(F.coalesce(high, zero))

    return F.aggregate(F.transform(count, bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of hashes."""
    return majority(counters(hashes), F.size(hashes))


def rolled(hashes: Column, width: Column) -> Column:
    """SimHash of every window of ``width`` hashes, in order of the starts."""
    first = counters(F.slice(hashes, F.lit(1), width))
    begin = let(first, lambda c: F.struct(c.alias("c"), F.array(majority(c, width)).alias("out")))

    def step(state: Column, i: Column) -> Column:
        come, go = F.get(hashes, i + width - 1), F.get(hashes, i - 1)
        now = F.transform(state["c"], lambda x, b: x + shifted(come, b).bitwiseAND(F.lit(PAIR)) - shifted(go, b).bitwiseAND(F.lit(PAIR)))
        return let(now, lambda c: F.struct(c.alias("c"), F.concat(state["out"], F.array(majority(c, width))).alias("out")))

    starts = F.size(hashes) - width
    steps = F.when(starts > 0, F.sequence(F.lit(1), starts)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, begin, step)["out"]


def items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, n, k, m, counts, once, fp) of all items that have a word.

    k is the shingle length, m their number, ``counts`` the (hash, number)
    pairs; ``once``: no shingle is repeated. ``item`` names id and text.
    """
    base = (benchmark.select("item_id", F.xxhash64("item_id", "text").alias("item"), word_hashes(F.col("text")).alias("w"))
            .withColumn("n", F.size("w")).where("n > 0").dropDuplicates(["item"]))
    runs = F.array().cast("array<bigint>")
    for k in range(SHINGLE, 0, -1):
        runs = F.when(F.least(F.col("n"), F.lit(SHINGLE)) == k, shingles(F.col("w"), k)).otherwise(runs)
    one = base.select("item", "item_id", "n", F.least(F.col("n"), F.lit(SHINGLE)).alias("k"), runs.alias("hashes")).withColumn("m", F.size("hashes"))
    number = (one.select("item", F.explode("hashes").alias("h")).groupBy("item", "h").agg(F.count("*").cast("int").alias("c"))
              .groupBy("item").agg(F.collect_list(F.struct("h", "c")).alias("counts")))
    return (one.join(number, "item").withColumn("once", F.size("counts") == F.col("m")).withColumn("fp", simhash(F.col("hashes")))
            .select("item", "item_id", "n", "k", "m", "counts", "once", "fp"))


def block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, i * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def near_values(reach: int) -> list[int]:
    """Differences of a block that have at most ``reach`` bits."""
    return sorted(sum(1 << b for b in bits) for r in range(min(reach, WIDTH) + 1) for bits in combinations(range(WIDTH), r))


def block_index(bench: DataFrame, radius: int) -> DataFrame:
    """(item, i, value): the values of block i that some fingerprint within the radius has where it comes closest."""
    near = F.array(*map(F.lit, near_values(radius // BLOCKS)))
    filed = F.array(*[F.struct(F.lit(i).alias("i"), block(F.col("fp"), i).alias("v")) for i in range(BLOCKS)])
    return (bench.select("item", F.explode(filed).alias("b")).select("item", "b.i", "b.v", F.explode(near).alias("d"))
            .select("item", "i", F.col("v").bitwiseXOR(F.col("d")).alias("value")))


def start_runs(spots: Column, least: Column, width: Column, last: Column) -> Column:
    """array<struct(lo, hi)>: the starts up to ``last`` whose window holds at least ``least`` of the sorted spots, as runs."""
    empty = F.array().cast("array<struct<lo:int,hi:int>>")

    def run(at: Column) -> Column:
        def step(acc: Column, j: Column) -> Column:
            lo = F.greatest(F.get(at, j + least - 1) - width + 1, F.lit(0))
            hi = F.least(F.get(at, j), last)
            end = F.get(acc, F.size(acc) - 1)
            joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(end["lo"].alias("lo"), F.greatest(end["hi"], hi).alias("hi"))))
            return (F.when(lo > hi, acc).when((F.size(acc) > 0) & (lo <= end["hi"] + 1), joined)
                    .otherwise(F.concat(acc, F.array(F.struct(lo.alias("lo"), hi.alias("hi"))))))

        return F.aggregate(F.sequence(F.lit(0), F.size(at) - least), empty, step)

    return let(spots, run)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = SIMILARITY) -> DataFrame:
    """(id, text_key, item_id, start, n_words, distance, similarity): the best window of every contaminated pair.

    ``start`` counts words from 0; among equal similarities the first window
    is reported. ``n_words`` is the size of the window: that of the item, or of
    the document if it is shorter. ``distance`` is that of the SimHashes.
    ``text_key`` is xxhash64 of the text: repeated rows share it, and are one
    row here. Case of A-Z is ignored. Items of fewer than five words are
    compared as one shingle of all their words; null and blank items and texts
    match nothing; a null id is carried. Items of equal texts are all reported;
    of an item id with several texts, the best. Other columns are ignored;
    empty tables give no rows.
    """
    bench = cut_lineage(items(benchmark))
    lengths = sorted(r["k"] for r in bench.select("k").distinct().collect())  # at most SHINGLE values
    doc = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    if not lengths:
        item_id = bench.schema["item_id"].dataType
        return doc.where("false").select("id", "text_key", F.lit(None).cast(item_id).alias("item_id"), F.lit(0).alias("start"),
                                         F.lit(0).alias("n_words"), F.lit(0).alias("distance"), F.lit(0.0).alias("similarity"))
    known = broadcast_if_small(bench.select("item", "n", "k", "m", F.explode("counts").alias("x")).select("item", "n", "k", "m", "x.h", "x.c"))
    hashed = doc.select("id", "text_key", word_hashes(F.col("text")).alias("w"))
    found = None
    for k in lengths:
        at = hashed.select("id", "text_key", F.size("w").alias("size"), F.posexplode(shingles(F.col("w"), k)).alias("at", "h"))
        part = at.join(known.where(F.col("k") == k), "h").select("id", "text_key", "size", "item", "n", "k", "m", "at", "h", "c")
        found = part if found is None else found.union(part)
    width = (F.least("n", "size") - F.col("k") + 1).alias("width")  # shingles of a window
    least = F.greatest(F.ceil((F.col("m") + F.col("width")) * (threshold / (1 + threshold)) - 1e-9).cast("int"), F.lit(1))
    key = ["id", "text_key", "item", "k", "m", "width", "last"]
    hits = (found.groupBy("id", "text_key", "size", "item", "n", "k", "m").agg(F.sort_array(F.collect_set(F.struct("at", "h", "c"))).alias("spots"))
            .select("id", "text_key", "item", "k", "m", width, F.greatest(F.col("size") - F.col("n"), F.lit(0)).alias("last"), "spots")
            .where(F.size("spots") >= least))
    runs = start_runs(F.col("spots.at"), least, F.col("width"), F.col("last"))
    hits = cut_lineage(hits.withColumn("runs", runs).where(F.size("runs") > 0))

    windows = fingerprints(doc, hits, lengths).join(broadcast_if_small(bench.select("item", "once", "fp")), "item")
    windows = windows.withColumn("distance", F.bit_count(F.col("window").bitwiseXOR(F.col("fp"))).cast("int"))
    plain = F.col("once") & F.col("single")
    radius = radius_of(threshold)
    blocks = F.array(*[F.struct(F.lit(i).alias("i"), block(F.col("window"), i).alias("value")) for i in range(BLOCKS)])
    looked = (windows.where(plain).select(*key, "start", "distance", F.explode(blocks).alias("b")).select(*key, "start", "distance", "b.i", "b.value")
              .join(broadcast_if_small(block_index(bench, radius)), ["item", "i", "value"])
              .where(F.col("distance") <= radius).select(*key, "start", "distance"))
    candidates = looked.union(windows.where(~plain).select(*key, "start", "distance"))  # one found by several blocks is one below

    spots = hits.select(*key, F.explode("spots").alias("x")).groupBy(*key, "x.h", "x.c").agg(F.sort_array(F.collect_list("x.at")).alias("at"))
    spans = F.transform("at", lambda p, j: F.struct(
        F.greatest(p - F.col("width") + 1, F.coalesce(F.get(F.col("at"), j - F.col("c")) + 1, F.lit(0)), F.lit(0)).alias("lo"),
        F.least(p, F.col("last")).alias("hi")))
    ends = F.explode(F.flatten(F.transform(F.filter(spans, lambda s: s["lo"] <= s["hi"]), lambda s: F.array(
        F.struct(s["lo"].alias("pos"), F.lit(1).alias("add")), F.struct((s["hi"] + 1).alias("pos"), F.lit(-1).alias("add"))))))
    events = spots.select(*key, ends.alias("e")).select(*key, "e.pos", "e.add", F.lit(None).cast("int").alias("distance"))
    rows = events.union(candidates.select(*key, F.col("start").alias("pos"), F.lit(0).alias("add"), "distance"))
    so_far = Window.partitionBy(*key).orderBy("pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    shared = rows.withColumn("shared", F.sum("add").over(so_far)).where("distance is not null")
    checked = shared.withColumn("similarity", F.col("shared") / (F.col("m") + F.col("width") - F.col("shared"))).where(F.col("similarity") >= threshold)
    best = F.max_by(F.struct(F.col("pos").alias("start"), (F.col("width") + F.col("k") - 1).alias("n_words"), "distance", "similarity"),
                    F.struct("similarity", -F.col("pos")))
    named = broadcast_if_small(bench.select("item", "item_id"))
    return checked.join(named, "item").groupBy("id", "text_key", "item_id").agg(best.alias("x")).select("id", "text_key", "item_id", "x.*")


def fingerprints(doc: DataFrame, hits: DataFrame, lengths: list[int]) -> DataFrame:
    """(id, text_key, item, k, m, width, last, start, window, single): the SimHash of every window of the runs of ``hits``.

    ``single``: no shingle is repeated in the stretch of the document that was rolled over.
    """
    pieces = F.flatten(F.transform("runs", lambda r: F.transform(
        F.sequence(r["lo"], r["hi"], F.lit(PIECE)), lambda lo: F.struct(lo.alias("lo"), F.least(lo + PIECE - 1, r["hi"]).alias("hi")))))
    todo = hits.select("id", "text_key", F.struct("item", "k", "m", "width", "last", pieces.alias("pieces")).alias("hit"))
    todo = cut_lineage(todo.groupBy("id", "text_key").agg(F.collect_list("hit").alias("hits")))
    named = doc.join(broadcast_if_small(todo.select("text_key").distinct()), "text_key", "left_semi")
    rows = (named.dropDuplicates(["id", "text_key"]).alias("d")
            .join(todo.alias("h"), F.expr("d.text_key = h.text_key and d.id <=> h.id"))
            .select("d.id", "d.text_key", word_hashes(F.col("d.text")).alias("w"), "h.hits"))
    rows = rows.select("id", "text_key", *[shingles(F.col("w"), k).alias(f"s{k}") for k in lengths], F.explode("hits").alias("hit"))
    runs = F.array().cast("array<bigint>")
    for k in lengths:
        runs = F.when(F.col("hit.k") == k, F.col(f"s{k}")).otherwise(runs)
    rows = rows.select("id", "text_key", "hit.item", "hit.k", "hit.m", "hit.width", "hit.last", runs.alias("runs"), F.explode("hit.pieces").alias("p"))
    stretch = F.slice("runs", F.col("p.lo") + 1, F.col("p.hi") - F.col("p.lo") + F.col("width"))
    rows = rows.select("id", "text_key", "item", "k", "m", "width", "last", F.col("p.lo").alias("lo"), stretch.alias("stretch"))
    rows = rows.select("id", "text_key", "item", "k", "m", "width", "last", "lo", (F.size(F.array_distinct("stretch")) == F.size("stretch")).alias("single"),
                       F.posexplode(rolled(F.col("stretch"), F.col("width"))).alias("at", "window"))
    return rows.select("id", "text_key", "item", "k", "m", "width", "last", (F.col("lo") + F.col("at")).alias("start"), "window", "single")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows and columns of the others stay as they are."""
    bad = broadcast_if_small(contaminated(docs, benchmark).select("id", "text_key").distinct())
    tmp = "__text_key"
    keyed = docs.withColumn(tmp, F.xxhash64("text"))
    return keyed.join(bad, (keyed[tmp] == bad["text_key"]) & keyed["doc_id"].eqNullSafe(bad["id"]), "left_anti").drop(tmp)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of ``benchmark``: one row per document and item, with its best window."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "start", "n_words", "distance", F.round("similarity", 6).alias("similarity"))
