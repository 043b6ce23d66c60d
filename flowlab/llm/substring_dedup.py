"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A word goes when a window of ``WINDOW`` words covers it whose word sequence also
starts in a document of a smaller id. Every window gets a Rabin-Karp hash
(two polynomials over word hashes, modulo 2^64, from prefix sums; the words are
hashed from their bytes likewise). Shuffling one row per window would move several times the text,
so neighbouring windows travel together:

1. The anchor of a window is its ``GRAM``-word run of the smallest hash, the
   first of equal ones. It depends on the window's words alone, so equal
   windows have equal anchors. Consecutive windows with one anchor are a run
   (about 20 windows); its key is the hash of all its words and its place
   around the anchor.
2. Anchors are counted in Spark. Runs go on only where their anchor is in two
   documents; nothing repeated is lost.
3. Where all runs of an anchor have one key, the smallest id of the key decides
   all its windows at once.
4. Else one run of each key is looked up in its text, the hashes of its windows
   are counted one by one, and the smallest id per window returns to the keys.
5. The repeated windows of a document merge into maximal removal intervals.

Keys of runs and windows have 128 bits. No group is ever collected but the runs
of one document and the (at most ``WINDOW``) windows of one key; counts are
combined before each shuffle and hot keys only meet joins that Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm.common import cut_lineage, table

WINDOW = 50
GRAM = 8
CHUNK = 1 << 21  # bytes of text handled at a time; a longer text is a chunk of its own
PIECE = 1 << 20  # bytes of a chunk hashed at a time
BASES = (0x9E3779B97F4A7C15 | 3, 0xC2B2AE3D27D4EB4F | 3)
LAST = 2**63 - 1  # order of a null id


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values, so that all bits are fit for comparison."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64))  # value of a byte in the hash of a word
SPACES = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


class Rolling:
    """Rabin-Karp hashes of the word runs of some texts; the words themselves are hashed from their bytes the same way."""

    def __init__(self):
        self.powers = [np.ones(1, np.uint64)] * 4

    def grow(self, n: int) -> None:
        """Powers of both bases and of their inverses, beyond n."""
        if len(self.powers[0]) <= n:
            for k, base in enumerate(BASES):
                for j, b in enumerate((base, pow(base, -1, 2**64))):
                    steps = np.full(n + n // 4 + 1, b, np.uint64)
                    steps[0] = 1
                    self.powers[2 * k + j] = np.multiply.accumulate(steps)

    def spans(self, k: int, total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Polynomials of the values lo to hi (exclusive) from the prefix sums of value times power."""
        return (total[hi] - total[lo]) * self.powers[2 * k + 1][lo]

    def sums_of(self, k: int, values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers[2 * k][:len(values)], out=total[1:])
        return total

    def load(self, texts: list[bytes]) -> None:
        """Words of the texts, one after the other, and the prefix sums of their hashes."""
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        blank = np.concatenate(([True], SPACES[data]))
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        lo, hi = edge[::2], edge[1::2]
        offset = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.size = np.diff(np.searchsorted(lo, offset))
        self.first = np.cumsum(self.size) - self.size
        self.n = n = len(lo)
        hashes = np.zeros((2, n), np.uint64)
        at = 0
        while at < n:  # a piece of bytes at a time; a longer word is a piece of its own
            end = max(at + 1, int(np.searchsorted(hi, lo[at] + PIECE, "right")))
            part = BYTES[data[lo[at]:hi[end - 1]]]
            self.grow(len(part))
            for k in (0, 1):
                value = self.spans(k, self.sums_of(k, part), lo[at:end] - lo[at], hi[at:end] - lo[at])
                hashes[k, at:end] = mix(value + (hi[at:end] - lo[at:end]).astype(np.uint64))
            at = end
        self.grow(n)
        self.sums = [self.sums_of(k, hashes[k]) for k in (0, 1)]

    def hash(self, k: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of the words lo to hi (exclusive), with the k-th base."""
        return self.spans(k, self.sums[k], lo, hi)


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    width = 1
    while 2 * width <= k:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:len(x) - (k - width)], x[k - width:]) if k > width else x


def runs(roll: Rolling, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first start, number of windows, anchor hash, key, key) of all runs of a loaded chunk."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if roll.n < window:
        return none
    at = np.arange(roll.n - gram + 1)
    grams = mix(roll.hash(0, at, at + gram))
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    anchor = (sliding_min(packed, window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(roll.size)), roll.size)
    ends = (roll.first + roll.size)[text]
    start = np.flatnonzero(ends - np.arange(roll.n) >= window)
    if not len(start):
        return none
    anchor = anchor[start]
    new = np.flatnonzero(np.concatenate(([True], (start[1:] != start[:-1] + 1) | (anchor[1:] != anchor[:-1]))))
    many = np.diff(np.append(new, len(start)))
    s, a = start[new], anchor[new]
    place = ((a - s) * (window + 1) + many).astype(np.uint64)
    key = [mix(roll.hash(k, s, s + many + window - 1) + mix(place + np.uint64(k))) for k in (0, 1)]
    return text[s], s - roll.first[text[s]], many, grams[a], key[0], key[1]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def chunks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[int], list[bytes]]]:
    """(batch, rows, their texts), at most ``CHUNK`` bytes or one text at a time."""
    for batch in batches:
        rows, found, held = [], [], 0
        column = batch.column(text).cast(pa.large_binary())
        for i in range(batch.num_rows):
            raw = column[i].as_py() or b""
            if rows and held + len(raw) > CHUNK:
                yield batch, rows, found
                rows, found, held = [], [], 0
            rows.append(i)
            found.append(raw)
            held += len(raw)
        if rows:
            yield batch, rows, found


def occurrences(named: DataFrame, window: int) -> DataFrame:
    """(h, c1, c2, o, r, s, m): anchor, key, order of the id, row, first start and number of windows of every run."""
    gram = min(GRAM, window)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling()
        for batch, rows, texts in chunks(batches, 2):
            roll.load(texts)
            text, s, m, h, c1, c2 = runs(roll, window, gram)
            pick = pa.array(np.array(rows, np.int64)[text])
            yield pa.RecordBatch.from_arrays(
                [signed(h), signed(c1), signed(c2), batch.column(0).take(pick), batch.column(1).take(pick),
                 pa.array(s.astype(np.int32)), pa.array(m.astype(np.int32))], ["h", "c1", "c2", "o", "r", "s", "m"])

    return named.select("o", "r", "text").mapInArrow(find, "h long, c1 long, c2 long, o long, r long, s int, m int")


def run_windows(named: DataFrame, picked: DataFrame, window: int) -> DataFrame:
    """(w1, w2, at, lo): every window of the picked runs (r, s, m, k, lo), found again in their texts; at = k * window + offset."""
    todo = picked.groupBy("r").agg(F.collect_list(F.struct("s", "m", "k", "lo")).alias("todo"))
    # rows of one id and text share r: one of them is enough
    joined = named.select("r", "text").join(todo, "r").dropDuplicates(["r"]).select("text", "todo")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling()
        for batch, rows, texts in chunks(batches, 0):
            roll.load(texts)
            lists = batch.column(1).take(pa.array(rows))
            part = lists.flatten()
            s, m, k, lo = (part.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            text = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
            off = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            at = np.repeat(roll.first[text] + s, m) + off
            yield pa.RecordBatch.from_arrays(
                [signed(mix(roll.hash(0, at, at + window))), signed(mix(roll.hash(1, at, at + window))),
                 pa.array(np.repeat(k * window, m) + off), pa.array(np.repeat(lo, m))], ["w1", "w2", "at", "lo"])

    return joined.mapInArrow(find, "w1 long, w2 long, at long, lo long")


def removals(named: DataFrame, window: int = WINDOW) -> DataFrame:
    """(r, intervals): array<struct(a, b)> of word ranges to remove (b exclusive, may overlap), for rows that have any."""
    occ = occurrences(named, window)
    # stored, so that the join below deals both sides itself and can split a hot anchor
    shared = cut_lineage(occ.groupBy("h").agg(F.min("o").alias("a"), F.max("o").alias("b")).where("a < b").select("h"))
    occ = cut_lineage(occ.join(shared, "h", "left_semi"))
    keys = occ.groupBy("h", "c1", "c2").agg(F.min("o").alias("lo"), F.first("r").alias("r"), F.first("s").alias("s"), F.first("m").alias("m"))
    keys = cut_lineage(keys.withColumn("k", F.monotonically_increasing_id()))
    of_anchor = cut_lineage(keys.groupBy("h").agg(F.count("*").alias("n")))
    keys = keys.join(of_anchor, "h")
    alone = keys.where("n = 1").select("c1", "c2", F.array(F.struct(F.lit(0).alias("off"), F.col("m").alias("m"), F.col("lo").alias("lo"))).alias("firsts"))

    each = cut_lineage(run_windows(named, keys.where("n > 1"), window))
    first = each.groupBy("w1", "w2").agg(F.min("lo").alias("first"), F.max("lo").alias("other")).where("first < other").drop("other")
    told = each.join(cut_lineage(first), ["w1", "w2"], "left").select("at", F.coalesce("first", "lo").alias("first"))
    # at most ``window`` windows a key
    off = (F.col("at") % window).cast("int").alias("off")
    several = told.groupBy(F.expr(f"at div {window}").alias("k")).agg(
        F.sort_array(F.collect_set(F.struct(off, F.lit(1).alias("m"), F.col("first").alias("lo")))).alias("firsts"))
    several = several.join(keys.select("k", "c1", "c2"), "k").select("c1", "c2", "firsts")

    hit = (occ.select("c1", "c2", "o", "r", "s").join(alone.unionByName(several), ["c1", "c2"])
           .select("r", "s", F.filter("firsts", lambda x: x["lo"] < F.col("o")).alias("gone")).where(F.size("gone") > 0))
    # windows in a row become one interval
    joined = F.aggregate("gone", F.array().cast("array<struct<a:int,b:int>>"), lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["b"] >= x["off"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["a"].alias("a"), (x["off"] + x["m"]).alias("b")))))
        .otherwise(F.concat(acc, F.array(F.struct(x["off"].alias("a"), (x["off"] + x["m"]).alias("b"))))))
    ranges = hit.select("r", F.explode(F.transform(joined, lambda x: F.struct(
        (F.col("s") + x["a"]).alias("a"), (F.col("s") + x["b"] + window - 1).alias("b")))).alias("x"))
    return ranges.groupBy("r").agg(F.collect_list("x").alias("intervals"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept): every row with its kept words joined by one space.

    Words are runs of characters other than the six ASCII white-space ones,
    compared as they are. Null and blank texts have no words and keep the empty
    text. Texts of fewer words than the window keep all. Rows of one id do not
    remove from each other, whether they repeat a text or differ; a null id
    counts as larger than any other, so its rows lose what rows with an id
    hold. Repeated rows stay and have the same result. Other columns, whatever
    their names, are ignored; an empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    named = docs.select(F.col(id_col).alias("id"), order.alias("o"), F.xxhash64(order, F.col(text_col)).alias("r"), F.col(text_col).alias("text"))
    marked = named.join(removals(named, window), "r", "left").select("id", "text", "intervals")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lists = batch.column(1).cast(pa.large_binary()), batch.column(2)
            n_words, n_removed, kept = [], [], []
            for i in range(batch.num_rows):
                words = (text[i].as_py() or b"").split()
                n = len(words)
                if lists[i].is_valid:
                    part = lists[i].values
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, part.field(0).to_numpy(), 1)
                    np.add.at(edge, part.field(1).to_numpy(), -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(edge)[:n] == 0)]
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                ["id", "n_words", "n_removed", "kept"])

    return marked.mapInArrow(keep, f"id {kind}, n_words long, n_removed long, kept string")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` that no repeated 50-word window covers: counts and a digest of the kept words."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
