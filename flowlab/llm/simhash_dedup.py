"""SimHash near-duplicate groups with bit-sliced distance counting.

Plan:

1. One pass over the texts gives a 64-bit SimHash per document.
2. Equal fingerprints collapse to one row each, so copies cost nothing below.
3. Every fingerprint is filed under keys made of ``m - r`` of its ``m`` blocks
   (all choices). Two fingerprints within ``r`` bits differ in at most ``r``
   blocks, so they share at least one key: no linked pair is lost.
4. Inside a bucket, fingerprints are compared with bit planes stored
   vertically: 64 lanes per machine word, carry-save counters, and words whose
   lanes all exceed the radius are abandoned. Only a spanning forest of the
   links leaves the task.
5. Connected components of the forest edges give the groups.

A bucket above ``CHUNK`` rows is cut into chunks by a hash of the fingerprint,
and every pair of chunks is a unit of its own, so a hot key never meets in one
task. Bucket keys get longer (more blocks) as the number of distinct
fingerprints grows; the result does not depend on that choice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm.common import cut_lineage, table
from flowlab.llm.components import connected_components

SHINGLE = 3
RADIUS = 3
CHUNK = 1024
PIECE = 1 << 16  # shingles hashed at a time: bounds the memory of a very long text


def text_fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned SimHash of a UTF-8 text: A-Z lowered, word shingles with repeats, XXH64 seed 42."""
    import xxhash

    words = raw.lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space characters
    if not words:
        return 0
    size = min(shingle, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    lo, hi = starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist()
    total, xxh = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for p in range(0, len(lo), PIECE):
        h = np.array([xxh(line[a:b], 42) for a, b in zip(lo[p:p + PIECE], hi[p:p + PIECE])], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * total > len(lo)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, text_key, fp): one row per input row, fp the signed 64-bit view of the SimHash; null text is the empty text.

    ``text_key`` is xxhash64 of the text: with the id it names a row and its repeats.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.binary())
            out = np.fromiter((text_fingerprint(t.as_py() or b"", shingle) for t in texts), "<u8", len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out.view(np.int64))], ["id", "text_key", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, text_key long, fp long")


def block_keys(n_distinct: int, radius: int) -> list[list[tuple[int, int]]]:
    """Key layouts: for each key the (first bit, width) of its blocks, for the fewest blocks that keep buckets small."""
    for m in range(radius + 1, 65):
        edges = [round(i * 64 / m) for i in range(m + 1)]
        blocks = [(a, b - a) for a, b in zip(edges, edges[1:])]
        keys = [list(c) for c in combinations(blocks, m - radius)]
        if n_distinct / 2 ** min(sum(w for _, w in k) for k in keys) <= CHUNK or m >= radius + 4:
            return keys
    raise AssertionError


def bit_planes(fp: np.ndarray) -> np.ndarray:
    """uint64 fingerprints -> (64, words + 1) planes; lane i of plane b is bit b of fingerprint i."""
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    rows = -(-len(fp) // 64) * 64 + 64
    padded = np.zeros((64, rows), np.uint8)
    padded[:, :len(fp)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def lanes(mask: np.ndarray, words: int) -> np.ndarray:
    padded = np.zeros(words * 64, np.uint8)
    padded[:len(mask)] = mask
    return np.packbits(padded, bitorder="little").view("<u8")


def sliced_forest(fp: np.ndarray, left: np.ndarray, radius: int) -> np.ndarray:
    """Root row of every row, for links within ``radius`` bits between rows of one bucket.

    ``left[i]`` is the number of rows after i in its bucket (rows are sorted by
    bucket). For each shift s all rows i are compared with rows i + s at once.
    """
    n = len(fp)
    root = np.arange(n)
    top = int(left.max(initial=0))
    if not top:
        return root
    planes = bit_planes(fp)
    words = planes.shape[1] - 1
    planes = np.concatenate([planes, np.zeros((64, top // 64 + 2), "<u8")], axis=1)
    width = max(1, int(radius).bit_length())
    start = 2 ** width - (radius + 1)  # the counter overflows on difference radius + 1
    for s in range(1, top + 1):
        open_ = left >= s
        if not open_.any():
            break
        open_[:n - s] &= root[:n - s] != root[s:]  # rows already in one tree need no comparison
        live = lanes(open_, words)
        act = np.flatnonzero(live)
        live = live[act]
        skip, r = divmod(s, 64)
        full = ~np.uint64(0)
        count = [np.full(len(act), full if start >> i & 1 else 0, "<u8") for i in range(width)]
        over = np.zeros(len(act), "<u8")
        for b in range(64):
            if not len(act):
                break
            plane = planes[b]
            other = plane[act + skip]
            if r:
                other = (other >> np.uint64(r)) | (plane[act + skip + 1] << np.uint64(64 - r))
            carry = plane[act] ^ other
            for i in range(width):
                count[i], carry = count[i] ^ carry, count[i] & carry
            over |= carry
            if b % 8 == 7:
                keep = (live & ~over) != 0
                if not keep.all():
                    act, live, over = act[keep], live[keep], over[keep]
                    count = [c[keep] for c in count]
        hit = live & ~over
        at = np.flatnonzero(hit)
        if len(at):
            lane = np.unpackbits(hit[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            word, off = np.nonzero(lane)
            i = act[at][word] * 64 + off
            root = merge(root, i, i + s)
    return root


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Root array after linking rows i and j (smallest row of a tree is its root)."""
    while True:
        a, b = root[i], root[j]
        new = a != b
        if not new.any():
            return root
        parent = np.arange(len(root))
        np.minimum.at(parent, np.maximum(a, b)[new], np.minimum(a, b)[new])
        while (parent != (up := parent[parent])).any():
            parent = up
        root = parent[root]


def _forest(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Buckets arrive whole and sorted; the last, maybe incomplete, bucket of a batch waits for the next one."""
    rest = None

    def edges(rows: pd.DataFrame) -> pd.DataFrame:
        unit = rows["unit"].to_numpy()
        fp = rows["fp"].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        size = np.diff(np.append(first, len(unit)))
        left = np.repeat(first + size, size) - np.arange(len(unit)) - 1
        root = sliced_forest(fp.view(np.uint64), left, radius)
        at = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": fp[at], "b": fp[root[at]]})

    for rows in batches:
        rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
        unit = rows["unit"].to_numpy()
        cut = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0
        rest = rows.iloc[cut:]
        if cut:
            yield edges(rows.iloc[:cut].reset_index(drop=True))
    if rest is not None and len(rest):
        yield edges(rest.reset_index(drop=True))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Forest edges (a, b) that connect exactly the fingerprints linked within ``radius`` bits; ``distinct`` has fp."""
    layouts = block_keys(distinct.count(), radius)

    def value(blocks):
        out, used = F.lit(0).cast("long"), 0
        for first, width in blocks:
            part = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
            out, used = out.bitwiseOR(F.shiftleft(part, used % 64)), used + width
        return out

    keys = F.array(*[F.struct(F.lit(t).alias("t"), value(b).alias("key")) for t, b in enumerate(layouts)])
    filed = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    hot = (filed.groupBy("t", "key").count().where(F.col("count") > CHUNK)
           .select("t", "key", F.ceil(F.col("count") / CHUNK).cast("int").alias("g")))
    part = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    split = (filed.join(hot, ["t", "key"], "left").withColumn("c", F.when(F.col("g").isNotNull(), part))
             .withColumn("d", F.explode(F.when(F.col("g").isNull(), F.array(F.lit(-1)))
                                        .otherwise(F.filter(F.sequence(F.lit(0), F.col("g") - 1),
                                                            lambda x: x != F.col("c")))))
             .withColumn("unit", F.xxhash64("t", "key", F.least("c", "d"), F.greatest("c", "d"))))
    return (split.select("unit", "fp").repartition("unit").sortWithinPartitions("unit", "fp")
            .mapInPandas(lambda it: _forest(it, radius), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """(id, text_key, fp, component, group): one row per input row; component is the smallest id of the linked group.

    ``group`` is a fingerprint that names the group, as two groups have one
    component where rows of one id are not linked.
    Null or blank texts have fingerprint zero and link like any other. Rows
    with a null id take part; a group of null ids only has a null component.
    Repeated rows stay. An empty table gives an empty table. Other columns,
    whatever their names, are ignored.
    """
    each = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut_lineage(each.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    tree = connected_components(links(distinct, radius))
    named = distinct.join(tree.withColumnRenamed("node", "fp"), "fp", "left")
    groups = (named.where("component is not null").groupBy("component").agg(F.min("first").alias("low")))
    shared = (named.join(groups, "component", "left").where("n > 1 or component is not null")
              .select("fp", F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("low")).alias("low"),
                      F.coalesce("component", "fp").alias("group"), F.lit(True).alias("shared")))
    shared = cut_lineage(shared)  # stored, so that the join below deals both sides itself and can split a hot fingerprint
    return (each.join(shared, "fp", "left")
            .select("id", "text_key", "fp", F.when(F.col("shared"), F.col("low")).otherwise(F.col("id")).alias("component"),
                    F.coalesce("group", "fp").alias("group")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group: the one of the smallest id, null last. Columns stay as they are.

    Rows of one id with texts that are not linked are different documents, each
    judged in its own group; of linked ones, and of a group of null ids only,
    the smallest text hash stays. Repeated rows become one row.
    """
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")
    groups = near_duplicates(docs).groupBy("id", "text_key", "group").agg(F.count("*").alias("n"))
    stay = cut_lineage(groups.groupBy("group").agg(F.min_by(F.struct("id", "text_key", "n"), rank).alias("x")).select("x.*"))
    tmp, key, own = "__copies", "__kept_id", "__text_key"
    rows = stay.select(F.col("id").alias(key), F.col("text_key").alias(own), F.col("n").alias(tmp))
    kept = docs.withColumn("__own_key", F.xxhash64("text"))
    kept = kept.join(rows, kept["doc_id"].eqNullSafe(F.col(key)) & (F.col("__own_key") == F.col(own))).drop(key, own)
    once = kept.where(F.col(tmp) == 1).drop(tmp, "__own_key")
    if stay.where("n > 1").isEmpty():
        return once
    again = kept.where(F.col(tmp) > 1).dropDuplicates(["doc_id", "__own_key"]).drop(tmp, "__own_key")
    return once.unionByName(again)


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``documents``: 3-word shingles, links at 3 or fewer differing bits."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.col("component").alias("component_id"))
