"""Exact top-k by inner product with pivot-table elimination.

For the Euclidean distance d(q, x), a pivot p gives |d(q, p) - d(x, p)| <= d(q, x),
and the largest of these bounds over many pivots is a lower bound of the
distance. With the norms it is an upper bound of the score,
q.x = (|q|^2 + |x|^2 - d^2) / 2. Candidates are evaluated in bound order until
the bound falls below the k-th best score found: exact, ties included.

The table of distances to the pivots is computed once per row, before rows are
dealt to blocks. Candidates and queries are hashed into blocks; every pair of
blocks is one group, so groups are bounded whatever the table size, and each
group returns its k best per query for a final merge. Rows are told apart by a
number of their own, so repeated ids and equal vectors are ordinary rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlab.llm.common import cut_lineage, table

K = 5
PIVOTS = 32
SCALE = 256
EVERY = 50
BLOCK_ROWS = 16_384  # candidates per block
BLOCK_QUERIES = 1_024  # queries per block
MIN_BLOCK = 256  # blocks are not cut smaller than this while there are fewer than SPREAD of them
SPREAD = 64
CHUNK = 64  # candidates evaluated at a time, in bound order
NULL_LAST = 2**63 - 1  # place of a null id among ties


def quantise(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v array<long>): floor(scale * x); vectors null, empty or with null or non-finite parts are left out."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return (vectors.where(x.isNotNull() & (F.size(x) > 0) & fine)
            .select(F.col(id_col).cast("long").alias("id"),
                    F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v")))


def n_blocks(rows: int, most: int) -> int:
    return max(1, -(-rows // most), min(SPREAD, rows // MIN_BLOCK))


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of the rows of x to the pivots, (rows, pivots)."""
    x, out = x.astype(float), np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots.astype(float)):
        out[:, j] = np.sqrt(((x - p) ** 2).sum(1))
    return out


@dataclass
class Rows:
    """Rows of a block: their numbers, ids in the order of ties, integer vectors, distances to the pivots."""

    row: np.ndarray
    tie: np.ndarray
    v: np.ndarray
    table: np.ndarray


def best_in_block(queries: Rows, rows: Rows, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query index, candidate index, scores, evaluated): the k best candidates of every query of one block pair."""
    q, c = queries.v, rows.v
    nc, nq = (c.astype(float) ** 2).sum(1), (q.astype(float) ** 2).sum(1)
    out_q, out_c, out_s, evaluated = [], [], [], 0
    for i in range(len(q)):
        low = np.abs(rows.table[:, 0] - queries.table[i, 0])
        for j in range(1, rows.table.shape[1]):
            np.maximum(low, np.abs(rows.table[:, j] - queries.table[i, j]), out=low)
        # rounding of the distances is far below this slack; it only widens the bound
        size = np.sqrt(nc) + np.sqrt(nq[i])
        low = np.maximum(low - 1e-9 * (1 + size + rows.table.max(initial=0.0)), 0)
        bound = (nq[i] + nc - low ** 2) / 2 + 1e-9 * (1 + nq[i] + nc)
        order = np.argsort(-bound, kind="stable")
        best, scores, at = np.empty(0, np.int64), np.empty(0, np.int64), 0
        while at < len(order):
            kth = scores[k - 1] if len(scores) >= k else None
            if kth is not None and bound[order[at]] < kth:
                break
            now = order[at:at + CHUNK]
            at += len(now)
            now = now[rows.row[now] != queries.row[i]]
            evaluated += len(now)
            best, scores = np.concatenate([best, now]), np.concatenate([scores, c[now] @ q[i]])
            top = np.lexsort((rows.tie[best], -scores))[:k]
            best, scores = best[top], scores[top]
        out_q.append(np.full(len(best), i))
        out_c.append(best)
        out_s.append(scores)
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s), evaluated


def top_k(vectors: DataFrame, query: Column, k: int = K, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, query_row, rank, id, score) of the rows of ``vectors`` (id, v: integers) for which ``query`` holds.

    A query never meets its own row; other rows of its id are candidates, and
    every row is a query of its own (``query_row`` tells them apart). Ties go to
    smaller ids, null last; a null id is carried. Only vectors of one length are
    compared. Fewer than k candidates give fewer rows; no candidates give none.
    The pivots are distinct candidates picked by hash, at most ``pivots`` for a
    length: a bounded set, whatever the data. A length without pivots takes the
    origin.
    """
    vectors = cut_lineage(vectors.select("id", "v", F.monotonically_increasing_id().alias("row")))
    n_c, n_q = vectors.count(), vectors.where(query).count()
    b_c, b_q = n_blocks(n_c, BLOCK_ROWS), max(1, -(-n_q // BLOCK_QUERIES))
    slots = (vectors.select("v", F.size("v").alias("n"), F.xxhash64("v").alias("h"))
             .groupBy("n", F.pmod("h", F.lit(8 * pivots)).alias("slot")).agg(F.min_by("v", "h").alias("v")))
    table_p: dict[int, list] = {}
    for row in slots.orderBy("slot", "n").limit(8 * pivots).select("v").collect():
        table_p.setdefault(len(row["v"]), []).append(list(row["v"]))
    table_p = {n: p[:pivots] for n, p in table_p.items()}

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            far = [None] * len(rows)
            for n, at in rows.groupby(rows["v"].str.len()).indices.items():
                found = to_pivots(np.stack(rows["v"].to_numpy()[at]), np.array(table_p.get(n) or [[0] * n]))
                for i, f in zip(at, found):
                    far[i] = f
            yield rows.assign(far=far)

    known = vectors.mapInPandas(measure, "id long, v array<long>, row long, far array<double>").withColumn("n", F.size("v"))
    whole = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    part_c = known.select(F.lit(0).alias("side"), "row", "id", "v", "far", "n", F.pmod(F.xxhash64("row"), F.lit(b_c)).alias("bc"), whole(b_q).alias("bq"))
    part_q = known.where(query).select(F.lit(1).alias("side"), "row", "id", "v", "far", "n", whole(b_c).alias("bc"),
                                       F.pmod(F.xxhash64("row"), F.lit(b_q)).alias("bq"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        is_q = rows["side"].to_numpy() == 1
        ids = rows["id"].astype("Int64")
        sides = []
        for side in (is_q, ~is_q):
            v, far = rows["v"].to_numpy()[side], rows["far"].to_numpy()[side]
            sides.append(Rows(rows["row"].to_numpy()[side], ids[side].fillna(NULL_LAST).to_numpy(np.int64),
                              np.stack(v).astype(np.int64) if len(v) else np.empty((0, 0), np.int64), np.stack(far) if len(far) else np.empty((0, 0))))
        if is_q.all() or not is_q.any():
            return pd.DataFrame({"query_id": ids[:0], "query_row": [], "id": ids[:0], "score": []}).astype({"query_row": "int64", "score": "int64"})
        a, b, s, _ = best_in_block(*sides, k)
        return pd.DataFrame({"query_id": ids[is_q].to_numpy()[a], "query_row": sides[0].row[a], "id": ids[~is_q].to_numpy()[b], "score": s}).astype(
            {"query_id": "Int64", "id": "Int64"})

    found = part_c.unionByName(part_q).groupBy("n", "bc", "bq").applyInPandas(run, "query_id long, query_row long, id long, score long")
    best = W.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "query_row", "rank", "id", "score")


def op10_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's 5 highest integer inner products over ``embeddings`` (queries: vec_id divisible by 50)."""
    v = quantise(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    out = top_k(v, F.col("id") % EVERY == 0)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
