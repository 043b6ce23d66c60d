"""Exact k-nearest-neighbour join (J9), distance-weighted kNN classifier (M6), LOF.

Block nested loop join: query rows are hashed into ``Bq`` blocks and reference
rows into ``Br`` blocks (counts from :func:`plan_blocks`: blocks up to 32k rows
and 16 MB of features a side, see :func:`block_side`, smaller only to give every core work). Every query row is
replicated to the ``Br`` reference blocks of its block row and every reference
row to the ``Bq`` query blocks, so each (query block, reference block) pair
meets in exactly one cogroup. A cogrouped ``applyInPandas`` walks the pair in tiles of
1k queries x 4k references: one NumPy matrix product per tile, the k best candidates per query
(plus every candidate within rounding reach of the k-th) recomputed exactly
from differences, then the k best of the block pair are kept from tile to tile and emitted. A second step keyed
by query id keeps the k best over all reference blocks, ties broken by
(distance, reference id). Groups are bounded by the block size, so no group
grows with the data and no single hot key exists (ids are hashed).

All pairs are compared, which costs queries x references. In up to ``CELL_DIMS``
dimensions, joins of more than ``CELL_PAIRS`` pairs go by the cells of a k-d
tree instead (:mod:`flowlab.operators.cells`), with the same result.

With ``group_col`` only rows of one group meet (a device, a fold): the group is
part of the block key and every group gets block counts of its own, so a group
that holds most of the rows is spread like the whole table would be.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.operators.cells import cells_join, group_key
from flowlab.session import broadcast_if_small, cut_lineage

CELL_DIMS = 8  # features up to which a cell has few neighbour cells
CELL_PAIRS = 2_000_000_000  # pairs from which the cells pay
DEFAULT_BLOCK_ROWS = 4096
QUERY_TILE = 1024  # queries of a tile: 32 MB of products with 4k references
BLOCK_ROWS, BLOCK_VALUES = 32_768, 2 << 20  # rows and feature values of a block at most
BLOCK_OUT = 5 * BLOCK_ROWS  # neighbours that a block emits, about
PAIRS = 1_000_000  # exact distances computed at a time within a tile
GROUPS = 256  # groups of the columns of a tile whose minima bound the k-th distance


def same_ids(qid: np.ndarray, rid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, reference) of equal ids."""
    order = np.argsort(rid, kind="stable")
    lo, hi = np.searchsorted(rid[order], qid, "left"), np.searchsorted(rid[order], qid, "right")
    many = hi - lo
    i = np.repeat(np.arange(len(qid)), many)
    return i, order[np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]


def tile_kernel(d: int, k: int, exclude_self: bool):
    """The function that finds the k best references of every query of a tile with ``d`` features."""

    def nearest(Q, qid, R, rid, centre):
        """(query row, reference row, distance) of the k best references of every query of a tile."""
        # Product form on centred coordinates (its rounding error follows the spread, not the offset), less the
        # query's own norm: one matrix product over the coordinates and a column for the reference's norm.
        q0, r0 = Q - centre, R - centre
        qn, rn = np.einsum("ij,ij->i", q0, q0), np.einsum("ij,ij->i", r0, r0)
        n, kk = len(R), min(k, len(R))
        groups = max(kk, min(GROUPS, n))  # a group is every groups-th column
        pad = -n % groups
        right = np.column_stack([np.concatenate([-2.0 * r0, np.zeros((pad, d))]), np.concatenate([rn, np.full(pad, np.inf)])])
        v = np.column_stack([q0, np.ones(len(q0))]) @ right.T
        if exclude_self:
            own = same_ids(qid, rid)
            v[own] = np.inf
        # k groups have a member up to the k-th smallest group minimum, so it bounds the k-th distance from above
        low = v.reshape(len(Q), -1, groups).min(axis=1)
        kth = np.partition(low, kk - 1, axis=1)[:, kk - 1]
        tol = 1e-9 * (qn + rn.max()) + 1e-12  # far above the rounding error of the product form
        near = v <= (kth + tol)[:, None]
        near[:, n:] = False
        if exclude_self:
            near[own] = False
        ends = np.cumsum(np.count_nonzero(near, axis=1))
        out, start = [], 0
        while start < Q.shape[0]:  # equal rows may all be near: recompute about PAIRS pairs at a time
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + PAIRS, side="right")))
            at = np.flatnonzero(near[start:stop])
            qi, rj = at // near.shape[1] + start, at % near.shape[1]
            acc = np.zeros(qi.shape[0], dtype=np.float64)
            for f in range(d):  # exact, sequential sum of squared differences
                diff = Q[qi, f] - R[rj, f]
                acc += diff * diff
            order = np.lexsort((rid[rj], acc, qi))
            qi, rj, acc = qi[order], rj[order], acc[order]
            place = np.arange(len(qi)) - np.searchsorted(qi, qi)
            best = place < k
            out.append((qi[best], rj[best], np.sqrt(acc[best])))
            start = stop
        return [np.concatenate(x) for x in zip(*out)]

    return nearest


def _kernel(features: list[str], k: int, exclude_self: bool, carry: list[str], tile: int, group: bool = False):
    nearest = tile_kernel(len(features), k, exclude_self)

    def fn(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        cols = ["qid", "rid", "dist", *carry]
        if q.empty or r.empty:
            out = pd.DataFrame({c: pd.Series(dtype="float64") for c in cols}).astype({"qid": "int64", "rid": "int64"})
            return out.assign(_g=np.array([], object)) if group else out
        Q = q[features].to_numpy(dtype=np.float64)
        R = r[features].to_numpy(dtype=np.float64)
        qid = q["_qid"].to_numpy(dtype=np.int64)
        rid = r["_rid"].to_numpy(dtype=np.int64)
        centre = R.mean(axis=0)
        parts = []
        # The reference block is walked in tiles and the k best so far go on to the next one, so memory
        # stays at one (query tile x reference tile) distance matrix and k candidates per query.
        step = min(tile, QUERY_TILE)
        for q0 in range(0, Q.shape[0], step):
            qs = slice(q0, q0 + step)
            best = ()
            for r0 in range(0, R.shape[0], tile):
                rs = slice(r0, r0 + tile)
                i, j, dist = nearest(Q[qs], qid[qs], R[rs], rid[rs], centre)
                found = (i, j + r0, dist)
                if best:
                    i, j, dist = (np.concatenate(x) for x in zip(best, found))
                    order = np.lexsort((rid[j], dist, i))
                    order = order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) < k]
                    found = (i[order], j[order], dist[order])
                best = found
            i, j, dist = best
            parts.append(pd.DataFrame({"qid": qid[qs][i], "rid": rid[j], "dist": dist, **{c: r[c].to_numpy()[j] for c in carry}}))
        out = pd.concat(parts, ignore_index=True)
        return out[cols].assign(_g=q["_g"].iloc[0]) if group else out[cols]

    return fn


def block_side(d: int, k: int) -> tuple[int, int]:
    """Query and reference rows of a block at most: both sides alike replicate the fewest rows for their memory."""
    rows = max(QUERY_TILE, min(BLOCK_ROWS, BLOCK_VALUES // max(1, d)))
    return max(QUERY_TILE, min(rows, BLOCK_OUT // max(1, k))), rows


def plan_blocks(nq: int, nr: int, parallelism: int, q_block_rows: int = BLOCK_ROWS, r_block_rows: int = BLOCK_ROWS,
                tile: int = DEFAULT_BLOCK_ROWS) -> tuple[int, int]:
    """Block counts (Bq, Br): blocks as large as allowed (less replication: nq*Br + nr*Bq rows),
    halved until there are at least 2 x parallelism block pairs or the blocks reach one tile."""
    qb, rb = q_block_rows, r_block_rows
    while True:
        bq, br = max(1, math.ceil(nq / qb)), max(1, math.ceil(nr / rb))
        if bq * br >= 2 * parallelism or (qb <= tile and rb <= tile):
            return bq, br
        if rb >= qb and rb > tile:
            rb //= 2
        elif qb > tile:
            qb //= 2
        else:
            rb //= 2


# Block pairs share this many shuffle partitions at most, however many there are.
MAX_PARTITIONS = 8192


def is_finite(features: list[str]) -> Column:
    """True where every feature is a finite number."""
    out = F.lit(True)
    for f in features:
        out = out & F.coalesce(F.abs(F.col(f).cast("double")) < F.lit(float("inf")), F.lit(False))  # NaN counts as larger
    return out


def group_counts(q: DataFrame, r: DataFrame) -> DataFrame:
    """(_g, nq, nr) for every group on both sides."""
    count = lambda df, name: df.groupBy("_g").agg(F.count(F.lit(1)).alias(name))
    left, right = count(q, "nq"), count(r, "nr").withColumnRenamed("_g", "_gr")
    return cut_lineage(left.join(right, F.col("_g").eqNullSafe(F.col("_gr"))).drop("_gr"))


def group_blocks(q: DataFrame, r: DataFrame, parallelism: int, tile: int, sizes: DataFrame | None = None,
                 side: tuple[int, int] = (BLOCK_ROWS, BLOCK_ROWS)) -> tuple[DataFrame, int]:
    """(_g, bq, br) for every group on both sides, and the number of block pairs; ``sizes`` (_g, nq, nr) if they are known.

    Block sizes start at ``side`` (query and reference rows) and are halved until
    there are at least 2 x parallelism pairs or the blocks reach one tile.
    """
    if sizes is None:
        sizes = group_counts(q, r)
    qb, rb = side
    if tile < DEFAULT_BLOCK_ROWS:
        qb = rb = tile
    while True:
        plan = sizes.select("_g", F.ceil(F.col("nq") / qb).cast("int").alias("bq"), F.ceil(F.col("nr") / rb).cast("int").alias("br"))
        pairs = plan.agg(F.sum(F.col("bq").cast("long") * F.col("br"))).first()[0] or 0
        if pairs >= 2 * parallelism or (qb <= tile and rb <= tile) or not pairs:
            return plan, int(pairs)
        qb, rb = (qb, rb // 2) if rb >= qb and rb > tile else (qb // 2, rb)


def knn_join(queries: DataFrame, refs: DataFrame, features: list[str], k: int = 5,
             q_key: str = "row_key", r_key: str = "row_key", exclude_self: bool = False,
             carry: list[str] | None = None, block_rows: int = DEFAULT_BLOCK_ROWS,
             sizes: tuple[int, int] | None = None, group_col: str | None = None, group_sizes: DataFrame | None = None) -> DataFrame:
    """Exact k nearest references per query (Euclidean). Returns qid, rid, dist, nn_rank, *carry (and the group).

    ``sizes``: (query rows, reference rows) when the caller already knows them
    (they only size the blocks), otherwise both sides are counted; ``group_sizes``:
    the same as a table (_g, nq, nr), one row per group.

    ``carry``: numeric reference columns passed through (e.g. the class label).
    With ``exclude_self`` a query never matches the reference with the same id
    (self-join use, e.g. SMOTE neighbours).

    ``group_col``: a column of both sides; only rows of equal groups (null
    equals null) meet, and neighbours are ranked per (group, query).

    Rows with a null, NaN or infinite feature have no distance: such a
    reference is nobody's neighbour, such a query has no neighbours (no rows).
    """
    carry = carry or []
    group = [F.col(group_col).alias("_g")] if group_col else []
    q = queries.select(F.col(q_key).cast("bigint").alias("_qid"), *group, *[F.col(f).cast("double").alias(f) for f in features])
    r = refs.select(F.col(r_key).cast("bigint").alias("_rid"), *group, *[F.col(f).cast("double").alias(f) for f in features],
                    *[F.col(c) for c in carry])
    q, r = q.where(is_finite(features)), r.where(is_finite(features))
    fields = [T.StructField("qid", T.LongType()), T.StructField("rid", T.LongType()), T.StructField("dist", T.DoubleType()),
              *[T.StructField(c, refs.schema[c].dataType) for c in carry]]
    if len(features) <= CELL_DIMS and block_rows >= DEFAULT_BLOCK_ROWS:
        if group_col:
            group_sizes = group_counts(q, r) if group_sizes is None else group_sizes
            pairs = group_sizes.agg(F.sum(F.col("nq").cast("double") * F.col("nr"))).first()[0] or 0
        else:
            sizes = sizes or (queries.count(), refs.count())
            pairs = sizes[0] * sizes[1]
        if pairs > CELL_PAIRS:
            g = group_key(F.col("_g") if group_col else None)
            cand = cells_join(q.withColumn("_gk", g), r.withColumn("_gk", g).drop("_g"), features, k, exclude_self, carry,
                              tile_kernel(len(features), k, exclude_self))
            return ranked(cand, k, group_col)
    kernel = _kernel(features, k, exclude_self, carry, min(block_rows, DEFAULT_BLOCK_ROWS), bool(group_col))
    par = queries.sparkSession.sparkContext.defaultParallelism
    if group_col:
        fields.append(T.StructField("_g", queries.schema[group_col].dataType))
        plan, pairs = group_blocks(q, r, par, block_rows, group_sizes, block_side(len(features), k))
        plan = broadcast_if_small(plan.withColumnRenamed("_g", "_gp"))  # one row per group
        keys = ["_g", "_bq", "_br"]
        q, r = (df.join(plan, F.col("_g").eqNullSafe(F.col("_gp"))).drop("_gp") for df in (q, r))
        bq, br = F.col("bq"), F.col("br")
    else:
        nq, nr = sizes if sizes else (queries.count(), refs.count())
        n_bq, n_br = plan_blocks(nq, nr, par, *block_side(len(features), k), tile=block_rows) if block_rows >= DEFAULT_BLOCK_ROWS else (
            max(1, math.ceil(nq / block_rows)), max(1, math.ceil(nr / block_rows)))
        keys, pairs, bq, br = ["_bq", "_br"], n_bq * n_br, F.lit(n_bq), F.lit(n_br)
    q = (q.withColumn("_bq", F.pmod(F.xxhash64("_qid"), bq).cast("int"))
         .withColumn("_br", F.explode(F.sequence(F.lit(0), br - 1))))
    r = (r.withColumn("_br", F.pmod(F.xxhash64("_rid"), br).cast("int"))
         .withColumn("_bq", F.explode(F.sequence(F.lit(0), bq - 1))))
    # An explicit partition count on both sides, so adaptive execution does not merge these
    # small-but-CPU-heavy partitions; the cogroup reuses the partitioning.
    n_parts = max(1, min(pairs, MAX_PARTITIONS))
    q = q.drop("bq", "br").repartition(n_parts, *keys)
    r = r.drop("bq", "br").repartition(n_parts, *keys)
    cand = q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(kernel, T.StructType(fields))
    return ranked(cand, k, group_col)


def ranked(cand: DataFrame, k: int, group_col: str | None = None) -> DataFrame:
    """The k nearest candidates of every query (and group ``_g``, renamed), with their rank."""
    w = Window.partitionBy(*(["_g"] if group_col else []), "qid").orderBy("dist", "rid")
    out = cand.withColumn("nn_rank", F.row_number().over(w)).filter(F.col("nn_rank") <= k)
    return out.withColumnRenamed("_g", group_col) if group_col else out


def weighted_vote(neigh: DataFrame, label_col: str = "label", by: list[str] | None = None) -> DataFrame:
    """M6 vote: weight 1/d; if a query has neighbours at distance 0, only those count (weight 1).

    Returns qid (and the group columns ``by``), predicted (largest weight; tie -> smaller label), score
    (weight share of label 1, for ROC/PR curves).
    """
    keys = [*(by or []), "qid"]
    per = (neigh.groupBy(*keys, label_col)
           .agg(F.sum(F.when(F.col("dist") > 0, 1.0 / F.col("dist"))).alias("_inv"),
                F.count_if(F.col("dist") == 0).alias("_z")))
    wq = Window.partitionBy(*keys)
    per = per.withColumn("_hz", F.max("_z").over(wq) > 0)
    per = per.withColumn("_w", F.when(F.col("_hz"), F.col("_z").cast("double"))
                         .otherwise(F.coalesce(F.col("_inv"), F.lit(0.0))))
    per = per.withColumn("_tot", F.sum("_w").over(wq))
    pick = Window.partitionBy(*keys).orderBy(F.desc("_w"), F.asc(label_col))
    per = per.withColumn("_rk", F.row_number().over(pick))
    score = F.sum(F.when(F.col(label_col) == 1, F.col("_w")).otherwise(0.0)).over(wq) / F.col("_tot")
    per = per.withColumn("score", score)
    return per.filter(F.col("_rk") == 1).select(*keys, F.col(label_col).alias("predicted"), "score")


def knn_classify(train: DataFrame, test: DataFrame, features: list[str], k: int = 5,
                 label_col: str = "binary_target", key_col: str = "row_key",
                 block_rows: int = DEFAULT_BLOCK_ROWS, sizes: tuple[int, int] | None = None) -> DataFrame:
    """M6: distance-weighted kNN prediction for every test row (train rows are the references).

    Returns the test rows with ``predicted`` and ``score`` columns.
    """
    neigh = knn_join(test, train, features, k, key_col, key_col, carry=[label_col], block_rows=block_rows,
                     sizes=sizes)
    votes = weighted_vote(neigh, label_col)
    return test.join(votes.withColumnRenamed("qid", key_col), key_col, "left")


def density_ratio(around: Column, own: Column) -> Column:
    """Mean density of the neighbours over the own one; equal rows have infinite density: 1 among their like."""
    top = F.lit(float("inf"))
    return F.when((around == top) & (own == top), 1.0).when(own == top, 0.0).otherwise(around / own)


def _densities(neigh: DataFrame, k_distance: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lrd): 1 over the mean reachability of a row's neighbours; infinite where that is 0."""
    reach = neigh.join(k_distance, [*keys[:-1], "rid"]).withColumn("_reach", F.greatest("_kd_o", "dist"))
    mean = reach.groupBy(*keys).agg(F.avg("_reach").alias("_mr"))
    return mean.select(*keys, F.when(F.col("_mr") > 0, 1.0 / F.col("_mr")).otherwise(F.lit(float("inf"))).alias("lrd"))


def novelty_lof(refs: DataFrame, queries: DataFrame, features: list[str], k: int = 5, key_col: str = "row_key",
                group_col: str | None = None, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """LOF of every query row against reference rows only (e.g. benign ones), per group if given.

    k-distance and density of a reference come from the other references of its
    group. A query that is a reference itself does not see itself.
    k-distance(o) = distance to o's k-th neighbour; reach(p, o) = max(k-distance(o), d(p, o));
    lrd(p) = 1 / mean_o reach(p, o); LOF(p) = mean_o lrd(o) / lrd(p), see :func:`density_ratio`
    for equal rows. Ties at the k-th neighbour are cut at k by (distance, id).

    Returns one row per query: key, group, k_distance, lrd, lof; null where there is no distance
    (null, NaN or infinite features) or no reference with neighbours.
    """
    by = [group_col] if group_col else []
    group = F.col(group_col) if group_col else F.lit(0)
    alone = refs is queries
    refs, queries = refs.withColumn("_lof_g", group), queries.withColumn("_lof_g", group)
    own = cut_lineage(knn_join(refs, refs, features, k, key_col, key_col, exclude_self=True, block_rows=block_rows, group_col="_lof_g"))
    far = own.groupBy(F.coalesce(F.col("_lof_g").cast("string"), F.lit("null")).alias("_gk"), F.col("qid").alias("rid")).agg(F.max("dist").alias("_kd_o"))
    keyed = lambda df: df.withColumn("_gk", F.coalesce(F.col("_lof_g").cast("string"), F.lit("null"))).drop("_lof_g")
    lrd_o = _densities(keyed(own), far, ["_gk", "qid"]).select("_gk", F.col("qid").alias("rid"), F.col("lrd").alias("_lrd_o"))
    neigh = keyed(own) if alone else cut_lineage(keyed(knn_join(queries, refs, features, k, key_col, key_col, exclude_self=True,
                                                                block_rows=block_rows, group_col="_lof_g")))
    lrd = _densities(neigh, far, ["_gk", "qid"])
    around = neigh.join(lrd_o, ["_gk", "rid"]).groupBy("_gk", "qid").agg(F.avg("_lrd_o").alias("_mo"))
    reach = neigh.groupBy("_gk", "qid").agg(F.max("dist").alias("k_distance"))
    scored = lrd.join(around, ["_gk", "qid"]).join(reach, ["_gk", "qid"]).withColumn("lof", density_ratio(F.col("_mo"), F.col("lrd")))
    rows = keyed(queries.select(F.col(key_col), *[F.col(c) for c in by], "_lof_g")).withColumn("qid", F.col(key_col).cast("bigint"))
    return rows.join(scored, ["_gk", "qid"], "left").select(key_col, *by, "k_distance", "lrd", "lof")


def local_outlier_factor(df: DataFrame, features: list[str], k: int = 5, key_col: str = "row_key",
                         block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """LOF of every row among all rows (self excluded): key, k_distance, lrd, lof. See :func:`novelty_lof`."""
    return novelty_lof(df, df, features, k, key_col, None, block_rows)
