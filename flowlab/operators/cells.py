"""Exact k nearest neighbours in few dimensions: a join over the cells of a k-d tree, in two rounds.

Blocks of all pairs (:mod:`flowlab.operators.knn`) cost queries x references;
here a query meets only the cells near it. Cut points come from a bounded
sample of the references (they only place the cells, no result depends on
them); a cell holds about ``LEAF_ROWS`` references.

1. Every query meets the references of its own cell: the k-th distance found
   there bounds the true one from above.
2. Every query meets the cells whose box is within that bound; candidates
   beyond it are dropped, a window keeps the k best by (distance, id).

Distances to boxes are computed by the steps of the distances to rows, and
these steps are monotone in floating point, so no cell with a neighbour is
missed. Of equal references (all features) only those with the k smallest ids
can be anybody's neighbours, the others are left out: a point that many rows
share is no large cell. Cells that many queries share are read by several
groups of queries.

Groups: queries meet the references of their own group (a tree per group), or,
with ``scalers``, those of all other groups, scaled by the query's group: one
copy of the references then serves all folds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.session import broadcast_if_small, cut_lineage

LEAF_ROWS = 2048  # references of a cell, about
LEAF_SAMPLE = 16  # of them in the sample that sets the cuts
MAX_LEAVES = 32_768  # of all trees; beyond, cells grow
QUERY_ROWS = 16_384  # queries of a cell that meet it in one group
TILE = 1024  # queries compared at a time
STEP = 16_384  # queries looked up in a tree at a time


@dataclass
class Tree:
    """Nodes of a k-d tree: rows with feature ``dim`` <= ``cut`` go left; ``dim`` is -1 in a leaf."""

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray  # the right child follows the left one
    lo: np.ndarray
    hi: np.ndarray

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        node = np.zeros(len(x), np.int32)
        while True:
            inner = np.flatnonzero(self.dim[node] >= 0)
            if not len(inner):
                return node
            at = node[inner]
            node[inner] = self.left[at] + (x[inner, self.dim[at]] > self.cut[at])

    def within(self, x: np.ndarray, radius: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves whose box lies within the radius of the row; ``lo``, ``hi``: boxes in the scale of x."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int32)
        rows, leaves = [], []
        while len(row):
            keep = box_distance(x[row], lo[node], hi[node]) <= radius[row]
            row, node = row[keep], node[keep]
            leaf = self.dim[node] < 0
            rows.append(row[leaf])
            leaves.append(node[leaf])
            row, node = np.repeat(row[~leaf], 2), np.repeat(self.left[node[~leaf]], 2)
            node[1::2] += 1
        return np.concatenate([*rows, np.array([], np.int64)]), np.concatenate([*leaves, np.array([], np.int32)])


def box_distance(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Distance of rows to boxes, by the steps of the distance between rows."""
    acc = np.zeros(np.broadcast_shapes(x.shape, lo.shape)[:-1])
    for f in range(x.shape[-1]):
        off = np.maximum(np.maximum(lo[..., f] - x[..., f], x[..., f] - hi[..., f]), 0.0)
        acc += off * off
    return np.sqrt(acc)


def build_tree(sample: np.ndarray) -> Tree:
    """Cuts the sample at medians, along the dimension of largest spread, down to ``LEAF_SAMPLE`` rows."""
    d = sample.shape[1]
    spread = sample.std(axis=0)
    spread[~(spread > 0)] = 1.0
    dim, cut, left, lo, hi = [-1], [0.0], [-1], [np.full(d, -np.inf)], [np.full(d, np.inf)]
    todo = [(0, sample)]
    for node, rows in todo:
        if len(rows) <= LEAF_SAMPLE:
            continue
        f = int(np.argmax(rows.std(axis=0) / spread))
        x = np.sort(rows[:, f])
        v = x[(len(x) - 1) // 2]
        if v == x[-1]:  # the upper half is one value: cut below it
            v = x[max(np.searchsorted(x, v) - 1, 0)]
        if v == x[-1]:
            continue  # equal rows
        dim[node], cut[node], left[node] = f, v, len(dim)
        for side in (rows[:, f] <= v, rows[:, f] > v):
            dim.append(-1)
            cut.append(0.0)
            left.append(-1)
            lo.append(lo[node].copy())
            hi.append(hi[node].copy())
            todo.append((len(dim) - 1, rows[side]))
        hi[-2][f] = lo[-1][f] = v
    return Tree(np.array(dim, np.int32), np.array(cut), np.array(left, np.int32), np.array(lo), np.array(hi))


def group_key(col: Column | None) -> Column:
    """A group as text that is never null."""
    return F.lit("") if col is None else F.coalesce(F.concat(F.lit("v"), col.cast("string")), F.lit("n"))


def fit_trees(refs: DataFrame, features: list[str], sizes: dict[str, int], leaf_rows: int) -> dict[str, Tree]:
    """A tree for every group of more than ``leaf_rows`` references; ``sizes``: the references of these groups."""
    if not sizes:
        return {}
    per = max(leaf_rows // LEAF_SAMPLE, sum(sizes.values()) // (LEAF_SAMPLE * MAX_LEAVES) + 1)
    some = refs.where(F.pmod(F.xxhash64("_rid", F.lit("cells")), F.lit(per)) == 0).select("_gk", *features).toPandas()  # bounded by MAX_LEAVES
    return {g: build_tree(rows[features].to_numpy(np.float64)) for g, rows in some.groupby("_gk") if g in sizes}


@dataclass
class Scaler:
    """(x - mean) / std of the rows outside a fold."""

    mean: np.ndarray
    std: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return (x - self.mean) / self.std


def cells_join(q: DataFrame, r: DataFrame, features: list[str], k: int, exclude_self: bool, carry: list[str], nearest: Callable,
               scalers: dict[str, Scaler] | None = None) -> DataFrame:
    """Candidates (qid, rid, dist, *carry, and _g if q has it), the k nearest references of every query among them.

    q: _qid, _gk (group as text), features, _g if wanted. r: _rid, _gk, features, carry. All features are finite doubles.
    ``nearest``: the tile kernel of :mod:`flowlab.operators.knn`. ``scalers``: by ``_gk`` of the queries; the references of a query
    are then the rows of all other groups.
    """
    spark = q.sparkSession
    folds = scalers is not None
    leaf_rows = max(LEAF_ROWS, 8 * k)
    q, r = (df.withColumn(i, F.coalesce(i, F.lit(-2**63))) for df, i in ((q, "_qid"), (r, "_rid")))  # a null id is one id
    same = Window.partitionBy("_gk", *features).orderBy("_rid")
    kept = F.dense_rank().over(same) <= k + 1 if exclude_self else F.row_number().over(same) <= k
    r = cut_lineage(r.withColumn("_kept", kept).where("_kept").drop("_kept"))
    tree_key = F.lit("") if folds else F.col("_gk")
    sizes = r.groupBy(tree_key.alias("_t")).agg(F.count(F.lit(1)).alias("n"))
    large = {x["_t"]: x["n"] for x in sizes.where(F.col("n") > leaf_rows).collect()}  # at most rows / leaf_rows groups
    trees = fit_trees(r.withColumn("_gk", tree_key), features, large, leaf_rows)

    def in_trees(part: pd.DataFrame) -> Iterator[tuple[np.ndarray, str, Tree]]:
        """The rows of every tree in steps; rows without one have cell 0."""
        for g, at in part.groupby("_gk").indices.items():
            tree = trees.get("" if folds else g)
            if tree is not None:
                for s in range(0, len(at), STEP):
                    yield at[s:s + STEP], g, tree

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x, cell = part[features].to_numpy(np.float64), np.zeros(len(part), np.int32)
            for at, _, tree in in_trees(part):
                cell[at] = tree.home(x[at])
            yield part.assign(_cell=cell)

    placed = lambda df: df.mapInPandas(place, T.StructType([*df.schema.fields, T.StructField("_cell", T.IntegerType())]))
    r, q = placed(r), placed(q)
    poor: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # of a fold: cells with fewer than k references, and those without any
    if folds and trees:
        own = r.groupBy("_cell", "_gk").agg(F.count(F.lit(1)).alias("n"))
        left = own.withColumn("left", F.sum("n").over(Window.partitionBy("_cell")) - F.col("n")).where(F.col("left") < k)
        found = left.select("_gk", "_cell", "left").toPandas()  # nearly one group a cell: a cell of more than 2 k rows has one at most
        poor = {g: (x["_cell"].to_numpy(), x["_cell"].to_numpy()[x["left"].to_numpy() == 0]) for g, x in found.groupby("_gk")}

    def scale(g: str, x: np.ndarray) -> np.ndarray:
        return scalers[g](x) if folds else x

    def rich_home(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries whose own cell has fewer than k references for them look into the nearest cell that has k."""
        for part in parts:
            x, cell = part[features].to_numpy(np.float64), part["_cell"].to_numpy().copy()
            for at, g, tree in in_trees(part):
                few = poor.get(g, (np.array([], np.int32),))[0]
                at = at[np.isin(cell[at], few)]
                leaves = np.setdiff1d(np.flatnonzero(tree.dim < 0), few)
                if len(at) and len(leaves):
                    lo, hi = scale(g, tree.lo[leaves]), scale(g, tree.hi[leaves])
                    for s in range(0, len(at), 256):
                        z = scale(g, x[at[s:s + 256]])
                        cell[at[s:s + 256]] = leaves[np.argmin(box_distance(z[:, None, :], lo[None], hi[None]), axis=1)]
            yield part.assign(_cell=cell)

    if poor:
        q = q.mapInPandas(rich_home, q.schema)
    key = ["_cell"] if folds else ["_gk", "_cell"]
    busy = q.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > QUERY_ROWS)
    busy = broadcast_if_small(busy.select(*key, F.ceil(F.col("n") / QUERY_ROWS).cast("int").alias("_n")))  # at most queries / QUERY_ROWS rows
    leaves = sum(int((t.dim < 0).sum()) for t in trees.values())
    n_parts = max(1, 4 * spark.sparkContext.defaultParallelism, leaves // 64)
    salted = lambda df, salt: (df.join(busy, key, "left").withColumn("_salt", salt(F.coalesce("_n", F.lit(1)))).drop("_n")
                               .repartition(n_parts, *key, "_salt"))
    ask = lambda df: salted(df, lambda n: F.pmod(F.xxhash64("_qid", *features), n).cast("int")).groupBy(*key, "_salt")
    given = salted(r, lambda n: F.explode(F.sequence(F.lit(0), n - 1))).groupBy(*key, "_salt")

    def met(qs: pd.DataFrame, rs: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(queries of a tile, of these the one, reference, distance) of the k best references."""
        x, y = qs[features].to_numpy(np.float64), rs[features].to_numpy(np.float64)
        qid, rid = qs["_qid"].to_numpy(np.int64), rs["_rid"].to_numpy(np.int64)
        for g, at in qs.groupby("_gk").indices.items() if folds else [("", np.arange(len(qs)))]:
            to = np.flatnonzero((rs["_gk"] != g).to_numpy()) if folds else np.arange(len(rs))
            zq, zr = scale(g, x[at]), scale(g, y[to])
            if folds:
                good, fit = np.isfinite(zq).all(axis=1), np.isfinite(zr).all(axis=1)
                at, zq, to, zr = at[good], zq[good], to[fit], zr[fit]
            for s in range(0, len(at) if len(to) else 0, TILE):
                tile = slice(s, s + TILE)
                best = [nearest(zq[tile], qid[at[tile]], zr[b:b + 4 * TILE], rid[to[b:b + 4 * TILE]], zr.mean(axis=0)) for b in range(0, len(to), 4 * TILE)]
                i, j, dist = (np.concatenate(c) for c in zip(*[(i, j + n * 4 * TILE, dist) for n, (i, j, dist) in enumerate(best)]))
                order = np.lexsort((rid[to[j]], dist, i))
                i, j, dist = i[order], j[order], dist[order]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                yield at[tile], i[first], to[j[first]], dist[first]

    q_fields = [f for f in q.schema.fields if f.name != "_cell"]
    names = [f.name for f in q_fields]

    def bound(qs: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        far = np.full(len(qs), np.inf)
        if len(qs) and len(rs):
            for tile, i, _, dist in met(qs, rs):
                last = np.flatnonzero(np.diff(i, append=-1))  # the last of a query
                last = last[np.bincount(i, minlength=len(tile))[i[last]] == k]
                far[tile[i[last]]] = dist[last]
        return qs[names].assign(_far=far)

    def visit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x, far = part[features].to_numpy(np.float64), part["_far"].to_numpy()
            alone = ~part["_gk"].isin(list(trees)).to_numpy() if not folds else np.full(len(part), not trees)
            yield part[alone].assign(_cell=np.zeros(int(alone.sum()), np.int32))
            boxes = {}
            for at, g, tree in in_trees(part):
                if g not in boxes:
                    boxes = {g: (scale(g, tree.lo), scale(g, tree.hi))}
                for s in range(0, len(at), 2048):
                    some = at[s:s + 2048]
                    z = scale(g, x[some])
                    row, leaf = tree.within(z, far[some], *boxes[g])
                    keep = ~np.isin(leaf, poor[g][1]) if g in poor else np.full(len(leaf), True)
                    yield part.iloc[some[row[keep]]].assign(_cell=leaf[keep])

    out_fields = [T.StructField("qid", T.LongType()), T.StructField("rid", T.LongType()), T.StructField("dist", T.DoubleType()),
                  *[T.StructField(c, r.schema[c].dataType) for c in carry], *[f for f in q_fields if f.name == "_g"]]
    out_names = [f.name for f in out_fields]

    def candidates(qs: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for tile, i, j, dist in met(qs, rs) if len(qs) and len(rs) else []:
            near = dist <= qs["_far"].to_numpy()[tile[i]]
            asked, found = qs.iloc[tile[i[near]]], rs.iloc[j[near]]
            part = {"qid": asked["_qid"].to_numpy(), "rid": found["_rid"].to_numpy(), "dist": dist[near]}
            part |= {c: found[c].to_numpy() for c in carry}
            if "_g" in names:
                part["_g"] = asked["_g"].to_numpy()
            parts.append(pd.DataFrame(part))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: pd.Series(dtype="object") for c in out_names})

    far = ask(q).cogroup(given).applyInPandas(bound, T.StructType([*q_fields, T.StructField("_far", T.DoubleType())]))
    far = far.mapInPandas(visit, T.StructType([*far.schema.fields, T.StructField("_cell", T.IntegerType())]))
    return ask(far).cogroup(given).applyInPandas(candidates, T.StructType(out_fields))
