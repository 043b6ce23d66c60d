"""Isolation forest (X8): fit on (e.g. benign) rows per group, score every row.

Sampling: each row gets R replicas (R = 1 unless the data is smaller than the
total sample), every replica is assigned to one tree by a seeded hash and
kept with probability p, so each tree receives about 1.5 * psi candidates;
the tree keeps the psi candidates with the smallest draw. Only the sample
(groups * trees * psi rows, independent of the data size) is shuffled.
Trees are built by a grouped ``applyInPandas`` (random feature, uniform split
between the node's min and max, depth limit ceil(log2 psi)); the forest table
has at most groups * trees * (2 psi - 1) rows, so it is checked and passed to
a vectorised ``mapInPandas`` scorer: anomaly score 2^(-E[h(x)] / c(psi)).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.functions.rand import hash32, uniform
from flowlab.session import broadcast_if_small, cut_lineage

EULER = 0.5772156649015329
ROWS_PER_UNIT = 100_000  # rows scored together


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful BST search over n points (0 for n <= 1)."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _builder(features: list[str], psi: int, seed: int, group_col: str | None):
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_u", "_key"]).head(psi)
        tree = int(pdf["_tree"].iloc[0])
        gval = pdf[group_col].iloc[0] if group_col else None
        X = pdf[features].to_numpy(dtype=np.float64)
        gkey = zlib.crc32(str(gval).encode())
        rng = np.random.default_rng([seed, tree, gkey])
        nodes = []  # (node, feature, threshold, left, right, size, depth)

        def grow(idx: np.ndarray, depth: int) -> int:
            nid = len(nodes)
            nodes.append(None)
            if depth >= max_depth or idx.size <= 1:
                nodes[nid] = (nid, -1, 0.0, -1, -1, int(idx.size), depth)
                return nid
            sub = X[idx]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            cand = np.flatnonzero(hi > lo)
            if cand.size == 0:
                nodes[nid] = (nid, -1, 0.0, -1, -1, int(idx.size), depth)
                return nid
            f = int(rng.choice(cand))
            thr = float(rng.uniform(lo[f], hi[f]))
            go_left = sub[:, f] < thr
            left = grow(idx[go_left], depth + 1)
            right = grow(idx[~go_left], depth + 1)
            nodes[nid] = (nid, f, thr, left, right, int(idx.size), depth)
            return nid

        grow(np.arange(X.shape[0]), 0)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
        out.insert(0, "tree", tree)
        if group_col:
            out.insert(0, group_col, gval)
        out["sample_size"] = X.shape[0]
        return out

    return build


def fit_isolation_forest(fit_rows: DataFrame, features: list[str], key_col: str = "row_key",
                         group_col: str | None = None, n_trees: int = 100, psi: int = 256,
                         seed: int = 42) -> DataFrame:
    """Forest table: (group?, tree, node, feature, threshold, left, right, size, depth, sample_size)."""
    gcols = [group_col] if group_col else []
    # a group's rows are copied only if it has fewer than the trees need, and thinned only if it has more
    wanted = 1.5 * psi * n_trees
    sizes = fit_rows.groupBy(*gcols).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*gcols, F.greatest(F.ceil(wanted / F.col("_n")), F.lit(1)).cast("int").alias("_reps"), "_n")
    sizes = sizes.withColumn("_p", F.least(F.lit(1.0), wanted / (F.col("_n") * F.col("_reps")))).drop("_n")
    sizes = broadcast_if_small(sizes)
    fit_rows = (fit_rows.join(sizes.withColumnRenamed(group_col, "_g"), F.col(group_col).eqNullSafe(F.col("_g"))).drop("_g")
                if group_col else fit_rows.crossJoin(sizes))  # without a group: one row of sizes
    rows = fit_rows.select(*gcols, F.col(key_col).alias("_key"), *[F.col(f).cast("double").alias(f) for f in features], "_reps", "_p")
    rep = rows.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.col("_reps") - 1)))
    rep = rep.withColumn("_tree", F.pmod(hash32(seed, "if-tree", "_key", "_rep"), F.lit(n_trees)).cast("int"))
    rep = rep.withColumn("_u", uniform(seed, "if-keep", "_key", "_rep")).filter(F.col("_u") < F.col("_p")).drop("_reps", "_p")
    schema_fields = ([T.StructField(group_col, fit_rows.schema[group_col].dataType)] if group_col else []) + [
        T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
        T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
        T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
        T.StructField("size", T.IntegerType()), T.StructField("depth", T.IntegerType()),
        T.StructField("sample_size", T.IntegerType())]
    return rep.groupBy(*gcols, "_tree").applyInPandas(_builder(features, psi, seed, group_col), T.StructType(schema_fields))


def score_isolation_forest(df: DataFrame, forest: DataFrame, features: list[str], key_col: str = "row_key",
                           group_col: str | None = None, psi: int = 256, carry: list[str] | None = None) -> DataFrame:
    """Anomaly score of every row of ``df`` against the forest of its group; ``carry`` columns pass through.

    Rows are dealt to units of a group (about ``ROWS_PER_UNIT`` rows, by a hash
    of the key) and each unit meets the forest of its group, so neither a hot
    group nor the whole forest has to fit anywhere. Rows of a group without a
    forest get a null path and score.
    """
    carry = carry or []
    gcols = [group_col] if group_col else []
    forest = cut_lineage(forest)  # the trees are built once
    g = F.col(group_col).cast("string") if group_col else F.lit("")
    units = df.groupBy(g.alias("_group")).agg(F.greatest(F.ceil(F.count(F.lit(1)) / ROWS_PER_UNIT), F.lit(1)).cast("int").alias("_units"))
    units = broadcast_if_small(units)
    rows = df.select(key_col, *gcols, *[c for c in carry if c not in (key_col, *gcols)], *[c for c in features if c not in carry], g.alias("_g0"))
    rows = (rows.alias("r").join(units.alias("u"), F.expr("r._g0 <=> u._group")).drop("_g0")
            .withColumn("_unit", F.pmod(F.xxhash64(key_col), F.col("_units")).cast("int")).drop("_units"))
    trees = forest.withColumn("_g0", g).alias("r").join(units.alias("u"), F.expr("r._g0 <=> u._group")).drop("_g0")
    trees = trees.withColumn("_unit", F.explode(F.sequence(F.lit(0), F.col("_units") - 1))).drop("_units")
    trees = trees.toDF(*trees.columns)  # columns of its own: both sides of the cogroup come from ``units``
    kept = [key_col, *gcols, *[c for c in carry if c not in (key_col, *gcols)]]
    out_schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in kept]
                              + [T.StructField("mean_path", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def score(part: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        out = part[kept].copy()
        if part.empty or nodes.empty:
            return out.assign(mean_path=pd.Series(dtype="float64"), score=pd.Series(dtype="float64"))
        X = part[features].to_numpy(dtype=np.float64)
        total, n_trees = np.zeros(X.shape[0]), 0
        at = np.arange(X.shape[0])
        for _, t in nodes.groupby("tree"):
            t = t.sort_values("node")
            feat, thr, left, right, size, depth = (t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "size", "depth"))
            node = np.zeros(X.shape[0], dtype=np.int64)
            for _ in range(int(depth.max()) + 1):
                f = feat[node]
                inner = f >= 0
                if not inner.any():
                    break
                nxt = np.where(X[at, np.where(inner, f, 0)] < thr[node], left[node], right[node])
                node = np.where(inner, nxt, node)
            total += depth[node] + c_factor(size[node])
            n_trees += 1
        path = total / n_trees
        c = float(c_factor([nodes["sample_size"].max() or psi])[0])
        return out.assign(mean_path=path, score=np.power(2.0, -path / c) if c else 0.5)

    keys = ["_group", "_unit"]
    return rows.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInPandas(score, out_schema)
