"""Conversation prefix trie: double arrays over dense turn ids per prefix shard, upper nodes merged globally.

A turn is named by the md5 of its role and text, so texts are read once and
never shuffled. The prefix of d turns is named by the exclusive or of 128-bit
hashes of (turn, depth). One grouped pass counts the conversations of every
prefix, and that decides who aggregates a node:

* tail: one conversation. Its values follow from the node alone.
* shard: 2 to ``SHARD_CONVERSATIONS`` conversations, at most ``SHARD_DEPTH``
  turns deep. The subtree under the first such prefix of a conversation is its
  prefix shard. Shards are packed by a hash of their prefix into tasks of about
  ``TASK_ROWS`` rows. A task packs BASE and CHECK arrays over its dense turn
  ids, walks all conversations through them and sums the subtrees along CHECK.
* wide: all others, above all the shared upper nodes. Every distinct node adds
  its share to one row, that of its smallest conversation and its depth; sums
  over deeper rows of a conversation, added up over the members of a node,
  give the node's subtree. These are grouped sums over all shards.

No conversation, prefix or node is ever one group: positions and running sums
go by segments of a conversation, and a hot prefix is wide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlab.llm.common import cut_lineage, n_words, table
from flowlab.operators.position import positions_within

GROUP = 20  # conversations that share the head of the first of them
HEAD = 4  # shared turns are fewer than this
SHARD_CONVERSATIONS = 1024
SHARD_DEPTH = 256
TASK_ROWS = 200_000
SEGMENT_BITS = 10  # turns of a conversation that one window holds, as a power of two
CHUNK_IDS = 4096  # conversation ids of a node joined to one string before they meet
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ["p1", "p2", "depth"]


def turn_key(role: Column, text: Column) -> Column:
    """md5 of role and text as 16 bytes; the length of the role keeps the pair apart."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """(c, pos, t, w): every turn at its position from 0, with its key and its number of words."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), turn_key(role, text).alias("t"), n_words(text).alias("w"))
    return positions_within(rows, ["c"], ["turn", "t"]).select("c", F.col("pos").cast("long").alias("pos"), "t", "w")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations (c, length), rows (c, depth, t, w, last)) after the heads of groups are put in front.

    Conversation c starts with the first h turns of conversation c - c % 20 (of
    the sign of c), h = crc32(decimal c) % 4, and goes on with its own turns
    after its first h.
    """
    own = turns.groupBy("c").agg(F.count("*").alias("size"))
    lead = own.select(F.col("c").alias("b"), F.col("size").alias("lead"))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % HEAD
    convs = own.withColumn("h", h).withColumn("b", F.col("c") - F.col("c") % GROUP).join(lead, "b", "left")
    convs = convs.withColumn("k", F.least("h", F.coalesce("lead", F.lit(0))))
    convs = cut_lineage(convs.select("c", "b", "h", "k", (F.col("k") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length")))
    heads = turns.where((F.col("pos") < HEAD - 1) & (F.col("c") % GROUP == 0)).withColumnRenamed("c", "b")
    front = convs.where("k > 0").join(heads, "b").where("pos < k").select("c", (F.col("pos") + 1).alias("depth"), "t", "w", "length")
    rest = turns.join(convs, "c").where("pos >= h").select("c", (F.col("k") + F.col("pos") - F.col("h") + 1).alias("depth"), "t", "w", "length")
    rows = front.unionByName(rest).select("c", "depth", "t", "w", (F.col("depth") == F.col("length")).cast("int").alias("last"))
    return convs.select("c", "length"), rows


def running(rows: DataFrame, key: str, at: Column, values: dict[str, Column], total: Callable, join: Callable) -> DataFrame:
    """Rows with the inclusive running aggregate of ``values`` per key in the order of ``at``, a segment a window."""
    rows = rows.select("*", at.alias("__at"), F.shiftright(at, SEGMENT_BITS).alias("__seg"), *[v.alias(f"__{n}") for n, v in values.items()])
    parts = rows.groupBy(key, "__seg").agg(*[total(f"__{n}").alias(f"__{n}") for n in values])
    before = Window.partitionBy(key).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(key, "__seg", *[F.coalesce(total(f"__{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in values])
    within = Window.partitionBy(key, "__seg").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(parts, [key, "__seg"])
    out = out.withColumns({n: join(F.col(f"__b_{n}"), total(f"__{n}").over(within)) for n in values})
    return out.drop(*[c for c in out.columns if c.startswith("__")])


class DoubleArray:
    """Trie in two arrays: the child of state s by code c is slot BASE[s] + c, valid if CHECK there is s. State 0 is the root."""

    TRIES, NEAR = 64, 1024

    def __init__(self):
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.check[0] = 0
        self.top, self.low = 0, 1  # last used slot, first slot that may be free

    def room(self, last: int) -> None:
        if last >= len(self.check):
            more = last + 1024
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def extend(self, state: np.ndarray, code: np.ndarray) -> None:
        """Adds children: distinct (state, code) pairs, sorted; all children of a state come at once."""
        first = np.flatnonzero(np.concatenate(([True], state[1:] != state[:-1])))
        many = np.diff(np.append(first, len(state)))
        for at, n in zip(first[many > 1], many[many > 1]):
            offset = code[at:at + n] - code[at]
            self.room(self.top + int(offset[-1]) + self.TRIES + 2)
            slot = self.place(offset)
            self.base[state[at]] = slot - code[at]
            self.check[slot + offset] = state[at]
            self.top = max(self.top, slot + int(offset[-1]))
        one = first[many == 1]
        if len(one):  # only children take the slots left free, then new ones
            self.room(self.top + len(one))
            free = self.low + np.flatnonzero(self.check[self.low:self.top + len(one) + 1] == -1)[:len(one)]
            self.base[state[one]] = free - code[one]
            self.check[free] = state[one]
            self.top = max(self.top, int(free[-1]))
            self.low = int(free[-1]) + 1

    def place(self, offset: np.ndarray) -> int:
        """A slot for the first child such that all children find free ones: near the first free slots, near the end, or behind it."""
        for lo, hi in ((self.low, self.low + 2 * self.TRIES), (max(self.low, self.top - self.NEAR), self.top)):
            free = lo + np.flatnonzero(self.check[lo:min(hi, self.top) + 1] == -1)
            if lo == self.low and len(free):
                self.low = int(free[0])
            fits = (self.check[free[:, None] + offset] == -1).all(1)
            if fits.any():
                return int(free[fits.argmax()])
        return self.top + 1

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Slots reached from the states by the codes; -1 where there is none."""
        slot = self.base[state] + code
        inside = (slot > 0) & (slot <= self.top) & (state >= 0)
        return np.where(inside & (self.check[np.where(inside, slot, 0)] == state), slot, -1)


SHARD_OUT = ("p1 long, p2 long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
             "saved_tokens long, top boolean, own_leaves long, own_saved long")


def shard_nodes(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes of some prefix shards, from the shared turns of their conversations.

    Rows: (c, depth, t, w, p1, p2, q1, q2, last, start, above, g1, g2, deep_leaves,
    deep_saved). ``start`` is the depth of the shard's top node and ``above`` the
    conversation of its parent; g1, g2 name the wide node that follows a deep
    conversation, and deep_* are the shares of such nodes that fall to it.
    """
    rows = rows.assign(level=rows["depth"] - rows["start"]).sort_values(["level", "q1", "q2", "p1", "p2", "c"], kind="stable").reset_index(drop=True)
    level, depth, w, c = (rows[k].to_numpy(np.int64) for k in ("level", "depth", "w", "c"))
    # dense ids by first appearance, level by level, so that most siblings are neighbours; a top node is named by its prefix
    top = level == 0
    names = rows["t"].where(~top, rows["p1"].astype(str) + "," + rows["p2"].astype(str) + ",top")
    code = pd.factorize(names)[0] + 1
    who = pd.factorize(c)[0]
    trie, state = DoubleArray(), np.zeros(who.max() + 1, np.int64)
    node = np.zeros(len(rows), np.int64)
    cuts = np.searchsorted(level, np.arange(level.max() + 2))
    wide = int(code.max()) + 1
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        at = who[lo:hi]
        pairs = np.unique(state[at] * wide + code[lo:hi])
        trie.extend(pairs // wide, pairs % wide)
        state[at] = node[lo:hi] = trie.step(state[at], code[lo:hi])
    assert (node > 0).all()

    size = trie.top + 1
    n, first, words, of = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64), np.zeros(size, np.int64)
    np.add.at(n, node, 1)
    np.minimum.at(first, node, c)
    words[node], of[node] = w, np.arange(len(rows))
    nodes = np.unique(node)
    parent = trie.check[:size]
    children = np.bincount(parent[nodes], minlength=size)

    # what follows the shared turns of a conversation: its end, a tail, or a wide node
    final = np.zeros(len(rows), bool)
    final[np.unique(who[::-1], return_index=True)[1]] = True
    final = final[::-1]
    on = final & (rows["last"].to_numpy() == 0)
    deep = on & rows["g1"].notna().to_numpy()
    tails = np.bincount(node[on & ~deep], minlength=size)
    follow = rows.loc[deep, ["g1", "g2"]].assign(node=node[deep]).drop_duplicates()
    children += tails + np.bincount(follow["node"].to_numpy(np.int64), minlength=size)

    leaves, saved = tails + ((children == 0) & (n > 0)), (n - 1) * words * (n > 0)
    more_leaves, more_saved = np.zeros(size, np.int64), np.zeros(size, np.int64)
    np.add.at(more_leaves, node[deep], rows["deep_leaves"].to_numpy(np.int64)[deep])
    np.add.at(more_saved, node[deep], rows["deep_saved"].to_numpy(np.int64)[deep])
    by_level = level[of]
    for k in range(int(level.max()), 0, -1):
        here = nodes[by_level[nodes] == k]
        for sums in (leaves, saved, more_leaves, more_saved):
            np.add.at(sums, parent[here], sums[here])
    pick = rows.iloc[of[nodes]]
    is_top = top[of[nodes]]
    return pd.DataFrame({
        "p1": pick["p1"].to_numpy(), "p2": pick["p2"].to_numpy(), "depth": depth[of[nodes]], "conv_id": first[nodes],
        "parent_conv_id": np.where(is_top, pick["above"].to_numpy(np.int64), first[parent[nodes]]), "n_convs": n[nodes],
        "n_children": children[nodes], "n_leaves": (leaves + more_leaves)[nodes], "saved_tokens": (saved + more_saved)[nodes],
        "top": is_top, "own_leaves": leaves[nodes], "own_saved": saved[nodes]})


def ends_digest(ends: DataFrame) -> DataFrame:
    """(p1, p2, depth, ends_sha256) from (p1, p2, depth, c): SHA-256 of the ascending, comma-joined ids of every node.

    Ids are joined to strings of up to ``CHUNK_IDS`` in sorted ranges first, so
    that only these strings of a hot node meet, one after the other.
    """
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                new = np.concatenate(([True], (rows[NODE].to_numpy()[1:] != rows[NODE].to_numpy()[:-1]).any(1)))
                run = np.cumsum(new) - 1
                within = np.arange(len(rows)) - np.flatnonzero(new)[run]
                rows = rows.assign(g=run, h=within // CHUNK_IDS, s=rows["c"].astype(str))
                yield rows.groupby(["g", "h"], sort=False).agg(
                    p1=("p1", "first"), p2=("p2", "first"), depth=("depth", "first"), c=("c", "first"), ids=("s", ",".join)).reset_index(drop=True)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for rows in batches:
            out = []
            for *now, ids in zip(rows["p1"], rows["p2"], rows["depth"], rows["ids"]):
                if now != key:
                    if state:
                        out.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
        if state:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=[*NODE, "ends_sha256"])

    kind = "p1 long, p2 long, depth long"
    packed = ends.select(*NODE, "c").repartitionByRange(*NODE, "c").sortWithinPartitions(*NODE, "c").mapInPandas(pack, f"{kind}, c long, ids string")
    return packed.repartition(*NODE).sortWithinPartitions(*NODE, "c").mapInPandas(digest, f"{kind}, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """All nodes of the prefix trie of conversations (c, length) with turns (c, depth from 1, t, w, last).

    Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256). The root exists if there is a conversation.
    """
    h1, h2 = F.xxhash64("t", "depth"), F.xxhash64(F.lit("second"), "t", "depth")
    rows = running(turns.withColumns({"h1": h1, "h2": h2}), "c", F.col("depth"), {"p1": F.col("h1"), "p2": F.col("h2")},
                   F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    rows = cut_lineage(rows.select("c", "depth", "t", "w", "last", "p1", "p2", F.col("p1").bitwiseXOR(F.col("h1")).alias("q1"),
                                   F.col("p2").bitwiseXOR(F.col("h2")).alias("q2")))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    kind = (F.when((F.col("depth") > 0) & (F.col("n") == 1), "tail")
            .when((F.col("depth") > 0) & (F.col("n") <= SHARD_CONVERSATIONS) & (F.col("depth") <= SHARD_DEPTH), "shard").otherwise("wide"))
    nodes = rows.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("c").alias("conv_id"), F.first("w").alias("w"), F.first("q1").alias("q1"),
                                    F.first("q2").alias("q2"), F.max("last").alias("ended"))
    root = convs.agg(F.count("*").alias("n"), F.min("c").alias("conv_id")).where("n > 0").select(
        zero.alias("p1"), zero.alias("p2"), zero.alias("depth"), "n", "conv_id", zero.alias("w"), zero.alias("q1"), zero.alias("q2"), F.lit(0).alias("ended"))
    nodes = nodes.unionByName(root).withColumn("kind", kind)
    above = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), (F.col("depth") + 1).alias("depth"),
                         F.col("conv_id").alias("parent_conv_id"), F.col("kind").alias("parent_kind"))
    nodes = cut_lineage(nodes.join(above, ["q1", "q2", "depth"], "left"))
    below = nodes.where("depth > 0 and parent_kind = 'wide'").groupBy(
        F.col("q1").alias("p1"), F.col("q2").alias("p2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    wide = cut_lineage(nodes.where("kind = 'wide'").join(below, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    # shares of wide nodes and of the tails under them, at the row of their smallest conversation
    shares = wide.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("w")).alias("saved")).union(
        nodes.where("kind = 'tail' and parent_kind = 'wide'").select("conv_id", "depth", F.lit(1).cast("long"), zero))
    deep = shares.where(F.col("depth") > SHARD_DEPTH).groupBy(F.col("conv_id").alias("c")).agg(
        F.sum("leaves").alias("deep_leaves"), F.sum("saved").alias("deep_saved"))

    # prefix shards
    named = rows.join(nodes.where("kind <> 'tail'").select(*NODE, "kind", "parent_conv_id", "parent_kind"), NODE)
    shared = cut_lineage(named.select("c", *NODE, "t", "w", "q1", "q2", "last", "kind", "parent_conv_id", "parent_kind"))
    inside = shared.where("kind = 'shard'")
    tops = inside.where("parent_kind = 'wide'").select("c", F.col("depth").alias("start"), F.col("parent_conv_id").alias("above"),
                                                       F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    follow = shared.where((F.col("kind") == "wide") & (F.col("depth") == SHARD_DEPTH + 1)).select("c", F.col("p1").alias("g1"), F.col("p2").alias("g2"))
    tasks = -(-inside.count() // TASK_ROWS)
    dealt = (inside.join(tops, "c").join(follow, "c", "left").join(deep, "c", "left")
             .select("c", *NODE, "t", "w", "q1", "q2", "last", "start", "above", "g1", "g2", F.coalesce("deep_leaves", F.lit(0)).alias("deep_leaves"),
                     F.coalesce("deep_saved", F.lit(0)).alias("deep_saved"), F.pmod(F.xxhash64("k1", "k2"), F.lit(max(tasks, 1))).alias("task")))
    packed = cut_lineage(dealt.groupBy("task").applyInPandas(lambda rows: shard_nodes(rows), SHARD_OUT))

    # upper nodes: sums over the shares of all members, at their depth or deeper
    shares = shares.union(packed.where("top").select("conv_id", "depth", "own_leaves", "own_saved"))
    owners = shares.select(F.col("conv_id").alias("c")).distinct()
    paths = shared.where("kind = 'wide'").select("c", "depth", "p1", "p2").union(convs.select("c", zero, zero, zero)).join(owners, "c", "left_semi")
    steps = (paths.select("c", "depth", "p1", "p2", zero.alias("leaves"), zero.alias("saved"))
             .union(shares.select("conv_id", "depth", none, none, "leaves", "saved"))
             .groupBy("c", "depth").agg(F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    sums = running(steps, "c", -F.col("depth"), {"n_leaves": F.col("leaves"), "saved_tokens": F.col("saved")}, F.sum, lambda a, b: a + b)
    sums = sums.where("p1 is not null").groupBy(*NODE).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    upper = wide.withColumnRenamed("n", "n_convs").join(sums, NODE, "left")
    many = upper.select("p1", "p2", *out).union(packed.select("p1", "p2", *out))
    ends = shared.where("last = 1").select(*NODE, "c").union(convs.where("length = 0").select(zero, zero, zero, "c"))
    many = many.join(ends_digest(ends), NODE, "left").select(*out, F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    tails = nodes.where("kind = 'tail'").select(
        "conv_id", "depth", "parent_conv_id", F.lit(1).cast("long").alias("n_convs"), (1 - F.col("ended")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(F.col("ended") == 1, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(EMPTY).alias("ends_sha256"))
    return many.unionByName(tails)


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """Nodes of the trie of the rebuilt conversations.

    Turns are ordered by their number, null first; turns of one number, by
    the md5 of role and text. A null role or text is empty; repeated rows are
    turns of their own. Rows with a null conversation id belong to no
    conversation and are left out. Conversations that lose all their turns stay
    as members of the root. Other columns, whatever their names, are ignored;
    an empty table gives an empty table.
    """
    convs, rows = rebuilt(turns_of(conversations, conv_col, turn_col, role_col, text_col))
    return trie(convs, rows)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the prefix trie of ``conversations``."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
