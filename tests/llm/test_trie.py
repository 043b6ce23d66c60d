"""Conversation prefix trie against a plain trie of lists."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from flowlab.llm import conversation_trie as ct


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [x for _, x in sorted(v, key=lambda y: y[0])] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - int(np.fmod(c, 20)), [])[:h] + v[h:])
    members = {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        kids = children.get(p, [])
        leaves[p] = sum(leaves[k] for k in kids) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = sum(saved[k] for k in kids) + (len(members[p]) - 1) * words
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(whole[c]) == len(p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children.get(p, [])), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, c string, depth int")
    return df.repartition(5)


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations(rng, n):
    """Few distinct turns, copies of whole conversations, some long ones, shuffled turn numbers."""
    rows, whole = [], []
    for c in rng.sample(range(-50, 4 * n), n):
        if whole and rng.random() < 0.3:
            turns = rng.choice(whole)
        else:
            size = rng.choice([1, 2, 3, 5, 8, 40])
            turns = [(rng.choice(["user", "assistant"]), " ".join(["word"] * rng.choice([1, 2, 3]))) for _ in range(size)]
            whole.append(turns)
        rows += [(c, 7 * i, role, text) for i, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("convs", "depth", "bits", "task", "chunk"), [(1024, 256, 10, 200_000, 4096), (4, 256, 2, 30, 3), (3, 5, 1, 50, 2), (50, 2, 3, 10, 1), (1, 3, 2, 9, 5)])
def test_equals_plain_trie(spark, monkeypatch, convs, depth, bits, task, chunk):
    for name, value in (("SHARD_CONVERSATIONS", convs), ("SHARD_DEPTH", depth), ("SEGMENT_BITS", bits), ("TASK_ROWS", task), ("CHUNK_IDS", chunk)):
        monkeypatch.setattr(ct, name, value)
    rows = conversations(random.Random(convs * 31 + depth), 150)
    assert got(ct.prefix_trie(table(spark, rows))) == plain(rows)


def test_odd_rows(spark):
    rows = [(20, 0, "user", "a b"), (20, None, "user", "first of all"), (20, 1, None, None), (20, 1, "", ""), (20, 1, "user", "tie"), (20, 1, "user", "tie"),
            (21, 0, "user", "x"), (None, 0, "user", "nobody"), (25, None, None, None), (41, 0, "us", "erx"), (41, 1, "user", "x"), (43, 5, "a", " \n\t "),
            (44, 1, "a", "w " * 20_000), (44, 2, "a", "é 漢字"), (-21, 0, "user", "a"), (-20, 0, "user", "b c")]
    rows += [(c, 0, "user", "only") for c in range(60, 80)]
    assert got(ct.prefix_trie(table(spark, rows))) == plain(rows)
    assert got(ct.prefix_trie(table(spark, rows).limit(0))) == []
    assert got(ct.prefix_trie(table(spark, [(None, 1, "a", "b")]))) == []


def test_one_conversation_of_a_third_and_a_hot_first_turn(spark):
    rows = [(5, i, "user", f"turn {i % 9}") for i in range(3000)]
    rows += [(c, i, "user", "hello" if i == 0 else f"{c} {i}") for c in range(100, 1100) for i in range(3)]
    rows += [(c, i, "user", f"copy {i}") for c in range(2000, 2600) for i in range(5)]
    assert got(ct.prefix_trie(table(spark, rows))) == plain(rows)


def test_double_array_holds_exactly_its_children():
    rng = np.random.default_rng(0)
    trie, want = ct.DoubleArray(), {}
    states = np.zeros(1, np.int64)
    for _ in range(5):
        pairs = sorted({(int(s), int(c)) for s in states for c in rng.integers(1, 400, rng.choice([1, 1, 2, 9]))})
        state, code = np.array(pairs).T
        trie.extend(state, code)
        states = trie.step(state, code)
        assert (states > 0).all() and len(set(states.tolist())) == len(states)
        want.update(zip(pairs, states.tolist()))
    every = np.array([s for s, _ in want] * 3)
    codes = rng.integers(1, 400, len(every))
    for s, c, t in zip(every.tolist(), codes.tolist(), trie.step(every, codes).tolist()):
        assert t == want.get((s, c), -1)
    assert trie.top < 4 * len(want) + 400
