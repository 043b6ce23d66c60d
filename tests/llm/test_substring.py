"""Substring dedup against brute force over word windows."""

import random

import numpy as np
import pytest

from flowlab.llm import substring_dedup as sub


def plain(rows, window):
    docs = [(2**63 - 1 if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in docs:
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for (i, t), (o, w) in zip(rows, docs):
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < o:
                gone[s:s + window] = True
        out.append((i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def texts(rng, n, vocabulary):
    """Texts that share passages, lines and whole copies; few words make many equal short runs."""
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(rng.choice([8, 20, 60]))] for _ in range(6)]
    out = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(6)):
            w += rng.choice(passages) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(30))]
        out.append(rng.choice([" ", "\n", " \t"]).join(w))
    return out + out[:n // 5]


@pytest.mark.parametrize(("window", "vocabulary"), [(10, 500), (25, 3), (50, 500), (16, 2), (5, 400)])
def test_equals_brute_force(spark, window, vocabulary):
    rng = random.Random(window)
    rows = [(i, t) for i, t in enumerate(texts(rng, 60, vocabulary))]
    rng.shuffle(rows)
    got = sub.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window=window)
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert got == plain(rows, window)
    assert any(0 < r[2] < r[1] for r in got) and any(r[2] == r[1] > 0 for r in got)


def test_odd_rows(spark):
    w = [f"x{i}" for i in range(130)]
    rows = [(None, " ".join(w)), (None, " ".join(w)), (5, " ".join(w[:80])), (5, " ".join(w[:80])), (5, " ".join(w[70:])), (3, None), (4, ""),
            (6, " \n "), (7, "a " * 500), (8, "a " * 60), (9, " ".join(w)), (-2, "é " + " ".join(w[100:])), (10, " ".join(w[20:69]))]
    df = spark.createDataFrame([(i, t, "z", 1, [2]) for i, t in rows], "doc_id long, text string, r string, o int, intervals array<int>")
    got = sorted((tuple(r) for r in sub.remove_repeats(df).collect()), key=str)
    assert got == plain(rows, sub.WINDOW) and len(got) == len(rows)
    assert sub.remove_repeats(df.limit(0)).count() == 0


def test_very_long_text_and_chunks(spark, monkeypatch):
    rng = random.Random(1)
    long = [f"v{rng.randrange(10**6)}" for _ in range(300_000)]
    rows = [(1, " ".join(long)), (2, "start " + " ".join(long[1000:250_000]) + " end"), (3, " ".join(long[-60:]))]
    got = sorted(tuple(r) for r in sub.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [r[:3] for r in got] == [(1, 300_000, 0), (2, 249_002, 249_000), (3, 60, 60)] and got[1][3] == "start end"


def test_a_window_hash_is_the_hash_of_its_words_alone():
    roll = sub.Rolling()
    w = " ".join(f"q{i % 7}" for i in range(100)).encode()
    roll.load([b"  " + w, b"", b" \n", b"other " * 3 + w.replace(b" ", b"\t\n ") + b" "])
    assert roll.size.tolist() == [100, 0, 0, 103]
    at = np.array([10, 100 + 3 + 10])
    for k in (0, 1):
        a, b = roll.hash(k, at, at + 50)
        assert a == b
    text, first, many, *_ = sub.runs(roll, 50, 8)
    assert [int(many[text == t].sum()) for t in range(4)] == [51, 0, 0, 54]


def test_words_are_hashed_alike_in_pieces(monkeypatch):
    text = [("x" * 900 + " ab  c\n").encode() * 20, b"a" * 5000 + b" b", "é\u00a0ß \u2003x".encode()]
    whole, parts = sub.Rolling(), sub.Rolling()
    whole.load(text)
    monkeypatch.setattr(sub, "PIECE", 64)
    parts.load(text)
    assert whole.size.tolist() == parts.size.tolist() == [60, 2, 2]
    for k in (0, 1):
        assert (whole.sums[k] == parts.sums[k]).all()
        words = np.diff(whole.sums[k]) * whole.powers[2 * k + 1][:64]
        assert len(set(words.tolist())) == 3 + 2 + 2


def test_common_passage_makes_no_large_group(spark):
    """A passage in every document between words of its own: every key of a run is small, the counts are right."""
    shared = [f"s{i}" for i in range(70)]
    rows = [(i, " ".join([f"a{i}_{j}" for j in range(40)] + shared + [f"b{i}_{j}" for j in range(40)])) for i in range(200)]
    got = {r["id"]: r["n_removed"] for r in sub.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 70 if i else 0 for i in range(200)}
