"""SimHash groups, decontamination and top-k against brute force."""

import collections
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowlab.llm import components, decontaminate, pivot_topk, simhash_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def plain_fingerprint(text, k=3):
    w = words(text)
    if not w:
        return 0
    k = min(k, len(w))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum((sum(h >> b & 1 for h in hs) * 2 > len(hs)) << b for b in range(64))


def plain_groups(prints, radius=3):
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_groups_equal_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").where("doc_id < 400").collect()
    got = simhash_dedup.near_duplicates(docs.where("doc_id < 400")).collect()
    want = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    assert {r["id"]: r["fp"] % 2 ** 64 for r in got} == want
    assert {r["id"]: r["component"] for r in got} == plain_groups(want)


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_bit_sliced_forest_equals_pairwise(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    fp = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(6)])
    rng.shuffle(fp)
    size = np.array([1, 70, 3, 150, len(fp) - 224])
    left = np.concatenate([np.arange(n)[::-1] for n in size])
    root = simhash_dedup.sliced_forest(fp, left, radius)
    at = 0
    for n in size:
        part = {i: int(fp[i]) for i in range(at, at + n)}
        want = plain_groups(part, radius)
        got = root[at:at + n]
        assert [want[i] for i in range(at, at + n)] == [min(at + np.flatnonzero(got == g)) for g in got]
        at += n


def test_hot_bucket_is_split_and_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CHUNK", 16)
    rng = np.random.default_rng(3)
    near = {int(np.uint64(0x1234567890ABCDEF) ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)))
            for a, b in rng.integers(0, 64, (150, 2))}
    prints = {v - 2 ** 64 if v >= 2 ** 63 else v: v for v in near}
    df = spark.createDataFrame([(k,) for k in prints], "fp long")
    tree = components.connected_components(simhash_dedup.links(df))
    got = {r["node"]: r["component"] for r in tree.collect()}
    want = plain_groups({k: v for k, v in prints.items()})
    sizes = lambda m: sorted(collections.Counter(m.values()).values())
    assert sizes({k: got.get(k, k) for k in prints}) == sizes(want)


def test_more_blocks_lose_no_link():
    for n in (10, 2 ** 30, 2 ** 40):
        keys = simhash_dedup.block_keys(n, 3)
        rng = np.random.default_rng(1)
        for _ in range(200):
            x = int(rng.integers(0, 2 ** 63))
            y = x
            for b in rng.choice(64, 3, replace=False):
                y ^= 1 << int(b)
            assert any(all((x >> f) % 2 ** w == (y >> f) % 2 ** w for f, w in k) for k in keys)


def test_components_of_paths_and_empty(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 7), (5, 5), (None, 4)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 3: 3, 7: 3}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dedup_odd_rows(spark, odd):
    got = simhash_dedup.near_duplicates(odd).collect()
    assert len(got) == 9
    by = collections.defaultdict(set)
    for r in got:
        by[r["id"]].add(r["component"])
    assert by[1] == by[2] == by[7] == {1} and by[4] == by[5] == {4} and by[6] == {6}
    kept = simhash_dedup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "6", "8", "None"]
    assert simhash_dedup.near_duplicates(odd.limit(0)).count() == 0 and simhash_dedup.keep_one(odd.limit(0)).count() == 0


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    """Unlinked texts under one id all stay, linked ones leave one, and no group is lost for lack of an id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(300)) for x in "abc")
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "y"), (2, a, "x"), (None, c, "x"), (None, c, "x"), (None, "", "x"), (5, a.replace("a7 ", "changed "), "x"), (6, b, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("group", F.lit("clash")).withColumn("n", F.lit(0))
    kept = simhash_dedup.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    linked = {r["id"]: r["component"] for r in simhash_dedup.near_duplicates(df).collect()}
    want = [(1, a), (1, b), (None, ""), (None, c)] + ([] if linked[5] == 1 else [(5, rows[7][1])])
    assert got == sorted(want, key=str)


def plain_contaminated(docs, items):
    """Best similarity of every pair of 0.8 or more; a document shorter than the item is one window."""
    out = {}
    for d, t in docs:
        w = words(t)
        for i, b in items:
            x = words(b)
            n, k = len(x), min(5, len(x))
            if not n:
                continue
            c = collections.Counter(tuple(x[j:j + k]) for j in range(n - k + 1))
            sh = [tuple(w[j:j + k]) for j in range(len(w) - k + 1)]
            m, width = n - k + 1, min(n, len(w)) - k + 1
            best = 0
            for s in range(len(sh) - width + 1 if width > 0 else 0):
                same = sum((c & collections.Counter(sh[s:s + width])).values())
                best = max(best, same / (m + width - same))
            if best >= 0.8:
                out[d, i] = round(best, 6)
    return out


def test_decontamination_equals_brute_force(spark):
    item = "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf in the dark cold forest near " \
           "a river that flows down to the sea where ships sail out each day at dawn with men who hope to come home again soon"
    x = item.split()
    rows = [(1, "intro " + item.upper() + " outro"), (2, " ".join(x[:30]) + " changed " + " ".join(x[31:])), (3, " ".join(x[2:])), (4, " ".join(x[:20])),
            (5, None), (6, ""), (7, "a b c\nd e f"), (None, item), (9, (item + " ") * 3), (9, (item + " ") * 3),
            (10, " ".join(x[:10] + ["zzz"] + x[10:20] + ["yyy"] + x[20:]))]
    items = [(100, item), (101, "a b c"), (102, None), (103, " "), (104, " ".join(x[:8] * 4))]
    d = spark.createDataFrame([(a, b, "extra") for a, b in rows], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["id"], r["item_id"]): round(r["similarity"], 6) for r in decontaminate.contaminated(d, b).collect()}
    assert got == plain_contaminated(rows, items) and (2, 100) in got and (1, 100) in got
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r[0] for r in rows} - {k[0] for k in got})
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0


def test_blocks_cover_the_radius():
    rng = np.random.default_rng(0)
    radius = decontaminate.radius_of(0.8)
    near, width = set(decontaminate.near_values(radius // decontaminate.BLOCKS)), decontaminate.WIDTH
    for _ in range(500):
        diff = 0
        for b in rng.choice(64, radius, replace=False):
            diff |= 1 << int(b)
        assert any((diff >> i * width & (1 << width) - 1) in near for i in range(decontaminate.BLOCKS))
    assert len(near) < 40  # and they do not cover everything


def test_radius_holds_pairs_at_the_threshold():
    """Fingerprints of two sets of shingles with a similarity just above 0.8, for few and for many shingles."""
    rng = np.random.default_rng(3)
    radius, missed, n = decontaminate.radius_of(0.8), 0, 0
    for m in (9, 10, 18, 45, 96, 300):
        change = int(m * 0.2 / 1.8)
        assert (m - change) / (m + change) >= 0.8 > (m - change - 1) / (m + change + 1)
        for _ in range(1500):
            h = rng.integers(0, 2 ** 63, m + change, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, m + change, dtype=np.uint64)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(int)
            missed += ((2 * bits[:m].sum(0) > m) != (2 * bits[change:].sum(0) > m)).sum() > radius
            n += 1
    assert missed <= n // 1000


def test_rolled_fingerprints(spark):
    rng = np.random.default_rng(5)
    h = [int(x) for x in rng.integers(-2 ** 63, 2 ** 63 - 1, 60)]
    df = spark.createDataFrame([(h, 7), (h, 60), (h[:1], 1), (h, 1)], "h array<long>, w int")
    for row in df.select("h", "w", decontaminate.rolled(F.col("h"), F.col("w")).alias("out")).collect():
        want = []
        for s in range(len(row["h"]) - row["w"] + 1):
            part = row["h"][s:s + row["w"]]
            v = sum((sum(x >> b & 1 for x in part) * 2 > len(part)) << b for b in range(64))
            want.append(v - 2 ** 64 if v >= 2 ** 63 else v)
        assert row["out"] == want


def test_edited_passages_near_the_threshold(spark):
    """Random passages with random edits inside random documents, items that repeat their own words included."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([4, 40, 90, 150])))) for i in range(12)]
    items += [(50, "la la la la la la la hey " * 5), (51, "one two three four five six " * 4 + "end")]
    docs = []
    for d in range(150):
        part = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 1, 2, 3])):
            at = rng.randrange(len(part))
            part[at:at + rng.randrange(2)] = [word() for _ in range(rng.randrange(2))]
        part = part * rng.choice([1, 1, 2])
        docs.append((d, " ".join([word() for _ in range(rng.randrange(40))] + part + [word() for _ in range(rng.randrange(40))])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + items[:3], "item_id long, text string")
    got = {(r["id"], r["item_id"]): round(r["similarity"], 6) for r in decontaminate.contaminated(d, b).collect()}
    want = plain_contaminated(docs, items)
    assert got == want and sum(v < 1 for v in want.values()) > 20


def test_long_item_many_times_in_one_document(spark):
    rng = random.Random(1)
    item = [f"t{rng.randrange(10**6)}" for _ in range(1000)]
    d = spark.createDataFrame([(1, " ".join(item * 8)), (2, " ".join(item[:990])), (3, "other words")], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    decontaminate.contaminated(d.limit(0), b).count()
    began = time.time()
    got = decontaminate.contaminated(d, b).collect()
    assert {(r["id"], r["start"], round(r["similarity"], 3)) for r in got} == {(1, 0, 1.0), (2, 0, round(986 / 996, 3))}
    assert time.time() - began < 30


def plain_topk(ids, vecs, k=5, every=50):
    out = []
    for n, (i, q) in enumerate(zip(ids, vecs)):
        if i is not None and i % every == 0:
            rank = sorted((-int(np.dot(q, v)), 2 ** 63 if j is None else j) for m, (j, v) in enumerate(zip(ids, vecs)) if m != n)[:k]
            out += [(i, r + 1, None if j == 2 ** 63 else j, -s) for r, (s, j) in enumerate(rank)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [16, 10_000])
def test_topk_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pivot_topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(pivot_topk, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype("float32")
    x[100:200] = x[0]  # a hot vector: ties go to smaller ids
    x[250:] *= 1e6
    ids = list(range(300))
    ids[200:204], ids[210:213], ids[260] = [0, 0, 50, 50], [None] * 3, None  # repeated ids are rows of their own
    rows = [(i, [float(e) for e in v], 0) for i, v in zip(ids, x)] + [(900, None, 0), (950, [1.0, None], 0), (951, [float("nan")] * 8, 0), (1000, [], 0)]
    rows.append((1050, [1.0, 2.0], 0))  # of another length: no candidates
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").withColumn("row", F.lit("clash")).withColumn("v", F.lit(1))
    v = pivot_topk.quantise(df, "vec_id", "embedding")
    got = pivot_topk.top_k(v, F.col("id") % 50 == 0).select("query_id", "rank", "id", "score").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_topk(ids, np.floor(x.astype(float) * 256).astype(np.int64))
    assert pivot_topk.top_k(v.limit(0), F.col("id") % 50 == 0).count() == 0


def test_topk_evaluates_few_candidates():
    rng = np.random.default_rng(2)
    centre = rng.integers(-900, 900, (20, 16))
    c = np.repeat(centre, 200, 0) + rng.integers(-5, 5, (4000, 16))
    block = lambda n: pivot_topk.Rows(np.arange(n), np.arange(n), c[:n], pivot_topk.to_pivots(c[:n], centre))
    *_, evaluated = pivot_topk.best_in_block(block(10), block(4000), 5)
    assert evaluated < 0.2 * 10 * 4000
