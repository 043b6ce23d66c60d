"""Decontamination against plain shingle similarity: documents shorter than the item, and pairs near the bar."""

import collections
import random

from flowlab.llm import decontaminate


def plain(docs, items, bar=0.8):
    out = {}
    for d, t in docs:
        for i, b in items:
            w, x = t.split(), b.split()
            n, k = min(len(w), len(x)), min(5, len(x))
            count = lambda ws: collections.Counter(tuple(ws[j:j + k]) for j in range(len(ws) - k + 1))
            c, best = count(x), 0
            for s in range(len(w) - n + 1):
                v = count(w[s:s + n])
                best = max(best, sum((c & v).values()) / max(1, sum((c | v).values())))
            if best >= bar:
                out[d, i] = round(best, 6)
    return out


def test_short_documents_and_pairs_near_the_bar(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([48, 13, 40, 95, 200, 4, 5] + [60] * 8)]
    docs = []
    for i, text in items:
        x = text.split()
        for cut in range(0, len(x), max(1, len(x) // 24)):  # shorter and shorter documents
            docs.append((len(docs), " ".join(x[cut:])))
            docs.append((len(docs), " ".join(x[:len(x) - cut])))
        for spot in range(1, 5):  # a changed word costs up to five shingles
            y = list(x)
            for at in rng.sample(range(len(y)), min(spot, len(y))):
                y[at] = "zzz"
            docs.append((len(docs), " ".join(rng.choices(words, k=7) + y + rng.choices(words, k=9))))
        for tail in range(1, 25):  # the first words are others: similarity falls through 0.8
            y = rng.choices(words, k=min(tail, len(x))) + x[min(tail, len(x)):]
            docs.append((len(docs), " ".join(y)))
        for _ in range(40 if len(x) == 60 else 0):  # 50 of 56 shingles shared: 0.806, some far apart in Hamming distance
            docs.append((len(docs), " ".join(rng.choices(words, k=6) + x[6:])))
    want = plain(docs, items)
    assert sum(0.8 <= s < 0.83 for s in want.values()) >= 15
    assert sum(len(docs[d][1].split()) < len(dict(items)[i].split()) for d, i in want) >= 30
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(d, b).collect()
    assert {(r["id"], r["item_id"]): round(r["similarity"], 6) for r in found} == want
    assert any(r["distance"] > 15 for r in found)
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(d, b).collect()}
    assert kept == {n for n, _ in docs} - {n for n, _ in want}
