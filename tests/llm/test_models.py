"""Quality CRF, weak toxicity supervision, licence scan and the pipeline."""

import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest

from flowlab.llm import crf_quality, license_scan, registry, weak_toxicity

SMALL = "/root/testdata/sf0.01"


def labelled(spark, query, column, cut, fold):
    rows = {r["doc_id"]: r for r in query(spark, SMALL).collect()}
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    k, held = fold
    for i, r in rows.items():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) and r["held_out"] == (zlib.crc32(str(i).encode()) % k == held)
    truth = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    return [(rows[i], y) for i, y in truth.items() if i in rows]


def test_quality_on_held_out_labels(spark):
    pairs = labelled(spark, crf_quality.op2_crf_quality, "quality", 0.7, (4, 2))
    held = [(r["predicted"], y) for r, y in pairs if r["held_out"]]
    assert np.mean([p == y for p, y in held]) >= 0.95 and np.mean([p for p, y in held if y == 1]) >= 0.98


def test_toxicity_on_held_out_labels(spark):
    pairs = labelled(spark, weak_toxicity.op7_weak_toxicity, "toxic", 0.5, (5, 0))
    held = [(r["predicted"], y) for r, y in pairs if r["held_out"]]
    assert np.mean([p == y for p, y in held]) >= 0.9 and np.mean([p for p, y in held if y == 0]) <= 0.05


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    per_text = np.array([1, 4, 3])
    u, step = rng.normal(size=8), rng.normal(size=(2, 2))
    got, pairs = crf_quality.marginals(u, per_text, step)
    want, total, at = np.zeros(8), np.zeros((2, 2)), 0
    for n in per_text:
        z = 0.0
        good, cells = np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(u[at + i] * y[i] for i in range(n)) + sum(step[a, b] for a, b in zip(y, y[1:])))
            z += w
            good += w * np.array(y)
            for a, b in zip(y, y[1:]):
                cells[a, b] += w
        want[at:at + n] = good / z
        total += cells / z
        at += n
    assert got == pytest.approx(want) and pairs == pytest.approx(total)


def test_line_features_count_what_they_say():
    x, per_text, chars = crf_quality.line_features(["Ab cd cd\n\nAB | 12", "", "x\nx y z\nx y z"])
    assert per_text.tolist() == [3, 1, 3] and chars.tolist() == [8, 0, 7, 0, 1, 5, 5]
    assert x.shape == (7, crf_quality.N_FEATURES)
    assert x[0, 8] == pytest.approx(2 / 3) and x[0, 9] == pytest.approx(1 / 3)  # distinct words, repeats of the word before
    assert x[2, 1] == pytest.approx(2 / 7) and x[2, 14] == pytest.approx(1 / 3)  # upper case, bars
    assert x[:, 10].tolist() == [0, 0, 0, 0, 0, 1, 1]  # repeated lines of one text
    one, _, _ = crf_quality.line_features(["x\nx y z\nx y z"])
    assert one == pytest.approx(x[4:])


def test_scores_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    chain = crf_quality.train(odd, labels)
    model, _ = weak_toxicity.train(odd, labels)
    rows = odd.select(crf_quality.quality_score(chain, F.col("text")).alias("q"), weak_toxicity.toxicity_score(model, F.col("text")).alias("t")).collect()
    assert len(rows) == 9 and all(0 <= r["q"] <= 1 and 0 <= r["t"] <= 1 for r in rows)
    assert crf_quality.keep_good(odd, labels).columns == odd.columns
    none = labels.limit(0)
    assert crf_quality.keep_good(odd.limit(0), none).count() == 0 and weak_toxicity.train(odd.limit(0), none)[0].weights == {}


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    noisy = lambda p: np.where(rng.random(4000) < p, y, ~y) * 2 - 1
    votes = np.column_stack([noisy(0.9), noisy(0.8), noisy(0.75), noisy(0.85), noisy(0.7)])
    votes = np.column_stack([votes, votes[:, 4], votes[:, 4]])  # a weak voter, three times
    posterior, accuracy, corr = weak_toxicity.label_model(votes)
    assert np.mean((posterior > 0.5) == y) > 0.9
    assert accuracy[:4] == pytest.approx([0.9, 0.8, 0.75, 0.85], abs=0.05) and corr[4, 5] > 0.95 and abs(corr[0, 1]) < 0.2


def test_licence_lines(spark, docs):
    want = set()
    names = {"apache": "Apache License", "mit": "MIT License", "gpl": "GNU General Public", "cc-by-nc": "CC BY-NC", "proprietary": "All rights reserved"}
    for r in docs.collect():
        for n, line in enumerate((r["text"] or "").split("\n")):
            want |= {(r["doc_id"], n, f) for f, p in names.items() if p in line}
    extra = [(10_001, "Text before. Released under the MIT License. And text after it, about the weather."), (10_002, "license to drive under the bridge by the public road"),
             (10_003, None), (10_004, ""), (10_005, "\n\nREDISTRIBUTION and use in source and binary forms, with or without modification, are permitted"), (10_006, "all rights reserved")]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    want |= {(10_001, 0, "mit"), (10_005, 2, "bsd"), (10_006, 0, "proprietary")}
    scanner = license_scan.train(docs)
    got = {(r["doc_id"], r["paragraph"], r["family"]) for r in license_scan.scan(more, scanner).collect() if r["family"] != "unknown"}
    assert got == want
    assert license_scan.scan(more.limit(0), scanner).count() == 0


def test_anchor_words_lose_no_prediction():
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i} w{i + 1}" if i % 3 else f"w{i}" for i in range(40)]
    weights, intercepts = rng.normal(size=(4, 40)), np.array([3.0, -1.0, -2.0, 0.0])
    seen = {f"w{i}": rng.random() for i in range(42)}
    anchors = set(license_scan.anchor_words(vocabulary, weights, intercepts, 0.6, seen))
    for _ in range(2000):
        x = rng.random(40) < 0.1
        s = weights @ x + intercepts
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        if p[1:].max() >= 0.6:
            assert anchors & {w for g, on in zip(vocabulary, x) if on for w in g.split(" ")}


def test_oracles_equal_spark(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    for name, sql in registry.ORACLE.items():
        df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        cur = con.execute(f"SELECT * FROM ({sql})")
        cols = [d[0] for d in cur.description]
        tidy = lambda v: "None" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)
        want = sorted(tuple(tidy(r[cols.index(c)]) for c in df.columns) for r in cur.fetchall())
        assert sorted(cols) == sorted(df.columns)
        assert sorted(tuple(tidy(v) for v in r) for r in df.collect()) == want, name


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as pipe
    from test_pairs import plain_contaminated, plain_fingerprint, plain_groups
    from test_rows import plain_spans

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 300")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = {}
    for k, (name, stage) in enumerate(pipe.STAGES):
        out = stage(spark, docs, SMALL)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[k] = {r["doc_id"]: r for r in docs.collect()}
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    both = [i for i in rows if i in truth]
    assert np.mean([(i in kept[0]) == bool(truth[i]) for i in both]) > 0.95
    groups = plain_groups({i: plain_fingerprint(r["text"]) for i, r in kept[0].items()})
    assert set(kept[1]) == {i for i, g in groups.items() if i == g}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bad = {d for d, _ in plain_contaminated([(i, r["text"]) for i, r in kept[1].items()], items)}
    assert set(kept[2]) == set(kept[1]) - bad
    assert set(kept[3]) == set(kept[2])
    for i, r in kept[3].items():
        assert not plain_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not plain_spans(kept[2][i]["text"]):
            assert r["text"] == kept[2][i]["text"]
    mix = docs.orderBy("position").collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for i, r in kept[3].items()}
    taken = {}
    for r in mix:
        assert r["words"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["words"]
    assert all(taken[i] <= 3 * size[i] for i in taken) and abs(sum(taken.values()) - sum(size.values())) <= 40


def write_tables(spark, place, documents, labels, benchmark):
    kinds = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int",
             "benchmark": "item_id long, text string"}
    for (name, kind), rows in zip(kinds.items(), (documents, labels, benchmark)):
        spark.createDataFrame(rows, kind).write.parquet(f"{place}/{name}.parquet")


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline as pipe

    words = [f"word{i}" for i in range(400)]
    texts = {"a": " ".join(words[:120]), "b": " ".join(words[120:260]), "c": " ".join(words[260:])}
    documents = [(1, texts["a"], "en", "s", 1), (1, texts["b"], "en", "s", 1), (None, texts["c"], "en", None, 1), (None, texts["c"], "en", None, 1),
                 (3, None, None, None, None), (4, "", "en", "s", 0), (5, "write to a@b.co or " + " ".join(words[::3]), "en", "t", 9), (6, texts["a"], "en", "s", 1)]
    write_tables(spark, f"{tmp_path}/odd", documents, [], [(9, None), (10, "")])
    left = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    with pytest.warns(UserWarning, match="keeps all documents"):
        for k, (_, stage) in enumerate(pipe.STAGES[:4]):
            stage(spark, left, f"{tmp_path}/odd").write.parquet(f"{tmp_path}/stage{k}")
            left = spark.read.parquet(f"{tmp_path}/stage{k}")
        got = pipe.run(spark, f"{tmp_path}/odd").collect()
    texts_left = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert sorted(texts_left, key=str) == sorted(
        [(1, texts["a"]), (1, texts["b"]), (None, texts["c"]), (3, None), (5, "write to <EMAIL> or " + " ".join(words[::3]))], key=str)
    assert sum(r["words"] for r in got) > 0 and {r["doc_id"] for r in got} <= {1, None, 5}
    write_tables(spark, f"{tmp_path}/empty", [], [], [])
    with pytest.warns(UserWarning):
        assert pipe.run(spark, f"{tmp_path}/empty").count() == 0


def test_long_texts_train_by_a_stretch(spark):
    long = "\n".join(f"line {i} of a long and readable text." for i in range(5000))
    part = crf_quality.stretch(long)
    assert part in long and part.count("\n") < crf_quality.TRAIN_LINES and len(part) <= crf_quality.TRAIN_CHARS and part.count("\n") > 200
    assert len(crf_quality.stretch("x" * 200_000)) == crf_quality.TRAIN_CHARS and crf_quality.stretch("a\nb") == "a\nb" and crf_quality.stretch("") == ""
    wide = "\n".join("y" * 1000 for _ in range(290))
    assert 0 < len(crf_quality.stretch(wide)) <= crf_quality.TRAIN_CHARS
    assert weak_toxicity.stretch(long) in long and len(weak_toxicity.stretch(long)) == weak_toxicity.TRAIN_CHARS
    # documents of which all are long still train a model
    good = [(i, f"Opening {i}.\n" + long, "x") for i in range(20)]
    junk = [(100 + i, f"{i} | buy | now\n" * 9000, "x") for i in range(20)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, *_ in good + junk], "doc_id long, quality int, toxic int")
    chain = crf_quality.train(docs, labels)
    assert chain.trained
    kept = {r["doc_id"] for r in crf_quality.keep_good(docs, labels).select("doc_id").collect()}
    assert kept == {i for i, *_ in good}
    assert not crf_quality.train(docs, labels.where("quality = 1")).trained
