"""URL filter, mixing, PII and html extraction."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from flowlab.llm import host_suffix_extract as html
from flowlab.llm import mixing, pii, url_filter

from helpers import luhn_ok


def test_url_parts_and_rules(spark):
    urls = ["HTTP://A.Example.NET/en/x?q#f", "http://example.net", "http://example.com/de/1", "x://org/fr/", "http://notnet/", "no url", None, "", "http://b.org?x/fr/",
            "http://u.com/a#b", "a://b://c/d"]
    df = spark.createDataFrame([(i, u, None, "h") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[1] == ("example.net", "", None, "allow")
    assert got[2] == ("example.com", "/de/1", "example.com/de/", "block") or got[2][2] == "example.com/de/"
    assert got[3][2:] == ("org/fr/", "allow") and got[4][2] is None
    assert got[5][:2] == got[6][:2] == got[7][:2] == ("", "") and got[5][3] == "allow"
    assert got[8][:3] == ("b.org", "", None) and got[10][:2] == ("b:", "//c/d") and len(got) == len(urls)
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_trust_and_distrust_follow_links(spark):
    link = lambda *hosts: "".join(f'<a class=x href="http://{h}/p">t</a><a href="/local">l</a>' for h in hosts)
    pages = [(1, "http://bad.net/x", link("c.com")), (2, "http://s.com/", link("bad.net")), (3, "http://t.com/", link("s.com")),
             (4, "http://good.org/fr/", link("g.com")), (5, "http://g.com/", ""), (6, "http://c.com/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["host"]: r for r in url_filter.filter_urls(df).collect()}
    assert got["s.com"]["verdict"] == "block" and got["t.com"]["verdict"] == "block"  # they link towards a blocked host
    assert got["g.com"]["verdict"] == "allow" and got["g.com"]["trust"] == pytest.approx(0.85) and got["c.com"]["verdict"] == "allow"
    # against a dense power series
    hosts = ["bad.net", "s.com", "t.com", "good.org", "g.com", "c.com"]
    a = np.zeros((6, 6))
    for s, d in (("bad.net", "c.com"), ("s.com", "bad.net"), ("t.com", "s.com"), ("good.org", "g.com")):
        a[hosts.index(s), hosts.index(d)] = 1
    seed, rank = np.eye(6)[0], np.eye(6)[0]
    for _ in range(url_filter.STEPS):
        rank = seed + 0.85 * rank @ (a.T / np.maximum(a.T.sum(1, keepdims=True), 1))
    assert [got[h]["distrust"] for h in hosts] == pytest.approx(rank.tolist())


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return {**fixed, **share}
        for s in over:
            fixed[s] = cap * sizes[s]
        left = sum(sizes.values()) - sum(fixed.values())


def test_targets_equal_round_by_round(spark):
    rng = random.Random(4)
    for n in (1, 2, 7, 40):
        sizes = {(None if i == 3 else f"s{i}"): rng.choice([0, 1, 5, 50, 1000, 20000]) for i in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = plain_targets(sizes)
        assert got == pytest.approx(want)


def test_mix_takes_the_targets_in_curriculum_order(spark, docs):
    plan = mixing.plan_mix(docs).collect()
    by = {}
    for r in plan:
        by.setdefault(r["source"], []).append(r)
    for rows in by.values():
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 1
        at = sorted((p, r["draw"]) for r in rows for p in r["positions"])
        assert all(0 <= p <= 1 for p, _ in at)
        # copies of one pass keep the draw order
        first = [d for _, d in at][:sum(1 for r in rows if r["positions"])]
        assert first == sorted(first)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in plan)
    again = mixing.plan_mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, plan))


@pytest.mark.parametrize("knots", mixing.SCHEDULES)
def test_positions_invert_the_integrated_schedule(spark, knots):
    t = np.linspace(0, 1, 20001)
    rate = np.interp(t, *zip(*knots))
    area = np.concatenate(([0], np.cumsum((rate[1:] + rate[:-1]) / 2 * np.diff(t))))
    done = [0.0, 0.01, 0.2, 0.5, 0.77, 0.999, 1.0]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x,) for x in done], "d double")
    got = [r[0] for r in df.select(mixing.demand_time(F.col("d"), F.lit(0), (knots,))).collect()]
    assert got == pytest.approx(np.interp(np.array(done) * area[-1], area, t).tolist(), abs=1e-4)


def test_mix_odd_rows(spark, odd):
    plan = mixing.plan_mix(odd).collect()
    assert len(plan) == 9 and all(r["taken"] <= 3 * r["size"] for r in plan)
    out = mixing.mixed_documents(odd)
    rows = out.collect()
    assert out.columns == [*[c for c in odd.columns if c not in ("words", "position")], "copy", "words", "position"]
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    assert sum(r["words"] for r in rows) == sum(r["taken"] for r in plan)
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) == r["words"] for r in rows)
    assert mixing.plan_mix(odd.limit(0)).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    bare = lambda m: re.sub("[^0-9]", "", m)
    ok = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
          "card": lambda m: 12 <= len(bare(m)) <= 19 and luhn_ok(bare(m)), "phone": lambda m: 9 <= len(bare(m)) <= 15}
    return sorted((m.start(), o, m.end(), k) for o, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if ok[k](m[0]))


def check_pii(df, rows):
    got = {r["n"]: r["pii_spans"] for r in pii.find_pii(df).collect()}
    for n, text in rows:
        mine = [(s["start"], s["order"], s["end"], s["kind"]) for s in got[n] if s["order"] < 4]
        assert mine == plain_spans(text), repr(text)[:200]
    return got


def test_base_spans_equal_python_regex(spark):
    rng = random.Random(9)
    bits = ["a@b.c", "x.y+z@mail-1.org.uk", "@", "a@b", "_", "1.2.3.4", "255.255.255.255", "1.2.3.256", "1.2.3.4.5.6.7.8", "007.0.0.001", ".", "4111 1111 1111 1111",
            "4111-1111-1111-1111", "79927398713", "0000000000000", "+1 (555) 555-0100", "+", "+1.2.3.4", " ", "\n", "-", "é", "漢", "😀", "12", "٣", "word", "("]
    rows = [(n, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for n in range(1500)]
    rows += [(9000, None), (9001, ""), (9002, "9" * 2_000), (9003, "a" * 2_000), (9004, "1." * 500), (9005, "+1" + "(" * 1_000), (9006, "x@y.z " * 300)]
    check_pii(spark.createDataFrame(rows, "n int, text string"), rows)


def test_very_long_runs_take_no_quadratic_time(spark):
    texts = ["9" * 200_000, "a" * 200_000, "1." * 20_000, "+1" + "(" * 200_000, "x@y.z " * 3_000]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    assert [len(r["pii_spans"]) for r in pii.find_pii(df).orderBy("n").collect()] == [0, 0, 5_000, 0, 3_000]


def test_many_matches_in_one_text_take_no_quadratic_time(spark):
    dump = " ".join(f"AB{i % 90 + 10} CD{i % 83 + 10}" for i in range(10_000))  # 20,000 starts of IBANs; by chance one in 97 checks is right
    mails = "".join(f"user{i}@host{i}.org, " for i in range(30_000))
    cards = "4111111111111111, " * 5_000
    texts = ["short", dump, mails, cards, "é" + "DE89 3704 0044 0532 0130 00; " * 5_000, "ssn 123-45-6789, " * 10_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    pii.mask_pii(df.where("doc_id = 0")).collect()
    began = time.time()
    got = pii.find_pii(df).selectExpr("doc_id", "size(pii_spans) n", "get(pii_spans, 0).start a", "get(pii_spans, size(pii_spans) - 1).end b").orderBy("doc_id").collect()
    assert [r["n"] for r in got][2:] == [30_000, 5_000, 5_000, 10_000]
    assert [(r["a"], r["b"]) for r in got[2:]] == [(0, len(mails) - 2), (0, len(cards) - 2), (1, len(texts[4]) - 2), (4, len(texts[5]) - 2)]
    assert time.time() - began < 40
    masked = [r["text"] for r in pii.mask_pii(df).orderBy("doc_id").collect()]
    assert masked[:1] + masked[2:] == ["short", "<EMAIL>, " * 30_000, "<CARD>, " * 5_000, "é" + "<IBAN>; " * 5_000, "ssn <SSN>, " * 10_000]


def test_added_kinds_are_validated_and_scored(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 end"), (2, "DE89370400440532013001"), (3, "my ssn is 123-45-6789"), (4, "part 123-45-6789 of"), (5, "ssn 000-45-6789")]
    got = check_pii(spark.createDataFrame(rows, "n int, text string"), rows)
    kinds = {n: [s["kind"] for s in v if s["order"] >= 4] for n, v in got.items()}
    assert kinds == {1: ["iban"], 2: [], 3: ["ssn"], 4: [], 5: []}
    bare = spark.createDataFrame([(1, "DE89370400440532013000", 0)], "n int, text string, pii_spans int")
    assert [s["kind"] for s in pii.find_pii(bare).first()["pii_spans"]] == ["iban"]


def test_masking(spark, odd):
    df = spark.createDataFrame([(1, "é mail a@b.co, ip 10.0.0.1."), (2, None), (3, "nothing")], "doc_id int, text string")
    assert [r["text"] for r in pii.mask_pii(df).orderBy("doc_id").collect()] == ["é mail <EMAIL>, ip <IP>.", None, "nothing"]
    assert pii.mask_pii(odd).columns == odd.columns and sorted(map(str, pii.mask_pii(odd).collect())) == sorted(map(str, odd.collect()))
    assert pii.find_pii(odd.limit(0)).count() == 0


def test_pii_digest(spark):
    from flowlab.llm.registry import QUERIES

    rows = {r["doc_id"]: r for r in QUERIES["op9_pii"](spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        spans = plain_spans(r["text"])
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert rows[r["doc_id"]]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()


PAGE = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav>'
        '<div class="ad">Buy {i}</div><article><h1>Title&amp;{i}</h1><p><b>one  two\n{i}<br><p>th&eacute;</p><!-- c <p>no</p> --></article>'
        '<div id="comments"><p>I disagree {i}</p></div><footer>&copy; site</footer>')


def test_pages_yield_the_article(spark):
    rows = [(i, f"http://h{i % 2}.com/{i}", PAGE.replace("{i}", str(i)), "extra") for i in range(12)] + [
        (50, None, None, ""), (51, "http://h0.com/", "", ""), (52, "x", "plain  words\n only", ""), (52, "x", "plain  words\n only", ""), (53, "http://h0.com/z", "<p>open <b", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract_main_text(df).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert all(by[i] == f"Title&{i}\none two {i}\nthé" for i in range(12))
    assert by[50] == by[51] == "" and by[52] == "plain words only" and by[53] == "open"
    assert html.extract_main_text(df.limit(0)).count() == 0


def block_pages(spark, pages, host="h.com"):
    """Pages of given (text, region) blocks: paragraphs in or outside an article."""
    wrap = {html.FREE: "<div>{}</div>", html.MAIN: "<article><p>{}</p></article>", html.DROP: "<nav>{}</nav>"}
    rows = [(i, f"http://{host}/{i}", "".join(wrap[r].format(t) for t, r in blocks)) for i, blocks in enumerate(pages)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts_of(df):
    return [r["text"] for r in html.extract_main_text(df).orderBy("page_id").collect()]


def test_repeated_runs_outside_articles_go(spark):
    template = "follow us on all the channels that we run every day of the week"
    pages = [[(template, html.FREE), (f"s{i} unique story number {i} about thing {i * 7} and more words {i}", html.FREE)] for i in range(8)]
    assert texts_of(block_pages(spark, pages)) == [p[1][0] for p in pages]
    mixed = [[(f"s{i} {template} e{i}", html.FREE)] for i in range(8)]
    assert texts_of(block_pages(spark, mixed)) == [f"s{i} e{i}" for i in range(8)]
    copies = [[("an article that was copied to many pages of the host word for word", html.FREE)]] * 9
    assert texts_of(block_pages(spark, copies)) == [c[0][0] for c in copies]
    shared = [[(template, html.MAIN), (f"story {i}", html.MAIN)] for i in range(8)]
    assert texts_of(block_pages(spark, shared)) == [f"{template}\nstory {i}" for i in range(8)]
    many = [[(template, html.MAIN), (f"s{i} story", html.MAIN)] for i in range(30)]
    assert texts_of(block_pages(spark, many)) == [f"s{i} story" for i in range(30)]


def test_run_counts_equal_brute_force():
    rng = np.random.default_rng(5)
    streams = [rng.integers(0, 3, rng.integers(0, 60)) for _ in range(6)]
    for s, g in zip(streams, html.run_counts(streams, 8)):
        want = [sum(any((t[b:b + 8] == s[a:a + 8]).all() for b in range(len(t) - 7)) for t in streams) for a in range(len(s) - 7)]
        assert g.tolist() == want


def plain_texts(pages):
    """Main texts of the blocks of one host's pages by sets of runs."""
    streams = [tuple(w for t, _ in p for w in t.split(" ")) for p in pages]
    runs = [{s[i:i + html.RUN] for i in range(len(s) - html.RUN + 1)} for s in set(streams)]
    count = {}
    for r in runs:
        for x in r:
            count[x] = count.get(x, 0) + 1
    d, out = len(runs), []
    for p, s in zip(pages, streams):
        best = [0] * len(s)
        for i in range(len(s) - html.RUN + 1):
            for j in range(i, i + html.RUN):
                best[j] = max(best[j], count[s[i:i + html.RUN]])
        at, kept = 0, []
        for t, region in p:
            bar = max(html.MAIN_PAGES, html.MAIN_SHARE * d) if region == html.MAIN else max(html.FREE_PAGES, html.FREE_SHARE * d)
            words = t.split(" ")
            left = " ".join(w for w, n in zip(words, best[at:at + len(words)]) if n < bar)
            at += len(words)
            if region != html.DROP and left:
                kept.append(left)
        out.append("\n".join(kept))
    return out


@pytest.mark.parametrize(("pages_a_shard", "bytes_a_shard"), [(128, 1 << 20), (3, 1 << 20), (1, 1 << 20), (128, 300)])
def test_unmarked_templates_go_however_pages_are_dealt(spark, monkeypatch, pages_a_shard, bytes_a_shard):
    """No block is marked, so the suffix arrays decide alone; the same texts for every way of dealing pages to shards."""
    monkeypatch.setattr(html, "SHARD_PAGES", pages_a_shard)
    monkeypatch.setattr(html, "SHARD_BYTES", bytes_a_shard)
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(3000)}"
    templates = [" ".join(word() for _ in range(n)) for n in (9, 14, 30)]
    pages = []
    for i in range(30):
        parts = [(t, html.FREE) for t, p in zip(templates, (1.0, 0.7, 0.3)) if rng.random() < p]
        parts += [(" ".join(word() for _ in range(rng.randrange(3, 60))), rng.choice([html.FREE, html.MAIN, html.MAIN])) for _ in range(3)]
        parts += [(templates[0], html.MAIN)]
        rng.shuffle(parts)
        pages.append(parts)
    pages[9] = [(" ".join(word() for _ in range(4000)), html.MAIN), *pages[9]]  # one long page among short ones
    pages += pages[:6]  # copies count once
    want = plain_texts(pages)
    plain_join = ["\n".join(t for t, r in p if r != html.DROP) for p in pages]
    assert texts_of(block_pages(spark, pages)) == want and sum(a != b for a, b in zip(want, plain_join)) == 36


def test_hot_host_is_sharded(spark, monkeypatch):
    monkeypatch.setattr(html, "SHARD_PAGES", 4)
    df = spark.createDataFrame([(i, "http://one.com/", PAGE.replace("{i}", str(i))) for i in range(40)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.extract_main_text(df).collect()} == {i: f"Title&{i}\none two {i}\nthé" for i in range(40)}
