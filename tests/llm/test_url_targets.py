"""Hosts that only links name are judged by the rules as well."""

import pytest

from flowlab.llm import url_filter


def test_uncrawled_targets_are_seeds(spark):
    link = lambda *urls: "".join(f'<a href="{u}">t</a>' for u in urls)
    pages = [(1, "http://s.com/", link("http://spam.net/x", "//worse.net/y")), (2, "http://t.com/", link("http://s.com/")),
             (3, "http://u.com/", link("http://fine.example.net/en/1")), (4, "http://v.com/", link("http://plain.com/")),
             # one blocked page, named often, of three: below the share of a seed
             (5, "http://w.com/", link(*["http://example.com/de/1"] * 5, "http://example.com/a", "http://example.com/b")), (6, "http://x.com/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["host"]: r for r in url_filter.filter_urls(df).collect()}
    assert {h: r["verdict"] for h, r in got.items()} == {"s.com": "block", "t.com": "block", "u.com": "allow", "v.com": "allow", "w.com": "allow", "x.com": "allow"}
    assert got["s.com"]["distrust"] == pytest.approx(0.85 * 2) and got["t.com"]["distrust"] == pytest.approx(0.85 ** 2 * 2)
    assert all(got[h]["distrust"] == 0 for h in ("u.com", "v.com", "w.com", "x.com")) and len(got) == len(pages)
