"""Main text of web pages: page structure, and suffix arrays over the pages of a host.

1. A pass over the html yields the blocks of a page, each with its region:
   boilerplate by structure (menus, forms, adverts, comments, ...), inside an
   article, or neither. The blocks that are not boilerplate are stored once.
2. Pages meet by host, copies once. A host with many pages or much text is dealt
   to shards by a hash of the page's content, so a hot host never meets in one
   task. In a shard the token streams are concatenated and their suffixes sorted
   to the depth of ``RUN`` tokens by prefix doubling; neighbours of equal rank
   share a run of that length. A run on a given share of a host's pages is on
   that share of the pages of some shard, so every shard names the runs that
   reach it, and loses none.
3. The named runs of a host with several shards are counted in all of them and
   summed in Spark. So the bars below hold for whole hosts, however their pages
   are dealt and however long they are.
4. Every page is covered by the runs that pass for its host (at most twice as
   many as a mean page of the host has tokens); longer repeats are unions of such
   runs. Covered tokens go, with a stricter bar inside an article (a template
   inside articles is on nearly all pages; a passage or a copied article is
   not). The unique runs stay, in page order.

Copies of a page count once, so a copied page is not its own boilerplate.
"""

from __future__ import annotations

import html as html_lib
import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm.common import cut_lineage, table
from flowlab.llm.url_filter import url_host
from flowlab.session import BROADCAST_MAX_ROWS, broadcast_if_small

RUN = 8  # tokens of a repeated run (a power of two: prefix doubling)
FREE_PAGES, FREE_SHARE = 4, 0.5  # distinct pages of a host (and their share) that make a run boilerplate outside articles
MAIN_PAGES, MAIN_SHARE = 20, 0.8  # the same inside articles
SHARD_PAGES, SHARD_BYTES = 128, 1 << 20  # pages, and bytes of compressed blocks, that meet in a task
BASES = tuple(np.array([pow(b, i, 2**64) for i in range(RUN)], np.uint64) for b in (0x9E3779B97F4A7C17, 0xC2B2AE3D27D4EB4F))

DROP, MAIN, FREE = 0, 1, 2
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "canvas", "object", "select")
DROP_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head", "label", "legend"}
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "img", "input", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
          "tt", "u", "var", "wbr"}
NO_STACK = INLINE - {"span"} | VOID | {"p", "li", "dt", "dd", "tr", "td", "th", "option"} | {f"h{i}" for i in range(1, 7)}
BOILER = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisement|adsense|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notice|"
    r"sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|share|sharing|social|related|recommended|"
    r"newsletter|subscribe|subscription|signup|login|popup|modal|widget|copyright|disclaimer|pagination|pager|toolbar|skip-link)(?:$|[^a-z])")
COMMENTS = re.compile(r"(?:^|[^a-z])(?:comments?|commentlist|comment-\w+|replies|reply|respond|disqus)(?:$|[^a-z])")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)"""
    r"""|<(?P<raw>""" + "|".join(RAW) + r""")(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<att>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<att2>[^>]*+)>"""
    r"""|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z"""
    r"""|(?P<text>[^<]++|<)""", re.S | re.I)


def is_boilerplate(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in DROP_TAGS or (tag == "header" and not inside_article):
        return True
    if tag in ("html", "body", "main") or not attributes.strip():
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value.strip() in DROP_ROLES:
            return True
        if name in ("class", "id") and (COMMENTS.search(value) or (tag != "article" and BOILER.search(value))):
            return True
    return False


def page_blocks(html: str) -> list[tuple[str, int]]:
    """(text, region) of the blocks of a page in order; empty blocks are left out.

    Unclosed and crossing tags are tolerated: an end tag closes up to the
    nearest open element of its name and is ignored where there is none.
    Unfinished tags, comments and scripts at the end of the page are markup.
    """
    out: list[tuple[str, int]] = []
    open_: list[tuple[str, int]] = []  # (tag, region inside it)
    part: list[str] = []
    region = FREE
    hidden: str | None = None  # an inline or simple block element that is boilerplate by its class
    depth = 0

    def flush() -> None:
        words = " ".join("".join(part).split())
        if words:
            out.append((words, region))
        part.clear()

    for m in TOKEN.finditer(html):
        if m["text"] is not None:
            if hidden is None:
                part.append(html_lib.unescape(m["text"]))
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        end = m["end"] or m["end2"]
        if tag in NO_STACK:
            if hidden in INLINE:
                if tag == hidden:
                    depth += -1 if end else 1
                    hidden = hidden if depth else None
                continue
            if hidden is not None and tag not in INLINE:
                hidden = None  # the next block starts or this one ends
            elif hidden is not None:
                continue
            if tag not in INLINE:
                flush()
            elif tag in ("br", "wbr", "img"):
                part.append(" ")
            if not end and tag not in VOID and region != DROP and is_boilerplate(tag, m["att"] or m["att2"] or "", region == MAIN):
                hidden, depth = tag, 1
            continue
        hidden = None
        if tag != "span":
            flush()
        if end:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    inner = region
                    del open_[i:]
                    region = open_[-1][1] if open_ else FREE
                    if inner != region and part:
                        region, outer = inner, region
                        flush()
                        region = outer
                    break
        else:
            inner = region
            if region != DROP:
                if is_boilerplate(tag, m["att"] or m["att2"] or "", region == MAIN):
                    inner = DROP
                elif tag in ("article", "main"):
                    inner = MAIN
            if inner != region and part:
                flush()
            open_.append((tag, inner))
            region = inner
    flush()
    return out


def run_counts(streams: list[np.ndarray], run: int = RUN) -> list[np.ndarray]:
    """For every start of every stream, the number of distinct streams that hold the run of ``run`` tokens there."""
    gap = -np.arange(1, len(streams) * run + 1).reshape(len(streams), run)  # ends of streams match nothing
    whole = np.concatenate([x for s, g in zip(streams, gap) for x in (s, g)]) if streams else np.empty(0, int)
    owner = np.repeat(np.arange(len(streams)), [len(s) + run for s in streams])
    rank = np.unique(whole, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < run:  # prefix doubling: rank of the next 2 * width tokens
        after = np.concatenate([rank[width:], np.zeros(width, np.int64)])
        rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1].astype(np.int64)
        width *= 2
    order = np.lexsort((owner, rank))  # the suffix array, to the depth of a run
    r, o = rank[order], owner[order]
    first = np.concatenate(([True], (r[1:] != r[:-1]) | (o[1:] != o[:-1])))
    shared = np.bincount(r[first])[rank]
    out, at = [], 0
    for s in streams:
        out.append(shared[at:at + max(0, len(s) - run + 1)])
        at += len(s) + run
    return out


class Tokens(dict):
    """Token -> its number; ``hashes`` holds their 64-bit hashes by number."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, token: str) -> int:
        import xxhash

        self[token] = at = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")))
        return at

    def stream(self, blocks: list[tuple[str, int]]) -> np.ndarray:
        return np.array([self[w] for t, _ in blocks for w in t.split(" ")], np.int64)

    def names(self, streams: list[np.ndarray]) -> list[np.ndarray]:
        """For every stream, the 128-bit names (starts, 2) of its runs: the same for the same tokens in any shard."""
        value = np.array(self.hashes, np.uint64)
        out = []
        for s in streams:
            h, n = value[s], max(0, len(s) - RUN + 1)
            out.append(np.stack([sum((h[i:i + n] * b[i] for i in range(RUN)), np.zeros(n, np.uint64)) for b in BASES], 1).view(np.int64))
        return out


def packed(blocks: list[tuple[str, int]]) -> bytes:
    return zlib.compress(json.dumps(blocks, ensure_ascii=False).encode("utf-8", "replace"), 6)


def unpacked(raw: bytes) -> list[tuple[str, int]]:
    return [tuple(x) for x in json.loads(zlib.decompress(raw))]


def shard_runs(rows: pd.DataFrame) -> pd.DataFrame:
    """(host, r1, r2, n, shards): runs on enough distinct pages of a shard; a row without a name counts the pages."""
    distinct = rows.drop_duplicates(["k1", "k2"])
    tokens, d, shards = Tokens(), len(distinct), int(rows["shards"].iloc[0])
    streams = [tokens.stream(unpacked(z)) for z in distinct["blocks"]]
    bar = max(FREE_SHARE * d, FREE_PAGES if shards == 1 else 0)
    counts = run_counts(streams)
    names = tokens.names(streams)
    picked = [np.column_stack([r[c >= bar], c[c >= bar]]) for r, c in zip(names, counts)]
    found = pd.DataFrame(np.concatenate(picked), columns=["r1", "r2", "n"]).drop_duplicates(["r1", "r2"]).astype({"r1": "Int64", "r2": "Int64"})
    whole = pd.DataFrame({"r1": pd.array([None], "Int64"), "r2": pd.array([None], "Int64"), "n": [d]})
    return pd.concat([found, whole]).assign(host=rows["host"].iloc[0], shards=shards)[["host", "r1", "r2", "n", "shards"]]


def count_runs(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """(host, r1, r2, n): on how many distinct pages of a shard the wanted runs are."""
    if not len(rows) or not len(wanted):
        return pd.DataFrame({"host": np.array([], object), **{c: np.array([], np.int64) for c in ("r1", "r2", "n")}})
    tokens, look = Tokens(), set(zip(wanted["r1"], wanted["r2"]))
    n: dict = {}
    for z in rows.drop_duplicates(["k1", "k2"])["blocks"]:
        stream = tokens.stream(unpacked(z))
        for key in look.intersection(map(tuple, tokens.names([stream])[0].tolist())):
            n[key] = n.get(key, 0) + 1
    out = pd.DataFrame([(*k, v) for k, v in n.items()], columns=["r1", "r2", "n"]).astype("int64")
    return out.assign(host=rows["host"].iloc[0])[["host", "r1", "r2", "n"]]


def covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Whether a run that starts at one of ``starts`` covers each of n tokens."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + RUN, -1)
    return np.cumsum(edge)[:n] > 0


def main_text(blocks: list[tuple[str, int]], runs: dict[tuple[int, int], bool], tokens: Tokens) -> str:
    """The blocks without the tokens under the runs; a run counts inside articles if its flag says so."""
    if not runs:
        return "\n".join(t for t, _ in blocks)
    stream = tokens.stream(blocks)
    hits = [(i, runs[key]) for i, key in enumerate(map(tuple, tokens.names([stream])[0].tolist())) if key in runs]
    free = covered(np.array([i for i, _ in hits], np.int64), len(stream))
    main = covered(np.array([i for i, m in hits if m], np.int64), len(stream))
    kept, at = [], 0
    for text, region in blocks:
        words = text.split(" ")
        gone = (main if region == MAIN else free)[at:at + len(words)]
        at += len(words)
        if gone.any():
            text = " ".join(w for w, g in zip(words, gone) if not g)
        if text:
            kept.append(text)
    return "\n".join(kept)


def host_runs(doc: DataFrame) -> DataFrame:
    """(host, r1, r2, main): the runs that are boilerplate on a host, from (host, k1, k2, shard, shards, blocks)."""
    pages = doc.select("host", "k1", "k2", "shard", "shards", "blocks")
    named = cut_lineage(pages.groupBy("host", "shard").applyInPandas(shard_runs, "host string, r1 long, r2 long, n long, shards int"))
    size = named.where("r1 is null").groupBy("host").agg(F.sum("n").alias("pages"))
    counts = named.where("r1 is not null and shards = 1").select("host", "r1", "r2", "n")
    wanted = named.where("r1 is not null and shards > 1").groupBy("host", "r1", "r2").agg(F.first("shards").alias("shards"))
    wanted = wanted.select("host", "r1", "r2", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    asked = broadcast_if_small(wanted.select("host").distinct())  # no other page needs a second look
    several = (pages.where("shards > 1").join(asked, "host", "left_semi").groupBy("host", "shard").cogroup(wanted.groupBy("host", "shard"))
               .applyInPandas(count_runs, "host string, r1 long, r2 long, n long"))
    counts = counts.union(several.groupBy("host", "r1", "r2").agg(F.sum("n").alias("n")))
    share = lambda least, part: F.col("n") >= F.greatest(F.lit(float(least)), F.col("pages") * part)
    return counts.join(size, "host").where(share(FREE_PAGES, FREE_SHARE)).select("host", "r1", "r2", share(MAIN_PAGES, MAIN_SHARE).alias("main"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages`` (page_id, url, html).

    Null or empty html gives the empty text. A null or malformed url belongs to
    the empty host. Repeated rows give equal rows and count as one page. Other
    columns are ignored; an empty table gives an empty table. Nothing is cut or
    capped.
    """
    doc = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), url_host(F.col("url")).alias("host"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def parse(batches):  # the compressed blocks of a page travel, not its html
        import xxhash

        for b in batches:
            blocks = [[(t, r) for t, r in page_blocks(h) if r != DROP] for h in b.pop("html")]
            keys = [xxhash.xxh3_128_intdigest("\n".join(t for t, _ in x).encode("utf-8", "replace")) for x in blocks]
            b["k1"] = np.array([k & (2**64 - 1) for k in keys], np.uint64).view(np.int64)
            b["k2"] = np.array([k >> 64 for k in keys], np.uint64).view(np.int64)
            b["blocks"] = [packed(x) for x in blocks]
            b["fresh"] = ~b.duplicated(["host", "k1", "k2"])
            yield b

    doc = cut_lineage(doc.mapInPandas(parse, f"page_id {kind}, url string, host string, k1 long, k2 long, blocks binary, fresh boolean"))
    sizes = doc.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.octet_length("blocks")).alias("b"))
    shards = sizes.select("host", F.greatest(F.ceil(F.col("n") / SHARD_PAGES), F.ceil(F.col("b") / SHARD_BYTES)).cast("int").alias("g")).where("g > 1")
    # one of the copies within a batch is enough for the counts; the others would only be dropped after the shuffle
    dealt = doc.where("fresh").join(broadcast_if_small(shards), "host", "left").withColumn("shards", F.coalesce("g", F.lit(1)))
    shard = F.pmod(F.xxhash64("k1", "k2"), F.col("shards").cast("long")).cast("int").alias("shard")
    runs = cut_lineage(host_runs(dealt.select("host", "k1", "k2", shard, "shards", "blocks")))

    each = doc.select("page_id", "url", "host", "blocks")
    found = runs.groupBy("host").agg(F.collect_list("r1").alias("r1"), F.collect_list("r2").alias("r2"), F.collect_list("main").alias("main"))
    each = each.join(F.broadcast(found) if runs.count() <= BROADCAST_MAX_ROWS else found, "host", "left").drop("host")

    def extract(batches):
        for b in batches:
            known: dict = {}  # the runs of a host come with each of its pages, and are read once
            texts, tokens = [], Tokens()
            for z, r1, r2, main in zip(b["blocks"], b["r1"], b["r2"], b["main"]):
                key = b"" if r1 is None else r1.tobytes()
                if key not in known:
                    known[key] = {} if r1 is None else dict(zip(zip(r1.tolist(), r2.tolist()), main))
                texts.append(main_text(unpacked(z), known[key], tokens))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return each.mapInPandas(extract, f"page_id {kind}, url string, text string, n_chars long")


def op6_host_suffix_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page and its length in code points."""
    return extract_main_text(table(spark, sf_dir, "pages"))
