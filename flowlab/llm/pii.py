"""Personal data: regular expressions propose spans, validators confirm them, context words adjust a score.

Everything is DataFrame expressions on one row; there is no shuffle. Spans are
code-point offsets. Positions come from splitting a text by the same pattern
that extracts the matches: a match starts after the gaps and matches in front
of it.

Matches are handled in groups of ``GROUP``: arrays only grow within a group, and
a group cuts its stretch of the text out once, so the work grows in proportion
to the text and its matches.

The patterns are written so that the regex engine neither backtracks nor
recurses on long runs: a run is only entered at its first character or right
after the previous match (``\\G``), and repeats are possessive. Both leave the
matches as they are, since every start inside a run succeeds or fails together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm.common import ascii_lower, table


@dataclass(frozen=True)
class Kind:
    """A proposal pattern with its prior score and the words that raise the score when they are near."""

    name: str
    pattern: str
    needs: str  # a cheap necessary condition on the text
    base: bool  # base kinds stay whatever their score
    score: float
    context: tuple[str, ...] = ()


# Kinds in the order in which spans at one start are listed.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.9),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", True, 0.6, ("ip", "address", "host", "server")),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9][0-9\x20-]{9}", True, 0.8, ("card", "visa", "credit", "karte", "carte", "tarjeta")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", True, 0.7, ("phone", "tel", "call", "mobile", "fax")),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", "[A-Z]{2}[0-9]{2}", False, 0.8,
         ("iban", "account", "bank", "konto", "cuenta", "compte")),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]{3}-[0-9]{2}-[0-9]{4}", False, 0.3,
         ("ssn", "social", "security")),
)
BASE = tuple(k.name for k in KINDS if k.base)
THRESHOLD = 0.5  # spans of added kinds below this score are dropped
CONTEXT_CHARS = 40  # characters on each side that are searched for context words
CONTEXT_GAIN = 0.3
GROUP = 64
# Every start of an IBAN: one character is matched, so no start is swallowed by the run before it. The look-ahead
# takes the run behind the start, one character more than any IBAN has, so that its right boundary shows.
IBAN_START = r"[A-Z](?=[A-Z][0-9]{2}(?:\x20?[A-Z0-9]){11})"
IBAN_RUN = r"(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,31}+))[A-Z]"
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE IM GG JE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}  # characters without spaces; other countries: any of 15 to 34


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True for a digit string whose Luhn sum is a multiple of ten (every second digit from the right doubled)."""
    back = F.split(F.reverse(number), "")
    total = F.aggregate(
        F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1))),
        F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97(s: Column) -> Column:
    """True for an IBAN whose rearranged number leaves 1 modulo 97 (letters count 10 to 35)."""
    bare = F.replace(s, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4)), "")
    rest = F.aggregate(turned, F.lit(0), lambda a, c: F.when(F.ascii(c) <= 57, (a * 10 + F.ascii(c) - 48) % 97)
                       .otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return rest == 1


def valid(kind: str, m: Column) -> Column:
    """Whether a proposed match passes its validator."""
    if kind == "ip":
        def part(p: Column) -> Column:
            short = F.ltrim(p, F.lit("0"))
            return F.when(F.length(short) > 3, False).when(F.length(short) == 0, True).otherwise(short.cast("int") <= 255)
        return F.forall(F.split(m, r"\."), part)
    if kind == "card":
        n = digits(m)
        return F.when(F.length(n).between(12, 19), luhn(n)).otherwise(False)
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    if kind == "ssn":
        return ~m.rlike("^(000|666|9)") & ~m.rlike("-00-|-0000$")
    return F.lit(True)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def iban_prefix(run: Column) -> Column:
    """The longest prefix of a run that is an IBAN: of its country's length, right modulo 97 and not within a longer word; else null."""
    def cut(n: int) -> Column:
        return F.regexp_extract(run, f"^((?:[A-Z0-9]\\x20?){{{n - 1}}}[A-Z0-9])(?![A-Z0-9])", 1)

    def checked(n: int) -> Column:
        return let(cut(n), lambda x: F.when((x != "") & mod97(x), x))

    out = F.coalesce(*[checked(n) for n in range(34, 14, -1)])
    for n, countries in IBAN_LENGTHS.items():
        out = F.when(F.substring(run, 1, 2).isin(countries.split()), checked(n)).otherwise(out)
    return out


SPANS = "array<struct<start:int,end:int,value:string>>"


def grouped(items: Column, size: int = GROUP) -> Column:
    """The array cut into arrays of ``size``; empty for an empty one."""
    n = F.size(items)
    first = F.when(n > 0, F.sequence(F.lit(0), F.call_function("div", n - 1, F.lit(size)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(first, lambda c: F.slice(items, c * size + 1, F.lit(size)))


def walked(steps: Column, keep) -> Column:
    """Spans of the steps (gap, value) whose value ``keep`` accepts: a span starts after all gaps and values before it."""
    empty = F.array().cast(SPANS)
    begin = F.struct(F.lit(0).alias("end"), empty.alias("spans"))

    def step(a: Column, s: Column) -> Column:
        start, end = a["end"] + s["gap"], a["end"] + s["gap"] + F.length(s["value"])
        span = F.struct(start.alias("start"), end.alias("end"), s["value"].alias("value"))
        return F.struct(end.alias("end"), F.when(keep(s["value"]), F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    def moved(part: Column, at: Column) -> Column:
        return F.transform(part["spans"], lambda x: F.struct(
            (x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["value"].alias("value")))

    def whole(parts: Column) -> Column:
        before = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda a, p: F.struct(
            (a["at"] + p["end"]).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))["all"]
        return F.flatten(F.zip_with(parts, before, moved))

    return let(steps, lambda all_: let(F.transform(grouped(all_), lambda part: F.aggregate(part, begin, step)), whole))


def steps_of(text: Column, pattern: str, hits: Column) -> Column:
    """array<struct(gap, value)>: every hit of the pattern with the length of the gap before it."""
    return let(hits, lambda h: F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(h)), h, lambda g, m: F.struct(
        F.length(g).alias("gap"), m.alias("value"))))


def ibans(text: Column) -> Column:
    """array<struct(start, end, value)> of the leftmost, non-overlapping IBANs; every start is tried."""
    runs = F.regexp_extract_all(text, F.lit(IBAN_RUN), F.lit(1))
    # a start is one character; its run travels along and is cut to the IBAN
    steps = let(runs, lambda r: F.zip_with(F.slice(F.split(text, IBAN_START, -1), F.lit(1), F.size(r)), r, lambda g, x: F.struct(
        F.length(g).alias("gap"), iban_prefix(x).alias("value"))))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(a: Column, s: Column) -> Column:
        start = a["at"] + s["gap"]
        span = F.struct(start.alias("start"), (start + F.length(s["value"])).alias("end"), s["value"].alias("value"))
        return F.struct((start + 1).alias("at"), F.when(s["value"].isNotNull(), F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    def moved(part: Column, at: Column) -> Column:
        return F.transform(part["spans"], lambda x: F.struct(
            (x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["value"].alias("value")))

    def whole(parts: Column) -> Column:
        before = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda a, p: F.struct(
            (a["at"] + p["at"]).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))["all"]
        return F.flatten(F.zip_with(parts, before, moved))

    found = let(steps, lambda all_: let(F.transform(grouped(all_), lambda part: F.aggregate(part, begin, step)), whole))
    return let(found, lambda f: fenced(f, F.lit(0), lambda x, end: x["start"] >= end, SPANS))


def fenced(spans: Column, first: Column, keep, kind: str) -> Column:
    """The spans, by start, that ``keep`` accepts given the end of what was kept before them."""
    def step(a: Column, x: Column) -> Column:
        return F.when(keep(x, a["end"]), F.struct(F.greatest(a["end"], x["end"]).alias("end"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)

    def run(a: Column, part: Column) -> Column:  # the kept spans of a group grow within it, then join the whole
        return let(F.aggregate(part, F.struct(a["end"].alias("end"), F.array().cast(kind).alias("kept")), step), lambda g: F.struct(
            g["end"].alias("end"), F.concat(a["kept"], F.array(g["kept"])).alias("kept")))

    begin = F.struct(first.alias("end"), F.array().cast(f"array<{kind}>").alias("kept"))
    return F.flatten(F.aggregate(grouped(spans), begin, run)["kept"])


def proposals(text: Column, kind: Kind) -> Column:
    """array<struct(start, end, value)> of the valid, leftmost, non-overlapping matches of one kind."""
    if kind.name == "iban":
        found = ibans(text)
    else:
        found = walked(steps_of(text, kind.pattern, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))), lambda m: valid(kind.name, m))
    return F.when(text.rlike(kind.needs), found).otherwise(F.array().cast(SPANS))


def context_pattern(kind: Kind) -> str:
    return rf"(?:^|[^a-z0-9])(?:{'|'.join(kind.context)})(?:$|[^a-z0-9])"


def score(text: Column, kind: Kind, start: Column, end: Column) -> Column:
    """Prior of the kind, raised when a context word stands within ``CONTEXT_CHARS`` of the span, in [0, 1]."""
    if not kind.context:
        return F.lit(kind.score)
    lo = F.greatest(start - CONTEXT_CHARS, F.lit(0))
    near = ascii_lower(F.concat_ws(" ", F.substr(text, lo + 1, start - lo), F.substr(text, end + 1, F.lit(CONTEXT_CHARS))))
    return F.lit(kind.score) + F.when(near.rlike(context_pattern(kind)), CONTEXT_GAIN).otherwise(0.0)


def scored(text: Column, kind: Kind, order: int, found: Column) -> Column:
    """array<struct(start, order, end, kind, score)> of spans; a group of them looks at one stretch of the text."""
    def one(stretch: Column, lo: Column, x: Column) -> Column:
        value = F.least(score(stretch, kind, x["start"] - lo, x["end"] - lo), F.lit(1.0))
        return F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind.name).alias("kind"), value.alias("score"))

    def part(group: Column) -> Column:
        lo = F.greatest(F.get(group, F.lit(0))["start"] - CONTEXT_CHARS, F.lit(0))
        hi = F.get(group, F.size(group) - 1)["end"] + CONTEXT_CHARS
        cut = F.struct(lo.alias("lo"), (F.substr(text, lo + 1, hi - lo) if kind.context else F.lit("")).alias("text"))
        return let(cut, lambda c: F.transform(group, lambda x: one(c["text"], c["lo"], x)))

    return let(found, lambda all_: F.flatten(F.transform(grouped(all_), part)))


def spans(text: Column) -> Column:
    """All accepted spans of a (non-null) text: array<struct(start, order, end, kind, score)>, by start, then kind as listed."""
    def of(order: int, kind: Kind) -> Column:
        found = scored(text, kind, order, proposals(text, kind))
        return found if kind.base else F.filter(found, lambda s: s["score"] >= THRESHOLD)

    return F.array_sort(F.concat(*[of(i, k) for i, k in enumerate(KINDS)]))


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii_spans") -> DataFrame:
    """Adds the span array ``out`` to every row.

    A null text is the empty text and has no spans; nothing is capped or
    shortened. Other columns stay as they are, whatever their names (a column
    named like ``out`` is replaced). Repeated rows and empty tables need no care.
    """
    return docs.withColumn(out, spans(F.coalesce(F.col(text_col), F.lit(""))))


def mask(text: Column, found: Column) -> Column:
    """Text with every span replaced by ``<KIND>``; overlapping spans become one mark, of the first of them."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def group(a: Column, part: Column) -> Column:
        last = F.aggregate(part, a["at"], lambda m, s: F.greatest(m, s["end"]))
        stretch = F.struct(a["at"].alias("lo"), last.alias("hi"), F.substr(text, a["at"] + 1, last - a["at"]).alias("text"))

        def inside(c: Column) -> Column:
            done = F.aggregate(part, F.struct(c["lo"].alias("at"), F.lit("").alias("out")), lambda b, s: F.struct(
                F.greatest(b["at"], s["end"]).alias("at"),
                F.when(s["start"] >= b["at"], F.concat(b["out"], F.substr(c["text"], b["at"] - c["lo"] + 1, s["start"] - b["at"]),
                                                       F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(b["out"]).alias("out")))
            return F.struct(c["hi"].alias("at"), F.concat(a["out"], F.array(done["out"])).alias("out"))

        return let(stretch, inside)

    done = F.aggregate(grouped(found), begin, group)
    whole = let(done, lambda d: F.concat(F.array_join(d["out"], ""), F.substr(text, d["at"] + 1, F.length(text))))
    return F.when(F.size(found) == 0, text).otherwise(whole)


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows with their personal data masked in place; columns and rows stay as they are, null texts stay null."""
    tmp = "__pii_spans"
    return find_pii(docs, text_col, tmp).withColumn(text_col, mask(F.col(text_col), F.col(tmp))).drop(tmp)


def digest(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans, for every document."""
    docs = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii_spans")
    s = F.col("pii_spans")
    base = F.filter(s, lambda x: x["order"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return docs.select("doc_id", *[count(k) for k in BASE], F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(s).alias("spans"))
