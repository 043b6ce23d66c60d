"""DuckDB twins of the training-data queries that SQL can express.

Not here: the classifiers (trained models), the SimHash queries (XXH64 has no
DuckDB form) and the html extraction; tests hold those against brute force,
held-out labels or known texts.
"""

from __future__ import annotations

from flowlab.llm import conversation_trie, mixing, pii, pivot_topk, substring_dedup, url_filter

SPACE_CLASS = r"[^\x20\x09-\x0D]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_sql() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r), r))
    cases = []
    for r in rules:
        name, slash, rest = r.partition("/")
        cases.append(f"WHEN (host = {quoted(name)} OR ends_with(host, {quoted('.' + name)})) AND starts_with(path, {quoted(slash + rest)}) THEN {quoted(r)}")
    verdicts = " ".join(f"WHEN {quoted(r)} THEN {quoted(v)}" for r, v in url_filter.RULES.items())
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda u: f"coalesce({low(f'regexp_extract({u}, {HOST}, 1)')}, '')"
    HOST = quoted(r"(?s)^.*?://([^/?#]*)")
    steps = "".join(f""",
r{k + 1} AS MATERIALIZED (SELECT host, way, sum(s) AS s FROM (
  SELECT w.dst AS host, w.way, r.s * w.p * {url_filter.DAMPING} AS s FROM r{k} r JOIN walk w ON w.way = r.way AND w.src = r.host
  UNION ALL SELECT host, way, s FROM r0) GROUP BY host, way)""" for k in range(url_filter.STEPS))
    return f"""
WITH u AS MATERIALIZED (SELECT page_id, {host('url')} AS host, coalesce(regexp_extract(url, {quoted('(?s)^.*?://[^/?#]*([^?#]*)')}, 1), '') AS path FROM pages),
j AS MATERIALIZED (SELECT *, CASE {' '.join(cases)} END AS rule FROM u),
k AS MATERIALIZED (SELECT *, CASE rule {verdicts} END AS ruled FROM j),
links AS (SELECT {host('url')} AS src, unnest(regexp_extract_all(coalesce(html, ''), {quoted(url_filter.LINK)}, 1)) AS link FROM pages),
whole AS (SELECT src, CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END AS link FROM links),
ends AS (SELECT src, {host("link")} AS dst, coalesce(regexp_extract(link, {quoted('(?s)^.*?://[^/?#]*([^?#]*)')}, 1), '') AS path FROM whole),
f AS MATERIALIZED (SELECT * FROM ends WHERE src <> '' AND dst <> '' AND src <> dst),
e AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM f GROUP BY src, dst),
t AS (SELECT host, CASE rule {verdicts} END AS ruled FROM (SELECT host, path, CASE {' '.join(cases)} END AS rule FROM (SELECT DISTINCT dst AS host, path FROM f))),
ways AS (SELECT 'trust' AS way, src, dst, n FROM e UNION ALL SELECT 'distrust', dst, src, n FROM e),
walk AS MATERIALIZED (SELECT way, src, dst, n / sum(n) OVER (PARTITION BY way, src) AS p FROM ways),
known AS (SELECT host, ruled FROM k WHERE host <> '' UNION ALL SELECT host, ruled FROM t WHERE host NOT IN (SELECT host FROM k)),
seeds AS (SELECT host, count(*) FILTER (WHERE ruled = 'allow') >= {url_filter.SEED_SHARE} * count(*) AS t,
                 count(*) FILTER (WHERE ruled = 'block') >= {url_filter.SEED_SHARE} * count(*) AS d FROM known GROUP BY host),
r0 AS MATERIALIZED (SELECT host, 'trust' AS way, 1.0::DOUBLE AS s FROM seeds WHERE t UNION ALL SELECT host, 'distrust', 1.0::DOUBLE FROM seeds WHERE d){steps},
s AS (SELECT host, sum(CASE WHEN way = 'trust' THEN s ELSE 0 END) AS t, sum(CASE WHEN way = 'distrust' THEN s ELSE 0 END) AS d FROM r{url_filter.STEPS} GROUP BY host)
SELECT page_id, k.host, path, rule,
  coalesce(ruled, CASE WHEN coalesce(d, 0) > {url_filter.BLOCK_RATIO} * (coalesce(t, 0) + coalesce(d, 0)) THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(t, 0), 9) AS trust, round(coalesce(d, 0), 9) AS distrust
FROM k LEFT JOIN s ON s.host = k.host"""


def schedule_sql(knots: tuple) -> str:
    """Inverse of one integrated schedule at ``done``."""
    area, total = [], 0.0
    for (t0, a), (t1, b) in zip(knots, knots[1:]):
        area.append((total, t0, t1, a, b))
        total += (a + b) / 2 * (t1 - t0)
    out = ""
    for at, t0, t1, a, b in area:
        slope = (b - a) / (t1 - t0)
        rest = f"greatest(done * {total!r}::DOUBLE - {at!r}::DOUBLE, 0.0::DOUBLE)"
        x = f"2 * {rest} / ({a!r}::DOUBLE + sqrt(greatest({a * a!r}::DOUBLE + {2 * slope!r}::DOUBLE * {rest}, 0.0::DOUBLE)))"
        piece = f"{t0!r}::DOUBLE + least({x}, {t1 - t0!r}::DOUBLE)"
        out = piece if not out else f"CASE WHEN done * {total!r}::DOUBLE > {at!r}::DOUBLE THEN {piece} ELSE {out} END"
    return out


def mix_sql() -> str:
    cap = mixing.MAX_EPOCHS
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
    times = " ".join(f"WHEN {i} THEN {schedule_sql(k)}" for i, k in enumerate(mixing.SCHEDULES))
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {quoted(SPACE_CLASS)}))::BIGINT AS size,
    md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS draw FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM g),
w AS (SELECT *, CASE rank % {len(mixing.WEIGHTS)} {weights} END::BIGINT AS weight, source_size * {cap} AS cap FROM k),
b AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS share
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap::DOUBLE < share * weight AS capped FROM b),
l AS (SELECT share AS level FROM c WHERE NOT capped ORDER BY cap::DOUBLE / weight, rank LIMIT 1),
t AS (SELECT source, source_size, rank, CASE WHEN capped THEN cap::DOUBLE ELSE (SELECT level FROM l) * weight END AS target FROM c),
p AS (SELECT d.*, t.source_size, t.target, t.rank, least(round(t.target)::BIGINT, t.source_size * {cap}) AS want,
    (sum(size) OVER (PARTITION BY d.source ORDER BY draw, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN want // source_size ELSE 0 END AS epochs FROM p),
f AS (SELECT *, epochs * size + least(greatest(want - epochs * source_size - start, 0), size) AS taken FROM e),
h AS (SELECT *, CASE WHEN taken > 0 THEN least(start::DOUBLE / want::DOUBLE, 1.0::DOUBLE) END AS done FROM f)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(CASE rank % {len(mixing.SCHEDULES)} {times} END, 9) END AS position FROM h"""


def pii_sql() -> str:
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+"}
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(range(1, length({digits}) + 1), lambda i:
      CASE WHEN i % 2 = 1 THEN substr(reverse({digits}), i, 1)::INT
           ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][substr(reverse({digits}), i, 1)::INT + 1] END)) % 10 = 0"""
    valid = {
        "email": "true",
        "ip": r"len(list_filter(string_split(value, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (length(ltrim(x, '0')) > 0 AND TRY_CAST(ltrim(x, '0') AS INT) > 255))) = 0",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "ssn": "NOT regexp_matches(value, '^(000|666|9)') AND NOT regexp_matches(value, '-00-|-0000$')",
    }
    def checked(x: str) -> str:
        bare = f"replace({x}, ' ', '')"
        turned = f"(substr({bare}, 5) || substr({bare}, 1, 4))"
        return f"""{x} <> '' AND list_reduce(list_prepend(0, list_transform(range(1, length({turned}) + 1), lambda i: ascii(substr({turned}, i, 1)))),
          lambda a, c: CASE WHEN c <= 57 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1"""

    sizes = " ".join(f"WHEN substr(run, 1, 2) IN ({', '.join(map(quoted, names.split()))}) THEN [{n}]" for n, names in pii.IBAN_LENGTHS.items())
    head = quoted("[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11}")
    # every start is tried, the longest right length is taken, and starts within an IBAN taken before are passed over
    ibans = f"""
SELECT row, text, start, stop FROM (
  SELECT row, text, unnest(list_reduce(list_transform(list_sort(list({{'start': start, 'stop': start + length(value)}})), lambda x: {{'stop': x.stop, 'kept': [x]}}),
    lambda a, x: CASE WHEN x.kept[1].start >= a.stop THEN {{'stop': x.stop, 'kept': list_concat(a.kept, x.kept)}} ELSE a END).kept, recursive := true)
  FROM (SELECT row, text, start, list_filter(list_transform(sizes, lambda n: regexp_extract(run, '^((?:[A-Z0-9] ?){{' || (n - 1) || '}}[A-Z0-9])(?:[^A-Z0-9]|$)', 1)),
                                        lambda x: {checked('x')})[1] AS value
        FROM (SELECT *, CASE {sizes} ELSE range(34, 14, -1) END AS sizes FROM (
          SELECT row, text, i - 1 AS start, substr(text, i, 72) AS run FROM (
            SELECT row, text, unnest(range(1, length(text) + 1)) AS i FROM d WHERE regexp_matches(text, {head}))
          WHERE regexp_matches(substr(text, i, 72), '^' || {head}))))
  WHERE value IS NOT NULL GROUP BY row, text)"""
    parts = []
    for order, kind in enumerate(pii.KINDS):
        pattern = quoted(plain.get(kind.name, kind.pattern))
        c = pii.CONTEXT_CHARS
        near = f"""translate(substr(text, greatest(start - {c}, 0) + 1, start - greatest(start - {c}, 0)) || ' ' || substr(text, stop + 1, {c}),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""
        enough = "true" if kind.base else (
            f"{kind.score} + CASE WHEN regexp_matches({near}, {quoted(pii.context_pattern(kind))}) THEN {pii.CONTEXT_GAIN} ELSE 0 END >= {pii.THRESHOLD}")
        if kind.name == "iban":
            parts.append(f"\nSELECT row, {order} AS k, '{kind.name}' AS kind, start, stop FROM ({ibans}) WHERE {enough}")
            continue
        parts.append(f"""
SELECT row, {order} AS k, '{kind.name}' AS kind, start, stop FROM (
  SELECT row, text, value, stop - length(value) AS start, stop FROM (
    SELECT row, text, value, (sum(length(gap) + length(value)) OVER (PARTITION BY row ORDER BY i))::BIGINT AS stop FROM (
      SELECT row, text, unnest(hits) AS value, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM (
        SELECT row, text, regexp_extract_all(text, {pattern}) AS hits, string_split_regex(text, {pattern}) AS gaps FROM d
        WHERE regexp_matches(text, {pattern})))))
WHERE {valid[kind.name]} AND {enough}""")
    name = "kind || ':' || start || ':' || stop"
    base = len(pii.BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in pii.BASE)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
s AS MATERIALIZED ({' UNION ALL '.join(parts)}),
a AS (SELECT row, {counts}, string_agg({name}, ',' ORDER BY start, k) FILTER (WHERE k < {base}) AS base,
      string_agg({name}, ',' ORDER BY start, k) AS spans FROM s GROUP BY row)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0)::BIGINT AS n_{k}' for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (row)"""


def topk_sql() -> str:
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({pivot_topk.SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c
  ON q.vec_id % {pivot_topk.EVERY} = 0 AND c.row <> q.row AND len(c.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= {pivot_topk.K}"""


def trie_sql() -> str:
    # crc32 of the decimal id, bit by bit: an entry of 0 or more is a byte to mix in, -1 is a shift
    steps = "flatten(list_transform(range(1, length(x) + 1), lambda i: list_concat([ascii(substr(x, i, 1))::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))"
    crc = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {steps}),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""
    return f"""
WITH r AS MATERIALIZED (SELECT c, t, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, t) - 1 AS pos FROM (
  SELECT conv_id AS c, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
    len(regexp_extract_all(coalesce(text, ''), {quoted(SPACE_CLASS)})) AS w FROM conversations WHERE conv_id IS NOT NULL)),
s AS (SELECT c, count(*) AS size, c::VARCHAR AS x FROM r GROUP BY c),
v AS MATERIALIZED (SELECT s.c, s.c - s.c % {conversation_trie.GROUP} AS b, size, {crc} % {conversation_trie.HEAD} AS h FROM s),
k AS MATERIALIZED (SELECT v.*, least(v.h, coalesce(o.size, 0)) AS k FROM v LEFT JOIN s o ON o.c = v.b),
a AS MATERIALIZED (SELECT k.c, pos + 1 AS d, t, w FROM k JOIN r ON r.c = k.b AND pos < k UNION ALL
  SELECT k.c, k + pos - h + 1, t, w FROM k JOIN r ON r.c = k.c AND pos >= h),
p AS MATERIALIZED (SELECT c, d, w, md5(string_agg(t, ',') OVER (PARTITION BY c ORDER BY d)) AS p FROM a UNION ALL SELECT c, 0, 0, 'root' FROM k),
q AS MATERIALIZED (SELECT *, lag(p) OVER (PARTITION BY c ORDER BY d) AS q, d = max(d) OVER (PARTITION BY c) AS last FROM p),
n AS MATERIALIZED (SELECT p, min(c) AS c, any_value(d) AS d, any_value(w) AS w, any_value(q) AS q, count(*) AS n,
  coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '') AS ends FROM q GROUP BY p),
u AS MATERIALIZED (SELECT n.*, coalesce(m, 0) AS m FROM n LEFT JOIN (SELECT q, count(*) AS m FROM n WHERE q IS NOT NULL GROUP BY q) z ON z.q = n.p),
g AS (SELECT q.p, sum(coalesce((m = 0)::BIGINT, 0)) OVER o AS leaves, sum(coalesce((n - 1) * u.w, 0)) OVER o AS saved
  FROM q LEFT JOIN u ON u.c = q.c AND u.d = q.d WINDOW o AS (PARTITION BY q.c ORDER BY q.d DESC)),
t AS (SELECT p, sum(leaves) AS leaves, sum(saved) AS saved FROM g GROUP BY p)
SELECT u.c AS conv_id, u.d AS depth, o.c AS parent_conv_id, u.n AS n_convs, u.m AS n_children, t.leaves::BIGINT AS n_leaves,
  t.saved::BIGINT AS saved_tokens, sha256(u.ends) AS ends_sha256
FROM u JOIN t USING (p) LEFT JOIN n o ON o.p = u.q"""


def substring_sql() -> str:
    n = substring_dedup.WINDOW
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), {quoted(SPACE_CLASS)}) AS w FROM documents),
v AS MATERIALIZED (SELECT row, coalesce(doc_id, {substring_dedup.LAST}) AS o, i AS s, md5(array_to_string(list_slice(w, i, i + {n - 1}), ' ')) AS h
  FROM (SELECT *, unnest(generate_series(1, len(w) - {n - 1})) AS i FROM d)),
f AS MATERIALIZED (SELECT h, min(o) AS first FROM v GROUP BY h),
g AS MATERIALIZED (SELECT row, s, first < o AS gone FROM v JOIN f USING (h)),
x AS (SELECT row, doc_id, i, w[i] AS word FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM d)),
y AS (SELECT x.*, coalesce(bool_or(g.gone) OVER (PARTITION BY x.row ORDER BY x.i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), false) AS out
  FROM x LEFT JOIN g ON g.row = x.row AND g.s = x.i),
z AS (SELECT row, count(*) FILTER (WHERE out) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT out) AS kept FROM y GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN z USING (row)"""


ORACLE = {
    "op1_url_filter": url_sql(),
    "op4_mixing": mix_sql(),
    "op9_pii": pii_sql(),
    "op10_pivot_topk": topk_sql(),
    "op12_conversation_trie": trie_sql(),
    "op13_substring_dedup": substring_sql(),
}
