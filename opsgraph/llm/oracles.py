"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from opsgraph.llm.secret_scan import BASE, RULES
from opsgraph.llm.url_filter import RULES as URL_RULES

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win
), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, grams.n, i, item_id FROM grams JOIN win USING (n, phrase)
), covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""


def op8() -> str:
    """All rules one after another: splitting at the expression gives the gaps between its matches."""
    parts = []
    for number, (kind, (pattern, group, least)) in enumerate(RULES.items()):
        p = pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {number} AS k, '{kind}' AS kind, a, a + length(m[i]) AS z FROM ("
            f"SELECT doc_id, m, g, i, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a FROM ("
            f"SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS g, string_split_regex(t, '{p}') AS s, unnest(range(1, len(m) + 1)) AS i FROM d)) "
            f"WHERE length(g[i]) >= {least}"
        )
    listed = "string_agg(kind || ':' || a::BIGINT || ':' || z::BIGINT, ',' ORDER BY a, k)"
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (" + " UNION ALL ".join(parts) + f"), g AS (SELECT doc_id, {counts}, {listed} FILTER (kind IN ({base})) AS base, {listed} AS spans FROM f GROUP BY doc_id) "
        "SELECT doc_id, " + ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE) + ", sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"
    )


def op9() -> str:
    """Aliases by recursion from every url that an edge names."""
    rules = sorted(URL_RULES, key=lambda r: -len(r[1]))

    def fit(host: str, path: str, at: int) -> str:
        cases = " ".join(f"WHEN ({host} = '{r[1].partition('/')[0]}' OR ends_with({host}, '.{r[1].partition('/')[0]}')) AND starts_with({path}, '/{r[1].partition('/')[2]}') THEN '{r[at]}'" for r in rules)
        return f"CASE {cases} END"

    rest = lambda u: f"CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"
    host = lambda u: f"coalesce({LOWER.format(f"regexp_extract({rest(u)}, '^[^/?#]*')")}, '')"
    alias = lambda u: f"CASE WHEN instr({u}, '://') > 0 THEN {host(u)} || regexp_extract({rest(u)}, '^[^/?#]*([^#]*)', 1) END"
    link = lambda t: f"CASE WHEN instr({t}, '://') > 0 THEN {alias(t)} WHEN starts_with({t}, '//') THEN {alias(f"('x:' || {t})")} WHEN starts_with({t}, '/') THEN host || regexp_extract({t}, '^[^#]*') END"
    tag = lambda e: rf"regexp_extract(coalesce(html, ''), '(?is){e}', 0)"
    canonical, refresh = tag(r"<link\b[^>]*\brel\s*=\s*[\"'']?canonical\b[^>]*>"), tag(r"<meta\b[^>]*\bhttp-equiv\s*=\s*[\"'']?refresh\b[^>]*>")
    word = r"\s*=\s*[\"'']?([^\"''\s>]+)"
    return rf"""
WITH RECURSIVE p AS (
  SELECT page_id, url, {host("url")} AS host, coalesce(regexp_extract({rest("url")}, '^[^/?#]*([^?#]*)', 1), '') AS path, {alias("url")} AS alias,
    regexp_extract({canonical}, '(?is)\bhref{word}', 1) AS c, regexp_extract({refresh}, '(?is)\burl{word}', 1) AS r FROM pages
), e AS (
  SELECT alias AS a, {link("c")} AS b FROM p UNION SELECT alias, {link("r")} FROM p
), arcs AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b
), reach(a, b) AS (SELECT a, a FROM arcs UNION SELECT reach.a, arcs.b FROM reach JOIN arcs ON reach.b = arcs.a
), met AS (
  SELECT a, bool_or(d = 'allow') AS allowed, bool_or(d = 'block') AS blocked
  FROM (SELECT a, {fit("regexp_extract(b, '^[^/?#]*')", "regexp_extract(b, '^[^/?#]*([^?#]*)', 1)", 0)} AS d FROM reach) GROUP BY a
)
SELECT page_id, host, path, {fit("host", "path", 1)} AS rule,
  coalesce({fit("host", "path", 0)}, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN met ON p.alias = met.a
"""


OP10 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least_ AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_ ON least_.a = d.doc_id
"""

OP11 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS t(i)
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>') AS shown,
    replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\:') AS name
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ') + length(name) + length(': ') + length(shown) + length('</turn>') + 1)::BIGINT AS formatted_chars, true AS mask_agrees
FROM e GROUP BY conv_id
"""


def op13() -> str:
    """Three assignments and two updates over all parts, plainly; lists stand for parts."""
    steps = []
    for r in range(3):
        dist = "list_sum(list_transform(list_zip(q.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT"
        steps.append(f"a{r} AS MATERIALIZED (SELECT q.row, q.p, min((d, e)) AS best FROM (SELECT q.row, q.p, b.e, {dist} AS d FROM q JOIN b{r} b ON q.p = b.p) q GROUP BY ALL)")
        if r < 2:
            means = f"SELECT q.p, a.best[2] AS e, i, floor(sum(q.v[i])::DOUBLE / count(*))::BIGINT AS m FROM q JOIN a{r} a ON q.row = a.row AND q.p = a.p, range(1, 1 + len(q.v)) AS t(i) GROUP BY ALL"
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM b{r} b LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS v FROM ({means}) GROUP BY ALL) n ON n.p = b.p AND n.e = b.e)")
    chain = ",\n".join(steps).replace("min((d, e))", "min([d, e])")
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS MATERIALIZED (SELECT row, p, x[1 + p * len(x) // 16 : (p + 1) * len(x) // 16] AS v FROM k, range(16) AS t(p)
), b0 AS MATERIALIZED (SELECT p, row - 1 AS e, v FROM q WHERE row <= 64),
{chain}, s AS (
  SELECT row, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM a2 GROUP BY row
), h AS (
  SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM b2)
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN s USING (row), h
"""


ORACLE_SQL = {"op1_decontaminate": OP1, "op3_exact_dedup": OP3, "op8_secret_scan": op8(), "op9_url_filter": op9(), "op10_jaccard_join": OP10, "op11_chat_format": OP11, "op13_vector_codes": op13()}
