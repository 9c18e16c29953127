"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from strandline.llm import url_trust
from strandline.llm.quality_rules import LEAST_ROWS, LEAST_WORDS, RATIOS, REPEATED_PERCENT, SPREAD

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i+n-1), ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i+n-1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i+n)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(items, '') AS items
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)"""

NEAR_DUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i+4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w)-4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, b.y FROM reach r JOIN sides b ON b.x = r.y)
SELECT x AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(y) AS component_id, min(y) = x AS kept FROM reach LEFT JOIN n ON n.doc_id = x GROUP BY x"""

_Q = ", ".join(f"quantile_disc({r}, 0.25) AS {r}_lo, quantile_disc({r}, 0.75) AS {r}_hi" for r in RATIOS)


def _top(r: str) -> str:
    of = lambda t: f"({t}.{r}_hi + {SPREAD} * greatest({t}.{r}_hi - {t}.{r}_lo, {RATIOS[r]}))"
    return f"CASE WHEN s.n >= {LEAST_ROWS} THEN {of('s')} WHEN l.n >= {LEAST_ROWS} THEN {of('l')} ELSE {of('t')} END"


QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i+2) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM win WHERE (doc_id, g) IN (SELECT (doc_id, g) FROM win GROUP BY doc_id, g HAVING count(*) > 1)) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, {_SPACED}) GROUP BY doc_id),
c AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
r AS (SELECT *, n_symbols/word_chars AS symbol_ratio, word_chars/n_words AS word_length, n_dup_lines/n_words AS dup_line_ratio, n_repeat_words/n_words AS repeat_ratio FROM c WHERE n_words > 0),
s AS (SELECT lang, source, count(*) AS n, {_Q} FROM r GROUP BY lang, source), l AS (SELECT lang, count(*) AS n, {_Q} FROM r GROUP BY lang), t AS (SELECT count(*) AS n, {_Q} FROM r),
v AS (SELECT c.*, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed FROM c)
SELECT v.doc_id, v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({" OR ".join(f"r.{x} > {_top(x)}" for x in RATIOS)}, false) AS kept
FROM v LEFT JOIN r ON r.doc_id = v.doc_id LEFT JOIN s ON s.lang = v.lang AND s.source = v.source LEFT JOIN l ON l.lang = v.lang, t"""

WORD_ROLLUP = rf"""
WITH counted AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), {_SPACED})) AS n FROM documents WHERE doc_id IS NOT NULL)
SELECT source, lang, 'words-1' AS tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM counted GROUP BY source, lang"""


FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, len(w)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM u),
p AS (SELECT doc_id, n, t, form, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

#: Host, path and verdict: fixed values of op12.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_LINK = url_trust.LINK.replace("'", "''")
_HOST = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

URL_TRUST = rf"""
WITH RECURSIVE rules(h, p, v) AS (VALUES {_RULES}),
r AS (SELECT *, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, row_number() OVER () AS k FROM pages),
p AS (SELECT k, page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, coalesce(html, '') AS html FROM r),
fits AS (SELECT k, arg_max(h || p || '|' || v, (length(h || p), length(h))) AS best FROM p, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k),
ruled AS (SELECT p.*, split_part(best, '|', 1) AS rule, split_part(best, '|', 2) AS ruled FROM p LEFT JOIN fits USING (k)),
seeds AS (SELECT host, count(*) FILTER (ruled = 'allow') * {url_trust.UNIT} // count(*) AS trust, count(*) FILTER (ruled = 'block') * {url_trust.UNIT} // count(*) AS distrust FROM ruled WHERE host <> '' GROUP BY host),
links AS (SELECT source, target, count(*) AS n FROM (SELECT DISTINCT k, host AS source, translate(unnest(regexp_extract_all(html, '{_LINK}', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS target FROM p) WHERE source <> '' AND target <> '' AND source <> target GROUP BY ALL),
both_ways AS (SELECT 'trust' AS kind, source AS host, target AS nxt, n FROM links UNION ALL SELECT 'distrust', target, source, n FROM links),
edges AS (SELECT *, sum(n) OVER (PARTITION BY kind, host)::BIGINT AS total FROM both_ways),
push AS (SELECT 'trust' AS kind, host, (trust * {100 - url_trust.DAMPING} // 100)::BIGINT AS v FROM seeds WHERE trust > 0 UNION ALL SELECT 'distrust', host, (distrust * {100 - url_trust.DAMPING} // 100)::BIGINT FROM seeds WHERE distrust > 0
  UNION ALL SELECT kind, nxt, sum(v // total * n // 100 * {url_trust.DAMPING})::BIGINT FROM push JOIN edges USING (kind, host) WHERE v >= {url_trust.LEAST_PUSH} GROUP BY kind, nxt),
score AS (SELECT host, coalesce(sum(v) FILTER (kind = 'trust'), 0)::BIGINT AS trust, coalesce(sum(v) FILTER (kind = 'distrust'), 0)::BIGINT AS distrust FROM push GROUP BY host)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) > {url_trust.MARGIN} THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0)::BIGINT AS trust, coalesce(distrust, 0)::BIGINT AS distrust
FROM ruled LEFT JOIN score USING (host)"""
