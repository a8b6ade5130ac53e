"""DuckDB SQL that gives the same rows as the queries, over the same whole tables."""

from __future__ import annotations

from . import sharding
from .quality import BOILERPLATE, MAX_LOST_PERCENT

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, url, coalesce({_LOWER.format("regexp_extract(rest, '^[^/?#]*')")}, '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
rules(rule, verdict, rhost, rpath) AS (VALUES
  ('com/en/', 'block', 'com', '/en/'), ('example.com/en/7', 'allow', 'example.com', '/en/7'), ('net/de/', 'allow', 'net', '/de/'),
  ('example.net/de/8', 'block', 'example.net', '/de/8'), ('org/es/', 'block', 'org', '/es/')),
best AS (
  SELECT p.url, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM (SELECT DISTINCT url, host, path FROM parts) p JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
  GROUP BY p.url),
words(word) AS (VALUES ('adult'), ('bets'), ('casino'), ('gambling'), ('pills'), ('poker'), ('porn'), ('spam'), ('track'), ('viagra'), ('xxx')),
globs(pattern, verdict, re) AS (VALUES ('/wp-login.', 'block', '(?is)/wp-login\\.'), ('/cgi-bin/', 'block', '(?is)/cgi-bin/'),
  ('||doubleclick.net^', 'block', '(?is)^[^/?#]*?://(?:[^/?#]*\\.)?doubleclick\\.net(?:[^0-9A-Za-z_.%\\-]|$)'), ('/robots.txt|', 'allow', '(?is)/robots\\.txt$')),
patterns AS (
  SELECT u.url, w.word AS pattern, 'block' AS verdict
  FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL) u JOIN words w
    ON regexp_matches(u.url, '(?i)^[^/?#]*?://(?:[^/?#]*[^0-9a-z/?#])?' || w.word || '(?:[^0-9a-z]|$)')
  UNION ALL
  SELECT u.url, g.pattern, g.verdict FROM (SELECT DISTINCT url FROM pages) u JOIN globs g ON regexp_matches(coalesce(u.url, ''), g.re)),
pick AS (SELECT url, arg_max(pattern, (verdict = 'allow', pattern)) AS pattern, arg_max(verdict, (verdict = 'allow', pattern)) AS verdict FROM patterns GROUP BY url)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, k.verdict, 'allow') AS verdict,
  CASE WHEN b.rule IS NULL THEN k.pattern END AS pattern
FROM parts p LEFT JOIN best b ON p.url = b.url LEFT JOIN pick k ON p.url = k.url
"""

_WS = r"[\x20\x09-\x0D]"
_NWS = r"[^\x20\x09-\x0D]"


def quality_sql() -> str:
    """The contract's columns for documents."""
    stock = "|".join(BOILERPLATE)
    good = f"""NOT regexp_matches(x, '{_NWS}') OR (
      regexp_matches(x, '[.!?…。！？:;]["''”’»)\\]]*{_WS}*$') AND NOT regexp_matches(lower(x), '{stock}')
      AND len(string_split_regex(x, '(?:^|{_WS})(?:[|»›•·→]|::|>>)')) - 1 < 2
      AND (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) * 10 <= length(x))"""
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_NWS}+') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
f AS (
  SELECT doc_id, t, w, list_filter(lines, lambda x: regexp_matches(x, '{_NWS}')) AS full_lines,
    array_to_string(list_filter(lines, lambda x: {good}), chr(10)) AS clean FROM d),
one AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
three AS (SELECT doc_id, p, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM one WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, x, y, z) AS n FROM three WHERE z IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM twice, (VALUES (0), (1), (2)) o(k) GROUP BY doc_id),
n AS (
  SELECT f.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(clean, '{_WS}+', '', 'g')) AS stay
  FROM f LEFT JOIN covered ON covered.doc_id = f.doc_id),
b AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (CASE WHEN word_chars > 0 THEN (word_chars - stay) * 100 / word_chars ELSE 0 END) <= {MAX_LOST_PERCENT} AS kept
FROM b
"""


OP3 = quality_sql()


def op4() -> str:
    table = ",".join(map(str, sharding.fill_table()))
    return f"""
WITH t AS (SELECT [{table}] AS shards)
SELECT doc_id, source, slot, 'shard-' || lpad(CAST(t.shards[slot + 1] AS VARCHAR), 3, '0') AS shard
FROM (SELECT doc_id, source, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % {sharding.SLOTS} AS slot FROM documents), t
"""


OP6 = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(regexp_replace(regexp_replace(text, '<(\\\\*)(/?s>)', '<\\\\\\1\\2', 'g'), '\\[(\\\\*)(/?INST\\])', '[\\\\\\1\\2', 'g')) AS body,
    length(regexp_replace(regexp_replace(role, '<(\\\\*)(/?s>)', '<\\\\\\1\\2', 'g'), '\\[(\\\\*)(/?INST\\])', '[\\\\\\1\\2', 'g')) AS name
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(body + CASE WHEN before IS NOT DISTINCT FROM role THEN 13 ELSE 9 + name + 7 + 4 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP7 = """
WITH l AS (
  SELECT doc_id, text, i, string_split(text, chr(10))[i + 1] AS line, trim(string_split(text, chr(10))[i + 1], chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS t
  FROM (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)),
full_lines AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE t <> ''),
three AS (SELECT doc_id, p, t, lead(t) OVER w AS t2, lead(t, 2) OVER w AS t3 FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY t, t2, t3 ORDER BY doc_id, p) AS n FROM three WHERE t3 IS NOT NULL) WHERE n > 1),
gone AS (SELECT DISTINCT f.doc_id, f.i FROM later JOIN (VALUES (0), (1), (2)) o(k) ON true JOIN full_lines f ON f.doc_id = later.doc_id AND f.p = later.p + o.k),
clean AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
    coalesce(string_agg(CASE WHEN g.i IS NULL THEN l.line END, chr(10) ORDER BY l.i), '') AS text
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed, c.text FROM documents d LEFT JOIN clean c ON c.doc_id = d.doc_id
"""

OP8 = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
one AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w WHERE len(ws) > 2),
s AS (
  SELECT DISTINCT doc_id, g FROM (SELECT doc_id, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g FROM one WINDOW o AS (PARTITION BY doc_id ORDER BY p)) WHERE g IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
df AS (SELECT g, count(*) AS f FROM s GROUP BY g HAVING count(*) > 1),
ranked AS (SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY coalesce(df.f, 1), s.g) AS r FROM s JOIN n USING (doc_id) LEFT JOIN df USING (g)),
prefix AS (SELECT doc_id, g, n FROM ranked WHERE r <= n - (85 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM prefix a JOIN prefix b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n),
links AS (SELECT a, b FROM (SELECT a, b, na, nb, count(*) AS c FROM cand JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.g = y.g GROUP BY a, b, na, nb) WHERE 100 * c >= 85 * (na + nb - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS seen FROM edges UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.seen = edges.a),
comp AS (SELECT doc_id, min(seen) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id, coalesce(comp.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.doc_id = d.doc_id
"""

_PLAIN = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP10 = f"""
WITH i AS (SELECT item_id, {_PLAIN.format("text")} AS ws FROM benchmark),
iw AS (SELECT item_id, ws, least(len(ws), 5) AS k FROM i WHERE len(ws) > 0),
ig AS (SELECT DISTINCT item_id, k, array_to_string(ws[p : p + k - 1], ' ') AS g FROM (SELECT item_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS p FROM iw)),
n AS (SELECT item_id, count(*) AS n_shingles FROM ig GROUP BY item_id),
d AS (SELECT doc_id, {_PLAIN.format("text")} AS ws FROM documents),
dg AS (SELECT DISTINCT doc_id, k, array_to_string(ws[p : p + k - 1], ' ') AS g FROM (
  SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM ig) WHERE len(ws) >= k))
SELECT dg.doc_id, ig.item_id, n.n_shingles, count(*) AS n_shared
FROM dg JOIN ig ON dg.g = ig.g AND dg.k = ig.k JOIN n ON n.item_id = ig.item_id
GROUP BY dg.doc_id, ig.item_id, n.n_shingles HAVING 100 * count(*) >= 80 * n.n_shingles
"""

ORACLE = {"op1_url_filters": OP1, "op3_quality_rules": OP3, "op4_sharding": op4, "op6_chat_formatting": OP6, "op7_line_dedup": OP7, "op8_minhash_dedup": OP8, "op10_benchmark_decontamination": OP10}
