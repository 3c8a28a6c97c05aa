"""DuckDB SQL of the audits that SQL can express: source divergence, spelling variants, URL filters."""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
occ AS (SELECT lang, source, r, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
vocab AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
n AS (SELECT lang, source, term, count(*) AS c FROM occ JOIN vocab USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM vocab GROUP BY lang),
g AS (SELECT x.lang, x.source, coalesce(sum(n.c), 0)::BIGINT AS total, coalesce(max(v.v), 0) AS v
      FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN n ON n.lang = x.lang AND n.source = x.source
      LEFT JOIN v ON v.lang = x.lang GROUP BY x.lang, x.source),
p AS (SELECT g.lang, g.source, vocab.term, coalesce(n.c, 0) AS c,
        1 + (1000000000::HUGEINT * (coalesce(n.c, 0) + 1)) // (g.total + g.v) AS p
      FROM g JOIN vocab ON vocab.lang = g.lang
      LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = vocab.term),
q AS (SELECT t.lang, t.term, 1 + (1000000000::HUGEINT * (t.c + 1)) // (l.total + l.v) AS q
      FROM (SELECT lang, term, sum(c) AS c FROM n GROUP BY lang, term) t
      JOIN (SELECT lang, sum(total) AS total, max(v) AS v FROM g GROUP BY lang) l ON l.lang = t.lang),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
             GROUP BY a.lang, a.source, b.source) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT p.lang, p.source, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // q.q)::BIGINT AS value
  FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.c > 0 AND p.p > q.q)
SELECT lang, source, 'pair' AS part, item, value,
  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
UNION ALL
SELECT lang, source, 'term', item, value, rank FROM (SELECT *,
  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM term) WHERE rank <= 200
"""

OP13_SQL = r"""
WITH RECURSIVE rules(host, path, verdict) AS (VALUES
  ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*?\brel\s*=\s*["'']?[^"''>]*\bcanonical\b[^>]*>')) AS tag,
    '(?is)\bhref\s*=\s*["'']?([^"''>\s]*)' AS pattern FROM pages
  UNION ALL SELECT url, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')),
    '(?is)\bcontent\s*=\s*["''][^"'']*?url\s*=\s*["'']?\s*([^"'']*)' FROM pages),
targets AS (SELECT url, regexp_extract(url, '(?s)^(.*?)://([^/?#]*)([^?#]*)', ['scheme', 'host', 'path']) AS u,
    CASE WHEN pattern LIKE '%href%' THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''>\s]*)', 1)
         ELSE regexp_extract(tag, '(?is)\bcontent\s*=\s*["''][^"'']*?url\s*=\s*["'']?\s*([^"'']*)', 1) END AS t FROM tags),
links AS (SELECT url AS a, CASE WHEN t LIKE '%://%' THEN t WHEN t LIKE '//%' THEN u.scheme || ':' || t
      WHEN t LIKE '/%' THEN u.scheme || '://' || u.host || t
      WHEN t LIKE '?%' THEN u.scheme || '://' || u.host || u.path || t
      ELSE u.scheme || '://' || u.host || coalesce(nullif(regexp_extract(u.path, '(?s)^(.*/)', 1), ''), '/') || t END AS b
  FROM (SELECT url, u, trim(replace(t, '&amp;', '&')) AS t FROM targets) x
  WHERE t <> '' AND t NOT LIKE '#%' AND (t LIKE '%://%' OR NOT regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:'))),
ends AS (SELECT regexp_replace(a, '(?s)#.*$', '') AS a, regexp_replace(b, '(?s)#.*$', '') AS b FROM links
  WHERE instr(a, '://') > 0 AND instr(b, '://') > 0),
low AS (SELECT translate(regexp_extract(a, '(?s)^(.*?://[^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      || substr(a, length(regexp_extract(a, '(?s)^(.*?://[^/?]*)', 1)) + 1) AS a,
    translate(regexp_extract(b, '(?s)^(.*?://[^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      || substr(b, length(regexp_extract(b, '(?s)^(.*?://[^/?]*)', 1)) + 1) AS b FROM ends),
both_ways AS (SELECT a, b FROM low UNION SELECT b, a FROM low),
addresses AS (SELECT url, page_id, row_number() OVER () AS r,
    coalesce(regexp_replace(CASE WHEN instr(url, '://') > 0 THEN url END, '(?s)#.*$', ''), '') AS plain FROM pages),
parts AS (SELECT page_id, r, coalesce(translate(regexp_extract(url, '(?s)^(.*?)://([^/?#]*)([^?#]*)', 2),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^(.*?)://([^/?#]*)([^?#]*)', 3), '') AS path,
    translate(regexp_extract(plain, '(?s)^(.*?://[^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      || substr(plain, length(regexp_extract(plain, '(?s)^(.*?://[^/?]*)', 1)) + 1) AS address FROM addresses),
own AS (SELECT p.page_id, p.r, p.host, p.path, p.address, rules.host || rules.path AS rule, rules.verdict,
    row_number() OVER (PARTITION BY p.r ORDER BY length(rules.host || rules.path) DESC, rules.verdict, rules.host || rules.path) AS k
  FROM parts p LEFT JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path)),
nodes AS (SELECT DISTINCT a, regexp_extract(a, '(?s)^(.*?)://([^/?#]*)([^?#]*)', 2) AS host,
    regexp_extract(a, '(?s)^(.*?)://([^/?#]*)([^?#]*)', 3) AS path FROM both_ways),
seeds AS (SELECT a FROM (SELECT a, rules.verdict,
    row_number() OVER (PARTITION BY a ORDER BY length(rules.host || rules.path) DESC, rules.verdict, rules.host || rules.path) AS k
  FROM nodes JOIN rules ON (nodes.host = rules.host OR ends_with(nodes.host, '.' || rules.host)) AND starts_with(nodes.path, rules.path))
  WHERE k = 1 AND verdict = 'block'),
blocked AS (SELECT a FROM seeds UNION SELECT both_ways.b FROM blocked JOIN both_ways ON both_ways.a = blocked.a)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN address IN (SELECT a FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM own WHERE k = 1
"""

OP12_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS head, unnest(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
seen AS (SELECT head, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY head, run),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(head || run)), '..'), lambda b: ('0x' || b)::BIGINT)),
      lambda s, b: xor(s >> 8, crc.t[(xor(s, b) & 255) + 1]))) AS h FROM seen, crc),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 97 = 0
      THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT x.word, y.word AS near, y.n AS near_n FROM cuts x JOIN cuts y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.a || c.b
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.a || c.b),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * words.n THEN near END AS form,
    CASE WHEN near_n >= 2 * words.n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, form AS root, 1 AS step FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT chain.word, forms.form, step + 1 FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT forms.word, form, coalesce(ends.root, forms.word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)
"""
