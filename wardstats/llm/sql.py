"""DuckDB statements for the registered queries that SQL can express."""

from __future__ import annotations

from wardstats.llm.licenses import COVERAGE, DRIFT, REACH, STEP, template_grams

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')"

JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (
  SELECT doc_id, doc_id AS m FROM documents
  UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.m = e.a)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.m) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
byte AS (
  SELECT doc_id, i, substr(h, 2 * i - 1, 2) AS b, CASE WHEN length(h) >= 2 * i + 98 THEN substr(h, 2 * i - 1, 100) END AS s
  FROM (SELECT doc_id, h, unnest(range(1, CAST(length(h) / 2 AS BIGINT) + 1)) AS i FROM d)),
known AS (SELECT doc_id, i, b, s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id AS hit FROM byte),
flag AS (
  SELECT doc_id, i, b, coalesce(max(CASE WHEN hit THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
  FROM known),
edge AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS head FROM flag),
told AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS removed, count(*) FILTER (head) AS spans,
         string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept
  FROM edge GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN told ON told.doc_id = d.doc_id
"""

SPELLING = rf"""
WITH RECURSIVE run AS (
  SELECT doc_id, translate(r, '{_UP}', '{_LOW}') AS r, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS r FROM documents) GROUP BY ALL),
byte AS (
  SELECT r, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b
  FROM run),
bits AS (SELECT r, n, list_transform(range(8 * len(b)), lambda i: CAST((b[i // 8 + 1] >> (i % 8)) & 1 AS BIGINT)) AS b FROM byte),
crc AS (
  SELECT r, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda s, x: xor(s >> 1, 3988292384 * (xor(s, x) & 1)))) AS h FROM bits),
w AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, sum(n) AS n
  FROM crc GROUP BY 1 HAVING sum(n) >= 3 AND length(word) >= 5),
place AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
gone AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM place),
pair AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM gone x JOIN gone y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word != y.word
  UNION SELECT x.word, y.word, y.n FROM gone x JOIN w y ON y.word = x.a || x.z
  UNION SELECT y.word, x.word, x.n FROM gone x JOIN w y ON y.word = x.a || x.z),
best AS (SELECT word, count(*) AS n_near, min((-near_n, near)) AS b FROM pair GROUP BY word),
told AS (
  SELECT w.word, CASE WHEN -b[1] >= 2 * w.n THEN b[2] END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * w.n THEN -b[1] END AS form_n
  FROM w LEFT JOIN best ON best.word = w.word),
chain AS (SELECT word, word AS at FROM told UNION ALL SELECT chain.word, told.form FROM chain JOIN told ON told.word = chain.at WHERE told.form IS NOT NULL)
SELECT t.word, t.form, c.at AS root, CAST(t.n AS BIGINT) AS n, CAST(t.n_near AS BIGINT) AS n_near, CAST(t.form_n AS BIGINT) AS form_n
FROM told t JOIN chain c ON c.word = t.word JOIN told e ON e.word = c.at AND e.form IS NULL
"""

_TERMS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
hit AS (
  SELECT k, doc_id, n, t, count(*) AS tf FROM (SELECT k, doc_id, len(w) AS n, unnest(w) AS t FROM d)
  WHERE t IN (SELECT t FROM q) GROUP BY ALL),
term AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM hit, s GROUP BY t),
worth AS (
  SELECT k, doc_id, hit.t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS v
  FROM hit JOIN term ON term.t = hit.t, s),
total AS (SELECT item_id, k, doc_id, CAST(sum(times * v) AS BIGINT) AS score FROM worth JOIN q ON q.t = worth.t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM total WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
"""


def licenses() -> str:
    quoted = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    grams = ",\n    ".join("(" + ", ".join(map(quoted, g)) + ")" for g in template_grams())
    return rf"""
WITH t(template, label, kind, size, pos, a, b, c) AS (VALUES
    {grams}),
d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
place AS (SELECT doc_id, i, w[i + 1] AS x, w[i + 2] AS y, w[i + 3] AS z FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d)),
hit AS (
  SELECT doc_id, template, label, kind, size, i, pos, i - pos AS diagonal, CASE WHEN c IS NULL THEN 2 ELSE 3 END AS k
  FROM place JOIN t ON x = a AND y = b AND (c IS NULL OR z = c)),
vote AS (
  SELECT doc_id, template, any_value(label) AS label, any_value(kind) AS kind, any_value(size) AS size, any_value(k) AS k,
         diagonal, list(DISTINCT pos) AS ps, min(i) AS i0, max(i) AS i1
  FROM hit GROUP BY doc_id, template, diagonal),
merged AS (
  SELECT doc_id, template, label, kind, size, k, diagonal, flatten(list(ps) OVER near) AS ps, min(i0) OVER near AS first_word, max(i1) OVER near AS i1
  FROM vote WINDOW near AS (PARTITION BY doc_id, template
    ORDER BY CASE WHEN kind = 'notice' AND floor(size * {DRIFT}) > 0 THEN CAST(floor(diagonal * {STEP} / floor(size * {DRIFT})) AS BIGINT)
                  ELSE CAST(diagonal AS BIGINT) * {2 * STEP} END
    RANGE BETWEEN {STEP} PRECEDING AND {STEP} FOLLOWING)),
found AS (SELECT *, len(list_distinct(flatten(list_transform(ps, lambda p: range(p, p + k))))) AS covered FROM merged),
rated AS (
  SELECT *, covered / size AS share, covered / size + covered / 1e6 AS worth, CAST((first_word + i1 + k) // 2 AS BIGINT) AS middle FROM found
  WHERE CASE kind WHEN 'notice' THEN covered / size >= {COVERAGE} ELSE covered = size END),
kept AS (
  SELECT * FROM (SELECT *, max(worth) OVER (PARTITION BY doc_id, kind ORDER BY middle RANGE BETWEEN {REACH} PRECEDING AND {REACH} FOLLOWING) AS best FROM rated)
  WHERE kind <> 'notice' OR worth = best),
told AS (
  SELECT doc_id, count(*) FILTER (kind = 'base') AS n_base, min(first_word) FILTER (kind = 'base') AS first_word,
         max(first_word) FILTER (kind = 'base') AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (kind = 'base')), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN told ON told.doc_id = d.doc_id
"""
