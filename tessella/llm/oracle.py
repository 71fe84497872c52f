"""The same results as some corpus queries in DuckDB SQL, by brute force."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
    range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh
  FROM w
),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (SELECT a, b FROM p WHERE 100 * shared >= 80 * (na + nb - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(sh) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN named ON a = doc_id
"""

SUBSTRINGS = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, (length(h) / 2)::bigint AS n FROM h),
s AS (SELECT doc_id, size, p, md5(substr(h, 2 * p + 1, 2 * size)) AS x
  FROM (SELECT doc_id, h, size, unnest(range(0, n - size + 1)) AS p FROM b, (VALUES (240), (400)) sizes(size) WHERE n >= size)),
twice AS (SELECT size, x FROM s GROUP BY ALL HAVING count(*) > 1),
starts AS (SELECT doc_id, p, bool_or(size = 400) AS long, bool_or(size = 240) AS short FROM s JOIN twice USING (size, x) GROUP BY doc_id, p),
bytes AS (
  SELECT doc_id, j, byte,
    coalesce(max(CASE WHEN long THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 399 PRECEDING AND CURRENT ROW), 0) AS gone,
    coalesce(max(CASE WHEN short THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 239 PRECEDING AND CURRENT ROW), 0) AS again
  FROM (SELECT u.doc_id, j, substr(h, 2 * j + 1, 2) AS byte, long, short
        FROM (SELECT doc_id, h, unnest(range(0, n)) AS j FROM b WHERE n >= 240) u LEFT JOIN starts ON starts.doc_id = u.doc_id AND p = j)
),
runs AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), 0) AS before FROM bytes),
long AS (
  SELECT doc_id, sum(gone)::bigint AS n_removed, count(*) FILTER (gone = 1 AND before = 0) AS n_spans, sum(again)::bigint AS n_repeated,
    sha256(unhex(coalesce(string_agg(byte, '' ORDER BY j) FILTER (gone = 0), ''))) AS kept FROM runs GROUP BY doc_id
)
SELECT b.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  coalesce(kept, sha256(unhex(h))) AS kept_sha256, coalesce(n_repeated, 0) AS n_repeated
FROM b LEFT JOIN long USING (doc_id)
"""

LINES = f"""
WITH l AS (
  SELECT doc_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS line, len(parts) AS n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
),
k AS (
  SELECT *, {_WORDS.format(_LOWER.replace("text", "line"))} AS w,
    coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start
  FROM l
),
p AS (
  SELECT doc_id, i, start AS line_start, unnest(range(1, len(parts) + 1)) AS j, unnest(parts) AS part, len(parts) AS m
  FROM (
    SELECT *, CASE WHEN len(w) > 8 THEN string_split(regexp_replace(line, '([.!?])([\\x20\\x09\\x0B-\\x0D])', '\\1' || chr(1) || '\\2', 'g'), chr(1))
      ELSE [line] END AS parts
    FROM k
  )
),
q AS (
  SELECT *, {_WORDS.format(_LOWER.replace("text", "part"))} AS w, (line_start
    + coalesce(sum(length(part)) OVER (PARTITION BY doc_id, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::bigint AS start
  FROM p
),
u AS (
  SELECT doc_id, i, 0 AS j, start, start + length(line) AS stop, w FROM k WHERE len(w) > 0
  UNION ALL
  SELECT doc_id, i, j, start, start + length(part) AS stop, w FROM q WHERE m > 1 AND len(w) >= 8
),
r AS (
  SELECT *, row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id NULLS FIRST, start, stop) > 1 AS gone,
    count(*) OVER (PARTITION BY array_to_string(w, ' ')) > 1 AS again
  FROM u
),
e AS (
  SELECT r.*, r.gone AND NOT (r.j > 0 AND coalesce(b.gone, false)) AS cut, r.again AND NOT (r.j > 0 AND coalesce(b.again, false)) AS common
  FROM r LEFT JOIN (SELECT doc_id, i, gone, again FROM r WHERE j = 0) b ON b.doc_id IS NOT DISTINCT FROM r.doc_id AND b.i = r.i
),
rest AS (
  SELECT q.doc_id, q.i, string_agg(CASE WHEN e.cut THEN '' ELSE q.part END, '' ORDER BY q.j) AS rest
  FROM q LEFT JOIN e ON q.m > 1 AND e.doc_id IS NOT DISTINCT FROM q.doc_id AND e.i = q.i AND e.j = q.j GROUP BY q.doc_id, q.i
),
texts AS (
  SELECT k.doc_id, string_agg(CASE WHEN e.cut THEN '' ELSE rest.rest || CASE WHEN k.i < k.n THEN chr(10) ELSE '' END END, '' ORDER BY k.i) AS text
  FROM k JOIN rest ON rest.doc_id IS NOT DISTINCT FROM k.doc_id AND rest.i = k.i
    LEFT JOIN e ON e.j = 0 AND e.doc_id IS NOT DISTINCT FROM k.doc_id AND e.i = k.i
  GROUP BY k.doc_id
),
counts AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (cut) AS n_removed, coalesce(sum(len(w)) FILTER (cut), 0)::bigint AS words_removed,
    coalesce(sum(len(w)) FILTER (common), 0)::bigint AS words_repeated, coalesce(string_agg(start::varchar || ':' || stop::varchar, ',' ORDER BY start) FILTER (cut), '') AS spans
  FROM e GROUP BY doc_id
)
SELECT texts.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(words_removed, 0)::bigint AS words_removed,
  coalesce(words_repeated, 0)::bigint AS words_repeated, coalesce(spans, '') AS spans, text
FROM texts LEFT JOIN counts ON counts.doc_id IS NOT DISTINCT FROM texts.doc_id
"""
