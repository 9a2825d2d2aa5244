"""DuckDB SQL of the corpus queries that SQL can express."""

#: Words and blank lines as in the operators.
WORD = r"[^\x20\x09-\x0D]+"
ENDS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"

LINE_DEDUP = rf"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, coalesce(source, '-') AS s, source IS NULL AS n FROM documents),
lines AS (
  SELECT r, doc_id, source, s, n, text, u.line AS line, u.k AS k, regexp_replace(u.line, '{ENDS}', '', 'g') AS key
  FROM rows, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line,
                             unnest(range(len(string_split(text, chr(10))))) AS k) u),
distinct_pages AS (SELECT s, n, coalesce(text, '') AS t, min(r) AS r FROM rows GROUP BY ALL),
totals AS (SELECT s, n, count(*) AS total FROM distinct_pages GROUP BY ALL),
often AS (
  SELECT l.s, l.n, l.key, count(DISTINCT l.r) AS c FROM lines l JOIN distinct_pages USING (r)
  WHERE l.key <> '' GROUP BY ALL),
boiler AS (
  SELECT o.s, o.n, o.key FROM often o JOIN totals t ON o.s = t.s AND o.n = t.n
  WHERE o.c >= 5 AND o.c > 0.01 * t.total),
marked AS (
  SELECT l.*, b.key IS NOT NULL AS dropped FROM lines l LEFT JOIN boiler b ON l.s = b.s AND l.n = b.n AND l.key = b.key),
cleaned AS (
  SELECT r, count(*) FILTER (WHERE key <> '') AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT dropped), '') AS clean
  FROM marked GROUP BY r)
SELECT rows.doc_id, rows.source AS host, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines,
       CAST(coalesce(n_dropped, 0) AS INTEGER) AS n_dropped,
       CASE WHEN rows.text IS NULL THEN NULL WHEN n_dropped > 0 THEN clean ELSE rows.text END AS text
FROM rows LEFT JOIN cleaned USING (r)
"""

MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS dense,
         length(regexp_replace(text, '[^#*$%&|<>!]+', '', 'g')) AS marks,
         (('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '#' || md5(coalesce(text, '')))), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS u
  FROM documents),
keyed AS (
  SELECT *, -ln(u) / greatest(0.05, coalesce(((dense - marks) / CAST(nullif(dense, 0) AS DOUBLE)) ** 2, 0)) AS key FROM sized),
sources AS (SELECT source, sum(size) AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, 3 * source_size AS cap FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / CAST(
             sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS DOUBLE) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / CAST(w AS DOUBLE), source NULLS LAST
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size, CAST(least(cap, w * (SELECT arg_min(level, cap / CAST(w AS DOUBLE)) FILTER (WHERE cap >= level * w) FROM levels)) AS DOUBLE) AS target
  FROM levels),
ordered AS (
  SELECT k.doc_id, k.size, g.source_size, g.target,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS before,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs
  FROM keyed k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(3, epochs + CASE WHEN before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ordered
"""


def _lloyd() -> str:
    """Two rounds and a last assignment of 16 parts of 4 components."""
    assigned = """
SELECT i, p, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
  SELECT s.i, s.p, b.j, (s.a - b.a) ** 2 + (s.b - b.b) ** 2 + (s.c - b.c) ** 2 + (s.d - b.d) ** 2 AS d
  FROM parts s JOIN {book} b ON s.p = b.p) GROUP BY i, p"""
    moved = """
SELECT b.p, b.j, coalesce(m.a, b.a) AS a, coalesce(m.b, b.b) AS b, coalesce(m.c, b.c) AS c, coalesce(m.d, b.d) AS d
FROM {book} b LEFT JOIN (
  SELECT s.p, t.j, floor(sum(s.a) / count(*)) AS a, floor(sum(s.b) / count(*)) AS b, floor(sum(s.c) / count(*)) AS c,
         floor(sum(s.d) / count(*)) AS d
  FROM parts s JOIN {at} t ON s.i = t.i AND s.p = t.p GROUP BY s.p, t.j) m ON b.p = m.p AND b.j = m.j"""
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS i, * FROM (
    SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)),
parts AS MATERIALIZED (
  SELECT i, p, x[4 * p + 1] AS a, x[4 * p + 2] AS b, x[4 * p + 3] AS c, x[4 * p + 4] AS d FROM kept, range(16) AS r(p)),
book0 AS MATERIALIZED (SELECT p, i - 1 AS j, a, b, c, d FROM parts WHERE i <= 64),
at0 AS MATERIALIZED ({assigned.format(book='book0')}),
book1 AS MATERIALIZED ({moved.format(book='book0', at='at0')}),
at1 AS MATERIALIZED ({assigned.format(book='book1')}),
book2 AS MATERIALIZED ({moved.format(book='book1', at='at1')}),
at2 AS MATERIALIZED ({assigned.format(book='book2')}),
coded AS (SELECT i, string_agg(printf('%02x', j), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM at2 GROUP BY i),
books AS (
  SELECT sha256(string_agg(printf('%d,%d,%d,%d', CAST(a AS BIGINT), CAST(b AS BIGINT), CAST(c AS BIGINT), CAST(d AS BIGINT)), ','
                           ORDER BY p, j)) AS h FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (i), books
"""


DUAL_LLOYD = _lloyd()
