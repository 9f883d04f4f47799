"""DuckDB SQL of those queries that SQL can state over whole tables."""

_SITE = r"""nullif(regexp_replace(regexp_extract(lower(trim(url)), '^https?://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '^www\.', ''), '')"""
_KEY = r"""replace(regexp_replace(lower(line), '[^\p{L}]+', '', 'g'), 'ς', 'σ')"""

_LINES = rf"""
WITH raw AS (
  SELECT chunk_id, {_SITE} AS site, string_split(text, chr(10)) AS parts FROM chunks
), lines AS (
  SELECT DISTINCT chunk_id, site, n AS line_no, {_KEY} AS k
  FROM (SELECT chunk_id, site, unnest(range(1, len(parts) + 1)) AS n, unnest(parts) AS line FROM raw)
  WHERE site IS NOT NULL
), hits AS (
  SELECT DISTINCT l.chunk_id, l.line_no FROM lines l JOIN (
    SELECT site, k FROM lines WHERE length(k) >= 12 GROUP BY site, k HAVING count(DISTINCT chunk_id) >= 12
  ) f ON l.site = f.site AND l.k = f.k
)
"""

P2_FOUND = _LINES + "SELECT chunk_id, CAST(line_no AS INTEGER) AS line_no FROM hits"

P2_CLEAN = _LINES.replace("), hits AS (", """), sites AS (
  SELECT site, count(DISTINCT chunk_id) AS held FROM raw WHERE site IS NOT NULL GROUP BY site
), hits AS (""").replace("SELECT site, k FROM lines WHERE length(k) >= 12 GROUP BY site, k HAVING count(DISTINCT chunk_id) >= 12", "SELECT site, k FROM lines JOIN sites USING (site) WHERE length(k) >= 12 GROUP BY site, k, held HAVING count(DISTINCT chunk_id) >= greatest(12, 0.01 * held)") + """
, drops AS (SELECT chunk_id, list(line_no) AS d FROM hits GROUP BY chunk_id)
SELECT c.chunk_id, c.ingested_at,
  CASE WHEN d IS NULL THEN text
       ELSE array_to_string(list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: NOT list_contains(d, i)), lambda i: string_split(text, chr(10))[i]), chr(10)) END AS clean_text,
  CAST(coalesce(len(d), 0) AS INTEGER) AS lines_removed
FROM chunks c LEFT JOIN drops USING (chunk_id)
"""

_FLOWS = """
WITH base AS (
  SELECT query_id, chunk_id, 'retriever:' || retriever AS criterion,
    max(CASE WHEN isfinite(score) THEN score END) AS s
  FROM retrieved WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL
), members AS (SELECT DISTINCT query_id, chunk_id FROM base),
weights AS (SELECT chunk_id, max(CASE WHEN isfinite(authority_weight) THEN authority_weight END) AS w FROM chunks GROUP BY chunk_id),
crit AS (SELECT DISTINCT query_id, criterion FROM base WHERE s IS NOT NULL),
low AS (SELECT query_id, criterion, min(s) AS low FROM base WHERE s IS NOT NULL GROUP BY ALL),
scores AS (
  SELECT m.query_id, m.chunk_id, c.criterion, coalesce(b.s, l.low) AS s
  FROM members m JOIN crit c USING (query_id) JOIN low l USING (query_id, criterion)
  LEFT JOIN base b ON b.query_id = m.query_id AND b.chunk_id = m.chunk_id AND b.criterion = c.criterion
  UNION ALL
  SELECT m.query_id, m.chunk_id, 'authority', coalesce(w.w, 0.4) FROM members m LEFT JOIN weights w USING (chunk_id)
), flows AS (
  SELECT a.query_id, a.chunk_id, round(sum(sign(a.s - b.s)) / 2.0 / greatest(1, n - 1) * (n / (n - 1.0 + (n = 1)::INT)), 9) AS flow
  FROM scores a JOIN scores b ON a.query_id = b.query_id AND a.criterion = b.criterion
  JOIN (SELECT query_id, count(*) AS n FROM members GROUP BY query_id) z ON z.query_id = a.query_id
  GROUP BY a.query_id, a.chunk_id, n
)
"""

P3_FOUND = _FLOWS + """
SELECT query_id, chunk_id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY flow DESC, chunk_id) AS place FROM flows
) WHERE place = 1
"""

P3_FLOWS = _FLOWS + """
SELECT query_id, chunk_id, flow, row_number() OVER (PARTITION BY query_id ORDER BY flow DESC, chunk_id) AS place FROM flows
"""

P3_CLIPPED = _FLOWS.replace("), flows AS (", """), ranked AS (
  SELECT *, (rank() OVER g - 1 + (count(*) OVER (PARTITION BY query_id, criterion, s) - 1) / 2.0) / greatest(1, count(*) OVER (PARTITION BY query_id, criterion) - 1) AS p,
    count(*) OVER (PARTITION BY query_id, criterion) AS n
  FROM scores WINDOW g AS (PARTITION BY query_id, criterion ORDER BY s)
), flows AS (""").replace("sum(sign(a.s - b.s)) / 2.0 / greatest(1, n - 1) * (n / (n - 1.0 + (n = 1)::INT))", "sum(greatest(-1.0, least(1.0, (a.p - b.p) / 0.25))) / greatest(1, a.n - 1)").replace(
    """FROM scores a JOIN scores b ON a.query_id = b.query_id AND a.criterion = b.criterion
  JOIN (SELECT query_id, count(*) AS n FROM members GROUP BY query_id) z ON z.query_id = a.query_id
  GROUP BY a.query_id, a.chunk_id, n""", """FROM ranked a JOIN ranked b ON a.query_id = b.query_id AND a.criterion = b.criterion
  GROUP BY a.query_id, a.chunk_id, a.n""") + """
SELECT query_id, chunk_id, round(flow, 6) + 0.0::DOUBLE AS flow FROM flows
"""

ORACLE_SQL = {"p2_found": P2_FOUND, "p2_clean": P2_CLEAN, "p3_found": P3_FOUND, "p3_flows": P3_FLOWS, "p3_clipped": P3_CLIPPED}
