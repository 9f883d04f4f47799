"""DuckDB SQL with the results of the registered queries."""

from __future__ import annotations

from provisio.functions.text import FURNITURE, STOPWORDS
from provisio.operators.answer import INSTRUCTIONS, REFUSAL, REFUSAL_REASON
from provisio.operators.embed import QUERY_PREFIX

CORPUS = """corpus AS (
  SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST) AS _n FROM chunks) WHERE _n = 1
)"""
SCORED = """scored AS (
  SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, id ORDER BY scored_at DESC NULLS LAST) AS _n FROM eval_results) WHERE _n = 1
)"""
ASKED = "asked AS (SELECT id AS query_id, concat_ws(' ', question, draft_citation) AS question FROM golden_set)"
# RE2 has no look-ahead; the third group takes the character that must not be a dot.
PROVISION = r"(?i)(?:§\s?|IRC\s+(?:§\s?)?)(\d+[A-Za-z]*)(?:((?:\([a-zA-Z0-9]+\))+)|[^.]|$)"
MENTION = (
    r"(?i)(IRC\s+§\s?\d+[A-Za-z]*(?:\([a-zA-Z0-9]+\))*|§\s?\d+[A-Za-z]*(?:\([a-zA-Z0-9]+\))*"
    r"|Treas\.\s?Reg\.\s?§[\d.]+-\d+(?:\([a-zA-Z0-9]+\))*|Pub\.?\s?\d+|Form\s?\d+|Schedule C Instructions|Schedule SE Instructions)"
)
TOKEN = r"(§\s?\d+[A-Za-z]*(?:\([a-zA-Z0-9]+\))*|Pub\.?\s?\d+|Form\s?\d+|Treas\.\s?Reg\.\s?§[\d.]+-\d+)"
STOPS = ", ".join(f"'{w}'" for w in STOPWORDS)


def words(text: str) -> str:
    return rf"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}_]+'), lambda w: w NOT IN ({STOPS}))"


def section(text: str) -> str:
    return f"nullif(lower(regexp_extract({text}, '{PROVISION}', 1)), '')"


def path(text: str) -> str:
    return rf"list_transform(regexp_extract_all(regexp_extract({text}, '{PROVISION}', 2), '\(([a-zA-Z0-9]+)\)', 1), lambda x: lower(x))"


def pid(sec: str, steps: str) -> str:
    return f"CASE WHEN {sec} IS NOT NULL THEN array_to_string(list_concat(['irc', {sec}], {steps}), '-') END"


def mention_key(c: str) -> str:
    return rf"regexp_replace(lower(regexp_replace({c}, '[\s.]', '', 'g')), '^irc', '')"


def citation_key(c: str) -> str:
    return rf"lower(regexp_replace(coalesce(nullif(regexp_extract({c}, '{TOKEN}', 1), ''), {c}), '[\s.]', '', 'g'))"


def parsed(select: str, text: str, source: str) -> str:
    inner = f"SELECT {select}, {text} AS _t, {section(text)} AS section FROM {source}"
    return f"SELECT *, CASE WHEN section IS NOT NULL THEN {path('_t')} END AS path, {pid('section', path('_t'))} AS pid FROM ({inner})"


def bm25(asked: str, k: int) -> str:
    return f"""
docs AS (SELECT chunk_id, pos, {words('text')} AS w, len({words('text')}) AS dl FROM corpus),
stats AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM docs),
postings AS (SELECT chunk_id, pos, dl, term, count(*) AS tf FROM (SELECT chunk_id, pos, dl, unnest(w) AS term FROM docs) GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM postings, stats GROUP BY term),
terms AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qw AS (SELECT query_id, unnest({words('question')}) AS term FROM {asked}),
gains AS (
  SELECT query_id, chunk_id, pos, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qw JOIN terms USING (term) JOIN postings USING (term), stats GROUP BY ALL
),
sparse AS (
  SELECT query_id, chunk_id, score, rank::INTEGER AS rank, 'sparse' AS retriever FROM (
    SELECT a.query_id, d.chunk_id, round(coalesce(g.score, 0), 9) AS score,
      row_number() OVER (PARTITION BY a.query_id ORDER BY round(coalesce(g.score, 0), 9) DESC, d.pos) AS rank
    FROM {asked} a CROSS JOIN docs d LEFT JOIN gains g ON g.query_id = a.query_id AND g.chunk_id = d.chunk_id
  ) WHERE rank <= {k}
)"""


PROVISIONS = f"""
stated AS ({parsed('chunk_id, pos', 'citation', 'corpus')}),
known AS (SELECT pid, section, path, arg_max(chunk_id, pos) AS chunk_id, min(pos) AS first_pos FROM stated WHERE pid IS NOT NULL GROUP BY ALL)"""

LOOKUP = f"""
targets AS (SELECT query_id, section, path, pid FROM ({parsed('query_id', 'question', 'asked')}) WHERE pid IS NOT NULL),
hits AS (SELECT t.query_id, k.pid, k.chunk_id, len(k.path) AS depth, k.first_pos FROM targets t JOIN known k ON k.section = t.section AND starts_with(k.pid, t.pid || '-')),
low AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.query_id = h.query_id AND starts_with(h.pid, o.pid || '-'))),
own AS (SELECT t.query_id, k.chunk_id, t.section, t.path FROM targets t JOIN known k USING (pid)),
up AS (
  SELECT o.query_id, k.chunk_id FROM own o
  JOIN known k ON k.pid = array_to_string(list_concat(['irc', o.section], o.path[:len(o.path) - 1]), '-')
  WHERE len(o.path) > 0 AND o.query_id NOT IN (SELECT query_id FROM low)
),
looked AS (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY b, d, p, chunk_id)::INTEGER AS ord FROM (
    SELECT query_id, chunk_id, 0 AS b, 0 AS d, 0 AS p FROM own
    UNION ALL SELECT query_id, chunk_id, 1, depth, first_pos FROM low
    UNION ALL SELECT query_id, chunk_id, 2, 0, 0 FROM up
  )
)"""

DIM = 64


def hashed(select: str, text: str, source: str, name: str) -> str:
    """Rows (select, dim, v): signed counts of the words' MD5; without any left, the first place is 1."""
    return f"""{name}_words AS (SELECT {select}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS w FROM {source}),
{name}_h AS (SELECT {select}, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM {name}_words),
{name}_some AS (SELECT {select}, h // 2 % {DIM} AS dim, sum(1 - 2 * (h % 2)) AS v FROM {name}_h GROUP BY ALL HAVING v <> 0),
{name} AS (SELECT * FROM {name}_some UNION ALL SELECT {select}, 0, 1 FROM {source} WHERE {select} NOT IN (SELECT {select} FROM {name}_some))"""


QUESTION = f"'{QUERY_PREFIX}' || coalesce(question, '')"


def dense(k: int) -> str:
    return f"""
{hashed('chunk_id', "coalesce(text, '')", 'corpus', 'cv')},
{hashed('query_id', QUESTION, 'asked', 'qv')},
cn AS (SELECT chunk_id, sqrt(sum(v * v)) AS n FROM cv GROUP BY chunk_id),
qn AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM qv GROUP BY query_id),
dots AS (SELECT query_id, chunk_id, sum(qv.v * cv.v) AS d FROM qv JOIN cv USING (dim) GROUP BY ALL),
dense AS (
  SELECT query_id, chunk_id, score, rank::INTEGER AS rank, 'dense' AS retriever FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT q.query_id, c.chunk_id, round(coalesce(d.d, 0) / (q.n * c.n), 9) AS score FROM qn q CROSS JOIN cn c LEFT JOIN dots d ON d.query_id = q.query_id AND d.chunk_id = c.chunk_id
    )
  ) WHERE rank <= {k}
)"""


MIXED = """mixed AS (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, d NULLS LAST, s NULLS LAST, chunk_id)::INTEGER AS rank,
    CASE WHEN s IS NULL THEN 'dense' WHEN d IS NULL THEN 'sparse' ELSE 'dense+sparse' END AS retriever
  FROM (
    SELECT query_id, chunk_id, d.rank AS d, s.rank AS s, round(coalesce(1.0::DOUBLE / (60.0 + d.rank), 0) + coalesce(1.0::DOUBLE / (60.0 + s.rank), 0), 12) AS score
    FROM dense d FULL JOIN sparse s USING (query_id, chunk_id)
  )
)"""


def merged(source: str, name: str = "merged") -> str:
    """Looked-up provisions, then the rest of the source, cut at 5."""
    return f"""{name} AS (
  SELECT query_id, chunk_id, score, rank::INTEGER AS rank, retriever FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src, o, chunk_id) AS rank FROM (
      SELECT query_id, chunk_id, 1.0::DOUBLE AS score, ord AS o, 'citation' AS retriever, 0 AS src FROM looked
      UNION ALL
      SELECT query_id, chunk_id, score, rank, retriever, 1 FROM {source} s
      WHERE NOT EXISTS (SELECT 1 FROM looked l WHERE l.query_id = s.query_id AND l.chunk_id = s.chunk_id)
    )
  ) WHERE rank <= 5
)"""


LISTS = f"""WITH {CORPUS}, {ASKED}, {PROVISIONS.strip()}, {LOOKUP.strip()}, {bm25('asked', 20).strip()}, {dense(20).strip()}, {MIXED}"""
HYBRID = f"{LISTS}, {merged('mixed')}"
RESULT = "SELECT query_id, chunk_id, round(score, 6) AS score, rank, retriever"

FUSED = """ranks AS (
  SELECT query_id, chunk_id, min(rank) FILTER (retriever = 'dense') AS d, min(rank) FILTER (retriever = 'sparse') AS s
  FROM retrieved WHERE retriever IN ('dense', 'sparse') AND rank IS NOT NULL GROUP BY ALL
), fused AS (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, d NULLS LAST, s NULLS LAST, chunk_id)::INTEGER AS rank,
    CASE WHEN s IS NULL THEN 'dense' WHEN d IS NULL THEN 'sparse' ELSE 'dense+sparse' END AS retriever
  FROM (SELECT *, round(coalesce(1.0::DOUBLE / (60.0 + d), 0) + coalesce(1.0::DOUBLE / (60.0 + s), 0), 12) AS score FROM ranks)
)"""

# every list of every retriever, a missing rank being the place by score
CONTEXT = f"""WITH {CORPUS}, listed AS (
  SELECT query_id, chunk_id, retriever, min(rank) AS rank, max(CASE WHEN isfinite(score) THEN score END) AS s
  FROM retrieved WHERE chunk_id IN (SELECT chunk_id FROM corpus) GROUP BY ALL
), placed AS (
  SELECT query_id, chunk_id, retriever, coalesce(rank, row_number() OVER (PARTITION BY query_id, retriever ORDER BY s DESC NULLS LAST, chunk_id)) AS rank FROM listed
), summed AS (
  SELECT query_id, chunk_id, min(rank) FILTER (retriever = 'dense') AS a, min(rank) FILTER (retriever = 'sparse') AS b, min(rank) FILTER (retriever = 'dense+sparse') AS c
  FROM placed GROUP BY ALL
), best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, a NULLS LAST, b NULLS LAST, c NULLS LAST, chunk_id) AS rank
    FROM (SELECT *, round(coalesce(1.0::DOUBLE / (60.0 + a), 0) + coalesce(1.0::DOUBLE / (60.0 + b), 0) + coalesce(1.0::DOUBLE / (60.0 + c), 0), 12) AS score FROM summed)
  ) WHERE rank <= 5
), contexts AS (
  SELECT query_id, string_agg('[' || coalesce(citation, '') || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank, chunk_id) AS context
  FROM best JOIN corpus USING (chunk_id) GROUP BY query_id
)"""
PROMPT_HEAD = (INSTRUCTIONS.format(refusal=REFUSAL) + "\n\nSource excerpts:\n\n").replace("'", "''")

REQUIRED = rf"""req AS (
  SELECT query_id, category, (row_number() OVER (PARTITION BY query_id ORDER BY place) - 1)::BIGINT AS n, {citation_key('part')} AS req_key FROM (
    SELECT id AS query_id, category, unnest(range(len(parts))) AS place, regexp_replace(unnest(parts), '^\s+|\s+$', '', 'g') AS part
    FROM (SELECT id, category, string_split(CASE WHEN category = 'out_of_scope' THEN '' ELSE coalesce(draft_citation, '') END, ';') AS parts FROM golden_set)
  ) WHERE part <> ''
)"""

RECALL = HYBRID + f""", {REQUIRED},
cited AS (SELECT m.query_id, m.rank, {citation_key('c.citation')} AS key FROM merged m JOIN corpus c USING (chunk_id)),
met AS (
  SELECT r.query_id, count(DISTINCT r.n) AS h, min(c.rank) AS r FROM req r JOIN cited c
  ON c.query_id = r.query_id AND (starts_with(r.req_key, c.key) OR starts_with(c.key, r.req_key)) GROUP BY r.query_id
),
recall_rows AS (
  SELECT g.id, g.category, CASE WHEN a.n IS NOT NULL THEN coalesce(m.h, 0)::DOUBLE / a.n END AS recall,
    CASE WHEN a.n IS NOT NULL THEN coalesce(1.0::DOUBLE / m.r, 0.0) END AS mrr
  FROM golden_set g LEFT JOIN (SELECT query_id, count(*) AS n FROM req GROUP BY query_id) a ON a.query_id = g.id LEFT JOIN met m ON m.query_id = g.id
)"""

SPOKEN = f"""WITH {CORPUS},
held AS (SELECT DISTINCT r.query_id, c.citation FROM retrieved r JOIN corpus c USING (chunk_id)),
said AS (SELECT f.query_id, c.text FROM (SELECT query_id, min(chunk_id) AS chunk_id FROM retrieved WHERE rank = 1 GROUP BY query_id) f JOIN corpus c USING (chunk_id))"""

MENTIONS = SPOKEN + f""",
found AS (SELECT query_id, unnest(range(len(ms)))::BIGINT AS place, unnest(ms) AS mention FROM (SELECT query_id, regexp_extract_all(text, '{MENTION}', 1) AS ms FROM said)),
firsts AS (SELECT query_id, {mention_key('mention')} AS key, arg_min(mention, place) AS mention, min(place) AS ord FROM found GROUP BY ALL),
borne AS (
  SELECT query_id, mention, ord FROM firsts f
  WHERE EXISTS (SELECT 1 FROM held h WHERE h.query_id = f.query_id AND (starts_with({mention_key('h.citation')}, f.key) OR starts_with(f.key, {mention_key('h.citation')})))
)"""

# answers of the stand-in: sentences that share two longer words with the question
SAID = RECALL + f""",
ask AS (SELECT id AS query_id, list_distinct(regexp_extract_all(lower(coalesce(question, '')), '[a-z0-9]{{5,}}')) AS asked FROM golden_set),
blocks AS (
  SELECT m.query_id, m.rank, m.chunk_id, coalesce(c.citation, '') AS head,
    list_filter(string_split(coalesce(c.text, ''), '. '), lambda x: len(list_intersect(list_distinct(regexp_extract_all(lower(x), '[a-z0-9]{{5,}}')), a.asked)) >= 2)[1] AS sentence
  FROM merged m JOIN corpus c USING (chunk_id) JOIN ask a USING (query_id)
),
spoken AS (
  SELECT query_id, string_agg(sentence || ' (' || head || ').', ' ' ORDER BY n) AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS n FROM blocks WHERE sentence IS NOT NULL) WHERE n <= 3 GROUP BY query_id
),
said AS (SELECT g.id AS query_id, regexp_replace(coalesce(s.text, '{REFUSAL}'), '^[\\s]+|[\\s]+$', '', 'g') AS text FROM golden_set g LEFT JOIN spoken s ON s.query_id = g.id),
held AS (SELECT DISTINCT m.query_id, c.citation FROM merged m JOIN corpus c USING (chunk_id)),
found AS (SELECT query_id, unnest(range(len(ms)))::BIGINT AS place, unnest(ms) AS mention FROM (SELECT query_id, regexp_extract_all(text, '{MENTION}', 1) AS ms FROM said)),
firsts AS (SELECT query_id, {mention_key('mention')} AS key, arg_min(mention, place) AS mention, min(place) AS ord FROM found GROUP BY ALL),
borne AS (
  SELECT query_id, mention, ord FROM firsts f
  WHERE EXISTS (SELECT 1 FROM held h WHERE h.query_id = f.query_id AND (starts_with({mention_key('h.citation')}, f.key) OR starts_with(f.key, {mention_key('h.citation')})))
),
answers AS (SELECT s.query_id, s.text, coalesce(list(b.mention ORDER BY b.ord) FILTER (b.mention IS NOT NULL), []) AS citations, contains(s.text, '{REFUSAL}') AS refused FROM said s LEFT JOIN borne b USING (query_id) GROUP BY ALL)"""

SCORED_ITEMS = SAID + f""",
given AS (SELECT DISTINCT query_id, {citation_key('c')} AS key FROM (SELECT query_id, unnest(citations) AS c FROM answers)),
right_ AS (SELECT r.query_id, count(DISTINCT r.n) AS h FROM req r JOIN given c ON c.query_id = r.query_id AND (starts_with(r.req_key, c.key) OR starts_with(c.key, r.req_key)) GROUP BY r.query_id),
tokens_ AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(text, '{TOKEN}', 1))) AS token FROM said),
wrong_ AS (SELECT query_id, list(token ORDER BY token) AS tokens FROM tokens_ t WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.query_id = t.query_id AND {citation_key('h.citation')} = {citation_key('t.token')}) GROUP BY query_id),
seen AS (SELECT query_id, lower(string_agg('[' || coalesce(citation, '') || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank, chunk_id)) AS context FROM merged JOIN corpus USING (chunk_id) GROUP BY query_id),
judged AS (
  SELECT a.query_id, regexp_extract_all(lower(a.text), '[a-z0-9]{{6,}}') AS ws, list_filter(regexp_extract_all(lower(a.text), '[a-z0-9]{{6,}}'), lambda w: contains(coalesce(s.context, ''), w)) AS hs
  FROM answers a LEFT JOIN seen s USING (query_id) WHERE NOT a.refused
)"""

LEVELED = rf"""leveled AS (
  SELECT regexp_replace(citation, '\(.*$', '') AS doc, pos AS seq, greatest(len(labels), 1) AS level, coalesce(labels[len(labels)], '?') AS label, coalesce(text, '') AS text
  FROM (SELECT *, regexp_extract_all(citation, '\(([A-Za-z0-9]+)\)', 1) AS labels FROM corpus WHERE lower(trim(source_type)) IN ('statute', 'regulation'))
)"""


def levels(seq: str) -> str:
    w = "OVER (PARTITION BY doc ORDER BY seq ROWS UNBOUNDED PRECEDING)"
    parts = [
        f"""CASE WHEN max(seq) FILTER (level = {n}) {w} > coalesce(max(seq) FILTER (level < {n}) {w}, -1)
        THEN '{n}:' || last_value(CASE WHEN level = {n} THEN label END IGNORE NULLS) {w} END"""
        for n in range(1, 7)
    ]
    return f"SELECT doc, {seq} AS seq, concat_ws('/', {', '.join(parts)}) AS path, text FROM leveled"


DOC = r"regexp_replace(citation, '( —|\().*$', '')"
FURNITURE_SQL = "(?i)" + "|".join(f"(?:{p})" for p in FURNITURE)


def sections(order: str) -> str:
    """From lines (doc, order columns, text, is_heading)."""
    return f"""kept AS (SELECT * REPLACE (trim(text) AS text) FROM flagged WHERE trim(text) <> '' AND NOT regexp_matches(trim(text), '{FURNITURE_SQL}')),
islands AS (SELECT *, sum(is_heading::INT) OVER (PARTITION BY doc ORDER BY {order} ROWS UNBOUNDED PRECEDING)::BIGINT AS section_no FROM kept),
parts AS (
  SELECT doc, section_no, coalesce(max(text) FILTER (is_heading), 'Introduction') AS heading, string_agg(text, ' ' ORDER BY {order}) FILTER (NOT is_heading) AS text
  FROM islands GROUP BY doc, section_no
)"""


LINES = "lines AS (SELECT doc_id AS doc, unnest(range(len(ls)))::BIGINT AS line_no, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"

ORACLE_SQL: dict[str, str] = {
    "registry_join": "SELECT filename, citation_prefix, source_type, authority_weight, url FROM registry",
    "chunks_by_document": f"""WITH {CORPUS} SELECT r.filename, count(*) AS n_chunks, round(sum(r.authority_weight), 4) AS weight
        FROM (SELECT {DOC} AS citation_prefix FROM corpus) c JOIN registry r USING (citation_prefix) GROUP BY r.filename""",
    "corpus_scan": f"WITH {CORPUS} SELECT chunk_id, citation, pos, length(text) AS n_chars FROM corpus",
    "golden_head": "SELECT id, category, question FROM golden_set ORDER BY id LIMIT 25",
    "upserted_vectors": "SELECT chunk_id, max(embedded_at) AS embedded_at, len(arg_max(ROW(embedding), embedded_at)[1]) AS width FROM chunk_vectors GROUP BY chunk_id",
    "embedding_drift_check": """SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, CASE WHEN b.chunk_id IS NULL THEN 'missing' ELSE 'stale' END AS state
        FROM (SELECT DISTINCT chunk_id FROM chunks) a FULL JOIN (SELECT DISTINCT chunk_id FROM chunk_vectors) b ON a.chunk_id = b.chunk_id WHERE a.chunk_id IS NULL OR b.chunk_id IS NULL""",
    "latest_runs": "SELECT config, arg_max(run_id, ROW(scored_at, run_id)) AS run_id, max(scored_at) AS last_at FROM eval_results GROUP BY config",
    "resume_anti_join": """WITH runs AS (SELECT config, arg_max(run_id, ROW(scored_at, run_id)) AS run_id FROM eval_results GROUP BY config)
        SELECT r.config, g.id FROM runs r CROSS JOIN golden_set g WHERE NOT EXISTS (SELECT 1 FROM eval_results e WHERE e.config = r.config AND e.run_id = r.run_id AND e.id = g.id)""",
    "flat_level_paths": f"WITH {CORPUS}, {LEVELED} SELECT doc, seq, path FROM ({levels('seq')}) WHERE trim(text) <> ''",
    "html_paragraph_paths": f"""WITH {CORPUS}, {LEVELED} SELECT doc AS filename, seq, path FROM ({levels('row_number() OVER (PARTITION BY doc ORDER BY seq) - 1')})
        WHERE regexp_replace(text, '[\\s]+', '', 'g') <> ''""",
    "slug_and_dedupe_ids": rf"""WITH {CORPUS}, s AS (SELECT pos AS seq, {DOC} AS doc, regexp_replace(regexp_replace(lower(citation), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM corpus),
        n AS (SELECT *, row_number() OVER (PARTITION BY doc, slug ORDER BY seq) AS nth FROM s) SELECT seq, CASE WHEN nth = 1 THEN slug ELSE slug || '-' || nth END AS chunk_id FROM n""",
    "heading_segments": rf"""WITH {LINES}, flagged AS (SELECT *, len(regexp_extract_all(text, '[^ \t]+')) <= 12 AND regexp_matches(text, '[A-Za-z]{{3,}}') AND NOT regexp_matches(rtrim(text), '[.;:,!?]$') AS is_heading FROM lines),
        {sections('line_no')} SELECT doc AS doc_id, section_no, heading, text FROM parts WHERE trim(text) <> ''""",
    "pdf_sections": rf"""WITH {LINES}, wl AS (SELECT doc::VARCHAR AS doc, line_no, (line_no // 40)::INTEGER AS page, regexp_extract_all(text, '[^ \t\r]+') AS w, CASE WHEN upper(text) = text THEN 14.0 ELSE 10.0 END AS size FROM lines),
        pl AS (SELECT * FROM wl WHERE len(w) > 0),
        sizes AS (SELECT doc, page, size, sum(len(w)) AS n, min(line_no) AS f FROM pl GROUP BY ALL),
        body AS (SELECT doc, page, arg_min(size, ROW(-n, f)) AS body_size FROM sizes GROUP BY ALL),
        flagged AS (SELECT pl.doc, page, line_no, array_to_string(w, ' ') AS text, len(w) <= 12 AND regexp_matches(array_to_string(w, ' '), '[A-Za-z]{{3,}}') AND (size > body_size + 1.0 OR line_no % 11 = 0) AS is_heading FROM pl JOIN body USING (doc, page)),
        {sections('page, line_no')} SELECT doc, section_no, heading, text FROM parts WHERE trim(text) <> ''""",
    "modal_sizes": """SELECT l_orderkey, arg_min(q, ROW(-n, p, q)) AS body_size FROM (SELECT l_orderkey, l_quantity AS q, count(*) AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""",
    "word_lines": """SELECT l_orderkey, round_even(l_extendedprice / 10000, 0)::BIGINT AS line_top, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_discount, l_partkey, l_quantity) AS text,
        count(*) AS n_words, round(avg(l_quantity), 6) AS avg_size, 1.0::DOUBLE AS bold FROM lineitem GROUP BY ALL""",
    "html_sections": rf"""WITH {CORPUS} SELECT chunk_id, array_to_string(regexp_extract_all(citation, '\(([A-Za-z0-9]+)\)', 1), '/') AS path, regexp_replace(text, '^[\s]+|[\s]+$', '', 'g') AS text
        FROM corpus WHERE text IS NOT NULL AND regexp_replace(text, '[\s]+', '', 'g') <> ''""",
    "tokenize_stopwords": f"WITH {CORPUS} SELECT chunk_id, len({words('text')}) AS dl, array_to_string({words('citation')}, ' ') AS words FROM corpus",
    "term_stats": f"""WITH {CORPUS}, asked AS (SELECT id AS query_id, question FROM golden_set), {bm25('asked', 1).strip()} SELECT term, df, round(idf, 6) AS idf FROM terms""",
    "term_postings": f"""WITH {CORPUS}, asked AS (SELECT id AS query_id, question FROM golden_set), {bm25('asked', 1).strip()} SELECT term, chunk_id, tf, dl FROM postings""",
    "bm25_topk": f"""WITH {CORPUS}, asked AS (SELECT id AS query_id, question FROM golden_set), {bm25('asked', 20).strip()}
        SELECT query_id, chunk_id, round(score, 6) AS score, rank, retriever FROM sparse""",
    "dense_cosine_topk": """SELECT query_id, vec_id, round(score, 5) AS score, rank::INTEGER AS rank, 'dense' AS retriever FROM (
        SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score,
          row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank
        FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 50 = 0) WHERE rank <= 20""",
    "rrf_fusion": f"WITH {FUSED} SELECT query_id, chunk_id, round(score, 9) AS score, rank, retriever FROM fused",
    "authority_reorder": f"""WITH {CORPUS}, {FUSED} SELECT f.query_id, f.chunk_id, round(f.score, 9) AS score,
        row_number() OVER (PARTITION BY f.query_id ORDER BY f.score DESC, c.authority_weight DESC NULLS LAST, f.rank)::INTEGER AS rank, f.retriever, c.authority_weight FROM fused f LEFT JOIN corpus c USING (chunk_id)""",
    "tax_year_filter": f"""WITH {CORPUS}, {FUSED}, years AS (SELECT query_id, year(min(asked_at)) - 3 AS y FROM retrieved GROUP BY query_id)
        SELECT f.query_id, f.chunk_id, round(f.score, 9) AS score, f.rank, f.retriever FROM fused f JOIN corpus c USING (chunk_id) JOIN years USING (query_id)
        WHERE (tax_year_start IS NULL OR y >= least(tax_year_start, tax_year_end)) AND (tax_year_end IS NULL OR y <= greatest(tax_year_start, tax_year_end))""",
    "citation_parse": f"""WITH {CORPUS}, every AS (SELECT chunk_id AS id, citation FROM corpus UNION ALL SELECT id, draft_citation FROM golden_set)
        SELECT id, section, array_to_string(path, '/') AS path, pid FROM ({parsed('id', 'citation', 'every')})""",
    "provision_map": f"WITH {CORPUS}, {PROVISIONS.strip()} SELECT pid, chunk_id, first_pos FROM known",
    "citation_descendants": f"""WITH {CORPUS}, {ASKED}, {PROVISIONS.strip()},
        named AS (SELECT query_id, section, pid FROM ({parsed('query_id', 'question', 'asked')}) WHERE pid IS NOT NULL),
        both_ AS (SELECT query_id, pid FROM named UNION ALL SELECT query_id || '/section', 'irc-' || section FROM named),
        hits AS (SELECT t.query_id, k.pid, k.chunk_id, len(k.path) AS depth FROM both_ t JOIN known k ON starts_with(k.pid, t.pid || '-'))
        SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.query_id = h.query_id AND starts_with(h.pid, o.pid || '-'))""",
    "citation_lookup": f"WITH {CORPUS}, {ASKED}, {PROVISIONS.strip()}, {LOOKUP.strip()} SELECT query_id, chunk_id, ord FROM looked",
    "stream_lookup": f"WITH {CORPUS}, {ASKED}, {PROVISIONS.strip()}, {LOOKUP.strip()} SELECT query_id, chunk_id, ord FROM looked",
    "hybrid_with_citation": f"{HYBRID} {RESULT} FROM merged",
    "sparse_with_citation": f"WITH {CORPUS}, {ASKED}, {PROVISIONS.strip()}, {LOOKUP.strip()}, {bm25('asked', 5).strip()}, {merged('sparse')} {RESULT} FROM merged",
    "hybrid_in_force": f"""{LISTS}, valid AS (
          SELECT m.*, c.authority_weight FROM mixed m JOIN corpus c USING (chunk_id) JOIN golden_set g ON g.id = m.query_id
          WHERE g.tax_year IS NULL OR ((tax_year_start IS NULL OR g.tax_year >= least(tax_year_start, tax_year_end)) AND (tax_year_end IS NULL OR g.tax_year <= greatest(tax_year_start, tax_year_end)))
        ), again AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, authority_weight DESC NULLS LAST, rank)::INTEGER AS rank) FROM valid)
        {RESULT} FROM again WHERE rank <= 5""",
    "ablation_matrix": f"""{LISTS}, {merged('mixed')}, {merged('(SELECT * FROM dense WHERE rank <= 5)', 'dense_first')}, {merged('(SELECT * FROM sparse WHERE rank <= 5)', 'sparse_first')}
        {RESULT}, 'hybrid' AS config FROM merged UNION ALL {RESULT}, 'dense_only' FROM dense_first UNION ALL {RESULT}, 'bm25_only' FROM sparse_first""",
    "embed_hash_udf": f"""WITH {CORPUS}, {hashed('chunk_id', "coalesce(text, '')", 'corpus', 'cv')}
        SELECT chunk_id, string_agg(coalesce(v, 0)::INTEGER::VARCHAR, ',' ORDER BY i) AS embedding FROM (SELECT chunk_id, unnest(range({DIM})) AS i FROM corpus) LEFT JOIN (SELECT chunk_id, dim AS i, v FROM cv) USING (chunk_id, i) GROUP BY chunk_id""",
    "embed_questions": f"""WITH asked AS (SELECT id AS query_id, question FROM golden_set), {hashed('query_id', QUESTION, 'asked', 'qv')}
        SELECT query_id, string_agg(coalesce(v, 0)::INTEGER::VARCHAR, ',' ORDER BY i) AS embedding FROM (SELECT query_id, unnest(range({DIM})) AS i FROM asked) LEFT JOIN (SELECT query_id, dim AS i, v FROM qv) USING (query_id, i) GROUP BY query_id""",
    "vector_store": "SELECT chunk_id, max(embedded_at) AS embedded_at, len(arg_max(ROW(embedding), embedded_at)[1]) AS width FROM chunk_vectors GROUP BY chunk_id",
    "corpus_build": rf"""WITH {CORPUS}, reg AS (SELECT *, row_number() OVER (ORDER BY filename) AS doc_pos FROM registry),
        rows_ AS (
          SELECT r.filename, r.doc_pos, r.citation_prefix, r.source_type, r.authority_weight, r.url, c.citation, c.pos, lower(trim(c.source_type)) AS kind,
            regexp_extract_all(c.citation, '\(([A-Za-z0-9]+)\)', 1) AS labels, trim(regexp_replace(c.text, '\s+', ' ', 'g')) AS body
          FROM (SELECT *, {DOC} AS citation_prefix FROM corpus WHERE length(trim(text)) > 0) c JOIN reg r USING (citation_prefix)
        ),
        leveled AS (SELECT filename AS doc, row_number() OVER (PARTITION BY filename ORDER BY pos) - 1 AS seq, greatest(len(labels), 1) AS level, coalesce(labels[len(labels)], '?') AS label, body AS text FROM rows_ WHERE kind = 'regulation'),
        regulations AS ({levels('seq')}),
        sections_ AS (
          SELECT filename, pos AS seq, array_to_string(list_transform(labels, lambda x: '(' || x || ')'), '') AS marks, array_to_string(list_transform(labels, lambda x: '(' || x || ')'), ' > ') AS steps, NULL AS heading, body FROM rows_ WHERE kind = 'statute'
          UNION ALL SELECT doc, seq, '(' || replace(regexp_replace(path, '[0-9]+:', '', 'g'), '/', ')(') || ')', '(' || replace(regexp_replace(path, '[0-9]:', '', 'g'), '/', ') > (') || ')', NULL, text FROM regulations
          UNION ALL SELECT filename, pos, '', '', coalesce(nullif(regexp_extract(citation, ' — (.*)$', 1), ''), 'Introduction'), body FROM rows_ WHERE kind NOT IN ('statute', 'regulation')
        ),
        cited AS (
          SELECT s.filename, r.doc_pos, s.seq, r.source_type, r.authority_weight, r.url, CASE WHEN heading IS NULL THEN r.citation_prefix || marks ELSE r.citation_prefix || ' — ' || heading END AS citation,
            CASE WHEN heading IS NOT NULL THEN r.citation_prefix || ' > ' || heading WHEN steps = '' THEN r.citation_prefix ELSE r.citation_prefix || ' > ' || steps END || ' — ' || body AS text
          FROM sections_ s JOIN reg r USING (filename) WHERE body <> ''
        ),
        slugs AS (SELECT *, regexp_replace(regexp_replace(lower(citation), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM cited),
        nth AS (SELECT *, row_number() OVER (PARTITION BY filename, slug ORDER BY seq) AS n, row_number() OVER (ORDER BY doc_pos, seq) - 1 AS pos FROM slugs)
        SELECT CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS chunk_id, citation, text, source_type, authority_weight, url, pos FROM nth""",
    "context_build": CONTEXT + " SELECT query_id, context FROM contexts",
    "prompts": CONTEXT + f" SELECT query_id, '{PROMPT_HEAD}' || context || chr(10) || chr(10) || 'Question: question ' || query_id AS prompt, contains(context, '{REFUSAL}') AS refused FROM contexts",
    "mention_extraction": MENTIONS + " SELECT query_id, mention, ord FROM borne",
    "grounded_citations": MENTIONS + " SELECT s.query_id, coalesce(list(b.mention ORDER BY b.ord) FILTER (b.mention IS NOT NULL), []) AS citations FROM said s LEFT JOIN borne b USING (query_id) GROUP BY s.query_id",
    "hallucinated_citations": SPOKEN + f""", t AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(text, '{TOKEN}', 1))) AS token FROM said)
        SELECT query_id, token FROM t WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.query_id = t.query_id AND {citation_key('h.citation')} = {citation_key('t.token')})""",
    "extractive_answers": SAID + f" SELECT query_id, text, citations, refused, CASE WHEN refused THEN '{REFUSAL_REASON}' END AS refusal_reason, 'extractive' AS model, 0.0::DOUBLE AS cost_usd FROM answers",
    "full_run": SCORED_ITEMS + """ SELECT g.id, g.category, round(g.recall, 6) AS recall_at_5, round(g.mrr, 6) AS mrr,
          round(CASE WHEN n.n IS NOT NULL THEN coalesce(r.h, 0)::DOUBLE / n.n END, 6) AS citation_accuracy, a.refused, 0.0::DOUBLE AS cost_usd,
          (5 * len(j.hs) >= 4 * len(j.ws))::INTEGER AS groundedness, CASE WHEN j.ws IS NOT NULL THEN 1 END AS premise_correction, len(j.hs) || ' of ' || len(j.ws) || ' words' AS judge_reasoning,
          coalesce(w.tokens, []) AS hallucinated_citations
        FROM recall_rows g JOIN answers a ON a.query_id = g.id LEFT JOIN (SELECT query_id, count(*) AS n FROM req GROUP BY query_id) n ON n.query_id = g.id
        LEFT JOIN right_ r ON r.query_id = g.id LEFT JOIN wrong_ w ON w.query_id = g.id LEFT JOIN judged j ON j.query_id = g.id""",
    "required_keys": f"WITH {REQUIRED} SELECT query_id, category, n, req_key FROM req",
    "citation_keys": f"WITH {CORPUS} SELECT chunk_id, {citation_key('citation')} AS citation_key, {mention_key('citation')} AS mention_key FROM corpus",
    "recall_mrr": RECALL + " SELECT id, category, round(recall, 6) AS recall, round(mrr, 6) AS mrr FROM recall_rows",
    "recall_mrr_by_category": RECALL + " SELECT coalesce(category, 'all') AS category, count(*) AS questions, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr FROM recall_rows GROUP BY ROLLUP (category)",
    "citation_accuracy": f"""WITH {SCORED}, {REQUIRED}, c AS (SELECT DISTINCT id AS query_id, {citation_key('c')} AS key FROM (SELECT id, unnest(hallucinated_citations) AS c FROM scored)),
        met AS (SELECT r.query_id, count(DISTINCT r.n) AS h FROM req r JOIN c ON c.query_id = r.query_id AND (starts_with(r.req_key, c.key) OR starts_with(c.key, r.req_key)) GROUP BY r.query_id)
        SELECT g.id, round(CASE WHEN a.n IS NOT NULL THEN coalesce(m.h, 0)::DOUBLE / a.n END, 6) AS citation_accuracy
        FROM golden_set g LEFT JOIN (SELECT query_id, count(*) AS n FROM req GROUP BY query_id) a ON a.query_id = g.id LEFT JOIN met m ON m.query_id = g.id""",
    "run_summary": f"""WITH {SCORED} SELECT run_id, config, count(*) AS questions, round(avg(recall_at_5), 6) AS recall_at_5, round(avg(mrr), 6) AS mrr, round(avg(citation_accuracy), 6) AS citation_accuracy,
        round(avg(groundedness), 6) AS groundedness, round(avg(premise_correction), 6) AS premise_correction,
        round(avg(CASE WHEN hallucinated_citations IS NOT NULL THEN (len(hallucinated_citations) > 0)::INT END), 6) AS hallucination_rate,
        round(avg((category = 'out_of_scope')::INT) FILTER (refused), 6) AS refusal_precision, count(*) FILTER (refused) AS refused, round(sum(cost_usd), 4) AS cost_usd FROM scored GROUP BY run_id, config""",
    "eval_by_category": f"""WITH {SCORED} SELECT config, CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS category, count(*) AS questions, round(avg(recall_at_5), 6) AS recall_at_5, round(avg(mrr), 6) AS mrr
        FROM scored GROUP BY GROUPING SETS ((config, category), (config))""",
    "judge_json_parse": f"""WITH {SCORED} SELECT run_id, id, 'json' AS form, groundedness, premise_correction, judge_reasoning AS reasoning FROM scored
        UNION ALL SELECT run_id, id, 'left', json_extract_string(try_cast(judge_reasoning AS JSON), '$.groundedness')::INTEGER, json_extract_string(try_cast(judge_reasoning AS JSON), '$.premise_correction')::INTEGER,
          CASE WHEN try_cast(judge_reasoning AS JSON) IS NULL THEN 'unparseable judge output: ' || judge_reasoning ELSE json_extract_string(try_cast(judge_reasoning AS JSON), '$.reasoning') END
        FROM scored WHERE judge_reasoning IS NOT NULL""",
}
