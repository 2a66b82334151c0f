"""The queries again, in DuckDB's SQL, by other means: tokens by splitting, neighbours by windows."""

from __future__ import annotations

from .queries import ASKED, PATTERNS, PHRASES, SPELLED


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_ASKED = "q(query_id, query) AS (VALUES " + ", ".join(f"({i}, {_text(q)})" for i, q in ASKED) + ")"
#: b has one character for each byte of the text: what isn't ASCII becomes blanks.
_BYTES = r"""bytes AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
    '[\x{80}-\x{7FF}]', '  ', 'g'), '[\x{800}-\x{FFFF}]', '   ', 'g'), '[\x{10000}-\x{10FFFF}]', '    ', 'g') AS b FROM documents)"""
_TOKENS = (
    _BYTES
    + r""",
parts AS (SELECT doc_id, unnest(s) AS part, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split_regex(b, '[^A-Za-z0-9]') AS s FROM bytes)),
toks AS (
  SELECT doc_id, lower(part) AS term, off FROM (
    SELECT doc_id, part, (sum(len(part) + 1) OVER (PARTITION BY doc_id ORDER BY i) - len(part) - 1)::BIGINT AS off FROM parts)
  WHERE part <> ''),
post AS (SELECT term, doc_id, count(*) AS tf, list(off ORDER BY off)[1:128] AS offsets FROM toks GROUP BY ALL),
stats AS (
  SELECT b.doc_id, strlen(b.text)::BIGINT AS body_len, coalesce(n, 0) AS token_count
  FROM bytes b LEFT JOIN (SELECT doc_id, count(*) AS n FROM toks GROUP BY ALL) t USING (doc_id)),
corpus AS (SELECT count(*) AS n_docs, coalesce(sum(token_count), 0)::BIGINT AS total_tokens, coalesce(avg(token_count), 0) AS avg_len FROM stats)"""
)
_BM25 = "idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (token_count / avg_len)))"
_TFIDF = "tf * idf / CASE WHEN token_count = 0 THEN 1 ELSE token_count END"


def _ranked(part: str = _BM25, order: str = "base_score DESC, score DESC", asked: str = _ASKED) -> str:
    return f"""{_TOKENS}, {asked},
qt AS (SELECT query_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS qi FROM (SELECT query_id, regexp_extract_all(lower(query), '[a-z0-9]+') AS t FROM q)),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
hits AS (
  SELECT query_id, qi, term, doc_id, offsets, {part} AS part
  FROM qt JOIN post USING (term) JOIN stats USING (doc_id), corpus, LATERAL (SELECT ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM dfs WHERE dfs.term = qt.term) w),
base AS (SELECT query_id, doc_id, list_sum(list(part ORDER BY qi)) AS base_score, min(offsets[1]) AS first_off FROM hits GROUP BY ALL),
places AS (SELECT query_id, doc_id, qi, unnest(offsets) AS off FROM hits),
pairs AS (
  SELECT query_id, doc_id, off - lag(off) OVER w AS gap, lag(off) OVER w AS prev, off, qi <> lag(qi) OVER w AS apart
  FROM places WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY off, qi)),
near AS (
  SELECT query_id, doc_id, gap, (prev + off + 1) // 2 AS center FROM pairs WHERE apart
  QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY gap, prev) = 1),
boosted AS (
  SELECT query_id, doc_id, base_score, CASE WHEN gap IS NULL THEN base_score ELSE base_score * (1 + 0.3::DOUBLE / (1 + ln(1 + gap))) END AS score, gap, coalesce(center, first_off) AS match_offset
  FROM base LEFT JOIN near USING (query_id, doc_id)),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {order}, doc_id)::INT AS rank, * EXCLUDE (query_id) FROM boosted
  QUALIFY rank <= 10)"""


_SHOWN = "SELECT query_id, rank, doc_id, round(base_score, 6) AS base_score, round(score, 6) AS score, gap, match_offset FROM ranked"


def _snippets(window: int) -> str:
    return (
        _ranked()
        + rf""",
views AS (SELECT r.*, b.text, b.b, strlen(b.text) AS n FROM ranked r JOIN bytes b USING (doc_id)),
bounds AS (
  SELECT *, greatest(0, least(match_offset - {window}, n)) AS low, greatest(0, least(match_offset + {window}, n)) AS high, greatest(0, least(match_offset, n)) AS here FROM views),
cuts AS (
  SELECT *, len(regexp_extract(b[1:low], '(?s)^.*[\n.!?]')) AS before,
    CASE WHEN regexp_matches(b[low + 1:here], '[\n.!?]') THEN len(regexp_extract(b[low + 1:here], '(?s)^[^\n.!?]*[\n.!?]')) ELSE 0 END AS inside,
    CASE WHEN regexp_matches(b[high + 1:n], '[\n.!?]') THEN len(regexp_extract(b[high + 1:n], '(?s)^[^\n.!?]*[\n.!?]')) ELSE 0 END AS after FROM bounds),
ends AS (
  SELECT *, CASE WHEN before > 0 THEN before WHEN inside > 0 THEN low + inside ELSE 0 END AS s, CASE WHEN after > 0 THEN high + after ELSE n END AS e FROM cuts),
sliced AS (SELECT query_id, rank, doc_id, score, match_offset, trim(decode(array_slice(encode(text), (s + 1)::BIGINT, greatest(e, s)::BIGINT)), chr(32) || chr(10) || chr(13) || chr(9)) AS snippet FROM ends)"""
    )


_RANGES = r"""
terms AS (SELECT query_id, term, qi FROM qt),
spots AS (
  SELECT s.query_id, s.rank, s.doc_id, t.term, t.qi, unnest(string_split(lower(s.snippet), t.term)) AS part,
    generate_subscripts(string_split(lower(s.snippet), t.term), 1) AS i FROM sliced s JOIN terms t USING (query_id)),
starts AS (
  SELECT * EXCLUDE (part), sum(len(part)) OVER w + (i - 1) * len(term) AS start, count(*) OVER (PARTITION BY query_id, rank, qi) AS n
  FROM spots WINDOW w AS (PARTITION BY query_id, rank, qi ORDER BY i)),
found AS (SELECT query_id, rank, term, qi, start::BIGINT AS start FROM starts WHERE i < n)"""


def _counts(patterns: tuple[str, ...], fold: bool) -> str:
    text = "lower(text)" if fold else "text"
    rows = []
    for p in patterns:
        # of a letter that is doubled, each run has one place fewer than letters; others don't overlap themselves
        n = f"len({text}) - len(regexp_replace({text}, '{p[0]}+', '{p[0]}', 'g'))" if len(p) == 2 and p[0] == p[1] else f"(len({text}) - len(replace({text}, {_text(p)}, ''))) // {len(p)}"
        rows.append(f"SELECT {_text(p)} AS label, coalesce(sum({n}), 0)::BIGINT AS n FROM documents")
    return " UNION ALL ".join(rows)


_KIND = """CASE WHEN octet_length(b) < 4 THEN 'unknown' WHEN hex(b)[1:8] = '25504446' THEN 'pdf' WHEN hex(b)[1:8] = '504B0304' THEN 'docx'
 WHEN regexp_extract(hex(b), '^(?:20|0A|0D|09)*(..)', 1) IN ('7B', '5B') THEN 'json' WHEN hex(b)[1:4] = '2320' THEN 'markdown' ELSE 'text' END"""


def _label(value: str, units: tuple[str, ...], base: int) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {base}::BIGINT ** {i} THEN format('{{:.1f}}{u}', {value} / ({base}::BIGINT ** {i})::DOUBLE)" for i, u in reversed(list(enumerate(units)))) + f" ELSE format('{{:.1f}}{units[0]}', {value}::DOUBLE) END"


ORACLE_SQL = {
    "bm25_search": f"WITH {_ranked()} {_SHOWN}",
    "tokens": f"WITH {_TOKENS} SELECT doc_id, term, off FROM toks",
    "index_build": f"WITH {_TOKENS} SELECT count(*) AS n_postings, count(DISTINCT term) AS n_terms, sum(tf)::BIGINT AS n_tokens, (SELECT n_docs FROM corpus) AS n_docs FROM post",
    "postings": f"WITH {_TOKENS} SELECT term, doc_id, tf, array_to_string(offsets, ',') AS offsets FROM post",
    "term_df": f"WITH {_TOKENS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM toks GROUP BY ALL",
    "doc_stats": f"WITH {_TOKENS} SELECT * FROM stats",
    "corpus_stats": f"WITH {_TOKENS} SELECT n_docs, total_tokens, round(avg_len, 6) AS avg_len FROM corpus",
    "tfidf_search": f"WITH {_ranked(_TFIDF)} {_SHOWN}",
    "boosted_rerank": f"WITH {_ranked(order='score DESC, base_score DESC')} {_SHOWN}",
    "snippets": f"WITH {_snippets(120)} SELECT query_id, rank, doc_id, match_offset, snippet FROM sliced",
    "match_ranges": f"""WITH {_snippets(60)}, {_RANGES},
firsts AS (SELECT query_id, rank, term, min(struct_pack(start := start, qi := qi)) AS f FROM found GROUP BY ALL)
SELECT s.query_id, s.rank, s.doc_id,
  coalesce((SELECT string_agg(start || '-' || (start + len(term)) || ':' || term, ' ' ORDER BY start, qi) FROM found f WHERE f.query_id = s.query_id AND f.rank = s.rank), '') AS ranges,
  coalesce((SELECT string_agg(term, ' ' ORDER BY f) FROM firsts f WHERE f.query_id = s.query_id AND f.rank = s.rank), '') AS matched
FROM sliced s""",
    "pattern_counts": _counts(PATTERNS, False),
    "pattern_counts_any_case": _counts(("the", "an"), True),
    "level_counts": "SELECT event_type AS label, count(*) AS n FROM events GROUP BY ALL",
    "sniff_types": f"""WITH bodies AS (
  SELECT encode(html) AS b FROM pages UNION ALL SELECT encode(text) FROM documents
  UNION ALL SELECT encode(h || html) FROM pages, (VALUES ('# '), (' ' || chr(10) || '{{'), ('%PDF-1.4'), ('PK' || chr(3) || chr(4))) v(h))
SELECT {_KIND} AS kind, count(*) AS n FROM bodies GROUP BY ALL""",
    "file_type_stats": r"""WITH p AS (SELECT regexp_extract(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '[^/]*$') AS f, url FROM pages),
l AS (SELECT CASE WHEN regexp_matches(f, '^.+\.[^.]+$') THEN upper(regexp_extract(f, '\.([^.]+)$', 1)) ELSE 'No ext' END AS label FROM p WHERE trim(url) <> '')
SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM l GROUP BY ALL""",
    "clean_markup": r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<w:binData[^>]*>.*?</w:binData>', '', 'g'),
  '\b[A-Za-z0-9+/]{120,}={0,2}\b', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')) AS text FROM pages""",
    "rag_bundle": f"""WITH {_snippets(40)}
SELECT query_id, string_agg(format('path: {{}}' || chr(10) || 'score: {{:.3f}}' || chr(10) || chr(10) || '{{}}', doc_id, score, snippet), chr(10) || chr(10) || '-----' || chr(10) || chr(10) ORDER BY rank) AS bundle
FROM sliced GROUP BY ALL""",
    "search_payloads": f"WITH {_ranked()} SELECT query_id, query, count(rank) AS n_results FROM q LEFT JOIN ranked USING (query_id) GROUP BY ALL",
    "catalog_labels": f"""WITH o AS (SELECT o_custkey AS id, count(*) * 997 AS n, (floor(sum(o_totalprice)) * 37)::BIGINT AS size, epoch(TIMESTAMP '2026-01-01') - epoch(max(o_orderdate)) AS age FROM orders GROUP BY ALL)
SELECT id, CASE WHEN n < 1000 THEN n::VARCHAR ELSE {_label("n", ("", "K", "M"), 1000)} END AS files, {_label("size", (" B", " KB", " MB", " GB"), 1024)} AS size,
  CASE WHEN age >= 86400 THEN (age // 86400)::BIGINT || 'd ago' WHEN age >= 3600 THEN (age // 3600)::BIGINT || 'h ago' WHEN age >= 60 THEN (age // 60)::BIGINT || 'm ago' ELSE 'Just now' END AS age FROM o""",
}


def _raw(source: str) -> str:
    return f"""WITH d AS ({source}), {_ASKED},
qt AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM q),
hits AS (
  SELECT query_id, doc_id, text, sum(len(string_split(lower(text), term)) - 1)::DOUBLE AS score, min(CASE WHEN strpos(lower(text), term) > 0 THEN strpos(lower(text), term) END) AS place
  FROM d, qt GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score, strlen(text[1:place - 1])::BIGINT AS match_offset
FROM hits WHERE score > 0 QUALIFY rank <= 10"""


ORACLE_SQL["raw_search"] = _raw("SELECT doc_id, coalesce(text, '') AS text FROM documents")
ORACLE_SQL["raw_search_conversations"] = _raw("SELECT conv_id * 1000 + turn AS doc_id, coalesce(text, '') AS text FROM conversations")


def _merged(source: str, keys: str) -> str:
    return rf"""WITH t AS (SELECT row_number() OVER () AS r, {keys}, lower(coalesce(text, '')) AS s FROM {source}),
hits AS (SELECT r, term, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM (SELECT r, term, string_split(s, term) AS parts FROM t, (VALUES ('the'), ('he'), ('en'), ('ti')) v(term))),
ranges AS (SELECT r, a AS lo, a + len(term) AS hi FROM (SELECT *, sum(len(part)) OVER (PARTITION BY r, term ORDER BY i) + (i - 1) * len(term) AS a FROM hits) WHERE i < n),
marked AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY r ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM ranges),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY r ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM marked),
merged AS (SELECT r, island, min(lo)::BIGINT AS lo, max(hi)::BIGINT AS hi FROM islands GROUP BY ALL)
SELECT {keys}, merged FROM (SELECT r, {keys}, coalesce(string_agg(lo || '-' || hi, ' ' ORDER BY lo), '') AS merged FROM t LEFT JOIN merged USING (r) GROUP BY ALL)"""


ORACLE_SQL["highlight_merge_documents"] = _merged("documents", "doc_id")
ORACLE_SQL["highlight_merge_conversations"] = _merged("conversations", "conv_id, turn")
_PASSAGES = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
ORACLE_SQL["bm25_batch"] = f"WITH {_ranked(asked=_PASSAGES)} {_SHOWN}"
ORACLE_SQL["bm25_pruned"] = ORACLE_SQL["bm25_search"]
ORACLE_SQL["bm25_batch_pruned"] = f"{ORACLE_SQL['bm25_batch']} WHERE rank <= 3"
ORACLE_SQL["packed_blocks"] = f"WITH {_TOKENS} SELECT term, count(DISTINCT doc_id) AS df, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM toks GROUP BY ALL"

#: The documents as the files of `queries._files` hold them.
_HELD = r"""files AS (
  SELECT doc_id, doc_id % 4 AS k, CASE doc_id % 4 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN regexp_replace(coalesce(text, ''), '[^\x00-\xFF]', '?', 'g')
    ELSE array_to_string(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), ' ') END AS t FROM documents)"""


def _places(text: str, pattern: str) -> str:
    return f"(len({text}) - len(replace({text}, '{pattern}', ''))) // {len(pattern)}"


ORACLE_SQL["extraction"] = f"WITH {_HELD} SELECT doc_id, trim(t, ' ') AS text, CASE WHEN t = '' THEN 'empty' ELSE 'ok' END AS extract_status FROM files"
ORACLE_SQL["counts_by_type"] = f"""WITH {_HELD}
SELECT 'compressedStreams' AS label, count(*) FILTER (k = 2) AS n FROM files
UNION ALL SELECT 'the', coalesce(sum({_places("t", "the")}) FILTER (k <> 2), 0)::BIGINT FROM files
UNION ALL SELECT 'token', coalesce(sum({_places("t", "token")}) FILTER (k <> 2), 0)::BIGINT FROM files"""
ORACLE_SQL["counts_by_type_levels"] = """SELECT event_type AS label, count(*) AS n FROM events GROUP BY ALL
UNION ALL SELECT 'compressedStreams', count(*) FROM documents WHERE doc_id % 4 = 2"""
ORACLE_SQL["archive_round_trip"] = "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, md5(coalesce(text, '')) AS md5 FROM documents"
ORACLE_SQL["ndjson_export"] = "SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents"
ORACLE_SQL["plain_listing"] = f"WITH {_snippets(40)} SELECT query_id, rank, '---' || chr(10) || doc_id || chr(10) || format('{{:.3f}}', score) || chr(10) || snippet AS line FROM sliced"
_PROMPTS = f"""WITH {_snippets(40)},
prompts AS (
  SELECT query_id, 'Answer the question from the context.' || chr(10) || chr(10) || 'Context:' || chr(10)
    || string_agg(snippet, chr(10) || chr(10) || '-----' || chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || any_value(query) || chr(10) || 'Answer:' AS prompt
  FROM sliced JOIN q USING (query_id) GROUP BY ALL)"""
ORACLE_SQL["prompts"] = f"{_PROMPTS} SELECT query_id, prompt FROM prompts"
ORACLE_SQL["answers"] = f"{_PROMPTS} SELECT query_id, len(prompt)::VARCHAR AS answer FROM prompts"
ORACLE_SQL["search_payload_results"] = f"WITH {_snippets(40)} SELECT query_id, rank - 1 AS place, doc_id, round(score, 6) AS score, snippet, match_offset FROM sliced"
ORACLE_SQL["preview_positions"] = f"WITH {_ranked()} SELECT query_id, rank, round(greatest(0, least(1, match_offset / strlen(text)::DOUBLE)), 6) AS fraction FROM ranked JOIN bytes USING (doc_id)"
ORACLE_SQL["range_validation"] = """WITH r AS (
  SELECT l_orderkey, l_linenumber - 3 AS lo, CASE WHEN l_quantity < 45 THEN floor(l_quantity / 5)::INT END AS hi FROM lineitem),
ok AS (SELECT * FROM r WHERE lo >= 0 AND hi > lo),
marked AS (
  SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY l_orderkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM ok),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY l_orderkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM marked),
merged AS (SELECT l_orderkey, island, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM islands GROUP BY ALL),
lists AS (SELECT l_orderkey, sum(n)::BIGINT AS n_valid, string_agg(lo || '-' || hi, ' ' ORDER BY lo) AS merged FROM merged GROUP BY ALL)
SELECT o.l_orderkey, coalesce(n_valid, 0) AS n_valid, coalesce(merged, '') AS merged FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN lists USING (l_orderkey)"""
ORACLE_SQL["plain_texts"] = "SELECT conv_id, turn, role || ': ' || replace(regexp_replace(text, chr(27) || '\\[[0-9;]*m', '', 'g'), '**', '') AS text FROM conversations"
ORACLE_SQL["titles"] = "SELECT page_id, regexp_extract(url, '[^/]*$') AS title FROM pages"
ORACLE_SQL["top_types"] = """SELECT (l_linenumber + l_suppkey % 3)::VARCHAR AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM lineitem GROUP BY ALL ORDER BY n DESC, label LIMIT 4"""
ORACLE_SQL["fallback_highlights"] = """WITH t AS (SELECT conv_id, turn, lower(text) AS s FROM conversations),
hits AS (
  SELECT conv_id, turn, term, unnest(list_filter(range(0, len(s)), lambda i: s[i + 1:i + len(term)] = term)) AS lo FROM t, (VALUES ('ti'), ('th'), ('nn'), ('ana')) v(term)),
marked AS (
  SELECT conv_id, turn, lo, lo + len(term) AS hi,
    CASE WHEN lo <= max(lo + len(term)) OVER (PARTITION BY conv_id, turn ORDER BY lo, len(term) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM hits),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id, turn ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM marked),
merged AS (SELECT conv_id, turn, island, min(lo) AS lo, max(hi) AS hi FROM islands GROUP BY ALL)
SELECT t.conv_id, t.turn, coalesce(string_agg(lo || '-' || hi, ' ' ORDER BY lo), '') AS merged FROM t LEFT JOIN merged USING (conv_id, turn) GROUP BY ALL"""

_PHRASES = "q(query_id, query) AS (VALUES " + ", ".join(f"({i}, {_text(q)})" for i, q in PHRASES) + ")"
ORACLE_SQL["phrase_search"] = f"""WITH {_TOKENS}, {_PHRASES},
qt AS (SELECT query_id, len(t) AS size, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS qi FROM (SELECT query_id, regexp_extract_all(lower(query), '[a-z0-9]+') AS t FROM q)),
placed AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY off) - 1 AS nth FROM toks),
starts AS (SELECT query_id, doc_id, nth - qi AS start FROM placed JOIN qt USING (term) GROUP BY query_id, doc_id, nth - qi, size HAVING count(*) = size),
found AS (SELECT query_id, doc_id, count(*) AS n, min(start) AS first FROM starts GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id)::INT AS rank, doc_id, n, first FROM found QUALIFY rank <= 10"""
ORACLE_SQL["conditional_search"] = f"""WITH {_TOKENS},
flags AS (
  SELECT doc_id, bool_or(term = 'of') AS of_, bool_or(term = 'tion') AS tion, bool_or(term = 'hain') AS hain, bool_or(starts_with(term, 'thea')) AS thea,
    bool_or(term = 'the') AS the, bool_or(term = 'only') AS only_, bool_or(term = 'and') AS and_ FROM toks GROUP BY ALL),
d AS (SELECT s.*, coalesce(of_, FALSE) AS of_, coalesce(tion, FALSE) AS tion, coalesce(hain, FALSE) AS hain, coalesce(thea, FALSE) AS thea, coalesce(the, FALSE) AS the, coalesce(only_, FALSE) AS only_, coalesce(and_, FALSE) AS and_
  FROM stats s LEFT JOIN flags USING (doc_id))
SELECT 'both' AS query_id, doc_id FROM d WHERE of_ AND tion
UNION ALL SELECT 'nested', doc_id FROM d WHERE (hain OR thea) AND NOT (the AND NOT only_)
UNION ALL SELECT 'none', doc_id FROM d WHERE NOT the AND NOT and_
UNION ALL SELECT 'long', doc_id FROM d WHERE and_ AND token_count > 500 AND body_len % 2 <> 0"""
ORACLE_SQL["fuzzy_terms"] = f"""WITH {_TOKENS}, w(word) AS (VALUES {", ".join(f"({_text(w)})" for w in SPELLED)})
SELECT word, term, count(*) AS df, levenshtein(word, term)::INT AS distance FROM post, w WHERE levenshtein(word, term) <= 2 GROUP BY ALL"""
ORACLE_SQL["raw_search_passages"] = _raw("SELECT doc_id, coalesce(text, '') AS text FROM documents").replace(_ASKED, _PASSAGES).replace("rank <= 10", "rank <= 3")
# words that don't overlap with themselves: the same letter or letters don't begin and end them
ORACLE_SQL["pattern_counts_many"] = """WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS label FROM (
  SELECT regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g') AS text FROM benchmark)),
w AS (SELECT label FROM t WHERE len(list_filter(range(1, len(label) // 2 + 1), lambda i: label[:i] = label[len(label) - i + 1:])) = 0)
SELECT label, coalesce(sum((len(text) - len(replace(text, label, ''))) // len(label)), 0)::BIGINT AS n FROM w LEFT JOIN documents ON contains(text, label) GROUP BY ALL"""
ORACLE_SQL["line_chunks"] = "SELECT md5(line) AS md5, count(*) AS n FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) GROUP BY ALL"
ORACLE_SQL["pdf_pages"] = """WITH w AS (SELECT doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), ' ') AS text FROM documents)
SELECT doc_id, 'pdf' AS kind, text, CASE WHEN text = '' THEN 'empty' ELSE 'ok' END AS extract_status FROM w"""
ORACLE_SQL["search_modes"] = f"""SELECT 'index' AS mode, query_id, rank, doc_id, match_offset FROM ({ORACLE_SQL["bm25_search"]})
UNION ALL SELECT 'scan', query_id, rank, doc_id, match_offset FROM ({ORACLE_SQL["raw_search"]})"""
ORACLE_SQL["index_changes"] = f"""WITH {_TOKENS},
live AS (SELECT doc_id, term, tf FROM post WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'changed', 1 FROM stats WHERE doc_id % 3 = 1),
summed AS (SELECT doc_id, term, sum(tf) AS tf FROM live GROUP BY ALL)
SELECT doc_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_tokens, sum(tf)::BIGINT AS token_count FROM summed GROUP BY ALL"""
ORACLE_SQL["catalog_entries"] = """SELECT n_nationkey::VARCHAR AS id, CASE WHEN n_regionkey = 1 THEN 'new ' || n_name ELSE n_name END AS name, n_regionkey::VARCHAR AS patterns FROM nation WHERE n_nationkey <> 3"""
