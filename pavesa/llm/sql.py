"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

WORDS = r"[w for w in regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+') if w <> '']"

#: Measurements of quality.ledger over a table ``src`` with a row number ``r``; windows are compared as text.
LEDGER = rf"""
w0 AS (SELECT *, {WORDS} AS ws, coalesce(text, '') AS tx FROM src),
win AS (SELECT r, i, array_to_string(ws[i:i+7], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w0 WHERE len(ws) >= 8)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, sum(CASE WHEN nxt IS NULL THEN 8 ELSE least(8, nxt - i) END) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM dup) GROUP BY r),
lines AS (SELECT r, [x for x in string_split(tx, chr(10)) if regexp_matches(x, '[^ \t\n\x0b\f\r]')] AS ls FROM w0),
m AS (
  SELECT w0.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(tx, '[ \t\n\x0b\f\r]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(tx) - length(translate(tx, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(length(regexp_replace(tx, '[^\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_upper
  FROM w0 JOIN lines USING (r) LEFT JOIN rep USING (r)),
ledger AS (
  SELECT *, CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars > 20 * n_words OR word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END) AS BIGINT) AS fail_bits
  FROM m)"""


def _esc(x: str) -> str:
    for plain, code in (("\\", "\\0"), ("<s>", "\\1"), ("</s>", "\\2"), ("[INST]", "\\3"), ("[/INST]", "\\4")):
        x = f"replace({x}, '{plain}', '{code}')"
    return x


#: Words of the lower-cased text for the benchmark; windows are compared as text, and a window's words are hit.
_TEST_WORDS = r"[w for w in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if w <> '']"

DECONTAMINATION = f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TEST_WORDS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(ws)) AS k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, {_TEST_WORDS} AS ws FROM documents),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k)),
h AS (SELECT doc_id, i, dw.k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
hw AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS w FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)"""

_LOWER_WORDS = WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

#: All pairs that share a shingle, by a join on shingles; groups by spreading the smallest id. ``documents`` may be another name.
NEAR_DUPLICATES = f"""w AS (SELECT doc_id, {_LOWER_WORDS} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM w WHERE len(ws) > 0)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
lk AS (SELECT a, b FROM pr JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
es AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk),
reach AS (SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT es.b, reach.r FROM reach JOIN es ON es.a = reach.a),
comp AS (SELECT d.doc_id, CAST(coalesce(sz.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM documents d LEFT JOIN sz USING (doc_id) JOIN (SELECT a AS doc_id, min(r) AS component_id FROM reach GROUP BY a) c USING (doc_id))"""

_BASE32 = "translate(" + " || ".join(f"upper(to_base(CAST('0x' || substr(d, {5 * i + 1}, 5) AS INTEGER), 32, 4))" for i in range(8)) + ", '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"

SQL: dict[str, str] = {
    "op2_odd_sketches": f"""WITH RECURSIVE {NEAR_DUPLICATES}
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM comp""",
    "op3_extendible_hashing": """WITH h AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, coalesce(strlen(text), 0) AS b, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT d, h >> (60 - d) AS p, sum(b) AS bytes FROM h, range(0, 61) AS r(d) GROUP BY d, p),
c AS (SELECT h.*, min(d) AS d FROM h JOIN s ON s.p = h.h >> (60 - s.d) WHERE s.bytes <= 1000000 OR s.d = 60 GROUP BY ALL)
SELECT doc_id, n_bytes, substr(bin(h + (1::BIGINT << 60)), 2, d) AS shard, CAST(bytes AS BIGINT) AS shard_bytes, bytes <= 1000000 AS fits FROM c JOIN s USING (d) WHERE s.p = c.h >> (60 - d)""",
    "op6_warc_revisits": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS d, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id) AS f, row_number() OVER (PARTITION BY html ORDER BY page_id) AS n FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN f END AS refers_to FROM h""",
    "op9_decontamination": f"""{DECONTAMINATION}
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
    "op12_source_divergence": rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
o AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, count(k.term) OVER w AS v, sum(coalesce(c.n, 0)) OVER w AS total
  FROM (SELECT DISTINCT lang, source FROM d UNION ALL SELECT DISTINCT lang, NULL FROM d) g LEFT JOIN k ON k.lang = g.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM o GROUP BY GROUPING SETS ((lang, source, term), (lang, term))) c ON c.lang = g.lang AND c.source IS NOT DISTINCT FROM g.source AND c.term = k.term
  WINDOW w AS (PARTITION BY g.lang, g.source)),
p AS (SELECT lang, source, term, n, CASE WHEN v > 0 THEN 1 + (1000000000::HUGEINT * (n + 1)) // (total + v) END AS p FROM v),
pr AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(((a.p - b.p) * (a.p - b.p)) // b.p), 0) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.source <> b.source AND a.term IS NOT DISTINCT FROM b.term GROUP BY ALL),
tm AS (SELECT a.lang, a.source, a.term AS item, ((a.p - b.p) * (a.p - b.p)) // b.p AS value FROM p a JOIN p b ON a.lang = b.lang AND a.source IS NOT NULL AND b.source IS NULL AND a.term = b.term WHERE a.n > 0 AND a.p > b.p),
x AS (SELECT lang, source, 'pair' AS part, item, value FROM pr UNION ALL SELECT lang, source, 'term', item, value FROM tm)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200""",
    "op4_quality_ledger": f"""WITH src AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents), {LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 55) = 0 AS kept, fail_bits FROM ledger""",
    "op10_reply_trees": f"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, '<s>' || replace({_esc('role')}, chr(10), '\\5') || chr(10)
  || CASE WHEN role = 'assistant' THEN {_esc('text')} ELSE '[INST] ' || {_esc('text')} || ' [/INST]' END || '</s>' AS piece FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(length(string_agg(piece, '' ORDER BY turn, role, text)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id""",
}
