"""DuckDB SQL for the queries that SQL can state. Words are given as a class, line breaks as chr(10)."""

from __future__ import annotations

from millrace.llm import fill_middle, license_scan, line_dedup, url_filter
from millrace.llm import quality_rules as rules

WORDS = r"'[^\x20\x09-\x0D]+'"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(values: list[bytes]) -> str:
    return ", ".join(f"'{v.decode()}'" for v in values)


_LOUD = " + ".join(f"length(line) - length(replace(line, '{c.decode()}', ''))" for c in rules.LOUD)
_PHRASES = " OR ".join(f"contains(low, '{p.decode()}')" for p in rules.BOILERPLATE)
_SYMBOLS = " + ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in rules.SYMBOLS)

QUALITY_RULES = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORDS}) AS words FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
parts AS (SELECT doc_id, i, line, translate(line, '{UPPER}', '{LOWER}') AS low, regexp_extract_all(line, {WORDS}) AS w FROM lines),
marked AS (SELECT doc_id, i, line, low, len(w) AS n, length(array_to_string(w, '')) AS chars, ({_LOUD}) AS marks,
  len(list_filter(w, lambda x: x IN ({_quoted(rules.SEPARATOR_WORDS)}))) AS seps,
  row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth FROM parts WHERE len(w) > 0),
judged AS (SELECT *, (marks >= {rules.MARKS} AND 2 * marks > n) OR (seps >= {rules.SEPARATORS} AND 4 * seps >= n)
  OR (n <= {rules.BOILERPLATE_WORDS} AND ({_PHRASES})) AS failed FROM marked),
by_lines AS (SELECT doc_id, count(*) FILTER (nth > 1) AS dups, count(*) FILTER (failed) AS n_failed,
  coalesce(sum(chars) FILTER (failed), 0) AS lost FROM judged GROUP BY doc_id),
tokens AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM docs),
windows AS (SELECT doc_id, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM windows WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
cover AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
base AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  ({_SYMBOLS})::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  coalesce(n_failed, 0)::BIGINT AS n_failed_lines, coalesce(lost, 0)::BIGINT AS lost_chars
  FROM docs d LEFT JOIN by_lines USING (doc_id) LEFT JOIN cover c USING (doc_id)),
ruled AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_SHARE} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost_chars <= {rules.MAX_LOST} * word_chars AS kept, n_failed_lines, lost_chars FROM ruled
"""

_TEMPLATES = ", ".join("('%s', [%s], %d, %d)" % (label, ", ".join(f"'{w}'" for w in words), license_scan.need(len(words)), wide)
                       for _, label, words, wide in license_scan._templates())
_PHRASE_TESTS = " ".join(
    "WHEN " + " AND ".join(f"{c} = '{w}'" for c, w in zip("abc", phrase)) + f" THEN '{label}'"
    for phrase, label in license_scan.PHRASES)

# The scan's blocks without look-ahead: marks before a number are taken out first.
_SPACE = r"[ \t\n\x0B\f\r]"
_NUMBERED = rf"[.!?]+({_SPACE}+[0-9])"
_BLOCK_END = rf"[.!?]+{_SPACE}+|\n[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]*\n"

LICENSE_SCAN = rf"""
WITH docs AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
tokens AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) - 1 AS i
  FROM (SELECT doc_id, regexp_extract_all(low, '{license_scan.WORD}') AS w FROM docs)),
triples AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
hits AS (SELECT doc_id, i, CASE {_PHRASE_TESTS} END AS label FROM triples),
base AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi FROM hits WHERE label IS NOT NULL GROUP BY doc_id),
templates AS (SELECT * FROM (VALUES {_TEMPLATES}) AS t(label, words, need, wide)),
blocks AS (SELECT doc_id, regexp_extract_all(block, '{license_scan.WORD}') AS words
  FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(low, '{_NUMBERED}', ' \1', 'g'), '{_BLOCK_END}')) AS block FROM docs)),
held AS MATERIALIZED (SELECT doc_id, label, b.words AS block, t.words, need, wide FROM blocks b, templates t
  WHERE len(b.words) >= need AND len(list_distinct(list_intersect(b.words, t.words))) >= need),
windows AS (SELECT doc_id, label, words, need, list_max(list_transform(range(1, len(block) + 1),
  lambda i: len(list_distinct(list_intersect(list_slice(block, i, i + wide - 1), words))))) AS most FROM held),
found AS (SELECT doc_id, label, most / len(words) AS share FROM windows WHERE most >= need),
best AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id),
base_names AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS names
  FROM (SELECT DISTINCT doc_id, label FROM hits WHERE label IS NOT NULL) GROUP BY doc_id),
names AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS names
  FROM (SELECT doc_id, label FROM hits WHERE label IS NOT NULL UNION SELECT doc_id, label FROM found) GROUP BY doc_id)
SELECT doc_id, len(regexp_extract_all(low, '{license_scan.WORD}'))::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base,
  lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(base_names.names, '') AS base_labels,
  coalesce(names.names, '') AS labels, CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(best.share, 0.0) END::DOUBLE AS score
FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN base_names USING (doc_id) LEFT JOIN names USING (doc_id)
"""

# levenshtein() counts bytes, and a character has up to four; so one edit is looked for at each place.
LINE_DEDUP = rf"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
worded AS (SELECT * FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
classes AS (SELECT line, length(line) AS n, min((doc_id, no)) AS first FROM worded GROUP BY line),
near AS (SELECT a.line, min(b.first) AS first FROM classes a JOIN classes b ON b.n BETWEEN a.n - 1 AND a.n + 1
    AND least(a.n, b.n) >= {line_dedup.NEAR_FROM} AND b.first < a.first AND a.line != b.line
    AND (left(a.line, a.n // 2 - 1) = left(b.line, a.n // 2 - 1) OR right(a.line, a.n // 2 - 1) = right(b.line, a.n // 2 - 1))
  WHERE levenshtein(a.line, b.line) <= 4 AND len(list_filter(range(greatest(a.n, b.n)), lambda k: left(a.line, k) = left(b.line, k)
    AND right(a.line, a.n - k - (a.n >= b.n)::INTEGER) = right(b.line, b.n - k - (b.n >= a.n)::INTEGER))) > 0 GROUP BY a.line),
matched AS (SELECT w.doc_id, w.no, coalesce(near.first, c.first) AS match, (near.first IS NOT NULL)::INTEGER AS n_edits
  FROM worded w JOIN classes c USING (line) LEFT JOIN near USING (line))
SELECT doc_id, no::INTEGER AS line_no, match[1] AS match_doc_id, match[2]::INTEGER AS match_line_no, n_edits
FROM matched WHERE match < (doc_id, no)
"""

URL_FILTER = rf"""
WITH parsed AS (SELECT page_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '{url_filter.HOST}', 1)), '\.+$', '') AS host,
    list_filter(string_split(regexp_extract(coalesce(url, ''), '{url_filter.PATH}', 1), '/'), lambda s: s != '') AS path,
    DATE '2024-01-01' + (page_id * 53 % 366)::INTEGER AS fetched FROM pages),
entries AS (SELECT CASE WHEN page_id % 20 IN (1, 7) THEN host WHEN page_id % 20 IN (3, 13) THEN regexp_replace(host, '^[^.]*\.', '')
      ELSE concat_ws('/', host, path[1]) END AS rule, page_id % 20 IN (1, 3, 11) AS added,
    DATE '2024-01-01' + (page_id * 37 % 360)::INTEGER AS day FROM parsed WHERE page_id % 20 IN (1, 3, 7, 11, 13, 17)),
history AS (SELECT rule, day, bool_or(added) AS added FROM entries WHERE rule != '' GROUP BY rule, day),
spans AS (SELECT rule, day AS since, added, lead(day) OVER (PARTITION BY rule ORDER BY day) AS until FROM history),
hits AS (SELECT p.page_id, s.rule, s.since, row_number() OVER (PARTITION BY p.page_id ORDER BY length(s.rule) DESC, s.rule) AS nth
  FROM parsed p JOIN spans s ON s.added AND s.since <= p.fetched AND (s.until IS NULL OR p.fetched < s.until)
    AND (p.host = s.rule OR ends_with(p.host, '.' || s.rule)
      OR (contains(s.rule, '/') AND starts_with(p.host || '/' || array_to_string(p.path, '/') || '/', s.rule || '/'))))
SELECT p.page_id, p.host, p.fetched::VARCHAR AS fetched, h.rule IS NOT NULL AS blocked, h.rule, h.since::VARCHAR AS since
FROM parsed p LEFT JOIN hits h ON h.page_id = p.page_id AND h.nth = 1
"""

_P, _S, _M = fill_middle.SENTINELS
_PART = "array_to_string(list_slice(u, {}, {}), '')"

FILL_MIDDLE = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{fill_middle.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
drawn AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '{_P}') OR contains(text, '{_S}') OR contains(text, '{_M}')
        OR ('0x' || h[17:24])::BIGINT % 100 >= {fill_middle.RATE} THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < {fill_middle.SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form FROM docs),
parts AS (SELECT *, {_PART.format(1, "least(x, y)")} AS prefix, {_PART.format("least(x, y) + 1", "greatest(x, y)")} AS middle,
    {_PART.format("greatest(x, y) + 1", "n")} AS suffix FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form != 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form != 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{_P}' || prefix || '{_S}' || suffix || '{_M}' || middle
    ELSE '{_S}' || suffix || '{_P}' || prefix || '{_M}' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts
"""
