"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_ESCAPE = r"regexp_replace({}, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')"

OP1 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(k)
), numbered AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         sum(25 + length({_ESCAPE.format("role")}) + length({_ESCAPE.format("text")}) - 5) OVER (w ROWS UNBOUNDED PRECEDING) AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars,
       count(*) FILTER (role = 'assistant' OR k = n) AS n_examples
FROM numbered GROUP BY conv_id
"""

OP2 = r"""
WITH each AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM each WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM ranked
"""

OP10 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS grams
  FROM words
), grams AS (
  SELECT doc_id, len(grams) AS n, unnest(grams) AS g FROM sets
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT doc_id, len(grams) AS n_shingles, component_id FROM sets JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = sets.doc_id
"""

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP9 = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents
), windows AS (
  SELECT doc_id, k, array_to_string(ws[k : k + 4], ' ') AS five FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS k FROM docs)
), again AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, unnest(range(k, k + 5)) AS p FROM (SELECT * FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1)) GROUP BY doc_id
), raw AS (
  SELECT doc_id, host, raw, {_WORDS.format("translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws
  FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS raw FROM docs)
), doubled AS (
  SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM raw WHERE len(ws) > 0 GROUP BY doc_id
), own AS (
  SELECT doc_id, host, array_to_string(ws, ' ') AS line, sum(len(ws)) AS words FROM raw WHERE len(ws) > 0 GROUP BY ALL
), signatures AS (
  SELECT doc_id, host, coalesce(signature, '') AS signature FROM docs
  LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY line) AS signature FROM own GROUP BY doc_id) USING (doc_id)
), limits AS (
  SELECT host, greatest(5.0::DOUBLE, 0.02::DOUBLE * count(DISTINCT signature)) AS most FROM signatures GROUP BY host
), often AS (
  SELECT host, line, most FROM own JOIN limits USING (host) GROUP BY host, line, most HAVING count(*) > most
), gone AS (
  SELECT host, line FROM own JOIN often USING (host, line) JOIN signatures USING (doc_id, host) GROUP BY host, line, most HAVING count(DISTINCT signature) > most
), removed AS (
  SELECT doc_id, sum(words) AS removed_words FROM own JOIN gone USING (host, line) GROUP BY doc_id
), figures AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM docs LEFT JOIN doubled USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN removed USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
       AND NOT (removed_words > 0 AND (n_words - removed_words < 10 OR n_words - removed_words < 0.2::DOUBLE * n_words)) AS kept
FROM figures
"""

OP12 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents
), drawn AS (
  SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS c2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM docs
), cut AS (
  SELECT *, coalesce(array_to_string(units[1 : least(c1, c2)], ''), '') AS p, coalesce(array_to_string(units[least(c1, c2) + 1 : greatest(c1, c2)], ''), '') AS m,
         coalesce(array_to_string(units[greatest(c1, c2) + 1 :], ''), '') AS s
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""

#: Reads the markup that the given pages have: one article a page, of headings, paragraphs, line breaks and bold text.
OP13 = r"""
WITH articles AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') AS raw FROM pages
), texts AS (
  SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(raw, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM articles
)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
"""

ORACLES: dict[str, str] = {"op1_chat_formatting": OP1, "op2_exact_dedup": OP2, "op9_quality_rules": OP9, "op10_ngram_jaccard": OP10, "op12_fill_in_middle": OP12, "op13_html_extraction": OP13}
