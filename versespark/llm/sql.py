"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i+7], ' ') AS g
        FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 7)) AS i FROM w WHERE len(words) >= 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(words) AS n_words, len(lines) AS n_lines,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(n_repeat, 0) AS n_repeat_words,
        length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS caps,
        length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS digits,
        length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS exclaims
      FROM w LEFT JOIN cov ON w.rid = cov.rid)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * caps > 4 * word_chars
    OR 10 * digits > 3 * word_chars OR 10 * exclaims > 3 * n_words) AS kept
FROM m
"""

SQL = {"op2_quality_cascade": _OP2}
