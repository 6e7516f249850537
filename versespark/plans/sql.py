"""DuckDB SQL of the registered queries."""

from __future__ import annotations

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_PROBLEMS = "problems AS (SELECT 'doc-' || doc_id AS problem_id, text FROM documents)"
_VERSES = """verses AS (SELECT 'bench' AS book_code, item_id // 10 + 1 AS chapter_number, item_id % 10 + 1 AS verse_index, text,
  'bench_' || (item_id // 10 + 1) || ':' || (item_id % 10 + 1) AS reference FROM benchmark)"""
_SPANS = """pieces AS (SELECT problem_id, reference, length(v.text) AS n, string_split(p.text, v.text) AS parts
  FROM problems p JOIN verses v ON contains(p.text, v.text)),
spans AS (SELECT problem_id, (list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * n)::INT AS span_start,
  (list_sum(list_transform(parts[1:k], lambda x: length(x))) + k * n)::INT AS span_end, reference
  FROM (SELECT *, unnest(generate_series(1, len(parts) - 1)) AS k FROM pieces))"""


def _char_chunks(size: int, step: int, least: int) -> str:
    piece = f"substring(text, i * {step} + 1, {size})"
    body = _STRIP.format("piece")
    lead = r"(length(piece) - length(regexp_replace(piece, '^\s+', '')))"
    return f"""chunks AS (SELECT problem_id, i::INT AS chunk_index, ({step} * i + {lead})::INT AS chunk_start,
  ({step} * i + {lead} + length({body}))::INT AS chunk_end, {body} AS text
  FROM (SELECT problem_id, i, {piece} AS piece FROM (SELECT problem_id, text, unnest(generate_series(0, (length(text) - 1) // {step})) AS i
  FROM problems WHERE length(text) > 0)) WHERE length({body}) >= {least})"""


def _grams(n: int) -> str:
    return f"""records AS (SELECT 'task::' || problem_id || '::chunk::' || chunk_index AS id, 'task' AS grp, text FROM chunks
  UNION ALL SELECT 'bible::' || reference, 'bible', text FROM verses),
grams AS (SELECT id, grp, i AS pos, substring(text, i + 1, {n}) AS gram FROM (
  SELECT id, grp, text, unnest(generate_series(0, length(text) - {n})) AS i FROM records WHERE length(text) >= {n})),
df AS (SELECT gram, count(DISTINCT id) AS df FROM grams WHERE gram IN (SELECT gram FROM grams WHERE grp = 'bible') GROUP BY gram)"""


_REUSE = f"""WITH {_PROBLEMS}, {_VERSES}, {_char_chunks(100, 50, 25)}, {_grams(16)},
kept AS (SELECT gram FROM df WHERE df BETWEEN 1 AND 750),
cand AS (SELECT b.id AS verse, t.id AS chunk, count(DISTINCT b.gram) AS shared FROM grams b JOIN grams t ON b.gram = t.gram
  WHERE b.grp = 'bible' AND t.grp = 'task' AND b.gram IN (SELECT gram FROM kept) GROUP BY 1, 2 HAVING count(DISTINCT b.gram) >= 3),
hits AS (SELECT b.id AS verse, t.id AS chunk, b.pos AS vp, t.pos AS cp FROM grams b JOIN grams t ON b.gram = t.gram
  WHERE b.grp = 'bible' AND t.grp = 'task' AND b.gram IN (SELECT gram FROM kept)),
runs AS (SELECT verse, chunk, min(vp)::INT AS vp, min(cp)::INT AS cp, (count(*) + 15)::INT AS size FROM (
  SELECT *, vp - cp AS shift, vp - row_number() OVER (PARTITION BY verse, chunk, vp - cp ORDER BY vp) AS run FROM hits)
  GROUP BY verse, chunk, shift, run HAVING count(*) + 15 >= 20),
flat AS (SELECT c.problem_id, r.chunk AS chunk_id, c.chunk_index, c.chunk_start, c.chunk_end, substr(verse, 8) AS reference, size::DOUBLE AS score,
  c.text AS chunk_text, v.text AS verse_text, vp, cp, size, replace(substring(v.text, vp + 1, size), '-', ' ') AS alg
  FROM (SELECT *, row_number() OVER (PARTITION BY verse, chunk ORDER BY size DESC, vp, cp) AS k FROM runs) r
  JOIN chunks c ON r.chunk = 'task::' || c.problem_id || '::chunk::' || c.chunk_index JOIN verses v ON verse = 'bible::' || v.reference WHERE k = 1)"""
# The rule of operators.reuse.align for chunks of 100 characters: hits in colinear chains, all local alignments in a chain's window, passages that cover enough.
_HIT, _AT = "STRUCT(k INT, c INT, v INT, p INT, b INT)", "STRUCT(i INT, j INT)"
_LINK, _BEST = f"STRUCT(k INT, c INT, v INT, l {_HIT}[])", "STRUCT(p INT, i INT, j INT, f BIGINT)"
_FILL, _BAND = f"STRUCT(d INT, s BIGINT[], t BIGINT[], best {_BEST})", f"STRUCT(d INT, s INT[], g {_AT}[][])"
# A cell of a score table is one number: points, then which step is preferred among equals, then the cell where its path begins.
_ONE, _WAY, _ROW = 1 << 42, 1 << 40, 1 << 20
_X = "(y.d + x - w - 1 + i0 - j0)"  # twice the row of an entry of a band, _Y twice its column
_Y = "(y.d - x + w + 1 - i0 + j0)"
_INSIDE = f"({_X} % 2 = 0 AND {_X} // 2 BETWEEN i0 AND best.i AND {_Y} // 2 BETWEEN j0 AND best.j)"
_STEP = f"CASE WHEN a[{_X} // 2] = b[{_Y} // 2] THEN 2 ELSE -1 END"
_HERE = f"{{'i': {_X} // 2, 'j': {_Y} // 2}}::{_AT}"
_CHAINS = f"""linked AS (SELECT verse, chunk, list_reduce(list_transform(h, lambda x, k: {{'k': k, 'c': x.c, 'v': x.v, 'l': []}}::{_LINK}), lambda o, x: {{'k': x.k, 'c': x.c, 'v': x.v,
    'l': list_append(o.l, list_transform([list_max(list_transform(list_filter(o.l, lambda y: y.v < x.v), lambda y: {{'m': y.p + y.c + y.v, 'k': y.k}}))],
      lambda z: {{'k': x.k, 'c': x.c, 'v': x.v, 'p': 700 + greatest(coalesce(z.m - x.c - x.v, 0), 0), 'b': CASE WHEN z.m > x.c + x.v THEN z.k ELSE 0 END}}::{_HIT})[1])}}::{_LINK},
    {{'k': 0, 'c': 0, 'v': 0, 'l': []}}::{_LINK}).l AS l
  FROM (SELECT verse, chunk, list({{'c': cp, 'v': vp}} ORDER BY cp, vp DESC) AS h FROM hits JOIN cand USING (verse, chunk) GROUP BY 1, 2)),
links AS (SELECT verse, chunk, x.k AS k, x.c AS c, x.v AS v, x.b AS b, row_number() OVER (PARTITION BY verse, chunk ORDER BY x.p DESC, x.c, x.v) AS rank
  FROM (SELECT verse, chunk, unnest(l) AS x FROM linked)),
taken AS (SELECT verse, chunk, k, b, rank AS chain FROM links l WHERE NOT EXISTS (
    SELECT 1 FROM links n WHERE n.verse = l.verse AND n.chunk = l.chunk AND n.b = l.k AND n.rank < l.rank)
  UNION ALL SELECT verse, chunk, l.k, l.b, chain FROM taken t JOIN links l USING (verse, chunk) WHERE l.k = t.b),
parts AS (SELECT *, sum(cut) OVER (PARTITION BY verse, chunk, chain ORDER BY c) AS part FROM (
  SELECT *, coalesce((c - lag(c) OVER (PARTITION BY verse, chunk, chain ORDER BY c) > 350)::INT, 0) AS cut
  FROM links JOIN (SELECT verse, chunk, k, min(chain) AS chain FROM taken GROUP BY 1, 2, 3) USING (verse, chunk, k))),
windows AS (SELECT verse, chunk, low, l, list_transform(string_split(a, ''), lambda x: unicode(x)) AS a,
  list_transform(string_split(substring(b, low + 1, high - low), ''), lambda x: unicode(x)) AS b
  FROM (SELECT verse, chunk, l, a, b, greatest(c1 - 2 * v1, 0) AS low, c2 + 16 + 2 * greatest(length(a) - v2 - 16, 0) AS high
    FROM (SELECT verse, chunk, min(c) AS c1, min(v) AS v1, max(c) AS c2, max(v) AS v2, list({{'c': c, 'v': v}}) AS l FROM parts GROUP BY verse, chunk, chain, part HAVING count(*) >= 3)
    JOIN (SELECT id AS verse, replace(text, '-', ' ') AS a FROM records) USING (verse) JOIN (SELECT id AS chunk, replace(text, '-', ' ') AS b FROM records) USING (chunk)))"""
# A turn fills the table of each window by its anti-diagonals (``best``: the first best cell and where its path begins), then the band around that path
# once more with the paths (``g``: a path's first cell and those that a gap leads to), whose cells the next turn leaves out. What falls short goes by unnesting
# nothing: a WHERE would be computed apart, and the tables twice.
_FILLED = f"""SELECT * EXCLUDE (r), unnest(list_filter([list_reduce(list_transform(range(2, len(a) + len(b) + 1), lambda d: {{'d': d, 's': [], 't': [], 'best': {{'p': 0, 'i': 0, 'j': 0, 'f': 0}}}}::{_FILL}),
  lambda o, y: list_transform([list_transform(list_zip(b, r[len(a) + len(b) + 2 - y.d:len(a) + 2 * len(b) + 1 - y.d], o.s, list_prepend(0, o.s), list_prepend(0, o.t), true),
      lambda z, j: CASE WHEN len(used) > 0 AND list_contains(used, (y.d * 256 + j)::INT) THEN 0 ELSE greatest(0, CASE WHEN z[5] > 0 THEN z[5] ELSE (y.d - j) * {_ROW} + j END
        + CASE WHEN z[1] = z[2] THEN {2 * _ONE + 2 * _WAY} ELSE {2 * _WAY - _ONE} END, z[3] - {2 * _ONE - _WAY}, z[4] - {2 * _ONE}) END)],
    lambda v: list_transform([list_max(v) // {_ONE}], lambda p: {{'d': y.d, 's': list_transform(v, lambda z: CASE WHEN z < {_ONE} THEN 0 ELSE z & {~(3 * _WAY)} END), 't': o.s,
      'best': CASE WHEN p >= greatest(o.best.p, 20) THEN list_transform([list_max(list_transform(v, lambda z, j: CASE WHEN z // {_ONE} = p THEN j END))],
        lambda j: CASE WHEN p > o.best.p OR y.d - j < o.best.i OR y.d - j = o.best.i AND j < o.best.j
          THEN {{'p': p, 'i': y.d - j, 'j': j, 'f': v[j] % {_WAY}}}::{_BEST} ELSE o.best END)[1] ELSE o.best END}}::{_FILL})[1])[1],
  {{'d': 1, 's': list_transform(b, lambda z: 0), 't': list_transform(b, lambda z: 0), 'best': {{'p': 0, 'i': 0, 'j': 0, 'f': 0}}}}::{_FILL}).best], lambda x: x.p >= 20)) AS best
  FROM (SELECT *, list_concat(list_transform(b, lambda x: -1), list_reverse(a), list_transform(b, lambda x: -1)) AS r FROM turns)"""
_TRACED = f"""SELECT *, list_reduce(list_transform(range(i0 + j0, best.i + best.j + 1), lambda d: {{'d': d, 's': [], 'g': []}}::{_BAND}),
  lambda o, y: list_transform([list_transform(o.s, lambda z, x: CASE WHEN {_INSIDE} THEN CASE WHEN list_contains(used, y.d * 256 + {_Y} // 2) THEN 0
      ELSE greatest(0, z + {_STEP}, o.s[x - 1] - 2, o.s[x + 1] - 2) END::INT ELSE z END)],
    lambda s: {{'d': y.d, 's': s, 'g': list_transform(o.g, lambda g, x: CASE WHEN NOT {_INSIDE} THEN g WHEN s[x] = 0 THEN []
        WHEN s[x] = o.s[x] + {_STEP} THEN CASE WHEN o.s[x] = 0 THEN [{_HERE}] ELSE g END
        ELSE list_append(CASE WHEN s[x] = o.s[x - 1] - 2 THEN o.g[x - 1] ELSE o.g[x + 1] END, {_HERE}) END)}}::{_BAND})[1],
  {{'d': 0, 's': list_transform(range(2 * w + 1), lambda x: 0), 'g': list_transform(range(2 * w + 1), lambda x: [])}}::{_BAND}).g[best.i - best.j - i0 + j0 + w + 1] AS g
  FROM (SELECT *, (best.i - i0 + best.j - j0 + 2 - best.p) // 3 AS w FROM (
    SELECT *, (best.f // {_ROW})::INT AS i0, (best.f % {_ROW})::INT AS j0 FROM ({_FILLED})))"""
_ALIGNED = f"""{_CHAINS},
turns AS (SELECT *, []::INT[] AS used, NULL::{_AT} AS head, NULL::{_AT} AS tail FROM windows
  UNION ALL SELECT verse, chunk, low, l, a, b, list_concat(used, list_transform(cells, lambda x: (x.i + x.j) * 256 + x.j)), cells[1], cells[-1]
  FROM (SELECT *, unnest(list_filter([flatten(list_transform(g, lambda x, k: list_transform(range(least(coalesce(g[k + 1].i, best.i) - x.i, coalesce(g[k + 1].j, best.j) - x.j) + 1),
    lambda t: {{'i': x.i + t, 'j': x.j + t}}::{_AT})))], lambda x: len(x) >= 20)) AS cells FROM ({_TRACED}))),
aligned AS (SELECT DISTINCT problem_id, reference, t.chunk, head.i - 1 AS vp, tail.i AS v_end, chunk_start + low + head.j - 1 AS place, chunk_start + low + tail.j AS past,
    length(v.text) AS n, chunk_start, chunk_start + length(c.text) AS c_end
  FROM turns t JOIN chunks c ON t.chunk = 'task::' || c.problem_id || '::chunk::' || c.chunk_index JOIN verses v ON t.verse = 'bible::' || v.reference
  WHERE len(list_filter(l, lambda x: x.v >= head.i - 1 AND x.v < tail.i AND x.c - low >= head.j - 1 AND x.c - low < tail.j)) > 0),
opened AS (SELECT *, coalesce(place - max(past) OVER (PARTITION BY problem_id, reference ORDER BY place, chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 350, false)::INT AS opens FROM aligned),
passages AS (SELECT *, sum(opens) OVER (PARTITION BY problem_id, reference ORDER BY place, chunk) AS passage FROM opened),
fresh AS (SELECT *, greatest(v_end - greatest(vp, coalesce(max(v_end) OVER (PARTITION BY problem_id, reference, passage ORDER BY vp, v_end, chunk
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS fresh FROM passages)"""
_EVAL = f"""WITH RECURSIVE {_REUSE.removeprefix('WITH ')}, {_SPANS}, {_ALIGNED},
pred AS (SELECT DISTINCT problem_id, reference FROM (SELECT problem_id, reference, n, sum(fresh) AS covered, max(c_end) - min(chunk_start) AS stretch FROM fresh GROUP BY 1, 2, passage, 3)
  WHERE covered >= 0.7::DOUBLE * least(n, stretch) AND covered >= 0.5::DOUBLE * n),
truth AS (SELECT DISTINCT problem_id, reference FROM spans),
kinds AS (SELECT coalesce(p.problem_id, t.problem_id) AS problem_id, coalesce(p.reference, t.reference) AS reference,
  CASE WHEN p.reference IS NULL THEN 'fn' WHEN t.reference IS NULL THEN 'fp' ELSE 'tp' END AS kind
  FROM pred p FULL JOIN truth t ON p.problem_id = t.problem_id AND p.reference = t.reference)"""

_SENTENCES = rf"""s AS (SELECT problem_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?;:])\s+', '\1' || chr(1), 'g'), chr(1)),
  lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS s FROM problems)"""
_COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_PAIRS = """SELECT query_id, reference, problem_id, round(sim, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY sim DESC, reference)::INT AS rank FROM (SELECT 'v-' || a.vec_id AS query_id, 'v-' || b.vec_id AS reference,
  'p-' || (a.vec_id % 50) AS problem_id, {cos} AS sim FROM embeddings a JOIN embeddings b ON {on})) WHERE rank <= {k}"""
_TOP = _PAIRS.format(cos=_COSINE, on="a.vec_id <> b.vec_id", k=5) + " AND sim >= 0.3"

_TURNS = r"""turns AS (SELECT conv_id, turn, 'conv-' || conv_id AS problem_id,
  list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM conversations),
paras AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT - 1 AS para_no, array_to_string(w, ' ') AS text FROM turns),
offs AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY para_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS offs FROM paras),
quotes AS (SELECT *, 'bench_' || (conv_id % 20 + 1) || ':' || (turn + 1) AS r1, 'bench_' || (conv_id % 20 + 1) || ':' || (turn + 2) AS r2 FROM offs WHERE len(w) >= 8)"""

_BASE = """base AS (SELECT 'doc-' || doc_id AS problem_id, (doc_id % 7)::INT AS span_start, (doc_id % 7 + 5)::INT AS span_end,
  array_to_string(list_sort(list_distinct(['bench_1:2', 'bench_1:' || (doc_id % 3 + 1)])), ',') AS "references" FROM documents),
added AS (SELECT * FROM (SELECT 'doc-' || doc_id AS problem_id, (doc_id % 7)::INT AS span_start,
  (doc_id % 7 + CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 5 + doc_id % 2 END)::INT AS span_end,
  array_to_string(list_sort(list_distinct(['bench_1:2', 'bench_1:' || (doc_id % 3 + 1)])), ',') AS "references" FROM documents) WHERE span_end > span_start)"""

_RESPONSES = r"""resp AS (SELECT 'conv-' || conv_id AS problem_id, turn::INT AS chunk_index, CASE conv_id % 4
 WHEN 0 THEN '{"matches":[{"reference":"bench_' || (conv_id % 4 + 1) || ':' || (turn + 1) || '","confidence":1.7}]}'
 WHEN 1 THEN '{"results":[{"ref":"bench_' || (conv_id % 7 + 1) || ':' || (turn + 1) || '-' || (turn + 3) || '","score":"0.7"}]}'
 WHEN 2 THEN '{"matches":[{"reference":"Genesis ' || (conv_id % 9 + 1) || ':' || (turn + 1) || '"},{"reference":"bench_1:' || (turn + 2) || '; foo_1:1"}]}'
 END AS js FROM conversations),
m AS (SELECT problem_id, chunk_index, list_concat(json_extract(js, '$.matches[*]'), json_extract(js, '$.results[*]')) AS l FROM resp WHERE js IS NOT NULL),
found AS (SELECT problem_id, chunk_index, coalesce(json_extract_string(x, '$.reference'), json_extract_string(x, '$.ref')) AS raw_reference,
  greatest(0, least(1, coalesce(json_extract_string(x, '$.confidence')::DOUBLE, json_extract_string(x, '$.score')::DOUBLE, 0.5))) AS confidence
  FROM (SELECT problem_id, chunk_index, unnest(l) AS x FROM m))"""

SQL = {
    "ref_normalize": "SELECT doc_id, lower(upper(lang) || '_' || (doc_id % 50 + 1) || ':' || (n_chars % 30 + 1)) AS reference FROM documents",
    "source_resolve": r"""WITH s AS (SELECT conv_id, turn, 'CF_Bench_' || (conv_id % 20 + 1) || '_' || (turn + 1) || '-' || (turn + 3) || '; (Gen_0' || (turn + 1)
  || ':' || (conv_id % 31 + 1) || ') Foo_1_1 gen_1_1 1Cor_13_4.' AS src FROM conversations),
t AS (SELECT conv_id, turn, pos, regexp_replace(regexp_replace(tok, '^[;().,]+|[;().,]+$', '', 'g'), '^[cC][fF]_', '') AS tok
  FROM (SELECT conv_id, turn, unnest(string_split(src, ' ')) AS tok, generate_subscripts(string_split(src, ' '), 1) AS pos FROM s)),
p AS (SELECT conv_id, turn, pos, CASE split_part(tok, '_', 1) WHEN 'Bench' THEN 'bench' WHEN 'Gen' THEN 'gen' WHEN '1Cor' THEN '1cor' END AS book,
  CASE WHEN contains(tok, ':') THEN split_part(split_part(tok, '_', 2), ':', 1) ELSE split_part(tok, '_', 2) END AS chapter,
  CASE WHEN contains(tok, ':') THEN split_part(tok, ':', 2) ELSE split_part(tok, '_', 3) END AS spec FROM t),
r AS (SELECT conv_id, turn, pos, book, chapter::INT AS chapter, unnest(generate_series(split_part(spec, '-', 1)::INT,
  CASE WHEN contains(spec, '-') THEN split_part(spec, '-', 2) ELSE spec END::INT)) AS verse FROM p WHERE book IS NOT NULL)
SELECT conv_id, turn, string_agg(book || '_' || chapter || ':' || verse, ' ' ORDER BY pos, verse) AS resolved FROM r GROUP BY ALL""",
    "verse_spec_expand": """WITH s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id % 20 + 1 WHEN 1 THEN doc_id % 20 + 1 END AS a,
  CASE doc_id % 3 WHEN 0 THEN doc_id % 20 + 1 WHEN 1 THEN n_chars % 20 + 1 END AS b FROM documents)
SELECT doc_id, CASE WHEN a <= b THEN array_to_string(generate_series(a, b), ' ') ELSE '' END AS verses, coalesce(a > b, true) AS is_error FROM s""",
    "freeform_parse": """SELECT doc_id, CASE doc_id % 4 WHEN 2 THEN '1cor' WHEN 3 THEN NULL ELSE 'gen' END AS book,
  CASE doc_id % 4 WHEN 2 THEN doc_id % 16 + 1 WHEN 3 THEN NULL ELSE doc_id % 50 + 1 END::INT AS chapter,
  CASE doc_id % 4 WHEN 3 THEN NULL WHEN 1 THEN least(n_chars % 30 + 3, n_chars % 7 + 1) ELSE n_chars % 30 + 1 END::INT AS verse_start,
  CASE doc_id % 4 WHEN 3 THEN NULL WHEN 1 THEN greatest(n_chars % 30 + 3, n_chars % 7 + 1) WHEN 2 THEN n_chars % 30 + 4 ELSE n_chars % 30 + 1 END::INT AS verse_end
  FROM documents""",
    "chunks_sentence": f"""WITH {_PROBLEMS}, {_SENTENCES}, c AS (SELECT problem_id, list_filter(s, lambda x: length(x) >= 30) AS c FROM s)
SELECT problem_id, (generate_subscripts(c, 1) - 1)::INT AS chunk_index, unnest(c) AS text FROM c""",
    "chunks_sentence_window": f"""WITH {_PROBLEMS}, {_SENTENCES}, c AS (SELECT problem_id, list_filter(list_transform(generate_series(1, len(s)),
  lambda i: array_to_string(s[i:i+1], ' ')), lambda x: length(x) >= 30) AS c FROM s WHERE len(s) > 0)
SELECT problem_id, (generate_subscripts(c, 1) - 1)::INT AS chunk_index, unnest(c) AS text FROM c""",
    "chunks_char": f"""WITH {_PROBLEMS}, {_char_chunks(500, 400, 30)}
SELECT problem_id, (row_number() OVER (PARTITION BY problem_id ORDER BY chunk_index) - 1)::INT AS chunk_index, text FROM chunks""",
    "chunks_char_offsets": f"WITH {_PROBLEMS}, {_char_chunks(500, 400, 30)} SELECT * FROM chunks",
    "token_budget": rf"""WITH {_PROBLEMS}, f AS (SELECT problem_id, {_STRIP.format('text')} AS text FROM problems),
w AS (SELECT problem_id, CASE WHEN ceil(length(text) / 4.0) <= 700 THEN [text] ELSE list_filter(list_transform(generate_series(0, (length(text) - 1) // 2400),
  lambda i: {_STRIP.format('substring(text, i * 2400 + 1, 2800)')}), lambda x: length(x) >= 30) END AS parts FROM f WHERE length(text) >= 30)
SELECT problem_id, 0 AS chunk_index, (generate_subscripts(parts, 1) - 1)::INT AS part_index, unnest(parts) AS text FROM w""",
    "ngram_df": f"WITH {_PROBLEMS}, {_VERSES}, {_char_chunks(100, 50, 25)}, {_grams(8)} SELECT gram, df FROM df",
    "reuse_candidates": f"{_REUSE} SELECT verse, chunk, shared FROM cand",
    "reuse_candidates_unbounded": f"""{_REUSE} SELECT b.id AS verse, t.id AS chunk, count(DISTINCT b.gram) AS shared FROM grams b JOIN grams t ON b.gram = t.gram
  WHERE b.grp = 'bible' AND t.grp = 'task' GROUP BY 1, 2 HAVING count(DISTINCT b.gram) >= 3""",
    "knn_index_recall": """SELECT count(*) FILTER (vec_id % 100 = 0) * least(10, count(*)) AS neighbours, true AS reached, true AS less_work FROM embeddings""",
    "span_validity": """WITH s AS (SELECT 'doc-' || doc_id AS problem_id, text, (doc_id % 7 - 2)::INT AS a,
  (CASE doc_id % 3 WHEN 0 THEN doc_id % 7 + 5 WHEN 1 THEN length(text) + doc_id % 2 ELSE doc_id % 7 - 2 END)::INT AS b FROM documents),
v AS (SELECT *, coalesce(a >= 0 AND a < b AND b <= length(text), false) AS good FROM s)
SELECT problem_id, a AS span_start, b AS span_end, CASE WHEN good THEN b - a END AS span_length, good AS valid_span, CASE WHEN good THEN
  substring(text, greatest(a - 20, 0) + 1, a - greatest(a - 20, 0)) || '[' || substring(text, a + 1, b - a) || ']' || substring(text, b + 1, 20) ELSE '' END AS visual_snippet FROM v""",
    "skipped_spans": "SELECT 'doc-' || doc_id AS problem_id, count(*) AS spans FROM documents WHERE doc_id % 3 = 0 GROUP BY 1",
    "user_method_table": """WITH t AS (SELECT 'doc-' || doc_id AS problem_id, text, coalesce(contains(text, ' '), false) AS good FROM documents)
SELECT problem_id, CASE WHEN good THEN 'bench_' || (length(text) % 20 + 1) || ':' || ((length(text) - length(replace(text, ' ', ''))) % 10 + 1) END AS reference,
  CASE WHEN good THEN 0.5::DOUBLE END AS score, CASE WHEN good THEN 'words' END AS method, CASE WHEN NOT good THEN 'no words' END AS error FROM t""",
    "verse_intervals": """WITH known AS (SELECT DISTINCT item_id // 10 + 1 AS chapter, item_id % 10 + 1 AS verse FROM benchmark WHERE item_id % 7 <> 3),
r AS (SELECT doc_id, doc_id % 30 + 1 AS chapter, n_chars % 12 + 1 AS s, CASE WHEN doc_id % 50 = 0 THEN 2000000000 ELSE n_chars % 12 + 4 END AS e FROM documents),
k AS (SELECT doc_id, r.chapter, verse, verse - row_number() OVER (PARTITION BY doc_id ORDER BY verse) AS island FROM r JOIN known ON r.chapter = known.chapter WHERE verse BETWEEN s AND e)
SELECT doc_id, chapter::INT AS chapter, min(verse)::INT AS first, max(verse)::INT AS last FROM k GROUP BY doc_id, chapter, island
UNION ALL SELECT doc_id, chapter::INT, s::INT, e::INT FROM r WHERE chapter NOT IN (SELECT chapter FROM known)""",
    "passage_groups": f"""{_REUSE}, marks AS (SELECT DISTINCT verse, chunk, cp AS mark FROM hits),
g AS (SELECT *, coalesce((mark - lag(mark) OVER (PARTITION BY verse, chunk ORDER BY mark) > 20)::INT, 0) AS new FROM marks),
n AS (SELECT *, sum(new) OVER (PARTITION BY verse, chunk ORDER BY mark)::INT AS passage FROM g)
SELECT verse, chunk, passage, min(mark)::INT AS start, max(mark)::INT AS "end", count(*) AS matches FROM n GROUP BY 1, 2, 3""",
    "exact_flatten": f"""{_REUSE} SELECT problem_id, chunk_index, reference, score, cp AS aligned_chunk_start, cp + size AS aligned_chunk_end,
  vp AS aligned_verse_start, vp + size AS aligned_verse_end FROM flat""",
    "exact_best": f"{_REUSE} SELECT problem_id, reference, max(score) AS score, 'passim' AS method FROM flat GROUP BY 1, 2",
    "exact_inspection": f"""{_REUSE}, {_SPANS}, truth AS (SELECT DISTINCT problem_id, reference FROM spans)
SELECT f.problem_id, chunk_id, chunk_index, chunk_start, chunk_end, f.reference, score, t.reference IS NOT NULL AS is_ground_truth_reference, chunk_text, verse_text,
  cp AS aligned_chunk_start, cp + size AS aligned_chunk_end, vp AS aligned_verse_start, vp + size AS aligned_verse_end, alg, alg AS alg2
  FROM flat f LEFT JOIN truth t ON f.problem_id = t.problem_id AND f.reference = t.reference""",
    "review_rows": f"""{_REUSE} SELECT problem_id, chunk_id, reference, left(chunk_text, 120) AS chunk_preview, left(verse_text, 120) AS verse_preview,
  chunk_start + cp AS start, chunk_start + cp + size AS "end" FROM flat WHERE score >= 20""",
    "run_counts": f"""{_REUSE} SELECT 'chunks' AS name, count(*) AS n FROM chunks UNION ALL SELECT 'verses', count(*) FROM verses
UNION ALL SELECT 'pairs', count(DISTINCT (problem_id, reference)) FROM flat UNION ALL SELECT 'matches', count(*) FROM flat
UNION ALL SELECT 'selected_problems', count(DISTINCT problem_id) FROM chunks""",
    "knn_topk": f"SELECT query_id, reference, similarity, rank FROM ({_TOP})",
    "knn_self": "SELECT query_id, reference, similarity, rank FROM (" + _PAIRS.format(cos=_COSINE, on="a.vec_id <> b.vec_id", k=2) + " AND sim >= 0.3)",
    "embedding_best": f"SELECT problem_id, reference, max(similarity) AS score, 'embedding' AS method FROM ({_TOP}) GROUP BY 1, 2",
    "truth_pairs": f"WITH {_PROBLEMS}, {_VERSES}, {_SPANS} SELECT DISTINCT problem_id, reference FROM spans",
    "error_sets": f"{_EVAL} SELECT problem_id, reference, kind FROM kinds",
    "score_predictions": f"""{_EVAL}, n AS (SELECT count(*) FILTER (kind = 'tp')::DOUBLE AS tp, count(*) FILTER (kind = 'fp')::DOUBLE AS fp,
  count(*) FILTER (kind = 'fn')::DOUBLE AS fn FROM kinds), r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM n)
SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, p AS "precision", r AS recall,
  CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM r""",
    "first_n_problems": f"""WITH {_PROBLEMS}, {_VERSES}, {_SPANS}, c AS (SELECT problem_id FROM problems ORDER BY problem_id LIMIT 5)
SELECT problem_id, span_start FROM spans WHERE problem_id IN (SELECT problem_id FROM c) UNION ALL SELECT problem_id, -1 FROM c""",
    "quote_stats": f"""WITH {_TURNS}, q AS (SELECT problem_id, count(*) FILTER (len(w) >= 8) AS n FROM paras GROUP BY 1)
SELECT count(*) + (SELECT count(*) FROM pages) AS files, (SELECT count(*) FROM pages) AS parse_errors, count(*) FILTER (n > 0) AS files_with_quotes,
  sum(n)::BIGINT AS quotes, sum(n)::BIGINT AS mapped, count(*) FILTER (n > 0) AS files_mapped FROM q""",
    "dataset_stats": f"""WITH {_TURNS}, refs AS (SELECT problem_id, r1 AS r FROM quotes UNION ALL SELECT problem_id, r2 FROM quotes)
SELECT (SELECT count(DISTINCT problem_id) FROM paras) + (SELECT count(*) FROM pages) + (SELECT count(*) FROM conversations WHERE turn = 0) AS files,
  count(DISTINCT problem_id) AS files_with_spans, (SELECT count(*) FROM quotes) AS spans,
  count(DISTINCT r) AS verses, count(DISTINCT split_part(r, '_', 1)) AS books, count(DISTINCT (problem_id, r)) AS pairs,
  (SELECT count(*) FROM pages) AS parse_errors FROM refs""",
    "quote_files": f"WITH {_TURNS} SELECT problem_id, count(*)::INT AS quotes FROM quotes GROUP BY 1",
    "absolute_spans": """SELECT doc_id, (CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 90 END + n_chars % 50)::INT AS span_start,
  (CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 90 END + n_chars % 50 + 7)::INT AS span_end FROM documents""",
    "aligned_ends": "SELECT doc_id, (doc_id % 40 + length(source) + length(lang))::INT AS \"end\" FROM documents",
    "highlight_slice": """WITH t AS (SELECT doc_id, '<' || source || '> & "' || lang || '"' AS t, doc_id % 12 - 2 AS a, n_chars % 20 AS b FROM documents),
c AS (SELECT doc_id, t, greatest(0, least(a, length(t))) AS a, b FROM t), d AS (SELECT doc_id, t, a, greatest(a, least(b, length(t))) AS b FROM c),
p AS (SELECT doc_id, unnest([t[:a], t[a+1:b], t[b+1:]]) AS x, unnest([1, 2, 3]) AS k FROM d),
e AS (SELECT doc_id, k, replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS x FROM p)
SELECT doc_id, max(CASE k WHEN 1 THEN x END) || '<mark>' || max(CASE k WHEN 2 THEN x END) || '</mark>' || max(CASE k WHEN 3 THEN x END) AS marked FROM e GROUP BY 1""",
    "reference_list": """SELECT doc_id, array_to_string(list_sort(list_distinct(['bench_' || (doc_id % 4) || ':1', lower(lang) || '_1:2', 'bench_0:' || (n_chars % 3)])), ' ') AS "references"
FROM documents""",
    "prompt_rows": rf"""SELECT 'doc-' || doc_id AS problem_id, 0 AS chunk_index, 'Name every verse.' || chr(10) || 'Book codes:' || chr(10) || '1cor, bench, gen' AS system,
  length({_STRIP.format('text')})::INT AS chars FROM documents WHERE length({_STRIP.format('text')}) >= 30""",
    "message_texts": r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN source || chr(10) || lang ELSE source || ' ' || lang END AS message FROM documents""",
    "find_collection": """WITH c AS (SELECT source || '-' || lang AS name, source, lang FROM documents)
SELECT coalesce((SELECT min(name) FROM c WHERE source = 'src1' AND lang = 'de'), (SELECT min(name) FROM c)) AS collection_name
UNION ALL SELECT coalesce((SELECT min(name) FROM c WHERE name = 'src2-en'), (SELECT min(name) FROM c)) UNION ALL SELECT min(name) FROM c""",
    "accepted_matches": f"""WITH {_BASE}, a AS (SELECT 'doc-' || doc_id AS problem_id, (doc_id % 7 + 1)::INT AS span_start, (doc_id % 7 + 4)::INT AS span_end,
  CASE WHEN doc_id % 3 = 0 THEN 'bench_7:7' ELSE 'bench_1:9,bench_2:1' END AS "references" FROM documents WHERE doc_id % 2 = 0)
SELECT * FROM added UNION SELECT * FROM a""",
    "merge_counts": f"""WITH {_BASE} SELECT count(DISTINCT problem_id) AS problems, count(*) AS rows FROM (SELECT * FROM base UNION SELECT * FROM added)""",
    "predictions_per_problem": f"""SELECT problem_id, string_agg(reference, ' ' ORDER BY score DESC, reference) AS "references"
FROM (SELECT problem_id, reference, max(similarity) AS score FROM ({_TOP}) GROUP BY 1, 2) GROUP BY 1""",
    "similar_verse_text": "SELECT query_id AS reference, query_id || ' => [' || string_agg(reference, ', ' ORDER BY rank) || ']' AS similar FROM ("
                          + _PAIRS.format(cos=_COSINE, on="a.vec_id <> b.vec_id", k=2) + " AND sim >= 0.3) GROUP BY query_id",
    "knn_search": "SELECT query_id, reference, similarity, rank FROM (" + _PAIRS.format(cos=_COSINE, on="a.vec_id % 100 = 0", k=10) + ")",
    "chunks_window_offsets": f"""WITH RECURSIVE {_PROBLEMS}, {_SENTENCES}, w AS (SELECT problem_id, text, list_filter(list_transform(generate_series(1, len(s)),
  lambda i: array_to_string(s[i:i+1], ' ')), lambda x: length(x) >= 30) AS c FROM s JOIN problems USING (problem_id) WHERE len(s) > 0),
walk AS (SELECT problem_id, 0 AS k, 0 AS past, 0 AS spot FROM w UNION ALL
  SELECT problem_id, k, greatest(past, spot + n) AS past, spot FROM (SELECT problem_id, k + 1 AS k, past, length(c[k + 1]) AS n,
    CASE WHEN position(c[k + 1] IN substring(text, past + 1)) > 0 THEN past + position(c[k + 1] IN substring(text, past + 1)) - 1
      WHEN position(c[k + 1] IN text) > 0 THEN position(c[k + 1] IN text) - 1 ELSE past END AS spot FROM walk JOIN w USING (problem_id) WHERE k < len(c)))
SELECT problem_id, (k - 1)::INT AS chunk_index, spot::INT AS chunk_start, (spot + length(c[k]))::INT AS chunk_end, c[k] AS text FROM walk JOIN w USING (problem_id) WHERE k > 0""",
    "tei_spans": f"""WITH {_TURNS} SELECT problem_id, (row_number() OVER (PARTITION BY problem_id ORDER BY para_no) - 1)::INT AS span_index,
  (offs + length(array_to_string(w[1:2], ' ')))::INT AS span_start, (offs + length(array_to_string(w[1:6], ' ')))::INT AS span_end,
  r1 || ' ' || r2 AS resolved_references FROM quotes""",
    "tei_texts": f"""WITH {_TURNS} SELECT problem_id, string_agg(text, chr(10) ORDER BY para_no) AS text FROM paras
  WHERE problem_id IN (SELECT problem_id FROM quotes) GROUP BY 1""",
    "paragraph_offsets": f'WITH {_TURNS} SELECT problem_id, para_no, offs AS "offset" FROM offs',
    "span_preview": f"""WITH {_PROBLEMS}, {_VERSES}, {_SPANS}, s AS (SELECT s.*, substring(text, span_start + 1, span_end - span_start) AS quote_text,
  substring(text, greatest(span_start - 20, 0) + 1, span_start - greatest(span_start - 20, 0)) AS left_context, substring(text, span_end + 1, 20) AS right_context
  FROM spans s JOIN problems p ON s.problem_id = p.problem_id), v AS (SELECT *, left_context || '[' || quote_text || ']' || right_context AS visual_snippet FROM s)
SELECT problem_id, span_start, span_end, span_end - span_start AS span_length, true AS valid_span, quote_text, left_context, right_context, visual_snippet,
  regexp_replace(replace(replace(replace(visual_snippet, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\\[(.*?)\\]', '<mark>\\1</mark>', 'g') AS marked FROM v""",
    "verse_text_pairs": f"""WITH {_VERSES}, r AS (SELECT 'doc-' || doc_id AS problem_id,
  ['bench_' || (doc_id % 25 + 1) || ':' || (n_chars % 10 + 1), 'gen_1:1', 'bench_1:1'] AS l FROM documents),
u AS (SELECT problem_id, unnest(l) AS reference, generate_subscripts(l, 1) AS pos FROM r)
SELECT problem_id, string_agg(u.reference || ' :: ' || coalesce(v.text, '[MISSING]'), ' || ' ORDER BY pos) AS pairs
  FROM u LEFT JOIN verses v ON u.reference = v.reference GROUP BY 1""",
    "highlight_clip": f"""WITH {_PROBLEMS}, x AS (SELECT problem_id, length(text) AS n, unnest([{{'s': 0, 'e': 5}}, {{'s': 3, 'e': 8}}, {{'s': 4, 'e': 6}},
  {{'s': length(text) - 3, 'e': length(text) + 10}}, {{'s': 9, 'e': 9}}]) AS x FROM problems),
c AS (SELECT problem_id, greatest(0, least(x.s, n)) AS s, greatest(0, least(x.e, n)) AS e FROM x),
m AS (SELECT problem_id, greatest(s, coalesce(max(e) OVER (PARTITION BY problem_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS s, e FROM c)
SELECT problem_id, s::INT AS span_start, e::INT AS span_end FROM m WHERE e > s""",
    "merge_solutions": f"WITH {_BASE} SELECT * FROM base UNION SELECT * FROM added",
    "source_label": f"""WITH {_BASE}, u AS (SELECT *, 1 AS b, 0 AS a FROM (SELECT DISTINCT * FROM base) UNION ALL SELECT *, 0, 1 FROM (SELECT DISTINCT * FROM added))
SELECT problem_id, span_start, span_end, "references", CASE WHEN max(b) = 1 AND max(a) = 1 THEN 'solution+add' WHEN max(b) = 1 THEN 'solution' ELSE 'add' END AS label
  FROM u GROUP BY 1, 2, 3, 4""",
    "unique_ids": """WITH r AS (SELECT doc_id AS row_index, CASE WHEN doc_id % 11 = 0 THEN '' ELSE lang || '_' || (doc_id % 7) END AS reference FROM documents),
b AS (SELECT *, CASE WHEN reference = '' THEN 'row_' || row_index ELSE reference END AS base FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY row_index) - 1 AS n FROM b)
SELECT row_index, reference, CASE WHEN n = 0 THEN base ELSE base || '__' || n END AS id FROM n""",
    "collection_name": """WITH n AS (SELECT doc_id, lower(source) || '__' || lower(lang) || '__' || lower('org_model_' || n_chars || repeat('_x', (doc_id % 40)::INT)) AS name FROM documents)
SELECT doc_id, CASE WHEN length(name) <= 63 THEN name ELSE rtrim(left(name, 51), '_-') || '__' || left(sha1(name), 10) END AS name FROM n""",
    "vector_upsert": """SELECT 'c' || label AS collection_name, 'v-' || vec_id AS id, vec_id AS row_index,
  CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS document FROM embeddings""",
    "vector_upsert_buckets": """SELECT 'c' || label AS collection_name, 'v-' || vec_id AS id, vec_id AS row_index,
  CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS document FROM embeddings""",
    "llm_extract": f"WITH {_RESPONSES} SELECT problem_id, chunk_index, raw_reference, confidence FROM found",
    "llm_best": rf"""WITH {_VERSES}, {_RESPONSES}, c AS (SELECT problem_id, confidence, unnest(regexp_split_to_array(raw_reference, '[;,|]\s*')) AS raw FROM found),
r AS (SELECT problem_id, confidence, CASE WHEN raw LIKE 'Genesis%' THEN 'gen' ELSE 'bench' END AS book, regexp_extract(raw, '(\d+):', 1)::INT AS chapter,
  regexp_extract(raw, ':(\d+)', 1)::INT AS a, CASE WHEN contains(raw, '-') THEN regexp_extract(raw, '-(\d+)', 1) ELSE regexp_extract(raw, ':(\d+)', 1) END::INT AS b
  FROM c WHERE raw NOT LIKE 'foo%'),
e AS (SELECT problem_id, confidence, book, chapter, unnest(generate_series(a, b)) AS verse FROM r)
SELECT problem_id, book || '_' || chapter || ':' || verse AS reference, max(confidence) AS score, 'direct_prompting' AS method FROM e
  WHERE NOT EXISTS (SELECT 1 FROM verses v WHERE v.book_code = e.book AND v.chapter_number = e.chapter)
    OR EXISTS (SELECT 1 FROM verses v WHERE v.book_code = e.book AND v.chapter_number = e.chapter AND v.verse_index = e.verse) GROUP BY 1, 2""",
    "verse_index": f"WITH {_VERSES} SELECT DISTINCT 'bench' AS book, chapter_number::INT AS chapter, verse_index::INT AS verse FROM verses",
    "verse_range_join": f"""WITH {_VERSES}, e AS (SELECT doc_id, doc_id % 30 + 1 AS chapter, unnest(generate_series(n_chars % 12 + 1, n_chars % 12 + 4)) AS verse FROM documents)
SELECT doc_id, 'bench_' || chapter || ':' || verse AS reference FROM e WHERE NOT EXISTS (SELECT 1 FROM verses v WHERE v.chapter_number = e.chapter)
  OR EXISTS (SELECT 1 FROM verses v WHERE v.chapter_number = e.chapter AND v.verse_index = e.verse)""",
    "dataset_overview": f"""WITH {_PROBLEMS}, {_VERSES}, {_SPANS}, {_BASE}
SELECT 'problems' AS name, count(*) AS n FROM problems UNION ALL SELECT 'solutions', count(*) FROM spans
UNION ALL SELECT 'additions', count(*) FROM documents UNION ALL SELECT 'merged', count(*) FROM (SELECT * FROM base UNION SELECT * FROM added)""",
}
