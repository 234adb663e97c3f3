"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op3_bit_sliced_search"] = """
WITH good AS (SELECT vec_id, max(embedding) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
v AS (SELECT vec_id, list_transform(e, lambda x: floor(256 * x::DOUBLE)) AS q FROM good),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLES["op8_prefix_tree_join"] = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION SELECT doc_id, 'whole ' || len(w) || ' ' || array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM grams a JOIN grams b
    ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM common JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v
  WHERE 100 * k >= 75 * (a.n + b.n - k)),
reach AS (SELECT DISTINCT u, u AS r FROM links UNION SELECT links.v, reach.r FROM reach JOIN links ON links.u = reach.u),
least AS (SELECT u, min(r) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.u = d.doc_id
"""

_BITS = "greatest(length(bin(v)) - 7, 0)"

ORACLES["op10_quality_rules"] = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
windows AS (SELECT row, i, array_to_string(words[i:i + 4], ' ') AS k
    FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, k) AS c FROM windows) WHERE c > 1),
covered AS (SELECT row, count(DISTINCT i + j) AS n FROM twice, range(5) r(j) GROUP BY row),
counts AS (SELECT d.doc_id, d.lang, d.source, len(words) AS n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words
  FROM d JOIN w USING (row) LEFT JOIN covered USING (row)),
rates AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_symbols * 1000 // greatest(word_chars, 1) AS symbol_rate, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_line_rate,
    n_repeat_words * 1000 // greatest(n_words, 1) AS repeat_rate, word_chars * 100 // greatest(n_words, 1) AS word_length
  FROM counts),
points AS (SELECT lang, source, unnest(['symbol_rate', 'dup_line_rate', 'repeat_rate', 'word_length']) AS rate,
    unnest([symbol_rate, dup_line_rate, repeat_rate, word_length])::BIGINT AS v FROM rates WHERE NOT base_failed),
buckets AS (SELECT lang, source, rate, (v >> {_BITS}) << {_BITS} AS b, count(*) AS n FROM points GROUP BY ALL),
merged AS (SELECT 0 AS level, * FROM buckets
  UNION ALL SELECT 1, lang, NULL, rate, b, sum(n) FROM buckets GROUP BY lang, rate, b
  UNION ALL SELECT 2, NULL, NULL, rate, b, sum(n) FROM buckets GROUP BY rate, b),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY b) AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, rate) AS total FROM merged),
quartiles AS (SELECT level, lang, source, rate, max(total) AS total, min(b) FILTER (upto * 4 >= total) AS q1,
    min(b) FILTER (upto * 4 >= total * 3) AS q3 FROM ranked GROUP BY ALL),
fences AS (SELECT level, lang, source, max(total) AS docs,
    max(q3 + greatest(3 * (q3 - q1), 50)) FILTER (rate = 'symbol_rate') AS symbol_most,
    max(q3 + greatest(3 * (q3 - q1), 300)) FILTER (rate = 'dup_line_rate') AS line_most,
    max(q3 + greatest(3 * (q3 - q1), 100)) FILTER (rate = 'repeat_rate') AS repeat_most,
    max(q3 + greatest(3 * (q3 - q1), 400)) FILTER (rate = 'word_length') AS length_most,
    max(q1 - greatest(3 * (q3 - q1), 400)) FILTER (rate = 'word_length') AS length_least
  FROM quartiles GROUP BY level, lang, source),
judged AS (SELECT r.*, CASE WHEN own.docs >= 50 THEN own WHEN l.docs >= 50 THEN l ELSE a END AS f
  FROM rates r LEFT JOIN fences own ON own.level = 0 AND own.lang IS NOT DISTINCT FROM r.lang
      AND own.source IS NOT DISTINCT FROM r.source
    LEFT JOIN fences l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM r.lang
    LEFT JOIN fences a ON a.level = 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND symbol_rate <= f.symbol_most AND dup_line_rate <= f.line_most
    AND repeat_rate <= f.repeat_most AND word_length <= f.length_most AND word_length >= f.length_least AS kept
FROM judged
"""

ORACLES["op12_source_divergence"] = """
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
words AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
held AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS df FROM words GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM held GROUP BY ALL HAVING sum(df) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
full_counts AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, k.n AS lang_n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
totals AS (SELECT lang, source, sum(n) AS total FROM full_counts GROUP BY ALL),
shares AS (SELECT c.lang, c.source, c.term, c.n,
    (1 + (1000000000::HUGEINT * (c.n + 2)::HUGEINT) // (t.total + 2 * l.v)::HUGEINT)::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (c.lang_n + 2)::HUGEINT) // (l.total + 2 * l.v)::HUGEINT)::BIGINT AS q
  FROM full_counts c JOIN totals t USING (lang, source) JOIN langs l USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
over_used AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM over_used))
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

# crc32 of a decimal number: each byte goes in before the first of its eight steps
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    string_split(conv_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda s, b: xor(xor(s, b) >> 1, 3988292384 * (xor(s, b) & 1))))"""

ORACLES["op13_prefix_trie"] = f"""
WITH t AS (SELECT conv_id::BIGINT AS conv_id, turn, coalesce(text, '') AS text,
    sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS tid
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'tid': tid, 'w': len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))}}
    ORDER BY turn NULLS FIRST, tid) AS x FROM t GROUP BY conv_id),
h AS (SELECT *, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM own),
whole AS (SELECT h.conv_id, list_concat(coalesce(b.x, [])[1:h.h], h.x[h.h + 1:]) AS x FROM h LEFT JOIN own b ON b.conv_id = h.base),
place AS (SELECT conv_id, x, unnest(range(0, len(x) + 1)) AS depth FROM whole),
prefix AS (SELECT conv_id, depth, len(x) = depth AS ended, CASE WHEN depth > 0 THEN x[depth].w ELSE 0 END AS w,
    list_transform(x[1:depth], lambda e: e.tid) AS p FROM place),
node AS (SELECT p, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends FROM prefix GROUP BY p),
child AS (SELECT p[1:depth - 1] AS p, count(*) AS children FROM node WHERE depth > 0 GROUP BY 1),
sized AS (SELECT node.*, coalesce(children, 0) AS children FROM node LEFT JOIN child USING (p)),
sums AS (SELECT a.p, count(*) FILTER (b.children = 0) AS leaves, sum((b.n - 1) * b.w) AS saved
  FROM sized a JOIN (SELECT *, unnest(range(0, depth + 1)) AS up FROM sized) b ON a.depth = b.up AND a.p = b.p[1:b.up] GROUP BY a.p)
SELECT s.conv_id, s.depth, u.conv_id AS parent_conv_id, s.n AS n_convs, s.children AS n_children, leaves AS n_leaves,
  saved::BIGINT AS saved_tokens, s.ends AS ends_sha256
FROM sized s JOIN sums USING (p) LEFT JOIN node u ON s.depth > 0 AND u.p = s.p[1:s.depth - 1]
"""
