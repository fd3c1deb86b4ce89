"""DuckDB SQL of the manifest, the quality rules and the divergence audit."""

from __future__ import annotations

from casewise.llm import divergence, merkle, ngram_ratio

MERKLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head
  FROM documents
), h AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS altered,
         list_reduce(
           flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
             lambda i: [CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
           lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)), CAST(4294967295 AS BIGINT)) & 1 = 1 AS touched
  FROM d
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS size FROM h
), nodes AS (
  SELECT source, 0 AS level, place, size, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, level + 1, place // {merkle.FAN}, (size + {merkle.FAN - 1}) // {merkle.FAN}, sha256(string_agg(digest, '' ORDER BY place))
  FROM nodes WHERE size > 1 GROUP BY source, level, place // {merkle.FAN}, size
), subroots AS (
  SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS size FROM nodes WHERE size = 1
), upper_nodes AS (
  SELECT 0 AS level, place, size, digest FROM subroots
  UNION ALL
  SELECT level + 1, place // {merkle.FAN}, (size + {merkle.FAN - 1}) // {merkle.FAN}, sha256(string_agg(digest, '' ORDER BY place))
  FROM upper_nodes WHERE size > 1 GROUP BY level, place // {merkle.FAN}, size
), steps AS (
  SELECT l.source, l.place, n.level, coalesce(string_agg(n.digest, '' ORDER BY n.place) FILTER (n.place < l.place // CAST({merkle.FAN} ** n.level AS BIGINT)), '') AS before,
         coalesce(string_agg(n.digest, '' ORDER BY n.place) FILTER (n.place > l.place // CAST({merkle.FAN} ** n.level AS BIGINT)), '') AS after
  FROM leaves AS l JOIN nodes AS n ON n.source IS NOT DISTINCT FROM l.source AND n.size > 1
   AND n.place // {merkle.FAN} = l.place // CAST({merkle.FAN} ** (n.level + 1) AS BIGINT) GROUP BY ALL
  UNION ALL
  SELECT l.source, l.place, 1000 + n.level, coalesce(string_agg(n.digest, '' ORDER BY n.place) FILTER (n.place < s.place // CAST({merkle.FAN} ** n.level AS BIGINT)), ''),
         coalesce(string_agg(n.digest, '' ORDER BY n.place) FILTER (n.place > s.place // CAST({merkle.FAN} ** n.level AS BIGINT)), '')
  FROM leaves AS l JOIN subroots AS s ON s.source IS NOT DISTINCT FROM l.source
  JOIN upper_nodes AS n ON n.size > 1 AND n.place // {merkle.FAN} = s.place // CAST({merkle.FAN} ** (n.level + 1) AS BIGINT) GROUP BY ALL
), proofs AS (
  SELECT source, place, list(before || '|' || after ORDER BY level) AS proof, string_agg(before || after, '' ORDER BY level) AS siblings FROM steps GROUP BY ALL
), folded AS (
  SELECT l.doc_id, l.leaf, s.digest AS subroot, (SELECT digest FROM upper_nodes WHERE size = 1) AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
         list_reduce(coalesce(p.proof, []), lambda node, step: sha256(split_part(step, '|', 1) || node || split_part(step, '|', 2)),
                     CASE WHEN l.touched THEN l.altered ELSE l.leaf END) AS folded_root
  FROM leaves AS l JOIN subroots AS s ON s.source IS NOT DISTINCT FROM l.source
  LEFT JOIN proofs AS p ON p.source IS NOT DISTINCT FROM l.source AND p.place = l.place
)
SELECT *, folded_root = root AS verified FROM folded
"""

_HALF, _TOP, _WRAP = ngram_ratio.BUCKETS // 2, "1099511627776", "18446744073709551616"
RATIO_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), w AS (SELECT row, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d
), p AS (
  SELECT row, i, list_slice(words, i, i + 4) AS five, count(*) OVER (PARTITION BY row, list_slice(words, i, i + 4)) AS times
  FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM w)
), r AS (SELECT row, count(DISTINCT spot) AS n FROM (SELECT row, unnest(range(i, i + 5)) AS spot FROM p WHERE times > 1) GROUP BY row
), l AS (
  SELECT row, count(*) - count(DISTINCT line) AS n FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY row
), t AS (
  SELECT row, generate_subscripts(tokens, 1) AS i, unnest(tokens) AS token FROM (
    SELECT row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+|[^0-9a-z\\x{{80}}-\\x{{10FFFF}}\\x20\\x09-\\x0D]+') AS tokens FROM d)
), k AS (
  SELECT token, list_reduce(
    list_transform(range(CAST(length(hex(encode(token))) // 2 AS BIGINT), 0, -1), lambda b: CAST(CAST('0x' || substr(hex(encode(token)), 2 * b - 1, 2) AS INTEGER) AS HUGEINT)),
    lambda h, b: (h * {ngram_ratio.PLACE} + b) % {_WRAP}, CAST(0 AS HUGEINT)) AS hash FROM (SELECT DISTINCT token FROM t)
), g AS (
  SELECT row, ((hash * {ngram_ratio.ALONE}) % {_WRAP}) // {_TOP} % {_HALF} AS bucket FROM t JOIN k USING (token)
  UNION ALL
  SELECT a.row, {_HALF} + (((x.hash * {ngram_ratio.FIRST}) % {_WRAP} + (y.hash * {ngram_ratio.SECOND}) % {_WRAP}) % {_WRAP}) // {_TOP} % {_HALF}
  FROM t AS a JOIN t AS b ON b.row = a.row AND b.i = a.i + 1 JOIN k AS x ON x.token = a.token JOIN k AS y ON y.token = b.token
), good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0
), c AS (
  SELECT bucket, count(*) AS raw, count(*) FILTER (doc_id IN (SELECT doc_id FROM good)) AS target FROM g JOIN d USING (row) GROUP BY bucket
), z AS (
  SELECT bucket, CAST(floor((log2((target + 1) / (sum(target) OVER half + {_HALF})) - log2((raw + 1) / (sum(raw) OVER half + {_HALF}))) * {ngram_ratio.SCALE} + 0.5) AS BIGINT) AS ratio
  FROM c WINDOW half AS (PARTITION BY bucket < {_HALF})
), s AS (SELECT row, count(*) AS n, sum(ratio) AS ratio FROM g JOIN z USING (bucket) GROUP BY row
), b AS (
  SELECT row, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d JOIN w USING (row) LEFT JOIN l USING (row) LEFT JOIN r USING (row)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {ngram_ratio.LEAST_WORDS} OR 100 * n_repeat_words > {ngram_ratio.REPEATED_PERCENT} * n_words AS base_failed,
       NOT (n_words < {ngram_ratio.LEAST_WORDS} OR 100 * n_repeat_words > {ngram_ratio.REPEATED_PERCENT} * n_words)
         AND s.ratio >= CAST(floor({ngram_ratio.FLOOR} * {ngram_ratio.SCALE}) AS BIGINT) * s.n AS kept,
       s.ratio / ({ngram_ratio.SCALE} * s.n) AS score
FROM b LEFT JOIN s USING (row)
"""

DIVERGENCE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM d
), c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM w GROUP BY ALL
), k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= {divergence.LEAST_DOCS}
), v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS n FROM k GROUP BY lang
), e AS (SELECT c.lang, c.source, c.term, c.n FROM c JOIN k USING (lang, term)
), g AS (
  SELECT lang, source, CAST(coalesce(any_value(t.n), 0) AS HUGEINT) AS n
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM e GROUP BY ALL) AS t USING (lang, source) GROUP BY ALL
), a AS (
  SELECT g.lang, g.source, k.term, coalesce(e.n, 0) AS count, 1 + (CAST({divergence.UNIT} AS HUGEINT) * (coalesce(e.n, 0) + 1)) // (g.n + v.v) AS p,
         1 + (CAST({divergence.UNIT} AS HUGEINT) * (k.n + 1)) // (v.n + v.v) AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN e ON e.lang = g.lang AND e.source = g.source AND e.term = k.term
), s AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
  FROM a AS x JOIN a AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  UNION ALL
  SELECT x.lang, x.source, 'pair', y.source, 0 FROM g AS x JOIN g AS y ON x.lang = y.lang AND x.source <> y.source WHERE x.lang NOT IN (SELECT lang FROM v)
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM a WHERE count > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM s)
WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}
"""
