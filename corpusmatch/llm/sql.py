"""SQL twins of the operators that SQL can express on whole tables."""

#: The mix as SQL: the same hash, and running sums over documents in place of histograms.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS hash
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM d GROUP BY source),
w AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         CASE (place - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) /
            (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         least(cap, coalesce(first_value(CASE WHEN level * weight <= cap THEN level END IGNORE NULLS)
           OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * weight, cap)) AS target
  FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
r AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.hash) AS tie
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (passes + CASE WHEN 2 * upto - tie <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""

#: Phrases by exploding all n-grams, cuts by joins, in 128-bit integers.
OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
t AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
x AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE len(words) > 0),
f AS (
  SELECT lang, words[i:i + k - 1] AS words, count(*) AS f FROM x, range(1, 6) AS s(k)
  WHERE i + k - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 100),
c AS (
  SELECT a.lang, a.words, a.f AS a, l.f AS l, r.f AS r, t.n, CAST(1000::HUGEINT * a.f * t.n // (l.f::HUGEINT * r.f) AS BIGINT) AS score,
         row_number() OVER (PARTITION BY a.lang, a.words ORDER BY 1000::HUGEINT * a.f * t.n // (l.f::HUGEINT * r.f), k) AS nth
  FROM (SELECT *, unnest(range(1, len(words))) AS k FROM f) AS a
  JOIN f AS l ON l.lang = a.lang AND l.words = a.words[1:k]
  JOIN f AS r ON r.lang = a.lang AND r.words = a.words[k + 1:]
  JOIN t ON t.lang = a.lang),
s AS (
  SELECT lang, words[i:i + k - 1] AS words, max(f) AS most
  FROM (SELECT *, unnest(range(1, len(words))) AS i FROM f) AS u, range(2, 5) AS v(k)
  WHERE k < len(words) AND i + k - 1 <= len(words) GROUP BY ALL),
o AS (
  SELECT c.lang, array_to_string(c.words, ' ') AS phrase, a, l, r, n, score
  FROM c LEFT JOIN s ON s.lang = c.lang AND s.words = c.words
  WHERE nth = 1 AND (s.most IS NULL OR 100 * s.most < 100 * a)),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM b WHERE rank <= 2000
"""

#: Common terms by counting all terms, distances by a join of all sources for each term, in 128-bit integers.
OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
o AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
g AS (
  SELECT DISTINCT d.lang, d.source, coalesce(v, 0) AS v, coalesce(t.total, 0) AS total, coalesce(l.total, 0) AS lang_total
  FROM d LEFT JOIN v USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source) AS t ON t.lang = d.lang AND t.source = d.source
  LEFT JOIN (SELECT lang, sum(n)::HUGEINT AS total FROM c GROUP BY lang) AS l ON l.lang = d.lang),
s AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.total + 5 * g.v) AS p,
         1 + 1000000000::HUGEINT * (sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term) + 5) // (g.lang_total + 5 * g.v) AS q
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM s AS a JOIN s AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM s WHERE n > 0 AND p > q),
x AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM x WHERE part = 'pair' OR rank <= 50
"""
