"""SQL for DuckDB that gives the same rows as the queries whose results their contracts fix wholly."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

#: Words, sets of shingles, one node for equal sets; linked sets share one of the rarest shingles of either (a set of n links with
#: no other that lacks its n - ceil(0.9 n) + 1 rarest), so only those are compared; components by reachability.
NGRAM_JACCARD = rf"""WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS shingles FROM t),
g AS (SELECT min(r) AS node, shingles, min(doc_id) AS least, len(shingles) AS n FROM s WHERE len(shingles) > 0 GROUP BY shingles),
e AS (SELECT node, n, unnest(shingles) AS shingle FROM g),
f AS (SELECT shingle, count(*) AS c FROM e GROUP BY 1 HAVING count(*) > 1),
p AS (SELECT node, n, shingle FROM (SELECT e.node, e.n, e.shingle, f.c, row_number() OVER (PARTITION BY e.node ORDER BY coalesce(f.c, 1), e.shingle) AS k FROM e LEFT JOIN f ON f.shingle = e.shingle) WHERE k <= n - (90 * n + 99) // 100 + 1 AND c IS NOT NULL),
c AS (SELECT DISTINCT a.node AS a, b.node AS b FROM p a JOIN p b ON a.shingle = b.shingle AND a.node < b.node AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n),
m AS (SELECT c.a, c.b, x.n + y.n AS total, len(list_intersect(x.shingles, y.shingles)) AS shared FROM c JOIN g x ON x.node = c.a JOIN g y ON y.node = c.b),
l AS (SELECT a, b FROM m WHERE 100 * shared >= 90 * (total - shared)),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
h AS (SELECT node, node AS other FROM g UNION SELECT h.node, d.b FROM h JOIN d ON d.a = h.other),
k AS (SELECT h.node, min(o.least) AS component_id FROM h JOIN g o ON o.node = h.other GROUP BY 1)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, CASE WHEN len(s.shingles) = 0 THEN s.doc_id ELSE k.component_id END AS component_id
FROM s LEFT JOIN g ON g.shingles = s.shingles LEFT JOIN k ON k.node = g.node"""

#: The same with another threshold, and which rows stay.
FOREST = NGRAM_JACCARD.replace("90 *", "85 *").replace("AS component_id\nFROM s", "AS component_id, CASE WHEN len(s.shingles) = 0 THEN TRUE ELSE s.doc_id IS NOT DISTINCT FROM k.component_id END AS kept\nFROM s")

#: All phrases of 1 to 5 words and their counts; candidates, their cuts, those within a longer one of as many, ranks.
COLLOCATIONS = rf"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) AS x(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
u AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, u.a, cut, l.f AS l, r.f AS r, n.n, 1000 * CAST(a AS HUGEINT) * CAST(n.n AS HUGEINT) // (CAST(l.f AS HUGEINT) * CAST(r.f AS HUGEINT)) AS score FROM u
  JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(w[cut + 1:], ' ') JOIN n ON n.lang = u.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS best FROM s),
i AS (SELECT lang, a, w, unnest(range(2, k)) AS size FROM c WHERE k > 2),
j AS (SELECT lang, a, array_to_string(w[o:o + size - 1], ' ') AS phrase FROM (SELECT lang, a, w, size, unnest(range(1, len(w) - size + 2)) AS o FROM i)),
d AS (SELECT b.* FROM b WHERE best = 1 AND NOT EXISTS (SELECT 1 FROM j WHERE j.lang = b.lang AND j.phrase = b.phrase AND 100 * j.a >= 100 * b.a)),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM k WHERE rank <= 2000"""

#: The base measures and base_failed are the contract's; kept is what the default rules say, in whatever order they stand.
QUALITY = rf"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_WORD}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, regexp_replace(text, '[^\p{{L}}]', '', 'g') AS letters FROM t),
e AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) AS five FROM a WHERE len(w) >= 5),
v AS (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS times FROM e),
q AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM v, range(0, 5) AS x(o) WHERE times > 1 GROUP BY 1),
m AS (SELECT a.*, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(q.n_repeat_words, 0) AS n_repeat_words FROM a LEFT JOIN q ON q.r = a.r),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > 0.25 * n_words OR n_dup_lines > 0.3 * len(lines) OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 0.5 * word_chars > length(letters)
    OR (length(regexp_replace(letters, '[^\p{{Lu}}]', '', 'g')) > 0.7 * length(letters) AND n_words >= 10) OR length(text) - length(replace(text, '!', '')) > 0.5 * n_words
    OR len(list_filter(lines, lambda x: ends_with(x, '...'))) > 0.5 * len(lines) OR len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) > 0.9 * len(lines)
    OR coalesce(list_max(list_transform(w, lambda x: length(x))), 0) > 1000) AS kept FROM b"""
