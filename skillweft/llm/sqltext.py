"""SQL counterparts, for DuckDB over the same tables."""

from skillweft.llm.licenses import ALIGNED, template_bigrams, template_places

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


_NORMAL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({ascii_lower('text')}, '{_NORMAL}') AS w FROM documents
), b AS (
  SELECT item_id, w, least(10, len(w)) AS size
  FROM (SELECT item_id, regexp_extract_all({ascii_lower('text')}, '{_NORMAL}') AS w FROM benchmark)
  WHERE len(w) > 0
), pattern AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM b)
), sizes AS (
  SELECT DISTINCT size FROM b
), place AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size
), found AS (
  SELECT doc_id, item_id, i, size
  FROM (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS words FROM place)
  JOIN pattern USING (size, words)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id
), item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""

CHAT = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, replace(replace(text, '&', '&amp;'), '<|', '&lt;|') AS body,
    replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;') AS head,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + CASE WHEN before IS NOT DISTINCT FROM role THEN length('<|im_sep|>')
    ELSE length('<|im_start|>') + length(head) + 1 + length('<|im_end|>') + 1 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_SPACED = r"[^\x20\x09-\x0D]+"

NGRAM_JOIN = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({ascii_lower('text')}, '{_SPACED}') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g
  FROM d
), g AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS shingle FROM s
), pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS shared
  FROM g x JOIN g y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
    AND 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n)
  GROUP BY ALL
), link AS (
  SELECT a, b FROM pair WHERE 100 * shared >= 90 * (na + nb - shared)
), edge AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT a AS node, a AS seen FROM edge
  UNION SELECT r.node, e.b FROM reach r JOIN edge e ON r.seen = e.a
), root AS (
  SELECT node, min(seen) AS component_id FROM reach GROUP BY node
), class AS (
  SELECT doc_id, CASE WHEN len(g) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(g)) END AS class_id FROM s
), degree AS (
  SELECT x.class_id, count(DISTINCT y.class_id) AS n_links FROM edge
  JOIN class x ON x.doc_id = edge.a JOIN class y ON y.doc_id = edge.b WHERE x.class_id <> y.class_id GROUP BY x.class_id
)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links,
  coalesce(component_id, doc_id) AS component_id
FROM s JOIN class USING (doc_id) LEFT JOIN degree USING (class_id) LEFT JOIN root ON root.node = s.doc_id
"""

SUBSTRINGS = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), first AS (
  SELECT h, min(doc_id) AS owner FROM win GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (h) WHERE owner < doc_id
), word AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS text, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def _license_rows() -> str:
    return ", ".join(
        f"('{name}', {len(own)}, '{bigram}')" for name, own in sorted(template_bigrams().items()) for bigram in sorted(own)
    )


def _license_places() -> str:
    return ", ".join(f"('{name}', {q}, '{bigram}', {length})" for name, q, bigram, length in template_places())


LICENSES = rf"""
WITH t(license, size, bigram) AS (VALUES {_license_rows()}
), c AS (
  SELECT doc_id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS clean FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT doc_id, clean, CASE WHEN instr(clean, chr(10)) > 0 THEN regexp_split_to_array(clean, '\n ?\n[ \n]*')
    ELSE []::VARCHAR[] END AS blocks FROM c
), u AS (
  SELECT doc_id, generate_subscripts(x, 1) AS unit, trim(replace(unnest(x), chr(10), ' ')) AS words
  FROM (SELECT doc_id, list_concat(string_split(clean, chr(10)),
    list_filter(blocks, lambda b: instr(trim(b, ' '), chr(10)) > 0),
    CASE WHEN len(blocks) > 1 THEN [clean] ELSE []::VARCHAR[] END) AS x FROM b)
), l AS (
  SELECT doc_id, unit, regexp_split_to_array(words, ' +') AS l FROM u WHERE words <> ''
), n AS (
  SELECT doc_id, unit, list_distinct(CASE WHEN len(l) > 1
    THEN list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]) ELSE l END) AS g FROM l
), m AS (
  SELECT doc_id, unit, license, size, 2.0::DOUBLE * count(*) / (n + size) AS dice
  FROM (SELECT doc_id, unit, len(g) AS n, unnest(g) AS bigram FROM n) JOIN t USING (bigram)
  GROUP BY doc_id, unit, license, n, size
), place(license, q, bigram, length) AS (VALUES {_license_places()}
), own AS (
  SELECT license, list(DISTINCT bigram) AS own FROM t GROUP BY license
), whole AS (
  SELECT doc_id, hash(clean) AS text_no, regexp_split_to_array(trim(replace(clean, chr(10), ' ')), ' +') AS l FROM c
), seed AS (
  SELECT doc_id, text_no, i, l[i] || ' ' || l[i + 1] AS bigram
  FROM (SELECT DISTINCT doc_id, text_no, l, unnest(range(1, len(l))) AS i FROM whole WHERE len(l) > 1)
), start AS (
  SELECT doc_id, text_no, license, length, i - q AS s FROM seed JOIN place USING (bigram)
  GROUP BY ALL HAVING count(*) * {ALIGNED} >= length - 1
), win AS (
  SELECT DISTINCT s.doc_id, license, s, s.text_no, own, list_distinct(list_transform(range(greatest(s, 1), least(s + length - 1, len(l))),
    lambda i: l[i] || ' ' || l[i + 1])) AS g
  FROM start s JOIN whole w ON s.text_no = w.text_no AND s.doc_id IS NOT DISTINCT FROM w.doc_id JOIN own USING (license)
), every AS (
  SELECT doc_id, license, size, dice FROM m
  UNION ALL SELECT doc_id, license, len(own), 2.0::DOUBLE * len(list_intersect(g, own)) / (len(g) + len(own)) FROM win
), f AS (
  SELECT doc_id, arg_min(license, (-dice, -size, license)) AS license, max(dice) AS dice,
    string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
  FROM every WHERE dice >= 0.8 GROUP BY doc_id
)
SELECT doc_id, license, dice, coalesce(licenses, '') AS licenses FROM documents LEFT JOIN f USING (doc_id)
"""


HARD_NEGATIVES = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r, a.vec_id AS anchor_id, a.label AS own, b.r AS other, b.vec_id, b.label,
    CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other) AS place
  FROM s WHERE label = own QUALIFY place <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score,
    s.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.vec_id NULLS LAST, s.other) AS rank
  FROM p JOIN s ON p.r = s.r WHERE s.label <> s.own AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 10
"""
