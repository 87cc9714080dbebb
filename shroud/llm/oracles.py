"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10"""

_PHRASES = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM p
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
  FROM w, range(1, 5) r(k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30
), cuts AS (
  SELECT lang, k, phrase, a, j, array_to_string(list_slice(w, 1, j), ' ') AS left_, array_to_string(list_slice(w, j + 1, k), ' ') AS right_
  FROM c, range(1, 4) r(j) WHERE j < k
), scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.k = j AND x.phrase = left_ JOIN f y ON y.lang = cuts.lang AND y.k = cuts.k - j AND y.phrase = right_
  QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.k, cuts.phrase ORDER BY score, j) = 1
), inner_ AS (
  SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS b
  FROM c, range(2, 4) r(m), range(1, 4) s(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL
), kept AS (
  SELECT scored.* FROM scored LEFT JOIN inner_ USING (lang, phrase) WHERE b IS NULL OR 100 * b < 80 * a
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
)
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER o <= 2000"""

_WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS s FROM pages),
     f AS (SELECT s, min(page_id) AS m FROM p WHERE b >= 100 GROUP BY s)
SELECT page_id, b AS payload_bytes, s AS payload_digest, CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m <> page_id THEN m END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM p LEFT JOIN f USING (s)"""

_SEARCH = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20"""

#: Least reachable id: ids and links spread until nothing changes (a plain closure, for small tables).
_REACH = """reach AS (
  SELECT id AS a, id AS b FROM ids UNION SELECT reach.a, l.b FROM reach JOIN links l ON l.a = reach.b
), least AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

_NEAR = f"""
WITH RECURSIVE v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), n AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE list_dot_product(e, e) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM n x JOIN n y ON x.id <> y.id AND list_dot_product(x.e, y.e) / (x.size * y.size) >= 0.95),
ids AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE links.a = least.id) AS n_links, component_id, id = component_id AS kept FROM least"""

_JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM w
), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
ids AS (SELECT doc_id AS id FROM documents),
common AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y USING (s) WHERE x.id <> y.id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * c >= 80 * (x.n + y.n - c)), {_REACH}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id FROM least LEFT JOIN n USING (id)"""

ORACLES: dict[str, str] = {
    "op2_warc": _WARC,
    "op6_embeddings": _NEAR,
    "op7_jaccard": _JACCARD,
    "op8_search": _SEARCH,
    "op12_phrases": _PHRASES,
    "op13_negatives": _NEGATIVES,
}
