"""DuckDB SQL of the operators that SQL can express, written plainly from their contracts."""

from reviewlake.llm.repair_sql import CONVERSATION_REPAIR

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS grams FROM w),
e AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2, 3, 4),
l AS (SELECT x, y FROM p WHERE 100 * common >= 90 * (nx + ny - common)), t AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(node, other) AS (SELECT x, y FROM t UNION SELECT r.node, t.y FROM r JOIN t ON t.x = r.other)
SELECT s.doc_id, len(grams)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.least, s.doc_id)) AS component_id FROM s LEFT JOIN (SELECT node, min(other) AS least FROM r GROUP BY 1) m ON m.node = s.doc_id"""

_CUT = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_CUT} AS words FROM documents), b AS (SELECT item_id::VARCHAR AS item_id, {_CUT} AS words FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, array_to_string(words[i:i + k - 1], ' ') AS w FROM (SELECT item_id, words, least(13, len(words)) AS k, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(words[i:i + k - 1], ' ') AS w FROM (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM iw) WHERE len(words) >= k)),
h AS (SELECT dw.doc_id, dw.i, dw.k, iw.item_id FROM dw JOIN iw ON iw.k = dw.k AND iw.w = dw.w),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
f AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id)"""

_TERMS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
RANKED_SEARCH = f"""WITH d AS (SELECT doc_id, {_TERMS} AS words FROM documents), s AS (SELECT count(*) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM d WHERE len(words) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark), p AS (SELECT doc_id, len(words) AS n, unnest(words) AS t FROM d), f AS (SELECT doc_id, t, n, count(*) AS tf FROM p WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY t, n_docs),
r AS (SELECT item_id, doc_id, sum(w * (1000000000 * tf // (1000 * tf + 20 * (50 + 50 * n * n_docs // n_terms))))::BIGINT AS score FROM q JOIN w USING (t) JOIN f USING (t), s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM r WHERE score > 0) WHERE rank <= 50"""

SQL = {"op5_ngram_jaccard": NGRAM_JACCARD, "op6_decontamination": DECONTAMINATION, "op11_conversation_repair": CONVERSATION_REPAIR, "op12_ranked_search": RANKED_SEARCH}
