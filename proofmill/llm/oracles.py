"""DuckDB SQL that returns the rows of this subpackage's queries, where SQL can express them."""

from __future__ import annotations

from proofmill.llm.chat import OPEN, TRAINED
from proofmill.llm.importance import BUCKETS, LEAST_WORDS, PERCENT, SEED
from proofmill.llm.licenses import CLASSES, CONTAINED, PHRASES, REACH
from proofmill.llm.vectors import LEAST_COSINE

#: Runs of letters, digits and characters beyond ASCII.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def license_scan() -> str:
    places = " UNION ALL ".join(
        f"SELECT rid, '{label}' AS label, i FROM w, range(len(ws)) AS r(i) WHERE " + " AND ".join(f"ws[i + {k + 1}] = '{word}'" for k, word in enumerate(phrase)) for label, phrase in PHRASES
    )
    templates = ", ".join(f"({k}, '{label}', list_distinct(string_split('{text}', ' ')))" for k, texts in enumerate(CLASSES) for label, text in texts)
    blocks = " UNION ALL ".join(f"SELECT rid, {k} AS cls, list_distinct(ws[s + 1 : s + {2 * r}]) AS rel FROM g, range(0, greatest(len(ws) - {r}, 1), {r}) AS r(s)" for k, r in enumerate(REACH))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, list_transform(regexp_extract_all(text, '{LICENSE_WORD}'), lambda x: translate(x, '{_UPPER}', '{_LOWER}')) AS ws FROM d),
p AS ({places}),
t(cls, label, words) AS (VALUES {templates}),
g AS (SELECT rid, regexp_extract_all(lower(text), '{LICENSE_WORD}') AS ws FROM d),
b AS ({blocks}),
m AS (SELECT rid, label, max(len(list_intersect(rel, words)) / len(words)) AS share FROM b JOIN t USING (cls)
      WHERE len(list_intersect(rel, words)) >= ceil({CONTAINED} * len(words)) GROUP BY rid, label),
pp AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY rid),
l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM p UNION SELECT rid, label FROM m) GROUP BY rid),
s AS (SELECT rid, max(share) AS share FROM m GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM w LEFT JOIN pp USING (rid) LEFT JOIN l USING (rid) LEFT JOIN s USING (rid)
"""


def embedding_near_dedup() -> str:
    return f"""
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= {LEAST_COSINE}),
c(id, r) AS (SELECT vec_id, vec_id FROM (SELECT DISTINCT vec_id FROM embeddings) UNION SELECT c.id, p.y FROM c JOIN p ON c.r = p.x),
n AS (SELECT x, count(*) AS n FROM p GROUP BY x), m AS (SELECT id, min(r) AS component_id FROM c GROUP BY id)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM m LEFT JOIN n ON id = x
"""


def ngram_jaccard() -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM d),
c AS (SELECT min(doc_id) AS rep, k AS s, len(k) AS n FROM (SELECT doc_id, list_sort(s.s) AS k FROM s WHERE len(s.s) > 0) GROUP BY k),
e AS (SELECT rep, n, unnest(s) AS h FROM c),
o AS (SELECT a.rep AS x, b.rep AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.rep < b.rep GROUP BY a.rep, b.rep),
p AS (SELECT x, y FROM o WHERE 100 * k >= 85 * (n + m - k)),
q AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
r(id, r) AS (SELECT rep, rep FROM c UNION SELECT r.id, q.y FROM r JOIN q ON r.r = q.x),
m AS (SELECT id, min(r) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN m ON m.id = c.rep
"""


def substring_dedup() -> str:
    return """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 20], ' ')) AS h FROM d, range(len(w) - 19) AS r(i)),
u AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM v) WHERE nth > 1),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM u, range(20) AS t(k)),
x AS (SELECT doc_id, p, w[p + 1] AS word FROM d, range(len(w)) AS r(p)),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM x ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


def preference_format() -> str:
    turn = f"concat('{OPEN}', replace(replace(x.role, '{OPEN}', '< |'), '|>', '| >'), '|>', chr(10), replace(x.text, '{OPEN}', '< |'), '<|end|>', chr(10))"
    mask = f"""array_to_string(list_transform(list_filter(range(1, len({{c}}) + 1), lambda i: {{c}}[i].role = '{TRAINED}'), lambda i:
        concat(coalesce(list_sum(list_transform({{c}}[1 : i - 1], lambda x: length({turn}))), 0)::BIGINT + length({{c}}[i].role) + 5, ':',
               list_sum(list_transform({{c}}[1 : i], lambda x: length({turn})))::BIGINT)), ',')"""
    text = f"array_to_string(list_transform({{c}}, lambda x: {turn}), '')"
    return f"""
WITH l AS (SELECT conv_id, max(struct_pack(turn := turn, text := text)) AS last FROM conversations WHERE role = '{TRAINED}' AND conv_id IS NOT NULL GROUP BY conv_id),
s AS (SELECT a.conv_id, a.last.turn AS turn, b.last.text AS text FROM l a JOIN l b ON b.conv_id = xor(a.conv_id, 1)),
t AS (SELECT c.conv_id, c.turn, coalesce(c.role, '') AS role, coalesce(c.text, '') AS own,
             coalesce(CASE WHEN c.role = '{TRAINED}' AND s.turn = c.turn THEN s.text ELSE c.text END, '') AS other
      FROM conversations c LEFT JOIN s USING (conv_id) WHERE c.conv_id IS NOT NULL),
p AS (SELECT conv_id, list_sort(list_distinct(list(struct_pack(turn := turn, role := role, text := own)))) AS a,
             list_sort(list_distinct(list(struct_pack(turn := turn, role := role, text := other)))) AS b FROM t GROUP BY conv_id),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i].role <> b[i].role OR a[i].text <> b[i].text)) - 1, least(len(a), len(b))) AS k FROM p),
r AS (SELECT conv_id, k, a[1 : k] AS pre, a[k + 1 :] AS a, b[k + 1 :] AS b FROM n)
SELECT conv_id, k::BIGINT AS n_common, {text.format(c="pre")} AS prompt, {text.format(c="a")} AS chosen, {text.format(c="b")} AS rejected,
       {mask.format(c="a")} AS chosen_mask, {mask.format(c="b")} AS rejected_mask FROM r
"""


def benchmark_leaks() -> str:
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{LICENSE_WORD}') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '{LICENSE_WORD}') AS w FROM benchmark),
x AS (SELECT DISTINCT doc_id, p, w[p + 1] AS word FROM d, range(len(w)) AS r(p)),
y AS (SELECT item_id, p, len(w) AS n, w[p + 1] AS word FROM b, range(len(w)) AS r(p)),
e AS (SELECT doc_id, item_id, x.p - y.p AS start, y.p AS p, any_value(n) AS n FROM x JOIN y USING (word) GROUP BY ALL),
f AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, start ORDER BY p RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS k FROM e),
g AS (SELECT doc_id, item_id, start, any_value(n) AS n, count(*) AS n_equal FROM f GROUP BY ALL HAVING max(k) >= CASE WHEN any_value(n) < 7 THEN any_value(n) ELSE ceil(0.8 * least(13, any_value(n))) END)
SELECT doc_id, item_id, start::BIGINT AS start, n::BIGINT AS n_words, n_equal::BIGINT AS n_equal, n_equal / n AS similarity
FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, start) = 1
"""


def importance_draw() -> str:
    ids = "rid, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0)))::BIGINT AS score"
    return f"""
WITH k AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, step: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS r(i))),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{LICENSE_WORD}') AS ws FROM documents),
e AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{LICENSE_WORD}') AS ws FROM benchmark),
dw AS (SELECT rid, unnest(ws) AS word FROM d), ew AS (SELECT unnest(ws) AS word FROM e),
v AS (SELECT word, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS bytes
      FROM (SELECT word FROM dw UNION SELECT word FROM ew)),
b AS (SELECT word, xor(list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(crc[xor(c % 256, x) + 1], c // 256)), 4294967295) % {BUCKETS} AS bucket FROM v, k),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN b USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM ew JOIN b USING (word) GROUP BY bucket),
a AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS s, (SELECT count(*) FROM ew)::DOUBLE AS t),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.t, 0)::DOUBLE + 1) * (a.s + {BUCKETS}) / ((coalesce(s.s, 0)::DOUBLE + 1) * (a.t + {BUCKETS}))))::BIGINT AS gain
      FROM (SELECT DISTINCT bucket FROM b) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), a),
w AS (SELECT rid, sum(gain)::BIGINT AS weight FROM dw JOIN b USING (word) JOIN g USING (bucket) GROUP BY rid),
n AS (SELECT rid, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (rid)),
c AS (SELECT {ids} FROM n),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS every FROM c WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= every * {PERCENT} // 100 THEN place END::BIGINT AS rank FROM c LEFT JOIN r USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_preference_format": preference_format(), "op2_benchmark_leaks": benchmark_leaks(), "op6_license_scan": license_scan(), "op8_embedding_near_dedup": embedding_near_dedup(), "op9_substring_dedup": substring_dedup(), "op10_ngram_jaccard": ngram_jaccard(), "op11_importance_draw": importance_draw()}
