"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.llm import bpe, cells, chat, codes, decontaminate, iblt, langid, pii, ppm, prefixtrie, quality, simhash, substring
from factloom.llm.common import table


def op1_ppm(spark, sf_dir):
    return ppm.report(table(spark, sf_dir, "documents"))


def op2_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.public())


def op3_decontaminate(spark, sf_dir):
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out()
    found = langid.predict(docs.select(F.col("doc_id").cast("long"), "text"), langid.learn(docs.where(~held)), ["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_simhash(spark, sf_dir):
    return simhash.report(table(spark, sf_dir, "documents"))


def op9_substring(spark, sf_dir):
    return substring.report(table(spark, sf_dir, "documents"))


def op5_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op7_chat(spark, sf_dir):
    return chat.report(table(spark, sf_dir, "conversations"))


def op6_fingerprints(spark, sf_dir):
    return iblt.report(table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    held = langid.held_out()
    found = quality.classify(table(spark, sf_dir, "documents"), labels, ~held)
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


def op11_near_vectors(spark, sf_dir):
    return cells.report(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark, sf_dir):
    return prefixtrie.report(table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark, sf_dir):
    return codes.report(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ppm, op2_bpe, op3_decontaminate, op4_language_id, op5_pii, op6_fingerprints, op7_chat, op8_simhash, op9_substring, op10_quality,
        op11_near_vectors, op12_prefix_trie, op13_vector_codes,
    )
}

ORACLE_SQL = {
    "op3_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS s
       FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN bw USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op9_substring": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, hash(array_to_string(w[p : p + 12], ' ')) AS s, md5(array_to_string(w[p : p + 12], ' ')) AS m
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
first AS (SELECT s, m, min(doc_id) AS f FROM win GROUP BY s, m),
gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 13)) AS q FROM win JOIN first USING (s, m) WHERE f < doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM d),
kept AS (SELECT doc_id, count(gone.q) AS n_removed, string_agg(word, ' ' ORDER BY q) FILTER (WHERE gone.q IS NULL) AS t FROM words LEFT JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_chat": r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL SELECT -7, n, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(n, r)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             sum(length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<]', 'xx', 'g')) + 14) AS n
      FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM g""",
    "op11_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                     WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT reach.vec_id, b FROM reach JOIN links ON other = a),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN n USING (vec_id)""",
    "op12_prefix_trie": r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
           FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT DISTINCT conv_id, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])) AS l FROM t),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
                 xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), l), lambda a, v: xor(xor(a, v) >> 1, (xor(a, v) & 1) * 3988292384)), 4294967295) % 4 AS h FROM bits),
heads AS (SELECT convs.conv_id, t.n, t.role, t.text FROM convs JOIN t ON t.conv_id = base AND n <= h),
k AS (SELECT convs.conv_id, h, count(n) AS k FROM convs LEFT JOIN heads USING (conv_id) GROUP BY convs.conv_id, h),
r AS (SELECT conv_id, n AS d, role, text FROM heads UNION ALL SELECT t.conv_id, n - h + k, role, text FROM t JOIN k USING (conv_id) WHERE n > h),
o AS (SELECT conv_id, d, list([role, text]) OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
             d = max(d) OVER (PARTITION BY conv_id) AS ends FROM r
      UNION ALL SELECT conv_id, 0, CAST([] AS VARCHAR[][]), 0, conv_id NOT IN (SELECT conv_id FROM r) FROM convs),
nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids FROM o GROUP BY path, d),
up AS (SELECT path[1 : d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_ AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN up USING (path)),
sub AS (SELECT path[1 : a] AS path, sum((n_convs - 1) * words) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ids) AS ends_sha256
FROM full_ f JOIN sub USING (path) LEFT JOIN nodes p ON f.d > 0 AND p.path = f.path[1 : f.d - 1]""",
    "op13_vector_codes": """
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n
              FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, n, p, w[p * len(w) // 16 + 1 : (p + 1) * len(w) // 16] AS v FROM (SELECT *, unnest(range(0, 16)) AS p FROM kept)),
b0 AS (SELECT p, n - 1 AS i, v AS e FROM parts WHERE n <= 64),
a0 AS (SELECT n, parts.p, any_value(v) AS v, min(list_sum(list_transform(list_zip(v, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + i) AS best FROM parts JOIN b0 USING (p) GROUP BY n, parts.p),
m0 AS (SELECT p, i, list(m ORDER BY j) AS e FROM (SELECT p, i, j, CAST(floor(sum(x) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m
         FROM (SELECT p, best % 64 AS i, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a0) GROUP BY p, i, j) GROUP BY p, i),
b1 AS (SELECT p, i, coalesce(m0.e, b0.e) AS e FROM b0 LEFT JOIN m0 USING (p, i)),
a1 AS (SELECT n, parts.p, any_value(v) AS v, min(list_sum(list_transform(list_zip(v, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + i) AS best FROM parts JOIN b1 USING (p) GROUP BY n, parts.p),
m1 AS (SELECT p, i, list(m ORDER BY j) AS e FROM (SELECT p, i, j, CAST(floor(sum(x) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m
         FROM (SELECT p, best % 64 AS i, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a1) GROUP BY p, i, j) GROUP BY p, i),
b2 AS (SELECT p, i, coalesce(m1.e, b1.e) AS e FROM b1 LEFT JOIN m1 USING (p, i)),
a2 AS (SELECT n, parts.p, any_value(v) AS v, min(list_sum(list_transform(list_zip(v, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + i) AS best FROM parts JOIN b2 USING (p) GROUP BY n, parts.p),
found AS (SELECT n, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY n),
books AS (SELECT sha256(string_agg(x, ',' ORDER BY p, i)) AS codebooks_sha256 FROM (SELECT p, i, array_to_string(e, ',') AS x FROM b2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM found JOIN kept USING (n), books""",
}
