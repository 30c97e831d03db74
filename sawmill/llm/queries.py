"""Queries over the whole tables, one for each operator, with what their contracts ask for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.llm import ann, bpe, chat, embedding_dedup, mixing, pii, recompression, simhash, spelling, suffix_dedup, token_files, toxicity, vector_codes
from sawmill.llm.common import shared_path, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = bpe.encode(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "token_ids")
    back = bpe.decode(tokens, ranks, public_tokenizers.PATTERN)
    return back.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), {"topic": mixing.TOPIC_SHARES})
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "selected")


def _digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, "").cast("binary"), 256)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    text = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = chat.canonical_turns(rows.select("conv_id", "turn", "role", "text").unionByName(more))
    out = chat.format_turns(turns).withColumn("back", chat.read_turns(F.col("formatted")))
    out = out.withColumn("loss", chat.loss_texts(F.col("formatted"), F.col("loss_spans")))
    return out.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"),
        _digest(F.transform("back", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))).alias("turns_sha256"),
        F.length(F.array_join("loss", "")).cast("long").alias("loss_chars"), _digest(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_files.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)

    return token_files.read_shards(spark, path).select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recompression.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.annotate(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe, op2_mixing, op3_chat, op4_suffix_dedup, op5_ann, op6_token_files, op7_embedding_dedup, op8_simhash,
        op9_toxicity, op10_recompression, op11_spelling, op12_pii, op13_vector_codes,
    )
}
#: Where SQL can say it. Not: 1 and 6 (merges by rank), 2 (raking to convergence), 4 (200-byte windows are too
#: many for whole tables), 5 (approximate), 8 (no XXH64 with a seed),
#: 9 (a fitted model), 12 (context scores and checksums of the kinds beyond the base). The tests hold those against plain code.
ORACLE_SQL: dict[str, str] = {
    "op3_chat": r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(role) + length(text) + 14 + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
    "op7_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op10_recompression": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w), g AS (SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS g FROM i),
d AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM g SEMI JOIN d USING (g)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op11_spelling": """WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{5,}')) AS run FROM documents),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM runs GROUP BY ALL),
x AS (SELECT w, n, hex(encode(id || ':' || w)) AS x FROM r),
c AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda i: CAST(strpos('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) * 16 + strpos('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 17 AS BIGINT))),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM x, t),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM c),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (SELECT a.word, b.word AS near FROM d a JOIN d b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word FROM d JOIN words w ON w.word = d.d UNION SELECT w.word, d.word FROM d JOIN words w ON w.word = d.d),
k AS (SELECT near.word, near.near, w.n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, near.near) AS p FROM near JOIN words w ON w.word = near.near),
f AS MATERIALIZED (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN k.n >= 2 * words.n THEN near END AS form, CASE WHEN k.n >= 2 * words.n THEN k.n END AS form_n FROM words LEFT JOIN k ON k.word = words.word AND p = 1),
g(word, root) AS (SELECT word, word FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, g.root, f.n, f.n_near, f.form_n FROM f JOIN g ON g.word = f.word JOIN f e ON e.word = g.root AND e.form IS NULL""",
    "op13_vector_codes": """WITH v AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, k, e[k * (len(e) // 16) + 1 : (k + 1) * (len(e) // 16)] AS x FROM v, range(16) r(k)),
b0 AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS j, x FROM p QUALIFY j < 64),
a0 AS MATERIALIZED (SELECT p.vec_id, p.k, p.x, min(struct_pack(d := list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), j := b.j)) AS m FROM p JOIN b0 b USING (k) GROUP BY ALL),
m0 AS (SELECT k, m.j AS j, i, CAST(floor(sum(x[i]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS c FROM a0, range(1, 65) r(i) WHERE i <= len(x) GROUP BY ALL),
b1 AS MATERIALIZED (SELECT k, j, coalesce(n.x, b.x) AS x FROM b0 b LEFT JOIN (SELECT k, j, list(c ORDER BY i) AS x FROM m0 GROUP BY k, j) n USING (k, j)),
a1 AS MATERIALIZED (SELECT p.vec_id, p.k, p.x, min(struct_pack(d := list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), j := b.j)) AS m FROM p JOIN b1 b USING (k) GROUP BY ALL),
m1 AS (SELECT k, m.j AS j, i, CAST(floor(sum(x[i]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS c FROM a1, range(1, 65) r(i) WHERE i <= len(x) GROUP BY ALL),
b2 AS MATERIALIZED (SELECT k, j, coalesce(n.x, b.x) AS x FROM b1 b LEFT JOIN (SELECT k, j, list(c ORDER BY i) AS x FROM m1 GROUP BY k, j) n USING (k, j)),
a2 AS MATERIALIZED (SELECT p.vec_id, p.k, p.x, min(struct_pack(d := list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), j := b.j)) AS m FROM p JOIN b2 b USING (k) GROUP BY ALL),
c AS (SELECT vec_id, string_agg(lower(lpad(to_hex(m.j), 2, '0')), '' ORDER BY k) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY k, j)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN v USING (vec_id), h""",
}
