"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chunks, decontaminate, media, mixing, pii, quality, simhash, strings, warc
from .common import hash_mod, table


def op1_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "shard")


def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.from_ogg(media.to_ogg(table(spark, sf_dir, "documents")))


def op3_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("place")


def op4_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pages = warc.archive_path(spark), table(spark, sf_dir, "pages")
    warc.write(pages, path)
    return warc.read(spark, path, pages.schema["page_id"].dataType.simpleString()).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = strings.score(docs, strings.fit(docs, labels))
    return scored.select("doc_id", F.coalesce(hash_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_chat_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\\### Assistant: </turn> ok"
    more = spark.sql(f"select * from values (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') as t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.render(rows.unionByName(more)))


def op7_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items", "matches")


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.detect(table(spark, sf_dir, "documents")))


def op9_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", F.coalesce(hash_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


def op10_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.duplicates(table(spark, sf_dir, "documents"), least_words=51).drop("place")


QUERIES = {f.__name__: f for f in (op1_sainte_lague_mix, op2_ogg_media, op3_simhash_bktree, op4_warc_chain, op5_string_kernel_toxicity, op6_chat_grammar, op7_suffix_array_decontamination, op8_pii_spans, op9_factorisation_quality, op10_gear_chunks)}

# The results that SQL can express, for another engine.
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ORACLE_SQL: dict[str, str] = {
    "op4_warc_chain": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p),
 g AS (SELECT *, first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM f)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
 list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform(range(4), lambda j: substr('{_B32}', (((('0x' || substr(h, 1 + 5 * i::INT, 5))::BIGINT >> (15 - 5 * j)::BIGINT) & 31))::INT + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
 CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM g""",
    "op6_chat_grammar": r"""WITH said AS (SELECT '\### Assistant: </turn> ok' AS s),
 r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', s FROM said UNION ALL SELECT -7, 1, 'assistant', s FROM said),
 e AS (SELECT *, regexp_replace(text, '<(\\*)/turn>', '<\1\\/turn>', 'g') AS body, replace(replace(replace(role, '%', '%25'), '>', '%3E'), '</', '%3C/') AS named FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(length(named) + length(body) + 15)::BIGINT AS formatted_chars FROM e GROUP BY conv_id""",
    "op7_suffix_array_decontamination": r"""WITH w AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
 b AS (SELECT DISTINCT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
 bw AS (SELECT DISTINCT item, least(13, len(words)) AS size, j, array_to_string(words[j : j + least(13, len(words)) - 1], ' ') AS gram FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 13, 0) + 2)) AS j FROM b WHERE len(words) > 0)),
 sizes AS (SELECT DISTINCT size FROM bw),
 dw AS (SELECT d, size, i, array_to_string(words[i : i + size - 1], ' ') AS gram FROM (SELECT d, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM w, sizes)),
 hits AS (SELECT d, i, j, item, dw.size AS size FROM dw JOIN bw ON dw.size = bw.size AND dw.gram = bw.gram),
 runs AS (SELECT d, item, size, i - j AS lag, i - row_number() OVER (PARTITION BY d, item, size, i - j ORDER BY i) AS run FROM hits),
 far AS (SELECT d, max(n) AS longest FROM (SELECT d, count(*) - 1 + size AS n FROM runs GROUP BY d, item, size, lag, run) GROUP BY d),
 spots AS (SELECT d, count(DISTINCT k) AS n_hit FROM (SELECT d, unnest(range(i, i + size)) AS k FROM hits) GROUP BY d),
 found AS (SELECT d, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT d, item FROM hits) GROUP BY d)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated, coalesce(longest, 0)::BIGINT AS longest
 FROM w LEFT JOIN spots USING (d) LEFT JOIN found USING (d) LEFT JOIN far USING (d)""",
}
