"""The subpackage's queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, cover_tree, html_template, jaccard_join, lsh_forest, mixing, packing, quality, substring_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.nearest(_table(spark, sf_dir, "embeddings")).select(F.col("query_id"), "rank", "vec_id", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract_main_text(_table(spark, sf_dir, "pages"))


def op4_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(sample).alias("text"))
    made = chat.format_chats(rows.unionByName(own)).where("checked IS NULL")
    turns = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")

    def under(s):
        cut = F.substr("formatted", s["start"] + 1, s["length"])
        return F.when(s["escaped"], chat.unescaped(cut)).otherwise(cut)

    loss = F.array_join(F.transform("loss_spans", under), "")
    return made.select(
        "conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_best_fit(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_dedup(_table(spark, sf_dir, "embeddings"), threshold=0.98)


QUERIES = {f.__name__: f for f in (op1_lsh_forest, op2_substring_dedup, op3_template_extraction, op4_warc_writer, op5_chat_format, op6_pareto_mixing, op7_jaccard_join, op8_compression_quality, op9_best_fit_packing, op10_cover_tree)}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
#: Where SQL can state the result on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op1_lsh_forest": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x) AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id AND len(q.x) = len(v.x))
SELECT query_id, row_number() OVER w AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 20""",
    "op2_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, unnest(generate_series(1, len(w) - 19)) AS i, w FROM d WHERE len(w) >= 20),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i : i + 19], ' ') ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
words AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS i, unnest(w) AS word FROM d),
gone AS (SELECT words.doc_id, words.i, word, max((late.i IS NOT NULL)::INT) OVER (PARTITION BY words.doc_id ORDER BY words.i ROWS 19 PRECEDING) AS g FROM words LEFT JOIN late ON late.doc_id = words.doc_id AND late.i = words.i),
k AS (SELECT doc_id, count(*) AS n_words, sum(g)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (g = 0), '') AS kept FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op4_warc_writer": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM q),
v AS (SELECT *, list_transform(range(0, 8), lambda g: list_sum(list_transform(range(1, 6), lambda j: (instr('0123456789abcdef', x[5 * g + j]) - 1) * (1 << (4 * (5 - j)))))::BIGINT) AS parts FROM m)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((parts[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
 CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM v""",
    "op5_chat_format": """
WITH src AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, bool_or(contains(text, '</s>')) OVER (PARTITION BY conv_id) AND regexp_matches(text, '[<\\[\\]]') AS e, CASE role WHEN 'user' THEN 4 WHEN 'system' THEN 3 WHEN 'assistant' THEN 3 ELSE 5 + length(role) END AS tag FROM src)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(length(text) + 14 + 2 * tag + CASE WHEN e THEN 2 + length(regexp_replace(text, '[^~<\\[\\]]', '', 'g')) ELSE 0 END)::BIGINT AS formatted_chars FROM t GROUP BY conv_id""",
    "op7_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM l JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.k + y.k - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS i, doc_id AS c FROM d UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.i WHERE r.c < u.b)
SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, min(r.c) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.i = d.doc_id GROUP BY 1, 2""",
    "op10_cover_tree": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS i, vec_id AS c FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.i WHERE r.c < e.b),
k AS (SELECT i, min(c) AS c FROM r GROUP BY i), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN k ON k.i = vec_id LEFT JOIN n ON n.a = vec_id""",
}
