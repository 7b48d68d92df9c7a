"""The subpackage's registered queries, thin digests of the operators' results, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.langid import fitted, held_out, predicted

    docs = table(spark, sf_dir, "documents")
    found = predicted(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), fitted(docs), ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.warc import archive_pages, capture_index

    scratch = Scratch(spark, "op2")
    found = capture_index(archive_pages(table(spark, sf_dir, "pages"), scratch), scratch)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp", "capture")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.simhash import hexed, simhash_groups

    found = simhash_groups(table(spark, sf_dir, "documents"), Scratch(spark, "op3"))
    return found.select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.suffix_dedup import repeated_bytes

    found = repeated_bytes(table(spark, sf_dir, "documents"), Scratch(spark, "op4"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.decontam import overlaps

    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.chat import formatted, linear_tree, loss_text, parsed

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    mark = F.lit("</s>[INST] ok [/INST]")
    own = [spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), mark.alias("text")) for i, role in enumerate(("user", "assistant"))]
    out = formatted(linear_tree(turns.unionByName(own[0]).unionByName(own[1])), Scratch(spark, "op6"))
    read = out.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.sharding import LAW, SHARDS, row_size, shard_of, sharded

    out = sharded(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op7"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    return out.select(
        "doc_id", row_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.lit(LAW).alias("law"),
        "shard", "slot", shard_of(F.col("doc_id"), SHARDS + 1).alias("grown_shard"),
    )


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.embed_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark, "op8"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.lm import likelihoods

    found = likelihoods(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))


OP5_SQL = r"""
WITH fold AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, coalesce(w, []) AS w FROM fold),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS n, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bw),
sizes AS (SELECT DISTINCT n FROM windows),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
found AS (SELECT doc_id, windows.n, i, item_id FROM
          (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM dw) x JOIN windows ON x.s = windows.s AND x.n = windows.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS names FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '|>', '|\>'), '</s>', '<\/s>'),
              '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>') AS body FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(length(role) + length(body) + 8) AS formatted_chars FROM e GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""

OP8_SQL = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, a FROM links UNION SELECT r.a, p.b FROM r JOIN pairs p ON r.b = p.a) SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(coalesce(low, vec_id) AS BIGINT) AS component_id, vec_id = coalesce(low, vec_id) AS kept
FROM v LEFT JOIN links ON links.a = vec_id LEFT JOIN reach ON reach.a = vec_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_chat": op6_chat,
    "op7_shards": op7_shards,
    "op8_embeddings": op8_embeddings,
    "op9_lm_score": op9_lm_score,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {"op5_decontaminate": OP5_SQL, "op6_chat": OP6_SQL, "op8_embeddings": OP8_SQL}
