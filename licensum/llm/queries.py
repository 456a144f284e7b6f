"""The queries over the operators of this subpackage, and the SQL of those that SQL can express."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from licensum.llm import bpe, chat_format, exact_dedup, hilbert_shards, language_id, maxent_lm, mixing, quality, range_coder, simhash, spelling, url_filter, whitening
from licensum.session import shared_folder

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_range_coded_ids")
def op1(spark, folder):
    path = shared_folder(spark)
    range_coder.write(table(spark, folder, "documents"), path, tokenizer=public_tokenizers.path("word_bpe_49k.json"), end=2)
    docs = range_coder.read(spark, path).select("shard", "frame", "before", "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return docs.join(range_coder.frame_starts(spark, path), ["shard", "frame"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


@query("op2_simhash_near_dedup")
def op2(spark, folder):
    found = simhash.simhash_components(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op3_language_id")
def op3(spark, folder):
    return language_id.identify(table(spark, folder, "documents"))


URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


@query("op4_url_filter")
def op4(spark, folder):
    return url_filter.judge(table(spark, folder, "pages"), URL_RULES)


@query("op5_quality_rules")
def op5(spark, folder):
    judged = quality.judge(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


@query("op6_hilbert_shards")
def op6(spark, folder):
    placed = hilbert_shards.assign(table(spark, folder, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


@query("op7_bpe_round_trip")
def op7(spark, folder):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe.decode(bpe.encode(table(spark, folder, "documents"), path=path), path=path)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@query("op8_entropy_mixing")
def op8(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")


@query("op9_lm_scores")
def op9(spark, folder):
    return maxent_lm.score(table(spark, folder, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query(
    "op10_exact_dedup",
    r"""
    WITH d AS (
      SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
      FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
      row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
    """,
)
def op10(spark, folder):
    docs = table(spark, folder, "documents")
    digest = F.sha2(exact_dedup.normalised(F.col("text")), 256)
    judged = exact_dedup.exact_dedup(docs.select("doc_id", "text", digest.alias("text_sha256")), keep_columns=["doc_id", "text_sha256"])
    return judged.select("row.doc_id", "keep_id", "group_size", "kept", "row.text_sha256")


@query(
    "op11_chat_format",
    r"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
    f AS (
      SELECT *, concat('<turn:', url_encode(role), '>',
        regexp_replace(text, '<(\\*)(/?(turn|text|image|audio|document|part)[:>])', '<\\\1\2', 'g'), '</turn>', chr(10)) AS formatted
      FROM t),
    g AS (
      SELECT conv_id, count(*) AS n_turns, sum(length(formatted))::BIGINT AS formatted_chars,
        string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, formatted) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, formatted) FILTER (role = 'assistant'), '') AS loss
      FROM f GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
    """,
)
def op11(spark, folder):
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = shared_folder(spark)
    chat_format.write(chat_format.format_turns(turns), path)
    return chat_format.digests(spark.read.parquet(path)).drop("expanded_tokens")


@query("op12_spelling_variants")
def op12(spark, folder):
    return spelling.variants(spelling.vocabulary(table(spark, folder, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_whitened_embeddings")
def op13(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)
