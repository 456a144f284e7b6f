"""From raw documents to a mixed, tokenised corpus: quality rules, exact and near duplicates, mixing, BPE."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from licensum.llm import bpe, exact_dedup, mixing, quality, simhash
from licensum.llm.common import addressed, stored

TOKENIZER = "byte_bpe_50k.json"

# Stages that compare documents decide on narrow rows and meet the whole ones once, in a join that is shuffled by address
# at every size: decisions grow with the documents, so they are never broadcast.
ADDRESS = ["file", "line"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep the base rules and read like trusted text rather than junk."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judge(docs, labels).filter("kept").select("row.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal text."""
    rows = addressed(docs)
    judged = exact_dedup.exact_dedup(rows.select("row.doc_id", "row.text", *ADDRESS), keep_columns=ADDRESS)
    dropped = judged.filter("NOT kept").select("row.*")
    return rows.join(dropped.hint("shuffle_hash"), ADDRESS, "left_anti").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints of three-word runs are within three bits of each other."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    rows = addressed(docs)
    mixed = mixing.mix(rows.select("row.doc_id", "row.text", "row.source", *ADDRESS), columns=ADDRESS)
    taken = mixed.filter("copies > 0").select("row.*", "copies")
    return rows.join(taken.hint("shuffle_hash"), ADDRESS).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the hash of the text that they decode to."""
    path = public_tokenizers.path(TOKENIZER)
    rows = bpe.decode(bpe.encode(docs, path=path), path=path)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("text", 256).alias("text_sha256"))


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_duplicates), ("near dedup", near_duplicates), ("mixing", mix_sources), ("bpe", tokenise)]

#: SQL has no XXH64, no Newton steps and no BPE; tests/llm compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each result is written, and read again by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
