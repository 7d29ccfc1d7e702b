"""A corpus from `documents`: language, quality, near-duplicates, contamination, pieces. Each stage's rows are the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquarry.llm import language_id
from reelquarry.llm.common import without, written
from reelquarry.llm.decontaminate import decontaminate
from reelquarry.llm.piece_lattice import encode_documents
from reelquarry.llm.quality_rules import quality_rules
from reelquarry.llm.simhash_dedup import one_of_each, text_hash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: those without a letter (null and empty ones too), or far from every centroid, go. Rows are judged by their text, whatever their id."""
    rest = tuple(c for c in COLUMNS if c != "doc_id")
    found = language_id.identify_language(docs, language_id.fit(docs), keep=rest)
    return found.filter("NOT rejected").select(*COLUMNS)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without lines that more than MOST_TEXTS distinct texts of their source have. Null sources are one source."""
    found = quality_rules(docs, keep=("lang", "source")).filter("kept")
    text = F.col("clean_text")
    return found.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates: that with the smallest doc_id, then text hash; of repeated rows any one."""
    return one_of_each(docs).select(*COLUMNS)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth stand in benchmark windows. Rows go by their text, as ids may be null or repeated."""
    rows = docs.withColumn("__hash", text_hash("text"))
    found = decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__hash")
    gone = written(found.filter("contaminated").select(F.col("__hash").alias("key")).distinct(), "contaminated")
    return without(rows, F.col("__hash"), gone).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best pieces of each document, what the next best change, and whether decoding gives the text again. Each row gets one, also of repeated ids."""
    return encode_documents(docs, keep=("lang", "source", "n_chars"))


STAGES = [
    ("language ID", identify),
    ("quality rules", judge_quality),
    ("SimHash near-dedup", deduplicate),
    ("benchmark decontamination", remove_contaminated),
    ("SentencePiece encoding", encode),
]

#: SQL can express neither the language model nor the piece lattice; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k + 1}")
    return docs
