"""A corpus pipeline: toxicity, line dedup, near-dedup, decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it kept, and returns a DataFrame that is written as Parquet and read back as the next one's docs.

Defined cases, alike in all stages: a null text counts as empty (and stays null where texts pass), texts of any length are handled whole, rows with a null or repeated doc_id are rows like others (near-dedup keeps one row of each class, whatever its doc_id), an empty table gives an empty table, and columns of docs pass through all stages but the last, except that one named as a result of a stage's operator has that result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, line_dedup, near_dedup, toxicity
from tallyforge.llm.common import stage, table
from tallyforge.llm.pieces import encode_documents
from tallyforge.llm.queries import public_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold of their language (0.5 where a language has none, or is null)."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).where("NOT toxic_rejected").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the long lines that many of them share; n_chars follows the text."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the least doc_id."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's contamination rule leaves alone; spans below the rule stay."""
    found = decontaminate.judged(decontaminate.find_windows(docs, table(spark, sf_dir, "benchmark")))
    return found.where("NOT contaminated").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the piece ids of each kept document, and a digest of the text that they decode to."""
    coded = encode_documents(docs.select("doc_id", "text"), public_path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("piece_ids").cast("long").alias("n_tokens"), "piece_ids", F.sha2("piece_text", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", encode),
]

#: A trained classifier and a tokenizer are beyond SQL; tests compare the stages with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
