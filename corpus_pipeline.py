"""The corpus pipeline: five operators of quillstone.llm over the documents table.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns a DataFrame; all but the last return the columns of documents.

Edge cases: documents with a null or empty text, or without a letter, go at the first
stage; null ids link with nothing and stay, and so does a null lang or source; rows
that repeat id and text go through alike, as one document that is there several
times; columns beside those of documents, whatever their names, are left out; with an
empty documents table every stage gives an empty result, and with an empty benchmark
nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from quillstone.llm._shared import Stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is recognised (no letter, no text) go."""
    model = language_id.fit_model(docs)
    return language_id.with_language(docs, model).filter(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of three lines go; a document of which no word is left goes with them."""
    out = line_dedup.line_dedup(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\s]")
    return out.filter(left).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return near_dedup.drop_copies(docs, percent=80).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.scan(docs, items, keep_text=True).filter(~F.col("contaminated")).select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in batches of equal padded length."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontaminate", drop_contaminated),
    ("packing", pack_documents),
]

#: Learnt piece probabilities and a tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet and read again by the next, after which it is deleted."""
    table, docs = Stage(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, f"stage-{name}")
            table.done(docs)
    return docs
