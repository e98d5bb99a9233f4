"""The corpus pipeline: five stages over the documents table, each written as Parquet before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import line_dedup, mixing, ngram_join, pieces, quality
from textloom.llm.common import load, materialize

#: No source is taken more often than this by the mixture, and every kept document is taken at least once.
MAX_REPEATS = 2.0


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier does not reject."""
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter("predicted = 1").select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the lines that ten or more documents share; a document that loses every line stays, empty."""
    done = line_dedup.dedup_lines(docs)
    done = done.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")})
    return done.select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates, that with the smallest doc_id; documents without words all stay."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat the documents of small sources by temperature; each copy is a row."""
    mixed = mixing.mix(docs, entropy_share=None, max_repeats=MAX_REPEATS, budget="cover")
    return mixing.realise(mixed).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids' count and digests for each row."""
    return pieces.encode_documents(docs.select("doc_id", "source", "text")).drop("text")


STAGES = [
    ("quality classifier", classify),
    ("line dedup", drop_common_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode),
]

#: A trained classifier and a tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
