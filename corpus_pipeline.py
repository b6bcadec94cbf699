"""The corpus pipeline: quality classifier, line dedup, SimHash near-dedup, mixing, SentencePiece sampling.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the result is written as Parquet and
read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import linededup, mixing, pieces, quality, simhash
from waymark.llm.common import Scratch, spare, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model scores at its threshold or above; learnt from the corpus's own labels."""
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    score = spare(docs, "quality")
    return quality.scored(docs, model, score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; all documents stay, n_chars follows the text."""
    names = docs.columns
    out = linededup.deduplicated(spark, docs, counts=False)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    return simhash.deduplicated(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(spark, docs)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document."""
    return pieces.sampled(spark, docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("simhash near-dedup", one_of_each),
    ("mixing sources", mix),
    ("sentencepiece", segment),
]

#: Learning, hashing and sampling have no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over documents."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
