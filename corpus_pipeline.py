"""From raw documents to token ids: the stages of a training-data pipeline, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import bpe, decontamination, neardup, quality, suffixes
from tapewright.llm.common import table, without
from tapewright.session import run_dir

REJECT = 0.3  # documents that are less likely good than this go
SIMILAR = 80  # percent of common shingles from which documents are near-duplicates


#: Columns that the operators add to documents.
ADDED = ("score", "predicted", "digest", "spans", "removed", "kept")


def beside(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` of the documents with the documents' columns: those of a name in ``ADDED`` step aside meanwhile."""
    mark = "_" * (1 + max(map(len, docs.columns)))  # longer than any name, so that no two become one
    away = {c: mark + c for c in docs.columns if c.lower() in ADDED}
    return work(docs.withColumnsRenamed(away)).select(*[F.col(away.get(c, c)).alias(c) for c in docs.columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the co-trained classifiers call bad; without labels of both classes nothing goes.

    A null text is judged like an empty one, a null id like any; rows that repeat a document share its fate. An empty
    table stays empty. Any column keeps its values, also one named like the classifiers' score.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return beside(docs, lambda own: quality.score(own, model).filter(F.col("score") >= REJECT))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group. Rows without an id stay, as do rows that repeat an id.

    Null and empty texts are near to nothing and stay; texts of fewer than five words are compared whole. An empty
    table stays empty; other columns take no part.
    """
    groups = neardup.near_duplicates(docs, SIMILAR)
    return without(docs, groups.filter(F.col("doc_id") != F.col("component_id")))


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of long passages out of the texts, at whole characters; no document goes.

    The document of the smallest id keeps a passage; rows of one id, or without one, take nothing from each other. A null
    text becomes an empty one. ``n_chars`` is counted anew, all other columns keep their values.
    """

    def cut(own: DataFrame) -> DataFrame:
        kept = suffixes.without_repeats(own, whole_chars=True).withColumn("text", F.decode("kept", "UTF-8"))
        return kept.withColumn("n_chars", F.length("text").cast(own.schema["n_chars"].dataType))

    return beside(docs, cut)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark question, or one with other numbers or names, go.

    Rows without an id stay, as do null and empty texts; all rows of an id go if one of them holds a question. With an
    empty benchmark nothing goes; other columns take no part.
    """
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each text's token ids and of their text: a row for each row, a null text counts as empty."""
    return bpe.encoded_digests(docs, bpe.vocabulary_path())


STAGES = [
    ("good_quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("long_repeats", long_repeats),
    ("benchmark_leaks", benchmark_leaks),
    ("token_ids", token_ids),
]

#: Classifiers, sketches and the tokenizer cannot be put in SQL: tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole ``documents`` table."""
    folder = run_dir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
