"""A training corpus from raw documents: quality, line dedup, near duplicates, decontamination, tokens.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and
returns the DataFrame that is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.  ``run``
applies them to the whole table.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factspark.llm import bpe, decontaminate, lines, minhash, quality
from factspark.llm.common import collecting, drop, shared_dir, table
from factspark.llm.queries import held_out, vocabulary_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_mine = threading.local()
#: Percent of shared shingles from which the pipeline calls documents near duplicates; op8 has its own.
NEAR_PERCENT = 80


def _stage(f: Stage) -> Stage:
    """f, which first deletes what the stage before it in this thread put in the shared folder: that stage's result has been written."""

    @wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, getattr(_mine, "paths", []))
        with collecting() as _mine.paths:
            return f(spark, docs, sf_dir)

    return call


def _recount(docs: DataFrame) -> DataFrame:
    """n_chars says what the text now has."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranker, fitted on the labelled ones, scores at its threshold or above.

    Null and empty texts have scores like others; rows that share a doc_id are
    scored each; without labels of both kinds all stay.  All columns are kept.
    """
    labels = table(spark, sf_dir, "labels").filter(~held_out())
    return quality.keep_quality(docs, quality.fit_ranker(docs, labels))


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that occur earlier, but for small edits; documents of such lines only go.

    Null and empty texts stay as they are; rows with a null doc_id keep their
    lines; rows that share a doc_id are told apart by their texts.  n_chars, where
    there is one, becomes the new text's, 0 for null.
    """
    return _recount(lines.dedup_lines(docs))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near duplicates.

    Texts without words, null ones among them, are near nothing and stay; rows
    that share the smallest doc_id of a group all stay.
    """
    return minhash.keep_first(docs, percent=NEAR_PERCENT)


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no window of a benchmark item occurs in; those without words stay, as all do without items."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text that they decode to; a null text counts as empty."""
    return bpe.bpe_encode(docs, vocabulary_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", to_tokens),
]

#: Sketches, a fitted ranker and a merge table are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before: str | None = None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop(spark, [before])
        before = path
    return docs
