"""The corpus pipeline: documents without toxic ones, near copies and repeated passages, mixed to target weights and encoded.

Every stage takes a table with the columns of documents, whatever others it has and whatever they are called, and all but the last return
them all. What a stage does with nulls, empty and very long texts, ties, repeated rows and empty tables is said at each.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symgraph.llm import mixing, ngram_join, pieces, suffix_dedup, toxicity
from symgraph.llm.tables import read, shared_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. The model is trained on the labelled ones among all documents.

    Rows with a null or empty text stay; repeated rows are judged alike; texts are judged whole, however long; without labels of both kinds, and from an empty table, nothing goes.
    """
    return toxicity.without_toxic(docs, toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the lowest id.

    Rows with a null id or text, and texts without words, stay; rows that repeat an id stay or go together; long texts count whole; an empty table stays empty.
    """
    return ngram_join.keep_first(docs)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of passages that repeat, the first stays, by document id and place.

    Rows with a null id or text and empty texts stay as they are; rows that repeat an id and its text are cut alike, others of an id by their own spans; a document
    of which nothing is left goes; long texts count whole; an empty table stays empty.
    """
    return suffix_dedup.without_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of the documents' tokens, in their sources' target shares.

    Rows with a null id or text, and texts without words, have no tokens; a null source is the source ''; repeated rows are tokens each time; a long text fills many blocks; an
    empty table gives no blocks. A block has the id of its first document.
    """
    return mixing.as_documents(mixing.mixed_blocks(docs), docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each block, whole however long; rows with a null id or text have none, an empty text has no pieces, repeated rows are encoded each, an empty table gives no rows."""
    return pieces.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_copies_stage),
    ("suffix_array_dedup", passages_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again by the next."""

    def step(docs: DataFrame, stage: tuple[str, Stage]) -> DataFrame:
        return shared_table(stage[1](spark, docs, sf_dir), f"pipeline-{stage[0]}")

    last = STAGES[-1]
    return last[1](spark, functools.reduce(step, STAGES[:-1], read(spark, sf_dir, "documents")), sf_dir)
