"""The corpus pipeline: toxicity, exact and near copies, mixing, SentencePiece pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet to the shared work folder and reads again as the next one's
documents.  All but the last return the columns of ``documents``.

* toxicity: documents at or over the threshold of their language go; the
  classifier learns from the labelled documents of the input table, whatever
  the stage is given.
* exact_dedup: of equal texts the least doc_id stays.
* near_dedup: of each class of near copies (five-word shingles, Jaccard 0.8)
  the least doc_id stays.
* mixing: documents are repeated so that the expected token shares by quality
  come to ``TARGETS``; each document stays at least once (rate floor 1), so no
  clean document is lost to the mixture.
* pieces: adds piece_ids and n_pieces.

Null texts count as empty in each stage and stay null in the output; an empty
table gives an empty result at each stage; columns beyond those of
``documents`` are carried along up to the mixture, and come out at the end
unless they have the name of a new one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from harrow.llm.common import read_table, to_scratch
from harrow.llm.exact_copies import drop_exact_copies
from harrow.llm.near_copies import drop_near_copies
from harrow.llm.piece_codec import encode_documents
from harrow.llm.soft_mixing import mix
from harrow.llm.toxicity import drop_toxic

#: Wanted token shares by quality label.
TARGETS = {"1": 0.88, "0": 0.12}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"), train_docs=read_table(spark, sf_dir, "documents"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, read_table(spark, sf_dir, "labels"), TARGETS, floor=1.0, budget=None)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("pieces", pieces),
]

#: A trained classifier and a subword encoder cannot be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = to_scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
