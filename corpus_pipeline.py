"""A corpus pipeline of five stages, each a call of one operator of tidemark.llm.

Rejected documents go (quality rules, near-duplicates, benchmark overlaps), boilerplate
lines go from the texts, and the last stage returns the ids of what is left and their
decoded texts.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontamination, line_spread, near_duplicates, quality
from tidemark.llm.shared import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Spark's bound on an Arrow batch's bytes, and what the stages set it to where the session has none.
ARROW_BOUND, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of some MB: the 10,000 texts of Spark's default are 33 MB of a JVM's buffers (twice that as they grow) and of every Python worker.

    It stays set, as frames are planned when they are written; no result depends on it.
    """
    if spark.conf.get(ARROW_BOUND, None) is None:
        spark.conf.set(ARROW_BOUND, str(ARROW_BYTES))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are close to their language's references.

    Null and empty texts go (they have fewer words than the rules ask for); a null or unknown language uses the
    reference of all others; repeated rows are judged alike; an empty table stays empty.
    """
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without lines that several sites share, but for each line's first occurrence.

    No row goes. Null texts stay null; a null source is one site; a null id comes last; rows alike lose the same lines.
    """
    return line_spread.remove_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8.

    The least id of a group stays, with all its rows; rows without id, and texts without words, always stay.
    """
    bounded_batches(spark)
    return near_duplicates.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no item of the benchmark.

    Null and empty texts overlap nothing; copies are judged alike; an empty benchmark keeps all.
    """
    bounded_batches(spark)
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids of every document, and the text that they decode to; a null text is encoded as the empty one."""
    bounded_batches(spark)
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("tokenise", tokenise),
]

#: BPE has no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, each one's result written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else written(docs), sf_dir)
    return docs
