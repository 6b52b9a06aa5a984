"""From documents to training shards in five stages, each written as Parquet and read by the next.

1. Language: documents without a known language (no text, or no letter) go.
2. Near-duplicates: texts within 14 bits of one another's SimHash whose five-word shingles have a Jaccard similarity of 0.8 or more; the
   smallest id of each group stays.
3. Decontamination: documents that hold 80 % of a benchmark item's five-word shingles go.
4. Mixing: rows are repeated or left out by rates that bring the expected tokens of the label domains to their targets.
5. Sharding: 40 shards of equal row counts, each with all sources in their shares.

The first four return the columns of documents, and rows as they are; the last returns a row for each with its place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import decontaminate, language, mixing, neardup, shards
from pagewright.llm.common import materialise, table
from pagewright.sources.shared import forget, mark


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, language.fit(docs.filter(~language.held_out())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_rates(mixing.mix(docs, table(spark, sf_dir, "labels"), keep_row=True))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shards.shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_to_targets),
    ("sharding", shard),
]

#: SQL can't express the linear models, the 64-bit hashes and the fitted rates; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents of a folder of tables. The stages' results stay in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        since = mark()
        docs = materialise(stage(spark, docs, sf_dir))
        forget(spark, since, keep=docs)  # what the stage wrote on its way
    return docs
