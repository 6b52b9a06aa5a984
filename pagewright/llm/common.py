"""What several operators of this subpackage share: intermediate tables, size-checked joins, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.sources.shared import shared_folder as shared_folder
from pagewright.sources.shared import shared_table as materialise

#: A side of at most so many narrow rows (a few numbers or a hash each) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_matching(rows: DataFrame, keys: DataFrame, on: Column, how: str, n_keys: int | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """left_semi or left_anti join of wide `rows` with narrow, materialised `keys`.

    The keys are broadcast if they are counted to be at most `broadcast_rows`; else both sides are shuffled, and the wide side isn't sorted.
    """
    n = keys.count() if n_keys is None else n_keys
    return rows.join(F.broadcast(keys) if n <= broadcast_rows else keys.hint("shuffle_hash"), on, how)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: (a, b) of any orderable type -> (node, component), the component being its smallest node.

    Alternates the large-star and small-star steps until the edges stand still. Each step is an aggregate with map-side
    minima and a join that AQE can split at a hot node; no node's neighbours are gathered in a task. The number of rounds
    grows with the logarithm of the longest chain. Loops and nulls are ignored; nodes without edges aren't returned.
    """
    now = materialise(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    while seen is not None or not now.isEmpty():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
