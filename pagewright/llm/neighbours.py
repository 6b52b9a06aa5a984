"""Operator 6: approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample; every vector is put in a leaf of each tree. A query walks all trees through
one priority queue, nearest splitting planes first, until the leaves it has opened hold enough vectors. Queries and
vectors meet by an equi join on the leaf: each leaf ranks its own vectors for the queries that have opened it by their
exact distance, and the best of a query's leaves are its neighbours.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import materialise

TREES = 4
#: Vectors in a leaf, about, from which the depth follows; a leaf that holds more is ranked in parts of so many.
LEAF = 512
#: Queries that are ranked together in a leaf, about.
LEAF_QUERIES = 4096
#: Vectors that the trees are fitted on, at most about: 5 MB of 64 floats each on the driver. A leaf has at least 16 of them.
SAMPLE = 20_000
#: A query opens leaves until they hold this share of all vectors, counting a vector once for each tree; k + 1 at least.
SEARCH_SHARE = 1.4


@dataclass(frozen=True)
class Forest:
    """planes (trees, nodes, dims) and offsets (trees, nodes) of complete binary trees: the children of node i are 2i+1, 2i+2."""

    planes: np.ndarray
    offsets: np.ndarray
    depth: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x in each tree: (rows, trees), from 0."""
        out = np.zeros((len(x), len(self.planes)), np.int16)
        rows = np.arange(len(x))
        for t in range(len(self.planes)):
            right = x @ self.planes[t].T >= self.offsets[t]
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + right[rows, node]
            out[:, t] = node - (2**self.depth - 1)
        return out

    def search(self, q: np.ndarray, sizes: np.ndarray, wanted: float) -> np.ndarray:
        """Which leaves (trees, leaves) a query opens until `sizes` of them sum up to `wanted`.

        One queue over all trees, ordered by the squared distances to the planes that were crossed on the way.
        """
        opened = np.zeros(sizes.shape, bool)
        margins = np.einsum("tnd,d->tn", self.planes, q) - self.offsets
        queue = [(0.0, t, 0) for t in range(len(self.planes))]
        inner, got = 2**self.depth - 1, 0.0
        while queue and got < wanted:
            crossed, t, node = heapq.heappop(queue)
            while node < inner:
                margin = margins[t, node]
                near, far = (2 * node + 2, 2 * node + 1) if margin >= 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (crossed + margin * margin, t, far))
                node = near
            opened[t, node - inner] = True
            got += sizes[t, node - inner]
        return opened


def build_forest(sample: np.ndarray, trees: int = TREES, depth: int = 7, seed: int = 42) -> Forest:
    """Trees that halve the sample at the median along the line between two random vectors of each node."""
    rng, dims = np.random.default_rng(seed), sample.shape[1] if sample.ndim == 2 else 0
    planes, offsets = np.zeros((trees, 2**depth - 1, dims)), np.zeros((trees, 2**depth - 1))
    for t in range(trees):
        members = {0: np.arange(len(sample))}
        for node in range(2**depth - 1):
            own = members.pop(node)
            if len(own) >= 2:
                a, b = sample[rng.choice(own, 2, replace=False)]
                planes[t, node] = (a - b) / (np.linalg.norm(a - b) or 1.0)
                along = sample[own] @ planes[t, node]
                offsets[t, node] = np.median(along)
                right = along >= offsets[t, node]
                members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
            else:
                members[2 * node + 1], members[2 * node + 2] = own, own[:0]
    return Forest(planes, offsets, depth)


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unpacked(column: pa.ChunkedArray, kind: str, dims: int) -> np.ndarray:
    """The rows of a column of packed vectors, in double precision."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims).astype(np.float64)


def ranked(vectors: pa.Table, asking: pa.Table, k: int, kind: str, dims: int) -> pa.Table:
    """(query_id, gid, score) of the k nearest vectors of one leaf to each query that has opened it, but those with its id only.

    Ties go to the smaller of the ids that aren't the query's.
    """
    out: list[pa.Table] = [pa.table({"query_id": pa.array([], pa.int64()), "gid": pa.array([], pa.string()), "score": pa.array([], pa.float64())})]
    if not len(vectors) or not len(asking):
        return out[0]
    x, gids = _unpacked(vectors.column("v"), kind, dims), vectors.column("gid")
    least, second = vectors.column("vid").to_numpy(), vectors.column("second").to_numpy()
    last = np.iinfo(np.int64).max  # stands for no second id
    for qid, v in zip(asking.column("query_id").to_pylist(), asking.column("v").to_pylist(), strict=True):
        score = np.sqrt(((x - np.frombuffer(v, kind).astype(np.float64)) ** 2).sum(axis=1))
        named = np.where(least == qid, second, least)
        own = np.flatnonzero(named != last)
        if len(own) > k:
            own = own[score[own] <= np.partition(score[own], k - 1)[k - 1]]
        first = own[np.lexsort((named[own], score[own]))[:k]]
        out.append(pa.table({"query_id": pa.array(np.full(len(first), qid)), "gid": gids.take(pa.array(first)), "score": pa.array(score[first])}))
    return pa.concat_tables([t.combine_chunks() for t in out])


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, and a vector that isn't null, empty or zero, with finite components only."""
    v = F.col(vec_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and size(v) > 0")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return rows.filter(finite & F.exists("v", lambda c: c != 0))


def nearest(
    rows: DataFrame,
    k: int = 10,
    every: int = 100,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    trees: int = TREES,
    leaf: int = LEAF,
    search_share: float = SEARCH_SHARE,
    sample: int = SAMPLE,
    leaf_queries: int = LEAF_QUERIES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, by Euclidean distance, ties to smaller ids.

    Queries are the rows whose id is divisible by `every`; candidates are all rows of another id. Rows with a null id, or a
    vector that is null, empty, zero, or holds null or non-finite components, take no part, nor do vectors of another
    length than most have (of equally many, the longer). Equal vectors are searched once: of their ids the k + 1
    smallest are kept, as no query can return more. Fewer candidates than k, none, or an empty table give fewer rows or none.
    An id that repeats stands for one row per distinct vector: as a candidate each counts, as a query a candidate's distance is
    that to the nearest of them, and there are k rows all the same. What a query costs grows with the leaves it opens.
    """
    spark = rows.sparkSession
    kind = "<f4" if rows.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    valid = usable(rows, id_col, vec_col)
    lengths = valid.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    dims = lengths.n
    gid = F.concat(F.hex(F.xxhash64("v")), F.lit("."), F.hex(F.xxhash64(F.lit(1), "v")))  # 128 bits stand for a vector
    valid = materialise(valid.filter(F.size("v") == dims).withColumn("gid", gid))
    named = valid.select("gid", "vec_id").distinct()
    at = F.row_number().over(Window.partitionBy("gid").orderBy("vec_id"))
    ids = named.withColumn("at", at).filter(F.col("at") <= k + 1).groupBy("gid").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = materialise(ids.join(valid.select("gid", "v").dropDuplicates(["gid"]), "gid"))
    n = distinct.count()
    taken = distinct.filter(F.pmod(F.xxhash64("gid"), F.lit(1_000_000)) < min(1.0, sample / n) * 1_000_000)
    got = np.array(sorted(r.v for r in taken.select("v").collect()), np.float64).reshape(-1, dims)
    depth = max(0, math.ceil(math.log2(max(1.0, min(n / leaf, len(got) / 16)))))
    forest = spark.sparkContext.broadcast(build_forest(got, trees, depth))
    cells = trees << depth

    def leaves_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(1))
                own = (forest.value.leaves(x).astype(np.int32) + (np.arange(trees) << depth).astype(np.int32)).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(own) + 1, trees, dtype=np.int32)), pa.array(own, pa.int32()))
                packed = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), packed, batch.column(2), batch.column(3), lists], ["gid", "v", "vid", "second", "cells"])

    last = F.lit(np.iinfo(np.int64).max)
    placed = distinct.select("gid", "v", F.col("ids")[0].alias("vid"), F.coalesce(F.get("ids", F.lit(1)), last).alias("second"))
    placed = materialise(placed.mapInArrow(leaves_of, "gid string, v binary, vid long, second long, cells array<int>"))
    in_cell = placed.select("gid", "v", "vid", "second", F.explode("cells").alias("cell"))
    sizes = np.zeros(cells, np.int64)
    for r in in_cell.groupBy("cell").count().collect():  # trees * 2**depth numbers at most
        sizes[r["cell"]] = r["count"]
    # Counted once for each tree, k + 1 vectors are sure to be among (k + 1) * trees.
    wanted, shared = max(search_share * n, (k + 1) * trees), spark.sparkContext.broadcast(sizes.reshape(trees, -1))

    def opened_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(1))
                found = [np.flatnonzero(forest.value.search(q, shared.value, wanted)).astype(np.int32) for q in x]
                packed = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.array(found, pa.list_(pa.int32()))], ["query_id", "v", "cells"])

    asked = valid.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "gid"]).select(F.col("vec_id").alias("query_id"), "v")
    queries = materialise(asked.mapInArrow(opened_by, "query_id long, v binary, cells array<int>"))
    asking = queries.select("query_id", "v", F.explode("cells").alias("cell"))
    openers = {r["cell"]: r["count"] for r in asking.groupBy("cell").count().collect()}
    plan = [(c, math.ceil(sizes[c] / (2 * leaf)), math.ceil(m / leaf_queries)) for c, m in openers.items() if sizes[c]]
    plan = F.broadcast(spark.createDataFrame(plan, "cell int, parts int, query_parts int"))  # a row for each leaf at most

    def spread(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    left = in_cell.join(plan, "cell").withColumn("part", F.pmod(F.xxhash64("gid"), "parts").cast("int")).withColumn("query_part", spread("query_parts"))
    right = asking.join(plan, "cell").withColumn("query_part", F.pmod(F.xxhash64("query_id"), "query_parts").cast("int")).withColumn("part", spread("parts"))
    keys = ["cell", "part", "query_part"]
    left, right = left.select(*keys, "gid", "v", "vid", "second"), right.select(*keys, "query_id", "v")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: ranked(a, b, k, kind, dims), "query_id long, gid string, score double")
    # The k nearest vectors of a query give at least k rows of other ids, so no more vectors matter, but for ties.
    found = found.groupBy("query_id", "gid").agg(F.min("score").alias("score")).join(distinct.select("gid", "ids"), "gid")
    each = found.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
