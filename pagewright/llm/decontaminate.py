"""Operator 1: benchmark decontamination, in DataFrame functions only.

A test item is inside a document if the document has at least a share t of the item's distinct word shingles. Items are
short and documents are long, so the Jaccard similarity of the two says nothing; what is sketched is containment. Items
are partitioned by their number of shingles. In a partition of at most u shingles an item is represented by its k
smallest shingle hashes (a bottom-k MinHash), k = u - ceil(t u) + 1; a document by all of its shingle hashes up to the
largest hash that any item's sketch holds. If a document lacks fewer than k of the item's shingles, it has one of the k:
so no document with containment t or more is missed, however long it is. Documents that share a sketch hash with an item
are candidates, and each candidate is verified by exact containment of the shingle texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import BROADCAST_ROWS, keep_matching, materialise

SHINGLE = 5
CONTAINMENT = 0.8
#: Over so many tasks one shingle hash is spread where the sketches are too many to broadcast.
SALTS = 32


def words(text: Column) -> Column:
    """The runs of letters and digits of the lower-cased text; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _rolled(tokens: str, make, n: int) -> Column:
    """make(i) for the start i, from 1, of each run of n tokens; of the whole sequence if it is shorter; none without tokens."""
    size = F.size(tokens)
    starts = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).when(size > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, make)


def shingles(tokens: str, n: int = SHINGLE) -> Column:
    """The distinct shingle texts of an array column of words."""
    return F.array_distinct(_rolled(tokens, lambda i: F.array_join(F.slice(tokens, i, n), " "), n))


def shingle_hashes(hashes: str, n: int = SHINGLE) -> Column:
    """A hash of each shingle, in order, from an array column of word hashes. Words past the end count as null."""
    return _rolled(hashes, lambda i: F.xxhash64(*[F.get(hashes, i - 1 + k) for k in range(n)]), n)


def _hashed(rows: DataFrame, n: int) -> DataFrame:
    """`rows` with `tokens` turned into `hash`, one row per shingle of each."""
    kept = [c for c in rows.columns if c != "tokens"]
    rows = rows.select(*kept, F.transform("tokens", lambda w: F.xxhash64(w)).alias("hashes"))
    return rows.select(*kept, F.explode(shingle_hashes("hashes", n)).alias("hash"))


def item_sketches(items: DataFrame, containment: float = CONTAINMENT, n: int = SHINGLE) -> DataFrame:
    """(item_id, hash): the sketch of each row of `items` (item_id, tokens), sized by the item's size partition.

    A partition's upper bound u is the next power of the fourth root of two, so k is at most a fifth over what the item needs.
    """
    rows = items.select("item_id", F.transform("tokens", lambda w: F.xxhash64(w)).alias("hashes"))
    rows = rows.select("item_id", F.array_sort(F.array_distinct(shingle_hashes("hashes", n))).alias("hashes"))
    bound = F.ceil(F.pow(F.lit(2.0), F.ceil(4 * F.log2(F.size("hashes").cast("double"))) / 4))
    k = bound - F.ceil(bound * containment - 1e-9) + 1
    rows = rows.filter(F.size("hashes") > 0).select("item_id", F.slice("hashes", F.lit(1), k.cast("int")).alias("hashes"))
    return rows.select("item_id", F.explode("hashes").alias("hash")).distinct()


def _contained(docs: DataFrame, items: DataFrame, containment: float, n: int, id_col: str, text_col: str, item_id_col: str, item_text_col: str, broadcast_rows: int) -> DataFrame:
    """(doc_id, row_key, item_id, item_shingles, shared, containment): a row is told by its id and by row_key, a hash of its text."""
    item_rows = materialise(
        items.select(F.col(item_id_col).cast("long").alias("item_id"), words(F.col(item_text_col)).alias("tokens")).filter(F.size("tokens") > 0)
    )
    sketches = materialise(item_sketches(item_rows, containment, n))
    n_sketch, top = sketches.agg(F.count("*"), F.max("hash")).first()
    text = F.col(text_col).cast("string")
    doc_rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))
    probes = _hashed(doc_rows.select("doc_id", "row_key", words(F.col("text")).alias("tokens")), n).filter(F.col("hash") <= F.lit(top))
    if n_sketch <= broadcast_rows:
        found = probes.join(F.broadcast(sketches), "hash")
    else:  # a passage that many documents share is spread by salt
        salted = sketches.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = probes.withColumn("salt", F.pmod(F.xxhash64("row_key", "doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"])
    found = materialise(found.select("doc_id", "row_key", "item_id").distinct())
    ids = materialise(found.select(F.col("doc_id").alias("found_id"), F.col("row_key").alias("found_key")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("row_key") == F.col("found_key"))
    suspects = keep_matching(doc_rows, ids, same, "left_semi", broadcast_rows=broadcast_rows).dropDuplicates(["doc_id", "row_key"])
    suspects = suspects.select("doc_id", "row_key", words(F.col("text")).alias("tokens")).select("doc_id", "row_key", shingles("tokens", n).alias("doc_shingles"))
    pieces = item_rows.select("item_id", shingles("tokens", n).alias("item_shingles"))
    pairs = found.select(F.col("doc_id").alias("found_id"), F.col("row_key").alias("found_key"), "item_id").join(pieces, "item_id")
    shared = F.size(F.array_intersect("item_shingles", "doc_shingles"))
    rows = suspects.join(pairs, same).select("doc_id", "row_key", "item_id", F.size("item_shingles").cast("long").alias("item_shingles"), shared.cast("long").alias("shared"))
    return rows.withColumn("containment", F.col("shared") / F.col("item_shingles")).filter(F.col("containment") >= containment - 1e-9)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    containment: float = CONTAINMENT,
    n: int = SHINGLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment): every document and item with at least that containment.

    Words are lower-cased runs of letters and digits. A text of fewer than n words is one shingle, the whole sequence; one
    without words (null, empty, signs only) has none, and takes no part. Rows of the same id are judged each by its own
    text, and the pair is returned once, with the largest figures; so are rows without an id, under the id null. Other
    columns play no part. Either table may be empty. Sketches, and what names the suspects, are broadcast if they are
    counted to be at most `broadcast_rows`; else both sides are shuffled.
    """
    rows = _contained(docs, items, containment, n, id_col, text_col, item_id_col, item_text_col, broadcast_rows)
    best = F.max(F.struct("containment", "shared", "item_shingles")).alias("b")
    return rows.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.item_shingles", "b.shared", "b.containment")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    containment: float = CONTAINMENT,
    n: int = SHINGLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The rows of `docs`, whole and as they are, whose own text holds no item: a clean row stays, whichever id it has or shares."""
    rows = _contained(docs, items, containment, n, id_col, text_col, item_id_col, item_text_col, broadcast_rows)
    bad = materialise(rows.select(F.col("doc_id").alias("bad_id"), F.col("row_key").alias("bad_key")).distinct())
    same = F.col(id_col).cast("long").eqNullSafe(F.col("bad_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("bad_key"))
    return keep_matching(docs, bad, same, "left_anti", broadcast_rows=broadcast_rows)
