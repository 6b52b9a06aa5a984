"""Operator 7: shards by proportional stratified interleaving, in DataFrame functions only.

Within each source the rows are shuffled by a seeded hash and ranked; the rank as a fraction of the source's rows is the
row's place in the whole (with a phase of the source's own). Sorted by that fraction, every stretch of rows holds the sources in their shares, so cutting
the order into stretches gives shards that match the mixture and whose row counts differ by one at most.

Ranks and places are taken without sorting any source, or the whole, in one task: rows are put in buckets that follow
the order, the buckets are counted, and a row's rank is its rank in the bucket plus the rows of the buckets before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import materialise

#: Buckets of a source and of the whole order: 16**BUCKET_DIGITS. At 10 billion rows a bucket of the order holds 150,000.
BUCKET_DIGITS = 4


def _placed(rows: DataFrame, keys: list[str], order: list, place: str) -> DataFrame:
    """`rows` with `place`: the place from 0 in `order` within keys[:-1], where keys[-1] is a bucket that follows the order."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    # The rows before a bucket: those in earlier stretches of buckets, and those in earlier buckets of its stretch. There
    # are 256 stretches, each of at most 16**BUCKET_DIGITS / 256 buckets, so no window is larger than that.
    *outer, bucket = keys
    number = F.conv(bucket, 16, 10).cast("long") if rows.schema[bucket].dataType.simpleString() == "string" else F.col(bucket)
    counts = counts.withColumn("_stretch", F.floor(number / (16**BUCKET_DIGITS // 256)))
    inside = F.sum("_n").over(Window.partitionBy(*outer, "_stretch").orderBy(bucket)) - F.col("_n")
    stretches = counts.groupBy(*outer, "_stretch").agg(F.sum("_n").alias("_m"))
    earlier = F.sum("_m").over(Window.partitionBy(*outer).orderBy("_stretch")) - F.col("_m")
    stretches = stretches.select(*outer, "_stretch", earlier.alias("_earlier"))
    counts = counts.withColumn("_inside", inside).join(stretches, [*outer, "_stretch"])
    counts = counts.select(*keys, (F.col("_inside") + F.col("_earlier")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    joined = rows.withColumn(place, within).join(counts, keys)
    return joined.withColumn(place, F.col(place) + F.col("_before")).drop("_before")


def shard(
    docs: DataFrame,
    shards: int = 40,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), source.

    The law is `rows`: the shards' row counts are at most one apart. Size is the text's UTF-8 bytes (null: none) plus 16.
    Rows without a source form one source of their own; an id may be null or repeated: equal rows have places next to one
    another, and it doesn't matter which has which. With no rows there are no shards. Texts are read once and not shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    rows = materialise(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
            (F.octet_length(text).cast("long") + 16).alias("size"),
            F.crc32(text).alias("text_crc32"),
            key.alias("key"),
        )
    )
    order = [F.col(c) for c in ("key", "doc_id", "text_crc32", "size")]
    of_source = rows.groupBy("source").agg(F.count("*").alias("source_rows"))
    total = int(of_source.agg(F.sum("source_rows")).first()[0] or 0)
    ranked = _placed(rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)), ["source", "bucket"], order, "rank")
    ranked = ranked.join(of_source, "source").drop("bucket")
    # Each source has its own phase, or sources of like size would meet at the same shares.
    phase = F.conv(F.substring(F.md5("source"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    share = (F.col("rank") + phase) / F.col("source_rows")
    ranked = ranked.withColumn("share", share).withColumn("part", F.floor(F.col("share") * 16**BUCKET_DIGITS))
    placed = _placed(ranked, ["part"], [F.col("share"), F.col("source"), *order], "at")
    placed = placed.withColumn("shard", F.expr(f"(at * {shards}L) div {max(total, 1)}L"))
    start = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("at") - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )
