"""Readers: files, page records, exploded blocks, chosen pages, query parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.params import page_numbers

#: The file name endings that are taken, in either case.
EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "gif", "tif", "tiff", "webp", "pdf")

BLOCK = T.StructType(
    [
        T.StructField("block_id", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("box", T.ArrayType(T.IntegerType())),
        T.StructField("angle", T.IntegerType()),
        T.StructField("angle_score", T.DoubleType()),
        T.StructField("end", T.StringType()),
    ]
)
#: A page record: one JSON object per line. A line that can't be read has everything null but _corrupt_record.
PAGE_RECORD = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("file", T.StringType()),
        T.StructField("code", T.IntegerType()),
        T.StructField("msg", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("blockCount", T.IntegerType()),
        T.StructField("blocks", T.ArrayType(BLOCK)),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def scan_files(spark: SparkSession, *paths: str, kinds: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, length, kind) of the files of these kinds (images and PDF) under the paths; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path", "length")
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    return files.withColumn("kind", kind).filter(F.col("kind").isin(*kinds))


def read_page_records(spark: SparkSession, *paths: str) -> DataFrame:
    """Page records as written by `to_records`; unreadable lines keep their text in _corrupt_record."""
    return spark.read.schema(PAGE_RECORD).option("columnNameOfCorruptRecord", "_corrupt_record").json(list(paths))


def explode_blocks(pages: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """One row per block: the keys, seq (its place from 0), and the block's fields. Pages without blocks give no row."""
    return pages.select(*keys, F.posexplode("blocks").alias("seq", "b")).select(*keys, "seq", "b.*")


def collect_pages(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id", "page"), order: str = "block_id") -> DataFrame:
    """One row per page with `blocks`, ordered by the column `order`. A page's blocks are one value, so they meet in one task."""
    fields = [F.col(f.name) for f in BLOCK]
    row = F.struct(F.col(order).alias("_order"), F.struct(*fields).alias("b"))
    return blocks.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["b"]).alias("blocks"))


def select_pages(docs: DataFrame, spec: str = "spec", count: str = "page_count", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, page) of the pages, from 0, that each document's written choice selects."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(page_numbers(F.col(spec), F.col(count))).alias("page"))


def query_params(url: Column) -> Column:
    """A map of a URL's query: a key without `=` has an empty value; of a repeated key the last value counts."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.when(F.contains(p, F.lit("=")), F.regexp_extract(p, "(?s)=(.*)$", 1)).otherwise("").alias("value")))
    n = F.size(entries)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, n), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def read_query_params(df: DataFrame, url_col: str = "url", out: str = "params") -> DataFrame:
    return df.withColumn(out, query_params(F.col(url_col)))
