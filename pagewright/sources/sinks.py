"""Writers, and the tables that they write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.geometry import corner, truncated
from pagewright.functions.html import full_document


def to_records(pages: DataFrame, coords: bool = True, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """(keys, record): one JSON object per page row with `blocks` and `text`; scores have four decimals, and errors are records too.

    Pages may have `code` and `msg` columns; a page whose code isn't 0 becomes an error record.
    """
    code = F.col("code") if "code" in pages.columns else F.lit(0)
    msg = F.col("msg") if "msg" in pages.columns else F.lit("")
    blocks = F.transform(
        "blocks",
        lambda b: F.struct(b["text"].alias("text"), F.round(b["score"], 4).alias("score"), b["box"].alias("box"), b["angle"].alias("angle"), F.round(b["angle_score"], 4).alias("angleScore"), b["end"].alias("end")),
    )
    good = [F.lit(0).alias("code"), F.col("text"), F.size("blocks").alias("blockCount")]
    record = F.to_json(F.struct(*keys, *good, *([blocks.alias("blocks")] if coords else [])))
    return pages.select(*keys, F.when(code == 0, record).otherwise(error_record(code, msg, *keys)).alias("record"))


def error_record(code: Column, msg: Column, *keys: str) -> Column:
    return F.to_json(F.struct(*keys, code.alias("code"), msg.alias("msg")))


def error_records(results: DataFrame, *keys: str) -> DataFrame:
    """(keys, record) of the results whose code isn't 0; a bad page never stops the others."""
    return results.filter("code <> 0").select(*keys, error_record(F.col("code"), F.col("msg"), *keys).alias("record"))


def write_records(records: DataFrame, path: str) -> None:
    records.select(F.col("record").alias("value")).write.mode("append").text(path)


def table_documents(tables: DataFrame, html: str = "html") -> DataFrame:
    """The tables with `html` as whole documents."""
    return tables.withColumn(html, full_document(F.col(html)))


def write_table_html(tables: DataFrame, path: str, html: str = "html") -> None:
    table_documents(tables, html).select(F.col(html).alias("value")).write.option("lineSep", "\n\f\n").mode("append").text(path)


def write_grid(grid: DataFrame, path: str, keys: tuple[str, ...] = ("page_id",), buckets: int = 64) -> None:
    """Grids as Parquet, in folders by a hash of the keys: row, column, text, and the anchor of merged ranges."""
    grid.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).write.partitionBy("bucket").mode("append").parquet(path)


def write_history(results: DataFrame, path: str, stamp: str = "dt") -> None:
    """Results of one run, appended under its date."""
    results.write.partitionBy(stamp).mode("append").parquet(path)


def text_layer(blocks: DataFrame, page_height: Column, dpi: int = 72, crop: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Where each block's text goes on a page in points: doc_id, page, block_id, font_pt, x, y. Empty texts have no place.

    The font is the mean of the left and right heights, 6 pixels at least; y counts from the bottom. `crop` is the cut-out
    (x0, y0, y1) in points.
    """
    (_, y0), (_, y1), (_, y2), (_, y3) = (corner(F.col("box"), i) for i in range(4))
    x0 = corner(F.col("box"), 0)[0]
    px = F.greatest(truncated((F.abs(y3 - y0) + F.abs(y2 - y1)) / 2), F.lit(6))
    scale = 72.0 / dpi
    return blocks.filter(F.coalesce(F.col("text"), F.lit("")) != "").select(
        "doc_id",
        "page",
        "block_id",
        F.greatest(px * scale, F.lit(2.0)).alias("font_pt"),
        (x0 * scale + crop[0]).alias("x"),
        ((page_height - crop[2]) + (y0 + px) * scale).alias("y"),
    )
