"""Aggregates: texts in order, page statistics, unions of intervals, clusters of cells, shares of a table's extent."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.geometry import block_angle
from pagewright.functions.params import char_length_choice
from pagewright.operators.filters import PAGE
from pagewright.operators.pages import by_group
from pagewright.operators.windows import band_by_gap


def ordered_concat(order: str, text: Column, sep: str = "") -> Column:
    """The texts of a group joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("s")))), lambda x: x["s"]), sep)


def assemble_text(blocks: DataFrame, keys: tuple[str, ...] = PAGE, order: str = "seq") -> DataFrame:
    """(keys, text, block_count): every block's text and end, in reading order."""
    return blocks.groupBy(*keys).agg(ordered_concat(order, F.concat("text", "end")).alias("text"), F.count("*").alias("block_count"))


def assemble_document(pages: DataFrame, rule: str = "\n--- %d ---\n") -> DataFrame:
    """(doc_id, text): the page texts in order; with more than one page each is followed by a rule with its number from 1."""
    many = F.count("*").over(Window.partitionBy("doc_id")) > 1
    number = F.format_string(rule, F.col("page") + 1)
    rows = pages.select("doc_id", "page", F.concat("text", F.when(many, number).otherwise("")).alias("text"))
    return rows.groupBy("doc_id").agg(ordered_concat("page", F.col("text")).alias("text"))


def page_rotation(blocks: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """(keys, rotation): the median of the blocks' angles."""
    return blocks.groupBy(*keys).agg(F.median(block_angle(F.col("box"))).alias("rotation"))


def mode_smallest(rows: DataFrame, value: Column, keys: tuple[str, ...], out: str = "mode") -> DataFrame:
    """(keys, mode): the most frequent value, the smallest of equally frequent ones."""
    counts = rows.groupBy(*keys, value.alias("_v")).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.max_by("_v", F.struct(F.col("_n"), -F.col("_v"))).alias(out))


def mode_width(components: DataFrame, key: str = "page_id") -> DataFrame:
    return mode_smallest(components, F.col("r") - F.col("l"), (key,), "mode_width")


def mode_row_separation(separations: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, line_sep): the most frequent separation in bins of two, named by their middle."""
    return mode_smallest(separations, 2 * F.floor(F.col("sep") / 2) + 1, (key,), "line_sep")


def page_char_length(components: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, char_length): the mode of the widths, or their mean if that is much larger."""
    mean = components.groupBy(key).agg(F.avg(F.col("r") - F.col("l")).alias("_mean"))
    joined = mode_width(components, key).join(mean.hint("merge"), key)
    return joined.select(key, char_length_choice(F.col("mode_width").cast("double"), F.col("_mean")).alias("char_length"))


def font_stats(blocks: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """(keys, font_height, char_width) of blocks (l, t, r, b, text): means of height and of width by byte of text."""
    h, w, n = F.col("b") - F.col("t"), F.col("r") - F.col("l"), F.octet_length("text")
    return blocks.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(h > 0, h)), F.lit(0.15)).alias("font_height"),
        F.coalesce(F.avg(F.when((w > 0) & (n > 0), w / n)), F.lit(0.1)).alias("char_width"),
    )


def table_bbox(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, x1, y1, x2, y2, unique_cells)."""
    return cells.groupBy(*keys).agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.countDistinct("x1", "y1", "x2", "y2").alias("unique_cells")
    )


def interval_union_length(rows: DataFrame, start: str, end: str, keys: tuple[str, ...], out: str = "union_length") -> DataFrame:
    """(keys, union_length): the length that intervals cover together."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    rows = rows.withColumn("_reach", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_opens", F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy(*keys, "_island").agg((F.max(end) - F.min(start)).alias("_len"))
    return islands.groupBy(*keys).agg(F.sum("_len").alias(out))


def dotted_line_areas(components: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, orient, l, t, r, b): rectangles of dotted lines, both directions.

    Thin parts (2 to 1 at least, 5 thick at most) form a line when their middles are within 2 of the one before, there are
    five, and together they cover 0.66 of the line.
    """
    out = []
    for orient, (lo, hi, cross_lo, cross_hi) in {"h": ("l", "r", "t", "b"), "v": ("t", "b", "l", "r")}.items():
        long, thick = F.col(hi) - F.col(lo), F.col(cross_hi) - F.col(cross_lo)
        thin = components.filter((thick > 0) & (long / thick >= 2.0) & (thick <= 5)).withColumn("_mid", (F.col(cross_lo) + F.col(cross_hi)) / 2)
        banded = band_by_gap(thin, "_mid", 2.0, (key,), ("l", "t", "r", "b"))
        covered = interval_union_length(banded, lo, hi, (key, "band"))
        areas = banded.groupBy(key, "band").agg(F.count("*").alias("_n"), *[(F.min if c in "lt" else F.max)(c).alias(c) for c in "ltrb"])
        span = F.greatest(F.col(hi) - F.col(lo), F.lit(1))
        kept = areas.join(covered.hint("merge"), [key, "band"]).filter((F.col("_n") >= 5) & (F.col("union_length") / span >= 0.66))
        out.append(kept.select(key, F.lit(orient).alias("orient"), *"ltrb"))
    return out[0].unionByName(out[1])


def table_clusters(cells: DataFrame, pairs: DataFrame, key: str = "page_id") -> DataFrame:
    """Cells (page_id, cell_id, ...) with `table_id`: the least cell_id that adjacency (page_id, a, b) reaches.

    Adjacency never leaves a page, so one shuffle by page and a union of each page's own pairs do; no rounds over all pages.
    """

    def rule(items: list[list[int]]) -> list[tuple]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a, b in items:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
        return [(x, root(x)) for x in list(parent)]

    kind = cells.schema["cell_id"].dataType.simpleString()
    groups = pairs.groupBy(key).agg(F.collect_list(F.array(F.col("a").cast(kind), F.col("b").cast(kind))).alias("items"))
    labels = by_group(groups, rule, (key,), f"cell_id {kind}, table_id {kind}")
    joined = cells.join(labels.hint("merge"), [key, "cell_id"], "left")
    return joined.withColumn("table_id", F.coalesce("table_id", "cell_id"))


def component_boxes(rows: DataFrame, keys: tuple[str, ...] = ("page_id", "label")) -> DataFrame:
    """The rectangle around each component's parts (l, t, r, b)."""
    return rows.groupBy(*keys).agg(*[(F.min if c in "lt" else F.max)(c).alias(c) for c in "ltrb"])


def cell_texts(matches: DataFrame, keys: tuple[str, ...] = ("page_id", "cell_id"), order: str = "block_id") -> DataFrame:
    """(keys, text): the texts of the blocks of each cell, in block order, joined by spaces."""
    return matches.groupBy(*keys).agg(ordered_concat(order, F.col("text"), " ").alias("text"))


def structure_score(tokens: DataFrame, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, structure_score): the mean token score, 0 for pages without tokens."""
    means = tokens.groupBy(key).agg(F.avg("score").alias("_mean"))
    return pages.select(key).distinct().join(means, key, "left").select(key, F.coalesce("_mean", F.lit(0.0)).alias("structure_score"))


def mean_and_stdev(rows: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, mean, stdev): stdev of the sample, 0 for one row."""
    return rows.groupBy(*keys).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"))


def run_summary(results: DataFrame) -> DataFrame:
    """One row: files, failed, exit_code (1 if any failed)."""
    return results.agg(F.count("*").alias("files"), F.count_if(F.col("code") != 0).alias("failed")).withColumn("exit_code", F.when(F.col("failed") > 0, 1).otherwise(0))


def size_shares(slots: DataFrame, keys: tuple[str, ...] = ("page_id", "table_id")) -> tuple[DataFrame, DataFrame]:
    """(keys, row, pct) of row heights and (keys, at, pct) of column widths, in percent of the table's extent.

    Columns are the stretches between distinct x edges.
    """
    whole = Window.partitionBy(*keys)
    rows = slots.groupBy(*keys, "row").agg(F.min("y1").alias("_a"), F.max("y2").alias("_b"))
    extent = F.greatest(F.max("_b").over(whole) - F.min("_a").over(whole), F.lit(1))
    rows = rows.select(*keys, "row", ((F.col("_b") - F.col("_a")) / extent * 100.0).alias("pct"))
    xs = slots.select(*keys, F.explode(F.array("x1", "x2")).alias("x")).distinct()
    after = F.lead("x").over(whole.orderBy("x"))
    width = F.greatest(F.max("x").over(whole) - F.min("x").over(whole), F.lit(1))
    xs = xs.select(*keys, (F.row_number().over(whole.orderBy("x")) - 1).alias("at"), ((after - F.col("x")) / width * 100.0).alias("pct"))
    return rows, xs.filter("pct is not null")


def max_effective_columns(raw: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, row, own, before, columns): of each row its colspans, the columns that earlier rowspans take, and the table's largest sum.

    `raw` holds cells (row, idx, colspan, rowspan); a span ends with the table's last row.
    """
    rows = raw.groupBy(key, "row").agg(F.sum("colspan").alias("own"))
    last = F.max("row").over(Window.partitionBy(key))
    spans = raw.withColumn("_end", F.least(F.col("row") + F.col("rowspan").cast("long") - 1, last).cast("int")).filter("_end > row")
    spans = spans.select(key, F.col("colspan").alias("_cs"), F.explode(F.sequence(F.col("row") + 1, F.col("_end"))).alias("row"))
    taken = spans.groupBy(key, "row").agg(F.sum("_cs").alias("before"))
    joined = rows.join(taken.hint("merge"), [key, "row"], "left").withColumn("before", F.coalesce("before", F.lit(0)))
    return joined.withColumn("columns", F.max(F.col("own") + F.col("before")).over(Window.partitionBy(key)))


def column_profile(pixels: DataFrame, key: str = "item_id", limit: int = 200) -> DataFrame:
    """(item_id, x, dark): how many pixels (x, y, grey) of each column are darker than `limit`."""
    return pixels.groupBy(key, "x").agg(F.count_if(F.col("grey") < limit).cast("int").alias("dark"))
