"""Filters over blocks, components, lines, cells and tables. Each takes and returns a DataFrame, with its columns unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.geometry import aabb, corner
from pagewright.functions.text import ascii_lower
from pagewright.operators.strips import area_by_depth

PAGE = ("doc_id", "page")


def non_empty(blocks: DataFrame) -> DataFrame:
    """Blocks with a text."""
    return blocks.filter(F.coalesce(F.col("text"), F.lit("")) != "")


def box_sides(box: Column) -> tuple[Column, Column]:
    """The lengths of a box's top and right sides."""
    (x0, y0), (x1, y1), (x2, y2) = (corner(box, i) for i in range(3))
    return F.hypot(x1 - x0, y1 - y0), F.hypot(x2 - x1, y2 - y1)


def box_quality(blocks: DataFrame, min_score: float = 0.6, min_side: float = 3.0, grown_side: float = 5.0, grow: float = 0.0, per_page: int = 1000, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Of each page's first `per_page` boxes those with a score and a long side of at least the bounds, and the grown one after growing."""
    first = top_candidates(blocks, per_page, keys)
    a, b = box_sides(F.col("box"))
    long = F.greatest(a, b)
    return first.filter((F.col("score") >= min_score) & (long >= min_side) & (long + 2 * grow >= grown_side))


def top_candidates(blocks: DataFrame, k: int = 1000, keys: tuple[str, ...] = PAGE, order: str = "block_id") -> DataFrame:
    """The first k blocks of each page."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return blocks.withColumn("_at", at).filter(F.col("_at") <= k).drop("_at")


def below_table_top(blocks: DataFrame, cells: DataFrame, key: str = "page_id") -> DataFrame:
    """Blocks (l, t, r, b) whose bottom isn't above the topmost cell (y1) of their page; those of pages without cells go."""
    top = cells.groupBy(key).agg(F.min("y1").alias("_top"))
    return blocks.join(top.hint("merge"), key).filter(F.col("b") >= F.col("_top")).drop("_top")


def contains_text(blocks: DataFrame, query: str) -> DataFrame:
    """Blocks whose text holds the query, case counting."""
    return blocks.filter(F.contains(F.col("text"), F.lit(query)))


def matches_text(text: Column, query: Column) -> Column:
    """Whether a text holds the query, the case of ASCII letters not counting."""
    return F.contains(ascii_lower(text), ascii_lower(query))


def in_region(blocks: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """Blocks whose centre lies in a rectangle, its right and bottom edges not included. Coordinates stay those of the page."""
    r = aabb(F.col("box"))
    cx, cy = (r.left + r.right) / 2, (r.top + r.bottom) / 2
    return blocks.filter((cx >= x) & (cx < x + w) & (cy >= y) & (cy < y + h))


def component_shape(components: DataFrame) -> DataFrame:
    """With `shaped`: sides within 5 to 1, and more than 0.08 of the rectangle inked."""
    w, h = F.col("r") - F.col("l"), F.col("b") - F.col("t")
    slender = F.greatest(w, h) / F.greatest(F.lit(1), F.least(w, h))
    fill = F.col("area") / F.greatest(F.lit(1), w * h)
    return components.withColumn("shaped", (slender <= 5.0) & (fill > 0.08))


def component_size(components: DataFrame, key: str = "page_id") -> DataFrame:
    """With `kept`, for shaped components: area near the page's medians (0.2 to 5 times), or a dash of about their width."""
    w, h = F.col("r") - F.col("l"), F.col("b") - F.col("t")
    page = Window.partitionBy(key)
    mw, mh = F.median(F.when(F.col("shaped"), w)).over(page), F.median(F.when(F.col("shaped"), h)).over(page)
    rows = components.withColumn("_mw", mw).withColumn("_mh", mh)
    size = F.col("_mw") * F.col("_mh")
    bounded = (w * h >= 0.2 * size) & (w * h <= 5.0 * size)
    dash = (w / F.greatest(F.lit(1), h) >= 2.0) & (w >= 0.5 * F.col("_mw")) & (w <= 1.5 * F.col("_mw"))
    return rows.withColumn("kept", F.coalesce(F.col("shaped") & (bounded | dash), F.lit(False))).drop("_mw", "_mh")


def straight_lines(lines: DataFrame) -> DataFrame:
    """Lines that are exactly horizontal or vertical, with `orient` h or v; points go."""
    flat, up = (F.col("y1") == F.col("y2")) & (F.col("x1") != F.col("x2")), (F.col("x1") == F.col("x2")) & (F.col("y1") != F.col("y2"))
    return lines.filter(flat | up).withColumn("orient", F.when(flat, "h").otherwise("v"))


def with_area(cells: DataFrame) -> DataFrame:
    """Cells (x1, y1, x2, y2) with a positive area."""
    return cells.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def cluster_size(cells: DataFrame, keys: tuple[str, ...] = ("page_id", "table_id"), least: int = 2) -> DataFrame:
    """Cells of clusters of at least two."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return cells.withColumn("_n", n).filter(F.col("_n") >= least).drop("_n")


def pair_overlap(cells: DataFrame, keys: tuple[str, ...] = ("page_id", "table_id"), band: int = 256, bands: int = 1024) -> DataFrame:
    """(keys, overlap): the common areas of all pairs of a table's distinct cells (whole coordinates), summed; 0 for tables without overlap.

    No pair is made: where d cells lie over one another, d * (d - 1) / 2 pairs share the place, so the sum is an area by depth. Bands are `band`
    units wide, or wider where a table would have more than `bands` of them: a cell is cut in as many pieces at most.
    """
    own = cells.select(*keys, *[F.col(c).cast("long").alias(n) for c, n in zip(("x1", "y1", "x2", "y2"), "ltrb", strict=True)]).distinct()
    table = Window.partitionBy(*keys)
    own = own.withColumn("_wide", F.greatest(F.lit(band), F.ceil((F.max("r").over(table) - F.min("l").over(table)) / bands)))
    sums = area_by_depth(own, keys, lambda depth: F.shiftright(depth * (depth - 1), 1), "overlap", F.col("_wide"))
    none = own.select(*keys, F.lit(0).cast("long").alias("overlap"))
    return sums.unionByName(none).groupBy(*keys).agg(F.sum("overlap").alias("overlap"))


def valid_tables(slots: DataFrame, keys: tuple[str, ...] = ("page_id", "table_id")) -> DataFrame:
    """The slots (row, col, x1, y1, x2, y2) of tables with a valid shape.

    Two rows and columns, four distinct cells, no more distinct edges than rows and columns give, and little overlap.
    """
    edges = [F.collect_set(c) for c in ("x1", "x2", "y1", "y2")]
    stats = slots.groupBy(*keys).agg(
        (F.max("row") + 1).alias("_rows"),
        (F.max("col") + 1).alias("_cols"),
        F.countDistinct("x1", "y1", "x2", "y2").alias("_cells"),
        F.size(F.array_union(edges[0], edges[1])).alias("_xs"),
        F.size(F.array_union(edges[2], edges[3])).alias("_ys"),
        ((F.max("x2") - F.min("x1")).cast("long") * (F.max("y2") - F.min("y1"))).alias("_area"),
    )
    shape = (F.col("_rows") >= 2) & (F.col("_cols") >= 2) & (F.col("_cells") >= 4) & (F.col("_xs") <= F.col("_cols") + 1) & (F.col("_ys") <= F.col("_rows") + 1)
    good = stats.join(pair_overlap(slots, keys).hint("merge"), list(keys)).filter(shape & (2 * F.col("overlap") < F.expr("_area div 5")))
    return slots.join(good.select(*keys).hint("shuffle_hash"), list(keys), "left_semi")


