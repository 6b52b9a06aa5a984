"""Window operators: matches, separators, bands, clusters, runs, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import text_separator
from pagewright.operators.filters import PAGE, matches_text


def order_by_top(blocks: DataFrame, keys: tuple[str, ...] = PAGE, top: str = "t") -> DataFrame:
    """With `seq`: the place of each block on its page by top edge, then by block_id."""
    return blocks.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy(top, "block_id")) - 1)


def nth_match(blocks: DataFrame, query: Column, n: Column | int, keys: tuple[str, ...] = PAGE, order: str = "block_id") -> DataFrame:
    """Of each page the n-th block (from 1; less counts as 1) that holds the query. A block counts once."""
    hits = blocks.filter(matches_text(F.col("text"), query))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    n = n if isinstance(n, Column) else F.lit(n)
    return hits.withColumn("_at", at).filter(F.col("_at") == F.greatest(n, F.lit(1))).drop("_at")


def separators(blocks: DataFrame, keys: tuple[str, ...] = PAGE, order: str = "seq") -> DataFrame:
    """With `end`: what stands between a block and the next of its page; a line break after the last."""
    following = F.lead("text").over(Window.partitionBy(*keys).orderBy(order))
    return blocks.withColumn("_next", following).withColumn("end", F.when(F.col("_next").isNull(), "\n").otherwise(text_separator(F.col("text"), F.col("_next")))).drop("_next")


def band_by_gap(rows: DataFrame, value: str, max_gap: float, keys: tuple[str, ...], tie: tuple[str, ...] = (), out: str = "band") -> DataFrame:
    """With `band`, from 0 within the keys: a new one wherever a value is more than `max_gap` above the one before."""
    order = Window.partitionBy(*keys).orderBy(value, *tie)
    opens = F.when(F.col(value) - F.lag(value).over(order) > max_gap, 1).otherwise(0)
    rows = rows.withColumn("_opens", opens)
    return rows.withColumn(out, F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def cluster_values(rows: DataFrame, value: str, k: float, min_gap: float, keys: tuple[str, ...], out: str = "cluster") -> DataFrame:
    """Distinct (keys, value) with `cluster`: a new one where the gap is above k times the median gap and above min_gap.

    With one or two gaps the smallest stands for the median.
    """
    own = rows.select(*keys, value).distinct()
    order, page = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys)
    own = own.withColumn("_gap", F.col(value) - F.lag(value).over(order))
    typical = F.when(F.count("_gap").over(page) > 2, F.median("_gap").over(page)).otherwise(F.min("_gap").over(page))
    own = own.withColumn("_opens", F.when(F.col("_gap") > F.greatest(typical * k, F.lit(min_gap)), 1).otherwise(0))
    return own.withColumn(out, F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap", "_opens")


def best_class(steps: DataFrame, scores: str = "scores") -> DataFrame:
    """With `best` and `best_score`: the class, from 0, of the largest score, the first of equals."""
    top = F.array_max(scores)
    return steps.withColumn("best", F.array_position(scores, top).cast("int") - 1).withColumn("best_score", top)


def collapse_runs(steps: DataFrame, key: str = "line_id", order: str = "t", cls: str = "cls", score: str = "score", blank: int = 0) -> DataFrame:
    """(key, symbols, n, scores): the classes of a line without blanks and without repeats of the step before, joined by commas."""
    before = F.lag(cls).over(Window.partitionBy(key).orderBy(order))
    kept = steps.withColumn("_before", before).filter((F.col(cls) != blank) & (F.col("_before").isNull() | (F.col("_before") != F.col(cls))))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cls).alias("c"), F.col(score).alias("s"))))
    grouped = kept.groupBy(key).agg(rows.alias("_rows"))
    symbols = F.array_join(F.transform("_rows", lambda r: r["c"].cast("string")), ",")
    return grouped.select(key, symbols.alias("symbols"), F.size("_rows").alias("n"), F.transform("_rows", lambda r: r["s"]).alias("scores"))


def dedupe_adjacent(candidates: DataFrame, key: str = "page_id") -> DataFrame:
    """Candidate cells: of equal (x1, x2, y1) the one with the nearest lower edge, then of equal (x1, x2, y2) the nearest upper edge."""
    upper = Window.partitionBy(key, "x1", "x2", "y1").orderBy("y2")
    lower = Window.partitionBy(key, "x1", "x2", "y2").orderBy(F.desc("y1"))
    rows = candidates.withColumn("_at", F.row_number().over(upper)).filter("_at = 1")
    return rows.withColumn("_at", F.row_number().over(lower)).filter("_at = 1").drop("_at")


def cells_from_dividers(dividers: DataFrame, keys: tuple[str, ...] = ("page_id", "x1", "x2", "y1", "y2")) -> DataFrame:
    """(page_id, x1, y1, x2, y2): a cell between each two neighbouring dividers `x` of a candidate."""
    following = F.lead("x").over(Window.partitionBy(*keys).orderBy("x"))
    rows = dividers.withColumn("_next", following).filter(F.col("_next").isNotNull())
    return rows.select("page_id", F.col("x").alias("x1"), "y1", F.col("_next").alias("x2"), "y2")


def column_segments(profile: DataFrame, height: int, key: str = "item_id", gap: tuple[int, float] = (4, 0.15), width: tuple[int, float] = (3, 0.08)) -> DataFrame:
    """(item_id, seg, start, end): runs of dark columns (dark > 0), joined over small gaps, narrow ones dropped; end isn't included.

    Gaps are small below max(4, 15 % of the height), runs narrow below max(3, 8 %); (8, 0.20) and (6, 0.10) are the
    coarser values for pages.
    """
    least_gap, least_width = max(gap[0], int(height * gap[1])), max(width[0], int(height * width[1]))
    dark = profile.filter("dark > 0")
    order = Window.partitionBy(key).orderBy("x")
    step = F.col("x") - F.lag("x").over(order) - 1
    dark = dark.withColumn("_opens", F.when(step >= least_gap, 1).otherwise(0))
    dark = dark.withColumn("_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = dark.groupBy(key, "_run").agg(F.min("x").alias("start"), (F.max("x") + 1).alias("end")).filter(F.col("end") - F.col("start") >= least_width)
    return runs.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1).alias("seg"), "start", "end")


def row_gaps(blocks: DataFrame, keys: tuple[str, ...], row: str = "row_id") -> DataFrame:
    """(keys, row, l, r): the free stretches of each row of blocks (l, r) between the page's left edge - 1 and right edge + 1."""
    page = Window.partitionBy(*keys)
    rows = blocks.select(*keys, row, "l", "r", (F.min("l").over(page) - 1).alias("_pl"), (F.max("r").over(page) + 1).alias("_pr"))
    before = F.max("r").over(Window.partitionBy(*keys, row).orderBy("l", "r").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_from", F.greatest(F.coalesce(before, F.col("_pl")), F.col("_pl")))
    inner = rows.filter(F.col("l") > F.col("_from")).select(*keys, row, F.col("_from").alias("l"), F.col("l").alias("r"))
    tail = rows.groupBy(*keys, row).agg(F.max("r").alias("l"), F.max("_pr").alias("r"))
    return inner.unionByName(tail)


def shift_to_origin(blocks: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Rectangles (l, t, r, b) moved so that the page's least x and y are 0, if either is negative."""
    page = Window.partitionBy(*keys)
    rows = blocks.withColumn("_x", F.min("l").over(page)).withColumn("_y", F.min("t").over(page))
    moved = (F.col("_x") < 0) | (F.col("_y") < 0)
    shift = {"l": "_x", "r": "_x", "t": "_y", "b": "_y"}
    return rows.withColumns({c: F.when(moved, F.col(c) - F.col(s)).otherwise(F.col(c)) for c, s in shift.items()}).drop("_x", "_y")
