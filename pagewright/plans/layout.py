"""Layout: a page's blocks in reading order, with what stands between them. One shuffle by page serves each strategy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import separator_of, text_separator
from pagewright.operators import lines as N
from pagewright.operators import pages as P
from pagewright.operators import regions as R
from pagewright.operators.filters import PAGE
from pagewright.operators.lines import let, unplaced
from pagewright.operators.pages import Block, Placed


def _single_line(blocks: list[Block]) -> list[Placed]:
    return [(b, k, end) for k, line in enumerate(P.text_lines(blocks)) for b, end in zip(line, P.ends_in_line(line), strict=True)]


def _single_none(blocks: list[Block]) -> list[Placed]:
    out = _single_line(blocks)
    for i in range(len(out) - 1):
        if out[i][2] == "\n":
            out[i] = (*out[i][:2], separator_of(out[i][0].text, out[i + 1][0].text))
    return out


def _single_code(blocks: list[Block]) -> list[Placed]:
    lines = [P.merge_code_line(line) for line in P.text_lines(blocks)]
    return [(b, k, "\n") for k, b in enumerate(P.indent_lines(lines))]


#: Strategies of one column as rules over one page's list: the plain second version that tests hold the columns against.
STRATEGIES: dict[str, Callable[[list[Block]], list[Placed]]] = {
    "single_line": _single_line,
    "single_none": _single_none,
    "single_code": _single_code,
    "single_vertical": _single_line,
}


def line_unit(line: Column) -> Column:
    """A line of blocks as one unit. One of several blocks takes for its right and bottom edges the larger of its top and those of its last block, as it always has."""
    first, last, top = F.get(line, F.lit(0)), F.element_at(line, F.lit(-1)), F.array_min(F.transform(line, lambda x: x["t"]))
    edge = lambda c: F.when(F.size(line) > 1, F.greatest(top, last[c])).otherwise(last[c]).alias(c)
    return F.struct(first["l"].alias("l"), top.alias("t"), edge("r"), edge("b"), first["text"].alias("head"), last["text"].alias("tail"))


def single_para(blocks: Column) -> Column:
    """Lines in paragraphs."""

    def with_ends(placed: Column) -> Column:
        ends = R.paragraph_ends(F.transform(R.stretches(placed, "line"), line_unit))
        return let(ends, lambda e: N.with_ends(placed, lambda x, y: F.when(y.isNull() | (y["line"] != x["line"]), F.get(e, x["line"])).otherwise(N.in_line_end(x, y))))

    return let(N.in_lines(blocks), with_ends)


#: The strategies of one column, over a page's array of blocks.
IN_COLUMNS: dict[str, Callable[[Column], Column]] = {
    "single_line": N.single_line,
    "single_para": single_para,
    "single_none": N.single_none,
    "single_code": N.single_code,
    "single_vertical": N.single_line,
}


def _placed(read: Column, end: Callable[[Column, Column, Column], Column]) -> Column:
    """What layouts give, from blocks in reading order; `end` takes a block, the next one or null, and its place."""

    def row(x: Column, y: Column, i: Column) -> Column:
        return F.struct(x["region"].alias("region_id"), *[x[c].alias(c) for c in ("block_id", "text", "score", "box")], end(x, y, i).alias("end"))

    return F.transform(read, lambda x, i: let(F.get(read, i + 1), lambda y: row(x, y, i)))


def multi_line(read: Column) -> Column:
    """Every block ends in a line break."""
    return _placed(read, lambda x, y, i: F.lit("\n"))


def multi_para(read: Column) -> Column:
    """The blocks of each column in paragraphs."""
    unit = lambda x: F.struct(*[x[c].alias(c) for c in "ltrb"], x["text"].alias("head"), x["text"].alias("tail"))
    ends = F.flatten(F.transform(R.stretches(read, "region"), lambda own: R.paragraph_ends(F.transform(own, unit))))
    return let(ends, lambda e: _placed(read, lambda x, y, i: F.get(e, i)))


def multi_none(read: Column) -> Column:
    """Blocks joined by what their characters ask for; a line break only at the end of the page."""
    return _placed(read, lambda x, y, i: F.when(y.isNull(), F.lit("\n")).otherwise(text_separator(x["text"], y["text"])))


#: The strategies of several columns, over a page's blocks in reading order.
IN_REGIONS: dict[str, Callable[[Column], Column]] = {"multi_line": multi_line, "multi_para": multi_para, "multi_none": multi_none}

NAMES = ("none", *IN_COLUMNS, *IN_REGIONS)


def read_regions(pages: DataFrame, regions: Callable[[Column], Column] = R.in_regions) -> DataFrame:
    """Pages with `read`, the blocks of `blocks` region after region in reading order; null where that is null or some block has no place."""
    own = F.when(~unplaced(F.col("blocks")), regions(F.col("blocks")))
    rows = pages.withColumn("_own", own).withColumn("_order", P.fine_order(F.col("_own")))
    return rows.withColumn("read", F.transform("_order", lambda i: F.get("_own", i))).drop("_own", "_order")


def laid_out(pages: DataFrame, strategy: str) -> DataFrame:
    """Pages with `laid`, their blocks laid out; null for a page with a block without a place, or without blocks at all (null)."""
    if strategy in IN_COLUMNS:
        return pages.withColumn("laid", F.when(F.col("blocks").isNotNull() & ~unplaced(F.col("blocks")), IN_COLUMNS[strategy](F.col("blocks"))))
    rows = read_regions(pages)
    return rows.withColumn("laid", let(F.col("read"), IN_REGIONS[strategy])).drop("read")


def placed_rows(pages: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """The keys and LAID_OUT from `laid`; a page without it is an error record."""
    rows = pages.select(*keys, F.posexplode_outer("laid").alias("_at", "_row"))
    failed = F.col("_row").isNull()
    said = [F.col(f"_row.{c}").alias(c) for c in ("region_id", "block_id", "text", "score", "box", "end")]
    return rows.select(*keys, F.coalesce("_at", F.lit(0)).alias("seq"), *said, failed.cast("int").alias("code"), F.when(failed, "a block has no place").alias("msg"))


def layout(blocks: DataFrame, strategy: str, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """The keys, seq, region_id, block_id, text, score, box, end, code, msg: blocks in reading order.

    region_id numbers lines (single-column strategies) or columns. Blocks without a text are left out, but by `none`,
    which passes every block through as it is. A page that fails gives one row with code 1 and msg. An unknown strategy
    raises an error.
    """
    if strategy == "none":
        order = Window.partitionBy(*keys).orderBy("block_id")
        seq = (F.row_number().over(order) - 1).cast("int")
        return blocks.select(*keys, seq.alias("seq"), F.lit(0).alias("region_id"), "block_id", "text", "score", "box", "end", F.lit(0).alias("code"), F.lit(None).cast("string").alias("msg"))
    if strategy not in NAMES:
        raise ValueError(f"unknown layout strategy {strategy!r}; there are {', '.join(NAMES)}")
    ready = P.preprocess(blocks, keys)
    if strategy == "single_vertical":  # the turned boxes are what is read, as of an upright page
        ready = P.preprocess(P.turn_pages(ready, keys).drop("l", "t", "r", "b", "seq"), keys)
    return placed_rows(laid_out(P.page_lists(ready, keys), strategy), keys)
