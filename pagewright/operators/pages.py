"""Page operators: rules that depend on the order within one page or one table.

Each takes the page's own list and is spread over pages by Spark. `preprocess` and the columns before it stay in the
JVM, as do lines, regions and paragraphs (`lines`, `regions`). The order within a region (`fine_order`) and the functions of
cells (`by_group`) take numbers that Spark has made, in Arrow batches. `by_page` runs a rule over one page's list, with an
error record for a page that fails: the plain second version that tests hold the columns against.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.geometry import UPRIGHT_DEG, Rect, aabb, block_angle, rotate_box, rotate_box_ccw90, spacing_match
from pagewright.functions.text import separator_of
from pagewright.operators import cells as C
from pagewright.operators import sweeps as S
from pagewright.operators.filters import PAGE, non_empty
from pagewright.operators.lines import let

#: What the layout operators return, one row per block.
LAID_OUT = "seq int, region_id int, block_id int, text string, score double, box array<int>, end string, code int, msg string"


class Block(NamedTuple):
    """A block of one page: its upright rectangle, and what is carried along."""

    l: float  # noqa: E741
    t: float
    r: float
    b: float
    text: str
    block_id: int = 0
    score: float = 0.0
    box: tuple[int, ...] = ()

    @property
    def h(self) -> float:
        return self.b - self.t


def preprocess(blocks: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Blocks with a text, with l, t, r, b and seq: turned back on pages tilted by more than 3 degrees, in order of top edges."""
    own = non_empty(blocks)
    page = Window.partitionBy(*keys)
    rows = own.withColumn("_angle", block_angle(F.col("box"))).withColumn("_turn", F.median("_angle").over(page))
    tilted = F.abs("_turn") > F.radians(F.lit(UPRIGHT_DEG))
    plain, turned = aabb(F.col("box")), rotate_box(F.col("box"), F.col("_turn"))
    rows = rows.withColumns({c: F.when(tilted, q).otherwise(p.cast("double")) for c, p, q in zip("ltrb", plain, turned, strict=True)})
    page_min = {"_x": F.min("l").over(page), "_y": F.min("t").over(page)}
    moved = tilted & ((F.col("_x") < 0) | (F.col("_y") < 0))
    shift = {"l": "_x", "r": "_x", "t": "_y", "b": "_y"}
    rows = rows.withColumns(page_min).withColumns({c: F.when(moved, F.col(c) - F.col(s)).otherwise(F.col(c)) for c, s in shift.items()})
    order = Window.partitionBy(*keys).orderBy(F.round("t", 6), "block_id")  # what turning adds in the last digits is no order
    return rows.withColumn("seq", F.row_number().over(order) - 1).drop("_angle", "_turn", "_x", "_y")


def page_lists(blocks: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """One row per page with `blocks`, in order of seq: what page functions take."""
    row = F.struct("seq", "l", "t", "r", "b", "text", "block_id", F.col("score").cast("double").alias("score"), "box")
    return blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("blocks"))


Placed = tuple[Block, int, str]


def by_page(pages: DataFrame, rule: Callable[[list[Block]], list[Placed]], keys: tuple[str, ...] = PAGE) -> DataFrame:
    """The keys and LAID_OUT: `rule` gives a page's blocks in reading order, each with its region and end."""
    head = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, *(c.strip().split(" ")[0] for c in LAID_OUT.replace("array<int>", "array").split(","))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                try:
                    blocks = [Block(x["l"], x["t"], x["r"], x["b"], x["text"], x["block_id"], x["score"], tuple(x["box"])) for x in row["blocks"]]
                    out += [(*own, i, region, b.block_id, b.text, b.score, list(b.box), end, 0, None) for i, (b, region, end) in enumerate(rule(blocks))]
                except (ValueError, ArithmeticError, LookupError, TypeError) as e:
                    out.append((*own, 0, None, None, None, None, None, None, 1, f"{type(e).__name__}: {e}"))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            kinds = [batch.schema.field(k).type for k in keys] + [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.list_(pa.int32()), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return pages.select(*keys, "blocks").mapInArrow(run, f"{head}, {LAID_OUT}")


# ---- lines of text ----


def text_lines(blocks: list[Block]) -> list[list[Block]]:
    """Blocks in lines, from left to right, and the lines by the top of their first block.

    The leftmost free block opens a line; a block further right joins if it begins no more than a line height before the
    line's end, lies within half a height of the first block, and is of like height.
    """
    free = sorted(blocks, key=lambda b: b.l)
    lines = []
    while free:
        first, rest = free[0], []
        line, end = [first], first.r
        for b in free[1:]:
            near = b.l >= end - first.h and b.t >= first.t - first.h / 2 and b.b <= first.b + first.h / 2
            if near and abs(first.h - b.h) <= min(first.h, b.h) / 2:
                line.append(b)
                end = b.r
            else:
                rest.append(b)
        lines.append(line)
        free = rest
    return sorted(lines, key=lambda line: line[0].t)


def ends_in_line(line: list[Block], fix_gap_height: bool = False) -> list[str]:
    """What follows each block of a line: a space after a wide gap, else by the characters; a line break after the last.

    The height that a gap is measured by takes the next block's left edge for its top, as it always has; `fix_gap_height`
    measures by the top.
    """
    ends = []
    for a, b in zip(line, line[1:], strict=False):
        height = (a.b + b.b - a.t - (b.t if fix_gap_height else b.l)) / 2
        ends.append(" " if b.l - a.r > height * 1.5 else separator_of(a.text, b.text))
    return [*ends, "\n"]


# ---- code ----


def half_up(x: float) -> int:
    """Rounded, halves away from zero."""
    return int(abs(x) + 0.5) * (1 if x >= 0 else -1)


def merge_code_line(line: list[Block]) -> Block:
    """A line as one block: two spaces for every height of a gap, the boxes joined, the scores' mean."""
    first = line[0]
    box, text = list(first.box), first.text
    height = float(box[7] - box[1])
    for b in line[1:]:
        height = (height + b.box[7] - b.box[1]) / 2
        spaces = max(0, half_up((b.box[0] - box[2]) / height)) if b.box[0] > box[2] and height else 0
        text += "  " * spaces + b.text
        top, bottom = min(box[1], box[3], b.box[1], b.box[3]), max(box[5], box[7], b.box[5], b.box[7])
        left, right = min(box[0], box[6], b.box[0], b.box[6]), max(box[2], box[4], b.box[2], b.box[4])
        box = [left, top, right, top, right, bottom, left, bottom]
    return first._replace(text=text, box=tuple(box), score=sum(b.score for b in line) / len(line))


def indent_lines(lines: list[Block]) -> list[Block]:
    """Two spaces before each line for every level of its left edge; levels are a mean line height apart, from the leftmost line."""
    if not lines:
        return []
    height = sum(b.box[7] - b.box[1] for b in lines) / len(lines)
    least, most = min(b.box[0] for b in lines), max(b.box[0] for b in lines)
    levels, x = [], float(least)
    while x < most and height > 0:
        levels.append(x)
        x += height
    out = []
    for b in lines:
        level = max(0, bisect_left(levels, b.box[0] + height / 2) - 1)
        out.append(b._replace(text="  " * level + b.text, box=(least, *b.box[1:6], least, b.box[7])))
    return out


# ---- order within a region ----

#: The linking rounds, as (below or right, gap, alignment). A gap of 0 is replaced by a tenth of the font
#: height (below) or ten character widths (right); -1 asks for matching spacing instead; below, 70 % of the alignment do.
ROUNDS = (("below", -1.0, 1.0), ("below", 0.0, 1.0), ("right", 0.0, 0.98), ("below", 0.25, 0.75), ("right", 0.25, 0.75), ("below", 0.5, 0.5), ("right", 0.5, 0.5))


#: Gaps that differ by no more count as equal, and so much of a side's length may stick out of what faces it.
EQUAL_GAPS, INSET = 0.1, 0.2

#: Of so many blocks at most it is worked out once how each lies to all others; of more, block by block.
AT_ONCE = 256


def earliest(boxes: Rect, among: np.ndarray) -> int:
    """Which of the blocks is read first, each compared with the first so far.

    Two blocks are weighed by x if they share a row, by y if they share a column only, and by both if neither; the
    weights differ from pair to pair, so there is no order of all blocks to sort by.
    """
    left, top, right, bottom = boxes

    def earlier(at: int, other: int) -> int:
        row = bottom[other] > top[at] and top[other] < bottom[at]
        column = right[other] > left[at] and left[other] < right[at]
        ahead = (row or not column) * (left[other] - left[at]) + (not row) * (top[other] - top[at])
        return other if ahead < 0 else at

    return reduce(earlier, among.tolist())


class Chains:
    """Blocks that are read one after another, and for each chain which blocks lie on its sides."""

    def __init__(self, boxes: Rect) -> None:
        self.boxes = boxes
        n = len(boxes.left)
        self.after: dict[int, int] = {}
        self.free = np.ones(n, bool)  # nothing leads to them yet
        self.chain = np.arange(n)  # named by one of its blocks
        self._sides: dict[int, np.ndarray] = {}
        self._all = self._ahead(np.arange(n)[:, None]) if n <= AT_ONCE else None

    def _ahead(self, i) -> tuple[np.ndarray, ...]:
        """How block i, or each of a column of blocks, lies to all blocks: their alignment in x and in y, the gaps, and which are ahead below and to the right."""
        l, t, r, b = self.boxes  # noqa: E741
        columns, rows = aligned(l[i], r[i], l, r), aligned(t[i], b[i], t, b)
        gap = np.where(columns > 0, t - b[i], l - r[i])
        ahead = (gap >= 0) & (np.arange(len(l)) != i)
        return columns, rows, gap, ahead & (columns > 0), ahead & (rows > 0)

    def sides(self, chain: int) -> np.ndarray:
        """Four rows: which blocks lie above, left, right and below of any block of the chain, facing most of its side."""
        if chain not in self._sides:
            l, t, r, b = self.boxes  # noqa: E741
            dx, dy = (r[chain] - l[chain]) * INSET, (b[chain] - t[chain]) * INSET
            facing_x = np.minimum(r, r[chain] - dx) >= np.maximum(l, l[chain] + dx)
            facing_y = np.minimum(b, b[chain] - dy) >= np.maximum(t, t[chain] + dy)
            self._sides[chain] = np.stack([(b <= t[chain]) & facing_x, (r <= l[chain]) & facing_y, (l >= r[chain]) & facing_y, (t >= b[chain]) & facing_x])
        return self._sides[chain]

    def follower(self, i: int, below: bool) -> tuple[int, float, float] | None:
        """The nearest free block below or to the right of block i, its alignment with it and its gap; of equal gaps the leftmost."""
        columns, rows, gap, under, beside = (side[i] for side in self._all) if self._all else self._ahead(i)
        fit = np.flatnonzero(self.free & (under if below else beside))
        if not len(fit):
            return None
        gaps = gap[fit]
        near = fit[gaps <= gaps.min() + EQUAL_GAPS]
        j = int(near[self.boxes.left[near].argmin()])
        return j, float((columns if below else rows)[j]), float(gap[j])

    def join(self, i: int, j: int) -> None:
        """Let j follow i, unless they are of one chain or the two chains together shut a free block in."""
        one, other = int(self.chain[i]), int(self.chain[j])
        if one == other:
            return
        both = self.sides(one) | self.sides(other)
        above, left, right, below = both[:, self.free & (self.chain != one) & (self.chain != other)]
        if not ((above & (left | right)) | (left & below)).any():
            self.after[i], self.free[j] = j, False
            self.chain[self.chain == other] = one
            self._sides[one] = both
            self._sides.pop(other, None)


def aligned(a0, a1, b0, b1) -> np.ndarray:
    """`alignment` of intervals, over arrays."""
    return (np.minimum(a1, b1) - np.maximum(a0, b0)) / np.maximum(np.maximum(a1 - a0, b1 - b0), 0.01)


def reading_order(boxes: Rect, size: np.ndarray) -> list[int]:
    """A region's blocks in reading order: chained below and to the right in seven rounds, then chain after chain by position.

    `size` is the length of each block's text in bytes. A link isn't made if its chain then shuts a free block in: between
    above and left, above and right, or left and below of it. Each chain keeps, for all blocks, on which of its sides they
    lie, so a link costs one pass over the region.
    """
    n = len(size)
    if n < 2:
        return list(range(n))
    high, wide = boxes.bottom - boxes.top, boxes.right - boxes.left
    written = (wide > 0) & (size > 0)
    usual = {"below": 0.1 * (high[high > 0].mean() if (high > 0).any() else 0.15), "right": 10 * ((wide[written] / size[written]).mean() if written.any() else 0.1)}
    chains, start = Chains(boxes), earliest(boxes, np.arange(n))
    chains.free[start] = False
    for way, limit, alignment in ROUNDS:
        below = way == "below"
        for i in range(n):
            if i in chains.after or not (found := chains.follower(i, below)):
                continue
            j, along, gap = found
            if limit < 0:
                close = bool(spacing_match(*(Rect(*(side[k] for side in boxes)) for k in (i, j))))
            else:
                close = gap <= (limit or usual[way])
            if close and along >= alignment * (0.7 if below else 1.0):
                chains.join(i, j)
    order, at, waiting = [], start, np.ones(n, bool)
    while True:
        order.append(at)
        waiting[at] = False
        if not waiting.any():
            return order
        at = chains.after.get(at, -1)
        if at < 0 or not waiting[at]:
            heads = np.flatnonzero(waiting & chains.free)
            at = earliest(boxes, heads if len(heads) else np.flatnonzero(waiting))


def fine_sort(region: list[Block]) -> list[Block]:
    """`reading_order` of a list of blocks."""
    boxes = Rect(*(np.array([getattr(b, c) for b in region], float) for c in "ltrb"))
    return [region[i] for i in reading_order(boxes, np.array([len(b.text.encode()) for b in region]))]


def _region_orders(region: pa.Array, left: pa.Array, top: pa.Array, right: pa.Array, bottom: pa.Array, size: pa.Array) -> pa.Array:
    out: list[list[int] | None] = []
    for page in zip(*(side.to_pylist() for side in (region, left, top, right, bottom, size)), strict=True):
        if not page[0]:
            out.append(page[0])
            continue
        numbers, *sides, sizes = (np.array(side) for side in page)
        starts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
        order: list[int] = []
        for a, b in zip(starts, [*starts[1:], len(numbers)], strict=True):
            order += [int(a) + i for i in reading_order(Rect(*(side[a:b].astype(float) for side in sides)), sizes[a:b])]
        out.append(order)
    return pa.array(out, pa.list_(pa.int32()))


def fine_order(blocks: Column) -> Column:
    """The places of a page's blocks (region, l, t, r, b, text), region after region, each in reading order; null for null. Only numbers reach Python."""
    return F.arrow_udf(_region_orders, "array<int>")(blocks["region"], *[blocks[c] for c in "ltrb"], F.transform(blocks, lambda b: F.octet_length(b["text"])))


# ---- vertical text ----


def turn_pages(blocks: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Preprocessed blocks with `box` turned a quarter against the clock about half of the page's extents."""
    page = Window.partitionBy(*keys)
    rows = blocks.withColumn("_cx", F.greatest(F.max("r").over(page), F.lit(0.0)) / 2).withColumn("_cy", F.greatest(F.max("b").over(page), F.lit(0.0)) / 2)
    return rows.withColumn("box", rotate_box_ccw90(F.col("box"), F.col("_cx"), F.col("_cy"))).drop("_cx", "_cy")


# ---- cells and grids ----

CellBox = tuple[int, int, int, int]


class Covered:
    """What is covered of a strip: intervals that don't touch, in order."""

    __slots__ = ("ends", "starts")

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, low: int, high: int) -> int:
        """The length within [low, high) that isn't covered."""
        first, last = bisect_right(self.ends, low), bisect_left(self.starts, high)
        return high - low - sum(min(high, self.ends[k]) - max(low, self.starts[k]) for k in range(first, last))

    def add(self, low: int, high: int) -> None:
        first, last = bisect_left(self.ends, low), bisect_right(self.starts, high)
        if first < last:
            low, high = min(low, self.starts[first]), max(high, self.ends[last - 1])
        self.starts[first:last], self.ends[first:last] = [low], [high]


def dedupe_boxes(cells: list[CellBox]) -> list[CellBox]:
    """Smallest first, the cells of which at least a quarter isn't covered by those kept before; areas are exact.

    The page is cut into strips at the cells' edges, across the axis on which cells span fewer of them; each strip knows what is covered
    of it as intervals. So memory grows with the cells and the strips they span, not with the area of the page.
    """
    own = [c for c in sorted(set(cells), key=lambda c: ((c[2] - c[0]) * (c[3] - c[1]), c)) if c[2] > max(0, c[0]) and c[3] > max(0, c[1])]
    edges = [np.unique([max(0, c[side]) for c in own for side in (axis, axis + 2)]) for axis in (0, 1)]
    spanned = [sum(np.searchsorted(e, [c[axis + 2] for c in own]) - np.searchsorted(e, [max(0, c[axis]) for c in own])) if own else 0 for axis, e in enumerate(edges)]
    axis = 1 if spanned[1] <= spanned[0] else 0
    cuts, kept = edges[axis].tolist(), []
    strips: list[Covered | None] = [None] * len(cuts)
    for c in own:
        low, high = max(0, c[1 - axis]), c[3 - axis]
        reach = range(bisect_left(cuts, max(0, c[axis])), bisect_left(cuts, c[axis + 2]))
        free, wanted = 0, 0.25 * (c[2] - c[0]) * (c[3] - c[1])
        for k in reach:
            strip = strips[k]
            free += (cuts[k + 1] - cuts[k]) * (high - low if strip is None else strip.free(low, high))
            if free >= wanted:
                break
        if free >= wanted:
            kept.append(c)
            for k in reach:
                if strips[k] is None:
                    strips[k] = Covered()
                strips[k].add(low, high)
    return kept


def spans_of(rows: list[list[CellBox]]) -> list[tuple[int, int, int, int]]:
    """(row, col, rowspan, colspan) of the slots where a cell begins: equal boxes to the right and below belong to it."""
    used, out = [[False] * len(row) for row in rows], []
    for i, row in enumerate(rows):
        for j, box in enumerate(row):
            if used[i][j]:
                continue
            wide = 1
            while j + wide < len(row) and row[j + wide] == box:
                wide += 1
            tall = 1
            while i + tall < len(rows) and all(j + k < len(rows[i + tall]) and not used[i + tall][j + k] and rows[i + tall][j + k] == box for k in range(wide)):
                tall += 1
            for y in range(i, i + tall):
                used[y][j : j + wide] = [True] * wide
            out.append((i, j, tall, wide))
    return out


def by_group(groups: DataFrame, rule: Callable[[Any], list[tuple]], keys: tuple[str, ...], schema: str) -> DataFrame:
    """The keys and `schema`: `rule` turns the list in the column `items` into rows."""
    head = ", ".join(f"{k} {groups.schema[k].dataType.simpleString()}" for k in keys)
    n = len(schema.split(","))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(*(row[k] for k in keys), *x) for row in batch.to_pylist() for x in rule(row["items"])]
            names = [*keys, *(c.strip().split(" ")[0] for c in schema.split(","))]
            kinds = [*(batch.schema.field(k).type for k in keys), *([None] * n)]
            ints = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
            kinds = [k or ints[c.strip().split(" ")[1]] for k, c in zip(kinds, [*([""] * len(keys)), *schema.split(",")], strict=True)]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return groups.select(*keys, "items").mapInArrow(run, f"{head}, {schema}")


def dedupe_cells(cells: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, cell_id, x1, y1, x2, y2): the kept cells of each page, numbered by (y1, x1, y2, x2). Those with an unknown edge are left out."""
    names = ("x1", "y1", "x2", "y2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, _ = S.in_order(*S.flat(batch, "items"), names)
            own = own.at(C.deduped(own.page, own, dedupe_boxes))
            own = own.at(np.lexsort((own.r, own.b, own.l, own.t, own.page)))
            ids = C.places(own.page)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own.page)), *(pa.array(side.astype(np.int32)) for side in (ids, *own[1:]))], [key, "cell_id", *names])

    lists = cells.groupBy(key).agg(F.collect_set(F.struct(*names)).alias("items"))
    return lists.mapInArrow(run, f"{key} {cells.schema[key].dataType.simpleString()}, cell_id int, x1 int, y1 int, x2 int, y2 int")


def spans(slots: DataFrame, keys: tuple[str, ...] = ("page_id", "table_id")) -> DataFrame:
    """(keys, row, col, rowspan, colspan) of the slots (row, col, x1, y1, x2, y2) where cells begin."""
    groups = slots.groupBy(*keys).agg(F.array_sort(F.collect_list(F.array("row", "col", "x1", "y1", "x2", "y2"))).alias("items"))

    def rule(items: list[list[int]]) -> list[tuple]:
        rows: dict[int, list[CellBox]] = {}
        for row, _, *box in items:
            rows.setdefault(row, []).append(tuple(box))
        return spans_of([rows[r] for r in sorted(rows)])

    return by_group(groups, rule, keys, "row int, col int, rowspan int, colspan int")


def grid_of(cells: Column, n: Column) -> Column:
    """struct(free, placed) of a table's cells (row, idx, wide, tall), in order, of n rows: each at the next free column of its row.

    `placed` has (row, idx, col), idx counting a row's cells from 0; `free` as many entries as the grid has columns. There are at most eight columns for
    every row; cells beyond them have a null for col, and spans end with the table, whatever they say. A fold that keeps, for each column, from which row
    on it is free.
    """
    start = F.expr("named_struct('free', cast(array() as array<int>), 'row', cast(null as int), 'at', 0, 'i', -1, 'k', -1, 'placed', cast(array() as array<struct<row:int,idx:int,col:int>>))")
    limit = n * 8

    def step(s: Column, c: Column) -> Column:
        goes_on = c["row"].eqNullSafe(s["row"])
        i, k, after = F.when(goes_on, s["i"]).otherwise(s["i"] + 1), F.when(goes_on, s["k"] + 1).otherwise(0), F.when(goes_on, s["at"]).otherwise(0)
        until = lambda x: F.coalesce(F.get(s["free"], x), F.lit(0))
        first = F.get(F.filter(F.sequence(after, F.greatest(after, F.size(s["free"]))), lambda x: until(x) <= i), F.lit(0))

        def put(at: Column) -> Column:
            wide = F.greatest(F.least(c["wide"], limit - at), F.lit(0))
            tall = F.greatest(F.least(c["tall"], n - i), F.lit(0))
            end = F.greatest(F.size(s["free"]), at + wide)
            taken = F.transform(F.sequence(F.lit(0), F.greatest(end - 1, F.lit(0))), lambda x: F.when((x >= at) & (x < at + wide), F.greatest(until(x), i + tall)).otherwise(until(x)))
            there = at < limit
            further = F.least(at + F.greatest(c["wide"].cast("long"), F.lit(1)), limit.cast("long")).cast("int")
            return F.struct(
                F.when(there & (wide > 0) & (tall > 0), taken).otherwise(s["free"]).alias("free"),
                c["row"].cast("int").alias("row"),
                F.when(there, further).otherwise(at).alias("at"),
                i.alias("i"),
                k.alias("k"),
                F.array_append(s["placed"], F.struct(c["row"].cast("int").alias("row"), k.alias("idx"), F.when(there, at).alias("col"))).alias("placed"),
            )

        return let(first, put)

    return F.aggregate(cells, start, step, lambda s: F.struct(s["free"].alias("free"), s["placed"].alias("placed")))


def place_grid(raw: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, row, idx, col, columns) of the raw cells (row, idx, colspan, rowspan) of each table; see `grid_of`. Cells without a row or an idx have no place."""
    cell = F.struct("row", "idx", F.coalesce("colspan", F.lit(1)).cast("int").alias("wide"), F.coalesce("rowspan", F.lit(1)).cast("int").alias("tall"))
    tables = raw.filter("row is not null and idx is not null").groupBy(key).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    tables = tables.select(key, grid_of(F.col("cells"), F.size(F.array_distinct("cells.row"))).alias("grid"))
    return tables.select(key, F.size("grid.free").alias("columns"), F.explode("grid.placed").alias("p")).select(key, "p.row", "p.idx", "p.col", "columns").filter("col is not null")
