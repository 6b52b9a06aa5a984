"""Joins between blocks, cells, lines and components.

Theta joins are equi joins on the page and on bands of height or width, so that a huge page is compared in parts; the rest of the
condition filters. Joins by page name a merge: Spark can't see how many rows an exploded row gives, and would send whole tables to the driver to broadcast them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.geometry import Rect, corner_distance, iou, overlap_area
from pagewright.operators import cells as C
from pagewright.operators import sweeps as S
from pagewright.operators.filters import PAGE
from pagewright.operators.windows import dedupe_adjacent

CELL = ("x1", "y1", "x2", "y2")


def cell_rect(prefix: str = "") -> Rect:
    return Rect(*(F.col(prefix + c) for c in CELL))


def block_rect(prefix: str = "") -> Rect:
    return Rect(*(F.col(prefix + c) for c in "ltrb"))


def _bands(low: Column, high: Column, width: int) -> Column:
    """The numbers of the bands of a height that an interval touches."""
    return F.sequence(F.floor(low / width).cast("int"), F.floor(high / width).cast("int"))


def _dealt(rows: DataFrame, low: Column, high: Column, width: int) -> DataFrame:
    """`rows` once for each band (`_band`) that the interval touches."""
    return rows.withColumn("_band", F.explode(_bands(low, high, width)))


def _first_band(low: Column, other_low: Column, width: int) -> Column:
    """Whether the band is the first that two intervals have in common: there a pair counts, and in no other."""
    return F.col("_band") == F.floor(F.greatest(low, other_low) / width)


def match_blocks_to_cells(blocks: DataFrame, cells: DataFrame, key: str = "page_id", band: int = 64) -> DataFrame:
    """(page_id, block_id, text, cell_id, iou): for each block its cell of the largest IoU; ties by corner distance, then the first cell.

    Both sides are dealt by page and bands of `band` units of height, so a page of very many cells isn't compared in whole;
    a pair counts in the first band that both touch.
    """
    b = blocks.select(key, "block_id", "text", *[F.col(c).alias(f"b_{c}") for c in "ltrb"]).withColumn("_band", F.explode(_bands(F.col("b_t"), F.col("b_b"), band)))
    c = cells.select(key, "cell_id", *CELL).withColumn("_band", F.explode(_bands(F.col("y1"), F.col("y2"), band)))
    first = F.col("_band") == F.floor(F.greatest("b_t", "y1") / band)
    pairs = b.join(c.hint("merge"), [key, "_band"]).filter(first & (overlap_area(block_rect("b_"), cell_rect()) > 0))
    pairs = pairs.withColumn("iou", iou(block_rect("b_"), cell_rect())).withColumn("_d", corner_distance(block_rect("b_"), cell_rect()))
    best = Window.partitionBy(key, "block_id").orderBy(F.desc(F.round("iou", 8)), "_d", "cell_id")
    rows = pairs.filter("iou > 1e-8").withColumn("_at", F.row_number().over(best)).filter("_at = 1")
    return rows.select(key, "block_id", "text", "cell_id", "iou")


def match_cells_to_block(cells: DataFrame, blocks: DataFrame, least: float = 0.1, key: str = "page_id", band: int = 64) -> DataFrame:
    """Cells with `content`: the text of the block of the largest IoU above `least`, the first of equals; else empty.

    Both come together by page in one shuffle and are swept downward; `band` times 16,384 pairs are compared at once.
    """
    kinds = {c: cells.schema[c].dataType.simpleString() for c in cells.columns}
    names, most = [c for c in cells.columns if c != key], band * 16_384
    own = cells.select(key, F.struct(*names).alias("_own"))
    others = blocks.select(key, F.struct("block_id", "text", *"ltrb").alias("_other"))
    lists = own.unionByName(others, allowMissingColumns=True).groupBy(key).agg(F.collect_list("_own").alias("items"), F.collect_list("_other").alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, items = S.flat(batch, "items")
            block_page, found = S.flat(batch, "blocks")
            texts = S.best_covers(*S.in_order(page, items, CELL), *S.in_order(block_page, found, "ltrb"), len(items), S.ids_of(found, "block_id"), least, most)
            content = pc.fill_null(found.field("text").take(pa.array(texts, pa.int64(), mask=texts < 0)), "")
            sides = {key: batch.column(0).take(pa.array(page)), **{n: items.field(n) for n in names}, "content": content}
            yield pa.RecordBatch.from_arrays([sides[c] for c in [*kinds, "content"]], [*kinds, "content"])

    return lists.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in kinds.items()) + ", content string")


def _meeting(a: DataFrame, b: DataFrame, key: str, band: int) -> DataFrame:
    """Pairs of an upper (a_x1, a_x2) and a lower stretch (b_x1, b_x2) whose ends correspond (2 % of the upper's width) or contain one another's, by bands of x."""
    w = F.when(F.col("a_x2") == F.col("a_x1"), 1.0).otherwise((F.col("a_x2") - F.col("a_x1")).cast("double"))

    def inside(x: Column, low: str, high: str) -> Column:
        return (F.col(low) <= x) & (x <= F.col(high))

    def ends_meet(c: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        return (F.abs((x - y) / w) <= 0.02) | inside(y, "a_x1", "a_x2") | inside(x, "b_x1", "b_x2")

    # Ends that meet leave no more than 2 % of the upper line's width between the lines.
    slack = F.abs(w) * 0.02
    a, b = _dealt(a, F.col("a_x1") - slack, F.col("a_x2") + slack, band), _dealt(b, F.col("b_x1"), F.col("b_x2"), band)
    return a.join(b.hint("merge"), [key, "_band"]).filter(_first_band(F.col("a_x1") - slack, F.col("b_x1"), band) & ends_meet("x1") & ends_meet("x2")).drop("_band")


def candidate_cells(hlines: DataFrame, key: str = "page_id", band: int = 256) -> DataFrame:
    """(page_id, x1, x2, y1, y2): pairs of horizontal lines, one above the other, whose ends correspond (2 % of the width) or contain one another's.

    Lines of the same stretch all pair with one another, as that is what the operator returns; `next_candidates` has those that a table needs.
    """
    a = hlines.select(key, *[F.col(c).alias(f"a_{c}") for c in ("x1", "x2", "y1")])
    b = hlines.select(key, *[F.col(c).alias(f"b_{c}") for c in ("x1", "x2", "y1")])
    pairs = _meeting(a, b, key, band).filter("a_y1 < b_y1")
    return pairs.select(key, F.greatest("a_x1", "b_x1").alias("x1"), F.least("a_x2", "b_x2").alias("x2"), F.col("a_y1").alias("y1"), F.col("b_y1").alias("y2"))


def next_candidates(hlines: DataFrame, key: str = "page_id", band: int = 256) -> DataFrame:
    """(page_id, x1, x2, y1, y2): what `dedupe_adjacent` keeps of `candidate_cells`, without making the others.

    Lines are grouped by their ends. Only the distinct stretches of a page are paired; for two that meet, the lines of both are put in one order
    from below, and each upper line has the last lower line passed: its next one. Lines of one stretch give as many candidates as there are lines.
    """
    lines = hlines.select(key, "x1", "x2", F.col("y1").alias("y")).distinct()
    stretches = lines.select(key, "x1", "x2").distinct()
    pairs = _meeting(*(stretches.select(key, *[F.col(c).alias(f"{side}_{c}") for c in ("x1", "x2")]) for side in "ab"), key, band)
    ends = ["a_x1", "a_x2", "b_x1", "b_x2"]
    sides = []
    for side, low in (("a", None), ("b", F.col("y"))):
        own = lines.select(key, F.col("x1").alias(f"{side}_x1"), F.col("x2").alias(f"{side}_x2"), "y")
        sides.append(pairs.join(own.hint("merge"), [key, f"{side}_x1", f"{side}_x2"]).select(key, *ends, "y", F.lit(side).alias("side"), (F.lit(None).cast(lines.schema["y"].dataType) if low is None else low).alias("low")))
    order = Window.partitionBy(key, *ends).orderBy(F.desc("y"), "side").rowsBetween(Window.unboundedPreceding, 0)
    rows = sides[0].unionByName(sides[1]).withColumn("y2", F.last("low", ignorenulls=True).over(order)).filter("side = 'a' and y2 is not null")
    return dedupe_adjacent(rows.select(key, F.greatest("a_x1", "b_x1").alias("x1"), F.least("a_x2", "b_x2").alias("x2"), F.col("y").alias("y1"), "y2"), key)


def dividers(candidates: DataFrame, vlines: DataFrame, key: str = "page_id", band: int = 256) -> DataFrame:
    """(page_id, x1, x2, y1, y2, x): vertical lines near a candidate, in x, that miss hardly any of its height. Dealt by bands of x, in one of which a line lies."""
    v = vlines.select(key, F.col("x1").alias("x"), F.col("y1").alias("v1"), F.col("y2").alias("v2"))
    margin = F.greatest(F.lit(5), ((F.col("x2") - F.col("x1")) * 0.025).cast("int"))
    high = F.col("y2") - F.col("y1")
    allowed = F.greatest(F.lit(5), F.least(F.lit(10), (high * 0.1).cast("int")))
    missing = high - (F.least("y2", "v2") - F.greatest("y1", "v1"))
    near = (F.col("x1") - margin <= F.col("x")) & (F.col("x") <= F.col("x2") + margin)
    c = _dealt(candidates, F.col("x1") - margin, F.col("x2") + margin, band)
    v = v.withColumn("_band", F.floor(F.col("x") / band).cast("int"))
    return c.join(v.hint("merge"), [key, "_band"]).filter(near & (missing <= allowed)).select(key, "x1", "x2", "y1", "y2", "x")


def adjacent_cells(cells: DataFrame, key: str = "page_id", band: int = 256) -> DataFrame:
    """(page_id, a, b), a < b: cells that share more than 5 on one axis and touch (5, or 5 % of the smaller side) on the other.

    Dealt by bands of height, each cell reaching 5 further, so that a page of very many cells is compared in parts.
    """
    reach = F.explode(_bands(F.col("y1") - 5, F.col("y2") + 5, band))
    a = cells.select(key, F.col("cell_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in CELL], F.explode(_bands(F.col("y1") - 5, F.col("y2") + 5, band)).alias("_band"))
    b = cells.select(key, F.col("cell_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in CELL], reach.alias("_band"))

    def shared(lo: str, hi: str) -> Column:
        return F.least(f"a_{hi}", f"b_{hi}") - F.greatest(f"a_{lo}", f"b_{lo}")

    def apart(lo: str, hi: str) -> Column:
        return F.least(*[F.abs(F.col(f"a_{p}") - F.col(f"b_{q}")) for p in (lo, hi) for q in (lo, hi)])

    def allowed(lo: str, hi: str) -> Column:
        return F.least(F.lit(5.0), F.least(F.col(f"a_{hi}") - F.col(f"a_{lo}"), F.col(f"b_{hi}") - F.col(f"b_{lo}")) * 0.05)

    touch = ((shared("y1", "y2") > 5) & (apart("x1", "x2") <= allowed("x1", "x2"))) | ((shared("x1", "x2") > 5) & (apart("y1", "y2") <= allowed("y1", "y2")))
    first = F.col("_band") == F.floor((F.greatest("a_y1", "b_y1") - 5) / band)
    return a.join(b.hint("merge"), [key, "_band"]).filter((F.col("a") < F.col("b")) & first & touch).select(key, "a", "b")


def nearest_delimiter(values: DataFrame, delims: DataFrame, keys: tuple[str, ...], value: str = "v", delim: str = "d") -> DataFrame:
    """(keys, v, d): for each distinct value its nearest delimiter, the smaller of two. Values of keys without delimiters go.

    Values and delimiters are put in one order; a value's delimiters are the last before it and the first after it, so none is
    compared with a value that it isn't next to.
    """
    own = values.select(*keys, F.col(value).alias("_at")).filter("_at is not null").distinct().withColumn("_d", F.lit(None).cast(delims.schema[delim].dataType))
    both = own.unionByName(delims.select(*keys, F.col(delim).alias("_at"), F.col(delim).alias("_d")).filter("_d is not null"))
    up, down = (Window.partitionBy(*keys).orderBy(order, F.col("_d").isNull()).rowsBetween(Window.unboundedPreceding, 0) for order in (F.asc("_at"), F.desc("_at")))
    both = both.withColumn("_before", F.last("_d", ignorenulls=True).over(up)).withColumn("_after", F.last("_d", ignorenulls=True).over(down))
    nearer = F.when(F.col("_after").isNull() | (F.col("_at") - F.col("_before") <= F.col("_after") - F.col("_at")), F.col("_before")).otherwise(F.col("_after"))
    rows = both.filter(F.col("_d").isNull() & (F.col("_before").isNotNull() | F.col("_after").isNotNull()))
    return rows.select(*keys, F.col("_at").alias(value), nearer.alias(delim))


def axis_delimiters(cells: DataFrame, gaps: dict[str, float], key: str = "page_id") -> DataFrame:
    """(page_id, table_id, axis, d): of each cluster of adjacent cells (cell_id, x1, y1, x2, y2), named by its least cell_id, the delimiters of the axes in `gaps`
    (axis to least gap): the rounded mean of each cluster of edges. A page's cells take one shuffle, and no join."""
    kind = cells.schema["cell_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, items = S.flat(batch, "items")
            own, order = S.in_order(page, items, CELL)
            ids = S.cluster_ids(page, own, order, S.ids_of(items, "cell_id"))[order]
            owner, label, table = C.coded(own.page, ids)
            for axis, gap in gaps.items():
                low, high = (own.l, own.r) if axis == "x" else (own.t, own.b)
                whose, d = C.delimiters(np.concatenate([table, table]), np.concatenate([low, high]), 0.1, gap)
                sides = [batch.column(0).take(pa.array(owner[whose])), pa.array(label[whose], items.type.field("cell_id").type), pa.array([axis] * len(d), pa.string()), pa.array(d.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(sides, [key, "table_id", "axis", "d"])

    return S.lists_of(cells, key, ["cell_id", *CELL]).mapInArrow(run, f"`{key}` {cells.schema[key].dataType.simpleString()}, table_id {kind}, axis string, d int")


def slot_cells(cells: DataFrame, keys: tuple[str, ...] = ("page_id", "table_id"), band: int = 1024) -> DataFrame:
    """(keys, row, col, x1, y1, x2, y2): for each slot of the table's grid the cell in it.

    Edges of cells bound the slots, so a cell covers a slot in whole or not at all. A slot has the smallest cell that covers it; else, where the row has cells, a
    filler without width at the edge nearest to the slot; else the slot itself. A table's cells take one shuffle, and no join; `band` times 1,024 pairs are
    held at once. Cells with an unknown edge are left out.
    """
    most = band * 1024
    kinds = [cells.schema[c].dataType.simpleString() for c in CELL]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, items = S.flat(batch, "items")
            own, _ = S.in_order(table, items, CELL)
            slots, boxes = C.slot_cells(own.page, own, batch.num_rows, most)
            head = [batch.column(k).take(pa.array(slots.table)) for k in range(len(keys))]
            sides = [pa.array(side).cast(items.type.field(c).type) for c, side in zip(CELL, boxes[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*head, pa.array(slots.row, pa.int32()), pa.array(slots.col, pa.int32()), *sides], [*keys, "row", "col", *CELL])

    head = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)
    lists = cells.groupBy(*keys).agg(F.collect_set(F.struct(*CELL)).alias("items"))
    return lists.mapInArrow(run, f"{head}, row int, col int, " + ", ".join(f"{c} {kind}" for c, kind in zip(CELL, kinds, strict=True)))


def area_hit_ratio(components: DataFrame, areas: DataFrame, limit: float = 0.25, key: str = "page_id", band: int = 256) -> DataFrame:
    """Components of whose rectangle less than a quarter lies in areas; areas count each. Dealt by bands of height."""
    a = areas.select(key, *[F.col(c).alias(f"a_{c}") for c in "ltrb"])
    pairs = _dealt(components, F.col("t"), F.col("b"), band).join(_dealt(a, F.col("a_t"), F.col("a_b"), band).hint("merge"), [key, "_band"])
    hit = pairs.filter(_first_band(F.col("t"), F.col("a_t"), band)).groupBy(key, "comp_id").agg(F.sum(overlap_area(block_rect(), block_rect("a_"))).alias("_hit"))
    size = (F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))
    return components.join(hit.hint("merge"), [key, "comp_id"], "left").filter(F.coalesce(F.col("_hit"), F.lit(0)) / size < limit).drop("_hit")


def close_components(components: DataFrame, blockers: DataFrame, char_length: Column, key: str = "page_id", band: int = 256) -> DataFrame:
    """(page_id, a, b), a < b: components whose rectangles overlap, or lie within a character of one another and half beside or below.

    Less than a tenth of the stretch between them may be covered by blockers, which count once where they overlap. `components` has the columns that
    `char_length` needs. Both come together by page in one shuffle and are swept downward; `band` times 4,096 pairs are compared at once.
    """
    kind = components.schema["comp_id"].dataType.simpleString()
    most = band * 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, items = S.flat(batch, "items")
            ids = items.field("comp_id")
            for a, b in S.close_runs(batch, most):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(page[a])), ids.take(pa.array(a)), ids.take(pa.array(b))], [key, "a", "b"])

    lists = S.close_lists(components, blockers, char_length, key)
    return lists.mapInArrow(run, f"{key} {components.schema[key].dataType.simpleString()}, a {kind}, b {kind}")


def attach_discarded(kept: DataFrame, discarded: DataFrame, char_length: Column, key: str = "page_id", band: int = 64) -> DataFrame:
    """Discarded components near a kept one: edges within a character in x, half the lower height shared, at most three times as large. Dealt by bands of height."""
    k = kept.withColumn("_c", char_length).select(key, "_c", *[F.col(c).alias(f"k_{c}") for c in "ltrb"])
    d = discarded
    sides = _dealt(d, F.col("t"), F.col("b"), band), _dealt(k, F.col("k_t"), F.col("k_b"), band)
    high, k_high = F.col("b") - F.col("t"), F.col("k_b") - F.col("k_t")
    shared = F.least("b", "k_b") - F.greatest("t", "k_t")
    apart = F.least(*[F.abs(F.col(p) - F.col(q)) for p in ("l", "r") for q in ("k_l", "k_r")])
    near = (shared >= F.least(high, k_high) * 0.5) & (shared > 0) & (apart <= F.col("_c")) & (F.greatest(high, F.col("r") - F.col("l")) <= 3 * F.greatest(k_high, F.col("k_r") - F.col("k_l")))
    ids = sides[0].join(sides[1].hint("merge"), [key, "_band"]).filter(near).select(key, "comp_id").distinct()
    return d.join(ids.hint("merge"), [key, "comp_id"], "left_semi")


def row_separation(boxes: DataFrame, char_length: Column, id_col: str = "comp_id", key: str = "page_id", band: int = 256) -> DataFrame:
    """(page_id, comp_id, sep): the least distance of middles to a lower box that shares more than half a character in x."""
    rows = boxes.withColumn("_half", F.floor(char_length / 2)).withColumn("_mid", (F.col("t") + F.col("b")) / 2)
    a = rows.select(key, id_col, "_half", F.col("_mid").alias("_from"), F.col("l").alias("a_l"), F.col("r").alias("a_r")).withColumn("_band", F.explode(_bands(F.col("a_l"), F.col("a_r"), band)))
    b = rows.select(key, F.col("_mid").alias("_to"), F.col("l").alias("b_l"), F.col("r").alias("b_r")).withColumn("_band", F.explode(_bands(F.col("b_l"), F.col("b_r"), band)))
    below = (F.least("a_r", "b_r") - F.greatest("a_l", "b_l") > F.col("_half")) & (F.col("_to") > F.col("_from"))
    return a.join(b.hint("merge"), [key, "_band"]).filter(below).groupBy(key, id_col).agg(F.min(F.col("_to") - F.col("_from")).alias("sep"))


def pages_with_blocks(pages: DataFrame, results: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Every page, with `blocks` of its result, and an empty list if it has none."""
    joined = pages.drop("blocks").join(results.select(*keys, "blocks"), list(keys), "left")
    kind = results.schema["blocks"].dataType.simpleString()
    return joined.withColumn("blocks", F.coalesce("blocks", F.array().cast(kind)))


def gap_intersection(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, kind, l, r): the stretches common to gaps of both sides (kept), gaps of `b` that meet none (new), gaps of `a` that meet none (removed)."""
    x, y = a.select(*keys, F.col("l").alias("a_l"), F.col("r").alias("a_r")), b.select(*keys, F.col("l").alias("b_l"), F.col("r").alias("b_r"))
    same = reduce(lambda p, q: p & q, [x[k].eqNullSafe(y[k]) for k in keys])
    meet = same & (F.greatest(F.col("a_l"), F.col("b_l")) <= F.least(F.col("a_r"), F.col("b_r")))
    kept = x.join(y, meet).select(*[x[k] for k in keys], F.lit("kept").alias("kind"), F.greatest("a_l", "b_l").alias("l"), F.least("a_r", "b_r").alias("r"))
    new = y.join(x, meet, "left_anti").select(*keys, F.lit("new").alias("kind"), F.col("b_l").alias("l"), F.col("b_r").alias("r"))
    removed = x.join(y, meet, "left_anti").select(*keys, F.lit("removed").alias("kind"), F.col("a_l").alias("l"), F.col("a_r").alias("r"))
    return reduce(DataFrame.unionByName, [kept, new, removed])


def backfill_merged(slots: DataFrame, keys: tuple[str, ...] = ("page_id", "table_id")) -> DataFrame:
    """Slots (row, col, x1, y1, x2, y2, content): an empty content becomes that of the first later row's slot of the same column and box."""
    later = Window.partitionBy(*keys, "col", *CELL).orderBy("row").rowsBetween(1, Window.unboundedFollowing)
    text = F.when(F.col("content") != "", F.col("content"))
    return slots.withColumn("content", F.coalesce(text, F.first(text, ignorenulls=True).over(later), F.lit("")))
