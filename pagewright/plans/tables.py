"""Tables: from ruled lines, from structure tokens, and from HTML to grids."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagewright.functions import html as H
from pagewright.functions.geometry import snap_line
from pagewright.operators import aggregates as A
from pagewright.operators import cells as C
from pagewright.operators import filters as FL
from pagewright.operators import grids as G
from pagewright.operators import joins as J
from pagewright.operators import pages as P
from pagewright.operators import sweeps as S

TABLE = ("page_id", "table_id")
STYLE = "<table style='table-layout:fixed;width:100%'>"


@lru_cache(4096)
def _percent(share: float) -> str:
    """Two decimals, halves up, as `format_string` writes them."""
    return str(Decimal(repr(share)).quantize(Decimal("0.01"), ROUND_HALF_UP))


def _html_of(slots: list[tuple]) -> str:
    """The HTML of one table's slots (row, col, x1, y1, x2, y2, content)."""
    slots = sorted(slots, key=lambda s: s[:6])
    rows: dict[int, list[tuple]] = {}
    contents: dict[tuple[int, int], list[str]] = {}
    for row, col, *box, content in slots:
        rows.setdefault(row, []).append(tuple(box))
        contents.setdefault((row, col), []).append(content or "&nbsp;")
    tds: dict[int, list[tuple[int, str]]] = {}
    for row, col, tall, wide in P.spans_of(list(rows.values())):
        span = f' rowspan="{tall}"' * (tall > 1) + f' colspan="{wide}"' * (wide > 1)
        tds.setdefault(row, []).extend((col, f"    <td{span}>{text}</td>\n") for text in contents.get((row, col), ()))
    xs = sorted({x for boxes in rows.values() for b in boxes for x in (b[0], b[2])})
    ends = {row: (min(b[1] for b in boxes), max(b[3] for b in boxes)) for row, boxes in rows.items()}
    high = max(max(b for _, b in ends.values()) - min(a for a, _ in ends.values()), 1)
    out = [STYLE + "\n"]
    if len(xs) > 1:
        cols = (f"    <col style='width:{_percent((b - a) / (xs[-1] - xs[0]) * 100.0)}%'>\n" for a, b in zip(xs, xs[1:], strict=False))
        out += ["  <colgroup>\n", *cols, "  </colgroup>\n"]
    for row, (a, b) in ends.items():
        out += [f"  <tr style='height:{_percent((b - a) / high * 100.0)}%'>\n", *(td for _, td in sorted(tds.get(row, ()))), "  </tr>\n"]
    return "".join([*out, "</table>\n"])


def table_html(slots: DataFrame, keys: tuple[str, ...] = TABLE) -> DataFrame:
    """(keys, html) of slots (row, col, x1, y1, x2, y2, content): widths and heights in percent, spans, and no empty cells. One grouping by table, and no join."""
    names = ("row", "col", *J.CELL, "content")
    tables = slots.groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            ends = pc.list_value_length(lists).to_numpy().cumsum().tolist()
            rows = list(zip(*(lists.flatten().field(n).to_pylist() for n in names), strict=True))
            htmls = [_html_of(rows[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array(htmls, pa.string())], [*keys, "html"])

    return tables.mapInArrow(run, ", ".join(f"{k} {slots.schema[k].dataType.simpleString()}" for k in keys) + ", html string")


class Bordered(NamedTuple):
    """The valid tables of a batch: of each its page (place in the batch) and least cell; of each slot its table, place, box and text."""

    page: np.ndarray
    label: np.ndarray
    table: np.ndarray
    row: np.ndarray
    col: np.ndarray
    box: list[np.ndarray]
    content: pa.Array


def _bordered(batch: pa.RecordBatch, char_length: float) -> Bordered:
    """From the lines and blocks of each page to its tables: cells, clusters of them, edges on delimiters, slots, texts."""
    lines, _ = S.in_order(*S.flat(batch, "items"), J.CELL)
    cells = C.between_lines(lines)
    cells = cells.at(C.deduped(cells.page, cells, P.dedupe_boxes))
    cells = cells.at(np.lexsort((cells.r, cells.b, cells.l, cells.t, cells.page)))
    labels = S.cluster_ids(cells.page, cells, np.arange(len(cells.t)), C.places(cells.page))
    page, label, table = C.coded(cells.page, labels)
    big = np.flatnonzero(np.bincount(table, minlength=len(page))[table] >= 2)
    cells, table = cells.at(big), table[big]
    sides = {}
    for axis, (low, high), gap in (("x", (cells.l, cells.r), char_length), ("y", (cells.t, cells.b), 0.5 * char_length)):
        delims = C.delimiters(np.concatenate([table, table]), np.concatenate([low, high]), 0.1, gap)
        sides[axis] = [C.nearest(table, side, *delims) for side in (low, high)]
    (x1, x2), (y1, y2) = sides["x"], sides["y"]
    solid = np.flatnonzero((x2 > x1) & (y2 > y1))
    slots, boxes = C.slot_cells(table[solid], S.Rects(*(side[solid] for side in (table, x1, y1, x2, y2))), len(page))
    kept = np.flatnonzero(C.valid(slots, boxes)[slots.table])
    block_page, found = S.flat(batch, "blocks")
    own = S.Rects(page[slots.table[kept]], *(side[kept] for side in boxes[1:]))
    order = np.lexsort((own.t, own.page))
    texts = np.full(len(slots.table), -1)
    texts[kept] = S.best_covers(own.at(order), order, *S.in_order(block_page, found, "ltrb"), len(kept), S.ids_of(found, "block_id"), 0.1)
    empty = pc.equal(pc.fill_null(found.field("text"), ""), "").to_numpy(zero_copy_only=False)
    texts[np.flatnonzero(texts >= 0)[empty[texts[texts >= 0]]]] = -1
    texts = C.backfilled(slots, boxes, texts)[kept]
    content = pc.fill_null(found.field("text").take(pa.array(texts, pa.int64(), mask=texts < 0)), "")
    return Bordered(page, label, slots.table[kept], slots.row[kept], slots.col[kept], [side[kept].astype(np.int32) for side in boxes[1:]], content)


def _with_blocks(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_id, items, blocks): the snapped lines that are straight and the blocks of each page, in one grouping."""
    snapped = lines.select("page_id", *[c.alias(n) for c, n in zip(snap_line(*(F.col(c) for c in J.CELL)), J.CELL, strict=True)])
    own = FL.straight_lines(snapped).select("page_id", F.struct(*J.CELL).alias("_own"))
    others = blocks.select("page_id", F.struct("block_id", "text", *"ltrb").alias("_other"))
    return own.unionByName(others, allowMissingColumns=True).groupBy("page_id").agg(F.collect_list("_own").alias("items"), F.collect_list("_other").alias("blocks"))


def bordered_slots(lines: DataFrame, blocks: DataFrame, char_length: float = 8.0) -> DataFrame:
    """(page_id, table_id, row, col, x1, y1, x2, y2, content) of every valid table between ruled lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _bordered(batch, char_length)
            sides = [batch.column(0).take(pa.array(b.page[b.table])), *(pa.array(side.astype(np.int32)) for side in (b.label[b.table], b.row, b.col, *b.box)), b.content]
            yield pa.RecordBatch.from_arrays(sides, [*TABLE, "row", "col", *J.CELL, "content"])

    key = lines.schema["page_id"].dataType.simpleString()
    return _with_blocks(lines, blocks).mapInArrow(run, f"page_id {key}, table_id int, row int, col int, x1 int, y1 int, x2 int, y2 int, content string")


def bordered_tables(lines: DataFrame, blocks: DataFrame, char_length: float = 8.0) -> DataFrame:
    """(page_id, table_id, html): tables from ruled lines (page_id, x1, y1, x2, y2) and text blocks (page_id, block_id, text, l, t, r, b).

    A page's lines and blocks come together in one grouping; a batch of pages goes from lines to HTML without a further shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _bordered(batch, char_length)
            starts = C.firsts(b.table)
            rows = list(zip(b.row.tolist(), b.col.tolist(), *(side.tolist() for side in b.box), b.content.to_pylist(), strict=True))
            ends = [*starts[1:].tolist(), len(rows)]
            tables = b.table[starts]
            htmls = [_html_of(rows[i:j]) for i, j in zip(starts.tolist(), ends, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(b.page[tables])), pa.array(b.label[tables].astype(np.int32)), pa.array(htmls, pa.string())], [*TABLE, "html"])

    key = lines.schema["page_id"].dataType.simpleString()
    return _with_blocks(lines, blocks).mapInArrow(run, f"page_id {key}, table_id int, html string")


# ---- structure tokens ----

CELL_TOKENS = ("<td", "<td>", "<td></td>")


def before_end(tokens: DataFrame, end: str = "eos", start: str = "sos") -> DataFrame:
    """The tokens before the first end token that isn't the first token; start tokens go."""
    order = Window.partitionBy("page_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    over = F.max(F.when((F.col("token") == end) & (F.col("t") > 0), 1).otherwise(0)).over(order)
    return tokens.withColumn("_over", over).filter((F.col("_over") == 0) & ~F.col("token").isin(start, end)).drop("_over")


def decode_structure(tokens: DataFrame) -> DataFrame:
    """(page_id, html, structure_score): the tokens as HTML with one `<td></td>` for every cell; attributes are left out."""
    own = before_end(tokens).withColumn("token", F.regexp_replace("token", r"\s", ""))
    before = Window.partitionBy("page_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    opened, closed = F.max(F.when(F.col("token") == "<td", F.col("t"))).over(before), F.max(F.when(F.col("token") == ">", F.col("t"))).over(before)
    inside = opened.isNotNull() & (closed.isNull() | (opened > closed))
    own = own.withColumn("_inside", inside)
    orphan = F.col("token").isin(">", "", "</td>") | F.col("token").contains('colspan="') | F.col("token").contains('rowspan="')
    piece = F.when(F.col("token").isin(*CELL_TOKENS), "<td></td>").when(F.col("_inside") | orphan, "").otherwise(F.col("token"))
    return own.groupBy("page_id").agg(
        F.concat(F.lit("<table>"), A.ordered_concat("t", piece), F.lit("</table>")).alias("html"), F.avg("score").alias("structure_score")
    )


def structure_cells(tokens: DataFrame) -> DataFrame:
    """(page_id, cell_id, x1, y1, x2, y2, colspan, rowspan): cells numbered in token order; spans come from the three tokens after an open `<td`."""
    own = before_end(tokens)
    order = Window.partitionBy("page_id").orderBy("t")
    near = F.concat(*[F.coalesce(F.lead("token", k).over(order), F.lit("")) for k in (1, 2, 3)])
    cells = own.withColumn("_near", near).filter(F.trim("token").isin(*CELL_TOKENS))

    def span(name: str) -> Column:
        value = F.regexp_extract("_near", rf'{name}="(\d+)"', 1).try_cast("int")
        return F.when(F.trim("token") == "<td", F.coalesce(value, F.lit(1))).otherwise(1).alias(name)

    return cells.select("page_id", (F.row_number().over(order) - 1).alias("cell_id"), *J.CELL, span("colspan"), span("rowspan"))


def fill_placeholders(structures: DataFrame, cells: DataFrame, texts: DataFrame) -> DataFrame:
    """(page_id, html): the k-th placeholder with the k-th cell's spans and text; placeholders beyond the cells stay."""
    full = cells.join(texts.hint("merge"), ["page_id", "cell_id"], "left")
    span = F.concat(*[F.when(F.col(c) > 1, F.format_string(f" {c}='%d'", c)).otherwise("") for c in ("colspan", "rowspan")])
    td = F.concat(F.lit("<td"), span, F.lit(">"), F.coalesce("text", F.lit("")), F.lit("</td>"))
    lists = full.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_id", td.alias("td")))), lambda c: c["td"]).alias("tds"))
    rows = structures.join(lists.hint("merge"), "page_id", "left").withColumn("parts", F.split("html", "<td></td>"))
    tds = F.coalesce("tds", F.array().cast("array<string>"))
    glued = F.transform("parts", lambda p, i: F.concat(p, F.when(i == F.size("parts") - 1, "").otherwise(F.coalesce(F.get(tds, i), F.lit("<td></td>")))))
    return rows.select("page_id", F.array_join(glued, "").alias("html"))


#: Wider and taller cells count as these, as in the HTML standard.
MAX_COLSPAN, MAX_ROWSPAN = 1_000, 65_534
#: A table with more columns is an error record: no spreadsheet holds it.
MAX_COLUMNS = 16_384


TD = re.compile("<td[^>]*>")
ATTRIBUTE = {name: re.compile(rf"""{name}[ =]*('[^']*|"[^"]*|[^\s'">][^\s>]*)""", re.I | re.A) for name in ("colspan", "rowspan")}
DIGITS = re.compile(r"['\"]?\s*([+-]?\d+)", re.A)


@lru_cache(4096)
def _span(tag: str, name: str) -> int:
    """The leading digits of an attribute, 1 if there are none: `html.int_attr` of one text."""
    value = ATTRIBUTE[name].search(tag)
    digits = DIGITS.match(value[1]) if value else None
    return n if digits and -(1 << 31) <= (n := int(digits[1])) < 1 << 31 else 1


@lru_cache(4096)
def _spans(tag: str) -> tuple[int, int]:
    """(colspan, rowspan) of a `<td ...>` tag."""
    return min(_span(tag, "colspan"), MAX_COLSPAN), min(_span(tag, "rowspan"), MAX_ROWSPAN)


def _spans_by_row(pieces: list[str]) -> list[list[tuple[int, int]]]:
    """The spans of the cell tags before each `</tr>`; what follows the last row end is no row."""
    return [[_spans(tag) for tag in TD.findall(piece)] for piece in pieces[:-1]]


def _padded(html: str) -> str:
    pieces = html.split("</tr>")
    rows = _spans_by_row(pieces)
    tall = [(i, wide, i + high) for i, row in enumerate(rows) for wide, high in row if high > 1]
    totals = [sum(wide for wide, _ in row) + sum(wide for a, wide, b in tall if a < i < b) if row else None for i, row in enumerate(rows)]
    most = max((n for n in totals if n is not None), default=0)
    return "</tr>".join([*(p if n is None else p + "<td>&nbsp;</td>" * (most - n) for p, n in zip(pieces, totals, strict=False)), pieces[-1]])


def _sized(html: str, cells: Iterable[tuple[int, int | None, int | None]]) -> str | None:
    pieces = html.split("</tr>")
    rows = _spans_by_row(pieces)
    columns = max((sum(wide for wide, _ in row) for row in rows if row), default=0)
    if not columns:
        return None
    tops: dict[int, list[int]] = {}
    lows: dict[int, list[int]] = {}
    for at, y1, y2 in cells:
        for known, y in ((tops, y1), (lows, y2)):
            if y is not None:
                known.setdefault(at, []).append(y)
    heights, first = [], 0
    for row in rows:
        top, low = ([y for k in range(first, first + len(row)) for y in known.get(k, ())] for known in (tops, lows))
        heights.append(float(max(low) - min(top)) if top and low else 0.0)
        first += len(row)
    whole = sum(heights)
    styles = (f"<tr style='height:{_percent(h / whole * 100.0 if whole else 0.0)}%'>" for h in heights)
    body = "</tr>".join([*(p.replace("<tr>", style) for p, style in zip(pieces, styles, strict=False)), pieces[-1]])
    return f"{STYLE}\n  <colgroup>\n" + f"    <col style='width:{_percent(100.0 / columns)}%'>\n" * columns + "  </colgroup>\n" + body[len("<table>") :]


def pad_rows(tables: DataFrame) -> DataFrame:
    """(page_id, html): short rows filled with empty cells up to the table's columns; spans from above count, rows without cells stay.

    Each table is changed within its own row: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls = [None if html is None else _padded(html) for html in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(htmls, pa.string())], ["page_id", "html"])

    return tables.select("page_id", "html").mapInArrow(run, f"page_id {tables.schema['page_id'].dataType.simpleString()}, html string")


def size_rows(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """(page_id, html): even column widths, and row heights in percent from the cells that are dealt to the rows by their tags.

    A table without any cell tag gets a null. One grouping of the cells by page; the rest is within each table's row.
    """
    lists = cells.groupBy("page_id").agg(F.collect_list(F.struct("cell_id", "y1", "y2")).alias("items"))
    rows = tables.join(lists.hint("merge"), "page_id", "left").select("page_id", "html", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, items = S.flat(batch, "items")
            own = list(zip(*(items.field(n).to_pylist() for n in ("cell_id", "y1", "y2")), strict=True))
            ends = np.searchsorted(page, np.arange(batch.num_rows + 1)).tolist()
            htmls = [None if html is None else _sized(html, own[a:b]) for html, a, b in zip(batch.column(1).to_pylist(), ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(htmls, pa.string())], ["page_id", "html"])

    return rows.mapInArrow(run, f"page_id {tables.schema['page_id'].dataType.simpleString()}, html string")


class Structure(NamedTuple):
    """The structure tokens of a batch, in order: of each page that has some its place in the batch, HTML and score; and the cells of all pages."""

    pages: np.ndarray
    htmls: list[str]
    scores: np.ndarray
    cells: S.Rects
    ids: np.ndarray
    spans: list[tuple[int, int]]


def _structures(page: np.ndarray, tokens: pa.StructArray, start: str = "sos", end: str = "eos") -> Structure:
    """`decode_structure` and `structure_cells` over arrays."""
    t = S.numbers(tokens, "t")
    order = np.lexsort((t, page))
    page, t = page[order], t[order]
    coded = tokens.field("token").dictionary_encode()
    words = [*coded.dictionary.to_pylist(), None]
    code = coded.indices.fill_null(len(words) - 1).to_numpy(zero_copy_only=False)[order]
    has = lambda test: np.array([w is not None and test(w) for w in words])[code]
    over = np.cumsum(has(lambda w: w == end) & (t > 0))
    first = np.searchsorted(page, page, "left")
    own = np.flatnonzero((over == np.where(first > 0, over[first - 1], 0)) & has(lambda w: w not in (start, end)))
    page, code, order = page[own], code[own], order[own]

    plain = [None if w is None else re.sub(r"\s", "", w, flags=re.A) for w in words]
    named = lambda test: np.array([w is not None and test(w) for w in plain])[code]
    first, at = np.searchsorted(page, page, "left"), np.arange(len(page))
    opened, closed = (np.append(-1, np.maximum.accumulate(np.where(named(lambda w, s=sign: w == s), at, -1))[:-1])[: len(at)] for sign in ("<td", ">"))
    inside = (opened >= first) & (opened > closed)
    orphan = lambda w: w in (">", "", "</td>") or 'colspan="' in w or 'rowspan="' in w
    silent = ~named(lambda w: w in CELL_TOKENS) & (inside | named(orphan))
    said = np.array(["<td></td>" if w in CELL_TOKENS else w for w in plain], object)[code]
    said[silent] = ""
    starts = C.firsts(page)
    ends, pieces = [*starts[1:].tolist(), len(page)], said.tolist()
    htmls = ["<table>" + "".join(pieces[a:b]) + "</table>" for a, b in zip(starts.tolist(), ends, strict=False)]
    score = S.numbers(tokens, "score")[order]
    known, place = ~np.isnan(score), np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(page))))
    with np.errstate(invalid="ignore"):
        scores = np.bincount(place[known], weights=score[known], minlength=len(starts)) / np.bincount(place[known], minlength=len(starts))

    cell = np.flatnonzero(has_cell := np.array([w is not None and w.strip(" ") in CELL_TOKENS for w in words])[code])
    spans = [(1, 1)] * len(cell)
    last = np.searchsorted(page, page, "right")
    for k in np.flatnonzero(np.array([w is not None and w.strip(" ") == "<td" for w in words])[code[cell]]).tolist():
        i = cell[k]
        near = "".join(words[c] for c in code[i + 1 : min(i + 4, last[i])])
        found = (re.search(rf'{name}="(\d+)"', near, re.A) for name in ("colspan", "rowspan"))
        spans[k] = tuple(int(n[1]) if n and int(n[1]) < 1 << 31 else 1 for n in found)
    rects = S.Rects(page[has_cell], *(S.numbers(tokens, n)[order[cell]] for n in J.CELL))
    return Structure(page[starts], htmls, scores, rects, C.places(rects.page), spans)


def _texts_of(cells: S.Rects, ids: np.ndarray, page: np.ndarray, blocks: pa.StructArray, below_top: bool) -> dict[int, str]:
    """Of each cell (by its place) the texts of the blocks whose best cell it is, in block order: `match_blocks_to_cells` and `cell_texts` over arrays.
    If `below_top`, blocks above a page's topmost cell are left out."""
    own, at = S.in_order(page, blocks, "ltrb")
    if below_top:
        top = np.full(int(max(cells.page.max(initial=-1), page.max(initial=-1))) + 1, np.nan)
        np.fmin.at(top, cells.page, cells.t)
        low = np.flatnonzero(own.b >= top[own.page])
        own, at = own.at(low), at[low]
    known = np.flatnonzero(~np.isnan(cells.l + cells.t + cells.r + cells.b))
    known = known[np.lexsort((cells.t[known], cells.page[known]))]
    best = np.full(len(at), -1)
    for i, k in S.meeting(own, cells.at(known)):
        k = known[k]
        a, b = own.at(i), cells.at(k)
        common = (np.minimum(a.r, b.r) - np.maximum(a.l, b.l)) * (np.minimum(a.b, b.b) - np.maximum(a.t, b.t))
        iou = common / ((a.r - a.l) * (a.b - a.t) + (b.r - b.l) * (b.b - b.t) - common + 1e-8)
        near, far = np.abs(a.l - b.l) + np.abs(a.t - b.t), np.abs(a.r - b.r) + np.abs(a.b - b.b)
        good = np.flatnonzero(iou > 1e-8)
        good = good[np.lexsort((ids[k[good]], (near + far + np.minimum(near, far))[good], -np.round(iou[good], 8), i[good]))]
        good = good[C.firsts(i[good])]
        best[i[good]] = k[good]
    found = np.flatnonzero(best >= 0)
    found = found[np.lexsort((S.ids_of(blocks, "block_id")[at[found]], best[found]))]
    texts: dict[int, list[str]] = {}
    for k, text in zip(best[found].tolist(), blocks.field("text").take(pa.array(at[found])).to_pylist(), strict=True):
        texts.setdefault(k, []).extend([] if text is None else [text])
    return {k: " ".join(words) for k, words in texts.items()}


class Filled(NamedTuple):
    """The structures of a batch with their cells' texts in them; where each one's cells begin and end, and whether its page has blocks."""

    structure: Structure
    htmls: list[str]
    first: list[int]
    last: list[int]
    blocked: list[bool]


def _filled(batch: pa.RecordBatch, below_top: bool) -> Filled:
    s = _structures(*S.flat(batch, "items"))
    block_page, found = S.flat(batch, "blocks")
    texts = _texts_of(s.cells, s.ids, block_page, found, below_top)
    first, last = (np.searchsorted(s.cells.page, s.pages, side).tolist() for side in ("left", "right"))
    htmls = []
    for html, a, b in zip(s.htmls, first, last, strict=True):
        parts = html.split("<td></td>")
        tds = [_td(*s.spans[k], texts.get(k, "")) for k in range(a, b)][: len(parts) - 1]
        tds += ["<td></td>"] * (len(parts) - 1 - len(tds))
        htmls.append("".join(x for pair in zip(parts, [*tds, ""], strict=True) for x in pair))
    blocked = np.bincount(block_page, minlength=batch.num_rows)[s.pages] > 0
    return Filled(s, htmls, first, last, blocked.tolist())


def _tokens_with_blocks(tokens: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_id, items, blocks): the tokens and the blocks of each page, in one grouping."""
    own = tokens.select("page_id", F.struct("t", "token", F.col("score").cast("double").alias("score"), *J.CELL).alias("_own"))
    others = blocks.select("page_id", F.struct("block_id", "text", *"ltrb").alias("_other"))
    both = own.unionByName(others, allowMissingColumns=True)
    return both.groupBy("page_id").agg(F.collect_list("_own").alias("items"), F.collect_list("_other").alias("blocks"))


def filled_structures(tokens: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_id, html): each page's structure with its cells' spans and texts; placeholders beyond the cells stay.

    `fill_placeholders` of `decode_structure`, `structure_cells` and the texts of the blocks matched to them, over arrays: tokens and blocks come together by
    page in one grouping, and nothing is joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filled = _filled(batch, below_top=False)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(filled.structure.pages)), pa.array(filled.htmls, pa.string())], ["page_id", "html"])

    return _tokens_with_blocks(tokens, blocks).mapInArrow(run, f"page_id {tokens.schema['page_id'].dataType.simpleString()}, html string")


def structured_tables(tokens: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_id, html, structure_score): tables from structure tokens (page_id, t, token, score, box) and text blocks.

    Blocks above the table are left out, each other goes to its best cell. Pages without cells or without blocks keep
    their bare structure. Tokens and blocks come together by page in one grouping, and nothing is joined or written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, fulls, first, last, blocked = _filled(batch, below_top=True)
            tops, lows = ([None if y != y else y for y in side.tolist()] for side in (s.cells.t, s.cells.b))
            htmls = []
            for html, full, a, b, has_blocks in zip(s.htmls, fulls, first, last, blocked, strict=True):
                sized = _sized(_padded(full), ((k, tops[a + k], lows[a + k]) for k in range(b - a))) if a < b and has_blocks else None
                htmls.append(html if sized is None else sized)
            scores = pa.array(s.scores, pa.float64(), mask=np.isnan(s.scores))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(s.pages)), pa.array(htmls, pa.string()), scores], ["page_id", "html", "structure_score"])

    return _tokens_with_blocks(tokens, blocks).mapInArrow(run, f"page_id {tokens.schema['page_id'].dataType.simpleString()}, html string, structure_score double")


def _td(wide: int, tall: int, text: str) -> str:
    return "<td" + (f" colspan='{wide}'" if wide > 1 else "") + (f" rowspan='{tall}'" if tall > 1 else "") + f">{text}</td>"


# ---- HTML to grids ----


def _with_rows(tables: DataFrame, key: str) -> DataFrame:
    """(key, rows): of the first table its rows with cells, as array<struct<tag, tds: array<struct<tag, body>>>>, within the table's own row."""
    trs = F.transform(H.tag_pairs(H.first_table(F.col("html")), "tr"), lambda t: F.struct(t["tag"].alias("tag"), H.tag_pairs(t["body"], "td").alias("tds")))
    return tables.select(key, F.filter(trs, lambda t: F.size(t["tds"]) > 0).alias("rows"))


def _read_cell(td: Column, row_tag: Column) -> list[Column]:
    """What a cell's tag, body and row say: colspan, rowspan, text, and sizes."""
    tag, plain = td["tag"], F.lower(td["tag"]) == "<td>"  # most cells have no attributes to search, and most texts no entities
    style = H.html_attr(tag, "style")
    row_pct = F.when(F.lower(row_tag) == "<tr>", 0.0).otherwise(H.style_pct(row_tag, "height"))
    body = F.regexp_replace(td["body"], r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    unless = lambda none, value: F.when(plain, none).otherwise(value)
    return [
        unless(1, H.int_attr(tag, "colspan", 1)).alias("colspan"),
        unless(1, H.int_attr(tag, "rowspan", 1)).alias("rowspan"),
        F.when(F.contains(body, F.lit("&")), H.html_unescape(body)).otherwise(body).alias("text"),
        unless(0, H.style_px(style, "width")).alias("width_px"),
        unless(0, H.style_px(style, "height")).alias("height_px"),
        unless(0.0, H.style_pct(style, "width")).alias("width_pct"),
        F.when(row_pct > 0, row_pct).otherwise(unless(0.0, H.style_pct(style, "height"))).alias("height_pct"),
    ]


def parse_html_table(tables: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, row, idx, colspan, rowspan, text, width_px, height_px, width_pct, height_pct) of the first table's cells; rows without cells don't count. Nothing is shuffled."""
    # Outer, as Spark would else work out the rows once more to leave out tables that have none.
    rows = _with_rows(tables, key).select(key, F.posexplode_outer("rows").alias("row", "tr"))
    rows = rows.select(key, "row", F.col("tr.tag").alias("row_tag"), F.posexplode_outer("tr.tds").alias("idx", "td")).filter("idx is not null")
    return rows.select(key, "row", "idx", *_read_cell(F.col("td"), F.col("row_tag")))


def placed_cells(tables: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, row, idx, col, n, columns, colspan, rowspan, text, ...): the cells of each table, read and placed in its grid of n rows within the table's own row; col is
    null for cells that have no place."""

    def spans(td: Column, i: Column, j: Column) -> Column:
        plain = F.lower(td["tag"]) == "<td>"  # most cells have no attributes to search
        wide, tall = (F.when(plain, 1).otherwise(H.int_attr(td["tag"], name, 1)) for name in ("colspan", "rowspan"))
        return F.struct(i.alias("row"), j.alias("idx"), wide.alias("wide"), tall.alias("tall"))

    rows = _with_rows(tables, key).withColumn("cells", F.flatten(F.transform("rows", lambda r, i: F.transform(r["tds"], lambda td, j: spans(td, i, j)))))
    rows = rows.withColumn("grid", P.grid_of(F.col("cells"), F.size("rows")))
    rows = rows.select(key, "rows", F.size("rows").alias("n"), F.size("grid.free").alias("columns"), F.explode_outer("grid.placed").alias("p")).filter("p is not null")
    tr = F.get("rows", F.col("p.row"))
    rows = rows.select(key, "p.row", "p.idx", "p.col", "n", "columns", tr["tag"].alias("row_tag"), F.get(tr["tds"], F.col("p.idx")).alias("td"))
    return rows.select(key, "row", "idx", "col", "n", "columns", *_read_cell(F.col("td"), F.col("row_tag")))


def grid_sizes(raw: DataFrame, placed: DataFrame, tables: DataFrame, key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """(page_id, col, width) in characters, 80 in all, and (page_id, row, height) in points, 28 a row on average.

    Percentages count if the columns' are complete, and if any row has one; else pixels; else 88 a column, and rows that
    give the table the aspect ratio that its page names, 1.35 if none, 30 at least.
    """
    columns = placed.groupBy(key).agg(F.max("columns").alias("columns"))
    group = F.regexp_extract("html", r"(?is)(<colgroup.*?)</colgroup>", 1)
    pcts = F.filter(F.transform(F.regexp_extract_all(group, F.lit(r"(<col [^>]*>)"), F.lit(1)), lambda c: H.style_pct(c, "width")), lambda p: p > 0)
    ratio = F.regexp_extract("html", r"aspect-ratio *: *([0-9.]+) */ *([0-9.]+)", 2).try_cast("double") / F.nullif(F.regexp_extract("html", r"aspect-ratio *: *([0-9.]+) */ *([0-9.]+)", 1).try_cast("double"), F.lit(0.0))
    page = tables.select(key, pcts.alias("pcts"), F.coalesce(ratio, F.lit(1.35)).alias("aspect")).join(columns.hint("merge"), key)
    page = page.withColumn("by_pct", F.size("pcts") == F.col("columns"))
    wide = raw.withColumn("start", F.coalesce(F.sum("colspan").over(Window.partitionBy(key, "row").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wide = wide.drop("columns").join(columns.hint("merge"), key).filter("width_px > 0 and colspan > 0 and start < columns").select(key, "columns", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + F.col("colspan"), F.col("columns")) - 1)).alias("col"), F.expr("width_px div colspan").alias("px"))
    cols = page.select(key, "pcts", "by_pct", "columns", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("col"))
    cols = cols.join(wide.groupBy(key, "col").agg(F.max("px").alias("px")), [key, "col"], "left")
    own = Window.partitionBy(key)
    cols = cols.withColumn("px", F.when(F.max("px").over(own).isNull(), 88).otherwise(F.coalesce("px", F.lit(0))))
    total = F.sum("px").over(own)
    cols = cols.withColumn("total", total)
    widths = cols.select(key, F.col("col").cast("int").alias("col"), F.when(F.col("by_pct"), F.get("pcts", F.col("col").cast("int")) / 100.0 * 80.0).otherwise(F.col("px") / F.col("total") * 80.0).alias("width"))
    totals = cols.groupBy(key).agg(F.first(F.when(F.col("by_pct"), 0).otherwise(F.col("total"))).alias("total"))
    rows = raw.groupBy(key, "row").agg(F.max("height_pct").alias("pct"), F.max("height_px").alias("px"))
    rows = rows.join(page.select(key, "aspect"), key).join(totals.hint("merge"), key)
    n, any_pct, any_px = F.count("*").over(own), F.max("pct").over(own) > 0, F.max("px").over(own) > 0
    even = F.greatest(F.expr("cast(total * aspect as int)").cast("int") / n, F.lit(30)).cast("int")
    rows = rows.withColumn("px", F.when(any_px, F.col("px")).otherwise(even)).withColumn("n", n).withColumn("any_pct", any_pct)
    least = F.min(F.when(F.col("px") > 0, F.col("px"))).over(own)
    points = F.when(F.col("any_pct"), F.when(F.col("pct") > 0, F.col("pct") / 100.0 * F.col("n") * 28.0).otherwise(28.0)).otherwise(F.col("px") * 16.0 / least)
    return widths, rows.select(key, "row", points.alias("height"))


#: So many cells go to a batch at most, but for one table of more.
CELLS_A_BATCH = 50_000


def _in_pieces(batches: Iterable[pa.RecordBatch], read: Callable[[str | None], list[tuple]]) -> Iterator[tuple[list, list[list[tuple]]]]:
    """The keys and the cells of the tables (key, html) that have any, in pieces of a bounded number of cells."""
    for batch in batches:
        keys, lists, held = [], [], 0
        for key, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own := read(html):
                keys.append(key)
                lists.append(own)
                held += len(own)
            if held >= CELLS_A_BATCH:
                yield keys, lists
                keys, lists, held = [], [], 0
        if keys:
            yield keys, lists


def html_to_grid(tables: DataFrame, key: str = "page_id", sized: bool = False) -> DataFrame:
    """(page_id, row, col, rowspan, colspan, text, width, height): the placed cells of each table's grid; their spans end with the table. If `sized`, also n, the rows
    of the grid that have cells, which `grid_slots` then needn't count.

    Pages without a table or without cells have no rows; `grid_records` tells of them. A table is read, placed and sized (see `grid_sizes`) within its own row, and
    nothing is shuffled or written.
    """
    names = ("row", "col", "rowspan", "colspan", "text", "width", "height", "n")
    kinds = (*(pa.int32(),) * 4, pa.string(), pa.float64(), pa.float64(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, lists in _in_pieces(batches, G.sized):
            repeated = pa.array(keys, kind).take(pa.array(np.repeat(np.arange(len(lists)), [len(own) for own in lists])))
            columns = zip(*(cell for own in lists for cell in own), strict=True)
            yield pa.RecordBatch.from_arrays([repeated, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [key, *names])

    kind = to_arrow_type(tables.schema[key].dataType)
    grid = tables.select(key, "html").mapInArrow(run, f"{key} {tables.schema[key].dataType.simpleString()}, row int, col int, rowspan int, colspan int, text string, width double, height double, n int")
    return grid if sized else grid.drop("n")


def table_cells(tables: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, cells): one row for each table with cells (row, col, text, colspan) that have a place in its grid; the spans are those that the cells name. Nothing is
    shuffled."""

    def read(html: str | None) -> list[tuple]:
        return [(row, col, text, cell.colspan) for row, _, col, cell, text in G.placed(html)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, lists in _in_pieces(batches, read):
            row, col, text, colspan = zip(*(cell for own in lists for cell in own), strict=True)
            cells = pa.StructArray.from_arrays([pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(text, pa.string()), pa.array(colspan, pa.int32())], ["row", "col", "text", "colspan"])
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.ListArray.from_arrays(pa.array(ends), cells)], [key, "cells"])

    kind = to_arrow_type(tables.schema[key].dataType)
    return tables.select(key, "html").mapInArrow(run, f"{key} {tables.schema[key].dataType.simpleString()}, cells array<struct<row: int, col: int, text: string, colspan: int>>")


def _clipped(cells: DataFrame) -> DataFrame:
    return cells.withColumns({"rowspan": within(F.col("rowspan"), F.col("n") - F.col("row")), "colspan": within(F.col("colspan"), F.col("columns") - F.col("col"))})


def within(span: Column, room: Column) -> Column:
    """A span of one place at least and of what room there is at most."""
    return F.greatest(F.least(span, room), F.lit(1)).cast("int")


def grid_records(tables: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, code, msg, rows, columns, cells): one record for each table. Code 0 with the grid's size and its cells in order; or code 1 with what is
    wrong (no table, no cells, more than MAX_COLUMNS columns) and nulls, so that a bad table stops no others."""
    cell = F.struct("row", "col", "rowspan", "colspan", "text")
    grid = _clipped(placed_cells(tables, key).filter("col is not null"))
    grids = grid.groupBy(key).agg(F.max("n").alias("rows"), F.max("columns").alias("columns"), F.array_sort(F.collect_list(cell)).alias("cells"))
    told = tables.select(key, (F.coalesce(H.first_table(F.col("html")), F.lit("")) == "").alias("_none")).join(grids, key, "left")
    msg = F.when(F.col("_none"), "no table").when(F.col("cells").isNull(), "no cells").when(F.col("columns") > MAX_COLUMNS, F.format_string("a table of %d columns", "columns"))
    told = told.withColumn("msg", msg).withColumn("code", F.when(F.col("msg").isNull(), 0).otherwise(1))
    return told.select(key, "code", "msg", *[F.when(F.col("code") == 0, F.col(c)).alias(c) for c in ("rows", "columns", "cells")])


def grid_slots(grid: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, row, col, text, anchor_row, anchor_col): every place of a grid, merged ones with their anchor and an empty text.

    Spans end with the last row, and with eight columns for every row, which is all that a grid has. The rows are counted over the page, unless the grid has their
    number, n.
    """
    n = F.col("n") if "n" in grid.columns else F.max("row").over(Window.partitionBy(key)) + 1
    grid = grid.withColumn("_n", n)
    tall, wide = within(F.col("rowspan"), F.col("_n") - F.col("row")), within(F.col("colspan"), F.greatest(F.col("_n") * 8, F.col("col") + 1) - F.col("col"))
    rows = grid.select(key, F.col("row").alias("anchor_row"), F.col("col").alias("anchor_col"), wide.alias("colspan"), "text", F.explode(F.sequence(F.lit(0), tall - 1)).alias("dy"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("colspan") - 1)).alias("dx"))
    first = (F.col("dy") == 0) & (F.col("dx") == 0)
    return rows.select(key, (F.col("anchor_row") + F.col("dy")).alias("row"), (F.col("anchor_col") + F.col("dx")).alias("col"), F.when(first, F.col("text")).otherwise("").alias("text"), "anchor_row", "anchor_col")
