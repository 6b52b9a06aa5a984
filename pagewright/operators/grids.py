"""HTML tables read, placed in a grid and sized: plain functions of one table's text, for Arrow batches.

They follow the same rules as the columns of `functions.html` and `pages.grid_of`, which tests hold them against, at a fraction of their time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from pagewright.functions.html import ENTITIES

FLAGS = re.I | re.A | re.S
TABLE = re.compile("<table.*?</table>", FLAGS)
PAIRS = {name: re.compile(rf"(<{name}[^>]*>)(.*?)(?:</{name}>|\Z)", FLAGS) for name in ("tr", "td")}
ATTRIBUTE = {name: re.compile(rf"""{name}[ =]*('[^']*|"[^"]*|[^\s'">][^\s>]*)""", FLAGS) for name in ("colspan", "rowspan", "style")}
LEADING = re.compile(r"\s*([+-]?\d+)", FLAGS)
PX = {name: re.compile(rf"{name} *: *(\d+)", FLAGS) for name in ("width", "height")}
PCT = {name: re.compile(rf"{name} *: *([0-9.]+)(%?)", FLAGS) for name in ("width", "height")}
COLGROUP, COL = re.compile("(<colgroup.*?)</colgroup>", FLAGS), re.compile("<col [^>]*>")
NUMBERED = re.compile("&#[x]?[0-9A-F]*;", FLAGS)
SPACES = " \t\r\n"


class Cell(NamedTuple):
    """What a cell's tag says."""

    colspan: int
    rowspan: int
    width_px: int
    height_px: int
    height_pct: float


def whole(digits: str) -> int | None:
    """A number of 32 bits, however many digits it is written in; None beyond."""
    plain = digits.lstrip("+-").lstrip("0") or "0"
    n = int(plain) * (-1 if digits[0] == "-" else 1) if len(plain) < 11 else 1 << 31
    return n if -(1 << 31) <= n < 1 << 31 else None


def attribute(tag: str, name: str) -> str:
    found = ATTRIBUTE[name].search(tag)
    value = found[1] if found else ""
    return value[1:] if value[:1] in ("'", '"') else value


def span(tag: str, name: str) -> int:
    found = LEADING.match(attribute(tag, name))
    n = whole(found[1]) if found else None
    return 1 if n is None else n


def px(style: str, name: str) -> int:
    found = PX[name].search(style)
    return (whole(found[1]) or 0) if found else 0


def pct(style: str, name: str) -> float:
    found = PCT[name].search(style)
    if not found or not found[2]:
        return 0.0
    try:
        return float(found[1])
    except ValueError:
        return 0.0


@lru_cache(4096)
def cell_of(tag: str) -> Cell:
    style = attribute(tag, "style")
    return Cell(span(tag, "colspan"), span(tag, "rowspan"), px(style, "width"), px(style, "height"), pct(style, "height"))


@lru_cache(4096)
def row_pct(tag: str) -> float:
    return pct(tag, "height")


def _sign(entity: str) -> str:
    """The character of a numbered entity, if it is ASCII."""
    digits = entity[2:-1]
    if digits[:1] in ("x", "X"):
        plain = digits[1:].lstrip("0")
        code = int(plain, 16) if 0 < len(plain) < 3 else 0
    else:
        plain = re.match("[0-9]*", digits)[0].lstrip("0")
        code = int(plain) if 0 < len(plain) < 4 else 0
    return chr(code) if 0 < code < 128 else ""


def unescaped(text: str) -> str:
    for entity, sign in ENTITIES:
        text = text.replace(entity, sign)
    for entity in dict.fromkeys(NUMBERED.findall(text)):
        text = text.replace(entity, _sign(entity))
    return text.replace("&amp;", "&")


def text_of(body: str) -> str:
    body = body.strip(SPACES)
    return unescaped(body) if "&" in body else body


#: The rows of a table that have cells: each row's tag, and its cells' tags and bodies.
Rows = list[tuple[str, list[tuple[str, str]]]]


def rows_of(html: str | None) -> Rows:
    """The rows of the first table."""
    table = TABLE.search(html) if html else None
    rows = [(tag, PAIRS["td"].findall(body)) for tag, body in PAIRS["tr"].findall(table[0])] if table else []
    return [row for row in rows if row[1]]


def place(rows: list[list[Cell]]) -> tuple[list[list[int | None]], int]:
    """The column of each cell, None if it has none, and the number of columns: see `pages.grid_of`."""
    n = len(rows)
    free: list[int] = []  # from which row on each column is free
    cols: list[list[int | None]] = []
    for i, row in enumerate(rows):
        at, own = 0, []
        for cell in row:
            while at < len(free) and free[at] > i:
                at += 1
            if at >= 8 * n:
                own.append(None)
                continue
            own.append(at)
            wide, tall = min(cell.colspan, 8 * n - at), min(cell.rowspan, n - i)
            if wide > 0 and tall > 0:
                free.extend([0] * (at + wide - len(free)))
                for x in range(at, at + wide):
                    free[x] = max(free[x], i + tall)
            at = min(at + max(cell.colspan, 1), 8 * n)
        cols.append(own)
    return cols, len(free)


def widths(html: str, rows: list[list[Cell]], columns: int) -> list[float]:
    """In characters, 80 in all: by the columns' percentages if they are complete, else by pixels, else even."""
    group = COLGROUP.search(html)
    pcts = [p for p in (pct(c, "width") for c in COL.findall(group[1])) if p > 0] if group else []
    if len(pcts) == columns:
        return [p / 100.0 * 80.0 for p in pcts]
    pixels = [0] * columns
    for row in rows:
        start = 0
        for cell in row:
            if cell.width_px > 0 and cell.colspan > 0:
                for x in range(max(start, 0), min(start + cell.colspan, columns)):
                    pixels[x] = max(pixels[x], cell.width_px // cell.colspan)
            start += cell.colspan
    if not any(pixels):
        pixels = [88] * columns
    total = sum(pixels)
    return [p / total * 80.0 for p in pixels]


def heights(tags: list[str], rows: list[list[Cell]]) -> list[float]:
    """In points: by percentages, 28 a row on average, if any row has one; else by pixels, 16 for the lowest row. Rows of no size are even, whatever the
    table's aspect ratio, so 16 each."""
    pcts = [own if (own := row_pct(tag)) > 0 else max(c.height_pct for c in row) for tag, row in zip(tags, rows, strict=True)]
    if any(p > 0 for p in pcts):
        return [p / 100.0 * len(rows) * 28.0 if p > 0 else 28.0 for p in pcts]
    pixels = [max(c.height_px for c in row) for row in rows]
    least = min((p for p in pixels if p > 0), default=0)
    return [p * 16.0 / least for p in pixels] if least else [16.0] * len(rows)


def placed(html: str | None) -> Iterator[tuple[int, int, int, Cell, str]]:
    """(row, idx, col, cell, text) of the cells that have a place in the first table's grid."""
    rows = rows_of(html)
    cols, _ = place([[cell_of(tag) for tag, _ in tds] for _, tds in rows])
    for i, ((_, tds), own) in enumerate(zip(rows, cols, strict=True)):
        for k, ((tag, body), col) in enumerate(zip(tds, own, strict=True)):
            if col is not None:
                yield i, k, col, cell_of(tag), text_of(body)


def sized(html: str | None) -> list[tuple[int, int, int, int, str, float, float, int]]:
    """(row, col, rowspan, colspan, text, width, height, n) of the cells in the first table's grid, of which n rows have any; spans end with the table."""
    rows = rows_of(html)
    if not rows:
        return []
    cells = [[cell_of(tag) for tag, _ in tds] for _, tds in rows]
    cols, columns = place(cells)
    wide, high = widths(html, cells, columns), heights([tag for tag, _ in rows], cells)
    n = len(rows)
    out = []
    last = 1 + max((i for i, own in enumerate(cols) if any(col is not None and col < columns for col in own)), default=0)
    for i, ((_, tds), own, said) in enumerate(zip(rows, cols, cells, strict=True)):
        for (_, body), col, cell in zip(tds, own, said, strict=True):
            if col is not None and col < columns:
                out.append((i, col, max(min(cell.rowspan, n - i), 1), max(min(cell.colspan, columns - col), 1), text_of(body), wide[col], high[i], last))
    return out
