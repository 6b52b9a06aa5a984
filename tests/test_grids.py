"""Grids of tables: placing cells, and tables whose attributes are hostile."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import aggregates as A
from pagewright.operators import pages as P
from pagewright.plans import tables as TB


def place_cells(rows: list[list[tuple[int, int]]]) -> tuple[list[tuple[int, int, int]], int]:
    """(row, idx, col) of each cell, given (colspan, rowspan) by row, at the next free column; and the number of columns.

    There are at most eight columns for every row; cells beyond them have no place.
    """
    limit = 8 * len(rows)
    taken: list[set[int]] = [set() for _ in rows]
    out = []
    for i, row in enumerate(rows):
        at = 0
        for k, (wide, tall) in enumerate(row):
            while at in taken[i]:
                at += 1
            if at >= limit:
                break
            out.append((i, k, at))
            for y in range(i, min(len(rows), i + tall)):
                taken[y].update(range(at, min(limit, at + wide)))
            at += wide if wide > 0 else 1
    return out, max((max(t) + 1 for t in taken if t), default=0)


RAW = "page_id long, row int, idx int, colspan int, rowspan int"


def placed(spark, tables):
    """page -> (places, columns) of tables given as rows of (colspan, rowspan)."""
    rows = [(p, i, k, w, t) for p, table in tables.items() for i, row in enumerate(table) for k, (w, t) in enumerate(row)]
    out: dict[int, tuple[list, int]] = {p: ([], 0) for p in tables}
    for r in P.place_grid(spark.createDataFrame(rows, RAW)).collect():
        out[r.page_id] = (sorted([*out[r.page_id][0], (r.row, r.idx, r.col)]), r.columns)
    return out


def test_place_grid(spark):
    assert placed(spark, {1: [[(1, 2), (2, 1)], [(1, 1), (1, 1)]]})[1] == ([(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 2)], 3)
    assert placed(spark, {1: [[(9, 1), (1, 1)]]})[1] == ([(0, 0, 0)], 8)
    assert placed(spark, {}) == {}


def test_place_grid_of_random_tables(spark):
    draw = random.Random(2)
    spans = [0, 1, 1, 1, 2, 3, 9, -1, 2**31 - 1]
    tables = {p: [[(draw.choice(spans), draw.choice(spans)) for _ in range(draw.randrange(1, 7))] for _ in range(draw.randrange(1, 6))] for p in range(150)}
    want = {}
    for p, table in tables.items():
        places, columns = place_cells([[(min(w, 1_000), min(t, 1_000)) for w, t in row] for row in table])
        want[p] = (sorted(places), columns if places else 0)
    got = placed(spark, tables)
    assert got == {p: (places, columns if places else 0) for p, (places, columns) in want.items()}


GOOD = "<table><tr><td colspan=\"2\">a</td></tr><tr><td>b</td><td rowspan='2'>c</td></tr><tr><td>d</td></tr></table>"
HOSTILE = {
    2: "<table><tr><td rowspan=\"2147483647\">x</td><td>y</td></tr><tr><td>z</td></tr></table>",
    3: "<table><tr><td colspan=\"2147483647\">x</td><td>y</td></tr><tr><td>z</td></tr></table>",
    4: "<table><tr><td colspan='2147483647' rowspan='2147483647'>x</td></tr></table>",
    5: "no table at all",
    6: "<table></table>",
    7: None,
    8: "<table><tr><td colspan='99999999999999' rowspan='-3'>x</td></tr></table>",
    9: "<table>" + "<tr><td>k</td></tr>" * 2_500 + "<tr>" + "<td colspan='9999'>w</td>" * 3 + "</tr></table>",
}


@pytest.fixture
def tables(spark):
    return spark.createDataFrame([(1, GOOD), *HOSTILE.items()], "page_id long, html string")


def test_hostile_spans_end_with_the_table(tables):
    grid = TB.html_to_grid(tables)
    rows = {p: [] for p in range(1, 10)}
    for r in grid.collect():
        rows[r.page_id].append((r.row, r.col, r.rowspan, r.colspan, r.text))
    assert sorted(rows[1]) == [(0, 0, 1, 2, "a"), (1, 0, 1, 1, "b"), (1, 1, 2, 1, "c"), (2, 0, 1, 1, "d")]
    assert sorted(rows[2]) == [(0, 0, 2, 1, "x"), (0, 1, 1, 1, "y"), (1, 1, 1, 1, "z")]
    assert (0, 0, 1, 16, "x") in rows[3] and rows[4] == [(0, 0, 1, 8, "x")]
    assert rows[5] == rows[6] == rows[7] == []
    slots = {(r.page_id, r.row, r.col): (r.text, r.anchor_row, r.anchor_col) for r in TB.grid_slots(grid).collect()}
    assert slots[2, 1, 0] == ("", 0, 0) and slots[1, 2, 1] == ("", 1, 1) and max(c for p, _, c in slots if p == 4) == 7
    hostile = grid.filter("page_id = 2").withColumns({"rowspan": F.lit(2**31 - 1), "colspan": F.lit(2**31 - 1)})
    assert TB.grid_slots(hostile).count() < 200
    raw = TB.parse_html_table(tables)
    assert {(r.page_id, r.row): r.before for r in A.max_effective_columns(raw).filter("page_id = 2").collect()} == {(2, 0): 0, (2, 1): 1}


def test_padding_of_hostile_tables(tables):
    padded = {r.page_id: r.html for r in TB.pad_rows(tables.filter("html is not null")).collect()}
    assert padded[1] == GOOD and padded[5] == HOSTILE[5]
    assert padded[3].count("&nbsp;") == TB.MAX_COLSPAN and padded[2].count("&nbsp;") == 0


def test_a_bad_table_is_a_record_beside_good_ones(tables):
    records = {r.page_id: r for r in TB.grid_records(tables).collect()}
    assert sorted(records) == list(range(1, 10))
    good = records[1]
    assert (good.code, good.msg, good.rows, good.columns, len(good.cells)) == (0, None, 3, 2, 4) and good.cells[0].text == "a"
    assert {p: records[p].msg for p in (5, 6, 7)} == {5: "no table", 6: "no cells", 7: "no table"} and all(records[p].code == 1 and records[p].cells is None for p in (5, 6, 7))
    assert records[9].code == 1 and "columns" in records[9].msg and records[2].code == records[3].code == records[4].code == 0
    plan = TB.grid_records(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
