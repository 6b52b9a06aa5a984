"""HTML tables read in Arrow batches against the columns of the same rules, documents of tables against a plain second version, and what they shuffle."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import sets as ST
from pagewright.plans import tables as TB
from pagewright.queries import all_queries

SF = "/root/testdata/sf0.001"
ATTRIBUTES = (" colspan=2", " COLSPAN='3'", ' colspan = "x2"', ' rowspan="2"', " rowspan= 3", " rowspan=99999999999", " colspan='+2abc'", " colspan='0000000000002'", " colspan='9'", " style='width: 30px; height:20px'", ' style="WIDTH:50px"', ' style="height: 12.5%"', " style='height: 40 %'", " style=width:90px", " style='height:1.2.3%'")
BODIES = ("a", " b \n", "&amp;lt;", "x&nbsp;y", "&#65;&#x42;&#38;#67;", "&#200;&#xFFFF;&#;&#x;", "é<b>x</b>", "", "&lt;&gt;&quot;&apos;&#39;", "&#6A;", "&#0000000000065;")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def some_html(rng: random.Random, zero: tuple[str, ...] = ()) -> str:
    def td():
        attributes = "".join(rng.choice((*ATTRIBUTES, *zero)) for _ in range(rng.choice([0, 0, 1, 3])))
        return rng.choice(["<td", "<TD"]) + attributes + ">" + rng.choice(BODIES) + rng.choice(["</td>", "</TD>", "</td>"])

    out = rng.choice(["", "<div style='aspect-ratio: 4 / 3'>"]) + rng.choice(["<table>", "<TABLE border=1>"])
    if rng.random() < 0.4:
        cols = ("<col style='width:25%'>", "<col width=3>", '<col style="width: 10.5%">', "<COL style='width:5%'>", "<col style='width:0%'>")
        out += "<colgroup>" + "".join(rng.choice(cols) for _ in range(rng.randrange(0, 5))) + rng.choice(["</colgroup>", "</COLGROUP>", ""])
    for _ in range(rng.randrange(0, 5)):
        out += rng.choice(["<tr>", "<TR>", "<tr style='height:33.3%'>", "<tr class=x>"]) + "".join(td() for _ in range(rng.randrange(0, 5))) + rng.choice(["</tr>", "</TR>", ""])
    return out + rng.choice(["</table>", "</table>", ""]) + rng.choice(["", "<table><tr><td>second</td></tr></table>"])


def html_frame(spark, seed, pages=300, zero=()):
    rng = random.Random(seed)
    return spark.createDataFrame([(p, some_html(rng, zero)) for p in range(pages)] + [(pages, None), (pages + 1, "")], "page_id long, html string")


def test_cells_of_tables_are_those_of_the_columns(spark):
    tables = html_frame(spark, 3, zero=(" colspan=0", " rowspan=0", " colspan=-1"))
    want = TB.placed_cells(tables).filter("col is not null").select("page_id", "row", "col", "text", "colspan")
    got = TB.table_cells(tables).select("page_id", F.inline("cells"))
    assert got.count() == want.count() > 400 and want.exceptAll(got).isEmpty()


def plain_union(tables):
    """[(doc, kind, table_no, row, col, text, colspan, out_row)] of (doc, table_no, title, cells)."""
    out = []
    for doc in {t[0] for t in tables}:
        own = [t for t in tables if t[0] == doc]
        heads = {}
        for _, no, _, cells in own:
            for row, _, _, wide in cells or ():
                if row == 0:
                    heads.setdefault(no, []).append(wide)
        first = heads[min(heads, key=lambda n: (n is not None, n or 0))] if heads else []
        width = sum(w for w in first if w is not None) if any(w is not None for w in first) else 8
        rows = [("title", no, -1, 0, title, width) for _, no, title, _ in own if title is not None]
        rows += [("cell", no, *c) for _, no, _, cells in own for c in cells or () if c[0] is not None]
        places = {k: i for i, k in enumerate(sorted({r[1:3] for r in rows}, key=lambda k: (k[0] is not None, k[0] or 0, k[1])))}
        out += [(doc, *r, places[r[1:3]]) for r in rows]
    return out


def test_documents_of_random_tables(spark):
    rng = random.Random(4)
    cell = lambda: (rng.choice([0, 0, 1, 2, 5, None]), rng.randrange(3), rng.choice(["a", "", None]), rng.choice([1, 2, None]))
    tables = [(rng.randrange(40), rng.choice([None, *range(6)]), rng.choice([None, "T", ""]), rng.choice([None, [cell() for _ in range(rng.randrange(6))]])) for _ in range(200)]
    frame = spark.createDataFrame(tables, "doc_id long, table_no long, title string, cells array<struct<row: int, col: int, text: string, colspan: int>>")
    got = ST.union_tables_with_titles(frame)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_union(tables)))
    assert ST.union_tables_with_titles(frame.filter("doc_id < 0")).isEmpty()


def test_documents_of_tables_take_one_grouping_and_no_join(spark):
    said = plan(all_queries()["set_02_union_tables"].run(spark, SF))
    assert "Join" not in said and said.count("Exchange hashpartitioning") == said.count("REPARTITION_BY_NUM") + 1


def test_grids_are_those_of_the_columns(spark):
    tables = html_frame(spark, 5)
    cells = TB.placed_cells(tables).cache()
    widths, heights = TB.grid_sizes(cells, cells, tables)
    span = lambda name, room: F.greatest(F.least(name, room), F.lit(1)).alias(name)
    want = cells.filter("col is not null").join(widths, ["page_id", "col"]).join(heights, ["page_id", "row"])
    sizes = [F.round(c, 9).alias(c) for c in ("width", "height")]
    want = want.select("page_id", "row", "col", span("rowspan", F.col("n") - F.col("row")), span("colspan", F.col("columns") - F.col("col")), "text", *sizes)
    got = TB.html_to_grid(tables)
    assert got.count() == want.count() > 500 and want.exceptAll(got.select("page_id", "row", "col", "rowspan", "colspan", "text", *sizes)).isEmpty()
    assert got.select("width").distinct().count() > 10 < got.select("height").distinct().count()
    slots = TB.grid_slots(TB.html_to_grid(tables, sized=True))
    assert slots.count() > 500 and slots.exceptAll(TB.grid_slots(got)).isEmpty()


def test_columns_narrower_than_a_pixel_are_even(spark):
    """They were a division by nought, which ended the whole job."""
    rows = TB.html_to_grid(spark.createDataFrame([(1, "<table><tr><td colspan=8 style='width:5px'>a</td></tr></table>")], "page_id long, html string")).collect()
    assert [(r.col, r.colspan, r.text, r.width, r.height) for r in rows] == [(0, 8, "a", 10.0, 16.0)]


@pytest.mark.parametrize("name", ["tab_03_html_to_grid", "snk_04_grid_slots"])
def test_grids_shuffle_and_write_nothing_but_the_orders(spark, name):
    said = plan(all_queries()[name].run(spark, SF))
    assert "Join" not in said and said.count("Exchange hashpartitioning") == said.count("REPARTITION_BY_NUM") == 1 and "pagewright-" not in said
