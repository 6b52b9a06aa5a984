"""Sweeps over arrays against plain second versions, and what they shuffle."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pagewright.operators import aggregates as A
from pagewright.operators import joins as J
from pagewright.operators import sweeps as S
from pagewright.plans import tables as TB
from pagewright.queries import all_queries

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def some_rects(rng, n, pages=3):
    rows = [(rng.randrange(pages), x := rng.randrange(-20, 60), y := rng.randrange(-20, 60), x + rng.randrange(0, 30), y + rng.randrange(0, 30)) for _ in range(n)]
    rows.sort(key=lambda r: (r[0], r[2]))
    return S.Rects(*(np.array(c, float if k else int) for k, c in enumerate(zip(*rows, strict=True))))


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_areas_and_blocked_gaps_are_those_of_every_point(most):
    rng = random.Random(most)
    gaps, covers = some_rects(rng, 40), some_rects(rng, 60)
    gaps = gaps.at(np.flatnonzero((gaps.l < gaps.r) & (gaps.t < gaps.b)))
    covers = covers.at(np.flatnonzero((covers.l < covers.r) & (covers.t < covers.b)))

    def points(r, k):
        return {(x, y) for x in range(int(r.l[k]), int(r.r[k])) for y in range(int(r.t[k]), int(r.b[k]))}

    for share in (0.1, 0.5, 1.0):
        want = [len(points(gaps, g) & set().union(*(points(covers, k) for k in range(len(covers.l)) if covers.page[k] == gaps.page[g]))) >= share * len(points(gaps, g)) for g in range(len(gaps.l))]
        assert S.blocked(gaps, covers, share, most).tolist() == want
    owner = covers.page
    assert S.union_areas(owner, covers, 3, most).tolist() == [len(set().union(*(points(covers, k) for k in np.flatnonzero(owner == p)))) for p in range(3)]


@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_pairs_of_a_sweep_come_in_runs_and_miss_none(most):
    own = some_rects(random.Random(5), 80)
    got = {(int(a), int(b)) for i, j in S.near_pairs(own, np.full(80, 3.0), most) for a, b in zip(i, j, strict=True)}
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if own.page[i] == own.page[j] and own.t[j] <= own.b[i] + 3}
    assert want <= got and all(own.page[i] == own.page[j] for i, j in got)


def test_clusters_of_cells_are_those_of_the_adjacent_pairs(spark):
    rng = random.Random(11)
    rows = [(p, (p << 40) + i, x := rng.randrange(0, 300), y := rng.randrange(-40, 300), x + rng.randrange(1, 60), y + rng.randrange(1, 60)) for p in range(4) for i in range(70)]
    cells = spark.createDataFrame([*rows, (9, 1, None, 0, 5, 5)], "page_id long, cell_id long, x1 int, y1 int, x2 int, y2 int")
    want = {(r.page_id, r.cell_id): r.table_id for r in A.table_clusters(cells, J.adjacent_cells(cells)).collect()}
    got = {(r.page_id, r.cell_id): r.table_id for r in S.adjacent_clusters(cells).collect()}
    assert got == want and 1 < len(set(got.values())) < len(got)


@pytest.mark.parametrize("band", [1, 64])
def test_cells_take_the_text_of_the_block_of_the_largest_iou(spark, band):
    rng = random.Random(3)
    box = lambda: ((x := rng.randrange(-20, 90)), (y := rng.randrange(-20, 90)), x + rng.choice([0, 10, 25]), y + rng.choice([10, 25]))
    cells = [(p, i, *box()) for p in range(3) for i in range(40)] + [(2, 99, None, 0, 5, 5), (8, 0, 0, 0, 5, 5)]
    blocks = [(p, i, f"b{i}" if i % 9 else None, *box()) for p in range(3) for i in range(40)]

    def content(p, x1, y1, x2, y2):
        best = []
        for q, i, text, l, t, r, b in blocks if x1 is not None else ():  # noqa: E741
            w, h = min(r, x2) - max(l, x1), min(b, y2) - max(t, y1)
            if p == q and w > 0 and h > 0 and (iou := w * h / ((r - l) * (b - t) + (x2 - x1) * (y2 - y1) - w * h + 1e-8)) > 0.1:
                best.append((-iou, i, text))
        return (min(best, key=lambda x: x[:2])[2] if best else None) or ""

    frames = spark.createDataFrame(cells, "page_id long, cell_id int, x1 int, y1 int, x2 int, y2 int"), spark.createDataFrame(blocks, "page_id long, block_id int, text string, l int, t int, r int, b int")
    got = {(r.page_id, r.cell_id): r.content for r in J.match_cells_to_block(*frames, band=band).collect()}
    assert got == {(p, i): content(p, *b) for p, i, *b in cells} and len(set(got.values())) > 10


def test_html_percentages_round_halves_up_and_repeated_slots_share_a_span(spark):
    rows = [(1, 0, r, c, 10 * c, 100 * r, 10 * c + 10, 100 * r + 100, "" if c else f"t{r}") for r in range(32) for c in range(2)]
    html = TB.table_html(spark.createDataFrame(rows, "page_id long, table_id int, row int, col int, x1 int, y1 int, x2 int, y2 int, content string")).first().html
    assert html.count("<tr style='height:3.13%'>\n    <td>t") == 32 and html.count("<col style='width:50.00%'>") == 2 and html.count("<td>&nbsp;</td>") == 32


@pytest.mark.parametrize("name", ["agg_12_table_clusters", "jon_09_close_components", "jon_02_cells_to_block", "pag_12_table_html"])
def test_neighbours_take_no_join(spark, name):
    said = plan(all_queries()[name].run(spark, SF))
    assert "Join" not in said
    assert said.count("Exchange hashpartitioning") <= said.count("FileScan") + 1 + (name == "pag_12_table_html")
