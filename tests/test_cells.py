"""Steps on cells over arrays against plain second versions, and what they shuffle."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import aggregates as A
from pagewright.operators import cells as C
from pagewright.operators import filters as FL
from pagewright.operators import joins as J
from pagewright.operators import pages as P
from pagewright.operators import sweeps as S
from pagewright.operators import windows as W
from pagewright.plans import metrics as M
from pagewright.plans import tables as TB
from pagewright.queries import all_queries

SF = "/root/testdata/sf0.001"
TABLES = "page_id long, table_id int, x1 int, y1 int, x2 int, y2 int"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def some_cells(seed, pages=12, most=14, least=0):
    rng, rows = random.Random(seed), []
    for p in range(pages):
        step = rng.choice([3, 10, 30])
        for i in range(rng.randrange(1, most)):
            x, y = rng.randrange(-3, 8) * step, rng.randrange(-3, 8) * step
            rows.append((p, i % 2, x, y, x + rng.randrange(least, 5) * step, y + rng.randrange(least, 5) * step))
    return rows


def plain_slots(boxes):
    ys, xs = sorted({v for b in boxes for v in (b[1], b[3])}), sorted({v for b in boxes for v in (b[0], b[2])})
    for row, (top, low) in enumerate(zip(ys, ys[1:], strict=False)):
        own = [b for b in boxes if b[1] <= top and low <= b[3]]
        for col, (left, right) in enumerate(zip(xs, xs[1:], strict=False)):
            inside = [((b[2] - b[0]) * (b[3] - b[1]), b) for b in own if b[0] <= left and right <= b[2]]
            near = [(min(abs(e - left), abs(e - right)), b, e) for b in own for e in (b[0], b[2])]
            yield row, col, *(min(inside)[1] if inside else (min(near)[2], top, min(near)[2], low) if near else (left, top, right, low))


@pytest.mark.parametrize("band", [1, 1024])
def test_slots_take_the_smallest_cell_a_filler_or_their_own_box(spark, band):
    rows = some_cells(5)
    got = sorted(map(tuple, J.slot_cells(spark.createDataFrame([*rows, *rows, (0, 0, None, 1, 2, 3)], TABLES), band=band).collect()))
    tables = sorted({r[:2] for r in rows})
    assert got == sorted((*t, *s) for t in tables for s in plain_slots([r[2:] for r in rows if r[:2] == t]))


def test_a_row_between_cells_keeps_its_own_box(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (1, 0, 0, 30, 10, 40)], TABLES)
    assert [tuple(r)[2:] for r in J.slot_cells(cells).orderBy("row").collect()] == [(0, 0, 0, 0, 10, 10), (1, 0, 0, 10, 10, 30), (2, 0, 0, 30, 10, 40)]


@pytest.mark.parametrize("name", ["jon_07_slot_cells", "pag_08_dedupe_cells", "agg_14_axis_delimiters"])
def test_steps_on_cells_shuffle_the_orders_keys_and_no_more(spark, name):
    said = plan(all_queries()[name].run(spark, SF))
    assert "Join" not in said and said.count("Exchange hashpartitioning") == said.count("REPARTITION_BY_NUM")


@pytest.mark.parametrize("most", [1, 300, 1 << 20])
def test_cells_of_all_pages_at_once_are_kept_as_one_by_one(most):
    for seed in range(20):
        rows = sorted(((p, *box) for p, _, *box in some_cells(seed, 5, 40)), key=lambda r: (r[0], r[2]))
        rects = S.Rects(*(np.array(side, float if k else int) for k, side in enumerate(zip(*rows, strict=True))))
        alone = []
        got = sorted(rows[i] for i in C.deduped(rects.page, rects, lambda boxes: alone.append(1) or P.dedupe_boxes(boxes), most))
        assert got == sorted((p, *c) for p in range(5) for c in P.dedupe_boxes([r[1:] for r in rows if r[0] == p]))
        assert bool(alone) == (most == 1) or most == 300


def test_kept_cells_are_numbered_and_unknown_edges_left_out(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, 20, 20), (1, 0, 0, 0, 10, 20), (1, 0, 10, 0, 20, 20), (1, 0, None, 0, 5, 5), (2, 0, 5, 5, 9, 9)], TABLES)
    assert sorted(map(tuple, P.dedupe_cells(cells).collect())) == [(1, 0, 0, 0, 10, 20), (1, 1, 10, 0, 20, 20), (2, 0, 5, 5, 9, 9)]


def test_delimiters_of_clusters_are_means_of_near_edges(spark):
    cells = spark.createDataFrame([(1, 4, 0, 0, 50, 20), (1, 5, 51, 0, 100, 20), (1, 7, 0, 20, 50, 40), (1, 9, 500, 500, 520, 520)], "page_id long, cell_id int, x1 int, y1 int, x2 int, y2 int")
    rows = sorted(map(tuple, J.axis_delimiters(cells, {"x": 8.0, "y": 4.0}).collect()))
    assert rows == [(1, 4, "x", d) for d in (0, 51, 100)] + [(1, 4, "y", d) for d in (0, 20, 40)] + [(1, 9, a, d) for a in "xy" for d in (500, 520)]


@pytest.mark.parametrize("gap", [2.0, 9.0])
def test_delimiters_and_nearest_ones_are_those_of_the_windows(spark, gap):
    rows = [(p, v) for p, _, *box in some_cells(8) for v in box]
    frame = spark.createDataFrame(rows, "page_id long, v int")
    clusters = W.cluster_values(frame, "v", 0.1, gap, ("page_id",)).groupBy("page_id", "cluster").agg(F.round(F.avg("v")).cast("int").alias("d"))
    table, values = (np.array(side) for side in zip(*rows, strict=True))
    owner, d = C.delimiters(table, values.astype(float), 0.1, gap)
    assert sorted(zip(owner, d, strict=True)) == sorted((r.page_id, r.d) for r in clusters.collect())
    want = {(r.page_id, r.v): r.d for r in J.nearest_delimiter(frame, clusters, ("page_id",)).collect()}
    assert dict(zip(rows, C.nearest(table, values.astype(float), owner, d), strict=True)) == want


def some_lines(seed, pages=40):
    """Ruled tables with lines that jut out, are cut short or lie a little aside."""
    rng, rows = random.Random(seed), []
    for p in range(pages):
        step, n, m = rng.choice([12, 40]), rng.randrange(2, 6), rng.randrange(2, 6)
        aside = lambda: rng.choice([0, 0, 0, 1, -1, 3])
        for flat, k in [(True, k) for k in range(n + 1)] + [(False, k) for k in range(m + 1)]:
            long = m if flat else n
            a, b = (0, long) if rng.random() < 0.7 else sorted(rng.sample(range(long + 1), 2))
            at, ends = k * step + aside(), (a * step + aside(), b * step + aside())
            rows.append((p, ends[0], at, ends[1], at) if flat else (p, at, ends[0], at, ends[1]))
    return rows


def test_cells_between_lines_are_those_of_the_joins(spark):
    rows = some_lines(4)
    lines = spark.createDataFrame(rows, "page_id long, x1 int, y1 int, x2 int, y2 int")
    straight = FL.straight_lines(lines)
    want = W.cells_from_dividers(J.dividers(J.next_candidates(straight.filter("orient = 'h'")), straight.filter("orient = 'v'"))).filter("x1 < x2")
    for most in (1, 1 << 20):
        got = C.between_lines(S.Rects(*(np.array(side, float if k else int) for k, side in enumerate(zip(*sorted(rows, key=lambda r: (r[0], r[2])), strict=True)))), most)
        assert {tuple(map(int, r)) for r in zip(*got, strict=True)} == {(r.page_id, r.x1, r.y1, r.x2, r.y2) for r in want.collect()} and len(got.t)


def test_tables_of_a_valid_shape_are_those_of_the_filter(spark):
    rows = sorted(some_cells(21, pages=200, most=9, least=1), key=lambda r: r[0])
    cells = S.Rects(*(np.array(side, float if k else int) for k, side in enumerate(zip(*[(r[0], *r[2:]) for r in rows], strict=True))))
    slots, boxes = C.slot_cells(cells.page, cells, 200)
    frame = spark.createDataFrame([tuple(map(int, r)) for r in zip(slots.table, slots.row, slots.col, *boxes[1:], strict=True)], "page_id long, row int, col int, x1 int, y1 int, x2 int, y2 int")
    want = {r.page_id for r in FL.valid_tables(frame, ("page_id",)).select("page_id").distinct().collect()}
    for most in (1, 1 << 20):
        assert set(np.flatnonzero(C.valid(slots, boxes, most)).tolist()) == want
    assert 0 < len(want) < 200


def test_ruled_tables_take_one_grouping_and_write_nothing(spark):
    said = plan(all_queries()["tab_01_bordered_tables"].run(spark, SF))
    assert "Join" not in said and said.count("Exchange hashpartitioning") == said.count("REPARTITION_BY_NUM") and said.count("MapInArrow") == 1 and "pagewright-" not in said


def test_page_metrics_are_those_of_the_joins(spark):
    rng, rows, bars = random.Random(9), [], []
    for p in range(60):
        for r in range(rng.randrange(1, 6)):
            x = 10
            for _ in range(rng.randrange(1, 12)):
                w, h = rng.choice([8, 10, 10, 12, 40, 3]), rng.choice([12, 14, 14, 5, 30])
                x, y = x + w + rng.choice([2, 4, 15, 40]), 20 + r * rng.choice([22, 30]) + rng.randrange(3)
                rows.append((p, len(rows), x - w, y, x, y + h, rng.choice([w * h // 2, w * h, w * h // 20, 3])))
                if rng.random() < 0.1:
                    bars.append((p, x, y, x + rng.randrange(0, 8), y + rng.randrange(0, 20)))
        rows += [(p, len(rows) + k, *((20 + 9 * k, 5, 26 + 9 * k, 7) if p % 2 else (5, 20 + 9 * k, 7, 26 + 9 * k)), 12) for k in range(rng.randrange(3, 9))]
    comps = spark.createDataFrame(rows, "page_id long, comp_id int, l int, t int, r int, b int, area int")
    inked = comps.filter("area > 5")
    sized = FL.component_size(FL.component_shape(J.area_hit_ratio(inked, A.dotted_line_areas(inked))))
    kept, left = sized.filter("kept"), sized.filter("not kept")
    chars = A.page_char_length(kept)
    kept = kept.join(chars, "page_id")
    both = kept.unionByName(J.attach_discarded(kept, left, F.col("char_length")).join(chars, "page_id")).withColumn("cell_id", F.col("comp_id"))
    blockers = spark.createDataFrame(bars, "page_id long, l int, t int, r int, b int")
    labelled = A.table_clusters(both, J.close_components(both, blockers, F.col("char_length"))).withColumnRenamed("table_id", "label")
    boxes = A.component_boxes(labelled)
    seps = A.mode_row_separation(J.row_separation(boxes.join(chars, "page_id"), F.col("char_length"), "label"))
    counted = boxes.groupBy("page_id").agg(F.count("*").alias("boxes")).join(chars, "page_id").join(seps, "page_id", "left")
    want = {r.page_id: (round(r.char_length, 6), r.line_sep or 0, r.boxes) for r in counted.collect()}
    assert {r.page_id: (round(r.char_length, 6), r.line_sep, r.boxes) for r in M.page_metrics(comps, blockers).collect()} == want and len(want) > 50


def test_page_metrics_take_one_grouping_and_write_nothing(spark):
    said = plan(all_queries()["tab_04_page_metrics"].run(spark, SF))
    assert "Join" not in said and said.count("Exchange hashpartitioning") == said.count("REPARTITION_BY_NUM") <= 3 and "pagewright-" not in said


def test_structured_tables_are_those_of_their_steps(spark):
    rng, tokens, blocks = random.Random(2), [], []
    for p in range(60):
        said = [("sos", None)] * (p % 2) + rng.choice([[], [("<thead>", None)], [("eos", None)], [(None, None)]])
        for r in range(rng.randrange(0, 5)):
            said.append((rng.choice(["<tr>", " <tr> "]), None))
            for c in range(rng.randrange(0, 5)):
                box = (c * 40 + rng.randrange(3), r * 20, c * 40 + rng.choice([38, 78]), r * 20 + rng.choice([18, 38])) if rng.random() < 0.9 else None
                spans = rng.choice([None, [' colspan="2"'], [' colspan="1"', ' rowspan="3"'], [' rowspan="99999999999"']])
                said += [("<td", box), *((x, None) for x in spans), (">", None), ("</td>", None)] if spans else [(rng.choice(["<td></td>", "<td>", " <td></td>"]), box)]
            said.append(("</tr>", None))
        said += [("eos", None), ("<td></td>", (0, 0, 10, 10))] * (rng.random() < 0.7)
        tokens += [(p, t, token, rng.choice([0.5, 0.9, None]), *(box or (None,) * 4)) for t, (token, box) in enumerate(said)]
        for i in range(rng.randrange(0, 12) if p % 7 else 0):
            x, y = rng.randrange(-5, 160), rng.randrange(-25, 90)
            blocks.append((p, 100 - i, rng.choice([f"a{i}", "b", None, ""]), x, y, x + rng.choice([0, 20, 45]), y + rng.choice([10, 25])))
    toks = spark.createDataFrame(tokens, "page_id long, t int, token string, score double, x1 int, y1 int, x2 int, y2 int")
    texts = spark.createDataFrame(blocks, "page_id long, block_id int, text string, l int, t int, r int, b int")
    plain, cells = TB.decode_structure(toks), TB.structure_cells(toks)
    full = plain.join(cells.select("page_id").distinct(), "page_id", "left_semi").join(texts.select("page_id").distinct(), "page_id", "left_semi")
    filled = TB.fill_placeholders(full, cells, A.cell_texts(J.match_blocks_to_cells(FL.below_table_top(texts, cells), cells)))
    sized = {r.page_id: r.html for r in TB.size_rows(TB.pad_rows(filled), cells).collect()}
    want = {r.page_id: (sized.get(r.page_id) or r.html, r.structure_score and round(r.structure_score, 9)) for r in plain.collect()}
    got = {r.page_id: (r.html, r.structure_score and round(r.structure_score, 9)) for r in TB.structured_tables(toks, texts).collect()}
    assert got == want and len({h for h, _ in got.values() if "colgroup" in h}) > 20


def test_structured_tables_take_one_grouping_and_write_nothing(spark):
    said = plan(all_queries()["tab_02_structured_tables"].run(spark, SF))
    assert "Join" not in said and said.count("Exchange hashpartitioning") == said.count("REPARTITION_BY_NUM") and "pagewright-" not in said


def test_rows_are_padded_and_sized_by_plain_functions_of_one_table(spark):
    """Lambdas over arrays of tags took most of the time."""
    tables = spark.createDataFrame([(1, "<table><tr><td colspan='x2'></td><td COLSPAN=3></td></tr><tr></tr><tr><td></td></tr></table>"), (2, "<table></table>"), (3, None)], "page_id long, html string")
    padded = TB.pad_rows(tables)
    cells = spark.createDataFrame([(1, 0, 0, 10), (1, 2, None, 40), (2, 0, 0, 5)], "page_id long, cell_id int, y1 int, y2 int")
    sized = {r.page_id: r.html for r in TB.size_rows(padded, cells).collect()}
    assert "lambdafunction" not in plan(padded) + plan(TB.size_rows(padded, cells))
    assert sized[2] is None and sized[3] is None
    assert sized[1].count("<col style='width:25.00%'>") == 4 and sized[1].count("height:100.00%") == 1 and sized[1].count("height:0.00%") == 2
    assert sized[1].endswith("<tr style='height:0.00%'><td></td>" + "<td>&nbsp;</td>" * 3 + "</tr></table>")
