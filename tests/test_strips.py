"""Areas, nearest delimiters, next lines and covered cells without pairs, against plain versions that make all pairs."""

from __future__ import annotations

import itertools
import random
import resource
import sys

import pytest
from pyspark.sql import functions as F

from pagewright.operators import filters as FL
from pagewright.operators import joins as J
from pagewright.operators import pages as P
from pagewright.operators import windows as W
from pagewright.operators.strips import covered_area

BOX = "page_id long, table_id int, x1 int, y1 int, x2 int, y2 int"


def boxes(n, seed, wide=60):
    draw = random.Random(seed)
    for k in range(n):
        x, y = draw.randrange(-20, 900), draw.randrange(0, 300)
        yield (k % 3, 0, x, y, x + draw.randrange(0, wide), y + draw.randrange(0, wide))


def common(a, b):
    return max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)


@pytest.mark.parametrize("band", [16, 256])
def test_pair_overlap(spark, band):
    rows = [*boxes(200, 1), (0, 0, -50, -50, 2_000, 2_000), (0, 0, -50, -50, 2_000, 2_000), (7, 0, 1, 1, 2, 2), (8, 0, 0, 0, 2**31 - 1, 1), (8, 0, 5, 0, 9, 2**31 - 1)]
    want = {p: sum(common(a[2:], b[2:]) for a, b in itertools.combinations(sorted({r for r in rows if r[0] == p}), 2)) for p in {r[0] for r in rows}}
    got = FL.pair_overlap(spark.createDataFrame(rows, BOX), band=band)
    assert {r.page_id: r.overlap for r in got.collect()} == want and want[8] == 4
    assert FL.pair_overlap(spark.createDataFrame([], BOX)).collect() == []


def test_pair_overlap_of_one_large_table(spark):
    n = spark.range(50_000)  # 250 columns of 200 cells, each over a third of the next one down
    cells = n.select(F.lit(0).alias("page_id"), F.lit(0).alias("table_id"), (F.col("id") % 250 * 40).cast("int").alias("x1"), F.expr("cast(id div 250 * 20 as int)").alias("y1"))
    cells = cells.withColumns({"x2": F.col("x1") + 40, "y2": F.col("y1") + 30})
    out = FL.pair_overlap(cells)
    assert out.first().overlap == 250 * 199 * 40 * 10
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "page_id" in plan and "Cartesian" not in plan


def test_covered_area_counts_each_point_once(spark):
    draw = random.Random(3)
    rect = lambda wide: (x := draw.randrange(0, 90), y := draw.randrange(0, 60), x + draw.randrange(1, wide), y + draw.randrange(1, wide))
    areas, covers = [(p, k, *rect(40)) for p in (0, 1) for k in range(8)], [(p, *rect(30)) for p in (0, 1, 2) for _ in range(12)]
    covers += covers[:5] + [(0, 3, 3, 3, 9)]
    points = lambda r: {(x, y) for x in range(r[0], r[2]) for y in range(r[1], r[3])}
    want = {}
    for p, k, *r in areas:
        n = len(points(r) & set().union(*(points(c[1:]) for c in covers if c[0] == p)))
        if n:
            want[p, k] = n
    frames = spark.createDataFrame(areas, "page_id long, k int, l int, t int, r int, b int"), spark.createDataFrame(covers, "page_id long, l int, t int, r int, b int")
    for band in (7, 256):
        assert {(r.page_id, r.k): r.covered for r in covered_area(*frames, "page_id", ["k"], band=band).collect()} == want


def test_equal_blockers_block_once(spark):
    comps = spark.createDataFrame([(0, 1, 0, 0, 100, 20), (0, 2, 150, 0, 250, 20)], "page_id long, comp_id int, l int, t int, r int, b int")
    blockers = spark.createDataFrame([(0, 110, 0, 113, 20)] * 2, "page_id long, l int, t int, r int, b int")
    found = lambda o: J.close_components(comps, o, F.lit(60.0)).count()
    assert found(blockers) == 1
    assert found(blockers.unionByName(blockers.withColumns({"l": F.lit(112), "r": F.lit(115)}))) == 0  # five of fifty


def test_nearest_delimiter(spark):
    draw = random.Random(5)
    values, delims = [(k % 4, draw.randrange(0, 200)) for k in range(300)], [(k % 3, draw.randrange(0, 200)) for k in range(40)]
    want = {(k, v, min((abs(v - d), d) for j, d in delims if j == k)[1]) for k, v in values if k < 3}
    got = J.nearest_delimiter(spark.createDataFrame([*values, (0, None)], "k int, v int"), spark.createDataFrame([*delims, (3, None)], "k int, d int"), ("k",))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def lines(rows):
    return [(p, x1, y, x2, y) for p, x1, x2, y in rows]


def test_next_candidates(spark):
    draw = random.Random(9)
    ends = [(0, 400), (0, 402), (8, 392), (100, 400), (0, 200), (300, 700), (500, 500)]
    rows = [(p, *draw.choice(ends), draw.randrange(0, 60)) for p in range(6) for _ in range(40)]
    frame = spark.createDataFrame(lines(rows), "page_id long, x1 int, y1 int, x2 int, y2 int")
    want = sorted(map(tuple, W.dedupe_adjacent(J.candidate_cells(frame)).select("page_id", "x1", "x2", "y1", "y2").collect()))
    for band in (32, 256):
        assert sorted(map(tuple, J.next_candidates(frame, band=band).collect())) == want and want


def test_a_stretch_of_many_lines_gives_as_many_candidates(spark):
    rules = spark.range(20_000).select(F.lit(0).alias("page_id"), F.lit(0).alias("x1"), (F.col("id") * 3).cast("int").alias("y1"), F.lit(500).alias("x2"), (F.col("id") * 3).cast("int").alias("y2"))
    got = J.next_candidates(rules)
    assert got.count() == 19_999 and got.filter("y2 - y1 = 3").count() == 19_999


def raster(cells):
    own = [c for c in sorted(set(cells), key=lambda c: ((c[2] - c[0]) * (c[3] - c[1]), c)) if c[2] > max(0, c[0]) and c[3] > max(0, c[1])]
    covered, kept = set(), []
    for c in own:
        points = {(x, y) for x in range(max(0, c[0]), c[2]) for y in range(max(0, c[1]), c[3])}
        if len(points - covered) >= 0.25 * (c[2] - c[0]) * (c[3] - c[1]):
            kept.append(c)
            covered |= points
    return kept


@pytest.mark.parametrize("seed", range(12))
def test_covered_cells_go(seed):
    draw = random.Random(seed)
    cells = []
    for _ in range(60):
        x, y = draw.randrange(-5, 50), draw.randrange(-5, 50)
        cells.append((x, y, x + draw.randrange(0, 25), y + draw.randrange(0, 12 if seed % 2 else 40)))
    assert P.dedupe_boxes(cells) == raster(cells)


def test_a_page_of_very_many_cells():
    cells = [(40 * i, 20 * j, 40 * i + 40, 20 * j + 20) for i in range(250) for j in range(400)]
    whole = [(0, 0, 10_000, 8_000), (0, 0, 10_000, 4_000)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert P.dedupe_boxes([*cells, *whole]) == sorted(cells)
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * (1 if sys.platform == "linux" else 1 / 1024)
    assert grown < 1_000_000  # KB
