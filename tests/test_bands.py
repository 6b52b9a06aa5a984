"""Joins that are dealt by bands give the rows of one band for all, also for boxes that span many bands or lie below zero."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import joins as J

ONE = 1 << 20


@pytest.fixture(scope="module")
def boxes(spark):
    rng, rows = random.Random(7), []
    for i in range(160):
        x, y = rng.randrange(-60, 200), rng.randrange(-60, 200)
        w, h = rng.choice([(0, 20), (30, 0), (12, 9), (150, 8), (9, 150)])
        rows.append((i % 2, i, x, y, x + w, y + h))
    return spark.createDataFrame(rows, "page_id long, id long, x1 int, y1 int, x2 int, y2 int")


def rects(df, name="comp_id"):
    return df.select("page_id", F.col("id").alias(name), F.col("x1").alias("l"), F.col("y1").alias("t"), F.col("x2").alias("r"), F.col("y2").alias("b"))


def cases(df):
    some, others = df.filter("id % 3 = 0"), df.filter("id % 3 <> 0")
    solid = rects(df.filter("x1 < x2 and y1 < y2"))
    hlines = df.filter("y1 = y2").select("page_id", "x1", "y1", "x2", "y2")
    around = others.filter("x1 < x2 and y1 < y2").select("page_id", "x1", "x2", "y1", "y2")
    return {
        "candidates": lambda band: J.candidate_cells(hlines, band=band),
        "dividers": lambda band: J.dividers(around, df.filter("x1 = x2").select("page_id", "x1", "y1", "x2", "y2"), band=band),
        "slots": lambda band: J.slot_cells(around.filter("x1 > 120").withColumn("table_id", F.lit(0)), band=band),
        "hits": lambda band: J.area_hit_ratio(solid, rects(some), band=band),
        "close": lambda band: J.close_components(solid, rects(others.filter("y2 - y1 < 10")), F.lit(15.0), band=band),
        "attached": lambda band: J.attach_discarded(rects(some), rects(others), F.lit(15.0), band=band),
    }


@pytest.mark.parametrize("name", ["candidates", "dividers", "slots", "hits", "close", "attached"])
def test_bands_change_no_rows(boxes, name):
    run = cases(boxes)[name]
    got = [sorted(map(tuple, run(band).collect())) for band in (16, ONE)]
    assert got[0] == got[1] and got[0]


def test_null_boxes_and_empty_tables(spark, boxes):
    nulls = spark.createDataFrame([(0, 999, None, None, None, None)], boxes.schema)
    for name, run in cases(boxes.unionByName(nulls)).items():
        want = cases(boxes)[name](16)
        assert run(16).filter("true").count() >= want.count(), name
    for run in cases(boxes.limit(0)).values():
        assert run(16).count() == 0


def test_clusters_keep_ids_beyond_32_bits(spark):
    from pagewright.operators.aggregates import table_clusters

    far = 1 << 40
    cells = spark.createDataFrame([(0, far + i) for i in range(4)], "page_id long, cell_id long")
    pairs = spark.createDataFrame([(0, far + 1, far + 2), (0, far + 2, far + 3)], "page_id long, a long, b long")
    got = {r.cell_id - far: r.table_id - far for r in table_clusters(cells, pairs).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1}
