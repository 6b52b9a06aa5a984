"""Derived tables and what tables share cost one shuffle, of keys or of the given rows, and no more."""

from __future__ import annotations

import pytest

from pagewright.operators import filters as FL
from pagewright.queries import all_queries
from pagewright.sources import derived as D

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["html_tables", "tokens", "grid_cells", "ruled_lines"])
def test_derived_tables_shuffle_once_for_each_reading_of_the_orders(spark, name):
    said = plan(getattr(D, name)(spark, SF))
    assert said.count("Exchange hashpartitioning") == said.count("FileScan") <= 2
    assert name == "html_tables" or "Sort [" not in said  # only html_tables reads values, which need an order
    assert "Join" not in said


def test_overlap_shuffles_nothing_but_the_orders_keys(spark):
    said = plan(all_queries()["agg_09_pair_overlap"].run(spark, SF))
    assert said.count("Exchange hashpartitioning") == said.count("REPARTITION_BY_NUM")
    assert "Join" not in said


def test_valid_tables_send_no_table_to_the_driver(spark):
    cells = D.grid_cells(spark, SF).selectExpr("page_id", "0 as table_id", "r as row", "c as col", "x1", "y1", "x2", "y2")
    assert "BroadcastExchange" not in plan(FL.valid_tables(cells))


@pytest.mark.parametrize("name", ["pag_13_fill_placeholders", "jon_01_blocks_to_cells", "jon_02_cells_to_block", "jon_05_adjacent_cells", "agg_12_table_clusters", "pag_15_size_rows"])
def test_joins_by_page_send_no_table_to_the_driver(spark, name):
    assert "BroadcastExchange" not in plan(all_queries()[name].run(spark, SF))


@pytest.mark.parametrize("name", ["tokens", "grid_cells", "grid_blocks", "ruled_lines"])
def test_partitions_grow_with_the_rows_of_the_orders(spark, monkeypatch, name):
    few = getattr(D, name)(spark, SF)
    monkeypatch.setattr(D, "ROWS_A_PARTITION", 500)
    many = getattr(D, name)(spark, SF)
    parts = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500)
    assert f", {parts}), REPARTITION_BY_NUM" in plan(many) and f", {parts})" not in plan(few)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
