"""Lines as columns against the same rules over one page's list."""

from __future__ import annotations

import random

import pytest

from pagewright.operators import pages as P
from pagewright.plans import layout as L

BLOCKS = "doc_id long, page int, block_id int, text string, score double, box array<int>, angle int, angle_score double, `end` string"


def pages(seed):
    """Pages of random blocks: one of them dense, one with many equal tops and lefts, one with a single block."""
    rng = random.Random(seed)
    rows = []
    for page, (n, x, y) in enumerate([(70, 900, 600), (50, 400, 60), (40, 8, 8), (1, 10, 10), (60, 2000, 40)]):
        for i in range(n):
            l, t, w, h = rng.randrange(x), rng.randrange(y), rng.randrange(5, 200), rng.randrange(8, 30)  # noqa: E741
            text = rng.choice(["word", "中文", "well-", ", b", "Über", "x", "1"])
            rows.append((1, page, i, text, rng.random(), [l, t, l + w, t, l + w, t + h, l, t + h], 0, 0.0, "\n"))
    return rows


@pytest.mark.parametrize("strategy", sorted(L.STRATEGIES))
def test_columns_give_what_lists_give(spark, strategy):
    blocks = spark.createDataFrame(pages(3), BLOCKS)
    ready = P.preprocess(blocks)
    if strategy == "single_vertical":
        ready = P.preprocess(P.turn_pages(ready).drop("l", "t", "r", "b", "seq"))
    slow = P.by_page(P.page_lists(ready), L.STRATEGIES[strategy])
    own, other = (sorted(map(tuple, df.select(slow.columns).collect()), key=lambda r: r[:3]) for df in (L.layout(blocks, strategy), slow))
    assert len(own) == len(other) > 0
    for a, b in zip(own, other, strict=True):
        assert a[:6] + a[7:] == b[:6] + b[7:]
        assert a[6] == pytest.approx(b[6])


@pytest.mark.parametrize("strategy", sorted(L.IN_COLUMNS))
def test_no_python_in_the_plan_and_one_exchange(spark, strategy):
    plan = L.layout(spark.createDataFrame(pages(4), BLOCKS), strategy)._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "Python" not in plan
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("strategy", sorted(L.IN_REGIONS))
def test_columns_of_text_take_one_exchange_and_hand_numbers_to_python(spark, strategy):
    plan = L.layout(spark.createDataFrame(pages(4), BLOCKS), strategy)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("ArrowEvalPython") == 1 and "InArrow" not in plan


@pytest.mark.parametrize("strategy", sorted({*L.IN_COLUMNS, *L.IN_REGIONS} - {"single_vertical"}))
def test_page_without_a_place_is_one_error_and_empty_tables_stay_empty(spark, strategy):
    rows = [r for r in pages(5) if r[1] in (0, 3)] + [(1, 9, 0, "x", 0.5, None, 0, 0.0, "\n"), (1, 9, 1, "y", 0.5, [0, 0, 9, 0, 9, 9, 0, 9], 0, 0.0, "\n")]
    out = L.layout(spark.createDataFrame(rows, BLOCKS), strategy)
    assert [tuple(r) for r in out.filter("page = 9").select("seq", "code", "msg").collect()] == [(0, 1, "a block has no place")]
    assert out.filter("page <> 9 and code = 0").count() > 2
    assert L.layout(spark.createDataFrame([], BLOCKS), strategy).count() == 0
