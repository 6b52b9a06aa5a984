"""Hand-worked pages for the rules within a page or a table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import pages as P
from pagewright.operators import regions as R
from pagewright.operators.pages import Block
from pagewright.plans import layout as L


def block(x, y, w, h=20, text="word", i=0):
    return Block(float(x), float(y), float(x + w), float(y + h), text, i, 0.5, (x, y, x + w, y, x + w, y + h, x, y + h))


def ids(placed):
    return [b.block_id for b, *_ in placed]


PLACED = "array<struct<l:double,t:double,r:double,b:double,text:string,block_id:int,score:double,box:array<int>>>"


def read(spark, strategy, blocks):
    """(block_id, end) of a page in reading order."""
    rows = [(b.l, b.t, b.r, b.b, b.text, b.block_id, b.score, list(b.box)) for b in blocks]
    laid = L.laid_out(spark.createDataFrame([(rows,)], f"blocks {PLACED}"), strategy).select("laid").first()[0]
    return [(x.block_id, x.end) for x in laid]


def two_columns():
    """Five rows of two columns, 28 apart."""
    return [block(40 + 620 * c, 50 + 28 * r, 500, text=f"c{c}r{r}", i=10 * c + r) for r in range(5) for c in range(2)]


def order(spark, strategy, blocks):
    return [i for i, _ in read(spark, strategy, blocks)]


def test_one_column_reads_across_and_columns_read_down(spark):
    page = two_columns()
    assert ids(L.STRATEGIES["single_line"](page)) == order(spark, "single_line", page) == [0, 10, 1, 11, 2, 12, 3, 13, 4, 14]
    assert order(spark, "multi_line", page) == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14]


def test_headline_over_two_columns_comes_first_and_footer_last(spark):
    page = [block(40, 0, 1100, text="head", i=90), *two_columns(), block(40, 250, 1100, text="foot", i=91)]
    assert order(spark, "multi_line", page) == [90, 0, 1, 2, 3, 4, 10, 11, 12, 13, 14, 91]


def test_columns_under_a_narrower_headline_are_read_before_what_stands_beside_it(spark):
    """The right column begins beside the headline and goes on beside both columns below it."""
    left = [block(0, 0, 500, text="head", i=1), *[block(x, 40 + 28 * r, 220, i=10 * (2 + x // 260) + r) for r in range(3) for x in (0, 260)]]
    page = left + [block(600, 28 * r, 300, i=50 + r) for r in range(5)]
    assert order(spark, "multi_line", page)[:7] == [1, 20, 21, 22, 30, 31, 32]
    assert order(spark, "multi_line", page)[7:] == [50, 51, 52, 53, 54]


@pytest.mark.parametrize("strategy", sorted({*L.IN_COLUMNS, *L.IN_REGIONS} - {"single_code"}))
def test_layouts_are_permutations_whatever_the_order(spark, strategy):
    rng = random.Random(2)
    page = [block(rng.randrange(900), rng.randrange(600), rng.randrange(5, 200), rng.randrange(8, 30), "a b", i) for i in range(60)]
    out = read(spark, strategy, sorted(page, key=lambda b: b.t))
    assert sorted(i for i, _ in out) == list(range(60))
    assert out[-1][1] == "\n" or strategy == "multi_para"  # its ends belong to the order from top to bottom
    assert read(spark, strategy, []) == []


@pytest.mark.parametrize("strategy", ["single_none", "multi_none"])
def test_none_strategies_break_only_at_the_end(spark, strategy):
    assert [end for _, end in read(spark, strategy, two_columns())].count("\n") == 1


def test_gap_in_a_line_forces_a_space_and_the_height_quirk():
    near = [block(0, 0, 50, text="中", i=0), block(52, 0, 50, text="文", i=1)]
    assert P.ends_in_line(near) == [" ", "\n"]  # measured by the left edge, the height is below zero
    assert P.ends_in_line(near, fix_gap_height=True) == ["", "\n"]
    assert P.ends_in_line([block(0, 0, 50, text="well-"), block(52, 0, 9, text="known")], True) == ["", "\n"]
    assert P.ends_in_line([block(0, 0, 50, text="a"), block(52, 0, 9, text=", b")], True) == ["", "\n"]


def test_line_membership():
    lines = P.text_lines([block(0, 0, 100, i=0), block(95, 9, 50, i=1), block(200, 11, 50, i=2), block(300, 0, 50, 40, i=3), block(70, 2, 10, i=4)])
    assert [[b.block_id for b in line] for line in lines] == [[0, 1], [3], [4, 2]]


def ends(spark, units):
    rows = [(u.l, u.t, u.r, u.b, u.text, u.text) for u in units]
    frame = spark.createDataFrame([(rows,)], "units array<struct<l:double,t:double,r:double,b:double,head:string,tail:string>>")
    return frame.select(R.paragraph_ends(F.col("units"))).first()[0]


def test_paragraphs_with_indent_and_last_line(spark):
    units = [block(40, 0, 460, text="Indented first"), block(20, 28, 480, text="body one"), block(20, 56, 480, text="body two"), block(20, 84, 200, text="last."), block(20, 160, 480, text="Next"), block(20, 188, 480, text="one")]
    assert ends(spark, units) == [" ", " ", " ", "\n", " ", "\n"]
    assert ends(spark, units[::-1]) == ["\n", " ", "\n", " ", " ", " "]  # in any order, read downward
    assert ends(spark, []) == [] and ends(spark, units[:1]) == ["\n"]


def test_a_single_unit_goes_to_the_nearer_neighbour_that_it_fits(spark):
    above, below = [block(20, 28 * k, 480) for k in range(3)], [block(20, 150 + 28 * k, 480) for k in range(3)]
    assert ends(spark, [*above, block(20, 84, 100), *below]) == [" ", " ", " ", "\n", " ", " ", "\n"]
    assert ends(spark, [*above, block(40, 122, 460), *below]) == [" ", " ", "\n", " ", " ", " ", "\n"]
    assert ends(spark, [*above, block(300, 100, 40), *below]) == [" ", " ", "\n", "\n", " ", " ", "\n"]


def test_line_units_keep_the_edge_rule(spark):
    line = [block(0, 10, 50, text="ab"), block(60, 12, 40, text="cd")]
    frame = spark.createDataFrame([([(b.l, b.t, b.r, b.b, b.text, 0, 0.5, list(b.box)) for b in line],)], f"line {PLACED}")
    assert tuple(frame.select(L.line_unit(F.col("line"))).first()[0]) == (0, 10, 100, 32, "ab", "cd")


def test_code_keeps_gaps_and_indents():
    page = [block(0, 0, 40, text="if x:", i=0), block(40, 28, 60, text="return", i=1), block(140, 28, 20, text="1", i=2), block(0, 56, 40, text="end", i=3)]
    out = L.STRATEGIES["single_code"](page)
    assert [b.text for b, *_ in out] == ["if x:", "  return    1", "end"]
    assert out[1][0].box[0] == 0
    flat = block(0, 0, 40, 0, text="a"), block(60, 0, 40, 0, text="b")
    assert P.merge_code_line(list(flat)).text == "ab"  # no height, no spaces


def test_region_rows_hang_on_the_first_block(spark):
    page = [block(0, 0, 10, 10), block(20, 9, 10, 30), block(40, 11, 10, 10)]
    frame = spark.createDataFrame([([(b.l, b.t, b.r, b.b, b.text, 0, 0.5, list(b.box)) for b in page],)], f"blocks {PLACED}")
    assert frame.select(F.transform(R.in_rows(F.col("blocks")), F.size)).first()[0] == [2, 1]


def test_a_link_that_shuts_a_block_in_is_taken_back():
    """The block between two rows, to the right of the upper and above the lower one, isn't jumped over."""
    page = [block(0, 0, 200, i=0), block(0, 24, 200, i=1), block(0, 48, 200, i=2), block(210, 12, 80, i=3)]
    assert sorted(b.block_id for b in P.fine_sort(page)) == [0, 1, 2, 3]
    assert P.fine_sort(page[:1]) == page[:1] and P.fine_sort([]) == []


def test_fine_sort_column_and_large_region():
    assert [b.block_id for b in P.fine_sort([block(0, 28 * i, 300 - i, i=i) for i in range(9)])] == list(range(9))
    big = [block(12 * (i % 2), 28 * i, 300, i=i) for i in range(400)]
    assert [b.block_id for b in P.fine_sort(big)] == list(range(400))


def test_dedupe_boxes():
    small, other, whole = (0, 0, 10, 10), (10, 0, 20, 10), (0, 0, 20, 10)
    assert P.dedupe_boxes([whole, small, other, small]) == [small, other]
    assert P.dedupe_boxes([whole, small]) == [small, whole]  # half of it is still free
    assert P.dedupe_boxes([]) == [] and P.dedupe_boxes([(5, 5, 5, 9)]) == []


def test_spans():
    a, b, c = (0, 0, 10, 20), (10, 0, 30, 10), (10, 10, 20, 20)
    d = (20, 10, 30, 20)
    assert P.spans_of([[a, b, b], [a, c, d]]) == [(0, 0, 2, 1), (0, 1, 1, 2), (1, 1, 1, 1), (1, 2, 1, 1)]
