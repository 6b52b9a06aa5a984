"""Structures filled with their cells' texts over arrays against the joins of the same rules, and what they shuffle."""

from __future__ import annotations

import random

from pagewright.operators import aggregates as A
from pagewright.operators import joins as J
from pagewright.plans import tables as TB
from pagewright.queries import all_queries

SF = "/root/testdata/sf0.001"


def test_filled_structures_are_those_of_the_joins(spark):
    rng, tokens, blocks = random.Random(7), [], []
    for p in range(120):
        said = [("sos", None)] * (p % 2)
        for r in range(rng.randrange(1, 5)):
            said.append(("<tr>", None))
            for c in range(rng.randrange(1, 5)):
                box = rng.choice([None, *[(c * 40, r * 20, c * 40 + rng.choice([40, 80]), r * 20 + 20)] * 4])
                spans = rng.sample([' colspan="2"', ' rowspan="3"', ' x="1"'], rng.randrange(1, 4))
                said += rng.choice([[("<td></td>", box)], [("<td", box), *((x, None) for x in spans), (">", None), ("</td>", None)], [("<td>", None)]])
            said.append(("</tr>", None))
        said += [("eos", None), ("<td></td>", (0, 0, 10, 10))] * (rng.random() < 0.7)
        tokens += [(p, t, token, 0.5, *(box or (None,) * 4)) for t, (token, box) in enumerate(said)]
        for i in range(rng.randrange(0, 12) if p % 7 else 0):
            x, y = rng.randrange(-5, 160), rng.randrange(-60, 90)
            blocks.append((p, 100 - i, rng.choice([f"a{i}", f"a{-i}", None, ""]), x, y, x + rng.choice([0, 20, 45]), y + rng.choice([10, 25])))
    toks = spark.createDataFrame(tokens, "page_id long, t int, token string, score double, x1 int, y1 int, x2 int, y2 int")
    texts = spark.createDataFrame([*blocks, (999, 0, "no page", 0, 0, 9, 9)], "page_id long, block_id int, text string, l int, t int, r int, b int")
    cells = TB.structure_cells(toks)
    want = sorted(TB.fill_placeholders(TB.decode_structure(toks), cells, A.cell_texts(J.match_blocks_to_cells(texts, cells))).collect())
    assert sorted(TB.filled_structures(toks, texts).collect()) == want and sum(">a" in r.html for r in want) > 20


def test_filled_structures_take_one_grouping_and_no_join(spark):
    said = all_queries()["pag_13_fill_placeholders"].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in said and said.count("Exchange hashpartitioning") == said.count("REPARTITION_BY_NUM")
