"""Lines of text as columns: the rules of one-column pages over a page's array of blocks, in the JVM.

Blocks are an array of structs with l, t, r, b, text, block_id, score and box, in order of top edges (`page_lists`). A page
stays one row from its blocks to its lines, so that batches and streams take the same expressions and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import text_separator


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unplaced(blocks: Column) -> Column:
    """Whether some block has no place: no box, or an edge that isn't known."""
    return F.coalesce(F.exists(blocks, lambda b: b["l"].isNull() | b["t"].isNull() | b["r"].isNull() | b["b"].isNull() | b["box"].isNull()), F.lit(False))


def _assigned(blocks: Column) -> Column:
    """struct(lines, own) of blocks in order of left edges: the open lines, and the line of each block.

    A block goes to the earliest line that it continues, else opens one: it begins no more than a line height before the
    line's end, lies within half a height of the line's first block, and is of like height.
    """
    none = F.struct(F.array().cast("array<struct<t:double,b:double,h:double,end:double>>").alias("lines"), F.array().cast("array<int>").alias("own"))

    def step(acc: Column, x: Column) -> Column:
        h = x["b"] - x["t"]

        def goes_on(line: Column) -> Column:
            beside = (x["l"] >= line["end"] - line["h"]) & (x["t"] >= line["t"] - line["h"] / 2) & (x["b"] <= line["b"] + line["h"] / 2)
            return beside & (F.abs(line["h"] - h) <= F.least(line["h"], h) / 2)

        def put(at: Column) -> Column:
            opened = F.array_append(acc["lines"], F.struct(x["t"].alias("t"), x["b"].alias("b"), h.alias("h"), x["r"].alias("end")))
            longer = F.transform(acc["lines"], lambda n, i: F.when(i == at - 1, F.struct(n["t"].alias("t"), n["b"].alias("b"), n["h"].alias("h"), x["r"].alias("end"))).otherwise(n))
            number = F.when(at == 0, F.size(acc["lines"])).otherwise((at - 1).cast("int"))
            return F.struct(F.when(at == 0, opened).otherwise(longer).alias("lines"), F.array_append(acc["own"], number).alias("own"))

        return let(F.array_position(F.transform(acc["lines"], goes_on), F.lit(True)), put)

    return F.aggregate(blocks, none, step)


def in_lines(blocks: Column) -> Column:
    """The blocks with `line`, line by line from left to right; lines are in order of the tops of their first blocks."""
    sided = F.transform(
        F.array_sort(F.transform(blocks, lambda b, i: F.struct(b["l"].alias("l"), i.alias("i"), b.alias("block")))), lambda s: s["block"]
    )

    def ordered(own: Column, lines: Column) -> Column:
        numbers = F.transform(F.array_sort(F.transform(lines["lines"], lambda n, i: F.struct(n["t"].alias("t"), i.alias("i")))), lambda n: n["i"])

        def rows(rank: Column) -> Column:
            line = lambda i: (F.array_position(rank, F.get(lines["own"], i)) - 1).cast("int").alias("line")
            fields = ("l", "t", "r", "b", "text", "block_id", "score", "box")
            return F.array_sort(F.transform(own, lambda b, i: F.struct(line(i), i.alias("i"), *[b[c].alias(c) for c in fields])))

        return let(numbers, rows)

    return let(sided, lambda own: let(_assigned(own), lambda lines: ordered(own, lines)))


def with_ends(placed: Column, end: Callable[[Column, Column], Column]) -> Column:
    """What layouts give, from blocks in lines; `end` takes a block and the next one, or null."""

    def row(x: Column, y: Column) -> Column:
        return F.struct(x["line"].alias("region_id"), x["block_id"].alias("block_id"), x["text"].alias("text"), x["score"].alias("score"), x["box"].alias("box"), end(x, y).alias("end"))

    return let(placed, lambda p: F.transform(p, lambda x, i: let(F.get(p, i + 1), lambda y: row(x, y))))


def in_line_end(x: Column, y: Column) -> Column:
    """A space after a wide gap, else by the characters. The height takes the next block's left edge for its top, as it always has."""
    height = (x["b"] + y["b"] - x["t"] - y["l"]) / 2
    return F.when(y["l"] - x["r"] > height * 1.5, F.lit(" ")).otherwise(text_separator(x["text"], y["text"]))


def single_line(blocks: Column) -> Column:
    """Lines that end in line breaks."""
    return with_ends(in_lines(blocks), lambda x, y: F.when(y.isNull() | (y["line"] != x["line"]), F.lit("\n")).otherwise(in_line_end(x, y)))


def single_none(blocks: Column) -> Column:
    """Lines joined by what their characters ask for; a line break only at the end of the page."""
    joined = lambda x, y: F.when(y["line"] != x["line"], text_separator(x["text"], y["text"])).otherwise(in_line_end(x, y))
    return with_ends(in_lines(blocks), lambda x, y: F.when(y.isNull(), F.lit("\n")).otherwise(joined(x, y)))


def _merged(line: Column) -> Column:
    """A line of code as one block: two spaces for every height of a gap, the boxes joined, the scores' mean."""
    first = F.get(line, F.lit(0))
    tall = lambda box: (F.get(box, 7) - F.get(box, 1)).cast("double")
    start = F.struct(tall(first["box"]).alias("height"), first["text"].alias("text"), first["box"].alias("box"))

    def step(acc: Column, x: Column) -> Column:
        old, new = acc["box"], x["box"]
        gap = F.get(new, 0) - F.get(old, 2)

        def joined(height: Column) -> Column:
            spaces = F.when((gap > 0) & (height > 0), F.floor(gap / height + 0.5)).otherwise(0).cast("int")
            top, left = [F.least(*[F.get(box, i) for box in (old, new) for i in at]) for at in ((1, 3), (0, 6))]
            right, bottom = [F.greatest(*[F.get(box, i) for box in (old, new) for i in at]) for at in ((2, 4), (5, 7))]
            text = F.concat(acc["text"], F.repeat(F.lit("  "), spaces), x["text"])
            return F.struct(height.alias("height"), text.alias("text"), F.array(left, top, right, top, right, bottom, left, bottom).alias("box"))

        return let((acc["height"] + tall(new)) / 2, joined)

    total = F.aggregate(line, F.lit(0.0), lambda s, x: s + x["score"])
    merged = F.aggregate(F.slice(line, 2, F.size(line)), start, step)
    return let(merged, lambda m: F.struct(first["line"].alias("line"), first["block_id"].alias("block_id"), m["text"].alias("text"), (total / F.size(line)).alias("score"), m["box"].alias("box")))


def single_code(blocks: Column) -> Column:
    """Lines of code: merged, and indented by two spaces for every mean line height that they begin right of the leftmost line."""

    def indented(lines: Column) -> Column:
        lefts = F.transform(lines, lambda n: F.get(n["box"], 0))
        height = F.aggregate(lines, F.lit(0.0), lambda s, n: s + F.get(n["box"], 7) - F.get(n["box"], 1)) / F.size(lines)
        page = F.struct(F.array_min(lefts).alias("least"), F.array_max(lefts).alias("most"), height.alias("height"))

        def row(n: Column, p: Column) -> Column:
            steps = lambda x: F.ceil((x - p["least"]) / p["height"])
            level = F.least(steps(p["most"]), steps(F.get(n["box"], 0) + p["height"] / 2)) - 1
            level = F.when(p["height"] > 0, F.greatest(level, F.lit(0))).otherwise(0).cast("int")
            box = F.array(p["least"], *[F.get(n["box"], i) for i in range(1, 6)], p["least"], F.get(n["box"], 7))
            return F.struct(n["line"].alias("region_id"), n["block_id"].alias("block_id"), F.concat(F.repeat(F.lit("  "), level), n["text"]).alias("text"), n["score"].alias("score"), box.alias("box"), F.lit("\n").alias("end"))

        return let(page, lambda p: F.transform(lines, lambda n: row(n, p)))

    def by_line(p: Column) -> Column:
        numbers = F.array_distinct(F.transform(p, lambda x: x["line"]))
        return F.transform(numbers, lambda k: let(F.filter(p, lambda x: x["line"] == k), _merged))

    return let(let(in_lines(blocks), by_line), lambda lines: F.when(F.size(lines) > 0, indented(lines)).otherwise(F.array().cast("array<struct<region_id:int,block_id:int,text:string,score:double,box:array<int>,end:string>>")))
