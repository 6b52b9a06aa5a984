"""Columns of text on a page (PAG-02) and paragraphs (PAG-05), as columns over a page's array of blocks, in the JVM.

Nothing here depends on how pages are spread: a page is one row from its blocks to its regions, in batches and streams alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import text_separator
from pagewright.operators.lines import let

#: What stays with a block.
FIELDS = ("l", "t", "r", "b", "text", "block_id", "score", "box")
#: Left edges and ends of columns that differ by no more are taken as equal.
NEAR = 1e-4
#: How far, in heights, a paragraph's edges may stray.
SLACK = 1.2


def stretches(items: Column, key: str) -> Column:
    """An array of structs cut where `key` changes from one to the next."""
    begins = F.transform(items, lambda x, i: F.when((i == 0) | (F.get(items, i - 1)[key] != x[key]), i))
    cut = lambda at: F.transform(at, lambda a, k: F.slice(items, a + 1, F.coalesce(F.get(at, k + 1), F.size(items)) - a))
    return let(F.filter(begins, lambda i: i.isNotNull()), cut)


# ---- columns of text ----


def in_rows(blocks: Column) -> Column:
    """The rows of a page: all blocks that begin no lower than the bottom of the row's first block, from left to right; each has `row`."""
    downward = F.sort_array(F.transform(blocks, lambda b, i: F.struct(b["t"].alias("t"), i.alias("k"), b.alias("block"))))
    none = F.struct(F.lit(None).cast("double").alias("limit"), F.array().cast("array<int>").alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        inside, last = F.coalesce(x["t"] <= acc["limit"], F.lit(False)), F.coalesce(F.get(acc["rows"], F.size(acc["rows"]) - 1), F.lit(-1))
        here = lambda n: F.struct(F.when(inside, acc["limit"]).otherwise(x["block"]["b"]).alias("limit"), F.array_append(acc["rows"], n).alias("rows"))
        return here(F.when(inside, last).otherwise(last + 1))

    def numbered(own: Column) -> Column:
        first = F.when(F.size(own) > 0, F.aggregate(own, none, step)["rows"])
        placed = lambda rows: F.sort_array(F.transform(own, lambda x, i: F.struct(F.get(rows, i).alias("row"), x["block"]["l"].alias("l"), x["block"]["r"].alias("r"), x["k"].alias("k"), x["block"].alias("block"))))
        return let(first, placed)

    return let(let(downward, numbered), lambda placed: stretches(placed, "row"))


def _free(row: Column, left: Column, right: Column) -> Column:
    """The parts of `left` to `right` that no block of the row covers; the last one always, even if it is empty."""
    part = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    start = F.struct(left.alias("at"), F.array().cast("array<struct<lo:double,hi:double>>").alias("free"))

    def step(acc: Column, x: Column) -> Column:
        free = F.when(x["l"] > acc["at"], F.array_append(acc["free"], part(acc["at"], x["l"]))).otherwise(acc["free"])
        return F.struct(F.greatest(acc["at"], x["r"]).alias("at"), free.alias("free"))

    return F.aggregate(row, start, step, lambda acc: F.array_append(acc["free"], part(acc["at"], right)))


def row_cuts(rows: Column) -> Column:
    """For each row the cuts (lo, hi) that run through it, from left to right.

    A cut is an interval of rows with what their free parts share. A row narrows the cuts that reach down to it, once for
    each free part that they meet; a free part that none of them meets begins a cut; a cut that meets none ends above.
    """
    none = F.array().cast("array<struct<lo:double,hi:double,top:int,low:int>>")
    meet = lambda a, b: F.greatest(a["lo"], b["lo"]) <= F.least(a["hi"], b["hi"])

    def step(cuts: Column, row: Column) -> Column:
        free, i = row["free"], row["i"]
        live = lambda c: c["low"] == i - 1
        cut = lambda lo, hi, top: F.struct(lo.alias("lo"), hi.alias("hi"), top.alias("top"), i.alias("low"))
        above = F.filter(cuts, lambda c: ~(live(c) & F.exists(free, lambda f: meet(c, f))))
        goes_on = F.transform(F.filter(cuts, live), lambda c: F.transform(F.filter(free, lambda f: meet(c, f)), lambda f: cut(F.greatest(c["lo"], f["lo"]), F.least(c["hi"], f["hi"]), c["top"])))
        begins = F.filter(free, lambda f: ~F.exists(cuts, lambda c: live(c) & meet(c, f)))
        return F.concat(above, F.flatten(goes_on), F.transform(begins, lambda f: cut(f["lo"], f["hi"], i)))

    def free_rows(page: Column) -> Column:
        return F.transform(rows, lambda row, i: F.struct(i.alias("i"), _free(row, page["left"], page["right"]).alias("free")))

    def through(cuts: Column) -> Column:
        ordered = F.sort_array(F.transform(cuts, lambda c, k: F.struct(c["lo"].alias("lo"), k.alias("k"), c["hi"].alias("hi"), c["top"].alias("top"), c["low"].alias("low"))))
        of_row = lambda i: lambda c: (c["top"] <= i) & (i <= c["low"])
        return let(ordered, lambda own: F.transform(rows, lambda _, i: F.filter(own, of_row(i))))

    whole = lambda all_: F.struct((F.array_min(F.transform(all_, lambda b: b["l"])) - 1).alias("left"), (F.array_max(F.transform(all_, lambda b: b["r"])) + 1).alias("right"))
    page = let(F.flatten(rows), whole)
    return let(F.aggregate(let(page, free_rows), none, step), through)


def _sided(rows: Column, cuts: Column) -> Column:
    """All blocks, row by row, with `side`: the right end of the cut before them and the left end of the cut after it."""

    def one(x: Column, own: Column) -> Column:
        before = F.size(F.filter(F.slice(own, F.lit(2), F.greatest(F.size(own) - 2, F.lit(0))), lambda c: x["l"] + NEAR > c["lo"]))
        side = let(before, lambda n: F.struct(F.get(own, n)["hi"].alias("left"), F.get(own, F.least(n + 1, F.size(own) - 1))["lo"].alias("right")))
        return F.struct(x["row"].alias("row"), side.alias("side"), x["block"].alias("block"))

    return F.flatten(F.transform(rows, lambda row, i: let(F.get(cuts, i), lambda own: F.transform(row, lambda x: one(x, own)))))


def _shut(side: Column, cuts: Column) -> Column:
    """The rows through which a side doesn't pass: no cut ends at its left, or none begins at its right, or one has an end between them."""
    between = lambda x: (side["left"] < x) & (x < side["right"])
    passes = lambda own: F.exists(own, lambda c: c["hi"] == side["left"]) & F.exists(own, lambda c: c["lo"] == side["right"]) & ~F.exists(own, lambda c: between(c["lo"]) | between(c["hi"]))
    return F.filter(F.transform(cuts, lambda own, i: F.when(~passes(own), i)), lambda i: i.isNotNull())


def _paths(columns: Column) -> Column:
    """Where each column stands in reading order, as the path from the page to it: columns are read before those that hang below them.

    A column hangs below the lowest, then rightmost, of those that end above it and lie across its right edge; below one,
    they go from left to right. Columns are in order of their first rows, so what one hangs on comes before it.
    """
    place = "struct<left:double,low:int,id:int>"
    none = F.array().cast(f"array<struct<low:int,right:double,back:int,left:double,path:array<{place}>>>")

    def step(acc: Column, c: Column) -> Column:
        edge = c["right"] - 2
        above = F.filter(acc, lambda a: (a["low"] < c["top"]) & (a["left"] <= edge) & (edge <= a["right"] + NEAR))
        head = F.coalesce(F.array_max(above)["path"], F.array().cast(f"array<{place}>"))
        own = F.struct(c["left"].alias("left"), c["low"].alias("low"), c["id"].alias("id"))
        return F.array_append(acc, F.struct(c["low"].alias("low"), c["right"].alias("right"), (-c["id"]).alias("back"), c["left"].alias("left"), F.array_append(head, own).alias("path")))

    return F.transform(F.aggregate(columns, none, step), lambda a: a["path"])


def _in_columns(blocks: Column, cuts: Column) -> Column:
    """The blocks with `region`, from _sided: equal sides with no shut row between them are one column."""

    def keyed(sides: Column, shut: Column) -> Column:
        def key(x: Column) -> Column:
            own = F.array_position(sides, x["side"]).cast("int") - 1
            return let(own, lambda s: F.struct(s.alias("s"), F.size(F.filter(F.get(shut, s), lambda i: i <= x["row"])).alias("part")))

        return F.transform(blocks, lambda x: F.struct(key(x).alias("key"), x["row"].alias("row"), x["block"].alias("block")))

    def placed(rows: Column, keys: Column, sides: Column, shut: Column) -> Column:
        def column(key: Column, i: Column) -> Column:
            top, side = F.get(F.filter(rows, lambda x: x["key"] == key), F.lit(0))["row"], F.get(sides, key["s"])
            low = lambda t: F.coalesce(F.array_min(F.filter(F.get(shut, key["s"]), lambda j: j > t)), F.size(cuts)) - 1
            return let(top, lambda t: F.struct(i.alias("id"), side["left"].alias("left"), side["right"].alias("right"), t.alias("top"), low(t).alias("low")))

        ranked = lambda paths: F.transform(F.sort_array(F.transform(paths, lambda p, i: F.struct(p.alias("p"), i.alias("i")))), lambda x: x["i"])

        def numbered(rank: Column) -> Column:
            region = lambda x: (F.array_position(rank, (F.array_position(keys, x["key"]) - 1).cast("int")) - 1).cast("int")
            return F.sort_array(F.transform(rows, lambda x, i: F.struct(region(x).alias("region"), x["block"]["t"].alias("_t"), i.alias("_i"), *[x["block"][c].alias(c) for c in FIELDS])))

        return let(let(let(F.transform(keys, column), _paths), ranked), numbered)

    def with_sides(sides: Column) -> Column:
        shut = F.transform(sides, lambda side: _shut(side, cuts))
        return let(shut, lambda s: let(keyed(sides, s), lambda rows: let(F.array_distinct(F.transform(rows, lambda x: x["key"])), lambda keys: placed(rows, keys, sides, s))))

    return let(F.array_distinct(F.transform(blocks, lambda x: x["side"])), with_sides)


def in_regions(blocks: Column) -> Column:
    """The blocks with `region`, in reading order of the columns and from top to bottom in each.

    A column lies between two neighbouring cuts and runs down over the rows through which they pass. No blocks: an empty array; null: null.
    """
    laid = let(in_rows(blocks), lambda rows: let(row_cuts(rows), lambda cuts: let(_sided(rows, cuts), lambda own: _in_columns(own, cuts))))
    plain = F.transform(laid, lambda x: F.struct(x["region"].alias("region"), *[x[c].alias(c) for c in FIELDS]))
    empty = "array<struct<region:int,l:double,t:double,r:double,b:double,text:string,block_id:int,score:double,box:array<int>>>"
    return F.when(F.size(blocks) > 0, plain).when(F.size(blocks) == 0, F.array().cast(empty))


def one_region(blocks: Column) -> Column:
    """The blocks as one region, as they are."""
    return F.transform(blocks, lambda b: F.struct(F.lit(0).alias("region"), *[b[c].alias(c) for c in FIELDS]))


# ---- paragraphs ----


def _grouped(units: Column) -> Column:
    """The units from top to bottom with `group` and `spacing`, the mean distance so far in their group (null for its first).

    A group goes on while left and right edges stay within SLACK heights of their running means and the spacing doesn't
    grow by half a height.
    """
    none = F.expr("named_struct('l', 0D, 'r', 0D, 'h', 0D, 'low', 0D, 'spacing', cast(null as double), 'group', -1, 'done', cast(array() as array<struct<group:int,spacing:double>>))")

    def step(acc: Column, u: Column) -> Column:
        near = lambda c: F.abs(acc[c] - u[c]) <= acc["h"] * SLACK
        gap = u["t"] - acc["low"]
        goes_on = (acc["group"] >= 0) & near("l") & near("r") & (acc["spacing"].isNull() | (gap < acc["spacing"] + acc["h"] / 2))
        longer = (acc["l"] + u["l"]) / 2, (acc["r"] + u["r"]) / 2, (acc["h"] + u["b"] - u["t"]) / 2, F.coalesce((acc["spacing"] + gap) / 2, gap), acc["group"]
        begun = u["l"], u["r"], u["b"] - u["t"], F.lit(None).cast("double"), acc["group"] + 1
        state = lambda values: F.struct(*[v.alias(k) for k, v in zip(("l", "r", "h", "spacing", "group"), values, strict=True)])

        def put(now: Column) -> Column:
            said = F.struct(now["group"].alias("group"), now["spacing"].alias("spacing"))
            return F.struct(*[now[c].alias(c) for c in ("l", "r", "h")], u["b"].alias("low"), now["spacing"].alias("spacing"), now["group"].alias("group"), F.array_append(acc["done"], said).alias("done"))

        return let(F.when(goes_on, state(longer)).otherwise(state(begun)), put)

    def with_groups(own: Column) -> Column:
        said = F.aggregate(own, none, step)["done"]
        return let(said, lambda s: F.transform(own, lambda u, i: F.struct(F.get(s, i)["group"].alias("group"), F.get(s, i)["spacing"].alias("spacing"), u.alias("u"))))

    downward = F.sort_array(F.transform(units, lambda u, i: F.struct(u["t"].alias("t"), i.alias("i"), *[u[c].alias(c) for c in ("l", "r", "b", "head", "tail")])))
    return let(downward, with_groups)


def _moves(groups: Column) -> Column:
    """For each group, from the last to the first: 1 if it goes to the group below, -1 to the one above, 0 if it stays.

    Only a group of one unit moves, to the neighbour that it fits; to the nearer one, if it fits both. It becomes the first or
    last unit of that group, which the groups above then see.
    """
    edge = "struct<l:double,t:double,r:double,b:double>"
    none = F.expr(f"named_struct('below', cast(null as {edge}), 'many', false, 'spacing', cast(null as double), 'took', false, 'moves', cast(array() as array<int>))")
    upward = F.reverse(F.transform(groups, lambda g, k: F.struct(k.alias("k"), g.alias("g"))))
    box = lambda x: F.struct(*[x["u"][c].alias(c) for c in "ltrb"])
    true = lambda c: F.coalesce(c, F.lit(False))
    apart = lambda gap, spacing, h: true(gap > spacing + h / 2)

    def decide(acc: Column, k: Column, own: Column, prior: Column) -> Column:
        u, up, down = own["first"], prior["last"], acc["below"]
        uh, dh = up["b"] - up["t"], down["b"] - down["t"]
        alone = (own["n"] == 1) & ~acc["took"]
        fits_up = true((F.abs(up["l"] - u["l"]) <= uh * SLACK) & (u["r"] <= up["r"] + uh * SLACK)) & ~apart(u["t"] - up["b"], prior["spacing"], uh)
        starts = (down["l"] - dh * SLACK <= u["l"]) & (u["l"] <= down["l"] + dh * (1 + SLACK))
        reaches = F.when(acc["many"], F.abs(down["r"] - u["r"]) <= dh * SLACK).otherwise(down["r"] - dh * SLACK < u["r"])
        fits_down = true(starts & reaches) & ~apart(down["t"] - u["b"], acc["spacing"], dh)
        goes_up = fits_up & (~fits_down | (u["t"] - up["b"] < down["t"] - u["b"]))
        move = F.when(~alone, F.lit(0)).when(true(goes_up), F.lit(-1)).when(fits_down, F.lit(1)).otherwise(F.lit(0))

        def after(m: Column) -> Column:
            spacing = F.when(m == 1, acc["spacing"]).otherwise(own["spacing"])
            many = (m == 1) | (own["n"] > 1) | acc["took"]
            return F.struct(u.alias("below"), many.alias("many"), spacing.alias("spacing"), (m == -1).alias("took"), F.array_append(acc["moves"], m).alias("moves"))

        return let(move, after)

    def step(acc: Column, x: Column) -> Column:
        told = lambda g: F.struct(box(F.get(g, F.lit(0))).alias("first"), box(F.element_at(g, F.lit(-1))).alias("last"), F.size(g).alias("n"), F.element_at(g, F.lit(-1))["spacing"].alias("spacing"))
        prior = F.when(x["k"] > 0, let(F.get(groups, x["k"] - 1), told))
        return let(told(x["g"]), lambda own: let(prior, lambda p: decide(acc, x["k"], own, p)))

    return F.reverse(F.aggregate(upward, none, step)["moves"])


def paragraph_ends(units: Column) -> Column:
    """What follows each unit (l, t, r, b, head, tail): units are lines or blocks, in any order; paragraphs are read downward and end in line breaks.

    Between units of a paragraph stands what the `tail` of one and the `head` of the next ask for.
    """

    def ends(own: Column, groups: Column, moves: Column) -> Column:
        fused = lambda g: (F.get(moves, g) == 1) | (F.get(moves, g + 1) == -1)

        def end(x: Column, y: Column) -> Column:
            joined = y.isNotNull() & ((x["group"] == y["group"]) | F.coalesce(fused(x["group"]), F.lit(False)))
            return F.when(joined, text_separator(x["u"]["tail"], y["u"]["head"])).otherwise(F.lit("\n"))

        said = F.transform(own, lambda x, i: F.struct(x["u"]["i"].alias("i"), let(F.get(own, i + 1), lambda y: end(x, y)).alias("end")))
        return F.transform(F.sort_array(said), lambda x: x["end"])

    return let(_grouped(units), lambda own: let(stretches(own, "group"), lambda groups: let(_moves(groups), lambda moves: ends(own, groups, moves))))
