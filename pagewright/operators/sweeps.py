"""Rectangles of a page that lie near one another, found by sweeps over arrays: all pages of an Arrow batch at once, in the order of their upper edges.

A rectangle is compared with those that begin no lower than its own lower end, so rows of a table meet the next row only; pairs are made and
dropped in runs of a bounded number, however many rectangles a page has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many pairs are held at a time.
PAIRS = 1 << 20


class Rects(NamedTuple):
    """Rectangles of a batch: the page of each (its place in the batch), and its edges."""

    page: np.ndarray
    l: np.ndarray  # noqa: E741
    t: np.ndarray
    r: np.ndarray
    b: np.ndarray

    def at(self, i: np.ndarray) -> Rects:
        return Rects(*(side[i] for side in self))


def flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.StructArray]:
    """The lists of structs in a column: the row of each struct, and the structs."""
    lists = batch.column(batch.schema.get_field_index(name))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def numbers(structs: pa.StructArray, name: str) -> np.ndarray:
    """A field as doubles, NaN for null. Whole coordinates stay exact."""
    return structs.field(name).cast(pa.float64()).to_numpy(zero_copy_only=False)


def ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i all whole numbers from start to end, the end not included: (i, number)."""
    n = np.maximum(end - start, 0)
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start, n)


def runs(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of neighbours whose counts make `most` together, or of one alone."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield slice(at, to)
        at = to


class Places:
    """One order of heights on all pages of a batch: page after page, each from its least to its largest height."""

    def __init__(self, *heights: np.ndarray) -> None:
        own = [h[np.isfinite(h)] for h in heights]
        self.low = min((h.min() for h in own if len(h)), default=0.0)
        self.span = max((h.max() for h in own if len(h)), default=0.0) - self.low + 2

    def of(self, page: np.ndarray, y: np.ndarray) -> np.ndarray:
        return page * self.span + np.clip(y - self.low, -0.5, self.span - 1.5) + 0.5


def near_pairs(own: Rects, reach: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of pairs (i, j), i before j by page and t, for which t of j is at most b of i + reach of i. `own` is in order of page and t."""
    until = np.maximum(own.t, own.b) + reach
    places = Places(own.t, until)
    start = np.arange(len(own.t)) + 1
    end = np.searchsorted(places.of(own.page, own.t), places.of(own.page, until), "right")
    for part in runs(np.maximum(end - start, 0), most):
        i, j = ranges(start[part], end[part])
        yield i + part.start, j


def union_areas(owner: np.ndarray, rects: Rects, n: int, most: int = PAIRS) -> np.ndarray:
    """The area that the rectangles of each of n owners cover together. They are cut in strips of x, and each strip is swept downward."""
    total = np.zeros(n)
    if not len(owner):
        return total
    xs, x = np.unique(np.concatenate([rects.l, rects.r]), return_inverse=True)
    edges, at = np.unique(np.concatenate([owner, owner]) * len(xs) + x, return_inverse=True)
    start, end = at[: len(owner)], at[len(owner) :]
    width = np.append(xs[edges[1:] % len(xs)] - xs[edges[:-1] % len(xs)], 0.0)
    ys, y = np.unique(np.concatenate([rects.t, rects.b]), return_inverse=True)
    top, bottom = y[: len(owner)], y[len(owner) :]
    held = np.cumsum(np.bincount(start, minlength=len(edges)) - np.bincount(end, minlength=len(edges)))
    for part in runs(held, most):
        some = np.flatnonzero((start < part.stop) & (end > part.start))
        k, strip = ranges(np.maximum(start[some], part.start), np.minimum(end[some], part.stop))
        k = some[k]
        order = np.lexsort((top[k], strip))
        k, strip = k[order], strip[order]
        passed = np.maximum.accumulate(strip * len(ys) + bottom[k])
        before = np.append(-1, passed[:-1]) - strip * len(ys)  # below 0 at the first of a strip
        covered = np.maximum(ys[bottom[k]] - ys[np.maximum(top[k], before)], 0.0)
        total += np.bincount(owner[k], weights=covered * width[strip], minlength=n)
    return total


def blocked(gaps: Rects, covers: Rects, share: float, most: int = PAIRS) -> np.ndarray:
    """For each gap whether the covers (in order of page and t) of its page take at least `share` of its area, each point once.

    Where one cover takes that much, or all of them added up don't, nothing more is worked out.
    """
    out, wanted = np.zeros(len(gaps.l), bool), share * (gaps.r - gaps.l) * (gaps.b - gaps.t)
    for g, k in meeting(gaps, covers, most):
        own, over = gaps.at(g), covers.at(k)
        cut = Rects(own.page, np.maximum(own.l, over.l), np.maximum(own.t, over.t), np.minimum(own.r, over.r), np.minimum(own.b, over.b))
        area = (cut.r - cut.l) * (cut.b - cut.t)
        out[g[area >= wanted[g]]] = True
        added = np.bincount(g, weights=area, minlength=len(out))
        open_ = np.flatnonzero(~out[g] & (added[g] >= wanted[g]))
        whose, place = np.unique(g[open_], return_inverse=True)
        out[whose] = union_areas(place, cut.at(open_), len(whose), most) >= wanted[whose]
    return out


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the links a-b reach."""
    least = np.arange(n)
    while len(a):
        x, y = least[a], least[b]
        new, low = least.copy(), np.minimum(x, y)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while not np.array_equal(further := new[new], new):
            new = further
        least = new
        apart = least[a] != least[b]
        a, b = a[apart], b[apart]
    return least


def lists_of(rows: DataFrame, key: str, columns: Sequence[str | Column], name: str = "items") -> DataFrame:
    """(key, items): the rows of each key as a list of structs."""
    return rows.groupBy(key).agg(F.collect_list(F.struct(*columns)).alias(name))


def ids_of(structs: pa.StructArray, name: str) -> np.ndarray:
    return structs.field(name).to_numpy(zero_copy_only=False)


def by_least(page: np.ndarray, ids: np.ndarray, pairs: Callable[[], Iterator[tuple[np.ndarray, np.ndarray]]]) -> np.ndarray:
    """For each row the least id of its page that the pairs (of rows) reach."""
    order = np.lexsort((ids, page))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    least = np.arange(len(order))
    for a, b in pairs():  # a run at a time: earlier runs' links are held as links to the least
        a, b = np.concatenate([np.arange(len(least)), place[a]]), np.concatenate([least, place[b]])
        least = least_reached(len(order), a, b)
    return ids[order][least[place]]


def adjacent(l: np.ndarray, t: np.ndarray, r: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:  # noqa: E741
    """Which pairs share more than 5 on one axis and touch (5, or 5 % of the smaller side) on the other."""

    def shared(lo, hi):
        return np.minimum(hi[i], hi[j]) - np.maximum(lo[i], lo[j])

    def touch(lo, hi):
        apart = np.minimum(np.minimum(np.abs(lo[i] - lo[j]), np.abs(lo[i] - hi[j])), np.minimum(np.abs(hi[i] - lo[j]), np.abs(hi[i] - hi[j])))
        return apart <= np.minimum(5.0, np.minimum(hi[i] - lo[i], hi[j] - lo[j]) * 0.05)

    return ((shared(t, b) > 5) & touch(l, r)) | ((shared(l, r) > 5) & touch(t, b))


def in_order(page: np.ndarray, structs: pa.StructArray, names: Sequence[str]) -> tuple[Rects, np.ndarray]:
    """The rectangles of structs in order of page and t, and which struct each is; those with an unknown edge are left out."""
    sides = [numbers(structs, n) for n in names]
    known = np.flatnonzero(~np.isnan(sum(sides)))
    order = known[np.lexsort((sides[1][known], page[known]))]
    return Rects(page[order], *(s[order] for s in sides)), order


def cluster_ids(page: np.ndarray, own: Rects, order: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each cell the least id that adjacency reaches. `own` are the cells whose edges are known, in order of page and t, and `order` says which."""

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in near_pairs(own, np.full(len(own.t), 5.0)):
            near = adjacent(*own[1:], i, j)
            yield order[i[near]], order[j[near]]

    return by_least(page, ids, pairs)


def adjacent_clusters(cells: DataFrame, key: str = "page_id") -> DataFrame:
    """Cells (page_id, cell_id, x1, y1, x2, y2, ...) with `table_id`: the least cell_id that adjacency reaches. A page's cells take one shuffle, and no join."""
    names = [c for c in cells.columns if c != key]
    kind = cells.schema["cell_id"].dataType.simpleString()
    head = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in [key, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, items = flat(batch, "items")
            own, order = in_order(page, items, ("x1", "y1", "x2", "y2"))
            ids = ids_of(items, "cell_id")
            table = pa.array(cluster_ids(page, own, order, ids), items.type.field("cell_id").type)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(page)), *(items.field(n) for n in names), table], [key, *names, "table_id"])

    return lists_of(cells, key, names).mapInArrow(run, f"{head}, table_id {kind}")


def _between(own: Rects, i: np.ndarray, j: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, Rects]:
    """Of pairs: whether they overlap; whether they lie within c of one another and half beside or below; and the gap between them."""
    a, b = own.at(i), own.at(j)
    l, t, r, low = np.maximum(a.l, b.l), np.maximum(a.t, b.t), np.minimum(a.r, b.r), np.minimum(a.b, b.b)  # noqa: E741
    xo, yo = r - l, low - t
    over = (xo > 0) & (yo > 0)
    beside = (2 * yo >= np.minimum(a.b - a.t, b.b - b.t)) & (xo > -c)
    below = (2 * xo >= np.minimum(a.r - a.l, b.r - b.l)) & (yo > -c)
    gap = Rects(a.page, np.where(beside, r, l), np.where(beside, t, low), np.where(beside, l, r), np.where(beside, low, t))
    return over, ~over & (beside | below), gap


def close_lists(components: DataFrame, blockers: DataFrame, char_length: Column, key: str, carried: Sequence[str] = ()) -> DataFrame:
    """(key, items, covers): the components of each page (comp_id, l, t, r, b, _c, and what is carried) and its blockers (l, t, r, b), in one shuffle."""
    own = components.withColumn("_c", char_length).select(key, F.struct("comp_id", *"ltrb", "_c", *carried).alias("_own"))
    others = blockers.select(key, F.struct(*"ltrb").alias("_other"))
    both = own.unionByName(others, allowMissingColumns=True)
    return both.groupBy(key).agg(F.collect_list("_own").alias("items"), F.collect_list("_other").alias("covers"))


def close_runs(batch: pa.RecordBatch, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of the pairs of components (places among the structs of `items`, the smaller comp_id first) of `close_lists` that are close; see `close_components`."""
    page, items = flat(batch, "items")
    own, order = in_order(page, items, "ltrb")
    c, ids = np.nan_to_num(numbers(items, "_c"), nan=-np.inf)[order], ids_of(items, "comp_id")[order]
    for i, j in close_pairs(own, ids, c, in_order(*flat(batch, "covers"), "ltrb")[0], batch.num_rows, most):
        yield order[i], order[j]


def close_pairs(own: Rects, ids: np.ndarray, c: np.ndarray, covers: Rects, n: int, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of the pairs of components of n pages that are close; components (with ids and character lengths c) and covers are in order of page and t."""
    covers = covers.at(np.flatnonzero((covers.l < covers.r) & (covers.t < covers.b)))
    reach = np.zeros(n)
    np.maximum.at(reach, own.page, c)
    for i, j in near_pairs(own, reach[own.page], most):
        i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
        over, near, gap = _between(own, i, j, c[i])
        near &= (gap.l < gap.r) & (gap.t < gap.b) & (ids[i] != ids[j])
        at = np.flatnonzero(near)
        near[at[blocked(gap.at(at), covers, 0.1, most)]] = False
        found = (over & (ids[i] != ids[j])) | near
        yield i[found], j[found]


def meeting(own: Rects, others: Rects, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of the pairs (i, k) of rectangles of both sides that share an area. Both are in order of page and t; all pairs of an i are in one run."""
    if not len(own.l) or not len(others.l):
        return
    places = Places(own.t, own.b, others.t, others.b)
    start = np.searchsorted(np.maximum.accumulate(places.of(others.page, others.b)), places.of(own.page, own.t), "left")
    end = np.searchsorted(places.of(others.page, others.t), places.of(own.page, own.b), "left")
    for part in runs(np.maximum(end - start, 0), most):
        i, k = ranges(start[part], end[part])
        i += part.start
        a, b = own.at(i), others.at(k)
        there = (a.page == b.page) & (np.minimum(a.r, b.r) > np.maximum(a.l, b.l)) & (np.minimum(a.b, b.b) > np.maximum(a.t, b.t))
        yield i[there], k[there]


def best_covers(own: Rects, places: np.ndarray, others: Rects, whose: np.ndarray, n: int, ids: np.ndarray, least: float, most: int = PAIRS) -> np.ndarray:
    """For each of n structs which other one has the largest IoU above `least` with it, the smallest id of equals; -1 for none."""
    out = np.full(n, -1, np.int64)
    for i, k in meeting(own, others, most):
        a, b = own.at(i), others.at(k)
        common = (np.minimum(a.r, b.r) - np.maximum(a.l, b.l)) * (np.minimum(a.b, b.b) - np.maximum(a.t, b.t))
        share = common / ((b.r - b.l) * (b.b - b.t) + (a.r - a.l) * (a.b - a.t) - common + 1e-8)
        good = np.flatnonzero(share > least)
        i, k, share = i[good], whose[k[good]], share[good]
        order = np.lexsort((ids[k], -share, i))
        first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
        out[places[i[first]]] = k[first]
    return out
