"""Cells of tables over arrays: all tables of an Arrow batch at once. Each function takes the table (or page) of every cell, as its place in the batch, and
whole coordinates as doubles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from pagewright.operators import sweeps as S


def coded(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of each owner in order: (owner, value) of them, and for each given value which of them it is."""
    distinct, code = np.unique(values, return_inverse=True)
    own, at = np.unique(owner * len(distinct) + code, return_inverse=True)
    return own // max(len(distinct), 1), distinct[own % max(len(distinct), 1)], at


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Where rows that are in order begin a new key."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def places(owner: np.ndarray) -> np.ndarray:
    """The place of each row among those of its owner, from 0; rows of an owner lie together."""
    starts = firsts(owner)
    return np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))


class Slots:
    """The grid of each of n tables: a row between neighbouring edges of y, a column between those of x. Slots are numbered table by table, row by row.

    Cells without an edge unknown give the edges, so a cell covers the slots that it meets in whole.
    """

    def __init__(self, table: np.ndarray, cells: S.Rects, n: int) -> None:
        self.sides = []
        for low, high in ((cells.t, cells.b), (cells.l, cells.r)):
            owner, value, at = coded(np.concatenate([table, table]), np.concatenate([low, high]))
            first = np.searchsorted(owner, np.arange(n + 1))
            self.sides.append((value, first, at[: len(table)], at[len(table) :], np.maximum(np.diff(first) - 1, 0)))
        rows, cols = self.sides[0][4], self.sides[1][4]
        self.base = np.append(0, np.cumsum(rows * cols))
        self.table = np.repeat(np.arange(n), rows * cols)
        place = np.arange(self.base[-1]) - self.base[self.table]
        self.row, self.col = place // np.maximum(cols[self.table], 1), place % np.maximum(cols[self.table], 1)
        self.y, self.x = (first[self.table] + at for (_, first, *_), at in zip(self.sides, (self.row, self.col), strict=True))
        (ys, *_), (xs, *_) = self.sides
        self.box = S.Rects(self.table, xs[self.x], ys[self.y], xs[self.x + 1], ys[self.y + 1])


def slot_cells(table: np.ndarray, cells: S.Rects, n: int, most: int = S.PAIRS) -> tuple[Slots, S.Rects]:
    """The slots of n tables, and for each the box of the smallest cell that covers it; else, where its row has cells, a filler without width at the edge
    nearest to it; else its own. Pairs of slots and cells are made in runs of `most`."""
    slots = Slots(table, cells, n)
    size = (cells.r - cells.l) * (cells.b - cells.t)
    order = np.lexsort((cells.b, cells.r, cells.t, cells.l, size))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    (_, first_y, top, bottom, _), (_, first_x, left, right, cols) = slots.sides
    tall, wide = np.maximum(bottom - top, 0), np.maximum(right - left, 0)
    best = np.full(len(slots.table), len(order))
    for part in S.runs(tall * wide, most):
        i, row = S.ranges(top[part], bottom[part])
        i += part.start
        k, col = S.ranges(left[i], right[i])
        i, row = i[k], row[k]
        np.minimum.at(best, slots.base[table[i]] + (row - first_y[table[i]]) * cols[table[i]] + col - first_x[table[i]], rank[i])
    found = best < len(order)
    own = order[np.minimum(best, max(len(order) - 1, 0))]
    out = [np.where(found, side[own], plain) for side, plain in zip(cells[1:], slots.box[1:], strict=True)]
    free = np.flatnonzero(~found)
    if len(free):
        i, row = S.ranges(top, bottom)  # the cells of each row that has free slots
        wanted = np.isin(row, slots.y[free])
        i, row = i[wanted], row[wanted]
        i, row = i[order_ := np.argsort(row, kind="stable")], row[order_]
        start, end = np.searchsorted(row, slots.y[free], "left"), np.searchsorted(row, slots.y[free], "right")
        for part in S.runs(2 * (end - start), most):
            f, c = S.ranges(start[part], end[part])
            f, c = np.concatenate([f, f]) + part.start, np.concatenate([i[c], i[c]])
            edge = np.where(np.arange(len(c)) < len(c) // 2, cells.l[c], cells.r[c])
            slot = free[f]
            apart = np.minimum(np.abs(edge - slots.box.l[slot]), np.abs(edge - slots.box.r[slot]))
            by = np.lexsort((edge, cells.b[c], cells.r[c], cells.t[c], cells.l[c], apart, slot))
            by = by[firsts(slot[by])]
            out[0][slot[by]] = out[2][slot[by]] = edge[by]
    return slots, S.Rects(slots.table, *out)


def delimiters(table: np.ndarray, values: np.ndarray, k: float, min_gap: float) -> tuple[np.ndarray, np.ndarray]:
    """(table, d) in order: the rounded mean of each cluster of a table's distinct values; a gap above k times the table's median gap and above min_gap parts them.
    With one or two gaps the smallest stands for the median."""
    owner, value, _ = coded(table, values)
    if not len(owner):
        return owner, value
    starts = firsts(owner)
    inner = np.ones(len(owner), bool)
    inner[starts] = False
    gap = np.append(0.0, np.diff(value))
    at = np.flatnonzero(inner)
    at = at[np.lexsort((gap[at], owner[at]))]
    group = np.cumsum(~inner) - 1
    n = np.bincount(group[at], minlength=len(starts))
    first = np.cumsum(n) - n
    sorted_gaps = np.append(gap[at], 0.0)
    low, high = first + np.maximum(n - 1, 0) // 2, first + n // 2
    low, high = np.minimum(low, len(at)), np.minimum(high, len(at))
    typical = np.where(n > 2, (sorted_gaps[low] + sorted_gaps[high]) / 2, sorted_gaps[np.minimum(first, len(at))])
    opens = inner & (gap > np.maximum(typical[group] * k, min_gap))
    cluster = np.cumsum(opens | ~inner) - 1
    mean = np.bincount(cluster, weights=value) / np.bincount(cluster)
    whole = np.floor(np.abs(mean) + 0.5) * np.sign(mean)
    return owner[opens | ~inner], whole


def nearest(table: np.ndarray, values: np.ndarray, owner: np.ndarray, delims: np.ndarray) -> np.ndarray:
    """For each value the nearest delimiter (owner, delims, in order) of its table, the smaller of two; NaN for tables without any."""
    if not len(values) or not len(delims):
        return np.full(len(values), np.nan)
    places = S.Places(values, delims)
    at = np.searchsorted(places.of(owner, delims), places.of(table, values), "left")
    before, after = np.maximum(at - 1, 0), np.minimum(at, len(delims) - 1)
    has_before, has_after = (at > 0) & (owner[before] == table), (at < len(delims)) & (owner[after] == table)
    nearer = np.where(~has_after | (has_before & (values - delims[before] <= delims[after] - values)), delims[before], delims[after])
    return np.where(has_before | has_after, nearer, np.nan)


#: A cell waits for the smaller ones that it meets; pages on which it takes more rounds than these are worked off cell by cell.
ROUNDS = 16


def deduped(page: np.ndarray, cells: S.Rects, alone: Callable[[list[tuple]], list[tuple]], most: int = S.PAIRS) -> np.ndarray:
    """Which cells are kept: of each page's distinct cells, smallest first, those of which at least a quarter isn't covered by those kept before.

    A cell that meets no smaller one is kept, and one whose smaller ones are all decided is decided by what the kept ones cover of it; so all pages go together,
    in few rounds. Pages of more than `most` pairs, or of long chains, go through `alone`, which keeps no pairs.
    """
    own = np.flatnonzero((cells.r > np.maximum(cells.l, 0)) & (cells.b > np.maximum(cells.t, 0)))
    area = (cells.r - cells.l) * (cells.b - cells.t)
    own = own[np.lexsort((cells.b[own], cells.r[own], cells.t[own], cells.l[own], area[own], page[own]))]
    own = own[firsts(page[own], *(side[own] for side in cells[1:]))]
    rank = np.empty(len(page), np.int64)
    rank[own] = np.arange(len(own))
    own = own[np.lexsort((cells.t[own], page[own]))]
    rects = S.Rects(page[own], *(np.maximum(side[own], 0.0) for side in cells[1:]))
    places = S.Places(rects.t, rects.b)
    last = np.searchsorted(places.of(rects.page, rects.t), places.of(rects.page, rects.b), "left")
    starts = np.append(firsts(rects.page), len(own)) if len(own) else np.zeros(1, int)
    counts = np.append(0, np.cumsum(np.maximum(last - np.arange(len(own)) - 1, 0)))[starts]
    kept: list[np.ndarray] = []
    for part in S.runs(np.diff(counts), most):
        a, b = starts[part.start], starts[part.stop]
        some = slice(a, b)
        if counts[part.stop] - counts[part.start] > most:
            undecided = np.ones(b - a, bool)
            state = np.zeros(b - a, np.int8)
        else:
            state = _decided(rects.at(some), rank[own[some]], 0.25 * area[own[some]], most)
            undecided = np.isin(rects.page[some], rects.page[some][state == 0])
        kept.append(own[some][(state == 1) & ~undecided])
        for p in np.unique(rects.page[some][undecided]):
            whose = own[some][rects.page[some] == p]
            boxes = [tuple(int(side[i]) for side in cells[1:]) for i in whose]
            good = set(alone(boxes))
            kept.append(whose[[box in good for box in boxes]])
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _decided(own: S.Rects, rank: np.ndarray, wanted: np.ndarray, most: int) -> np.ndarray:
    """1 for the cells that are kept, 2 for those that aren't, 0 where it takes too many rounds."""
    pairs = list(S.near_pairs(own, np.zeros(len(own.t)), most))
    i, j = (np.concatenate([p[side] for p in pairs]) if pairs else np.zeros(0, np.int64) for side in (0, 1))
    cut = S.Rects(own.page[i], np.maximum(own.l[i], own.l[j]), np.maximum(own.t[i], own.t[j]), np.minimum(own.r[i], own.r[j]), np.minimum(own.b[i], own.b[j]))
    met = np.flatnonzero((cut.l < cut.r) & (cut.t < cut.b))
    i, j, cut = i[met], j[met], cut.at(met)
    early, late = np.where(rank[i] < rank[j], i, j), np.where(rank[i] < rank[j], j, i)
    size = (cut.r - cut.l) * (cut.b - cut.t)
    allowed = (own.r - own.l) * (own.b - own.t) - wanted
    state = np.zeros(len(own.t), np.int8)
    for _ in range(ROUNDS):
        waits = np.zeros(len(state), bool)
        waits[late[state[early] == 0]] = True
        ready = (state == 0) & ~waits
        if not ready.any():
            break
        use = np.flatnonzero(ready[late] & (state[early] == 1))
        covered = np.bincount(late[use], weights=size[use], minlength=len(state))
        over = np.flatnonzero(covered[late[use]] > allowed[late[use]])
        whose, place = np.unique(late[use[over]], return_inverse=True)
        covered[whose] = S.union_areas(place, cut.at(use[over]), len(whose), most)
        state[ready] = np.where(covered[ready] <= allowed[ready], 1, 2)
    return state


def _meets(a: S.Rects, b: S.Rects) -> np.ndarray:
    """Pairs of stretches (l, r) whose ends correspond (2 % of the first one's width) or contain one another's."""
    wide = np.where(a.r == a.l, 1.0, a.r - a.l)

    def ends(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (np.abs((x - y) / wide) <= 0.02) | ((a.l <= y) & (y <= a.r)) | ((b.l <= x) & (x <= b.r))

    return ends(a.l, b.l) & ends(a.r, b.r)


def next_lines(page: np.ndarray, left: np.ndarray, right: np.ndarray, y: np.ndarray, most: int = S.PAIRS) -> S.Rects:
    """The candidate cells of horizontal lines: see `joins.next_candidates`. Only stretches of a page that lie near one another are compared, in runs."""
    order = np.lexsort((y, right, left, page))
    order = order[firsts(page[order], left[order], right[order], y[order])]
    page, left, right, y = page[order], left[order], right[order], y[order]
    first = firsts(page, left, right)
    last = np.append(first[1:], len(page))
    stretch = np.repeat(np.arange(len(first)), last - first)
    own = S.Rects(page[first], left[first], left[first], right[first], right[first])
    slack = np.zeros(int(page.max()) + 1 if len(page) else 0)
    np.maximum.at(slack, own.page, 0.02 * np.abs(np.where(own.r == own.l, 1.0, own.r - own.l)))
    places = S.Places(y)
    at = places.of(stretch, y)
    found = [np.zeros((0, 5))]

    def nearest_below(rows: np.ndarray) -> np.ndarray:
        rows = rows[np.lexsort(rows.T[::-1])]
        return rows[firsts(*rows.T[:4])]

    def both_ways():
        yield np.arange(len(first)), np.arange(len(first))
        for i, j in S.near_pairs(own, slack[own.page], most):
            yield np.concatenate([i, j]), np.concatenate([j, i])

    for a, b in both_ways():
        met = np.flatnonzero(_meets(own.at(a), own.at(b)))
        a, b = a[met], b[met]
        for part in S.runs(last[a] - first[a], most):
            pair, line = S.ranges(first[a[part]], last[a[part]])
            over, under = a[part][pair], b[part][pair]
            to = np.searchsorted(at, places.of(under, y[line]), "right")
            good = np.flatnonzero(to < last[under])
            over, under, line, to = over[good], under[good], line[good], to[good]
            found.append(nearest_below(np.stack([page[line], np.maximum(own.l[over], own.l[under]), np.minimum(own.r[over], own.r[under]), y[line], y[to]], 1)))
    rows = nearest_below(np.concatenate(found))
    rows = rows[np.lexsort((-rows[:, 3], rows[:, 4], rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[firsts(rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 4])]
    return S.Rects(rows[:, 0].astype(np.int64), rows[:, 1], rows[:, 3], rows[:, 2], rows[:, 4])


def between_lines(lines: S.Rects, most: int = S.PAIRS) -> S.Rects:
    """The cells between straight lines, before repeated ones go: see `joins.dividers` and `windows.cells_from_dividers`."""
    flat = np.flatnonzero((lines.t == lines.b) & (lines.l != lines.r))
    up = np.flatnonzero((lines.l == lines.r) & (lines.t != lines.b))
    area = next_lines(lines.page[flat], lines.l[flat], lines.r[flat], lines.t[flat], most)
    up = up[np.lexsort((lines.l[up], lines.page[up]))]
    bars = lines.at(up)
    margin = np.maximum(5.0, np.trunc((area.r - area.l) * 0.025))
    high = area.b - area.t
    allowed = np.maximum(5.0, np.minimum(10.0, np.trunc(high * 0.1)))
    places = S.Places(bars.l, area.l - margin, area.r + margin)
    at = places.of(bars.page, bars.l)
    start, end = np.searchsorted(at, places.of(area.page, area.l - margin), "left"), np.searchsorted(at, places.of(area.page, area.r + margin), "right")
    out = []
    for part in S.runs(np.maximum(end - start, 0), most):
        c, v = S.ranges(start[part], end[part])
        c += part.start
        near = high[c] - (np.minimum(area.b[c], bars.b[v]) - np.maximum(area.t[c], bars.t[v])) <= allowed[c]
        c, x = c[near], bars.l[v[near]]
        keep = firsts(c, x)
        c, x = c[keep], x[keep]
        k = np.flatnonzero(c[1:] == c[:-1])
        out.append(S.Rects(area.page[c[k]], x[k], area.t[c[k]], x[k + 1], area.b[c[k]]))
    return S.Rects(*(np.concatenate(side) for side in zip(*out, strict=True))) if out else area


def valid(slots: Slots, boxes: S.Rects, most: int = S.PAIRS) -> np.ndarray:
    """Which tables have a valid shape: see `filters.valid_tables`. Pairs are made for tables only whose boxes lie over one another."""
    n = len(slots.base) - 1
    rows, cols = slots.sides[0][4], slots.sides[1][4]
    order = np.lexsort((boxes.b, boxes.r, boxes.l, boxes.t, boxes.page))
    own = boxes.at(order[firsts(*(side[order] for side in boxes))])
    edges = [np.bincount(coded(np.concatenate([own.page] * 2), np.concatenate(pair))[0], minlength=n) for pair in ((own.l, own.r), (own.t, own.b))]
    shape = (rows >= 2) & (cols >= 2) & (np.bincount(own.page, minlength=n) >= 4) & (edges[0] <= cols + 1) & (edges[1] <= rows + 1)
    solid = own.at(np.flatnonzero((own.l < own.r) & (own.t < own.b)))
    sizes = np.bincount(solid.page, weights=(solid.r - solid.l) * (solid.b - solid.t), minlength=n)
    over = S.union_areas(solid.page, solid, n, most) < sizes
    solid = solid.at(np.flatnonzero(over[solid.page]))
    overlap = np.zeros(n)
    for i, j in S.near_pairs(solid, np.zeros(len(solid.t)), most):
        common = np.maximum(np.minimum(solid.r[i], solid.r[j]) - np.maximum(solid.l[i], solid.l[j]), 0) * np.maximum(np.minimum(solid.b[i], solid.b[j]) - np.maximum(solid.t[i], solid.t[j]), 0)
        overlap += np.bincount(solid.page[i], weights=common, minlength=n)
    ends = []
    for side, least in ((boxes.l, True), (boxes.t, True), (boxes.r, False), (boxes.b, False)):
        end = np.full(n, np.inf if least else -np.inf)
        (np.minimum if least else np.maximum).at(end, boxes.page, side)
        ends.append(end)
    with np.errstate(invalid="ignore"):
        area = (ends[2] - ends[0]) * (ends[3] - ends[1])
    return shape & (2 * overlap < np.floor(np.where(np.isfinite(area), area, 0.0) / 5))


def backfilled(slots: Slots, boxes: S.Rects, text: np.ndarray) -> np.ndarray:
    """Of each slot the number of its text (-1 for none), or that of the first later row's slot of the same column and box."""
    order = np.lexsort((slots.row, boxes.b, boxes.r, boxes.t, boxes.l, slots.col, boxes.page))
    starts = firsts(slots.col[order], *(side[order] for side in boxes))
    end = np.repeat(np.append(starts[1:], len(order)), np.diff(np.append(starts, len(order))))
    own = text[order]
    there = np.where(own >= 0, np.arange(len(own)), len(own))
    after = np.minimum.accumulate(there[::-1])[::-1]
    out = text.copy()
    out[order] = np.where(after < end, own[np.minimum(after, max(len(own) - 1, 0))], -1)
    return out
