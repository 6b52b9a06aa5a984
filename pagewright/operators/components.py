"""Ink components over arrays: all pages of an Arrow batch at once, each component with its page's place in the batch."""

from __future__ import annotations

import numpy as np

from pagewright.operators import cells as C
from pagewright.operators import sweeps as S


def medians(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The median of each of n owners' values, NaN for none."""
    order = np.lexsort((values, owner))
    counts = np.bincount(owner, minlength=n)
    first = np.cumsum(counts) - counts
    own = np.append(values[order], np.nan)
    at = [np.where(counts > 0, first + k, len(values)) for k in (np.maximum(counts - 1, 0) // 2, counts // 2)]
    return (own[at[0]] + own[at[1]]) / 2


def modes(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The most frequent value of each of n owners, the smallest of equals; NaN for none."""
    whose, value, at = C.coded(owner, values)
    order = np.lexsort((value, -np.bincount(at, minlength=len(value)), whose))
    order = order[C.firsts(whose[order])]
    out = np.full(n, np.nan)
    out[whose[order]] = value[order]
    return out


def dotted_lines(own: S.Rects) -> S.Rects:
    """The rectangles of dotted lines, in order of page and t: see `aggregates.dotted_line_areas`."""
    found = []
    for lo, hi, low, high in ((own.l, own.r, own.t, own.b), (own.t, own.b, own.l, own.r)):
        long, thick = hi - lo, high - low
        thin = np.flatnonzero((thick > 0) & (long >= 2.0 * thick) & (thick <= 5))
        mid = (low + high) / 2
        thin = thin[np.lexsort((own.b[thin], own.r[thin], own.t[thin], own.l[thin], mid[thin], own.page[thin]))]
        if not len(thin):
            continue
        new = np.zeros(len(thin), bool)
        new[C.firsts(own.page[thin])] = True
        new[1:] |= np.diff(mid[thin]) > 2.0
        band = np.cumsum(new) - 1
        order = np.lexsort((hi[thin], lo[thin], band))
        thin, band = thin[order], band[order]
        starts = C.firsts(band)
        places = S.Places(lo, hi)
        reach = np.append(-1.0, np.maximum.accumulate(places.of(band, hi[thin]))[:-1])
        opens = places.of(band, lo[thin]) > reach
        opens[starts] = True
        islands = np.flatnonzero(opens)
        lengths = np.bincount(band[islands], weights=np.maximum.reduceat(hi[thin], islands) - lo[thin][islands])
        ends = [(np.minimum if k < 2 else np.maximum).reduceat(side[thin], starts) for k, side in enumerate(own[1:])]
        span = np.maximum(np.maximum.reduceat(hi[thin], starts) - np.minimum.reduceat(lo[thin], starts), 1)
        line = (np.bincount(band) >= 5) & (lengths / span >= 0.66)
        found.append(S.Rects(own.page[thin][starts], *ends).at(np.flatnonzero(line)))
    areas = S.Rects(*(np.concatenate(side) for side in zip(*found, strict=True))) if found else own.at(np.zeros(0, int))
    return areas.at(np.lexsort((areas.t, areas.page)))


def outside(own: S.Rects, areas: S.Rects, limit: float = 0.25) -> np.ndarray:
    """Which rectangles lie in areas by less than `limit`; areas count each. Both are in order of page and t."""
    hit = np.zeros(len(own.t))
    for i, k in S.meeting(own, areas):
        a, b = own.at(i), areas.at(k)
        hit += np.bincount(i, weights=(np.minimum(a.r, b.r) - np.maximum(a.l, b.l)) * (np.minimum(a.b, b.b) - np.maximum(a.t, b.t)), minlength=len(hit))
    size = (own.r - own.l) * (own.b - own.t)
    return (size > 0) & (hit < limit * size)


def usual(own: S.Rects, area: np.ndarray, n: int) -> np.ndarray:
    """Which components have the shape and size of their page's others: see `filters.component_shape` and `component_size`."""
    w, h = own.r - own.l, own.b - own.t
    shaped = (np.maximum(w, h) / np.maximum(1, np.minimum(w, h)) <= 5.0) & (area / np.maximum(1, w * h) > 0.08)
    mw, mh = (medians(own.page[shaped], side[shaped], n)[own.page] for side in (w, h))
    bounded = (w * h >= 0.2 * (mw * mh)) & (w * h <= 5.0 * (mw * mh))
    dash = (w / np.maximum(1, h) >= 2.0) & (w >= 0.5 * mw) & (w <= 1.5 * mw)
    return shaped & (bounded | dash)


def char_lengths(page: np.ndarray, wide: np.ndarray, n: int) -> np.ndarray:
    """The mode of each page's widths, or their mean if that is much larger; NaN for pages without any."""
    mode = modes(page, wide, n)
    with np.errstate(invalid="ignore"):
        mean = np.bincount(page, weights=wide, minlength=n) / np.bincount(page, minlength=n)
        return np.where(mode * 1.5 <= mean, mean, mode)


def attached(left: S.Rects, kept: S.Rects, c: np.ndarray) -> np.ndarray:
    """Which of `left` are near one of `kept`: see `joins.attach_discarded`; c is the character length of each page. Both are in order of page and t."""
    out = np.zeros(len(left.t), bool)
    wide = S.Rects(kept.page, kept.l - c[kept.page] - 1, kept.t, kept.r + c[kept.page] + 1, kept.b)
    for i, k in S.meeting(S.Rects(left.page, left.l - 1, left.t, left.r + 1, left.b), wide):
        d, o = left.at(i), kept.at(k)
        high, o_high = d.b - d.t, o.b - o.t
        shared = np.minimum(d.b, o.b) - np.maximum(d.t, o.t)
        apart = np.minimum.reduce([np.abs(p - q) for p in (d.l, d.r) for q in (o.l, o.r)])
        near = (shared >= np.minimum(high, o_high) * 0.5) & (apart <= c[d.page]) & (np.maximum(high, d.r - d.l) <= 3 * np.maximum(o_high, o.r - o.l))
        out[i[near]] = True
    return out


def boxes_of(page: np.ndarray, label: np.ndarray, own: S.Rects) -> S.Rects:
    """The rectangle around the parts of each label of a page."""
    order = np.lexsort((label, page))
    starts = C.firsts(page[order], label[order])
    if not len(starts):
        return own
    return S.Rects(page[order][starts], *((np.minimum if k < 2 else np.maximum).reduceat(side[order], starts) for k, side in enumerate(own[1:])))


def separations(boxes: S.Rects, half: np.ndarray, most: int = S.PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """(page, distance) of each box that has a lower one sharing more than half[page] in x: the distance of their middles, the least.

    Boxes are in order of their middles, so the first one found below is the nearest; those that wait for one look twice as far each time.
    """
    mid = (boxes.t + boxes.b) / 2
    order = np.lexsort((mid, boxes.page))
    own, mid = boxes.at(order), mid[order]
    end = np.searchsorted(own.page, own.page, "right")
    sep = np.full(len(mid), np.nan)
    waiting, start, ahead = np.arange(len(mid)), np.arange(len(mid)) + 1, 8
    while len(waiting):
        stop = np.minimum(start + ahead, end[waiting])
        for part in S.runs(stop - start, most):
            a, b = S.ranges(start[part], stop[part])
            a = waiting[part][a]
            met = np.flatnonzero((np.minimum(own.r[a], own.r[b]) - np.maximum(own.l[a], own.l[b]) > half[own.page[a]]) & (mid[b] > mid[a]))
            a, b = a[met], b[met]
            first = C.firsts(a)
            sep[a[first]] = mid[b[first]] - mid[a[first]]
        on = np.isnan(sep[waiting]) & (stop < end[waiting])
        waiting, start, ahead = waiting[on], stop[on], 2 * ahead
    found = ~np.isnan(sep)
    return own.page[found], sep[found]
