"""Geometry columns over boxes, rectangles and ruled lines.

A box is an array of eight numbers, x and y of the top left, top right, bottom right and bottom left corner. A rectangle
is given by four columns: left, top, right, bottom.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degrees up to which a page counts as upright, and up to which a line counts as horizontal or vertical.
UPRIGHT_DEG = 3.0
SNAP_DEG = 5.0


class Rect(NamedTuple):
    left: Column
    top: Column
    right: Column
    bottom: Column


def rect(prefix: str = "") -> Rect:
    """The rectangle in the columns <prefix>l, <prefix>t, <prefix>r, <prefix>b."""
    return Rect(*(F.col(f"{prefix}{c}") for c in "ltrb"))


def corner(box: Column, i: int) -> tuple[Column, Column]:
    return F.get(box, F.lit(2 * i)), F.get(box, F.lit(2 * i + 1))


def aabb(box: Column) -> Rect:
    """The upright rectangle around a box."""
    xs, ys = zip(*(corner(box, i) for i in range(4)), strict=True)
    return Rect(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def block_angle(box: Column) -> Column:
    """The direction of the longer of the top and right sides, in radians, folded to [-90 + 3, 90 + 3) degrees."""
    (x0, y0), (x1, y1), (x2, y2) = (corner(box, i) for i in range(3))
    tall = F.hypot(x1 - x0, y1 - y0) < F.hypot(x2 - x1, y2 - y1)
    angle = F.when(tall, F.atan2(y2 - y1, x2 - x1)).otherwise(F.atan2(y1 - y0, x1 - x0))
    fold = math.radians(UPRIGHT_DEG)
    return F.when(angle < -math.pi / 2 + fold, angle + math.pi).when(angle >= math.pi / 2 + fold, angle - math.pi).otherwise(angle)


def rotate_box(box: Column, radians: Column) -> Rect:
    """The upright rectangle around a box that is turned back by `radians` about the origin."""
    c, s = F.cos(-radians), F.sin(-radians)
    xs = [c * x - s * y for x, y in (corner(box, i) for i in range(4))]
    ys = [s * x + c * y for x, y in (corner(box, i) for i in range(4))]
    return Rect(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def rotate_rect_ccw90(r: Rect, cx: Column, cy: Column) -> Rect:
    """A rectangle turned a quarter against the clock about half extents (cx, cy)."""
    return Rect(r.top + cx - cy, cx + cy - r.right, r.bottom + cx - cy, cx + cy - r.left)


def rotate_box_ccw90(box: Column, cx: Column, cy: Column) -> Column:
    """The eight numbers of a box turned a quarter against the clock, rounded half away from zero."""
    out = []
    for i in range(4):
        x, y = corner(box, i)
        out += [F.round(y + cx - cy).cast("int"), F.round(cx + cy - x).cast("int")]
    return F.array(*out)


def _span(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))


def overlap_area(a: Rect, b: Rect) -> Column:
    """The common area of two rectangles, 0 if they don't meet."""
    return _span(a.left, a.right, b.left, b.right) * _span(a.top, a.bottom, b.top, b.bottom)


def area(r: Rect) -> Column:
    return (r.right - r.left) * (r.bottom - r.top)


def iou(a: Rect, b: Rect) -> Column:
    """Common area by joint area; 0 if they don't meet."""
    common = overlap_area(a, b).cast("double")
    return F.when(common > 0, common / (area(a) + area(b) - common + F.lit(1e-8))).otherwise(0.0)


def corner_distance(a: Rect, b: Rect) -> Column:
    """The four edge differences, plus the smaller of the top left and the bottom right ones."""
    one = F.abs(a.left - b.left) + F.abs(a.top - b.top)
    two = F.abs(a.right - b.right) + F.abs(a.bottom - b.bottom)
    return one + two + F.least(one, two)


def alignment(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two intervals by the longer one (0.01 at least); negative if they are apart, by the gap."""
    longest = F.greatest(a1 - a0, b1 - b0, F.lit(0.01))
    return (F.least(a1, b1) - F.greatest(a0, b0)) / longest


def closeness(a: Rect, b: Rect) -> tuple[Column, Column, Column]:
    """(gap, column alignment, row alignment): the gap is downwards if the columns overlap, else to the right."""
    columns, rows = alignment(a.left, a.right, b.left, b.right), alignment(a.top, a.bottom, b.top, b.bottom)
    return F.when(columns > 0, b.top - a.bottom).otherwise(b.left - a.right), columns, rows


def spacing_match(a: Rect, b: Rect, within: float = 0.15):
    """Heights alike within 15 %, and base lines (a tenth above the bottom) about 1.2 heights apart.

    In plain arithmetic, so that columns and arrays of numbers do alike.
    """
    ha, hb = a.bottom - a.top, b.bottom - b.top
    slack = (ha + hb) / 2 * within
    base_a, base_b = a.bottom - ha * 0.1, b.bottom - hb * 0.1
    apart, most, least = base_b - base_a, ha * 1.2 + slack, ha * 1.2 - slack
    spaced = (apart <= most) & (apart >= -most) & ((apart >= least) | (apart <= -least))
    unsure = (base_a <= 0) | (base_b <= 0)
    return (ha > 0) & (hb > 0) & (ha - hb <= slack) & (hb - ha <= slack) & (unsure | spaced)


#: Names of places in a box; any other name is the centre.
PLACES = {"topleft": "topleft", "左上": "topleft", "topright": "topright", "右上": "topright", "bottomleft": "bottomleft", "左下": "bottomleft", "bottomright": "bottomright", "右下": "bottomright"}


def place_of(loc: Column) -> Column:
    """The canonical name of a place, `center` for unknown ones and null."""
    names = F.create_map(*[F.lit(x) for pair in PLACES.items() for x in pair])
    return F.coalesce(F.element_at(names, loc), F.lit("center"))


def _by_place(loc: Column, centre: Column, **places: Column) -> Column:
    place, out = place_of(loc), None
    for name, value in places.items():
        out = F.when(place == name, value) if out is None else out.when(place == name, value)
    return out.otherwise(centre)


def truncated(value: Column) -> Column:
    """Towards zero, as an int."""
    return value.cast("int")


def anchor_point(box: Column, loc: Column) -> tuple[Column, Column]:
    """x and y of a corner of a box, or of its centre: the mean of the corners, truncated."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = (corner(box, i) for i in range(4))
    x = _by_place(loc, truncated((x0 + x1 + x2 + x3) / 4), topleft=x0, topright=x1, bottomleft=x3, bottomright=x2)
    y = _by_place(loc, truncated((y0 + y1 + y2 + y3) / 4), topleft=y0, topright=y1, bottomleft=y3, bottomright=y2)
    return x, y


def point_between(box: Column, loc: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """x and y of a stretch of a box's text, from share `start` to `end` of its width: its corners or its middle."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = (corner(box, i) for i in range(4))
    x = _by_place(
        loc,
        x0 + truncated((start + end) / 2 * (x1 - x0)),
        topleft=x0 + truncated(start * (x1 - x0)),
        topright=x0 + truncated(end * (x1 - x0)),
        bottomleft=x3 + truncated(start * (x2 - x3)),
        bottomright=x3 + truncated(end * (x2 - x3)),
    )
    y = _by_place(loc, truncated((y0 + y3) / 2), topleft=y0, topright=y1, bottomleft=y3, bottomright=y2)
    return x, y


def line_props(x1: Column, y1: Column, x2: Column, y2: Column) -> dict[str, Column]:
    """length, angle in degrees, and whether a line is exactly horizontal or vertical (180 or 0, and 90, whole degrees)."""
    angle = F.degrees(F.atan2(y2 - y1, x2 - x1))
    return {"length": F.hypot(x2 - x1, y2 - y1), "angle": angle, "horizontal": y1 == y2, "vertical": x1 == x2}


def snap_line(x1: Column, y1: Column, x2: Column, y2: Column, degrees: float = SNAP_DEG) -> tuple[Column, Column, Column, Column]:
    """The line with ordered ends; one within 5 degrees of horizontal or vertical is put on its rounded middle."""
    dx, dy = F.abs(x2 - x1), F.abs(y2 - y1)
    slope = F.degrees(F.atan2(dy, dx))
    flat, upright = slope <= degrees, slope >= 90 - degrees
    my, mx = F.round((y1 + y2) / 2).cast("int"), F.round((x1 + x2) / 2).cast("int")
    return (
        F.when(upright, mx).otherwise(F.least(x1, x2)),
        F.when(flat, my).otherwise(F.least(y1, y2)),
        F.when(upright, mx).otherwise(F.greatest(x1, x2)),
        F.when(flat, my).otherwise(F.greatest(y1, y2)),
    )


def scale_params(w: Column, h: Column, target: int) -> dict[str, Column]:
    """The size to which a page is scaled so that its long side is `target`: multiples of 32, 32 at least; and the ratios."""
    ratio = F.lit(float(target)) / F.greatest(w, h)
    dw, dh = F.greatest((w * ratio / 32).cast("int") * 32, F.lit(32)), F.greatest((h * ratio / 32).cast("int") * 32, F.lit(32))
    return {"dst_w": dw, "dst_h": dh, "ratio_w": dw / w, "ratio_h": dh / h}


def unclip_distance(box: Column, ratio: float) -> Column:
    """How far a box is grown: its shoelace area x ratio by its perimeter; 0 for a point."""
    p = [corner(box, i) for i in range(4)]
    q = p[1:] + p[:1]
    twice = F.abs(sum((a[0] * b[1] - b[0] * a[1] for a, b in zip(p, q, strict=True)), F.lit(0)))
    around = sum((F.hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(p, q, strict=True)), F.lit(0.0))
    return F.when(around > 0, twice / 2 * ratio / around).otherwise(0.0)


def restore_box(box: Column, ratio_w: Column, ratio_h: Column, pad: int, w: Column, h: Column) -> Column:
    """A box of the scaled page on the original: divided by the ratios, truncated, kept on the page, less the padding."""
    out = []
    for i in range(4):
        x, y = corner(box, i)
        out += [
            F.least(F.greatest(truncated(x / ratio_w), F.lit(0)), w - 1) - pad,
            F.least(F.greatest(truncated(y / ratio_h), F.lit(0)), h - 1) - pad,
        ]
    return F.array(*out)


def order_corners(box: Column) -> Column:
    """The eight numbers in the order top left, top right, bottom right, bottom left: left pair and right pair, each by y."""
    points = F.array_sort(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in (corner(box, i) for i in range(4))]))
    a, b, c, d = (F.get(points, F.lit(i)) for i in range(4))

    def pick(yes: Column, one: Column, other: Column) -> Column:
        return F.when(yes, one).otherwise(other)

    left_up, right_up = b["y"] > a["y"], d["y"] > c["y"]
    tl, bl = pick(left_up, a, b), pick(left_up, b, a)
    tr, br = pick(right_up, c, d), pick(right_up, d, c)
    return F.array(*[p[k] for p in (tl, tr, br, bl) for k in ("x", "y")])
