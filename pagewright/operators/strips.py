"""Areas of many rectangles without their pairs: rectangles are cut into strips between neighbouring edges, and each strip is swept from top to bottom.

The x axis is dealt in bands first, so that a rectangle meets the edges of its own bands only. With whole coordinates a band of n units has
at most n strips, however many rectangles lie in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_bands(rows: DataFrame, band: Column | int) -> DataFrame:
    """Rectangles (l, t, r, b) with a positive area, cut at bands of x (`_band`)."""
    wide = band if isinstance(band, Column) else F.lit(band)
    rows = rows.filter("l < r and t < b").withColumn("_band", F.explode(F.sequence(F.floor(F.col("l") / wide), F.ceil(F.col("r") / wide) - 1)))
    return rows.withColumns({"l": F.greatest("l", F.col("_band") * wide), "r": F.least("r", (F.col("_band") + 1) * wide)})


def in_strips(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pieces (keys, _band, l, t, r, b) once for each strip of their band that they cover: (keys, _band, x, width, t, b).

    A band's edges reach its pieces by a window: where the pieces lie together by page nothing is shuffled.
    """
    own = [*keys, "_band"]
    band = Window.partitionBy(*own)
    edges = F.array_sort(F.array_union(F.collect_set("l").over(band), F.collect_set("r").over(band)))
    strips = F.zip_with("_edges", F.slice("_edges", 2, F.greatest(F.size("_edges") - 1, F.lit(1))), lambda x, y: F.struct(x.alias("x"), (y - x).alias("width")))
    rows = pieces.select(*own, *"ltrb").withColumn("_edges", edges)
    covered = F.filter(strips, lambda s: (F.col("l") <= s["x"]) & (s["x"] < F.col("r")))
    return rows.select(*own, "t", "b", F.explode(covered).alias("s")).select(*own, "s.x", "s.width", "t", "b")


def in_met_strips(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What `in_strips` gives, for very many keys of few pieces each: a window for every key would cost more than a join."""
    own = [*keys, "_band"]
    edges = pieces.select(*own, F.explode(F.array("l", "r")).alias("x")).distinct()
    edges = edges.withColumn("width", F.lead("x").over(Window.partitionBy(*own).orderBy("x")) - F.col("x")).filter("width is not null")
    return pieces.join(edges.hint("merge"), own).filter("l <= x and x < r").select(*own, "x", "width", "t", "b")


def area_by_depth(rows: DataFrame, keys: Sequence[str], weight, out: str, band: Column | int = 256) -> DataFrame:
    """(keys, out): the area of the plane, each point counted `weight(depth)` times, depth being how many of the keys' rectangles hold it.

    In a strip the depth is a running sum of the tops and bottoms passed; between two of them it stands still.
    """
    return depth_in_strips(in_strips(in_bands(rows, band), keys), keys, weight, out)


def depth_in_strips(strips: DataFrame, keys: Sequence[str], weight, out: str) -> DataFrame:
    """`area_by_depth` of rectangles that are cut in strips."""
    strip = [*keys, "_band", "x", "width"]
    ends = F.explode(F.array(F.struct(F.col("t").alias("y"), F.lit(1).alias("step")), F.struct(F.col("b").alias("y"), F.lit(-1).alias("step")))).alias("e")
    steps = strips.select(*strip, ends).groupBy(*strip, F.col("e.y").alias("y")).agg(F.sum("e.step").alias("step"))
    order = Window.partitionBy(*strip).orderBy("y")
    steps = steps.withColumn("depth", F.sum("step").over(order)).withColumn("high", F.lead("y").over(order) - F.col("y"))
    area = (F.col("width") * F.col("high")).cast(rows.schema["l"].dataType if strips.schema["x"].dataType.simpleString() in ("float", "double") else "long")
    return steps.filter("high is not null and depth > 0").groupBy(*keys).agg(F.sum(area * weight(F.col("depth"))).alias(out))


def covered_area(areas: DataFrame, covers: DataFrame, key: str, ids: Sequence[str], out: str = "covered", band: int = 256) -> DataFrame:
    """(key, ids, out): of each area (key, ids, l, t, r, b) what the key's covers (key, l, t, r, b) cover together, each point once.

    Areas and covers meet by key and band of x; equal pieces of several covers are one. Areas that nothing covers have no row.
    """
    own = [key, *ids]
    a = in_bands(areas.select(*own, *"ltrb"), band).select(*own, "_band", *[F.col(c).alias(f"a_{c}") for c in "ltrb"])
    pairs = a.join(in_bands(covers.select(key, *"ltrb"), band).hint("merge"), [key, "_band"])
    low = {c: F.greatest(c, f"a_{c}").alias(c) for c in "lt"}
    high = {c: F.least(c, f"a_{c}").alias(c) for c in "rb"}
    pieces = pairs.select(*own, *low.values(), *high.values()).filter("l < r and t < b").distinct()
    return depth_in_strips(in_met_strips(in_bands(pieces, band), own), own, lambda depth: F.lit(1), out)
