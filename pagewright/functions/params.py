"""Parameters: defaults for zeros, regions and page specifications written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a zero stands for.
DEFAULTS = {"padding": 50, "max_side_len": 1024, "box_score_thresh": 0.6, "box_thresh": 0.3, "unclip_ratio": 2.0}


def default_params(**given: Column) -> dict[str, Column]:
    """Each parameter, or its default where it is null or zero."""
    return {k: F.coalesce(F.nullif(given[k], F.lit(0)), F.lit(v)) if k in given else F.lit(v) for k, v in DEFAULTS.items()}


def char_length_choice(mode: Column, mean: Column) -> Column:
    """The mean, if it is at least 1.5 times the mode; else the mode."""
    return F.when(mode * 1.5 <= mean, mean).otherwise(mode)


def parse_region(text: Column) -> Column:
    """struct(x, y, w, h, code) of `x,y,w,h`: four ints, x and y not negative, w and h positive; else code 5 and nulls."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda s: F.trim(s).try_cast("int"))
    x, y, w, h = (F.get(parts, F.lit(i)) for i in range(4))
    ok = F.coalesce((F.size(parts) == 4) & (x >= 0) & (y >= 0) & (w > 0) & (h > 0), F.lit(False))
    values = [F.when(ok, v).alias(n) for n, v in zip("xywh", (x, y, w, h), strict=True)]
    return F.struct(*values, F.when(ok, 0).otherwise(5).alias("code"))


def page_numbers(spec: Column, count: Column) -> Column:
    """The page indices, from 0, that `1,2-5` or `all` selects among `count` pages: in order, each once, out of range none.

    Full-width commas count. `all` counts only on its own; bad pieces and ranges that run backwards select nothing.
    """
    whole = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    pieces = F.split(F.translate(F.coalesce(spec, F.lit("")), "，", ","), ",")

    def pages(piece: Column) -> Column:
        first = F.regexp_extract(piece, r"^\s*(\d+)\s*(?:-\s*\d+\s*)?$", 1).try_cast("int")
        last = F.coalesce(F.regexp_extract(piece, r"^\s*\d+\s*-\s*(\d+)\s*$", 1).try_cast("int"), first)
        a, b = F.greatest(first, F.lit(1)), F.least(last, count)
        return F.when(first.isNotNull() & (first <= last) & (a <= b), F.sequence(a - 1, b - 1)).otherwise(F.array().cast("array<int>"))

    chosen = F.array_sort(F.array_distinct(F.flatten(F.transform(pieces, pages))))
    return F.when(F.lower(F.trim(spec)).isin("all", ""), whole).otherwise(chosen)
