"""Reports over a page's blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.aggregates import ordered_concat
from pagewright.operators.filters import PAGE


def coords_report(blocks: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """(keys, report): for each block, in order, its text, score, corners and angle, for people to read."""
    corners = [F.get("box", F.lit(k)) for k in range(8)]
    angle = F.coalesce(F.get(F.array(*[F.lit(f"{a} deg") for a in (0, 90, 180, 270)]), F.col("angle")), F.lit("unknown"))
    known = F.when(F.col("angle").between(0, 3), angle).otherwise("unknown")
    line = F.format_string(
        "block %d: %s\n  score: %.4f\n  box: (%d,%d) - (%d,%d) - (%d,%d) - (%d,%d)\n  angle: %s (score: %.4f)", F.col("block_id") + 1, F.col("text"), F.col("score").cast("double"), *corners, known, F.col("angle_score").cast("double")
    )
    return blocks.groupBy(*keys).agg(ordered_concat("block_id", line, "\n\n").alias("report"))
