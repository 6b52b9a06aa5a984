"""Queries over recognition steps and column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import aggregates as A
from pagewright.operators import windows as W
from pagewright.queries import Query
from pagewright.sources import derived as D

STEPS, PROFILE = D.with_sql("steps"), D.with_sql("profile")


def _win05(spark, sf_dir):
    out = W.collapse_runs(D.steps(spark, sf_dir))
    return out.select("line_id", "symbols", F.col("n").cast("long").alias("n"), F.round(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_WIN05 = STEPS + """, p AS (SELECT *, lag(cls) OVER (PARTITION BY line_id ORDER BY t) AS b FROM steps)
SELECT line_id, string_agg(CAST(cls AS VARCHAR), ',' ORDER BY t) AS symbols, count(*) AS n, round(sum(score), 6) AS total FROM p WHERE cls <> 0 AND (b IS NULL OR b <> cls) GROUP BY line_id"""

_RUNS = """, d AS (SELECT item_id, x, x - lag(x) OVER w - 1 AS gap FROM profile WHERE dark > 0 WINDOW w AS (PARTITION BY item_id ORDER BY x)),
g AS (SELECT *, sum(CASE WHEN gap >= {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY x) AS run FROM d),
s AS (SELECT item_id, run, min(x) AS "start", max(x) + 1 AS "end" FROM g GROUP BY item_id, run HAVING max(x) + 1 - min(x) >= {width})
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY "start") - 1 AS INTEGER) AS seg, "start", "end" FROM s"""


def _win03(spark, sf_dir):
    return W.band_by_gap(D.profile(spark, sf_dir).filter("dark > 0"), "x", 2.0, ("item_id",)).select("item_id", "x", F.col("band").cast("int").alias("band"))


def _agg10(spark, sf_dir):
    rows = D.profile(spark, sf_dir).filter("dark > 0").select("item_id", F.col("x").alias("a"), (F.col("x") + 1 + F.col("x") % 4).alias("b"))
    return A.interval_union_length(rows, "a", "b", ("item_id",)).select("item_id", F.col("union_length").cast("long").alias("union_length"))


_AGG10 = PROFILE + """, i AS (SELECT item_id, x AS a, x + 1 + x % 4 AS b FROM profile WHERE dark > 0), c AS (SELECT DISTINCT item_id, unnest(range(a, b)) AS k FROM i) SELECT item_id, count(*) AS union_length FROM c GROUP BY item_id"""


def _agg21(spark, sf_dir):
    pixels = D.given(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.posexplode("embedding").alias("at", "v"))
    pixels = pixels.select("item_id", (F.col("at") % 16).alias("x"), F.expr("at div 16").alias("y"), F.when(F.col("v") > 0.05, 120).otherwise(230).alias("grey"))
    return A.column_profile(pixels)


_AGG21 = """SELECT item_id, CAST(k % 16 AS INTEGER) AS x, CAST(count(*) FILTER (v > 0.05) AS INTEGER) AS dark FROM (SELECT vec_id AS item_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS k FROM embeddings) GROUP BY ALL"""

QUERIES = {
    "win_03_band_by_gap": Query(_win03, PROFILE + ", d AS (SELECT item_id, x, x - lag(x) OVER w AS gap FROM profile WHERE dark > 0 WINDOW w AS (PARTITION BY item_id ORDER BY x)) SELECT item_id, x, CAST(sum(CASE WHEN gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY x) AS INTEGER) AS band FROM d"),
    "win_05_collapse_runs": Query(_win05, _WIN05),
    "win_06_best_class": Query(lambda s, d: W.best_class(D.steps(s, d)).select("line_id", "t", "best", "best_score"), STEPS + " SELECT line_id, t, cls AS best, 1.0::DOUBLE AS best_score FROM steps"),
    "win_09_column_segments": Query(lambda s, d: W.column_segments(D.profile(s, d), 20), PROFILE + _RUNS.format(gap=4, width=3)),
    "win_09_page_segments": Query(lambda s, d: W.column_segments(D.profile(s, d), 20, gap=(8, 0.20), width=(6, 0.10)), PROFILE + _RUNS.format(gap=8, width=6)),
    "agg_10_interval_union": Query(_agg10, _AGG10),
    "agg_21_column_profile": Query(_agg21, _AGG21),
}
