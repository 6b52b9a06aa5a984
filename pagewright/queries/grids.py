"""Queries from HTML tables to grids and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import pages as P
from pagewright.operators import sets as ST
from pagewright.plans import tables as TB
from pagewright.queries import Query
from pagewright.sources import derived as D
from pagewright.sources import sinks as K

HTML = D.with_sql("html_tables")
#: Raw cells of the derived tables: one per text, but for the merged cell, which has none.
_RAW = HTML + """, g AS (SELECT page_id, block_id // 4 AS r, block_id % 4 AS c, text, max(block_id // 4) OVER (PARTITION BY page_id) + 1 AS n FROM grid_blocks),
m AS (SELECT *, page_id % 5 = 0 AND n >= 2 AND r = 0 AS wide FROM g),
raw AS (SELECT page_id, r, c, CASE WHEN wide AND c = 3 THEN 2 ELSE c END AS idx, CASE WHEN wide AND c = 1 THEN 2 ELSE 1 END AS colspan, CASE WHEN wide AND c = 1 THEN '' ELSE text END AS text, n FROM m WHERE NOT (wide AND c = 2))"""


def _raw(spark, sf_dir):
    return TB.parse_html_table(D.html_tables(spark, sf_dir))


def _pag18(spark, sf_dir):
    tables = D.html_tables(spark, sf_dir)
    raw = TB.parse_html_table(tables)
    widths, heights = TB.grid_sizes(raw, P.place_grid(raw), tables)
    both = widths.select("page_id", F.lit("col").alias("kind"), F.col("col").alias("at"), F.round("width", 6).alias("size"))
    return both.unionByName(heights.select("page_id", F.lit("row").alias("kind"), F.col("row").alias("at"), F.round("height", 6).alias("size")))


_PAG18 = _RAW + """ SELECT page_id, 'col' AS kind, CAST(k AS INTEGER) AS "at", 20.0::DOUBLE AS size FROM (SELECT DISTINCT page_id FROM raw), range(4) t(k)
UNION ALL SELECT page_id, 'row', CAST(k AS INTEGER), 16.0 FROM (SELECT DISTINCT page_id, n FROM raw), range(13) t(k) WHERE k < n"""


def _tab03(spark, sf_dir):
    out = TB.html_to_grid(D.html_tables(spark, sf_dir))
    return out.select("page_id", "row", "col", "rowspan", "colspan", "text", F.round("width", 6).alias("width"), F.round("height", 6).alias("height"))


def _snk04(spark, sf_dir):
    return TB.grid_slots(TB.html_to_grid(D.html_tables(spark, sf_dir), sized=True))


_SNK04 = _RAW + """ SELECT page_id, CAST(r AS INTEGER) AS "row", CAST(c + d AS INTEGER) AS "col", CASE WHEN d = 0 THEN text ELSE '' END AS text, CAST(r AS INTEGER) AS anchor_row, CAST(c AS INTEGER) AS anchor_col FROM raw, range(2) t(d) WHERE d < colspan"""


def _snk03(spark, sf_dir):
    return K.table_documents(D.html_tables(spark, sf_dir).withColumn("html", F.replace("html", F.lit("<table>"), F.lit("<table><tbody>"))))


_SNK03 = HTML + """ SELECT page_id, '<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head><meta charset="UTF-8"><style>table { border-collapse:collapse; } td { border:1px solid black; padding:8px; }</style></head>' || chr(10) || '<body>' || chr(10) || html || chr(10) || '</body>' || chr(10) || '</html>' AS html FROM html_tables"""


def _set02(spark, sf_dir):
    """Ten orders to a document; every third table has no title."""
    cells = TB.table_cells(D.html_tables(spark, sf_dir))
    title = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("Table "), F.col("page_id")))
    tables = cells.select(F.expr("page_id div 10").alias("doc_id"), F.col("page_id").alias("table_no"), title.alias("title"), "cells")
    return ST.union_tables_with_titles(tables).select("doc_id", F.col("out_row").cast("long").alias("out_row"), "kind", "table_no", "col", "text", "colspan")


_SET02 = _RAW + """, b AS (SELECT page_id // 10 AS doc_id, 'cell' AS kind, page_id AS table_no, r AS rw, c AS col, text, colspan FROM raw
    UNION ALL SELECT DISTINCT page_id // 10, 'title', page_id, -1, 0, 'Table ' || page_id, 4 FROM raw WHERE page_id % 3 <> 0)
SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY table_no, rw) - 1 AS out_row, kind, table_no, CAST(col AS INTEGER) AS col, text, colspan FROM b"""

QUERIES = {
    "snk_03_table_documents": Query(_snk03, _SNK03),
    "snk_04_grid_slots": Query(_snk04, _SNK04),
    "set_02_union_tables": Query(_set02, _SET02),
    "pag_16_parse_html": Query(lambda s, d: _raw(s, d).select("page_id", "row", "idx", "colspan", "rowspan", "text", "width_px", "height_pct"), _RAW + ' SELECT page_id, CAST(r AS INTEGER) AS "row", CAST(idx AS INTEGER) AS idx, colspan, 1 AS rowspan, text, 0 AS width_px, 0.0::DOUBLE AS height_pct FROM raw'),
    "pag_17_place_grid": Query(lambda s, d: P.place_grid(_raw(s, d)), _RAW + ' SELECT page_id, CAST(r AS INTEGER) AS "row", CAST(idx AS INTEGER) AS idx, CAST(c AS INTEGER) AS col, 4 AS columns FROM raw'),
    "pag_18_grid_sizes": Query(_pag18, _PAG18),
    "tab_03_html_to_grid": Query(_tab03, _RAW + ' SELECT page_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, 1 AS rowspan, colspan, text, 20.0::DOUBLE AS width, 16.0::DOUBLE AS height FROM raw'),
}
