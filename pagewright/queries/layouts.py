"""Queries of the layout strategies.

In the derived pages lines of text are rows of at most two columns, upright and evenly spaced, so that the right order can
be said in SQL: by row and column for one-column strategies, by column and row for the others.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import pages as P
from pagewright.operators.lines import let
from pagewright.operators.regions import in_regions, one_region
from pagewright.plans.layout import layout, multi_line, placed_rows, read_regions
from pagewright.queries import Query
from pagewright.queries.scalars import PB, text_separator_sql
from pagewright.sources import derived as D
from pagewright.streaming.jobs import layout_records

OUT = ("doc_id", "page", "seq", "block_id", "text", "end")


def _layout(strategy: str):
    def run(spark, sf_dir):
        out = layout(D.page_blocks(spark, sf_dir), strategy)
        return out.select(*OUT, "code")

    return run


_ROWS = PB + """, b AS (SELECT doc_id, page, block_id, text, box[1] AS x0, box[3] AS x1, box[2] AS y0, CASE WHEN box[1] > 600 THEN 1 ELSE 0 END AS col, (box[2] - 50) // 28 AS r, score, box FROM page_blocks WHERE text <> '')"""
_NEXT = _ROWS + """, n AS (SELECT *, lead(text) OVER w AS nt, lead(x0) OVER w AS nx, lead(r) OVER w AS nr, row_number() OVER w - 1 AS seq FROM b WINDOW w AS (PARTITION BY doc_id, page ORDER BY r, col))"""
_GAP = f"CASE WHEN nx - x1 > (y0 + 40 - nx) / 2.0 * 1.5 THEN ' ' ELSE {text_separator_sql('text', 'nt')} END"
_SINGLE = f"CASE WHEN nr = r THEN {_GAP} ELSE chr(10) END"
_SINGLE_NONE = f"CASE WHEN nt IS NULL THEN chr(10) WHEN nr = r THEN {_GAP} ELSE {text_separator_sql('text', 'nt')} END"
_BY_COLUMN = _ROWS + """, n AS (SELECT *, lead(text) OVER w AS nt, row_number() OVER w - 1 AS seq FROM b WINDOW w AS (PARTITION BY doc_id, page ORDER BY col, r))"""


def _select(end: str) -> str:
    return f' SELECT doc_id, page, CAST(seq AS INTEGER) AS seq, CAST(block_id AS INTEGER) AS block_id, text, {end} AS "end", 0 AS code FROM n'


def _lines(spark, sf_dir):
    """The lines of each page: their number of blocks, first block and text."""
    out = layout(D.page_blocks(spark, sf_dir), "single_line")
    return out.groupBy("doc_id", "page", "region_id").agg(F.count("*").alias("n"), F.min_by("block_id", "seq").alias("first"))


_LINES = _ROWS + " SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY r) - 1 AS INTEGER) AS region_id, n, first FROM (SELECT doc_id, page, r, count(*) AS n, CAST(arg_min(block_id, col) AS INTEGER) AS first FROM b GROUP BY doc_id, page, r)"

_CODE = _NEXT + """, l AS (
    SELECT doc_id, page, r, min(x0) AS x0, arg_min(block_id, col) AS block_id,
        string_agg(CASE WHEN col = 1 AND px IS NOT NULL THEN repeat('  ', CAST(round((x0 - px) / 20.0) AS INTEGER)) ELSE '' END || text, '' ORDER BY col) AS text
    FROM (SELECT *, lag(x1) OVER (PARTITION BY doc_id, page, r ORDER BY col) AS px FROM b) GROUP BY doc_id, page, r),
m AS (SELECT *, min(x0) OVER w AS least, max(x0) OVER w AS most, row_number() OVER (PARTITION BY doc_id, page ORDER BY r) - 1 AS seq FROM l WINDOW w AS (PARTITION BY doc_id, page))
SELECT doc_id, page, CAST(seq AS INTEGER) AS seq, CAST(block_id AS INTEGER) AS block_id,
    repeat('  ', CAST(greatest(len(list_filter(range(CAST(ceil((most - least) / 20.0) AS BIGINT)), lambda k: least + 20 * k < x0 + 10)) - 1, 0) AS INTEGER)) || text AS text, chr(10) AS "end", 0 AS code
FROM m"""


def _merged_code(spark, sf_dir):
    return _layout("single_code")(spark, sf_dir)


def _stream(spark, sf_dir):
    """What a stream of these pages would write, as one batch."""
    blocks = D.page_blocks(spark, sf_dir)
    row = F.struct("block_id", "text", "score", "box", "angle", "angle_score", "end")
    pages = blocks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("block_id", row.alias("b")))).alias("l"))
    pages = pages.select("doc_id", "page", F.lit(0).alias("code"), F.lit(None).cast("string").alias("msg"), F.transform("l", lambda x: x["b"]).alias("blocks"), F.lit(None).cast("string").alias("_corrupt_record"))
    said = F.from_json("record", "doc_id long, page int, code int, text string, blockCount int")
    return layout_records(pages, "single_line").select(said.alias("r")).select("r.doc_id", "r.page", "r.code", "r.text", F.col("r.blockCount").alias("block_count"))


_STREAM = _NEXT + f""", e AS (SELECT doc_id, page, seq, text || {_SINGLE} AS said FROM n), l AS (SELECT doc_id, page, string_agg(said, '' ORDER BY seq) AS text, count(*) AS k FROM e GROUP BY doc_id, page)
SELECT doc_id, page, 0 AS code, coalesce(text, '') AS text, CAST(coalesce(k, 0) AS INTEGER) AS block_count FROM (SELECT DISTINCT doc_id, page FROM page_blocks) LEFT JOIN l USING (doc_id, page)"""


def _para(strategy: str):
    return _layout(strategy)


def _regions(spark, sf_dir):
    """The columns of each page and their blocks, before their order within columns."""
    ready = P.page_lists(P.preprocess(D.page_blocks(spark, sf_dir)))
    rows = placed_rows(ready.withColumn("laid", let(in_regions(F.col("blocks")), multi_line)))
    return rows.select("doc_id", "page", "seq", "region_id", "block_id", "code")


def _fine(spark, sf_dir):
    """Every page taken as one region."""
    ready = P.page_lists(P.preprocess(D.page_blocks(spark, sf_dir)))
    rows = placed_rows(read_regions(ready, one_region).withColumn("laid", let(F.col("read"), multi_line)))
    return rows.select("doc_id", "page", "seq", "block_id", "code")


QUERIES = {
    "pag_02_regions": Query(_regions, _BY_COLUMN.replace("row_number() OVER w - 1 AS seq", "row_number() OVER w - 1 AS seq, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY col) - 1 AS region_id") + " SELECT doc_id, page, CAST(seq AS INTEGER) AS seq, CAST(region_id AS INTEGER) AS region_id, CAST(block_id AS INTEGER) AS block_id, 0 AS code FROM n"),
    "pag_03_fine_sort": Query(_fine, None),
    "pag_04_text_lines": Query(_lines, _LINES),
    "pag_05_paragraphs": Query(_para("single_para"), None),
    "pag_06_code_lines": Query(_merged_code, _CODE),
    "pag_07_vertical": Query(_layout("single_vertical"), None),
    "lay_01_single_line": Query(_layout("single_line"), _NEXT + _select(_SINGLE)),
    "lay_02_single_para": Query(_layout("single_para"), None),
    "lay_03_single_none": Query(_layout("single_none"), _NEXT + _select(_SINGLE_NONE)),
    "lay_04_single_code": Query(_layout("single_code"), _CODE),
    "lay_05_single_vertical": Query(_layout("single_vertical"), None),
    "lay_06_multi_line": Query(_layout("multi_line"), _BY_COLUMN + _select("chr(10)")),
    "lay_07_multi_para": Query(_layout("multi_para"), None),
    "lay_08_multi_none": Query(_layout("multi_none"), _BY_COLUMN + _select(f"CASE WHEN nt IS NULL THEN chr(10) ELSE {text_separator_sql('text', 'nt')} END")),
    "lay_09_none": Query(_layout("none"), PB + ' SELECT doc_id, page, CAST(block_id AS INTEGER) AS seq, CAST(block_id AS INTEGER) AS block_id, text, "end", 0 AS code FROM page_blocks'),
    "str_01_layout_records": Query(_stream, _STREAM),
}
