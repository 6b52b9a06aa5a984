"""Queries that write to the shared folder and read back: files, records, histories, and tables from a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import aggregates as A
from pagewright.plans import tables as TB
from pagewright.queries import Query
from pagewright.queries.scalars import PB
from pagewright.queries.tables import _TAB02
from pagewright.sources import derived as D
from pagewright.sources import records as R
from pagewright.sources import sinks as K
from pagewright.sources.shared import new_path
from pagewright.streaming.jobs import stream_tables


def _src01(spark, sf_dir):
    """The files of the given tables, by name and kind."""
    files = R.scan_files(spark, sf_dir, kinds=("parquet",))
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", "kind")


def _pages(spark, sf_dir):
    blocks = D.page_blocks(spark, sf_dir)
    return R.collect_pages(blocks).join(A.assemble_text(blocks, order="block_id"), ["doc_id", "page"])


def _src02(spark, sf_dir):
    """Records of all pages, every ninth of them failed, as they are read back."""
    failed = F.col("doc_id") % 9 == 0
    pages = _pages(spark, sf_dir).withColumn("code", F.when(failed, 1).otherwise(0)).withColumn("msg", F.when(failed, 'no "page"'))
    K.write_records(K.to_records(pages), path := new_path(spark))
    back = R.read_page_records(spark, path)
    return back.select("doc_id", "page", "code", "msg", "text", F.col("blockCount").alias("block_count"), F.size("blocks").alias("blocks"), F.element_at("blocks", 1)["text"].alias("first_text"))


_SRC02 = PB + """, p AS (SELECT doc_id, page, doc_id % 9 = 0 AS failed, string_agg(text || "end", '' ORDER BY block_id) AS text, CAST(count(*) AS INTEGER) AS n, arg_min(text, block_id) AS first_text FROM page_blocks GROUP BY doc_id, page)
SELECT doc_id, page, CASE WHEN failed THEN 1 ELSE 0 END AS code, CASE WHEN failed THEN 'no "page"' END AS msg, CASE WHEN NOT failed THEN text END AS text, CASE WHEN NOT failed THEN n END AS block_count,
    CASE WHEN failed THEN NULL ELSE n END AS blocks, CASE WHEN NOT failed THEN first_text END AS first_text FROM p"""


def _snk05(spark, sf_dir):
    """Two runs appended to one history, and the history read back."""
    path = new_path(spark)
    texts = A.assemble_text(D.page_blocks(spark, sf_dir), order="block_id")
    for run in (0, 1):
        dated = texts.filter(F.col("doc_id") % 2 == run).withColumn("dt", F.format_string("2024-0%d-1%d", F.lit(run + 1), F.col("doc_id") % 3))
        K.write_history(dated, path)
    return spark.read.parquet(path).select("doc_id", "page", "text", "block_count", F.col("dt").cast("string").alias("dt"))


_SNK05 = PB + """ SELECT doc_id, page, string_agg(text || "end", '' ORDER BY block_id) AS text, count(*) AS block_count, '2024-0' || (doc_id % 2 + 1) || '-1' || (doc_id % 3) AS dt FROM page_blocks GROUP BY doc_id, page"""


def _str02(spark, sf_dir):
    """Tables from a stream of structure tokens whose pages come in three parts, each in files, and so a batch, of its own."""
    tokens, blocks = D.tokens(spark, sf_dir, ended=True), D.grid_blocks(spark, sf_dir)
    path_in, parts = new_path(spark), D.order_partitions(spark, sf_dir)
    for part in range(3):  # as many files each, one part after the other, as a stream takes files in order of time
        tokens.filter(F.col("t") % 3 == part).write.mode("append").parquet(path_in)
        files = len(spark.read.parquet(path_in).inputFiles()) if part == 0 else files
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema)
    # Dealt as the blocks are, tokens meet them without a further shuffle of blocks.
    tables = lambda t: TB.structured_tables(t.repartition(parts, "page_id"), blocks)
    stream_tables(spark, path_in, path_out := new_path(spark), tables, schema, new_path(spark), files_per_batch=files).awaitTermination()
    return spark.read.parquet(path_out).select("page_id", "html", F.round("structure_score", 9).alias("structure_score"))


QUERIES = {
    "src_01_scan_files": Query(_src01, None),
    "src_02_page_records": Query(_src02, _SRC02),
    "snk_05_history": Query(_snk05, _SNK05),
    "str_02_stream_tables": Query(_str02, _TAB02),
}
