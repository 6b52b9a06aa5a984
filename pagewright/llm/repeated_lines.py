"""Operator 12: lines that many documents share are dropped from all documents but the first.

Texts are split at line breaks and exploded into (document, position, hash of the normalised line). A hash's documents are counted
with partial sums in every task; lines over the threshold are dropped, and what is left of each text is put together by position.

Only hashes and positions travel by hash; a text is shuffled once, to meet the positions that it loses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import BROADCAST_ROWS, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is stripped at both ends of a line.
BLANKS = "\t\n\x0b\x0c\r "


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def line_key(line: Column) -> Column:
    """A line as it is compared: without blanks at both ends, A-Z in lower case."""
    return F.translate(stripped(line), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """Names a row by its id and 128 bits of its text; equal rows share it, and what they lose."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(1), text).alias("_t2")]


ROW = ["_id", "_t1", "_t2"]
LINE = ["_h1", "_h2"]


def long_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _t1, _t2, _doc, _pos, _h1, _h2): every line whose key is long enough, with 128 bits of the key's hash."""
    rows = docs.select(*_row_key(id_col, text_col), F.col(id_col).cast("long").alias("_doc"), _lines(F.col(text_col)).alias("_lines"))
    rows = rows.select(*ROW, "_doc", F.posexplode("_lines").alias("_pos", "_line"))  # after the hashes of the text, which are taken once
    rows = rows.filter(F.char_length(stripped(F.col("_line"))) >= min_chars).withColumn("_key", line_key(F.col("_line")))
    return rows.select(*ROW, "_doc", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))


def shared_lines(lines: DataFrame, min_docs: int = 2) -> DataFrame:
    """(_h1, _h2, _first): the hashes of lines found in at least `min_docs` documents, and the smallest id among these.

    Two documents are told by the least and the largest id alone; more are counted after a line has been counted once a document.
    All rows without an id are one document, which comes after all others.
    """
    if min_docs <= 2:
        ids = lines.groupBy(*LINE).agg(F.min("_doc").alias("_first"), F.max("_doc").alias("_last"), F.max(F.col("_doc").isNull()).alias("_none"))
        several = F.lit(True) if min_docs < 2 else (F.col("_first") < F.col("_last")) | (F.col("_none") & F.col("_first").isNotNull())
        return ids.filter(several).select(*LINE, "_first")
    once = lines.groupBy(*LINE, "_doc").agg(F.lit(1).alias("_one"))
    return once.groupBy(*LINE).agg(F.min("_doc").alias("_first"), F.count("*").alias("_n")).filter(F.col("_n") >= min_docs).select(*LINE, "_first")


def _without(lines: Column, gone: Column) -> Column:
    """`lines` without the positions in `gone`, which ascend: the stretches between them, so that long texts take no more than a pass."""
    n = F.size(gone)
    before = lambda k: F.coalesce(F.get(gone, k - 1), F.lit(-1))
    after = lambda k: F.coalesce(F.get(gone, k), F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(lines, before(k) + 2, after(k) - before(k) - 1)))


def drop_shared_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped), a row for each row: texts without the lines that an earlier document holds too.

    A line counts by its key (see `line_key`); keys of at least `min_chars` code points found in at least `min_docs` documents lose all their
    lines except in the smallest id that holds them, where all of them stay. A null or empty text is one empty line. Repeated rows
    of an id are one document, and so are all rows without an id, which come last: they lose what any other document holds. Rows keep
    what they lose apart by id and text, other columns play no part. No rows in, no rows out.

    The hashes of shared lines are written to the shared folder and broadcast if they are counted to be at most `broadcast_rows`; beyond
    that both sides are shuffled by hash, and a line that a third of all documents hold is split by AQE.
    """
    lines = long_lines(docs, min_chars, id_col, text_col)
    shared = materialise(shared_lines(lines, min_docs))
    few = shared.count() <= broadcast_rows
    lost = lines.join(F.broadcast(shared) if few else shared, LINE).filter(~F.col("_doc").eqNullSafe(F.col("_first")))
    lost = lost.groupBy(*ROW).agg(F.array_sort(F.collect_set("_pos")).alias("_gone"))
    rows = docs.select(*_row_key(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(lost, ROW, "left").withColumn("_lines", _lines(F.col("text")))
    left = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(_without(F.col("_lines"), F.col("_gone")), "\n"))
    dropped = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone"))
    return rows.select("doc_id", left.alias("text"), F.size("_lines").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))
