"""Streams of page records and tokens: layout and tables as they come in. Pages don't depend on one another, so layout keeps no state; a page whose
tokens come in parts is kept until it is whole."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.functions.geometry import UPRIGHT_DEG, aabb, block_angle, rotate_box, rotate_box_ccw90
from pagewright.operators.lines import unplaced
from pagewright.plans.layout import laid_out
from pagewright.sources.records import PAGE_RECORD
from pagewright.sources.shared import intermediate, remove


def _upright(rows: DataFrame) -> DataFrame:
    """`rows` with `blocks`, in order of top edges, from the blocks in `own`: what `preprocess` does, within one row a page."""
    angles = F.array_sort(F.transform("own", lambda b: block_angle(b["box"])))
    rows = rows.withColumn("angles", angles).withColumn("n", F.size("angles"))
    middle = (F.get("angles", F.expr("cast((n - 1) div 2 as int)")) + F.get("angles", F.expr("cast(n div 2 as int)"))) / 2
    rows = rows.withColumn("turn", middle).withColumn("tilted", F.abs("turn") > F.radians(F.lit(UPRIGHT_DEG)))

    def placed(b):
        plain, turned = aabb(b["box"]), rotate_box(b["box"], F.col("turn"))
        sides = [F.when(F.col("tilted"), q).otherwise(p.cast("double")).alias(c) for c, p, q in zip("ltrb", plain, turned, strict=True)]
        return F.struct(*sides, b["text"].alias("text"), b["block_id"].alias("block_id"), b["score"].cast("double").alias("score"), b["box"].alias("box"))

    rows = rows.withColumn("own", F.transform("own", placed))
    least = {c: F.array_min(F.col(f"own.{c}")) for c in "lt"}
    shift = F.col("tilted") & ((least["l"] < 0) | (least["t"] < 0))
    rows = rows.withColumn("dx", F.when(shift, least["l"]).otherwise(0.0)).withColumn("dy", F.when(shift, least["t"]).otherwise(0.0))
    order = F.array_sort(
        F.transform(
            "own",
            lambda b: F.struct(F.round(b["t"] - F.col("dy"), 6).alias("by"), b["block_id"].alias("block_id"), (b["t"] - F.col("dy")).alias("t"), (b["l"] - F.col("dx")).alias("l"), (b["r"] - F.col("dx")).alias("r"), (b["b"] - F.col("dy")).alias("b"), b["text"].alias("text"), b["score"].alias("score"), b["box"].alias("box")),
        )
    )
    return rows.withColumn("blocks", order).drop("angles", "n", "turn", "tilted", "dx", "dy")


def layout_records(pages: DataFrame, strategy: str) -> DataFrame:
    """(doc_id, page, record): one result or error record for each page record, without any shuffle; for batches and streams alike."""
    good = F.filter("blocks", lambda b: F.coalesce(b["text"], F.lit("")) != "")
    rows = pages.select("doc_id", "page", F.coalesce("code", F.lit(0)).alias("code"), F.coalesce("msg", F.when(F.col("_corrupt_record").isNotNull(), "unreadable record")).alias("msg"), F.col("_corrupt_record").isNotNull().alias("bad"), good.alias("own"))
    rows = _upright(rows)
    if strategy == "single_vertical":  # the turned boxes are what is read, as of an upright page
        half = {n: F.greatest(F.array_max(F.col(f"blocks.{c}")), F.lit(0.0)) / 2 for n, c in (("cx", "r"), ("cy", "b"))}
        turned = F.transform("blocks", lambda b: F.struct(b["text"].alias("text"), b["block_id"].alias("block_id"), b["score"].alias("score"), rotate_box_ccw90(b["box"], F.col("cx"), F.col("cy")).alias("box")))
        rows = _upright(rows.withColumns(half).withColumn("own", turned))
    rows = rows.select("doc_id", "page", "code", "msg", "bad", "blocks")
    none = F.array().cast(rows.schema["blocks"].dataType)
    told, lost = F.col("bad") | (F.col("code") != 0), unplaced(F.col("blocks"))
    rows = rows.select("doc_id", "page", F.when(told, F.coalesce("msg", F.lit("failed page"))).when(lost, "a block has no place").alias("msg"), F.coalesce("blocks", none).alias("blocks"))
    rows = laid_out(rows.withColumn("blocks", F.when(F.col("msg").isNull(), F.col("blocks"))), strategy)
    text = F.array_join(F.transform("laid", lambda x: F.concat(x["text"], x["end"])), "")
    count = F.when(F.col("laid").isNotNull(), F.size("laid"))
    said = F.struct("doc_id", "page", F.col("msg").isNotNull().cast("int").alias("code"), text.alias("text"), count.alias("blockCount"), "msg")
    return rows.select("doc_id", "page", F.to_json(said).alias("record"))


def stream_layout(spark: SparkSession, path_in: str, path_out: str, strategy: str, checkpoint: str) -> StreamingQuery:
    """Page records in, one result or error record per page out, as text files; takes what is there and ends."""
    pages = spark.readStream.schema(PAGE_RECORD).option("columnNameOfCorruptRecord", "_corrupt_record").json(path_in)
    records = layout_records(pages, strategy).select(F.col("record").alias("value"))
    return records.writeStream.format("text").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path_out)


#: What a page is in a batch: its end token and all before it are there; it is waited for; it was waited for too long; it has been told before.
WHOLE, OPEN, LATE, TOLD = "whole", "open", "late", "told"


def page_states(tokens: DataFrame, now: float, timeout: float, end: str = "eos") -> DataFrame:
    """(page_id, state) of tokens (page_id, t, token, ...) with `_seen`, the second at which each came in.

    A page is whole once its first end token after the first place, and every place before that, has come, in whatever order; late if it isn't
    and its last token came more than `timeout` seconds ago.
    """
    end_at = F.min(F.when((F.col("token") == end) & (F.col("t") > 0), F.col("t")))
    pages = tokens.groupBy("page_id").agg(end_at.alias("end_at"), F.collect_set("t").alias("places"), F.max("_seen").alias("last"))
    there = F.size(F.filter("places", lambda t: (t >= 0) & (t <= F.col("end_at")))) == F.col("end_at") + 1
    whole = F.col("end_at").isNotNull() & there
    return pages.select("page_id", F.when(whole, WHOLE).when(F.col("last") < now - timeout, LATE).otherwise(OPEN).alias("state"))


def stream_tables(
    spark: SparkSession,
    path_in: str,
    path_out: str,
    tables: Callable[[DataFrame], DataFrame],
    schema: str,
    checkpoint: str,
    timeout: float = 3600.0,
    end: str = "eos",
    files_per_batch: int | None = None,
    clock: Callable[[], float] = time.time,
) -> StreamingQuery:
    """Parquet rows of tokens (page_id, t, token, ...) in, tables out, with `code` and `msg`; takes what is there and ends, and goes on from there when run again.

    A page's tokens are kept until all of them up to the end token have come, however they are dealt over files, batches and runs; then
    `tables`, a batch plan with joins and loops, makes its rows, with code 0. A page whose next token doesn't come within `timeout` seconds gives one
    row with code 1. Tokens of a page that has been told already are dropped for as long as the time-out, then they are a new page's.

    What is kept lies as Parquet beside the query's own checkpoint, under the number of the batch: a batch reads what the one before it left, and
    writes its own, and its tables, over what a failed attempt may have left. So every page is told once, whatever is lost and run again. Of a batch's
    tokens only those of open pages are written; the batch itself is read again from its files.
    """

    def at(number: int, part: str) -> str:
        return f"{checkpoint}/pages/batch={number}/{part}"

    def write(batch: DataFrame, number: int) -> None:
        session, now = batch.sparkSession, clock()
        came = batch.filter("page_id is not null").withColumn("_seen", F.lit(now))
        kind = came.schema
        told = session.createDataFrame([], "page_id long, told_at double")
        if number > 0:
            told = session.read.schema(told.schema).parquet(at(number - 1, "told")).filter(F.col("told_at") >= now - timeout)
            came = came.unionByName(session.read.schema(kind).parquet(at(number - 1, "tokens")))
        states = page_states(came, now, timeout, end).join(told, "page_id", "left")
        states.select("page_id", F.when(F.col("told_at").isNotNull(), TOLD).otherwise(F.col("state")).alias("state")).write.mode("overwrite").parquet(at(number, "states"))
        states = session.read.parquet(at(number, "states"))
        own = lambda state: states.filter(F.col("state") == state).select("page_id")
        there = {r.state for r in states.select("state").distinct().collect()}

        def tokens_of(state: str) -> DataFrame:
            """The tokens of the pages of a state; where all pages have it, nothing needs to be joined for that, and nothing shuffled."""
            if there <= {state}:
                return came
            return came.join(own(state), "page_id", "left_semi") if state in there else session.createDataFrame([], kind)

        tokens_of(OPEN).write.mode("overwrite").parquet(at(number, "tokens"))
        done = states.filter(F.col("state").isin(WHOLE, LATE)).select(F.col("page_id").cast("long").alias("page_id"), F.lit(now).alias("told_at"))
        told.unionByName(done).write.mode("overwrite").parquet(at(number, "told"))
        ended = bool(there & {WHOLE, LATE})
        if number == 0 or ended:
            with intermediate(session):
                found = tables(tokens_of(WHOLE).select(*batch.columns)).withColumns({"code": F.lit(0), "msg": F.lit(None).cast("string")})
                lost = own(LATE).withColumns({"code": F.lit(1), "msg": F.lit(f"the page's end didn't come within {timeout:g} seconds")})
                found = found.unionByName(lost, allowMissingColumns=True)
                if not ended:  # the columns alone, so that there is something to read
                    found = session.createDataFrame([], found.schema)
                found.write.mode("overwrite").parquet(f"{path_out}/batch={number}")
        remove(session, at(number, "states"))
        if number > 1:
            remove(session, f"{checkpoint}/pages/batch={number - 2}")

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path_in).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
