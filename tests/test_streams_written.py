"""What a stream of tables writes and makes, batch by batch."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pagewright.queries import all_queries
from pagewright.streaming.jobs import stream_tables

SCHEMA = "page_id long, t int, token string"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def run(spark, folder, tables):
    stream_tables(spark, str(folder / "in"), str(folder / "out"), tables, SCHEMA, str(folder / "cp"), 100.0, files_per_batch=1, clock=lambda: 0.0).awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(str(folder / "out")).select("page_id", "n", "code").collect())


def counted(tokens):
    return tokens.groupBy("page_id").agg(F.count("*").alias("n"))


def test_a_batch_writes_open_pages_and_no_others(spark, tmp_path):
    """All tokens of a batch were written, and then those of open pages once more."""
    put(spark, tmp_path, [(1, 0, "a"), (1, 1, "eos"), (2, 0, "a"), (None, 0, "a")])

    def broken(tokens):
        return tokens.select("page_id", F.raise_error(F.lit("no tables today")).cast("long").alias("n"))

    with pytest.raises(PySparkException, match="no tables today"):
        run(spark, tmp_path, broken)
    left = {p.name: p for p in (tmp_path / "cp" / "pages" / "batch=0").iterdir()}
    assert sorted(left) == sorted(["states", "tokens", "told"])
    assert [(r.page_id, r.t) for r in spark.read.parquet(str(left["tokens"])).collect()] == [(2, 0)]
    assert run(spark, tmp_path, counted) == [(1, 2, 0)]


def test_tables_are_made_of_whole_pages_only(spark, tmp_path):
    """A first batch without a whole page read all that the tables join."""
    put(spark, tmp_path, [(1, 0, "a"), (2, 0, "a")])

    def joined(tokens):
        others = spark.range(3).select("id", F.raise_error(F.lit("read")).cast("long").alias("m"))
        return tokens.select("page_id").unionByName(others.select(F.col("m").alias("page_id"))).withColumn("n", F.lit(1).cast("long"))

    assert run(spark, tmp_path, joined) == []
    put(spark, tmp_path, [(1, 1, "eos")])  # one of two
    assert run(spark, tmp_path, counted) == [(1, 2, 0)]
    put(spark, tmp_path, [(2, 1, "eos"), (1, 2, "late")])  # one whole, one told
    assert run(spark, tmp_path, counted) == [(1, 2, 0), (2, 2, 0)]
    put(spark, tmp_path, [(1, 3, "late"), (2, 2, "late")])  # told only
    assert run(spark, tmp_path, counted) == [(1, 2, 0), (2, 2, 0)]
    put(spark, tmp_path, [(3, 0, "a"), (3, 1, "eos")])  # whole only
    assert run(spark, tmp_path, counted) == [(1, 2, 0), (2, 2, 0), (3, 2, 0)]


def test_the_stream_is_the_batch(spark, sf_dir):
    stream, batch = (all_queries()[n].run(spark, sf_dir).select("page_id", "html", F.round("structure_score", 6)).collect() for n in ("str_02_stream_tables", "tab_02_structured_tables"))
    assert sorted(stream) == sorted(batch) and len(batch) > 1000
