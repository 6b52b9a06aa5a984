"""Compositions: layout of tables of blocks, tables from lines and tokens, records, streams, and queries against SQL."""

from __future__ import annotations

import json
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest
from pyspark.sql import functions as F

from pagewright.operators import aggregates as A
from pagewright.operators import filters as FL
from pagewright.operators import joins as J
from pagewright.plans import search as S
from pagewright.plans import tables as TB
from pagewright.plans.layout import layout
from pagewright.queries import all_queries
from pagewright.sources import derived as D
from pagewright.sources import records as R
from pagewright.sources import sinks as K
from pagewright.sources.shared import forget, intermediate, mark, shared_table
from pagewright.streaming.jobs import layout_records, stream_layout, stream_tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or str(v) in ("<NA>", "nan"):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    try:
        return f"{float(v):.9g}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize(
    "name",
    ["scl_04_word_separator", "scl_17_partial_point", "src_05_select_pages", "pag_01_preprocess", "lay_01_single_line", "lay_04_single_code", "lay_06_multi_line", "jon_01_blocks_to_cells", "jon_07_slot_cells", "agg_12_table_clusters", "win_05_collapse_runs", "win_09_column_segments", "tab_01_bordered_tables", "tab_02_structured_tables", "tab_03_html_to_grid", "fnd_03_find_text_many", "scl_15_spacing_match", "flt_12_cluster_size", "jon_09_close_components", "pag_02_regions", "str_01_layout_records", "str_02_stream_tables", "snk_01_records", "snk_05_history", "src_02_page_records"],
)
def test_query_equals_its_sql(spark, sf_dir, name):
    query = all_queries()[name]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want, got = con.execute(query.sql).df(), query.run(spark, sf_dir).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(tuple(map(cell, r)) for r in df[columns].itertuples(index=False)) for df in (want, got)]
    assert rows[0] == rows[1] and rows[0]


def test_layout_of_pages(spark, sf_dir):
    blocks = D.page_blocks(spark, sf_dir).filter("doc_id < 20")
    with pytest.raises(ValueError, match="unknown layout strategy"):
        layout(blocks, "sideways")
    same = layout(blocks, "none")
    assert same.count() == blocks.count() and {r.code for r in same.select("code").distinct().collect()} == {0}
    bad = blocks.withColumn("box", F.when((F.col("doc_id") == 3) & (F.col("block_id") == 1), F.array(F.lit(1))).otherwise(F.col("box")))
    out = layout(bad, "single_code")
    assert {(r.doc_id, r.code) for r in out.filter("code <> 0").collect()} <= {(3, 1)}
    assert out.filter("code = 0 and doc_id <> 3").count() > 0
    one, many = (layout(blocks.repartition(n), "multi_para").orderBy("doc_id", "seq").collect() for n in (1, 7))
    assert one == many


def test_vertical_pages(spark):
    """Two columns of characters, the right one first."""
    rows = [(1, 0, k, t, 0.5, [x, y, x + 20, y, x + 20, y + 60, x, y + 60], 0, 0.0, "\n") for k, (t, x, y) in enumerate([("三四", 0, 70), ("一", 100, 0), ("二", 100, 70), ("三", 0, 0)])]
    df = spark.createDataFrame(rows, "doc_id long, page int, block_id int, text string, score double, box array<int>, angle int, angle_score double, end string")
    assert [r.text for r in layout(df, "single_vertical").orderBy("seq").collect()] == ["一", "二", "三", "三四"]


def test_records_round_trip_and_streams(spark, sf_dir, tmp_path):
    blocks = D.page_blocks(spark, sf_dir).filter("doc_id < 12")
    pages = R.collect_pages(blocks).join(A.assemble_text(blocks, order="block_id"), ["doc_id", "page"])
    pages = pages.withColumn("code", F.when(F.col("doc_id") == 5, 1).otherwise(0)).withColumn("msg", F.when(F.col("doc_id") == 5, 'bad "page"'))
    records = K.to_records(pages)
    K.write_records(records, str(tmp_path / "in"))
    (tmp_path / "in" / "broken.txt").write_text("{not json\n")
    back = R.read_page_records(spark, str(tmp_path / "in"))
    assert back.count() == 13 and back.filter("_corrupt_record is not null and doc_id is null").count() == 1
    assert back.filter("doc_id = 5").first().msg == 'bad "page"'
    stream_layout(spark, str(tmp_path / "in"), str(tmp_path / "out"), "multi_line", str(tmp_path / "cp")).awaitTermination()
    streamed = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert streamed == sorted(r.record for r in layout_records(back, "multi_line").collect())
    parsed = [json.loads(x) for x in streamed]
    assert sum(p["code"] for p in parsed) == 2
    ready = blocks.filter("doc_id <> 5").join(back.select("doc_id"), "doc_id", "left_semi")
    batch = {r.doc_id: r.text for r in A.assemble_text(layout(ready, "multi_line")).collect()}
    assert {p["doc_id"]: p["text"] for p in parsed if p["code"] == 0 and p["text"]} == batch


def with_ends(tokens):
    ends = tokens.groupBy("page_id").agg((F.max("t") + 1).alias("t")).withColumns({"token": F.lit("eos"), "score": F.lit(1.0)})
    return tokens.unionByName(ends, allowMissingColumns=True)


class Stream:
    """Files of tokens put in one after another, and runs of the stream between them."""

    def __init__(self, spark, folder, blocks, schema):
        self.spark, self.folder, self.blocks, self.schema, self.now, self.n = spark, folder, blocks, schema, 0.0, 0

    def put(self, tokens):
        self.n += 1
        tokens.coalesce(1).write.mode("append").parquet(str(self.folder / "tokens"))

    def run(self, files_per_batch=1):
        stream_tables(self.spark, str(self.folder / "tokens"), str(self.folder / "out"), lambda t: TB.structured_tables(t, self.blocks), self.schema, str(self.folder / "cp"), 100.0, files_per_batch=files_per_batch, clock=lambda: self.now).awaitTermination()
        return self.spark.read.parquet(str(self.folder / "out")).drop("batch").orderBy("page_id").collect()


@pytest.fixture
def stream(spark, sf_dir, tmp_path):
    tokens = D.tokens(spark, sf_dir).filter("page_id < 60")
    blocks = D.grid_blocks(spark, sf_dir).filter("page_id < 60")
    return Stream(spark, tmp_path, shared_table(blocks), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema)), shared_table(with_ends(tokens))


def as_batch(stream, tokens):
    return TB.structured_tables(tokens, stream.blocks).withColumns({"code": F.lit(0), "msg": F.lit(None).cast("string")}).orderBy("page_id").collect()


def test_stream_of_tables(stream):
    stream, tokens = stream
    stream.put(tokens)
    assert stream.run(None) == as_batch(stream, tokens)


def test_stream_of_tables_in_parts_and_runs(stream):
    stream, tokens = stream
    part = F.pmod(F.xxhash64("page_id", "t"), F.lit(4))  # ends come before, between and after the rest
    stream.put(tokens.filter(part == 0))
    assert stream.run() == as_batch(stream, tokens.filter("false"))
    stream.put(tokens.filter(part == 1))
    stream.put(tokens.filter(part == 2))
    stream.run()
    stream.put(tokens.filter(part == 3))
    assert stream.run() == as_batch(stream, tokens)
    left = [p.name for p in (stream.folder / "cp" / "pages").iterdir()]
    assert len(left) == 2  # what the last batch left, and what it could be run again from


def test_pages_that_never_end_are_told_once(stream):
    stream, tokens = stream
    cut = tokens.filter("page_id <> 7 or token <> 'eos'").filter("page_id <> 33 or t <> 2").filter("page_id <> 2")
    stream.put(cut)
    stream.run()
    stream.now = 99.0
    stream.put(tokens.filter("page_id = 33 and t = 2"))  # in time
    assert [r.page_id for r in stream.run() if r.code] == []
    stream.now = 101.0
    stream.put(tokens.filter("page_id = 2"))
    got = stream.run()
    assert [(r.page_id, r.html) for r in got if r.code] == [(7, None)] and "100 seconds" in next(r.msg for r in got if r.code)
    stream.now = 150.0
    stream.put(tokens.filter("page_id = 7 and token = 'eos'"))  # too late, and no page of its own
    stream.run()
    stream.now = 260.0
    stream.put(tokens.filter("page_id = 3").withColumn("page_id", F.lit(1_000).cast("long")))
    got = stream.run()
    assert [r.page_id for r in got if r.code] == [7] and got[-1].page_id == 1_000
    assert [r for r in got if r.code == 0 and r.page_id < 1_000] == as_batch(stream, tokens.filter("page_id <> 7"))


def test_runs_forget_only_their_own_tables(spark):
    with intermediate(spark):
        mine = shared_table(spark.range(3))
        with ThreadPoolExecutor(1) as pool:

            def other():
                with intermediate(spark):
                    shared_table(spark.range(4))
                return shared_table(spark.range(5))

            theirs = pool.submit(other).result()
        assert mine.count() == 3
        with intermediate(spark):
            inner = shared_table(spark.range(6)).inputFiles()[0]
        assert not os.path.exists(inner.removeprefix("file://")) and mine.count() == 3
        files = mine.inputFiles()
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files) and theirs.count() == 5


def test_streams_turn_vertical_pages(spark, sf_dir):
    blocks = D.page_blocks(spark, sf_dir, True).filter("doc_id < 30")
    pages = R.collect_pages(blocks).select("*", F.lit(0).alias("code"), F.lit(None).cast("string").alias("msg"), F.lit(None).cast("string").alias("_corrupt_record"))
    for strategy in ("single_vertical", "single_line", "multi_para"):
        got = {r.doc_id: json.loads(r.record)["text"] for r in layout_records(pages, strategy).collect()}
        assert {d: t for d, t in got.items() if t} == {r.doc_id: r.text for r in A.assemble_text(layout(blocks, strategy)).collect()}


def test_many_queries_are_found_by_an_equi_join(spark, sf_dir):
    blocks = D.page_blocks(spark, sf_dir)
    asked = spark.createDataFrame([(1, "la", 1, "center"), (2, "E", 2, "topleft"), (3, "The ", 1, "center"), (4, "", 1, "center"), (5, "der é", 1, "center"), (6, "zzzz", 1, "center")], "query_id int, q string, n int, loc string")
    few, many = (S.find_text_many(blocks, asked, broadcast_queries=n) for n in (10, 0))
    assert sorted(many.collect()) == sorted(few.collect()) and many.count() > 100
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_shared_tables_are_removed(spark, tmp_path):
    since = mark()
    one, two = shared_table(spark.range(3)), shared_table(spark.range(5))
    forget(spark, since, keep=two)
    assert two.count() == 5 and mark() == since + 1
    with pytest.raises(Exception, match="(?i)not.*exist"):
        one.count()
    forget(spark, since)
    assert mark() == since


def test_files(spark, tmp_path):
    for name in ("a.PNG", "b.pdf", "c.txt", "sub/d.jpeg"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x")
    assert sorted(r.kind for r in R.scan_files(spark, str(tmp_path)).collect()) == ["jpeg", "pdf", "png"]


def test_structure_ends_at_the_end_token_and_pages_without_blocks_stay_bare(spark):
    rows = [(1, k, t, 0.5, *((0, 0, 10, 10) if t.startswith("<td") else (None,) * 4)) for k, t in enumerate(["sos", "<tr>", "<td", ' rowspan="2"', ">", "</td>", "<td></td>", "</tr>", "eos", "<td></td>"])]
    tokens = spark.createDataFrame(rows, "page_id long, t int, token string, score double, x1 int, y1 int, x2 int, y2 int")
    cells = TB.structure_cells(tokens).orderBy("cell_id").collect()
    assert [(c.colspan, c.rowspan) for c in cells] == [(1, 2), (1, 1)]
    none = spark.createDataFrame([], "page_id long, block_id int, text string, l int, t int, r int, b int")
    out = TB.structured_tables(tokens, none).first()
    assert out.html == "<table><tr><td></td><td></td></tr></table>" and out.structure_score == 0.5


def test_short_rows_under_a_rowspan_are_padded(spark):
    html = "<table><tr><td rowspan='2'>a</td><td>b</td></tr><tr><td>c</td></tr><tr><td>d</td></tr></table>"
    out = TB.pad_rows(spark.createDataFrame([(1, html)], "page_id long, html string")).first().html
    assert out == html.replace("<td>d</td>", "<td>d</td><td>&nbsp;</td>")


def test_iou_ties_go_to_the_nearer_then_the_first_cell(spark):
    cells = spark.createDataFrame([(1, 7, 0, 0, 10, 10), (1, 3, 20, 0, 30, 10), (1, 5, 20, 0, 30, 10)], "page_id long, cell_id int, x1 int, y1 int, x2 int, y2 int")
    blocks = spark.createDataFrame([(1, 1, "t", 5, 0, 25, 10)], "page_id long, block_id int, text string, l int, t int, r int, b int")
    assert J.match_blocks_to_cells(blocks, cells).first().cell_id == 3
    assert J.match_blocks_to_cells(blocks.limit(0), cells).count() == 0


def test_clusters_and_valid_shapes(spark):
    cells = spark.createDataFrame([(1, k, 10 * (k % 3), 10 * (k // 3), 10 * (k % 3) + 10, 10 * (k // 3) + 10) for k in range(6)] + [(1, 9, 500, 500, 600, 600)], "page_id long, cell_id int, x1 int, y1 int, x2 int, y2 int")
    got = {r.cell_id: r.table_id for r in A.table_clusters(cells, J.adjacent_cells(cells)).collect()}
    assert got == {**dict.fromkeys(range(6), 0), 9: 9}
    slots = cells.filter("cell_id < 6").select("page_id", F.lit(0).alias("table_id"), F.expr("cell_id div 3").alias("row"), F.expr("cell_id % 3").alias("col"), "x1", "y1", "x2", "y2")
    assert FL.valid_tables(slots).count() == 6 and FL.valid_tables(slots.filter("row = 0")).count() == 0


def test_search(spark):
    rows = [(1, 0, 0, "Alpha beta", 0.5, [0, 0, 100, 0, 100, 20, 0, 20]), (1, 0, 1, "BETA beta", 0.5, [0, 30, 90, 30, 90, 50, 0, 50])]
    df = spark.createDataFrame(rows, "doc_id long, page int, block_id int, text string, score double, box array<int>")
    hits = {n: S.find_text(df, "beta", n, "topleft").first() for n in (0, 1, 2)}
    assert (hits[0].block_id, hits[0].x, hits[0].y) == (0, 60, 0) == (hits[1].block_id, hits[1].x, hits[1].y)
    assert (hits[2].block_id, hits[2].x) == (1, 0) and S.find_text(df, "beta", 3).count() == 0 and S.find_text(df, "").count() == 0
    segments = spark.createDataFrame([(1, 0, 1, k, 10 * k, 10 * k + 8) for k in range(9)], "doc_id long, page int, block_id int, seg int, start int, end int")
    assert S.find_text(df, "beta", 2, "center", segments).first().x == 14
    assert [r.found for r in S.has_text(df, "alpha").collect()] == [False]
