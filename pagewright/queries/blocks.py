"""Queries over page blocks: filters, windows, aggregates, records, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import aggregates as A
from pagewright.operators import filters as FL
from pagewright.operators import joins as J
from pagewright.operators import pages as P
from pagewright.operators import windows as W
from pagewright.plans import search as S
from pagewright.queries import Query
from pagewright.queries.scalars import _CORNERS, AABB_SQL, ANGLE_SQL, PB, ratio_sql, text_separator_sql
from pagewright.sources import derived as D
from pagewright.sources import records as R
from pagewright.sources import sinks as K

SKEW = D.with_sql("skew_blocks")
IDS = ("doc_id", "page", "block_id")


def _with_rect(df):
    from pagewright.functions.geometry import aabb

    return df.withColumns(dict(zip("ltrb", aabb(F.col("box")), strict=True)))


def _src03(spark, sf_dir):
    pages = R.collect_pages(D.page_blocks(spark, sf_dir))
    return R.explode_blocks(pages).select("doc_id", "page", "seq", "block_id", "text", F.round("score", 9).alias("score"))


def _src04(spark, sf_dir):
    pages = R.collect_pages(D.page_blocks(spark, sf_dir))
    return pages.select("doc_id", "page", F.size("blocks").cast("long").alias("n"), F.array_join(F.transform("blocks", lambda b: b["text"]), "|").alias("texts"))


def _src05(spark, sf_dir):
    return R.select_pages(D.page_specs(spark, sf_dir))


_SRC05 = D.with_sql("page_specs") + """, pieces AS (SELECT doc_id, page_count, spec, unnest(string_split(spec, ',')) AS p FROM page_specs),
bounds AS (SELECT doc_id, page_count, CASE WHEN spec = 'all' THEN 1 ELSE CAST(split_part(p, '-', 1) AS INTEGER) END AS a,
    CASE WHEN spec = 'all' THEN page_count WHEN contains(p, '-') THEN CAST(split_part(p, '-', 2) AS INTEGER) ELSE CAST(p AS INTEGER) END AS b FROM pieces)
SELECT DISTINCT doc_id, CAST(k - 1 AS INTEGER) AS page FROM (SELECT doc_id, page_count, unnest(range(a, b + 1)) AS k FROM bounds WHERE a <= b) WHERE k <= page_count"""


def _results(spark, sf_dir):
    """One result per page; every fiftieth page has failed."""
    bad = F.col("doc_id") % 50 == 3
    rows = D.given(spark, sf_dir, "documents")
    return rows.select("doc_id", F.lit(0).alias("page"), F.when(bad, 1).otherwise(0).alias("code"), F.when(bad, 'can\'t read "page"').otherwise("").alias("msg"))


_RESULTS = """WITH results AS (SELECT doc_id, 0 AS page, CASE WHEN doc_id % 50 = 3 THEN 1 ELSE 0 END AS code, CASE WHEN doc_id % 50 = 3 THEN 'can''t read "page"' ELSE '' END AS msg FROM documents)"""


def _snk01(spark, sf_dir):
    pages = R.collect_pages(D.page_blocks(spark, sf_dir))
    texts = A.assemble_text(D.page_blocks(spark, sf_dir), order="block_id")
    records = K.to_records(pages.join(texts, ["doc_id", "page"]))
    said = F.from_json("record", "doc_id long, page int, code int, text string, blockCount int, blocks array<struct<text: string, score: double, box: array<int>, angle: int, angleScore: double, `end`: string>>")
    rows = records.select(said.alias("r")).select("r.*").withColumn("last", F.element_at("blocks", -1))
    return rows.select("doc_id", "page", "code", "text", F.col("blockCount").alias("block_count"), F.col("last.text").alias("last_text"), F.col("last.score").alias("last_score"), F.array_join("last.box", ",").alias("last_box"))


_SNK01 = PB + """ SELECT doc_id, page, 0 AS code, string_agg(text || "end", '' ORDER BY block_id) AS text, CAST(count(*) AS INTEGER) AS block_count,
    arg_max(text, block_id) AS last_text, round(arg_max(score, block_id), 4) AS last_score, array_to_string(arg_max(box, block_id), ',') AS last_box FROM page_blocks GROUP BY doc_id, page"""


def _snk06(spark, sf_dir):
    out = K.text_layer(D.page_blocks(spark, sf_dir, True), F.lit(1000), 150, (5, 0, 990))
    return out.select(*IDS, *[F.round(c, 6).alias(c) for c in ("font_pt", "x", "y")])


_SNK06 = SKEW + f""", c AS (SELECT doc_id, page, block_id, {_CORNERS} FROM skew_blocks WHERE text <> ''),
f AS (SELECT *, greatest((abs(y3 - y0) + abs(y2 - y1)) // 2, 6) AS px FROM c)
SELECT doc_id, page, block_id, round(greatest(px * 0.48::DOUBLE, 2.0), 6) AS font_pt, round(x0 * 0.48::DOUBLE + 5, 6) AS x, round(10 + (y0 + px) * 0.48::DOUBLE, 6) AS y FROM f"""


def _flt06(spark, sf_dir):
    return FL.in_region(D.page_blocks(spark, sf_dir), 100, 60, 500, 200).select(*IDS)


def _win10(spark, sf_dir):
    rows = _with_rect(D.page_blocks(spark, sf_dir)).withColumn("row_id", F.expr("(t - 50) div 28").cast("int"))
    return W.row_gaps(rows, ("doc_id", "page")).select("doc_id", "page", "row_id", "l", "r")


_WIN10 = PB + f""", b AS (SELECT doc_id, page, (t - 50) // 28 AS row_id, l, r, min(l) OVER (PARTITION BY doc_id) - 1 AS pl, max(r) OVER (PARTITION BY doc_id) + 1 AS pr FROM (SELECT *, {AABB_SQL} FROM page_blocks)),
f AS (SELECT *, greatest(coalesce(max(r) OVER (PARTITION BY doc_id, row_id ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), pl), pl) AS pos FROM b)
SELECT doc_id, page, row_id, pos AS l, l AS r FROM f WHERE l > pos UNION ALL SELECT doc_id, page, row_id, max(r), max(pr) FROM f GROUP BY ALL"""


def _win11(spark, sf_dir):
    rows = _with_rect(D.page_blocks(spark, sf_dir)).withColumns({"l": F.col("l") - 300, "r": F.col("r") - 300})
    return W.shift_to_origin(rows).select(*IDS, *"ltrb")


_WIN11 = PB + f""", b AS (SELECT doc_id, page, block_id, l - 300 AS l, t, r - 300 AS r, b FROM (SELECT *, {AABB_SQL} FROM page_blocks)),
m AS (SELECT *, min(l) OVER w AS x, min(t) OVER w AS y FROM b WINDOW w AS (PARTITION BY doc_id, page))
SELECT doc_id, page, block_id, CASE WHEN x < 0 OR y < 0 THEN l - x ELSE l END AS l, CASE WHEN x < 0 OR y < 0 THEN t - y ELSE t END AS t,
    CASE WHEN x < 0 OR y < 0 THEN r - x ELSE r END AS r, CASE WHEN x < 0 OR y < 0 THEN b - y ELSE b END AS b FROM m"""


def _pag01(spark, sf_dir):
    rows = P.preprocess(D.page_blocks(spark, sf_dir, True))
    return rows.select(*IDS, *[F.round(c, 5).alias(c) for c in "ltrb"], F.col("seq"))


def _pre_sql(blocks: str) -> str:
    xs, ys = [f"box[{2 * i + 1}]" for i in range(4)], [f"box[{2 * i + 2}]" for i in range(4)]
    rx, ry = [f"(cos(-turn) * {x} - sin(-turn) * {y})" for x, y in zip(xs, ys, strict=True)], [f"(sin(-turn) * {x} + cos(-turn) * {y})" for x, y in zip(xs, ys, strict=True)]
    sides = (("least", xs, rx, "l"), ("least", ys, ry, "t"), ("greatest", xs, rx, "r"), ("greatest", ys, ry, "b"))
    cases = ", ".join(f"CASE WHEN tilted THEN {f}({', '.join(q)}) ELSE {f}({', '.join(p)})::DOUBLE END AS {n}" for f, p, q, n in sides)
    return f"""a AS (SELECT *, median({ANGLE_SQL}) OVER (PARTITION BY doc_id, page) AS turn FROM {blocks} WHERE text <> ''),
k AS (SELECT *, abs(turn) > radians(3) AS tilted FROM a), q AS (SELECT doc_id, page, block_id, text, tilted, {cases} FROM k),
m AS (SELECT *, min(l) OVER w AS x, min(t) OVER w AS y FROM q WINDOW w AS (PARTITION BY doc_id, page)),
pre AS (SELECT doc_id, page, block_id, text, CASE WHEN tilted AND (x < 0 OR y < 0) THEN l - x ELSE l END AS l, CASE WHEN tilted AND (x < 0 OR y < 0) THEN t - y ELSE t END AS t,
    CASE WHEN tilted AND (x < 0 OR y < 0) THEN r - x ELSE r END AS r, CASE WHEN tilted AND (x < 0 OR y < 0) THEN b - y ELSE b END AS b FROM m)"""


_PAG01 = SKEW + ", " + _pre_sql("skew_blocks") + """
SELECT doc_id, page, block_id, round(l, 5) AS l, round(t, 5) AS t, round(r, 5) AS r, round(b, 5) AS b, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY round(t, 6), block_id) - 1 AS INTEGER) AS seq FROM pre"""


def _queries_table(spark):
    return spark.createDataFrame([(1, "the", 1, "center"), (2, "der", 2, "topleft"), (3, "zzz", 1, "center"), (4, "LA", 0, "bottomright")], "query_id int, q string, n int, loc string")


def _fnd03(spark, sf_dir):
    return S.find_text_many(D.page_blocks(spark, sf_dir), _queries_table(spark))


def _hits_sql(q: str, n: str, loc: str) -> str:
    """x and y of the n-th block of each page that holds q."""
    low = f"translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    places = {"center": ("x0 + trunc((s + e) / 2 * (x1 - x0))", "trunc((y0 + y3) / 2)"), "topleft": ("x0 + trunc(s * (x1 - x0))", "y0"), "bottomright": ("x3 + trunc(e * (x2 - x3))", "y2")}
    x, y = places[loc]
    return f"""
SELECT doc_id, page, block_id, CAST({x} AS INTEGER) AS x, CAST({y} AS INTEGER) AS y FROM (
    SELECT *, {_CORNERS}, {ratio_sql('text', 'st')} AS s, {ratio_sql('text', f'(st + {len(q)})')} AS e FROM (
        SELECT *, instr({low}, '{q.lower()}') - 1 AS st, row_number() OVER (PARTITION BY doc_id, page ORDER BY block_id) AS pos FROM page_blocks WHERE contains({low}, '{q.lower()}'))
    WHERE pos = {n})"""


_FND03 = PB + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT {i} AS query_id, * FROM ({_hits_sql(q, n, loc)})" for i, q, n, loc in ((1, "the", 1, "center"), (2, "der", 2, "topleft"), (3, "zzz", 1, "center"), (4, "LA", 1, "bottomright"))) + ")"


def _positions(spark, sf_dir):
    return S.all_positions(D.page_blocks(spark, sf_dir, True), "topright").select(*IDS, "text", "x", "y")


def _list(spark, sf_dir):
    return S.list_blocks(D.page_blocks(spark, sf_dir)).select("doc_id", "page", "index", "text", F.array_join(F.transform("box", lambda v: v.cast("string")), ",").alias("box"))


def _jon12(spark, sf_dir):
    pages = D.given(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page"))
    found = R.collect_pages(FL.contains_text(D.page_blocks(spark, sf_dir), "la"))
    return J.pages_with_blocks(pages, found).select("doc_id", "page", F.size("blocks").cast("long").alias("n"))


def _gaps(spark, sf_dir, row: int):
    rows = _with_rect(D.page_blocks(spark, sf_dir)).withColumn("row_id", F.expr("(t - 50) div 28").cast("int"))
    return W.row_gaps(rows, ("doc_id", "page")).filter(F.col("row_id") == row).select("doc_id", "l", "r")


def _jon13(spark, sf_dir):
    return J.gap_intersection(_gaps(spark, sf_dir, 0), _gaps(spark, sf_dir, 1), ("doc_id",))


_JON13 = _WIN10.replace("\nSELECT doc_id, page, row_id, pos AS l", "\n, g AS (SELECT doc_id, page, row_id, pos AS l", 1) + """),
upper AS (SELECT * FROM g WHERE row_id = 0), lower AS (SELECT * FROM g WHERE row_id = 1)
SELECT u.doc_id, 'kept' AS kind, greatest(u.l, v.l) AS l, least(u.r, v.r) AS r FROM upper u JOIN lower v ON u.doc_id = v.doc_id AND greatest(u.l, v.l) <= least(u.r, v.r)
UNION ALL SELECT doc_id, 'new', l, r FROM lower v WHERE NOT EXISTS (SELECT 1 FROM upper u WHERE u.doc_id = v.doc_id AND greatest(u.l, v.l) <= least(u.r, v.r))
UNION ALL SELECT doc_id, 'removed', l, r FROM upper u WHERE NOT EXISTS (SELECT 1 FROM lower v WHERE u.doc_id = v.doc_id AND greatest(u.l, v.l) <= least(u.r, v.r))"""


def _agg07(spark, sf_dir):
    out = A.font_stats(_with_rect(D.page_blocks(spark, sf_dir)))
    return out.select("doc_id", "page", F.round("font_height", 9).alias("font_height"), F.round("char_width", 9).alias("char_width"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
QUERIES = {
    "src_03_explode_blocks": Query(_src03, PB + " SELECT doc_id, page, CAST(block_id AS INTEGER) AS seq, CAST(block_id AS INTEGER) AS block_id, text, round(score, 9) AS score FROM page_blocks"),
    "src_04_collect_pages": Query(_src04, PB + " SELECT doc_id, page, count(*) AS n, string_agg(text, '|' ORDER BY block_id) AS texts FROM page_blocks GROUP BY doc_id, page"),
    "src_05_select_pages": Query(_src05, _SRC05),
    "snk_01_records": Query(_snk01, _SNK01),
    "snk_02_error_records": Query(lambda s, d: K.error_records(_results(s, d), "doc_id", "page"), _RESULTS + r""" SELECT doc_id, page, '{"doc_id":' || doc_id || ',"page":0,"code":1,"msg":"can''t read \"page\""}' AS record FROM results WHERE code <> 0"""),
    "snk_06_text_layer": Query(_snk06, _SNK06),
    "flt_01_non_empty": Query(lambda s, d: FL.non_empty(D.page_blocks(s, d)).select(*IDS, "text"), PB + " SELECT doc_id, page, block_id, text FROM page_blocks WHERE text <> ''"),
    "flt_02_box_quality": Query(lambda s, d: FL.box_quality(D.page_blocks(s, d), min_side=40.0, grown_side=50.0, grow=4.0, per_page=20).select(*IDS), PB + " SELECT doc_id, page, block_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY block_id) AS k, greatest(box[3] - box[1], 20) AS side FROM page_blocks) WHERE k <= 20 AND score >= 0.6 AND side >= 40 AND side + 8 >= 50"),
    "flt_04_contains_text": Query(lambda s, d: FL.contains_text(D.page_blocks(s, d), "La").select(*IDS, "text"), PB + " SELECT doc_id, page, block_id, text FROM page_blocks WHERE contains(text, 'La')"),
    "flt_05_matches_text": Query(lambda s, d: D.page_blocks(s, d).filter(FL.matches_text(F.col("text"), F.lit("DER É"))).select(*IDS, "text"), PB + f" SELECT doc_id, page, block_id, text FROM page_blocks WHERE contains({_LOWER}, 'der É')"),
    "flt_06_in_region": Query(_flt06, PB + f" SELECT doc_id, page, block_id FROM (SELECT *, {AABB_SQL} FROM page_blocks) WHERE (l + r) / 2.0 >= 100 AND (l + r) / 2.0 < 600 AND (t + b) / 2.0 >= 60 AND (t + b) / 2.0 < 260"),
    "win_01_nth_match": Query(lambda s, d: W.nth_match(D.page_blocks(s, d), F.lit("La"), 2).select(*IDS), PB + f" SELECT doc_id, page, block_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY block_id) AS k FROM page_blocks WHERE contains({_LOWER}, 'la')) WHERE k = 2"),
    "win_02_separators": Query(lambda s, d: W.separators(FL.non_empty(D.page_blocks(s, d)), order="block_id").select(*IDS, "end"), PB + f", n AS (SELECT *, lead(text) OVER (PARTITION BY doc_id, page ORDER BY block_id) AS nx FROM page_blocks WHERE text <> '') SELECT doc_id, page, block_id, CASE WHEN nx IS NULL THEN chr(10) ELSE {text_separator_sql('text', 'nx')} END AS \"end\" FROM n"),
    "win_10_row_gaps": Query(_win10, _WIN10),
    "win_11_shift_to_origin": Query(_win11, _WIN11),
    "srt_01_order_by_top": Query(lambda s, d: W.order_by_top(_with_rect(D.page_blocks(s, d))).select(*IDS, "seq"), PB + f" SELECT doc_id, page, block_id, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY t, block_id) - 1 AS INTEGER) AS seq FROM (SELECT *, {AABB_SQL} FROM page_blocks)"),
    "srt_02_top_candidates": Query(lambda s, d: FL.top_candidates(D.page_blocks(s, d), 7).select(*IDS), PB + " SELECT doc_id, page, block_id FROM page_blocks QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY block_id) <= 7"),
    "agg_01_assemble_text": Query(lambda s, d: A.assemble_text(D.page_blocks(s, d), order="block_id"), PB + " SELECT doc_id, page, string_agg(text || \"end\", '' ORDER BY block_id) AS text, count(*) AS block_count FROM page_blocks GROUP BY doc_id, page"),
    "agg_02_assemble_document": Query(lambda s, d: A.assemble_document(D.given(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), "text")), r"SELECT conv_id AS doc_id, string_agg(text || CASE WHEN n > 1 THEN chr(10) || '--- ' || (turn + 1) || ' ---' || chr(10) ELSE '' END, '' ORDER BY turn) AS text FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) GROUP BY conv_id"),
    "agg_03_page_rotation": Query(lambda s, d: A.page_rotation(FL.non_empty(D.page_blocks(s, d, True))).select("doc_id", "page", F.round("rotation", 9).alias("rotation")), SKEW + f" SELECT doc_id, page, round(median(a), 9) AS rotation FROM (SELECT *, {ANGLE_SQL} AS a FROM skew_blocks WHERE text <> '') GROUP BY doc_id, page"),
    "agg_07_font_stats": Query(_agg07, PB + f" SELECT doc_id, page, round(coalesce(avg(CASE WHEN b > t THEN b - t END), 0.15), 9) AS font_height, round(coalesce(avg(CASE WHEN r > l AND text <> '' THEN (r - l) / strlen(text) END), 0.1), 9) AS char_width FROM (SELECT *, {AABB_SQL} FROM page_blocks) GROUP BY doc_id, page"),
    "agg_17_mean_stdev": Query(lambda s, d: A.mean_and_stdev(D.page_blocks(s, d), "score", ("doc_id",)).select("doc_id", F.round("mean", 9).alias("mean"), F.round("stdev", 9).alias("stdev")), PB + " SELECT doc_id, round(avg(score), 9) AS mean, round(coalesce(stddev_samp(score), 0.0), 9) AS stdev FROM page_blocks GROUP BY doc_id"),
    "agg_18_run_summary": Query(lambda s, d: A.run_summary(_results(s, d)), _RESULTS + " SELECT count(*) AS files, count(*) FILTER (code <> 0) AS failed, CASE WHEN count(*) FILTER (code <> 0) > 0 THEN 1 ELSE 0 END AS exit_code FROM results"),
    "pag_01_preprocess": Query(_pag01, _PAG01),
    "jon_12_pages_with_blocks": Query(_jon12, PB + " SELECT d.doc_id, 0 AS page, count(b.block_id) AS n FROM documents d LEFT JOIN page_blocks b ON d.doc_id = b.doc_id AND contains(b.text, 'la') GROUP BY d.doc_id"),
    "jon_13_gap_intersection": Query(_jon13, _JON13),
    "fnd_01_find_text": Query(lambda s, d: S.find_text(D.page_blocks(s, d), "The", 1, "center"), PB + _hits_sql("The", "1", "center")),
    "fnd_02_list_blocks": Query(_list, PB + " SELECT doc_id, page, block_id AS index, text, array_to_string(box, ',') AS box FROM page_blocks"),
    "fnd_02_all_text": Query(lambda s, d: S.all_text(D.page_blocks(s, d)), PB + " SELECT doc_id, page, string_agg(text, chr(10) ORDER BY block_id) AS text FROM page_blocks GROUP BY doc_id, page"),
    "fnd_02_all_positions": Query(_positions, SKEW + " SELECT doc_id, page, block_id, text, box[3] AS x, box[4] AS y FROM skew_blocks"),
    "fnd_02_has_text": Query(lambda s, d: S.has_text(D.page_blocks(s, d), "La "), PB + " SELECT doc_id, page, bool_or(contains(text, 'La ')) AS found FROM page_blocks GROUP BY doc_id, page"),
    "fnd_03_find_text_many": Query(_fnd03, _FND03),
}
