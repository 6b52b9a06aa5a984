"""Queries of the scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import html as H
from pagewright.functions import params as PR
from pagewright.functions import text as T
from pagewright.queries import Query
from pagewright.sources import derived as D
from pagewright.sources.records import read_query_params

KEY = ("doc_id", "block_id")
PB = D.with_sql("page_blocks")
GC = D.with_sql("grid_cells", "grid_blocks")


def _blocks(columns, skew=False):
    """A query of columns over page blocks."""

    def run(spark, sf_dir):
        return D.page_blocks(spark, sf_dir, skew).select(*KEY, *[c.alias(n) for n, c in columns().items()])

    return run


def _first(cp: str, ranges) -> str:
    return "(" + " OR ".join(f"{cp} BETWEEN {a} AND {b}" for a, b in ranges) + ")"


def _cp(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN 0 ELSE unicode({text}) END"


def _punct_sql(cp: str) -> str:
    return f"CASE WHEN {cp} < 128 THEN {cp} IN ({', '.join(str(ord(c)) for c in T.ASCII_PUNCT)}) ELSE {_first(cp, T.PUNCT_RANGES)} END"


def separator_sql(before: str, after: str) -> str:
    """The separator between two code points, in SQL."""
    return f"CASE WHEN ({_first(before, T.CJK_RANGES)} AND {_first(after, T.CJK_RANGES)}) OR {before} = 45 OR ({_punct_sql(after)}) THEN '' ELSE ' ' END"


def text_separator_sql(before: str, after: str) -> str:
    return separator_sql(f"({_cp(f'right({before}, 1)')})", f"({_cp(after)})")


#: A text for the character classes: every second document's text, with other letters and signs mixed in.
def _mixed(text):
    return F.when(F.col("block_id") % 2 == 0, F.concat(F.lit("中ア한，…é "), text, F.lit("。¿x‰"))).otherwise(text)


_MIXED_SQL = "CASE WHEN block_id % 2 = 0 THEN '中ア한，…é ' || text || '。¿x‰' ELSE text END"
_MIX = PB + f", m AS (SELECT *, {_MIXED_SQL} AS mixed FROM page_blocks)"


def _weights_sql(text: str) -> str:
    wide = T.WIDE_CLASS.replace("\\x{", "\\x{")
    n = f"length({text})"
    w, a = f"({n} - length(regexp_replace({text}, '{wide}', '', 'g')))", f"({n} - length(regexp_replace({text}, '{T.NARROW_CLASS}', '', 'g')))"
    return f"({w} * {T.WIDE}::DOUBLE + {a} * {T.NARROW}::DOUBLE + ({n} - {w} - {a}) * {T.OTHER}::DOUBLE)"


RATIO_SQL = "CASE WHEN {w} > 0 THEN {p} / {w} ELSE 0.0 END"


def ratio_sql(text: str, index: str) -> str:
    return RATIO_SQL.format(w=_weights_sql(text), p=_weights_sql(f"left({text}, {index})"))


def _scl06(spark, sf_dir):
    rows = D.page_blocks(spark, sf_dir).withColumn("mixed", _mixed(F.col("text")))
    return rows.select(*KEY, *[F.round(T.weighted_char_ratio(F.col("mixed"), i), 9).alias(f"ratio_{i}") for i in (0, 3, 10)])


def _box_sql(i: int) -> tuple[str, str]:
    return f"box[{2 * i + 1}]", f"box[{2 * i + 2}]"


_XS, _YS = [_box_sql(i)[0] for i in range(4)], [_box_sql(i)[1] for i in range(4)]
AABB_SQL = f"least({', '.join(_XS)}) AS l, least({', '.join(_YS)}) AS t, greatest({', '.join(_XS)}) AS r, greatest({', '.join(_YS)}) AS b"
_FOLD = math.radians(G.UPRIGHT_DEG)
ANGLE_SQL = f"""(SELECT CASE WHEN a < {-math.pi / 2 + _FOLD!r} THEN a + {math.pi!r} WHEN a >= {math.pi / 2 + _FOLD!r} THEN a - {math.pi!r} ELSE a END FROM (
    SELECT CASE WHEN sqrt((box[3] - box[1]) ^ 2 + (box[4] - box[2]) ^ 2) < sqrt((box[5] - box[3]) ^ 2 + (box[6] - box[4]) ^ 2)
        THEN atan2(box[6] - box[4], box[5] - box[3]) ELSE atan2(box[4] - box[2], box[3] - box[1]) END AS a) q)"""


def _pairs(spark, sf_dir):
    """Cells with a block of their page and row: neighbours and equals."""
    cells = D.grid_cells(spark, sf_dir).select("page_id", "cell_id", "r", *[F.col(c).alias(n) for c, n in zip(("x1", "y1", "x2", "y2"), ("c_l", "c_t", "c_r", "c_b"), strict=True)])
    blocks = D.grid_blocks(spark, sf_dir).select("page_id", F.expr("block_id div 4").alias("r"), "block_id", *[F.col(c).alias(f"k_{c}") for c in "ltrb"])
    return cells.join(blocks, ["page_id", "r"])


_PAIRS = GC + """, pairs AS (
    SELECT c.page_id, cell_id, block_id, c.x1 AS c_l, c.y1 AS c_t, c.x2 AS c_r, c.y2 AS c_b, k.l AS k_l, k.t AS k_t, k.r AS k_r, k.b AS k_b
    FROM grid_cells c JOIN grid_blocks k ON c.page_id = k.page_id AND c.r = k.block_id // 4)"""
OVERLAP_SQL = "greatest(least(c_r, k_r) - greatest(c_l, k_l), 0) * greatest(least(c_b, k_b) - greatest(c_t, k_t), 0)"
IOU_SQL = f"CASE WHEN {OVERLAP_SQL} > 0 THEN {OVERLAP_SQL} / ((c_r - c_l) * (c_b - c_t) + (k_r - k_l) * (k_b - k_t) - {OVERLAP_SQL} + 1e-8) ELSE 0.0 END"


def _pair_query(columns):
    def run(spark, sf_dir):
        return _pairs(spark, sf_dir).select("page_id", "cell_id", "block_id", *[c.alias(n) for n, c in columns().items()])

    return run


def _rects():
    return G.Rect(*(F.col(f"c_{c}") for c in "ltrb")), G.Rect(*(F.col(f"k_{c}") for c in "ltrb"))


def _align_sql(lo: str, hi: str) -> str:
    return f"(least(c_{hi}, k_{hi}) - greatest(c_{lo}, k_{lo})) / greatest(c_{hi} - c_{lo}, k_{hi} - k_{lo}, 0.01::DOUBLE)"


def _lines(spark, sf_dir):
    """Ruled lines, every third a little off and every fifth turned around."""
    rows = D.ruled_lines(spark, sf_dir)
    off = (F.col("line_id") % 3).cast("int")
    swap = F.col("line_id") % 5 == 0
    rows = rows.withColumn("y2", F.col("y2") + off)
    return rows.select("page_id", "line_id", *[F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))])


_LINES = D.with_sql("ruled_lines") + """, o AS (SELECT page_id, line_id, x1, y1, x2, CAST(y2 + line_id % 3 AS INTEGER) AS y2 FROM ruled_lines),
ln AS (SELECT page_id, line_id, CASE WHEN line_id % 5 = 0 THEN x2 ELSE x1 END AS x1, CASE WHEN line_id % 5 = 0 THEN y2 ELSE y1 END AS y1,
    CASE WHEN line_id % 5 = 0 THEN x1 ELSE x2 END AS x2, CASE WHEN line_id % 5 = 0 THEN y1 ELSE y2 END AS y2 FROM o)"""


def _scl19(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    props = G.line_props(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    return rows.select("page_id", "line_id", *[(F.round(c, 6) if n in ("length", "angle") else c).alias(n) for n, c in props.items()])


def _scl20(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return rows.select("page_id", "line_id", *[c.alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), G.snap_line(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))), strict=True)])


def _region():
    box = F.concat_ws(",", F.get("box", F.lit(0)), F.get("box", F.lit(1)), F.get("box", F.lit(2)) - F.get("box", F.lit(0)), F.lit(20))
    return F.when(F.col("block_id") % 4 == 0, F.concat(box, F.lit(",x"))).when(F.col("block_id") % 4 == 1, F.concat(F.lit("-"), box)).otherwise(box)


_REGION_SQL = "CASE block_id % 4 WHEN 0 THEN concat_ws(',', box[1], box[2], box[3] - box[1], 20) || ',x' WHEN 1 THEN '-' || concat_ws(',', box[1], box[2], box[3] - box[1], 20) ELSE concat_ws(',', box[1], box[2], box[3] - box[1], 20) END"


def _scl18(spark, sf_dir):
    return D.page_blocks(spark, sf_dir).select(*KEY, PR.parse_region(_region()).alias("g")).select(*KEY, "g.*")


def _scl26(spark, sf_dir):
    rows = D.page_blocks(spark, sf_dir)
    given = {"padding": F.col("block_id") % 3, "max_side_len": (F.col("block_id") % 2) * 960, "box_score_thresh": F.when(F.col("block_id") % 5 == 0, 0.0).otherwise(F.col("score")), "unclip_ratio": F.col("angle_score")}
    return rows.select(*KEY, *[c.alias(n) for n, c in PR.default_params(**given).items()])


def _scl25(spark, sf_dir):
    rows = D.components(spark, sf_dir).groupBy("page_id").agg(F.min(F.col("r") - F.col("l")).cast("double").alias("low"), F.avg(F.col("r") - F.col("l")).alias("mean"))
    return rows.select("page_id", F.round(PR.char_length_choice(F.col("low"), F.col("mean")), 9).alias("char_length"))


_ENTITIES = "CASE WHEN page_id % 3 = 0 THEN '&#65;&#x42;&#200;&nbsp;&amp;lt;' ELSE '' END"


def _scl27(spark, sf_dir):
    rows = D.given(spark, sf_dir, "pages")
    extra = F.when(F.col("page_id") % 3 == 0, "&#65;&#x42;&#200;&nbsp;&amp;lt;").otherwise("")
    return rows.select("page_id", H.html_unescape(F.concat(F.col("html"), extra)).alias("text"))


def _nested_replace(text: str) -> str:
    for a, b in H.ENTITIES:
        text = f"replace({text}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return text


_SCL27 = f"""SELECT page_id, replace(replace(replace(replace({_nested_replace(f"(html || {_ENTITIES})")}, '&#65;', 'A'), '&#x42;', 'B'), '&#200;', ''), '&amp;', '&') AS text FROM pages"""

_TD = "<TD ColSpan=\"{0}\" rowspan='{1}' STYLE='width : {2}px; height:{3}%'>"


def _scl28(spark, sf_dir):
    cells = D.grid_cells(spark, sf_dir)
    tag = F.format_string(_TD.format("%d", "%d", "%d", "%d").replace("%'", "%%'"), F.col("c") + 1, F.col("r") + 1, F.col("x2"), F.col("y2"))
    rows = cells.withColumn("tag", tag).withColumn("style", H.html_attr(F.col("tag"), "style"))
    return rows.select("page_id", "cell_id", H.int_attr(F.col("tag"), "colspan", 1).alias("colspan"), H.html_attr(F.col("tag"), "rowspan").alias("rowspan"), H.html_attr(F.col("tag"), "class").alias("none"), H.style_px(F.col("style"), "width").alias("width_px"), H.style_pct(F.col("style"), "height").alias("height_pct"), H.style_pct(F.col("style"), "width").alias("width_pct"))


_PARTIAL = {"topleft": ("x0 + trunc(s * (x1 - x0))", "y0"), "bottomright": ("x3 + trunc(e * (x2 - x3))", "y2"), "center": ("x0 + trunc((s + e) / 2 * (x1 - x0))", "trunc((y0 + y3) / 2)")}
_CORNERS = ", ".join(f"{_box_sql(i)[0]} AS x{i}, {_box_sql(i)[1]} AS y{i}" for i in range(4))


def _scl16():
    return {f"{c}_{loc}": v for loc in ("topleft", "topright", "bottomleft", "bottomright", "center", "elsewhere") for c, v in zip("xy", G.anchor_point(F.col("box"), F.lit(loc)), strict=True)}


def _scl17():
    s, e = T.weighted_char_ratio(F.col("text"), 2), T.weighted_char_ratio(F.col("text"), 6)
    return {f"{c}_{loc}": v for loc in _PARTIAL for c, v in zip("xy", G.point_between(F.col("box"), F.lit(loc), s, e), strict=True)}


def _shuffled_box():
    at = F.col("block_id") % 4
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.get("box", ((k + 2 * at) % 8).cast("int")))


def _scl22():
    return {"distance": F.round(G.unclip_distance(F.col("box"), 1.5), 9)}


def _scl23():
    out = G.restore_box(F.col("box"), F.lit(0.5), F.lit(0.8), 10, F.lit(1000), F.lit(800))
    return {f"v{k}": F.get(out, F.lit(k)) for k in range(8)}


def _restore_sql() -> str:
    out = []
    for i in range(4):
        out.append(f"CAST(least(greatest(trunc({_box_sql(i)[0]} / 0.5), 0), 999) - 10 AS INTEGER) AS v{2 * i}")
        out.append(f"CAST(least(greatest(trunc({_box_sql(i)[1]} / 0.8), 0), 799) - 10 AS INTEGER) AS v{2 * i + 1}")
    return f"{PB} SELECT doc_id, block_id, {', '.join(out)} FROM page_blocks"


def _scl24():
    out = G.order_corners(_shuffled_box())
    return {f"v{k}": F.get(out, F.lit(k)) for k in range(8)}


def _scl29(spark, sf_dir):
    from pagewright.operators.blocks import coords_report

    return coords_report(D.page_blocks(spark, sf_dir))


_SCL29 = PB + """
SELECT doc_id, page, string_agg(printf('block %d: %s\n  score: %.4f\n  box: (%d,%d) - (%d,%d) - (%d,%d) - (%d,%d)\n  angle: 0 deg (score: 0.0000)',
    block_id + 1, text, score, box[1], box[2], box[3], box[4], box[5], box[6], box[7], box[8]), chr(10) || chr(10) ORDER BY block_id) AS report
FROM page_blocks GROUP BY doc_id, page"""


def _src06(spark, sf_dir):
    rows = read_query_params(D.given(spark, sf_dir, "pages").select("page_id", "url"))
    return rows.select("page_id", F.explode("params").alias("key", "value"))


_SRC06 = r"""
WITH q AS (SELECT page_id, unnest(l) AS p, unnest(range(len(l))) AS k FROM (SELECT page_id, string_split(regexp_extract(url, '\?([^#]*)', 1), '&') AS l FROM pages)),
e AS (SELECT page_id, k, split_part(p, '=', 1) AS key, CASE WHEN contains(p, '=') THEN substr(p, instr(p, '=') + 1) ELSE '' END AS value FROM q WHERE p <> '')
SELECT page_id, key, arg_max(value, k) AS value FROM e GROUP BY page_id, key"""

_ROT = [f"cos({{a}}) * {x} - sin({{a}}) * {y}" for x, y in map(_box_sql, range(4))], [f"sin({{a}}) * {x} + cos({{a}}) * {y}" for x, y in map(_box_sql, range(4))]
_A = "-0.1::DOUBLE"


def _rotated_sql() -> str:
    xs, ys = ([e.format(a=_A) for e in side] for side in _ROT)
    return ", ".join(f"round({f}({', '.join(v)}), 6) AS {n}" for f, v, n in (("least", xs, "l"), ("least", ys, "t"), ("greatest", xs, "r"), ("greatest", ys, "b")))


_SNAP = """
SELECT page_id, line_id,
    CASE WHEN slope >= 85 THEN mx ELSE least(x1, x2) END AS x1, CASE WHEN slope <= 5 THEN my ELSE least(y1, y2) END AS y1,
    CASE WHEN slope >= 85 THEN mx ELSE greatest(x1, x2) END AS x2, CASE WHEN slope <= 5 THEN my ELSE greatest(y1, y2) END AS y2
FROM (SELECT *, degrees(atan2(abs(y2 - y1), abs(x2 - x1))) AS slope, CAST(round((y1 + y2) / 2.0) AS INTEGER) AS my, CAST(round((x1 + x2) / 2.0) AS INTEGER) AS mx FROM ln)"""

_ORDERED = """
, turned AS (SELECT doc_id, block_id, list_transform(range(8), lambda k: box[(k + 2 * (block_id % 4)) % 8 + 1]) AS q FROM page_blocks),
p AS (SELECT doc_id, block_id, list_sort([{'x': q[1], 'y': q[2]}, {'x': q[3], 'y': q[4]}, {'x': q[5], 'y': q[6]}, {'x': q[7], 'y': q[8]}]) AS p FROM turned),
o AS (SELECT doc_id, block_id, CASE WHEN p[2].y > p[1].y THEN p[1] ELSE p[2] END AS tl, CASE WHEN p[2].y > p[1].y THEN p[2] ELSE p[1] END AS bl,
    CASE WHEN p[4].y > p[3].y THEN p[3] ELSE p[4] END AS tr, CASE WHEN p[4].y > p[3].y THEN p[4] ELSE p[3] END AS br FROM p)
SELECT doc_id, block_id, tl.x AS v0, tl.y AS v1, tr.x AS v2, tr.y AS v3, br.x AS v4, br.y AS v5, bl.x AS v6, bl.y AS v7 FROM o"""

_SPACING = """(c_b > c_t AND k_b > k_t AND abs((c_b - c_t) - (k_b - k_t)) <= ((c_b - c_t) + (k_b - k_t)) / 2.0 * 0.15::DOUBLE
    AND NOT (c_b - (c_b - c_t) * 0.1::DOUBLE > 0 AND k_b - (k_b - k_t) * 0.1::DOUBLE > 0
        AND abs(abs(k_b - (k_b - k_t) * 0.1::DOUBLE - (c_b - (c_b - c_t) * 0.1::DOUBLE)) - (c_b - c_t) * 1.2::DOUBLE) > ((c_b - c_t) + (k_b - k_t)) / 2.0 * 0.15::DOUBLE))"""


def _scl14():
    gap, columns, rows = G.closeness(*_rects())
    return {"gap": gap, "col_align": F.round(columns, 9), "row_align": F.round(rows, 9)}


def _scl15(spark, sf_dir):
    """Blocks of a page against those one, two and three rows further down, heights stretched by their inset."""
    rows = D.grid_blocks(spark, sf_dir)
    a = rows.select("page_id", F.col("block_id").alias("a"), *[F.col(c).alias(f"c_{c}") for c in "ltrb"])
    b = rows.select("page_id", F.col("block_id").alias("b"), *[F.col(c).alias(f"k_{c}") for c in "ltrb"])
    pairs = a.withColumn("b", F.explode(F.array(*[F.col("a") + 4 * k for k in (1, 2, 3)]))).join(b, ["page_id", "b"])
    return pairs.select("page_id", "a", "b", G.spacing_match(*_rects()).alias("same"))


_SCL15 = GC + f"""
SELECT page_id, a, b, {_SPACING} AS same FROM (
    SELECT x.page_id, x.block_id AS a, y.block_id AS b, x.l AS c_l, x.t AS c_t, x.r AS c_r, x.b AS c_b, y.l AS k_l, y.t AS k_t, y.r AS k_r, y.b AS k_b
    FROM grid_blocks x JOIN grid_blocks y ON x.page_id = y.page_id AND y.block_id IN (x.block_id + 4, x.block_id + 8, x.block_id + 12))"""

_PAGE = "doc_id, block_id"
QUERIES = {
    "scl_01_code_points": Query(_blocks(lambda: {"first": T.first_cp(_mixed(F.col("text"))), "last": T.last_cp(_mixed(F.col("text")))}), f"{_MIX} SELECT {_PAGE}, {_cp('mixed')} AS first, {_cp('right(mixed, 1)')} AS last FROM m"),
    "scl_02_is_cjk": Query(_blocks(lambda: {"first": T.is_cjk(T.first_cp(_mixed(F.col("text")))), "last": T.is_cjk(T.last_cp(_mixed(F.col("text"))))}), f"{_MIX} SELECT {_PAGE}, {_first(f'({_cp("mixed")})', T.CJK_RANGES)} AS first, {_first(f'({_cp("right(mixed, 1)")})', T.CJK_RANGES)} AS last FROM m"),
    "scl_03_is_punct": Query(_blocks(lambda: {"first": T.is_punct(T.first_cp(_mixed(F.col("text")))), "last": T.is_punct(T.last_cp(_mixed(F.col("text"))))}), f"{_MIX} SELECT {_PAGE}, {_punct_sql(f'({_cp("mixed")})')} AS first, {_punct_sql(f'({_cp("right(mixed, 1)")})')} AS last FROM m"),
    "scl_04_word_separator": Query(_blocks(lambda: {"sep": T.text_separator(F.col("text"), _mixed(F.col("text"))), "back": T.text_separator(_mixed(F.col("text")), F.col("text"))}), f"{_MIX} SELECT {_PAGE}, {text_separator_sql('text', 'mixed')} AS sep, {text_separator_sql('mixed', 'text')} AS back FROM m"),
    "scl_05_offsets": Query(_blocks(lambda: {"n": T.char_count(_mixed(F.col("text"))), "at": T.byte_offset(_mixed(F.col("text")), 5)}), f"{_MIX} SELECT {_PAGE}, CAST(length(mixed) AS INTEGER) AS n, CAST(strlen(left(mixed, 5)) AS INTEGER) AS at FROM m"),
    "scl_06_weighted_ratio": Query(_scl06, f"{_MIX} SELECT {_PAGE}, " + ", ".join(f"round({ratio_sql('mixed', str(i))}, 9) AS ratio_{i}" for i in (0, 3, 10)) + " FROM m"),
    "scl_07_aabb": Query(_blocks(lambda: G.aabb(F.col("box"))._asdict() | {}, True), D.with_sql("skew_blocks") + f" SELECT {_PAGE}, l AS \"left\", t AS top, r AS \"right\", b AS bottom FROM (SELECT *, {AABB_SQL} FROM skew_blocks)"),
    "scl_08_block_angle": Query(_blocks(lambda: {"angle": F.round(G.block_angle(F.col("box")), 9)}, True), D.with_sql("skew_blocks") + f" SELECT {_PAGE}, round({ANGLE_SQL}, 9) AS angle FROM skew_blocks"),
    "scl_09_rotate_box": Query(_blocks(lambda: {n: F.round(c, 6) for n, c in zip("ltrb", G.rotate_box(F.col("box"), F.lit(0.1)), strict=True)}, True), D.with_sql("skew_blocks") + f" SELECT {_PAGE}, {_rotated_sql()} FROM skew_blocks"),
    "scl_10_rotate_ccw90": Query(_blocks(lambda: {f"v{k}": F.get(G.rotate_box_ccw90(F.col("box"), F.lit(612.5), F.lit(400.0)), F.lit(k)) for k in range(8)}), f"{PB} SELECT {_PAGE}, " + ", ".join(f"CAST(round({y} + 212.5::DOUBLE) AS INTEGER) AS v{2 * i}, CAST(round(1012.5::DOUBLE - {x}) AS INTEGER) AS v{2 * i + 1}" for i, (x, y) in enumerate(map(_box_sql, range(4)))) + " FROM page_blocks"),
    "scl_11_iou": Query(_pair_query(lambda: {"iou": F.round(G.iou(*_rects()), 9)}), f"{_PAIRS} SELECT page_id, cell_id, block_id, round({IOU_SQL}, 9) AS iou FROM pairs"),
    "scl_12_corner_distance": Query(_pair_query(lambda: {"distance": G.corner_distance(*_rects())}), f"{_PAIRS} SELECT page_id, cell_id, block_id, abs(c_l - k_l) + abs(c_t - k_t) + abs(c_r - k_r) + abs(c_b - k_b) + least(abs(c_l - k_l) + abs(c_t - k_t), abs(c_r - k_r) + abs(c_b - k_b)) AS distance FROM pairs"),
    "scl_13_alignment": Query(_pair_query(lambda: {"columns": F.round(G.alignment(F.col("c_l"), F.col("c_r"), F.col("k_l"), F.col("k_r")), 9)}), f"{_PAIRS} SELECT page_id, cell_id, block_id, round({_align_sql('l', 'r')}, 9) AS columns FROM pairs"),
    "scl_14_closeness": Query(_pair_query(_scl14), f"{_PAIRS} SELECT page_id, cell_id, block_id, CASE WHEN {_align_sql('l', 'r')} > 0 THEN k_t - c_b ELSE k_l - c_r END AS gap, round({_align_sql('l', 'r')}, 9) AS col_align, round({_align_sql('t', 'b')}, 9) AS row_align FROM pairs"),
    "scl_15_spacing_match": Query(_scl15, _SCL15),
    "scl_16_anchor_point": Query(_blocks(_scl16, True), D.with_sql("skew_blocks") + f" SELECT {_PAGE}, " + ", ".join(f"{x} AS x_{loc}, {y} AS y_{loc}" for loc, (x, y) in {"topleft": ("x0", "y0"), "topright": ("x1", "y1"), "bottomleft": ("x3", "y3"), "bottomright": ("x2", "y2"), "center": ("(x0 + x1 + x2 + x3) // 4", "(y0 + y1 + y2 + y3) // 4"), "elsewhere": ("(x0 + x1 + x2 + x3) // 4", "(y0 + y1 + y2 + y3) // 4")}.items()) + f" FROM (SELECT *, {_CORNERS} FROM skew_blocks)"),
    "scl_17_partial_point": Query(_blocks(_scl17), PB + f" SELECT {_PAGE}, " + ", ".join(f"CAST({x} AS INTEGER) AS x_{loc}, CAST({y} AS INTEGER) AS y_{loc}" for loc, (x, y) in _PARTIAL.items()) + f" FROM (SELECT *, {_CORNERS}, {ratio_sql('text', '2')} AS s, {ratio_sql('text', '6')} AS e FROM page_blocks)"),
    "scl_18_parse_region": Query(_scl18, f"""{PB}, g AS (SELECT {_PAGE}, list_transform(string_split({_REGION_SQL}, ','), lambda s: try_cast(s AS INTEGER)) AS v FROM page_blocks),
h AS (SELECT *, coalesce(len(v) = 4 AND v[1] >= 0 AND v[2] >= 0 AND v[3] > 0 AND v[4] > 0, false) AS ok FROM g)
SELECT {_PAGE}, CASE WHEN ok THEN v[1] END AS x, CASE WHEN ok THEN v[2] END AS y, CASE WHEN ok THEN v[3] END AS w, CASE WHEN ok THEN v[4] END AS h, CASE WHEN ok THEN 0 ELSE 5 END AS code FROM h"""),
    "scl_19_line_props": Query(_scl19, f"{_LINES} SELECT page_id, line_id, round(sqrt((x2 - x1) ^ 2 + (y2 - y1) ^ 2), 6) AS length, round(degrees(atan2(y2 - y1, x2 - x1)), 6) AS angle, y1 = y2 AS horizontal, x1 = x2 AS vertical FROM ln"),
    "scl_20_snap_line": Query(_scl20, _LINES + _SNAP),
    "scl_21_scale_params": Query(_blocks(lambda: {n: (F.round(c, 9) if n[0] == "r" else c) for n, c in G.scale_params(F.get("box", F.lit(2)), F.get("box", F.lit(5)), 1024).items()}), f"""{PB}, s AS (SELECT {_PAGE}, box[3] AS w, box[6] AS h, 1024.0::DOUBLE / greatest(box[3], box[6]) AS k FROM page_blocks),
d AS (SELECT *, greatest(CAST(trunc(w * k / 32) AS INTEGER) * 32, 32) AS dst_w, greatest(CAST(trunc(h * k / 32) AS INTEGER) * 32, 32) AS dst_h FROM s)
SELECT {_PAGE}, dst_w, dst_h, round(dst_w / w, 9) AS ratio_w, round(dst_h / h, 9) AS ratio_h FROM d"""),
    "scl_22_unclip_distance": Query(_blocks(_scl22, True), D.with_sql("skew_blocks") + f""", c AS (SELECT {_PAGE}, {_CORNERS} FROM skew_blocks),
m AS (SELECT *, abs((x0*y1 - x1*y0) + (x1*y2 - x2*y1) + (x2*y3 - x3*y2) + (x3*y0 - x0*y3)) / 2.0 AS a, sqrt((x1-x0)^2 + (y1-y0)^2) + sqrt((x2-x1)^2 + (y2-y1)^2) + sqrt((x3-x2)^2 + (y3-y2)^2) + sqrt((x0-x3)^2 + (y0-y3)^2) AS p FROM c)
SELECT {_PAGE}, round(CASE WHEN p > 0 THEN a * 1.5::DOUBLE / p ELSE 0.0 END, 9) AS distance FROM m"""),
    "scl_23_restore_box": Query(_blocks(_scl23), _restore_sql()),
    "scl_24_order_corners": Query(_blocks(_scl24), PB + _ORDERED),
    "scl_25_char_length_choice": Query(_scl25, D.with_sql("components") + " SELECT page_id, round(CASE WHEN low * 1.5 <= mean THEN mean ELSE low END, 9) AS char_length FROM (SELECT page_id, CAST(min(r - l) AS DOUBLE) AS low, avg(r - l) AS mean FROM components GROUP BY page_id)"),
    "scl_26_default_params": Query(_scl26, f"{PB} SELECT {_PAGE}, coalesce(nullif(block_id % 3, 0), 50) AS padding, coalesce(nullif(block_id % 2 * 960, 0), 1024) AS max_side_len, coalesce(nullif(CASE WHEN block_id % 5 = 0 THEN 0.0 ELSE score END, 0), 0.6) AS box_score_thresh, 0.3::DOUBLE AS box_thresh, 2.0::DOUBLE AS unclip_ratio FROM page_blocks"),
    "scl_27_html_unescape": Query(_scl27, _SCL27),
    "scl_28_html_attr": Query(_scl28, D.with_sql("grid_cells") + " SELECT page_id, cell_id, c + 1 AS colspan, CAST(r + 1 AS VARCHAR) AS rowspan, '' AS none, x2 AS width_px, CAST(y2 AS DOUBLE) AS height_pct, 0.0::DOUBLE AS width_pct FROM grid_cells"),
    "scl_29_coords_report": Query(_scl29, _SCL29),
    "src_06_query_params": Query(_src06, _SRC06),
}
