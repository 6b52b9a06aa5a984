"""Queries over ruled lines, cells, structure tokens and ink components."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.operators import aggregates as A
from pagewright.operators import filters as FL
from pagewright.operators import joins as J
from pagewright.operators import pages as P
from pagewright.operators import sets as ST
from pagewright.operators import sweeps as S
from pagewright.operators import windows as W
from pagewright.plans import metrics as M
from pagewright.plans import tables as TB
from pagewright.queries import Query
from pagewright.queries.scalars import _LINES, _lines
from pagewright.sources import derived as D

CELLS, FAR, BOTH, COMPS, RULED, TOKENS = (D.with_sql(*n) for n in (("grid_cells",), ("far_cells",), ("grid_cells", "grid_blocks"), ("components",), ("ruled_lines",), ("tokens", "grid_blocks")))
BOX = ("x1", "y1", "x2", "y2")
TABLE = ("page_id", "table_id")


def _tables(df):
    return df.withColumn("table_id", F.lit(0))


def _slots(spark, sf_dir):
    """The grid of every order as slots; on merged pages the second and third of the first row hold one box."""
    rows = D.grid_cells(spark, sf_dir, sized=True)
    wide = D.merged(F.col("page_id"), F.col("n")) & (F.col("r") == 0) & F.col("c").isin(1, 2)
    return rows.select("page_id", F.lit(0).alias("table_id"), F.col("r").alias("row"), F.col("c").alias("col"), F.when(wide, 130).otherwise(F.col("x1")).alias("x1"), "y1", F.when(wide, 370).otherwise(F.col("x2")).alias("x2"), "y2")


_SLOTS = CELLS + """, g AS (SELECT *, max(r) OVER (PARTITION BY page_id) + 1 AS n FROM grid_cells),
h AS (SELECT *, page_id % 5 = 0 AND n >= 2 AND r = 0 AND c IN (1, 2) AS wide FROM g),
slots AS (SELECT page_id, 0 AS table_id, r AS "row", c AS "col", CASE WHEN wide THEN 130 ELSE x1 END AS x1, y1, CASE WHEN wide THEN 370 ELSE x2 END AS x2, y2, n FROM h)"""


def _hlines(spark, sf_dir):
    return D.ruled_lines(spark, sf_dir).filter("y1 = y2")


def _candidates(spark, sf_dir):
    return J.candidate_cells(_hlines(spark, sf_dir))


#: Lines meet by page and band of x, a pair once.
_CAND = RULED + """, h AS (SELECT *, unnest(range(x1 // 256, x2 // 256 + 1)) AS band FROM ruled_lines WHERE y1 = y2), met AS (
    SELECT DISTINCT a.page_id, a.line_id AS la, b.line_id AS lb, a.x1 AS ax1, a.x2 AS ax2, a.y1 AS ya, b.x1 AS bx1, b.x2 AS bx2, b.y1 AS yb
    FROM h a JOIN h b ON a.page_id = b.page_id AND a.band = b.band WHERE a.y1 < b.y1), cand AS (
    SELECT page_id, greatest(ax1, bx1) AS x1, least(ax2, bx2) AS x2, ya AS y1, yb AS y2 FROM met
    WHERE (abs(ax1 - bx1) / (ax2 - ax1) <= 0.02 OR bx1 BETWEEN ax1 AND ax2 OR ax1 BETWEEN bx1 AND bx2) AND (abs(ax2 - bx2) / (ax2 - ax1) <= 0.02 OR bx2 BETWEEN ax1 AND ax2 OR ax2 BETWEEN bx1 AND bx2))"""
_NEAR = _CAND + """, up AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY page_id, x1, x2, y1 ORDER BY y2) = 1),
near AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY page_id, x1, x2, y2 ORDER BY y1 DESC) = 1)"""
_DIV = _NEAR + """, div AS (SELECT c.page_id, c.x1, c.x2, c.y1, c.y2, v.x1 AS x FROM near c JOIN ruled_lines v ON c.page_id = v.page_id AND v.x1 = v.x2
    WHERE v.x1 BETWEEN c.x1 - greatest(5, CAST(trunc((c.x2 - c.x1) * 0.025) AS INTEGER)) AND c.x2 + greatest(5, CAST(trunc((c.x2 - c.x1) * 0.025) AS INTEGER))
        AND c.y2 - c.y1 - (least(c.y2, v.y2) - greatest(c.y1, v.y1)) <= greatest(5, least(10, CAST(trunc((c.y2 - c.y1) * 0.1) AS INTEGER))))"""


def _dividers(spark, sf_dir):
    return J.dividers(W.dedupe_adjacent(_candidates(spark, sf_dir)), D.ruled_lines(spark, sf_dir).filter("x1 = x2"))


def _jon01(spark, sf_dir):
    out = J.match_blocks_to_cells(D.grid_blocks(spark, sf_dir), D.grid_cells(spark, sf_dir).withColumns({"x1": F.col("x1") - 30, "x2": F.col("x2") - 30}))
    return out.select("page_id", "block_id", "text", "cell_id", F.round("iou", 9).alias("iou"))


_IOU = "greatest(least(k.r, c.x2) - greatest(k.l, c.x1), 0) * greatest(least(k.b, c.y2) - greatest(k.t, c.y1), 0)"


def _iou_sql(shift: int = 0) -> str:
    inter = _IOU.replace("c.x2", f"(c.x2 - {shift})").replace("c.x1", f"(c.x1 - {shift})")
    return f"({inter}) / ((k.r - k.l) * (k.b - k.t) + (c.x2 - c.x1) * (c.y2 - c.y1) - ({inter}) + 1e-8)"


_JON01 = BOTH + f""", p AS (SELECT k.page_id, k.block_id, k.text, c.cell_id, {_iou_sql(30)} AS iou,
    abs(k.l - c.x1 + 30) + abs(k.t - c.y1) + abs(k.r - c.x2 + 30) + abs(k.b - c.y2) + least(abs(k.l - c.x1 + 30) + abs(k.t - c.y1), abs(k.r - c.x2 + 30) + abs(k.b - c.y2)) AS d
    FROM grid_blocks k JOIN grid_cells c ON k.page_id = c.page_id AND k.r > c.x1 - 30 AND k.l < c.x2 - 30 AND k.b > c.y1 AND k.t < c.y2)
SELECT page_id, block_id, text, cell_id, round(iou, 9) AS iou FROM p WHERE iou > 1e-8 QUALIFY row_number() OVER (PARTITION BY page_id, block_id ORDER BY round(iou, 8) DESC, d, cell_id) = 1"""


def _jon02(spark, sf_dir):
    cells = D.grid_cells(spark, sf_dir).withColumns({"x1": F.col("x1") - 30, "x2": F.col("x2") - 30})
    return J.match_cells_to_block(cells, D.grid_blocks(spark, sf_dir)).select("page_id", "cell_id", "content")


_JON02 = BOTH + f""", p AS (SELECT c.page_id, c.cell_id, k.text, k.block_id, {_iou_sql(30)} AS iou FROM grid_cells c JOIN grid_blocks k ON k.page_id = c.page_id AND k.t // 30 = c.y1 // 30),
b AS (SELECT page_id, cell_id, text FROM p WHERE iou > 0.1 QUALIFY row_number() OVER (PARTITION BY page_id, cell_id ORDER BY iou DESC, block_id) = 1)
SELECT c.page_id, c.cell_id, coalesce(b.text, '') AS content FROM grid_cells c LEFT JOIN b USING (page_id, cell_id)"""

#: Cells of one table are 30 high, so neighbours are in one row or in the next.
_JON05 = """, near AS (SELECT *, y1 // 30 AS y, unnest([y1 // 30 - 1, y1 // 30, y1 // 30 + 1]) AS at FROM {t}),
own AS (SELECT *, y1 // 30 AS y FROM {t}),
pairs AS (SELECT a.page_id, a.cell_id AS a, b.cell_id AS b FROM near a JOIN own b ON a.page_id = b.page_id AND a.at = b.y WHERE a.cell_id < b.cell_id AND (
    (least(a.y2, b.y2) - greatest(a.y1, b.y1) > 5 AND least(abs(a.x1 - b.x1), abs(a.x1 - b.x2), abs(a.x2 - b.x1), abs(a.x2 - b.x2)) <= least(5.0, 0.05 * least(a.x2 - a.x1, b.x2 - b.x1)))
    OR (least(a.x2, b.x2) - greatest(a.x1, b.x1) > 5 AND least(abs(a.y1 - b.y1), abs(a.y1 - b.y2), abs(a.y2 - b.y1), abs(a.y2 - b.y2)) <= least(5.0, 0.05 * least(a.y2 - a.y1, b.y2 - b.y1)))))"""


def _jon06(spark, sf_dir):
    values = D.grid_cells(spark, sf_dir).select("page_id", (F.col("x1") + F.col("cell_id") * 7 % 61).cast("int").alias("v"))
    delims = D.grid_cells(spark, sf_dir).select("page_id", F.col("x1").alias("d")).distinct()
    return J.nearest_delimiter(values, delims, ("page_id",))


_JON06 = CELLS + ", v AS (SELECT DISTINCT page_id, CAST(x1 + cell_id * 7 % 61 AS INTEGER) AS v FROM grid_cells), d AS (SELECT DISTINCT page_id, x1 AS d FROM grid_cells) SELECT page_id, v, d FROM v JOIN d USING (page_id) QUALIFY row_number() OVER (PARTITION BY page_id, v ORDER BY abs(v - d), d) = 1"


def _jon07(spark, sf_dir):
    return J.slot_cells(_slots(spark, sf_dir).drop("row", "col")).select(*TABLE, "row", "col", *BOX)


def _kept(spark, sf_dir):
    return FL.component_size(FL.component_shape(D.components(spark, sf_dir)))


_KEPT = COMPS + """, s AS (SELECT *, r - l AS w, b - t AS h, greatest(r - l, b - t) / greatest(1, least(r - l, b - t)) <= 5.0 AND area / greatest(1, (r - l) * (b - t)) > 0.08 AS shaped FROM components),
m AS (SELECT *, median(CASE WHEN shaped THEN w END) OVER p AS mw, median(CASE WHEN shaped THEN h END) OVER p AS mh FROM s WINDOW p AS (PARTITION BY page_id)),
kept AS (SELECT *, coalesce(shaped AND ((w * h >= 0.2 * mw * mh AND w * h <= 5.0 * mw * mh) OR (w / greatest(1, h) >= 2.0 AND w >= 0.5 * mw AND w <= 1.5 * mw)), false) AS kept FROM m)"""
_DOTTED = COMPS + ", areas AS (SELECT DISTINCT page_id, 'h' AS orient, 20 AS l, 5 AS t, 89 AS r, 7 AS b FROM components WHERE comp_id >= 100000)"


def _jon08(spark, sf_dir):
    comps = D.components(spark, sf_dir)
    return J.area_hit_ratio(comps, A.dotted_line_areas(comps)).select("page_id", "comp_id")


_JON08 = _DOTTED + """ SELECT page_id, comp_id FROM components c WHERE coalesce((SELECT sum(greatest(least(c.r, a.r) - greatest(c.l, a.l), 0) * greatest(least(c.b, a.b) - greatest(c.t, a.t), 0)) FROM areas a WHERE a.page_id = c.page_id), 0) / ((c.r - c.l) * (c.b - c.t)) < 0.25"""


def _beside_blockers(spark, sf_dir):
    """On every fourth page everything is blocked, on the next a point. On the others there are blockers right of each component that lie over one
    another: three equal ones a point wide, or one over the height and one over half of it that share half their width."""
    kind = F.col("page_id") % 4
    side = F.when(kind == 0, 100_000).otherwise(1)
    whole = D.page_sizes(spark, sf_dir).filter("page_id % 4 < 2").select("page_id", F.lit(0).alias("l"), F.lit(0).alias("t"), side.alias("r"), side.alias("b"))

    def right(x1, x2, low=F.col("b")):
        return F.struct((F.col("r") + x1).alias("l"), F.col("t"), (F.col("r") + x2).alias("r"), low.alias("b"))

    slips = F.when(kind == 2, F.array(*[right(1, 2)] * 3)).otherwise(F.array(right(1, 3), right(2, 4, F.expr("cast((t + b) div 2 as int)"))))
    beside = D.grid_blocks(spark, sf_dir).filter("page_id % 4 >= 2").select("page_id", F.explode(slips).alias("s")).select("page_id", "s.*")
    return ST.union_all(whole, beside)


def _close(spark, sf_dir):
    return J.close_components(D.components(spark, sf_dir), _beside_blockers(spark, sf_dir), F.lit(30))


_COMMON = "greatest(least({r}, gr) - greatest({l}, gl), 0) * greatest(least({b}, gb) - greatest({t}, gt), 0)"
_WIDE, _HALF, _BOTH = (_COMMON.format(l=x, r=y, t="k.t", b=z) for x, y, z in (("k.r + 1", "k.r + CASE WHEN k.page_id % 4 = 2 THEN 2 ELSE 3 END", "k.b"), ("k.r + 2", "k.r + 4", "(k.t + k.b) // 2"), ("k.r + 2", "k.r + 3", "(k.t + k.b) // 2")))
#: Pairs meet by page and row of height 30, the one below included; of two blockers that overlap the common part counts once.
_CLOSE = COMPS + f""", c AS (SELECT *, t // 30 AS y FROM components), near AS (SELECT *, unnest([y - 1, y, y + 1]) AS at FROM c),
p AS (SELECT a.page_id, least(a.comp_id, b.comp_id) AS a, greatest(a.comp_id, b.comp_id) AS b, least(a.r, b.r) - greatest(a.l, b.l) AS xo, least(a.b, b.b) - greatest(a.t, b.t) AS yo, least(a.r - a.l, b.r - b.l) AS w, least(a.b - a.t, b.b - b.t) AS h,
    least(a.r, b.r) AS x1, greatest(a.l, b.l) AS x2, greatest(a.t, b.t) AS y1, least(a.b, b.b) AS y2
    FROM near a JOIN c b ON a.page_id = b.page_id AND a.at = b.y AND a.comp_id < b.comp_id),
k AS (SELECT *, CASE WHEN xo > 0 AND yo > 0 THEN 'over' WHEN 2 * yo >= h AND xo > -30 THEN 'beside' WHEN 2 * xo >= w AND yo > -30 THEN 'below' END AS kind FROM p),
g AS (SELECT page_id, a, b, kind, CASE WHEN kind = 'beside' THEN x1 ELSE x2 END AS gl, CASE WHEN kind = 'beside' THEN x2 ELSE x1 END AS gr, CASE WHEN kind = 'beside' THEN y1 ELSE y2 END AS gt, CASE WHEN kind = 'beside' THEN y2 ELSE y1 END AS gb FROM k WHERE kind IS NOT NULL),
blocked AS (SELECT g.page_id, g.a, g.b, sum({_WIDE} + CASE WHEN k.page_id % 4 = 3 THEN {_HALF} - {_BOTH} ELSE 0 END) AS n
    FROM g JOIN c k ON g.page_id = k.page_id AND k.comp_id < 100000 AND g.page_id % 4 >= 2 AND kind <> 'over' GROUP BY ALL)
SELECT page_id, a, b FROM g LEFT JOIN blocked USING (page_id, a, b)
WHERE kind = 'over' OR page_id % 4 <> 0 AND gl < gr AND gt < gb AND coalesce(n, 0) * 10 < (gr - gl) * (gb - gt)"""


def _jon10(spark, sf_dir):
    rows = _kept(spark, sf_dir)
    return J.attach_discarded(rows.filter("kept"), rows.filter("not kept"), F.lit(40)).select("page_id", "comp_id")


_JON10 = _KEPT + """ SELECT DISTINCT d.page_id, d.comp_id FROM kept d JOIN kept k ON d.page_id = k.page_id AND k.kept AND NOT d.kept
WHERE least(d.b, k.b) - greatest(d.t, k.t) >= 0.5 * least(d.h, k.h) AND least(d.b, k.b) > greatest(d.t, k.t) AND greatest(d.h, d.w) <= 3 * greatest(k.h, k.w)
    AND least(abs(d.l - k.l), abs(d.l - k.r), abs(d.r - k.l), abs(d.r - k.r)) <= 40"""


def _jon11(spark, sf_dir):
    return J.row_separation(D.components(spark, sf_dir), F.lit(8.0))


_SEP = """, sep AS (SELECT a.page_id, a.comp_id, min((b.t + b.b) / 2.0 - (a.t + a.b) / 2.0) AS sep FROM components a JOIN components b ON a.page_id = b.page_id
    WHERE least(a.r, b.r) - greatest(a.l, b.l) > 4 AND (b.t + b.b) / 2.0 > (a.t + a.b) / 2.0 GROUP BY ALL)"""


def _tall(spark, sf_dir):
    """Slots whose first column is one box on every page; its content stands in the second row only."""
    rows = _slots(spark, sf_dir)
    page = Window.partitionBy("page_id")
    first = F.col("col") == 0
    content = F.when(first & (F.col("row") != 1), "").otherwise(F.concat(F.lit("t"), F.col("row"), F.lit("."), F.col("col")))
    return rows.withColumns({"y1": F.when(first, 0).otherwise(F.col("y1")), "y2": F.when(first, F.max("y2").over(page)).otherwise(F.col("y2")), "content": content})


_JON14 = _SLOTS + """ SELECT page_id, table_id, "row", "col", CASE WHEN "col" = 0 AND "row" = 0 AND n > 1 THEN 't1.0' WHEN "col" = 0 AND "row" <> 1 THEN '' ELSE 't' || "row" || '.' || "col" END AS content FROM slots"""


def _overlapping(spark, sf_dir):
    return _tables(D.grid_cells(spark, sf_dir)).withColumn("x2", F.col("x2") + (F.col("cell_id") % 3 * 5).cast("int"))


_AGG09 = CELLS + """, c AS (SELECT DISTINCT page_id, x1, y1, CAST(x2 + cell_id % 3 * 5 AS INTEGER) AS x2, y2 FROM grid_cells)
SELECT a.page_id, 0 AS table_id, CAST(sum(CASE WHEN (a.x1, a.y1, a.x2, a.y2) < (b.x1, b.y1, b.x2, b.y2) THEN greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) ELSE 0 END) AS BIGINT) AS overlap
FROM c a JOIN c b ON a.page_id = b.page_id GROUP BY a.page_id"""


def _clusters(spark, sf_dir):
    return S.adjacent_clusters(D.grid_cells(spark, sf_dir, far=True).select("page_id", "cell_id", *BOX))


_TABLE_ID = "CASE WHEN page_id % 7 = 0 AND r >= 4 THEN 16 ELSE 0 END"


def _agg14(spark, sf_dir):
    cells = D.grid_cells(spark, sf_dir, far=True).select("page_id", "cell_id", *BOX)
    return J.axis_delimiters(cells, {"x": 8.0, "y": 4.0}).select(*TABLE, "axis", "d")


_AGG14 = FAR + f", c AS (SELECT *, {_TABLE_ID} AS table_id FROM far_cells) SELECT DISTINCT page_id, table_id, 'x' AS axis, unnest([x1, x2]) AS d FROM c UNION ALL SELECT DISTINCT page_id, table_id, 'y', unnest([y1, y2]) FROM c"


def _agg19(spark, sf_dir):
    rows, cols = A.size_shares(_slots(spark, sf_dir))
    both = rows.select(*TABLE, F.lit("row").alias("kind"), F.col("row").alias("at"), F.round("pct", 6).alias("pct"))
    return both.unionByName(cols.select(*TABLE, F.lit("col").alias("kind"), "at", F.round("pct", 6).alias("pct")))


_AGG19 = _SLOTS + """ SELECT DISTINCT page_id, 0 AS table_id, 'row' AS kind, "row" AS "at", round(100.0 / n, 6) AS pct FROM slots
UNION ALL SELECT page_id, 0, 'col', CAST(k AS INTEGER), 25.0 FROM (SELECT DISTINCT page_id FROM slots), range(4) t(k)"""


def _raw(spark, sf_dir):
    return TB.parse_html_table(D.html_tables(spark, sf_dir))


def _agg20(spark, sf_dir):
    """Of each order the first row's first cell is two rows tall, and odd rows have a cell less."""
    cells = D.grid_cells(spark, sf_dir).filter("not (r % 2 = 1 and c = 3)")
    raw = cells.select("page_id", F.col("r").alias("row"), F.col("c").alias("idx"), F.lit(1).alias("colspan"), F.when((F.col("r") == 0) & (F.col("c") == 0), 2).otherwise(1).alias("rowspan"))
    return A.max_effective_columns(raw)


_AGG20 = CELLS + """, k AS (SELECT DISTINCT page_id, r FROM grid_cells), m AS (SELECT page_id, r, 4 - r % 2 AS own, CASE WHEN r = 1 THEN 1 ELSE 0 END AS "before" FROM k)
SELECT page_id, r AS "row", CAST(own AS BIGINT) AS own, CAST("before" AS BIGINT) AS "before", CAST(max(own + "before") OVER (PARTITION BY page_id) AS BIGINT) AS columns FROM m"""


def _win04(spark, sf_dir):
    return W.cluster_values(D.grid_blocks(spark, sf_dir), "l", 0.1, 8.0, ("page_id",)).select("page_id", "l", F.col("cluster").cast("int").alias("cluster"))


_WIN04 = BOTH + """, v AS (SELECT DISTINCT page_id, l FROM grid_blocks), g AS (SELECT page_id, l, l - lag(l) OVER (PARTITION BY page_id ORDER BY l) AS gap FROM v),
t AS (SELECT *, CASE WHEN count(gap) OVER p > 2 THEN median(gap) OVER p ELSE min(gap) OVER p END AS typical FROM g WINDOW p AS (PARTITION BY page_id))
SELECT page_id, l, CAST(sum(CASE WHEN gap > greatest(typical * 0.1, 8.0) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY l) AS INTEGER) AS cluster FROM t"""


def _flt10(spark, sf_dir):
    return FL.valid_tables(_slots(spark, sf_dir)).select(*TABLE, "row", "col", *BOX)


def _flt12(spark, sf_dir):
    rows = D.grid_cells(spark, sf_dir).withColumn("table_id", F.col("c"))  # each column of cells is a cluster
    return FL.cluster_size(rows).select("page_id", "cell_id")


def _pag08(spark, sf_dir):
    """The cells of each order, each twice, and one that covers all of them."""
    cells = D.grid_cells(spark, sf_dir).select("page_id", *BOX)
    whole = cells.groupBy("page_id").agg(*[(F.min if c[1] == "1" else F.max)(c).alias(c) for c in BOX])
    return P.dedupe_cells(ST.union_all(cells, cells, whole.select("page_id", *BOX)))


def _pag11(spark, sf_dir):
    return P.spans(_slots(spark, sf_dir))


_PAG11 = _SLOTS + """ SELECT page_id, table_id, "row", "col", 1 AS rowspan, CASE WHEN x2 - x1 > 120 THEN 2 ELSE 1 END AS colspan FROM slots WHERE NOT (x2 - x1 > 120 AND "col" = 2)"""


def _pag12(spark, sf_dir):
    slots = J.match_cells_to_block(_slots(spark, sf_dir), D.grid_blocks(spark, sf_dir))
    return TB.table_html(slots)


_BORDERED = BOTH + """, t AS (SELECT page_id, block_id // 4 AS r, block_id % 4 AS c, text, max(block_id // 4) OVER (PARTITION BY page_id) + 1 AS n FROM grid_blocks),
tr AS (SELECT page_id, n, r, '  <tr style=''height:' || printf('%.2f', 30 / (30 * n)::DOUBLE * 100.0) || '%''>' || chr(10) || string_agg('    <td' || CASE WHEN page_id % 5 = 0 AND n >= 2 AND r = 0 AND c = 1 THEN ' colspan="2"' ELSE '' END || '>' || text || '</td>' || chr(10), '' ORDER BY c) || '  </tr>' || chr(10) AS line
    FROM t WHERE NOT (page_id % 5 = 0 AND n >= 2 AND r = 0 AND c = 2) GROUP BY page_id, n, r)
SELECT page_id, 0 AS table_id, '<table style=''table-layout:fixed;width:100%''>' || chr(10) || '  <colgroup>' || chr(10) || repeat('    <col style=''width:25.00%''>' || chr(10), 4) || '  </colgroup>' || chr(10) || string_agg(line, '' ORDER BY r) || '</table>' || chr(10) AS html
FROM tr {where} GROUP BY page_id"""


def _tab01(spark, sf_dir):
    return TB.bordered_tables(D.ruled_lines(spark, sf_dir), D.grid_blocks(spark, sf_dir))


def _tab02(spark, sf_dir):
    out = TB.structured_tables(D.tokens(spark, sf_dir), D.grid_blocks(spark, sf_dir))
    return out.select("page_id", "html", F.round("structure_score", 9).alias("structure_score"))


_TAB02 = TOKENS + """, t AS (SELECT page_id, block_id // 4 AS r, block_id % 4 AS c, text, max(block_id // 4) OVER (PARTITION BY page_id) + 1 AS n FROM grid_blocks),
m AS (SELECT *, page_id % 5 = 0 AND n >= 2 AND r = 0 AS wide FROM t),
u AS (SELECT page_id, n, r, CASE WHEN wide AND c = 2 THEN 1 ELSE c END AS c, wide, string_agg(text, ' ' ORDER BY c) AS text FROM m GROUP BY page_id, n, r, CASE WHEN wide AND c = 2 THEN 1 ELSE c END, wide),
tr AS (SELECT page_id, n, r, '<tr style=''height:' || printf('%.2f', 30 / (30 * n)::DOUBLE * 100.0) || '%''>' || string_agg('<td' || CASE WHEN wide AND c = 1 THEN ' colspan=''2''' ELSE '' END || '>' || text || '</td>', '' ORDER BY c) || '</tr>' AS line FROM u GROUP BY page_id, n, r),
s AS (SELECT page_id, round(avg(score), 9) AS structure_score FROM tokens GROUP BY page_id)
SELECT page_id, '<table style=''table-layout:fixed;width:100%''>' || chr(10) || '  <colgroup>' || chr(10) || repeat('    <col style=''width:25.00%''>' || chr(10), 4) || '  </colgroup>' || chr(10) || string_agg(line, '' ORDER BY r) || '</table>' AS html, any_value(structure_score) AS structure_score
FROM tr JOIN s USING (page_id) GROUP BY page_id"""


def _pag09(spark, sf_dir):
    return TB.decode_structure(D.tokens(spark, sf_dir)).select("page_id", "html", F.round("structure_score", 9).alias("structure_score"))


_PAG09 = TOKENS + """ SELECT page_id, '<table>' || string_agg(CASE WHEN token IN ('<td></td>', '<td') THEN '<td></td>' WHEN token IN ('<tr>', '</tr>') THEN token ELSE '' END, '' ORDER BY t) || '</table>' AS html, round(avg(score), 9) AS structure_score FROM tokens GROUP BY page_id"""
_PAG10 = TOKENS + """ SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY t) - 1 AS INTEGER) AS cell_id, x1, y1, x2, y2, CASE WHEN token = '<td' THEN 2 ELSE 1 END AS colspan, 1 AS rowspan FROM tokens WHERE x1 IS NOT NULL"""


def _filled(spark, sf_dir):
    return TB.filled_structures(D.tokens(spark, sf_dir), D.grid_blocks(spark, sf_dir))


_PAG13 = TOKENS + """, t AS (SELECT page_id, block_id // 4 AS r, block_id % 4 AS c, text, max(block_id // 4) OVER (PARTITION BY page_id) + 1 AS n FROM grid_blocks),
m AS (SELECT *, page_id % 5 = 0 AND n >= 2 AND r = 0 AS wide FROM t),
u AS (SELECT page_id, r, CASE WHEN wide AND c = 2 THEN 1 ELSE c END AS c, wide, string_agg(text, ' ' ORDER BY c) AS text FROM m GROUP BY page_id, r, CASE WHEN wide AND c = 2 THEN 1 ELSE c END, wide),
tr AS (SELECT page_id, r, '<tr>' || string_agg('<td' || CASE WHEN wide AND c = 1 THEN ' colspan=''2''' ELSE '' END || '>' || text || '</td>', '' ORDER BY c) || '</tr>' AS line FROM u GROUP BY page_id, r)
SELECT page_id, '<table>' || string_agg(line, '' ORDER BY r) || '</table>' AS html FROM tr GROUP BY page_id"""


def _short(spark, sf_dir):
    """HTML whose odd rows have a cell less."""
    cells = D.grid_cells(spark, sf_dir).filter("not (r % 2 = 1 and c = 3)")
    rows = cells.groupBy("page_id", "r").agg(F.concat(F.lit("<tr>"), A.ordered_concat("c", F.format_string("<td>%d</td>", "cell_id")), F.lit("</tr>")).alias("line"))
    return rows.groupBy("page_id").agg(F.concat(F.lit("<table>"), A.ordered_concat("r", F.col("line")), F.lit("</table>")).alias("html"))


_PADDED = CELLS + """, tr AS (SELECT page_id, r, {open} || string_agg(CASE WHEN r % 2 = 1 AND c = 3 THEN '<td>&nbsp;</td>' ELSE '<td>' || cell_id || '</td>' END, '' ORDER BY c) || '</tr>' AS line, max(r) OVER (PARTITION BY page_id) + 1 AS n FROM grid_cells GROUP BY page_id, r)
SELECT page_id, {head} || string_agg(line, '' ORDER BY r) || '</table>' AS html FROM tr GROUP BY page_id"""
_SIZED = CELLS + """, k AS (SELECT *, max(r) OVER (PARTITION BY page_id) + 1 AS n FROM grid_cells),
tr AS (SELECT page_id, r, '<tr style=''height:' || printf('%.2f', 30 / (30 * n)::DOUBLE * 100.0) || '%''>' || string_agg(CASE WHEN r % 2 = 1 AND c = 3 THEN '<td>&nbsp;</td>' ELSE '<td>' || cell_id || '</td>' END, '' ORDER BY c) || '</tr>' AS line FROM k GROUP BY page_id, r, n)
SELECT page_id, '<table style=''table-layout:fixed;width:100%''>' || chr(10) || '  <colgroup>' || chr(10) || repeat('    <col style=''width:25.00%''>' || chr(10), 4) || '  </colgroup>' || chr(10) || string_agg(line, '' ORDER BY r) || '</table>' AS html FROM tr GROUP BY page_id"""


def _pag15(spark, sf_dir):
    """The first row of every order is full, so there are always four columns."""
    return TB.size_rows(TB.pad_rows(_short(spark, sf_dir)), D.grid_cells(spark, sf_dir))


def _between_rows(spark, sf_dir):
    """On every third page two bars that overlap lie across below each row; on the next ones two equal slips, of 6 % of a block's width, below each block."""
    blocks = D.grid_blocks(spark, sf_dir)

    def below(x1, x2):
        return F.struct(x1.alias("l"), F.col("b").alias("t"), x2.alias("r"), (F.col("b") + 8).alias("b"))

    bars = F.when((F.col("page_id") % 3 == 0) & (F.col("block_id") % 4 == 0), F.array(below(F.lit(0), F.lit(400)), below(F.lit(200), F.lit(600))))
    slips = F.when(F.col("page_id") % 3 == 1, F.array(*[below(F.col("r") - 50, F.col("r") - 44)] * 2))
    return blocks.select("page_id", F.explode(F.coalesce(bars, slips)).alias("s")).select("page_id", "s.*")


def _tab04(spark, sf_dir):
    out = M.page_metrics(D.components(spark, sf_dir), _between_rows(spark, sf_dir))
    return out.select("page_id", F.round("char_length", 6).alias("char_length"), F.col("line_sep").cast("long").alias("line_sep"), "boxes")


#: Dots go as parts of a dotted line; all else is close to its neighbours, but for rows that bars part, which are 30 units apart.
_TAB04 = COMPS + """, own AS (SELECT * FROM components WHERE comp_id < 100000),
k AS (SELECT page_id, w FROM (SELECT page_id, r - l AS w, count(*) AS n FROM own GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, w) = 1),
m AS (SELECT page_id, avg(r - l) AS mean, count(DISTINCT t) AS n FROM own GROUP BY page_id)
SELECT page_id, round(CASE WHEN w * 1.5 <= mean THEN mean ELSE w END, 6) AS char_length, CAST(CASE WHEN page_id % 3 = 0 AND n > 1 THEN 31 ELSE 0 END AS BIGINT) AS line_sep, CAST(CASE WHEN page_id % 3 = 0 THEN n ELSE 1 END AS BIGINT) AS boxes
FROM k JOIN m USING (page_id)"""


def _boxes(spark, sf_dir):
    labelled = D.components(spark, sf_dir).withColumn("label", F.expr("comp_id div 4"))
    return A.component_boxes(labelled)


def _agg05(spark, sf_dir):
    return A.mode_row_separation(_jon11(spark, sf_dir)).select("page_id", F.col("line_sep").cast("long").alias("line_sep"))


_ROWS4 = ("page_id", "cell_id")
QUERIES = {
    "flt_03_below_table_top": Query(lambda s, d: FL.below_table_top(D.grid_blocks(s, d), D.grid_cells(s, d).filter("r >= 1")).select("page_id", "block_id"), BOTH + " SELECT page_id, block_id FROM grid_blocks k JOIN (SELECT page_id, min(y1) AS top FROM grid_cells WHERE r >= 1 GROUP BY page_id) USING (page_id) WHERE k.b >= top"),
    "flt_07_component_shape": Query(lambda s, d: FL.component_shape(D.components(s, d)).select("page_id", "comp_id", "shaped"), _KEPT + " SELECT page_id, comp_id, shaped FROM kept"),
    "flt_08_component_size": Query(lambda s, d: _kept(s, d).select("page_id", "comp_id", "kept"), _KEPT + " SELECT page_id, comp_id, kept FROM kept"),
    "flt_09_straight_lines": Query(lambda s, d: FL.straight_lines(_lines(s, d)).select("page_id", "line_id", "orient"), _LINES + " SELECT page_id, line_id, CASE WHEN y1 = y2 THEN 'h' ELSE 'v' END AS orient FROM ln WHERE (y1 = y2 AND x1 <> x2) OR (x1 = x2 AND y1 <> y2)"),
    "flt_10_valid_tables": Query(_flt10, _SLOTS + ' SELECT page_id, table_id, "row", "col", x1, y1, x2, y2 FROM slots WHERE n >= 2'),
    "flt_11_with_area": Query(lambda s, d: FL.with_area(D.grid_cells(s, d).withColumn("x2", F.when(F.col("cell_id") % 3 == 0, F.col("x1")).otherwise(F.col("x2")))).select(*_ROWS4), CELLS + " SELECT page_id, cell_id FROM grid_cells WHERE cell_id % 3 <> 0"),
    "flt_12_cluster_size": Query(_flt12, CELLS + " SELECT page_id, cell_id FROM (SELECT *, count(*) OVER (PARTITION BY page_id, c) AS n FROM grid_cells) WHERE n >= 2"),
    "jon_01_blocks_to_cells": Query(_jon01, _JON01),
    "jon_02_cells_to_block": Query(_jon02, _JON02),
    "jon_03_candidate_cells": Query(_candidates, _CAND + " SELECT page_id, x1, x2, y1, y2 FROM cand"),
    "jon_04_dividers": Query(_dividers, _DIV + " SELECT page_id, x1, x2, y1, y2, x FROM div"),
    "jon_05_adjacent_cells": Query(lambda s, d: J.adjacent_cells(D.grid_cells(s, d, far=True)), FAR + _JON05.format(t="far_cells") + " SELECT page_id, a, b FROM pairs"),
    "jon_06_nearest_delimiter": Query(_jon06, _JON06),
    "jon_07_slot_cells": Query(_jon07, _SLOTS + ' SELECT page_id, table_id, "row", "col", x1, y1, x2, y2 FROM slots'),
    "jon_08_area_hit_ratio": Query(_jon08, _JON08),
    "jon_09_close_components": Query(_close, _CLOSE),
    "jon_10_attach_discarded": Query(_jon10, _JON10),
    "jon_11_row_separation": Query(_jon11, COMPS + _SEP + " SELECT page_id, comp_id, sep FROM sep"),
    "jon_14_backfill_merged": Query(lambda s, d: J.backfill_merged(_tall(s, d)).select(*TABLE, "row", "col", "content"), _JON14),
    "agg_04_mode_width": Query(lambda s, d: A.mode_width(D.components(s, d)), COMPS + " SELECT page_id, w AS mode_width FROM (SELECT page_id, r - l AS w, count(*) AS n FROM components GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, w) = 1"),
    "agg_05_mode_row_separation": Query(_agg05, COMPS + _SEP + " SELECT page_id, v AS line_sep FROM (SELECT page_id, CAST(2 * floor(sep / 2) + 1 AS BIGINT) AS v, count(*) AS n FROM sep GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, v) = 1"),
    "agg_06_char_length": Query(lambda s, d: A.page_char_length(D.components(s, d)).select("page_id", F.round("char_length", 9).alias("char_length")), COMPS + ", k AS (SELECT page_id, w FROM (SELECT page_id, r - l AS w, count(*) AS n FROM components GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, w) = 1) SELECT page_id, round(CASE WHEN w * 1.5 <= mean THEN mean ELSE w END, 9) AS char_length FROM k JOIN (SELECT page_id, avg(r - l) AS mean FROM components GROUP BY page_id) USING (page_id)"),
    "agg_08_table_bbox": Query(lambda s, d: A.table_bbox(D.grid_cells(s, d), ("page_id",)), CELLS + " SELECT page_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(DISTINCT (x1, y1, x2, y2)) AS unique_cells FROM grid_cells GROUP BY page_id"),
    "agg_09_pair_overlap": Query(lambda s, d: FL.pair_overlap(_overlapping(s, d)), _AGG09),
    "agg_11_dotted_lines": Query(lambda s, d: A.dotted_line_areas(D.components(s, d)), _DOTTED + " SELECT page_id, orient, l, t, r, b FROM areas"),
    "agg_12_table_clusters": Query(lambda s, d: _clusters(s, d).select("page_id", "cell_id", "table_id"), FAR + f" SELECT page_id, cell_id, {_TABLE_ID} AS table_id FROM far_cells"),
    "agg_13_component_boxes": Query(_boxes, COMPS + " SELECT page_id, comp_id // 4 AS label, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b FROM components GROUP BY page_id, comp_id // 4"),
    "agg_14_axis_delimiters": Query(_agg14, _AGG14),
    "agg_15_cell_texts": Query(lambda s, d: A.cell_texts(D.grid_blocks(s, d).withColumn("cell_id", F.expr("block_id div 4"))), BOTH + " SELECT page_id, block_id // 4 AS cell_id, string_agg(text, ' ' ORDER BY block_id) AS text FROM grid_blocks GROUP BY page_id, block_id // 4"),
    "agg_16_structure_score": Query(lambda s, d: A.structure_score(D.tokens(s, d).filter("t < page_id % 3 * 4"), D.grid_cells(s, d)).select("page_id", F.round("structure_score", 9).alias("structure_score")), TOKENS + " SELECT page_id, round(coalesce(avg(score) FILTER (t < page_id % 3 * 4), 0.0), 9) AS structure_score FROM tokens GROUP BY page_id"),
    "agg_19_size_shares": Query(_agg19, _AGG19),
    "agg_20_effective_columns": Query(_agg20, _AGG20),
    "win_04_cluster_values": Query(_win04, _WIN04),
    "win_07_dedupe_adjacent": Query(lambda s, d: W.dedupe_adjacent(_candidates(s, d)).select("page_id", "x1", "x2", "y1", "y2"), _NEAR + " SELECT page_id, x1, x2, y1, y2 FROM near"),
    "win_08_cells_from_dividers": Query(lambda s, d: W.cells_from_dividers(_dividers(s, d)), _DIV + " SELECT page_id, x AS x1, y1, nx AS x2, y2 FROM (SELECT *, lead(x) OVER (PARTITION BY page_id, x1, x2, y1, y2 ORDER BY x) AS nx FROM div) WHERE nx IS NOT NULL"),
    "set_01_union_lines": Query(lambda s, d: ST.union_all(_hlines(s, d), D.ruled_lines(s, d).filter("x1 = x2")).select("page_id", "line_id", *BOX), RULED + " SELECT page_id, line_id, x1, y1, x2, y2 FROM ruled_lines WHERE y1 = y2 UNION ALL SELECT page_id, line_id, x1, y1, x2, y2 FROM ruled_lines WHERE x1 = x2"),
    "set_03_distinct_edges": Query(lambda s, d: ST.distinct_edges(D.grid_cells(s, d)), CELLS + " SELECT DISTINCT page_id, 'x' AS axis, unnest([x1, x2]) AS v FROM grid_cells UNION ALL SELECT DISTINCT page_id, 'y', unnest([y1, y2]) FROM grid_cells"),
    "pag_08_dedupe_cells": Query(_pag08, CELLS + " SELECT page_id, cell_id, x1, y1, x2, y2 FROM grid_cells"),
    "pag_09_decode_structure": Query(_pag09, _PAG09),
    "pag_10_structure_cells": Query(lambda s, d: TB.structure_cells(D.tokens(s, d)), _PAG10),
    "pag_11_spans": Query(_pag11, _PAG11),
    "pag_12_table_html": Query(_pag12, _BORDERED.format(where="")),
    "pag_13_fill_placeholders": Query(_filled, _PAG13),
    "pag_14_pad_rows": Query(lambda s, d: TB.pad_rows(_short(s, d)), _PADDED.format(open="'<tr>'", head="'<table>'")),
    "pag_15_size_rows": Query(_pag15, _SIZED),
    "tab_01_bordered_tables": Query(_tab01, _BORDERED.format(where="WHERE n >= 2")),
    "tab_02_structured_tables": Query(_tab02, _TAB02),
    "tab_04_page_metrics": Query(_tab04, _TAB04),
}
