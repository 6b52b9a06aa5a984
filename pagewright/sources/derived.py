"""Input tables of the layout and table operators, derived from the given tables by integer arithmetic.

Each has a Spark form and a DuckDB form of the same rows, so that results can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_blocks(spark: SparkSession, sf_dir: str, skew: bool = False) -> DataFrame:
    """One page per document, one block per line of text; odd documents have two columns. With `skew`, every tenth page is tilted."""
    rows = given(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "txt"))
    odd = F.col("doc_id") % 2 == 1
    rows = rows.select(
        "doc_id",
        F.lit(0).alias("page"),
        F.col("i").alias("block_id"),
        F.when(odd, F.col("i") % 2).otherwise(0).alias("col"),
        F.when(odd, F.expr("i div 2").cast("int")).otherwise(F.col("i")).alias("r"),
        F.when((F.col("doc_id") * 7 + F.col("i")) % 11 == 0, "").otherwise(F.col("txt")).alias("text"),
        F.least(F.lit(560), 8 * F.length("txt")).alias("w"),
    )
    rows = rows.withColumn("x0", 40 + F.col("col") * 620 + F.when(F.col("block_id") % 3 == 0, 12).otherwise(0)).withColumn("y0", 50 + F.col("r") * 28)
    xs = [F.col("x0"), F.col("x0") + F.col("w"), F.col("x0") + F.col("w"), F.col("x0")]
    ys = [F.col("y0"), F.col("y0"), F.col("y0") + 20, F.col("y0") + 20]
    if skew:
        ys = [F.when(F.col("doc_id") % 10 == 7, y + (x / 10).cast("int")).otherwise(y) for x, y in zip(xs, ys, strict=True)]
    return rows.select(
        "doc_id",
        "page",
        "block_id",
        "text",
        (((F.col("doc_id") * 31 + F.col("block_id") * 17) % 1000) / 1000.0).alias("score"),
        F.array(*[v for xy in zip(xs, ys, strict=True) for v in xy]).alias("box"),
        F.lit(0).alias("angle"),
        F.lit(0.0).alias("angle_score"),
        F.lit("\n").alias("end"),
    )


def _page_blocks_sql(skew: bool) -> str:
    tilt = " + CASE WHEN doc_id % 10 = 7 THEN ({x}) // 10 ELSE 0 END" if skew else ""
    points = []
    for x, y in (("x0", "y0"), ("x0 + w", "y0"), ("x0 + w", "y0 + 20"), ("x0", "y0 + 20")):
        points += [x, y + tilt.format(x=x)]
    return f"""
SELECT doc_id, 0 AS page, i AS block_id, text, ((doc_id * 31 + i * 17) % 1000) / 1000.0::DOUBLE AS score, [{", ".join(points)}] AS box, 0 AS angle, 0.0::DOUBLE AS angle_score, chr(10) AS "end"
FROM (
    SELECT doc_id, i, CASE WHEN (doc_id * 7 + i) % 11 = 0 THEN '' ELSE txt END AS text, least(560, 8 * length(txt)) AS w,
        40 + (CASE WHEN doc_id % 2 = 1 THEN i % 2 ELSE 0 END) * 620 + CASE WHEN i % 3 = 0 THEN 12 ELSE 0 END AS x0,
        50 + (CASE WHEN doc_id % 2 = 1 THEN i // 2 ELSE i END) * 28 AS y0
    FROM (SELECT doc_id, unnest(l) AS txt, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


#: So many rows of orders go to a partition at most, as each becomes several cells or tokens that are sorted there.
ROWS_A_PARTITION = 100_000


def order_partitions(spark: SparkSession, sf_dir: str) -> int:
    """How many partitions the orders are dealt to."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-given(spark, sf_dir, "lineitem").count() // ROWS_A_PARTITION))


def by_order(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """lineitem's columns with an order's rows in one partition. The partitions grow in number with the rows, and are as many as the session names at least:
    what a task sorts stays of one size."""
    return given(spark, sf_dir, "lineitem").select("l_orderkey", *columns).repartition(order_partitions(spark, sf_dir), "l_orderkey")


def _order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with page_id (the order), r (the row's place in it, from 0) and n (the order's rows)."""
    own = Window.partitionBy("l_orderkey")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    rows = by_order(spark, sf_dir, "l_returnflag", *order)
    rows = rows.withColumn("r", F.row_number().over(own.orderBy(*order)) - 1).withColumn("n", F.count("*").over(own).cast("int"))
    return rows.withColumnRenamed("l_orderkey", "page_id")


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders, page_id, and n, how many rows each has: all that tables need which read no value of a row. Nothing is sorted, and keys alone are shuffled."""
    keys = by_order(spark, sf_dir).withColumnRenamed("l_orderkey", "page_id")
    return keys.groupBy("page_id").agg(F.count("*").cast("int").alias("n"))


def _numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, n, r: what `_order_rows` has but for the values of a row."""
    return page_sizes(spark, sf_dir).select("page_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("r"))


_ORDER_ROWS_SQL = """
SELECT l_orderkey AS page_id, l_linenumber, l_partkey, l_quantity, l_returnflag, CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS n,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS r
FROM lineitem"""


def grid_cells(spark: SparkSession, sf_dir: str, far: bool = False, sized: bool = False) -> DataFrame:
    """One table of four columns per order: page_id, cell_id, r, c, x1, y1, x2, y2, and n if `sized`. With `far`, every seventh page's rows from 4 on lie apart."""
    rows = _numbered_rows(spark, sf_dir).select("page_id", "n", "r", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("c"))
    down = F.when((F.col("page_id") % 7 == 0) & (F.col("r") >= 4), 5000).otherwise(0) if far else F.lit(0)
    return rows.select(
        "page_id",
        (4 * F.col("r") + F.col("c")).alias("cell_id"),
        "r",
        "c",
        (10 + 120 * F.col("c")).alias("x1"),
        (30 * F.col("r") + down).alias("y1"),
        (130 + 120 * F.col("c")).alias("x2"),
        (30 * F.col("r") + 30 + down).alias("y2"),
        *["n"] * sized,
    )


def _grid_cells_sql(far: bool) -> str:
    down = " + CASE WHEN page_id % 7 = 0 AND r >= 4 THEN 5000 ELSE 0 END" if far else ""
    return f"""
SELECT page_id, CAST(4 * r + c AS INTEGER) AS cell_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CAST(10 + 120 * c AS INTEGER) AS x1, CAST(30 * r{down} AS INTEGER) AS y1,
    CAST(130 + 120 * c AS INTEGER) AS x2, CAST(30 * r + 30{down} AS INTEGER) AS y2
FROM order_rows, range(4) t(c)"""


def grid_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text block inside each cell: page_id, block_id, text, l, t, r, b."""
    rows = _order_rows(spark, sf_dir)
    texts = F.array(*[c.cast("string") for c in (F.col("l_partkey"), F.col("l_quantity").cast("int"), F.col("l_returnflag"), F.col("l_linenumber"))])
    rows = rows.select("page_id", F.col("r").alias("row"), F.posexplode(texts).alias("c", "text"), (F.col("l_partkey") % 7).cast("int").alias("inset"))
    return rows.select(
        "page_id",
        (4 * F.col("row") + F.col("c")).alias("block_id"),
        "text",
        (20 + 120 * F.col("c") + F.col("inset")).alias("l"),
        (30 * F.col("row") + 4).alias("t"),
        (120 + 120 * F.col("c")).alias("r"),
        (30 * F.col("row") + 26).alias("b"),
    )


_GRID_BLOCKS_SQL = """
SELECT page_id, CAST(4 * r + c AS INTEGER) AS block_id, text, CAST(20 + 120 * c + l_partkey % 7 AS INTEGER) AS l, CAST(30 * r + 4 AS INTEGER) AS t, CAST(120 + 120 * c AS INTEGER) AS r, CAST(30 * r + 26 AS INTEGER) AS b
FROM (SELECT page_id, r, l_partkey, unnest([CAST(l_partkey AS VARCHAR), CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR), CAST(l_returnflag AS VARCHAR), CAST(l_linenumber AS VARCHAR)]) AS text, unnest(range(4)) AS c FROM order_rows)"""


def merged(page_id, n):
    """Pages on which the second and third cell of the first row are one."""
    return (page_id % 5 == 0) & (n >= 2)


def ruled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of each order's table: page_id, line_id, x1, y1, x2, y2. On merged pages the middle rule starts below the first row."""
    pages = page_sizes(spark, sf_dir)
    flat = pages.select("page_id", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k"))
    flat = flat.select("page_id", F.col("k").alias("line_id"), F.lit(10).alias("x1"), (30 * F.col("k")).alias("y1"), F.lit(490).alias("x2"), (30 * F.col("k")).alias("y2"))
    up = pages.select("page_id", "n", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    top = F.when(merged(F.col("page_id"), F.col("n")) & (F.col("k") == 2), 30).otherwise(0)
    up = up.select("page_id", (1000 + F.col("k")).alias("line_id"), (10 + 120 * F.col("k")).alias("x1"), top.alias("y1"), (10 + 120 * F.col("k")).alias("x2"), (30 * F.col("n")).alias("y2"))
    return flat.unionByName(up)


_RULED_SQL = """
SELECT page_id, CAST(k AS INTEGER) AS line_id, 10 AS x1, CAST(30 * k AS INTEGER) AS y1, 490 AS x2, CAST(30 * k AS INTEGER) AS y2 FROM (SELECT page_id, unnest(range(n + 1)) AS k FROM (SELECT DISTINCT page_id, n FROM order_rows))
UNION ALL
SELECT page_id, CAST(1000 + k AS INTEGER), CAST(10 + 120 * k AS INTEGER), CASE WHEN page_id % 5 = 0 AND n >= 2 AND k = 2 THEN 30 ELSE 0 END, CAST(10 + 120 * k AS INTEGER), 30 * n FROM (SELECT DISTINCT page_id, n FROM order_rows), range(5) t(k)"""


def tokens(spark: SparkSession, sf_dir: str, ended: bool = False) -> DataFrame:
    """Structure tokens of each order's table: page_id, t, token, score, x1, y1, x2, y2 (the cell's box at its first token, else nulls). If `ended`, each table's
    last token is followed by an end token, as in a stream."""
    rows = _numbered_rows(spark, sf_dir)
    has_merged = merged(F.col("page_id"), F.col("n"))
    joined = has_merged & (F.col("r") == 0)

    def token(text: str, c: int | None = None, wide: int = 1):
        ends = (F.lit(10 + 120 * c), 30 * F.col("r"), F.lit(10 + 120 * (c + wide)), 30 * F.col("r") + 30) if c is not None else (F.lit(None).cast("int"),) * 4
        return F.struct(F.lit(text).alias("token"), *[e.cast("int").alias(n) for e, n in zip(ends, ("x1", "y1", "x2", "y2"), strict=True)])

    plain = F.array(token("<tr>"), *[token("<td></td>", c) for c in range(4)], token("</tr>"))
    wide = F.array(token("<tr>"), token("<td></td>", 0), token("<td", 1, 2), token(' colspan="2"'), token(">"), token("</td>"), token("<td></td>", 3), token("</tr>"))
    before = 6 * F.col("r") + F.when(has_merged & (F.col("r") > 0), 2).otherwise(0)  # a row has six tokens, one with a merged cell eight
    said = F.when(joined, wide).otherwise(plain)
    if ended:
        said = F.when(F.col("r") == F.col("n") - 1, F.concat(said, F.array(token("eos")))).otherwise(said)
    rows = rows.select("page_id", before.alias("before"), F.posexplode(said).alias("k", "x"))
    rows = rows.withColumn("t", F.col("before") + F.col("k"))
    return rows.select("page_id", "t", "x.token", ((F.col("t") % 10) / 10.0).alias("score"), "x.x1", "x.y1", "x.x2", "x.y2")


_TOKENS_SQL = """
SELECT page_id, t, token, (t % 10) / 10.0::DOUBLE AS score, x1, y1, x2, y2 FROM (
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY r, k) - 1 AS INTEGER) AS t, token,
        CAST(CASE WHEN c >= 0 THEN 10 + 120 * c END AS INTEGER) AS x1, CAST(CASE WHEN c >= 0 THEN 30 * r END AS INTEGER) AS y1,
        CAST(CASE WHEN c >= 0 THEN 10 + 120 * (c + wide) END AS INTEGER) AS x2, CAST(CASE WHEN c >= 0 THEN 30 * r + 30 END AS INTEGER) AS y2
    FROM (
        SELECT page_id, r, unnest(range(len(l))) AS k, unnest(l) AS token, unnest(cs) AS c, unnest(ws) AS wide FROM (
            SELECT page_id, r,
                CASE WHEN m THEN ['<tr>', '<td></td>', '<td', ' colspan="2"', '>', '</td>', '<td></td>', '</tr>'] ELSE ['<tr>', '<td></td>', '<td></td>', '<td></td>', '<td></td>', '</tr>'] END AS l,
                CASE WHEN m THEN [-1, 0, 1, -1, -1, -1, 3, -1] ELSE [-1, 0, 1, 2, 3, -1] END AS cs,
                CASE WHEN m THEN [1, 1, 2, 1, 1, 1, 1, 1] ELSE [1, 1, 1, 1, 1, 1] END AS ws
            FROM (SELECT *, page_id % 5 = 0 AND n >= 2 AND r = 0 AS m FROM order_rows))))"""


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One HTML table per order, with the texts of its cells: page_id, html."""
    rows = _order_rows(spark, sf_dir)
    texts = [c.cast("string") for c in (F.col("l_partkey"), F.col("l_quantity").cast("int"), F.col("l_returnflag"), F.col("l_linenumber"))]
    first, second, third, fourth = (F.coalesce(F.when(F.col("page_id").isNotNull(), F.concat(F.lit("<td>"), t, F.lit("</td>"))), F.lit("")) for t in texts)
    inner = F.when(merged(F.col("page_id"), F.col("n")) & (F.col("r") == 0), '<td colspan="2"></td>').otherwise(F.concat(second, third))
    lines = rows.select("page_id", F.struct("r", F.concat(F.lit("<tr>"), first, inner, fourth, F.lit("</tr>")).alias("s")).alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "")
    return lines.groupBy("page_id").agg(F.concat(F.lit("<table>"), joined, F.lit("</table>")).alias("html"))


_HTML_SQL = """
SELECT k.page_id, '<table>' || string_agg(CASE WHEN token = '<td></td>' THEN '<td>' || text || '</td>' ELSE token END, '' ORDER BY k.t) || '</table>' AS html
FROM tokens k LEFT JOIN grid_blocks b ON b.page_id = k.page_id AND k.x1 = 10 + 120 * (b.block_id % 4) AND k.y1 = b.t - 4
GROUP BY k.page_id"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognition steps from events: line_id, t, cls, score, scores."""
    kinds = ("view", "click", "purchase", "signup", "error")
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = given(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    cls = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("event_type")).cast("int") - 1
    rows = rows.select(F.col("user_id").cast("long").alias("line_id"), (F.row_number().over(own) - 1).alias("t"), cls.alias("cls"), F.col("value").alias("score"))
    return rows.withColumn("scores", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.when(k == F.col("cls"), 1.0).otherwise(0.1)))


_STEPS_SQL = """
SELECT user_id AS line_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS t,
    CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS cls, value AS score FROM events"""


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column profile from each vector: item_id, x, dark."""
    rows = given(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.posexplode("embedding").alias("x", "v"))
    return rows.select("item_id", "x", F.when(F.col("v") > 0, 1).otherwise(0).alias("dark"))


_PROFILE_SQL = """
SELECT item_id, CAST(x AS INTEGER) AS x, CASE WHEN v > 0 THEN 1 ELSE 0 END AS dark FROM (SELECT vec_id AS item_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS x FROM embeddings)"""


def page_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a page count and a written choice of pages: doc_id, page_count, spec."""
    rows = given(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg((F.max("turn") + 1).cast("int").alias("page_count"))
    return rows.withColumn("spec", F.get(F.array(*[F.lit(s) for s in ("all", "1", "1,3-4", "5-2,2", "2-100")]), (F.col("doc_id") % 5).cast("int")))


_SPECS_SQL = """
SELECT conv_id AS doc_id, CAST(max(turn) + 1 AS INTEGER) AS page_count, ['all', '1', '1,3-4', '5-2,2', '2-100'][conv_id % 5 + 1] AS spec FROM conversations GROUP BY conv_id"""


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink components of each order's table: page_id, comp_id, l, t, r, b, area. Every ninth page has a dotted line above."""
    own = grid_blocks(spark, sf_dir).select("page_id", F.col("block_id").alias("comp_id"), "l", "t", "r", "b")
    own = own.withColumn("area", F.expr("((r - l) * (b - t) * 60) div 100").cast("int"))
    pages = page_sizes(spark, sf_dir).select("page_id").filter("page_id % 9 = 0")
    dots = pages.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    dots = dots.select("page_id", (100000 + F.col("k")).alias("comp_id"), (20 + 9 * F.col("k")).alias("l"), F.lit(5).alias("t"), (26 + 9 * F.col("k")).alias("r"), F.lit(7).alias("b"), F.lit(12).alias("area"))
    return own.unionByName(dots)


_COMPONENTS_SQL = """
SELECT page_id, block_id AS comp_id, l, t, r, b, CAST(((r - l) * (b - t) * 60) // 100 AS INTEGER) AS area FROM grid_blocks
UNION ALL
SELECT page_id, CAST(100000 + k AS INTEGER), CAST(20 + 9 * k AS INTEGER), 5, CAST(26 + 9 * k AS INTEGER), 7, 12 FROM (SELECT DISTINCT page_id FROM order_rows WHERE page_id % 9 = 0), range(8) t(k)"""

#: name -> (DuckDB SQL, names of derived tables that it reads)
SQL = {
    "page_blocks": (_page_blocks_sql(False), ()),
    "skew_blocks": (_page_blocks_sql(True), ()),
    "order_rows": (_ORDER_ROWS_SQL, ()),
    "grid_cells": (_grid_cells_sql(False), ("order_rows",)),
    "far_cells": (_grid_cells_sql(True), ("order_rows",)),
    "grid_blocks": (_GRID_BLOCKS_SQL, ("order_rows",)),
    "ruled_lines": (_RULED_SQL, ("order_rows",)),
    "tokens": (_TOKENS_SQL, ("order_rows",)),
    "html_tables": (_HTML_SQL, ("tokens", "grid_blocks")),
    "steps": (_STEPS_SQL, ()),
    "profile": (_PROFILE_SQL, ()),
    "page_specs": (_SPECS_SQL, ()),
    "components": (_COMPONENTS_SQL, ("grid_blocks",)),
}


def with_sql(*names: str, recursive: bool = False) -> str:
    """A WITH clause, open for further tables, that defines the named derived tables and what they read."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in done:
            for other in SQL[name][1]:
                add(other)
            done[name] = SQL[name][0]

    for name in names:
        add(name)
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(f"{k} AS ({v})" for k, v in done.items())
