"""Text search in blocks: where a text stands, and listings of what a page holds."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.geometry import anchor_point, corner, place_of, point_between, truncated
from pagewright.functions.text import ascii_lower, weighted_char_ratio
from pagewright.operators.aggregates import ordered_concat
from pagewright.operators.filters import PAGE, matches_text
from pagewright.operators.lines import let
from pagewright.sources.shared import shared_table

try:
    import ahocorasick
except ImportError:  # then all queries go by their grams
    ahocorasick = None

#: Query tables of at most so many rows are broadcast, as one automaton; larger ones are joined by a shuffle on a gram of theirs.
BROADCAST_QUERIES = 10_000
#: Characters of a gram; a shorter query is its own.
GRAM = 3
#: Size of the map that tells which grams are asked for.
GRAM_BITS = 1 << 16


def list_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, index, text, score, box)."""
    return blocks.select(*PAGE, F.col("block_id").alias("index"), "text", "score", "box")


def all_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, text): the block texts in order, one per line."""
    return blocks.groupBy(*PAGE).agg(ordered_concat("block_id", F.col("text"), "\n").alias("text"))


def all_positions(blocks: DataFrame, loc: str = "center") -> DataFrame:
    """(doc_id, page, block_id, text, x, y)."""
    x, y = anchor_point(F.col("box"), F.lit(loc))
    return blocks.select(*PAGE, "block_id", "text", x.alias("x"), y.alias("y"))


def has_text(blocks: DataFrame, query: str) -> DataFrame:
    """(doc_id, page, found): case counts."""
    return blocks.groupBy(*PAGE).agg(F.bool_or(F.contains(F.col("text"), F.lit(query))).alias("found"))


def _located(hits: DataFrame, query: Column, loc: Column, segments: DataFrame | None) -> DataFrame:
    start = F.instr(ascii_lower(F.col("text")), ascii_lower(query)) - 1
    last = start + F.char_length(query) - 1
    hits = hits.withColumn("_start", start).withColumn("_last", last)
    x, y = point_between(F.col("box"), loc, weighted_char_ratio(F.col("text"), F.col("_start")), weighted_char_ratio(F.col("text"), F.col("_last") + 1))
    if segments is None:
        return hits.withColumn("x", x).withColumn("y", y).drop("_start", "_last")
    lists = segments.groupBy(*PAGE, "block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", "start", "end"))), lambda s: truncated((s["start"] + s["end"]) / 2)).alias("_mids"))
    hits = hits.join(lists, [*PAGE, "block_id"], "left")
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = (corner(F.col("box"), i) for i in range(4))
    mid = F.get("_mids", F.expr("(_start + _last) div 2").cast("int"))
    share = F.when(x1 != x0, F.least(F.greatest((mid - x0) / (x1 - x0), F.lit(0.0)), F.lit(1.0))).otherwise(0.5)
    place = place_of(loc)
    low = place.isin("bottomleft", "bottomright")
    sx = F.when(low, x3 + truncated(share * (x2 - x3))).otherwise(x0 + truncated(share * (x1 - x0)))
    sy = F.when(place == "topleft", y0).when(place == "topright", y1).when(place == "bottomleft", y3).when(place == "bottomright", y2).otherwise(truncated((y0 + y3) / 2))
    seen = F.size("_mids") == F.char_length("text")
    return hits.withColumn("x", F.when(seen, sx).otherwise(x)).withColumn("y", F.when(seen, sy).otherwise(y)).drop("_start", "_last", "_mids")


@cache
def _automaton(patterns: tuple[str, ...]):
    """Finds all patterns in one pass over a text. One is made in each Python worker."""
    found = ahocorasick.Automaton()
    for k, pattern in enumerate(patterns):
        found.add_word(pattern, k)
    found.make_automaton()
    return found


def _scanned(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """Each block with each query that it holds: a text is read once, whatever the number of queries, which has been counted to be small."""
    named = asked.withColumn("_pattern", ascii_lower(F.col("q")))
    patterns = blocks.sparkSession.sparkContext.broadcast(tuple(sorted(r[0] for r in named.select("_pattern").distinct().collect())))

    @F.pandas_udf("array<int>")
    def held(texts: pd.Series) -> pd.Series:
        scan = _automaton(patterns.value).iter if patterns.value else lambda _: ()
        return texts.map(lambda t: sorted({k for _, k in scan(t)}))

    numbers = blocks.sparkSession.createDataFrame(list(enumerate(patterns.value)), "_at int, _pattern string")
    queries = F.broadcast(named.join(numbers, "_pattern").drop("_pattern"))
    found = blocks.withColumn("_at", F.explode(held(F.coalesce(ascii_lower(F.col("text")), F.lit("")))))
    return found.join(queries, "_at").drop("_at")


def _grams(text: Column, sizes: list[int]) -> Column:
    """The distinct stretches of so many characters in a text."""

    def pieces(chars: Column, n: int) -> Column:
        at = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return let(chars, lambda c: F.array_distinct(F.concat(*[pieces(c, n) for n in sizes])))


def _bit(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_BITS)).cast("int")


def _with_grams(blocks: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """Blocks with `_gram`: those of their grams that may be among `grams`, told by a map of GRAM_BITS bits, however many there are."""
    words = [0] * (GRAM_BITS // 64)
    for row in grams.groupBy(F.shiftright(_bit(F.col("_gram")), 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(_gram), {GRAM_BITS}) & 63 as int))")).alias("bits")).collect():
        words[row.word] = row.bits
    held = F.expr("array(" + ", ".join(f"{w}L" if w > -(1 << 63) else "bigint(-9223372036854775808)" for w in words) + ")")
    asked = lambda g: let(_bit(g), lambda h: F.get(held, F.shiftright(h, 6)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)))) != 0)
    return blocks.withColumn("_gram", F.explode(F.filter(_grams(ascii_lower(F.col("text")), sizes), asked)))


def _holding(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """Each block with each query that it holds, by an equi join on the query's rarest gram.

    The grams of the queries are counted over all blocks first; a query with a gram that no block has finds nothing.
    """
    size = F.least(F.char_length("q"), F.lit(GRAM))
    sizes = sorted(r.n for r in asked.select(size.alias("n")).distinct().collect())
    own = asked.withColumn("_gram", F.explode(F.filter(_grams(ascii_lower(F.col("q")), sizes), lambda g: F.char_length(g) == size)))
    grams = own.select("_gram").distinct()
    seen = _with_grams(blocks.select("text"), grams, sizes).groupBy("_gram").agg(F.count("*").alias("_n"))
    counted = own.join(seen, "_gram", "left")
    rarest = counted.groupBy("query_id", "q", "n", "loc").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_least")).filter("_least.n > 0")
    rarest = shared_table(rarest.select("query_id", "q", "n", "loc", F.col("_least._gram").alias("_gram")))
    near = _with_grams(blocks, rarest, sizes)
    return near.join(rarest, "_gram").filter(matches_text(F.col("text"), F.col("q"))).drop("_gram")


def find_text_many(blocks: DataFrame, queries: DataFrame, segments: DataFrame | None = None, broadcast_queries: int = BROADCAST_QUERIES) -> DataFrame:
    """(query_id, doc_id, page, block_id, x, y): each page's place of each query (query_id, q, n, loc).

    The n-th block of the page that holds the text counts (a block once, case of ASCII letters not counting), and in it the
    first hit. With `segments` (doc_id, page, block_id, seg, start, end), a block with one segment for each character is
    located by them, others by the widths of characters. Empty queries find nothing.
    """
    asked = queries.filter("q <> ''")
    asked = asked.select("query_id", "q", "n", "loc").distinct()
    few = ahocorasick is not None and asked.count() <= broadcast_queries
    hits = _scanned(blocks, asked) if few else _holding(blocks, asked)
    return _nth_located(hits, ("query_id", *PAGE), segments)


def _nth_located(hits: DataFrame, keys: tuple[str, ...], segments: DataFrame | None) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("block_id"))
    hits = hits.withColumn("_at", at).filter(F.col("_at") == F.greatest("n", F.lit(1))).drop("_at")
    return _located(hits, F.col("q"), F.col("loc"), segments).select(*keys, "block_id", "x", "y")


def find_text(blocks: DataFrame, query: str, n: int = 1, loc: str = "center", segments: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, block_id, x, y): as find_text_many, for one query, which is a filter."""
    asked = {"q": F.lit(query), "n": F.lit(n), "loc": F.lit(loc)}
    hits = blocks.filter(matches_text(F.col("text"), F.lit(query)) & (F.lit(query) != "")).withColumns(asked)
    return _nth_located(hits, PAGE, segments)
