"""Set operators: unions of lines and areas, distinct edges, tables of a document in one."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators import sweeps as S


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all, matched by column names; repeats stay."""
    return reduce(DataFrame.unionByName, others, first)


def distinct_edges(cells: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, axis, v): the distinct x and y coordinates of cells."""
    edges = F.array(*[F.struct(F.lit(c[0]).alias("axis"), F.col(c).alias("v")) for c in ("x1", "x2", "y1", "y2")])
    return cells.select(key, F.explode(edges).alias("e")).select(key, "e.axis", "e.v").distinct()


def union_tables_with_titles(tables: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc_id, out_row, kind, table_no, row, col, text, colspan): a document's tables in one, each under a title row.

    `tables` has table_no, title (may be null), and cells (row, col, text, colspan). A title spans the columns of the first
    row of the document's first table; eight if it has none. A document's tables come together in one grouping, and its rows
    are numbered over arrays; nothing is joined.
    """
    kinds = {f.name: f.dataType for f in tables.schema["cells"].dataType.elementType}
    lists = tables.groupBy(doc).agg(F.collect_list(F.struct("table_no", "title", "cells")).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_of, own = S.flat(batch, "items")
            numbers, titles, lists = (own.field(n) for n in ("table_no", "title", "cells"))
            place = pc.rank(numbers, null_placement="at_start", tiebreaker="dense").to_numpy().astype(int)
            table, cells = np.repeat(np.arange(len(own)), pc.fill_null(pc.list_value_length(lists), 0)), lists.flatten()
            said = np.flatnonzero(pc.and_(cells.is_valid(), cells.field("row").is_valid()).to_numpy(zero_copy_only=False))
            table, cells = table[said], cells.take(pa.array(said))
            row = cells.field("row").to_numpy()

            # The width of a document's first table with a first row.
            head = np.flatnonzero(row == 0)
            least = np.full(batch.num_rows, len(own) + 1)
            np.minimum.at(least, doc_of[table[head]], place[table[head]])
            head = head[place[table[head]] == least[doc_of[table[head]]]]
            spans = cells.field("colspan").take(pa.array(head))
            known = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            width = np.full(batch.num_rows, 8)
            width[np.unique(doc_of[table[head[known]]])] = 0
            np.add.at(width, doc_of[table[head[known]]], spans.take(pa.array(known)).to_numpy())
            width = np.clip(width, -(1 << 31), (1 << 31) - 1)

            titled = np.flatnonzero(titles.is_valid().to_numpy(zero_copy_only=False))
            both, rows = np.concatenate([titled, table]), np.concatenate([np.full(len(titled), -1), row])
            order = np.lexsort((rows, place[both], doc_of[both]))
            docs, tables_, rows_ = doc_of[both][order], place[both][order], rows[order]
            fresh = (docs[1:] != docs[:-1]) | (tables_[1:] != tables_[:-1]) | (rows_[1:] != rows_[:-1])
            dense = np.cumsum(np.r_[[0] * min(len(order), 1), fresh]).astype(np.int32)
            out = np.empty(len(order), np.int32)
            out[order] = dense - dense[np.searchsorted(docs, docs)]
            column = lambda name, first: pa.concat_arrays([first.cast(cells.field(name).type), cells.field(name)])
            sides = [batch.column(0).take(pa.array(doc_of[both])), pa.array(np.repeat(["title", "cell"], [len(titled), len(table)]), pa.string()), numbers.take(pa.array(both))]
            sides += [column("row", pa.array(np.full(len(titled), -1))), column("col", pa.array(np.zeros(len(titled), int)))]
            sides += [column("text", titles.take(pa.array(titled))), column("colspan", pa.array(width[doc_of[titled]])), pa.array(out)]
            yield pa.RecordBatch.from_arrays(sides, [doc, "kind", "table_no", "row", "col", "text", "colspan", "out_row"])

    said = ", ".join(f"{n} {kinds[n].simpleString()}" for n in ("row", "col", "text", "colspan"))
    return lists.mapInArrow(run, f"{doc} {tables.schema[doc].dataType.simpleString()}, kind string, table_no {tables.schema['table_no'].dataType.simpleString()}, {said}, out_row int")
