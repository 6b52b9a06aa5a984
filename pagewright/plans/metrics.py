"""Page metrics from the rectangles of ink components: character length, line separation, merged boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators import components as K
from pagewright.operators import sweeps as S


def page_metrics(components: DataFrame, blockers: DataFrame | None = None) -> DataFrame:
    """(page_id, char_length, line_sep, boxes) of components (page_id, comp_id, l, t, r, b, area): pages without components of usual shape and size have no row.

    Components of 5 inked points at most and parts of dotted lines go; those of unusual shape or size come back where they lie near a usual one. Boxes are those
    of components that are close to one another; line_sep is 0 if no box has another below it. `blockers` (page_id, l, t, r, b) may block the space between
    components. Both come together by page in one grouping, and all steps run over arrays.
    """
    key = components.schema["page_id"].dataType.simpleString()
    blockers = blockers if blockers is not None else components.select("page_id", *"ltrb").filter("false")
    own = components.filter("area > 5").select("page_id", F.struct("comp_id", *"ltrb", F.col("area").cast("double").alias("area")).alias("_own"))
    both = own.unionByName(blockers.select("page_id", F.struct(*"ltrb").alias("_other")), allowMissingColumns=True)
    lists = both.groupBy("page_id").agg(F.collect_list("_own").alias("items"), F.collect_list("_other").alias("covers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            page, items = S.flat(batch, "items")
            own, order = S.in_order(page, items, "ltrb")
            ids, area = S.ids_of(items, "comp_id")[order], S.numbers(items, "area")[order]
            plain = np.flatnonzero(K.outside(own, K.dotted_lines(own)))
            own, ids, area = own.at(plain), ids[plain], area[plain]
            kept = K.usual(own, area, n)
            chars = K.char_lengths(own.page[kept], (own.r - own.l)[kept], n)
            left = np.flatnonzero(~kept)
            kept[left[K.attached(own.at(left), own.at(np.flatnonzero(kept)), chars)]] = True
            own, ids = own.at(np.flatnonzero(kept)), ids[kept]
            covers, _ = S.in_order(*S.flat(batch, "covers"), "ltrb")
            labels = S.by_least(own.page, ids, lambda own=own, ids=ids, covers=covers, chars=chars, n=n: S.close_pairs(own, ids, chars[own.page], covers, n))
            boxes = K.boxes_of(own.page, labels, own)
            whose, apart = K.separations(boxes, np.floor(chars / 2))
            seps = np.nan_to_num(K.modes(whose, 2 * np.floor(apart / 2) + 1, n))
            counts = np.bincount(boxes.page, minlength=n)
            told = np.flatnonzero(counts > 0)
            sides = [batch.column(0).take(pa.array(told)), pa.array(chars[told]), pa.array(seps[told].astype(np.int64)), pa.array(counts[told].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(sides, ["page_id", "char_length", "line_sep", "boxes"])

    return lists.mapInArrow(run, f"page_id {key}, char_length double, line_sep long, boxes long")
