"""Operator 4: SimHash near-duplicates, by tiled exact comparison of fingerprints.

Each text becomes a 64-bit majority vote over the hashes of its word shingles. Distinct fingerprints are laid in tiles
by the population counts of their four 16-bit quarters. The difference of two population counts bounds the number of
differing bits from below, so a pair of tiles whose counts differ by more than the radius in sum can't hold a link and
is skipped; every other pair is compared whole, with exclusive-or and bit counts. The result is exact at any size.

`near_copies` is the same comparison at a wide radius, for near copies by a similarity of shingle sets: fingerprints
within the radius are candidates only, and a candidate counts if the exact Jaccard similarity of the two sets says so.
There a tile also has sets of like size, as sets whose sizes differ by more than the similarity can't be near copies.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import connected_components, keep_matching, materialise

#: Fingerprints in a tile, about. A pair of tiles of this size is compared in strips of 512 rows: 1 million pairs at a time.
TILE = 2048
#: Near copies: words in a shingle, least Jaccard similarity, and the radius in which candidates lie. At the least
#: similarity two fingerprints are 10 bits apart on average; the README has the measured share of links within the radius.
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 14
#: Sets in a tile of near_copies, about.
SET_TILE = 4096
#: Words of 64 bits in the outline of a set: it has the bit of each of its hashes.
OUTLINE = 16


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one whole text; null or without words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return majority(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): one row per input row; fp is the fingerprint as a signed long. Only the two named columns are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(t.as_py(), shingle, seed) for t in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def near_tiles(blocks: int, radius: int) -> list[tuple[int, ...]]:
    """The differences of population counts that a pair within the radius can have, each pair of opposite ones once."""
    steps = product(range(-radius, radius + 1), repeat=blocks)
    return sorted(d for d in steps if sum(map(abs, d)) <= radius and d >= (0,) * blocks)


def forest(pairs: np.ndarray) -> np.ndarray:
    """Rows (node, smallest node of its component) for pairs in two rows: no more rows than nodes, however many pairs link."""
    if not pairs.size:
        return np.empty((0, 2), np.uint64)
    nodes, ends = np.unique(pairs, return_inverse=True)
    ends, label = ends.reshape(2, -1), np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, ends[0], label[ends[1]])
        np.minimum.at(least, ends[1], label[ends[0]])
        least = least[least]
        if (least == label).all():
            break
        label = least
    away = label != np.arange(len(nodes))
    return np.stack([nodes[away], nodes[label[away]]], axis=1)


def tile_links(one: np.ndarray, other: np.ndarray, radius: int) -> np.ndarray:
    """Links within the radius between two tiles (or in one, if they are the same array), as a spanning forest.

    Each strip of rows is reduced to its own forest first, so a dense pair of tiles takes the memory of one strip.
    """
    found = [np.empty((0, 2), np.uint64)]
    for at in range(0, len(one), 512):
        i, j = np.nonzero(np.bitwise_count(one[at : at + 512, None] ^ other[None, :]) <= radius)
        pairs = np.stack([one[i + at], other[j]])
        found.append(forest(pairs[:, pairs[0] != pairs[1]]))
    return forest(np.concatenate(found).T)


def fingerprint_links(fps: DataFrame, radius: int = 2, blocks: int = 4, tile: int = TILE) -> DataFrame:
    """(a, b): edges between distinct fingerprints `fp` whose components are those of all links within the radius."""
    width = 64 // blocks
    counts = [F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND((1 << width) - 1)) for i in range(blocks)]
    radix = width + 2 * radius + 1  # no carry when a difference is added
    weights = [radix**i for i in range(blocks)]
    key = sum((c.cast("long") * w for c, w in zip(counts, weights, strict=True)), F.lit(0).cast("long"))
    keyed = fps.select("fp", key.alias("tile"))
    parts = keyed.groupBy("tile").agg(F.ceil(F.count("*") / tile).alias("parts"))
    tiles = materialise(
        keyed.join(parts, "tile")
        .groupBy("tile", F.pmod(F.xxhash64("fp"), "parts").alias("part"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    steps = F.array(*[F.lit(sum(d * w for d, w in zip(ds, weights, strict=True))).cast("long") for ds in near_tiles(blocks, radius)])
    # Which parts meet is found on the tiles' names; then each pair fetches its two arrays by name and part, so that the
    # parts of the usual counts, which meet one another most, are spread over tasks.
    names = tiles.select("tile", F.col("part").alias("part_a"), F.explode(steps).alias("step"))
    names = names.withColumn("other", F.col("tile") + F.col("step"))
    others = tiles.groupBy(F.col("tile").alias("other")).agg(F.max("part").alias("last"))
    names = names.join(others, "other").withColumn("part_b", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    names = names.filter("step <> 0 or part_a <= part_b")
    first = tiles.select("tile", F.col("part").alias("part_a"), F.col("fps").alias("fps_a"))
    second = tiles.select(F.col("tile").alias("other"), F.col("part").alias("part_b"), F.col("fps").alias("fps_b"))
    pairs = names.join(first, ["tile", "part_a"]).join(second, ["other", "part_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(c.offsets.to_numpy(), c.values.to_numpy().view(np.uint64)) for c in (batch.column(0), batch.column(1))]
            links = [np.empty((0, 2), np.uint64)]
            for k in range(len(batch)):
                one, other = (v[o[k] : o[k + 1]] for o, v in sides)
                links.append(tile_links(one, other, radius))
            out = np.concatenate(links).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    return pairs.select("fps_a", "fps_b").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 2
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id.

    Fingerprints that differ in at most `radius` bits link; component_id is the smallest doc_id that links reach, itself
    included (null if all of them are null). Null, empty and wordless texts have fingerprint zero and link like any
    other. Equal fingerprints are compared once, so copies cost nothing; repeated rows stay repeated. Other columns of
    `docs` play no part. The population counts are those of 16-bit quarters, or of bytes from 2**26 distinct
    fingerprints on, where smaller tiles cost less than larger comparisons; the links are the same.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle, seed))
    least = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    blocks = 4 if least.count() < 1 << 26 else 8
    linked = connected_components(fingerprint_links(least.select("fp"), radius, blocks))
    joined = least.join(linked, least.fp == linked.node, "left").select(
        "fp", "doc_id", F.coalesce("component", "fp").alias("component")
    )
    joined = materialise(joined)
    heads = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = joined.join(heads, "component").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(ids, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


# ---- near copies by the similarity of shingle sets ----

_WORD = re.compile(r"[^\W_]+")
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _FOLD
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of a whole text's shingles, sorted.

    Words are lower-cased runs of letters and digits. Fewer than a shingle's are one shingle, the whole sequence; without
    words there is none.
    """
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    runs = max(1, len(words) - shingle + 1)
    out = np.full(runs, min(shingle, len(words)), np.uint64)
    for k in range(min(shingle, len(words))):
        out = _mixed(out ^ hashes[k : k + runs])
    return np.unique(_mixed(out))


def set_key(shingles: np.ndarray) -> int:
    """What stands for a set of shingles: a 64-bit hash of all of it, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes())).view(np.int64))


def outline(shingles: np.ndarray) -> bytes:
    """OUTLINE * 64 bits, of which those are set that hashes of the set fall on."""
    bits = np.zeros(OUTLINE * 64, np.uint8)
    bits[shingles % np.uint64(OUTLINE * 64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_reach(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of outlines leave room for the similarity: a bit that one alone has is at least one hash of its own. None is lost."""
    shared = np.minimum(n_a - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), n_b - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
    return shared >= similarity * (n_a + n_b - shared) - 1e-9


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(at, 256) for at in range(0, len(batch), 256))


def set_prints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, row_key, key, fp, n): of each row a hash of its text, and its shingle set's hash, fingerprint and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            sets = [shingle_set(t.as_py(), shingle) for t in part.column(2)]
            fps = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([set_key(s) for s in sets], pa.int64()), pa.array(fps), pa.array([len(s) for s in sets], pa.int32())],
                ["doc_id", "row_key", "key", "fp", "n"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row_key long, key long, fp long, n int")


def _picked(i: np.ndarray, j: np.ndarray, apart: np.ndarray, most: int) -> np.ndarray:
    """Which pairs (i, j) to take: of each i the `most` nearest j, and the j that the most pairs have."""
    degree = np.bincount(j)
    taken = np.zeros(len(i), bool)
    for order, n in ((np.lexsort((j, apart, i)), most), (np.lexsort((j, -degree[j], i)), 1)):
        own = i[order]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
        taken[order[rank < n]] = True
    return taken


def candidates(one: dict[str, np.ndarray], other: dict[str, np.ndarray], radius: int, similarity: float, most: int | None) -> np.ndarray:
    """Pairs of keys, smaller first, of two tiles (key, fp, n, label): within the radius, of like size, of different labels.

    With `bits`, the outlines, such whose outlines leave room for the similarity. All of them, or with `most` those that _picked takes for either side, strip by strip: some for each node that has any.
    """
    found = [np.empty((2, 0), np.int64)]
    for at in range(0, len(one["fp"]), 512):
        strip = {c: v[at : at + 512] for c, v in one.items()}
        apart = np.bitwise_count(strip["fp"][:, None] ^ other["fp"][None, :])
        i, j = np.nonzero(apart <= radius)
        small, large = np.minimum(strip["n"][i], other["n"][j]), np.maximum(strip["n"][i], other["n"][j])
        good = (strip["label"][i] != other["label"][j]) & (small >= similarity * large - 1e-9)
        if most is None and one is other:
            good &= i + at < j
        i, j = i[good], j[good]
        if "bits" in one and len(i):
            good = np.concatenate([may_reach(strip["bits"][i[k : k + 65536]], other["bits"][j[k : k + 65536]], strip["n"][i[k : k + 65536]], other["n"][j[k : k + 65536]], similarity) for k in range(0, len(i), 65536)])
            i, j = i[good], j[good]
        if most is not None and len(i):
            bits = apart[i, j]
            good = _picked(i, j, bits, most) | _picked(j, i, bits, most)
            i, j = i[good], j[good]
        a, b = strip["key"][i], other["key"][j]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
    return np.concatenate(found, axis=1)


def candidate_pairs(nodes: DataFrame, radius: int, similarity: float, most: int | None, tile: int = SET_TILE) -> DataFrame:
    """(a, b): the candidates among the rows (key, fp, n, label, and maybe bits) of `nodes`, each pair once.

    Tiles are cut by the size of the set (four bands to the factor 1 / similarity) and in a band by population count; pairs of tiles
    whose bands or counts are too far apart are skipped. All others meet, each in a group of its own of two tiles, so the
    work is that of the square of the texts of like size, spread evenly.
    """
    step, reach = math.log(1 / similarity) / 4, 4
    carried = [c for c in ("key", "fp", "n", "label", "bits") if c in nodes.columns]
    keyed = nodes.select(*carried, F.floor(F.log("n") / step).cast("int").alias("band"), F.bit_count("fp").alias("pop"))
    counts = keyed.groupBy("band", "pop").agg(F.count("*").alias("c"))  # at most 65 rows a band
    before = F.sum("c").over(Window.partitionBy("band").orderBy("pop")) - F.col("c")
    counts = counts.select("band", "pop", F.floor(before / tile).alias("part"), F.ceil(F.col("c") / tile).alias("subs"))
    where = keyed.join(counts, ["band", "pop"]).withColumn("sub", F.pmod(F.xxhash64("key"), "subs"))
    name = F.struct("band", "part", "sub")
    where = materialise(where.select(*carried, "pop", name.alias("tile")))
    tiles = materialise(where.groupBy("tile").agg(F.min("pop").alias("low"), F.max("pop").alias("high")))
    a = tiles.select(F.col("tile").alias("x"), F.col("low").alias("low_x"), F.col("high").alias("high_x"), F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("up"))
    a = a.withColumn("band", F.col("x.band") + F.col("up"))
    b = tiles.select(F.col("tile").alias("y"), F.col("low").alias("low_y"), F.col("high").alias("high_y"), F.col("tile.band").alias("band"))
    meet = a.join(b, "band").filter(((F.col("up") > 0) | (F.col("x") <= F.col("y"))) & (F.greatest("low_x", "low_y") - F.least("high_x", "high_y") <= radius))
    meet = materialise(meet.select("x", "y"))
    sides = [meet.select("x", "y", F.col("x").alias("tile"), F.lit(0).alias("side")), meet.filter(F.col("x") != F.col("y")).select("x", "y", F.col("y").alias("tile"), F.lit(1).alias("side"))]
    dealt = where.drop("pop").join(sides[0].unionByName(sides[1]), "tile")

    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        columns = {c: group.column(c).to_numpy() for c in ("key", "fp", "n", "label")}
        columns["fp"], columns["n"] = columns["fp"].view(np.uint64), columns["n"].astype(np.int64)
        if "bits" in carried:
            columns["bits"] = np.frombuffer(b"".join(group.column("bits").to_pylist()), "<u8").reshape(-1, OUTLINE)
        one = {c: v[side == 0] for c, v in columns.items()}
        other = {c: v[side == 1] for c, v in columns.items()} if (side == 1).any() else one
        pairs = candidates(one, other, radius, similarity, most)
        return pa.table({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})

    return dealt.select("x", "y", *carried, "side").groupBy("x", "y").applyInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose sets have at least that Jaccard similarity."""
    one = sets.select(F.col("key").alias("a"), F.col("shingles").alias("shingles_a"))
    other = sets.select(F.col("key").alias("b"), F.col("shingles").alias("shingles_b"))
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    either = F.size("shingles_a") + F.size("shingles_b") - shared
    return pairs.join(one, "a").join(other, "b").filter(shared >= similarity * either - 1e-9).select("a", "b")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, tile: int = SET_TILE
) -> DataFrame:
    """One row per input row: doc_id, row_key (a hash of its text) and component_id, the smallest doc_id that near copies reach.

    Near copies are texts whose sets of shingles have at least that Jaccard similarity and whose fingerprints differ in at
    most `radius` bits. Equal sets (of the 64-bit hash: n * n / 2**65 false ones are to be expected among n) are one
    node, so copies cost nothing; texts without words are equal to each other. Components are those of all such pairs,
    though in large groups not all are looked at: each node is first compared with some of its candidates, then those that are left
    in different components with some more, and last with all that are still in different components. Of the later
    candidates those are left out whose outlines (the bits that their shingles' hashes fall on) prove them too far apart.
    Repeated rows stay repeated; a null id is no smallest id (null, if all of a component are). Other columns play no part.
    """
    prints = materialise(set_prints(docs, id_col, text_col, shingle))
    nodes = materialise(prints.filter("n > 0").groupBy("key", "fp", "n").agg(F.min(F.struct("doc_id", "row_key")).alias("at")))
    plain = nodes.select("key", "fp", "n", F.col("key").alias("label"))
    tried = materialise(candidate_pairs(plain, radius, similarity, 1, tile))
    open_keys = materialise(tried.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    open_nodes = materialise(nodes.join(open_keys, "key", "left_semi"))
    wanted = materialise(open_nodes.select(F.col("at.doc_id").alias("its_id"), F.col("at.row_key").alias("its_key")).distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    texts = keep_matching(texts, wanted, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("row_key") == F.col("its_key")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            found = [shingle_set(t.as_py(), shingle) for t in part.column(0)]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in found]))).astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)))
            bits = pa.array([outline(s) for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in found], pa.int64()), cells, bits], ["key", "shingles", "bits"])

    sets = materialise(texts.select("text").mapInArrow(run, "key long, shingles array<long>, bits binary").dropDuplicates(["key"]))
    open_nodes = materialise(open_nodes.select("key", "fp", "n").join(sets.select("key", "bits"), "key"))
    links = materialise(_verified(tried, sets, similarity))
    linked = None
    for most in (8, None):
        linked = linked if linked is not None else materialise(connected_components(links))
        label = F.coalesce("component", "key").alias("label")
        labelled = open_nodes.join(linked, open_nodes.key == linked.node, "left").select("key", "fp", "n", label, "bits")
        more = materialise(candidate_pairs(labelled, radius, similarity, most, tile).join(tried, ["a", "b"], "left_anti"))
        if more.isEmpty():
            break
        found = materialise(_verified(more, sets, similarity))
        tried = materialise(tried.unionByName(more))
        if not found.isEmpty():
            links = materialise(links.unionByName(found))
            linked = None
    linked = linked if linked is not None else materialise(connected_components(links))
    heads = prints.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    heads = heads.join(linked, heads.key == linked.node, "left").select("key", "doc_id", F.coalesce("component", "key").alias("component"))
    heads = materialise(heads)
    least = heads.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = heads.join(least, "component").select("key", "component_id")
    return prints.select("doc_id", "row_key", "key").join(ids, "key").select("doc_id", "row_key", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The documents with one of each group of near copies left: the one with the smallest id. `params` are those of near_copies.

    Rows are judged each by its own text, also where an id repeats. Of repeated rows (id and text) all stay, as they stand
    for one document. Rows without an id stay too: no decision can name them.
    """
    found = near_copies(docs, id_col, text_col, **params)
    gone = materialise(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key")).distinct())
    same = (F.col(id_col).cast("long") == F.col("gone_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("gone_key"))
    return keep_matching(docs, gone, same, "left_anti")
