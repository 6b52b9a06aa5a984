"""Operator 13: the trie of conversations' common beginnings, from composable fingerprints.

A conversation may be rebuilt from the head of another and its own later turns. A fingerprint of turns is the sum of
`element * base ** place` over a prime field, so fingerprints compose like the turns: the product of a base's head and an own suffix
is the head's sum and the difference of two of the conversation's own sums, moved to its new places. Rebuilt texts are never made: a rebuilt turn
is a reference to the stored turn, with its digest, its bytes and the fingerprint of the rebuilt turns up to it.

Rebuilt turns of equal depth and fingerprint are a node of the trie. That they are equal is verified, not believed: all members of a node must
refer to stored turns of one SHA-256 and have one parent. If ever two differ, the trie is made again with other bases.

What a node sums over its subtree is summed over its members instead: every node's share is kept by its smallest member, and a conversation
brings to each node on its way what it keeps from there on. So no level waits for another, however deep the trie.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import materialise

#: Each fingerprint is four numbers below this prime, packed in two longs.
PRIME = (1 << 31) - 1
LANES = 4
#: Heads are at most so many turns long; a base's first turns are kept in one row.
MAX_HEAD = 8
#: Ids of ends are joined into texts by so many numbers, before a node's texts are hashed one after another.
END_BLOCK = 256

NODE = ["depth", "_fa", "_fb"]


def head_length(conv_id: Column) -> Column:
    """How many turns a conversation takes from its base: the unsigned CRC-32 of its decimal id, modulo 9."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MAX_HEAD + 1)).cast("int")


def base_of(conv_id: Column) -> Column:
    """The conversation that the head is taken from; the remainder has the sign of the id."""
    return conv_id - conv_id % 5


def _power(base: int, exponent: Column) -> Column:
    """base ** exponent modulo PRIME, for exponents from 0 to 2 ** 31 - 1: the product of the squares that its bits name."""
    squares = [(1 << bit, pow(base, 1 << bit, PRIME)) for bit in range(31)]
    steps = F.expr("array(" + ", ".join(f"named_struct('bit', {bit}L, 'square', {square}L)" for bit, square in squares) + ")")
    return F.aggregate(F.filter(steps, lambda s: s["bit"].bitwiseAND(exponent) != 0), F.lit(1).cast("long"), lambda p, s: p * s["square"] % PRIME)


def _bases(seed: int) -> list[int]:
    draw = random.Random(seed)
    return [draw.randrange(1 << 20, PRIME - 1) for _ in range(LANES)]


def stored_turns(conversations: DataFrame, bases: list[int]) -> DataFrame:
    """(conv_id, at, digest, bytes, f0..f3): each turn's place from 1 in its conversation, and the fingerprint of the turns up to it."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.sha2(named, 256).alias("digest"), F.octet_length(text).cast("long").alias("bytes"), role.alias("_r"), text.alias("_s"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "_r", "_s")
    rows = rows.withColumn("at", F.row_number().over(order)).drop("_r", "_s")
    for k, base in enumerate(bases):
        element = F.pmod(F.xxhash64(F.lit(k), F.col("digest")), F.lit(PRIME))
        rows = rows.withColumn(f"_e{k}", element * _power(base, F.col("at").cast("long")) % PRIME)
    so_far = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("conv_id", "at", "digest", "bytes", *[(F.sum(f"_e{k}").over(so_far) % PRIME).alias(f"f{k}") for k in range(LANES)])


def _packed(lanes: list[Column]) -> list[Column]:
    return [F.shiftleft(lanes[0], 31).bitwiseOR(lanes[1]), F.shiftleft(lanes[2], 31).bitwiseOR(lanes[3])]


def rebuilt_turns(conversations: DataFrame, bases: list[int]) -> DataFrame:
    """(conv_id, depth, _fa, _fb, _pa, _pb, digest, bytes, total): the rebuilt conversations as references; depth 0 is every conversation's root.

    `_pa`, `_pb` is the fingerprint one turn before, `total` the number of the conversation's rebuilt turns.
    """
    turns = materialise(stored_turns(conversations, bases))
    lanes = [f"f{k}" for k in range(LANES)]
    first = F.array_sort(F.collect_list(F.when(F.col("at") <= MAX_HEAD, F.struct("at", "digest", "bytes", *lanes))))
    own = turns.groupBy("conv_id").agg(F.max("at").alias("n"), first.alias("head"))
    convs = own.withColumn("h", head_length(F.col("conv_id"))).withColumn("base", base_of(F.col("conv_id")))
    heads = own.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    none = F.array().cast(own.schema["head"].dataType)
    convs = convs.join(heads, "base", "left").withColumn("base_head", F.slice(F.coalesce("base_head", none), 1, F.col("h")))
    convs = convs.withColumn("taken", F.size("base_head")).withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    nothing = F.lit(0).cast("long")

    def sums(items: str, k: Column) -> list[Column]:
        """The lanes of the first k turns of a head."""
        return [F.coalesce(F.get(items, k - 1)[x], nothing) for x in lanes]

    pair = lambda a, b: [c.alias(n) for c, n in zip([*_packed(a), *_packed(b)], ("_fa", "_fb", "_pa", "_pb"), strict=True)]
    roots = convs.select("conv_id", F.lit(0).alias("depth"), *[nothing.alias(c) for c in ("_fa", "_fb", "_pa", "_pb")], F.lit("").alias("digest"), nothing.alias("bytes"), "total")
    taken = convs.select("conv_id", "total", "base_head", F.posexplode("base_head").alias("_k", "t"))
    taken = taken.select("conv_id", (F.col("_k") + 1).alias("depth"), *pair([F.col(f"t.{x}") for x in lanes], sums("base_head", F.col("_k"))), "t.digest", "t.bytes", "total")

    moved = convs.filter("n > h").select("conv_id", "h", "taken", "total", F.array(*sums("base_head", F.col("taken"))).alias("_base"), F.array(*sums("head", F.col("h"))).alias("_own"))
    rest = turns.join(moved, "conv_id").filter("at > h")
    now = []
    for k, base in enumerate(bases):
        back = [pow(base, -x, PRIME) for x in range(MAX_HEAD + 1)]  # turns move up by h - taken places
        shift = F.get(F.array(*map(F.lit, back)).cast("array<bigint>"), F.col("h") - F.col("taken"))
        now.append((F.col("_base")[k] + F.pmod(F.col(f"f{k}") - F.col("_own")[k], F.lit(PRIME)) * shift) % PRIME)
    rest = rest.select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), *[c.alias(f"_n{k}") for k, c in enumerate(now)], "_base", "digest", "bytes", "total")
    order = Window.partitionBy("conv_id").orderBy("depth")
    before = [F.coalesce(F.lag(f"_n{k}").over(order), F.col("_base")[k]) for k in range(LANES)]
    rest = rest.select("conv_id", "depth", *pair([F.col(f"_n{k}") for k in range(LANES)], before), "digest", "bytes", "total")
    return materialise(roots.unionByName(taken).unionByName(rest))


def _nodes(turns: DataFrame) -> DataFrame:
    """(depth, _fa, _fb, _pa, _pb, conv_id, n_convs, bytes, n_ends, equal): a row for each group of rebuilt turns."""
    parts = ["digest", "_pa", "_pb", "bytes"]
    equal = F.lit(True)
    for c in parts:
        equal = equal & (F.min(c) == F.max(c))
    return turns.groupBy(*NODE).agg(
        F.min("_pa").alias("_pa"), F.min("_pb").alias("_pb"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.count_if(F.col("depth") == F.col("total")).alias("n_ends"), equal.alias("equal")
    )


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in order of node and block -> a digest for each node. Holds one digest's state, however many ids end at a node."""
    node, state, names = None, None, ["depth", "_fa", "_fb", "ends_sha256"]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names)

    for batch in batches:
        found = []
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "_fa", "_fb", "ids")), strict=True):
            if key != node:
                if node:
                    found.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield rows(found)
    if node:
        yield rows([(*node, state.hexdigest())])


def ends_of(turns: DataFrame) -> DataFrame:
    """(depth, _fa, _fb, ends_sha256): of the conversations that end at a node the digest of their ids, ascending, joined by commas."""
    ends = turns.filter("depth = total").withColumn("_block", F.floor(F.col("conv_id") / END_BLOCK))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy(*NODE, "_block").agg(ids.alias("ids"))
    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "_block").mapInArrow(_hash_ends, "depth int, _fa long, _fb long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, seed: int = 13) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node.

    Turns (conv_id, turn, role, text) are ordered by turn, null first, equal turns by role and text; null roles and texts are empty, and repeated
    rows are turns of their own. Rows without a conv_id belong to no conversation and are left out. Conversation c is rebuilt: the first h turns of
    c - c % 5 (all if fewer, none if absent), then its own turns after its first h, h being CRC-32 of the decimal c modulo 9. Each distinct
    beginning (role, text) of rebuilt turns is a node, the root having none. conv_id is its smallest member; saved_tokens
    sums (members - 1) * UTF-8 bytes of the last text over the subtree; ends_sha256 is of the members that end at the node. Other columns are ignored.
    No conversations, no nodes.

    One conversation's turns are put in order, and summed up, by one task that spills; heads are at most eight turns; all else is dealt by node and summed
    before it is shuffled. A node where a third of all conversations end has its ids joined in blocks, which one task hashes one after another, as SHA-256 asks.
    """
    while True:
        turns = rebuilt_turns(conversations, _bases(seed))
        nodes = materialise(_nodes(turns))
        if nodes.filter("not equal").isEmpty():
            break
        seed += 1
    ways = turns.select("conv_id", *NODE, (F.col("depth") == F.col("total")).alias("_end"))
    held = nodes.select(*NODE, F.col("conv_id").alias("_least"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("_saved"), (F.col("n_ends") == F.col("n_convs")).alias("_leaf"))
    ways = ways.join(held, NODE)
    own = F.col("conv_id") == F.col("_least")
    ways = ways.select("conv_id", *NODE, F.when(own, F.col("_saved")).otherwise(0).alias("_saved"), (own & F.col("_end") & F.col("_leaf")).cast("long").alias("_leaf"))
    onward = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    ways = ways.select(*NODE, F.sum("_saved").over(onward).alias("_saved"), F.sum("_leaf").over(onward).alias("_leaf"))
    sums = ways.groupBy(*NODE).agg(F.sum("_saved").alias("saved_tokens"), F.sum("_leaf").alias("n_leaves"))
    parent = [(F.col("depth") - 1).alias("depth"), F.col("_pa").alias("_fa"), F.col("_pb").alias("_fb")]
    children = nodes.filter("depth > 0").select(*parent).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("_fa").alias("_pa"), F.col("_fb").alias("_pb"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(above, ["depth", "_pa", "_pb"], "left").join(sums, NODE).join(children, NODE, "left").join(ends_of(turns), NODE, "left")
    return out.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
