"""The pipeline's near-duplicates against brute force over all pairs."""

from __future__ import annotations

import re

import numpy as np
import pytest

import corpus_pipeline
from pagewright.llm import neardup
from tests.llm.test_operators import documents


def word_sets(rows):
    """doc_id -> the set of its five-word shingles."""
    sets = {}
    for d, text in rows.items():
        w = re.findall(r"[^\W_]+", (text or "").lower())
        sets[d] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return sets


def brute_heads(rows, radius=64, similarity=0.8):
    """doc_id -> smallest doc_id that links reach: of that Jaccard similarity, and with fingerprints at most `radius` bits apart."""
    sets = word_sets(rows)
    fps = {d: neardup.majority(neardup.shingle_set(t)) for d, t in rows.items()}
    links = [(a, b) for a, s in sets.items() for b, t in sets.items() if a < b and (s == t or (len(s & t) >= similarity * len(s | t) and bin(fps[a] ^ fps[b]).count("1") <= radius))]
    head, changed = {d: d for d in rows}, True
    while changed:
        changed = False
        for a, b in links:
            if head[a] != head[b]:
                head[a] = head[b] = min(head[a], head[b])
                changed = True
    return head


def test_stage_drops_near_copies_of_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    got = {r.doc_id for r in kept.collect()}
    heads = brute_heads(rows, neardup.RADIUS)
    assert kept.columns == docs.columns and got == {d for d, h in heads.items() if d == h}
    near = {d for d, h in brute_heads(rows).items() if d != h}
    assert not (set(rows) - got) - near, "no clean document goes"
    assert near and len(near & got) <= 0.1 * len(near), "the radius misses few"


@pytest.mark.parametrize("tile", [4, 4096])
def test_stage_follows_chains_and_keeps_what_is_below(spark, tile):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 300)]
    rows = {1: " ".join(words)}
    for k in range(2, 30):  # each a near copy of the one before, the ends far apart
        words = list(words)
        words[10 * k - 15 : 10 * k - 12] = [f"x{k}", f"y{k}", f"z{k}"]
        rows[k] = " ".join(words)
    far = list(words)
    far[::12] = ["other"] * len(far[::12])
    rows |= {50: " ".join(far), 51: "two words", 52: "Two  words!", 53: "two other", 54: None, 55: "", 56: "?"}
    clash = " ".join(f"v{k}" for k in range(40))
    docs = documents(spark, [*((d, t, "en", "a") for d, t in rows.items()), (None, rows[1], "en", "a"), (1, rows[1], "en", "a"), (2, clash, "en", "a")])
    heads = brute_heads(rows, neardup.RADIUS)
    kept = neardup.keep_one(docs, tile=tile)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert kept.columns == docs.columns and heads[29] == 1 and heads[50] == 50
    want = [(None, rows[1]), (1, rows[1]), (2, clash), *((d, rows[d]) for d, h in heads.items() if d == h)]
    assert got == sorted(want, key=str), "a row is judged by its own text, also where its id repeats"
    assert neardup.keep_one(documents(spark, [])).count() == 0


def test_large_groups_around_the_similarity(spark):
    """Copies with a tenth of their words changed: near the original, of which some are near one another and some aren't."""
    rng = np.random.default_rng(2)
    rows, at = {}, 0
    for group in range(3):
        words = [f"g{group}w{k}" for k in range(200)]
        for _ in range(60):
            own = list(words)
            for k in rng.integers(0, 200, int(rng.integers(2, 9))):
                own[k] = f"n{rng.integers(10**9)}"
            rows[at] = " ".join(own)
            at += 1
    heads = brute_heads(rows, neardup.RADIUS)
    found = neardup.near_copies(documents(spark, [(d, t, "en", "a") for d, t in rows.items()]), tile=16).collect()
    assert {r.doc_id: r.component_id for r in found} == heads
    assert len(set(heads.values())) > 3, "some are apart from their group"


def test_outlines_lose_no_pair():
    rng = np.random.default_rng(8)
    for n in (1, 5, 60, 400, 3000):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        for share in (0.0, 0.05, 0.11, 0.12, 0.3, 1.0):
            other = base.copy()
            changed = rng.permutation(n)[: round(share * n)]
            other[changed] = rng.integers(0, 2**63, len(changed), dtype=np.uint64)
            a, b = np.unique(base), np.unique(other)
            rows = [np.frombuffer(neardup.outline(x), "<u8").reshape(1, -1) for x in (a, b)]
            shared = len(np.intersect1d(a, b))
            near = shared >= 0.8 * (len(a) + len(b) - shared)
            may = bool(neardup.may_reach(*rows, np.array([len(a)]), np.array([len(b)]), 0.8)[0])
            assert may or not near
            if n == 60 and share == 0.3:
                assert not may
