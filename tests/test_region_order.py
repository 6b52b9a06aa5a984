"""The order within a region: what lies ahead of a block is worked out once for all of a region's blocks, or block by block, with the same order."""

from __future__ import annotations

import random

import numpy as np

from pagewright.functions.geometry import Rect
from pagewright.operators import pages as P


def regions(seed, n=40):
    rng = random.Random(seed)
    for _ in range(n):
        boxes = [((x := rng.randrange(0, 300)), (y := rng.randrange(0, 12) * 10 + rng.randrange(3)), x + rng.randrange(0, 120), y + rng.choice([8, 10, 20])) for _ in range(rng.randrange(1, 30))]
        yield Rect(*(np.array(side, float) for side in zip(*boxes, strict=True))), np.array([rng.randrange(0, 30) for _ in boxes])


def test_small_and_large_regions_are_read_alike(monkeypatch):
    want = [P.reading_order(*r) for r in regions(1)]
    monkeypatch.setattr(P, "AT_ONCE", 0)
    assert [P.reading_order(*r) for r in regions(1)] == want


def test_alignments_of_a_small_region_are_worked_out_once(monkeypatch):
    calls = []
    monkeypatch.setattr(P, "aligned", lambda *a, own=P.aligned: calls.append(1) or own(*a))
    for r in regions(2, 5):
        calls.clear()
        P.reading_order(*r)
        assert len(calls) <= 2
