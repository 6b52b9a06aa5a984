"""Operators 11 to 13 against brute force, over given tables and rows with nulls, ties, repeats, long texts and extra columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import prefix_trie, repeated_lines, spelling
from pagewright.llm.prefix_trie import prefix_trie as trie
from pagewright.llm.queries import QUERIES
from pagewright.llm.repeated_lines import drop_shared_lines
from pagewright.llm.spelling import near_words, roots_of, spelling_forms, vocabulary

LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
DOC = "doc_id long, text string, n long, word string, _id string, _lines string, form string, root string"
TURN = "conv_id long, turn long, role string, text string, depth int, at int, digest string, h int"


def documents(spark, rows):
    """Rows (doc_id, text), with extra columns of clashing names."""
    return spark.createDataFrame([(*r, 1, "w", "i", "l", "f", "r") for r in rows], DOC)


def turns(spark, rows):
    return spark.createDataFrame([(*r, 7, 8, "d", 9) for r in rows], TURN)


def brute_forms(rows):
    """Sorted (word, form, root, n, n_near, form_n)."""
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= 5
    n = {w: k for w, k in n.items() if k >= 3}
    near = {w: set() for w in n}
    holes: dict[tuple, list[str]] = {}
    for w in n:
        for i in range(len(w)):
            holes.setdefault((i, w[:i], w[i + 1 :]), []).append(w)
            if (v := w[:i] + w[i + 1 :]) in n:
                near[w].add(v)
                near[v].add(w)
    for group in holes.values():
        for a in group:
            near[a].update(b for b in group if b != a)
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v for w, v in best.items() if v and n[v] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def test_op11(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op11_spelling"](spark, sf_dir).collect()), key=lambda r: r[0])
    assert got == brute_forms(rows) and any(r[1] for r in got)


@pytest.mark.parametrize("max_bits", [spelling.MAX_BITS, 64])
def test_spelling_edges(spark, max_bits):
    long = "q" * 3_000
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (None, "Letter letter LETTER Straße straße Straße Àpple Àpple Àpple àpple àpple àpple"), (4, "lettre " * 7 + "letters " * 9 + "leter " * 3), (4, "lettre " * 7), (5, f"{long} {long}q {long}a " * 3)]
    rows += [(k, "aaaaa aaaab aaaba aaaaa aaaac " * k) for k in range(6, 12)] * 2
    got = sorted((tuple(r) for r in spelling_forms(documents(spark, rows), max_bits=max_bits).collect()), key=lambda r: r[0])
    assert got == brute_forms(rows)
    assert spelling_forms(documents(spark, []), max_bits=max_bits).collect() == []


def test_spelling_takes_the_first_of_equally_frequent(spark):
    rows = [(1000 + k, w) for k, w in enumerate(["planet"] * 3 + ["planex"] * 60 + ["planea"] * 60)]
    got = {r.word: r for r in spelling_forms(documents(spark, rows)).collect()}
    assert sorted(map(tuple, got.values())) == brute_forms(rows) and got["planet"].n_near == 2


def test_numbers_of_edits_are_those_of_the_edited_words():
    words = ["hello", "aabba", "àÿzéx"]
    full = {5: np.full((1, spelling.WORDS), 2**64 - 1, np.uint64), 4: np.full((1, spelling.WORDS), 2**64 - 1, np.uint64)}
    seen = set()
    for row, place, letter, numbers in spelling._positives(words, [ord("m"), 0xFF], full):
        for i, p, c, x in zip(row, place, letter, numbers, strict=True):
            w = words[i][:p] + (chr(c) if c else "") + words[i][p + 1 :]
            assert spelling.word_numbers([w])[0] == x
            seen.add(w)
    assert {"helo", "mello", "aabb", "abba", "aaba", "hellÿ"} <= seen and "hellm" not in seen


def test_filters_hold_every_word_and_few_others(spark, sf_dir):
    words = repeated_lines.materialise(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    filters = spelling.filters_of(words)
    own = [r.word for r in words.collect()]
    for n in {len(w) for w in own}:
        of_length = [w for w in own if len(w) == n]
        assert len(spelling._held(filters, n, spelling.word_numbers(of_length))) == len(of_length)
    others = spelling.word_numbers([f"xq{i:05d}" for i in range(20_000)])
    assert len(spelling._held(filters, 7, others)) < 1_000
    assert near_words(words).count() > 0


def test_roots_of_chains(spark):
    forms = spark.createDataFrame([(f"w{k:02d}", f"w{k + 1:02d}") for k in range(20)] + [("x", "w00")], "word string, form string")
    assert {r.root for r in roots_of(forms).collect()} == {"w20"} and roots_of(forms).count() == 21


def brute_lines(rows, least=10, min_docs=2):
    key = lambda x: x.strip("\t\n\x0b\x0c\r ").translate(LOWER)
    holders: dict[str, set] = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add((d is None, d or 0))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(h := holders.get(key(x), set())) < min_docs or min(h) == (d is None, d or 0)]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


LINES = [
    (1, None),
    (2, ""),
    (3, "A line of ten\n a LINE of ten\x0b\nshort\n\n"),
    (4, "a line of ten\nshort\nown line of four\n"),
    (4, "a line of ten\nshort\nown line of four\n"),
    (4, "another text of four\na line of ten"),
    (None, "a line of ten\nonly nameless rows"),
    (None, "only nameless rows\nÄrger mit Umlauten\närger mit Umlauten\n"),
    (7, "Ärger mit Umlauten\r\na line of ten \n123456789\n1234567890"),
    (8, "123456789\n1234567890\n" + "\n" * 4_000 + "x" * 100_000),
    (9, "x" * 100_000 + "\n" + "a line of ten\n" * 5_000 + "end"),
]


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
@pytest.mark.parametrize("min_docs", [2, 3])
def test_lines(spark, broadcast_rows, min_docs):
    got = drop_shared_lines(documents(spark, LINES), min_docs=min_docs, broadcast_rows=broadcast_rows)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted_rows(got) == brute_lines(LINES, min_docs=min_docs)
    assert drop_shared_lines(documents(spark, []), broadcast_rows=broadcast_rows).collect() == []


def test_lines_of_a_third_of_all_rows(spark):
    rows = [(k, f"the very same line\nrow {k} of many rows\nthe very same line") for k in range(300)]
    got = drop_shared_lines(documents(spark, rows), broadcast_rows=0).collect()
    assert sorted(r.n_dropped for r in got) == [0] + [2] * 299


def brute_trie(rows):
    own: dict[int, list] = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    head = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    base = lambda c: c - (abs(c) % 5) * (1 if c > 0 else -1)
    built = {c: own.get(base(c), [])[: head[c]] + v[head[c] :] for c, v in own.items()}
    members: dict[tuple, list[int]] = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    below: dict[tuple, list[tuple]] = {p: [] for p in members}
    for p in members:
        if p:
            below[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in below[p]) or 1
        saved[p] = sum(saved[q] for q in below[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def trie_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def test_op13(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(QUERIES["op13_prefix_trie"](spark, sf_dir)) == brute_trie(rows)


def test_trie_edges(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c % 3}") for c in range(60) for t in range(c % 14)]
    rows += [(100, None, None, None), (100, 3, "user", "b"), (100, 3, "user", "a"), (100, 3, "user", "a"), (None, 0, "user", "lost")]
    rows += [(c, t, "user", "x" * 5_000) for c in (200, 203, 1_000_000_007, 2**40) for t in range(40)]
    rows += [(c, 0, "ro", "le") for c in (301, 302)] + [(c, 0, "r", "ole") for c in (306, 307)]
    rows += [(c, t, "user", "the same") for c in range(1_000, 1_400) for t in range(3)]  # ends in several blocks of ids
    rows += [(5_000, t, "user", "long") for t in range(1_500)]
    want = brute_trie(rows)
    assert trie_rows(trie(turns(spark, rows))) == want
    assert trie(turns(spark, [])).collect() == []


def test_trie_is_made_again_after_a_collision(spark, monkeypatch):
    rows = [(c, t, "user", f"turn {t ^ c % 2}") for c in range(20) for t in range(12)]  # to base 1, order doesn't count
    own, tried = prefix_trie._bases, []
    monkeypatch.setattr(prefix_trie, "_bases", lambda seed: tried.append(seed) or ([1] * prefix_trie.LANES if len(tried) == 1 else own(seed)))
    assert trie_rows(trie(turns(spark, rows))) == brute_trie(rows) and len(tried) == 2
