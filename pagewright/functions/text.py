"""Text columns: code points, character classes, separators between pieces of text, widths of substrings."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code point ranges of Chinese, Japanese and Korean letters and signs.
CJK_RANGES = ((0x4E00, 0x9FFF), (0x3040, 0x30FF), (0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF), (0x3000, 0x303F), (0xFE30, 0xFE4F), (0xFF00, 0xFFEF))

#: The ASCII punctuation, and the other single code points and ranges that count as punctuation.
ASCII_PUNCT = "!\"#%&'()*,-./:;?@[\\]_{}"
PUNCT_RANGES = (
    (0x00A1, 0x00A1), (0x00A7, 0x00A7), (0x00AB, 0x00AB), (0x00B6, 0x00B7), (0x00BB, 0x00BB), (0x00BF, 0x00BF),
    (0x2010, 0x2027), (0x2030, 0x205E), (0x2080, 0x208E), (0x2768, 0x2775), (0x27C5, 0x27C6), (0x27E6, 0x27EF),
    (0x2983, 0x2998), (0x29D8, 0x29DB), (0x29FC, 0x29FD), (0x2CF9, 0x2CFC), (0x2CFE, 0x2CFF), (0x2E00, 0x2E01),
    (0x2E06, 0x2E08), (0x2E0B, 0x2E0B), (0x2E1C, 0x2E1D), (0x2E20, 0x2E29), (0x2E2E, 0x2E2E), (0x2E3A, 0x2E3B),
    (0x2E9B, 0x2E9C), (0xFE10, 0xFE19), (0xFE41, 0xFE44), (0xFE47, 0xFE48), (0xFE56, 0xFE5A), (0xFE63, 0xFE63),
    (0xFE68, 0xFE68), (0xFE6A, 0xFE6B), (0xFF61, 0xFF61),
)

#: Widths of characters, as classes of a regular expression and the width of one of them.
WIDE_CLASS = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}\x{AC00}-\x{D7AF}\x{3040}-\x{30FF}]"
NARROW_CLASS = r"[\x20-\x7E]"
WIDE, NARROW, OTHER = 1.0, 0.55, 0.75


def _in_ranges(cp: Column, ranges: tuple[tuple[int, int], ...]) -> Column:
    return reduce(or_, [cp.between(a, b) if a != b else cp == a for a, b in ranges])


def first_cp(text: Column) -> Column:
    """The first code point; 0 for an empty or null text."""
    return F.coalesce(F.ascii(text), F.lit(0))


def last_cp(text: Column) -> Column:
    """The last code point; 0 for an empty or null text."""
    return F.coalesce(F.ascii(F.right(text, F.lit(1))), F.lit(0))


def is_cjk(cp: Column) -> Column:
    return _in_ranges(cp, CJK_RANGES)


def is_punct(cp: Column) -> Column:
    return F.when(cp < 0x80, cp.isin([ord(c) for c in ASCII_PUNCT])).otherwise(_in_ranges(cp, PUNCT_RANGES))


def word_separator(before: Column, after: Column) -> Column:
    """What stands between two pieces whose last and first code points are given: nothing or a space."""
    glued = (is_cjk(before) & is_cjk(after)) | (before == ord("-")) | is_punct(after)
    return F.when(glued, "").otherwise(" ")


def text_separator(before: Column, after: Column) -> Column:
    """`word_separator` of two texts."""
    return word_separator(last_cp(before), first_cp(after))


def char_count(text: Column) -> Column:
    return F.char_length(text)


def byte_offset(text: Column, index: Column | int) -> Column:
    """The UTF-8 byte offset of character `index` (from 0); the byte length at or past the end."""
    index = index if isinstance(index, Column) else F.lit(index)
    return F.octet_length(F.left(text, index))


def weight(text: Column) -> Column:
    """The estimated width of a text."""
    wide = F.char_length(text) - F.char_length(F.regexp_replace(text, WIDE_CLASS, ""))
    narrow = F.char_length(text) - F.char_length(F.regexp_replace(text, NARROW_CLASS, ""))
    return wide * WIDE + narrow * NARROW + (F.char_length(text) - wide - narrow) * OTHER


def weighted_char_ratio(text: Column, index: Column | int) -> Column:
    """The width of the first `index` characters as a share of the whole; 0 for an empty text."""
    index = index if isinstance(index, Column) else F.lit(index)
    whole = weight(text)
    return F.when(whole > 0, weight(F.left(text, index)) / whole).otherwise(0.0)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else, as the search compares texts."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# The same rules for one pair of strings, for the page functions that work on a page's own list.


def separator_of(before: str, after: str) -> str:
    """`text_separator` for two Python strings."""
    a, b = (ord(before[-1]) if before else 0), (ord(after[0]) if after else 0)

    def within(cp: int, ranges: tuple[tuple[int, int], ...]) -> bool:
        return any(x <= cp <= y for x, y in ranges)

    punct = chr(b) in ASCII_PUNCT if 0 < b < 0x80 else within(b, PUNCT_RANGES)
    return "" if (within(a, CJK_RANGES) and within(b, CJK_RANGES)) or a == ord("-") or punct else " "
