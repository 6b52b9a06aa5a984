"""HTML in columns: entities, attributes, styles, tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The named entities; `&amp;` comes last so that what it makes isn't read again.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"))


def html_unescape(text: Column) -> Column:
    """Named entities as characters; numeric ones as ASCII characters, or nothing from 128 on; others stay."""
    text = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(&#[xX]?[0-9A-Fa-f]*;)"), F.lit(1)))

    def put(t: Column, entity: Column) -> Column:
        digits = F.regexp_extract(entity, r"&#[xX]?([0-9A-Fa-f]*);", 1)
        is_hex = entity.rlike("^&#[xX]")
        decimal = F.regexp_extract(digits, r"^(\d*)", 1)
        code = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(decimal).try_cast("int")
        sign = F.when((code > 0) & (code < 128), F.chr(code)).otherwise("")
        return F.replace(t, entity, sign)

    return F.replace(F.aggregate(numbers, text, put), F.lit("&amp;"), F.lit("&"))


def html_attr(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted or not, name in either case; empty if it isn't there."""
    value = F.regexp_extract(tag, rf"""(?is){name}[ =]*('[^']*|"[^"]*|[^\s'">][^\s>]*)""", 1)
    return F.regexp_replace(value, "^['\"]", "")


def int_attr(tag: Column, name: str, default: int) -> Column:
    """The leading digits of an attribute, or the default."""
    return F.coalesce(F.regexp_extract(html_attr(tag, name), r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(default))


def style_px(style: Column, prop: str) -> Column:
    """The number in `prop: N...`, 0 if there is none."""
    return F.coalesce(F.regexp_extract(style, rf"(?i){prop} *: *(\d+)", 1).try_cast("int"), F.lit(0))


def style_pct(style: Column, prop: str) -> Column:
    """The number in `prop: N%`; 0 if there is none, or the first number of that property has no percent sign."""
    number = F.regexp_extract(style, rf"(?i){prop} *: *([0-9.]+)(%?)", 1)
    percent = F.regexp_extract(style, rf"(?i){prop} *: *([0-9.]+)(%?)", 2)
    return F.when(percent == "%", F.coalesce(number.try_cast("double"), F.lit(0.0))).otherwise(0.0)


def first_table(html: Column) -> Column:
    """From the first `<table` through the next `</table>`; empty if there is none."""
    return F.regexp_extract(html, r"(?is)(<table.*?</table>)", 1)


def tag_pairs(html: Column, tag: str) -> Column:
    """array<struct<tag, body>>: each `<tag ...>` with what stands before the next `</tag>` or the end."""
    whole = F.regexp_extract_all(html, F.lit(rf"(?is)(<{tag}[^>]*>.*?(?:</{tag}>|\z))"), F.lit(1))
    return F.transform(
        whole,
        lambda w: F.struct(
            F.regexp_extract(w, r"(?s)^(<[^>]*>)", 1).alias("tag"),
            F.regexp_extract(w, rf"(?is)^<[^>]*>(.*?)(?:</{tag}>)?\z", 1).alias("body"),
        ),
    )


def full_document(html: Column) -> Column:
    """A fragment inside a document with a head and a border style; a document (starting with a doctype or html tag) as it is."""
    head = '<!DOCTYPE html>\n<html>\n<head><meta charset="UTF-8"><style>table { border-collapse:collapse; } td { border:1px solid black; padding:8px; }</style></head>\n<body>\n'
    clean = F.regexp_replace(html, "</?tbody>", "")
    whole = F.lower(F.ltrim(html)).rlike("^(<!doctype|<html)")
    return F.when(whole, clean).otherwise(F.concat(F.lit(head), clean, F.lit("\n</body>\n</html>")))
