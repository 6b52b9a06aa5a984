"""Goldens of the column functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import html as H
from pagewright.functions import params as PR
from pagewright.functions import text as T
from pagewright.sources.records import query_params


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(
    "before,after,sep",
    [("中", "文", ""), ("中", "a", " "), ("a", "中", " "), ("pre-", "fix", ""), ("a", ", b", ""), ("a", "(b", ""), ("a", "$b", " "), ("a", "", " "), ("", "b", " "), ("a", "—b", ""), ("한", "あ", ""), ("a", "€", " ")],
)
def test_separators_in_columns_and_in_python(spark, before, after, sep):
    assert one(spark, s=T.text_separator(F.lit(before), F.lit(after))).s == sep == T.separator_of(before, after)


def test_punctuation_edges(spark):
    edges = [(a - 1, a, b, b + 1) for a, b in T.PUNCT_RANGES]
    rows = spark.createDataFrame([(x,) for e in edges for x in e], "cp int").select("cp", T.is_punct(F.col("cp")).alias("p")).collect()
    inside = {c for a, b in T.PUNCT_RANGES for c in range(a, b + 1)}
    assert all(r.p == (r.cp in inside) for r in rows)


def test_text_measures(spark):
    r = one(spark, n=T.char_count(F.lit("ab😀")), o=T.byte_offset(F.lit("aé😀"), 2), end=T.byte_offset(F.lit("aé"), 9), w=T.weighted_char_ratio(F.lit("中a"), 1), e=T.weighted_char_ratio(F.lit(""), 0), low=T.ascii_lower(F.lit("ÄBC")))
    assert (r.n, r.o, r.end, r.e, r.low) == (3, 3, 3, 0.0, "Äbc") and abs(r.w - 1 / 1.55) < 1e-9


def test_geometry(spark):
    box = F.array(*[F.lit(v) for v in (0, 0, 100, 10, 98, 30, -2, 20)])
    r = one(spark, a=G.aabb(box).left, b=G.aabb(box).bottom, angle=F.degrees(G.block_angle(box)), o=G.order_corners(F.array(*[F.lit(v) for v in (9, 9, 0, 0, 9, 0, 0, 9)])), u=G.unclip_distance(F.array(*[F.lit(v) for v in (0, 0, 10, 0, 10, 10, 0, 10)]), 2.0))
    assert (r.a, r.b) == (-2, 30) and abs(r.angle - 5.7106) < 1e-3 and r.o == [0, 0, 9, 0, 9, 9, 0, 9] and r.u == 5.0
    a, b = G.Rect(*map(F.lit, (0, 0, 10, 10))), G.Rect(*map(F.lit, (5, 0, 15, 10)))
    r = one(spark, ab=G.iou(a, b), ba=G.iou(b, a), aa=G.iou(a, a), far=G.iou(a, G.Rect(*map(F.lit, (20, 20, 30, 30)))), d=G.corner_distance(a, b), al=G.alignment(F.lit(0), F.lit(10), F.lit(14), F.lit(18)))
    assert r.ab == r.ba and abs(r.ab - 1 / 3) < 1e-6 and r.aa > 0.999 and r.far == 0 and r.d == 15 and r.al == -0.4


def test_snap(spark):
    r = one(spark, flat=F.array(*G.snap_line(*map(F.lit, (100, 4, 0, 1)))), up=F.array(*G.snap_line(*map(F.lit, (3, 90, 0, 0)))), skew=F.array(*G.snap_line(*map(F.lit, (0, 0, 50, 50)))))
    assert r.flat == [0, 3, 100, 3] and r.up == [2, 0, 2, 90] and r.skew == [0, 0, 50, 50]


def test_places(spark):
    box = F.array(*[F.lit(v) for v in (0, 0, 11, 0, 11, 7, 0, 7)])
    r = one(spark, c=F.array(*G.anchor_point(box, F.lit("中心"))), br=F.array(*G.anchor_point(box, F.lit("右下"))), x=F.array(*G.anchor_point(box, F.lit("nowhere"))))
    assert r.c == [5, 3] == r.x and r.br == [11, 7]


def test_regions_and_pages(spark):
    got = [one(spark, g=PR.parse_region(F.lit(t))).g for t in ("1, 2,3,4", "1,2,3", "-1,2,3,4", "1,2,0,4", "a,b,c,d", None)]
    assert [g.code for g in got] == [0, 5, 5, 5, 5, 5] and (got[0].x, got[0].h) == (1, 4) and got[1].x is None
    cases = {"all": [0, 1, 2, 3, 4], "": [0, 1, 2, 3, 4], "1，3-4": [0, 2, 3], "5-2,2": [1], "2-100": [1, 2, 3, 4], "1,all": [0], "0,9,x": [], "3,1,3": [0, 2]}
    for spec, pages in cases.items():
        assert one(spark, p=PR.page_numbers(F.lit(spec), F.lit(5))).p == pages, spec
    assert one(spark, p=PR.page_numbers(F.lit("all"), F.lit(0))).p == []


def test_html(spark):
    texts = {"a&nbsp;b": "a b", "&amp;lt;": "&lt;", "&lt;&gt;&quot;&apos;&#39;": "<>\"''", "&#65;&#x42;&#200;&#0;": "AB", "&copy; & x": "&copy; & x"}
    for text, want in texts.items():
        assert one(spark, t=H.html_unescape(F.lit(text))).t == want
    tag = F.lit("<td ColSpan=3 rowspan=\"2\" STYLE='width : 40px;height:12.5%'>")
    style = H.html_attr(tag, "style")
    r = one(spark, c=H.int_attr(tag, "colspan", 1), r=H.int_attr(tag, "rowspan", 1), n=H.int_attr(tag, "class", 7), w=H.style_px(style, "width"), h=H.style_pct(style, "height"), no=H.style_pct(style, "width"))
    assert (r.c, r.r, r.n, r.w, r.h, r.no) == (3, 2, 7, 40, 12.5, 0.0)
    doc = one(spark, d=H.full_document(F.lit("<table><tbody></tbody></table>")), k=H.full_document(F.lit(" <!DOCTYPE html><p>")))
    assert doc.d.startswith("<!DOCTYPE html>") and "tbody" not in doc.d and doc.k == " <!DOCTYPE html><p>"


def test_query_params(spark):
    assert one(spark, q=query_params(F.lit("http://h/p?a=1&b&a=2=3&&c=#x=9"))).q == {"b": "", "a": "2=3", "c": ""}
    assert one(spark, q=query_params(F.lit("http://h/p"))).q == {}


def test_defaults(spark):
    r = one(spark, **PR.default_params(padding=F.lit(0), box_thresh=F.lit(0.5), unclip_ratio=F.lit(None).cast("double")))
    assert (r.padding, r.max_side_len, r.box_score_thresh, r.box_thresh, r.unclip_ratio) == (50, 1024, 0.6, 0.5, 2.0)
    r = one(spark, a=PR.char_length_choice(F.lit(10.0), F.lit(15.0)), b=PR.char_length_choice(F.lit(10.0), F.lit(14.9)))
    assert (r.a, r.b) == (15.0, 10.0)
