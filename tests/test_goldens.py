"""Golden cases of kernels, regions, decoding and text functions."""

import struct
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import decode, raster, regions
from pagemill.sources import readers


def page(shape, spots):
    g = np.zeros(shape, np.uint8)
    for y, x in spots:
        g[y, x] = 255
    return g


def boxes(g):
    return [(c["x"], c["y"], c["w"], c["h"]) for c in raster.components(g)]


def test_components():
    assert boxes(page((10, 10), [])) == []
    assert boxes(page((5, 5), [(2, 2)])) == [(2, 2, 1, 1)]
    two = np.zeros(50, np.uint8)
    two[[0, 1, 10, 11, 37, 38, 39]] = 255
    assert len(boxes(two.reshape(5, 10))) == 2
    assert boxes(page((5, 5), [(0, x) for x in range(4)] + [(y, 0) for y in range(4)])) == [(0, 0, 4, 4)]


def test_blank_and_black_pages():
    assert raster.detect(np.full((100, 100, 3), 255, np.uint8)) == []
    assert raster.detect(np.zeros((200, 200, 3), np.uint8)) == []
    assert raster.detect(np.zeros((0, 0, 3), np.uint8)) == []


def test_dilation():
    g = np.zeros((1, 100), np.uint8)
    g[0, [42, 47]] = 255
    out = raster.dilate_h(g, 20)[0]
    assert out[32:57].all() or out[33:57].all()
    assert not out[31] and not out[58]
    v = raster.dilate_v(page((5, 5), [(2, 2)]), 3).ravel()
    assert v[[7, 12, 17]].all() and not v[[2, 22]].any()


def test_blur_and_threshold():
    b = raster.blur(page((11, 11), [(5, 5)]))
    assert 0 < b[5, 5] < 255 and b[5, 4] > 0
    g = np.full((10, 50), 200, np.uint8)
    g[5, 10:40] = 20
    t = raster.adaptive_threshold(g)
    assert t[5, 20] == 255 and t[0, 0] == 0


def test_split_tall():
    ink = np.zeros((80, 100), np.uint8)
    ink[10:30, 10:90] = ink[50:70, 10:90] = 255
    c = lambda x, y, w, h: {"x": x, "y": y, "w": w, "h": h, "n": 0, "ang": 0.0}
    out = raster.split_tall([c(10, 10, 80, 60), c(10, 75, 40, 20), c(50, 75, 40, 20)], ink)
    assert len(out) >= 4 and max(k["h"] for k in out) <= 36


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=24, max_size=24), st.integers(1, 9))
def test_dilation_is_extensive(values, k):
    g = np.array(values, np.uint8).reshape(4, 6)
    assert (raster.dilate_h(g, k) >= g).all()


def test_margins(spark):
    rows = [(0, 20, 200, 60, 30), (1, 50, 200, 200, 30), (2, 920, 200, 60, 30), (3, 200, 70, 100, 40), (4, 200, 200, 300, 30)]
    d = spark.createDataFrame(rows, "seq long, x long, y long, w long, h long")
    kept = d.filter(regions.margin_ok(100, 100, 100, 100, 1000, 1000)).select("seq").collect()
    assert sorted(r[0] for r in kept) == [1, 4]


def test_rows_columns_clusters(spark):
    rows = [(1, 0, 100, 100, 200, 30), (1, 1, 400, 105, 150, 30), (1, 2, 100, 160, 200, 30), (1, 3, 400, 162, 150, 30), (1, 4, 100, 400, 200, 30)]
    d = spark.createDataFrame(rows, "page long, seq long, x long, y long, w long, h long")
    out = regions.clusters(regions.columns(regions.assign_rows(d))).orderBy("seq").collect()
    assert [r["row"] for r in out] == [0, 0, 1, 1, 2]
    assert [r["col"] for r in out] == [0, 1, 0, 1, 0]
    assert [r["cluster"] for r in out] == [0, 0, 0, 0, 1]


def test_ctc(spark):
    for ids, tokens in (([0, 0, 1, 1, 0, 2], [0, 1]), ([1, 0, 1], [0, 0]), ([0, 0, 0, 0], [])):
        d = spark.createDataFrame([([(i, 0.5) for i in ids],)], "steps array<struct<idx:bigint,p:double>>")
        r = decode.decoded(d).first()
        assert list(r["tokens"]) == tokens
        assert (r["confidence"] > 0) == bool(tokens)


def test_softmax(spark):
    r = spark.range(1).select(decode.softmax_argmax(F.array(*[F.lit(float(x)) for x in (1, 3, 2)])).alias("a"), decode.softmax_argmax(F.array().cast("array<double>")).alias("b")).first()
    assert r["a"]["idx"] == 1 and r["a"]["p"] > 0.5 and tuple(r["b"]) == (0, 0.0)


def test_text(spark):
    one = lambda col: spark.range(1).select(col.alias("v")).first()[0]
    assert one(T.digit_spacing(F.lit("1 2 3"))) == "12 3"
    assert one(T.cer(F.lit(""), F.lit(""))) == 0 and one(T.cer(F.lit(""), F.lit("a"))) == 1
    assert one(T.cer(F.lit("små"), F.lit("sma"))) == 1 / 3
    assert one(T.word_edits(F.lit("a b c d"), F.lit("a x c"))) == 2
    assert one(T.fold_diacritics(F.lit("åäö ÆØ"))) == "aao AO"
    assert one(T.has_nordic(F.lit("på"))) and not one(T.has_nordic(F.lit("aZ")))
    assert one(T.leading_garbage(F.lit("xxhello world"), F.lit("hello world")))


def tiff(pages):
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for width, height, data, how in pages:
        at = len(out)
        body = zlib.compress(data) if how == 8 else data
        out += body
        out[link : link + 4] = struct.pack("<I", len(out))
        tags = [(256, width), (257, height), (258, 8), (259, how), (262, 1), (273, at), (277, 1), (278, height), (279, len(body))]
        out += struct.pack("<H", len(tags))
        for t, v in tags:
            out += struct.pack("<HHII", t, 4, 1, v)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def test_tiff_pages(spark):
    data = tiff([(2, 2, bytes([1, 2, 3, 4]), 1), (3, 1, bytes([9, 8, 7]), 8)])
    rows = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"%PDF-1.4")), ("c", bytearray(b"II*\0"))], "path string, content binary")
    out = {(r["path"], r["source_page_index"]): r for r in readers.decode_tiffs(rows).collect()}
    assert bytes(out["a", 0]["data"]) == bytes([1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4])
    assert out["a", 1]["width"] == 3 and out["b", None]["error_kind"] == "pdf" and out["c", None]["error_kind"] == "decode"
    some = readers.decode_tiffs(rows.filter("path = 'a'"), [1]).collect()
    assert [(r["source_page_index"], r["page_index"]) for r in some] == [(1, 0)]
