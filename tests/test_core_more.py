"""Operators that have no SQL, or whose SQL sees small inputs only."""

import base64
import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.operators import curate, decode, evaluate, raster, regions
from pagemill.plans import process as P
from pagemill.sources import readers, sinks


def tiff(pages):
    """Uncompressed 8-bit gray pages as a little-endian TIFF."""
    out, at = bytearray(b"II*\0\0\0\0\0"), 4
    for g in pages:
        h, w = g.shape
        data = len(out)
        out += g.tobytes()
        tags = [(256, w), (257, h), (258, 8), (259, 1), (262, 1), (273, data), (277, 1), (278, h), (279, h * w)]
        out[at : at + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags)
        at = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def test_rotate():
    rng = np.random.default_rng(1)
    g = rng.integers(0, 256, (9, 13)).astype(np.uint8)
    assert (raster.rotate(g, 0) == g).all()
    assert (raster.rotate(g, 90)[0] != 255).any()
    # One pixel by the rule: neighbours outside the page count as white.
    t, (h, w) = np.deg2rad(7), g.shape
    turned = raster.rotate(g, 7)
    at = lambda y, x: float(g[y, x]) if 0 <= y < h and 0 <= x < w else 255.0
    for y in range(h):
        for x in range(w):
            sx, sy = np.cos(t) * (x - w / 2) + np.sin(t) * (y - h / 2) + w / 2, -np.sin(t) * (x - w / 2) + np.cos(t) * (y - h / 2) + h / 2
            x0, y0 = int(np.floor(sx)), int(np.floor(sy))
            fx, fy = sx - x0, sy - y0
            want = at(y0, x0) * (1 - fx) * (1 - fy) + at(y0, x0 + 1) * fx * (1 - fy) + at(y0 + 1, x0) * (1 - fx) * fy + at(y0 + 1, x0 + 1) * fx * fy
            assert abs(int(turned[y, x]) - want) <= 1


def test_skew_is_found():
    g = np.full((120, 200), 255, np.uint8)
    for y in range(10, 110, 12):
        g[y : y + 3, 10:190] = 0
    assert abs(raster.skew(raster.rotate(g, 2.0)) + 2.0) < 0.35
    assert (raster.deskew(g) == g).all()


def test_windows_added_up():
    rng = np.random.default_rng(2)
    g = rng.integers(0, 256, (7, 9)).astype(np.uint8)
    h, w = g.shape
    for y in range(h):
        for x in range(w):
            num = den = 0.0
            for dy in range(-3, 4):
                for dx in range(-3, 4):
                    if 0 <= y + dy < h and 0 <= x + dx < w:
                        v = float(g[y + dy, x + dx])
                        k = np.exp(-(dy * dy + dx * dx) / 18) * np.exp(-((v - g[y, x]) ** 2) / 1800)
                        num, den = num + k * v, den + k
            assert abs(int(raster.bilateral(g)[y, x]) - num / den) <= 1


def columns(*spans, w=210, h=40, rows=(10, 30)):
    box = np.zeros((h, w), bool)
    for a, b in spans:
        box[rows[0] : rows[1], a:b] = True
    return box


def test_trimmed_span():
    assert raster.trimmed_span(columns((0, 10), (60, 94), (200, 209))) == (0, 94)
    # The right end is measured from the left cut on: once a fragment of another line is cut there, the body is too short.
    left = columns((60, 94), (200, 209))
    left[0:3, 0:10] = True
    assert raster.trimmed_span(left) == (60, 209)
    # Of two widest gaps the last counts.
    assert raster.trimmed_span(columns((0, 10), (40, 170), (200, 209))) is None
    assert raster.trimmed_span(columns((0, 10), (40, 200))) == (40, 200)
    assert raster.trimmed_span(columns((0, 130), (160, 170))) == (0, 130)
    assert raster.trimmed_span(columns((0, 10), (40, 55), w=59)) is None
    assert raster.words_of(np.array([1, 1, 0, 0, 0, 1, 0, 0, 0, 0, 1], bool)) == [[0, 6], [10, 11]]


def test_split_cuts():
    rows = np.full(60, 50)
    rows[28:32] = 3
    assert raster.split_cuts(rows) == [30]
    assert raster.split_cuts(np.zeros(60, int)) == []
    rows[:5] = 0
    assert raster.split_cuts(rows) == [30]


def test_tall_components_are_cut_by_the_mask():
    mask, ink = np.zeros((120, 100), np.uint8), np.zeros((120, 100), np.uint8)
    mask[10:70, 10:90] = 255
    mask[38:42, 20:90] = 0
    c = lambda x, y, w, h: {"x": x, "y": y, "w": w, "h": h, "n": 0, "ang": 0.0}
    comps = [c(10, 10, 80, 60), c(10, 75, 40, 20), c(50, 75, 40, 20)]
    assert [k["h"] for k in raster.split_tall(comps, mask)] == [30, 30, 20, 20]
    assert raster.split_tall(comps, ink) == comps


def test_fit_width():
    line = np.full((16, 40, 3), 60, np.uint8)
    out = raster.fit_width(line)
    assert out.shape == (3, 32, 384) and np.allclose(out[:, :, :80], 60 / 127.5 - 1) and np.allclose(out[:, :, 80:], 128 / 127.5 - 1)
    assert raster.fit_width(np.zeros((8, 900, 3), np.uint8)).max() == -1
    assert (raster.fit_width(np.zeros((0, 5, 3), np.uint8)) > 0).all()
    ramp = np.repeat(np.arange(0, 200, 2, dtype=np.uint8)[None, :, None], 32, 0).repeat(3, 2)
    assert (np.diff(raster.resize_cubic(ramp, 50, 32)[0, 2:-2, 0].astype(int)) == 4).all()


def test_numbers_are_a_permutation(spark):
    n = 1_000_000
    d = spark.range(n).select(F.xxhash64("id").alias("k"), F.col("id").cast("string").alias("more"))
    got = sinks.numbered(d, ["k"]).agg(F.count("*"), F.countDistinct("n"), F.min("n"), F.max("n")).first()
    assert tuple(got) == (n, n, 1, n)
    small = sinks.numbered(spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "k int, v string"), ["k"]).orderBy("n").collect()
    assert [(r["k"], r["image_key"]) for r in small] == [(1, "image-000000001"), (2, "image-000000002"), (3, "image-000000003")]


def test_matches(spark):
    rng = random.Random(3)
    edges = sorted({(p, a, b): (p, a, b, float(rng.randrange(6))) for p in range(4) for _ in range(60) for a in [rng.randrange(9)] for b in [rng.randrange(9)]}.values())
    order = [(p, a, rng.randrange(4)) for p in range(4) for a in range(9)]

    def taken(rows):
        used, out = set(), []
        for p, a, b, d in rows:
            if not {(p, "l", a), (p, "r", b)} & used:
                used |= {(p, "l", a), (p, "r", b)}
                out.append((p, a, b, d))
        return sorted(out)

    e = spark.createDataFrame(edges, "page long, lseq long, rseq long, dist double")
    o = spark.createDataFrame(order, "page long, lseq long, ord long")
    assert sorted(map(tuple, regions.greedy_match(e).collect())) == taken(sorted(edges, key=lambda x: (x[3], x[1], x[2])))
    place = {(p, a): k for p, a, k in order}
    assert sorted(map(tuple, regions.sequential_match(e, o).collect())) == taken(sorted(edges, key=lambda x: (place[x[0], x[1]], x[1], x[3], x[2])))
    assert regions.greedy_match(e.limit(0)).count() == 0


def test_overlaps(spark):
    rng = random.Random(4)
    box = lambda k: [(p, i, rng.randrange(900), rng.randrange(300), rng.randrange(0, k), rng.randrange(0, k)) for p in range(3) for i in range(25)]
    left, right = box(400), box(90)
    names = "page long, seq long, x long, y long, w long, h long"
    got = ends(regions.overlap_pairs(spark.createDataFrame(left, names), spark.createDataFrame(right, names)).collect())
    meet = lambda a, b, k: min(a[k] + a[k + 2], b[k] + b[k + 2]) > max(a[k], b[k])
    assert got == sorted((a[0], a[1], b[1]) for a in left for b in right if a[0] == b[0] and meet(a, b, 2) and meet(a, b, 3))


def ends(rows):
    return sorted((r["page"], r["lseq"], r["rseq"]) for r in rows)


def test_near_width_batches(spark):
    rows = [(1, i, w) for i, w in enumerate([10, 40, 12, 44, 20, 100, 100])] + [(2, i, 8) for i in range(5)]
    d = spark.createDataFrame(rows, "page long, seq long, line_w long")
    got = {(r["page"], r["seq"]): r["chunk"] for r in regions.near_width_batches(d, 10, 3).collect()}
    assert [got[1, k] for k in range(7)] == [0, 1, 0, 1, 0, 2, 2] and [got[2, k] for k in range(5)] == [0, 0, 0, 1, 1]
    assert {r["chunk"] for r in regions.equal_width_batches(d, 3).filter("line_w = 8").collect()} == {0, 1}


def test_line_trims(spark):
    rows = [("abcdefgh  x", [0, 2, 4, 6, 8, 10, 12, 14, 16, 18, 60], 0.5), ("  ab ", [0, 1, 2, 3, 4], 0.9), ("   ", [0, 1, 2], 0.7), ("", [], 0.0), ("word", [0, 2, 4, 6], 0.8)]
    d = spark.createDataFrame([(i, t, p, [0.25 + 0.05 * k for k in range(len(p))], c) for i, (t, p, c) in enumerate(rows)], "i int, text string, pos array<bigint>, ps array<double>, confidence double")
    got = {r["i"]: r for r in decode.strip_spaces(decode.trim_trailing(d)).collect()}
    assert [got[i]["text"] for i in range(5)] == ["abcdefgh", "ab", "", "", "word"]
    assert [len(got[i]["pos"]) for i in range(5)] == [8, 2, 0, 0, 4] == [len(got[i]["ps"]) for i in range(5)]
    assert np.isclose(got[0]["confidence"], np.exp(np.mean(np.log([0.25 + 0.05 * k for k in range(8)])))) and got[2]["confidence"] == 0 and got[4]["confidence"] == 0.8
    assert got[1]["pos"] == [2, 3]
    assert d.select(decode.text_of(F.array(F.lit(0), F.lit(2), F.lit(9)), "xyz")).first()[0] == "xz�"


def test_joins_that_check(spark):
    a = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "z")], "page int, k int, a string")
    b = spark.createDataFrame([(1, 0, "x"), (1, 1, "q"), (3, 0, "z")], "page int, k int, b string")
    assert evaluate.zipped(a, b).count() == 2
    with pytest.raises(Exception, match="line counts differ on page 1"):
        evaluate.zipped(a, b.limit(1)).collect()
    assert evaluate.required(a, spark.createDataFrame([(1, "en"), (2, "de")], "page int, lang string"), "page").count() == 3
    with pytest.raises(Exception, match="no such page: 2"):
        evaluate.required(a, spark.createDataFrame([(1, "en")], "page int, lang string"), "page").collect()


def test_nordic_cer(spark):
    d = spark.createDataFrame([(1, 0, "Åre är kul", "Are är kul"), (1, 1, "plain", "plane"), (1, 2, "ö", "")], "page int, seq int, ref string, hyp string")
    assert tuple(evaluate.nordic_cer(d).first())[:2] == (2, 6)
    assert evaluate.nordic_cer(d.limit(0)).first()["cer"] is None


def test_confusion_rates(spark):
    d = spark.createDataFrame([(1, 0, "aåä öö", "aaä oö")], "page int, seq int, ref string, hyp string")
    got = {r["pair"]: (r["total"], r["confused"]) for r in evaluate.confusion_rates(d).collect()}
    assert got["aå"] == (2, 1) and got["oö"] == (2, 1) and got["ÖØ"] == (0, 0) and got["aä"] == (2, 0)


def test_multipart(spark):
    def body(*fields):
        return b"".join(b'--XyZ\r\nContent-Disposition: form-data; name="' + k + b'"\r\n\r\n' + v + b"\r\n" for k, v in fields) + b"--XyZ--\r\n"

    kind = 'multipart/form-data; boundary="XyZ"'
    rows = [(0, kind, body((b"file", b"\x00\r\n\x01"), (b"pages", b"[0, 2]"))), (1, kind, body((b"pages", b"[1]"))), (2, kind, body((b"file", b"x"), (b"pages", b"oops"))), (3, kind, body((b"other", b"x"), (b"file", b""))), (4, "text/plain", b"x"), (5, None, None), (6, kind, body((b"file", b"x"), (b"pages", b"null")))]
    got = {r["id"]: (r["status"], None if r["content"] is None else bytes(r["content"]), r["pages"], r["error"]) for r in readers.multipart(spark.createDataFrame(rows, "id int, content_type string, body binary")).collect()}
    assert got[0] == (200, b"\x00\r\n\x01", [0, 2], None) and got[1] == (400, None, None, "missing 'file' field")
    assert [got[k][0] for k in range(7)] == [200, 400, 400, 200, 400, 400, 200] and got[2][3] == "invalid pages" and got[3][1] == b"" and got[6][2] is None


def test_files_and_results(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    for name in ("p_2.png", "p_10.png", "note.txt"):
        (tmp_path / "pages" / name).write_bytes(b"\x89PNG")
    got = readers.page_files(spark, str(tmp_path / "pages")).collect()
    assert [r["page"] for r in got] == [10, 2]
    assert {r["kind"] for r in readers.files(spark, str(tmp_path / "pages"), "*.png").collect()} == {"image"}
    old = [{"pageNumber": p, "x": 1, "y": 2, "width": 3, "height": 4, "text": t, "textConfidence": 0.5, "column": 0, "row": 0, "density": 0.1, "clusterId": 1} for p, t in ((0, "a"), (0, "b"), (1, "c"))]
    (tmp_path / "old.json").write_text(json.dumps(old))
    assert sorted((r["page"], r["seq"], r["text"], r["w"]) for r in readers.legacy_lines(spark, str(tmp_path / "old.json")).collect()) == [(0, 0, "a", 3), (0, 1, "b", 3), (1, 0, "c", 3)]
    new = {"pages": [{"page_index": 0, "text": "a", "confidence": 0.5, "lines": [{"text": "a", "confidence": 0.5, "bbox": {"x": 1, "y": 2, "width": 3, "height": 4}}]}], "timing": {"total_ms": 1.0}}
    (tmp_path / "new.json").write_text(json.dumps(new))
    (line,) = readers.result_lines(spark.read.schema(readers.RESULT).option("multiLine", "true").json(str(tmp_path / "new.json"))).collect()
    assert (line["page"], line["seq"], line["text"], line["width"]) == (0, 0, "a", 3.0)


def test_images(spark, tmp_path):
    rgb = np.arange(4 * 5 * 3, dtype=np.uint8).reshape(4, 5, 3)
    (tmp_path / "a.png").write_bytes(sinks.png(rgb))
    (r,) = readers.images(spark, str(tmp_path)).collect()
    assert (r["width"], r["height"]) == (5, 4) and bytes(r["data"]) == rgb.tobytes()


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, "two"), ("d", 0, "one"), ("e", 0, "x")], "doc string, page_index int, text string")
    timing = spark.createDataFrame([("d", 12.0, 1.0, 2.0, 3.0, 6.0)], "doc string, total_ms double, decode_ms double, preprocess_ms double, detect_ms double, recognize_ms double")
    got = {r["doc"]: json.loads(r["value"]) for r in sinks.envelope(pages, timing).collect()}
    assert [p["text"] for p in got["d"]["pages"]] == ["one", "two"] and got["d"]["timing"]["total_ms"] == 12 and "timing" not in got["e"]
    line = timing.select(F.struct("total_ms", "decode_ms", "preprocess_ms", "detect_ms", "recognize_ms").alias("timing")).select(sinks.timing_line()).first()[0]
    assert line.startswith("total: 12.0ms | decode: 1.0ms")
    pairs = spark.createDataFrame([(1, i, "abcd", "abcd" if i % 2 else "ab") for i in range(6)], "page int, seq int, ref string, hyp string")
    sinks.write_evaluation(pairs, evaluate.micro_cer(pairs), str(tmp_path / "eval"), worst=2)
    read = lambda name: spark.read.option("sep", "\t").option("header", "true").csv(f"{tmp_path}/eval/{name}")
    assert read("predictions").columns == ["true", "pred", "cer", "correct"] and read("predictions").count() == 6 and [r["cer"] for r in read("worst").collect()] == ["0.5", "0.5"]
    assert spark.read.json(f"{tmp_path}/eval/metrics").first()["edits"] == 6
    sinks.write_report(evaluate.micro_cer(pairs), pairs, str(tmp_path / "report"))
    assert spark.read.json(f"{tmp_path}/report/regions").count() == 6
    sinks.write_split(curate.ordered_split(spark.range(100).withColumnRenamed("id", "k"), "k", "1"), str(tmp_path / "split"))
    assert {r["split"]: r["n"] for r in spark.read.parquet(str(tmp_path / "split")).groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 90, "val": 5, "test": 5}
    for fmt in ("text", "json", "jsonl", "tsv"):
        sinks.write_results(pages.withColumnRenamed("page_index", "page"), fmt, str(tmp_path / fmt))
    rgb = np.arange(6 * 8 * 3, dtype=np.uint8).reshape(6, 8, 3)
    page = spark.createDataFrame([(1, 8, 6, bytearray(rgb.tobytes()))], "page long, width int, height int, data binary")
    boxes = spark.createDataFrame([(1, 0, 2, 1, 3, 2), (1, 1, 20, 1, 3, 2)], "page long, seq long, x long, y long, w long, h long")
    cut = {r["seq"]: r["png"] for r in sinks.crops(page, boxes).collect()}
    data = base64.b64decode(cut[0])
    size = struct.unpack(">II", data[16:24])
    at = data.index(b"IDAT")
    raw = zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]])
    assert size == (3, 2) and raw[1:10] == rgb[1, 2:5].tobytes() and cut[1] is None


def test_process(spark):
    """From a file to its text, with a backend that reads how wide a line is; another that reads text itself; bad files are rows."""
    g = np.full((3508 // 4, 2480 // 4), 255, np.uint8)
    for y in (200, 260, 320):
        for x in range(180, 420, 6):
            g[y : y + 26, x : x + 4] = 0
    files = spark.createDataFrame([("a.tif", bytearray(tiff([g, g]))), ("b.pdf", bytearray(b"%PDF-1")), ("c.tif", bytearray(b"II*\0zz"))], "path string, content binary")

    def scores():
        def read(lines):
            out = np.full((len(lines), 6, 4), -9.0)
            out[:, [0, 2, 4], [1, 2, 3]] = 9
            out[:, [1, 3, 5], 0] = 9
            return list(out)

        return read

    P.register_recognizer("fixed", lambda config: scores)
    P.register_recognizer("own", lambda config: lambda: lambda lines: [(f"w{x.shape[2]}", 0.5) for x in lines])
    got = {(r["path"], r["page_index"]): r for r in P.process(files, P.Config("abc", recognizer="fixed")).collect()}
    a = got["a.tif", 0]
    assert a["n_lines"] >= 1 and set(a["text"].split("\n")) == {"abc"} and a["text"] == got["a.tif", 1]["text"] and a["confidence"] > 0.99
    assert got["b.pdf", None]["error"] and got["c.tif", None]["error"]
    own = P.process(files.limit(1), P.Config("abc", recognizer="own"), pages=[1]).collect()
    assert len(own) == 1 and own[0]["text"].startswith("w") and own[0]["confidence"] == 0.5
    for bad in (P.Config("abc", detector="none"), P.Config("abc", recognizer="none"), P.Config("abc"), P.Config("", recognizer="own"), P.Config("abc", recognizer="own", max_batch=0)):
        with pytest.raises(ValueError):
            P.process(files, bad)
    with pytest.raises(ValueError, match="results for"):
        P.in_batches([np.zeros((3, 32, 4))] * 3, lambda lines: [], 2)
    assert P.stages(lambda d: d.limit(1), lambda d: d.select("path"))(files).columns == ["path"]


def test_known_error(spark):
    rows = [("fO84", "084"), ("5356300", "556500"), ("Reseryv", "Reserv"), ("Icasing", "LEASING"), ("12-75", "x"), ("O84", "O84"), ("plain", "text")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(curate.known_error(F.col("a"), F.col("b"))).collect()]
    assert got == ["O vs 0", "wrong org.nr", "typo", "I vs l", "wrong date", None, None]
