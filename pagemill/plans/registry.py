"""All queries on the driver's tables: name -> builder, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagemill.functions import text as T
from pagemill.operators import curate, decode, evaluate, raster, regions
from pagemill.plans import views as V
from pagemill.sources import readers, sinks

Builder = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Builder] = {}
_ORACLES: dict[str, str] = {}
c = F.col


def _add(name: str, build: Builder, sql: str | None = None) -> None:
    _QUERIES[name] = build
    if sql:
        _ORACLES[name] = V.by_characters(sql)


def queries() -> dict[str, Builder]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


# ---- pages and sinks -------------------------------------------------------------------------------------------------


def _chat(s: SparkSession, sf: str) -> DataFrame:
    conf = ((c("turn") * 37 + c("conv_id")) % 100).cast("double") / 100
    return V.table(s, sf, "conversations").select(c("conv_id").alias("page"), c("turn").alias("seq"), "text", conf.alias("confidence"))


_CHAT = "chat AS (SELECT conv_id AS page, turn AS seq, text, CAST((turn * 37 + conv_id) % 100 AS DOUBLE) / 100 AS confidence FROM conversations)"
_ASSEMBLE = "SELECT page, string_agg(coalesce(text, ''), chr(10) ORDER BY seq) AS text, count(*) AS n_lines, round(avg(confidence), 6) AS confidence FROM chat"
_add("page_assembly", lambda s, sf: evaluate.assemble(_chat(s, sf)), f"WITH {_CHAT} {_ASSEMBLE} GROUP BY page")
_add("page_filtered_assembly", lambda s, sf: evaluate.assemble(_chat(s, sf).filter(c("page").isin(1, 3, 5, 8))), f"WITH {_CHAT} {_ASSEMBLE} WHERE page IN (1, 3, 5, 8) GROUP BY page")
_add(
    "empty_pages_kept",
    lambda s, sf: evaluate.assemble(_chat(s, sf).filter("seq > 2"), _chat(s, sf).select("page").distinct()),
    f"WITH {_CHAT}, p AS (SELECT DISTINCT page FROM chat), g AS ({_ASSEMBLE} WHERE seq > 2 GROUP BY page) SELECT p.page, coalesce(text, '') AS text, coalesce(n_lines, 0) AS n_lines, coalesce(confidence, 0) AS confidence FROM p LEFT JOIN g USING (page)",
)
_add(
    "text_sink_format",
    lambda s, sf: sinks.page_text(_chat(s, sf).select(c("page").alias("doc"), c("seq").alias("page"), "text")),
    f"WITH {_CHAT}, n AS (SELECT *, count(*) OVER (PARTITION BY page) AS k FROM chat) SELECT page AS doc, string_agg(CASE WHEN k > 1 THEN '--- Page ' || (seq + 1) || ' ---' || chr(10) || text ELSE text END, chr(10) ORDER BY seq) AS text FROM n GROUP BY page",
)
_add(
    "regions_per_page",
    lambda s, sf: V.regions(s, sf).groupBy("page").agg(F.count("*").alias("n_regions")),
    f"WITH {V.V_REGIONS} SELECT page, count(*) AS n_regions FROM regions GROUP BY page",
)
_add(
    "kind_sniff",
    lambda s, sf: V.table(s, sf, "documents").withColumn("_b", F.concat(F.element_at(F.array(F.unhex(F.lit("25504446")), F.unhex(F.lit("49492A00")), F.unhex(F.lit("4D4D002A")), F.unhex(F.lit("FFD8")), F.lit(b"")), (c("doc_id") % 5 + 1).cast("int")), F.encode("text", "UTF-8"))).select("doc_id", readers.kind(c("_b")).alias("kind"), readers.is_jpeg(c("_b")).alias("jpeg")),
    "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'multi_page_tiff' WHEN 2 THEN 'multi_page_tiff' ELSE 'image' END AS kind, doc_id % 5 = 3 AS jpeg FROM documents",
)
_add(
    "noisy_json",
    lambda s, sf: V.table(s, sf, "events").select("event_id", readers.noisy_json(F.concat(F.lit("log: 1\n"), F.to_json(F.struct("event_id", "event_type"))), "event_id bigint, event_type string").alias("j")).select("event_id", c("j.event_type").alias("kind")),
    "SELECT event_id, event_type AS kind FROM events",
)
_add(
    "request_decode",
    lambda s, sf: readers.request(V.table(s, sf, "benchmark").select("item_id", F.to_json(F.struct(F.when(c("item_id") % 3 == 0, F.lit("!!")).otherwise(F.base64(F.encode("text", "UTF-8"))).alias("file"), F.lit("[0,2]").alias("pages"))).alias("body"))).select("item_id", "status", F.coalesce(F.length("content"), F.lit(0)).alias("n_bytes"), F.size("pages").alias("n_pages")),
    "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 400 ELSE 200 END AS status, CAST(CASE WHEN item_id % 3 = 0 THEN 0 ELSE strlen(text) END AS INTEGER) AS n_bytes, 2 AS n_pages FROM benchmark",
)
_add(
    "tsv_scan",
    lambda s, sf: readers.tsv(V.table(s, sf, "documents").select(F.concat_ws("\t", c("doc_id").cast("string"), "lang", F.when(c("doc_id") % 4 > 0, c("source"))).alias("value")), ["filename", "text", "source_fid"]),
    "SELECT CAST(doc_id AS VARCHAR) AS filename, lang AS text, source AS source_fid FROM documents WHERE doc_id % 4 > 0",
)
_add(
    "label_coalesce",
    lambda s, sf: V.table(s, sf, "documents").select("doc_id", readers.label_text(F.when(c("doc_id") % 3 == 0, "").otherwise(c("lang")), F.when(c("doc_id") % 2 == 0, c("source"))).alias("label")),
    "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), nullif(CASE WHEN doc_id % 2 = 0 THEN source END, ''), '') AS label FROM documents",
)
_add(
    "page_set_parse",
    lambda s, sf: V.table(s, sf, "benchmark").select("item_id", F.array_join(curate.page_set(F.concat(c("item_id").cast("string"), F.lit(",x, 7"))).cast("array<string>"), ",").alias("pages")),
    "SELECT item_id, item_id || ',7' AS pages FROM benchmark",
)
_add("lmdb_keys", lambda s, sf: sinks.numbered(V.table(s, sf, "documents").select("doc_id"), ["doc_id"]).select("doc_id", "image_key", "label_key"), "SELECT doc_id, format('image-{:09d}', n) AS image_key, format('label-{:09d}', n) AS label_key FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents)")
_add(
    "page_number_from_stem",
    lambda s, sf: V.table(s, sf, "pages").select("page_id", F.regexp_extract("url", r"/(\d+)", 1).alias("stem")),
    r"SELECT page_id, regexp_extract(url, '/(\d+)', 1) AS stem FROM pages",
)

# ---- regions ---------------------------------------------------------------------------------------------------------
_COLS = ["page", "seq", "x", "y", "w", "h"]


def _boxes(df: DataFrame) -> DataFrame:
    return df.select(*[c(k).cast("bigint").alias(k) for k in _COLS])


_SIZE = "w >= 20 AND h >= 24"
_MARGIN = "(x >= 140 OR (x + w - 140 >= 0 AND x + w - 140 >= 0.5 * w)) AND x <= 2480 - 140 AND (y >= 120 OR (y + h - 120 >= 0 AND y + h - 120 >= 0.5 * h)) AND y <= 3508 - 140"
_ROT = "NOT ((ang > 4 AND ang < 86) OR (180 - ang > 4 AND 180 - ang < 86))"
_add("region_derive", lambda s, sf: regions.geometry(V.regions(s, sf)).select("page", "seq", "area", "cx", "cy", "right", "bottom"), f'WITH {V.V_REGIONS} SELECT page, seq, w * h AS area, x + w / 2 AS cx, y + h / 2 AS cy, x + w AS "right", y + h AS bottom FROM regions')
_add(
    "region_filter_pad",
    lambda s, sf: _boxes(regions.pad(V.regions(s, sf).filter(regions.size_ok() & regions.margin_ok() & regions.rotation_ok()))),
    f"WITH {V.V_REGIONS} SELECT page, seq, greatest(x - 8, 0) AS x, greatest(y - 8, 0) AS y, least(w + 16, 2480 - greatest(x - 8, 0)) AS w, least(h + 16, 3508 - greatest(y - 8, 0)) AS h FROM regions WHERE {_SIZE} AND {_MARGIN} AND {_ROT}",
)
_add("size_filter", lambda s, sf: _boxes(V.regions(s, sf).filter(regions.size_ok())), f"WITH {V.V_REGIONS} SELECT page, seq, x, y, w, h FROM regions WHERE {_SIZE}")
_add("margin_filter_only", lambda s, sf: _boxes(V.regions(s, sf).filter(regions.margin_ok())), f"WITH {V.V_REGIONS} SELECT page, seq, x, y, w, h FROM regions WHERE {_MARGIN}")
_add("rotation_filter", lambda s, sf: _boxes(V.regions(s, sf).filter(regions.rotation_ok())), f"WITH {V.V_REGIONS} SELECT page, seq, x, y, w, h FROM regions WHERE {_ROT}")
_add("region_reading_order", lambda s, sf: regions.reading_order(V.regions(s, sf)).select("page", "seq", "ord"), f"WITH {V.V_REGIONS} SELECT page, seq, row_number() OVER (PARTITION BY page ORDER BY y, x, seq) - 1 AS ord FROM regions")
_ROWS = f"""WITH RECURSIVE {V.V_REGIONS},
able AS (SELECT *, y + h / 2 AS yc, row_number() OVER (PARTITION BY page ORDER BY y + h / 2, y, x, seq) AS k FROM regions WHERE h >= 20),
fold AS (
  SELECT page, seq, k, yc AS total, 1 AS n, CAST(0 AS BIGINT) AS row FROM able WHERE k = 1
  UNION ALL
  SELECT a.page, a.seq, a.k, CASE WHEN abs(a.yc - f.total / f.n) <= 20 THEN f.total + a.yc ELSE a.yc END, CASE WHEN abs(a.yc - f.total / f.n) <= 20 THEN f.n + 1 ELSE 1 END,
    CASE WHEN abs(a.yc - f.total / f.n) <= 20 THEN f.row ELSE f.row + 1 END
  FROM fold f JOIN able a ON a.page = f.page AND a.k = f.k + 1),
rowed AS (SELECT r.*, f.row FROM regions r LEFT JOIN fold f ON r.page = f.page AND r.seq = f.seq)"""
_add("region_rows_fold", lambda s, sf: regions.assign_rows(V.regions(s, sf)).select("page", "seq", "row"), f"{_ROWS} SELECT page, seq, row FROM rowed")
_add("region_columns", lambda s, sf: regions.columns(regions.assign_rows(V.regions(s, sf))).select("page", "seq", "row", "col"), f"{_ROWS} SELECT page, seq, row, CASE WHEN row IS NOT NULL THEN row_number() OVER (PARTITION BY page, row ORDER BY x, seq) - 1 END AS col FROM rowed")
_add(
    "region_clusters",
    lambda s, sf: regions.clusters(regions.assign_rows(V.regions(s, sf))).select("page", "seq", "row", "cluster"),
    f"""{_ROWS}, g AS (SELECT page, row, min(y) AS top, max(y + h) AS bottom FROM rowed WHERE row IS NOT NULL GROUP BY page, row),
j AS (SELECT page, row, CASE WHEN top - lag(bottom) OVER (PARTITION BY page ORDER BY row) > 80 THEN 1 ELSE 0 END AS jump FROM g),
k AS (SELECT page, row, CAST(sum(jump) OVER (PARTITION BY page ORDER BY row) AS BIGINT) AS cluster FROM j)
SELECT r.page, r.seq, r.row, k.cluster FROM rowed r LEFT JOIN k ON r.page = k.page AND r.row = k.row""",
)
_add(
    "polygon_bbox",
    lambda s, sf: V.regions(s, sf).withColumn("poly", regions.rectangle()).select("page", "seq", *[v.alias(k) for k, v in regions.envelope(c("poly")).items()]),
    f"WITH {V.V_REGIONS} SELECT page, seq, x, y, w, h FROM regions",
)
_add("expand_box", lambda s, sf: regions.expand(V.regions(s, sf)).select(*_COLS), f"WITH {V.V_REGIONS} SELECT page, seq, greatest(x + w / 2 - w * 1.5::DOUBLE / 2, 0) AS x, greatest(y + h / 2 - h * 1.5::DOUBLE / 2, 0) AS y, w * 1.5::DOUBLE AS w, h * 1.5::DOUBLE AS h FROM regions")
_add(
    "neural_postfilter",
    lambda s, sf: regions.largest(V.regions(s, sf).filter(((c("x") * 7 + c("y")) % 100 >= 30) & (c("w") * c("h") >= 100)), c("w") * c("h")).select(*_COLS),
    f"WITH {V.V_REGIONS} SELECT page, seq, x, y, w, h FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY w * h DESC, seq) AS k FROM regions WHERE (x * 7 + y) % 100 >= 30 AND w * h >= 100) WHERE k <= 1000",
)


def _page_pairs(s: SparkSession, sf: str) -> DataFrame:
    return regions.overlap_pairs(V.regions(s, sf), V.jitter(s, sf))


_add(
    "iou_pairs",
    lambda s, sf: _page_pairs(s, sf).select("page", "lseq", "rseq", F.round(regions.iou(), 6).alias("iou")).filter("iou > 0"),
    f"""WITH {V.V_JITTER}, p AS (SELECT a.page, a.seq AS lseq, b.seq AS rseq, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS dw, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS dh, a.w * a.h + b.w * b.h AS areas FROM regions a JOIN jitter b ON a.page = b.page)
SELECT page, lseq, rseq, round(dw * dh / (areas - dw * dh)::DOUBLE, 6) AS iou FROM p WHERE dw > 0 AND dh > 0 AND round(dw * dh / (areas - dw * dh)::DOUBLE, 6) > 0""",
)
_RADIUS = f"WITH {V.V_JITTER}, m AS (SELECT a.page, a.seq AS lseq, b.seq AS rseq, sqrt(pow(a.x + a.w / 2 - b.x - b.w / 2, 2) + pow(a.y + a.h / 2 - b.y - b.h / 2, 2)) AS dist FROM regions a JOIN jitter b ON a.page = b.page), near AS (SELECT * FROM m WHERE dist < 100)"
_near = lambda s, sf: regions.radius_pairs(V.regions(s, sf), V.jitter(s, sf))
_add("radius_pairs", lambda s, sf: _near(s, sf).withColumn("dist", F.round("dist", 6)), f"{_RADIUS} SELECT page, lseq, rseq, round(dist, 6) AS dist FROM near")
_add("unmatched_left", lambda s, sf: V.regions(s, sf).select("page", "seq").join(_near(s, sf).select("page", c("lseq").alias("seq")), ["page", "seq"], "left_anti"), f"{_RADIUS} SELECT page, seq FROM regions r WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.page = r.page AND n.lseq = r.seq)")
_add("unmatched_right", lambda s, sf: V.jitter(s, sf).select("page", "seq").join(_near(s, sf).select("page", c("rseq").alias("seq")), ["page", "seq"], "left_anti"), f"{_RADIUS} SELECT page, seq FROM jitter r WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.page = r.page AND n.rseq = r.seq)")


def _one_to_one(edges: str, order: str, out: str = "SELECT page, lseq, rseq, round(dist, 6) AS dist FROM f WHERE hit") -> str:
    """SQL that goes through each page's edges (CTE ``edges``: page, lseq, rseq, dist) in an order and takes those whose ends are free."""
    ok = "NOT list_contains(f.ul, e.lseq) AND NOT list_contains(f.ur, e.rseq)"
    return f""", e AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY {order}) AS k FROM {edges}),
f AS (SELECT page, k, lseq, rseq, dist, true AS hit, [lseq] AS ul, [rseq] AS ur FROM e WHERE k = 1
  UNION ALL
  SELECT e.page, e.k, e.lseq, e.rseq, e.dist, {ok}, CASE WHEN {ok} THEN list_append(f.ul, e.lseq) ELSE f.ul END, CASE WHEN {ok} THEN list_append(f.ur, e.rseq) ELSE f.ur END
  FROM f JOIN e ON e.page = f.page AND e.k = f.k + 1)
{out}"""


_rounded = lambda df: df.withColumn("dist", F.round("dist", 6))
_RECURSIVE = _RADIUS.replace("WITH ", "WITH RECURSIVE ", 1)
_GREEDY = _one_to_one("near", "dist, lseq, rseq", "")
_add("greedy_match", lambda s, sf: _rounded(regions.greedy_match(_near(s, sf))), _RECURSIVE + _one_to_one("near", "dist, lseq, rseq"))
_add(
    "sequential_match",
    lambda s, sf: _rounded(regions.sequential_match(_near(s, sf), V.regions(s, sf).select("page", c("seq").alias("lseq"), (-c("w")).alias("ord")))),
    _RECURSIVE + ", wide AS (SELECT n.*, r.w FROM near n JOIN regions r ON r.page = n.page AND r.seq = n.lseq)" + _one_to_one("wide", "w DESC, lseq, dist, rseq"),
)


def _deltas(s: SparkSession, sf: str) -> DataFrame:
    a = V.regions(s, sf).select("page", c("seq").alias("lseq"), *[c(k).alias(f"a{k}") for k in "xywh"])
    b = V.jitter(s, sf).select("page", c("seq").alias("rseq"), *[c(k).alias(f"b{k}") for k in "xywh"])
    m = a.join(regions.greedy_match(_near(s, sf)), ["page", "lseq"], "left").join(b, ["page", "rseq"], "left")
    far = F.greatest(F.abs(c("ax") - c("bx")), F.abs(c("ay") - c("by"))) > 20
    off = F.greatest(F.abs(c("aw") - c("bw")), F.abs(c("ah") - c("bh"))) > 40
    return m.agg(F.count("*").alias("n"), F.count("rseq").alias("matched"), F.sum((far | off).cast("bigint")).alias("shifted")).withColumn("matched_percent", F.round(100 * c("matched") / c("n"), 6))


_add(
    "detection_deltas",
    _deltas,
    _RECURSIVE
    + _GREEDY
    + """, mm AS (SELECT a.*, b.x AS jx, b.y AS jy, b.w AS jw, b.h AS jh, b.seq AS jseq FROM regions a LEFT JOIN (SELECT * FROM f WHERE hit) g ON g.page = a.page AND g.lseq = a.seq LEFT JOIN jitter b ON b.page = g.page AND b.seq = g.rseq)
SELECT count(*) AS n, count(jseq) AS matched, CAST(sum(CASE WHEN greatest(abs(x - jx), abs(y - jy)) > 20 OR greatest(abs(w - jw), abs(h - jh)) > 40 THEN 1 ELSE 0 END) AS BIGINT) AS shifted, round(100 * count(jseq) / count(*), 6) AS matched_percent FROM mm""",
)


def _detection_f1(s: SparkSession, sf: str) -> DataFrame:
    near = _page_pairs(s, sf).withColumn("dist", 1 - regions.iou()).filter("dist <= 0.5").select("page", "lseq", "rseq", "dist")
    return regions.detection_scores(regions.greedy_match(near), V.jitter(s, sf), V.regions(s, sf))


_add(
    "detection_f1",
    _detection_f1,
    f"""WITH RECURSIVE {V.V_JITTER}, p AS (SELECT a.page, a.seq AS lseq, b.seq AS rseq, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS dw, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS dh, a.w * a.h + b.w * b.h AS areas FROM regions a JOIN jitter b ON a.page = b.page),
near AS (SELECT page, lseq, rseq, 1 - dw * dh / (areas - dw * dh)::DOUBLE AS dist FROM p WHERE dw > 0 AND dh > 0 AND 1 - dw * dh / (areas - dw * dh)::DOUBLE <= 0.5)"""
    + _GREEDY
    + """, n AS (SELECT (SELECT count(*) FROM f WHERE hit) AS tp, (SELECT count(*) FROM jitter) AS found, (SELECT count(*) FROM regions) AS truth)
SELECT tp, round(tp / greatest(found, 1)::DOUBLE, 6) AS precision, round(tp / greatest(truth, 1)::DOUBLE, 6) AS recall, round(2 * tp / greatest(found + truth, 1)::DOUBLE, 6) AS f1 FROM n""",
)
_PLAN = f"WITH {V.V_REGIONS}, q AS (SELECT *, greatest(CAST(round(w * 32 / h::DOUBLE) AS BIGINT), 4) AS rw FROM regions), plan AS (SELECT * EXCLUDE (rw), greatest(least(rw - rw % 4, 1792), 4) AS line_w FROM q)"
_plan = lambda s, sf: regions.width_plan(V.regions(s, sf))
_BATCH = f"{_PLAN}, n AS (SELECT page, seq, line_w, (row_number() OVER (ORDER BY line_w, page, seq) - 1) // 64 AS batch FROM plan), b AS (SELECT *, max(line_w) OVER (PARTITION BY batch) AS batch_w FROM n)"
_add("width_plan", lambda s, sf: _plan(s, sf).select("page", "seq", "line_w"), f"{_PLAN} SELECT page, seq, line_w FROM plan")
_add("width_batches", lambda s, sf: regions.width_batches(_plan(s, sf)).select("page", "seq", "batch", "batch_w", "item_w"), f"{_BATCH} SELECT page, seq, batch, batch_w, least(line_w, batch_w) AS item_w FROM b")
_add("padding_waste", lambda s, sf: regions.width_batches(_plan(s, sf)).agg(F.countDistinct("batch").alias("batches"), F.sum(c("batch_w") - c("line_w")).alias("waste")), f"{_BATCH} SELECT count(DISTINCT batch) AS batches, CAST(sum(batch_w - line_w) AS BIGINT) AS waste FROM b")
_add("equal_width_batches", lambda s, sf: regions.equal_width_batches(_plan(s, sf)).select("page", "seq", "line_w", "chunk"), f"{_PLAN} SELECT page, seq, line_w, (row_number() OVER (PARTITION BY line_w ORDER BY page, seq) - 1) // 64 AS chunk FROM plan")
_add("round_robin", lambda s, sf: V.table(s, sf, "documents").groupBy((c("doc_id") % 4).alias("stream")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "SELECT doc_id % 4 AS stream, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
_add("page_batches", lambda s, sf: V.table(s, sf, "documents").select("doc_id", F.floor(c("doc_id") / 8).alias("batch")), "SELECT doc_id, doc_id // 8 AS batch FROM documents")
_add("sort_check", lambda s, sf: regions.disorders(V.regions(s, sf).withColumn("ord", c("seq"))), f"WITH {V.V_REGIONS} SELECT CAST(coalesce(sum(CASE WHEN before > y THEN 1 ELSE 0 END), 0) AS BIGINT) AS disorders FROM (SELECT y, lag(y) OVER (PARTITION BY page ORDER BY seq) AS before FROM regions)")
_add("upper_median_height", lambda s, sf: V.regions(s, sf).groupBy("page").agg(decode.upper_median(F.collect_list("h")).alias("mid")), f"WITH {V.V_REGIONS} SELECT page, list_sort(list(h))[CAST(count(*) // 2 + 1 AS INTEGER)] AS mid FROM regions GROUP BY page")
_add("region_page_lookup", lambda s, sf: evaluate.required(V.regions(s, sf), V.table(s, sf, "documents").select(c("doc_id").alias("page"), "lang"), "page").select("page", "seq", "lang"), f"WITH {V.V_REGIONS} SELECT page, seq, lang FROM regions JOIN documents ON doc_id = page")

# ---- rasters ---------------------------------------------------------------------------------------------------------


def _kernel(f) -> Builder:
    return lambda s, sf: raster.pixels(raster.on_pages(V.raster(s), f))


def _g(f):
    return lambda rgb: f(raster.gray(rgb))


_EDGE = "ROWS BETWEEN {b} PRECEDING AND {a} FOLLOWING"
_add("gray", _kernel(raster.gray), f"WITH {V.V_RASTER} SELECT page, y, x, v FROM gray")


def _tap(src: str, axis: str, last: int) -> str:
    other = "y" if axis == "x" else "x"
    return (
        f"SELECT a.page, a.y, a.x, sum(b.v * k.wt) // 16 AS v FROM {src} a, (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) k(d, wt), {src} b "
        f"WHERE b.page = a.page AND b.{other} = a.{other} AND b.{axis} = least(greatest(a.{axis} + k.d, 0), {last}) GROUP BY a.page, a.y, a.x"
    )


_BLUR = f"WITH {V.V_RASTER}, bh AS ({_tap('gray', 'x', 31)}), blur AS ({_tap('bh', 'y', 23)})"
_add("blur", _kernel(_g(raster.blur)), f"{_BLUR} SELECT page, y, x, CAST(v AS BIGINT) AS v FROM blur")


def _integral(s: SparkSession, sf: str) -> DataFrame:
    flat = raster.pixels(raster.on_pages(V.raster(s), raster.gray))
    rows = W.partitionBy("page", "y").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    cols = W.partitionBy("page", "x").orderBy("y").rowsBetween(W.unboundedPreceding, 0)
    return flat.withColumn("v", F.sum("v").over(rows)).withColumn("v", F.sum("v").over(cols))


_add("integral", _integral, f"WITH {V.V_RASTER} SELECT a.page, a.y, a.x, CAST(sum(b.v) AS BIGINT) AS v FROM gray a JOIN gray b ON a.page = b.page AND b.y <= a.y AND b.x <= a.x GROUP BY 1, 2, 3")


def _near_sql(r: int, body: str) -> str:
    return f"WITH {V.V_RASTER} SELECT a.page, a.y, a.x, {body} AS v FROM gray a JOIN gray b ON a.page = b.page AND abs(a.y - b.y) <= {r} AND abs(a.x - b.x) <= {r} GROUP BY a.page, a.y, a.x, a.v"


_add("adaptive_threshold", _kernel(_g(raster.adaptive_threshold)), _near_sql(7, "CAST(CASE WHEN a.v <= avg(b.v) - 4 THEN 255 ELSE 0 END AS BIGINT)"))
_add("sauvola", _kernel(_g(raster.sauvola)), _near_sql(15, "CAST(CASE WHEN a.v > avg(b.v) * (1 + 0.2::DOUBLE * (stddev_pop(b.v) / 128 - 1)) THEN 255 ELSE 0 END AS BIGINT)"))
_add("dilate_rect", _kernel(_g(raster.dilate_rect)), _near_sql(1, "max(b.v)"))
_add("erode", _kernel(_g(raster.erode_rect)), _near_sql(1, "min(b.v)"))
_add("dilate_h", _kernel(_g(raster.dilate_h)), f"WITH {V.V_RASTER} SELECT page, y, x, max(v) OVER (PARTITION BY page, y ORDER BY x {_EDGE.format(b=9, a=10)}) AS v FROM gray")
_add("dilate_h_symmetric", _kernel(_g(lambda g: raster.dilate_h(g, 20, True))), f"WITH {V.V_RASTER} SELECT page, y, x, max(v) OVER (PARTITION BY page, y ORDER BY x {_EDGE.format(b=10, a=10)}) AS v FROM gray")
_add("dilate_v", _kernel(_g(raster.dilate_v)), f"WITH {V.V_RASTER} SELECT page, y, x, max(v) OVER (PARTITION BY page, x ORDER BY y {_EDGE.format(b=1, a=1)}) AS v FROM gray")
_add(
    "median3",
    _kernel(_g(raster.median3)),
    f"WITH {V.V_RASTER}, n AS (SELECT a.page, a.y, a.x, b.v FROM gray a, (VALUES (-1), (0), (1)) p(dy), (VALUES (-1), (0), (1)) q(dx), gray b WHERE b.page = a.page AND b.y = least(greatest(a.y + dy, 0), 23) AND b.x = least(greatest(a.x + dx, 0), 31)) SELECT page, y, x, list_sort(list(v))[5] AS v FROM n GROUP BY 1, 2, 3",
)
_add(
    "gauss5",
    _kernel(_g(raster.gauss5)),
    f"WITH {V.V_RASTER}, k(i, w) AS (VALUES {', '.join(f'({i}, {w})' for i, w in enumerate(raster.GAUSS.ravel().tolist()))}) SELECT a.page, a.y, a.x, CAST(sum(b.v * k.w) // 273 AS BIGINT) AS v FROM gray a, k, gray b WHERE b.page = a.page AND b.y = least(greatest(a.y + k.i // 5 - 2, 0), 23) AND b.x = least(greatest(a.x + k.i % 5 - 2, 0), 31) GROUP BY 1, 2, 3",
)
_square = lambda src, agg: f"SELECT a.page, a.y, a.x, {agg}(b.v) AS v FROM {src} a JOIN {src} b ON a.page = b.page AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3"
_add("opened", _kernel(_g(raster.opened)), f"WITH {V.V_RASTER}, e AS ({_square('gray', 'min')}) {_square('e', 'max')}")
_add("closed", _kernel(_g(raster.closed)), f"WITH {V.V_RASTER}, e AS ({_square('gray', 'max')}) {_square('e', 'min')}")
_add("bilateral", _kernel(_g(raster.bilateral)))
_add("deskew", _kernel(_g(raster.deskew)))
_add("preprocess_chain", _kernel(_g(raster.preprocess)))
_wide = lambda src: f"SELECT page, y, x, max(v) OVER (PARTITION BY page, y ORDER BY x {_EDGE.format(b=9, a=10)}) AS v FROM {src}"
_high = lambda src: f"SELECT page, y, x, max(v) OVER (PARTITION BY page, x ORDER BY y {_EDGE.format(b=1, a=1)}) AS v FROM {src}"
_add(
    "detection_mask",
    _kernel(lambda rgb: raster.masks(rgb)[0]),
    f"""{_BLUR}, ink AS (SELECT a.page, a.y, a.x, CAST(CASE WHEN a.v <= avg(b.v) - 4 THEN 255 ELSE 0 END AS BIGINT) AS v FROM blur a JOIN blur b ON a.page = b.page AND abs(a.y - b.y) <= 7 AND abs(a.x - b.x) <= 7 GROUP BY a.page, a.y, a.x, a.v),
h1 AS ({_wide('ink')}), v1 AS ({_high('h1')}), h2 AS ({_wide('v1')}) {_high('h2')}""",
)
_add("detect_regions", lambda s, sf: raster.detect_pages(V.raster(s)))
_ink = lambda s: raster.pixels(raster.on_pages(V.raster(s), _g(raster.adaptive_threshold)))
_INK = f"WITH {V.V_RASTER}, ink AS (SELECT a.page, a.y, a.x, CASE WHEN a.v <= avg(b.v) - 4 THEN 255 ELSE 0 END AS v FROM gray a JOIN gray b ON a.page = b.page AND abs(a.y - b.y) <= 7 AND abs(a.x - b.x) <= 7 GROUP BY a.page, a.y, a.x, a.v)"
_PROFILE = f"{_INK}, prof AS (SELECT page, y, CAST(sum(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM ink GROUP BY page, y)"
_prof = lambda s: _ink(s).groupBy("page", "y").agg(F.sum((c("v") == 0).cast("bigint")).alias("n"))
_add("profile_rows", lambda s, sf: _prof(s), f"{_PROFILE} SELECT page, y, n FROM prof")
_add("profile_variance", lambda s, sf: _prof(s).groupBy("page").agg(F.round(F.var_pop("n"), 6).alias("variance")), f"{_PROFILE} SELECT page, round(var_pop(n), 6) AS variance FROM prof GROUP BY page")


def _islands(s: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("page").orderBy("y")
    on = _prof(s).withColumn("on", c("n") < 22).withColumn("_new", (c("on") & ~F.coalesce(F.lag("on").over(w), F.lit(False))).cast("bigint")).withColumn("_id", F.sum("_new").over(w))
    return on.filter("on").groupBy("page", "_id").agg(F.min("y").alias("top"), F.max("y").alias("last")).select("page", "top", "last")


_add("line_islands", _islands, f"{_PROFILE}, o AS (SELECT *, n < 22 AS onn, y - row_number() OVER (PARTITION BY page, n < 22 ORDER BY y) AS g FROM prof) SELECT page, min(y) AS top, max(y) AS last FROM o WHERE onn GROUP BY page, g")


def _components(s: SparkSession, sf: str) -> DataFrame:
    d = raster.component_table(raster.on_pages(V.raster(s), _g(raster.adaptive_threshold)))
    return d.withColumn("ang", F.round("ang", 4)).drop("seq")


_REACH = """reach(page, y, x, id, root) AS (SELECT page, y, x, id, id FROM fg UNION SELECT n.page, n.y, n.x, n.id, r.root FROM reach r JOIN fg n ON n.page = r.page AND abs(n.y - r.y) + abs(n.x - r.x) = 1 AND n.id > r.root),
lab AS (SELECT page, y, x, id, min(root) AS root FROM reach GROUP BY ALL)"""
_LABELS = f"""WITH RECURSIVE {_INK.removeprefix("WITH ")}, fg AS (SELECT page, y, x, y * 32 + x AS id FROM ink WHERE v > 0), {_REACH}"""
_add("component_moments", lambda s, sf: _components(s, sf).drop("ang"), f"{_LABELS} SELECT page, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS n FROM lab GROUP BY page, root")
_add(
    "component_orientation",
    lambda s, sf: _components(s, sf).select("page", "x", "y", "ang"),
    f"""{_LABELS}, m AS (SELECT page, min(x) AS x0, min(y) AS y0, degrees(0.5::DOUBLE * atan2(2 * (avg(x * y) - avg(x) * avg(y)), (avg(x * x) - avg(x) * avg(x)) - (avg(y * y) - avg(y) * avg(y)))) AS a FROM lab GROUP BY page, root)
SELECT page, x0 AS x, y0 AS y, round(CASE WHEN a < 0 THEN a + 180 ELSE a END, 4) AS ang FROM m""",
)
_add(
    "despeckle",
    _kernel(_g(lambda g: raster.despeckle(raster.adaptive_threshold(g)))),
    f"""WITH RECURSIVE {_INK.removeprefix("WITH ")}, fg AS (SELECT page, y, x, y * 32 + x AS id FROM ink WHERE v = 0), {_REACH},
n AS (SELECT page, y, x, count(*) OVER (PARTITION BY page, root) AS n FROM lab)
SELECT i.page, i.y, i.x, CAST(CASE WHEN n.n < 10 THEN 255 ELSE i.v END AS BIGINT) AS v FROM ink i LEFT JOIN n ON n.page = i.page AND n.y = i.y AND n.x = i.x""",
)

# ---- decoding --------------------------------------------------------------------------------------------------------


def _steps(s: SparkSession, sf: str) -> DataFrame:
    return V.logits(s, sf).select("vec_id", F.transform("scores", decode.softmax_argmax).alias("steps"))


_lines = lambda s, sf: decode.decoded(_steps(s, sf))
_add("softmax_argmax", lambda s, sf: _steps(s, sf).select("vec_id", F.posexplode("steps").alias("t", "s")).select("vec_id", c("t").cast("bigint").alias("t"), "s.idx", F.round("s.p", 6).alias("p")), f"WITH {V.V_STEPS} SELECT vec_id, t, idx, round(p, 6) AS p FROM steps")
_add("ctc_decode", lambda s, sf: _lines(s, sf).select("vec_id", F.posexplode(F.arrays_zip("tokens", "pos")).alias("k", "z")).select("vec_id", c("k").cast("bigint").alias("k"), c("z.tokens").alias("token"), c("z.pos").alias("pos")), f"WITH {V.V_STEPS} SELECT vec_id, k, token, pos FROM emitted")
_add("ctc_per_item", lambda s, sf: _steps(s, sf).select("vec_id", F.size(decode.ctc_decode(c("steps"), 4 * (c("vec_id") % 17))).cast("bigint").alias("n")), f"WITH {V.V_STEPS} SELECT e.vec_id, count(m.pos) AS n FROM embeddings e LEFT JOIN emitted m ON m.vec_id = e.vec_id AND m.pos < e.vec_id % 17 GROUP BY e.vec_id")
_add("line_confidence", lambda s, sf: _lines(s, sf).select("vec_id", F.round("confidence", 6).alias("confidence")), f"WITH {V.V_STEPS} SELECT e.vec_id, round(coalesce(exp(avg(ln(p))), 0), 6) AS confidence FROM embeddings e LEFT JOIN emitted m USING (vec_id) GROUP BY e.vec_id")
_add("char_gaps", lambda s, sf: _lines(s, sf).select("vec_id", F.posexplode(decode.gaps(c("pos"))).alias("k", "gap")).withColumn("k", c("k").cast("bigint")), f"WITH {V.V_STEPS} SELECT vec_id, k, gap FROM (SELECT vec_id, k, lead(pos) OVER (PARTITION BY vec_id ORDER BY k) - pos AS gap FROM emitted) WHERE gap IS NOT NULL")
_add(
    "trailing_trim",
    lambda s, sf: _lines(s, sf).select("vec_id", F.size("pos").cast("bigint").alias("n"), decode.trailing_cut(c("pos")).cast("bigint").alias("kept")),
    f"""WITH {V.V_STEPS}, a AS (SELECT vec_id, count(*) AS n FROM emitted GROUP BY 1), g AS (SELECT vec_id, k AS i, lead(pos) OVER (PARTITION BY vec_id ORDER BY k) - pos AS gap FROM emitted),
m AS (SELECT vec_id, list_sort(list(gap))[CAST(count(*) // 2 + 1 AS INTEGER)] AS mid FROM g WHERE gap IS NOT NULL GROUP BY 1),
w AS (SELECT g.vec_id, arg_max(i, gap * 100 - i) AS i, max(gap) AS widest FROM g JOIN a USING (vec_id) WHERE gap IS NOT NULL AND i >= n * 60 // 100 GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0) AS n, CASE WHEN n >= 4 AND widest >= 3 AND (mid <= 0 OR widest >= 2 * mid) AND n - i - 1 <= 6 AND 4 * (n - i - 1) <= n THEN i + 1 ELSE coalesce(n, 0) END AS kept
FROM embeddings e LEFT JOIN a USING (vec_id) LEFT JOIN m USING (vec_id) LEFT JOIN w USING (vec_id)""",
)
_add("ar_decode", lambda s, sf: _steps(s, sf).select("vec_id", F.size(decode.ar_decode(F.transform("steps", lambda x: x["idx"]))).cast("bigint").alias("n")), f"WITH {V.V_STEPS} SELECT vec_id, coalesce(min(CASE WHEN idx IN (0, 2) THEN t END), 16) AS n FROM steps GROUP BY vec_id")
_ALPHA = "abcdefghijklmnopqrstuvwxyz "
_ids = lambda: decode.tokenizer_encode(c("lang"), _ALPHA, 28, 0, 29, 8)
_add("tokenizer_encode", lambda s, sf: V.table(s, sf, "documents").select("doc_id", F.array_join(_ids().cast("array<string>"), " ").alias("ids")), f"SELECT doc_id, array_to_string(list_concat([28], list_transform(string_split(lang, ''), lambda ch: strpos('{_ALPHA}', ch)), [0], list_transform(range(0, 6 - length(lang)), lambda i: 29)), ' ') AS ids FROM documents")
_add("tokenizer_decode", lambda s, sf: V.table(s, sf, "documents").select("doc_id", decode.tokenizer_decode(_ids(), _ALPHA, 28, 0, 29).alias("text")), "SELECT doc_id, lang AS text FROM documents")
# Whole lines, padded to a multiple of eight ids.
_line_ids = lambda s, sf: V.lines(s, sf).select("page", "seq", decode.tokenizer_encode(c("line"), _ALPHA, 28, 0, 29, (F.ceil((F.length("line") + 2) / 8) * 8).cast("int")).alias("_ids"))
_add("tokenizer_encode_lines", lambda s, sf: _line_ids(s, sf).select("page", "seq", F.array_join(c("_ids").cast("array<string>"), " ").alias("ids")))
_add("tokenizer_decode_lines", lambda s, sf: _line_ids(s, sf).select("page", "seq", decode.tokenizer_decode(c("_ids"), _ALPHA, 28, 0, 29).alias("text")))
_add("strip_spaces", lambda s, sf: V.lines(s, sf).select("page", "seq", (F.length("line") - F.length(F.ltrim("line"))).cast("bigint").alias("from_char"), F.trim("line").alias("text")), f"WITH {V.V_LINES} SELECT page, seq, length(line) - length(ltrim(line)) AS from_char, trim(line) AS text FROM lines")

# ---- evaluation ------------------------------------------------------------------------------------------------------


def _on(build, view=V.pairs) -> Builder:
    return lambda s, sf: build(view(s, sf))


_P = f"WITH {V.V_PAIRS}"
_CER = "CASE WHEN length({r}) = 0 THEN CASE WHEN length({h}) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein({r}, {h}) / length({r})::DOUBLE END"
_SPACED = r"regexp_replace({x}, '(\d)\s+(\d)', '\1\2', 'g')"
_EXACT = "CAST(sum(CASE WHEN {e} THEN 1 ELSE 0 END) AS BIGINT)"
_n = lambda e: _EXACT.format(e=e)
_add("cer_rows", _on(lambda p: p.select("page", "seq", F.round(T.cer(c("ref"), c("hyp")), 6).alias("cer"))), f"{_P} SELECT page, seq, round({_CER.format(r='ref', h='hyp')}, 6) AS cer FROM pairs")
_add("micro_cer", _on(evaluate.micro_cer), f"{_P} SELECT CAST(sum(levenshtein(ref, hyp)) AS BIGINT) AS edits, CAST(sum(length(ref)) AS BIGINT) AS ref_chars, round(sum(levenshtein(ref, hyp)) / greatest(sum(length(ref)), 1)::DOUBLE, 6) AS cer FROM pairs")
_add("wer_micro", _on(evaluate.micro_wer))
_add("exact_accuracy", _on(evaluate.exact), f"{_P} SELECT count(*) AS n, {_n('ref = hyp')} AS correct, round(avg(CASE WHEN ref = hyp THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy FROM pairs")
_CHARS = "ch AS (SELECT page, seq, hyp, ref, unnest(range(1, {m} + 1)) AS i FROM pairs)"
_add("confusions_top20", _on(evaluate.confusions), f"{_P}, {_CHARS.format(m='least(length(ref), length(hyp))')}, d AS (SELECT substr(ref, i, 1) AS true_char, substr(hyp, i, 1) AS pred_char, page * 100000000 + seq * 1000000 + i AS spot FROM ch WHERE substr(ref, i, 1) <> substr(hyp, i, 1)) SELECT true_char, pred_char, count(*) AS n FROM d GROUP BY 1, 2 ORDER BY n DESC, min(spot) LIMIT 20")
_add("per_letter_accuracy", _on(lambda p: evaluate.diacritics(p, "aeiou")), f"{_P}, {_CHARS.format(m='length(ref)')} SELECT substr(ref, i, 1) AS letter, count(*) AS total, {_n('substr(ref, i, 1) = substr(hyp, i, 1)')} AS correct, round({_n('substr(ref, i, 1) = substr(hyp, i, 1)')} / count(*)::DOUBLE, 6) AS accuracy FROM ch WHERE substr(ref, i, 1) IN ('a', 'e', 'i', 'o', 'u') GROUP BY 1")
_add("per_diacritic", lambda s, sf: evaluate.diacritics(V.lines(s, sf).select("page", "seq", c("line").alias("ref"), F.lower("line").alias("hyp"))), f"WITH {V.V_LINES}, ch AS (SELECT line AS ref, lower(line) AS hyp, unnest(range(1, length(line) + 1)) AS i FROM lines), d AS (SELECT substr(ref, i, 1) AS letter, substr(hyp, i, 1) AS h FROM ch) SELECT letter, count(*) AS total, {_n('letter = h')} AS correct, round({_n('letter = h')} / count(*)::DOUBLE, 6) AS accuracy FROM d WHERE letter IN ({', '.join(repr(x) for x in T.EVALUATED_LETTERS)}) GROUP BY 1")
_add("length_buckets", _on(evaluate.length_buckets), f"{_P}, b AS (SELECT *, CASE WHEN length(ref) <= 10 THEN '1-10' WHEN length(ref) <= 30 THEN '11-30' WHEN length(ref) <= 60 THEN '31-60' ELSE '61+' END AS bucket FROM pairs) SELECT bucket, count(*) AS n, {_n('ref = hyp')} AS correct, round({_n('ref = hyp')} / count(*)::DOUBLE, 6) AS accuracy, round(sum(levenshtein(ref, hyp) / greatest(length(ref), 1)::DOUBLE) / count(*), 6) AS mean_cer FROM b GROUP BY bucket")
_T3 = f"WITH {V.V_TRIPLES}"
_SUM = ", ".join(
    ["count(*) AS n"]
    + [f"{_n(f'{k} = v')} AS {k}_exact" for k in "ab"]
    + [_n(f"replace({k}, ' ', '') = replace(v, ' ', '')") + f" AS {k}_space" for k in "ab"]
    + [f"round(sum({_CER.format(r='v', h=k)}), 6) AS {k}_cer_sum" for k in "ab"]
)
_add("three_way_summary", _on(evaluate.three_way, V.triples), f"{_T3} SELECT {_SUM} FROM triples")
_add("three_way_per_page", _on(evaluate.three_way_pages, V.triples), f"{_T3} SELECT page, {_SUM} FROM triples GROUP BY page")
_add("three_way_wins", _on(evaluate.three_way_wins, V.triples), f"{_T3} SELECT {_n('a = v AND b = v')} AS both_right, {_n('a = v AND b <> v')} AS only_a, {_n('a <> v AND b = v')} AS only_b, {_n('a <> v AND b <> v')} AS both_wrong FROM triples")
_add("model_agreement", _on(evaluate.agreement, V.triples), f"{_T3} SELECT count(*) AS n, {_n('a = v')} AS correct_a, {_n('b = v')} AS correct_b, {_n('a = v AND b = v')} AS both, {_n('a = v AND b <> v')} AS only_a, {_n('a <> v AND b = v')} AS only_b, {_n('a <> b')} AS disagree FROM triples")
_add(
    "difference_categories",
    _on(evaluate.categories),
    f"{_P}, e AS (SELECT *, {_CER.format(r='ref', h='hyp')} AS e FROM pairs), k AS (SELECT CASE WHEN ref = hyp THEN 'exact' WHEN {_SPACED.format(x='ref')} = {_SPACED.format(x='hyp')} THEN 'number_spacing' WHEN e < 0.1 THEN 'minor' WHEN length(hyp) > 3 * length(ref) THEN 'hallucination' WHEN e > 0.8 THEN 'both_differ' ELSE 'reference_error' END AS category FROM e) SELECT category, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM k GROUP BY category",
)
_add("number_spacing", _on(evaluate.number_spacing), rf"{_P} SELECT count(*) AS n, CAST(coalesce(sum(CASE WHEN replace(ref, ' ', '') = replace(hyp, ' ', '') THEN 1 ELSE 0 END), 0) AS BIGINT) AS spacing_only FROM pairs WHERE regexp_matches(ref, '^-?[\d\s]+$') AND ref <> hyp")
_add("corpus_cer_excl", _on(evaluate.corpus_cer), f"{_P}, d AS (SELECT {_SPACED.format(x='ref')} AS ref, {_SPACED.format(x='hyp')} AS hyp FROM pairs WHERE NOT (length(hyp) > 3 * length(ref) AND length(ref) > 3)) SELECT count(*) AS n, CAST(sum(levenshtein(ref, hyp)) AS BIGINT) AS edits, CAST(sum(greatest(length(ref), 1)) AS BIGINT) AS ref_len, round(sum(levenshtein(ref, hyp)) / sum(greatest(length(ref), 1))::DOUBLE, 6) AS cer FROM d")
_GARBAGE = "length(hyp) >= 5 AND length(ref) >= 8 AND len(list_filter([1, 2, 3, 4, 5, 6], lambda k: k < length(hyp) - 1 AND substr(hyp, k + 1, 8) = substr(ref, 1, 8))) > 0"
_add("match_levels", _on(evaluate.match_levels), f"{_P}, m AS (SELECT ref = hyp AS ex, lower(ref) = lower(hyp) AS cs, replace(ref, ' ', '') = replace(hyp, ' ', '') AS sp, {_GARBAGE} AS lg FROM pairs) SELECT count(*) AS n, {_n('ex')} AS exact, {_n('NOT ex AND cs')} AS case_only, {_n('NOT ex AND NOT cs AND sp')} AS space_only, {_n('NOT ex AND NOT cs AND NOT sp')} AS different, {_n('lg AND NOT ex')} AS leading_garbage FROM m")
_add("leading_garbage", _on(lambda p: p.filter(T.leading_garbage(F.concat(F.lit("q"), c("hyp")), c("ref"))).select("page", "seq")), f"{_P} SELECT page, seq FROM (SELECT page, seq, ref, 'q' || hyp AS hyp FROM pairs) WHERE {_GARBAGE}")
_add("worst_50", _on(lambda p: evaluate.worst(p).select("page", "seq", "cer")), f"{_P} SELECT page, seq, round(levenshtein(ref, hyp) / greatest(length(ref), 1)::DOUBLE, 6) AS cer FROM pairs ORDER BY 3 DESC, 1, 2 LIMIT 50")
_add("corrections_30", _on(lambda p: evaluate.corrections(p).select("page", "seq", "cer")), f"{_P}, k AS (SELECT page, seq, round({_CER.format(r='ref', h='hyp')}, 6) AS cer FROM pairs WHERE length(ref) > 5) SELECT page, seq, cer FROM k WHERE cer > 0.05 AND cer < 0.4 ORDER BY cer, page, seq LIMIT 30")
_add("first_samples", _on(lambda p: p.filter("ref <> hyp").orderBy("page", "seq").limit(15).select("page", "seq")), f"{_P} SELECT page, seq FROM pairs WHERE ref <> hyp ORDER BY 1, 2 LIMIT 15")
_add("normalize_ws", _on(lambda p: p.select("page", "seq", T.normalize_ws(F.replace(c("ref"), F.lit("e"), F.lit("  "))).alias("text"))), rf"{_P} SELECT page, seq, trim(regexp_replace(replace(ref, 'e', '  '), '\s+', ' ', 'g')) AS text FROM pairs")
_add("digit_spacing", _on(lambda p: p.select("page", "seq", T.digit_spacing(F.translate("ref", "aeiou", "1234 ")).alias("text"))), f"{_P} SELECT page, seq, {_SPACED.format(x='''translate(ref, 'aeiou', '1234 ')''')} AS text FROM pairs")
_add("diacritic_fold", lambda s, sf: V.lines(s, sf).select("page", "seq", T.fold_diacritics(c("line")).alias("text")), f"WITH {V.V_LINES} SELECT page, seq, translate(line, '{T.FOLD_FROM}', '{T.FOLD_TO}') AS text FROM lines")
_add("positional_zip", _on(lambda p: evaluate.zipped(p.select("page", c("seq").alias("k"), "a"), p.select("page", c("seq").alias("k"), "v")).filter("a = v").groupBy("page").agg(F.count("*").alias("same")), V.triples), f"{_T3} SELECT page, count(*) AS same FROM triples WHERE a = v GROUP BY page")
_add("running_best", lambda s, sf: V.table(s, sf, "events").select("user_id", "event_id", "value", F.coalesce(c("value") < F.min("value").over(W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(True)).alias("best")), "SELECT user_id, event_id, value, coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS best FROM events")
_add("timing_sum", lambda s, sf: evaluate.throughput(V.table(s, sf, "events"), "event_type", "value").withColumns({k: F.round(k, 4) for k in ("mean", "a_second")}), "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(round(sum(value), 4) / count(*), 4) AS mean, round(1000 * count(*) / round(sum(value), 4), 4) AS a_second FROM events GROUP BY 1")
_add("request_metrics", lambda s, sf: V.table(s, sf, "events").groupBy(F.floor(c("value") / 10).alias("bucket")).agg(F.count("*").alias("n")), "SELECT CAST(floor(value / 10) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1")

# ---- curation --------------------------------------------------------------------------------------------------------
_CLASS = r"A-Za-z0-9 .,\n"
_add("charset_strip", lambda s, sf: V.lines(s, sf).select("page", "seq", curate.strip_charset(c("line"), _CLASS).alias("text")), f"WITH {V.V_LINES} SELECT page, seq, regexp_replace(line, '[^{_CLASS}]', '', 'g') AS text FROM lines")
_add("charset_drop", lambda s, sf: V.lines(s, sf).filter(curate.in_charset(c("line"), _CLASS)).select("page", "seq"), f"WITH {V.V_LINES} SELECT page, seq FROM lines WHERE NOT regexp_matches(line, '[^{_CLASS}]')")
_reason = lambda: curate.skip_reason(c("page") % 7 > 0, c("line"), _CLASS)
_add("skip_reasons", lambda s, sf: V.lines(s, sf).groupBy(F.coalesce(_reason(), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n")), f"WITH {V.V_LINES} SELECT CASE WHEN page % 7 = 0 THEN 'missing' WHEN regexp_matches(line, '[^{_CLASS}]') THEN 'charset' WHEN length(line) NOT BETWEEN 1 AND 100 THEN 'length' ELSE 'kept' END AS reason, count(*) AS n FROM lines GROUP BY 1")
_add("charset_subset", lambda s, sf: V.lines(s, sf).select("page", "seq", F.size(F.array_except(F.split("line", ""), F.split(F.lit("abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ.,"), ""))).cast("bigint").alias("n_outside")), f"WITH {V.V_LINES} SELECT page, seq, len(list_filter(list_distinct(string_split(line, '')), lambda ch: strpos('abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ.,', ch) = 0)) AS n_outside FROM lines")
_add("length_filter", lambda s, sf: V.lines(s, sf).filter(F.length("line").between(1, 100)).select("page", "seq"), f"WITH {V.V_LINES} SELECT page, seq FROM lines WHERE length(line) BETWEEN 1 AND 100")
_add("ordered_split", lambda s, sf: curate.ordered_split(V.table(s, sf, "documents").select("doc_id"), "doc_id", "42"), "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '42'), doc_id) AS k, count(*) OVER () AS t FROM documents) SELECT doc_id, CASE WHEN k <= t - t * 5 // 100 - t * 5 // 100 THEN 'train' WHEN k <= t - t * 5 // 100 THEN 'val' ELSE 'test' END AS split FROM n")
_add("oversample_union", lambda s, sf: curate.oversample(V.table(s, sf, "documents").select("doc_id", F.lit("auto").alias("kind")), V.table(s, sf, "labels").select("doc_id", F.lit("verified").alias("kind"))), "SELECT doc_id, 'auto' AS kind FROM documents UNION ALL SELECT doc_id, 'verified' AS kind FROM labels, range(4)")
_add("image_exists_semi", lambda s, sf: curate.with_files(V.table(s, sf, "documents").select("doc_id", "lang"), V.table(s, sf, "labels"), "doc_id"), "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
_add("missing_page_error", lambda s, sf: V.table(s, sf, "documents").select("doc_id").join(V.table(s, sf, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.when(c("quality").isNull(), "page missing").alias("error")), "SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'page missing' END AS error FROM documents d LEFT JOIN labels USING (doc_id)")
_add("valid_rows", lambda s, sf: curate.without_errors(V.table(s, sf, "events").select("event_id", F.when(c("event_id") % 5 == 0, "timeout").alias("error"))).select("event_id"), "SELECT event_id FROM events WHERE event_id % 5 <> 0")
_add("confidence_gate", lambda s, sf: _lines(s, sf).filter(curate.all_confident(c("ps"), 0.27)).select("vec_id"), f"WITH {V.V_STEPS} SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM emitted WHERE p < 0.27)")
_add("review_routing", lambda s, sf: V.table(s, sf, "events").select("event_id", curate.review_route(c("value") % 1).alias("route")), "SELECT event_id, CASE WHEN value % 1 > 0.95 THEN 'accept' WHEN value % 1 >= 0.7 THEN 'flag' ELSE 'review' END AS route FROM events")
_add("number_predicate", lambda s, sf: V.lines(s, sf).select("page", "seq", F.regexp_extract("line", r"^(\S+)", 1).rlike(r"^-?[\d\s]+$").alias("number"), c("line").rlike(r"^\d+\s*\(\d+\)$").alias("marker")), rf"WITH {V.V_LINES} SELECT page, seq, regexp_matches(regexp_extract(line, '^(\S+)', 1), '^-?[\d\s]+$') AS number, regexp_matches(line, '^\d+\s*\(\d+\)$') AS marker FROM lines")
_add("seeded_sample", lambda s, sf: curate.seeded_order(V.table(s, sf, "documents").select("doc_id"), "doc_id", "7", 25), "SELECT doc_id FROM documents ORDER BY md5(doc_id || '7'), doc_id LIMIT 25")
_add("target_mix", lambda s, sf: curate.sample_mix(V.table(s, sf, "documents").select("doc_id", "lang"), "doc_id", {"en": 0.5, "de": 0.4, "fr": 0.1}, "lang"), "SELECT doc_id, lang FROM (SELECT doc_id, lang, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents) WHERE u < CASE lang WHEN 'en' THEN 0.5 WHEN 'de' THEN 0.4 WHEN 'fr' THEN 0.1 ELSE 0 END")
_add("gray16_to_8", lambda s, sf: V.table(s, sf, "events").select("event_id", readers.byte_of(c("event_id") * 977 % 65536).alias("v")), "SELECT event_id, CAST((event_id * 977 % 65536) >> 8 AS INTEGER) AS v FROM events")
_add("ocr_confidence", lambda s, sf: V.table(s, sf, "events").select("event_id", decode.from_percent(c("event_id") % 120 - 10).alias("p")), "SELECT event_id, greatest(event_id % 120 - 10, 0) / 100.0::DOUBLE AS p FROM events")


# ---- comparison, errors and display --------------------------------------------------------------------------------------
_add("agreement_by_page", _on(evaluate.agreement_by_page, V.triples), f"{_T3} SELECT page, count(*) AS n, {_n('a = b')} AS agree, round(100 * {_n('a = b')} / count(*)::DOUBLE, 6) AS percent FROM triples GROUP BY page")
_MISREAD = lambda p: p.withColumns({"a": F.replace(F.replace("ref", F.lit("e"), F.lit("O84")), F.lit("Reserv"), F.lit("Reseryv")), "b": F.replace("ref", F.lit("e"), F.lit("084"))})
_add(
    "known_errors",
    _on(lambda p: _MISREAD(p).select("page", "seq", curate.known_error(c("a"), c("b")).alias("reason"))),
    f"""{_P}, m AS (SELECT page, seq, replace(replace(ref, 'e', 'O84'), 'Reserv', 'Reseryv') AS a, replace(ref, 'e', '084') AS b FROM pairs)
SELECT page, seq, CASE WHEN a = b THEN NULL WHEN contains(a, 'O84') AND contains(b, '084') THEN 'O vs 0' WHEN contains(a, '5356300') AND contains(b, '556500') THEN 'wrong org.nr' WHEN contains(a, 'Reseryv') AND contains(b, 'Reserv') THEN 'typo'
  WHEN contains(a, 'Icasing') AND contains(lower(b), 'leasing') THEN 'I vs l' WHEN contains(a, 'f2 14') OR contains(a, '12-75') OR contains(a, '12- /4') THEN 'wrong date' END AS reason FROM m""",
)
_PAIRS = ", ".join(f"('{x}', '{y}', '{x}{y}')" for x, y in evaluate.CONFUSION_PAIRS)
_add(
    "confusion_pairs",
    lambda s, sf: evaluate.confusion_rates(V.pairs(s, sf).withColumn("hyp", F.translate("ref", "äöÄÖ", "aoAØ"))),
    f"""{_P}, ch AS (SELECT unnest(string_split(ref, '')) AS r, unnest(string_split(translate(ref, 'äöÄÖ', 'aoAØ'), '')) AS h FROM pairs),
n AS (SELECT r, h, count(*) AS n FROM ch GROUP BY 1, 2), k(x, y, pair) AS (VALUES {_PAIRS}),
s AS (SELECT pair, coalesce(sum(n), 0) AS total, coalesce(sum(CASE WHEN (r = x AND h = y) OR (r = y AND h = x) THEN n END), 0) AS confused FROM k LEFT JOIN n ON r = x OR r = y GROUP BY pair)
SELECT pair, CAST(total AS BIGINT) AS total, CAST(confused AS BIGINT) AS confused, round(CASE WHEN total > 0 THEN confused / total::DOUBLE ELSE 0 END, 6) AS rate FROM s""",
)
_add("nordic_cer", _on(evaluate.nordic_cer))
_add("display_text", lambda s, sf: V.lines(s, sf).select("page", "seq", evaluate.display(c("line"), 20).alias("text")), f"WITH {V.V_LINES} SELECT page, seq, left(trim(line), 20) AS text FROM lines")
_add("page_union", lambda s, sf: V.lines(s, sf).select("page", "seq").unionAll(V.jitter(s, sf).select("page", "seq")), f"WITH {V.V_JITTER} SELECT page, seq FROM lines UNION ALL SELECT page, seq FROM jitter")
_add("sibling_arrays", lambda s, sf: evaluate.siblings(V.table(s, sf, "documents").select("doc_id", F.split("text", "\n").alias("a"), F.split("lang", "").alias("b")), "a", "b").select("doc_id", "k", F.length("a").cast("bigint").alias("a"), "b"), "SELECT doc_id, CAST(k AS INTEGER) AS k, length(a[k + 1]) AS a, b[k + 1] AS b FROM (SELECT doc_id, a, b, unnest(range(0, greatest(len(a), len(b)))) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS a, string_split(lang, '') AS b FROM documents))")
_add("gathered_results", lambda s, sf: evaluate.gathered(V.jitter(s, sf).select("page", "seq", c("w").alias("read")), V.regions(s, sf).select("page", "seq"), ["page", "seq"]), f"WITH {V.V_JITTER} SELECT r.page, r.seq, j.w AS read FROM regions r LEFT JOIN jitter j ON j.page = r.page AND j.seq = r.seq")
_add("eta", lambda s, sf: V.table(s, sf, "events").select("event_id", evaluate.progress(c("event_id") % 50, F.lit(50), c("value")).alias("p")).select("event_id", F.round("p.rate", 6).alias("rate"), F.floor("p.eta").alias("eta")), "SELECT event_id, round(CASE WHEN value > 0 THEN event_id % 50 / value ELSE 0 END, 6) AS rate, CAST(floor(CASE WHEN value > 0 AND event_id % 50 > 0 THEN (50 - event_id % 50) / (event_id % 50 / value) ELSE 0 END) AS BIGINT) AS eta FROM events")
_LETTERS = " ab"
_text = lambda s, sf: _lines(s, sf).withColumn("text", decode.text_of(c("tokens"), _LETTERS))
_add(
    "trimmed_lines",
    lambda s, sf: decode.strip_spaces(decode.trim_trailing(_text(s, sf))).select("vec_id", "text", F.size("ps").cast("bigint").alias("n"), F.round("confidence", 6).alias("confidence")),
)
_add("decoded_text", lambda s, sf: _text(s, sf).select("vec_id", "text"), f"WITH {V.V_STEPS} SELECT e.vec_id, coalesce(string_agg(substr('{_LETTERS}', CAST(token + 1 AS INTEGER), 1), '' ORDER BY pos), '') AS text FROM embeddings e LEFT JOIN emitted m USING (vec_id) GROUP BY e.vec_id")
_add("near_width_batches", lambda s, sf: regions.near_width_batches(_plan(s, sf), 32).select("page", "seq", "line_w", "chunk"))


# ---- cuts within a component, its profile given --------------------------------------------------------------------------


def _profiles(s: SparkSession, sf: str) -> DataFrame:
    """doc_id, profile: ink by row of a made-up component, from a document's first bytes on, all of them."""
    h = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: (i * (c("doc_id") % 7 + 3) + c("doc_id")) % 41)
    return V.table(s, sf, "documents").select("doc_id", h.alias("profile"))


_add("split_cuts", lambda s, sf: raster.cuts_of(_profiles(s, sf), "doc_id"), """WITH p AS (SELECT doc_id, i, (i * (doc_id % 7 + 3) + doc_id) % 41 AS n FROM documents, range(0, 60) r(i)),
q AS (SELECT *, max(n) OVER (PARTITION BY doc_id) AS top FROM p), v AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM q WHERE top > 0 AND n <= CAST(floor(0.3::DOUBLE * top) AS BIGINT) AND i >= 12 AND i < 48)
SELECT doc_id, (min(i) + max(i) + 1) // 2 AS cut FROM v GROUP BY doc_id, g""")
