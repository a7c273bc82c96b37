"""Region operators on tables with page, seq, x, y, w, h (and ang)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagemill.functions.groups import whole_groups
from pagemill.operators.curate import positions

PAGE_W, PAGE_H = 2480, 3508
c = F.col


def size_ok(min_w: int = 20, min_h: int = 24) -> Column:
    return (c("w") >= min_w) & (c("h") >= min_h)


def margin_ok(left: int = 140, top: int = 120, right: int = 140, bottom: int = 140, page_w: int = PAGE_W, page_h: int = PAGE_H) -> Column:
    """A region that begins in the left or top margin stays if at least half of it lies inside; zero turns a side off."""
    inside = lambda at, size, m: (c(at) >= m) | ((c(at) + c(size) - m >= 0) & (c(at) + c(size) - m >= 0.5 * c(size)))
    ok = F.lit(True)
    if left:
        ok = ok & inside("x", "w", left)
    if right:
        ok = ok & (c("x") <= page_w - right)
    if top:
        ok = ok & inside("y", "h", top)
    if bottom:
        ok = ok & (c("y") <= page_h - bottom)
    return ok


def rotation_ok(tolerance: float = 4) -> Column:
    between = lambda a: (a > tolerance) & (a < 90 - tolerance)
    return ~(between(c("ang")) | between(180 - c("ang")))


def pad(df: DataFrame, by: int = 8, page_w: int = PAGE_W, page_h: int = PAGE_H) -> DataFrame:
    x, y = F.greatest(c("x") - by, F.lit(0)), F.greatest(c("y") - by, F.lit(0))
    return df.withColumns({"w": F.least(c("w") + 2 * by, page_w - x), "h": F.least(c("h") + 2 * by, page_h - y), "x": x, "y": y})


def geometry(df: DataFrame) -> DataFrame:
    return df.withColumns({"area": c("w") * c("h"), "cx": c("x") + c("w") / 2, "cy": c("y") + c("h") / 2, "right": c("x") + c("w"), "bottom": c("y") + c("h")})


def rectangle() -> Column:
    """The region's corners, clockwise from the top left."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, r, b = c("x"), c("y"), c("x") + c("w"), c("y") + c("h")
    return F.array(at(x, y), at(r, y), at(r, b), at(x, b))


def envelope(polygon: Column) -> dict[str, Column]:
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return {"x": F.array_min(xs), "y": F.array_min(ys), "w": F.array_max(xs) - F.array_min(xs), "h": F.array_max(ys) - F.array_min(ys)}


def expand(df: DataFrame, ratio: float = 1.5) -> DataFrame:
    """Grow about the centre; x and y stop at 0, the size doesn't shrink."""
    nw, nh = c("w") * ratio, c("h") * ratio
    return df.withColumns({"x": F.greatest(c("x") + c("w") / 2 - nw / 2, F.lit(0.0)), "y": F.greatest(c("y") + c("h") / 2 - nh / 2, F.lit(0.0)), "w": nw, "h": nh})


def reading_order(df: DataFrame) -> DataFrame:
    return df.withColumn("ord", (F.row_number().over(W.partitionBy("page").orderBy("y", "x", "seq")) - 1).cast("bigint"))


def assign_rows(df: DataFrame, tolerance: float = 20.0, min_h: int = 20) -> DataFrame:
    """Row numbers: in order of y-centre a region joins the current row if it is within ``tolerance`` of the row's running mean.

    Regions of under ``min_h`` get null.  One fold a page over its sorted
    regions; a page's regions are what one task holds.
    """
    able = df.filter(c("h") >= min_h)
    items = F.array_sort(F.collect_list(F.struct((c("y") + c("h") / 2).alias("yc"), c("y").alias("y0"), c("x").alias("x0"), c("seq").alias("s"))))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("n"), F.lit(-1).alias("row"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, i: Column) -> Column:
        joins = (a["n"] > 0) & (F.abs(i["yc"] - a["sum"] / F.greatest(a["n"], F.lit(1.0))) <= tolerance)
        row = F.when(joins, a["row"]).otherwise(a["row"] + 1)
        return F.struct(
            F.when(joins, a["sum"] + i["yc"]).otherwise(i["yc"]).alias("sum"), F.when(joins, a["n"] + 1.0).otherwise(F.lit(1.0)).alias("n"),
            row.alias("row"), F.concat(a["out"], F.array(row)).alias("out"),
        )

    rows = able.groupBy("page").agg(items.alias("_i")).withColumn("_o", F.aggregate("_i", start, step)["out"])
    flat = rows.select("page", F.explode(F.arrays_zip(F.col("_i.s").alias("seq"), F.col("_o").alias("row"))).alias("_z")).select("page", F.col("_z.seq").alias("seq"), F.col("_z.row").cast("bigint").alias("row"))
    return df.join(flat, ["page", "seq"], "left")


def columns(df: DataFrame) -> DataFrame:
    at = F.row_number().over(W.partitionBy("page", "row").orderBy("x", "seq")) - 1
    return df.withColumn("col", F.when(c("row").isNotNull(), at).cast("bigint"))


def clusters(df: DataFrame, gap: float = 80) -> DataFrame:
    """Cluster numbers of rows: a new one where a row starts more than ``gap`` below the end of the row before."""
    rows = df.filter("row is not null").groupBy("page", "row").agg(F.min("y").alias("_top"), F.max(c("y") + c("h")).alias("_end"))
    w = W.partitionBy("page").orderBy("row")
    jump = F.when(c("_top") - F.lag("_end").over(w) > gap, 1).otherwise(0)
    numbered = rows.withColumn("_jump", jump).withColumn("cluster", F.sum("_jump").over(w).cast("bigint")).select("page", "row", "cluster")
    return df.join(numbered, ["page", "row"], "left")


def filter_and_cluster(df: DataFrame, padding: int = 8) -> DataFrame:
    """From components (page, seq, x, y, w, h, ang, page_w, page_h) to text regions: those of a fit size, place and angle, padded, with ord (top down, then left to right), row, col and cluster."""
    w, h = c("page_w"), c("page_h")
    kept = df.filter(size_ok() & margin_ok(page_w=w, page_h=h) & rotation_ok())
    return clusters(columns(assign_rows(reading_order(pad(kept, padding, w, h)))))


def iou(a: str = "a", b: str = "b") -> Column:
    """Intersection over union of the boxes in struct columns."""
    side = lambda p, s: F.least(c(f"{a}.{p}") + c(f"{a}.{s}"), c(f"{b}.{p}") + c(f"{b}.{s}")) - F.greatest(c(f"{a}.{p}"), c(f"{b}.{p}"))
    w, h = side("x", "w"), side("y", "h")
    both = F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0))
    union = c(f"{a}.w") * c(f"{a}.h") + c(f"{b}.w") * c(f"{b}.h") - both
    return F.when((both > 0) & (union > 0), both.cast("double") / union).otherwise(F.lit(0.0))


def radius_pairs(left: DataFrame, right: DataFrame, radius: float = 100.0) -> DataFrame:
    """page, lseq, rseq, dist of regions whose centres are nearer than ``radius``.

    The page is dealt into cells of the radius; a left region looks into the
    nine cells around its own, so that the join is an equi-join.
    """
    mid = lambda df, s: df.select("page", c("seq").alias(f"{s}seq"), (c("x") + c("w") / 2).alias(f"{s}x"), (c("y") + c("h") / 2).alias(f"{s}y"))
    cell = lambda v: F.floor(c(v) / radius)
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    lt = mid(left, "l").withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near)).withColumn("_gx", cell("lx") + c("_dx")).withColumn("_gy", cell("ly") + c("_dy"))
    rt = mid(right, "r").withColumn("_gx", cell("rx")).withColumn("_gy", cell("ry"))
    d = F.sqrt((c("lx") - c("rx")) ** 2 + (c("ly") - c("ry")) ** 2)
    return lt.join(rt, ["page", "_gx", "_gy"]).withColumn("dist", d).filter(c("dist") < radius).select("page", "lseq", "rseq", "dist")


def overlap_pairs(left: DataFrame, right: DataFrame, cell_w: int = 256, cell_h: int = 64) -> DataFrame:
    """page, lseq, rseq, a, b (boxes) of regions that overlap.

    A region enters every cell of a grid that it touches, so that the join is
    an equi-join; a pair is given by the cell of its intersection's corner only.
    """

    def cells(df: DataFrame, seq: str, box: str) -> DataFrame:
        span = lambda at, size, cell: F.sequence(F.floor(c(at) / cell), F.floor((c(at) + c(size)) / cell))
        d = df.select("page", c("seq").alias(seq), F.struct("x", "y", "w", "h").alias(box), F.explode(span("x", "w", cell_w)).alias("_gx"), *[c(k) for k in "yh"])
        return d.withColumn("_gy", F.explode(span("y", "h", cell_h))).drop("y", "h")

    d = cells(left, "lseq", "a").join(cells(right, "rseq", "b"), ["page", "_gx", "_gy"])
    corner = (F.floor(F.greatest("a.x", "b.x") / cell_w) == c("_gx")) & (F.floor(F.greatest("a.y", "b.y") / cell_h) == c("_gy"))
    apart = lambda p, s: F.least(c(f"a.{p}") + c(f"a.{s}"), c(f"b.{p}") + c(f"b.{s}")) <= F.greatest(c(f"a.{p}"), c(f"b.{p}"))
    return d.filter(corner & ~apart("x", "w") & ~apart("y", "h")).select("page", "lseq", "rseq", "a", "b")


def _first_free(page: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of edges in their order of preference those that a pass takes which takes an edge if both its ends are free.

    An edge that is the first one left for both its ends is taken, whatever
    comes in between: all of those go at once, until no edge is left.
    """
    ends = [np.unique(np.stack([page, side]), axis=1, return_inverse=True)[1].ravel() for side in (left, right)]
    live, taken = np.arange(len(page)), []
    while len(live):
        best = np.ones(len(live), bool)
        for end in ends:
            first = np.zeros(len(live), bool)
            first[np.unique(end[live], return_index=True)[1]] = True
            best &= first
        hit = live[best]
        taken.append(hit)
        for end in ends:
            live = live[~np.isin(end[live], end[hit])]
    return np.sort(np.concatenate(taken)) if taken else live


def _matched(pairs: DataFrame, order: list[str]) -> DataFrame:
    """One-to-one matches by page, edges taken in the order given; many pages at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(it, "page"):
            col = {k: t.column(k).to_numpy() for k in ("page", "lseq", "rseq", "dist")}
            keep = _first_free(col["page"], col["lseq"], col["rseq"])
            yield pa.RecordBatch.from_arrays([pa.array(v[keep]) for v in col.values()], list(col))

    rows = pairs.repartition("page").sortWithinPartitions("page", *order).select("page", "lseq", "rseq", "dist")
    return rows.mapInArrow(run, "page long, lseq long, rseq long, dist double")


def greedy_match(pairs: DataFrame) -> DataFrame:
    """One-to-one matches by page: nearest pairs first, ties by left then right number."""
    return _matched(pairs, ["dist", "lseq", "rseq"])


def sequential_match(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """Each left region, by the order given (page, lseq, ord), takes its nearest right region that is still free."""
    return _matched(pairs.join(order, ["page", "lseq"]), ["ord", "lseq", "dist", "rseq"])


def detection_scores(matches: DataFrame, n_found: DataFrame, n_true: DataFrame) -> DataFrame:
    """tp, precision, recall, f1 from one-to-one matches and both sides' regions; 0 where a side is empty."""
    n = lambda df, k: df.agg(F.count("*").alias(k))
    d = n(matches, "tp").crossJoin(n(n_found, "n_found")).crossJoin(n(n_true, "n_true"))  # three single rows
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return d.select("tp", share(c("tp"), c("n_found")).alias("precision"), share(c("tp"), c("n_true")).alias("recall"), share(2 * c("tp"), c("n_found") + c("n_true")).alias("f1"))


def largest(df: DataFrame, by: Column, n: int = 1000) -> DataFrame:
    """Each page's ``n`` regions of greatest ``by``, ties to smaller numbers."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy("page").orderBy(F.desc(by), "seq"))).filter(c("_k") <= n).drop("_k")


def disorders(df: DataFrame, value: str = "y") -> DataFrame:
    """How many regions in the order ``ord`` lie above the one before them: 0 for a sorted page."""
    before = F.lag(value).over(W.partitionBy("page").orderBy("ord"))
    return df.withColumn("_b", before).agg(F.coalesce(F.sum((c("_b") > c(value)).cast("bigint")), F.lit(0)).alias("disorders"))


def width_plan(df: DataFrame, line_h: int = 32, cap: int = 1792) -> DataFrame:
    """The width at which a line of height ``line_h`` is read: a multiple of 4 between 4 and ``cap``."""
    w = F.greatest(F.round(c("w") * line_h / c("h")).cast("bigint"), F.lit(4))
    return df.withColumn("line_w", F.greatest(F.least(w - w % 4, F.lit(cap)), F.lit(4)).cast("bigint"))


def width_batches(df: DataFrame, size: int = 64) -> DataFrame:
    """Batches of ``size`` lines of like width, numbered over the whole input: batch, batch_w, item_w."""
    d = positions(df, ["line_w", "page", "seq"]).withColumn("batch", F.floor((c("n") - 1) / size).cast("bigint")).drop("n")
    d = d.withColumn("batch_w", F.max("line_w").over(W.partitionBy("batch")))
    return d.withColumn("item_w", F.least("line_w", "batch_w"))


def equal_width_batches(df: DataFrame, size: int = 64) -> DataFrame:
    """``chunk``: batches of ``size`` lines of one width, numbered by width; a line's place is its overall one less that of its width's first."""
    d = positions(df, ["line_w", "page", "seq"])
    first = d.groupBy("line_w").agg(F.min("n").alias("_first"))
    return d.join(first, "line_w").withColumn("chunk", F.floor((c("n") - c("_first")) / size).cast("bigint")).drop("n", "_first")


def near_width_batches(df: DataFrame, variance: int, size: int = 64) -> DataFrame:
    """``chunk`` by page: in order of width a line joins the current batch while that has fewer than ``size`` lines and the line is at most ``variance`` wider than its first.

    One fold a page over its sorted lines.
    """
    items = F.array_sort(F.collect_list(F.struct("line_w", c("seq").alias("s"))))
    start = F.struct(F.lit(0).cast("bigint").alias("base"), F.lit(0).alias("n"), F.lit(-1).alias("chunk"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, i: Column) -> Column:
        joins = (a["n"] > 0) & (a["n"] < size) & (i["line_w"] - a["base"] <= variance)
        chunk = F.when(joins, a["chunk"]).otherwise(a["chunk"] + 1)
        return F.struct(F.when(joins, a["base"]).otherwise(i["line_w"].cast("bigint")).alias("base"), F.when(joins, a["n"] + 1).otherwise(F.lit(1)).alias("n"), chunk.alias("chunk"), F.concat(a["out"], F.array(chunk)).alias("out"))

    rows = df.groupBy("page").agg(items.alias("_i")).withColumn("_o", F.aggregate("_i", start, step)["out"])
    flat = rows.select("page", F.explode(F.arrays_zip(c("_i.s").alias("seq"), c("_o").alias("chunk"))).alias("_z"))
    return df.join(flat.select("page", c("_z.seq").alias("seq"), c("_z.chunk").cast("bigint").alias("chunk")), ["page", "seq"])
