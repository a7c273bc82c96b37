"""Raster kernels on uint8 numpy pages, and ``on_pages`` to run them over a table of pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gray(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., i].astype(np.int64) for i in range(3))
    return (77 * r + 150 * g + 29 * b >> 8).astype(np.uint8)


def _along(a: np.ndarray, axis: int, before: int, after: int, reduce, fill=None) -> np.ndarray:
    """Reduce a window along an axis; outside the page: the edge, or ``fill``."""
    wide = [(0, 0)] * a.ndim
    wide[axis] = (before, after)
    p = np.pad(a, wide, mode="edge") if fill is None else np.pad(a, wide, constant_values=fill)
    return reduce(np.lib.stride_tricks.sliding_window_view(p, before + after + 1, axis=axis))


def blur(g: np.ndarray, size: int = 5) -> np.ndarray:
    """Binomial, rows then columns, truncated after each."""
    if size < 3 or not g.size:
        return g.copy()
    k = np.array([1, 4, 6, 4, 1])
    out = g.astype(np.int64)
    for axis in (1, 0):
        out = _along(out, axis, 2, 2, lambda w: (w * k).sum(-1) // 16)
    return out.astype(np.uint8)


def integral(g: np.ndarray) -> np.ndarray:
    return g.astype(np.int64).cumsum(0).cumsum(1)


def _box(g: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the pixels of the block about each pixel, clipped to the page."""
    s = np.pad(integral(g), ((1, 0), (1, 0)))
    r = block // 2
    h, w = g.shape
    y0, y1 = np.maximum(np.arange(h) - r, 0), np.minimum(np.arange(h) + r + 1, h)
    x0, x1 = np.maximum(np.arange(w) - r, 0), np.minimum(np.arange(w) + r + 1, w)
    total = s[np.ix_(y1, x1)] - s[np.ix_(y0, x1)] - s[np.ix_(y1, x0)] + s[np.ix_(y0, x0)]
    return total, np.outer(y1 - y0, x1 - x0)


def adaptive_threshold(g: np.ndarray, block: int = 15, c: float = 4.0) -> np.ndarray:
    total, n = _box(g, block)
    return np.where(g <= total / n - c, 255, 0).astype(np.uint8)


def sauvola(g: np.ndarray, window: int = 31, k: float = 0.2, r: float = 128.0) -> np.ndarray:
    total, n = _box(g, window)
    squares, _ = _box(g.astype(np.int64) ** 2, window)
    m = total / n
    s = np.sqrt(np.maximum(squares / n - m * m, 0))
    return np.where(g > m * (1 + k * (s / r - 1)), 255, 0).astype(np.uint8)


def dilate_h(g: np.ndarray, k: int = 20, symmetric: bool = False) -> np.ndarray:
    before, after = (k // 2, k // 2) if symmetric else ((k - 1) // 2, k // 2)
    return g.copy() if not k or not g.size else _along(g, 1, before, after, lambda w: w.max(-1), 0)


def dilate_v(g: np.ndarray, k: int = 3, symmetric: bool = False) -> np.ndarray:
    return dilate_h(g.T, k, symmetric).T.copy()


def dilate(g: np.ndarray, k_h: int = 20, k_v: int = 3, iterations: int = 2) -> np.ndarray:
    for _ in range(iterations):
        g = dilate_v(dilate_h(g, k_h), k_v)
    return g


def dilate_rect(g: np.ndarray, k: int = 3) -> np.ndarray:
    return _along(_along(g, 1, k // 2, k // 2, lambda w: w.max(-1)), 0, k // 2, k // 2, lambda w: w.max(-1))


def erode_rect(g: np.ndarray, k: int = 3) -> np.ndarray:
    return 255 - dilate_rect(255 - g, k)


def opened(g: np.ndarray, k: int = 3) -> np.ndarray:
    return dilate_rect(erode_rect(g, k), k)


def closed(g: np.ndarray, k: int = 3) -> np.ndarray:
    return erode_rect(dilate_rect(g, k), k)


def _patches(g: np.ndarray, r: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(g, r, mode="edge"), (2 * r + 1, 2 * r + 1))


def median3(g: np.ndarray) -> np.ndarray:
    return np.sort(_patches(g, 1).reshape(*g.shape, 9), axis=-1)[..., 4]


#: 5 x 5 Gaussian weights, sum 273 (fixed values).
GAUSS = np.array([[1, 4, 7, 4, 1], [4, 16, 26, 16, 4], [7, 26, 41, 26, 7], [4, 16, 26, 16, 4], [1, 4, 7, 4, 1]])


def _shifted(g: np.ndarray, r: int, fill=None):
    """The page seen from each offset of a (2 r + 1)-square window: dy, dx and the neighbours; outside the edge, or ``fill``."""
    p = np.pad(g, r, mode="edge") if fill is None else np.pad(g, r, constant_values=fill)
    h, w = g.shape
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            yield dy, dx, p[r + dy : r + dy + h, r + dx : r + dx + w]


def gauss5(g: np.ndarray) -> np.ndarray:
    total = np.zeros(g.shape, np.int64)
    for dy, dx, v in _shifted(g.astype(np.int64), 2):
        total += GAUSS[dy + 2, dx + 2] * v
    return (total // 273).astype(np.uint8)


def bilateral(g: np.ndarray, r: int = 3, sigma_s: float = 3.0, sigma_r: float = 30.0) -> np.ndarray:
    """Neighbours outside the page don't count; one page-sized temporary an offset at a time."""
    own = g.astype(np.float64)
    total, weight = np.zeros(g.shape), np.zeros(g.shape)
    for dy, dx, v in _shifted(own, r, np.nan):
        w = np.exp(-(dy * dy + dx * dx) / (2 * sigma_s**2) - (v - own) ** 2 / (2 * sigma_r**2))
        there = ~np.isnan(w)
        total[there] += (w * v)[there]
        weight[there] += w[there]
    return np.clip(total / weight, 0, 255).astype(np.uint8)


def profile(b: np.ndarray) -> np.ndarray:
    """Black pixels by row."""
    return (b == 0).sum(axis=1)


def rotate(g: np.ndarray, degrees: float) -> np.ndarray:
    """About the centre, bilinear; a neighbour outside the page counts as white."""
    h, w = g.shape
    t = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w]
    cy, cx = h / 2, w / 2
    sx, sy = np.cos(t) * (x - cx) + np.sin(t) * (y - cy) + cx, -np.sin(t) * (x - cx) + np.cos(t) * (y - cy) + cy
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0
    wide = np.pad(g.astype(float), 1, constant_values=255)
    at = lambda dy, dx: wide[np.clip(y0 + dy, -1, h) + 1, np.clip(x0 + dx, -1, w) + 1]
    v = at(0, 0) * (1 - fx) * (1 - fy) + at(0, 1) * fx * (1 - fy) + at(1, 0) * (1 - fx) * fy + at(1, 1) * fx * fy
    return np.clip(v, 0, 255).astype(np.uint8)


def rotated_profile(b: np.ndarray, degrees: float) -> np.ndarray:
    """``profile`` of the page turned by ``degrees``, from the ink's coordinates alone: no page is turned."""
    y, x = np.nonzero(b == 0)
    t = np.deg2rad(degrees)
    h, w = b.shape
    row = np.floor(np.sin(t) * (x - w / 2) + np.cos(t) * (y - h / 2) + h / 2 + 0.5).astype(np.int64)
    return np.bincount(row[(row >= 0) & (row < h)], minlength=h)


def skew(b: np.ndarray, most: float = 5.0, step: float = 0.1) -> float:
    """The angle whose row profile varies most, the smallest of equals."""
    angles = np.arange(-round(most / step), round(most / step) + 1) * step
    angles = angles[np.argsort(np.abs(angles), kind="stable")]
    return float(angles[int(np.argmax([rotated_profile(b, a).var() for a in angles]))])


def deskew(b: np.ndarray, least: float = 0.3) -> np.ndarray:
    a = skew(b)
    return rotate(b, a) if abs(a) >= least else b


def label(b: np.ndarray) -> np.ndarray:
    """4-connected components of pixels above 0, numbered from 1 in the order of their first pixel; 0 elsewhere."""
    h, w = b.shape
    if not b.size:
        return np.zeros((h, w), np.int64)
    fg = b > 0
    edge = np.diff(fg.astype(np.int8), axis=1, prepend=0)
    run = np.where(fg, (edge == 1).ravel().cumsum().reshape(h, w), 0)
    up, down = run[:-1][fg[:-1] & fg[1:]], run[1:][fg[:-1] & fg[1:]]
    root = np.arange(int(run.max(initial=0)) + 1)
    while True:
        a, c = root[up], root[down]
        low = np.minimum(a, c)
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, c, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return np.unique(np.append(root[run].ravel(), 0), return_inverse=True)[1][:-1].reshape(h, w)


def despeckle(b: np.ndarray, least: int = 10) -> np.ndarray:
    """Black components of fewer than ``least`` pixels turn white."""
    lab = label(255 * (b == 0).astype(np.uint8))
    n = np.bincount(lab.ravel())
    out = b.copy()
    out[(lab > 0) & (n[lab] < least)] = 255
    return out


def preprocess(g: np.ndarray) -> np.ndarray:
    return despeckle(closed(sauvola(deskew(bilateral(g)))))


def components(b: np.ndarray) -> list[dict]:
    """Box, pixel count and orientation (degrees in [0, 180)) of each component."""
    lab = label(b)
    y, x = np.nonzero(lab)
    k = lab[y, x]
    n = np.bincount(k, minlength=1)
    out = []
    mean = lambda v: np.bincount(k, v, len(n)) / np.maximum(n, 1)
    mx, my = mean(x), mean(y)
    m20, m02, m11 = mean(x * x) - mx**2, mean(y * y) - my**2, mean(x * y) - mx * my
    x0, y0, x1, y1 = np.full(len(n), 1 << 30), np.full(len(n), 1 << 30), np.full(len(n), -1), np.full(len(n), -1)
    for f, t, v in ((np.minimum, x0, x), (np.minimum, y0, y), (np.maximum, x1, x), (np.maximum, y1, y)):
        f.at(t, k, v)
    for i in range(1, len(n)):
        a = np.degrees(0.5 * np.arctan2(2 * m11[i], m20[i] - m02[i]))
        out.append({"x": int(x0[i]), "y": int(y0[i]), "w": int(x1[i] - x0[i] + 1), "h": int(y1[i] - y0[i] + 1), "n": int(n[i]), "ang": float(a + 180 if a < 0 else a)})
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches of true, ends exclusive."""
    e = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(e[::2].tolist(), e[1::2].tolist(), strict=True))


def split_cuts(rows: np.ndarray) -> list[int]:
    """Where a component with that many mask pixels in its rows is cut: the middles of the valleys, off the outer fifths; nowhere if it has none."""
    h, most = len(rows), int(rows.max(initial=0))
    margin = h // 5
    start = max(margin, 1)
    low = rows <= int(0.3 * most)
    low[:start] = False
    low[max(h - margin, start + 1) :] = False
    return [(a + b) // 2 for a, b in runs(low)] if most else []


def split_tall(comps: list[dict], mask: np.ndarray, ratio: float = 1.8) -> list[dict]:
    """Cut components much taller than the upper median where the (dilated) mask has valleys."""
    heights = sorted(c["h"] for c in comps if c["h"] >= 10)
    if len(comps) < 3 or len(heights) < 3:
        return comps
    mid = heights[len(heights) // 2]
    out = []
    for c in comps:
        if c["h"] <= ratio * mid or c["h"] < 10 or c["w"] < 5:
            out.append(c)
            continue
        rows = (mask[c["y"] : c["y"] + c["h"], c["x"] : c["x"] + c["w"]] > 0).sum(1)
        cuts = split_cuts(rows)
        pieces = [(a, b) for a, b in zip([0, *cuts], [*cuts, c["h"]], strict=True) if b - a >= 5]
        out += [{**c, "y": c["y"] + a, "h": b - a, "n": int(rows[a:b].sum())} for a, b in pieces] if cuts else [c]
    return out


def words_of(columns: np.ndarray, gap: int = 4) -> list[list[int]]:
    """Stretches of columns with ink, those less than ``gap`` apart joined; ends exclusive."""
    words: list[list[int]] = []
    for a, b in runs(columns):
        if words and a - words[-1][1] < gap:
            words[-1][1] = b
        else:
            words.append([a, b])
    return words


def trimmed_span(box: np.ndarray) -> tuple[int, int] | None:
    """The columns of a component's ink that stay once a small word at either end that sits off the line or far from the rest is cut; None if all stay.

    What is checked on the right is measured from the left cut on.
    """
    h, w = box.shape
    words = words_of(box.any(axis=0))
    if w < 60 or h < 5 or len(words) < 2:
        return None
    first, last, inner = words[0], words[-1], words[-2]
    start, end = first[0], last[1]
    small = lambda edge, body: edge[1] - edge[0] <= 80 and body >= 32 and 4 * (edge[1] - edge[0]) < body

    def off_line(edge: list[int], a: int, b: int) -> bool:
        middles = [np.nonzero(box[:, p:q])[0] for p, q in (edge, (a, b))]
        return all(len(m) for m in middles) and abs(np.float32(middles[0].mean()) - np.float32(middles[1].mean())) > max(h / 8, 4)

    if small(first, last[1] - words[1][0]) and off_line(first, words[1][0], last[1]):
        start = words[1][0]
    if small(last, inner[1] - start) and off_line(last, start, inner[1]):
        end = inner[1]
    gaps = [b[0] - a[1] for a, b in zip(words, words[1:])]
    widest = max(gaps)
    at = len(gaps) - 1 - gaps[::-1].index(widest)  # the last of the widest
    second = max((g for i, g in enumerate(gaps) if i != at), default=0)
    if widest >= 4 and not 2 * widest < 3 * second:
        if start == first[0] and at == 0 and small(first, last[1] - words[1][0]):
            start = words[1][0]
        if end == last[1] and at == len(gaps) - 1 and small(last, inner[1] - start):
            end = inner[1]
    return (start, end) if end - start >= 32 and (start > first[0] or end < last[1]) else None


def trim_edges(comps: list[dict], ink: np.ndarray) -> list[dict]:
    """Cut small words at either end that sit off the line or far from the rest."""
    spans = [trimmed_span(ink[c["y"] : c["y"] + c["h"], c["x"] : c["x"] + c["w"]] > 0) for c in comps]
    return [c if s is None else {**c, "x": c["x"] + s[0], "w": s[1] - s[0]} for c, s in zip(comps, spans, strict=True)]


def lines(g: np.ndarray, ink_below: int = 160) -> list[tuple[int, int, int, int]]:
    """Text lines (x, y, w, h) from the row profile."""
    ink = g < ink_below
    rows = ink.sum(axis=1)
    h, w = g.shape
    found: list[list[int]] = []
    for a, b in runs(rows > max(5, 0.005 * rows.max(initial=0))):
        if found and a - found[-1][1] < 15:
            found[-1][1] = b
        else:
            found.append([a, b])
    out = []
    for a, b in found:
        if b - a < 15:
            continue
        a, b = max(a - 4, 0), min(b + 4, h)
        xs = np.flatnonzero(ink[a:b].any(axis=0))
        if len(xs):
            x0, x1 = max(xs[0] - 4, 0), min(xs[-1] + 5, w)
            out.append((int(x0), a, int(x1 - x0), b - a))
    return out


def crop_line(rgb: np.ndarray, x: float, y: float, w: float, h: float, line_h: int = 32, cap: int = 1792) -> np.ndarray:
    """A region as the recognizer's input: cropped, scaled to ``line_h``, 3 x h x w, -1 to 1."""
    H, W = rgb.shape[:2]
    x0, y0 = int(min(max(x, 0), W)), int(min(max(y, 0), H))
    x1, y1 = int(min(np.ceil(x + w), W)), int(min(np.ceil(y + h), H))
    if x1 <= x0 or y1 <= y0:
        return np.zeros((3, line_h, 4), np.float32)
    cut = rgb[y0:y1, x0:x1].astype(float)
    ch, cw = cut.shape[:2]
    tw = max(min(max(int(np.floor(cw * line_h / ch + 0.5)), 4) // 4 * 4, cap), 4)
    sy, sx = np.arange(line_h) * ch / line_h, np.arange(tw) * cw / tw
    iy, ix = np.minimum(sy.astype(int), ch - 1), np.minimum(sx.astype(int), cw - 1)
    jy, jx = np.minimum(iy + 1, ch - 1), np.minimum(ix + 1, cw - 1)
    fy, fx = (sy - iy)[:, None, None], (sx - ix)[None, :, None]
    top, low = cut[iy][:, ix] * (1 - fx) + cut[iy][:, jx] * fx, cut[jy][:, ix] * (1 - fx) + cut[jy][:, jx] * fx
    return np.ascontiguousarray(((top * (1 - fy) + low * fy) / 127.5 - 1).transpose(2, 0, 1).astype(np.float32))


def _cubic_weights(n: int, size: int) -> np.ndarray:
    """size x n weights of cubic convolution (a = -0.5), widened when shrinking; rows sum to 1."""
    scale = n / size
    wide = max(scale, 1.0)
    centre = (np.arange(size) + 0.5) * scale
    lo = np.maximum((centre - 2 * wide + 0.5).astype(int), 0)[:, None]
    hi = np.minimum((centre + 2 * wide + 0.5).astype(int), n)[:, None]
    at = np.arange(n)
    t = np.abs((at + 0.5 - centre[:, None]) / wide)
    near, far = (1.5 * t - 2.5) * t * t + 1, ((-0.5 * t + 2.5) * t - 4) * t + 2
    w = np.where((at >= lo) & (at < hi), np.where(t < 1, near, np.where(t < 2, far, 0.0)), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize_cubic(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """Columns first, then rows; bytes after each, in 22-bit fixed point."""
    out = rgb.astype(np.int64)
    for axis, size in ((1, width), (0, height)):
        w = np.rint(_cubic_weights(out.shape[axis], size) * (1 << 22)).astype(np.int64)
        out = np.moveaxis(np.tensordot(w, out, axes=(1, axis)), 0, axis)
        out = np.clip((out + (1 << 21)) >> 22, 0, 255)
    return out.astype(np.uint8)


def fit_width(rgb: np.ndarray, line_h: int = 32, width: int = 384) -> np.ndarray:
    """A line scaled to ``line_h`` and padded with gray 128 to ``width``, or squeezed to it if wider; 3 x h x w, -1 to 1."""
    h, w = rgb.shape[:2]
    out = np.full((line_h, width, 3), 128, np.uint8)
    if h and w:
        tw = min(round(w * (line_h / h)), width)
        if tw:
            out[:, :tw] = resize_cubic(rgb, tw, line_h)
    return np.ascontiguousarray((out / 127.5 - 1).transpose(2, 0, 1).astype(np.float32))


def masks(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The detector's dilated mask and the ink before dilation."""
    ink = adaptive_threshold(blur(gray(rgb)))
    return dilate(ink), ink


def detect(rgb: np.ndarray) -> list[dict]:
    if not rgb.size:
        return []
    wide, ink = masks(rgb)
    return trim_edges(split_tall(components(wide), wide), ink)


def on_pages(pages: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Run a kernel over one-row-a-page rasters: page, width, height, channels, data."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("page", "width", "height", "channels", "data")}
                shape = (r["height"], r["width"]) + ((r["channels"],) if r["channels"] > 1 else ())
                out = kernel(np.frombuffer(r["data"], np.uint8).reshape(shape))
                yield pa.RecordBatch.from_pydict({"page": [r["page"]], "width": [out.shape[1]], "height": [out.shape[0]], "channels": [1], "data": [out.astype(np.uint8).tobytes()]}, pa.schema([("page", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())]))

    return pages.select("page", "width", "height", "channels", "data").mapInArrow(run, "page long, width int, height int, channels int, data binary")


def _component_rows(pages: DataFrame, find: Callable[[np.ndarray], list[dict]]) -> DataFrame:
    names = ("x", "y", "w", "h", "n")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for page, h, w, ch, data in zip(*(batch.column(c).to_pylist() for c in ("page", "height", "width", "channels", "data")), strict=True):
                found = find(np.frombuffer(data, np.uint8).reshape(h, w, ch))
                cols = [pa.array([page] * len(found), pa.int64()), pa.array(range(len(found)), pa.int64()), *(pa.array([f[c] for f in found], pa.int64()) for c in names), pa.array([f["ang"] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, ["page", "seq", *names, "ang"])

    return pages.select("page", "height", "width", "channels", "data").mapInArrow(run, "page long, seq long, x long, y long, w long, h long, n long, ang double")


def detect_pages(pages: DataFrame) -> DataFrame:
    """page, seq, x, y, w, h, n, ang of every detected component."""
    return _component_rows(pages, lambda img: detect(np.repeat(img, 3, axis=2) if img.shape[2] == 1 else img[..., :3]))


def component_table(pages: DataFrame) -> DataFrame:
    """page, seq, x, y, w, h, n, ang of every connected component of one-channel pages."""
    return _component_rows(pages, lambda img: components(img[..., 0]))


def cuts_of(profiles: DataFrame, key: str) -> DataFrame:
    """key, cut: where components with these row profiles are cut."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cuts = [split_cuts(np.array(p, np.int64)) for p in batch.column("profile").to_pylist()]
            of = [k for k, c in zip(batch.column(key).to_pylist(), cuts, strict=True) for _ in c]
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array([x for c in cuts for x in c], pa.int64())], [key, "cut"])

    return profiles.select(key, "profile").mapInArrow(run, f"{key} long, cut long")


def pixels(pages: DataFrame, name: str = "v") -> DataFrame:
    """page, y, x and the value of each pixel of one-channel pages."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for page, w, data in zip(*(batch.column(c).to_pylist() for c in ("page", "width", "data")), strict=True):
                v = np.frombuffer(data, np.uint8).astype(np.int64)
                y, x = np.divmod(np.arange(len(v)), max(w, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), page)), pa.array(y), pa.array(x), pa.array(v)], ["page", "y", "x", name])

    return pages.select("page", "width", "data").mapInArrow(run, f"page long, y long, x long, {name} long")
