"""Rasters as one row an image: ``img``, ``width``, ``height`` and one byte a pixel in ``grey``; 0 is black, 255 white.

An image's pixels stay together and are worked on by numpy in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

# Threshold bounds, tone distance and the local threshold's constants.
EMPTY_THRESHOLD, LEAST_THRESHOLD, MOST_THRESHOLD, TONE_DISTANCE = 186, 90, 230, 45
SAUVOLA_K, SAUVOLA_RANGE, LEAST_WINDOW = 0.34, 128.0, 3
# Paper, marks and pale drawings.
PAPER_LUMA, PAPER_SHARE, LUMA = 176.0, 0.15, (0.299, 0.587, 0.114)
MARK_CONTRAST, CELLS_PER_INCH, MOST_CELLS, LEAST_MARK_CELLS = 24.0, 150.0, 4_000_000, 3
LARGE_MARK_SHARE, PLATE_FILL, SOLID_FILL, TYPE_INCHES, INK_UNDER_DRAWING = 0.02, 0.25, 0.6, 0.25, 0.05
BOX_PADDING, BRIGHT, LEAST_BLOCKS = 0.25, 140, 6
# Verdicts on a page's fate.
FLOOR, WATCH, DARKER, LEAST_SHARED, FLAT = 0.45, 0.75, 2.0, 16, 1e-6
THUMBNAIL_SCALE, THUMBNAIL_EDGE = 40.0 / 72.0, 4000


def per_image(images: DataFrame, columns: list[str], work: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Rows (img, ...) that work(*values of the columns) yields for each image."""
    ship(images.sparkSession)
    target = images.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                img, *values = (batch.column(i)[k].as_py() for i in range(batch.num_columns))
                out += [(img, *row) for row in work(*values)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)] if out else [pa.array([], t) for t in arrow.types], schema=arrow)

    return images.select("img", *columns).mapInArrow(run, schema)


def plane(data: bytes | None, width: int, height: int) -> np.ndarray:
    """Pixels by row; an image with too few of them is empty."""
    a = np.frombuffer(data or b"", np.uint8)
    return a[: width * height].reshape(height, width) if len(a) >= width * height > 0 else np.zeros((0, 0), np.uint8)


def otsu(g: np.ndarray) -> int:
    """The first value of the greatest variance between classes, within bounds."""
    if not g.size:
        return EMPTY_THRESHOLD
    n = np.bincount(g.ravel(), minlength=256).astype(float)
    n0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    n1, s1 = n0[-1] - n0, s0[-1] - s0
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = np.where((n0 > 0) & (n1 > 0), n0 * n1 * (s0 / n0 - s1 / n1) ** 2, 0.0)
    return int(np.clip(np.round(apart, 3).argmax(), LEAST_THRESHOLD, MOST_THRESHOLD))


def tone(g: np.ndarray, threshold: int) -> float:
    return float((np.abs(g.astype(int) - threshold) < TONE_DISTANCE).mean()) if g.size else 0.0


def box_sums(a: np.ndarray, radius: int) -> np.ndarray:
    """Sums over windows of ``radius`` pixels to all sides, cut at the edges, from one integral image."""
    h, w = a.shape
    total = np.zeros((h + 1, w + 1), a.dtype)
    total[1:, 1:] = a.cumsum(0).cumsum(1)
    y0, y1 = np.maximum(np.arange(h) - radius, 0), np.minimum(np.arange(h) + radius + 1, h)
    x0, x1 = np.maximum(np.arange(w) - radius, 0), np.minimum(np.arange(w) + radius + 1, w)
    return total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]


def window_of(dpi: float, width: int, height: int) -> int:
    return min(max(int(dpi / 4), LEAST_WINDOW), max(LEAST_WINDOW, min(width, height) // 2))


def local_marks(g: np.ndarray, dpi: float) -> np.ndarray:
    """Pixels darker than their window's mean times 1 + k * (deviation / range - 1)."""
    radius = window_of(dpi, g.shape[1], g.shape[0]) // 2
    v = g.astype(float)
    n = box_sums(np.ones_like(v), radius)
    mean = box_sums(v, radius) / n
    deviation = np.sqrt(np.maximum(box_sums(v * v, radius) / n - mean * mean, 0))
    return v < mean * (1 + SAUVOLA_K * (deviation / SAUVOLA_RANGE - 1))


def downsampled(g: np.ndarray, factor: int) -> np.ndarray:
    """Means of whole cells, truncated; what is left over at the edges goes, but for an image smaller than a cell."""
    if factor <= 1 or not g.size:
        return g
    h, w = g.shape
    rows, cols = max(h // factor, 1), max(w // factor, 1)
    y, x = np.minimum(np.arange(rows + 1) * factor, h), np.minimum(np.arange(cols + 1) * factor, w)
    total = np.zeros((h + 1, w + 1), np.int64)
    total[1:, 1:] = g.astype(np.int64).cumsum(0).cumsum(1)
    sums = total[y[1:]][:, x[1:]] - total[y[:-1]][:, x[1:]] - total[y[1:]][:, x[:-1]] + total[y[:-1]][:, x[:-1]]
    return (sums // (np.diff(y)[:, None] * np.diff(x)[None])).astype(np.uint8)


def upsampled(g: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, pixels having their centres at halves; rounded half up."""

    def places(n: int, size: int):
        at = (np.arange(n) + 0.5) * size / n - 0.5
        low = np.maximum(np.floor(at), 0).astype(int)
        return np.minimum(low, size - 1), np.minimum(low + 1, size - 1), at - low

    y0, y1, wy = places(height, g.shape[0])
    x0, x1, wx = places(width, g.shape[1])
    v = g.astype(float)
    top = v[y0][:, x0] + (v[y0][:, x1] - v[y0][:, x0]) * wx
    low = v[y1][:, x0] + (v[y1][:, x1] - v[y1][:, x0]) * wx
    out = top + (low - top) * wy[:, None]
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    """Peak signal to noise ratio; infinite for identical images, -1 for none or of different size."""
    if a.shape != b.shape or not a.size:
        return -1.0
    error = float(((a.astype(float) - b.astype(float)) ** 2).mean())
    return 10 * float(np.log10(255.0 * 255.0 / error)) if error else float("inf")


def packed_bits(g: np.ndarray, threshold: int) -> bytes:
    """Two tones, eight pixels a byte, rows filled up to whole bytes; 1 is white."""
    return np.packbits(g >= threshold, axis=1).tobytes()


def paper_colour(rgb: np.ndarray) -> np.ndarray | None:
    """Mean colour of the bright pixels, if they are enough of all."""
    bright = rgb[(rgb * np.array(LUMA)).sum(axis=-1) >= PAPER_LUMA]
    return bright.mean(axis=0) if len(bright) and len(bright) / (rgb.size / 3) >= PAPER_SHARE else None


def saturations(rgb: np.ndarray) -> np.ndarray:
    """(most - least) / most of each pixel, colours first balanced so that paper is grey."""
    paper = paper_colour(rgb)
    if paper is not None and (paper > 0).all():
        rgb = rgb * (paper.max() / paper)
    high, low = rgb.max(axis=-1), rgb.min(axis=-1)
    return np.where(high > 0, (high - low) / np.maximum(high, 1e-9), 0.0)


def block_means(g: np.ndarray, step: int = 2, least: int = 50) -> list[float | None]:
    """Means of the bright pixels of nine blocks, of every ``step``-th; null for a block with ``least`` or fewer."""
    h, w = g.shape
    out: list[float | None] = []
    for by in range(3):
        for bx in range(3):
            part = g[by * h // 3 : (by + 1) * h // 3 : step, bx * w // 3 : (bx + 1) * w // 3 : step]
            bright = part[part > BRIGHT]
            out.append(float(bright.mean()) if len(bright) > least else None)
    return out


def gradient(means: list[float | None]) -> float:
    """How much darker than the brightest block the darkest one is; 0 for too few blocks."""
    known = [m for m in means if m is not None]
    return (max(known) - min(known)) / max(known) if len(known) >= LEAST_BLOCKS and max(known) > 0 else 0.0


def interior(g: np.ndarray) -> tuple[slice, slice]:
    h, w = g.shape
    mx, my = w // 16, h // 16
    return slice(my, min(max(h - my, my + 1), h)), slice(mx, min(max(w - mx, mx + 1), w))


def grown(mask: np.ndarray, radius: int) -> np.ndarray:
    """Pixels with a marked one in the box of ``radius`` around them."""
    return box_sums(mask.astype(np.int64), radius) > 0 if radius > 0 and mask.size else mask


def page_marks(g: np.ndarray, threshold: int, dpi: float) -> tuple[np.ndarray, np.ndarray, int, tuple[int, int]]:
    """(ink, pale, factor, origin): cells of the page's interior with ink, and those with marks paler than paper but no ink near."""
    rows, cols = interior(g)
    inner = g[rows, cols]
    h, w = inner.shape
    bright = np.bincount(inner[inner >= threshold].ravel(), minlength=256)
    limit = float(threshold)
    if bright.sum():
        paper = threshold + int(bright[threshold:].argmax())
        over = bright[paper:]
        limit = paper - max(3 * float((over * np.arange(len(over))).sum() / max(over.sum(), 1)), MARK_CONTRAST)
    factor = max(int(np.floor(dpi / CELLS_PER_INCH + 0.5)), 1)
    while max(w // factor, 1) * max(h // factor, 1) > MOST_CELLS:
        factor *= 2
    ch, cw = max(h // factor, 1), max(w // factor, 1)

    def cells(mask: np.ndarray) -> np.ndarray:
        part = mask[: ch * factor, : cw * factor]
        full = np.zeros((ch * factor, cw * factor), bool)
        full[: part.shape[0], : part.shape[1]] = part
        return full.reshape(ch, factor, cw, factor).any(axis=(1, 3))

    ink = cells(inner < threshold)
    pale = cells((inner >= threshold) & (inner < limit)) & ~grown(ink, 1) if limit > threshold else np.zeros_like(ink)
    return ink, pale, factor, (rows.start, cols.start)


def components(mask: np.ndarray, least: int = LEAST_MARK_CELLS) -> list[tuple[int, int, int, int, int]]:
    """(x, y, width, height, area) of the parts that touch, corners too, by their first cell; smaller ones are left out.

    Runs of each row are joined to those of the row before that they touch.
    """
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)  # stop is past the end
    root = np.arange(len(row))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        a, a_end, b, b_end = first[y - 1], first[y], first[y], first[y + 1]
        while a < a_end and b < b_end:
            if start[a] <= stop[b] and start[b] <= stop[a]:
                i, j = find(a), find(b)
                root[max(i, j)] = min(i, j)
            if stop[a] < stop[b]:
                a += 1
            else:
                b += 1
    of = np.array([find(i) for i in range(len(row))], int)
    out = []
    for r in np.unique(of):
        part = of == r
        area = int((stop[part] - start[part]).sum())
        if area >= least:
            x, y = int(start[part].min()), int(row[part].min())
            out.append((x, y, int(stop[part].max()) - x, int(row[part].max()) - y + 1, area))
    return out


def large_mark_tone(g: np.ndarray, threshold: int, dpi: float) -> float:
    """The greatest tone among the patches under large and fairly solid marks."""
    ink, _, factor, (oy, ox) = page_marks(g, threshold, dpi)
    h, w = g.shape
    best = 0.0
    for x, y, cw, ch, area in components(ink):
        if cw * ch / ink.size >= LARGE_MARK_SHARE and area / (cw * ch) >= PLATE_FILL:
            px, py = min(ox + x * factor, w - 1), min(oy + y * factor, h - 1)
            best = max(best, tone(g[py : min(py + ch * factor, h), px : min(px + cw * factor, w)], threshold))
    return best


def pale_drawing(g: np.ndarray, threshold: int, dpi: float) -> tuple[float, float]:
    """(extent, coverage) of pale marks taller than type, not solid and with hardly any ink under them."""
    ink, pale, factor, _ = page_marks(g, threshold, dpi)
    ceiling = max(TYPE_INCHES * dpi / factor, 2)
    boxes = [c for c in components(pale) if c[3] > ceiling and c[4] / (c[2] * c[3]) < SOLID_FILL and ink[c[1] : c[1] + c[3], c[0] : c[0] + c[2]].mean() <= INK_UNDER_DRAWING]
    return max((c[2] * c[3] for c in boxes), default=0) / ink.size, sum(c[4] for c in boxes) / ink.size


def text_region(boxes: list[tuple[float, float, float, float]], width: int, height: int) -> np.ndarray:
    """Pixels of boxes (x, y, width, height in shares of the page), padded by a quarter of their height."""
    out = np.zeros((height, width), bool)
    for x, y, w, h in boxes:
        if not np.isfinite([x, y, w, h]).all():
            continue
        pad = h * BOX_PADDING
        side = pad * height / width
        x0, x1 = max(int((x - side) * width), 0), min(int((x + w + side) * width) + 1, width)
        y0, y1 = max(int((y - pad) * height), 0), min(int((y + h + pad) * height) + 1, height)
        if x0 < x1 and y0 < y1:
            out[y0:y1, x0:x1] = True
    return out


def ink_outside(g: np.ndarray, region: np.ndarray, threshold: int) -> float:
    """The share of the interior's ink that lies outside a region; 0 without ink, 1 if the sizes differ."""
    if g.shape != region.shape or not g.size:
        return 1.0
    at = interior(g)
    ink = g[at] < threshold
    return float((ink & ~region[at]).sum() / ink.sum()) if ink.any() else 0.0


def filled(g: np.ndarray, holes: np.ndarray, radius: int, passes: int = 3) -> np.ndarray:
    """Holes filled by means of the pixels around them, pass by pass over twice the radius, what is left by the mean of all others."""
    out, live, reach = g.astype(np.int64), holes.copy(), max(radius, 1)
    for _ in range(passes):
        if not live.any():
            break
        steps = np.arange(-reach, reach + 1, max(reach // 3, 1))
        total, count = np.zeros_like(out), np.zeros_like(out)
        known = np.pad(~live, reach)
        value = np.pad(np.where(live, 0, out), reach)
        h, w = out.shape
        for dy in steps:
            for dx in steps:
                at = (slice(reach + dy, reach + dy + h), slice(reach + dx, reach + dx + w))
                total, count = total + value[at], count + known[at]
        done = live & (count > 0)
        out = np.where(done, total // np.maximum(count, 1), out)
        live, reach = live & ~done, reach * 2
    if live.any():
        out[live] = int(out[~holes].sum() // (~holes).sum()) if (~holes).any() else 255
    return out.astype(np.uint8)


def correlation(a: np.ndarray, b: np.ndarray) -> float | None:
    """Pearson's correlation; null where one side is flat."""
    a, b = a - a.mean(), b - b.mean()
    sa, sb = (a * a).sum(), (b * b).sum()
    return float((a * b).sum() / np.sqrt(sa * sb)) if sa / len(a) > FLAT and sb / len(b) > FLAT else None


def high_passed(grid: np.ndarray, radius: int = 2) -> np.ndarray:
    return grid - box_sums(grid.astype(float), radius) / box_sums(np.ones(grid.shape), radius)


def resemblance(a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> float | None:
    """The better of two correlations of ink grids, plain and without their local means; plain alone where one is far darker."""
    if shared.sum() < LEAST_SHARED:
        return None
    scores = [correlation(a[shared], b[shared])]
    if not (b.mean() >= 0.01 and a.mean() > DARKER * b.mean()):
        scores.append(correlation(high_passed(a)[shared], high_passed(b)[shared]))
    return max((s for s in scores if s is not None), default=None)


def page_fate(score: Column, ratio: Column) -> Column:
    """What became of a page, by its resemblance and the ink that it kept."""
    return F.when(score.isNull(), "flat").when(score < FLOOR, "lost").when(ratio < 0.5, "faded").when(score < WATCH, "watch").otherwise("kept")


def thumbnail_size(width: Column, height: Column) -> Column:
    """(width, height) of a thumbnail of a page in points; null for a page without extent."""
    scale = F.least(F.lit(THUMBNAIL_SCALE), THUMBNAIL_EDGE / F.greatest(width, height))
    side = lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(THUMBNAIL_EDGE)), F.lit(1)).cast("long")
    return F.when((width > 0) & (height > 0), F.struct(side(width).alias("width"), side(height).alias("height")))


def signals(images: DataFrame, dpi: float = 150.0) -> DataFrame:
    """Threshold, ink, tone, the tone of large marks and the extent and coverage of pale drawings of each image."""

    def work(data, width, height):
        g = plane(data, width, height)
        t = otsu(g)
        extent, coverage = pale_drawing(g, t, dpi) if g.size else (0.0, 0.0)
        yield t, float((g < t).mean()) if g.size else 0.0, tone(g, t), large_mark_tone(g, t, dpi) if g.size else 0.0, extent, coverage

    return per_image(images, ["grey", "width", "height"], work, "img long, threshold long, ink double, tone double, mark_tone double, extent double, coverage double")


def pixels_of(images: DataFrame, make: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(img, y, x, v) of an image made of each."""

    def work(data, width, height):
        a = make(plane(data, width, height)).astype(int)
        for y, x in np.ndindex(*a.shape):
            yield int(y), int(x), int(a[y, x])

    return per_image(images, ["grey", "width", "height"], work, "img long, y long, x long, v long")


def mark_components(images: DataFrame, dpi: float = 150.0) -> DataFrame:
    """(img, x, y, width, height, area) of each image's ink marks."""

    def work(data, width, height):
        g = plane(data, width, height)
        if g.size:
            yield from components(page_marks(g, otsu(g), dpi)[0])

    return per_image(images, ["grey", "width", "height"], work, "img long, x long, y long, width long, height long, area long")


def colour_signals(images: DataFrame, floor: float = 0.3) -> DataFrame:
    """Mean saturation and the share of pixels above a floor, of planes red, green and blue."""

    def work(red, green, blue, width, height):
        rgb = np.stack([plane(x, width, height) for x in (red, green, blue)], axis=-1).astype(float)
        s = saturations(rgb) if rgb.size else np.zeros(1)
        yield float(s.mean()), float((s > floor).mean())

    return per_image(images, ["red", "green", "blue", "width", "height"], work, "img long, saturation double, saturated double")


def footprint(a: np.ndarray, b: np.ndarray, at: tuple[slice, slice], least: int = 12) -> tuple[float, float, float]:
    """(coverage, x, y): the share of pixels of a box that a mark changed, and their centre as shares of the box."""
    changed = np.abs(a[at].astype(int) - b[at].astype(int)) > least
    if not changed.any():
        return 0.0, 0.0, 0.0
    y, x = np.nonzero(changed)
    return float(changed.mean()), float(x.mean() / changed.shape[1]), float(y.mean() / changed.shape[0])
