"""Histograms and equalisation: aggregation by image and bin, windows over bins, joins back on the bin.

Counts are aggregated before they're shuffled, and a table of bins has at most
as many rows for an image as there are levels.
"""

from __future__ import annotations

from ..functions.expr import KEYS, half_even, luma, num, operator, pack, scaled


def level(levels: int = 256) -> str:
    """The luminance bin of a pixel: half-even rounding."""
    return f"CAST({half_even(f'{luma(*(scaled(c) for c in 'rgb'))} * {levels - 1}e0')} AS INT)"


@operator
def luminance_histogram(source, levels: int = 256):
    """(image_id, frame_no, bin, n)"""
    return f"SELECT image_id, frame_no, {level(levels)} AS bin, count(*) AS n FROM {source} GROUP BY image_id, frame_no, {level(levels)}"


@operator
def clip_histogram(source, limit: int = 350, levels: int = 256):
    """What is over the limit in any bin is dealt out: the same to each bin, the residue to every so-manieth bin from the first. Gives every bin."""
    grid = f"SELECT DISTINCT image_id, frame_no FROM {source}"
    bins = " UNION ALL ".join(f"SELECT {k} AS d" for k in range(16))
    numbers = f"SELECT CAST(p.d * 256 + q.d * 16 + s.d AS INT) AS bin FROM ({bins}) AS p CROSS JOIN ({bins}) AS q CROSS JOIN ({bins}) AS s WHERE p.d * 256 + q.d * 16 + s.d < {levels}" if levels > 16 else f"SELECT d AS bin FROM ({bins}) AS p WHERE d < {levels}"
    full = f"SELECT g.image_id, g.frame_no, b.bin, coalesce(h.n, 0) AS n FROM ({grid}) AS g CROSS JOIN ({numbers}) AS b LEFT JOIN {source} AS h ON h.image_id = g.image_id AND h.frame_no = g.frame_no AND h.bin = b.bin"
    over = f"SELECT *, sum(greatest(n - {limit}, 0)) OVER (PARTITION BY image_id, frame_no) AS excess FROM ({full}) AS filled"
    parts = f"SELECT *, CAST(floor(excess / {levels}e0) AS BIGINT) AS each_bin, excess - {levels} * CAST(floor(excess / {levels}e0) AS BIGINT) AS residual FROM ({over}) AS counted"
    step = f"greatest(CAST(floor({levels}e0 / CASE WHEN residual = 0 THEN 1 ELSE residual END) AS BIGINT), 1)"
    extra = f"CASE WHEN residual > 0 AND bin % {step} = 0 AND CAST(floor(bin * 1e0 / {step}) AS BIGINT) < residual THEN 1 ELSE 0 END"
    return f"SELECT image_id, frame_no, bin, CAST(least(n, {limit}) + each_bin + {extra} AS BIGINT) AS n FROM ({parts}) AS parts"


@operator
def cdf(source):
    """(image_id, frame_no, bin, c, least): running sums of a histogram, less the first one that isn't zero."""
    run = f"SELECT image_id, frame_no, bin, n, sum(n) OVER (PARTITION BY image_id, frame_no ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM {source}"
    least = f"SELECT *, min(CASE WHEN upto > 0 THEN upto END) OVER (PARTITION BY image_id, frame_no) AS least FROM ({run}) AS running"
    return f"SELECT image_id, frame_no, bin, CAST(greatest(0, upto - least) AS BIGINT) AS c, CAST(least AS BIGINT) AS least FROM ({least}) AS leasts"


def _cdf_of(source, levels, clip):
    h = luminance_histogram.sql(source, levels)
    if clip is not None:
        h = clip_histogram.sql(f"({h})", clip, levels)
        return cdf.sql(f"({h}) AS clipped")
    return cdf.sql(f"({h}) AS histogram")


def _table(source, levels, clip):
    """(image_id, frame_no, bin, c, least, total): the running sums, and the image's pixels from its histogram."""
    totals = f"SELECT image_id, frame_no, sum(n) AS total FROM ({luminance_histogram.sql(source, levels)}) AS histogram GROUP BY image_id, frame_no"
    return f"SELECT f.*, s.total FROM ({_cdf_of(source, levels, clip)}) AS f JOIN ({totals}) AS s ON s.image_id = f.image_id AND s.frame_no = f.frame_no"


def _with_cdf(source, levels, clip):
    """Pixels with their bin's c, the image's least and its pixel count; pixels are only joined, with a row for each bin."""
    binned = f"SELECT {KEYS}, r, g, b, a, {level(levels)} AS bin FROM {source}"
    return f"SELECT p.*, t.c, t.least, t.total FROM ({binned}) AS p JOIN ({_table(source, levels, clip)}) AS t ON t.image_id = p.image_id AND t.frame_no = p.frame_no AND t.bin = p.bin"


@operator
def equalize(source, levels: int = 256, clip: int | None = None):
    """Global equalisation: every channel becomes the share of pixels that are as dark or darker. Of one flat colour nothing is left to divide: black."""
    v = pack("CASE WHEN total = least THEN 0e0 ELSE c * 1e0 / (total - least) END")
    return f"SELECT {KEYS}, {v} AS r, {v} AS g, {v} AS b, a FROM ({_with_cdf(source, levels, clip)}) AS looked_up"


@operator
def auto_level(source, levels: int = 256, clip: int | None = None):
    """Channels scaled together, by what equalisation makes of the luminance (zero where that is zero)."""
    factor = f"(CASE WHEN bin = 0 OR total = least THEN 0e0 ELSE (c * 1e0 / (total - least)) * {levels}e0 / bin END)"
    cols = ", ".join(f"{pack(f'{factor} * {scaled(c)}')} AS {c}" for c in "rgb")
    return f"SELECT {KEYS}, {cols}, a FROM ({_with_cdf(source, levels, clip)}) AS looked_up"


@operator
def auto_level_separate(source, levels: int = 256, clip: int | None = None):
    """Each channel by itself in the luminance's table, which has a row for every level so that the joins are equalities."""
    table = _cdf_of(source, levels, 2**31 - 1 if clip is None else clip)
    joins, cols = "", []
    for c in "rgb":
        joins += f" JOIN ({table}) AS t{c} ON t{c}.image_id = p.image_id AND t{c}.frame_no = p.frame_no AND t{c}.bin = CAST({half_even(f'{scaled(f'p.{c}')} * {levels - 1}e0')} AS INT)"
        cols.append(f"{pack(f'CASE WHEN p.total = t{c}.least THEN 0e0 ELSE t{c}.c * 1e0 / (p.total - t{c}.least) END')} AS {c}")
    counted = f"(SELECT {KEYS}, r, g, b, a, count(*) OVER (PARTITION BY image_id, frame_no) AS total FROM {source}) AS p"
    return f"SELECT p.image_id, p.frame_no, p.y, p.x, {', '.join(cols)}, p.a FROM {counted}{joins}"


@operator
def statistics(source):
    """Of each image the mean, least and largest 8-bit luminance, and the pixels."""
    y = luma(*(scaled(c) for c in "rgb"))
    v = f"CAST(floor(255e0 * {y} + 0.5e0) AS INT)"
    return f"SELECT image_id, frame_no, CAST(sum({v}) AS DOUBLE) / count(*) AS mean_l, min({v}) AS min_l, max({v}) AS max_l, count(*) AS n FROM {source} GROUP BY image_id, frame_no"


@operator
def channel_histogram(source):
    """(image_id, frame_no, channel, bin, n) of red, green, blue and alpha."""
    return " UNION ALL ".join(f"SELECT image_id, frame_no, '{c}' AS channel, {c} AS bin, count(*) AS n FROM {source} GROUP BY image_id, frame_no, {c}" for c in "rgba")


@operator
def tile_equalize(source, tiles: int = 8, levels: int = 256, clip: int | None = None):
    """Each tile equalised by itself (tiles of ceil(size / tiles)), without interpolation between tiles."""
    sized = f"SELECT {KEYS}, r, g, b, a, max(x) OVER (PARTITION BY image_id, frame_no) + 1 AS w, max(y) OVER (PARTITION BY image_id, frame_no) + 1 AS h FROM {source}"
    tiled = f"SELECT image_id * 1000000 + CAST(floor(y / ceil(h * 1e0 / {tiles})) AS BIGINT) * 1000 + CAST(floor(x / ceil(w * 1e0 / {tiles})) AS BIGINT) AS image_id, frame_no, y, x, r, g, b, a FROM ({sized}) AS sized"
    done = equalize.sql(f"({tiled}) AS tiled", levels, clip)
    return f"SELECT CAST(floor(image_id / 1000000e0) AS BIGINT) AS image_id, frame_no, y, x, r, g, b, a FROM ({done}) AS done"
