"""Gradients of SSIM and MS-SSIM by both frames, band by band.

Per position of a map, SSIM is a function of five window means of the two frames. Its derivatives by those
means, weighted by what comes from above, are spread back by the window's adjoint (the full correlation with
the mirrored taps): with a, b, c the derivatives by the mean of x, of x^2 and of xy,

    dL/dx = W'a + 2 x W'b + y W'c

Nothing is kept from a forward pass but, for MS-SSIM, one mean a scale and plane: the product rule across
scales gives each scale's weight, and the adjoint of halving spreads a coarse gradient over its blocks.
A task holds a band with the window's reach above and below it (times the coarsest block for MS-SSIM), and
gives that band's rows: frames of any height are worked on in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.functions import pixels
from framescope.operators.pairing import KEYS
from framescope.operators.scoring import Unit, _exploded, _least, _run, _units, peak, pyramid_step
from framescope.plans.features import plan

SCHEMA = "clip_id string, frame_no long, c int, top int, left int, height int, width int, dx array<double>, dy array<double>"


def spread(m: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """The adjoint of `pixels.valid`: every position's value goes back to the samples under its window."""
    k = len(taps) - 1
    return pixels.valid(np.pad(m, ((0, 0), (k, k), (k, k))), taps[::-1])


def ssim_gradient(x: np.ndarray, y: np.ndarray, peak: float, taps: np.ndarray, k1: float, k2: float, on_full: np.ndarray | float, on_contrast: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """dL/dx and dL/dy of planes (n, h, w), from dL by every value of the SSIM and the contrast map."""
    half, c1, c2 = peak / 2, (k1 * peak) ** 2, (k2 * peak) ** 2
    x, y = x - half, y - half  # contrast does not feel a shift; luminance takes the true means
    mx, my, xx, yy, xy = pixels.valid(np.stack([x, y, x * x, y * y, x * y]), taps)
    below = xx - mx * mx + yy - my * my + c2
    contrast = (2 * (xy - mx * my) + c2) / below
    ux, uy = mx + half, my + half
    power = ux * ux + uy * uy + c1
    light = (2 * ux * uy + c1) / power
    by_light, by_contrast = on_full * contrast, on_full * light + on_contrast
    slope = 2 * by_contrast / below
    square = spread(-contrast * slope / 2, taps)
    cross = spread(slope, taps)
    dx = spread(2 * by_light * (uy - ux * light) / power + slope * (contrast * mx - my), taps) + 2 * x * square + y * cross
    dy = spread(2 * by_light * (ux - uy * light) / power + slope * (contrast * my - mx), taps) + 2 * y * square + x * cross
    return dx, dy


def _grown(g: np.ndarray, scale: int, rows: int, columns: int) -> np.ndarray:
    """The adjoint of `scale` halvings: a block's cells share its value; cells outside whole blocks get none."""
    n = 1 << scale
    out = np.zeros((len(g), rows, columns))
    wide = np.repeat(np.repeat(g, n, axis=1), n, axis=2)[:, :rows, :columns] / (n * n)
    out[:, : wide.shape[1], : wide.shape[2]] = wide
    return out


def band_gradient(unit: Unit, x: np.ndarray, y: np.ndarray, peak: float, above: int, own: int, weights: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the `own` rows that follow `above` rows of a piece, which begins at a whole block of the
    coarsest scale. weights: for each scale, dL by the SSIM and by the contrast map."""
    size, sigma, k1, k2 = unit.args[:4]
    taps, shape = pixels.gaussian(size, sigma), x.shape
    out = [np.zeros((len(x), own, shape[2])) for _ in range(2)]
    for s, (full, contrast) in enumerate(weights):
        if s:
            x, y = pixels.halved(x), pixels.halved(y)
        if not np.any(full) and not np.any(contrast):
            continue
        a, b = above >> s, -(-(above + own) >> s)
        for total, g in zip(out, ssim_gradient(x, y, peak, taps, k1, k2, full, contrast), strict=True):
            total += _grown(g[:, a:b], s, own, shape[2]) if s else g[:, a:b]
    return out[0], out[1]


def _pieces(u: Unit, scales: int):
    """Bands of a plane with the reach of all scales above and below: top, rows, first (rows above the
    band's own) and own."""
    step, reach = pyramid_step(scales), u.halo << (scales - 1)
    block = 1 << (scales - 1)

    def of(p: Column) -> Column:
        at = F.get(F.col("ref"), p)
        inner, across = at["height"] - 2 * u.crop, at["width"] - 2 * u.crop
        fault = F.concat(F.lit(f"a gradient over {scales} scales needs {_least(u)} pixels a side after cropping, not "), inner.cast("string"), F.lit(" x "), across.cast("string"))
        last = F.ceil(inner / step).cast("int") - 1

        def band(b: Column) -> Column:
            low, end = F.greatest(F.lit(0), b * step - reach), F.least(inner, b * step + step + reach + block)
            return F.struct(F.lit(0).alias("unit"), p.alias("plane"), (low + u.crop).alias("top"), (end - low).alias("rows"), (b * step - low).alias("first"), F.least(F.lit(step), inner - b * step).alias("own"))

        return F.transform(F.when(F.least(inner, across) < _least(u), F.raise_error(fault).cast("array<int>")).otherwise(F.sequence(F.lit(0), last)), band)

    return of


def gradients(pairs: DataFrame, feature: str = "ssim", upstream: DataFrame | float = 1.0, **options) -> DataFrame:
    """Stripes of dL/dx and dL/dy of ssim or ms_ssim by the stored samples: clip_id, frame_no, plane c, the
    stripe's top row, left column, height and width, dx, dy (row by row). Where a border is cropped there are no
    stripes, as gradients are 0 there; luma gives each of the three planes its share.

    upstream: dL by the score, for all frames; or, for ssim, dL by every value of its map, as a table of maps
    (clip_id, frame_no, c, width, data), whole or in stripes that also have their top row, as similarity_map gives them;
    a frame's stripes are put together in one row. A frame and plane without a row there gets no gradient. A
    scale of MS-SSIM whose mean is 0 or less is clamped: the frame's score is 0 there, and so are its gradients."""
    p = plan(feature, options, None)[0]
    if p.feature.name not in ("ssim", "ms_ssim") or p.options.get("downsample"):
        raise ValueError(f"{feature} has no gradient here")
    unit = _units(p)[0]
    scales = unit.args[4] if unit.kind == "pyramid" else 1
    by_map = isinstance(upstream, DataFrame)
    if by_map and scales > 1:
        raise ValueError("ms_ssim has one score a frame: its upstream is a number")
    rgb = F.col("color_family") == "RGB"
    planes = F.lit(1) if unit.whole else F.when(rgb, F.size("ref")).otherwise(1)
    if unit.kind == "pyramid":
        pairs = pairs.join(_scale_weights(pairs, unit, p.options["weights"], float(upstream)), list(KEYS))
    extra = {"g": F.col("weights")} if unit.kind == "pyramid" else {"g": F.lit(None).cast("array<array<double>>")}
    rows = _exploded(pairs, [unit], False, bands=lambda i, u: _pieces(u, scales), extra=extra | {"planes": planes, "tall": F.get("ref", F.lit(0))["height"]}, top=True)
    rows = rows.withColumn("peak", peak(F.col("dtype"), F.col("bits"), unit.peak))
    if by_map:
        # the rows of the map that a piece covers: as many as its own less the window's reach
        if "top" in upstream.columns:  # stripes, as similarity_map gives them
            parts = upstream.groupBy(*KEYS, "c").agg(F.first("width").alias("width"), F.sort_array(F.collect_list(F.struct("top", "data"))).alias("parts"))
            upstream = parts.select(*KEYS, "c", "width", F.flatten(F.transform("parts", lambda p: p["data"])).alias("data"))
        given = upstream.select(*KEYS, F.col("c").alias("plane"), F.col("data").alias("up"), F.col("width").alias("up_width"))
        rows = rows.join(given, [*KEYS, "plane"])
        rows = rows.withColumn("up", F.slice("up", (F.col("top") - unit.crop) * F.col("up_width") + 1, (F.col("rows") - unit.halo) * F.col("up_width")))
    number = None if by_map else float(upstream)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c not in ("r", "d", "up")}
                x, y = (pixels.decode(batch.column(k)[i].as_buffer(), r["dtype"], r["n"], r["rows"], r["width"]) for k in "rd")
                x, y = (v[..., unit.crop : v.shape[-1] - unit.crop] for v in (x, y))
                if unit.luma:
                    if len(x) != 3:
                        raise ValueError(f"luma needs 3 planes, not {len(x)}")
                    x, y = pixels.luma(x, unit.luma, r["peak"]), pixels.luma(y, unit.luma, r["peak"])
                if by_map:
                    weights = [(np.asarray(batch.column("up")[i].values).reshape(1, -1, r["up_width"]), 0.0)]
                elif r["g"] is None:
                    share = number / ((r["tall"] - 2 * unit.crop - unit.halo) * (x.shape[2] - unit.halo) * r["planes"])
                    weights = [(share, 0.0)]
                else:
                    each = r["g"][0 if unit.whole else r["plane"]]
                    weights = [(w, 0.0) if s == scales - 1 else (0.0, w) for s, w in enumerate(each)]
                both = band_gradient(unit, x, y, r["peak"], r["first"], r["own"], weights)
                shares = pixels.LUMA[unit.luma][:3] if unit.luma else (1.0,)
                flat = [pa.ListArray.from_arrays(pa.array(np.arange(len(shares) + 1, dtype=np.int32) * both[0].size, pa.int32()), pa.array(np.concatenate([(q * v).ravel() for q in shares]))) for v in both]
                m, same = len(shares), lambda v, kind: pa.array([v] * len(shares), kind)  # noqa: B023
                yield pa.RecordBatch.from_arrays(
                    [same(r["clip_id"], pa.string()), same(r["frame_no"], pa.int64()), pa.array(range(m) if unit.luma else [r["plane"]], pa.int32()), same(r["top"] + r["first"], pa.int32()), same(unit.crop, pa.int32()), same(r["own"], pa.int32()), same(x.shape[2], pa.int32()), *flat],
                    ["clip_id", "frame_no", "c", "top", "left", "height", "width", "dx", "dy"])

    return rows.mapInArrow(run, SCHEMA)


def _scale_weights(pairs: DataFrame, unit: Unit, weights: tuple[float, ...], upstream: float) -> DataFrame:
    """clip_id, frame_no, weights: by plane and scale, dL by every value of that scale's map. One forward
    pass gives the scales' means; only their sums are shuffled."""
    bands = _exploded(pairs, [unit], False).withColumn("peak", peak(F.col("dtype"), F.col("bits"), unit.peak))
    done = bands.mapInArrow(_run([unit], None, ()), "clip_id string, frame_no long, unit int, plane int, peak double, s array<double>")
    last = len(weights) - 1
    sums = done.groupBy(*KEYS, "plane").agg(*[F.sum(F.get("s", F.lit(j))).alias(f"s{j}") for j in range(3 * len(weights))])
    count = lambda j: F.col(f"s{3 * j}")
    mean = lambda j: F.col(f"s{3 * j + (1 if j == last else 2)}") / count(j)
    alive = reduce(lambda a, b: a & b, (mean(j) > 0 for j in range(len(weights))))
    value = reduce(lambda a, b: a * b, (F.pow(mean(j), F.lit(float(w))) for j, w in enumerate(weights)))
    each = F.array(*[F.when(alive, value * float(w) / mean(j) / count(j)).otherwise(0.0) for j, w in enumerate(weights)])
    by_plane = sums.select(*KEYS, F.struct("plane", each.alias("w")).alias("p")).groupBy(*KEYS).agg(F.sort_array(F.collect_list("p")).alias("p"))  # three planes at most
    return by_plane.select(*KEYS, F.transform("p", lambda p: F.transform(p["w"], lambda w: w * upstream / F.size("p"))).alias("weights"))
