"""Scores of paired frames as one Spark job.

Every requested feature becomes work units: a plane (or all planes) at a scale, cut into bands of
rows with the halo its stencil needs. Bands are sliced out of the frame's bytes by SQL functions, so
a task holds a band and not a frame; a small array helper turns each band into sums; one aggregation
by frame, partial before the shuffle, and column arithmetic give the scores. Features that need the
same sums share units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.functions import pixels
from framescope.operators.pairing import KEYS
from framescope.plans.features import SUFFIXES, Plan, plan
from framescope.sources.weights import load as load_weights  # noqa: F401
from framescope.sources.weights import net as named_net

ANY = "any"  # pairs of all color families in one job
BAND = 512  # source rows of a band, about
_SUMS = "array<double>"


@dataclass(frozen=True)
class Unit:
    """What one kind of unit computes; scale halves the planes so many times first."""

    kind: str
    scale: int
    whole: bool  # all planes in one unit: luma, RGB metrics
    crop: int
    luma: str | None
    peak: float | None
    args: tuple = ()

    @property
    def halo(self) -> int:
        return self.args[0] - 1 if self.kind in ("ssim", "pyramid") else 2 if self.kind == "gms" else 0

    @property
    def banded(self) -> bool:
        """Whether bands of a plane may be worked on apart; the other kinds see whole planes."""
        return self.kind in ("gms", "ssimulacra2", "pyramid") or self.kind == "pixel" and self.args != (None,) or self.kind == "ssim" and not self.args[4]


def _units(p: Plan) -> list[Unit]:
    o, f = p.options, p.feature
    base = (bool(o["luma"]) or f.scope == "rgb", o["crop_border"], o["luma"], o["data_range"])
    if f.kind == "pixel":
        return [Unit("pixel", 0, *base, (o.get("eps", 1e-3) if f.name == "charbonnier" else 1e-3, o.get("delta", 1.0)))]
    if f.kind == "ssim":
        window = (o["win_size"], float(o["sigma"]), *map(float, o["K"]))
        return [Unit("pyramid", 0, *base, (*window, len(o["weights"]))) if f.name == "ms_ssim" else Unit("ssim", 0, *base, (*window, bool(o.get("downsample"))))]
    if f.kind == "gms":
        return [Unit("gms", int(o["downsample"]), *base, (o["T"], o["eps"]))]
    if f.kind == "ssimulacra2":
        return [Unit("ssimulacra2", 0, *base)]
    return [Unit(f.kind, 0, *base, (f.function,) if f.kind == "custom" else ())]


_PLAIN = {"psnr": 1, "mse": 1, "l1": 2, "charbonnier": 3, "huber": 4}  # which sum a pixel feature reads
_ROWS = 32  # rows of a map computed at a time, so that its parts stay in cache


def sums(unit: Unit, x: np.ndarray, y: np.ndarray, peak: float, net: dict | None = None, wanted: tuple[str, ...] = ("mse", "l1", "charbonnier", "huber"), first: int = 0, own: int = 0) -> list[float]:
    """The sums of one band; x and y are (planes, rows, columns) of samples as stored. first, own: which
    rows count, of a band that has more around them."""
    if unit.crop:
        x, y = (v[..., unit.crop : v.shape[-1] - unit.crop] for v in (x, y))
    if unit.kind == "pixel" and not unit.luma:
        return [float(x.size), *pixels.pixel_sums(x, y, *unit.args, wanted)]
    if unit.kind == "ssimulacra2":
        if len(x) == 1:
            x, y = (np.repeat(v, 3, axis=0) for v in (x, y))
        return pixels.ssimulacra2_sums(x, y, peak, first, own)
    halvings = 0 if unit.luma else unit.scale
    for _ in range(halvings):
        x, y = pixels.halved(x), pixels.halved(y)
    x, y = x.astype(np.float64, copy=False), y.astype(np.float64, copy=False)
    if unit.luma:
        if len(x) != 3:
            raise ValueError(f"luma needs 3 planes, not {len(x)}")
        x, y = pixels.luma(x, unit.luma, peak), pixels.luma(y, unit.luma, peak)
    if unit.kind == "pixel":
        return [float(x.size), *pixels.pixel_sums(x, y, *unit.args, wanted)]
    if unit.kind == "custom":
        return [1.0, float(unit.args[0](x, y, peak))]
    if unit.kind == "lpips":
        if len(x) == 1:
            x, y = (np.repeat(v, 3, axis=0) for v in (x, y))
        return [1.0, sum(float(m.mean()) for m in pixels.lpips_maps(x, y, peak, net))]
    if unit.kind == "pyramid":
        return _pyramid(unit, x, y, peak, own)
    for _ in range(unit.scale - halvings):
        x, y = pixels.halved(x), pixels.halved(y)
    if unit.kind == "gms":
        q = gms(unit, x, y, peak)
        return [float(q.size), float(q.sum()), float(((q - q.mean()) ** 2).sum()), float(q.sum() ** 2 / q.size)]
    if unit.args[4]:
        x, y = pixels.shrunk(x), pixels.shrunk(y)
    return _ssim_sums(unit, x, y, peak, x.shape[1] - unit.halo)


def _ssim_sums(unit: Unit, x: np.ndarray, y: np.ndarray, peak: float, rows: int) -> list[float]:
    """Positions, and the sums of SSIM and contrast, over the first `rows` rows of the maps."""
    out = [0.0, 0.0, 0.0]
    for top in range(0, rows, _ROWS):
        part = slice(top, min(top + _ROWS, rows) + unit.halo)
        full, contrast = ssim(unit, x[:, part], y[:, part], peak)
        out = [a + float(b) for a, b in zip(out, (full.size, full.sum(), contrast.sum()), strict=True)]
    return out


def _pyramid(unit: Unit, x: np.ndarray, y: np.ndarray, peak: float, own: int) -> list[float]:
    """The sums of every scale from one band, halved from scale to scale; own: source rows whose maps count
    here, 0 for all to the frame's end."""
    out = []
    for s in range(unit.args[4]):
        if s:
            x, y = pixels.halved(x), pixels.halved(y)
        rows = x.shape[1] - unit.halo
        out += _ssim_sums(unit, x, y, peak, min(rows, own >> s) if own else rows)
    return out


def gms(unit: Unit, x: np.ndarray, y: np.ndarray, peak: float) -> np.ndarray:
    t, eps = unit.args
    return pixels.gms_map(x, y, 170.0 * (peak / 255.0) ** 2 if t is None else t, (1e-6 * peak) ** 2 if eps is None else eps)


def ssim(unit: Unit, x: np.ndarray, y: np.ndarray, peak: float) -> tuple[np.ndarray, np.ndarray]:
    size, sigma, k1, k2 = unit.args[:4]
    return pixels.ssim_maps(x, y, peak, pixels.gaussian(size, sigma), k1, k2)


def _least(unit: Unit) -> int:
    """Smallest side of a plane that a unit accepts, after cropping."""
    return {"ssim": (unit.halo + 1) << unit.scale, "pyramid": (unit.halo + 1) << (unit.args[4] - 1 if unit.kind == "pyramid" else 0), "gms": 3 << unit.scale, "ssimulacra2": 8, "lpips": 32}.get(unit.kind, 1)


def peak(dtype: Column, bits: Column, given: float | None = None) -> Column:
    """Data range: as given, or of the bit depth, or of the sample type."""
    if given is not None:
        return F.lit(float(given))
    by_type = reduce(lambda c, t: c.when(dtype == t, pixels.peak_of(t, None)), list(pixels.WIDTH)[1:], F.when(dtype == "u8", 255.0))
    return F.when(~dtype.isin("f16", "bf16", "f32", "f64") & bits.isNotNull(), F.expr("double(shiftleft(1L, bits) - 1)")).otherwise(by_type)


def _strips(i: int, u: Unit, p: Column, inner: Column, fault: Column) -> Column:
    """Bands of all scales of SSIMULACRA 2 at once: whole blocks of the coarsest scale, with its blur's reach
    above and below."""
    step, reach = pyramid_step(pixels.SCALES), -(-pixels.REACH << (pixels.SCALES - 1))
    last = F.ceil(inner / step).cast("int") - 1

    def band(b: Column) -> Column:
        low, end = F.greatest(F.lit(0), b * step - reach), F.least(inner, b * step + step + reach)
        return F.struct(F.lit(i).alias("unit"), p.alias("plane"), (low + u.crop).alias("top"), (end - low).alias("rows"), (b * step - low).alias("first"), F.when(b == last, 0).otherwise(step).alias("own"))

    return F.transform(fault.otherwise(F.sequence(F.lit(0), last)), band)


def pyramid_step(scales: int) -> int:
    """Rows of a pyramid's band: whole blocks of its coarsest scale, and some times its halo."""
    return max(BAND >> (scales - 1), 1) << (scales - 1)


def _tall(i: int, u: Unit, p: Column, inner: Column, fault: Column) -> Column:
    """Bands of all scales of a pyramid at once: the halo below is that of the coarsest one."""
    scales = u.args[4]
    step, halo = pyramid_step(scales), u.halo << (scales - 1)
    last = F.greatest(F.lit(0), F.ceil((inner - halo) / step).cast("int") - 1)

    def band(b: Column) -> Column:
        end = F.when(b == last, inner).otherwise(b * step + step + halo)
        return F.struct(F.lit(i).alias("unit"), p.alias("plane"), (b * step + u.crop).alias("top"), (end - b * step).alias("rows"), F.lit(0).alias("first"), F.when(b == last, 0).otherwise(step).alias("own"))

    return F.transform(fault.otherwise(F.sequence(F.lit(0), last)), band)


def _ssimulacra2(bands: Column) -> Column:
    """The score from a frame's bands: of every scale pixels and 18 sums, zeros where a scale is not there. The
    weights are laid out by channel, scale, norm and map for the scales there are."""
    scales, each = pixels.SCALES, 19
    sums = F.aggregate(bands, F.array_repeat(F.lit(0.0), scales * each), lambda s, x: F.zip_with(s, x, lambda v, w: v + w))
    n = sum((F.when(F.get(sums, F.lit(k * each)) > 0, 1).otherwise(0) for k in range(scales)), F.lit(0))
    weights = [[[float(pixels.WEIGHTS[(((j // 6) * there + k) * 2 + j // 3 % 2) * 3 + j % 3]) if k < there else 0.0 for j in range(18)] for k in range(scales)] for there in range(1, scales + 1)]

    def part(own: Column, w: Column) -> Column:
        means = F.transform(F.slice(own, 2, 18), lambda v, j: F.pow(v / F.get(own, F.lit(0)), F.when(F.floor(j / 3) % 2 == 1, 0.25).otherwise(1.0)))
        total = F.aggregate(F.zip_with(means, w, lambda v, x: v * x), F.lit(0.0), lambda s, v: s + v)
        return F.when(F.get(own, F.lit(0)) > 0, total).otherwise(0.0)

    # arrays of one element name a value, so that it is not written out each time it is used
    split = F.transform(F.sequence(F.lit(0), F.lit(scales - 1)), lambda k: F.slice(sums, k * each + 1, each))
    total = F.aggregate(F.zip_with(split, F.get(F.lit(weights), n - 1), part), F.lit(0.0), lambda s, v: s + v)
    cubic = F.transform(F.array(total * 0.9562382616834844), lambda v: 2.326765642916932 * v - 0.020884521182843837 * v * v + 6.248496625763138e-05 * v * v * v)
    return F.get(F.transform(cubic, lambda v: F.when(v > 0, 100.0 - 10.0 * F.pow(v, F.lit(0.6276336467831387))).otherwise(100.0)), F.lit(0))


def _exploded(pairs: DataFrame, units: list[Unit], rgb_only: bool, bands: Callable | None = None, extra: dict[str, Column] | None = None, top: bool = False) -> DataFrame:
    """One row a band: unit, plane, rows, width, and its bytes of both frames. bands: another way to cut a
    unit's planes; extra: further columns of the pair; top: the band's first row too."""
    rgb = F.col("color_family") == "RGB"
    if rgb_only:
        pairs = pairs.withColumn("ref", F.when(~F.col("color_family").isin("RGB", "GRAY"), F.raise_error(F.lit("RGB frames are needed; convert first"))).otherwise(F.col("ref")))

    def usual(i: int, u: Unit):
        """From a plane's number to the bands of unit i in it."""
        step = max(1, BAND >> u.scale)

        def of(p: Column) -> Column:
            at = F.get(F.col("ref"), p)
            inner, across = at["height"] - 2 * u.crop, at["width"] - 2 * u.crop
            small = F.least(inner, across) < _least(u)
            out = F.shiftright(inner, u.scale) - u.halo
            fault = F.concat(F.lit(f"{u.kind} at scale {u.scale} needs {_least(u)} pixels a side after cropping, not "), inner.cast("string"), F.lit(" x "), across.cast("string"))
            if u.kind == "ssimulacra2":
                return _strips(i, u, p, inner, F.when(small, F.raise_error(fault).cast("array<int>")))
            if u.kind == "pyramid":
                return _tall(i, u, p, inner, F.when(small, F.raise_error(fault).cast("array<int>")))
            last = F.greatest(F.lit(0), F.ceil(out / step).cast("int") - 1) if u.banded else F.lit(0)
            starts = F.when(small, F.raise_error(fault).cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda b: b * step))

            def band(a: Column) -> Column:
                end = F.when(a + step >= out, inner).otherwise(F.shiftleft(a + step + u.halo, u.scale)) if u.banded else inner
                top = F.shiftleft(a, u.scale)
                return F.struct(F.lit(i).alias("unit"), p.alias("plane"), (top + u.crop).alias("top"), (end - top).alias("rows"), F.lit(0).alias("first"), F.lit(0).alias("own"))

            return F.transform(starts, band)

        return of

    pieces = []
    for i, u in enumerate(units):
        last = F.lit(0) if u.whole else F.size("ref") - 1 if u.kind == "pixel" else F.when(rgb, F.size("ref") - 1).otherwise(0)
        pieces.append(F.flatten(F.transform(F.sequence(F.lit(0), last), (bands or usual)(i, u))))
    extra = extra or {}
    rows = pairs.select(*KEYS, "color_family", "bits", "dtype", "ref", "dist", *[c.alias(n) for n, c in extra.items()], F.explode(F.flatten(F.array(*pieces))).alias("b")).select("*", "b.*").drop("b")
    width = reduce(lambda c, t: c.when(F.col("dtype") == t, pixels.WIDTH[t]), pixels.WIDTH, F.when(F.lit(False), 0)).otherwise(F.raise_error(F.concat(F.lit("unknown dtype "), F.col("dtype"))))
    whole = F.col("unit").isin([i for i, u in enumerate(units) if u.whole])

    def cut(side: str) -> Column:
        def part(plane: Column) -> Column:
            return plane["data"].substr(F.col("top") * plane["width"] * width + 1, F.col("rows") * plane["width"] * width)

        one, many = part(F.get(side, F.col("plane"))), F.size(side)
        joined = F.when(many == 1, part(F.get(side, F.lit(0)))).otherwise(F.concat(*[part(F.get(side, F.lit(j))) for j in range(3)]))
        return F.when(whole, joined).otherwise(one)

    return rows.select(*KEYS, *extra, *(["top"] if top else []), "dtype", "bits", "unit", "plane", "first", "own", F.when(whole, F.size("ref")).otherwise(1).alias("n"), "rows", F.get("ref", F.col("plane"))["width"].alias("width"), cut("ref").alias("r"), cut("dist").alias("d"))


def _run(units: list[Unit], net: Broadcast | None, wanted: tuple[str, ...], also: tuple[str, ...] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, both = [], [batch.column(k) for k in "rd"]
            small = [x for x in batch.schema.names if x not in "rd"]
            for i, r in enumerate(batch.select(small).to_pylist()):
                x, y = (pixels.samples(v[i].as_buffer(), r["dtype"], r["n"], r["rows"], r["width"]) for v in both)  # no copy
                out.append(sums(units[r["unit"]], x, y, r["peak"], net and net.value, wanted, r["first"], r["own"]))
            keep = [*KEYS, *also, "unit", "plane", "peak"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.list_(pa.float64()))], [*keep, "s"])

    return run


def _shared(needed: list[list[Unit]]) -> list[list[Unit]]:
    """SSIM reads the first scale of a pyramid of the same window, where one is asked for too."""
    tall = [us[0] for us in needed if us[0].kind == "pyramid"]
    alike = lambda u, v: u.kind == "ssim" and not u.args[4] and (u.whole, u.crop, u.luma, u.peak, u.args[:4]) == (v.whole, v.crop, v.luma, v.peak, v.args[:4])
    return [next(([v] for v in tall if alike(us[0], v)), us) for us in needed]


def score(pairs: DataFrame, feature: object, *, options: dict[str, dict] | None = None, max_planes: int = 3, color_family: str | None = None, **common) -> DataFrame:
    """clip_id, frame_no and a column a score for every pair.

    Per-plane features have a column a plane; their names take the suffixes of color_family (GRAY,
    YUV or RGB), or of the pairs' own if it is not given: then their first row is looked up. "any" takes pairs of
    all three in one job: columns are those of all families, null where they are not a frame's own. A frame of
    another family than the one asked for, or with more or fewer planes than its family has, fails the job."""
    plans = plan(feature, common, options)
    if color_family is None:
        first = pairs.select("color_family").first()
        color_family = first[0] if first else "GRAY"
    if color_family != ANY and color_family not in SUFFIXES:
        raise ValueError(f"color_family is one of {sorted(SUFFIXES)} or {ANY!r}, not {color_family!r}")
    families = list(SUFFIXES) if color_family == ANY else [color_family]
    planes = reduce(lambda c, f: c.when(F.col("color_family") == f, len(SUFFIXES[f])), families, F.when(F.lit(False), 0))
    fault = F.concat(F.lit("clip "), F.coalesce("clip_id", F.lit("null")), F.lit(" frame "), F.coalesce(F.col("frame_no").cast("string"), F.lit("null")), F.lit(": "), F.coalesce("color_family", F.lit("null")), F.lit(" of "), F.size("ref").cast("string"), F.lit(f" planes where {' or '.join(f'{f} of {len(SUFFIXES[f])}' for f in families)} is asked for"))
    pairs = pairs.withColumn("ref", F.when(~F.coalesce(F.size("ref") == planes, F.lit(False)), F.raise_error(fault)).otherwise(F.col("ref")))
    needed = _shared([_units(p) for p in plans])
    units = list(dict.fromkeys(u for us in needed for u in us))
    nets = [p.options["net"] for p in plans if p.feature.name == "lpips"]
    if nets and nets[0] is None:
        raise FileNotFoundError("lpips needs its weights: pass options={'lpips': {'net': name or load_weights(path)}}")
    net = pairs.sparkSession.sparkContext.broadcast(named_net(nets[0])) if nets else None
    bands = _exploded(pairs, units, any(p.feature.scope == "rgb" for p in plans), extra={"family": F.col("color_family")})
    ranges = reduce(lambda c, i: c.when(F.col("unit") == i, peak(F.col("dtype"), F.col("bits"), units[i].peak)), range(len(units)), F.when(F.lit(False), 0.0))
    bands = bands.withColumn("peak", ranges)
    done = bands.mapInArrow(_run(units, net, tuple(sorted({p.feature.name.replace("psnr", "mse") for p in plans if p.feature.name in _PLAIN})), ("family",)), "clip_id string, frame_no long, family string, unit int, plane int, peak double, s array<double>")
    place = {u: i for i, u in enumerate(units)}
    n_planes = max(len(SUFFIXES[f]) for f in families)
    total: dict[str, Column] = {}
    if len(families) > 1:
        total["family"] = F.first("family").alias("family")

    def of(u: Unit, plane: int | None, j: int) -> Column:
        name = f"u{place[u]}_{'all' if plane is None else plane}_{j}"
        here = F.col("unit") == place[u] if plane is None else (F.col("unit") == place[u]) & (F.col("plane") == plane)
        total[name] = F.sum(F.when(here, F.get("s", F.lit(j)))).alias(name)
        return F.col(name)

    columns: list[Column] = []
    for p, us in zip(plans, needed, strict=True):
        f, u = p.feature, us[0]
        single = u.whole or "RGB" not in families and f.scope != "per_plane"
        if f.scope == "per_plane":
            for family, plane, suffix in [(None, 0, "")] if u.whole else [(x, i, suffix) for x in families for i, suffix in enumerate(SUFFIXES[x])]:
                name = f.column + suffix
                mean = of(u, plane, _PLAIN[f.name]) / of(u, plane, 0)
                if f.name == "psnr":
                    top = f"p{place[u]}"
                    total[top] = F.max(F.when(F.col("unit") == place[u], F.col("peak"))).alias(top)
                    mean = psnr(mean, F.col(top), p.options["eps"])
                columns.append((mean if family is None or len(families) == 1 else F.when(F.col("family") == family, mean)).alias(name))
        elif f.name == "ssimulacra2":
            total["bands"] = F.collect_list(F.when(F.col("unit") == place[u], F.col("s"))).alias("bands")  # a few a frame
            columns.append(_ssimulacra2(F.col("bands")).alias(f.column))
        elif f.name == "ssim":
            columns.append((of(u, None, 1) / of(u, None, 0)).alias(f.column))
        elif f.name == "ms_ssim":
            weights = p.options["weights"]
            each = [
                reduce(lambda a, b: a * b, (F.pow(F.greatest(of(u, c, 3 * j + (1 if j == len(weights) - 1 else 2)) / of(u, c, 3 * j), F.lit(0.0)), F.lit(float(w))) for j, w in enumerate(weights)))
                for c in range(1 if single else n_planes)
            ]
            if len(families) > 1:  # the planes that are there
                each = F.array_compact(F.array(*[F.when(of(u, c, 0).isNotNull(), v) for c, v in enumerate(each)]))
                columns.append((F.aggregate(each, F.lit(0.0), lambda a, b: a + b) / F.size(each)).alias(f.column))
            else:
                columns.append((reduce(lambda a, b: a + b, each) / len(each)).alias(f.column))
        elif f.name in ("gms", "gmsd"):
            n, mean = of(u, None, 0), of(u, None, 1) / of(u, None, 0)
            spread = F.greatest(of(u, None, 2) + of(u, None, 3) - of(u, None, 1) * of(u, None, 1) / n, F.lit(0.0)) / n
            columns.append((F.sqrt(spread) if f.name == "gmsd" else mean).alias(f.column))
        else:
            columns.append((of(u, None, 1) / of(u, None, 0)).alias(f.column))
    return done.groupBy(*KEYS).agg(*total.values()).select(*KEYS, *columns)


def psnr(mse: Column, top: Column, eps: float = 0.0) -> Column:
    """Decibels of a mean squared error; infinite where there is none."""
    floor = F.greatest(mse, F.lit(float(eps)))
    return F.when(floor == 0, F.lit(float("inf"))).otherwise(10 * F.log10(top * top) - 10 * F.log10(floor))


def append(distorted: DataFrame, scores: DataFrame) -> DataFrame:
    """The distorted frames with their scores as further columns; their own columns stay."""
    return distorted.join(scores, list(KEYS), "left")


def batch(scores: DataFrame, data_range: float | None = None) -> DataFrame:
    """One row: each score's mean over all frames; PSNR is that of the mean squared error, which frames
    of one data range (or the given one, where their errors are there too) give without it."""
    names = [c for c in scores.columns if c not in KEYS]

    def one(c: str) -> Column:
        if not c.startswith("psnr"):
            return F.avg(c).alias(c)
        partner = "mse" + c.removeprefix("psnr")
        if partner in names and data_range is not None:
            return psnr(F.avg(partner), F.lit(float(data_range))).alias(c)
        share = F.avg(F.pow(F.lit(10.0), -F.col(c) / 10))  # the mean error over the squared range
        return F.when(share == 0, F.lit(float("inf"))).otherwise(-10 * F.log10(F.when(share > 0, share))).alias(c)

    return scores.agg(*map(one, names))


def losses(scores: DataFrame) -> DataFrame:
    """Each score that has a loss, as loss_<name>: 1 - similarity, or the distance itself."""
    flipped = {"float_ssim": "ssim", "float_ms_ssim": "ms_ssim", "gms": "gms"}
    out = [(1 - F.col(c)).alias(f"loss_{flipped[c]}") for c in scores.columns if c in flipped]
    same = ("l1", "charbonnier", "huber", "lpips")
    return scores.select(*KEYS, *out, *(F.col(c).alias(f"loss_{c}") for c in scores.columns if c.startswith(same)))


def _grown(m: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear growth of a map to a size, samples at cell centres."""
    def axis(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.minimum(at.astype(np.int64), max(n - 2, 0))
        return low, np.minimum(low + 1, n - 1), at - low

    (a, b, u), (c, d, v) = axis(m.shape[0], height), axis(m.shape[1], width)
    rows = m[a] * (1 - u)[:, None] + m[b] * u[:, None]
    return rows[:, c] * (1 - v) + rows[:, d] * v


def similarity_map(pairs: DataFrame, feature: str, options: dict[str, dict] | None = None, **common) -> DataFrame:
    """clip_id, frame_no, c, top, height, width, data (row by row): the map of ssim, gms, gmsd or lpips, in stripes
    of its rows from `top` on. ssim and gms are worked on band by band; lpips, and ssim with downsample, see a
    frame at once and give one stripe. Only bytes and finished Arrow lists are kept, never Python numbers."""
    p = plan(feature, common, options)[0]
    if p.feature.kind not in ("ssim", "gms", "lpips") or p.feature.name == "ms_ssim":
        raise ValueError(f"{feature} has no map")
    unit, net = _units(p)[0], p.options.get("net")
    if unit.kind == "lpips" and net is None:
        raise FileNotFoundError("lpips needs its weights: pass options={'lpips': {'net': name or load_weights(path)}}")
    net = pairs.sparkSession.sparkContext.broadcast(named_net(net)) if net is not None else None

    def maps(x: np.ndarray, y: np.ndarray, peak: float) -> np.ndarray:
        if unit.crop:
            rows = slice(0, None) if unit.banded else slice(unit.crop, x.shape[1] - unit.crop)  # bands leave the border's rows out
            x, y = (v[:, rows, unit.crop : v.shape[2] - unit.crop] for v in (x, y))
        if unit.luma:
            x, y = pixels.luma(x, unit.luma, peak), pixels.luma(y, unit.luma, peak)
        if unit.kind == "lpips":
            x, y = (np.repeat(v, 3 // len(v), axis=0) for v in (x, y))
            return sum(_grown(m, *x.shape[1:]) for m in pixels.lpips_maps(x, y, peak, net.value))[None]
        for _ in range(unit.scale):
            x, y = pixels.halved(x), pixels.halved(y)
        if unit.kind == "ssim" and unit.args[4]:
            x, y = pixels.shrunk(x), pixels.shrunk(y)
        return gms(unit, x, y, peak) if unit.kind == "gms" else ssim(unit, x, y, peak)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c not in "rd"}
                m = maps(*(pixels.decode(batch.column(k)[i].as_buffer(), r["dtype"], r["n"], r["rows"], r["width"]) for k in "rd"), r["peak"])
                n, size = len(m), m[0].size
                data = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.array(m.ravel()))
                same = lambda v, t: pa.array([v] * n, t)  # noqa: B023, E731
                top = (r["top"] - unit.crop) >> unit.scale if unit.banded else 0
                yield pa.RecordBatch.from_arrays(
                    [same(r["clip_id"], pa.string()), same(r["frame_no"], pa.int64()), pa.array(range(n) if n > 1 else [r["plane"]], pa.int32()), same(top, pa.int32()), same(m.shape[1], pa.int32()), same(m.shape[2], pa.int32()), data],
                    ["clip_id", "frame_no", "c", "top", "height", "width", "data"])

    units = [unit] if unit.banded else [Unit("pixel", 0, True, 0, None, None, (None,))]
    rows = _exploded(pairs, units, unit.kind == "lpips", top=True)
    rows = rows.withColumn("peak", peak(F.col("dtype"), F.col("bits"), unit.peak))
    return rows.mapInArrow(run, "clip_id string, frame_no long, c int, top int, height int, width int, data array<double>")


def random_net(seed: int = 0) -> dict:
    """A trunk of the usual shape with seeded random weights: for tests and timing, never for scores."""
    rng, last = np.random.default_rng(seed), 3
    net: dict[str, list] = {x: [] for x in ("weight", "bias", "lin", "stride", "padding", "pool")}
    for channels, size, stride, padding, pool in ((16, 11, 4, 2, False), (24, 5, 1, 2, True), (32, 3, 1, 1, True)):
        layer = (rng.normal(0, (2 / (last * size * size)) ** 0.5, (channels, last, size, size)), rng.normal(0, 0.01, channels), rng.random(channels), stride, padding, pool)
        for values, x in zip(net.values(), layer, strict=True):
            values.append(x)
        last = channels
    return net
