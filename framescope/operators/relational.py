"""The same scores from pixel relations, inside the engine alone: no Python worker runs.

Frames are exploded to (clip_id, frame_no, c, y, x, r, d); windows over rows and columns are sums of `lead`
frames, halvings are groups of 2 x 2 cells, scores are averages. Every pixel is a row and is shuffled some
times a stencil, so this is for checking the banded kernels, for engines without Python workers and
for looking into intermediate values with SQL (`pixels`, `ssim_map`), not for speed.

What it cannot do it refuses: features beyond psnr, mse, l1, charbonnier, huber, ssim, ms_ssim, gms and gmsd,
luma conversion, MATLAB's downsampling, and samples other than whole numbers of 8 or 16 bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescope.functions.pixels import gaussian
from framescope.operators.pairing import KEYS
from framescope.operators.scoring import _least, _units, peak, psnr
from framescope.plans.features import SUFFIXES, Plan, plan

FEATURES = ("psnr", "mse", "l1", "charbonnier", "huber", "ssim", "ms_ssim", "gms", "gmsd")
_SIZE = {"u8": 1, "u16": 2}
_IMAGE = [*KEYS, "c"]


def pixels(pairs: DataFrame, crop: int = 0) -> DataFrame:
    """clip_id, frame_no, peak, image (whether the plane takes part in image features), c, y, x, r, d."""
    size = F.when(F.col("dtype") == "u8", 1).when(F.col("dtype") == "u16", 2).otherwise(F.raise_error(F.concat(F.lit("impl='sql' reads u8 and u16 samples, not "), F.col("dtype"))).cast("int"))

    def values(plane: str) -> Column:
        text = lambda i: F.hex(F.col(plane)["data"].substr(F.col("y") * F.col("width") * F.col("size") + i * F.col("size") + 1, F.col("size")))
        order = lambda h: F.when(F.col("size") == 1, h).otherwise(F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)))
        return F.transform("xs", lambda i: F.conv(order(text(i)), 16, 10).cast("double"))

    planes = pairs.select(*KEYS, peak(F.col("dtype"), F.col("bits")).alias("peak"), (F.col("color_family") == "RGB").alias("rgb"), size.alias("size"), F.posexplode(F.arrays_zip("ref", "dist")).alias("c", "p"))
    planes = planes.select(*KEYS, "peak", (F.col("rgb") | (F.col("c") == 0)).alias("image"), "size", "c", F.col("p.ref").alias("ref"), F.col("p.dist").alias("dist"), F.col("p.ref.height").alias("height"), F.col("p.ref.width").alias("width"))
    lines = planes.select("*", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), F.sequence(F.lit(0), F.col("width") - 1).alias("xs"))
    cells = lines.select(*KEYS, "peak", "image", "c", "height", "width", "y", F.posexplode(F.arrays_zip(values("ref").alias("r"), values("dist").alias("d"))).alias("x", "v"))
    inside = (F.col("x") >= crop) & (F.col("x") < F.col("width") - crop) & (F.col("y") >= crop) & (F.col("y") < F.col("height") - crop)
    return cells.where(inside).select(*KEYS, "peak", "image", "c", (F.col("y") - crop).alias("y"), (F.col("x") - crop).alias("x"), F.col("v.r").alias("r"), F.col("v.d").alias("d"))



def _along(axis: str):
    """Windows over a row's cells by x, or over a column's by y."""
    return Window.partitionBy(*_IMAGE, "x" if axis == "y" else "y").orderBy(axis)


def _window(cells: DataFrame, named: dict[str, Column], taps: list[float]) -> DataFrame:
    """Separable windows over named expressions, where they fit wholly; other columns stay."""
    k = len(taps)

    def along(df: DataFrame, columns: dict[str, Column], w) -> DataFrame:
        df = df.withColumns(columns)
        total = lambda c: reduce(lambda a, b: a + b, (F.lead(c, i).over(w) * t if i else F.col(c) * t for i, t in enumerate(taps)))
        return df.withColumns({**{c: total(c) for c in columns}, "fits": F.lead("peak", k - 1).over(w).isNotNull()}).where("fits").drop("fits")

    return along(along(cells, named, _along("x")), {c: F.col(c) for c in named}, _along("y"))


def ssim_map(cells: DataFrame, size: int, sigma: float, k1: float, k2: float) -> DataFrame:
    """cells with s and cs, SSIM and contrast-structure, at every place where the window fits."""
    x, y = F.col("r") - F.col("peak") / 2, F.col("d") - F.col("peak") / 2
    m = _window(cells, {"mx": x, "my": y, "xx": x * x, "yy": y * y, "xy": x * y}, [float(t) for t in gaussian(size, sigma)])
    c1, c2 = F.pow(F.col("peak") * k1, 2), F.pow(F.col("peak") * k2, 2)
    ux, uy = F.col("mx") + F.col("peak") / 2, F.col("my") + F.col("peak") / 2
    cs = (2 * (F.col("xy") - F.col("mx") * F.col("my")) + c2) / (F.col("xx") - F.col("mx") * F.col("mx") + F.col("yy") - F.col("my") * F.col("my") + c2)
    return m.withColumn("cs", cs).withColumn("s", (2 * ux * uy + c1) / (ux * ux + uy * uy + c1) * F.col("cs"))


def halved(cells: DataFrame) -> DataFrame:
    """Means of whole 2 x 2 blocks."""
    blocks = cells.groupBy(*_IMAGE, F.expr("y div 2").cast("int").alias("y"), F.expr("x div 2").cast("int").alias("x"))
    means = blocks.agg(F.first("peak").alias("peak"), F.avg("r").alias("r"), F.avg("d").alias("d"), F.count("*").alias("n"))
    return means.where("n = 4").drop("n")


def gms_map(cells: DataFrame, t: float | None, eps: float | None) -> DataFrame:
    """cells with q, the similarity of gradient magnitudes."""
    limit = F.pow(F.col("peak") / 255, 2) * 170.0 if t is None else F.lit(t)
    floor = F.pow(F.col("peak") * 1e-6, 2) if eps is None else F.lit(eps)
    # the sum of three cells one way, and the difference over them the other way
    both = {f"{v}{k}": F.col(v) for v in "rd" for k in "xy"}
    wide = cells.withColumns(both)
    step = lambda c, w, plus: F.col(c) + F.lead(c, 1).over(w) + F.lead(c, 2).over(w) if plus else F.col(c) - F.lead(c, 2).over(w)
    for w, plus in ((_along("x"), "y"), (_along("y"), "x")):
        wide = wide.withColumns({c: step(c, w, c[1] == plus) for c in both} | {"fits": F.lead("peak", 2).over(w).isNotNull()}).where("fits")
    size = lambda v: F.sqrt(F.pow(F.col(f"{v}x") / 3, 2) + F.pow(F.col(f"{v}y") / 3, 2) + floor)
    wide = wide.withColumn("a", size("r")).withColumn("b", size("d"))
    return wide.withColumn("q", (2 * F.col("a") * F.col("b") + limit) / (F.col("a") * F.col("a") + F.col("b") * F.col("b") + limit))


def _difference(p: Plan) -> Column:
    e = F.col("r") - F.col("d")
    eps, delta = float(p.options.get("eps") or 0.0), float(p.options.get("delta", 1.0))
    return {
        "psnr": e * e, "mse": e * e, "l1": F.abs(e), "charbonnier": F.sqrt(e * e + eps * eps),
        "huber": F.when(F.abs(e) <= delta, 0.5 * e * e).otherwise(delta * (F.abs(e) - 0.5 * delta)),
    }[p.feature.name]


def _checked(pairs: DataFrame, plans: list[Plan]) -> DataFrame:
    """pairs; a plane too small for a feature fails the query."""
    for p in plans:
        unit = _units(p)[0]
        need = _least(unit) + 2 * unit.crop
        small = F.exists("ref", lambda v: F.least(v["height"], v["width"]) < need) if unit.kind == "pixel" else F.least(F.get("ref", F.lit(0))["height"], F.get("ref", F.lit(0))["width"]) < need  # noqa: B023
        pairs = pairs.withColumn("ref", F.when(small, F.raise_error(F.lit(f"{p.feature.name} needs {need} pixels a side"))).otherwise(F.col("ref")))
    return pairs


def score(pairs: DataFrame, feature: object, *, options: dict[str, dict] | None = None, color_family: str = "GRAY", **common) -> DataFrame:
    """clip_id, frame_no and a column a score, as by scoring.score, for one color_family."""
    plans = plan(feature, common, options)
    for p in plans:
        if p.feature.name not in FEATURES or p.options.get("luma") or p.options.get("downsample") and p.feature.name == "ssim":
            raise NotImplementedError(f"impl='sql' has no {p.feature.name} with these options; use impl='arrow'")
    family = pairs.withColumn("ref", F.when(F.col("color_family") != color_family, F.raise_error(F.lit(f"frames are not all {color_family}"))).otherwise(F.col("ref")))
    pairs = _checked(family, plans)
    results, columns = [], []
    for number, p in enumerate(plans):
        o, name = p.options, p.feature.name
        cells = pixels(pairs, o["crop_border"])
        if o["data_range"] is not None:
            cells = cells.withColumn("peak", F.lit(float(o["data_range"])))
        if p.feature.scope == "per_plane":
            aggs = {f"v{number}_{c}": F.avg(F.when(F.col("c") == c, _difference(p))) for c in range(len(SUFFIXES[color_family]))}
            found = cells.groupBy(*KEYS).agg(*[a.alias(n) for n, a in aggs.items()], F.first("peak").alias(f"top{number}"))
            columns += [(psnr(F.col(n), F.col(f"top{number}"), o["eps"]) if name == "psnr" else F.col(n)).alias(p.feature.column + s) for n, s in zip(aggs, SUFFIXES[color_family], strict=True)]
        else:
            cells, window = cells.where("image"), (o.get("win_size"), o.get("sigma"), *o.get("K", ()))
            value = f"v{number}"
            if name == "ssim":
                found = ssim_map(cells, *window).groupBy(*KEYS).agg(F.avg("s").alias(value))
            elif name == "ms_ssim":
                found, last = None, len(o["weights"]) - 1
                for j, w in enumerate(o["weights"]):
                    cells = halved(cells) if j else cells
                    mean = F.avg("s" if j == last else "cs")
                    scale = ssim_map(cells, *window).groupBy(*_IMAGE).agg(F.pow(F.greatest(mean, F.lit(0.0)), F.lit(float(w))).alias(f"m{j}"))
                    found = scale if found is None else found.join(scale, _IMAGE)
                product = reduce(lambda a, b: a * b, (F.col(f"m{j}") for j in range(last + 1)))
                found = found.groupBy(*KEYS).agg(F.avg(product).alias(value))
            else:
                cells = halved(cells) if o["downsample"] else cells
                found = gms_map(cells, o["T"], o["eps"]).groupBy(*KEYS).agg((F.stddev_pop("q") if name == "gmsd" else F.avg("q")).alias(value))
            columns.append(F.col(value).alias(p.feature.column))
        results.append(found)
    return reduce(lambda a, b: a.join(b, list(KEYS)), results).select(*KEYS, *columns)
