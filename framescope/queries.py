"""The frame queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope import __version__
from framescope.functions import pixels
from framescope.functions.pixels import LUMA, MS_SSIM_WEIGHTS, gaussian
from framescope.metrics import score_frames
from framescope.operators import gradients, logs, pooling, scoring
from framescope.operators.pairing import KEYS, mismatches, pair
from framescope.sources import frames, scratch, video

Query = Callable[[SparkSession, str], DataFrame]


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair(*frames.from_embeddings(spark, sf_dir))


def _rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair(*(frames.rgb(x, "rgb64") for x in frames.from_embeddings(spark, sf_dir)))


def _large(side: int, rgb: bool = False) -> Query:
    def source(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = frames.mosaics(spark, sf_dir, side)
        return pair(*((frames.rgb(x, f"rgb{side}") for x in found) if rgb else found))

    return source


def _deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair(*frames.from_embeddings(spark, sf_dir, bits=10))


def _float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair(*(frames.as_float(x, "emb64_f32") for x in frames.from_embeddings(spark, sf_dir)))


def _yuv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair(*(frames.yuv420(x, "yuv64") for x in frames.from_embeddings(spark, sf_dir)))


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, dist = frames.from_embeddings(spark, sf_dir)
    whole = scoring.append(dist, scoring.score(_pairs(spark, sf_dir), ["psnr", "l1"], color_family="GRAY"))
    return _rounded(whole.select(*KEYS, "color_family", "bits", F.md5(F.col("planes")[0]["data"]).alias("dist_md5"), "psnr", "l1"))


def _reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(score_frames(*frames.from_embeddings(spark, sf_dir), ["psnr", "l1", "ssim"], color_family="GRAY", reduction="mean"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _scored(source: Query, feature: object, family: str = "GRAY", finish: Callable[[DataFrame], DataFrame] = lambda x: x, **options) -> Query:
    return lambda spark, sf_dir: _rounded(finish(scoring.score(source(spark, sf_dir), feature, color_family=family, **options)))


def _identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, _ = frames.from_embeddings(spark, sf_dir)
    return pair(r, r)


def _map(feature: str, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = scoring.similarity_map(_pairs(spark, sf_dir), feature, **options)
        flat = m.select("frame_no", "top", "width", F.posexplode("data").alias("at", "v"))
        return flat.select("frame_no", F.expr("top + at div width").cast("long").alias("y"), F.expr("at % width").cast("long").alias("x"), F.round("v", 6).alias("v"))

    return query


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames written as YUV4MPEG2 files, some a clip, and read again from the third one on."""
    at = scratch.folder(spark)
    for name, table in zip(("ref", "dist"), frames.from_embeddings(spark, sf_dir), strict=True):
        video.write(table, f"{at}/{name}", "y4m", "overwrite", files=3)
    return pair(*(video.read(spark, f"{at}/{name}", "y4m").where("frame_no >= 2") for name in ("ref", "dist")))


def _mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults between stored tables, told from metadata: every third reference frame is missing, every fourth
    distorted one, and frame 5 has another shape."""
    at = scratch.folder(spark)
    r, d = frames.from_embeddings(spark, sf_dir)
    turned = F.transform("planes", lambda p: F.struct((p["height"] / 2).cast("int").alias("height"), (p["width"] * 2).alias("width"), p["data"].alias("data")))
    r.where("frame_no % 3 <> 1").write.parquet(f"{at}/ref")
    d.where("frame_no % 4 <> 2").withColumn("planes", F.when(F.col("frame_no") == 5, turned).otherwise(F.col("planes"))).write.parquet(f"{at}/dist")
    return mismatches(frames.read(spark, f"{at}/ref"), frames.read(spark, f"{at}/dist"))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of all three families, scored in one job."""
    gray = frames.from_embeddings(spark, sf_dir)
    both = [x.unionByName(frames.yuv420(x, "yuv64")).unionByName(frames.rgb(x, "rgb64")) for x in gray]
    return _rounded(score_frames(*both, ["psnr", "ssim", "gmsd"], color_family=scoring.ANY))


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-bit frames reshaped to 32 x 128 and cast to float32, in their old range."""
    return pair(*(frames.staged(x, 32, 128, "f32") for x in frames.from_embeddings(spark, sf_dir, bits=10)))


def _gradient(feature: str, **options) -> Query:
    """Gradients of 1000 times the score, pixel by pixel."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = gradients.gradients(_pairs(spark, sf_dir), feature, 1000.0, **options)
        flat = g.select("frame_no", "top", "left", "width", F.posexplode(F.arrays_zip("dx", "dy")).alias("at", "v"))
        return flat.select("frame_no", F.expr("top + at div width").cast("long").alias("y"), F.expr("left + at % width").cast("long").alias("x"), F.round("v.dx", 9).alias("dx"), F.round("v.dy", 9).alias("dy"))

    return query


ALL = ["mse", "psnr", "l1", "charbonnier", "huber", "ssim", "gms", "gmsd"]


def _log(format: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return logs.log(_scored(_pairs, ["psnr", "gmsd"])(spark, sf_dir), format, digits=6)

    return query


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "score_frames": _scored(_pairs, ALL),
        "pair_frames": lambda s, d: _pairs(s, d).select(*KEYS, F.col("ref")[0]["height"].alias("height"), F.col("ref")[0]["width"].alias("width"), F.md5(F.col("ref")[0]["data"]).alias("ref_md5"), F.md5(F.col("dist")[0]["data"]).alias("dist_md5")),
        "psnr_identical": _scored(_identical, ["psnr", "mse", "ssim", "gms", "gmsd"]),
        "psnr_batch": _scored(_pairs, ["psnr", "mse", "l1"], finish=lambda x: scoring.batch(x, 255.0)),
        "crop_border": _scored(_pairs, ["mse", "ssim", "gmsd"], crop_border=4),
        "y_psnr_crop": _scored(_rgb, "psnr", "RGB", luma="matlab", crop_border=4),
        "rgb_planes": _scored(_rgb, ["mse", "psnr", "ssim", "gms", "gmsd"], "RGB"),
        "ssim_map": _map("ssim"),
        "gms_map": _map("gms"),
        "ms_ssim": _scored(_large(192), "ms_ssim"),
        "ms_ssim_weights2": _scored(_pairs, "ms_ssim", weights=(0.4, 0.6)),
        "gmsd_nodown": _scored(_pairs, ["gms", "gmsd"], downsample=False),
        "pooled_scores": lambda s, d: _rounded(pooling.pooled(_scored(_pairs, ALL)(s, d))),
        "pooled_infinite": lambda s, d: _rounded(pooling.pooled(_scored(_identical, ["psnr", "mse", "ssim"])(s, d))),
        "worst_frames": lambda s, d: pooling.worst(_scored(_pairs, "psnr")(s, d), "psnr", 3),
        "loss": _scored(_pairs, ["l1", "charbonnier", "huber", "ssim", "gms"], finish=scoring.losses),
        "ssimulacra2": _scored(_rgb, "ssimulacra2", "RGB"),
        "yuv420": _scored(_yuv, ["mse", "psnr", "l1", "ssim", "gmsd"], "YUV"),
        "gray10": _scored(_deep, ALL),
        "float32": _scored(_float, ALL),
        "ssim_downsample": _scored(_large(384), "ssim", downsample=True),
        "ssimulacra2_odd6": _scored(_large(129, True), "ssimulacra2", "RGB"),
        "lpips_random": _scored(_rgb, "lpips", "RGB", options={"lpips": {"net": scoring.random_net()}}),
        "staged_frames": _scored(_staged, ["psnr", "l1", "huber"], data_range=1023.0), "frame_mismatches": _mismatches, "mixed_families": _mixed,
        "clip_files": _scored(_files, ["psnr", "ssim"]),
        "ssim_gradients": _gradient("ssim"),
        "ms_ssim_gradients": _gradient("ms_ssim", weights=(0.4, 0.6)),
        "impl_sql": lambda s, d: _rounded(score_frames(*frames.from_embeddings(s, d), ALL, impl="sql")),
        "impl_sql_ms_ssim": lambda s, d: _rounded(score_frames(*frames.from_embeddings(s, d), "ms_ssim", impl="sql", weights=(0.4, 0.6))),
        "append_scores": _appended, "reduction_mean": _reduced,
        "log_json": _log("json"), "log_xml": _log("xml"), "log_csv": _log("csv"), "log_sub": _log("sub"),
    }
    for name in ALL:
        out[name] = _scored(_pairs, name)
    for size in (3, 5, 7, 9):
        out[f"ssim_win{size}"] = _scored(_pairs, "ssim", win_size=size)
    for mode in LUMA:
        out[f"luma_{mode}"] = _scored(_rgb, ["mse", "psnr", "ssim", "gmsd"], "RGB", luma=mode)
    return out


# ---- the same rows in SQL, over long pixel relations px(f, c, y, x, r, d) ----

def _emb(bits: int = 8) -> str:
    top, scale = (1 << bits) - 1, 1 << (bits - 8)
    return f"""
e AS (SELECT vec_id // 64 AS f, 0 AS c, vec_id % 64 AS y, unnest(range(64)) AS x, unnest(embedding)::DOUBLE AS v FROM embeddings),
g AS (SELECT f FROM e GROUP BY f HAVING count(*) = 4096),
i AS (SELECT f, c, y, x, greatest(0, least({top}, floor({scale} * (128 + 400 * v))))::BIGINT AS r FROM e JOIN g USING (f)),
raw AS (SELECT *, greatest(0, least({top}, r + {scale} * ((7 * x + 13 * y + 5 * f) % 17 - 8))) AS d FROM i)"""


_EMB = _emb()
_FLOAT = f"""{_EMB},
raw1 AS (SELECT f, c, y, x, r / 256 AS r, d / 256 AS d FROM raw)"""
_RGB = f"""{_EMB},
raw3 AS (SELECT f // 3 AS f, f % 3 AS c, y, x, r, d FROM raw WHERE f // 3 < (SELECT count(*) FROM g) // 3)"""
_YUV = f"""{_RGB},
raw4 AS (SELECT * FROM raw3 WHERE c = 0 OR x < 32 AND y < 32)"""


def _wide(side: int, rgb: bool = False) -> str:
    return f"""
e AS (SELECT vec_id // {side} AS f, 0 AS c, vec_id % {side} AS y, unnest(range({side})) AS x, embedding FROM embeddings),
g AS (SELECT f FROM e GROUP BY f HAVING count(*) = {side * side}),
j AS (SELECT f, c, y, x, embedding[x % 64 + 1]::DOUBLE AS v FROM e JOIN g USING (f)),
i AS (SELECT f, c, y, x, greatest(0, least(255, floor(128 + 400 * CASE WHEN x // 64 % 2 = 0 THEN v ELSE -v END + 9 * (x // 64))))::BIGINT AS r FROM j),
flat AS (SELECT *, greatest(0, least(255, r + (7 * x + 13 * y + 5 * f) % 17 - 8)) AS d FROM i),
raw AS (SELECT {'f // 3 AS f, f % 3 AS c' if rgb else 'f, c'}, y, x, r, d FROM flat{' WHERE f // 3 < (SELECT count(*) FROM g) // 3' if rgb else ''})"""


_SOURCES = {
    "emb": (_EMB, "raw"), "rgb": (_RGB, "raw3"), "deep": (_emb(10), "raw"), "float": (_FLOAT, "raw1"), "yuv": (_YUV, "raw4"),
    "wide192": (_wide(192), "raw"), "wide384": (_wide(384), "raw"), "wide129": (_wide(129, True), "raw"),
}


def _px(source: str, width: int, height: int, crop: int = 0, luma: str | None = None, same: bool = False) -> tuple[str, int, int]:
    """CTEs that end in px, and its width and height."""
    text, last = _SOURCES[source]
    d = "r" if same else "d"
    cut = f"SELECT f, c, y - {crop} AS y, x - {crop} AS x, r::DOUBLE AS r, {d}::DOUBLE AS d FROM {last} WHERE x BETWEEN {crop} AND {width - crop - 1} AND y BETWEEN {crop} AND {height - crop - 1}"
    if luma:
        r, g, b, o = LUMA[luma]
        y = lambda v: f"sum({v} * CASE c WHEN 0 THEN {r!r} WHEN 1 THEN {g!r} ELSE {b!r} END) + {o * 255!r}"
        cut = f"SELECT f, 0 AS c, y, x, {y('r')} AS r, {y('d')} AS d FROM ({cut}) GROUP BY f, y, x"
    return f"{text},\npx AS ({cut})", width - 2 * crop, height - 2 * crop


def _stencil(name: str, source: str, columns: dict[str, str], taps: list[float], width: int, height: int) -> str:
    """CTEs {name}: separable correlation of expressions over source where the window fits."""
    k = len(taps)
    across = ", ".join(f"{' + '.join(f'{t!r} * lead({e}, {i}) OVER w' if i else f'{t!r} * ({e})' for i, t in enumerate(taps))} AS {c}" for c, e in columns.items())
    down = ", ".join(f"{' + '.join(f'{t!r} * lead({c}, {i}) OVER w' if i else f'{t!r} * {c}' for i, t in enumerate(taps))} AS {c}" for c in columns)
    return (
        f"{name}_h AS (SELECT f, c, y, x, {across} FROM {source} WINDOW w AS (PARTITION BY f, c, y ORDER BY x)),\n"
        f"{name} AS (SELECT * FROM (SELECT f, c, y, x, {down} FROM {name}_h WHERE x <= {width - k} WINDOW w AS (PARTITION BY f, c, x ORDER BY y)) WHERE y <= {height - k})"
    )


def _ssim_cte(name: str, source: str, width: int, height: int, size: int = 11, peak: float = 255.0) -> str:
    taps, half, c1, c2 = [float(t) for t in gaussian(size, 1.5)], peak / 2, (0.01 * peak) ** 2, (0.03 * peak) ** 2
    a, b = f"(r - {half!r})", f"(d - {half!r})"
    moments = _stencil(f"{name}_m", source, {"mx": a, "my": b, "xx": f"{a} * {a}", "yy": f"{b} * {b}", "xy": f"{a} * {b}"}, taps, width, height)
    return (
        f"{moments},\n{name}_v AS (SELECT f, c, y, x, mx + {half!r} AS ux, my + {half!r} AS uy, (2 * (xy - mx * my) + {c2!r}) / (xx - mx * mx + yy - my * my + {c2!r}) AS cs FROM {name}_m),\n"
        f"{name} AS (SELECT f, c, y, x, (2 * ux * uy + {c1!r}) / (ux * ux + uy * uy + {c1!r}) * cs AS s, cs FROM {name}_v)"
    )


def _half_cte(name: str, source: str, width: int, height: int) -> str:
    return f"{name} AS (SELECT f, c, y // 2 AS y, x // 2 AS x, avg(r) AS r, avg(d) AS d FROM {source} WHERE x < {width // 2 * 2} AND y < {height // 2 * 2} GROUP BY ALL)"


def _gms_cte(name: str, source: str, width: int, height: int, peak: float = 255.0) -> str:
    t, eps = 170 * (peak / 255) ** 2, (1e-6 * peak) ** 2

    def gradient(v: str) -> str:
        at = {(i, j): f"lead({v}_{i}, {j}) OVER w" if j else f"{v}_{i}" for i in range(3) for j in range(3)}
        gx = " + ".join(f"{at[i, 0]} - {at[i, 2]}" for i in range(3))
        gy = " + ".join(f"{at[0, j]} - {at[2, j]}" for j in range(3))
        return f"sqrt((({gx}) / 3) ** 2 + (({gy}) / 3) ** 2 + {eps!r})"

    rows = ", ".join(f"lead({v}, {i}) OVER w AS {v}_{i}" if i else f"{v} AS {v}_0" for v in "rd" for i in range(3))
    return (
        f"{name}_r AS (SELECT f, c, y, x, {rows} FROM {source} WINDOW w AS (PARTITION BY f, c, x ORDER BY y)),\n"
        f"{name}_g AS (SELECT f, c, y, x, {gradient('r')} AS a, {gradient('d')} AS b FROM {name}_r WHERE y <= {height - 3} WINDOW w AS (PARTITION BY f, c, y ORDER BY x)),\n"
        f"{name} AS (SELECT f, c, y, x, (2 * a * b + {t!r}) / (a * a + b * b + {t!r}) AS q FROM {name}_g WHERE x <= {width - 3})"
    )


_PIXEL = {
    "mse": "avg((r - d) * (r - d))", "l1": "avg(abs(r - d))", "charbonnier": "avg(sqrt((r - d) * (r - d) + 1e-6))",
    "huber": "avg(CASE WHEN abs(r - d) <= 1 THEN 0.5 * (r - d) * (r - d) ELSE abs(r - d) - 0.5 END)",
}
_PIXEL["psnr"] = f"CASE WHEN {_PIXEL['mse']} = 0 THEN 'inf'::DOUBLE ELSE 10 * log10(65025.0) - 10 * log10({_PIXEL['mse']}) END"
_COLUMN = {"ssim": "float_ssim", "ms_ssim": "float_ms_ssim"}


def _scores_sql(features: list[str], clip: str, source: str = "emb", width: int = 64, height: int = 64, size: int = 11, down: bool = True, planes: str = "", peak: float = 255.0, **cut) -> tuple[str, list[str]]:
    """CTEs that end in sc(clip_id, frame_no, scores unrounded), and the score columns. planes: suffixes of
    the planes, comma-joined; those of YUV leave the other features to the first one."""
    text, w, h = _px(source, width, height, **cut)
    ctes, joins, columns = [text], [], []
    pixel = {f: _PIXEL[f].replace("65025.0", repr(peak * peak)) for f in features if f in _PIXEL}
    if pixel:
        if planes:
            names = planes.split(",")
            each = ", ".join(f"{p.replace('(r - d)', f'(CASE WHEN c = {c} THEN r - d END)').replace('abs(r - d)', f'abs(CASE WHEN c = {c} THEN r - d END)')} AS {f}_{n}" for f, p in pixel.items() for c, n in enumerate(names))
            columns += [f"{f}_{n}" for f in pixel for n in names]
        else:
            each = ", ".join(f"{p} AS {f}" for f, p in pixel.items())
            columns += pixel
        ctes.append(f"s_px AS (SELECT f, {each} FROM px GROUP BY f)")
        joins.append("s_px")
    image = "px"
    if planes.startswith("y"):
        ctes.append("first AS (SELECT * FROM px WHERE c = 0)")
        image = "first"
    if "ssim" in features:
        ctes += [_ssim_cte("ss", image, w, h, size, peak), "s_ss AS (SELECT f, avg(s) AS float_ssim FROM ss GROUP BY f)"]
        joins.append("s_ss")
        columns.append("float_ssim")
    if {"gms", "gmsd"} & {*features}:
        if down:
            ctes += [_half_cte("hp", image, w, h), _gms_cte("gq", "hp", w // 2, h // 2, peak)]
        else:
            ctes.append(_gms_cte("gq", image, w, h, peak))
        ctes.append("s_gq AS (SELECT f, avg(q) AS gms, stddev_pop(q) AS gmsd FROM gq GROUP BY f)")
        joins.append("s_gq")
        columns += [f for f in features if f in ("gms", "gmsd")]
    order = [_COLUMN.get(f, f) for f in features]
    columns.sort(key=lambda c: order.index(c) if c in order else [c.startswith(f) for f in features].index(True))
    ctes.append(f"sc AS (SELECT '{clip}' AS clip_id, f::BIGINT AS frame_no, {', '.join(columns)} FROM {joins[0]} {' '.join(f'JOIN {j} USING (f)' for j in joins[1:])})")
    return ",\n".join(ctes), columns


def _select(columns: list[str], text: str) -> str:
    return f"WITH {text}\nSELECT clip_id, frame_no, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM sc"


def _sql(features: list[str], clip: str = "emb64", **options) -> str:
    text, columns = _scores_sql(features, clip, **options)
    return _select(columns, text)


def _ms_ssim_sql(clip: str, source: str, side: int, weights: tuple[float, ...]) -> str:
    text, w, h = _px(source, side, side)
    ctes, prior = [text], "px"
    for j, _ in enumerate(weights):
        if j:
            ctes.append(_half_cte(f"p{j}", prior, w, h))
            prior, w, h = f"p{j}", w // 2, h // 2
        ctes.append(_ssim_cte(f"z{j}", prior, w, h))
        ctes.append(f"t{j} AS (SELECT f, greatest(avg({'s' if j == len(weights) - 1 else 'cs'}), 0) AS v{j} FROM z{j} GROUP BY f)")
    product = " * ".join(f"v{j} ** {w!r}" for j, w in enumerate(weights))
    joins = " ".join(f"JOIN t{j} USING (f)" for j in range(1, len(weights)))
    return f"WITH {', '.join(ctes)}\nSELECT '{clip}' AS clip_id, f::BIGINT AS frame_no, round({product}, 6) AS float_ms_ssim FROM t0 {joins}"


def _ssimulacra2_sql(clip: str, source: str, side: int) -> str:
    """All scales as window functions, zero outside the frame, on the long relation of linear light."""
    text, size, _ = _px(source, side, side)
    linear = lambda v: f"CASE WHEN {v} / 255 <= 0.04045 THEN {v} / 255 / 12.92 ELSE (({v} / 255 + 0.055) / 1.055) ** 2.4 END"
    ctes = [text, f"l0 AS (SELECT f, c, y, x, {linear('r')} AS a, {linear('d')} AS b FROM px)"]
    taps, bias = [float(t) for t in pixels.cosine_taps()], pixels._BIAS

    def blur(e: str) -> str:
        at = lambda k: f"({e})" if k == 0 else f"coalesce({'lead' if k > 0 else 'lag'}({e}, {abs(k)}) OVER w, 0)"
        return " + ".join(f"{t!r} * {at(k - 5)}" for k, t in enumerate(taps))

    s = 0
    while s < 6 and size >= 8:
        if s:
            ctes.append(f"l{s} AS (SELECT f, c, y // 2 AS y, x // 2 AS x, avg(a) AS a, avg(b) AS b FROM l{s - 1} GROUP BY ALL)")
            size = -(-size // 2)
        wide = ", ".join(f"max(CASE WHEN c = {c} THEN {v} END) AS {v}{c}" for v in "ab" for c in range(3))
        cone = ", ".join(f"cbrt(greatest({' + '.join(f'{float(m)!r} * {v}{c}' for c, m in enumerate(row))} + {bias!r}, 0)) - cbrt({bias!r}) AS {v}_{n}" for v in "ab" for n, row in zip("lms", pixels._OPSIN, strict=True))
        forms = ("({v}_l - {v}_m) * 7 + 0.42", "({v}_l + {v}_m) / 2 + 0.01", "{v}_s - ({v}_l + {v}_m) / 2 + 0.55")
        rows = " UNION ALL ".join(f"SELECT f, {c} AS c, y, x, {form.format(v='a')} AS p, {form.format(v='b')} AS q FROM o{s}" for c, form in enumerate(forms))
        groups = {"mp": "p", "mq": "q", "pp": "p * p", "qq": "q * q", "pq": "p * q"}
        across = ", ".join(f"{blur(e)} AS {n}" for n, e in groups.items())
        down = ", ".join(f"{blur(n)} AS {n}" for n in groups)
        norms = ", ".join(f"avg({m}) AS {m}0, avg({m} ** 4) ** 0.25 AS {m}1" for m in ("st", "ring", "lost"))
        ctes += [
            f"o{s} AS (SELECT f, y, x, {cone} FROM (SELECT f, y, x, {wide} FROM l{s} GROUP BY f, y, x))", f"x{s} AS ({rows})",
            f"h{s} AS (SELECT f, c, y, x, p, q, {across} FROM x{s} WINDOW w AS (PARTITION BY f, c, y ORDER BY x))",
            f"v{s} AS (SELECT f, c, y, x, p, q, {down} FROM h{s} WINDOW w AS (PARTITION BY f, c, x ORDER BY y))",
            f"d{s} AS (SELECT f, c, 1 - (mp - mq) ** 2 AS num_m, 2 * (pq - mp * mq) + 0.0009 AS num_s, (pp - mp * mp) + (qq - mq * mq) + 0.0009 AS den, (abs(q - mq) - abs(p - mp)) / (1 + abs(p - mp)) AS e FROM v{s})",
            f"n{s} AS (SELECT f, c, {norms} FROM (SELECT f, c, greatest(1 - num_m * num_s / den, 0) AS st, greatest(e, 0) AS ring, greatest(-e, 0) AS lost FROM d{s}) GROUP BY f, c)",
        ]
        s += 1
    weights = iter(pixels.WEIGHTS)
    terms = [f"{float(next(weights))!r} * abs((SELECT {m}{n} FROM n{k} WHERE n{k}.f = t.f AND n{k}.c = {c}))" for c in range(3) for k in range(s) for n in range(2) for m in ("st", "ring", "lost")]
    ctes.append(f"t AS (SELECT DISTINCT f FROM px), z AS (SELECT f, ({' + '.join(x for x in terms if not x.startswith('0.0 '))}) * 0.9562382616834844 AS s FROM t)")
    ctes.append("u AS (SELECT f, 2.326765642916932 * s - 0.020884521182843837 * s * s + 6.248496625763138e-05 * s * s * s AS s FROM z)")
    return f"WITH {', '.join(ctes)}\nSELECT '{clip}' AS clip_id, f::BIGINT AS frame_no, round(CASE WHEN s > 0 THEN 100 - 10 * s ** 0.6276336467831387 ELSE 100 END, 6) AS ssimulacra2 FROM u"


def _pool_sql(features: list[str], **options) -> str:
    text, columns = _scores_sql(features, "emb64", **options)
    rows = " UNION ALL ".join(f"SELECT clip_id, '{c}' AS prop, round({c}, 6) AS v FROM sc" for c in columns)
    harmonic = "CASE WHEN min(v) <= -1 THEN 'nan'::DOUBLE WHEN sum(1 / (v + 1)) = 0 THEN 'inf'::DOUBLE ELSE count(*) / sum(1 / (v + 1)) - 1 END"
    return f"WITH {text}, u AS ({rows})\nSELECT clip_id, prop, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round({harmonic}, 6) AS harmonic_mean FROM u GROUP BY clip_id, prop"


def _log_sql(format: str) -> str:
    text, _ = _scores_sql(["psnr", "gmsd"], "emb64")
    text += ",\nro AS (SELECT clip_id, frame_no, round(psnr, 6) AS psnr, round(gmsd, 6) AS gmsd FROM sc)"
    number = lambda c: f"printf('%.6f', {c})"
    if format == "csv":
        return f"WITH {text}\nSELECT -1::BIGINT AS place, 'frameNum,psnr,gmsd' AS line UNION ALL SELECT frame_no, frame_no || ',' || {number('psnr')} || ',' || {number('gmsd')} FROM ro"
    if format == "sub":
        return f"WITH {text}\nSELECT frame_no AS place, '{{' || frame_no || '}}{{' || (frame_no + 1) || '}}frame: ' || frame_no || '|psnr: ' || {number('psnr')} || '|gmsd: ' || {number('gmsd')} || '|' AS line FROM ro"
    last = 1 << 62
    stats = {"min": "min({c})", "max": "max({c})", "mean": "avg({c})", "harmonic_mean": "count(*) / sum(1 / ({c} + 1)) - 1"}
    fixed = lambda at, *lines: " UNION ALL ".join(f"SELECT {at + i}::BIGINT AS place, '{x}' AS line" for i, x in enumerate(lines))
    if format == "xml":
        show = lambda names: " || ' ' || ".join(f"'{n}=\"' || {number(e)} || '\"'" for n, e in names)
        parts = [fixed(-3, '<?xml version="1.0" encoding="utf-8"?>', f'<framescope version="{__version__}">', "  <frames>"), f"SELECT frame_no, '    <frame frameNum=\"' || frame_no || '\" ' || {show([('psnr', 'psnr'), ('gmsd', 'gmsd')])} || '/>' FROM ro", fixed(last - 1, "  </frames>", "  <pooled_metrics>")]
        parts += [f"SELECT {last + i}::BIGINT, '    <metric name=\"{c}\" ' || {show([(s, e.format(c=c)) for s, e in stats.items()])} || '/>' FROM ro" for i, c in enumerate(("psnr", "gmsd"), 1)]
        parts.append(fixed(last + 3, "  </pooled_metrics>", "</framescope>"))
    else:
        show = lambda names: " || ', ' || ".join(f"'\"{n}\": ' || ({e})::VARCHAR" for n, e in names)
        parts = [fixed(-2, f'{{"version": "{__version__}",', '  "frames": ['), f"SELECT frame_no, CASE WHEN frame_no = (SELECT min(frame_no) FROM ro) THEN '    ' ELSE '   ,' END || '{{\"frameNum\": ' || frame_no || ', \"metrics\": {{' || {show([('psnr', 'psnr'), ('gmsd', 'gmsd')])} || '}}}}' FROM ro", fixed(last - 1, "  ],", '  "pooled_metrics": {')]
        parts += [f"SELECT {last + i}::BIGINT, '{'    ' if i == 1 else '   ,'}\"{c}\": {{' || {show([(s, f'round({e.format(c=c)}, 6)') for s, e in stats.items()])} || '}}' FROM ro" for i, c in enumerate(("psnr", "gmsd"), 1)]
        parts.append(fixed(last + 3, "  }", "}"))
    return f"WITH {text}\n" + " UNION ALL ".join(parts)


def _downsample_sql(clip: str, side: int) -> str:
    """Means of 2 x 2 boxes with a replicated edge, every second one, then SSIM."""
    text, w, h = _px(f"wide{side}", side, side)
    edge = lambda v: f"(1 + ({v} = 0)::INT + ({v} = {side - 1})::INT)"
    small = f"small AS (SELECT f, c, (y + 1) // 2 AS y, (x + 1) // 2 AS x, sum({edge('y')} * {edge('x')} * r) / 4 AS r, sum({edge('y')} * {edge('x')} * d) / 4 AS d FROM px GROUP BY ALL)"
    return f"WITH {text},\n{small},\n{_ssim_cte('ss', 'small', w // 2 + 1, h // 2 + 1)}\nSELECT '{clip}' AS clip_id, f::BIGINT AS frame_no, round(avg(s), 6) AS float_ssim FROM ss GROUP BY f"


def _gradient_ctes(name: str, source: str, width: int, height: int, on_full: str, on_contrast: str, scalars: str = "") -> str:
    """CTEs that end in {name}(f, c, y, x, dx, dy): derivatives by the window means, spread back to every pixel
    whose windows they came from. on_full, on_contrast: dL by each value of the SSIM and the contrast map."""
    taps, half, c1, c2 = [float(t) for t in gaussian(11, 1.5)], 127.5, (0.01 * 255) ** 2, (0.03 * 255) ** 2
    a, b = f"(r - {half!r})", f"(d - {half!r})"
    back = lambda c: " + ".join(f"{t!r} * coalesce({f'lag({c}, {i}) OVER w' if i else c}, 0)" for i, t in enumerate(taps))
    across, down = (", ".join(f"{back(c)} AS {c}" for c in ("ax", "ay", "sq", "cr")) for _ in range(2))
    return f"""{_stencil(f"{name}_m", source, {"mx": a, "my": b, "xx": f"{a} * {a}", "yy": f"{b} * {b}", "xy": f"{a} * {b}"}, taps, width, height)},
{name}_v AS (SELECT f, c, y, x, mx, my, mx + {half!r} AS ux, my + {half!r} AS uy, xx - mx * mx + yy - my * my + {c2!r} AS below, 2 * (xy - mx * my) + {c2!r} AS above FROM {name}_m),
{name}_w AS (SELECT *, above / below AS cs, ux * ux + uy * uy + {c1!r} AS power, (2 * ux * uy + {c1!r}) / (ux * ux + uy * uy + {c1!r}) AS light FROM {name}_v),
{name}_k AS (SELECT *, {on_full} * cs AS by_light, 2 * ({on_full} * light + {on_contrast}) / below AS cr FROM {name}_w {scalars}),
{name}_c AS (SELECT f, c, y, x, 2 * by_light * (uy - ux * light) / power + cr * (cs * mx - my) AS ax, 2 * by_light * (ux - uy * light) / power + cr * (cs * my - mx) AS ay, -cs * cr / 2 AS sq, cr FROM {name}_k),
{name}_g AS (SELECT p.f, p.c, p.y, p.x, {a} AS r, {b} AS d, ax, ay, sq, cr FROM {source} p LEFT JOIN {name}_c q ON p.f = q.f AND p.c = q.c AND p.y = q.y AND p.x = q.x),
{name}_h AS (SELECT f, c, y, x, r, d, {across} FROM {name}_g WINDOW w AS (PARTITION BY f, c, y ORDER BY x)),
{name}_d AS (SELECT f, c, y, x, r, d, {down} FROM {name}_h WINDOW w AS (PARTITION BY f, c, x ORDER BY y)),
{name} AS (SELECT f, c, y, x, ax + 2 * r * sq + d * cr AS dx, ay + 2 * d * sq + r * cr AS dy FROM {name}_d)"""


def _gradient_sql() -> str:
    share = repr(1000.0 / 54**2)
    return f"WITH {_px('emb', 64, 64)[0]},\n{_gradient_ctes('ga', 'px', 64, 64, share, '0')}\nSELECT f::BIGINT AS frame_no, y::BIGINT AS y, x::BIGINT AS x, round(dx, 9) AS dx, round(dy, 9) AS dy FROM ga"


def _ms_gradient_sql(a: float, b: float) -> str:
    """Two scales: the product rule gives each one's share, and half a frame's gradient is spread over its blocks."""
    ctes = [
        _px("emb", 64, 64)[0], _half_cte("hp", "px", 64, 64), _ssim_cte("z0", "px", 64, 64), _ssim_cte("z1", "hp", 32, 32),
        "t0 AS (SELECT f, avg(cs) AS m0 FROM z0 GROUP BY f)", "t1 AS (SELECT f, avg(s) AS m1 FROM z1 GROUP BY f)",
        f"t AS (SELECT f, CASE WHEN m0 > 0 AND m1 > 0 THEN 1000 * {a!r} * m0 ** {a!r} * m1 ** {b!r} / m0 / {54**2} ELSE 0 END AS g0, CASE WHEN m0 > 0 AND m1 > 0 THEN 1000 * {b!r} * m0 ** {a!r} * m1 ** {b!r} / m1 / {22**2} ELSE 0 END AS g1 FROM t0 JOIN t1 USING (f))",
        _gradient_ctes("ga", "px", 64, 64, "0", "g0", "JOIN t USING (f)"), _gradient_ctes("gb", "hp", 32, 32, "g1", "0", "JOIN t USING (f)"),
    ]
    return f"WITH {', '.join(ctes)}\nSELECT ga.f::BIGINT AS frame_no, ga.y::BIGINT AS y, ga.x::BIGINT AS x, round(ga.dx + gb.dx / 4, 9) AS dx, round(ga.dy + gb.dy / 4, 9) AS dy FROM ga JOIN gb ON ga.f = gb.f AND ga.c = gb.c AND ga.y // 2 = gb.y AND ga.x // 2 = gb.x"


def _mismatch_sql() -> str:
    return f"""WITH {_EMB}, n AS (SELECT DISTINCT f FROM raw)
SELECT 'emb64' AS clip_id, f::BIGINT AS frame_no, CASE WHEN f % 3 = 1 THEN 'has no reference frame' WHEN f % 4 = 2 THEN 'has no distorted frame' ELSE 'differs in format or size' END AS fault
FROM n WHERE (f % 3 = 1) <> (f % 4 = 2) OR f = 5 AND f % 3 <> 1"""


def _mixed_sql() -> str:
    """The three families' own queries, one under the other, each with its own columns."""
    planes = {"emb64": ("emb", ""), "yuv64": ("yuv", "y,cb,cr"), "rgb64": ("rgb", "r,g,b")}
    every = ["psnr", *(f"psnr_{x}" for x in ("y", "cb", "cr", "r", "g", "b")), "float_ssim", "gmsd"]
    parts = []
    for clip, (source, names) in planes.items():
        text, columns = _scores_sql(["psnr", "ssim", "gmsd"], clip, source=source, planes=names)
        picked = ", ".join(f"round({c}, 6) AS {c}" if c in columns else f"NULL::DOUBLE AS {c}" for c in every)
        parts.append(f"SELECT * FROM (WITH {text} SELECT clip_id, frame_no, {picked} FROM sc)")
    return " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    batch, _ = _scores_sql(["psnr", "mse", "l1"], "emb64")
    worst, _ = _scores_sql(["psnr"], "emb64")
    appended, _ = _scores_sql(["psnr", "l1"], "emb64")
    mean, _ = _scores_sql(["mse", "l1", "ssim"], "emb64")
    loss, _ = _scores_sql(["l1", "charbonnier", "huber", "ssim", "gms"], "emb64")
    maps = lambda cte, name, v: f"WITH {_px('emb', 64, 64)[0]},\n{cte}\nSELECT f::BIGINT AS frame_no, y::BIGINT AS y, x::BIGINT AS x, round({v}, 6) AS v FROM {name}"
    bytes_ = lambda v: f"md5(unhex(string_agg(printf('%02X', {v}), '' ORDER BY y, x)))"
    out = {
        "score_frames": _sql(ALL),
        "pair_frames": f"WITH {_EMB}\nSELECT 'emb64' AS clip_id, f::BIGINT AS frame_no, 64 AS height, 64 AS width, {bytes_('r')} AS ref_md5, {bytes_('d')} AS dist_md5 FROM raw GROUP BY f",
        "psnr_identical": _sql(["psnr", "mse", "ssim", "gms", "gmsd"], same=True),
        "psnr_batch": f"WITH {batch}\nSELECT round(10 * log10(65025.0) - 10 * log10(avg(mse)), 6) AS psnr, round(avg(mse), 6) AS mse, round(avg(l1), 6) AS l1 FROM sc",
        "crop_border": _sql(["mse", "ssim", "gmsd"], crop=4),
        "y_psnr_crop": _sql(["psnr"], "rgb64", source="rgb", luma="matlab", crop=4),
        "rgb_planes": _sql(["mse", "psnr", "ssim", "gms", "gmsd"], "rgb64", source="rgb", planes="r,g,b"),
        "ssim_map": maps(_ssim_cte("ss", "px", 64, 64), "ss", "s"),
        "gms_map": maps(f"{_half_cte('hp', 'px', 64, 64)},\n{_gms_cte('gq', 'hp', 32, 32)}", "gq", "q"),
        "ms_ssim": _ms_ssim_sql("emb192", "wide192", 192, MS_SSIM_WEIGHTS),
        "ms_ssim_weights2": _ms_ssim_sql("emb64", "emb", 64, (0.4, 0.6)),
        "gmsd_nodown": _sql(["gms", "gmsd"], down=False),
        "pooled_scores": _pool_sql(ALL),
        "pooled_infinite": _pool_sql(["psnr", "mse", "ssim"], same=True),
        "worst_frames": f"WITH {worst}\nSELECT clip_id, frame_no, round(psnr, 6) AS psnr FROM sc ORDER BY 3, 1, 2 LIMIT 3",
        "loss": f"WITH {loss}\nSELECT clip_id, frame_no, round(1 - float_ssim, 6) AS loss_ssim, round(1 - gms, 6) AS loss_gms, round(l1, 6) AS loss_l1, round(charbonnier, 6) AS loss_charbonnier, round(huber, 6) AS loss_huber FROM sc",
        "ssimulacra2": _ssimulacra2_sql("rgb64", "rgb", 64),
        "log_csv": _log_sql("csv"), "log_sub": _log_sql("sub"), "log_json": _log_sql("json"), "log_xml": _log_sql("xml"),
        "yuv420": _sql(["mse", "psnr", "l1", "ssim", "gmsd"], "yuv64", source="yuv", planes="y,cb,cr"),
        "gray10": _sql(ALL, "emb64_10", source="deep", peak=1023.0),
        "float32": _sql(ALL, "emb64_f32", source="float", peak=1.0),
        "ssim_downsample": _downsample_sql("emb384", 384),
        "ssimulacra2_odd6": _ssimulacra2_sql("rgb129", "wide129", 129),
        "staged_frames": _sql(["psnr", "l1", "huber"], "emb64_10", source="deep", peak=1023.0), "frame_mismatches": _mismatch_sql(), "mixed_families": _mixed_sql(),
        "clip_files": _sql(["psnr", "ssim"]) + " WHERE frame_no >= 2",
        "ssim_gradients": _gradient_sql(), "ms_ssim_gradients": _ms_gradient_sql(0.4, 0.6),
        "impl_sql": _sql(ALL), "impl_sql_ms_ssim": _ms_ssim_sql("emb64", "emb", 64, (0.4, 0.6)),
        "append_scores": f"WITH {appended},\nds AS (SELECT f::BIGINT AS frame_no, {bytes_('d')} AS dist_md5 FROM raw GROUP BY f)\nSELECT clip_id, frame_no, 'GRAY' AS color_family, 8 AS bits, dist_md5, round(psnr, 6) AS psnr, round(l1, 6) AS l1 FROM sc JOIN ds USING (frame_no)",
        "reduction_mean": f"WITH {mean}\nSELECT round(10 * log10(65025.0) - 10 * log10(avg(mse)), 6) AS psnr, round(avg(l1), 6) AS l1, round(avg(float_ssim), 6) AS float_ssim FROM sc",
    }
    for name in ALL:
        out[name] = _sql([name])
    for size in (3, 5, 7, 9):
        out[f"ssim_win{size}"] = _sql(["ssim"], size=size)
    for mode in LUMA:
        out[f"luma_{mode}"] = _sql(["mse", "psnr", "ssim", "gmsd"], "rgb64", source="rgb", luma=mode)
    return out
