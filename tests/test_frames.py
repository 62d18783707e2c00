"""Frame scores against independent float64 formulas, and the contract's errors."""

import json
import math
import xml.dom.minidom

import numpy as np
import pytest
from pyspark.sql import functions as F

from framescope.functions import pixels
from framescope.metrics import Metric, score_frames
from framescope.operators import logs, pooling, scoring
from framescope.operators.pairing import pair
from framescope.plans import features
from framescope.sources import frames

CODES = {"u8": "u1", "u16": "<u2", "f32": "<f4", "f64": "<f8"}


def table(spark, images, family="GRAY", dtype="u8", bits=None, first=0):
    """images: one list of 2-d planes a frame."""
    rows = [("c", first + i, family, bits, dtype, [(p.shape[0], p.shape[1], p.astype(CODES[dtype]).tobytes()) for p in planes]) for i, planes in enumerate(images)]
    return spark.createDataFrame(rows, frames.SCHEMA)


def noisy(h, w, seed, noise=9, planes=1):
    rng = np.random.default_rng(seed)
    a = [rng.integers(0, 256, (h, w)).astype(float) for _ in range(planes)]
    return a, [np.clip(np.round(x + noise * rng.normal(size=x.shape)), 0, 255) for x in a]


def one(scores):
    row = scores.collect()
    assert len(row) == 1
    return row[0].asDict()


def window2d(size):
    t = np.arange(size) - (size - 1) / 2
    w = np.exp(-(t[:, None] ** 2 + t[None] ** 2) / 4.5)
    return w / w.sum()


def correlate(p, k):
    h, w = p.shape[0] - k.shape[0] + 1, p.shape[1] - k.shape[1] + 1
    return sum(k[i, j] * p[i : i + h, j : j + w] for i in range(k.shape[0]) for j in range(k.shape[1]))


def ssim2d(x, y, size=11, peak=255.0):
    w = window2d(size)
    mx, my = correlate(x, w), correlate(y, w)
    xx, yy, xy = correlate(x * x, w) - mx * mx, correlate(y * y, w) - my * my, correlate(x * y, w) - mx * my
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    cs = (2 * xy + c2) / (xx + yy + c2)
    return (2 * mx * my + c1) / (mx * mx + my * my + c1) * cs, cs


def half2d(p):
    h, w = p.shape[0] // 2 * 2, p.shape[1] // 2 * 2
    return p[:h, :w].reshape(h // 2, 2, w // 2, 2).mean(axis=(1, 3))


def gms2d(x, y, peak=255.0):
    k = np.array([[1, 0, -1]] * 3) / 3
    e = (1e-6 * peak) ** 2
    a, b = (np.sqrt(correlate(p, k) ** 2 + correlate(p, k.T) ** 2 + e) for p in (x, y))
    t = 170 * (peak / 255) ** 2
    return (2 * a * b + t) / (a * a + b * b + t)


@pytest.mark.parametrize(("h", "w"), [(64, 64), (127, 233), (33, 41), (1100, 40)])
def test_gray_scores(spark, h, w):
    (x,), (y,) = noisy(h, w, h * w)
    got = one(score_frames(table(spark, [[x]]), table(spark, [[y]]), ["mse", "psnr", "l1", "charbonnier", "huber", "ssim", "gms", "gmsd"], color_family="GRAY"))
    d = x - y
    q = gms2d(half2d(x), half2d(y))
    want = {
        "mse": (d * d).mean(), "psnr": 10 * math.log10(255**2 / (d * d).mean()), "l1": abs(d).mean(), "charbonnier": np.sqrt(d * d + 1e-6).mean(),
        "huber": np.where(abs(d) <= 1, d * d / 2, abs(d) - 0.5).mean(), "float_ssim": ssim2d(x, y)[0].mean(), "gms": q.mean(), "gmsd": q.std(),
    }
    assert got.keys() - {"clip_id", "frame_no"} == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k


@pytest.mark.parametrize(("h", "w"), [(200, 232), (257, 193), (176, 176), (1300, 180)])
def test_ms_ssim(spark, h, w):
    (x,), (y,) = noisy(h, w, h + w)
    got = one(score_frames(table(spark, [[x]]), table(spark, [[y]]), "ms_ssim", color_family="GRAY"))["float_ms_ssim"]
    want = 1.0
    for j, weight in enumerate(pixels.MS_SSIM_WEIGHTS):
        s, cs = ssim2d(x, y)
        want *= max((s if j == 4 else cs).mean(), 0) ** weight
        x, y = half2d(x), half2d(y)
    assert got == pytest.approx(want, abs=1e-9)


def test_identity(spark):
    (x,), _ = noisy(64, 64, 1)
    t = table(spark, [[x]])
    got = one(score_frames(t, t, ["psnr", "mse", "ssim", "gms", "gmsd"], color_family="GRAY"))
    assert got["psnr"] == math.inf and got["mse"] == 0 and got["float_ssim"] == pytest.approx(1, abs=1e-12) and got["gms"] == 1 and got["gmsd"] == 0


def test_rgb_planes_luma_and_crop(spark):
    x, y = noisy(60, 72, 99, planes=3)
    r, d = table(spark, [x], "RGB"), table(spark, [y], "RGB")
    got = one(score_frames(r, d, ["psnr", "ssim", "gmsd"], color_family="RGB", crop_border=4))
    cut = [[p[4:-4, 4:-4] for p in v] for v in (x, y)]
    assert got["psnr_g"] == pytest.approx(10 * math.log10(255**2 / ((cut[0][1] - cut[1][1]) ** 2).mean()))
    assert got["float_ssim"] == pytest.approx(np.mean([ssim2d(a, b)[0].mean() for a, b in zip(*cut, strict=True)]), abs=1e-9)
    assert got["gmsd"] == pytest.approx(np.stack([gms2d(half2d(a), half2d(b)) for a, b in zip(*cut, strict=True)]).std(), abs=1e-9)
    for mode, (cr, cg, cb, o) in pixels.LUMA.items():
        a, b = (cr * v[0] + cg * v[1] + cb * v[2] + o * 255 for v in cut)
        got = one(score_frames(r, d, ["mse", "ssim"], color_family="RGB", luma=mode, crop_border=4))
        assert got["mse"] == pytest.approx(((a - b) ** 2).mean(), abs=1e-9)
        assert got["float_ssim"] == pytest.approx(ssim2d(a, b)[0].mean(), abs=1e-9)


def test_yuv_planes_of_their_own_size(spark):
    (y0, c1), (y1, c2) = zip(noisy(48, 64, 5)[0] + noisy(24, 32, 6)[0], noisy(48, 64, 7)[0] + noisy(24, 32, 8)[0], strict=True)
    r, d = table(spark, [[y0, y1, y1]], "YUV"), table(spark, [[c1, c2, y1]], "YUV")
    got = one(score_frames(r, d, ["psnr", "mse", "ssim"]))
    assert got["mse_y"] == pytest.approx(((y0 - c1) ** 2).mean()) and got["mse_cb"] == pytest.approx(((y1 - c2) ** 2).mean())
    assert got["psnr_cr"] == math.inf and got["float_ssim"] == pytest.approx(ssim2d(y0, c1)[0].mean(), abs=1e-9)


@pytest.mark.parametrize(("dtype", "bits", "peak"), [("u8", None, 255), ("u16", 10, 1023), ("u16", None, 65535), ("f32", None, 1), ("f64", None, 1)])
def test_sample_types_and_ranges(spark, dtype, bits, peak):
    (x,), (y,) = noisy(40, 40, 2)
    x, y = (v / 255 * peak if dtype[0] == "f" else np.round(v / 255 * peak) for v in (x, y))
    x, y = (v.astype(CODES[dtype]).astype(float) for v in (x, y))
    got = one(score_frames(table(spark, [[x]], dtype=dtype, bits=bits), table(spark, [[y]], dtype=dtype, bits=bits), ["psnr", "ssim"], color_family="GRAY"))
    assert got["psnr"] == pytest.approx(10 * math.log10(peak**2 / ((x - y) ** 2).mean()))
    assert got["float_ssim"] == pytest.approx(ssim2d(x, y, peak=float(peak))[0].mean(), abs=1e-8)


def test_bfloat16():
    x = np.array([[1.0, -2.5], [0.15625, 3.0]], np.float32)
    assert (pixels.decode((x.view(np.uint32) >> 16).astype("<u2").tobytes(), "bf16", 1, 2, 2)[0] == x).all()


def test_windows_and_maps(spark):
    (x,), (y,) = noisy(40, 44, 3)
    r, d = table(spark, [[x]]), table(spark, [[y]])
    for size in (3, 5, 7, 9):
        assert one(score_frames(r, d, "ssim", win_size=size, color_family="GRAY"))["float_ssim"] == pytest.approx(ssim2d(x, y, size)[0].mean(), abs=1e-9)
    m = Metric("ssim").map(r, d).collect()[0]
    assert (m.height, m.width) == (30, 34) and np.allclose(np.array(m.data).reshape(30, 34), ssim2d(x, y)[0], atol=1e-9)
    g = Metric("gmsd", {"crop_border": 2}).map(r, d).collect()[0]
    assert np.allclose(np.array(g.data).reshape(g.height, g.width), gms2d(half2d(x[2:-2, 2:-2]), half2d(y[2:-2, 2:-2])), atol=1e-9)


def test_downsampled_ssim(spark):
    (x,), (y,) = noisy(700, 640, 4)
    f = 2  # round(640 / 256 = 2.5), half to even
    wide = [np.pad(v, 1, mode="edge") for v in (x, y)]
    small = [correlate(v, np.full((f, f), 0.25))[::f, ::f] for v in wide]
    got = one(score_frames(table(spark, [[x]]), table(spark, [[y]]), "ssim", downsample=True, color_family="GRAY"))
    assert got["float_ssim"] == pytest.approx(ssim2d(*small)[0].mean(), abs=1e-9)


def slow_ssimulacra2(a, b):
    """The metric with five blurs and the textbook forms, pixel by pixel loops over taps."""
    taps = pixels.cosine_taps()

    def blur(p):
        out = np.zeros_like(p)
        wide = np.pad(p, 5)
        for i in range(11):
            for j in range(11):
                out += taps[i] * taps[j] * wide[i : i + p.shape[0], j : j + p.shape[1]]
        return out

    def lin(v):
        return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)

    def xyb(p):
        m = [np.cbrt(sum(k * c for k, c in zip(row, p, strict=True)) + 0.0037930732552754493) - np.cbrt(0.0037930732552754493) for row in pixels._OPSIN]
        y = (m[0] + m[1]) / 2
        return [(m[0] - m[1]) / 2 * 14 + 0.42, y + 0.01, m[2] - y + 0.55]

    def down(p):
        p = np.pad(p, ((0, p.shape[0] % 2), (0, p.shape[1] % 2)), mode="edge")
        return p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).mean(axis=(1, 3))

    a, b = [lin(p / 255) for p in a], [lin(p / 255) for p in b]
    norms, size = [], a[0].shape
    for s in range(6):
        if min(size) < 8:
            break
        if s:
            a, b = [down(p) for p in a], [down(p) for p in b]
        size = a[0].shape
        row = []
        for x, y in zip(xyb(a), xyb(b), strict=True):
            mx, my = blur(x), blur(y)
            sxx, syy, sxy = blur(x * x) - mx * mx, blur(y * y) - my * my, blur(x * y) - mx * my
            d = np.maximum(1 - (1 - (mx - my) ** 2) * (2 * sxy + 0.0009) / (sxx + syy + 0.0009), 0)
            e = (1 + abs(y - my)) / (1 + abs(x - mx)) - 1
            row.append([[f(m) for m in (d, np.maximum(e, 0), np.maximum(-e, 0))] for f in (np.mean, lambda m: np.mean(m**4) ** 0.25)])
        norms.append(row)
    flat = [abs(v) for c in range(3) for s in norms for n in s[c] for v in n]
    t = sum(w * v for w, v in zip(pixels.WEIGHTS, flat, strict=False)) * 0.9562382616834844
    t = 2.326765642916932 * t - 0.020884521182843837 * t * t + 6.248496625763138e-05 * t**3
    return 100 - 10 * t**0.6276336467831387 if t > 0 else 100.0


@pytest.mark.parametrize(("h", "w", "band"), [(64, 64, 512), (81, 97, 512), (81, 97, 16), (8, 9, 512), (300, 20, 32)])
def test_ssimulacra2(spark, monkeypatch, h, w, band):
    monkeypatch.setattr(scoring, "BAND", band)
    x, y = noisy(h, w, 0x5217, planes=3)
    r, d = table(spark, [x], "RGB"), table(spark, [y], "RGB")
    got = one(score_frames(r, d, "ssimulacra2", color_family="RGB"))["ssimulacra2"]
    assert got == pytest.approx(slow_ssimulacra2(x, y), abs=1e-8)
    assert one(score_frames(r, r, 12, color_family="RGB"))["ssimulacra2"] == 100
    assert one(score_frames(d, r, 12, color_family="RGB"))["ssimulacra2"] != pytest.approx(got, abs=1e-6)


def random_net(path):
    rng = np.random.default_rng(0)
    channels, last, parts = (6, 8, 8), 3, {}
    for i, c in enumerate(channels):
        k = (11, 5, 3)[i]
        parts |= {f"weight{i}": rng.normal(0, 0.1, (c, last, k, k)), f"bias{i}": rng.normal(0, 0.1, c), f"lin{i}": rng.random((1, c, 1, 1))}
        last = c
    np.savez(path, format_version=1, stride=[4, 1, 1], padding=[2, 2, 1], pool_before=[False, True, True], **parts)
    return scoring.load_weights(path)


def test_lpips_with_random_weights(spark, tmp_path):
    net = random_net(str(tmp_path / "net.npz"))
    x, y = noisy(64, 64, 5, planes=3)
    r, d = table(spark, [x], "RGB"), table(spark, [y], "RGB")
    options = {"lpips": {"net": net}}
    got = one(score_frames(r, d, "lpips", options=options, color_family="RGB"))["lpips"]

    def tap(p):
        h, out = (np.stack(p) / 127.5 - 1 - pixels._SHIFT) / pixels._SCALE, []
        for w, b, s, pad, pool in zip(net["weight"], net["bias"], net["stride"], net["padding"], net["pool"], strict=True):
            if pool:
                h = np.array([[[c[i : i + 3, j : j + 3].max() for j in range(0, c.shape[1] - 2, 2)] for i in range(0, c.shape[0] - 2, 2)] for c in h])
            h = np.pad(h, ((0, 0), (pad, pad), (pad, pad)))
            k = w.shape[-1]
            n, m = (h.shape[1] - k) // s + 1, (h.shape[2] - k) // s + 1
            h = np.maximum(np.array([[[(h[:, i * s : i * s + k, j * s : j * s + k] * f).sum() + c for j in range(m)] for i in range(n)] for f, c in zip(w, b, strict=True)]), 0)
            out.append(h / (np.sqrt((h * h).sum(axis=0)) + 1e-10))
        return out

    want = sum(((l[:, None, None] * (a - b) ** 2).sum(axis=0)).mean() for l, a, b in zip(net["lin"], tap(x), tap(y), strict=True))
    assert got == pytest.approx(want, abs=1e-10)
    assert one(score_frames(r, r, "lpips", options=options, color_family="RGB"))["lpips"] == 0
    with pytest.raises(FileNotFoundError):
        score_frames(r, d, "lpips", color_family="RGB")


def test_pairing_errors_and_drops(spark):
    x, y = noisy(40, 40, 1)
    r, short = table(spark, [x, x]), table(spark, [y])
    with pytest.raises(Exception, match="no distorted frame"):
        score_frames(r, short, "mse", color_family="GRAY").collect()
    assert score_frames(r, short, "mse", color_family="GRAY", on_mismatch="drop").count() == 1
    with pytest.raises(Exception, match="differs in format or size"):
        score_frames(table(spark, [noisy(40, 42, 1)[0]]), short, "mse", color_family="GRAY").collect()
    with pytest.raises(Exception, match="needs 11 pixels"):
        score_frames(table(spark, [[x[0][:10]]]), table(spark, [[y[0][:10]]]), "ssim", color_family="GRAY").collect()
    with pytest.raises(Exception, match="needs 176 pixels"):
        score_frames(table(spark, [noisy(175, 180, 1)[0]]), table(spark, [noisy(175, 180, 1)[1]]), "ms_ssim", color_family="GRAY").collect()
    with pytest.raises(Exception, match="needs 8 pixels"):
        score_frames(table(spark, [[x[0][:7]] * 3], "RGB"), table(spark, [[y[0][:7]] * 3], "RGB"), "ssimulacra2", color_family="RGB").collect()
    with pytest.raises(Exception, match="RGB frames"):
        score_frames(table(spark, [[x[0]] * 3], "YUV"), table(spark, [[y[0]] * 3], "YUV"), "ssimulacra2", color_family="YUV").collect()


@pytest.mark.parametrize(("feature", "kind"), [(None, ValueError), ("nope", ValueError), (1, ValueError), (4, ValueError), (99, ValueError), (True, TypeError), (1.5, TypeError), ([], ValueError), ([0, True], TypeError)])
def test_bad_features(feature, kind):
    with pytest.raises(kind):
        features.resolve(feature)


def test_feature_requests():
    assert [f.name for f in features.resolve(["PSNR", 0, "ms-ssim", np.int64(5), "psnr"])] == ["psnr", "ms_ssim", "gmsd"]
    assert len(features.available_features()) == 11
    for bad in ({"delta": 0}, {"luma": "x"}, {"crop_border": -1}, {"nope": 1}):
        with pytest.raises((ValueError, TypeError)):
            features.plan("huber", bad)
    with pytest.raises(TypeError):
        features.plan("mse", {"luma": 3})
    assert features.plan("ssim", {"win_size": 7}, {"ssim": {"win_size": 5}})[0].options["win_size"] == 5


def test_pooling_and_logs(spark, tmp_path):
    inf, nan = math.inf, math.nan
    rows = spark.createDataFrame([("c", 1, 2.0, inf, "t"), ("c", 0, 0.0, inf, "t"), ("c", 2, 1.0, inf, "t")], "clip_id string, frame_no long, a double, b double, note string")
    got = {r.prop: r for r in pooling.pooled(rows).collect()}
    assert got["a"].harmonic_mean == pytest.approx(3 / (1 + 1 / 3 + 1 / 2) - 1) and (got["a"].min, got["a"].max, got["a"].mean) == (0, 2, 1)
    assert got["b"].harmonic_mean == inf and got.keys() == {"a", "b"}
    low = pooling.pooled(spark.createDataFrame([("c", 0, -1.0), ("c", 1, 5.0)], "clip_id string, frame_no long, a double")).first()
    assert math.isnan(low.harmonic_mean) and low.min == -1
    scores = rows.drop("note")
    logs.write(scores, str(tmp_path / "log"), "csv")
    lines = [x for p in sorted((tmp_path / "log").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ["frameNum,a,b", "0,0.000000,inf", "1,2.000000,inf", "2,1.000000,inf"]
    text = lambda f: [r.line for r in logs.log(scores, f).orderBy("place").collect()]
    assert text("sub")[0] == "{0}{1}frame: 0|a: 0.000000|b: inf|"
    doc = json.loads("\n".join(text("json")))
    assert [f["frameNum"] for f in doc["frames"]] == [0, 1, 2] and doc["frames"][1]["metrics"] == {"a": 2.0, "b": "inf"} and doc["pooled_metrics"]["b"]["max"] == "inf"
    tree = xml.dom.minidom.parseString("\n".join(text("xml")).encode())
    assert [n.getAttribute("frameNum") for n in tree.getElementsByTagName("frame")] == ["0", "1", "2"] and len(tree.getElementsByTagName("metric")) == 2
    with pytest.raises(ValueError):
        logs.log(scores, "yaml")
    assert nan != nan


def test_losses_and_batch(spark):
    x, y = noisy(64, 64, 1)
    a, b = noisy(64, 64, 2, noise=30)
    r, d = table(spark, [x, a]), table(spark, [y, b])
    s = score_frames(r, d, ["psnr", "mse", "ssim", "gms", "l1"], color_family="GRAY")
    rows = s.orderBy("frame_no").collect()
    got = scoring.batch(s, 255.0).first()
    assert got.psnr == pytest.approx(10 * math.log10(255**2 / np.mean([r.mse for r in rows]))) and got.float_ssim == pytest.approx(np.mean([r.float_ssim for r in rows]))
    loss = scoring.losses(s).orderBy("frame_no").first()
    assert loss.loss_ssim == pytest.approx(1 - rows[0].float_ssim) and loss.loss_l1 == rows[0].l1 and loss.loss_gms == pytest.approx(1 - rows[0].gms)
    with pytest.raises(ValueError):
        Metric("psnr").loss(r, d)
    kept = scoring.append(d.withColumn("tag", F.lit("x")), s).first()
    assert kept.tag == "x" and kept.mse is not None


def test_plan_slices_bands_before_python(spark):
    r, d = frames.synthetic(spark, 1, 64)
    plan = score_frames(r, d, ["mse", "ssim"], color_family="GRAY")._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") >= 1 and "Generate explode" in plan


def test_shared_units(spark):
    plans = features.plan(["psnr", "mse", "l1"])
    assert len({u for p in plans for u in scoring._units(p)}) == 1
    for name in ("ms_ssim", "ssimulacra2"):  # all scales from one band
        assert len(scoring._units(features.plan(name)[0])) == 1
    shared = scoring._shared([scoring._units(p) for p in features.plan(["ssim", "ms_ssim"])])
    assert shared[0] == shared[1]
    assert pair is not None


def test_frames_of_raw_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    planes = [[rng.integers(0, 1024, s).astype("<u2") for s in ((6, 8), (3, 4), (3, 4))] for _ in range(5)]

    def padded(p, pitch):
        return np.pad(p, ((0, 0), (0, pitch - p.shape[1]))).tobytes()

    (tmp_path / "clip").mkdir()
    for name, part in (("a.yuv", planes[:3]), ("b.yuv", planes[3:]), ("c.yuv", [])):
        (tmp_path / "clip" / name).write_bytes(b"".join(padded(p, 10 if p.shape[1] == 8 else 5) for f in part for p in f))
    got = frames.raw_files(spark, str(tmp_path / "clip"), 6, 8, "YUV", "u16", 10, (1, 1), stride=10).orderBy("frame_no").collect()
    assert [(r.clip_id, r.frame_no, r.bits) for r in got] == [("clip", i, 10) for i in range(5)]
    assert [[bytes(p.data) for p in r.planes] for r in got] == [[p.tobytes() for p in f] for f in planes]
    y4m = tmp_path / "d.y4m"
    y4m.write_bytes(b"YUV4MPEG2 W8 H6 F25:1 C420p10\n" + b"".join(b"FRAME\n" + b"".join(p.tobytes() for p in f) for f in planes))
    read = frames.y4m_file(spark, str(y4m)).orderBy("frame_no").collect()
    assert [[bytes(p.data) for p in r.planes] for r in read] == [[p.tobytes() for p in f] for f in planes] and read[0].dtype == "u16" and read[0].color_family == "YUV"
    y4m.write_bytes(b"YUV4MPEG2 W3 H3 Cmono\nFRAME\n" + bytes(9))
    assert [(r.color_family, r.bits, len(r.planes), bytes(r.planes[0].data)) for r in frames.y4m_file(spark, str(y4m)).collect()] == [("GRAY", 8, 1, bytes(9))]
    y4m.write_bytes(b"RIFF")
    with pytest.raises(ValueError):
        frames.y4m_file(spark, str(y4m))


def test_wrappers_reduction_and_log(spark, tmp_path):
    from framescope import metrics

    x, y = noisy(64, 64, 1)
    a, b = noisy(64, 64, 2, noise=30)
    r, d = table(spark, [x, a]), table(spark, [y, b])
    each = metrics.ssim(r, d, color_family="GRAY", win_size=7).orderBy("frame_no").collect()
    assert [e.float_ssim for e in each] == pytest.approx([ssim2d(p[0], q[0], 7)[0].mean() for p, q in ((x, y), (a, b))], abs=1e-9)
    mean = score_frames(r, d, ["psnr", "l1"], color_family="GRAY", reduction="mean", log_path=str(tmp_path / "log"), log_format="xml").first()
    assert mean.psnr == pytest.approx(10 * math.log10(255**2 / np.mean([((p[0] - q[0]) ** 2).mean() for p, q in ((x, y), (a, b))])))
    lines = [s for p in sorted((tmp_path / "log").glob("part-*")) for s in p.read_text().splitlines()]
    assert len(xml.dom.minidom.parseString("\n".join(lines).encode()).getElementsByTagName("frame")) == 2
    assert score_frames(r, r, "psnr", color_family="GRAY", reduction="mean").first().psnr == math.inf
    for bad in ({"reduction": "sum"}, {"log_format": "yaml"}):
        with pytest.raises(ValueError):
            score_frames(r, d, "psnr", **bad)
    assert metrics.engine_status()["engine"] == "spark"


def test_registered_metric(spark, monkeypatch):
    for name in ("_BY_NAME", "_BY_ID"):
        monkeypatch.setattr(features, name, dict(getattr(features, name)))
    f = features.register_metric("peak_gap", lambda x, y, peak: abs(x - y).max() / peak)
    assert features.available_features()["peak_gap"] == f.id > 12
    x, y = noisy(40, 600, 1)
    assert one(score_frames(table(spark, [x]), table(spark, [y]), ["mse", "peak_gap"], color_family="GRAY"))["peak_gap"] == abs(x[0] - y[0]).max() / 255
    for bad in (("mse", max), ("other", max, "plane")):
        with pytest.raises(ValueError):
            features.register_metric(*bad)


def test_lpips_map(spark):
    x, y = noisy(64, 72, 5, planes=3)
    r, d, options = table(spark, [x], "RGB"), table(spark, [y], "RGB"), {"lpips": {"net": scoring.random_net()}}
    m = scoring.similarity_map(pair(r, d), "lpips", options).first()
    assert (m.height, m.width) == (64, 72)
    want = np.zeros((64, 72))
    for layer in pixels.lpips_maps(np.stack(x), np.stack(y), 255.0, options["lpips"]["net"]):
        for i in range(64):
            for j in range(72):
                u, v = (min(max((k + 0.5) * n / size - 0.5, 0), n - 1) for k, n, size in ((i, layer.shape[0], 64), (j, layer.shape[1], 72)))
                a, b = int(u), int(v)
                c, e = min(a + 1, layer.shape[0] - 1), min(b + 1, layer.shape[1] - 1)
                want[i, j] += (layer[a, b] * (1 - v + b) + layer[a, e] * (v - b)) * (1 - u + a) + (layer[c, b] * (1 - v + b) + layer[c, e] * (v - b)) * (u - a)
    assert np.allclose(np.array(m.data).reshape(64, 72), want, atol=1e-12)
    with pytest.raises(ValueError):
        scoring.similarity_map(pair(r, d), "mse")


def test_whole_samples_sum_as_float_ones_do():
    rng = np.random.default_rng(3)
    for dtype, top in (("u1", 256), ("<u2", 65536)):
        x, y = (rng.integers(0, top, (1, 30, 40)).astype(dtype) for _ in range(2))
        a = pixels.pixel_sums(x, y, 1e-3, 1.0)
        assert a == pytest.approx(pixels.pixel_sums(x.astype(float), y.astype(float), 1e-3, 1.0), rel=1e-14)
        assert pixels.pixel_sums(x, y, 1e-3, 1.0, ("l1",)) == [0.0, a[1], 0.0, 0.0]
        assert np.array_equal(pixels.linear(x, top - 1.0), pixels.linear(x.astype(float), top - 1.0))


def test_stored_frames_are_paired_without_a_shuffle(spark):
    x, y = noisy(40, 40, 1)
    for name, images in (("kept_ref", [x, y]), ("kept_dist", [y, x])):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        frames.store(table(spark, images), name, 3)
    pairs = pair(spark.table("kept_ref"), spark.table("kept_dist"))
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert score_frames(spark.table("kept_ref"), spark.table("kept_dist"), "mse", color_family="GRAY").count() == 2


def test_logs_of_several_clips_are_one_file_each(spark, tmp_path):
    rows = [(c, i, float(i) + k, None if i == 1 else 0.25) for k, c in enumerate(("a", "b", "c/d")) for i in range(4)]
    scores = spark.createDataFrame(rows, "clip_id string, frame_no long, psnr double, ssim double").repartition(3)
    for f in logs.FORMATS:
        logs.write_clips(scores, str(tmp_path / f), f)
        assert sorted(p.name for p in (tmp_path / f).iterdir()) == [f"a.{f}", f"b.{f}", f"c%2Fd.{f}"]
        for c in ("a", "b", "c/d"):
            logs.write(scores.where(F.col("clip_id") == c), str(tmp_path / f"one_{f}_{c[0]}"), f)
            one = "".join(p.read_text() for p in sorted((tmp_path / f"one_{f}_{c[0]}").glob("part-*")))
            assert (tmp_path / f / f"{c.replace('/', '%2F')}.{f}").read_text() == one
    assert json.loads((tmp_path / "json" / "b.json").read_text())["frames"][3]["metrics"]["psnr"] == 4.0
    assert not scores.storageLevel.useMemory
    with pytest.raises(Exception, match="no log"):
        logs.write_clips(scores.withColumn("clip_id", F.lit(None).cast("string")), str(tmp_path / "none"), "csv")


def test_pools_of_no_values_are_nan(spark):
    scores = spark.createDataFrame([("a", 0, None, 1.0), ("b", 0, 2.0, None), ("b", 1, None, 3.0)], "clip_id string, frame_no long, p double, q double")
    got = {(r.clip_id, r.prop): r for r in pooling.pooled(scores).collect()}
    assert math.isnan(got["a", "p"].mean) and math.isnan(got["a", "p"].harmonic_mean) and math.isnan(got["a", "p"].min)
    assert got["b", "p"].mean == 2.0 and math.isclose(got["b", "p"].harmonic_mean, 2.0) and got["b", "q"].max == 3.0 and len(got) == 4


def test_mixed_families_in_one_job(spark):
    """A clip of each family in one table: every frame has its own family's columns, equal to those of a job of its own."""
    made = {f: noisy(40, 44, i, planes=1 if f == "GRAY" else 3) for i, f in enumerate(("GRAY", "YUV", "RGB"))}
    side = lambda k: [table(spark, [made[f][k]], f).withColumn("clip_id", F.lit(f)) for f in made]
    whole = [a.unionByName(b).unionByName(c) for a, b, c in (side(0), side(1))]
    features, options = ["psnr", "l1", "ssim", "gmsd", "ms_ssim"], {"ms_ssim": {"weights": (0.5, 0.5)}}
    got = {r.clip_id: r.asDict() for r in score_frames(*whole, features, color_family="any", options=options).collect()}
    for r, d, f in zip(side(0), side(1), made):
        alone = one(score_frames(r, d, features, color_family=f, options=options))
        own = {k: v for k, v in got[f].items() if v is not None}
        assert own.keys() == alone.keys() and not {k: (own[k], v) for k, v in alone.items() if own[k] != v and abs(own[k] - v) > 1e-9}
    assert {"psnr", "psnr_cb", "psnr_g", "float_ssim"} <= set(got["RGB"])
    with pytest.raises(Exception, match="where GRAY of 1 is asked for"):
        score_frames(*whole, "psnr", color_family="GRAY").collect()
    with pytest.raises(Exception, match="of 3 planes where GRAY of 1"):
        three = table(spark, [made["RGB"][0]], "GRAY")
        score_frames(three, three, "psnr", color_family="any").collect()
    with pytest.raises(Exception, match="CMYK of 1 planes"):
        other = table(spark, [made["GRAY"][0]], "CMYK")
        score_frames(other, other, "psnr", color_family="any").collect()


def test_maps_come_in_stripes(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BAND", 16)
    (x,), (y,) = noisy(60, 44, 3)
    r, d = table(spark, [[x]]), table(spark, [[y]])

    def whole(rows, h, w):
        out = np.full((h, w), np.nan)
        for m in rows:
            out[m.top : m.top + m.height] = np.array(m.data).reshape(m.height, m.width)
        return out

    rows = Metric("ssim").map(r, d).collect()
    assert len(rows) == 4 and np.allclose(whole(rows, 50, 34), ssim2d(x, y)[0], atol=1e-9)
    rows = Metric("gms", {"crop_border": 2}).map(r, d).collect()
    want = gms2d(half2d(x[2:-2, 2:-2]), half2d(y[2:-2, 2:-2]))
    assert len(rows) > 1 and np.allclose(whole(rows, *want.shape), want, atol=1e-9)


def test_mismatches_are_found_without_samples(spark, tmp_path):
    x, y = noisy(20, 20, 1)
    table(spark, [x, x, x, x]).write.parquet(str(tmp_path / "r"))
    bad = table(spark, [y]).unionByName(table(spark, [noisy(20, 22, 1)[0]], first=1)).unionByName(table(spark, [y], first=2)).unionByName(table(spark, [y, y], first=2)).unionByName(table(spark, [y], first=9))
    bad.where("frame_no <> 4").write.parquet(str(tmp_path / "d"))
    r, d = (frames.read(spark, str(tmp_path / k)) for k in "rd")
    from framescope.operators.pairing import check, mismatches

    found = mismatches(r, d)
    got = {x.frame_no: x.fault for x in found.collect()}
    assert got == {1: "differs in format or size", 2: "stands more than once", 9: "has no reference frame"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "height" in plan and "data:binary" not in plan
    with pytest.raises(ValueError, match="3 frames do not pair: clip c frame 1 differs"):
        score_frames(r, d, "psnr", on_mismatch="check", color_family="GRAY")
    assert score_frames(r.where("frame_no = 0"), d.where("frame_no = 0"), "psnr", on_mismatch="check", color_family="GRAY").count() == 1
    check(r, r)


def test_staging_casts_and_reshapes(spark):
    (x,), (y,) = noisy(6, 8, 1)
    df = table(spark, [[x]], dtype="u16", bits=10).withColumn("ts", F.lit("kept"))
    got = frames.staged(df, 4, 12, "f32").first()
    assert (got.dtype, got.bits, got.ts, got.planes[0].height, got.planes[0].width) == ("f32", None, "kept", 4, 12)
    assert np.array_equal(np.frombuffer(got.planes[0].data, "<f4"), x.ravel())
    same = frames.staged(df, 8, 6).first()
    assert (same.dtype, same.bits) == ("u16", 10) and bytes(same.planes[0].data) == x.astype("<u2").tobytes()
    half = frames.staged(table(spark, [[x + 0.5]], dtype="f64"), 6, 8, "u8", 8).first()
    assert np.array_equal(np.frombuffer(half.planes[0].data, "u1"), x.ravel()) and half.bits == 8
    back = pixels.samples(frames.staged(df, 6, 8, "bf16").first().planes[0].data, "bf16", 1, 6, 8)
    assert abs(back[0] - x).max() <= 1
    with pytest.raises(Exception, match="has no shape 5 x 5"):
        frames.staged(df, 5, 5).collect()


def test_nets_are_found_by_name(spark, tmp_path, monkeypatch):
    from framescope.sources import weights

    random_net(tmp_path / "lpips_alex.npz")
    monkeypatch.delenv(weights.ONE, raising=False)
    monkeypatch.setenv(weights.FOLDER, str(tmp_path))
    assert weights.available_nets() == ["alex"]
    x, y = noisy(64, 64, 2, planes=3)
    r, d = table(spark, [x], "RGB"), table(spark, [y], "RGB")
    by_name = one(score_frames(r, d, "lpips", options={"lpips": {"net": "alex"}}))["lpips"]
    assert by_name == one(score_frames(r, d, "lpips", options={"lpips": {"net": weights.load(tmp_path / "lpips_alex.npz")}}))["lpips"]
    with pytest.raises(FileNotFoundError, match="no weights of 'vgg'"):
        score_frames(r, d, "lpips", options={"lpips": {"net": "vgg"}})
    monkeypatch.setenv(weights.ONE, str(tmp_path / "none.npz"))
    with pytest.raises(FileNotFoundError, match="is no file"):
        weights.path("alex")
    np.savez(tmp_path / "old.npz", format_version=2, stride=[1])
    with pytest.raises(ValueError, match="format_version 2"):
        weights.load(tmp_path / "old.npz")
    np.savez(tmp_path / "short.npz", format_version=1, stride=[1])
    with pytest.raises(ValueError, match="lacks"):
        weights.load(tmp_path / "short.npz")
