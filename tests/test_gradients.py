"""Gradients against finite differences of an independent forward pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_frames import noisy, table

from framescope.functions.pixels import gaussian
from framescope.operators import gradients as g
from framescope.operators import scoring
from framescope.operators.pairing import pair


def maps(x, y, peak, size=11):
    """SSIM and contrast maps, window by window."""
    w = np.outer(gaussian(size, 1.5), gaussian(size, 1.5))
    view = lambda v: np.lib.stride_tricks.sliding_window_view(v, (size, size))
    mean = lambda v: (view(v) * w).sum(axis=(2, 3))
    mx, my = mean(x), mean(y)
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    cs = (2 * (mean(x * y) - mx * my) + c2) / (mean(x * x) - mx * mx + mean(y * y) - my * my + c2)
    return (2 * mx * my + c1) / (mx * mx + my * my + c1) * cs, cs


def half(v):
    h, w = v.shape[0] // 2 * 2, v.shape[1] // 2 * 2
    return v[:h, :w].reshape(h // 2, 2, w // 2, 2).mean(axis=(1, 3))


def slow_ms(x, y, peak, weights, size):
    out = 1.0
    for j, w in enumerate(weights):
        full, cs = maps(x, y, peak, size)
        out *= max(float((full if j == len(weights) - 1 else cs).mean()), 0.0) ** w
        x, y = half(x), half(y)
    return out


def whole(rows, h, w):
    """Stripes put together: (c) -> dx, dy."""
    out = {}
    for r in rows:
        dx, dy = out.setdefault(r.c, (np.zeros((h, w)), np.zeros((h, w))))
        for v, flat in ((dx, r.dx), (dy, r.dy)):
            v[r.top : r.top + r.height, r.left : r.left + r.width] = np.array(flat).reshape(r.height, r.width)
    return out


def differences(f, v, spots, step=1e-3):
    out = []
    for s in spots:
        up, down = v.copy(), v.copy()
        up[s] += step
        down[s] -= step
        out.append((f(up) - f(down)) / (2 * step))
    return np.array(out)


SPOTS = [(0, 0), (0, 7), (5, 3), (17, 29), (31, 16), (-1, -1), (-2, 4), (20, -1), (16, 15), (15, 16)]


@pytest.mark.parametrize("band", [512, 8])
@pytest.mark.parametrize("h, w", [(40, 33), (35, 48)])
def test_ssim_gradient(spark, monkeypatch, band, h, w):
    monkeypatch.setattr(scoring, "BAND", band)
    (x,), (y,) = noisy(h, w, 3)
    rows = g.gradients(pair(table(spark, [[x]], dtype="f64"), table(spark, [[y]], dtype="f64")), "ssim", data_range=255.0).collect()
    assert len(rows) == (1 if band == 512 else -(-h // 8))
    dx, dy = whole(rows, h, w)[0]
    score = lambda a, b: maps(a, b, 255.0)[0].mean()
    assert np.allclose([dx[s] for s in SPOTS], differences(lambda v: score(v, y), x, SPOTS), rtol=1e-6, atol=1e-12)
    assert np.allclose([dy[s] for s in SPOTS], differences(lambda v: score(x, v), y, SPOTS), rtol=1e-6, atol=1e-12)


def test_ssim_gradient_of_a_map(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BAND", 16)
    h, w = 50, 31
    (x,), (y,) = noisy(h, w, 4)
    up = np.random.default_rng(0).normal(size=(h - 6, w - 6))
    given = spark.createDataFrame([("c", 0, 0, w - 6, up.ravel().tolist())], "clip_id string, frame_no long, c int, width int, data array<double>")
    pairs = pair(table(spark, [[x]], dtype="f64"), table(spark, [[y]], dtype="f64"))
    dx, dy = whole(g.gradients(pairs, "ssim", given, win_size=7, data_range=255.0).collect(), h, w)[0]
    stripes = spark.createDataFrame([("c", 0, 0, t, w - 6, up[t : t + 20].ravel().tolist()) for t in (40, 0, 20)], "clip_id string, frame_no long, c int, top int, width int, data array<double>")
    again = whole(g.gradients(pairs, "ssim", stripes, win_size=7, data_range=255.0).collect(), h, w)[0]
    assert np.array_equal(again[0], dx) and np.array_equal(again[1], dy)
    loss = lambda a, b: (maps(a, b, 255.0, 7)[0] * up).sum()
    assert np.allclose([dx[s] for s in SPOTS], differences(lambda v: loss(v, y), x, SPOTS), rtol=1e-5, atol=1e-9)
    assert np.allclose([dy[s] for s in SPOTS], differences(lambda v: loss(x, v), y, SPOTS), rtol=1e-5, atol=1e-9)


@pytest.mark.parametrize("band", [512, 8])
@pytest.mark.parametrize("h, w", [(48, 40), (51, 45)])
def test_ms_ssim_gradient(spark, monkeypatch, band, h, w):
    monkeypatch.setattr(scoring, "BAND", band)
    weights = (0.3, 0.3, 0.4)
    (x,), (y,) = noisy(h, w, 5)
    pairs = pair(table(spark, [[x]], dtype="f64"), table(spark, [[y]], dtype="f64"))
    dx, dy = whole(g.gradients(pairs, "ms_ssim", 2.0, weights=weights, win_size=7, data_range=255.0).collect(), h, w)[0]
    loss = lambda a, b: 2 * slow_ms(a, b, 255.0, weights, 7)
    spots = [*SPOTS, (h - 1, 0), (h - 3, w - 3), (47, 39)]
    assert np.allclose([dx[s] for s in spots], differences(lambda v: loss(v, y), x, spots), rtol=1e-5, atol=1e-10)
    assert np.allclose([dy[s] for s in spots], differences(lambda v: loss(x, v), y, spots), rtol=1e-5, atol=1e-10)
    got = scoring.score(pairs, "ms_ssim", weights=weights, win_size=7, data_range=255.0).first().float_ms_ssim
    assert abs(got - slow_ms(x, y, 255.0, weights, 7)) < 1e-12


def test_clamped_scales_have_no_gradient(spark):
    (x,), _ = noisy(40, 40, 6)
    pairs = pair(table(spark, [[x]]), table(spark, [[255 - x]]))  # inverted: contrast below 0
    rows = g.gradients(pairs, "ms_ssim", weights=(0.5, 0.5)).collect()
    assert scoring.score(pairs, "ms_ssim", weights=(0.5, 0.5)).first().float_ms_ssim == 0
    assert all(v == 0 for r in rows for v in (*r.dx, *r.dy))


def test_gradients_of_planes_luma_and_crop(spark):
    a, b = noisy(36, 36, 7, planes=3)
    pairs = pair(table(spark, [a], "RGB", "f64"), table(spark, [b], "RGB", "f64"))
    each = whole(g.gradients(pairs, "ssim", data_range=255.0).collect(), 36, 36)
    score = lambda planes: np.mean([maps(p, q, 255.0)[0].mean() for p, q in zip(planes, b)])
    for c in range(3):
        f = lambda v: score([v if k == c else p for k, p in enumerate(a)])  # noqa: E731, B023
        assert np.allclose([each[c][0][s] for s in SPOTS], differences(f, a[c], SPOTS), rtol=1e-5, atol=1e-12)
    gray = whole(g.gradients(pairs, "ssim", data_range=255.0, luma="bt709", crop_border=4).collect(), 36, 36)
    light = lambda p: 0.2126 * p[0] + 0.7152 * p[1] + 0.0722 * p[2]
    for c in range(3):
        f = lambda v: maps(light([v if k == c else p for k, p in enumerate(a)])[4:-4, 4:-4], light(b)[4:-4, 4:-4], 255.0)[0].mean()  # noqa: E731, B023
        assert np.allclose([gray[c][0][s] for s in SPOTS], differences(f, a[c], SPOTS), rtol=1e-5, atol=1e-12)
        assert not gray[c][0][:4].any() and gray[c][0][4:-4, 4:-4].any()


def test_gradient_errors(spark):
    (x,), (y,) = noisy(20, 20, 8)
    pairs = pair(table(spark, [[x]]), table(spark, [[y]]))
    with pytest.raises(ValueError, match="no gradient"):
        g.gradients(pairs, "psnr")
    with pytest.raises(Exception, match="pixels a side"):
        g.gradients(pairs, "ms_ssim").collect()
    with pytest.raises(ValueError, match="upstream is a number"):
        g.gradients(pairs, "ms_ssim", pairs)
    assert g.gradients(pairs.where("false"), "ssim").count() == 0 and F
