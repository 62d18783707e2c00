"""impl='sql' against the banded kernels."""

import numpy as np
import pytest
from test_frames import noisy, table

from framescope.metrics import score_frames
from framescope.operators.pairing import pair
from framescope.operators import relational
from framescope.sources import frames

ALL = ["psnr", "mse", "l1", "charbonnier", "huber", "ssim", "gms", "gmsd", "ms_ssim"]


def both(r, d, feature, **options):
    rows = [{x.frame_no: x.asDict() for x in score_frames(r, d, feature, impl=i, **options).collect()} for i in ("arrow", "sql")]
    assert rows[0].keys() == rows[1].keys() and rows[0]
    for k, want in rows[0].items():
        assert list(want) == list(rows[1][k])
        for c, v in want.items():
            assert v == rows[1][k][c] or abs(v - rows[1][k][c]) < 1e-9, (k, c, v, rows[1][k][c])


def test_sql_scores_equal_arrow_scores_on_a_table(spark):
    r, d = frames.from_embeddings(spark, "/root/testdata/sf0.001")
    both(r.where("frame_no < 3"), d.where("frame_no < 3"), ALL, color_family="GRAY", options={"ms_ssim": {"weights": (0.4, 0.6)}})


@pytest.mark.parametrize("family, dtype, bits, planes", [("RGB", "u8", None, 3), ("GRAY", "u16", 10, 1), ("YUV", "u8", 8, 3)])
def test_sql_scores_of_planes_types_and_crops(spark, family, dtype, bits, planes):
    pairs = [noisy(37, 30, i, planes=planes) for i in range(2)]
    r, d = (table(spark, [p[k] for p in pairs], family, dtype, bits) for k in (0, 1))
    both(r, d, ["psnr", "l1", "ssim", "gmsd"], color_family=family, crop_border=3, options={"ssim": {"win_size": 7}})


def test_sql_refuses_what_it_cannot_do(spark):
    (x,), (y,) = noisy(40, 40, 1)
    r, d = table(spark, [[x]]), table(spark, [[y]])
    for feature, options in (("ssimulacra2", {}), ("lpips", {}), ("ssim", {"downsample": True}), ("psnr", {"luma": "bt709"})):
        with pytest.raises(NotImplementedError):
            score_frames(r, d, feature, impl="sql", **options)
    with pytest.raises(ValueError, match="impl is"):
        score_frames(r, d, "psnr", impl="gpu")
    with pytest.raises(Exception, match="u8 and u16"):
        score_frames(table(spark, [[x]], dtype="f32"), table(spark, [[y]], dtype="f32"), "psnr", impl="sql").collect()
    with pytest.raises(Exception, match="pixels a side"):
        score_frames(r, d, "ms_ssim", impl="sql").collect()
    with pytest.raises(Exception, match="not all RGB"):
        score_frames(r, d, "psnr", impl="sql", color_family="RGB").collect()
    assert score_frames(r.where("false"), d.where("false"), "ssim", impl="sql").count() == 0 and np.isfinite(1)


def test_sql_plan_has_no_python(spark):
    (x,), (y,) = noisy(40, 40, 1)
    df = relational.score(pair(table(spark, [[x]]), table(spark, [[y]])), ["ssim", "gmsd"])
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "") and "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()
