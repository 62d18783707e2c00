"""The splittable clip source and its writer."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framescope.sources import frames, video


def planar(rng, n, shapes, kind=np.uint8, top=256):
    return [[rng.integers(0, top, s).astype(kind) for s in shapes] for _ in range(n)]


def rows(df):
    return {(r.clip_id, r.frame_no): [(p.height, p.width, bytes(p.data)) for p in r.planes] for r in df.collect()}


def test_raw_clips_of_several_files_with_padding(spark, tmp_path):
    rng = np.random.default_rng(0)
    images = planar(rng, 7, [(6, 8), (3, 4), (3, 4)], "<u2", 1024)
    for clip, parts in (("a", [images[:3], images[3:]]), ("b", [images[4:]])):
        (tmp_path / clip).mkdir()
        for k, part in enumerate(parts):
            pad = lambda p, w: np.pad(p, ((0, 0), (0, w - p.shape[1])))
            body = b"".join(b"hd" + b"".join(pad(p, 10 * p.shape[1] // 8).tobytes() for p in f) for f in part)
            (tmp_path / clip / f"{k}.raw").write_bytes(b"head" + body + b"rest")
    df = video.read(spark, str(tmp_path), height=6, width=8, color_family="YUV", dtype="u16", bits=10, subsampling=(1, 1), stride=10, header=4, frame_header=2, split_bytes=300)
    assert df.rdd.getNumPartitions() > 5
    got = rows(df)
    want = lambda f: [(*p.shape, p.tobytes()) for p in f]
    assert got == {("a", i): want(f) for i, f in enumerate(images)} | {("b", i): want(f) for i, f in enumerate(images[4:])}
    assert df.first().bits == 10 and df.schema == spark.createDataFrame([], frames.SCHEMA).schema
    old = frames.raw_files(spark, str(tmp_path / "a"), 6, 8, "YUV", "u16", 10, (1, 1), stride=10, header=4, frame_header=2)
    assert rows(old) == {k: v for k, v in got.items() if k[0] == "a"}


def test_conditions_read_only_their_own_bytes(spark, tmp_path):
    """Frames outside the condition are broken: reading one fails."""
    (tmp_path / "c").mkdir()
    frame = lambda i: b"FRAME\n" + bytes([i] * 12)
    good = {3, 4, 5, 11}
    (tmp_path / "c" / "x.y4m").write_bytes(b"YUV4MPEG2 W4 H3 F25:1 Cmono\n" + b"".join(frame(i) if i in good else b"WRONG\n" + bytes(12) for i in range(20)))
    df = video.read(spark, str(tmp_path), "y4m", split_bytes=60)
    assert {r.frame_no for r in df.where("frame_no >= 3 and frame_no < 6").collect()} == {3, 4, 5}
    assert {r.frame_no for r in df.where(F.col("frame_no").isin(4, 11)).collect()} == {4, 11}
    assert [bytes(r.planes[0].data) for r in df.where("frame_no = 11").collect()] == [bytes([11] * 12)]
    assert df.where("frame_no = 11").rdd.getNumPartitions() == 1
    assert df.where("clip_id = 'none'").count() == 0 and df.where("frame_no > 100").count() == 0
    with pytest.raises(Exception, match="has parameters or is no frame"):
        df.where("frame_no >= 3").count()


def test_a_file_over_two_gigabytes(spark, tmp_path):
    (tmp_path / "big").mkdir()
    path, side = tmp_path / "big" / "v.raw", 4096
    with open(path, "wb") as f:  # a sparse file: no disk is used for the gap
        f.truncate(140 * side * side)
        f.seek(139 * side * side)
        f.write(bytes([7]) * side)
    assert path.stat().st_size > 2 << 30
    df = video.read(spark, str(tmp_path), height=side, width=side)
    assert df.rdd.getNumPartitions() == 18
    last = df.where("frame_no in (0, 139)").select("frame_no", F.hex(F.col("planes")[0]["data"].substr(1, 2)).alias("h")).orderBy("frame_no").collect()
    assert [(r.frame_no, r.h) for r in last] == [(0, "0000"), (139, "0707")]


@pytest.mark.parametrize("family, dtype, bits, sizes", [("GRAY", "u8", 8, [(6, 8)]), ("YUV", "u16", 10, [(6, 8), (3, 4), (3, 4)]), ("YUV", "u8", 8, [(5, 7), (5, 4), (5, 4)])])
def test_written_clips_come_back(spark, tmp_path, family, dtype, bits, sizes):
    rng = np.random.default_rng(1)
    kind = "<u2" if dtype == "u16" else np.uint8
    data = [(c, i, family, bits, dtype, [(*p.shape, p.tobytes()) for p in f]) for c in ("a", "b") for i, f in enumerate(planar(rng, 9, sizes, kind, 1 << bits))]
    df = spark.createDataFrame(data, frames.SCHEMA).repartition(5)
    video.write(df, str(tmp_path / "y"), "y4m", files=4)
    back = video.read(spark, str(tmp_path / "y"), "y4m")
    assert rows(back) == rows(df) and {(r.color_family, r.bits, r.dtype) for r in back.collect()} == {(family, bits, dtype)}
    assert len(list((tmp_path / "y").rglob("*.y4m"))) > 2 and not list((tmp_path / "y").glob(".pending*"))
    video.write(df.where("clip_id = 'a' and frame_no < 2"), str(tmp_path / "y"), "y4m", mode="overwrite", files=1)
    assert {k for k in rows(video.read(spark, str(tmp_path / "y"), "y4m"))} == {("a", 0), ("a", 1)}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    mixed = spark.createDataFrame([("a", 0, "GRAY", 8, "u8", [(1, 2, b"ab")]), ("a", 1, "GRAY", 8, "u8", [(2, 2, b"abcd")])], frames.SCHEMA)
    with pytest.raises(Exception, match="differs in format or size"):
        video.write(mixed, str(tmp_path / "m"), files=1)
    assert [x for _, _, x in os.walk(tmp_path / "m") if x] == []
    rgb = spark.createDataFrame([("a", 0, "RGB", 8, "u8", [(1, 1, b"a")] * 3)], frames.SCHEMA)
    with pytest.raises(Exception, match="holds no RGB"):
        video.write(rgb, str(tmp_path / "m"), "y4m")


def test_bad_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "empty.y4m").write_bytes(b"")
    assert video.read(spark, str(tmp_path), "y4m").count() == 0
    (tmp_path / "a" / "short.y4m").write_bytes(b"YUV4MPEG2 W2 H1 Cmono\nFRAME\nab" + b"FRA")
    with pytest.raises(Exception, match="are no frame"):
        video.read(spark, str(tmp_path), "y4m").count()
    (tmp_path / "a" / "short.y4m").write_bytes(b"RIFF....")
    with pytest.raises(Exception, match="known chroma format"):
        video.read(spark, str(tmp_path), "y4m").count()
