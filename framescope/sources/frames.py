"""Frame tables: their schema, and frames derived from other tables by SQL functions alone."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from framescope.functions.pixels import NUMPY, WIDTH, samples

SCHEMA = "clip_id string, frame_no long, color_family string, bits int, dtype string, planes array<struct<height:int,width:int,data:binary>>"


def read(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A stored frame table."""
    return spark.read.schema(SCHEMA).format(format).load(path)


def store(frames: DataFrame, table: str, buckets: int = 200) -> None:
    """Save a frame table in buckets of clip and frame: two of as many buckets are paired without a shuffle,
    each frame scored where it lies."""
    keys = ("clip_id", "frame_no")
    frames.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def shapes(height: int, width: int, color_family: str, subsampling: tuple[int, int] = (0, 0)) -> list[tuple[int, int]]:
    """(height, width) of each plane; subsampling: how often chroma is halved across and down."""
    if color_family == "GRAY":
        return [(height, width)]
    across, down = subsampling if color_family == "YUV" else (0, 0)
    return [(height, width)] + [(-(-height >> down) if down else height, -(-width >> across) if across else width)] * 2


def raw_files(
    spark: SparkSession, path: str, height: int, width: int, color_family: str = "GRAY", dtype: str = "u8", bits: int | None = None,
    subsampling: tuple[int, int] = (0, 0), stride: int | None = None, header: int = 0, frame_header: int = 0,
) -> DataFrame:
    """Planar raw frames, any number a file; files are ordered by name inside their folder, the clip. Rows
    are `stride` samples apart in the first plane and in proportion in the others (as wide as the plane
    if not given); header and frame_header bytes before the file's and each frame's samples are left out.

    Frames are numbered from paths and sizes alone; a frame's bytes stay where its file was read."""
    size = WIDTH[dtype]
    whole = shapes(height, width, color_family, subsampling)
    pitches = [w if stride is None else -(-stride * w // width) for _, w in whole]
    length = frame_header + sum(h * p for (h, _), p in zip(whole, pitches, strict=True)) * size
    content = F.col("content")

    def planes(nth: Column) -> Column:
        out, at = [], header + frame_header + 1
        for (h, w), pitch in zip(whole, pitches, strict=True):
            start = nth * length + at
            if pitch == w:
                data = content.substr(start.cast("int"), F.lit(h * w * size))
            else:
                data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda y: F.hex(content.substr((start + y * pitch * size).cast("int"), F.lit(w * size)))), ""))  # noqa: B023
            out.append(F.struct(F.lit(h).alias("height"), F.lit(w).alias("width"), data.alias("data")))
            at += h * pitch * size
        return F.array(*out)

    files = spark.read.format("binaryFile").load(path)
    clip, n = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1), F.expr(f"(length - {header}) div {length}").cast("int")
    before = F.sum(n).over(Window.partitionBy(clip).orderBy("path")) - n
    numbers = files.select("path", clip.alias("clip_id"), before.alias("before"))
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("nth"), planes(i).alias("planes")))
    # outer, as else the optimiser cuts the frames twice to see whether there are any
    each = files.where(n > 0).select("path", F.explode_outer(cut).alias("f"))
    return each.join(numbers, "path").select(
        "clip_id", (F.col("before") + F.col("f.nth")).cast("long").alias("frame_no"), F.lit(color_family).alias("color_family"), F.lit(bits).cast("int").alias("bits"), F.lit(dtype).alias("dtype"), "f.planes")


# Fixed values of the format: how often each chroma tag halves chroma across and down.
CHROMA = {"420": (1, 1), "420jpeg": (1, 1), "420mpeg2": (1, 1), "420paldv": (1, 1), "422": (1, 0), "444": (0, 0), "mono": None}


def y4m_file(spark: SparkSession, path: str) -> DataFrame:
    """The frames of one uncompressed YUV4MPEG2 file of 8 to 16 bits (tags such as C420p10); its frames carry
    no parameters of their own."""
    head = spark.read.format("binaryFile").load(path).select(F.decode(F.col("content").substr(1, 1024), "ISO-8859-1").alias("h")).first()["h"].split("\n")[0]
    values = {x[0]: x[1:] for x in head.split()[1:]}
    tag = re.fullmatch(rf"({'|'.join(sorted(CHROMA, reverse=True))})p?(\d*)", values.get("C", "420"))
    if not head.startswith("YUV4MPEG2") or tag is None:
        raise ValueError(f"{path} is no YUV4MPEG2 file of a known chroma format")
    halved, bits = CHROMA[tag[1]], int(tag[2] or 8)
    return raw_files(spark, path, int(values["H"]), int(values["W"]), "GRAY" if halved is None else "YUV", "u8" if bits == 8 else "u16", bits, halved or (0, 0), header=len(head) + 1, frame_header=6)


def _frames(rows: DataFrame, clip: str, height: int, width: int, value: str, bits: int = 8) -> DataFrame:
    """rows (f, y, vs: array of whole numbers) become one GRAY frame each f, where all rows are there."""
    pair = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    text = F.transform(value, pair if bits == 8 else lambda v: F.concat(pair(v % 256), pair(F.floor(v / 256))))
    lines = rows.select("f", "y", F.array_join(text, "").alias("line"))
    joined = lines.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("y", "line"))).alias("ls")).where(F.size("ls") == height)
    data = F.unhex(F.array_join(F.transform("ls", lambda x: x["line"]), ""))
    plane = F.struct(F.lit(height).alias("height"), F.lit(width).alias("width"), data.alias("data"))
    return joined.select(F.lit(clip).alias("clip_id"), F.col("f").cast("long").alias("frame_no"), F.lit("GRAY").alias("color_family"), F.lit(bits).alias("bits"), F.lit("u8" if bits == 8 else "u16").alias("dtype"), F.array(plane).alias("planes"))


def _clip(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), v))


def from_embeddings(spark: SparkSession, sf_dir: str, bits: int = 8) -> tuple[DataFrame, DataFrame]:
    """64 x 64 frames, one each 64 consecutive vectors: reference and distorted. A frame that lacks rows is
    left out: of a table of n vectors without gaps, the last n mod 64."""
    top, scale = (1 << bits) - 1, 1 << (bits - 8)
    clip = lambda v: F.greatest(F.lit(0), F.least(F.lit(top), v))
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = e.select(F.expr("vec_id div 64").alias("f"), (F.col("vec_id") % 64).alias("y"), F.transform("embedding", lambda v: clip(F.floor(scale * (128 + 400 * v.cast("double"))).cast("long"))).alias("r"))
    d = rows.withColumn("d", F.transform("r", lambda v, x: clip(v + scale * ((7 * x + 13 * F.col("y") + 5 * F.col("f")) % 17 - 8))))
    name = "emb64" if bits == 8 else f"emb64_{bits}"
    return _frames(d, name, 64, 64, "r", bits), _frames(d, name, 64, 64, "d", bits)


def mosaics(spark: SparkSession, sf_dir: str, side: int) -> tuple[DataFrame, DataFrame]:
    """side x side frames, a row a vector, side consecutive vectors each: the vector's entries over and over, every
    second time with their signs turned, each time a little brighter. Vectors that fill no frame are left out."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    entry = F.col("embedding")
    nth = lambda x: F.floor(x / 64)

    def pixel(x: Column) -> Column:
        v = F.get(entry, (x % 64).cast("int")).cast("double")
        return _clip(F.floor(128 + 400 * F.when(nth(x) % 2 == 0, v).otherwise(-v) + 9 * nth(x)).cast("long"))

    rows = e.select(F.expr(f"vec_id div {side}").alias("f"), (F.col("vec_id") % side).alias("y"), F.transform(F.sequence(F.lit(0), F.lit(side - 1)), pixel).alias("r"))
    d = rows.withColumn("d", F.transform("r", lambda v, x: _clip(v + (7 * x + 13 * F.col("y") + 5 * F.col("f")) % 17 - 8)))
    return _frames(d, f"emb{side}", side, side, "r"), _frames(d, f"emb{side}", side, side, "d")


def as_float(frames: DataFrame, clip: str) -> DataFrame:
    """8-bit frames as float32 ones, samples over 256."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = [[p | {"data": (np.frombuffer(p["data"], np.uint8) / np.float32(256)).astype("<f4").tobytes()} for p in ps] for ps in batch.column("planes").to_pylist()]
            i = batch.schema.get_field_index("planes")
            yield batch.set_column(i, batch.schema.field(i), pa.array(planes, batch.schema.field(i).type))

    out = frames.select(F.lit(clip).alias("clip_id"), "frame_no", "color_family", F.lit(None).cast("int").alias("bits"), F.lit("f32").alias("dtype"), "planes")
    return out.mapInArrow(run, out.schema)


def staged(frames: DataFrame, height: int, width: int, dtype: str | None = None, bits: int | None = None) -> DataFrame:
    """Frames, of a table or of a stream, in one shape and sample type: planes of as many samples are reshaped to
    height x width row by row, others fail the job; samples are cast (towards zero, modulo the type's range, where
    it is narrower). bits is given to all frames; without it they keep theirs if their samples' type stays."""
    def cast(data: bytes, old: str) -> bytes:
        values = samples(data, old, 1, 1, -1)[0, 0]
        if dtype == "bf16":
            return (values.astype("<f4").view("<u4") >> 16).astype("<u2").tobytes()
        return values.astype(NUMPY[dtype]).tobytes() if dtype else data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes, types = [], batch.column("dtype").to_pylist()
            for old, ps in zip(types, batch.column("planes").to_pylist(), strict=True):
                for p in ps or ():
                    if p["height"] * p["width"] != height * width:
                        raise ValueError(f"a plane of {p['height']} x {p['width']} samples has no shape {height} x {width}")
                planes.append(None if ps is None else [{"height": height, "width": width, "data": p["data"] if dtype in (None, old) else cast(p["data"], old)} for p in ps])
            i = batch.schema.get_field_index("planes")
            yield batch.set_column(i, batch.schema.field(i), pa.array(planes, batch.schema.field(i).type))

    done = frames.mapInArrow(run, frames.schema)
    kept = F.lit(bits).cast("int") if bits is not None else F.when(F.col("dtype") == (dtype or F.col("dtype")), F.col("bits"))
    done = done.withColumn("bits", kept)
    return done if dtype is None else done.withColumn("dtype", F.lit(dtype))


def yuv420(frames: DataFrame, clip: str) -> DataFrame:
    """Each three consecutive 64 x 64 GRAY frames as one YUV frame: the first is luma, the upper left
    quarters of the others are chroma."""
    def quarter(p: Column) -> Column:
        rows = F.concat(*[p["data"].substr(y * 64 + 1, 32) for y in range(32)])
        return F.struct(F.lit(32).alias("height"), F.lit(32).alias("width"), rows.alias("data"))

    p = F.col("planes")
    return rgb(frames, clip).withColumn("color_family", F.lit("YUV")).withColumn("planes", F.array(p[0], quarter(p[1]), quarter(p[2])))


def rgb(frames: DataFrame, clip: str) -> DataFrame:
    """Each three consecutive GRAY frames as one RGB frame."""
    n = F.expr("frame_no div 3")
    joined = frames.groupBy(n.alias("frame_no")).agg(F.sort_array(F.collect_list(F.struct("frame_no", "planes"))).alias("ps")).where(F.size("ps") == 3)
    return joined.select(F.lit(clip).alias("clip_id"), "frame_no", F.lit("RGB").alias("color_family"), F.lit(8).alias("bits"), F.lit("u8").alias("dtype"), F.flatten(F.transform("ps", lambda p: p["planes"])).alias("planes"))


def synthetic(spark: SparkSession, n: int, side: int = 192) -> tuple[DataFrame, DataFrame]:
    """n frames of a formula, side x side: reference and distorted."""
    base = spark.range(n * side).select(F.expr(f"id div {side}").alias("f"), (F.col("id") % side).alias("y"))
    f, y = F.col("f"), F.col("y")
    r = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(side - 1).cast("long")), lambda x: (7 * x + 3 * y + 29 * F.floor(x / 16) * F.floor(y / 16) + 31 * f) % 256)
    rows = base.withColumn("r", r).withColumn("d", F.transform("r", lambda v, x: _clip(v + (5 * x + 11 * y + 7 * f) % 23 - 11)))
    name = f"syn{side}"
    return _frames(rows, name, side, side, "r"), _frames(rows, name, side, side, "d")
