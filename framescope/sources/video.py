"""Clips in raw planar or YUV4MPEG2 files as a splittable Spark data source, and its writer.

Every file of a folder belongs to the clip of that folder's name; files are ordered by name and their
frames numbered on. A frame's place in its file follows from its number alone, so a partition is a range of
frames, and a task seeks to its bytes: files of any size are read by as many tasks as they have ranges, a
few frames at a time. Conditions on frame_no and clip_id are pushed into the ranges: other frames' bytes
are never read.

    read(spark, path, format="y4m").where("clip_id = 'a' AND frame_no BETWEEN 100 AND 199")

Paths are local ones or URIs of any file system Arrow knows. Empty files give no frames; bytes after the last
whole frame are left out in raw files and are a fault in y4m ones, as is a frame whose marker carries
parameters (its length could not be known). Frame rates are not kept.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from framescope.functions.pixels import WIDTH
from framescope.sources.frames import CHROMA, SCHEMA, shapes

NAME = "framescope_clips"
SPLIT_BYTES = 128 << 20  # of a partition, about
_BATCH_BYTES = 8 << 20
_PLANE = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])
ARROW = pa.schema([("clip_id", pa.string()), ("frame_no", pa.int64()), ("color_family", pa.string()), ("bits", pa.int32()), ("dtype", pa.string()), ("planes", pa.list_(_PLANE))])
MARK = b"FRAME\n"


@dataclass(frozen=True)
class Layout:
    """How frames lie in a file."""

    color_family: str
    dtype: str
    bits: int | None
    planes: tuple[tuple[int, int, int], ...]  # height, width and samples from row to row
    header: int = 0
    mark: int = 0  # bytes before each frame's samples

    @property
    def length(self) -> int:
        return self.mark + WIDTH[self.dtype] * sum(h * p for h, _, p in self.planes)

    def split(self, data: memoryview) -> list[bytes]:
        """The planes of one frame without padding."""
        out, at, size = [], self.mark, WIDTH[self.dtype]
        for h, w, p in self.planes:
            raw = data[at : at + h * p * size]
            out.append(bytes(raw) if p == w else np.frombuffer(raw, np.uint8).reshape(h, p * size)[:, : w * size].tobytes())
            at += h * p * size
        return out


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:/", path, re.I) else (fs.LocalFileSystem(), path)


def raw_layout(options: dict) -> Layout:
    height, width, dtype = int(options["height"]), int(options["width"]), options.get("dtype", "u8")
    family = options.get("color_family", "GRAY")
    halved = tuple(int(x) for x in options.get("subsampling", "0,0").split(","))
    stride = options.get("stride")
    planes = tuple((h, w, w if stride is None else -(-int(stride) * w // width)) for h, w in shapes(height, width, family, halved))
    return Layout(family, dtype, int(options["bits"]) if options.get("bits") else None, planes, int(options.get("header", 0)), int(options.get("frame_header", 0)))


def y4m_layout(head: bytes, path: str) -> Layout:
    """The layout that a file's first line states."""
    line = head.split(b"\n")[0].decode("latin-1")
    values = {x[0]: x[1:] for x in line.split()[1:]}
    tag = re.fullmatch(rf"({'|'.join(sorted(CHROMA, reverse=True))})p?(\d*)", values.get("C", "420"))
    if not line.startswith("YUV4MPEG2") or tag is None or not {"H", "W"} <= set(values):
        raise ValueError(f"{path} is no YUV4MPEG2 file of a known chroma format")
    halved, bits = CHROMA[tag[1]], int(tag[2] or 8)
    family = "GRAY" if halved is None else "YUV"
    planes = tuple((h, w, w) for h, w in shapes(int(values["H"]), int(values["W"]), family, halved or (0, 0)))
    return Layout(family, "u8" if bits == 8 else "u16", bits, planes, len(line) + 1, len(MARK))


@dataclass
class Range(InputPartition):
    """Frames first to first + n - 1 of a file; the first one's number in its clip is `number`."""

    path: str
    clip: str
    layout: Layout
    first: int
    n: int
    number: int


class ClipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.low, self.high, self.only, self.clips = 0, None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name, value = f.attribute if hasattr(f, "attribute") else (), getattr(f, "value", None)
            wanted = {value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if isinstance(f, IsNotNull) and name in (("frame_no",), ("clip_id",)):
                continue
            if name == ("clip_id",) and wanted is not None:
                self.clips = wanted if self.clips is None else self.clips & wanted
            elif name == ("frame_no",) and wanted is not None:
                self.only = wanted if self.only is None else self.only & wanted
            elif name == ("frame_no",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            elif name == ("frame_no",) and isinstance(f, (LessThan, LessThanOrEqual)):
                last = value - isinstance(f, LessThan)
                self.high = last if self.high is None else min(self.high, last)
            else:
                yield f

    def files(self) -> list[tuple[str, int]]:
        """Paths and sizes, by path: names alone are read here."""
        where, path = filesystem(self.options["path"])
        info = where.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(path, recursive=True))
        hidden = lambda p: any(x[:1] in "._" for x in PurePosixPath(p).relative_to(path).parts)
        return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and (f.path == path or not hidden(f.path)))

    def partitions(self) -> list[Range]:
        where, _ = filesystem(self.options["path"])
        files = [(p, n, PurePosixPath(p).parent.name) for p, n in self.files()]
        if self.clips is not None:
            files = [f for f in files if f[2] in self.clips]
        if self.options.get("format", "raw") == "y4m":

            def head(f: tuple[str, int, str]) -> Layout | None:
                if not f[1]:
                    return None
                with where.open_input_file(f[0]) as file:
                    return y4m_layout(file.read_at(min(f[1], 1024), 0), f[0])

            with ThreadPoolExecutor(16) as pool:  # one short read a file
                layouts = list(pool.map(head, files))
        else:
            layouts = [raw_layout(self.options)] * len(files)
        out, number, at = [], 0, None
        for (path, size, clip), layout in zip(files, layouts, strict=True):
            number = number if clip == at else 0
            at = clip
            if layout is None:
                continue
            n, rest = divmod(max(0, size - layout.header), layout.length)
            if rest and self.options.get("format", "raw") == "y4m":
                raise ValueError(f"{path}: {rest} bytes after {n} frames are no frame")
            step = max(1, int(self.options.get("split_bytes", SPLIT_BYTES)) // layout.length)
            wanted = [x - number for x in sorted(self.only)] if self.only is not None else None
            low, high = max(0, self.low - number), n if self.high is None else min(n, self.high - number + 1)
            for first in range(low, high, step):
                end = min(first + step, high)
                if wanted is None or any(first <= x < end for x in wanted):
                    out.append(Range(path, clip, layout, first, end - first, number + first))
            number += n
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark gives where there are no ranges
            return
        where, _ = filesystem(self.options["path"])
        a, length = partition.layout, partition.layout.length
        numbers = [k for k in range(partition.n) if self.only is None or partition.number + k in self.only]
        each = max(1, _BATCH_BYTES // length)
        with where.open_input_file(partition.path) as file:
            for i in range(0, len(numbers), each):
                part, data = numbers[i : i + each], []
                for k in part:
                    raw = memoryview(file.read_at(length, a.header + (partition.first + k) * length))
                    if self.options.get("format", "raw") == "y4m" and bytes(raw[: a.mark]) != MARK:
                        raise ValueError(f"{partition.path}: frame {partition.first + k} has parameters or is no frame")
                    data += a.split(raw)
                m, p = len(part), len(a.planes)
                plane = pa.StructArray.from_arrays([pa.array([h for h, _, _ in a.planes] * m, pa.int32()), pa.array([w for _, w, _ in a.planes] * m, pa.int32()), pa.array(data, pa.binary())], fields=list(_PLANE))
                same = lambda v, kind: pa.array([v] * m, kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [same(partition.clip, pa.string()), pa.array([partition.number + k for k in part], pa.int64()), same(a.color_family, pa.string()), same(a.bits, pa.int32()), same(a.dtype, pa.string()), pa.ListArray.from_arrays(pa.array(np.arange(0, (m + 1) * p, p), pa.int32()), plane)],
                    schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a file lies, and where it belongs


class FileWriter(DataSourceArrowWriter):
    """Tasks write whole files aside; commit moves them to their places, abort removes them. Attempts of a
    task never meet, as names aside hold the attempt's number."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = dict(options), overwrite
        self.aside = f"{self.options['path'].rstrip('/')}/.pending-{uuid.uuid4().hex}"

    def contents(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
        """Relative names, and pieces of each file in turn."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, aside = filesystem(self.aside)
        _, path = filesystem(self.options["path"].rstrip("/"))
        attempt, done = TaskContext.get().taskAttemptId(), []
        where.create_dir(aside, recursive=True)
        for name, pieces in self.contents(iterator):
            held = f"{aside}/{attempt}-{len(done)}"
            with where.open_output_stream(held) as file:
                for x in pieces:
                    file.write(x)
            done.append((held, f"{path}/{name}"))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        where, path = filesystem(self.options["path"].rstrip("/"))
        files = [x for m in messages if m is not None for x in m.files]
        names = [to for _, to in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two tasks wrote one file: sort and partition the rows first")
        if self.overwrite:
            for f in where.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if not f.base_name.startswith(".pending-"):
                    where.delete_dir(f.path) if f.type == fs.FileType.Directory else where.delete_file(f.path)
        for held, to in files:
            where.create_dir(str(PurePosixPath(to).parent), recursive=True)
            where.move(held, to)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        where, aside = filesystem(self.aside)
        if where.get_file_info(aside).type == fs.FileType.Directory:
            where.delete_dir(aside)


class ClipWriter(FileWriter):
    """One file for each task and clip, named by its first frame; rows come sorted by clip and frame."""

    def contents(self, iterator):
        y4m = self.options.get("format", "raw") == "y4m"
        rows = ((c.as_py(), n.as_py(), f.as_py(), b.as_py(), d.as_py(), p) for batch in iterator for c, n, f, b, d, p in zip(*(batch.column(x) for x in ARROW.names), strict=True))
        row = next(rows, None)
        while row is not None:
            clip, first = row[0], row[1]
            if clip is None or first is None:
                raise ValueError("a frame without clip_id or frame_no has no place in a file")
            shape = _shape(row)

            def pieces() -> Iterator[bytes]:
                nonlocal row
                if y4m:
                    yield _head(shape)
                while row is not None and row[0] == clip:  # noqa: B023
                    if _shape(row) != shape:  # noqa: B023
                        raise ValueError(f"frame {row[1]} of clip {clip} differs in format or size from frame {first}")  # noqa: B023
                    if y4m:
                        yield MARK
                    for plane in row[5].values:
                        yield plane["data"].as_buffer().to_pybytes()
                    row = next(rows, None)

            yield f"{clip}/{first:012d}.{'y4m' if y4m else 'raw'}", pieces()


def _shape(row: tuple) -> tuple:
    return (*row[2:5], tuple((p["height"].as_py(), p["width"].as_py()) for p in row[5].values))


def _head(shape: tuple) -> bytes:
    family, bits, dtype, planes = shape
    (h, w), chroma = planes[0], planes[1:2]
    tag = "mono" if family == "GRAY" else next((t for t, s in CHROMA.items() if s is not None and family == "YUV" and chroma == tuple(shapes(h, w, "YUV", s)[1:2])), None)
    if tag is None or dtype not in ("u8", "u16"):
        raise ValueError(f"YUV4MPEG2 holds no {family} frames of {dtype} and planes {planes}")
    deep = "" if dtype == "u8" else f"p{bits or 16}" if tag != "mono" else str(bits or 16)
    return f"YUV4MPEG2 W{w} H{h} F25:1 C{tag}{deep}\n".encode()


class Clips(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ClipReader:
        return ClipReader(self.options)

    def writer(self, schema, overwrite: bool) -> ClipWriter:
        return ClipWriter(self.options, overwrite)


def read(spark: SparkSession, path: str, format: str = "raw", **options) -> DataFrame:
    """The frames of all files under path. format "y4m", or "raw" with height, width and, where they differ
    from the defaults, color_family, dtype, bits, subsampling (halvings across and down), stride (samples
    from row to row of the first plane), header and frame_header (bytes to leave out). split_bytes: of a
    partition. Turns on the session's filter pushdown for Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Clips)
    given = {k: ",".join(map(str, v)) if isinstance(v, tuple) else str(v) for k, v in options.items() if v is not None}
    return spark.read.format(NAME).options(format=format, **given).load(path)


def write(frames: DataFrame, path: str, format: str = "raw", mode: str = "append", files: int | None = None) -> None:
    """Files of consecutive frames under path/clip_id, about `files` of them over all clips (as many as
    shuffle partitions); they are numbered from 0 without gaps when read again. All files appear at once when
    the job has succeeded."""
    frames.sparkSession.dataSource.register(Clips)
    keys = ("clip_id", "frame_no")
    ranged = frames.repartitionByRange(files, *keys) if files else frames.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).select(*ARROW.names).write.format(NAME).options(format=format).mode(mode).save(path)
