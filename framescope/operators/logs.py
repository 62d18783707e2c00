"""Score logs as ordered text lines: csv, json, xml and MicroDVD subtitles.

Lines are built by SQL functions; `write` sorts them by range and writes text files whose order is
the log's: one clip a log, as its frame numbers are the only key. `write_clips` writes the logs of many clips, a
whole file each.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from framescope import __version__
from framescope.operators.pairing import KEYS
from framescope.operators.pooling import pooled
from framescope.sources.video import FileWriter

FORMATS = ("xml", "json", "csv", "sub")
_LAST = (1 << 62)


def number(v: Column) -> Column:
    """Six decimals, or nan, inf, -inf."""
    inf = float("inf")
    return F.when(F.isnan(v), "nan").when(v == inf, "inf").when(v == -inf, "-inf").otherwise(F.format_string("%.6f", v))


def _json(v: Column, digits: int | None) -> Column:
    v = v if digits is None else F.round(v, digits)
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.concat(F.lit('"'), number(v), F.lit('"'))).otherwise(v.cast("string"))


def log(scores: DataFrame, format: str, digits: int | None = None, by_clip: bool = False) -> DataFrame:
    """place, line: a log's text, ordered by place. digits: of json's numbers, which are whole else. by_clip:
    a log for every clip, with its clip_id."""
    if format not in FORMATS:
        raise ValueError(f"a log format is one of {FORMATS}, not {format!r}")
    props = [c for c in scores.columns if c not in KEYS]
    n, clip = F.col("frame_no"), ["clip_id"] if by_clip else []
    has = lambda p: F.col(p).isNotNull()

    def lines(df: DataFrame, place: Column, line: Column) -> DataFrame:
        return df.select(*clip, place.cast("long").alias("place"), line.alias("line"))

    def fixed(place: int, *text: str) -> DataFrame:
        """Constant lines: once, without reading the scores, or once a clip."""
        rows = F.array(*[F.struct(F.lit(place + i).cast("long").alias("place"), F.lit(t).alias("line")) for i, t in enumerate(text)])
        return scores.select("clip_id").distinct().select("clip_id", F.inline(rows)) if by_clip else scores.sparkSession.range(1, numPartitions=1).select(F.inline(rows))

    if format == "csv":
        body = F.concat_ws(",", n.cast("string"), *[F.when(has(p), number(F.col(p))).otherwise("") for p in props])
        parts = [fixed(-1, ",".join(["frameNum", *props])), lines(scores, n, body)]
    elif format == "sub":
        body = F.concat(F.lit("{"), n, F.lit("}{"), n + 1, F.lit("}frame: "), n, F.lit("|"), *[F.when(has(p), F.concat(F.lit(f"{p}: "), number(F.col(p)), F.lit("|"))).otherwise("") for p in props])
        parts = [lines(scores, n, body)]
    else:
        stats = ("min", "max", "mean", "harmonic_mean")
        order = F.array_position(F.array(*map(F.lit, props)), F.col("prop")) + _LAST
        means = pooled(scores)
        if format == "xml":
            body = F.concat(F.lit('    <frame frameNum="'), n, F.lit('" '), F.concat_ws(" ", *[F.when(has(p), F.concat(F.lit(f'{p}="'), number(F.col(p)), F.lit('"'))) for p in props]), F.lit("/>"))
            pool = F.concat(F.lit('    <metric name="'), F.col("prop"), F.lit('" '), F.concat_ws(" ", *[F.concat(F.lit(f'{s}="'), number(F.col(s)), F.lit('"')) for s in stats]), F.lit("/>"))
            parts = [
                fixed(-3, '<?xml version="1.0" encoding="utf-8"?>', f'<framescope version="{__version__}">', "  <frames>"), lines(scores, n, body),
                fixed(_LAST - 1, "  </frames>", "  <pooled_metrics>"), lines(means, order, pool), fixed(_LAST + 1 + len(props), "  </pooled_metrics>", "</framescope>"),
            ]
        else:
            # one object a line inside the two containers; commas lead, as the last line is not known
            if by_clip:
                scores = scores.withColumn("__first", F.min("frame_no").over(Window.partitionBy("clip_id")))
                first = F.col("__first")
            else:
                first = F.lit(scores.agg(F.min("frame_no")).first()[0])
            body = F.concat(F.when(n == first, "    ").otherwise("   ,"), F.lit('{"frameNum": '), n, F.lit(', "metrics": {'), F.concat_ws(", ", *[F.when(has(p), F.concat(F.lit(f'"{p}": '), _json(F.col(p), digits))) for p in props]), F.lit("}}"))
            pool = F.concat(F.when(F.col("prop") == (props[0] if props else ""), "    ").otherwise("   ,"), F.lit('"'), F.col("prop"), F.lit('": {'), F.concat_ws(", ", *[F.concat(F.lit(f'"{s}": '), _json(F.col(s), digits)) for s in stats]), F.lit("}"))
            parts = [
                fixed(-2, f'{{"version": "{__version__}",', '  "frames": ['), lines(scores, n, body),
                fixed(_LAST - 1, "  ],", '  "pooled_metrics": {'), lines(means, order, pool), fixed(_LAST + 1 + len(props), "  }", "}"),
            ]
    return reduce(DataFrame.unionByName, parts)


class LogWriter(FileWriter):
    """One file a clip: its rows come to one task, in order."""

    def contents(self, iterator):
        rows = ((c, line) for batch in iterator for c, line in zip(batch.column("clip_id").to_pylist(), batch.column("line").to_pylist(), strict=True))
        for clip, lines in groupby(rows, lambda x: x[0]):
            yield f"{quote(clip, safe='')}.{self.options['format']}", (f"{line}\n".encode() for _, line in lines)


class Logs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framescope_logs"

    def writer(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(self.options, overwrite)


def write_clips(scores: DataFrame, path: str, format: str, mode: str = "append") -> None:
    """A file `clip.format` under path for every clip, whole or not there: tasks write aside, and files take
    their names when the job has succeeded (those of the same name are replaced). A clip's lines are one
    task's work, line by line; frames without a clip_id fail the job."""
    held = not scores.storageLevel.useMemory and format not in ("csv", "sub")
    if held:
        scores.persist()
    try:
        scores.sparkSession.dataSource.register(Logs)
        named = F.when(F.col("clip_id").isNull(), F.raise_error(F.lit("a frame without clip_id has no log"))).otherwise(F.col("clip_id"))
        lines = log(scores, format, by_clip=True).withColumn("clip_id", named)
        lines.repartition("clip_id").sortWithinPartitions("clip_id", "place").write.format("framescope_logs").options(format=format).mode(mode).save(path)
    finally:
        if held:
            scores.unpersist()


def write(scores: DataFrame, path: str, format: str, mode: str = "errorifexists") -> None:
    """Text part files under path; in name order they are the log. Formats with pooled statistics read
    the scores several times: they are kept while the log is written."""
    held = not scores.storageLevel.useMemory and format not in ("csv", "sub")
    if held:
        scores.persist()
    try:
        log(scores, format).orderBy("place").select("line").write.mode(mode).text(path)
    finally:
        if held:  # only what was cached here
            scores.unpersist()
