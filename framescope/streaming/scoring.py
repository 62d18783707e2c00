"""Scores of frame streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framescope.operators import scoring
from framescope.operators.pairing import KEYS


def paired(reference: DataFrame, distorted: DataFrame, late: str = "10 minutes", keep_unmatched: bool = False) -> DataFrame:
    """Stream-stream join of two frame streams with a ts column on clip, frame and time: partners
    are at most `late` apart, which bounds the join's state. Later frames are dropped, and counted by
    Spark (see `dropped`). keep_unmatched: distorted frames whose partner can no longer come follow
    with a null ref."""
    r = reference.withWatermark("ts", late).select(F.col("clip_id").alias("r_clip"), F.col("frame_no").alias("r_frame"), F.col("ts").alias("r_ts"), F.col("planes").alias("ref"))
    d = distorted.withWatermark("ts", late).withColumnRenamed("planes", "dist")
    near = F.expr(f"r_clip = clip_id AND r_frame = frame_no AND r_ts BETWEEN ts - INTERVAL {late} AND ts + INTERVAL {late}")
    return d.join(r, near, "left_outer" if keep_unmatched else "inner").drop("r_clip", "r_frame", "r_ts")


def dropped(query: StreamingQuery) -> int:
    """Rows that came too late for a stream's state, by its recent progress reports."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def start(
    pairs: DataFrame, feature: object, sink: Callable[[DataFrame, int], None], checkpoint: str, *, trigger: dict | None = None, color_family: str = "GRAY",
    unmatched: Callable[[DataFrame, int], None] | None = None, **options,
) -> StreamingQuery:
    """Score every micro-batch of a pair stream by the batch plan and hand it to sink(scores, id); frames
    without a reference go to unmatched(keys, id), if given, and are left out."""

    def each(batch: DataFrame, number: int) -> None:
        sink(scoring.score(batch.where("ref is not null"), feature, color_family=color_family, **options), number)
        if unmatched is not None:
            unmatched(batch.where("ref is null").select(*KEYS), number)

    return pairs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
