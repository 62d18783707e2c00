"""Clips of a score stream as they complete: each frame counted once, logs in frame order.

State of a clip: a bitmap of the frame numbers that have come (blocks of 2**15 frames, 4 kB each), the rows
themselves as a list, and one timer. A frame that comes again, in one batch or after a restart, is passed over; a clip
is complete when every number from 0 to frames - 1 has come, whether its scores are null or not. A clip
without news for `patience_ms` is given as it is and marked partial; frames of a clip that has been given are
passed over while its mark lives (`remember_ms`). State is kept in RocksDB, so it may outgrow memory; rows are
written to it by batch, not one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from framescope.operators import logs
from framescope.operators.pairing import KEYS

_BITS = 15
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Completion(StatefulProcessor):
    def __init__(self, frames: int, names: list[str], patience_ms: int, remember_ms: int):
        self.frames, self.names, self.patience, self.remember = frames, names, patience_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "block long", "bits binary")
        self.rows = handle.getListState("rows", "frame_no long, " + ", ".join(f"`{x}` double" for x in self.names))
        self.count = handle.getValueState("count", "n long, unplaced long, timer long")
        self.given = handle.getValueState("given", "at long", self.remember)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.given.exists():
            return
        n, unplaced, timer = self.count.get() if self.count.exists() else (0, 0, -1)
        blocks: dict[int, bytearray] = {}
        for batch in rows:
            kept = []
            for i, frame in enumerate(batch["frame_no"]):
                if pd.isna(frame) or not 0 <= frame < self.frames:
                    unplaced += 1
                    continue
                block, at = divmod(int(frame), 1 << _BITS)
                if block not in blocks:
                    blocks[block] = bytearray(self.seen.getValue((block,))[0]) if self.seen.containsKey((block,)) else bytearray(1 << (_BITS - 3))
                if not blocks[block][at >> 3] >> (at & 7) & 1:
                    blocks[block][at >> 3] |= 1 << (at & 7)
                    kept.append(i)
            if kept:
                part = batch.iloc[kept]
                self.rows.appendList([(int(f), *(None if pd.isna(x) and x is None else float(x) for x in v)) for f, *v in part[["frame_no", *self.names]].astype(object).where(part[["frame_no", *self.names]].notna(), None).itertuples(index=False)])
                n += len(kept)
        for block, bits in blocks.items():
            self.seen.updateValue((block,), (bytes(bits),))
        if timer >= 0:
            self.handle.deleteTimer(timer)
        now = timerValues.getCurrentProcessingTimeInMs()
        if n >= self.frames:
            yield self._give(key, n, unplaced, True, now)
        else:
            self.handle.registerTimer(now + self.patience)
            self.count.update((n, unplaced, now + self.patience))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, unplaced, _ = self.count.get()
        if n:
            yield self._give(key, n, unplaced, False, timerValues.getCurrentProcessingTimeInMs())
        else:
            self.count.clear()

    def _give(self, key, n: int, unplaced: int, complete: bool, now: int) -> pd.DataFrame:
        found = sorted((tuple(r) for r in self.rows.get()), key=lambda r: r[0])
        out = pd.DataFrame(found, columns=["frame_no", *self.names]).astype({"frame_no": "int64"} | {x: "float64" for x in self.names})
        for x, v in (("clip_id", key[0]), ("complete", complete), ("seen", n), ("unplaced", unplaced)):
            out[x] = v
        for state in (self.seen, self.rows, self.count):
            state.clear()
        self.given.update((now,))
        return out[["clip_id", "frame_no", *self.names, "complete", "seen", "unplaced"]]

    def close(self) -> None:
        pass


def completed(scores: DataFrame, frames: int, patience_ms: int = 600_000, remember_ms: int = 86_400_000) -> DataFrame:
    """scores: a stream of clip_id, frame_no and double columns. The rows of each clip, in frame order inside the
    clip, once all its `frames` frames have come or its time is up; with complete, seen (different frames
    that came) and unplaced (rows whose frame_no is null or outside the clip). Null scores stay null or NaN.
    The session's state store must be RocksDB; this sets it."""
    scores.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    names = [c for c, t in scores.dtypes if c not in KEYS and t in ("double", "float")]
    out = "clip_id string, frame_no long, " + ", ".join(f"`{x}` double" for x in names) + ", complete boolean, seen long, unplaced long"
    rows = scores.select(*KEYS, *names)
    return rows.groupBy("clip_id").transformWithStateInPandas(Completion(frames, names, patience_ms, remember_ms), out, "Append", "ProcessingTime")


def log_clips(scores: DataFrame, frames: int, path: str, format: str, checkpoint: str, *, patience_ms: int = 600_000, trigger: dict | None = None, also: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """A log file under path for every clip of a score stream as it completes, under path/partial for those
    whose time is up. A batch that runs again after a failure writes the same files again. also: what else
    to do with each batch's rows."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for at, part in ((path, batch.where("complete")), (f"{path}/partial", batch.where("not complete"))):
                if not part.isEmpty():
                    logs.write_clips(part.drop("complete", "seen", "unplaced"), at, format)
            if also is not None:
                also(batch, number)
        finally:
            batch.unpersist()

    return completed(scores, frames, patience_ms).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
