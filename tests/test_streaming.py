import datetime as dt
import math
import time

from framescope.sources import frames
from framescope.operators import pooling
from framescope.streaming import clips, scoring


def stamped(df, path):
    from pyspark.sql import functions as F

    df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame_no"))).write.parquet(path)


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    from framescope.metrics import score_frames

    r, d = frames.synthetic(spark, 4, 32)
    stamped(r, str(tmp_path / "r"))
    stamped(d, str(tmp_path / "d"))
    schema = frames.SCHEMA + ", ts timestamp"
    streams = [spark.readStream.schema(schema).parquet(str(tmp_path / x)) for x in ("r", "d")]
    got = []
    q = scoring.start(scoring.paired(*streams), ["mse", "ssim"], lambda df, _: got.extend(df.collect()), str(tmp_path / "check"))
    q.awaitTermination(120)
    want = score_frames(r, d, ["mse", "ssim"], color_family="GRAY").collect()
    key = lambda x: x.frame_no
    assert len(got) == 4 and [(x.frame_no, x.mse, x.float_ssim) for x in sorted(got, key=key)] == [(x.frame_no, x.mse, x.float_ssim) for x in sorted(want, key=key)]


SCORES = "clip_id string, frame_no long, p double, q double"


def until(done, seconds=60):
    ends = time.time() + seconds
    while not done() and time.time() < ends:
        time.sleep(0.3)
    assert done()


def read(query):
    """Rows of finished batches; a query with timers never says that it has nothing left to do."""
    return sum(p.numInputRows for p in query.recentProgress)


def feed(spark, path, rows):
    spark.createDataFrame(rows, SCORES).coalesce(1).write.mode("append").parquet(path)


def test_clips_are_given_once_all_their_frames_have_come(spark, tmp_path):
    """Repeats, null scores, null and outside frame numbers, and a restart between a clip's frames."""
    at = str(tmp_path / "v")
    feed(spark, at, [("a", 2, 3.0, None), ("a", 0, 1.0, 0.5), ("a", 0, 9.0, 9.0), ("a", None, 1.0, 1.0), ("a", 7, 1.0, 1.0), ("b", 1, None, None)])
    got = []

    def start():
        stream = spark.readStream.schema(SCORES).parquet(at)
        return clips.completed(stream, 3).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()

    q = start()
    until(lambda: read(q) == 6)
    q.stop()
    assert not got  # three rows of `a` could be placed, but only two frames
    feed(spark, at, [("a", 0, 5.0, 5.0), ("a", 1, 2.0, 1.5)])
    q = start()
    until(lambda: got)
    assert [(r.clip_id, r.frame_no, r.p, r.complete, r.seen, r.unplaced) for r in got] == [("a", i, float(i + 1), True, 3, 2) for i in range(3)]
    assert got[0].q == 0.5 and got[2].q is None
    feed(spark, at, [("a", 1, 2.0, 1.5), ("b", 0, None, None), ("b", 2, 1.0, 1.0)])
    until(lambda: len(got) > 3)
    q.stop()
    assert [(r.clip_id, r.frame_no, r.p) for r in got[3:]] == [("b", 0, None), ("b", 1, None), ("b", 2, 1.0)]


def test_clips_of_a_stream_are_logged_whole_or_partial(spark, tmp_path):
    at, logs_at = str(tmp_path / "v"), tmp_path / "logs"
    feed(spark, at, [("a/1", i, float(i), 1.0) for i in (2, 0, 1)] + [("b", 1, 1.0, 2.0)])
    pooled = []
    q = clips.log_clips(spark.readStream.schema(SCORES).parquet(at), 3, str(logs_at), "csv", str(tmp_path / "c"), patience_ms=3000, trigger={"processingTime": "1 second"}, also=lambda df, _: pooled.extend(pooling.pooled(df.select("clip_id", "frame_no", "p")).collect()))
    until(lambda: len(pooled) == 2)
    q.stop()
    assert (logs_at / "a%2F1.csv").read_text() == "frameNum,p,q\n0,0.000000,1.000000\n1,1.000000,1.000000\n2,2.000000,1.000000\n"
    assert (logs_at / "partial" / "b.csv").read_text() == "frameNum,p,q\n1,1.000000,2.000000\n"
    assert {r.clip_id: r.mean for r in pooled} == {"a/1": 1.0, "b": 1.0}
    assert math.isclose(next(r.harmonic_mean for r in pooled if r.clip_id == "a/1"), 3 / (1 + 1 / 2 + 1 / 3) - 1) and dt


def test_frames_without_a_partner_are_told(spark, tmp_path):
    from pyspark.sql import functions as F

    r, d = frames.synthetic(spark, 4, 32)
    stamped(r.where("frame_no <> 0"), str(tmp_path / "r"))
    early = d.where("frame_no <> 1").withColumn("ts", F.timestamp_seconds(F.when(F.col("frame_no") == 0, 1_600_000_000).otherwise(1_700_000_000 + F.col("frame_no"))))
    early.write.parquet(str(tmp_path / "d"))
    schema = frames.SCHEMA + ", ts timestamp"
    streams = [spark.readStream.schema(schema).parquet(str(tmp_path / x)) for x in ("r", "d")]
    got, lost = [], []
    q = scoring.start(scoring.paired(*streams, "1 minute", True), "mse", lambda df, _: got.extend(df.collect()), str(tmp_path / "c"), unmatched=lambda df, _: lost.extend(df.collect()))
    ends = time.time() + 60
    while not lost and time.time() < ends:
        time.sleep(0.2)
    q.awaitTermination(5)
    q.stop()
    assert {x.frame_no for x in got} == {2, 3} and [x.frame_no for x in lost] == [0] and scoring.dropped(q) == 0


def test_staged_streams_are_scored(spark, tmp_path):
    """Frames of another shape and type in a stream, cast and reshaped on the way in."""
    r, d = frames.synthetic(spark, 2, 32)
    stamped(r, str(tmp_path / "r"))
    stamped(d, str(tmp_path / "d"))
    schema = frames.SCHEMA + ", ts timestamp"
    streams = [frames.staged(spark.readStream.schema(schema).parquet(str(tmp_path / x)), 16, 64, "f32") for x in ("r", "d")]
    got = []
    q = scoring.start(scoring.paired(*streams), "mse", lambda df, _: got.extend(df.collect()), str(tmp_path / "check"), data_range=255.0)
    q.awaitTermination(60)
    from framescope.metrics import score_frames

    want = {x.frame_no: x.mse for x in score_frames(r, d, "mse", color_family="GRAY").collect()}
    assert {x.frame_no: x.mse for x in got} == want
