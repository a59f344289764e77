"""Frame detections as a stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from boxwright.plans.views import VIEWS
from boxwright.session import run_folder


def read_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """Rows (video_id, frame_idx, event_time, class_name, conf) as their Parquet files arrive.

    ``event_time`` is a TIMESTAMP (watermarks need one), read as UTC.
    """
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}*")
    return spark.sql(VIEWS["frame_detections"], events=events).withColumn("event_time", F.to_utc_timestamp(F.col("event_time").cast("timestamp"), "UTC"))


def window_counts(detections: DataFrame, length: str, late: str = "1 hour") -> DataFrame:
    """Detections per video, class and tumbling window; state of windows past the watermark goes in append mode."""
    counted = detections.withWatermark("event_time", late).groupBy(F.window("event_time", length), "video_id", "class_name").agg(F.count("*").alias("n"))
    return counted.select("video_id", "class_name", F.unix_timestamp("window.start").alias("window_start"), "n")


def frame_windows(detections: DataFrame, length: str, late: str) -> DataFrame:
    """``window``, video_id, frame_idx, count and confidences of each frame in each tumbling window, for append mode."""
    frames = detections.withWatermark("event_time", late).groupBy(F.window("event_time", length), "video_id", "frame_idx")
    return frames.agg(F.count("*").alias("n"), F.sum("conf").alias("conf_sum"), F.min("conf").alias("min_conf"), F.max("conf").alias("max_conf"))


def video_windows(detections: DataFrame, length: str, late: str, frames: str) -> DataFrame:
    """Total, frames, peak of a frame and confidences of each video in each window of ``length``, final when they come.

    Two stateful aggregations, one after the other: frames in windows of
    ``frames`` (which divide ``length``), then videos over the frames that are
    closed.  Both give up a window's state when the watermark has passed it, so
    the state holds the open windows only; rows that are later than that are
    dropped (see ``replay`` for how many).
    """
    closed = frame_windows(detections, frames, late)
    videos = closed.groupBy(F.window(F.window_time("window"), length), "video_id").agg(
        F.sum("n").alias("total"), F.count("*").alias("n_frames"), F.max("n").alias("peak"),
        (F.sum("conf_sum") / F.sum("n")).alias("mean_conf"), F.min("min_conf").alias("min_conf"), F.max("max_conf").alias("max_conf"),
    )
    return videos.select("video_id", F.unix_timestamp("window.start").alias("window_start"), *[c for c in videos.columns if c not in ("video_id", "window")])


@dataclass
class Replayed:
    """What a stream wrote, and what its state holds at the end."""

    rows: DataFrame
    state: DataFrame
    n_read: int
    n_state: list[int]


def replay(arrivals: DataFrame, batch: str, n: int, work: Callable[[DataFrame], DataFrame]) -> Replayed:
    """Run ``work`` in append mode over rows that arrive in ``n`` batches (numbers from 0 in the column ``batch``).

    Each batch's files are added to the shared folder and the stream is started
    again from its checkpoint, as after a failure; watermark and state go on.
    ``rows`` are the final rows; ``state`` is the first aggregation's state (key
    and value), read from the checkpoint; ``n_state`` tells the rows of state
    after each batch.
    """
    spark = arrivals.sparkSession
    folder = run_folder(spark, "stream")
    given = arrivals.drop(batch)
    n_read, n_state = 0, []
    for k in range(n):
        arrivals.filter(F.col(batch) == k).drop(batch).write.mode("append").parquet(f"{folder}/in")
        stream = work(spark.readStream.schema(given.schema).parquet(f"{folder}/in"))
        query = _start(stream, "append", folder, lambda rows: rows)
        query.awaitTermination()
        progress = [p for p in query.recentProgress if p["stateOperators"]]
        n_read += sum(p["numInputRows"] for p in progress)
        n_state.append(sum(o["numRowsTotal"] for o in progress[-1]["stateOperators"]) if progress else 0)
    state = spark.read.format("statestore").option("operatorId", 0).load(f"{folder}/state")
    return Replayed(spark.read.schema(stream.schema).parquet(f"{folder}/out/*"), state, n_read, n_state)


def numbered_frames(detections: DataFrame, videos: DataFrame) -> DataFrame:
    """T5: adds ``frame_no`` of its video, from the time since it ``began`` (microseconds) and its ``fps``."""
    timed = detections.join(videos.select("video_id", "began", "fps"), "video_id")
    number = F.expr("(unix_micros(event_time) - began) * fps div 1000000")
    return timed.withColumn("frame_no", number).drop("began", "fps")


def frame_statistics(detections: DataFrame) -> DataFrame:
    """Count and confidences of each frame so far, the state that a video's statistics are made from."""
    return detections.groupBy("video_id", "frame_idx").agg(F.count("*").alias("n"), F.sum("conf").alias("conf_sum"), F.min("conf").alias("min_conf"), F.max("conf").alias("max_conf"))


def video_statistics(frames: DataFrame) -> DataFrame:
    """Total, peak of a frame and confidences of each video so far, from its frames' statistics.

    For ``run_once(..., finish=...)``: a stream can't aggregate twice, a batch of
    its output can.  An exact median can't be kept as a stream's state: see the batch form.
    """
    return frames.groupBy("video_id").agg(
        F.sum("n").alias("total"), F.max("n").alias("peak"), (F.sum("conf_sum") / F.sum("n")).alias("mean_conf"), F.min("min_conf").alias("min_conf"), F.max("max_conf").alias("max_conf")
    )


def _start(stream: DataFrame, mode: str, folder: str, finish: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Start a stream over what is there now; each batch goes through ``finish`` to a folder of its own, so that one that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        finish(batch).write.mode("overwrite").parquet(f"{folder}/out/{'all' if mode == 'complete' else number}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()


def run_once(stream: DataFrame, mode: str, finish: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> DataFrame:
    """Run a stream over what is there now and return what it wrote, each batch through ``finish``; the result lies in the shared folder."""
    spark = stream.sparkSession
    folder = run_folder(spark, "stream")
    _start(stream, mode, folder, finish).awaitTermination()
    schema = finish(spark.createDataFrame([], stream.schema)).schema
    return spark.read.schema(schema).parquet(f"{folder}/out/*")
