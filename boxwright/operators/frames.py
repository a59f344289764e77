"""Statistics of detections in videos, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep(detections: DataFrame, conf: float, classes: tuple[str, ...] = ()) -> DataFrame:
    """P5: detections over a confidence, of the chosen classes; no choice means all."""
    out = detections.filter(F.col("conf") >= conf)
    return out.filter(F.col("class_name").isin(*classes)) if classes else out


def confidence_summary(detections: DataFrame, by: str = "video_id") -> DataFrame:
    """Total, mean, exact median, least and most."""
    return detections.groupBy(by).agg(
        F.count("*").alias("total"), F.avg("conf").alias("mean_conf"), F.median("conf").alias("median_conf"), F.min("conf").alias("min_conf"), F.max("conf").alias("max_conf")
    )


def class_summary(detections: DataFrame, by: str = "video_id") -> DataFrame:
    """Count, share in per cent (one decimal) and mean confidence (three) of each class."""
    counts = detections.groupBy(by, "class_name").agg(F.count("*").alias("n"), F.round(F.avg("conf"), 3).alias("mean_conf"))
    return counts.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(by)), 1))


def frame_counts(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections of every frame, 0 where there is none."""
    counts = detections.groupBy("video_id", "frame_idx").agg(F.count("*").alias("n"))
    return frames.join(counts, ["video_id", "frame_idx"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def peaks(counts: DataFrame) -> DataFrame:
    """The most and the mean number of detections of a frame, per video."""
    return counts.groupBy("video_id").agg(F.count("*").alias("n_frames"), F.max("n").alias("peak"), F.avg("n").alias("mean_per_frame"))


def histogram(detections: DataFrame, bins: int = 10) -> DataFrame:
    """Detections in equal bins of confidence, the last one closed, empty ones 0."""
    counts = detections.groupBy(F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = detections.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def overview(detections: DataFrame) -> DataFrame:
    """Mean confidence, total and number of classes."""
    return detections.agg(F.avg("conf").alias("mean_conf"), F.count("*").alias("total"), F.count_distinct("class_name").alias("n_classes"))


def class_shares(detections: DataFrame) -> DataFrame:
    """Counts of classes with whole per cents, largest first."""
    counts = detections.groupBy("class_name").agg(F.count("*").alias("n"))  # a row for each class
    share = F.floor(100 * F.col("n") / F.sum("n").over(Window.partitionBy()))
    return counts.withColumn("share", share).orderBy(F.desc("n"), "class_name")


def within_budget(detections: DataFrame, videos: DataFrame, seconds: float | None = None, most: int | None = None) -> DataFrame:
    """The first int(seconds x fps) frames, else ``most``, else all; ``videos``: video_id, fps, n_frames."""
    budget = F.floor(F.lit(seconds) * F.col("fps")) if seconds is not None else F.lit(most) if most is not None else F.col("n_frames")
    limits = videos.select("video_id", F.least(budget, F.col("n_frames")).alias("budget"))
    return detections.join(limits, "video_id").filter(F.col("frame_no") < F.col("budget")).drop("budget")


def throughput(videos: DataFrame) -> DataFrame:
    """Frames a second, ms a frame and duration, from n_frames, fps and busy_s."""
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return videos.withColumns(
        {"frames_per_s": safe(F.col("n_frames"), F.col("busy_s")), "ms_per_frame": safe(1000.0 * F.col("busy_s"), F.col("n_frames")), "duration_s": safe(F.col("n_frames"), F.col("fps"))}
    )
