"""Queries of run reports and of video statistics, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.operators import frames as V
from boxwright.operators import runs as R
from boxwright.plans.registry import query
from boxwright.plans.views import frame, sql
from boxwright.streaming import frames as T


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "run_metrics").withColumnsRenamed({"precision_v": "precision", "recall_v": "recall"})


def _first_run(spark: SparkSession, d: str) -> str:
    return frame(spark, d, "run_metrics").agg(F.min("run")).first()[0]


@query("w14_leaderboard", sql("SELECT run, map50_95, CAST(row_number() OVER (ORDER BY map50_95 DESC NULLS LAST, run) AS INT) AS place FROM run_metrics", "run_metrics"))
def w14(spark: SparkSession, d: str) -> DataFrame:
    return R.leaderboard(_runs(spark, d)).select("run", "map50_95", "place")


DELTA = ", ".join(f"round(r.{c}{s} - b.{c}{s}, 6) AS {c}_delta, round((r.{c}{s} - b.{c}{s}) / nullif(b.{c}{s}, 0) * 100, 6) AS {c}_delta_pct" for c, s in (("precision", "_v"), ("recall", "_v"), ("map50", ""), ("map50_95", "")))


@query("w15_baseline_delta", sql(f"SELECT r.run, {DELTA} FROM run_metrics r, (SELECT * FROM run_metrics ORDER BY run LIMIT 1) b", "run_metrics"))
def w15(spark: SparkSession, d: str) -> DataFrame:
    out = R.baseline_deltas(_runs(spark, d), _first_run(spark, d))
    return out.select("run", *[F.round(c, 6).alias(c) for c in out.columns if "_delta" in c])


LONG = " UNION ALL ".join(f"SELECT config_id, '{c}' AS metric, {c}{s} AS value FROM run_metrics" for c, s in (("precision", "_v"), ("recall", "_v"), ("map50", ""), ("map50_95", "")))


@query("a10_seed_statistics", sql(f"SELECT config_id, metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, min(value) AS min, max(value) AS max, count(*) AS n FROM ({LONG}) GROUP BY 1, 2", "run_metrics"))
def a10(spark: SparkSession, d: str) -> DataFrame:
    out = R.seed_statistics(_runs(spark, d), "config_id", ("precision", "recall", "map50", "map50_95"))
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("w16_model_choice", sql("SELECT run, CAST(rank() OVER (ORDER BY map50_95 DESC, recall_v DESC, map50 DESC, seed) AS INT) AS choice FROM run_metrics", "run_metrics"))
def w16(spark: SparkSession, d: str) -> DataFrame:
    return R.choose(_runs(spark, d), ("-map50_95", "-recall", "-map50", "seed")).select("run", "choice")


@query("w16_documented_order", sql("SELECT run, CAST(rank() OVER (ORDER BY map50_95 DESC, recall_v DESC, 100.0 - config_id DESC, config_id * 1000 + seed) AS INT) AS choice FROM run_metrics", "run_metrics"))
def w16_documented(spark: SparkSession, d: str) -> DataFrame:
    """By accuracy, then recall, then frames a second, then the number of parameters."""
    runs = _runs(spark, d).withColumns({"fps": F.lit(100.0) - F.col("config_id"), "parameters": F.col("config_id") * 1000 + F.col("seed")})
    return R.choose(runs).select("run", "choice")


STOP = """WITH h AS (SELECT *, row_number() OVER w AS n, max(map50_95) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM history WINDOW w AS (PARTITION BY run_id ORDER BY epoch)),
b AS (SELECT *, before IS NULL OR map50_95 > before AS is_best FROM h),
g AS (SELECT *, n - max(CASE WHEN is_best THEN n END) OVER w AS since_best, max(map50_95) OVER w AS best FROM b WINDOW w AS (PARTITION BY run_id ORDER BY epoch ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, bool_or(since_best >= 10) OVER (PARTITION BY run_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS stopped FROM g)"""


@query("w17_early_stop", sql(f"{STOP} SELECT run_id, epoch, best, is_best, since_best::BIGINT AS since_best, stopped FROM s", "history"))
def w17(spark: SparkSession, d: str) -> DataFrame:
    return R.early_stop(frame(spark, d, "history"), 10).select("run_id", "epoch", "best", "is_best", F.col("since_best").cast("bigint").alias("since_best"), "stopped")


@query("w17_best_epochs", sql(f"{STOP}, k AS (SELECT *, coalesce(lag(stopped) OVER (PARTITION BY run_id ORDER BY epoch), false) AS over FROM s) SELECT run_id, max(CASE WHEN is_best THEN epoch END) AS best_epoch, max(map50_95) AS best, min(CASE WHEN stopped THEN epoch END) AS stop_epoch FROM k WHERE NOT over GROUP BY 1", "history"))
def w17_best(spark: SparkSession, d: str) -> DataFrame:
    return R.best_epochs(frame(spark, d, "history"), 10)


def _detections(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "frame_detections")


@query("p5_confidence_filter", sql("SELECT video_id, frame_idx, class_name, conf FROM frame_detections WHERE conf >= 0.25 AND class_name IN ('car', 'bus')", "frame_detections"))
def p5(spark: SparkSession, d: str) -> DataFrame:
    return V.keep(_detections(spark, d), 0.25, ("car", "bus")).select("video_id", "frame_idx", "class_name", "conf")


@query("p7_frame_budget", sql("WITH n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 AS frame_no FROM frame_detections) SELECT video_id, count(*) AS n FROM n WHERE frame_no < least(floor(1.5::DOUBLE * (10 + video_id % 5)), 50) GROUP BY 1", "frame_detections"))
def p7(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    numbered = _detections(spark, d).withColumn("frame_no", F.row_number().over(Window.partitionBy("video_id").orderBy("frame_idx")) - 1)
    videos = numbered.groupBy("video_id").agg((10 + F.col("video_id") % 5).alias("fps"), F.lit(50).alias("n_frames"))
    return V.within_budget(numbered, videos, seconds=1.5).groupBy("video_id").agg(F.count("*").alias("n"))


@query("a11_confidence_summary", sql("SELECT video_id, count(*) AS total, round(avg(conf), 9) AS mean_conf, round(median(conf), 9) AS median_conf, min(conf) AS min_conf, max(conf) AS max_conf FROM frame_detections GROUP BY 1", "frame_detections"))
def a11(spark: SparkSession, d: str) -> DataFrame:
    return V.confidence_summary(_detections(spark, d)).withColumns({c: F.round(c, 9) for c in ("mean_conf", "median_conf")})


@query("a12_class_summary", sql("SELECT video_id, class_name, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY video_id), 1) AS share FROM frame_detections GROUP BY 1, 2", "frame_detections"))
def a12(spark: SparkSession, d: str) -> DataFrame:
    return V.class_summary(_detections(spark, d)).drop("mean_conf")


PER_FRAME = "c AS (SELECT video_id, frame_idx // 50 AS frame_idx, count_if(conf >= 0.5) AS n FROM frame_detections GROUP BY 1, 2)"


@query("a13_peaks", sql(f"WITH {PER_FRAME} SELECT video_id, count(*) AS n_frames, max(n)::BIGINT AS peak, round(avg(n), 6) AS mean_per_frame FROM c GROUP BY 1", "frame_detections"))
def a13(spark: SparkSession, d: str) -> DataFrame:
    rows = _detections(spark, d).withColumn("frame_idx", F.floor(F.col("frame_idx") / 50))
    return V.peaks(V.frame_counts(rows.select("video_id", "frame_idx").distinct(), rows.filter("conf >= 0.5"))).withColumn("mean_per_frame", F.round("mean_per_frame", 6))


@query("a14_confidence_histogram", sql("SELECT b.bin::INT AS bin, count(f.conf) AS n FROM range(10) b(bin) LEFT JOIN frame_detections f ON least(floor(f.conf * 10), 9) = b.bin GROUP BY 1", "frame_detections"))
def a14(spark: SparkSession, d: str) -> DataFrame:
    return V.histogram(_detections(spark, d))


@query("a15_overview", sql("SELECT round(avg(conf), 6) AS mean_conf, count(*) AS total, count(DISTINCT class_name) AS n_classes FROM frame_detections", "frame_detections"))
def a15(spark: SparkSession, d: str) -> DataFrame:
    return V.overview(_detections(spark, d)).withColumn("mean_conf", F.round("mean_conf", 6))


@query("a23_throughput", sql("WITH v AS (SELECT video_id, count(*) AS n_frames, sum(conf) AS busy_s FROM frame_detections GROUP BY 1) SELECT video_id, round(n_frames / busy_s, 6) AS frames_per_s, round(1000 * busy_s / n_frames, 6) AS ms_per_frame, round(n_frames / 25.0::DOUBLE, 6) AS duration_s FROM v", "frame_detections"))
def a23(spark: SparkSession, d: str) -> DataFrame:
    videos = _detections(spark, d).groupBy("video_id").agg(F.count("*").alias("n_frames"), F.sum("conf").alias("busy_s"), F.lit(25).alias("fps"))
    return V.throughput(videos).select("video_id", *[F.round(c, 6).alias(c) for c in ("frames_per_s", "ms_per_frame", "duration_s")])


@query("w18_sorted_detections", sql("SELECT video_id, frame_idx, class_name, CAST(row_number() OVER (PARTITION BY video_id ORDER BY conf DESC, frame_idx) AS INT) AS place FROM frame_detections", "frame_detections"))
def w18(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("video_id").orderBy(F.desc("conf"), "frame_idx")
    return _detections(spark, d).select("video_id", "frame_idx", "class_name", F.row_number().over(w).alias("place"))


@query("w19_class_shares", sql("SELECT class_name, count(*) AS n, floor(100 * count(*) / sum(count(*)) OVER ())::BIGINT AS share FROM frame_detections GROUP BY 1", "frame_detections"))
def w19(spark: SparkSession, d: str) -> DataFrame:
    return V.class_shares(_detections(spark, d))


WINDOW = "SELECT video_id, class_name, epoch(time_bucket(INTERVAL '6 hours', event_time))::BIGINT AS window_start, count(*) AS n FROM frame_detections {where} GROUP BY 1, 2, 3"


@query("t2_window_counts", sql(WINDOW.format(where=""), "frame_detections"))
def t2(spark: SparkSession, d: str) -> DataFrame:
    return T.run_once(T.window_counts(T.read_stream(spark, d), "6 hours"), "complete")


@query("t4_live_filter", sql("SELECT video_id, frame_idx, class_name, conf FROM frame_detections WHERE conf >= 0.5 AND class_name IN ('person', 'bus')", "frame_detections"))
def t4(spark: SparkSession, d: str) -> DataFrame:
    return T.run_once(V.keep(T.read_stream(spark, d), 0.5, ("person", "bus")).select("video_id", "frame_idx", "class_name", "conf"), "append")


#: The first five days of each video, at 10 to 14 frames a second from its first event on.
BUDGET_S = 5 * 86400


@query(
    "t5_stream_budget",
    sql(
        f"""WITH v AS (SELECT video_id, min(epoch_us(event_time)) AS began, 10 + video_id % 5 AS fps FROM frame_detections GROUP BY video_id)
SELECT video_id, frame_idx FROM frame_detections JOIN v USING (video_id) WHERE (epoch_us(event_time) - began) * fps // 1000000 < {BUDGET_S} * fps""",
        "frame_detections",
    ),
)
def t5(spark: SparkSession, d: str) -> DataFrame:
    began = F.min(F.unix_micros(F.to_utc_timestamp(F.col("event_time").cast("timestamp"), "UTC"))).alias("began")
    videos = _detections(spark, d).groupBy("video_id").agg(began).withColumns({"fps": 10 + F.col("video_id") % 5, "n_frames": F.lit(1 << 40)})
    stream = T.numbered_frames(T.read_stream(spark, d), videos)
    return T.run_once(V.within_budget(stream, videos, seconds=BUDGET_S).select("video_id", "frame_idx"), "append")


@query(
    "t3_video_statistics",
    sql(
        """WITH f AS (SELECT video_id, frame_idx // 50 AS frame_idx, count(*) AS n, sum(conf) AS conf_sum, min(conf) AS lo, max(conf) AS hi FROM frame_detections GROUP BY 1, 2)
SELECT video_id, sum(n)::BIGINT AS total, max(n) AS peak, round(sum(conf_sum) / sum(n), 9) AS mean_conf, min(lo) AS min_conf, max(hi) AS max_conf FROM f GROUP BY 1""",
        "frame_detections",
    ),
)
def t3(spark: SparkSession, d: str) -> DataFrame:
    frames = T.read_stream(spark, d).withColumn("frame_idx", F.floor(F.col("frame_idx") / 50))
    return T.run_once(T.frame_statistics(frames), "complete", T.video_statistics).withColumn("mean_conf", F.round("mean_conf", 9))


@query("t1_stream_rows", sql("SELECT class_name, count(*) AS n FROM frame_detections GROUP BY 1", "frame_detections"))
def t1(spark: SparkSession, d: str) -> DataFrame:
    return T.run_once(T.read_stream(spark, d).groupBy("class_name").agg(F.count("*").alias("n")), "complete")


#: Batches in which events arrive, and how far the watermark lies behind the latest event.
BATCHES, LATE_H = 4, 6
LATE = f"""b AS (SELECT min(epoch_us(event_time)) AS lo, max(epoch_us(event_time)) AS hi FROM frame_detections),
e AS (SELECT f.*, epoch_us(event_time) AS us, least({BATCHES - 1}, {BATCHES} * (epoch_us(event_time) - lo) // (hi - lo + 1) + CASE WHEN frame_idx % 40 = 0 THEN 2 ELSE 0 END) AS batch FROM frame_detections f, b),
m AS (SELECT batch, max(max(us)) OVER (ORDER BY batch) - {LATE_H} * 3600000000 AS mark FROM e GROUP BY batch),
a AS (SELECT e.*, coalesce((SELECT max(mark) FROM m WHERE m.batch < e.batch), -1) AS before, (SELECT max(mark) FROM m) AS last FROM e)"""


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Detections by the batch they arrive in: by time, but each fortieth one two batches late."""
    rows = _detections(spark, d).withColumn("event_time", F.to_utc_timestamp(F.col("event_time").cast("timestamp"), "UTC"))
    us = F.unix_micros("event_time")
    lo, hi = rows.agg(F.min(us), F.max(us)).first()  # one row
    on_time = F.floor(BATCHES * (us - lo) / F.lit(hi - lo + 1)) if lo is not None else F.lit(0)
    return rows.withColumn("batch", F.least(F.lit(BATCHES - 1), on_time + F.when(F.col("frame_idx") % 40 == 0, 2).otherwise(0)))


def _replayed_counts(spark: SparkSession, d: str) -> T.Replayed:
    return T.replay(_arrivals(spark, d), "batch", BATCHES, lambda stream: T.window_counts(stream, "6 hours", f"{LATE_H} hours"))


def _open(found: T.Replayed) -> DataFrame:
    return found.state.select("key.video_id", "key.class_name", F.unix_timestamp("key.window.start").alias("window_start"), F.col("value.count").alias("n"))


SIX_H = 6 * 3600 * 1_000_000


@query(
    "t2_append_windows",
    sql(
        f"WITH {LATE} SELECT video_id, class_name, (us // {SIX_H} * {SIX_H} // 1000000)::BIGINT AS window_start, count(*) AS n, us // {SIX_H} * {SIX_H} + {SIX_H} <= last AS closed FROM a WHERE us // {SIX_H} * {SIX_H} + {SIX_H} > before GROUP BY ALL",
        "frame_detections",
    ),
)
def t2_append(spark: SparkSession, d: str) -> DataFrame:
    """Windows that a stream in append mode has closed, and those that its state still holds; late rows are in neither."""
    found = _replayed_counts(spark, d)
    return found.rows.withColumn("closed", F.lit(True)).unionByName(_open(found).withColumn("closed", F.lit(False)))


@query(
    "t2_late_rows",
    sql(
        f"WITH {LATE}, w AS (SELECT us // {SIX_H} * {SIX_H} + {SIX_H} AS stop, before, last FROM a) SELECT count(*) AS n_read, count_if(stop > before AND stop <= last) AS n_closed, count_if(stop > before AND stop > last) AS n_open, count_if(stop <= before) AS n_late FROM w",
        "frame_detections",
    ),
)
def t2_late(spark: SparkSession, d: str) -> DataFrame:
    """How many rows a stream read, closed, still holds and dropped as late."""
    found = _replayed_counts(spark, d)
    rows = found.rows.select("n", F.lit(True).alias("closed")).union(_open(found).select("n", F.lit(False)))
    of = lambda closed, name: F.coalesce(F.sum(F.when(F.col("closed") == closed, F.col("n"))), F.lit(0)).alias(name)
    counts = rows.agg(of(True, "n_closed"), of(False, "n_open"))
    n = F.lit(found.n_read).cast("bigint")
    return counts.select(n.alias("n_read"), "n_closed", "n_open", (n - F.col("n_closed") - F.col("n_open")).alias("n_late"))


HOUR, DAY = 3_600_000_000, 86_400_000_000


@query(
    "t3_video_windows",
    sql(
        f"""WITH {LATE}, f AS (SELECT video_id, us // {HOUR} AS hour, frame_idx // 50 AS frame_idx, any_value(last) AS last, count(*) AS n, sum(conf) AS conf_sum, min(conf) AS lo, max(conf) AS hi FROM a WHERE us // {HOUR} * {HOUR} + {HOUR} > before GROUP BY 1, 2, 3)
SELECT video_id, (hour * {HOUR} // {DAY} * {DAY} // 1000000)::BIGINT AS window_start, sum(n)::BIGINT AS total, count(*) AS n_frames, max(n) AS peak, round(sum(conf_sum) / sum(n), 9) AS mean_conf, min(lo) AS min_conf, max(hi) AS max_conf
FROM f WHERE hour * {HOUR} // {DAY} * {DAY} + {DAY} <= last GROUP BY 1, 2""",
        "frame_detections",
    ),
)
def t3_windows(spark: SparkSession, d: str) -> DataFrame:
    """Each video's statistics by day, final in append mode, from frames of an hour that are closed before."""
    frames = _arrivals(spark, d).withColumn("frame_idx", F.floor(F.col("frame_idx") / 50))
    found = T.replay(frames, "batch", BATCHES, lambda stream: T.video_windows(stream, "1 day", f"{LATE_H} hours", "1 hour"))
    return found.rows.withColumn("mean_conf", F.round("mean_conf", 9))
