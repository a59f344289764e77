"""Reports over training and evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: columns that runs are compared by
COMPARED = ("precision", "recall", "map50", "map50_95", "inference_ms", "fps", "inference_ms_batch1", "fps_batch1")


def leaderboard(runs: DataFrame, by: str = "map50_95", id_col: str = "run") -> DataFrame:
    """Runs, best first, with their place; runs without a value last."""
    w = Window.orderBy(F.desc_nulls_last(by), id_col)  # a row for each run
    return runs.withColumn("place", F.row_number().over(w))


def baseline_deltas(runs: DataFrame, baseline: str, columns: tuple[str, ...] = COMPARED, id_col: str = "run") -> DataFrame:
    """Each run's difference to the baseline, and the relative one in per cent where the baseline isn't 0.

    Columns that the table lacks are skipped; a missing baseline is an error.
    """
    base = runs.filter(F.col(id_col) == baseline).limit(1).collect()
    if not base:
        raise ValueError(f"no run {baseline!r}")
    out = {}
    for c in columns:
        if c in runs.columns:
            b = base[0][c]
            delta = F.col(c) - F.lit(b).cast("double")
            out[f"{c}_delta"] = delta
            out[f"{c}_delta_pct"] = delta / F.lit(b).cast("double") * 100 if b else F.lit(None).cast("double")
    return runs.withColumns(out)


def seed_statistics(runs: DataFrame, by: str, columns: tuple[str, ...]) -> DataFrame:
    """A10: mean, sample deviation (0 for one run), least, most and number of each metric over a config's seeds."""
    stack = ", ".join(f"'{c}', {c}" for c in columns)
    long = runs.select(by, F.expr(f"stack({len(columns)}, {stack}) AS (metric, value)"))
    return long.groupBy(by, "metric").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"),
    )


def choose(runs: DataFrame, order: tuple[str, ...] = ("-map50_95", "-recall", "-fps", "parameters"), id_col: str = "run") -> DataFrame:
    """Rank by several keys, ``-`` for falling order."""
    keys = [F.desc_nulls_last(c[1:]) if c[0] == "-" else F.asc_nulls_last(c) for c in order]
    return runs.withColumn("choice", F.rank().over(Window.orderBy(*keys)))


def early_stop(history: DataFrame, patience: int, run_col: str = "run_id", metric: str = "map50_95") -> DataFrame:
    """Running best, epochs since it was made (strictly greater) and whether training would have stopped by then."""
    w = Window.partitionBy(run_col).orderBy("epoch")
    before = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = F.col(metric) > F.coalesce(before, F.lit(float("-inf")))
    marked = history.withColumns({"best": F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(w), "is_best": better})
    last = F.max(F.when(F.col("is_best"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    counted = marked.withColumn("since_best", F.col("_n") - last)
    return counted.withColumn("stopped", F.max((F.col("since_best") >= patience).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_n")


def best_epochs(history: DataFrame, patience: int, run_col: str = "run_id", metric: str = "map50_95") -> DataFrame:
    """The epoch whose weights would be kept, its value, and the epoch at which training stops (null: it doesn't)."""
    marked = early_stop(history, patience, run_col, metric)
    w = Window.partitionBy(run_col).orderBy("epoch")
    lagged = marked.withColumn("_over", F.coalesce(F.lag("stopped").over(w), F.lit(False))).filter("not _over")
    return lagged.groupBy(run_col).agg(
        F.max_by("epoch", F.when(F.col("is_best"), F.col("epoch"))).alias("best_epoch"), F.max(metric).alias("best"), F.min(F.when(F.col("stopped"), F.col("epoch"))).alias("stop_epoch")
    )
