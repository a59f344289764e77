"""Streams in append mode over several batches with late rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from boxwright.streaming import frames

BEGAN = datetime.datetime(2024, 1, 1)
#: batch, minute; in batch 2 minute 12 is late, in batch 3 minute 31, in batch 4 all but the last
ROWS = [(0, 5), (0, 15), (1, 25), (1, 65), (2, 12), (2, 42), (2, 70), (3, 31), (3, 59), (3, 130), (4, 10), (4, 75), (4, 95), (4, 200)]


@pytest.fixture(scope="module")
def arrivals(spark):
    rows = [(b, 1, m // 10, BEGAN + datetime.timedelta(minutes=m), m / 1000, "car") for b, m in ROWS]
    return spark.createDataFrame(rows, "batch int, video_id bigint, frame_idx bigint, event_time timestamp, conf double, class_name string")


def minutes(column):
    return ((F.col(column) - F.lit(BEGAN.replace(tzinfo=datetime.UTC).timestamp())) / 60).cast("int")


def test_late_rows_are_dropped_and_closed_windows_leave_the_state(arrivals):
    found = frames.replay(arrivals, "batch", 5, lambda s: frames.window_counts(s, "10 minutes", "20 minutes"))
    got = sorted(tuple(r) for r in found.rows.select(minutes("window_start"), "n").collect())
    assert got == [(0, 1), (10, 1), (20, 1), (40, 1), (50, 1), (60, 1), (70, 1), (130, 1)]
    assert found.n_read == len(ROWS) and max(found.n_state) <= 2
    assert [r[0] for r in found.state.select("value.count").collect()] == [1]  # minute 200 is still open


def test_two_aggregations_in_append_mode(arrivals):
    found = frames.replay(arrivals, "batch", 5, lambda s: frames.video_windows(s, "60 minutes", "20 minutes", "10 minutes"))
    got = sorted(tuple(r) for r in found.rows.select(minutes("window_start"), "total", "n_frames", "peak", "min_conf", "max_conf").collect())
    assert got == [(0, 5, 5, 1, 0.005, 0.059), (60, 2, 2, 1, 0.065, 0.07), (120, 1, 1, 1, 0.13, 0.13)]
    assert max(found.n_state) <= 4
