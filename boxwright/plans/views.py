"""The canonical tables as views over the driver's star schema, in Spark and in SQL.

Each view is one SQL text that both engines run; ``frame`` gives the Spark
DataFrame, ``sql`` a query text with the views it needs in front.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from boxwright.session import spread

VIEWS = {
    "gt_boxes": """
SELECT image_id, CAST(gt_idx AS BIGINT) AS gt_idx, class_id, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1,
       CAST(x1 + w AS DOUBLE) AS x2, CAST(y1 + h AS DOUBLE) AS y2
FROM (SELECT l_orderkey AS image_id,
        ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS gt_idx,
        CAST(l_partkey % 6 AS INT) AS class_id,
        16 + (l_partkey * 7) % 240 AS w, 16 + (l_suppkey * 13 + l_linenumber * 29) % 180 AS h,
        (l_partkey * 37 + l_linenumber * 101) % 1024 AS x1, (l_partkey * 53 + l_suppkey * 17) % 524 AS y1
      FROM {lineitem}) b""",
    "predictions": """
SELECT image_id, gt_idx AS pred_idx, CASE WHEN k % 13 = 0 THEN (class_id + 1) % 6 ELSE class_id END AS class_id,
  CAST((k * 7919) % 1000 AS DOUBLE) / 1000 AS conf,
  x1 + CASE WHEN k % 5 = 0 THEN (x2 - x1) * CAST(0.5 AS DOUBLE) ELSE k % 4 END AS x1, y1 + k % 3 AS y1,
  x2 + CASE WHEN k % 5 = 0 THEN (x2 - x1) * CAST(0.5 AS DOUBLE) ELSE k % 4 END AS x2, y2 + k % 3 AS y2
FROM (SELECT *, image_id * 31 + gt_idx * 17 AS k FROM {gt_boxes} g0) g WHERE k % 7 <> 0""",
    "images": """
SELECT o_orderkey AS image_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'foggy' WHEN '2-HIGH' THEN 'rainy' WHEN '3-MEDIUM' THEN 'snowy' WHEN '4-NOT SPECIFIED' THEN 'clear' ELSE 'undefined' END AS weather_raw,
  CASE o_custkey % 3 WHEN 0 THEN 'night' WHEN 1 THEN 'dawn/dusk' ELSE 'daytime' END AS timeofday,
  CASE o_orderstatus WHEN 'F' THEN 'xwod' WHEN 'O' THEN 'bdd' ELSE 'acdc' END AS source,
  1280 AS width, 720 AS height,
  CONCAT('/data/', CASE o_custkey % 5 WHEN 0 THEN 'Fog' WHEN 1 THEN 'heavy_rain' WHEN 2 THEN 'Dusty' WHEN 3 THEN 'SNOWY' ELSE 'plain' END,
         '/images/train/', CAST(o_orderkey AS VARCHAR(20)), '.jpg') AS image_path
FROM {orders}""",
    "raw_boxes": """
SELECT g.image_id, g.gt_idx,
  CASE (g.image_id + g.gt_idx) % 10 WHEN 0 THEN ' Person' WHEN 1 THEN 'rider' WHEN 2 THEN 'BIKE' WHEN 3 THEN 'car' WHEN 4 THEN 'motor'
    WHEN 5 THEN 'bus' WHEN 6 THEN 'truck ' WHEN 7 THEN 'traffic light' WHEN 8 THEN 'train' ELSE '' END AS category,
  x1 - 40 AS x1, y1 - 20 AS y1, CASE WHEN g.image_id % 17 = 0 THEN x1 - 60 ELSE x2 + 40 END AS x2, y2 + 60 AS y2
FROM {gt_boxes} g""",
    "frame_detections": """
SELECT user_id AS video_id, event_id AS frame_idx, ts AS event_time,
  CASE event_type WHEN 'click' THEN 'person' WHEN 'view' THEN 'car' WHEN 'purchase' THEN 'bus' WHEN 'signup' THEN 'truck' ELSE 'bicycle' END AS class_name,
  CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000 AS conf
FROM {events}""",
    "run_metrics": """
SELECT s_name AS run, s_nationkey AS config_id, CAST(s_suppkey % 3 AS INT) AS seed,
  CAST((s_suppkey * 37) % 100 AS DOUBLE) / 100 AS precision_v, CAST((s_suppkey * 53) % 100 AS DOUBLE) / 100 AS recall_v,
  CAST((s_suppkey * 71) % 100 AS DOUBLE) / 100 AS map50, CAST((s_suppkey * 29) % 100 AS DOUBLE) / 200 AS map50_95
FROM {supplier}""",
    "history": """
SELECT l_suppkey % 20 AS run_id, CAST(l_partkey % 60 AS INT) AS epoch, CAST(SUM((l_partkey * 31 + l_suppkey * 17) % 500) % 1000 AS DOUBLE) / 1000 AS map50_95
FROM {lineitem} GROUP BY l_suppkey % 20, CAST(l_partkey % 60 AS INT)""",
    "mask_runs": """
SELECT l_orderkey AS image_id, CAST(l_linenumber * 10 + l_partkey % 10 AS INT) AS y, CAST(l_partkey % 900 AS INT) AS x_start,
  CAST(l_partkey % 900 + 5 + l_suppkey % 40 AS INT) AS x_end,
  CASE WHEN l_suppkey % 4 = 0 THEN 24 + l_partkey % 10 ELSE (24 + l_partkey % 10) * 1000 + l_suppkey % 3 END AS segment_id
FROM {lineitem}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def _needs(name: str) -> list[str]:
    """The views that a view stands on, itself last."""
    out: list[str] = []
    for part in _NAME.findall(VIEWS[name]):
        if part in VIEWS:
            out += [x for x in _needs(part) if x not in out]
    return [*out, name]


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; views of views are nested, so that Spark prunes and pushes through them."""
    tables: dict[str, DataFrame] = {}
    for part in dict.fromkeys(_NAME.findall(VIEWS[name])):
        if part not in VIEWS:
            spread(spark, f"{sf_dir}/{part}.parquet")
        tables[part] = frame(spark, sf_dir, part) if part in VIEWS else spark.read.parquet(f"{sf_dir}/{part}.parquet")
    return spark.sql(VIEWS[name], **tables)


def sql(body: str, *names: str) -> str:
    """A query over the named views; further WITH parts may follow in ``body`` after "WITH"."""
    order: list[str] = []
    for name in names:
        order += [x for x in _needs(name) if x not in order]
    ctes = ",\n".join(f"{n} AS ({_NAME.sub(lambda m: m[1], VIEWS[n])})" for n in order)
    body = body.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    rest = re.sub(r"^WITH\s+(RECURSIVE\s+)?", ",\n", body, flags=re.I) if body.upper().startswith("WITH") else "\n" + body
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{rest}"
