"""Queries of detection evaluation: matching, metrics, error analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.functions.geometry import Box, area, iou, size_bucket
from boxwright.functions.vocab import normalize_weather
from boxwright.operators import errors, matching, metrics
from boxwright.plans.registry import query
from boxwright.plans.views import frame, sql


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return frame(spark, d, "predictions"), frame(spark, d, "gt_boxes")


IOU = """greatest(0, least(p.x2,g.x2)-greatest(p.x1,g.x1)) * greatest(0, least(p.y2,g.y2)-greatest(p.y1,g.y1))
    / greatest((p.x2-p.x1)*(p.y2-p.y1) + (g.x2-g.x1)*(g.y2-g.y1)
    - greatest(0, least(p.x2,g.x2)-greatest(p.x1,g.x1)) * greatest(0, least(p.y2,g.y2)-greatest(p.y1,g.y1)), 1e-9)"""
PAIRS = f"""pairs AS (SELECT p.image_id, p.pred_idx, g.gt_idx, p.conf, p.class_id AS pc, g.class_id AS gc, {IOU} AS iou
  FROM predictions p JOIN gt_boxes g USING (image_id))"""
GREEDY = """
c AS (SELECT image_id, pred_idx, conf, list(gt_idx ORDER BY iou DESC, gt_idx) AS gs FROM pairs WHERE iou >= 0.5 AND pc = gc GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, pred_idx) AS k FROM c),
w AS (SELECT image_id, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS pred_idx, NULL::BIGINT AS gt_idx FROM (SELECT DISTINCT image_id FROM r)
      UNION ALL
      SELECT w.image_id, r.k, CASE WHEN x.g IS NULL THEN w.used ELSE list_append(w.used, x.g) END, r.pred_idx, x.g
      FROM w JOIN r ON r.image_id = w.image_id AND r.k = w.k + 1,
           LATERAL (SELECT list_filter(r.gs, lambda v: NOT list_contains(w.used, v))[1] AS g) x),
m AS (SELECT image_id, pred_idx, gt_idx FROM w WHERE gt_idx IS NOT NULL)"""
M1 = f"WITH RECURSIVE {PAIRS}, {GREEDY}"
ERRORS = f"""{M1},
hit AS (SELECT m.image_id, m.pred_idx, m.gt_idx, pairs.iou, pairs.gc AS cls FROM m JOIN pairs USING (image_id, pred_idx, gt_idx)),
best AS (SELECT image_id, pred_idx, arg_min(gc, (-iou, gt_idx)) AS gc, max(iou) AS iou, arg_min(gt_idx, (-iou, gt_idx)) AS gt_idx FROM pairs WHERE iou > 0 GROUP BY image_id, pred_idx),
e AS (
  SELECT h.image_id, h.pred_idx, h.gt_idx, h.cls AS class_id, CASE WHEN h.iou >= 0.75 THEN 'true_positive' ELSE 'loose_box' END AS error_type, h.iou, p.conf, (g.x2-g.x1)*(g.y2-g.y1) AS area
  FROM hit h JOIN predictions p USING (image_id, pred_idx) JOIN gt_boxes g ON g.image_id = h.image_id AND g.gt_idx = h.gt_idx
  UNION ALL
  SELECT p.image_id, p.pred_idx, b.gt_idx, p.class_id,
    CASE WHEN b.iou >= 0.5 AND b.gc <> p.class_id THEN 'wrong_class' WHEN b.iou >= 0.1 AND b.iou < 0.5 AND b.gc = p.class_id THEN 'poor_localization' ELSE 'false_positive' END,
    coalesce(b.iou, 0), p.conf, (p.x2-p.x1)*(p.y2-p.y1)
  FROM predictions p ANTI JOIN m USING (image_id, pred_idx) LEFT JOIN best b ON b.image_id = p.image_id AND b.pred_idx = p.pred_idx
  UNION ALL
  SELECT g.image_id, NULL, g.gt_idx, g.class_id, 'missed_object', NULL, NULL, (g.x2-g.x1)*(g.y2-g.y1) FROM gt_boxes g ANTI JOIN m USING (image_id, gt_idx)),
s AS (SELECT *, CASE WHEN area < 1024 THEN 'small' WHEN area < 9216 THEN 'medium' ELSE 'large' END AS size_bucket,
  ['person','bicycle','car','motorcycle','bus','truck'][class_id + 1] AS class_name FROM e)"""
COUNTS = ", ".join(f"count_if(error_type = '{t}')::BIGINT AS {t}" for t in errors.ERROR_TYPES)
BASE = ("predictions", "gt_boxes")


@query("f18_size_buckets", sql("SELECT CASE WHEN a < 1024 THEN 'small' WHEN a < 9216 THEN 'medium' ELSE 'large' END AS size_bucket, count(*) AS n FROM (SELECT (x2-x1)*(y2-y1) AS a FROM gt_boxes) GROUP BY 1", "gt_boxes"))
def f18(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "gt_boxes").groupBy(size_bucket(area(Box.of())).alias("size_bucket")).agg(F.count("*").alias("n"))


@query("f19_iou_pairs", sql(f"WITH {PAIRS} SELECT image_id, pred_idx, gt_idx, round(iou, 6) AS iou FROM pairs WHERE iou > 0", *BASE))
def f19(spark: SparkSession, d: str) -> DataFrame:
    return matching.pairs(*_tables(spark, d)).select("image_id", "pred_idx", "gt_idx", F.round("iou", 6).alias("iou"))


@query("j9_best_pairs", sql(f"WITH {PAIRS} SELECT image_id, pred_idx, arg_min(gt_idx, (-iou, gt_idx)) AS gt_idx, round(max(iou), 6) AS iou FROM pairs WHERE iou > 0 GROUP BY 1, 2", *BASE))
def j9(spark: SparkSession, d: str) -> DataFrame:
    return matching.best_box(matching.pairs(*_tables(spark, d))).select("image_id", "pred_idx", "gt_idx", F.round("iou", 6).alias("iou"))


@query("m1_greedy_match", sql(f"{M1} SELECT image_id, pred_idx, gt_idx FROM m", *BASE))
def m1(spark: SparkSession, d: str) -> DataFrame:
    return matching.greedy(*_tables(spark, d))


@query(
    "m2_precision_recall",
    sql(
        f"""WITH RECURSIVE {PAIRS.replace("FROM predictions p", "FROM (SELECT * FROM predictions WHERE conf >= 0.25) p")}, {GREEDY},
n AS (SELECT (SELECT count(*) FROM m) AS tp, (SELECT count(*) FROM predictions WHERE conf >= 0.25) AS p, (SELECT count(*) FROM gt_boxes) AS g)
SELECT tp, p - tp AS fp, g - tp AS fn, round(tp / p, 6) AS precision, round(tp / g, 6) AS recall FROM n""",
        *BASE,
    ),
)
def m2(spark: SparkSession, d: str) -> DataFrame:
    return metrics.precision_recall(*_tables(spark, d)).withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


ARGMAX = """b AS (SELECT image_id, pred_idx, conf, pc, arg_min(gt_idx, (-iou, gt_idx)) AS gt_idx, arg_min(gc, (-iou, gt_idx)) AS gc, max(iou) AS iou FROM pairs GROUP BY 1, 2, 3, 4),
o AS (SELECT image_id, gt_idx, arg_min(pred_idx, (-conf, pred_idx)) AS pred_idx, arg_min(pc, (-conf, pred_idx)) AS pc, any_value(gc) AS gc FROM b WHERE iou >= 0.5 GROUP BY 1, 2)"""


@query("m3_argmax_match", sql(f"WITH {PAIRS}, {ARGMAX} SELECT image_id, pred_idx, gt_idx FROM o", *BASE))
def m3(spark: SparkSession, d: str) -> DataFrame:
    return matching.argmax(*_tables(spark, d)).select("image_id", "pred_idx", "gt_idx")


CONFUSION = f"""WITH kept AS (SELECT * FROM predictions WHERE conf >= 0.25), {PAIRS.replace("FROM predictions p", "FROM kept p")}, {ARGMAX},
x AS (SELECT gc AS true_class, pc AS pred_class FROM o
  UNION ALL SELECT -1, k.class_id FROM kept k ANTI JOIN o USING (image_id, pred_idx)
  UNION ALL SELECT g.class_id, -1 FROM gt_boxes g ANTI JOIN o USING (image_id, gt_idx)),
n AS (SELECT true_class::INT AS true_class, pred_class::INT AS pred_class, count(*) AS n FROM x GROUP BY 1, 2)"""


@query("a16_confusion_matrix", sql(f"{CONFUSION} SELECT true_class, pred_class, n, round(n / (sum(n) OVER (PARTITION BY true_class) + 1e-9), 6) AS share FROM n", *BASE))
def a16(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    table = matching.confusion(*_tables(spark, d))
    return table.withColumn("share", F.round(F.col("n") / (F.sum("n").over(Window.partitionBy("true_class")) + 1e-9), 6))


FLAGS = f"""WITH {PAIRS},
b AS (SELECT image_id, pred_idx, conf, pc, arg_min(gt_idx, (-iou, gt_idx)) AS gt_idx, max(iou) AS iou FROM pairs WHERE pc = gc GROUP BY 1, 2, 3, 4),
o AS (SELECT image_id, gt_idx, arg_min(pred_idx, (-conf, pred_idx)) AS pred_idx FROM b WHERE iou >= 0.5 GROUP BY 1, 2),
t AS (SELECT class_id, count(*) AS n_gt FROM gt_boxes GROUP BY 1),
f AS (SELECT p.image_id, p.pred_idx, p.class_id, p.conf, t.n_gt, CASE WHEN o.gt_idx IS NULL THEN 0 ELSE 1 END AS tp
  FROM predictions p JOIN t USING (class_id) LEFT JOIN o ON o.image_id = p.image_id AND o.pred_idx = p.pred_idx),
c AS (SELECT *, sum(tp) OVER w AS cum_tp, count(*) OVER w AS cum_n FROM f WINDOW w AS (PARTITION BY class_id ORDER BY conf DESC, image_id, pred_idx ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT *, cum_tp / (n_gt + 1e-9) AS recall, cum_tp / (cum_n + 1e-9) AS precision FROM c)"""


@query("m4_class_flags", sql(f"{FLAGS} SELECT image_id, pred_idx, class_id, tp FROM f", *BASE))
def m4(spark: SparkSession, d: str) -> DataFrame:
    return metrics.flagged(*_tables(spark, d)).select("image_id", "pred_idx", "class_id", "tp")


@query(
    "m5_average_precision",
    sql(
        f"""{FLAGS},
e AS (SELECT class_id, cum_n, recall, max(precision) OVER (PARTITION BY class_id ORDER BY cum_n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env,
  coalesce(lag(recall) OVER (PARTITION BY class_id ORDER BY cum_n), 0) AS before FROM pr)
SELECT class_id, round(sum((recall - before) * env), 6) AS ap FROM e GROUP BY 1""",
        *BASE,
    ),
)
def m5(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(metrics.flagged(*_tables(spark, d))).withColumn("ap", F.round("ap", 6))


@query("m6_pr_curve", sql(f"{FLAGS} SELECT image_id, pred_idx, class_id, round(recall, 6) AS recall, round(precision, 6) AS precision FROM pr", *BASE))
def m6(spark: SparkSession, d: str) -> DataFrame:
    return metrics.curve(metrics.flagged(*_tables(spark, d))).select("image_id", "pred_idx", "class_id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


def _coco_sql(group: str, join: str) -> str:
    """Greedy matching at ten thresholds by a recursion over ranks, then 101 recall points."""
    return f"""WITH RECURSIVE ts AS (SELECT unnest([0.5,0.55,0.6,0.65,0.7,0.75,0.8,0.85,0.9,0.95]::DOUBLE[]) AS t),
tagged AS (SELECT p.*, {group} AS grp FROM predictions p {join.format(t="p")}),
top AS (SELECT * FROM tagged QUALIFY row_number() OVER (PARTITION BY image_id, class_id ORDER BY conf DESC, pred_idx) <= 100),
gt AS (SELECT g.*, {group} AS grp FROM gt_boxes g {join.format(t="g")}),
tot AS (SELECT grp, class_id, count(*) AS n_gt FROM gt GROUP BY 1, 2),
pairs AS (SELECT p.image_id, p.class_id, p.pred_idx, g.gt_idx, p.conf, {IOU} AS iou FROM top p JOIN gt_boxes g USING (image_id, class_id)),
c AS (SELECT image_id, class_id, t, pred_idx, conf, list(gt_idx ORDER BY iou DESC, gt_idx) AS gs FROM pairs JOIN ts ON iou >= t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, class_id, t ORDER BY conf DESC, pred_idx) AS k FROM c),
w AS (SELECT image_id, class_id, t, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS pred_idx, NULL::BIGINT AS gt_idx FROM (SELECT DISTINCT image_id, class_id, t FROM r)
      UNION ALL
      SELECT w.image_id, w.class_id, w.t, r.k, CASE WHEN x.g IS NULL THEN w.used ELSE list_append(w.used, x.g) END, r.pred_idx, x.g
      FROM w JOIN r ON r.image_id = w.image_id AND r.class_id = w.class_id AND r.t = w.t AND r.k = w.k + 1,
           LATERAL (SELECT list_filter(r.gs, lambda v: NOT list_contains(w.used, v))[1] AS g) x),
f AS (SELECT top.grp, top.class_id, ts.t, top.conf, top.image_id, top.pred_idx, tot.n_gt, CASE WHEN w.gt_idx IS NULL THEN 0 ELSE 1 END AS tp
  FROM top CROSS JOIN ts JOIN tot ON tot.grp = top.grp AND tot.class_id = top.class_id
  LEFT JOIN w ON w.image_id = top.image_id AND w.pred_idx = top.pred_idx AND w.t = ts.t AND w.gt_idx IS NOT NULL),
cum AS (SELECT *, sum(tp) OVER o AS ct, count(*) OVER o AS cn FROM f WINDOW o AS (PARTITION BY grp, class_id, t ORDER BY conf DESC, image_id, pred_idx ROWS UNBOUNDED PRECEDING)),
st AS (SELECT grp, class_id, t, ((100 * ct) // n_gt)::INT AS k, max(ct / cn) AS p FROM cum WHERE tp = 1 GROUP BY ALL),
gr AS (SELECT grp, class_id, ts.t, k FROM tot CROSS JOIN ts CROSS JOIN range(101) q(k)),
ap AS (SELECT gr.grp, gr.class_id, gr.t, gr.k, coalesce(max(st.p), 0) AS p FROM gr LEFT JOIN st ON st.grp = gr.grp AND st.class_id = gr.class_id AND st.t = gr.t AND st.k >= gr.k GROUP BY ALL),
av AS (SELECT grp, class_id, t, avg(p) AS ap FROM ap GROUP BY ALL),
ar AS (SELECT tot.grp, tot.class_id, ts.t, coalesce(max(ct), 0) / any_value(tot.n_gt) AS ar FROM tot CROSS JOIN ts LEFT JOIN cum ON cum.grp = tot.grp AND cum.class_id = tot.class_id AND cum.t = ts.t GROUP BY ALL)
"""


M7_END = "SELECT grp, class_id::INT AS class_id, t AS threshold, round(ap, 6) AS ap, round(ar, 6) AS ar FROM av JOIN ar USING (grp, class_id, t)"
SUM_END = "SELECT grp, round(avg(ap) FILTER (t = 0.5), 6) AS map50, round(avg(ap), 6) AS map50_95, round(avg(ar), 6) AS mar_100 FROM av JOIN ar USING (grp, class_id, t) GROUP BY grp"
WEATHER_SQL = "CASE i.weather_raw WHEN 'foggy' THEN 'fog' WHEN 'rainy' THEN 'rain' WHEN 'snowy' THEN 'snow' ELSE i.weather_raw END"
BY_IMAGE = "JOIN images i ON i.image_id = {t}.image_id"


@query("m7_coco_ap", sql(_coco_sql("'all'", "") + M7_END, *BASE))
def m7(spark: SparkSession, d: str) -> DataFrame:
    return metrics.coco(*_tables(spark, d)).withColumns({"ap": F.round("ap", 6), "ar": F.round("ar", 6)})


@query("m7_coco_summary", sql(_coco_sql("'all'", "") + SUM_END, *BASE))
def m7_summary(spark: SparkSession, d: str) -> DataFrame:
    table = metrics.coco_summary(metrics.coco(*_tables(spark, d)))
    return table.select("grp", *[F.round(c, 6).alias(c) for c in ("map50", "map50_95", "mar_100")])


@query(
    "m8_ap_by_class_name",
    sql(
        f"""{FLAGS},
e AS (SELECT class_id, cum_n, recall, max(precision) OVER (PARTITION BY class_id ORDER BY cum_n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env,
  coalesce(lag(recall) OVER (PARTITION BY class_id ORDER BY cum_n), 0) AS before FROM pr),
a AS (SELECT class_id, round(sum((recall - before) * env), 6) AS ap FROM e GROUP BY 1)
SELECT n.class_name, a.ap FROM (VALUES (0,'person'),(1,'bicycle'),(2,'car'),(3,'motorcycle'),(4,'bus'),(5,'truck')) n(class_id, class_name) LEFT JOIN a USING (class_id)""",
        *BASE,
    ),
)
def m8(spark: SparkSession, d: str) -> DataFrame:
    return metrics.by_class_name(m5(spark, d))


def _weather_images(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "images").select("image_id", normalize_weather(F.col("weather_raw")).alias("weather"))


@query("m9_coco_by_weather", sql(_coco_sql(WEATHER_SQL, BY_IMAGE) + SUM_END, *BASE, "images"))
def m9(spark: SparkSession, d: str) -> DataFrame:
    table = metrics.coco_summary(metrics.coco(*_tables(spark, d), images=_weather_images(spark, d), by="weather"))
    return table.select("grp", *[F.round(c, 6).alias(c) for c in ("map50", "map50_95", "mar_100")])


M9_TABLE = f"""{_coco_sql(WEATHER_SQL, BY_IMAGE).rstrip()},
z AS ({SUM_END}),
h AS (SELECT grp, count(*) AS tp FROM f WHERE t = 0.5 AND tp = 1 AND conf >= 0.25 GROUP BY 1), np AS (SELECT grp, count(*) AS n FROM tagged WHERE conf >= 0.25 GROUP BY 1), ng AS (SELECT grp, count(*) AS n FROM gt GROUP BY 1),
im AS (SELECT {WEATHER_SQL} AS grp, count(*) AS images FROM images i GROUP BY 1)
SELECT im.grp, im.images, round(coalesce(tp / np.n, 0), 6) AS precision, round(coalesce(tp / ng.n, 0), 6) AS recall, coalesce(map50, 0) AS map50, coalesce(map50_95, 0) AS map50_95, coalesce(mar_100, 0) AS mar_100
FROM im LEFT JOIN h USING (grp) LEFT JOIN np USING (grp) LEFT JOIN ng USING (grp) LEFT JOIN z USING (grp)"""


@query("m9_weather_table", sql(M9_TABLE, *BASE, "images"))
def m9_table(spark: SparkSession, d: str) -> DataFrame:
    table = metrics.table_by_group(*_tables(spark, d), _weather_images(spark, d), "weather")
    return table.select("grp", "images", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "map50", "map50_95", "mar_100")])


NMS = """WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY conf DESC, pred_idx) AS k FROM predictions),
w AS (SELECT image_id, class_id, 0::BIGINT AS k, []::STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[] AS kept, NULL::BIGINT AS pred_idx, false AS ok FROM (SELECT DISTINCT image_id, class_id FROM r)
  UNION ALL
  SELECT w.image_id, w.class_id, r.k, CASE WHEN z.ok THEN list_append(w.kept, {'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}) ELSE w.kept END, r.pred_idx, z.ok
  FROM w JOIN r ON r.image_id = w.image_id AND r.class_id = w.class_id AND r.k = w.k + 1,
  LATERAL (SELECT len(list_filter(w.kept, lambda b: greatest(0, least(b.x2,r.x2)-greatest(b.x1,r.x1)) * greatest(0, least(b.y2,r.y2)-greatest(b.y1,r.y1))
    > 0.3 * greatest((b.x2-b.x1)*(b.y2-b.y1) + (r.x2-r.x1)*(r.y2-r.y1) - greatest(0, least(b.x2,r.x2)-greatest(b.x1,r.x1)) * greatest(0, least(b.y2,r.y2)-greatest(b.y1,r.y1)), 1e-9))) = 0 AS ok) z)
SELECT image_id, class_id, pred_idx FROM w WHERE ok"""


@query("m10_non_maximum_suppression", sql(NMS, "predictions"))
def m10(spark: SparkSession, d: str) -> DataFrame:
    return matching.suppress(frame(spark, d, "predictions"), 0.3).select("image_id", "class_id", "pred_idx")


def _errors(spark: SparkSession, d: str) -> DataFrame:
    return errors.error_table(*_tables(spark, d))


@query(
    "e4_error_table",
    sql(f"{ERRORS} SELECT image_id, pred_idx, gt_idx, class_id, class_name, error_type, round(iou, 6) AS iou, conf, floor(area)::BIGINT AS box_area, size_bucket FROM s", *BASE),
)
def e4(spark: SparkSession, d: str) -> DataFrame:
    return _errors(spark, d).select("image_id", "pred_idx", "gt_idx", "class_id", "class_name", "error_type", F.round("iou", 6).alias("iou"), "conf", "box_area", "size_bucket")


for _name, _kinds in (("e1_matches", ("true_positive", "loose_box")), ("e2_false_predictions", ("wrong_class", "poor_localization", "false_positive")), ("e3_missed_objects", ("missed_object",))):
    _list = ", ".join(f"'{k}'" for k in _kinds)

    @query(_name, sql(f"{ERRORS} SELECT image_id, pred_idx, gt_idx, error_type FROM s WHERE error_type IN ({_list})", *BASE))
    def _some(spark: SparkSession, d: str, kinds: tuple[str, ...] = _kinds) -> DataFrame:
        return _errors(spark, d).filter(F.col("error_type").isin(*kinds)).select("image_id", "pred_idx", "gt_idx", "error_type")


@query("a17_totals_by_weather", sql(f"{ERRORS} SELECT {WEATHER_SQL} AS weather, count_if(error_type IN ('true_positive', 'loose_box')) / nullif(count_if(pred_idx IS NOT NULL), 0) AS precision FROM s JOIN images i USING (image_id) GROUP BY 1".replace("count_if(error_type IN", "round(count_if(error_type IN").replace("0) AS precision", "0), 6) AS precision"), *BASE, "images"))
def a17(spark: SparkSession, d: str) -> DataFrame:
    found = F.count_if(F.col("error_type").isin("true_positive", "loose_box"))
    return _errors(spark, d).join(_weather_images(spark, d), "image_id").groupBy("weather").agg(F.round(found / F.nullif(F.count("pred_idx"), F.lit(0)), 6).alias("precision"))


@query("a18_error_by_class", sql(f"{ERRORS}, n AS (SELECT class_id, class_name, {COUNTS} FROM s GROUP BY 1, 2) SELECT *, true_positive + loose_box + missed_object AS n_gt, round(coalesce((true_positive + loose_box) / nullif(true_positive + loose_box + missed_object, 0), 0), 4) AS recall FROM n", *BASE))
def a18(spark: SparkSession, d: str) -> DataFrame:
    return errors.by_class(_errors(spark, d))


@query("a19_recall_by_size", sql(f"{ERRORS}, n AS (SELECT size_bucket, count(*) AS n_gt, count_if(error_type <> 'missed_object')::BIGINT AS n_found FROM s WHERE error_type IN ('true_positive', 'loose_box', 'missed_object') GROUP BY 1) SELECT *, round(n_found / n_gt, 4) AS recall FROM n", *BASE))
def a19(spark: SparkSession, d: str) -> DataFrame:
    return errors.by_size(_errors(spark, d))


@query("a20_error_summary", sql(f"{ERRORS}, n AS (SELECT {COUNTS} FROM s) SELECT *, round((true_positive + loose_box) / (true_positive + loose_box + missed_object), 4) AS recall, round(loose_box / (true_positive + loose_box), 4) AS loose_ratio FROM n", *BASE))
def a20(spark: SparkSession, d: str) -> DataFrame:
    return errors.summary(_errors(spark, d))


IMAGE_ERRORS = f"""{ERRORS}, n AS (SELECT image_id, count_if(error_type <> 'true_positive')::BIGINT AS n_errors,
  bool_or(class_name IN ('bicycle', 'motorcycle', 'bus') AND error_type IN ('missed_object', 'wrong_class', 'poor_localization')) AS rare_error FROM s GROUP BY 1)"""


@query("a21_errors_by_image", sql(f"{IMAGE_ERRORS} SELECT * FROM n", *BASE))
def a21(spark: SparkSession, d: str) -> DataFrame:
    return errors.by_image(_errors(spark, d))


@query("e5_worst_images", sql(f"{IMAGE_ERRORS} SELECT * FROM n WHERE n_errors > 0 ORDER BY rare_error DESC, n_errors DESC, image_id LIMIT 20", *BASE))
def e5(spark: SparkSession, d: str) -> DataFrame:
    return errors.worst_images(errors.by_image(_errors(spark, d)))


@query("j11_predictions_by_weather", sql(f"SELECT {WEATHER_SQL} AS weather, count(DISTINCT p.image_id) AS n_images, count(*) AS n_predictions FROM predictions p JOIN images i USING (image_id) GROUP BY 1", "predictions", "images"))
def j11(spark: SparkSession, d: str) -> DataFrame:
    joined = frame(spark, d, "predictions").join(_weather_images(spark, d), "image_id")
    return joined.groupBy("weather").agg(F.count_distinct("image_id").alias("n_images"), F.count("*").alias("n_predictions"))


@query("f19_self_iou", sql("SELECT image_id, gt_idx, CAST(1 AS DOUBLE) AS iou FROM gt_boxes", "gt_boxes"))
def f19_self(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "gt_boxes").select("image_id", "gt_idx", F.round(iou(Box.of(), Box.of()), 6).alias("iou"))
