"""Queries of annotation preparation: vocabularies, geometry, names, filters, joins, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.functions import names as N
from boxwright.functions import vocab as V
from boxwright.operators import prepare as P
from boxwright.plans.registry import query
from boxwright.plans.views import frame, sql


def sql_map(table: dict, key: str) -> str:
    """A CASE over a vocabulary."""
    lit = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return f"CASE {key} " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in table.items()) + " END"


NAME = "lower(trim(category))"
for _q, _aliases in (("f1_normalize_class", V.CLASS_ALIASES), ("f2_normalize_driving_class", V.DRIVING_ALIASES), ("f3_normalize_voc_class", V.VOC_ALIASES)):

    @query(_q, sql(f"SELECT image_id, gt_idx, {sql_map(_aliases, NAME)} AS class_name FROM raw_boxes", "raw_boxes"))
    def _normalize(spark: SparkSession, d: str, aliases: dict[str, str] = _aliases) -> DataFrame:
        return frame(spark, d, "raw_boxes").select("image_id", "gt_idx", V.normalize_class(F.col("category"), aliases).alias("class_name"))


@query("f4_remap_class", sql(f"SELECT image_id, gt_idx, {sql_map(V.TEN_TO_SIX, 'CAST(gt_idx % 10 AS INT)')} AS from_ten, {sql_map(V.SIX_TO_SIX, 'class_id')} AS from_six FROM gt_boxes", "gt_boxes"))
def f4(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "gt_boxes").select("image_id", "gt_idx", V.remap_class(F.col("gt_idx") % 10, V.TEN_TO_SIX).alias("from_ten"), V.remap_class(F.col("class_id"), V.SIX_TO_SIX).alias("from_six"))


SEGMENT = f"{sql_map(V.SEGMENT_CLASSES, 'CASE WHEN segment_id >= 1000 THEN segment_id // 1000 ELSE segment_id END')}"


@query("f5_segment_class", sql(f"SELECT segment_id, {SEGMENT} AS class_name, count(*) AS n FROM mask_runs GROUP BY 1, 2", "mask_runs"))
def f5(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "mask_runs").groupBy("segment_id", V.segment_class(F.col("segment_id")).alias("class_name")).agg(F.count("*").alias("n"))


PLAIN = "replace(replace(lower(trim(weather_raw)), '_', ' '), '-', ' ')"


@query("f6_normalize_weather", sql(f"SELECT image_id, CASE WHEN coalesce(weather_raw, '') = '' THEN 'unknown' ELSE coalesce({sql_map(V.WEATHER_ALIASES, PLAIN)}, {PLAIN}) END AS weather FROM images", "images"))
def f6(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "images").select("image_id", V.normalize_weather(F.col("weather_raw")).alias("weather"))


def _path_sql(table: tuple[tuple[str, str], ...]) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(image_path), '{a}') THEN '{b}'" for a, b in table) + " ELSE 'unknown' END"


@query("f7_weather_from_path", sql(f"SELECT image_id, {_path_sql(V.PATH_WEATHER)} AS weather, {_path_sql(V.VOC_PATH_WEATHER)} AS voc_weather FROM images", "images"))
def f7(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("image_path")
    return frame(spark, d, "images").select("image_id", V.weather_from_path(path).alias("weather"), V.weather_from_path(path, V.VOC_PATH_WEATHER).alias("voc_weather"))


@query("f8_voc_weather_counts", sql(f"SELECT {_path_sql(V.VOC_PATH_WEATHER)} AS weather, count(*) AS n FROM images GROUP BY 1", "images"))
def f8(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "images").groupBy(V.weather_from_path(F.col("image_path"), V.VOC_PATH_WEATHER).alias("weather")).agg(F.count("*").alias("n"))


HEAD = "regexp_extract(image_path, '^/data/([^/]*)/', 1) || '_train_' || image_id"
HEAD_LOW = f"lower(regexp_extract({HEAD}, '^(.*?)_(?:train|valid|test)_', 1))"


@query("f9_weather_from_name", sql(f"SELECT image_id, coalesce({sql_map(V.NAME_WEATHER_ALIASES, HEAD_LOW)}, {HEAD_LOW}) AS weather FROM images", "images"))
def f9(spark: SparkSession, d: str) -> DataFrame:
    stem = F.concat(F.regexp_extract("image_path", "^/data/([^/]*)/", 1), F.lit("_train_"), F.col("image_id").cast("string"))
    return frame(spark, d, "images").select("image_id", V.weather_from_name(stem).alias("weather"))


SPLIT = "CASE WHEN image_id % 10 = 0 THEN 'val' WHEN image_id % 10 = 1 THEN 'test' ELSE 'train' END"
CONDITION = """CASE WHEN weather_raw IN ('foggy', 'snowy', 'rainy') THEN weather_raw WHEN timeofday = 'dawn/dusk' THEN 'dawn_dusk' WHEN timeofday = 'night' THEN 'night' ELSE 'other' END"""


#: Attributes as they come: padded, in any case.
UNEVEN = "SELECT image_id, CASE image_id % 3 WHEN 0 THEN '  ' || upper(weather_raw) WHEN 1 THEN weather_raw || ' ' ELSE weather_raw END AS weather_raw, CASE image_id % 2 WHEN 0 THEN upper(timeofday) || ' ' ELSE timeofday END AS timeofday FROM images"


@query("f10_capture_condition", sql(f"SELECT image_id, {CONDITION} AS condition FROM (SELECT image_id, lower(trim(weather_raw)) AS weather_raw, lower(trim(timeofday)) AS timeofday FROM ({UNEVEN}))", "images"))
def f10(spark: SparkSession, d: str) -> DataFrame:
    images = spark.sql(UNEVEN.replace("FROM images", "FROM {images}"), images=frame(spark, d, "images"))
    return images.select("image_id", V.capture_condition(F.col("weather_raw"), F.col("timeofday")).alias("condition"))


CLAMPED = """c AS (SELECT image_id, gt_idx, category, x1 AS rx1, y1 AS ry1, x2 AS rx2, y2 AS ry2, greatest(0, least(x1, 1279)) AS x1, greatest(0, least(y1, 719)) AS y1, greatest(0, least(x2, 1280)) AS x2, greatest(0, least(y2, 720)) AS y2 FROM raw_boxes)"""


@query("f11_clamp_box", sql(f"WITH {CLAMPED} SELECT image_id, gt_idx, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM c WHERE x2 > x1 AND y2 > y1", "raw_boxes"))
def f11(spark: SparkSession, d: str) -> DataFrame:
    box, ok = G.clamp(G.Box.of(), F.lit(1280), F.lit(720))
    return frame(spark, d, "raw_boxes").filter(ok).select("image_id", "gt_idx", *[c.alias(n) for n, c in box.named().items()])


@query("f12_clamp_all_corners", sql("WITH c AS (SELECT image_id, gt_idx, greatest(0, least(x1, 1280))::DOUBLE AS x1, greatest(0, least(y1, 720))::DOUBLE AS y1, greatest(0, least(x2, 1280))::DOUBLE AS x2, greatest(0, least(y2, 720))::DOUBLE AS y2 FROM raw_boxes) SELECT * FROM c WHERE x2 > x1 AND y2 > y1", "raw_boxes"))
def f12(spark: SparkSession, d: str) -> DataFrame:
    box, ok = G.clamp_all(G.Box.of(), F.lit(1280), F.lit(720))
    return frame(spark, d, "raw_boxes").filter(ok).select("image_id", "gt_idx", *[c.alias(n) for n, c in box.named().items()])


@query(
    "f13_clip_and_sort",
    sql(
        """WITH c AS (SELECT image_id, gt_idx, greatest(0, least(x1, 640)) AS a, greatest(0, least(x2, 640)) AS b, greatest(0, least(y1, 360)) AS c, greatest(0, least(y2, 360)) AS d FROM raw_boxes),
s AS (SELECT image_id, gt_idx, least(a, b)::DOUBLE AS x1, least(c, d)::DOUBLE AS y1, greatest(a, b)::DOUBLE AS x2, greatest(c, d)::DOUBLE AS y2 FROM c)
SELECT * FROM s WHERE x2 - x1 >= 1 AND y2 - y1 >= 1""",
        "raw_boxes",
    ),
)
def f13(spark: SparkSession, d: str) -> DataFrame:
    box, ok = G.clip_sorted(G.Box.of(), F.lit(640), F.lit(360))
    return frame(spark, d, "raw_boxes").filter(ok).select("image_id", "gt_idx", *[c.alias(n) for n, c in box.named().items()])


CENTER = "SELECT image_id, gt_idx, round((x1 + x2) / 2 / 1280, 10) AS cx, round((y1 + y2) / 2 / 720, 10) AS cy, round((x2 - x1) / 1280, 10) AS w, round((y2 - y1) / 720, 10) AS h FROM gt_boxes"


@query("f14_to_center", sql(CENTER, "gt_boxes"))
def f14(spark: SparkSession, d: str) -> DataFrame:
    out = G.to_center(G.Box.of(), F.lit(1280), F.lit(720))
    return frame(spark, d, "gt_boxes").select("image_id", "gt_idx", *[F.round(c, 10).alias(n) for n, c in out.items()])


@query("f15_center_round_trip", sql("SELECT image_id, gt_idx, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2 FROM gt_boxes", "gt_boxes"))
def f15(spark: SparkSession, d: str) -> DataFrame:
    c = frame(spark, d, "gt_boxes").select("image_id", "gt_idx", *[v.alias(n) for n, v in G.to_center(G.Box.of(), F.lit(1280), F.lit(720)).items()])
    box = G.from_center(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.lit(1280), F.lit(720))
    return c.select("image_id", "gt_idx", *[F.round(v, 4).alias(n) for n, v in box.named().items()])



@query(
    "f16_pixel_corners",
    sql(
        """WITH b AS (SELECT image_id, gt_idx, (class_id + 1) / 8::DOUBLE AS cx, (gt_idx % 7 + 1) / 8::DOUBLE AS cy, (class_id + 1) / 16::DOUBLE AS w, (gt_idx % 5 + 1) / 4::DOUBLE AS h FROM gt_boxes)
SELECT image_id, gt_idx, greatest(0, least(trunc((cx - w / 2) * 1277)::INT, 1277)) AS x1, greatest(0, least(trunc((cy - h / 2) * 719)::INT, 719)) AS y1,
  greatest(0, least(trunc((cx + w / 2) * 1277)::INT, 1277)) AS x2, greatest(0, least(trunc((cy + h / 2) * 719)::INT, 719)) AS y2 FROM b""",
        "gt_boxes",
    ),
)
def f16(spark: SparkSession, d: str) -> DataFrame:
    c, g = F.col("class_id"), F.col("gt_idx")
    box = G.to_pixels((c + 1) / 8, (g % 7 + 1) / 8, (c + 1) / 16, (g % 5 + 1) / 4, F.lit(1277), F.lit(719))
    return frame(spark, d, "gt_boxes").select("image_id", "gt_idx", *[v.alias(n) for n, v in box.named().items()])


@query("f17_letterbox", sql("SELECT image_id, gt_idx, round(x1 * 0.5::DOUBLE, 6) AS x1, round(y1 * 0.5::DOUBLE + 140, 6) AS y1, round(x2 * 0.5::DOUBLE, 6) AS x2, round(y2 * 0.5::DOUBLE + 140, 6) AS y2 FROM gt_boxes", "gt_boxes"))
def f17(spark: SparkSession, d: str) -> DataFrame:
    box = G.letterbox(G.Box.of(), F.lit(1280), F.lit(720), 640)
    return frame(spark, d, "gt_boxes").select("image_id", "gt_idx", *[F.round(v, 6).alias(n) for n, v in box.named().items()])


@query("f20_label_path", sql("SELECT image_id, regexp_replace(regexp_replace(image_path, '^(.*/|)images/', '\\1labels/'), '\\.[^./]*$', '.txt') AS label_path FROM images", "images"))
def f20(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "images").select("image_id", N.label_path(F.col("image_path")).alias("label_path"))


@query("f21_output_name", sql("SELECT image_id, source || '_' || weather_raw || '_' || image_id || '_' || substr(sha1(image_path), 1, 10) AS name FROM images", "images"))
def f21(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "images").select("image_id", N.output_name(F.col("source"), F.col("weather_raw"), F.col("image_path")).alias("name"))


@query("f22_source_of_name", sql("SELECT image_id, CASE WHEN image_id % 2 = 0 THEN source ELSE 'other' END AS source FROM images", "images"))
def f22(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("source"), F.when(F.col("image_id") % 2 == 0, "_").otherwise("-"), F.col("image_id").cast("string"))
    return frame(spark, d, "images").select("image_id", V.source_of_name(name).alias("source"))


@query("f23_box_text", sql("SELECT image_id, pred_idx, concat_ws(' ', round_even(x1, 0)::BIGINT, round_even(y1, 0)::BIGINT, round_even(x2, 0)::BIGINT, round_even(y2, 0)::BIGINT) AS box FROM predictions", "predictions"))
def f23(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "predictions").select("image_id", "pred_idx", G.to_text(G.Box.of()).alias("box"))


@query("f24_copy_names", sql("SELECT image_id, image_id || '_os' || (image_id % 3 + 1) AS os_name, 'cp_' || lpad(CAST(image_id % 1000 AS VARCHAR), 5, '0') || '_' || image_id AS cp_name FROM images", "images"))
def f24(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("image_id").cast("string")
    return frame(spark, d, "images").select("image_id", N.copy_name(name, "os", F.col("image_id") % 3 + 1).alias("os_name"), N.composite_name(name, F.col("image_id") % 1000).alias("cp_name"))


@query("f25_path_parts", sql("SELECT image_id, CAST(image_id AS VARCHAR) AS stem, '.jpg' AS suffix, CAST(image_id AS VARCHAR) AS key FROM images", "images"))
def f25(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("image_path")
    masked = F.regexp_replace(path, r"\.jpg$", "_rgb_anon.png")
    return frame(spark, d, "images").select("image_id", N.stem(path).alias("stem"), N.suffix(path).alias("suffix"), N.image_key(masked).alias("key"))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """Raw boxes nested as frames, as the driving annotations come."""
    box = F.struct("x1", "y1", "x2", "y2")
    labels = frame(spark, d, "raw_boxes").groupBy("image_id").agg(F.collect_list(F.struct("category", F.when(F.col("gt_idx") % 4 != 0, box).alias("box2d"))).alias("labels"))
    images = frame(spark, d, "images").select("image_id", F.when(F.col("image_id") % 5 != 0, F.struct(F.col("weather_raw").alias("weather"), "timeofday", F.lit(None).cast("string").alias("scene"))).alias("attributes"))
    return images.join(labels, "image_id").withColumn("name", F.col("image_id").cast("string"))


TARGETS = ", ".join(f"'{k}'" for k in V.DRIVING_ALIASES)


@query("p1_frames_with_targets", sql(f"SELECT DISTINCT CAST(image_id AS VARCHAR) AS name FROM raw_boxes JOIN images USING (image_id) WHERE lower(category) IN ({TARGETS}) AND gt_idx % 4 <> 0", "raw_boxes", "images"))
def p1(spark: SparkSession, d: str) -> DataFrame:
    return P.frames_with_targets(_frames(spark, d)).select("name")


@query(
    "s1_exploded_frames",
    sql(
        """SELECT CAST(image_id AS VARCHAR) AS name, CASE WHEN image_id % 5 <> 0 THEN weather_raw ELSE 'undefined' END AS weather, CASE WHEN image_id % 5 <> 0 THEN timeofday ELSE 'undefined' END AS timeofday,
  'undefined' AS scene, category, CASE WHEN gt_idx % 4 <> 0 THEN x1 END AS x1, CASE WHEN gt_idx % 4 <> 0 THEN y2 END AS y2 FROM raw_boxes JOIN images USING (image_id)""",
        "raw_boxes",
        "images",
    ),
)
def s1(spark: SparkSession, d: str) -> DataFrame:
    return P.explode_labels(_frames(spark, d)).select("name", "weather", "timeofday", "scene", "category", "x1", "y2")


CLEAN = f"""{CLAMPED}, k AS (SELECT image_id, gt_idx, {sql_map(V.DRIVING_ALIASES, NAME)} AS class_name, x1, y1, x2, y2 FROM c WHERE rx2 > rx1 AND ry2 > ry1 AND x2 > x1 AND y2 > y1),
clean AS (SELECT *, {sql_map({c: k for k, c in enumerate(V.CLASSES)}, "class_name")} AS class_id FROM k WHERE class_name IS NOT NULL)"""


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return P.clean_boxes(frame(spark, d, "raw_boxes"), V.DRIVING_ALIASES, F.lit(1280), F.lit(720))


@query("p2_clean_boxes", sql(f"WITH {CLEAN} SELECT image_id, gt_idx, class_id, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM clean", "raw_boxes"))
def p2(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d).select("image_id", "gt_idx", "class_id", "x1", "y1", "x2", "y2")


@query("p6_keep_conditions", sql(f"SELECT image_id, condition, split FROM (SELECT image_id, {CONDITION} AS condition, {SPLIT} AS split FROM images) WHERE condition IN ('foggy', 'night') AND split IN ('train', 'val')", "images"))
def p6(spark: SparkSession, d: str) -> DataFrame:
    images = frame(spark, d, "images").withColumns({"condition": V.capture_condition(F.col("weather_raw"), F.col("timeofday")), "split": F.expr(SPLIT)})
    return P.keep_listed(images, condition=("foggy", "night"), split=("train", "val")).select("image_id", "condition", "split")


@query("p9_split_of_manifest", sql(f"SELECT image_id, image_path FROM (SELECT *, {SPLIT} AS split FROM images) WHERE split = 'val'", "images"))
def p9(spark: SparkSession, d: str) -> DataFrame:
    return P.keep_listed(frame(spark, d, "images").withColumn("split", F.expr(SPLIT)), split=("val",)).select("image_id", "image_path")


@query("p3_keep_weathers", sql("SELECT image_id, weather_raw AS weather FROM images WHERE weather_raw IN ('foggy', 'snowy')", "images"))
def p3(spark: SparkSession, d: str) -> DataFrame:
    return P.keep_weathers(frame(spark, d, "images").select("image_id", F.col("weather_raw").alias("weather")), ("foggy", "snowy"))


for _keep, _join in ((False, "JOIN"), (True, "LEFT JOIN")):

    @query(f"p4_images_with_boxes{'_or_negatives' if _keep else ''}", sql(f"WITH {CLEAN}, n AS (SELECT image_id, count(*) AS n FROM clean GROUP BY 1) SELECT i.image_id, coalesce(n.n, 0) AS num_objects FROM images i {_join} n USING (image_id)", "raw_boxes", "images"))
    def _p4(spark: SparkSession, d: str, keep: bool = _keep) -> DataFrame:
        return P.with_boxes(frame(spark, d, "images").select("image_id"), _clean(spark, d), keep)


@query("p8_rounded_confidence", sql("SELECT image_id, pred_idx, round_even(conf, 1) AS conf FROM predictions", "predictions"))
def p8(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "predictions").select("image_id", "pred_idx", F.bround("conf", 1).alias("conf"))


@query("p10_class_range", sql("SELECT image_id, gt_idx, class_id FROM (SELECT image_id, gt_idx, class_id * 2 AS class_id FROM gt_boxes) WHERE class_id BETWEEN 0 AND 5", "gt_boxes"))
def p10(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "gt_boxes").select("image_id", "gt_idx", (F.col("class_id") * 2).alias("class_id")).filter(F.col("class_id").between(0, len(V.CLASSES) - 1))


ANNOTATIONS = """a AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'd' || (o_custkey % 4) ELSE 'x' || (o_orderkey % 2) END AS dir, CAST(o_orderkey % 5000 AS VARCHAR) AS stem, 'a' || o_orderkey AS annotation FROM orders WHERE o_orderkey % 7 <> 0),
im AS (SELECT o_orderkey AS image_id, 'd' || (o_custkey % 4) AS dir, CAST(o_orderkey % 5000 AS VARCHAR) AS stem FROM orders)"""


@query(
    "j1_match_annotations",
    f"""WITH {ANNOTATIONS},
h AS (SELECT dir, stem, min(annotation) AS near FROM a GROUP BY 1, 2), w AS (SELECT stem, count(*) AS n, min(annotation) AS far FROM a GROUP BY 1)
SELECT image_id, CASE WHEN near IS NOT NULL THEN 'same_dir' WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS found,
  CASE WHEN near IS NOT NULL THEN near WHEN n = 1 THEN far END AS annotation FROM im LEFT JOIN h USING (dir, stem) LEFT JOIN w USING (stem)""",
)
def j1(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    stem = F.expr("CAST(o_orderkey % 5000 AS STRING)").alias("stem")
    images = orders.select(F.col("o_orderkey").alias("image_id"), F.expr("'d' || (o_custkey % 4)").alias("dir"), stem)
    notes = orders.filter("o_orderkey % 7 <> 0").select(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'd' || (o_custkey % 4) ELSE 'x' || (o_orderkey % 2) END").alias("dir"), stem, F.expr("'a' || o_orderkey").alias("annotation"))
    return P.match_annotations(images, notes).select("image_id", "found", "annotation")


@query("j2_find_by_name", sql("SELECT CASE WHEN image_id % 2 = 0 THEN image_path ELSE image_id || '.jpg' END AS name, image_path FROM images", "images"))
def j2(spark: SparkSession, d: str) -> DataFrame:
    images = frame(spark, d, "images").select("image_id", "image_path")
    wanted = images.select(F.expr("CASE WHEN image_id % 2 = 0 THEN image_path ELSE image_id || '.jpg' END").alias("name"))
    return P.find_by_name(wanted, images)


@query("j3_pair_by_stem", "SELECT o_orderkey AS image_id, 'l' || o_orderkey AS label FROM orders WHERE o_orderkey % 3 = 0")
def j3(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    split = F.expr("CASE WHEN o_custkey % 4 = 0 THEN 'val' ELSE 'train' END").alias("split")
    images = orders.select(F.col("o_orderkey").alias("image_id"), split, F.col("o_orderkey").cast("string").alias("stem"))
    labels = orders.filter("o_orderkey % 3 = 0").select(split, F.col("o_orderkey").cast("string").alias("stem"), F.expr("'l' || o_orderkey").alias("label"))
    return P.pair_by_stem(images, labels).select("image_id", "label")


@query("j4_left_labels", sql("SELECT i.image_id, count(g.gt_idx) AS num_objects FROM images i LEFT JOIN gt_boxes g USING (image_id) GROUP BY 1", "images", "gt_boxes"))
def j4(spark: SparkSession, d: str) -> DataFrame:
    return P.with_boxes(frame(spark, d, "images").select("image_id"), frame(spark, d, "gt_boxes"), True)


@query("j5_existing_frames", sql("SELECT EXISTS (SELECT 1 FROM gt_boxes g WHERE g.image_id = i.image_id) AS present, count(*) AS n FROM images i GROUP BY 1", "images", "gt_boxes"))
def j5(spark: SparkSession, d: str) -> DataFrame:
    frames = frame(spark, d, "images").select(F.col("image_id").alias("name"))
    return P.existing(frames, frame(spark, d, "gt_boxes").select(F.col("image_id").alias("name"))).groupBy("present").agg(F.count("*").alias("n"))


@query("j6_condition_default", sql(f"SELECT i.image_id, coalesce(c.condition, 'other') AS condition FROM images i LEFT JOIN (SELECT image_id, {CONDITION} AS condition FROM images WHERE image_id % 3 <> 0) c USING (image_id)", "images"))
def j6(spark: SparkSession, d: str) -> DataFrame:
    images = frame(spark, d, "images")
    known = images.filter("image_id % 3 <> 0").select("image_id", V.capture_condition(F.col("weather_raw"), F.col("timeofday")).alias("condition"))
    return images.select("image_id").join(known, "image_id", "left").withColumn("condition", F.coalesce("condition", F.lit("other")))


@query("j7_choose_masks", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'instance' WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 = 0 THEN 'panoptic' WHEN o_orderkey % 2 = 0 THEN 'panoptic_as_instance' ELSE 'no_mask' END AS mask_source FROM orders")
def j7(spark: SparkSession, d: str) -> DataFrame:
    keys = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("key"))
    return P.choose_masks(keys, keys.filter("key % 3 = 0"), keys.filter("key % 2 = 0"), keys.filter("key % 5 = 0"))


SEGMENTS = "SELECT image_id, segment_id, min(x_start)::DOUBLE AS x1, min(y)::DOUBLE AS y1, max(x_end)::DOUBLE AS x2, (max(y) + 1)::DOUBLE AS y2 FROM mask_runs GROUP BY 1, 2"


@query("a9_segment_boxes", sql(SEGMENTS, "mask_runs"))
def a9(spark: SparkSession, d: str) -> DataFrame:
    return P.segment_boxes(frame(spark, d, "mask_runs"))


@query("j8_segment_categories", sql(f"WITH s AS ({SEGMENTS}) SELECT coalesce({SEGMENT}, 'extra') AS class_name, count(*) AS n FROM s GROUP BY 1", "mask_runs"))
def j8(spark: SparkSession, d: str) -> DataFrame:
    return P.segment_boxes(frame(spark, d, "mask_runs")).groupBy(F.coalesce(V.segment_class(F.col("segment_id")), F.lit("extra")).alias("class_name")).agg(F.count("*").alias("n"))


@query("s5_packed_ids", sql("SELECT DISTINCT segment_id FROM mask_runs", "mask_runs"))
def s5(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("segment_id")
    rgb = frame(spark, d, "mask_runs").select((s % 256).alias("r"), (F.floor(s / 256) % 256).alias("g"), F.floor(s / 65536).alias("b"))
    return rgb.select(P.pack_id(F.col("r"), F.col("g"), F.col("b")).alias("segment_id")).distinct()


NAMES = "(VALUES (0,'person'),(1,'bicycle'),(2,'car'),(3,'motorcycle'),(4,'bus'),(5,'truck')) n(class_id, class_name)"


@query("a1_class_counts", sql(f"WITH {CLEAN} SELECT n.class_id, n.class_name, count(clean.class_id) AS n FROM {NAMES} LEFT JOIN clean ON clean.class_id = n.class_id GROUP BY 1, 2", "raw_boxes"))
def a1(spark: SparkSession, d: str) -> DataFrame:
    return P.class_counts(_clean(spark, d))


@query("a2_images_by_source", sql("SELECT source, weather_raw, count(*) AS n FROM images GROUP BY 1, 2", "images"))
def a2(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "images").groupBy("source", "weather_raw").agg(F.count("*").alias("n"))


@query("a3_weather_distribution", sql("SELECT weather_raw, count(*) AS n FROM images WHERE image_id % 10 <> 0 GROUP BY 1", "images"))
def a3(spark: SparkSession, d: str) -> DataFrame:
    return P.distribution(frame(spark, d, "images").withColumn("split", F.when(F.col("image_id") % 10 == 0, "val").otherwise("train")), "weather_raw", "val")


@query("a5_unknown_classes", sql(f"SELECT CASE WHEN {NAME} = '' THEN '<empty>' ELSE {NAME} END AS category, count(*) AS n FROM raw_boxes WHERE {sql_map(V.VOC_ALIASES, NAME)} IS NULL GROUP BY 1", "raw_boxes"))
def a5(spark: SparkSession, d: str) -> DataFrame:
    return P.unknown_classes(frame(spark, d, "raw_boxes"), V.VOC_ALIASES)


@query("a6_classes_of_images", sql("SELECT image_id, array_to_string(list_sort(list(DISTINCT class_id)), ',') AS classes FROM gt_boxes GROUP BY 1", "gt_boxes"))
def a6(spark: SparkSession, d: str) -> DataFrame:
    return P.classes_of_images(frame(spark, d, "gt_boxes")).withColumn("classes", F.array_join("classes", ","))


@query("a7_boxes_of_images", sql("SELECT image_id, count(*) AS num_objects FROM gt_boxes GROUP BY 1", "gt_boxes"))
def a7(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "gt_boxes").groupBy("image_id").agg(F.count("*").alias("num_objects"))


@query("j12_class_dimension", sql("SELECT g.class_id, n.class_name, n.class_name IN ('bicycle', 'motorcycle', 'bus') AS is_rare, count(*) AS n FROM gt_boxes g JOIN " + NAMES + " USING (class_id) GROUP BY ALL", "gt_boxes"))
def j12(spark: SparkSession, d: str) -> DataFrame:
    name = V.class_name(F.col("class_id"))
    return frame(spark, d, "gt_boxes").groupBy("class_id", name.alias("class_name"), name.isin(*V.RARE_CLASSES).alias("is_rare")).agg(F.count("*").alias("n"))


@query("w20_first_of_files", "SELECT o_custkey AS key, min(o_orderkey) AS file FROM orders GROUP BY 1")
def w20(spark: SparkSession, d: str) -> DataFrame:
    files = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("file"))
    return P.first_of(files, "key", "file")
