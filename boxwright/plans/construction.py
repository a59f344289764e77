"""Queries of training-set construction: splits, quotas, samples, merges, copy-paste."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.functions.vocab import capture_condition, class_name, segment_class
from boxwright.operators import copypaste as C
from boxwright.operators import merge as M
from boxwright.operators import sampling as S
from boxwright.operators.prepare import choose_masks, class_contract, kept_and_counted
from boxwright.plans.annotation import CONDITION, NAMES, SEGMENT
from boxwright.plans.registry import query
from boxwright.plans.views import frame, sql
from boxwright.session import run_folder
from boxwright.sources import readers, sinks

KEY = "md5('42|' || image_id)"
CNAME = "['person','bicycle','car','motorcycle','bus','truck'][class_id + 1]"


def _images(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "images").withColumn("condition", capture_condition(F.col("weather_raw"), F.col("timeofday")))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "gt_boxes").withColumn("class_name", class_name(F.col("class_id")))


def _ranked(part: str) -> str:
    over = f"PARTITION BY {part} " if part else ""
    return f"r AS (SELECT *, row_number() OVER ({over}ORDER BY {KEY}, image_id) AS rank, count(*) OVER ({over}) AS total FROM images)"


@query("w1_stratified_split", sql(f"WITH {_ranked('weather_raw')} SELECT image_id, CASE WHEN rank <= floor(total * 0.70::DOUBLE) THEN 'train' WHEN rank <= floor(total * 0.70::DOUBLE) + floor(total * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r", "images"))
def w1(spark: SparkSession, d: str) -> DataFrame:
    return S.split(frame(spark, d, "images"), "image_id", {"train": 0.70, "val": 0.15}, "test", "weather_raw").select("image_id", "split")


@query("w2_random_split", sql(f"WITH {_ranked('')} SELECT image_id, CASE WHEN rank <= floor(total * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM r", "images"))
def w2(spark: SparkSession, d: str) -> DataFrame:
    return S.split(frame(spark, d, "images"), "image_id", {"train": 0.8}, "val").select("image_id", "split")


@query("w3_split_by_source", sql(f"WITH {_ranked('source')} SELECT source, CASE WHEN rank <= floor(total * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split, count(*) AS n FROM r GROUP BY 1, 2", "images"))
def w3(spark: SparkSession, d: str) -> DataFrame:
    return S.split(frame(spark, d, "images"), "image_id", {"train": 0.8}, "val", "source").groupBy("source", "split").agg(F.count("*").alias("n"))


@query("w4_preserved_split", sql("SELECT CASE image_id % 3 WHEN 0 THEN 'val' WHEN 1 THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM images GROUP BY 1", "images"))
def w4(spark: SparkSession, d: str) -> DataFrame:
    given = F.when(F.col("image_id") % 3 == 0, "valid").when(F.col("image_id") % 3 == 1, "train").otherwise("test")
    names = F.create_map(*[F.lit(x) for x in ("valid", "val")])  # W5
    return frame(spark, d, "images").groupBy(F.coalesce(F.element_at(names, given), given).alias("split")).agg(F.count("*").alias("n"))


CAPS = {"snowy": 1000, "rainy": 500, "dawn_dusk": 800, "night": 900}


@query(
    "w6_quota_sample",
    sql(
        f"""WITH c AS (SELECT image_id, {CONDITION} AS condition FROM images), r AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY {KEY}, image_id) AS rank FROM c),
k AS (SELECT *, CASE condition WHEN 'snowy' THEN 1000 WHEN 'rainy' THEN 500 WHEN 'dawn_dusk' THEN 800 WHEN 'night' THEN 900 END AS cap FROM r),
t AS (SELECT coalesce(sum(least(n, coalesce(cap, n))), 0) AS taken FROM (SELECT condition, any_value(cap) AS cap, count(*) AS n FROM k WHERE condition <> 'other' GROUP BY 1))
SELECT image_id, condition FROM k, t WHERE CASE WHEN condition = 'other' THEN rank <= greatest(9000 - taken, 0) ELSE rank <= coalesce(cap, rank) END""",
        "images",
    ),
)
def w6(spark: SparkSession, d: str) -> DataFrame:
    return S.quota_sample(_images(spark, d), "image_id", 9000, CAPS).select("image_id", "condition")


@query("w7_uniform_sample", sql(f"SELECT image_id FROM images ORDER BY {KEY}, image_id LIMIT 500", "images"))
def w7(spark: SparkSession, d: str) -> DataFrame:
    return S.sample(frame(spark, d, "images"), "image_id", 500).select("image_id")


@query("w8_full_set", sql("SELECT image_id, source FROM images", "images"))
def w8(spark: SparkSession, d: str) -> DataFrame:
    return S.sample_share(frame(spark, d, "images"), "image_id", 1.0).select("image_id", "source")


@query("w9_replay_sample", sql(f"WITH {_ranked('')} SELECT image_id FROM r WHERE rank <= round_even(total * 0.3::DOUBLE, 0)", "images"))
def w9(spark: SparkSession, d: str) -> DataFrame:
    return S.sample_share(frame(spark, d, "images"), "image_id", 0.3).select("image_id")


@query("w10_one_per_group", sql(f"WITH {_ranked('weather_raw')} SELECT weather_raw, image_id FROM r WHERE rank = 1", "images"))
def w10(spark: SparkSession, d: str) -> DataFrame:
    return S.one_per_group(frame(spark, d, "images"), "image_id", "weather_raw").select("weather_raw", "image_id")


SPLIT = "CASE WHEN image_id % 10 = 0 THEN 'val' WHEN image_id % 10 = 1 THEN 'test' ELSE 'train' END"


def _with_split(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "images").withColumn("split", F.when(F.col("image_id") % 10 == 0, "val").when(F.col("image_id") % 10 == 1, "test").otherwise("train"))


@query("w11_merge_sources", sql(f"SELECT source AS source_dataset, split, count(*) AS n, min(source || '_' || image_id) AS first FROM (SELECT *, {SPLIT} AS split FROM images) WHERE source IN ('xwod', 'bdd') AND split <> 'test' AND (split <> 'val' OR source = 'xwod') GROUP BY 1, 2", "images"))
def w11(spark: SparkSession, d: str) -> DataFrame:
    images = _with_split(spark, d)
    merged = M.merge_sources({"xwod": images.filter("source = 'xwod'"), "bdd": images.filter("source = 'bdd'"), "absent": None}, validation_from="xwod")
    return merged.groupBy("source_dataset", "split").agg(F.count("*").alias("n"), F.min("new_image").alias("first"))


MULT = f"m AS (SELECT image_id, max(CASE {CNAME} WHEN 'bicycle' THEN 2 WHEN 'motorcycle' THEN 3 WHEN 'bus' THEN 3 ELSE 1 END) AS mult FROM gt_boxes GROUP BY 1)"
OVER = f"{MULT}, o AS (SELECT i.image_id, i.split, unnest(range(CASE WHEN i.split = 'train' THEN coalesce(m.mult, 1) ELSE 1 END)) AS copy FROM (SELECT *, {SPLIT} AS split FROM images) i LEFT JOIN m USING (image_id))"


@query("w12_oversample", sql(f"WITH {OVER} SELECT image_id, split, copy::INT AS copy, image_id || CASE WHEN copy > 0 THEN '_os' || copy ELSE '' END AS new_image FROM o", "images", "gt_boxes"))
def w12(spark: SparkSession, d: str) -> DataFrame:
    return M.oversample(_with_split(spark, d), _boxes(spark, d)).select("image_id", "split", "copy", "new_image")


@query("w13_before_after", sql(f"WITH {OVER}, g AS (SELECT image_id, {CNAME} AS cls, CASE WHEN (x2-x1)*(y2-y1) < 1024 THEN 'small' WHEN (x2-x1)*(y2-y1) < 9216 THEN 'medium' ELSE 'large' END AS size FROM gt_boxes), n AS (SELECT * FROM o JOIN g USING (image_id)) SELECT 'class' AS kind, cls AS name, count(*) FILTER (copy = 0) AS n_before, count(*) AS n_after FROM n GROUP BY 2 UNION ALL SELECT 'size', size, count(*) FILTER (copy = 0), count(*) FROM n GROUP BY 2", "images", "gt_boxes"))
def w13(spark: SparkSession, d: str) -> DataFrame:
    boxes = frame(spark, d, "gt_boxes")
    images = _with_split(spark, d)
    after = M.oversample(images, _boxes(spark, d)).select("image_id").join(boxes, "image_id")
    return M.before_after(boxes.join(images.select("image_id"), "image_id"), after)


@query("a8_multipliers", sql(f"WITH {MULT} SELECT mult, count(*) AS n FROM m GROUP BY 1", "gt_boxes"))
def a8(spark: SparkSession, d: str) -> DataFrame:
    return M.multipliers(_boxes(spark, d)).groupBy("mult").agg(F.count("*").alias("n"))


@query("a22_replay_dominance", sql("SELECT count_if(source = 'bdd')::BIGINT AS n_replay, count_if(source <> 'bdd')::BIGINT AS n_adverse, count_if(source = 'bdd') > count_if(source <> 'bdd') AS dominated FROM images", "images"))
def a22(spark: SparkSession, d: str) -> DataFrame:
    images = frame(spark, d, "images")
    return M.dominance(images.filter("source = 'bdd'"), images.filter("source <> 'bdd'"))


def _u(what: str) -> str:
    return f"(('0x' || substr(md5('42|' || image_id || '|' || copy || '|{what}'), 1, 8))::BIGINT / 4294967296::DOUBLE)"


@query(
    "w21_variant_plan",
    sql(
        f"""WITH n AS (SELECT image_id, split, unnest(CASE WHEN split = 'train' THEN [0, 1] ELSE [0] END) AS copy FROM (SELECT image_id, {SPLIT} AS split FROM images))
SELECT image_id, copy, image_id || CASE WHEN copy > 0 THEN '_waug' || copy ELSE '' END AS new_image,
  CASE WHEN copy > 0 THEN ['fog','rain','snow','shadow'][floor({_u("kind")} * 4)::INT + 1] ELSE 'original' END AS variant, copy > 0 AND {_u("brightness")} < 0.5 AS brightness,
  CASE WHEN copy > 0 AND {_u("noise")} < 0.3 THEN CASE WHEN {_u("which")} < 0.5 THEN 'blur' ELSE 'noise' END ELSE 'none' END AS noise FROM n""",
        "images",
    ),
)
def w21(spark: SparkSession, d: str) -> DataFrame:
    return M.variant_plan(_with_split(spark, d)).drop("split")


@query("w22_class_contract", f"SELECT class_id, class_name, true AS ok FROM {NAMES} WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey % 6 = class_id)")
def w22(spark: SparkSession, d: str) -> DataFrame:
    """The classes that the boxes have, by the names of a class table, checked against the library's order."""
    names = spark.sql(f"SELECT * FROM {NAMES}")
    there = frame(spark, d, "gt_boxes").select(F.col("class_id").cast("int").alias("class_id")).distinct()
    return class_contract(there.join(names, "class_id"))


DATASETS = "(VALUES ('xwod', '/data/xwod'), ('bdd', '/data/bdd'), ('acdc', '/data/acdc'), ('unused', '/data/unused')) r(dataset, path)"


@query("s12_dataset_paths", sql(f"SELECT path, count(*) AS n FROM images JOIN {DATASETS} ON source = dataset GROUP BY 1", "images"))
def s12(spark: SparkSession, d: str) -> DataFrame:
    images = frame(spark, d, "images").select(F.col("source").alias("dataset"))
    return readers.with_dataset_paths(images, spark.sql(f"SELECT * FROM {DATASETS}")).groupBy("path").agg(F.count("*").alias("n"))


@query("w23_image_lists", sql("SELECT weather_raw, image_path FROM images", "images"))
def w23(spark: SparkSession, d: str) -> DataFrame:
    """Lists as text files below a folder for each weather; each list may be several tasks' work."""
    folder = run_folder(spark, "lists")
    sinks.write_image_lists(frame(spark, d, "images"), "weather_raw", folder)
    return spark.read.schema("image_path STRING, weather_raw STRING").text(folder).select("weather_raw", "image_path")


def _bank(spark: SparkSession, d: str) -> DataFrame:
    return C.instance_bank(_boxes(spark, d).withColumns({"width": F.lit(1280), "height": F.lit(720)}))


BANK = f"""b AS (SELECT image_id, gt_idx, {CNAME} AS class_name, x2 - x1 AS w, y2 - y1 AS h FROM gt_boxes),
bank AS (SELECT *, CASE WHEN least(w, h) < 12 THEN 'crop_too_small' WHEN w > 1280 * 0.35::DOUBLE OR h > 720 * 0.35::DOUBLE THEN 'crop_too_large' WHEN class_name = 'person' AND w * h >= 9216 THEN 'person_not_small' END AS reason
  FROM b WHERE class_name IN ('bicycle', 'motorcycle', 'bus', 'person'))"""


@query("c1_instance_bank", sql(f"WITH {BANK} SELECT image_id, gt_idx, class_name, reason FROM bank", "gt_boxes"))
def c1(spark: SparkSession, d: str) -> DataFrame:
    return _bank(spark, d).select("image_id", "gt_idx", "class_name", "reason")


@query("a4_skip_reasons", sql(f"WITH {BANK} SELECT reason, count(*) AS n FROM bank WHERE reason IS NOT NULL GROUP BY 1", "gt_boxes"))
def a4(spark: SparkSession, d: str) -> DataFrame:
    from boxwright.operators.prepare import skip_reasons

    return skip_reasons(_bank(spark, d))


def _pastes(spark: SparkSession, d: str) -> DataFrame:
    """As many composites as a tenth of the images."""
    images = frame(spark, d, "images")
    return C.draw_pastes(images, _bank(spark, d), max(30, images.count() // 10))


def _draw(*parts: str) -> str:
    """SQL of a seeded number in [0, 1)."""
    return "(('0x' || substr(md5('42|' || " + " || '|' || ".join(parts) + "), 1, 8))::BIGINT / 4294967296::DOUBLE)"


PASTES = f"""{BANK},
pool AS (SELECT image_id, width, height, row_number() OVER (ORDER BY {KEY}, image_id) AS rank, count(*) OVER () AS total FROM images),
crops AS (SELECT image_id || '|' || gt_idx AS crop_id, class_name, w AS crop_w, h AS crop_h,
  row_number() OVER (PARTITION BY class_name ORDER BY md5('42|' || image_id || '|' || gt_idx), image_id || '|' || gt_idx) AS rank FROM bank WHERE reason IS NULL),
weights AS (SELECT v.*, n FROM (VALUES (1, 'bicycle', 3), (2, 'motorcycle', 3), (3, 'bus', 3), (4, 'person', 1)) v(place, class_name, weight) JOIN (SELECT class_name, count(*) AS n FROM crops GROUP BY 1) USING (class_name)),
upto AS (SELECT *, sum(weight) OVER (ORDER BY place) AS high, sum(weight) OVER (ORDER BY place) - weight AS low, sum(weight) OVER () AS whole FROM weights),
numbers AS (SELECT no FROM range(greatest(30, (SELECT count(*) // 10 FROM images))) t(no)),
drawn AS (SELECT no, pool.image_id, width, height, unnest(range(1, floor({_draw("no", "'count'")} * 3)::BIGINT + 2)) AS paste FROM numbers JOIN pool ON pool.rank = floor({_draw("no", "'bg'")} * pool.total)::BIGINT + 1),
classed AS (SELECT d.*, u.class_name, floor({_draw("no", "paste", "'crop'")} * u.n)::BIGINT + 1 AS rank, 0.8::DOUBLE + {_draw("no", "paste", "'scale'")} * 0.4::DOUBLE AS scale
  FROM drawn d JOIN upto u ON {_draw("no", "paste", "'class'")} * u.whole >= u.low AND {_draw("no", "paste", "'class'")} * u.whole < u.high),
pastes AS (SELECT no, paste::INT AS paste, image_id, class_name, crop_id, greatest(floor(crop_w * scale), 12)::DOUBLE AS w, greatest(floor(crop_h * scale), 12)::DOUBLE AS h, width, height
  FROM classed JOIN crops USING (class_name, rank))"""


def _spot(axis: str, side: str, size: str) -> str:
    return f"2 + floor({_draw('no', 'paste', 't', repr(axis))} * (greatest({side} - {size} - 4, 0) + 1))"


_COMMON = "greatest(0, least(o.x2, b.x2) - greatest(o.x1, b.x1)) * greatest(0, least(o.y2, b.y2) - greatest(o.y1, b.y1))"
PLACED = f"""{PASTES},
corners AS (SELECT no, paste, w, h, t, {_spot("x", "width", "w")} AS x, {_spot("y", "height", "h")} AS y FROM pastes, range(1, 11) q(t) WHERE w + 4 <= width AND h + 4 <= height),
spots AS (SELECT no, paste, list({{'x1': x::DOUBLE, 'y1': y::DOUBLE, 'x2': (x + w)::DOUBLE, 'y2': (y + h)::DOUBLE}} ORDER BY t) AS spots FROM corners GROUP BY 1, 2),
there AS (SELECT image_id, list({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) AS taken FROM gt_boxes GROUP BY 1),
folds AS (SELECT no, 0 AS paste, coalesce(taken, []::STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[]) AS taken, NULL::STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE) AS spot
    FROM (SELECT DISTINCT no, image_id FROM pastes) LEFT JOIN there USING (image_id)
  UNION ALL
  SELECT f.no, p.paste, CASE WHEN z.spot IS NULL THEN f.taken ELSE list_append(f.taken, z.spot) END, z.spot
  FROM folds f JOIN pastes p ON p.no = f.no AND p.paste = f.paste + 1 LEFT JOIN spots s ON s.no = p.no AND s.paste = p.paste,
    LATERAL (SELECT list_filter(s.spots, lambda b: len(list_filter(f.taken, lambda o: {_COMMON}
      >= 0.2 * greatest((o.x2 - o.x1) * (o.y2 - o.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_COMMON}, 1e-9))) = 0)[1] AS spot) z),
placed AS (SELECT p.no, p.image_id, p.paste, p.class_name, p.crop_id, f.spot.x1 AS x1, f.spot.y1 AS y1, f.spot.x2 AS x2, f.spot.y2 AS y2,
  CASE WHEN f.spot IS NOT NULL THEN NULL WHEN s.no IS NULL THEN 'crop_invalid' ELSE 'overlap' END AS reason
  FROM pastes p JOIN folds f ON f.no = p.no AND f.paste = p.paste LEFT JOIN spots s ON s.no = p.no AND s.paste = p.paste)"""
PASTED = ("images", "gt_boxes")


@query("c2_draw_pastes", sql(f"WITH {PASTES} SELECT no, paste, image_id, class_name, crop_id, w, h FROM pastes", *PASTED))
def c2(spark: SparkSession, d: str) -> DataFrame:
    return _pastes(spark, d).select("no", "paste", "image_id", "class_name", "crop_id", "w", "h")


@query("c3_place_pastes", sql(f"WITH RECURSIVE {PLACED} SELECT * FROM placed", *PASTED))
def c3(spark: SparkSession, d: str) -> DataFrame:
    return C.place(_pastes(spark, d), frame(spark, d, "gt_boxes"))


@query(
    "c4_composites",
    sql(
        f"""WITH RECURSIVE {PLACED},
chosen AS (SELECT DISTINCT no, image_id FROM placed WHERE reason IS NULL ORDER BY no LIMIT greatest(10, (SELECT count(*) // 30 FROM images)))
SELECT c.no, printf('cp_%05d_%s', c.no, c.image_id::VARCHAR) AS new_image, {CNAME} AS class_name, x1, y1, x2, y2, false AS pasted FROM chosen c JOIN gt_boxes USING (image_id)
UNION ALL SELECT c.no, printf('cp_%05d_%s', c.no, c.image_id::VARCHAR), class_name, x1, y1, x2, y2, true FROM chosen c JOIN placed p ON p.no = c.no WHERE reason IS NULL""",
        *PASTED,
    ),
)
def c4(spark: SparkSession, d: str) -> DataFrame:
    images = frame(spark, d, "images")
    return C.composites(c3(spark, d), _boxes(spark, d), max(10, images.count() // 30))


def _sizes(area: str) -> str:
    return f"CASE WHEN {area} < 1024 THEN 'small' WHEN {area} < 9216 THEN 'medium' ELSE 'large' END"


AREA = "(x2 - x1) * (y2 - y1)"


@query(
    "c5_paste_statistics",
    sql(
        f"""WITH RECURSIVE {PLACED}, base AS (SELECT *, {CNAME} AS class_name FROM gt_boxes),
c AS (SELECT 'bank' AS kind, class_name AS name FROM bank WHERE reason IS NULL
UNION ALL SELECT 'skipped', reason FROM bank WHERE reason IS NOT NULL
UNION ALL SELECT 'skipped', reason FROM placed WHERE reason IS NOT NULL
UNION ALL SELECT 'pasted_class', class_name FROM placed WHERE reason IS NULL
UNION ALL SELECT 'pasted_source', i.source FROM placed p JOIN images i ON i.image_id = split_part(p.crop_id, '|', 1)::BIGINT WHERE reason IS NULL
UNION ALL SELECT 'pasted_size', {_sizes(AREA)} FROM placed WHERE reason IS NULL
UNION ALL SELECT 'before_class', class_name FROM base
UNION ALL SELECT 'after_class', class_name FROM base UNION ALL SELECT 'after_class', class_name FROM placed WHERE reason IS NULL
UNION ALL SELECT 'before_size', {_sizes(AREA)} FROM base WHERE image_id IN (SELECT image_id FROM bank)
UNION ALL SELECT 'after_size', {_sizes(AREA)} FROM base WHERE image_id IN (SELECT image_id FROM bank) UNION ALL SELECT 'after_size', {_sizes(AREA)} FROM placed WHERE reason IS NULL)
SELECT kind, name, count(*) AS n FROM c GROUP BY 1, 2""",
        *PASTED,
    ),
)
def c5(spark: SparkSession, d: str) -> DataFrame:
    return C.paste_statistics(_bank(spark, d), c3(spark, d).checkpoint(), _boxes(spark, d), frame(spark, d, "images"))


@query(
    "a4_all_reasons",
    sql(
        f"""WITH RECURSIVE {PLACED},
m AS (SELECT CASE WHEN NOT (o_orderkey % 3 = 0 OR o_orderkey % 2 = 0) THEN 'no_mask' WHEN o_orderkey NOT IN (SELECT image_id FROM mask_runs WHERE {SEGMENT} IS NOT NULL) THEN 'no_boxes' END AS reason FROM orders),
every AS (SELECT reason FROM m UNION ALL SELECT reason FROM bank UNION ALL SELECT reason FROM placed
UNION ALL SELECT CASE WHEN count_if(reason IS NULL) = 0 THEN 'no_paste' END FROM placed GROUP BY no)
SELECT reason, count(*) AS n FROM every WHERE reason IS NOT NULL GROUP BY 1""",
        *PASTED,
        "mask_runs",
    ),
)
def a4_all(spark: SparkSession, d: str) -> DataFrame:
    """Every reason for which something is left out, counted by the passes that write what is kept."""
    folder = run_folder(spark, "kept")
    keys = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("key"))
    masks = choose_masks(keys, keys.filter("key % 3 = 0"), keys.filter("key % 2 = 0"), keys.filter("key % 5 = 0"))
    found = frame(spark, d, "mask_runs").filter(segment_class(F.col("segment_id")).isNotNull()).groupBy(F.col("image_id").alias("key")).agg(F.count("*").alias("n"))
    masks = masks.join(found, "key", "left").withColumn("reason", F.when(F.col("mask_source") == "no_mask", "no_mask").when(F.col("n").isNull(), "no_boxes"))
    placed = c3(spark, d).checkpoint()  # written twice: as pastes and by composite
    made = placed.groupBy("no").agg(F.count_if(F.col("reason").isNull()).alias("n")).withColumn("reason", F.when(F.col("n") == 0, "no_paste"))
    crops = ("crop_too_small", "crop_too_large", "person_not_small", "crop_invalid")
    steps = {"masks": (masks, ("no_mask", "no_boxes")), "bank": (_bank(spark, d), crops), "pastes": (placed, ("crop_invalid", "overlap")), "composites": (made, ("no_paste",))}
    counts: dict[str, int] = {}
    for name, (rows, reasons) in steps.items():
        kept, seen = kept_and_counted(rows, reasons)
        kept.write.parquet(f"{folder}/{name}")
        for reason, n in seen.get.items():
            counts[reason] = counts.get(reason, 0) + n
    return spark.createDataFrame([(r, n) for r, n in counts.items() if n], "reason string, n bigint")
