"""Queries that write with a sink to the shared folder and read back with a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.operators import errors, prepare
from boxwright.plans.annotation import NAME
from boxwright.plans.evaluation import BASE, ERRORS
from boxwright.plans.registry import query
from boxwright.plans.views import frame, sql
from boxwright.session import run_folder
from boxwright.sources import label_files, readers, sinks


#: Images of an XML file at most: such a file is read by one task.
FILE_ROWS = 50_000


def _folder(spark: SparkSession) -> str:
    return run_folder(spark, "io")


@query("k1_label_text", sql("SELECT i.image_id, g.class_id::INT AS class_id, (x1 + x2)::BIGINT AS x_sum, (y1 + y2)::BIGINT AS y_sum, (x2 - x1)::BIGINT AS w, (y2 - y1)::BIGINT AS h FROM images i LEFT JOIN gt_boxes g USING (image_id)", "images", "gt_boxes"))
def k1(spark: SparkSession, d: str) -> DataFrame:
    images = frame(spark, d, "images").withColumn("split", F.lit("train"))
    text = sinks.label_text(images, frame(spark, d, "gt_boxes"))
    lines = text.select("image_id", F.explode(F.split("value", "\n")).alias("value"))
    parsed = lines.select("image_id", *[c.alias(n) for n, c in readers.parse_label_line(F.col("value")).items()])
    # six decimals give the pixels back exactly
    return parsed.select("image_id", "class_id", *[F.round(F.col(c) * k).cast("bigint").alias(n) for n, c, k in (("x_sum", "cx", 2560), ("y_sum", "cy", 1440), ("w", "w", 1280), ("h", "h", 720))])


@query("s3_read_labels", sql("SELECT CAST(class_id AS INT) AS class_id, count(*) AS n FROM gt_boxes GROUP BY 1", "gt_boxes"))
def s3(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    text = sinks.label_text(frame(spark, d, "images").withColumn("split", F.lit("train")), frame(spark, d, "gt_boxes"))
    text.filter("value <> ''").select("value").write.text(folder)
    return readers.read_labels(spark, folder).groupBy("class_id").agg(F.count("*").alias("n"))


@query("s5_read_mask_runs", sql("SELECT CAST(image_id AS VARCHAR) AS image_id, count(*) AS n_runs, sum(x_end - x_start)::BIGINT AS n_pixels, count(DISTINCT segment_id) AS n_segments FROM mask_runs GROUP BY 1", "mask_runs"))
def s5_runs(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    runs = frame(spark, d, "mask_runs")
    runs.select(F.col("image_id").cast("string").alias("image_id"), *[F.col(c).cast("int").alias(c) for c in ("y", "x_start", "x_end")], F.col("segment_id").cast("bigint").alias("segment_id")).write.parquet(folder)
    found = readers.read_mask_runs(spark, folder).groupBy("image_id")
    return found.agg(F.count("*").alias("n_runs"), F.sum(F.col("x_end") - F.col("x_start")).alias("n_pixels"), F.count_distinct("segment_id").alias("n_segments"))


@query("s2_read_voc", sql(f"SELECT {NAME} AS name, count(*) AS n, sum(x1)::DOUBLE AS sum_x1 FROM raw_boxes WHERE {NAME} <> '' GROUP BY 1", "raw_boxes"))
def s2(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    box = F.struct(*[F.col(a).alias(b) for a, b in (("x1", "xmin"), ("y1", "ymin"), ("x2", "xmax"), ("y2", "ymax"))])
    named = frame(spark, d, "raw_boxes").filter("trim(category) <> ''")
    named.groupBy("image_id").agg(F.collect_list(F.struct(F.col("category").alias("name"), box.alias("bndbox"))).alias("object")).drop("image_id").write.format("xml").option("rowTag", "annotation").option("maxRecordsPerFile", FILE_ROWS).save(folder)
    return readers.read_voc(spark, folder).groupBy("name").agg(F.count("*").alias("n"), F.sum("x1").alias("sum_x1"))


@query("s1_read_frames", sql("SELECT weather_raw AS weather, count(*) AS n FROM raw_boxes JOIN images USING (image_id) GROUP BY 1", "raw_boxes", "images"))
def s1(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    labels = frame(spark, d, "raw_boxes").groupBy("image_id").agg(F.collect_list(F.struct("category", F.struct("x1", "y1", "x2", "y2").alias("box2d"))).alias("labels"))
    parts = max(7, -(-labels.count() // 1000))  # about 1000 frames at most in an array
    images = frame(spark, d, "images").select("image_id", F.struct(F.col("weather_raw").alias("weather"), "timeofday").alias("attributes"))
    rows = images.join(labels, "image_id").select(F.pmod(F.xxhash64("image_id"), F.lit(parts)).alias("part"), F.struct(F.col("image_id").cast("string").alias("name"), "attributes", "labels").alias("frame"))
    arrays = rows.groupBy("part").agg(F.to_json(F.collect_list("frame"), {"pretty": "true"}).alias("value")).select("value")
    arrays.write.option("maxRecordsPerFile", 1).text(folder)  # a file for each array, in one folder
    return readers.read_frame_labels(spark, folder).groupBy("weather").agg(F.count("*").alias("n"))


@query("s7_read_manifest", sql("SELECT source, weather_raw AS weather, count(*) AS n FROM images GROUP BY 1, 2", "images"))
def s7(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    images = frame(spark, d, "images").select(F.lit("train").alias("split"), "source", F.col("weather_raw").alias("weather"), F.col("image_path").alias("output_image"))
    sinks.write_manifest(images.filter("source = 'bdd'"), f"{folder}/a")
    sinks.write_manifest(images.filter("source <> 'bdd'").withColumnRenamed("output_image", "image"), f"{folder}/b")
    both = readers.merge_manifests([readers.read_manifest(spark, f"{folder}/a"), readers.read_manifest(spark, f"{folder}/b")])
    return both.groupBy("source", "weather").agg(F.count("image").alias("n"))


@query("k3_statistics", sql("SELECT 'weather' AS kind, weather_raw AS name, count(*) AS n FROM images GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM images GROUP BY 2", "images"))
def k3(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    images = frame(spark, d, "images")
    count = lambda c: images.groupBy(c).agg(F.count("*").alias("n"))
    sinks.write_json(sinks.statistics({"weather": count("weather_raw"), "source": count("source")}), folder)
    row = spark.read.schema("weather MAP<STRING, BIGINT>, source MAP<STRING, BIGINT>").json(folder)
    parts = [row.select(F.lit(k).alias("kind"), F.explode(k).alias("name", "n")) for k in ("weather", "source")]
    return parts[0].union(parts[1])


@query("s8_read_metrics", sql("SELECT run, map50, map50_95 FROM run_metrics", "run_metrics"))
def s8(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    runs = frame(spark, d, "run_metrics").select("run", "map50", "map50_95")
    parts = 2 + runs.count() // 1000  # about 1000 runs at most in an array
    arrays = runs.groupBy(F.pmod(F.xxhash64("run"), F.lit(parts)).alias("part")).agg(F.to_json(F.collect_list(F.struct(*runs.columns))).alias("value"))
    arrays.write.partitionBy("part").text(folder)
    paths = {f"part {k}": f"{folder}/part={k}" for k in range(parts + 1)}  # and one that isn't there
    found, missing = readers.read_metrics(spark, paths)
    if f"part {parts}" not in missing:
        raise ValueError("a run without metrics was found")
    return found.select("run", "map50", "map50_95")


@query("s9_read_history", sql("SELECT CAST(run_id AS VARCHAR) AS run_id, epoch, map50_95 FROM history", "history"))
def s9(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    rows = frame(spark, d, "history").groupBy("run_id").agg(F.collect_list(F.struct("epoch", "map50_95")).alias("history"))
    rows.write.partitionBy("run_id").json(folder)
    return readers.read_history(spark, folder).select("run_id", "epoch", "map50_95")


@query("s10_read_image_list", sql("SELECT image_path FROM images WHERE source IN ('bdd', 'acdc')", "images"))
def s10(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    images = frame(spark, d, "images")
    for source in ("bdd", "acdc"):
        images.filter(F.col("source") == source).select("image_path").write.text(f"{folder}/{source}.txt")
    return readers.read_image_list(spark, [f"{folder}/bdd.txt", f"{folder}/acdc.txt"])


@query("k4_replaced_output", sql("SELECT image_id FROM images WHERE source = 'bdd'", "images"))
def k4(spark: SparkSession, d: str) -> DataFrame:
    """A second write is refused, and a clean one leaves nothing of the first."""
    from pyspark.errors import AnalysisException

    folder = _folder(spark)
    images = frame(spark, d, "images").select("image_id", "source")
    sinks.write_json(images.filter("source <> 'bdd'"), folder)
    try:
        sinks.write_json(images.filter("source = 'bdd'"), folder)
    except AnalysisException:
        sinks.write_json(images.filter("source = 'bdd'"), folder, clean=True)
    return spark.read.schema("image_id BIGINT").json(folder)


@query("k8_split_layout", sql("SELECT i.split, i.image_id, count(g.gt_idx) AS n_lines, coalesce(sum(g.class_id), 0)::BIGINT AS sum_class FROM (SELECT image_id, CASE WHEN image_id % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM images) i LEFT JOIN gt_boxes g USING (image_id) GROUP BY 1, 2", "images", "gt_boxes"))
def k8(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    images = frame(spark, d, "images").withColumn("split", F.expr("CASE WHEN image_id % 10 = 0 THEN 'val' ELSE 'train' END"))
    sinks.write_label_tables(images, frame(spark, d, "gt_boxes"), folder)
    tables = spark.read.option("sep", "\t").schema("image_id BIGINT, line STRING, split STRING").csv(folder)
    parsed = tables.select("split", "image_id", readers.parse_label_line(F.col("line"))["class_id"].alias("class_id"))
    return parsed.groupBy("split", "image_id").agg(F.count("class_id").alias("n_lines"), F.coalesce(F.sum("class_id"), F.lit(0)).alias("sum_class"))


@query("s11_read_predictions", sql("SELECT class_id, count(*) AS n, round(sum(conf), 3) AS sum_conf FROM predictions GROUP BY 1", "predictions"))
def s11(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    frame(spark, d, "predictions").write.parquet(folder)
    return readers.read_predictions(spark, folder).groupBy("class_id").agg(F.count("*").alias("n"), F.round(F.sum("conf"), 3).alias("sum_conf"))


def _write_panoptic(spark: SparkSession, d: str, folder: str) -> None:
    segments = frame(spark, d, "mask_runs").select("image_id", "segment_id").distinct()
    info = F.struct(F.col("segment_id").alias("id"), (F.col("segment_id") % 5).cast("int").alias("category_id"))
    notes = segments.groupBy("image_id").agg(F.collect_list(info).alias("segments_info"))
    categories = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(f"c{k}").alias("name")) for k in range(5)])
    note = F.struct(F.concat(F.col("image_id").cast("string"), F.lit("_gt_panoptic.png")).alias("file_name"), "segments_info")
    parts = max(7, -(-segments.select("image_id").distinct().count() // 1000))  # about 1000 images at most in a file
    notes.groupBy(F.pmod(F.xxhash64("image_id"), F.lit(parts)).alias("part")).agg(F.collect_list(note).alias("annotations")).select("part", categories.alias("categories"), "annotations").write.partitionBy("part").json(folder)


@query("s4_read_panoptic", sql("SELECT category_name, count(*) AS n FROM (SELECT DISTINCT image_id, segment_id, 'c' || CAST(segment_id % 5 AS VARCHAR) AS category_name FROM mask_runs) GROUP BY 1", "mask_runs"))
def s4(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    _write_panoptic(spark, d, folder)
    return readers.read_panoptic(spark, f"{folder}/*").groupBy("category_name").agg(F.count("*").alias("n"))


@query("k7_error_reports", sql(f"{ERRORS} SELECT class_name, error_type, count(*) AS n FROM s GROUP BY 1, 2", *BASE))
def k7(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    sinks.write_errors({"errors": errors.error_table(frame(spark, d, "predictions"), frame(spark, d, "gt_boxes"))}, folder)
    return spark.read.option("header", True).csv(f"{folder}/errors").groupBy("class_name", "error_type").agg(F.count("*").alias("n"))


@query("k6_detection_export", sql("SELECT class_name AS class, count(*) AS count FROM frame_detections GROUP BY 1", "frame_detections"))
def k6(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    sinks.write_detections(frame(spark, d, "frame_detections"), folder)
    return spark.read.option("header", True).schema("class STRING, count BIGINT").csv(f"{folder}/counts")


@query("k8_label_files", sql("SELECT i.split, i.image_id || '.txt' AS name, count(g.gt_idx) AS n_lines, coalesce(sum(g.class_id), 0)::BIGINT AS sum_class FROM (SELECT image_id, CASE WHEN image_id % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM images) i LEFT JOIN gt_boxes g USING (image_id) GROUP BY 1, 2", "images", "gt_boxes"))
def k8_files(spark: SparkSession, d: str) -> DataFrame:
    """A text file for each image, read back by its name; empty ones too."""
    folder = _folder(spark)
    images = frame(spark, d, "images").withColumn("split", F.expr("CASE WHEN image_id % 10 = 0 THEN 'val' ELSE 'train' END"))
    sinks.write_label_files(images, frame(spark, d, "gt_boxes"), folder)
    texts = readers.read_files(readers.list_inventory(spark, f"{folder}/labels", (".txt",)))
    parts = F.split("image_path", "/")
    classes = F.filter(F.transform(F.split("value", "\n"), lambda line: readers.parse_label_line(line)["class_id"]), lambda k: k.isNotNull())
    n_lines, sum_class = F.size(classes).cast("bigint"), F.aggregate(classes, F.lit(0).cast("bigint"), lambda a, k: a + k)
    return texts.select(F.element_at(parts, -2).alias("split"), F.element_at(parts, -1).alias("name"), n_lines.alias("n_lines"), sum_class.alias("sum_class"))


SUFFIXES = "['.jpg', '.JPEG', '.png', '.Bmp', '.webp', '.txt', ''][(image_id % 7)::INT + 1]"


@query("s6_image_inventory", sql(f"SELECT source || '/' || weather_raw || '/' || image_id || {SUFFIXES} AS image FROM images WHERE image_id % 7 < 5", "images"))
def s6(spark: SparkSession, d: str) -> DataFrame:
    """Files of several suffixes in a tree of folders, listed by the executors."""
    folder = f"{_folder(spark)}/tree"
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".jpg", ".JPEG", ".png", ".Bmp", ".webp", ".txt", "")]), (F.col("image_id") % 7 + 1).cast("int"))
    name = F.concat("source", F.lit("/"), "weather_raw", F.lit("/"), F.col("image_id").cast("string"), suffix)
    label_files.write_files(frame(spark, d, "images").select(name.alias("name"), F.lit("").alias("value")), folder, linked=True)
    return readers.list_inventory(spark, folder).select(F.element_at(F.split("image_path", "/tree/"), -1).alias("image"))


@query("s4_panoptic_fallback", sql("SELECT category_name, count(*) AS n FROM (SELECT DISTINCT image_id, segment_id, 'c' || CAST(segment_id % 5 AS VARCHAR) AS category_name FROM mask_runs) GROUP BY 1", "mask_runs"))
def s4_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Files below folders for each condition, read where the root has none."""
    folder = _folder(spark)
    _write_panoptic(spark, d, f"{folder}/conditions")
    return readers.read_panoptic(spark, f"{folder}/*_panoptic.json", f"{folder}/conditions/*").groupBy("category_name").agg(F.count("*").alias("n"))


@query(
    "k7_summary_reports",
    sql(
        f"""{ERRORS} SELECT 'class' AS report, class_name AS name, count_if(error_type IN ('true_positive', 'loose_box', 'missed_object'))::BIGINT AS n_gt, count_if(error_type IN ('true_positive', 'loose_box'))::BIGINT AS n_found FROM s GROUP BY 2
UNION ALL SELECT 'size', size_bucket, count(*)::BIGINT, count_if(error_type <> 'missed_object')::BIGINT FROM s WHERE error_type IN ('true_positive', 'loose_box', 'missed_object') GROUP BY 2
UNION ALL SELECT 'dataset', 'all', count_if(error_type IN ('true_positive', 'loose_box', 'missed_object'))::BIGINT, count_if(error_type IN ('true_positive', 'loose_box'))::BIGINT FROM s""",
        *BASE,
    ),
)
def k7_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The reports by class, by size and of the dataset, written and read back."""
    folder = _folder(spark)
    table = errors.tally(errors.error_table(frame(spark, d, "predictions"), frame(spark, d, "gt_boxes")))
    sinks.write_errors({"class": errors.by_class(table), "size": errors.by_size(table), "dataset": errors.summary(table)}, folder)
    read = lambda name: spark.read.option("header", True).csv(f"{folder}/{name}")
    found = (F.col("true_positive").cast("bigint") + F.col("loose_box").cast("bigint")).alias("n_found")
    row = lambda name, of, n_gt, n_found: read(name).select(F.lit(name).alias("report"), of.alias("name"), n_gt.cast("bigint").alias("n_gt"), n_found.cast("bigint").alias("n_found"))
    by_class = row("class", F.col("class_name"), F.col("n_gt"), found)
    by_size = row("size", F.col("size_bucket"), F.col("n_gt"), F.col("n_found"))
    return by_class.union(by_size).union(row("dataset", F.lit("all"), found + F.col("missed_object").cast("bigint"), found))


@query(
    "k6_export_files",
    sql(
        """SELECT 'detections' AS output, count(*) AS n, round(avg(conf), 3) AS mean FROM frame_detections
UNION ALL SELECT 'summary', count(*), round(avg(conf), 3) FROM frame_detections UNION ALL SELECT 'report', count(*), round(avg(conf), 3) FROM frame_detections""",
        "frame_detections",
    ),
)
def k6_files(spark: SparkSession, d: str) -> DataFrame:
    """The export's table, its summary as JSON and its report as text, read back."""
    folder = _folder(spark)
    sinks.write_detections(frame(spark, d, "frame_detections"), folder)
    row = lambda name, rows, n, mean: rows.select(F.lit(name).alias("output"), n.alias("n"), mean.alias("mean"))
    table = spark.read.option("header", True).schema("class STRING, confidence DOUBLE").csv(f"{folder}/detections").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 3).alias("mean"))
    summary = spark.read.schema("total BIGINT, mean_confidence DOUBLE").json(f"{folder}/summary")
    number = lambda pattern, kind: F.regexp_extract("value", pattern, 1).cast(kind)
    report = spark.read.text(f"{folder}/report")
    rows = row("detections", table, F.col("n"), F.col("mean")).union(row("summary", summary, F.col("total"), F.col("mean_confidence")))
    return rows.union(row("report", report, number(r"^(\d+) detections", "bigint"), number(r"confidence ([\d.]+)$", "double")))
