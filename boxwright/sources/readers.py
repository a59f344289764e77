"""Readers of annotation, manifest, metrics and prediction files. Schemas are always given, never inferred."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Mapping
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.functions import names as N
from boxwright.operators.prepare import explode_labels
from boxwright.session import checkpoint_dir, ship_package
from boxwright.sources.json_arrays import read_json_arrays
from boxwright.sources.label_files import dealt, open_store

BOX = "STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>"
FRAMES = f"name STRING, attributes STRUCT<weather: STRING, timeofday: STRING, scene: STRING>, labels ARRAY<STRUCT<category: STRING, box2d: {BOX}>>"
VOC = "object ARRAY<STRUCT<name: STRING, bndbox: STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE>>>"
PANOPTIC = "categories ARRAY<STRUCT<id: INT, name: STRING>>, annotations ARRAY<STRUCT<file_name: STRING, segments_info: ARRAY<STRUCT<id: BIGINT, category_id: INT>>>>"
METRICS = (
    "run STRING, config STRING, weights STRING, split STRING, precision DOUBLE, recall DOUBLE, map50 DOUBLE, map50_95 DOUBLE, inference_ms DOUBLE, fps DOUBLE, "
    "inference_ms_batch1 DOUBLE, fps_batch1 DOUBLE, parameters BIGINT, per_class MAP<STRING, STRUCT<map50: DOUBLE, map50_95: DOUBLE>>, per_class_map50_95 MAP<STRING, DOUBLE>"
)
HISTORY = "history ARRAY<STRUCT<epoch: INT, train_loss: DOUBLE, precision: DOUBLE, recall: DOUBLE, map50: DOUBLE, map50_95: DOUBLE, mar_100: DOUBLE>>, best_map50_95 DOUBLE"
PREDICTIONS = "image_id BIGINT, pred_idx BIGINT, class_id INT, conf DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
MASK_RUNS = "image_id STRING, y INT, x_start INT, x_end INT, segment_id BIGINT"
# fixed values
#: Entries of a folder that are listed at once.
LISTED = 10_000
#: Bytes of text in a batch, about.
BLOCK = 1_000_000
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp")


def read_frames(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Frames with nested labels from JSON arrays; a large file is read by several tasks."""
    frames = read_json_arrays(spark, path, FRAMES)
    return frames.repartition(partitions) if partitions else frames


def read_frame_labels(spark: SparkSession, path: str) -> DataFrame:
    return explode_labels(read_frames(spark, path))


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    """One row per object of each XML file: its stem, name (trimmed, lower case) and box.

    Objects without a box are skipped; a missing coordinate is 0; a file without
    objects gives one row of nulls.
    """
    files = spark.read.format("xml").option("rowTag", "annotation").schema(VOC).load(path).select(N.stem(F.col("_metadata.file_path")).alias("stem"), "object")
    rows = files.select("stem", F.explode_outer("object").alias("o"), (F.coalesce(F.size("object"), F.lit(0)) <= 0).alias("none"))
    corner = lambda a: F.coalesce(F.col(f"o.bndbox.{a}"), F.when(F.col("o.bndbox").isNotNull(), F.lit(0.0)))
    box = {"x1": "xmin", "y1": "ymin", "x2": "xmax", "y2": "ymax"}
    return rows.filter(F.col("none") | F.col("o.bndbox").isNotNull()).select("stem", F.lower(F.trim("o.name")).alias("name"), *[corner(b).alias(a) for a, b in box.items()])


def parse_label_line(line: Column) -> dict[str, Column]:
    parts = F.split(F.trim(line), r"\s+")
    # try_cast: a line with words is malformed, not a failed job
    number = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    return {"n_tokens": F.size(parts), "class_id": number(0).cast("int"), "cx": number(1), "cy": number(2), "w": number(3), "h": number(4)}


def read_labels(spark: SparkSession, path: str, exactly: bool = True) -> DataFrame:
    """S3: stem, line, class_id, cx, cy, w, h of label text files: lines of exactly five tokens, or at least five."""
    lines = spark.read.text(path).select(N.stem(F.col("_metadata.file_path")).alias("stem"), "value")
    rows = lines.select("stem", F.col("value").alias("line"), *[c.alias(n) for n, c in parse_label_line(F.col("value")).items()])
    return rows.filter(F.col("n_tokens") == 5 if exactly else F.col("n_tokens") >= 5).filter("class_id is not null and h is not null").drop("n_tokens")


def read_panoptic(spark: SparkSession, root_path: str, fallback_path: str | None = None) -> DataFrame:
    """Key, segment_id, category_id, category_name; per-condition files only where the root has none; the later file wins a key.

    A file that isn't JSON gives no rows; neither path there is an error.
    """
    if fallback_path is not None and not path_exists(spark, root_path):
        root_path, fallback_path = fallback_path, None

    def rows(path: str) -> DataFrame:
        files = spark.read.schema(PANOPTIC).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.col("_metadata.file_path"))
        names = F.map_from_entries(F.transform("categories", lambda c: F.struct(c["id"], c["name"])))
        notes = files.select("file", names.alias("names"), F.explode("annotations").alias("a")).withColumn("key", N.image_key(F.col("a.file_name")))
        w = Window.partitionBy("key").orderBy(F.desc("file"))
        last = notes.withColumn("k", F.row_number().over(w)).filter("k = 1")
        parts = last.select("key", "names", F.explode("a.segments_info").alias("s"))
        return parts.select("key", F.col("s.id").alias("segment_id"), "s.category_id", F.element_at("names", F.col("s.category_id")).alias("category_name"))

    found = rows(root_path)
    return found if fallback_path is None or not found.isEmpty() else rows(fallback_path)


def read_mask_runs(spark: SparkSession, path: str) -> DataFrame:
    """S5."""
    return spark.read.schema(MASK_RUNS).parquet(path)


def list_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Paths below a folder with an image suffix, in any case. Contents aren't read.

    The driver lists the folder; ``list_inventory`` has the executors do it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path")
    return files.filter(N.suffix(F.col("path")).isin(*IMAGE_SUFFIXES)).select(F.col("path").alias("image_path"))


def list_inventory(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """Like ``list_images``, listed by the executors.

    The folders of one level are rows; tasks list them, which gives files and the
    folders of the next level, until there are none.  The tree is as deep as
    rounds are run, and no machine sees more than its folders, of which each task
    has about as many as the others, however short their paths.  Each level is
    checkpointed.  A path that isn't there is an error.  Empty files are listed too.
    """
    checkpoint_dir(spark)
    schema = pa.schema([("path", pa.string()), ("is_folder", pa.bool_())])

    def table(head: str, found: list[tuple[str, bool]]) -> pa.RecordBatch:
        paths, folders = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([head + x for x in paths], pa.string()), pa.array(folders, pa.bool_())], schema=schema)

    def list_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(folder)
                head = folder.removesuffix(at) if folder.endswith(at) else ""
                if isinstance(system, fs.LocalFileSystem):  # a folder is read bit by bit
                    with os.scandir(at) as entries:
                        while found := [(x.path, x.is_dir()) for x in islice(entries, LISTED)]:
                            yield table(head, found)
                else:
                    found = [(x.path, x.type == fs.FileType.Directory) for x in system.get_file_info(fs.FileSelector(at))]
                    for k in range(0, len(found), LISTED):
                        yield table(head, found[k : k + LISTED])

    level = spark.range(1).select(F.lit(path.rstrip("/")).alias("path"))
    found, n = None, 1
    while True:
        parts = min(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
        listed = level.repartitionByRange(parts, "path").mapInArrow(list_, "path string, is_folder boolean").checkpoint()
        files = listed.filter(~F.col("is_folder") & N.suffix(F.col("path")).isin(*suffixes)).select(F.col("path").alias("image_path"))
        found = files if found is None else found.union(files)
        level = listed.filter("is_folder").select("path")
        n = level.count()
        if not n:
            return found


def read_files(files: DataFrame, path: str = "image_path") -> DataFrame:
    """The path and whole text (``value``) of each listed file, empty ones too, read by the tasks; one that isn't there is an error.

    Spark's reader of whole files lists them on the driver, opens a task for
    every 32 small ones, and leaves out the empty ones.
    """
    ship_package(files.sparkSession)
    schema = pa.schema([(path, pa.string()), ("value", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[fs.FileSystem, str]] = {}
        for batch in batches:
            texts, size = [], 0
            for file in batch.column(0).to_pylist():
                folder, _, name = file.rpartition("/")
                if folder not in known:
                    known[folder] = open_store(folder)
                system, at = known[folder]
                with system.open_input_stream(f"{at}/{name}", compression=None) as stream:
                    texts.append({path: file, "value": stream.read()})
                size += len(texts[-1]["value"])
                if size > BLOCK:
                    yield pa.RecordBatch.from_pylist(texts, schema=schema)
                    texts, size = [], 0
            yield pa.RecordBatch.from_pylist(texts, schema=schema)

    found = dealt(files.select(F.col(path).cast("string").alias(path)), path).mapInArrow(read, f"{path} string, value binary")
    return found.withColumn("value", F.col("value").cast("string"))


def read_manifest(spark: SparkSession, path: str, required: Iterable[str] = ("split", "weather")) -> DataFrame:
    """A manifest of any kind with its image column as ``image``; a missing required column is an error."""
    rows = spark.read.option("header", True).csv(path)
    image = next((c for c in ("image", "output_image") if c in rows.columns), None)
    missing = [c for c in required if c not in rows.columns] + ([] if image else ["image"])
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return rows.withColumnRenamed(image, "image")


def merge_manifests(manifests: Iterable[DataFrame]) -> DataFrame:
    """Manifests of several kinds by column name, nulls where a kind lacks one."""
    first, *rest = manifests
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern matches anything, on whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_metrics(spark: SparkSession, runs: Mapping[str, str]) -> tuple[DataFrame, list[str]]:
    """Metrics of the runs (name to path) whose file is there, and the names of the others; none at all is an error."""
    known = {name: path for name, path in runs.items() if path_exists(spark, path)}
    if not known:
        raise ValueError("no run has metrics")
    return spark.read.schema(METRICS).option("multiLine", True).json(list(known.values())), sorted(set(runs) - set(known))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """One row per run and epoch. A run is its file's stem, or its folder's ``run_id=...`` where there are such folders."""
    files = spark.read.schema(HISTORY).option("multiLine", True).json(path)
    run = F.col("run_id").cast("string") if "run_id" in files.columns else N.stem(F.col("_metadata.file_path"))
    files = files.select(run.alias("run_id"), "history")
    return files.select("run_id", F.inline("history"))


def read_image_list(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Images of ``.txt`` lists and folders together."""
    parts = [spark.read.text(p).select(F.trim("value").alias("image_path")).filter("image_path <> ''") if p.endswith(".txt") else list_images(spark, p) for p in paths]
    first, *rest = parts
    for other in rest:
        first = first.union(other)
    return first


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """S11."""
    return spark.read.schema(PREDICTIONS).parquet(path)


def with_dataset_paths(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """``rows`` with the ``path`` of their ``dataset`` from a table (dataset, path); an unknown one stops the job and is named."""
    unknown = F.raise_error(F.concat(F.lit("unknown dataset: "), F.coalesce("dataset", F.lit("null")))).cast("string")
    return rows.join(registry.select("dataset", F.col("path").alias("_path")), "dataset", "left").withColumn("path", F.coalesce("_path", unknown)).drop("_path")


def dataset_path(registry: Mapping[str, str], key: str) -> str:
    """A dataset's path; an unknown key is an error that names the known ones."""
    if key not in registry:
        raise KeyError(f"unknown dataset {key!r}; known: {', '.join(sorted(registry))}")
    return registry[key]
