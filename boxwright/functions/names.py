"""Paths and file names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(.)\.[^.]*$", "$1")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def image_key(path: Column) -> Column:
    """The stem without the endings of image and mask files."""
    return F.regexp_replace(stem(path), "(_rgb_anon|_gt_panoptic)$", "")


def label_path(image_path: Column) -> Column:
    """The label file of an image: in ``labels`` for the last ``images`` part, with ``.txt``."""
    return F.regexp_replace(F.regexp_replace(image_path, "^(.*/|)images/", "$1labels/"), r"\.[^./]*$", ".txt")


def output_name(source: Column, weather: Column, relative_path: Column) -> Column:
    """A name that depends on nothing but the image's own place."""
    return F.concat_ws("_", source, weather, stem(relative_path), F.substring(F.sha1(relative_path), 1, 10))


def copy_name(name: Column, kind: str, number: Column) -> Column:
    """``kind``: os (repeated) or waug (varied) copies, with their number."""
    return F.concat(name, F.lit(f"_{kind}"), number.cast("string"))


def composite_name(name: Column, number: Column) -> Column:
    return F.format_string("cp_%05d_%s", number, name)
