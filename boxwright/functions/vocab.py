"""Class and weather vocabularies, as column functions.

Vocabularies are small and fixed, so they are literal maps: a lookup is one
expression in the scan's stage, without a join.  A caller may pass its own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: class ids are positions in this list
CLASSES = ("person", "bicycle", "car", "motorcycle", "bus", "truck")
RARE_CLASSES = ("bicycle", "motorcycle", "bus")
# fixed values: class names as each annotation source writes them
CLASS_ALIASES = {
    "person": "person", "pedestrian": "person", "rider": "person", "other person": "person", "people": "person",
    "bicycle": "bicycle", "bike": "bicycle", "motorcycle": "motorcycle", "motorbike": "motorcycle", "motor": "motorcycle",
    "car": "car", "bus": "bus", "truck": "truck",
}
DRIVING_ALIASES = {
    "person": "person", "rider": "person", "bike": "bicycle", "bicycle": "bicycle", "car": "car",
    "motor": "motorcycle", "motorcycle": "motorcycle", "bus": "bus", "truck": "truck",
}
VOC_ALIASES = {
    "pedestrian": "person", "people": "person", "person": "person", "bike": "bicycle", "bicycle": "bicycle",
    "motorbike": "motorcycle", "motor cycle": "motorcycle", "motorcycle": "motorcycle", "car": "car", "bus": "bus", "truck": "truck",
}
# fixed values: numeric class ids of two label sets, old to new
TEN_TO_SIX = {0: 0, 1: 0, 2: 2, 3: 4, 4: 5, 5: 1, 6: 3}
SIX_TO_SIX = {0: 0, 1: 2, 2: 5, 3: 3, 4: 4, 5: 1}
# fixed values: ids of a public city-scene label table
SEGMENT_CLASSES = {24: "person", 25: "rider", 26: "car", 27: "truck", 28: "bus", 31: "train", 32: "motorcycle", 33: "bicycle"}
# fixed values: weather names
WEATHER_ALIASES = {
    "clear": "clear", "clear-daytime": "clear", "daytime-clear": "clear", "partly cloudy": "clear", "overcast": "clear",
    "fog": "fog", "foggy": "fog", "rain": "rain", "rainy": "rain", "snow": "snow", "snowy": "snow",
    "sand": "sand", "sandstorm": "sand", "dust": "sand", "night": "night",
}
NAME_WEATHER_ALIASES = {
    "heavy_rain": "rain", "rain": "rain", "fog": "fog", "snow": "snow", "dust": "sand", "sand": "sand",
    "flooding": "flooding", "tornado": "tornado", "wildfire": "wildfire",
}
PATH_WEATHER = (("fog", "fog"), ("foggy", "fog"), ("rain", "rain"), ("rainy", "rain"), ("snow", "snow"), ("snowy", "snow"), ("sand", "sand"), ("dust", "sand"))
VOC_PATH_WEATHER = (("fog", "fog"), ("rain", "rain"), ("sand", "sand"), ("snow", "snow"))


def lookup(key: Column, table: Mapping) -> Column:
    """The table's value for a key, null where there is none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def normalize_class(name: Column, aliases: Mapping[str, str] = CLASS_ALIASES) -> Column:
    """Trimmed, lower-case name through the aliases; null for blank or unknown names."""
    return lookup(F.lower(F.trim(name)), aliases)


def class_id(class_name: Column) -> Column:
    return lookup(class_name, {c: k for k, c in enumerate(CLASSES)})


def class_name(class_id: Column) -> Column:
    return lookup(class_id.cast("int"), dict(enumerate(CLASSES)))


def remap_class(old: Column, table: Mapping[int, int]) -> Column:
    """A numeric class in another label set; parsed as a number, decimals cut; null where unmapped."""
    return lookup(old.cast("double").cast("int"), table)


def segment_class(segment_id: Column) -> Column:
    """Instance ids hold the class in their thousands, plain ids are the class."""
    return lookup(F.when(segment_id >= 1000, F.floor(segment_id / 1000)).otherwise(segment_id).cast("int"), SEGMENT_CLASSES)


def normalize_weather(raw: Column, aliases: Mapping[str, str] = WEATHER_ALIASES) -> Column:
    """Trimmed, lower case, with spaces for ``_`` and ``-``; its alias or itself; ``unknown`` for null or empty (spaces only give an empty text)."""
    plain = F.translate(F.lower(F.trim(raw)), "_-", "  ")
    return F.when(raw.isNull() | (raw == ""), "unknown").otherwise(F.coalesce(lookup(plain, aliases), plain))


def weather_from_path(path: Column, keywords: tuple[tuple[str, str], ...] = PATH_WEATHER) -> Column:
    """The weather of the first keyword, in the table's order, that the path holds."""
    low, out = F.lower(path), F.lit("unknown")
    for word, weather in reversed(keywords):
        out = F.when(low.contains(word), weather).otherwise(out)
    return out


def weather_from_name(stem: Column, aliases: Mapping[str, str] = NAME_WEATHER_ALIASES) -> Column:
    """What stands before ``_train_``, ``_valid_`` or ``_test_`` in a file's stem."""
    head = F.lower(F.split(stem, "_(?:train|valid|test)_", 2)[0])
    return F.coalesce(lookup(head, aliases), head)


def capture_condition(weather: Column, timeofday: Column) -> Column:
    """Foggy before snowy before rainy before dawn or dusk before night; else other. Trimmed, in any case."""
    w, t = F.lower(F.trim(weather)), F.lower(F.trim(timeofday))
    return (
        F.when(w.isin("foggy", "snowy", "rainy"), w)
        .when(t == "dawn/dusk", "dawn_dusk")
        .when(t == "night", "night")
        .otherwise("other")
    )


def source_of_name(name: Column) -> Column:
    out = F.lit("other")
    for source in ("bdd", "acdc", "xwod"):
        out = F.when(name.startswith(f"{source}_"), source).otherwise(out)
    return out
