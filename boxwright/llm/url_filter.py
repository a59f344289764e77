"""URL rules through a cascade of Bloom filters, in DataFrame operations only.

A rule is a host and a path, as in ``example.com/en/``; it fits its host and all
subdomains where the url's path starts with the rule's.  Every url has a few
keys that could be rules: each suffix of its host with each prefix of its path
that is as long as some rule's path.  The key universe is all keys of all urls.

A cascade gives exact membership over that universe.  Level 1 is a Bloom filter
of the listed keys; level 2 encodes the other keys that pass level 1; level 3
the listed keys that pass level 2, and so on until a level has nothing to
encode.  A key is listed if the first level that refuses it is an even one (or
none refuses it and the last is an odd one).  Filters are sized by what they
encode; level 1 as such that level 2 is about as large, so the whole cascade is
proportional to the rule list, whatever the corpus.  The list is the driver's;
urls meet no join.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.session import checkpoint_dir

#: Bits that a cascade may have in all; more rules than fit in them are refused.
MOST_BITS = 1 << 24


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case; "" for null and without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What stands from the host's end to the next ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass
class Level:
    words: list[int]  # 32 bits in each
    hashes: int

    @property
    def bits(self) -> int:
        return 32 * len(self.words)


def _place(key_hash: Column, level: int, i: Column, bits: int) -> Column:
    """The bit of a level's hash function ``i``; levels are independent of each other."""
    return F.pmod(F.xxhash64(key_hash, F.lit(level), i), F.lit(bits))


def _one_bit(bit: Column) -> Column:
    """The word in which only this bit is set."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(bit, F.lit(32)).cast("int"))


def _level(keys: DataFrame, n: int, number: int, share: float) -> Level:
    """A filter of the column ``key`` that passes about this share of others."""
    bits = max(32, 32 * math.ceil(n * math.log(1 / share) / math.log(2) ** 2 / 32))
    hashes = max(1, round(bits / n * math.log(2)))
    if bits > MOST_BITS:
        raise ValueError(f"a level needs {bits} bits; {MOST_BITS} are allowed")
    places = F.transform(F.sequence(F.lit(1), F.lit(hashes)), lambda i: _place(F.xxhash64("key"), number, i, bits))
    words = (
        keys.select(F.explode(places).alias("bit"))
        .groupBy(F.floor(F.col("bit") / 32).cast("int").alias("word"))
        .agg(F.bit_or(_one_bit(F.col("bit"))).alias("value"))
    )
    found = {r.word: r.value for r in words.collect()}  # bits / 32 rows at most
    return Level([found.get(k, 0) for k in range(bits // 32)], hashes)


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def _passes(self, key_hash: Column, number: int) -> Column:
        level = self.levels[number]
        words = F.from_json(F.lit(str(level.words)), "array<bigint>")  # a constant, folded once

        def is_set(i: Column) -> Column:
            bit = _place(key_hash, number, i, level.bits)
            return F.element_at(words, (F.floor(bit / 32) + 1).cast("int")).bitwiseAND(_one_bit(bit)) != 0

        return F.forall(F.sequence(F.lit(1), F.lit(level.hashes)), is_set)

    def contains(self, key_hash: Column) -> Column:
        """Whether a key of the universe, given by its xxhash64, is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            out = F.when(self._passes(key_hash, k), out).otherwise(F.lit(k % 2 == 1))
        return out


def build_cascade(universe: DataFrame, listed: Iterable[str]) -> Cascade:
    """The cascade of ``listed`` over the distinct values of ``universe``'s column ``key``.

    Listed keys outside the universe are encoded too.  An empty list gives a
    cascade that contains nothing.
    """
    spark = universe.sparkSession
    checkpoint_dir(spark)
    names = sorted(set(listed))
    if not names:
        return Cascade()
    # one constant, which Spark reads; not a literal for each name
    inside = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(names)), "array<string>")).alias("key"))
    outside = _minus(universe.select("key").filter("key is not null"), inside).checkpoint()
    cascade, yes, no = Cascade(), inside, outside
    n_yes, n_no = len(names), outside.count()
    while True:
        share = 0.5 if cascade.levels else min(0.5, max(1e-6, n_yes / (math.sqrt(2) * max(n_no, 1))))
        cascade.levels.append(_level(yes, n_yes, len(cascade.levels), share))
        wrong = no.filter(cascade._passes(F.xxhash64("key"), len(cascade.levels) - 1)).checkpoint()
        n_wrong = wrong.count()
        if not n_wrong:
            return cascade
        if len(cascade.levels) == 64:
            raise ValueError("two keys have the same hash")
        yes, no, n_yes, n_no = wrong, yes, n_wrong, n_yes


def _minus(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """Keys that aren't listed, by one grouping."""
    tagged = keys.withColumn("l", F.lit(0)).union(listed.withColumn("l", F.lit(1)))
    return tagged.groupBy("key").agg(F.max("l").alias("l")).filter("l = 0").select("key")


def candidate_keys(host: Column, path: Column, depth: int, lengths: list[int]) -> Column:
    """All keys of a url that rules of at most ``depth`` host labels and of these path lengths could have."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    first = F.greatest(F.lit(1), n - depth + 1)
    hosts = F.transform(F.sequence(first, n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths]))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    return F.when(host != "", keys).otherwise(F.array().cast("array<string>"))


def judge_urls(
    pages: DataFrame,
    allow: Iterable[str],
    block: Iterable[str],
    blocked_hosts: Iterable[str] = (),
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    The longest fitting rule decides; urls that no rule fits are blocked if
    their host, or a domain above it, is in ``blocked_hosts``, and else allowed.
    A rule in both lists blocks.  Every list goes through a cascade of its own.

    A null url, or one without ``://``, has an empty host and path, fits no rule
    and is allowed.  Null ids stay null; repeated rows are judged alike; an empty
    table gives no rows; empty lists allow everything.  Urls may be long: a url
    has at most as many keys as the longest rule has labels times the number of
    different path lengths of rules.  Other columns are ignored.
    """
    block, blocked_hosts = set(block), set(blocked_hosts)
    allow = set(allow) - block
    rules = sorted(allow | block)
    depth = max([1, *(r.split("/")[0].count(".") + 1 for r in rules), *(h.count(".") + 1 for h in blocked_hosts)])
    lengths = sorted({len(r) - len(r.split("/")[0]) for r in rules})
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    keyed = out.withColumns({"_keys": candidate_keys(F.col("host"), F.col("path"), depth, lengths or [0]), "_hosts": candidate_keys(F.col("host"), F.lit(""), depth, [0])})
    # all keys of all urls once: a cascade that is exact over more keys than it is asked for is exact
    checkpoint_dir(pages.sparkSession)
    universe = keyed.select(F.explode(F.concat("_keys", "_hosts")).alias("key")).distinct().checkpoint()
    blocks, allows, hosts = build_cascade(universe, block), build_cascade(universe, allow), build_cascade(universe, blocked_hosts)
    hashed = F.transform("_keys", lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"), F.xxhash64(k).alias("h")))
    fits = F.filter(hashed, lambda x: blocks.contains(x["h"]) | allows.contains(x["h"]))
    named = keyed.withColumn("_longest", F.array_max(fits))
    listed = F.exists(F.transform("_hosts", lambda k: F.xxhash64(k)), hosts.contains)
    verdict = (
        F.when(F.col("_longest").isNotNull(), F.when(blocks.contains(F.col("_longest.h")), "block").otherwise("allow"))
        .when(listed, "block")
        .otherwise("allow")
    )
    return named.select("page_id", "host", "path", F.col("_longest.rule").alias("rule"), verdict.alias("verdict"))
