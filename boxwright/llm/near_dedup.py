"""Near-duplicate groups by MinHash with tensored banding, verified on full shingle sets.

A text is the set of its word shingles.  For one in ``m`` small collections of
``width`` minhashes each, a band is the collection's values; a table's key is a
*pair* of bands.  So m(m-1)/2 tables of 2 x width minhashes each come from only
m x width minhashes, and two texts share a table if they share two bands.

1. Equal sets are one class (128-bit fingerprints of the sets), with a number
   of its own that stands for it from here on; ids may repeat.
2. Bands that only one class has are dropped, and tables are made from the
   rest; tables with the same members are one.
3. In each table every class is compared with the table's leader; the links
   found give first components.
4. Tables that still hold several components: each class that isn't in the
   table's largest component (a guest) is compared with all the others of the
   table, in blocks of bounded size.  Links inside one component add nothing, so
   no group is expanded into all its pairs.
5. Components of the components.

A link that no table holds is missed; ``collections_for`` picks m so that this
has a stated probability for a pair right at the limit, and far less above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.llm.components import components
from boxwright.llm.textvec import blocks, buffer_of, lower_ascii, mix64, span_hashes, windows, word_spans
from boxwright.session import checkpoint_dir

#: Shingles of one side of a block of comparisons.
BLOCK_SHINGLES = 100_000
#: So many ids at most are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def collections_for(similarity: float, width: int, miss: float = 2e-5) -> int:
    """The least number of collections with which two texts of this similarity fail to share two bands with at most this probability."""
    p = similarity**width
    m = 2
    while (1 - p) ** m + m * p * (1 - p) ** (m - 1) > miss:
        m += 1
    return m


def _shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts in a row (repeated as they occur), and those before each text."""
    data = lower_ascii(data)
    starts, ends, before = word_spans(data, offsets)
    return windows(span_hashes(data, starts, ends), before, size)


def signatures(docs: DataFrame, size: int, m: int, width: int) -> DataFrame:
    """doc_id, n_shingles, a fingerprint of the set (f1, f2) and its m bands, from (doc_id, text)."""
    rng = np.random.default_rng(20_240_229)
    factors = rng.integers(0, 1 << 63, m * width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    terms = rng.integers(0, 1 << 63, m * width, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            for lo, hi in blocks(offsets):
                part = offsets[lo : hi + 1]
                hashes, begin = _shingles(data[part[0] : part[-1]], part - part[0], size)
                n = np.zeros(hi - lo, dtype=np.int64)
                f = np.zeros((2, hi - lo), dtype=np.uint64)
                bands = np.zeros((hi - lo, m), dtype=np.uint64)
                full = np.flatnonzero(np.diff(begin) > 0)
                with np.errstate(over="ignore"):
                    for k in full.tolist():
                        own = np.unique(hashes[begin[k] : begin[k + 1]])
                        n[k] = len(own)
                        f[:, k] = _fingerprint(own)
                    if len(full):
                        at = begin[full]
                        for i in range(m):
                            band = np.full(len(full), i + 1, dtype=np.uint64)
                            for j in range(i * width, (i + 1) * width):
                                least = np.minimum.reduceat(hashes * factors[j] + terms[j], at)
                                band = mix64(band * np.uint64(0x9E3779B97F4A7C15) + least)
                            bands[full, i] = band
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * m, type=pa.int32()), pa.array(bands.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(n), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), lists],
                    names=["doc_id", "n_shingles", "f1", "f2", "bands"],
                )

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>")


def _fingerprint(own: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits of a set of distinct hashes."""
    with np.errstate(over="ignore"):
        return mix64(own).sum(), mix64(own ^ np.uint64(0x5851F42D4C957F2D)).sum()


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, the set's fingerprint (f1, f2) and shingles (sorted distinct hashes) from (doc_id, text).

    A task gives equal (doc_id, f1, f2) once; several tasks may give them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            for lo, hi in blocks(offsets):
                part = offsets[lo : hi + 1]
                hashes, begin = _shingles(data[part[0] : part[-1]], part - part[0], size)
                keys, own = [], []
                for k, i in enumerate(batch.column(0)[lo:hi].to_pylist()):
                    found = np.unique(hashes[begin[k] : begin[k + 1]])
                    key = (i, *(int(f.view(np.int64)) for f in _fingerprint(found)))
                    if key not in seen:
                        seen.add(key)
                        keys.append(key)
                        own.append(found)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in own])])
                flat = np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64)
                ids = [pa.array([key[j] for key in keys], type=pa.int64()) for j in range(3)]
                yield pa.RecordBatch.from_arrays([*ids, pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(flat))], names=["doc_id", "f1", "f2", "shingles"])

    return docs.mapInArrow(run, "doc_id bigint, f1 bigint, f2 bigint, shingles array<bigint>")


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    flat_a, row_a = np.concatenate(a), np.repeat(np.arange(len(a)), [len(x) for x in a])
    flat_b, row_b = np.concatenate(b), np.repeat(np.arange(len(b)), [len(x) for x in b])
    both = np.intersect1d(flat_a, flat_b)
    if not len(both):
        return out
    at = np.minimum(np.searchsorted(both, flat_a), len(both) - 1)
    has = both[at] == flat_a
    v_a, row_a = at[has], row_a[has]
    at = np.minimum(np.searchsorted(both, flat_b), len(both) - 1)
    has = both[at] == flat_b
    v_b, row_b = at[has], row_b[has]
    n_a, n_b = np.bincount(v_a, minlength=len(both)), np.bincount(v_b, minlength=len(both))
    often = np.flatnonzero(n_a * n_b > 64)
    for k in range(0, len(often), 2048):  # shingles that many have: products of 0/1 matrices, in slices
        number = np.full(len(both), -1)
        number[often[k : k + 2048]] = np.arange(len(often[k : k + 2048]))
        left, right = np.zeros((len(a), 2048), np.float32), np.zeros((len(b), 2048), np.float32)
        x = number[v_a] >= 0
        left[row_a[x], number[v_a[x]]] = 1
        x = number[v_b] >= 0
        right[row_b[x], number[v_b[x]]] = 1
        out += (left @ right.T).astype(np.int64)
    seldom = n_a * n_b <= 64
    x = seldom[v_a]
    v_a, row_a = v_a[x], row_a[x]
    x = seldom[v_b]
    v_b, row_b = v_b[x], row_b[x]
    order = np.argsort(v_b, kind="stable")
    v_b, row_b = v_b[order], row_b[order]
    first = np.searchsorted(v_b, v_a)
    many = np.searchsorted(v_b, v_a, side="right") - first
    inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    np.add.at(out, (np.repeat(row_a, many), row_b[inner]), 1)
    return out


def _compare(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between components, as (a, b) with a < b.

    ``rows``: unit, rep, n (set size), comp, guest.  In every unit each guest is
    compared with every member (the rows that aren't guests) of another component.
    Large units are divided into blocks of guests by members.
    """
    side = F.when(F.col("guest"), F.col("n"))
    cut = lambda c: F.ceil(F.coalesce(F.sum(c), F.lit(0)) / BLOCK_SHINGLES)
    units = rows.groupBy("unit").agg(cut(side).alias("gs"), cut(F.when(~F.col("guest"), F.col("n"))).alias("ms"), F.sum("n").alias("weight")).checkpoint()
    small = (F.col("gs") <= 1) & (F.col("ms") <= 1)
    bins = max(1, -(-(units.filter(small).agg(F.sum("weight")).first()[0] or 0) // BLOCK_SHINGLES))
    own = lambda k: F.pmod(F.xxhash64("rep"), F.greatest(F.col(k), F.lit(1)))
    other = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.when(F.col("guest"), F.col("ms")).otherwise(F.col("gs")), F.lit(1)).cast("bigint") - 1)
    dealt = (
        rows.join(units, "unit")
        .select("unit", "rep", "comp", "guest", "gs", "ms", F.when(F.col("guest"), own("gs")).otherwise(own("ms")).alias("mine"), F.explode(other).alias("other"))
        .withColumns({"g": F.when(F.col("guest"), F.col("mine")).otherwise(F.col("other")), "m": F.when(F.col("guest"), F.col("other")).otherwise(F.col("mine"))})
        .select("unit", "rep", "comp", "guest", F.when(~small, F.xxhash64("unit", "g", "m")).otherwise(F.pmod(F.xxhash64("unit"), F.lit(bins))).alias("block"))
    )

    def run(table: pa.Table) -> pa.Table:
        unit, comp, guest = (table[c].to_numpy() for c in ("unit", "comp", "guest"))
        values = table["shingles"].combine_chunks()
        ends = values.offsets.to_numpy()
        flat = values.values.to_numpy().view(np.uint64)
        found = set()
        order = np.argsort(unit, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
            g, m = own[guest[own]], own[~guest[own]]
            if not len(g) or not len(m):
                continue
            pick = lambda rows: [flat[ends[k] : ends[k + 1]] for k in rows]
            sets_g, sets_m = pick(g), pick(m)
            common = _common(sets_g, sets_m)
            union = np.array([len(x) for x in sets_g])[:, None] + np.array([len(x) for x in sets_m])[None, :] - common
            x, y = np.nonzero((common > 0) & (den * common >= num * union) & (comp[g][:, None] != comp[m][None, :]))
            found.update(zip(np.minimum(comp[g][x], comp[m][y]).tolist(), np.maximum(comp[g][x], comp[m][y]).tolist(), strict=True))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, type=pa.int64()), "b": pa.array(b, type=pa.int64())})

    return dealt.join(sets, "rep").select("block", "unit", "comp", "guest", "shingles").groupBy("block").applyInArrow(run, "a bigint, b bigint").distinct()


def _small(rows: DataFrame) -> DataFrame:
    """The rows with a hint to broadcast them, if they were counted to be few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else rows


def _mixed(held: DataFrame, found: DataFrame) -> DataFrame:
    """key, rep, n, comp, most and guest of the tables that hold several components: ``most`` is a table's largest one, guests are not of it."""
    placed = held.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp")).checkpoint()
    weights = placed.select("rep", "comp").distinct().groupBy("comp").agg(F.count("*").alias("weight"))
    several = placed.join(weights, "comp").groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max_by("comp", "weight").alias("most")).filter("lo <> hi")
    return placed.join(several.select("key", "most"), "key").withColumn("guest", F.col("comp") != F.col("most"))


def _units(mixed: DataFrame) -> DataFrame:
    """Rows of ``_compare``: each guest of a mixed table against all the table's members.

    Tables of one largest component have many pairs in common where they hold
    nearly the same classes, and few where they don't.  They are one unit if
    that is less to compare, and else a unit each.
    """
    work = F.sum(F.when(F.col("guest"), F.col("n").cast("double")).otherwise(0.0)) * F.sum(F.col("n").cast("double"))
    apart = mixed.groupBy("key", "most").agg(work.alias("work")).groupBy("most").agg(F.sum("work").alias("apart"))
    once = mixed.select("most", "rep", "n", "guest").distinct()
    together = once.groupBy("most").agg(work.alias("together"))
    plan = _small(apart.join(together, "most").select("most", (F.col("apart") < F.col("together")).alias("alone")).checkpoint())
    rows = mixed.join(plan, "most").select(F.when(F.col("alone"), F.xxhash64("key", F.lit("table"))).otherwise(F.xxhash64("most")).alias("unit"), "rep", "n", "comp", "guest").distinct().checkpoint()
    return rows.withColumn("guest", F.lit(False)).unionByName(rows.filter("guest"))


def _onward(first: DataFrame, second: DataFrame) -> DataFrame:
    """(node, component) of both: ``second`` links components of ``first`` and nodes that ``first`` doesn't have."""
    over = second.select(F.col("node").alias("component"), F.col("component").alias("over"))
    return first.join(over, "component", "left").select("node", F.coalesce("over", "component").alias("component")).unionByName(second.join(first.select("node"), "node", "left_anti").select("node", "component"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    num: int = 80,
    den: int = 100,
    width: int = 3,
    miss: float = 2e-5,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Two texts are linked if den x |A and B| >= num x |A or B| for their sets of
    ``size``-word shingles (words: runs of non-white-space, A-Z in lower case; a
    shorter text is one shingle).  component_id is the smallest id that a row
    reaches over links, itself included; kept says that it is the row's own.

    Null, empty and blank texts have no shingles and link with nothing.  A null
    id can't be named: such rows have a null component_id, are kept, and take no
    part.  Repeated rows are judged one by one, so rows that share id and text
    are kept or not together.  An empty table gives no rows.  Texts may have any
    length.  Other columns are ignored.
    """
    checkpoint_dir(docs.sparkSession)
    m = collections_for(num / den, width, miss)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = signatures(texts, size, m, width).checkpoint()
    full = signed.filter("doc_id is not null and n_shingles > 0")

    # classes of equal sets, numbered; the number is fixed once the table is written
    classes = full.groupBy("f1", "f2").agg(F.min("doc_id").alias("least"), F.count("*").alias("many"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = classes.withColumn("rep", F.monotonically_increasing_id()).checkpoint()
    bands = classes.select("rep", "n", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").count().filter("count > 1").select("band")
    kept = bands.join(shared, "band").groupBy("rep", "n").agg(F.sort_array(F.collect_set("band")).alias("bands")).filter(F.size("bands") > 1)
    pairs = F.flatten(F.transform("bands", lambda x, i: F.transform(F.slice(F.col("bands"), i + 2, F.lit(m)), lambda y: F.xxhash64(x, y))))
    tables = kept.select("rep", "n", F.explode(pairs).alias("key")).checkpoint()
    # tables that hold the same classes are one
    sizes = tables.groupBy("key").agg(F.count("*").alias("many"), F.min("rep").alias("leader"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.hash("rep")).alias("y")).filter("many > 1")
    once = sizes.groupBy("many", "leader", "x", "y").agg(F.min("key").alias("key")).select("key", "leader")
    held = tables.join(once, "key").select("key", "rep", "n", "leader").checkpoint()

    # one set for each class: that of a row with its least id, of which there may be several if the id repeats
    repeated = full.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("least"), F.lit(True).alias("again"))
    involved = held.select("rep").distinct().join(classes.select("rep", "least", "f1", "f2"), "rep").join(repeated, "least", "left").checkpoint()
    ids = _small(involved.select(F.col("least").alias("doc_id")).distinct())
    found = shingle_sets(texts.join(ids, "doc_id", "left_semi"), size).join(_small(involved.withColumnRenamed("least", "doc_id")), ["doc_id", "f1", "f2"])
    sets = found.select("rep", "again", "shingles").checkpoint()
    if involved.filter("again").isEmpty():
        sets = sets.select("rep", "shingles")
    else:
        more = sets.filter("again").select("rep", "shingles").dropDuplicates(["rep"]).checkpoint()
        sets = sets.filter("again is null").select("rep", "shingles").unionByName(more)

    # each class against the leaders of most of its tables
    order = Window.partitionBy("rep").orderBy(F.desc("tables"), "leader")
    chosen = held.filter("rep <> leader").groupBy("rep", "n", "leader").agg(F.count("*").alias("tables")).withColumn("k", F.row_number().over(order)).filter("k <= 3")
    guests = chosen.select(F.col("leader").alias("unit"), "rep", "n", F.col("rep").alias("comp"), F.lit(True).alias("guest"))
    leaders = held.filter("rep = leader").select("rep", "n").distinct().join(chosen.select(F.col("leader").alias("rep")).distinct(), "rep", "left_semi")
    rows = guests.unionByName(leaders.select(F.col("rep").alias("unit"), "rep", "n", F.col("rep").alias("comp"), F.lit(False).alias("guest")))
    found = components(_compare(rows.checkpoint(), sets, num, den)).checkpoint()
    # the tables that still hold several components
    found = _onward(found, components(_compare(_units(_mixed(held, found).checkpoint()), sets, num, den)))
    final = found.select(F.col("node").alias("rep"), F.col("component").alias("to"))
    # back to ids: the least one of each component, for the classes of several rows or with links
    linked = final.join(classes.select("rep", "least"), "rep").checkpoint()
    least = _small(linked.groupBy("to").agg(F.min("least").alias("component")))
    linked = linked.join(least, "to").select("rep", "component")
    many = classes.join(linked, "rep", "left").filter("many > 1 or component is not null").select("f1", "f2", F.coalesce("component", "least").alias("component"))
    named = signed.join(many, ["f1", "f2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
