"""Near-duplicate detection by one-permutation MinHash.

A text's word shingles are hashed once. The top bits of a hash name its bin, and each of ``BINS``
bins keeps its smallest hash; an empty bin takes over that of a full bin which a fixed random
sequence of its own picks (optimal densification). Bands of ``ROWS`` bins give bucket keys.

Texts with the same shingle set are one class, so copies cost one row. In each bucket only edges
between a centre and the other members are candidates, a star; the centre is the member that
shares most buckets with others, which in a group of edited copies is the text nearest to their source.
Candidates are confirmed on the full shingle sets.

A star alone would miss two members that are like each other and unlike the centre. These are found
without comparing all pairs: for sets x and y with differences X and Y to the centre's set, the
sets differ in just the elements in which X and Y differ. Like sets differ in few elements, so X
and Y share most, and hence share one of their first elements in any fixed order (prefix filter, with
lengths from the sizes of X and Y). The order is by the number of a star's members that differ in the
element, rare ones first, so copies edited apart hardly meet. Where over ``GROUP`` members
still meet at an element, they become a star of their own: one of them is its centre, edges go from it, and
the same is done with the differences to it, ``LEVELS`` times at most; then what is left is paired.
So no link between classes of a bucket is missed, and pairs don't grow with the square of a group.

Defined results: words are cut at ASCII white space, A-Z lower-cased; a text with fewer words than
a shingle is one shingle; a text without words, or null, has an empty set and links with nothing.
Rows may repeat ids or texts; a component's id is its smallest id that is not null. Texts of any length are
taken whole; an empty table gives an empty result; further columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Cache, caches_of, dropped, in_parts, private, row_name, small_batches, stored, work_dir
from .components import components

#: 32 bands of 4 bins: a pair with a similarity of 0.8 shares no band with probability 5e-8.
BINS, ROWS = 128, 4
#: Words whose hashes a worker keeps; edges of a star that meet one copy of its centre's set.
WORDS, EDGES = 200_000, 256
#: Members that are paired where they meet at an element, and levels of stars within stars.
GROUP, LEVELS = 256, 3
_STEP, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


_hashes = Cache(xxhash.xxh3_64_intdigest, WORDS)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    k = min(size, n)
    with np.errstate(over="ignore"):
        out = h[: n - k + 1].copy()
        for i in range(1, k):
            out = _mix(out) * _STEP + h[i : n - k + 1 + i]
        return np.unique(_mix(out + _END * np.uint64(k)))


@lru_cache(4)
def _probes(bins: int) -> np.ndarray:
    """For each bin its own fixed random sequence of bins."""
    return np.random.default_rng(20_171).integers(0, bins, (16 * bins, bins))


def signature(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The smallest hash of each bin; empty bins densified."""
    edges = (np.arange(bins, dtype=np.uint64) * np.uint64(2**64 // bins)).astype(np.uint64)
    first = np.searchsorted(shingles, edges)
    after = np.append(first[1:], len(shingles))
    full = first < after
    source = np.arange(bins)
    left = np.flatnonzero(~full)
    for row in _probes(bins):
        if not len(left):
            break
        source[left] = row[left]
        left = left[~full[row[left]]]
    source[left] = np.flatnonzero(full)[0]
    return shingles[first[source]]


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    with np.errstate(over="ignore"):
        bands = sig.reshape(-1, rows)
        key = np.arange(len(bands), dtype=np.uint64) * _END
        for i in range(rows):
            key = _mix(key * _STEP + bands[:, i])
        return key.view(np.int64)


def set_name(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, size: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, t (name of the row), node (name of its shingle set), n_shingles, bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.binary()), ("node", pa.binary()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches_of("minhash", _hashes.forget)
        for batch in batches:
            names, counts, bands = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), size)
                names.append(set_name(s))
                counts.append(len(s))
                bands.append(band_keys(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(counts, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_name(id_col, text_col).alias("t"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, t binary, node binary, n_shingles long, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """node, shingles of the wanted classes, from the text of one row of each (wanted: node, t)."""
    schema = pa.schema([("node", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches_of("minhash", _hashes.forget)
        for batch in batches:
            for part in in_parts(batch, 1):
                sets = [shingle_set(t, size).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    texts = docs.select(row_name(id_col, text_col).alias("t"), F.col(text_col).cast("string").alias("text"))
    rows = wanted.join(texts, "t").select("node", "text").mapInArrow(run, "node binary, shingles array<long>")
    return rows.dropDuplicates(["node"])  # a row may be there several times


def star_edges(members: DataFrame, folder: str) -> DataFrame:
    """Distinct edges (a: centre, b) of each bucket (key, node, m: its size)."""
    weight = members.groupBy("node").agg(F.sum(F.col("m") - 1).alias("w"))
    centre = members.join(weight, "node").groupBy("key").agg(F.max(F.struct("w", "node"))["node"].alias("a"))
    return members.join(stored(centre, folder, "centres"), "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def _with_sets(edges: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """Adds the full sets sa and sb. A centre's set is there once for some EDGES edges, so no task gets all of a large star."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    copies = stored(edges.groupBy("a").agg(F.ceil(F.count("*") / EDGES).cast("int").alias("copies")), folder, f"copies-{uuid.uuid4().hex}")
    left = left.join(copies, "a").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    spread = edges.join(copies, "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int"))
    return spread.drop("copies").join(right, "b").join(left.drop("copies"), ["a", "copy"]).drop("copy")


def compared(edges: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """Candidate edges (a, b) with the sizes of their full sets (na, nb) and of what both have (both)."""
    both = F.size(F.array_intersect("sa", "sb"))
    return _with_sets(edges, sets, folder).select(*edges.columns, F.size("sa").alias("na"), F.size("sb").alias("nb"), both.alias("both"))


def _like(percent: int):
    return 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))


def differences(stars: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, folder: str, level: int) -> DataFrame:
    """g, element, b, n, d, unlike, label, pos: the first elements, by rarity, in which members of a star (g) differ from its centre.

    Like sets differ in ``most`` elements at most; o of the elements in which x and y differ from the
    centre are then the same, o = (dx + dy - most) / 2, and the first dx - o + 1 and dy - o + 1 of them
    have one in common. An unlike x differs from the centre in more than ``most`` elements, so
    of y no more than about half of its differences are needed. Stars that have no unlike member have no rows.
    """
    share = (100 - percent) / (100 + percent)
    near = stars.withColumn("unlike", ~_like(percent))
    mixed = stored(near.where("unlike").select("g").distinct(), folder, f"mixed{level}")
    label = labels.select(F.col("node").alias("b"), "label")
    near = near.join(mixed, "g").join(label, "b", "left").select("g", "a", "b", F.col("nb").alias("n"), "unlike", F.coalesce("label", "b").alias("label"))
    apart = F.concat(F.array_except("sb", "sa"), F.array_except("sa", "sb"))
    full = _with_sets(near, sets, folder).select("g", "b", "n", "unlike", "label", apart.alias("apart"))
    rows = stored(full.select("g", "b", "n", F.size("apart").alias("d"), "unlike", "label", F.explode("apart").alias("element")), folder, f"apart{level}")
    freq = stored(rows.groupBy("g", "element").agg(F.count("*").alias("f")).where("f > 1"), folder, f"freq{level}")
    member = Window.partitionBy("g", "b")
    shared = rows.join(freq, ["g", "element"])  # the elements of one member alone come before these
    placed = shared.withColumn("pos", F.col("d") - F.count("*").over(member) + F.row_number().over(member.orderBy("f", "element")) - 1)
    most = F.floor(share * F.col("n") * (1 + 100 / percent) + 1e-6)
    half = F.floor(F.col("d") * (1 + share) / 2 + 1e-6) + 1
    placed = placed.withColumn("half", F.col("pos") < half).where((F.col("pos") <= most) & (F.col("unlike") | F.col("half")))
    return stored(placed.drop("f"), folder, f"differences{level}")


def unlike_centre(stars: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, folder: str, level: int = 0) -> list[DataFrame]:
    """Links (a, b) between members of a star (g; a: centre, b) of which one at least isn't like the centre."""
    rows = differences(stars, sets, labels, percent, folder, level)
    share = (100 - percent) / (100 + percent)
    groups = rows.groupBy("g", "element").agg(F.count("*").alias("m"), (F.min("label") < F.max("label")).alias("apart"), F.max("unlike").alias("any"))
    groups = stored(groups.where("m > 1 AND apart AND any").select("g", "element", "m"), folder, f"groups{level}")
    bound = GROUP if level < LEVELS else (1 << 62)
    small = rows.join(groups.where(F.col("m") <= bound), ["g", "element"])
    side = {n: small.select("g", "element", *[F.col(c).alias(f"{n}_{c}") for c in ("b", "n", "d", "label", "pos", "unlike", "half")]) for n in "xy"}
    most = F.floor(share * (F.col("x_n") + F.col("y_n")) + 1e-6)
    ok = (
        (F.when(F.col("y_unlike"), F.col("x_b") < F.col("y_b")).otherwise(F.col("x_b") != F.col("y_b"))) & (F.col("x_label") != F.col("y_label"))
        & (100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n"))
        & (F.col("x_pos") <= F.floor((F.col("x_d") - F.col("y_d") + most) / 2)) & (F.col("y_pos") <= F.floor((F.col("y_d") - F.col("x_d") + most) / 2))
    )
    x, y = side["x"].where("x_unlike").alias("x"), side["y"].where("y_unlike OR y_half").alias("y")
    pairs = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.element") == F.col("y.element")) & ok)
    pairs = stored(pairs.select(F.least("x_b", "y_b").alias("a"), F.greatest("x_b", "y_b").alias("b")).distinct(), folder, f"pairs{level}")
    found = [stored(compared(pairs, sets, folder).where(_like(percent)).select("a", "b"), folder, f"more{level}")]
    large = groups.where(F.col("m") > bound)
    if large.isEmpty():
        return found
    members = rows.join(large, ["g", "element"]).select(F.xxhash64("g", "element").alias("g"), "b", "d")
    centres = stored(members.groupBy("g").agg(F.min(F.struct("d", "b"))["b"].alias("a")), folder, f"centres{level}")
    inner = stored(compared(members.join(centres, "g").where("a <> b").select("g", "a", "b"), sets, folder), folder, f"stars{level}")
    return [*found, inner.where(_like(percent)).select("a", "b"), *unlike_centre(inner, sets, labels, percent, folder, level + 1)]


def clusters(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, t, n_shingles, component_id, label.

    The label (a node's name) names the component; its id doesn't, as ids may be null or repeated.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = work_dir(spark)
    rows = stored(signed(docs, size, text_col, id_col), folder, "signed")
    classes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("t").alias("t"), F.any_value("bands").alias("bands"))
    classes = stored(classes, folder, "classes")
    members = classes.select("node", F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("key"))
    shared = stored(members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), folder, "shared")
    members = stored(members.join(shared, "key"), folder, "members")
    edges = stored(star_edges(members, folder), folder, "edges")
    wanted = members.select("node").distinct().join(classes.select("node", "t"), "node")
    sets = stored(sets_of(docs, wanted, size, text_col, id_col), folder, "sets")
    stars = stored(compared(edges, sets, folder), folder, "stars")
    links = stars.where(_like(percent)).select("a", "b")
    labels = components(links, folder, "first")
    more = reduce(DataFrame.unionByName, unlike_centre(stars.withColumn("g", F.xxhash64("a")), sets, labels, percent, folder))
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more), folder, "all")
    dropped(spark, folder, "sets", *(f"apart{i}" for i in range(LEVELS + 1)))
    named = classes.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = stored(named.groupBy("label").agg(F.min("rep").alias("component_id")), folder, "ids")
    of_node = stored(named.join(ids, "label").select("node", "component_id", "label"), folder, "components")
    found = rows.drop("bands").join(of_node, "node", "left")
    return found.select("doc_id", "t", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "label")


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with the columns of ``docs`` and no others.

    It is a row with the component's id (its smallest); of several rows with that id the one
    whose name is the smallest. Rows without words all stay. A component whose ids are all
    null keeps one row, and components that share an id keep one row each.
    """
    names = docs.columns
    row, worded = private(docs, "row", "worded")
    found = clusters(docs, size, percent).where("n_shingles > 0 AND doc_id <=> component_id")
    stays = found.groupBy("label").agg(F.min("t").alias(row)).select(row).distinct()
    keyed = docs.withColumns({row: row_name("doc_id", "text"), worded: F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))})
    kept = keyed.where(F.col(worded)).join(stays, row, "left_semi").dropDuplicates([row])
    return kept.unionByName(keyed.where(~F.col(worded))).select(*[F.col(f"`{c}`") for c in names])
