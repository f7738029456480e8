"""Removal of repeated byte strings by prefix doubling of names within texts, and three rounds of Spark over anchors.

This departs from plain distributed prefix doubling, which sorts (position, rank) pairs of all bytes anew at each
offset: a row per byte would write some 30 times the input a round. Every byte that a repeated string of
``LENGTH`` bytes covers is removed. Ranks are names: equal
strings have equal 64-bit names. A text's names double in place from 8 to 128 bytes, a name at
twice the length being made of the names at a position and at the growing offset after it. Spark
then sorts (name, position) pairs, level by level, and only positions whose name is still shared
go on to the next, longer level:

  level 0  For every window of LENGTH bytes the position of its smallest 64-byte name is its anchor;
           equal windows have equal anchors, so it is enough to compare windows at anchors with
           equal names. Neighbouring windows with one anchor are one run. Names that are unique
           drop out. A run whose whole extent has a shared name is repeated as a whole.
  level 1  The other runs, and one of each set of equal runs, are cut at fixed offsets from the
           anchor into blocks of BLOCK windows. A block whose common core (the bytes in all its
           windows) is unique drops out; one whose whole extent is shared is repeated.
  level 2  What is still open is compared window by window.

Anchors are about one position in 70. Groups are counted by pre-aggregated sums and never collected; each set
of equal runs sends one of its own to the next level, so a passage in every text costs no more
there than one in two. What is counted is stored before it is joined back, so both sides come from plain exchanges
and adaptive execution splits a name that very many positions share.

Defined results: a null text is empty; texts below LENGTH bytes are left as they are; rows
that repeat id and text are copies of each other and lose all windows; empty tables give empty
results; further columns play no part. Long texts are worked through in pieces of PIECE windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, small_batches, stored, work_dir

LENGTH, GRAM, BLOCK = 200, 64, 16
#: Windows of a text that are worked on at once.
PIECE = 1 << 20
_SPAN = LENGTH - GRAM + 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64(24)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(29))


def _names(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the GRAM-byte and of the LENGTH-byte string at each position."""
    h = _mix(np.ndarray((len(raw) - 7,), "<u8", raw.data, 0, (1,)) * _A)
    k, gram = 8, None
    while k < 128:
        h = _mix(h[:-k] * _A + h[k:])
        k *= 2
        gram = h if k == GRAM else gram
    rest = LENGTH - k
    return gram, _mix(h[:-rest] * _A + h[rest:] * np.uint64(5))


def _runs_of_piece(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor name, extent name, first window, anchor offset, windows, of each run."""
    gram, whole = _names(raw)
    least = (gram >> _PLACE << _PLACE) | np.arange(len(gram), dtype=np.uint64)
    s = 1
    while 2 * s <= _SPAN:
        least = np.minimum(least[:-s], least[s:])
        s *= 2
    if s < _SPAN:
        least = np.minimum(least[: len(least) - (_SPAN - s)], least[_SPAN - s :])
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    last = np.concatenate([first[1:] - 1, [len(anchor) - 1]])
    at = anchor[first]
    extent = _mix(_mix(whole[first] * _A + whole[last]) * _A + ((at - first) * 256 + (last - first)).astype(np.uint64))
    return gram[at], extent, first, at - first, last - first + 1


def runs(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """The runs of a whole text, piece by piece; each run is in one piece, uncut."""
    windows = len(text) - LENGTH + 1
    raw = np.frombuffer(text, np.uint8)
    with np.errstate(over="ignore"):
        for begin in range(0, max(0, windows), PIECE):
            low, high = max(0, begin - _SPAN), min(windows, begin + PIECE + _SPAN)
            found = _runs_of_piece(raw[low : high + LENGTH - 1])
            first = found[2] + low
            own = (first >= begin) & (first < begin + PIECE)
            yield found[0][own], found[1][own], first[own], found[3][own], found[4][own]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """d and t name a row by id and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("d"), F.xxhash64(id_col, text_col).alias("t"), text.cast("binary").alias("raw"))


def anchors(rows: DataFrame) -> DataFrame:
    """One row per run: gram, extent, d, t, and place = first window, offset, windows, packed."""
    schema = pa.schema([(n, pa.int64()) for n in ("gram", "extent", "d", "t", "place")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for gram, extent, first, offset, windows in runs(raw):
                    n = len(gram)
                    place = first << 16 | offset << 8 | windows - 1
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram.view(np.int64), extent.view(np.int64), np.full(n, d), np.full(n, t), place)], schema=schema)

    return rows.where(F.octet_length("raw") >= LENGTH).select("d", "t", "raw").mapInArrow(_joined(run), "gram long, extent long, d long, t long, place long")


def _joined(run, rows: int = 50_000):
    """Joins the small batches of ``run`` to larger ones."""

    def larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return larger


def _unpacked(place) -> tuple:
    """First window, anchor, windows."""
    first = F.shiftright(place, 16)
    return first, first + F.shiftright(place, 8).bitwiseAND(255), place.bitwiseAND(255) + 1


def contexts(rows: DataFrame, picked: DataFrame) -> DataFrame:
    """The bytes around the anchors of picked runs (gram, place, weight, d, t): all their windows."""
    schema = pa.schema([("gram", pa.int64()), ("d", pa.int64()), ("t", pa.int64()), ("place", pa.int64()), ("weight", pa.int64()), ("low", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t, raw, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = []
                for x in found:
                    anchor = (x["place"] >> 16) + (x["place"] >> 8 & 255)
                    low = max(0, anchor - _SPAN - BLOCK)
                    out.append((x["gram"], d, t, x["place"], x["weight"], low, raw[low : anchor + LENGTH + BLOCK]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    lists = picked.groupBy("d", "t").agg(F.collect_list(F.struct("gram", "place", "weight")).alias("found"))  # as many as a text has runs
    joined = rows.select("d", "t", "raw").join(lists, ["d", "t"]).select("d", "t", "raw", "found")
    return joined.mapInArrow(_joined(run, 2_000), "gram long, d long, t long, place long, weight long, low long, bytes binary").dropDuplicates(["d", "t", "place"])


def _name(raw: bytes) -> int:
    return int.from_bytes(blake2b(raw, digest_size=8).digest(), "little", signed=True)


def blocks(context: DataFrame) -> DataFrame:
    """Runs cut into blocks: names of core and extent, first window, windows."""
    names = ["gram", "core", "extent", "d", "t", "place", "block", "first", "windows", "weight"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for gram, d, t, place, weight, low, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, far, windows = place >> 16, place >> 8 & 255, (place & 255) + 1
                anchor, near = first + far, far - windows + 1  # offsets from far down to near
                for block in range(near // BLOCK, far // BLOCK + 1):
                    start = anchor - block * BLOCK - low  # of the window with the block's smallest offset
                    core = raw[start : start - BLOCK + 1 + LENGTH]
                    begin = start - BLOCK + 1
                    extent = raw[begin : start + LENGTH] if begin >= 0 else b""
                    if len(extent) < LENGTH + BLOCK - 1:  # over the text's edge: like no other
                        extent = f"{d} {t} {place} {block}".encode()
                    hi, lo = min(far, block * BLOCK + BLOCK - 1), max(near, block * BLOCK)
                    out.append((gram, _name(core + bytes([block])), _name(extent), d, t, place, block, anchor - hi, hi - lo + 1, weight))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    rows = context.select("gram", "d", "t", "place", "weight", "low", "bytes")
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def windows_of(context: DataFrame, open_blocks: DataFrame) -> DataFrame:
    """A name for each window of open blocks (d, t, place, first, windows, weight)."""
    schema = pa.schema([(n, pa.int64()) for n in ("gram", "name", "d", "t", "first", "weight")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for gram, d, t, low, raw, first, n, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for p in range(first, first + n):
                    out.append((gram, _name(raw[p - low : p - low + LENGTH]), d, t, p, weight))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    joined = context.drop("weight").join(open_blocks, ["d", "t", "place"])
    return joined.select("gram", "d", "t", "low", "bytes", "first", "windows", "weight").mapInArrow(run, "gram long, name long, d long, t long, first long, weight long")


def repeated_spans(rows: DataFrame, folder: str) -> DataFrame:
    """d, t, first, windows: stretches of windows that start somewhere else too."""
    spark = rows.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        return stored(df, folder, name)

    runs_ = kept(anchors(rows), "anchors")
    shared = kept(runs_.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "shared")
    alive = kept(runs_.join(shared, "gram"), "level0")
    dropped(spark, folder, "anchors", "shared")
    sets = kept(alive.groupBy("gram", "extent").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "place")).alias("one")), "sets")
    mixed = kept(sets.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1").select("gram"), "mixed")
    whole = alive.join(sets.where("n > 1").select("gram", "extent"), ["gram", "extent"])
    first, _, windows = _unpacked(F.col("place"))
    spans = [kept(whole.select("d", "t", first.alias("first"), windows.cast("long").alias("windows")), "spans0")]
    dropped(spark, folder, "level0")
    picked = sets.join(mixed, "gram").select("gram", "one.d", "one.t", "one.place", F.least("n", F.lit(2)).alias("weight"))
    context = kept(contexts(rows, picked), "contexts")
    cut = kept(blocks(context), "level1")
    dropped(spark, folder, "sets", "mixed")
    kinds = kept(cut.groupBy("gram", "core", "extent").agg(F.sum("weight").alias("n"), F.min(F.struct("d", "t", "place", "first", "windows")).alias("one")), "kinds")
    cores = kept(kinds.groupBy("gram", "core").agg(F.count("*").alias("kinds")).where("kinds > 1").select("gram", "core"), "cores")
    again = cut.where("weight = 1").join(kinds.where("n > 1").select("gram", "core", "extent"), ["gram", "core", "extent"])
    spans.append(kept(again.select("d", "t", "first", "windows"), "spans1"))
    left = kinds.join(cores, ["gram", "core"]).select("one.*", F.least("n", F.lit(2)).alias("weight"))
    single = kept(windows_of(context, left), "level2")
    dropped(spark, folder, "contexts", "level1", "kinds", "cores")
    same = kept(single.groupBy("gram", "name").agg(F.sum("weight").alias("n")).where("n > 1").select("gram", "name"), "same")
    last = single.where("weight = 1").join(same, ["gram", "name"]).select("d", "t", "first", F.lit(1).cast("long").alias("windows"))
    spans.append(kept(last, "spans2"))
    dropped(spark, folder, "level2", "same")
    return spans[0].unionByName(spans[1]).unionByName(spans[2])


def merged(found: list[tuple[int, int]]) -> list[list[int]]:
    """Stretches of windows -> maximal byte ranges [start, end)."""
    out: list[list[int]] = []
    for first, n in sorted(found):
        end = first + n - 1 + LENGTH
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges), kept (the bytes that remain) of every row."""
    small_batches(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, work_dir(docs.sparkSession))
    lists = spans.groupBy(F.col("d").alias("sd"), F.col("t").alias("st")).agg(F.collect_list(F.struct("first", "windows")).alias("found"))
    joined = rows.join(lists, (F.col("d") == F.col("sd")) & (F.col("t") == F.col("st")), "left").select("doc_id", "raw", "found")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, ranges, kept = [], [], [], []
            for doc_id, raw, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cut = merged([(x["first"], x["windows"]) for x in found or []])
                at, parts = 0, []
                for start, end in cut:
                    parts.append(raw[at:start])
                    at = end
                ids.append(doc_id)
                sizes.append(len(raw))
                ranges.append(cut)
                kept.append(b"".join([*parts, raw[at:]]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, sizes, ranges, kept), schema, strict=True)], schema=schema)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<array<long>>, kept binary")
