"""Token ids in sorted-string-table shards.

Documents are encoded with the tokenizers library and written in ascending order of their key
to shards, each a file of its own:

    header   MAGIC
    blocks   zstandard frames; an entry is varint(shared), varint(own), varint(value bytes),
             the key's own bytes, then the ids as little-endian unsigned 32-bit integers.
             ``shared`` counts the key bytes taken over from the entry before (0 for the first).
    index    one row per block: first key, last key, offset, size, crc32, ids before, entries
    bloom    bit array over the keys, HASHES probes each
    footer   JSON: places of index and bloom, entries, ids, key range; its length; MAGIC

A lookup asks the Bloom filter, finds the block by binary search in the sparse index and reads
that block alone. A scan reads block by block. A shard holds one block, its index and 8 bytes per
key in memory while it is written.

Keys are the id's 8 big-endian bytes with the sign flipped, so byte order is number order.
Defined results: a null id has the empty key and so comes first; a null or empty text holds the
end id alone; rows that repeat an id keep all their entries, in the order of their ids; a key
with very many rows spreads over neighbouring shards. Each file is written under a name of its own
attempt and then renamed, so a repeated or lost task leaves whole files only. A text of any length is one entry;
an empty table gives no shards and an empty result; further columns play no part.
"""

from __future__ import annotations

import bisect
import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import pairwise
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import caches_of, in_parts, shuffle_width, small_batches, stored, work_dir

MAGIC = b"PLSST001"
BLOCK_BYTES, BITS_PER_KEY, HASHES = 1 << 18, 10, 7
#: Words whose ids a worker keeps.
WORDS = 1_000_000
#: Stands between the words that go to the library together, and how many do.
_MARK, _TOGETHER = "\x7f", 100
#: Id after each document.
END_ID = 2


def sort_key(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) % (1 << 64))


def key_id(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h1, h2 = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    h = (h1 << 32 | h2) * 0x9E3779B97F4A7C15 % (1 << 64)
    return [((h >> 32) + i * (h & 0xFFFFFFFF | 1)) % bits for i in range(HASHES)]


class ShardWriter:
    """Takes (key, ids) in ascending order of the keys."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.index, self.keys, self.block = [], [], bytearray()
        self.first = self.last = None
        self.in_block = self.ids_before = self.ids = self.entries = 0
        self.pack = zstandard.ZstdCompressor(level=1)
        self._put(MAGIC)

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def add(self, key: bytes, ids: bytes) -> None:
        if self.last is not None and key < self.last:
            raise ValueError("keys must ascend")
        shared = len(os.path.commonprefix([self.last, key])) if self.in_block else 0
        if not self.in_block:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.last, self.in_block, self.entries, self.ids = key, self.in_block + 1, self.entries + 1, self.ids + len(ids) // 4
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        raw = self.pack.compress(bytes(self.block))
        self.index.append([self.first.hex(), self.last.hex(), self.at, len(raw), zlib.crc32(raw), self.ids_before, self.in_block])
        self._put(raw)
        self.block, self.in_block, self.ids_before = bytearray(), 0, self.ids

    def close(self) -> dict:
        if self.in_block:
            self._close_block()
        bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = zlib.compress(json.dumps(self.index).encode())
        foot = {"entries": self.entries, "ids": self.ids, "index": [self.at, len(index)], "bloom": [self.at + len(index), len(bloom), bits]}
        foot |= {"first": self.index[0][0] if self.index else None, "last": self.index[-1][1] if self.index else None}
        raw = json.dumps(foot).encode()
        self._put(index)
        self._put(bytes(bloom))
        self._put(raw + struct.pack("<Q", len(raw)) + MAGIC)
        return foot


class ShardReader:
    """Reads a shard from a seekable file."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2) or source.tell()
        tail = self._at(size - 16, 16)
        if tail[8:] != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError("not a shard")
        n = struct.unpack("<Q", tail[:8])[0]
        self.foot = json.loads(self._at(size - 16 - n, n))
        self.index = [[bytes.fromhex(a), bytes.fromhex(b), *rest] for a, b, *rest in json.loads(zlib.decompress(self._at(*self.foot["index"])))]
        self.lasts = [x[1] for x in self.index]
        self.unpack = zstandard.ZstdDecompressor()
        self.bloom = None

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        _, _, place, size, crc, _, n = self.index[block]
        raw = self._at(place, size)
        if zlib.crc32(raw) != crc:
            raise ValueError("a block is damaged")
        raw, at, key = self.unpack.decompress(raw), 0, b""
        for _ in range(n):
            shared, at = _read_varint(raw, at)
            own, at = _read_varint(raw, at)
            length, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + own]
            at += own
            yield key, raw[at : at + length]
            at += length

    def may_hold(self, key: bytes) -> bool:
        if self.bloom is None:
            place, n, _ = self.foot["bloom"]
            self.bloom = self._at(place, n)
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.foot["bloom"][2]))

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of every entry with this id, found by binary search."""
        key, found = sort_key(doc_id), []
        if self.index and self.may_hold(key):
            for block in range(bisect.bisect_left(self.lasts, key), len(self.index)):
                if self.index[block][0] > key:
                    break
                found += [ids for k, ids in self.entries(block) if k == key]
        return found

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for block in range(len(self.index)):
            yield from self.entries(block)


class LibraryEncoder:
    """The tokenizers library's ids of whole texts.

    The vocabulary's normalisation and word pattern do not cross white space, so each word between ASCII white space
    goes to the library once and its ids are kept: the ids of a whole text are those of its words in a row. Arrow cuts
    the texts and finds the distinct words of many texts, so Python sees those alone. A stop or comma that ends a word
    goes to the library by itself, a word of ASCII letters in lower case, where the vocabulary's own forms and pieces are so. New words
    go there some at a time, with a mark of one id between them. Texts that hold the mark or a special token's string go there whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.together = _TOGETHER if len(mark) == 1 else 1
        self.mark = mark[0] if mark else -1
        # whether a stop or comma after a letter is a piece of its own, and letters of both cases are the same
        form, pieces = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.stops = pieces is not None and all(len(pieces.pre_tokenize_str(f"a{x}")) == 2 for x in ".,")
        self.folds = form is not None and form.normalize_str(ascii_uppercase) == ascii_lowercase and not any(map(str.isalpha, self.special))
        self.ends = {x: pa.scalar(ids.tobytes(), pa.large_binary()) for x, ids in zip(".,", self._library([".", ","]), strict=True)}

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> list[bytes]:
        step, between, found = self.together, f" {_MARK} ", []
        for ids in self._library([between.join(new[i : i + step]) for i in range(0, len(new), step)]):
            raw, at = ids.tobytes(), 0
            for place in np.flatnonzero(ids == self.mark).tolist() if step > 1 else ():
                found.append(raw[at : 4 * place])
                at = 4 * place + 4
            found.append(raw[at:])
        self.words.update(zip(new, found, strict=True))
        return found

    def _distinct(self, words: pa.Array) -> pa.Array:
        """Ids of different words: those of what stands before a stop or comma, then that one's own."""
        stop = pc.and_(pc.match_substring_regex(words, "[A-Za-z][.,]$"), self.stops)
        own = pc.if_else(stop, pc.utf8_slice_codeunits(words, 0, -1), words)
        own = pc.if_else(pc.and_(pc.ascii_is_alpha(own), self.folds), pc.ascii_lower(own), own).dictionary_encode()
        found = own.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = [*map(self.words.get, found)]
        if len(self.words) > WORDS:  # those in use stay
            self.words = {w: x for w, x in zip(found, ids, strict=True) if x is not None}
        new = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(new, self._learn([found[i] for i in new]), strict=True):
            ids[i] = x
        end = pc.if_else(stop, pc.if_else(pc.ends_with(words, "."), self.ends["."], self.ends[","]), pa.scalar(b"", pa.large_binary()))
        return pc.binary_join_element_wise(pa.array(ids, pa.large_binary()).take(own.indices), end, pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        whole = reduce(pc.or_, [pc.match_substring(texts, x) for x in [_MARK, *self.special]])
        split = pc.ascii_split_whitespace(pc.if_else(whole, "", texts))
        coded = split.flatten().dictionary_encode()
        # the ids of all words in a row
        row = self._distinct(coded.dictionary).take(coded.indices)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(row).to_numpy())])[split.offsets.to_numpy()].tolist()
        raw = memoryview(row.buffers()[2] or b"")
        odd = iter(self._library(texts.filter(whole).to_pylist()))
        return [next(odd).tobytes() if w else raw[a:b].tobytes() for w, (a, b) in zip(whole.to_pylist(), pairwise(ends), strict=True)]


@lru_cache(2)
def library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def encode(docs: DataFrame, path: str, bounds: list[int], end_id: int = END_ID) -> DataFrame:
    """shard, doc_id, ids (two bytes each where the vocabulary allows) of every row."""
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])
    cuts = np.array(bounds, dtype=np.int64)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = library(path), array("I", [end_id]).tobytes()
        caches_of("sst", library.cache_clear)
        for batch in batches:
            for part in in_parts(batch, 1):
                ids = [narrow(x + end) for x in encoder.encode(part.column(1).fill_null(""))]
                keys = part.column(0).to_pylist()
                num = np.array([-(1 << 63) if k is None else k for k in keys], dtype=np.int64)
                low, high = np.searchsorted(cuts, num, "left"), np.searchsorted(cuts, num, "right")
                # a key that is a bound, once or many times over, may go to any shard between
                shard = [lo + zlib.crc32(x) % (hi - lo + 1) for lo, hi, x in zip(low.tolist(), high.tolist(), ids, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), part.column(0), pa.array(ids, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "shard int, doc_id long, ids binary")


def narrow(ids: bytes) -> bytes:
    """A length mark and two bytes an id, or four where an id needs them."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if len(wide) and wide.max() < 65536 else b"\x04" + ids


def widen(raw: bytes) -> bytes:
    return np.frombuffer(raw, "<u2", offset=1).astype("<u4").tobytes() if raw[:1] == b"\x02" else raw[1:]


def write(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Encodes and writes all rows; returns the manifest, one row per shard, in key order."""
    shards = shards or shuffle_width(docs.sparkSession)
    cuts = docs.select(F.col("doc_id").cast("long").alias("k")).where("k is not null").agg(F.percentile_approx("k", [i / shards for i in range(1, shards)], 100 * shards)).first()[0]
    rows = encode(docs, path, cuts or [], end_id).repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = out = writer = None
        for batch in batches:
            for shard, doc_id, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    name, part = f"shard-{shard:06d}.sst", f"{base}/_{uuid.uuid4().hex}"
                    out = store.open_output_stream(part)
                    writer = ShardWriter(out)
                writer.add(sort_key(doc_id), widen(ids))
        if writer is not None:
            foot = writer.close()
            out.close()
            store.move(part, f"{base}/{name}")
            yield pa.RecordBatch.from_pylist([{"name": name, "entries": foot["entries"], "n_ids": foot["ids"], "first_key": foot["first"], "last_key": foot["last"]}], schema=manifest)

    manifest = pa.schema([("name", pa.string()), ("entries", pa.int64()), ("n_ids", pa.int64()), ("first_key", pa.string()), ("last_key", pa.string())])
    made = rows.mapInArrow(run, "name string, entries long, n_ids long, first_key string, last_key string")
    return stored(made, folder, "manifest").orderBy("name")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), ids, from all shards of a folder."""
    shards, before = [], 0
    for row in spark.read.parquet(f"{folder}/manifest").orderBy("name").collect():  # one row per shard
        shards.append((len(shards), row["name"], before))
        before += row["n_ids"]
    listed = spark.createDataFrame(shards, "n int, name string, before long")
    if shards:
        listed = listed.repartitionById(len(shards), "n")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{base}/{row['name']}") as f:
                    shard, at = ShardReader(f), row["before"]
                    for block in range(len(shard.index)):
                        keys, starts, values = [], [], []
                        for key, ids in shard.entries(block):
                            keys.append(key_id(key))
                            starts.append(at)
                            values.append(ids)
                            at += len(ids) // 4
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(values, pa.binary())], schema=schema)

    return listed.mapInArrow(run, "doc_id long, start long, ids binary")


def lookup(spark: SparkSession, folder: str, doc_id: int | None) -> list[bytes]:
    """The ids of the entries with one id: the manifest's key ranges, then one block a shard."""
    key = sort_key(doc_id).hex()
    store, base = pafs.FileSystem.from_uri(folder)
    found = []
    for row in spark.read.parquet(f"{folder}/manifest").where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("name").collect():
        with store.open_input_file(f"{base}/{row['name']}") as f:
            found += ShardReader(f).get(doc_id)
    return found


def through_shards(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Writes all rows to shards in the shared folder and reads them back."""
    folder = f"{work_dir(docs.sparkSession)}/sst"
    write(docs, path, folder, end_id)
    return read(docs.sparkSession, folder)
