"""Shared helpers of the training-data operators: shared storage, folds, input columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fold of the contracts: rows whose crc32(doc_id as text) mod FOLDS is 0 are held out.
FOLDS = 5
#: For each permission that it sets, Hadoop's local file system starts a process ``chmod`` out of the JVM, which until it runs has all of the
#: JVM's memory as its own: three a file where a checksum file goes with each, two without. Pages of Parquet hold checksums too,
#: which are then read instead. Other stores than ``file`` don't look at the first two settings.
WRITES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false", "parquet.page.write-checksum.enabled": "true"}
READS = {"parquet.page.verify-checksum.enabled": "true"}


def work_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share; it goes when the session's JVM ends.

    Only where the session names none, and all of it runs in one process (tests), a folder of this machine is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/paperloom-{uuid.uuid4().hex}"
    store, path = _store(spark, folder)
    store.mkdirs(path)
    store.deleteOnExit(path)
    return folder


def _store(spark: SparkSession, place: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def dropped(spark: SparkSession, folder: str, *names: str) -> None:
    """Deletes stored tables that nothing reads any more."""
    for name in names:
        store, path = _store(spark, f"{folder}/{name}")
        store.delete(path, True)


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and returns the reread table.

    This cuts the lineage: a lost executor costs no more than the tasks that it ran. The files of
    shuffles that the rows went through are then unused, and Spark drops them with the garbage.
    """
    path = f"{folder}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").options(**WRITES).parquet(path)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).options(**READS).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def row_name(id_col: str, text_col: str) -> Column:
    """16 bytes that name a row by its id and text, nulls told from empty ones."""
    own = F.coalesce(F.col(id_col).cast("string"), F.lit("-"))
    text = F.coalesce(F.concat(F.lit("t"), F.col(text_col).cast("string")), F.lit("n"))
    return F.unhex(F.md5(F.concat(own, F.lit(" "), text).cast("binary")))


def private(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Cache(dict):
    """A dict that makes missing values and holds ``bound`` of them at most.

    It has two generations: when the young one is half the bound, it becomes the old one; values of the old
    one that are asked for again go back to the young one, others fall away with it.
    """

    def __init__(self, make: Callable, bound: int):
        super().__init__()
        self.make, self.half, self.old = make, max(1, bound // 2), {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old = {}


#: Rows of an Arrow batch, bytes of text that are worked on at once, and rows.
BATCH_ROWS, PART_BYTES, PART_ROWS = 1000, 4 << 20, 500


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts are kept small, unless the session has its own number of rows: each task and its Python
    worker hold some of them at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # the default
        spark.conf.set(name, str(BATCH_ROWS))


def in_parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with some PART_BYTES of text each, or one longer text."""
    sizes, at, held = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if i > at and (held + n > PART_BYTES or i - at >= PART_ROWS):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield batch.slice(at)


_forget: dict[str, Callable[[], None]] = {}
_turn: list[str] = []


def caches_of(name: str, forget: Callable[[], None] | None = None) -> None:
    """An operator takes its turn in this Python worker: the caches of the one before it go, and their memory.

    Workers are used again for the next stage, so the caches of several operators would else add up.
    """
    if forget is not None:
        _forget[name] = forget
    if _turn[-1:] != [name]:
        for other in set(_forget) - {name}:
            _forget[other]()
        _turn[:] = [name]
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def held_out(doc_id: Column) -> Column:
    """True for rows of the held-out fold; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
