"""Stored intermediate tables: no more files than parts, and damage is seen; batches of the operators on them."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from paperloom.llm import substrings
from paperloom.llm.common import BATCH_ROWS, stored, work_dir


def test_stored_tables_have_no_checksum_files_and_damage_is_seen(spark):
    folder, name = work_dir(spark), uuid.uuid4().hex
    rows = spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("x")).repartition(3)
    back = stored(rows, folder, name)
    place = f"{folder.removeprefix('file:').replace('//', '/')}/{name}"
    files = sorted(os.listdir(place))
    assert len(files) == 3 and all(f.startswith("part-") for f in files), files
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    path = f"{place}/{files[0]}"
    with open(path, "r+b") as f:
        f.seek(os.path.getsize(path) // 2)
        byte = f.read(1)[0]
        f.seek(-1, os.SEEK_CUR)
        f.write(bytes([byte ^ 1]))
    with pytest.raises(Exception, match="(?i)checksum|crc|corrupt"):
        back.agg(F.sum("id"), F.bit_xor(F.xxhash64("x"))).collect()


def test_repeated_substrings_go_to_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        docs = spark.createDataFrame([(1, "a" * 300), (2, "short")], "doc_id long, text string")
        found = {r["doc_id"]: bytes(r["kept"]) for r in substrings.remove_repeats(docs).collect()}
        assert found == {1: b"", 2: b"short"} and int(spark.conf.get(name)) == BATCH_ROWS
    finally:
        spark.conf.set(name, before)
