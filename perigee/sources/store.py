"""Small file operations on the folders that hold versions and records, for any file system Spark reads.

A record is one small JSON text.  ``create_new`` writes it beside its place and renames it there without
overwriting, so of several writers of the same record one succeeds and no reader sees half a text
(the file system must rename without overwriting in one step, as Spark's own streaming logs need too).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none where it does not exist."""
    fs, path = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def n_files(spark: SparkSession, folder: str) -> int:
    """Data files in a folder (not below it)."""
    return sum(not n.startswith(("_", ".")) for n in names(spark, folder))


def n_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of all files in and below a folder."""
    fs, path = _fs(spark, folder)
    return fs.getContentSummary(path).getLength()


def modified(spark: SparkSession, path: str) -> float:
    """Time of the last change, in seconds since 1970."""
    fs, jpath = _fs(spark, path)
    return fs.getFileStatus(jpath).getModificationTime() / 1000


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a folder that this library wrote and that nothing refers to any more."""
    fs, jpath = _fs(spark, path)
    return fs.delete(jpath, True)


def _rename_new(spark: SparkSession, jvm_from, jvm_to) -> None:
    """Rename without overwriting; fails where the target exists."""
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm_to.toUri(), spark._jsc.hadoopConfiguration())
    files.rename(jvm_from, jvm_to, options)


def move_new(spark: SparkSession, path: str, target: str) -> bool:
    """Move a folder that this library wrote to ``target``; False where that is there already."""
    fs, there = _fs(spark, target)
    try:
        _rename_new(spark, spark._jvm.org.apache.hadoop.fs.Path(path), there)
    except Exception:
        if fs.exists(there):
            return False
        raise
    return True


def create_new(spark: SparkSession, path: str, record: dict) -> bool:
    """Write ``record`` at ``path``; False where another writer was first."""
    jvm = spark._jvm
    fs, target = _fs(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    try:
        out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
    finally:
        out.close()
    try:
        _rename_new(spark, beside, target)
    except Exception:
        fs.delete(beside, False)
        if fs.exists(target):
            return False
        raise
    return True


def read_record(spark: SparkSession, path: str) -> dict:
    fs, jpath = _fs(spark, path)
    stream = fs.open(jpath)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


# --------------------------------------------------------------------------- numbered records
def record_path(root: str, run_no: int) -> str:
    return f"{root}/manifest/{run_no:012d}.json"


def record_numbers(spark: SparkSession, root: str) -> list[int]:
    return [int(n[:-5]) for n in names(spark, f"{root}/manifest") if n.endswith(".json") and n[:-5].isdigit()]


def newest(spark: SparkSession, root: str) -> dict | None:
    """The newest record under ``root``; None where nothing was committed."""
    numbers = record_numbers(spark, root)
    return read_record(spark, record_path(root, numbers[-1])) if numbers else None
