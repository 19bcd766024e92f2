"""Durable intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, str] = {}
#: Tables written in the scopes that are open, innermost last.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A folder below spark.checkpoint.dir; a temporary one only where that is unset and all tasks run in this process (tests, one machine)."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="tributary-")
            spark.sparkContext.setCheckpointDir(base)
        _scratch[app] = f"{base.rstrip('/')}/tributary-{uuid.uuid4().hex}"
        atexit.register(remove, spark, _scratch[app])
    return _scratch[app]


def _filesystem(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    try:
        files, where = _filesystem(spark, path)
        files.delete(where, True)
    except Exception:  # the session is gone already: the folder's owner clears it
        pass


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _filesystem(spark, path)
    return files.exists(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file by a temporary name and a rename, so readers see it whole or not at all."""
    files, where = _filesystem(spark, path)
    _, part = _filesystem(spark, f"{path}.part")
    out = files.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(where, False)
    if not files.rename(part, where):
        raise OSError(f"cannot rename {path}.part")


def read_text(spark: SparkSession, path: str) -> str:
    files, where = _filesystem(spark, path)
    if not files.exists(where):
        raise FileNotFoundError(path)
    stream = files.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends in files every executor sees.

    A lost executor costs only the tasks it ran; what follows restarts from these files. The rows are
    fixed from here on, so numbers such as monotonically_increasing_id() stay what they are. The files live until the scope they are
    written in ends (see scope), else until the application does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a materialised table that nothing will read again."""
    path = getattr(table, "_scratch_path", None)
    if path:
        remove(table.sparkSession, path)


def keep(table: DataFrame) -> DataFrame:
    """table, taken out of the scope it was written in: it lives until the scope around that ends."""
    path = getattr(table, "_scratch_path", None)
    for i, paths in enumerate(_scopes):
        if path in paths:
            paths.remove(path)
            if i:
                _scopes[i - 1].append(path)
            break
    return table


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete at its end the intermediate tables that were written within. What was built from them must have been read by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)
