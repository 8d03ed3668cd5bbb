"""Intermediate tables that outlive executors.

Iterative operators cut their lineage by writing Parquet to the folder that
the cluster names in ``spark.checkpoint.dir`` and reading it back: every
executor sees that folder, so a lost executor costs a re-read and no more.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def base_dir(spark: SparkSession) -> str:
    """The shared folder; a session in one process that names none (tests) gets a local one."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        if not re.match(r"[a-z][a-z0-9+.-]*:", named):  # a path of the cluster's default file system: say which, for those that open files themselves
            fs, target = _hadoop(spark, named)
            named = re.sub(r"^file:/+", "file:///", fs.makeQualified(target).toString())
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="lectern-"))
    return _own[0]


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{base_dir(spark)}/lectern/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder that tasks write files of their own to."""
    path = new_path(spark, label)
    fs, target = _hadoop(spark, path)
    fs.mkdirs(target)
    return path


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads what was written."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    path = getattr(df, "scratch_path", None)
    if path:
        delete(df.sparkSession, path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished jobs now.

    The cleaner acts when the driver's JVM collects garbage, which a small
    driver may not do for long; between two heavy steps disk matters more.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder or file, for tasks that read or write files themselves."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def commit(fs: pyarrow.fs.FileSystem, partial: str, path: str) -> None:
    """Give a finished file its name.  Another attempt of the task may have done so: its file is as good."""
    try:
        fs.move(partial, path)
    except OSError:
        if fs.get_file_info(path).type != pyarrow.fs.FileType.File:
            raise
        fs.delete_file(partial)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _hadoop(spark, path)
    fs.delete(target, True)


@atexit.register
def _clean_up() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended: nothing to delete with
            return
