"""Writing: what a run adds lies beside what was there, and one small table says which of it counts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def without(rows: DataFrame, field: str, value: object) -> DataFrame:
    """Rows but those whose field equals the value."""
    return rows.where(~F.col(field).eqNullSafe(F.lit(value)))


def matching(rows: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Rows that equal all values, compared as text."""
    return reduce(lambda df, f: df.where(F.col(f[0]).cast("string") == str(f[1])), filters.items(), rows)


def updated(rows: DataFrame, book_id: int, changes: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """Rows with a book's fields changed, and the count of those that match."""
    own = F.col("book_id") == book_id
    out = rows.withColumns({c: F.when(own, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()})
    return out, rows.where(own).agg(F.count("*").alias("matched"))


class Folder:
    """Paths below a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def names(self, name: str) -> list[str]:
        fs, path = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def claim(self, name: str) -> bool:
        """Make an empty file; False if it was there, so of several writers one gets it."""
        fs, path = self._at(name)
        return fs.createNewFile(path)

    def delete(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)


class Versions(Folder):
    """A table whose newest complete version counts.

    A version is written beside the one that it may be computed from.  Two
    writers that start from the same version can't both save: the second gets
    an error and has to start again from the newer one.
    """

    def newest(self) -> int | None:
        done = [n for n in self.names("") if n.startswith("v") and self.exists(f"{n}/_SUCCESS")]
        return int(done[-1][1:]) if done else None

    def read(self, schema: str) -> DataFrame:
        n = self.newest()
        return self.spark.createDataFrame([], schema) if n is None else self.spark.read.parquet(f"{self.folder}/v{n:08d}")

    def save(self, rows: DataFrame) -> int:
        newest = self.newest()
        n = 0 if newest is None else newest + 1
        if not self.claim(f"claims/{n:08d}"):
            raise RuntimeError(f"another writer saves version {n} of {self.folder}; start again from it, or delete claims/{n:08d} if that writer is gone")
        try:
            rows.write.mode("overwrite").parquet(f"{self.folder}/v{n:08d}")
        except BaseException:
            self.delete(f"v{n:08d}")
            self.delete(f"claims/{n:08d}")
            raise
        return n


    def prune(self, keep: int = 2) -> None:
        """Delete all but the newest versions; readers of older ones have to begin again."""
        newest = self.newest()
        for name in self.names("") if newest is not None else ():
            if name.startswith("v") and int(name[1:]) <= newest - keep:
                self.delete(name)


class Collections(Folder):
    """The collections of a library below one folder.

    Rows are only ever added, in batches: files of whole batches, not of
    single books.  A table of (book, batch) says which batch holds what counts
    of a book, so a book's rows are replaced or taken away by one small write,
    readers never see half of a change, and a run that is repeated adds a batch
    that replaces the first.  ``compact`` drops what no longer counts.  Absent
    collections read as None; counts of them are 0.
    """

    NAMES = ("full", "equations", "chapters")
    CURRENT = "book_id bigint, batch bigint"

    def path(self, name: str) -> str:
        if not name.isidentifier():
            raise ValueError(f"no such collection: {name}")
        return f"{self.folder}/{name}"

    def _current(self, name: str) -> Versions:
        return Versions(self.spark, f"{self.path(name)}_current")

    def batches(self, name: str) -> list[int]:
        return [int(n.removeprefix("batch=")) for n in self.names(name) if n.startswith("batch=") and self.exists(f"{name}/{n}/_SUCCESS")]

    def read(self, name: str) -> DataFrame | None:
        """The rows that count, or None if nothing was ever put there."""
        done = self.batches(name)
        if not done:
            return None
        rows = self.spark.read.option("mergeSchema", True).option("basePath", self.path(name)).parquet(*(f"{self.path(name)}/batch={b}" for b in done))
        current = self._current(name).read(self.CURRENT).select(F.col("book_id").alias("_book"), F.col("batch").alias("_batch"))
        return rows.join(current, (F.col("book_id") == F.col("_book")) & (F.col("batch") == F.col("_batch")), "left_semi").drop("batch")

    def count(self, name: str) -> int:
        rows = self.read(name)
        return 0 if rows is None else rows.count()

    def index(self, name: str, rows: DataFrame, books: DataFrame | None = None) -> None:
        """Put rows in place of what their books had.

        ``books`` (book_id) says which books those are, by default the ones in
        ``rows``; a book without rows loses what it had.
        """
        self.path(name)
        taken = self.batches(name)
        batch = taken[-1] + 1 if taken else 0
        while not self.claim(f"{name}_claims/{batch:08d}"):
            batch += 1
        rows.write.mode("overwrite").parquet(f"{self.path(name)}/batch={batch}")
        own = (self.spark.read.parquet(f"{self.path(name)}/batch={batch}") if books is None else books).select(F.col("book_id").cast("bigint")).distinct()
        self._point(name, own, batch)

    def index_all(self, made: Mapping[str, DataFrame], books: DataFrame) -> None:
        for name, rows in made.items():
            self.index(name, rows, books)

    def remove(self, name: str, books: DataFrame) -> None:
        """Take away the rows of books (book_id)."""
        if self.batches(name):
            self._point(name, books.select(F.col("book_id").cast("bigint")).distinct(), None)

    def _point(self, name: str, books: DataFrame, batch: int | None) -> None:
        current = self._current(name)
        kept = current.read(self.CURRENT).join(books, "book_id", "left_anti")
        current.save(kept if batch is None else kept.unionByName(books.withColumn("batch", F.lit(batch).cast("bigint"))))

    def compact(self, name: str) -> None:
        """Write what counts as one batch and delete the older ones; readers that began before have to begin again."""
        old, rows = self.batches(name), self.read(name)
        if rows is None:
            return
        books = self._current(name).read(self.CURRENT).select("book_id")
        self.index(name, rows, books)
        for b in old:
            self.delete(f"{name}/batch={b}")
