"""The catalog of books, changed by whole tables: register, patch, delete, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import relations

BOOK_COLUMNS = ("title", "authors", "isbn", "format", "status", "status_message", "source_path", "source_hash", "converted_path", "subjects", "library", "extraction_duration_s", "publisher", "year", "extraction_backend")


def register(books: DataFrame, incoming: DataFrame, ever: DataFrame | None = None) -> DataFrame:
    """Incoming rows (title, source_path) with ``already_exists`` and the id each has or gets.

    A row is known by its title in any case, else by its path; new ones are
    numbered after the largest id, in order of title and path.  ``ever`` (id)
    holds ids that were given out before, so that none is given twice.
    """
    titles = books.groupBy(F.lower("title").alias("_title")).agg(F.min("id").alias("_by_title"))
    paths = books.where("source_path IS NOT NULL").groupBy(F.col("source_path").alias("_path")).agg(F.min("id").alias("_by_path"))
    known = incoming.join(titles, F.lower("title") == F.col("_title"), "left").join(paths, F.col("source_path") == F.col("_path"), "left")
    known = known.withColumn("_known", F.coalesce("_by_title", "_by_path")).select(*incoming.columns, "_known")
    old = known.where("_known IS NOT NULL").select(*incoming.columns, F.col("_known").alias("id"), F.lit(True).alias("already_exists"))
    top = (books if ever is None else ever).agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    new = relations.numbered(known.where("_known IS NULL"), "title", "source_path", name="_nth").join(F.broadcast(top), F.lit(True))  # one row
    return old.unionByName(new.select(*incoming.columns, (F.col("_top") + F.col("_nth")).alias("id"), F.lit(False).alias("already_exists")))


def patch(books: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Books with the columns of ``changes`` where those are not null."""
    fields = [c for c in changes.columns if c != key]
    if unknown := set(fields) - set(BOOK_COLUMNS):
        raise ValueError(f"no such fields: {', '.join(sorted(unknown))}")
    if missing := set(fields) - set(books.columns):
        raise ValueError(f"the table has no {', '.join(sorted(missing))}")
    joined = books.join(changes.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in fields)), F.col(key) == F.col("_key"), "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in books.columns))


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def propagate(chunks: DataFrame, books: DataFrame, fields: tuple[str, ...] = ("library", "subjects")) -> DataFrame:
    """Chunks with the books' values of ``fields`` where the books have any."""
    values = books.select(F.col("id").alias("_id"), *(F.col(f).alias(f"_{f}") for f in fields))
    joined = chunks.join(values, F.col("book_id") == F.col("_id"), "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in chunks.columns))


def merge_sources(first: DataFrame, second: DataFrame, extra: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of either of two sources, values of the first where it has them; ``extra`` only adds."""
    named = lambda df, p: df.select(F.col(key), *(F.col(f).alias(f"{p}_{f}") for f in fields if f in df.columns))
    joined = named(first, "a").join(named(second, "b"), key, "full_outer").join(named(extra, "c"), key, "left")
    pick = lambda f: F.coalesce(*(F.col(f"{p}_{f}") for p in "abc" if f"{p}_{f}" in joined.columns)).alias(f)
    return joined.select(key, *(pick(f) for f in fields))


def latest_status(events: DataFrame) -> DataFrame:
    """Each book's status by its last event."""
    return events.groupBy("book_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("updated_at"))


def may_start(status, step: str, force: bool = False):
    """Whether a step may start from a status: extraction once unless forced, indexing unless it runs."""
    if step == "extract":
        return F.lit(force) | ~F.coalesce(status, F.lit("pending")).isin("extracting", "extracted", "indexing", "indexed")
    if step == "index":
        return F.coalesce(status, F.lit("pending")) != "indexing"
    raise ValueError(f"no such step: {step}")
