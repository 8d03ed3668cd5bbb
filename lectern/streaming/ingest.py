"""Files dropped into a folder, registered and indexed as they come.

An extension: the stream itself keeps no state.  Blocks of books that are not
complete wait in an inbox, a table that grows and shrinks with them; complete
books are chunked and put in place of what they had.  A batch that is repeated
after a failure does again what it had not finished and changes nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.chunking import chunks
from lectern.operators.sinks import Collections, Folder, Versions

#: ``version`` and ``n_blocks`` say which content of a book a block belongs to and how many blocks that has.
DROPPED = "book_id bigint, raw_idx int, page int, block_type string, text string, version bigint, n_blocks int"
DONE = "book_id bigint, version bigint, content bigint"


def dropped(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of JSON-lines files as they arrive.

    Without ``version`` and ``n_blocks`` a file holds whole books, and a file
    that was written later holds newer content; with them a book may come in
    several files and batches.
    """
    rows = spark.readStream.schema(DROPPED).json(folder)
    written = F.unix_millis("_metadata.file_modification_time")
    return rows.select("*", F.col("_metadata.file_path").alias("file"), F.coalesce("version", written).alias("content_version")).drop("version")


def _content() -> Column:
    """A number that equal sets of blocks share, whatever their order."""
    return F.sum(F.xxhash64("raw_idx", "page", "block_type", "text").cast("decimal(20,0)")).cast("decimal(38,0)")


def _whole(inbox: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(books, blocks)``: the newest complete content of each book.

    Blocks that came twice count once: of one place the last file's.  Content
    is complete with all the blocks it says it has, or with its file.
    """
    parts = inbox.withColumn("_part", F.when(F.col("n_blocks").isNull(), F.col("file")).otherwise(F.lit("")))
    keys = ["book_id", "content_version", "_part"]
    once = parts.groupBy(*keys, "raw_idx").agg(F.max(F.struct("file", "page", "block_type", "text", "n_blocks")).alias("b")).select(*keys, "raw_idx", "b.page", "b.block_type", "b.text", "b.n_blocks")
    sized = once.groupBy(*keys).agg(F.count("*").alias("n"), F.max("n_blocks").alias("n_blocks"), F.pmod(_content(), F.lit(2**62).cast("decimal(38,0)")).cast("bigint").alias("content"))
    complete = sized.where("n_blocks IS NULL OR n >= n_blocks")
    newest = complete.groupBy("book_id").agg(F.max(F.struct("content_version", "_part", "content")).alias("b")).select("book_id", "b.*")
    return newest, once.join(newest.select(*keys), keys, "left_semi")


def ingest(stream: DataFrame, target: str, checkpoint: str, also: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Chunk complete books and put them in place of what they had; runs until the folder is drained.

    Chunks are the collection ``full`` below ``target``.  Older content that
    comes late, and the same content again, change nothing.  ``also`` gets the
    chunks that were put there.
    """
    spark = stream.sparkSession
    collections, staged = Collections(spark, target), Folder(spark, f"{target}/staged")
    inbox, known = Versions(spark, f"{target}/inbox"), Versions(spark, f"{target}/done")

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{staged.folder}/{name}")
        return spark.read.parquet(f"{staged.folder}/{name}")

    def write(batch: DataFrame, epoch: int) -> None:
        rows = kept(batch, f"batch-{epoch}")
        rows = rows.unionByName(inbox.read(rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")))
        books, blocks = _whole(rows)
        done = known.read(DONE)
        old = done.select("book_id", F.col("version").alias("_version"), F.col("content").alias("_content"))
        fresh = books.join(old, "book_id", "left").where("_version IS NULL OR content_version >= _version AND content <> _content")
        fresh = kept(fresh, f"fresh-{epoch}")
        ready = blocks.join(fresh.select("book_id"), "book_id", "left_semi").select("book_id", F.col("raw_idx").alias("block_idx"), "page", "block_type", "text")
        collections.index("full", chunks(ready), fresh.select("book_id"))
        if also:
            also(collections.read("full").join(fresh.select("book_id"), "book_id", "left_semi"), epoch)
        now = fresh.select("book_id", F.col("content_version").alias("version"), "content")
        known.save(done.join(now, "book_id", "left_anti").unionByName(now))
        # What stays in the inbox: content newer than what is done, whose other blocks are still to come.
        latest = known.read(DONE).select("book_id", "version")
        inbox.save(rows.join(latest, "book_id", "left").where("version IS NULL OR content_version > version").drop("version"))
        for table in (inbox, known):
            table.prune()
        staged.delete("")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events per type and window; those later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
