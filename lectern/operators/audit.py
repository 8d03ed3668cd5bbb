"""Checks of books and collections: coverage, gaps, quality, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import fixed, text


def counts_by(rows: DataFrame, key: str, out: str = "n") -> DataFrame:
    """Rows per value, missing values as ``Unknown``."""
    return rows.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("Unknown")).alias(key)).agg(F.count("*").alias(out))


def distribution(rows: DataFrame, key: str) -> DataFrame:
    """Rows per value with their share of all in percent."""
    return counts_by(rows, key).withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def library_profile(books: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per library: books, indexed books, chunks of the indexed; no library is ``unassigned``."""
    per_book = chunks.groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("chunks"))
    joined = books.join(per_book, "id", "left")
    indexed = F.col("status") == "indexed"
    return joined.groupBy(F.coalesce("library", F.lit("unassigned")).alias("library")).agg(F.count("*").alias("total"), F.count_if(indexed).alias("indexed"), F.sum(F.when(indexed, F.coalesce("chunks", F.lit(0))).otherwise(0)).alias("chunks"))


def page_gaps(pages: DataFrame, least_missing: int = 6) -> DataFrame:
    """Runs of missing pages between each book's first and last, for books that miss at least so many."""
    there = pages.where("page IS NOT NULL").select("book_id", "page").distinct()
    following = F.lead("page").over(Window.partitionBy("book_id").orderBy("page"))
    runs = there.withColumn("_next", following).where("_next > page + 1").select("book_id", (F.col("page") + 1).alias("gap_start"), (F.col("_next") - 1).alias("gap_end"))
    missing = F.sum(F.col("gap_end") - F.col("gap_start") + 1).over(Window.partitionBy("book_id"))
    return runs.withColumn("missing", missing).where(F.col("missing") >= least_missing)


def completeness(chunks: DataFrame) -> DataFrame:
    """Coverage of each book's chunks and a status: red, yellow or green."""
    out = chunks.groupBy("book_id").agg(
        F.count("*").alias("chunks"), F.count_if(F.col("chapter_num").isNotNull()).alias("with_chapter"), F.count_if(F.coalesce("section_title", F.lit("")) != "").alias("with_section"),
        F.count_distinct("page").alias("pages"), F.min("page").alias("min_page"), F.max("page").alias("max_page"), F.count_if(F.col("page").isNull()).alias("no_page"),
    )
    chapter, section = F.col("with_chapter") / F.col("chunks"), F.col("with_section") / F.col("chunks")
    issue = (F.col("no_page") > F.col("chunks") * 0.3) | F.when(F.col("with_chapter") > 0, chapter < 0.5).otherwise(section < 0.5) | F.coalesce(F.col("pages") < (F.col("max_page") - F.col("min_page") + 1) * 0.5, F.lit(False))
    return out.withColumn("status", F.when((F.col("chunks") < 10) | (chapter < 0.3), "red").when(issue, "yellow").otherwise("green"))


def ocr_quality(chunks: DataFrame, sample: int = 20) -> DataFrame:
    """Share of odd texts among a fixed sample of each book's, and a status.

    The sample is the texts with the smallest hashes, so reruns agree; texts
    under 30 characters are not judged.
    """
    nth = F.row_number().over(Window.partitionBy("book_id").orderBy(F.md5(F.col("text").cast("binary")), "block_idx"))
    picked = chunks.where(F.coalesce("text", F.lit("")) != "").withColumn("_nth", nth).where(F.col("_nth") <= sample).where(F.length(text.strip(F.col("text"))) >= 30)
    judged = picked.groupBy("book_id").agg(F.count("*").alias("checked"), F.count_if(F.size(text.garbled_reasons(F.col("text"))) > 0).alias("garbled"))
    share = F.col("garbled") / F.col("checked")
    return judged.withColumn("status", F.when(share > 0.3, "red").when(share > 0.1, "yellow").otherwise("green"))


def landmarks(chunks: DataFrame) -> DataFrame:
    """Per book and landmark where it was found; headers go before text."""
    rules = [F.struct(F.lit(name).alias("landmark"), F.expr("text").rlike("(?i)" + pattern).alias("hit")) for name, pattern in fixed.LANDMARKS]
    hits = chunks.select("book_id", "block_type", F.explode(F.array(*rules)).alias("r")).where("r.hit")
    return hits.groupBy("book_id", "r.landmark").agg(F.when(F.bool_or(F.col("block_type") == "SectionHeader"), "found_in_headers").otherwise("found_in_text").alias("found"))


def corpus_audit(rows: DataFrame, key: str, **measures) -> DataFrame:
    """Measures per key and for all together (key null)."""
    return rows.rollup(key).agg(*(c.alias(n) for n, c in measures.items()))


def roll_up_status(books: DataFrame) -> DataFrame:
    """RED, YELLOW or GREEN per book by its counts, with the issues."""
    issues = F.array_compact(F.array(F.when(F.col("chunks") == 0, "no chunks"), F.when(F.col("no_page") > F.col("chunks") * 0.3, "pages missing"), F.when(F.col("labelled") == 0, "no labels")))
    status = F.when(F.col("chunks") == 0, "RED").when(F.size(issues) > 0, "YELLOW").otherwise("GREEN")
    return books.withColumn("status", status).withColumn("issues", F.array_join(issues, "; "))


def separation(samples: DataFrame, signals: list[str]) -> DataFrame:
    """For each signal the largest of the local runs against the smallest of the offloaded."""
    long = samples.unpivot(["label"], signals, "signal", "value")
    out = long.groupBy("signal").agg(F.max(F.when(F.col("label") == "ok", F.col("value"))).alias("max_ok"), F.min(F.when(F.col("label") == "offload", F.col("value"))).alias("min_offload"))
    return out.withColumn("verdict", F.when(F.col("max_ok") < F.col("min_offload"), "CLEAN GAP").otherwise("OVERLAP"))


def count_changes(before: DataFrame, after: DataFrame, key: str = "table_name") -> DataFrame:
    """Tables whose row counts differ, or that only one side has."""
    a, b = before.select(key, F.col("n").alias("before")), after.select(key, F.col("n").alias("after"))
    return a.join(b, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def yields(documents: DataFrame, **found: DataFrame) -> DataFrame:
    """Documents with the number of rows that each extractor found, 0 for none."""
    out = documents
    for name, rows in found.items():
        out = out.join(rows.groupBy("book_id").agg(F.count("*").alias(name)), "book_id", "left").fillna(0, [name])
    return out
