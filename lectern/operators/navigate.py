"""Reading books in order: pages, contents, chapters, spans under a budget."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.operators.structure import ordered_text


def page_window(blocks: DataFrame, page: int, around: int = 2) -> DataFrame:
    """Text of each page from ``page - around`` to ``page + around``."""
    return ordered_text(blocks.where(F.col("page").between(page - around, page + around)), ["book_id", "page"], "block_idx")


def contents(blocks: DataFrame) -> DataFrame:
    """Headings as (title, start_page), each once, with ``nth`` in order of first occurrence."""
    heads = blocks.where((F.col("block_type") == "SectionHeader") & (F.col("text") != ""))
    once = heads.groupBy("book_id", F.col("text").alias("title"), F.col("page").alias("start_page")).agg(F.min("block_idx").alias("first_idx"))
    return once.withColumn("nth", F.row_number().over(Window.partitionBy("book_id").orderBy("first_idx")))


def chapter_pages(toc: DataFrame, pages: int = 10) -> DataFrame:
    """Contents with ``end_page``: the page before the next entry if that is later, else ``pages`` on."""
    following = F.lead("start_page").over(Window.partitionBy("book_id").orderBy("nth"))
    end = F.when(following > F.col("start_page"), following - 1).otherwise(F.col("start_page") + pages)
    return toc.withColumn("end_page", end)


def parse_cursor(cursor: str | None) -> int:
    if not cursor:
        return 0
    if not (m := re.fullmatch(r"block:(\d+)", cursor)):
        raise ValueError(f"cursor must look like block:12, not {cursor!r}")
    return int(m[1])


def read_span(rows: DataFrame, key: str, order: str, max_chars: int = fixed.SPAN_CHARS, cursor: str | None = None) -> DataFrame:
    """The rows of each group that fit the budget, in order, and the cursor to go on from.

    Empty texts are skipped; the first row is always read; reading stops at
    the first row that would pass the budget (1 to 50,000 characters).
    """
    budget = min(max(max_chars, 1), fixed.SPAN_MOST)
    ordered = Window.partitionBy(key).orderBy(order)
    there = rows.where((F.coalesce(F.col("text"), F.lit("")) != "") & (F.col(order) >= parse_cursor(cursor)))
    summed = there.withColumn("_total", F.sum(F.length("text")).over(ordered)).withColumn("_nth", F.row_number().over(ordered))
    fits = (F.col("_total") <= budget) | (F.col("_nth") == 1)
    listed = F.array_sort(F.collect_list(F.when(fits, F.struct(F.col(order).alias("o"), F.col("text").alias("t")))))
    out = summed.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n").alias("text"), F.count_if(fits).alias("n_blocks"), F.min(F.when(~fits, F.col(order))).alias("_next"))
    return out.select(key, "text", "n_blocks", F.concat(F.lit("block:"), F.col("_next").cast("string")).alias("next_cursor"))


def page_of_rows(rows: DataFrame, key: str, after: object = None, size: int = 1000) -> DataFrame:
    """The next ``size`` rows in order of a unique key, after the last key that was seen.

    The filter reaches the scan, so later pages don't read what earlier ones
    did where files are sorted or partitioned by the key.
    """
    rest = rows if after is None else rows.where(F.col(key) > F.lit(after))
    return rest.orderBy(key).limit(size)
