"""Predicates of searches over metadata, text and pages."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed


def subject(tag: str, column: str = "subjects", *, strict: bool = False) -> Column:
    """Rows tagged ``tag``; ``x/*`` asks for all below x.

    As a literal match anywhere in the serialized list ``x`` also finds
    ``other-x``; ``strict`` compares whole tags and their parents.
    """
    stem = tag.removesuffix("/*")
    if strict:
        return F.exists(F.col(column), lambda s: (s == stem) | F.startswith(s, F.lit(stem + "/")))
    return F.contains(F.to_json(F.col(column)), F.lit(stem))


def subjects(tags: Iterable[str], column: str = "subjects", *, strict: bool = False) -> Column:
    """Rows with any of the tags."""
    return reduce(lambda a, b: a | b, (subject(t, column, strict=strict) for t in tags))


def metadata(*, subjects_: Iterable[str] | None = None, library: str | None = None, block_type: str | None = None, book_id: int | None = None, strict: bool = False) -> Column | None:
    """All conditions that are set, joined by AND; None without any.

    Empty strings and lists set nothing; book 0 is a book.
    """
    parts: list[Column] = []
    if book_id is not None:
        parts.append(F.col("book_id") == book_id)
    if library:
        parts.append(F.col("library") == library)
    if block_type:
        parts.append(F.col("block_type") == block_type)
    if subjects_:
        parts.append(subjects(subjects_, strict=strict))
    return reduce(lambda a, b: a & b, parts) if parts else None


def where(df: DataFrame, condition: Column | None) -> DataFrame:
    return df if condition is None else df.where(condition)


def literal(text: Column, needle: str) -> Column:
    """Case-insensitive containment; ``%`` and ``_`` are plain characters."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


def same_title(title: Column, wanted: str) -> Column:
    """Titles equal in any case; ``%`` and ``_`` are plain characters."""
    return F.lower(title) == F.lit(wanted.lower())


def pages(first: int, last: int) -> Column:
    return F.col("page").between(first, last)


def early_pages(blocks: DataFrame, count: int = 10) -> DataFrame:
    """Blocks on the first ``count`` distinct pages of each book."""
    from pyspark.sql import Window

    nth = F.dense_rank().over(Window.partitionBy("book_id").orderBy("page"))
    return blocks.where(F.col("page").isNotNull()).withColumn("_nth", nth).where(F.col("_nth") <= count).drop("_nth")


def enrichment_reasons(authors: Column, title: Column, publisher: Column) -> Column:
    """Why a book's metadata needs work; empty if it doesn't."""
    missing = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.array_compact(
        F.array(
            F.when(missing(authors) | (F.lower(authors) == "unknown"), F.lit("author is Unknown")),
            F.when(F.contains(title, F.lit("_")) | F.endswith(title, F.lit(".pdf")) | F.endswith(title, F.lit(".epub")), F.lit("title looks like filename")),
            F.when(missing(publisher), F.lit("no publisher")),
        )
    )


def route(img_mpix: Column, page_megapix: Column, most_image: float = fixed.IMAGE_MEGAPIXELS, most_page: float = fixed.PAGE_MEGAPIXELS) -> Column:
    """Backend of an extraction: over either limit it goes to the large machine."""
    over = (img_mpix > most_image) | (page_megapix > most_page)
    reason = F.when(img_mpix > most_image, F.lit("image megapixels")).when(page_megapix > most_page, F.lit("page megapixels")).otherwise(F.lit("within limits"))
    return F.struct(F.when(F.coalesce(over, F.lit(False)), F.lit("modal")).otherwise(F.lit("spark")).alias("backend"), reason.alias("reason"))
