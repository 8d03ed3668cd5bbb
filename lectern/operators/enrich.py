"""Metadata of books guessed from their first blocks, merged and validated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed, text


def merge_metadata(rows: DataFrame, key: str, order: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """Per key: scalars of the first source that has them, lists united in order of sources."""
    first = [F.expr(f"min_by(`{c}`, `{order}`) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in scalars]
    united = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("v")))), lambda x: F.coalesce(x["v"], F.array().cast("array<string>"))))).alias(c) for c in lists]
    return rows.groupBy(key).agg(*first, *united)


def copyright_facts(blocks: DataFrame) -> DataFrame:
    """Per book year, isbn, publisher (the last match of each), page and confidence.

    The page is that of the last block with a copyright mark, else of the
    first with another fact.  Confidence adds up over blocks, so it may pass 1.
    """
    low = F.lower("text")
    marked = F.contains("text", F.lit("©")) | F.contains(low, F.lit("copyright"))
    year = F.when(marked, text.group_or_null(low, fixed.COPYRIGHT_YEAR)).cast("int")
    isbn = F.regexp_replace(text.group_or_null(F.col("text"), fixed.COPYRIGHT_ISBN), "-", "")
    named = F.when(low.rlike("published by|publisher"), text.strip(text.group_or_null(F.col("text"), fixed.NAMED_PUBLISHER)))
    known = F.coalesce(*(F.when(F.contains(low, F.lit(p.lower())), F.lit(p)) for p in fixed.COPYRIGHT_PUBLISHERS))
    facts = blocks.select("book_id", "block_idx", "page", marked.alias("marked"), year.alias("y"), isbn.alias("i"), named.alias("n"), known.alias("k"))
    part = lambda c, w: F.when(F.col(c).isNotNull(), w).otherwise(0)
    facts = facts.withColumn("tenths", part("y", 3) + part("i", 3) + part("n", 2) + part("k", 2)).withColumn("pub", F.coalesce("k", "n"))
    last = lambda c, out: F.expr(f"max_by({c}, block_idx) FILTER (WHERE {c} IS NOT NULL)").alias(out)
    out = facts.groupBy("book_id").agg(
        last("y", "year"), last("i", "isbn"), last("pub", "publisher"), F.sum("tenths").alias("_t"),
        F.expr("max_by(page, block_idx) FILTER (WHERE marked)").alias("_marked"), F.expr("min_by(page, block_idx) FILTER (WHERE i IS NOT NULL OR pub IS NOT NULL)").alias("_other"),
    )
    return out.select("book_id", "year", "isbn", "publisher", F.coalesce("_marked", "_other").alias("page"), (F.col("_t") / 10).alias("confidence"))


def title_guess(blocks: DataFrame) -> DataFrame:
    """First short heading that isn't a chapter (0.8), else bold text of the first page (0.5)."""
    flat = text.html_to_text(F.col("html"))
    heading = (F.col("block_type") == "SectionHeader") & (flat != "") & (F.length(flat) < 100) & ~flat.rlike(fixed.NO_TITLE[0]) & ~flat.rlike(fixed.NO_TITLE[1])
    bold = text.strip(F.regexp_extract("html", r"<b>([^<]+)</b>", 1))
    rows = blocks.withColumns({"_flat": flat, "_heading": heading, "_bold": bold}).join(blocks.groupBy("book_id").agg(F.min("page").alias("_first")), "book_id")
    is_bold = "block_type = 'Text' AND page = _first AND length(_bold) BETWEEN 4 AND 99"
    out = rows.groupBy("book_id").agg(F.expr("min_by(_flat, block_idx) FILTER (WHERE _heading)").alias("_h"), F.expr(f"min_by(_bold, block_idx) FILTER (WHERE {is_bold})").alias("_b"))
    return out.select("book_id", F.coalesce("_h", "_b").alias("title"), F.when(F.col("_h").isNotNull(), 0.8).when(F.col("_b").isNotNull(), 0.5).otherwise(0.0).alias("confidence"))


def author_guess(blocks: DataFrame, pages: int = 5) -> DataFrame:
    """Author from the first pages: ``by Name`` 0.9, name over affiliation 0.8, a bare name 0.5; else a catalog entry 0.7."""
    from lectern.operators.filters import early_pages

    lines = text.html_to_text(F.col("html"), "lines")
    first, second = text.strip(F.get(F.split(lines, "\n"), F.lit(0))), F.lower(F.coalesce(F.get(F.split(lines, "\n"), F.lit(1)), F.lit("")))
    by = text.group_or_null(lines, fixed.AUTHOR_AFTER_BY)
    sure = lambda c, x: F.struct(c.alias("author"), F.lit(x).alias("confidence"))
    guess = F.coalesce(F.when(by.isNotNull(), sure(by, 0.9)), F.when(text.any_of(second, fixed.AFFILIATIONS) & first.rlike(fixed.AUTHOR_LINE), sure(first, 0.8)), F.when(first.rlike(fixed.AUTHOR_LINE), sure(first, 0.5)))
    near = early_pages(blocks, pages).where("block_type = 'Text'").select("book_id", "block_idx", guess.alias("g")).groupBy("book_id").agg(F.expr("min_by(g, block_idx) FILTER (WHERE g IS NOT NULL)").alias("near"))
    entry, flat = fixed.AUTHOR_ENTRY, text.html_to_text(F.col("html"))
    turned = F.when(flat.rlike(entry), F.concat_ws(" ", text.strip(F.regexp_extract(flat, entry, 2)), F.regexp_extract(flat, entry, 1)))
    far = blocks.select("book_id", "block_idx", turned.alias("t")).groupBy("book_id").agg(F.expr("min_by(t, block_idx) FILTER (WHERE t IS NOT NULL)").alias("far"))
    joined = far.join(near, "book_id", "left")
    return joined.select("book_id", F.coalesce("near.author", "far").alias("author"), F.coalesce("near.confidence", F.when(F.col("far").isNotNull(), 0.7), F.lit(0.0)).alias("confidence"))


def recommendation(local_title: Column, title: Column, local_publisher: Column, publisher: Column, authors_match: Column, confidence: Column) -> Column:
    """``keep`` if nothing differs, else ``update`` from a sure source (0.9) or ``review``.

    Titles and publishers agree if one is part of the other.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    agree = lambda a, b: F.contains(low(a), low(b)) | F.contains(low(b), low(a))
    differs = ~agree(local_title, title) | ~agree(local_publisher, publisher) | ~F.coalesce(authors_match, F.lit(True))
    return F.when(~differs, "keep").when(confidence >= 0.9, "update").otherwise("review")


def apply_enrichment(books: DataFrame, found: DataFrame, least: float = 0.4) -> DataFrame:
    """Books with guesses in place of missing values where the guess is sure enough, and a status."""
    joined = books.join(found.select(F.col("book_id").alias("id"), F.col("title").alias("_title"), F.col("author").alias("_author"), "confidence"), "id", "left")
    sure = F.coalesce("confidence", F.lit(0.0)) >= least
    no_author = F.coalesce("authors", F.lit("")).isin("", "Unknown")
    like_file = F.col("title").rlike(fixed.LIKE_A_FILE)
    author = F.when(sure & no_author, F.coalesce("_author", "authors")).otherwise(F.col("authors"))
    title = F.when(sure & like_file, F.coalesce("_title", "title")).otherwise(F.col("title"))
    changed = ~author.eqNullSafe(F.col("authors")) | ~title.eqNullSafe(F.col("title"))
    return joined.withColumns({"new_authors": author, "new_title": title, "enrichment": F.when(F.col("confidence").isNull(), "failed").when(changed, "enriched").otherwise("skipped")}).drop("_title", "_author")


def references_found(blocks: DataFrame) -> DataFrame:
    """Per book: bibliography pages, numbered and author-year citations, ISBNs, publishers with pages."""
    low = F.lower("text")
    head = F.when((F.col("block_type") == "SectionHeader") & text.any_of(low, fixed.BIBLIOGRAPHY_WORDS), F.col("page"))
    numbers = F.transform(F.regexp_extract_all("text", F.lit(fixed.NUMBERED_CITATION), F.lit(1)), lambda x: x.cast("int"))
    isbns = F.transform(F.regexp_extract_all("text", F.lit(fixed.CITED_ISBN), F.lit(1)), lambda x: F.regexp_replace(x, "-", ""))
    publishers = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(p.lower())), F.concat(F.lit(p + "@"), F.col("page").cast("string"))) for p in fixed.CITED_PUBLISHERS)))
    each = blocks.select("book_id", head.alias("head"), numbers.alias("numbers"), text.author_year_citations(F.col("text")).alias("cites"), isbns.alias("isbns"), publishers.alias("publishers"))
    some = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return each.groupBy("book_id").agg(F.array_sort(F.collect_set("head")).alias("bibliography_pages"), some("numbers").alias("numbers"), some("cites").alias("author_years"), some("isbns").alias("isbns"), some("publishers").alias("publishers"))


def mean_confidence(*columns: str) -> Column:
    """The mean of the parts' confidences, two digits."""
    return F.round(reduce(lambda a, b: a + b, (F.col(c) for c in columns)) / len(columns), 2)
