"""Chapters and sections of books from their blocks, by windows over reading order.

``blocks`` has book_id, block_idx, page, block_type and text.  Everything is
partitioned by book; a book is one document's blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from lectern.functions import fixed, text


def _book() -> WindowSpec:
    """A book in reading order."""
    return Window.partitionBy("book_id").orderBy("block_idx")


def _so_far() -> WindowSpec:
    return _book().rowsBetween(Window.unboundedPreceding, 0)


def headings(blocks: DataFrame) -> DataFrame:
    """Section headers with ``heading`` (cleaned) and ``chapter`` (number and title, or null)."""
    bare = text.strip(F.regexp_replace("text", r"^#+\s*", ""))
    heads = blocks.where(F.col("block_type") == "SectionHeader")
    return heads.withColumn("heading", text.strip(F.regexp_replace(bare, r"\*{1,2}", ""))).withColumn("chapter", text.chapter_heading(bare))


def chapter_occurrences(blocks: DataFrame) -> DataFrame:
    """Chapter headings with ``in_toc``: a table of contents is an early cluster of them.

    If any of the 4th to 10th occurrence lies within 100 blocks of the first,
    all up to the last such are entries of the table of contents.
    """
    found = headings(blocks).where("chapter IS NOT NULL").select("book_id", "block_idx", "page", F.col("chapter.number").alias("number"), F.col("chapter.title").alias("title"))
    nth, first = F.row_number().over(_book()), F.min("block_idx").over(Window.partitionBy("book_id"))
    near = F.when(nth.between(fixed.TOC_FIRST, fixed.TOC_LAST) & (F.col("block_idx") - first < fixed.TOC_BLOCKS), F.col("block_idx"))
    ended = found.withColumn("_near", near).withColumn("toc_end", F.coalesce(F.max("_near").over(Window.partitionBy("book_id")) + 1, F.lit(0)))
    return ended.drop("_near").withColumn("in_toc", F.col("block_idx") < F.col("toc_end"))


def chapters(blocks: DataFrame) -> DataFrame:
    """One row per chapter number: number, title, page_start, start_block_idx.

    The last heading outside the table of contents counts; titles are filled
    from earlier ones.  Chapters that only the table of contents has need a
    title and have no page.
    """
    at = chapter_occurrences(blocks)
    titled = F.col("title") != ""
    grouped = at.groupBy("book_id", "number").agg(
        F.max(F.expr("IF(NOT in_toc, block_idx, NULL)")).alias("start_block_idx"),
        F.expr("max_by(coalesce(page, 0), block_idx) FILTER (WHERE NOT in_toc)").alias("page_start"),
        F.expr("max_by(title, block_idx) FILTER (WHERE NOT in_toc AND title <> '')").alias("later"),
        F.expr("min_by(title, block_idx) FILTER (WHERE in_toc AND title <> '')").alias("earlier"),
        F.bool_or(titled | ~F.col("in_toc")).alias("known"),
    )
    return grouped.where("known").select("book_id", "number", F.coalesce("later", "earlier", F.lit("")).alias("title"), "page_start", "start_block_idx")


def block_labels(blocks: DataFrame) -> DataFrame:
    """Every block with chapter_num and section_title, by the last heading before it.

    Sections end where the chapter changes; books without chapters have
    sections all the same.
    """
    at = chapter_occurrences(blocks).select("book_id", "block_idx", "number", "in_toc", "toc_end")
    heads = headings(blocks).select("book_id", "block_idx", "heading")
    marked = blocks.join(at, ["book_id", "block_idx"], "left").join(heads, ["book_id", "block_idx"], "left")
    whole = Window.partitionBy("book_id")
    marked = marked.withColumn("toc_end", F.coalesce(F.max("toc_end").over(whole), F.lit(0))).withColumn("has_chapters", F.count("number").over(whole) > 0)
    marked = marked.withColumn("chapter_num", F.last(F.expr("IF(in_toc, NULL, number)"), True).over(_so_far()))
    is_start = F.col("number").isNotNull() & ~F.coalesce("in_toc", F.lit(True))
    section = F.when((F.col("block_idx") >= F.col("toc_end")) & ~is_start & (F.col("heading") != "") & ~F.lower("heading").isin(*fixed.SKIPPED_SECTIONS) & (~F.col("has_chapters") | F.col("chapter_num").isNotNull()), F.col("heading"))
    changed = F.when(F.col("chapter_num").eqNullSafe(F.lag("chapter_num").over(_book())), 0).otherwise(1)
    marked = marked.withColumn("_section", section).withColumn("_changed", changed).withColumn("_run", F.sum("_changed").over(_so_far()))
    within = Window.partitionBy("book_id", "_run").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("section_title", F.last("_section", True).over(within)).select("book_id", "block_idx", "page", "block_type", "text", "chapter_num", "section_title")


def breadcrumbs(labels: DataFrame, chapters_: DataFrame) -> DataFrame:
    """Labels with chapter_title and breadcrumb."""
    titles = chapters_.select("book_id", F.col("number").alias("chapter_num"), F.col("title").alias("chapter_title"))
    joined = labels.join(titles, ["book_id", "chapter_num"], "left")
    return joined.withColumn("breadcrumb", text.breadcrumb(F.col("chapter_num"), F.col("chapter_title"), F.col("section_title")))


def page_context(pages: DataFrame, chapters_: DataFrame) -> DataFrame:
    """Chapter of each (book_id, page): the first, by number, whose pages hold it.

    A chapter's pages end before the start of the next numbered one; the last
    has no end.
    """
    by_number = Window.partitionBy("book_id").orderBy("number")
    spans = chapters_.select("book_id", "number", "title", "page_start", F.lead("page_start").over(by_number).alias("next_start"))
    inside = (F.col("page") >= F.col("page_start")) & (F.col("next_start").isNull() | (F.col("page") < F.col("next_start")))
    hit = pages.join(spans, "book_id").where(inside)
    best = hit.groupBy("book_id", "page").agg(F.min_by("number", "number").alias("chapter_num"), F.min_by("title", "number").alias("chapter_title"))
    return pages.join(best, ["book_id", "page"], "left")


def body_end(blocks: DataFrame) -> DataFrame:
    """Block where each book's back matter begins, null without any.

    Looked for in the back half of books of 20 blocks or more: a heading that
    names back matter, or the first of four headings in a row of at most two
    characters (an index's letters), whichever is seen first.
    """
    n = F.count("*").over(Window.partitionBy("book_id"))
    sized = blocks.withColumn("_n", n).where((F.col("_n") >= 20) & (F.col("block_idx") >= F.floor(F.col("_n") / 2)))
    heads = headings(sized).where("heading <> ''").withColumn("_named", F.col("heading").rlike("(?i)" + fixed.BACK_MATTER)).withColumn("_letter", F.length("heading") <= 2)
    run = F.sum(F.expr("IF(_letter, 0, 1)")).over(_so_far())
    heads = heads.withColumn("_run", run)
    in_run = Window.partitionBy("book_id", "_run", "_letter").orderBy("block_idx")
    heads = heads.withColumn("_nth", F.row_number().over(in_run)).withColumn("_start", F.min("block_idx").over(in_run))
    seen = heads.where("_named OR (_letter AND _nth = 4)").select("book_id", "block_idx", F.expr("IF(_named, block_idx, _start)").alias("body_end"))
    return seen.groupBy("book_id").agg(F.min_by("body_end", "block_idx").alias("body_end"))


def trim_back_matter(labels: DataFrame, ends: DataFrame) -> DataFrame:
    """Labels from the end of the body on are taken away; the blocks stay."""
    joined = labels.join(ends, "book_id", "left")
    inside = F.col("body_end").isNull() | (F.col("block_idx") < F.col("body_end"))
    return joined.withColumns({c: F.when(inside, F.col(c)) for c in ("chapter_num", "section_title")}).drop("body_end")


def ranges(labels: DataFrame, *keys: str) -> DataFrame:
    """First and last block of each chapter or section."""
    present = labels.where(F.col(keys[-1]).isNotNull())
    return present.groupBy("book_id", *keys).agg(F.min("block_idx").alias("start_block_idx"), F.max("block_idx").alias("end_block_idx"))


def ordered_text(rows: DataFrame, keys: list[str], order: str, text_col: str = "text", joint: str = "\n\n") -> DataFrame:
    """Texts of a group in order, joined by ``joint``; empty ones are left out."""
    there = rows.where(F.coalesce(F.col(text_col), F.lit("")) != "")
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text_col).alias("t"))))
    return there.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["t"]), joint).alias("text"))


def validate(chapters_: DataFrame, total_pages: DataFrame) -> DataFrame:
    """Per book: chapters, chapters with pages, page coverage (at most 1), chapters that start before one before them."""
    by_number = Window.partitionBy("book_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    paged = F.expr("IF(page_start > 0, page_start, NULL)")
    following = F.lead("page_start").over(Window.partitionBy("book_id").orderBy("number"))
    rows = chapters_.withColumn("_before", F.last(paged, True).over(by_number)).withColumn("_end", following).join(total_pages, "book_id", "left")
    covered = F.when(paged.isNotNull(), F.coalesce("_end", "total_pages") - F.col("page_start"))
    counted = rows.groupBy("book_id").agg(
        F.count("*").alias("chapter_count"), F.count(paged).alias("chapters_with_pages"),
        F.count_if(paged < F.col("_before")).alias("out_of_order"), F.sum(covered).alias("_covered"), F.max("total_pages").alias("_total"),
    )
    return counted.withColumn("page_coverage", F.when(F.col("_total") > 0, F.least(F.lit(1.0), F.coalesce(F.col("_covered"), F.lit(0)) / F.col("_total"))).otherwise(0.0)).drop("_covered", "_total")


def heading_records(blocks: DataFrame, chars: int = 180) -> DataFrame:
    """Headings (240 characters) with a peek: the body text up to the next heading, cut to ``chars``."""
    is_head = F.col("block_type") == "SectionHeader"
    runs = blocks.withColumn("_run", F.sum(F.when(is_head, 1).otherwise(0)).over(_so_far()))
    body = ordered_text(runs.where(~is_head), ["book_id", "_run"], "block_idx", joint=" ").withColumnRenamed("text", "_body")
    heads = runs.where(is_head).withColumn("heading", F.left(text.clean_heading(F.col("text")), F.lit(240))).where("heading <> ''")
    return heads.join(body, ["book_id", "_run"], "left").select("book_id", "block_idx", "page", "heading", F.left(F.coalesce("_body", F.lit("")), F.lit(chars)).alias("peek"))


def chapter_level(records: DataFrame, least: int = 3) -> DataFrame:
    """Per book the shallowest heading level that occurs at least ``least`` times."""
    counts = records.where("level IS NOT NULL").groupBy("book_id", "level").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least).groupBy("book_id").agg(F.min("level").alias("level"))


def in_order(proposals: DataFrame) -> DataFrame:
    """Of each book's ``proposed`` array of (number, start) those that rise in both, greedily.

    An array fold: each is kept if it rises over the last that was kept.
    """
    kind = "array<struct<number:int,start:int>>"
    rises = "size(s) = 0 OR (x.number > element_at(s, -1).number AND x.start > element_at(s, -1).start)"
    kept = "concat(s, array(named_struct('number', x.number, 'start', x.start)))"
    fold = f"aggregate(proposed, CAST(array() AS {kind}), (s, x) -> IF(x.number > 0 AND x.start >= 0 AND ({rises}), {kept}, s))"
    return proposals.withColumn("accepted", F.expr(fold))


def from_chapters(blocks: DataFrame, accepted: DataFrame) -> DataFrame:
    """Labels from validated chapters (book_id, number, title, start): ranges run to the next start.

    Other headings become sections, but not those that echo the chapter's
    title within two blocks of it.
    """
    starts = accepted.select("book_id", F.col("start").alias("block_idx"), F.col("number").alias("_number"), F.col("title").alias("_title"))
    heads = headings(blocks).select("book_id", "block_idx", "heading")
    marked = blocks.join(starts, ["book_id", "block_idx"], "left").join(heads, ["book_id", "block_idx"], "left")
    last = lambda c: F.last(c, True).over(_so_far())
    marked = marked.withColumns({"chapter_num": last("_number"), "chapter_title": last("_title"), "_at": last(F.expr("IF(_number IS NULL, NULL, block_idx)"))})
    echo = text.same_text(F.coalesce("heading", F.lit("")), F.coalesce("chapter_title", F.lit(""))) & (F.col("block_idx") - F.col("_at") <= 2)
    section = F.when(F.col("_number").isNull() & F.col("chapter_num").isNotNull() & (F.col("heading") != "") & ~echo & ~F.lower("heading").isin(*fixed.SKIPPED_SECTIONS), F.col("heading"))
    within = Window.partitionBy("book_id", "_at").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("_section", section).withColumn("section_title", F.last("_section", True).over(within)).select("book_id", "block_idx", "page", "block_type", "text", "chapter_num", "chapter_title", "section_title")


def decision(proposed: Column, accepted: Column) -> Column:
    """What an audit's answer is worth: ``no_answer``, ``rejected``, ``no_change`` or ``apply``."""
    return F.when(proposed.isNull(), "no_answer").when(F.size(accepted) == 0, "rejected").when(F.size(accepted) == F.size(proposed), "apply").otherwise("apply_valid")


def fit_prompt(heads: DataFrame, budget: int = 38_000, caps: tuple[int, ...] = (120, 96, 64, 40, 0)) -> DataFrame:
    """Each book's headings as one text within the budget: peeks are cut to the first cap that fits, then the text is."""
    lines = lambda cap: F.array_join(F.transform("rows", lambda r: F.concat(F.lit("["), r["block_idx"].cast("string"), F.lit("] "), r["heading"], F.when(F.lit(cap > 0) & (r["peek"] != ""), F.concat(F.lit(" :: "), F.left(r["peek"], F.lit(cap)))).otherwise(""))), "\n")
    listed = heads.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", "heading", "peek"))).alias("rows"))
    fits = [F.when(F.length(lines(c)) <= budget, lines(c)) for c in caps]
    return listed.select("book_id", F.coalesce(*fits, F.left(lines(0), F.lit(budget))).alias("prompt"))
