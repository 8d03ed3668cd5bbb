"""From blocks to the three collections, for all books at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import chunking, structure

Embed = Callable[[Column], Column]


def structured(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels (back matter trimmed) and the chapters that blocks still belong to."""
    labels = structure.trim_back_matter(structure.block_labels(blocks), structure.body_end(blocks))
    found = structure.chapters(blocks)
    kept = labels.where("chapter_num IS NOT NULL").select("book_id", F.col("chapter_num").alias("number")).distinct()
    return labels, found.join(kept, ["book_id", "number"], "left_semi")


def book_fields(books: DataFrame) -> DataFrame:
    """What every chunk repeats of its book."""
    return books.select(F.col("id").alias("book_id"), F.coalesce(F.nullif("title", F.lit("")), F.lit("Unknown")).alias("title"), F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ", ").alias("authors"), "subjects", F.coalesce("library", F.lit("")).alias("library"), "source_path")


def build(blocks: DataFrame, books: DataFrame, embed: Embed) -> dict[str, DataFrame]:
    """The rows of ``full``, ``equations`` and ``chapters``."""
    labels, found = structured(blocks)
    about = book_fields(books)
    context = structure.page_context(blocks.select("book_id", "page").distinct(), found)
    crumbs = structure.breadcrumbs(labels, found).select("book_id", "block_idx", "chapter_title", "breadcrumb")
    pieces = chunking.label_chunks(chunking.chunks(blocks.select("book_id", "block_idx", "page", "block_type", "text")), labels, context)
    full = pieces.join(crumbs, ["book_id", "block_idx"], "left")
    html = blocks if "html" in blocks.columns else blocks.withColumn("html", F.lit(None).cast("string"))
    equations = chunking.equations_with_context(html)
    equations = chunking.searchable_equations(equations, chunking.describe_latex(F.col("latex")))
    nodes = chunking.summaries(blocks, labels, found).withColumn("text", F.col("summary"))
    made = {"full": full, "equations": equations, "chapters": nodes}
    return {n: df.join(about, "book_id", "left").withColumn("embedding", embed(F.col("text"))) for n, df in made.items()}


def coverage(chunks: DataFrame, least: int = 10) -> DataFrame:
    """Chunks per book, and whether fewer than half of more than ``least`` have a chapter or section."""
    labelled = F.count_if(F.col("chapter_num").isNotNull() | F.col("section_title").isNotNull())
    counts = chunks.groupBy("book_id").agg(F.count("*").alias("chunks"), labelled.alias("labelled"))
    return counts.withColumn("poorly_labelled", (F.col("chunks") > least) & (F.col("labelled") * 2 < F.col("chunks")))
