"""A library as one object: catalog, blocks and collections below a folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.operators import audit, catalog, filters, index, navigate, retrieval, structure
from lectern.operators.sinks import Collections, Versions
from lectern.sources.remote import Embedder, embed

BOOKS = "id bigint, title string, authors array<string>, isbn string, format string, status string, source_path string, subjects array<string>, library string, publisher string"
#: What is kept of a book besides what is searched.
TABLES = ("blocks", "labels", "chapters_of_books")
#: What a collection that does not exist yet looks like to searches.
CHUNKS = "text string, book_id bigint, page int, chapter_num int, section_title string, block_idx int, piece_idx int, block_type string, title string, authors string, library string, subjects array<string>, embedding array<float>"


class Library:
    """Reads are lazy DataFrames; writes add a version or a batch and then point to it.

    ``load`` makes the embedder, once per worker and once here for queries.
    """

    def __init__(self, spark: SparkSession, folder: str, load: Callable[[], Embedder]):
        self.spark, self.folder, self.load = spark, folder.rstrip("/"), load
        self.collections = Collections(spark, self.folder)
        self.catalog = Versions(spark, f"{self.folder}/books")

    # catalog

    def _rows(self) -> DataFrame:
        """All books ever: deleted ones keep their id."""
        return self.catalog.read(BOOKS)

    def books(self, status: str | None = None) -> DataFrame:
        """The catalog: the newest of its versions, empty if there is none."""
        rows = self._rows().where("NOT status <=> 'deleted'")
        return (rows if status is None else rows.where(F.col("status") == status)).orderBy("id")

    def register(self, incoming: DataFrame) -> DataFrame:
        """Add books (title, source_path and other fields) that aren't known; all with id and already_exists.

        Ids of deleted books are not given again.
        """
        fields = [c for c in incoming.columns if c not in ("id", "status", "title", "source_path")]
        # Of rows with one title in any case, the first by title and path is the book.
        same = F.coalesce(F.lower("title"), F.concat(F.lit("/"), "source_path"))
        asked = incoming.groupBy(same.alias("_same")).agg(F.min(F.struct("title", "source_path", *fields)).alias("b")).select("b.*")
        before = self.books()
        seen = catalog.register(before, asked.select("title", "source_path"), self._rows()).where("NOT already_exists")
        seen = seen.select(F.col("title").alias("_title"), F.col("source_path").alias("_path"), "id")
        new = asked.join(seen, F.expr("title <=> _title AND source_path <=> _path")).drop("_title", "_path").withColumn("status", F.lit("pending"))
        self.catalog.save(self._rows().unionByName(new, allowMissingColumns=True))
        found = catalog.register(self.books(), incoming.select("title", "source_path")).drop("already_exists")
        known = before.select("id", F.lit(True).alias("already_exists"))
        return found.join(known, "id", "left").select("title", "source_path", "id", F.coalesce("already_exists", F.lit(False)).alias("already_exists"))

    def update(self, changes: DataFrame) -> None:
        """Change books' fields (nulls change nothing) and what their chunks repeat of them."""
        self.catalog.save(catalog.patch(self._rows(), changes))
        ids = changes.select(F.col("id").alias("book_id"))
        about = index.book_fields(self.books()).withColumnRenamed("book_id", "id").join(changes.select("id"), "id", "left_semi")
        for name in Collections.NAMES:
            rows = self.collections.read(name)
            if rows is not None:
                own = rows.join(ids, "book_id", "left_semi")
                self.collections.index(name, catalog.propagate(own, about, ("title", "authors", "library", "subjects")))

    def delete(self, ids: Iterable[int]) -> None:
        """Books go from the catalog and from every collection; their ids are not given again, their files stay."""
        gone = self.spark.createDataFrame([(i,) for i in ids], "id bigint")
        marked = self._rows().join(gone.withColumn("_gone", F.lit(True)), "id", "left")
        nothing = [F.when(F.col("_gone"), F.lit("deleted") if c == "status" else F.lit(None)).otherwise(F.col(c)).alias(c) if c != "id" else F.col(c) for c in self._rows().columns]
        self.catalog.save(marked.select(*nothing))
        for name in (*Collections.NAMES, *TABLES):
            self.collections.remove(name, gone.withColumnRenamed("id", "book_id"))

    def profile(self) -> DataFrame:
        return audit.library_profile(self.books(), self._or_none("full", "book_id bigint"))

    def _or_none(self, name: str, schema: str) -> DataFrame:
        rows = self.collections.read(name)
        return self.spark.createDataFrame([], schema) if rows is None else rows

    # indexing

    def index(self, blocks: DataFrame) -> DataFrame:
        """Index all books that ``blocks`` has, in place of what they had; per-book coverage.

        A book that no longer has equations, say, loses those it had.
        """
        books = blocks.select(F.col("book_id").cast("bigint").alias("book_id")).distinct()
        labels, chapters = index.structured(blocks)
        self.collections.index_all({"blocks": blocks, "labels": labels.drop("text"), "chapters_of_books": chapters}, books)
        self.collections.index_all(index.build(blocks, self.books(), lambda c: embed(c, self.load)), books)
        done = books.select(F.col("book_id").alias("id")).withColumn("status", F.lit("indexed"))
        self.catalog.save(catalog.patch(self._rows(), done))
        return index.coverage(self._known("full"))

    def blocks(self) -> DataFrame:
        return self._or_none("blocks", "book_id bigint, block_idx int, page int, block_type string, text string")

    def labels(self) -> DataFrame:
        return self._or_none("labels", "book_id bigint, block_idx int, page int, block_type string, chapter_num int, section_title string")

    # search

    def _vector(self, query: str) -> Column:
        return F.array(*(F.lit(float(x)) for x in self.load()([query])[0]))

    def _known(self, name: str) -> DataFrame:
        """A collection's rows of books in the catalog, each with a key for ties; none if it doesn't exist yet."""
        rows = self._or_none(name, CHUNKS)
        own = rows.join(self.books().select(F.col("id").alias("book_id")), "book_id", "left_semi")
        place = [c for c in ("block_idx", "piece_idx", "chapter_num", "section_title") if c in rows.columns]
        return own.withColumn("vec_id", F.concat_ws("/", "book_id", *(F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("")), 12, " ") for c in place)))

    def search(self, query: str, k: int = 5, *, equations: int = 3, images: DataFrame | None = None, **where) -> DataFrame:
        """Text chunks and, of the best books, equations; with the images of a hit's page if given."""
        vector, rows = self._vector(query), self._known("full")
        texts = retrieval.vector_top_k(rows, vector, k, filters.metadata(**where))
        maths = self._known("equations") if equations else None
        hits = texts.withColumn("result_type", F.lit("text")) if maths is None else retrieval.fused(texts, retrieval.vector_top_k(maths, vector, equations))
        shaped = retrieval.search_rows(hits.withColumn("book_id", F.col("book_id").cast("int")))
        if images is None:
            return shaped
        numbered = shaped.withColumn("hit_id", F.monotonically_increasing_id())
        return numbered.join(retrieval.images_of_hits(numbered, images), "hit_id", "left").drop("hit_id")

    def search_chapters(self, query: str, k: int = 3, by: str = "relevance") -> DataFrame:
        return retrieval.chapters_ordered(self._known("chapters"), self._vector(query), k, by)

    def search_hierarchical(self, query: str, k: int = 5, chapters: int = 3, *, strict: bool = False, **where) -> DataFrame:
        return retrieval.search_rows(retrieval.hierarchical(self._known("full"), self._known("chapters"), self._vector(query), k, chapters, strict=strict, condition=filters.metadata(**where)))

    def text_search(self, needle: str, k: int = 10, **where) -> DataFrame:
        return retrieval.search_rows(retrieval.text_search(self._known("full"), needle, k, filters.metadata(**where), ("book_id", "block_idx", "piece_idx")))

    # reading

    def spans(self) -> DataFrame:
        return structure.ranges(self.labels(), "chapter_num", "section_title")

    def read_span(self, book_id: int, *, chapter: int | None = None, section: str | None = None, cursor: str | None = None, max_chars: int = fixed.SPAN_CHARS) -> DataFrame:
        rows = self.blocks().join(self.labels().select("book_id", "block_idx", "chapter_num", "section_title"), ["book_id", "block_idx"]).where(F.col("book_id") == book_id)
        if chapter is not None:
            rows = rows.where(F.col("chapter_num") == chapter)
        if section is not None:
            rows = rows.where(F.col("section_title") == section)
        return navigate.read_span(rows, "book_id", "block_idx", max_chars, cursor)

    def verify(self) -> DataFrame:
        """Completeness and text quality of every indexed book; the worse status counts."""
        rows = self._known("full")
        both = audit.completeness(rows).join(audit.ocr_quality(rows).select("book_id", F.col("status").alias("text_quality")), "book_id", "left")
        worst = F.when(F.array_contains(F.array("status", "text_quality"), "red"), "red").when(F.array_contains(F.array("status", "text_quality"), "yellow"), "yellow").otherwise("green")
        return both.withColumn("overall", worst)
