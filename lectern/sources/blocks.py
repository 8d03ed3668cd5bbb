"""Extracted documents (JSON), markdown, PDF text and binary listings as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text

BLOCK = "struct<id:string,block_type:string,html:string,text:string,page:int,images:map<string,string>,bbox:array<double>>"
DOCUMENT = f"blocks array<{BLOCK}>, chunks array<{BLOCK}>"
# What a book's folder may hold, by path below it.
ARTIFACTS = {
    "content": "raw/marker/document.json",
    "meta": "raw/marker/metadata.json",
    "markdown": "raw/marker/document.md",
    "html": "raw/marker/document.html",
    "equations": "raw/marker/equations.json",
    "pdftext": "raw/pdftotext/document.txt",
    "pdftext_pages": "raw/pdftotext/pages.json",
    "pdftext_meta": "raw/pdftotext/metadata.json",
    "fulltext": "raw/grobid/fulltext.tei.xml",
    "references": "raw/grobid/references.tei.xml",
    "structure": "structure.json",
    "metadata": "metadata.json",
}
#: The folder that names the book: the one above a tool's folder, else the file's own.
BOOK_OF_PATH = r"/([^/]+)/(?:raw/[^/]+/)?[^/]+$"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of extraction JSON below ``path`` (one document per file, under ``blocks`` or ``chunks``).

    The folder names the book.  ``raw_idx`` counts all blocks, ``block_idx``
    those that have text.
    """
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    book = F.regexp_extract(F.input_file_name(), BOOK_OF_PATH, 1)
    return flat_blocks(docs.select(book.alias("book_id"), F.coalesce("blocks", "chunks").alias("blocks")))


def flat_blocks(docs: DataFrame) -> DataFrame:
    """A row per block of documents (book_id, blocks)."""
    rows = docs.select("book_id", F.posexplode("blocks").alias("raw_idx", "b"))
    body = F.coalesce(F.nullif(text.strip(F.col("b.text")), F.lit("")), text.html_to_text(F.col("b.html"), "structured"))
    flat = rows.select("book_id", "raw_idx", "b.page", F.coalesce("b.block_type", F.lit("Text")).alias("block_type"), "b.html", body.alias("text"), F.col("b.id").alias("block_id"), "b.images", "b.bbox")
    return number_blocks(flat)


def number_blocks(raw: DataFrame) -> DataFrame:
    """Drops blocks without text and numbers the others densely."""
    dense = F.row_number().over(Window.partitionBy("book_id").orderBy("raw_idx")) - 1
    return raw.where("text <> ''").withColumn("block_idx", dense)


def to_markdown(blocks: DataFrame) -> DataFrame:
    """Each book's blocks in order as one markdown text, headers as headings."""
    from lectern.operators.structure import ordered_text

    line = F.when(F.col("block_type") == "SectionHeader", F.concat(F.lit("# "), "text")).when(F.col("block_type") == "Code", F.concat(F.lit("```\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    return ordered_text(blocks.withColumn("text", line), ["book_id"], "block_idx")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Whole markdown files: book_id, raw, and text with equations in words."""
    from lectern.operators.chunking import augment_equations

    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), BOOK_OF_PATH, 1).alias("book_id"), F.col("value").alias("raw"), augment_equations(F.col("value")).alias("text"))


def split_pages(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Pages of form-fed text, from 1; the empty page after the last feed is none."""
    rows = texts.select("*", F.posexplode(F.split(F.regexp_replace(text_col, r"\f\z", ""), "\f", -1)).alias("_at", "page_text"))
    return rows.select(*(c for c in texts.columns if c != text_col), (F.col("_at") + 1).alias("page"), F.rtrim(F.col("page_text"), F.lit("\n")).alias("text"))


def kinds_of_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Files (``path``) that are artifacts of a book: with ``book_id`` and ``kind``."""
    kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), F.regexp_extract(path, rf"/([^/]+)/{re.escape(name)}$", 1).alias("book")) for kind, name in ARTIFACTS.items()))
    # The longest path decides: what a tool wrote is not the book's own file of that name.
    found = F.filter(kinds, lambda k: (k["book"] != "") & ~((k["kind"] == "metadata") & F.col(path).rlike(r"/raw/[^/]+/[^/]+$")))
    return files.withColumn("_k", F.get(found, F.lit(0))).where("_k IS NOT NULL").withColumns({"book_id": F.col("_k.book"), "kind": F.col("_k.kind")}).drop("_k")


def artifacts(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Artifacts below a folder of books, of one kind or all: book_id, kind, path, size, hash of the content.

    Contents are read only for the hash: a query that doesn't ask for it lists
    files and no more.
    """
    if kind is not None and kind not in ARTIFACTS:
        raise ValueError(f"no such artifact: {kind}")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if kind is not None:
        reader = reader.option("pathGlobFilter", ARTIFACTS[kind].rpartition("/")[2])
    found = kinds_of_files(reader.load(path))
    found = found if kind is None else found.where(F.col("kind") == kind)
    return found.select("book_id", "kind", "path", F.col("length").alias("size_bytes"), text.content_hash(F.col("content")).alias("source_hash"))


def library_folders(paths: DataFrame) -> DataFrame:
    """``Title (ID)/file`` paths as books; a PDF is preferred to an EPUB."""
    parts = paths.select("path", F.regexp_extract("path", r"/([^/]+) \((\d+)\)/[^/]+$", 1).alias("title"), F.regexp_extract("path", r" \((\d+)\)/[^/]+$", 1).try_cast("int").alias("id"), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("format"))
    usable = parts.where("id IS NOT NULL AND format IN ('pdf', 'epub')")
    return usable.groupBy("id").agg(F.min_by(F.struct("title", "format", "path"), F.struct(F.when(F.col("format") == "pdf", 0).otherwise(1), "path")).alias("b")).select("id", "b.*")


def pdf_signals(info: DataFrame) -> DataFrame:
    """Page count, page size and embedded megapixels from the tools' text output (path, pdfinfo, pdfimages)."""
    pages = F.regexp_extract("pdfinfo", r"Pages:\s+(\d+)", 1).try_cast("int")
    wide, high = (F.regexp_extract("pdfinfo", r"Page size:\s+([\d.]+) x ([\d.]+)", g).try_cast("double") for g in (1, 2))
    rows = F.filter(F.split("pdfimages", "\n"), lambda x: x.rlike(r"^\s*\d+\s+\d+\s+\w+\s+\d+\s+\d+"))
    area = F.aggregate(F.transform(rows, lambda x: F.regexp_extract(x, r"^\s*\d+\s+\d+\s+\w+\s+(\d+)\s+(\d+)", 1).cast("double") * F.regexp_extract(x, r"^\s*\d+\s+\d+\s+\w+\s+(\d+)\s+(\d+)", 2).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return info.select("path", pages.alias("pages"), (area / 1e6).alias("img_mpix"), (wide / 72 * 192 * high / 72 * 192 / 1e6).alias("page_megapix"))


def read_bench_queries(spark: SparkSession, path: str) -> DataFrame:
    schema = "query string, expected_sources array<string>, expected_terms array<string>, collection string, description string"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def images_of_blocks(blocks: DataFrame) -> DataFrame:
    """Image files that blocks refer to, with page, kind and caption of the first that does."""
    names = F.array_distinct(F.concat(F.coalesce(F.map_keys("images"), F.array().cast("array<string>")), F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""src=["']([^"']+)["']"""), F.lit(1))))
    each = blocks.select("book_id", "raw_idx", "page", "block_type", "text", F.explode(names).alias("ref"))
    stem = F.regexp_replace(F.regexp_extract("ref", r"([^/]+)$", 1), r"\.\w+$", "")
    first = each.withColumn("stem", stem).groupBy("book_id", "stem").agg(F.min_by(F.struct("page", "block_type", "text"), "raw_idx").alias("b"))
    kind = F.lower(F.regexp_extract("stem", r"_page_\d+_([A-Za-z]+)_\d+", 1))
    page, index = (F.regexp_extract("stem", p, 1).try_cast("int") for p in (r"_page_(\d+)_", r"_page_\d+_[A-Za-z]+_(\d+)"))
    label = text.group_or_null(F.col("b.text"), r"(?i)^((?:figure|fig\.|table)\s+\d+(?:\.\d+)*)")
    return first.select("book_id", F.concat(F.lit("marker:"), "stem").alias("image_id"), F.when(kind.isin("figure", "picture", "table"), kind).when(F.col("b.block_type") == "FigureGroup", "figure").otherwise("unknown").alias("kind"), page.alias("page"), index.alias("index"), F.col("b.page").alias("marker_page"), F.nullif(F.col("b.text"), F.lit("")).alias("caption"), label.alias("label"))


def image_name(stem: F.Column) -> F.Column:
    """``struct(page, kind, idx)`` that an image's name without ending says; null where it doesn't."""
    part = lambda p: F.nullif(F.regexp_extract(stem, p, 1), F.lit(""))
    return F.struct(part(r"_page_(\d+)_").try_cast("int").alias("page"), F.lower(part(r"_page_\d+_([A-Za-z]+)_")).alias("kind"), part(r"_(\d+)$").try_cast("int").alias("idx"))


def resolve_image(image_id: F.Column) -> F.Column:
    """File name of an image id; null for anything but a plain name with a picture's ending."""
    name = F.regexp_extract(F.try_url_decode(image_id) if hasattr(F, "try_url_decode") else F.url_decode(image_id), r"^marker:([^/\\]+\.(?:png|jpe?g|gif|webp))$", 1)
    return F.when((name != "") & ~F.startswith(name, F.lit(".")), name)


#: Endings of files that are taken in.
BOOK_ENDINGS = ("pdf", "epub")


def extractor_of(path: F.Column) -> F.Column:
    """Which kind of extraction a file needs, by its ending in any case; others are unsupported."""
    ending = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    return F.when(ending.isin(*BOOK_ENDINGS), ending).otherwise(F.lit("unsupported"))


def uploads(spark: SparkSession, folder: str, *, stream: bool = False) -> DataFrame:
    """Files put into a folder, as rows to register: title, format, path, size, hash, and why one is refused.

    The title is the file's name without ending and underscores.  Empty files
    have no row.  ``stream`` reads files as they come.
    """
    reader = spark.readStream if stream else spark.read
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = reader.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder) if stream else reader.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = extractor_of(F.col("path"))
    refused = F.when(kind == "unsupported", F.lit("only .pdf and .epub files are taken"))
    title = F.trim(F.translate(F.regexp_replace(F.try_url_decode(name), r"\.\w+$", ""), "_", " "))
    return files.select(title.alias("title"), F.when(kind != "unsupported", kind).alias("format"), F.col("path").alias("source_path"), F.col("length").alias("size_bytes"), text.content_hash(F.col("content")).alias("source_hash"), refused.alias("refused"))
