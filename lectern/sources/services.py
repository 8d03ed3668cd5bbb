"""Extraction, scholarly and look-up services behind a transport that callers pass in.

Nothing here opens a connection: ``load`` makes a transport once per worker, a
function from a request to a reply.  What a reply must be like is checked in
the plan, so a service that fails gives a row with an error, and nothing of an
earlier, better run is lost: only rows without an error are ever saved.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.sinks import Collections
from lectern.sources.blocks import DOCUMENT, flat_blocks
from lectern.sources.remote import Completer
from lectern.sources.tei import is_tei


@dataclass(frozen=True)
class Request:
    """A call of ``path`` with form fields, and a file or a JSON body."""

    path: str
    fields: Mapping[str, str] = field(default_factory=dict)
    name: str | None = None
    content: bytes | None = None
    json: Mapping[str, object] | None = None


@dataclass(frozen=True)
class Reply:
    status: int
    body: str = ""


#: Carries a request out; raises what its client raises.
Transport = Callable[[Request], Reply]


def called(rows: DataFrame, load: Callable[[], Transport], path: str, name: str, content: str | None, into: str, *, attempts: int = 1, delay: float = 2.0, **fields: str) -> DataFrame:
    """Rows with a column ``into`` (status, body, error) of what the service replied to each.

    ``{}`` in ``path`` stands for the row's ``name``.  An exception of the
    transport is an error, after ``attempts`` with a growing delay.
    """

    @F.pandas_udf("status int, body string, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        send = load()

        def one(n: str | None, data: bytes | None) -> tuple[int | None, str | None, str | None]:
            request, said = Request(path.replace("{}", n or ""), fields, n, None if data is None else bytes(data)), ""
            for nth in range(attempts):
                if nth:
                    time.sleep(delay * nth)
                try:
                    reply = send(request)
                    return reply.status, reply.body, None
                except Exception as e:  # noqa: BLE001  whatever the client raises is an answer that failed
                    said = f"request failed: {e}"
            return None, None, said

        for names, contents in batches:
            yield pd.DataFrame([one(n, d) for n, d in zip(names, contents, strict=True)], columns=["status", "body", "error"]).astype({"status": "Int32"})

    return rows.withColumn(into, run(F.col(name).cast("string"), F.lit(None).cast("binary") if content is None else F.col(content)))


def _first_error(*checks: tuple[Column, Column]) -> Column:
    """The message of the first check that is true; null if none is."""
    return F.coalesce(*(F.when(F.coalesce(failed, F.lit(False)), message) for failed, message in checks))


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


# layout extraction

ENVELOPE = "success boolean, error string, output string, chunks string, metadata string, images map<string,string>"


def layout_of(files: DataFrame, load: Callable[[], Transport], *, remote: bool = False, html: bool = True, attempts: int = 1, delay: float = 2.0) -> DataFrame:
    """Each file (book_id, name, content) as blocks, metadata and, in a second call, HTML with its images.

    Returns book_id, document (JSON), metadata (JSON), page_count, html, images
    and error, which is null for whole extractions alone.  ``remote`` is the
    machine that is called as a function: its envelope holds ``chunks`` in
    place of ``output``, is asked once, and gives no HTML.
    """
    ask = lambda rows, kind, into: called(rows, load, "marker/upload", "name", "content", into, attempts=attempts, delay=delay, output_format=kind)
    first = _unpacked(ask(files, "chunks", "reply"), "reply", "chunks" if remote else "output")
    document = F.col("reply_output")
    parsed = F.from_json(document, DOCUMENT)
    malformed = F.coalesce(parsed["blocks"], parsed["chunks"]).isNull() & ~F.startswith(F.ltrim(document), F.lit("{"))
    stats = F.from_json("reply_metadata", "page_count int, page_stats array<string>")
    count = F.coalesce(F.nullif(stats["page_count"], F.lit(0)), F.nullif(F.greatest(F.size(stats["page_stats"]), F.lit(0)), F.lit(0)))
    out = first.withColumn("error", F.coalesce("reply_error", F.when(malformed, F.lit("chunks are no JSON object")))).withColumns({"document": document, "metadata": F.coalesce("reply_metadata", F.lit("{}")), "page_count": count})
    names = ["book_id", "document", "metadata", "page_count"]
    if remote or not html:
        return out.select(*names, F.lit(None).cast("string").alias("html"), F.lit(None).cast("map<string,binary>").alias("images"), "error")
    good = out.where("error IS NULL")
    second = _unpacked(ask(good, "html", "page"), "page", "output")
    plain = F.transform_keys("page_images", lambda k, v: F.regexp_extract(k, r"([^/\\]+)$", 1))
    images = F.transform_values(plain, lambda k, v: F.unbase64(v))
    done = second.select(*names, F.col("page_output").alias("html"), F.coalesce(images, F.create_map().cast("map<string,binary>")).alias("images"), F.when(F.col("page_error").isNotNull(), F.concat(F.lit("HTML: "), "page_error")).alias("error"))
    failed = out.where("error IS NOT NULL").select(*names, F.lit(None).cast("string").alias("html"), F.lit(None).cast("map<string,binary>").alias("images"), "error")
    return done.unionByName(failed)


def _unpacked(rows: DataFrame, reply: str, output: str) -> DataFrame:
    """The checked envelope of a reply: ``<reply>_output``, ``_metadata``, ``_images`` and ``_error``."""
    e = F.from_json(F.col(f"{reply}.body"), ENVELOPE)
    rows = rows.withColumn("_e", e)
    error = F.coalesce(
        F.col(f"{reply}.error"),
        _first_error(
            (F.col(f"{reply}.status") >= 400, F.concat(F.lit("HTTP "), F.col(f"{reply}.status"), F.lit(": "), F.left(F.col(f"{reply}.body"), F.lit(300)))),
            (F.coalesce(F.startswith(F.ltrim(f"{reply}.body"), F.lit("{")), F.lit(False)) == F.lit(False), F.lit("the reply is no JSON object")),
            (~F.coalesce(F.col("_e.success"), F.lit(False)), F.concat(F.lit("extraction failed: "), F.coalesce("_e.error", F.lit("unknown error")))),
            (_empty(F.col(f"_e.{output}")), F.lit(f"the reply has no '{output}'")),
        ),
    )
    return rows.withColumns({f"{reply}_error": error, f"{reply}_output": F.col(f"_e.{output}"), f"{reply}_metadata": F.col("_e.metadata"), f"{reply}_images": F.col("_e.images")}).drop("_e")


def blocks_of(extractions: DataFrame) -> DataFrame:
    """The blocks of extractions without an error, numbered as files of blocks are."""
    good = extractions.where("error IS NULL").select("book_id", F.from_json("document", DOCUMENT).alias("d"))
    return flat_blocks(good.select("book_id", F.coalesce("d.blocks", "d.chunks").alias("blocks")))


# scholarly documents

NO_REFERENCES = '<listBibl xmlns="http://www.tei-c.org/ns/1.0" />'
NO_TEXT = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader/><text><body/><back><listBibl/></back></text></TEI>'


def _tei(files: DataFrame, load: Callable[[], Transport], path: str, nothing: str, full: bool, consolidate: str, attempts: int, delay: float) -> DataFrame:
    rows = called(files, load, path, "name", "content", "reply", attempts=attempts, delay=delay, includeRawCitations="1", consolidateCitations=consolidate)
    said = F.trim(F.regexp_replace(F.coalesce("reply.body", F.lit("")), r"\s+", " "))
    short = F.when(F.length(said) > 500, F.concat(F.left(said, F.lit(500)), F.lit("…"))).otherwise(F.coalesce(F.nullif(said, F.lit("")), F.lit("(empty body)")))
    xml = F.when(F.col("reply.status") == 204, F.lit(nothing)).otherwise(F.col("reply.body"))
    rows = rows.withColumn("xml", xml)
    error = F.coalesce(F.col("reply.error"), _first_error((F.col("reply.status") >= 400, F.concat_ws(": ", F.col("reply.status").cast("string"), short)), (~is_tei(F.col("xml"), full), F.lit("the reply is no TEI document"))))
    return rows.select("book_id", error.alias("error"), F.when(error.isNull(), F.col("xml")).alias("xml"))


def references_of(files: DataFrame, load: Callable[[], Transport], *, consolidate: str = "0", attempts: int = 1, delay: float = 2.0) -> DataFrame:
    """Bibliographies (book_id, xml, error) of files; one without references (204) has an empty list.

    ``tei.read_tei(..., "references", full=False)`` reads them.
    """
    return _tei(files, load, "api/processReferences", NO_REFERENCES, False, consolidate, attempts, delay)


def fulltext_of(files: DataFrame, load: Callable[[], Transport], *, consolidate: str = "0", attempts: int = 1, delay: float = 2.0) -> DataFrame:
    """Whole TEI documents (book_id, xml, error); 204 is an empty one, any other reply without TEI an error."""
    return _tei(files, load, "api/processFulltextDocument", NO_TEXT, True, consolidate, attempts, delay)


# books by ISBN

VOLUMES = "totalItems int, items array<struct<volumeInfo:struct<title:string,authors:array<string>,publisher:string>>>"
EDITIONS = "map<string,struct<title:string,authors:array<struct<name:string>>,publishers:array<struct<name:string>>>>"


def books_by_isbn(books: DataFrame, volumes: Callable[[], Transport], editions: Callable[[], Transport], *, attempts: int = 1, delay: float = 2.0) -> DataFrame:
    """Metadata of books (id, isbn): id, title, authors, publisher, isbn, confidence, source.

    The second service is asked for what the first does not have; books that
    neither has, and those without an ISBN, have no row.
    """
    plain = F.translate("isbn", "- ", "")
    asked = books.select("id", plain.alias("isbn")).where("isbn <> ''")
    first = called(asked, volumes, "books/v1/volumes?q=isbn:{}", "isbn", None, "reply", attempts=attempts, delay=delay)
    v = F.from_json("reply.body", VOLUMES)
    one = F.get(v["items"], F.lit(0))["volumeInfo"]
    first = first.withColumn("b", F.when((F.col("reply.status") == 200) & (F.coalesce(v["totalItems"], F.lit(0)) > 0), one)).drop("reply")
    found = first.where("b IS NOT NULL").select("id", "b.title", "b.authors", "b.publisher", "isbn", F.lit("google_books").alias("source"))
    second = called(first.where("b IS NULL").select("id", "isbn"), editions, "api/books?bibkeys=ISBN:{}&format=json&jscmd=data", "isbn", None, "reply", attempts=attempts, delay=delay)
    e = F.try_element_at(F.from_json("reply.body", EDITIONS), F.concat(F.lit("ISBN:"), "isbn"))
    second = second.withColumn("b", F.when(F.col("reply.status") == 200, e)).where("b IS NOT NULL")
    people = F.transform("b.authors", lambda a: F.coalesce(a["name"], F.lit("")))
    rest = second.select("id", "b.title", people.alias("authors"), F.get("b.publishers", F.lit(0))["name"].alias("publisher"), "isbn", F.lit("openlibrary").alias("source"))
    both = found.unionByName(rest)
    return both.select("id", "title", F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), "publisher", "isbn", F.lit(1.0).alias("confidence"), "source")


# completions

def generate(send: Transport, model: str) -> Completer:
    """Completions of a server with one generating call."""

    def one(prompt: str) -> str:
        return json.loads(_good(send(Request("api/generate", json={"model": model, "prompt": prompt, "stream": False})))).get("response", "")

    return one


def chat(send: Transport, model: str = "auto", *, max_tokens: int = 1024, temperature: float = 0, extra: Mapping[str, object] | None = None) -> Completer:
    """Completions of a chat server; ``auto`` asks it which model it serves, again for each prompt.

    An empty answer is an error, so it is tried again.
    """

    def one(prompt: str) -> str:
        served = model
        if not model or model.lower() == "auto":
            models = json.loads(_good(send(Request("models")))).get("data", [])
            if not models:
                raise ValueError("the server serves no model")
            served = models[0]["id"]
        body = {"model": served, "messages": [{"role": "user", "content": prompt}], "max_tokens": max_tokens, "temperature": temperature, **(extra or {})}
        content = json.loads(_good(send(Request("chat/completions", json=body))))["choices"][0]["message"].get("content")
        if not content:
            raise ValueError("the answer is empty")
        return content

    return one


def messages(send: Transport, model: str, *, max_tokens: int = 1024) -> Completer:
    """Completions of a server of messages whose answer is a list of parts."""

    def one(prompt: str) -> str:
        body = {"model": model, "max_tokens": max_tokens, "messages": [{"role": "user", "content": prompt}]}
        return json.loads(_good(send(Request("messages", json=body))))["content"][0]["text"]

    return one


def _good(reply: Reply) -> str:
    if reply.status >= 400:
        raise OSError(f"HTTP {reply.status}: {reply.body[:300]}")
    return reply.body


# what is kept

EXTRACTED = "extractions"


def save_extractions(collections: Collections, extractions: DataFrame) -> DataFrame:
    """Keep whole extractions in place of what their books had; the others' (book_id, error) are returned.

    A book whose extraction failed keeps its earlier one.
    """
    good = extractions.where("error IS NULL")
    collections.index(EXTRACTED, good.drop("error"))
    return extractions.where("error IS NOT NULL").select("book_id", "error")


METADATA = "book_id bigint, source_hash string, source_filename string, format string, title string, authors array<string>, year int, publisher string, isbn string, page_count int, extractors_run array<string>, extraction_backend string, extracted_at string"


def save_metadata(collections: Collections, rows: DataFrame) -> None:
    """Keep one row of merged metadata per book, in place of what it had."""
    collections.index("metadata", rows)


def load_metadata(collections: Collections) -> DataFrame:
    rows = collections.read("metadata")
    return collections.spark.createDataFrame([], METADATA) if rows is None else rows
