"""EPUB books as blocks: spine documents in order, their top-level elements typed."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame

# Block types of elements; elements that count without text; elements without an end.
TYPES = {**dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "SectionHeader"), "ul": "ListGroup", "ol": "ListGroup", "table": "Table", "figure": "Figure"}
COUNT_EMPTY = ("img", "figure", "table")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = "page int, block_num int, block_id string, block_type string, html string"


class _TopLevel(HTMLParser):
    """Collects the children of the body, each as (tag or None, html, text)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str | None, str, str]] = []
        self.open: list[str] = []
        self.html: list[str] = []
        self.text: list[str] = []
        self.in_body = False

    def _close(self, tag: str | None) -> None:
        self.found.append((tag, "".join(self.html), "".join(self.text).strip()))
        self.html, self.text = [], []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body", "head"):
            self.in_body = self.in_body or tag == "body"
            self.open, self.html, self.text = [], [], []
            return
        self.html.append(self.get_starttag_text() or f"<{tag}>")
        if tag not in VOID:
            self.open.append(tag)
        elif not self.open:
            self._close(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.html.append(self.get_starttag_text() or f"<{tag}/>")
        if not self.open:
            self._close(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("body", "html", "head"):
            if tag == "head":
                self.found, self.html, self.text, self.open = [], [], [], []
            return
        if tag not in self.open:
            return
        while self.open:
            last = self.open.pop()
            self.html.append(f"</{last}>")
            if last == tag:
                break
        if not self.open:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if self.open:
            self.html.append(escape(data, quote=False))
            self.text.append(data)
        elif data.strip():
            self.html, self.text = [f"<p>{escape(data.strip(), quote=False)}</p>"], [data]
            self._close(None)


def blocks_of_html(page: str, number: int) -> list[tuple[int, int, str, str, str]]:
    """Rows of ``BLOCKS``: elements without text are left out, but for images, figures and tables."""
    parser = _TopLevel()
    parser.feed(page)
    parser.close()
    if parser.open or parser.html:
        parser._close(parser.open[0] if parser.open else None)
    out = []
    for tag, html, text in parser.found:
        if text or tag in COUNT_EMPTY:
            kind = TYPES.get(tag or "", "Text")
            out.append((number, len(out), f"/chapter/{number}/{kind}/{len(out)}", kind, html))
    return out


def read_epub(data: bytes) -> tuple[dict, list[tuple[int, int, str, str, str]]]:
    """Metadata (title, authors, publisher, year) and blocks; pages are the non-empty spine documents from 1."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        local = lambda e: e.tag.rsplit("}", 1)[-1]
        container = ET.fromstring(z.read("META-INF/container.xml"))
        opf_path = next(e.attrib["full-path"] for e in container.iter() if local(e) == "rootfile")
        opf = ET.fromstring(z.read(opf_path))
        values: dict[str, list[str]] = {}
        for e in opf.iter():
            if local(e) in ("title", "creator", "publisher", "date") and (e.text or "").strip():
                values.setdefault(local(e), []).append(e.text.strip())
        items = {e.attrib["id"]: e.attrib["href"] for e in opf.iter() if local(e) == "item"}
        spine = [items[e.attrib["idref"]] for e in opf.iter() if local(e) == "itemref" and e.attrib["idref"] in items]
        rows, page = [], 0
        for href in spine:
            found = blocks_of_html(z.read(posixpath.normpath(posixpath.join(posixpath.dirname(opf_path), href))).decode("utf-8", "replace"), page + 1)
            if found:
                page += 1
                rows += found
    year = re.search(r"\d{4}", values.get("date", [""])[0])
    return {"title": next(iter(values.get("title", [])), None), "authors": values.get("creator", []), "publisher": next(iter(values.get("publisher", [])), None), "year": int(year[0]) if year else None}, rows


def epub_blocks(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Blocks of EPUB files given as binary content, e.g. by the ``binaryFile`` source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                rows = read_epub(data.as_py())[1]
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(rows), k.type), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())))], names=[key, "page", "block_num", "block_id", "block_type", "html"])

    return files.select(key, content).mapInArrow(run, f"`{key}` string, {BLOCKS}")


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Top-level blocks of HTML pages."""
    kind = pages.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks_of_html(x.as_py() or "", 1) for x in batch.column(1)]
            row = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            flat = [r for f in found for r in f]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array([r[1] for r in flat], pa.int32()), pa.array([r[3] for r in flat], pa.string()), pa.array([r[4] for r in flat], pa.string())], names=[key, "block_num", "block_type", "html"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind.simpleString()}, block_num int, block_type string, html string")


def opf_metadata(opf: F.Column) -> F.Column:  # noqa: F821
    """``struct(title, authors, publisher, year)`` of a package document, by XPath in the JVM."""
    from pyspark.sql import functions as F

    at = lambda name: F.xpath(opf, F.lit(f"//*[local-name()='{name}']/text()"))
    year = F.nullif(F.regexp_extract(F.coalesce(F.get(at("date"), F.lit(0)), F.lit("")), r"(\d{4})", 1), F.lit("")).cast("int")
    return F.struct(F.get(at("title"), F.lit(0)).alias("title"), at("creator").alias("authors"), F.get(at("publisher"), F.lit(0)).alias("publisher"), year.alias("year"))
