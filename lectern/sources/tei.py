"""TEI documents of scholarly parsers: references, citations, sections, figures, header."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID = "{http://www.w3.org/XML/1998/namespace}id"
CONTEXTS = ("p", "s", "figDesc", "note", "item")
STRING = pa.string()
TABLES: dict[str, list[tuple[str, str, pa.DataType]]] = {
    "references": [(n, "string", STRING) for n in ("id", "type", "title")] + [("authors", "array<string>", pa.list_(STRING)), ("year", "int", pa.int32())] + [(n, "string", STRING) for n in ("container_title", "volume", "issue", "page", "publisher", "doi", "url", "note")],
    "citations": [(n, "string", STRING) for n in ("text", "ref_id", "context", "section")],
    "sections": [("title", "string", STRING), ("level", "int", pa.int32()), ("parent", "string", STRING)],
    "figures": [(n, "string", STRING) for n in ("id", "label", "caption", "type")],
    "header": [("title", "string", STRING), ("authors", "array<string>", pa.list_(STRING)), ("year", "int", pa.int32())],
}


def _words(e: ET.Element | None) -> str | None:
    return None if e is None else " ".join("".join(e.itertext()).split()) or None


class Tei:
    """One document, its tags without namespaces; ``ValueError`` for other roots."""

    def __init__(self, xml: str, *, full: bool = True):
        self.root = ET.fromstring(xml)
        for e in self.root.iter():
            e.tag = e.tag.rsplit("}", 1)[-1]
        if full and self.root.tag != "TEI":
            raise ValueError(f"not a TEI document but <{self.root.tag}>")
        self.entries = [self.root] if self.root.tag == "biblStruct" else self.root.findall(".//back//listBibl/biblStruct" if full else ".//biblStruct")

    @staticmethod
    def _id(entry: ET.Element, nth: int) -> str:
        last = re.search(r"(\d+)$", entry.get(ID, ""))
        return f"ref-{int(last[1]) + 1 if last else nth}"

    @staticmethod
    def _people(entry: ET.Element) -> list[str]:
        names = []
        for author in entry.findall("analytic/author") or entry.findall("monogr/author"):
            person = author.find("persName")
            if person is None:  # an author with only an affiliation is no person
                name = None if author.find("affiliation") is not None else _words(author)
            else:
                given = [w for w in map(_words, person.findall("forename")) if w]
                name = " ".join([*given, *filter(None, [_words(person.find("surname"))])]) or _words(person)
            if name:
                names.append(name)
        return names

    @staticmethod
    def _year(entry: ET.Element) -> int | None:
        date = entry.find("monogr/imprint/date")
        date = entry.find(".//date") if date is None else date
        found = None if date is None else re.search(r"\d{4}", date.get("when") or _words(date) or "")
        return int(found[0]) if found else None

    def references(self) -> list[tuple]:
        rows = []
        for nth, e in enumerate(self.entries, 1):
            article, container = _words(e.find("analytic/title")), _words(e.find("monogr/title"))
            raw = next((_words(n) for n in e.iter("note") if n.get("type") == "raw_reference"), None)
            scope = lambda unit, e=e: e.find(f"monogr/imprint/biblScope[@unit='{unit}']")
            pages = scope("page")
            span = None if pages is None else f"{pages.get('from')}-{pages.get('to')}" if pages.get("from") and pages.get("to") else _words(pages)
            ident = lambda kind, e=e: next((_words(i) for i in e.iter("idno") if i.get("type", "").lower() == kind), None)
            kind = "article" if not container else "article-journal" if article else "chapter"
            rows.append((self._id(e, nth), kind, article or raw, self._people(e), self._year(e), container, _words(scope("volume")), _words(scope("issue")), span, _words(e.find("monogr/imprint/publisher")), ident("doi"), ident("url"), raw and f"Raw reference: {raw}"))
        return rows

    def citations(self) -> list[tuple]:
        """Bibliographic anchors at any depth, with the nearest text around and the nearest headed section."""
        targets = {e.get(ID): self._id(e, nth) for nth, e in enumerate(self.entries, 1) if e.get(ID)}
        rows: list[tuple] = []

        def walk(e: ET.Element, context: ET.Element | None, section: str | None) -> None:
            if e.tag == "div" and (head := e.find("head")) is not None:
                section = _words(head)
            if e.tag in CONTEXTS:
                context = e
            if e.tag == "ref" and e.get("type") == "bibr" and (said := _words(e)):
                rows.append((said, targets.get(e.get("target", "").lstrip("#")), (_words(context) if context is not None else None) or "", section))
            for child in e:
                walk(child, context, section)

        if (body := self.root.find(".//body")) is not None:
            walk(body, None, None)
        return rows

    def sections(self) -> list[tuple]:
        """Headed divisions with level and parent; one without a heading adds no level."""
        rows: list[tuple] = []

        def walk(e: ET.Element, level: int, parent: str | None) -> None:
            for div in e.findall("div"):
                title = _words(div.find("head"))
                if title:
                    rows.append((title, level, parent))
                walk(div, level + bool(title), title or parent)

        if (body := self.root.find(".//body")) is not None:
            walk(body, 1, None)
        return rows

    def figures(self) -> list[tuple]:
        rows = []
        for e in self.root.iter("figure"):
            label, caption = _words(e.find("label")) or _words(e.find("head")), _words(e.find("figDesc"))
            if label or caption:
                rows.append((e.get(ID), label, caption, e.get("type", "figure")))
        return rows

    def header(self) -> list[tuple]:
        """Title, authors and year; only of documents that cite something."""
        head = self.root.find(".//teiHeader")
        if head is None or not self.entries:
            return []
        source = head.find(".//sourceDesc/biblStruct")
        return [(_words(head.find(".//titleStmt/title")), self._people(source) if source is not None else [], self._year(source) if source is not None else None)]


def is_tei(xml: Column, full: bool = True) -> Column:
    """Whether a text is well-formed XML with the root that a TEI document, or a bibliography, has."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        def good(x: str | None) -> bool:
            try:
                Tei(x or "", full=full)
            except (ValueError, ET.ParseError):
                return False
            return True

        return texts.map(good)

    return run(xml)


def read_tei(docs: DataFrame, table: str, key: str = "book_id", xml: str = "xml", *, full: bool = True) -> DataFrame:
    """One of ``TABLES`` of all documents, with the document's key and ``nth`` in its order.

    A document that is no TEI fails the job: it must not pass as an empty one.
    """
    fields = TABLES[table]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [getattr(Tei(x.as_py(), full=full), table)() for x in batch.column(1)]
            row = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            flat = [r for f in found for r in f]
            nth = pa.array([n for f in found for n in range(len(f))], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), nth, *(pa.array([r[i] for r in flat], t) for i, (_, _, t) in enumerate(fields))], names=[key, "nth", *(f[0] for f in fields)])

    return docs.where(f"{xml} IS NOT NULL").select(key, xml).mapInArrow(run, f"`{key}` {kind}, nth int, " + ", ".join(f"{n} {t}" for n, t, _ in fields))
