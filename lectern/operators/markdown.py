"""Structure of markdown books: a scan of each book's lines.

Later lines depend on earlier ones (the last page seen, the open chapter), so
a book is scanned in one go; books run side by side in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed

# Forms of headings in markdown.
TOP = re.compile(r"^#\s+(.+)$")
TITLE = re.compile(r"^#{1,3}\s+\*{0,2}([^#\n]+?)\*{0,2}\s*$")
LOWER = re.compile(r"^#{2,3}\s+\*{0,2}(.+?)\*{0,2}\s*$")
BOOK_SECTION = re.compile(rf"^Section\s+({'|'.join(fixed.NUMBER_WORDS)}|\d+)[:\s]+(.+)$", re.I)
GRAMMAR = tuple(re.compile(p, re.I) for p in fixed.CHAPTER_HEADINGS)
PAGES = (re.compile(r"page-(\d+)"), re.compile(r"_page_(\d+)_"))
#: Lines after a bare chapter heading that may hold its title, and lines that may hold its page.
TITLE_WITHIN, PAGE_WITHIN = 3, 19
NO_SECTIONS = ("chapter summary", "notes", "references")
END_MARKERS = ("Appendix", r"Index\b", "Bibliography", "About the Author")
SCHEMA = [("kind", "string", pa.string()), ("number", "int", pa.int32()), ("title", "string", pa.string()), ("page_start", "int", pa.int32()), ("page_end", "int", pa.int32()), ("parent", "int", pa.int32())]


def page_of(line: str) -> int | None:
    """The page that a line marks; page 0 is no page."""
    found = [m for p in PAGES for m in p.findall(line)]
    return int(found[0]) or None if found else None


def chapter_of(heading: str) -> tuple[int, str] | None:
    bare = re.sub(r"\*{1,2}", "", heading).strip()
    m = next((m for p in GRAMMAR if (m := p.match(bare))), None)
    return (int(m[1]), (m[2] or "").strip()) if m else None


def _title_below(lines: list[str]) -> str:
    """Title of a chapter from the first line with text below its heading, if that is one."""
    first = next((x for x in lines[:TITLE_WITHIN] if x.strip()), "")
    m = TITLE.match(first)
    title = m[1].strip() if m else ""
    return "" if any(p in title.lower() for p in fixed.NOT_A_TITLE) else title


def scan(content: str) -> list[tuple]:
    """Rows of ``SCHEMA`` in reading order: book sections, chapters, sections.

    ``parent`` is a section's chapter, or a chapter's book section by place.
    A chapter's last page is the last one seen before the next chapter, its
    summary, or the end.
    """
    rows: list[dict] = []
    chapter: dict | None = None
    page, book_sections = None, 0
    lines = content.split("\n")
    add = lambda **r: rows.append(dict.fromkeys((n for n, _, _ in SCHEMA)) | r) or rows[-1]

    def close() -> None:
        if chapter is not None and page:
            chapter["page_end"] = page

    for i, line in enumerate(lines):
        page = page_of(line) or page
        lower, top = LOWER.match(line), TOP.match(line)
        heading = lower[1].strip() if lower else ""
        part = BOOK_SECTION.match(heading)
        found = chapter_of(top[1]) if top else None
        if part:
            word = part[1].lower()
            book_sections += 1
            add(kind="book_section", number=int(word) if word.isdigit() else fixed.NUMBER_WORDS.index(word) + 1, title=part[2].strip())
        elif found:
            close()
            ahead = next((p for x in lines[i + 1 : i + 1 + PAGE_WITHIN] if (p := page_of(x))), None)
            chapter = add(kind="chapter", number=found[0], title=found[1] or _title_below(lines[i + 1 :]), page_start=page or ahead, parent=book_sections or None)
        elif heading.lower() == "chapter summary":
            close()
        elif heading and chapter is not None and heading.lower() not in NO_SECTIONS:
            add(kind="section", title=heading, page_start=page, parent=chapter["number"])
    close()
    return [tuple(r[n] for n, _, _ in SCHEMA) for r in rows]


def chapter_text(content: str, number: int, numbers: list[int]) -> str:
    """Text of a chapter: up to the next one if there is such, else to the end matter or the end."""
    at = lambda n: rf"(?im)^#\s+\*{{0,2}}Chapter\s+{n}\b"
    start = re.search(at(number), content)
    if number not in numbers or not start:
        return ""
    body = content[start.start() :]
    ends = [re.compile(at(number + 1)).search(body, 1)] if number + 1 in numbers else []
    ends += [re.search(rf"(?im)^#\s+\*{{0,2}}{m}", body) for m in END_MARKERS]
    return body[: next((m.start() for m in ends if m), len(body))]


def parse_books(books: DataFrame, key: str = "book_id", text_col: str = "text") -> DataFrame:
    """Structure rows of all books, ``nth`` in reading order."""
    kind = books.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(x.as_py() or "") for x in batch.column(1)]
            row = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            flat = [r for f in found for r in f]
            nth = pa.array([n for f in found for n in range(len(f))], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), nth, *(pa.array([r[i] for r in flat], t) for i, (_, _, t) in enumerate(SCHEMA))], names=[key, "nth", *(n for n, _, _ in SCHEMA)])

    return books.select(key, text_col).mapInArrow(run, f"`{key}` {kind}, nth int, " + ", ".join(f"{n} {t}" for n, t, _ in SCHEMA))


def chapter_texts(books: DataFrame, key: str = "book_id", text_col: str = "text") -> DataFrame:
    """Text of every chapter of every book."""
    kind = books.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, texts = [], [], []
            for k, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = [r[1] for r in scan(content or "") if r[0] == "chapter"]
                for n in dict.fromkeys(own):
                    keys.append(k)
                    numbers.append(n)
                    texts.append(chapter_text(content, n, own))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=[key, "number", "text"])

    return books.select(key, text_col).mapInArrow(run, f"`{key}` {kind}, number int, text string")


def render_contents(structure: DataFrame, key: str = "book_id") -> DataFrame:
    """A book's chapters and sections as an indented list."""
    page = F.when(F.col("page_start").isNotNull(), F.concat(F.lit(" (p. "), F.col("page_start").cast("string"), F.lit(")"))).otherwise("")
    line = F.when(F.col("kind") == "chapter", F.concat(F.lit("Chapter "), F.col("number").cast("string"), F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(": "), "title")).otherwise(""), page)).when(F.col("kind") == "section", F.concat(F.lit("  - "), "title", page)).otherwise(F.col("title"))
    listed = F.array_sort(F.collect_list(F.struct("nth", line.alias("line"))))
    return structure.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("contents"))
