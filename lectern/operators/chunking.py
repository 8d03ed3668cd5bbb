"""Chunks, equations with context, and summaries of books.

Splitting looks at one block or one document at a time, so it runs in Arrow
batches; everything that relates blocks to each other stays in the JVM.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import fixed, text, tokens
from lectern.operators.structure import ordered_text

SENTENCE = re.compile(r"(?<=[.!?])\s+|\n{2,}")
EQUATION = re.compile(r"\$\$(.+?)\$\$", re.S)
WHERE = re.compile(r"where\s+.+?(?:\.\s|\n\n|$)", re.I | re.S)
BREAKS = (". ", ".\n", "? ", "! ")


def _fitting(word: str, size: int, count: tokens.Counter) -> list[str]:
    """A word, or text without spaces, cut into parts of at most ``size`` tokens."""
    if count(word) <= size:
        return [word]
    out, at = [], 0
    while at < len(word):
        lo, hi = 1, len(word) - at
        while lo < hi:  # the longest part that fits; one character always goes in
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if count(word[at : at + mid]) <= size else (lo, mid - 1)
        out.append(word[at : at + lo])
        at += lo
    return out


#: A text with its tokens at the start of a piece and after a space.
Unit = tuple[str, int, int]


def _units(body: str, size: int, count: tokens.Counter) -> list[Unit]:
    """Sentences; one above ``size`` in runs of words, each as long as fits."""
    unit = lambda t: (t, count(t), count(" " + t))
    out: list[Unit] = []
    for sentence in SENTENCE.split(body):
        words = sentence.split()
        if not words:
            continue
        whole = unit(" ".join(words))
        if max(whole[1:]) <= size:
            out.append(whole)
            continue
        now: list[Unit] = []
        for part in (unit(p) for w in words for p in _fitting(w, size - 1, count)):
            if now and _tokens([*now, part]) > size:
                out.append(unit(" ".join(t for t, *_ in now)))
                now = []
            now.append(part)
        out.append(unit(" ".join(t for t, *_ in now)))
    return out


def _tokens(units: list[Unit]) -> int:
    return units[0][1] + sum(u[2] for u in units[1:]) if units else 0


def split_sentences(body: str, size: int = fixed.CHUNK_TOKENS, overlap: int = fixed.CHUNK_OVERLAP, count: tokens.Counter = tokens.rough) -> list[str]:
    """Pieces of at most ``size`` tokens made of whole sentences, the next one starting with up to ``overlap`` tokens again.

    A sentence above ``size`` is cut between words, a word above it between
    characters.  A text that fits is one piece, as it is.
    """
    body = body.strip()
    if not body or count(body) <= size:
        return [body] if body else []
    pieces: list[list[Unit]] = []
    now: list[Unit] = []
    for unit in _units(body, size, count):
        if now and _tokens([*now, unit]) > size:
            pieces.append(now)
            kept = now[1:]
            while kept and (_tokens(kept) > overlap or _tokens([*kept, unit]) > size):
                kept = kept[1:]
            now = kept
        now = [*now, unit]
    return [" ".join(text for text, *_ in p) for p in [*pieces, now] if p]


def equation_zones(body: str, around: int = 300) -> list[tuple[int, int]]:
    """Stretches around display equations that stay whole; overlapping ones are one.

    A "where ..." clause that follows decides the end instead of ``around``.
    """
    zones: list[tuple[int, int]] = []
    for m in EQUATION.finditer(body):
        clause = WHERE.search(body[m.end() : m.end() + 500])
        end = m.end() + clause.end() if clause else min(len(body), m.end() + around)
        zones.append((max(0, m.start() - around), end))
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(zones):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def chunk_with_equations(body: str, size: int = 512, overlap: int = 50, around: int = 300) -> list[tuple[int, int, str]]:
    """``(start, end, text)`` of chunks of about ``size`` characters that don't cut equation zones.

    A chunk ends after a paragraph or else a sentence, if one ends in its
    second half; the next one starts ``overlap`` characters earlier.
    """
    zones, out, at = equation_zones(body, around), [], 0
    while at < len(body):
        end = min(at + size, len(body))
        for lo, hi in zones:
            if lo <= at < hi or at < lo < end < hi:
                end = max(end, hi)
                break
        half = at + size // 2
        stops = [(body.rfind("\n\n", at, end + 50), 2), *((body.rfind(b, at, end + 50), len(b)) for b in BREAKS)]
        end = next((i + n for i, n in stops if i > half), end)
        if piece := body[at:end].strip():
            out.append((at, end, piece))
        following = end - overlap
        at = following if out and following > out[-1][0] else end
        if end >= len(body):
            if at < len(body) and (tail := body[at:].strip()):
                out.append((at, len(body), tail))
            break
    return out


def _exploded(rows: DataFrame, column: str, pieces: Callable[[str], list], out: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """``rows`` without ``column``, one row per piece with the columns ``out`` (name, type in Spark, type in Arrow)."""
    keep = [c for c in rows.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pieces(x.as_py() or "") for x in batch.column(batch.num_columns - 1)]
            row = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            flat = [x for f in found for x in f]
            made = [pa.array([x[k] for x in flat], kind) for k, (_, _, kind) in enumerate(out)]
            yield pa.RecordBatch.from_arrays([*(c.take(row) for c in batch.columns[:-1]), *made], names=[*keep, *(o[0] for o in out)])

    source = rows.select(*keep, column)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + [f"{n} {t}" for n, t, _ in out]
    return source.mapInArrow(run, ", ".join(fields))


def chunks(blocks: DataFrame, size: int = fixed.CHUNK_TOKENS, overlap: int = fixed.CHUNK_OVERLAP, tokenizer: str | None = None) -> DataFrame:
    """Blocks as chunks: code without line numbers, long blocks split, ``piece_idx`` within the block.

    Sizes are tokens of the embedding model: ``tokenizer`` is its vocabulary
    file, by default the one that ``LECTERN_TOKENIZER`` names; without either
    they are estimated.
    """
    path = tokenizer or os.environ.get("LECTERN_TOKENIZER")
    ready = blocks.withColumn("text", F.when(F.col("block_type") == "Code", text.clean_code(F.col("text"))).otherwise(F.col("text")))
    split = lambda body: list(enumerate(split_sentences(body, size, overlap, tokens.counter(path))))
    return _exploded(ready, "text", split, [("piece_idx", "int", pa.int32()), ("text", "string", pa.string())])


def equation_chunks(docs: DataFrame, text_col: str = "text", size: int = 512, overlap: int = 50) -> DataFrame:
    found = lambda body: [(i, *c) for i, c in enumerate(chunk_with_equations(body, size, overlap))]
    return _exploded(docs, text_col, found, [("piece_idx", "int", pa.int32()), ("start", "int", pa.int32()), ("end", "int", pa.int32()), ("chunk", "string", pa.string())])


def label_chunks(chunks_: DataFrame, labels: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunks with the labels of their block; those without any get their page's chapter."""
    named = chunks_.join(labels.select("book_id", "block_idx", "chapter_num", "section_title"), ["book_id", "block_idx"], "left")
    by_page = pages.select("book_id", "page", F.col("chapter_num").alias("_chapter"))
    joined = named.join(by_page, ["book_id", "page"], "left")
    neither = F.col("chapter_num").isNull() & F.col("section_title").isNull()
    return joined.withColumn("chapter_num", F.when(neither, F.col("_chapter")).otherwise(F.col("chapter_num"))).drop("_chapter")


def equations_with_context(blocks: DataFrame, chars: int = 500, reach: int = 50) -> DataFrame:
    """Equation blocks with their LaTeX, number, and the text before and after.

    Context is that of the nearest ``reach`` blocks that are no equations.
    """
    is_eq = F.lower("block_type") == "equation"
    body = F.when(~is_eq, F.nullif(F.coalesce(F.nullif(F.col("text"), F.lit("")), text.html_to_text(F.col("html"))), F.lit("")))
    order = Window.partitionBy("book_id").orderBy("block_idx")
    near = lambda a, b: F.array_join(F.collect_list("_body").over(order.rowsBetween(a, b)), " ")
    seen = blocks.withColumn("_body", body).withColumns({"_before": near(-reach, -1), "_after": near(1, reach), "_parts": text.equation_parts(F.coalesce("html", F.lit("")))})
    plain = F.nullif(text.strip(F.replace(F.coalesce("text", F.lit("")), F.lit("\\_"), F.lit("_"))), F.lit(""))
    after = F.left("_after", F.lit(chars))
    latex = F.coalesce("_parts.latex", plain)
    number = F.coalesce("_parts.number", text.group_or_null(F.concat_ws(" ", latex, F.left("_after", F.lit(100))), r"\((\d+)\)"))
    return seen.where(is_eq).where(latex.isNotNull()).select("book_id", "block_idx", "page", latex.alias("latex"), number.alias("equation_number"), F.right("_before", F.lit(chars)).alias("context_before"), after.alias("context_after"))


def searchable_equations(equations: DataFrame, description: Column) -> DataFrame:
    """Equations with tags and the text to search: description, number, and the terms a "where" explains."""
    terms = F.nullif(F.regexp_extract("context_after", r"(?is)where\s+(.+?)(?:\.|\z)", 1), F.lit(""))
    named = F.when(F.col("equation_number").isNotNull(), F.concat(F.lit("equation "), "equation_number"))
    around = F.concat_ws(" ", "context_before", "context_after")
    window = F.concat(F.col("context_before"), F.lit("\n$$"), F.col("latex"), F.lit("$$\n"), F.col("context_after"))
    return equations.withColumns({"tags": text.equation_tags(F.col("latex"), around), "context_window": window, "text": F.concat_ws(" ", description, named, terms)})


def describe_latex(latex: Column) -> Column:
    """LaTeX in words, by the names of its commands; braces and markup go."""
    plain = F.regexp_replace(latex, r"\\(?:left|right|mathrm|mathbf|text|begin|end|displaystyle)\b", "")
    plain = F.regexp_replace(plain, r"\\frac\{([^{}]*)\}\{([^{}]*)\}", "$1/$2")
    plain = F.regexp_replace(plain, r"\\([A-Za-z]+)", " $1 ")
    return text.strip(F.regexp_replace(F.regexp_replace(plain, r"[{}\\&]", " "), text.SPACES, " "))


def augment_equations(c: Column) -> Column:
    """Each display equation of a text followed by itself in words; inline math stays."""
    return F.regexp_replace(c, r"(?s)(\$\$(.+?)\$\$)", "$1\n[Mathematical equation: $2]")


def summaries(blocks: DataFrame, labels: DataFrame, chapters: DataFrame, summarize: Callable[[Column], Column] | None = None, least: int = 1500, most: int = 40) -> DataFrame:
    """Summary nodes: one per book; per chapter if it has any, else per long section in reading order.

    ``summarize`` maps texts to summaries, by default their first paragraph
    cut to 500 characters; books and sections without a summary have no node.
    """
    summarize = summarize or (lambda c: F.left(F.get(F.split(c, "\n\n"), F.lit(0)), F.lit(500)))
    level = lambda df, name: df.withColumn("level", F.lit(name)).withColumn("summary", summarize(F.left("text", F.lit(4000))))
    labelled = labels.select("book_id", "block_idx", "text", "chapter_num", "section_title")
    none = F.lit(None)
    book = level(ordered_text(blocks, ["book_id"], "block_idx"), "book").select("book_id", "level", none.cast("int").alias("chapter_num"), none.cast("string").alias("section_title"), "summary")
    per_chapter = level(ordered_text(labelled.where("chapter_num IS NOT NULL"), ["book_id", "chapter_num"], "block_idx"), "chapter")
    first = labelled.where("section_title IS NOT NULL").groupBy("book_id", "section_title").agg(F.min("block_idx").alias("_first"))
    long = ordered_text(labelled.where("section_title IS NOT NULL"), ["book_id", "section_title"], "block_idx").where(F.length("text") >= least).join(first, ["book_id", "section_title"])
    nth = F.row_number().over(Window.partitionBy("book_id").orderBy("_first"))
    flat = long.join(chapters.select("book_id").distinct(), "book_id", "left_anti").withColumn("_nth", nth).where(F.col("_nth") <= most)
    columns = ["book_id", "level", "chapter_num", "section_title", "summary"]
    out = book.unionByName(per_chapter.withColumn("section_title", none.cast("string")).select(*columns)).unionByName(level(flat, "section").withColumn("chapter_num", none.cast("int")).select(*columns))
    return out.where("summary <> ''")
