"""Registration of named queries, and the driver's tables seen as books.

A document is a book: its lines are blocks, ten to a page.  ``outline`` gives
every tenth block a chapter heading and every fifth a section heading, since
the documents have none of their own.  The SQL fragments state the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import fixed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_blocks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    lines = docs.select(F.col("doc_id").alias("book_id"), "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("raw_idx", "text"))
    return lines.withColumn("text", F.trim("text"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that have text, numbered densely."""
    kept = raw_blocks(spark, d).where("text <> ''")
    dense = (F.row_number().over(Window.partitionBy("book_id").orderBy("raw_idx")) - 1).alias("block_idx")
    kind = F.expr("CASE WHEN length(text) < 40 AND NOT endswith(text, '.') THEN 'SectionHeader' WHEN raw_idx % 7 = 3 THEN 'Code' ELSE 'Text' END").alias("block_type")
    return kept.select("book_id", dense, F.expr("CAST(raw_idx div 10 + 1 AS INT)").alias("page"), kind, "text", "lang", "source")


def outline(spark: SparkSession, d: str) -> DataFrame:
    out = blocks(spark, d)
    heading = F.expr("CASE WHEN block_idx % 10 = 0 THEN concat('Chapter ', block_idx div 10 + 1, ': ', trim(left(text, 20))) WHEN block_idx % 5 = 0 THEN trim(left(text, 30)) ELSE text END")
    return out.withColumns({"text": heading, "block_type": F.expr("IF(block_idx % 5 = 0, 'SectionHeader', 'Text')")})


def inline(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A few rows written down in the query; ``values_sql`` gives the same to SQL."""
    return spark.createDataFrame(rows, names)


def plus(rows: DataFrame, names: str, more: list[tuple]) -> DataFrame:
    """Rows of a table and, after them, a few odd ones that the tables lack; ``plus_sql`` says the same."""
    few = rows.sparkSession.createDataFrame(more, names)
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in few.schema)).unionByName(few)


def plus_sql(rows: str, columns: str, more: list[tuple]) -> str:
    return f"(SELECT {columns} FROM ({rows}) UNION ALL SELECT {columns} FROM {values_sql(columns, more)})"


def quoted(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(quoted, x)) + "]"
    return str(x)


def values_sql(columns: str, rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS v({columns})"


RAW_SQL = "raw AS (SELECT doc_id AS book_id, lang, source, unnest(range(len(l))) AS raw_idx, trim(unnest(l)) AS text FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents))"
BLOCKS_SQL = (
    RAW_SQL
    + """, blocks AS (SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY raw_idx) - 1 AS INT) AS block_idx, CAST(raw_idx // 10 + 1 AS INT) AS page,
    CASE WHEN length(text) < 40 AND NOT ends_with(text, '.') THEN 'SectionHeader' WHEN raw_idx % 7 = 3 THEN 'Code' ELSE 'Text' END AS block_type, text, lang, source FROM raw WHERE text <> '')"""
)
OUTLINE_SQL = (
    BLOCKS_SQL
    + """, outline AS (SELECT book_id, block_idx, page, CASE WHEN block_idx % 5 = 0 THEN 'SectionHeader' ELSE 'Text' END AS block_type, lang, source,
    CASE WHEN block_idx % 10 = 0 THEN concat('Chapter ', block_idx // 10 + 1, ': ', trim(left(text, 20))) WHEN block_idx % 5 = 0 THEN trim(left(text, 30)) ELSE text END AS text FROM blocks)"""
)


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def heading_sql(x: str) -> tuple[str, str]:
    """SQL for the chapter number and title of a heading, by the first pattern that matches."""
    bare = strip_sql(rf"regexp_replace({x}, '\*{{1,2}}', '', 'g')")
    case = lambda g: "CASE " + " ".join(f"WHEN regexp_matches({bare}, '(?i){p}') THEN regexp_extract({bare}, '(?i){p}', {g})" for p in fixed.CHAPTER_HEADINGS) + " END"
    return f"CAST({case(1)} AS INT)", strip_sql(case(2))


_number, _title = heading_sql("bare")
HEADS_SQL = (
    OUTLINE_SQL
    + rf""", heads AS (SELECT *, {strip_sql(r"regexp_replace(bare, '\*{1,2}', '', 'g')")} AS heading, {_number} AS number, {_title} AS title
      FROM (SELECT *, {strip_sql(r"regexp_replace(text, '^#+\s*', '')")} AS bare FROM outline WHERE block_type = 'SectionHeader')),
    seen AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY block_idx) AS nth, min(block_idx) OVER (PARTITION BY book_id) AS first FROM heads WHERE number IS NOT NULL),
    occ AS (SELECT *, block_idx < toc_end AS in_toc FROM (SELECT *, coalesce(max(CASE WHEN nth BETWEEN {fixed.TOC_FIRST} AND {fixed.TOC_LAST} AND block_idx - first < {fixed.TOC_BLOCKS} THEN block_idx END) OVER (PARTITION BY book_id) + 1, 0) AS toc_end FROM seen)),
    chapters AS (SELECT * FROM (SELECT book_id, number,
        coalesce(arg_max(title, block_idx) FILTER (NOT in_toc AND title <> ''), arg_min(title, block_idx) FILTER (in_toc AND title <> ''), '') AS title,
        arg_max(page, block_idx) FILTER (NOT in_toc) AS page_start, max(block_idx) FILTER (NOT in_toc) AS start_block_idx, bool_or(title <> '' OR NOT in_toc) AS known FROM occ GROUP BY ALL) WHERE known)"""
)
_skip = ", ".join(f"'{s}'" for s in fixed.SKIPPED_SECTIONS)
LABELS_SQL = (
    HEADS_SQL
    + f""", m AS (SELECT o.*, c.number, c.in_toc, h.heading, coalesce(max(c.toc_end) OVER (PARTITION BY o.book_id), 0) AS toc_end, count(c.number) OVER (PARTITION BY o.book_id) > 0 AS has_chapters,
        last_value(CASE WHEN c.in_toc THEN NULL ELSE c.number END IGNORE NULLS) OVER (PARTITION BY o.book_id ORDER BY o.block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter_num
      FROM outline o LEFT JOIN occ c USING (book_id, block_idx) LEFT JOIN heads h USING (book_id, block_idx)),
    n AS (SELECT *, CASE WHEN block_idx >= toc_end AND NOT (number IS NOT NULL AND NOT in_toc) AND heading <> '' AND lower(heading) NOT IN ({_skip}) AND (NOT has_chapters OR chapter_num IS NOT NULL) THEN heading END AS sec,
        CASE WHEN chapter_num IS NOT DISTINCT FROM lag(chapter_num) OVER (PARTITION BY book_id ORDER BY block_idx) THEN 0 ELSE 1 END AS changed FROM m),
    p AS (SELECT *, sum(changed) OVER (PARTITION BY book_id ORDER BY block_idx ROWS UNBOUNDED PRECEDING) AS run FROM n),
    labels AS (SELECT book_id, block_idx, page, block_type, text, chapter_num, last_value(sec IGNORE NULLS) OVER (PARTITION BY book_id, run ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_title FROM p)"""
)
