"""Joins, windows, orders and set operations as the operators use them, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import audit, catalog, chunking, enrich, filters, metrics, relations, structure
from lectern.plans.collection_queries import METRICS_SQL, _scores
from lectern.plans.registry import BLOCKS_SQL, HEADS_SQL, LABELS_SQL, OUTLINE_SQL, blocks, inline, outline, plus, plus_sql, query, table
from lectern.plans.text_queries import _subjects
from lectern.sources import blocks as block_sources
from lectern.sources import remote

S = SparkSession


def _labels(spark: S, d: str) -> DataFrame:
    return structure.block_labels(outline(spark, d))


@query(f"WITH {BLOCKS_SQL} SELECT block_idx, page, text FROM blocks WHERE book_id = 7")
def s03_blocks_of_a_book(spark: S, d: str) -> DataFrame:
    return blocks(spark, d).where("book_id = 7").select("block_idx", "page", "text")


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id IN (1, 2, 3, 5, 8)")
def s16_catalog_by_ids(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("doc_id").isin(1, 2, 3, 5, 8)).select("doc_id", "source", "lang")


@query("SELECT item_id, text AS query FROM benchmark")
def s22_bench_queries(spark: S, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))


@query(f"WITH {BLOCKS_SQL} SELECT book_id, block_idx FROM blocks WHERE source = 'src2' AND block_type = 'Text' AND book_id = 42")
def f01_metadata_and(spark: S, d: str) -> DataFrame:
    rows = blocks(spark, d).withColumnRenamed("source", "library")
    return filters.where(rows, filters.metadata(library="src2", block_type="Text", book_id=42)).select("book_id", "block_idx")


@query(f"WITH {LABELS_SQL} SELECT book_id, block_idx FROM labels WHERE chapter_num IN (1, 3)")
def f04_chapters_in(spark: S, d: str) -> DataFrame:
    wanted = inline(spark, "chapter_num int", [(1,), (3,)])
    return _labels(spark, d).join(F.broadcast(wanted), "chapter_num", "left_semi").select("book_id", "block_idx")


PRESENT = [(1, "indexed", "978", "/c"), (2, "pending", "", None), (3, "indexed", None, "/d"), (4, "failed", "12", None)]


_present = ("d.doc_id AS id", "CASE WHEN quality = 0 THEN 'failed' ELSE 'pending' END AS status", "nullif(nullif(lang, 'en'), 'de') AS isbn", "CASE WHEN d.doc_id % 3 = 0 THEN source END AS path")


@query(f"SELECT id, coalesce(isbn, '') <> '' AS has_isbn, path IS NOT NULL AS converted FROM {plus_sql(f'SELECT {str(chr(44)).join(_present)} FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id', 'id, status, isbn, path', PRESENT)} WHERE status <> 'failed'")
def f09_presence(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents").alias("d").join(table(spark, d, "labels").alias("l"), F.expr("l.doc_id = d.doc_id"), "left").selectExpr(*_present)
    rows = plus(docs, "id bigint, status string, isbn string, path string", PRESENT).where("status <> 'failed'")
    return rows.select("id", (F.coalesce("isbn", F.lit("")) != "").alias("has_isbn"), F.col("path").isNotNull().alias("converted"))


@query(f"WITH {BLOCKS_SQL} SELECT b.book_id, b.block_idx, coalesce(nullif(d.source, ''), 'Unknown') AS title FROM blocks b LEFT JOIN documents d ON d.doc_id = b.book_id AND d.doc_id % 2 = 0")
def j01_blocks_with_titles(spark: S, d: str) -> DataFrame:
    books = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("book_id"), F.col("source").alias("title"))  # every second book is missing, so that the default shows
    return relations.with_fields(blocks(spark, d).select("book_id", "block_idx"), books, "book_id", title="Unknown")


@query(f"WITH {BLOCKS_SQL} SELECT l.doc_id, coalesce(n, 0) AS chunks FROM labels l LEFT JOIN (SELECT book_id, count(*) AS n FROM blocks WHERE block_type = 'Code' GROUP BY ALL) c ON c.book_id = l.doc_id")
def j03_counts_default_zero(spark: S, d: str) -> DataFrame:
    code = blocks(spark, d).where("block_type = 'Code'").select(F.col("book_id").alias("doc_id"))
    return relations.tallied(table(spark, d, "labels").select("doc_id"), code, "doc_id", chunks=F.count("*"))


@query(f"""WITH {BLOCKS_SQL} SELECT d.doc_id, coalesce(a.n, 0) AS blocks, coalesce(b.n, 0) AS headers, coalesce(c.p, 0) AS pages FROM documents d LEFT JOIN (SELECT book_id, count(*) AS n FROM blocks GROUP BY ALL) a ON a.book_id = d.doc_id
  LEFT JOIN (SELECT book_id, count(*) AS n FROM blocks WHERE block_type = 'SectionHeader' GROUP BY ALL) b ON b.book_id = d.doc_id LEFT JOIN (SELECT book_id, max(page) AS p FROM blocks GROUP BY ALL) c ON c.book_id = d.doc_id""")
def j04_many_left_joins(spark: S, d: str) -> DataFrame:
    """Three joins in the reference's habit; here one aggregate, then one join."""
    rows = blocks(spark, d).withColumnRenamed("book_id", "doc_id")
    return relations.tallied(table(spark, d, "documents").select("doc_id"), rows, "doc_id", blocks=F.count("*"), headers=F.count_if(F.col("block_type") == "SectionHeader"), pages=F.max("page"))


@query("SELECT vec_id FROM embeddings WHERE label >= 5 AND vec_id % 20 IN (SELECT vec_id % 20 FROM embeddings WHERE vec_id < 3)")
def j05_semi_by_book(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("book_id", F.col("vec_id") % 20)
    near = rows.where("vec_id < 3").select("book_id").distinct()
    return rows.where("label >= 5").join(near, "book_id", "left_semi").select("vec_id")


@query(f"WITH {LABELS_SQL}, c AS (SELECT book_id, chapter_num FROM labels WHERE block_idx = 10) SELECT l.book_id, l.block_idx FROM labels l SEMI JOIN c ON l.book_id = c.book_id AND l.chapter_num = c.chapter_num")
def j06_semi_by_chapter(spark: S, d: str) -> DataFrame:
    rows = _labels(spark, d)
    return rows.join(rows.where("block_idx = 10").select("book_id", "chapter_num"), ["book_id", "chapter_num"], "left_semi").select("book_id", "block_idx")


@query("SELECT e.event_id, o.v FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS v FROM events WHERE event_type = 'view' GROUP BY ALL) o ON e.user_id = o.user_id AND e.ts >= o.ts")
def j07_as_of_backward(spark: S, d: str) -> DataFrame:
    """The last view at or before each event of a user, without a join."""
    seen = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return relations.as_of(seen, "user_id", "ts", "event_id", F.col("event_type") == "view", "v").select("event_id", "v")


@query(f"WITH {LABELS_SQL} SELECT book_id, block_idx, chapter_num, section_title FROM labels WHERE section_title IS NOT NULL")
def j08_as_of_with_reset(spark: S, d: str) -> DataFrame:
    return _labels(spark, d).where("section_title IS NOT NULL").select("book_id", "block_idx", "chapter_num", "section_title")


SHOWN = [(1, "a", 3, 4), (1, "b", 4, None), (1, "c", None, 9), (2, "d", 3, 3)]


_shown = ("page_id % 20 AS book_id", "concat('i', page_id) AS image", "page_id % 9 AS page", "CASE WHEN page_id % 3 = 0 THEN page_id % 7 END AS marker_page")


@query(f"WITH i AS (SELECT * FROM {plus_sql(f'SELECT {str(chr(44)).join(_shown)} FROM pages', 'book_id, image, page, marker_page', SHOWN)}), p AS (SELECT DISTINCT doc_id % 20 AS book_id, doc_id % 9 AS pg FROM documents) SELECT p.book_id, p.pg, i.image FROM p JOIN i ON i.book_id = p.book_id AND (i.page = p.pg OR i.marker_page = p.pg)")
def j10_either_page(spark: S, d: str) -> DataFrame:
    """The OR becomes one row per distinct page, so the join has a key."""
    images = plus(table(spark, d, "pages").selectExpr(*_shown), "book_id bigint, image string, page bigint, marker_page bigint", SHOWN)
    pages = table(spark, d, "documents").selectExpr("doc_id % 20 AS book_id", "doc_id % 9 AS pg").distinct()
    return pages.join(relations.on_either(images, ["page", "marker_page"], "pg"), ["book_id", "pg"]).select("book_id", "pg", "image")


TARGETS, ENTRIES = [("(Kim)", "#b0"), ("[9]", "#b9"), ("x", None)], [("b0", "ref-1"), ("b1", "ref-2")]


@query(f"SELECT c.said, r.id FROM {plus_sql("SELECT text AS said, concat('#b', doc_id) AS target FROM documents", 'said, target', TARGETS)} c LEFT JOIN {plus_sql("SELECT concat('b', doc_id) AS k, concat('ref-', quality, toxic) AS id FROM labels WHERE doc_id > 1", 'k, id', ENTRIES)} r ON ltrim(c.target, '#') = r.k")
def j12_citations_to_references(spark: S, d: str) -> DataFrame:
    cited = plus(table(spark, d, "documents").selectExpr("text AS said", "concat('#b', doc_id) AS target"), "said string, target string", TARGETS)
    entries = plus(table(spark, d, "labels").where("doc_id > 1").selectExpr("concat('b', doc_id) AS k", "concat('ref-', quality, toxic) AS id"), "k string, id string", ENTRIES)
    return cited.withColumn("k", F.ltrim("target", F.lit("#"))).join(entries, "k", "left").select("said", "id")


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NOT NULL AS in_documents, b.doc_id IS NOT NULL AS in_labels FROM (SELECT * FROM documents WHERE doc_id % 5 <> 0) a FULL JOIN labels b ON a.doc_id = b.doc_id")
def j14_full_outer(spark: S, d: str) -> DataFrame:
    some = table(spark, d, "documents").where("doc_id % 5 <> 0")  # so that either side lacks keys
    return relations.presence(some, table(spark, d, "labels"), "doc_id", ("in_documents", "in_labels"))


@query("SELECT count(*) AS n FROM embeddings")
def a01_count(spark: S, d: str) -> DataFrame:
    return relations.counted_tables({"embeddings": table(spark, d, "embeddings")}).select("n")


LEVELS = [(1, "chapter"), (1, None), (1, "book"), (2, "section")]


_level = "CASE block_type WHEN 'SectionHeader' THEN 'section' WHEN 'Text' THEN 'chapter' END AS level"


@query(f"WITH {BLOCKS_SQL} SELECT CAST(book_id AS INT) AS book_id, coalesce(level, 'chapter') AS level, count(*) AS n FROM {plus_sql(f'SELECT book_id, {_level} FROM blocks', 'book_id, level', LEVELS)} GROUP BY ALL")
def a14_summary_levels(spark: S, d: str) -> DataFrame:
    rows = plus(blocks(spark, d).select("book_id", F.expr(_level)), "book_id bigint, level string", LEVELS).fillna("chapter")
    counted = audit.counts_by(rows.withColumn("level", F.concat_ws("/", "book_id", "level")), "level")
    return counted.select(F.split("level", "/")[0].cast("int").alias("book_id"), F.split("level", "/")[1].alias("level"), "n")


ON_FILE = [(1, "Sea", "Ann", "/a.pdf"), (2, "", None, "/b.pdf"), (3, "Land", "", None)]


_on_file = ("doc_id AS id", "nullif(lang, 'en') AS title", "nullif(source, 'src0') AS authors", "concat('/', doc_id) AS path")


@query(f"SELECT id, CASE WHEN coalesce(title, '') = '' THEN 'red' WHEN coalesce(authors, '') = '' THEN 'yellow' ELSE 'green' END AS metadata, CASE WHEN f.p IS NOT NULL THEN 'green' ELSE 'red' END AS file FROM {plus_sql(f'SELECT {str(chr(44)).join(_on_file)} FROM documents', 'id, title, authors, path', ON_FILE)} LEFT JOIN (SELECT concat('/', doc_id) AS p FROM labels UNION ALL SELECT '/a.pdf') f ON f.p = path")
def a15_metadata_and_file(spark: S, d: str) -> DataFrame:
    files = plus(table(spark, d, "labels").selectExpr("concat('/', doc_id) AS path", "true AS there"), "path string, there boolean", [("/a.pdf", True)])
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    status = F.when(none("title"), "red").when(none("authors"), "yellow").otherwise("green")
    books = plus(table(spark, d, "documents").selectExpr(*_on_file), "id bigint, title string, authors string, path string", ON_FILE)
    return books.join(files, "path", "left").select("id", status.alias("metadata"), F.when(F.col("there"), "green").otherwise("red").alias("file"))


@query(f"WITH {METRICS_SQL}, b AS (SELECT *, query_id % 2 AS backend FROM scores) SELECT avg(mrr) FILTER (backend = 0) AS mrr_a, avg(mrr) FILTER (backend = 1) AS mrr_b, avg(mrr) FILTER (backend = 0) - avg(mrr) FILTER (backend = 1) AS gain FROM b")
def a21_backend_comparison(spark: S, d: str) -> DataFrame:
    means = metrics.report(_scores(spark, d).withColumn("backend", F.col("query_id") % 2), "backend")
    of = lambda b: F.max(F.when(F.col("backend") == b, F.col("mean_mrr")))
    return means.agg(of(0).alias("mrr_a"), of(1).alias("mrr_b"), (of(0) - of(1)).alias("gain"))


@query(f"WITH {HEADS_SQL}, s AS (SELECT *, lead(page_start) OVER (PARTITION BY book_id ORDER BY number) AS f FROM chapters) SELECT d.doc_id AS book_id, min(number) AS chapter_num FROM documents d LEFT JOIN s ON s.book_id = d.doc_id AND 2 >= page_start AND (f IS NULL OR 2 < f) GROUP BY ALL")
def t10_context_of_page_two(spark: S, d: str) -> DataFrame:
    asked = table(spark, d, "documents").select(F.col("doc_id").alias("book_id"), F.lit(2).alias("page"))
    return structure.page_context(asked, structure.chapters(outline(spark, d))).select("book_id", "chapter_num")


@query(f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN concat(lang, '/', source) ELSE array_to_string(list_filter(f, lambda s: contains(s, '/') OR len(list_filter(f, lambda x: starts_with(x, s || '/'))) = 0), ',') END AS subjects
  FROM (SELECT doc_id, lang, source, list_filter([{_subjects}], lambda x: x IS NOT NULL) AS f FROM (SELECT *, lower(text) AS low FROM documents))""")
def t23_tags_with_fallback(spark: S, d: str) -> DataFrame:
    """A model's answer if it has one, else keywords."""
    said = F.concat(F.lit('Sure: {"subjects": ["'), "lang", F.lit("/"), "source", F.lit('"], "library": null} ok'))
    answer = remote.json_in(F.when(F.col("doc_id") % 4 == 0, said).when(F.col("doc_id") % 4 == 1, "").when(F.col("doc_id") % 4 == 2, "sorry"), "subjects array<string>, library string")
    return table(spark, d, "documents").select("doc_id", F.array_join(F.coalesce(answer["subjects"], text.keyword_subjects(F.col("text"))), ",").alias("subjects"))


GUESSES = [(1, 0.8, 0.9, 0.5), (2, 0.0, 0.0, 0.3), (3, 0.5, 0.7, 0.0)]


_guesses = ("doc_id AS id", "toxic * 0.9e0 AS a", "quality * 0.8e0 AS b", "doc_id % 10 / 10e0 AS c")


@query(f"SELECT id, round((a + b + c) / 3, 2) AS confidence FROM {plus_sql(f'SELECT {str(chr(44)).join(_guesses)} FROM labels', 'id, a, b, c', GUESSES)}")
def t27_mean_confidence(spark: S, d: str) -> DataFrame:
    rows = plus(table(spark, d, "labels").selectExpr(*_guesses), "id bigint, a double, b double, c double", GUESSES)
    return rows.select("id", enrich.mean_confidence("a", "b", "c").alias("confidence"))


STEMS = [("_page_4_Figure_10",), ("_page_0_Table_2",), ("photo",)]


_stem = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat('_page_', page_id, '_Figure_', page_id % 7) WHEN 2 THEN concat('_page_', page_id % 9, '_Table_', page_id) ELSE concat('photo_', page_id) END AS stem"


@query(f"SELECT stem, TRY_CAST(nullif(regexp_extract(stem, '_page_(\\d+)_', 1), '') AS INT) AS page, nullif(lower(regexp_extract(stem, '_page_\\d+_([A-Za-z]+)_', 1)), '') AS kind, TRY_CAST(nullif(regexp_extract(stem, '_(\\d+)$', 1), '') AS INT) AS idx FROM {plus_sql(f'SELECT {_stem} FROM pages', 'stem', STEMS)}")
def t32_image_stems(spark: S, d: str) -> DataFrame:
    stem = plus(table(spark, d, "pages").select(F.expr(_stem)), "stem string", STEMS)
    return stem.select("stem", block_sources.image_name(F.col("stem")).alias("n")).select("stem", "n.page", "n.kind", "n.idx")


@query("SELECT doc_id, concat_ws(', ', lang, source) AS authors, to_json(['lang/' || lang, source]) AS subjects FROM documents")
def t34_node_metadata(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array("lang", "source"), ", ").alias("authors"), F.to_json(F.array(F.concat(F.lit("lang/"), "lang"), "source")).alias("subjects"))


@query(f"WITH {BLOCKS_SQL} SELECT book_id, page, concat('--- Page ', page, ' ---', chr(10), t) AS rendered FROM (SELECT book_id, page, string_agg(text, chr(10) || chr(10) ORDER BY block_idx) AS t FROM blocks GROUP BY book_id, page)")
def t38_rendered_pages(spark: S, d: str) -> DataFrame:
    pages = structure.ordered_text(blocks(spark, d), ["book_id", "page"], "block_idx")
    return pages.select("book_id", "page", F.concat(F.format_string("--- Page %d ---\n", "page"), "text").alias("rendered"))


@query(f"WITH {LABELS_SQL} SELECT book_id, count(DISTINCT chapter_num) AS chapters, count(DISTINCT section_title) AS sections FROM labels GROUP BY book_id")
def t45_recomputed_structure(spark: S, d: str) -> DataFrame:
    """What a fresh run would store; nothing is written."""
    return _labels(spark, d).groupBy("book_id").agg(F.count_distinct("chapter_num").alias("chapters"), F.count_distinct("section_title").alias("sections"))


@query(f"WITH {BLOCKS_SQL} SELECT book_id, block_idx, last_value(CASE WHEN block_idx % 4 = 0 THEN page END IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page FROM blocks")
def c03_last_known_page(spark: S, d: str) -> DataFrame:
    rows = blocks(spark, d).select("book_id", "block_idx", F.expr("IF(block_idx % 4 = 0, page, NULL)").alias("page"))
    return relations.last_known(rows, "book_id", "block_idx", F.col("page"), "page")


@query(f"WITH {OUTLINE_SQL} SELECT book_id, left(string_split(string_agg(text, chr(10) || chr(10) ORDER BY block_idx), chr(10) || chr(10))[1], 500) AS summary FROM outline GROUP BY ALL")
def c06_lead_summaries(spark: S, d: str) -> DataFrame:
    o = outline(spark, d)
    nodes = chunking.summaries(o, _labels(spark, d), structure.chapters(o))
    return nodes.where("level = 'book'").select("book_id", "summary")


@query(f"WITH {BLOCKS_SQL} SELECT book_id, string_agg(CAST(block_idx AS VARCHAR), ',' ORDER BY block_idx) AS places FROM blocks GROUP BY ALL")
def n07_numeric_order(spark: S, d: str) -> DataFrame:
    """Block 10 follows block 9, not block 1."""
    return relations.listed_in_order(blocks(spark, d), "book_id", "block_idx", "places")


@query(f"WITH {BLOCKS_SQL} SELECT book_id, block_idx, lead(page) OVER (PARTITION BY book_id ORDER BY block_idx) AS next_page FROM blocks")
def w02_look_ahead(spark: S, d: str) -> DataFrame:
    return relations.look_ahead(blocks(spark, d), "book_id", "block_idx", "page", "next_page").select("book_id", "block_idx", "next_page")


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents")
def w03_row_numbers(spark: S, d: str) -> DataFrame:
    return relations.positions(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id")


@query(f"WITH {BLOCKS_SQL} SELECT book_id, block_idx, dense_rank() OVER (PARTITION BY book_id ORDER BY page) AS r FROM blocks")
def w04_dense_rank(spark: S, d: str) -> DataFrame:
    return relations.ranks(blocks(spark, d), "book_id", "page", "r").select("book_id", "block_idx", "r")


@query(f"WITH {BLOCKS_SQL}, c AS (SELECT *, CASE WHEN block_type = lag(block_type) OVER (PARTITION BY book_id ORDER BY block_idx) THEN 0 ELSE 1 END AS s FROM blocks), r AS (SELECT *, sum(s) OVER (PARTITION BY book_id ORDER BY block_idx ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT book_id, min(block_idx) AS start, block_type, count(*) AS n FROM r GROUP BY book_id, run, block_type")
def w05_runs(spark: S, d: str) -> DataFrame:
    return relations.runs(blocks(spark, d), "book_id", "block_idx", "block_type")


@query("SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY source")
def w06_share_of_total(spark: S, d: str) -> DataFrame:
    return relations.shares(table(spark, d, "documents"), "source")


@query("SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) ORDER BY n DESC, source, lang LIMIT 7")
def o02_count_order(spark: S, d: str) -> DataFrame:
    return relations.largest_groups(table(spark, d, "documents"), ["source", "lang"], 7)


_scored = ("source", "doc_id AS id", "n_chars % 50 / 50 AS score", "CASE WHEN doc_id % 2 = 0 THEN 'text' ELSE 'equation' END AS kind")


@query(f"SELECT id, row_number() OVER (PARTITION BY source ORDER BY score DESC, kind = 'equation', id) AS nth FROM (SELECT {', '.join(_scored)} FROM documents)")
def o01_stable_score_order(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "documents").selectExpr(*_scored)
    w = Window.partitionBy("source").orderBy(*relations.by_score(rows, "id", F.col("kind") == "equation"))
    return rows.select("id", F.row_number().over(w).alias("nth"))


@query("SELECT vec_id, 'text' AS kind FROM embeddings WHERE label < 2 UNION ALL SELECT vec_id, 'equation' FROM embeddings WHERE label IN (1, 2)")
def u01_bag_union(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    return relations.tagged_union("kind", text=rows.where("label < 2"), equation=rows.where("label IN (1, 2)")).drop("label")


@query("SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE lang = 'en' END AS same FROM documents")
def u05_author_sets(spark: S, d: str) -> DataFrame:
    """The same people in another order and form; one of them alone; two lists that are equal for one language."""
    a = F.array(F.concat("source", F.lit(", "), "lang"), F.lit("Ann  Lee"))
    b = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("Lee, ann"), F.concat("lang", F.lit(" "), F.upper("source")))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("Ann Lee"))).otherwise(F.array(F.lit("Ann Lee"), F.concat(F.lit("en "), "source")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.same_authors(a, b).alias("same"))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def u06_intersection(spark: S, d: str) -> DataFrame:
    return relations.keys_of_each("doc_id", table(spark, d, "documents"), table(spark, d, "labels"))


@query("""WITH s AS (SELECT source AS book, doc_id AS ord, CASE WHEN doc_id % 4 = 0 THEN concat(lang, doc_id) END AS title, CASE WHEN doc_id % 5 = 0 THEN concat('e', doc_id) END AS error, concat('x', doc_id % 3) AS x FROM documents)
  SELECT book, title, error, extractors FROM (SELECT book, arg_min(title, ord) FILTER (title IS NOT NULL) AS title, arg_min(error, ord) FILTER (error IS NOT NULL) AS error FROM s GROUP BY book)
  JOIN (SELECT book, string_agg(x, '|' ORDER BY first) AS extractors FROM (SELECT book, x, min(ord) AS first FROM s GROUP BY ALL) GROUP BY book) USING (book)""")
def p02_merged_extractions(spark: S, d: str) -> DataFrame:
    """Every extractor runs; what they found is merged, errors are kept beside."""
    rows = table(spark, d, "documents").selectExpr("source AS book", "doc_id AS ord", "CASE WHEN doc_id % 4 = 0 THEN concat(lang, doc_id) END AS title", "CASE WHEN doc_id % 5 = 0 THEN concat('e', doc_id) END AS error", "array(concat('x', doc_id % 3)) AS extractors")
    return enrich.merge_metadata(rows, "book", "ord", ["title", "error"], ["extractors"]).withColumn("extractors", F.array_join("extractors", "|"))


@query("SELECT doc_id AS id, source AS library FROM documents WHERE source = 'src1' ORDER BY id LIMIT 20")
def p05_listed_books(spark: S, d: str) -> DataFrame:
    listed = relations.first_books(table(spark, d, "documents"), F.col("source") == "src1", "doc_id", 20)
    return listed.select(F.col("doc_id").alias("id"), F.col("source").alias("library"))


@query("SELECT d.doc_id AS id, coalesce(CASE WHEN l.toxic = 1 THEN 'T' END, d.lang) AS title FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def k08_field_update(spark: S, d: str) -> DataFrame:
    books = table(spark, d, "documents").selectExpr("doc_id AS id", "lang AS title")
    return catalog.patch(books, table(spark, d, "labels").selectExpr("doc_id AS id", "CASE WHEN toxic = 1 THEN 'T' END AS title"))
