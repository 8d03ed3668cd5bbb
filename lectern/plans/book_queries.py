"""Structure, navigation, retrieval, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import fixed, text, vectors
from lectern.operators import filters, navigate, retrieval, structure
from lectern.plans.registry import BLOCKS_SQL, HEADS_SQL, LABELS_SQL, OUTLINE_SQL, blocks, inline, outline, plus, plus_sql, query, table

S = SparkSession
COS = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])), 4)"
Q0 = "q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0)"


def _vector(spark: S, d: str, vec_id: int = 0) -> F.Column:
    """A query vector: one row, as a constant."""
    row = table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()
    return F.array(*(F.lit(float(x)) for x in row.embedding))


def _chunks(spark: S, d: str) -> DataFrame:
    """Vectors as chunks: a book for every 20, the label as chapter."""
    return table(spark, d, "embeddings").withColumns({"book_id": F.col("vec_id") % 20, "chapter_num": F.nullif(F.col("label"), F.lit(9))})


CHUNKS_SQL = "chunks AS (SELECT *, vec_id % 20 AS book_id, nullif(label, 9) AS chapter_num FROM embeddings)"


@query(f"WITH {Q0} SELECT vec_id, {COS} AS score FROM embeddings e, q ORDER BY score DESC, vec_id LIMIT 5")
def r01_vector_topk(spark: S, d: str) -> DataFrame:
    return retrieval.vector_top_k(table(spark, d, "embeddings"), _vector(spark, d)).select("vec_id", "score")


@query(f"WITH {Q0} SELECT vec_id, label, {COS} AS score FROM embeddings e, q WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def r01_vector_topk_filtered(spark: S, d: str) -> DataFrame:
    return retrieval.vector_top_k(table(spark, d, "embeddings"), _vector(spark, d), 10, F.col("label") == 3).select("vec_id", "label", "score")


@query(f"""SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT q.vec_id AS query_id, e.vec_id, {COS.replace("q.v", "q.embedding")} AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id < 20) q)) WHERE rank <= 5""")
def j17_batch_topk(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.batch_top_k(rows, asked).select("query_id", "vec_id", "score", "rank")


@query(f"""WITH {Q0}, {CHUNKS_SQL}, s AS (SELECT vec_id, book_id, label, {COS} AS score FROM chunks e, q), t AS (SELECT * FROM s WHERE label < 5 ORDER BY score DESC, vec_id LIMIT 5),
  x AS (SELECT * FROM s WHERE label >= 5 ORDER BY score DESC, vec_id LIMIT 20), b AS (SELECT book_id FROM t ORDER BY score DESC, vec_id LIMIT 3)
  SELECT vec_id, book_id, score, 'text' AS result_type FROM t UNION ALL SELECT vec_id, book_id, score, 'equation' FROM x WHERE book_id IN (SELECT book_id FROM b) OR NOT EXISTS (SELECT 1 FROM t)""")
def r02_fused_search(spark: S, d: str) -> DataFrame:
    rows, q = _chunks(spark, d), _vector(spark, d)
    hits = retrieval.fused(retrieval.vector_top_k(rows, q, 5, F.col("label") < 5), retrieval.vector_top_k(rows, q, 20, F.col("label") >= 5))
    return hits.select("vec_id", "book_id", "score", "result_type")


@query(f"WITH {Q0} SELECT vec_id, label, {COS} AS score FROM embeddings e, q WHERE vec_id % 7 = 0 ORDER BY score DESC, vec_id LIMIT 3")
def r03_chapter_search(spark: S, d: str) -> DataFrame:
    return retrieval.vector_top_k(table(spark, d, "embeddings"), _vector(spark, d), 3, F.col("vec_id") % 7 == 0).select("vec_id", "label", "score")


@query(f"""WITH {Q0}, {CHUNKS_SQL}, c AS (SELECT chapter_num FROM chunks e, q WHERE vec_id % 7 = 0 ORDER BY {COS} DESC, vec_id LIMIT 3)
  SELECT vec_id, chapter_num, {COS} AS score FROM chunks e, q WHERE chapter_num IN (SELECT chapter_num FROM c WHERE chapter_num IS NOT NULL) OR NOT EXISTS (SELECT 1 FROM c WHERE chapter_num IS NOT NULL) ORDER BY score DESC, vec_id LIMIT 5""")
def r04_hierarchical(spark: S, d: str) -> DataFrame:
    rows = _chunks(spark, d)
    return retrieval.hierarchical(rows, rows.where("vec_id % 7 = 0"), _vector(spark, d)).select("vec_id", "chapter_num", "score")


@query(f"""WITH {Q0}, {CHUNKS_SQL}, c AS (SELECT book_id, chapter_num FROM chunks e, q WHERE vec_id % 7 = 0 ORDER BY {COS} DESC, vec_id LIMIT 3)
  SELECT vec_id, e.book_id, e.chapter_num, {COS} AS score FROM chunks e SEMI JOIN c ON e.book_id = c.book_id AND e.chapter_num = c.chapter_num, q ORDER BY score DESC, vec_id LIMIT 5""")
def r04_hierarchical_strict(spark: S, d: str) -> DataFrame:
    rows = _chunks(spark, d)
    return retrieval.hierarchical(rows, rows.where("vec_id % 7 = 0"), _vector(spark, d), strict=True).select("vec_id", "book_id", "chapter_num", "score")


@query(f"""WITH {Q0}, {CHUNKS_SQL}, t AS (SELECT vec_id, chapter_num, {COS} AS score FROM chunks e, q ORDER BY score DESC, vec_id LIMIT 8)
  SELECT vec_id, chapter_num, score, row_number() OVER (ORDER BY coalesce(chapter_num, 999), score DESC, vec_id) AS nth FROM t""")
def r05_chapters_ordered(spark: S, d: str) -> DataFrame:
    best = retrieval.chapters_ordered(_chunks(spark, d), _vector(spark, d), 8)
    nth = F.row_number().over(Window.orderBy(F.coalesce("chapter_num", F.lit(999)), F.desc("score"), "vec_id"))  # eight rows
    return best.select("vec_id", "chapter_num", "score", nth.alias("nth"))


@query(f"WITH {Q0} SELECT vec_id, {COS} AS score FROM embeddings e, q WHERE label >= 5 ORDER BY score DESC, vec_id LIMIT 10")
def r06_equations_only(spark: S, d: str) -> DataFrame:
    return retrieval.vector_top_k(table(spark, d, "embeddings"), _vector(spark, d), 10, F.col("label") >= 5).select("vec_id", "score")


@query(f"WITH {BLOCKS_SQL} SELECT book_id, block_idx, text FROM blocks WHERE contains(lower(text), 'licensed') ORDER BY book_id, block_idx LIMIT 10")
def r08_text_search(spark: S, d: str) -> DataFrame:
    return retrieval.text_search(blocks(spark, d), "Licensed", 10).select("book_id", "block_idx", "text")


@query(f"""WITH {Q0} SELECT '' AS text, {COS} AS score, 'Unknown' AS title, '' AS authors, CAST(vec_id AS INT) AS book_id, CAST(NULL AS INT) AS page, label AS chapter_num, '' AS chapter_title, 'Text' AS block_type, '' AS library
  FROM embeddings e, q ORDER BY score DESC, vec_id LIMIT 4""")
def r09_result_rows(spark: S, d: str) -> DataFrame:
    hits = retrieval.vector_top_k(table(spark, d, "embeddings"), _vector(spark, d), 4)
    return retrieval.search_rows(hits.select(F.lit("").alias("text"), "score", F.col("vec_id").cast("int").alias("book_id"), F.col("label").alias("chapter_num"), F.lit("Text").alias("block_type")))


HITS = [(-1, 7, 3), (-2, 7, 4), (-3, 8, 1)]
_hits = "doc_id AS hit_id, doc_id % 20 AS book_id, doc_id % 9 AS page"
IMAGES = [(7, "marker:a", "picture", 3, 2, None, None, "c1"), (7, "marker:b", "figure", 3, 10, None, None, None), (7, "marker:c", "figure", 3, 2, None, None, None), (7, "marker:d", "table", 9, 1, 3, None, "c2"), (7, "marker:e", "unknown", 4, 1, 4, None, None)]
_images = "page_id % 20 AS book_id; concat('marker:', page_id) AS image_id; CASE page_id % 4 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' WHEN 2 THEN 'picture' ELSE 'unknown' END AS kind; page_id % 9 AS page; page_id % 5 AS idx; CASE WHEN page_id % 3 = 0 THEN page_id % 7 END AS marker_page; CAST(NULL AS STRING) AS label; CASE WHEN page_id % 8 = 0 THEN url END AS caption"
_rank = "CASE kind WHEN 'figure' THEN 0 WHEN 'picture' THEN 1 WHEN 'table' THEN 2 WHEN 'unknown' THEN 3 ELSE 9 END"


@query(f"""WITH h AS (SELECT * FROM {plus_sql(f"SELECT {_hits} FROM documents", "hit_id, book_id, page", HITS)}), i AS (SELECT * FROM {plus_sql(f"SELECT {_images.replace(';', ',')} FROM pages", "book_id, image_id, kind, page, idx, marker_page, label, caption", IMAGES)}),
  p AS (SELECT DISTINCT h.hit_id, i.* FROM h JOIN i ON h.book_id = i.book_id AND (i.marker_page = h.page OR i.page = h.page)),
  r AS (SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY CASE WHEN coalesce(caption, '') <> '' THEN 0 ELSE 1 END, {_rank}, page, concat(idx, ':', image_id)) AS n FROM p)
  SELECT h.hit_id, coalesce(string_agg(image_id, '|' ORDER BY n) FILTER (n <= 3), '') AS images FROM h LEFT JOIN r USING (hit_id) GROUP BY h.hit_id""")
def r10_image_links(spark: S, d: str) -> DataFrame:
    found = table(spark, d, "pages").selectExpr(*_images.replace("AS idx", "AS index").split("; "))
    images = plus(found, "book_id bigint, image_id string, kind string, page int, index int, marker_page int, label string, caption string", IMAGES)
    hits = plus(table(spark, d, "documents").selectExpr(*_hits.split(", ")), "hit_id bigint, book_id bigint, page int", HITS)
    found = retrieval.images_of_hits(hits, images)
    return found.select("hit_id", F.array_join("images", "|").alias("images"))


WILD = [("100% sure_thing",), ("100 sure thing",), ("abc",), ("a_c",)]


@query(f"SELECT t, contains(lower(t), 'a_c') AS underscore, contains(lower(t), '0%') AS percent FROM {plus_sql('SELECT text AS t FROM documents', 't', WILD)}")
def f05_literal_wildcards(spark: S, d: str) -> DataFrame:
    return plus(table(spark, d, "documents").select(F.col("text").alias("t")), "t string", WILD).select("t", filters.literal(F.col("t"), "A_C").alias("underscore"), filters.literal(F.col("t"), "0%").alias("percent"))


def _tagged(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("book_id"), F.col("source").alias("library"), F.array(F.concat(F.lit("lang/"), "lang"), F.concat(F.lit("old-lang/"), "source")).alias("subjects"))


TAGGED_SQL = "tagged AS (SELECT doc_id AS book_id, source AS library, ['lang/' || lang, 'old-lang/' || source] AS subjects FROM documents)"


@query(f"WITH {TAGGED_SQL} SELECT book_id FROM tagged WHERE contains(to_json(subjects), 'lang/src1')")
def f03_subject_compat(spark: S, d: str) -> DataFrame:
    return _tagged(spark, d).where(filters.subject("lang/src1/*")).select("book_id")


@query(f"WITH {TAGGED_SQL} SELECT book_id FROM tagged WHERE len(list_filter(subjects, lambda s: s = 'lang/de' OR starts_with(s, 'lang/de/'))) > 0")
def f03_subject_strict(spark: S, d: str) -> DataFrame:
    return _tagged(spark, d).where(filters.subject("lang/de/*", strict=True)).select("book_id")


@query(f"WITH {TAGGED_SQL} SELECT book_id FROM tagged WHERE library = 'src3' AND (contains(to_json(subjects), 'lang/de') OR contains(to_json(subjects), 'lang/fr'))")
def f02_subject_or(spark: S, d: str) -> DataFrame:
    return filters.where(_tagged(spark, d), filters.metadata(subjects_=["lang/de", "lang/fr/*"], library="src3")).select("book_id")


@query(f"WITH {BLOCKS_SQL} SELECT book_id, block_idx, page FROM (SELECT *, dense_rank() OVER (PARTITION BY book_id ORDER BY page) AS r FROM blocks) WHERE r <= 2")
def f13_early_pages(spark: S, d: str) -> DataFrame:
    return filters.early_pages(blocks(spark, d), 2).select("book_id", "block_idx", "page")


@query(f"WITH {HEADS_SQL} SELECT book_id, number, title, page_start, start_block_idx FROM chapters")
def t07_chapters(spark: S, d: str) -> DataFrame:
    return structure.chapters(outline(spark, d))


@query(f"WITH {LABELS_SQL} SELECT book_id, block_idx, chapter_num FROM labels")
def t07_chapter_labels(spark: S, d: str) -> DataFrame:
    return structure.block_labels(outline(spark, d)).select("book_id", "block_idx", "chapter_num")


@query(f"WITH {LABELS_SQL} SELECT book_id, block_idx, section_title FROM labels")
def t08_section_labels(spark: S, d: str) -> DataFrame:
    return structure.block_labels(outline(spark, d)).select("book_id", "block_idx", "section_title")


@query(f"""WITH {LABELS_SQL} SELECT l.book_id, block_idx, concat_ws(' > ', CASE WHEN chapter_num IS NOT NULL THEN concat('Chapter ', chapter_num, CASE WHEN coalesce(title, '') <> '' THEN ': ' || title ELSE '' END) END, nullif(section_title, '')) AS breadcrumb
  FROM labels l LEFT JOIN chapters c ON l.book_id = c.book_id AND l.chapter_num = c.number""")
def t09_breadcrumb(spark: S, d: str) -> DataFrame:
    o = outline(spark, d)
    return structure.breadcrumbs(structure.block_labels(o), structure.chapters(o)).select("book_id", "block_idx", "breadcrumb")


@query(f"""WITH {HEADS_SQL}, s AS (SELECT *, lead(page_start) OVER (PARTITION BY book_id ORDER BY number) AS next_start FROM chapters), p AS (SELECT DISTINCT book_id, page FROM outline)
  SELECT p.book_id, p.page, min(number) AS chapter_num, arg_min(title, number) AS chapter_title FROM p LEFT JOIN s ON p.book_id = s.book_id AND p.page >= s.page_start AND (next_start IS NULL OR p.page < next_start) GROUP BY ALL""")
def j09_page_context(spark: S, d: str) -> DataFrame:
    o = outline(spark, d)
    return structure.page_context(o.select("book_id", "page").distinct(), structure.chapters(o))


BACK = [(-1, i, 1, "SectionHeader" if i in (3, 15, 18) else "Text", {3: "Index", 15: "Notes", 18: "**About the Author**"}.get(i, "words")) for i in range(22)]
BACK += [(-2, i, 1, "SectionHeader" if i >= 12 else "Text", "ABCDEFGHIJ"[i - 12] if i >= 12 else "words") for i in range(22)] + [(-3, i, 1, "SectionHeader", "Index") for i in range(5)]


@query(f"""WITH {OUTLINE_SQL}, b AS (SELECT * FROM {plus_sql("SELECT book_id, block_idx, page, block_type, text FROM outline", "book_id, block_idx, page, block_type, text", BACK)}), h AS (SELECT *, regexp_replace(text, '\\*{{1,2}}', '', 'g') AS heading FROM (SELECT *, count(*) OVER (PARTITION BY book_id) AS n FROM b) WHERE n >= 20 AND block_idx >= n // 2 AND block_type = 'SectionHeader'),
  r AS (SELECT *, regexp_matches(heading, '(?i){fixed.BACK_MATTER}') AS named, length(heading) <= 2 AS letter, sum(CASE WHEN length(heading) <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY book_id ORDER BY block_idx) AS run FROM h),
  k AS (SELECT *, row_number() OVER (PARTITION BY book_id, run, letter ORDER BY block_idx) AS nth, min(block_idx) OVER (PARTITION BY book_id, run, letter) AS start FROM r)
  SELECT book_id, arg_min(CASE WHEN named THEN block_idx ELSE start END, block_idx) AS body_end FROM k WHERE named OR (letter AND nth = 4) GROUP BY book_id""")
def t11_back_matter(spark: S, d: str) -> DataFrame:
    return structure.body_end(plus(outline(spark, d), "book_id bigint, block_idx int, page int, block_type string, text string", BACK))


@query(f"""WITH {HEADS_SQL}, s AS (SELECT *, lead(page_start) OVER (PARTITION BY book_id ORDER BY number) AS e, last_value(nullif(page_start, 0) IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM chapters), t AS (SELECT book_id, max(page) AS total FROM outline GROUP BY book_id)
  SELECT s.book_id, count(*) AS chapter_count, count(nullif(page_start, 0)) AS chapters_with_pages, count(*) FILTER (page_start > 0 AND page_start < b) AS out_of_order, CASE WHEN max(total) > 0 THEN least(1.0, coalesce(sum(CASE WHEN page_start > 0 THEN coalesce(e, total) - page_start END), 0) / max(total)) ELSE 0 END AS page_coverage
  FROM s LEFT JOIN t USING (book_id) GROUP BY s.book_id""")
def a22_structure_validation(spark: S, d: str) -> DataFrame:
    o = outline(spark, d)
    return structure.validate(structure.chapters(o), o.groupBy("book_id").agg(F.max("page").alias("total_pages")))


@query(f"WITH {LABELS_SQL} SELECT book_id, chapter_num, min(block_idx) AS start_block_idx, max(block_idx) AS end_block_idx FROM labels WHERE chapter_num IS NOT NULL GROUP BY ALL")
def a23_ranges(spark: S, d: str) -> DataFrame:
    return structure.ranges(structure.block_labels(outline(spark, d)), "chapter_num")


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE coalesce(text, '') <> '' GROUP BY conv_id")
def a24_ordered_text(spark: S, d: str) -> DataFrame:
    return structure.ordered_text(table(spark, d, "conversations"), ["conv_id"], "turn")


@query(f"WITH {OUTLINE_SQL}, l AS (SELECT book_id, CASE WHEN block_idx % 10 = 0 THEN 1 ELSE 2 END AS level FROM outline WHERE block_type = 'SectionHeader') SELECT book_id, min(level) AS level FROM (SELECT book_id, level FROM l GROUP BY ALL HAVING count(*) >= 3) GROUP BY book_id")
def a26_heading_level(spark: S, d: str) -> DataFrame:
    heads = outline(spark, d).where("block_type = 'SectionHeader'").select("book_id", F.expr("IF(block_idx % 10 = 0, 1, 2)").alias("level"))
    return structure.chapter_level(heads)


@query(f"""WITH {OUTLINE_SQL}, r AS (SELECT *, sum(CASE WHEN block_type = 'SectionHeader' THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY block_idx) AS run FROM outline),
  b AS (SELECT book_id, run, string_agg(text, ' ' ORDER BY block_idx) AS body FROM r WHERE block_type <> 'SectionHeader' GROUP BY ALL)
  SELECT book_id, block_idx, left(coalesce(body, ''), 180) AS peek FROM r LEFT JOIN b USING (book_id, run) WHERE block_type = 'SectionHeader' AND trim(regexp_replace(regexp_replace(regexp_replace(text, '^#+\\s*', ''), '\\*{{1,2}}', '', 'g'), '\\s+', ' ', 'g')) <> ''""")
def t40_heading_peeks(spark: S, d: str) -> DataFrame:
    return structure.heading_records(outline(spark, d)).select("book_id", "block_idx", "peek")


PROPOSED = [(1, [(1, 0), (2, 5), (2, 9), (4, 3), (5, 12), (0, 20), (6, 12)]), (2, [(3, 1), (1, 4)]), (3, [])]


@query("SELECT * FROM (VALUES (1, '1:0|2:5|5:12'), (2, '3:1'), (3, '')) AS v(book_id, accepted)")
def t42_chapters_in_order(spark: S, d: str) -> DataFrame:
    rows = inline(spark, "book_id int, proposed array<struct<number:int,start:int>>", PROPOSED)
    return structure.in_order(rows).select("book_id", F.array_join(F.transform("accepted", lambda x: F.concat_ws(":", x["number"].cast("string"), x["start"].cast("string"))), "|").alias("accepted"))


@query(f"WITH {BLOCKS_SQL} SELECT book_id, page, string_agg(text, chr(10) || chr(10) ORDER BY block_idx) AS text FROM blocks WHERE page BETWEEN 1 AND 4 GROUP BY ALL")
def n01_page_window(spark: S, d: str) -> DataFrame:
    return navigate.page_window(blocks(spark, d), 2)


TOC_SQL = OUTLINE_SQL + ", toc AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY first_idx) AS nth FROM (SELECT book_id, text AS title, page AS start_page, min(block_idx) AS first_idx FROM outline WHERE block_type = 'SectionHeader' AND text <> '' GROUP BY ALL))"


@query(f"WITH {TOC_SQL} SELECT * FROM toc")
def n02_toc(spark: S, d: str) -> DataFrame:
    return navigate.contents(outline(spark, d))


@query(f"WITH {TOC_SQL}, n AS (SELECT *, lead(start_page) OVER (PARTITION BY book_id ORDER BY nth) AS f FROM toc) SELECT book_id, nth, title, start_page, CASE WHEN f > start_page THEN f - 1 ELSE start_page + 10 END AS end_page FROM n")
def n03_read_chapter(spark: S, d: str) -> DataFrame:
    return navigate.chapter_pages(navigate.contents(outline(spark, d))).select("book_id", "nth", "title", "start_page", "end_page")


@query(f"WITH {LABELS_SQL} SELECT book_id, section_title, min(block_idx) AS first_idx FROM labels WHERE section_title IS NOT NULL GROUP BY ALL")
def n05_list_spans(spark: S, d: str) -> DataFrame:
    spans = structure.ranges(structure.block_labels(outline(spark, d)), "section_title")
    return spans.select("book_id", "section_title", F.col("start_block_idx").alias("first_idx"))


@query("""WITH s AS (SELECT *, sum(length(text)) OVER w AS total, row_number() OVER w AS nth FROM conversations WHERE coalesce(text, '') <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
  SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (total <= 300 OR nth = 1) AS text, count(*) FILTER (total <= 300 OR nth = 1) AS n_blocks, 'block:' || min(turn) FILTER (NOT (total <= 300 OR nth = 1)) AS next_cursor FROM s GROUP BY conv_id""")
def n06_span_read(spark: S, d: str) -> DataFrame:
    return navigate.read_span(table(spark, d, "conversations"), "conv_id", "turn", 300)


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_user FROM conversations""")
def w01_forward_fill(spark: S, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.last(F.expr("IF(role = 'user', turn, NULL)"), True).over(w).alias("last_user"))


@query(f"WITH {Q0} SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 6) AS dot FROM embeddings, q WHERE vec_id < 50")
def r12_dot_product(spark: S, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id < 50").select("vec_id", F.round(vectors.dot(F.col("embedding"), _vector(spark, d)), 6).alias("dot"))


NUMBERS = [(1, "Waves", "Tides"), (2, "", None), (None, "x", "Sea")]


_numbers = "CASE WHEN doc_id % 3 > 0 THEN doc_id END AS n; CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE lang END AS t; CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE source END AS s"


@query(f"SELECT n, concat_ws(' > ', CASE WHEN n IS NOT NULL THEN concat('Chapter ', n, CASE WHEN coalesce(t, '') <> '' THEN ': ' || t ELSE '' END) END, nullif(s, '')) AS crumb FROM {plus_sql(f'SELECT {_numbers.replace(chr(59), chr(44))} FROM documents', 'n, t, s', NUMBERS)}")
def t09_breadcrumb_parts(spark: S, d: str) -> DataFrame:
    rows = plus(table(spark, d, "documents").selectExpr(*_numbers.split("; ")), "n bigint, t string, s string", NUMBERS)
    return rows.select("n", text.breadcrumb(F.col("n"), F.col("t"), F.col("s")).alias("crumb"))
