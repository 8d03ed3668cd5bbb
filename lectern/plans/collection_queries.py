"""Aggregations, audits, catalog changes, enrichment, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.operators import audit, catalog, enrich, metrics, relations, retrieval
from lectern.plans.registry import BLOCKS_SQL, LABELS_SQL, OUTLINE_SQL, blocks, inline, outline, plus, plus_sql, query, quoted, strip_sql, table
from lectern.plans.text_queries import GARBLED_FROM, GARBLED_SQL
from lectern.operators.structure import block_labels
from lectern.sources import remote

S = SparkSession


@query("SELECT 'documents' AS collection, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'pages', count(*) FROM pages")
def a05_collection_counts(spark: S, d: str) -> DataFrame:
    return relations.counted_tables({t: table(spark, d, t) for t in ("documents", "embeddings", "pages")})


@query("SELECT coalesce(json_extract_string(props, '$.k'), 'Unknown') AS k, count(*) AS n FROM events GROUP BY ALL")
def a02_metadata_counts(spark: S, d: str) -> DataFrame:
    return audit.counts_by(table(spark, d, "events").select(F.get_json_object("props", "$.k").alias("k")), "k")


@query("SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS INT) IS NOT NULL")
def a03_indexed_ids(spark: S, d: str) -> DataFrame:
    return relations.whole_numbers(table(spark, d, "events"), F.get_json_object("props", "$.k"), "k")


@query(f"WITH {BLOCKS_SQL} SELECT block_type, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM blocks GROUP BY block_type")
def a04_block_types(spark: S, d: str) -> DataFrame:
    return audit.distribution(blocks(spark, d), "block_type")


BOOKS_SQL = "books AS (SELECT d.doc_id AS id, nullif(source, 'src0') AS library, lang, CASE WHEN l.quality = 1 THEN 'indexed' WHEN l.quality = 0 THEN 'failed' ELSE 'pending' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def _books(spark: S, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", "quality")
    status = F.when(F.col("quality") == 1, "indexed").when(F.col("quality") == 0, "failed").otherwise("pending")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), F.nullif("source", F.lit("src0")).alias("library"), "lang", status.alias("status"))


@query(f"WITH {BLOCKS_SQL}, {BOOKS_SQL}, c AS (SELECT book_id AS id, count(*) AS chunks FROM blocks GROUP BY ALL) SELECT coalesce(library, 'unassigned') AS library, count(*) AS total, count(*) FILTER (status = 'indexed') AS indexed, CAST(sum(CASE WHEN status = 'indexed' THEN coalesce(chunks, 0) ELSE 0 END) AS BIGINT) AS chunks FROM books LEFT JOIN c USING (id) GROUP BY ALL")
def a06_library_profile(spark: S, d: str) -> DataFrame:
    return audit.library_profile(_books(spark, d), blocks(spark, d))


@query("SELECT 'library' AS kind, source AS value FROM documents GROUP BY ALL UNION ALL SELECT 'subject', 'lang/' || lang FROM documents GROUP BY ALL")
def a07_taxonomy(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    subjects = docs.select(F.explode(F.array(F.concat(F.lit("lang/"), "lang"))).alias("value")).distinct()
    return docs.select(F.lit("library").alias("kind"), F.col("source").alias("value")).distinct().unionByName(subjects.select(F.lit("subject").alias("kind"), "value"))


@query(f"""WITH {LABELS_SQL}, c AS (SELECT book_id, count(*) AS chunks, count(chapter_num) AS with_chapter, count(nullif(section_title, '')) AS with_section, count(DISTINCT page) AS pages, min(page) AS min_page, max(page) AS max_page, count(*) - count(page) AS no_page FROM labels GROUP BY book_id)
  SELECT *, CASE WHEN chunks < 10 OR with_chapter / chunks < 0.3 THEN 'red' WHEN no_page > chunks * 0.3 OR (CASE WHEN with_chapter > 0 THEN with_chapter / chunks < 0.5 ELSE with_section / chunks < 0.5 END) OR coalesce(pages < (max_page - min_page + 1) * 0.5, FALSE) THEN 'yellow' ELSE 'green' END AS status FROM c""")
def a08_completeness(spark: S, d: str) -> DataFrame:
    return audit.completeness(block_labels(outline(spark, d)))


@query("""WITH p AS (SELECT DISTINCT doc_id // 100 AS book_id, doc_id AS page FROM labels), n AS (SELECT *, lead(page) OVER (PARTITION BY book_id ORDER BY page) AS f FROM p),
  g AS (SELECT book_id, page + 1 AS gap_start, f - 1 AS gap_end, sum(f - page - 1) OVER (PARTITION BY book_id) AS missing FROM n WHERE f > page + 1) SELECT book_id, gap_start, gap_end, CAST(missing AS BIGINT) AS missing FROM g WHERE missing >= 6""")
def a09_page_gaps(spark: S, d: str) -> DataFrame:
    return audit.page_gaps(table(spark, d, "labels").select(F.expr("doc_id div 100").alias("book_id"), F.col("doc_id").alias("page")))


@query(f"""WITH {BLOCKS_SQL} SELECT book_id, count(*) FILTER (block_type = 'Text') AS texts, count(DISTINCT page) FILTER (block_type <> 'Code') AS pages, min(page) FILTER (block_type = 'Code') AS first_code, max(page) FILTER (block_type = 'Code') AS last_code FROM blocks GROUP BY book_id""")
def a10_filtered_aggs(spark: S, d: str) -> DataFrame:
    f = lambda e, c: F.expr(f"{e} FILTER (WHERE {c})")
    return blocks(spark, d).groupBy("book_id").agg(f("count(*)", "block_type = 'Text'").alias("texts"), f("count(DISTINCT page)", "block_type <> 'Code'").alias("pages"), f("min(page)", "block_type = 'Code'").alias("first_code"), f("max(page)", "block_type = 'Code'").alias("last_code"))


@query(f"""WITH {BLOCKS_SQL}, c AS (SELECT book_id AS id, count(*) AS chunks, count(*) FILTER (page > 2) AS no_page FROM blocks GROUP BY ALL), b AS (SELECT d.doc_id AS id, coalesce(chunks, 0) AS chunks, coalesce(no_page, 0) AS no_page, count(l.doc_id) AS labelled FROM documents d LEFT JOIN c ON c.id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY ALL)
  SELECT *, CASE WHEN chunks = 0 THEN 'RED' WHEN no_page > chunks * 0.3 OR labelled = 0 THEN 'YELLOW' ELSE 'GREEN' END AS status, array_to_string(list_filter([CASE WHEN chunks = 0 THEN 'no chunks' END, CASE WHEN no_page > chunks * 0.3 THEN 'pages missing' END, CASE WHEN labelled = 0 THEN 'no labels' END], lambda x: x IS NOT NULL), '; ') AS issues FROM b""")
def a11_rollup_status(spark: S, d: str) -> DataFrame:
    counts = blocks(spark, d).groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("chunks"), F.count_if(F.col("page") > 2).alias("no_page"))
    labelled = table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("labelled"))
    books = table(spark, d, "documents").select(F.col("doc_id").alias("id")).join(counts, "id", "left").join(labelled, "id", "left").fillna(0)
    return audit.roll_up_status(books)


@query(f"""WITH {BLOCKS_SQL}, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY md5(text), block_idx) AS nth FROM {GARBLED_FROM}) WHERE nth <= 20 AND length({strip_sql("text")}) >= 30),
  j AS (SELECT book_id, count(*) AS checked, count(*) FILTER ({GARBLED_SQL}) AS garbled FROM p GROUP BY book_id) SELECT *, CASE WHEN garbled / checked > 0.3 THEN 'red' WHEN garbled / checked > 0.1 THEN 'yellow' ELSE 'green' END AS status FROM j""")
def a12_ocr_quality(spark: S, d: str) -> DataFrame:
    return audit.ocr_quality(blocks(spark, d))


MARKS = [(-1, "SectionHeader", "Table of Contents"), (-1, "Text", "see the index"), (-1, "Text", "indexing"), (-2, "Text", "In this Introduction"), (-2, "SectionHeader", "Foreword"), (-3, "Text", "none")]
_marks = " UNION ALL ".join(f"SELECT *, '{n}' AS landmark FROM m WHERE regexp_matches(text, '(?i){p}')" for n, p in fixed.LANDMARKS)


@query(f"WITH {BLOCKS_SQL}, m AS (SELECT * FROM {plus_sql('SELECT book_id, block_type, text FROM blocks', 'book_id, block_type, text', MARKS)}) SELECT book_id, landmark, CASE WHEN bool_or(block_type = 'SectionHeader') THEN 'found_in_headers' ELSE 'found_in_text' END AS found FROM ({_marks}) GROUP BY ALL")
def a13_landmarks(spark: S, d: str) -> DataFrame:
    return audit.landmarks(plus(blocks(spark, d), "book_id bigint, block_type string, text string", MARKS))


@query(f"WITH {BLOCKS_SQL} SELECT lang, count(*) AS blocks, count(DISTINCT book_id) AS books, count(*) FILTER (block_type = 'Code') AS code, CAST(sum(length(text)) AS BIGINT) AS chars FROM blocks GROUP BY ROLLUP (lang)")
def a16_corpus_audit(spark: S, d: str) -> DataFrame:
    return audit.corpus_audit(blocks(spark, d), "lang", blocks=F.count("*"), books=F.count_distinct("book_id"), code=F.count_if(F.col("block_type") == "Code"), chars=F.sum(F.length("text")))


@query(f"WITH {BLOCKS_SQL} SELECT d.doc_id AS book_id, (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id) AS labels, (SELECT count(*) FROM blocks b WHERE b.book_id = d.doc_id AND b.block_type = 'Code') AS code FROM documents d")
def a17_yields(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("book_id"))
    return audit.yields(docs, labels=table(spark, d, "labels").withColumnRenamed("doc_id", "book_id"), code=blocks(spark, d).where("block_type = 'Code'"))


SAMPLES = [("ok", 10.0, 4.2), ("ok", 841.0, 1.0), ("offload", 1091.0, 3.0), ("offload", 2000.0, 13.2)]


_measured = "SELECT CASE WHEN toxic = 1 THEN 'offload' ELSE 'ok' END AS label, CAST(n_chars AS DOUBLE) AS img, CAST(toxic * 100 + n_chars % 7 AS DOUBLE) AS page FROM documents JOIN labels USING (doc_id)"


@query(f"WITH s AS (SELECT * FROM {plus_sql(_measured, 'label, img, page', SAMPLES)}), u AS (SELECT label, 'img' AS signal, img AS value FROM s UNION ALL SELECT label, 'page', page FROM s), a AS (SELECT signal, CAST(max(value) FILTER (label = 'ok') AS DOUBLE) AS max_ok, CAST(min(value) FILTER (label = 'offload') AS DOUBLE) AS min_offload FROM u GROUP BY signal) SELECT *, CASE WHEN max_ok < min_offload THEN 'CLEAN GAP' ELSE 'OVERLAP' END AS verdict FROM a")
def a18_signal_separation(spark: S, d: str) -> DataFrame:
    known = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    measured = known.select(F.when(F.col("toxic") == 1, "offload").otherwise("ok").alias("label"), F.col("n_chars").alias("img"), (F.col("toxic") * 100 + F.col("n_chars") % 7).alias("page"))
    return audit.separation(plus(measured, "label string, img double, page double", SAMPLES), ["img", "page"])


#: What texts are embedded by: how often each of these occurs.
SYLLABLES = ["the", "and", "to", "in", "er", "on", "ti", "es", "ou", "sch", "la", "re"]
_counts = ", ".join(f"CAST((length(low) - length(replace(low, '{w}', ''))) // {len(w)} AS DOUBLE)" for w in SYLLABLES)
METRICS_SQL = f"""qs AS (SELECT item_id AS query_id, list_distinct(string_split(text, ' ')) AS terms, ['src' || (item_id % 5)] AS sources, [{_counts}] AS v FROM (SELECT *, lower(text) AS low FROM benchmark)),
  dv AS (SELECT * FROM (SELECT doc_id, text, source, [{_counts}] AS v FROM (SELECT *, lower(text) AS low FROM documents)) WHERE list_sum(v) > 0),
  hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, text, source AS title, round(list_cosine_similarity(dv.v, qs.v), 4) AS score FROM qs, dv WHERE list_sum(qs.v) > 0)) WHERE rank <= 5),
  j AS (SELECT query_id, rank, len(list_filter(sources, lambda s: contains(lower(title), lower(s)))) > 0 AS src, list_filter(terms, lambda t: contains(lower(text), lower(t))) AS m, terms FROM hits JOIN qs USING (query_id)),
  r AS (SELECT *, src OR len(m) >= len(terms) // 2 AS rel FROM j),
  scores AS (SELECT q.query_id, coalesce(count(*) FILTER (rel), 0) / 5 AS precision_at_k, coalesce(CAST(bool_or(src) AS DOUBLE), 0.0) AS recall, CASE WHEN len(any_value(q.terms)) = 0 THEN 1.0 ELSE coalesce(len(list_distinct(flatten(list(m)))), 0) / len(list_distinct(any_value(q.terms))) END AS term_coverage, coalesce(1 / min(rank) FILTER (rel), 0.0) AS mrr, coalesce(count(*) FILTER (rel), 0) AS relevant_count FROM qs q LEFT JOIN r USING (query_id) GROUP BY q.query_id)"""


def _scores(spark: S, d: str) -> DataFrame:
    """Every benchmark text searched for among all documents by vectors, and the hits scored."""
    words = list(SYLLABLES)
    vector = lambda: remote.embed(F.col("text"), lambda: remote.vocabulary_embedder(words))
    docs = table(spark, d, "documents").withColumn("embedding", vector())
    items = table(spark, d, "benchmark")
    asked = items.select(F.col("item_id").alias("query_id"), F.array_distinct(F.split("text", " ")).alias("expected_terms"), F.array(F.concat(F.lit("src"), (F.col("item_id") % 5).cast("string"))).alias("expected_sources"))
    best = retrieval.batch_top_k(docs, items.select(F.col("item_id").alias("query_id"), vector().alias("query_vector")), 5, key="doc_id")
    hits = best.join(docs.select("doc_id", "text", F.col("source").alias("title")), "doc_id").select("query_id", "rank", "text", "title")
    return metrics.score_queries(asked, hits)


@query(f"WITH {METRICS_SQL} SELECT * FROM scores")
def a19_ir_metrics(spark: S, d: str) -> DataFrame:
    return _scores(spark, d)


@query(f"WITH {METRICS_SQL} SELECT query_id % 2 AS backend, count(*) AS queries, avg(precision_at_k) AS mean_precision_at_k, avg(recall) AS mean_recall, avg(term_coverage) AS mean_term_coverage, avg(mrr) AS mean_mrr, count(*) FILTER (recall < 0.5 OR term_coverage < 0.5) AS failures FROM scores GROUP BY ALL")
def a20_report_means(spark: S, d: str) -> DataFrame:
    return metrics.report(_scores(spark, d).withColumn("backend", F.col("query_id") % 2), "backend")


@query("SELECT doc_id // 50 AS book_id, coalesce(max(doc_id % 50), 0) AS pages FROM documents GROUP BY ALL")
def a25_page_counts(spark: S, d: str) -> DataFrame:
    return relations.last_page(table(spark, d, "documents"), F.expr("doc_id div 50"), F.col("doc_id") % 50, "book_id")


METADATA = [("a", 2, "Late", None, ["x", "y"]), ("a", 1, None, 1999, ["z"]), ("a", 3, "Last", 2001, ["y", "w"]), ("b", 1, None, None, None), ("b", 2, "Only", None, ["q", "q"])]


_found = "source AS k, doc_id AS ord, CASE WHEN doc_id % 4 = 0 THEN concat(lang, doc_id) END AS title, CASE WHEN doc_id % 3 = 0 THEN CAST(1990 + doc_id % 30 AS INT) END AS year"


@query(f"""WITH s AS (SELECT {_found}, [lang, concat('x', doc_id % 3)] AS authors FROM documents), f AS (SELECT k, a, min(ord * 10 + p) AS first FROM (SELECT k, ord, unnest(authors) AS a, unnest([0, 1]) AS p FROM s) GROUP BY ALL),
  m AS (SELECT k, arg_min(title, ord) FILTER (title IS NOT NULL) AS title, arg_min(year, ord) FILTER (year IS NOT NULL) AS year FROM s GROUP BY k)
  SELECT k, title, year, authors FROM m JOIN (SELECT k, string_agg(a, '|' ORDER BY first) AS authors FROM f GROUP BY k) USING (k) UNION ALL SELECT * FROM (VALUES ('a', 'Late', 1999, 'z|x|y|w'), ('b', 'Only', NULL, 'q'))""")
def a27_metadata_merge(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents").selectExpr("source AS k", "doc_id AS ord", "CASE WHEN doc_id % 4 = 0 THEN concat(lang, doc_id) END AS title", "CASE WHEN doc_id % 3 = 0 THEN CAST(1990 + doc_id % 30 AS INT) END AS year", "array(lang, concat('x', doc_id % 3)) AS authors")
    rows = plus(docs, "k string, ord bigint, title string, year int, authors array<string>", METADATA)
    merged = enrich.merge_metadata(rows, "k", "ord", ["title", "year"], ["authors"])
    return merged.withColumn("authors", F.array_join("authors", "|"))


IMPRINTS = [(-1, 0, 2, "© Prentice Hall International (UK) Ltd, 1992"), (-1, 1, 3, "ISBN 0-13-014401-1"), (-1, 2, 4, "Published by Acme, Boston"), (-2, 0, 1, "plain"), (-2, 1, 5, "Springer series"), (-3, 0, 1, "copyright notice"), (-3, 1, 9, "Copyright 2001 O'Reilly")]
_imprint = "CASE block_idx % 9 WHEN 0 THEN concat('Copyright ', 1950 + book_id % 70, ' ', text) WHEN 3 THEN concat('ISBN 978-0-', 100000000 + book_id, ' ', text) WHEN 5 THEN concat('Published by ', lang, ' Wiley, ', text) WHEN 7 THEN concat('Publisher: ', source) ELSE text END AS text"
_known = "CASE " + " ".join(f"WHEN contains(low, {quoted(p.lower())}) THEN {quoted(p)}" for p in fixed.COPYRIGHT_PUBLISHERS) + " END"


@query(rf"""WITH {BLOCKS_SQL}, b AS (SELECT *, lower(text) AS low, contains(text, '©') OR contains(lower(text), 'copyright') AS marked FROM {plus_sql(f"SELECT book_id, block_idx, page, {_imprint} FROM blocks", "book_id, block_idx, page, text", IMPRINTS)}),
  f AS (SELECT *, CASE WHEN marked THEN TRY_CAST(regexp_extract(low, '(?:©|copyright)[^0-9]*(\d{{4}})', 1) AS INT) END AS y, nullif(replace(regexp_extract(text, 'ISBN[-:\s]*(\d[\d-]{{9,}}[\dXx])', 1), '-', ''), '') AS i, nullif(trim(regexp_extract(text, '(?i)(?:published by|publisher[:\s]+)([^,\n]+)', 1)), '') AS n, {_known} AS k FROM b),
  g AS (SELECT *, coalesce(k, n) AS pub, (CASE WHEN y IS NULL THEN 0 ELSE 3 END) + (CASE WHEN i IS NULL THEN 0 ELSE 3 END) + (CASE WHEN n IS NULL THEN 0 ELSE 2 END) + (CASE WHEN k IS NULL THEN 0 ELSE 2 END) AS t FROM f)
  SELECT book_id, arg_max(y, block_idx) FILTER (y IS NOT NULL) AS year, arg_max(i, block_idx) FILTER (i IS NOT NULL) AS isbn, arg_max(pub, block_idx) FILTER (pub IS NOT NULL) AS publisher, coalesce(arg_max(page, block_idx) FILTER (marked), arg_min(page, block_idx) FILTER (i IS NOT NULL OR pub IS NOT NULL)) AS page, sum(t) / 10 AS confidence FROM g GROUP BY book_id""")
def a28_copyright_fold(spark: S, d: str) -> DataFrame:
    pages = blocks(spark, d).select("book_id", "block_idx", "page", F.expr(_imprint))
    return enrich.copyright_facts(plus(pages, "book_id bigint, block_idx int, page int, text string", IMPRINTS))


FRONT = [(1, 0, 1, "Text", "<p><b>Tides and Waves</b></p>"), (1, 1, 1, "Text", "<p>by John Q. Public</p>"), (1, 2, 2, "SectionHeader", "<h1>Chapter 1</h1>"), (2, 0, 1, "SectionHeader", "<h1>The Sea</h1>"), (2, 1, 1, "Text", "J. M. Selig\nDepartment of Physics"), (3, 0, 1, "Text", "Selig, J. M."), (4, 0, 1, "Text", "nothing")]


@query("SELECT * FROM (VALUES (1, 'Tides and Waves', 0.5::DOUBLE, 'John Q. Public', 0.9::DOUBLE), (2, 'The Sea', 0.8, 'J. M. Selig', 0.8), (3, NULL, 0.0, 'J. M. Selig', 0.7), (4, NULL, 0.0, NULL, 0.0)) AS v(book_id, title, title_confidence, author, author_confidence)")
def t25_t26_title_and_author(spark: S, d: str) -> DataFrame:
    front = inline(spark, "book_id int, block_idx int, page int, block_type string, html string", FRONT)
    titles = enrich.title_guess(front).withColumnRenamed("confidence", "title_confidence")
    return titles.join(enrich.author_guess(front).withColumnRenamed("confidence", "author_confidence"), "book_id")


EXTERNAL = [("Tides", "tides and waves", "Wiley", "wiley", True, 0.95), ("Sea", "Land", None, "X", True, 0.9), ("Sea", "Land", "X", "X", True, 0.5), ("Sea", "sea", "X", "X", False, 0.95)]
_agree = lambda a, b: f"(contains(lower(coalesce({a}, '')), lower(coalesce({b}, ''))) OR contains(lower(coalesce({b}, '')), lower(coalesce({a}, ''))))"


_compared = ("source AS lt", "CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE lang END AS t", "lang AS lp", "nullif(lang, 'de') AS p", "doc_id % 3 <> 0 AS m", "CAST(doc_id % 11 AS DOUBLE) / 10 AS c")


@query(f"SELECT lt, t, CASE WHEN {_agree('lt', 't')} AND {_agree('lp', 'p')} AND coalesce(m, TRUE) THEN 'keep' WHEN c >= 0.9 THEN 'update' ELSE 'review' END AS advice FROM {plus_sql(f'SELECT {str(chr(44)).join(_compared)} FROM documents', 'lt, t, lp, p, m, c', EXTERNAL)}")
def t29_validation(spark: S, d: str) -> DataFrame:
    rows = plus(table(spark, d, "documents").selectExpr(*_compared), "lt string, t string, lp string, p string, m boolean, c double", EXTERNAL)
    c = F.col
    return rows.select("lt", "t", enrich.recommendation(c("lt"), c("t"), c("lp"), c("p"), c("m"), c("c")).alias("advice"))


SHELF = [(-1, "a_b.pdf", "Unknown"), (-2, "Tides", "Ann Lee"), (-3, "Sea", "")]
FOUND = [(-1, "The Sea", "J. Kim", 0.7), (-2, "Other", "Other", 0.9), (-3, "Sea", "Bo", 0.3)]


_shelved = ("doc_id AS id", "CASE doc_id % 4 WHEN 0 THEN concat(lang, '_', doc_id) WHEN 1 THEN concat(source, '.pdf') ELSE source END AS title", "CASE doc_id % 3 WHEN 0 THEN 'Unknown' WHEN 1 THEN '' ELSE lang END AS authors")
_guessed = ("doc_id AS book_id", "CASE WHEN doc_id % 5 > 0 THEN concat('T', doc_id) END AS title", "CASE WHEN doc_id % 7 > 0 THEN concat('A', doc_id) END AS author", "CAST(doc_id % 10 AS DOUBLE) / 10 AS confidence")


@query(f"""WITH b AS (SELECT {', '.join(_shelved)} FROM documents), f AS (SELECT {', '.join(_guessed)} FROM labels),
  n AS (SELECT b.*, f.confidence, CASE WHEN coalesce(confidence, 0) >= 0.4 AND authors IN ('', 'Unknown') THEN coalesce(f.author, authors) ELSE authors END AS new_authors, CASE WHEN coalesce(confidence, 0) >= 0.4 AND regexp_matches(b.title, '_|\\.pdf$|\\.epub$') THEN coalesce(f.title, b.title) ELSE b.title END AS new_title FROM b LEFT JOIN f ON f.book_id = b.id)
  SELECT id, new_title, new_authors, CASE WHEN confidence IS NULL THEN 'failed' WHEN new_authors <> authors OR new_title <> title THEN 'enriched' ELSE 'skipped' END AS enrichment FROM n
  UNION ALL SELECT * FROM (VALUES (-1, 'The Sea', 'J. Kim', 'enriched'), (-2, 'Tides', 'Ann Lee', 'skipped'), (-3, 'Sea', '', 'skipped'))""")
def t28_enrich(spark: S, d: str) -> DataFrame:
    books = plus(table(spark, d, "documents").selectExpr(*_shelved), "id bigint, title string, authors string", SHELF)
    found = plus(table(spark, d, "labels").selectExpr(*_guessed), "book_id bigint, title string, author string, confidence double", FOUND)
    return enrich.apply_enrichment(books, found).select("id", "new_title", "new_authors", "enrichment")


@query("""WITH b AS (SELECT doc_id AS id, text AS title FROM documents WHERE doc_id % 2 = 0), i AS (SELECT lower(text) AS title, 'p' || (doc_id + 100000) AS source_path FROM documents WHERE doc_id % 3 = 0),
  t AS (SELECT lower(title) AS title, min(id) AS id FROM b GROUP BY ALL), k AS (SELECT i.*, t.id FROM i LEFT JOIN t ON lower(i.title) = t.title)
  SELECT title, source_path, id, TRUE AS already_exists FROM k WHERE id IS NOT NULL UNION ALL SELECT title, source_path, (SELECT max(id) FROM b) + row_number() OVER (ORDER BY title, source_path), FALSE FROM k WHERE id IS NULL""")
def k05_register_dedup(spark: S, d: str) -> DataFrame:
    """Whole texts as titles; every second document is known and every third comes in, so that some are new."""
    docs = table(spark, d, "documents")
    path = lambda add: F.concat(F.lit("p"), (F.col("doc_id") + add).cast("string")).alias("source_path")
    books = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("text").alias("title"), path(0))
    return catalog.register(books, docs.where("doc_id % 3 = 0").select(F.lower("text").alias("title"), path(100000)))


@query(f"WITH {BOOKS_SQL} SELECT b.id, coalesce(p.library, b.library) AS library, b.status FROM books b LEFT JOIN (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'held' END AS library FROM labels) p USING (id)")
def k06_update_patch(spark: S, d: str) -> DataFrame:
    changes = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "held").alias("library"))
    return catalog.patch(_books(spark, d), changes).select("id", "library", "status")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def k07_delete(spark: S, d: str) -> DataFrame:
    gone = table(spark, d, "labels").where("toxic = 1")
    return catalog.delete(table(spark, d, "documents"), gone, "doc_id").select("doc_id", "source")


@query(f"WITH {BLOCKS_SQL}, {BOOKS_SQL} SELECT c.book_id, c.block_idx, coalesce(b.library, c.source) AS library FROM blocks c LEFT JOIN books b ON b.id = c.book_id")
def k14_propagate_library(spark: S, d: str) -> DataFrame:
    return catalog.propagate(blocks(spark, d).withColumnRenamed("source", "library"), _books(spark, d), ("library",)).select("book_id", "block_idx", "library")


@query("""WITH a AS (SELECT doc_id AS id, lang FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id AS id, 'b-' || lang AS lang, source FROM documents WHERE doc_id % 4 <> 0), c AS (SELECT doc_id AS id, 'c' AS source FROM documents)
  SELECT id, coalesce(a.lang, b.lang) AS lang, coalesce(b.source, c.source) AS source FROM a FULL JOIN b USING (id) LEFT JOIN c USING (id)""")
def k15_full_outer_merge(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "id")
    a, b = docs.where("id % 3 <> 0").select("id", "lang"), docs.where("id % 4 <> 0").select("id", F.concat(F.lit("b-"), "lang").alias("lang"), "source")
    return catalog.merge_sources(a, b, docs.select("id", F.lit("c").alias("source")), "id", ["lang", "source"])


@query("WITH a AS (SELECT source AS table_name, count(*) AS before FROM documents GROUP BY ALL), b AS (SELECT source AS table_name, count(*) AS after FROM documents WHERE lang = 'en' OR source = 'src1' GROUP BY ALL) SELECT table_name, before, after FROM a FULL JOIN b USING (table_name) WHERE before IS DISTINCT FROM after")
def k16_count_diff(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    counts = lambda df: df.groupBy(F.col("source").alias("table_name")).agg(F.count("*").alias("n"))
    return audit.count_changes(counts(docs), counts(docs.where("lang = 'en' OR source = 'src1'")))


@query("SELECT user_id AS book_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS updated_at FROM events GROUP BY ALL")
def k09_latest_status(spark: S, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("user_id").alias("book_id"), F.col("event_type").alias("status"), F.struct("ts", "event_id").alias("ts"))
    return catalog.latest_status(events).select("book_id", "status", F.col("updated_at.ts").alias("updated_at"))


STATES = [("pending",), ("extracting",), ("extracted",), ("indexing",), ("indexed",), ("failed",), (None,)]


_state = "CASE event_type WHEN 'view' THEN 'extracting' WHEN 'click' THEN 'indexed' WHEN 'error' THEN 'indexing' WHEN 'signup' THEN NULL ELSE event_type END AS s"


@query(f"SELECT s, coalesce(s, 'pending') NOT IN ('extracting', 'extracted', 'indexing', 'indexed') AS extract, coalesce(s, 'pending') <> 'indexing' AS index FROM {plus_sql(f'SELECT {_state} FROM events', 's', STATES)}")
def p03_state_guards(spark: S, d: str) -> DataFrame:
    rows = plus(table(spark, d, "events").select(F.expr(_state)), "s string", STATES)
    return rows.select("s", catalog.may_start(F.col("s"), "extract").alias("extract"), catalog.may_start(F.col("s"), "index").alias("index"))


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def j02_left_join_default(spark: S, d: str) -> DataFrame:
    return relations.with_fields(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", quality=-1)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j13_anti_join(spark: S, d: str) -> DataFrame:
    return relations.unmatched(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("""SELECT d.doc_id AS id, coalesce(g.title, o.title) AS title FROM documents d LEFT JOIN (SELECT '978' || doc_id || '0' AS k, 'G' || doc_id AS title FROM labels) g ON g.k = translate(concat('978-', d.doc_id, ' 0'), '- ', '')
  LEFT JOIN (SELECT '978' || (3 * item_id) || '0' AS k, text AS title FROM benchmark) o ON o.k = translate(concat('978-', d.doc_id, ' 0'), '- ', '')""")
def j15_isbn_lookup(spark: S, d: str) -> DataFrame:
    key = lambda c: F.concat(F.lit("978"), c.cast("string"), F.lit("0")).alias("k")
    books = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.translate(F.concat(F.lit("978-"), F.col("doc_id"), F.lit(" 0")), "- ", "").alias("k"))
    first = table(spark, d, "labels").select(key(F.col("doc_id")), F.concat(F.lit("G"), "doc_id").alias("title"))
    return relations.first_of(books, "k", "title", first, table(spark, d, "benchmark").select(key(F.col("item_id") * 3), F.col("text").alias("title"))).drop("k")


@query(f"WITH {OUTLINE_SQL} SELECT book_id, count(*) AS n FROM outline WHERE block_type = 'SectionHeader' GROUP BY ALL HAVING count(*) > 3")
def o03_limits_after_group(spark: S, d: str) -> DataFrame:
    return relations.groups_over(outline(spark, d).where("block_type = 'SectionHeader'"), "book_id", 3)


@query("""SELECT id, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), '|') AS united, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), '|') AS only_first
  FROM (SELECT doc_id AS id, [source, lang, 'x'] AS a, [lang, 'src1', 'z'] AS b FROM documents)""")
def u04_list_sets(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "documents").selectExpr("doc_id AS id", "array(source, lang, 'x') AS a", "array(lang, 'src1', 'z') AS b")
    return rows.select("id", F.array_join(F.array_union("a", "b"), "|").alias("united"), F.array_join(F.array_except("a", "b"), "|").alias("only_first"))


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 UNION SELECT doc_id FROM labels")
def u02_set_union(spark: S, d: str) -> DataFrame:
    some = table(spark, d, "documents").where("doc_id % 2 = 0")  # so that neither side has all keys
    return relations.keys_of_all("doc_id", some, table(spark, d, "labels"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u03_set_difference(spark: S, d: str) -> DataFrame:
    return relations.keys_only_in("doc_id", table(spark, d, "documents"), table(spark, d, "labels"))