"""Chunking and parsers: rows without SQL are held by tests against fixtures."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import chunking, markdown, sinks, structure
from lectern.plans.registry import BLOCKS_SQL, LABELS_SQL, blocks, inline, outline, plus, plus_sql, query, table
from lectern.sources import blocks as block_sources
from lectern.sources import epub, remote, tei

S = SparkSession

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>On Tides</title></titleStmt><sourceDesc><biblStruct><analytic><author><persName><forename>Ann</forename><surname>Lee</surname></persName></author></analytic><monogr><imprint><date when="2019-05"/></imprint></monogr></biblStruct></sourceDesc></fileDesc></teiHeader>
<text><body><div><head>Methods</head><p>As shown <ref type="bibr" target="#b0">(Kim, 2001)</ref> here.</p><div><p>Nested <ref type="bibr" target="#b9">[9]</ref></p></div><div><head>Data</head></div></div><figure xml:id="fig_0"><head>Figure 1</head><figDesc>Waves <ref type="bibr" target="#b1">[2]</ref></figDesc></figure><figure type="table"/></body>
<back><listBibl><biblStruct xml:id="b0"><analytic><title>Waves</title><author><persName><forename>Bo</forename><surname>Kim</surname></persName></author><author><affiliation>Lab</affiliation></author></analytic><monogr><title>J. Sea</title><imprint><biblScope unit="volume">3</biblScope><biblScope unit="page" from="1" to="9"/><date when="2001"/></imprint></monogr><idno type="doi">10.1/x</idno></biblStruct>
<biblStruct xml:id="b1"><monogr><title>Book of Sea</title><author>Sea Society</author><imprint><publisher>Wiley</publisher><date>c. 1999</date></imprint></monogr><note type="raw_reference">Sea Society, Book of Sea.</note></biblStruct></listBibl></back></text></TEI>"""


#: A document as a paper: {0} and so on are its id, language, source and a year's last digits.
PAPER = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>T {0}</title></titleStmt><sourceDesc><biblStruct><analytic><author><persName><forename>{1}</forename><surname>{2}</surname></persName></author></analytic><monogr><imprint><date when="20{3}-05"/></imprint></monogr></biblStruct></sourceDesc></fileDesc></teiHeader>
<text><body><div><head>{2}</head><p>As in <ref type="bibr" target="#b0">[{0}]</ref> so.</p><div><head>{1}</head><p>x</p></div></div><figure xml:id="f{0}"><head>Figure {0}</head><figDesc>Of {2}</figDesc></figure></body>
<back><listBibl><biblStruct xml:id="b0"><analytic><title>A {1}</title><author><persName><forename>{1}</forename><surname>{2}</surname></persName></author></analytic><monogr><title>J {2}</title><imprint><biblScope unit="volume">{0}</biblScope><date when="19{3}"/></imprint></monogr></biblStruct></listBibl></back></text></TEI>"""
_two = "lpad(CAST(doc_id % 90 + 10 AS STRING), 2, '0')"


def _filled(form: str) -> F.Column:
    values = [F.col("doc_id").cast("string"), F.col("lang"), F.col("source"), F.expr(_two)]
    out = F.lit(form)
    for i, v in enumerate(values):
        out = F.replace(out, F.lit("{%d}" % i), v)
    return out


def _tei(spark: S, d: str, name: str) -> DataFrame:
    papers = table(spark, d, "documents").select(F.col("doc_id").alias("book_id"), _filled(PAPER).alias("xml"))
    return tei.read_tei(plus(papers, "book_id bigint, xml string", [(-1, TEI)]), name)


@query(f"""SELECT doc_id AS book_id, 'ref-1' AS id, 'article-journal' AS type, 'A ' || lang AS title, lang || ' ' || source AS authors, CAST('19' || {_two} AS INT) AS year, 'J ' || source AS container_title, CAST(doc_id AS STRING) AS volume, NULL AS page, NULL AS publisher, NULL AS doi FROM documents UNION ALL
  SELECT * FROM (VALUES (-1, 'ref-1', 'article-journal', 'Waves', 'Bo Kim', 2001, 'J. Sea', '3', '1-9', NULL, '10.1/x'), (-1, 'ref-2', 'chapter', 'Sea Society, Book of Sea.', 'Sea Society', 1999, 'Book of Sea', NULL, NULL, 'Wiley', NULL))""")
def x02_csl(spark: S, d: str) -> DataFrame:
    return _tei(spark, d, "references").select("book_id", "id", "type", "title", F.array_join("authors", "; ").alias("authors"), "year", "container_title", "volume", "page", "publisher", "doi")


@query("""SELECT doc_id AS book_id, 0 AS nth, concat('[', doc_id, ']') AS text, 'ref-1' AS ref_id, concat('As in [', doc_id, '] so.') AS context, source AS section FROM documents UNION ALL
  SELECT * FROM (VALUES (-1, 0, '(Kim, 2001)', 'ref-1', 'As shown (Kim, 2001) here.', 'Methods'), (-1, 1, '[9]', NULL, 'Nested [9]', 'Methods'), (-1, 2, '[2]', 'ref-2', 'Waves [2]', NULL))""")
def x03_citations(spark: S, d: str) -> DataFrame:
    return _tei(spark, d, "citations").select("book_id", "nth", "text", "ref_id", "context", "section")


@query("SELECT doc_id AS book_id, source AS title, 1 AS level, NULL AS parent FROM documents UNION ALL SELECT doc_id, lang, 2, source FROM documents UNION ALL SELECT * FROM (VALUES (-1, 'Methods', 1, NULL), (-1, 'Data', 2, 'Methods'))")
def x04_sections(spark: S, d: str) -> DataFrame:
    return _tei(spark, d, "sections").select("book_id", "title", "level", "parent")


@query("SELECT doc_id AS book_id, concat('f', doc_id) AS id, concat('Figure ', doc_id) AS label, 'Of ' || source AS caption, 'figure' AS type FROM documents UNION ALL SELECT * FROM (VALUES (-1, 'fig_0', 'Figure 1', 'Waves [2]', 'figure'))")
def x05_figures(spark: S, d: str) -> DataFrame:
    return _tei(spark, d, "figures").select("book_id", "id", "label", "caption", "type")


@query(f"SELECT doc_id AS book_id, concat('T ', doc_id) AS title, lang || ' ' || source AS authors, CAST('20' || {_two} AS INT) AS year FROM documents UNION ALL SELECT * FROM (VALUES (-1, 'On Tides', 'Ann Lee', 2019))")
def x06_header(spark: S, d: str) -> DataFrame:
    return _tei(spark, d, "header").select("book_id", "title", F.array_join("authors", "; ").alias("authors"), "year")


OPF = '<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Sea</dc:title><dc:creator>Ann Lee</dc:creator><dc:creator>Bo Kim</dc:creator><dc:publisher>Wiley</dc:publisher><dc:date>2020-01-02</dc:date></metadata><manifest><item id="a" href="a.xhtml"/><item id="e" href="e.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="e"/><itemref idref="b"/></spine></package>'


def sample_epub() -> bytes:
    """A small book of two chapters and an empty document between them."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
        z.writestr("OPS/book.opf", OPF)
        z.writestr("OPS/a.xhtml", "<html><head><title>x</title></head><body><h1>One</h1><p>First <b>words</b></p><p> </p><ul><li>a</li></ul></body></html>")
        z.writestr("OPS/e.xhtml", "<html><body> <p></p></body></html>")
        z.writestr("OPS/b.xhtml", "<html><body>bare text<figure><img src='i.png'/></figure><table><tr><td>1</td></tr></table></body></html>")
    return out.getvalue()


@query("""SELECT * FROM (VALUES (1, 0, 'SectionHeader', '<h1>One</h1>'), (1, 1, 'Text', '<p>First <b>words</b></p>'), (1, 2, 'ListGroup', '<ul><li>a</li></ul>'),
  (2, 0, 'Text', '<p>bare text</p>'), (2, 1, 'Figure', '<figure><img src=''i.png''/></figure>'), (2, 2, 'Table', '<table><tr><td>1</td></tr></table>')) AS v(page, block_num, block_type, html)""")
def s06_epub(spark: S, d: str) -> DataFrame:
    files = spark.createDataFrame([("x.epub", bytearray(sample_epub()))], "path string, content binary")
    return epub.epub_blocks(files).select("page", "block_num", "block_type", "html")


@query()
def s07_html_blocks(spark: S, d: str) -> DataFrame:
    return epub.html_blocks(table(spark, d, "pages"))


_opf = '<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{2} {0}</dc:title><dc:creator>{1} Lee</dc:creator><dc:creator>Bo {2}</dc:creator><dc:publisher>{1}</dc:publisher><dc:date>20{3}-01-02</dc:date></metadata></package>'


@query(f"SELECT concat(source, ' ', doc_id) AS title, concat(lang, ' Lee; Bo ', source) AS authors, lang AS publisher, CAST('20' || {_two} AS INT) AS year FROM documents UNION ALL SELECT * FROM (VALUES ('Sea', 'Ann Lee; Bo Kim', 'Wiley', 2020))")
def s08_opf_metadata(spark: S, d: str) -> DataFrame:
    packages = plus(table(spark, d, "documents").select(_filled(_opf).alias("opf")), "opf string", [(OPF,)])
    m = packages.select(epub.opf_metadata(F.col("opf")).alias("m"))
    return m.select("m.title", F.array_join("m.authors", "; ").alias("authors"), "m.publisher", "m.year")


FEEDS = [(-1, "one\n\ftwo\n\n\f"), (-2, "only"), (-3, "\fsecond")]


@query("""SELECT id, page, rtrim(p[page], chr(10)) AS text FROM (SELECT doc_id AS id, p, unnest(range(1, len(p) + 1)) AS page FROM (SELECT doc_id, string_split(regexp_replace(replace(text, chr(10), chr(10) || chr(12)), '\f$', ''), chr(12)) AS p FROM documents))
  UNION ALL SELECT * FROM (VALUES (-1, 1, 'one'), (-1, 2, 'two'), (-2, 1, 'only'), (-3, 1, ''), (-3, 2, 'second'))""")
def s09_pdf_pages(spark: S, d: str) -> DataFrame:
    """Every line of a document as a page that ends in a line end and a form feed."""
    fed = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.replace("text", F.lit("\n"), F.lit("\n\f")).alias("text"))
    return block_sources.split_pages(plus(fed, "id bigint, text string", FEEDS))


@query(f"""WITH {BLOCKS_SQL} SELECT book_id, string_agg(CASE block_type WHEN 'SectionHeader' THEN '# ' || text WHEN 'Code' THEN '```' || chr(10) || text || chr(10) || '```' ELSE text END, chr(10) || chr(10) ORDER BY block_idx) AS text FROM blocks GROUP BY book_id""")
def s02_markdown(spark: S, d: str) -> DataFrame:
    return block_sources.to_markdown(blocks(spark, d))


INFO = [("a.pdf", "Pages:  12\nPage size:  612 x 792 pts", "page num type width height\n   1  0 image  1000  2000 rgb\n   2  1 image  500 400 gray"), ("b.pdf", "", "")]


@query("""SELECT concat('p', doc_id) AS path, CAST(doc_id AS INT) AS pages, (CAST(1000 + doc_id % 100 AS DOUBLE) * 2000 + 200000) / 1e6 AS img_mpix, CAST(600 + doc_id % 50 AS DOUBLE) / 72 * 192 * 792 / 72 * 192 / 1e6 AS page_megapix FROM documents UNION ALL
  SELECT * FROM (VALUES ('a.pdf', 12, 2.2::DOUBLE, 612::DOUBLE / 72 * 192 * 792 / 72 * 192 / 1e6), ('b.pdf', NULL, 0.0, NULL))""")
def s21_pdf_signals(spark: S, d: str) -> DataFrame:
    said = table(spark, d, "documents").select(
        F.concat(F.lit("p"), "doc_id").alias("path"),
        F.format_string("Pages:  %d\nPage size:  %d x 792 pts", "doc_id", F.col("doc_id") % 50 + 600).alias("pdfinfo"),
        F.format_string("page num type width height\n   1  0 image  %d  2000 rgb\n   2  1 image  500 400 gray", F.col("doc_id") % 100 + 1000).alias("pdfimages"),
    )
    return block_sources.pdf_signals(plus(said, "path string, pdfinfo string, pdfimages string", INFO))


FOLDERS = [("/c/Ann/Sea (2)/Sea.epub",), ("/c/Ann/Sea (2)/Sea.pdf",), ("/c/Bo/Land (7)/l.epub",), ("/c/x/cover.jpg",)]


_folder = "concat('/c/', lang, '/', source, ' (', doc_id // 2, ')/', doc_id, CASE doc_id % 3 WHEN 0 THEN '.epub' WHEN 1 THEN '.pdf' ELSE '.jpg' END)"


@query(f"""WITH f AS (SELECT CAST(doc_id // 2 AS INT) AS id, source AS title, CASE doc_id % 3 WHEN 0 THEN 'epub' WHEN 1 THEN 'pdf' END AS format, {_folder} AS path FROM documents WHERE doc_id >= 20), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY format DESC, path) AS nth FROM f WHERE format IS NOT NULL)
  SELECT id, title, format, path FROM r WHERE nth = 1 UNION ALL SELECT * FROM (VALUES (2, 'Sea', 'pdf', '/c/Ann/Sea (2)/Sea.pdf'), (7, 'Land', 'epub', '/c/Bo/Land (7)/l.epub'))""")
def s20_library_folders(spark: S, d: str) -> DataFrame:
    paths = table(spark, d, "documents").where("doc_id >= 20").select(F.expr(_folder.replace("//", "div")).alias("path"))  # ids below are those of the rows beside
    return block_sources.library_folders(plus(paths, "path string", FOLDERS))


FIGURES = [(1, 0, 3, "Figure", "Figure 2: Waves", '<img src="_page_4_Figure_10.jpeg">', None), (1, 1, 5, "Text", "again", '<img src="_page_4_Figure_10.jpeg">', None), (1, 2, 6, "FigureGroup", "", "", {"x_photo.png": "data"})]


@query("SELECT * FROM (VALUES ('marker:_page_4_Figure_10', 'figure', 4, 10, 3, 'Figure 2: Waves', 'Figure 2'), ('marker:x_photo', 'figure', NULL, NULL, 6, NULL, NULL)) AS v(image_id, kind, page, index, marker_page, caption, label)")
def j11_image_blocks(spark: S, d: str) -> DataFrame:
    rows = inline(spark, "book_id int, raw_idx int, page int, block_type string, text string, html string, images map<string,string>", FIGURES)
    return block_sources.images_of_blocks(rows).drop("book_id")


IDS = [("marker:a_1.png",), ("marker:..%2Fetc.png",), ("other:a.png",), ("marker:a%20b.jpg",), ("marker:x.exe",), ("marker:.png",)]


_named = "source, '_', doc_id, CASE doc_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.exe' WHEN 3 THEN '%2F..%2Fx.png' ELSE '.webp' END"


@query(f"SELECT concat('marker:', {_named}) AS image_id, CASE WHEN doc_id % 5 IN (0, 1, 4) THEN concat({_named}) END AS file FROM documents UNION ALL SELECT * FROM (VALUES ('marker:a_1.png', 'a_1.png'), ('marker:..%2Fetc.png', NULL), ('other:a.png', NULL), ('marker:a%20b.jpg', 'a b.jpg'), ('marker:x.exe', NULL), ('marker:.png', NULL))")
def f12_image_path(spark: S, d: str) -> DataFrame:
    ids = plus(table(spark, d, "documents").selectExpr(f"concat('marker:', {_named}) AS image_id"), "image_id string", IDS)
    return ids.select("image_id", block_sources.resolve_image(F.col("image_id")).alias("file"))


@query()
def c01_chunks(spark: S, d: str) -> DataFrame:
    return chunking.chunks(blocks(spark, d).drop("lang", "source"), 64, 16)


@query()
def c02_equation_chunks(spark: S, d: str) -> DataFrame:
    return chunking.equation_chunks(table(spark, d, "documents").select("doc_id", "text"))


@query(f"""WITH {LABELS_SQL}, s AS (SELECT *, lead(page_start) OVER (PARTITION BY book_id ORDER BY number) AS f FROM chapters), q AS (SELECT DISTINCT book_id, page FROM outline),
  c AS (SELECT q.book_id, q.page, min(number) AS chapter_num FROM q LEFT JOIN s ON s.book_id = q.book_id AND q.page >= page_start AND (f IS NULL OR q.page < f) GROUP BY ALL)
  SELECT l.book_id, l.block_idx, l.page, l.block_type, 0 AS piece_idx, l.text, CASE WHEN l.chapter_num IS NULL AND l.section_title IS NULL THEN c.chapter_num ELSE l.chapter_num END AS chapter_num, l.section_title
  FROM labels l LEFT JOIN c USING (book_id, page) WHERE l.text <> ''""")
def c04_labelled_chunks(spark: S, d: str) -> DataFrame:
    """Blocks as whole chunks, so that SQL can follow: how they are split, a test by definition holds."""
    o = outline(spark, d).drop("lang", "source")
    context = structure.page_context(o.select("book_id", "page").distinct(), structure.chapters(o))
    return chunking.label_chunks(chunking.chunks(o, 1 << 40, 0), structure.block_labels(o), context)


_lead = "left(string_split(left(string_agg(text, chr(10) || chr(10) ORDER BY block_idx), 4000), chr(10) || chr(10))[1], 500)"


@query(f"""WITH {LABELS_SQL}, nodes AS (SELECT book_id, 'book' AS level, NULL AS chapter_num, NULL AS section_title, {_lead} AS summary FROM outline GROUP BY book_id UNION ALL
  SELECT book_id, 'chapter', chapter_num, NULL, {_lead} FROM labels WHERE chapter_num IS NOT NULL GROUP BY book_id, chapter_num UNION ALL
  SELECT book_id, 'section', NULL, section_title, summary FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY first) AS nth FROM (SELECT book_id, section_title, min(block_idx) AS first, {_lead} AS summary, sum(length(text) + 2) - 2 AS size FROM labels
    WHERE section_title IS NOT NULL AND book_id NOT IN (SELECT book_id FROM chapters) GROUP BY book_id, section_title) WHERE size >= 1500) WHERE nth <= 40) SELECT * FROM nodes WHERE summary <> ''""")
def c05_summary_nodes(spark: S, d: str) -> DataFrame:
    o = outline(spark, d)
    return chunking.summaries(o, structure.block_labels(o), structure.chapters(o))


EQ_BLOCKS = [(1, 0, 1, "Text", "Newton wrote", None), (1, 1, 1, "Equation", "", "<math>F = ma</math> (1)"), (1, 2, 1, "Text", "where F is force. More", None), (1, 3, 2, "Equation", r"a\_1 = b", None), (1, 4, 2, "Text", "see (7) there", None)]


@query(r"""SELECT * FROM (VALUES (1, 'F = ma', '1', 'Newton wrote', 'where F is force. More see (7) there', 'equality,physics', 'F = ma equation 1 F is force'), (3, 'a_1 = b', '7', 'Newton wrote where F is force. More', 'see (7) there', 'equality,physics', 'a_1 = b equation 7')) AS v(block_idx, latex, equation_number, context_before, context_after, tags, text)""")
def t14_t18_equations(spark: S, d: str) -> DataFrame:
    rows = inline(spark, "book_id int, block_idx int, page int, block_type string, text string, html string", EQ_BLOCKS)
    found = chunking.equations_with_context(rows)
    ready = chunking.searchable_equations(found, chunking.describe_latex(F.col("latex")))
    return ready.select("block_idx", "latex", "equation_number", "context_before", "context_after", F.array_join("tags", ",").alias("tags"), "text")


MATH = [("a $$x^2$$ b $y$ $$\nz\n$$",), ("plain",)]


_math = "concat('a $$', lang, '^', doc_id, '$$ b $y$ ', text, ' $$', source, '$$') AS t"


@query(r"SELECT t, regexp_replace(t, '(?s)(\$\$(.+?)\$\$)', '\1' || chr(10) || '[Mathematical equation: \2]', 'g') AS augmented FROM " + plus_sql(f"SELECT {_math} FROM documents", "t", MATH))
def t03_augment_equations(spark: S, d: str) -> DataFrame:
    return plus(table(spark, d, "documents").select(F.expr(_math)), "t string", MATH).select("t", chunking.augment_equations(F.col("t")).alias("augmented"))


ANSWERS = [('Sure: {"subjects": ["a"], "library": "cs"} ok',), ("no json",), ("```json\n{\"subjects\": []}\n```",)]


@query("SELECT event_id AS n, NULL AS subjects, NULL AS library, CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k FROM events UNION ALL SELECT * FROM (VALUES (-1, 'a', 'cs', NULL), (-2, NULL, NULL, NULL), (-3, '', NULL, NULL))")
def t22_json_answers(spark: S, d: str) -> DataFrame:
    """Answers around the events' properties, but for errors."""
    said = F.when(F.col("event_type") != "error", F.concat(F.lit("```json\nSure: "), "props", F.lit(" ok\n```"))).otherwise("no json")
    rows = plus(table(spark, d, "events").select(F.col("event_id").alias("n"), said.alias("answer")), "n bigint, answer string", [(-1 - i, a[0]) for i, a in enumerate(ANSWERS)])
    j = rows.select("n", remote.json_in(F.col("answer"), "subjects array<string>, library string, k int").alias("j"))
    return j.select("n", F.array_join("j.subjects", ",").alias("subjects"), "j.library", "j.k")


@query("SELECT doc_id, source, lang FROM documents WHERE lang IS DISTINCT FROM 'de'")
def k03_delete_by_field(spark: S, d: str) -> DataFrame:
    return sinks.without(table(spark, d, "documents"), "lang", "de").select("doc_id", "source", "lang")


@query("SELECT doc_id FROM documents WHERE lang = 'fr' AND CAST(doc_id % 2 AS VARCHAR) = '1'")
def s17_scan_by_filters(spark: S, d: str) -> DataFrame:
    return sinks.matching(table(spark, d, "documents").withColumn("odd", F.col("doc_id") % 2), {"lang": "fr", "odd": 1}).select("doc_id")


@query("SELECT vec_id, CASE WHEN vec_id % 20 = 3 THEN -1 ELSE label END AS label FROM embeddings")
def k04_update_by_book(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "label", (F.col("vec_id") % 20).alias("book_id"))
    return sinks.updated(rows, 3, {"label": -1})[0].select("vec_id", "label")


WORDS = ["the", "and", "to"]


@query("SELECT item_id, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS n_the, (length(lower(text)) - length(replace(lower(text), 'and', ''))) // 3 AS n_and, (length(lower(text)) - length(replace(lower(text), 'to', ''))) // 2 AS n_to FROM benchmark")
def r12_embedding(spark: S, d: str) -> DataFrame:
    vector = remote.embed(F.col("text"), lambda: remote.vocabulary_embedder(WORDS))
    made = table(spark, d, "benchmark").withColumn("v", vector)
    return made.select("item_id", *(F.get("v", F.lit(i)).cast("bigint").alias(f"n_{w}") for i, w in enumerate(WORDS)))


MARKDOWN = """### Section One: Basics
# Chapter 1
_page_3_Picture_1.jpeg
# **The Sea**
### **Tides**
### Notes
page-7
### Section 2: More
# Chapter 2: Land
## Hills
page-12
# Index
"""


#: A document as a book of two chapters; see ``PAPER`` for the numbers.
BOOK = "### Section 1: {2}\n# Chapter 1: {2}\npage-3\n## {1}\npage-7\n# Chapter 2: End of {0}\n## Notes\npage-9\n# Index\n"


def _books(spark: S, d: str) -> DataFrame:
    return plus(table(spark, d, "documents").select(F.col("doc_id").alias("book_id"), _filled(BOOK).alias("text")), "book_id bigint, text string", [(-1, MARKDOWN)])


@query("""SELECT doc_id AS book_id, 0 AS nth, 'book_section' AS kind, 1 AS number, source AS title, NULL AS page_start, NULL AS page_end, NULL AS parent FROM documents UNION ALL SELECT doc_id, 1, 'chapter', 1, source, 3, 7, 1 FROM documents
  UNION ALL SELECT doc_id, 2, 'section', NULL, lang, 3, NULL, 1 FROM documents UNION ALL SELECT doc_id, 3, 'chapter', 2, concat('End of ', doc_id), 7, 9, 1 FROM documents UNION ALL
  SELECT * FROM (VALUES (-1, 0, 'book_section', 1, 'Basics', NULL, NULL, NULL), (-1, 1, 'chapter', 1, '', 3, 7, 1), (-1, 2, 'section', NULL, 'Tides', 3, NULL, 1),
  (-1, 3, 'book_section', 2, 'More', NULL, NULL, NULL), (-1, 4, 'chapter', 2, 'Land', 7, 12, 2), (-1, 5, 'section', NULL, 'Hills', 7, NULL, 2))""")
def t06_markdown_structure(spark: S, d: str) -> DataFrame:
    return markdown.parse_books(_books(spark, d))


@query("""SELECT doc_id AS book_id, 1 AS number, CAST(length(source) + length(lang) + 32 AS INT) AS n_chars FROM documents UNION ALL SELECT doc_id, 2, CAST(length(CAST(doc_id AS VARCHAR)) + 37 AS INT) FROM documents UNION ALL SELECT * FROM (VALUES (-1, 1, 100), (-1, 2, 35))""")
def t35_chapter_text(spark: S, d: str) -> DataFrame:
    return markdown.chapter_texts(_books(spark, d)).select("book_id", "number", F.length("text").alias("n_chars"))


@query("""SELECT doc_id AS book_id, concat_ws(chr(10), source, concat('Chapter 1: ', source, ' (p. 3)'), concat('  - ', lang, ' (p. 3)'), concat('Chapter 2: End of ', doc_id, ' (p. 7)')) AS contents FROM documents UNION ALL
  SELECT -1, concat_ws(chr(10), 'Basics', 'Chapter 1 (p. 3)', '  - Tides (p. 3)', 'More', 'Chapter 2: Land (p. 7)', '  - Hills (p. 7)')""")
def t12_contents(spark: S, d: str) -> DataFrame:
    return markdown.render_contents(markdown.parse_books(_books(spark, d)))


ACCEPTED = [(1, 1, "Sea", 0), (1, 2, "Land", 4)]
AUDITED = [(1, i, 1, "SectionHeader" if t else "Text", t or "x") for i, t in enumerate(["Chapter 1", "SEA", "", "Foam", "Land", "Hills", "", "Notes"])]


@query("SELECT * FROM (VALUES (0, 1, NULL), (1, 1, NULL), (2, 1, NULL), (3, 1, 'Foam'), (4, 2, NULL), (5, 2, 'Hills'), (6, 2, 'Hills'), (7, 2, 'Hills')) AS v(block_idx, chapter_num, section_title)")
def t43_structure_from_chapters(spark: S, d: str) -> DataFrame:
    rows = inline(spark, "book_id int, block_idx int, page int, block_type string, text string", AUDITED)
    return structure.from_chapters(rows, inline(spark, "book_id int, number int, title string, start int", ACCEPTED)).select("block_idx", "chapter_num", "section_title")


@query("SELECT * FROM (VALUES (1, '[0] Sea :: deep wat'), (2, '[3] Land')) AS v(book_id, prompt)")
def t41_fit_prompt(spark: S, d: str) -> DataFrame:
    heads = inline(spark, "book_id int, block_idx int, heading string, peek string", [(1, 0, "Sea", "deep water"), (2, 3, "Land", "")])
    return structure.fit_prompt(heads, 19, (10, 8, 0))


CHECKED = [(-1, None, None), (-2, [1, 2], []), (-3, [1, 2], [1, 2]), (-4, [1, 2], [1])]


@query("SELECT doc_id AS id, CASE WHEN quality IS NULL THEN 'no_answer' WHEN quality = 1 THEN 'apply' WHEN toxic = 1 THEN 'apply_valid' ELSE 'rejected' END AS decision FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT * FROM (VALUES (-1, 'no_answer'), (-2, 'rejected'), (-3, 'apply'), (-4, 'apply_valid'))")
def t44_decision(spark: S, d: str) -> DataFrame:
    known = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    audits = known.selectExpr("doc_id AS id", "CASE WHEN quality IS NOT NULL THEN array(1, 2) END AS p", "CASE WHEN quality = 1 THEN array(1, 2) WHEN toxic = 1 THEN array(1) WHEN quality = 0 THEN array() END AS a")
    rows = plus(audits, "id bigint, p array<int>, a array<int>", CHECKED)
    return rows.select("id", structure.decision(F.col("p"), F.col("a")).alias("decision"))


@query(f"WITH {BLOCKS_SQL} SELECT book_id, page, block_idx, text FROM blocks WHERE block_type = 'SectionHeader' AND page = 1")
def n04_headers_of_a_page(spark: S, d: str) -> DataFrame:
    return blocks(spark, d).where("block_type = 'SectionHeader' AND page = 1").select("book_id", "page", "block_idx", "text")


@query("SELECT doc_id, text FROM documents WHERE source ILIKE 'SRC1'")
def f06_title_in_any_case(spark: S, d: str) -> DataFrame:
    from lectern.operators import filters

    return table(spark, d, "documents").where(filters.same_title(F.col("source"), "SRC1")).select("doc_id", "text")


@query(f"WITH {BLOCKS_SQL} SELECT book_id, block_idx, page FROM blocks WHERE page BETWEEN 2 AND 3")
def f07_page_range(spark: S, d: str) -> DataFrame:
    from lectern.operators import filters

    return blocks(spark, d).where(filters.pages(2, 3)).select("book_id", "block_idx", "page")


@query("SELECT d.doc_id, d.lang, r.tag FROM documents d, (VALUES ('en', 'english'), ('de', 'german')) AS r(lang, tag) WHERE contains(d.lang, r.lang)")
def j16_rules_on_rows(spark: S, d: str) -> DataFrame:
    """A fixed handful of rules against all rows."""
    rules = F.broadcast(inline(spark, "rule string, tag string", [("en", "english"), ("de", "german")]))
    return table(spark, d, "documents").join(rules, F.contains("lang", F.col("rule"))).select("doc_id", "lang", "tag")


FILES = [("a.pdf",), ("b.EPUB",), ("c.txt",)]


_path = "concat(source, '/', doc_id, CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.EPUB' WHEN 2 THEN '.txt' ELSE '' END) AS path"


@query(f"SELECT {_path}, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'epub' ELSE 'unsupported' END AS route FROM documents UNION ALL SELECT * FROM (VALUES ('a.pdf', 'pdf'), ('b.EPUB', 'epub'), ('c.txt', 'unsupported'))")
def p01_dispatch(spark: S, d: str) -> DataFrame:
    paths = plus(table(spark, d, "documents").select(F.expr(_path)), "path string", FILES)
    return paths.select("path", block_sources.extractor_of(F.col("path")).alias("route"))
