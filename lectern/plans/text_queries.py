"""Sources, scalars and text transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import fixed, text
from lectern.operators import enrich, filters
from lectern.plans.registry import BLOCKS_SQL, OUTLINE_SQL, blocks, heading_sql, outline, plus, plus_sql, query, quoted, strip_sql, table

S = SparkSession
BARE = "regexp_replace(html, '<[^>]+>', '', 'g')"


def _mode(spark: S, d: str, mode: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.html_to_text(F.col("html"), mode).alias("text"))


@query(f"SELECT page_id, {strip_sql(BARE)} AS text FROM pages")
def t01_html_strip(spark: S, d: str) -> DataFrame:
    return _mode(spark, d, "strip")


@query(f"SELECT page_id, {strip_sql(rf"regexp_replace({BARE}, '\s+', ' ', 'g')")} AS text FROM pages")
def t01_html_flat(spark: S, d: str) -> DataFrame:
    return _mode(spark, d, "flat")


@query(f"SELECT page_id, {strip_sql(rf"regexp_replace(regexp_replace({BARE}, '[^\S\n]+', ' ', 'g'), '\n\s*\n', chr(10), 'g')")} AS text FROM pages")
def t01_html_lines(spark: S, d: str) -> DataFrame:
    return _mode(spark, d, "lines")


_s = "regexp_replace(regexp_replace(regexp_replace(html, '<img[^>]*>', '', 'g'), '<br\\s*/?>', chr(10), 'g'), '<p[^>]*>', '', 'g')"
_s = f"regexp_replace(replace({_s}, '</p>', chr(10) || chr(10)), '<li[^>]*>', '  - ', 'g')"
_s = f"regexp_replace(regexp_replace(replace({_s}, '</li>', chr(10)), '<[^>]+>', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"


@query(f"SELECT page_id, {strip_sql(_s)} AS text FROM pages")
def t01_html_structured(spark: S, d: str) -> DataFrame:
    return _mode(spark, d, "structured")


@query(f"WITH {BLOCKS_SQL} SELECT book_id, block_idx, page, block_type, text FROM blocks")
def s01_blocks(spark: S, d: str) -> DataFrame:
    return blocks(spark, d).select("book_id", "block_idx", "page", "block_type", "text")


HEADS = [("# **Investing** basics",), ("Chapter 5: Waves",), ("chapter 12",), ("Rule No. 3: Listen",), ("Part 2 – The Road",), ("Cycle 7",), ("Lesson 1 - Start",), ("**Chapter 9** Tides",), ("3. The Third Way",), ("123. Too long",), ("Section 2",), ("",)]
_n, _t = heading_sql("heading")


@query(f"""WITH {OUTLINE_SQL} SELECT heading, {_n} AS number, {_t} AS title FROM {plus_sql("SELECT text AS heading FROM outline WHERE block_type = 'SectionHeader'", 'heading', HEADS)}""")
def t05_chapter_heading(spark: S, d: str) -> DataFrame:
    heads = outline(spark, d).where("block_type = 'SectionHeader'").select(F.col("text").alias("heading"))
    h = plus(heads, "heading string", HEADS).withColumn("c", text.chapter_heading(F.col("heading")))
    return h.select("heading", F.col("c.number").alias("number"), F.col("c.title").alias("title"))


PAGED = [('<span id="page-12-3"></span> x _page_7_Picture_1',), ("![](_page_44_Figure_2.jpeg)",), ("no marker",), ("page-0 first, page-9 later",), ("_page_3_ then page-8",)]


_paged = """CASE block_idx % 3 WHEN 0 THEN concat('<span id="page-', page, '-1"></span> ', text) WHEN 1 THEN concat(text, ' _page_', page, '_Figure_1') ELSE text END AS t"""


@query(f"WITH {BLOCKS_SQL} SELECT t, CAST(coalesce(nullif(regexp_extract(t, 'page-(\\d+)', 1), ''), nullif(regexp_extract(t, '_page_(\\d+)_', 1), '')) AS INT) AS page FROM {plus_sql(f'SELECT {_paged} FROM blocks', 't', PAGED)}")
def t04_first_page(spark: S, d: str) -> DataFrame:
    return plus(blocks(spark, d).select(F.expr(_paged)), "t string", PAGED).withColumn("page", text.first_page(F.col("t")))


MARKED = [("## **Chapter 5:**  Waves",), ("Chapter-5 waves!",), ("# Tides",), ("***",)]
_marked = "concat('## **', text, '**  ', lang) AS h"


@query(
    rf"""WITH {BLOCKS_SQL} SELECT h, trim(regexp_replace(regexp_replace(regexp_replace(h, '^#+\s*', ''), '\*{{1,2}}', '', 'g'), '\s+', ' ', 'g')) AS clean, regexp_replace(lower(h), '\W+', '', 'g') = 'chapter5waves' AS same
      FROM {plus_sql(f"SELECT {_marked} FROM blocks", "h", MARKED)}"""
)
def t02_clean_heading(spark: S, d: str) -> DataFrame:
    h = plus(blocks(spark, d).select(F.expr(_marked)), "h string", MARKED)
    return h.select("h", text.clean_heading(F.col("h")).alias("clean"), text.same_text(F.col("h"), F.lit("chapter 5 waves")).alias("same"))


EQUATIONS = [(r'<p><math display="block">E = mc^2, \tag{3}</math></p>',), ("<math>a = b (4)</math>",), ("<math>F = ma.</math> (2.1)",), ("<p>no math</p>",), ("<math>x,</math>",), ("<math> (5)</math>",)]
_math = strip_sql("regexp_extract(html, '(?s)<math[^>]*>(.*?)</math>', 1)")
_numbered = r"""CASE block_idx %% 4 WHEN 0 THEN concat('<p><math>', left(text, 30), %s' \tag{', block_idx, '}</math></p>') WHEN 1 THEN concat('<math display="block">', left(text, 20), ' (', page, ')</math>') WHEN 2 THEN concat('<math>', left(text, 10), '</math> (', page, '.', block_idx, ')') ELSE text END AS html"""
_paren = r"\(([0-9]+[a-z]?(?:\.[0-9]+)*)\)"


@query(
    rf"""WITH {BLOCKS_SQL} SELECT html, CASE WHEN latex <> '' THEN latex END AS latex, CASE WHEN latex <> '' THEN number END AS number FROM (SELECT html,
      regexp_replace(regexp_replace(regexp_replace(trim(CASE WHEN regexp_matches(m, '\\tag\{{[^}}]+\}}') THEN regexp_extract(m, '(?s)^(.*?)\\tag\{{', 1) WHEN regexp_matches(m, '{_paren}\s*$') THEN regexp_replace(m, '{_paren}\s*$', '') ELSE m END), ',+$', ''), '\.+$', ''), '\s+$', '') AS latex,
      coalesce(nullif(regexp_extract(m, '\\tag\{{([^}}]+)\}}', 1), ''), nullif(regexp_extract(m, '{_paren}\s*$', 1), ''), nullif(regexp_extract(a, '{_paren}', 1), '')) AS number
      FROM (SELECT html, CASE WHEN regexp_matches(html, '(?s)<math[^>]*>.*?</math>') THEN {_math} END AS m, regexp_extract(html, '(?s)<math[^>]*>.*?</math>(.*)$', 1) AS a FROM {plus_sql(f"SELECT {_numbered % ''} FROM blocks", "html", EQUATIONS)}))"""
)
def t16_equation_number(spark: S, d: str) -> DataFrame:
    e = plus(blocks(spark, d).select(F.expr(_numbered % "r")), "html string", EQUATIONS).withColumn("e", text.equation_parts(F.col("html")))
    return e.select("html", F.col("e.latex").alias("latex"), F.col("e.number").alias("number"))


LATEX = [(r"\frac{dx}{dt} = -kx", "population growth"), (r"\int_0^1 f", "the mean and variance"), (r"\vec{F} \cdot \sin(x)", ""), (r"\begin{pmatrix}1\end{pmatrix}", "cell membrane potential"), ("x", "nothing here")]
_syntax = ", ".join("CASE WHEN " + " OR ".join(f"contains(latex, {quoted(m)})" for m in marks) + f" THEN '{tag}' END" for tag, marks in fixed.EQUATION_SYNTAX)
_domain = ", ".join("CASE WHEN " + " OR ".join(f"contains(low, {quoted(w)})" for w in words) + f" THEN '{tag}' END" for tag, words in fixed.EQUATION_DOMAINS)


_latex = r"""CASE doc_id %% 5 WHEN 0 THEN concat(%(r)s'\frac{d', lang, '}{dt} = -kx') WHEN 1 THEN concat(%(r)s'\int ', source) WHEN 2 THEN concat(%(r)s'\vec{', lang, '} ', %(r)s'\sin x') ELSE lang END AS latex, text AS around"""


@query(f"SELECT latex, array_to_string(list_filter([{_syntax}, {_domain}], lambda x: x IS NOT NULL), ',') AS tags FROM (SELECT *, lower(concat(latex, ' ', around)) AS low FROM {plus_sql(f'SELECT {_latex % dict(r=str())} FROM documents', 'latex, around', LATEX)})")
def t17_equation_tags(spark: S, d: str) -> DataFrame:
    e = plus(table(spark, d, "documents").selectExpr(f"{_latex % dict(r='r')}".split(" AS latex, ")[0] + " AS latex", "text AS around"), "latex string, around string", LATEX)
    return e.select("latex", F.array_join(text.equation_tags(F.col("latex"), F.col("around")), ",").alias("tags"))


CODE = [("1\nint x;\n2\n\n3\n\n\ny();\n4",), ("53 }\n54 ArrayList<>\n55 return x",), ("plain text\nwith 2 lines",), ("10 ways\n5 means",), ("7\nalone",)]
# a text's lines numbered before, numbered in lines of their own, or as they are
_code = "CASE doc_id % 3 WHEN 0 THEN array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: concat(i, ' ', x)), chr(10)) WHEN 1 THEN array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: concat(i, chr(10), x)), chr(10)) ELSE text END AS code"
_standalone = r"list_filter(l, lambda x: regexp_matches(x, '^\s*\d{1,4}\s*$'))"
_inline = r"list_filter(l, lambda x: regexp_matches(x, '^\d{1,4} \S'))"
_nums = lambda arr: rf"list_transform({arr}, lambda x: CAST(regexp_extract(x, '(\d+)', 1) AS INT))"
_rising = lambda n, least, share: f"(len({n}) >= {least} AND len({n}) > len(l) * {share} AND {n}[-1] > {n}[1] AND ({n}[-1] - {n}[1]) / (len({n}) - 1) < 5)"


@query(
    rf"""SELECT code, CASE WHEN {_rising("own", 3, 0.15)} THEN regexp_replace(array_to_string(list_filter(l, lambda x: NOT regexp_matches(x, '^\s*\d{{1,4}}\s*$')), chr(10)), '(?m)^([ \t]*\n)(?:[ \t]*\n)+', '\1', 'g')
      WHEN {_rising("pre", 2, 0.1)} THEN array_to_string(list_transform(l, lambda x: CASE WHEN regexp_matches(x, '^\d{{1,4}} \S') THEN regexp_replace(x, '^\d{{1,4}} ', '') ELSE x END), chr(10)) ELSE code END AS clean
      FROM (SELECT code, l, {_nums(_standalone)} AS own, {_nums(_inline)} AS pre FROM (SELECT code, string_split(code, chr(10)) AS l FROM {plus_sql(f"SELECT {_code} FROM documents", "code", CODE)}))"""
)
def t13_code_clean(spark: S, d: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    numbered = lambda between: F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(between), x)), "\n")
    code = F.when(F.col("doc_id") % 3 == 0, numbered(" ")).when(F.col("doc_id") % 3 == 1, numbered("\n")).otherwise(F.col("text"))
    return plus(table(spark, d, "documents").select(code.alias("code")), "code string", CODE).withColumn("clean", text.clean_code(F.col("code")))


_third = 100


@query("SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE concat(left(text, 100), chr(10), chr(10), '[...]', chr(10), chr(10), substr(text, CAST(length(text) // 2 - 50 + 1 AS INT), 100), chr(10), chr(10), '[...]', chr(10), chr(10), right(text, 100)) END AS sample FROM documents")
def t20_sample_text(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.sample_text(F.col("text"), 300).alias("sample"))


_any = lambda words: " OR ".join(f"contains(low, {quoted(w)})" for w in words)
_subjects = ", ".join(f"CASE WHEN {_any(w)} THEN '{n}' END" for n, w in fixed.SUBJECT_KEYWORDS)
_library = "CASE " + " ".join(f"WHEN {_any(w)} THEN '{n}'" for n, w in fixed.LIBRARY_KEYWORDS) + " END"


@query(
    f"""SELECT doc_id, array_to_string(list_filter(f, lambda s: contains(s, '/') OR len(list_filter(f, lambda x: starts_with(x, s || '/'))) = 0), ',') AS subjects, library
      FROM (SELECT doc_id, list_filter([{_subjects}], lambda x: x IS NOT NULL) AS f, {_library} AS library FROM (SELECT doc_id, lower(text) AS low FROM documents))"""
)
def t21_keyword_tags(spark: S, d: str) -> DataFrame:
    tagged = text.with_keyword_tags(table(spark, d, "documents").select("doc_id", "text"), "text")
    return tagged.select("doc_id", F.array_join("subjects", ",").alias("subjects"), "library")


@query(
    f"""WITH {BLOCKS_SQL} SELECT book_id, block_idx, CASE WHEN len(w) = 0 THEN 'empty' ELSE array_to_string(list_filter([
      CASE WHEN length(regexp_replace(text, '\\s+', '', 'g')) / len(w) < 2.5 THEN 'short_words' END,
      CASE WHEN length(regexp_replace(text, '[^\\pL\\pN\\s]', '', 'g')) / length(text) < 0.6 THEN 'symbols' END,
      CASE WHEN {" OR ".join(f"contains(text, {quoted(m)})" for m in fixed.MOJIBAKE)} THEN 'mojibake' END], lambda x: x IS NOT NULL), ',') END AS reasons
      FROM (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM blocks)"""
)
def t19_garbled(spark: S, d: str) -> DataFrame:
    """Without the check for runs of a character, which needs back-references."""
    reasons = F.array_remove(text.garbled_reasons(F.col("text")), "runs")
    return blocks(spark, d).select("book_id", "block_idx", F.array_join(reasons, ",").alias("reasons"))


# five equal characters in a row: RE2 has no back-references, so character by character
RUNS_SQL = "len(list_filter(range(1, len(c) - 3), lambda i: c[i] = c[i + 1] AND c[i] = c[i + 2] AND c[i] = c[i + 3] AND c[i] = c[i + 4])) > 0"
GARBLED_SQL = f"""len(w) = 0 OR length(regexp_replace(text, '\\s+', '', 'g')) / len(w) < 2.5 OR length(regexp_replace(text, '[^\\pL\\pN\\s]', '', 'g')) / length(text) < 0.6
  OR {" OR ".join(f"contains(text, {quoted(m)})" for m in fixed.MOJIBAKE)} OR {RUNS_SQL}"""
GARBLED_FROM = "(SELECT *, string_split(text, '') AS c, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM blocks)"


@query(f"WITH {BLOCKS_SQL} SELECT book_id, block_idx FROM {GARBLED_FROM} WHERE {RUNS_SQL}")
def t19_character_runs(spark: S, d: str) -> DataFrame:
    return blocks(spark, d).where(F.array_contains(text.garbled_reasons(F.col("text")), "runs")).select("book_id", "block_idx")


AUTHORS = [("Robert Pozen", "Pozen, Robert"), ("J. M. Selig", "J.M. Selig"), ("Ann  Lee", "ann lee"), ("A, B, C", "a, b, c"), ("Kim", "Jim")]
_norm = lambda c: rf"""trim(regexp_replace(replace((CASE WHEN len(string_split(trim(regexp_replace(lower({c}), '\s+', ' ', 'g')), ', ')) = 2
    THEN concat(string_split(trim(regexp_replace(lower({c}), '\s+', ' ', 'g')), ', ')[2], ' ', string_split(trim(regexp_replace(lower({c}), '\s+', ' ', 'g')), ', ')[1]) ELSE trim(regexp_replace(lower({c}), '\s+', ' ', 'g')) END), '.', ' '), '\s+', ' ', 'g'))"""  # noqa: E731


_people = "concat(source, ', ', lang) AS a, concat(lang, '  ', upper(source)) AS b"


@query(f"SELECT a, b, {_norm('a')} AS normal, {_norm('a')} = {_norm('b')} AS same FROM {plus_sql(f'SELECT {_people} FROM documents', 'a, b', AUTHORS)}")
def t24_author_norm(spark: S, d: str) -> DataFrame:
    rows = plus(table(spark, d, "documents").selectExpr(*_people.replace(" AS a, ", " AS a;").split(";")), "a string, b string", AUTHORS)
    return rows.select("a", "b", text.normal_author(F.col("a")).alias("normal"), text.same_authors(F.array("a"), F.array("b")).alias("same"))


SIGNALS = [("a", 900.0, 6.0), ("b", 900.1, 1.0), ("c", 1.0, 6.01), ("d", 1091.0, 13.2), ("e", None, None)]


@query(f"SELECT path, CASE WHEN coalesce(img > 900 OR page > 6.0, FALSE) THEN 'modal' ELSE 'spark' END AS backend, CASE WHEN img > 900 THEN 'image megapixels' WHEN page > 6.0 THEN 'page megapixels' ELSE 'within limits' END AS reason FROM {plus_sql("SELECT concat('d', doc_id) AS path, n_chars / 2 AS img, CASE WHEN doc_id % 7 > 0 THEN doc_id % 13 / 2 END AS page FROM documents", 'path, img, page', SIGNALS)}")
def f11_routing(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents").selectExpr("concat('d', doc_id) AS path", "n_chars / 2 AS img", "CASE WHEN doc_id % 7 > 0 THEN doc_id % 13 / 2 END AS page")
    rows = plus(docs, "path string, img double, page double", SIGNALS).withColumn("r", filters.route(F.col("img"), F.col("page")))
    return rows.select("path", F.col("r.backend").alias("backend"), F.col("r.reason").alias("reason"))


INTS = [("7",), (" 12 ",), ("",), ("null",), (None,), ("x1",)]


@query(f"SELECT s, TRY_CAST(nullif(nullif(trim(s), ''), 'null') AS INT) AS n FROM {plus_sql("SELECT json_extract_string(props, '$.k') AS s FROM events", 's', INTS)}")
def f08_int_or_null(spark: S, d: str) -> DataFrame:
    said = table(spark, d, "events").select(F.get_json_object("props", "$.k").alias("s"))
    return plus(said, "s string", INTS).withColumn("n", text.int_or_null(F.col("s")))


_shelf = ("doc_id AS id", "nullif(source, 'src0') AS authors", "CASE doc_id % 3 WHEN 0 THEN concat(lang, '_', doc_id) WHEN 1 THEN concat(source, '.pdf') ELSE lang END AS title", "nullif(lang, 'en') AS publisher")
BOOKS = [(1, "unknown", "a_b.pdf", None), (2, "Ann Lee", "Tides", "Wiley"), (3, "", "Waves.epub", ""), (4, "Kim", "Sea", None)]


@query(
    f"""SELECT id, array_to_string(list_filter([CASE WHEN coalesce(authors, '') = '' OR lower(authors) = 'unknown' THEN 'author is Unknown' END,
      CASE WHEN contains(title, '_') OR ends_with(title, '.pdf') OR ends_with(title, '.epub') THEN 'title looks like filename' END, CASE WHEN coalesce(publisher, '') = '' THEN 'no publisher' END], lambda x: x IS NOT NULL), '; ') AS reasons
      FROM {plus_sql(f"SELECT {', '.join(_shelf)} FROM documents", "id, authors, title, publisher", BOOKS)}"""
)
def f10_enrichment_reasons(spark: S, d: str) -> DataFrame:
    rows = plus(table(spark, d, "documents").selectExpr(*_shelf), "id bigint, authors string, title string, publisher string", BOOKS)
    return rows.select("id", F.array_join(filters.enrichment_reasons(F.col("authors"), F.col("title"), F.col("publisher")), "; ").alias("reasons"))


@query("SELECT doc_id, 'sha256:' || left(sha256(text), 12) AS hash FROM documents")
def t33_content_hash(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query("""SELECT conv_id, turn, r FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, g ORDER BY turn) AS r FROM (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g
      FROM (SELECT conv_id, turn, CASE WHEN md5(role) = lag(md5(role)) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS c FROM conversations)))""")
def t37_consecutive_dups(spark: S, d: str) -> DataFrame:
    """Place of each turn in its run of equal content (here the role)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    hashed = table(spark, d, "conversations").withColumn("h", F.md5(F.col("role").cast("binary")))
    runs = hashed.withColumn("c", F.when(F.col("h") == F.lag("h").over(w), 0).otherwise(1)).withColumn("g", F.sum("c").over(w))
    return runs.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id", "g").orderBy("turn")).alias("r"))


@query(
    f"""WITH {BLOCKS_SQL}, x AS (SELECT book_id, page, block_idx, text, instr(lower(text), 'the') AS a FROM blocks WHERE contains(lower(text), 'the'))
      SELECT book_id, block_idx, replace(concat(CASE WHEN greatest(a - 51, 0) > 0 THEN '...' ELSE '' END, substr(text, CAST(greatest(a - 51, 0) + 1 AS INT), CAST(least(length(text), a - 1 + 53) - greatest(a - 51, 0) AS INT)), CASE WHEN least(length(text), a - 1 + 53) < length(text) THEN '...' ELSE '' END), chr(10), ' ') AS snippet FROM x"""
)
def t31_snippets(spark: S, d: str) -> DataFrame:
    cut = blocks(spark, d).select("book_id", "block_idx", text.snippet(F.col("text"), "the").alias("snippet"))
    return cut.where("snippet IS NOT NULL")


@query("SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?s)\\$\\$(.+?)\\$\\$', 1), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), '|') AS latex FROM documents WHERE contains(text, '$$')")
def t15_display_equations(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.contains("text", F.lit("$$"))).select("doc_id", F.array_join(text.display_equations(F.col("text")), "|").alias("latex"))


_cited = "CASE block_idx % 4 WHEN 0 THEN concat(text, ' [', block_idx % 150, '] Smith (', 1950 + book_id % 70, ')') WHEN 1 THEN concat('References ', text) WHEN 2 THEN concat(text, ' ISBN 978-', 100000000 + book_id, ' Wiley') ELSE text END AS text"
CITING = [(-1, 0, 1, "SectionHeader", "References"), (-1, 1, 1, "Text", "[1] Smith (2020) and (Lee & Kim, 1999), Springer."), (-1, 2, 2, "Text", "See [12] and [1]. ISBN: 978-3-16-148410-0"), (-2, 0, 1, "Text", "Nothing, O'Reilly said"), (-2, 1, 3, "SectionHeader", "Further Reading")]
_flat = lambda e: f"array_to_string(list_sort(list_distinct(flatten(list({e})))), '|')"
_pubs = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), {quoted(p.lower())}) THEN concat({quoted(p + '@')}, page) END" for p in fixed.CITED_PUBLISHERS) + "], lambda x: x IS NOT NULL)"


@query(
    rf"""WITH {BLOCKS_SQL} SELECT book_id, coalesce(array_to_string(list_sort(list_distinct(list(CASE WHEN block_type = 'SectionHeader' AND ({" OR ".join(f"contains(lower(text), '{w}')" for w in fixed.BIBLIOGRAPHY_WORDS)}) THEN page END))), '|'), '') AS bibliography_pages,
      array_to_string(list_sort(list_distinct(flatten(list(list_transform(regexp_extract_all(text, '\[(\d{{1,3}})\]', 1), lambda x: CAST(x AS INT)))))), '|') AS numbers,
      {_flat(r"list_concat(regexp_extract_all(text, '\([A-Z][a-z]+(?:\s+(?:and|&)\s+[A-Z][a-z]+)?,\s*\d{4}\)'), regexp_extract_all(text, '[A-Z][a-z]+\s+\(\d{4}\)'))")} AS author_years,
      {_flat(r"list_transform(regexp_extract_all(text, '(?i)ISBN[-:\s]*([\d-]{10,17})', 1), lambda x: replace(x, '-', ''))")} AS isbns, {_flat(_pubs)} AS publishers
      FROM {plus_sql(f"SELECT book_id, block_idx, page, block_type, {_cited} FROM blocks", "book_id, block_idx, page, block_type, text", CITING)} GROUP BY book_id"""
)
def t30_references(spark: S, d: str) -> DataFrame:
    found = enrich.references_found(plus(blocks(spark, d).select("book_id", "block_idx", "page", "block_type", F.expr(_cited)), "book_id bigint, block_idx int, page int, block_type string, text string", CITING))
    return found.select("book_id", *(F.array_join(F.col(c).cast("array<string>"), "|").alias(c) for c in ("bibliography_pages", "numbers", "author_years", "isbns", "publishers")))


@query("SELECT url, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def t36_slug(spark: S, d: str) -> DataFrame:
    return table(spark, d, "pages").select("url", text.slug(F.col("url")).alias("slug"))
