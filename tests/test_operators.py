"""Operators on small inputs with results worked out by hand."""

import datetime as dt
import json
import os
import random
import re
import subprocess
import sys
import time
import zipfile
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern import conf
from lectern.functions import text, tokens, vectors
from lectern.operators import audit, catalog, chunking, filters, metrics, navigate, relations, retrieval, sinks, structure
from lectern.plans import parser_queries
from lectern.sources import blocks as block_sources
from lectern.sources import epub, remote, services, tei
from lectern.streaming import ingest

BLOCK = "book_id int, block_idx int, page int, block_type string, text string"


def listed(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def book(n=12, book_id=1):
    return [(book_id, i, i // 5 + 1, "Text", f"block {i}") for i in range(n)]


def test_span_pages_join_to_the_whole_in_numeric_order(spark):
    rows = spark.createDataFrame(book(), BLOCK)
    parts, cursor = [], None
    for _ in range(20):
        r = navigate.read_span(rows, "book_id", "block_idx", 20, cursor).first()
        parts.append(r.text)
        cursor = r.next_cursor
        if cursor is None:
            break
    assert "\n\n".join(parts) == "\n\n".join(f"block {i}" for i in range(12))


def test_span_reads_one_block_over_budget_and_rejects_bad_cursors(spark):
    rows = spark.createDataFrame([(1, 0, 1, "Text", ""), (1, 1, 1, "Text", "x" * 50)], BLOCK)
    assert navigate.read_span(rows, "book_id", "block_idx", 1).first().n_blocks == 1
    with pytest.raises(ValueError):
        navigate.read_span(rows, "book_id", "block_idx", 1, "idx:3")


def test_labels_reset_sections_at_chapters(spark):
    heads = {0: "Chapter 1: Sea", 2: "Tides", 4: "Notes", 6: "Chapter 2", 8: "Foam"}
    rows = [(1, i, 1, "SectionHeader" if i in heads else "Text", heads.get(i, "t")) for i in range(10)]
    got = structure.block_labels(spark.createDataFrame(rows, BLOCK)).orderBy("block_idx").collect()
    assert [r.chapter_num for r in got] == [1] * 6 + [2] * 4
    assert [r.section_title for r in got] == [None, None, "Tides", "Tides", "Tides", "Tides", None, None, "Foam", "Foam"]


def test_table_of_contents_gives_titles_only(spark):
    toc = [(1, i, 1, "SectionHeader", f"Chapter {i + 1}: T{i + 1}") for i in range(4)]
    body = [(1, 200 + 10 * i, 20 + i, "SectionHeader", f"Chapter {i + 1}") for i in range(3)]
    got = structure.chapters(spark.createDataFrame(toc + body, BLOCK))
    assert listed(got, "number", "title", "page_start", "start_block_idx") == [(1, "T1", 20, 200), (2, "T2", 21, 210), (3, "T3", 22, 220), (4, "T4", None, None)]


def test_sections_without_chapters(spark):
    rows = [(1, 0, 1, "SectionHeader", "METHODS"), (1, 1, 1, "Text", "a"), (1, 2, 1, "SectionHeader", "RESULTS"), (1, 3, 1, "Text", "b")]
    got = structure.block_labels(spark.createDataFrame(rows, BLOCK)).orderBy("block_idx").collect()
    assert [r.section_title for r in got] == ["METHODS", "METHODS", "RESULTS", "RESULTS"]


def test_trimmed_back_matter_keeps_blocks(spark):
    labels = spark.createDataFrame([(1, i, 1, "s") for i in range(4)], "book_id int, block_idx int, chapter_num int, section_title string")
    ends = spark.createDataFrame([(1, 2)], "book_id int, body_end int")
    got = structure.trim_back_matter(labels, ends)
    assert listed(got.where("chapter_num IS NULL"), "block_idx") == [(2,), (3,)]


def test_sentence_splitter_overlaps_and_cuts():
    words = lambda t: len(t.split())
    body = " ".join(f"Sentence {i} has five words." for i in range(6))
    pieces = chunking.split_sentences(body, 12, 5, words)
    assert all(words(p) <= 12 for p in pieces) and len(pieces) == 5
    assert pieces[0].endswith("Sentence 1 has five words.") and pieces[1].startswith("Sentence 1 has five words.")
    assert chunking.split_sentences("short", 12, 5) == ["short"] and chunking.split_sentences("  ", 12, 5) == []
    assert [words(p) for p in chunking.split_sentences("w " * 30, 12, 0, words)] == [12, 12, 6]


def pieces_by_definition(body, size, overlap, count):
    """Whole sentences taken in turn; another way to the same pieces, for texts whose sentences fit."""
    sentences = [" ".join(s.split()) for s in chunking.SENTENCE.split(body.strip())]
    cost = lambda a, b: count(" ".join(sentences[a:b])) if b > a else 0
    out, first = [], 0
    while True:
        last = max(e for e in range(first + 1, len(sentences) + 1) if cost(first, e) <= size)
        out.append(" ".join(sentences[first:last]))
        if last == len(sentences):
            return out
        first = min(i for i in range(first + 1, last + 1) if cost(i, last) <= overlap and cost(i, last + 1) <= size)


def test_chunks_hold_as_many_tokens_as_they_may(spark, data):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    count = tokens.from_file(path)
    rows = spark.read.parquet(f"{data}/documents.parquet").where("length(text) > 400").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("text")).limit(60)
    blocks = rows.select(F.col("doc_id").alias("book_id"), F.lit(0).alias("block_idx"), F.lit(1).alias("page"), F.lit("Text").alias("block_type"), "text")
    got = {}
    for r in chunking.chunks(blocks, 80, 16, path).orderBy("book_id", "piece_idx").collect():
        got.setdefault(r.book_id, []).append(r.text)
        assert count(r.text) <= 80
    split = 0
    for r in rows.collect():
        sentences = chunking.SENTENCE.split(r.text.strip())
        if count(r.text.strip()) <= 80:
            assert got[r.doc_id] == [r.text.strip()]
        elif max(count(" " + s) for s in sentences) <= 80:
            assert got[r.doc_id] == pieces_by_definition(r.text, 80, 16, count)
            split += 1
        else:
            assert set(" ".join(got[r.doc_id]).split()) >= set(r.text.split())
    assert split > 3


def test_texts_without_spaces_are_cut_by_characters():
    body = "潮汐" * 500
    pieces = chunking.split_sentences(body, 50, 0)
    assert all(tokens.rough(" " + p) <= 51 for p in pieces) and "".join("".join(pieces).split()) == body


def test_equation_chunks_keep_zones_whole():
    body = "a. " * 150 + "$$x = y$$ where x is what y was. " + "b. " * 300
    for start, end, _ in chunking.chunk_with_equations(body, 400, 40):
        for lo, hi in [(body.index("$$"), body.index("$$x = y$$") + 9)]:
            assert not (start < lo < end < hi) and not (lo < start < hi and end < hi)
    assert chunking.equation_zones("$$a$$ and $$b$$", 3) == [(0, 8), (7, 15)] or len(chunking.equation_zones("$$a$$ and $$b$$", 3)) == 1


def equation_chunks_by_definition(body, size, overlap, around):
    """Chunk ends found by looking at every place."""
    zones = []
    for m in re.finditer(r"\$\$(.+?)\$\$", body, re.S):
        clause = re.search(r"(?is)where\s+.+?(?:\.\s|\n\n|$)", body[m.end() : m.end() + 500])
        zones.append([max(0, m.start() - around), m.end() + clause.end() if clause else min(len(body), m.end() + around)])
    merged = []
    for z in sorted(zones):
        if merged and z[0] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], z[1])
        else:
            merged.append(z)
    out, at = [], 0
    while at < len(body):
        end = min(at + size, len(body))
        for lo, hi in merged:
            if lo <= at < hi or at < lo < end < hi:
                end = max(end, hi)
                break
        limit = end + 50
        for mark in ("\n\n", ". ", ".\n", "? ", "! "):
            places = [i for i in range(at, min(limit, len(body)) - len(mark) + 1) if body.startswith(mark, i) and i > at + size // 2]
            if places:
                end = places[-1] + len(mark)
                break
        if body[at:end].strip():
            out.append((at, end, body[at:end].strip()))
        following = end - overlap
        at = following if out and following > out[-1][0] else end
        if end >= len(body):
            if at < len(body) and body[at:].strip():
                out.append((at, len(body), body[at:].strip()))
            return out
    return out


def test_equation_chunks_match_their_definition(spark):
    rng = random.Random(2)
    parts = ["Some words here. ", "more of them, ", "really? ", "yes! ", "\n\n", "$$a = b$$ ", "$$x$$ where x is long. ", "where nothing. ", "word " * 30, "$$\n\\int f\n$$\n\n"]
    bodies = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(bodies)), "doc_id int, text string")
    got = {}
    for r in chunking.equation_chunks(rows, "text", 200, 30).orderBy("doc_id", "piece_idx").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.chunk))
    for i, body in enumerate(bodies):
        assert got.get(i, []) == equation_chunks_by_definition(body, 200, 30, 300), i


def test_html_blocks_match_an_xml_tree(spark):
    rng = random.Random(6)
    names = {"h1": "SectionHeader", "h3": "SectionHeader", "p": "Text", "div": "Text", "ul": "ListGroup", "ol": "ListGroup", "table": "Table", "figure": "Figure", "blockquote": "Text"}

    def element(depth=0):
        tag = rng.choice(list(names) if not depth else ["b", "i", "span", "li", "p"])
        inner = "".join(rng.choice(["words ", "", " ", element(depth + 1) if depth < 3 else "x"]) for _ in range(rng.randrange(0, 4)))
        return f"<{tag}>{inner}</{tag}>"

    bodies = ["".join(element() for _ in range(rng.randrange(0, 8))) for _ in range(80)]
    pages = spark.createDataFrame([(i, f"<html><head><title>t</title></head><body>{b}</body></html>") for i, b in enumerate(bodies)], "page_id int, html string")
    got = {}
    for r in epub.html_blocks(pages).orderBy("page_id", "block_num").collect():
        got.setdefault(r.page_id, []).append((r.block_type, r.html))
    for i, body in enumerate(bodies):
        want = []
        for e in ElementTree.fromstring(f"<body>{body}</body>"):
            if "".join(e.itertext()).strip() or e.tag in ("figure", "table"):
                e.tail = None
                want.append((names[e.tag], ElementTree.tostring(e, encoding="unicode", short_empty_elements=False)))
        assert got.get(i, []) == want, body


def test_fused_keeps_equations_of_top_books_and_all_without_text(spark):
    hit = "vec_id int, book_id int, score double"
    texts = spark.createDataFrame([(1, 1, 0.9), (2, 2, 0.8), (3, 3, 0.7), (4, 4, 0.6)], hit)
    equations = spark.createDataFrame([(10, 3, 0.95), (11, 4, 0.99)], hit)
    assert [r.vec_id for r in retrieval.fused(texts, equations).collect()] == [10, 1, 2, 3, 4]
    assert [r.vec_id for r in retrieval.fused(texts.where("false"), equations).collect()] == [11, 10]


def test_hierarchical_without_chapters_searches_all(spark):
    rows = spark.createDataFrame([(1, 1, None, [1.0, 0.0]), (2, 1, None, [0.0, 1.0])], "vec_id int, book_id int, chapter_num int, embedding array<double>")
    q = F.array(F.lit(0.0), F.lit(1.0))
    assert [r.vec_id for r in retrieval.hierarchical(rows, rows, q, 1).collect()] == [2]


def test_strict_hierarchical_without_chapters_finds_nothing(spark):
    rows = spark.createDataFrame([(1, 1, None, [1.0, 0.0]), (2, 1, 1, [0.0, 1.0]), (3, 2, 1, [0.0, 1.0])], "vec_id int, book_id int, chapter_num int, embedding array<double>")
    q = F.array(F.lit(1.0), F.lit(0.1))
    found = lambda n, **how: [r.vec_id for r in retrieval.hierarchical(rows, rows, q, chapters=n, **how).collect()]
    assert found(1) == [1, 2, 3] and found(1, strict=True) == []
    assert found(2) == [2, 3] and found(2, strict=True) == [2]


def test_images_of_hits_are_the_best_of_all_their_pages(spark):
    rng = random.Random(1)
    kinds = ("figure", "picture", "table", "unknown", "other", None)
    some = [(rng.randrange(2), f"i{i}", rng.choice(kinds), rng.choice((1, 2, 3, None)), rng.choice((1, 2, 10, None)), rng.choice((1, 2, 3, None)), None, rng.choice(("c", "", None))) for i in range(60)]
    places = [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 9), (5, None, 1), (6, 0, None), (7, 0, 1), (7, 1, 3), (8, 1, 9), (8, 1, 2)]
    images = spark.createDataFrame(some, "book_id int, image_id string, kind string, page int, index int, marker_page int, label string, caption string")
    hits = spark.createDataFrame(places, "hit_id int, book_id int, page int")

    def order(x):
        _, name, kind, page, index, _, _, caption = x
        return (not caption, kinds.index(kind) if kind in kinds[:4] else 9, 10**9 if page is None else page, f"{10**9 if index is None else index}:{name}")

    for limit in (1, 3, 100):
        want = {h: [] for h, _, _ in places}
        for h, book_id, page in places:
            want[h] += [x for x in some if x[0] == book_id and page is not None and page in (x[3], x[5])]
        assert {r.hit_id: r.images for r in retrieval.images_of_hits(hits, images, limit).collect()} == {h: [x[1] for x in sorted(rows, key=order)][:limit] for h, rows in want.items()}


def test_cosine_of_odd_vectors_is_null(spark):
    rows = spark.createDataFrame([([0.0, 0.0],), ([1.0],), (None,), ([3.0, 4.0],)], "v array<double>")
    got = [r.c for r in rows.select(vectors.cosine(F.col("v"), F.array(F.lit(3.0), F.lit(4.0))).alias("c")).collect()]
    assert got[:3] == [None] * 3 and got[3] == pytest.approx(1.0)


def test_result_rows_have_defaults(spark):
    row = retrieval.search_rows(spark.createDataFrame([("t", 0.5)], "text string, score double")).first()
    assert (row.title, row.authors, row.book_id, row.chapter_title) == ("Unknown", "", None, "")


def test_metadata_filter_ignores_empty_but_keeps_book_zero(spark):
    assert filters.metadata(library="", subjects_=[]) is None
    rows = spark.createDataFrame([(0,), (1,)], "book_id int")
    assert listed(filters.where(rows, filters.metadata(book_id=0)), "book_id") == [(0,)]


def test_scores_with_few_terms_and_no_hits(spark):
    q = spark.createDataFrame([(1, ["x"], ["Sea"]), (2, [], [])], "query_id int, expected_terms array<string>, expected_sources array<string>")
    h = spark.createDataFrame([(1, 1, "nothing", "land"), (1, 2, "x", "The Sea")], "query_id int, rank int, text string, title string")
    got = {r.query_id: r for r in metrics.score_queries(q, h, 5).collect()}
    assert (got[1].precision_at_k, got[1].recall, got[1].mrr, got[1].term_coverage) == (0.4, 1.0, 1.0, 1.0)
    assert (got[2].precision_at_k, got[2].recall, got[2].term_coverage) == (0.0, 0.0, 1.0)


def test_patch_refuses_unknown_fields(spark):
    books = spark.createDataFrame([(1, "a")], "id int, title string")
    with pytest.raises(ValueError):
        catalog.patch(books, spark.createDataFrame([(1, "x")], "id int, colour string"))


def test_gaps_only_of_books_that_miss_enough(spark):
    pages = spark.createDataFrame([(1, 1), (1, 9), (2, 1), (2, 3), (3, None)], "book_id int, page int")
    assert listed(audit.page_gaps(pages), "book_id", "gap_start", "gap_end") == [(1, 2, 8)]


def test_ocr_sample_is_fixed(spark):
    rows = [(1, i, 1, "Text", ("good words in a plain sentence here %d" % i) if i % 2 else "@@ ## $$ %% ^^ && ** (( )) !! ~~ ++ == -- %d" % i) for i in range(10)]
    got = audit.ocr_quality(spark.createDataFrame(rows, BLOCK)).first()
    assert (got.checked, got.garbled, got.status) == (10, 5, "red")


def test_garbled_reasons(spark):
    texts = ["", "aaaaaa bbb ccc", "a b c d", "plain words here", "cafÃ© words"]
    got = [r.g for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.garbled_reasons(F.col("t")).alias("g")).collect()]
    assert got == [["empty"], ["runs"], ["short_words"], [], ["mojibake"]]


def test_epub_and_html_blocks():
    meta, rows = epub.read_epub(parser_queries.sample_epub())
    assert meta == {"title": "Sea", "authors": ["Ann Lee", "Bo Kim"], "publisher": "Wiley", "year": 2020}
    assert [r[3] for r in rows] == ["SectionHeader", "Text", "ListGroup", "Text", "Figure", "Table"] and max(r[0] for r in rows) == 2
    assert epub.blocks_of_html("<p>open", 1)[0][3] == "Text"
    with pytest.raises(zipfile.BadZipFile):
        epub.read_epub(b"no zip")


def test_tei_refuses_other_documents():
    with pytest.raises(ValueError):
        tei.Tei("<html/>")
    assert tei.Tei("<listBibl><biblStruct/></listBibl>", full=False).references()[0][0] == "ref-1"


def test_json_documents_under_either_key(spark, tmp_path):
    for name, key in (("7", "blocks"), ("8", "chunks")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "d.json").write_text(json.dumps({key: [{"html": "<p>a</p>", "page": 1, "block_type": "Text"}, {"html": "<img>", "page": 1}, {"text": "b", "page": 2}]}))
    got = block_sources.read_documents(spark, str(tmp_path))
    assert listed(got, "book_id", "raw_idx", "block_idx", "text") == [("7", 0, 0, "a"), ("7", 2, 1, "b"), ("8", 0, 0, "a"), ("8", 2, 1, "b")]


def test_collections_replace_books_and_are_empty_when_absent(spark, tmp_path):
    c = sinks.Collections(spark, str(tmp_path))
    assert c.read("full") is None and c.count("full") == 0
    rows = lambda *x: spark.createDataFrame(list(x), "text string, book_id int")
    c.index("full", rows(("a", 1), ("b", 2)))
    c.index("full", rows(("c", 2)))
    assert listed(c.read("full"), "book_id", "text") == [(1, "a"), (2, "c")]
    changed, matched = sinks.updated(c.read("full"), 1, {"text": "z"})
    assert matched.first().matched == 1 and (1, "z") in listed(changed, "book_id", "text")


def test_a_book_without_rows_loses_what_it_had(spark, tmp_path):
    c = sinks.Collections(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "text string, book_id bigint")
    c.index("equations", rows(("a", 1), ("b", 2), ("c", 3)))
    c.index("equations", rows(("d", 2)), spark.createDataFrame([(1,), (2,)], "book_id bigint"))
    assert listed(c.read("equations"), "book_id", "text") == [(2, "d"), (3, "c")]
    c.remove("equations", spark.createDataFrame([(3,)], "book_id bigint"))
    c.compact("equations")
    assert listed(c.read("equations"), "book_id", "text") == [(2, "d")] and len(c.batches("equations")) == 1
    c.remove("full", spark.createDataFrame([(3,)], "book_id bigint"))
    assert c.read("full") is None


def test_two_writers_cannot_save_the_same_version(spark, tmp_path):
    table = sinks.Versions(spark, str(tmp_path))
    rows = spark.createDataFrame([(1,)], "id int")
    assert table.newest() is None and table.save(rows) == 0 and table.save(rows.unionByName(rows)) == 1
    assert table.read("id int").count() == 2
    table.claim("claims/00000002")
    with pytest.raises(RuntimeError):
        table.save(rows)
    assert table.newest() == 1


def drop_file(folder, name, blocks):
    (folder / name).write_text("".join(json.dumps(b) + "\n" for b in blocks))


def streamed(spark, tmp_path):
    ingest.ingest(ingest.dropped(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    return listed(sinks.Collections(spark, str(tmp_path / "out")).read("full"), "book_id", "block_idx", "text")


def test_streamed_books_are_chunked_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = {"book_id": 5, "raw_idx": 0, "page": 1, "block_type": "Text", "text": "Hello there."}
    drop_file(tmp_path / "in", "a.json", [line])
    drop_file(tmp_path / "in", "b.json", [line])
    assert streamed(spark, tmp_path) == [(5, 0, "Hello there.")]


def test_streamed_books_come_whole(spark, tmp_path):
    (tmp_path / "in").mkdir()
    block = lambda i, text, **more: {"book_id": 1, "raw_idx": i, "page": 1, "block_type": "Text", "text": text, **more}
    drop_file(tmp_path / "in", "a.json", [block(i, f"Block {i}.") for i in range(4)])
    whole = [(1, i, f"Block {i}.") for i in range(4)]
    assert streamed(spark, tmp_path) == whole
    # the same book again with one block changed
    os.utime(tmp_path / "in" / "a.json", (1e9, 1e9))
    drop_file(tmp_path / "in", "b.json", [block(i, "Changed." if i == 2 else f"Block {i}.") for i in range(4)])
    changed = [(1, i, "Changed." if i == 2 else t) for _, i, t in whole]
    assert streamed(spark, tmp_path) == changed
    # a newer version in two parts: nothing changes until the second has come
    later = {"version": 9_000_000_000_000, "n_blocks": 3}
    drop_file(tmp_path / "in", "c.json", [block(0, "New 0.", **later), block(1, "New 1.", **later)])
    assert streamed(spark, tmp_path) == changed
    drop_file(tmp_path / "in", "d.json", [block(2, "New 2.", **later), block(1, "New 1.", **later)])
    assert streamed(spark, tmp_path) == [(1, i, f"New {i}.") for i in range(3)]
    # older content that comes late
    drop_file(tmp_path / "in", "e.json", [block(0, "Old.", version=5, n_blocks=1)])
    assert streamed(spark, tmp_path) == [(1, i, f"New {i}.") for i in range(3)]


def test_queries_in_blocks_find_what_one_block_finds(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(rng.standard_normal((300, 6)).tolist())], "vec_id bigint, embedding array<float>")
    asked = rows.where("vec_id < 40").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    one, many = (retrieval.batch_top_k(rows, asked, 5, most=m) for m in (40, 7))
    assert listed(one, "query_id", "rank", "vec_id") == listed(many, "query_id", "rank", "vec_id") and one.count() == 200


def test_numbers_follow_the_order(spark):
    names = ["b", None, "aaab", "aaaa", "aaaaz", "b", "é", "B"]
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "t string, i int")
    got = [r.t for r in relations.numbered(rows, "t", "i").orderBy("nth").collect()]
    assert got == [None, "B", "aaaa", "aaaaz", "aaab", "b", "b", "é"]
    assert sorted(r.nth for r in relations.numbered(rows, "t", "i").collect()) == list(range(1, 9))


def test_relations_treat_nulls_as_values(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, None), (1, 2, "x"), (1, 3, None)], "k int, at int, v string")
    assert listed(relations.runs(rows, "k", "at", "v"), "start", "n") == [(0, 2), (2, 1), (3, 1)]
    assert [r.w for r in relations.last_known(rows, "k", "at", F.col("v"), "w").orderBy("at").collect()] == [None, None, "x", "x"]
    assert [r.w for r in relations.look_ahead(rows, "k", "at", "at", "w").orderBy("at").collect()] == [1, 2, 3, None]
    seen = relations.as_of(rows, "k", "at", "v", F.col("at") == 2, "w")
    assert [r.w for r in seen.orderBy("at").collect()] == [None, None, "x", "x"]
    books = spark.createDataFrame([(1, "")], "k int, title string")
    assert relations.with_fields(rows, books, "k", title="Unknown").first().title == "Unknown"
    assert relations.counted_tables({"a": rows, "b": None}).collect()[1].n == 0


def test_activity_windows_in_batch(spark):
    events = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 1), "a"), (dt.datetime(2024, 1, 1, 0, 4), "a"), (dt.datetime(2024, 1, 1, 0, 6), "a")], "ts timestamp, event_type string")
    assert [r.n for r in ingest.activity(events).orderBy("start").collect()] == [2, 1]


def test_completions_fall_back_to_nothing(spark):
    def failing():
        def answer(prompt):
            raise {"os": OSError, "key": KeyError}.get(prompt, ValueError)("down")

        return answer

    rows = spark.createDataFrame([("x",), ("os",), ("key",), (None,)], "p string")
    assert [r.a for r in rows.select(remote.complete(F.col("p"), failing, delay=0.01).alias("a")).collect()] == [""] * 4


def test_completions_are_tried_again_after_a_delay(spark):
    def third():
        calls = []

        def answer(prompt):
            calls.append(time.time())
            if len(calls) < 3:
                raise TimeoutError("busy")
            return f"{prompt} {round(calls[2] - calls[0], 1) >= 0.3}"

        return answer

    got = spark.createDataFrame([("x",)], "p string").select(remote.complete(F.col("p"), third, delay=0.1).alias("a")).first()
    assert got.a == "x True"


def test_completers_speak_to_their_servers():
    asked = []

    def send(request):
        asked.append(request)
        answers = {"models": {"data": [{"id": "m1"}]}, "api/generate": {"response": "g"}, "messages": {"content": [{"text": "m"}]}, "chat/completions": {"choices": [{"message": {"content": "c"}}]}}
        return services.Reply(200, json.dumps(answers[request.path]))

    assert services.generate(send, "x")("p") == "g" and asked[-1].json["prompt"] == "p"
    assert services.chat(send, extra={"top": 1})("p") == "c" and asked[-1].json["model"] == "m1" and asked[-1].json["top"] == 1
    assert services.messages(send, "x")("p") == "m"
    empty = lambda r: services.Reply(200, json.dumps({"data": [], "choices": [{"message": {"content": ""}}]}))
    for failing in (services.chat(empty, "m"), services.chat(empty, "auto"), services.generate(lambda r: services.Reply(500, "no"), "m")):
        with pytest.raises((ValueError, OSError)):
            failing("p")


LAYOUT = {"blocks": [{"id": "a", "block_type": "SectionHeader", "html": "<h1>One</h1>", "page": 0}, {"id": "b", "block_type": "Text", "html": "<p>Body</p>", "page": 1}, {"id": "c", "block_type": "Text", "html": "", "page": 1}]}


def layout_service():
    """What makes a transport; nested, so that workers get it whole."""

    def load():
        def send(request):
            if request.name == "down.pdf":
                raise ConnectionError("no route")
            if request.fields["output_format"] == "html":
                body = {"success": request.name != "half.pdf", "error": "no images", "output": "<h1>One</h1>", "images": {"../x/p.png": "aGk="}}
                return services.Reply(200, json.dumps(body))
            replies = {
                "busy.pdf": services.Reply(503, "try later " * 90),
                "text.pdf": services.Reply(200, "<html>queue</html>"),
                "failed.pdf": services.Reply(200, json.dumps({"success": False, "error": "encrypted"})),
                "empty.pdf": services.Reply(200, json.dumps({"success": True})),
                "odd.pdf": services.Reply(200, json.dumps({"success": True, "output": "no json"})),
            }
            good = {"success": True, "output": json.dumps(LAYOUT), "chunks": LAYOUT, "metadata": {"page_stats": [{"page": 0}, {"page": 1}]}}
            return replies.get(request.name, services.Reply(200, json.dumps(good)))

        return send

    return load


def test_layout_replies_are_checked(spark, tmp_path):
    names = ["good.pdf", "down.pdf", "busy.pdf", "text.pdf", "failed.pdf", "empty.pdf", "odd.pdf", "half.pdf"]
    files = spark.createDataFrame([(i, n, bytearray(b"%PDF")) for i, n in enumerate(names)], "book_id bigint, name string, content binary")
    got = {r.book_id: r for r in services.layout_of(files, layout_service()).collect()}
    assert got[0].error is None and got[0].page_count == 2 and got[0].html == "<h1>One</h1>" and got[0].images == {"p.png": bytearray(b"hi")}
    errors = {names[i]: r.error for i, r in got.items() if i}
    assert errors["busy.pdf"].startswith("HTTP 503: try later") and len(errors["busy.pdf"]) == len("HTTP 503: ") + 300
    assert errors == errors | {"down.pdf": "request failed: no route", "text.pdf": "the reply is no JSON object", "failed.pdf": "extraction failed: encrypted", "empty.pdf": "the reply has no 'output'", "odd.pdf": "chunks are no JSON object", "half.pdf": "HTML: extraction failed: no images"}
    remote_ = {r.book_id: r for r in services.layout_of(files, layout_service(), remote=True).collect()}
    assert remote_[0].error is None and remote_[0].html is None and remote_[7].error is None and remote_[5].error == "the reply has no 'chunks'"
    assert listed(services.blocks_of(services.layout_of(files.where("book_id = 0"), layout_service(), html=False)), "block_idx", "block_type", "text") == [(0, "SectionHeader", "One"), (1, "Text", "Body")]

    kept = sinks.Collections(spark, str(tmp_path))
    first = services.layout_of(files.where("book_id = 0"), layout_service())
    assert services.save_extractions(kept, first).count() == 0
    failed = services.layout_of(files.where("book_id = 2").withColumn("book_id", F.lit(0).cast("bigint")), layout_service())
    assert services.save_extractions(kept, failed).first().error.startswith("HTTP 503")
    assert kept.read("extractions").first().html == "<h1>One</h1>"  # a failure destroys nothing


def test_tei_replies_are_checked(spark):
    def load():
        replies = {"none": services.Reply(204), "bad": services.Reply(500, "a  b\n" * 300), "bare": services.Reply(503), "html": services.Reply(200, "<html/>"), "broken": services.Reply(200, "<TEI"), "good": services.Reply(200, parser_queries.TEI)}
        return lambda request: replies[request.name]

    names = ["none", "bad", "bare", "html", "broken", "good"]
    files = spark.createDataFrame([(i, n, bytearray(b"")) for i, n in enumerate(names)], "book_id bigint, name string, content binary")
    got = {names[r.book_id]: r for r in services.fulltext_of(files, load).collect()}
    assert got["bad"].error.startswith("500: a b a b") and got["bad"].error.endswith("…") and len(got["bad"].error) == 506
    assert got["bare"].error == "503: (empty body)" and got["html"].error == got["broken"].error == "the reply is no TEI document"
    assert got["none"].error is None and got["good"].error is None and got["bad"].xml is None
    whole = services.fulltext_of(files, load).where("error IS NULL")
    assert {r.book_id for r in tei.read_tei(whole, "references").collect()} == {5} and tei.read_tei(whole, "sections").count() == 2
    listing = services.references_of(files.where("name = 'none'"), load)
    assert listing.first().error is None and tei.read_tei(listing, "references", full=False).count() == 0


def test_books_by_isbn_ask_the_second_service_for_the_rest(spark):
    def volumes():
        known = {"9781": {"totalItems": 1, "items": [{"volumeInfo": {"title": "G", "authors": ["A"], "publisher": "P"}}]}, "9783": {"totalItems": 0}}
        return lambda r: services.Reply(200, json.dumps(known[r.name])) if r.name in known and r.path.endswith("isbn:" + r.name) else services.Reply(404)

    def editions():
        known = {"ISBN:9782": {"title": "O", "authors": [{"name": "B"}, {}], "publishers": [{"name": "Q"}, {"name": "R"}]}, "ISBN:9781": {"title": "no"}}
        return lambda r: services.Reply(200, json.dumps(known))

    books = spark.createDataFrame([(1, "97-8 1"), (2, "9782"), (3, "9783"), (4, None), (5, "")], "id int, isbn string")
    got = listed(services.books_by_isbn(books, volumes, editions), "id", "title", "authors", "publisher", "isbn", "confidence", "source")
    assert got == [(1, "G", ["A"], "P", "9781", 1.0, "google_books"), (2, "O", ["B", ""], "Q", "9782", 1.0, "openlibrary")]


def test_artifacts_of_books_are_found(spark, tmp_path):
    for name in ("12/raw/marker/document.json", "12/raw/marker/metadata.json", "12/raw/marker/document.md", "12/metadata.json", "12/structure.json", "7/raw/pdftotext/document.txt", "7/raw/pdftotext/pages.json", "7/raw/pdftotext/metadata.json", "7/notes.txt", "9/raw/grobid/fulltext.tei.xml"):
        file = tmp_path / "books" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(json.dumps({"blocks": [{"block_type": "Text", "text": "Body", "page": 1}]}) if name.endswith("document.json") else "# One\n$$x$$")
    found = listed(block_sources.artifacts(spark, str(tmp_path / "books")), "book_id", "kind")
    assert found == [("12", "content"), ("12", "markdown"), ("12", "meta"), ("12", "metadata"), ("12", "structure"), ("7", "pdftext"), ("7", "pdftext_meta"), ("7", "pdftext_pages"), ("9", "fulltext")]
    one = block_sources.artifacts(spark, str(tmp_path / "books"), "pdftext").first()
    assert one.book_id == "7" and one.size_bytes == 11 and one.source_hash.startswith("sha256:")
    with pytest.raises(ValueError):
        block_sources.artifacts(spark, str(tmp_path), "cover")
    assert listed(block_sources.read_documents(spark, str(tmp_path / "books" / "12" / "raw")), "book_id", "text") == [("12", "Body")]
    assert listed(block_sources.read_markdown(spark, str(tmp_path / "books")), "book_id", "raw", "text") == [("12", "# One\n$$x$$", "# One\n$$x$$\n[Mathematical equation: x]")]


def test_uploads_take_books_only(spark, tmp_path):
    for name, body in (("The_Sea.PDF", b"x"), ("b.epub", b"y"), ("c.txt", b"z")):
        (tmp_path / name).write_bytes(body)
    got = {r.title: r for r in block_sources.uploads(spark, str(tmp_path)).collect()}
    assert got["The Sea"].format == "pdf" and got["The Sea"].refused is None and got["b"].format == "epub" and got["b"].source_hash.startswith("sha256:")
    assert got["c"].refused and got["c"].format is None
    stream = block_sources.uploads(spark, str(tmp_path), stream=True)
    assert stream.isStreaming and set(stream.columns) == set(block_sources.uploads(spark, str(tmp_path)).columns)


def test_metadata_of_a_book_is_kept_once(spark, tmp_path):
    kept = sinks.Collections(spark, str(tmp_path))
    assert services.load_metadata(kept).count() == 0
    row = lambda title: spark.createDataFrame([(1, title, ["A"])], "book_id bigint, title string, authors array<string>")
    services.save_metadata(kept, row("old"))
    services.save_metadata(kept, row("new"))
    assert [r.title for r in services.load_metadata(kept).collect()] == ["new"]


def test_pages_of_rows_follow_each_other(spark):
    rows, seen, after = spark.range(25).withColumnRenamed("id", "k"), [], None
    while page := [r.k for r in navigate.page_of_rows(rows, "k", after, 10).collect()]:
        seen += page
        after = page[-1]
    assert seen == list(range(25))


def test_vocabulary_embedder_counts():
    assert np.array_equal(remote.vocabulary_embedder(["sea"])(["Sea sea", ""]), [[2], [0]])


def test_settings_order(tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"chunk_tokens": 100, "library_path": "x"}')
    got = conf.load(str(path), {"LECTERN_CHUNK_TOKENS": "50"})
    assert (got.chunk_tokens, got.library_path, got.chunk_overlap) == (50, "x", 64)
    (tmp_path / f"{path.stem}.local.json").write_text('{"library_path": "mine"}')
    assert conf.load(str(path), {}).library_path == "mine" and conf.load(str(path), {"LECTERN_LIBRARY_PATH": "env"}).library_path == "env"
    path.write_text('{"nope": 1}')
    with pytest.raises(ValueError):
        conf.load(str(path), {})


def test_summary_nodes(spark):
    rows = [(1, 0, 1, "SectionHeader", "Chapter 1: A"), (1, 1, 1, "Text", "body"), (2, 0, 1, "SectionHeader", "Intro"), (2, 1, 1, "Text", "y" * 1600)]
    blocks = spark.createDataFrame(rows, BLOCK)
    got = chunking.summaries(blocks, structure.block_labels(blocks), structure.chapters(blocks))
    assert listed(got, "book_id", "level") == [(1, "book"), (1, "chapter"), (2, "book"), (2, "section")]


def test_registry_works_without_the_optional_subpackage():
    code = "import sys; sys.modules['lectern.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_bare_subjects_go_where_a_child_matched(spark):
    rows = [("dbt for a therapist",), ("a therapist",), ("tcp and an algorithm",), ("nothing",)]
    got = [r.s for r in spark.createDataFrame(rows, "t string").select(text.keyword_subjects(F.col("t")).alias("s")).collect()]
    assert got == [["therapy/dbt"], ["therapy"], ["cs/networking"], []]
