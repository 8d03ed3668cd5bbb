"""A library from registration to search."""

from lectern.library import Library
from lectern.sources.remote import vocabulary_embedder

WORDS = ["tide", "wave", "interest", "fund"]


def book(book_id, topic):
    rows = [(book_id, 0, 1, "SectionHeader", f"Chapter 1: {topic}"), (book_id, 1, 1, "Text", f"All about the {topic}. " * 3), (book_id, 2, 2, "SectionHeader", "Details"), (book_id, 3, 2, "Text", f"The {topic} again, 100% sure.")]
    return [(*r, None) for r in rows] + [(book_id, 4, 2, "Equation", "", f"<math>{topic} = 2</math>")]


def test_library_end_to_end(spark, tmp_path):
    words = list(WORDS)
    lib = Library(spark, str(tmp_path), lambda: vocabulary_embedder(words))
    assert lib.books().count() == 0 and lib.search("tide").count() == 0 and lib.profile().count() == 0
    incoming = spark.createDataFrame([("Sea", "/sea.pdf", ["Ann Lee"], "science", ["sea/tides"]), ("Money", "/money.pdf", ["Bo Kim"], "finance", ["money"])], "title string, source_path string, authors array<string>, library string, subjects array<string>")
    lib.register(incoming)
    again = lib.register(incoming).collect()
    assert {r.title: (r.id, r.already_exists) for r in again} == {"Money": (1, True), "Sea": (2, True)} and lib.books().count() == 2

    blocks = spark.createDataFrame(book(1, "fund") + book(2, "tide"), "book_id bigint, block_idx int, page int, block_type string, text string, html string")
    coverage = lib.index(blocks).collect()
    assert len(coverage) == 2 and not any(r.poorly_labelled for r in coverage)
    assert {r.status for r in lib.books().collect()} == {"indexed"}
    lib.index(blocks)
    assert lib.collections.count("full") == sum(r.chunks for r in coverage)

    top = lib.search("tide", 2).collect()
    assert {r.book_id for r in top} == {2} and top[0].title == "Sea" and top[0].authors == "Ann Lee"
    assert {r.book_id for r in lib.search("tide", 5, equations=0, library="finance").collect()} <= {1}
    assert [r.book_id for r in lib.text_search("100% SURE", 5).collect()] == [1, 2]
    assert {r.chapter_num for r in lib.search_hierarchical("fund", 3).collect()} == {1}
    assert lib.search_chapters("fund", 1).first().book_id == 1
    assert lib.read_span(2, section="Details").first().text == "Details\n\nThe tide again, 100% sure."
    assert lib.read_span(2, chapter=1, max_chars=1).first().next_cursor == "block:1"
    assert lib.spans().count() == 2 and lib.verify().count() == 2

    lib.update(spark.createDataFrame([(2, "Oceans", None)], "id bigint, title string, library string"))
    assert lib.search("tide", 1).first().title == "Oceans"
    lib.delete([2])
    assert lib.collections.read("full").where("book_id = 2").count() == 0 and lib.spans().where("book_id = 2").count() == 0
    assert lib.books().count() == 1 and {r.book_id for r in lib.search("tide", 5, equations=0).collect()} <= {1}
    assert {r.library: r.indexed for r in lib.profile().collect()} == {"finance": 1}


def test_deleted_ids_are_not_given_again(spark, tmp_path):
    lib = Library(spark, str(tmp_path), lambda: vocabulary_embedder(WORDS))
    add = lambda *titles: lib.register(spark.createDataFrame([(t, f"/{t}.pdf") for t in titles], "title string, source_path string"))
    assert [r.id for r in add("Money", "Sea").orderBy("id").collect()] == [1, 2]
    lib.index(spark.createDataFrame(book(1, "fund") + book(2, "tide"), "book_id bigint, block_idx int, page int, block_type string, text string, html string"))
    lib.delete([2])
    assert {r.book_id for r in lib.text_search("tide").collect()} == set()
    assert [(r.id, r.already_exists) for r in add("Brand new").collect()] == [(3, False)]
    assert {r.book_id for r in lib.text_search("tide").collect()} == set() and lib.books().count() == 2
    again = {r.title: r.id for r in add("sea", "Sea", "MONEY").collect()}
    assert again == {"sea": 4, "Sea": 4, "MONEY": 1}


def test_a_book_indexed_again_loses_what_it_no_longer_has(spark, tmp_path):
    lib = Library(spark, str(tmp_path), lambda: vocabulary_embedder(WORDS))
    lib.register(spark.createDataFrame([("Money", "/m.pdf")], "title string, source_path string"))
    schema = "book_id bigint, block_idx int, page int, block_type string, text string, html string"
    lib.index(spark.createDataFrame(book(1, "fund"), schema))
    assert lib.collections.count("equations") == 1
    lib.index(spark.createDataFrame(book(1, "fund")[:2], schema))
    assert lib.collections.count("equations") == 0 and lib.collections.count("full") == 2


def test_an_empty_library_answers_with_no_rows(spark, tmp_path):
    lib = Library(spark, str(tmp_path), lambda: vocabulary_embedder(WORDS))
    for rows in (lib.search("tide"), lib.search_chapters("tide"), lib.search_hierarchical("tide"), lib.text_search("tide"), lib.verify(), lib.blocks(), lib.labels(), lib.spans(), lib.profile(), lib.read_span(1)):
        assert rows.count() == 0


def test_a_library_is_opened_again(spark, tmp_path):
    open_ = lambda: Library(spark, str(tmp_path), lambda: vocabulary_embedder(WORDS))
    rows = lambda *titles: spark.createDataFrame([(t, f"/{t}.pdf") for t in titles], "title string, source_path string")
    open_().register(rows("Money", "Sea"))
    lib = open_()
    assert [r.id for r in lib.register(rows("Land")).collect()] == [3]  # numbers go on where they were
    schema = "book_id bigint, block_idx int, page int, block_type string, text string, html string"
    lib.index(spark.createDataFrame(book(2, "tide"), schema))
    chapters = open_().collections.read("chapters_of_books")
    assert [(r.book_id, r.number, r.title) for r in chapters.collect()] == [(2, 1, "tide")] and open_().labels().where("book_id = 2").count() == 5
    # approved subjects reach the catalog and the chunks
    lib.update(spark.createDataFrame([(2, ["sea/tides", "sea"])], "id bigint, subjects array<string>"))
    assert open_().books().where("id = 2").first().subjects == ["sea/tides", "sea"]
    assert {tuple(r.subjects) for r in open_().collections.read("full").collect()} == {("sea/tides", "sea")}
    assert [r.book_id for r in open_().search("tide", 1, equations=0, subjects_=["sea/*"]).collect()] == [2]
