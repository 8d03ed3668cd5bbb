"""Text functions on columns.

Python's ``\\s`` and ``\\w`` are Unicode classes, Java's are not: patterns that
must agree with the former carry ``(?U)``.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed

SPACES = r"(?U)\s+"


def strip(c: Column) -> Column:
    """White space off both ends, of any kind (``trim`` takes spaces alone)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def _chain(c: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def html_to_text(c: Column, mode: str = "flat") -> Column:
    """Text of an HTML column; null gives ''.  Entities stay, script bodies stay.

    ``strip`` only drops tags, ``flat`` squeezes white space, ``lines`` keeps
    line ends, ``structured`` turns breaks, paragraphs and items into lines.
    """
    c = F.coalesce(c, F.lit(""))
    if mode == "structured":
        lines = _chain(c, (r"<img[^>]*>", ""), (r"<br\s*/?>", "\n"), (r"<p[^>]*>", ""), ("</p>", "\n\n"), (r"<li[^>]*>", "  - "), ("</li>", "\n"), (r"<[^>]+>", ""))
        return strip(F.regexp_replace(lines, r"\n{3,}", "\n\n"))
    bare = F.regexp_replace(c, r"<[^>]+>", "")
    if mode == "strip":
        return strip(bare)
    if mode == "lines":
        return strip(_chain(bare, (r"(?U)[^\S\n]+", " "), (r"(?U)\n\s*\n", "\n")))
    if mode == "flat":
        return strip(F.regexp_replace(bare, SPACES, " "))
    raise ValueError(f"no such mode: {mode}")


def clean_heading(c: Column) -> Column:
    """A heading without ``#``, ``*`` and runs of white space."""
    return strip(_chain(c, (r"^#+\s*", ""), (r"\*{1,2}", ""), (SPACES, " ")))


def same_text(a: Column, b: Column) -> Column:
    """Equal letters and digits, whatever else."""
    only = lambda c: F.regexp_replace(F.lower(c), r"(?U)\W+", "")
    return only(a) == only(b)


def group_or_null(c: Column, pattern: str, group: int = 1) -> Column:
    """First match's group; null where nothing matches."""
    return F.when(F.regexp_count(c, F.lit(pattern)) > 0, F.regexp_extract(c, pattern, group))


def first_page(c: Column) -> Column:
    """Page number of the first marker; all ``page-N`` come before all ``_page_N_``."""
    return F.coalesce(*(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in fixed.PAGE_MARKERS)).cast("int")


def chapter_heading(c: Column) -> Column:
    """``struct(number, title)`` by the first pattern of the grammar that matches, else null."""
    bare = strip(F.regexp_replace(c, r"\*{1,2}", ""))
    cases = [F.when(bare.rlike("(?iU)" + p), F.struct(F.regexp_extract(bare, "(?iU)" + p, 1).cast("int").alias("number"), strip(F.regexp_extract(bare, "(?iU)" + p, 2)).alias("title"))) for p in fixed.CHAPTER_HEADINGS]
    return F.coalesce(*cases)


def sample_text(c: Column, size: int) -> Column:
    """Beginning, middle and end of a long text, a third of ``size`` each; a short text whole."""
    third = size // 3
    n = F.length(c)
    middle = F.expr("1") * (F.floor(n / 2) - third // 2 + 1)
    parts = F.concat_ws("\n\n[...]\n\n", F.substring(c, 1, third), F.substring(c, middle.cast("int"), F.lit(third)), F.right(c, F.lit(third)))
    return F.when(n <= size, c).otherwise(parts)


def any_of(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def keyword_subjects(c: Column) -> Column:
    """Subjects whose keywords the text holds; a bare parent goes where a child of it matched."""
    low = F.lower(c)
    below = lambda name: [w for n, words in fixed.SUBJECT_KEYWORDS if n.startswith(name + "/") for w in words]
    hit = lambda name, words: any_of(low, words) & ~any_of(low, below(name)) if below(name) else any_of(low, words)
    return F.array_compact(F.array(*(F.when(hit(name, words), F.lit(name)) for name, words in fixed.SUBJECT_KEYWORDS)))


def keyword_library(c: Column) -> Column:
    low = F.lower(c)
    return F.coalesce(*(F.when(any_of(low, words), F.lit(name)) for name, words in fixed.LIBRARY_KEYWORDS))


def with_keyword_tags(rows: DataFrame, column: str) -> DataFrame:
    """Rows with ``subjects`` and ``library`` as the two functions above give them.

    In steps that Catalyst keeps apart because later ones use them often: the
    text is lower-cased once and every list of words is looked for once, a
    parent's children by what was found for them.
    """
    lists = {**{f"_s{i}": words for i, (_, words) in enumerate(fixed.SUBJECT_KEYWORDS)}, **{f"_l{i}": words for i, (_, words) in enumerate(fixed.LIBRARY_KEYWORDS)}}
    found = rows.withColumn("_low", F.lower(column)).withColumns({name: any_of(F.col("_low"), words) for name, words in lists.items()})
    names = [name for name, _ in fixed.SUBJECT_KEYWORDS]

    def hit(i: int) -> Column:
        below = [F.col(f"_s{j}") for j, name in enumerate(names) if name.startswith(names[i] + "/")]
        return F.col(f"_s{i}") & ~reduce(lambda a, b: a | b, below) if below else F.col(f"_s{i}")

    subjects = F.array_compact(F.array(*(F.when(hit(i), F.lit(name)) for i, name in enumerate(names))))
    library = F.coalesce(*(F.when(F.col(f"_l{i}"), F.lit(name)) for i, (name, _) in enumerate(fixed.LIBRARY_KEYWORDS)))
    return found.withColumns({"subjects": subjects, "library": library}).drop("_low", *lists)


def normal_author(c: Column) -> Column:
    """``Last, First`` and ``F. M. Last`` in one form: lower case, no dots, single spaces."""
    low = strip(F.regexp_replace(F.lower(c), SPACES, " "))
    parts = F.split(low, ", ", -1)
    turned = F.when(F.size(parts) == 2, F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))).otherwise(low)
    return strip(F.regexp_replace(F.regexp_replace(turned, r"\.", " "), SPACES, " "))


def same_authors(a: Column, b: Column) -> Column:
    """Author lists equal as sets of normal names; two empty ones are equal, one alone is not."""
    names = lambda c: F.array_sort(F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), normal_author)))
    return names(a) == names(b)


def garbled_reasons(c: Column) -> Column:
    """What is odd about a text: ``empty``, ``short_words``, ``symbols``, ``runs``, ``mojibake``."""
    words = F.filter(F.split(c, SPACES), lambda w: w != "")
    letters = F.length(F.regexp_replace(c, r"(?U)\s+", ""))
    plain = F.length(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}\s]", ""))
    checks = F.array_compact(
        F.array(
            F.when(letters / F.size(words) < 2.5, F.lit("short_words")),
            F.when(plain / F.length(c) < 0.6, F.lit("symbols")),
            F.when(c.rlike(r"(.)\1{4,}"), F.lit("runs")),
            F.when(any_of(c, fixed.MOJIBAKE), F.lit("mojibake")),
        )
    )
    return F.when(F.size(words) == 0, F.array(F.lit("empty"))).otherwise(checks)


def equation_parts(html: Column) -> Column:
    """``struct(latex, number)`` of an equation block, null without a math element or LaTeX.

    The number is a ``\\tag{N}``, else ``(N)`` that ends the math, else ``(N)``
    after it.
    """
    math = F.when(html.rlike(fixed.MATH), strip(F.regexp_extract(html, fixed.MATH, 1)))
    after = F.regexp_extract(html, fixed.AFTER_MATH, 1)
    tag, ending, outside = fixed.EQUATION_TAG, fixed.EQUATION_NUMBER + r"\s*$", fixed.EQUATION_NUMBER
    number = F.coalesce(group_or_null(math, tag), group_or_null(math, ending), group_or_null(after, outside))
    latex = F.when(math.rlike(tag), F.regexp_extract(math, r"(?s)^(.*?)\\tag\{", 1)).when(math.rlike(ending), F.regexp_replace(math, ending, "")).otherwise(math)
    latex = _chain(strip(latex), (r",+$", ""), (r"\.+$", ""), (r"\s+$", ""))
    return F.when(latex != "", F.struct(latex.alias("latex"), number.alias("number")))


def equation_tags(latex: Column, around: Column) -> Column:
    low = F.lower(F.concat_ws(" ", latex, around))
    by_syntax = [F.when(any_of(latex, marks), F.lit(tag)) for tag, marks in fixed.EQUATION_SYNTAX]
    by_domain = [F.when(any_of(low, words), F.lit(tag)) for tag, words in fixed.EQUATION_DOMAINS]
    return F.array_compact(F.array(*by_syntax, *by_domain))


def clean_code(c: Column) -> Column:
    """Code without the line numbers of its print.

    Numbers on lines of their own go if there are 3 or more, over 15% of the
    lines, that rise by less than 5 on average; blank lines that then meet
    become one.  Else numbers before code go, for 2 or more over 10%.
    """
    lines = F.split(c, "\n", -1)
    rising = lambda nums, least, share: (F.size(nums) >= least) & (F.size(nums) > F.size(lines) * share) & (F.try_element_at(nums, F.lit(-1)) > F.try_element_at(nums, F.lit(1))) & ((F.try_element_at(nums, F.lit(-1)) - F.try_element_at(nums, F.lit(1))) / (F.size(nums) - 1) < 5)
    alone = lambda x: x.rlike(r"^\s*\d{1,4}\s*$")
    before = lambda x: x.rlike(r"^\d{1,4} \S")
    own = F.transform(F.filter(lines, alone), lambda x: strip(x).cast("int"))
    inline = F.transform(F.filter(lines, before), lambda x: F.regexp_extract(x, r"^(\d{1,4}) ", 1).cast("int"))
    rest = F.array_join(F.filter(lines, lambda x: ~alone(x)), "\n")
    squeezed = F.regexp_replace(rest, r"(?m)^([ \t]*\n)(?:[ \t]*\n)+", "$1")
    return F.when(rising(own, 3, 0.15), squeezed).when(rising(inline, 2, 0.1), F.regexp_replace(c, r"(?m)^\d{1,4} (?=\S)", "")).otherwise(c)


def snippet(text: Column, needle: str, around: int = 50) -> Column:
    """The first place of ``needle``, with its surroundings; null where it isn't."""
    at = F.instr(F.lower(text), needle.lower())
    start = F.greatest(at - 1 - around, F.lit(0))
    end = F.least(F.length(text), at - 1 + len(needle) + around)
    cut = F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))
    out = F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(end < F.length(text), "...").otherwise(""))
    return F.when(at > 0, F.regexp_replace(out, "\n", " "))


def content_hash(c: Column, digits: int = 12) -> Column:
    """``sha256:`` and the first digits of the hash."""
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(c.cast("binary"), 256), 1, digits))


def int_or_null(c: Column) -> Column:
    """A number, or null for all spellings of a missing one."""
    bare = strip(c.cast("string"))
    return F.when(~bare.isin("", "null"), bare.try_cast("int"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def breadcrumb(number: Column, title: Column, section: Column) -> Column:
    """``Chapter N: Title > Section`` of the parts there are."""
    chapter = F.when(number.isNotNull(), F.concat(F.lit("Chapter "), number.cast("string"), F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(": "), title)).otherwise("")))
    return F.concat_ws(" > ", chapter, F.nullif(section, F.lit("")))


def display_equations(c: Column) -> Column:
    """LaTeX between double dollar signs, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?s)\$\$(.+?)\$\$"), F.lit(1)), strip)


def author_year_citations(c: Column) -> Column:
    """``(Name, 2020)`` and ``Name (2020)``."""
    inside = F.regexp_extract_all(c, F.lit(fixed.AUTHOR_YEAR_INSIDE), F.lit(0))
    return F.concat(inside, F.regexp_extract_all(c, F.lit(fixed.AUTHOR_YEAR_OUTSIDE), F.lit(0)))
