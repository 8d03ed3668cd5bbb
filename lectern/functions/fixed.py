"""Word lists, patterns and limits that results depend on."""

# fmt: off
# Chapter heading grammar, in order; each has a number and a title group.
CHAPTER_HEADINGS = (
    r"^Chapter\s+(\d+)\s*[:\-–]?\s*(.*)$",
    r"^Rule\s+No\.?\s*(\d+)\s*[:\-–]?\s*(.*)$",
    r"^Part\s+(\d+)\s*[:\-–]?\s*(.*)$",
    r"^Cycle\s+(\d+)\s*[:\-–]?\s*(.*)$",
    r"^Lesson\s+(\d+)\s*[:\-–]?\s*(.*)$",
    r"^(\d{1,2})\.\s+(.+)$",
)
# Headings that are no sections, and headings that begin back matter.
SKIPPED_SECTIONS = ("chapter summary", "notes", "references", "bibliography")
BACK_MATTER = r"^\s*(index|about the authors?|colophon|(wiley\s+)?end[- ]user license agreement)\s*$"
# Phrases that mark an introduction, not a chapter's title.
NOT_A_TITLE = ("this chapter", "in this chapter", "chapter reviews")
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
# Where the table of contents may be, in headings and in blocks.
TOC_FIRST, TOC_LAST, TOC_BLOCKS = 4, 10, 100

# Keywords of subjects, in order.
SUBJECT_KEYWORDS = (
    ("therapy/dbt", ("dialectical behavior", "dbt", "linehan", "distress tolerance", "emotion regulation")),
    ("therapy/cbt", ("cognitive behavioral", "cognitive behaviour", "cbt", "automatic thoughts", "thought record")),
    ("therapy/act", ("acceptance and commitment", "act ", "psychological flexibility", "defusion", "russ harris")),
    ("therapy/ifs", ("internal family systems", "ifs", "parts work", "self-energy", "richard schwartz")),
    ("therapy/existential", ("existential", "logotherapy", "meaning-centered", "irvin yalom")),
    ("therapy", ("psychotherapy", "therapeutic", "clinician", "therapist", "mental health")),
    ("biology", ("biology", "evolution", "ecology", "species", "organism")),
    ("biology/neuroscience", ("neuroscience", "brain", "neural", "cortex", "synapse")),
    ("biology/bioacoustics", ("bioacoustics", "animal communication", "vocalization", "call structure")),
    ("cs", ("algorithm", "data structure", "computer science", "programming")),
    ("cs/networking", ("networking", "tcp", "protocol", "routing", "packet")),
    ("cs/ml", ("machine learning", "deep learning", "neural network", "training data")),
    ("cs/crypto", ("cryptography", "bitcoin", "blockchain", "distributed ledger")),
)
# Keywords of libraries; the first that matches is taken.
LIBRARY_KEYWORDS = (
    ("therapy-core", ("therapy", "therapeutic", "psychotherapy", "clinician", "mental health", "dbt", "cbt", "act ", "ifs", "counseling")),
    ("biology", ("biology", "ecology", "evolution", "species", "organism", "bioacoustics")),
    ("cs", ("computer", "programming", "algorithm", "software", "networking")),
)

# Tags of equations by what their LaTeX holds (any of), in order, and by words around them.
EQUATION_SYNTAX = (
    ("differential", (r"\frac{d", r"\dot", r"\ddot")), ("equality", ("=",)), ("integral", (r"\int",)), ("summation", (r"\sum",)),
    ("partial-differential", (r"\partial",)), ("transcendental", (r"\sin", r"\cos", r"\tan", r"\exp", r"\log")),
    ("vector", (r"\vec", r"\mathbf")), ("matrix", (r"\matrix", r"\begin{pmatrix}")),
)
EQUATION_DOMAINS = (
    ("physics", ("force", "mass", "energy", "momentum", "pressure", "velocity")),
    ("biology", ("population", "growth", "decay", "species", "cell")),
    ("acoustics", ("sound", "frequency", "oscillat", "vibrat", "resonan")),
    ("neuroscience", ("neuron", "synap", "firing", "membrane", "potential")),
    ("economics", ("price", "demand", "supply", "utility", "equilibrium")),
    ("statistics", ("probability", "distribution", "variance", "mean", "expect")),
)

# Traces of a wrong decoding.
MOJIBAKE = ("â€™", 'â€"', "â€œ", "Ã©", "Ã¡", "ï¬", "\ufffd")
# Parts that a book is expected to have, as patterns.
LANDMARKS = (
    ("table_of_contents", "table of contents|contents"), ("bibliography", "bibliography|references cited|works cited"), ("index", r"\bindex\b"),
    ("appendix", "appendix"), ("glossary", "glossary"), ("preface", "preface|foreword"), ("introduction", "introduction"),
)
# Headings of bibliographies, publishers that citations name, publishers on copyright pages.
BIBLIOGRAPHY_WORDS = ("bibliography", "references", "further reading", "works cited", "citations")
CITED_PUBLISHERS = (
    "Springer", "Wiley", "Elsevier", "Academic Press", "Cambridge University Press", "Oxford University Press", "MIT Press", "McGraw-Hill",
    "Pearson", "CRC Press", "IEEE", "ACM", "SIAM", "Addison-Wesley", "Morgan Kaufmann", "O'Reilly",
)
COPYRIGHT_PUBLISHERS = (
    "Prentice Hall", "O'Reilly", "Springer", "Wiley", "McGraw-Hill", "Cambridge University Press", "Oxford University Press", "MIT Press",
    "Academic Press", "Addison-Wesley", "Morgan Kaufmann", "CRC Press",
)
AFFILIATIONS = ("department", "university", "institute", "college", "school")
# Patterns of copyright pages: a year after the mark, an ISBN, a publisher that is named.
COPYRIGHT_YEAR = r"(?:©|copyright)[^0-9]*(\d{4})"
COPYRIGHT_ISBN = r"ISBN[-:\s]*(\d[\d-]{9,}[\dXx])"
NAMED_PUBLISHER = r"(?i)(?:published by|publisher[:\s]+)([^,\n]+)"
# Headings that are no titles; names in text, on a line of their own, and as a catalog has them.
NO_TITLE = (r"^\d+\.?\s", r"(?i)^(Chapter|Section|Part)\s+\d")
AUTHOR_AFTER_BY = r"\bby\s+([A-Z][a-z]+(?:\s+[A-Z]\.?\s*)?[A-Z][a-z]+)"
AUTHOR_LINE = r"^[A-Z]\.?\s*[A-Z]?\.?\s*[A-Z][a-z]+$"
AUTHOR_ENTRY = r"^([A-Z][a-z]+),\s+([A-Z]\.?\s*[A-Z]?\.?)$"
LIKE_A_FILE = r"_|\.pdf$|\.epub$"
# Citations by number, by author and year in and outside parentheses, and ISBNs in text.
NUMBERED_CITATION = r"\[(\d{1,3})\]"
AUTHOR_YEAR_INSIDE = r"\([A-Z][a-z]+(?:\s+(?:and|&)\s+[A-Z][a-z]+)?,\s*\d{4}\)"
AUTHOR_YEAR_OUTSIDE = r"[A-Z][a-z]+\s+\(\d{4}\)"
CITED_ISBN = r"(?i)ISBN[-:\s]*([\d-]{10,17})"
# Page markers, in order; math elements and the numbers of their equations.
PAGE_MARKERS = (r"page-(\d+)", r"_page_(\d+)_")
MATH = r"(?s)<math[^>]*>(.*?)</math>"
AFTER_MATH = r"(?s)<math[^>]*>.*?</math>(.*)$"
EQUATION_TAG = r"\\tag\{([^}]+)\}"
EQUATION_NUMBER = r"\(([0-9]+[a-z]?(?:\.[0-9]+)*)\)"
# Extraction limits that choose a backend.
IMAGE_MEGAPIXELS, PAGE_MEGAPIXELS = 900.0, 6.0
# Sizes of chunks, spans and results.
CHUNK_TOKENS, CHUNK_OVERLAP = 320, 64
SPAN_CHARS, SPAN_MOST = 12_000, 50_000
# fmt: on
