"""Main text of web pages by scoring the containers of paragraphs.

A page is read into a light tree.  Each paragraph earns points for its length
and its commas and passes them to its ancestors, full to the parent and less
with every step up, discounted by the share of its text in links.  The best
container wins, with those of its siblings that look alike, and its blocks
are printed in page order.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.workers import map_batches

# Elements by what the HTML standard makes of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html caption dd dt legend li summary tbody td tfoot th thead tr".split())
HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
#: End tags don't reach past these, those of table parts not past a table.
SCOPE = frozenset("caption html object table td th".split())
TABLE_PARTS = frozenset("caption table tbody td tfoot th thead tr".split())
#: What an opening tag ends, up to the nearest of the second set.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
}
#: Elements that never hold article text.
DROPPED = frozenset("nav aside footer form button dialog menu search fieldset label input select svg head".split())
#: Elements whose class or id may say that they surround an article; of others only what is none of it in any element.
CONTAINERS = frozenset("div section article ul ol dl table center details figure header span a".split())
ADVERT = frozenset("ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsored".split())
NEVER = ADVERT | frozenset("promo promotion cookie cookies consent gdpr notice notices newsletter comment comments breadcrumb breadcrumbs pagination hidden".split())
CHROME = NEVER | frozenset(
    "banner popup popover modal overlay subscribe subscription paywall sidebar side aside nav navbar navigation menu masthead foot footer replies disqus respond share sharing social related recommended recommendation recommendations teaser teasers pager tags tagcloud toolbar widget widgets search login signin signup copyright skip".split()
)
#: The last word of a name counts, without those that only say what kind of box it is.
BOX = frozenset("area articles bar box block buttons container content form group holder icons inner items link links list panel posts region row section slot stories thread tools unit widget wrap wrapper zone".split())
#: With one of these in front, a name says that something else has such a part.
HAVING = frozenset("has have with no not without is".split())
HEADER = frozenset(["header"])
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

INLINE_BREAK = frozenset(["br", "hr", "wbr"])
MARKUP = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
#: A quoted value without its end is read as an unquoted one, so that it can't swallow the page.
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
TAG_END = re.compile(r"[\s/]*>")
COMMENT_END = re.compile(r"--!?>")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
SPACE = re.compile(r"\s+")
#: A paragraph under so many characters earns nothing by its length.
SHORT = 25
COMMAS = ",，、،;"


class Node:
    __slots__ = ("commas", "dropped", "kids", "linked", "parent", "score", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.kids: list[Node | str] = []
        self.score, self.size, self.linked, self.commas = 0.0, 0, 0, 0


def _names(value: str) -> Iterator[str]:
    """What each name of a class or id is about: its last word that says more than the kind of box."""
    for name in value.split():
        words = [w.lower() for w in WORDS.findall(name)]
        if not words or words[0] in HAVING:
            continue
        while len(words) > 1 and (words[-1] in BOX or words[-1].isdigit()):
            words.pop()
        yield words[-1]


def _chrome(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Does an element surround the article, by its tag, class, id or role?"""
    if tag in DROPPED:
        return True
    if tag == "header" and not in_article:  # an article's own header has its title
        return True
    if not attributes or tag in ("body", "html", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in ROLES and tag in CONTAINERS:
        return True
    about = {*_names(attributes.get("class", "")), *_names(attributes.get("id", ""))}
    if tag not in CONTAINERS:
        return bool(about & NEVER)
    return bool(about & (CHROME if in_article else CHROME | HEADER))


class _Tree:
    """Open elements, and where those of each tag are, so that no tag has to look for its own."""

    def __init__(self):
        self.root = Node("#root", None)
        self.open = [self.root]
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks, self.scopes = [0], [0]

    @property
    def now(self) -> Node:
        return self.open[-1]

    def last(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=0)

    def push(self, tag: str, attributes: dict[str, str]) -> None:
        fresh = Node(tag, self.now, _chrome(tag, attributes, bool(self.at["article"] or self.at["main"])))
        self.now.kids.append(fresh)
        if tag in VOID:
            return
        place = len(self.open)
        self.open.append(fresh)
        self.at[tag].append(place)
        if tag in BLOCK:
            self.blocks.append(place)
        if tag in SCOPE:
            self.scopes.append(place)

    def close(self, place: int) -> None:
        """End the element at ``place`` and all within it."""
        while len(self.open) > place:
            tag = self.open.pop().tag
            self.at[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            if tag in SCOPE:
                self.scopes.pop()

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if self.at["head"] and tag not in HEAD:
            self.close(self.last("head"))
        if tag in CLOSES_P and self.last("p") > self.scopes[-1]:
            self.close(self.last("p"))
        if tag in ENDS:
            ended, limit = ENDS[tag]
            least = self.last(*limit)
            inside = [self.at[t][-1] for t in ended if self.at[t] and self.at[t][-1] > least]
            if inside:
                self.close(min(inside))
        self.push(tag, attributes)

    def end(self, tag: str) -> None:
        place = self.last(tag)
        if not place:
            return
        if tag in TABLE_PARTS:
            reach = self.last("table") if tag != "table" else 0
        else:
            reach = self.scopes[-1] if tag in BLOCK else self.blocks[-1]
        if place > reach or place == reach and tag in SCOPE:
            self.close(place)

    def text(self, text: str) -> None:
        if self.at["head"] and text.strip():
            self.close(self.last("head"))
        self.now.kids.append(text)


def parse(page: str) -> Node:
    """A tree of elements and texts; unclosed and stray tags are put right as browsers do, roughly."""
    tree, at, end = _Tree(), 0, len(page)
    raw_ends: dict[str, re.Pattern] = {}
    unclosed: set[str] = set()
    while at < end:
        m = MARKUP.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            tree.text(text)
        if not m:
            break
        at = m.end()
        if m[1]:
            if page.startswith((">", "->"), at):  # an empty comment, cut short
                at = page.index(">", at) + 1
                continue
            close = COMMENT_END.search(page, at) if "!--" not in unclosed else None
            if not close:
                unclosed.add("!--")
            at = close.end() if close else end
            continue
        if m[2]:  # a doctype, an instruction, a section marked as data: all of it up to the next >
            close_at = page.find(">", at)
            at = close_at + 1 if close_at >= 0 else end
            continue
        tag, attributes = m[4].lower(), {}
        while not (closing := TAG_END.match(page, at)):
            a = ATTRIBUTE.match(page, at)
            if not a or a.end() == at:
                break
            attributes.setdefault(a[1].lower(), html_lib.unescape(next((v for v in (a[2], a[3], a[4]) if v is not None), "")))
            at = a.end()
        if not closing:  # the page ends within a tag
            break
        at = closing.end()
        if m[3]:
            tree.end(tag)
        elif tag in RAW:
            # The text of these is no markup and no article, up to their end tag.
            pattern = raw_ends.setdefault(tag, re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I))
            close = None if tag in unclosed else pattern.search(page, at)
            if not close:
                unclosed.add(tag)  # searched once, however often it opens
            at = close.end() if close else end if tag in ("script", "style", "textarea", "title") else at
        else:
            tree.start(tag, attributes)
    return tree.root


def _measure(root: Node) -> list[Node]:
    """Sizes, linked sizes and commas of every element, all without what is dropped; elements in post-order."""
    done: list[Node] = []
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, left = todo.pop()
        if node.dropped:
            continue
        if not left:
            todo.append((node, True))
            todo += [(k, False) for k in reversed(node.kids) if not isinstance(k, str)]
            continue
        for k in node.kids:
            if isinstance(k, str):
                node.size += len(k.strip())
                node.commas += sum(map(k.count, COMMAS))
            elif not k.dropped:
                node.size += k.size
                node.linked += k.linked
                node.commas += k.commas
        if node.tag == "a":
            node.linked = node.size
        done.append(node)
    return done


def link_density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _paragraph(node: Node) -> bool:
    """Holds text of its own and no block below it."""
    if node.tag not in BLOCK and node.tag != "#root":
        return False
    return any(isinstance(k, str) and k.strip() or not isinstance(k, str) and not k.dropped and k.tag not in BLOCK and k.size for k in node.kids)


def best_container(root: Node) -> Node:
    elements = _measure(root)
    containers: list[Node] = []
    for node in elements:
        if not _paragraph(node) or node.size < SHORT:
            continue
        own = (1 + node.commas + min(3.0, node.size / 100)) * (1 - link_density(node))
        up, step = node.parent if node.tag not in ("#root", "div", "section", "article", "main", "td") else node, 1
        while up is not None:
            if not up.score:
                containers.append(up)
            up.score += own / step
            up, step = up.parent, step * 2 if step == 1 else step + 1
            if step > 8:
                break
    if not containers:  # nothing but short paragraphs: the first element that says it is the article
        named = [n for tag in ("article", "main") for n in elements if n.tag == tag and n.size]
        return named[0] if named else root
    at = {id(n): i for i, n in zip(count(), elements)}
    return max(containers, key=lambda n: (n.score * (1 - link_density(n)), -at.get(id(n), 0)))


def _prose(node: Node) -> bool:
    return node.size >= SHORT and link_density(node) < 0.25


def _keeps(parent: Node, best: Node, in_article: bool):
    """Says which children of ``parent`` stay beside the one that holds the best container."""
    least = max(4.0, best.score * 0.2)

    def stays(kid: Node | str) -> bool:
        if isinstance(kid, str):
            return in_article or len(kid.strip()) >= SHORT
        if kid.dropped:
            return False
        if in_article:  # what an article holds is the article, but for lists of links
            return kid.tag not in BLOCK or link_density(kid) < 0.5
        if kid.score >= least and link_density(kid) < 0.5:
            return True
        if kid.tag in ("h1", "h2", "h3", "p", "blockquote", "pre", "ul", "ol", "dl", "table", "figure"):
            return bool(kid.size) and link_density(kid) < 0.25
        return kid.tag not in BLOCK and _prose(kid) or kid.tag == "article" and _prose(kid)

    return stays


def _chosen(root: Node) -> list[Node | str | None]:
    """The best container with its siblings that stay, in page order; None stands where something was left out.

    Within an article element that is all of it that is no list of links; one
    level outside, the siblings that score alike, articles, headings and
    linkless paragraphs.
    """
    best = best_container(root)
    chosen: list[Node | str | None] = [best]
    node = best
    while node.parent is not None and node.tag not in ("body", "html", "main"):
        outer = node.parent
        while outer is not None and outer.tag != "article":
            outer = outer.parent
        in_article = outer is not None
        stays = _keeps(node.parent, best, in_article)
        around: list[Node | str | None] = []
        for kid in node.parent.kids:
            around += chosen if kid is node else [kid] if stays(kid) else [None] if isinstance(kid, str) or kid.tag in BLOCK else []
        chosen, node = around, node.parent
        if not in_article:
            break
    return chosen


def blocks(nodes: list[Node | str | None]) -> Iterator[str]:
    """Text of each block in page order, white space turned into single spaces."""
    parts: list[str] = []

    def flush() -> Iterator[str]:
        text = SPACE.sub(" ", html_lib.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            yield text

    todo: list[Node | str | None] = list(reversed(nodes))
    while todo:
        item = todo.pop()
        if item is None:
            yield from flush()
        elif isinstance(item, str):
            parts.append(item)
        elif item.dropped:
            if item.tag in BLOCK:
                yield from flush()
        elif item.tag in INLINE_BREAK:
            if item.tag == "hr":
                yield from flush()
            else:
                parts.append(" " if item.tag == "br" else "")
        elif item.tag in BLOCK:
            yield from flush()
            todo.append(None)
            todo += reversed(item.kids)
        else:
            todo += reversed(item.kids)
    yield from flush()


def extract(page: str | None) -> str:
    """The main text of one page; empty if it has none."""
    if not page:
        return ""
    return "\n".join(blocks(_chosen(parse(page))))


def extract_pages(pages: DataFrame, html_col: str = "html", *keep: str) -> DataFrame:
    """The columns ``keep`` of every row, with ``text`` and ``n_chars``.

    Null, empty and textless pages have text "" and n_chars 0.  Broken, deep
    and very long pages are read to their end, in time that grows with their
    length; a page that ends within a tag loses that tag.  Repeated rows
    each give a row; an empty table gives none.  Other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            lengths = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), lengths], names=[*keep, "text", "n_chars"])

    source = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))
    schema = T.StructType([*(source.schema[k] for k in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return map_batches(source, run, schema)
