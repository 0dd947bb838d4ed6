"""Main text of web pages: site template removal.

Every element subtree of a page is hashed twice: with its whole content, and by its shape, which is the names, classes, ids and roles in it without
any text, equal neighbours taken once. Spark counts, for each host, the different pages that a hash occurs on; pages with
the same main content count once, so that copies of an article do not make a template of it. Subtrees that recur across
many pages of their host are deleted: by content wherever they stand, by shape (a menu, an advert or a footer whose words change from
page to page) only beside the part that holds the article, and only if the shape has the lesser part of the text of the pages that show it.

On hosts with fewer different pages than it takes to recur no count can tell. Only there the markup decides: an article or main element is taken alone, and
elements that their names call menus, headers, footers, sidebars, notices, adverts, forms or reader comments go. Plain paragraphs, headings, lists and the like
inside an article element are the text itself: a sentence that many articles of a site share is still theirs, so these
stay even where they recur.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidepool.llm.bytestext import slices, small_batches, utf8
from tidepool.llm.columns import taken
from tidepool.llm.scratch import cut

#: A subtree is a template part if this many pages of its host with different content have it, however many pages the host has.
PAGES = 5
#: A shape is a template part only if it has less than one part in so many of the text of the pages that show it.
LESSER = 4
#: The mark that every page has once: where it recurs on a host, the host has pages enough for counts to decide.
COUNTED = 1

# Element names of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
UNSEEN = frozenset("head script style title noscript template iframe object embed applet canvas svg math audio video map".split())
NEVER = UNSEEN | frozenset("nav header footer aside form button input select textarea option fieldset menu dialog".split())
BLOCK = frozenset("address article blockquote body center dd details div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside form fieldset dir menu search caption".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tfoot tr td th figure figcaption b i em strong a span code br".split())
INLINE = frozenset("b i em strong a span code u small mark sub sup abbr cite q".split())
CLOSES_P = BLOCK - frozenset("html body".split())
SAME_LEVEL = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar status".split())
#: Words of class and id values that name what is no part of an article.
NAMED = frozenset(
    "nav menu submenu header topbar footer side rail ad ads promo promotion banner consent gdpr notice notices alert popup modal overlay signup login social share sharing related widget respond reply replies pager toolbar masthead skip paywall".split()
)
#: Beginnings of such words.
NAMED_BEGINNINGS = tuple("navbar navigation breadcrumb sidebar advert adsense sponsor cookie newsletter subscri recommend comment disqus pagination".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:![^>]*|\?[^>]*)>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


class Node:
    """An element; ``parts`` are texts and elements in page order."""

    __slots__ = ("name", "marks", "parts", "mark", "shape", "chars", "holds")

    def __init__(self, name: str, marks: dict[str, str]):
        self.name, self.marks, self.parts, self.mark, self.shape, self.chars, self.holds = name, marks, [], 0, 0, 0, False

    def elements(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]

    def is_main(self) -> bool:
        return self.name in ("article", "main") or self.marks.get("role") == "main"

    def named_away(self) -> bool:
        """Whether its markup says that it is no part of the article."""
        marks = self.marks
        if self.name in NEVER or "hidden" in marks or marks.get("aria-hidden") == "true" or marks.get("role", "").lower() in ROLES:
            return True
        if not marks or self.name in ("html", "body", "main"):
            return False
        if "display:none" in marks.get("style", "").replace(" ", "").lower():
            return True
        words = {w.lower() for key in ("class", "id") for w in _SPLIT.split(marks.get(key, "")) if w}
        if self.name == "article":  # a reader's comment may be an article of its own
            return any(w.startswith("comment") for w in words) and not self.holds_article()
        named = not NAMED.isdisjoint(words) and self.name not in HEADINGS or any(w.startswith(NAMED_BEGINNINGS) for w in words)
        return named and not self.holds_article()

    def holds_article(self) -> bool:
        """Whether an article, main part or first heading is in it: then its names tell of the layout, not of what it is."""
        todo = [self]
        while todo:
            inner = [p for p in todo.pop().parts if isinstance(p, Node)]
            if any(p.name in ("main", "h1") or p.name == "article" and not any(w.lower().startswith("comment") for w in _SPLIT.split(p.marks.get("class", ""))) for p in inner):
                return True
            todo += inner
        return False


def parse(page: str) -> Node:
    """The tree of a page. Elements left open end where HTML says that the next tag ends them, or with the page."""
    root = Node("", {})
    stack, at, lower = [root], 0, None
    while True:
        found = _TAG.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            stack[-1].parts.append(references.unescape(text))
        if not found:
            return root
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    del stack[depth:]
                    break
            continue
        rest = found[3]
        marks = {m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)} if len(rest) > 1 else {}
        if name in CLOSES_P:
            _close(stack, frozenset(["p"]), frozenset("table td th article section div body button".split()))
        if name in SAME_LEVEL:
            _close(stack, *SAME_LEVEL[name])
        node = Node(name, marks)
        stack[-1].parts.append(node)
        if name in VOID or rest.endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{name}", at)
            end = len(page) if end < 0 else end
            if name == "textarea" or name == "title":
                node.parts.append(references.unescape(page[at:end]))
            close = page.find(">", end)
            at = len(page) if close < 0 else close + 1
            continue
        stack.append(node)


def _close(stack: list[Node], names: frozenset[str], limit: frozenset[str]) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].name in names:
            del stack[depth:]
            return
        if stack[depth].name in limit:
            return


def mark_subtrees(node: Node) -> tuple[dict[int, bool], dict[int, int]]:
    """Hashes each subtree, bottom up: ``mark`` by element name, class, id, role and whole content, ``shape`` by the same without text.

    The first result says of each mark whether a recurrence may delete it: prose inside an article may not be deleted, nor a word marked up amid text.
    The second has the characters of each shape that a recurrence may delete; a node that its shape may not delete has shape 0.
    """
    out: dict[int, bool] = {}
    todo: list[tuple[Node, bool, bool]] = [(node, False, False)]
    while todo:
        at, within, ready = todo.pop()
        if not ready:
            todo.append((at, within, True))
            below = within or at.is_main()
            amid = any(isinstance(p, str) and not p.isspace() for p in at.parts)
            todo += [(p, below or amid and p.name in INLINE, False) for p in at.elements()]
            continue
        head = f"{at.name} {at.marks.get('class', '')} {at.marks.get('id', '')} {at.marks.get('role', '')}"
        whole, shape, last = xxhash.xxh64(head), xxhash.xxh64(head, 1), 0
        for part in at.parts:
            if isinstance(part, Node):
                whole.update(part.mark.to_bytes(8, "big"))
                at.chars += part.chars
                at.holds |= part.holds or part.is_main() or part.name == "h1"
                if part.shape != last and part.name not in UNSEEN:
                    shape.update(part.shape.to_bytes(8, "big"))
                    last = part.shape
            else:
                words = " ".join(part.split())
                whole.update(words)
                at.chars += len(words)
        if at.name in UNSEEN:
            at.chars = 0
        at.mark, at.shape = whole.intdigest(), shape.intdigest()
        free = at.name not in ("", "html", "body", "article", "main", "br") and not (within and at.name in PROSE | INLINE)
        out[at.mark] = out.get(at.mark, True) and free
    return out, _free_shapes(node)


def _free_shapes(root: Node) -> dict[int, int]:
    """Characters of each shape that stands beside what holds the article; all other nodes get shape 0.

    That is an article or main element, or a first heading. On a page without one it is each part with a ``LESSER`` share of the text, among the outermost that stand side by side.
    """
    spared: set[int] = set()
    if not root.holds:
        outer = root
        while len(shown := [p for p in outer.elements() if p.chars]) == 1:
            outer = shown[0]
        spared = {id(p) for p in shown if LESSER * p.chars >= root.chars} or {id(outer)}
    out: dict[int, int] = {}
    todo = [(root, False)]
    while todo:
        at, within = todo.pop()
        within = within or at.is_main() or id(at) in spared
        if within or at.holds or at.name in PROSE | INLINE | UNSEEN or at.name in ("", "html", "body") or not at.chars:
            at.shape = 0
        else:
            out[at.shape] = out.get(at.shape, 0) + at.chars
        todo += [(p, within) for p in at.elements()]
    return out


def blocks(root: Node, template: frozenset[int] = frozenset(), names: bool = True) -> list[str]:
    """The texts of the page's blocks in page order, without what the site's template or, with ``names``, its markup rules out."""
    top = _main(root, template) if names else root
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        words = "".join(held).split()
        held.clear()
        if words:
            out.append(" ".join(words))

    todo: list[object] = [top]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            held.append(at)
            continue
        if at is None:
            end()
            continue
        if at is not top and (at.mark in template or at.shape in template or (at.named_away() if names else at.name in UNSEEN)):
            if at.name in BLOCK:
                end()
            continue
        if at.name == "br":
            held.append(" ")
            continue
        if at.name in BLOCK:
            end()
            todo.append(None)
        todo += reversed(at.parts)
    end()
    return out


def _main(root: Node, template: frozenset[int]) -> Node:
    """What holds the article: all article elements together, else main, else the body."""
    articles, mains, todo = [], [], [root]
    while todo:
        at = todo.pop()
        if (at.mark in template or at.shape in template) and at is not root or at.named_away():
            continue
        if at.name == "article":
            articles.append(at)
            continue
        if at.name == "main" or at.marks.get("role") == "main":
            mains.append(at)
        todo += reversed([p for p in at.parts if isinstance(p, Node)])
    if articles:
        holder = Node("", {})
        holder.parts = articles
        return holder
    return mains[0] if mains else root


def article_text(root: Node) -> str:
    """What tells pages apart: the text of the outermost article and main elements, or of the whole page without any. No word of a class or id is looked at."""
    found, todo = [], [root]
    while todo:
        at = todo.pop()
        if at.is_main():
            found += blocks(at, names=False)
        else:
            todo += reversed(at.elements())
    return "\n".join(found or blocks(root, names=False))


def host_key(url: str) -> Column:
    """A hash of an address's host, lower-cased, without user and port; all addresses without one share a key."""
    host = F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.xxhash64(F.lower(host))


def page_marks(pages: DataFrame) -> DataFrame:
    """(page, content, total, marks, shapes, chars) of a table (url, html): the deletable subtrees of each page, by content and by shape with its characters.

    Marks and shapes are mixed with the host's hash (``of_host``), so that those of different hosts differ. ``content`` is a hash of the article's text, ``total`` the page's characters; equal pages of a host have one ``page``.
    """
    names = ["page", "content", "total", "marks", "shapes", "chars"]
    lists = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            rows = []
            for host, raw in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                root = parse(raw.as_py().decode("utf-8", "replace"))
                found, shapes = mark_subtrees(root)
                content = signed(xxhash.xxh64_intdigest(article_text(root)))
                marks = [COUNTED, *(m for m, free in found.items() if free)]
                rows.append((content, root.chars, [of_host(m, host) for m in marks], [of_host(m, host) for m in shapes], list(shapes.values())))
            made = [pa.array([r[k] for r in rows], pa.int64() if k < 2 else lists) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *made], names=names)

    own = small_batches(pages).select(host_key("url").alias("host"), page_key().alias("page"), utf8("html").alias("html"))
    return own.mapInArrow(run, "page long, content long, total long, marks array<long>, shapes array<long>, chars array<long>")


def page_key() -> Column:
    return F.xxhash64(host_key("url"), utf8("html"))


def subtree_counts(marked: DataFrame) -> DataFrame:
    """(mark, pages, chars, total): on how many pages with different main content of its host each deletable subtree or shape occurs, and what part of their text it has.

    A page gives each of its subtrees once, so the rows are in proportion to the markup; they are summed before they move. Every
    content of a host is counted by its hash, once, whatever the number of its copies. For subtrees counted by content ``chars`` is 0.
    """
    by_content = F.transform("marks", lambda m: F.struct(m.alias("mark"), F.lit(0).cast("long").alias("chars")))
    by_shape = F.transform(F.arrays_zip("shapes", "chars"), lambda x: F.struct(x["shapes"].alias("mark"), x["chars"].alias("chars")))
    seen = marked.select("content", "total", F.explode(F.concat(by_content, by_shape)).alias("m"))
    once = seen.groupBy("m.mark", "content").agg(F.max("m.chars").alias("chars"), F.max("total").alias("total"))
    return once.groupBy("mark").agg(F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"), F.sum("total").alias("total"))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def of_host(mark: int, host: int) -> int:
    """A mark mixed with a host's hash, as a signed number; mixing it again gives the mark back."""
    return signed((mark ^ host) & 0xFFFFFFFFFFFFFFFF)


def template_marks(marked: DataFrame, least: int = PAGES) -> DataFrame:
    """(page, marks array<long>): what each page has of its host's template; no array is longer than its page."""
    # written first, so that its size is known: a small one is sent to all tasks, and a large one is joined with hot hosts split up
    recurring = cut(subtree_counts(marked).where((F.col("pages") >= least) & (LESSER * F.col("chars") < F.col("total") + 1)).select("mark"), "recurring")
    each = marked.select("page", F.explode(F.concat("marks", "shapes")).alias("mark")).join(recurring, "mark")
    return each.groupBy("page").agg(F.collect_set("mark").alias("marks"))


def main_texts(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html", least: int = PAGES, names: bool | None = None) -> DataFrame:
    """One row per page: its id, url, text (blocks joined by two line ends; empty if none) and n_chars.

    Null html counts as empty; pages without a host in their url are one site. Pages of any length are parsed whole, an empty table gives an empty
    table. Repeated rows stay; other columns are neither read nor returned, whatever their names. On hosts with ``least`` different pages only recurring subtrees are deleted, on
    others the names in the markup decide; with ``names`` true or false they do so everywhere, beside the counts, or nowhere.
    """
    asked = taken(pages, id=id_column, url=url, html=html)
    template = cut(template_marks(cut(page_marks(asked), "marks"), least), "template")
    own = small_batches(asked).select("id", "url", utf8("html").alias("raw"), host_key("url").alias("host"), page_key().alias("own"))
    joined = own.join(template, F.col("own") == F.col("page"), "left").drop("own", "page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = []
            for raw, host, marks in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True):
                root = parse(raw.as_py().decode("utf-8", "replace"))
                known = frozenset(of_host(m, host) & 0xFFFFFFFFFFFFFFFF for m in marks.as_py() or ())
                if known - {COUNTED}:
                    mark_subtrees(root)
                texts.append("\n\n".join(blocks(root, known, COUNTED not in known if names is None else names)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    schema = StructType([asked.schema["id"], asked.schema["url"], StructField("text", StringType()), StructField("n_chars", LongType())])
    return joined.mapInArrow(run, schema).toDF(id_column, url, "text", "n_chars")
