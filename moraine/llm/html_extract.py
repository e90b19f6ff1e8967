"""Main text of web pages, by template deduction with equivalence classes.

A page is a sequence of tokens: its elements, named by their path of tags and
classes, and its blocks of text, named by path and text. Pages of one host
come from a template; the template's tokens occur together. So tokens of a
host are grouped by their occurrence vectors (how often each page has them).
A vector grows with the host's pages, so it is kept as two random linear sums
(each distinct page has two random numbers, which count as often as the page
has the token) beside the number of pages that have the token: equal vectors
have equal sums, others differ but by a chance of 2**-62, and a host of any
size is summed up by partial aggregation. Copies of a page say nothing of its
template and count once. A class is valid if it has at least two tokens, an
element among them, and occurs on at least three pages and half of the host's. Valid classes nest by path: a page's template is
the tree of the elements in them, and every block lies in the slot of the
deepest such element. Text that is in a valid class itself belongs to the
template, except within an article or main element. What the other slots hold
is the page's content; it is kept unless the way down to it leads through a part
that isn't main text, or its slot is a menu: a path of the template, outside an
article or main element, that holds three blocks or more on the page, all of
them links. If only menus are left, they are kept.

Parsing takes time and memory in proportion to the page, however deep its
elements nest and whatever is left open.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, pick, texts
from .url_filter import host_and_path

#: Elements without an end tag, of raw text, that begin a block, and that aren't main text; fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
APART = frozenset("nav footer aside form script style noscript template button select option textarea iframe svg canvas object head title menu dialog label input".split())
#: Words in a class, id or role that mark such a part; fixed values.
MARKS = frozenset("ad ads advert adverts advertisement advertising adslot adbox banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices paywall popup promo promotion promoted related replies reply respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
#: An open p ends where one of these begins; li, dd, dt, tr, td, th and option end at their like.
LIKE = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS = frozenset(["p", *LIKE])
SCOPE = frozenset("ul ol dl table select article section div main body html".split())
#: A quote begins a value only right after "="; elsewhere it is a character like any other.
TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*+)?)*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>"'][^\s>]*)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SEED = 11
MIN_PAGES = 3


class Element:
    """above: its parent; base: itself, or the nearest parent that isn't inline; near: places of open elements that a tag may end."""

    __slots__ = ("tag", "token", "apart", "content", "above", "base", "near")

    def __init__(self, tag: str, attributes: str, above: Element | None, place: int = 0):
        words = _marks(attributes)
        label = ".".join([tag, *sorted(words)])
        self.tag, self.above = tag, above
        self.token = xxhash.xxh64_intdigest(label, above.token if above else SEED)
        self.content = bool(above and above.content) or tag in ("article", "main")
        # a header inside the article is the article's own
        own = tag in APART or tag == "header" and not self.content or tag not in ("html", "body", "article", "main") and not MARKS.isdisjoint(words)
        self.apart = bool(above and above.apart) or own
        # inline elements don't make a path
        self.base = self if tag in BLOCK or self.apart or above is None else above.base
        self.near = {} if above is None or tag in SCOPE else above.near | {tag: place} if tag in ENDS else above.near


def _marks(attributes: str) -> set[str]:
    """Words of class, id and role; of attributes that come twice the first counts."""
    found: dict[str, str] = {}
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return {w.lower() for n in ("class", "id", "role") if n in found for w in WORD.findall(html.unescape(found[n]))}


class Page:
    """Elements and blocks of one page, in order."""

    def __init__(self, text: str):
        self.elements: list[Element] = []
        #: The element that a block lies in, its text, its token.
        self.blocks: list[tuple[Element, str, int]] = []
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = {}
        #: Whether a block is a link: all its text lies in a elements.
        self.link: list[bool] = []
        self.waiting: list[str] = []
        self.plain = False
        self._open("#page", "")
        self._parse(text)
        self._flush()

    def _open(self, tag: str, attributes: str) -> None:
        e = Element(tag, attributes, self.stack[-1] if self.stack else None, len(self.stack))
        self.elements.append(e)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(e)

    def _flush(self) -> None:
        words = html.unescape("".join(self.waiting)).split()
        link, self.waiting, self.plain = not self.plain, [], False
        if words:
            self.link.append(link)
            text = " ".join(words)
            e = self.stack[-1].base
            self.blocks.append((e, text, xxhash.xxh64_intdigest(text, e.token)))

    def _cut(self, place: int) -> None:
        """End the elements from this place on."""
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()

    def _end_like(self, tags: frozenset[str] | set[str]) -> None:
        near = self.stack[-1].near
        if at := max((near[t] for t in tags if t in near), default=0):
            self._cut(at)

    def _parse(self, text: str) -> None:
        at = 0
        while m := TAG.search(text, at):
            self._add(text[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            edge = tag in BLOCK or tag in APART
            if edge:
                self._flush()
            elif tag == "br":
                self.waiting.append(" ")
            if m[1]:
                if self.places.get(tag):
                    self._cut(self.places[tag][-1])
            elif tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)|\Z", re.I).search(text, at)
                self._flush()
                self._open(tag, m[3])
                self._cut(len(self.stack) - 1)
                at = end.end()
            elif tag not in VOID and not m[3].endswith("/"):
                if tag in BLOCK:
                    self._end_like({"p"})
                    if tag in LIKE:
                        self._end_like(LIKE[tag])
                self._open(tag, m[3])
        self._add(text[at:])

    def _add(self, text: str) -> None:
        self.waiting.append(text)
        self.plain = self.plain or not self.places.get("a") and not text.isspace() and text != ""

    def tokens(self) -> Counter:
        return Counter([e.token for e in self.elements if e.tag in BLOCK or e.tag == "#page"] + [t for _, _, t in self.blocks])

    def main_text(self, template: frozenset[int]) -> str:
        """Blocks in slots of main text; of the template's own text those in an article or main element only."""
        slot: dict[Element, Element] = {}
        for e in self.elements:  # parents come first
            slot[e] = e if e.above is None or e.base is e and e.token in template else slot[e.above]
        held: dict[int, list[bool]] = {}
        for (e, _, token), link in zip(self.blocks, self.link):
            if not e.apart and not e.content and token not in template and slot[e].above:
                held.setdefault(slot[e].token, []).append(link)
        menus = {t for t, links in held.items() if len(links) >= 3 and all(links)}
        # a part's elements are all apart, the page's own as well as the template's
        found = [(e, text) for e, text, token in self.blocks if not e.apart and (e.content or token not in template)]
        found = [(e, text) for e, text in found if e.content or slot[e].token not in menus] or found
        if any(e.content for e, _ in found):
            found = [(e, text) for e, text in found if e.content]
        return "\n".join(text for _, text in found)


def _decoded(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tokens(pages: DataFrame) -> DataFrame:
    """(host, token, element, v, w, pages), summed up by batch; v and w are the sums that stand for the vector."""
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[tuple[int, int], list] = {}
            for host, raw in zip(b.column(0).to_pylist(), texts(b.column(1))):
                page = Page(_decoded(raw))
                key = xxhash.xxh64_intdigest(raw, SEED)
                first, second = key >> 33, key & ((1 << 31) - 1)
                elements = {e.token for e in page.elements}
                for token, n in page.tokens().items():
                    at = total.setdefault((host, token), [token in elements, 0, 0, 0])
                    at[1] += n * first
                    at[2] += n * second
                    at[3] += 1
            columns = [[k[0] for k in total], [_signed(k[1]) for k in total], *([v[j] for v in total.values()] for j in range(4))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "token", "element", "v", "w", "pages"])

    return pages.select("host", "html").mapInArrow(run, "host long, token long, element boolean, v long, w long, pages long")


def _distinct(pages: DataFrame) -> DataFrame:
    """(host, html): each page of a host once; only those that have copies are shuffled."""
    p = pages.select("host", "html", F.xxhash64("html").alias("key"))
    copied = durable(p.groupBy("host", "key").count().where("count > 1").drop("count"))
    if copied.isEmpty():
        return pages.select("host", "html")
    single = p.join(copied, ["host", "key"], "left_anti")
    return single.unionByName(p.join(copied, ["host", "key"], "left_semi").dropDuplicates(["host", "key"])).select("host", "html")


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): the tokens of each host's valid classes.

    Pages are those of different html, here and in all counts. A token counts
    only if half of the host's pages have it, so a template is at most twice as
    long as its pages are on average. A host's sums hold up to 2**32 uses of a
    token.
    """
    each = _tokens(_distinct(pages)).groupBy("host", "token").agg(F.max("element").alias("element"), F.sum("v").alias("v"), F.sum("w").alias("w"), F.sum("pages").alias("pages"))
    each = durable(each)
    root = _signed(Element("#page", "", None).token)
    sizes = each.where(F.col("token") == root).select("host", F.col("pages").alias("of"))
    often = each.where(F.col("pages") >= MIN_PAGES).join(sizes, "host").where(F.col("pages") * 2 >= F.col("of"))
    classes = often.groupBy("host", "v", "w", "pages").agg(F.collect_list("token").alias("members"), F.max("element").alias("element"))
    valid = classes.where((F.size("members") >= 2) & F.col("element"))
    return durable(valid.groupBy("host").agg(F.flatten(F.collect_list("members")).alias("template")))


def extracted(pages: DataFrame, broadcast_tokens: int = 1_000_000) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Null and empty html have empty text. A null url, or one without host,
    belongs to the host without a name. On hosts of fewer than three distinct
    pages no class is valid, and the marks of a page's own elements decide alone.
    Repeated rows each have a row; other columns are ignored; an empty table
    gives an empty result.
    """
    p = pick(pages, "page_id", "url", "html")
    p = p.select(F.col("page_id").cast("long"), "url", "html", F.xxhash64(host_and_path(F.col("url"))[0]).alias("host"))
    found = templates(p)
    if (found.agg(F.sum(F.size("template") + 1)).first()[0] or 0) <= broadcast_tokens:
        found = F.broadcast(found)
    both = p.join(found, "host", "left").select("page_id", "url", "html", "host", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int | None, frozenset[int]] = None, frozenset()
        for b in batches:
            out = []
            template = b.column(4)
            for k, (host, raw) in enumerate(zip(b.column(3).to_pylist(), texts(b.column(2)))):
                if host != known[0]:
                    known = host, frozenset(x % (1 << 64) for x in template[k].as_py() or ())
                out.append(Page(_decoded(raw)).main_text(known[1]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return both.mapInArrow(run, "page_id long, url string, text string, n_chars long")
