"""Main text of web pages: element subtrees that recur over a site go, blocks of the article stay."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cached_property
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Kinds of elements, and landmark roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr dd dt li".split())
DROPPED = frozenset("head script style noscript template iframe svg nav footer aside form button select textarea dialog menu object audio video canvas".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption caption summary tr tbody thead table ul ol dl figure section".split())
#: An open element of the key that the start tag of the values ends, up to the border elements.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Class words that say which item of a menu the page is.
STATES = frozenset("active current selected open first last odd even".split())

# Words of classes and ids that name adverts, notices, menus, sidebars and reader comments.
FURNITURE = frozenset("ad ads advert adverts advertisement advertising sponsored promo comment comments commentlist disqus cookie cookies menu navbar breadcrumb breadcrumbs newsletter sidebar share".split())
#: Words beside them that say that the element merely has or lacks such a part.
ABOUT = frozenset("has no with without free open closed".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_DIGITS = re.compile(r"\d")
_WORDS = re.compile(r"[\s_-]+")


class Element:
    """A node of a page; ``exact`` and ``shape`` are set by ``measure``."""

    __slots__ = ("tag", "attrs", "children", "exact", "shape", "chars", "link_chars")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.exact = self.shape = b""
        self.chars = self.link_chars = 0

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(self.attrs)} if self.attrs.strip(" /") else {}

    def kind(self) -> str:
        """Tag and class words, without digits and without those that mark the current page."""
        if not self.attrs:
            return self.tag
        names = sorted({_DIGITS.sub("", w) for w in self.attributes().get("class", "").lower().split()} - STATES)
        return " ".join([self.tag, *names])

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def walk(self) -> Iterator[Element]:
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack += reversed(e.elements())


def _tag_end(html: str, at: int) -> int:
    """Where the tag's '>' is, outside quoted values; -1 if there is none."""
    spot = at
    while m := _STOP.search(html, spot):
        if m[0] == ">":
            return m.start()
        before = m.start() - 1
        while before >= spot and html[before].isspace():
            before -= 1
        if html[before] != "=":  # a quote opens a value after '=' only
            spot = m.end()
            continue
        close = html.find(m[0], m.end())
        if close < 0:
            return -1
        spot = close + 1
    return -1


def parse(html: str) -> Element:
    """A tree of elements and decoded texts, in time linear in the page.

    Missing end tags are implied, stray ones ignored. Once a quoted value does
    not end, quotes count no more; a tag without '>' is text. Elements nest as
    deep as the page has them: where the open ones of a tag stand is kept by tag.
    """
    root = Element("#root")
    stack, at, n = [root], 0, len(html)
    opened: defaultdict[str, list[int]] = defaultdict(list)
    blocks = [0]
    quotes = True
    text: list[str] = []

    def pop(k: int) -> None:
        while len(stack) > k:
            opened[stack.pop().tag].pop()
        while blocks[-1] >= k:
            blocks.pop()

    def last(tags: Iterable[str]) -> int:
        return max((opened[t][-1] for t in tags if opened[t]), default=0)

    while at < n:
        begin = html.find("<", at)
        if begin < 0:
            break
        sign = html[begin + 1 : begin + 2]
        closing = sign == "/"
        m = _NAME.match(html, begin + 1 + closing)
        if m is None and sign not in ("!", "?"):
            text.append(html[at : begin + 1])
            at = begin + 1
            continue
        if m is None:
            end = html.find("-->", begin + 4) if html.startswith("<!--", begin) else html.find(">", begin)
            after = n if end < 0 else end + (3 if html.startswith("<!--", begin) else 1)
            if end < 0 and not html.startswith("<!--", begin):
                break
        else:
            end = _tag_end(html, m.end()) if quotes else html.find(">", m.end())
            if end < 0 and quotes:
                quotes, end = False, html.find(">", m.end())
            if end < 0:
                break
            after = end + 1
        text.append(html[at:begin])
        at = after
        if whole := "".join(text):
            stack[-1].children.append(unescape(whole))
        text.clear()
        if m is None:
            continue
        tag = m[0].lower()
        if closing:
            if opened[tag]:
                pop(opened[tag][-1])
            continue
        attrs = html[m.end() : end]
        if tag in IMPLIED:
            ends, border = IMPLIED[tag]
            if (k := last(ends)) > last(border):
                pop(k)
        if tag in CLOSES_P and opened["p"] and opened["p"][-1] > blocks[-1]:
            pop(opened["p"][-1])
        e = Element(tag, attrs)
        stack[-1].children.append(e)
        shut = attrs.endswith("/")
        if tag in RAW and not (tag == "svg" and shut):
            close = _RAW_END[tag].search(html, at)
            end = html.find(">", close.end()) if close else -1
            at = n if end < 0 else end + 1
        elif tag not in VOID and (not shut or tag in BLOCK):
            opened[tag].append(len(stack))
            if tag in BLOCK and tag != "p":
                blocks.append(len(stack))
            stack.append(e)
    if rest := "".join([*text, html[at:]]):
        stack[-1].children.append(unescape(rest))
    return root


def measure(root: Element) -> None:
    """Hashes and sizes of all subtrees.

    ``exact``: kinds and texts, white space runs as one space; where links lead
    and other attributes do not count. ``shape``: kinds alone, equal
    neighbours once, so that a menu keeps its shape whatever it lists.
    """
    for e in reversed(list(root.walk())):
        kind = e.kind().encode("utf-8", "replace")
        exact, shape, last = hashlib.blake2b(b"x" + kind, digest_size=8), hashlib.blake2b(b"s" + kind, digest_size=8), b""
        for c in e.children:
            if isinstance(c, Element):
                exact.update(b"\1" + c.exact)
                if c.shape != last:
                    shape.update(c.shape)
                last = c.shape
                e.chars += c.chars
                e.link_chars += c.chars if c.tag == "a" else c.link_chars
            else:
                own = " ".join(c.split())
                exact.update(b"\2" + own.encode("utf-8", "replace"))
                e.chars += len(own)
        e.exact, e.shape = exact.digest(), shape.digest()


def is_dropped(e: Element, inside: bool) -> bool:
    """Whether tag, role or hiding says that the element is no main text; ``inside`` an article, headers stay."""
    if e.tag in DROPPED or (e.tag == "header" and not inside):
        return True
    if not e.attrs or e.tag in ("html", "body"):
        return False
    a = e.attributes()
    hides = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    return hides or (not inside and a.get("role", "").lower() in DROPPED_ROLES)


def is_furniture(e: Element) -> bool:
    """Whether a class or the id names an advert, a notice, a menu, a sidebar or reader comments."""
    if not e.attrs or e.tag in ("html", "body", "#root"):
        return False
    a = e.attributes()
    for name in [*a.get("class", "").lower().split(), a.get("id", "").lower()]:
        parts = set(_WORDS.split(name))
        if parts & FURNITURE and not parts & ABOUT:
            return True
    return False


def is_part(e: Element, name: str) -> bool:
    """Whether the element is marked as the page's ``name`` (article or main)."""
    return e.tag == name or bool(e.attrs and e.attributes().get("role") == name)


def furniture(root: Element) -> set[int]:
    """Ids of the elements named as furniture that hold no article or main element of the page."""
    holds: set[int] = set()
    named: set[int] = set()
    for e in reversed(list(root.walk())):
        named_so = is_furniture(e)
        if any(id(c) in holds for c in e.elements()) or (not named_so and (is_part(e, "article") or is_part(e, "main"))):
            holds.add(id(e))
        elif named_so:
            named.add(id(e))
    return named


def articles(root: Element, named: set[int] | frozenset[int] = frozenset()) -> list[Element]:
    """Outermost articles; else main elements; none where a page marks neither. ``named``: ids of furniture."""
    for name in ("article", "main"):
        found: list[Element] = []
        stack = [root]
        while stack:
            e = stack.pop()
            if is_dropped(e, False) or id(e) in named:
                continue
            if is_part(e, name):
                found.append(e)
            else:
                stack += reversed(e.elements())
        if found:
            return found
    return []


def body_of(root: Element) -> Element:
    return next((e for e in root.walk() if e.tag == "body"), root)


class Page:
    """A parsed page with the keys by which its subtrees are counted."""

    def __init__(self, html: str):
        self.root = parse(html)
        self.named = furniture(self.root)
        self.main = articles(self.root, self.named)

    @cached_property
    def _key(self) -> dict[int, bytes]:
        """The keys of the elements that have one; where markup decides, none is made."""
        measure(self.root)
        inside = {id(x) for m in self.main for x in m.walk()}
        # a page's own frame: whatever holds a main part
        frame = {"#root", "html", "body", "head"}
        keys: dict[int, bytes] = {}
        holds: set[int] = set(inside)
        for e in reversed(list(self.root.walk())):
            c = e.elements()
            if id(e) not in inside and any(id(x) in holds for x in c):
                holds.add(id(e))
                continue
            if e.tag in frame or e.tag in VOID or e.tag in ("article", "main"):
                continue
            if id(e) in inside:
                if e.tag in BLOCK:
                    keys[id(e)] = (b"p" if e.tag in PROSE else b"b") + e.exact
            elif self.main or 2 * e.link_chars > e.chars:
                keys[id(e)] = b"o" + e.shape
            else:
                keys[id(e)] = b"o" + e.exact
        return keys

    def keys(self) -> set[bytes]:
        """One byte for the kind of place - ``o`` outside the main part, ``b`` a box or ``p`` prose within it - and a hash."""
        return set(self._key.values())

    def text(self, templates: frozenset[bytes] | set[bytes] | None = None) -> str:
        """Blocks in page order, joined by line breaks.

        With ``templates``, those of the page's host: everything but templates and
        what its markup drops. Without: the main part, by markup alone.
        """
        blocks: list[str] = []
        run: list[str] = []

        def end() -> None:
            if text := " ".join("".join(run).split()):
                blocks.append(text)
            run.clear()

        main = {id(m) for m in self.main}
        for part in (self.main or [body_of(self.root)]) if templates is None else [body_of(self.root)]:
            stack: list[tuple[object, bool]] = [(part, bool(self.main) and templates is None)]
            while stack:
                e, inside = stack.pop()
                if e is None:
                    end()
                elif isinstance(e, str):
                    run.append(e)
                elif e.tag == "br":
                    run.append(" ")
                elif e is not part and (is_dropped(e, inside) or id(e) in self.named or (templates and self._key.get(id(e)) in templates)):
                    if e.tag in BLOCK:
                        end()
                else:
                    inside = inside or id(e) in main
                    if e.tag in BLOCK:
                        end()
                        stack.append((None, inside))
                    stack += [(c, inside) for c in reversed(e.children)]
            end()
        return "\n".join(blocks)


def main_text(html: str, templates: frozenset[bytes] | set[bytes] | None = None) -> str:
    return Page(html).text(templates)


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; null or no host: ''."""
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def site_templates(source: DataFrame, min_pages: int = 4, share: float = 0.2, box_pages: int = 10, prose_pages: int = 40, prose_share: float = 0.5) -> DataFrame:
    """host, templates (array of keys) of every host with more than ``min_pages`` distinct main texts.

    ``source``: host, html. Each subtree counts once for each distinct main text
    of its host, so that copies of a page are no evidence however many they are.
    Outside the main part a subtree is a template on more than ``min_pages`` of
    them and at least ``share`` of all; within it, a box on more than ``box_pages``
    and ``share``, a paragraph, list, table or section on more than ``prose_pages``
    and ``prose_share``, as shared passages are common there. Pages without a host are no site.
    """

    def subtrees(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        contents, keys = [], []
        for body in batch.column("html").to_pylist():
            page = Page(body or "")
            contents.append(hashlib.blake2b(page.text().encode("utf-8", "replace"), digest_size=16).digest())
            keys.append(sorted(page.keys()))
        yield common.batch_of({"host": batch.column("host"), "content": contents, "keys": keys}, {"content": pa.binary(), "keys": pa.list_(pa.binary())})

    read = common.map_arrow(source.filter("host <> ''").select("host", "html"), subtrees, "host string, content binary, keys array<binary>")
    once = common.cut(read.groupBy("host", "content").agg(F.first("keys").alias("keys")))
    hosts = once.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") > min_pages)
    counted = once.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_pages)
    place = F.substring(F.col("key").cast("string"), 1, 1)
    most = F.when(place == "p", F.lit(prose_pages)).when(place == "b", F.lit(box_pages)).otherwise(F.lit(min_pages))
    least = F.when(place == "p", F.lit(prose_share)).otherwise(F.lit(share))
    over = counted.join(hosts, "host").filter((F.col("n") > most) & (F.col("n") >= F.col("pages") * least))
    own = over.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("templates"))
    return hosts.select("host").join(own, "host", "left").select("host", F.coalesce("templates", F.array().cast("array<binary>")).alias("templates"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", block_rows: int = 100_000, **limits) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Spark counts the element subtrees of each host over its whole pages
    (``site_templates``, which ``limits`` go to) and the pages of the hosts counted lose their templates;
    no article element decides there. On hosts of too few pages, markup does: the
    article or main element, or else the body, without navigation and the like.
    On every host, elements whose class or id names an advert, a notice, a menu, a
    sidebar or reader comments go, unless they hold the article. Pages of any depth are read as they are.
    The hosts' templates - a host has at most its mean number of subtrees divided
    by the share - meet the pages in one join: broadcast while at most ``block_rows``
    hosts have any, by host beyond, where Spark splits a host that is too large for a task.

    Null html gives an empty text; pages without a host are judged by markup;
    repeated rows stay; an empty table gives an empty result; other columns are not read.
    """
    source = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"), host_of(F.col(f"`{url}`")).alias("host"))
    sites = common.cut(site_templates(source, **limits))
    if sites.count() <= block_rows:
        sites = F.broadcast(sites)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = [main_text(b or "", None if t is None else set(t)) for b, t in zip(batch.column("html").to_pylist(), batch.column("templates").to_pylist())]
        yield common.batch_of({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": out, "n_chars": list(map(len, out))}, {"text": pa.string(), "n_chars": pa.int64()})

    joined = source.join(sites, "host", "left").select("page_id", "url", "html", "templates")
    return common.map_arrow(joined, run, "page_id long, url string, text string, n_chars long")
