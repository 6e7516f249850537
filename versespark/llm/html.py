"""Main text of web pages by site template removal.

Every page is parsed into elements and text blocks. Each element subtree is hashed (its tag, texts and children),
Spark counts on how many different pages of its host each hash stands, and subtrees that recur on
many pages of the host are deleted as its template; elements that a sign (below) would take are counted like others, and what recurs counts as template. Copies of one page count once: a page is told by the block that is longest
for the number of the host's pages it stands on, so neither a long footer nor a changing advert tells pages apart. Since a host may have one page only, elements that by tag, role, class or id
are menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts or styles go as well; a class or id is a sign
as a whole name, not by a word in it (``site-footer``, ``related-posts``; not ``has-sidebar``, ``related-work``), and no sign takes a
page's only marked article. Where
a page marks its article (or main part), the text is taken from there, and a subtree inside it needs to be on most pages
of the host before it counts as template.

Defined cases: null or empty html, and pages without text, give an empty text; equal rows get equal
results; urls without a host share the empty host; tags left open are closed as browsers do for
blocks; unterminated comments and tags run to the end; a block may be of any length; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, slices, written

#: A subtree is template from this many different pages of a host on, and this share of them or this larger number; one with a sign needs no share.
LEAST_PAGES, LEAST_SHARE, MANY_PAGES = 3, 0.10, 25
INSIDE_PAGES, INSIDE_SHARE = 5, 0.60
#: The lists of subtrees to delete are broadcast up to this many bytes, joined by shuffle beyond.
BROADCAST_BYTES = 48 << 20

_words = lambda text: frozenset(text.split())
#: Fixed values of HTML: elements without content, block elements, elements whose start closes an open p.
VOID = _words("area base br col embed hr img input link meta param source track wbr")
BLOCKS = _words("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol
optgroup option p pre search section summary table tbody td tfoot th thead title tr ul""")
ENDS_P = BLOCKS - _words("body caption dd dt head html legend li optgroup option summary tbody td tfoot th thead title tr")
CLOSES = {"li": _words("li"), "dt": _words("dt dd"), "dd": _words("dt dd"), "tr": _words("tr td th"),
          "td": _words("td th"), "th": _words("td th"), "option": _words("option"),
          "tbody": _words("thead tbody tfoot tr td th"), "tfoot": _words("thead tbody tfoot tr td th")}
FENCES = _words("ul ol dl table html body article section div")
RAW = _words("script style textarea title iframe noembed noframes xmp")
#: Elements that are never part of an article, and signs of the same in role, class or id.
OUTSIDE = _words("""nav footer aside form script style noscript template iframe svg button select textarea dialog
head title object canvas menu search noembed noframes""")
ROLES = _words("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar")
SIGNS = _words("""nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside widget widgets ad ads
advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related
recommended note dialog comment comments disqus discussion replies reply respond toolbar pagination pager copyright disclaimer
announcement privacy topbar subnav crumbs colophon adsense adslot adbox promos banners side rail commentlist commentform
searchform sharebar topnav""")
#: Names that within an article may be its subject, so that alone they are no sign there.
SUBJECTS = _words("""ad ads privacy disclaimer announcement discussion promotion recommended related copyright overlay respond reply
replies rail side social consent banner subscription notice alert menu note""")
#: Those of them that are a sign there too where they name a box, not a paragraph, heading or part of one.
BOXED = _words("ad ads banner alert notice respond reply replies subscription consent overlay social rail")
BOXES = _words("div section aside ul ol dl table iframe form fieldset details dialog header footer")
#: Words that say which part or place of a sign a name is about, and words that say that something else has or lacks it.
PARTS = _words("""list lists link links button buttons box bar wrapper wrap container block section area panel inner outer form slot
unit row column col top bottom left right header title head body site page post posts article articles item items icons icon media
text message content thread count counter stories story news primary secondary global sticky fixed mobile desktop floating inline
region zone group card cards grid feed main the js policy bottombar holder""")
HAVING = _words("has have with without no not is hide show after before under near")
COMMENTS = _words("comment comments commentlist disqus discussion replies reply respond")
#: Class or id values of a page's main part.
MAIN = _words("""main content main-content maincontent page-content article article-body article-content post post-content
post-body entry entry-content story story-body""")

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
END_OF_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


@lru_cache(maxsize=1 << 16)
def sign_of(name: str, within: bool = False, box: bool = False) -> frozenset:
    """The signs of a class or id name, none if the name as a whole is about something else. ``within``: it stands in an article, ``box``: on an
    element that holds others."""
    tokens = [t.lower() for t in TOKEN.findall(name)]
    held = frozenset(tokens) & SIGNS
    subjects = SUBJECTS - BOXED if box else SUBJECTS
    if not held or not HAVING.isdisjoint(tokens) or within and len(tokens) == 1 and held <= subjects:
        return frozenset()
    if tokens[-1] in SIGNS and not (within and tokens[-1] in subjects and tokens[0] not in SIGNS | PARTS):
        return held
    return held if all(t in SIGNS or t in PARTS for t in tokens) else frozenset()


class Page:
    """Elements (parallel lists) and text blocks of a page."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.out, self.root, self.digest = [""], [-1], [False], [False], [0]
        self.signed: dict[int, frozenset] = {}  # elements that go by a sign alone
        self.blocks: list[tuple[str, int]] = []
        self._stack, self._parts, self._own = [0], [], [[]]
        self._open, self._roots = Counter(), 0  # open elements by name, and open marked parts
        self._before: dict[int, list[str]] = {}  # text that an inline element outside the article interrupts
        self._parse(html)
        self._flush()
        self._pop_to(1)
        self._settle()

    def _settle(self) -> None:
        """Where signs take every marked article, those that are no comments give the elements around it back."""
        n = len(self.tag)
        covered, kept_out = [False] * n, [False] * n  # by any element outside the article; by one that no sign alone put there, or comments
        for e in range(1, n):
            up = self.parent[e]
            covered[e] = covered[up] or self.out[e]
            kept_out[e] = kept_out[up] or self.out[e] and not (e in self.signed and COMMENTS.isdisjoint(self.signed[e]))
        roots = [e for e in range(n) if self.root[e]]
        if roots and all(covered[e] for e in roots):
            seen: set[int] = set()
            for e in roots:
                while not kept_out[e] and e > 0 and e not in seen:
                    seen.add(e)
                    self.out[e] = False
                    e = self.parent[e]

    def _parse(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            found = TAG.search(html, at)
            if not found:
                self._text(html[at:])
                return
            if found.start() > at:
                self._text(html[at:found.start()])
            at = found.end()
            name = found[2]
            if not name:
                continue
            name = name.lower()
            if found[1]:
                self._end(name)
                continue
            self._start(name, found[3])
            if name in RAW:
                end = END_OF_RAW[name].search(html, at)
                at = end.start() if end else n
                self._end(name)

    def _text(self, text: str) -> None:
        self._parts.append(unescape(text) if "&" in text else text)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            self._parts = []
            if text:
                self._own[-1].append(text)
                self.blocks.append((text, self._stack[-1]))

    def _pop(self) -> None:
        import xxhash

        element, own = self._stack.pop(), self._own.pop()
        self._open[self.tag[element]] -= 1
        self._roots -= self.root[element]
        if element in self._before:
            self._parts = self._before.pop(element)
        if own:
            content = "\x00".join([self.tag[element], *map(str, own)])
            self.digest[element] = xxhash.xxh64_intdigest(content) >> 1
            self._own[-1].append(self.digest[element])

    def _pop_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            self._pop()
            if len(self._stack) > depth:
                self._flush()

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._parts.append(" ")
            return
        if name in BLOCKS:
            self._flush()
            if name in ENDS_P:
                self._close(_words("p"))
            if name in CLOSES:
                self._close(CLOSES[name])
        if name in VOID or (attributes.endswith("/") and name not in BLOCKS):
            return
        if name not in BLOCKS and name not in OUTSIDE and not attributes.strip():
            return  # plain inline markup
        out, root, signs = self._kind(name, attributes)
        if signs:
            self.signed[len(self.tag)] = signs
        self.tag.append(name)
        self.parent.append(self._stack[-1])
        self.out.append(out)
        self.root.append(root)
        self.digest.append(0)
        if out and name not in BLOCKS:
            self._before[len(self.tag) - 1], self._parts = self._parts, []
        self._stack.append(len(self.tag) - 1)
        self._own.append([])
        self._open[name] += 1
        self._roots += root

    def _kind(self, name: str, attributes: str) -> tuple[bool, bool, frozenset]:
        """(is outside any article, marks the article, the signs by which alone it is outside)."""
        none: frozenset = frozenset()
        if name in OUTSIDE:
            return True, False, none
        root = name in ("article", "main")
        if not attributes or attributes.isspace():
            return name == "header" and not self._within(), root, none
        held = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
        role = held.get("role", "").lower()
        names = f"{held.get('class', '')} {held.get('id', '')}".split()
        within = self._within()
        signs = frozenset().union(*[sign_of(x, within, name in BOXES) for x in names])
        if role == "main" or "articlebody" in held.get("itemprop", "").lower() or name in BLOCKS and not MAIN.isdisjoint(x.lower() for x in names):
            root = True
        if name in ("html", "body", "main") or name == "article" and not signs & (COMMENTS | {"ad", "ads"}):
            return False, root, none
        hidden = "hidden" in held or held.get("aria-hidden") == "true" or "display:none" in held.get("style", "").replace(" ", "")
        head = (name == "header" or any(TOKEN.findall(x)[-1:] == ["header"] for x in names)) and not within
        other = bool(hidden or head or role in ROLES)
        return other or bool(signs), root and not other and not signs, none if other else signs

    def _within(self) -> bool:
        return self._roots > 0

    def _close(self, names: frozenset) -> None:
        if not any(self._open[name] for name in names):
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            name = self.tag[self._stack[depth]]
            if name in names:
                self._flush()
                self._pop_to(depth)
                return
            if name in FENCES:
                return

    def _end(self, name: str) -> None:
        if name in BLOCKS:
            self._flush()
        if not self._open[name]:
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            if self.tag[self._stack[depth]] == name:
                self._pop_to(depth)
                return

    def _marks(self, drop: set[int]) -> list[tuple[bool, bool]]:
        """Per element (deleted, inside the article), its ancestors' marks included."""
        marks: list[tuple[bool, bool]] = [(False, False)]
        for e in range(1, len(self.tag)):
            deleted, inside = marks[self.parent[e]]
            marks.append((deleted or self.out[e] or self.digest[e] in drop, inside or self.root[e]))
        return marks

    def subtrees(self) -> list[tuple[int, bool | None, int, bool]]:
        """(hash, inside, longest own block, has a sign) of the subtrees with text, those that a sign takes included, what lies in them not; inside is
        null for those that are never deleted by recurrence: the marked parts and the page as a whole."""
        longest: dict[int, int] = {}
        for text, e in self.blocks:
            longest[e] = max(longest.get(e, 0), len(text))
        found: dict[tuple, tuple[int, bool]] = {}
        marks = self._marks(set())
        for e, (deleted, inside) in enumerate(marks):
            if self.digest[e] and not (e and marks[self.parent[e]][0]):
                key = (self.digest[e], None if self.root[e] or self.tag[e] in ("html", "body", "") else inside)
                # Blocks that a sign takes do not tell pages apart.
                size, signed = found.get(key, (0, False))
                found[key] = max(size, 0 if deleted else longest.get(e, 0)), signed or deleted
        return [(*key, *x) for key, x in found.items() if key[1] is not None or x[0]]

    def text(self, drop: set[int]) -> str:
        return self.extracted(drop)[0]

    def extracted(self, drop: set[int]) -> tuple[str, int, int]:
        """(text, subtrees deleted because they recur, subtrees with text deleted by a sign alone)."""
        marks, recurring, signed = self._marks(drop), 0, 0
        for e in range(1, len(self.tag)):
            if self.digest[e] and marks[e][0] and not marks[self.parent[e]][0]:
                recurring, signed = (recurring + 1, signed) if self.digest[e] in drop else (recurring, signed + 1)
        kept = [(text, marks[e][1]) for text, e in self.blocks if not marks[e][0]]
        if any(inside for _, inside in kept):
            kept = [x for x in kept if x[1]]
        return "\n\n".join(text for text, _ in kept), recurring, signed


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _subtree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            rows = [(key, host, *found) for key, host, html in zip(*[part.column(c).to_pylist() for c in ("key", "host", "html")], strict=True)
                    for found in Page(html).subtrees()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.binary(), pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["key", "host", "digest", "inside", "size", "signed"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            found = [Page(html).extracted(set(drop or ())) if html else ("", 0, 0)
                     for html, drop in zip(part.column("html").to_pylist(), part.column("drop").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), *[pa.array(c, k) for c, k in zip(
                    zip(*found, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)]], names=["page_id", "url", "text", "n_recurring", "n_signed"])


def templates(pages: DataFrame) -> DataFrame:
    """(key, drop): for each page that has any, the hashes of its template subtrees."""
    found = written(pages.where("html <> ''").select("key", host_of(F.col("url")).alias("host"), "html").mapInArrow(
        _subtree_rows, "key binary, host string, digest long, inside boolean, size int, signed boolean"), "page-subtrees")
    # Joined back, the counts are plain written tables, so that adaptive execution may split hot hosts and blocks.
    own = found.where("size > 0").select("key", "host", "digest", "size").groupBy("key", "host", "digest").agg(F.max("size").alias("size"))
    often = written(own.groupBy("host", "digest").agg(F.count("*").alias("n")).where("n > 1"), "page-blocks")
    weight = F.col("size") / F.coalesce("n", F.lit(1))
    told = own.join(often, ["host", "digest"], "left").groupBy("key").agg(F.max(F.struct(weight.alias("w"), "digest"))["digest"].alias("told"))
    found = found.join(told, "key").select("key", "host", "digest", "inside", "signed", "told")
    per_host = found.select("host", "told").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    found = found.where("inside IS NOT NULL")
    counted = found.groupBy("host", "digest", "inside", "told").agg(F.max("signed").alias("signed")).groupBy("host", "digest", "inside").agg(
        F.count("*").alias("n"), F.max("signed").alias("signed")).where(F.col("n") >= LEAST_PAGES)
    enough = F.when(F.col("inside"), (F.col("n") >= INSIDE_PAGES) & (F.col("n") >= INSIDE_SHARE * F.col("pages"))).otherwise(
        F.col("signed") | (F.col("n") >= LEAST_SHARE * F.col("pages")) | (F.col("n") >= MANY_PAGES))
    recurring = written(counted.join(per_host, "host").where(enough).select("host", "digest", "inside"), "page-recurring")
    return found.join(recurring, ["host", "digest", "inside"]).groupBy("key").agg(
        F.collect_set("digest").alias("drop"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_recurring, n_signed) of every page: its text, how many of its subtrees were deleted because they recur on the host, and
    how many others with text by a sign alone."""
    pages = pages.select("page_id", "url", "html", row_key("page_id", "url", "html").alias("key"))
    drops = written(templates(pages), "page-templates")
    held = drops.agg(F.count("*"), F.sum(F.size("drop"))).first()
    drops = F.broadcast(drops) if 64 * held[0] + 8 * (held[1] or 0) <= BROADCAST_BYTES else drops
    both = pages.join(drops, "key", "left").select("page_id", "url", "html", "drop")
    schema = "page_id {}, url string, text string, n_recurring long, n_signed long".format(pages.schema["page_id"].dataType.simpleString())
    return both.mapInArrow(_texts, schema)
