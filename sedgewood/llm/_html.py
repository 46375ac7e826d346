"""A forgiving HTML reader: blocks of text, and the elements as ranges of them.

It reads tags, comments, and the raw bodies of scripts and styles, and closes what a start tag implies closed.  An
element's hash is made from its tags, its text and the hashes of the elements in it, so a page is read in time linear in
its length, however deep its elements lie and whatever stays open.  It is no browser: tables and lists are plain blocks.

Menus, footers, forms and the like are known by tag and role.  A class or id is only believed if more speaks for it.
Outside of articles the element must hold less than half of the page, or an article must lie outside of it.  Within an article all words of the name must mean
furniture or layout (``share-buttons``, not ``share-price``) and the element hold less than a quarter of the article, or
half if one of ``STEMS`` is in it; or half of its text must be links.  Comments may be of any length, but follow a text; they are also known by a heading
such as "3 responses".
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import xxhash

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_ENDS = re.compile("[>\"']")
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

#: Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg annotation annotation-xml object select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd caption figcaption summary address td th tr tbody thead tfoot table body html".split())
EXCLUDED = frozenset("nav header footer aside form head button dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
LABELS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification popup modal overlay "
    "newsletter subscribe signup sidebar comment comments disqus reply replies respond menu nav navbar navigation breadcrumb breadcrumbs footer header masthead toolbar "
    "social share sharing related widget pagination pager".split()
)
#: Parts of longer labels that mean the same wherever they stand.
STEMS = ("comment", "cookie", "advert", "sidebar", "newsletter", "disqus", "sponsor", "navbar", "breadcrumb", "masthead")
#: Words that say nothing more in a label.
LAYOUT = frozenset(
    "box block list container wrapper wrap bar area section sections buttons button links link icons icon posts articles slot unit top bottom left right inner outer main page "
    "site post article content items item panel card inline user group row holder module text title heading form count counter js the".split()
)
#: What a label may say of comments without being their place; and headings of comments, after their number.
STATES = frozenset("has no with without allow enable enabled open closed".split())
_REMARKS = re.compile(r"\s*\d{1,7}\s+(?:reader\s+|user\s+)?(?:comments?|responses?|replies|reply|kommentare?|antworten|commentaires?|réponses?|comentarios?|respuestas?)\b.{0,40}$", re.I | re.S)
_LABEL = re.compile("[a-z]+")
#: How far a label is believed: not at all, with links, in an element of less than a quarter or half of the text, as comments.
NONE, WEAK, STRONG, SURE, REMARKS = range(5)
#: A start tag of the key's kind closes an open element of these kinds.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}, "body": {"head"}}
_SCOPES = frozenset("table ul ol dl article section div main body html aside nav footer header form blockquote figure".split())


#: Kinds of elements that a page keeps: a container, main, an article, an article whose labels speak against it.
CONTAINER, MAIN, ARTICLE, SUSPECT = range(4)


@dataclass
class Element:
    tag: str
    first: int  # number of its first block
    excluded: bool
    kind: int = -1
    place: int = -1  # among the page's elements
    state: object = None  # running hash of what it holds
    form_main: bool = False  # a form that holds an article or main
    label: int = 0  # what its labels say
    scope: int = -1  # place of the article or main that it lies in


@dataclass
class Page:
    """Blocks of text that no excluded element holds, and the elements as ranges of blocks, outer ones first."""

    blocks: list[str] = field(default_factory=list)
    elements: list[tuple[int, int, int, int]] = field(default_factory=list)  # first block, block after the last, kind, hash of markup and content


def _meaning(name: str, inside: bool) -> int:
    """How far one class or id is believed; within an article only if all its words are furniture or layout."""
    words = _LABEL.findall(name.lower())
    stem = any(s in w for w in words for s in STEMS)
    if not stem and LABELS.isdisjoint(words):
        return NONE
    if not inside:
        return SURE
    if not STATES.isdisjoint(words):
        return NONE
    known = all(w in LABELS or w in LAYOUT or any(s in w for s in STEMS) for w in words)
    if any("comment" in w or w in ("disqus", "replies") for w in words):
        return REMARKS if known else WEAK
    return (SURE if stem else STRONG) if known else WEAK


def _labelled(attrs: str, inside: bool) -> tuple[bool, bool, int]:
    """Whether the attributes hide an element, whether its role is no content, and how far its classes and id say that it is none."""
    hidden, role, label = False, False, NONE
    if attrs and ("=" in attrs or "hidden" in attrs.lower()):
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            low = value.lower()
            hidden |= name == "hidden" and low in ("", "hidden", "true") or name == "aria-hidden" and low == "true"
            role |= name == "role" and low in ROLES
            if name in ("class", "id"):
                label = max([label, *(_meaning(v, inside) for v in value.split())])
    return hidden, role, label


class _Reader:
    """One pass over a page; each character, tag and element is handled a bounded number of times."""

    def __init__(self, html: str):
        self.html, self.at = html, 0
        self.stack: list[Element] = []
        self.scopes: list[dict[str, int]] = [{}]  # open elements by tag since each enclosing scope
        self.open: dict[str, int] = {}
        self.text: list[str] = []
        self.blocks: list[str] = []
        self.elements: list[list] = []
        self.gone: list[tuple[int, int]] = []  # blocks of excluded elements
        self.doubts: list[tuple[int, int, int, int]] = []  # blocks of labelled elements, their scope and label
        self.within: list[int] = []  # scope of each element
        self.articles: list[int] = []  # places of the open articles and mains
        self.forms: list[Element] = []
        self.linked, self.link_chars = False, 0
        self.links: list[int] = []  # characters of each block that are in links
        self.holders: list[Element] = []  # open elements with a hash
        self.muted = 0  # open inline elements that are excluded
        self.quoted = True

    def tag_end(self, at: int) -> int:
        """Where the tag that is open at ``at`` ends, past its ``>``; quotes count until one of them stays open."""
        html, k = self.html, at
        while self.quoted:
            m = _ENDS.search(html, k)
            if m is None:
                self.quoted = False
            elif m[0] == ">":
                return m.end()
            else:
                k = html.find(m[0], m.end()) + 1
                self.quoted = k > 0
        return html.find(">", at) + 1

    def flush(self) -> None:
        if self.text:
            body = "".join(self.text)
            self.text.clear()
            if body and not body.isspace():
                self.blocks.append(body)
                self.links.append(self.link_chars)
            self.link_chars = 0

    def say(self, raw: str) -> None:
        if self.holders:
            self.holders[-1].state.update(raw.encode("utf-8", "surrogatepass"))

    def push(self, e: Element) -> None:
        self.stack.append(e)
        self.open[e.tag] = self.open.get(e.tag, 0) + 1
        self.scopes[-1][e.tag] = self.scopes[-1].get(e.tag, 0) + 1
        if e.tag in _SCOPES:
            self.scopes.append({})

    def pop(self) -> None:
        e = self.stack.pop()
        if e.tag in _SCOPES:
            self.scopes.pop()
        self.open[e.tag] -= 1
        self.scopes[-1][e.tag] -= 1
        if e.tag == "form":
            self.forms.pop()
            if self.forms:
                self.forms[-1].form_main |= e.form_main
        if e.label and len(self.blocks) > e.first:
            self.doubts.append((e.first, len(self.blocks), e.scope, e.label))
        if e.kind < 0:
            if e.tag not in BLOCK:
                self.muted -= e.excluded
            elif e.excluded:
                self.exclude(e)
            return
        if e.kind != CONTAINER:
            self.articles.pop()
        self.holders.pop()
        digest = e.state.digest()
        if self.holders:
            self.holders[-1].state.update(digest)
        self.elements[e.place][1:] = [len(self.blocks), e.kind, int.from_bytes(digest, "big") - (1 << 63)]
        if e.excluded:
            self.exclude(e)

    def exclude(self, e: Element) -> None:
        if len(self.blocks) > e.first and not e.form_main:
            self.gone.append((e.first, len(self.blocks)))

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            self.pop()

    def end_tag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        self.linked &= tag != "a"
        if self.open.get(tag):
            k = len(self.stack) - 1
            while self.stack[k].tag != tag:
                k -= 1
            self.pop_to(k)

    def start_tag(self, tag: str, attrs: str, raw: str) -> None:
        if tag in VOID or tag in ("td", "th"):
            self.text.append(" ")
            return
        hidden, role, label = _labelled(attrs, bool(self.articles))
        if tag not in BLOCK:
            # within an article, a labelled link or word is part of its sentence
            if hidden or role or tag in EXCLUDED or label and not self.articles:
                self.push(Element(tag, len(self.blocks), True))
                self.muted += 1
            self.linked |= tag == "a"
            return
        self.linked = False
        self.flush()
        shut = _CLOSES.get(tag, frozenset()) | {"p"}
        inner = self.scopes[-1]
        if any(inner.get(t) for t in shut) or tag == "body" and self.open.get("head"):
            k = len(self.stack) - 1
            while self.stack[k].tag not in shut:
                k -= 1
            self.pop_to(k)
        article = tag in ("article", "main")
        # the heading of an article is its own; labels of a page or an article say nothing about its text
        excluded = hidden or tag in EXCLUDED and not (tag == "header" and self.articles) or role and not article and tag not in ("html", "body")
        e = Element(tag, len(self.blocks), excluded, scope=self.articles[-1] if self.articles else -1)
        if not article and tag not in ("html", "body"):
            e.label = label
        if tag == "form":
            self.forms.append(e)
        if tag not in PROSE:
            e.kind = (SUSPECT if role or label else ARTICLE) if tag == "article" else MAIN if article else CONTAINER
            e.place, e.state = len(self.elements), xxhash.xxh64(raw.encode("utf-8", "surrogatepass"))
            self.elements.append([e.first, e.first, e.kind, 0])
            self.within.append(e.scope)
            self.holders.append(e)
            if article:
                self.articles.append(e.place)
                if self.forms:
                    self.forms[-1].form_main = True
        self.push(e)

    def read(self) -> Page:
        html, n = self.html, len(self.html)
        while self.at < n:
            lt = html.find("<", self.at)
            if lt < 0:
                lt = n
            m = _NAME.match(html, lt + 1) if lt < n else None
            if m is None and lt < n and html[lt + 1 : lt + 2] not in ("!", "?"):
                lt += 1  # a lone < is text
                if self.at < lt:
                    self.words(html[self.at : lt])
                self.at = lt
                continue
            if self.at < lt:
                self.words(html[self.at : lt])
            if lt == n:
                break
            if m is None:
                close = html.find("-->", lt + 4) + 3 if html.startswith("<!--", lt) else html.find(">", lt) + 1
                self.at = close if close > 2 else n
                continue
            end = self.tag_end(m.end())
            if not end:  # a tag that never ends is text, and so is all after it
                self.words(html[lt:])
                break
            raw, tag = html[lt:end], m[0].lower()
            self.at = end
            if tag[0] == "/":
                self.say(raw)
                self.end_tag(tag[1:])
            elif tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, end)
                self.at = close.end() if close else n
            else:
                if tag in BLOCK and tag not in PROSE:
                    self.start_tag(tag, html[m.end() : end - 1], raw)
                else:
                    self.say(raw)
                    self.start_tag(tag, html[m.end() : end - 1], raw)
        self.flush()
        self.pop_to(0)
        return self.page()

    def words(self, raw: str) -> None:
        self.say(raw)
        if not self.muted:
            self.text.append(raw)
            if self.linked:
                self.link_chars += len(raw.strip())

    def believed(self) -> list[tuple[int, int]]:
        """The blocks of labelled elements, and of comments by their heading, that what else is known speaks against."""
        n = len(self.blocks)
        gone = [0] * (n + 1)
        for a, b in self.gone:
            gone[a] += 1
            gone[b] -= 1
        text, links, depth = [0], [0], 0
        for i, block in enumerate(self.blocks):
            depth += gone[i]
            text.append(text[-1] + (0 if depth else len(block.strip())))
            links.append(links[-1] + (0 if depth else self.links[i]))
        out = []
        mains = [(a, b) for a, b, kind, _ in self.elements if kind != CONTAINER and text[b] > text[a]]
        first, last = min((a for a, _ in mains), default=n), max((b for _, b in mains), default=0)
        for a, b, scope, label in self.doubts:
            start, stop = self.elements[scope][:2] if scope >= 0 else (0, n)
            size, whole = text[b] - text[a], text[stop] - text[start]
            linked = 2 * (links[b] - links[a]) >= size
            after = text[a] > text[start]  # comments follow a text
            if linked and size < whole or label == STRONG and 4 * size < whole or label == SURE and (2 * size < whole or scope < 0 and (first < a or last > b)) or label == REMARKS and after:
                out.append((a, b))
        heads = {i for i, block in enumerate(self.blocks) if len(block) < 200 and _REMARKS.match(unescape(block))}
        for (a, b, kind, _), scope in zip(self.elements, self.within, strict=True) if heads else ():
            if kind == CONTAINER and a in heads and b > a + 1 and text[a] > text[self.elements[scope][0] if scope >= 0 else 0]:
                out.append((a, b))
        return out

    def page(self) -> Page:
        left = [0] * (len(self.blocks) + 1)
        for a, b in self.gone + self.believed():
            left[a] += 1
            left[b] -= 1
        depth, place, blocks = 0, [0] * (len(left)), []
        for i, block in enumerate(self.blocks):
            depth += left[i]
            if not depth:
                blocks.append(block)
            place[i + 1] = len(blocks)
        return Page(blocks, [(place[a], place[b], kind, h) for a, b, kind, h in self.elements if place[a] < place[b]])


def read(html: str) -> Page:
    return _Reader(html).read()
