"""Text blocks of a page: one pass over the markup, no tree.

A block is the text between two block-level tags. It knows how many of its words stand in links, whether it is a heading and what
the elements around it say about themselves by their name, class, id and role. The scan follows the markup as far as browsers do:
comments, raw-text elements, quoted attributes, paragraphs and list items closed by what follows, missing and stray end tags.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from typing import NamedTuple

#: Elements, by their part in the standard. Fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements whose content is no text of the page.
HIDDEN = frozenset("head script style template svg math iframe object audio video canvas map select datalist textarea button xmp noembed noframes noscript title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold what is not the article, and words in class, id or role that say so or the contrary.
NOISE = frozenset("nav footer aside menu dialog fieldset".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts adv advertisement advertisements advertising banner sponsor sponsored promo promotion menu nav navbar navigation sidenav sidebar aside rail widget widgets complementary "
    "masthead topbar toolbar breadcrumb breadcrumbs footer foot contentinfo copyright legal cookie cookies consent gdpr notice notices notification alert disclaimer popup modal overlay dialog "
    "comment comments commentlist disqus replies respond discussion share sharing social follow related recommended recommendations teaser teasers newsletter subscribe subscription signup "
    "login signin search searchbox form pagination pager tags tagcloud paywall".split()
)
HEADER_WORDS = frozenset("header".split())
MAIN_WORDS = frozenset("article articlebody post postbody entry story storybody main content maincontent text".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    heading: bool
    noise: bool  # an element around it is, or names itself, something other than the article
    header: bool
    main: bool
    label: str | None  # of the nearest element with a data-label, which the labelled examples have


def _named(attributes: dict[str, str]) -> set[str]:
    """The words of class, id and role, split at signs and at changes of case. Names such as with-sidebar tell of the page, not of the element."""
    out: set[str] = set()
    for key in ("class", "id", "role"):
        for name in attributes.get(key, "").split():
            words = _WORD.findall(_CAMEL.sub(" ", name).lower())
            if words and words[0] not in ("with", "has", "no"):
                out.update(words)
    return out


def _kinds(name: str, attributes: dict[str, str], inside: Counter[str]) -> list[str]:
    """What an element adds to the context of the text inside it."""
    if name in ("html", "body"):
        return []
    kinds = []
    words = _named(attributes) if attributes else set()
    if noise := name in NOISE or words & NOISE_WORDS and name not in ("article", "main") or name == "article" and "comment" in words:
        kinds.append("noise")
    if name == "header" or words & HEADER_WORDS:
        kinds.append("header")
    if name == "form":
        kinds.append("form")
    if name in ("article", "main") or words & MAIN_WORDS and not noise:
        kinds += ["main", "main in form"] if inside["form"] else ["main"]
    if name in HIDDEN or "hidden" in attributes or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        kinds.append("hidden")
    if name == "a":
        kinds.append("link")
    if name in HEADINGS:
        kinds.append("heading")
    return kinds


def text_blocks(page: str | None) -> list[Block]:
    """The blocks with at least one word, in page order; white space inside a block is one space. A null page has none."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, list[str], str | None]] = []
    open_names: Counter[str] = Counter()
    inside: Counter[str] = Counter()
    pieces: list[tuple[str, bool]] = []  # text and whether it stands in a link
    context: tuple | None = None
    missing: set[str] = set()  # what is searched for and found no more

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        at = page.find(what, start)
        if at < 0:
            missing.add(what)
        return at

    def flush() -> None:
        nonlocal context
        if pieces:
            text = " ".join("".join(t for t, _ in pieces).split())
            if text:
                linked = sum(len(t.split()) for t, link in pieces if link)
                words = text.count(" ") + 1
                out.append(Block(text, words, min(words, linked), *context))
        pieces.clear()
        context = None

    def add(text: str) -> None:
        nonlocal context
        if inside["hidden"] or not text:
            return
        if context is None and not text.isspace():
            noise = inside["noise"] > 0 or inside["form"] > 0 and not inside["main in form"]
            context = (inside["heading"] > 0, noise, inside["header"] > 0, inside["main"] > 0, next((s[2] for s in reversed(stack) if s[2]), None) if labelled else None)
        pieces.append((text, inside["link"] > 0))

    def close(name: str) -> None:
        """Close the nearest open element of this name and all inside it."""
        while stack:
            top, kinds, _ = stack.pop()
            open_names[top] -= 1
            for k in kinds:
                inside[k] -= 1
            if top == name:
                return

    labelled = "data-label" in page
    i, size = 0, len(page)
    while i < size:
        j = find("<", i)
        j = size if j < 0 else j
        if j > i:
            add(references.unescape(page[i:j]))
        if j == size:
            break
        i = j
        if page.startswith("<!--", i):
            end = find("-->", i + 2)
            i = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), i):
            end = find(">", i)
            i = size if end < 0 else end + 1
            continue
        tag = _TAG.match(page, i) if ">" not in missing else None
        if tag is None:
            follows = page[i + 1 : i + 3].lstrip("/")[:1]
            if follows.isascii() and follows.isalpha():  # a tag cut off by the end of the page
                break
            add("<")
            i += 1
            continue
        i = tag.end()
        name = tag[2].lower()
        if tag[1]:
            if name not in INLINE:
                flush()
            if open_names[name]:
                close(name)
            continue
        if name == "br":
            add(" ")
            continue
        if name not in INLINE:
            flush()
            if open_names["p"] and next((s[0] for s in reversed(stack) if s[0] not in INLINE), "") == "p":
                close("p")
            if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                close(name)
        if name in VOID:
            continue
        attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(tag[3])} if "=" in tag[3] else {}
        if "hidden" in tag[3].lower().split():
            attributes["hidden"] = ""
        if name in RAW:  # no markup inside: go on at its end tag
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, i)
            i = end.start() if end else size
            continue
        if tag[3].endswith("/") and inside["hidden"]:  # drawings close their elements like this
            continue
        kinds = _kinds(name, attributes, inside)
        stack.append((name, kinds, attributes.get("data-label")))
        open_names[name] += 1
        for k in kinds:
            inside[k] += 1
    flush()
    return out
