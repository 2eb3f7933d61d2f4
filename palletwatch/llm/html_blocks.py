"""Pages as flat text blocks, read in one forward pass that forgives unclosed tags."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache

# Elements whose content is never text of the page. Raw ones hold no tags, and an unclosed one takes the rest.
RAW = "script style noscript iframe textarea".split()
UNSEEN = set("template svg math object canvas audio video select datalist button".split())
NESTING = {"template", "svg", "math", "object"}  # others end where the next of their name begins
VOID = set("area base br col embed hr img input link meta param source track wbr".split())

TOKEN = re.compile(
    r"(<(?:"
    r"/?(?!(?:" + "|".join(RAW) + r")(?![^\s/>]))[a-z](?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*>"
    r"|!--.*?(?:--!?>|\Z)"
    r"|(" + "|".join(RAW) + r")(?![^\s/>])[^<>]*>.*?(?:</\2\b[^<>]*(?:>|\Z)|\Z)"
    r"|/?[a-z][^<>]*>"
    r"|[!?/][^<>]*>))",
    re.I | re.S,
)
NAME = re.compile(r"</?\s*([a-z][a-z0-9]*)", re.I)
HINTS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
HIDDEN = re.compile(r"\s(?:hidden(?=[\s/>=])|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)

INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
# Elements whose extent is followed; others only part blocks.
FOLLOWED = set(
    "article main nav header footer aside form menu dialog section div ul ol li table blockquote figure fieldset address "
    "details head span".split()
)
PARAGRAPHS = set("p li dd dt blockquote td th pre figcaption caption".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ASIDE_TAGS = set("nav footer aside form menu dialog head".split())
MAIN_TAGS = {"article", "main"}
# Words in class, id or role that name what stands beside an article, or the article.
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promoted promotion nav navbar "
    "subnav topnav sidenav mainnav navigation menu mainmenu menubar sidebar rail aside complementary comment comments commentlist "
    "discussion reply replies responses disqus respond footer contentinfo masthead topbar cookie cookies consent gdpr notice "
    "notices notification alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended popular trending breadcrumb breadcrumbs pagination pager search widget widgets toolbar copyright legal "
    "disclaimer tags form".split()
)
# Of these, such as are common in names of an article's own parts. Inside an article they count only where all words of the name are
# of this kind or say nothing: share, post-share-2, related-posts, but not form-description.
LOOSE_WORDS = set(
    "form related share sharing social tags search notice notices notification alert alerts discussion reply replies responses "
    "recommended popular trending legal disclaimer copyright login widget widgets toolbar rail complementary contentinfo footer comment".split()
)
EMPTY_WORDS = set(
    "post posts article articles story stories entry user users reader readers site page box boxes block blocks list section area "
    "container wrapper inner outer item items button buttons link links bar panel group top bottom left right inline main body".split()
)
HEADER_WORDS = {"header", "siteheader", "pageheader"}  # as the element of that name
MAIN_WORDS = set("article articlebody main maincontent content entry post story".split())
# Beside one of the words above, these name a layout around it: has-sidebar, content-sidebar-wrap.
LAYOUT_WORDS = set("has with no wrap layout content".split())
WORD = re.compile(r"[a-z0-9]+")
# Where an unclosed unseen element ends at the latest.
PARTING = FOLLOWED - {"span", "head"} | HEADINGS | set("p pre hr body html tr td th dl dt dd tbody thead tfoot caption figcaption summary".split())
FULL_NAME = re.compile(r"<(/?)([a-z][^\s/>]*)", re.I)
HAS_UNSEEN = re.compile(r"<(?:" + "|".join(sorted(UNSEEN)) + r")(?![^\s/>])", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int  # words inside links
    aside: bool  # inside something named as no part of an article
    main: bool  # inside an article
    heading: bool
    paragraph: bool = False  # a paragraph, an item of a list, a quotation or a cell
    named: bool = False  # an aside inside an article, for no more than a class or id


@lru_cache(4096)
def _sort(name: str, tag: str, inside_main: bool) -> tuple[bool, bool, bool]:
    """Whether an element begins something beside an article, for more than its class or id, or begins an article."""
    words: set[str] = set()
    roles: set[str] = set()
    if "=" in tag:
        for kind, *values in HINTS.findall(tag):
            for value in "".join(values).lower().split():
                found = set(WORD.findall(value))
                if kind.lower() == "role":
                    roles |= found
                elif not (found & LAYOUT_WORDS and found & (ASIDE_WORDS | HEADER_WORDS)):
                    plain = {w for w in found - ASIDE_WORDS - EMPTY_WORDS if not any(c.isdigit() for c in w)}
                    words |= found - LOOSE_WORDS if inside_main and plain else found
    inner = name in MAIN_TAGS
    firm = (
        name in ASIDE_TAGS or not inside_main and name == "header" or bool(roles & ASIDE_WORDS) and not inner
        or bool(HIDDEN.search(tag))
    )
    aside = (
        firm or not inside_main and bool((words | roles) & HEADER_WORDS) and not inner
        or bool(words & ASIDE_WORDS) and not inner
    )
    return aside, firm, not aside and (inner or bool((words | roles) & MAIN_WORDS))


@lru_cache(4096)
def _is_named_aside(tag: str) -> bool:
    """Whether an article's own class, id or role names it as something beside the article of the page."""
    return _sort("div", tag, True)[0]


def _unseen(tags: list[str]) -> tuple[set[int], set[int]]:
    """Which tags are part of unseen elements, and before which tags the text is.

    An element ends at its end tag. One that has none before an enclosing element ends, or before the
    next of its name begins, ends at the next block or there, whichever is first.
    """
    open_: list[tuple[str, int, int]] = []  # name, its tag, and the first block after it
    number: dict[str, int] = {}
    waiting: list[int] = []  # places in open_ of unseen elements without a block after them
    hidden: set[int] = set()
    before: set[int] = set()
    until = -1  # all up to this tag is hidden

    def hide(first: int, last: int, closed: bool) -> None:
        nonlocal until
        hidden.update(range(max(first, until), last + closed))
        before.update(range(max(first, until) + 1, last + 1))
        until = max(until, last)

    def pop(to: int, at: int, closed: bool) -> None:
        ends = []
        while len(open_) > to:
            name, start, block = open_.pop()
            number[name] -= 1
            if name in UNSEEN:
                ends.append((start, at if closed and len(open_) == to else min(block, at), closed and len(open_) == to))
        for start, end, whole in reversed(ends):  # the outer one first
            if end > until or start > until:
                hide(start, end, whole)
        while waiting and waiting[-1] >= to:
            waiting.pop()

    for i, tag in enumerate(tags):
        match = FULL_NAME.match(tag)
        if not match:
            continue
        name = match[2].lower()
        if match[1]:
            if number.get(name):
                to = next(k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name)
                pop(to, i, True)
            continue
        if name in PARTING:
            for k in waiting:
                open_[k] = (*open_[k][:2], i)
            waiting.clear()
        if name in VOID:
            continue
        if name in UNSEEN:
            if name in ("svg", "math") and tag.endswith("/>"):
                hidden.add(i)
                continue
            if name not in NESTING and number.get(name):
                pop(next(k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name), i, False)
            waiting.append(len(open_))
        open_.append((name, i, len(tags)))
        number[name] = number.get(name, 0) + 1
    pop(0, len(tags), False)
    return hidden, before


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order: references decoded, white space made one space, ends trimmed."""
    found: list[Block] = []
    parts: list[tuple[str, bool]] = []
    open_: list[tuple[str, bool, bool, bool]] = []  # followed elements: name, and what was in force before
    aside = firm = main = heading = paragraph = False  # firm: an aside for more than a class or id
    outside = False  # the aside began outside an article
    alone = alone_firm = False  # the block that is open is an aside by itself
    links = False

    def flush() -> None:
        whole = "".join([part for part, _ in parts])
        words = (html.unescape(whole) if "&" in whole else whole).split()
        if words:
            linked = sum([len(part.split()) for part, inside in parts if inside])
            found.append(Block(" ".join(words), len(words), min(linked, len(words)), aside or alone, main, heading, paragraph, not (firm or alone_firm or aside and outside)))
        parts.clear()

    pieces = TOKEN.split(page)
    hidden, before = _unseen(pieces[1::3]) if HAS_UNSEEN.search(page) else (set(), set())
    for i, (text, tag, unseen) in enumerate(zip(pieces[::3], [*pieces[1::3], ""], [*pieces[2::3], ""], strict=True)):
        if text and i not in before:
            parts.append((text, links))
        match = None if unseen or i in hidden else NAME.match(tag)
        if not match:
            continue
        name = match[1].lower()
        closing = tag[1] == "/"
        if name == "br":
            parts.append((" ", False))
            continue
        if name == "a":
            links = not closing
            continue
        if name not in INLINE:
            if parts:
                flush()
            links = False
            heading = not closing and name in HEADINGS
            paragraph = not closing and name in PARAGRAPHS
            alone, alone_firm = _sort(name, tag, main)[:2] if not closing and name not in FOLLOWED and "=" in tag else (False, False)
            if name == "body":
                open_, aside, firm, main = [], False, False, False
        if name not in FOLLOWED:
            continue
        if closing:
            for depth in range(len(open_) - 1, -1, -1):
                if open_[depth][0] == name:
                    if name == "span" and (aside, firm, main) != open_[depth][1:] and parts:
                        flush()
                    aside, firm, main = open_[depth][1:]
                    del open_[depth:]
                    break
        else:
            if name == "li" and open_ and open_[-1][0] == "li":  # the one before was left open
                _, aside, firm, main = open_.pop()
            to_aside, to_firm, to_main = _sort(name, tag, main)
            open_.append((name, aside, firm, main))
            if to_aside and not aside:
                if name == "span" and parts:
                    flush()
                aside, firm, outside = True, to_firm, not main
            elif to_firm:
                firm = True
            elif aside and not firm and not main and name in MAIN_TAGS and not _is_named_aside(tag):
                aside, main = False, True
            elif to_main and name != "span":
                main = True
    if parts:
        flush()
    if not any(block.main and not block.aside for block in found):  # all of an article cannot stand beside it
        for block in found:
            block.aside &= not (block.main and block.named)
    return found
