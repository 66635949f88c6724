"""Wrappers: union-free regular expressions over the token streams of web pages.

A page is a stream of tokens: ``<x>`` and ``</x>`` of elements that part a page
(``article``, ``nav``, ...; ``!`` for any element whose class or id says that it is no
content) and ``#x``, a slot with the text of a block. A wrapper is a list of tokens
with marks: optional, repeated, fixed text. Two streams are aligned; equal tokens
meet, runs of one token or of a group of tokens become repeated, everything else
becomes optional, and a slot whose texts differ is open.
"""

from __future__ import annotations

import html
import json
import re
from dataclasses import astuple, dataclass
from difflib import SequenceMatcher

# Elements by what they do to a page.
CONTENT = {"article", "main"}
APART = {"nav", "footer", "aside", "form", "header", "menu", "dialog"}
DROPPED = {"head", "button", "select", "textarea", "noscript", "template", "svg", "iframe", "object", "label"}
BLOCKS = set(
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption section blockquote pre"
    " figure figcaption hr address details summary fieldset body html hgroup center".split()
) | CONTENT | APART | DROPPED
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Opening one of these ends an open one of the same kind.
SELF_ENDING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Words in a class or id of what is no content.
NOT_CONTENT = set(
    "ad ads advert adverts advertisement advertising banner promo sponsor sponsored nav navbar navigation menu"
    " breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent notice notices newsletter subscribe"
    " share sharing social comment comments disqus reply replies related popup modal pagination".split()
)

# Words that go with these in the name of a box; inside an article a name with any other
# word ("related-work", "share-price") is a name of its own.
HOLDERS = set(
    "box boxes list item items block section area wrap wrapper container content inner outer widget bar link links"
    " button buttons icon icons panel slot unit card group row col column title head header heading body text form"
    " thread left right top bottom main small large fixed sticky overlay post posts story stories article articles"
    " tool tools toolbar site page global local primary secondary js count counter".split()
)
# Controls and embedded things, dropped where they stand in no article.
_LOOSE = {"button", "label", "object"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(?:>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# A name that begins so tells what is elsewhere on the page ("with-sidebar").
_TELLS = {"has", "with", "no", "without", "is", "not"}
_PART = re.compile(r"[a-z]+")
_LONGEST_GROUP = 4
# Pages of a host that must agree on a text before it is the host's and not theirs.
FIXED = 3


@dataclass
class Item:
    token: str
    pages: int = 1
    optional: bool = False
    repeated: bool = False
    text: str | None = None  # the one text of a slot so far; None: they differ


def _kind(name: str, attributes: str, inside: bool) -> str:
    """What an element does to what stands in it; ``inside``: does it stand in an article?"""
    if name in CONTENT or name in ("html", "body"):
        return name if name in CONTENT else ""
    for found in _NAMED.findall(attributes):
        for own in "".join(found).lower().split():
            parts = _PART.findall(own)
            if not parts or parts[0] in _TELLS or NOT_CONTENT.isdisjoint(parts):
                continue
            if not inside or all(p in NOT_CONTENT or p in HOLDERS for p in parts):
                return "!"
    if inside and name in _LOOSE:
        return ""
    return name if name in APART or name in DROPPED else ""


def stream(page: str) -> list[tuple[str, str]]:
    """Tokens of a page, slots with their text. Broken markup is read as browsers do:
    what is not closed ends with what it stands in."""
    tokens: list[tuple[str, str]] = []
    stack: list[tuple[str, str, int]] = []  # element, kind, and where its text begins
    text: list[str] = []

    def flush() -> None:
        block = " ".join("".join(text).split())
        text.clear()
        if block:
            name = next((n for n, _, _ in reversed(stack) if n in BLOCKS), "text")
            tokens.append((f"#{name}", block))

    def pop() -> None:
        name, kind, start = stack.pop()
        if kind and name in BLOCKS:
            tokens.append((f"</{kind}>", ""))
        elif kind:  # no content in the middle of a block
            del text[start:]

    at = 0
    for tag in _TAG.finditer(page):
        if tag.start() > at:
            text.append(html.unescape(page[at : tag.start()]))
        at = tag.end()
        name = (tag[3] or tag[6] or "").lower()
        if not name:
            continue
        closes, attributes = tag[2] or tag[5], tag[4] or tag[7] or ""
        if name == "br":
            text.append(" ")
        inside = any(k in CONTENT for _, k, _ in stack)
        block = name in BLOCKS and not (inside and name in _LOOSE)
        if block:
            flush()
        if name in VOID:
            continue
        if closes:
            if any(n == name for n, _, _ in stack):
                while stack[-1][0] != name:
                    if stack[-1][0] in BLOCKS:
                        flush()
                    pop()
                flush() if block else None
                pop()
            continue
        if name in CONTENT or name == "body":  # these stand in nothing that is no content
            while stack and any(k in APART | DROPPED | {"!"} for _, k, _ in stack):
                pop()
        if name in SELF_ENDING or (block and stack and stack[-1][0] in HEADINGS | {"p"}):
            last = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCKS), None)
            if last is not None and (stack[last][0] == name or stack[last][0] == "p"):
                while len(stack) > last:
                    pop()
        kind = _kind(name, attributes, any(k in CONTENT for _, k, _ in stack))
        stack.append((name, kind, len(text)))
        if kind and block:
            tokens.append((f"<{kind}>", ""))
    text.append(html.unescape(page[at:]))
    flush()
    while stack:
        pop()
    return tokens


def squashed(tokens: list[tuple[str, str]]) -> list[tuple[Item, list[tuple[int, str]]]]:
    """Items of a stream with runs made one, and the texts of each with their places."""
    found: list[tuple[Item, list[tuple[int, str]]]] = []
    for k, (token, text) in enumerate(tokens):
        own = [(k, text)] if token[0] == "#" else []
        if found and token[0] == "#" and found[-1][0].token == token:
            found[-1][0].repeated, found[-1][0].text = True, None
            found[-1][1].extend(own)
        else:
            found.append((Item(token, text=text if own else None), own))
    for size in range(2, _LONGEST_GROUP + 1):
        k = 0
        while k + 2 * size <= len(found):
            body = [item.token for item, _ in found[k : k + size]]
            n = 1
            while [item.token for item, _ in found[k + n * size : k + (n + 1) * size]] == body:
                n += 1
            if n > 1 and all(t[0] in "#(" for t in body):
                texts = [x for _, own in found[k : k + n * size] for x in own]
                found[k : k + n * size] = [(Item(f"({' '.join(body)})", repeated=True), texts)]
            k += 1
    return found


def merged(a: list[Item], b: list[Item]) -> list[Item]:
    """The wrapper of everything that two wrappers match."""
    out: list[Item] = []
    match = SequenceMatcher(None, [x.token for x in a], [x.token for x in b], autojunk=False)
    for kind, a0, a1, b0, b1 in match.get_opcodes():
        if kind == "equal":
            for x, y in zip(a[a0:a1], b[b0:b1]):
                text = x.text if x.text == y.text else None
                out.append(Item(x.token, x.pages + y.pages, x.optional or y.optional, x.repeated or y.repeated, text))
        else:
            out += [Item(x.token, x.pages, True, x.repeated, x.text) for x in (*a[a0:a1], *b[b0:b1])]
    # The optional twins that an alignment leaves side by side are one repeated slot.
    tidy: list[Item] = []
    for x in out:
        if tidy and x.token[0] in "#(" and tidy[-1].token == x.token:
            y = tidy[-1]
            tidy[-1] = Item(x.token, max(x.pages, y.pages), x.optional and y.optional, True, None)
        else:
            tidy.append(x)
    return tidy


def dumped(items: list[Item]) -> str:
    return json.dumps([astuple(x) for x in items])


def loaded(text: str) -> list[Item]:
    return [Item(*x) for x in json.loads(text)]


def _regions(tokens: list[str]) -> list[tuple[bool, bool]]:
    """For each token: whether it stands in content, and whether in what is none."""
    found, stack = [], []
    for token in tokens:
        if token[0] == "<" and token[1] != "/":
            stack.append(token[1:-1])
        content = any(x in CONTENT for x in stack)
        # A header inside an article has its title; outside, it is the site's.
        bad = any(x not in CONTENT and not (x == "header" and content) for x in stack)
        found.append((content, bad))
        if token[:2] == "</" and token[2:-1] in stack:
            while stack.pop() != token[2:-1]:
                pass
    return found


def hosts_own(item: Item) -> bool:
    """Whether a slot has one text on all pages of a host. A slot that is not optional
    was met on each of them."""
    return item.text is not None and not item.optional and item.pages >= FIXED


def kept(wrapper: list[Item], page: list[tuple[Item, list[tuple[int, str]]]]) -> list[bool]:
    """Which items of a page hold main text, by the slots of the wrapper they fall in."""
    of_wrapper, of_page = _regions([x.token for x in wrapper]), _regions([x.token for x, _ in page])
    article = any(content and not bad and x.token[0] != "<" for (x, _), (content, bad) in zip(page, of_page))
    open_ = any(x.text is None and x.token[0] != "<" and not bad for x, (_, bad) in zip(wrapper, of_wrapper))
    slot: list[int | None] = [None] * len(page)
    match = SequenceMatcher(None, [x.token for x in wrapper], [x.token for x, _ in page], autojunk=False)
    for a, b, n in match.get_matching_blocks():
        slot[b : b + n] = range(a, a + n)
    found = []
    for k, (content, bad) in enumerate(of_page):
        fixed = False
        if slot[k] is not None:
            item, (inside, outside) = wrapper[slot[k]], of_wrapper[slot[k]]
            bad = bad or outside and not content
            fixed = open_ and not (content or inside) and hosts_own(item) and item.text == page[k][0].text
        found.append(not bad and (content or not article) and not fixed)
    return found


def main_text(page: list[tuple[Item, list[tuple[int, str]]]], keep: list[bool]) -> str:
    blocks = sorted(x for (_, texts), k in zip(page, keep) if k for x in texts)
    return "\n".join(text for _, text in blocks)
