"""Leaf blocks of HTML pages: their text, and the features of their ancestors and of the text itself."""

from __future__ import annotations

import html
import re

#: Elements that run on within a line of text; every other tag ends a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style template noscript svg iframe object select datalist title".split())
#: An opening tag ends these open elements before it.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: The search for an element that a tag ends stops at these.
SCOPE = frozenset("html body article section main aside nav header footer div table ul ol dl form blockquote figure".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_BIN = ((3, "1"), (6, "2"), (11, "3"), (21, "4"), (51, "5"))


class Block:
    __slots__ = ("text", "above", "tag", "words", "linked")

    def __init__(self, text: str, above: tuple[str, ...], tag: str, linked: int):
        self.text, self.above, self.tag, self.linked = text, above, tag, linked
        self.words = text.count(" ") + 1


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks with text, in order. Broken markup is read as leniently as browsers do."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = [("", ())]
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                k = len(stack) - 1
                while k and stack[k][0] in INLINE:
                    k -= 1
                out.append(Block(text, stack[k][1], stack[k][0], linked))
            held.clear()
        linked = 0

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            held.append(page[at:])
            break
        if m.start() > at:
            text = page[at : m.start()]
            held.append(text)
            if any(t == "a" for t, _ in stack[-3:]):
                linked += len(text.split())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            flush() if tag not in INLINE else None
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if tag not in INLINE or all(t in INLINE for t, _ in stack[k:]):
                        del stack[k:]
                    break
            continue
        if tag in VOID:
            continue
        ends = CLOSES.get(tag)
        if ends or tag in SCOPE:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in (ends or ("p",)):
                    del stack[k:]
                    break
                if stack[k][0] in SCOPE:
                    break
        above = stack[-1][1]
        if tag not in INLINE:
            own = [f"in:{tag}"]
            for _, a, b, c in _NAMES.findall(m[3]):
                own += [f"of:{w}" for w in _WORD.findall((a or b or c).lower())]
            above = above + tuple(f for f in dict.fromkeys(own) if f not in above)
        stack.append((tag, above))
    flush()
    return out


def features(found: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out = []
    for k, b in enumerate(found):
        size = next((name for most, name in _BIN if b.words < most), "6")
        share = 4 * b.linked // b.words if b.linked else -1
        own = [*b.above, f"tag:{b.tag}", f"size:{size}", f"link:{min(share, 3)}", f"last:{'stop' if b.text[-1] in '.!?…' else 'other'}"]
        if "©" in b.text:
            own.append("has:copyright")
        if "|" in b.text:
            own.append("has:bar")
        if k == 0:
            own.append("first")
        out.append(own)
    return out
