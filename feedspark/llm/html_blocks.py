"""Leaf blocks of an HTML page with their ancestors, by one tolerant pass over the tags."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

#: Elements that start and end blocks; the fixed sets of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section "
    "select summary table tbody td textarea tfoot th thead tr ul label".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page. Without an end tag only what stands before the next tag is left out.
SKIPPED_TAGS = frozenset("script style title template".split())
#: A start tag in the first set ends an open element of the second, unless one of the third lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_IN_P = BLOCK_TAGS - {"button", "label", "option", "select", "textarea", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "body", "html"}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+|[^>]*)(?:>|\Z)""", re.S)
_MARK = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


class Block(NamedTuple):
    text: str
    path: tuple  # of (tag, words of class, id and role), outermost first
    link_chars: int


def _words(attributes: str) -> tuple[str, ...]:
    found = []
    for m in _MARK.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        split = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
        found += _WORD.findall(split)
    return tuple(sorted(set(found)))


def leaf_blocks(html: str | None) -> list[Block]:
    """Blocks of visible text in page order; references decoded, white space run to one space, empty ones left out."""
    html = html or ""
    out: list[Block] = []
    path: list[tuple] = []
    parts: list[str] = []
    links, depth = 0, 0  # characters in links of this block, open links

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, tuple(path), links))
            parts.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if depth:
                links += len(text.strip())

    at = 0
    while m := _TAG.search(html, at):
        add(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                depth = 0
            elif tag == "br":
                parts.append(" ")
            elif tag in BLOCK_TAGS:
                if any(t == tag for t, _ in path):
                    flush()
                    while path.pop()[0] != tag:
                        pass
                elif tag == "p":
                    flush()
                depth = 0
            continue
        if tag in SKIPPED_TAGS:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else (html.find("<", at) if "<" in html[at:] else len(html))
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            depth = 1
        elif tag in BLOCK_TAGS:
            flush()
            depth = 0
            if tag in _IN_P and any(t == "p" for t, _ in path):
                while path.pop()[0] != "p":
                    pass
            ends, fence = CLOSES.get(tag, ((), ()))
            for k in range(len(path) - 1, -1, -1):
                if path[k][0] in fence:
                    break
                if path[k][0] in ends:
                    del path[k:]
                    break
            if tag not in VOID_TAGS:
                path.append((tag, _words(m[3])))
    add(html[at:])
    flush()
    return out
