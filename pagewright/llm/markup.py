"""Reading blocks of visible text out of HTML, without building a tree."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<!doctype[^>]*>|<\?.*?>", re.I | re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>")
_SPACE = re.compile(r"\s+")
_CLASS = re.compile(r"""(?:class|id)\s*=\s*["']?([^"'>]*)""", re.I)
_LAYOUT = re.compile(r"""\b(?:role|width|bgcolor|align)\s*=\s*["']?([^"'\s>]+)""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end by themselves when one of the same kind, or their parent, goes on; cells that lay
#: out a page (those with a label in the path) hold further cells instead.
_LOOSE = frozenset("p li td th tr dt dd option".split())
_CELLS = frozenset(("td", "th"))


class Block(NamedTuple):
    """One run of visible text.

    ``path`` is the root-to-leaf path of tag names, each with its first class or id, or else the values
    of its layout attributes; ``tag`` the innermost element; ``links`` the number of links and ``linked`` the characters inside them.
    """

    path: str
    tag: str
    text: str
    links: int
    linked: int


def blocks(page: str | None) -> list[Block]:
    """The visible blocks of a page in page order, with the title first under the path ``title``.

    Links belong to the text around them; every other tag ends a block. Unclosed elements stay
    open until an enclosing one ends. Null, empty and white-space pages have none.
    """
    if not page or not page.strip():
        return []
    source = _HIDDEN.sub(" ", page)
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    links = linked = 0
    inside = False
    position = 0

    def flush() -> None:
        nonlocal links, linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                tag = stack[-1][0] if stack else "body"
                out.append(Block("/".join(name for _, name in stack) or "body", tag, text, links, linked))
        links = linked = 0

    for m in _TAG.finditer(source):
        if m.start() > position:
            piece = source[position : m.start()]
            parts.append(piece)
            if inside:
                linked += len(piece.strip())
        position = m.end()
        closing, name, attributes = m.group(1), m.group(2).lower(), m.group(3)
        if name == "a":
            inside = not closing
            links += not closing
            continue
        flush()
        if name in _VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        else:
            if name in _LOOSE and stack and stack[-1][0] == name and not (name in _CELLS and stack[-1][1] != name):
                stack.pop()
            kind = _CLASS.search(attributes)
            label = kind.group(1).split()[0] if kind and kind.group(1).split() else "+".join(_LAYOUT.findall(attributes))
            if not attributes.rstrip().endswith("/"):
                stack.append((name, f"{name}.{label}" if label else name))
    if position < len(source):
        parts.append(source[position:])
    flush()
    return out


_LINK = re.compile(r"</?[aA](?:\s[^<>]*)?>")


def visible_text(page: str | None) -> str:
    """Title and all visible text of a page; tags other than links part words."""
    if not page:
        return ""
    return html.unescape(_TAG.sub("\n", _LINK.sub("", _HIDDEN.sub(" ", page))))
