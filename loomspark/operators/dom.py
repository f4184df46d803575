"""A small document tree and a CSS selector engine over the standard library's HTML tokenizer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def raw_text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                stack.extend(reversed(c.children))
        return "".join(out)

    def text(self) -> str:
        return " ".join(self.raw_text().split())

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None and node.tag != "#document":
            yield node
            node = node.parent

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document")
        self.comments = 0

    def handle_starttag(self, tag, attrs):
        for closed, scope in ((_CLOSED_BY.get(tag, set()), _SCOPES.get(tag, set())), ({"p"} if tag in BLOCK else set(), {"td", "th", "button", "object"})):
            node = self.at
            while node.parent is not None and node.tag not in scope:
                if node.tag in closed:
                    self.at = node.parent
                    if tag not in ("tr", "tbody"):
                        break
                node = node.parent
        node = Node(tag, {}, self.at)
        for k, v in attrs:
            node.attrs.setdefault(k, v or "")
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag in ("svg", "path", "circle", "rect", "g", "use"):
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(data)

    def handle_comment(self, data):
        self.comments += 1


def parse(html: str) -> Node:
    builder = _Builder()
    try:
        builder.feed(html)
        builder.close()
    except (AssertionError, ValueError):  # declarations that the tokenizer refuses; what was read stands
        pass
    return builder.root


# --- selectors ---------------------------------------------------------------------------------------------------

_SIMPLE = re.compile(
    r"(?P<tag>[a-zA-Z][\w-]*|\*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"
    r"|\[\s*(?P<name>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<v1>[^\"]*)\"|'(?P<v2>[^']*)'|(?P<v3>[^\s\]]+))\s*(?P<flag>[iI])?\s*)?\]"
    r"|:nth-of-type\(\s*(?P<nth>\d+)\s*\)|:(?P<first>first-of-type|first-child)"
)


class SelectorError(ValueError):
    pass


@lru_cache(maxsize=1024)
def compile_selector(text: str) -> tuple:
    """Alternatives, each a list of (combinator, tests), from the left."""
    alternatives = []
    for part in _split(text, ","):
        steps, combinator, at = [], " ", 0
        part = part.strip()
        if not part:
            raise SelectorError(f"empty selector in {text!r}")
        while at < len(part):
            tests = []
            while m := _SIMPLE.match(part, at):
                tests.append(m.groupdict())
                at = m.end()
            if not tests:
                raise SelectorError(f"cannot read {part[at:]!r} of {text!r}")
            steps.append((combinator, tests))
            gap = re.match(r"\s*([>+~]?)\s*", part[at:])
            if at < len(part) and not gap[0]:
                raise SelectorError(f"cannot read {part[at:]!r} of {text!r}")
            at += gap.end()
            combinator = gap[1] or " "
            if combinator in "+~" and gap[1]:
                raise SelectorError("sibling combinators are not supported")
            if at >= len(part) and gap[1]:
                raise SelectorError(f"dangling combinator in {text!r}")
        alternatives.append(tuple(steps))
    return tuple(alternatives)


def _split(text: str, sign: str) -> list[str]:
    out, depth, quote, last = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[(":
            depth += 1
        elif c in "])":
            depth -= 1
        elif c == sign and not depth:
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]


def _passes(node: Node, t: dict) -> bool:
    if t["tag"]:
        return t["tag"] == "*" or node.tag == t["tag"].lower()
    if t["id"]:
        return node.attrs.get("id") == t["id"]
    if t["cls"]:
        return t["cls"] in node.classes
    if t["nth"] or t["first"]:
        if node.parent is None:
            return False
        if t["first"] == "first-child":
            return node.parent.elements()[0] is node
        alike = [c for c in node.parent.elements() if c.tag == node.tag]
        n = int(t["nth"] or 1)
        return len(alike) >= n and alike[n - 1] is node
    if t["name"].lower() not in node.attrs:
        return False
    if not t["op"]:
        return True
    have, want = node.attrs[t["name"].lower()], next(v for v in (t["v1"], t["v2"], t["v3"]) if v is not None)
    if t["flag"]:
        have, want = have.lower(), want.lower()
    return {"=": have == want, "~=": want in have.split(), "|=": have == want or have.startswith(want + "-"), "^=": bool(want) and have.startswith(want), "$=": bool(want) and have.endswith(want), "*=": bool(want) and want in have}[t["op"]]


def _matches(node: Node, steps: tuple) -> bool:
    combinator, tests = steps[-1]
    if not all(_passes(node, t) for t in tests):
        return False
    rest = steps[:-1]
    if not rest:
        return True
    if combinator == ">":
        return node.parent is not None and node.parent.tag != "#document" and _matches(node.parent, rest)
    return any(_matches(a, rest) for a in node.ancestors())


def matches(node: Node, selector: str) -> bool:
    return any(_matches(node, steps) for steps in compile_selector(selector))


def select(root: Node, selector: str) -> list[Node]:
    alternatives = compile_selector(selector)
    return [n for n in root.walk() if any(_matches(n, steps) for steps in alternatives)]


def first(root: Node, selector: str) -> Node | None:
    alternatives = compile_selector(selector)
    return next((n for n in root.walk() if any(_matches(n, steps) for steps in alternatives)), None)


def first_text(root: Node, selector: str) -> str | None:
    node = first(root, selector)
    return (node.text() or None) if node else None


def meta(root: Node, *names: str) -> str | None:
    """The content of the first meta element of one of the names, tried in order."""
    found: dict[str, str] = {}
    for n in root.walk():
        if n.tag == "meta":
            key = (n.attrs.get("property") or n.attrs.get("name") or n.attrs.get("itemprop") or "").lower()
            if key and n.attrs.get("content", "").strip():
                found.setdefault(key, n.attrs["content"].strip())
    return next((found[n] for n in names if n in found), None)
