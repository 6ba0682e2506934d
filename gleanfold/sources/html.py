"""A small HTML tree and the selectors that listing layouts need; used inside Spark tasks, one page at a time.

Selectors: tag, #id, .class, [a], [a=v], [a^=v], [a$=v], [a*=v], :nth-child(n), :nth-child(n+k), :last-child, :first-child,
:last-of-type, :not(.c), descendant and > combinators, and commas.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.entities import html5
from html.parser import HTMLParser

_VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: an opening tag ends an open element of these kinds
_ENDS = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "p": {"p"}}
_FENCE = {"table", "html", "body", "ul", "ol", "dl", "div", "select"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self):
        todo = self.elements()[::-1]
        while todo:
            n = todo.pop()
            yield n
            todo += n.elements()[::-1]

    def text(self) -> str:
        parts, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                parts.append(n)
            else:
                todo += n.children[::-1]
        return "".join(parts)

    def own_text(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))

    def select(self, selector: str) -> list[Node]:
        """Descendants that match, in document order."""
        wanted = _compiled(selector)
        return [n for n in self.walk() if any(_matches(n, chain, len(chain) - 1, self) for chain in wanted)]

    def first(self, selector: str) -> Node | None:
        wanted = _compiled(selector)
        return next((n for n in self.walk() if any(_matches(n, chain, len(chain) - 1, self) for chain in wanted)), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "head", "body") and self.at.tag not in ("#root", "html", "head"):
            return  # a second one inside the page's body counts for nothing
        ends, n = _ENDS.get(tag, ()), self.at
        while ends and n.parent is not None and n.tag not in _FENCE:
            if n.tag in ends:
                self.at = n.parent
            n = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None:
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


_REFERENCE = re.compile(r"&(#\d+;|#[xX][\da-fA-F]+;|\w+;)?")


def _closed_only(m: re.Match) -> str:
    name = m.group(1)
    return m.group() if name and (name[0] == "#" or name in html5) else "&amp;" + (name or "")


def parse(html: str | None, unclosed: bool = True) -> Node:
    """The tree of a page. HTML knows some references without their semicolon too (&amp); with ``unclosed`` false they are text as they stand."""
    b = _Builder()
    b.feed((html or "") if unclosed else _REFERENCE.sub(_closed_only, html or ""))
    b.close()
    return b.root


_PART = re.compile(r"(?P<tag>[a-zA-Z][\w-]*|\*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w:-]+)(?:(?P<op>[\^$*]?=)[\"']?(?P<val>[^\"'\]]*)[\"']?)?\]|:nth-child\((?P<nth>\d+)\)|:nth-child\(n\+(?P<from>\d+)\)|:(?P<edge>first-child|last-child|last-of-type)|:not\(\.(?P<no>[\w-]+)\)")


@lru_cache(maxsize=2000)
def _compiled(selector: str):
    """Chains of (combinator, tests) for each comma-separated alternative."""
    chains = []
    for alternative in selector.split(","):
        chain, combinator = [], " "
        for token in re.sub(r"\s*>\s*", " > ", alternative.strip()).split():
            if token == ">":
                combinator = ">"
                continue
            tests, at = [], 0
            while at < len(token):
                m = _PART.match(token, at)
                if not m:
                    raise ValueError(f"selector {selector!r}")
                tests.append({k: v for k, v in m.groupdict().items() if v is not None})
                at += m.end() - m.start()
            chain.append((combinator, tests))
            combinator = " "
        chains.append(chain)
    return chains


def _holds(n: Node, t: dict) -> bool:
    if "tag" in t:
        return t["tag"] == "*" or n.tag == t["tag"].lower()
    if "id" in t:
        return n.attrs.get("id") == t["id"]
    if "cls" in t:
        return t["cls"] in n.attrs.get("class", "").split()
    if "no" in t:
        return t["no"] not in n.attrs.get("class", "").split()
    if "attr" in t:
        v = n.attrs.get(t["attr"].lower())
        if v is None or "op" not in t:
            return v is not None
        return {"=": v == t["val"], "^=": v.startswith(t["val"]), "$=": v.endswith(t["val"]), "*=": t["val"] in v}[t["op"]]
    family = n.parent.elements() if n.parent else [n]
    if "nth" in t:
        return len(family) >= int(t["nth"]) and family[int(t["nth"]) - 1] is n
    if "from" in t:
        return any(x is n for x in family[int(t["from"]) - 1 :])
    if t["edge"] == "first-child":
        return family[0] is n
    if t["edge"] == "last-child":
        return family[-1] is n
    return [x for x in family if x.tag == n.tag][-1] is n


def _matches(n: Node, chain, i: int, top: Node) -> bool:
    combinator, tests = chain[i]
    if not all(_holds(n, t) for t in tests):
        return False
    if i == 0:
        return True
    p = n.parent
    while p is not None:
        if _matches(p, chain, i - 1, top):
            return True
        if combinator == ">":
            return False
        p = p.parent
    return False
