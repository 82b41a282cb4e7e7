"""A small tolerant tree and selector helper used inside the extraction tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

# Fixed values of HTML: elements without content, and start tags that end an open element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr"
    " main nav ol p pre section table ul".split()
)
ENDED_BY = {
    "p": BLOCKS,
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "td": frozenset({"td", "th", "tr"}),
    "th": frozenset({"td", "th", "tr"}),
    "tr": frozenset({"tr"}),
    "option": frozenset({"option", "optgroup"}),
}
# An implied end never reaches past these.
WALLS = frozenset({"table", "ul", "ol", "dl", "select", "body", "html", "#root"})


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kids: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """This element and all below it, in document order, without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(k for k in reversed(node.kids) if not isinstance(k, str))

    def texts(self) -> Iterator[str]:
        stack: list[Node | str] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            else:
                stack.extend(reversed(node.kids))

    def elements(self) -> list[Node]:
        return [k for k in self.kids if not isinstance(k, str)]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        node = self.here
        while node.parent is not None and node.tag not in WALLS:
            if tag in ENDED_BY.get(node.tag, ()):
                self.here = node.parent
                break
            node = node.parent
        # The first of several attributes with one name counts.
        child = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.here)
        self.here.kids.append(child)
        if tag not in VOID:
            self.here = child

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.here
        while node.parent is not None:
            if node.tag == tag:
                self.here = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.here.kids.append(data)


def parse_html(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    _ensure_body(builder.root)
    return builder.root


def _ensure_body(root: Node) -> None:
    """Put ``html`` and ``body`` around what lacks them, as any browser does."""
    html = next((n for n in root.elements() if n.tag == "html"), None)
    if html is None:
        html = _wrap(root, "html", root.kids)
        root.kids = [html]
    if not any(n.tag == "body" for n in root.walk()):
        head = [k for k in html.kids if not isinstance(k, str) and k.tag == "head"]
        body = _wrap(html, "body", [k for k in html.kids if isinstance(k, str) or k.tag != "head"])
        html.kids = [*head, body]


def _wrap(parent: Node, tag: str, kids: list[Node | str]) -> Node:
    node = Node(tag, {}, parent)
    node.kids = list(kids)
    for kid in node.elements():
        kid.parent = node
    return node


_PART = re.compile(
    r"""(?P<tag>\*|[a-zA-Z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)
      |\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~*^$]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+)))?\s*\]
      |:nth-child\(\s*(?P<nth>\d+)\s*\)|(?P<comb>\s*[>+,]\s*|\s+)""",
    re.X,
)

_ATTR_TESTS = {
    "=": lambda have, want: have == want,
    "*=": lambda have, want: bool(want) and want in have,
    "^=": lambda have, want: bool(want) and have.startswith(want),
    "$=": lambda have, want: bool(want) and have.endswith(want),
    "~=": lambda have, want: bool(want) and want in have.split(),
}


def _simple_test(m: re.Match):
    """One simple selector as a predicate on an element."""
    if m["tag"]:
        tag = m["tag"].lower()
        return lambda n: tag == "*" or n.tag == tag
    if m["cls"]:
        return lambda n, c=m["cls"]: c in n.attrs.get("class", "").split()
    if m["id"]:
        return lambda n, i=m["id"]: n.attrs.get("id") == i
    if m["nth"]:
        nth = int(m["nth"])

        def is_nth(n: Node) -> bool:
            kids = n.parent.elements() if n.parent else []
            return 0 < nth <= len(kids) and kids[nth - 1] is n

        return is_nth
    name = m["attr"].lower()
    if not m["op"]:
        return lambda n: name in n.attrs
    want = m["dq"] if m["dq"] is not None else m["sq"] if m["sq"] is not None else m["bare"]
    test = _ATTR_TESTS[m["op"]]
    return lambda n: name in n.attrs and test(n.attrs[name], want)


@lru_cache(maxsize=512)
def compile_selector(css: str):
    """A selector list as alternatives ``(tag, [(combinator, predicates), ...])``.

    ``tag`` is the type the matched element must have, or None; it is looked at first.
    """
    alternatives, chain, at, comb = [], [], 0, " "
    tests: list = []
    tag = None
    css = css.strip()
    while at < len(css):
        m = _PART.match(css, at)
        if not m:
            raise ValueError(f"unsupported selector: {css!r}")
        at = m.end()
        if m["comb"] is None:
            if m["tag"]:
                tag = None if m["tag"] == "*" else m["tag"].lower()
            tests.append(_simple_test(m))
            continue
        if not tests:
            raise ValueError(f"unsupported selector: {css!r}")
        chain.append((comb, tests))
        tests, comb = [], m["comb"].strip() or " "
        if comb == ",":
            alternatives.append((tag, chain))
            chain, comb = [], " "
        tag = None
    if not tests:
        raise ValueError(f"unsupported selector: {css!r}")
    alternatives.append((tag, chain + [(comb, tests)]))
    return alternatives


def _matches(node: Node, chain: list, last: int, scope: Node) -> bool:
    comb, tests = chain[last]
    if node.tag == "#root" or not all(test(node) for test in tests):
        return False
    if last == 0:
        return True
    if node is scope:
        return False
    if comb == "+":
        kids = node.parent.elements()
        i = next(i for i, k in enumerate(kids) if k is node)
        return i > 0 and _matches(kids[i - 1], chain, last - 1, scope)
    up = node.parent
    while up is not None:
        if _matches(up, chain, last - 1, scope):
            return True
        if comb == ">" or up is scope:
            return False
        up = up.parent
    return False


def select(scope: Node, css: str) -> list[Node]:
    """Elements at or below ``scope`` that match, each once, in document order."""
    if not css:
        return [scope]
    alternatives = compile_selector(css)
    return [
        n for n in scope.walk()
        if any(
            (tag is None or n.tag == tag) and _matches(n, chain, len(chain) - 1, scope)
            for tag, chain in alternatives
        )
    ]


def joined_text(nodes: list[Node]) -> str:
    return " ".join(" ".join(t for n in nodes for t in n.texts()).split())


def own_texts(nodes: list[Node]) -> list[str]:
    return [k for n in nodes for k in n.kids if isinstance(k, str)]
