"""Elements of web pages by selector, as tables: list pages become rows, detail pages fields.

Selectors are those of marquee.sources.selectors. Pages are read in Arrow batches; what is done with
the fields is left to Columns.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from marquee.sources.literals import member_list
from marquee.sources.selectors import compiled

# Elements without content, and the class of elements that a page builder hides.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = "w-condition-invisible"
# Elements whose start ends an open one, as HTML lets end tags be left out; and the
# elements that an open one is looked for in.
BLOCKS = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul"
ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "tr td th tbody thead", "tfoot": "tr td th tbody thead"} | dict.fromkeys(BLOCKS.split(), "p")
SCOPES = {"li": "ul ol", "dt": "dl", "dd": "dl", "tr": "table", "td": "table tr", "th": "table tr", "option": "select", "tbody": "table", "tfoot": "table"}
_ENDS = {k: frozenset(v.split()) for k, v in ENDS.items()}
_SCOPES = {k: frozenset(v.split()) for k, v in SCOPES.items()}

_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.IGNORECASE)


class Index:
    """The elements of a page in its order, and by id, class and tag."""

    def __init__(self, root: Element):
        self.all: list[Element] = []
        self.named: dict[tuple[str, str], list[Element]] = defaultdict(list)
        self.orders: dict[tuple[str, str], list[int]] = {}
        todo = [root]
        while todo:
            e = todo.pop()
            e.order, e.index = len(self.all), self
            self.all.append(e)
            self.named["tag", e.tag].append(e)
            if e.attrs:
                if "id" in e.attrs:
                    self.named["id", e.attrs["id"]].append(e)
                for c in e.classes:
                    self.named["class", c].append(e)
            if e.kids:
                todo += reversed(e.kids)
        for e in reversed(self.all):
            e.last = e.kids[-1].last if e.kids else e.order

    def between(self, name: tuple[str, str], first: int, end: int) -> list[Element]:
        """The elements of an id, class or tag whose order is in [first, end)."""
        found = self.named.get(name)
        if not found:
            return []
        orders = self.orders.get(name)
        if orders is None:
            orders = self.orders[name] = [e.order for e in found]
        return found[bisect_left(orders, first) : bisect_left(orders, end)]


class Element:
    """A tag with attributes; children are elements and texts, kids the elements among them."""

    def __init__(self, tag: str, attrs: dict[str, str], above: Element | None = None):
        self.tag, self.attrs, self.above = tag, attrs, above
        self.children: list[Element | str] = []
        self.kids: list[Element] = []
        self.index: Index | None = None
        self.order = self.last = 0

    @cached_property
    def classes(self) -> frozenset[str]:
        return frozenset(self.attrs.get("class", "").lower().split())

    def add(self, child: Element | str) -> None:
        self.children.append(child)
        if isinstance(child, Element):
            self.kids.append(child)

    def candidates(self, name: tuple[str, str] | None) -> list[Element]:
        """This element and those below it, of an id, class or tag; the page itself is none."""
        if self.index is None:
            top = self
            while top.above is not None:
                top = top.above
            Index(top)
        first = self.order + (not self.tag)
        if name is None:
            return self.index.all[first : self.last + 1]
        return self.index.between(name, first, self.last + 1)

    def text(self) -> str:
        """All text inside, with single blanks; a break is a blank."""
        found, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                found.append(x)
            elif x.tag == "br":
                found.append(" ")
            elif x.tag not in ("script", "style") or x is self:
                todo += reversed(x.children)
        return " ".join("".join(found).split())

    def lines(self) -> list[str]:
        """Lines between this element's own breaks, without blank ones."""
        out = [""]
        for c in self.children:
            if isinstance(c, str):
                out[-1] += " ".join(c.replace("\n", " ").split(" ")) if c.strip() else " "
            elif c.tag == "br":
                out.append("")
            else:
                out[-1] += c.text()
        return [" ".join(x.split()) for x in out if x.strip()]

    def select(self, selector: str) -> list[Element]:
        """This element and those below it that the selector names, in the page's order."""
        return compiled(selector).select(self)

    def first(self, selector: str) -> Element | None:
        return compiled(selector).first(self)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {})

    def _close(self, tag: str) -> None:
        """Ends what the start of a tag ends, if it is open within the tag's scope."""
        ends, scope = _ENDS.get(tag), _SCOPES.get(tag, frozenset(("button",)))
        e = self.at
        while ends and e.above is not None and e.tag not in scope:
            if e.tag in ends:
                self.at = e.above
                # of cells and rows the outermost that is open ends
                if tag not in ("tr", "tbody", "tfoot"):
                    return
            e = e.above

    def handle_starttag(self, tag, attrs):
        self._close(tag)
        if tag == "tr" and self.at.tag == "table":  # rows lie in a body, written or not
            self.handle_starttag("tbody", [])
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.add(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash says nothing but in void elements

    def handle_endtag(self, tag):
        e = self.at
        while e.above is not None and e.tag != tag:
            e = e.above
        if e.above is not None:  # an end without its start is passed over
            self.at = e.above

    def handle_data(self, data):
        self.at.add(data)


# Elements whose content is not read as markup; tags as nearly all pages write them (sign of an end, name,
# attributes), without references in their attributes; and such attributes.
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript plaintext".split())
_ATTRIBUTE = r"[ \t\n\r\f]+([A-Za-z][A-Za-z0-9_:-]*)(?:=(?:\"([^\"<>&]*)\"|'([^'<>&]*)'|([^\s\"'=<>`&\x00]+)))?"
_TAG = re.compile(rf"<(/?)([A-Za-z][A-Za-z0-9-]*)((?:{re.sub(r'[(](?![?])', '(?:', _ATTRIBUTE)})*)[ \t\n\r\f]*/?>")
_ATTRIBUTE = re.compile(_ATTRIBUTE)


def _plain(page: str) -> Element | None:
    """The elements of a page that has only text and plain tags, as the parser would build them: cut by one pattern,
    which takes a fraction of its time. None for other pages."""
    parts = _TAG.split(page)
    if any("<" in text for text in parts[::4]):
        return None
    b = _Builder()
    for i in range(0, len(parts), 4):
        if text := parts[i]:
            b.at.add(unescape(text) if "&" in text else text)
        if i + 1 == len(parts):
            return b.root
        end, tag, attributes = parts[i + 1 : i + 4]
        tag = tag.lower()
        if end:
            if attributes:
                return None
            b.handle_endtag(tag)
        elif tag in RAW:
            return None
        else:
            b.handle_starttag(tag, [(k.lower(), x or y or z) for k, x, y, z in _ATTRIBUTE.findall(attributes)] if attributes else [])


def parse(page: str | None) -> Element:
    if found := _plain(page or ""):
        return found
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root


# Byte order marks.
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\xfe\xff", "utf-16"), (b"\xff\xfe", "utf-16"))


def decoded(body: bytes | None, header: str | None = None) -> str | None:
    """A page's text: by its byte order mark, else in the charset of its header, else the one that its
    first 1,024 bytes name, else UTF-8. Unknown charsets count as UTF-8, broken bytes as the
    replacement character."""
    if body is None:
        return None
    marked = next((charset for mark, charset in MARKS if body.startswith(mark)), None)
    named = _CHARSET.search((header or "").encode()) or _CHARSET.search(body[:1024])
    try:
        return body.decode(marked or (named[1].decode() if named else "utf-8"), "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def value(of: Element, selector: str, what: str) -> str | None:
    """Of the first element that the selector names (an empty one: of itself) its "text", an
    attribute ("@name"), an absolute address ("href", "src"), its lines, joined by newlines, or its own
    characters as they stand, as a script's ("data").
    Nothing, blanks and relative addresses are null. "shown:words" is whether any of the elements
    is not hidden and holds the words: "true" or "false"."""
    if what.startswith("shown:"):
        words = what[6:].lower()
        return str(any(HIDDEN not in e.classes and words in e.text().lower() for e in of.select(selector))).lower()
    e = of.first(selector) if selector else of
    if e is None:
        return None
    if what in ("href", "src"):
        found = e.attrs.get(what, "")
        return found if found.startswith("http") else None
    if what == "data":
        return "".join(c for c in e.children if isinstance(c, str))
    found = e.text() if what == "text" else "\n".join(e.lines()) if what == "lines" else e.attrs.get(what[1:], "")
    return found if found.strip() else None


def picked(pages: DataFrame, each: str, fields: dict[str, tuple[str, str]], key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, *fields): a row for every element of a page that `each` names, numbered from 1, with
    fields (see value) as strings. An empty `each` takes the page itself. Null pages and pages
    without such elements have no rows; with an empty `each`, one of nulls."""
    kind = pages.schema[key].dataType.simpleString()
    names = list(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, page in zip(b["k"], b["h"], strict=True):
                root = parse(page)
                for pos, e in enumerate(root.select(each) if each else [root], 1):
                    out.append((k, pos, *[value(e, *fields[n]) for n in names]))
            yield pd.DataFrame(out, columns=[key, "pos", *names])

    columns = ", ".join([f"`{key}` {kind}", "pos int", *[f"`{n}` string" for n in names]])
    return pages.selectExpr(f"`{key}` AS k", f"`{html}` AS h").mapInPandas(run, columns)


def members(pages: DataFrame, name: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, member, error): the list `name` of the first object literal in a page's scripts that has
    it, a row of JSON for each of its members. Pages without one have no rows; one whose literal
    cannot be read has a row of its own, with the error, at place 0."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, page in zip(b["k"], b["h"], strict=True):
                out += [(k, pos, x, error) for pos, x, error in page_members(page, name)]
            yield pd.DataFrame(out, columns=[key, "pos", "member", "error"])

    return pages.selectExpr(f"`{key}` AS k", f"`{html}` AS h").mapInPandas(run, f"`{key}` {kind}, pos int, member string, error string")


def page_members(page: str | None, name: str) -> list[tuple[int, str | None, str | None]]:
    """(place, JSON, error) for the members of a page's list, as members has them."""
    try:
        found = next((x for e in parse(page).select("script") if (x := member_list("".join(c for c in e.children if isinstance(c, str)), name)) is not None), [])
    except ValueError as e:
        return [(0, None, str(e))]
    return [(pos, json.dumps(x, ensure_ascii=False), None) for pos, x in enumerate(found, 1)]
