"""CSS selectors over parsed pages: compiled once, matched from the right.

A selector is groups of chains ("," between them) of compounds joined by " ", ">", "+" or "~". A
compound is a tag or "*", then .class, #id, attributes ([a], [a=v], [a!=v], [a^=v], [a$=v], [a*=v],
[a~=pattern], [^prefix]) and pseudo-classes (see PSEUDO and NTH). Values, classes and words compare
without regard to case, ids with it. A chain is matched within the element that is asked, which may
itself be a result or the start of a chain; elements above it count for nothing.

What a compound names most narrowly (id, else class, else tag) looks up its candidates in the
page's index, so the rest of a page costs nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

Test = Callable[["Element", "Element"], bool]  # of an element, within one that is asked

_NAME = re.compile(r"[\w-]+|\\.")
_ATTRIBUTE = re.compile(r"\s*(\^?)([\w:.-]+)\s*(?:([!^$*~]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]]*?))\s*)?\]")
_STEP = re.compile(r"\s*([>+~])\s*|\s+")


def _words(text: str) -> str:
    return " ".join(text.split()).lower()


def _own(e) -> str:
    return "".join(c for c in e.children if isinstance(c, str))


def _attribute(prefix: str, key: str, sign: str | None, value: str) -> Test:
    key = key.lower()
    if prefix:
        return lambda e, _: any(k.startswith(key) for k in e.attrs)
    if not sign:
        return lambda e, _: key in e.attrs
    if sign == "~=":
        pattern = re.compile(value)
        return lambda e, _: key in e.attrs and bool(pattern.search(e.attrs[key]))
    v = value.strip().lower()
    if sign == "!=":
        return lambda e, _: e.attrs.get(key, "").strip().lower() != v if key in e.attrs else True
    compare = {"=": lambda a: a.strip() == v, "^=": lambda a: a.startswith(v), "$=": lambda a: a.endswith(v), "*=": lambda a: v in a}[sign]
    return lambda e, _: key in e.attrs and compare(e.attrs[key].lower())


def _place(e, same_tag: bool = False, from_end: bool = False) -> int:
    """The element's number among its siblings, from 1."""
    kids = [k for k in e.above.kids if not same_tag or k.tag == e.tag] if e.above else [e]
    at = next(i for i, k in enumerate(kids) if k is e)
    return len(kids) - at if from_end else at + 1


#: Pseudo-classes without an argument.
PSEUDO: dict[str, Test] = {
    "first-child": lambda e, _: _place(e) == 1,
    "last-child": lambda e, _: _place(e, from_end=True) == 1,
    "only-child": lambda e, _: e.above is not None and len(e.above.kids) == 1,
    "first-of-type": lambda e, _: _place(e, True) == 1,
    "last-of-type": lambda e, _: _place(e, True, True) == 1,
    "empty": lambda e, _: not e.kids and not _own(e).strip(),
    "root": lambda e, _: e.above is not None and not e.above.tag,
}
#: Pseudo-classes that count siblings by an+b, odd, even or a number.
NTH = {"nth-child": (False, False), "nth-last-child": (False, True), "nth-of-type": (True, False), "nth-last-of-type": (True, True)}
_SIBLINGS = {"eq": lambda i, n: i == n, "lt": lambda i, n: i < n, "gt": lambda i, n: i > n}


def _nth(argument: str, same_tag: bool, from_end: bool) -> Test:
    text = {"odd": "2n+1", "even": "2n"}.get(argument.strip().lower(), argument.replace(" ", "").lower())
    found = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", text)
    if not found or not text:
        raise ValueError(f"no such place: {argument!r}")
    step = 0 if found[1] is None else int(found[1] + "1") if found[1] in ("", "+", "-") else int(found[1])
    first = int(found[2] or 0)

    def test(e, _) -> bool:
        past = _place(e, same_tag, from_end) - first
        return past == 0 if not step else past % step == 0 and past // step >= 0

    return test


def _pseudo(name: str, argument: str | None) -> Test:
    if argument is None and name in PSEUDO:
        return PSEUDO[name]
    if argument is None:
        raise ValueError(f"unknown or without its argument: :{name}")
    if name in NTH:
        return _nth(argument, *NTH[name])
    if name in _SIBLINGS:
        n, compare = int(argument), _SIBLINGS[name]
        return lambda e, _: compare(_place(e) - 1, n)
    if name in ("contains", "containsown"):
        text = _words(argument.strip("\"'"))
        return (lambda e, _: text in _words(e.text())) if name == "contains" else (lambda e, _: text in _words(_own(e)))
    inner = compiled(argument)
    if name == "has":
        return lambda e, _: inner.any_below(e)
    if name == "not":
        return lambda e, within: not inner.fits(e, within)
    if name == "is":
        return lambda e, within: inner.fits(e, within)
    raise ValueError(f"unknown: :{name}")


class Compound:
    """Tests that one element has to pass, and the narrowest name among them."""

    def __init__(self, tests: list[Test], names: dict[str, str]):
        self.tests = tests
        self.name = next(((k, names[k]) for k in ("id", "class", "tag") if k in names), None)

    def fits(self, e, within) -> bool:
        """The page itself, which has no tag, is no element, but a chain may start there."""
        return bool(e.tag or self.tests[0] is _asked) and all(t(e, within) for t in self.tests)


def _asked(e, within) -> bool:
    return e is within


class Chain:
    """Compounds from left to right, and the steps between them."""

    def __init__(self, compounds: list[Compound], steps: list[str]):
        self.compounds, self.steps = compounds, steps

    def fits(self, e, within, last: int | None = None) -> bool:
        """Whether e is what the chain up to compound `last` names."""
        i = len(self.compounds) - 1 if last is None else last
        if not self.compounds[i].fits(e, within):
            return False
        if not i:
            return True
        step = self.steps[i - 1]
        if step in "+~":
            # the siblings of the element that is asked lie outside it, but for a chain that starts there
            if e.above is None or (e is within):
                return False
            before = e.above.kids[: _place(e) - 1]
            return any(self.fits(k, within, i - 1) for k in (before[-1:] if step == "+" else before))
        up = None if e is within else e.above
        while up is not None:
            if self.fits(up, within, i - 1):
                return True
            up = None if step == ">" or up is within else up.above
        return False


class Selector:
    """Groups of chains."""

    def __init__(self, chains: list[Chain]):
        self.chains = chains

    def fits(self, e, within) -> bool:
        return any(c.fits(e, within) for c in self.chains)

    def select(self, within) -> list:
        """Elements in the page's order, each once."""
        found = {}
        for c in self.chains:
            for e in within.candidates(c.compounds[-1].name):
                if e.order not in found and c.fits(e, within):
                    found[e.order] = e
        return [found[k] for k in sorted(found)]

    def first(self, within):
        """The first of select, or None."""
        if len(self.chains) == 1:
            c = self.chains[0]
            return next((e for e in within.candidates(c.compounds[-1].name) if c.fits(e, within)), None)
        return next(iter(self.select(within)), None)

    def any_below(self, within) -> bool:
        """Whether an element below (or, for a chain that begins with + or ~, behind) `within` fits."""
        for c in self.chains:
            if c.compounds[0].tests == [_asked] and c.steps[0] in "+~":
                behind = within.above.kids[_place(within) :] if within.above else []
                if any(c.fits(e, within) for k in behind for e in k.candidates(c.compounds[-1].name)):
                    return True
            elif any(e is not within and c.fits(e, within) for e in within.candidates(c.compounds[-1].name)):
                return True
        return False


class _Reader:
    """Reads one selector from left to right."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self):
        raise ValueError(f"no selector from place {self.at} on: {self.text!r}")

    def name(self) -> str:
        m = _NAME.match(self.text, self.at)
        if not m:
            self.fail()
        self.at = m.end()
        return m[0]

    def brackets(self) -> str:
        """The argument behind an opening bracket, quotes and brackets inside it minded."""
        begin, depth, quote = self.at, 1, ""
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c in "()":
                depth += 1 if c == "(" else -1
                if not depth:
                    return self.text[begin : self.at - 1]
        self.fail()

    def compound(self) -> Compound:
        tests, names = [], {}
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "*" and not tests:
                self.at += 1
                tests.append(lambda e, _: True)
            elif c in ".#":
                self.at += 1
                value = self.name()
                if c == "#":
                    names.setdefault("id", value)
                    tests.append(lambda e, _, v=value: e.attrs.get("id") == v)
                else:
                    low = value.lower()
                    names.setdefault("class", low)
                    tests.append(lambda e, _, v=low: v in e.classes)
            elif c == "[":
                m = _ATTRIBUTE.match(self.text, self.at + 1)
                if not m:
                    self.fail()
                self.at = m.end()
                tests.append(_attribute(m[1], m[2], m[3], next((x for x in m.groups()[3:] if x is not None), "")))
            elif c == ":":
                self.at += 1
                name = self.name().lower()
                argument = None
                if self.text[self.at : self.at + 1] == "(":
                    self.at += 1
                    argument = self.brackets()
                tests.append(_pseudo(name, argument))
            elif not tests and _NAME.match(self.text, self.at):
                low = self.name().lower()
                names["tag"] = low
                tests.append(lambda e, _, v=low: e.tag == v)
            else:
                break
        if not tests:
            self.fail()
        return Compound(tests, names)

    def chain(self) -> Chain:
        m = _STEP.match(self.text, self.at)
        self.at = m.end() if m else self.at
        # a chain that begins with a step begins at the element that is asked
        compounds, steps = ([Compound([_asked], {})], [m[1]]) if m and m[1] else ([], [])
        while True:
            compounds.append(self.compound())
            m = _STEP.match(self.text, self.at)
            if not m or not self.text[m.end() :] or self.text[m.end()] == ",":
                self.at = m.end() if m else self.at
                if m and m[1]:
                    self.fail()
                return Chain(compounds, steps)
            self.at = m.end()
            steps.append(m[1] or " ")

    def selector(self) -> Selector:
        chains = [self.chain()]
        while self.at < len(self.text):
            if self.text[self.at] != ",":
                self.fail()
            self.at += 1
            chains.append(self.chain())
        return Selector(chains)


@lru_cache(maxsize=4096)
def compiled(selector: str) -> Selector:
    """The selector of a text; ValueError where it is none."""
    return _Reader(selector.strip()).selector()
