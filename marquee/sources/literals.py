"""Object literals in the scripts of pages: a scanner that knows strings and comments, and a reader of
literals as scripts write them, both linear in the script."""

from __future__ import annotations

import re

#: A token of a script: blanks and comments, strings, numbers, names and marks.
TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)
    |(?P<number>[+-]?(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?![\w$]))
    |(?P<name>[A-Za-z_$][\w$]*)
    |(?P<mark>.)""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|.))", re.DOTALL)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": "", "\r": ""}
#: Names that are values.
WORDS = {"true": True, "false": False, "null": None, "undefined": None}


def unquoted(string: str) -> str:
    """What a string in quotes stands for."""
    if "\\" not in string:
        return string[1:-1]

    def plain(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code is None:
            return _PLAIN.get(m[4], m[4])
        return chr(int(code, 16)) if int(code, 16) <= 0x10FFFF else "\ufffd"

    text = _ESCAPE.sub(plain, string[1:-1])
    # halves of a character that were escaped one by one
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def read(text: str, at: int = 0) -> object:
    """The value of the literal that begins at a place of text: objects (names bare or in quotes of either
    kind), lists, strings, numbers and WORDS, with commas behind the last member if need be, !0 and
    !1 as shortened truth values, and comments. ValueError where it is none; what follows is not read.
    A name that stands twice has its last value. Nesting may be as deep as the text."""
    stack: list[list | dict] = []
    names: list[str | None] = []  # of each open object the name that waits for its value
    state = "value"  # what may come: value, or first (value or end), name, or first name, colon, next
    while True:
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError("the literal does not end")
        at, kind, token = m.end(), m.lastgroup, m[0]
        if kind == "skip":
            continue
        if state in ("name", "first name"):
            if token == "}":
                value, state = stack.pop(), "done"
                names.pop()
            elif kind in ("string", "name", "number"):
                names[-1] = unquoted(token) if kind == "string" else token
                state = "colon"
                continue
            else:
                raise ValueError(f"a name is missing at {at - 1}")
        elif state == "colon":
            if token != ":":
                raise ValueError(f"a colon is missing at {at - 1}")
            state = "value"
            continue
        elif state == "next":
            open_object = isinstance(stack[-1], dict)
            if token == ",":
                state = "name" if open_object else "first"
                continue
            if token != ("}" if open_object else "]"):
                raise ValueError(f"a comma is missing at {at - 1}")
            value, state = stack.pop(), "done"
            names.pop()
        elif token in "{[" and kind == "mark":
            stack.append({} if token == "{" else [])
            names.append(None)
            state = "first name" if token == "{" else "first"
            continue
        elif token == "]" and state == "first":
            value, state = stack.pop(), "done"
            names.pop()
        elif kind == "string":
            value = unquoted(token)
        elif kind == "number":
            value = _number(token)
        elif kind == "name" and token in WORDS:
            value = WORDS[token]
        elif token == "!" and text[at : at + 1] in ("0", "1"):
            value, at = text[at] == "0", at + 1
        else:
            raise ValueError(f"no value at {m.start()}: {token!r}")
        if not stack:
            return value
        if isinstance(stack[-1], dict):
            stack[-1][names[-1]] = value
        else:
            stack[-1].append(value)
        state = "next"


def _number(token: str) -> int | float:
    sign, digits = (-1, token[1:]) if token[0] == "-" else (1, token.lstrip("+"))
    if digits[:2].lower() == "0x":
        return sign * int(digits, 16)
    return sign * (int(digits) if digits.isdecimal() else float(digits))


def around(script: str, name: str, bracket: str = "[") -> int | None:
    """Where the object begins that has the member name with a list or an object (bracket) as its value:
    the innermost brace that is open there, strings and comments passed over. None without one."""
    if name not in script:
        return None
    opened: list[int] = []
    at, before = 0, ["", ""]  # the last two tokens
    while at < len(script):
        m = TOKEN.match(script, at)
        token, kind, at = m[0], m.lastgroup, m.end()
        if kind == "skip":
            continue
        if token == bracket and before == [name, ":"] and opened:
            return opened[-1]
        if kind == "mark" and token == "{":
            opened.append(m.start())
        elif kind == "mark" and token == "}" and opened:
            opened.pop()
        before = [before[1], unquoted(token) if kind == "string" else token]
    return None


def member_list(script: str, name: str) -> list | None:
    """The list `name` of the object literal in a script that has it; None without one, ValueError if the
    literal cannot be read."""
    start = around(script, name)
    found = None if start is None else read(script, start)
    return found[name] if found is not None and isinstance(found.get(name), list) else None
