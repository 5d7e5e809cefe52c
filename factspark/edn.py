"""Reading and writing EDN text.

Keywords keep their leading colon as ``Keyword``; symbols are ``Symbol``;
vectors become lists, lists become ``Form`` tuples, sets frozensets, maps
dicts (with hashable keys: vectors and maps as keys become tuples).  Tagged
elements call a reader of the given table, else become ``Tagged``.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from typing import Any


class Keyword(str):
    """A keyword with its colon."""

    __slots__ = ()

    def __repr__(self) -> str:
        return str(self)


class Symbol(str):
    __slots__ = ()

    def __repr__(self) -> str:
        return str(self)


class Form(tuple):
    """A list form, in round brackets."""

    __slots__ = ()


@dataclass(frozen=True)
class Tagged:
    tag: str
    value: Any


_TOKEN = re.compile(r'[\s,]*(?:;[^\n]*\n?[\s,]*)*(#_|#\{|##[A-Za-z]+|#[A-Za-z][^\s\[\](){}",;]*|[\[\](){}^\'`~]|"(?:\\.|[^"\\])*"|\\(?:newline|space|tab|return|u[0-9a-fA-F]{4}|.)|[^\s\[\](){}",;]+)?', re.S)
_INT, _FLOAT, _RATIO = re.compile(r"[+-]?\d+N?$"), re.compile(r"[+-]?\d+(\.\d*)?([eE][+-]?\d+)?M?$"), re.compile(r"[+-]?\d+/\d+$")
_CLOSE = {"[": "]", "(": ")", "{": "}", "#{": "}"}
_SPECIAL = {"##Inf": float("inf"), "##-Inf": float("-inf"), "##NaN": float("nan")}
_CHARS = {"newline": "\n", "space": " ", "tab": "\t", "return": "\r"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _hashable(x: Any) -> Any:
    if isinstance(x, list):
        return tuple(_hashable(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted(((k, _hashable(v)) for k, v in x.items()), key=repr))
    return x


class _Reader:
    def __init__(self, text: str, tags: dict[str, Callable[[Any], Any]]) -> None:
        self.text, self.at, self.tags = text, 0, tags

    def token(self) -> str | None:
        m = _TOKEN.match(self.text, self.at)
        self.at = m.end()
        return m[1]

    def items(self, close: str) -> list:
        out = []
        while True:
            t = self.token()
            if t is None:
                raise ValueError(f"EDN: missing {close}")
            if t == close:
                return out
            if t == "#_":
                self.value(self.token())
                continue
            out.append(self.value(t))

    def value(self, t: str | None) -> Any:  # noqa: PLR0911, PLR0912
        if t is None:
            raise ValueError("EDN: unexpected end")
        if t in _CLOSE:
            xs = self.items(_CLOSE[t])
            if t == "[":
                return xs
            if t == "(":
                return Form(xs)
            if t == "#{":
                return frozenset(map(_hashable, xs))
            if len(xs) % 2:
                raise ValueError("EDN: a map needs an even number of forms")
            return {_hashable(k): v for k, v in zip(xs[::2], xs[1::2], strict=True)}
        if t == "'":
            return self.value(self.token())
        if t == "#_":
            self.value(self.token())
            return self.value(self.token())
        if t[0] == '"':
            return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), t[1:-1], flags=re.S)
        if t in _SPECIAL:
            return _SPECIAL[t]
        if t[0] == "#":
            v = self.value(self.token())
            if (f := self.tags.get(t[1:])) is not None:
                return f(v)
            if t == "#inst":
                return dt.datetime.fromisoformat(v.replace("Z", "+00:00")).astimezone(dt.UTC).replace(tzinfo=None) if "T" in v else dt.datetime.fromisoformat(v)
            return uuid.UUID(v) if t == "#uuid" else Tagged(t[1:], v)
        if t[0] == "\\":
            return _CHARS.get(t[1:], chr(int(t[2:], 16)) if len(t) == 6 and t[1] == "u" else t[1:])
        return atom(t)


def atom(t: str) -> Any:  # noqa: PLR0911
    if t in ("nil", "true", "false"):
        return {"nil": None, "true": True, "false": False}[t]
    if t[0] == ":" and len(t) > 1:
        return Keyword(t)
    if _INT.match(t):
        return int(t.rstrip("N"))
    if _RATIO.match(t):
        return Fraction(t)
    if _FLOAT.match(t):
        return Decimal(t[:-1]) if t[-1] == "M" else float(t)
    return Symbol(t)


def read(text: str, tags: dict[str, Callable[[Any], Any]] | None = None) -> Any:
    """The first form in text."""
    r = _Reader(text, tags or {})
    return r.value(r.token())


def write(x: Any) -> str:  # noqa: PLR0911, PLR0912
    """EDN text of x; str() forms of keywords and symbols stay bare."""
    if x is None:
        return "nil"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, Keyword | Symbol):
        return str(x)
    if isinstance(x, str):
        return '"' + x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '"'
    if isinstance(x, float):
        return "##NaN" if x != x else "##Inf" if x == float("inf") else "##-Inf" if x == float("-inf") else repr(x)
    if isinstance(x, int):
        return str(x)
    if isinstance(x, Decimal):
        return f"{x}M"
    if isinstance(x, Fraction):
        return f"{x.numerator}/{x.denominator}"
    if isinstance(x, dt.datetime):
        return f'#inst "{x.isoformat()}"'
    if isinstance(x, uuid.UUID):
        return f'#uuid "{x}"'
    if isinstance(x, Tagged):
        return f"#{x.tag} {write(x.value)}"
    if isinstance(x, dict):
        return "{" + ", ".join(f"{write(k)} {write(v)}" for k, v in x.items()) + "}"
    if isinstance(x, frozenset | set):
        return "#{" + " ".join(sorted(map(write, x))) + "}"
    if isinstance(x, Form):
        return "(" + " ".join(map(write, x)) + ")"
    if isinstance(x, list | tuple):
        return "[" + " ".join(map(write, x)) + "]"
    raise TypeError(f"no EDN for {type(x).__name__}")
