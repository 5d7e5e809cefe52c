"""Functions and aggregates of queries, as column expressions."""

from collections.abc import Callable
from typing import Any

#: Functions of Python values that pull patterns may name.
_PLAIN: dict[str, Callable[..., Any]] = {
    "inc": lambda x: x + 1, "dec": lambda x: x - 1, "str": lambda x: "" if x is None else str(x), "count": lambda x: len(x or ()), "vector": lambda *x: list(x), "identity": lambda x: x,
    "name": lambda x: str(x).rpartition("/")[2].lstrip(":"), "keyword": lambda x: ":" + str(x).lstrip(":"), "not": lambda x: x is None or x is False, "first": lambda x: x[0] if x else None,
}


def python_builtin(name: str) -> Callable[..., Any]:
    if name not in _PLAIN:
        raise ValueError(f"nothing is named {name}")
    return _PLAIN[name]
