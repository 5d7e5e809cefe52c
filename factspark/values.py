"""Values of different types in one column, and the kinds that the planner tells apart.

A kind is one of long, double, string, keyword, symbol, bool, ts, uuid, array,
other, any, gid, or ``eid:table``.  Columns of kind any are tagged structs whose
order is the order across types: keywords, collections, symbols, booleans,
numbers, strings, instants, uuids.
"""

from __future__ import annotations

import datetime as dt
import uuid
from decimal import Decimal
from fractions import Fraction
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .edn import Keyword, Symbol, write

ANY = "struct<rank:tinyint,num:double,lng:bigint,str:string,bool:boolean,ts:timestamp_ntz>"
#: The order of types.
RANKS = {"keyword": 0, "array": 1, "other": 1, "symbol": 2, "bool": 3, "long": 4, "double": 4, "string": 5, "ts": 6, "uuid": 7}
ENTITY_BITS = 40


def kind_of_type(t: T.DataType) -> str:
    if isinstance(t, T.LongType | T.IntegerType | T.ShortType | T.ByteType):
        return "long"
    if isinstance(t, T.DoubleType | T.FloatType | T.DecimalType):
        return "double"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "ts"
    return "array" if isinstance(t, T.ArrayType) else "any" if t.simpleString() == ANY else "other"


def kind_of(x: Any) -> str:  # noqa: PLR0911
    if isinstance(x, bool):
        return "bool"
    if isinstance(x, int):
        return "long"
    if isinstance(x, float | Fraction | Decimal):
        return "double"
    if isinstance(x, Keyword):
        return "keyword"
    if isinstance(x, Symbol):
        return "symbol"
    if isinstance(x, str):
        return "string"
    if isinstance(x, dt.datetime | dt.date):
        return "ts"
    if isinstance(x, uuid.UUID):
        return "uuid"
    return "array" if isinstance(x, list | tuple) else "other"


def literal(x: Any) -> Column:
    """A Python value as a native literal."""
    k = kind_of(x)
    if k == "double":
        return F.lit(float(x))
    if k == "long":
        return F.lit(x).cast("bigint")
    if k in ("keyword", "symbol", "string", "uuid"):
        return F.lit(str(x))
    if k == "array":
        return F.array(*[literal(y) for y in x])
    if k == "ts":
        return F.lit(x).cast("timestamp_ntz")
    return F.lit(x) if k == "bool" else F.lit(write(x))


def order_text(x: Any) -> str:
    """A collection as text: its length first, so that shorter ones sort first."""
    return f"{len(x):08d}{write(x)}" if isinstance(x, list | tuple) else write(x)


def tagged(x: Any) -> tuple:
    """A Python value as the fields of ANY."""
    k = kind_of(x)
    num = float(x) if k in ("long", "double") else None
    text = str(x) if k in ("keyword", "symbol", "string", "uuid") else order_text(x) if k in ("array", "other") else None
    return (RANKS[k], num, x if k == "long" else None, text, x if k == "bool" else None, x if k == "ts" else None)


def frozen(x: Any) -> Any:
    return tuple(map(frozen, x)) if isinstance(x, list | tuple) else x


def untagged(row: Any) -> Any:
    """The Python value of the fields of ANY."""
    from .edn import read

    rank, num, lng, text, flag, ts = row
    if rank == RANKS["keyword"]:
        return Keyword(text)
    if rank == RANKS["array"]:
        return frozen(read(text[8:] if text[:8].isdigit() else text))
    if rank == RANKS["symbol"]:
        return Symbol(text)
    if rank == RANKS["bool"]:
        return flag
    if rank == RANKS["long"]:
        return lng if lng is not None else num
    if rank == RANKS["uuid"]:
        return uuid.UUID(text)
    return ts if rank == RANKS["ts"] else text


def to_any(c: Column, kind: str) -> Column:
    if kind == "any":
        return c
    none = lambda t: F.lit(None).cast(t)
    integral = kind in ("long", "gid")
    rank = RANKS["long"] if integral else RANKS[kind]
    text = c if kind in ("keyword", "symbol", "string", "uuid") else F.to_json(F.struct(c.alias("v"))) if kind in ("array", "other") else none("string")
    return F.struct(
        F.lit(rank).cast("tinyint").alias("rank"), (c.cast("double") if integral or kind == "double" else none("double")).alias("num"), (c.cast("bigint") if integral else none("bigint")).alias("lng"),
        text.alias("str"), (c if kind == "bool" else none("boolean")).alias("bool"), (c.cast("timestamp_ntz") if kind == "ts" else none("timestamp_ntz")).alias("ts"),
    )


def from_any(c: Column, kind: str) -> Column:
    """The native column of a tagged one whose values all have the kind."""
    part = {"long": "lng", "double": "num", "bool": "bool", "ts": "ts"}.get(kind, "str")
    return c[part] if kind not in ("any", "array", "other") else c
