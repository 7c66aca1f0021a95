"""Canonical JSON text of rows: key order, omit rules, HTML escaping, quoted numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compiler import kind_of, zero_of
from . import rules as R
from .numbers import finite, number_text

_TO_JSON = {"ignoreNullFields": "false"}


@dataclass(frozen=True)
class Out:
    """How a field leaves: under `name`, left out when empty or zero, or as a quoted number. splice: a map's entries stand behind the named fields."""

    name: str | None = None
    omit_empty: bool = False
    omit_zero: bool = False
    quoted: bool = False
    splice: bool = False


def html_escape(json: Column) -> Column:
    """These characters occur inside strings only."""
    for c in "<>&":
        json = F.replace(json, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return json


def _has_floats(t: T.DataType) -> bool:
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return True
    if isinstance(t, T.StructType):
        return any(_has_floats(f.dataType) for f in t.fields)
    return _has_floats(t.elementType) if isinstance(t, T.ArrayType) else isinstance(t, T.MapType) and _has_floats(t.valueType)


def _plain(c: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(c.alias("v")), _TO_JSON), r'(?s)\A\{"v":(.*)\}\z', 1)


def _list(items: Column, open_: str, close: str) -> Column:
    """Joined texts; null if one is null, as array_join would leave it out."""
    return F.when(F.forall(items, lambda x: x.isNotNull()), F.concat(F.lit(open_), F.array_join(items, ","), F.lit(close)))


def value_text(c: Column, t: T.DataType) -> Column:
    """JSON text of a value; null where a float in it is NaN or infinite."""
    if isinstance(t, (T.DoubleType, T.FloatType)):
        text = number_text(c)
    elif not _has_floats(t):
        text = _plain(c)
    elif isinstance(t, T.ArrayType):
        text = _list(F.transform(c, lambda x: value_text(x, t.elementType)), "[", "]")
    elif isinstance(t, T.MapType):
        text = _list(F.transform(F.map_entries(c), lambda e: F.concat(_plain(e["key"].cast("string")), F.lit(":"), value_text(e["value"], t.valueType))), "{", "}")
    else:
        text = _list(F.array(*[F.concat(_plain(F.lit(f.name)), F.lit(":"), value_text(c[f.name], f.dataType)) for f in t.fields]), "{", "}")
    return F.when(c.isNull(), "null").otherwise(text)


def encodable(df: DataFrame) -> Column:
    """False where a top-level float is NaN or infinite: such a row has no JSON text."""
    out = F.lit(True)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out = out & F.coalesce(finite(F.col(f"`{f.name}`")), F.lit(True))
    return out


def encode(df: DataFrame, fields: dict[str, Out] | None = None, sort_keys: bool = True, html: bool = False) -> Column:
    """The row as a JSON object. Only omitted fields are left out: other nulls are written as null.

    Each field's text is made by itself and joined, so that omit rules and nulls don't hinder each other. A row with a NaN
    or an infinity has no JSON text: the result is null there.
    """
    fields = fields or {f.name: Out() for f in df.schema.fields}
    parts, splices = [], []
    for column, out in sorted(fields.items(), key=lambda x: x[1].name or x[0]) if sort_keys else fields.items():
        c, t = F.col(f"`{column}`"), df.schema[column].dataType
        kind, name = kind_of(t), out.name or column
        value = value_text(c, t)
        if out.splice:
            splices.append(F.when(F.size(c) > 0, F.substr(value, F.lit(2), F.char_length(value) - 2)).otherwise(F.when(c.isNull() | value.isNotNull(), F.lit(""))))
            continue
        value = F.when(c.isNull(), "null").otherwise(F.concat(F.lit('"'), value, F.lit('"')) if out.quoted and kind in R.NUMERIC else value)
        keep = F.lit(True)
        if out.omit_empty and kind in R.SIZED:
            keep = keep & F.coalesce(R.size_of(c, kind) > 0, F.lit(False))
        elif out.omit_empty:
            keep = keep & c.isNotNull()
        if out.omit_zero:
            keep = keep & (c.isNotNull() if kind in (R.ARRAY, R.MAP, R.OTHER) else F.coalesce(c != zero_of(t), F.lit(False)))
        parts.append(F.when(keep, F.concat(_plain(F.lit(name)), F.lit(":"), value)).otherwise(F.lit("")))
    every = F.array(*parts, *splices)
    body = F.array_join(F.filter(every, lambda x: x != ""), ",")
    text = F.when(F.forall(every, lambda x: x.isNotNull()), F.concat(F.lit("{"), body, F.lit("}")))
    return html_escape(text) if html else text


def encode_array(payload: Column, order: Column) -> Column:
    """An aggregate: the group's payloads as one JSON array in that order; [] for an empty group. For bounded groups."""
    found = F.array_sort(F.collect_list(F.struct(order.alias("o"), payload.alias("p"))))
    return F.concat(F.lit("["), F.array_join(F.transform(found, lambda x: x["p"]), ","), F.lit("]"))
