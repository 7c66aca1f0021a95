"""Validators: a rule's predicate as a Column, its message, and the kinds that it fits.

Lengths are bytes, rune counts are code points. Predicates see a value that isn't null; the compiler skips nulls.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import number_text

STRING, BINARY, INTEGER, NUMBER, BOOLEAN, ARRAY, MAP, OTHER = "string", "binary", "integer", "number", "boolean", "array", "map", "other"
SIZED = frozenset({STRING, BINARY, ARRAY, MAP})
NUMERIC = frozenset({INTEGER, NUMBER})
TEXT = frozenset({STRING})
COMPARED = NUMERIC | TEXT
#: Kinds whose value stands in an error's row.
SHOWN = frozenset({STRING, INTEGER, NUMBER, BOOLEAN})


def size_of(c: Column, kind: str) -> Column:
    return F.octet_length(c) if kind in (STRING, BINARY) else F.size(c)


@dataclass(frozen=True)
class Rule:
    kinds: frozenset[str]
    test: Callable[[Column, str, tuple[str, ...]], Column]
    message: Callable[[Column, str, tuple[str, ...]], Column]
    param: str = "none"  # none, count, number, value, values, text, divisor


def _number(text: str, kind: str) -> Column:
    """A literal in the field's own type: integers stay exact."""
    return F.lit(int(text)) if kind == INTEGER else F.lit(float(text))


def _literal(text: str, kind: str) -> Column:
    return F.lit(text) if kind == STRING else _number(text, kind)


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def value_of(c: Column, kind: str) -> Column:
    """A value as messages show it."""
    return F.coalesce(number_text(c.cast("double"), 1e-4), c.cast("string")) if kind == NUMBER else c.cast("string")


def _text(c: Column) -> Column:
    return c.cast("string")


def _quoted(c: Column | str) -> Column:
    c = F.lit(c) if isinstance(c, str) else c
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), c, F.lit('"'))


def _sized(test, words: str) -> Rule:
    return Rule(SIZED, lambda c, k, a: test(size_of(c, k), int(a[0])), lambda c, k, a: _say("length ", _text(size_of(c, k)), f" {words} {a[0]}"), "count")


def _runes(test, words: str) -> Rule:
    return Rule(TEXT, lambda c, k, a: test(F.char_length(c), int(a[0])), lambda c, k, a: _say("rune count ", _text(F.char_length(c)), f" {words} {a[0]}"), "count")


def _bound(test, words: str) -> Rule:
    # NaN is larger than all numbers here, but passes no bound
    sure = lambda c, k: ~F.isnan(c.cast("double")) if k == NUMBER else F.lit(True)
    return Rule(NUMERIC, lambda c, k, a: test(c, _number(a[0], k)) & sure(c, k), lambda c, k, a: _say("value ", value_of(c, k), f" {words} {a[0]}"), "number")


def _pattern(regex: str, words: str, negate: bool = False) -> Rule:
    return Rule(TEXT, lambda c, k, a: ~F.rlike(c, F.lit(regex)) if negate else F.rlike(c, F.lit(regex)), lambda c, k, a: _say(_quoted(c), f" {words}"))


def _affix(test, words: str) -> Rule:
    return Rule(TEXT, lambda c, k, a: test(c, F.lit("|".join(a))), lambda c, k, a: _say(_quoted(c), f" {words} ", _quoted("|".join(a))), "text")


def _url(c: Column, k: str, a: tuple[str, ...]) -> Column:
    at = F.locate("://", c)
    return (at > 1) & (F.char_length(c) >= at + 3)


# Anchors are \A and \z: Java's $ also matches before a final newline.
RULES: dict[str, Rule] = {
    "notempty": Rule(SIZED, lambda c, k, a: size_of(c, k) > 0, lambda c, k, a: F.lit("must not be empty")),
    "len": _sized(lambda n, x: n == x, "!= required"),
    "minlen": _sized(lambda n, x: n >= x, "below minimum"),
    "maxlen": _sized(lambda n, x: n <= x, "exceeds maximum"),
    "runes": _runes(lambda n, x: n == x, "!= required"),
    "minrunes": _runes(lambda n, x: n >= x, "below minimum"),
    "maxrunes": _runes(lambda n, x: n <= x, "exceeds maximum"),
    "gt": _bound(lambda c, x: c > x, "not greater than"),
    "gte": _bound(lambda c, x: c >= x, "below minimum"),
    "lt": _bound(lambda c, x: c < x, "not less than"),
    "lte": _bound(lambda c, x: c <= x, "exceeds maximum"),
    "eq": Rule(COMPARED, lambda c, k, a: c == _literal("|".join(a), k), lambda c, k, a: _say("value ", value_of(c, k), f" != {'|'.join(a)}"), "value"),
    "neq": Rule(COMPARED, lambda c, k, a: c != _literal("|".join(a), k), lambda c, k, a: F.lit(f"value must not equal {'|'.join(a)}"), "value"),
    "multiple": Rule(frozenset({INTEGER}), lambda c, k, a: c % int(a[0]) == 0, lambda c, k, a: _say(_text(c), f" is not a multiple of {a[0]}"), "divisor"),
    "oneof": Rule(COMPARED, lambda c, k, a: c.isin(*[_literal(x, k) for x in a]), lambda c, k, a: _say("value ", value_of(c, k), f" not in allowed set [{', '.join(a)}]"), "values"),
    "url": Rule(TEXT, _url, lambda c, k, a: _say(_quoted(c), " is not a valid url")),
    "alphanum": _pattern(r"\A[A-Za-z0-9]+\z", "must be alphanumeric"),
    "numeric": _pattern(r"\A[0-9]+\z", "must be all digits"),
    "hexadecimal": _pattern(r"\A[0-9A-Fa-f]+\z", "is not hexadecimal"),
    "islower": _pattern(r"\p{Lu}", "contains uppercase letters", negate=True),
    "isupper": _pattern(r"\p{Ll}", "contains lowercase letters", negate=True),
    "starts": _affix(F.startswith, "does not start with"),
    "ends": _affix(F.endswith, "does not end with"),
    "contains": _affix(F.contains, "does not contain"),
}
#: Markers: presence is judged by the object's keys, not by a predicate.
MARKERS = frozenset({"required", "optional"})
REQUIRED_MESSAGE = "missing required field"
