"""Transforms of typed columns. All stay in Catalyst."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import INTEGER, NUMERIC, TEXT

# Fixed value: white space that trim strips; U+0085 and U+00A0 are in it, U+FEFF is not.
TRIMMED = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(TRIMMED))


def lower(c: Column) -> Column:
    """Character by character: no final sigma, and one code point for U+0130."""
    return F.lower(F.translate(c, "Σİ", "σi"))


@cache
def _upper_tables() -> tuple[str, str, str]:
    """Characters that full case mapping expands, stand-ins that it leaves alone, and the simple mapping's results."""
    grow = [c for c in map(chr, range(sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000 and len(c.upper()) > 1]
    return "".join(grow), "".join(chr(0xE000 + i) for i in range(len(grow))), "".join(c.title() if len(c.title()) == 1 else c for c in grow)


def upper(c: Column) -> Column:
    """Character by character: what would become several characters keeps its simple mapping."""
    grow, hold, simple = _upper_tables()
    return F.when(F.rlike(c, F.lit(f"[{grow}]")), F.translate(F.upper(F.translate(c, grow, hold)), hold, simple)).otherwise(F.upper(c))


def trim_left(c: Column, prefix: str) -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def trim_right(c: Column, suffix: str) -> Column:
    return F.when(F.endswith(c, F.lit(suffix)), F.left(c, F.char_length(c) - len(suffix))).otherwise(c)


def clamp(c: Column, low: str, high: str, integer: bool) -> Column:
    """The lower bound first, then the upper; an empty bound is none."""
    read = int if integer else float
    if low:
        c = F.when(c < F.lit(read(low)), F.lit(read(low))).otherwise(c)
    if high:
        above = c > F.lit(read(high))
        c = F.when(above if integer else above & ~F.isnan(c.cast("double")), F.lit(read(high))).otherwise(c)  # NaN stays
    return c


@dataclass(frozen=True)
class Mod:
    kinds: frozenset[str]
    apply: Callable[[Column, str, tuple[str, ...]], Column]
    args: int | None = 0


MODS: dict[str, Mod] = {
    "trim": Mod(TEXT, lambda c, k, a: trim(c)),
    "tolower": Mod(TEXT, lambda c, k, a: lower(c)),
    "toupper": Mod(TEXT, lambda c, k, a: upper(c)),
    "trimleft": Mod(TEXT, lambda c, k, a: trim_left(c, "|".join(a)), None),
    "trimright": Mod(TEXT, lambda c, k, a: trim_right(c, "|".join(a)), None),
    "replace": Mod(TEXT, lambda c, k, a: F.replace(c, F.lit(a[0]), F.lit(a[1])), 2),
    "clamp": Mod(NUMERIC, lambda c, k, a: clamp(c, a[0], a[1], k == INTEGER), 2),
}
