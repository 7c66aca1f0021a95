"""Shortest texts of floating point numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < float("inf"))


def number_text(c: Column, plain_from: float = 1e-6) -> Column:
    """Shortest text of a float or double; the exponent form outside [plain_from, 1e21), as 1e-7 and 1e+21. Null for NaN and infinity.

    The digits come from the engine's own shortest text, at the value's width; only their layout is made here.
    """
    t = c.cast("string")
    short = F.when(F.endswith(t, F.lit(".0")), F.left(t, F.char_length(t) - 2)).otherwise(t)
    near = ~F.contains(t, F.lit("E")) & ((F.abs(c) >= plain_from) | (c == 0))
    return F.when(finite(c), F.when(near, short).otherwise(_laid_out(c, t, plain_from)))


def _laid_out(c: Column, t: Column, plain_from: float) -> Column:
    """The text of a number whose shortest text has an exponent, or needs one."""
    bound = lambda value, body: F.transform(F.array(value), body)[0]
    mantissa = F.regexp_replace(F.substring_index(t, "E", 1), "-", "")
    power = F.coalesce(F.regexp_extract(t, r"E(-?[0-9]+)\z", 1).try_cast("int"), F.lit(0))
    whole, part = F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), r"0+\z", "")
    read = F.struct(F.concat(whole, part).alias("every"), F.char_length(whole).alias("size"), power.alias("power"))

    def parts(r: Column) -> Column:
        digits = F.ltrim(r["every"], F.lit("0"))
        point = r["size"] + r["power"] - (F.char_length(r["every"]) - F.char_length(digits))  # digits before the point
        return F.struct(F.rtrim(digits, F.lit("0")).alias("d"), point.alias("point"))

    def laid(r: Column) -> Column:
        digits, point, n = r["d"], r["point"], F.char_length(r["d"])
        rest = F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise("")
        exponent = F.concat(F.left(digits, F.lit(1)), rest, F.when(point > 0, "e+").otherwise("e-"), F.abs(point - 1).cast("string"))
        plain = (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n)))
            .otherwise(F.concat(F.left(digits, point), F.lit("."), F.substr(digits, point + 1)))
        )
        return F.when((F.abs(c) >= 1e21) | (F.abs(c) < plain_from), exponent).otherwise(plain)

    text = bound(bound(read, parts), laid)
    return F.concat(F.when(F.startswith(t, F.lit("-")), "-").otherwise(""), text)
