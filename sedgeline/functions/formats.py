"""Text formats of scalars: decode guards first, as the built-in readers take more than the formats allow."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def from_hex(c: Column) -> Column:
    """Null for an odd length or other characters."""
    return F.when(F.rlike(c, F.lit(r"\A(?:[0-9A-Fa-f]{2})*\z")), F.unhex(c))


def to_base64(c: Column) -> Column:
    """Without the line breaks that the built-in puts in."""
    return F.regexp_replace(F.base64(c), "[\r\n]", "")


_B64 = r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"


def from_base64(c: Column) -> Column:
    return F.when(F.rlike(c, F.lit(_B64)), F.try_to_binary(c, F.lit("base64")))


def to_base64url(c: Column) -> Column:
    return F.translate(to_base64(c), "+/", "-_")


def from_base64url(c: Column) -> Column:
    return F.when(~F.rlike(c, F.lit("[+/]")), from_base64(F.translate(c, "-_", "+/")))


def to_number_array(c: Column) -> Column:
    """Bytes as numbers 0 to 255."""
    return F.when(F.octet_length(c) == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.octet_length(c) - 1), lambda i: F.conv(F.substring(F.hex(c), i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    )


def from_number_array(c: Column) -> Column:
    """Numbers 0 to 255 as bytes; null where one is outside or null."""
    fits = F.forall(c, lambda x: F.coalesce((x >= 0) & (x <= 255), F.lit(False)))
    return F.when(fits, F.unhex(F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), "")))


def of_length(c: Column, n: int) -> Column:
    """Decoded bytes of exactly that length, else null."""
    return F.when(F.octet_length(c) == n, c)


# Alphabets of base32 and base32hex. The second has the digits of `conv` in base 32.
BASE32, BASE32HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def _rebase(digits: Column, width: int, base: int, to_width: int, to_base: int) -> Column:
    """Digits in another base, `width` of them at a time; a short end is filled with zeros. The text is cut up once: its time is linear."""
    parts = F.regexp_extract_all(digits, F.lit(f".{{1,{width}}}"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.lpad(F.conv(F.rpad(x, width, "0"), base, to_base), to_width, "0")), "")


def to_base32(c: Column, alphabet: str = BASE32) -> Column:
    """Padded text: 60 bits at a time, 15 hexadecimal digits, become twelve characters."""
    size, whole = F.octet_length(c), _rebase(F.hex(c), 15, 16, 12, 32)
    whole = whole if alphabet == BASE32HEX else F.translate(whole, BASE32HEX, alphabet)
    return F.rpad(F.left(whole, F.ceil(size * 8 / 5).cast("int")), F.ceil(size / 5).cast("int") * 8, F.lit("="))


def from_base32(c: Column, alphabet: str = BASE32) -> Column:
    """Null unless the text is upper case and padded; bits beyond the last byte are ignored."""
    one = f"[{alphabet}]"
    shape = rf"\A(?:{one}{{8}})*(?:{one}{{2}}={{6}}|{one}{{4}}={{4}}|{one}{{5}}={{3}}|{one}{{7}}=)?\z"
    body = F.rtrim(c, F.lit("="))
    whole = _rebase(body if alphabet == BASE32HEX else F.translate(body, alphabet, BASE32HEX), 12, 32, 15, 16)
    return F.when(F.rlike(c, F.lit(shape)), F.unhex(F.left(whole, F.floor(F.char_length(body) * 5 / 8).cast("int") * 2)))


_RFC3339 = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])\z"


def from_rfc3339(c: Column) -> Column:
    """Microseconds; digits beyond are cut."""
    return F.when(F.rlike(c, F.lit(_RFC3339)), F.try_to_timestamp(F.regexp_replace(c, r"(\.[0-9]{6})[0-9]+", "$1")))


def to_rfc3339(c: Column) -> Column:
    """UTC, shortest fraction. The session's zone must be UTC."""
    text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", ""), F.lit("Z"))


def to_unix(c: Column, unit: str = "milli") -> Column:
    t = c.cast("timestamp")
    return {"sec": F.unix_seconds, "milli": F.unix_millis, "micro": F.unix_micros}[unit](t) if unit != "nano" else F.unix_micros(t) * 1000


def from_unix(c: Column, unit: str = "milli") -> Column:
    return {"sec": F.timestamp_seconds, "milli": F.timestamp_millis, "micro": F.timestamp_micros}[unit](c) if unit != "nano" else F.timestamp_micros(F.call_function("div", c - F.pmod(c, F.lit(1000)), F.lit(1000)))


# Units of durations in nanoseconds.
UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
_DURATION = r"\A[+-]?(?:0|(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:ns|us|µs|μs|ms|s|m|h))+)\z"


def from_duration(c: Column) -> Column:
    """`1h30m` as nanoseconds; null for other text."""
    parts = F.regexp_extract_all(c, F.lit(r"((?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:ns|us|µs|μs|ms|s|m|h))"), 1)
    scale = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v)])

    def nanos(part: Column) -> Column:
        number, unit = F.regexp_extract(part, r"\A([0-9.]+)", 1), F.regexp_extract(part, r"([a-zµμ]+)\z", 1)
        return (number.try_cast("decimal(28,9)") * scale[unit].cast("decimal(14,0)")).try_cast("decimal(38,0)")

    total = F.aggregate(parts, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + nanos(x)).try_cast("decimal(38,0)"))
    return F.when(F.rlike(c, F.lit(_DURATION)), (total * F.when(F.startswith(c, F.lit("-")), -1).otherwise(1)).try_cast("long"))


def to_duration(c: Column) -> Column:
    """Nanoseconds as `1h30m0s`, `1.5s`, `2ms`, `3µs`, `4ns`, `0s`."""
    n = F.abs(c.cast("decimal(38,0)"))
    part = lambda unit: F.floor(n / F.lit(unit).cast("decimal(20,0)")).cast("long")

    def decimals(unit: int, name: str) -> Column:
        rest = F.lpad(F.pmod(n, F.lit(unit).cast("decimal(20,0)")).cast("long").cast("string"), len(str(unit)) - 1, "0")
        rest = F.regexp_replace(rest, r"0+\z", "")
        return F.concat(part(unit).cast("string"), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit(name))

    small = F.when(n == 0, "0s").when(n < 1000, F.concat(n.cast("string"), F.lit("ns"))).when(n < 1_000_000, decimals(1000, "µs")).otherwise(decimals(1_000_000, "ms"))
    hours, minutes = part(UNITS["h"]), F.pmod(part(UNITS["m"]), F.lit(60))
    second = F.lit(UNITS["s"]).cast("decimal(20,0)")
    tail = F.lpad(F.pmod(n, second).cast("long").cast("string"), 9, "0")
    tail = F.regexp_replace(tail, r"0+\z", "")
    seconds = F.concat(F.pmod(part(UNITS["s"]), F.lit(60)).cast("string"), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""), F.lit("s"))
    large = F.concat(
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"))).otherwise(""), F.when(part(UNITS["m"]) > 0, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(""), seconds
    )
    return F.concat(F.when(c < 0, "-").otherwise(""), F.when(n < UNITS["s"], small).otherwise(large))


def from_duration_number(c: Column, unit: str) -> Column:
    """A number of sec, milli, micro or nano as nanoseconds; null beyond 64 bits."""
    return (c.cast("decimal(28,9)") * F.lit({"sec": 10**9, "milli": 10**6, "micro": 1000, "nano": 1}[unit]).cast("decimal(10,0)")).try_cast("long")


# Named layouts by their reference time, and what each element of a layout is in a pattern.
LAYOUTS = {
    "ANSIC": "Mon Jan _2 15:04:05 2006", "UnixDate": "Mon Jan _2 15:04:05 MST 2006", "RubyDate": "Mon Jan 02 15:04:05 -0700 2006", "RFC822": "02 Jan 06 15:04 MST",
    "RFC822Z": "02 Jan 06 15:04 -0700", "RFC850": "Monday, 02-Jan-06 15:04:05 MST", "RFC1123": "Mon, 02 Jan 2006 15:04:05 MST", "RFC1123Z": "Mon, 02 Jan 2006 15:04:05 -0700",
    "Kitchen": "3:04PM", "Stamp": "Jan _2 15:04:05", "StampMilli": "Jan _2 15:04:05.000", "StampMicro": "Jan _2 15:04:05.000000", "StampNano": "Jan _2 15:04:05.000000000",
    "DateTime": "2006-01-02 15:04:05", "DateOnly": "2006-01-02", "TimeOnly": "15:04:05", "Layout": "01/02 03:04:05PM '06 -0700",
}
_ELEMENTS = [
    ("Monday", "EEEE"), ("January", "MMMM"), ("2006", "yyyy"), ("-07:00", "xxx"), ("Z07:00", "XXX"), ("-0700", "xx"), ("Mon", "EEE"), ("Jan", "MMM"), ("MST", "zzz"),
    ("01", "MM"), ("02", "dd"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("15", "HH"), ("PM", "a"), ("_2", "d"), ("1", "M"), ("2", "d"), ("3", "h"), ("4", "m"), ("5", "s"),
]


def pattern(layout: str) -> str:
    """A layout (named, or written as its reference time) as a date-time pattern."""
    layout, out, at = LAYOUTS.get(layout, layout), "", 0
    while at < len(layout):
        dots = re.match(r"[.,](0+|9+)(?![0-9])", layout[at:])
        hit = next(((a, b) for a, b in _ELEMENTS if layout.startswith(a, at)), None)
        if dots:
            out, at = out + layout[at] + "S" * len(dots[1]), at + len(dots[0])
        elif hit:
            out, at = out + hit[1], at + len(hit[0])
        else:
            out, at = out + (f"'{layout[at]}'" if layout[at].isalpha() else "''" if layout[at] == "'" else layout[at]), at + 1
    return out


def to_layout(c: Column, layout: str) -> Column:
    """In the session's zone, which must be UTC; `_2` pads with a space."""
    layout = LAYOUTS.get(layout, layout)
    pieces = layout.split("_2")
    out = [F.date_format(c, pattern(p)) if p else F.lit("") for p in pieces]
    day = F.lpad(F.dayofmonth(c).cast("string"), 2, " ")
    return F.concat(*[x for k, p in enumerate(out) for x in ((day, p) if k else (p,))])


def from_layout(c: Column, layout: str) -> Column:
    """Null where the text doesn't have the layout. A weekday must be there but isn't checked against the date."""
    layout = LAYOUTS.get(layout, layout)
    for name, days in (("Monday", "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"), ("Mon", "Mon|Tue|Wed|Thu|Fri|Sat|Sun")):
        if layout.startswith(name):
            rest = re.match(r"[^A-Za-z0-9_]*", layout[len(name) :])[0]
            c = F.when(F.rlike(c, F.lit(rf"\A(?:{days}){re.escape(rest)}")), F.regexp_replace(c, rf"\A(?:{days}){re.escape(rest)}", ""))
            layout = layout[len(name) + len(rest) :]
    if "_2" in layout:
        c = F.regexp_replace(c, "  ", " ")
    return F.try_to_timestamp(c, F.lit(pattern(layout)))
