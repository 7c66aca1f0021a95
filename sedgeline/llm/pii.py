"""Personal data: patterns propose spans, checksum validators confirm them, nearby words adjust the score.

Every text is scanned whole, in time that grows with its length. Base kinds (email, ip, card, phone) follow a fixed
contract; the method adds IBANs that pass mod-97 (of a match that runs on into the words behind it, the part that passes)
and, only when context words near them raise their score to KEEP, national numbers of the 3-2-4 form. Defined results:
null text counts as empty; an empty text has no spans; an empty table gives an empty result; repeated rows give repeated
rows; extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
KEEP = 0.5
#: Code points on either side of a span in which context words count.
WINDOW = 60

# The base patterns.
_EMAIL_TAIL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")  # whole chains of dotted numbers, so that long runs of digits are read once
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# The method's own.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9[0-9][0-9])[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: Lengths of IBANs by country.
IBAN_LENGTH = {
    c: n
    for n, cs in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in cs.split()
}
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "credit", "pay", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "tél"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "insurance"),
}
_NEAR = {k: re.compile("|".join(map(re.escape, v))) for k, v in CONTEXT.items()}
#: Score of a span before its context, after its validator; a context word adds LIFT.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.85, "ssn": 0.4}
LIFT = 0.2


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(text: str) -> bool:
    s = text.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ibans(text: str) -> list[tuple[int, int]]:
    """Parts of the pattern's matches that end at a token's border and pass mod-97: of the country's length, else the longest.

    A match that has none is left at its first character, so that a number inside it is still found.
    """
    out, m = [], _IBAN.search(text)
    while m:
        a, b = m.span()
        ends = [b, *(i for i in range(b - 1, a, -1) if text[i] == " ")]
        own = IBAN_LENGTH.get(text[a : a + 2])
        ends.sort(key=lambda i: len(text[a:i].replace(" ", "")) != own)  # stable: the longest first
        end = next((i for i in ends if mod97(text[a:i])), None)
        if end:
            out.append((a, end))
        m = _IBAN.search(text, end or a + 1)
    return out


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from each @ outwards: linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _EMAIL_TAIL.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of four dotted numbers, each at most 255: of a longer chain the first four, the next four and so on."""
    out = []
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            own = parts[k : k + 4]
            size = sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in own):
                out.append((at, at + size))
            at += size + 1
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def spans(text: str) -> list[tuple[int, int, str, float]]:
    """All spans as (start, end, kind, score) by start, then kind as listed."""
    found = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(a, b, "ip") for a, b in ips(text)]
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                found.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    found.append((*m.span(), "phone"))
        found += [(a, b, "iban") for a, b in ibans(text)]
        if "-" in text:
            for m in _SSN.finditer(text):
                found.append((*m.span(), "ssn"))
    out = []
    for a, b, kind in found:
        near = text[max(0, a - WINDOW) : a].lower() + " " + text[b : b + WINDOW].lower()
        score = min(1.0, PRIOR[kind] + LIFT * bool(_NEAR[kind].search(near)))
        if kind in BASE or score >= KEEP:
            out.append((a, b, kind, round(score, 3)))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str, found: list[tuple[int, int, str, float]]) -> str:
    """Replace each span by its kind in brackets; overlapping spans merge into the first one's."""
    out, at = [], 0
    for a, b, kind, _ in found:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, `found` (array of start, end, kind, score) and the redacted text. No shuffle."""

    def make():
        def f(b):
            got = [spans(t) for t in b["text"]]
            yield {
                "id": b["id"],
                "found": [[{"start": s, "end": e, "kind": k, "score": v} for s, e, k, v in g] for g in got],
                "redacted": [redact(t, g) for t, g in zip(b["text"], got, strict=True)],
            }

        return f

    schema = "id long, found array<struct<start: long, end: long, kind: string, score: double>>, redacted string"
    return map_texts(docs, {"id": f"`{id_col}`", "text": f"coalesce(`{text_col}`, '')"}, schema, make)


def joined(found: list[tuple[int, int, str, float]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k, _ in found)


def op2_pii(spark, sf_dir) -> DataFrame:
    """The digest of all spans of every document."""
    from .common import documents

    spec = documents(spark, sf_dir)

    def make():
        def f(b):
            out = {"doc_id": b["id"], **{f"n_{k}": [] for k in BASE}, "base_sha256": [], "spans": [], "max_score": []}
            for t in b["text"]:
                got = spans(t)
                base = [s for s in got if s[2] in BASE]
                for k in BASE:
                    out[f"n_{k}"].append(sum(s[2] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(got))
                out["max_score"].append(max((s[3] for s in got), default=None))
            yield out

        return f

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, max_score double"
    return map_texts(spec, {"id": "doc_id", "text": "coalesce(text, '')"}, schema, make)


def redact_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every span masked; n_chars follows the text, other columns stay as they are."""
    target = docs.schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in target.fields)

    def make():
        def f(b):
            b["text"] = [t if t is None else redact(t, spans(t)) for t in b["text"]]
            if "n_chars" in b:
                b["n_chars"] = [None if t is None else len(t) for t in b["text"]]
            yield b

        return f

    return map_texts(docs, {c: f"`{c}`" for c in docs.columns}, ddl, make).select([F.col(f"`{c}`") for c in docs.columns])
