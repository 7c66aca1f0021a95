"""License scans: pigeonhole-split exact seeds locate candidates, bounded-error matching verifies short notices.

A notice of n characters matched with at most k errors contains at least one of k + 1 disjoint pieces unchanged, so the
pieces are exact seeds: an Aho-Corasick automaton over all of them finds the places, and the regex library's fuzzy
matching confirms a window around each place and gives the span. Base phrases are found by consecutive words.
Defined results: null text counts as empty; without words n_words is 0, places are null, labels empty and score 0;
repeated rows give repeated rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import documents, map_texts

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices of the method, in the normal form (words joined by one space), and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "the software is provided as is without warranty of any kind": "mit",
    "licensed under the apache license version 2 0": "apache",
    "this program is free software you can redistribute it and or modify": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the mit license": "mit",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "mozilla public license": "mpl",
    "all rights reserved": "proprietary",
    "the above copyright notice and this permission notice shall be included in all copies": "mit",
    "neither the name of the copyright holder nor the names of its contributors may be used": "bsd",
    "unless required by applicable law or agreed to in writing software distributed under the license": "apache",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "gnu affero general public license": "agpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "european union public licence": "eupl",
    "creative commons zero": "cc0",
}
#: Errors allowed: one for each so many characters of a notice; the exact seeds between them are about as long.
CHARS_PER_ERROR = 12

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BASE = [
    (label, re.compile(rb"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])" + _GAP.join(w.encode() for w in phrase.split()) + rb"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"), phrase.split()[0].encode())
    for phrase, label in PHRASES.items()
]


def errors_allowed(notice: str) -> int:
    return len(notice) // CHARS_PER_ERROR


def pieces(notice: str) -> list[tuple[int, str]]:
    """k + 1 disjoint pieces (offset, text) that cover the notice."""
    k = errors_allowed(notice) + 1
    cuts = [len(notice) * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Compiled once in each task."""

    def __init__(self, notices: dict[str, str] | None = None):
        import ahocorasick
        import regex

        self.notices = list((NOTICES if notices is None else notices).items())
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _) in enumerate(self.notices):
            for off, piece in pieces(n):
                places.setdefault(piece, []).append((i, off))
        self.seeds = ahocorasick.Automaton()
        for piece, at in places.items():
            self.seeds.add_word(piece, (len(piece), at))
        self.seeds.make_automaton()
        self.least = [max(1, len(n) - errors_allowed(n)) for n, _ in self.notices]
        self.fuzzy = [regex.compile(f"(?b)(?:{regex.escape(n)}){{e<={errors_allowed(n)}}}") for n, _ in self.notices]

    def notices_in(self, normal: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) in the normal form of the text, each place once."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, at) in self.seeds.iter(normal):
            for i, off in at:
                n = self.notices[i][0]
                k = errors_allowed(n)
                a = max(0, end + 1 - size - off - k)
                b = min(len(normal), end + 1 - size - off + len(n) + k)
                own = windows.setdefault(i, [])
                if own and a <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], b)
                else:
                    own.append([a, b])
        out = []
        for i, own in windows.items():
            while own:
                a, b = own.pop()
                # the best match of the part; others stand before and behind it
                m = self.fuzzy[i].search(normal, a, b)
                if m:
                    out.append((m.start(), m.end(), self.notices[i][1], sum(m.fuzzy_counts)))
                    own += [[x, y] for x, y in ((a, m.start()), (m.end(), b)) if y - x >= self.least[i]]
        return sorted(out)

    def scan(self, text: str) -> dict:
        low = text.encode("utf-8", "surrogatepass").lower()
        words = _WORD.findall(low)
        starts, base = [], set()
        for label, pattern, first in _BASE:
            if first in low:
                for m in pattern.finditer(low):
                    starts.append(m.start())
                    base.add(label)
        at = []
        if starts:
            starts.sort()
            n, done = 0, 0
            for s in starts:
                n += len(_WORD.findall(low, done, s))
                done = s
                at.append(n)
        normal = b" ".join(words).decode("utf-8", "surrogatepass")
        notices = self.notices_in(normal)
        best = max((1 - e / max(1, b - a) for a, b, _, e in notices), default=0.0)
        return {
            "n_words": len(words),
            "n_base": len(starts),
            "first_word": at[0] if at else None,
            "last_word": at[-1] if at else None,
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {x[2] for x in notices})),
            "score": 1.0 if base else max(0.0, best),
            "notices": [{"start": a, "end": b, "label": x, "edits": e} for a, b, x, e in notices],
        }


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts, labels, score and the notices' spans in the normal form. No shuffle."""

    def make():
        scanner = Scanner()

        def f(b):
            rows = [scanner.scan(t) for t in b["text"]]
            keys = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices")
            yield {"doc_id": b["id"], **{k: [r[k] for r in rows] for k in keys}}

        return f

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<start: long, end: long, label: string, edits: long>>"
    return map_texts(docs, {"id": f"`{id_col}`", "text": f"coalesce(`{text_col}`, '')"}, schema, make)


def op5_licenses(spark, sf_dir) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).drop("notices")
