"""The public word-end BPE vocabulary, encoded through a bounded word cache.

White space always separates pre-tokens of this vocabulary, so the ids of a text are those of its white-space-separated
words one after another. Pre-tokens are frequent, so ids are kept by pre-token; one that is not yet known is merged by a
rank table built from the vocabulary file itself. Anything for which that short way is not known to be the same
(characters beyond U+00FF, control separators, special token strings) goes to the tokenizers library, which is also what
the tests compare with.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

#: Pre-tokens kept in one process; the cache starts anew beyond it.
CACHE_PIECES = 500_000
#: Characters of a pre-token that is kept; longer ones are encoded each time.
CACHE_CHARS = 64

# This vocabulary's pre-token pattern for lower-case text up to U+00FF, and its end-of-word mark.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
_SPLIT = re.compile(r"[^ \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_END = "</w>"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_chars() -> dict[str, int]:
    """The byte that each printable stand-in of byte-level vocabularies means."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in keep}
    for i, b in enumerate(b for b in range(256) if b not in keep):
        out[chr(256 + i)] = b
    return out


assert sys.byteorder == "little" and array("I").itemsize == 4


class WordBpe:
    def __init__(self, path: str | None = None):
        import tiktoken
        from tokenizers import Tokenizer

        path = path or default_path()
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        of, ranks = _byte_chars(), {}
        added = {t.content for t in self.slow.get_added_tokens_decoder().values()}
        for token, i in vocab.items():
            if token in added:
                continue
            end = token.endswith(_END) and len(token) > len(_END)
            body = token[: -len(_END)] if end else token
            raw = bytes(of[c] for c in body) + (b"\xff" if end else b"")
            if raw == b"\xff" and not end:
                continue
            ranks[raw] = i
        ranks[b"\xff"] = max(vocab.values()) + 1  # never left alone: it merges with the byte before it first
        self.added = sorted(added)
        self.fast = tiktoken.Encoding("word-ends", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.cache = _Pieces(self.fast)

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens of a text for which the short way holds, else None."""
        if any(s in text for s in self.added):
            return None
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if any(c in raw for c in b"\x1c\x1d\x1e\x1f"):
            return None
        return _PIECES.findall(text.lower())

    def _slow(self, text: str) -> bytes:
        return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()

    def packed(self, text: str) -> bytes:
        """The ids as unsigned little-endian 32-bit numbers."""
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        found = self.pieces(text)
        if found is not None:
            return b"".join(map(self.cache.__getitem__, found))
        if any(s in text for s in self.added):
            return self._slow(text)
        out: list[bytes] = []
        for w in _SPLIT.findall(text):
            got = self.pieces(w)
            out += [self._slow(w)] if got is None else map(self.cache.__getitem__, got)
        return b"".join(out)

    def ids(self, text: str) -> list[int]:
        return array("I", self.packed(text)).tolist()

    def count(self, text: str) -> int:
        return len(self.packed(text)) // 4


class _Pieces(dict):
    def __init__(self, fast):
        super().__init__()
        self.fast = fast._core_bpe

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.fast.encode_single_piece(piece.encode() + b"\xff")).tobytes()
        if len(piece) <= CACHE_CHARS:
            self[piece] = ids
        return ids
