"""Edit-aware token counts: a segment tree over each document's pre-token runs; an edit re-encodes what it touches.

A text is cut into leaves at borders that no pre-token of the vocabulary spans: before white space, beside a digit (each
digit is a pre-token), between a letter and a mark. So the leaves' counts add up to the text's count. Edits replace the
leaves they touch, all edits of neighbouring leaves at once; a neighbour is taken in as context while the new text's
borders aren't such places. Only those leaves are encoded again, and the sums above them follow in the tree.

Trees are kept: every result row holds its edited text's leaves (code points and tokens of each), and a later call that
gets those rows as `trees` encodes only what its own edits touch. Defined results: null text counts as empty (0 tokens);
edits are spans of the text as it was, in order and without overlap; a tree that is not of this text (by its hash) is
planted anew; repeated rows give repeated rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_texts

#: Code points of a leaf at least, but for the last; white space is looked for first, any border from four times as many.
LEAF = 256
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = frozenset("0123456789")
# Marks that no contraction and no special token of the vocabulary holds.
_MARKS = frozenset("!\"#$%&()*+,-./:;=?@[\\]^_`{}~")


def space_border(left: str, right: str) -> bool:
    return right.isspace() and not left.isspace()


def border(left: str, right: str) -> bool:
    """Whether no pre-token can span the place between two characters."""
    if space_border(left, right):
        return True
    if left in _DIGITS:
        return right in _DIGITS or right in _LETTERS or right in _MARKS
    if left in _LETTERS:
        return right in _DIGITS or right in _MARKS
    return left in _MARKS and (right in _DIGITS or right in _LETTERS)


def cuts(text: str, leaf: int = LEAF) -> list[int]:
    """Starts of the leaves; the first is 0."""
    out, at = [0], leaf
    n = len(text)
    while at < n:
        far = out[-1] + 4 * leaf
        while at < n and not (space_border if at < far else border)(text[at - 1], text[at]):
            at += 1
        if at < n:
            out.append(at)
        at += leaf
    return out


class CountTree:
    """Leaves of a text under a binary tree of token sums."""

    def __init__(self, text: str, count: Callable[[str], int], leaf: int = LEAF, kept: tuple[list[int], list[int]] | None = None):
        """kept: code points and tokens of the leaves, from an earlier tree of this text."""
        self.count, self.leaf = count, leaf
        if kept is not None and sum(kept[0]) == len(text):
            ends = list(itertools.accumulate(kept[0]))
            self.leaves = [text[b - n : b] for n, b in zip(kept[0], ends, strict=True)]
            self.encoded = 0
            self._plant(list(kept[1]))
            return
        starts = cuts(text, leaf)
        self.leaves = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
        self.encoded = len(text)
        self._plant([count(x) for x in self.leaves])

    def kept(self) -> tuple[list[int], list[int]]:
        """Code points and tokens of the leaves that aren't empty."""
        n = [self.size + i for i, x in enumerate(self.leaves) if x]
        return [self.chars[i] for i in n], [self.sums[i] for i in n]

    def _plant(self, counts: list[int]) -> None:
        size = 1
        while size < len(counts):
            size *= 2
        self.size = size
        self.sums = [0] * size + counts + [0] * (size - len(counts))
        self.chars = [0] * size + [len(x) for x in self.leaves] + [0] * (size - len(counts))
        for i in range(size - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    @property
    def tokens(self) -> int:
        return self.sums[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a code point, and the leaf's start."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at - start >= self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def _set(self, leaf: int, text: str) -> None:
        self.encoded += len(text)
        self.leaves[leaf] = text
        node = self.size + leaf
        self.sums[node], self.chars[node] = self.count(text) if text else 0, len(text)
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the code points start to end (exclusive) by `new`."""
        self.edit_all([(start, end, new)])

    def edit_all(self, edits: list[tuple[int, int, str]]) -> None:
        """Edits by places of the text as it is, in order and without overlap; those of the same or neighbouring leaves are one."""
        groups: list[list] = []
        for start, end, new in edits:
            first, at = self.find(start)
            last, _ = self.find(max(start, end - 1))
            if groups and first <= groups[-1][1] + 1:
                groups[-1][1] = max(groups[-1][1], last)
                groups[-1][3].append((start, end, new))
            else:
                groups.append([first, last, at, [(start, end, new)]])
        for first, last, at, own in reversed(groups):
            old, text, done = "".join(self.leaves[first : last + 1]), [], 0
            for start, end, new in own:
                text += [old[done : start - at], new]
                done = end - at
            self._put(first, last, "".join([*text, old[done:]]))

    def _put(self, first: int, last: int, text: str) -> None:
        # boundary context: the borders must still be ones
        while last + 1 < len(self.leaves):
            right = self.leaves[last + 1]
            if right and text and border(text[-1], right[0]):
                break
            text += right
            last += 1
        while first > 0:
            left = self.leaves[first - 1]
            if left and text and border(left[-1], text[0]):
                break
            text = left + text
            first -= 1
        for i in range(first + 1, last + 1):
            if self.leaves[i]:
                self._set(i, "")
        self._set(first, text)

    def rebalance(self) -> None:
        """Cut leaves that edits made long; the tree is planted anew without encoding the others."""
        if all(len(x) <= 8 * self.leaf for x in self.leaves):
            return
        out, counts = [], []
        for i, x in enumerate(self.leaves):
            if len(x) <= 8 * self.leaf:
                out.append(x)
                counts.append(self.sums[self.size + i])
                continue
            starts = cuts(x, self.leaf)
            own = [x[a:b] for a, b in zip(starts, [*starts[1:], len(x)], strict=True)]
            self.encoded += len(x)
            out += own
            counts += [self.count(y) for y in own]
        self.leaves = out
        self._plant(counts)


def mask_edits(text: str) -> list[tuple[int, int, str]]:
    """The edits of the query: personal data is masked."""
    from .pii import spans

    out, done = [], 0
    for a, b, kind, _ in spans(text):
        if a >= done:
            out.append((a, b, f"[{kind}]"))
            done = b
    return out


def count_tokens(
    docs: DataFrame,
    edits: Callable[[str], list[tuple[int, int, str]]] = mask_edits,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    trees: DataFrame | None = None,
) -> DataFrame:
    """Tokens of each document before and after its edits, the code points that had to be encoded, and the tree that remains.

    trees: rows of an earlier call, over the texts that it left behind; their documents are joined by id and text hash.
    """
    text = f"coalesce(`{text_col}`, '')"
    columns = {"id": f"`{id_col}`", "text": text}
    if trees is not None:
        old = trees.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.struct("leaf_chars", "leaf_tokens").alias("__tree"))
        old = old.dropDuplicates(["__id", "__hash"])
        docs = docs.join(old, (F.col(f"`{id_col}`") == F.col("__id")) & (F.xxhash64(F.expr(text)) == F.col("__hash")), "left")
        columns |= {"chars": "__tree.leaf_chars", "tokens": "__tree.leaf_tokens"}

    def make():
        from .wordbpe import WordBpe

        bpe = WordBpe(tokenizer)
        names = ("doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "n_chars_encoded", "n_chars_reencoded", "edited", "leaf_chars", "leaf_tokens")

        def f(b):
            out = {k: [] for k in names}
            kept = zip(b["chars"], b["tokens"], strict=True) if "chars" in b else itertools.repeat((None, None))
            for i, t, k in zip(b["id"], b["text"], kept, strict=False):
                own = edits(t)
                tree = CountTree(t, bpe.count, kept=k if k[0] is not None else None)
                n, planted = tree.tokens, tree.encoded
                if own:
                    tree.edit_all(own)
                    tree.rebalance()
                for c, v in zip(names, (i, n, len(own), tree.tokens, tree.chars[1], planted, tree.encoded - planted, tree.text if own else None, *tree.kept()), strict=True):
                    out[c].append(v)
            yield out

        return f

    schema = "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_edited long, n_chars_encoded long, n_chars_reencoded long, edited string, leaf_chars array<int>, leaf_tokens array<int>"
    got = map_texts(docs, columns | {"hash": f"xxhash64({text})"}, schema + ", hash long", lambda: _with_hash(make()))
    return got.withColumn("text_hash", F.when(F.col("edited").isNull(), F.col("hash")).otherwise(F.xxhash64("edited"))).drop("hash")


def _with_hash(f):
    def run(b):
        for out in f(b):
            yield out | {"hash": b["hash"]}

    return run


def op7_token_counts(spark, sf_dir) -> DataFrame:
    return count_tokens(documents(spark, sf_dir)).drop("edited")
