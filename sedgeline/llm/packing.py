"""Packing by power-of-two decomposition: every document is cut into pieces of binary lengths, equal lengths share a bucket.

A document of n ids (its tokens and the closing id) becomes floor(n / max_len) pieces of max_len and one piece for each
set bit of the rest, longest first. Each piece is a sequence of its own: a sequence never crosses documents, and every
length is a power of two, so nothing is padded. The bucket of a sequence is the logarithm of its length. No shuffle: each
task cuts its own documents; sequence ids are (task, running number), the same on a rerun over the same input splits.
Defined results: null text counts as empty; an empty document is its closing id alone; repeated rows are packed again;
extra columns are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame

from .common import documents, map_texts

MAX_LEN = 2048
CLOSING_ID = 1
#: Bits of a sequence id below the task's number.
RUNNING_BITS = 36
#: Pieces in one Arrow batch of the result.
BATCH_PIECES = 20_000

_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def piece_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Lengths of the pieces of n ids, longest first; max_len is a power of two."""
    out = [max_len] * (n // max_len)
    rest = n % max_len
    return out + [1 << b for b in range(max_len.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, max_len: int = MAX_LEN, with_ids: bool = False
) -> DataFrame:
    """One row a piece; with_ids adds the ids themselves (array of int)."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    columns = (*_COLUMNS, "ids") if with_ids else _COLUMNS

    def make():
        import numpy as np
        from pyspark import TaskContext

        from .wordbpe import WordBpe

        bpe = WordBpe(tokenizer)
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        at = [(TaskContext.get().partitionId() if TaskContext.get() else 0) << RUNNING_BITS]

        def f(b):
            out = {c: [] for c in columns}
            for i, t in zip(b["id"], b["text"], strict=True):
                raw = bpe.packed(t) + closing
                total, start = len(raw) // 4, 0
                for n in piece_lengths(total, max_len):
                    own = raw[4 * start : 4 * (start + n)]
                    row = (i, start, n, zlib.crc32(own), total, at[0], 0, n.bit_length() - 1)
                    for c, v in zip(_COLUMNS, row, strict=True):
                        out[c].append(v)
                    if with_ids:
                        out["ids"].append(np.frombuffer(own, "<u4").tolist())
                    at[0] += 1
                    start += n
                if len(out["doc_id"]) >= BATCH_PIECES:
                    yield out
                    out = {c: [] for c in columns}
            yield out

        return f

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int" + ", ids array<int>" * with_ids
    return map_texts(docs, {"id": f"`{id_col}`", "text": f"coalesce(`{text_col}`, '')"}, schema, make)


def op10_packing(spark, sf_dir) -> DataFrame:
    return pack(documents(spark, sf_dir))


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
