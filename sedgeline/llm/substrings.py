"""Substring dedup by super-k-mer partitioning: windows of 35 words that start anywhere else lose their words.

Each window has a minimiser, the smallest hash of its runs of MINI words. Consecutive windows that share one travel as
one packed string to the minimiser's bucket: equal windows have equal minimisers, so they meet there, where sorting the
windows' 128-bit hashes counts them exactly. What comes back are intervals of repeated windows; each document merges its
own and drops the words they cover. Strings that repeat inside a batch travel once, with a mark, so that thousands of
copies cost one string a batch. A minimiser that very many different strings share (a common line) would fill one bucket;
its windows travel one by one, bucketed by their own hash. That list is bounded and only changes the way, not the result.

Defined results: null text has no words; documents under 35 words lose nothing; a row that repeats counts as elsewhere;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, slices
from .wordhash import mixed, sliding_min, windows, words

WINDOW = 35
MINI = 4
#: Bytes of text for which there is one bucket.
BUCKET_BYTES = 2_000_000
MIN_BUCKETS = 64
#: A minimiser counts as common in a batch from this share of the batch's strings, and this many of them.
COMMON_SHARE, COMMON_LEAST = 1 / 2000, 16
#: Common in all batches together: this many strings. At most so many are kept.
COMMON_TOTAL, COMMON_KEPT = 2000, 50_000

_ROW = "bucket int, packed binary, doc array<long>, mark array<long>, start array<int>, n array<int>, kind array<tinyint>, w1 array<long>, w2 array<long>"
ONCE, FIRST, AGAIN, SINGLE, SINGLE_FIRST, SINGLE_AGAIN = range(6)


class _Runs:
    """The strings of one batch, as arrays over runs of windows."""

    def __init__(self, texts: list[bytes | None]):
        texts = [t or b"" for t in texts]
        raw = b"\n".join(texts)
        offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
        h, self.starts, self.ends = words(raw)
        self.raw = raw
        first = np.searchsorted(self.starts, offsets)  # first word of each document
        counts = np.diff(first)
        valid = np.maximum(counts - WINDOW + 1, 0)
        doc = np.repeat(np.arange(len(texts)), valid)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(valid) - valid, valid) + np.repeat(first[:-1], valid)
        self.w1, self.w2 = windows(h, WINDOW), windows(h, WINDOW, second=True)
        low = sliding_min(windows(h, MINI), WINDOW - MINI + 1)[at] if len(at) else np.zeros(0, np.uint64)
        new = np.ones(len(at), bool)
        new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        off = np.arange(len(at)) - np.repeat(begin, np.diff([*begin, len(at)]))
        begin = np.flatnonzero(off % (WINDOW - MINI) == 0)  # longer runs are cut, so that both end windows tell all
        self.first_word = first
        self.s = at[begin]
        self.n = np.diff([*begin, len(at)]).astype(np.int64)
        self.doc = doc[begin]
        self.low = low[begin]
        e = self.s + self.n - 1
        self.k1 = mixed(self.w1[self.s] + mixed(self.w1[e] + self.n.astype(np.uint64)))
        self.k2 = mixed(self.w2[self.s] + mixed(self.w2[e] + self.n.astype(np.uint64)))

    def start_in_doc(self, s, doc):
        return s - self.first_word[doc]


def _groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort order, and for each place of it whether it opens a group and whether its group has others."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    opens = np.ones(len(order), bool)
    opens[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    alone = opens & np.append(opens[1:], True) if len(order) else opens
    return order, opens, ~alone


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def common_minimisers(texts: DataFrame) -> list[int]:
    """Minimisers of very many different strings, from all texts; bounded by COMMON_KEPT."""

    def run(batches):
        for b in (part for whole in batches for part in slices(whole)):
            r = _Runs(b["raw"].to_pylist())
            order, opens, _ = _groups(r.k1, r.k2)
            low, n = np.unique(r.low[order[opens]], return_counts=True)
            keep = n >= max(COMMON_LEAST, COMMON_SHARE * len(r.low))
            yield pa.RecordBatch.from_pydict({"low": _signed(low[keep]), "n": n[keep].astype(np.int64)})

    found = texts.select("raw").mapInArrow(run, "low long, n long").groupBy("low").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_TOTAL)
    return [r[0] for r in found.orderBy(F.desc("n"), "low").limit(COMMON_KEPT).collect()]


def _pack(texts: DataFrame, buckets: int, common: list[int]) -> DataFrame:
    hot = np.array(sorted(common), np.int64).view(np.uint64)
    hot.sort()

    def rows(r: _Runs, ids: np.ndarray, marks: np.ndarray):
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        is_hot = np.isin(r.low, hot) if len(hot) else np.zeros(len(r.low), bool)
        plain = np.flatnonzero(~is_hot)
        order, opens, more = _groups(r.k1[plain], r.k2[plain])
        kind = np.where(opens, np.where(more, FIRST, ONCE), AGAIN).astype(np.int8)
        i = plain[order]
        parts = [(mixed(r.low[i]) % np.uint64(buckets), kind, r.s[i], r.n[i], r.doc[i])]
        if len(plain) < len(r.low):  # windows of common minimisers, one by one
            j = np.flatnonzero(is_hot)
            doc = np.repeat(r.doc[j], r.n[j])
            s = np.repeat(r.s[j], r.n[j]) + np.arange(r.n[j].sum()) - np.repeat(np.cumsum(r.n[j]) - r.n[j], r.n[j])
            order, opens, more = _groups(r.w1[s], r.w2[s])
            kind = np.where(opens, np.where(more, SINGLE_FIRST, SINGLE), SINGLE_AGAIN).astype(np.int8)
            s, doc = s[order], doc[order]
            parts.append((mixed(r.w1[s]) % np.uint64(buckets), kind, s, np.ones(len(s), np.int64), doc))
        bucket, kind, s, n, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((kind, bucket))
        bucket, kind, s, n, doc = bucket[order], kind[order], s[order], n[order], doc[order]
        edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, int)
        a, b = r.starts[s], r.ends[s + n - 1 + WINDOW - 1]
        single = kind >= SINGLE
        w1, w2 = _signed(np.where(single, r.w1[s], 0)), _signed(np.where(single, r.w2[s], 0))
        start = r.start_in_doc(s, doc).astype(np.int32)
        raw = r.raw
        for x, y in zip(edge, [*edge[1:], len(bucket)], strict=True):
            with_words = x + int(np.searchsorted(kind[x:y], AGAIN))
            blob = b"\n".join([raw[p:q] for p, q in zip(a[x:with_words].tolist(), b[x:with_words].tolist(), strict=True)])
            own = slice(x, y)
            own_single = slice(x + int(np.searchsorted(kind[x:y], SINGLE)), y)
            yield (int(bucket[x]), press.compress(blob), ids[doc[own]], marks[doc[own]], start[own], n[own].astype(np.int32), kind[own], w1[own_single], w2[own_single])

    def lists(arrays, kind):
        offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), kind))

    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int8(), pa.int64(), pa.int64())
        names = ("doc", "mark", "start", "n", "kind", "w1", "w2")
        for batch in (part for whole in batches for part in slices(whole)):
            r = _Runs(batch["raw"].to_pylist())
            ids = batch["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64)
            marks = batch["mark"].to_numpy(zero_copy_only=False).astype(np.int64)
            out = list(rows(r, ids, marks))
            for at in range(0, len(out), 256):
                cols = list(zip(*out[at : at + 256], strict=True))
                table = {"bucket": pa.array(cols[0], pa.int32()), "packed": pa.array(cols[1], pa.binary())}
                yield pa.RecordBatch.from_pydict(table | {c: lists(v, k) for c, v, k in zip(names, cols[2:], kinds, strict=True)})

    return texts.select("doc_id", "mark", "raw").mapInArrow(run, _ROW)


def _count(table: pa.Table) -> pa.Table:
    """One bucket: intervals (doc, mark, start, n) of windows that occur twice or more."""
    import zstandard

    out = zstandard.ZstdDecompressor()
    blobs = [out.decompress(x) for x in table["packed"].to_pylist()]
    col = {c: np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in table[c]]) for c in ("doc", "mark", "start", "n", "kind")}
    singles = {c: np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in table[c]]).view(np.uint64) for c in ("w1", "w2")}
    kind, n = col["kind"], col["n"].astype(np.int64)
    known = np.isin(kind, (FIRST, AGAIN, SINGLE_FIRST, SINGLE_AGAIN))
    lettered, single = np.flatnonzero(kind <= FIRST), np.flatnonzero(kind >= SINGLE)
    h, _, _ = words(b"\n".join(x for x in blobs if x))
    size = n[lettered] + WINDOW - 1
    base = np.cumsum(size) - size
    owner = np.repeat(lettered, n[lettered])
    off = np.arange(len(owner)) - np.repeat(np.cumsum(n[lettered]) - n[lettered], n[lettered])
    at = np.repeat(base, n[lettered]) + off
    w1, w2 = windows(h, WINDOW)[at] if len(at) else np.zeros(0, np.uint64), windows(h, WINDOW, second=True)[at] if len(at) else np.zeros(0, np.uint64)
    fresh = kind[single] != SINGLE_AGAIN
    owner = np.concatenate([owner, single[fresh]])
    off = np.concatenate([off, np.zeros(fresh.sum(), np.int64)])
    order, _, more = _groups(np.concatenate([w1, singles["w1"][fresh]]), np.concatenate([w2, singles["w2"][fresh]]))
    hit = order[more]
    hit = hit[~known[owner[hit]]]
    hit = hit[np.lexsort((off[hit], owner[hit]))]
    who, where = owner[hit], off[hit]
    new = np.ones(len(hit), bool)
    new[1:] = (who[1:] != who[:-1]) | (where[1:] != where[:-1] + 1)
    begin = np.flatnonzero(new)
    count = np.diff([*begin, len(hit)])
    whole = np.flatnonzero(known)
    i = np.concatenate([who[begin], whole])
    start = col["start"][i] + np.concatenate([where[begin], np.zeros(len(whole), np.int64)])
    count = np.concatenate([count, n[whole]])
    return pa.table({"doc": col["doc"][i], "mark": col["mark"][i], "start": start.astype(np.int32), "n": count.astype(np.int32)})


def repeated_intervals(texts: DataFrame) -> DataFrame:
    """(doc, mark, start, n): n consecutive windows from word `start` repeat. texts: doc_id, mark, raw."""
    total = texts.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    buckets = max(MIN_BUCKETS, total // BUCKET_BYTES)
    packed = _pack(texts, int(buckets), common_minimisers(texts))
    return packed.groupBy("bucket").applyInArrow(_count, "doc long, mark long, start int, n int")


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256, and the kept text on demand."""
    texts = docs.select(
        F.col("doc_id").alias("id"), F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.xxhash64("doc_id", "text").alias("mark"), F.col("text").cast("binary").alias("raw")
    )
    found = repeated_intervals(texts).groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    found = found.select(F.col("doc").alias("doc_id"), "mark", "spans")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def run(batches):
        for b in batches:
            out = {c: [] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")} | ({"kept": []} if with_text else {})
            for i, raw, spans in zip(b["id"].to_pylist(), b["raw"], b["spans"], strict=True):
                own = (raw.as_py() or b"").split()
                n = len(own)
                if spans.is_valid:
                    s = spans.values
                    a = s.field("start").to_numpy().astype(np.int64)
                    e = a + s.field("n").to_numpy() + WINDOW - 1
                    gone = np.zeros(n + 1, np.int64)
                    np.add.at(gone, a, 1)
                    np.add.at(gone, e, -1)
                    keep = np.cumsum(gone[:n]) == 0
                    own = [own[k] for k in np.flatnonzero(keep).tolist()]
                kept = b" ".join(own)
                row = [i, n, n - len(own), hashlib.sha256(kept).hexdigest()] + ([kept.decode()] if with_text else [])
                for c, v in zip(out, row, strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.string() if c in ("kept_sha256", "kept") else pa.int64()) for c in out]))

    both = texts.join(found, ["doc_id", "mark"], "left").select("id", "raw", "spans")
    return both.mapInArrow(run, schema)


def op6_substrings(spark, sf_dir) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
