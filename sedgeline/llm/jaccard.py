"""N-gram Jaccard join: exact components of documents whose shingle sets have a Jaccard distance of at most RADIUS.

Jaccard distance is a metric, so distances to a pivot say much at once: what lies within RADIUS of the pivot is linked
with it, and two documents whose distances to it differ by more than RADIUS can't be linked. The join works in regions:

1. Seeds. Two linked documents share one of their first floor(n / 4) + 1 shingles in any common order of all shingles, so
   each shingle (a pivot that is a single shingle) is a region, and a document is replicated to the regions of that
   window. Shingles that are common in some batch come last in the order; that list is bounded and changes the order only,
   never the result. Regions of one document vanish; regions with the same documents are one. Sizes and sketches (parities
   by hash bits, which bound the distance from below) drop documents that can't be linked with any other of the region.
2. Voronoi cells. Inside a region a few documents become pivots and all distances to them are measured exactly. Each
   document goes to the cell of its nearest pivot; one that lies within 2 * RADIUS of being nearer to another pivot is
   replicated to that cell too. Documents at OUTER or more from every pivot are a cell of their own, to which those
   within RADIUS of that border are replicated. A linked pair meets in the cell that one of them calls home.
3. Recursion. Cells are split again. A cell whose documents are all in one component is done; a region whose cells aren't
   smaller (all documents about equally far from each other) is finished by taking each document outside its largest
   component as a pivot. Cells up to LARGE shingles are one task's work; larger ones are split by rounds over the whole table.

Each document is compared in one region first, its largest, and so on for PASSES passes; what is still open then (regions
of several components, pairs that had no region in common so far) is compared in a last pass over all regions. Copies of one set are one class. Only links leave a task:
one for each document that joins a component there. Links and components stay in tables; components come from label
spreading with pointer jumps.

Defined results: null text and texts without words have n_shingles 0 and are alone; fewer than five words are one shingle;
a row that repeats is a copy; rows with one doc_id and different texts are judged each by its own text; a null doc_id
takes no part and has a null component; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_skewed, documents, key_runs, lean_memory, release, slices, stage, unstage
from .wordhash import mixed, windows, words

GRAM = 5
#: Linked: PERCENT * |union| <= 100 * |intersection|; the distance is at most RADIUS.
PERCENT = 75
RADIUS = 1 - PERCENT / 100
#: Distance from every pivot beyond which a document belongs to the outer cell.
OUTER = 1 - RADIUS
#: Shingles in so many documents of one batch, and of all batches together, come last in the order; at most so many.
COMMON_BATCH, COMMON_TOTAL, COMMON_KEPT = 2, 8, 200_000
#: Bytes of text for which there is one bucket of seeds.
BUCKET_BYTES, MIN_BUCKETS = 2_000_000, 64
#: Bytes of a shingle's hash that travel to its bucket: two shingles that agree in them share a region, which costs time only.
TOKEN_BYTES = 5
#: Shingles of a region that one task holds.
LARGE = 1 << 20
#: Documents of a region that are compared without pivots, and pivots of a region.
LEAF, PIVOTS = 12, 8
#: Cells are worth it while the largest has at most this share of the region, and all together so many times its documents.
SHRINK, MOST_COPIES = 0.8, 2
#: Passes in which each document is compared in one region only, before the last pass over all that is left.
PASSES = 3
#: Documents of a region that are held against each other by sketches; in larger ones all stay.
SKETCHED = 4000
#: Bytes of the smallest sketch, and classes that may be broadcast (16 bytes each) once they are counted.
SKETCH_LEAST, BROADCAST_IDS = 64, 500_000


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; ASCII letters are lower-cased."""
    texts = [(t or b"").lower() for t in texts]
    out = []
    at = 0
    while at < len(texts):  # a few MB at a time
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < 1 << 22):
            size += len(texts[end])
            end += 1
        h, starts, _ = words(b"\n".join(texts[at:end]))
        edge = np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts[at:end]]]))
        grams = windows(h, GRAM)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            n = b - a
            if n >= GRAM:
                out.append(np.unique(grams[a : b - GRAM + 1]))
            else:
                out.append(mixed(windows(h[a:b], n) + np.uint64(n)) if n else np.zeros(0, np.uint64))
        at = end
    return out


def set_class(s: np.ndarray) -> int:
    """64 bits of a set, as a signed number: the name of its class."""
    x = int(mixed(s ^ np.uint64(0x51ED270B)).sum(dtype=np.uint64)) + 0x9E3779B97F4A7C15 * len(s) & (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def sketch(s: np.ndarray) -> bytes:
    """Parities of a set's hashes by their last bits, one bit each: two to four bits for a shingle.

    A bit differs between two sketches only if some shingle is in one set alone, so the bits that differ bound the
    symmetric difference from below. A longer sketch folds to a shorter one by exclusive or.
    """
    size = SKETCH_LEAST
    while size * 4 < len(s):
        size *= 2
    odd = np.bincount((s & np.uint64(size * 8 - 1)).astype(np.int64), minlength=size * 8) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """Sketches (last axis, in 64-bit parts) at `size` parts."""
    return np.bitwise_xor.reduce(x.reshape(*x.shape[:-1], -1, size), axis=-2)


class Sketches:
    """Sketches of documents side by side, by length, to be held against one document at a time."""

    def __init__(self, sketches: list[bytes], n: np.ndarray):
        self.n = n
        self.length = np.array([len(e) for e in sketches], np.int64)
        self.of = {}
        for size in np.unique(self.length).tolist():
            rows = np.flatnonzero(self.length == size)
            self.of[size // 8] = (rows, np.frombuffer(b"".join(sketches[i] for i in rows.tolist()), np.uint64).reshape(len(rows), size // 8))

    def may_link(self, e: bytes, n: int, wanted: np.ndarray | None = None) -> np.ndarray:
        """False only for documents that can't be linked with this one: by sizes, or as parities differ by too much."""
        out = 100 * np.minimum(self.n, n) >= PERCENT * np.maximum(self.n, n)
        if wanted is not None:
            out &= wanted
        q = np.frombuffer(e, np.uint64)
        for size, (rows, x) in self.of.items():
            near = out[rows]
            if not near.any():
                continue
            rows, x, same = rows[near], x[near], min(size, len(q))
            differ = np.bitwise_count(folded(x, same) ^ folded(q, same)).sum(axis=-1, dtype=np.int64)
            out[rows] = (100 + PERCENT) * differ <= (100 - PERCENT) * (self.n[rows] + n)
        return out


def may_link(a: bytes, b: bytes, na: int, nb: int) -> bool:
    return bool(Sketches([a], np.array([na])).may_link(b, nb)[0])


def linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (100 * inter >= PERCENT * (a + b - inter)) & (inter > 0)


class Region:
    """Documents of one region in one task: sets as places in the region's own list of shared shingles."""

    def __init__(self, sets: list[np.ndarray], n: np.ndarray, component: np.ndarray, homes: tuple[np.ndarray, ...] = ()):
        """component: documents of one known component have one number. homes: pairs with an equal number in one of them are settled."""
        self.n, self.homes = n, homes
        size = np.array([len(s) for s in sets], np.int64)
        token = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.known, place, count = np.unique(token, return_inverse=True, return_counts=True)
        shared = count[place] > 1  # the others meet nothing here
        doc = np.repeat(np.arange(len(sets)), size)[shared]
        self.place = place[shared].astype(np.int32)
        self.offset = np.append(0, np.cumsum(np.bincount(doc, minlength=len(sets)))).astype(np.int64)
        self.mark = np.zeros(len(self.known) + 1, bool)
        _, self.root = np.unique(component, return_inverse=True)
        self.joined: list[tuple[int, int]] = []

    def distances(self, pivots: np.ndarray, idx: np.ndarray):
        """For each pivot the linked documents among idx, and all distances."""
        begin, length = self.offset[idx], self.offset[idx + 1] - self.offset[idx]
        flat = np.repeat(begin - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
        place = self.place[flat]
        edge = np.append(0, np.cumsum(length))
        for p in pivots.tolist():
            own = self.place[self.offset[p] : self.offset[p + 1]]
            self.mark[own] = True
            total = np.append(0, np.cumsum(self.mark[place], dtype=np.int64))
            self.mark[own] = False
            inter = total[edge[1:]] - total[edge[:-1]]
            yield p, linked(inter, self.n[idx], self.n[p]), 1 - inter / np.maximum(1, self.n[idx] + self.n[p] - inter)

    def join(self, p: int, others: np.ndarray) -> None:
        """One component of p and the others."""
        for r in np.unique(self.root[others]).tolist():
            if r != self.root[p]:
                self.joined.append((p, int(others[np.flatnonzero(self.root[others] == r)[0]])))
                self.root[self.root == r] = self.root[p]

    def open_pairs(self, idx: np.ndarray) -> bool:
        return len(idx) > 1 and bool((self.root[idx] != self.root[idx[0]]).any())

    def exhaust(self, idx: np.ndarray) -> None:
        """Each document outside the largest component is held against all others."""
        roots, count = np.unique(self.root[idx], return_counts=True)
        most = roots[np.argmax(count)]
        for i in idx[self.root[idx] != most].tolist():
            near = (self.root[idx] != self.root[i]) & (100 * np.minimum(self.n[idx], self.n[i]) >= PERCENT * np.maximum(self.n[idx], self.n[i]))
            for h in self.homes:
                near &= h[idx] != h[i]
            if near.any():
                others = idx[near]
                for p, close, _ in self.distances(np.array([i]), others):
                    if close.any():
                        self.join(p, others[close])

    def search(self, idx: np.ndarray, seed: int = 1) -> None:
        """All links among idx, by Voronoi cells of a few pivots and cells of cells."""
        todo = [(idx, seed)]
        while todo:
            idx, seed = todo.pop()
            if not self.open_pairs(idx):
                continue
            if len(idx) <= LEAF:
                self.exhaust(idx)
                continue
            rng = np.random.default_rng(seed)
            pivots = np.sort(rng.choice(idx, PIVOTS, replace=False))
            d = np.empty((len(pivots), len(idx)))
            for k, (p, close, far) in enumerate(self.distances(pivots, idx)):
                d[k] = far
                if close.any():
                    self.join(p, idx[close])
            rest = ~np.isin(idx, pivots)  # a pivot's links are all known
            idx, d = idx[rest], d[:, rest]
            cells = voronoi(d)
            if sum(map(np.sum, cells)) > MOST_COPIES * len(rest) or any(c.sum() > SHRINK * len(rest) for c in cells):
                self.exhaust(idx)
            else:
                todo += [(idx[c], int(rng.integers(1 << 40))) for c in cells]


def voronoi(d: np.ndarray) -> list[np.ndarray]:
    """Members of each pivot's cell, and of the outer cell, from distances (pivots by documents); a mask for each cell."""
    nearest, least = d.argmin(axis=0), d.min(axis=0)
    slack = 1e-9
    cells = []
    for k in range(len(d)):
        home = (nearest == k) & (least < OUTER)
        if home.any():
            cells.append(home | ((least < OUTER) & (d[k] <= least + 2 * RADIUS + slack) & (d[k] < OUTER + RADIUS + slack) & (d[k] <= d[k][home].max() + RADIUS + slack)))
    outer = least >= OUTER
    if outer.any():
        cells.append(outer | (least >= OUTER - RADIUS - slack))
    return [c for c in cells if c.sum() > 1]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), F.col("text").cast("binary").alias("raw")
    )


def _scan(texts: DataFrame) -> DataFrame:
    """One pass over the texts. kind 0: a = doc_id, b = set size, c = class, row, e = sketch. kind 1: a = common shingle, b = documents."""

    def run(batches):
        lean_memory()
        for batch in (part for whole in batches for part in slices(whole)):
            sets = shingle_sets(batch["raw"].to_pylist())
            names = [set_class(s) for s in sets]
            seen, once, e = set(), [], []
            for k, s in zip(names, sets, strict=True):
                e.append(sketch(s) if k not in seen else None)
                if k not in seen:
                    seen.add(k)
                    once.append(s)
            yield pa.RecordBatch.from_pydict(
                {
                    "kind": pa.array([0] * len(sets), pa.int8()), "a": batch["doc_id"], "b": pa.array([len(s) for s in sets], pa.int64()),
                    "c": pa.array(names, pa.int64()), "row": batch["row"], "e": pa.array(e, pa.binary()),
                }
            )
            token, n = np.unique(np.concatenate(once), return_counts=True)
            token, n = token[n >= COMMON_BATCH], n[n >= COMMON_BATCH]
            zero = np.zeros(len(n), np.int64)
            yield pa.RecordBatch.from_pydict({"kind": pa.array(zero + 1, pa.int8()), "a": token.view(np.int64), "b": n.astype(np.int64), "c": zero, "row": zero, "e": pa.nulls(len(n), pa.binary())})

    return texts.mapInArrow(run, "kind tinyint, a long, b long, c long, row long, e binary")


def _seeds(texts: DataFrame, common: list[int], buckets: int) -> DataFrame:
    """(bucket, packed): each batch's window of shingles, dealt by shingle; packed holds shingles, then classes.

    A common shingle's classes are dealt by shingle and class, to buckets from `buckets` on, so that no task gets them all.
    """
    last = np.sort(np.array(common, np.int64).view(np.uint64))

    def run(batches):
        lean_memory()
        for batch in (part for whole in batches for part in slices(whole)):
            seen, tokens, owners, hots = set(), [], [], []
            for i, s in zip(batch["doc_id"].to_pylist(), shingle_sets(batch["raw"].to_pylist()), strict=True):
                if not len(s) or i is None:
                    continue
                k = set_class(s)
                if k in seen:
                    continue
                seen.add(k)
                p = len(s) * (100 - PERCENT) // 100 + 1
                hot = np.zeros(len(s), bool)
                if len(last):
                    hot = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                    if hot[:p].any():
                        s, hot = np.concatenate([s[~hot], s[hot]]), np.sort(hot)
                tokens.append(s[:p])
                hots.append(hot[:p])
                owners.append(np.full(p, k, np.int64))
            if not tokens:
                continue
            token, owner, hot = np.concatenate(tokens), np.concatenate(owners), np.concatenate(hots)
            dealt = np.where(hot, mixed(token + mixed(owner.view(np.uint64))), mixed(token))
            bucket = (dealt % np.uint64(buckets)).astype(np.int32) + np.where(hot, buckets, 0).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, token, owner = bucket[order], token[order], owner[order]
            edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            short = token.view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]
            blobs = [short[x:y].tobytes() + owner[x:y].tobytes() for x, y in zip(edge, [*edge[1:], len(bucket)], strict=True)]
            yield pa.RecordBatch.from_pydict({"bucket": bucket[edge], "packed": pa.array(blobs, pa.binary())})

    return texts.mapInArrow(run, "bucket int, packed binary")


def _regions(buckets: int):
    """One bucket: the classes of each shingle that two or more have, and a hash of that list; or of a common shingle, those dealt to this bucket."""

    def run(table: pa.Table) -> pa.Table:
        parts = table["packed"].to_pylist()
        bucket = table["bucket"][0].as_py()
        count = [len(x) // (TOKEN_BYTES + 8) for x in parts]
        raw = np.zeros((sum(count), 8), np.uint8)
        raw[:, :TOKEN_BYTES] = np.frombuffer(b"".join(x[: TOKEN_BYTES * n] for x, n in zip(parts, count, strict=True)), np.uint8).reshape(-1, TOKEN_BYTES)
        token = raw.view(np.uint64).ravel()
        doc = np.concatenate([np.frombuffer(x, np.int64, offset=TOKEN_BYTES * n) for x, n in zip(parts, count, strict=True)])
        order = np.lexsort((doc, token))
        token, doc = token[order], doc[order]
        again = np.zeros(len(token), bool)
        again[1:] = (token[1:] == token[:-1]) & (doc[1:] == doc[:-1])  # the same class from two batches
        token, doc = token[~again], doc[~again]
        edge = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, int)
        size = np.diff([*edge, len(token)])
        if bucket >= buckets:
            begin, length, region = edge, size, token[edge]
        else:
            region = np.add.reduceat(mixed(doc.view(np.uint64) + np.uint64(1)), edge) if len(edge) else token
            keep = size >= 2
            _, first = np.unique(region[keep], return_index=True)
            begin, length, region = edge[keep][first], size[keep][first], region[keep][first]
        offsets = np.append(0, np.cumsum(length)).astype(np.int32)
        at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], length) + np.repeat(begin, length)
        part = np.full(len(region), bucket if bucket >= buckets else 0, np.int32)
        return pa.table({"region": region.view(np.int64), "part": part, "docs": pa.ListArray.from_arrays(pa.array(offsets), pa.array(doc[at], pa.int64()))})

    return run


def _of_size(rows: DataFrame) -> DataFrame:
    """The rows that have another one of their region in reach by size. rows: region, doc, n."""

    def run(batches):
        for table, _ in key_runs(batches, ["region"]):
            region, n = (table[c].to_numpy(zero_copy_only=False) for c in ("region", "n"))
            near = (region[1:] == region[:-1]) & (100 * n[:-1] >= PERCENT * n[1:])  # sorted by size: the next one is the nearest
            yield from table.filter(pa.array(np.append(near, False) | np.append(False, near))).to_batches()

    return rows.select("region", "doc", "n").repartition("region").sortWithinPartitions("region", "n").mapInArrow(run, "region long, doc long, n long")


def _with_sizes(rows: DataFrame, state: Classes, total: int) -> DataFrame:
    """The staged rows with m, the rows of their region; staged."""
    sizes = state.stage(rows.groupBy("region").agg(F.count(F.lit(1)).alias("m")).withColumn("w", F.col("m")), "jaccard-sizes")
    return state.stage(attach_skewed(rows, sizes, ["region"], "w", total, "inner"), "jaccard-sized")


def _near(rows: DataFrame, sketches: DataFrame, state: Classes) -> DataFrame:
    """The rows whose sizes and sketches leave a link open to another one of the region. rows: region, doc, n, component, homes, m; staged."""

    def run(batches):
        lean_memory()
        for table, edge in key_runs(batches, ["region"]):
            n, comp, *homes = (table[c].to_numpy(zero_copy_only=False) for c in ("n", "component", *_HOMES))
            keep = np.zeros(len(n), bool)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if b - a > 1:
                    own = table["e"][a:b].to_pylist()
                    if b - a == 2:
                        if comp[a] != comp[a + 1] and all(h[a] != h[a + 1] for h in homes):
                            keep[a:b] = may_link(own[0], own[1], int(n[a]), int(n[a + 1]))
                        continue
                    side = Sketches(own, n[a:b])
                    for i in range(b - a):
                        if not keep[a + i]:
                            wanted = comp[a:b] != comp[a + i]
                            for h in homes:
                                wanted &= h[a:b] != h[a + i]
                            found = side.may_link(own[i], int(n[a + i]), wanted)
                            if found.any():
                                keep[a + i] = True
                                keep[a:b] |= found
            yield from table.select(_ROW).filter(pa.array(keep)).to_batches()

    small = rows.where(F.col("m") <= SKETCHED)
    dealt = small.join(_only(sketches, small, state), "doc").select(*_ROW, "e").repartition("region").sortWithinPartitions("region")
    schema = ", ".join(f"{c} long" for c in _ROW)
    return dealt.mapInArrow(run, schema).unionByName(rows.where(F.col("m") > SKETCHED).select(*_ROW))


def _sets(texts: DataFrame, wanted: DataFrame, own: DataFrame) -> DataFrame:
    """(doc, set) of the wanted classes, one row each, staged; a set is 8 bytes a shingle."""
    carriers = stage(own.join(wanted, "doc").select("least.doc_id", "least.row"), "jaccard-carriers")
    side = F.broadcast(carriers) if carriers.count() <= BROADCAST_IDS else carriers
    picked = texts.join(side, ["doc_id", "row"], "left_semi").select("raw")

    def run(batches):
        lean_memory()
        for batch in (part for whole in batches for part in slices(whole)):
            found = {}
            for s in shingle_sets(batch["raw"].to_pylist()):
                found[set_class(s)] = s.tobytes()
            yield pa.RecordBatch.from_pydict({"doc": pa.array(list(found), pa.int64()), "set": pa.array(list(found.values()), pa.binary())})

    return stage(picked.mapInArrow(run, "doc long, set binary").groupBy("doc").agg(F.first("set").alias("set")), "jaccard-sets")


def _only(side: DataFrame, rows: DataFrame, state: Classes) -> DataFrame:
    """The side's rows that a join by doc will need, filtered by a broadcast of ids where those are few."""
    ids = state.stage(rows.select("doc").distinct(), "jaccard-ids")
    return side.join(F.broadcast(ids), "doc", "left_semi") if ids.count() <= BROADCAST_IDS else side


def _more_sets(texts: DataFrame, wanted: DataFrame, own: DataFrame, sets: DataFrame | None, state: Classes) -> DataFrame | None:
    """The sets so far and those of wanted classes that aren't among them."""
    fresh = state.stage(wanted if sets is None else wanted.join(sets.select("doc"), "doc", "left_anti"), "jaccard-wanted")
    if not fresh.limit(1).count():
        return sets
    more = _sets(texts, fresh, own)
    release(texts.sparkSession)
    return more if sets is None else sets.unionByName(more)


def _unpacked(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


_LINKS = "a long, b long"
_HOMES = [f"h{k}" for k in range(PASSES)]
_ROW = ["region", "doc", "n", "component", *_HOMES]


def _in_tasks(rows: DataFrame) -> DataFrame:
    """Links (a, b) inside regions up to LARGE shingles. rows: region, doc, n, component, homes, set."""

    def run(batches):
        lean_memory()
        for table, edge in key_runs(batches, ["region"]):
            doc, n, comp, *homes = (table[c].to_numpy(zero_copy_only=False) for c in ("doc", "n", "component", *_HOMES))
            a_out, b_out = [], []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if b - a > 1 and (comp[a:b] != comp[a]).any():
                    own = Region(_unpacked(table["set"][a:b]), n[a:b], comp[a:b], tuple(h[a:b] for h in homes))
                    own.search(np.arange(b - a))
                    a_out += [int(doc[a + x]) for x, _ in own.joined]
                    b_out += [int(doc[a + y]) for _, y in own.joined]
            yield pa.RecordBatch.from_pydict({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return rows.select(*_ROW, "set").repartition("region").sortWithinPartitions("region").mapInArrow(run, _LINKS)


def _against(members: DataFrame, askers: DataFrame, cells: bool) -> DataFrame:
    """Each part of a region against its askers: links (kind 0: a, b) and, on demand, cells (kind 1: a = document, b = pivot or null for the outer cell).

    Both: region, part, doc, n, component, set.
    """
    columns = ["region", "part", "doc", "n", "component", "set"]
    both = askers.select(*columns, F.lit(0).alias("side")).unionByName(members.select(*columns, F.lit(1).alias("side")))

    def run(batches):
        lean_memory()
        for table, edge in key_runs(batches, ["region", "part"]):
            region, doc, n, comp, side = (table[c].to_numpy(zero_copy_only=False) for c in ("region", "doc", "n", "component", "side"))
            out = {"kind": [], "region": [], "a": [], "b": []}

            def put(kind, where, a, b):
                for c, v in zip(out, (np.full(len(a), kind), np.full(len(a), where), a, np.full(len(a), b)), strict=True):
                    out[c].append(v)

            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                own = Region(_unpacked(table["set"][a:b]), n[a:b], comp[a:b])
                pivots, idx = np.flatnonzero(side[a:b] == 0), np.flatnonzero(side[a:b] == 1)
                if not len(pivots) or not len(idx):
                    continue
                d = np.empty((len(pivots) if cells else 1, len(idx)))
                for k, (p, close, far) in enumerate(own.distances(pivots, idx)):
                    if cells:
                        d[k] = far
                    close = close & (comp[a + idx] != comp[a + p])
                    put(0, region[a], doc[a + idx[close]], doc[a + p])
                if cells:
                    nearest, least = d.argmin(axis=0), d.min(axis=0)
                    for k, p in enumerate(pivots.tolist()):
                        inner = (least < OUTER) & ((nearest == k) | ((d[k] <= least + 2 * RADIUS + 1e-9) & (d[k] < OUTER + RADIUS + 1e-9)))
                        inner &= ~np.isin(doc[a + idx], doc[a + pivots])
                        put(1, region[a], doc[a + idx[inner]], doc[a + p])
                    border = (least >= OUTER - RADIUS - 1e-9) & ~np.isin(doc[a + idx], doc[a + pivots])
                    put(2, region[a], doc[a + idx[border]], 0)
            done = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()}
            yield pa.RecordBatch.from_pydict({c: pa.array(v.astype(np.int64), pa.int64()) for c, v in done.items()})

    dealt = both.repartition("region", "part").sortWithinPartitions("region", "part", "side")
    return dealt.mapInArrow(run, "kind long, region long, a long, b long")


def _measured(rows: DataFrame) -> DataFrame:
    """(region, m, total): documents and shingles of each region."""
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))


def _unsettled(start: int = 0) -> dict:
    """Homes that no two documents have in common, from the pass `start` on."""
    return {h: F.xxhash64("doc", F.lit(k)) for k, h in enumerate(_HOMES) if k >= start}


class Classes:
    """Components of classes so far: rows (node, component), staged; classes without links aren't listed."""

    def __init__(self):
        self.known: DataFrame | None = None
        self.tables: list[DataFrame] = []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """A staged table that goes at the end of a pass."""
        self.tables.append(stage(df, name))
        return self.tables[-1]

    def sweep(self, *keep: DataFrame) -> None:
        """Delete the pass's tables but for those, and let shuffle files go."""
        for t in self.tables:
            if not any(t is k for k in keep):
                unstage(t)
        spark = self.tables[0].sparkSession if self.tables else None
        self.tables = [t for t in self.tables if any(t is k for k in keep)]
        if spark:
            release(spark)

    def add(self, links: DataFrame) -> None:
        links = stage(links, "jaccard-links")
        if links.limit(1).count():
            self.known = _join_classes(links, self.known)
        unstage(links)

    def beside(self, rows: DataFrame) -> DataFrame:
        rows = rows.drop("component")
        if self.known is None:
            return rows.withColumn("component", F.col("doc"))
        return rows.join(self.known, rows["doc"] == self.known["node"], "left").select(*rows.columns, F.coalesce("component", "doc").alias("component"))

    def still_open(self, rows: DataFrame, total: int) -> DataFrame:
        """The rows, with components, of regions that hold several."""
        rows = self.stage(self.beside(rows), "jaccard-beside")
        several = rows.groupBy("region").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("m"))
        several = self.stage(several.where("c0 <> c1").select("region", "m"), "jaccard-several")
        return self.stage(attach_skewed(rows, several, ["region"], "m", total, "inner"), "jaccard-open")


def _link_regions(rows: DataFrame, sets: DataFrame, classes: Classes, total: int) -> None:
    """All links inside the regions go to `classes`. rows: region, doc, n, component, homes; staged."""
    size = classes.stage(_measured(rows).where("m > 1").withColumn("large", F.col("total") > LARGE), "jaccard-sizes")
    rows = classes.stage(attach_skewed(rows, size.select("region", "large", "m", "total", F.col("m").alias("w")), ["region"], "w", total, "inner"), "jaccard-sized")
    classes.add(_in_tasks(rows.where("not large").join(sets, "doc")))
    large, seed = rows.where("large").select("region", "doc", "n", "m", "total"), 0
    while large.limit(1).count():
        seed += 1
        now = classes.stage(classes.beside(large).join(sets, "doc"), "jaccard-large")
        # pivots by a hash that every round draws anew, one at least
        draw = F.pmod(F.xxhash64("doc", F.lit(seed)), F.lit(1 << 30))
        one = now.groupBy("region").agg(F.min(F.struct(draw, "doc")).alias("f")).select("region", F.col("f.doc").alias("f"))
        split = now.join(F.broadcast(one) if one.count() <= BROADCAST_IDS else one, "region").withColumn("parts", F.ceil(F.col("total") / LARGE).cast("int"))
        split = split.withColumn("part", F.pmod(F.xxhash64("doc", F.lit(-1)), F.col("parts")).cast("int"))
        pivots = split.where((F.col("doc") == F.col("f")) | (draw / float(1 << 30) * F.col("m") < PIVOTS))
        found = classes.stage(_against(split, pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), True), "jaccard-cells")
        classes.add(found.where("kind = 0").select("a", "b").distinct())
        # the cells of a region, or the region itself where they aren't smaller
        cells = found.where("kind > 0").select("region", F.xxhash64("region", "kind", "b", F.lit(seed)).alias("cell"), F.col("a").alias("doc"))
        fate = cells.groupBy("region", "cell").agg(F.count(F.lit(1)).alias("k")).groupBy("region").agg(F.sum("k").alias("all"), F.max("k").alias("most"))
        split = now.join(fate, "region").withColumn("stuck", (F.col("all") > MOST_COPIES * F.col("m")) | (F.col("most") > SHRINK * F.col("m")))
        split = classes.stage(split.select("region", "doc", "n", "total", "set", "stuck"), "jaccard-fate")
        _exhaust(split.where("stuck"), classes)
        cells = cells.join(split.where("not stuck").select("region", "doc", "n"), ["region", "doc"]).select(F.col("cell").alias("region"), "doc", "n")
        cells = classes.still_open(cells, MOST_COPIES * total)
        size = classes.stage(_measured(cells).withColumn("w", F.col("m")), "jaccard-sizes")
        cells = classes.stage(attach_skewed(cells, size, ["region"], "w", MOST_COPIES * total, "inner"), "jaccard-cells")
        small = cells.where(F.col("total") <= LARGE).withColumns(_unsettled())
        classes.add(_in_tasks(small.join(sets, "doc")))
        large = classes.stage(cells.where(F.col("total") > LARGE).select("region", "doc", "n", "m", "total"), "jaccard-large")


def _exhaust(rows: DataFrame, classes: Classes) -> None:
    """Every document outside its region's largest component against all others, part by part. rows: region, doc, n, total, set; staged."""
    if not rows.limit(1).count():
        return
    rows = classes.stage(classes.beside(rows), "jaccard-stuck")
    top = rows.groupBy("region", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("region").agg(F.max(F.struct("k", "component")).alias("t"))
    rows = rows.join(top.select("region", F.col("t.component").alias("top")), "region")
    parts = F.ceil(F.col("total") / LARGE).cast("int")
    minors = rows.where("component <> top")
    few = minors.groupBy("region").agg(F.ceil(F.sum("n") / LARGE).cast("int").alias("chunks"))
    name = lambda p, c: F.struct(p.cast("int"), c.cast("int"))
    members = rows.join(few, "region").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    members = members.withColumn("part", name(F.pmod(F.xxhash64("doc", F.lit(-1)), parts), F.col("chunk")))
    askers = minors.join(few, "region").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    askers = askers.withColumn("part", name(F.col("part"), F.pmod(F.xxhash64("doc", F.lit(-2)), F.col("chunks"))))
    number = lambda df: df.withColumn("part", F.xxhash64("part"))
    found = _against(number(members), number(askers), False)
    classes.add(found.where("kind = 0").select("a", "b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge: the smallest node that it reaches. edges: a, b."""
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "cc-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        new = labels.join(near, F.col("node") == F.col("a")).select("node", "component", F.least("component", "m").alias("c1"))
        jump = labels.select(F.col("node").alias("c1"), F.col("component").alias("c2"))
        new = stage(new.join(jump, "c1").select("node", F.col("component").alias("old"), F.least("c1", "c2").alias("component")), "cc-labels")
        changed = new.where("old <> component").limit(1).count()
        unstage(labels)
        labels = new.select("node", "component")
        if not changed:
            unstage(both)
            return labels


def _join_classes(links: DataFrame, known: DataFrame | None) -> DataFrame:
    """Components after more links (a, b) between documents: node, component."""
    if known is None:
        return components(links)
    name = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    across = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    across = stage(across.distinct(), "cc-across")
    if not across.limit(1).count():
        return known
    merged = components(across).withColumnRenamed("component", "top")
    every = known.unionByName(across.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known, "node", "left_anti").select("node", F.col("node").alias("component")))
    return stage(every.join(merged, every["component"] == merged["node"], "left").select(every["node"], F.coalesce("top", "component").alias("component")), "cc-classes")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, answers): nodes has doc_id, row, n_shingles and class c, one row a document; answers has c, component_id
    (the smallest doc_id of all classes linked with c), part (a number of that component) and w (its rows), for classes of several rows or with links."""
    texts = _texts(docs)
    scan = stage(_scan(texts), "jaccard-scan")
    nodes = scan.where("kind = 0").select(F.col("a").alias("doc_id"), "row", F.col("b").alias("n_shingles"), "c", "e")
    named = nodes.where("n_shingles > 0 and doc_id is not null")
    # classes; the sketch stands beside a batch's first row of a class
    first = F.min(F.struct("doc_id", "row")).alias("least")
    own = stage(named.groupBy(F.col("c").alias("doc")).agg(F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"), first), "jaccard-own")
    sketches = stage(scan.where("kind = 0 and e is not null").groupBy(F.col("c").alias("doc")).agg(F.first("e").alias("e")), "jaccard-sketches")
    found = scan.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).where(F.col("n") >= COMMON_TOTAL)
    common = [r["a"] for r in found.orderBy(F.desc("n"), "a").limit(COMMON_KEPT).collect()]
    size = texts.agg(F.sum(F.octet_length("raw")), F.count(F.lit(1))).first()
    buckets = int(max(MIN_BUCKETS, (size[0] or 0) // BUCKET_BYTES))
    lists = _seeds(texts, common, buckets).groupBy("bucket").applyInArrow(_regions(buckets), "region long, part int, docs array<long>")
    lists = lists.groupBy("region", "part").agg(F.first("docs").alias("docs"))
    members = stage(lists.select("region", F.explode("docs").alias("doc")), "jaccard-lists")
    release(docs.sparkSession)
    total = members.count()
    # regions that hold the same documents are one
    counted = members.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.min("doc").alias("p"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("same"))
    counted = stage(counted.where("m > 1").groupBy("m", "p", "same").agg(F.min("region").alias("region")).select("region", "m", F.col("m").alias("w")), "jaccard-counted")
    state = Classes()
    if counted.limit(1).count():
        rows = attach_skewed(members, counted, ["region"], "w", total, "inner")
        rows = state.stage(rows.join(own.select("doc", "n"), "doc").select("region", "doc", "n", "m"), "jaccard-members")
        unstage(members)
        small = _of_size(rows.where(F.col("m") <= SKETCHED))
        rows = state.stage(small.unionByName(rows.where(F.col("m") > SKETCHED).select("region", "doc", "n")).withColumns(_unsettled()), "jaccard-members")
        state.sweep(rows)
        sets: DataFrame | None = None
        for k in range(PASSES + 1):
            rows = _with_sizes(state.still_open(rows, total), state, total)
            if not rows.limit(1).count():
                break
            if k:  # what may still be linked, in any region
                rows = _with_sizes(state.stage(_near(rows, sketches, state), "jaccard-near"), state, total)
                release(docs.sparkSession)
            now = base = rows
            if k < PASSES:  # each document in its largest region that wasn't its home before
                fresh = F.lit(True)
                for h in _HOMES[:k]:
                    fresh &= F.col("region") != F.col(h)
                home = rows.where(fresh).groupBy("doc").agg(F.max(F.struct("m", "region")).alias("h")).select("doc", F.col("h.region").alias("home"))
                rows = base = state.stage(rows.join(home, "doc", "left").withColumn(_HOMES[k], F.coalesce("home", _HOMES[k])), "jaccard-home")
                now = rows.where("region = home").withColumns(_unsettled(k))
            now = state.stage(now.select(*_ROW) if k else _near(now, sketches, state), "jaccard-now")
            sets = _more_sets(texts, now.select("doc").distinct(), own, sets, state)
            if sets is not None:
                _link_regions(now, sets, state, total)
            state.sweep(base)
            rows = rows.select("region", "doc", "n", *_HOMES)
        state.sweep()
    if state.known is None:
        answers = own.where("copies > 1").select(F.col("doc").alias("c"), F.col("least.doc_id").alias("component_id"), F.col("doc").alias("part"), F.col("copies").alias("w"))
    else:
        joined = own.join(state.known, own["doc"] == state.known["node"], "left").select("doc", "copies", F.col("least.doc_id").alias("least"), F.coalesce("component", "doc").alias("part"), F.col("component").isNotNull().alias("tied"))
        joined = stage(joined.where("tied or copies > 1"), "jaccard-answers")
        part = joined.where("tied").groupBy("part").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("w"))
        tied = attach_skewed(joined.where("tied"), stage(part, "jaccard-parts"), ["part"], "w", total, "inner")
        alone = joined.where("not tied").withColumn("component_id", F.col("least"))
        answers = tied.unionByName(alone.select(*tied.columns)).select(F.col("doc").alias("c"), "component_id", "part", F.col("copies").alias("w"))
    return nodes.select("doc_id", "row", "n_shingles", "c"), stage(answers, "jaccard-classes")


def _components(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles, component_id, part (a number of the component, null for documents alone)."""
    nodes, answers = classes(docs)
    takes_part = F.col("n_shingles").cast("boolean") & F.col("doc_id").isNotNull()
    joined = attach_skewed(nodes.where(takes_part), answers, ["c"], "w", nodes.count(), "left")
    joined = joined.select("doc_id", "row", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("part", "c").alias("part"))
    rest = nodes.where(~F.coalesce(takes_part, F.lit(False))).select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("part"))
    return joined.unionByName(rest)


def jaccard_join(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id."""
    return _components(docs).select("doc_id", "n_shingles", "component_id")


def op4_jaccard(spark, sf_dir) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))


def near_duplicates_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one whose doc_id names the component; a row that repeats stays once.

    Of several texts with that doc_id in one group, the one of the smallest row hash stays; a doc_id whose texts are in
    different groups stays in each. Documents without words stay, repeated rows once; null doc_ids all stay.
    """
    found = _components(docs).where(F.col("doc_id").isNotNull() & (F.col("doc_id") == F.col("component_id")))
    grouped = found.where("part is not null").groupBy("part").agg(F.min(F.struct("doc_id", "row")).alias("r")).select("r.doc_id", "r.row")
    keep = grouped.unionByName(found.where("part is null").select("doc_id", "row")).distinct()
    names = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(*names, F.col("doc_id").cast("long").alias("__id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("__row"))
    keep = keep.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"))
    once = marked.where(F.col("doc_id").isNotNull()).join(keep, ["__id", "__row"], "left_semi").dropDuplicates(["__id", "__row"]).select(*names)
    return once.unionByName(docs.where(F.col("doc_id").isNull()))
