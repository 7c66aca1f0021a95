"""Approximate nearest neighbours over learned partitions.

A bounded sample gives an exact neighbour graph, which is cut into balanced parts; a softmax classifier learns the parts
of a vector's neighbours. The classifier gives every row its part and routes a query to its most probable parts, as many
as a held-back part of the sample needs for TARGET_RECALL. Parts are read in blocks of bounded size, so a part that holds
a third of all rows is many blocks; queries meet blocks, and the best of all blocks are ranked again by the exact inner
product in double precision.

Defined results: vectors that are null, zero, of another length than the commonest, or hold null or non-finite
components take no part; ties go to the smaller vec_id; a row that repeats is a candidate each time, but a query's own
vec_id is none; a vec_id whose row repeats is asked once (with its smallest vector, should they differ); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

K = 20
QUERY_MODULUS = 20
SAMPLE_ROWS = 6000
HELD_BACK = 600
GRAPH_K = 10
#: Rows for which there is one part, and the least and most parts.
ROWS_PER_PART, MIN_PARTS, MAX_PARTS = 6000, 8, 256
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
TARGET_RECALL = 0.96
SLACK = 0.25


def _blocks_topk(scores: np.ndarray, k: int) -> np.ndarray:
    k = min(k, scores.shape[1])
    return np.argpartition(-scores, k - 1, axis=1)[:, :k] if k else np.zeros((len(scores), 0), int)


def neighbour_graph(x: np.ndarray, k: int = GRAPH_K) -> np.ndarray:
    out = np.zeros((len(x), min(k, max(0, len(x) - 1))), int)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 1024] = _blocks_topk(s, out.shape[1])
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Cut the graph: balanced median splits along random directions, then moves that save edges while parts have room."""
    rng = np.random.default_rng(seed)
    part = np.zeros(len(x), int)

    def split(ids: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            part[ids] = first
            return
        own = x[ids] - x[ids].mean(axis=0)
        v = rng.normal(size=x.shape[1])
        for _ in range(8):  # towards the widest direction
            v = own.T @ (own @ v)
            v /= np.linalg.norm(v) or 1.0
        order = ids[np.argsort(own @ v, kind="stable")]
        at = len(ids) * (n // 2) // n
        split(order[:at], first, n // 2)
        split(order[at:], first + n // 2, n - n // 2)

    split(np.arange(len(x)), 0, parts)
    room = int(np.ceil(len(x) / parts * (1 + SLACK)))
    sizes = np.bincount(part, minlength=parts)
    near = [[] for _ in range(len(x))]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            near[i].append(j)
            near[j].append(i)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)):
            if not near[i]:
                continue
            votes = np.bincount(part[near[i]], minlength=parts)
            own = part[i]
            best = int(np.argmax(np.where(sizes < room, votes, -1)))
            if votes[best] > votes[own]:
                sizes[own] -= 1
                sizes[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


def train_classifier(x: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, epochs: int = 40, seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression onto the distribution of a vector's own and its neighbours' parts."""
    rng = np.random.default_rng(seed)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.arange(len(x)), part), graph.shape[1] + 1)
    for c in range(graph.shape[1]):
        np.add.at(goal, (np.arange(len(x)), part[graph[:, c]]), 1)
    goal /= goal.sum(axis=1, keepdims=True)
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    for e in range(epochs):
        order = rng.permutation(len(x))
        rate = 2.0 / (1 + 0.1 * e)
        for a in range(0, len(x), 256):
            i = order[a : a + 256]
            z = x[i] @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = (p - goal[i]) / len(i)
            mw, mb = 0.9 * mw + x[i].T @ d + 1e-5 * w, 0.9 * mb + d.sum(axis=0)
            w -= rate * mw
            b -= rate * mb
    return w, b


class Router:
    def __init__(self, sample: np.ndarray, parts: int):
        self.parts = parts if len(sample) > 2 * parts else 1
        self.scale = 1 / max(1e-12, float(np.median(np.linalg.norm(sample, axis=1))) if len(sample) else 1.0)
        dim = sample.shape[1]
        if self.parts == 1:
            self.w, self.b, self.probes = np.zeros((dim, 1)), np.zeros(1), 1
            return
        x = sample * self.scale
        back = min(HELD_BACK, len(x) // 5)
        fit, held = x[back:], x[:back]
        graph = neighbour_graph(fit)
        part = balanced_parts(fit, graph, self.parts)
        self.w, self.b = train_classifier(fit, part, graph, self.parts)
        # probes: the fewest parts that hold TARGET_RECALL of the held-back rows' neighbours
        own = self.logits(fit, False).argmax(axis=1)
        true = _blocks_topk(held @ fit.T, K)
        rank = np.argsort(np.argsort(-self.logits(held, False), axis=1), axis=1)
        need = np.take_along_axis(rank, own[true], axis=1).ravel()
        self.probes = int(np.quantile(need, TARGET_RECALL, method="higher")) + 1 if need.size else self.parts

    def logits(self, x: np.ndarray, scale: bool = True) -> np.ndarray:
        return (x * self.scale if scale else x) @ self.w + self.b

    def part(self, x: np.ndarray) -> np.ndarray:
        return self.logits(x).argmax(axis=1)

    def route(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, : self.probes]


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id and the vector in doubles, for rows that take part, all of the commonest length."""
    v = F.col(vec).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    keep = F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size(F.col(vec)) > 0)
    out = vectors.where(keep).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    top = out.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return out.where(F.size("v") == (top[0]["d"] if top else -1))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def _search(left: pa.Table, right: pa.Table) -> pa.Table:
    """One block of rows against one block of queries: each query's K best in it."""
    x, ids = _matrix(left["v"]), left["vec_id"].to_numpy()
    q, qids = _matrix(right["v"]), right["vec_id"].to_numpy()
    out_q, out_i, out_s = [], [], []
    if len(x) and len(q):
        for a in range(0, len(q), 256):
            s = q[a : a + 256] @ x.T
            for r, row in enumerate(s):
                row[ids == qids[a + r]] = -np.inf
                k = min(K, len(row))
                floor = np.partition(row, len(row) - k)[len(row) - k]
                near = np.flatnonzero(row >= floor - 1e-9 * (1 + abs(floor))) if np.isfinite(floor) else np.flatnonzero(np.isfinite(row))
                exact = (x[near] * q[a + r]).sum(axis=1)  # the same order of additions for every row
                best = np.lexsort((ids[near], -exact))[:K]
                out_q.append(np.full(len(best), qids[a + r]))
                out_i.append(ids[near][best])
                out_s.append(exact[best])
    join = lambda parts, t: pa.array(np.concatenate(parts) if parts else np.zeros(0), t)
    return pa.table({"query_id": join(out_q, pa.int64()), "vec_id": join(out_i, pa.int64()), "score": join(out_s, pa.float64())})


def search(vectors: DataFrame, vec: str = "embedding", modulus: int = QUERY_MODULUS) -> DataFrame:
    rows = usable(vectors, vec)
    total = rows.count()
    share = min(1.0, 0.97 * SAMPLE_ROWS / max(1, total))
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20))).limit(SAMPLE_ROWS).toArrow()
    order = np.argsort(sample["vec_id"].to_numpy(), kind="stable")
    x = _matrix(sample["v"])[order] if total else np.zeros((0, 1))
    x = x[np.random.default_rng(4).permutation(len(x))]
    router = Router(x, int(np.clip(-(-total // ROWS_PER_PART), MIN_PARTS, MAX_PARTS)))

    def assign(batches):
        for b in batches:
            if not b.num_rows:
                continue
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], pa.array(router.part(_matrix(b["v"])), pa.int32())], ["vec_id", "v", "part"])

    def route(batches):
        for b in batches:
            if not b.num_rows:
                continue
            parts = router.route(_matrix(b["v"]))
            n = parts.shape[1]
            again = pa.array(np.repeat(np.arange(b.num_rows), n))
            yield pa.RecordBatch.from_arrays([b["vec_id"].take(again), b["v"].take(again), pa.array(parts.ravel(), pa.int32())], ["vec_id", "v", "part"])

    indexed = stage(rows.mapInArrow(assign, "vec_id long, v array<double>, part int"), "ann-index")
    once = rows.where(F.col("vec_id") % modulus == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = once.mapInArrow(route, "vec_id long, v array<double>, part int")
    # blocks: at most MAX_PARTS counts
    n_rows = {r["part"]: r["n"] for r in indexed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_asked = {r["part"]: r["n"] for r in asked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = F.create_map(*[F.lit(x) for p, n in sorted(n_rows.items()) for x in (p, -(-n // BLOCK_ROWS))]) if n_rows else None
    groups = F.create_map(*[F.lit(x) for p, n in sorted(n_asked.items()) for x in (p, -(-n // BLOCK_QUERIES))]) if n_asked else None
    schema = "query_id long, vec_id long, score double"
    if blocks is None or groups is None:
        found = rows.sparkSession.createDataFrame([], schema)
    else:
        deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = indexed.withColumn("block", deal(blocks[F.col("part")], 1)).withColumn("b", blocks[F.col("part")])
        left = left.withColumn("g", F.coalesce(groups[F.col("part")], F.lit(0))).where("g > 0").withColumn("group", every(F.col("g")))
        right = asked.withColumn("group", deal(groups[F.col("part")], 2)).withColumn("b", F.coalesce(blocks[F.col("part")], F.lit(0))).where("b > 0").withColumn("block", every(F.col("b")))
        key = ["part", "block", "group"]
        found = left.select(*key, "vec_id", "v").groupBy(*key).cogroup(right.select(*key, "vec_id", "v").groupBy(*key)).applyInArrow(_search, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark, sf_dir) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
