"""Shared helpers of the training-data operators: staged tables, input checks, keyed attachment."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators' word definition has it: space, tab, LF, VT, FF, CR.
SPACE_CLASS = "\\x20\\x09-\\x0D"
WORD_CLASS = f"[^{SPACE_CLASS}]+"

#: A keyed side is broadcast only when it was counted and holds at most this many rows.
BROADCAST_ROWS = 20_000
#: Copies of each row of a keyed side that is too large to broadcast.
SALT = 32


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for staged tables; one of this machine only where the setting is absent and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "sedgeline-stage")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a fresh table in the shared folder and read it back: lineage ends, a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the cluster delete the shuffle files of tables that are staged by now: it does so as the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def attach(df: DataFrame, side: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Left-join a table with one row for each key (nulls match nulls).

    A counted side of up to BROADCAST_ROWS rows is broadcast. A larger one is replicated SALT times and joined on
    (key, salt), so that no key, however hot, meets in one task.
    """
    rows = side.count() if rows is None else rows
    side = side.select([F.col(c).alias(f"__k_{c}") if c in keys else F.col(c) for c in side.columns])
    on = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in keys]
    if rows <= BROADCAST_ROWS:
        side = F.broadcast(side)
        drop = []
    else:
        df = df.withColumn("__salt", (F.rand(7) * SALT).cast("int"))
        side = side.withColumn("__kk_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        on = [F.col("__salt") == F.col("__kk_salt"), *on]
        drop = ["__salt", "__kk_salt"]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.join(side, cond, "left").drop(*[f"__k_{c}" for c in keys], *drop)


def attach_skewed(df: DataFrame, side: DataFrame, keys: list[str], weight: str, total: int, how: str = "left") -> DataFrame:
    """Join a staged table that has one row for each key; its column `weight` bounds or estimates a key's rows in `df`.

    Keys with a ten-thousandth of all rows or more are broadcast (there are 10,000 of them at most, as weights add up to
    `total`); the others are joined by a shuffle. The weight itself isn't kept.
    """
    least = max(1000, total // 10_000)
    hot, cold = side.where(F.col(weight) >= least).drop(weight), side.where(F.coalesce(F.col(weight) < least, F.lit(True))).drop(weight)
    if not hot.limit(1).count():
        return df.join(cold, keys, how)
    heavy = df.join(F.broadcast(hot), keys, "inner")
    return heavy.unionByName(df.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold, keys, how))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of text that vectorised code works on at a time.
SLICE_BYTES = 8_000_000


def slices(batch: pa.RecordBatch, column: str = "raw") -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE_BYTES of a binary column, one row at least."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch[column]).to_pylist()):
        if size and size + (n or 0) > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if batch.num_rows > start:
        yield batch.slice(start)


def lean_memory() -> None:
    """In a Python worker: freed arrays go back to the system at once, instead of staying in the allocator."""
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD, which else grows with what is freed
    except (OSError, AttributeError):
        return
    pa.set_memory_pool(pa.system_memory_pool())


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from sorted batches, and the groups' edges in each; a group is never cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = batch[k].to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
            new[0] |= bool(held) and held[-1][k][held[-1].num_rows - 1].as_py() != x[0]
        cut = np.flatnonzero(new)
        if len(cut):
            whole = [*held, batch.slice(0, cut[-1])]
            table = pa.Table.from_batches([x for x in whole if x.num_rows])
            if table.num_rows:
                yield table.combine_chunks(), _edges(table, keys)
            held = [batch.slice(cut[-1])]
        else:
            held.append(batch)
    if held:
        table = pa.Table.from_batches(held)
        yield table.combine_chunks(), _edges(table, keys)


def _edges(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.ones(table.num_rows + 1, bool)
    new[1:-1] = False
    for k in keys:
        x = table[k].to_numpy()
        new[1:-1] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def map_texts(
    docs: DataFrame, columns: dict[str, str], schema: str, make: Callable[[], Callable[[dict], Iterator[dict] | list[dict]]]
) -> DataFrame:
    """Apply a function over Arrow batches of the named columns.

    columns: name inside the function -> column or SQL expression of `docs`. `make` runs once in each task and returns
    the function of one batch (dict of lists in, list of dicts of lists out).
    """
    picked = docs.select([F.expr(e).alias(n) for n, e in columns.items()])
    target = pa_schema(picked, schema)

    def run(batches):
        f = make()
        for b in batches:
            for out in f(b.to_pydict()):
                yield pa.RecordBatch.from_pydict(out, schema=target)

    return picked.mapInArrow(run, schema)


def pa_schema(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(ddl)
    assert isinstance(kind, StructType)
    return to_arrow_schema(kind)
