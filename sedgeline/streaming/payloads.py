"""Streams of JSON lines: stateless decoding and step lists, split into valid rows and dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_lines(spark: SparkSession, path: str, column: str = "payload", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).where(~F.rlike("value", F.lit(r"\A\s*\z"))).withColumnRenamed("value", column)


def write_split(decoded: DataFrame, valid_path: str, dead_path: str, checkpoint: str, valid: Callable[[DataFrame], DataFrame] | None = None, **trigger) -> StreamingQuery:
    """Each micro-batch once: its valid rows to one Parquet folder, the others with their errors to another."""

    def sink(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        good = batch.where("valid").drop("errors", "valid")
        (valid(good) if valid else good).write.mode("overwrite").parquet(f"{valid_path}/batch={epoch}")
        batch.where("not valid").write.mode("overwrite").parquet(f"{dead_path}/batch={epoch}")
        batch.unpersist()

    return decoded.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
