"""Byte formats against the standard library, and texts that a decoder refuses."""

import base64
import time

import pytest
from pyspark.sql import functions as F

from sedgeline.functions import formats

BYTES = [b"", b"f", b"fo", b"foo", b"foob", b"fooba", b"foobar", bytes(range(256)), b"\x00" * 7, b"\xff" * 11, None]


@pytest.mark.parametrize(("alphabet", "encode"), [(formats.BASE32, base64.b32encode), (formats.BASE32HEX, base64.b32hexencode)])
def test_base32_round_trip(spark, alphabet, encode):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(BYTES)], "i int, b binary").withColumn("t", formats.to_base32(F.col("b"), alphabet))
    rows = df.withColumn("back", formats.from_base32(F.col("t"), alphabet)).orderBy("i").collect()
    for b, r in zip(BYTES, rows, strict=True):
        assert r["t"] == (None if b is None else encode(b).decode())
        assert (None if r["back"] is None else bytes(r["back"])) == b


def test_base32_refuses(spark):
    bad = ["A", "MY", "my======", "MY=====", "M1======", "MZXW6===\n", "MZX=====", "========", "MZXW6YTB="]
    rows = spark.createDataFrame([(t,) for t in bad], "t string").select(formats.from_base32(F.col("t")).alias("b")).collect()
    assert [r["b"] for r in rows] == [None] * len(bad)


def test_base32_reads_its_input_a_few_times(spark):
    df = spark.createDataFrame([(b"foob",)], "given binary").select(formats.from_base32(formats.to_base32(F.col("given"))).alias("back"))
    assert df._jdf.queryExecution().analyzed().toString().count("given#") < 20  # 265 when each digit looked it up
    assert bytes(df.first()["back"]) == b"foob"


def test_base32_of_long_values(spark):
    b = bytes(range(251)) * 400
    start = time.monotonic()
    r = spark.createDataFrame([(b,)], "b binary").select(formats.to_base32(F.col("b")).alias("t")).select("t", formats.from_base32(F.col("t")).alias("back")).first()
    assert (r["t"], bytes(r["back"])) == (base64.b32encode(b).decode(), b)
    assert time.monotonic() - start < 10  # linear in their length


def test_number_array(spark):
    given = [[], [0, 10, 255], [256], [-1], [1, None], None]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(given)], "i int, a array<int>").select("i", formats.from_number_array(F.col("a")).alias("b")).orderBy("i").collect()
    assert [None if r["b"] is None else bytes(r["b"]) for r in rows] == [b"", b"\x00\x0a\xff", None, None, None, None]
