import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgeline.functions import encode as E
from sedgeline.functions import formats, mods
from sedgeline.plans.compiler import Function, apply_pipes, error_text, split
from sedgeline.plans.grammar import StepError, parse
from sedgeline.sources.payload import decode, explode_array, until_first


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_grammar():
    p = parse("required trim oneof=a|b|'c d' inner:(notempty minlen=1) @even:'must be even'")
    assert [s.name for s in p.steps] == ["required", "trim", "oneof", "even"]
    assert p.steps[2].args == ("a", "b", "c d") and p.steps[3].message == "must be even"
    assert [s.name for s in p.inner.steps] == ["notempty", "minlen"]
    v = parse("nullzero / . / @Conv ~ gte=0")
    assert [x.name for x in v.variants] == ["nullzero", ".", "Conv"] and v.steps[0].name == "gte"
    for bad in ("inner:(a", "eq='x", ")", "@"):
        with pytest.raises(StepError):
            parse(bad)


def test_unsupported_variants(spark):
    df = spark.createDataFrame([(1,), (None,)], "n long")
    conv = {"ToInt": Function(lambda c: c.cast("int"), "mod", "string")}
    for text in (". / @NoSuchThing ~ minlen=1",):
        with pytest.raises(StepError, match="no function"):
            apply_pipes(df, {"n": text})
    with pytest.raises(StepError, match="needs a payload"):
        apply_pipes(df, {"n": ". / @ToInt"}, conv)
    for text in ("nullzero / . / @ToInt ~ gte=0", "@ToInt ~ gte=0", ". / other ~ gte=0"):
        with pytest.raises(StepError, match="input variant"):
            apply_pipes(df, {"n": text})
    with pytest.raises(StepError, match="input variant"):
        apply_pipes(df.select(F.array("n").alias("n")), {"n": "inner:(. / @ToInt ~ gte=0)"})
    assert [r["n"] for r in apply_pipes(df, {"n": "nullzero / . ~ gte=0"}).collect()] == [1, 0]


@pytest.mark.parametrize(
    ("rule", "good", "bad"),
    [
        ("len=2", "é", "ab1"), ("runes=2", "éé", "é"), ("notempty", "a", ""), ("alphanum", "a1", "a\n"), ("numeric", "09", ""), ("hexadecimal", "aF", "g"),
        ("islower", "", "A"), ("isupper", "A", "a"), ("url", "a://b", "://b"), ("url", "a://b", "a://"), ("starts=a", "ab", "ba"), ("ends=b", "ab", "ba"),
        ("contains=x", "axb", "ab"), ("eq=yes", "yes", "no"), ("neq=yes", "no", "yes"), ("oneof=a|'c d'", "c d", "c"), ("minlen=2", "é", "a"), ("maxrunes=1", "é", "ab"),
    ],
)
def test_text_rules(spark, rule, good, bad):
    rows = apply_pipes(column(spark, [good, bad, None]), {"v": rule}).select("valid").collect()
    assert [r[0] for r in rows] == [True, False, True]


@pytest.mark.parametrize(("rule", "good", "bad"), [("gt=1", 2, 1), ("gte=1", 1, 0), ("lt=1", 0, 1), ("lte=1", 1, 2), ("multiple=3", -6, 4), ("oneof=1|2", 2, 3), ("neq=4", 5, 4)])
def test_number_rules(spark, rule, good, bad):
    assert [r[0] for r in apply_pipes(column(spark, [good, bad], "long"), {"v": rule}).select("valid").collect()] == [True, False]


def test_mods(spark):
    got = lambda f, *v: [r[0] for r in column(spark, v).select(f(F.col("v"))).collect()]
    assert got(mods.trim, "\u00a0\t a \u0085", "\ufeffa") == ["a", "\ufeffa"]
    assert got(mods.lower, "İΟΔΟΣ") == ["iοδοσ"]
    assert got(mods.upper, "ßaǰ", "straße") == ["ßAǰ", "STRAßE"]
    assert got(lambda c: mods.trim_left(c, "SKU-"), "SKU-SKU-1", "x") == ["SKU-1", "x"]
    assert got(lambda c: mods.trim_right(c, "ab"), "xabab") == ["xab"]


def test_order_and_errors(spark):
    df = spark.createDataFrame([(" Ab ", 500.0), (None, -1.0)], "name string, score double")
    out = apply_pipes(df, {"name": "required trim tolower minlen=3", "score": "gte=0 clamp=0|100 lte=100"})
    rows = out.select("name", "score", error_text(F.col("errors")).alias("e")).collect()
    assert rows[0][:2] == ("ab", 100.0) and rows[0]["e"] == "name: length 2 below minimum 3"
    assert rows[1]["e"] == "score: value -1 below minimum 0; name: missing required field"
    first = apply_pipes(df, {"name": "required", "score": "gte=0"}, errors="first")
    assert [len(r[0]) for r in first.select("errors").collect()] == [0, 1]
    good, dead = split(first)
    assert good.count() == 1 and dead.count() == 1


def test_scopes_and_functions(spark):
    df = spark.createDataFrame([(["a", " "], {"K ": 5, "k": 200})], "tags array<string>, m map<string,int>")
    even = Function(lambda c: c % 2 == 0)
    out = apply_pipes(df, {"tags": "inner:(trim notempty)", "m": "keys:(trim tolower) inner:(lte=100 @even:'must be even')"}, {"even": even}).first()
    assert out["tags"] == ["a", ""] and out["m"] == {"k": 200}
    assert [(e["path"], e["rule"]) for e in out["errors"]] == [(["tags[]"], "notempty"), (["m", "k.value"], "lte")]


def test_schema_check(spark):
    with pytest.raises(StepError) as e:
        apply_pipes(spark.createDataFrame([(1, "a")], "n int, s string"), {"n": "len=2 multiple=0", "s": "lower gt=1 oneof=a|a", "x": "trim"})
    text = str(e.value)
    assert all(x in text for x in ("n: len doesn't fit integer", "multiple=0", "unknown step lower", "s: gt doesn't fit", "distinct", "x: no such column"))


def test_decode(spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType()))])
    docs = ['{"id":1,"tags":["a"]}', '{"id":1,"id":2}', '{"id":null}', "", '{"z":3}']
    df = spark.createDataFrame([(d,) for d in docs], "p string")
    rows = decode(df, "p", schema, unknown="ignore").select("id", "tags", F.transform("errors", lambda e: e["rule"]).alias("r")).collect()
    assert rows[0][:2] == (1, ["a"]) and "duplicate" in rows[1]["r"] and rows[2]["r"] == ["value"] and rows[3]["r"] == ["syntax"]
    assert rows[4][:2] == (0, []) and rows[4]["r"] == []
    first = decode(df, "p", schema, duplicates="first", unknown="collect").collect()
    assert first[1]["id"] == 1 and first[1]["valid"] and first[4]["unknown"] == {"z": "3"}
    assert decode(df, "p", schema, null_zero=True, unknown="ignore").collect()[2]["id"] == 0


def test_array_and_stop(spark):
    df = spark.createDataFrame([("[1,2]",), ("[3] x",)], "p string")
    assert [r["value"] for r in explode_array(df, "p", T.LongType()).collect()] == [1, 2]
    rows = spark.createDataFrame([(i, i == 2) for i in range(5)], "i int, bad boolean")
    assert sorted(r["i"] for r in until_first(rows, "i", F.col("bad")).collect()) == [0, 1, 2]


def test_formats(spark):
    got = lambda f, *v: [r[0] for r in column(spark, v).select(f(F.col("v")).alias("x")).collect()]
    assert got(formats.from_hex, "0a", "0", "zz") == [b"\n", None, None]
    assert got(formats.from_base64, "YQ==", "YQ", "Y-") == [b"a", None, None]
    assert got(formats.from_duration, "1h30m", "1.5s", "-2ms", "0", "5", "1x") == [5400 * 10**9, 1500000000, -2000000, 0, None, None]
    assert [x is None for x in got(formats.from_rfc3339, "2020-01-02T03:04:05Z", "2020-01-02T3:04:05Z", "2020-01-02")] == [False, True, True]
    assert got(lambda c: formats.to_rfc3339(c.cast("timestamp")), "2020-01-02 03:04:05.120", "2020-01-02 03:00:00") == ["2020-01-02T03:04:05.12Z", "2020-01-02T03:00:00Z"]
    assert got(lambda c: formats.to_base64(c.cast("binary")), "x" * 100)[0].count("\n") == 0


def test_encode(spark):
    df = spark.createDataFrame([("a<b", None, 1e21, 1e-7, 1.0, [], 0)], "s string, n int, f double, g double, h double, a array<int>, z int")
    out = {c: E.Out() for c in df.columns} | {"a": E.Out(omit_empty=True), "z": E.Out(omit_zero=True)}
    assert df.select(E.encode(df, out, html=True)).first()[0] == '{"f":1e+21,"g":1e-7,"h":1,"n":null,"s":"a\\u003cb"}'


def test_stream(spark, tmp_path):
    from sedgeline.streaming.payloads import read_lines, write_split

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id":1}\n\n{"id":"x"}\n')
    schema = T.StructType([T.StructField("id", T.LongType())])
    q = write_split(decode(read_lines(spark, str(tmp_path / "in")), "payload", schema), str(tmp_path / "ok"), str(tmp_path / "dead"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1 and spark.read.parquet(str(tmp_path / "dead")).count() == 1


def test_catalogue_matches_duckdb(spark):
    import duckdb

    from sedgeline.plans import catalogue

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("customer", "part", "orders", "nation", "events", "documents", "pages", "embeddings", "lineitem"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("pipe_first_error", "pipe_order", "payload_policies", "omit_rules", "scope_keys"):
        a, b = catalogue.QUERIES[name](spark, d), con.execute(catalogue.ORACLES[name])
        names = [c[0] for c in b.description]
        assert sorted(map(str, (tuple(r[c] for c in names) for r in a.collect()))) == sorted(map(str, b.fetchall())), name
