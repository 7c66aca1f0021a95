"""Queries over the driver's tables and the DuckDB SQL that they match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import encode as E
from ..functions import formats, mods, network
from ..functions.rules import INTEGER, NUMBER, RULES, STRING
from ..sources.payload import decode, is_json, shape, unknown_keys
from .compiler import Function, apply_pipes, error_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passes(step: str, c: Column, kind: str) -> Column:
    name, _, arg = step.partition("=")
    return RULES[name].test(c, kind, tuple(arg.split("|")) if arg else ())


@query("SELECT doc_id, strlen(text) > 0 AS notempty, strlen(text) = 1500 AS len_ok, strlen(text) >= 100 AS min_ok, strlen(text) <= 5000 AS max_ok FROM documents")
def val_len_bytes(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", passes("notempty", t, STRING).alias("notempty"), passes("len=1500", t, STRING).alias("len_ok"), passes("minlen=100", t, STRING).alias("min_ok"), passes("maxlen=5000", t, STRING).alias("max_ok"))


@query("SELECT doc_id, length(text) = 1500 AS runes_ok, length(text) >= 100 AS min_ok, length(text) <= 5000 AS max_ok FROM documents")
def val_runes(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", passes("runes=1500", t, STRING).alias("runes_ok"), passes("minrunes=100", t, STRING).alias("min_ok"), passes("maxrunes=5000", t, STRING).alias("max_ok"))


@query("SELECT doc_id, regexp_full_match(lang, '[A-Za-z0-9]+') AS ok FROM documents")
def val_alphanum(spark, d):
    return table(spark, d, "documents").select("doc_id", passes("alphanum", F.col("lang"), STRING).alias("ok"))


@query(r"SELECT doc_id, NOT regexp_matches(text, '\p{Lu}') AS ok FROM documents")
def val_islower(spark, d):
    return table(spark, d, "documents").select("doc_id", passes("islower", F.col("text"), STRING).alias("ok"))


@query(r"SELECT doc_id, NOT regexp_matches(text, '\p{Ll}') AS ok FROM documents")
def val_isupper(spark, d):
    return table(spark, d, "documents").select("doc_id", passes("isupper", F.col("text"), STRING).alias("ok"))


@query("SELECT page_id, strpos(url, '://') > 1 AND length(url) >= strpos(url, '://') + 3 AS ok FROM pages")
def val_url(spark, d):
    return table(spark, d, "pages").select("page_id", passes("url", F.col("url"), STRING).alias("ok"))


@query("SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') AS ok FROM customer")
def val_oneof(spark, d):
    return table(spark, d, "customer").select("c_custkey", passes("oneof=BUILDING|MACHINERY|FURNITURE", F.col("c_mktsegment"), STRING).alias("ok"))


@query("SELECT o_orderkey, o_custkey % 7 = 0 AS ok FROM orders")
def val_multiple(spark, d):
    return table(spark, d, "orders").select("o_orderkey", passes("multiple=7", F.col("o_custkey"), INTEGER).alias("ok"))


@query("SELECT l_orderkey, l_linenumber, l_discount > 0.02 AS gt_ok, l_discount >= 0.02 AS gte_ok, l_quantity < 40 AS lt_ok, l_quantity <= 40 AS lte_ok FROM lineitem")
def val_range(spark, d):
    a, b = F.col("l_discount"), F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", passes("gt=0.02", a, NUMBER).alias("gt_ok"), passes("gte=0.02", a, NUMBER).alias("gte_ok"), passes("lt=40", b, NUMBER).alias("lt_ok"), passes("lte=40", b, NUMBER).alias("lte_ok"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS eq_ok, l_returnflag <> 'N' AS neq_ok FROM lineitem")
def val_eq_neq(spark, d):
    c = F.col("l_returnflag")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", passes("eq=R", c, STRING).alias("eq_ok"), passes("neq=N", c, STRING).alias("neq_ok"))


@query("SELECT page_id, starts_with(url, 'https') AS starts_ok, ends_with(url, '1') AS ends_ok, contains(url, 'example') AS contains_ok FROM pages")
def val_affix(spark, d):
    c = F.col("url")
    return table(spark, d, "pages").select("page_id", passes("starts=https", c, STRING).alias("starts_ok"), passes("ends=1", c, STRING).alias("ends_ok"), passes("contains=example", c, STRING).alias("contains_ok"))


@query("SELECT c_custkey, regexp_full_match(substr(c_name, 10), '[0-9]+') AS numeric_ok, regexp_full_match(substr(c_mktsegment, 1, 3), '[0-9A-Fa-f]+') AS hex_ok FROM customer")
def val_numeric_hex(spark, d):
    return table(spark, d, "customer").select("c_custkey", passes("numeric", F.expr("substr(c_name, 10)"), STRING).alias("numeric_ok"), passes("hexadecimal", F.expr("substr(c_mktsegment, 1, 3)"), STRING).alias("hex_ok"))


_CLASS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@query(rf"SELECT doc_id, regexp_replace(text, '^[{_CLASS}]+|[{_CLASS}]+$', '', 'g') AS trimmed FROM documents")
def mod_trim(spark, d):
    return table(spark, d, "documents").select("doc_id", mods.trim(F.col("text")).alias("trimmed"))


@query("SELECT p_partkey, lower(p_brand) AS low, upper(p_name) AS up FROM part")
def mod_case(spark, d):
    return table(spark, d, "part").select("p_partkey", mods.lower(F.col("p_brand")).alias("low"), mods.upper(F.col("p_name")).alias("up"))


@query("SELECT c_custkey, CASE WHEN starts_with(c_name, 'Customer#') THEN substr(c_name, 10) ELSE c_name END AS l, CASE WHEN ends_with(c_name, '1') THEN substr(c_name, 1, length(c_name) - 1) ELSE c_name END AS r FROM customer")
def mod_affix(spark, d):
    c = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", mods.trim_left(c, "Customer#").alias("l"), mods.trim_right(c, "1").alias("r"))


@query("SELECT p_partkey, replace(p_name, 'a', '4') AS name FROM part")
def mod_replace(spark, d):
    return table(spark, d, "part").select("p_partkey", mods.MODS["replace"].apply(F.col("p_name"), STRING, ("a", "4")).alias("name"))


@query("SELECT o_orderkey, least(greatest(o_totalprice, 1000.0::DOUBLE), 200000.0::DOUBLE) AS price FROM orders")
def mod_clamp(spark, d):
    return table(spark, d, "orders").select("o_orderkey", mods.clamp(F.col("o_totalprice"), "1000", "200000", False).alias("price"))


def _rules_of(errors: str) -> Column:
    return F.transform(errors, lambda e: e["rule"])


@query("SELECT o_orderkey, least(greatest(o_totalprice, 50000.0::DOUBLE), 200000.0::DOUBLE) AS o_totalprice, CASE WHEN o_totalprice >= 100000 THEN '' ELSE 'gte' || CASE WHEN least(greatest(o_totalprice, 50000.0), 200000.0) >= 60000 THEN '' ELSE ',gte' END END AS failed FROM orders")
def pipe_order(spark, d):
    out = apply_pipes(table(spark, d, "orders"), {"o_totalprice": "gte=100000 clamp=50000|200000 gte=60000"})
    return out.select("o_orderkey", "o_totalprice", F.array_join(_rules_of("errors"), ",").alias("failed"))


_CUSTOMER = {"c_name": "trimleft=Customer# numeric len=9", "c_mktsegment": "oneof=BUILDING|MACHINERY|FURNITURE", "c_acctbal": "gte=0"}
_SEGMENT, _BALANCE = "c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')", "c_acctbal < 0"


@query(f"SELECT c_custkey, substr(c_name, 10) AS c_name, c_mktsegment, c_acctbal, NOT ({_SEGMENT} OR {_BALANCE}) AS valid, CASE WHEN {_SEGMENT} THEN 'oneof' WHEN {_BALANCE} THEN 'gte' END AS first_rule FROM customer")
def pipe_first_error(spark, d):
    out = apply_pipes(table(spark, d, "customer"), _CUSTOMER, errors="first")
    return out.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "valid", F.get(_rules_of("errors"), F.lit(0)).alias("first_rule"))


@query(f"SELECT c_custkey, concat_ws(',', CASE WHEN {_SEGMENT} THEN 'oneof' END, CASE WHEN {_BALANCE} THEN 'gte' END) AS failed FROM customer")
def pipe_all_errors(spark, d):
    return apply_pipes(table(spark, d, "customer"), _CUSTOMER).select("c_custkey", F.array_join(_rules_of("errors"), ",").alias("failed"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x < -0.2))::BIGINT AS low, len(embedding) = 64 AS len_ok, list_sum(list_transform(embedding, lambda x: CASE WHEN x < -0.2 THEN 1 ELSE 0 END))::BIGINT AS clamped FROM embeddings")
def scope_inner(spark, d):
    out = apply_pipes(table(spark, d, "embeddings").withColumn("v", F.col("embedding")), {"embedding": "len=64 inner:(gte=-0.2)", "v": "inner:(clamp=-0.2|)"})
    bad = F.filter("errors", lambda e: e["rule"] == "gte")
    same = F.zip_with("v", "embedding", lambda a, b: (a != b).cast("int"))
    return out.select("vec_id", F.size(bad).cast("long").alias("low"), (F.size("embedding") == 64).alias("len_ok"), F.aggregate(same, F.lit(0).cast("long"), lambda a, x: a + x).alias("clamped"))


@query("SELECT event_id, array_to_string(list_transform(json_keys(props), lambda x: upper(x)), ',') AS keys FROM events")
def scope_keys(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return apply_pipes(e, {"m": "keys:(toupper)"}).select("event_id", F.array_join(F.map_keys("m"), ",").alias("keys"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, TRUE AS valid FROM events")
def dec_field(spark, d):
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    return decode(table(spark, d, "events").select("event_id", "props"), "props", schema).select("event_id", "k", "valid")


@query("SELECT event_id, array_to_string(list_filter(json_keys(props), lambda x: x <> 'z'), ',') AS unknown FROM events")
def obj_unknown(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(unknown_keys(F.col("props"), ["z"]), ",").alias("unknown"))


@query("SELECT c_custkey, lower(hex(encode(c_name))) AS hex, to_base64(encode(c_name)) AS b64 FROM customer")
def fmt_hex_b64(spark, d):
    raw = F.col("c_name").cast("binary")
    return table(spark, d, "customer").select("c_custkey", formats.to_hex(raw).alias("hex"), formats.to_base64(raw).alias("b64"))


def _base32_sql(alphabet: str) -> str:
    place = " + ".join(f"{16 >> k} * substr(rpad(bin(c_name), (8 * strlen(c_name) + 4)::INT, '0'), (5 * i + {k + 1})::INT, 1)::INT" for k in range(5))
    used = "(8 * strlen(c_name) + 4) // 5"
    return f"array_to_string(list_transform(range({used}), lambda i: substr('{alphabet}', 1 + {place}, 1)), '') || repeat('=', ((8 - ({used}) % 8) % 8)::INT)"


@query(f"SELECT c_custkey, {_base32_sql(formats.BASE32)} AS b32, {_base32_sql(formats.BASE32HEX)} AS b32hex, c_name AS back FROM customer")
def fmt_base32(spark, d):
    raw = F.col("c_name").cast("binary")
    texts = table(spark, d, "customer").select("c_custkey", formats.to_base32(raw).alias("b32"), formats.to_base32(raw, formats.BASE32HEX).alias("b32hex"))
    return texts.select("*", formats.from_base32(F.col("b32")).cast("string").alias("back"))


@query("SELECT c_custkey, c_name AS back, CASE WHEN strlen(c_name) = 18 THEN c_name END AS fixed FROM customer")
def fmt_number_array(spark, d):
    back = formats.from_number_array(formats.to_number_array(F.col("c_name").cast("binary")))
    return table(spark, d, "customer").select("c_custkey", back.cast("string").alias("back"), formats.of_length(back, 18).cast("string").alias("fixed"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS day FROM orders")
def fmt_rfc3339(spark, d):
    return table(spark, d, "orders").select("o_orderkey", formats.to_rfc3339(F.col("o_orderdate")).alias("day"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS us FROM events")
def fmt_unix(spark, d):
    return table(spark, d, "events").select("event_id", formats.to_unix(F.col("ts")).alias("ms"), formats.to_unix(F.col("ts"), "micro").alias("us"))


@query("SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS json FROM nation")
def enc_row(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", E.encode(n).alias("json"))


@query("SELECT p_partkey, '{\"brand\":\"' || p_brand || '\"' || CASE WHEN p_size > 10 THEN ',\"size\":\"' || p_size || '\"' ELSE '' END || '}' AS json FROM part")
def omit_rules(spark, d):
    p = table(spark, d, "part").withColumn("none", F.lit("")).withColumn("size0", F.when(F.col("p_size") > 10, F.col("p_size")).otherwise(0))
    out = {"p_brand": E.Out("brand"), "none": E.Out("none", omit_empty=True), "size0": E.Out("size", omit_zero=True, quoted=True)}
    return p.select("p_partkey", E.encode(p, out).alias("json"))


_PROBES = [
    ('{"a":1}', True, "object"), ("[1,2]", True, "array"), ('"x"', True, "string"), ("12", True, "integer"), ("1.5", True, "number"), ("true", True, "bool"), ("null", True, "null"),
    ('{"a":1} x', False, None), ('{"a":1}{"b":2}', False, None), ("[1,]", False, None), ("01", False, None), ("{'a':1}", False, None), ("NaN", False, None), ('{"a":1', False, None), ("1],[2", False, None),
]


@query("SELECT * FROM (VALUES " + ", ".join("('{}', {}, {})".format(p.replace("'", "''"), str(ok).upper(), f"'{s}'" if s else "NULL") for p, ok, s in _PROBES) + ") t(payload, ok, shape)")
def payload_integrity(spark, d):
    df = spark.createDataFrame([(p,) for p, _, _ in _PROBES], "payload string")
    ok = F.coalesce(is_json(F.col("payload")), F.lit(False))
    return df.select("payload", ok.alias("ok"), F.when(ok, shape(F.try_parse_json("payload"))).alias("shape"))


_OBJECTS = [
    ('{"id":1,"name":"x"}', 1, "x", ""), ('{"name":"x"}', 0, "x", "required"), ('{"id":1,"name":null}', 1, None, "value"), ('{"id":1.0,"name":"x"}', None, "x", "value"),
    ('{"id":"1","name":"x"}', None, "x", "value"), ('{"id":1,"name":"x","z":2}', 1, "x", "unknown"), ('{"id":1}', 1, "", ""), ('{"id":1,"id":2}', 1, "", "duplicate"),
    ('{"id":1} 2', None, None, "syntax"), ("[]", None, None, "syntax"),
]


def _sql(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


@query("SELECT payload, id::VARCHAR AS id, name, failed FROM (VALUES " + ", ".join(f"({', '.join(map(_sql, r))})" for r in _OBJECTS) + ") t(payload, id, name, failed)")
def payload_policies(spark, d):
    df = spark.createDataFrame([(r[0],) for r in _OBJECTS], "payload string")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    return decode(df, "payload", schema, required=("id",)).select("payload", F.col("id").cast("string").alias("id"), "name", F.array_join(_rules_of("errors"), ",").alias("failed"))


def _rows(names: str, rows: list[tuple]) -> str:
    """Expected rows as SQL, written from the survey's semantics."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) t({names})"


# payload, id, tags (null marked), u, props, errors as path:rule
_SHAPES = [
    ('{"id":1,"x":{"a":1,"a":2}}', "1", "", "0", ""), ('{"id":1,"z":1,"z":2}', "1", "", "0", ""), ('{"id":1,"id":2,"id":"x"}', "1", "", "0", "id:duplicate"),
    ('{"id":1,"id":}', None, None, None, ":syntax"), ('{"tags":["a","b"]}', "0", "a|b", "0", ""), ('{"tags":["a",null]}', "0", None, "0", "tags[]:value"),
    ('{"tags":[1,true]}', "0", None, "0", "tags[]:value"), ('{"tags":null}', "0", None, "0", ""), ('{"tags":[]}', "0", "", "0", ""), ('{"tags":"a"}', "0", None, "0", "tags:value"),
    ('{"u":18446744073709551615}', "0", "", "18446744073709551615", ""), ('{"u":1.0}', "0", "", None, "u:value"), ('{"u":1e2}', "0", "", None, "u:value"), ('{"u":"1"}', "0", "", None, "u:value"),
    ('{"id":9223372036854775807}', "9223372036854775807", "", "0", ""), ('{"id":9223372036854775808}', None, "", "0", "id:value"), ('{"id":-9223372036854775808}', "-9223372036854775808", "", "0", ""),
    ('{"id":01}', None, None, None, ":syntax"), ('{"id":1.0}', None, "", "0", "id:value"), ('{"id":true}', None, "", "0", "id:value"), ('{"id":null}', None, "", "0", "id:value"),
    ('{"m":{"a":1,"b":2}}', "0", "", "0", ""), ('{"m":{"a":"1"}}', "0", "", "0", "m.a.value:value"), ('{"m":null}', "0", "", "0", ""), ('{"m":[1]}', "0", "", "0", "m:value"),
    ('{"o":{"n":3,"s":"x"}}', "0", "", "0", ""), ('{"o":{"n":"3"}}', "0", "", "0", "o.n:value"), ('{"o":{}}', "0", "", "0", ""), ('{"o":5}', "0", "", "0", "o:value"),
    ('{"f":1e400}', "0", "", "0", "f:value"), ('{"f":-0}', "0", "", "0", ""), ('{"f":"NaN"}', "0", "", "0", "f:value"), ('{"f":NaN}', None, None, None, ":syntax"), ('{"b":"true"}', "0", "", "0", "b:value"),
    ('{"b":1}', "0", "", "0", "b:value"), ('{"b":false}', "0", "", "0", ""), ("{'id':1}", None, None, None, ":syntax"), ('{"id":1,}', None, None, None, ":syntax"), ('{"id":1}{}', None, None, None, ":syntax"),
    ('{"id":1}],[{"id":2}', None, None, None, ":syntax"), ('{"s":"\\ud83d\\ude00"}', "0", "", "0", ""), ('{"s":"\\ud83d"}', None, None, None, ":syntax"), ('{"s":"\\\\ud83d"}', "0", "", "0", ""),
    (' \n{"id":7}\t', "7", "", "0", ""), ("", None, None, None, ":syntax"), ("null", None, None, None, ":syntax"), ('{"id":"1","u":"2"}', None, "", None, "id:value"), ('{"ID":1}', "0", "", "0", ""),
]


@query(_rows("payload, id, tags, u, failed", _SHAPES))
def payload_shapes(spark, d):
    """Strict shapes at every level, repeated keys, skipped content, 64-bit edges."""
    inner = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("s", T.StringType())])
    types = {"id": T.LongType(), "tags": T.ArrayType(T.StringType()), "u": T.DecimalType(20, 0), "m": T.MapType(T.StringType(), T.IntegerType()), "o": inner, "f": T.DoubleType(), "b": T.BooleanType(), "s": T.StringType()}
    df = spark.createDataFrame([(r[0],) for r in _SHAPES], "payload string")
    out = decode(df, "payload", T.StructType([T.StructField(k, v) for k, v in types.items()]), unknown="ignore")
    failed = F.array_join(F.transform("errors", lambda e: F.concat(F.array_join(e["path"], "."), F.lit(":"), e["rule"])), ",")
    return out.select("payload", F.col("id").cast("string").alias("id"), F.array_join("tags", "|").alias("tags"), F.col("u").cast("string").alias("u"), failed.alias("failed"))


_FIRST = [('{"name":"alice","name":"bob","n":1}', "alice", 1, ""), ('{"name":"x","n":10,"n":999,"n":-5}', "x", 10, ""), ('{"name":"x","n":1,"n":@@@}', None, None, ": malformed payload"), ('{"n":null,"n":5}', "", None, "n: value doesn't fit the field"), ('{"n":101,"n":1}', "", 101, "n: value 101 exceeds maximum 100")]


@query(_rows("payload, name, n, failed", _FIRST))
def payload_first_wins(spark, d):
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.IntegerType())])
    df = spark.createDataFrame([(r[0],) for r in _FIRST], "payload string")
    out = decode(df, "payload", schema, duplicates="first", pipes={"name": "minlen=1", "n": "gte=0 lte=100"})
    return out.select("payload", "name", "n", error_text(F.col("errors")).alias("failed"))


# payload, count, price, opt, errors
_LOOSE = [
    ('{"count":5,"price":99,"opt":2}', 5, 99, 2, ""), ('{"count":"7","price":99,"opt":"3"}', 7, 99, 3, ""), ('{"count":1,"price":{"amount":42},"opt":0}', 1, 42, 0, ""),
    ('{"count":1,"price":1,"opt":null}', 1, 1, 0, ""), ('{"count":"-3","price":1,"opt":0}', -3, 1, 0, "rule count: value -3 below minimum 0"),
    ('{"count":true,"price":1,"opt":0}', None, 1, 0, "parse count: value doesn't fit the field"), ('{"count":"xyz","price":1}', None, 1, 0, "parse count: invalid number"),
    ('{"count":null}', None, 0, 0, "parse count: value doesn't fit the field"), ("{}", 0, 0, 0, ""), ('{"price":{"amount":"x"}}', 0, None, 0, "parse price.amount: value doesn't fit the field"),
]
_ATOI = Function(lambda c: F.struct(c.try_cast("int").alias("value"), F.when(~F.rlike(c, F.lit(r"\A[+-]?[0-9]+\z")) | c.try_cast("int").isNull(), "invalid number").alias("error")), "try", "string")
_MONEY = Function(lambda c: c["amount"], "mod", "object", T.StructType([T.StructField("amount", T.IntegerType())]))


def _kinds_and_texts(errors: str) -> Column:
    return F.array_join(F.transform(errors, lambda e: F.concat(e["kind"], F.lit(" "), error_text(F.array(e)))), "; ")


@query(_rows("payload, count, price, opt, failed", _LOOSE))
def var_converters(spark, d):
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("count", "price", "opt")])
    pipes = {"count": ". / @AtoiStrict ~ gte=0", "price": ". / @FromMoney", "opt": "nullzero / . / @AtoiStrict"}
    df = spark.createDataFrame([(r[0],) for r in _LOOSE], "payload string")
    out = decode(df, "payload", schema, pipes=pipes, functions={"AtoiStrict": _ATOI, "FromMoney": _MONEY})
    return out.select("payload", "count", "price", "opt", _kinds_and_texts("errors").alias("failed"))


_SHORT = "CASE WHEN c_custkey % 3 = 0 THEN 'ab' ELSE c_mktsegment END"


@query(
    f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE {_SHORT} END AS email, CASE WHEN c_custkey % 3 = 0 THEN 'parse email: rejected by mod' ELSE "
    "concat_ws('; ', 'rule email: \"' || c_mktsegment || '\" does not contain \"@\"', CASE WHEN length(c_mktsegment) < 10 THEN 'rule email: length ' || length(c_mktsegment) || ' below minimum 10' END, "
    "CASE WHEN c_acctbal < 0 THEN 'rule c_acctbal: value below' END) END AS failed FROM customer"
)
def pipe_fallible(spark, d):
    """A transform that fails ends the record with its error alone."""
    reject = Function(lambda c: F.struct(c.alias("value"), F.when(F.octet_length(c) < 3, "rejected by mod").alias("error")), "try")
    df = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "ab").otherwise(F.col("c_mktsegment")).alias("email"), "c_acctbal")
    out = apply_pipes(df, {"email": "required @RejectShort contains=@ minlen=10", "c_acctbal": "gte=0"}, {"RejectShort": reject})
    # the balance's own text is a float's: told by its start only
    short = F.regexp_replace(_kinds_and_texts("errors"), r"value -[0-9.e]+ below minimum 0", "value below")
    return out.select("c_custkey", "email", short.alias("failed"))


_MESSAGES = [
    ("maxlen=2", "abc", "length 3 exceeds maximum 2"), ("maxrunes=1", "éé", "rune count 2 exceeds maximum 1"), ("url", "://b", '"://b" is not a valid url'), ("alphanum", "a b", '"a b" must be alphanumeric'),
    ("numeric", "1x", '"1x" must be all digits'), ("hexadecimal", "g", '"g" is not hexadecimal'), ("islower", "aB", '"aB" contains uppercase letters'), ("isupper", "Ab", '"Ab" contains lowercase letters'),
    ("starts=a", "ba", '"ba" does not start with "a"'), ("ends=b", "ba", '"ba" does not end with "b"'), ("contains=x", "ba", '"ba" does not contain "x"'), ("len=2", "a", "length 1 != required 2"),
    ("notempty", "", "must not be empty"), ("eq=yes", "no", "value no != yes"), ("neq=no", "no", "value must not equal no"), ("oneof=a|b", "c", "value c not in allowed set [a, b]"),
]


@query(_rows("rule, v, message", _MESSAGES))
def err_messages(spark, d):
    out = None
    for rule, v, _ in _MESSAGES:
        one = apply_pipes(spark.createDataFrame([(rule, v)], "rule string, v string"), {"v": rule}).select("rule", "v", F.col("errors")[0]["message"].alias("message"))
        out = one if out is None else out.unionByName(one)
    return out


_FLOATS = [
    ("0", "0"), ("-0.0", "-0"), ("1", "1"), ("-1.5", "-1.5"), ("1.2345678901234568e-5", "0.000012345678901234568"), ("1.2345678901234566e-9", "1.2345678901234566e-9"), ("1e-6", "0.000001"), ("9.99e-7", "9.99e-7"), ("1e-7", "1e-7"), ("1e20", "100000000000000000000"),
    ("1e21", "1e+21"), ("123456789012345680000", "123456789012345680000"), ("1.7976931348623157e308", "1.7976931348623157e+308"), ("0.1", "0.1"), ("123.456", "123.456"), ("100", "100"), ("12345678.9", "12345678.9"),
]


@query("SELECT text, '{\"list\":[' || json || ',null],\"v\":' || json || '}' AS json FROM (" + _rows("text, json", _FLOATS) + ") UNION ALL SELECT 'NaN', NULL UNION ALL SELECT 'Infinity', NULL")
def enc_floats(spark, d):
    """Shortest texts at the top level and inside arrays; NaN and infinity have no JSON text."""
    v = F.col("text").cast("double")
    df = spark.createDataFrame([(r[0],) for r in _FLOATS] + [("NaN",), ("Infinity",)], "text string").select("text", v.alias("v"), F.array(v, F.lit(None).cast("double")).alias("list"))
    return df.select("text", E.encode(df.select("v", "list")).alias("json"))


@query("SELECT p_partkey, '{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || ',\"type\":\"' || p_type || '\"}' AS json FROM part")
def enc_splice(spark, d):
    """A catch-all map's entries stand behind the named fields."""
    p = table(spark, d, "part").withColumn("rest", F.create_map(F.lit("type"), F.col("p_type")))
    return p.select("p_partkey", E.encode(p, {"rest": E.Out(splice=True), "p_size": E.Out("size"), "p_brand": E.Out("brand")}).alias("json"))


# format, text, canonical text or null
_NETWORK = [
    ("addr", "1.2.3.4", "1.2.3.4"), ("addr", "1.2.3.04", None), ("addr", "256.1.1.1", None), ("addr", "::1", "::1"), ("addr", "FE80::1%eth0", "fe80::1%eth0"), ("addr", "::1%", None), ("addr", "", None),
    ("addr", "::ffff:1.2.3.4", "::ffff:1.2.3.4"), ("ip", "", ""), ("ip", "::ffff:1.2.3.4", "1.2.3.4"), ("ip", "fe80::1%eth0", None), ("ip", "2001:DB8:0:0::1", "2001:db8::1"), ("ip", "1.2.3", None),
    ("prefix", "10.1.2.3/8", "10.1.2.3/8"), ("prefix", "10.0.0.0/33", None), ("prefix", "10.0.0.0/08", None), ("prefix", "::1/128", "::1/128"), ("prefix", "10.0.0.0", None),
    ("cidr", "10.1.2.3/8", "10.0.0.0/8"), ("cidr", "2001:db8::1/32", "2001:db8::/32"), ("cidr", "fe80::1%eth0/64", None), ("cidr", "", ""), ("cidr", "1.2.3.4/0", "0.0.0.0/0"),
    ("socket", "1.2.3.4:80", "1.2.3.4:80"), ("socket", "[::1]:80", "[::1]:80"), ("socket", "[fe80::1%eth0]:80", "[fe80::1%eth0]:80"), ("socket", ":80", ":80"), ("socket", "", ""), ("socket", "localhost:80", None),
    ("socket", "1.2.3.4:65536", None), ("socket", "1.2.3.4:http", None), ("socket", "[::ffff:1.2.3.4]:80", "1.2.3.4:80"), ("socket", "[::ffff:1.2.3.4%e]:80", None), ("socket", "::1:80", None), ("socket", "[1.2.3.4]:80", None), ("socket", "1.2.3.4", None),
    ("url", "http://a.b/c?d=e#f", "http://a.b/c?d=e#f"), ("url", "HTTP://a.b/c d", "http://a.b/c%20d"), ("url", "://a", None), ("url", "http://a b/", None), ("url", "/x/y", "/x/y"), ("url", "http://a:x/", None), ("url", "http://a/%zz", None),
    ("url", "a:b", "a:b"), ("url", "mailto:x@y.z", "mailto:x@y.z"), ("url", "http://[::1]:8080/", "http://[::1]:8080/"), ("url", "1a:b", None), ("url", "", ""),
    ("bigint", "123456789012345678901234567890123456789012", "123456789012345678901234567890123456789012"), ("bigint", "-0", "-0"), ("bigint", "01", None), ("bigint", "1.0", None),
    ("bigdecimal", "1.50", "1.5"), ("bigdecimal", "1e400", "1e+400"), ("bigdecimal", "x", None), ("bigrational", "4/6", "2/3"), ("bigrational", "1/0", None), ("bigrational", "0.25", "1/4"), ("bigrational", "3", "3/1"),
]


@query(_rows("format, t, canonical", _NETWORK))
def fmt_network(spark, d):
    df = spark.createDataFrame([(f, t) for f, t, _ in _NETWORK], "format string, t string")
    out = F.lit(None).cast("string")
    for name, read in network.READERS.items():
        out = F.when(F.col("format") == name, read(F.col("t"))).otherwise(out)
    return df.select("format", "t", out.alias("canonical"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S +0000') AS rfc1123z, strftime(o_orderdate, '%-I:%M%p') AS kitchen, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderdate AS back FROM orders")
def fmt_layout(spark, d):
    c = F.col("o_orderdate")
    text = formats.to_layout(c.cast("timestamp"), "RFC1123Z")
    return table(spark, d, "orders").select("o_orderkey", text.alias("rfc1123z"), formats.to_layout(c, "Kitchen").alias("kitchen"), formats.to_layout(c, "2006-01-02").alias("day"), formats.from_layout(text, "RFC1123Z").cast("timestamp_ntz").alias("back"))


# text, nanoseconds, what is written back
_DURATIONS = [
    ("1h30m", 5400000000000, "1h30m0s"), ("1.5s", 1500000000, "1.5s"), ("-2ms", -2000000, "-2ms"), ("0", 0, "0s"), ("3us", 3000, "3µs"), ("4ns", 4, "4ns"), ("1m", 60000000000, "1m0s"), ("1500ms", 1500000000, "1.5s"),
    ("1.25ms", 1250000, "1.25ms"), ("9999999999h", None, None), ("99999999999999999999999s", None, None), ("5", None, None), ("1x", None, None), ("1h1s", 3601000000000, "1h0m1s"),
]


@query(_rows("text, nanos, back", _DURATIONS))
def fmt_duration(spark, d):
    n = formats.from_duration(F.col("text"))
    return spark.createDataFrame([(r[0],) for r in _DURATIONS], "text string").select("text", n.alias("nanos"), formats.to_duration(n).alias("back"))


@query("SELECT n, us FROM (VALUES (1700000000123456999::BIGINT, 1700000000123456::BIGINT), (-1, -1), (999, 0), (0, 0)) t(n, us)")
def fmt_unix_nano(spark, d):
    df = spark.createDataFrame([(1700000000123456999,), (-1,), (999,), (0,)], "n long")
    return df.select("n", F.unix_micros(formats.from_unix(F.col("n"), "nano")).alias("us"))


@query("SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN " + _SEGMENT + " THEN 'oneof' END, CASE WHEN " + _BALANCE + " THEN 'gte' END], lambda x: x IS NOT NULL)) AS rule FROM customer) GROUP BY rule")
def ext_violations(spark, d):
    """Extension: violations by rule."""
    out = apply_pipes(table(spark, d, "customer"), _CUSTOMER)
    return out.select(F.explode(_rules_of("errors")).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
