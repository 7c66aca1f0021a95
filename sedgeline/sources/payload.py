"""JSON text columns: whole-payload integrity, key policies and typed fields, in Catalyst expressions.

The JSON reader alone is lax: it takes trailing data, repeated keys and single quotes. The integrity test refuses them. A
payload is parsed once into a variant for each declared field; what is skipped is only checked for its grammar, so
repeated keys in it pass. Known limits: nesting beyond about 1000 levels counts as malformed; a declared container with
repeated keys inside doesn't fit its field; integers beyond 64 bits written with a point (`1e19` apart) count as integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import formats
from ..functions import rules as R
from ..plans.compiler import ERRORS, Function, StepError, apply_pipes, check, error_row, kind_of, let, stopping, when_error, zero_of
from ..plans.grammar import Pipe, parse

_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}
_BAD = "__bad"
# A high surrogate's escape without its low one, or a low one alone.
_LONE = r"(?<!\\)(?:\\\\)*\\u(?:[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])|(?<!\\u[dD][89abAB][0-9a-fA-F]{2}\\u)[dD][c-fC-F])"


def is_json(payload: Column) -> Column:
    """One JSON value and nothing after it."""
    return (
        F.try_parse_json(payload).isNotNull()
        & F.coalesce(F.json_array_length(F.concat(F.lit("["), payload, F.lit("]"))) == 1, F.lit(False))
        & F.try_parse_json(F.concat(F.lit('{"v":'), payload, F.lit("}"))).isNotNull()
    )


def one_value(payload: Column) -> Column:
    """As is_json, but repeated keys in objects pass, and quotes and control characters aren't looked at closely."""
    alone = F.json_array_length(F.concat(F.lit("["), payload, F.lit("]"))) == 1
    closed = F.size(F.json_object_keys(F.concat(F.lit('{"v":'), payload, F.lit("}")))) == 1
    return F.coalesce(alone & closed, F.lit(False))


def unknown_keys(payload: Column, declared: list[str]) -> Column:
    return F.array_except(F.json_object_keys(payload), F.array(*[F.lit(k) for k in declared]))


def shape(v: Column) -> Column:
    """string, integer, number, bool, null, object or array."""
    s = F.schema_of_variant(v)
    return (
        F.when(s == "STRING", "string")
        .when((s == "BIGINT") | F.rlike(s, F.lit(r"\ADECIMAL\((19|[23][0-9]),0\)\z")), "integer")
        .when(s.startswith("DECIMAL") | (s == "DOUBLE"), "number")
        .when(s == "BOOLEAN", "bool")
        .when(s == "VOID", "null")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
    )


_INPUTS = {"string": T.StringType(), "number": T.DoubleType(), "bool": T.BooleanType(), "array": T.ArrayType(T.StringType()), "object": T.MapType(T.StringType(), T.StringType())}


def _path(key: str) -> str:
    return "$['" + key.replace("'", "\\'") + "']"


def _right(s: Column, kind: str) -> Column:
    """Whether a variant's schema text is of the kind's shape."""
    integer = (s == "BIGINT") | (F.startswith(s, F.lit("DECIMAL")) & F.rlike(s, F.lit(r"\ADECIMAL\((19|[23][0-9]),0\)\z")))
    if kind in (R.STRING, R.BINARY):
        return s == "STRING"
    if kind == R.INTEGER:
        return integer
    if kind == R.NUMBER:
        return (s == "BIGINT") | (s == "DOUBLE") | F.startswith(s, F.lit("DECIMAL"))
    return s == "BOOLEAN" if kind == R.BOOLEAN else F.startswith(s, F.lit("ARRAY" if kind == R.ARRAY else "OBJECT"))


def _read(v: Column, t: T.DataType) -> Column:
    """A scalar out of a variant of the right shape, null where it doesn't fit."""
    if kind_of(t) == R.BINARY:
        return formats.from_base64(F.try_variant_get(v, "$", "string"))
    read = F.try_variant_get(v, "$", t.simpleString())
    return F.when(F.abs(read) < float("inf"), read) if isinstance(t, (T.DoubleType, T.FloatType)) else read


def _is_null(v: Column) -> Column:
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))


def typed(v: Column, t: T.DataType, path, null: bool = False, unknown: str = "ignore") -> Column:
    """struct(v, e) of a variant as a value of the type. null: null fits scalars too (arrays and maps always take it); null elements
    of arrays and maps fit only structures and containers."""
    kind = kind_of(t)
    wrong = lambda: F.array(error_row(path, "value", "value doesn't fit the field", "parse"))
    none = F.array().cast(ERRORS)
    made = lambda value, e: F.struct(value.cast(t).alias("v"), e.alias("e"))
    right = _right(F.schema_of_variant(v), kind)
    if kind == R.ARRAY:
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: typed(x, t.elementType, [*path[:-1], F.concat(path[-1], F.lit("[]"))], False, unknown))
        got = let(items, lambda r: made(F.transform(r, lambda x: x["v"]), F.coalesce(F.flatten(F.transform(r, lambda x: x["e"])), none)))
    elif kind == R.MAP:
        entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        one = lambda e: F.struct(e["key"].alias("k"), typed(e["value"], t.valueType, [*path, F.concat(e["key"], F.lit(".value"))], False, unknown).alias("r"))
        got = let(
            F.transform(entries, one),
            lambda r: made(F.map_from_entries(F.transform(r, lambda x: F.struct(x["k"], x["r"]["v"]))), F.coalesce(F.flatten(F.transform(r, lambda x: x["r"]["e"])), none)),
        )
    elif isinstance(t, T.StructType):
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        parts = [F.try_variant_get(v, _path(f.name), "variant") for f in t.fields]
        parts = [F.when(F.array_contains(keys, f.name), typed(x, f.dataType, [*path, F.lit(f.name)], f.metadata.get("nullable", False), unknown)) for f, x in zip(t.fields, parts, strict=True)]

        def whole(r: Column) -> Column:
            fields = [F.when(r[i].isNotNull(), r[i]["v"]).otherwise(zero_of(f.dataType)).alias(f.name) for i, f in enumerate(t.fields)]
            bad = [F.coalesce(r[i]["e"], none) for i in range(len(t.fields))]
            if unknown == "error":
                bad.append(F.coalesce(F.transform(F.array_except(keys, F.array(*[F.lit(f.name) for f in t.fields])), lambda k: error_row([*path, k], "unknown", "unknown key")), none))
            return made(F.struct(*fields), F.concat(*bad))

        got = let(F.struct(*[p.alias(f"c{i}") for i, p in enumerate(parts)]), lambda r: whole([r[f"c{i}"] for i in range(len(parts))]))
    else:
        read = _read(v, t)
        return F.when(_is_null(v), made(F.lit(None), none if null else wrong())).otherwise(
            let(F.when(right, read), lambda x: made(x, F.when(x.isNull(), wrong()).otherwise(none)))
        )
    return F.when(_is_null(v), made(F.lit(None), none)).when(right, got).otherwise(made(F.lit(None), wrong()))


def _converted(v: Column, t: T.DataType, name: str, pipe: Pipe, functions: dict[str, Function], null: bool, unknown: str) -> Column:
    """struct(v, e) by the field's input variants: the one that takes the value's shape."""
    path = [F.lit(name)]
    found = F.when(shape(v) == "integer", "number").otherwise(shape(v))
    out = None
    for x in pipe.variants:
        if not x.function:
            continue
        f = functions[x.name]
        given = f.input or _INPUTS[f.takes]
        made = let(typed(v, given, path, False, "ignore"), lambda g: _through(g, f, x, t, path))  # noqa: B023
        out = F.when(found == f.takes, made) if out is None else out.when(found == f.takes, made)
    own = typed(v, t, path, null, unknown)
    native = any(x.name == "." and not x.function for x in pipe.variants)
    if not native:
        own = F.when(_is_null(v) & F.lit(pipe.null_zero or null), own).otherwise(F.struct(F.lit(None).cast(t).alias("v"), F.array(error_row(path, "value", "value doesn't fit the field", "parse")).alias("e")))
    return own if out is None else out.otherwise(own)


def _through(g: Column, f: Function, step, t: T.DataType, path) -> Column:
    empty = F.lit(None).cast(t)
    if f.role == "mod":
        return F.struct(F.when(F.size(g["e"]) == 0, f.column(g["v"])).otherwise(empty).cast(t).alias("v"), g["e"].alias("e"))
    return let(
        f.column(g["v"]),
        lambda r: F.struct(
            F.when((F.size(g["e"]) == 0) & r["error"].isNull(), r["value"].cast(t)).otherwise(empty).alias("v"),
            F.when(F.size(g["e"]) > 0, g["e"]).otherwise(when_error(r["error"].isNotNull(), error_row(path, step.name, r["error"], "parse"))).alias("e"),
        ),
    )


def decode(
    df: DataFrame, payload: str, schema: T.StructType, duplicates: str = "error", unknown: str = "error", null_zero: bool = False, required: tuple[str, ...] = (), absent_zero: bool = True,
    pipes: dict[str, str] | None = None, functions: dict[str, Function] | None = None, errors: str = "all", utf8: str = "error",
) -> DataFrame:
    """Fields of a JSON object as columns, with `errors` and `valid`.

    duplicates: error or first; the first of repeated keys gives the value either way. unknown: error, ignore or collect
    (adds `unknown`, a map of key to JSON text). A key that is absent gives the kind's zero value, or null with
    absent_zero=False, and its steps don't run; null fits arrays, maps and nullable fields only, unless null_zero. pipes: step
    lists by field, with input variants; functions: what they name. utf8: error or permit invalid bytes and lone surrogates.
    A parse error (kind "parse") is the only one of its record. Payload order isn't seen: errors come in field order.
    """
    if duplicates not in ("error", "first") or unknown not in ("error", "ignore", "collect") or utf8 not in ("error", "permit"):
        raise StepError("duplicates is 'error' or 'first'; unknown is 'error', 'ignore' or 'collect'; utf8 is 'error' or 'permit'")
    p, names, functions = F.col(f"`{payload}`"), [f.name for f in schema.fields], functions or {}
    parsed = {n: parse(x) for n, x in (pipes or {}).items()}
    wrong = [f"{n}: no such field" for n in parsed if n not in names]
    wrong += [w for n, x in parsed.items() if n in names for w in check(x, schema[n].dataType, n, functions, raw=True)]
    if wrong:
        raise StepError("\n".join(wrong))
    required = (*required, *(n for n, x in parsed.items() if x.required and n not in required))
    whole = T.StructType([*(T.StructField(n, T.VariantType()) for n in names), T.StructField(_BAD, T.StringType())])
    options = {**_OPTIONS, "columnNameOfCorruptRecord": _BAD}
    fine = one_value(p) & F.rlike(p, F.lit(r"\A[ \t\r\n]*\{"))
    if utf8 == "error":
        fine = fine & F.is_valid_utf8(p) & ~(F.contains(p, F.lit("\\u")) & F.rlike(p, F.lit(_LONE)))
    out = df.withColumns({"__o": F.from_json(p, whole, options), "__k": F.json_object_keys(p), "__fine": fine})
    # a field's variant can fail where the grammar is right: repeated keys inside it
    strict = F.from_json(p, T.StructType([T.StructField(_BAD + "_none", T.VariantType()), T.StructField(_BAD, T.StringType())]), options)[_BAD].isNull()
    keys, fine = F.col("__k"), F.col("__fine")
    out = out.withColumn("__fine", F.coalesce(fine & (F.col("__o")[_BAD].isNull() | strict), F.lit(False)))
    again = F.when(F.size(F.array_distinct(keys)) < F.size(keys), repeated_keys_of(keys, names)).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("__again", F.when(fine, again))
    made, seen, read = {}, {}, {}
    for i, f in enumerate(schema.fields):
        v, pipe, kind = F.col("__o")[f.name], parsed.get(f.name), kind_of(f.dataType)
        nz = null_zero or bool(pipe and pipe.null_zero)
        nullable = nz or f.metadata.get("nullable", False)
        # the reader keeps the last of repeated keys in records, but all of them in maps
        pairs = F.filter(F.map_entries(F.from_json(p, T.MapType(T.StringType(), T.VariantType()), _OPTIONS)), lambda e: e["key"] == f.name)  # noqa: B023
        seen[f"__n{i}"] = F.when(F.array_contains(F.col("__again"), f.name), F.get(pairs, F.lit(0))["value"]).otherwise(v)
        v, there = F.col(f"__n{i}"), F.array_contains(keys, f.name)
        if kind in (R.ARRAY, R.MAP, R.OTHER) or pipe and pipe.variants:
            if pipe and pipe.variants:
                got = let(v, lambda x: _converted(x, f.dataType, f.name, pipe, functions, nullable, unknown))  # noqa: B023
            else:
                got = let(v, lambda x: typed(x, f.dataType, [F.lit(f.name)], nullable, unknown))  # noqa: B023
            if nz:
                got = let(got, lambda g: F.struct(F.coalesce(g["v"], F.when(F.size(g["e"]) == 0, zero_of(f.dataType))).alias("v"), g["e"].alias("e")))  # noqa: B023
            got = let(got, lambda g: F.struct(F.when(~F.exists(g["e"], lambda e: e["kind"] == "parse"), g["v"]).alias("v"), g["e"].alias("e")))
            made[f"__f{i}"] = F.when(fine & there, got)
            continue
        # scalars: a column for each step instead of bound values, so that code is generated for all of it
        read[f"__r{i}"] = F.when(fine & _right(F.schema_of_variant(v), kind), _read(v, f.dataType))
        value, bad = F.col(f"__r{i}"), fine & there & F.col(f"__r{i}").isNull()
        null = _is_null(v) & F.lit(nullable)
        wrong_type = F.array(error_row([F.lit(f.name)], "value", "value doesn't fit the field", "parse"))
        made[f"__f{i}"] = F.struct(
            (F.when(bad & null, zero_of(f.dataType)).otherwise(value) if nz else value).alias("v"), F.when(bad & ~null, wrong_type).otherwise(F.array().cast(ERRORS)).alias("e")
        )
    for layer in (seen, read, made):
        out = out.withColumns(layer) if layer else out
    got = {f.name: F.col(f"__f{i}") for i, f in enumerate(schema.fields)}
    none = F.array().cast(ERRORS)
    found = [F.coalesce(got[n]["e"], none) for n in names]
    named = lambda keys_of, rule, message: F.coalesce(F.when(fine, F.transform(keys_of, lambda k: error_row([k], rule, message))), none)
    if duplicates == "error":
        found.append(named(F.col("__again"), "duplicate", "duplicate key"))
    if unknown == "error":
        found.append(named(F.array_except(keys, F.array(*[F.lit(n) for n in names])), "unknown", "unknown key"))
    missing = [when_error(fine & ~F.array_contains(keys, n), error_row([F.lit(n)], "required", R.REQUIRED_MESSAGE)) for n in names if n in required]
    syntax = when_error(~fine, error_row([], "syntax", "malformed payload", "parse"))
    values = {n: got[n]["v"] for n in names}
    if pipes:
        steps = {n: x for n, x in ((n, _without_variants(pipes[n], parsed[n])) for n in parsed) if x}
        out = out.withColumns({f"__v{i}": values[n] for i, n in enumerate(names)} | {"__before": F.concat(syntax, *found)})
        place = {n: f"__v{i}" for i, n in enumerate(names)}
        out = _with_steps(out, {place[n]: x for n, x in steps.items()}, functions, place, keys)
        values = {n: F.col(place[n]) for n in names}
        every = F.concat("__before", "__steps", *missing)
    else:
        every = F.concat(syntax, *found, *missing)
    absent = lambda f: zero_of(f.dataType) if absent_zero and kind_of(f.dataType) != R.OTHER else F.lit(None).cast(f.dataType)
    final = {f.name: F.when(fine & ~F.array_contains(keys, f.name), absent(f)).otherwise(values[f.name]) for f in schema.fields}
    told = stopping(F.col("__errors"))
    columns = [F.col(f"`{c}`") for c in df.columns if c not in (*names, "errors", "valid")]
    out = out.withColumns({f"__z{i}": final[n] for i, n in enumerate(names)} | {"__errors": every})
    more = []
    if unknown == "collect":
        everything = F.from_json(p, T.MapType(T.StringType(), T.StringType()), _OPTIONS)
        more = [F.when(fine, F.map_filter(everything, lambda k, v: ~k.isin(*names))).alias("unknown")]
    told = F.slice(told, 1, 1) if errors == "first" else told
    return out.select(*columns, *[F.col(f"__z{i}").alias(n) for i, n in enumerate(names)], *more, told.alias("errors")).withColumn("valid", F.size("errors") == 0)


def repeated_keys_of(keys: Column, declared: list[str]) -> Column:
    own = F.filter(keys, lambda k: k.isin(*declared))
    return F.array_distinct(F.filter(own, lambda k: F.size(F.filter(own, lambda o: o == k)) > 1))


def _without_variants(text: str, pipe: Pipe) -> str:
    return text.split("~", 1)[1].strip() if pipe.variants and "~" in text else "" if pipe.variants and not pipe.steps else text


def _with_steps(out: DataFrame, steps: dict[str, str], functions: dict[str, Function], place: dict[str, str], keys: Column) -> DataFrame:
    """The steps' errors as `__steps`, under the fields' names; absent fields have none."""
    name_of = {c: n for n, c in place.items()}
    done = apply_pipes(out.drop("errors", "valid"), {c: x for c, x in steps.items()}, functions).withColumnRenamed("errors", "__steps").drop("valid")
    names = F.create_map(*[F.lit(x) for c, n in name_of.items() for x in (c, n)])

    def renamed(e: Column) -> Column:
        head = F.regexp_extract(e["path"][0], r"\A(__v[0-9]+)", 1)
        first = F.concat(names[head], F.regexp_replace(e["path"][0], r"\A__v[0-9]+", ""))
        path = F.concat(F.array(first), F.slice(e["path"], 2, F.size(e["path"])))
        return F.struct(*[path.alias("path") if c == "path" else e[c].alias(c) for c in ("kind", "path", "rule", "message", "value", "limit")])

    held = F.filter("__steps", lambda e: (e["rule"] != "required") & F.array_contains(keys, names[F.regexp_extract(e["path"][0], r"\A(__v[0-9]+)", 1)]))
    return done.withColumn("__steps", F.transform(held, renamed))


def explode_array(df: DataFrame, payload: str, element: T.DataType, strict: bool = True) -> DataFrame:
    """Elements of a JSON array, one row each, with `index` from 0. strict refuses data after the array."""
    p = F.col(f"`{payload}`")
    parsed = F.from_json(p, T.ArrayType(element), _OPTIONS)
    parsed = F.when(F.coalesce(is_json(p), F.lit(False)), parsed) if strict else parsed
    return df.select("*", F.posexplode(parsed).alias("index", "value"))


def read_lines(spark: SparkSession, path: str, column: str = "payload") -> DataFrame:
    """One JSON value a line; blank lines are white space between values."""
    return spark.read.text(path).where(~F.rlike("value", F.lit(r"\A\s*\z"))).withColumnRenamed("value", column)


def read_documents(spark: SparkSession, path: str, column: str = "payload") -> DataFrame:
    """One file, one JSON value."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", column)


def write_lines(df: DataFrame, payload: Column, path: str) -> None:
    df.select(payload.alias("value")).write.text(path)


def until_first(df: DataFrame, index: str, ends: Column) -> DataFrame:
    """Rows of an ordered source up to the first that ends the loop, that one included. One aggregate, no sort."""
    stop = df.where(ends).agg(F.min(index).alias("__stop"))
    return df.join(F.broadcast(stop)).where(F.col("__stop").isNull() | (F.col(index) <= F.col("__stop"))).drop("__stop")
