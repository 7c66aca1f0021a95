"""Step lists compiled to Catalyst expressions: a value and an array of errors for each field, without a UDF.

Steps run in declared order; each validator sees the value as it is by then. Each transform of a column is a projection of
its own and each one inside a container is bound once, so that plans grow with the number of steps only. Nulls skip
built-in steps, but a null array or map counts as empty. A converter or a transform that fails ends the record: its error,
of the kind "parse", is the only one. A check of the whole schema runs on the driver first and raises all its findings at
once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R
from ..functions.mods import MODS
from ..functions.rules import MARKERS, RULES
from .grammar import Pipe, Step, StepError, parse

ERROR = "struct<kind:string,path:array<string>,rule:string,message:string,value:string,limit:string>"
ERRORS = f"array<{ERROR}>"


@dataclass(frozen=True)
class Function:
    """A named step: `column` maps a Column to a Column.

    role: mod gives a value; check a boolean; error a text or null; try a struct of `value` and `error`, whose error is null
    unless the step fails. takes: the JSON shape that it reads as a converter (string, number, bool, object, array),
    input: that shape's type, if it isn't the plain one.
    """

    column: Callable[[Column], Column]
    role: str = "check"
    takes: str | None = None
    input: T.DataType | None = None


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return R.STRING
    if isinstance(t, T.BinaryType):
        return R.BINARY
    if isinstance(t, T.BooleanType):
        return R.BOOLEAN
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or isinstance(t, T.DecimalType) and t.scale == 0:
        return R.INTEGER
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return R.NUMBER
    return R.ARRAY if isinstance(t, T.ArrayType) else R.MAP if isinstance(t, T.MapType) else R.OTHER


def zero_of(t: T.DataType) -> Column:
    """The zero value of a kind that has one."""
    kind = kind_of(t)
    plain = {R.STRING: "", R.INTEGER: 0, R.NUMBER: 0, R.BOOLEAN: False, R.BINARY: b""}
    return (F.lit(plain[kind]) if kind in plain else F.array() if kind == R.ARRAY else F.create_map() if kind == R.MAP else F.lit(None)).cast(t)


#: JSON shapes that a kind reads by itself.
NATIVE_SHAPE = {R.STRING: "string", R.BINARY: "string", R.INTEGER: "number", R.NUMBER: "number", R.BOOLEAN: "bool", R.ARRAY: "array", R.MAP: "object", R.OTHER: "object"}


def _check_variants(pipe: Pipe, kind: str, where: str, functions: dict[str, Function], raw: bool) -> list[str]:
    """raw: values come from a JSON payload, so that converters can read other shapes."""
    out, claimed = [], {}
    for v in pipe.variants:
        if v.name in (".", "nullzero") and not v.function and not v.args:
            shape = NATIVE_SHAPE[kind] if v.name == "." else "null"
        elif not v.function or v.args:
            out.append(f"{where}: input variant {'@' * v.function}{v.name}{'=' * bool(v.args)}{v.arg} isn't supported")
            continue
        elif v.name not in functions:
            out.append(f"{where}: no function @{v.name} for an input variant")
            continue
        elif not raw:
            out.append(f"{where}: input variant @{v.name} needs a payload: a typed column has one shape")
            continue
        elif functions[v.name].takes is None or functions[v.name].role not in ("mod", "try"):
            out.append(f"{where}: input variant @{v.name} needs a function that takes one shape and gives a value")
            continue
        else:
            shape = functions[v.name].takes
        if shape in claimed:
            out.append(f"{where}: input variants {claimed[shape]} and {v.name} both take {shape}")
        claimed[shape] = v.name
    return out


def check(pipe: Pipe, t: T.DataType, where: str, functions: dict[str, Function], raw: bool = False) -> list[str]:
    kind = kind_of(t)
    out = _check_variants(pipe, kind, where, functions, raw)
    for s in pipe.steps:
        if s.function:
            if s.name not in functions:
                out.append(f"{where}: no function @{s.name}")
        elif s.name in MARKERS or s.name == "nullzero":
            if s.args:
                out.append(f"{where}: {s.name} takes no argument")
        elif s.name in RULES:
            out += _check_rule(s, kind, where)
        elif s.name in MODS:
            m = MODS[s.name]
            if kind not in m.kinds:
                out.append(f"{where}: {s.name} doesn't fit {kind}")
            elif (m.args is None and not s.arg) or (m.args is not None and len(s.args) != m.args):
                out.append(f"{where}: {s.name} has the wrong number of arguments")
        else:
            hint = f"; did you mean to{s.name} or is{s.name}?" if s.name in ("lower", "upper") else ""
            out.append(f"{where}: unknown step {s.name}{hint}")
    for scope, child in (("inner", pipe.inner), ("keys", pipe.keys)):
        if child is None:
            continue
        if scope == "inner" and kind in (R.ARRAY, R.MAP):
            out += check(child, t.elementType if kind == R.ARRAY else t.valueType, f"{where}.inner", functions)
        elif scope == "keys" and kind == R.MAP:
            out += check(child, t.keyType, f"{where}.keys", functions)
        else:
            out.append(f"{where}: {scope} doesn't fit {kind}")
    return out


def _check_rule(s: Step, kind: str, where: str) -> list[str]:
    rule = RULES[s.name]
    if kind not in rule.kinds:
        return [f"{where}: {s.name} doesn't fit {kind}"]
    read = int if kind == R.INTEGER else float
    try:
        if rule.param == "none" and s.args:
            return [f"{where}: {s.name} takes no argument"]
        if rule.param == "count" and int(s.args[0]) < 0 or rule.param == "divisor" and int(s.args[0]) < 1:
            return [f"{where}: {s.name}={s.arg} is out of range"]
        if rule.param == "number" or rule.param in ("value", "values") and kind != R.STRING:
            values = [read(x) for x in s.args]
            if not values or rule.param == "values" and len(set(values)) < len(values):
                return [f"{where}: {s.name} needs distinct values"]
        elif rule.param == "values" and (not s.args or len(set(s.args)) < len(s.args)):
            return [f"{where}: {s.name} needs distinct values"]
        if rule.param == "text" and not s.arg:
            return [f"{where}: {s.name} needs an argument"]
    except (ValueError, IndexError):
        return [f"{where}: {s.name}={s.arg} can't be read for {kind}"]
    return []


def error_row(path, rule: str, message, kind: str = "rule", value=None, limit: str | None = None) -> Column:
    """One row of the error array; path: columns or texts."""
    text = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    parts = F.array(*[text(p) for p in path]).cast("array<string>")
    return F.struct(F.lit(kind).alias("kind"), parts.alias("path"), F.lit(rule).alias("rule"), text(message).alias("message"), text(value).alias("value"), text(limit).alias("limit")).cast(ERROR)


def _none() -> Column:
    return F.array().cast(ERRORS)


def when_error(bad: Column, error: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(error)).otherwise(_none())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def stopping(errors: Column) -> Column:
    """A parse error ends the record: the first one is all that is told."""
    first = F.slice(F.filter(errors, lambda e: e["kind"] == "parse"), 1, 1)
    return F.when(F.size(errors) < 2, errors).when(F.exists(errors, lambda e: e["kind"] == "parse"), first).otherwise(errors)


def _is_mod(s: Step, functions: dict[str, Function]) -> bool:
    return functions[s.name].role in ("mod", "try") if s.function else s.name in MODS


def _judged(value: Column, t: T.DataType, s: Step, path, functions: dict[str, Function]) -> Column | None:
    """The errors of a step that isn't a transform."""
    kind = kind_of(t)
    if s.function:
        f = functions[s.name]
        if f.role == "error":
            return let(f.column(value), lambda e: when_error(e.isNotNull(), error_row(path, "custom", F.lit(s.message) if s.message else e, value=R.value_of(value, kind) if kind in R.SHOWN else None)))
        shown = R.value_of(value, kind) if kind in R.SHOWN else F.lit(None)
        message = F.lit(s.message) if s.message else F.concat(F.lit(f'"{s.name}" rejected '), F.coalesce(shown, F.lit("value")))
        return when_error(~F.coalesce(f.column(value), F.lit(True)), error_row(path, "predicate", message, value=shown))
    if s.name not in RULES:
        return None
    if kind in (R.ARRAY, R.MAP):
        value = F.coalesce(value, zero_of(t))  # null has length 0
    ok = RULES[s.name].test(value, kind, s.args)
    return when_error(~ok, error_row(path, s.name, F.coalesce(RULES[s.name].message(value, kind, s.args), F.lit(s.name)), value=R.value_of(value, kind) if kind in R.SHOWN else None, limit=s.arg or None))


def _changed(value: Column, t: T.DataType, s: Step, functions: dict[str, Function]) -> Column:
    """The value after a transform; of a step that may fail, a struct of value and error."""
    if not s.function:
        return F.when(value.isNotNull(), MODS[s.name].apply(value, kind_of(t), s.args)).cast(t)
    out = functions[s.name].column(value)
    if functions[s.name].role == "mod":
        return out.cast(t)
    return F.struct(out["value"].cast(t).alias("value"), F.when(out["error"].isNotNull(), F.lit(s.message) if s.message else out["error"]).alias("error"))


def _scoped(value: Column, t: T.DataType, pipe: Pipe, path, functions: dict[str, Function]) -> Column:
    """struct(v, e) after keys and inner; value is bound already."""
    kind = kind_of(t)
    if pipe.keys and kind == R.MAP:
        key_path = lambda k: [*path, F.concat(k.cast("string"), F.lit(".key"))]
        done = F.transform(F.map_entries(value), lambda e: F.struct(nested(e["key"], t.keyType, pipe.keys, key_path(e["key"]), functions).alias("k"), e["value"].alias("value")))

        def rebuilt(d: Column) -> Column:
            # two keys that become one: the later entry stays
            names, values = F.transform(d, lambda x: x["k"]["v"]), F.transform(d, lambda x: x["value"])
            last = lambda n: F.map_from_arrays(F.array_distinct(n), F.transform(F.array_distinct(n), lambda k: F.element_at(F.filter(d, lambda o: o["k"]["v"] == k), -1)["value"]))
            made = let(names, lambda n: F.when(F.size(F.array_distinct(n)) == F.size(n), F.map_from_arrays(n, values)).otherwise(last(n)))
            return F.struct(made.alias("v"), F.coalesce(F.flatten(F.transform(d, lambda x: x["k"]["e"])), _none()).alias("e"))

        rest = Pipe(inner=pipe.inner)
        return let(let(done, rebuilt), lambda r: let(_scoped(r["v"], t, rest, path, functions), lambda x: F.struct(x["v"].alias("v"), F.concat(r["e"], x["e"]).alias("e"))))
    if pipe.inner and kind == R.ARRAY:
        at = [*path[:-1], F.concat(path[-1], F.lit("[]"))]
        items = F.transform(value, lambda x: nested(x, t.elementType, pipe.inner, at, functions))
        return let(items, lambda r: F.struct(F.transform(r, lambda x: x["v"]).alias("v"), F.coalesce(F.flatten(F.transform(r, lambda x: x["e"])), _none()).alias("e")))
    if pipe.inner and kind == R.MAP:
        value_path = lambda k: [*path, F.concat(k.cast("string"), F.lit(".value"))]
        done = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), nested(e["value"], t.valueType, pipe.inner, value_path(e["key"]), functions).alias("r")))
        return let(
            done,
            lambda d: F.struct(
                F.map_from_entries(F.transform(d, lambda x: F.struct(x["key"], x["r"]["v"]))).alias("v"), F.coalesce(F.flatten(F.transform(d, lambda x: x["r"]["e"])), _none()).alias("e")
            ),
        )
    return F.struct(value.alias("v"), _none().alias("e"))


def nested(value: Column, t: T.DataType, pipe: Pipe, path, functions: dict[str, Function]) -> Column:
    """struct(v, e) of a value inside a container, after steps and scopes; each transform's result is bound once."""
    if pipe.null_zero:
        value = F.coalesce(value, zero_of(t))

    def go(x: Column, steps: list[Step], found: list[Column]) -> Column:
        for i, s in enumerate(steps):
            if _is_mod(s, functions):
                rest = steps[i + 1 :]
                if s.function and functions[s.name].role == "try":
                    failed = lambda y: F.struct(F.lit(None).cast(t).alias("v"), F.concat(*found, F.array(error_row(path, s.name, y["error"], "parse"))).alias("e"))  # noqa: B023, E731
                    return let(_changed(x, t, s, functions), lambda y: F.when(y["error"].isNotNull(), failed(y)).otherwise(go(y["value"], rest, found)))  # noqa: B023
                return let(_changed(x, t, s, functions), lambda y: go(y, rest, found))  # noqa: B023
            errors = _judged(x, t, s, path, functions)
            if errors is not None:
                found = [*found, errors]
        if not pipe.keys and not pipe.inner:
            return F.struct(x.alias("v"), (F.concat(*found) if found else _none()).alias("e"))
        return let(_scoped(x, t, pipe, path, functions), lambda r: F.struct(r["v"].alias("v"), F.concat(*found, r["e"]).alias("e")))

    return let(value, lambda x: go(x, pipe.steps, []))


def _run_columns(df: DataFrame, parsed: dict[str, Pipe], types: dict[str, T.DataType], functions: dict[str, Function]) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """The frame with one column more for each transform, and for each field its value and its errors."""
    at = {name: f"__{i}" for i, name in enumerate(parsed)}
    now: dict[str, Column] = {}
    found: dict[str, list[Column]] = {name: [] for name in parsed}
    failed: dict[str, Column] = {}
    todo = {name: list(pipe.steps) for name, pipe in parsed.items()}
    first = {at[n]: F.coalesce(F.col(f"`{n}`"), zero_of(types[n])) if p.null_zero else F.col(f"`{n}`") for n, p in parsed.items()}
    df = df.withColumns(first)
    now = {n: F.col(at[n]) for n in parsed}
    layer = 0
    while any(todo.values()):
        layer += 1
        made = {}
        for name, steps in todo.items():
            while steps:
                s = steps.pop(0)
                if _is_mod(s, functions):
                    new = f"{at[name]}_{layer}"
                    made[new] = _changed(now[name], types[name], s, functions)
                    now[name] = F.col(new)
                    if s.function and functions[s.name].role == "try":
                        stop = F.col(new)["error"].isNotNull()
                        before = failed.get(name)
                        found[name].append(when_error(stop if before is None else stop & ~before, error_row([F.lit(name)], s.name, F.col(new)["error"], "parse")))
                        failed[name] = stop if before is None else before | stop
                        now[name] = F.col(new)["value"]
                    break
                errors = _judged(now[name], types[name], s, [F.lit(name)], functions)
                if errors is not None:
                    found[name].append(F.when(failed[name], _none()).otherwise(errors) if name in failed else errors)
        if made:
            df = df.withColumns(made)
    scoped = {n: f"{at[n]}_s" for n, p in parsed.items() if p.keys or p.inner}
    if scoped:
        df = df.withColumns({c: _scoped(now[n], types[n], parsed[n], [F.lit(n)], functions) for n, c in scoped.items()})
    for n, c in scoped.items():
        now[n] = F.col(c)["v"]
        found[n].append(F.when(failed[n], _none()).otherwise(F.col(c)["e"]) if n in failed else F.col(c)["e"])
    values = {n: F.when(~failed[n], now[n]) if n in failed else now[n] for n in parsed}
    return df, values, {n: F.concat(*e) if e else _none() for n, e in found.items()}


def apply_pipes(df: DataFrame, pipes: dict[str, str], functions: dict[str, Function] | None = None, errors: str = "all", validate: bool = True) -> DataFrame:
    """Run step lists on typed columns. Adds `errors` (all, or the first) and `valid`; every other column stays.

    A null column counts as absent: `required` fails on it. Columns named `errors` or `valid` are replaced, but errors of the
    error array's own type that stand there (of `decode`) come first.
    """
    functions = functions or {}
    parsed, wrong = {}, []
    for name, text in pipes.items():
        try:
            parsed[name] = parse(text)
            if name not in df.columns:
                wrong.append(f"{name}: no such column")
            else:
                wrong += check(parsed[name], df.schema[name].dataType, name, functions)
        except StepError as e:
            wrong.append(f"{name}: {e}")
    if wrong:
        raise StepError("\n".join(wrong))
    columns, types = df.columns, {n: df.schema[n].dataType for n in parsed}
    if not validate:
        parsed = {}
    missing = [when_error(F.col(f"`{n}`").isNull(), error_row([F.lit(n)], "required", R.REQUIRED_MESSAGE)) for n, p in parsed.items() if p.required]
    before = [F.col("errors")] if "errors" in columns and "errors" not in parsed and df.schema["errors"].dataType.simpleString() == ERRORS else []
    out, values, found = _run_columns(df, parsed, types, functions)
    every = [*before, *found.values(), *missing]
    out = out.withColumn("__errors", F.concat(*every) if every else _none())
    told = stopping(F.col("__errors")) if any(f.role == "try" for f in functions.values()) or before else F.col("__errors")
    kept = [values.get(c, F.col(f"`{c}`")).alias(c) for c in columns if c not in ("errors", "valid")]
    out = out.select(*kept, (F.slice(told, 1, 1) if errors == "first" else told).alias("errors"))
    return out.withColumn("valid", F.size("errors") == 0)


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the error columns, rows for the dead letters)."""
    return df.where("valid").drop("errors", "valid"), df.where(~F.col("valid"))


def error_text(errors: Column) -> Column:
    """`a.b: message` joined by `; `."""
    return F.array_join(F.transform(errors, lambda e: F.concat(F.concat_ws(".", e["path"]), F.lit(": "), e["message"])), "; ")
