"""From syntax tree to Spark column.

Evaluation of the language is eager and error-absorbing: one failing part rejects the
row, even under OR or NOT. So each node becomes a value and an error flag. What is
known when compiling (the kind of a literal, that nothing can fail) is folded then, and
plain Python booleans stand for constant flags.

A filter's names are looked up in a source: a VARIANT column (JSON text parsed once), or
a struct of typed columns, for which comparisons stay native, and those that a scan
can use are pushed down.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .interpreter import found, nearest, re2_pattern
from .syntax import Call, ListOf, Literal, Name, Node, Op, Param, Quantified, Star

Flag = Column | bool


def _and(*flags: Flag) -> Flag:
    if any(f is False for f in flags):
        return False
    left = [f for f in flags if f is not True]
    return reduce(lambda a, b: a & b, left) if left else True


def _or(*flags: Flag) -> Flag:
    if any(f is True for f in flags):
        return True
    left = [f for f in flags if f is not False]
    return reduce(lambda a, b: a | b, left) if left else False


def _not(flag: Flag) -> Flag:
    return not flag if isinstance(flag, bool) else ~flag


def _column(flag: Flag) -> Column:
    return F.lit(flag) if isinstance(flag, bool) else flag


# --- values ---------------------------------------------------------------------


class Value:
    """Something with a kind (nil, num, str, bool, arr, obj), known now or only per row."""

    def is_(self, kind: str) -> Flag:
        raise NotImplementedError

    def num(self) -> Column: ...
    def str(self) -> Column: ...
    def bool(self) -> Column: ...
    def items(self) -> tuple[Column, Callable[[Column], Value]] | list[Value]: ...
    def step(self, name: str) -> tuple[Flag, Value]: ...
    def text(self) -> Column: ...


@dataclass
class Known(Value):
    """A literal, or a computed column of a certain kind."""

    kind: str
    column: Column | None = None
    values: list[Value] | None = None
    literal: object = None

    def is_(self, kind: str) -> Flag:
        return self.kind == kind

    def num(self) -> Column:
        return self.column

    str = bool = num

    def items(self):
        return self.values

    def step(self, name: str):
        return (True, Known("num", F.lit(float(len(self.values))))) if self.kind == "arr" and name == "length" else (False, Known("nil"))


class Variant(Value):
    """A VARIANT column; NULL and JSON null are nil."""

    def __init__(self, column: Column) -> None:
        self.column = column
        self.schema = F.schema_of_variant(column)

    def is_(self, kind: str) -> Flag:
        s = self.schema
        if kind == "nil":
            return F.coalesce(s == "VOID", F.lit(True))
        if kind == "num":
            found = s.isin("BIGINT", "DOUBLE", "FLOAT") | s.startswith("DECIMAL")
        elif kind in ("str", "bool"):
            found = s == {"str": "STRING", "bool": "BOOLEAN"}[kind]
        else:
            found = s.startswith({"arr": "ARRAY", "obj": "OBJECT"}[kind])
        return F.coalesce(found, F.lit(False))

    def num(self) -> Column:
        return F.try_variant_get(self.column, "$", "double")

    def str(self) -> Column:
        return F.try_variant_get(self.column, "$", "string")

    def bool(self) -> Column:
        return F.try_variant_get(self.column, "$", "boolean")

    def items(self):
        return F.try_variant_get(self.column, "$", "array<variant>"), Variant

    def step(self, name: str):
        inner = F.try_variant_get(self.column, f"$.{name}", "variant")
        array = F.try_variant_get(self.column, "$", "array<variant>")
        if name != "length":
            return _and(self.is_("obj"), inner.isNotNull()), Variant(inner)
        length = F.when(self.is_("arr"), F.to_variant_object(F.array(F.size(array).cast("double")))).otherwise(F.lit(None))
        value = F.when(self.is_("arr"), F.try_variant_get(length, "$[0]", "variant")).otherwise(inner)
        return _or(self.is_("arr"), _and(self.is_("obj"), inner.isNotNull())), Variant(value)

    def text(self) -> Column:
        # 1 and 1.0 are one number: both print as 1
        return F.regexp_replace(F.to_json(self.column), r"(?<=[\[:,])(-?\d+)\.0(?=[,\]}])", "$1")


class Native(Value):
    """A typed column; NULL is nil, and as a struct's field it is absent."""

    KINDS = {T.StringType: "str", T.BooleanType: "bool", T.ArrayType: "arr", T.StructType: "obj"}

    def __init__(self, column: Column, dtype: T.DataType) -> None:
        self.column, self.dtype = column, dtype
        self.kind = "num" if isinstance(dtype, T.NumericType) else self.KINDS.get(type(dtype), "other")

    def is_(self, kind: str) -> Flag:
        if kind == "nil":
            return self.column.isNull()
        return self.column.isNotNull() if kind == self.kind else False

    def num(self) -> Column:
        return self.column.cast("double")

    def str(self) -> Column:
        return self.column

    bool = str

    def items(self):
        return self.column, lambda c: Native(c, self.dtype.elementType)

    def step(self, name: str):
        if self.kind == "arr" and name == "length":
            return self.column.isNotNull(), Known("num", F.size(self.column).cast("double"))
        if self.kind == "obj" and name in self.dtype.fieldNames():
            inner = self.column.getField(name)
            return inner.isNotNull(), Native(inner, self.dtype[name].dataType)
        return False, Known("nil")

    def text(self) -> Column:
        return F.regexp_replace(F.to_json(self.column), r"(?<=[\[:,])(-?\d+)\.0(?=[,\]}])", "$1")


class VariantSource:
    """Names are fields of a VARIANT column."""

    def __init__(self, column: Column) -> None:
        self.root = Variant(column)

    def name(self, name: str) -> tuple[Flag, Flag, Value]:
        """(whether names can be looked up, whether this one is there, its value)"""
        inner = F.try_variant_get(self.root.column, f"$.{name}", "variant")
        return self.root.is_("obj"), _and(self.root.is_("obj"), inner.isNotNull()), Variant(inner)


class NativeSource:
    """Names are columns of a table; pairs of metadata name and column."""

    def __init__(self, schema: T.StructType) -> None:
        self.fields = {f.name: f.dataType for f in schema.fields}

    def name(self, name: str) -> tuple[Flag, Flag, Value]:
        if name not in self.fields:
            return True, False, Known("nil")
        column = F.col(f"`{name}`")
        return True, column.isNotNull(), Native(column, self.fields[name])


class _ItemSource:
    """Names are fields of an array's element."""

    def __init__(self, item: Value) -> None:
        self.item = item

    def name(self, name: str) -> tuple[Flag, Flag, Value]:
        if isinstance(self.item, Variant):
            return VariantSource(self.item.column).name(name)
        if isinstance(self.item, Native) and self.item.kind == "obj":
            present, value = self.item.step(name)
            return self.item.column.isNotNull(), present, value
        return False, False, Known("nil")


# --- operators ---------------------------------------------------------------------


def _equal(a: Value, b: Value) -> Flag:
    flags = [_and(a.is_("nil"), b.is_("nil"))]
    for kind in ("num", "str", "bool"):
        both = _and(a.is_(kind), b.is_(kind))
        if both is not False:
            flags.append(_and(both, F.coalesce(getattr(a, kind)() == getattr(b, kind)(), F.lit(False))))
    if isinstance(b, Known) and b.values is not None:
        a, b = b, a
    if isinstance(a, Known) and a.values is not None:
        if isinstance(b, Known):
            flags.append(b.values is not None and len(a.values) == len(b.values) and _and(True, *map(_equal, a.values, b.values)))
        elif b.is_("arr") is not False:
            array, wrap = b.items()
            each = [_equal(v, wrap(F.get(array, F.lit(i)))) for i, v in enumerate(a.values)]
            flags.append(_and(b.is_("arr"), F.coalesce(F.size(array) == len(a.values), F.lit(False)), *each))
    elif not isinstance(a, Known) and not isinstance(b, Known):
        for kind in ("arr", "obj"):
            both = _and(a.is_(kind), b.is_(kind))
            if both is not False:
                flags.append(_and(both, F.coalesce(a.text() == b.text(), F.lit(False))))
    return _or(*flags)


def _member(a: Value, b: Value) -> Flag:
    if isinstance(b, Known):
        if b.values and not isinstance(a, Known) and all(isinstance(v, Known) and v.kind in ("num", "str") for v in b.values):
            found = []
            for kind in ("num", "str"):
                wanted = [v.literal for v in b.values if v.kind == kind]
                if wanted and a.is_(kind) is not False:
                    found.append(_and(a.is_(kind), F.coalesce(getattr(a, kind)().isin(wanted), F.lit(False))))
            return _or(*found)
        return _or(*(_equal(a, v) for v in b.values or []))
    array, wrap = b.items()
    return F.coalesce(F.exists(array, lambda x: _column(_equal(a, wrap(x)))), F.lit(False))


def java_pattern(pattern: str) -> str | None:
    """An RE2 pattern in Java's dialect; None if RE2 has no such pattern."""
    named = re.sub(r"\[:(\^?)(\w+):\]", lambda m: rf"\{'P' if m[1] else 'p'}{{{'XDigit' if m[2] == 'xdigit' else m[2].capitalize()}}}", pattern)
    java = re2_pattern(named, r"\z", nested=True)
    if java is None:
        return None
    java = "(?d)" + java
    session = SparkSession.getActiveSession()
    try:
        session._jvm.java.util.regex.Pattern.compile(java)
    except Exception:  # noqa: BLE001 - py4j wraps PatternSyntaxException
        return None
    return java


def _searched(texts: pd.Series, patterns: pd.Series) -> pd.Series:
    out = []
    for text, pattern in zip(texts, patterns):
        try:
            out.append(None if text is None or pattern is None else found(pattern, text))
        except re.error:
            out.append(None)
    return pd.Series(out, dtype="object")


class _Compiler:
    def __init__(self, source, quirks: bool) -> None:
        self.source, self.quirks = source, quirks

    def on(self, item: Value) -> _Compiler:
        return _Compiler(_ItemSource(item), self.quirks)

    def __call__(self, node: Node) -> tuple[Flag, Value]:
        """(error, value)"""
        match node:
            case Literal(None):
                return False, Known("nil")
            case Literal(value):
                kind = "bool" if isinstance(value, bool) else "str" if isinstance(value, str) else "num"
                return False, Known(kind, F.lit(value), literal=value)
            case ListOf(items):
                parts = [self(i) for i in items]
                return _or(False, *(e for e, _ in parts)), Known("arr", values=[v for _, v in parts])
            case Name(name):
                able, _, value = self.source.name(name)
                return _not(able), value
            case Param(name):
                _, present, value = self.source.name(name)
                return _not(present), value
            case Star(array):
                return self(array)
            case Op(".", left, Name(step)):
                error, base = self(left)
                present, value = base.step(step)
                return _or(error, _not(present)), value
            case Op("NOT", _, right):
                error, value = self(right)
                return self.truth(error, value, lambda b: _not(b))
            case Op(op, left, right):
                return self.binary(op, self(left), self(right), right)
            case Call("EXISTS", (inner,)):
                if isinstance(inner, Name) and not self.quirks:
                    return False, self.flag(self.source.name(inner.name)[1])
                return False, self.flag(_not(self(inner)[0]))
            case Call("DOES_NOT_EXIST", (Name(name),)):
                able, present, _ = self.source.name(name)
                return False, self.flag(_and(able, _not(present)))
            case Call("DOES_NOT_EXIST", (inner,)) if not self.quirks:
                able = self.source.name("_")[0]
                return False, self.flag(_and(able, self(inner)[0]))
            case Call("LENGTH", (inner,)):
                return self.length(*self(inner))
            case Quantified():
                return self.quantified(node)
        return True, Known("nil")

    @staticmethod
    def flag(value: Flag) -> Known:
        return Known("bool", _column(value), literal=value if isinstance(value, bool) else None)

    @staticmethod
    def bool_of(value: Value) -> Flag:
        if isinstance(value, Known):
            return value.literal if isinstance(value.literal, bool) else value.column if value.kind == "bool" else False
        return F.coalesce(value.bool(), F.lit(False)) if value.is_("bool") is not False else False

    def truth(self, error: Flag, value: Value, then: Callable[[Flag], Flag]) -> tuple[Flag, Value]:
        return _or(error, _not(value.is_("bool"))), self.flag(then(self.bool_of(value)))

    def binary(self, op: str, a_: tuple[Flag, Value], b_: tuple[Flag, Value], right: Node) -> tuple[Flag, Value]:
        (ea, a), (eb, b) = a_, b_
        error = _or(ea, eb)
        if op in ("==", "!="):
            same = _equal(a, b)
            return error, self.flag(same if op == "==" else _not(same))
        if op in ("AND", "OR"):
            x, y, is_a, is_b = self.bool_of(a), self.bool_of(b), a.is_("bool"), b.is_("bool")
            if op == "AND":
                return _or(error, _not(is_a), _not(is_b)), self.flag(_and(x, y))
            return _or(error, _not(is_a), _and(_not(x), _not(is_b))), self.flag(_or(x, y))
        if op in (">", ">=", "<", "<="):
            options = []
            for kind in ("num", "str"):
                both = _and(a.is_(kind), b.is_(kind))
                if both is not False:
                    x, y = getattr(a, kind)(), getattr(b, kind)()
                    options.append((both, {">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[op]))
            able = _or(False, *(o for o, _ in options))
            return _or(error, _not(able)), self.flag(_or(False, *(_and(o, F.coalesce(v, F.lit(False))) for o, v in options)))
        if op in ("IN", "NOT_IN"):
            is_list = b.is_("arr")
            found = _member(a, b) if is_list is not False else False
            return _or(error, _not(is_list)), self.flag(found if op == "IN" else _not(found))
        if op in ("CONTAINS", "STARTS_WITH", "ENDS_WITH", "MATCHES"):
            able = _and(a.is_("str"), b.is_("str"))
            if able is False:
                return True, Known("nil")
            if op == "MATCHES":
                if isinstance(right, Literal):
                    pattern = java_pattern(right.value)
                    if pattern is None:
                        return True, Known("nil")
                    found = a.str().rlike(pattern)
                else:
                    found = F.pandas_udf(_searched, "boolean")(a.str(), b.str())
                    able = _and(able, found.isNotNull())
            else:
                found = {"CONTAINS": F.contains, "STARTS_WITH": F.startswith, "ENDS_WITH": F.endswith}[op](a.str(), b.str())
            return _or(error, _not(able)), self.flag(_and(able, F.coalesce(found, F.lit(False))))
        if op == "[]":
            able = _and(a.is_("arr"), b.is_("num"))
            if able is False or isinstance(a, Known):
                return True, Known("nil")
            array, wrap = a.items()
            if isinstance(right, Literal):
                at = F.lit(min(nearest(right.value), 2**31 - 1) if right.value >= -0.5 else -1)
            else:
                x = b.num()
                at = F.when(F.abs(x) < 2**30, F.floor(F.abs(x) + 0.5) * F.signum(x)).otherwise(F.lit(-1.0)).cast("int")
            return _or(error, _not(able)), wrap(F.get(array, at))
        return True, Known("nil")

    def length(self, error: Flag, value: Value) -> tuple[Flag, Value]:
        if isinstance(value, Known):
            if value.kind == "str":
                return error, Known("num", F.octet_length(value.str()).cast("double"))
            return (error, Known("num", F.lit(float(len(value.values))))) if value.values is not None else (True, Known("nil"))
        sizes = []
        if value.is_("str") is not False:
            sizes.append((value.is_("str"), F.octet_length(value.str())))
        if value.is_("arr") is not False:
            sizes.append((value.is_("arr"), F.size(value.items()[0])))
        if value.is_("obj") is not False:
            if isinstance(value, Variant):
                sizes.append((value.is_("obj"), F.size(F.map_keys(F.try_variant_get(value.column, "$", "map<string,variant>")))))
            else:
                sizes.append((value.is_("obj"), sum((F.when(value.column.getField(n).isNotNull(), 1).otherwise(0) for n in value.dtype.fieldNames()), F.lit(0))))
        able = _or(False, *(s for s, _ in sizes))
        column = F.coalesce(*(F.when(s, n) for s, n in sizes)).cast("double") if sizes else F.lit(None).cast("double")
        return _or(error, _not(able)), Known("num", F.coalesce(column, F.lit(0.0)))

    def quantified(self, node: Quantified) -> tuple[Flag, Value]:
        """Elements in turn, until one decides; errors behind that one are never met."""
        error, array = self(node.array)
        is_any = node.name == "ANY"
        if isinstance(array, Known) or array.is_("arr") is False:
            return True, Known("nil")
        items, wrap = array.items()

        def step(state: Column, x: Column) -> Column:
            failed, value = self.on(wrap(x))(node.condition)
            met = _and(value.is_("bool"), self.bool_of(value) if is_any else _not(self.bool_of(value)))
            return (
                F.when(state["done"], state)
                .when(_column(failed), F.struct(F.lit(True).alias("done"), F.lit(False).alias("met"), F.lit(True).alias("failed")))
                .otherwise(F.struct(_column(met).alias("done"), _column(met).alias("met"), F.lit(False).alias("failed")))
            )

        start = F.struct(F.lit(False).alias("done"), F.lit(False).alias("met"), F.lit(False).alias("failed"))
        result = F.aggregate(F.coalesce(items, F.array().cast("array<variant>") if isinstance(array, Variant) else F.array().cast(array.dtype)), start, step)
        met = result["met"]
        return _or(error, _not(array.is_("arr")), result["failed"]), self.flag(met if is_any else ~met)


def _implied(node: Node, source) -> list[Column]:
    """Plain predicates that every row passing the filter fulfils, for the scan to use."""
    match node:
        case Op("AND", left, right):
            return _implied(left, source) + _implied(right, source)
        case Op("==" | ">" | ">=" | "<" | "<=" as op, Name(name), Literal(value)) if name in source.fields and value is not None:
            native = Native(F.col(f"`{name}`"), source.fields[name])
            same = native.kind == ("bool" if isinstance(value, bool) else "str" if isinstance(value, str) else "num")
            if not same or (native.kind == "bool" and op != "==") or isinstance(source.fields[name], (T.DecimalType, T.FloatType)):
                return []
            if isinstance(source.fields[name], T.IntegralType):
                if value != int(value) or abs(value) >= 2**31:
                    return []
                value = int(value)
            c = native.column
            return [{"==": c == value, ">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}[op]]
        case Op("IN", Name(name), ListOf(items)) if name in source.fields and isinstance(source.fields[name], T.StringType):
            return [F.col(f"`{name}`").isin([i.value for i in items if isinstance(i.value, str)])]
    return []


def compile_filter(node: Node, source: VariantSource | NativeSource, quirks: bool = False) -> Column:
    """A boolean column, for filter(): whether the row passes."""
    error, value = _Compiler(source, quirks)(node)
    passed = _and(value.is_("bool"), _Compiler.bool_of(value), _not(error))
    if isinstance(source, VariantSource):
        passed = _and(source.root.column.isNotNull(), passed)  # what isn't JSON passes nothing
    column = F.coalesce(_column(passed), F.lit(False))
    if isinstance(source, NativeSource):
        for predicate in _implied(node, source):
            column = predicate & column  # NULL where a column is: such a row doesn't pass either way
    return column
