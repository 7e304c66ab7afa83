"""Typed scalar expressions: a Spark column with its type under the strict rules.

Every builder checks its operands and raises a CompileError before Spark sees anything;
the columns are Catalyst's own expressions, without Python UDFs.
"""

from __future__ import annotations

import datetime
import decimal as dec
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .. import types as T
from ..diagnostics import Code, fail
from ..types import Category, Type


@dataclass(frozen=True, eq=False)
class Expr:
    type: Type
    column: Column

    def alias(self, name: str) -> Column:
        return self.column.alias(name)

    # Python's operators are the expressions of the same sign.
    def __add__(self, other):
        return add(self, other)

    def __radd__(self, other):
        return add(other, self)

    def __sub__(self, other):
        return subtract(self, other)

    def __mul__(self, other):
        return multiply(self, other)

    def __rmul__(self, other):
        return multiply(other, self)

    def __truediv__(self, other):
        return divide(self, other)

    def __mod__(self, other):
        return remainder(self, other)

    def __neg__(self):
        return negate(self)

    def __pos__(self):
        return plus(self)

    def __and__(self, other):
        return and_(self, other)

    def __or__(self, other):
        return or_(self, other)

    def __invert__(self):
        return not_(self)

    def __eq__(self, other):
        return compare("=", self, other)

    def __ne__(self, other):
        return compare("<>", self, other)

    def __lt__(self, other):
        return compare("<", self, other)

    def __le__(self, other):
        return compare("<=", self, other)

    def __gt__(self, other):
        return compare(">", self, other)

    def __ge__(self, other):
        return compare(">=", self, other)

    __hash__ = object.__hash__


def expr(x: Any) -> Expr:
    return x if isinstance(x, Expr) else literal(x)


def _literal_type(value: Any) -> Type:
    if value is None:
        return T.UNKNOWN
    if isinstance(value, bool):
        return T.BOOLEAN
    if isinstance(value, int):
        return T.INT4 if -(1 << 31) <= value < 1 << 31 else T.INT8
    if isinstance(value, float):
        return T.FLOAT8
    if isinstance(value, dec.Decimal):
        _, digits, exponent = value.as_tuple()
        scale = max(0, -int(exponent))
        return T.decimal(max(len(digits), scale), scale)
    if isinstance(value, str):
        return T.character(len(value))
    if isinstance(value, (bytes, bytearray)):
        return T.octet(len(value))
    if isinstance(value, datetime.datetime):
        return T.time_point(value.tzinfo is not None)
    if isinstance(value, datetime.date):
        return T.DATE
    if isinstance(value, datetime.time):
        return T.time_of_day(value.tzinfo is not None)
    if isinstance(value, datetime.timedelta):
        return T.INTERVAL
    raise fail(Code.UNSUPPORTED_TYPE, f"literals of {type(value).__name__} are not supported")


def literal(value: Any, type: Type | None = None) -> Expr:  # noqa: A002
    """A literal, of its natural type or one that this can be assigned to. Arrays, records and extensions have no literals."""
    own = _literal_type(value)
    if type is None:
        return Expr(own, F.lit(value) if value is not None else F.lit(None))
    if type.category in (Category.COLLECTION, Category.STRUCTURE, Category.EXTERNAL, Category.UNIQUE):
        raise fail(Code.UNSUPPORTED_TYPE, f"{type} has no literals")
    if type.kind == "bit":
        if not isinstance(value, str) or set(value) - {"0", "1"}:
            raise fail(Code.INCONSISTENT_TYPE, f"{value!r} is not a bit string")
    elif not T.assignable(own, type):
        raise fail(Code.INCONSISTENT_TYPE, f"a literal of {own} can't be of {type}")
    return Expr(type, F.lit(value).cast(T.to_spark(type)))


def interval(days: int = 0, hours: int = 0, minutes: int = 0, seconds: float = 0.0) -> Expr:
    return literal(datetime.timedelta(days=days, hours=hours, minutes=minutes, seconds=seconds))


def months(n: int) -> Expr:
    """An interval of whole months."""
    return Expr(T.INTERVAL, F.make_ym_interval(F.lit(0), F.lit(n)))


def _need(e: Expr, ok: bool, what: str) -> None:
    if not ok and not T.is_unresolved(e.type):
        raise fail(Code.INCONSISTENT_TYPE, f"{what}, not {e.type}")


def _to(e: Expr, t: Type) -> Column:
    """The column, cast where its Spark type isn't that of `t`."""
    if e.type == t or e.type.kind == t.kind and t.kind not in ("decimal",):
        return e.column
    return e.column.cast(T.to_spark(t))


def plus(x: Any) -> Expr:
    e = expr(x)
    if e.type.category is Category.DATETIME_INTERVAL:
        return e
    t = T.unary_numeric(e.type)
    _need(e, t != T.ERROR, "+ needs a number or an interval")
    return Expr(t, F.positive(_to(e, t)))


def negate(x: Any) -> Expr:
    e = expr(x)
    t = e.type if e.type.category is Category.DATETIME_INTERVAL else T.unary_numeric(e.type)
    _need(e, t != T.ERROR, "- needs a number or an interval")
    return Expr(t, F.negative(_to(e, t)))


def length(x: Any) -> Expr:
    e = expr(x)
    _need(e, e.type.category in (Category.CHARACTER_STRING, Category.OCTET_STRING, Category.BIT_STRING, Category.UNKNOWN), "length needs a string")
    return Expr(T.INT4, F.length(e.column.cast("string") if e.type.kind == "unknown" else e.column))


def _boolean(x: Any, what: str) -> Column:
    e = expr(x)
    _need(e, e.type.category in (Category.BOOLEAN, Category.UNKNOWN), f"{what} needs a boolean")
    return e.column.cast("boolean") if e.type.kind == "unknown" else e.column


def not_(x: Any) -> Expr:
    return Expr(T.BOOLEAN, ~_boolean(x, "NOT"))


def and_(x: Any, y: Any) -> Expr:
    return Expr(T.BOOLEAN, _boolean(x, "AND") & _boolean(y, "AND"))


def or_(x: Any, y: Any) -> Expr:
    return Expr(T.BOOLEAN, _boolean(x, "OR") | _boolean(y, "OR"))


def is_null(x: Any) -> Expr:
    e = expr(x)
    _need(e, e.type.category not in (Category.COLLECTION, Category.STRUCTURE, Category.UNIQUE, Category.EXTERNAL), "IS NULL needs a simple type")
    return Expr(T.BOOLEAN, e.column.isNull())


def is_true(x: Any) -> Expr:
    return Expr(T.BOOLEAN, F.coalesce(_boolean(x, "IS TRUE"), F.lit(False)))


def is_false(x: Any) -> Expr:
    return Expr(T.BOOLEAN, F.coalesce(~_boolean(x, "IS FALSE"), F.lit(False)))


def is_unknown(x: Any) -> Expr:
    return Expr(T.BOOLEAN, _boolean(x, "IS UNKNOWN").isNull())


def _shift(t: Expr, i: Expr, sign: int) -> Expr:
    """Temporal plus or minus interval: of the temporal's type, also where Spark would make it a timestamp."""
    if t.type.kind == "time_of_day":  # around the clock; Spark's own functions of TIME are switched off by default
        at = F.concat(F.lit("1970-01-02 "), t.column.cast("string")).cast("timestamp_ntz")
        return Expr(t.type, F.date_format(at + i.column if sign > 0 else at - i.column, "HH:mm:ss.SSSSSS").cast("time(6)"))
    moved = t.column + i.column if sign > 0 else t.column - i.column
    return Expr(t.type, moved.cast("date") if t.type.kind == "date" else moved)


def _interval_micros(c: Column) -> Column:
    return (c.cast("interval day to second").cast("decimal(38,6)") * 1_000_000).cast("long")


def _is(e: Expr, category: Category) -> bool:
    return e.type.category is category


def _additive(x: Expr, y: Expr, sign: str) -> Expr:
    if _is(x, Category.DATETIME_INTERVAL) and _is(y, Category.DATETIME_INTERVAL):
        return Expr(T.INTERVAL, x.column + y.column if sign == "+" else x.column - y.column)
    t = T.binary_numeric(x.type, y.type)
    if t == T.ERROR:
        raise fail(Code.INCONSISTENT_TYPE, f"{sign} can't take {x.type} and {y.type}")
    if t.kind == "decimal":
        scales = [T._as_decimal(e.type).scale for e in (x, y) if e.type.kind != "unknown"]
        t = T.decimal(None, None if None in scales else max(scales))
    a, b = _to(x, t), _to(y, t)
    out = a + b if sign == "+" else a - b
    return Expr(t, out.cast(T.to_spark(t)) if t.kind == "decimal" else out)


def add(x: Any, y: Any) -> Expr:
    x, y = expr(x), expr(y)
    if _is(x, Category.TEMPORAL) and _is(y, Category.DATETIME_INTERVAL):
        return _shift(x, y, 1)
    if _is(x, Category.DATETIME_INTERVAL) and _is(y, Category.TEMPORAL):
        return _shift(y, x, 1)
    return _additive(x, y, "+")


def subtract(x: Any, y: Any) -> Expr:
    """An interval minus a temporal, and a temporal minus a temporal, are rejected."""
    x, y = expr(x), expr(y)
    if _is(x, Category.TEMPORAL) and _is(y, Category.DATETIME_INTERVAL):
        return _shift(x, y, -1)
    return _additive(x, y, "-")


def _multiplicative(x: Expr, y: Expr, sign: str) -> tuple[Type, Column, Column]:
    t = T.binary_numeric(x.type, y.type)
    if t == T.ERROR:
        raise fail(Code.INCONSISTENT_TYPE, f"{sign} can't take {x.type} and {y.type}")
    if t.kind == "decimal":  # of any precision and scale: Spark's own rules keep the digits
        return T.decimal(), *(e.column if e.type.kind == "decimal" else e.column.cast(T.to_spark(T._as_decimal(e.type))) for e in (x, y))
    return t, _to(x, t), _to(y, t)


def multiply(x: Any, y: Any) -> Expr:
    x, y = expr(x), expr(y)
    for a, b in ((x, y), (y, x)):
        if _is(a, Category.DATETIME_INTERVAL) and b.type.category in (Category.NUMBER, Category.UNKNOWN):
            return Expr(T.INTERVAL, a.column * (b.column.cast("int") if b.type.kind == "unknown" else b.column))
    t, a, b = _multiplicative(x, y, "*")
    return Expr(t, a * b)


def divide(x: Any, y: Any) -> Expr:
    """Integers give integers, cut towards zero."""
    x, y = expr(x), expr(y)
    if _is(x, Category.DATETIME_INTERVAL) and y.type.category in (Category.NUMBER, Category.UNKNOWN):
        return Expr(T.INTERVAL, x.column / (y.column.cast("int") if y.type.kind == "unknown" else y.column))
    t, a, b = _multiplicative(x, y, "/")
    if t.kind in ("int4", "int8"):
        return Expr(t, F.call_function("div", a, b).cast(T.to_spark(t)))
    out = a / b
    return Expr(t, out.cast("float") if t.kind == "float4" else out)


def remainder(x: Any, y: Any) -> Expr:
    """The sign is the dividend's. An interval modulo a number counts in microseconds."""
    x, y = expr(x), expr(y)
    if _is(x, Category.DATETIME_INTERVAL) and y.type.category is Category.NUMBER:
        left = _interval_micros(x.column) % (y.column.cast("decimal(38,6)") * 1_000_000).cast("long")
        return Expr(T.INTERVAL, F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), left.cast("decimal(18,6)") / F.lit(dec.Decimal(1_000_000))))
    t, a, b = _multiplicative(x, y, "%")
    return Expr(t, a % b)


def concat(x: Any, y: Any) -> Expr:
    x, y = expr(x), expr(y)
    t = T.concatenated(x.type, y.type)
    if t == T.ERROR and not T.is_unresolved(x.type, y.type):
        raise fail(Code.INCONSISTENT_TYPE, f"|| can't take {x.type} and {y.type}")
    spark = T.to_spark(t)
    return Expr(t, F.concat(*(e.column.cast(spark) if e.type.kind == "unknown" else e.column for e in (x, y))))


#: Comparison operators with their negations.
NEGATED = {"=": "<>", "<>": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def comparison_type(op: str, a: Type, b: Type) -> Type:
    """The common type in which two values are compared; equality and order ask for more or less of it."""
    t = T.unify(a, b)
    if t == T.ERROR and not T.is_unresolved(a, b):
        raise fail(Code.INCONSISTENT_TYPE, f"{a} and {b} can't be compared")
    ok = t.equality_comparable if op in ("=", "<>") else t.order_comparable or t.kind == "unknown"
    if not ok and not T.is_unresolved(a, b):
        raise fail(Code.INCONSISTENT_TYPE, f"{t} can't be compared with {op}")
    return t


def compare(op: str, x: Any, y: Any) -> Expr:
    x, y = expr(x), expr(y)
    t = comparison_type(op, x.type, y.type)
    a, b = x.column, y.column
    if t.kind == "decimal" and t.scale is None:
        pass  # Spark widens both to hold all digits
    elif t.category is Category.NUMBER:
        a, b = _to(x, t), _to(y, t)
    return Expr(T.BOOLEAN, _COMPARE[op](a, b))


def like(x: Any, pattern: Any, escape: str | None = None) -> Expr:
    """LIKE. For a literal pattern with a fixed beginning a range on that beginning is added, which reaches the scan."""
    x, pattern_ = expr(x), expr(pattern)
    for e in (x, pattern_):
        _need(e, e.type.category in (Category.CHARACTER_STRING, Category.UNKNOWN), "LIKE needs character strings")
    if escape is not None and len(escape) != 1:
        raise fail(Code.INCONSISTENT_ELEMENTS, "ESCAPE must be one character")
    mark = escape if escape is not None else "\\"
    text = x.column.cast("string")
    found = F.like(text, pattern_.column.cast("string"), F.lit(mark))
    if isinstance(pattern, str):
        found = F.like(text, F.lit(_plain_pattern(pattern, mark)), F.lit("\\"))
        prefix, exact = like_prefix(pattern, mark)
        if exact:
            return Expr(T.BOOLEAN, text == F.lit(prefix))
        if prefix:
            return Expr(T.BOOLEAN, text.startswith(prefix) & found)
    return Expr(T.BOOLEAN, found)


def _plain_pattern(pattern: str, escape: str) -> str:
    """A pattern with the backslash as its escape, before special characters alone: Spark takes no other."""
    out, chars = [], iter(pattern)
    for c in chars:
        if c == escape:
            c = next(chars, None)
            if c is None:
                raise fail(Code.INCONSISTENT_ELEMENTS, "a pattern can't end with the escape character")
            out.append("\\" + c if c in "%_\\" else c)
        else:
            out.append("\\\\" if c == "\\" else c)
    return "".join(out)


def like_prefix(pattern: str, escape: str) -> tuple[str, bool]:
    """What every match begins with, and whether that is all of it."""
    out, chars = [], iter(pattern)
    for c in chars:
        if c == escape:
            c = next(chars, None)
            if c is None:
                raise fail(Code.INCONSISTENT_ELEMENTS, "a pattern can't end with the escape character")
        elif c in "%_":
            return "".join(out), False
        out.append(c)
    return "".join(out), True


def _unified(values: list[Expr], what: str) -> tuple[Type, list[Column]]:
    t = T.unify_all([e.type for e in values])
    if t == T.ERROR:
        raise fail(Code.INCONSISTENT_TYPE, f"{what} can't mix " + ", ".join(str(e.type) for e in values))
    if t.kind == "unknown":
        return t, [e.column for e in values]
    if t.kind == "decimal" and t.scale is None:  # unspecified: wide enough for all of them
        own = [T._as_decimal(e.type) for e in values if e.type.kind != "unknown"]
        scale = max(10 if d.scale is None else d.scale for d in own)
        spark = S.DecimalType(38, scale)
    else:
        spark = T.to_spark(t)
    return t, [e.column if e.type == t or e.type.kind == t.kind and t.kind != "decimal" else e.column.cast(spark) for e in values]


def conditional(*branches: tuple[Any, Any], default: Any = None) -> Expr:
    """CASE WHEN condition THEN value ... ELSE default."""
    if not branches:
        raise fail(Code.INCONSISTENT_ELEMENTS, "CASE needs a branch")
    t, bodies = _unified([*(expr(v) for _, v in branches), expr(default)], "CASE")
    out = F
    for (condition, _), body in zip(branches, bodies, strict=False):
        out = out.when(_boolean(condition, "CASE"), body)
    return Expr(t, out.otherwise(bodies[-1]))


def coalesce(*values: Any) -> Expr:
    if not values:
        raise fail(Code.INCONSISTENT_ELEMENTS, "COALESCE needs a value")
    t, columns = _unified([expr(v) for v in values], "COALESCE")
    return Expr(t, F.coalesce(*columns))


def cast(x: Any, t: Type) -> Expr:
    """CAST under the strict rules; what fails at run time is an error, as ANSI has it."""
    e = expr(x)
    if not T.castable(e.type, t):
        raise fail(Code.INCONSISTENT_TYPE, f"{e.type} can't be cast to {t}")
    column = e.column.cast(T.to_spark(t))
    if t.kind == "character" and t.length is not None:
        column = F.substring(column, 1, t.length)
        column = column if t.varying else F.rpad(column, t.length, " ")
    return Expr(t, column)


def assign(x: Any, t: Type) -> Expr:
    """A value for a column or parameter of a type."""
    e = expr(x)
    if not T.assignable(e.type, t):
        raise fail(Code.INCONSISTENT_TYPE, f"{e.type} can't be assigned to {t}")
    return Expr(t, e.column if e.type == t else e.column.cast(T.to_spark(t)))


def let(value: Any, body: Callable[[Expr], Expr]) -> Expr:
    """A local variable for the body. The value is evaluated once for each row, however often it is used; columns and literals, which cost nothing, stand for themselves and can be pushed down."""
    v = expr(value)
    made = body(v)
    if v.column is None or _SIMPLE.fullmatch(str(v.column)):
        return made
    return Expr(made.type, F.element_at(F.transform(F.array(v.column), lambda x: body(Expr(v.type, x)).column), 1))


#: How Spark writes columns that are names, or numbers.
_SIMPLE = re.compile(r"Column<'[\w.`]+'>")


def between(x: Any, low: Any, high: Any) -> Expr:
    return let(x, lambda v: and_(compare(">=", v, low), compare("<=", v, high)))
