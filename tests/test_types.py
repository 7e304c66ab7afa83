"""The strict type rules, as matrices."""

import datetime
import decimal

import pytest

from bramble import types as T
from bramble.diagnostics import Code, CompileError
from bramble.functions import scalar as X
from bramble.session import Session

NUMBERS = [T.INT1, T.INT2, T.INT4, T.INT8, T.decimal(10, 2), T.FLOAT4, T.FLOAT8]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (T.INT1, T.INT2, T.INT4), (T.INT4, T.INT8, T.INT8), (T.INT4, T.FLOAT4, T.FLOAT8), (T.FLOAT4, T.FLOAT4, T.FLOAT4),
        (T.decimal(10, 2), T.FLOAT4, T.FLOAT8), (T.decimal(10, 0), T.INT4, T.decimal(10, 0)), (T.decimal(5, 0), T.INT8, T.decimal(19, 0)),
        (T.decimal(10, 2), T.decimal(12, 2), T.decimal(12, 2)), (T.decimal(10, 2), T.decimal(10, 3), T.decimal()), (T.decimal(10, 2), T.decimal(None, 2), T.decimal(None, 2)),
        (T.UNKNOWN, T.INT1, T.INT1), (T.character(3), T.character(3, False), T.character(3)), (T.character(3), T.character(4), T.character()),
        (T.DATE, T.time_point(), T.ERROR), (T.INT4, T.character(), T.ERROR), (T.BOOLEAN, T.INT4, T.ERROR), (T.time_point(), T.time_point(True), T.ERROR),
        (T.array(T.INT4), T.array(T.INT4), T.array(T.INT4)), (T.array(T.INT4), T.array(T.INT8), T.ERROR), (T.ERROR, T.INT4, T.ERROR),
    ],
)
def test_unify(a, b, want):
    assert T.unify(a, b) == want
    assert T.unify(b, a) == want


def test_assignable():
    for a in NUMBERS[:5]:
        for b in NUMBERS:
            assert T.assignable(a, b)
    for a in NUMBERS[5:]:
        assert [T.assignable(a, b) for b in NUMBERS] == [False] * 5 + [True] * 2
    assert T.assignable(T.DATE, T.time_point()) and T.assignable(T.time_point(True), T.DATE)
    assert not T.assignable(T.time_point(), T.time_point(True))
    assert T.assignable(T.time_of_day(), T.time_point()) and not T.assignable(T.time_of_day(), T.time_point(True))
    assert T.assignable(T.UNKNOWN, T.BLOB) and T.assignable(T.CLOB, T.CLOB) and not T.assignable(T.character(), T.CLOB)
    assert T.assignable(T.INTERVAL, T.INTERVAL) and not T.assignable(T.INT4, T.INTERVAL)


def test_castable():
    assert T.castable(T.FLOAT8, T.INT4) and T.castable(T.FLOAT4, T.decimal())
    assert not T.castable(T.BOOLEAN, T.INT4) and not T.castable(T.INT4, T.BOOLEAN)
    assert T.castable(T.BOOLEAN, T.character()) and T.castable(T.character(), T.INTERVAL)
    assert not T.castable(T.BLOB, T.character()) and T.castable(T.CLOB, T.character())
    assert T.castable(T.octet(), T.BLOB) and T.castable(T.BLOB, T.octet())
    assert T.castable(T.time_point(), T.time_point(True)) and not T.castable(T.array(T.INT4), T.array(T.INT8))


def test_applicable():
    widening = [T.INT1, T.INT2, T.INT4, T.INT8, T.decimal(), T.FLOAT4, T.FLOAT8]
    for i, a in enumerate(widening):
        for j, b in enumerate(widening):
            assert T.applicable(a, b) == (i <= j and b not in (T.INT1, T.INT2))
    assert not T.applicable(T.decimal(5, 2), T.decimal(10, 2)) and T.applicable(T.decimal(5, 2), T.decimal())
    assert not T.applicable(T.character(3), T.character(5)) and T.applicable(T.character(3, False), T.character())
    assert not T.applicable(T.INTERVAL, T.INTERVAL) and not T.applicable(T.array(T.INT4), T.array(T.INT4))
    assert T.applicable(T.time_of_day(), T.time_of_day()) and not T.applicable(T.time_of_day(), T.time_of_day(True))


def test_comparable():
    equal = {T.BOOLEAN, *NUMBERS, T.character(), T.octet(), T.bit(), T.DATE, T.time_of_day(), T.time_point(), T.INTERVAL, T.array(T.INT4), T.record(a=T.INT4), T.UNKNOWN}
    order = equal - {T.INTERVAL, T.array(T.INT4), T.record(a=T.INT4), T.UNKNOWN}
    every = equal | {T.BLOB, T.CLOB, T.ROW_ID, T.declared("d"), T.extension("e"), T.table(a=T.INT4), T.ERROR}
    assert {t for t in every if t.equality_comparable} == equal
    assert {t for t in every if t.order_comparable} == order


def test_spark_round_trip():
    for t in [T.BOOLEAN, T.INT1, T.INT2, T.INT4, T.INT8, T.FLOAT4, T.FLOAT8, T.decimal(12, 3), T.character(), T.octet(), T.DATE, T.time_of_day(), T.time_point(), T.time_point(True), T.INTERVAL, T.UNKNOWN, T.array(T.INT4), T.record(a=T.INT4, b=T.character())]:
        assert T.from_spark(T.to_spark(t)) == t
    assert T.from_spark(T.to_spark(T.BLOB), {"lob": True}) == T.BLOB
    with pytest.raises(CompileError):
        T.to_spark(T.extension("x"))


def typed(f):
    try:
        return f().type
    except CompileError as e:
        return e.code


def test_expression_types(spark):
    lit, I, D = X.literal, X.interval(hours=1), X.literal(datetime.date(2020, 1, 1))  # noqa: E741
    small, dec = X.literal(1, T.INT1), X.literal(decimal.Decimal("1.50"))
    bad = Code.INCONSISTENT_TYPE
    cases = [
        (lambda: small + small, T.INT4), (lambda: +small, T.INT4), (lambda: -small, T.INT4), (lambda: lit(7) / 2, T.INT4), (lambda: lit(1 << 40) / 2, T.INT8), (lambda: lit(7) % lit(1 << 40), T.INT8),
        (lambda: dec + dec, T.decimal(None, 2)), (lambda: dec + 1, T.decimal(None, 2)), (lambda: dec * dec, T.decimal()), (lambda: dec / 2, T.decimal()), (lambda: dec * 1.5, T.FLOAT8), (lambda: lit(None) + 1, T.INT4),
        (lambda: D + I, T.DATE), (lambda: X.add(I, D), T.DATE), (lambda: D - I, T.DATE), (lambda: X.subtract(I, D), bad), (lambda: D - D, bad), (lambda: I + I, T.INTERVAL), (lambda: I * 2, T.INTERVAL), (lambda: X.multiply(2, I), T.INTERVAL),
        (lambda: I / 2, T.INTERVAL), (lambda: I % 2, T.INTERVAL), (lambda: X.divide(2, I), bad), (lambda: -I, T.INTERVAL), (lambda: X.negate("a"), bad), (lambda: lit(True) + 1, bad),
        (lambda: X.concat("ab", "c"), T.character(3)), (lambda: X.concat(b"a", b"bc"), T.octet(3)), (lambda: X.concat("a", b"b"), bad), (lambda: X.concat("a", 1), bad), (lambda: X.concat(lit("01", T.bit()), lit("1", T.bit())), T.bit()),
        (lambda: X.length("abc"), T.INT4), (lambda: X.length(3), bad), (lambda: ~lit(True), T.BOOLEAN), (lambda: ~lit(1), bad), (lambda: lit(True) & None, T.BOOLEAN), (lambda: lit(True) | 1, bad),
        (lambda: lit(1) == "1", bad), (lambda: lit(1) == 2.0, T.BOOLEAN), (lambda: I == I, T.BOOLEAN), (lambda: I < I, bad), (lambda: X.compare("=", D, datetime.datetime(2020, 1, 1)), bad),
        (lambda: X.conditional((True, 1), default="a"), bad), (lambda: X.conditional((True, 1), default=2.5), T.FLOAT8), (lambda: X.conditional((1, 1)), bad), (lambda: X.coalesce(None, 1, 1 << 40), T.INT8), (lambda: X.coalesce(1, "a"), bad),
        (lambda: X.cast(True, T.INT4), bad), (lambda: X.cast("1", T.INT4), T.INT4), (lambda: X.like("a", 1), bad), (lambda: X.like("a", "%"), T.BOOLEAN), (lambda: X.between(5, 1, 10), T.BOOLEAN),
        (lambda: X.is_null(1), T.BOOLEAN), (lambda: X.is_true(1), bad), (lambda: X.is_unknown(None), T.BOOLEAN), (lambda: X.literal([1]), Code.UNSUPPORTED_TYPE), (lambda: X.literal(1, T.array(T.INT4)), Code.UNSUPPORTED_TYPE), (lambda: X.literal("2", T.bit()), bad),
    ]
    for i, (f, want) in enumerate(cases):
        assert typed(f) == want, i


def test_expression_values(spark):
    lit = X.literal
    one = Session(spark).spark.range(1)  # a session with TIME on
    value = lambda e: one.select(e.column.alias("v")).first()[0]
    assert value(lit(-7) / 2) == -3 and value(lit(-7) % 2) == -1
    assert value(lit(datetime.date(2020, 1, 1)) + X.interval(hours=25)) == datetime.date(2020, 1, 2)
    assert value(X.interval(seconds=7.5) % 2) == datetime.timedelta(seconds=1.5)
    assert value(X.interval(hours=3) / 2) == datetime.timedelta(minutes=90)
    assert value(lit(True) & None) is None and value(lit(False) & None) is False and value(lit(True) | None) is True
    assert value(X.cast("abcdef", T.character(3))) == "abc" and value(X.cast("a", T.character(3, False))) == "a  "
    assert value(X.like("100%", "100!%", "!")) is True and value(X.like("1000", "100!%", "!")) is False
    assert value(X.like("abcxe", "abc_e")) is True and value(X.like("a\\b", "a#\\b", "#")) is True
    assert value(lit(datetime.time(23, 30)) + X.interval(hours=1)) == datetime.time(0, 30)
    assert X.like_prefix("ab%c", "\\") == ("ab", False) and X.like_prefix("a!%b", "!") == ("a%b", True)
