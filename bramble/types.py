"""Type kinds, and the strict rules for promoting, unifying, assigning, casting and applying them.

Spark coerces far more than these rules allow; expressions and operators ask here first
and then cast explicitly, so that Catalyst never has to guess.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import types as S

from .diagnostics import Code, fail


class Category(Enum):
    BOOLEAN = "boolean"
    NUMBER = "number"
    CHARACTER_STRING = "character_string"
    OCTET_STRING = "octet_string"
    BIT_STRING = "bit_string"
    TEMPORAL = "temporal"
    DATETIME_INTERVAL = "datetime_interval"
    LARGE_OCTET_STRING = "large_octet_string"
    LARGE_CHARACTER_STRING = "large_character_string"
    COLLECTION = "collection"
    STRUCTURE = "structure"
    UNKNOWN = "unknown"
    UNIQUE = "unique"
    EXTERNAL = "external"
    UNRESOLVED = "unresolved"


#: The category of each type kind.
CATEGORIES = {
    "boolean": Category.BOOLEAN,
    "int1": Category.NUMBER,
    "int2": Category.NUMBER,
    "int4": Category.NUMBER,
    "int8": Category.NUMBER,
    "decimal": Category.NUMBER,
    "float4": Category.NUMBER,
    "float8": Category.NUMBER,
    "character": Category.CHARACTER_STRING,
    "octet": Category.OCTET_STRING,
    "bit": Category.BIT_STRING,
    "date": Category.TEMPORAL,
    "time_of_day": Category.TEMPORAL,
    "time_point": Category.TEMPORAL,
    "datetime_interval": Category.DATETIME_INTERVAL,
    "blob": Category.LARGE_OCTET_STRING,
    "clob": Category.LARGE_CHARACTER_STRING,
    "array": Category.COLLECTION,
    "record": Category.STRUCTURE,
    "unknown": Category.UNKNOWN,
    "table": Category.UNIQUE,
    "row_id": Category.UNIQUE,
    "row_reference": Category.UNIQUE,
    "declared": Category.UNIQUE,
    "extension": Category.EXTERNAL,
    "error": Category.UNRESOLVED,
    "pending": Category.UNRESOLVED,
}

_NO_EQUAL = {Category.LARGE_OCTET_STRING, Category.LARGE_CHARACTER_STRING, Category.UNIQUE, Category.EXTERNAL, Category.UNRESOLVED}
_NO_ORDER = _NO_EQUAL | {Category.DATETIME_INTERVAL, Category.COLLECTION, Category.STRUCTURE, Category.UNKNOWN}


@dataclass(frozen=True)
class Type:
    """A type. What doesn't apply to its kind stays at its default.

    precision and scale: None is unspecified (`*`). length: None is unlimited.
    name: of declared and extension types. elements: of arrays, records and tables.
    """

    kind: str
    precision: int | None = None
    scale: int | None = None
    varying: bool = True
    length: int | None = None
    with_time_zone: bool = False
    name: str = ""
    elements: tuple = ()

    @property
    def category(self) -> Category:
        return CATEGORIES[self.kind]

    @property
    def equality_comparable(self) -> bool:
        return self.category not in _NO_EQUAL

    @property
    def order_comparable(self) -> bool:
        return self.category not in _NO_ORDER

    def __str__(self) -> str:
        if self.kind == "decimal":
            return "decimal({},{})".format(*("*" if x is None else x for x in (self.precision, self.scale)))
        if self.kind in ("character", "octet", "bit"):
            return f"{self.kind}{' varying' if self.varying else ''}({'*' if self.length is None else self.length})"
        if self.kind in ("time_of_day", "time_point"):
            return self.kind + (" with time zone" if self.with_time_zone else "")
        return f"{self.kind}({self.name})" if self.name else self.kind


BOOLEAN, INT1, INT2, INT4, INT8 = map(Type, ("boolean", "int1", "int2", "int4", "int8"))
FLOAT4, FLOAT8, DATE, INTERVAL = map(Type, ("float4", "float8", "date", "datetime_interval"))
BLOB, CLOB, UNKNOWN, ROW_ID, ERROR = map(Type, ("blob", "clob", "unknown", "row_id", "error"))


def decimal(precision: int | None = None, scale: int | None = None) -> Type:
    return Type("decimal", precision=precision, scale=scale)


def character(length: int | None = None, varying: bool = True) -> Type:
    return Type("character", length=length, varying=varying)


def octet(length: int | None = None, varying: bool = True) -> Type:
    return Type("octet", length=length, varying=varying)


def bit(length: int | None = None, varying: bool = True) -> Type:
    return Type("bit", length=length, varying=varying)


def time_of_day(with_time_zone: bool = False) -> Type:
    return Type("time_of_day", with_time_zone=with_time_zone)


def time_point(with_time_zone: bool = False) -> Type:
    return Type("time_point", with_time_zone=with_time_zone)


def array(element: Type) -> Type:
    return Type("array", elements=(element,))


def record(**fields: Type) -> Type:
    return Type("record", elements=tuple(fields.items()))


def table(**columns: Type) -> Type:
    return Type("table", elements=tuple(columns.items()))


def declared(name: str, body: Type | None = None) -> Type:
    return Type("declared", name=name, elements=(body,) if body else ())


def extension(name: str) -> Type:
    return Type("extension", name=name)


# --- Spark ---

_SPARK = {
    "boolean": S.BooleanType(), "int1": S.ByteType(), "int2": S.ShortType(), "int4": S.IntegerType(), "int8": S.LongType(),
    "float4": S.FloatType(), "float8": S.DoubleType(), "character": S.StringType(), "octet": S.BinaryType(), "bit": S.StringType(),
    "date": S.DateType(), "datetime_interval": S.DayTimeIntervalType(), "blob": S.BinaryType(), "clob": S.StringType(),
    "unknown": S.NullType(), "row_id": S.LongType(), "row_reference": S.LongType(), "error": S.NullType(), "pending": S.NullType(),
}


def to_spark(t: Type) -> S.DataType:
    """Spark's type that holds a type's values. Unspecified precision is 38, unspecified scale 10; bit strings are text of 0 and 1."""
    if t.kind == "decimal":
        scale = 10 if t.scale is None else t.scale
        return S.DecimalType(38 if t.precision is None else min(38, t.precision), min(scale, 38))
    if t.kind == "time_of_day":
        return S.TimeType(6) if not t.with_time_zone else S.StructType([S.StructField("time", S.TimeType(6)), S.StructField("offset", S.IntegerType())])
    if t.kind == "time_point":
        return S.TimestampType() if t.with_time_zone else S.TimestampNTZType()
    if t.kind == "array":
        return S.ArrayType(to_spark(t.elements[0]))
    if t.kind in ("record", "table"):
        return S.StructType([S.StructField(n, to_spark(e)) for n, e in t.elements])
    if t.kind == "declared" and t.elements:
        return to_spark(t.elements[0])
    if t.kind in _SPARK:
        return _SPARK[t.kind]
    raise fail(Code.UNSUPPORTED_TYPE, f"{t} has no Spark type")


def from_spark(t: S.DataType, metadata: dict | None = None) -> Type:
    """The type of a Spark column; metadata `lob` marks large objects, `bit` bit strings."""
    metadata = metadata or {}
    if isinstance(t, S.DecimalType):
        return decimal(t.precision, t.scale)
    if isinstance(t, (S.CharType, S.VarcharType)):
        return character(t.length, isinstance(t, S.VarcharType))
    if isinstance(t, S.StringType):
        return CLOB if metadata.get("lob") else bit() if metadata.get("bit") else character()
    if isinstance(t, S.BinaryType):
        return BLOB if metadata.get("lob") else octet()
    if isinstance(t, (S.TimestampType, S.TimestampNTZType)):
        return time_point(isinstance(t, S.TimestampType))
    if isinstance(t, S.TimeType):
        return time_of_day()
    if isinstance(t, (S.DayTimeIntervalType, S.YearMonthIntervalType, S.CalendarIntervalType)):
        return INTERVAL
    if isinstance(t, S.ArrayType):
        return array(from_spark(t.elementType))
    if isinstance(t, S.StructType):
        return Type("record", elements=tuple((f.name, from_spark(f.dataType, f.metadata)) for f in t.fields))
    for kind, spark in _SPARK.items():
        if spark == t:
            return Type(kind)
    raise fail(Code.UNSUPPORTED_TYPE, f"columns of Spark's type {t.simpleString()} are not supported")


# --- promotion ---

_EXACT = ("int1", "int2", "int4", "int8", "decimal")
_INTS = ("int1", "int2", "int4", "int8")
_APPROXIMATE = ("float4", "float8")


def is_unresolved(*types: Type) -> bool:
    return any(t.category is Category.UNRESOLVED for t in types)


def unary_numeric(t: Type) -> Type:
    """Small integers and untyped NULLs become int4."""
    if t.kind in ("int1", "int2", "unknown"):
        return INT4
    return t if t.category is Category.NUMBER else ERROR


def _as_decimal(t: Type) -> Type:
    return t if t.kind == "decimal" else decimal(19 if t.kind == "int8" else 10, 0)


def unify_decimal(a: Type, b: Type) -> Type:
    """Of one scale: that scale, and the larger precision if both are known. Otherwise both are unspecified."""
    if a.scale is not None and a.scale == b.scale:
        known = a.precision is not None and b.precision is not None
        return decimal(max(a.precision, b.precision) if known else None, a.scale)
    return decimal()


def binary_numeric(a: Type, b: Type) -> Type:
    """The common type of two numbers; one may be an untyped NULL."""
    a, b = (b if a.kind == "unknown" else a), (a if b.kind == "unknown" else b)
    a, b = unary_numeric(a), unary_numeric(b)
    if ERROR in (a, b):
        return ERROR
    kinds = {a.kind, b.kind}
    if kinds <= {"int4", "int8"}:
        return INT8 if "int8" in kinds else INT4
    if kinds == {"float4"}:
        return FLOAT4
    if kinds & set(_APPROXIMATE):
        return FLOAT8
    return unify_decimal(_as_decimal(a), _as_decimal(b))


def _unify_string(a: Type, b: Type) -> Type:
    return Type(a.kind, varying=True, length=a.length if a.length == b.length else None)


def unify(a: Type, b: Type) -> Type:
    """The common type of values that stand side by side (CASE, COALESCE, UNION, VALUES, comparisons), or ERROR.

    Types of one category alone unify; an untyped NULL takes the other type. Temporal types,
    collections, structures and user-defined types only unify with themselves.
    """
    if is_unresolved(a, b):
        return ERROR
    if a.kind == "unknown" or b.kind == "unknown":
        return b if a.kind == "unknown" else a
    if a.category is not b.category:
        return ERROR
    if a.category is Category.NUMBER:
        return binary_numeric(a, b)
    if a.category in (Category.CHARACTER_STRING, Category.OCTET_STRING, Category.BIT_STRING):
        return _unify_string(a, b)
    return a if a == b else ERROR


def unify_all(types: list[Type]) -> Type:
    out = UNKNOWN
    for t in types:
        out = unify(out, t)
        if out == ERROR:
            break
    return out


# --- conversion ---

_TIMES = ("time_of_day", "time_point")


def assignable(source: Type, target: Type) -> bool:
    """INSERT, UPDATE, arguments and keys. Unresolved types pass, so that one mistake isn't told twice."""
    if is_unresolved(source, target) or source.kind == "unknown":
        return True
    if source.kind in _EXACT:
        return target.category is Category.NUMBER
    if source.kind in _APPROXIMATE:
        return target.kind in _APPROXIMATE
    pair = {source.kind, target.kind}
    if pair == {"date"} or pair == {"date", "time_point"}:
        return True
    if pair <= set(_TIMES):
        return source.with_time_zone == target.with_time_zone
    if source.kind in ("array", "record", "declared", "extension"):
        return source == target
    return source.kind == target.kind and source.kind in ("boolean", "character", "octet", "bit", "datetime_interval", "blob", "clob")


def castable(source: Type, target: Type) -> bool:
    """CAST: what can be assigned, text to and from all but large octets, approximate to exact, times across zones, octets and blobs."""
    if assignable(source, target):
        return True
    if Category.CHARACTER_STRING in (source.category, target.category):
        return source.category is not Category.LARGE_OCTET_STRING
    if source.kind in _APPROXIMATE and target.kind in _EXACT:
        return True
    pair = {source.kind, target.kind}
    return pair <= set(_TIMES) or pair == {"octet", "blob"}


def is_widest(t: Type) -> bool:
    """Whether a type can be a parameter's: the widest of its category, as far as lengths and precision go."""
    if t.kind in ("int1", "int2"):
        return False
    if t.kind == "decimal":
        return t.precision is None and t.scale is None
    if t.kind in ("character", "octet", "bit"):
        return t.varying and t.length is None
    return not is_unresolved(t)


_WIDENING = ("int1", "int2", "int4", "int8", "decimal", "float4", "float8")


def applicable(argument: Type, parameter: Type) -> bool:
    """Overload resolution: widening alone; intervals and nested types don't apply."""
    if is_unresolved(argument, parameter):
        return True
    if not is_widest(parameter):
        return False
    if argument.kind == "unknown":
        return True
    if argument.kind in _WIDENING and parameter.kind in _WIDENING:
        return _WIDENING.index(argument.kind) <= _WIDENING.index(parameter.kind)
    if argument.kind in _TIMES:
        return argument.kind == parameter.kind and argument.with_time_zone == parameter.with_time_zone
    return argument.kind == parameter.kind and argument.kind in ("boolean", "character", "octet", "bit", "date", "blob", "clob")


def concatenated(a: Type, b: Type) -> Type:
    """Strings of one category; lengths add up."""
    if is_unresolved(a, b):
        return ERROR
    if a.kind == "unknown":
        a = replace(b, length=0) if b.kind != "unknown" else a
    if b.kind == "unknown":
        b = replace(a, length=0)
    if a.category is not b.category or a.kind not in ("character", "octet", "bit"):
        return ERROR
    return Type(a.kind, varying=a.varying or b.varying, length=None if None in (a.length, b.length) else a.length + b.length)
