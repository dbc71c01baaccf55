"""Typed values: key domains, date expressions, text forms of keys, canonical classes."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATETIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)

# The largest key of each type that holds every integer below it.
INTEGER_LIMITS = {T.ByteType: 127, T.ShortType: 32_767, T.IntegerType: 2**31 - 1, T.FloatType: 2**24, T.DoubleType: 2**53}

# Spellings of yes, no and nothing in metadata.
YES = ("y", "yes", "s", "sim", "true", "t", "1")
NO = ("n", "no", "nao", "não", "false", "f", "0")
NOTHING = ("", "nan", "none", "null", "<na>")


def named(column: str) -> Column:
    """A column of exactly this name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def type_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def key_capacity(kind: T.DataType) -> int | None:
    """The largest generated key of a type; None if it is unbounded here (long, string)."""
    if isinstance(kind, T.DecimalType):
        return 10 ** (kind.precision - kind.scale) - 1
    if isinstance(kind, (T.LongType, T.StringType)):
        return None
    if type(kind) in INTEGER_LIMITS:
        return INTEGER_LIMITS[type(kind)]
    raise TypeError(f"{kind.simpleString()} cannot be a generated key")


def any_null(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [named(c).isNull() for c in columns])


def all_null(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [named(c).isNull() for c in columns])


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin(*YES), F.lit(False))


def cleaned(text: Column) -> Column:
    """Trimmed text; the spellings of nothing are null."""
    t = F.trim(text.cast("string"))
    return F.when(~F.lower(t).isin(*NOTHING), t)


def yes_or_no(value: object) -> bool:
    if isinstance(value, bool):
        return value
    text = str(value).strip().lower()
    if text in YES:
        return True
    if text in NO:
        return False
    raise ValueError(f"neither yes nor no: {value!r}")


def key_text(column: str, kind: T.DataType) -> Column:
    """A key's text, equal for 10, 10.0 and ' 10': integral types never pass through double."""
    c = named(column)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
    return F.trim(c.cast("string"))


def date_for(expression: Column, kind: T.DataType, with_time: bool = False) -> Column:
    """A date or timestamp expression in a column's own type."""
    if isinstance(kind, T.StringType):
        return F.date_format(expression, "yyyy-MM-dd HH:mm:ss" if with_time else "yyyy-MM-dd")
    return expression.cast(kind)


def canonical(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.DecimalType):
        return "decimal"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, T.FractionalType):
        return "float"
    if isinstance(kind, DATETIMES):
        return "datetime"
    return "string"


def free_name(taken: Iterable[str], wish: str) -> str:
    """wish, with as many leading underscores as it takes to be new (names compare without case)."""
    known = {c.lower() for c in taken}
    while wish.lower() in known:
        wish = "_" + wish
    return wish
