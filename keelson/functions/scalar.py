"""Null- and error-safe column expressions (all JVM-side, codegen friendly, safe under ANSI mode)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT_MAX = 2147483647
INT_MIN = -2147483648

# Fixed value: the text token the credit data uses for a missing number.
NA_TOKEN = "NA"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_double(c, default: float = 0.0) -> Column:
    """Cast to double; null or malformed becomes ``default``.

    ``try_cast`` instead of ``cast``: under ANSI mode a plain cast of a malformed string raises.
    """
    return F.coalesce(_c(c).try_cast("double"), F.lit(float(default)))


def bin_case(c, rules: Sequence[tuple], default=0.0, dtype: str = "double") -> Column:
    """First matching rule wins. ``rules`` are ``(op, threshold, result)`` with op in
    ``> >= < <= = !=``; a null input matches no rule and falls to ``default``."""
    col = _c(c)
    ops = {">": col.__gt__, ">=": col.__ge__, "<": col.__lt__, "<=": col.__le__,
           "=": col.__eq__, "!=": col.__ne__}
    out = None
    for op, threshold, result in rules:
        cond = ops[op](F.lit(threshold))
        out = F.when(cond, F.lit(result)) if out is None else out.when(cond, F.lit(result))
    out = F.lit(default) if out is None else out.otherwise(F.lit(default))
    return out.cast(dtype)


# The age-group rule of the credit script (over 62 is group 1, over 30 group 2).
AGE_GROUP_RULES = [(">", 62, 1), (">", 30, 2)]


def age_group(c) -> Column:
    """P2 as used by the credit script: age > 62 -> 1, > 30 -> 2, else (null too) 0, as double."""
    return bin_case(c, AGE_GROUP_RULES, default=0, dtype="double")


def parse_int(c, na_token: str = NA_TOKEN, strict: bool = False) -> Column:
    """``NA`` -> 0, else the text parsed as a double and truncated toward zero.

    Out-of-range values saturate at the int bounds and NaN gives 0, as the JVM's ``toInt`` does.
    Text that is not a number gives null, or raises when ``strict``.
    """
    s = _c(c).cast("string")
    d = s.try_cast("double")
    as_int = (F.when(F.isnan(d), F.lit(0))
              .when(d >= F.lit(float(INT_MAX)), F.lit(INT_MAX))
              .when(d <= F.lit(float(INT_MIN)), F.lit(INT_MIN))
              .otherwise(d.try_cast("int")))
    bad = s.isNotNull() & d.isNull()
    if strict:
        as_int = F.when(bad, F.raise_error(F.concat(F.lit("not a number: "), s)).cast("int")).otherwise(as_int)
    return F.when(s == F.lit(na_token), F.lit(0)).otherwise(as_int).cast("int")


def indicator(c, value) -> Column:
    """P5: 1 when the column equals ``value``, else 0 (null too)."""
    return F.coalesce((_c(c) == F.lit(value)).cast("int"), F.lit(0))


def abs_error(prediction, label) -> Column:
    """Absolute error."""
    return F.abs(_c(prediction) - _c(label))


def ms_bucket(ms, width_ms: int = 1000) -> Column:
    """Integer division of epoch milliseconds, truncating toward zero as the JVM does.

    ``c - c % w`` is an exact multiple of ``w`` (``%`` keeps the dividend's sign), so the
    division is exact for any |ms| below 2^53.
    """
    c = _c(ms).cast("bigint")
    w = F.lit(int(width_ms)).cast("bigint")
    return ((c - c % w) / w).cast("bigint")


def epoch_ms_to_timestamp(ms) -> Column:
    """P20: epoch milliseconds to timestamp."""
    return F.timestamp_millis(_c(ms).cast("bigint"))


def ntz_epoch_micros(c) -> Column:
    """Microseconds since 1970-01-01 00:00 of a ``timestamp_ntz`` read as UTC wall-clock time.

    Built from the date and the clock fields, which do not depend on the session time zone
    (casting to ``timestamp`` would go through the session zone and its daylight saving).
    """
    col = _c(c)
    days = F.unix_date(col.cast("date")).cast("bigint")
    clock = (F.hour(col) * 3600 + F.minute(col) * 60).cast("bigint")
    micros = (F.date_part(F.lit("SECOND"), col) * F.lit(1_000_000)).cast("bigint")
    return days * F.lit(86_400_000_000) + clock * F.lit(1_000_000) + micros


def _floor_div(c: Column, w: int) -> Column:
    return ((c - F.pmod(c, F.lit(w))) / F.lit(w)).cast("bigint")


def epoch_ms(c, dtype: T.DataType | None = None) -> Column:
    """P20: timestamp (with or without time zone) or epoch-ms number to epoch milliseconds.

    ``timestamp_ntz`` values are read as UTC wall-clock times, independent of the session zone.
    """
    col = _c(c)
    if dtype is None or isinstance(dtype, T.TimestampNTZType):
        if dtype is None:
            raise ValueError("pass the column's data type (df.schema[name].dataType)")
        return _floor_div(ntz_epoch_micros(col), 1000)
    if isinstance(dtype, T.TimestampType):
        return F.unix_millis(col)
    if isinstance(dtype, T.DateType):
        return F.unix_date(col).cast("bigint") * F.lit(86_400_000)
    if isinstance(dtype, T.IntegralType):
        return col.cast("bigint")
    raise TypeError(f"cannot read {dtype.simpleString()} as epoch milliseconds")


def vector_element(v, index: int) -> Column:
    """P10: element ``index`` of an ML vector (null past the end, as Spark 2.1 did)."""
    from pyspark.ml.functions import vector_to_array

    return F.get(vector_to_array(_c(v)), index)


def can_hash(dtype: T.DataType) -> bool:
    """Spark hashes no maps, nor anything that holds one, and no variants."""
    if isinstance(dtype, T.StructType):
        return all(can_hash(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return can_hash(dtype.elementType)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def hashable(column: Column, dtype: T.DataType) -> list[Column]:
    """The parts of a column that a hash can read: itself, or the fields of a struct that can be hashed."""
    if can_hash(dtype):
        return [column]
    if isinstance(dtype, T.StructType):
        return [c for f in dtype.fields for c in hashable(column.getField(f.name), f.dataType)]
    return []


def hashable_columns(df: DataFrame) -> list[Column]:
    """Everything in a row that a hash can read, so that a row hash works on tables with map columns too."""
    return [c for f in df.schema.fields for c in hashable(F.col(f"`{f.name}`"), f.dataType)]
