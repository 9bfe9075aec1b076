"""Values into declared types: the rules for writing, and the matrix for changing a field's type.

Both give ``struct<value, reason>`` expressions: a value with a null reason, or a null value
with the reason it failed.  Absent and JSON-null values have neither.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.records import STRICT_DATETIME, JsonValue, canonical_float_text, float_text, utc_of
from ..types import DATETIME, INT, MAX_STRING_CHARS, NUMERIC, SPARK_TYPE, STRING

# Accepted spellings.
DIGITS = r"^-?[0-9]+$"
JSON_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
ANY_NUMBER = r"^[ \t\n\r\x0B\f]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\r\x0B\f]*$"
REJECTED = {(INT, DATETIME), (NUMERIC, DATETIME), (DATETIME, INT), (DATETIME, NUMERIC)}


def outcome(declared: str, value: Column, reason: Column) -> Column:
    return F.struct(F.when(reason.isNull(), value.cast(SPARK_TYPE[declared])).alias("value"), reason.alias("reason"))


def _int_of(text: Column) -> tuple[Column, Column]:
    """(bigint, whether it is written exactly as it would be printed)"""
    n = F.when(text.rlike(DIGITS), text.try_cast("bigint"))
    return n, F.coalesce(n.cast("string") == text, F.lit(False))


def _integral(d: Column) -> Column:
    # From 2**53 on every double is whole, and floor() to a long would overflow.
    return F.when(F.abs(d) < 2.0**53, F.floor(d) == d).otherwise(~F.isnan(d) & (F.abs(d) < float("inf")))


def _in_int64(d: Column) -> Column:
    return (d >= -(2.0**63)) & (d < 2.0**63)


def _long_of(d: Column) -> Column:
    return F.when(_in_int64(d), d).try_cast("bigint")


def write_value(v: Column, declared: str, kind: Column | None = None, text: Column | None = None) -> Column:
    """First write.  Reasons: unparseable, out_of_range, malformed_number, malformed_datetime, too_long."""
    j = JsonValue(v, kind, text)
    none = F.lit(None).cast("string")
    if declared == STRING:
        text = F.when(j.is_float, float_text(j.double)).when(j.is_bool, F.when(j.bool, "1").otherwise("")).otherwise(j.string)
        reason = F.when(~j.is_scalar, "unparseable").when(F.char_length(text) > MAX_STRING_CHARS, "too_long").otherwise(none)
        value = text
    elif declared == INT:
        n, exact = _int_of(j.string)
        reason = (
            F.when(j.is_int, none)
            .when(j.is_float, F.when(_integral(j.double) & _in_int64(j.double), none).otherwise(F.lit("out_of_range")))
            .when(j.is_string & j.string.rlike(DIGITS), F.when(exact, none).otherwise(F.lit("out_of_range")))
            .otherwise(F.lit("unparseable"))
        )
        value = F.when(j.is_int, j.int).when(j.is_float, _long_of(j.double)).otherwise(n)
    elif declared == NUMERIC:
        reason = F.when(j.is_number | j.is_string & j.string.rlike(ANY_NUMBER), none).otherwise(F.lit("malformed_number"))
        value = F.when(j.is_number, j.double).otherwise(F.trim(j.string).try_cast("double"))
    else:
        value = F.when(j.is_string, utc_of(j.string))
        reason = F.when(value.isNotNull(), none).otherwise(F.lit("malformed_datetime"))
    nothing = F.lit(None).cast(f"struct<value:{SPARK_TYPE[declared]},reason:string>")
    return F.when(j.absent, nothing).otherwise(outcome(declared, value, reason))


def retype_value(v: Column, source: str, target: str) -> Column:
    """Change of declared type, from the JSON value.  Absent and null are not attempted."""
    j = JsonValue(v)
    none = F.lit(None).cast("string")
    fail = lambda code: F.lit(code)
    if (source, target) in REJECTED:
        value, reason = F.lit(None), fail("epoch_coercion_rejected")
    elif target == INT and source in (STRING, INT):
        # A number in an int field stands for itself; in a string field only strings count.
        text = F.when(j.is_string, j.string) if source == STRING else F.when(j.is_float, float_text(j.double)).when(j.is_bool, F.when(j.bool, "1").otherwise("")).otherwise(j.string)
        n, exact = _int_of(text)
        native = j.is_int if source == INT else F.lit(False)
        reason = F.when(native, none).when(text.isNull() | ~text.rlike(DIGITS), "unparseable").when(~exact, "out_of_range").otherwise(none)
        value = F.when(native, j.int).otherwise(n)
    elif target == NUMERIC and source in (STRING, NUMERIC):
        native = j.is_number if source == NUMERIC else F.lit(False)
        text = F.when(j.is_string, j.string)
        d = text.try_cast("double")
        fine = text.rlike(JSON_NUMBER)
        reason = F.when(native, none).when(text.isNull() | ~fine, "malformed_number").when(F.abs(d) == float("inf"), "out_of_range").otherwise(none)
        value = F.when(native, j.double).otherwise(d)
    elif source == STRING and target == DATETIME:
        value = F.when(j.is_string & j.string.rlike(STRICT_DATETIME), utc_of(j.string))
        reason = F.when(value.isNull(), "malformed_datetime").otherwise(none)
    elif source == INT:  # to string or numeric
        n, exact = _int_of(F.when(j.is_string, j.string))
        reason = F.when(j.is_int, none).when(j.is_string & j.string.rlike(DIGITS), F.when(exact, none).otherwise(fail("out_of_range"))).otherwise(fail("unparseable"))
        value = F.when(j.is_int, j.int).otherwise(n)
    elif source == NUMERIC:  # to string or int
        text = F.when(j.is_string & j.string.rlike(JSON_NUMBER), j.string)
        d = F.when(j.is_number, j.double).otherwise(text.try_cast("double"))
        d = F.when(F.abs(d) < float("inf"), d)
        if target == INT:
            reason = F.when(d.isNull(), "malformed_number").when(~_integral(d), "non_integer").when(~_in_int64(d), "out_of_range").otherwise(none)
            value = _long_of(d)
        else:
            reason = F.when(d.isNull(), "malformed_number").otherwise(none)
            value = F.when(d == 0, "0").when(j.is_int, j.int.cast("string")).otherwise(canonical_float_text(d))
    elif source == DATETIME:  # to string or datetime
        ts = F.when(j.is_string, utc_of(j.string, micros=target == STRING))
        reason = F.when(ts.isNull(), "malformed_datetime").otherwise(none)
        value = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") if target == STRING else ts
    else:  # string to string
        text = F.when(j.is_float, float_text(j.double)).when(j.is_bool, F.when(j.bool, "1").otherwise("")).otherwise(j.string)
        value, reason = text, F.when(~j.is_scalar, "unparseable").otherwise(none)
    nothing = F.lit(None).cast(f"struct<value:{SPARK_TYPE[target]},reason:string>")
    return F.when(j.absent, nothing).otherwise(outcome(target, value, reason))
