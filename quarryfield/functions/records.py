"""Column functions over records' JSON payloads and text, shared by coercion, reads and exports."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidCursor


def path_of(key: str) -> str:
    """JSON path of a top-level key, whatever characters it holds."""
    escaped = key.replace("\\", "\\\\").replace('"', '\\"')
    return f'$["{escaped}"]' if "'" in key else f"$['{key}']"


def payload(fields: Column) -> Column:
    """JSON text as a variant; null if it is not JSON."""
    return F.try_parse_json(fields)


def value_of(variant: Column, key: str) -> Column:
    """Null only where the key is absent; a JSON null is a variant of its own."""
    return F.try_variant_get(variant, path_of(key), "variant")


def kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


class JsonValue:
    """One JSON value, told apart by its own type; ``kind`` and ``text`` may be columns that hold them already."""

    def __init__(self, v: Column, kind: Column | None = None, text: Column | None = None):
        self.v = v
        kind = kind_of(v) if kind is None else kind
        self.absent = v.isNull() | F.is_variant_null(v)
        self.is_string = kind == "STRING"
        self.is_bool = kind == "BOOLEAN"
        self.is_int = kind == "BIGINT"
        self.is_float = kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
        self.is_number = self.is_int | self.is_float
        self.is_scalar = self.is_string | self.is_bool | self.is_number
        self.string = text_of(v) if text is None else text
        self.int = F.try_variant_get(v, "$", "bigint")
        self.double = F.try_variant_get(v, "$", "double")
        self.bool = F.try_variant_get(v, "$", "boolean")


_ZERO = "0." + "0" * 13 + "e+00"


def _trim_zeros(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` mentions it.

    The lambda is not part of generated code either, whose size grows with each mention and
    beyond some size is not compiled.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def float_text(d: Column) -> Column:
    """14 significant digits; an exponent below 1e-4 and from 1e14 on (``1.0E+25``)."""

    def spelt(sci: Column) -> Column:
        tail = F.substring_index(sci, "e", -1)
        digits = F.regexp_replace(F.regexp_replace(F.substring_index(sci, "e", 1), "0+$", ""), r"\.$", ".0")
        far = F.concat(digits, F.regexp_replace(tail, r"^([+-])0*", "E$1"))
        plain = F.regexp_replace(sci.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
        return F.when(sci == _ZERO, "0").when(sci == "-" + _ZERO, "-0").when(~tail.try_cast("int").between(-4, 13), far).otherwise(plain)

    return _let(F.format_string("%.13e", d), spelt)


def canonical_float_text(d: Column) -> Column:
    """Without an exponent: at most 14 decimals, trailing zeros cut."""
    text = float_text(d)
    long = _trim_zeros(F.format_string("%.14f", d))
    return F.when(d == 0, "0").when(F.contains(text, F.lit("E")), F.when(long.isin("", "-"), "0").otherwise(long)).otherwise(text)


# Date, time, optional fraction and optional zone; the zone is optional only where the caller allows it.
_DATETIME = r"^(\d{4}-\d{2}-\d{2})(?:[Tt ](\d{2}:\d{2}(?::\d{2})?)(?:\.(\d+))?)? ?(Z|z|[+-]\d{2}:?\d{2})?$"
STRICT_DATETIME = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def utc_of(text: Column, micros: bool = False) -> Column:
    """ISO date or date-time, UTC unless it names an offset, as timestamp_ntz in UTC; null if it is none."""
    part = lambda i: F.regexp_extract(text, _DATETIME, i)
    clock = F.when(part(2) == "", "00:00:00").when(F.length(part(2)) == 5, F.concat(part(2), F.lit(":00"))).otherwise(part(2))
    fraction = F.rpad(F.substring(part(3), 1, 6), 6, "0") if micros else F.lit("000000")
    local = F.concat(part(1), F.lit(" "), clock, F.lit("."), fraction).try_cast("timestamp_ntz")
    zone = F.regexp_replace(part(4), ":", "")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    hours, minutes = (sign * F.coalesce(F.substring(zone, a, 2).try_cast("int"), F.lit(0)) for a in (2, 4))
    shifted = local - F.make_dt_interval(F.lit(0), hours, minutes, F.lit(0))
    return F.when(text.rlike(_DATETIME), shifted)


def datetime_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


# Cursors


def encode_cursor(entry_id: int) -> str:
    return base64.urlsafe_b64encode(f"v1:{entry_id}".encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> int:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", cursor, re.ASCII):
        raise InvalidCursor("not base64url")
    try:
        text = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode()
    except ValueError:
        raise InvalidCursor("not base64url") from None
    if not text.startswith("v1:"):
        raise InvalidCursor("unknown version")
    if not re.fullmatch(r"[0-9]+", text[3:], re.ASCII):
        raise InvalidCursor("not an id")
    return int(text[3:])


def cursor_column(entry_id: Column) -> Column:
    plain = F.base64(F.encode(F.concat(F.lit("v1:"), entry_id.cast("string")), "UTF-8"))
    return F.regexp_replace(F.translate(plain, "+/", "-_"), "=+$", "")
