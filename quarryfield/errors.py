"""Errors a caller can meet."""

from __future__ import annotations

from typing import Any


class EngineError(Exception):
    """Base of all."""


class InvalidTenantId(EngineError, ValueError): ...


class InvalidCursor(EngineError, ValueError): ...


class PageSizeOutOfRange(EngineError, ValueError): ...


class MalformedPayload(EngineError, ValueError):
    """``key`` names the offending place, such as ``[3].modelId``."""

    def __init__(self, key: str, message: str):
        super().__init__(f"{key}: {message}" if key else message)
        self.key = key


class PayloadTooLarge(EngineError, ValueError): ...


class UncoercibleValue(EngineError, ValueError): ...


class EntryNotFound(EngineError, LookupError): ...


class ConcurrentWrite(EngineError): ...


class LeaseLost(EngineError): ...


class FieldNotFound(EngineError, LookupError): ...


class UnknownField(EngineError, LookupError): ...


class FieldNotFilterable(EngineError):
    """``reason``: not_filterable, unmapped, backfilling or tombstoned."""

    def __init__(self, field: str, reason: str):
        super().__init__(f"field {field!r} cannot be filtered on: {reason}")
        self.field, self.reason = field, reason


class FieldNotIndexed(FieldNotFilterable): ...


class IncompatibleRetype(EngineError, ValueError): ...


class RetypeInProgress(EngineError): ...


class CompactionCapacity(EngineError): ...


class ActiveExportCap(EngineError): ...


class ArtifactError(EngineError): ...


class QuarantineEmpty(EngineError, LookupError): ...


# The closed set of filter error codes (fixed values).
FILTER_CODES = (
    "envelope_malformed",
    "node_malformed",
    "operator_unknown",
    "capability_unsupported",
    "field_unknown",
    "field_not_filterable",
    "value_type_mismatch",
    "value_count_mismatch",
    "value_unexpected",
    "value_out_of_bounds",
    "nesting_too_deep",
    "node_count_exceeded",
    "version_unsupported",
)


class FilterError(EngineError, ValueError):
    """A rejected filter: one of ``FILTER_CODES``, where it is (RFC 6901) and details."""

    def __init__(self, code: str, pointer: str, message: str, **details: Any):
        assert code in FILTER_CODES
        super().__init__(f"{code} at {pointer or '/'}: {message}")
        self.code, self.pointer, self.details = code, pointer, details


def tenant(value: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise InvalidTenantId(f"a tenant id is a positive integer, not {value!r}")
    return value
