"""Declared types, slot families and limits.

Fixed values throughout: results and error codes depend on them.
"""

from __future__ import annotations

from dataclasses import dataclass

STRING, INT, NUMERIC, DATETIME = "string", "int", "numeric", "datetime"
DECLARED_TYPES = (STRING, INT, NUMERIC, DATETIME)

#: Slot family of each declared type, and how many slots of it a page offers.
FAMILY = {STRING: "str", INT: "int", NUMERIC: "num", DATETIME: "dt"}
FAMILY_SLOTS = {"str": 25, "int": 15, "num": 10, "dt": 10}
PAGE_SLOTS = 60

SPARK_TYPE = {STRING: "string", INT: "bigint", NUMERIC: "double", DATETIME: "timestamp_ntz"}

SLOT_STATUSES = ("free", "assigned", "tombstoned", "backfilling", "ready")
LIVE = ("assigned", "backfilling", "ready")
QUERYABLE = ("assigned", "ready")

INT64_MIN, INT64_MAX = -(1 << 63), (1 << 63) - 1
MAX_STRING_CHARS = 4096
MAX_NAME = 128


@dataclass(frozen=True)
class FilterLimits:
    max_depth: int = 8
    max_nodes: int = 256
    max_args: int = 64
    max_in: int = 1024
    max_string: int = MAX_STRING_CHARS
    max_payload_bytes: int = 65_536


@dataclass(frozen=True)
class Settings:
    """Engine options with their defaults."""

    collation: str | None = None  # "UNICODE_CI_AI" compares without case and accents, but is not pushed to Parquet
    absent_is_null: bool = False  # True: is_null also matches records whose field group was never written
    page_size_default: int = 100
    page_size_max: int = 1000
    bulk_max: int = 1000
    bulk_chunk: int = 500
    export_active_cap: int = 3
    import_round: int = 100  # chunks that commit together
    export_backoff: tuple[int, ...] = (1, 4, 16)  # seconds before an export that failed for an outside reason is tried again
    export_max_bytes: int = 5 << 30
    export_max_skips: int = 1000
    min_free_space: float = 0.1
    lease_seconds: int = 60
    gc_completed_seconds: int = 86_400
    gc_failed_seconds: int = 3_600
    low_selectivity: float = 0.01
    low_selectivity_min_rows: int = 10_000
    low_distinct: int = 10
    spread_threshold: int = 2
    free_ratio_threshold: float = 0.2
