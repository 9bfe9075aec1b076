"""Scans, pages and point reads.

``records``: a DataFrame of one tenant-and-model store with entry_id, tenant_id, model_id,
created_at, deleted_at, fields (JSON), a typed column ``f_<id>`` for each typed field and a
presence column ``p_<page>`` for each field group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PageSizeOutOfRange, tenant
from ..functions.records import datetime_text, decode_cursor, encode_cursor, payload, value_of
from ..plans import ast
from ..plans.compiler import compile_filter
from ..plans.preflight import not_filterable_reason, validate
from ..registry import FieldView
from ..types import DATETIME, Settings

#: Rows that one task sends to the driver when pages are drained.
TASK_ROWS = 1 << 15


@dataclass(frozen=True)
class Page:
    rows: list[dict]
    next_cursor: str | None
    page_size: int


@dataclass(frozen=True)
class Request:
    tenant_id: int
    model_id: int
    filter: ast.Node | None = None
    select: Sequence[str] | None = None  # None: every registered field
    page_size: int = 100
    cursor: str | None = None

    def check(self, settings: Settings) -> None:
        tenant(self.tenant_id)
        if isinstance(self.page_size, bool) or not 1 <= self.page_size <= settings.page_size_max:
            raise PageSizeOutOfRange(f"1 to {settings.page_size_max} rows, not {self.page_size}")


class SearchDriver(Protocol):
    """What a search backend offers; inject another one into the engine to replace this one."""

    def list(self, request: Request, fields: dict[str, FieldView]) -> Page: ...

    def get(self, tenant_id: int, entry_id: int) -> dict | None: ...

    def supported_operators(self) -> frozenset[str]: ...

    def supports_filter_on(self, view: FieldView) -> bool: ...

    def supports_fuzzy_search(self) -> bool: ...

    def consistency(self) -> str: ...


def field_value(view: FieldView | None, name: str, variant: Column) -> Column:
    """Typed column where the field has one, else the payload's value; names of no field give null."""
    if view is None:
        return F.lit(None).cast("string").alias(name)
    if view.typed:
        c = F.col(view.column)
        return (datetime_text(c) if view.field.declared_type == DATETIME else c).alias(name)
    return F.try_variant_get(value_of(variant, name), "$", "string").alias(name)


def base_scan(records: DataFrame, tenant_id: int, model_id: int, after: int = 0) -> DataFrame:
    return records.where((F.col("tenant_id") == tenant(tenant_id)) & (F.col("model_id") == model_id) & F.col("deleted_at").isNull() & (F.col("entry_id") > after))


def scan(records: DataFrame, fields: dict[str, FieldView], tenant_id: int, model_id: int, node: ast.Node | None = None, select: Sequence[str] | None = None, after: int = 0, settings: Settings = Settings(), operators: frozenset[str] = frozenset(ast.LEAF_OPS)) -> DataFrame:
    """Every matching record, lazily: entry_id and the selected fields."""
    validate(node, fields, operators)
    df = base_scan(records, tenant_id, model_id, after)
    condition = compile_filter(node, fields, settings)
    if condition is not None:
        df = df.where(condition)
    names = list(fields) if select is None else list(dict.fromkeys(select))
    variant = payload(F.col("fields"))
    return df.select("entry_id", *(field_value(fields.get(n), n, variant) for n in names))


def page(records: DataFrame, fields: dict[str, FieldView], request: Request, settings: Settings = Settings()) -> Page:
    """One page by id; a row more than asked for is the only sign that there are further ones."""
    request.check(settings)
    after = decode_cursor(request.cursor) if request.cursor is not None else 0
    df = scan(records, fields, request.tenant_id, request.model_id, request.filter, request.select, after, settings)
    rows = [r.asDict() for r in df.orderBy("entry_id").limit(request.page_size + 1).collect()]
    more = len(rows) > request.page_size
    rows = rows[: request.page_size]
    return Page(rows, encode_cursor(rows[-1]["entry_id"]) if more else None, request.page_size)


def pages(records: DataFrame, fields: dict[str, FieldView], request: Request, settings: Settings = Settings()) -> Iterator[Page]:
    """Pages until the last, all of one snapshot: the rows are sorted once and cut into pages as they arrive.

    So a page costs its own rows, not another scan, and the driver holds a page and the results of
    two tasks.  Analytics take ``scan`` instead.
    """
    request.check(settings)
    after = decode_cursor(request.cursor) if request.cursor is not None else 0
    df = scan(records, fields, request.tenant_id, request.model_id, request.filter, request.select, after, settings)
    tasks = max(1, -(-df.count() // TASK_ROWS))
    rows: list[dict] = []
    for r in df.repartitionByRange(tasks, "entry_id").sortWithinPartitions("entry_id").toLocalIterator(prefetchPartitions=True):
        if len(rows) == request.page_size:
            yield Page(rows, encode_cursor(rows[-1]["entry_id"]), request.page_size)
            rows = []
        rows.append(r.asDict())
    yield Page(rows, None, request.page_size)


def get(records: DataFrame, tenant_id: int, entry_id: int) -> dict | None:
    """The whole payload, unregistered keys included; None if missing, deleted or another tenant's."""
    live = records.where((F.col("entry_id") == entry_id) & (F.col("tenant_id") == tenant(tenant_id)) & F.col("deleted_at").isNull())
    row = live.select("entry_id", "tenant_id", "model_id", "created_at", "deleted_at", "fields").first()
    return row.asDict() if row else None


# Joins of separate tables of one field group each, as a store that splits records over tables needs them.


def on_all_groups(entries: DataFrame, *groups: DataFrame) -> DataFrame:
    """Entries that every group's (filtered) rows hold, with the groups' columns."""
    for g in groups:
        entries = entries.join(g, "entry_id")
    return entries


def in_any_group(entries: DataFrame, *groups: DataFrame) -> DataFrame:
    """Entries that some group's rows hold, each once."""
    hits = groups[0].select("entry_id")
    for g in groups[1:]:
        hits = hits.union(g.select("entry_id"))
    return entries.join(hits, "entry_id", "left_semi")


def in_no_group(entries: DataFrame, *groups: DataFrame) -> DataFrame:
    for g in groups:
        entries = entries.join(g.select("entry_id"), "entry_id", "left_anti")
    return entries


def with_groups(entries: DataFrame, *groups: DataFrame) -> DataFrame:
    """Every entry, with null where a group has no row."""
    for g in groups:
        entries = entries.join(g, "entry_id", "left")
    return entries


class SparkDriver:
    """The default driver: batch reads of one snapshot."""

    def __init__(self, records: DataFrame, settings: Settings = Settings()):
        self.records, self.settings = records, settings

    def list(self, request: Request, fields: dict[str, FieldView]) -> Page:
        return page(self.records, fields, request, self.settings)

    def get(self, tenant_id: int, entry_id: int) -> dict | None:
        return get(self.records, tenant_id, entry_id)

    def supported_operators(self) -> frozenset[str]:
        return frozenset(ast.LEAF_OPS)

    def supports_filter_on(self, view: FieldView) -> bool:
        return not_filterable_reason(view) is None

    def supports_fuzzy_search(self) -> bool:
        return False

    def consistency(self) -> str:
        return "strong"
