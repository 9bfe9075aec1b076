"""Fields that change online: retype, promote, demote, relocate, sweep.

A change first rewrites the registry (the field reads from JSON meanwhile), then one job
projects the new typed column into a new store version, and only then does the registry say
the slot is ready.  Readers keep the snapshot they planned with.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import IncompatibleRetype, RetypeInProgress
from ..functions.records import payload, value_of
from ..registry import FieldView, Registry, Slot
from ..types import LIVE, SPARK_TYPE
from .coercion import REJECTED, retype_value


def _tombstone(reg: Registry, field_id: int) -> Registry:
    for s in reg.slots:
        if s.field_id == field_id and s.status in LIVE:
            reg = reg.with_slot(replace(s, status="tombstoned", field_id=None, tombstoned_at=time.time()))
    return reg


def begin_retype(reg: Registry, model_id: int, name: str, target: str, filterable: bool | None = None, only_page: int | None = None) -> tuple[Registry, bool]:
    """One version: new type, old slot tombstoned, new indexed slot reserved.  True if a backfill is due."""
    view = reg.field(model_id, name)
    f = view.field
    if (f.declared_type, target) in REJECTED:
        raise IncompatibleRetype(f"{f.declared_type} cannot become {target}")
    if view.slot is not None and view.slot.status == "backfilling":
        raise RetypeInProgress(f"field {name!r} is being changed")
    new = replace(f, declared_type=target, filterable=f.filterable if filterable is None else filterable)
    reg = _tombstone(reg.with_field(new), f.id)
    if new.filterable:
        reg = reg.reserve(new, "backfilling", indexed_only=True, only_page=only_page)
    due = new.filterable and reg.view(model_id)[name].slot is not None
    return reg.with_pending(f.id, f.declared_type if due else None).bump(), due


def promote(reg: Registry, model_id: int, name: str) -> tuple[Registry, bool]:
    view = reg.field(model_id, name)
    return (reg, False) if view.field.filterable else begin_retype(reg, model_id, name, view.field.declared_type, filterable=True)


def demote(reg: Registry, model_id: int, name: str) -> Registry:
    view = reg.field(model_id, name)
    return begin_retype(reg, model_id, name, view.field.declared_type, filterable=False)[0] if view.field.filterable else reg


def outcome(view: FieldView, source: str) -> Column:
    return retype_value(value_of(payload(F.col("fields")), view.field.name), source, view.field.declared_type)


def backfill(records: DataFrame, view: FieldView, source: str) -> DataFrame:
    """Adds or replaces the field's typed column for every record of the model, deleted ones included.

    The record's group counts as written afterwards, even where the value is absent.
    """
    kind = SPARK_TYPE[view.field.declared_type]
    mine = F.col("model_id") == view.field.model_id
    was = F.col(view.group) if view.group in records.columns else F.lit(False)
    return records.withColumns({view.column: F.when(mine, outcome(view, source)["value"].cast(kind)), view.group: mine | was})


def audit(records: DataFrame, view: FieldView, source: str) -> DataFrame:
    """One row for each value that could not be coerced; absent and null values were not tried."""
    df = records.where(F.col("model_id") == view.field.model_id).select("entry_id", "tenant_id", outcome(view, source)["reason"].alias("reason"))
    return df.where("reason IS NOT NULL")


def finish_retype(reg: Registry, model_id: int, name: str) -> Registry:
    slot = reg.field(model_id, name).slot
    return reg.with_slot(replace(slot, status="ready")).with_pending(slot.field_id, None).bump()


def sweep(reg: Registry, columns: Sequence[str], limit: int = 50) -> tuple[Registry, list[str], list[Slot]]:
    """Tombstoned slots become free, oldest first; gives those of ``columns`` that no field's live slot uses."""
    dead = sorted((s for s in reg.slots if s.status == "tombstoned"), key=lambda s: (s.tombstoned_at or 0, s.page_id, s.column))[:limit]
    for s in dead:
        reg = reg.with_slot(replace(s, status="free", tombstoned_at=None, gaps=0))
    live = {v.column for f in reg.fields if (v := reg.view(f.model_id)[f.name]).slot is not None}
    gone = [c for c in columns if c.startswith("f_") and c not in live]
    return (reg.bump() if dead else reg), gone, dead
