"""Models, fields and slots: an immutable, versioned snapshot that plans are made from.

The registry is small (a row for each declared field and slot), so it lives on the driver;
``to_frames`` gives it as DataFrames to the analytics, which also run over registries of any
size that exist only as tables.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from .errors import FieldNotFound
from .types import DECLARED_TYPES, FAMILY, FAMILY_SLOTS, LIVE, MAX_NAME, QUERYABLE


@dataclass(frozen=True)
class Model:
    id: int
    tenant_id: int
    name: str


@dataclass(frozen=True)
class Field:
    id: int
    model_id: int
    name: str
    declared_type: str
    filterable: bool = False


@dataclass(frozen=True)
class Slot:
    id: int
    page_id: int
    column: str
    family: str
    field_id: int | None = None
    status: str = "free"
    indexed: bool = True
    tombstoned_at: float | None = None
    gaps: int = 0  # sweeps that could not finish


@dataclass(frozen=True)
class FieldView:
    """A field as plans see it: with its live slot, if any."""

    field: Field
    slot: Slot | None

    @property
    def typed(self) -> bool:
        """Read from the typed column; else from the record's JSON."""
        return self.field.filterable and self.slot is not None and self.slot.status in QUERYABLE

    @property
    def column(self) -> str:
        """Named by type too, so that a file written before a change of type is never read as the new one."""
        return f"f_{self.field.id}_{FAMILY[self.field.declared_type]}"

    @property
    def group(self) -> str | None:
        """Column that tells whether the record's field group (the slot's page) was ever written."""
        return f"p_{self.slot.page_id}" if self.slot else None


@dataclass(frozen=True)
class Registry:
    version: int = 0
    models: tuple[Model, ...] = ()
    fields: tuple[Field, ...] = ()
    slots: tuple[Slot, ...] = ()
    pending: tuple[tuple[int, str], ...] = ()  # fields to backfill, with the type their values were declared as
    _views: dict = field(default_factory=dict, compare=False, repr=False)

    # reading

    def model(self, tenant_id: int, name: str) -> Model | None:
        """Names are unique without regard to case."""
        return next((m for m in self.models if m.tenant_id == tenant_id and m.name.casefold() == name.casefold()), None)

    def model_by_id(self, tenant_id: int, model_id: int) -> Model | None:
        return next((m for m in self.models if m.id == model_id and m.tenant_id == tenant_id), None)

    def view(self, model_id: int) -> dict[str, FieldView]:
        """Fields by exact name, in order of id; kept for this version."""
        if model_id not in self._views:
            live = {s.field_id: s for s in self.slots if s.field_id is not None and s.status in LIVE}
            mine = sorted((f for f in self.fields if f.model_id == model_id), key=lambda f: f.id)
            self._views[model_id] = {f.name: FieldView(f, live.get(f.id)) for f in mine}
        return self._views[model_id]

    def field(self, model_id: int, name: str) -> FieldView:
        try:
            return self.view(model_id)[name]
        except KeyError:
            raise FieldNotFound(f"no field {name!r}") from None

    def listing(self, tenant_id: int) -> list[dict]:
        return [self.describe(m) for m in sorted(self.models, key=lambda m: m.id) if m.tenant_id == tenant_id]

    def describe(self, model: Model) -> dict:
        fields = [{"id": v.field.id, "name": v.field.name, "type": v.field.declared_type, "isFilterable": v.field.filterable, "isIndexed": v.typed} for v in self.view(model.id).values()]
        return {"id": model.id, "name": model.name, "fields": fields}

    def free_slots(self, indexed_only: bool = False) -> list[Slot]:
        return sorted((s for s in self.slots if s.status == "free" and (s.indexed or not indexed_only)), key=lambda s: (s.page_id, s.id))

    def hosting_pages(self, model_id: int) -> set[int]:
        own = {f.id for f in self.fields if f.model_id == model_id}
        return {s.page_id for s in self.slots if s.field_id in own and s.status in LIVE}

    def duplicate_live_slots(self) -> list[int]:
        """Fields with more than one live slot; the invariant is that there are none."""
        seen: dict[int, int] = {}
        for s in self.slots:
            if s.field_id is not None and s.status in LIVE:
                seen[s.field_id] = seen.get(s.field_id, 0) + 1
        return sorted(f for f, n in seen.items() if n > 1)

    # changing: each gives a new registry with the version one higher

    def _next(self, **changes) -> "Registry":
        return replace(self, version=self.version + 1, _views={}, **changes)

    def define(self, tenant_id: int, name: str, fields: Iterable[tuple[str, str] | tuple[str, str, bool]], reserve: bool = True) -> "Registry":
        """Get or create a model and its fields; existing fields keep their type.  One version for the whole call."""
        reg, changed = self, False
        model = self.model(tenant_id, _name(name))
        if model is None:
            model = Model(max((m.id for m in self.models), default=0) + 1, tenant_id, name)
            reg, changed = replace(reg, models=(*reg.models, model), _views={}), True
        for f in fields:
            fname, kind, filterable = (*f, True)[:3]
            if kind not in DECLARED_TYPES:
                raise ValueError(f"no declared type {kind!r}")
            if any(x.name.casefold() == _name(fname).casefold() for x in reg.fields if x.model_id == model.id):
                continue
            new = Field(max((x.id for x in reg.fields), default=0) + 1, model.id, fname, kind, filterable)
            reg, changed = replace(reg, fields=(*reg.fields, new), _views={}), True
            if filterable and reserve:
                reg = reg.reserve(new, "assigned")
        return replace(reg, version=self.version + 1) if changed else self

    def provision(self, pages: int = 1, indexed: dict[str, int] | None = None) -> "Registry":
        """Append pages of 60 free slots; ``indexed``: how many of each family are indexed (all if None)."""
        slots, page, sid = list(self.slots), max((s.page_id for s in self.slots), default=0), max((s.id for s in self.slots), default=0)
        for _ in range(pages):
            page += 1
            for family, n in FAMILY_SLOTS.items():
                for i in range(n):
                    sid += 1
                    slots.append(Slot(sid, page, f"i_{family}_{i + 1:02d}", family, indexed=indexed is None or i < indexed.get(family, 0)))
        return self._next(slots=tuple(slots))

    def choose_slot(self, model_id: int, family: str, indexed_only: bool = False, avoid_pages: Iterable[int] = (), only_page: int | None = None) -> Slot | None:
        """A page that hosts the model already comes first, then the oldest; an indexed slot matters more than either."""
        host, avoid = self.hosting_pages(model_id), set(avoid_pages)
        free = [s for s in self.free_slots(indexed_only) if s.family == family and s.page_id not in avoid and only_page in (None, s.page_id)]
        return min(free, key=lambda s: (s.page_id not in host, s.page_id, s.id), default=None)

    def reserve(self, f: Field, status: str, indexed_only: bool = False, only_page: int | None = None) -> "Registry":
        """Give the field a slot if one is free; otherwise it stays unmapped."""
        slot = self.choose_slot(f.model_id, FAMILY[f.declared_type], indexed_only, only_page=only_page)
        return self if slot is None else self.with_slot(replace(slot, field_id=f.id, status=status))

    def with_slot(self, slot: Slot) -> "Registry":
        return replace(self, slots=tuple(slot if s.id == slot.id else s for s in self.slots), _views={})

    def with_field(self, f: Field) -> "Registry":
        return replace(self, fields=tuple(f if x.id == f.id else x for x in self.fields), _views={})

    def with_pending(self, field_id: int, source: str | None) -> "Registry":
        """Notes that a field is to be backfilled from that type; None: not any more."""
        return replace(self, pending=(*(p for p in self.pending if p[0] != field_id), *([(field_id, source)] if source else [])))

    def bump(self) -> "Registry":
        return self._next()

    def to_dict(self) -> dict:
        return {"version": self.version, "pending": [list(p) for p in self.pending], **{k: [asdict(x) for x in getattr(self, k)] for k in ("models", "fields", "slots")}}

    @staticmethod
    def from_dict(d: dict) -> "Registry":
        return Registry(d["version"], tuple(Model(**x) for x in d["models"]), tuple(Field(**x) for x in d["fields"]), tuple(Slot(**x) for x in d["slots"]), tuple((f, t) for f, t in d.get("pending", ())))

    def to_frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {
            "models": spark.createDataFrame([(m.id, m.tenant_id, m.name) for m in self.models], "id int, tenant_id long, name string"),
            "fields": spark.createDataFrame([(f.id, f.model_id, f.name, f.declared_type, f.filterable) for f in self.fields], "id long, model_id int, name string, declared_type string, is_filterable boolean"),
            "slots": spark.createDataFrame(
                [(s.id, s.page_id, s.column, s.family, s.field_id, s.status, s.indexed) for s in self.slots],
                "id long, page_id int, slot_column string, slot_type string, field_id long, status string, is_indexed boolean",
            ),
        }


def _name(name: str) -> str:
    if not name.strip() or len(name.encode()) > MAX_NAME:
        raise ValueError(f"a name is not blank and has at most {MAX_NAME} bytes: {name!r}")
    return name
