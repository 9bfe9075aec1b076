"""Driver-side planners and the registry."""

from dataclasses import replace

import pytest

from quarryfield.errors import CompactionCapacity
from quarryfield.operators.planning import Capacity, Placed, least_pages, plan_compaction, plan_provisioning
from quarryfield.registry import Registry


@pytest.mark.parametrize("counts,pages", [({}, 0), ({"str": 25}, 1), ({"str": 26}, 2), ({"int": 16}, 2), ({"num": 11}, 2), ({"dt": 11}, 2), ({"str": 1, "dt": 21}, 3)])
def test_least_pages(counts, pages):
    assert least_pages(counts) == pages


def test_provisioning():
    full = {"str": Capacity(60, 60, 60, 60)}
    assert not plan_provisioning(full, {}, 0.2).wanted
    low = plan_provisioning({"str": Capacity(120, 5, 120, 5)}, {}, 0.2)
    assert (low.trigger, dict(low.columns)) == ("low_capacity", {})
    starved = plan_provisioning({"str": Capacity(60, 60, 60, 60), "dt": Capacity(10, 10, 0, 0)}, {"dt": 1}, 0.2)
    assert (starved.trigger, starved.starved, dict(starved.columns)) == ("unsatisfiable_demand", ("dt",), {"dt": 1})
    many = plan_provisioning({"num": Capacity(10, 0, 10, 0)}, {"num": 30}, 0.2)
    assert dict(many.columns) == {"num": 10}


def test_compaction():
    placed = [Placed(1, "str", 1), Placed(2, "str", 2), Placed(3, "str", 3)]
    plan = plan_compaction(placed, {1: {"str": 20}, 2: {"str": 1}, 3: {"str": 1}})
    assert plan.targets == (1,) and [(m.field_id, m.to_page) for m in plan.moves] == [(2, 1), (3, 1)] and plan.unmoved == 1
    two = plan_compaction(placed, {1: {"str": 1}, 2: {}, 3: {}})
    assert two.targets == (1, 2) and len(two.moves) == 1
    with pytest.raises(CompactionCapacity):
        plan_compaction(placed, {1: {"int": 5}, 2: {}, 3: {}})
    assert plan_compaction([], {}).moves == () and plan_compaction(placed[:1], {}).moves == ()


def test_registry():
    reg = Registry().provision(2).define(1, "Model", [("a", "string"), ("b", "int", False)])
    assert reg.version == 2 and len(reg.slots) == 120
    assert reg.define(1, "MODEL", [("A", "int")]) is reg
    more = reg.define(1, "model", [("c", "datetime")])
    assert more.version == 3 and [f.name for f in more.fields] == ["a", "b", "c"]
    assert more.view(1)["a"].typed and not more.view(1)["b"].typed and more.view(1)["c"].slot.page_id == 1
    assert Registry.from_dict(more.to_dict()) == more
    assert more.define(2, "model", []).model(2, "model").id == 2
    for bad in ("", "  ", "x" * 129):
        with pytest.raises(ValueError):
            reg.define(1, bad, [])
    slot = replace(more.free_slots()[0], field_id=more.fields[0].id, status="ready")
    assert more.with_slot(slot).duplicate_live_slots() == [more.fields[0].id]


def test_slot_choice_prefers_pages_that_host_the_model():
    reg = Registry().provision(3).define(1, "one", [("a", "string")])
    moved = replace(reg.view(1)["a"].slot, field_id=None, status="free")
    other = next(s for s in reg.slots if s.page_id == 2 and s.family == "str")
    reg = reg.with_slot(moved).with_slot(replace(other, field_id=1, status="assigned"))
    assert reg.choose_slot(1, "int").page_id == 2 and reg.choose_slot(9, "int").page_id == 1
    bare = reg
    for s in reg.slots:
        if s.page_id == 2 and s.family == "int":
            bare = bare.with_slot(replace(s, indexed=False))
    assert bare.choose_slot(1, "int", indexed_only=True).page_id == 1
