"""The engine end to end: writes, reads, changes of type, queues, exports."""

import glob
import json
from datetime import datetime, timedelta

import pytest

from quarryfield.engine import Engine
from quarryfield.errors import ActiveExportCap, ArtifactError, CompactionCapacity, EntryNotFound, FieldNotFilterable, IncompatibleRetype, MalformedPayload, PayloadTooLarge, QuarantineEmpty, UncoercibleValue
from quarryfield.events import VOCABULARY, Events
from quarryfield.operators.planning import CompactionPlan
from quarryfield.streaming.outbox import enqueue
from quarryfield.types import Settings

COMPANIES = [
    ("Acme Corp", "manufacturing", 340, "1998-04-12"), ("Globex", "energy", 85, "2011-09-01"), ("Initech", "software", 510, "2003-01-20"), ("Umbrella", "pharma", 1200, "1990-06-30"), ("Hooli", "software", 240, "2009-11-11"),
]


@pytest.fixture
def engine(spark, tmp_path):
    seen = []
    e = Engine(spark, f"file://{tmp_path}/store", events=Events(sink=seen.append))
    e.seen = seen
    e.provision(2)
    return e


def leaf(op, name, *value):
    return {"op": op, "field": {"model": "company", "name": name}} | ({"value": value[0]} if value else {})


def text(node):
    return json.dumps({"version": "1", "filter": node})


def company(engine):
    m = engine.define_model(1, "company", [("name", "string"), ("industry", "string"), ("employees", "int"), ("founded", "datetime"), ("note", "string", False)])
    rows = [{"tenantId": 1, "modelId": m, "fields": {"name": n, "industry": i, "employees": k, "founded": f"{d}T00:00:00+00:00", "extra": [1]}} for n, i, k, d in COMPANIES]
    assert [c["status"] for c in engine.bulk_write(rows)] == ["committed"]
    return m


def test_search_pages_and_isolation(engine):
    m = company(engine)
    got = engine.search(1, m, text({"op": "and", "args": [leaf("eq", "industry", "software"), leaf("gt", "employees", 100)]}), ["name", "founded"])
    assert [r["name"] for r in got.rows] == ["Initech", "Hooli"] and got.rows[0]["founded"] == "2003-01-20 00:00:00" and got.next_cursor is None
    names, cursor = [], None
    while True:
        page = engine.search(1, m, None, ["name"], 2, cursor)
        names += [r["name"] for r in page.rows]
        cursor = page.next_cursor
        if cursor is None:
            break
    assert names == [c[0] for c in COMPANIES]
    other = engine.define_model(2, "company", [("name", "string")])
    engine.write(2, other, {"name": "Acme Corp"})
    assert engine.scan(1, m).count() == 5 and engine.scan(2, other).count() == 1
    assert engine.get(2, 1) is None and json.loads(engine.get(1, 1)["fields"])["extra"] == [1]
    assert [r["name"] for r in engine.search(1, m, text({"op": "not", "arg": leaf("eq", "industry", "software")}), ["name"]).rows] == ["Acme Corp", "Globex", "Umbrella"]
    with pytest.raises(FieldNotFilterable):
        engine.search(1, m, text(leaf("eq", "note", "x")))
    assert {e["event"] for e in engine.seen} >= {"bulk_chunk_committed", "entry_written", "search_request", "pre_flight_rejected"}
    assert all(e["event"] in VOCABULARY[e["source"]] for e in engine.seen)


def test_null_absent_and_update(engine):
    m = engine.define_model(1, "m", [("name", "string"), ("industry", "string")])
    ids = [engine.write(1, m, f) for f in ({"name": "a"}, {"name": "b", "industry": None}, {"other": 1}, {"name": "d", "industry": "x"})]
    f = lambda op, *v: [r["entry_id"] for r in engine.search(1, m, json.dumps({"filter": {"op": op, "field": {"model": "m", "name": "industry"}} | ({"value": v[0]} if v else {})})).rows]
    assert f("is_null") == [ids[0], ids[1]] and f("is_not_null") == [ids[3]] and f("neq", "y") == [ids[3]]
    engine.update(1, ids[3], {"name": "d2"})
    row = engine.get(1, ids[3])
    assert json.loads(row["fields"]) == {"name": "d2"} and f("is_not_null") == [] and ids[3] in f("is_null")
    engine.update(1, ids[2], {"industry": "z", "name": None})
    assert f("eq", "z") == [ids[2]]
    assert engine.delete(1, ids[0]) and not engine.delete(1, ids[0]) and engine.get(1, ids[0]) is None
    with pytest.raises(EntryNotFound):
        engine.update(1, ids[0], {})
    assert engine.scan(1, m).count() == 3
    assert engine.write(1, m, {"name": "e"}) == ids[-1] + 1


def test_bulk_chunks_and_envelopes(engine):
    m = engine.define_model(1, "m", [("n", "int")])
    rows = [{"tenantId": 1, "modelId": m, "fields": {"n": v}} for v in (1, 2, 3, "bad", 5, 6, 7)]
    assert [c["status"] for c in engine.bulk_write(rows, 3)] == ["committed", "rolled_back", "committed"]
    assert engine.scan(1, m).count() == 4
    with pytest.raises(UncoercibleValue):
        engine.write(1, m, {"n": 1.5})
    with pytest.raises(PayloadTooLarge):
        engine.bulk_write([rows[0]] * 1001)
    for raw, key in [([{"tenantId": 1, "modelId": m, "fields": []}], "[0].fields"), ([rows[0], {"tenantId": 1, "modelId": "x", "fields": {}}], "[1].modelId"), ([{"modelId": 1, "fields": {}}], "[0].tenantId"), ("{}", "")]:
        with pytest.raises(MalformedPayload) as e:
            engine.bulk_write(raw)
        assert e.value.key == key
    batch = engine.spark.createDataFrame([(i, 1, m, json.dumps({"n": i if i != 600 else "x"})) for i in range(1200)], "idx long, tenant_id long, model_id int, fields string").repartition(5)
    manifest = {r["chunk"]: r["status"] for r in engine.ingest(batch, 1, m).collect()}
    assert manifest == {0: "committed", 1: "rolled_back", 2: "committed"}
    got = engine.scan(1, m).collect()
    assert len(got) == 4 + 700 and len({r["entry_id"] for r in got}) == 704


def test_retype_promote_demote_sweep(engine):
    m = engine.define_model(1, "m", [("s", "string"), ("x", "numeric", False)])
    for v in ("42", "-1", "hello", "3.5", None):
        engine.write(1, m, {"s": v, "x": 1.5})
    engine.delete(1, 1)
    audit = engine.retype_field(1, m, "s", "int")
    assert sorted((r["entry_id"], r["reason"]) for r in audit.collect()) == [(3, "unparseable"), (4, "unparseable")]
    assert [r["s"] for r in engine.scan(1, m, None, ["s"]).orderBy("entry_id").collect()] == [-1, None, None, None]
    assert engine.records().where("entry_id = 1").select(engine.registry.view(m)["s"].column).first()[0] == 42
    with pytest.raises(IncompatibleRetype):
        engine.retype_field(1, m, "s", "datetime")
    engine.promote(1, m, "x")
    f = json.dumps({"filter": {"op": "gt", "field": {"model": "m", "name": "x"}, "value": 1}})
    assert engine.scan(1, m, f).count() == 4
    engine.demote(1, m, "x")
    with pytest.raises(FieldNotFilterable):
        engine.scan(1, m, f)
    assert engine.retype_field(1, m, "s", "string").count() == 2
    assert [r["s"] for r in engine.scan(1, m, None, ["s"]).orderBy("entry_id").collect()] == ["-1", None, None, None]
    assert engine.sweep() == 3 and engine.sweep() == 0


def test_imports_and_quarantine(engine):
    m = engine.define_model(1, "m", [("n", "int")])
    good = [{"tenantId": 1, "modelId": m, "fields": {"n": i}} for i in range(3)]
    job = engine.submit_bulk_write(good, "key")
    assert engine.submit_bulk_write(good, "key").id == job.id
    done = engine.run_next_import()
    assert (done.status, done.manifest) == ("completed", {"chunks": 1, "entries_written": 3}) and engine.scan(1, m).count() == 3
    engine.submit_bulk_write(good + [{"tenantId": 1, "modelId": m, "fields": {"n": "bad"}}])
    assert engine.run_next_import().status == "failed" and engine.run_next_import() is None
    assert [r["reason"] for r in engine.quarantined().collect()] == ["other"] and engine.scan(1, m).count() == 3
    assert engine.replay(reason="other") == 0 and engine.quarantined().count() == 0
    with pytest.raises(QuarantineEmpty):
        engine.replay(reason="other")
    for bad in ([], [good[0], {"tenantId": 2, "modelId": m, "fields": {}}]):
        with pytest.raises(MalformedPayload):
            engine.submit_bulk_write(bad)
    stuck = engine.imports.submit(1, artifact_path="none")
    engine.imports.update(stuck.id, status="processing", heartbeat_at=datetime(2000, 1, 1))
    assert engine.imports.claim().id == stuck.id


def test_outbox_fills_in_what_had_no_slot(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    m = e.define_model(1, "m", [("n", "int")])
    e.write(1, m, {"n": 5})
    e.write(1, m, {"n": "bad"})
    f = json.dumps({"filter": {"op": "eq", "field": {"model": "m", "name": "n"}, "value": 5}})
    with pytest.raises(FieldNotFilterable):
        e.scan(1, m, f)
    assert e.watch().trigger == "unsatisfiable_demand"
    e.drain_outbox()
    assert [r["entry_id"] for r in e.scan(1, m, f).collect()] == [1]
    assert [(r["entry_id"], r["reason"]) for r in e.quarantined().collect()] == [(2, "schema_incompatibility")]
    version = e.store.version()
    e.drain_outbox()
    assert e.store.version() == version
    assert not e.watch().wanted


def artifact(path):
    (name,) = glob.glob(path.removeprefix("file://") + "/part-*")
    with open(name, "rb") as f:
        return f.read()


def test_exports(engine):
    m = engine.define_model(1, "m", [("zebra", "string"), ("alpha", "numeric"), ("mango", "string", False)])
    for z in ("plain", "has,comma", 'has "quote"', "has\nnewline", "nul\0"):
        engine.write(1, m, {"zebra": z, "alpha": 1.0, "mango": {"a": [1]}, "more": True})
    engine.write(1, m, {"mango": False})
    job = engine.submit_export(1, m, "csv")
    done = engine.run_next_export()
    assert artifact(done.artifact_path) == b'alpha,mango,zebra\r\n1,"{""a"":[1]}",plain\r\n1,"{""a"":[1]}","has,comma"\r\n1,"{""a"":[1]}","has ""quote"""\r\n1,"{""a"":[1]}","has\nnewline"\r\n,false,\r\n'
    assert done.manifest == {"skipped": 1} and engine.get_export(1, job.id).status == "completed" and engine.get_export(2, job.id) is None
    f = json.dumps({"filter": {"op": "eq", "field": {"model": "m", "name": "zebra"}, "value": "plain"}})
    engine.submit_export(1, m, "json", f)
    assert [r["zebra"] for r in json.loads(artifact(engine.run_next_export().artifact_path))] == ["plain"]
    engine.submit_export(1, m, "json", f)
    assert len(json.loads(artifact(engine.run_next_export(apply_filter=False).artifact_path))) == 6
    empty = engine.define_model(1, "none", [])
    engine.submit_export(1, empty, "json")
    assert json.loads(artifact(engine.run_next_export().artifact_path)) == []
    for _ in range(3):
        engine.submit_export(1, m, "csv")
    with pytest.raises(ActiveExportCap):
        engine.submit_export(1, m, "csv")
    with pytest.raises(ValueError):
        engine.submit_export(2, m, "xml")
    engine.exports.submit_export(2, 1, "csv")
    assert engine.exports.claim(fair=True).tenant_id == 1
    engine.settings = Settings(export_max_bytes=10)
    with pytest.raises(ArtifactError):
        engine.run_next_export()
        engine.run_next_export()


def test_garbage(engine):
    now = datetime(2026, 1, 10)
    engine.exports.clock = lambda: now
    a = engine.exports.submit(1, artifact_path="a")
    b = engine.exports.submit(1, artifact_path="b")
    engine.exports.update(a.id, status="completed", completed_at=now - timedelta(days=2))
    engine.exports.update(b.id, status="failed", completed_at=now - timedelta(minutes=5))
    gone = []
    assert engine.exports.collect_garbage(gone.append) == 1 and gone == ["a"] and engine.exports.collect_garbage(gone.append) == 0


def test_compaction_keeps_values(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    e.provision(1)
    m = e.define_model(1, "m", [(f"s{i}", "string") for i in range(25)])
    e.provision(1)
    e.registry = e.registry.define(1, "m", [("t", "string")])
    assert e.registry.hosting_pages(m) == {1, 2}
    assert e.compact_model(1, m).moves == ()
    e.demote(1, m, "s0")
    e.sweep()
    e.write(1, m, {"t": "hello", "s1": "x"})
    plan = e.compact_model(1, m, dry_run=True)
    assert isinstance(plan, CompactionPlan) and len(plan.moves) == 1 and e.registry.hosting_pages(m) == {1, 2}
    e.compact_model(1, m)
    assert e.registry.hosting_pages(m) == {1}
    assert [r["t"] for r in e.scan(1, m, None, ["t"]).collect()] == ["hello"]
    with pytest.raises(CompactionCapacity):
        from quarryfield.operators.planning import Placed, plan_compaction

        plan_compaction([Placed(1, "str", 1), Placed(2, "str", 2)], {})


def test_state_survives(engine, spark):
    m = company(engine)
    engine.submit_export(1, m, "csv")
    engine.save()
    again = Engine(spark, engine.root)
    again.load()
    assert again.registry == engine.registry and again.exports.rows == engine.exports.rows
    assert again.scan(1, m).count() == 5 and again.list_models(1)[0]["name"] == "company"
    assert again.write(1, m, {"name": "New"}) == 6


def test_injected_driver(spark, tmp_path):
    from quarryfield.operators.search import Page

    class Stub:
        def list(self, request, fields):
            return Page([{"entry_id": 9}], None, request.page_size)

        def get(self, tenant_id, entry_id):
            return {"entry_id": entry_id}

        def supported_operators(self):
            return frozenset({"eq", "fuzzy"})

        def supports_filter_on(self, view):
            return True

        def supports_fuzzy_search(self):
            return True

        def consistency(self):
            return "eventual"

    e = Engine(spark, f"file://{tmp_path}/s", driver=Stub())
    e.provision(1)
    m = e.define_model(1, "m", [("s", "string")])
    assert e.search(1, m).rows == [{"entry_id": 9}] and e.get(1, 4) == {"entry_id": 4}
    with pytest.raises(Exception, match="capability_unsupported"):
        e.search(1, m, json.dumps({"filter": {"op": "neq", "field": {"model": "m", "name": "s"}, "value": "x"}}))


def test_collect_garbage_deletes_artifacts(engine):
    m = company(engine)
    engine.submit_export(1, m, "csv")
    done = engine.run_next_export()
    engine.exports.update(done.id, completed_at=datetime(2000, 1, 1))
    assert engine.collect_garbage() == 1 and not glob.glob(done.artifact_path.removeprefix("file://")) and engine.collect_garbage() == 0
    engine.settings = Settings(min_free_space=1.1)
    engine.submit_export(1, m, "csv")
    assert engine.run_next_export() is None and engine.seen[-1]["event"] == "low_disk"


def test_advisories_after_a_change_of_type(engine):
    m = company(engine)
    engine.retype_field(1, m, "employees", "numeric")
    assert {e["column"] for e in engine.seen if e["event"] == "low_cardinality_index"} == {"name", "industry", "employees", "founded"}
    assert [e["event"] for e in engine.seen if e["source"] == "registry"][-2:] != [] and any(e["event"] == "spread_sampled" for e in engine.seen)


def test_command_line(engine, spark, capsys):
    from quarryfield.cli import main

    m = company(engine)
    engine.submit_export(1, m, "json")
    engine.save()
    root = ["--root", engine.root]
    assert main([*root, "export"]) == 0 and main([*root, "spread"]) == 0 and main([*root, "sweep"]) == 0 and main([*root, "watch"]) == 0
    assert main([*root, "compact", "1", str(m), "--dry-run"]) == 0
    assert main([*root, "replay", "--reason", "other"]) == 1 and main([*root, "nonsense"]) == 2
    again = Engine(spark, engine.root)
    again.load()
    assert again.exports.rows[1].status == "completed"
    assert '"moves": 0' in capsys.readouterr().out


def test_reconcile_waits_for_capacity(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    m = e.define_model(1, "m", [("n", "int")])
    assert e.reconcile() == "capacity_wait"
    e.write(1, m, {"n": 5})
    e.watch()
    e.submit_bulk_write([{"tenantId": 1, "modelId": m, "fields": {"n": 6}}])
    assert e.reconcile() == "import" and e.reconcile() == "idle"
    f = json.dumps({"filter": {"op": "gte", "field": {"model": "m", "name": "n"}, "value": 5}})
    assert [r["entry_id"] for r in e.scan(1, m, f).orderBy("entry_id").collect()] == [1, 2]


def test_queued_entries_wait_for_capacity(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    m = e.define_model(1, "m", [("n", "int")])
    e.write(1, m, {"n": 5})
    assert e.reconcile() == "capacity_wait" and e.reconcile() == "capacity_wait"
    e.watch()
    assert e.reconcile() == "idle"
    f = json.dumps({"filter": {"op": "eq", "field": {"model": "m", "name": "n"}, "value": 5}})
    assert [r["entry_id"] for r in e.scan(1, m, f).collect()] == [1]
    version = e.store.version()
    assert e.reconcile() == "idle" and e.store.version() == version


def test_missing_queued_entries_are_quarantined_once(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    ids = [e.define_model(1, name, [("n", "int")]) for name in ("a", "b")]
    e.write(1, ids[0], {"n": 5})
    e.write(1, ids[1], {"n": 6})
    enqueue(spark.createDataFrame([(999,)], "entry_id long"), f"file://{tmp_path}/store/outbox")
    e.drain_outbox()
    e.drain_outbox()
    assert [(r["entry_id"], r["reason"]) for r in e.quarantined().collect()] == [(999, "missing_entry_data")]
