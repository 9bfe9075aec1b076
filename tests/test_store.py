"""The store under failures and several writers; ids and imports that lose and repeat nothing."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarryfield.engine import Engine
from quarryfield.errors import ArtifactError, ConcurrentWrite, EntryNotFound
from quarryfield.events import Events
from quarryfield.operators import ingest
from quarryfield.sources.store import Store
from quarryfield.types import Settings

ROWS = "entry_id long, tenant_id long, model_id int, s string"


def ids(df):
    return sorted(r["entry_id"] for r in df.select("entry_id").collect())


@pytest.mark.parametrize("aqe", ["true", "false"])
def test_ingest_stores_every_row_once(spark, tmp_path, aqe):
    """Payloads are read back: a count alone would not read them, and a plan without them may differ."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        e = Engine(spark, f"file://{tmp_path}/store")
        e.provision()
        m = e.define_model(1, "m", [("n", "int"), ("s", "string")])
        n = 150_000
        spark.range(n, numPartitions=7).select(
            F.col("id").alias("idx"), F.lit(1).cast("long").alias("tenant_id"), F.lit(m).alias("model_id"),
            F.to_json(F.struct(F.col("id").alias("n"), F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha2(F.col("id").cast("string"), 256)).alias("s"))).alias("fields"),
        ).repartition(9).write.parquet(f"{tmp_path}/rows")
        for step, rows in enumerate((spark.read.parquet(f"{tmp_path}/rows"), spark.read.parquet(f"{tmp_path}/rows").dropDuplicates(["idx"]))):
            manifest = e.ingest(rows, 1, m)
            assert manifest.where("status = 'committed'").agg(F.sum("rows")).first()[0] == n
            out = f"{tmp_path}/out-{step}"
            e.scan(1, m).where(F.col("entry_id") > step * n).write.parquet(out)
            back = spark.read.parquet(out)
            assert back.agg(F.count("s"), F.count_distinct("s"), F.count_distinct("entry_id"), F.min("entry_id"), F.max("entry_id")).first()[:] == (n, n, n, step * n + 1, (step + 1) * n)
            assert back.where(F.col("entry_id") != F.col("n") + 1 + step * n).isEmpty()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_numbers_of_repeated_places(spark, tmp_path):
    rows = spark.createDataFrame([(i // 3, "x" * 50) for i in range(900)], "idx long, s string").repartition(5)
    got = sorted((r["entry_id"], r["idx"]) for r in ingest.assign_ids(rows, 10, f"{tmp_path}/ids").collect())
    assert [g[0] for g in got] == list(range(10, 910)) and [g[1] for g in got] == sorted(i // 3 for i in range(900))


def test_a_driver_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    s = Store(spark, f"file://{tmp_path}/s")
    assert s.version() is None and s.read() is None
    frame = lambda a, b: spark.createDataFrame([(i, 1, 1, f"v{i}") for i in range(a, b)], ROWS)
    s.append(frame(0, 10))
    s.write_text("STATE", "one")

    def die(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(s, "_claim", die)
    for change in (lambda: s.append(frame(10, 20)), lambda: s.write(frame(0, 1)), lambda: s.rewrite(F.col("entry_id") == 3, lambda df: [df.where("entry_id != 3")]), lambda: s.write_text("STATE", "two")):
        with pytest.raises(KeyboardInterrupt):
            change()
    again = Store(spark, f"file://{tmp_path}/s")
    assert ids(again.read()) == list(range(10)) and again.read_text("STATE") == "one"
    again.append(frame(10, 12))
    again.write_text("STATE", "two")
    assert ids(again.read()) == list(range(12)) and again.read_text("STATE") == "two"
    assert again.vacuum() == 3 and ids(again.read()) == list(range(12))


def test_rewrites_touch_only_the_files_they_must(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    for t in (1, 2):
        for at in (0, 100):
            s.append(spark.createDataFrame([(t * 1000 + at + i, t, 1, "old") for i in range(50)], ROWS).coalesce(1))
    before = s._state()[1]["batches"]
    reader = s.read()
    s.rewrite((F.col("tenant_id") == 2) & (F.col("entry_id") == 2103), lambda df: [df.withColumn("s", F.when(F.col("entry_id") == 2103, "new").otherwise(F.col("s")))])
    after = s._state()[1]["batches"]
    assert len(set(before) - set(after)) == 1 and len(set(after) - set(before)) == 1
    assert [(r["entry_id"], r["s"]) for r in s.read().where("s = 'new'").collect()] == [(2103, "new")] and s.read().count() == 200
    assert reader.count() == 200  # its files are still there
    keys = spark.createDataFrame([(1, 1, 1001), (2, 1, 2001)], "tenant_id long, model_id int, entry_id long")
    s.rewrite(keys, lambda df: [df.where("entry_id % 1000 != 1")])
    assert s.read().count() == 198
    assert s.rewrite(F.col("entry_id") == 5, lambda df: [df]) == s.version()


def test_part_of_a_batch_is_rewritten(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.append(spark.createDataFrame([(i, i % 4 + 1, 1, "old") for i in range(40)], ROWS).coalesce(1))
    for t in (1, 2):
        s.rewrite(F.col("tenant_id") == t, lambda df: [df.withColumn("s", F.lit("new"))])
    assert sorted(tuple(r) for r in s.read().groupBy("tenant_id", "s").count().collect()) == [(1, "new", 10), (2, "new", 10), (3, "old", 10), (4, "old", 10)]
    (left,) = [v for v in s._state()[1]["batches"].values() if v is not None]
    assert len(left) == 2


def test_two_writers(spark, tmp_path, monkeypatch):
    a, b = (Engine(spark, f"file://{tmp_path}/store") for _ in range(2))
    a.provision()
    m = a.define_model(1, "m", [("n", "int")])
    b.registry = a.registry
    assert [a.write(1, m, {"n": 1}), b.write(1, m, {"n": 2}), a.write(1, m, {"n": 3})] == [1, 2, 3]
    assert b.scan(1, m).count() == 3

    frame = lambda i: spark.createDataFrame([(i, 1, m, "x")], ROWS)
    state, raced = Store._state, []

    def late(self, version=None):
        got = state(self, version)
        if not raced:
            raced.append(1)
            Store(spark, self.root).append(frame(100))  # another writer comes first
        return got

    monkeypatch.setattr(Store, "_state", late)
    a.store.append(frame(101))
    assert {100, 101} <= set(ids(a.store.read()))
    raced.clear()
    with pytest.raises(ConcurrentWrite):
        a.store.rewrite(F.col("entry_id") == 1, lambda df: [df])
    assert ids(a.store.read()).count(1) == 1


def entities(models, n, bad=()):
    return [{"tenantId": 1, "modelId": models[i % len(models)], "fields": {"n": "bad" if i in bad else i}} for i in range(n)]


def stored(e, models):
    return sorted(r["n"] for m in models for r in e.scan(1, m, None, ["n"]).collect())


@pytest.mark.parametrize("die_at", [0, 1, 2, 3])
def test_a_killed_import_goes_on_where_it_stopped(spark, tmp_path, monkeypatch, die_at):
    now = [datetime(2026, 1, 1)]
    make = lambda: Engine(spark, f"file://{tmp_path}/store", Settings(bulk_chunk=2, import_round=1), clock=lambda: now[0])
    e = make()
    e.provision()
    models = [e.define_model(1, name, [("n", "int")]) for name in "ab"]
    e.submit_bulk_write(entities(models, 8))
    e.save()
    rounds, append = [], e.store.append

    def dying(*frames, **notes):
        rounds.append(1)
        if die_at % 2 == 0 and len(rounds) == die_at // 2 + 2:
            raise KeyboardInterrupt  # before the round counts
        got = append(*frames, **notes)
        if die_at % 2 == 1 and len(rounds) == die_at // 2 + 2:
            raise KeyboardInterrupt  # after it counts, before the job table knows
        return got

    monkeypatch.setattr(e.store, "append", dying)
    with pytest.raises(KeyboardInterrupt):
        e.run_next_import()
    e.save()
    again = make()
    again.load()
    assert again.run_next_import() is None  # its lease still runs
    now[0] += timedelta(hours=1)
    job = again.run_next_import()
    assert job.status == "completed" and job.manifest == {"chunks": 4, "entries_written": 8}
    assert stored(again, models) == list(range(8))


def test_an_import_stops_at_its_first_bad_chunk(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store", Settings(bulk_chunk=2))
    e.provision()
    models = [e.define_model(1, name, [("n", "int")]) for name in "ab"]
    e.submit_bulk_write(entities(models, 12, bad=(5, 10)))
    job = e.run_next_import()
    assert job.status == "failed" and job.manifest == {"chunks": 2, "entries_written": 4} and stored(e, models) == [0, 1, 2, 3]
    assert [r["error_message"] for r in e.quarantined().collect()] == ["n: unparseable"]


def test_a_worker_that_lost_its_lease_gives_up(spark, tmp_path, monkeypatch):
    seen = []
    e = Engine(spark, f"file://{tmp_path}/store", Settings(bulk_chunk=2, import_round=1), events=Events(sink=seen.append))
    e.provision()
    m = e.define_model(1, "m", [("n", "int")])
    job = e.submit_bulk_write(entities([m], 6))
    append = e.store.append

    def robbed(*frames, **notes):
        got = append(*frames, **notes)
        e.imports.update(job.id, worker="another")
        return got

    monkeypatch.setattr(e.store, "append", robbed)
    assert e.run_next_import().worker == "another" and [x["event"] for x in seen][-1] == "lease_lost"
    monkeypatch.undo()
    e.imports.update(job.id, heartbeat_at=datetime(2000, 1, 1))
    assert e.run_next_import().status == "completed" and stored(e, [m]) == list(range(6))


def test_a_damaged_artifact_is_rejected(spark, tmp_path):
    from quarryfield.operators.jobs import import_artifact, read_artifact

    _, lines = import_artifact([{"tenant_id": 1, "model_id": 1, "fields": {"a": i, "b": "x\ny"}} for i in range(5)])
    for name, text in (("half", lines[:4] + [lines[4][:20]]), ("gap", lines[:2] + lines[3:]), ("twice", lines + lines[:1]), ("empty", [])):
        spark.createDataFrame([(x,) for x in text], "value string").write.text(f"{tmp_path}/{name}")
        with pytest.raises(ArtifactError):
            read_artifact(spark, f"{tmp_path}/{name}")
    spark.createDataFrame([(x,) for x in lines], "value string").repartition(3).write.text(f"{tmp_path}/fine")
    assert sorted(json.loads(r["fields"])["a"] for r in read_artifact(spark, f"{tmp_path}/fine").collect()) == list(range(5))


def test_a_batch_of_the_outbox_that_failed_runs_again(spark, tmp_path, monkeypatch):
    e = Engine(spark, f"file://{tmp_path}/store")
    models = [e.define_model(1, name, [("n", "int")]) for name in "ab"]
    for i, m in enumerate(models * 2):
        e.write(1, m, {"n": i if i != 3 else "bad"})
    e.watch()
    rewrite = e.store.rewrite

    def die(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(e.store, "rewrite", die)
    with pytest.raises(Exception):
        e.drain_outbox()
    monkeypatch.setattr(e.store, "rewrite", rewrite)
    e.drain_outbox()
    assert [(r["entry_id"], r["reason"]) for r in e.quarantined().collect()] == [(4, "schema_incompatibility")]
    f = lambda m: json.dumps({"filter": {"op": "is_not_null", "field": {"model": "x", "name": "n"}}})
    assert [ids(e.scan(1, m, f(m))) for m in models] == [[1, 3], [2]]
    e.delete(1, 1)
    with pytest.raises(EntryNotFound):
        e.update(1, 1, {})


def test_a_change_of_type_is_finished_by_another_driver(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    e.provision()
    m, other = (e.define_model(1, name, [("s", "string")]) for name in "ab")
    for v in ("42", "x"):
        e.write(1, m, {"s": v})
    e.write(1, other, {"s": "kept"})
    assert e.retype_field(1, m, "s", "int", later=True) is None
    e.save()
    e = Engine(spark, e.root)
    e.load()
    f = json.dumps({"filter": {"op": "eq", "field": {"model": "a", "name": "s"}, "value": 42}})
    with pytest.raises(Exception, match="backfilling"):
        e.scan(1, m, f)
    before = {b for b, files in e.store._state()[1]["batches"].items()}
    assert e.reconcile() == "retype" and e.reconcile() == "idle"
    assert ids(e.scan(1, m, f)) == [1]
    assert len(before & set(e.store._state()[1]["batches"])) == 1  # the other model's file stays
    assert [r["s"] for r in e.scan(1, other, None, ["s"]).collect()] == ["kept"]
    e.retype_field(1, m, "s", "string")
    e.sweep()
    assert [r["s"] for r in e.scan(1, m, None, ["s"]).orderBy("entry_id").collect()] == ["42", None]
    assert [r["s"] for r in e.scan(1, other, None, ["s"]).collect()] == ["kept"]
    assert all(c.startswith(("f_1_str", "f_2_str")) for c in e.records().columns if c.startswith("f_"))


def test_exports_are_tried_again(spark, tmp_path, monkeypatch):
    from quarryfield.operators import export

    waited = []
    e = Engine(spark, f"file://{tmp_path}/store", sleep=waited.append)
    e.provision()
    m = e.define_model(1, "m", [("n", "int")])
    e.write(1, m, {"n": 1})
    e.submit_export(1, m, "json")
    write, failures = export.write_json, [OSError(), OSError()]

    def flaky(*args):
        if failures:
            raise failures.pop()
        return write(*args)

    monkeypatch.setattr(export, "write_json", flaky)
    assert e.run_next_export().status == "completed" and waited == [1, 4]
    failures.extend(OSError() for _ in range(4))
    e.submit_export(1, m, "json")
    with pytest.raises(OSError):
        e.run_next_export()
    assert waited == [1, 4, 1, 4, 16] and e.exports.rows[2].failed_reason == "query_failure"


def test_a_sweep_that_others_disturb_is_flagged(spark, tmp_path, monkeypatch):
    seen = []
    e = Engine(spark, f"file://{tmp_path}/store", events=Events(sink=seen.append))
    e.provision()
    m = e.define_model(1, "m", [("n", "int"), ("s", "string")])
    e.write(1, m, {"n": 1, "s": "x"})
    e.demote(1, m, "n")
    rewrite, failures = e.store.rewrite, [1] * 3

    def disturbed(*args):
        if failures:
            failures.pop()
            raise ConcurrentWrite("another writer came first")
        return rewrite(*args)

    monkeypatch.setattr(e.store, "rewrite", disturbed)
    assert e.sweep() == 0 and [s.gaps for s in e.registry.slots if s.status == "tombstoned"] == [1]
    assert [x["event"] for x in seen][-3:] == ["deadlock_retry", "deadlock_retry", "sweep_gap_flagged"]
    failures.extend([1, 1])
    assert e.sweep() == 1 and not any(c.startswith("f_1_") for c in e.records().columns)
    assert [r["s"] for r in e.scan(1, m, None, ["s"]).collect()] == ["x"] and all(s.gaps == 0 for s in e.registry.slots)


def test_commands_for_reconciling_and_replay(spark, tmp_path, capsys):
    from quarryfield.cli import main

    e = Engine(spark, f"file://{tmp_path}/store")
    m = e.define_model(1, "m", [("n", "int")])
    e.write(1, m, {"n": "bad"})
    e.watch()
    e.save()
    root = ["--root", e.root]
    assert main([*root, "reconcile"]) == 0 and '"did": "idle"' in capsys.readouterr().out
    (dead,) = e.quarantined().collect()
    assert main([*root, "replay", "--id", str(dead["id"])]) == 0 and '"queued": 1' in capsys.readouterr().out
    assert main([*root, "replay", "--id", "1", "--reason", "x"]) == 2 and main([*root, "replay"]) == 2
    assert main(["--root", "nosuchscheme://x", "sweep"]) == 1
