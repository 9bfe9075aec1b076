"""Work that must grow with the input and no faster."""

from pyspark.sql import functions as F

from quarryfield.engine import Engine
from quarryfield.operators import ingest, search
from quarryfield.sources.tables import CUSTOMER, records
from quarryfield.sources import work

SMALL = "/root/testdata/sf0.01"


def test_pages_scan_once(spark, monkeypatch):
    df, reg = records(spark, SMALL, CUSTOMER)
    request = search.Request(1, 1, None, ["c_name"], 67)
    want, cursor = [], None
    while True:
        want.append(search.page(df, reg.view(1), search.Request(1, 1, None, ["c_name"], 67, cursor)))
        cursor = want[-1].next_cursor
        if cursor is None:
            break
    calls, scan = [], search.scan
    monkeypatch.setattr(search, "scan", lambda *a: calls.append(a) or scan(*a))
    monkeypatch.setattr(search, "TASK_ROWS", 100, raising=False)
    assert len(want) > 5 and list(search.pages(df, reg.view(1), request)) == want
    assert len(calls) == 1
    tail = search.Request(1, 1, None, ["c_name"], 67, want[2].next_cursor)
    assert list(search.pages(df, reg.view(1), tail)) == want[3:]
    full = search.Request(1, 1, None, ["c_name"], len(want[0].rows))
    two = df.where(F.col("entry_id") <= want[1].rows[-1]["entry_id"])
    assert [p.next_cursor is None for p in search.pages(two, reg.view(1), full)] == [False, True]
    assert list(search.pages(df.where("false"), reg.view(1), request)) == [search.Page([], None, 67)]


def test_gathered_rows_come_in_blocks(spark):
    want = [(i, f"r{i}") for i in range(25)]
    df = work.gathered(spark, iter(want), "i long, s string", work.work_dir(spark, "test"), block=10)
    assert sorted(map(tuple, df.collect())) == want and len(df.inputFiles()) == 3
    assert work.gathered(spark, iter(()), "i long", work.work_dir(spark, "test")).collect() == []


def test_waiting_entries_are_not_read_until_the_fields_without_a_slot_change(spark, tmp_path, monkeypatch):
    e = Engine(spark, f"file://{tmp_path}/a store")
    m = e.define_model(1, "m", [("n", "int")])
    e.bulk_write([{"tenantId": 1, "modelId": m, "fields": {"n": n}} for n in (5, 6, "bad", None)])
    calls, records = [], e.records
    monkeypatch.setattr(e, "records", lambda *a: calls.append(a) or records(*a))
    assert [e.reconcile() for _ in range(3)] == ["capacity_wait"] * 3 and not calls
    e.define_model(1, "other", [("x", "string")])
    assert [e.reconcile() for _ in range(3)] == ["capacity_wait"] * 3 and calls
    n = len(calls)
    assert e.reconcile() == "capacity_wait" and len(calls) == n
    again = Engine(spark, e.root)  # what waits is in the store, not in the engine
    again.registry = e.registry
    again.watch()
    assert again.reconcile() == "idle"
    assert sorted((r["entry_id"], r["n"]) for r in again.scan(1, m).collect()) == [(1, 5), (2, 6), (3, None), (4, None)]
    assert [(r["entry_id"], r["reason"]) for r in again.quarantined().collect()] == [(3, "schema_incompatibility")]
    version = again.store.version()
    assert again.reconcile() == "idle" and again.store.version() == version


def test_filling_in_agrees_with_the_upsert(spark):
    old = spark.sql("SELECT id AS entry_id, 1L AS tenant_id, 2 AS model_id, id * 10 AS created_at, 0L AS updated_at, CAST(NULL AS LONG) AS deleted_at, concat('old ', id) AS fields, id AS f_1_1, id + 1 AS f_2_1, true AS p_1 FROM range(6)")
    new = spark.sql("SELECT id * 2 AS entry_id, 1L AS tenant_id, 2 AS model_id, concat('new ', id) AS fields, CAST(NULL AS LONG) AS f_1_1, id AS f_3_2, id > 1 AS p_2 FROM range(5)")
    times = old.select("entry_id", "created_at", "updated_at", "deleted_at")
    want = ingest.upsert(old, new.withColumn("seq", F.lit(0)).join(times, "entry_id"))
    got = ingest.filled_in(old, new)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Window" not in plan
