"""Queries over what the engine does besides scanning: decoding, checks, jobs, changes of fields, reports.

Each runs an engine of its own and gives what a caller would see as a small DataFrame; the
SQL derives the same from the driver's tables, mostly ``nation`` as a list of 25 requests.
"""

from __future__ import annotations

import json
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from .catalog import _PARTS, _PERSONS, _engine, _load, _query, both, leaf
from .cli import main
from .errors import EngineError, FieldNotFilterable, FilterError, PayloadTooLarge
from .events import Events
from .plans import ast, preflight
from .plans.schema import json_schema
from .plans.wire import decode
from .sources.tables import table
from .sources.work import work_dir
from .types import INT, NUMERIC, STRING, FilterLimits, Settings

_NUMBERS = "SELECT n_nationkey::BIGINT AS n FROM nation"


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _deep(levels: int) -> dict:
    node = leaf("m", "is_null", "f")
    for _ in range(levels - 1):
        node = {"op": "not", "arg": node}
    return node


def _wide(nodes: int) -> dict:
    """A tree of that many nodes, at most 64 to a parent."""
    full, rest = divmod(nodes - 1, 51)
    group = lambda k: both("or", *(leaf("m", "is_null", "f") for _ in range(k)))
    return both("and", *(group(50) for _ in range(full)), *([group(rest - 1)] if rest else []))


@_query("wire_limits", f"""WITH r AS ({_NUMBERS})
  SELECT n, CASE WHEN n + 1 > 8 THEN 'nesting_too_deep' ELSE 'ok' END AS depth, CASE WHEN 250 + n > 256 THEN 'node_count_exceeded' ELSE 'ok' END AS nodes,
    CASE WHEN 52 + n > 64 THEN 'value_out_of_bounds' ELSE 'ok' END AS args, CASE WHEN 1010 + n > 1024 THEN 'value_out_of_bounds' ELSE 'ok' END AS list,
    CASE WHEN 4080 + n > 4096 THEN 'value_out_of_bounds' ELSE 'ok' END AS text, CASE WHEN n > 10 THEN 'value_out_of_bounds' ELSE 'ok' END AS bytes FROM r""")  # fmt: skip
def _(spark, sf_dir):
    def code(node, size=None) -> str:
        text = json.dumps({"filter": node})
        try:
            decode(text if size is None else text + " " * (size - len(text)))
        except FilterError as e:
            return e.code
        return "ok"

    one = leaf("m", "is_null", "f")
    rows = []
    for (n,) in table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long")).collect():
        rows.append((n, code(_deep(n + 1)), code(_wide(250 + n)), code(both("and", *[one] * (52 + n))), code(leaf("m", "in", "f", list(range(1010 + n)))), code(leaf("m", "eq", "f", "x" * (4080 + n))), code(one, 65_526 + n)))
    return _frame(spark, rows, "n long, depth string, nodes string, args string, list string, text string, bytes string")


# Malformed requests: what is sent, the code and the place it is reported at.
_MALFORMED = [
    ("text", "not json", "envelope_malformed", ""),
    ("list", "[]", "envelope_malformed", ""),
    ("no filter", "{}", "ok", ""),
    ("null filter", '{"filter": null}', "node_malformed", "/filter"),
    ("version", '{"version": "2"}', "version_unsupported", "/version"),
    ("operator", '{"filter": {"op": "like", "field": {"model": "m", "name": "f"}, "value": 1}}', "operator_unknown", "/filter/op"),
    ("no value", '{"filter": {"op": "eq", "field": {"model": "m", "name": "f"}}}', "node_malformed", "/filter"),
    ("value of is_null", '{"filter": {"op": "is_null", "field": {"model": "m", "name": "f"}, "value": null}}', "value_unexpected", "/filter/value"),
    ("between of three", '{"filter": {"op": "between", "field": {"model": "m", "name": "f"}, "value": [1, 2, 3]}}', "value_count_mismatch", "/filter/value"),
    ("empty prefix", '{"filter": {"op": "prefix", "field": {"model": "m", "name": "f"}, "value": ""}}', "value_out_of_bounds", "/filter/value"),
    ("empty in", '{"filter": {"op": "in", "field": {"model": "m", "name": "f"}, "value": []}}', "value_count_mismatch", "/filter/value"),
    ("no args", '{"filter": {"op": "and", "args": []}}', "value_count_mismatch", "/filter/args"),
    ("below", '{"filter": {"op": "and", "args": [{"op": "not", "arg": {"op": "eq"}}]}}', "node_malformed", "/filter/args/0/arg"),
]


@_query("wire_errors", "SELECT * FROM (VALUES " + ", ".join(f"('{name}', '{code}', '{place}')" for name, _, code, place in _MALFORMED) + ") t(request, code, place)")
def _(spark, sf_dir):
    rows = []
    for name, text, _, _ in _MALFORMED:
        try:
            decode(text)
            rows.append((name, "ok", ""))
        except FilterError as e:
            rows.append((name, e.code, e.pointer))
    return _frame(spark, rows, "request string, code string, place string")


@_query("wire_in_dedup", f"SELECT n, 1 + (n > 0)::BIGINT + 3 AS kept FROM ({_NUMBERS})")
def _(spark, sf_dir):
    """Equal numbers of one type are one; a whole float, a text and a truth value stay apart from the number."""
    rows = []
    for (n,) in table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long")).collect():
        node = decode(json.dumps({"filter": leaf("m", "in", "f", [0, n, n, float(n), float(n), str(n), str(n), True, True])}))
        rows.append((n, len(node.value)))
    return _frame(spark, rows, "n long, kept long")


@_query("filter_sizes", f"SELECT n, CASE WHEN n = 0 THEN 0 WHEN n = 1 THEN 1 ELSE n + 1 END AS nodes, CASE WHEN n = 0 THEN 'joins' WHEN n % 3 = 2 THEN 'exists' ELSE 'joins' END AS strategy FROM ({_NUMBERS})")
def _(spark, sf_dir):
    rows = []
    for (n,) in table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long")).collect():
        leaves = [decode(json.dumps({"filter": leaf("m", "is_null", "f")})) for _ in range(n)]
        node = ast.Or(tuple(leaves)) if n % 3 == 2 else ast.all_of(leaves)
        rows.append((n, ast.size(node), ast.strategy(node)))
    return _frame(spark, rows, "n long, nodes long, strategy string")


@_query("schema_limits", "SELECT 64::BIGINT AS args, 1024::BIGINT AS list, 4096::BIGINT AS text, 7::BIGINT AS shapes")
def _(spark, sf_dir):
    s = json_schema(FilterLimits())
    shapes = s["$defs"]["node"]["oneOf"]
    row = (shapes[0]["properties"]["args"]["maxItems"], shapes[4]["properties"]["value"]["maxItems"], shapes[2]["properties"]["value"]["anyOf"][0]["maxLength"], len(shapes))
    return _frame(spark, [row], "args long, list long, text long, shapes long")


def _said(run) -> str:
    try:
        run()
    except FilterError as e:
        return e.code
    except EngineError as e:
        return type(e).__name__
    return "ok"


@_query("preflight_outcomes", """SELECT * FROM (VALUES ('unknown field', 'UnknownField'), ('not filterable', 'FieldNotFilterable'), ('operator', 'capability_unsupported'), ('text for int', 'value_type_mismatch'),
  ('whole float for int', 'ok'), ('truth value for int', 'value_type_mismatch'), ('naive date', 'value_type_mismatch'), ('unknown before type', 'UnknownField'), ('operator before type', 'capability_unsupported')) t(request, outcome)""")  # fmt: skip
def _(spark, sf_dir):
    e = _engine(spark)
    m = e.define_model(1, "m", [("n", INT), ("d", "datetime"), ("s", STRING, False)])
    view = e.registry.view(m)
    few = frozenset({"eq", "gt"})

    def check(node, operators=frozenset(ast.LEAF_OPS)):
        return lambda: preflight.validate(decode(json.dumps({"filter": node})), view, operators)

    cases = [
        ("unknown field", check(leaf("m", "eq", "x", 1))), ("not filterable", check(leaf("m", "eq", "s", "a"))), ("operator", check(leaf("m", "lt", "n", 1), few)),
        ("text for int", check(leaf("m", "eq", "n", "1"))), ("whole float for int", check(leaf("m", "eq", "n", 2.0))), ("truth value for int", check(leaf("m", "eq", "n", True))),
        ("naive date", check(leaf("m", "eq", "d", "2024-01-01T00:00:00"))), ("unknown before type", check(both("and", leaf("m", "eq", "n", "1"), leaf("m", "eq", "x", 1)))),
        ("operator before type", check(both("and", leaf("m", "eq", "n", "1"), leaf("m", "lt", "n", 1)), few)),
    ]
    return _frame(spark, [(name, _said(run)) for name, run in cases], "request string, outcome string")


@_query("engine_pages", "SELECT n_nationkey::BIGINT + 1 AS entry_id, n_nationkey::BIGINT // 7 AS page, n_name FROM nation")
def _(spark, sf_dir):
    """Cursor by cursor through the engine, seven records a page."""
    e = _engine(spark)
    m = _load(e, "nation", [("n_name", STRING)], table(spark, sf_dir, "nation"), "n_nationkey")
    rows, cursor, nth = [], None, 0
    while True:
        page = e.read(1, m, [], select=["n_name"], page_size=7, cursor=cursor)
        rows += [(r["entry_id"], nth, r["n_name"]) for r in page.rows]
        cursor, nth = page.next_cursor, nth + 1
        if cursor is None:
            return _frame(spark, rows, "entry_id long, page long, n_name string")


@_query("engine_page_bounds", f"SELECT n, CASE WHEN n * 100 BETWEEN 1 AND 1000 THEN 'ok' ELSE 'PageSizeOutOfRange' END AS outcome FROM ({_NUMBERS})")
def _(spark, sf_dir):
    e = _engine(spark)
    m = e.define_model(1, "m", [("n", INT)])
    numbers = [r[0] for r in table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long")).collect()]
    return _frame(spark, [(n, _said(lambda n=n: e.search(1, m, page_size=n * 100))) for n in numbers], "n long, outcome string")


@_query("engine_writes", f"""SELECT n, CASE WHEN n % 5 = 0 THEN 'UncoercibleValue' WHEN n % 5 = 1 THEN 'FieldNotFound' WHEN n % 5 = 2 THEN 'InvalidTenantId' ELSE 'ok' END AS outcome,
  sum(CASE WHEN n % 5 > 2 THEN 1 ELSE 0 END) OVER (ORDER BY n)::BIGINT AS stored FROM ({_NUMBERS})""")  # fmt: skip
def _(spark, sf_dir):
    e = _engine(spark)
    m = e.define_model(1, "m", [("n", INT)])
    rows, stored = [], 0
    for n in sorted(r[0] for r in table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long")).collect()):
        request = [(1, m, {"n": "x"}), (2, m, {"n": n}), (0, m, {"n": n}), (1, m, {"n": n}), (1, m, {"other": n})][n % 5]
        rows.append((n, _said(lambda r=request: e.write(*r)), 0))
    stored = [r["entry_id"] for r in e.scan(1, m).orderBy("entry_id").collect()]
    at = 0
    for i, (n, outcome, _) in enumerate(rows):
        at += outcome == "ok" and stored[at] == at + 1
        rows[i] = (n, outcome, at)
    return _frame(spark, rows, "n long, outcome string, stored long")


@_query("engine_jobs", "SELECT * FROM (VALUES (1::BIGINT, 'completed', 5::BIGINT), (2::BIGINT, 'failed', 4::BIGINT), (3::BIGINT, 'completed', 9::BIGINT)) t(job, status, entries)")
def _(spark, sf_dir):
    """Imports: one whole, one with a bad entity in its second chunk, one sent twice under one key."""
    e = _engine(spark, settings=Settings(bulk_chunk=4))
    m = e.define_model(1, "m", [("n", INT)])
    many = lambda values: [{"tenantId": 1, "modelId": m, "fields": {"n": v}} for v in values]
    e.submit_bulk_write(many(range(5)))
    e.submit_bulk_write(many([1, 2, 3, 4, 5, "bad"]))
    for _ in range(2):
        e.submit_bulk_write(many(range(9)), key="once")
    while e.reconcile() == "import":
        pass
    return _frame(spark, [(j.id, j.status, j.manifest.get("entries_written", 0)) for j in e.imports.rows.values()], "job long, status string, entries long")


@_query("engine_exports", """WITH p AS (SELECT count(*) FILTER (WHERE p_size <= 10) AS n_few, count(*) AS n_all FROM part)
  SELECT 1::BIGINT AS job, 'completed' AS status, n_few + 1 AS lines, NULL AS reason FROM p UNION ALL SELECT 2, 'completed', n_all + 1, NULL FROM p
  UNION ALL SELECT 3, 'failed', NULL, 'artifact_size_exceeded' FROM p""")  # fmt: skip
def _(spark, sf_dir):
    """Filtered, unfiltered and too large; artifacts of finished jobs are counted, then collected."""
    now = [datetime(2026, 1, 1)]
    e = _engine(spark, clock=lambda: now[0])
    m = _load(e, "part", _PARTS, table(spark, sf_dir, "part"), "p_partkey")
    for _ in range(3):
        e.submit_export(1, m, "csv", json.dumps({"filter": leaf("part", "lte", "p_size", 10)}))
    lines = {}
    for apply in (True, False, True):
        if len(lines) == 2:
            e.settings = Settings(export_max_bytes=10)
        try:
            job = e.run_next_export(apply)
            lines[job.id] = spark.read.option("lineSep", "\r\n").text(job.artifact_path).count()
        except EngineError:
            pass
    now[0] += timedelta(days=2)
    e.run_next_export()  # idle: collects garbage
    rows = [(j.id, j.status, lines.get(j.id), (j.failed_reason or "").split(":")[0] or None) for j in e.exports.rows.values() if j.artifact_path is None]
    return _frame(spark, rows, "job long, status string, lines long, reason string")


@_query("engine_field_changes", """SELECT step, n::BIGINT AS n FROM (SELECT 'typed' AS step, count(*) FILTER (WHERE c_nationkey > 10) AS n FROM customer
  UNION ALL SELECT 'demoted', -1 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT 'promoted', count(*) FILTER (WHERE c_nationkey > 10) FROM customer
  UNION ALL SELECT 'as text', count(*) FILTER (WHERE c_nationkey::VARCHAR = '11') FROM customer UNION ALL SELECT 'swept', 3 FROM nation WHERE n_nationkey = 0)""")  # fmt: skip
def _(spark, sf_dir):
    e = _engine(spark)
    m = _load(e, "customer", _PERSONS, table(spark, sf_dir, "customer"), "c_custkey")
    count = lambda op, v: e.scan(1, m, json.dumps({"filter": leaf("customer", op, "c_nationkey", v)}), []).count()
    rows = [("typed", count("gt", 10))]
    e.demote(1, m, "c_nationkey")
    try:
        rows.append(("demoted", count("gt", 10)))
    except FieldNotFilterable:
        rows.append(("demoted", -1))
    e.promote(1, m, "c_nationkey")
    rows.append(("promoted", count("gt", 10)))
    e.retype_field(1, m, "c_nationkey", STRING)
    rows.append(("as text", count("eq", "11")))
    e.demote(1, m, "c_mktsegment")
    rows.append(("swept", e.sweep()))
    return _frame(spark, rows, "step string, n long")


@_query("engine_compaction", "SELECT 1::BIGINT AS moves, 2::BIGINT AS pages_before, 1::BIGINT AS pages_after, count(*) AS found FROM part WHERE p_size = 7")
def _(spark, sf_dir):
    """A field on a second page moves to the first once that has room; its values stay filterable."""
    e = _engine(spark, pages=1)
    names = [f"s{i}" for i in range(15)]
    m = e.define_model(1, "part", [(n, INT) for n in names])
    e.provision(1)
    e.define_model(1, "part", [("p_size", INT)])
    before = len(e.registry.hosting_pages(m))
    e.demote(1, m, "s0")
    e.sweep()
    payload = F.to_json(F.struct("p_size"))
    e.ingest(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.lit(1).cast("long").alias("tenant_id"), F.lit(m).alias("model_id"), payload.alias("fields")), 1, m)
    plan = e.compact_model(1, m)
    found = e.scan(1, m, json.dumps({"filter": leaf("part", "eq", "p_size", 7)}), []).count()
    return _frame(spark, [(len(plan.moves), before, len(e.registry.hosting_pages(m)), found)], "moves long, pages_before long, pages_after long, found long")


@_query("engine_watch", f"""WITH d AS (SELECT n, n + 1 AS texts, n % 4 AS dates FROM ({_NUMBERS}))
  SELECT n, CASE WHEN texts > 25 OR dates > 10 THEN 'unsatisfiable_demand' WHEN (60 - texts - dates) / 60.0 < 0.6 THEN 'low_capacity' ELSE 'none' END AS trigger FROM d""")  # fmt: skip
def _(spark, sf_dir):
    """One page, more and more of its slots taken: what the watcher says."""
    rows = []
    for (n,) in table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long")).collect():
        e = _engine(spark, pages=1, settings=Settings(free_ratio_threshold=0.6))
        e.define_model(1, "m", [(f"s{i}", STRING) for i in range(n + 1)] + [(f"d{i}", "datetime") for i in range(n % 4)])
        rows.append((n, e.watch().trigger))
    return _frame(spark, rows, "n long, trigger string")


@_query("engine_events", """SELECT * FROM (VALUES ('api', 'entry_written', 1::BIGINT), ('api', 'entry_updated', 1::BIGINT), ('api', 'entry_deleted', 1::BIGINT), ('api', 'search_request', 1::BIGINT),
  ('api', 'pre_flight_rejected', 1::BIGINT), ('registry', 'page_provisioned', 1::BIGINT), ('api', 'bulk_chunk_committed', 1::BIGINT), ('api', 'bulk_chunk_rolled_back', 1::BIGINT), ('api', 'payload_too_large', 1::BIGINT)) t(source, event, n)""")  # fmt: skip
def _(spark, sf_dir):
    seen: list[dict] = []
    e = _engine(spark, pages=0, events=Events(sink=seen.append))
    e.provision()
    m = e.define_model(1, "m", [("n", INT)])
    entry = e.write(1, m, {"n": 1})
    e.update(1, entry, {"n": 2})
    e.search(1, m)
    for run in (lambda: e.search(1, m, json.dumps({"filter": leaf("m", "eq", "n", "text")})),):
        _said(run)
    e.delete(1, entry)
    many = [{"tenantId": 1, "modelId": m, "fields": {"n": v}} for v in (1, 2, "bad")]
    e.bulk_write(many, 2)
    try:
        e.bulk_write(many * 400)
    except PayloadTooLarge:
        pass
    counts = Counter((x["source"], x["event"]) for x in seen)
    return _frame(spark, [(s, event, n) for (s, event), n in counts.items()], "source string, event string, n long")


@_query("engine_commands", "SELECT * FROM (VALUES ('bootstrap', 0::BIGINT), ('reconcile', 0::BIGINT), ('export', 0::BIGINT), ('import', 0::BIGINT), ('sweep', 0::BIGINT), ('replay', 1::BIGINT), ('nonsense', 2::BIGINT)) t(command, code)")
def _(spark, sf_dir):
    import contextlib
    import io

    root, rows = ["--root", work_dir(spark, "commands")], []
    for command, *more in (["bootstrap"], ["reconcile"], ["export"], ["import"], ["sweep"], ["replay", "--reason", "other"], ["nonsense"]):
        with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
            rows.append((command, main([*root, command, *more])))
    return _frame(spark, rows, "command string, code long")


@_query("engine_state", "SELECT count(*) AS entries, 2::BIGINT AS fields, max(c_custkey) + 2 AS next_id FROM customer")
def _(spark, sf_dir):
    """A second engine over the same root: registry, records and the next id."""
    e = _engine(spark)
    fields = [("c_name", STRING), ("c_acctbal", NUMERIC)]
    m = _load(e, "customer", fields, table(spark, sf_dir, "customer"), "c_custkey")
    e.save()
    from .engine import Engine

    again = Engine(spark, e.root)
    again.load()
    n = again.scan(1, m).count()
    return _frame(spark, [(n, len(again.describe_model(1, "customer")["fields"]), again.write(1, m, {"c_name": "next"}))], "entries long, fields long, next_id long")
