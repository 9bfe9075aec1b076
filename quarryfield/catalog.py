"""Queries over the test tables, one or more for each operator, with the SQL that must agree."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .engine import Engine
from .functions.records import cursor_column, encode_cursor
from .operators import analytics, export, ingest, lifecycle, search
from .operators.coercion import retype_value, write_value
from .plans.wire import decode
from .registry import Registry
from .sources.tables import CUSTOMER, EVENT, ORDER, PART, Source, records, table
from .sources.work import gathered, work_dir
from .types import DATETIME, INT, NUMERIC, STRING, Settings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# What the sources' record stores are in SQL.
_EVENT = """WITH e AS (SELECT event_id + 1 AS entry_id, user_id % 3 + 1 AS tenant_id, event_type,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value, user_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts,
  props, event_id % 17 = 0 AS gone, event_id % 10 <> 0 AS present FROM events) """
_CUSTOMER = "WITH e AS (SELECT c_custkey + 1 AS entry_id, CAST(c_nationkey % 3 + 1 AS BIGINT) AS tenant_id, c_name, c_mktsegment, c_acctbal, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer) "
_ORDER = "WITH e AS (SELECT o_orderkey + 1 AS entry_id, o_custkey % 3 + 1 AS tenant_id, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate, o_custkey FROM orders) "
_PART = "WITH e AS (SELECT p_partkey + 1 AS entry_id, 1 AS tenant_id, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part) "
_BASE = {"event": (EVENT, _EVENT), "customer": (CUSTOMER, _CUSTOMER), "order": (ORDER, _ORDER), "part": (PART, _PART)}


def leaf(model: str, op: str, name: str, *value) -> dict:
    out = {"op": op, "field": {"model": model, "name": name}}
    return out | ({"value": value[0]} if value else {})


def both(op: str, *args: dict) -> dict:
    return {"op": op, "args": list(args)}


def run_filter(spark: SparkSession, sf_dir: str, source: Source, tenant_id: int, node: dict | None, select: list[str] | None, after: int = 0, settings: Settings = Settings()) -> DataFrame:
    """From the wire text to the lazy scan."""
    df, reg = records(spark, sf_dir, source)
    tree = decode(json.dumps({"version": "1"} | ({} if node is None else {"filter": node})))
    return search.scan(df, reg.view(1), tenant_id, 1, tree, select, after, settings)


def _filter(name: str, model: str, node: dict | None, where: str, select: list[str], tenant_id: int = 1, settings: Settings = Settings()) -> None:
    source, base = _BASE[model]
    QUERIES[name] = lambda spark, sf_dir: run_filter(spark, sf_dir, source, tenant_id, node, select, settings=settings)
    shown = ", ".join("strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts" if c == "ts" else c for c in select)
    live = " AND NOT gone" if model == "event" else ""
    ORACLES[name] = f"{base}SELECT entry_id, {shown} FROM e WHERE tenant_id = {tenant_id}{live} AND ({where})"


def _query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


E = "event"
_PURCHASE = leaf(E, "eq", "event_type", "purchase")
_filter("filter_eq", E, _PURCHASE, "event_type = 'purchase'", ["event_type", "value"])
_filter("filter_neq", E, leaf(E, "neq", "value", 50), "value <> 50", ["value"])
_filter("filter_lt", E, leaf(E, "lt", "value", 10.5), "value < 10.5", ["value", "user_id"])
_filter("filter_lte", "part", leaf("part", "lte", "p_size", 10), "p_size <= 10", ["p_name", "p_size"])
_filter("filter_gt", E, leaf(E, "gt", "value", 100), "value > 100", ["value", "event_type"])
_filter("filter_gte", "order", leaf("order", "gte", "o_totalprice", 200000), "o_totalprice >= 200000", ["o_totalprice"])
_filter("filter_in", "customer", leaf("customer", "in", "c_mktsegment", ["BUILDING", "MACHINERY"]), "c_mktsegment IN ('BUILDING', 'MACHINERY')", ["c_name", "c_mktsegment"])
_filter("filter_in_1024", "order", leaf("order", "in", "o_custkey", list(range(0, 2048, 2))), "o_custkey % 2 = 0 AND o_custkey < 2048", ["o_custkey"])
_filter("filter_nin", E, leaf(E, "nin", "event_type", ["view", "click"]), "event_type NOT IN ('view', 'click')", ["event_type"])
_filter("filter_nin_null_rows", E, leaf(E, "nin", "value", [1, 2]), "value NOT IN (1, 2)", ["value"])
_filter("filter_between", "part", leaf("part", "between", "p_retailprice", [905, 930.5]), "p_retailprice BETWEEN 905 AND 930.5", ["p_retailprice"])
_filter("filter_between_reversed", "part", leaf("part", "between", "p_size", [20, 10]), "p_size BETWEEN 20 AND 10", ["p_size"])
_filter("filter_prefix", "part", leaf("part", "prefix", "p_brand", "Brand#1"), "starts_with(p_brand, 'Brand#1')", ["p_brand"])
_filter("filter_prefix_metachar", "part", both("or", leaf("part", "prefix", "p_name", "%"), leaf("part", "prefix", "p_brand", "B_and"), leaf("part", "prefix", "p_brand", "Brand#2")), "starts_with(p_name, '%') OR starts_with(p_brand, 'B_and') OR starts_with(p_brand, 'Brand#2')", ["p_brand"])
_filter("filter_is_null", E, leaf(E, "is_null", "value"), "present AND value IS NULL", ["event_type", "value"])
_filter("filter_is_null_absent_too", E, leaf(E, "is_null", "value"), "value IS NULL", ["event_type"], settings=Settings(absent_is_null=True))
_filter("filter_is_not_null", E, leaf(E, "is_not_null", "value"), "value IS NOT NULL", ["value"])
_filter("filter_not_is_null", E, {"op": "not", "arg": leaf(E, "is_null", "value")}, "NOT (present AND value IS NULL)", ["value"])
_filter("filter_and", E, both("and", _PURCHASE, leaf(E, "gt", "value", 100)), "event_type = 'purchase' AND value > 100", ["event_type", "value"])
_filter("filter_or", E, both("or", _PURCHASE, leaf(E, "gt", "value", 100)), "event_type = 'purchase' OR value > 100", ["event_type", "value"])
_filter("filter_nested", E, both("and", both("or", _PURCHASE, leaf(E, "eq", "event_type", "signup")), {"op": "not", "arg": leaf(E, "lt", "value", 50)}), "event_type IN ('purchase', 'signup') AND NOT coalesce(value < 50, false)", ["event_type", "value"])
_filter("filter_not_null_rows", E, {"op": "not", "arg": leaf(E, "gt", "value", 20)}, "NOT coalesce(value > 20, false)", ["value"])
_filter("filter_double_not", E, {"op": "not", "arg": {"op": "not", "arg": leaf(E, "gt", "value", 20)}}, "coalesce(value > 20, false)", ["value"])
_filter("filter_not_and", E, {"op": "not", "arg": both("and", _PURCHASE, leaf(E, "gt", "value", 20))}, "NOT (event_type = 'purchase' AND coalesce(value > 20, false))", ["event_type", "value"])
_filter("filter_three_families", "order", both("and", leaf("order", "eq", "o_orderstatus", "F"), leaf("order", "gt", "o_totalprice", 50000), leaf("order", "lt", "o_custkey", 100)), "o_orderstatus = 'F' AND o_totalprice > 50000 AND o_custkey < 100", ["o_orderstatus", "o_totalprice", "o_custkey"])
_filter("filter_datetime_range", E, leaf(E, "between", "ts", ["2024-01-05T00:00:00Z", "2024-01-20T12:30:00Z"]), "ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:30:00'", ["ts"])
_filter("filter_datetime_offset", E, leaf(E, "gte", "ts", "2024-01-15T05:00:00.500000+05:00"), "ts >= TIMESTAMP '2024-01-15 00:00:00.5'", ["ts"])
_filter("filter_case_insensitive", "customer", leaf("customer", "eq", "c_mktsegment", "Buílding"), "c_mktsegment COLLATE NOCASE.NOACCENT = 'Buílding'", ["c_mktsegment"], settings=Settings(collation="UNICODE_CI_AI"))
_filter("match_all", E, None, "true", ["event_type", "value", "user_id", "ts"])
_filter("tenant_isolated", "customer", None, "true", ["c_name"], tenant_id=2)
_filter("select_fields", E, _PURCHASE, "event_type = 'purchase'", ["user_id", "event_type"], tenant_id=3)
_filter("search_order_tree", "order", both("or", both("and", leaf("order", "eq", "o_orderpriority", "1-URGENT"), leaf("order", "gt", "o_totalprice", 100000)), {"op": "not", "arg": both("or", leaf("order", "neq", "o_orderstatus", "P"), leaf("order", "lt", "o_custkey", 50))}), "(o_orderpriority = '1-URGENT' AND o_totalprice > 100000) OR NOT (o_orderstatus <> 'P' OR o_custkey < 50)", ["o_orderpriority", "o_orderstatus", "o_totalprice"])


@_query("soft_deleted_excluded", _EVENT + "SELECT count(*) FILTER (WHERE NOT gone) AS live, count(*) FILTER (WHERE gone) AS deleted FROM e WHERE tenant_id = 1")
def _(spark, sf_dir):
    df, _ = records(spark, sf_dir, EVENT)
    return df.where("tenant_id = 1").agg(F.count_if(F.col("deleted_at").isNull()).alias("live"), F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"))


@_query("filter_neq_vs_not", _EVENT + "SELECT count(*) FILTER (WHERE value <> 50) AS n_neq, count(*) FILTER (WHERE NOT coalesce(value = 50, false)) AS n_not FROM e WHERE tenant_id = 1 AND NOT gone")
def _(spark, sf_dir):
    neq = run_filter(spark, sf_dir, EVENT, 1, leaf(E, "neq", "value", 50), [])
    non = run_filter(spark, sf_dir, EVENT, 1, {"op": "not", "arg": leaf(E, "eq", "value", 50)}, [])
    return neq.agg(F.count(F.lit(1)).alias("n_neq")).join(non.agg(F.count(F.lit(1)).alias("n_not")))


@_query("select_unknown_field", _CUSTOMER + "SELECT entry_id, c_name, CAST(NULL AS VARCHAR) AS nothing FROM e WHERE tenant_id = 1")
def _(spark, sf_dir):
    return run_filter(spark, sf_dir, CUSTOMER, 1, None, ["c_name", "nothing"])


@_query("json_fallback", _EVENT + "SELECT entry_id, props->>'k' AS k FROM e WHERE tenant_id = 1 AND NOT gone")
def _(spark, sf_dir):
    return run_filter(spark, sf_dir, EVENT, 1, None, ["k"])


@_query("page_first", _EVENT + "SELECT entry_id, value FROM e WHERE tenant_id = 1 AND NOT gone AND event_type = 'purchase' ORDER BY entry_id LIMIT 50")
def _(spark, sf_dir):
    df, reg = records(spark, sf_dir, EVENT)
    got = search.page(df, reg.view(1), search.Request(1, 1, decode(json.dumps({"filter": _PURCHASE})), ["value"], 50))
    return spark.createDataFrame([(r["entry_id"], r["value"]) for r in got.rows], "entry_id long, value double")


@_query("page_second", _EVENT + "SELECT entry_id, value FROM (SELECT *, row_number() OVER (ORDER BY entry_id) AS n FROM e WHERE tenant_id = 1 AND NOT gone AND event_type = 'purchase') WHERE n BETWEEN 51 AND 100")
def _(spark, sf_dir):
    df, reg = records(spark, sf_dir, EVENT)
    tree = decode(json.dumps({"filter": _PURCHASE}))
    first = search.page(df, reg.view(1), search.Request(1, 1, tree, ["value"], 50))
    second = search.page(df, reg.view(1), search.Request(1, 1, tree, ["value"], 50, first.next_cursor or encode_cursor(0)))
    return spark.createDataFrame([(r["entry_id"], r["value"]) for r in second.rows], "entry_id long, value double")


@_query("page_drain", _CUSTOMER + "SELECT entry_id, c_name FROM e WHERE tenant_id = 1")
def _(spark, sf_dir):
    df, reg = records(spark, sf_dir, CUSTOMER)
    rows = ((r["entry_id"], r["c_name"]) for page in search.pages(df, reg.view(1), search.Request(1, 1, None, ["c_name"], 1000)) for r in page.rows)
    return gathered(spark, rows, "entry_id long, c_name string", work_dir(spark, "pages"))


@_query("cursor_tokens", _CUSTOMER + "SELECT entry_id, rtrim(replace(replace(base64(encode('v1:' || entry_id)), '+', '-'), '/', '_'), '=') AS cursor FROM e")
def _(spark, sf_dir):
    df, _ = records(spark, sf_dir, CUSTOMER)
    return df.select("entry_id", cursor_column(F.col("entry_id")).alias("cursor"))


@_query("point_get", _EVENT + "SELECT entry_id, tenant_id, props AS fields FROM e WHERE entry_id = 43 AND NOT gone")
def _(spark, sf_dir):
    df, _ = records(spark, sf_dir, EVENT)
    tenant_of = df.where("entry_id = 43").select("tenant_id").first()
    row = search.get(df, tenant_of[0], 43) if tenant_of else None
    return spark.createDataFrame([(r["entry_id"], r["tenant_id"], r["fields"]) for r in [row] if r], "entry_id long, tenant_id long, fields string")


# Joins: the forms that separate page tables would need.

_PAGES = "WITH a AS (SELECT event_id + 1 AS entry_id, event_type FROM events WHERE event_id % 10 <> 3), b AS (SELECT event_id + 1 AS entry_id, value FROM events WHERE event_id % 10 <> 7) "


def _page_tables(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    entry = ev.select((F.col("event_id") + 1).alias("entry_id"))
    a = ev.where("event_id % 10 <> 3").select((F.col("event_id") + 1).alias("entry_id"), "event_type")
    b = ev.where("event_id % 10 <> 7").select((F.col("event_id") + 1).alias("entry_id"), "value")
    return entry, a, b


@_query("join_equivalence_pages", _PAGES + "SELECT e.event_id + 1 AS entry_id, event_type, a.entry_id IS NOT NULL AS in_a, b.value FROM events e JOIN a ON a.entry_id = e.event_id + 1 JOIN b ON b.entry_id = e.event_id + 1 WHERE event_type = 'click' AND b.value > 50".replace("event_type, a.entry_id", "a.event_type, a.entry_id").replace("WHERE event_type", "WHERE a.event_type"))
def _(spark, sf_dir):
    entry, a, b = _page_tables(spark, sf_dir)
    return search.on_all_groups(entry, a.where("event_type = 'click'"), b.where("value > 50")).select("entry_id", "event_type", F.lit(True).alias("in_a"), "value")


@_query("semi_join", _PAGES + "SELECT event_id + 1 AS entry_id FROM events e WHERE EXISTS (SELECT 1 FROM a WHERE a.entry_id = e.event_id + 1 AND a.event_type = 'click') OR EXISTS (SELECT 1 FROM b WHERE b.entry_id = e.event_id + 1 AND b.value > 100)")
def _(spark, sf_dir):
    entry, a, b = _page_tables(spark, sf_dir)
    return search.in_any_group(entry, a.where("event_type = 'click'"), b.where("value > 100"))


@_query("anti_join", _PAGES + "SELECT event_id + 1 AS entry_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.entry_id = e.event_id + 1 AND a.event_type = 'click')")
def _(spark, sf_dir):
    entry, a, _b = _page_tables(spark, sf_dir)
    return search.in_no_group(entry, a.where("event_type = 'click'"))


@_query("left_fallback", _PAGES + "SELECT event_id + 1 AS entry_id, a.event_type, b.value FROM events e LEFT JOIN a ON a.entry_id = e.event_id + 1 LEFT JOIN b ON b.entry_id = e.event_id + 1")
def _(spark, sf_dir):
    entry, a, b = _page_tables(spark, sf_dir)
    return search.with_groups(entry, a, b)


# A registry of any size: one field for each part.

_REG = """WITH r AS (SELECT p_partkey + 1 AS id, p_partkey % 7 + 1 AS page_id, p_brand, p_partkey,
    CASE p_size % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'int' WHEN 2 THEN 'numeric' ELSE 'datetime' END AS declared_type,
    CASE p_size % 4 WHEN 0 THEN 'str' WHEN 1 THEN 'int' WHEN 2 THEN 'num' ELSE 'dt' END AS slot_type,
    p_size % 3 <> 0 AS is_filterable, p_partkey % 3 <> 1 AS is_indexed,
    CASE p_partkey % 5 WHEN 0 THEN 'free' WHEN 1 THEN 'assigned' WHEN 2 THEN 'tombstoned' WHEN 3 THEN 'backfilling' ELSE 'ready' END AS status FROM part),
  models AS (SELECT row_number() OVER (ORDER BY p_brand) AS id, row_number() OVER (ORDER BY p_brand) % 3 + 1 AS tenant_id, p_brand AS name FROM (SELECT DISTINCT p_brand FROM part)),
  fields AS (SELECT r.id, m.id AS model_id, 'f' || r.id AS name, declared_type, is_filterable, slot_type FROM r JOIN models m ON m.name = r.p_brand),
  slots AS (SELECT id, page_id, slot_type, CASE WHEN status IN ('assigned', 'backfilling', 'ready') THEN id END AS field_id, status, is_indexed FROM r)
"""


def registry_frames(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    pick = lambda c, names: F.element_at(F.array(*(F.lit(n) for n in names)), (c + 1).cast("int"))
    r = p.select(
        (F.col("p_partkey") + 1).alias("id"), (F.col("p_partkey") % 7 + 1).alias("page_id"), "p_brand",
        pick(F.col("p_size") % 4, [STRING, INT, NUMERIC, DATETIME]).alias("declared_type"), pick(F.col("p_size") % 4, ["str", "int", "num", "dt"]).alias("slot_type"),
        (F.col("p_size") % 3 != 0).alias("is_filterable"), (F.col("p_partkey") % 3 != 1).alias("is_indexed"),
        pick(F.col("p_partkey") % 5, ["free", "assigned", "tombstoned", "backfilling", "ready"]).alias("status"),
    )
    n = F.row_number().over(Window.orderBy("p_brand"))
    models = p.select("p_brand").distinct().select(n.cast("long").alias("id"), (n % 3 + 1).cast("long").alias("tenant_id"), F.col("p_brand").alias("name"))
    fields = r.join(models.select(F.col("id").alias("model_id"), F.col("name").alias("p_brand")), "p_brand").select("id", "model_id", F.concat(F.lit("f"), "id").alias("name"), "declared_type", "is_filterable")
    slots = r.select("id", "page_id", "slot_type", F.when(F.col("status").isin("assigned", "backfilling", "ready"), F.col("id")).alias("field_id"), "status", "is_indexed")
    return models, fields, slots


@_query("capacity_report", _REG + "SELECT slot_type, count(*) AS total, count(*) FILTER (WHERE status = 'free') AS free, count(*) FILTER (WHERE is_indexed) AS indexed, count(*) FILTER (WHERE is_indexed AND status = 'free') AS indexed_free FROM slots GROUP BY 1")
def _(spark, sf_dir):
    return analytics.capacity_report(registry_frames(spark, sf_dir)[2])


@_query("capacity_totals", _REG + "SELECT count(DISTINCT page_id) AS pages, count(*) AS total_slots, count(*) FILTER (WHERE status = 'free') AS total_free, count(*) FILTER (WHERE status = 'free') / count(*)::DOUBLE AS free_ratio FROM slots")
def _(spark, sf_dir):
    return analytics.capacity_totals(registry_frames(spark, sf_dir)[2])


_DEMAND = "demand AS (SELECT slot_type, count(*) AS waiters FROM fields f WHERE is_filterable AND NOT EXISTS (SELECT 1 FROM slots s WHERE s.field_id = f.id) GROUP BY 1)"


@_query("pending_demand", _REG + ", " + _DEMAND + " SELECT * FROM demand")
def _(spark, sf_dir):
    _m, fields, slots = registry_frames(spark, sf_dir)
    return analytics.pending_demand(fields, slots)


@_query("provisioning_columns", _REG + ", " + _DEMAND + """, cap AS (SELECT slot_type, count(*) FILTER (WHERE is_indexed AND status = 'free') AS n FROM slots GROUP BY 1)
  SELECT slot_type, waiters, CAST(greatest(1, least(waiters - coalesce(n, 0), CASE slot_type WHEN 'str' THEN 25 WHEN 'int' THEN 15 ELSE 10 END)) AS BIGINT) AS columns FROM demand LEFT JOIN cap USING (slot_type)""")
def _(spark, sf_dir):
    _m, fields, slots = registry_frames(spark, sf_dir)
    return analytics.provisioning_columns(analytics.capacity_report(slots), analytics.pending_demand(fields, slots))


_SAMPLE = """WITH e AS (SELECT user_id % 3 + 1 AS tenant_id, event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value, user_id FROM events),
  long AS (SELECT tenant_id, 'event_type' AS "column", count(*) AS row_count, count(DISTINCT event_type) AS distinct_count FROM e GROUP BY 1
    UNION ALL SELECT tenant_id, 'value', count(*), count(DISTINCT value) FROM e GROUP BY 1 UNION ALL SELECT tenant_id, 'user_id', count(*), count(DISTINCT user_id) FROM e GROUP BY 1),
  sample AS (SELECT *, round(distinct_count::DOUBLE / row_count, 4) AS selectivity FROM long) """


def _sample(spark, sf_dir):
    df, reg = records(spark, sf_dir, EVENT)
    return analytics.cardinality_sample(df, {n: reg.view(1)[n].column for n in ("event_type", "value", "user_id")})


_query("cardinality_sample", _SAMPLE + "SELECT * FROM sample")(_sample)


@_query("low_cardinality", _SAMPLE + ", low AS (SELECT *, concat_ws(',', CASE WHEN selectivity < 0.01 AND row_count >= 1000 THEN 'selectivity' END, CASE WHEN distinct_count < 10 THEN 'distinct_floor' END) AS reasons FROM sample) SELECT * FROM low WHERE reasons <> ''")
def _(spark, sf_dir):
    return analytics.low_cardinality(_sample(spark, sf_dir), Settings(low_selectivity_min_rows=1000))


_SPREAD = """, spread AS (SELECT tenant_id, model_id, count(DISTINCT page_id) AS pages, count(*) AS live_slots,
    CAST(greatest(ceil(count(*) FILTER (WHERE s.slot_type = 'str') / 25.0), ceil(count(*) FILTER (WHERE s.slot_type = 'int') / 15.0), ceil(count(*) FILTER (WHERE s.slot_type = 'num') / 10.0), ceil(count(*) FILTER (WHERE s.slot_type = 'dt') / 10.0)) AS BIGINT) AS min_pages
    FROM slots s JOIN fields f ON f.id = s.field_id AND f.is_filterable JOIN models m ON m.id = f.model_id WHERE s.status IN ('assigned', 'ready') GROUP BY 1, 2) """


@_query("spread_report", _REG + _SPREAD + "SELECT *, pages - min_pages AS excess FROM spread")
def _(spark, sf_dir):
    return analytics.spread_report(*registry_frames(spark, sf_dir))


@_query("high_spread", _REG + _SPREAD + "SELECT *, pages - min_pages AS excess FROM spread WHERE pages >= 2 AND pages - min_pages >= 2")
def _(spark, sf_dir):
    return analytics.high_spread(analytics.spread_report(*registry_frames(spark, sf_dir)))


@_query("free_capacity_by_page", _REG + "SELECT page_id, slot_type, count(*) AS free FROM slots WHERE status = 'free' AND is_indexed GROUP BY 1, 2")
def _(spark, sf_dir):
    return analytics.free_capacity_by_page(registry_frames(spark, sf_dir)[2])


@_query("affine_slot_pick", _REG + """, host AS (SELECT DISTINCT f.model_id, s.page_id FROM slots s JOIN fields f ON f.id = s.field_id),
  req AS (SELECT DISTINCT m.id AS model_id, t.slot_type FROM models m, (SELECT DISTINCT slot_type FROM slots) t),
  ranked AS (SELECT req.model_id, req.slot_type, s.page_id, s.id AS slot_id, h.page_id IS NOT NULL AS affine,
    row_number() OVER (PARTITION BY req.model_id, req.slot_type ORDER BY s.is_indexed DESC, (h.page_id IS NOT NULL) DESC, s.page_id, s.id) AS n
    FROM req JOIN slots s ON s.slot_type = req.slot_type AND s.status = 'free' LEFT JOIN host h ON h.model_id = req.model_id AND h.page_id = s.page_id)
  SELECT model_id, slot_type, page_id, slot_id, affine FROM ranked WHERE n = 1""")
def _(spark, sf_dir):
    models, fields, slots = registry_frames(spark, sf_dir)
    families = slots.select("slot_type").distinct()
    requests = models.select(F.col("id").alias("model_id"), F.explode(F.array(*(F.lit(x) for x in ("str", "int", "num", "dt")))).alias("slot_type")).join(families, "slot_type", "left_semi")
    return analytics.affine_slots(requests, fields, slots)


@_query("schema_listing", _REG + "SELECT m.tenant_id, f.model_id, m.name AS model_name, f.id AS field_id, f.name AS field_name, declared_type, is_filterable, is_filterable AND EXISTS (SELECT 1 FROM slots s WHERE s.field_id = f.id AND s.status IN ('assigned', 'ready')) AS is_indexed FROM fields f JOIN models m ON m.id = f.model_id")
def _(spark, sf_dir):
    return analytics.schema_listing(*registry_frames(spark, sf_dir))


@_query("duplicate_live_slots", "SELECT p_size AS field_id, count(*) AS n FROM part WHERE p_partkey % 5 IN (1, 3, 4) GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf_dir):
    slots = registry_frames(spark, sf_dir)[2].drop("field_id").join(table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("id"), F.col("p_size").alias("field_id")), "id")
    return analytics.duplicate_live_slots(slots)


@_query("distinct_pages", _REG + "SELECT DISTINCT f.model_id, s.page_id FROM slots s JOIN fields f ON f.id = s.field_id")
def _(spark, sf_dir):
    _m, fields, slots = registry_frames(spark, sf_dir)
    return analytics.hosting_pages(fields, slots)


@_query("next_page_number", "SELECT coalesce(max(p_partkey % 7 + 1), 0) + 1 AS next_page FROM part")
def _(spark, sf_dir):
    return analytics.next_page_number(registry_frames(spark, sf_dir)[2])


# Jobs: one for each order.

_JOBS = """WITH jobs AS (SELECT o_orderkey + 1 AS id, o_custkey % 50 + 1 AS tenant_id,
    CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'failed' END AS status,
    o_orderdate AS created_at, o_orderdate + to_seconds(o_orderkey % 100) AS heartbeat_at, o_orderdate + to_hours(o_orderkey % 48) AS completed_at,
    CASE WHEN o_orderkey % 6 <> 0 THEN 'a/' || o_orderkey END AS artifact_path FROM orders) """


def job_frame(spark, sf_dir) -> DataFrame:
    key = F.col("o_orderkey")
    later = lambda **k: F.col("o_orderdate") + F.make_dt_interval(**k)
    return table(spark, sf_dir, "orders").select(
        (key + 1).alias("id"), (F.col("o_custkey") % 50 + 1).alias("tenant_id"),
        F.element_at(F.array(*(F.lit(x) for x in ("pending", "processing", "completed", "failed"))), (key % 4 + 1).cast("int")).alias("status"),
        F.col("o_orderdate").alias("created_at"), later(secs=key % 100).alias("heartbeat_at"), later(hours=(key % 48).cast("int")).alias("completed_at"),
        F.when(key % 6 != 0, F.concat(F.lit("a/"), key.cast("string"))).alias("artifact_path"),
    )


@_query("round_robin_claim", _JOBS + "SELECT id, tenant_id, row_number() OVER (ORDER BY oldest, created_at, id) AS position FROM (SELECT *, min(created_at) OVER (PARTITION BY tenant_id) AS oldest FROM jobs WHERE status = 'pending')")
def _(spark, sf_dir):
    return analytics.round_robin(job_frame(spark, sf_dir).where("status = 'pending'"), work_dir(spark, "round-robin") + "/jobs").select("id", "tenant_id", F.col("position").cast("long").alias("position"))


@_query("next_job", _JOBS + "SELECT id, tenant_id FROM (SELECT *, min(created_at) OVER (PARTITION BY tenant_id) AS oldest FROM jobs WHERE status = 'pending') ORDER BY oldest, created_at, id LIMIT 1")
def _(spark, sf_dir):
    return analytics.next_job(job_frame(spark, sf_dir)).select("id", "tenant_id")


@_query("active_cap", _JOBS + "SELECT tenant_id, count(*) AS active FROM jobs WHERE status IN ('pending', 'processing') GROUP BY 1 HAVING count(*) >= 3")
def _(spark, sf_dir):
    return analytics.active_by_tenant(job_frame(spark, sf_dir)).where(F.col("active") >= Settings().export_active_cap)


@_query("stale_leases", _JOBS + "SELECT id, tenant_id FROM jobs WHERE status = 'processing' AND heartbeat_at < TIMESTAMP '1996-01-01 00:00:00' - INTERVAL 60 SECOND")
def _(spark, sf_dir):
    return analytics.stale_jobs(job_frame(spark, sf_dir), F.expr("timestamp_ntz'1996-01-01 00:00:00'"), 60).select("id", "tenant_id")


@_query("gc_candidates", _JOBS + "SELECT id, artifact_path FROM jobs WHERE artifact_path IS NOT NULL AND ((status = 'completed' AND completed_at < TIMESTAMP '1996-01-02 00:00:00' - INTERVAL 86400 SECOND) OR (status = 'failed' AND completed_at < TIMESTAMP '1996-01-02 00:00:00' - INTERVAL 3600 SECOND))")
def _(spark, sf_dir):
    return analytics.gc_candidates(job_frame(spark, sf_dir), F.expr("timestamp_ntz'1996-01-02 00:00:00'")).select("id", "artifact_path")


# Coercion: literals through the expressions, with the expected outcome spelled in SQL.

_LITERALS = {
    "write_string": (write_value, (STRING,), [('"x"', "x", None), ("42", "42", None), ("1.5", "1.5", None), ("true", "1", None), ("false", "", None), ("[1]", None, "unparseable"), ("null", None, None), ('""', "", None), ("1e20", "1.0E+20", None)]),
    "write_int": (write_value, (INT,), [("42", "42", None), ('"7"', "7", None), ('"007"', None, "out_of_range"), ('"-0"', None, "out_of_range"), ("1.5", None, "out_of_range"), ("true", None, "unparseable"), ('"abc"', None, "unparseable"), ('"92233720368547758070"', None, "out_of_range"), ("null", None, None)]),
    "write_numeric": (write_value, (NUMERIC,), [("42", "42.0", None), ('" +1.5"', "1.5", None), ('".5"', "0.5", None), ('"1e2"', "100.0", None), ('"x"', None, "malformed_number"), ("true", None, "malformed_number"), ("null", None, None)]),
    "write_datetime": (write_value, (DATETIME,), [('"2026-01-15T08:00:00Z"', "2026-01-15 08:00:00", None), ('"2026-01-15T08:00:00.9+05:00"', "2026-01-15 03:00:00", None), ('"2026-01-15"', "2026-01-15 00:00:00", None), ('"2026-02-30"', None, "malformed_datetime"), ('""', None, "malformed_datetime"), ("5", None, "malformed_datetime")]),
    "retype_string_int": (retype_value, (STRING, INT), [('"42"', "42", None), ('"-1"', "-1", None), ('"0"', "0", None), ('"hello"', None, "unparseable"), ('"3.5"', None, "unparseable"), ('"+42"', None, "unparseable"), ('" 42"', None, "unparseable"), ('"1,234"', None, "unparseable"), ('"92233720368547758070"', None, "out_of_range"), ('"007"', None, "out_of_range"), ("null", None, None)]),
    "retype_string_numeric": (retype_value, (STRING, NUMERIC), [('"42"', "42.0", None), ('"3.5"', "3.5", None), ('"-0.5"', "-0.5", None), ('"1.5e2"', "150.0", None), ('"hello"', None, "malformed_number"), ('"NaN"', None, "malformed_number"), ('"Infinity"', None, "malformed_number"), ('"+3.5"', None, "malformed_number"), ('".5"', None, "malformed_number"), ('"1e999"', None, "out_of_range")]),
    "retype_string_datetime": (retype_value, (STRING, DATETIME), [('"2026-01-15T08:00:00Z"', "2026-01-15 08:00:00", None), ('"2026-01-15T08:00:00+05:00"', "2026-01-15 03:00:00", None), ('"2026-01-15 08:00:00.123Z"', "2026-01-15 08:00:00", None), ('"2026-01-15T08:00:00"', None, "malformed_datetime"), ('"2026-01-15"', None, "malformed_datetime"), ('"text"', None, "malformed_datetime")]),
    "retype_int_string": (retype_value, (INT, STRING), [("42", "42", None), ('"7"', "7", None), ('"007"', None, "out_of_range"), ("1.5", None, "unparseable")]),
    "retype_int_numeric": (retype_value, (INT, NUMERIC), [("42", "42.0", None), ('"7"', "7.0", None), ("true", None, "unparseable")]),
    "retype_int_datetime": (retype_value, (INT, DATETIME), [("42", None, "epoch_coercion_rejected"), ("null", None, None)]),
    "retype_numeric_string": (retype_value, (NUMERIC, STRING), [("0.0", "0", None), ("-0.0", "0", None), ("42.0", "42", None), ("1.5", "1.5", None), ("1e-7", "0.0000001", None), ('"2.50"', "2.5", None), ('"x"', None, "malformed_number")]),
    "retype_numeric_int": (retype_value, (NUMERIC, INT), [("42.0", "42", None), ("3.5", None, "non_integer"), ("1e30", None, "out_of_range"), ('"8"', "8", None), ('"x"', None, "malformed_number")]),
    "retype_numeric_datetime": (retype_value, (NUMERIC, DATETIME), [("1.5", None, "epoch_coercion_rejected")]),
    "retype_datetime_string": (retype_value, (DATETIME, STRING), [('"2026-01-15T08:00:00+05:00"', "2026-01-15T03:00:00.000000Z", None), ('"2026-01-15 08:00:00.25"', "2026-01-15T08:00:00.250000Z", None), ("5", None, "malformed_datetime")]),
    "retype_datetime_int": (retype_value, (DATETIME, INT), [('"2026-01-15"', None, "epoch_coercion_rejected")]),
    "retype_datetime_numeric": (retype_value, (DATETIME, NUMERIC), [('"2026-01-15"', None, "epoch_coercion_rejected")]),
    "retype_same_string": (retype_value, (STRING, STRING), [('"hello"', "hello", None), ("5", "5", None), ('{"a":1}', None, "unparseable")]),
    "retype_same_int": (retype_value, (INT, INT), [("42", "42", None), ('"x"', None, "unparseable")]),
    "retype_same_numeric": (retype_value, (NUMERIC, NUMERIC), [("1.5", "1.5", None), ('"x"', None, "malformed_number")]),
    "retype_same_datetime": (retype_value, (DATETIME, DATETIME), [('"2026-01-02 03:04:05"', "2026-01-02 03:04:05", None), ("5", None, "malformed_datetime")]),
}


def _coercion(name: str, function, kinds: tuple, cases: list) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, js string")
        out = function(F.parse_json("js"), *kinds)
        value = F.date_format(out["value"], "yyyy-MM-dd HH:mm:ss") if kinds[-1] == DATETIME else out["value"].cast("string")
        return df.select("id", value.alias("value"), out["reason"].alias("reason"))

    quote = lambda x: "CAST(NULL AS VARCHAR)" if x is None else "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(v)}, {quote(r)})" for i, (_, v, r) in enumerate(cases))
    _query(f"coerce_{name}", f"SELECT * FROM (VALUES {rows}) t(id, value, reason)")(run)


for _name, (_function, _kinds, _cases) in _LITERALS.items():
    _coercion(_name, _function, _kinds, _cases)


# Coercion of whole tables, with the rule in SQL.

_SPELT = """CASE event_id % 8 WHEN 0 THEN '"' || user_id || '"' WHEN 1 THEN user_id::VARCHAR WHEN 2 THEN user_id || '.5' WHEN 3 THEN '"0' || user_id || '"'
    WHEN 4 THEN 'true' WHEN 5 THEN '"x' || user_id || '"' WHEN 6 THEN user_id || '.0' ELSE 'null' END"""


def _spelt(spark, sf_dir) -> DataFrame:
    u, q = F.col("user_id").cast("string"), F.lit('"')
    texts = [F.concat(q, u, q), u, F.concat(u, F.lit(".5")), F.concat(F.lit('"0'), u, q), F.lit("true"), F.concat(F.lit('"x'), u, q), F.concat(u, F.lit(".0")), F.lit("null")]
    js = F.element_at(F.array(*texts), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.parse_json(js).alias("v"))


def _whole_table(name: str, value: str, reason: str, coerce: Callable) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _spelt(spark, sf_dir).withColumn("o", coerce(F.col("v")))
        return df.select("event_id", F.col("o.value").alias("value"), F.col("o.reason").alias("reason"))

    _query(f"coerce_table_{name}", f"SELECT event_id, CASE {value} END AS value, CASE {reason} END AS reason FROM (SELECT event_id, user_id, event_id % 8 AS k FROM events)")(run)


_whole_table("write_int", "WHEN k IN (0, 1, 6) THEN user_id", "WHEN k IN (2, 3) THEN 'out_of_range' WHEN k IN (4, 5) THEN 'unparseable'", lambda v: write_value(v, INT))
_whole_table("write_numeric", "WHEN k IN (0, 1, 3, 6) THEN user_id::DOUBLE WHEN k = 2 THEN user_id + 0.5::DOUBLE", "WHEN k IN (4, 5) THEN 'malformed_number'", lambda v: write_value(v, NUMERIC))
_whole_table("write_string", "WHEN k IN (0, 1, 6) THEN user_id::VARCHAR WHEN k = 2 THEN user_id || '.5' WHEN k = 3 THEN '0' || user_id WHEN k = 4 THEN '1' WHEN k = 5 THEN 'x' || user_id", "WHEN false THEN ''", lambda v: write_value(v, STRING))
_whole_table("retype_numeric_int", "WHEN k IN (0, 1, 6) THEN user_id", "WHEN k = 2 THEN 'non_integer' WHEN k IN (3, 4, 5) THEN 'malformed_number'", lambda v: retype_value(v, NUMERIC, INT))
_whole_table("retype_string_int", "WHEN k = 0 THEN user_id", "WHEN k = 3 THEN 'out_of_range' WHEN k IN (1, 2, 4, 5, 6) THEN 'unparseable'", lambda v: retype_value(v, STRING, INT))


# Writes.


def _event_batch(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    bad = F.when(F.col("event_id") % 1501 == 7, F.lit("bad")).otherwise(F.col("user_id").cast("string"))
    fields = F.to_json(F.struct(F.col("event_type").alias("event_type"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"), bad.alias("user_id")), {"ignoreNullFields": "false"})
    return ev.select(F.col("event_id").alias("idx"), (F.col("user_id") % 3 + 1).alias("tenant_id"), F.lit(1).alias("model_id"), fields.alias("fields"))


@_query("bulk_chunk_outcome", "SELECT event_id // 500 AS chunk, CASE WHEN bool_or(event_id % 1501 = 7) THEN 'rolled_back' ELSE 'committed' END AS status, count(*) AS rows, min(CASE WHEN event_id % 1501 = 7 THEN event_id END) AS first_bad FROM events GROUP BY 1")
def _(spark, sf_dir):
    rows = ingest.split(_event_batch(spark, sf_dir), EVENT.registry().view(1))
    return ingest.chunk_manifest(ingest.chunked(rows, 500))


@_query("write_split", "SELECT event_id AS idx, event_type, CASE WHEN event_id % 5 <> 0 THEN value END AS value, CASE WHEN event_id % 1501 <> 7 THEN user_id END AS user_id, CAST(event_id % 1501 = 7 AS BIGINT) AS n_faults FROM events")
def _(spark, sf_dir):
    view = EVENT.registry().view(1)
    rows = ingest.split(_event_batch(spark, sf_dir), view)
    return rows.select("idx", *(F.col(view[n].column).alias(n) for n in ("event_type", "value", "user_id")), F.size("faults").cast("long").alias("n_faults"))


@_query("assign_ids", "SELECT event_id AS idx, 1000 + row_number() OVER (ORDER BY event_id) - 1 AS entry_id FROM events")
def _(spark, sf_dir):
    return ingest.assign_ids(table(spark, sf_dir, "events").select(F.col("event_id").alias("idx")), 1000, work_dir(spark, "ids") + "/rows").select("idx", F.col("entry_id").cast("long").alias("entry_id"))


@_query("upsert_last_wins", "SELECT user_id AS entry_id, max_by(value, event_id) AS value FROM events GROUP BY 1 UNION ALL SELECT c_custkey + 1000000 AS entry_id, c_acctbal AS value FROM customer")
def _(spark, sf_dir):
    changes = table(spark, sf_dir, "events").select(F.col("user_id").alias("entry_id"), "value", F.col("event_id").alias("seq"))
    cust = table(spark, sf_dir, "customer")
    current = cust.select((F.col("c_custkey") + 1000000).alias("entry_id"), F.col("c_acctbal").alias("value")).union(changes.select("entry_id", F.lit(-1.0)).distinct())
    return ingest.upsert(current, changes)


@_query("update_put", _CUSTOMER + "SELECT entry_id, tenant_id, CASE WHEN entry_id = 7 THEN 'New name' ELSE c_name END AS c_name, CASE WHEN entry_id = 7 THEN NULL ELSE c_acctbal END AS c_acctbal FROM e WHERE tenant_id = (SELECT tenant_id FROM e WHERE entry_id = 7)")
def _(spark, sf_dir):
    df, reg = records(spark, sf_dir, CUSTOMER)
    view, now = reg.view(1), F.expr("timestamp_ntz'2024-06-01 00:00:00'")
    owner = df.where("entry_id = 7").select("tenant_id").first()[0]
    mine = df.where(F.col("tenant_id") == owner).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    out = ingest.replace_entry(mine, view, owner, 7, json.dumps({"c_name": "New name"}), now)
    return out.select("entry_id", "tenant_id", F.col(view["c_name"].column).alias("c_name"), F.col(view["c_acctbal"].column).alias("c_acctbal"))


@_query("soft_delete", _CUSTOMER + "SELECT entry_id, entry_id = 7 AS is_deleted, c_name FROM e")
def _(spark, sf_dir):
    df, reg = records(spark, sf_dir, CUSTOMER)
    owner = df.where("entry_id = 7").select("tenant_id").first()[0]
    out, _changed = ingest.soft_delete(df.withColumn("updated_at", F.lit(None).cast("timestamp_ntz")), owner, 7, F.expr("timestamp_ntz'2024-06-01 00:00:00'"))
    return out.select("entry_id", F.col("deleted_at").isNotNull().alias("is_deleted"), F.col(reg.view(1)["c_name"].column).alias("c_name"))


@_query("outbox_split", "SELECT c.event_id + 1 AS entry_id, CASE WHEN e.event_id IS NULL THEN 'missing_entry_data' WHEN c.event_id % 1501 = 7 THEN 'schema_incompatibility' END AS reason FROM (SELECT event_id * 2 AS event_id FROM events) c LEFT JOIN events e ON e.event_id = c.event_id")
def _(spark, sf_dir):
    from .streaming.outbox import drain_batch

    queue = table(spark, sf_dir, "events").select((F.col("event_id") * 2 + 1).alias("entry_id"))
    store = _event_batch(spark, sf_dir).select((F.col("idx") + 1).alias("entry_id"), "tenant_id", "model_id", "fields")
    return drain_batch(queue, store, EVENT.registry().view(1)).select("entry_id", "reason")


@_query("dlq_replay", "SELECT event_id + 1 AS entry_id FROM events WHERE event_type = 'error'")
def _(spark, sf_dir):
    from .operators.jobs import replay

    dead = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 1 == 0, F.col("event_id") + 1).alias("entry_id"), F.when(F.col("event_type") == "error", "other").otherwise("malformed_json").alias("reason"))
    again, _left = replay(dead, reason="other")
    return again


# Changing types.

_BACKFILL = "SELECT event_id + 1 AS entry_id, {} FROM events"


def _retype(spark, sf_dir):
    df, reg = records(spark, sf_dir, EVENT)
    bad = F.when(F.col("entry_id") % 10 == 1, F.lit('{"k":"x"}')).when(F.col("entry_id") % 10 == 2, F.lit("{}")).otherwise(F.col("fields"))
    reg, _ = lifecycle.begin_retype(reg, 1, "k", STRING, filterable=True)
    return df.withColumn("fields", bad), reg.view(1)["k"]


@_query("retype_backfill", _BACKFILL.format("CASE WHEN (event_id + 1) % 10 IN (1, 2) THEN NULL ELSE props->>'k' END AS k"))
def _(spark, sf_dir):
    df, view = _retype(spark, sf_dir)
    return lifecycle.backfill(df, view, INT).select("entry_id", F.col(view.column).alias("k"))


@_query("coercion_audit", "SELECT event_id + 1 AS entry_id, 'unparseable' AS reason FROM events WHERE (event_id + 1) % 10 = 1")
def _(spark, sf_dir):
    df, view = _retype(spark, sf_dir)
    return lifecycle.audit(df, view, INT).select("entry_id", "reason")


@_query("page_inventory", "SELECT page_id, slot_type, count(*) AS n FROM (SELECT unnest(range(1, 4)) AS page_id) p, (SELECT 'str' AS slot_type, unnest(range(25)) UNION ALL SELECT 'int', unnest(range(15)) UNION ALL SELECT 'num', unnest(range(10)) UNION ALL SELECT 'dt', unnest(range(10))) s GROUP BY 1, 2")
def _(spark, sf_dir):
    return Registry().provision(3).to_frames(spark)["slots"].groupBy(F.col("page_id").cast("long").alias("page_id"), "slot_type").agg(F.count(F.lit(1)).alias("n"))


# Exports.


@_query("export_csv_lines", """SELECT p_partkey + 1 AS entry_id, CASE WHEN contains(p_name, ',') OR contains(p_name, '"') THEN '"' || replace(p_name, '"', '""') || '"' ELSE p_name END || ',' || p_brand || ',' || p_size AS line FROM part""")
def _(spark, sf_dir):
    df, reg = records(spark, sf_dir, PART)
    return export.csv_lines(export.rows_of(df, reg.view(1), 1, 1), ["p_name", "p_brand", "p_size"]).where("NOT skipped").select("entry_id", "line")


@_query("export_csv_documents", """SELECT doc_id + 1 AS entry_id, CASE WHEN regexp_matches(text, '[,"\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END || ',' || source AS line FROM documents""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("entry_id"), F.to_json(F.struct("text", "source")).alias("fields"))
    return export.csv_lines(rows, ["text", "source"]).where("NOT skipped").select("entry_id", "line")


@_query("export_header", "SELECT 'event_type,k,ts,user_id,value' AS header")
def _(spark, sf_dir):
    return spark.createDataFrame([(export.csv_header(export.header_fields(EVENT.registry().view(1))),)], "header string")


@_query("export_json", _EVENT + "SELECT entry_id, props->>'k' AS k FROM e WHERE tenant_id = 1 AND NOT gone")
def _(spark, sf_dir):
    df, reg = records(spark, sf_dir, EVENT)
    doc = export.json_document(export.rows_of(df, reg.view(1), 1, 1))
    whole = F.regexp_replace("line", r"^\[|[\],]$", "")
    return doc.select("entry_id", F.get_json_object(whole, "$.k").alias("k"))


# Through the engine: records that are written, changed and read back from its own store.


def _engine(spark: SparkSession, pages: int = 2, **options) -> Engine:
    e = Engine(spark, work_dir(spark, "engine"), **options)
    if pages:
        e.provision(pages)
    return e


def _load(e: Engine, name: str, fields: list[tuple], rows: DataFrame, key: str) -> int:
    """A table as one model of tenant 1; gives the model."""
    m = e.define_model(1, name, fields)
    payload = F.to_json(F.struct(*(c for c, *_ in fields)), {"ignoreNullFields": "false"})
    e.ingest(rows.select(F.col(key).alias("idx"), F.lit(1).cast("long").alias("tenant_id"), F.lit(m).alias("model_id"), payload.alias("fields")), 1, m)
    return m


_PERSONS = [("c_name", STRING), ("c_mktsegment", STRING), ("c_acctbal", NUMERIC), ("c_nationkey", INT)]
_KEPT = """WITH c AS (SELECT *, event_id // 500 AS chunk FROM events),
  n AS (SELECT *, row_number() OVER (ORDER BY event_id) AS entry_id FROM c WHERE chunk NOT IN (SELECT chunk FROM c WHERE event_id % 1501 = 7)) """


def _ingested(spark, sf_dir) -> tuple[Engine, int, DataFrame]:
    e = _engine(spark)
    m = e.define_model(1, "event", [("event_type", STRING), ("value", NUMERIC), ("user_id", INT)])
    return e, m, e.ingest(_event_batch(spark, sf_dir).withColumn("tenant_id", F.lit(1).cast("long")), 1, m)


@_query("engine_ingest", _KEPT + "SELECT entry_id, event_type, CASE WHEN event_id % 5 <> 0 THEN value END AS value, user_id FROM n")
def _(spark, sf_dir):
    e, m, _ = _ingested(spark, sf_dir)
    return e.scan(1, m)


@_query("engine_ingest_manifest", "SELECT event_id // 500 AS chunk, CASE WHEN bool_or(event_id % 1501 = 7) THEN 'rolled_back' ELSE 'committed' END AS status, count(*) AS rows, min(CASE WHEN event_id % 1501 = 7 THEN event_id END) AS first_bad FROM events GROUP BY 1")
def _(spark, sf_dir):
    return _ingested(spark, sf_dir)[2]


@_query("engine_search", _KEPT + "SELECT entry_id, user_id FROM n WHERE event_type = 'purchase' AND event_id % 5 <> 0 AND value > 50")
def _(spark, sf_dir):
    e, m, _ = _ingested(spark, sf_dir)
    return e.scan(1, m, json.dumps({"version": "1", "filter": both("and", _PURCHASE, leaf(E, "gt", "value", 50))}), ["user_id"])


@_query("engine_update_delete", "SELECT c_custkey + 1 AS entry_id, CASE WHEN c_custkey = 6 THEN 'New name' ELSE c_name END AS c_name, CASE WHEN c_custkey <> 6 THEN c_acctbal END AS c_acctbal FROM customer WHERE c_custkey <> 8")
def _(spark, sf_dir):
    e = _engine(spark)
    m = _load(e, "customer", _PERSONS, table(spark, sf_dir, "customer"), "c_custkey")
    e.update(1, 7, {"c_name": "New name"})
    e.delete(1, 9)
    return e.scan(1, m, None, ["c_name", "c_acctbal"])


@_query("engine_outbox", "SELECT o_orderkey + 1 AS entry_id, o_totalprice FROM orders WHERE o_totalprice >= 200000")
def _(spark, sf_dir):
    e = _engine(spark, pages=0)
    m = _load(e, "order", [("o_totalprice", NUMERIC), ("o_orderstatus", STRING)], table(spark, sf_dir, "orders"), "o_orderkey")
    for _ in range(2):
        e.reconcile()  # no capacity yet: the entries stay queued
    e.watch()
    e.reconcile()
    return e.scan(1, m, json.dumps({"filter": leaf("order", "gte", "o_totalprice", 200000)}), ["o_totalprice"])


@_query("engine_retype", "SELECT c_custkey + 1 AS entry_id, c_nationkey::DOUBLE AS c_nationkey FROM customer WHERE c_nationkey > 10")
def _(spark, sf_dir):
    e = _engine(spark)
    m = _load(e, "customer", _PERSONS, table(spark, sf_dir, "customer"), "c_custkey")
    e.retype_field(1, m, "c_nationkey", NUMERIC, later=True)
    e.reconcile()
    e.sweep()
    return e.scan(1, m, json.dumps({"filter": leaf("customer", "gt", "c_nationkey", 10)}), ["c_nationkey"])


@_query("engine_import", "SELECT (n_nationkey + 1)::BIGINT AS entry_id, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS model, n_name FROM nation WHERE n_nationkey < 16")
def _(spark, sf_dir):
    e = _engine(spark, settings=Settings(bulk_chunk=4, import_round=2))
    models = [e.define_model(1, name, [("n_name", STRING), ("n_regionkey", INT)]) for name in ("even", "odd")]
    nations = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    e.submit_bulk_write([{"tenantId": 1, "modelId": models[r["n_nationkey"] % 2], "fields": {"n_name": r["n_name"], "n_regionkey": "bad" if r["n_nationkey"] == 18 else r["n_regionkey"]}} for r in nations])
    e.reconcile()
    parts = [e.scan(1, m, None, ["n_name"]).select("entry_id", F.lit(name).alias("model"), "n_name") for m, name in zip(models, ("even", "odd"))]
    return parts[0].union(parts[1])


@_query("engine_quarantine", "SELECT (n_nationkey + 1)::BIGINT AS entry_id, 'schema_incompatibility' AS reason FROM nation WHERE n_nationkey % 5 = 3")
def _(spark, sf_dir):
    e = _engine(spark, pages=0)
    rows = table(spark, sf_dir, "nation").withColumn("n", F.when(F.col("n_nationkey") % 5 == 3, F.lit("bad")).otherwise(F.col("n_regionkey").cast("string")))
    _load(e, "nation", [("n", INT)], rows, "n_nationkey")
    e.watch()
    e.reconcile()
    e.replay(reason="schema_incompatibility")
    e.reconcile()
    return e.quarantined().select("entry_id", "reason")


_PARTS = [("p_name", STRING), ("p_brand", STRING), ("p_size", INT)]


def _artifact(spark, sf_dir, kind: str, separator: str) -> DataFrame:
    e = _engine(spark)
    m = _load(e, "part", _PARTS, table(spark, sf_dir, "part"), "p_partkey")
    e.submit_export(1, m, kind, json.dumps({"filter": leaf("part", "lte", "p_size", 10)}))
    return spark.read.option("lineSep", separator).text(e.run_next_export().artifact_path).withColumnRenamed("value", "line")


@_query("engine_export_csv", """SELECT p_brand || ',' || CASE WHEN contains(p_name, ',') OR contains(p_name, '"') THEN '"' || replace(p_name, '"', '""') || '"' ELSE p_name END || ',' || p_size AS line FROM part WHERE p_size <= 10
  UNION ALL SELECT 'p_brand,p_name,p_size'""")
def _(spark, sf_dir):
    return _artifact(spark, sf_dir, "csv", "\r\n")


@_query("engine_export_json", "SELECT p_name, p_size::BIGINT AS p_size FROM part WHERE p_size <= 10")
def _(spark, sf_dir):
    whole = F.from_json(F.regexp_replace("line", r"^\[|[\],]$", ""), "p_name string, p_size long")
    return _artifact(spark, sf_dir, "json", "\n").select(whole.alias("r")).select("r.*")


FLAGSHIP = "filter_and"

from . import scenarios  # noqa: E402, F401  (registers its queries)
