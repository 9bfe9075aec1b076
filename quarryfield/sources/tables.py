"""Plain tables as record stores: which column feeds which declared field.

Keys start at 0 and record ids at 1, so ``entry_id = key + 1``.  The tables have no nulls, so
the event model derives some: see ``EVENT``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import Registry
from ..types import DATETIME, INT, NUMERIC, SPARK_TYPE, STRING

TENANTS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Source:
    model: str
    table: str
    key: str
    tenant: str  # SQL over the table
    fields: tuple[tuple[str, str, bool], ...]  # name, declared type, filterable
    values: dict[str, str]  # SQL of each typed field, if not the column itself
    deleted: str = "false"
    present: dict[str, str] | None = None  # SQL of group presence by field, if not always

    def registry(self) -> Registry:
        """The model of every tenant as one: model id 1, one page of slots for each field group."""
        return Registry().provision(2).define(1, self.model, self.fields)


EVENT = Source(
    "event", "events", "event_id", f"user_id % {TENANTS} + 1",
    (("event_type", STRING, True), ("value", NUMERIC, True), ("user_id", INT, True), ("ts", DATETIME, True), ("k", INT, False)),
    {"ts": "cast(date_trunc('second', ts) as timestamp_ntz)", "value": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END"},
    deleted="event_id % 17 = 0",
    present={"value": "event_id % 10 <> 0"},
)
CUSTOMER = Source("customer", "customer", "c_custkey", f"c_nationkey % {TENANTS} + 1", (("c_name", STRING, True), ("c_mktsegment", STRING, True), ("c_acctbal", NUMERIC, True), ("c_nationkey", INT, True)), {})
ORDER = Source(
    "order", "orders", "o_orderkey", f"o_custkey % {TENANTS} + 1",
    (("o_orderstatus", STRING, True), ("o_orderpriority", STRING, True), ("o_totalprice", NUMERIC, True), ("o_orderdate", DATETIME, True), ("o_custkey", INT, True)), {},
)
PART = Source("part", "part", "p_partkey", "1", (("p_name", STRING, True), ("p_brand", STRING, True), ("p_type", STRING, True), ("p_size", INT, True), ("p_retailprice", NUMERIC, True)), {})


def records(spark: SparkSession, sf_dir: str, source: Source) -> tuple[DataFrame, Registry]:
    """The table as a record store, lazily; comparisons on plain columns reach the Parquet scan."""
    reg = source.registry()
    df, presence = table(spark, sf_dir, source.table), source.present or {}
    typed, groups = {}, {}
    for name, view in reg.view(1).items():
        if view.field.filterable:
            typed[view.column] = F.expr(source.values.get(name, name)).cast(SPARK_TYPE[view.field.declared_type])
            groups.setdefault(view.group, set()).add(name)
    # Fields of one page share its presence; the first field with a rule decides.
    present = {g: F.expr(next((presence[n] for n in sorted(names) if n in presence), "true")) for g, names in groups.items()}
    fields = F.col("props") if source.table == "events" else F.to_json(F.struct(*(f for f, _, _ in source.fields)))
    return df.select(
        (F.col(source.key) + 1).cast("long").alias("entry_id"), F.expr(source.tenant).cast("long").alias("tenant_id"), F.lit(1).alias("model_id"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"), F.expr(f"CASE WHEN {source.deleted} THEN timestamp_ntz'2024-01-01 00:00:00' END").alias("deleted_at"),
        fields.alias("fields"), *(c.alias(n) for n, c in typed.items()), *(c.alias(n) for n, c in present.items()),
    ), reg
