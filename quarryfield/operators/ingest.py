"""Writes: envelopes, the split of payloads into typed columns, bulk chunks, updates, deletes."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EntryNotFound, MalformedPayload, PayloadTooLarge, UncoercibleValue, tenant
from ..functions.numbering import numbered
from ..functions.records import kind_of, payload, text_of, value_of
from ..registry import FieldView
from ..types import SPARK_TYPE, Settings
from .coercion import write_value

#: A batch to write: idx orders its rows.
BATCH = T.StructType([T.StructField("idx", T.LongType()), T.StructField("tenant_id", T.LongType()), T.StructField("model_id", T.IntegerType()), T.StructField("fields", T.StringType())])


def parse_envelope(raw: Any, key: str = "") -> dict:
    """``{tenantId, modelId, fields}``; other keys are ignored."""
    if not isinstance(raw, dict):
        raise MalformedPayload(key, "not an object")
    at = lambda name: f"{key}.{name}" if key else name
    for name in ("tenantId", "modelId"):
        if name not in raw or isinstance(raw[name], bool) or not isinstance(raw[name], int):
            raise MalformedPayload(at(name), "an integer is needed")
    fields = raw.get("fields")
    if not isinstance(fields, dict):
        raise MalformedPayload(at("fields"), "an object is needed")
    return {"tenant_id": raw["tenantId"], "model_id": raw["modelId"], "fields": fields}


def parse_envelopes(raw: Any) -> list[dict]:
    if isinstance(raw, str):
        try:
            raw = json.loads(raw)
        except ValueError as e:
            raise MalformedPayload("", f"not JSON: {e}") from None
    if not isinstance(raw, list):
        raise MalformedPayload("", "not an array")
    return [parse_envelope(x, f"[{i}]") for i, x in enumerate(raw)]


def batch(spark, envelopes: list[dict]) -> DataFrame:
    return spark.createDataFrame([(i, tenant(e["tenant_id"]), e["model_id"], json.dumps(e["fields"], ensure_ascii=False)) for i, e in enumerate(envelopes)], BATCH)


def split(rows: DataFrame, fields: dict[str, FieldView]) -> DataFrame:
    """Adds typed columns, group presence, ``missing`` (filterable fields without a slot) and ``faults``.

    Fields not registered or not filterable stay in the payload alone.
    """
    wanted = [(i, name, view) for i, (name, view) in enumerate(fields.items()) if view.field.filterable]
    # Each step is a column of its own, used more than once, so that Catalyst computes it once: the
    # parsed payload, the value of each key (null only if the key is absent), its kind and text, its outcome.
    df = rows.withColumn("_payload", payload(F.col("fields")))
    df = df.withColumns({f"_value_{i}": value_of(F.col("_payload"), name) for i, name, _ in wanted})
    mapped = [(i, f"_value_{i}", view.field.declared_type) for i, _, view in wanted if view.slot is not None]
    df = df.withColumns({f"_kind_{i}": kind_of(F.col(v)) for i, v, _ in mapped} | {f"_text_{i}": text_of(F.col(v)) for i, v, _ in mapped})
    df = df.withColumns({f"_outcome_{i}": write_value(F.col(v), declared, F.col(f"_kind_{i}"), F.col(f"_text_{i}")) for i, v, declared in mapped})
    typed, groups, missing, faults = {}, {}, [], []
    for i, name, view in wanted:
        present = F.col(f"_value_{i}").isNotNull()
        if view.slot is None:
            missing.append(F.when(present, F.lit(name)))
            continue
        outcome = F.col(f"_outcome_{i}")
        typed[view.column] = outcome["value"].cast(SPARK_TYPE[view.field.declared_type])
        faults.append(F.when(outcome["reason"].isNotNull(), F.concat(F.lit(f"{name}: "), outcome["reason"])))
        groups.setdefault(view.group, []).append(present)
    some = lambda cols: F.filter(F.array(*cols), lambda x: x.isNotNull()) if cols else F.array().cast("array<string>")
    present = {}
    for group, cols in groups.items():
        present[group] = cols[0]
        for c in cols[1:]:
            present[group] = present[group] | c
    faulty = F.when(F.col("_payload").isNull(), F.array(F.lit("malformed_json"))).otherwise(some(faults))
    return df.select(*rows.columns, *(c.alias(n) for n, c in (typed | present).items()), some(missing).alias("missing"), faulty.alias("faults"))


def assign_ids(rows: DataFrame, first: int, where: str) -> DataFrame:
    """``entry_id`` from ``first`` on, in order of idx; the numbered rows are written to ``where`` once."""
    return with_ids(numbered(rows, ["idx"], where), first)


def with_ids(rows: DataFrame, first: int) -> DataFrame:
    return rows.withColumn("entry_id", F.col("nth") + F.lit(first)).drop("nth")


def stamped(rows: DataFrame, now: Column) -> DataFrame:
    """Split rows with an entry_id as the store keeps them."""
    keep = [c for c in rows.columns if c not in ("idx", "missing", "faults", "entry_id", "tenant_id", "model_id", "fields", "chunk")]
    return rows.select("entry_id", "tenant_id", "model_id", now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"), "fields", *keep)


def require_clean(split_rows: DataFrame) -> None:
    bad = split_rows.where(F.size("faults") > 0).select("idx", "faults").orderBy("idx").first()
    if bad:
        raise UncoercibleValue(f"row {bad['idx']}: {', '.join(bad['faults'])}")


def check_bulk_size(n: int, settings: Settings = Settings()) -> None:
    if n > settings.bulk_max:
        raise PayloadTooLarge(f"{n} entities; at most {settings.bulk_max} in one call")


def chunked(split_rows: DataFrame, chunk_size: int) -> DataFrame:
    return split_rows.withColumn("chunk", F.floor(F.col("idx") / chunk_size).cast("long"))


def chunk_manifest(chunks: DataFrame) -> DataFrame:
    """One bad row rolls back its chunk and no other."""
    bad = F.size("faults") > 0
    return chunks.groupBy("chunk").agg(
        F.when(F.bool_or(bad), "rolled_back").otherwise("committed").alias("status"),
        F.count(F.lit(1)).alias("rows"),
        F.min(F.when(bad, F.col("idx"))).alias("first_bad"),
    )


def upsert(current: DataFrame, changes: DataFrame, key: str = "entry_id", order: str = "seq") -> DataFrame:
    """Last write wins: the newest change of each key replaces its row, new keys are added."""
    latest = changes.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_rank = 1").drop("_rank", order)
    return current.join(latest.select(key), key, "left_anti").unionByName(latest, allowMissingColumns=True)


def filled_in(current: DataFrame, drained: DataFrame) -> DataFrame:
    """Records with the payload and typed columns of ``drained``, one row for each of its ids, in one join; typed columns it lacks become null there."""
    fixed = ("entry_id", "tenant_id", "model_id", "created_at", "updated_at", "deleted_at")
    new = {c: f"_new_{i}" for i, c in enumerate(drained.columns) if c not in fixed}
    rows = current.join(drained.select("entry_id", F.lit(True).alias("_hit"), *(F.col(c).alias(n) for c, n in new.items())), "entry_id", "left")
    put = {c: F.when(F.col("_hit"), F.col(new[c]) if c in new else None).otherwise(F.col(c) if c in current.columns else None) for c in [*current.columns, *new] if c not in fixed}
    return rows.select(*(put[c].alias(c) if c in put else c for c in dict.fromkeys([*current.columns, *new])))


def replace_entry(records: DataFrame, fields: dict[str, FieldView], tenant_id: int, entry_id: int, payload_json: str, now: Column) -> DataFrame:
    """Full replacement: fields left out become null, model and creation time stay."""
    hit = (F.col("entry_id") == entry_id) & (F.col("tenant_id") == tenant(tenant_id)) & F.col("deleted_at").isNull()
    old = records.where(hit).select("tenant_id", "model_id", "created_at", "entry_id").first()
    if old is None:
        raise EntryNotFound(f"no entry {entry_id}")
    spark = records.sparkSession
    new = split(spark.createDataFrame([(0, tenant_id, old["model_id"], payload_json)], BATCH), fields)
    require_clean(new)
    for view in fields.values():
        if view.slot is not None and view.group in records.columns:
            new = new.withColumn(view.group, F.lit(True))  # live slots are written, as null where left out
    new = new.withColumns({"entry_id": F.lit(entry_id).cast("long"), "created_at": F.lit(old["created_at"]).cast("timestamp_ntz"), "updated_at": now, "deleted_at": F.lit(None).cast("timestamp_ntz")})
    return records.where(~hit).unionByName(new.select(*(c for c in records.columns if c in new.columns)), allowMissingColumns=True)


def soft_delete(records: DataFrame, tenant_id: int, entry_id: int, now: Column) -> tuple[DataFrame, bool]:
    """The typed columns stay as they were; true only if the entry was not deleted yet."""
    hit = (F.col("entry_id") == entry_id) & (F.col("tenant_id") == tenant(tenant_id)) & F.col("deleted_at").isNull()
    changed = not records.where(hit).isEmpty()
    return records.withColumns({"deleted_at": F.when(hit, now).otherwise(F.col("deleted_at")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}), changed
