"""Reports over registries and stores of any size: grouped aggregations, no driver loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..types import FAMILY, FAMILY_SLOTS, LIVE, QUERYABLE, Settings


def family_of(declared: Column) -> Column:
    out = F
    for kind, family in FAMILY.items():
        out = out.when(declared == kind, family)
    return out


def capacity_report(slots: DataFrame) -> DataFrame:
    """Per family: slots, free, indexed and both; families without slots count 0."""
    families = slots.sparkSession.createDataFrame([(f,) for f in FAMILY_SLOTS], "slot_type string")
    free, indexed = F.col("status") == "free", F.col("is_indexed")
    got = slots.groupBy("slot_type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(free).alias("free"), F.count_if(indexed).alias("indexed"), F.count_if(free & indexed).alias("indexed_free"),
    )
    return families.join(got, "slot_type", "left").na.fill(0)


def capacity_totals(slots: DataFrame) -> DataFrame:
    free = F.count_if(F.col("status") == "free")
    total = F.count(F.lit(1))
    return slots.agg(F.count_distinct("page_id").alias("pages"), total.alias("total_slots"), free.alias("total_free"), F.coalesce(F.try_divide(free, total), F.lit(0.0)).alias("free_ratio"))


def pending_demand(fields: DataFrame, slots: DataFrame) -> DataFrame:
    """Filterable fields without a live slot, by family."""
    live = slots.where(F.col("status").isin(*LIVE) & F.col("field_id").isNotNull()).select(F.col("field_id").alias("id"))
    return fields.where("is_filterable").join(live, "id", "left_anti").groupBy(family_of(F.col("declared_type")).alias("slot_type")).agg(F.count(F.lit(1)).alias("waiters"))


def provisioning_columns(capacity: DataFrame, demand: DataFrame) -> DataFrame:
    """How many columns to index for each family with waiters: the shortfall, at least one, at most a page's."""
    size = F.create_map(*(F.lit(x) for kv in FAMILY_SLOTS.items() for x in kv))
    short = F.col("waiters") - F.coalesce("indexed_free", F.lit(0))
    return demand.join(capacity, "slot_type", "left").select("slot_type", "waiters", F.greatest(F.lit(1), F.least(short, size[F.col("slot_type")])).cast("long").alias("columns"))


def cardinality_sample(records: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Per tenant and typed column: rows, distinct values, selectivity.  ``columns``: name -> column.

    One pass: the columns' values are stacked and grouped with the tenant, which partial
    aggregation thins before the only shuffle of each step.
    """
    pairs = F.array(*(F.struct(F.lit(n).alias("column"), F.col(c).cast("string").alias("value")) for n, c in columns.items()))
    long = records.select("tenant_id", F.explode(pairs).alias("p")).select("tenant_id", "p.*")
    by_value = long.groupBy("tenant_id", "column", "value").agg(F.count(F.lit(1)).alias("n"))
    return by_value.groupBy("tenant_id", "column").agg(F.sum("n").alias("row_count"), F.count("value").alias("distinct_count")).withColumn(
        "selectivity", F.when(F.col("row_count") == 0, 0.0).otherwise(F.round(F.col("distinct_count") / F.col("row_count"), 4))
    )


def low_cardinality(sample: DataFrame, settings: Settings = Settings()) -> DataFrame:
    reasons = F.concat_ws(
        ",",
        F.when((F.col("selectivity") < settings.low_selectivity) & (F.col("row_count") >= settings.low_selectivity_min_rows), "selectivity"),
        F.when(F.col("distinct_count") < settings.low_distinct, "distinct_floor"),
    )
    return sample.withColumn("reasons", reasons).where("reasons <> ''")


def spread_report(models: DataFrame, fields: DataFrame, slots: DataFrame) -> DataFrame:
    """Per tenant and model: pages its queryable slots are on, slots, the least pages possible, the excess."""
    own = slots.where(F.col("status").isin(*QUERYABLE)).select("page_id", "slot_type", F.col("field_id").alias("id"))
    df = own.join(fields.where("is_filterable").select("id", "model_id"), "id").join(models.select(F.col("id").alias("model_id"), "tenant_id"), "model_id")
    least = [F.ceil(F.count_if(F.col("slot_type") == f) / n) for f, n in FAMILY_SLOTS.items()]
    got = df.groupBy("tenant_id", "model_id").agg(F.count_distinct("page_id").alias("pages"), F.count(F.lit(1)).alias("live_slots"), F.greatest(*least).cast("long").alias("min_pages"))
    return got.withColumn("excess", F.col("pages") - F.col("min_pages"))


def high_spread(report: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return report.where((F.col("pages") >= 2) & (F.col("excess") >= settings.spread_threshold))


def free_capacity_by_page(slots: DataFrame) -> DataFrame:
    return slots.where((F.col("status") == "free") & F.col("is_indexed")).groupBy("page_id", "slot_type").agg(F.count(F.lit(1)).alias("free"))


def affine_slots(requests: DataFrame, fields: DataFrame, slots: DataFrame) -> DataFrame:
    """For each request (model_id, slot_type): the free slot it gets.

    Indexed before not, a page that hosts the model before others, then the oldest.  Each
    model's own candidates are the best free slot of each (page, family) only.
    """
    hosts = slots.where(F.col("status").isin(*LIVE)).select("page_id", F.col("field_id").alias("id")).join(fields.select("id", "model_id"), "id").select("model_id", "page_id").distinct().withColumn("host", F.lit(1))
    free = slots.where("status = 'free'").groupBy("slot_type", "page_id", "is_indexed").agg(F.min("id").alias("slot_id"))
    df = requests.join(free, "slot_type").join(hosts, ["model_id", "page_id"], "left")
    best = Window.partitionBy("model_id", "slot_type").orderBy(F.desc("is_indexed"), F.col("host").desc_nulls_last(), "page_id", "slot_id")
    return df.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("model_id", "slot_type", "page_id", "slot_id", F.col("host").isNotNull().alias("affine"))


def round_robin(jobs: DataFrame, where: str) -> DataFrame:
    """Pending jobs in order of service: tenants by their oldest job, then each tenant's own by age.

    Positions come from range-partitioned tasks, whose table is written to ``where``.
    """
    oldest = jobs.groupBy("tenant_id").agg(F.min("created_at").alias("tenant_oldest"))
    placed = numbered(jobs.join(oldest, "tenant_id"), ["tenant_oldest", "created_at", "id"], where, "position")
    return placed.withColumn("position", F.col("position") + 1)


def next_job(jobs: DataFrame) -> DataFrame:
    """The job a worker claims; only a top-1, so no global sort."""
    oldest = F.min("created_at").over(Window.partitionBy("tenant_id"))
    return jobs.where("status = 'pending'").withColumn("_o", oldest).orderBy("_o", "created_at", "id").limit(1).drop("_o")


def active_by_tenant(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("pending", "processing")).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("active"))


def stale_jobs(jobs: DataFrame, now: Column, lease_seconds: int) -> DataFrame:
    return jobs.where((F.col("status") == "processing") & (F.col("heartbeat_at") < now - F.make_dt_interval(secs=F.lit(lease_seconds))))


def gc_candidates(jobs: DataFrame, now: Column, settings: Settings = Settings()) -> DataFrame:
    age = lambda s: F.col("completed_at") < now - F.make_dt_interval(secs=F.lit(s))
    done = (F.col("status") == "completed") & age(settings.gc_completed_seconds) | (F.col("status") == "failed") & age(settings.gc_failed_seconds)
    return jobs.where(F.col("artifact_path").isNotNull() & done)


def duplicate_live_slots(slots: DataFrame) -> DataFrame:
    """Fields with more than one live slot; the invariant is that there are none."""
    return slots.where(F.col("status").isin(*LIVE) & F.col("field_id").isNotNull()).groupBy("field_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def hosting_pages(fields: DataFrame, slots: DataFrame) -> DataFrame:
    """Each model's pages, once."""
    return slots.select("page_id", F.col("field_id").alias("id")).join(fields.select("id", "model_id"), "id").select("model_id", "page_id").distinct()


def next_page_number(slots: DataFrame) -> DataFrame:
    return slots.agg((F.coalesce(F.max("page_id"), F.lit(0)) + 1).alias("next_page"))


def schema_listing(models: DataFrame, fields: DataFrame, slots: DataFrame) -> DataFrame:
    live = slots.where(F.col("status").isin(*QUERYABLE) & F.col("field_id").isNotNull()).select(F.col("field_id").alias("field_id"), F.lit(True).alias("_live"))
    f = fields.select(F.col("id").alias("field_id"), "model_id", F.col("name").alias("field_name"), "declared_type", "is_filterable")
    df = f.join(live, "field_id", "left").join(models.select(F.col("id").alias("model_id"), "tenant_id", F.col("name").alias("model_name")), "model_id")
    return df.select("tenant_id", "model_id", "model_name", "field_id", "field_name", "declared_type", "is_filterable", (F.col("is_filterable") & F.coalesce("_live", F.lit(False))).alias("is_indexed"))
