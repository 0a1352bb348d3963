"""Audit trail and access-log analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# --- fixed values: write methods, audited operations, exempt operations ----------------------------
WRITE_METHODS = ("POST", "PUT", "PATCH", "DELETE")
REGISTRY = (
    ("users_create", "user.create", "user"),
    ("users_update", "user.update", "user"),
    ("users_update_me", "user.update", "user"),
    ("users_deactivate", "user.deactivate", "user"),
    ("auth_change_password", "user.change_password", "user"),
    ("auth_logout", "auth.logout", "session"),
    ("tenants_update_current", "tenant.update", "tenant"),
    ("knowledge_bases_create", "knowledge_base.create", "knowledge_base"),
    ("knowledge_bases_update", "knowledge_base.update", "knowledge_base"),
    ("knowledge_bases_delete", "knowledge_base.delete", "knowledge_base"),
    ("documents_upload", "document.upload", "document"),
    ("documents_reingest", "document.reingest", "document"),
    ("documents_delete", "document.delete", "document"),
)
EXEMPT = (
    "auth_refresh", "conversations_create", "conversations_update", "conversations_delete",
    "conversations_send_message", "conversations_stop_message", "rag_query", "notifications_mark_read",
)
RECORDED_ELSEWHERE = ("auth_login",)
ACCESS_EVENT = "http_request"
SLO_MS = 300.0
# ---------------------------------------------------------------------------------------------------


def outcome(status: Column) -> Column:
    return F.when(status == 403, "denied").when(status < 400, "succeeded").otherwise("failed")


def audit_rows(requests: DataFrame) -> DataFrame:
    """Write requests of a tenant as audit rows; an operation nobody registered is still recorded."""
    writes = requests.filter(
        F.col("method").isin(*WRITE_METHODS) & F.col("tenant_id").isNotNull()
        & ~F.coalesce(F.col("operation_id").isin(*EXEMPT, *RECORDED_ELSEWHERE), F.lit(False))
    )
    actions = F.create_map(*[F.lit(x) for op, action, _ in REGISTRY for x in (op, action)])
    kinds = F.create_map(*[F.lit(x) for op, _, kind in REGISTRY for x in (op, kind)])
    op = F.coalesce("operation_id", F.lit("unknown"))
    return writes.select(
        "id", "tenant_id", "created_at", "actor_id",
        F.coalesce(F.try_element_at(actions, op), F.concat(F.lit("unregistered."), op)).alias("action"),
        F.coalesce(F.try_element_at(kinds, op), F.lit("unknown")).alias("resource_type"),
        outcome(F.col("outcome_status")).alias("outcome"), F.col("outcome_status").alias("status"),
    )


def audit_query(
    audit: DataFrame, *, action: str | None = None, resource_type: str | None = None, actor_id=None,
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Equality filters and an inclusive UTC day range, both pushed to the scan; page with ``paging.page``."""
    rows = audit
    for column, value in (("action", action), ("resource_type", resource_type), ("actor_id", actor_id)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    if start is not None:
        rows = rows.filter(F.col("created_at") >= F.lit(start).cast("date").cast("timestamp_ntz"))
    if end is not None:
        rows = rows.filter(F.col("created_at") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    return rows


def append_only_violations(audit: DataFrame, columns: list[str]) -> DataFrame:
    """Ids that were seen with two different contents: an append-only table can have none."""
    digest = F.xxhash64(*columns)
    return audit.groupBy("id").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).filter("a <> b").select("id")


def access_events(lines: DataFrame) -> DataFrame:
    """Tolerant access-log reader over ``value`` lines: ts, path, status, duration_ms.

    Lines that are not JSON objects, or are cut off, are skipped; only request events with a numeric
    duration remain. ``ts`` is NULL where it cannot be read.
    """
    doc = F.try_parse_json(F.trim("value"))
    rows = lines.filter(F.ltrim("value").startswith("{")).select(doc.alias("d")).filter(F.col("d").isNotNull())
    kind = F.schema_of_variant(F.try_variant_get("d", "$.duration_ms", "variant"))
    numeric = (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
    stamp = F.try_variant_get("d", "$.ts", "string")
    return rows.filter((F.try_variant_get("d", "$.event", "string") == ACCESS_EVENT) & numeric).select(
        F.try_to_timestamp(stamp).alias("ts"), F.try_variant_get("d", "$.path", "string").alias("path"),
        F.try_variant_get("d", "$.status", "int").alias("status"), F.try_variant_get("d", "$.duration_ms", "double").alias("duration_ms"),
    )


def last_seconds(events: DataFrame, seconds: float) -> DataFrame:
    """Events within ``seconds`` of the newest one. Untimed rows are dropped, unless no row has a time."""
    newest = events.agg(F.max("ts")).scalar()
    limit = newest - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))
    return events.filter(newest.isNull() | (F.col("ts") >= limit))


def latency_report(events: DataFrame, *, slo_ms: float = SLO_MS) -> DataFrame:
    """Exact nearest-rank percentiles per path, with n, max, mean and the p95 target.

    A path may hold most of the log, so its rows are never sorted in one task: counts per whole
    millisecond locate the few milliseconds that hold the wanted ranks, and only the rows inside those
    are numbered.
    """
    rows = events.select("path", "duration_ms", F.floor("duration_ms").alias("ms"))
    per_ms = rows.groupBy("path", "ms").agg(
        F.count("*").alias("n"), F.max("duration_ms").alias("max"), F.sum("duration_ms").alias("sum")
    )
    upto = F.sum("n").over(W.partitionBy("path").orderBy("ms").rowsBetween(W.unboundedPreceding, 0))
    placed = per_ms.select("path", "ms", "n", upto.alias("through"))
    totals = per_ms.groupBy("path").agg(
        F.sum("n").alias("n"), F.max("max").alias("max"), (F.sum("sum") / F.sum("n")).alias("mean")
    )
    wanted = totals.select("path", F.col("n").alias("total"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(share).alias("share"))
        for name, share in (("p50", 0.50), ("p95", 0.95), ("p99", 0.99))
    ])).alias("w")).select(
        "path", "w.name", F.greatest(F.lit(1), F.least("total", _nearest_rank(F.col("total"), F.col("w.share")))).alias("rank")
    )
    holds = (F.col("rank") > F.col("through") - F.col("n")) & (F.col("rank") <= F.col("through"))
    targets = placed.join(wanted, "path").filter(holds).select(
        "path", "ms", "name", (F.col("rank") - (F.col("through") - F.col("n"))).alias("offset")
    )
    inside = rows.join(targets.select("path", "ms").distinct(), ["path", "ms"], "left_semi")
    counted = inside.groupBy("path", "ms", "duration_ms").agg(F.count("*").alias("c"))
    order = W.partitionBy("path", "ms").orderBy("duration_ms").rowsBetween(W.unboundedPreceding, 0)
    counted = counted.withColumn("hi", F.sum("c").over(order)).withColumn("lo", F.col("hi") - F.col("c"))
    values = counted.join(targets, ["path", "ms"]).filter((F.col("offset") > F.col("lo")) & (F.col("offset") <= F.col("hi")))
    wide = values.groupBy("path").agg(*[
        F.max(F.when(F.col("name") == name, F.col("duration_ms"))).alias(name) for name in ("p50", "p95", "p99")
    ])
    return totals.join(wide, "path").select(
        "path", "n", "p50", "p95", "p99", "max", "mean", (F.col("p95") < slo_ms).alias("within_slo")
    )


def _nearest_rank(total: Column, share: Column) -> Column:
    """round(share * n + 0.5), ties to even."""
    return F.rint(share * total + 0.5).cast("long")
