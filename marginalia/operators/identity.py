"""Effective permissions, permission drift, partitions and retention, row isolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: what each built-in role may do --------------------------------------------------
ROLE_PERMISSIONS = {
    "owner": ("user:read", "user:write", "tenant:read", "tenant:admin", "knowledge:read", "knowledge:write",
              "knowledge:admin", "rag:query", "chat:use", "analytics:read", "audit:read"),
    "admin": ("user:read", "user:write", "tenant:read", "knowledge:read", "knowledge:write", "knowledge:admin",
              "rag:query", "chat:use", "analytics:read", "audit:read"),
    "editor": ("tenant:read", "knowledge:read", "knowledge:write", "rag:query", "chat:use"),
    "viewer": ("tenant:read", "knowledge:read", "rag:query", "chat:use"),
}
# ---------------------------------------------------------------------------------------------------
MONTHS_AHEAD = 3


def permissions_of(role: Column) -> Column:
    """Permissions of a role as an array; NULL for a role nobody declared."""
    pairs = [x for name, codes in ROLE_PERMISSIONS.items() for x in (F.lit(name), F.array(*[F.lit(c) for c in codes]))]
    return F.try_element_at(F.create_map(*pairs), role)


def effective_permissions(user_roles: DataFrame, denied: DataFrame | None = None) -> DataFrame:
    """Union of the permissions of a user's roles; unknown roles give nothing, the deny list takes away."""
    granted = user_roles.select("tenant_id", "user_id", F.explode(permissions_of(F.col("role"))).alias("permission")).distinct()
    return granted if denied is None else granted.join(denied, ["tenant_id", "user_id", "permission"], "left_anti")


def permission_drift(stored: DataFrame) -> DataFrame:
    """Declared against stored (scope, role, permission): what is missing and what is extra per scope."""
    scopes = stored.select("scope").distinct()
    roles = F.explode(F.array(*[F.lit(r) for r in ROLE_PERMISSIONS])).alias("role")
    declared = scopes.select("scope", roles).select("scope", "role", F.explode(permissions_of(F.col("role"))).alias("permission"))
    have = stored.select("scope", "role", "permission")
    missing = declared.exceptAll(have).withColumn("drift", F.lit("missing"))
    return missing.unionByName(have.exceptAll(declared).withColumn("drift", F.lit("extra")))


def month_name(table: Column, month: Column) -> Column:
    return F.concat(table, F.lit("_"), F.date_format(month, "yyyy_MM"))


def missing_partitions(existing: DataFrame, now: Column, ahead: int = MONTHS_AHEAD) -> DataFrame:
    """Month partitions each table should have from this month on, minus those it has.

    ``existing``: table_name, partition.
    """
    start = F.trunc(now, "MM")
    wanted = existing.select("table_name").distinct().select(
        "table_name", F.explode(F.sequence(start, F.add_months(start, ahead), F.expr("interval 1 month"))).alias("start")
    ).select("table_name", month_name(F.col("table_name"), F.col("start")).alias("partition"), "start", F.add_months("start", 1).alias("end"))
    return wanted.join(existing, ["table_name", "partition"], "left_anti")


def cutoff(months: Column, now: Column) -> Column:
    """First day of this month, ``months`` months back."""
    return F.add_months(F.trunc(now, "MM"), -months)


def expired_partitions(partitions: DataFrame, retention: DataFrame, now: Column, *, drop: bool = False) -> DataFrame:
    """Partitions whose upper bound is at or before their table's cutoff; tables without a policy stay.

    ``retention`` (table_name, months) is one configuration line. Partitions are detached unless dropping
    is asked for; a partition without a readable bound is never touched.
    """
    kept = retention.select("table_name", cutoff(F.col("months"), now).alias("cutoff"))
    return partitions.join(kept, "table_name").filter(F.col("upper_bound") <= F.col("cutoff")).select(
        "table_name", "partition", "upper_bound", "cutoff", F.lit("drop" if drop else "detach").alias("action")
    )


def split_rows(rows: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, error rows with a reason): one tenant's bad row never stops the job for the others."""
    marked = rows.withColumn("problem", problem)
    return marked.filter(F.col("problem").isNull()).drop("problem"), marked.filter(F.col("problem").isNotNull())
