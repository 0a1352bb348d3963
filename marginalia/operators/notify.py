"""Notifications: collapsing, recipients, channels, dedupe, inbox, read marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.session import materialise

# --- fixed values: channels by type, roles that get account-wide news, titles and bodies ------------------------------
CHANNELS = {
    "document_failed": ("in_app", "email"),
    "quota_threshold": ("in_app", "email"),
    "document_ready": ("in_app",),
    "evaluation_completed": ("in_app",),
}
MANAGERS = ("owner", "admin")
COLLAPSE_MINUTES = 10
PAIRS = 1_000_000  # rows of documents and managers that one task makes, some
KEPT_IDS = 9
READY_KEY = ["tenant_id", "user_id", "kb_id", "slot"]
ONE_READY, MANY_READY = " 已完成", " 份文件已完成"
ONE_BODY, AND, MANY_BODY = "可以開始問答了。", " 等 ", " 份文件可以開始問答了。"
# ---------------------------------------------------------------------------------------------------


def ready_parts(events: DataFrame, minutes: int = COLLAPSE_MINUTES) -> DataFrame:
    """Per user, knowledge base and aligned time bucket: what a notice of these events needs; parts merge.

    ``events``: tenant_id, user_id, kb_id, doc_id, filename, ts. The first nine documents are found without
    gathering a bucket: a row limit prunes map-side.
    """
    slot = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (minutes * 60))
    rows = events.withColumn("slot", slot)
    whole = rows.groupBy(*READY_KEY).agg(
        F.count("*").alias("count"), F.max(F.struct("ts", "doc_id", "filename")).alias("last"))
    place = F.row_number().over(W.partitionBy(*READY_KEY).orderBy("ts", "doc_id"))
    early = rows.withColumn("_r", place).filter(F.col("_r") <= KEPT_IDS)
    ids = early.groupBy(*READY_KEY).agg(F.array_sort(F.collect_list(F.struct("ts", "doc_id"))).alias("early"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in READY_KEY]
    named = ids.select(*[F.col(k).alias(f"_k_{k}") for k in READY_KEY], "early")
    return whole.join(named, same).select(*READY_KEY, "count", "last", "early")


def ready_notices(parts: DataFrame) -> DataFrame:
    """One unread notice per user, knowledge base and bucket, from parts of its events."""
    merged = parts.groupBy(*READY_KEY).agg(
        F.sum("count").cast("long").alias("count"), F.max("last").alias("last"),
        F.slice(F.array_sort(F.flatten(F.collect_list("early"))), 1, KEPT_IDS).alias("early"))
    first = F.transform("early", lambda s: s["doc_id"])
    documents = F.when(F.col("count") > KEPT_IDS, F.concat(first, F.array("last.doc_id"))).otherwise(first)
    many = F.col("count") > 1
    return merged.select(
        *READY_KEY, "count", F.col("last.ts").alias("updated_at"), documents.alias("document_ids"),
        F.when(many, F.concat("count", F.lit(MANY_READY))).otherwise(F.concat("last.filename", F.lit(ONE_READY))).alias("title"),
        F.when(many, F.concat("last.filename", F.lit(AND), "count", F.lit(MANY_BODY))).otherwise(ONE_BODY).alias("body"),
        F.concat(F.lit("document_ready:"), "kb_id", F.lit(":"), "slot").alias("dedupe_key"),
    )


def collapse_ready(events: DataFrame, minutes: int = COLLAPSE_MINUTES) -> DataFrame:
    """One unread row per (user, knowledge base, aligned time bucket) of "ready" events.

    The document list holds the first nine and the latest one.
    """
    return ready_notices(ready_parts(events, minutes))


def recipients(documents: DataFrame, user_roles: DataFrame, users: DataFrame) -> DataFrame:
    """Who hears about a document: its uploader, else the tenant's active owners and admins, once each.

    A tenant's documents meet all its managers, so the result may be far larger than both. A tenant's documents are
    dealt to as many parts as their rows with all managers need, its managers are copied to each part, and parts are
    spread over tasks by that number, not by their own size.
    """
    active = users.filter(F.col("status") == "active").select("user_id")
    managers = user_roles.filter(F.col("role").isin(*MANAGERS)).join(active, "user_id", "left_semi").select(
        "tenant_id", F.col("user_id").alias("recipient")
    ).distinct()
    known = documents.filter(F.col("uploaded_by").isNotNull()).select("doc_id", F.col("uploaded_by").alias("recipient"))
    orphans = documents.filter(F.col("uploaded_by").isNull()).select("doc_id", "tenant_id")
    managers = materialise(managers, "managers")
    sizes = orphans.groupBy("tenant_id").agg(F.count("*").alias("_docs")).join(
        managers.groupBy("tenant_id").agg(F.count("*").alias("_managers")), "tenant_id")
    parts = materialise(sizes.select("tenant_id", F.ceil(F.col("_docs") * F.col("_managers") / PAIRS).alias("_parts")), "recipient-parts")
    tasks = max(int(parts.agg(F.sum("_parts")).first()[0] or 1), documents.sparkSession.sparkContext.defaultParallelism)
    dealt = orphans.join(parts, "tenant_id").withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.col("_parts")))
    copied = managers.join(parts, "tenant_id").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    key = ["tenant_id", "_part"]
    pairs = dealt.select("doc_id", *key).repartition(tasks, *key).join(copied.select("recipient", *key).repartition(tasks, *key), key)
    return known.unionByName(pairs.select("doc_id", "recipient"))


def deliveries(notifications: DataFrame, *, email_enabled: bool = True) -> DataFrame:
    """One row per notification and channel it goes to; the e-mail rows are the mail queue."""
    declared = F.create_map(*[x for kind, names in CHANNELS.items() for x in (F.lit(kind), F.array(*[F.lit(n) for n in names]))])
    names = F.coalesce(F.try_element_at(declared, F.col("type")), F.array(F.lit("in_app")))
    if not email_enabled:
        names = F.filter(names, lambda n: n != "email")
    return notifications.select("id", "tenant_id", "user_id", "type", F.explode(names).alias("channel"))


def new_notifications(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates not yet stored under (tenant, user, dedupe_key); among candidates the first one wins.

    Rows without a key are never deduplicated.
    """
    key = ["tenant_id", "user_id", "dedupe_key"]
    keyed = candidates.filter(F.col("dedupe_key").isNotNull())
    rest = [c for c in candidates.columns if c not in key]
    first = keyed.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("created_at", "id")).alias("r")).select(*key, "r.*")
    fresh = first.join(stored.select(*key).distinct(), key, "left_anti").select(*candidates.columns)
    return fresh.unionByName(candidates.filter(F.col("dedupe_key").isNull()))


def inbox(notifications: DataFrame, user, *, unread_only: bool = False) -> DataFrame:
    """One user's notifications; page them by (updated_at, id) with ``paging.page``."""
    mine = notifications.filter(F.col("user_id") == user)
    return mine.filter(F.col("read_at").isNull()) if unread_only else mine


def unread_counts(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("tenant_id", "user_id").agg(F.count_if(F.col("read_at").isNull()).alias("unread"))


def mark_read(notifications: DataFrame, reads: DataFrame) -> DataFrame:
    """Set ``read_at`` to the first read after the last change; a later click never moves it.

    ``reads``: id, user_id, read_ts. Marks on someone else's notification do nothing.
    """
    after = reads.join(notifications.select("id", "user_id", "updated_at"), ["id", "user_id"]).filter(F.col("read_ts") >= F.col("updated_at"))
    earliest = after.groupBy("id").agg(F.min("read_ts").alias("_first"))
    joined = notifications.join(earliest, "id", "left")
    return joined.withColumn("read_at", F.coalesce("read_at", "_first")).select(*notifications.columns)
