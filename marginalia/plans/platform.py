"""Registered quota, notification, audit, security, identity and retention queries and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.entries import retention_months
from marginalia.functions.masking import mask_record
from marginalia.functions.text import mask
from marginalia.operators import audit as U
from marginalia.operators import identity as I
from marginalia.operators import notify as N
from marginalia.operators import partitions as P
from marginalia.operators import quota as Q
from marginalia.operators import security as S
from marginalia.operators.paging import page
from marginalia.plans import fixtures as fx
from marginalia.plans.fixtures import NOW, PLAN, minutes, ntz
from marginalia.plans.text import tokens_sql
from marginalia.session import exists, prepare, scratch_path
from marginalia.sources import tables as T
from marginalia.sources.objects import foreign_keys

NOON = "2024-01-30 12:00:00"
RETENTION = "line_A:13;line_N:84;bad;neg:-2;zero:0;line_A: 30"
LINE_NOW = "2001-03-10 08:00:00"

EXTRA = {
    "qx_limit": """
select tenant_id, r.resource, case when r.resource = 'documents' and settings like '%"documents":30%' then 30
  when r.resource = 'documents' and settings like '%"documents":null%' then null
  when r.resource = 'messages_day' and settings like '%"messages_day":50%' then 50 else r.plan_limit end as limit_value
from fx_tenant, (values ('tokens_month', 1000000::bigint), ('messages_day', 200), ('documents', 100), ('storage_bytes', 1073741824), ('streams', 2)) as r(resource, plan_limit)""",
    "qx_stock": """
select tenant_id, count(*) as documents, sum(size_bytes)::bigint as storage_bytes from fx_document
where deleted_at is null and kb_id in (select kb_id from fx_kb where deleted_at is null) group by 1""",
    "qx_fact": """
select tenant_id, 'tokens_month' as resource, sum(prompt_tokens + completion_tokens)::bigint as used from fx_usage where category = 'llm' and created_at >= timestamp '2024-01-01' group by 1
union all select tenant_id, 'messages_day', count(*) from fx_message where role = 'assistant' and created_at >= timestamp '2024-01-30' group by 1
union all select tenant_id, 'documents', documents from qx_stock union all select tenant_id, 'storage_bytes', storage_bytes from qx_stock""",
    "qx_move": """
select tenant_id, message_id, created_at as moved, 1 as step from fx_message
union all select tenant_id, message_id, created_at + to_minutes(cast(length(content) as int)), -1 from fx_message""",
    "qx_event": """
select tenant_id, 'tokens_month' as resource, strftime(created_at, '%Y-%m') as period, id as turn, row_number() over (partition by tenant_id order by created_at, id, k) as seq, kind,
  prompt_tokens as amount, case when kind = 'commit' then prompt_tokens * (id % 3) // 2 end as actual
from fx_usage, (values (0, 'reserve'), (1, 'settle')) as s(k, step),
  lateral (select case when k = 0 then 'reserve' when model = 'error' then 'release' else 'commit' end as kind)""",
    "nx_ready": """
select tenant_id, coalesce(uploaded_by, 7) as user_id, kb_id, doc_id, filename, updated_at as ts from fx_document""",
    "nx_collapsed": """
select tenant_id, user_id, kb_id, epoch(ts)::bigint // 600 as slot, count(*) as n, max(ts) as updated_at, arg_max(filename, (ts, doc_id)) as last_file,
  list(doc_id order by ts, doc_id) as ids from nx_ready group by all""",
    "nx_notice": """
select doc_id as id, tenant_id, uploaded_by as user_id, case when doc_id % 4 = 0 then 'document_failed' when doc_id % 4 = 1 then 'document_ready' when doc_id % 4 = 2 then 'quota_threshold' else 'other' end as type,
  case when doc_id % 5 <> 0 then kb_id end as dedupe_key, created_at, updated_at, case when doc_id % 6 = 0 then updated_at end as read_at
from fx_document where uploaded_by is not null""",
    "ax_audit": """
select id, tenant_id, created_at, actor_id, case operation_id when 'users_create' then 'user.create' when 'users_update' then 'user.update' when 'documents_upload' then 'document.upload'
    when 'documents_delete' then 'document.delete' when 'tenants_update_current' then 'tenant.update' else 'unregistered.' || operation_id end as action,
  case operation_id when 'users_create' then 'user' when 'users_update' then 'user' when 'documents_upload' then 'document' when 'documents_delete' then 'document' when 'tenants_update_current' then 'tenant' else 'unknown' end as resource_type,
  case when outcome_status = 403 then 'denied' when outcome_status < 400 then 'succeeded' else 'failed' end as outcome, outcome_status as status
from fx_request where method <> 'GET' and operation_id <> 'rag_query'""",
    "ax_log": "select id, created_at as ts, path, outcome_status as status, duration_ms from fx_request where id % 11 not in (3, 5, 7, 8)",
    "lx_month": """
select distinct 'line_' || l_returnflag as table_name, date_trunc('month', l_shipdate)::date as start from lineitem""",
}


def limits(spark, d):
    return Q.limits(fx.tenant(spark, d), PLAN)


def qta_01_limits(spark, d):
    return limits(spark, d)


def qta_02_periods(spark, d):
    rows = fx.usage(spark, d).select("id", "created_at", F.explode(F.array(*[F.lit(r) for r in Q.RESOURCES])).alias("resource"))
    now = F.col("created_at")
    return rows.select("id", "resource", Q.period_label(F.col("resource"), now).alias("label"), Q.resets_at(F.col("resource"), now).alias("resets_at"))


def qta_03_stock(spark, d):
    return Q.stock(fx.document(spark, d), fx.kb(spark, d))


def facts(spark, d):
    return Q.facts(fx.usage(spark, d), fx.message(spark, d), fx.document(spark, d), fx.kb(spark, d), ntz(NOON))


def qta_04_status(spark, d):
    streams = fx.message(spark, d).filter(F.col("status") == "streaming").groupBy("tenant_id").agg(F.count("*").alias("used"))
    used = facts(spark, d).unionByName(streams.withColumn("resource", F.lit("streams")).select("tenant_id", "resource", "used"))
    return Q.status(limits(spark, d), used, ntz(NOON))


def quota_events(spark, d):
    """Every usage row reserves its prompt tokens, then commits a share of them or releases (errors)."""
    usage = fx.usage(spark, d)
    steps = F.explode(F.array(F.lit("reserve"), F.when(F.col("model") == "error", "release").otherwise("commit"))).alias("kind")
    rows = usage.select("tenant_id", "id", "created_at", "prompt_tokens", steps)
    k = (F.col("kind") != "reserve").cast("int")
    return rows.select(
        "tenant_id", F.lit("tokens_month").alias("resource"), Q.period_label(F.lit("tokens_month"), F.col("created_at")).alias("period"),
        F.col("id").alias("turn"), F.struct("created_at", "id", k.alias("k")).alias("seq"), "kind", F.col("prompt_tokens").cast("long").alias("amount"),
        F.when(F.col("kind") == "commit", F.floor(F.col("prompt_tokens") * (F.col("id") % 3) / 2)).alias("actual"))


def qta_05_reservations(spark, d):
    """Half of the tenants have a limit they will hit."""
    few = F.when(F.substring("tenant_id", 4, 9).cast("int") % 2 == 0, 20000).otherwise(10**9).cast("long")
    held = fx.usage(spark, d).select("tenant_id").distinct().select("tenant_id", F.lit("tokens_month").alias("resource"), few.alias("limit"))
    return Q.replay_reservations(quota_events(spark, d), held)


def qta_06_reserve_estimate(spark, d):
    return fx.message(spark, d).select("message_id", Q.reserve_estimate(F.col("content")).alias("reserve"))


def qta_07_reconcile(spark, d):
    drifted = facts(spark, d).withColumn("used", F.col("used") - F.length("tenant_id"))
    return Q.reconcile(facts(spark, d), drifted, limits(spark, d), ntz(NOON))


def qta_08_threshold_alerts(spark, d):
    usage = fx.usage(spark, d).filter(F.col("category") == "llm")
    held = usage.select("tenant_id").distinct().select("tenant_id", F.lit("tokens_month").alias("resource"), F.lit(30000).cast("long").alias("limit"))
    return Q.threshold_alerts(usage, held, "tokens_month", F.col("prompt_tokens").cast("long") + F.col("completion_tokens"))


def qta_09_concurrency(spark, d):
    spans = fx.message(spark, d).select("tenant_id", F.col("message_id").alias("id"), F.col("created_at").alias("started_at"), (F.col("created_at") + minutes(F.length("content"))).alias("ended_at"))
    return Q.concurrency(spans, 2)


def ready_events(spark, d):
    return fx.document(spark, d).select("tenant_id", F.coalesce("uploaded_by", F.lit(7)).alias("user_id"), "kb_id", "doc_id", "filename", F.col("updated_at").alias("ts"))


def ntf_01_collapse_ready(spark, d):
    """Collapsed over whole days so that buckets hold many documents."""
    wide = ready_events(spark, d).withColumn("user_id", F.lit(7).cast("long"))
    out = N.collapse_ready(wide, 24 * 60)
    return out.withColumn("document_ids", F.array_join(F.transform("document_ids", lambda x: x.cast("string")), ","))


def ntf_01_collapse_ten_minutes(spark, d):
    return N.collapse_ready(ready_events(spark, d)).select("tenant_id", "user_id", "kb_id", "slot", "count", "updated_at", "title")


def users(spark, d):
    return T.table(prepare(spark), d, "events").select("user_id").distinct().select("user_id", F.when(F.col("user_id") % 9 == 4, "disabled").otherwise("active").alias("status"))


def ntf_02_recipients(spark, d):
    return N.recipients(fx.document(spark, d), fx.user_role(spark, d), users(spark, d))


def notices(spark, d):
    i = F.col("doc_id")
    kind = F.when(i % 4 == 0, "document_failed").when(i % 4 == 1, "document_ready").when(i % 4 == 2, "quota_threshold").otherwise("other")
    return fx.document(spark, d).filter(F.col("uploaded_by").isNotNull()).select(
        i.alias("id"), "tenant_id", F.col("uploaded_by").alias("user_id"), kind.alias("type"), F.when(i % 5 != 0, F.col("kb_id")).alias("dedupe_key"),
        "created_at", "updated_at", F.when(i % 6 == 0, F.col("updated_at")).alias("read_at"))


def ntf_03_deliveries(spark, d):
    return N.deliveries(notices(spark, d)).select("id", "channel")


def ntf_04_new_notifications(spark, d):
    rows = notices(spark, d)
    mark = ntz("2024-01-10 00:00:00")
    stored = rows.filter((F.col("created_at") < mark) & F.col("dedupe_key").isNotNull())
    return N.new_notifications(rows.filter(F.col("created_at") >= mark), stored).select("id", "tenant_id", "user_id", "dedupe_key")


def ntf_05_inbox_page(spark, d):
    mine = N.inbox(notices(spark, d).withColumn("user_id", F.lit(1)), 1, unread_only=True)
    return page(mine, "updated_at", "id", limit=30).select("id", "updated_at", "position", "next_id")


def ntf_05_unread_counts(spark, d):
    return N.unread_counts(notices(spark, d))


def ntf_06_mark_read(spark, d):
    """Two clicks per notice: one before its last change, one after; some by the wrong user."""
    rows = notices(spark, d)
    clicks = F.explode(F.array(F.lit(-30), F.lit(20), F.lit(45))).alias("after")
    reads = rows.select("id", "user_id", "updated_at", clicks).filter(F.col("id") % 7 != 1).select(
        "id", (F.col("user_id") + F.when(F.col("id") % 10 == 2, 1).otherwise(0)).alias("user_id"), (F.col("updated_at") + minutes(F.col("after"))).alias("read_ts"))
    return N.mark_read(rows, reads).select("id", "read_at")


def audit(spark, d):
    return U.audit_rows(fx.request(spark, d))


def aud_01_audit_rows(spark, d):
    return audit(spark, d)


def aud_02_outcomes(spark, d):
    return fx.request(spark, d).select("id", U.outcome(F.col("outcome_status")).alias("outcome"))


def aud_03_audit_page(spark, d):
    found = U.audit_query(audit(spark, d), action="user.update", start="2024-01-05", end="2024-01-20")
    return page(found, "created_at", "id", limit=50).select("id", "created_at", "position", "next_id")


def aud_04_append_only_violations(spark, d):
    rows = audit(spark, d)
    again = rows.withColumn("outcome", F.when(F.col("status") == 500, "succeeded").otherwise(F.col("outcome")))
    return U.append_only_violations(rows.unionByName(again), ["tenant_id", "action", "outcome", "status"])


def sec_01_lockouts(spark, d):
    return S.lockouts(fx.login(spark, d))


def sec_02_token_reuse(spark, d):
    """A family per user and day; an error event presents the token before the current one."""
    e = T.table(prepare(spark), d, "events").withColumn("family", F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")))
    from pyspark.sql import Window as W
    n = F.row_number().over(W.partitionBy("family").orderBy("ts", "event_id"))
    rows = e.withColumn("issued", n).withColumn("presented", F.when(F.col("event_type") == "error", F.col("issued") - 3).otherwise(F.col("issued") - 1))
    return S.token_reuse(rows)


def sec_03_foreign_keys(spark, d):
    docs = fx.document(spark, d)
    owner = F.when(F.col("doc_id") % 13 == 0, F.concat("tenant_id", F.lit("0"))).otherwise(F.col("tenant_id"))
    keyed = docs.select("doc_id", "tenant_id", F.concat(F.lit("tenant-"), owner, F.lit("/kb/"), F.col("kb_id"), F.lit("/"), F.col("doc_id")).alias("storage_key"))
    return foreign_keys(keyed)


def msk_01_masked_text(spark, d):
    extra = F.concat("text", F.lit(" https://bob:s3c@h.example/x A123456789 0912-345-678 4111111111111111 Authorization: Bearer abc.def {\"access_token\": \"q\"}"))
    return T.table(prepare(spark), d, "documents").select("doc_id", mask(extra).alias("masked"))


def msk_02_masked_record(spark, d):
    docs = T.table(prepare(spark), d, "documents")
    record = F.struct(
        F.col("text").alias("author"), F.col("lang").alias("Client_Secret"), F.col("n_chars").alias("token_count"),
        F.struct(F.col("source").alias("cookie_jar"), F.array(F.concat("source", F.lit("@mail.example"))).alias("to")).alias("inner"),
        F.create_map(F.lit("api_key"), F.col("lang"), F.lit("note"), F.concat(F.lit("token="), F.col("lang"))).alias("extra"))
    rows = docs.select("doc_id", record.alias("r"))
    safe = rows.select("doc_id", mask_record(F.col("r"), rows.schema["r"].dataType).alias("r"))
    return safe.select("doc_id", F.col("r.Client_Secret").alias("secret"), F.col("r.token_count").alias("count"), F.col("r.inner.cookie_jar").alias("cookie"),
                       F.col("r.inner.to")[0].alias("to"), F.col("r.extra")["api_key"].alias("api_key"), F.col("r.extra")["note"].alias("note"), F.length("r.author").alias("author_length"))


def access_log(spark, d):
    """The request log written as text lines, with noise: other events, cut lines, plain text, no duration."""
    r = fx.request(spark, d)
    body = F.to_json(F.struct(
        F.when(F.col("id") % 11 == 3, "startup").otherwise(U.ACCESS_EVENT).alias("event"), "path", F.col("outcome_status").alias("status"),
        F.when(F.col("id") % 11 != 5, F.col("duration_ms")).alias("duration_ms"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts")))
    line = F.when(F.col("id") % 11 == 7, F.expr("left(body, 40)")).when(F.col("id") % 11 == 8, "INFO started").otherwise(F.col("body"))
    path = scratch_path(spark, "access-log")
    r.select(body.alias("body"), "id").select(line.alias("value")).write.text(path)
    return spark.read.text(path)


def src_03_access_log(spark, d):
    out = U.access_events(access_log(spark, d))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def log_01_latency_report(spark, d):
    return U.latency_report(U.access_events(access_log(spark, d))).withColumn("mean", F.round("mean", 6))


def log_02_last_seconds(spark, d):
    events = U.access_events(access_log(spark, d))
    return U.last_seconds(events, 86400).select(F.col("ts").cast("timestamp_ntz").alias("ts"), "path", "duration_ms")


def tn_01_tenant_view(spark, d):
    return T.tenant_view(fx.document(spark, d), "src5").select("doc_id", "tenant_id", "kb_id")


def tn_02_live_documents(spark, d):
    return T.live_view(fx.document(spark, d)).select("doc_id", "tenant_id")


def tn_03_shared_rows(spark, d):
    docs = fx.document(spark, d).withColumn("tenant_id", F.when(F.col("doc_id") % 10 != 0, F.col("tenant_id")))
    return T.shared_view(docs, "src5").select("doc_id", "tenant_id")


def _tenants(spark, d):
    broken = F.substring("tenant_id", 4, 9).cast("int") % 7 == 3
    rows = fx.tenant(spark, d).withColumn("settings", F.when(broken, "not json").otherwise(F.col("settings")))
    return I.split_rows(rows, F.when(F.try_parse_json("settings").isNull(), "settings are not JSON"))


def tn_04_isolated_results(spark, d):
    good, _ = _tenants(spark, d)
    return Q.status(Q.limits(good, PLAN), facts(spark, d), ntz(NOON)).select("tenant_id", "resource", "used", "remaining")


def tn_04_error_rows(spark, d):
    return _tenants(spark, d)[1].select("tenant_id", "problem")


def idn_01_effective_permissions(spark, d):
    roles = fx.user_role(spark, d)
    denied = roles.filter(F.col("user_id") % 4 == 0).select("tenant_id", "user_id", F.lit("knowledge:write").alias("permission"))
    return I.effective_permissions(roles, denied)


def idn_02_permission_drift(spark, d):
    """Each tenant's stored copy follows the roles its users hold, so unused roles are missing."""
    held = fx.user_role(spark, d).select(F.col("tenant_id").alias("scope"), "role").distinct()
    stored = held.select("scope", "role", F.explode(F.coalesce(I.permissions_of(F.col("role")), F.array(F.lit("haunt:read")))).alias("permission"))
    return I.permission_drift(stored)


def _months(spark, d):
    lines = T.table(prepare(spark), d, "lineitem")
    return lines.select(F.concat(F.lit("line_"), "l_returnflag").alias("table_name"), F.trunc("l_shipdate", "MM").alias("start")).distinct()


def rtn_01_missing_partitions(spark, d):
    have = _months(spark, d).filter(F.col("start") < F.lit("2001-05-01").cast("date"))
    existing = have.select("table_name", I.month_name(F.col("table_name"), F.col("start")).alias("partition"))
    return I.missing_partitions(existing, ntz(LINE_NOW))


def rtn_02_retention(spark, d):
    size = F.col("p_size").cast("string")
    line = F.concat(F.col("p_type"), F.lit(":"), size, F.lit("; ;x;:5;neg:-"), size, F.lit(";zero:0;"), F.col("p_name"), F.lit(": "), size, F.lit(" ;"), F.col("p_brand"), F.lit(":"), size, F.lit(".5;"), F.col("p_type"), F.lit(":7"))
    parsed = retention_months(T.table(prepare(spark), d, "part").select("p_partkey", line.alias("line")), ["p_partkey"], "line")
    return parsed.select("p_partkey", "table_name", "months", I.cutoff(F.col("months"), ntz(NOW)).alias("cutoff"))


def rtn_03_expired_partitions(spark, d):
    parts = _months(spark, d).select("table_name", I.month_name(F.col("table_name"), F.col("start")).alias("partition"), F.add_months("start", 1).alias("upper_bound"))
    policy = retention_months(spark.range(1).select(F.lit(RETENTION).alias("line")), [], "line")
    return I.expired_partitions(parts, policy, ntz(LINE_NOW))


def rtn_03_detached_rows(spark, d):
    """Line items written by table and month; what is left in the table and what was detached, by partition."""
    root, detached = scratch_path(prepare(spark), "lines"), scratch_path(spark, "detached")
    flag, month = F.concat(F.lit("line_"), "l_returnflag").alias("table_name"), F.trunc("l_shipdate", "MM").alias("start")
    lines = T.table(spark, d, "lineitem").select(flag, month, "l_orderkey", F.col("l_quantity").cast("double").alias("quantity"))
    named = lines.withColumn("partition", I.month_name(F.col("table_name"), F.col("start")))
    spread = F.pmod(F.xxhash64("l_orderkey"), F.lit(4))
    named.repartition("table_name", "partition", spread).write.partitionBy("table_name", "partition").parquet(root)
    P.apply_expired(spark, rtn_03_expired_partitions(spark, d), root, detached)
    schema = "quantity double, table_name string, partition string"
    # without anything detached there is no second folder
    both = [spark.read.schema(schema).parquet(path).withColumn("place", F.lit(place))
            for path, place in ((root, "table"), (detached, "detached")) if exists(spark, path)]
    rows = reduce(DataFrame.unionByName, both)
    return rows.groupBy("place", "table_name", "partition").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


QUERIES = {f.__name__: f for f in (
    qta_01_limits, qta_02_periods, qta_03_stock, qta_04_status, qta_05_reservations, qta_06_reserve_estimate, qta_07_reconcile,
    qta_08_threshold_alerts, qta_09_concurrency, ntf_01_collapse_ready, ntf_01_collapse_ten_minutes, ntf_02_recipients,
    ntf_03_deliveries, ntf_04_new_notifications, ntf_05_inbox_page, ntf_05_unread_counts, ntf_06_mark_read, aud_01_audit_rows,
    aud_02_outcomes, aud_03_audit_page, aud_04_append_only_violations, sec_01_lockouts, sec_02_token_reuse, sec_03_foreign_keys,
    msk_01_masked_text, msk_02_masked_record, src_03_access_log, log_01_latency_report, log_02_last_seconds, tn_01_tenant_view,
    tn_02_live_documents, tn_03_shared_rows, tn_04_isolated_results, tn_04_error_rows, idn_01_effective_permissions,
    idn_02_permission_drift, rtn_01_missing_partitions, rtn_02_retention, rtn_03_expired_partitions,
    rtn_03_detached_rows,
)}

_PERMISSIONS = ", ".join(f"('{r}', '{c}')" for r, codes in I.ROLE_PERMISSIONS.items() for c in codes)
_STATUS = """
select l.tenant_id, l.resource, limit_value, coalesce(used, 0) as used, greatest(limit_value - coalesce(used, 0), 0) as remaining
from qx_limit l left join qx_fact f on f.tenant_id = l.tenant_id and f.resource = l.resource"""


def _edge(text: str, pattern: str, shown: str) -> str:
    once = f"regexp_replace({text}, '(^|[^0-9A-Za-z]){pattern}([^0-9A-Za-z]|$)', '\\1{shown}\\2', 'g')"
    return f"regexp_replace({once}, '(^|[^0-9A-Za-z]){pattern}([^0-9A-Za-z]|$)', '\\1{shown}\\2', 'g')"


def mask_sql(col: str) -> str:
    url = rf"regexp_replace({col}, '(?i)(^|[^\p{{L}}\p{{N}}_])([a-z][a-z0-9+.\-]*://)([^\s/:@]*):([^\s/@]*)@', '\1\2\3:***@', 'g')"
    keys = "password|passwd|secret|token|api_key|apikey|authorization|cookie|credential|private_key"
    pair = rf"""regexp_replace({url}, '(?i)((?:{keys})[A-Za-z0-9_.\-]*)(["'']?\s*[=:]\s*)(["'']?)(?:bearer|basic|token)?\s*[^&\s"'',}}）]+', '\1\2\3***', 'g')"""
    mail = rf"regexp_replace({pair}, '[\p{{L}}\p{{N}}\p{{M}}_.+-]+@[\p{{L}}\p{{N}}\p{{M}}_-]+\.[\p{{L}}\p{{N}}\p{{M}}_.-]+', '<email>', 'g')"
    return _edge(_edge(_edge(mail, r"[A-Z][12]\d{8}", "<id>"), r"09\d{2}-?\d{3}-?\d{3}", "<phone>"), r"\d{13,19}", "<redacted>")


ORACLES = {
    "qta_01_limits": 'select tenant_id, resource, limit_value as "limit" from qx_limit',
    "qta_02_periods": """
select id, resource, case resource when 'tokens_month' then strftime(created_at, '%Y-%m') else strftime(created_at, '%Y-%m-%d') end as label,
  case resource when 'tokens_month' then date_trunc('month', created_at)::timestamp + interval 1 month when 'messages_day' then date_trunc('day', created_at)::timestamp + interval 1 day end as resets_at
from fx_usage, (values ('tokens_month'), ('messages_day'), ('documents'), ('storage_bytes'), ('streams')) as r(resource)""",
    "qta_03_stock": "select * from qx_stock",
    "qta_04_status": """
select l.tenant_id, l.resource, limit_value as "limit", coalesce(used, 0) as used, greatest(limit_value - coalesce(used, 0), 0) as remaining,
  case l.resource when 'tokens_month' then timestamp '2024-02-01' when 'messages_day' then timestamp '2024-01-31' end as resets_at
from qx_limit l left join (select * from qx_fact union all select tenant_id, 'streams', count(*) from fx_message where status = 'streaming' group by 1) f
  on f.tenant_id = l.tenant_id and f.resource = l.resource""".replace("greatest(limit_value - coalesce(used, 0), 0)", "case when limit_value is not null then greatest(limit_value - coalesce(used, 0), 0) end"),
    "qta_05_reservations": """
with recursive e as (select *, case when cast(substr(tenant_id, 4) as int) % 2 = 0 then 20000 else 1000000000 end as cap from qx_event),
f as (select tenant_id, 0::bigint as seq, 0::bigint as used, 0::bigint as granted, 0::bigint as denied, false as opened, '' as period from e group by 1
  union all
  select e.tenant_id, e.seq,
    case e.kind when 'reserve' then case when f.used + e.amount > e.cap then f.used else f.used + e.amount end
      else case when f.opened then greatest(f.used - e.amount + case e.kind when 'commit' then e.actual else 0 end, 0) else f.used end end::bigint,
    f.granted + (e.kind = 'reserve' and f.used + e.amount <= e.cap)::bigint, f.denied + (e.kind = 'reserve' and f.used + e.amount > e.cap)::bigint,
    e.kind = 'reserve' and f.used + e.amount <= e.cap, e.period
  from f join e on e.tenant_id = f.tenant_id and e.seq = f.seq + 1)
select tenant_id, 'tokens_month' as resource, period, used, granted, denied from f qualify row_number() over (partition by tenant_id order by seq desc) = 1""",
    "qta_06_reserve_estimate": f"select message_id, {tokens_sql('content')} + 2000 as reserve from fx_message",
    "qta_07_reconcile": """
select l.tenant_id, l.resource, case l.resource when 'tokens_month' then 'month' else 'day' end as period,
  case l.resource when 'tokens_month' then date '2024-01-01' else date '2024-01-30' end as period_start, coalesce(used, 0) as used, limit_value as "limit",
  case when used is not null then -length(l.tenant_id) end as drift
from qx_limit l left join qx_fact f on f.tenant_id = l.tenant_id and f.resource = l.resource where l.resource <> 'streams'""",
    "qta_08_threshold_alerts": """
select tenant_id, 'tokens_month' as resource, strftime(created_at, '%Y-%m') as period, threshold, created_at as crossed_at, least(used, 30000)::bigint as used, 30000 as "limit" from (
  select *, sum(prompt_tokens + completion_tokens) over (partition by tenant_id, date_trunc('month', created_at) order by created_at, id) as used from fx_usage where category = 'llm'),
  (values (80), (100)) as t(threshold) where used * 100 >= threshold * 30000
qualify row_number() over (partition by tenant_id, date_trunc('month', created_at), threshold order by created_at, id) = 1""",
    "qta_09_concurrency": """
select tenant_id, max(open)::int as peak, max(open) > 2 as over_cap from (
  select tenant_id, sum(step) over (partition by tenant_id order by moved, step, message_id rows between unbounded preceding and current row) as open from qx_move) group by 1""",
    "ntf_01_collapse_ready": """
select tenant_id, user_id, kb_id, slot, n as count, updated_at, array_to_string(case when n > 9 then list_append(ids[1:9], ids[-1]) else ids end, ',') as document_ids,
  case when n > 1 then n || ' 份文件已完成' else last_file || ' 已完成' end as title, case when n > 1 then last_file || ' 等 ' || n || ' 份文件可以開始問答了。' else '可以開始問答了。' end as body,
  'document_ready:' || kb_id || ':' || slot as dedupe_key
from (select tenant_id, 7 as user_id, kb_id, epoch(ts)::bigint // 86400 as slot, count(*) as n, max(ts) as updated_at, arg_max(filename, (ts, doc_id)) as last_file,
  list(doc_id order by ts, doc_id) as ids from nx_ready group by all)""",
    "ntf_01_collapse_ten_minutes": """
select tenant_id, user_id, kb_id, slot, n as count, updated_at, case when n > 1 then n || ' 份文件已完成' else last_file || ' 已完成' end as title from nx_collapsed""",
    "ntf_02_recipients": """
select doc_id, uploaded_by as recipient from fx_document where uploaded_by is not null
union all select distinct doc_id, r.user_id from fx_document d join fx_user_role r on r.tenant_id = d.tenant_id
where uploaded_by is null and r.role in ('owner', 'admin') and r.user_id % 9 <> 4""",
    "ntf_03_deliveries": """
select id, 'in_app' as channel from nx_notice union all select id, 'email' from nx_notice where type in ('document_failed', 'quota_threshold')""",
    "ntf_04_new_notifications": """
select id, tenant_id, user_id, dedupe_key from nx_notice n where created_at >= timestamp '2024-01-10' and (dedupe_key is null or not exists (
  select 1 from nx_notice s where s.created_at < timestamp '2024-01-10' and s.tenant_id = n.tenant_id and s.user_id = n.user_id and s.dedupe_key = n.dedupe_key))
qualify dedupe_key is null or row_number() over (partition by tenant_id, user_id, dedupe_key order by created_at, id) = 1""",
    "ntf_05_inbox_page": """
select id, updated_at, r::int as position, case when r = 30 and n > 30 then id end as next_id from (
  select *, row_number() over (order by updated_at desc, id desc) as r, count(*) over () as n from nx_notice where read_at is null) where r <= 30""",
    "ntf_05_unread_counts": "select tenant_id, user_id, count(*) filter (read_at is null) as unread from nx_notice group by 1, 2",
    "ntf_06_mark_read": """
select id, coalesce(read_at, case when id % 7 <> 1 and id % 10 <> 2 then updated_at + interval 20 minutes end) as read_at from nx_notice""",
    "aud_01_audit_rows": "select * from ax_audit",
    "aud_02_outcomes": "select id, case when outcome_status = 403 then 'denied' when outcome_status < 400 then 'succeeded' else 'failed' end as outcome from fx_request",
    "aud_03_audit_page": """
select id, created_at, r::int as position, case when r = 50 and n > 50 then id end as next_id from (
  select *, row_number() over (order by created_at desc, id desc) as r, count(*) over () as n from ax_audit
  where action = 'user.update' and created_at >= timestamp '2024-01-05' and created_at < timestamp '2024-01-21') where r <= 50""",
    "aud_04_append_only_violations": "select id from ax_audit where status = 500",
    "sec_01_lockouts": """
with recursive e as (select *, row_number() over (partition by tenant_id, email order by ts, event_id) as n from fx_login),
f as (select tenant_id, email, 0::bigint as n, 0 as c, null::timestamp as until_ts, null::timestamp as ts, false as locked, false as refused from e group by 1, 2
  union all
  select e.tenant_id, e.email, e.n,
    case when x.c >= 5 then x.c when e.ok then 0 else x.c + 1 end, case when x.c >= 5 then f.until_ts when e.ok then null else e.ts + interval 900 seconds end,
    e.ts, x.c = 4 and not e.ok, x.c >= 5
  from f join e on e.tenant_id = f.tenant_id and e.email = f.email and e.n = f.n + 1,
    lateral (select case when f.until_ts is not null and e.ts >= f.until_ts then 0 else f.c end as c) x),
k as (select * from f where locked)
select k.tenant_id, k.email, k.ts as locked_at, k.until_ts as unlock_at, 5 as failures,
  (select count(*) from f r where r.refused and r.tenant_id = k.tenant_id and r.email = k.email and r.ts > k.ts and r.ts < k.until_ts) as refused from k""",
    "sec_02_token_reuse": """
with recursive e as (select user_id || '/' || ts::date as family, event_id, ts, row_number() over (partition by user_id, ts::date order by ts, event_id) as n, event_type = 'error' as old from events),
t as (select *, n as issued, case when old then n - 3 else n - 1 end as presented from e),
f as (select family, 0::bigint as n, null::bigint as current, null::bigint as rotated, null::timestamp as rotated_at, 0::bigint as rotations, null::timestamp as revoked_at from t group by 1
  union all
  select t.family, t.n, case when live and fits then t.issued else f.current end, case when live and fits then t.presented else f.rotated end,
    case when live and fits then t.ts else f.rotated_at end, f.rotations + (live and fits)::bigint,
    case when f.revoked_at is not null then f.revoked_at when fits or (t.presented = f.rotated and t.ts <= f.rotated_at + interval 10 seconds) then null else t.ts end
  from f join t on t.family = f.family and t.n = f.n + 1, lateral (select f.revoked_at is null as live, f.current is null or t.presented = f.current as fits) x)
select family, revoked_at, 'reuse' as reason, rotations from f where revoked_at is not null qualify row_number() over (partition by family order by n desc) = 1""",
    "sec_03_foreign_keys": """
select doc_id, tenant_id, 'tenant-' || tenant_id || '0/kb/' || kb_id || '/' || doc_id as storage_key from fx_document where doc_id % 13 = 0""",
    "msk_01_masked_text": f"""
select doc_id, {mask_sql('t')} as masked from (select doc_id, text || ' https://bob:s3c@h.example/x A123456789 0912-345-678 4111111111111111 Authorization: Bearer abc.def {{"access_token": "q"}}' as t from documents)""",
    "msk_02_masked_record": f"""
select doc_id, '***' as secret, n_chars as count, '***' as cookie, '<email>' as "to", '***' as api_key, 'token=***' as note, length({mask_sql('text')})::int as author_length from documents""",
    "src_03_access_log": "select ts, path, status, duration_ms from ax_log",
    "log_01_latency_report": """
with r as (select path, duration_ms, row_number() over (partition by path order by duration_ms) as i, count(*) over (partition by path) as n from ax_log)
select path, max(n) as n, max(duration_ms) filter (i = greatest(1, least(n, round_even(0.50::double * n + 0.5, 0)))) as p50,
  max(duration_ms) filter (i = greatest(1, least(n, round_even(0.95::double * n + 0.5, 0)))) as p95,
  max(duration_ms) filter (i = greatest(1, least(n, round_even(0.99::double * n + 0.5, 0)))) as p99,
  max(duration_ms) as max, round(avg(duration_ms), 6) as mean, p95 < 300 as within_slo from r group by path""",
    "log_02_last_seconds": "select ts, path, duration_ms from ax_log where ts >= (select max(ts) - interval 86400 seconds from ax_log)",
    "tn_01_tenant_view": "select doc_id, tenant_id, kb_id from fx_document where tenant_id = 'src5'",
    "tn_02_live_documents": "select doc_id, tenant_id from fx_document where deleted_at is null",
    "tn_03_shared_rows": """
select doc_id, case when doc_id % 10 <> 0 then tenant_id end as tenant_id from fx_document where doc_id % 10 = 0 or tenant_id = 'src5'""",
    "tn_04_isolated_results": f"""
select tenant_id, resource, used, case when limit_value is not null then remaining end as remaining from ({_STATUS}) where cast(substr(tenant_id, 4) as int) % 7 <> 3""",
    "tn_04_error_rows": "select tenant_id, 'settings are not JSON' as problem from fx_tenant where cast(substr(tenant_id, 4) as int) % 7 = 3",
    "idn_01_effective_permissions": f"""
select distinct tenant_id, user_id, p.permission from fx_user_role r join (values {_PERMISSIONS}) as p(role, permission) using (role)
where not (user_id % 4 = 0 and p.permission = 'knowledge:write')""",
    "idn_02_permission_drift": f"""
with p as (select * from (values {_PERMISSIONS}) as p(role, permission)), h as (select distinct tenant_id as scope, role from fx_user_role)
select scope, role, permission, 'missing' as drift from (select distinct scope from h), p where (scope, role) not in (select (scope, role) from h)
union all select scope, role, 'haunt:read', 'extra' from h where role = 'ghost'""",
    "rtn_01_missing_partitions": """
with have as (select * from lx_month where start < date '2001-05-01'),
w as (select table_name, unnest([date '2001-03-01', date '2001-04-01', date '2001-05-01', date '2001-06-01']) as start from (select distinct table_name from have))
select table_name, table_name || '_' || strftime(start, '%Y_%m') as partition, start, (start + interval 1 month)::date as "end" from w where (table_name, start) not in (select (table_name, start) from have)""",
    "rtn_02_retention": """
with e as (select p_partkey, unnest([p_type, p_name, p_type]) as table_name, unnest([p_size, p_size, 7]) as months, unnest([1, 2, 3]) as pos from part)
select p_partkey, table_name, months::int as months, (date '2024-01-01' - to_months(months::int))::date as cutoff from e
where months > 0 qualify row_number() over (partition by p_partkey, table_name order by pos desc) = 1""",
    "rtn_03_expired_partitions": """
select table_name, table_name || '_' || strftime(start, '%Y_%m') as partition, (start + interval 1 month)::date as upper_bound, cutoff, 'detach' as action
from lx_month join (values ('line_A', date '1998-09-01'), ('line_N', date '1994-03-01')) as c(table_name, cutoff) using (table_name) where start + interval 1 month <= cutoff""",
    "rtn_03_detached_rows": """
with l as (select 'line_' || l_returnflag as table_name, date_trunc('month', l_shipdate)::date as start, l_quantity::double as quantity from lineitem)
select case when start + interval 1 month <= cutoff then 'detached' else 'table' end as place, table_name, table_name || '_' || strftime(start, '%Y_%m') as partition,
  count(*) as n, sum(quantity) as quantity
from l left join (values ('line_A', date '1998-09-01'), ('line_N', date '1994-03-01')) as c(table_name, cutoff) using (table_name) group by 1, 2, 3""",
}
