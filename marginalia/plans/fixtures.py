"""The platform's tables derived from the shared test tables, once for Spark and once as SQL.

``VIEWS`` holds the SQL form; ``with_views`` prepends the ones a statement names. The Spark form of
``fx_name`` is the function ``name`` below. Both read whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.vectors import hash_embedding
from marginalia.session import prepare
from marginalia.sources.tables import table

NOW = "2024-01-31 00:00:00"
DIMS = 64
PRICES = "click:0.15/0.60; view:0.02/0;bad;neg:-1/1;purchase:1.5/2.5;"
PLAN = "tokens_month:1000000;messages_day:200;documents:100;storage_bytes:1073741824;streams:2"


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def minutes(n):
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int") if hasattr(n, "cast") else F.lit(n))


def tenant(spark: SparkSession, d: str) -> DataFrame:
    kind = F.substring("tenant_id", 4, 9).cast("int") % 4
    settings = (
        F.when(kind == 0, '{"quota":{"documents":30}}')
        .when(kind == 1, '{"quota":{"documents":null}}')
        .when(kind == 2, '{"quota":{"documents":true,"messages_day":50}}')
        .otherwise("{}")
    )
    ids = table(prepare(spark), d, "documents").select(F.col("source").alias("tenant_id")).distinct()
    return ids.select("tenant_id", F.lit("free").alias("plan"), settings.alias("settings"))


def kb(spark: SparkSession, d: str) -> DataFrame:
    config = (
        F.when(F.col("lang") == "en", '{"chunk":{"target_tokens":256,"overlap_tokens":32},"retrieval":{"top_k":10}}')
        .when(F.col("lang") == "fr", '{"chunk":{"target_tokens":9,"overlap_tokens":900},"retrieval":{"top_k":999}}')
        .when(F.col("lang") == "de", '{"chunk":{"target_tokens":true},"retrieval":{"top_k":"five","min_score_ratio":1}}')
        .otherwise("{}")
    )
    gone = F.when((F.col("lang") == "es") & F.col("source").isin("src3", "src4"), ntz("2024-01-20 00:00:00"))
    pairs = table(prepare(spark), d, "documents").select("source", "lang").distinct()
    return pairs.select(
        F.col("source").alias("tenant_id"), F.concat_ws("-", "source", "lang").alias("kb_id"),
        config.alias("config"), gone.alias("deleted_at"),
    )


STATUSES = ("uploaded", "parsing", "cleaned", "chunked", "embedding", "failed", "ready", "ready")


def document(spark: SparkSession, d: str, read=table) -> DataFrame:
    i = F.col("doc_id")
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (i % 8).cast("int") + 1)
    return read(prepare(spark), d, "documents").select(
        "doc_id", F.col("source").alias("tenant_id"), F.concat_ws("-", "source", "lang").alias("kb_id"),
        F.concat(F.lit("doc-"), i).alias("filename"), "text", "lang",
        F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size_bytes"),
        F.when(i % 3 != 0, i % 150).alias("uploaded_by"), status.alias("status"),
        (1 + i % 2).cast("int").alias("doc_version"),
        (ntz("2024-01-01 00:00:00") + minutes(i * 37 % 43200)).alias("created_at"),
        (ntz("2024-01-30 22:00:00") + minutes(i % 120)).alias("updated_at"),
        F.when(i % 17 == 0, ntz("2024-01-25 00:00:00")).alias("deleted_at"),
    )


def block(spark: SparkSession, d: str) -> DataFrame:
    lines = table(prepare(spark), d, "documents").select(
        "doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("block_order", "text")
    )
    order = F.col("block_order").cast("long")
    kind = (
        F.when((order % 10 == 0) & (F.length("text") <= 60), "heading")
        .when(order % 13 == 12, "table").otherwise("paragraph")
    )
    body = lines.select(
        "doc_id", order.alias("block_order"),
        F.when(F.col("doc_id") % 2 == 0, 1 + F.floor(order / 5)).alias("page"),
        kind.alias("type"), "text",
    )
    headers = body.filter((F.col("doc_id") % 50 == 0) & F.col("page").isNotNull()).select(
        "doc_id", (-F.col("page")).alias("block_order"), "page",  # before the text, so never a line of it
        F.lit("paragraph").alias("type"), F.lit("Internal  use only").alias("text"),
    ).distinct()
    return body.unionByName(headers)


def chunk(spark: SparkSession, d: str) -> DataFrame:
    docs = document(spark, d).select("doc_id", "tenant_id", "kb_id", F.col("doc_version").alias("_current"))
    blocks = block(spark, d).filter(F.col("block_order") >= 0)
    versions = F.explode(F.sequence(F.lit(1), F.col("_current"))).alias("doc_version")
    return docs.select("*", versions).join(blocks, "doc_id").select(
        F.concat_ws(":", "doc_id", "doc_version", "block_order").alias("chunk_id"),
        "tenant_id", "kb_id", "doc_id", "doc_version", F.col("block_order").cast("int").alias("seq"),
        F.col("text").alias("content"), (F.col("doc_version") < F.col("_current")).alias("superseded"),
    )


def embedding(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    owner = F.concat(F.lit("t"), v % 2)
    return table(prepare(spark), d, "embeddings").select(
        v.alias("chunk_id"), owner.alias("tenant_id"),
        F.concat(owner, F.lit("-"), F.col("label") % 5).alias("kb_id"), F.floor(v / 4).alias("doc_id"),
        F.col("embedding").alias("vector"), F.when(v % 11 == 0, "m-old").otherwise("m").alias("model"),
        F.lit(1).alias("embedding_version"), (v % 7 == 0).alias("superseded"),
        (40 + v * 13 % 900).cast("int").alias("tokens"),
    )


def message(spark: SparkSession, d: str, read=table) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    unfinished = (F.col("role") == "assistant") & (c % 9 == 0)
    return read(prepare(spark), d, "conversations").select(
        (c * 1000 + t).alias("message_id"), F.concat(F.lit("src"), c % 20).alias("tenant_id"),
        c.alias("conversation_id"), "role", F.col("text").alias("content"),
        F.when(unfinished, "streaming").otherwise("completed").alias("status"),
        (ntz("2024-01-01 00:00:00") + minutes(c * 431 % 43200 + t)).alias("created_at"),
    )


def query(spark: SparkSession, d: str) -> DataFrame:
    """Every user turn is a question; its vector comes from the hash embedding."""
    asked = message(spark, d).filter(F.col("role") == "user")
    return asked.select(
        F.col("message_id").alias("query_id"), F.concat(F.lit("t"), F.col("conversation_id") % 2).alias("tenant_id"),
        F.col("content").alias("question"), hash_embedding(F.col("content"), DIMS).alias("vector"),
    )


def conversation(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("conversation_id")
    return message(spark, d).groupBy("conversation_id", "tenant_id").agg(
        F.min("content").alias("title"), F.min("created_at").alias("created_at"), F.max("created_at").alias("_last")
    ).select(
        "conversation_id", "tenant_id", (c % 7).alias("user_id"), "title", (c % 10 == 0).alias("pinned"),
        "created_at", F.when(c % 6 != 0, F.col("_last")).alias("last_message_at"),
    )


def answer(spark: SparkSession, d: str) -> DataFrame:
    tail = (
        F.when(F.col("message_id") % 5 == 0, " [c:1] x [c:1]").when(F.col("message_id") % 5 == 1, " [c:2][c:99]")
        .when(F.col("message_id") % 5 == 2, " [c:abc] [c:1]").when(F.col("message_id") % 5 == 3, " [c:]").otherwise("")
    )
    return message(spark, d).filter(F.col("role") == "assistant").select(
        "message_id", "tenant_id", "conversation_id", "created_at", F.concat("content", tail).alias("content")
    )


def usage(spark: SparkSession, d: str, read=table) -> DataFrame:
    e = read(prepare(spark), d, "events")
    view = F.col("event_type") == "view"
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("src"), F.col("user_id") % 20).alias("tenant_id"),
        F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("user_id"),
        F.when(view, "embedding").otherwise("llm").alias("category"), F.col("event_type").alias("model"),
        F.floor(F.col("value") * 10).cast("int").alias("prompt_tokens"),
        F.when(view, 0).otherwise(F.col("event_id") % 300).cast("int").alias("completion_tokens"),
        F.col("event_id").cast("string").alias("request_id"), F.col("ts").alias("created_at"),
    )


OPERATIONS = (
    "users_create", "users_update", "documents_upload", "documents_delete",
    "tenants_update_current", "rag_query", "mystery_op",
)


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def request(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    error = F.col("event_type") == "error"
    return table(prepare(spark), d, "events").select(
        i.alias("id"), F.concat(F.lit("src"), F.col("user_id") % 20).alias("tenant_id"),
        F.col("user_id").alias("actor_id"), F.col("ts").alias("created_at"),
        _pick(("GET", "POST", "PATCH", "DELETE"), i % 4).alias("method"),
        _pick(OPERATIONS, i % 7).alias("operation_id"),
        F.concat(F.lit("/api/"), F.col("event_type")).alias("path"), F.col("value").alias("duration_ms"),
        F.when(error & (i % 2 == 0), 403).when(error, 500).otherwise(200).alias("outcome_status"),
    )


def login(spark: SparkSession, d: str, read=table) -> DataFrame:
    who = F.col("user_id") % 3
    return read(prepare(spark), d, "events").filter(F.col("event_type").isin("error", "signup")).select(
        "event_id", F.concat(F.lit("src"), who).alias("tenant_id"), F.concat(F.lit("u"), who).alias("email"),
        (ntz("2024-01-01 00:00:00") + minutes(F.col("event_id"))).alias("ts"),
        (F.col("event_type") != "error").alias("ok"),
    )


def job_event(spark: SparkSession, d: str) -> DataFrame:
    docs = document(spark, d).select("doc_id", "doc_version", "status", "created_at")
    stages = F.explode(
        F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(p).alias("pos")) for p, s in enumerate(("extract", "clean", "chunk"))])
    ).alias("s")
    tries = 1 + (F.col("doc_id") + F.col("s.pos")) % 3
    rows = docs.select("*", stages).select("*", F.explode(F.sequence(F.lit(1), tries.cast("int"))).alias("attempt"))
    retried = F.col("attempt") < tries
    cause = _pick(("ExtractionFailedError", "TimeoutError", "OSError"), F.col("doc_id") % 3)
    broken = (F.col("status") == "failed") & (F.col("s.pos") == 2)
    return rows.select(
        "doc_id", "doc_version", F.col("s.stage").alias("stage"), "attempt",
        F.when(retried | broken, "failed").otherwise("succeeded").alias("status"),
        F.when(retried, cause).alias("cause"),
        (F.col("created_at") + minutes(F.col("s.pos") * 10 + F.col("attempt"))).alias("ts"),
    )


def stream_event(spark: SparkSession, d: str, read=table) -> DataFrame:
    said = message(spark, d, read).filter(F.col("role") == "assistant")
    cut = F.posexplode(F.transform(
        F.sequence(F.lit(0), F.floor((F.length("content") - 1) / 40).cast("int")),
        lambda i: F.substring(F.col("content"), i * 40 + 1, F.lit(40)),
    )).alias("pos", "text")
    deltas = said.select("message_id", "created_at", cut).select(
        "message_id", (F.col("pos") + 1).alias("seq"), F.lit("delta").alias("type"), "text", F.col("created_at").alias("ts")
    )
    ends = said.select(
        "message_id", (F.floor((F.length("content") - 1) / 40) + 2).cast("int").alias("seq"),
        F.when(F.col("message_id") % 7 == 0, "error").otherwise("done").alias("type"),
        F.lit(None).cast("string").alias("text"), (F.col("created_at") + minutes(1)).alias("ts"),
    )
    return deltas.unionByName(ends)


def user_role(spark: SparkSession, d: str) -> DataFrame:
    users = table(prepare(spark), d, "events").select("user_id").distinct()
    names = _pick(("owner", "admin", "editor", "viewer", "ghost"), F.col("user_id") % 5)
    extra = F.when((F.col("user_id") % 30 == 0), F.array(names, F.lit("admin"))).otherwise(F.array(names))
    return users.select(
        "user_id", F.concat(F.lit("src"), F.col("user_id") % 20).alias("tenant_id"),
        F.explode(F.array_distinct(extra)).alias("role"),
    )


VIEWS = {
    "fx_tenant": """
select distinct source as tenant_id, 'free' as plan,
  case cast(substr(source,4) as int) % 4 when 0 then '{"quota":{"documents":30}}' when 1 then '{"quota":{"documents":null}}'
       when 2 then '{"quota":{"documents":true,"messages_day":50}}' else '{}' end as settings
from documents""",
    "fx_kb": """
select distinct source as tenant_id, source || '-' || lang as kb_id,
  case lang when 'en' then '{"chunk":{"target_tokens":256,"overlap_tokens":32},"retrieval":{"top_k":10}}'
       when 'fr' then '{"chunk":{"target_tokens":9,"overlap_tokens":900},"retrieval":{"top_k":999}}'
       when 'de' then '{"chunk":{"target_tokens":true},"retrieval":{"top_k":"five","min_score_ratio":1}}' else '{}' end as config,
  case when lang = 'es' and source in ('src3','src4') then timestamp '2024-01-20 00:00:00' end as deleted_at
from documents""",
    "fx_document": """
select doc_id, source as tenant_id, source || '-' || lang as kb_id, 'doc-' || doc_id as filename, text, lang,
  sha256(text) as content_hash, octet_length(encode(text)) as size_bytes,
  case when doc_id % 3 = 0 then null else doc_id % 150 end as uploaded_by,
  case doc_id % 8 when 0 then 'uploaded' when 1 then 'parsing' when 2 then 'cleaned' when 3 then 'chunked'
       when 4 then 'embedding' when 5 then 'failed' else 'ready' end as status,
  cast(1 + doc_id % 2 as int) as doc_version,
  timestamp '2024-01-01 00:00:00' + to_minutes(cast(doc_id * 37 % 43200 as int)) as created_at,
  timestamp '2024-01-30 22:00:00' + to_minutes(cast(doc_id % 120 as int)) as updated_at,
  case when doc_id % 17 = 0 then timestamp '2024-01-25 00:00:00' end as deleted_at
from documents""",
    "fx_block": """
select * from (with l as (select doc_id, unnest(string_split(text, chr(10))) as text,
                  generate_subscripts(string_split(text, chr(10)), 1) - 1 as block_order from documents),
b as (select doc_id, block_order, case when doc_id % 2 = 0 then 1 + block_order // 5 end as page, text,
             case when block_order % 10 = 0 and length(text) <= 60 then 'heading' when block_order % 13 = 12 then 'table'
                  else 'paragraph' end as type from l)
select doc_id, block_order, page, type, text from b
union all
select distinct doc_id, -page as block_order, page, 'paragraph' as type, 'Internal  use only' as text from b
where doc_id % 50 = 0 and page is not null)""",
    "fx_chunk": """
select d.doc_id || ':' || v.ver || ':' || b.block_order as chunk_id, d.tenant_id, d.kb_id, d.doc_id, cast(v.ver as int) as doc_version,
  cast(b.block_order as int) as seq, b.text as content, v.ver < d.doc_version as superseded
from fx_document d join fx_block b on b.doc_id = d.doc_id and b.block_order >= 0
join (values (1), (2)) as v(ver) on v.ver <= d.doc_version""",
    "fx_embedding": """
select vec_id as chunk_id, 't' || (vec_id % 2) as tenant_id, 't' || (vec_id % 2) || '-' || (label % 5) as kb_id,
  vec_id // 4 as doc_id, embedding as vector, case when vec_id % 11 = 0 then 'm-old' else 'm' end as model,
  cast(1 as int) as embedding_version, vec_id % 7 = 0 as superseded, cast(40 + vec_id * 13 % 900 as int) as tokens
from embeddings""",
    "fx_message": """
select conv_id * 1000 + turn as message_id, 'src' || (conv_id % 20) as tenant_id, conv_id as conversation_id, role, text as content,
  case when role = 'assistant' and conv_id % 9 = 0 then 'streaming' else 'completed' end as status,
  timestamp '2024-01-01 00:00:00' + to_minutes(cast(conv_id * 431 % 43200 + turn as int)) as created_at
from conversations""",
    "fx_query": """
select query_id, tenant_id, question, list_transform(raw, lambda x: x / n) as vector from (
  select *, sqrt(list_sum(list_transform(raw, lambda x: x * x))) as n from (
    select *, list_transform(range(64), lambda i: ('0x' || substr(hexed, 1 + 2 * i, 2))::int / 255.0::double - 0.5::double) as raw from (
      select message_id as query_id, 't' || (conversation_id % 2) as tenant_id, content as question,
        sha256(unhex(sha256(content) || '00000000')) || sha256(unhex(sha256(content) || '00000001')) as hexed
      from fx_message where role = 'user')))""",
    "fx_conversation": """
select conversation_id, tenant_id, conversation_id % 7 as user_id, min(content) as title, conversation_id % 10 = 0 as pinned,
  min(created_at) as created_at, case when conversation_id % 6 = 0 then null else max(created_at) end as last_message_at
from fx_message group by conversation_id, tenant_id""",
    "fx_answer": """
select message_id, tenant_id, conversation_id, created_at,
  content || case message_id % 5 when 0 then ' [c:1] x [c:1]' when 1 then ' [c:2][c:99]' when 2 then ' [c:abc] [c:1]' when 3 then ' [c:]' else '' end as content
from fx_message where role = 'assistant'""",
    "fx_usage": """
select event_id as id, 'src' || (user_id % 20) as tenant_id, case when user_id % 10 = 0 then null else user_id end as user_id,
  case event_type when 'view' then 'embedding' else 'llm' end as category, event_type as model,
  cast(floor(value * 10) as int) as prompt_tokens, cast(case event_type when 'view' then 0 else event_id % 300 end as int) as completion_tokens,
  cast(event_id as varchar) as request_id, ts as created_at
from events""",
    "fx_request": """
select event_id as id, 'src' || (user_id % 20) as tenant_id, user_id as actor_id, ts as created_at,
  case event_id % 4 when 0 then 'GET' when 1 then 'POST' when 2 then 'PATCH' else 'DELETE' end as method,
  case event_id % 7 when 0 then 'users_create' when 1 then 'users_update' when 2 then 'documents_upload' when 3 then 'documents_delete'
       when 4 then 'tenants_update_current' when 5 then 'rag_query' else 'mystery_op' end as operation_id,
  '/api/' || event_type as path, value as duration_ms,
  cast(case when event_type = 'error' and event_id % 2 = 0 then 403 when event_type = 'error' then 500 else 200 end as int) as outcome_status
from events""",
    "fx_login": """
select event_id, 'src' || (user_id % 3) as tenant_id, 'u' || (user_id % 3) as email,
  timestamp '2024-01-01 00:00:00' + to_minutes(event_id) as ts, event_type <> 'error' as ok
from events where event_type in ('error', 'signup')""",
    "fx_job_event": """
select d.doc_id, d.doc_version, s.stage, cast(a.n as int) as attempt,
  case when a.n < 1 + (d.doc_id + s.pos) % 3 then 'failed' when d.status = 'failed' and s.pos = 2 then 'failed' else 'succeeded' end as status,
  case when a.n < 1 + (d.doc_id + s.pos) % 3 then (case d.doc_id % 3 when 0 then 'ExtractionFailedError' when 1 then 'TimeoutError' else 'OSError' end) end as cause,
  d.created_at + to_minutes(cast(s.pos * 10 + a.n as int)) as ts
from fx_document d, (values ('extract', 0), ('clean', 1), ('chunk', 2)) as s(stage, pos), (values (1), (2), (3)) as a(n)
where a.n <= 1 + (d.doc_id + s.pos) % 3""",
    "fx_stream_event": """
select message_id, cast(i + 1 as int) as seq, 'delta' as type, substr(content, cast(i * 40 + 1 as int), 40) as text, created_at as ts
from (select message_id, content, created_at, unnest(generate_series(0, (length(content) - 1) // 40)) as i from fx_message where role = 'assistant')
union all
select message_id, cast((length(content) - 1) // 40 + 2 as int), case message_id % 7 when 0 then 'error' else 'done' end, null, created_at + to_minutes(1)
from fx_message where role = 'assistant'""",
    "fx_user_role": """
select u.user_id, 'src' || (u.user_id % 20) as tenant_id, r.role from (select distinct user_id from events) u
join (values ('owner', 0), ('admin', 1), ('editor', 2), ('viewer', 3), ('ghost', 4)) as r(role, k)
  on r.k = u.user_id % 5 or (u.user_id % 30 = 0 and r.k = 1)""",
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prepend every view the statement uses, directly or through another view."""
    known = {**VIEWS, **(extra or {})}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b[a-z]+x_[a-z_]+\b", text)):
            if name in known and name not in ordered:
                visit(known[name])
                ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    views = ",\n".join(f"{name} as ({known[name]}\n)" for name in ordered)
    body = sql.strip()
    for start in ("with recursive ", "with "):
        if body.lower().startswith(start):
            return f"{start}{views},\n{body[len(start):]}"
    return f"with {views}\n{body}"
