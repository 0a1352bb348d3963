"""Registered version, job and embedding queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions.arrays import each
from marginalia.functions.vectors import half_precision, hash_embedding
from marginalia.operators import embed as E
from marginalia.operators import inference as I
from marginalia.operators import jobs as J
from marginalia.operators import versions as V
from marginalia.plans import fixtures as fx
from marginalia.plans.fixtures import NOW, minutes, ntz
from marginalia.plans.text import tokens_sql
from marginalia.session import materialise, prepare, scratch_path
from marginalia.sources.tables import table

EXTRA = {
    "vx_vector": """
select chunk_id, tenant_id, case when seq % 5 = 0 then 'm-old' else 'm' end as model, 1 as embedding_version
from fx_chunk where doc_version = 1 or seq % 3 <> 0 or kb_id like '%-fr'""",
    "vx_active": """
select c.* from fx_chunk c join fx_document d on d.doc_id = c.doc_id and d.doc_version = c.doc_version where not superseded""",
    "vx_gone": """
select d.* from fx_document d left join fx_kb k using (kb_id)
where d.deleted_at < timestamp '2024-02-20' or k.deleted_at < timestamp '2024-02-20'""",
    "jx_status": """
select doc_id, s.status, created_at + to_minutes(cast(s.pos * s.pos * 3 + doc_id % 4 as int)) as ts from fx_document d,
  (values ('uploaded', 0), ('parsing', 1), ('cleaned', 2), ('chunked', 3), ('embedding', 4), ('ready', 5), ('failed', 6), ('uploaded', 7)) as s(status, pos)
where case d.status when 'failed' then pos in (0, 1, 6, 7) else pos <= list_position(['uploaded','parsing','cleaned','chunked','embedding','ready'], d.status) - 1
  and not (pos = 2 and size_bytes > 3000) end""",
    "jx_job": """
select doc_id, doc_version, stage, count(*)::int as attempt, arg_max(status, ts) as status,
  first(cause order by ts desc) as cause, max(ts) as finished_at from fx_job_event group by 1, 2, 3""",
}


def vector(spark, d):
    chunk = fx.chunk(spark, d)
    seq = F.col("seq")
    return chunk.filter((F.col("doc_version") == 1) | (seq % 3 != 0) | F.col("kb_id").endswith("-fr")).select(
        "chunk_id", "tenant_id", F.when(seq % 5 == 0, "m-old").otherwise("m").alias("model"), F.lit(1).alias("embedding_version"))


def status_event(spark, d):
    pos = lambda s: F.array_position(F.array(*[F.lit(x) for x in J.FLOW]), s) - 1
    docs = fx.document(spark, d).select("doc_id", "status", "created_at", "size_bytes")
    steps = F.explode(F.array(*[F.struct(F.lit(s).alias("to"), F.lit(p).alias("pos")) for p, s in enumerate((*J.FLOW, "failed", "uploaded"))])).alias("s")
    rows = docs.select("*", steps)
    at = F.col("s.pos")
    skip = (at == 2) & (F.col("size_bytes") > 3000)
    keep = F.when(F.col("status") == "failed", at.isin(0, 1, 6, 7)).otherwise((at <= pos(F.col("status"))) & ~skip)
    return rows.filter(keep).select("doc_id", F.col("s.to").alias("status"), (F.col("created_at") + minutes(at * at * 3 + F.col("doc_id") % 4)).alias("ts"))


def failed_ids(spark, d):
    return fx.document(spark, d).filter(F.col("status") == "failed").select("doc_id")


def ver_01_reingest_documents(spark, d):
    out = V.reingest_documents(fx.document(spark, d), failed_ids(spark, d), ntz(NOW))
    return out.select("doc_id", "doc_version", "status", "updated_at")


def ver_01_supersede_chunks(spark, d):
    return V.supersede_chunks(fx.chunk(spark, d), failed_ids(spark, d)).select("chunk_id", "doc_id", "superseded")


def ver_02_active_chunks(spark, d):
    return V.active_chunks(fx.chunk(spark, d), fx.document(spark, d)).select("chunk_id", "doc_id", "doc_version", "content")


def _purge(spark, d):
    return V.purgeable_chunks(fx.chunk(spark, d), fx.document(spark, d))


def ver_03_kept_vectors(spark, d):
    return V.without(vector(spark, d), _purge(spark, d), ["chunk_id"]).select("chunk_id", "model")


def ver_03_kept_chunks(spark, d):
    return V.without(fx.chunk(spark, d), _purge(spark, d), ["chunk_id"]).select("chunk_id", "doc_id", "superseded")


def ver_03_purged_count(spark, d):
    return _purge(spark, d).groupBy("tenant_id").agg(F.count("*").alias("purged"))


def ver_04_reembed_coverage(spark, d):
    return V.reembed_coverage(fx.chunk(spark, d), fx.document(spark, d), vector(spark, d).withColumn("model", F.lit("m")), "m", 1)


def _gone(spark, d):
    return V.purgeable_documents(fx.document(spark, d), fx.kb(spark, d), ntz("2024-03-21 00:00:00"))


def ver_05_kept_documents(spark, d):
    return V.without(fx.document(spark, d), _gone(spark, d), ["doc_id"]).select("doc_id", "kb_id")


def ver_05_kept_chunks(spark, d):
    return V.without(fx.chunk(spark, d), _gone(spark, d), ["doc_id"]).select("chunk_id", "doc_id")


def ver_05_kept_vectors(spark, d):
    dead = fx.chunk(spark, d).join(_gone(spark, d).select("doc_id"), "doc_id", "left_semi")
    return V.without(vector(spark, d), dead, ["chunk_id"]).select("chunk_id", "model")


def job_01_job_ledger(spark, d):
    return J.job_ledger(fx.job_event(spark, d))


def job_02_resume_points(spark, d):
    return J.resume_points(J.job_ledger(fx.job_event(spark, d)))


def job_03_status_moves(spark, d):
    return J.status_moves(status_event(spark, d))


def job_04_stuck_documents(spark, d):
    return J.stuck_documents(fx.document(spark, d), ntz(NOW))


def job_05_can_reingest(spark, d):
    return J.can_reingest(fx.document(spark, d), ntz(NOW)).select("doc_id", "status", "can_reingest")


def job_06_stuck_answers(spark, d):
    out = J.stuck_answers(fx.message(spark, d), ntz(NOW))
    return out.select("message_id", "content", "status", "error.code", "error.cause")


def job_07_failure_report(spark, d):
    return J.failure_report(J.job_ledger(fx.job_event(spark, d)))


def job_07_failures(spark, d):
    attempts = fx.job_event(spark, d)
    return J.failures(attempts.filter(F.col("attempt") == 1))


def job_08_retry_schedule(spark, d):
    return J.retry_schedule(fx.job_event(spark, d))


def emb_01_hash_embedding(spark, d):
    docs = table(prepare(spark), d, "documents")
    return each(docs, [F.col("doc_id").alias("chunk_id")], hash_embedding(F.col("text"), 40), "x", "pos").withColumn("x", F.round("x", 9))


def _pending(spark, d):
    return E.pending_chunks(V.active_chunks(fx.chunk(spark, d), fx.document(spark, d)), vector(spark, d), "m", 1)


def emb_02_batch_inference(spark, d):
    out = E.embed_batches(_pending(spark, d), E.word_model(64))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("chunk_id", F.size("vector").alias("dims"), F.round(F.col("vector")[0].cast("double"), 4).alias("first"), F.round(total, 4).alias("total"))


def _refusing(make_model, every):
    """The model, but for texts of some lengths, at which its call fails."""
    def make():
        predict = make_model()

        def refuse(texts):
            if any(len(text) % every == 0 for text in texts):
                raise ValueError("no vectors for this batch")
            return predict(texts)

        return refuse
    return make


def emb_02_resumed_inference(spark, d):
    """The first run's model refuses some batches; the second run computes those and no other."""
    home, pending = scratch_path(spark, "vectors"), materialise(_pending(spark, d), "pending")
    for make in (_refusing(E.word_model(64), 9), E.word_model(64)):
        out = I.embed_missing(pending, make, home, model="m", version=1, waves=2)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("chunk_id", "run", F.size("vector").alias("dims"), F.round(F.col("vector")[0].cast("double"), 4).alias("first"), F.round(total, 4).alias("total"))


def emb_03_pending_chunks(spark, d):
    return _pending(spark, d).select("chunk_id", "content")


def emb_04_upsert_vectors(spark, d):
    stored = fx.embedding(spark, d).select("chunk_id", "model", "embedding_version", F.col("vector")[0].cast("double").alias("head"))
    fresh = stored.filter(F.col("model") == "m").select("chunk_id", F.when(F.col("chunk_id") % 2 == 0, "m").otherwise("m2").alias("model"), "embedding_version", (F.col("head") + 1).alias("head"))
    return E.upsert_vectors(stored, fresh).withColumn("head", F.round("head", 6))


def emb_05_wrong_dimensions(spark, d):
    """Every vector is cut to a length that depends on its label."""
    cut = fx.embedding(spark, d).withColumn("vector", F.slice("vector", 1, F.when(F.col("kb_id").endswith("-3"), 32).otherwise(64)))
    return E.wrong_dimensions(cut, 64)


def emb_06_distinct_texts(spark, d):
    docs = table(prepare(spark), d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    out = E.embed_distinct(docs, lambda once: once.withColumn("vector", hash_embedding(F.col("content"), 32)))
    return out.select("chunk_id", "content_key", F.round(F.col("vector")[0], 6).alias("first"))


def emb_07_lookup_models(spark, d):
    kb = fx.kb(spark, d).select("kb_id", F.when(F.col("kb_id").endswith("-en"), "click").when(F.col("kb_id").endswith("-fr"), " ").when(F.col("kb_id").endswith("-de"), "view").alias("embedding_model"))
    reported = fx.usage(spark, d).groupBy(F.col("model").alias("requested")).agg(F.max(F.when(F.col("category") == "llm", F.concat("model", F.lit("-2024"))).otherwise("")).alias("reported"))
    return E.lookup_models(kb, reported, "signup").select("kb_id", "lookup_model")


def emb_08_half_precision(spark, d):
    v = fx.embedding(spark, d).select("chunk_id", half_precision(F.col("vector")).alias("v"))
    return v.select("chunk_id", F.round(F.col("v")[0].cast("double"), 8).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


def emb_09_embedding_runs(spark, d):
    return E.embedding_runs(fx.document(spark, d), fx.chunk(spark, d), vector(spark, d), "m", 1)


QUERIES = {f.__name__: f for f in (
    ver_01_reingest_documents, ver_01_supersede_chunks, ver_02_active_chunks, ver_03_kept_vectors, ver_03_kept_chunks,
    ver_03_purged_count, ver_04_reembed_coverage, ver_05_kept_documents, ver_05_kept_chunks, ver_05_kept_vectors,
    job_01_job_ledger, job_02_resume_points, job_03_status_moves, job_04_stuck_documents, job_05_can_reingest,
    job_06_stuck_answers, job_07_failure_report, job_07_failures, job_08_retry_schedule, emb_01_hash_embedding,
    emb_02_batch_inference, emb_02_resumed_inference, emb_03_pending_chunks, emb_04_upsert_vectors, emb_05_wrong_dimensions, emb_06_distinct_texts,
    emb_07_lookup_models, emb_08_half_precision, emb_09_embedding_runs,
)}

_PURGE = "select chunk_id from fx_chunk join fx_document using (doc_id) where superseded and status = 'ready'"
_PENDING = "select * from vx_active where chunk_id not in (select chunk_id from vx_vector where model = 'm')"


def _hash_sql(text: str, source: str, key: str, dims: int) -> str:
    blocks = " || ".join(f"sha256(unhex(sha256({text}) || '{n:08x}'))" for n in range((dims + 31) // 32))
    return f"""
select {key}, list_transform(raw, lambda x: x / n) as v from (
  select *, sqrt(list_sum(list_transform(raw, lambda x: x * x))) as n from (
    select *, list_transform(range({dims}), lambda i: ('0x' || substr(hexed, 1 + 2 * i, 2))::int / 255.0::double - 0.5::double) as raw
    from (select *, {blocks} as hexed from {source})))"""


ORACLES = {
    "ver_01_reingest_documents": """
select doc_id, (doc_version + (status = 'failed')::int)::int as doc_version, case status when 'failed' then 'uploaded' else status end as status,
  case status when 'failed' then timestamp '2024-01-31' else updated_at end as updated_at from fx_document""",
    "ver_01_supersede_chunks": """
select chunk_id, doc_id, superseded or status = 'failed' as superseded from fx_chunk join fx_document using (doc_id)""",
    "ver_02_active_chunks": "select chunk_id, doc_id, doc_version, content from vx_active",
    "ver_03_kept_vectors": f"select chunk_id, model from vx_vector where chunk_id not in ({_PURGE})",
    "ver_03_kept_chunks": f"select chunk_id, doc_id, superseded from fx_chunk where chunk_id not in ({_PURGE})",
    "ver_03_purged_count": f"select tenant_id, count(*) as purged from fx_chunk where chunk_id in ({_PURGE}) group by 1",
    "ver_04_reembed_coverage": """
select a.tenant_id, kb_id, count(*) as chunks, count(v.chunk_id) as embedded, count(v.chunk_id) / count(*) as coverage,
  count(v.chunk_id) = count(*) as ready_to_switch
from vx_active a left join vx_vector v on v.chunk_id = a.chunk_id group by 1, 2""",
    "ver_05_kept_documents": "select doc_id, kb_id from fx_document where doc_id not in (select doc_id from vx_gone)",
    "ver_05_kept_chunks": "select chunk_id, doc_id from fx_chunk where doc_id not in (select doc_id from vx_gone)",
    "ver_05_kept_vectors": """
select chunk_id, model from vx_vector where chunk_id not in (select chunk_id from fx_chunk where doc_id in (select doc_id from vx_gone))""",
    "job_01_job_ledger": "select * from jx_job",
    "job_02_resume_points": """
with w as (select doc_id, doc_version, max(status) filter (stage = 'extract') as e, max(status) filter (stage = 'clean') as c,
  max(status) filter (stage = 'chunk') as k from jx_job group by 1, 2)
select doc_id, doc_version, case when e is distinct from 'succeeded' then 'extract' when c is distinct from 'succeeded' then 'clean' else 'chunk' end as resume_stage,
  case when e = 'failed' then 'extract' when c = 'failed' then 'clean' when k = 'failed' then 'chunk' else 'extract' end as failing_stage from w""",
    "job_03_status_moves": """
select doc_id, from_status, to_status, ts, coalesce((from_status, to_status) in (('uploaded','parsing'), ('parsing','cleaned'), ('cleaned','chunked'),
    ('chunked','embedding'), ('embedding','ready'), ('ready','uploaded'), ('failed','uploaded')) or (to_status = 'failed' and from_status not in ('ready','failed')), false) as legal,
  date_diff('second', since, ts) as seconds,
  case to_status when 'parsing' then 20 when 'cleaned' then 40 when 'chunked' then 60 when 'embedding' then 80 when 'ready' then 100 else 0 end::int as progress
from (select doc_id, lag(status) over w as from_status, status as to_status, ts, lag(ts) over w as since from jx_status window w as (partition by doc_id order by ts))
where from_status is not null""",
    "job_04_stuck_documents": """
select doc_id, tenant_id, status, updated_at, case status when 'uploaded' then 'ingestion' else 'embedding' end as queue from fx_document
where status in ('uploaded', 'chunked') and updated_at < timestamp '2024-01-30 23:50:00'""",
    "job_05_can_reingest": """
select doc_id, status, not (status in ('parsing', 'cleaned', 'embedding') and updated_at > timestamp '2024-01-30 23:00:00') as can_reingest from fx_document""",
    "job_06_stuck_answers": """
select message_id, content, 'interrupted' as status, 'STREAM_INTERRUPTED' as code, 'worker_lost' as cause from fx_message
where status = 'streaming' and created_at < timestamp '2024-01-30 23:50:00'""",
    "job_07_failure_report": """
select stage, coalesce(cause, 'unknown') as cause, coalesce(cause not in ('ExtractionFailedError', 'ObjectNotFoundError'), true) as retryable, count(*) as n
from jx_job where status = 'failed' group by all""",
    "job_07_failures": """
select doc_id, doc_version, stage, coalesce(cause, 'unknown') as cause, coalesce(cause <> 'ExtractionFailedError', true) as retryable,
  case when cause = 'ExtractionFailedError' then cause else '處理失敗，請稍後重試或聯絡管理員' end as message
from fx_job_event where attempt = 1 and status = 'failed'""",
    "job_08_retry_schedule": """
select doc_id, doc_version, stage, attempt, ts + to_seconds(case attempt when 1 then 30 when 2 then 120 when 3 then 600 end) as next_due, attempt > 3 as dead_letter
from fx_job_event where status = 'failed'""",
    "emb_01_hash_embedding": f"""
select chunk_id, (p - 1)::int as pos, round(x, 9) as x from (select chunk_id, unnest(v) as x, generate_subscripts(v, 1) as p from (
{_hash_sql('text', 'documents', 'doc_id as chunk_id', 40)}))""",
    "emb_02_batch_inference": rf"""
with p as ({_PENDING}),
w as (select chunk_id, unnest(regexp_extract_all(content, '[^\x20\x09-\x0D]+')) as word from p),
c as (select chunk_id, ('0x' || substr(md5(word), 1, 8))::bigint % 64 as place, count(*) as n from w group by 1, 2),
v as (select chunk_id, place, n / sqrt(sum(n * n) over (partition by chunk_id)) as x from c)
select p.chunk_id, 64 as dims, round(coalesce(max(x) filter (place = 0), 0.0)::float::double, 4) as first, round(coalesce(sum(x::float::double), 0.0), 4) as total
from p left join v using (chunk_id) group by p.chunk_id""",
    "emb_02_resumed_inference": rf"""
with p as ({_PENDING}),
b as (select doc_id, doc_version, seq // 64 as n, max((length(content) % 9 = 0)::int)::int as run from p group by all),
w as (select chunk_id, unnest(regexp_extract_all(content, '[^\x20\x09-\x0D]+')) as word from p),
c as (select chunk_id, ('0x' || substr(md5(word), 1, 8))::bigint % 64 as place, count(*) as n from w group by 1, 2),
v as (select chunk_id, place, n / sqrt(sum(n * n) over (partition by chunk_id)) as x from c)
select p.chunk_id, any_value(run) as run, 64 as dims, round(coalesce(max(x) filter (place = 0), 0.0)::float::double, 4) as first, round(coalesce(sum(x::float::double), 0.0), 4) as total
from p join b on b.doc_id = p.doc_id and b.doc_version = p.doc_version and b.n = p.seq // 64 left join v using (chunk_id) group by p.chunk_id""",
    "emb_03_pending_chunks": f"select chunk_id, content from ({_PENDING})",
    "emb_04_upsert_vectors": """
with s as (select chunk_id, model, embedding_version, vector[1]::double as head from fx_embedding),
n as (select chunk_id, case when chunk_id % 2 = 0 then 'm' else 'm2' end as model, embedding_version, head + 1 as head from s where model = 'm')
select chunk_id, model, embedding_version, round(head, 6) as head from n
union all select chunk_id, model, embedding_version, round(head, 6) from s where (chunk_id, model) not in (select (chunk_id, model) from n)""",
    "emb_05_wrong_dimensions": "select chunk_id, 32 as dims from fx_embedding where kb_id like '%-3'",
    "emb_06_distinct_texts": f"""
select doc_id as chunk_id, sha256(text) as content_key, round(v[1], 6) as first from ({_hash_sql('text', 'documents', 'doc_id, text', 32)})""",
    "emb_07_lookup_models": """
select kb_id, case when kb_id like '%-en' then 'click-2024' when kb_id like '%-de' then 'view' else 'signup-2024' end as lookup_model from fx_kb""",
    "emb_08_half_precision": """
with x as (select chunk_id, p, v::double as x, case when v = 0 then 1 else pow(2, greatest(floor(log2(abs(v::double))), -14) - 10) end as step from (
  select chunk_id, unnest(vector) as v, generate_subscripts(vector, 1) as p from fx_embedding)),
h as (select chunk_id, p, round_even(x / step, 0) * step as h from x)
select chunk_id, round(max(h) filter (p = 1), 8) as first, round(sum(h order by p), 6) as total from h group by 1""",
    "emb_09_embedding_runs": f"""
with p as (select doc_id, count(*) as embedded, sum({tokens_sql('content')})::bigint as tokens from ({_PENDING}) group by 1)
select doc_id, tenant_id, doc_version, 'ready' as status, coalesce(embedded, 0) as embedded, coalesce(tokens, 0) as tokens,
  case when tokens > 0 then 'embed:' || doc_id || ':v' || doc_version end as request_id
from fx_document left join p using (doc_id) where status in ('chunked', 'embedding', 'ready')""",
}
