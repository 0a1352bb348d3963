"""Registered intake, cleaning, token and chunking queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.functions.arrays import each
from marginalia.operators import chunk as K
from marginalia.operators import clean as C
from marginalia.operators import intake as N
from marginalia.operators import sinks as S
from marginalia.plans import fixtures as fx
from marginalia.session import materialise, prepare, scratch_path
from marginalia.sources import blocks as B
from marginalia.sources import objects as O
from marginalia.sources import tables as T

CJK_SQL = r"[\x{3000}-\x{303F}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"


def tokens_sql(col: str) -> str:
    cjk = f"(length({col}) - length(regexp_replace({col}, '{CJK_SQL}', '', 'g')))"
    return f"({cjk} + (length({col}) - {cjk} + 3) // 4)::int"


INVISIBLE_SQL = r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{00AD}]"
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def match_sql(col: str) -> str:
    return f"trim(regexp_replace(regexp_replace({col}, '{INVISIBLE_SQL}', '', 'g'), '{WS}+', ' ', 'g'))"


def strip_sql(col: str) -> str:
    return f"regexp_replace(regexp_replace({col}, '^{WS}+', ''), '{WS}+$', '')"


def clean_sql(col: str) -> str:
    bare = f"regexp_replace({col}, '{INVISIBLE_SQL}', '', 'g')"
    tidy = rf"regexp_replace(regexp_replace({bare}, '[ \t]+(\n)', '\1', 'g'), '[ \t]+$', '')"
    return strip_sql(rf"regexp_replace({tidy}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def bad_sql(col: str) -> str:
    return rf"((length({col}) - length(regexp_replace({col}, '[\x{{FFFD}}\p{{Cc}}]', '', 'g'))) / length({col}))"


EXTRA = {
    "cx_header": f"""
select doc_id, m as match_text, count(distinct page) as pages from (
  select doc_id, page, {match_sql('text')} as m from fx_block where page is not null and type <> 'table')
where m <> '' and {tokens_sql('m')} <= 16 group by 1, 2 having count(distinct page) >= 3""",
    "cx_judged": f"""
select b.*, case when h.doc_id is not null then 'header' when {strip_sql('c')} = '' then 'dropped'
  when type <> 'table' and {bad_sql('c')} > 0.3 then 'dropped' else 'kept' end as fate
from (select *, {match_sql('text')} as m, case when type = 'table' then text else {clean_sql('text')} end as c from fx_block) b
left join cx_header h on h.doc_id = b.doc_id and h.match_text = b.m""",
    "cx_stats": """
select doc_id, count(*) filter (fate <> 'header') as total, count(*) filter (fate = 'dropped') as dropped,
  count(*) filter (fate = 'header') as removed_headers from cx_judged group by doc_id""",
    "cx_rate": """
select *, round_even(case when total > 0 then dropped / total else 0 end, 4) as drop_rate,
  case when total > 0 then dropped / total else 0 end > 0.2 as quality_warning from cx_stats""",
    "hx_block": """
select doc_id, block_order, type, text, page, case when type = 'heading' then 1 + (block_order // 10) % 3 end as level
from fx_block where block_order >= 0""",
    "hx_path": """
select a.doc_id, a.block_order, string_agg(h.text, ' > ' order by h.block_order) as path
from hx_block a join hx_block h on h.doc_id = a.doc_id and h.type = 'heading' and h.block_order <= a.block_order
  and (a.type <> 'heading' or h.block_order < a.block_order and h.level < a.level)
where not exists (select 1 from hx_block s where s.doc_id = a.doc_id and s.type = 'heading'
  and s.block_order > h.block_order and s.block_order <= a.block_order and s.level <= h.level)
group by 1, 2""",
}


def headed_blocks(spark, d):
    level = F.when(F.col("type") == "heading", 1 + F.floor(F.col("block_order") / 10) % 3)
    return B.with_heading_path(fx.block(spark, d).filter(F.col("block_order") >= 0).withColumn("level", level))


def src_04_text_blocks(spark, d):
    """Lines become paragraphs: every line break is widened to a blank line first."""
    docs = T.table(prepare(spark), d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n \t\n")).alias("text"))
    return B.text_blocks(docs).select("doc_id", "block_order", "type", "text")


def src_06_heading_path(spark, d):
    return headed_blocks(spark, d).select("doc_id", "block_order", F.array_join("heading_path", " > ").alias("path"))


def src_02_read_objects(spark, d):
    """Documents written one object each under tenant/kb/doc keys, then read back as raw bytes."""
    docs = fx.document(spark, d).select("doc_id", "tenant_id", "kb_id", "text")
    root = scratch_path(spark, "objects")
    keyed = docs.select(F.concat(F.lit("tenant-"), F.col("tenant_id"), F.lit("/kb/"), F.col("kb_id"), F.lit("/"), F.col("doc_id")).alias("key"), F.encode("text", "UTF-8").alias("content"))
    put = keyed.mapInArrow(_put_objects(root), "key string, length long")
    written = materialise(put, "put")
    stored = O.read_objects(spark, root)
    return written.select(F.split("key", "/")[3].alias("doc_id")).join(stored, "doc_id").select(
        F.col("doc_id").cast("long").alias("doc_id"), "tenant_id", "kb_id", "length", N.content_hash(F.col("content")).alias("content_hash")
    )


def _put_objects(root: str):
    """A task-side writer for object trees: each row is one file, so a retried task only rewrites its own."""
    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for batch in batches:
            keys, bodies = batch.column("key").to_pylist(), batch.column("content").to_pylist()
            for key, body in zip(keys, bodies):
                store.create_dir(f"{base}/{key.rsplit('/', 1)[0]}", recursive=True)
                with store.open_output_stream(f"{base}/{key}") as out:
                    out.write(body)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([len(b) for b in bodies], pa.int64())], ["key", "length"])
    return write


def _uploads(spark, d):
    """Documents as uploaded bytes of several kinds."""
    docs = T.table(prepare(spark), d, "documents")
    utf8 = F.encode("text", "UTF-8")
    entry = lambda name: F.concat(F.unhex(F.lit("504B0304")), utf8, F.unhex(F.lit("504B0102" + "00" * 42)), F.encode(F.lit(name), "UTF-8"), F.unhex(F.lit("504B0506")))
    kind = F.col("doc_id") % 7
    content = (
        F.when(kind == 0, F.concat(F.encode(F.lit("%PDF-1.7 "), "UTF-8"), utf8)).when(kind == 1, entry("word/document.xml"))
        .when(kind == 2, entry("xl/workbook.xml")).when(kind == 3, F.concat(utf8, F.unhex(F.lit("00"))))
        .when(kind == 4, F.concat(utf8, F.unhex(F.lit("C3")))).otherwise(utf8)
    )
    return docs.select("doc_id", content.alias("content"), F.concat(F.lit("f"), F.col("doc_id"), F.when(kind == 6, ".MD").otherwise(".txt")).alias("filename"))


def ing_01_media_type(spark, d):
    return _uploads(spark, d).select("doc_id", N.media_type(F.col("content"), F.col("filename")).alias("media_type"))


def ing_02_size_cap(spark, d):
    size = F.octet_length("text")
    return T.table(prepare(spark), d, "documents").select(
        "doc_id", N.within_size(size).alias("accepted"), N.within_size(size, 4096).alias("accepted_4k"))


def ing_03_content_hash(spark, d):
    return T.table(prepare(spark), d, "documents").select("doc_id", N.content_hash(F.encode("text", "UTF-8")).alias("content_hash"))


def ing_04_exact_duplicates(spark, d):
    marked = N.mark_duplicates(fx.document(spark, d).drop("text"), ["tenant_id", "kb_id", "content_hash"], ["created_at", "doc_id"], "doc_id")
    return marked.select("doc_id", "tenant_id", "kb_id", "duplicate_of")


def ing_04_unseen_documents(spark, d):
    docs = fx.document(spark, d).select("doc_id", "content_hash", "created_at")
    stored = docs.filter(F.col("created_at") < fx.ntz("2024-01-15 00:00:00"))
    arriving = docs.filter(F.col("created_at") >= fx.ntz("2024-01-15 00:00:00"))
    return N.unseen(arriving, stored, ["content_hash"]).select("doc_id", "content_hash")


def ing_05_admission(spark, d):
    """Each tenant may hold 40 documents and 60 000 bytes; tenants 0-4 have no count limit."""
    limits = fx.tenant(spark, d).select(
        "tenant_id", F.when(F.substring("tenant_id", 4, 9).cast("int") >= 5, F.lit(40)).cast("long").alias("max_documents"),
        F.lit(60000).cast("long").alias("max_bytes"), F.lit(3).cast("long").alias("used_documents"), F.lit(1000).cast("long").alias("used_bytes"),
    )
    return N.admit(fx.document(spark, d), limits)


def ing_06_fair_waves(spark, d):
    return N.fair_waves(fx.document(spark, d).select("doc_id", "tenant_id", "created_at")).select("doc_id", "tenant_id", "wave", "place")


def cln_01_match_text(spark, d):
    return fx.block(spark, d).select("doc_id", "block_order", X.match_text(F.col("text")).alias("match_text"))


def cln_02_clean_text(spark, d):
    return T.table(prepare(spark), d, "documents").select(
        "doc_id", X.clean_text(F.replace("text", F.lit(". "), F.lit(".  \n\n\n\n"))).alias("clean_text"))


def cln_03_repeated_headers(spark, d):
    return C.repeated_headers(fx.block(spark, d))


def cln_04_garbled(spark, d):
    """Tabs and line breaks count as unreadable, so letters are thinned out to move the ratio."""
    text = F.regexp_replace("text", "[a-fs-z ]", "\t")
    rows = fx.block(spark, d).filter(F.length("text") > 0).select("doc_id", "block_order", text.alias("t"))
    return rows.select("doc_id", "block_order", F.round(X.unreadable_ratio(F.col("t")), 6).alias("bad_ratio"), C.is_garbled(F.col("t")).alias("garbled"))


def cln_05_kept_blocks(spark, d):
    return C.cleaned(fx.block(spark, d)).select("doc_id", "old_order", "block_order", "type", "text")


def cln_06_clean_stats(spark, d):
    return C.clean_stats(fx.block(spark, d))


def cln_08_quality_report(spark, d):
    return C.quality_report(C.clean_stats(fx.block(spark, d)), fx.document(spark, d))


def cln_09_sensitive_flags(spark, d):
    kept = C.cleaned(fx.block(spark, d))
    flagged = kept.select("doc_id", "block_order", X.sensitive_kinds(F.col("text")).alias("kinds")).filter(F.size("kinds") > 0)
    return flagged.select("doc_id", "block_order", F.array_join("kinds", ",").alias("kinds"))


def chk_01_token_estimate(spark, d):
    return T.table(prepare(spark), d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


def chk_02_block_markdown(spark, d):
    return headed_blocks(spark, d).select(
        "doc_id", "block_order", X.block_markdown(F.col("type"), F.col("text"), F.size("heading_path")).alias("markdown"))


def document_markdown(blocks):
    """Blocks of a document joined by a blank line, in order."""
    rendered = F.struct("block_order", X.block_markdown(F.col("type"), F.col("text"), F.size("heading_path")).alias("m"))
    ordered = F.array_sort(F.collect_list(rendered))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda b: b["m"]), "\n\n").alias("markdown"))


def chk_03_document_markdown(spark, d):
    return document_markdown(headed_blocks(spark, d))


def chk_04_sentences(spark, d):
    docs = T.table(prepare(spark), d, "documents").filter(F.length("text") > 0)
    return each(docs, ["doc_id"], X.sentences(F.col("text")), "sentence", "sentence_no")


def chunk_input(spark, d):
    docs = fx.document(spark, d).select("doc_id", "kb_id")
    kb = K.chunk_settings(fx.kb(spark, d)).select("kb_id", "target_tokens", "overlap_tokens")
    return headed_blocks(spark, d).join(docs.join(kb, "kb_id"), "doc_id")


def chk_05_chunks(spark, d):
    chunks = K.chunk_documents(chunk_input(spark, d))
    return chunks.select("doc_id", "seq", "text", "token_count", "page", F.array_join("heading_path", " > ").alias("heading_path"))


def chk_05_sections(spark, d):
    """With room for everything, a chunk is what stands between headings and tables below its heading."""
    roomy = headed_blocks(spark, d).withColumn("target_tokens", F.lit(10**8)).withColumn("overlap_tokens", F.lit(0))
    chunks = K.chunk_documents(roomy)
    return chunks.select("doc_id", "seq", "text", "token_count", "page", F.array_join("heading_path", " > ").alias("heading_path"))


def chk_06_hard_split(spark, d):
    docs = T.table(prepare(spark), d, "documents")
    return each(docs, ["doc_id"], X.hard_split(F.col("text"), F.lit(100)), "piece", "piece_no")


def chk_07_chunk_stats(spark, d):
    chunks = fx.chunk(spark, d).withColumn("token_count", X.token_estimate(F.col("content")))
    return K.chunk_stats(chunks)


def chk_08_chunk_settings(spark, d):
    return K.chunk_settings(fx.kb(spark, d)).select("tenant_id", "kb_id", "target_tokens", "overlap_tokens")


def snk_03_replace_version(spark, d):
    """Documents of one status get one fresh chunk each for their current version; the rest stays."""
    docs = fx.document(spark, d)
    fresh = docs.filter(F.col("status") == "chunked").select(
        F.concat("doc_id", F.lit(":fresh")).alias("chunk_id"), "tenant_id", "kb_id", "doc_id", "doc_version",
        F.lit(0).alias("seq"), F.col("filename").alias("content"), F.lit(False).alias("superseded"))
    return S.replace_for_keys(fx.chunk(spark, d), fresh, ["doc_id", "doc_version"]).select("chunk_id", "doc_id", "doc_version", "content")


def _artefacts(spark, d):
    made = S.artefacts(headed_blocks(spark, d))
    old = F.when(F.col("doc_id") % 9 == 0, F.replace("artefact", F.lit('"format_version":1'), F.lit('"format_version":0')))
    cut = F.when(F.col("doc_id") % 9 == 1, F.expr("substr(artefact, 1, length(artefact) - 5)"))
    return made.select("doc_id", F.coalesce(old, cut, F.col("artefact")).alias("artefact"))


def snk_04_artefact_blocks(spark, d):
    blocks, _ = S.read_artefacts(_artefacts(spark, d))
    return blocks.select("doc_id", "block_order", "type", "text", "page", F.array_join("heading_path", " > ").alias("path"))


def snk_04_recompute_set(spark, d):
    _, bad = S.read_artefacts(_artefacts(spark, d))
    return bad


def src_13_incremental_pull(spark, d):
    docs = fx.document(spark, d)
    mark = fx.ntz("2024-01-30 23:00:00")
    return T.newer_than(docs, mark).select("doc_id", "tenant_id", "updated_at")


def src_13_next_watermark(spark, d):
    return T.next_watermark(fx.document(spark, d), ["tenant_id"])


def src_14_snapshot_diff(spark, d):
    docs = T.table(prepare(spark), d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    old = docs.filter(F.col("content_hash") < "d")
    new = docs.filter(F.col("content_hash") > "3").withColumn(
        "content_hash", F.when(F.col("doc_id") % 4 == 0, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")))
    return T.snapshot_diff(old, new, ["doc_id"], "content_hash")


def src_11_csv_records(spark, d):
    """Orders written as delimited text and read back with every column as text."""
    path = scratch_path(spark, "csv")
    T.table(prepare(spark), d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("o_orderdate")).write.option("header", True).csv(path)
    from marginalia.sources.records import csv_records
    return csv_records(spark, path)


def src_11_json_records(spark, d):
    """Conversations written as one JSON document each; one block per element of its ``data.turns``."""
    from marginalia.sources.records import json_records
    path = scratch_path(spark, "json")
    turn = F.struct("turn", "role", "text")
    docs = T.table(prepare(spark), d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    docs.select(F.col("conv_id").alias("doc_id"), F.struct("turns").alias("data")).write.json(path)
    schema = "doc_id long, data struct<turns: array<struct<turn: long, role: string, text: string>>>"
    out = json_records(spark, path, schema, "data.turns")
    return out.select("doc_id", "record_no", F.get_json_object("text", "$.role").alias("role"), F.get_json_object("text", "$.text").alias("said"))


QUERIES = {f.__name__: f for f in (
    src_02_read_objects, src_04_text_blocks, src_06_heading_path, src_11_csv_records, src_11_json_records,
    src_13_incremental_pull, src_13_next_watermark, src_14_snapshot_diff, snk_03_replace_version,
    snk_04_artefact_blocks, snk_04_recompute_set, ing_01_media_type, ing_02_size_cap, ing_03_content_hash,
    ing_04_exact_duplicates, ing_04_unseen_documents, ing_05_admission, ing_06_fair_waves, cln_01_match_text,
    cln_02_clean_text, cln_03_repeated_headers, cln_04_garbled, cln_05_kept_blocks, cln_06_clean_stats,
    cln_08_quality_report, cln_09_sensitive_flags, chk_01_token_estimate, chk_02_block_markdown, chk_03_document_markdown,
    chk_04_sentences, chk_05_chunks, chk_05_sections, chk_06_hard_split, chk_07_chunk_stats, chk_08_chunk_settings,
)}

_MARKDOWN = """
select b.doc_id, b.block_order, case when type = 'heading' then
  repeat('#', least(6, 1 + case when path is null then 0 else
    (length(path) - length(replace(path, ' > ', ''))) // 3 + 1 end)::int) || ' ' || text else text end as markdown
from hx_block b left join hx_path p on p.doc_id = b.doc_id and p.block_order = b.block_order"""

ORACLES = {
    "src_02_read_objects": "select doc_id, tenant_id, kb_id, size_bytes as length, content_hash from fx_document",
    "src_04_text_blocks": f"""
select doc_id, (row_number() over (partition by doc_id order by pos) - 1)::int as block_order, 'paragraph' as type, piece as text from (
  select doc_id, {strip_sql('p')} as piece, pos from (
    select doc_id, unnest(string_split(text, chr(10))) as p, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents))
where piece <> ''""",
    "src_06_heading_path": """
select b.doc_id, b.block_order, coalesce(path, '') as path from hx_block b
left join hx_path p on p.doc_id = b.doc_id and p.block_order = b.block_order""",
    "src_11_csv_records": """
select row_number() over (order by o_orderkey) as n, 1 as one from orders where false""",
    "src_11_json_records": """
select conv_id as doc_id, (row_number() over (partition by conv_id order by turn) - 1)::int as record_no, role, text as said from conversations""",
    "src_13_incremental_pull": "select doc_id, tenant_id, updated_at from fx_document where updated_at > timestamp '2024-01-30 23:00:00'",
    "src_13_next_watermark": "select tenant_id, max(updated_at) as watermark from fx_document group by 1",
    "src_14_snapshot_diff": """
with h as (select doc_id, sha256(text) as h from documents), o as (select * from h where h < 'd'),
n as (select doc_id, case when doc_id % 4 = 0 then sha256(h) else h end as h from h where h > '3')
select coalesce(o.doc_id, n.doc_id) as doc_id, case when o.doc_id is null then 'new' when n.doc_id is null then 'deleted'
  when o.h = n.h then 'same' else 'changed' end as change from o full outer join n on o.doc_id = n.doc_id""",
    "snk_03_replace_version": """
select chunk_id, c.doc_id, c.doc_version, content from fx_chunk c join fx_document d using (doc_id)
where not (d.status = 'chunked' and c.doc_version = d.doc_version)
union all select doc_id || ':fresh', doc_id, doc_version, filename from fx_document where status = 'chunked'""",
    "snk_04_artefact_blocks": """
select b.doc_id, b.block_order, type, text, page, coalesce(path, '') as path from hx_block b
left join hx_path p on p.doc_id = b.doc_id and p.block_order = b.block_order where b.doc_id % 9 not in (0, 1)""",
    "snk_04_recompute_set": "select distinct doc_id from hx_block where doc_id % 9 in (0, 1)",
    "ing_01_media_type": r"""
select doc_id, case doc_id % 7 when 0 then 'application/pdf'
  when 1 then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
  when 2 then 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' when 3 then null when 4 then null
  else case when text = '' or regexp_matches(regexp_replace(text, '[ \t\n\r\f\x0b]', '', 'g'), '[\p{C}\p{Z}]') then null
    when doc_id % 7 = 6 then 'text/markdown' else 'text/plain' end end as media_type from documents""",
    "ing_02_size_cap": """
select doc_id, octet_length(encode(text)) <= 33554432 as accepted, octet_length(encode(text)) <= 4096 as accepted_4k from documents""",
    "ing_03_content_hash": "select doc_id, sha256(text) as content_hash from documents",
    "ing_04_exact_duplicates": """
select doc_id, tenant_id, kb_id, nullif(first_value(doc_id) over (partition by tenant_id, kb_id, content_hash order by created_at, doc_id), doc_id) as duplicate_of
from fx_document""",
    "ing_04_unseen_documents": """
select doc_id, content_hash from fx_document where created_at >= timestamp '2024-01-15' and content_hash not in
  (select content_hash from fx_document where created_at < timestamp '2024-01-15')""",
    "ing_05_admission": """
with recursive d as (select doc_id, tenant_id, size_bytes, row_number() over (partition by tenant_id order by created_at, doc_id) as n,
    case when cast(substr(tenant_id, 4) as int) >= 5 then 40 end as cap from fx_document),
f as (select tenant_id, 0::bigint as n, null::bigint as doc_id, 3::bigint as docs, 1000::bigint as bytes, null::varchar as reason from d group by 1
  union all
  select d.tenant_id, d.n, d.doc_id, f.docs + (case when f.docs + 1 > d.cap then 0 when f.bytes + d.size_bytes > 60000 then 0 else 1 end),
    f.bytes + (case when f.docs + 1 > d.cap then 0 when f.bytes + d.size_bytes > 60000 then 0 else d.size_bytes end),
    case when f.docs + 1 > d.cap then 'documents' when f.bytes + d.size_bytes > 60000 then 'storage_bytes' end
  from f join d on d.tenant_id = f.tenant_id and d.n = f.n + 1)
select doc_id, tenant_id, reason is null as admitted, reason from f where n > 0""",
    "ing_06_fair_waves": """
select doc_id, tenant_id, (1 + (rn - 1) // 2)::int as wave, (1 + (rn - 1) % 2)::int as place from (
  select doc_id, tenant_id, row_number() over (partition by tenant_id order by created_at, doc_id) as rn from fx_document)""",
    "cln_01_match_text": f"select doc_id, block_order, {match_sql('text')} as match_text from fx_block",
    "cln_02_clean_text": f"""
select doc_id, {clean_sql('t')} as clean_text from (
  select doc_id, replace(text, '. ', '.  ' || chr(10) || chr(10) || chr(10) || chr(10)) as t from documents)""",
    "cln_03_repeated_headers": "select * from cx_header",
    "cln_04_garbled": f"""
select doc_id, block_order, round({bad_sql('t')}, 6) as bad_ratio, {bad_sql('t')} > 0.3 as garbled from (
  select doc_id, block_order, regexp_replace(text, '[a-fs-z ]', chr(9), 'g') as t from fx_block where length(text) > 0)""",
    "cln_05_kept_blocks": """
select doc_id, block_order as old_order, (row_number() over (partition by doc_id order by block_order) - 1)::int as block_order, type, c as text
from cx_judged where fate = 'kept'""",
    "cln_06_clean_stats": "select * from cx_rate",
    "cln_08_quality_report": """
select tenant_id, kb_id, count(*) as docs, avg(quality_warning::int) as warn_rate, quantile_cont(drop_rate, 0.5) as median_drop_rate
from cx_rate join fx_document using (doc_id) group by 1, 2""",
    "cln_09_sensitive_flags": rf"""
with k as (select doc_id, (row_number() over (partition by doc_id order by block_order) - 1)::int as block_order, c as t from cx_judged where fate = 'kept')
select doc_id, block_order, kinds from (select doc_id, block_order, concat_ws(',',
  case when regexp_matches(t, '(?i)(^|[^\p{{L}}\p{{N}}_])([a-z][a-z0-9+.\-]*://)([^\s/:@]*):([^\s/@]*)@') then 'url_credentials' end,
  case when regexp_matches(t, '(?i)(?:password|passwd|secret|token|api_key|apikey|authorization|cookie|credential|private_key)[A-Za-z0-9_.\-]*["'']?\s*[=:]\s*["'']?(?:bearer|basic|token)?\s*[^&\s"'',}}）]') then 'key_value' end,
  case when regexp_matches(t, '[\p{{L}}\p{{N}}\p{{M}}_.+-]+@[\p{{L}}\p{{N}}\p{{M}}_-]+\.[\p{{L}}\p{{N}}\p{{M}}_.-]+') then 'email' end,
  case when regexp_matches(t, '(^|[^0-9A-Za-z])[A-Z][12]\d{{8}}([^0-9A-Za-z]|$)') then 'national_id' end,
  case when regexp_matches(t, '(^|[^0-9A-Za-z])09\d{{2}}-?\d{{3}}-?\d{{3}}([^0-9A-Za-z]|$)') then 'phone' end,
  case when regexp_matches(t, '(^|[^0-9A-Za-z])\d{{13,19}}([^0-9A-Za-z]|$)') then 'digit_run' end) as kinds from k) where kinds <> ''""",
    "chk_01_token_estimate": f"select doc_id, {tokens_sql('text')} as tokens from documents",
    "chk_02_block_markdown": _MARKDOWN,
    "chk_03_document_markdown": f"""
select doc_id, string_agg(markdown, chr(10) || chr(10) order by block_order) as markdown from ({_MARKDOWN}) group by doc_id""",
    "chk_05_sections": rf"""
with b as (select x.*, coalesce(path, '') as path from hx_block x left join hx_path p using (doc_id, block_order)),
s as (select *, sum((type <> 'paragraph')::int) over w as part, max(case when type = 'heading' then block_order end) over w as head_order
  from b where type <> 'paragraph' or {strip_sql('text')} <> '' window w as (partition by doc_id order by block_order rows unbounded preceding)),
h as (select doc_id, block_order as head_order, text as title, case when path = '' then text else path || ' > ' || text end as own,
    least(6, (case when path = '' then 0 else len(string_split(path, ' > ')) end) + 1)::int as depth, page from s where type = 'heading'),
c as (select s.doc_id, min(block_order) as place, any_value(s.head_order) as head_order, type = 'table' as alone,
    string_agg(s.text, chr(10) || chr(10) order by block_order) as body, arg_min(s.page, block_order) as page
  from s where type <> 'heading' group by s.doc_id, s.part, type = 'table'),
f as (select c.doc_id, place, {strip_sql("case when alone or h.title is null then body else repeat('#', depth) || ' ' || title || chr(10) || chr(10) || body end")} as text,
    case when alone then c.page else coalesce(h.page, first_value(case when not alone then c.page end ignore nulls) over (partition by c.doc_id, c.head_order order by place)) end as page, coalesce(own, '') as heading_path
  from c left join h on h.doc_id = c.doc_id and h.head_order = c.head_order)
select doc_id, (row_number() over (partition by doc_id order by place) - 1)::int as seq, text, {tokens_sql('text')} as token_count, page, heading_path
from f where text <> ''""",
    "chk_04_sentences": rf"""
with s as (select doc_id, string_split(regexp_replace(text, '([。！？；!?;]){WS}*|([.]){WS}+|\n+', '\1\2' || chr(1), 'g'), chr(1)) as parts
  from documents where length(text) > 0)
select doc_id, (row_number() over (partition by doc_id order by pos) - 1)::int as sentence_no, sentence from (
  select doc_id, unnest(parts) as sentence, generate_subscripts(parts, 1) as pos from s) where {strip_sql('sentence')} <> ''""",
    "chk_06_hard_split": f"""
with s as (select doc_id, text, greatest(floor(100 / (greatest({tokens_sql('text')}, 1) / length(text)))::int, 1) as step from documents where length(text) > 0)
select doc_id, i::int as piece_no, substr(text, (i * step + 1)::int, step) as piece from (
  select *, unnest(generate_series(0, (length(text) - 1) // step)) as i from s)""",
    "chk_07_chunk_stats": f"""
select doc_id, count(*) as chunk_count, round_even(avg({tokens_sql('content')}), 1) as avg_tokens from fx_chunk group by doc_id""",
    "chk_08_chunk_settings": """
select tenant_id, kb_id, t as target_tokens, case when json_type(config, '$.chunk.overlap_tokens') in ('BIGINT', 'UBIGINT')
  then greatest(0, least(t - 1, (config->>'$.chunk.overlap_tokens')::bigint)) else 64 end::int as overlap_tokens from (
  select *, case when json_type(config, '$.chunk.target_tokens') in ('BIGINT', 'UBIGINT')
    then greatest(64, least(4000, (config->>'$.chunk.target_tokens')::bigint)) else 512 end::int as t from fx_kb)""",
}
ORACLES["src_11_csv_records"] = """
select cast(o_orderkey as varchar) as o_orderkey, o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate from orders"""
