"""Registered retrieval, context, citation, answer and conversation queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.functions.skew import running_count
from marginalia.operators import citations as A
from marginalia.operators import context as P
from marginalia.operators import conversations as V
from marginalia.operators import graph as G
from marginalia.operators import lexical as L
from marginalia.operators import retrieve as R
from marginalia.operators.paging import page
from marginalia.plans import fixtures as fx
from marginalia.plans.fixtures import NOW, ntz
from marginalia.plans.text import strip_sql, tokens_sql
from marginalia.session import materialise, prepare
from marginalia.sources.tables import table

RATIO = 0.8

EXTRA = {
    "rx_hit": """
select query_id, kb_id, chunk_id, score, row_number() over (partition by query_id, kb_id order by score desc, chunk_id)::int as rank from (
  select q.query_id, e.kb_id, e.chunk_id, round(list_dot_product(q.vector, e.unit_vector), 12) as score
  from fx_query q join (select *, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as unit_vector
    from (select *, vector::double[] as v from fx_embedding where model = 'm' and not superseded)) e on e.tenant_id = q.tenant_id)
qualify rank <= 40""",
    "rx_group": """
select query_id, kb_id, chunk_id, score, rank, dense_rank() over (order by kb_id) as pos from rx_hit
union all select query_id, kb_id, chunk_id, score + 0.5, rank, 1000 from rx_hit where rank <= 5""",
    "rx_merged": """
select *, row_number() over (partition by query_id order by score desc, chunk_id::varchar)::int as merged_rank from (
  select query_id, chunk_id, kb_id, score from rx_group qualify row_number() over (partition by query_id, chunk_id order by pos, rank) = 1)""",
    "rx_gated": """
select * from (select *, first_value(score) over (partition by query_id order by merged_rank) as best from rx_merged)
where best <= 0 or merged_rank = 1 or score >= best * 0.8""",
    "rx_selected": """
select * from (select *, sum(tokens) over (partition by query_id order by position)::bigint as used_tokens from (
  select g.*, e.tokens, row_number() over (partition by query_id order by merged_rank)::int as position
  from rx_gated g join fx_embedding e using (chunk_id)) where position <= 8) where position = 1 or used_tokens <= 2000""",
    "rx_content": r"""
select s.query_id, s.position, case when s.chunk_id % 7 = 3 then '' else 'doc-' || s.chunk_id end as document_name,
  case when s.chunk_id % 2 = 0 then s.chunk_id // 4 end as page,
  case s.chunk_id % 3 when 0 then '' when 1 then '（A）' else '（A › B）' end as shown_path,
  case when s.chunk_id % 5 = 0 then 'x <<redacted-delimiter>> y <<redacted-delimiter>>' || chr(10) else '' end || d.text as shown
from rx_selected s join documents d on d.doc_id = s.chunk_id""",
    "rx_context": """
select q.query_id, '<<<KNOWLEDGE_CONTEXT>>>' || chr(10) || coalesce(string_agg('[c:' || position || '] 來源：' ||
  case when document_name = '' then '未命名文件' else document_name end || case when page is null then '' else ' 第 ' || page || ' 頁' end ||
  shown_path || chr(10) || shown || chr(10) || chr(10), '' order by position), '') || '<<<END_KNOWLEDGE_CONTEXT>>>' as context
from fx_query q left join rx_content c using (query_id) group by q.query_id""",
    "rx_word": r"""
select doc_id as chunk_id, w from (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as w from documents) where w <> ''""",
    "rx_lexical": r"""
select query_id, chunk_id, bm25, row_number() over (partition by query_id order by bm25 desc, chunk_id)::int as rank from (
  select q.query_id, t.chunk_id, round(sum(q.qtf * ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * (t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * l.len / s.avg)))), 9) as bm25
  from (select query_id, w, count(*) as qtf from (select query_id, unnest(regexp_split_to_array(lower(question), '[^\p{L}\p{N}]+')) as w from fx_query) where w <> '' group by 1, 2) q
  join (select chunk_id, w, count(*) as tf from rx_word group by 1, 2) t using (w)
  join (select w, count(distinct chunk_id) as df from rx_word group by 1) f using (w)
  join (select chunk_id, count(*) as len from rx_word group by 1) l on l.chunk_id = t.chunk_id,
  (select (select count(*) from documents) as n, (select count(*) from rx_word) / (select count(*) from documents) as avg) s
  group by 1, 2) qualify rank <= 40""",
    "tx_context": """
select conversation_id, row_number() over (partition by conversation_id order by created_at, message_id)::int as n, message_id as chunk_id, content
from fx_message where role = 'user'""",
    "tx_marker": r"""
select message_id, conversation_id, (pos - 1)::int as pos, marker from (select message_id, conversation_id,
  unnest(regexp_extract_all(content, '\[c:([^\]\s]+)\]', 1)) as marker,
  generate_subscripts(regexp_extract_all(content, '\[c:([^\]\s]+)\]', 1), 1) as pos from fx_answer)""",
    "tx_first": """
select m.message_id, m.conversation_id, m.marker, m.pos, c.chunk_id, c.content from (
  select message_id, conversation_id, marker, min(pos) as pos from tx_marker group by 1, 2, 3) m
left join tx_context c on c.conversation_id = m.conversation_id and c.n::varchar = m.marker""",
    "tx_cited": f"""
select message_id, row_number() over (partition by message_id order by pos)::int as n, marker, chunk_id,
  case when length({strip_sql('content')}) > 240 then substr({strip_sql('content')}, 1, 240) || '…' else {strip_sql('content')} end as snippet
from tx_first where chunk_id is not null""",
    "tx_stats": """
select a.message_id, a.tenant_id, a.created_at, c.k as context_chunks, count(f.chunk_id) as citations, count(f.marker) - count(f.chunk_id) as dropped
from fx_answer a join (select conversation_id, count(*) as k from tx_context group by 1) c using (conversation_id)
left join tx_first f on f.message_id = a.message_id where a.content <> '' group by 1, 2, 3, 4""",
    "tx_snapshot": """
select conversation_id, (1 + turn // 4)::int as version, 's' || max(turn) as summary, max(length(content))::int as token_count, max(message_id) as upto_message_id
from (select *, message_id % 1000 as turn from fx_message) group by 1, 2""",
    "tx_prompt": """
select * from (select distinct source as tenant_id, lang as key, source || '/' || lang as prompt_id, null::timestamp as deleted_at from documents where source in ('src0', 'src1', 'src2')
union all select distinct null, lang, 'system/' || lang, null from documents)""",
}


def hits(spark, d):
    vectors = R.searchable(fx.embedding(spark, d), "m", 1)
    return R.nearest_chunks(fx.query(spark, d), vectors, 40)


def groups(spark, d):
    """The hits per knowledge base, plus the best five of each again as a late group with better scores."""
    first = F.struct(F.lit(0).alias("late"), "score")
    again = F.struct(F.lit(1).alias("late"), (F.col("score") + 0.5).alias("score"))
    both = F.explode(F.when(F.col("rank") <= 5, F.array(first, again)).otherwise(F.array(first))).alias("_g")
    return hits(spark, d).select("query_id", "kb_id", "chunk_id", "rank", both).select(
        "query_id", "kb_id", "chunk_id", "_g.score", "rank", "_g.late")


def merged(spark, d):
    return R.merge_candidates(groups(spark, d), F.struct("late", "kb_id"))


def selected(spark, d, ranked=None):
    sized = (ranked or merged(spark, d)).join(fx.embedding(spark, d).select("chunk_id", "tokens"), "chunk_id")
    return R.select_context(sized, token_budget=2000, ratio=F.lit(RATIO))


def selected_content(spark, d):
    texts = table(prepare(spark), d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    c = F.col("chunk_id")
    forged = F.when(c % 5 == 0, f"x {P.START} y {P.END}\n").otherwise("")
    path = F.slice(F.array(F.lit("A"), F.lit("B")), 1, (c % 3).cast("int"))
    return selected(spark, d).join(texts, "chunk_id").select(
        "query_id", "position", F.concat(forged, "text").alias("content"),
        F.when(c % 7 == 3, "").otherwise(F.concat(F.lit("doc-"), c)).alias("document_name"),
        F.when(c % 2 == 0, F.floor(c / 4)).alias("page"), path.alias("heading_path"))


def contexts(spark, d):
    return P.context_blocks(fx.query(spark, d), selected_content(spark, d))


def ret_01_normalise_query(spark, d):
    """Questions padded with blanks; every eleventh one is blank and rejected."""
    blank = F.when(F.col("message_id") % 11 == 0, F.lit(" \n\t ")).otherwise(F.concat(F.lit(" \t"), F.col("content"), F.lit("\n ")))
    asked = fx.message(spark, d).filter(F.col("role") == "user").select("message_id", blank.alias("question"))
    return R.normalise_queries(asked).select("message_id", "query_norm")


def ret_02_search_query(spark, d):
    blanked = fx.message(spark, d).withColumn("content", F.when(F.col("message_id") % 4 == 1, " ").otherwise(F.col("content")))
    return R.search_queries(blanked, 2)


def ret_03_exact_top_k(spark, d):
    return hits(spark, d).withColumn("score", F.round("score", 4))


def ret_03_settings_context(spark, d):
    """The first base of each tenant sets how many hits, how many chunks, how many tokens and which ratio."""
    vectors = fx.embedding(spark, d)
    own = F.when(F.col("tenant_id") == "t0", '{"top_k":3,"context_chunks":2,"context_token_budget":900,"min_score_ratio":0.9}').otherwise(
        '{"top_k":9,"context_chunks":6,"context_token_budget":2500}')
    config = F.when(F.col("kb_id").endswith("-0"), F.concat(F.lit('{"retrieval":'), own, F.lit("}"))).otherwise('{"retrieval":{"top_k":1}}')
    kbs = vectors.select("tenant_id", "kb_id").distinct().withColumn("config", config)
    chunks = vectors.select("chunk_id", "tokens", F.concat(F.lit("doc-"), "doc_id").alias("document_name"), "embedding_version")
    out = R.retrieve(fx.query(spark, d), R.searchable(vectors, "m", 1), kbs, chunks, ["document_name", "embedding_version"])
    return out.withColumn("score", F.round("score", 4))


def _ann(spark, d):
    return G.approximate_chunks(fx.query(spark, d), R.searchable(fx.embedding(spark, d), "m", 1), 40)


def ret_04_approximate_top_k(spark, d):
    return _ann(spark, d).withColumn("score", F.round("score", 4))


def ret_04_recall(spark, d):
    return R.recall(hits(spark, d), _ann(spark, d))


def ret_04_checked(spark, d):
    """Per question: approximate hits whose score is not the exact cosine, hits out of order, and whether there are any."""
    return R.check_hits(_ann(spark, d), fx.query(spark, d), fx.embedding(spark, d))


def ret_04_recall_bound(spark, d):
    """The exact hits of all questions, and whether the graph finds at least nine tenths of them.

    The questions' vectors have no direction in common with the stored ones, the hardest case for a graph.
    """
    return ret_04_recall(spark, d).agg(
        F.count("*").alias("questions"), F.sum("hits").alias("exact_hits"), (F.avg("recall") >= 0.9).alias("enough"))


def ret_05_rag_settings(spark, d):
    return R.rag_settings(fx.kb(spark, d)).drop("config", "deleted_at")


def ret_06_merge_candidates(spark, d):
    return merged(spark, d).withColumn("score", F.round("score", 4))


def ret_07_distinct_queries(spark, d):
    asked = R.normalise_queries(fx.query(spark, d))
    models = fx.embedding(spark, d).select("tenant_id", F.col("model").alias("lookup_model")).distinct()
    return R.distinct_queries(asked, models)


def ret_08_score_gate(spark, d):
    return R.score_gate(merged(spark, d), F.lit(RATIO)).select("query_id", "chunk_id", "merged_rank")


def ret_09_select_context(spark, d):
    return selected(spark, d).select("query_id", "chunk_id", "kb_id", "position", "used_tokens", F.round("score", 4).alias("score"))


def ret_10_trace(spark, d):
    ranked = materialise(merged(spark, d), "ranked")
    out = R.retrieval_trace(fx.query(spark, d), ranked, selected(spark, d, ranked))
    return out.withColumn("top_score", F.round("top_score", 4)).withColumn("spread", F.round("spread", 4))


def lexical(spark, d):
    texts = table(prepare(spark), d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return L.lexical_hits(fx.query(spark, d), texts, 40)


def ret_11_lexical_top_k(spark, d):
    return lexical(spark, d).withColumn("bm25", F.round("bm25", 3))


def ret_12_fusion(spark, d):
    by_vector = merged(spark, d).filter(F.col("merged_rank") <= 40).withColumnRenamed("merged_rank", "rank")
    return R.fuse([by_vector, lexical(spark, d)]).withColumn("rrf", F.round("rrf", 10))


def _word_overlap():
    """A stand-in scorer: share of the question's words that the chunk holds."""
    import numpy as np

    def score(questions, contents):
        out, last, held = np.zeros(len(questions)), None, None
        for i, (q, c) in enumerate(zip(questions, contents)):
            if last is None or c != last:  # pairs come chunk by chunk
                last, held = c, set(c.lower().split())
            asked = set(q.lower().split())
            out[i] = len(asked & held) / max(len(asked), 1)
        return out
    return score


def ret_13_rerank(spark, d):
    asked = fx.query(spark, d).select("query_id", "question")
    texts = table(prepare(spark), d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    pairs = lexical(spark, d).join(asked, "query_id").join(texts, "chunk_id")
    return R.rerank(pairs, _word_overlap).select("query_id", "chunk_id", "position", F.round("rerank_score", 9).alias("score"))


def ret_14_merge_adjacent(spark, d):
    """Two of three lines of each document are taken; each repeats the end of the line before it."""
    chunks = fx.chunk(spark, d).filter(~F.col("superseded") & (F.col("seq") % 3 != 2))
    prev = chunks.select("doc_id", (F.col("seq") + 1).alias("seq"), F.right("content", F.lit(12)).alias("tail"))
    lapped = chunks.join(prev, ["doc_id", "seq"], "left")
    return R.merge_adjacent(lapped.select(
        F.col("doc_id").alias("query_id"), "doc_id", "seq", F.concat(F.coalesce("tail", F.lit("")), "content").alias("content")))


def _golden(spark, d):
    """Up to three expected chunks per question, where the question's tenant has them."""
    q = F.col("query_id")
    wanted = fx.query(spark, d).select("query_id", "tenant_id", F.explode(F.array_distinct(F.array(q % 499, q * 7 % 499, q * 13 % 499))).alias("chunk_id"))
    return wanted.join(fx.embedding(spark, d).select("tenant_id", "chunk_id"), ["tenant_id", "chunk_id"], "left_semi").select("query_id", "chunk_id")


def ret_15_evaluation(spark, d):
    ranked = merged(spark, d).withColumnRenamed("merged_rank", "rank")
    return R.evaluate(_golden(spark, d), ranked, 40)


def ret_15_summary(spark, d):
    out = R.evaluation_summary(ret_15_evaluation(spark, d), 40)
    return out.withColumn("recall", F.round("recall", 9)).withColumn("mrr", F.round("mrr", 9))


def ret_15_cross_language(spark, d):
    """The question's language is taken from its best lexical hit."""
    found = lexical(spark, d)
    lang = table(prepare(spark), d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("doc_lang"))
    asked = found.filter(F.col("rank") == 1).join(lang, "chunk_id").select("query_id", F.col("doc_lang").alias("query_lang"))
    out = R.cross_language_share(found, asked, lang)
    return out.withColumn("cross_share", F.round("cross_share", 9))


def ctx_01_context_blocks(spark, d):
    return contexts(spark, d)


def ctx_02_user_turn(spark, d):
    asked = fx.query(spark, d).select("query_id", "question")
    given = contexts(spark, d).filter(F.col("query_id") % 2 == 0)
    return asked.join(given, "query_id", "left").select("query_id", P.user_turn(F.col("question"), F.col("context")).alias("user_turn"))


def current_pair(spark, d):
    m = fx.message(spark, d)
    at = F.struct("created_at", "message_id")
    newest = m.groupBy("conversation_id").agg(
        F.max_by("message_id", F.when(F.col("role") == "user", at)).alias("u"), F.max_by("message_id", F.when(F.col("role") == "assistant", at)).alias("a"))
    return newest.select(F.explode(F.array("u", "a")).alias("message_id"))


def ctx_03_memory_window(spark, d):
    said = fx.message(spark, d).withColumn("role", F.when(F.col("role") == "system", "narrator").otherwise(F.col("role")))
    blanked = said.withColumn("content", F.when(F.col("message_id") % 10 == 3, "").otherwise(F.col("content")))
    return P.memory_window(blanked, current_pair(spark, d), 6)


def _prompts(spark, d):
    docs = table(prepare(spark), d, "documents")
    own = docs.filter(F.col("source").isin("src0", "src1", "src2")).groupBy(F.col("source").alias("tenant_id"), F.col("lang").alias("key"))
    system = docs.groupBy(F.lit(None).cast("string").alias("tenant_id"), F.col("lang").alias("key"))
    # the version in force is the one with the smallest document id of the pair
    active = F.min("doc_id").alias("active_version_id")
    both = own.agg(active).unionByName(system.agg(active))
    prompt = F.concat_ws("/", F.coalesce("tenant_id", F.lit("system")), "key")
    versions = docs.select(
        F.col("doc_id").alias("version_id"), F.explode(F.array("source", F.lit("system"))).alias("owner"), "lang",
        F.when(F.col("doc_id") % 4 == 3, "draft").otherwise("published").alias("status"), F.col("doc_id").alias("version"), F.col("text").alias("template"),
    ).withColumn("prompt_id", F.concat_ws("/", "owner", "lang"))
    return both.select("*", prompt.alias("prompt_id"), F.lit(None).cast("timestamp").alias("deleted_at")), versions


def ctx_04_active_prompt(spark, d):
    prompts, versions = _prompts(spark, d)
    wanted = table(prepare(spark), d, "documents").select(F.col("source").alias("tenant_id"), F.col("lang").alias("key")).distinct()
    return P.active_prompts(wanted, prompts, versions)


def ctx_05_token_budgets(spark, d):
    asked = fx.query(spark, d).select("query_id", "question", F.floor(F.col("query_id") / 1000).alias("conversation_id"))
    memory = P.memory_window(fx.message(spark, d), current_pair(spark, d)).groupBy("conversation_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "content"))), lambda s: s["content"]), "\n").alias("memory"))
    parts = asked.join(memory, "conversation_id", "left").join(contexts(spark, d), "query_id", "left").withColumn("system", F.lit("Answer from the context only."))
    return P.token_budgets(parts)


def snapshot(spark, d):
    m = fx.message(spark, d).withColumn("turn", F.col("message_id") % 1000)
    return m.groupBy("conversation_id", (1 + F.floor(F.col("turn") / 4)).cast("int").alias("version")).agg(
        F.concat(F.lit("s"), F.max("turn")).alias("summary"), F.max(F.length("content")).cast("int").alias("token_count"), F.max("message_id").alias("upto_message_id"))


def _overflow(spark, d):
    early = snapshot(spark, d).filter(F.col("version") == 1)
    return P.memory_overflow(fx.message(spark, d), early)


def ctx_06_memory_overflow(spark, d):
    return _overflow(spark, d)[1]


def ctx_06_memory_windows(spark, d):
    return _overflow(spark, d)[0]


def context_of_turn(spark, d):
    asked = fx.message(spark, d).filter(F.col("role") == "user")
    numbered = running_count(asked, ["conversation_id"], F.date_trunc("hour", "created_at"), [F.col("created_at"), F.col("message_id")], "n")
    return numbered.select("conversation_id", "n", F.col("message_id").alias("chunk_id"), "content")


def _lists(spark, d):
    return A.citations(fx.answer(spark, d), context_of_turn(spark, d))


def cit_01_markers(spark, d):
    return A.marker_rows(fx.answer(spark, d))


def cit_02_citations(spark, d):
    return A.citation_rows(_lists(spark, d)).select("message_id", "n", "marker", "chunk_id")


def cit_02_dropped(spark, d):
    return _lists(spark, d).select("message_id", F.array_join("dropped", ",").alias("dropped")).filter(F.col("dropped") != "")


def cit_03_snippets(spark, d):
    return table(prepare(spark), d, "documents").select("doc_id", X.snippet(F.concat(F.lit(" \n"), F.col("text"))).alias("snippet"))


def cit_04_hallucination_report(spark, d):
    stats = A.turn_stats(fx.answer(spark, d), _lists(spark, d), context_of_turn(spark, d))
    return A.hallucination_report(stats, [F.to_date("created_at").alias("day"), F.col("tenant_id")])


def cit_05_answer_segments(spark, d):
    """Some answers end in the middle of a marker."""
    cut = fx.answer(spark, d).withColumn("content", F.concat("content", F.when(F.col("message_id") % 3 == 0, " tail [c:1").otherwise("")))
    return A.answer_segments(cut, _lists(spark, d))


def cit_06_evaluation_sample(spark, d):
    return A.evaluation_sample(fx.answer(spark, d)).select("message_id", "content")


def ans_01_assembled_answers(spark, d):
    return A.answers_from_events(fx.stream_event(spark, d))


def _resume(spark, d):
    return A.resume_events(fx.stream_event(spark, d), 2, ntz("2024-01-15 12:00:00"))


def ans_02_resume_events(spark, d):
    return _resume(spark, d)[0]


def ans_02_expired_streams(spark, d):
    return _resume(spark, d)[1]


def cnv_01_recent_conversations(spark, d):
    owned = V.owned_page_source(fx.conversation(spark, d), 3)
    return page(owned, "recent_at", "conversation_id", limit=100).select("conversation_id", "recent_at", "position")


def cnv_02_counters(spark, d):
    return V.counters(fx.message(spark, d))


def cnv_03_message_page(spark, d):
    m = fx.message(spark, d).filter(F.col("conversation_id") == 9)
    return page(m, "created_at", "message_id", limit=4, ascending=True).select("message_id", "role", "position", "next_id")


def cnv_04_latest_snapshots(spark, d):
    return V.latest_snapshots(snapshot(spark, d))


def cnv_05_recency_groups(spark, d):
    return V.recency_groups(fx.conversation(spark, d), ntz("2024-01-29 15:00:00"))


def cnv_06_title_search(spark, d):
    return V.title_search(fx.conversation(spark, d), " THE ").select("conversation_id", "title")


QUERIES = {f.__name__: f for f in (
    ret_01_normalise_query, ret_02_search_query, ret_03_exact_top_k, ret_03_settings_context, ret_04_approximate_top_k, ret_04_recall, ret_04_checked, ret_04_recall_bound, ret_05_rag_settings,
    ret_06_merge_candidates, ret_07_distinct_queries, ret_08_score_gate, ret_09_select_context, ret_10_trace,
    ret_11_lexical_top_k, ret_12_fusion, ret_13_rerank, ret_14_merge_adjacent, ret_15_evaluation, ret_15_summary,
    ret_15_cross_language, ctx_01_context_blocks, ctx_02_user_turn, ctx_03_memory_window, ctx_04_active_prompt,
    ctx_05_token_budgets, ctx_06_memory_overflow, ctx_06_memory_windows, cit_01_markers, cit_02_citations, cit_02_dropped,
    cit_03_snippets, cit_04_hallucination_report, cit_05_answer_segments, cit_06_evaluation_sample, ans_01_assembled_answers,
    ans_02_resume_events, ans_02_expired_streams, cnv_01_recent_conversations, cnv_02_counters, cnv_03_message_page,
    cnv_04_latest_snapshots, cnv_05_recency_groups, cnv_06_title_search,
)}

_EVALUATION = """
select g.query_id, count(r.chunk_id) / count(*) as recall, coalesce(1.0 / min(r.merged_rank), 0) as mrr
from (select distinct query_id, chunk_id from (select *, unnest([query_id % 499, query_id * 7 % 499, query_id * 13 % 499]) as chunk_id from fx_query) q
  where (tenant_id, chunk_id) in (select (tenant_id, chunk_id) from fx_embedding)) g
left join rx_merged r on r.query_id = g.query_id and r.chunk_id = g.chunk_id and r.merged_rank <= 40 group by 1"""

ORACLES = {
    "ret_01_normalise_query": f"select message_id, {strip_sql('content')} as query_norm from fx_message where role = 'user' and message_id % 11 <> 0",
    "ret_02_search_query": f"""
select message_id, {strip_sql("array_to_string(list_filter([b2, b1, q], lambda x: x <> ''), chr(10))")} as search_query from (
  select message_id, q, lag(q, 1) over w as b1, lag(q, 2) over w as b2 from (
    select *, case when message_id % 4 = 1 then '' else {strip_sql('content')} end as q from fx_message where role = 'user')
  window w as (partition by conversation_id order by created_at, message_id))""",
    "ret_04_checked": "select query_id, 0::bigint as wrong_scores, 0::bigint as out_of_order, true as any_hits from fx_query",
    "ret_04_recall_bound": "select count(distinct query_id) as questions, count(*) as exact_hits, true as enough from rx_hit",
    "ret_03_settings_context": """
with p as (select * from (values ('t0', 3, 2, 900, 0.9::double), ('t1', 9, 6, 2500, 0.0::double)) as v(tenant_id, top_k, most, budget, ratio)),
m as (select h.query_id, h.kb_id, h.chunk_id, h.score, p.most, p.budget, p.ratio,
    row_number() over (partition by h.query_id order by h.score desc, h.chunk_id::varchar) as merged_rank
  from rx_hit h join fx_query q using (query_id) join p using (tenant_id) where h.rank <= p.top_k),
g as (select * from (select *, first_value(score) over (partition by query_id order by merged_rank) as best from m)
  where ratio <= 0 or best <= 0 or merged_rank = 1 or score >= best * ratio),
n as (select g.*, e.tokens, e.doc_id, e.embedding_version, row_number() over (partition by query_id order by merged_rank)::int as position from g join fx_embedding e using (chunk_id)),
u as (select *, sum(tokens) over (partition by query_id order by position)::bigint as used_tokens from n where position <= most)
select query_id, chunk_id, kb_id, case when round(score, 4) = 0 then 0.0::double else round(score, 4) end as score, position, used_tokens,
  'doc-' || doc_id as document_name, embedding_version from u where position = 1 or used_tokens <= budget""",
    "ret_03_exact_top_k": "select query_id, kb_id, chunk_id, case when round(score, 4) = 0 then 0.0::double else round(score, 4) end as score, rank from rx_hit",
    "ret_05_rag_settings": """
select tenant_id, kb_id,
  case when json_type(config, '$.retrieval.top_k') in ('BIGINT', 'UBIGINT') then greatest(1, least(200, (config->>'$.retrieval.top_k')::bigint)) else 40 end::int as top_k,
  8 as context_chunks, 4500 as context_token_budget,
  case when json_type(config, '$.retrieval.min_score_ratio') in ('BIGINT', 'UBIGINT', 'DOUBLE') then greatest(0, least(1, (config->>'$.retrieval.min_score_ratio')::double)) else 0 end::double as min_score_ratio,
  1 as query_history_turns from fx_kb""",
    "ret_06_merge_candidates": "select query_id, chunk_id, kb_id, case when round(score, 4) = 0 then 0.0::double else round(score, 4) end as score, merged_rank from rx_merged",
    "ret_07_distinct_queries": f"""
select distinct {strip_sql('question')} as query_norm, model as lookup_model from fx_query q join fx_embedding e on e.tenant_id = q.tenant_id""",
    "ret_08_score_gate": "select query_id, chunk_id, merged_rank from rx_gated",
    "ret_09_select_context": "select query_id, chunk_id, kb_id, position, used_tokens, case when round(score, 4) = 0 then 0.0::double else round(score, 4) end as score from rx_selected",
    "ret_10_trace": """
select q.query_id, coalesce(c.n, 0) as candidates, coalesce(s.n, 0) as selected, coalesce(s.t, 0) as tokens, case when round(top, 4) = 0 then 0.0::double else round(top, 4) end as top_score, case when round(top - low, 4) = 0 then 0.0::double else round(top - low, 4) end as spread
from fx_query q left join (select query_id, count(*) as n, max(score) as top, min(score) as low from rx_merged group by 1) c using (query_id)
left join (select query_id, count(*) as n, max(used_tokens) as t from rx_selected group by 1) s using (query_id)""",
    "ret_11_lexical_top_k": "select query_id, chunk_id, round(bm25, 3) as bm25, rank from rx_lexical",
    "ret_12_fusion": """
select query_id, chunk_id, round(rrf, 10) as rrf, row_number() over (partition by query_id order by rrf desc, chunk_id::varchar)::int as rank from (
  select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 12) as rrf from (
    select query_id, chunk_id, merged_rank as rank from rx_merged where merged_rank <= 40
    union all select query_id, chunk_id, rank from rx_lexical) group by 1, 2) qualify rank <= 24""",
    "ret_13_rerank": r"""
with w as (select query_id, list_distinct(list_filter(regexp_split_to_array(lower(question), '\s+'), lambda x: x <> '')) as q from fx_query),
d as (select doc_id as chunk_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') as c from documents)
select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id::varchar)::int as position, round(score, 9) as score from (
  select query_id, chunk_id, len(list_intersect(q, c)) / greatest(len(q), 1) as score from rx_lexical join w using (query_id) join d using (chunk_id))
where score >= 0.3 qualify position <= 8""",
    "ret_14_merge_adjacent": """
with c as (select doc_id, seq, content from fx_chunk where not superseded and seq % 3 <> 2),
l as (select c.doc_id, c.seq, coalesce(right(p.content, 12), '') || c.content as content, p.doc_id is not null as joined
  from c left join c p on p.doc_id = c.doc_id and p.seq = c.seq - 1),
s as (select *, sum((not joined)::int) over (partition by doc_id order by seq) as island, lag(content) over (partition by doc_id order by seq) as prev from l),
t as (select *, case when joined then coalesce(list_max(list_filter(range(1, least(length(prev), length(content)) + 1),
  lambda n: right(prev, n) = substr(content, 1, n))), 0) else 0 end as seam from s)
select doc_id as query_id, doc_id, min(seq) as first_seq, max(seq) as last_seq, string_agg(substr(content, seam + 1), '' order by seq) as passage
from t group by doc_id, island""",
    "ret_15_evaluation": _EVALUATION,
    "ret_15_summary": f"select 40 as k, count(*) as queries, round(avg(recall), 9) as recall, round(avg(mrr), 9) as mrr from ({_EVALUATION})",
    "ret_15_cross_language": """
select q.lang as query_lang, count(*) as hits, round(avg((q.lang <> d.lang)::int), 9) as cross_share from rx_lexical r join documents d on d.doc_id = r.chunk_id
join (select query_id, lang from rx_lexical join documents on doc_id = chunk_id where rank = 1) q using (query_id) group by 1""",
    "ctx_01_context_blocks": "select * from rx_context",
    "ctx_02_user_turn": """
select query_id, case when query_id % 2 = 0 then context || chr(10) || chr(10) || '問題：' || question else question end as user_turn
from fx_query join rx_context using (query_id)""",
    "ctx_03_memory_window": """
with m as (select *, row_number() over (partition by conversation_id order by created_at desc, message_id desc) as r,
  max(message_id) filter (role = 'user') over (partition by conversation_id) as u, max(message_id) filter (role = 'assistant') over (partition by conversation_id) as a from fx_message)
select conversation_id, row_number() over (partition by conversation_id order by created_at, message_id)::int as position, message_id,
  case role when 'system' then 'user' else role end as role, content
from m where r <= 6 and message_id % 10 <> 3 and message_id is distinct from u and message_id is distinct from a and content <> ''""",
    "ctx_04_active_prompt": """
with p as (select source, lang, min(doc_id) as own from documents where source in ('src0', 'src1', 'src2') group by 1, 2),
s as (select lang, min(doc_id) as shared from documents group by 1)
select w.source as tenant_id, w.lang as key, v.doc_id as version, v.text as template
from (select distinct source, lang from documents) w left join p using (source, lang) join s using (lang)
join documents v on v.doc_id = coalesce(own, shared) where v.doc_id % 4 <> 3""",
    "ctx_05_token_budgets": f"""
with m as (select conversation_id, content, created_at, message_id, row_number() over (partition by conversation_id order by created_at desc, message_id desc) as r,
  max(message_id) filter (role = 'user') over (partition by conversation_id) as u, max(message_id) filter (role = 'assistant') over (partition by conversation_id) as a from fx_message),
h as (select conversation_id, string_agg(content, chr(10) order by created_at, message_id) as memory from m
  where r <= 20 and content <> '' and message_id is distinct from u and message_id is distinct from a group by 1),
t as (select query_id, {tokens_sql("'Answer from the context only.'")} as system, coalesce({tokens_sql('memory')}, 0) as memory,
  coalesce({tokens_sql('context')}, 0) as context, {tokens_sql('question')} as question
  from fx_query q left join h on h.conversation_id = q.query_id // 1000 left join rx_context using (query_id)),
u as (unpivot t on system, memory, context, question into name part value tokens)
select query_id, part, tokens, case part when 'system' then 800 when 'memory' then 1500 when 'context' then 4500 else 700 end as budget,
  case part when 'system' then 800 when 'memory' then 1500 when 'context' then 4500 else 700 end - tokens as slack from u""",
    "ctx_06_memory_overflow": """
select m.conversation_id, m.message_id from (select *, row_number() over (partition by conversation_id order by created_at desc, message_id desc) as r from fx_message) m
left join tx_snapshot s on s.conversation_id = m.conversation_id and s.version = 1 where r > 10 and m.message_id > coalesce(s.upto_message_id, -1)""",
    "ctx_06_memory_windows": f"""
with t as (select conversation_id, sum({tokens_sql('content')}) filter (r <= 10) as t10, sum({tokens_sql('content')}) filter (r <= 6) as t6, sum({tokens_sql('content')}) filter (r <= 4) as t4
  from (select *, row_number() over (partition by conversation_id order by created_at desc, message_id desc) as r from fx_message) group by 1)
select conversation_id, case when t10 <= 1500 then 10 when t6 <= 1500 then 6 else 4 end as window from t""",
    "cit_01_markers": "select message_id, pos, marker from tx_marker",
    "cit_02_citations": "select message_id, n, marker, chunk_id from tx_cited",
    "cit_02_dropped": "select message_id, string_agg(marker, ',' order by pos) as dropped from tx_first where chunk_id is null group by 1",
    "cit_03_snippets": f"""
select doc_id, case when length(t) > 240 then substr(t, 1, 240) || '…' else t end as snippet from (select doc_id, {strip_sql('text')} as t from documents)""",
    "cit_04_hallucination_report": """
select created_at::date as day, tenant_id, count(*) as turns, sum(context_chunks)::bigint as context_chunks, sum(citations)::bigint as citations,
  sum(dropped)::bigint as dropped, case when sum(citations + dropped) > 0 then sum(dropped) / sum(citations + dropped) end as dropped_rate
from tx_stats group by 1, 2""",
    "cit_05_answer_segments": r"""
with a as (select message_id, content || case when message_id % 3 = 0 then ' tail ' else '' end as t from fx_answer),
p as (select message_id, regexp_split_to_array(t, '\[c:[^\]\s]+\]') as texts, regexp_extract_all(t, '\[c:([^\]\s]+)\]', 1) as marks from a),
r as (select message_id, i, 0 as part, texts[i] as text, null as index from (select *, unnest(range(1, len(texts) + 1)) as i from p) where texts[i] <> ''
  union all select q.message_id, i, 1, marks[i], c.n from (select *, unnest(range(1, len(marks) + 1)) as i from p) q
    join tx_cited c on c.message_id = q.message_id and c.marker = marks[i])
select message_id, (row_number() over (partition by message_id order by i, part) - 1)::int as segment_no,
  case part when 0 then 'text' else 'citation' end as kind, text, index::int as index from r""",
    "cit_06_evaluation_sample": "select message_id, content from fx_answer where message_id % 100 < 5",
    "ans_01_assembled_answers": """
select message_id, content, case when message_id % 7 = 0 then 'failed' else 'completed' end as status from fx_message where role = 'assistant'""",
    "ans_02_resume_events": """
select e.* from fx_stream_event e join (select message_id from fx_stream_event group by 1 having max(ts) + interval 300 seconds > timestamp '2024-01-15 12:00:00') using (message_id) where seq > 2""",
    "ans_02_expired_streams": """
select message_id, max(ts) as last from fx_stream_event group by 1 having max(ts) + interval 300 seconds <= timestamp '2024-01-15 12:00:00'""",
    "cnv_01_recent_conversations": """
select conversation_id, coalesce(last_message_at, created_at) as recent_at, row_number() over (order by recent_at desc, conversation_id desc)::int as position
from fx_conversation where user_id = 3 qualify position <= 100""",
    "cnv_02_counters": "select conversation_id, count(*) as message_count, max(created_at) as last_message_at from fx_message group by 1",
    "cnv_03_message_page": """
select message_id, role, r::int as position, case when r = 4 and n > 4 then message_id end as next_id from (
  select *, row_number() over (order by created_at, message_id) as r, count(*) over () as n from fx_message where conversation_id = 9) where r <= 4""",
    "cnv_04_latest_snapshots": """
select conversation_id, version, summary, token_count, version + 1 as next_version from tx_snapshot qualify row_number() over (partition by conversation_id order by version desc) = 1""",
    "cnv_05_recency_groups": """
select label, n, case label when '已釘選' then 1 when '今天' then 2 when '昨天' then 3 when '前 7 天' then 4 when '前 30 天' then 5 else 6 end::bigint as place from (
  select case when pinned then '已釘選' when seen >= timestamp '2024-01-29' then '今天' when seen >= timestamp '2024-01-28' then '昨天'
    when seen >= timestamp '2024-01-22' then '前 7 天' when seen >= timestamp '2023-12-30' then '前 30 天' else '更早' end as label, count(*) as n
  from (select *, coalesce(last_message_at, timestamp '2024-01-29 15:00:00') as seen from fx_conversation) group by 1)""",
    "cnv_06_title_search": "select conversation_id, title from fx_conversation where contains(lower(title), 'the')",
}
