import json

import pytest
from pyspark.sql import functions as F

from marginalia.operators import audit as U
from marginalia.operators import citations as A
from marginalia.operators import conversations as V
from marginalia.operators import embed as E
from marginalia.operators import identity as I
from marginalia.operators import jobs as J
from marginalia.operators import notify as N
from marginalia.operators import quota as Q
from marginalia.operators import versions as S
from marginalia.operators.context import memory_overflow, memory_window
from marginalia.operators.paging import page
from tests.conftest import at

READY = "tenant_id string, user_id long, kb_id string, doc_id long, filename string, ts timestamp_ntz"


def test_collapse_keeps_first_nine_and_latest(spark):
    rows = [("t", 1, "k", i, f"f{i}", at(seconds=i)) for i in range(15)] + [("t", None, "k", 90, "g", at(0)), ("t", 1, "k", 91, "h", at(10))]
    got = {(r.user_id, r.slot - 2840112): r for r in N.collapse_ready(spark.createDataFrame(rows, READY).repartition(3)).collect()}
    big = next(r for r in got.values() if r["count"] == 15)
    assert list(big.document_ids) == [*range(9), 14] and big.title == "15 份文件已完成" and big.body == "f14 等 15 份文件可以開始問答了。"
    assert big.updated_at == at(seconds=14)
    single = [r for r in got.values() if r["count"] == 1]
    assert {r.title for r in single} == {"g 已完成", "h 已完成"} and all(len(r.document_ids) == 1 for r in single)


def test_ten_ids_are_all_kept(spark):
    rows = [("t", 1, "k", i, "f", at(seconds=i)) for i in range(10)]
    assert list(N.collapse_ready(spark.createDataFrame(rows, READY)).first()["document_ids"]) == list(range(10))


def test_email_switch_only_loses_email(spark):
    df = spark.createDataFrame([(1, "t", 1, "document_failed"), (2, "t", 1, "novel")], "id long, tenant_id string, user_id long, type string")
    assert {(r.id, r.channel) for r in N.deliveries(df).collect()} == {(1, "in_app"), (1, "email"), (2, "in_app")}
    assert {(r.id, r.channel) for r in N.deliveries(df, email_enabled=False).collect()} == {(1, "in_app"), (2, "in_app")}


def test_recipients_fall_back_to_active_managers_once(spark):
    docs = spark.createDataFrame([(1, "t", 5), (2, "t", None), (3, "u", None)], "doc_id long, tenant_id string, uploaded_by long")
    roles = spark.createDataFrame([(7, "t", "owner"), (7, "t", "admin"), (8, "t", "admin"), (9, "t", "viewer"), (6, "u", "owner")], "user_id long, tenant_id string, role string")
    users = spark.createDataFrame([(7, "active"), (8, "disabled"), (9, "active"), (6, "active")], "user_id long, status string")
    assert sorted(map(tuple, N.recipients(docs, roles, users).collect())) == [(1, 5), (2, 7), (3, 6)]


def test_recipients_of_one_large_tenant_are_dealt_to_tasks(spark, monkeypatch):
    """A tenant's documents times its managers are made in pieces, and every document meets every manager once."""
    monkeypatch.setattr(N, "PAIRS", 500)
    docs = spark.range(400).selectExpr("id as doc_id", "'t' as tenant_id", "cast(null as long) as uploaded_by")
    users = spark.range(50).selectExpr("id as user_id", "'active' as status")
    roles = users.selectExpr("'t' as tenant_id", "user_id", "'admin' as role")
    out = N.recipients(docs, roles, users)
    assert out.distinct().count() == out.count() == 20_000
    tasks = [r.n for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(tasks) >= 15 and max(tasks) <= 4_000


def test_mark_read_keeps_the_earliest(spark):
    notices = spark.createDataFrame([(1, 5, at(10), None), (2, 5, at(10), at(11)), (3, 6, at(10), None)], "id long, user_id long, updated_at timestamp_ntz, read_at timestamp_ntz")
    reads = spark.createDataFrame([(1, 5, at(9)), (1, 5, at(20)), (1, 5, at(15)), (2, 5, at(30)), (3, 5, at(30))], "id long, user_id long, read_ts timestamp_ntz")
    assert {r.id: r.read_at for r in N.mark_read(notices, reads).collect()} == {1: at(15), 2: at(11), 3: None}


def test_paging_walks_everything_once(spark):
    df = spark.createDataFrame([(i, at(i // 3)) for i in range(10)], "id long, ts timestamp_ntz")
    seen, after = [], None
    for _ in range(5):
        rows = page(df, "ts", "id", after=after, limit=4).orderBy("position").collect()
        seen += [r.id for r in rows]
        if rows[-1].next_id is None:
            break
        after = (rows[-1].next_ts, rows[-1].next_id)
    assert seen == [9, 8, 7, 6, 5, 4, 3, 2, 1, 0]
    assert page(df, "ts", "id", limit=10).filter("next_id is not null").count() == 0
    assert page(df.limit(0), "ts", "id").count() == 0


def test_audit_rows(spark):
    rows = [(1, "t", at(0), 5, "POST", "users_create", 201), (2, "t", at(0), 5, "GET", "users_create", 200), (3, None, at(0), 5, "POST", "users_create", 401),
            (4, "t", at(0), 5, "POST", "rag_query", 200), (5, "t", at(0), 5, "POST", "auth_login", 200), (6, "t", at(0), 5, "PUT", "brand_new", 403), (7, "t", at(0), 5, "DELETE", None, 500)]
    df = spark.createDataFrame(rows, "id long, tenant_id string, created_at timestamp_ntz, actor_id long, method string, operation_id string, outcome_status int")
    got = {r.id: (r.action, r.resource_type, r.outcome) for r in U.audit_rows(df).collect()}
    assert got == {1: ("user.create", "user", "succeeded"), 6: ("unregistered.brand_new", "unknown", "denied"), 7: ("unregistered.unknown", "unknown", "failed")}


def lines(spark, items):
    return spark.createDataFrame([(i if isinstance(i, str) else json.dumps(i),) for i in items], "value string")


def test_access_log_tolerates_noise(spark):
    ok = {"event": "http_request", "path": "/a", "status": 200, "duration_ms": 5, "ts": "2024-01-01T00:00:00Z"}
    noise = ["INFO start", "", '{"event": "http_req', "[1]", {**ok, "event": "x"}, {**ok, "duration_ms": "5"}, {**ok, "duration_ms": None}]
    got = U.access_events(lines(spark, [ok, "  " + json.dumps({**ok, "duration_ms": 1.5, "ts": "never"}), *noise])).orderBy("duration_ms").collect()
    assert [(r.duration_ms, r.ts is None) for r in got] == [(1.5, True), (5.0, False)]


def test_last_seconds(spark):
    schema = "ts timestamp, path string, duration_ms double"
    df = spark.createDataFrame([(at(0), "a", 1.0), (at(5), "a", 2.0), (None, "a", 3.0)], schema)
    assert [r.duration_ms for r in U.last_seconds(df, 300).orderBy("duration_ms").collect()] == [1.0, 2.0]
    assert [r.duration_ms for r in U.last_seconds(df, 299.5).collect()] == [2.0]
    assert U.last_seconds(df.filter("ts is null"), 1).count() == 1


@pytest.mark.parametrize("n", [1, 2, 3, 20, 60, 101])
def test_percentiles_use_the_nearest_rank(spark, n):
    values = [float((i * 37) % n) + 0.25 for i in range(n)]
    r = U.latency_report(spark.createDataFrame([(None, "p", v) for v in values], "ts timestamp, path string, duration_ms double")).first()
    ranked = sorted(values)
    want = [ranked[max(1, min(n, round(f * n + 0.5))) - 1] for f in (0.5, 0.95, 0.99)]
    assert [r.p50, r.p95, r.p99] == want and r.n == n and r["max"] == ranked[-1]


def test_append_only_violation(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "id int, c string")
    assert [r.id for r in U.append_only_violations(df, ["c"]).collect()] == [2]


def test_permissions_union_and_unknown_roles(spark):
    df = spark.createDataFrame([("t", 1, "viewer"), ("t", 1, "editor"), ("t", 2, "ghost"), ("t", 3, "owner")], "tenant_id string, user_id long, role string")
    got = {}
    for r in I.effective_permissions(df).collect():
        got.setdefault(r.user_id, set()).add(r.permission)
    assert got == {1: set(I.ROLE_PERMISSIONS["editor"]), 3: set(I.ROLE_PERMISSIONS["owner"])}
    assert "tenant:admin" not in I.ROLE_PERMISSIONS["admin"]


def test_status_and_reconcile_keep_facts(spark):
    held = spark.createDataFrame([("t", "documents", 3), ("t", "streams", 2), ("t", "tokens_month", None)], "tenant_id string, resource string, limit long")
    used = spark.createDataFrame([("t", "documents", 5), ("t", "tokens_month", 9)], "tenant_id string, resource string, used long")
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    got = {r.resource: (r.used, r.remaining) for r in Q.status(held, used, now).collect()}
    assert got == {"documents": (5, 0), "streams": (0, 2), "tokens_month": (9, None)}
    counters = spark.createDataFrame([("t", "tokens_month", 14)], used.schema)
    snap = {r.resource: (r.used, r.limit, r.drift, str(r.period_start)) for r in Q.reconcile(used, counters, held, now).collect()}
    assert snap == {"documents": (5, 3, None, "2024-01-30"), "tokens_month": (9, None, 5, "2024-01-01")}


def test_job_ledger_resume_and_retry(spark):
    rows = [(1, 1, "extract", 1, "failed", "OSError", at(0)), (1, 1, "extract", 2, "succeeded", None, at(1)), (1, 1, "clean", 1, "failed", "ExtractionFailedError", at(2)),
            (2, 1, "extract", 4, "failed", "TimeoutError", at(0)), (3, 1, "extract", 1, "succeeded", None, at(0)), (3, 1, "clean", 1, "succeeded", None, at(1)), (3, 1, "chunk", 1, "succeeded", None, at(2))]
    df = spark.createDataFrame(rows, "doc_id long, doc_version int, stage string, attempt int, status string, cause string, ts timestamp_ntz")
    jobs = J.job_ledger(df)
    got = {r.doc_id: (r.resume_stage, r.failing_stage) for r in J.resume_points(jobs).collect()}
    assert got == {1: ("clean", "clean"), 2: ("extract", "extract"), 3: ("chunk", "extract")}
    retry = {(r.doc_id, r.stage, r.attempt): (r.next_due, r.dead_letter) for r in J.retry_schedule(df).collect()}
    assert retry == {(1, "extract", 1): (at(seconds=30), False), (1, "clean", 1): (at(2, 30), False), (2, "extract", 4): (None, True)}
    failed = {(r.doc_id, r.stage): (r.retryable, r.message == J.HIDDEN_MESSAGE) for r in J.failures(jobs).collect()}
    assert failed == {(1, "clean"): (False, False), (2, "extract"): (True, True)}


def test_status_moves(spark):
    rows = [(1, s, at(i)) for i, s in enumerate(["uploaded", "parsing", "chunked", "embedding", "ready", "uploaded"])] + [(2, "uploaded", at(0)), (2, "failed", at(3)), (2, "parsing", at(4))]
    got = [(r.doc_id, r.to_status, r.legal, r.progress) for r in J.status_moves(spark.createDataFrame(rows, "doc_id long, status string, ts timestamp_ntz")).orderBy("doc_id", "ts").collect()]
    assert got == [(1, "parsing", True, 20), (1, "chunked", False, 60), (1, "embedding", True, 80), (1, "ready", True, 100), (1, "uploaded", True, 0), (2, "failed", True, 0), (2, "parsing", False, 20)]


def test_purge_leaves_other_statuses_alone(spark):
    docs = spark.createDataFrame([(1, "ready", 2), (2, "failed", 2)], "doc_id long, status string, doc_version int")
    chunks = spark.createDataFrame([(10, 1, 1, True), (11, 1, 2, False), (20, 2, 1, True)], "chunk_id long, doc_id long, doc_version int, superseded boolean")
    assert [r.chunk_id for r in S.purgeable_chunks(chunks, docs).collect()] == [10]
    assert [r.chunk_id for r in S.active_chunks(chunks, docs).collect()] == [11]
    ids = spark.createDataFrame([(2,), (2,)], "doc_id long")
    assert {r.doc_id: (r.doc_version, r.status) for r in S.reingest_documents(docs.withColumn("updated_at", F.lit(None).cast("timestamp_ntz")), ids, F.lit(at(5))).collect()} == {1: (2, "ready"), 2: (3, "uploaded")}
    assert S.supersede_chunks(chunks, ids).filter("superseded").count() == 2


def test_embedding_helpers(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "chunk_id long, vector array<float>")
    assert sorted(map(tuple, E.wrong_dimensions(vectors, 2).collect())) == [(2, 1), (3, 0)]
    with pytest.raises(Exception, match="wrong number of dimensions"):
        E.require_dimensions(vectors, 2).collect()
    assert E.require_dimensions(vectors.filter("chunk_id = 1"), 2).count() == 1
    chunks = spark.createDataFrame([(i, f"text {i % 3}") for i in range(200)], "chunk_id long, content string")
    from marginalia.functions.vectors import half_precision, hash_embedding
    found = {r.content: r.vector for r in E.embed_batches(chunks, E.word_model(40)).collect()}
    assert len(found) == 3 and all(abs(sum(x * x for x in v) - 1) < 1e-6 for v in found.values())
    odd = spark.createDataFrame([(1, "a a b"), (2, ""), (3, " \t")], "chunk_id long, content string")
    made = {r.chunk_id: sorted(x for x in r.vector if x) for r in E.embed_batches(odd, E.word_model(40)).collect()}
    assert [round(x, 6) for x in made[1]] == [0.447214, 0.894427] and made[2] == made[3] == []
    calls = spark.sparkContext.accumulator(0)
    def counted(once):
        assert once.count() == 3
        return once.withColumn("vector", hash_embedding(F.col("content"), 8))
    assert E.embed_distinct(chunks, counted).count() == 200
    halves = spark.createDataFrame([([0.1, 1.0, -2.5],), (None,)], "v array<float>").select(half_precision(F.col("v")).alias("h")).collect()
    assert [round(x, 6) for x in halves[0].h] == [0.099976, 1.0, -2.5] and halves[1].h is None
    assert calls.value == 0


def test_memory_window_limits_before_it_filters(spark):
    rows = [(i, 1, "weird" if i == 3 else "user", "" if i in (6, 7) else f"m{i}", at(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "message_id long, conversation_id long, role string, content string, created_at timestamp_ntz")
    got = memory_window(df, spark.createDataFrame([(8,)], "message_id long"), 6).orderBy("position").collect()
    assert [(r.position, r.message_id, r.role) for r in got] == [(1, 3, "user"), (2, 4, "user"), (3, 5, "user")]
    long = df.withColumn("content", F.repeat(F.lit("x"), 1000))
    windows, overflow = memory_overflow(long, spark.createDataFrame([(1, 1, 0)], "conversation_id long, version int, upto_message_id long"))
    assert windows.first()["window"] == 6 and overflow.count() == 0


def test_answers_and_resume(spark):
    rows = [(1, 2, "delta", "b", at(0)), (1, 1, "delta", "a", at(0)), (1, 3, "stopped", None, at(1)), (2, 1, "delta", "x", at(9)), (3, 1, "error", None, at(9))]
    df = spark.createDataFrame(rows, "message_id long, seq int, type string, text string, ts timestamp_ntz")
    assert {r.message_id: (r.content, r.status) for r in A.answers_from_events(df).collect()} == {1: ("ab", "interrupted"), 2: ("x", "streaming"), 3: ("", "failed")}
    events, gone = A.resume_events(df, 0, F.lit(at(6)))
    assert {r.message_id for r in gone.collect()} == {1} and {r.message_id for r in events.collect()} == {2, 3}


def test_recency_groups_and_title_search(spark):
    now = F.lit(at(600, day=31))
    rows = [(1, True, at(0)), (2, False, None), (3, False, at(0, day=31)), (4, False, at(1439, day=30)), (5, False, at(0, day=24)), (6, False, at(0, day=1)), (7, False, at(0) - (at(1440) - at(0)))]
    df = spark.createDataFrame([(*r, f"T{r[0]} About") for r in rows], "conversation_id long, pinned boolean, last_message_at timestamp_ntz, title string")
    assert [(r.label, r.n) for r in V.recency_groups(df, now).collect()] == [("已釘選", 1), ("今天", 2), ("昨天", 1), ("前 7 天", 1), ("前 30 天", 1), ("更早", 1)]
    assert V.title_search(df, " aBOUT").count() == 7 and V.title_search(df, "  ").count() == 7 and V.title_search(df, "t3 ").count() == 1


def test_one_tenant_is_untouched_by_another(spark):
    tenants = spark.createDataFrame([("a", "{}"), ("b", "not json")], "tenant_id string, settings string")
    good, bad = I.split_rows(tenants, F.when(F.try_parse_json("settings").isNull(), "broken"))
    assert [r.tenant_id for r in good.collect()] == ["a"] and [(r.tenant_id, r.problem) for r in bad.collect()] == [("b", "broken")]
    alone = Q.limits(tenants.filter("tenant_id = 'a'"), "documents:1")
    both = Q.limits(tenants, "documents:1").filter("tenant_id = 'a'")
    assert sorted(map(str, alone.collect())) == sorted(map(str, both.collect()))
