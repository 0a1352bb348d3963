import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marginalia.functions.shared import TopHits, spread_of
from marginalia.functions.vectors import hash_embedding
from marginalia.operators import citations as A
from marginalia.operators import context as P
from marginalia.operators import graph as G
from marginalia.operators import lexical as L
from marginalia.operators import retrieve as R
from tests.conftest import at


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 8))
    vectors[50:90] = vectors[7]  # a group of copies
    rows = [(int(i), f"kb{i % 3}", "t" if i % 10 else "u", v.tolist()) for i, v in enumerate(vectors)]
    asked = [(1000 + i, "t" if i % 4 else "u", rng.normal(size=8).tolist()) for i in range(40)] + [(2000, "t", vectors[7].tolist())]
    return (
        spark.createDataFrame(asked, "query_id long, tenant_id string, vector array<double>"),
        spark.createDataFrame(rows, "chunk_id long, kb_id string, tenant_id string, vector array<double>"),
        asked, rows,
    )


def brute(asked, rows, k):
    out = set()
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for q, tenant, vector in asked:
        for kb in {r[1] for r in rows}:
            scored = sorted((-round(float(unit(vector) @ unit(r[3])), 9), r[0]) for r in rows if r[1] == kb and r[2] == tenant)
            out |= {(q, kb, c, rank + 1) for rank, (_, c) in enumerate(scored[:k])}
    return out


def test_exact_search_by_every_route(spark, corpus, monkeypatch):
    queries, vectors, asked, rows = corpus
    monkeypatch.setattr(R, "SCORE_DIGITS", 9)
    want = brute(asked, rows, 5)
    found = lambda: {(r.query_id, r.kb_id, r.chunk_id, r["rank"]) for r in R.nearest_chunks(queries, vectors, 5).collect()}
    assert found() == want
    monkeypatch.setattr(R, "BLOCK_QUESTIONS", 3)
    assert found() == want
    monkeypatch.setattr("marginalia.functions.shared.KEPT_ROWS", 20)  # hits are pruned and handed on early
    assert found() == want


def test_hits_handed_on_do_not_grow_with_the_vectors_files(spark, corpus, monkeypatch):
    """However many tasks the vectors come from, a question hands on k hits a base, here from one part."""
    queries, vectors, _, _ = corpus
    monkeypatch.setattr(R, "W", type("Spy", (), {"partitionBy": staticmethod(lambda *a: type("O", (), {"orderBy": staticmethod(lambda *b: None)}))}))
    monkeypatch.setattr(R.F, "row_number", lambda: type("N", (), {"over": staticmethod(lambda w: F.lit(1))}))
    found = R.nearest_chunks(queries, vectors.repartition(23, "chunk_id"), 5).groupBy("query_id", "kb_id").count()
    assert found.agg(F.max("count")).first()[0] == 5


def test_best_rows_are_those_of_a_sort():
    """Offered in pieces, with ties and scores that are none, the best of each question are kept."""
    rng = np.random.default_rng(4)
    scores, ids = rng.integers(-1, 6, (700, 30)).astype(float), rng.permutation(700)
    scores[scores < 0] = -np.inf
    scores[:, 3] = -np.inf
    top = TopHits(30, 9, 6, 0.0)
    for at in range(0, 700, 60):
        top.offer(scores[at:at + 60], ids[at:at + 60])
    got = sorted(zip(*(x.tolist() for x in top.best())))
    want = [(q, int(i), s) for q in range(30) for s, i in sorted(((s, i) for s, i in zip(scores[:, q], ids) if s >= 0), key=lambda x: (-x[0], x[1]))[:9]]
    assert got == sorted(want)


def test_few_questions_are_dealt_with_parts_of_what_is_searched():
    assert spread_of(10, 1000, 8, 64, 100) == (5, 2)
    assert spread_of(1, 10**6, 8, 64, 100) == (1, 8)
    assert spread_of(10**6, 10**6, 8, 16_384, 100) == (62, 1)
    assert spread_of(0, 0, 8, 64, 100) == (1, 1)


def test_no_questions_give_no_hits(corpus):
    queries, vectors, _, _ = corpus
    assert R.nearest_chunks(queries.filter("query_id < 0"), vectors, 3).count() == 0


def _hits(df):
    return sorted((r.query_id, r.kb_id, r.chunk_id, r["rank"], r.score) for r in df.collect())


def test_graph_search(spark, corpus, monkeypatch):
    """All parts opened wholly are the exact search; narrower ones find most; the width is found by measuring."""
    queries, vectors, _, _ = corpus
    exact = R.nearest_chunks(queries, vectors, 5)
    graph = G.build_graph(vectors, part=40)
    assert graph.agg(F.max("nodes")).first()[0] < 80 and graph.count() > 6
    assert _hits(G.graph_chunks(queries, graph, 5, 500)) == _hits(exact)
    narrow = R.recall(exact, G.graph_chunks(queries, G.build_graph(vectors), 5, 12)).agg(F.avg("recall")).first()[0]
    assert narrow > 0.8
    ef, measured = G.width_for_recall(queries, vectors, graph, 5, target=1.0, sample=10)
    assert measured == 1.0 and ef <= 128
    monkeypatch.setattr(G, "BLOCK", 7)
    assert _hits(G.graph_chunks(queries, graph, 5, 500)) == _hits(exact)
    clash = queries.selectExpr("*", "1 as part", "2 as block", "'x' as kb_id")
    assert _hits(G.graph_chunks(clash, graph, 5, 500)) == _hits(exact)
    assert G.graph_chunks(queries.limit(0), graph, 5, 10).count() == 0
    assert G.approximate_chunks(queries, vectors.limit(0), 5).count() == 0
    keyless = vectors.withColumn("tenant_id", F.lit(None).cast("string"))
    assert G.build_graph(keyless).count() == 0


def test_graphs_are_searched_after_other_functions_ran(spark, corpus):
    """Tasks carry what they call, not whole modules: a pandas function of ``retrieve`` in use cannot be pickled."""
    queries, vectors, _, _ = corpus
    seam = spark.createDataFrame([(1, 7, 0, "ab"), (1, 7, 1, "bc")], "query_id long, doc_id long, seq int, content string")
    assert R.merge_adjacent(seam).first()["passage"] == "abc"
    assert G.approximate_chunks(queries, vectors, 5).count() > 0


def test_a_wide_beam_compares_all():
    rng = np.random.default_rng(9)
    stored, asked = rng.normal(size=(900, 12)), rng.normal(size=(20, 12))
    unit, asked = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (stored, asked))
    _, score = G.beam_search(asked, unit, G.neighbour_links(unit), np.arange(0, 900, 16), 40)
    assert score.shape == (20, 900) and np.allclose(score, asked @ unit.T)


def test_questions_near_stored_vectors_are_found_by_a_few_steps():
    """Clustered vectors: a beam far narrower than the graph finds nearly all, and meets few of the vectors."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 24))
    stored = centres[rng.integers(0, 60, 4000)] + 0.4 * rng.normal(size=(4000, 24))
    unit = stored / np.linalg.norm(stored, axis=1, keepdims=True)
    links = G.neighbour_links(unit)
    assert links.shape == (4000, 32) and (links[:, 0] >= 0).all() and links.max() < 4000
    assert all(i not in row for i, row in enumerate(links))
    asked = stored[::40] + 0.2 * rng.normal(size=(100, 24))
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    place, score = G.beam_search(asked, unit, links, np.arange(0, 4000, 16), 64)
    near = asked @ unit.T
    want = np.argsort(-near, axis=1)[:, :10]
    found = [len(set(w) & set(p)) for w, p in zip(want, place)]
    assert np.mean(found) >= 9.5
    assert np.allclose(np.take_along_axis(near, place, axis=1), score)


def test_links_lead_in_different_directions():
    """Of two clusters of near copies, a vector links to its own and, by the choice of directions, to the other."""
    rng = np.random.default_rng(8)
    one, two = np.array([1.0, 0, 0]), np.array([0, 1.0, 0])
    stored = np.concatenate([one + 0.01 * rng.normal(size=(30, 3)), two + 0.01 * rng.normal(size=(30, 3))])
    unit = stored / np.linalg.norm(stored, axis=1, keepdims=True)
    links = G.neighbour_links(unit, m=4, candidates=59)
    across = [(row[row >= 0] >= 30).any() for row in links[:30]]
    assert any(across)
    assert (G.neighbour_links(unit[:1]) == -1).all()


def test_exact_text_ranks_first(spark):
    docs = spark.createDataFrame([(i, "kb", "t", f"text {i}") for i in range(50)], "chunk_id long, kb_id string, tenant_id string, content string")
    vectors = docs.withColumn("vector", hash_embedding(F.col("content"), 48))
    queries = vectors.select(F.col("chunk_id").alias("query_id"), "tenant_id", "vector")
    top = R.nearest_chunks(queries, vectors, 1).collect()
    assert len(top) == 50 and all(r.query_id == r.chunk_id and abs(r.score - 1) < 1e-9 for r in top)


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, kb_id string, chunk_id long, score double, rank int")


def test_merge_keeps_first_occurrence_and_sorts_ids_as_text(spark):
    rows = [(1, "a", 9, 0.2, 1), (1, "b", 9, 0.9, 1), (1, "b", 10, 0.2, 2), (1, "b", 3, 0.5, 3)]
    merged = R.merge_candidates(hits(spark, rows), F.col("kb_id")).orderBy("merged_rank").collect()
    assert [(r.chunk_id, r.score) for r in merged] == [(3, 0.5), (10, 0.2), (9, 0.2)]


@pytest.mark.parametrize("scores, ratio, kept", [
    ([0.9, 0.8, 0.1], 0.0, 3), ([0.9, 0.8, 0.1], 0.8, 2), ([0.9, 0.8], 1.0, 1), ([-0.2, -0.3], 0.8, 2), ([0.0, -1.0], 0.5, 2),
])
def test_score_gate(spark, scores, ratio, kept):
    ranked = spark.createDataFrame([(1, i, s, i + 1) for i, s in enumerate(scores)], "query_id long, chunk_id long, score double, merged_rank int")
    assert R.score_gate(ranked, F.lit(ratio)).count() == kept


@pytest.mark.parametrize("tokens, budget, chunks, kept", [
    ([10, 10, 10], 25, 8, 2), ([100, 1], 25, 8, 1), ([10, 20, 1], 25, 8, 1), ([1, 1, 1], 25, 2, 2), ([10, 15], 25, 8, 2),
])
def test_context_stops_at_the_first_overflow(spark, tokens, budget, chunks, kept):
    ranked = spark.createDataFrame([(1, i, 1.0 - i / 10, i + 1, t) for i, t in enumerate(tokens)], "query_id long, chunk_id long, score double, merged_rank int, tokens int")
    assert R.select_context(ranked, max_chunks=chunks, token_budget=budget).count() == kept


def test_history_counts_turns_before_blanks_are_dropped(spark):
    rows = [(i, 1, "user", text, at(i)) for i, text in enumerate(["first", "  ", "third", "fourth"])] + [(9, 1, "assistant", "x", at(2, 30))]
    df = spark.createDataFrame(rows, "message_id long, conversation_id long, role string, content string, created_at timestamp_ntz")
    got = {r.message_id: r.search_query for r in R.search_queries(df, 1).collect()}
    assert got == {0: "first", 1: "first", 2: "third", 3: "third\nfourth"}
    assert {r.search_query for r in R.search_queries(df, 0).collect()} == {"first", "", "third", "fourth"}


def test_lexical_blocks_agree(spark, monkeypatch):
    queries = spark.createDataFrame([(i, f"common word{i % 5} rare{i}") for i in range(12)], "query_id long, question string")
    chunks = spark.createDataFrame([(i, f"Common word{i % 5}, text rare{i % 20} common") for i in range(60)], "chunk_id long, content string")
    rows = lambda: sorted(map(tuple, L.lexical_hits(queries, chunks, 4).collect()))
    one = rows()
    monkeypatch.setattr(L, "BLOCK_QUESTIONS", 5)
    assert rows() == one and len(one) == 48


def test_lexical_search_of_parts_is_plain_bm25(spark, monkeypatch):
    """Common and rare words, parts of the texts and blocks of questions, against sums in plain Python."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(40)]
    draw = lambda n: " ".join(rng.choice(words, n, p=np.arange(1, 41) / 820))
    texts, asked = {i: draw(rng.integers(0, 30)) for i in range(200)}, {i: draw(5) for i in range(30)}
    docs = {i: t.split() for i, t in texts.items()}
    average = sum(map(len, docs.values())) / len(docs)
    df = {w: sum(w in d for d in docs.values()) for w in words}

    def score(question, d):
        return round(sum(np.log(1 + (200 - df[w] + 0.5) / (df[w] + 0.5)) * d.count(w) * 2.2 / (d.count(w) + 1.2 * (0.25 + 0.75 * len(d) / average))
                         for w in question.split() if w in d), 6)

    want = set()
    for q, question in asked.items():
        best = sorted((-score(question, d), i) for i, d in docs.items() if set(d) & set(question.split()))[:7]
        want |= {(q, i, -s, rank + 1) for rank, (s, i) in enumerate(best)}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, question string")
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, content string")
    for block, part, common in ((4096, 16_384, 1 / 256), (3, 10, 0.5), (50, 10, 0.0)):
        monkeypatch.setattr(L, "BLOCK_QUESTIONS", block)
        monkeypatch.setattr(L, "PART_TEXTS", part)
        monkeypatch.setattr(L, "COMMON", common)
        got = {(r.query_id, r.chunk_id, round(r.bm25, 6), r["rank"]) for r in L.lexical_hits(queries, chunks, 7).collect()}
        assert got == want


def test_short_floats_decide_no_lexical_hit(spark):
    """Sums in short floats only leave out what cannot be found; scores and order come from full ones."""
    rng = np.random.default_rng(3)
    known, share = np.arange(40), np.linspace(0.5, 0.0001, 40)
    questions = pd.DataFrame({"query_id": range(9), "hash": [np.sort(rng.choice(40, 12, replace=False)) for _ in range(9)],
                              "w": [rng.random(12) * 9 for _ in range(9)]})
    which, words = np.nonzero(rng.random((70, 40)) < 0.4)
    factors = rng.random(len(which)) * 2
    plain = np.zeros((70, 9))
    for c, word, factor in zip(which, words, factors):
        for q in range(9):
            plain[c, q] += factor * dict(zip(questions["hash"][q], questions["w"][q])).get(word, 0.0)
    block = L._Block(questions, known, share)
    rough, full = block.scores(which, words, factors, 70)
    c, q = np.nonzero(plain)
    assert 0 < block.common < 40 and rough.dtype == np.float32
    assert (abs(rough - plain) <= block.error * plain).all() and abs(full(c, q) - plain[c, q]).max() < 1e-12

    sizes = {i: 60_000 + i * 7 % 90 for i in range(90)}  # scores that short floats do not tell apart
    chunks = spark.createDataFrame([(i, "a " + "x " * (n - 1)) for i, n in sizes.items()], "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "a b")], "query_id long, question string")
    found = [r.chunk_id for r in L.lexical_hits(asked, chunks, 30).orderBy("rank").collect()]
    idf, average = np.log(1 + 0.5 / 90.5), sum(sizes.values()) / 90
    score = lambda n: round(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * n / average)), 9)
    assert found == sorted(sizes, key=lambda i: (-score(sizes[i]), i))[:30]


def test_words_of_one_hash_get_another_seed(spark, monkeypatch):
    true_hash = F.xxhash64
    monkeypatch.setattr(L.F, "xxhash64", lambda word, seed: F.when(seed < 2, F.lit(7)).otherwise(true_hash(word, seed)))
    seed, hashed = L._hashed(spark.createDataFrame([("a",), ("b",)], "term string"))
    assert seed == 2 and hashed.select("hash").distinct().count() == 2


def test_what_has_no_text_or_vector_is_not_found(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, None), (3, "b c")], "chunk_id long, content string")
    asked = spark.createDataFrame([(7, "b"), (8, None)], "query_id long, question string")
    assert [(r.query_id, r.chunk_id) for r in L.lexical_hits(asked, texts, 5).orderBy("chunk_id").collect()] == [(7, 1), (7, 3)]
    vectors = spark.createDataFrame([(1, "k", "t", [1.0, 0.0]), (2, "k", "t", None)], "chunk_id long, kb_id string, tenant_id string, vector array<double>")
    queries = spark.createDataFrame([(7, "t", [1.0, 0.0]), (8, "t", None)], "query_id long, tenant_id string, vector array<double>")
    for found in (R.nearest_chunks(queries, vectors, 5), G.approximate_chunks(queries, vectors, 5)):
        assert [(r.query_id, r.chunk_id, r.score) for r in found.collect()] == [(7, 1, 1.0)]


def test_citations_unmatched_and_repeated(spark):
    answers = spark.createDataFrame([(1, 5, "a [c:2] b [c:9] [c:2] [c:01] [c:9] [c:1] [c:]"), (2, 5, "plain")], "message_id long, conversation_id long, content string")
    context = spark.createDataFrame([(5, 1, 11, "x" * 300), (5, 2, 12, " y ")], "conversation_id long, n int, chunk_id long, content string")
    lists = A.citations(answers, context)
    assert [(r.n, r.marker, r.chunk_id) for r in A.citation_rows(lists).orderBy("n").collect()] == [(1, "2", 12), (2, "1", 11)]
    assert lists.first()["dropped"] == ["9", "01"]
    segments = A.answer_segments(answers.withColumn("content", F.concat("content", F.lit(" end [c:2"))), lists).filter("message_id = 1").orderBy("segment_no").collect()
    assert [(s.kind, s.text, s["index"]) for s in segments] == [
        ("text", "a ", None), ("citation", "2", 1), ("text", " b ", None), ("text", " ", None), ("citation", "2", 1), ("text", " ", None),
        ("text", " ", None), ("text", " ", None), ("citation", "1", 2), ("text", " [c:] end ", None),
    ]


def test_context_block_text(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    rows = [(1, 2, f"b {P.END} c", "", None, []), (1, 1, "a", "f.pdf", 3, ["x", "y"])]
    chosen = spark.createDataFrame(rows, "query_id long, position int, content string, document_name string, page int, heading_path array<string>")
    got = {r.query_id: r.context for r in P.context_blocks(queries, chosen).collect()}
    assert got[2] == f"{P.START}\n{P.END}"
    assert got[1] == f"{P.START}\n[c:1] 來源：f.pdf 第 3 頁（x › y）\na\n\n[c:2] 來源：未命名文件\nb {P.DEFUSED} c\n\n{P.END}"


def test_adjacent_chunks_lose_the_repeated_seam(spark):
    rows = [(1, 7, 0, "alpha beta"), (1, 7, 1, "beta gamma"), (1, 7, 3, "delta"), (1, 8, 4, "delta more")]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, seq int, content string")
    got = {(r.doc_id, r.first_seq): r.passage for r in R.merge_adjacent(df).collect()}
    assert got == {(7, 0): "alpha beta gamma", (7, 3): "delta", (8, 4): "delta more"}


def test_border_is_the_longest_common_seam():
    import random
    import time

    draw = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(draw.choice("ab𝄞") for _ in range(draw.randrange(12))) for _ in range(2))
        assert R.border(a, b) == max(n for n in range(min(len(a), len(b)) + 1) if a[len(a) - n:] == b[:n])
    start = time.perf_counter()
    assert R.border("x" + "ab" * 50_000, "ab" * 50_000 + "c") == 100_000
    assert R.border("a" * 100_000 + "c", "a" * 100_000 + "b") == 0
    assert time.perf_counter() - start < 1


def test_seams_of_odd_texts(spark):
    rows = [(1, 7, 0, None), (1, 7, 1, "a"), (1, 7, 2, ""), (1, 7, 3, "b" * 100_000), (1, 7, 4, "b" * 100_000 + "c")]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, seq int, content string")
    assert [r.passage for r in R.merge_adjacent(df).collect()] == ["a" + "b" * 100_000 + "c"]
    assert R.merge_adjacent(df.limit(0)).count() == 0


def test_prompt_in_force(spark):
    prompts = spark.createDataFrame([
        ("own", "a", "k", 1, None), ("sys", None, "k", 5, None), ("sys2", None, "j", 6, None), ("gone", "a", "j", 7, at(0)),
    ], "prompt_id string, tenant_id string, key string, active_version_id long, deleted_at timestamp_ntz")
    versions = spark.createDataFrame([(1, "own", "draft", 1, "mine"), (2, "own", "published", 2, "newer"), (5, "sys", "published", 1, "shared"), (6, "sys2", "published", 4, "j!")],
                                     "version_id long, prompt_id string, status string, version int, template string")
    wanted = spark.createDataFrame([("a", "k"), ("b", "k"), ("a", "j"), ("b", "nope")], "tenant_id string, key string")
    got = {(r.tenant_id, r.key): r.template for r in P.active_prompts(wanted, prompts, versions).collect()}
    assert got == {("b", "k"): "shared", ("a", "j"): "j!"}


def test_hits_are_checked_without_a_vector_a_hit(spark, monkeypatch):
    """Wrong scores, hits out of order, ids that repeat, vectors and ids that are missing; no vector is shuffled with a hit."""
    monkeypatch.setattr(R, "PAIRS", 2)
    vectors = spark.createDataFrame(
        [(1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [1.0, 1.0]), (3, [1.0, -1.0]), (4, None), (5, [1.0, None]), (6, [1.0, 1.0, 1.0]), (None, [1.0, 0.0])],
        "chunk_id long, vector array<float>")
    queries = spark.createDataFrame(
        [(1, [5.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, 0.0]), (None, [1.0, 0.0])], "query_id long, vector array<double>")
    half = 0.5 ** 0.5
    found = spark.createDataFrame([
        (1, "a", 1, 1.0, 1), (1, "a", 2, 0.5, 2), (1, "a", 3, half, 3), (1, "b", 4, 9.0, 1), (1, "b", 5, 8.0, 2), (1, "b", 6, 8.5, 3),
        (2, "a", 2, 1.0, 1), (2, "a", 3, half, 2), (2, "b", 1, 0.5, 1), (3, "a", 1, 0.5, 1), (4, "a", 77, 0.5, 1), (4, "a", None, 0.5, 2),
        (1, "c", 1, 1.0, 1), (1, "c", 77, 0.1, 2), (1, "c", 2, 0.0, 3), (5, "a", 1, 1.0, 1), (None, "a", 1, 1.0, 1),
    ], "query_id long, kb_id string, chunk_id long, score double, rank int").repartition("query_id")
    checked = R.check_hits(found, queries, vectors)
    plan = checked._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1]
    assert plan.count("Exchange") == 2  # the hits by question, and the questions' vectors
    # question 2 stands there twice: chunk 3's second vector and chunk 1 are wrong for both copies
    assert sorted(map(tuple, checked.collect())) == [(1, 1, 2, True), (2, 4, 0, True), (3, 0, 0, True)]


def test_hits_are_shuffled_once_until_they_are_merged(spark):
    """Ranks of a base and the merged order both lie by question."""
    rows = [(i, "t", "kb" + str(i % 2), [float(i), 1.0]) for i in range(6)]
    stored = spark.createDataFrame(rows, "chunk_id long, tenant_id string, kb_id string, vector array<double>")
    asked = stored.filter("chunk_id < 3").select(F.col("chunk_id").alias("query_id"), "tenant_id", "vector")
    merged = R.merge_candidates(R.nearest_chunks(asked, stored, 2), F.col("kb_id"))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and plan.split("MapInPandas")[0].count("Exchange") == 1
    assert merged.count() == 12
