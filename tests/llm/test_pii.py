"""Certain spans against plain patterns; trees against the fitted model; added spans."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from marginalia.llm import pii, queries
from marginalia.session import materialise
from tests.conftest import DATA

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and _luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    spans = [
        (m.start(), k, m.end())
        for k, kind in enumerate(pii.KINDS) for m in re.finditer(PLAIN[kind], text or "") if _holds(kind, m[0])
    ]
    return sorted(spans)


def check(rows, got):
    want = sorted(((d, brute(t)) for d, t in rows), key=repr)
    assert sorted(((r.doc_id, [tuple(s) for s in r.certain]) for r in got), key=repr) == want


def test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op9_boosted_spans(spark, DATA).collect()}
    assert len(got) == len(rows)
    for d, text in rows:
        spans = brute(text)
        joined = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans]
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == n for s in spans) for n in range(4)]
        assert got[d].base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(got[d].spans.split(","))


def test_random_texts(spark):
    rng = random.Random(8)
    pieces = ["a@b.c", "@", ".", "-", " ", "+", "(", ")", "1", "23", "4539578763621486", "4539 5787-6362 1486", "256",
              "1.2.3.4", "é", "日", "x_y%", "+1 (017) 555-7713", "_", "b..c", "😀", "0", "\n", "0001.2.3.255", "a.b-c@d-e.f-g"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))) for i in range(1500)]
    rows += [(None, "q@w.e"), (7, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as certain", "2 as h", "3 as label")
    check(rows, pii.personal_data(df).collect())


def test_phones_with_digits_far_apart(spark):
    """Any number of signs may stand between the digits of a certain phone number."""
    rng = random.Random(3)
    gaps = ["", " ", " - ", "   ", ") (", "....", "-"]
    rows = [(1, "+44 - 20 - 79 - 46 - 09 - 58"), (2, "call +12   34   56   78   90 now")]
    rows += [(10 + i, "x +1" + "".join(rng.choice(gaps) + rng.choice("0123456789") for _ in range(rng.randint(6, 16)))) for i in range(300)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, got)
    assert {r.doc_id: len(r.certain) for r in got if r.doc_id < 10} == {1: 1, 2: 1}


def test_long_runs_need_no_stack_and_no_second_try(spark):
    rows = [(1, "1" * 300_000), (2, "1 " * 150_000), (3, "a@" + "b." * 150_000 + "c"), (4, "a" * 300_000), (5, "1." * 150_000),
            (6, "+1" + "(" * 300_000), (7, "-1" * 100_000)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id: len(r.certain) for r in got}
    assert found == {1: 0, 2: 0, 3: 1, 4: 0, 5: 37_500, 6: 0, 7: 0}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_data(df).collect() == []


def _mails(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        name = "".join(rng.choice("abcdefg") for _ in range(6))
        serial = "".join(rng.choice("0123456789") for _ in range(16))
        rows.append((i, f"please mail {name}@host{i % 9}.org now, part {serial} or {i}.{i}.{i}.{i} ends"))
    rows += [(1000 + i, f"please mail jérôme{i}@host{i % 9}.org now") for i in range(40)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_added_spans(spark):
    rows, df = _mails(spark)
    got = pii.personal_data(df).collect()
    check(rows, got)
    texts = dict(rows)
    added = {texts[r.doc_id][s.start : s.end] for r in got for s in r.added}
    assert all("@" in a for a in added)


def test_a_candidate_at_its_threshold_is_selected(spark):
    """Thresholds are not above the scores they were taken from: some certain candidate of each kind reaches its own."""
    rows, df = _mails(spark)
    model = pii.train(df)
    assert model.thresholds
    texts = df.select(F.coalesce("text", F.lit("")).alias("text"))
    spans = texts.select("text", pii.candidate_spans(F.col("text")).alias("c"))
    chosen = spans.select(F.explode(pii._selected(F.col("text"), F.col("c"), F.array().cast(
        "array<struct<start:int,kind:int,end:int>>"), model)).alias("s")).select("s.kind").distinct().collect()
    assert {pii.KINDS[r.kind] for r in chosen} == set(model.thresholds)


def test_all_documents_teach(spark, monkeypatch):
    """No document is left out, however many there are: the candidates of 30,000."""
    kept = {}
    monkeypatch.setattr(pii, "materialise", lambda df, name: kept.setdefault(name, materialise(df, name)))
    docs = spark.range(30_000).selectExpr("id as doc_id", "concat('mail a', id, '@b', id % 7, '.org') as text")
    pii.train(docs)
    assert kept["pii-candidates"].count() == 30_000
    assert kept["pii-candidates"].agg(F.sum("label")).first()[0] == 30_000


def test_documents_of_many_candidates_teach(spark, monkeypatch):
    """Those of over 200 candidates as well, and in time: one has 20,000 addresses, another 20,000 that are none."""
    kept = {}
    monkeypatch.setattr(pii, "materialise", lambda df, name: kept.setdefault(name, materialise(df, name)))
    rows = [(1, "mail a@b.cd " * 20_000), (2, "ip 1.2.3.999 " * 20_000), (3, "mail jérôme@b.cd, 1.2.3.4"), (4, None)]
    pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    got = kept["pii-candidates"].groupBy("kind", "label", "before", "after", "named").count().collect()
    # 0 nothing, 1 blank; all but the last follow a word that names them
    assert sorted(map(tuple, got)) == [
        (0.0, 1.0, 1.0, 1.0, 1.0, 20_000), (0.0, 1.0, 1.0, 4.0, 1.0, 1),
        (1.0, 0.0, 1.0, 1.0, 1.0, 20_000), (1.0, 1.0, 1.0, 0.0, 0.0, 1)]


def _overlap(a, b):
    return a[0] < b[2] and b[0] < a[2]


def test_best_of_overlapping_spans(spark):
    """Against a look at all pairs; spans of one kind never overlap."""
    rng = random.Random(6)
    rows = []
    for i in range(200):
        spans = []
        for kind in range(4):
            at = 0
            for _ in range(rng.randint(0, 9)):
                at += rng.randint(0, 6)
                end = at + rng.choice([1, 2, 3, 30])
                spans.append((at, kind, end, rng.choice([0.25, 0.5, 0.75])))
                at = end
        rows.append((i, spans))
    df = spark.createDataFrame(rows, "i long, s array<struct<start:int,kind:int,end:int,score:double>>")
    taken = pii._by_kind(F.col("s"))
    asked = F.struct(F.lit(10).alias("start"), F.lit(14).alias("end"))
    got = df.select("i", pii._best(F.col("s")).alias("b"), pii._let(taken, lambda k: F.array(
        *[pii._meets(asked, k[kind]) for kind in pii.KINDS])).alias("m")).collect()
    for r in got:
        spans = dict(rows)[r.i]
        rank = lambda s: (s[3], s[2] - s[0], -s[0], -s[1])
        assert [tuple(s) for s in r.b] == [c for c in spans if not any(_overlap(c, s) and rank(s) > rank(c) for s in spans)]
        assert list(r.m) == [any(s[1] == k and _overlap((10, 0, 14), s) for s in spans) for k in range(4)]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd or 1.2.3.4 now"), (2, None)], "doc_id long, text string")
    got = pii.redacted(df, pii.personal_data(df))
    assert {r.doc_id: r.text for r in got.collect()} == {1: "mail [email] or [ip] now", 2: None}


def test_expression_is_the_fitted_model(spark):
    tree = (0, 1.5, -1.0, (1, 0.0, 0.25, 1.0))
    model = pii.Trees([tree, 0.5], [1.0, 0.1], {})
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 0.0), (2.0, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(F.round(pii.probability(model, [F.col("a"), F.col("b")]), 6)).collect()]
    assert got == [0.130108, 0.645656, 0.890903]
