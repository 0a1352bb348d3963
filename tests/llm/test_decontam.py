"""Benchmark windows against a plain search, word by word."""

import random
import re

import pytest

from marginalia.llm import decontam
from tests.conftest import DATA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def brute(docs, items, size=10):
    windows = {}
    for name, text in items:
        found = WORD.findall(_lower(text))
        n = min(size, len(found))
        for i in range(len(found) - n + 1 if n else 0):
            windows.setdefault(tuple(found[i : i + n]), set()).add("" if name is None else str(name))
    out = []
    for d, text in docs:
        at = list(WORD.finditer(_lower(text)))
        found, hit, own = [m[0] for m in at], set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(found) - n + 1):
                names = windows.get(tuple(found[i : i + n]))
                if names:
                    own |= names
                    hit |= set(range(i, i + n))
        spans = []
        for i in sorted(hit):
            if i - 1 in hit:
                spans[-1] = (spans[-1][0], at[i].end())
            else:
                spans.append((at[i].start(), at[i].end()))
        out.append((d, len(found), len(hit), sorted(own), spans))
    return sorted(out, key=repr)


def found(docs, items, **how):
    rows = decontam.benchmark_hits(docs, items, **how).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) for r in rows), key=repr)


@pytest.mark.parametrize("most", [400_000, 1000])
def test_table(spark, most):
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(docs, items, max_windows=most) == want
    assert any(r[2] for r in want)


def _tables(spark):
    rng = random.Random(3)
    words = ["a", "B", "é", "日本", "c3", "d"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "--", "\x00"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(80)] + [(None, "a B"), (1, ""), (2, None), (3, "!!"), (3, "!!")]
    items = [(i, text(rng.randint(2, 14))) for i in range(6)] + [(None, "é é é"), (6, ""), (7, None), (5, "d d d d")]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    return docs, items, frame(docs, "doc_id"), frame(items, "item_id")


@pytest.mark.parametrize("most", [400_000, 3])
def test_odd_rows(spark, most):
    docs, items, d, i = _tables(spark)
    clash = d.selectExpr("1 as n_hit", "2 as items", "3 as c0", "*")
    assert found(clash, i, size=3, max_windows=most) == brute(docs, items, 3)
    assert found(d, i.limit(0)) == brute(docs, [], 3)
    assert found(d.limit(0), i) == []


def test_removal(spark):
    docs, items, d, i = _tables(spark)
    hits = brute(docs, items, 3)
    clash = d.selectExpr("1 as n_hit", "'x' as c0", "*")
    left = decontam.remove_documents(clash, i, size=3)
    assert left.columns == clash.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted((h[0] for h in hits if not h[2]), key=repr)
    cut = decontam.remove_spans(clash, i, size=3)
    want = []
    spans = {}
    for h in hits:
        spans.setdefault((h[0], h[1]), h[4])
    for name, text in docs:
        at = spans[(name, len(WORD.findall(_lower(text))))]
        for s, e in reversed(at):
            text = text[:s] + text[e:]
        want.append((name, text))
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=repr) == sorted(want, key=repr)


def test_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(150_000, 150_020)))], "item_id long, text string")
    assert [r[:3] for r in found(docs, items)] == [(1, 300_000, 20)]
