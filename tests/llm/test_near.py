"""Near-duplicate groups against all pairs compared one by one."""

import re
from collections import defaultdict

import numpy as np
import pytest

from marginalia.llm import near
from tests.conftest import DATA


def _set(text, size):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    n = min(size, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset()


def brute(rows, size, percent=80):
    """{(doc_id, text): (n_shingles, component, kept)}; rows: (doc_id, text)."""
    sets = [_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_id = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            by_id[d].append(i)
    for same in by_id.values():
        for i in same[1:]:
            parent[root(i)] = root(same[0])
    live = [i for i, (d, _) in enumerate(rows) if d is not None and sets[i]]
    holders = defaultdict(list)
    for i in live:
        for s in sets[i]:
            holders[s].append(i)
    for i in live:
        shared = defaultdict(int)
        for s in sets[i]:
            for j in holders[s]:
                if j < i:
                    shared[j] += 1
        for j, common in shared.items():
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(rows)):
        d = rows[i][0]
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(root(i)) if d is not None else None
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def found(df, size):
    got = near.near_duplicates(df, size=size).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr)


@pytest.mark.parametrize("size", [2, 5])
def test_table(spark, size):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    assert found(df, size) == brute([(r.doc_id, r.text) for r in df.collect()], size)


def test_families(spark):
    """Chains, families around one text, and texts that share a passage but not enough."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 4))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(40):
        text = list(base)
        for k in rng.choice(60, rng.integers(0, 9), replace=False):
            text[k] = word()
        rows.append((i, " ".join(text)))
    for i in range(40):
        rows.append((100 + i, " ".join(base + [word() for _ in range(rng.integers(0, 30))])))
    chain = [word() for _ in range(30)]
    for i in range(12):
        chain = chain[1:] + [word()]
        rows.append((200 + i, "\n".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, 2) == brute(rows, 2)


def test_repeated_rows_keep_links(spark):
    """A row that stands twice, or an id with several texts, must not shorten what is compared of a set."""
    pad = lambda name, n: [f"{name}{i}" for i in range(n)]
    rows = []
    for k in range(30):
        core, at = pad(f"c{k}x", 101), 10 * k
        # a chain of three: the outer ones agree with the middle one only
        for i, cut in enumerate((0, 9, 18)):
            rows += [(at + i, " ".join(core[cut:] + pad(f"t{k}y{i}z", cut)))] * 2
        rows += [(1000 + at, " ".join(core[5:] + pad(f"o{k}z", 5))), (1000 + at, " ".join(pad(f"q{k}z", 40)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, 2) == brute(rows, 2)


def test_rare_pairs_of_repeated_rows(spark):
    """Sets of 100 that agree in 89, first common element the twelfth rarest, no link from the star round."""
    sets = [(1, list(range(11)) + list(range(100, 189))), (2, list(range(20, 31)) + list(range(100, 189)))]
    docs = [(d, " ".join(f"w{i}" for i in s)) for d, s in sets] * 2
    frame = spark.createDataFrame(docs, "node long, text string")
    held = frame.mapInArrow(near._collect_sets(1), near._SETS).dropDuplicates(["node", "own"])
    nodes = spark.createDataFrame([(1, 1), (2, 2)], "node long, component long")
    assert [tuple(r) for r in near._rare_pairs(nodes, held, 80).collect()] == [(1, 2)]


def test_one_id_with_several_texts(spark):
    """Its texts are one document, also when another id has the class or a row has no words."""
    rows = [(3, "p q"), (8, "p q"), (8, "r s"), (9, "r s"), (8, None), (20, "u v"), (20, ""), (21, "u w"), (21, ""), (5, None)]
    long = [f"m{i}" for i in range(40)]
    rows += [(30, " ".join(long)), (30, ""), (31, " ".join(long[:34] + ["x", "y", "z", "q", "r", "s"])), (31, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, 2) == brute(rows, 2)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two"), (7, "ONE  two"), (7, "ONE  two"),
        (8, "éa b c"), (8, "x y"), (9, "ÉA b c"), (10, "x y z"), (None, "one two"), (None, None), (11, "X Y"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = df.selectExpr("*", "1 as n", "'x' as component_id", "2 as bucket", "3 as node")
    assert found(clash, 2) == brute(rows, 2)
    assert found(df.limit(0), 2) == []


def test_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, long), (2, long + " end"), (3, "q" * 2_500_000)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert [(r[0], r[2]) for r in got] == [(1, 1), (2, 1), (3, 3)]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    same = near.signature(a, 2000) == near.signature(b, 2000)
    assert abs(same.mean() - 800 / 1200) < 0.05
