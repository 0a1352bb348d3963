"""The parity-sketch join against all pairs compared one by one, and the sketch against the sets it stands for."""

import numpy as np
import pytest

from marginalia.llm import parity
from tests.conftest import DATA
from tests.llm.test_near import brute as all_pairs


def brute(rows, size, percent=80):
    return sorted(((d, n, c) for d, n, c, _ in all_pairs(rows, size, percent)), key=repr)


def found(df, size, percent=80):
    got = parity.similar_documents(df, size=size, percent=percent).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr)


def _sets(rng, n, m, common):
    x = rng.integers(0, 2**64, n + m - common, dtype=np.uint64)
    return np.sort(x[:n]), np.sort(x[n - common :])


@pytest.mark.parametrize("size", [2, 5])
def test_table(spark, size):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    assert found(df, size) == brute([(r.doc_id, r.text) for r in df.collect()], size)


def test_sketches_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(1)
    for n, m, common in ((5, 6, 5), (100, 120, 95), (1000, 900, 850), (3000, 3000, 0)):
        a, b = _sets(rng, n, m, common)
        apart = n + m - 2 * common
        for bits in (512, 2048):
            differ = int(np.bitwise_count((parity.folded(a, bits) ^ parity.folded(b, bits)).view(np.uint64)).sum())
            assert differ <= apart and differ % 2 == apart % 2
        halves = parity.folded(a, 2048).reshape(2, -1)
        assert (halves[0] ^ halves[1] == parity.folded(a, 1024)).all()
        level = parity.band(n)
        keys = [set(parity.sketch_words(s, level, 80)[0].tolist()) for s in (a, b)]
        assert max(len(keys[0] - keys[1]), len(keys[1] - keys[0])) <= apart


def test_a_bit_toggled_twice_is_gone():
    one, other = np.uint64(7 << 33), np.uint64((7 << 33) | 5)
    same_bit = one | np.uint64(1 << 60)
    keys, starts = parity.sketch_words(np.array([one, other]), 0, 80)
    assert len(keys) == 1 and len(starts) == 1
    assert not parity.folded(np.array([one, one]), 512).any() and parity.folded(np.array([one, same_bit]), 512).any()


@pytest.mark.parametrize("percent", [60, 70, 80, 95])
def test_rarest_segments_of_similar_sets_meet(percent):
    """Pairs just at the similarity, of all sizes around the edges of bands, with common shingles put last."""
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.choice([3, 4, 5, 9, 30, 60, 63, 64, 79, 80, 120, 128, 150, 255, 256, 300, 500, 900, 2100]))
        m = int(rng.integers(n, n * 100 // percent + 1))
        common = -(-(n + m) * percent // (100 + percent))
        if common > n:
            continue
        a, b = _sets(rng, n, m, common)
        often = np.sort(rng.choice(np.concatenate([a, b]), 40))
        often = np.unique(often)
        seen = rng.integers(1, 9, len(often))
        keys = []
        for s in (a, b):
            count, level = parity.reach(len(s), percent) + 1, parity.band(len(s))
            both = set(parity.rare_first(s, level, percent, often, seen, count).tolist())
            if level and len(s) * percent <= 100 * ((parity.FIRST_BAND << (level - 1)) - 1):
                both |= set(parity.rare_first(s, level - 1, percent, often, seen, count).tolist())
            keys.append(both)
        assert keys[0] & keys[1] or n == m == common


def test_families(spark):
    """Chains, families around one text, passages in common, sizes across the edge of a band, and crowds."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    base = [word() for _ in range(70)]
    rows = []
    for i in range(90):
        text = list(base)
        for k in rng.choice(70, rng.integers(0, 14), replace=False):
            text[k] = word()
        rows.append((i, " ".join(text)))
    for i in range(60):
        rows.append((100 + i, " ".join(base + [word() for _ in range(rng.integers(0, 40))])))
    chain = [word() for _ in range(60)]
    for i in range(15):
        chain = chain[2:] + [word(), word()]
        rows.append((200 + i, "\n".join(chain)))
    short = [word() for _ in range(6)]
    for i in range(100):  # a crowd of short texts that share most, but not enough
        rows.append((300 + i, " ".join([*short, word(), word()])))
    rows += [(500 + i, rows[i][1]) for i in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for size in (1, 2):
        assert found(df, size) == brute(rows, size)


def test_shuffled_texts(spark, monkeypatch):
    monkeypatch.setattr(parity, "SENT", 0)
    test_families(spark)


def test_repeated_rows_and_ids(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two"), (7, "ONE  two"), (7, "ONE  two"),
        (8, "éa b c"), (8, "x y"), (9, "ÉA b c"), (10, "x y z"), (None, "one two"), (None, None), (11, "X Y"), (12, "x y"), (12, ""),
    ]
    long = [f"m{i}" for i in range(40)]
    rows += [(30, " ".join(long)), (30, ""), (31, " ".join([*long[:38], "x", "y"])), (31, " ".join([*long[:38], "x", "y"])), (31, "q r")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = df.selectExpr("*", "1 as n", "'x' as component_id", "2 as bucket", "3 as node")
    assert found(clash, 2) == brute(rows, 2)
    assert found(df.limit(0), 2) == []
    with pytest.raises(ValueError):
        found(df, 2, 50)


def test_long_text(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, "q" * 2_500_000)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    assert [(r[0], r[2]) for r in got] == [(1, 1), (2, 1), (3, 3)]


def test_hubs_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(parity, "HUB", 3)
    many = spark.createDataFrame([(i % 4, i) for i in range(40)] + [(9, 1), (None, 2)], "k long, x long")
    one = spark.createDataFrame([(i, i * 10) for i in range(12)], "k long, y long")
    got = sorted(tuple(r) for r in parity.dealt_join(many, one, "k").select("k", "x", "y").collect())
    assert got == sorted([(i % 4, i, i % 4 * 10) for i in range(40)] + [(9, 1, 90)])


def test_common_shingles_are_counted_without_copies(spark):
    rows = [(i, "the same copy here") for i in range(50)] + [(100 + i, f"shared passage of words {i}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    counted = df.mapInArrow(parity._counted(2), parity._DOCS).filter("shingle is not null").collect()
    assert sorted(r.seen for r in counted) == [9, 9, 9]
