"""Chunks of lines against plain Python."""

import hashlib
import random

import pytest

from marginalia.llm import lines


def _chunks(text, window, spread):
    rows = (text or "").split("\n")
    hashes = [int(hashlib.md5(r.encode()).hexdigest()[:8], 16) for r in rows]
    made, own = [], []
    for i, row in enumerate(rows):
        own.append(row)
        rolled = 0
        for h in hashes[max(0, i - window + 1) : i + 1]:
            rolled = (rolled * 1_000_003 + h) % 2_147_483_647
        if rolled % spread == 0 or i == len(rows) - 1:
            made.append(own)
            own = []
    return made


def brute(rows, window=2, spread=3, solid=2):
    """Rows: (doc_id, text), ids given; rows alike are one document."""
    first = {}
    for d, text in sorted(set(rows), key=lambda r: (r[0], r[1] or "")):
        for no, own in enumerate(_chunks(text, window, spread)):
            if sum(bool(x.strip(" ")) for x in own) >= solid:
                first.setdefault("\n".join(own), (d, no))
    out = []
    for d, text in rows:
        own = ["\n".join(c) for c in _chunks(text, window, spread)]
        cut = [c in first and first[c] != (d, no) for no, c in enumerate(own)]
        out.append((d, "\n".join(c for c, gone in zip(own, cut) if not gone), (text or "").count("\n") + 1, len(own), sum(cut)))
    return sorted(out, key=repr)


def found(df, **how):
    rows = lines.cut_repeated_lines(df, **how).collect()
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_chunks, r.n_cut) for r in rows), key=repr)


@pytest.mark.parametrize(("window", "spread"), [(2, 3), (1, 2), (4, 5), (3, 1)])
def test_shared_passages(spark, window, spread):
    rng = random.Random(window)
    passage = [f"shared line {i} é" for i in range(14)]
    rows = []
    for d in range(40):
        own = [f"own {d} {i}" if rng.random() < 0.8 else rng.choice(["", " ", "common"]) for i in range(rng.randint(0, 12))]
        at = rng.randint(0, len(own))
        rows.append((d, "\n".join(own[:at] + passage[rng.randint(0, 4) :] + own[at:]) if d % 2 else "\n".join(own)))
    got = found(spark.createDataFrame(rows, "doc_id long, text string"), window=window, spread=spread)
    assert got == brute(rows, window, spread)
    assert any(g[4] for g in got) or spread == 1


def test_odd_rows(spark):
    copy = "\n".join(f"line {i}" for i in range(9))
    rows = [(1, copy), (2, copy), (2, copy), (3, None), (4, ""), (5, "\n\n\n"), (6, copy + "\n" + copy), (7, "x\r\ny"),
            (8, "\n".join(f"long {i}" for i in range(30_000))), (9, "q" * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as no", "2 as key", "'x' as _cut")
    assert found(df) == brute(rows)
    assert found(df.limit(0)) == []
    nulls = spark.createDataFrame([(None, copy), (None, copy + "\nmore"), (5, copy)], "doc_id long, text string")
    kept = {r.doc_id: r.n_cut for r in lines.cut_repeated_lines(nulls).collect() if r.doc_id}
    assert kept == {5: 0}
