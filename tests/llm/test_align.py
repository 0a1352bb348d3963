"""Aligned tokens against token rows compared byte by byte, and pieces against whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from marginalia.llm import align
from marginalia.llm import pieces as P
from tests.conftest import DATA

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return align.Tokenizers(A, B)


def brute(rows, pair):
    """One row per (doc_id, text), by the definition: whole texts, all links one by one."""
    docs, held = [], Counter()
    for doc_id, text in rows:
        a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        same = b"".join(pair.bytes_a[i] for i in a) == whole and b"".join(pair.bytes_b[i] for i in b) == whole
        groups = []
        if text and same:
            ends = [set(np.cumsum([len(xs[i]) for i in ids]).tolist()) for ids, xs in ((a, pair.bytes_a), (b, pair.bytes_b))]
            groups = {e: ([], []) for e in sorted(ends[0] & ends[1])}
            cuts = list(groups)
            for side, ids, xs in ((0, a, pair.bytes_a), (1, b, pair.bytes_b)):
                at, k = 0, 0
                for i in ids:
                    at += len(xs[i])
                    while cuts[k] < at:
                        k += 1
                    groups[cuts[k]][side].append(i)
            groups = list(groups.values())
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        held.update(set(links))
        docs.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), groups, links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, n_a, n_b, groups, links in docs:
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((doc_id, n_a, n_b, len(groups), sum(links.values()), sum(n for (x, y), n in links.items() if held[x, y] == best[x]),
                    sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr), held


def got(df, **settings):
    return sorted((tuple(r) for r in align.aligned_documents(df, byte_level=A, piecewise=B, **settings).collect()), key=repr)


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a \n b", "\n a", "a\tb", "x▁y", "tail ▁", "<s>hi</s> <unk>",
    "<|endoftext|> of <|endoftext|>", "<0x41> A", "nul\0byte", " x  y", "café été la", "日本語 テスト",
    "　　 wide", "emoji \U0001f600\U0001f468‍\U0001f469", "  line \x1c sep \x85 next", "don't we'll I'M  they'RE", "12345 67,890.12",
    "a" * 700 + " " + "ab" * 400, "=" * 300, "wordwithoutblank" * 200, "same words same words", "same words same words",
]


def test_table(spark, pair):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    expected, held = brute(rows, pair)
    made = align.Alignment(df.repartition(5), A, B, block_bytes=20_000)
    assert sorted((tuple(r) for r in made.documents().collect()), key=repr) == expected
    assert {(r.a_id, r.b_id): r.n_docs for r in made.pair_counts().collect()} == held


def test_more_blocks_make_more_tasks(spark):
    """What is read, written or scored at once does not grow with the table: 60 blocks of one partition."""
    import pyarrow.dataset as ds

    df = spark.createDataFrame([(i, f"text number {i} of all 日本") for i in range(60)], "doc_id long, text string").coalesce(1)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"  # a block closes after a batch at the earliest
    before = spark.conf.get(rows)
    spark.conf.set(rows, 1)
    try:
        made = align.Alignment(df, A, B, block_bytes=1)
    finally:
        spark.conf.set(rows, before)
    assert made.blocks.count() == 60
    files = list(ds.dataset([f.removeprefix("file://") for f in made.blocks.inputFiles()]).get_fragments())
    groups = [g.num_rows for f in files for g in f.row_groups]
    assert sum(groups) == 61 and max(groups) <= align.ROW_GROUP
    scored = made.documents()
    assert scored.count() == 60
    assert scored.rdd.getNumPartitions() >= 60 // align.SCORED


def test_odd_texts(spark, pair):
    rows = list(enumerate(ODD)) + [(None, "no id"), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected, _ = brute(rows, pair)
    assert got(df) == expected
    clash = df.selectExpr("*", "1 as block", "'x' as pairs", "2 as at", "3 as n_a")
    assert got(clash, block_bytes=100) == expected
    assert got(df.limit(0)) == []
    assert got(df.filter("doc_id < 2")) == brute(rows[:2], pair)[0]


def test_long_text(spark, pair):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghéß"), rng.integers(1, 12))) for _ in range(3000)]
    rows = [(1, " ".join(rng.choice(words, 300_000))), (2, "x" * 1_500_000), (3, "short text")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, pair)[0]


def test_groups_as_text(spark, pair):
    df = spark.createDataFrame([(1, "hello unusualword"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r.groups for r in align.aligned_groups(df, byte_level=A, piecewise=B).collect()}
    assert found[2] is None
    tokens = [[p.split(",") for p in g.split("|")] for g in found[1].split(";")]
    text = [b"".join(pair.bytes_a[int(i)] for i in a) for a, _ in tokens]
    assert b"".join(text) == b" hello unusualword"
    assert text == [b"".join(pair.bytes_b[int(i)] for i in b) for _, b in tokens]


def test_forgotten_pieces_change_nothing(pair):
    """A worker that remembers few pieces learns them again."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(1, 9))) for _ in range(500)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(80)] + ["z" * 400 + " end"] * 2
    few, many = align.Pieces(pair, remembered=50), align.Pieces(pair)
    for i in range(0, len(texts), 4):
        batch = pa.array(texts[i : i + 4])
        for x, y in zip(align._documents(batch, few), align._documents(batch, many), strict=True):
            assert x[3] == y[3] and (x[2] == y[2]).all() and (x[5] == y[5]).all() and (x[6] == y[6]).all()
    assert len(few.keys) < 400


def test_cuts_are_before_white_space_after_none():
    text = "a b\nc  d  e　 fé g \nh"
    (first, raw, edges), = P.prefixed(pa.array([text, None, "", "z"]))
    starts, ends = P.cut(raw, edges)
    assert first == 0 and edges.tolist()[-3:] == [len(raw) - 2] * 2 + [len(raw)]
    assert [raw[s:e].tobytes().decode() for s, e in zip(starts, ends)] == [
        " a", " b", "\nc", "  d  e　 fé", " g", " \nh", " z"]
