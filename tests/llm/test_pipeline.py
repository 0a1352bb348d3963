"""The pipeline, stage by stage and as a whole, against brute force."""

import duckdb
import pandas as pd
from tokenizers import Tokenizer

import corpus_pipeline
from marginalia.llm import mixing
from tests.conftest import DATA
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_near import brute as brute_near
from tests.llm.test_tokens import _want


def brute(rows, items):
    """Rows: (doc_id, text, lang, source, n_chars) -> the last stage's rows."""
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    near = {d: kept for d, _, _, kept in brute_near([r[:2] for r in rows], 5)}
    rows = [r for r in rows if near[r[0]]]
    hits = {h[0]: h[2] for h in brute_hits([r[:2] for r in rows], items)}
    rows = [r for r in rows if not hits[r[0]]]
    con = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841
    con.execute("create table documents as select * from documents")
    turns = dict(con.execute(f"select doc_id, turns from ({mixing.ORACLE})").fetchall())
    made = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    return _want([r[:2] for r in rows for _ in range(turns[r[0]])], lambda t: made.encode(t or "", add_special_tokens=False).ids)


def test_whole_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()],
                 [(r.item_id, r.text) for r in items.collect()])
    got = corpus_pipeline.run(spark, DATA).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    assert 0 < len({r.doc_id for r in got}) < docs.count()


def test_stages_keep_the_columns_and_odd_rows(spark):
    rows = [(1, "a clean text of seven whole words", "en", "s"), (2, None, "en", "s"), (3, "", None, None), (4, "12 34", "en", "t"),
            (None, "no id at all here it is", None, "t"), (5, "a clean text of seven whole words", "en", "s"),
            (6, "ein anderer Text mit Worten", "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as kept", "2 as n_hit", "3 as c0")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "kept", "n_hit", "c0"], name
        seen.append(sorted((r.doc_id or 0 for r in docs.collect())))
    assert seen[0] == [0, 1, 5, 6] and seen[1] == [0, 1, 6] and seen[2] == [0, 1, 6]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert sorted((r.doc_id or 0) for r in last) == seen[3]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0
