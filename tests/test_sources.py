import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from marginalia.operators import intake as N
from marginalia.operators import sinks as S
from marginalia.sources import blocks as B
from marginalia.sources import layout as Y
from marginalia.sources import objects as O
from marginalia.sources import tables as T
from marginalia.sources import web as H
from marginalia.sources.markdown import blocks_of, markdown_blocks
from tests.conftest import DATA


def zipped(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name in names:
            archive.writestr(name, "<x/>" * 50)
    return out.getvalue()


@pytest.mark.parametrize("content, name, kind", [
    (b"%PDF-1.7 rest", "a.txt", N.PDF), (zipped("[Content_Types].xml", "word/document.xml"), "a.pdf", N.DOCX), (zipped("xl/workbook.xml"), "a", N.XLSX),
    (zipped("other.txt"), "a.docx", None), (b"PK\x03\x04 word/document.xml", "a.docx", None), (b"", "a.txt", None), ("文字\n".encode(), "a.txt", N.TEXT),
    (b"# t\tx\r\n", "A.MARKDOWN", N.MARKDOWN), (b"# t", "a.md.txt", N.TEXT), (b"a\x00b", "a.txt", None), (b"\xff\xfe", "a.txt", None),
    (b"MZ\x90", "a.md", None), ("zero​width".encode(), "a.txt", None), ("wide　space".encode(), "a.txt", None), (b"form\x0cfeed\x0b", "a.txt", N.TEXT),
])
def test_media_type(spark, content, name, kind):
    df = spark.createDataFrame([(bytearray(content), name)], "content binary, filename string")
    assert df.select(N.media_type(F.col("content"), F.col("filename"))).first()[0] == kind


def test_duplicates_and_soft_deleted_keys(spark):
    df = spark.createDataFrame([(3, "t", "h", 1), (1, "t", "h", 2), (2, "u", "h", 0), (4, "t", "g", 0)], "doc_id long, tenant_id string, h string, created_at int")
    got = {r.doc_id: r.duplicate_of for r in N.mark_duplicates(df, ["tenant_id", "h"], ["created_at"], "doc_id").collect()}
    assert got == {3: None, 1: 3, 2: None, 4: None}
    assert N.unseen(df, df.filter("doc_id = 4"), ["tenant_id", "h"]).count() == 3


def test_fair_waves(spark):
    df = spark.createDataFrame([(i, "a" if i < 5 else "b", f"2024-01-01 0{i}:00:00") for i in range(7)], "doc_id long, tenant_id string, ts string")
    got = N.fair_waves(df.withColumn("created_at", F.col("ts").cast("timestamp_ntz")), 2).orderBy("doc_id").collect()
    assert [(r.wave, r.place) for r in got] == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (1, 1), (1, 2)]


def test_text_blocks(spark):
    df = spark.createDataFrame([(1, " a\nb\n \t\n\n\nc \n\x0b\nd"), (2, " \n\n ")], "doc_id long, text string")
    assert [(r.block_order, r.text) for r in B.text_blocks(df).orderBy("block_order").collect()] == [(0, "a\nb"), (1, "c"), (2, "d")]


def test_heading_path_pops_same_and_deeper(spark):
    rows = [(1, "heading", "A", 1), (2, "heading", "B", 3), (3, "paragraph", "p", None), (4, "heading", "C", 2), (5, "paragraph", "q", None), (6, "heading", "D", 1), (7, "paragraph", "r", None)]
    df = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, block_order long, type string, text string, level int")
    got = {r.block_order: list(r.heading_path) for r in B.with_heading_path(df).collect()}
    assert got == {1: [], 2: ["A"], 3: ["A", "B"], 4: ["A"], 5: ["A", "C"], 6: [], 7: ["D"]}


def test_markdown_blocks():
    text = """---
title: x
---

# One ##
para line 1
para line 2
- item
  continued

  still inside
- second
1. other list

Setext
======
> quote
lazy

    indented
      code

| a | b |
|---|:-:|
| 1 | 2 |
not a row|

~~~py
# not a heading
```
~~~
***
#hashtag
| lone |
"""
    got = list(blocks_of(text))
    assert got == [
        ("heading", "title: x", 2), ("heading", "One", 1), ("paragraph", "para line 1\npara line 2", None),
        ("paragraph", "- item\n  continued\n\n  still inside\n- second", None), ("paragraph", "1. other list", None), ("heading", "Setext", 1),
        ("paragraph", "> quote\nlazy", None), ("code", "indented\n  code", None), ("table", "| a | b |\n|---|:-:|\n| 1 | 2 |\nnot a row|", None),
        ("code", "# not a heading\n```", None), ("paragraph", "#hashtag\n| lone |", None),
    ]


def test_open_fence_runs_to_the_end_and_empty_text(spark):
    assert list(blocks_of("```\na\n\nb\n")) == [("code", "a\n\nb", None)] and list(blocks_of("\n \n")) == []
    df = spark.createDataFrame([(1, "# A\n\n## B\n\ntext"), (2, "plain")], "doc_id long, text string")
    got = sorted((r.doc_id, r.block_order, r.type, tuple(r.heading_path)) for r in markdown_blocks(df).collect())
    assert got == [(1, 0, "heading", ()), (1, 1, "heading", ("A",)), (1, 2, "paragraph", ("A", "B")), (2, 0, "paragraph", ())]


LINE = "doc_id long, line_no long, page int, text string, size double, top double, height double"


def test_page_lines(spark):
    lines = spark.createDataFrame([
        (1, 0, 1, "Title", 20.0, 10.0, 20.0), (1, 1, 1, "body one", 10.0, 40.0, 10.0), (1, 2, 1, "body two", 10.0, 52.0, 10.0),
        (1, 3, 1, "far below", 10.0, 90.0, 10.0), (1, 4, 2, "next page", 10.0, 5.0, 10.0), (1, 5, 2, "small", 8.0, 17.0, 10.0),
    ], LINE)
    tables = spark.createDataFrame([(1, 1, 70.0, "| t |")], "doc_id long, page int, top double, text string")
    none = spark.createDataFrame([], "doc_id long, entry_no long, title string, level int")
    got = Y.line_blocks(lines, tables, none).orderBy("block_order").collect()
    assert [(r.type, r.text, r.page, list(r.heading_path)) for r in got] == [
        ("heading", "Title", 1, []), ("paragraph", "body one\nbody two", 1, ["Title"]), ("table", "| t |", 1, ["Title"]),
        ("paragraph", "far below", 1, ["Title"]), ("paragraph", "next page", 2, ["Title"]), ("paragraph", "small", 2, ["Title"]),
    ]
    outline = spark.createDataFrame([(1, 0, " body   two ", 1)], none.schema)
    types = [r.type for r in Y.line_blocks(lines, tables, outline).orderBy("block_order").collect()]
    assert types == ["paragraph", "paragraph", "heading", "table", "paragraph", "paragraph", "paragraph"]


def test_equal_weight_prefers_the_smaller_size(spark):
    lines = spark.createDataFrame([(1, 0, 1, "abcd", 12.0, 1.0, 10.0), (1, 1, 1, "efgh", 10.0, 2.0, 10.0)], LINE)
    assert Y.body_sizes(lines).first()["body"] == 10.0


def test_sheets(spark):
    rows = [("S", i, [f"r{i}", None]) for i in range(103)] + [("S", 200, [" ", ""]), ("S", 201, ["", None]), ("H", 1, ["only", "header"])]
    got = Y.sheet_blocks(spark.createDataFrame(rows, "sheet string, row_no long, cells array<string>"), [], F.floor(F.col("row_no") / 10)).orderBy("sheet", "block_order").collect()
    assert [(r.sheet, r.type) for r in got] == [("H", "heading"), ("H", "table"), ("S", "heading"), ("S", "table"), ("S", "table"), ("S", "table")]
    assert got[1].text == "| only | header |\n| --- | --- |"
    assert [len(r.text.split("\n")) for r in got[3:]] == [52, 52, 5]
    assert all(r.text.startswith("| r0 |  |\n| --- | --- |\n") for r in got[3:])


def test_table_text(spark):
    df = spark.createDataFrame([([["a|b", "c"], ["1\n2"], []],), ([],)], "rows array<array<string>>")
    got = [r[0] for r in df.select(Y.markdown_table(F.col("rows"))).collect()]
    assert got == ["| a\\|b | c |\n| --- | --- |\n| 1<br>2 |  |\n|  |  |", ""]


def test_web(spark):
    rows = [(1, "HTTP://Ex.org:80/a/?b=2&utm_source=x&a=1#f", "<head><title>t</title></head><p>One&nbsp;&amp; <b>two</b></p><script>x<y</script><!-- c --><p>3</p>"),
            (2, "https://ex.org/a?a=1&b=2", ""), (3, "https://ex.org/", "x")]
    got = {r.page_id: r for r in H.web_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].url_key == got[2].url_key == "ex.org/a?a=1&b=2" and got[3].url_key == "ex.org"
    assert (got[1].is_duplicate, got[2].is_duplicate) == (False, True) and got[1].main_text == "One & two\n3"


def test_page_text_of_references_and_open_ends(spark):
    pages = ["a &#65;&#x1F600;&copy;&eacute; &nope; &amp;#66; &#0; &#55296; &", "one<script>two</p>three", "a<!-- b <p>c", "<style>x</style>y<nav>z", None]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    got = {r.i: r.t for r in rows.select("i", H.main_text(F.col("html")).alias("t")).collect()}
    assert got == {0: "a A😀©é &nope; &#66; \ufffd \ufffd &", 1: "one", 2: "a", 3: "yz", 4: None}


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"


def _article(parts):
    """The rule over [(tag, [(text, is link)])], in plain Python."""
    runs = [(" ".join(t for t, _ in runs), sum(len(t.split()) for t, _ in runs), sum(len(t.split()) for t, link in runs if link)) for _, runs in parts]
    runs = [r for r in runs if r[1]]
    out = []
    for i, (text, words, linked) in enumerate(runs):
        _, before, before_linked = runs[i - 1] if i else ("", 0, 0)
        after = runs[i + 1][1] if i + 1 < len(runs) else 0
        if linked / words > 1 / 3:
            continue
        if not before or before_linked / before <= 5 / 9:
            good = words > 16 or after > 15 or before > 4
        else:
            good = words > 40 or after > 17
        if good:
            out.append(text)
    return "\n".join(out)


def test_articles_by_rule(spark):
    """Random pages of links and texts of every size around the rule's limits."""
    rng, pages = random.Random(4), []
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(0, 8)):
            runs = [(" ".join(["word"] * rng.choice([1, 2, 3, 4, 5, 9, 15, 16, 17, 18, 40, 41])), rng.random() < 0.4) for _ in range(rng.randint(0, 3))]
            parts.append((rng.choice(["p", "div", "li", "h2", "td"]), runs))
        pages.append(parts)
    html = ["".join(f"<{tag} class=x>" + " ".join(f'<a href="/x">{t}</a>' if link else f"<b>{t}</b>" for t, link in runs) + f"</{tag}>" for tag, runs in parts) for parts in pages]
    rows = spark.createDataFrame(list(enumerate(html)), "i int, html string")
    got = {r.i: r.t for r in rows.select("i", H.article_text(F.col("html")).alias("t")).collect()}
    assert got == {i: _article(parts) for i, parts in enumerate(pages)}
    assert sum(t != "" for t in got.values()) > 50


def test_article_pages(spark):
    """Boilerplate links outside ``nav``, links around blocks, open links, marks and references, nothing at all."""
    menu = "".join(f'<li><a href="/{i}">Topic number {i}</a></li>' for i in range(9))
    pages = [
        f"<ul>{menu}</ul><h1>A title of five words</h1><p>{LONG}</p><p>See <a href=/x>this page</a> for {LONG}</p><div><a href=/y>Read more</a> | <a href=/z>Share</a></div>",
        f"<a href=/x><div>{LONG}</div><p>{LONG}</p></a><p>{LONG} end</p>",
        f"<p>{LONG}</p><p><a href=/x>open {LONG}",
        f"<p>\x02{LONG}\x03 &#2;&#x03; &lt;a&gt; &amp;</p>", "", "<p> </p>", None, "short",
    ]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    got = {r.i: r.t for r in rows.select("i", H.article_text(F.col("html")).alias("t")).collect()}
    assert got == {
        0: f"A title of five words\n{LONG}\nSee this page for {LONG}", 1: "", 2: LONG, 3: f"{LONG} \ufffd\ufffd <a> &",
        4: "", 5: "", 6: None, 7: ""}


def test_objects_and_foreign_keys(spark, tmp_path):
    (tmp_path / "tenant-a" / "kb" / "k1").mkdir(parents=True)
    (tmp_path / "tenant-a" / "kb" / "k1" / "7").write_bytes(b"\x00abc")
    (tmp_path / "stray").write_bytes(b"x")
    got = O.read_objects(spark, str(tmp_path)).collect()
    assert [(r.tenant_id, r.kb_id, r.doc_id, bytes(r.content), r.length) for r in got] == [("a", "k1", "7", b"\x00abc", 4)]
    keys = spark.createDataFrame([("a", "tenant-a/x"), ("a", "tenant-ab/x"), ("a", None)], "tenant_id string, storage_key string")
    assert sorted(str(r.storage_key) for r in O.foreign_keys(keys).collect()) == ["None", "tenant-ab/x"]


def test_views_need_a_tenant(spark):
    df = spark.createDataFrame([("a", None), ("b", 1), (None, None)], "tenant_id string, deleted_at int")
    assert T.tenant_view(df, "a").count() == 1 and T.shared_view(df, "a").count() == 2
    assert T.live_view(df).count() == 2 and T.live_view(df, including_deleted=True).count() == 3
    for missing in (None, ""):
        with pytest.raises(ValueError):
            T.tenant_view(df, missing)


def test_upsert_null_keys_and_last_write(spark):
    schema = "k string, v int"
    current = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], schema)
    changes = spark.createDataFrame([(None, 9), ("a", 5), ("a", 7), ("c", 4)], schema)
    merged = S.upsert(current, changes, ["k"], F.col("v"))
    want = [("", 9), ("a", 7), ("b", 3), ("c", 4)]
    assert sorted((r.k or "", r.v) for r in merged.collect()) == want
    assert sorted((r.k or "", r.v) for r in S.upsert(merged, changes, ["k"], F.col("v")).collect()) == want


def test_replace_is_rerun_safe(spark):
    current = spark.createDataFrame([(1, 1, "old"), (1, 2, "keep"), (2, 1, "other")], "doc_id int, doc_version int, t string")
    fresh = spark.createDataFrame([(1, 1, "new"), (1, 1, "new2")], current.schema)
    once = S.replace_for_keys(current, fresh, ["doc_id", "doc_version"])
    twice = S.replace_for_keys(once, fresh, ["doc_id", "doc_version"])
    assert sorted(r.t for r in once.collect()) == sorted(r.t for r in twice.collect()) == ["keep", "new", "new2", "other"]


def test_partition_overwrite_leaves_other_days(spark, tmp_path):
    path = str(tmp_path / "t")
    S.overwrite_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, day string"), path, "day")
    S.overwrite_partitions(spark.createDataFrame([(9, "b")], "v int, day string"), path, "day")
    assert sorted((r.v, r.day) for r in spark.read.parquet(path).collect()) == [(1, "a"), (9, "b")]


def test_artefacts_of_other_versions_or_shapes_are_recomputed(spark):
    good = '{"format_version":1,"doc_meta":{"block_count":1},"blocks":[{"type":"paragraph","text":"x","order":0,"page":null,"heading_path":[]}]}'
    rows = [(1, good), (2, good.replace('n":1', 'n":2', 1)), (3, good.replace("paragraph", "poem")), (4, good[:-4]), (5, '{"format_version":1}'), (6, "")]
    blocks, again = S.read_artefacts(spark.createDataFrame(rows, "doc_id long, artefact string"))
    assert [r.doc_id for r in blocks.collect()] == [1] and sorted(r.doc_id for r in again.collect()) == [2, 3, 4, 5, 6]


def test_snapshot_and_watermark(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, h string")
    new = spark.createDataFrame([(2, "x"), (3, None), (4, "d")], "k int, h string")
    assert {r.k: r.change for r in T.snapshot_diff(old, new, ["k"], "h").collect()} == {1: "deleted", 2: "changed", 3: "same", 4: "new"}


def test_spread_only_when_splits_are_few(spark):
    assert T.table(spark, DATA, "documents").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_shared_folder_comes_from_the_session_or_is_refused():
    from types import SimpleNamespace

    from marginalia.session import shared_dir

    def session(setting, master, app):
        conf = SimpleNamespace(get=lambda key, default: setting if key == "spark.checkpoint.dir" else default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=app))

    assert shared_dir(session("hdfs://nn/tmp/", "yarn", "a")) == "hdfs://nn/tmp"
    with pytest.raises(RuntimeError):
        shared_dir(session(None, "yarn", "a"))
    assert shared_dir(session(None, "local[2]", "b")) == shared_dir(session(None, "local[2]", "b"))


def test_markdown_blocks_are_handed_on_a_few_megabytes_at_a_time():
    """A batch of documents is not held as Python values at once, whatever its size."""
    import pyarrow as pa

    from marginalia.functions.batches import HELD_CHARS
    from marginalia.sources.markdown import _walk_batches

    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(["# a\n\n" + "x" * 400_000] * 30)], names=["doc_id", "text"])
    sizes = [(out.num_rows, sum(len(t) for t in out.column("text").to_pylist())) for out in _walk_batches(iter([batch]))]
    assert sum(n for n, _ in sizes) == 60 and max(chars for _, chars in sizes) < HELD_CHARS + 400_001 and len(sizes) > 4
