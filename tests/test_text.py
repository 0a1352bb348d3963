import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.functions.masking import mask_record
from marginalia.operators import clean as C


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize("value, tokens", [("", 0), ("abcd", 1), ("abcde", 2), ("中文", 2), ("中文ab", 3), ("，。", 2), ("한국", 2), ("カナ", 2), ("😀😀😀😀😀", 2)])
def test_token_estimate(spark, value, tokens):
    assert one(spark, X.token_estimate, value) == tokens


@pytest.mark.parametrize("value, parts", [
    ("One. Two! Three", ["One.", "Two!", "Three"]), ("甲。乙！丙", ["甲。", "乙！", "丙"]), ("a;b", ["a;", "b"]),
    ("1.5 is fine", ["1.5 is fine"]), ("x\n\ny", ["x", "y"]), ("   ", ["   "]), ("!?a", ["!", "?", "a"]),
])
def test_sentences(spark, value, parts):
    assert one(spark, X.sentences, value) == parts


def test_match_and_clean_text(spark):
    assert one(spark, X.match_text, " A​ 　B\t\n C﻿ ") == "A B C"
    assert one(spark, X.clean_text, "​ a  \t\nb\n\n\n\nc  ") == "a\nb\n\nc"
    assert one(spark, X.clean_text, "a\r\nb") == "a\r\nb"


def test_garbled_counts_line_breaks(spark):
    assert one(spark, C.is_garbled, "ab\n\n") is True
    assert one(spark, C.is_garbled, "abcdefg\n\n\n") is False
    assert one(spark, C.is_garbled, "��abc") is True
    assert one(spark, C.is_garbled, "") is True


def test_hard_split_keeps_everything(spark):
    text = "x" * 950 + "中" * 50
    pieces = one(spark, lambda t: X.hard_split(t, F.lit(40)), text)
    assert "".join(pieces) == text and len(pieces) > 1


def test_markdown_of_blocks(spark):
    rows = [("heading", "T", 0), ("heading", "T", 9), ("code", "x", 0), ("caption", "c", 1), ("table", "|a|", 0), ("paragraph", "p", 3)]
    df = spark.createDataFrame(rows, "type string, text string, depth int")
    got = [r[0] for r in df.select(X.block_markdown(F.col("type"), F.col("text"), F.col("depth"))).collect()]
    assert got == ["# T", "###### T", "```\nx\n```", "*c*", "|a|", "p"]


@pytest.mark.parametrize("value, masked", [
    ("redis://:hunter2@cache:6379/0", "redis://:***@cache:6379/0"),
    ("GET https://h/x?api_key=abc&y=1", "GET https://h/x?api_key=***&y=1"),
    ('{"access_token": "sk-1"}', '{"access_token": "***"}'),
    ("Authorization: Bearer abc.def.ghi next", "Authorization: *** next"),
    ("write to a.b+c@mail.example.org.", "write to <email>"),
    ("id A123456789, phone 0912-345-678 / 0912345678", "id <id>, phone <phone> / <phone>"),
    ("card 4111111111111111 ok", "card <redacted> ok"),
    ("request 1234567890abcdef1234567890abcdef", "request 1234567890abcdef1234567890abcdef"),
    ("author=Kim", "author=Kim"), ("max_tokens=5", "max_tokens=***"),
])
def test_mask(spark, value, masked):
    assert one(spark, X.mask, value) == masked


def test_mask_record_by_key(spark):
    df = spark.createDataFrame(
        [((("x@y.zz", 7, "s"), [("n", "token=1")], {"note": "0912-345-678", "X-Cookie": "c"}),)],
        "r struct<a: struct<mail: string, prompt_tokens: int, user_password: string>, l: array<struct<k: string, v: string>>, m: map<string, string>>",
    )
    r = df.select(mask_record(F.col("r"), df.schema["r"].dataType).alias("r")).first()["r"]
    assert (r.a.mail, r.a.prompt_tokens, r.a.user_password) == ("<email>", 7, "***")
    assert r.l[0].v == "token=***" and r.m == {"note": "<phone>", "X-Cookie": "***"}


def blocks(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, block_order long, page long, type string, text string")


def test_headers_need_three_pages_and_shortness(spark):
    long_line = "word " * 40
    rows = [(1, i, i, "paragraph", "Internal  use​ only") for i in (1, 2, 3)] + [(1, 10 + i, i, "paragraph", long_line) for i in (1, 2, 3)]
    rows += [(1, 20, None, "paragraph", "Internal use only"), (1, 30, 1, "paragraph", "twice"), (1, 31, 2, "paragraph", "twice")]
    rows += [(1, 40 + i, i, "table", "| t |") for i in (1, 2, 3)] + [(2, i, 1, "paragraph", "same page") for i in (1, 2, 3)]
    df = blocks(spark, rows)
    assert [(r.doc_id, r.match_text, r.pages) for r in C.repeated_headers(df).collect()] == [(1, "Internal use only", 3)]
    stats = {r.doc_id: r for r in C.clean_stats(df).collect()}
    assert (stats[1].total, stats[1].removed_headers, stats[1].dropped) == (8, 4, 0)


def test_same_line_in_tables_neither_counts_nor_stays(spark):
    rows = [(1, 1, 1, "table", "H"), (1, 2, 1, "paragraph", "H"), (1, 3, 2, "paragraph", "H"), (1, 4, 3, "table", "H"), (1, 5, 3, "paragraph", "H")]
    assert {r.fate for r in C.judged(blocks(spark, rows)).collect()} == {"header"}
    assert {r.fate for r in C.judged(blocks(spark, rows[:4])).collect()} == {"kept"}


def test_drop_rate_and_renumbering(spark):
    rows = [(1, 0, None, "paragraph", "​  "), (1, 5, None, "paragraph", "ok"), (1, 7, None, "paragraph", "��"), (1, 9, None, "table", "\t")]
    s = C.clean_stats(blocks(spark, rows)).first()
    assert (s.total, s.dropped, s.drop_rate, s.quality_warning) == (4, 3, 0.75, True)
    kept = C.cleaned(blocks(spark, rows)).collect()
    assert [(k.block_order, k.old_order, k.text) for k in kept] == [(0, 5, "ok")]


def test_language_model_and_scripts(spark):
    from marginalia.operators import language as G

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = G.train(docs.select("lang", "text"))
    found = G.detect(docs.select("doc_id", "text"), model).join(docs.select("doc_id", "lang", "n_chars"), "doc_id")
    wrong = found.filter((F.col("n_chars") > 200) & (F.col("language") != F.col("lang"))).count()
    assert wrong <= 0.05 * docs.count()
    odd = spark.createDataFrame([(1, "漢字かな"), (2, "한국어"), (3, "  \n"), (4, "12"), (5, None)], "doc_id long, text string")
    assert {r.doc_id: r.language for r in G.detect(odd, model).collect()} == {1: "ja", 2: "ko", 3: "und", 4: "und", 5: "und"}
    key = lambda gram: sum(ord(c) << 21 * (2 - i) for i, c in enumerate(gram))
    few = spark.createDataFrame([(1, "ABCDabc"), (None, "A\n𝄞Ñx"), (3, "ab"), (4, ""), (5, None)], "doc_id long, text string")
    got = {(r.doc_id, r.gram): r.n for r in G.counted(few, ["doc_id"]).collect()}
    assert got == {(d, key(g)): n for d, g, n in [
        (1, "abc", 2), (1, "bcd", 1), (1, "cda", 1), (1, "dab", 1), (None, "a\n𝄞", 1), (None, "\n𝄞ñ", 1), (None, "𝄞ñx", 1)]}
    nothing = G.train(spark.createDataFrame([(None, "abc"), ("en", None), ("en", "ab")], "lang string, text string"))
    assert {r.doc_id: r.language for r in G.detect(odd, nothing).collect()} == {1: "ja", 2: "ko", 3: "und", 4: "und", 5: "und"}


def test_texts_to_detect_are_made_once(spark):
    """What makes the texts, such as cleaning, runs once although their scripts and their trigrams are both needed."""
    from marginalia.operators import language as G

    made = spark.sparkContext.accumulator(0)

    def make(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    model = G.train(spark.createDataFrame([("en", "the cat and the dog"), ("fr", "le chat et le chien")], "lang string, text string"))
    docs = spark.createDataFrame([(1, "the dog"), (2, "le chien"), (3, None), (4, " ")], "doc_id long, text string")
    got = G.detect(docs.coalesce(1).mapInPandas(make, docs.schema), model).collect()
    assert {r.doc_id: r.language for r in got} == {1: "en", 2: "fr", 3: "und", 4: "und"} and made.value == 4


def test_blank_and_collapsed_texts(spark):
    """As stripping and collapsing every run of white space say, for all white space and line ends."""
    texts = ["", " ", "\n", " 　", "a", " a", "​", "a  b", "a\tb", "a  b", " a b ", "a\n\nb\r", "\U0001f600 ", "\x1c \x85", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        X.is_blank(F.col("t")).alias("blank"), (X.strip(F.col("t")) == "").alias("stripped"),
        X.match_text(F.col("t")).alias("line"), F.trim(F.regexp_replace(X.without_invisible(F.col("t")), f"{X.SPACE}+", " ")).alias("plain"))
    for r in rows.collect():
        assert r.blank == r.stripped and r.line == r.plain
