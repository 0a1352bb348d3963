"""Language identification: held-out accuracy, and the word and n-gram scores against a plain version."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.llm import langid, queries
from tests.conftest import DATA


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.op8_word_backoff(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and len(held) > 20
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def _words(text):
    out = [""]
    for c in text or "":
        if c.isalpha():
            out[-1] += c.lower() if len(c.lower()) == 1 else c
        elif out[-1]:
            out.append("")
    return [w for w in out if w]


def _grams(word, n):
    padded = f"\n{word}\n"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def brute(train, texts):
    languages = sorted({lang for _, lang in train})
    tables = []
    for n in (0, 4, 3, 2, 1):
        counts = Counter(
            (g, lang) for text, lang in train for w in _words(text) for g in (_grams(w, n) if n else [w]))
        keys = {g for g, _ in counts}
        sums = {lang: sum(max(counts[g, lang], 0) + 0.1 for g in keys) for lang in languages}
        tables.append({g: [math.log((counts[g, lang] + 0.1) / sums[lang]) for lang in languages] for g in keys})
    shares = Counter(lang for _, lang in train)
    out = []
    for text in texts:
        total = [math.log(shares[lang] / len(train)) for lang in languages]
        for w in _words(text):
            if w in tables[0]:
                add = tables[0][w]
            else:
                add = [0.0] * len(languages)
                for n, table in zip((4, 3, 2, 1), tables[1:]):
                    known = [table[g] for g in _grams(w, n) if g in table]
                    if known:
                        add = [sum(x) / len(known) for x in zip(*known)]
                        break
            total = [a + b for a, b in zip(total, add)]
        best = max(total)
        share = 1 / sum(math.exp(t - best) for t in total)
        out.append((languages[total.index(best)], share) if _words(text) else ("und", 0.0))
    return out


def test_scores(spark):
    train = [("The cat sat. THE dog!", "en"), ("der Hund und die Katze, ß", "de"), ("le chat et l'été", "fr"), ("a", "en")]
    texts = ["the hat", "Hunde", "ÉTÉ", "qqq zzz", "l'x", None, "", "12 !!", "dog 3dog", "İ Dž", "the\nthe", "日本"]
    frame = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(train)], "doc_id long, text string, lang string")
    noise = spark.createDataFrame([(None, "xx", "zz"), (90, None, "zz"), (91, "xx", None)], frame.schema)
    model = langid.train(frame.union(noise), sample_rows=10**9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    for i, want in enumerate(brute(train, texts)):
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1], abs=1e-5), texts[i]


def test_odd_rows(spark):
    rows = [(1, "the cat", "en"), (1, "the cat", "en"), (None, "the cat", None), (2, None, "de"), (3, "", None),
            (4, "the " * 400_000, "en"), (5, "x" * 1_000_000, "en"), (6, "der", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("s"))
    model = langid.train(df)
    assert model.languages == ["de", "en"]
    got = langid.identify(df, model, keep=tuple(df.columns))
    assert got.columns == [*df.columns, "lang_pred", "score"]
    assert Counter(r[-2] for r in got.collect()) == {"en": 5, "und": 2, "de": 1}
    empty = langid.train(df.limit(0))
    assert {r.lang_pred for r in langid.identify(df, empty).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).collect() == []


def test_smaller_sample_when_the_model_is_large(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert len(langid.train(docs, max_cells=60_000).tables[0][0]) < len(langid.train(docs).tables[0][0])


def test_languages_whose_texts_are_all_long(spark):
    said = {"en": "the cat and the dog sat on the mat ", "fr": "le chat et le chien sont dans la maison "}
    rows = [(i, said[lang] * 7000, lang) for i, lang in enumerate(["en", "fr"] * 5)]
    assert min(len(t) for _, t, _ in rows) > 200_000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.train(docs), keep=("doc_id", "lang")).collect()
    assert len(got) == 10 and all(r.lang == r.lang_pred for r in got)


def test_the_rarest_are_left_out(spark):
    """Words counted n times for n = 1 to 200: a small model keeps those counted most, and about as many as it may."""
    name = lambda n: "".join(chr(97 + (n // 26**k) % 26) for k in range(6))
    rows = [(n, f"{name(n * 7919)} " * n, "en") for n in range(1, 201)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = sum(len(keys) for keys, _ in langid.train(docs).tables.values())
    counted = spark.createDataFrame([("en", 0, n, n) for n in range(1, 201)], langid._COUNTS)
    kept = {r.n for r in langid._commonest(counted, 50).collect()}
    assert 45 <= len(kept) <= 55 and set(range(160, 201)) <= kept and max(range(1, 201)) in kept
    assert langid._commonest(counted, 200).count() == 200
    ones = spark.createDataFrame([("en", 0, n, 1) for n in range(2000)], langid._COUNTS)
    assert 400 <= langid._commonest(ones, 500).count() <= 600
    small = sum(len(keys) for keys, _ in langid.train(docs, max_cells=300).tables.values())
    assert 200 <= small <= 400 < whole
