"""URL verdicts: parts and rules against plain string work, model scores against plain counting."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import queries, urls
from tests.conftest import DATA


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def rule(host, path, rules):
    fitting = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fitting, key=lambda r: len(r.host + r.path), default=None)


def check(rows, got, rules):
    assert len(got) == len(rows)
    want = Counter()
    for page, url in rows:
        host, path = parts(url)
        r = rule(host, path, rules)
        want[page, host, path, r and r.host + r.path, r and r.verdict] += 1
    assert want == Counter((g.page_id, g.host, g.path, g.rule, g.verdict if g.rule else None) for g in got)


def test_table(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = queries.op10_character_ratio(spark, DATA).collect()
    check([(p.page_id, p.url) for p in pages], got, queries.RULES)
    assert {g.verdict for g in got if g.rule is None} <= {"allow", "block"}


ODD = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x", "http://example.com/en/",
    "http://notexample.com/en/", "http://a.example.com/en/?q", "http://a.net/es/#x", "http://a.net/esx", "x://y://z.net/fr/a",
    "http://É.NET/fr/é", "http://a.com?x=/en/", "http://a.com#/", "http://com.", "http://.com/", "http://a.net/fr/\n/b",
]


def test_odd_rows(spark):
    rows = [(i, u) for i, u in enumerate(ODD)] + [(None, "http://a.com/"), (3, "http://"), (99, "http://q.org/" + "z" * 700_000)]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as verdict", "'x' as accepted")
    check(rows, urls.url_verdicts(df, queries.RULES).collect(), queries.RULES)
    free = urls.url_verdicts(df, ()).collect()
    assert {(g.rule, g.verdict, g.score) for g in free} == {(None, "allow", 0.0)}
    assert urls.url_verdicts(df.limit(0), queries.RULES).collect() == []


def brute(train, url, order=urls.ORDER):
    counts = [defaultdict(Counter) for _ in range(2)]
    for accepted, u in train:
        padded = "\0" * order + u
        for i in range(order, len(padded)):
            for k in range(order + 1):
                counts[accepted][padded[i - k : i]][padded[i]] += 1
    floor = 1 / (len(set(counts[0][""]) | set(counts[1][""])) + 1)
    padded, total = "\0" * order + url, 0.0
    for i in range(order, len(padded)):
        for accepted, sign in ((1, 1), (0, -1)):
            p = floor
            for k in range(order + 1):
                after = counts[accepted].get(padded[i - k : i])
                if after:
                    p = (after[padded[i]] + len(after) * p) / (sum(after.values()) + len(after))
            total += sign * math.log(p)
    return total / max(len(url), 1)


def test_scores(spark):
    rng = random.Random(4)
    train = [(i % 2, "http://" + "".join(rng.choice("abcé./") for _ in range(rng.randint(1, 20)))) for i in range(60)]
    frame = spark.createDataFrame([(bool(a), u) for a, u in train], "accepted boolean, url string")
    counted = frame.mapInArrow(urls._count, urls._COUNTS).groupBy("accepted", "order", "context", "gram").sum("n")
    model = urls.Model(*urls._tables(counted.toDF(*urls._COUNTS.names).toArrow()), 0.0)
    asked = ["http://abc", "", "zzz", "http://é.a/a", train[0][1], train[1][1]]
    assert urls.differences(model, asked).tolist() == pytest.approx([brute(train, u) for u in asked])


def test_all_urls_teach(spark):
    """Every character of four fifths of the URLs is counted, of 25,000 of a verdict and of one of 3,000 characters."""
    rows = spark.range(50_000).selectExpr("id as page_id", "concat('http://a', id, '.org/', if(id < 2, repeat('y', 3000), '')) as url", "id % 2 = 0 as accepted")
    model = urls.train(rows)
    learned = rows.filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(5)) != 4)
    sizes = {r.accepted: r.n for r in learned.groupBy("accepted").agg(F.sum(F.length("url")).alias("n")).collect()}
    assert model.grams[0][1].sum(axis=0).tolist() == [sizes[False], sizes[True]]
    few = urls.train(rows, most_grams=500)
    assert 100 < sum(len(known) for known, _ in few.grams) <= 500


def test_no_gram_is_left_out(spark, monkeypatch):
    """More n-grams than workers hold stay in tables: all are counted, and scores are those of a model of all."""
    rng = random.Random(5)
    monkeypatch.setattr(urls, "_SLICE", 2_000)
    rows = [(i % 7 and i, "http://" + "".join(rng.choice("abcdé./") for _ in range(rng.randint(0, 30)))
             + rng.choice([".com", ".net/es/", ".org", ""])) for i in range(400)]
    rows += [*rows[:9], (1, None), (2, ""), (3, "http://a.com/" + "xyz" * 1_500), (4, "http://b.org/" + "zy" * 1_500)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    rules = (urls.Rule("allow", "com", ""), urls.Rule("block", "net", "/es/"))
    held, tables = (urls.url_verdicts(df, rules, held_grams=n).collect() for n in (10**6, 100))
    key = lambda r: repr(tuple(r)[:-1] + (round(r.score, 9),))
    assert sorted(map(key, held)) == sorted(map(key, tables))
    assert len({r.score for r in tables}) > 100
    ruled = df.selectExpr("page_id", "url", "if(url like '%.com%', true, if(url like '%.net/es/', false, null)) as accepted")
    whole, kept = urls.train(ruled), urls.train(ruled, held_grams=100)
    assert isinstance(kept, urls.Tables) and isinstance(whole, urls.Model)
    assert kept.grams.count() == sum(len(known) for known, _ in whole.grams)
    assert kept.threshold == whole.threshold


def test_threshold_parts_best():
    assert urls.threshold([(-20, 0, 4), (-5, 1, 3), (7, 0, 1), (10, 5, 0)]) == 9 / urls.STEPS
    assert urls.threshold([(3, 5, 0)]) == urls.threshold([]) == 0.0


def test_models_part_what_rules_part(spark):
    rows = [(i, f"http://{'shop' if i % 2 else 'news'}{i % 17}.example.{'net' if i % 2 else 'com'}/a{i}") for i in range(400)]
    rules = (urls.Rule("allow", "com", "/a1"), urls.Rule("block", "net", "/a1"))
    got = urls.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    free = [g for g in got if g.rule is None]
    assert len(free) > 100
    assert np.mean([(g.verdict == "allow") == (g.page_id % 2 == 0) for g in free]) > 0.95
