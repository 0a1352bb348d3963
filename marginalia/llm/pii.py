"""Personal data: certain spans by pattern, and more by boosted trees over candidate spans.

Generators propose overlapping candidates with high recall. Gradient-boosted trees judge them by their
format and their context, and a threshold for each kind, calibrated on candidates that the trees have not
seen, selects those to redact. What the certain patterns find teaches the trees and always stays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import materialise

KINDS = ("email", "ip", "card", "phone")
#: Characters before a candidate that are its context.
CONTEXT = 24
#: Matches that are put in their places together.
RUN = 128
TREES, DEPTH = 10, 3
#: Share of the selected candidates of a kind that certain patterns confirm, at least, when calibrated.
PRECISION = 0.95

# The certain patterns. Possessive groups need no stack and no second try; look-behinds keep each start from
# running over the same characters again. Both find what the plain patterns find from the left.
CERTAIN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a loose pattern to be tried, and for a certain one.
NEEDS = {
    "email": r"@|[(\[]at[)\]]",
    "ip": r"[0-9A-Fa-f][.:][0-9A-Fa-f]",
    "card": r"[0-9][\x20./-]{0,2}[0-9][\x20./-]{0,2}[0-9]",
    "phone": r"[0-9][\x20().-]{0,2}[0-9][\x20().-]{0,2}[0-9]",
}
CERTAIN_NEEDS = NEEDS | {"phone": r"\+[0-9]"}
LOOSE = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++\x20?(?:@|[(\[]at[)\]])\x20?[\p{L}\p{N}-]++"
             r"(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[\p{L}\p{N}-]++)++",
    "ip": r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}+|[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}+)(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}+(?![0-9])",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP_PARTS = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
_WORDS = r"(?i)(?:mail|phone|tel|mobile|call|fax|card|visa|account|pay|addr|host|server|ip)\b[^\p{L}]*$"


class Trees(NamedTuple):
    """A tree is a number (a leaf) or (feature, threshold, left, right); thresholds are per kind."""

    trees: list
    weights: list[float]
    thresholds: dict[str, float]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of a certain pattern counts."""
    if kind == "ip":
        return F.rlike(value, F.lit(_IP_PARTS))
    if kind == "card":
        return F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` is worked out once; the result is copied, so not for each step of a fold."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _matches(text: Column, pattern: str, kind: str, context: bool) -> Column:
    """The matches from the left as array of (start, kind, end, value), by code points.

    Lengths of what stands between matches and of the matches add up to their places. With ``context`` also what
    stands before a match, ``CONTEXT`` characters at most, and the character after it: no text is searched for them.
    """
    cut = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def spans(cut: Column) -> Column:
        gaps, found = cut["gaps"], cut["found"]
        between = F.slice(gaps, F.lit(1), F.size(found))
        steps = F.zip_with(between, found, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
        if context:
            following = F.zip_with(
                F.slice(gaps, F.lit(2), F.size(found)), F.slice(found, F.lit(2), F.size(found)),
                lambda gap, value: F.substr(F.concat(F.left(gap, F.lit(1)), F.coalesce(F.left(value, F.lit(1)), F.lit(""))),
                                            F.lit(1), F.lit(1)))
            steps = F.zip_with(steps, following, lambda step, after: F.struct(
                step["gap"].alias("gap"), step["value"].alias("value"), after.alias("after")))
        return F.when(F.size(found) > 0, _let(steps, walked)).otherwise(_no_spans(context))

    def walked(steps: Column) -> Column:
        """Run by run, each from where the one before ended, so that no long array grows span by span."""
        start = F.struct(F.lit(0).alias("at"), _no_spans(context).alias("spans"), F.lit("").alias("tail"))

        def run(done: Column, number: Column) -> Column:
            before = F.element_at(done, F.lit(-1))
            first, last = number * RUN, F.least((number + 1) * RUN, F.size(steps)) - 1
            ahead = F.struct(before["at"].alias("at"), _no_spans(context).alias("spans"), before["tail"].alias("tail"))
            return F.concat(done, F.array(F.aggregate(F.sequence(first, last), ahead, lambda so_far, i: put(so_far, F.get(steps, i)))))

        runs = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int"))
        return F.aggregate(runs, F.array(start), run, lambda done: F.flatten(F.transform(done, lambda r: r["spans"])))

    def put(so_far: Column, step: Column) -> Column:
        start = so_far["at"] + F.length(step["gap"])
        end = start + F.length(step["value"])
        made = [start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), step["value"].alias("value")]
        tail = so_far["tail"]
        if context:
            before = F.substr(F.concat(tail, step["gap"]), F.lit(-CONTEXT))
            made += [before.alias("before"), step["after"].alias("after")]
            tail = F.substr(F.concat(before, step["value"]), F.lit(-CONTEXT))
        return F.struct(end.alias("at"), F.concat(so_far["spans"], F.array(F.struct(*made))).alias("spans"), tail.alias("tail"))

    return _let(cut, spans)


def _no_spans(context: bool = False) -> Column:
    more = ",before:string,after:string" if context else ""
    return F.expr(f"cast(array() as array<struct<start:int,kind:int,end:int,value:string{more}>>)")


def _found(text: Column, patterns: dict[str, str], needs: dict[str, str], kind: str, context: bool = False) -> Column:
    return F.when(F.rlike(text, F.lit(needs[kind])), _matches(text, patterns[kind], kind, context)).otherwise(_no_spans(context))


def certain_spans(text: Column) -> Column:
    """The certain spans of a text: array of (start, kind, end, value) by start, then kind."""
    def kept(kind: str) -> Column:
        return F.filter(_found(text, CERTAIN, CERTAIN_NEEDS, kind), lambda s: _holds(kind, s["value"]))

    return F.array_sort(F.concat(*[kept(kind) for kind in KINDS]))


def candidate_spans(text: Column) -> Column:
    """What the generators propose, with its context, kind by kind; spans of different kinds may overlap."""
    return F.concat(*[_found(text, LOOSE, NEEDS, k, context=True) for k in KINDS])


def _count(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)).cast("double")


def _kind_of(character: Column) -> Column:
    """0 nothing, 1 blank, 2 letter, 3 digit, 4 sign."""
    return (F.when(character == "", 0.0).when(F.rlike(character, F.lit(r"\s")), 1.0)
            .when(F.rlike(character, F.lit(r"\p{L}")), 2.0).when(F.rlike(character, F.lit(r"\p{N}")), 3.0).otherwise(4.0))


def features(span: Column) -> dict[str, Column]:
    """Format and context of a candidate, as numbers."""
    value, digits = span["value"], _digits(span["value"])
    return {
        "kind": span["kind"].cast("double"),
        "length": F.length(value).cast("double"),
        "digits": F.length(digits).cast("double"),
        "letters": _count(value, r"\p{L}"),
        "beyond_ascii": _count(value, r"[^\x00-\x7F]"),
        "blanks": _count(value, r"\x20"),
        "dots": _count(value, r"\."),
        "signs": _count(value, r"[()\[\]/:-]"),
        "plus": F.startswith(value, F.lit("+")).cast("double"),
        "at": F.contains(value, F.lit("@")).cast("double"),
        "check_digit": F.coalesce(F.call_function("luhn_check", digits).cast("double"), F.lit(0.0)),
        "bytes": F.rlike(value, F.lit(_IP_PARTS)).cast("double"),
        "before": _kind_of(F.substr(span["before"], F.lit(-1))),
        "after": _kind_of(span["after"]),
        "named": F.rlike(span["before"], F.lit(_WORDS)).cast("double"),
    }


#: The names of the features, in their order.
FEATURES = ("kind", "length", "digits", "letters", "beyond_ascii", "blanks", "dots", "signs", "plus", "at", "check_digit",
            "bytes", "before", "after", "named")


def _by_kind(spans: Column) -> Column:
    """The spans of each kind, from the left; those of one kind never overlap."""
    def of(number: int) -> Column:
        return F.filter(spans, lambda s: s["kind"] == number)

    return F.struct(*[of(k).alias(kind) for k, kind in enumerate(KINDS)])


def _leading(spans: Column, holds: Callable[[Column], Column]) -> Column:
    """How many spans ``holds`` is true of, if it is so up to some place: halving steps, not a look at each."""
    def halve(range_: Column, _: Column) -> Column:
        middle = F.shiftright(range_["low"] + range_["high"], 1)
        right = F.coalesce(holds(F.get(spans, middle)), F.lit(False))
        return F.when(right, F.struct((middle + 1).alias("low"), range_["high"].alias("high"))).otherwise(
            F.struct(range_["low"].alias("low"), middle.alias("high")))

    steps = F.array_repeat(F.lit(0), F.length(F.bin(F.size(spans))))
    start = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))
    return F.when(F.size(spans) > 0, F.aggregate(steps, start, halve, lambda done: done["low"])).otherwise(F.lit(0))


def _meets(span: Column, spans: Column) -> Column:
    """Whether a span overlaps any of one kind's: the last that starts before its end, or none."""
    last = F.get(spans, _leading(spans, lambda s: s["start"] < span["end"]) - 1)
    return F.coalesce(last["end"] > span["start"], F.lit(False))


def _tree(node) -> object:
    """A fitted tree as nested tuples."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def _grown(tree, values: list[Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, level, left, right = tree
    return F.when(values[feature] <= level, _grown(left, values)).otherwise(_grown(right, values))


def probability(model: Trees, values: list[Column]) -> Column:
    """The boosted trees as one expression."""
    margin = sum((w * _grown(t, values) for t, w in zip(model.trees, model.weights)), F.lit(0.0))
    return 1 / (1 + F.exp(-2 * margin))


def train(docs: DataFrame, *, precision: float = PRECISION) -> Trees | None:
    """Boosted trees fitted on the candidates of all documents, however many a document has.

    A candidate is positive when it overlaps a certain span of its kind. Every fourth document, by a hash of id and
    text, calibrates instead: the threshold of a kind is the least score at or above which at least ``precision`` of
    its candidates there are positive. A kind without such a score is never selected. None without both sorts of
    candidates.
    """
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    spans = texts.select("text", "h", candidate_spans(F.col("text")).alias("candidates"))

    def judged(certain: Column) -> Column:
        def row(c: Column) -> Column:
            known = F.lit(False)
            for k, kind in enumerate(KINDS):
                known = F.when(c["kind"] == k, _meets(c, certain[kind])).otherwise(known)
            return F.struct(known.cast("double").alias("label"), *[v.alias(k) for k, v in features(c).items()])

        return F.transform("candidates", row)

    each = F.when(F.size("candidates") > 0, _let(certain_spans(F.col("text")), lambda s: _let(_by_kind(s), judged)))
    rows = materialise(spans.select("h", F.explode(each).alias("c")).select(
        "c.label", (F.pmod("h", F.lit(4)) == 3).alias("checked"), *[f"c.{k}" for k in FEATURES]), "pii-candidates")
    if rows.filter("not checked").select("label").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11).fit(rows.filter("not checked"))
    scored = fitted.transform(rows.filter("checked")).select(
        F.col("kind").cast("int").alias("kind"), "label",
        (F.floor(vector_to_array("probability")[1] * 1e6) / 1e6 - 1e-9).alias("score"))  # never above the score itself
    steps = scored.groupBy("kind", "score").agg(F.sum("label").alias("hits"), F.count("*").alias("n")).orderBy(
        "kind", F.desc("score")).collect()
    thresholds: dict[str, float] = {}
    totals: dict[str, tuple[float, int]] = {}
    for step in steps:
        kind = KINDS[step.kind]
        hits, n = totals.get(kind, (0.0, 0))
        totals[kind] = hits, n = hits + step.hits, n + step.n
        if hits / n >= precision:
            thresholds[kind] = step.score
    trees = [_tree(t._java_obj.rootNode()) for t in fitted.trees]
    return Trees(trees, [float(w) for w in fitted.treeWeights], thresholds)


def _selected(_: Column, candidates: Column, certain: Column, model: Trees) -> Column:
    """The candidates that overlap no certain span and reach the threshold of their kind."""
    def judged(span: Column) -> Column:
        return F.struct(span["start"].alias("start"), span["kind"].alias("kind"), span["end"].alias("end"),
                        probability(model, list(features(span).values())).alias("score"))

    def free(known: Column) -> Column:
        taken = lambda c: reduce(or_, [_meets(c, known[kind]) for kind in KINDS])
        return F.filter(candidates, lambda c: ~taken(c))

    def reaches(c: Column) -> Column:
        least = F.lit(2.0)
        for kind, t in model.thresholds.items():
            least = F.when(c["kind"] == KINDS.index(kind), F.lit(t)).otherwise(least)
        return c["score"] >= least

    return F.filter(F.transform(_let(_by_kind(certain), free), judged), reaches)


def _best(spans: Column) -> Column:
    """Of overlapping spans the one with the higher score, then the longer, the earlier, the first kind.

    What overlaps a span is a stretch of each kind; all stretches together are at most as long as the kinds.
    """
    def rank(s: Column) -> Column:
        return F.struct(s["score"], s["end"] - s["start"], -s["start"], -s["kind"])

    def beaten(c: Column, others: Column) -> Column:
        stretch = F.struct(_leading(others, lambda s: s["end"] <= c["start"]).alias("first"),
                           (_leading(others, lambda s: s["start"] < c["end"]) - 1).alias("last"))
        return _let(stretch, lambda r: F.when(r["first"] <= r["last"], F.exists(
            F.sequence(r["first"], r["last"]), lambda i: rank(F.get(others, i)) > rank(c))).otherwise(F.lit(False)))

    return _let(_by_kind(spans), lambda known: F.filter(
        spans, lambda c: ~reduce(or_, [beaten(c, known[kind]) for kind in KINDS])))


def of_kind(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def written(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    bare = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_join(F.transform(F.array_sort(bare), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, certain and added, arrays of (start, kind, end) in code points, end exclusive.

    ``kind`` is the place in KINDS. ``certain`` are the matches, from the left for each kind, that hold: parts
    of addresses at most 255, 12 to 19 digits passing the check sum, 9 to 15 digits of phone numbers.
    ``added`` are candidates that the trees select; none overlaps a certain span or a better added one.

    Whole texts are searched; null and empty ones have no spans. Repeated rows each give a row; other columns
    are ignored; an empty table gives an empty result.
    """
    model = train(docs, **how)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    certain = F.when(F.rlike("text", F.lit(r"[0-9@]")), certain_spans(F.col("text"))).otherwise(_no_spans())
    found = rows.withColumn("certain", certain)
    bare = "array<struct<start:int,kind:int,end:int,score:double>>"
    if model and model.thresholds:
        found = found.withColumn("candidates", F.when(
            F.rlike("text", F.lit(r"[0-9@]|[(\[]at[)\]]")), candidate_spans(F.col("text"))).otherwise(_no_spans(context=True)))
        added = F.when(F.size("candidates") > 0, _selected(F.col("text"), F.col("candidates"), F.col("certain"), model))
        found = found.withColumn("added", F.coalesce(added, F.expr(f"cast(array() as {bare})")))
        found = found.withColumn("added", F.when(F.size("added") > 1, _best(F.col("added"))).otherwise(F.col("added")))
    else:
        found = found.withColumn("added", F.expr(f"cast(array() as {bare})"))
    plain = [F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias(c)
             for c in ("certain", "added")]
    return found.select("doc_id", *plain)


def redacted(docs: DataFrame, found: DataFrame, mark: str = "[{}]") -> DataFrame:
    """doc_id and text of the documents, each span of ``found`` replaced by its kind's mark.

    Both must have one row per doc_id. Spans inside or across an earlier one are covered by its mark.
    """
    both = docs.select("doc_id", "text").join(found, "doc_id")
    names = F.array(*[F.lit(mark.format(k)) for k in KINDS])

    def put(so_far: Column, s: Column) -> Column:
        inside = s["start"] < so_far["at"]
        kept = F.substr(F.col("text"), so_far["at"] + 1, F.greatest(s["start"] - so_far["at"], F.lit(0)))
        text = F.when(inside, so_far["text"]).otherwise(F.concat(so_far["text"], kept, F.element_at(names, s["kind"] + 1)))
        return F.struct(F.greatest(so_far["at"], s["end"]).alias("at"), text.alias("text"))

    spans = F.array_sort(F.concat("certain", "added"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    text = F.aggregate(spans, start, put, lambda done: F.concat(done["text"], F.substr(F.col("text"), done["at"] + 1)))
    return both.select("doc_id", text.alias("text"))
