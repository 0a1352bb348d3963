"""Text expressions: normalising, token estimate, sentences, markers, masking.

All of them are Column expressions, so they run in the JVM inside the stage that uses them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------
# Characters that are invisible on screen: zero-width space, non-joiner, joiner, word joiner,
# byte-order mark, soft hyphen.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
# What counts as white space when text is stripped or collapsed.
SPACE = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
# Ranges that cost one token per character: CJK punctuation, kana, extension A, unified ideographs,
# hangul syllables, compatibility ideographs, full-width forms.
CJK = r"[\u3000-\u303F\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uAC00-\uD7AF\uF900-\uFAFF\uFF00-\uFFEF]"
CHARS_PER_TOKEN = 4
# Sentence boundary: after CJK stops and ! ? ; at once, after . ! ? with white space, at newlines.
SENTENCE = rf"(?<=[。！？；!?;]){SPACE}*|(?<=[.!?]){SPACE}+|\n+"
# Unreadable: the replacement character, control characters, unassigned code points.
UNREADABLE = r"[\uFFFD\p{Cc}\p{Cn}]"
# Citation marker in an answer.
MARKER = r"(?U)\[c:([^\]\s]+)\]"
# Masking: sensitive key parts, the keys that are counts and not secrets, and the patterns in the
# order in which they apply (URL credentials, key=value, e-mail, national id, phone, digit runs). The
# third entry is text without which a pattern cannot match, so most texts skip it.
SENSITIVE_PARTS = (
    "password", "passwd", "secret", "token", "api_key", "apikey",
    "authorization", "cookie", "credential", "private_key",
)
COUNT_KEYS = ("prompt_tokens", "completion_tokens", "total_tokens", "token_count", "max_tokens")
REDACTED = "***"
MASKS = (
    (r"(?i)(?U)\b([a-z][a-z0-9+.\-]*://)([^\s/:@]*):([^\s/@]*)@", "$1$2:***@", "://"),
    (
        r"(?i)((?:" + "|".join(SENSITIVE_PARTS) + r")[A-Za-z0-9_.\-]*)"
        rf"([\"']?{SPACE}*[=:]{SPACE}*)([\"']?)(?:bearer|basic|token)?{SPACE}*[^&\"',}}}}）{SPACE[1:-1]}]+",
        "$1$2$3***", None,
    ),
    (r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+", "<email>", "@"),
    (r"(?<![0-9A-Za-z])[A-Z][12]\p{Nd}{8}(?![0-9A-Za-z])", "<id>", None),
    (r"(?<![0-9A-Za-z])09\p{Nd}{2}-?\p{Nd}{3}-?\p{Nd}{3}(?![0-9A-Za-z])", "<phone>", "09"),
    (r"(?<![0-9A-Za-z])\p{Nd}{13,19}(?![0-9A-Za-z])", "<redacted>", None),
)
# ------------------------------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``; a lambda body would repeat a plain expression."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Drop white space at both ends (any Unicode white space, not only blanks)."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    """Whether nothing is left of the text when it is stripped."""
    return ~text.rlike(f"(?!{SPACE})(?s:.)")


def without_invisible(text: Column) -> Column:
    return F.translate(text, INVISIBLE, "")


def match_text(text: Column) -> Column:
    """The form two lines are compared in: no invisible characters, white space collapsed.

    Single blanks, which most white space is, are no match and need no replacement.
    """
    return F.trim(F.regexp_replace(without_invisible(text), rf"{SPACE}{{2,}}|(?!\x20){SPACE}", " "))


def clean_text(text: Column) -> Column:
    """Tidy white space without touching the wording."""
    tidy = F.regexp_replace(without_invisible(text), r"(?m)[ \t]+(?=\n|\z)", "")
    return strip(F.regexp_replace(tidy, r"\n{3,}", "\n\n"))


def count_matches(text: Column, char_class: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, char_class, ""))


def token_estimate(text: Column) -> Column:
    """One token per CJK character, one per four others, rounded up."""
    cjk = count_matches(text, CJK)
    return (cjk + F.ceil((F.length(text) - cjk) / CHARS_PER_TOKEN)).cast("int")


def unreadable_ratio(text: Column) -> Column:
    return count_matches(text, UNREADABLE) / F.length(text)


def sentences(text: Column) -> Column:
    """Sentence array; text without a non-blank sentence is its own single sentence."""
    parts = F.filter(F.split(text, SENTENCE, -1), lambda s: F.length(strip(s)) > 0)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def hard_split(sentence: Column, budget: Column) -> Column:
    """Cut a sentence that is over budget into pieces of equal character length."""
    length = F.length(sentence)
    ratio = F.greatest(token_estimate(sentence), F.lit(1)) / length
    step = F.greatest(F.floor(budget / ratio).cast("int"), F.lit(1))
    pieces = let(
        step,
        lambda n: F.transform(
            F.sequence(F.lit(1), length, n), lambda at: F.substring(sentence, at, n)
        ),
    )
    return F.when(length > 0, pieces).otherwise(F.array().cast("array<string>"))


def block_markdown(kind: Column, text: Column, depth: Column) -> Column:
    """One block as Markdown; ``depth`` is the length of its heading path."""
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.least(depth + 1, F.lit(6))), F.lit(" "), text))
        .when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(kind == "caption", F.concat(F.lit("*"), text, F.lit("*")))
        .otherwise(text)
    )


def snippet(content: Column, limit: int = 240) -> Column:
    body = strip(content)
    return F.when(F.length(body) > limit, F.concat(F.substring(body, 1, limit), F.lit("…"))).otherwise(body)


def markers(answer: Column) -> Column:
    return F.regexp_extract_all(answer, F.lit(MARKER), F.lit(1))


def mask(text: Column) -> Column:
    """Free-text masking, patterns applied in their fixed order."""
    def apply(done: Column, rule: tuple) -> Column:
        pattern, shown, needle = rule
        if needle is None:
            return F.regexp_replace(done, pattern, shown)
        return let(done, lambda t: F.when(F.contains(t, F.lit(needle)), F.regexp_replace(t, pattern, shown)).otherwise(t))

    return reduce(apply, MASKS, text)


#: A whole key name that is sensitive, for Java's and Python's matchers alike.
SENSITIVE_KEY = rf"(?is)^(?!(?:{'|'.join(COUNT_KEYS)})$).*(?:{'|'.join(SENSITIVE_PARTS)})"


def is_sensitive_key(key: Column) -> Column:
    return key.rlike(SENSITIVE_KEY)


def sensitive_kinds(text: Column) -> Column:
    """Which masking rules would fire on a text, in rule order (mark only, nothing is rewritten)."""
    names = ("url_credentials", "key_value", "email", "national_id", "phone", "digit_run")
    flags = [F.when(text.rlike(rule[0]), F.lit(name)) for name, rule in zip(names, MASKS)]
    return F.filter(F.array(*flags), lambda kind: kind.isNotNull())
