"""Web pages: main text, URL key, duplicates by URL key."""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import let
from marginalia.operators.intake import mark_duplicates

# Page furniture that is not main text, dropped with its content.
DROPPED = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript", "head")
BLOCK_TAGS = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|table|tr|article|section|main|blockquote|pre|td|th)\b[^>]*>"
RAW = ("script", "style")
TRACKING = r"^(?:utm_[a-z]+|gclid|fbclid|ref)="


def dropped_pattern(tag: str) -> str:
    return rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>{'|\\z' if tag in RAW else ''})"


def decoded(text: Column) -> Column:
    """Character references as characters: numbers, and the names of HTML 4; unknown ones stay as they are."""
    names = F.create_map(*[F.lit(v) for n, c in name2codepoint.items() for v in (n, " " if n == "nbsp" else chr(c))],
                         F.lit("apos"), F.lit("'"))

    def character(body: Column) -> Column:
        code = F.when(F.rlike(body, F.lit("^#[xX]")), F.conv(F.substr(body, F.lit(3)), 16, 10)).otherwise(F.substr(body, F.lit(2)))
        number = code.cast("long")
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        made = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(~F.startswith(body, F.lit("#")), F.try_element_at(names, body)).when(valid, made).otherwise("\uFFFD")

    def replaced(piece: Column, at: Column) -> Column:
        body = F.substring_index(piece, ";", 1)
        shown = F.concat(character(body), F.substr(piece, F.length(body) + 2))
        return F.when(at == 0, piece).otherwise(F.coalesce(shown, F.concat(F.lit("&"), piece)))

    pieces = F.split(text, r"&(?=(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,8});)", -1)
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, replaced), "")).otherwise(text)


def main_text(html: Column) -> Column:
    """Visible text of a page: furniture and comments removed, block tags as line breaks, references decoded.

    A comment, script or style that is never closed takes the rest of the page with it.
    """
    bare = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")
    bare = reduce(lambda t, tag: F.regexp_replace(t, dropped_pattern(tag), ""), DROPPED, bare)
    lines = F.regexp_replace(F.regexp_replace(bare, BLOCK_TAGS, "\n"), r"<[^>]*>", "")
    tidy = F.regexp_replace(F.regexp_replace(let(lines, decoded), r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n")
    return F.trim(F.regexp_replace(tidy, r"^\n+|\n+$", ""))


# Marks around the text of links; references to these characters are unknown ones.
OPEN, CLOSE = "\x02", "\x03"


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, " ", -1), lambda w: w != ""))


def segments(html: Column, dropped: tuple[str, ...] = DROPPED) -> Column:
    """The runs of text between block tags, in order: text, words, and how many of these stand in links.

    The tags ``dropped`` go with their content. A link may hold block tags; one that is not closed ends where the
    next begins. Runs without words are left out.
    """
    bare = F.regexp_replace(F.translate(html, OPEN + CLOSE, ""), r"(?s)<!--.*?(?:-->|\z)", "")
    bare = reduce(lambda t, tag: F.regexp_replace(t, dropped_pattern(tag), ""), dropped, bare)
    marked = F.regexp_replace(F.regexp_replace(bare, r"(?i)<a\b[^>]*>", OPEN), r"(?i)</a\s*>", CLOSE)
    lines = F.regexp_replace(F.regexp_replace(marked, BLOCK_TAGS, "\n"), r"<[^>]*>", "")
    lines = F.regexp_replace(lines, r"&#(?:0*[23]|[xX]0*[23]);", "\uFFFD")

    def in_lines(piece: Column, at: Column) -> Column:
        link = F.substring_index(piece, CLOSE, 1)
        rest = F.translate(F.substr(piece, F.length(link) + 2), CLOSE, "")
        whole = F.concat(F.lit(OPEN), F.replace(link, F.lit("\n"), F.lit(f"{CLOSE}\n{OPEN}")), F.lit(CLOSE), rest)
        return F.when(at == 0, F.translate(piece, CLOSE, "")).otherwise(whole)

    def segment(line: Column) -> Column:
        tidy = F.trim(F.regexp_replace(F.translate(line, OPEN + CLOSE, ""), r"[ \t\r]+", " "))
        links = F.array_join(F.regexp_extract_all(line, F.lit(f"{OPEN}([^{CLOSE}]*){CLOSE}"), 1), " ")
        linked = _words(F.regexp_replace(links, r"[ \t\r]+", " "))
        return F.struct(tidy.alias("text"), _words(tidy).alias("words"), linked.alias("linked"))

    split = let(let(lines, decoded), lambda t: F.split(F.array_join(F.transform(F.split(t, OPEN, -1), in_lines), ""), "\n", -1))
    return F.filter(F.transform(split, segment), lambda s: s["words"] > 0)


def _is_content(at: Column, before: Column, after: Column) -> Column:
    """The published rule of shallow text features (words and link density of a segment and its neighbours)."""
    # fixed values of the rule: densities 1/3 and 5/9; 16, 15, 4, 40 and 17 words
    words, previous, following = at["words"], F.coalesce(before["words"], F.lit(0)), F.coalesce(after["words"], F.lit(0))
    after_text = F.coalesce(before["linked"] * 9 <= before["words"] * 5, F.lit(True))
    beside_text = (words > 16) | (following > 15) | (previous > 4)
    beside_links = (words > 40) | (following > 17)
    return (at["linked"] * 3 <= words) & F.when(after_text, beside_text).otherwise(beside_links)


def article_text(html: Column, dropped: tuple[str, ...] = DROPPED) -> Column:
    """The segments of a page that are its article, one a line: judged by words and links, not by their tags.

    NULL stays NULL; a page without an article gives an empty text.
    """
    kept = let(segments(html, dropped), lambda s: F.filter(
        s, lambda x, i: _is_content(x, F.get(s, i - 1), F.get(s, i + 1))))
    return F.array_join(F.transform(kept, lambda x: x["text"]), "\n")


def url_key(url: Column) -> Column:
    """Scheme-free key: lower-case host without default port, path without trailing slash, sorted query
    without tracking parameters, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^(?i)https?://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?i)https?://([^/?#:]*)", 1))


def web_pages(pages: DataFrame) -> DataFrame:
    """page_id, url_key, main_text, is_duplicate; the smallest page id of a key is the original."""
    keyed = pages.select("page_id", url_key(F.col("url")).alias("url_key"), main_text(F.col("html")).alias("main_text"))
    firsts = mark_duplicates(keyed.select("page_id", "url_key"), ["url_key"], [], "page_id")
    marked = firsts.select("page_id", F.col("duplicate_of").isNotNull().alias("is_duplicate"))
    return keyed.join(marked, "page_id")


def same_site(pages: DataFrame, root: str, max_depth: int) -> DataFrame:
    """Pages of the start page's host that lie at most ``max_depth`` path steps deep."""
    path = F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"^(?i)https?://[^/]*(/.*)?$", 1)
    depth = F.size(F.filter(F.split(path, "/", -1), lambda s: s != ""))
    return pages.filter((host_of(F.col("url")) == host_of(F.lit(root))) & (depth <= max_depth))
