"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last few lines decides where a chunk ends, so a passage is cut alike
wherever it stands. Chunks of several lines that occur more than once anywhere are told apart by all their
bytes; the first occurrence stays and the others are cut out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import let
from marginalia.session import materialise

#: Lines that the rolling hash covers, and one line in how many ends a chunk.
WINDOW, SPREAD = 2, 3
#: Lines with something on them that a chunk must have to be cut out.
SOLID = 2
_BASE, _PRIME = 1_000_003, 2_147_483_647


def chunks(text: Column, window: int = WINDOW, spread: int = SPREAD) -> Column:
    """Array of (no, text, solid): consecutive lines up to each line where the rolling hash is a multiple of ``spread``."""
    def hashed(lines: Column) -> Column:
        return F.transform(lines, lambda line: F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long"))

    def rolled(hashes: Column, at: Column) -> Column:
        start = F.greatest(at - window + 1, F.lit(1))
        covered = F.slice(hashes, start, at - start + 1)
        return F.aggregate(covered, F.lit(0).cast("long"), lambda sofar, h: (sofar * _BASE + h) % _PRIME)

    def ends(lines: Column) -> Column:
        return let(hashed(lines), lambda hashes: F.filter(
            F.sequence(F.lit(1), F.size(lines)),
            lambda at: (at == F.size(lines)) | (rolled(hashes, at) % spread == 0)))

    def cut(lines: Column) -> Column:
        return let(ends(lines), lambda to: F.transform(F.sequence(F.lit(1), F.size(to)), lambda k: piece(lines, to, k)))

    def piece(lines: Column, to: Column, k: Column) -> Column:
        start = F.when(k == 1, F.lit(1)).otherwise(F.get(to, k - 2) + 1)
        return let(F.slice(lines, start, F.get(to, k - 1) - start + 1), lambda own: F.struct(
            k.alias("no"), F.array_join(own, "\n").alias("text"),
            F.size(F.filter(own, lambda line: F.trim(line) != "")).alias("solid")))

    return let(F.split(text, "\n", -1), cut)


def _documents(docs: DataFrame, window: int, spread: int) -> DataFrame:
    """_owner (documents without an id come last), _hash of the text, _chunks."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    last = F.shiftrightunsigned(F.xxhash64(text), 2) + (1 << 62)
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), last).alias("_owner"), F.xxhash64(text).alias("_hash"),
        F.col("doc_id").cast("long").alias("doc_id"), chunks(text, window, spread).alias("_chunks"))


def repeated_chunks(docs: DataFrame, window: int = WINDOW, spread: int = SPREAD, solid: int = SOLID) -> tuple[DataFrame, DataFrame]:
    """(places of chunks of several lines, the repeated ones with their first place).

    Chunks are grouped by key and text, so equal means equal in every byte; copies are merged before the
    shuffle. Places hold a digest instead of the text.
    """
    rows = _documents(docs, window, spread)
    each = rows.select("_owner", "_hash", F.explode(F.filter("_chunks", lambda c: c["solid"] >= solid)).alias("c"))
    named = each.select("_owner", "_hash", F.col("c.no").alias("no"), F.xxhash64("c.text").alias("key"), F.col("c.text").alias("text"))
    groups = materialise(
        named.groupBy("key", "text").agg(F.count("*").alias("n"), F.min("_owner").alias("first")).filter("n > 1")
        .select("key", _digest("text").alias("digest"), "first"), "line-groups")
    places = materialise(named.select("_owner", "_hash", "no", "key", _digest("text").alias("digest")), "line-places")
    first = places.join(groups, ["key", "digest"]).filter("_owner = first").groupBy("key", "digest").agg(
        F.min("first").alias("first"), F.min("no").alias("first_no"))
    return places, materialise(first, "line-first")


def _digest(column: str) -> Column:
    return F.unhex(F.md5(F.col(column).cast("binary")))


def cut_repeated_lines(docs: DataFrame, *, window: int = WINDOW, spread: int = SPREAD, solid: int = SOLID) -> DataFrame:
    """One row per document: doc_id, text without the repeated chunks, n_lines, n_chunks, n_cut (chunks).

    Of the occurrences of a chunk the one in the document of least id stays, there the first. Chunks with
    fewer than ``solid`` lines that are not blank are left alone. Null counts as an empty text, which has one
    empty line. Rows that share id and text are one document; documents without an id come after all others,
    in the order of a hash. Other columns are ignored; an empty table gives an empty result.
    """
    places, first = repeated_chunks(docs, window, spread, solid)
    again = places.join(first, ["key", "digest"]).filter(~((F.col("_owner") == F.col("first")) & (F.col("no") == F.col("first_no"))))
    cut = again.groupBy(F.col("_owner").alias("_o"), F.col("_hash").alias("_h")).agg(F.collect_set("no").alias("_cut"))
    # one plan at every size: the list of cuts grows with the documents, so it is never sent to all tasks
    both = _documents(docs, window, spread).join(
        cut.hint("merge"), (F.col("_owner") == F.col("_o")) & (F.col("_hash") == F.col("_h")), "left")
    gone = F.coalesce("_cut", F.array().cast("array<int>"))
    kept = F.when(F.size(gone) > 0, F.filter("_chunks", lambda c: ~F.array_contains(gone, c["no"]))).otherwise(F.col("_chunks"))
    lines = F.aggregate("_chunks", F.lit(0), lambda n, c: n + F.size(F.split(c["text"], "\n", -1)))
    return both.select(
        "doc_id", F.array_join(F.transform(kept, lambda c: c["text"]), "\n").alias("text"),
        lines.cast("long").alias("n_lines"), F.size("_chunks").cast("long").alias("n_chunks"),
        F.size(gone).cast("long").alias("n_cut"))


ORACLE = f"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents
), h as (
  select *, ('0x' || substr(md5(line), 1, 8))::bigint % {_PRIME} as x, ('0x' || substr(md5(line), 1, 8))::bigint as raw from l
), r as (
  select *, coalesce((lag(x) over w * {_BASE} + raw) % {_PRIME}, x) % {SPREAD} = 0 as stop from h window w as (partition by doc_id order by i)
), c as (
  select *, coalesce(sum(stop::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as run from r
), k as (
  select doc_id, run, string_agg(line, chr(10) order by i) as chunk, count(*) filter (trim(line) <> '') as solid, count(*) as lines
  from c group by 1, 2
), f as (
  select *, solid >= {SOLID} and row_number() over (partition by solid >= {SOLID}, chunk order by doc_id, run) > 1 as cut from k
)
select doc_id, sum(lines)::bigint as n_lines, count(*) as n_chunks, count(*) filter (cut) as n_cut,
       sha256(coalesce(string_agg(chunk, chr(10) order by run) filter (not cut), '')) as text_sha256
from f group by 1
"""
