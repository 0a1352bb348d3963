"""Registered structured-source and language queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import clean as C
from marginalia.operators import language as G
from marginalia.plans import fixtures as fx
from marginalia.plans import text as cleaning
from marginalia.plans.text import strip_sql
from marginalia.session import prepare
from marginalia.sources import layout as Y
from marginalia.sources import web as H
from marginalia.sources.markdown import markdown_blocks
from marginalia.sources.tables import table

WORDS = r"[^\p{L}\p{N} ]"

EXTRA = cleaning.EXTRA | {
    "mx_line": rf"""
select doc_id, i, 'w ' || trim(regexp_replace(l, '[^\p{{L}}\p{{N}} ]', '', 'g')) as w, (i + length(l)) % 6 as k from (
  select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents)""",
    "mx_block": """
select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as block_order,
  case k when 0 then 'heading' when 1 then 'code' when 2 then 'table' when 4 then 'heading' else 'paragraph' end as type,
  case k when 2 then '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || trim(w) || ' | x |' when 3 then case when i % 2 = 0 then '- ' || trim(w) || chr(10) || '- second' else '* ' || trim(w) || chr(10) || '* second' end
    else trim(w) end as text, case k when 0 then 1 + i % 3 when 4 then 2 end as level
from mx_line where k <> 5 or i % 2 = 0""",
    "mx_path": """
select a.doc_id, a.block_order, string_agg(h.text, ' > ' order by h.block_order) as path
from mx_block a join mx_block h on h.doc_id = a.doc_id and h.type = 'heading' and h.block_order <= a.block_order
  and (a.type <> 'heading' or h.block_order < a.block_order and h.level < a.level)
where not exists (select 1 from mx_block s where s.doc_id = a.doc_id and s.type = 'heading'
  and s.block_order > h.block_order and s.block_order <= a.block_order and s.level <= h.level)
group by 1, 2""",
    "px_line": f"""
select doc_id, i::int as line_no, (1 + i // 30)::int as page, {strip_sql('l')} as text,
  case when i % 10 = 0 and length(l) <= 60 then 18.0 when i % 25 = 13 then 14.0 when i % 50 = 20 then 9.0 else 10.0 end::double as size,
  (100 + (i % 30) * 14 + case when i % 9 >= 4 then 8 else 0 end)::double as top, 12.0::double as height from (
  select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents)
where {strip_sql('l')} <> ''""",
    "px_outline": """
select doc_id, regexp_replace(text, '\\s+', ' ', 'g') as title, arg_min(1 + (line_no // 20) % 2, line_no) as level from px_line
where doc_id % 5 = 0 and line_no % 20 = 0 group by 1, 2""",
    "px_body": """
select doc_id, size as body from (select doc_id, size, sum(length(text)) as c from px_line group by 1, 2)
qualify row_number() over (partition by doc_id order by c desc, size) = 1""",
    "px_size": """
select doc_id, size, dense_rank() over (partition by doc_id order by size desc) as level from (
  select distinct l.doc_id, l.size from px_line l join px_body b using (doc_id) where l.size >= b.body * 1.2) where doc_id not in (select doc_id from px_outline)""",
    "px_item": """
select l.doc_id, 0 as kind, line_no, page, top, text, l.size, height, coalesce(o.level, s.level) as level from px_line l
left join px_outline o on o.doc_id = l.doc_id and o.title = regexp_replace(l.text, '\\s+', ' ', 'g') left join px_size s on s.doc_id = l.doc_id and s.size = l.size
union all select distinct doc_id, 1, 0, page, 130.0, 'T' || page, null, null, null from px_line where doc_id % 7 = 0""",
    "px_group": """
select *, sum(brk::int) over (partition by doc_id order by page, top, kind, line_no) - 1 as block_order from (
  select *, kind = 1 or level is not null or coalesce(lag(kind = 1 or level is not null) over w, true) or coalesce(page <> lag(page) over w or size <> lag(size) over w
    or top - lag(top) over w > greatest(lag(height) over w, height, 1.0) * 1.6, false) as brk
  from px_item window w as (partition by doc_id order by page, top, kind, line_no))""",
    "px_block": """
select doc_id, block_order::bigint as block_order, case when max(kind) = 1 then 'table' when max(level) is not null then 'heading' else 'paragraph' end as type,
  string_agg(text, chr(10) order by page, top, kind, line_no) as text, min(page) as page, max(level) as level from px_group group by 1, 2""",
    "px_path": """
select a.doc_id, a.block_order, string_agg(h.text, ' > ' order by h.block_order) as path
from px_block a join px_block h on h.doc_id = a.doc_id and h.type = 'heading' and h.block_order <= a.block_order
  and (a.type <> 'heading' or h.block_order < a.block_order and h.level < a.level)
where not exists (select 1 from px_block s where s.doc_id = a.doc_id and s.type = 'heading'
  and s.block_order > h.block_order and s.block_order <= a.block_order and s.level <= h.level)
group by 1, 2""",
    "wx_page": r"""
select page_id, url, regexp_replace(regexp_replace(url, '#.*$', ''), '^(?i)https?://', '') as bare, html from pages""",
    "wx_key": r"""
select page_id, host || path || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end as url_key, html from (
  select page_id, html, regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', '') as host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') as path,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(lower(p), '^(utm_[a-z]+|gclid|fbclid|ref)='))) as q from wx_page)""",
}


def lines(spark, d):
    return table(prepare(spark), d, "documents").select("doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("i", "l"))


def markdown_docs(spark, d):
    """Every line of a document becomes one Markdown construct; constructs are separated by blank lines."""
    rows = lines(spark, d)
    w = F.concat(F.lit("w "), F.trim(F.regexp_replace("l", WORDS, "")))
    k = (F.col("i") + F.length("l")) % 6
    bullet = F.when(F.col("i") % 2 == 0, "-").otherwise("*")
    md = (
        F.when(k == 0, F.concat(F.repeat(F.lit("#"), 1 + F.col("i") % 3), F.lit(" "), w, F.lit(" ##")))
        .when(k == 1, F.concat(F.lit("```py\n"), w, F.lit("\n```")))
        .when(k == 2, F.concat(F.lit("| a | b |\n| --- | --- |\n| "), F.trim(w), F.lit(" | x |")))
        .when(k == 3, F.concat(bullet, F.lit(" "), F.trim(w), F.lit("\n"), bullet, F.lit(" second"))).when(k == 4, F.concat(F.trim(w), F.lit("\n---")))
        .otherwise(F.when(F.col("i") % 2 == 0, F.trim(w)).otherwise("***"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("i", md.alias("m"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda s: s["m"]), "\n\n").alias("text"))


def src_05_markdown_blocks(spark, d):
    out = markdown_blocks(markdown_docs(spark, d))
    return out.select("doc_id", "block_order", "type", F.trim("text").alias("text"), F.array_join("heading_path", " > ").alias("path"))


def page_lines(spark, d):
    from marginalia.functions.text import strip
    i = F.col("i")
    size = F.when((i % 10 == 0) & (F.length("l") <= 60), 18.0).when(i % 25 == 13, 14.0).when(i % 50 == 20, 9.0).otherwise(10.0)
    top = (100 + (i % 30) * 14 + F.when(i % 9 >= 4, 8).otherwise(0)).cast("double")
    rows = lines(spark, d).select("doc_id", i.alias("line_no"), (1 + F.floor(i / 30)).cast("int").alias("page"), strip(F.col("l")).alias("text"), size.alias("size"), top.alias("top"), F.lit(12.0).alias("height"))
    return rows.filter(F.col("text") != "")


def src_07_page_lines_to_blocks(spark, d):
    rows = page_lines(spark, d)
    outline = rows.filter((F.col("doc_id") % 5 == 0) & (F.col("line_no") % 20 == 0)).select(
        "doc_id", F.col("line_no").alias("entry_no"), F.col("text").alias("title"), (1 + F.floor(F.col("line_no") / 20) % 2).cast("int").alias("level"))
    tables = rows.filter(F.col("doc_id") % 7 == 0).select("doc_id", "page").distinct().select(
        "doc_id", "page", F.lit(130.0).alias("top"), F.concat(F.lit("T"), "page").alias("text"))
    out = Y.line_blocks(rows, tables, outline)
    return out.select("doc_id", "block_order", "type", "text", "page", F.array_join("heading_path", " > ").alias("path"))


def src_08_outside_tables(spark, d):
    rows = page_lines(spark, d).select(
        "doc_id", "line_no", "page", (F.col("line_no") % 7 * 40).cast("double").alias("x0"), (F.col("line_no") % 7 * 40 + F.length("text")).cast("double").alias("x1"),
        "top", (F.col("top") + F.col("height")).alias("bottom"))
    pages = rows.select("doc_id", "page").distinct()
    boxes = pages.select("doc_id", "page", F.explode(F.array(
        F.struct(F.lit(0.0).alias("x0"), F.lit(100.0).alias("top"), F.lit(90.0).alias("x1"), F.lit(200.0).alias("bottom")),
        F.struct(F.lit(120.0).alias("x0"), F.lit(150.0).alias("top"), F.lit(300.0).alias("x1"), F.lit(420.0).alias("bottom")))).alias("b")).select("doc_id", "page", "b.*")
    return Y.outside_tables(rows, boxes).select("doc_id", "line_no")


def sheet_rows(spark, d):
    """A sheet per supplier: one row per line item, ordered by item; every ninth line number is empty."""
    li = table(prepare(spark), d, "lineitem")
    cells = F.array(F.concat(F.lit(" "), "l_returnflag", F.lit("|")), F.concat("l_linestatus", F.lit("\n"), "l_linenumber"), F.col("l_orderkey").cast("string"))
    short = F.when(F.col("l_orderkey") % 9 == 0, F.array(F.lit(""), F.lit(None).cast("string"))).when(F.col("l_orderkey") % 5 == 0, F.slice(cells, 1, 2)).otherwise(cells)
    return li.select(F.col("l_suppkey").alias("sheet"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate").alias("row_no"), short.alias("cells"))


def src_09_sheet_blocks(spark, d):
    return Y.sheet_blocks(sheet_rows(spark, d), [], F.floor(F.col("row_no.l_orderkey") / 1000))


def src_10_markdown_tables(spark, d):
    """One table per order: a header and its line items with cells that need escaping."""
    li = table(prepare(spark), d, "lineitem")
    row = F.array(F.col("l_linenumber").cast("string"), F.concat(F.lit("a|"), "l_returnflag"), F.concat("l_linestatus", F.lit("\n x ")))
    cut = F.when(F.col("l_linenumber") % 3 == 0, F.slice(row, 1, 2)).otherwise(row)
    data = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", cut.alias("r")))), lambda s: s["r"])
    rows = F.concat(F.array(F.array(F.lit("no"), F.lit("flag"))), data)
    return li.groupBy("l_orderkey").agg(rows.alias("rows")).select("l_orderkey", Y.markdown_table(F.col("rows")).alias("table_text"))


def src_12_web_pages(spark, d):
    return H.web_pages(table(prepare(spark), d, "pages"))


def src_12_article_text(spark, d):
    """Navigation is left in the pages: its links are seen by their density."""
    tags = tuple(t for t in H.DROPPED if t != "nav")
    return table(prepare(spark), d, "pages").select("page_id", H.article_text(F.col("html"), tags).alias("article"))


def src_12_same_site(spark, d):
    return H.same_site(table(prepare(spark), d, "pages"), "http://blog.example.org", 1).select("page_id", "url")


def cln_07_languages(spark, d):
    """What cleaning leaves of a document decides its language; the model knows the raw texts."""
    docs = table(prepare(spark), d, "documents")
    out = G.detect(C.cleaned_texts(fx.block(spark, d)), G.train(docs.select("lang", "text")))
    return out.withColumn("confidence", F.round("confidence", 3))


QUERIES = {f.__name__: f for f in (
    src_05_markdown_blocks, src_07_page_lines_to_blocks, src_08_outside_tables, src_09_sheet_blocks, src_10_markdown_tables,
    src_12_web_pages, src_12_article_text, src_12_same_site, cln_07_languages,
)}


def _main_text_sql(html: str) -> str:
    bare = rf"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "nav", "header", "footer", "aside", "form", "noscript", "head"):
        bare = rf"regexp_replace({bare}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    breaks = "(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|table|tr|article|section|main|blockquote|pre|td|th)\\b[^>]*>"
    lines = rf"regexp_replace(regexp_replace({bare}, '{breaks}', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for name, shown in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&")):
        lines = f"replace({lines}, '&{name};', '{shown}')"
    tidy = rf"regexp_replace(regexp_replace({lines}, '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')"
    return rf"trim(regexp_replace({tidy}, '^\n+|\n+$', '', 'g'))"


def _marked_sql(html: str) -> str:
    text = rf"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "header", "footer", "aside", "form", "noscript", "head"):
        close = rf"(?:</{tag}\s*>|\z)" if tag in ("script", "style") else rf"</{tag}\s*>"
        text = rf"regexp_replace({text}, '(?is)<{tag}\b[^>]*>.*?{close}', '', 'g')"
    breaks = "(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|table|tr|article|section|main|blockquote|pre|td|th)\\b[^>]*>"
    for pattern, made in ((r"(?i)<a\b[^>]*>", "chr(2)"), (r"(?i)</a\s*>", "chr(3)"), (breaks, "chr(10)"), ("<[^>]*>", "''")):
        text = f"regexp_replace({text}, '{pattern}', {made}, 'g')"
    for name, shown in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{shown}')"
    return text


_CELL = "trim(replace(replace({c}, '|', '\\|'), chr(10), '<br>'))"

ORACLES = {
    "src_05_markdown_blocks": """
select b.doc_id, b.block_order, type, text, coalesce(path, '') as path from mx_block b left join mx_path p on p.doc_id = b.doc_id and p.block_order = b.block_order""",
    "src_07_page_lines_to_blocks": """
select b.doc_id, b.block_order, type, text, page, coalesce(path, '') as path from px_block b left join px_path p on p.doc_id = b.doc_id and p.block_order = b.block_order""",
    "src_08_outside_tables": """
select doc_id, line_no from (select *, (line_no % 7 * 40 + line_no % 7 * 40 + length(text)) / 2 as x, top + 6 as y from px_line)
where not (x between 0 and 90 and y between 100 and 200) and not (x between 120 and 300 and y between 150 and 420)""",
    "src_09_sheet_blocks": r"""
with r as (select l_suppkey as sheet, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) as row_no, l_returnflag || '\|' as a, l_linestatus || '<br>' || l_linenumber as b,
    case when l_orderkey % 5 = 0 then null else l_orderkey::varchar end as c from lineitem where l_orderkey % 9 <> 0),
n as (select *, row_number() over (partition by sheet order by row_no) as n, first_value(a) over w as ha, first_value(b) over w as hb, first_value(c) over w as hc from r window w as (partition by sheet order by row_no)),
w as (select sheet, (n - 2) // 50 as win, string_agg('| ' || a || ' | ' || b || case when hc is null and wide = 2 then '' else ' | ' || coalesce(c, '') end || ' |', chr(10) order by row_no) as body, any_value(wide) as wide
  from (select *, case when max((c is not null)::int) over (partition by sheet, (n - 2) // 50) = 1 or hc is not null then 3 else 2 end as wide from n where n > 1) group by 1, 2),
h as (select distinct sheet, ha, hb, hc from n),
t as (select h.sheet, coalesce(win, 0) as win, coalesce(wide, case when hc is null then 2 else 3 end) as wide, body, ha, hb, hc from h left join w using (sheet))
select sheet, (win + 1)::int as block_order, 'table' as type, '| ' || ha || ' | ' || hb || case when wide = 3 then ' | ' || coalesce(hc, '') else '' end || ' |' || chr(10)
  || case when wide = 3 then '| --- | --- | --- |' else '| --- | --- |' end || coalesce(chr(10) || body, '') as text from t
union all select distinct sheet, 0, 'heading', sheet::varchar from h""",
    "src_10_markdown_tables": r"""
with r as (select l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate, l_linenumber::varchar as a, 'a\|' || l_returnflag as b, case when l_linenumber % 3 <> 0 then l_linestatus || '<br> x' end as c from lineitem),
w as (select l_orderkey, max((c is not null)::int) as wide from r group by 1)
select l_orderkey, case when any_value(wide) = 1 then '| no | flag |  |' || chr(10) || '| --- | --- | --- |' else '| no | flag |' || chr(10) || '| --- | --- |' end || chr(10)
  || string_agg('| ' || a || ' | ' || b || case when wide = 1 then ' | ' || coalesce(c, '') else '' end || ' |', chr(10) order by l_linenumber, l_partkey, l_extendedprice, l_shipdate) as table_text
from r join w using (l_orderkey) group by 1""",
    "src_12_web_pages": f"""
select page_id, url_key, {_main_text_sql('html')} as main_text, row_number() over (partition by url_key order by page_id) > 1 as is_duplicate from wx_key""",
    "src_12_article_text": rf"""
with m as (select page_id, {_marked_sql('html')} as t from pages),
c as (select page_id, string_split(t, chr(2)) as p from m),
l as (select page_id, string_split(array_to_string(list_transform(p, lambda x, i: case when i = 1 then replace(x, chr(3), '')
    else chr(2) || replace(split_part(x, chr(3), 1), chr(10), chr(3) || chr(10) || chr(2)) || chr(3) || replace(substr(x, length(split_part(x, chr(3), 1)) + 2), chr(3), '') end), ''), chr(10)) as lines from c),
u as (select page_id, unnest(lines) as line, generate_subscripts(lines, 1) as n from l),
w as (select page_id, n, trim(regexp_replace(translate(line, chr(2) || chr(3), ''), '[ \t\r]+', ' ', 'g')) as text,
  array_to_string(regexp_extract_all(line, '\x02([^\x03]*)\x03', 1), ' ') as links from u),
s as (select page_id, n, text, len(regexp_extract_all(text, '[^ ]+')) as words, len(regexp_extract_all(links, '[^ \t\r]+')) as linked from w where text <> ''),
a as (select *, lag(words) over o as pw, lag(linked) over o as pl, lead(words) over o as nw from s window o as (partition by page_id order by n)),
k as (select * from a where linked * 3 <= words and case when pw is null or pl * 9 <= pw * 5
  then words > 16 or coalesce(nw, 0) > 15 or coalesce(pw, 0) > 4 else words > 40 or coalesce(nw, 0) > 17 end)
select p.page_id, coalesce(string_agg(text, chr(10) order by n), '') as article from pages p left join k using (page_id) group by p.page_id""",
    "src_12_same_site": r"""
select page_id, url from pages where regexp_matches(lower(url), '^https?://blog\.example\.org([/?#:]|$)')
  and len(list_filter(string_split(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^(?i)https?://[^/]*(/.*)?$', 1), '/'), lambda s: s <> '')) <= 1""",
    "cln_07_languages": r"""
with g as (select doc_id, lang, substr(t, i::int, 3) as gram from (select doc_id, lang, lower(text) as t, unnest(generate_series(1, length(text) - 2)) as i from documents)),
c as (select lang, gram, count(*) as n from g group by 1, 2), v as (select gram from c group by 1),
k as (select c.* from c join v using (gram)), t as (select lang, sum(n) as total from k group by 1),
m as (select v.gram, t.lang, ln((coalesce(k.n, 0) + 1) / (t.total + (select count(*) from v))) as score from v cross join t left join k on k.gram = v.gram and k.lang = t.lang),
d as (select doc_id, coalesce(string_agg(c, chr(10) order by block_order) filter (fate = 'kept'), '') as text from cx_judged group by 1),
y as (select doc_id, substr(t, i::int, 3) as gram from (select doc_id, lower(text) as t, unnest(generate_series(1, length(text) - 2)) as i from d)),
s as (select doc_id, m.lang, sum(m.score * x.n) as score from (select doc_id, gram, count(*) as n from y group by 1, 2) x join m using (gram) group by 1, 2),
b as (select doc_id, arg_max(lang, score) as lang, 1 / sum(exp(score - top)) as confidence from (select *, max(score) over (partition by doc_id) as top from s) group by 1)
select d.doc_id, case when trim(text) = '' then 'und' when confidence >= 0.5 then b.lang else 'und' end as language, case when trim(text) <> '' then round(confidence, 3) end as confidence
from d left join b using (doc_id)""",
}
