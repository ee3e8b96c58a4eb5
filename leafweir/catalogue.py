"""The reference operators as registered queries over the supplied tables, each with its SQL.

Queries are thin: they lay evidence out (``sources.evidence``) and call one operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import planted
from .functions import geometry as G
from .functions import predicates as P
from .functions import text as T
from .operators import chrome, document, forms, labels, layout, ocr, overlap, pagetext, quality, reading, regions, rules, search, tables, vertical
from .plans import process, report, tools
from .sources import evidence as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
W, H = ev.PAGE_WIDTH, ev.PAGE_HEIGHT
_EV = "with " + ev.SQL.strip()


def query(sql: str | None = None, evidence: bool = True):
    """Registers a function (spark, sf_dir); its SQL may use the evidence CTEs line, block, page, span."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"{_EV}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}" if evidence else sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return ev.table(spark, d, "documents")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return ev.lines(docs(spark, d))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return ev.pages_of(ev.page_rows(docs(spark, d)))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return ev.blocks_of(ev.page_rows(docs(spark, d)))


def page_keys(spark: SparkSession, d: str) -> DataFrame:
    return ev.page_keys(docs(spark, d))


def spans(spark: SparkSession, d: str) -> DataFrame:
    return ev.spans(lines(spark, d))


def images(spark: SparkSession, d: str) -> DataFrame:
    """A page image for every seventh page, a figure for the others with a multiple of three (by id and page)."""
    n = F.col("doc_id") * 31 + F.col("page")
    full = n % 7 == 0
    rows = page_keys(spark, d).filter(full | (n % 3 == 0)).select("doc_id", "page", full.alias("full"))
    return rows.select("doc_id", "page", F.lit(0).alias("image"), *[F.when(F.col("full"), a).otherwise(b).alias(c) for c, a, b in (("x", 6.0, 100.0), ("y", 6.0, 500.0), ("width", 600.0, 400.0), ("height", 780.0, 280.0))])


_IMAGE = """image as (select doc_id, page, 0 as image, (case when full_ then 6.0 else 100.0 end)::double as x, (case when full_ then 6.0 else 500.0 end)::double as y, (case when full_ then 600.0 else 400.0 end)::double as width, (case when full_ then 780.0 else 280.0 end)::double as height
  from (select doc_id, page, (doc_id * 31 + page) % 7 = 0 as full_ from page where (doc_id * 31 + page) % 7 = 0 or (doc_id * 31 + page) % 3 = 0))"""
_STATUS = r"""quality as (select *, len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{FDD0}-\x{FDEF}\x{FFFE}\x{FFFF}]')) as non_printable_count from page),
status as (select *, case when char_count > 0 then floor(non_printable_count / char_count * 1000 + 0.5) / 1000 else 0.0 end as non_printable_ratio,
  case when char_count > 0 and non_printable_count / char_count >= 0.2995 then 'unusable_glyph_indices' when char_count > 0 and non_printable_count / char_count >= 0.0495 then 'mixed_glyph_indices' when char_count > 0 then 'ok' else 'empty' end as native_text_status from quality)"""
#: Planted edges (as ``chromed`` plants them), the keys of bands, the marked lines and, cut where marks change, the blocks.
_MARKED = r"""pl(doc_id, page, block, line, text, x, y, width, height) as (select doc_id, page, 900, 0, 'Lecture 5 - ' || page, 400.0, 20.0, 110.0, 10.0 from page where doc_id % 3 = 0
  union all select doc_id, page, 900, 0, 'Issued by the office of public records', 36.0, case when doc_id % 2 = 0 then 752.0 else 760.0 end, 240.0, 10.0 from page where doc_id % 3 = 1
  union all select doc_id, page, 900, 1, 'sheet ' || (doc_id * 7919 + page * 104729), 36.0, 772.0, 250.0, 10.0 from page where doc_id % 3 = 1
  union all select doc_id, page, 900, 0, 'Row total ' || page * 7 || ' units', 36.0, 400.0, 120.0, 10.0 from page where doc_id % 3 = 2),
al as (select doc_id, page, block, line, text, x, y, width, height from numbered union all select * from pl),
bl as (select doc_id, page, block, trim(regexp_replace(string_agg(text, chr(10) order by line), '\s+', ' ', 'g')) as t, min(y) as y, max(y + height) as low, max(x + width) - min(x) as width from al group by all),
edge as (select * from bl where (y <= 79.2 or low >= 712.8) and regexp_replace(lower(t), '\.$', '') not in ('yes', 'no', 'stop')),
ref as (select doc_id, page, block, null::integer as line, true as whole, y, t, width from edge union all
  select doc_id, page, block, line, false, al.y, trim(regexp_replace(al.text, '\s+', ' ', 'g')), al.width from al semi join edge using (doc_id, page, block) where al.y <= 31.68 or al.y + al.height >= 760.32),
told as (select *, list_filter(string_split_regex(lower(t), '[^\p{L}\p{N}_]+'), lambda w: w <> '') as ws from ref),
named as (select *, length(t) between 1 and 80 and ((length(t) <= 12 and regexp_replace(t, '[\p{N}\s.-]', '', 'g') = '' and width <= 73.44) or (ws[1] in ('page', 'slide', 'lecture') and starts_with(lower(t), ws[1])) or regexp_matches(lower(t), '^p\.[\p{L}\p{N}_]')
  or (width <= 153.0 and (list_has_any(ws, ['page', 'slide', 'lecture']) or regexp_matches(lower(t), '(^|[^\p{L}\p{N}_])p\.[\p{L}\p{N}_]')))) as label from told),
keyed as (select doc_id, page, block, line, whole, cast(floor(y / 5.0 + 0.5) * 5 as bigint) as bin, unnest(list_distinct(list_filter([case when t <> '' then t end, case when label then case when regexp_matches(t, '\s') and regexp_full_match(regexp_replace(t, '\s', '', 'g'), '\p{N}{2,4}') then '#page-number'
  when regexp_matches(t, '\p{N}') and len(regexp_extract_all(t, '\p{L}')) >= 4 then regexp_replace(t, '\p{N}+', '#', 'g') end end], lambda k: k is not null))) as key from named where whole or length(t) >= 20 or width >= 122.4 or label),
total as (select doc_id, count(distinct page) as total from bl group by 1),
rep as (select doc_id, whole, bin, key, count(distinct page) as on_pages from keyed join total using (doc_id) group by doc_id, whole, bin, key, total having count(distinct page) >= greatest(2, ceil(total / 2))),
hits as (select distinct doc_id, page, block, line, whole from keyed semi join rep using (doc_id, whole, bin, key)),
flag as (select al.*, exists (select 1 from hits h where h.doc_id = al.doc_id and h.page = al.page and h.block = al.block and (h.whole or h.line = al.line)) as f from al),
turn as (select *, coalesce(f <> lag(f) over w, false)::int as change from flag window w as (partition by doc_id, page, block order by line)),
part as (select *, sum(change) over (partition by doc_id, page, block order by line) as part from turn),
marked as (select doc_id, page, cast(row_number() over (partition by doc_id, page order by block, part) - 1 as integer) as block, string_agg(text, chr(10) order by line) as text, bool_and(f) as repeated, min(x) as x, min(y) as y, max(x + width) - min(x) as width, max(y + height) - min(y) as height from part group by doc_id, page, block, part)"""


# -- quality ---------------------------------------------------------------------------------------


@query("+" + _STATUS + " select doc_id, page, char_count, text_coverage, non_printable_count, non_printable_ratio, native_text_status from status")
def page_quality(spark, d):
    return quality.with_quality(pages(spark, d)).select("doc_id", "page", "char_count", "text_coverage", "non_printable_count", "non_printable_ratio", "native_text_status")


@query("+" + _STATUS + " select native_text_status, count(*) as pages, sum(char_count)::bigint as chars from status group by 1")
def status_counts(spark, d):
    return quality.with_quality(pages(spark, d)).groupBy("native_text_status").agg(F.count(F.lit(1)).alias("pages"), F.sum("char_count").alias("chars"))


@query("+ b as (select doc_id, page, count(*) as block_count from block group by all), s as (select doc_id, page, count(*) as span_count from span group by all), p as (select *, count(*) over (partition by doc_id) as total_pages from page) select doc_id, page, char_count, text_coverage, total_pages, coalesce(block_count, 0) as block_count, coalesce(span_count, 0) as span_count from p left join b using (doc_id, page) left join s using (doc_id, page) where total_pages > 1")
def overview(spark, d):
    return quality.overview(pages(spark, d), {"block_count": blocks(spark, d), "span_count": spans(spark, d)}).select("doc_id", "page", "char_count", "text_coverage", "total_pages", "block_count", "span_count")


@query("+" + _STATUS + """, d as (select distinct doc_id, native_text_status, page from status), g as (select *, page - row_number() over (partition by doc_id, native_text_status order by page) as island from d),
r as (select doc_id, native_text_status, min(page) as a, max(page) as b, count(*) as n from g group by doc_id, native_text_status, island)
select doc_id, native_text_status, sum(n)::bigint as pages, string_agg(case when a = b then a::varchar else a || '-' || b end, ', ' order by a) as ranges from r group by all""")
def document_map_ranges(spark, d):
    return quality.page_ranges(quality.with_quality(pages(spark, d)), ["doc_id", "native_text_status"])


@query("select doc_id, page, count(*) as n from line where page between 2 and 3 or page = 7 group by all")
def page_range_filter(spark, d):
    return quality.select_pages(lines(spark, d), "2-3,7").groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))


@query("+ " + _IMAGE + """ select p.doc_id, p.page, case when r is null then null when r > 0.005 then 'ok' when r > 0.001 then 'sparse' when r > 0 and p.char_count > 0 and not g then 'sparse' when r >= 0.0005 and g then 'sparse' else 'blank' end as visual_status
from (select *, case when (doc_id + page) % 5 = 0 then null else ((doc_id * 7 + page) % 13) / 2000.0 end as r from page) p join (select page.doc_id, page.page, image.image is not null as g from page left join image using (doc_id, page)) using (doc_id, page)""")
def visual_status(spark, d):
    rows = pages(spark, d).withColumn("r", F.when((F.col("doc_id") + F.col("page")) % 5 != 0, ((F.col("doc_id") * 7 + F.col("page")) % 13) / 2000.0))
    has = images(spark, d).select("doc_id", "page", F.lit(True).alias("g"))
    rows = rows.join(has, ["doc_id", "page"], "left").withColumn("g", F.coalesce("g", F.lit(False)))
    return rows.select("doc_id", "page", quality.visual_status(F.col("r"), F.col("char_count") > 0, F.col("g"), F.lit(False)).alias("visual_status"))


# -- text statistics -------------------------------------------------------------------------------


@query(r"select doc_id, len(regexp_extract_all(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{FDD0}-\x{FDEF}\x{FFFE}\x{FFFF}]')) as bad, length(coalesce(text, '')) as points from documents", evidence=False)
def nonprintable_stats(spark, d):
    return docs(spark, d).select("doc_id", T.non_printable_count(F.col("text")).alias("bad"), T.code_points(F.col("text")).alias("points"))


@query(r"select doc_id, len(regexp_extract_all(coalesce(text, ''), '[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]')) as private_use, len(regexp_extract_all(coalesce(text, ''), '\x{FFFD}')) as replaced from documents", evidence=False)
def private_use_and_replacement(spark, d):
    return docs(spark, d).select("doc_id", T.private_use_count(F.col("text")).alias("private_use"), T.replacement_count(F.col("text")).alias("replaced"))


@query(r"select doc_id, page, len(regexp_extract_all(text, '\p{L}')) as letters, len(regexp_extract_all(text, '[\x{C0}-\x{FF}]')) as accented from page where len(regexp_extract_all(text, '\p{L}')) >= 50")
def letter_counts(spark, d):
    t = F.col("text")
    return pages(spark, d).select("doc_id", "page", T.letters(t).alias("letters"), T.count(t, r"[\x{C0}-\x{FF}]").alias("accented")).filter("letters >= 50")


@query(r"+ said as (select doc_id, page, case when (doc_id + page) % 3 = 0 then repeat('שלום עולם ', 12) || substr(text, 1, 100 * cast(page % 4 as integer)) else text end as text from page) select doc_id, page from said where len(regexp_extract_all(text, '\p{L}')) >= 50 and len(regexp_extract_all(text, '[\p{Hebrew}\p{Arabic}]')) > 0.25 * len(regexp_extract_all(text, '\p{L}'))")
def rtl_script_text(spark, d):
    """Every third page begins with Hebrew words, before none or up to 300 characters of its own."""
    said = F.when((F.col("doc_id") + F.col("page")) % 3 == 0, F.concat(F.lit("שלום עולם " * 12), F.expr("substring(text, 1, 100 * cast(page % 4 as int))"))).otherwise(F.col("text"))
    return rules.rtl_script(pages(spark, d).withColumn("text", said)).select("doc_id", "page")


@query(r"select doc_id, page, floor(len(regexp_extract_all(text, '[^\p{L}\p{N}\s]')) / len(regexp_extract_all(text, '\S')) * 1000 + 0.5) / 1000 as share from page where char_count >= 80 and len(regexp_extract_all(text, '[^\p{L}\p{N}\s]')) / len(regexp_extract_all(text, '\S')) >= 0.35")
def symbol_noise(spark, d):
    return rules.symbol_noise(pages(spark, d)).select("doc_id", "page", F.col("detail").cast("double").alias("share"))


@query(r"+ t as (select doc_id, page, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: length(x) > 0) as w from page) select doc_id, page, len(w) as tokens, len(list_filter(w, lambda x: regexp_matches(x, '^\p{L}$'))) as single, len(list_filter(w, lambda x: regexp_matches(x, '^\p{L}{1,2}$'))) as short from t where len(w) >= 80")
def word_fragmentation_stats(spark, d):
    tokens = F.filter(F.split(F.trim(F.col("text")), r"\s+"), lambda w: F.length(w) > 0)
    n = lambda p: F.size(F.filter(tokens, lambda w: w.rlike(p))).cast("long")
    return pages(spark, d).select("doc_id", "page", F.size(tokens).cast("long").alias("tokens"), n(r"^\p{L}$").alias("single"), n(r"^\p{L}{1,2}$").alias("short")).filter("tokens >= 80")


@query(r"select doc_id, page, count(*) as dot_lines, sum(length(regexp_replace(text, '\s+', '', 'g')))::bigint as dots from line where regexp_matches(regexp_replace(text, '\s+', '', 'g'), '^[.·•․‥…|*#$%&!]{3,}$') group by all")
def leader_lines(spark, d):
    token = F.regexp_replace("text", r"\s+", "")
    return lines(spark, d).filter(token.rlike("^[.·•․‥…|*#$%&!]{3,}$")).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("dot_lines"), F.sum(F.length(token)).alias("dots"))


@query(r"+ t as (select doc_id, page, regexp_replace(case when line % 3 = 0 and (doc_id + page) % 2 = 0 then repeat('. ', 6 + line) else text end, '\s+', '', 'g') as k from line) select doc_id, page, count(*) as n from t where regexp_matches(k, '^[.·•․‥…]{3,}$') group by all having count(*) >= 8 and sum(length(k)) >= 80")
def dot_leader_noise(spark, d):
    """On every other page each third line is a leader."""
    said = F.when((F.col("line") % 3 == 0) & ((F.col("doc_id") + F.col("page")) % 2 == 0), F.expr("repeat('. ', 6 + line)")).otherwise(F.col("text"))
    return rules.dot_leaders(lines(spark, d).withColumn("text", said)).select("doc_id", "page", F.split("detail", "/")[0].cast("long").alias("n"))


@query(r"+ said as (select doc_id, page, case when (doc_id + page) % 4 = 0 then '<latexit sha1=x>' || repeat('Ab9+/ ', cast(10 + page % 9 as integer)) || '</latexit> ' || text else text end as text from page) select doc_id, page from said where regexp_matches(text, '<latexit[^>]*>[A-Za-z0-9+/=\s]{80,}')")
def latexit_payload(spark, d):
    """Every fourth page begins with an embedded source, long enough on some."""
    said = F.when((F.col("doc_id") + F.col("page")) % 4 == 0, F.concat(F.lit("<latexit sha1=x>"), F.expr("repeat('Ab9+/ ', cast(10 + page % 9 as int))"), F.lit("</latexit> "), "text")).otherwise(F.col("text"))
    return rules.raw_embedded_source(pages(spark, d).withColumn("text", said)).select("doc_id", "page")


#: Bad glyphs planted by page number: what stands behind the page's text, or (from 9 on) in its place.
_BEHIND = {
    1: "�", 2: "\x01\x02", 3: "" * 9, 4: " waLJter eLJ LJx naïLJve", 5: " 日 本 語 文 字 列 行 間 東 京", 6: " 日日本本語語文文字字列列行行間間東東京京都都市市",
    7: " 日 日日 日日日日日日 x 京", 8: " " + "日本語文字列行間東京都市" * 5 + " ā ē ī ō ū ą xā",
}
_INSTEAD = {9: "ÃÂâã ÐðÞþÃÂ éèêë ab", 10: "".join(chr(0x3400 + 2 * i) for i in range(12)) + " x", 11: "A\x01 title above a line that goes on", 12: "" * 30 + " ab", 13: "\x01" * 20 + "� and so on and so forth"}
_GLYPHS = "glyphed as (select doc_id, page, case (doc_id * 31 + page) % 14 " + " ".join(f"when {k} then text || '{v}'" for k, v in _BEHIND.items()) + " " + " ".join(f"when {k} then '{v}'" for k, v in _INSTEAD.items()) + r""" else text end as text from page),
g0 as (select *, length(text) as char_count, len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{FDD0}-\x{FDEF}\x{FFFE}\x{FFFF}]')) as bad, len(regexp_extract_all(text, '\S')) as shown, len(regexp_extract_all(text, '[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]')) as pua, len(regexp_extract_all(text, '[\p{Han}\p{Hiragana}\p{Katakana}]')) as cjk from glyphed),
g as (select *, case when char_count > 0 then floor(bad / char_count * 1000 + 0.5) / 1000 else 0.0 end as npr, coalesce(pua / nullif(shown, 0), 0) as share from g0),
ch as (select doc_id, page, generate_subscripts(c, 1) as i, unnest(c) as x from (select doc_id, page, string_split(text, '') as c from g where cjk >= 8)),
flat as (select doc_id, page, generate_subscripts(c, 1) as i, unnest(c) as x from (select doc_id, page, string_split(regexp_replace(text, '[ \t\x{3000}]', '', 'g'), '') as c from g where cjk >= 8)),
one as (select doc_id, page, generate_subscripts(c, 1) as i, unnest(c) as x from (select doc_id, page, string_split(regexp_replace(text, '[ \t\x{3000}]+', ' ', 'g'), '') as c from g where cjk >= 8)),
sp as (select doc_id, page, count(*) as spaced from (select *, lead(x) over w as x1, lead(x, 2) over w as x2 from one window w as (partition by doc_id, page order by i)) where regexp_matches(x, '[\p{Han}\p{Hiragana}\p{Katakana}]') and x1 = ' ' and regexp_matches(x2, '[\p{Han}\p{Hiragana}\p{Katakana}]') group by all),
db as (select doc_id, page, sum(n // 2) as doubled from (select doc_id, page, x, count(*) as n from (select *, i - row_number() over (partition by doc_id, page, x order by i) as island from ch) where regexp_matches(x, '[\p{Han}\p{Hiragana}\p{Katakana}]') group by doc_id, page, x, island) group by all),
rn as (select doc_id, page, max(n) as longest from (select doc_id, page, x, count(*) as n from (select *, i - row_number() over (partition by doc_id, page, x order by i) as island from flat) where regexp_matches(x, '[\p{Han}\p{Hiragana}\p{Katakana}]') group by doc_id, page, x, island) group by all),
mo as (select doc_id, page, count(*) as moji from (select *, lag(x) over w as b, lead(x) over w as a from ch window w as (partition by doc_id, page order by i)) where regexp_matches(x, '[\x{100}-\x{24F}\x{1E00}-\x{1EFF}]') and not coalesce(regexp_matches(b, '\p{Latin}'), false) and not coalesce(regexp_matches(a, '\p{Latin}'), false) group by all),
ex as (select doc_id, page, row_number() over (partition by doc_id, page order by i) as i, unicode(x) as u, regexp_matches(x, '[\x{3400}-\x{4DBF}\x{20000}-\x{2EBEF}]') as e from ch where not regexp_matches(x, '^\s*$')),
es as (select *, case when e and lag(e) over w then u - lag(u) over w end as step, count(*) over (partition by doc_id, page) as n, sum(e::int) over (partition by doc_id, page) as rare from ex window w as (partition by doc_id, page order by i)),
sq as (select distinct doc_id, page from (select doc_id, page, step, island, count(*) as k, any_value(n) as n, any_value(rare) as rare from (select *, i - row_number() over (partition by doc_id, page, step order by i) as island from es where step between 1 and 4) group by doc_id, page, step, island) where k >= 7 and rare >= 8 and rare / n >= 0.75)"""


def glyphed(spark: SparkSession, d: str) -> DataFrame:
    """Pages with bad glyphs planted in 13 of 14, with their quality."""
    n, text = (F.col("doc_id") * 31 + F.col("page")) % 14, F.col("text")
    for k, v in _BEHIND.items():
        text = F.when(n == k, F.concat("text", F.lit(v))).otherwise(text)
    for k, v in _INSTEAD.items():
        text = F.when(n == k, F.lit(v)).otherwise(text)
    return quality.with_quality(pages(spark, d).withColumn("text", text).withColumn("char_count", F.length("text").cast("long")))


@query("+" + _GLYPHS + r""" select doc_id, page, rule from (
  select doc_id, page, 'replacement' as rule from g where npr < 0.05 and contains(text, '�') union all select doc_id, page, 'non_printable' from g where bad >= 2 and npr < 0.05
  union all select doc_id, page, 'private_use' from g where pua >= 1 and not (pua >= 2 and share >= 0.6) and (share >= 0.25 or (pua >= 8 and share >= 0.02))
  union all select doc_id, page, 'digraph' from g where len(list_filter(string_split_regex(text, '[^\p{L}\p{M}\p{N}_]+'), lambda w: regexp_full_match(w, '[\p{Ll}\p{Nd}]+LJ[\p{Ll}\p{Nd}]+'))) > 0
  union all select doc_id, page, 'cjk_spacing' from g join sp using (doc_id, page) where cjk >= 8 and spaced >= 5 and spaced / greatest(1, cjk - 1) >= 0.45
  union all select doc_id, page, 'cjk_doubled' from g join db using (doc_id, page) where cjk >= 20 and doubled >= 6 and doubled / cjk >= 0.04
  union all select doc_id, page, 'cjk_run' from rn where longest >= 8
  union all select doc_id, page, 'cjk_mojibake' from g join mo using (doc_id, page) where cjk >= 50 and moji >= 5 and moji / char_count < 0.05
  union all select doc_id, page, 'latin1_mojibake' from g where len(regexp_extract_all(text, '[\x{A0}-\x{FF}]')) - len(regexp_extract_all(text, '\x{A0}')) >= 4 and (len(regexp_extract_all(text, '[\x{A0}-\x{FF}]')) - len(regexp_extract_all(text, '\x{A0}'))) / shown >= 0.6 and regexp_matches(text, '[\x{A0}-\x{FF}]{2}') and regexp_matches(text, '[ÃÂâãÐðÞþ]')
  union all select doc_id, page, 'sequential_extension' from sq)""")
def localized_glyph_noise(spark, d):
    """Every sub-rule on pages in which each is planted."""
    return rules.localized_glyph_noise(glyphed(spark, d)).select("doc_id", "page", F.col("detail").alias("rule"))


@query("+" + _GLYPHS + r" select doc_id, page, case when npr >= 0.2995 then 'unusable_glyph_indices' when npr >= 0.0495 then 'mixed_glyph_indices' else 'ok' end as status from g where char_count > 0 and (npr >= 0.05 or (pua >= 2 and share >= 0.6))")
def glyph_garbage(spark, d):
    return rules.glyph_garbage(glyphed(spark, d)).select("doc_id", "page", F.col("detail").alias("status"))


@query("+" + _GLYPHS + r" select doc_id, page from g where npr >= 0.1")
def unreliable_geometry(spark, d):
    """Pages whose geometry rules are held back."""
    return quality.unreliable_geometry(glyphed(spark, d)).select("doc_id", "page")


@query("+" + _GLYPHS + r" select doc_id, page, 3 as block from g where bad = 1 and npr < 0.05 and (doc_id * 31 + page) % 14 = 11")
def single_display_glyph(spark, d):
    """Pages whose third block holds the one bad code point in a display line, the second in a small one."""
    line = F.struct(F.lit("A\x01 title").alias("text"), F.lit(20.0).alias("font_size"), F.lit(18.0).alias("height"))
    low = F.struct(F.lit("A\x01 note").alias("text"), F.lit(9.0).alias("font_size"), F.lit(9.0).alias("height"))
    ps = glyphed(spark, d)
    blocks_ = ps.filter((F.col("doc_id") * 31 + F.col("page")) % 14 == 11).select("doc_id", "page", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))).alias("block")).withColumn("lines", F.array(F.when(F.col("block") == 2, low).otherwise(line)))
    return rules.single_display_glyph(ps, blocks_).select("doc_id", "page", "block")


@query(r"""select doc_id, regexp_replace(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: not (length(s) > 0 and length(regexp_replace(s, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) = 0)), chr(10)), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') as text from documents""", evidence=False)
def normalize_text_c0(spark, d):
    return docs(spark, d).select("doc_id", T.strip_controls(F.col("text")).alias("text"))


@query("select doc_id, md5(nfc_normalize(coalesce(text, ''))) as digest from documents", evidence=False)
def normalize_text_nfc(spark, d):
    """NFKC and NFC agree on these texts; the operator is NFKC."""
    from .functions.normal import nfkc

    return nfkc(docs(spark, d).select("doc_id", "text"), "text").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("select doc_id, length(coalesce(text, '')) as points, substr(sha256(coalesce(text, '')), 1, 16) as fingerprint from documents", evidence=False)
def fingerprint(spark, d):
    t = F.coalesce("text", F.lit(""))
    return docs(spark, d).select("doc_id", T.code_points(t).alias("points"), document.fingerprint(t.cast("binary")).alias("fingerprint"))


# -- layout ----------------------------------------------------------------------------------------


@query("select doc_id, page, line, count(*) as words, min(x) as x, max(x + width) - min(x) as width from span group by all")
def span_lines(spark, d):
    return spans(spark, d).groupBy("doc_id", "page", "line").agg(F.count(F.lit(1)).alias("words"), F.min("x").alias("x"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"))


@query("select doc_id, page, block, md5(text) as digest, n_lines, font_size, x, y, width, height from block")
def union_box(spark, d):
    return blocks(spark, d).select("doc_id", "page", "block", F.md5(F.col("text").cast("binary")).alias("digest"), "n_lines", "font_size", "x", "y", "width", "height")


@query("""+ l as (select *, lag(y) over w as py, lag(height) over w as ph, lag(font_size) over w as pf, lag(x) over w as px, lag(width) over w as pw from line window w as (partition by doc_id, page order by y, x, line)),
b as (select *, (py is null or y - (py + ph) > 0.4 * greatest(height, ph) or greatest(font_size, pf) > 1.3 * least(font_size, pf) or least(x + width, px + pw) <= greatest(x, px))::int as new from l),
s as (select *, sum(new) over (partition by doc_id, page order by y, x, line) - 1 as session from b)
select doc_id, page, cast(session as integer) as block, count(*) as n_lines, min(y) as y from s group by all""")
def block_sessionize(spark, d):
    return layout.sessions(lines(spark, d), 0.4).groupBy("doc_id", "page", "block").agg(F.count(F.lit(1)).alias("n_lines"), F.min("y").alias("y"))


@query("""+ r as (select doc_id, page, font_size, sum(length(trim(text))) as n from line where length(trim(text)) > 0 group by all), u as (select *, sum(n) over (partition by doc_id, page order by font_size) as upto, sum(n) over (partition by doc_id, page) as total from r)
select doc_id, page, min(font_size) as body from u where upto >= total / 2 group by all""")
def body_font_median(spark, d):
    return layout.body_font(lines(spark, d))


@query(r"""+ r as (select doc_id, page, font_size, sum(length(trim(text))) as n from line where length(trim(text)) > 0 group by all), u as (select *, sum(n) over (partition by doc_id, page order by font_size) as upto, sum(n) over (partition by doc_id, page) as total from r),
f as (select doc_id, page, min(font_size) as body from u where upto >= total / 2 group by all)
select b.doc_id, b.page, block, case when font_size / body >= 1.4 then 1 when font_size / body >= 1.25 then 2 when font_size / body >= 1.15 then 3 else 4 end as level
from block b join f using (doc_id, page) where font_size / body >= 1.08 and n_lines <= 3 and length(trim(text)) between 2 and 120 and regexp_matches(text, '\p{L}') and not regexp_matches(trim(text), '(?i)^(?:fig(?:ure)?\.?|table|tab\.|図|表)\s*[0-9]+')
and not regexp_matches(trim(text), '(?i)^(?:https?://|www\.|@|doi:)') and not regexp_matches(trim(text), '[,;]$') and not regexp_matches(trim(text), '[.!?]\s+\p{Lu}.*[.!?]$')""")
def heading_tiers(spark, d):
    ls = lines(spark, d)
    return layout.headings(blocks(spark, d), layout.body_font(ls)).filter("level is not null").select("doc_id", "page", "block", "level")


@query("""+ c as (select *, (width > 612 * 0.6)::int as wide from block), r as (select *, sum(wide) over (partition by doc_id, page order by y, x, block) * 2 - wide as run from c)
select doc_id, page, block, cast(row_number() over (partition by doc_id, page order by run, case when wide = 1 then 0 else floor(x / 30.6) end, y, x, block) - 1 as integer) as ord from r""")
def column_order(spark, d):
    return layout.column_order(blocks(spark, d), W).select("doc_id", "page", "block", F.col("ord").cast("int").alias("ord"))


_GAPS = """r as (select doc_id, page, line, word, text, font_size, x * 4 as x, x * 4 + width as e from span),
g as (select *, lag(e) over w as pe, x - lag(e) over w as gap, min(x) over p as l, max(e) over p as r, least(font_size, lag(font_size) over w) as f from r window w as (partition by doc_id, page, line order by x, word), p as (partition by doc_id, page, line))"""


def spread(spark: SparkSession, d: str) -> DataFrame:
    """Words set four times as far apart, on a sheet as much wider."""
    return spans(spark, d).withColumn("x", F.col("x") * 4)


@query("+ " + _GAPS + " select doc_id, page, cast(floor((pe + gap / 2) / 5 + 0.5) * 5 as bigint) as bin, count(distinct line) as rows from g where r - l >= 0.6 * 2448 and gap >= greatest(1.05 * f, 9) and pe - l >= 612 and r - x >= 612 group by all having count(distinct line) >= 3")
def recurring_gutters(spark, d):
    return layout.recurring_gutters(spread(spark, d), 4 * W)


@query("+ " + _GAPS + " select doc_id, page, cast(floor(x / 5 + 0.5) * 5 as bigint) as bin, count(distinct line) as rows from g where r - l >= 0.6 * 2448 and gap >= greatest(0.9 * f, 9) and x >= 0.58 * 2448 and pe - l >= 0.4 * 2448 group by all having count(distinct line) >= 2")
def recurring_panels(spark, d):
    return layout.recurring_panels(spread(spark, d), 4 * W)


@query("""with c as (select l_orderkey as doc_id, cast(l_linenumber as integer) as line, unnest([0, 1, 2, 3]) as word, unnest(['Item', cast(cast(l_quantity as integer) as varchar), case when l_partkey % 5 = 0 then '-' else cast(l_partkey as varchar) end, case when l_suppkey % 3 = 0 then 'none' else cast(l_suppkey as varchar) end]) as text from (select l_orderkey, l_linenumber, min(l_quantity) as l_quantity, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey from lineitem group by all)),
n as (select doc_id, line, word, text, 40.0 + 60 * word + (line % 2) * 10 as x, text = '-' or regexp_full_match(text, '[0-9]+') as num from c), m as (select *, sum(num::int) over (partition by doc_id, line) as nums, lag(num) over w as pn, lag(x + 30) over w as pe from n window w as (partition by doc_id, line order by x, word))
select doc_id, 1 as page, cast(floor((pe + (x - pe) / 2) / 5 + 0.5) * 5 as bigint) as bin, count(distinct line) as rows from m where nums >= 3 and num and pn and x - pe >= 10.5 group by all having count(distinct line) >= 4""", evidence=False)
def table_gutters(spark, d):
    """Order lines as rows of four cells, odd ones ten points to the right."""
    cells = F.array(F.lit("Item"), F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_partkey") % 5 == 0, "-").otherwise(F.col("l_partkey").cast("string")), F.when(F.col("l_suppkey") % 3 == 0, "none").otherwise(F.col("l_suppkey").cast("string")))
    one = ev.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_quantity", "l_partkey", "l_suppkey")])
    rows = one.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").cast("int").alias("line"), F.posexplode(cells).alias("word", "text"))
    placed = rows.withColumns({"x": 40.0 + 60 * F.col("word") + (F.col("line") % 2) * 10, "width": F.lit(30.0), "font_size": F.lit(10.0)})
    return layout.table_gutters(placed, W)


@query("""select l_orderkey as doc_id, cast(l_linenumber as integer) as line, '$ ' || cast(l_quantity as integer) || '|' || l_partkey || '|€ ' || l_suppkey || case when l_linenumber % 2 = 0 then '|each £' else '|5 £' end as cells from lineitem group by all""", evidence=False)
def currency_cells(spark, d):
    """A lone sign, a number with a sign at its end, and a last cell from which no sign goes on."""
    cells = F.array(F.lit("$"), F.col("l_quantity").cast("int").cast("string"), F.concat(F.col("l_partkey").cast("string"), F.lit(" €")), F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "each £").otherwise("5 £"))
    rows = ev.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey").distinct()
    key = F.xxhash64("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    rows = rows.select(F.col("l_orderkey").alias("doc_id"), key.alias("page"), F.col("l_linenumber").cast("int").alias("line"), F.posexplode(cells).alias("word", "text"))
    folded = layout.currency_folded(rows).groupBy("doc_id", "page", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word", "text"))), lambda c: c["text"]), "|").alias("cells"))
    return folded.drop("page")


@query("""+ a as (select doc_id, page, block, x, y, width, height from block), p as (select a.doc_id, a.page, a.block, o.block as other, a.y - (o.y + o.height) as up, o.y - (a.y + a.height) as down from a join a o on a.doc_id = o.doc_id and a.page = o.page and a.block <> o.block and least(a.x + a.width, o.x + o.width) > greatest(a.x, o.x)),
n as (select doc_id, page, block, arg_min(other, up * 1000000 + other) filter (where up >= 0) as above, arg_min(other, down * 1000000 + other) filter (where down >= 0) as below from p group by all)
select a.doc_id, a.page, a.block, coalesce(above, -1) as above, coalesce(below, -1) as below from a left join n using (doc_id, page, block)""")
def heading_neighbours(spark, d):
    near = layout.neighbours(blocks(spark, d))
    return near.select("doc_id", "page", "block", F.coalesce("above", F.lit(-1)).alias("above"), F.coalesce("below", F.lit(-1)).alias("below"))


@query(r"""select doc_id, page, line, word, text from span where regexp_matches(text, '\d') and length(regexp_replace(text, '[0-9.,()%$¥€£+\-/~\s·⋅∙×^]', '', 'g')) = 0""")
def numeric_cells(spark, d):
    return spans(spark, d).filter(T.numeric_cell(F.col("text"))).select("doc_id", "page", "line", "word", "text")


@query("""+ c as (select l_orderkey as doc_id, 1 as page, cast(l_linenumber as integer) as line, 0 as word, l_returnflag as text from lineitem union all select l_orderkey, 1, cast(l_linenumber as integer), 1, cast(cast(l_quantity as integer) as varchar) from lineitem union all select l_orderkey, 1, cast(l_linenumber as integer), 2, cast(l_suppkey as varchar) from lineitem),
r as (select distinct doc_id, page, line, count(*) as cells, sum((text ~ '^[0-9]+$')::int) as num from c group by all having count(*) >= 3 and sum((text ~ '^[0-9]+$')::int) >= 2),
n as (select *, coalesce(line - lag(line) over (partition by doc_id order by line) > 1, true)::int as new from r), t as (select *, sum(new) over (partition by doc_id order by line) - 1 as tab from n)
select doc_id, cast(tab as integer) as "table", min(line) as first_line, max(line) as last_line, count(*) as row_count from t group by all having count(*) >= 2""")
def numeric_tables(spark, d):
    """Order lines as rows of three cells (flag, quantity, supplier)."""
    cells = F.array(F.col("l_returnflag"), F.col("l_quantity").cast("int").cast("string"), F.col("l_suppkey").cast("string"))
    rows = ev.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").cast("int").alias("line"), F.posexplode(cells).alias("word", "text"))
    return layout.tables(layout.table_rows(rows)).select("doc_id", "table", "first_line", "last_line", "row_count")


# -- repeated chrome -------------------------------------------------------------------------------


def chromed(spark: SparkSession, d: str) -> DataFrame:
    """Blocks, and one more a page: a counting head, a foot whose first line stays, or a row amid the page."""
    line = lambda n, text, x, y, width: F.struct(F.lit(n).alias("line"), text.alias("text"), F.lit(True).alias("start"), F.lit(x).alias("x"), y.alias("y"), F.lit(width).alias("width"), F.lit(10.0).alias("height"), F.lit(10.0).alias("font_size"))
    kind = F.col("doc_id") % 3
    low = F.when(F.col("doc_id") % 2 == 0, 752.0).otherwise(760.0)
    head = F.array(line(0, F.concat(F.lit("Lecture 5 - "), "page"), 400.0, F.lit(20.0), 110.0))
    foot = F.array(line(0, F.lit("Issued by the office of public records"), 36.0, low, 240.0), line(1, F.concat(F.lit("sheet "), F.col("doc_id") * 7919 + F.col("page") * 104729), 36.0, F.lit(772.0), 250.0))
    row = F.array(line(0, F.concat(F.lit("Row total "), F.col("page") * 7, F.lit(" units")), 36.0, F.lit(400.0), 120.0))
    rows = page_keys(spark, d).select("doc_id", F.lit(None).cast("string").alias("source"), "page", F.lit(900).alias("block"), F.when(kind == 0, head).when(kind == 1, foot).otherwise(row).alias("lines"))
    size = lambda c, end: F.array_max(F.transform("lines", lambda l: l[c] + l[end])) - F.array_min(F.transform("lines", lambda l: l[c]))
    first = F.get("lines", F.lit(0))
    planted = rows.select("doc_id", "source", "page", "block", F.array_join(F.transform("lines", lambda l: l["text"]), "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"), F.lit(10.0).alias("font_size"), first["x"].alias("x"), first["y"].alias("y"), size("x", "width").alias("width"), size("y", "height").alias("height"), "lines")
    return blocks(spark, d).unionByName(planted)


@query("+" + _MARKED + " select doc_id, whole, bin, key, on_pages from rep")
def repeated_chrome(spark, d):
    return chrome.repeated_keys(chromed(spark, d), W, H)


@query("+" + _MARKED + " select doc_id, page, block, repeated, md5(text) as digest, y, height from marked")
def chrome_cut_blocks(spark, d):
    """Every block marked or not, feet cut where their lines differ."""
    return chrome.mark_repeated(chromed(spark, d), W, H).select("doc_id", "page", "block", "repeated", F.md5(F.col("text").cast("binary")).alias("digest"), "y", "height")


@query("+" + _MARKED + " select doc_id, page, md5(coalesce(string_agg(text, chr(10) order by block) filter (where not repeated), '')) as digest from marked group by all")
def strip_repeated_body(spark, d):
    return chrome.body_text(chrome.mark_repeated(chromed(spark, d), W, H)).select("doc_id", "page", F.md5(F.col("body").cast("binary")).alias("digest"))


@query("+" + _MARKED + """, p as (select a.doc_id, a.page, a.block, b.block as chrome, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y) as depth, b.y - (a.y + a.height) as gap from marked a join marked b on a.doc_id = b.doc_id and a.page = b.page
where not a.repeated and b.repeated and b.y + b.height > a.y and least(a.x + a.width, b.x + b.width) > greatest(a.x, b.x))
select doc_id, page, block, coalesce(arg_min(chrome, (-depth, chrome)) filter (where depth > 0), arg_min(chrome, (gap, chrome)) filter (where depth <= 0 and gap >= 0 and gap < 6)) as other_block, coalesce(max(depth) filter (where depth > 0), 0.0) as overlap,
coalesce(case when count(*) filter (where depth > 0) = 0 then min(gap) filter (where depth <= 0 and gap >= 0 and gap < 6) end, -1.0) as gap from p where depth > 0 or (gap >= 0 and gap < 6) group by all""")
def body_near_chrome(spark, d):
    near = chrome.body_near_chrome(chrome.mark_repeated(chromed(spark, d), W, H))
    return near.withColumns({"overlap": F.coalesce("overlap", F.lit(0.0)), "gap": F.coalesce("gap", F.lit(-1.0))})


# -- geometry rules --------------------------------------------------------------------------------


@query("""+ s as (select doc_id, page, block, width, height, case block % 5 when 0 then x - 40 when 1 then x + 576 when 2 then x - 38 else x end as x, case block % 5 when 3 then y + 740 when 4 then y - 50 else y end as y from block)
select doc_id, page, block, array_to_string(list_filter([case when x < -3.672 then 'left' end, case when y < -greatest(3.672, least(12, height * 0.1)) then 'top' end, case when x + width > 612 + 3.672 then 'right' end, case when y + height > 792 + 3.672 then 'bottom' end], lambda e: e is not null), '/') as edges from s
where x < -3.672 or y < -greatest(3.672, least(12, height * 0.1)) or x + width > 612 + 3.672 or y + height > 792 + 3.672""")
def off_page(spark, d):
    """Blocks moved over each edge, by more or less than the slack."""
    n = F.col("block") % 5
    x = F.when(n == 0, F.col("x") - 40).when(n == 1, F.col("x") + 576).when(n == 2, F.col("x") - 38).otherwise(F.col("x"))
    y = F.when(n == 3, F.col("y") + 740).when(n == 4, F.col("y") - 50).otherwise(F.col("y"))
    return rules.off_page(blocks(spark, d).drop("lines").withColumns({"x": x, "y": y}), W, H).select("doc_id", "page", "block", F.col("detail").alias("edges"))


@query("+ s as (select *, x * 1.2 as x2, width * 1.2 as w2 from block) select doc_id, page, block from s where x2 + w2 > 612 + 3.672")
def off_page_scaled(spark, d):
    """As if the pages were set a fifth larger than their sheet."""
    wide = blocks(spark, d).withColumns({"x": F.col("x") * 1.2, "width": F.col("width") * 1.2})
    return rules.off_page(wide, W, H).select("doc_id", "page", "block")


@query(r"""+ m as (select * from block) select doc_id, page, block, floor((756.0 - (y + height)) * 10 + 0.5) / 10 as rest from m where 756.0 - (y + height) >= 0 and 756.0 - (y + height) < 18 and not (length(trim(text)) between 1 and 120 and n_lines <= 2 and width <= 612 * 0.35 and abs(x + width / 2 - 306) <= 612 * 0.15)
and not (length(trim(text)) between 1 and 160 and ((width <= 40 and regexp_matches(trim(text), '^\d{1,4}$')) or regexp_matches(trim(text), '(?i)\b(?:https?://|www\.|doi:|arxiv:)') or (width <= 40 and regexp_matches(trim(text), '(?i)^m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$'))))""")
def near_bottom_edge(spark, d):
    """On a sheet of 756 points, whose last line ends near the bottom."""
    return rules.near_bottom_edge(blocks(spark, d), W, 756.0).select("doc_id", "page", "block", F.col("detail").cast("double").alias("rest"))


@query(r"""+ t as (select *, trim(text) as t from line) select doc_id, page, case when width >= height * 1.5 and width >= font_size * 6 and x + width - 570 > 0 and x + width - 570 <= font_size * 1.25 then 'right' end as edge, count(*) as n from t
where length(t) >= 8 and not regexp_matches(t, '[\p{P}\p{S}]$') group by all having edge is not null""")
def page_edge_truncated(spark, d):
    """Lines as runs on a sheet of 570 points, where full lines cross the right edge."""
    found = rules.page_edge_truncated(lines(spark, d), 570.0, H)
    return found.select("doc_id", "page", F.split("detail", ":")[0].alias("edge"), F.split("detail", ":")[1].cast("long").alias("n"))


#: Pairs of blocks of a page, those that overlap without a reason and, from 4 on, one for every reason: (block, text, box, lines' font).
_PAIRS = {
    1: [("Body text of the first column", 36, 100, 200, 12, 12), ("Another text that runs over it", 100, 104, 200, 12, 12)],
    2: [("Narrow words here", 36, 200, 100, 12, 12), ("Words printed right over them", 90, 202, 150, 12, 12)],
    3: [("Only their boxes touch, lines hardly", 36, 300, 200, 12, 12), ("as these stand nearly a line lower", 40, 308, 200, 12, 12)],
    4: [("The same words twice", 36, 340, 120, 12, 12), ("The same words, twice!", 37, 341, 120, 12, 12)],
    5: [("................", 36, 380, 200, 12, 12), ("Words among the dots", 60, 384, 120, 12, 12)],
    6: [("12", 60, 416, 10, 8, 8), ("A long line of text with a raised mark in it", 36, 420, 300, 12, 12)],
    7: [("•", 30, 460, 8, 12, 12), ("An item of a list after its bullet", 36, 460, 200, 12, 12)],
    8: [("Total sales", 40, 502, 60, 10, 10), ("48,210", 36, 500, 120, 40, 40)],
    9: [("x = 2y", 100, 561, 24, 8, 8), ("where the sum f(x) + g(y) is taken over all pairs", 36, 560, 300, 12, 12)],
    10: [("A line with a tall formula in it that", 36, 600, 300, 30, 12), ("goes on below before it ends here", 36, 614, 300, 30, 12)],
    11: [("Sales of the year in the chart", 300, 650, 60, 12, 12), ("North and south by quarter", 310, 654, 60, 12, 12)],
}


def colliding(spark: SparkSession, d: str) -> DataFrame:
    """Two blocks for each case, one case to a number, on the first page of every document."""
    made = [(2 * k + i, t, float(x), float(y), float(w), float(h), float(f)) for k, two in _PAIRS.items() for i, (t, x, y, w, h, f) in enumerate(two)]
    rows = spark.createDataFrame(made, "block int, text string, x double, y double, width double, height double, font_size double")
    line = F.struct(F.lit(0).alias("line"), "text", "x", "y", "width", "height", "font_size")
    return docs(spark, d).select("doc_id", F.lit(1).alias("page")).crossJoin(F.broadcast(rows.withColumns({"lines": F.array(line), "n_lines": F.lit(1).cast("long")})))


@query("select doc_id, 1 as page, block, other_block, area, rank, 2 as pairs from documents, (values (2, 3, 1088.0, 1), (4, 5, 460.0, 2)) as v(block, other_block, area, rank)", evidence=False)
def text_overlap_topk(spark, d):
    """Eleven pairs of blocks on a page: two collide, one touches, eight have a reason (one stands in a figure)."""
    figure = docs(spark, d).select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("image"), F.lit(280.0).alias("x"), F.lit(640.0).alias("y"), F.lit(200.0).alias("width"), F.lit(100.0).alias("height"))
    found = overlap.largest(overlap.pairs(colliding(spark, d), figure, W * H))
    return found.select("doc_id", "page", "block", "other_block", "area", F.col("rank").cast("int").alias("rank"), F.col("pairs").cast("int").alias("pairs"))


@query(r"""+ s as (select doc_id, page, line, lower(trim(text)) as key, y, font_size from line where length(trim(text)) >= 6), p as (select a.doc_id, a.page, a.key, a.y as y1, b.y as y2 from s a join s b on a.doc_id = b.doc_id and a.page = b.page and a.key = b.key and b.y - a.y >= 20)
select doc_id, page, count(distinct key) as keys, count(*) as pairs from p group by all having count(distinct key) >= 2""")
def duplicate_layer_pairs(spark, d):
    s = lines(spark, d).withColumn("key", F.lower(F.trim("text"))).filter(F.length("key") >= 6)
    pair = s.select("doc_id", "page", "key", F.col("y").alias("y1")).join(s.select("doc_id", "page", "key", F.col("y").alias("y2")), ["doc_id", "page", "key"]).filter(F.col("y2") - F.col("y1") >= 20)
    return pair.groupBy("doc_id", "page").agg(F.countDistinct("key").alias("keys"), F.count(F.lit(1)).alias("pairs")).filter("keys >= 2")


@query("+ " + _IMAGE + """, t as (select image.doc_id, image.page, max(image.width * image.height) / (612.0 * 792.0) as share from image group by all) select doc_id, page, floor(share * 1000 + 0.5) / 1000 as share from page join t using (doc_id, page) where share >= 0.9 and (text_coverage >= 0.1 or (text_coverage >= 0.02 and char_count >= 50))""")
def raster_backed_text(spark, d):
    return rules.raster_backed(pages(spark, d).withColumn("vector_count", F.lit(0)), images(spark, d)).select("doc_id", "page", F.col("detail").cast("double").alias("share"))


@query("+ " + _IMAGE + """ select i.doc_id, i.page, i.image from image i left join line l using (doc_id, page) where i.width * i.height >= 0.2 * 612.0 * 792.0 group by i.doc_id, i.page, i.image, i.x, i.y, i.width, i.height
having coalesce(sum(greatest(0, least(i.x + i.width, l.x + l.width) - greatest(i.x, l.x)) * greatest(0, least(i.y + i.height, l.y + l.height) - greatest(i.y, l.y))), 0) / (i.width * i.height) < 0.01""")
def large_raster_low_text(spark, d):
    return rules.large_raster_low_text(images(spark, d), lines(spark, d), W * H).select("doc_id", "page", F.col("detail").cast("int").alias("image"))


@query("""+ f as (select doc_id, page, 36.0 as x, 30.0 as y, 200.0 as width, 40.0 as height, 20 as preceding_runs from page where (doc_id + page) % 3 = 0), s as (select *, line as run from span where length(text) >= 3)
select s.doc_id, s.page, count(*) as n from s where exists (select 1 from f where f.doc_id = s.doc_id and f.page = s.page and f.preceding_runs >= s.run and greatest(0, least(s.x + s.width, f.x + f.width) - greatest(s.x, f.x)) * greatest(0, least(s.y + s.height, f.y + f.height) - greatest(s.y, f.y)) / (s.width * s.height) >= 0.9) group by all""")
def redaction_coverage(spark, d):
    """A dark box over the top left of every third page, drawn after 20 runs."""
    at = page_keys(spark, d).filter((F.col("doc_id") + F.col("page")) % 3 == 0)
    fills = at.select("doc_id", "page", F.lit(36.0).alias("x"), F.lit(30.0).alias("y"), F.lit(200.0).alias("width"), F.lit(40.0).alias("height"), F.lit(20).alias("preceding_runs"))
    return rules.text_under_fill(spans(spark, d).withColumn("run", F.col("line")), fills).select("doc_id", "page", F.col("detail").cast("long").alias("n"))


# -- search ----------------------------------------------------------------------------------------

_FOUND = """f as (select doc_id, page, line, q, regexp_extract_all(text, p) as m, regexp_split_to_array(text, p) as s, x, y, width, height, text from line, (values (0, '(?i)nder'), (1, '(?i)tion the')) as v(q, p)),
hit as (select doc_id, page, line, q as query, m[k] as match, list_sum(list_transform(s[1:k], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda z: length(z))), 0) as start, x, y, width, height, text from (select *, unnest(range(1, len(m) + 1)) as k from f where len(m) > 0))"""


def _hits(spark, d):
    return search.matches(lines(spark, d), search.compile_queries(["nder", "tion the"]))


@query("+ " + _FOUND + " select doc_id, page, line, query, match, cast(start as integer) as start, floor((x + width / length(text) * start) * 100 + 0.5) / 100 as x, floor(width / length(text) * length(match) * 100 + 0.5) / 100 as width from hit")
def search_literal(spark, d):
    return _hits(spark, d).select("doc_id", "page", "line", "query", "match", "start", "x", "width")


@query(r"select doc_id, page, line, unnest(regexp_extract_all(text, '[A-Z][a-z]+(?:tion|ment|heit)[ .,]')) as match from line")
def search_regex(spark, d):
    return search.matches(lines(spark, d), search.compile_queries(r"[A-Z][a-z]+(?:tion|ment|heit)[ .,]", regex=True, case_sensitive=True)).select("doc_id", "page", "line", "match")


@query("+ " + _FOUND + ", n as (select *, row_number() over (partition by doc_id, page, query order by line, start) as k from hit) select doc_id, page, query, line, cast(start as integer) as start from n where k <= 3")
def search_capped(spark, d):
    return search.capped(_hits(spark, d), 3).select("doc_id", "page", "query", "line", "start")


@query("+ " + _FOUND + " select query, count(*) as hits, count(distinct doc_id) as documents from hit group by all")
def search_multi_query(spark, d):
    return _hits(spark, d).groupBy("query").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("doc_id").alias("documents"))


@query("+ " + _FOUND + """, b as (select *, floor((x + width / length(text) * start) * 100 + 0.5) / 100 as bx, floor(width / length(text) * length(match) * 100 + 0.5) / 100 as bw from hit)
select doc_id, page, line, query, cast(start as integer) as start, 24.0::double as x, y - 12.0 as y, floor((least(612.0, x + width + 12) - 24.0) * 100 + 0.5) / 100 as width from b""")
def search_context_region(spark, d):
    ls = lines(spark, d)
    found = search.crop_region(_hits(spark, d), ls, W, H)
    return found.select("doc_id", "page", "line", "query", "start", "region.x", "region.y", "region.width")


@query("+ " + _FOUND + ", w as (select doc_id, page, line, query, start, match, text as context from hit) select doc_id, page, line, query, cast(start as integer) as start, md5(context) as digest from w")
def search_line_context(spark, d):
    found = search.with_context(_hits(spark, d), lines(spark, d))
    return found.select("doc_id", "page", "line", "query", "start", F.md5(F.col("context").cast("binary")).alias("digest"))


@query("+ " + _FOUND + " select doc_id, page, line, count(*) as hits, array_to_string(list_sort(list_distinct(list(match)))[1:4], '/') as texts from hit group by all")
def search_collapse(spark, d):
    """Hits of one line have one region, so they collapse to one row."""
    found = search.collapse(search.crop_region(_hits(spark, d), lines(spark, d), W, H))
    return found.select("doc_id", "page", F.col("first.line").alias("line"), "hits", F.array_join("texts", "/").alias("texts"))


@query("+ " + _FOUND + """, o as (select * from hit where start >= 40), n as (select * from hit where start < 40), b as (select doc_id, page, query, lower(match) as k, count(*) as budget from n group by all),
r as (select doc_id, page, query, line, start, lower(match) as k, row_number() over (partition by doc_id, page, query, lower(match) order by line, start) as i from o) select doc_id, page, query, line, cast(start as integer) as start from r left join b using (doc_id, page, query, k) where i > coalesce(budget, 0)""")
def ocr_bag_difference(spark, d):
    """Hits in the left 40 characters as native, the others as OCR."""
    found = _hits(spark, d)
    return search.bag_difference(found.filter("start < 40"), found.filter("start >= 40")).select("doc_id", "page", "query", "line", "start")


@query("+ " + _FOUND + """, r as (select doc_id, page, query, line, start, 'p' || page || ' [native] ' || match as s from hit) select doc_id, md5(string_agg(s, chr(10) order by page, query, line, start)) as digest, count(*) as matches from r group by all""")
def matches_only_report(spark, d):
    return search.matches_only(_hits(spark, d)).select("doc_id", F.md5(F.col("report").cast("binary")).alias("digest"), "matches")


# -- links and structure of HTML pages -------------------------------------------------------------


@query(r"""select page_id, cast(k - 1 as integer) as link, t[k] as target, trim(regexp_replace(s[k], '\s+', ' ', 'g')) as text, case when regexp_matches(t[k], '(?i)^https?://') then 'url' when t[k] like '#%' then 'destination' else 'relative' end as type
from (select *, unnest(range(1, len(t) + 1)) as k from (select page_id, regexp_extract_all(html, '(?i)<a\s+[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1) as t, regexp_extract_all(html, '(?i)<a\s+[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2) as s from pages))""", evidence=False)
def link_extract(spark, d):
    return forms.html_links(ev.table(spark, d, "pages"))


@query(r"""with l as (select page_id, unnest(regexp_extract_all(html, '(?i)<a\s+[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) as target, unnest(regexp_extract_all(html, '(?i)<a\s+[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) as text from pages),
w as (select *, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) > 0) as a, list_filter(regexp_split_to_array(lower(target), '[^\p{L}\p{N}]+'), lambda x: length(x) > 0) as b from l)
select page_id, count(*) as links, sum((len(a) > 0 and list_has_all(b, a))::int)::bigint as restated from w group by all""", evidence=False)
def anchor_restates_target(spark, d):
    found = forms.html_links(ev.table(spark, d, "pages"))
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.sum(search.anchor_restates_target(F.col("text"), F.col("target")).cast("int")).alias("restated"))


@query(r"""select page_id, cast(k - 1 as integer) as ord, cast(l[k] as integer) as level, trim(regexp_replace(t[k], '\s+', ' ', 'g')) as text from (select *, unnest(range(1, len(l) + 1)) as k from (select page_id, regexp_extract_all(html, '(?i)<h([1-6])[^>]*>([^<]*)</h[1-6]>', 1) as l, regexp_extract_all(html, '(?i)<h([1-6])[^>]*>([^<]*)</h[1-6]>', 2) as t from pages))""", evidence=False)
def heading_extract(spark, d):
    return forms.html_headings(ev.table(spark, d, "pages"))


@query(r"""with r as (select page_id, cast(k - 1 as integer) as row, tr[k] as tr from (select page_id, tr, unnest(range(1, len(tr) + 1)) as k from (select page_id, regexp_extract_all(html || '<table><tr class="a"><th>Page</th><th>Two <b>words</b></th></tr><tr><td>' || page_id || '</td><td> a  b</td><td></td></tr><tr></tr></table>', '(?is)<tr[^>]*>(.*?)</tr>', 1) as tr from pages)))
select page_id, row, len(regexp_extract_all(tr, '(?is)<t[hd][^>]*>(.*?)</t[hd]>', 1)) as cells, array_to_string(list_transform(regexp_extract_all(tr, '(?is)<t[hd][^>]*>(.*?)</t[hd]>', 1), lambda c: trim(regexp_replace(regexp_replace(c, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))), '|') as text from r where len(regexp_extract_all(tr, '(?is)<t[hd][^>]*>(.*?)</t[hd]>', 1)) > 0""", evidence=False)
def structure_table_grid(spark, d):
    """Pages with a table of three rows at their end, the last without a cell."""
    table = F.concat("html", F.lit('<table><tr class="a"><th>Page</th><th>Two <b>words</b></th></tr><tr><td>'), "page_id", F.lit("</td><td> a  b</td><td></td></tr><tr></tr></table>"))
    cells = forms.html_cells(ev.table(spark, d, "pages").withColumn("html", table)).withColumns({"doc_id": F.col("page_id"), "page": F.lit(1), "table": F.lit(0)})
    return forms.structure_tables(cells).select(F.col("doc_id").alias("page_id"), "row", F.size("cells").cast("long").alias("cells"), F.array_join("cells", "|").alias("text"))


@query("""+ k as (select doc_id, page, line as link, text as own, x + 30.0 as x, y, 60.0 as width, height from line where line % 5 = 0 and width > 120), p as (select k.doc_id, k.page, link, l.line, l.text from k join line l on k.doc_id = l.doc_id and k.page = l.page
where greatest(0, least(k.x + k.width, l.x + l.width) - greatest(k.x, l.x)) * greatest(0, least(k.y + k.height, l.y + l.height) - greatest(k.y, l.y)) / least(k.width * k.height, l.width * l.height) >= 0.45 and l.width > 0)
select k.doc_id, k.page, k.link, md5(string_agg(p.text, ' ' order by p.line)) as digest from k left join p using (doc_id, page, link) group by all""")
def link_text_join(spark, d):
    """A link box on every fifth line."""
    ls = lines(spark, d).filter("width > 0")
    at = ls.filter("line % 5 = 0 and width > 120").select("doc_id", "page", F.col("line").alias("link"), (F.col("x") + 30).alias("x"), "y", F.lit(60.0).alias("width"), "height")
    return forms.link_text(at, ls).select("doc_id", "page", "link", F.md5(F.col("text").cast("binary")).alias("digest"))


# -- OCR against native text -----------------------------------------------------------------------


@query(r"""+ h as (select doc_id, page, line, regexp_replace(text, '[^\x00-\x7F]', '', 'g') as s from line), t as (select doc_id, page, line, trim(regexp_replace(lower(s), '\s+', ' ', 'g')) as a, trim(regexp_replace(lower(reverse(s)), '\s+', ' ', 'g')) as b from h)
select doc_id, page, line, levenshtein(a, b) as distance from t where length(a) between 3 and 200 and length(b) between 3 and 200 and least(length(a), length(b)) / greatest(length(a), length(b)) >= 0.75 and floor(levenshtein(a, b) / greatest(length(a), length(b)) * 1000 + 0.5) / 1000 >= 0.5""")
def ocr_native_mismatch(spark, d):
    """Every line against itself reversed, as if an engine had misread it."""
    said = F.regexp_replace("text", r"[^\x{0}-\x{7F}]", "")
    pairs = lines(spark, d).select("doc_id", "page", "line", said.alias("native"), F.reverse(said).alias("ocr"), F.lit(0.95).alias("confidence"))
    return ocr.native_mismatch(pairs).select("doc_id", "page", "line", F.col("distance").cast("long").alias("distance"))


@query(r"""+ t as (select doc_id, page, text as o, regexp_replace(text, '([aeiourstn]) ', '\1', 'g') as n from page) select doc_id, page, len(regexp_extract_all(trim(n), '\s+')) as native_spaces, len(regexp_extract_all(trim(o), '\s+')) as ocr_spaces from t
where length(o) >= 120 and regexp_replace(lower(n), '\s+', '', 'g') = regexp_replace(lower(o), '\s+', '', 'g') and len(regexp_extract_all(trim(n), '\s+')) <= 0.7 * len(regexp_extract_all(trim(o), '\s+'))""")
def ocr_spacing_loss(spark, d):
    """Whole pages against themselves with the spaces after some letters lost: all other letters agree."""
    pairs = pages(spark, d).select("doc_id", "page", F.regexp_replace("text", "([aeiourstn]) ", "$1").alias("native"), F.col("text").alias("ocr"), F.lit(0.95).alias("confidence"))
    return ocr.spacing_loss(pairs).select("doc_id", "page", F.col("native_spaces").cast("long").alias("native_spaces"), F.col("ocr_spaces").cast("long").alias("ocr_spaces"))


@query()
def ocr_spacing_loss_pages(spark, d):
    """Whole pages against themselves with the spaces after most letters lost."""
    pairs = pages(spark, d).select("doc_id", "page", F.regexp_replace("text", "([aeiounrst]) ", "$1").alias("native"), F.col("text").alias("ocr"), F.lit(0.95).alias("confidence"))
    return ocr.page_spacing_loss(pairs).select("doc_id", "page", *[F.col(c).cast("long").alias(c) for c in ("native_spaces", "ocr_spaces")])


# -- regions ---------------------------------------------------------------------------------------


@query("+ " + _IMAGE + """, c as (select doc_id, page, x, y, width, height from image union all select doc_id, page, x + 10, y + 10, width / 2, height / 2 from image)
select doc_id, page, x, width from c a where not exists (select 1 from c o where o.doc_id = a.doc_id and o.page = a.page and o.width * o.height >= 1.5 * a.width * a.height and greatest(0, least(a.x + a.width, o.x + o.width) - greatest(a.x, o.x)) * greatest(0, least(a.y + a.height, o.y + o.height) - greatest(a.y, o.y)) >= 0.9 * a.width * a.height)""")
def region_contained_anti(spark, d):
    at = regions.raster_candidates(images(spark, d), W, H)
    inner = at.withColumns({"x": F.col("x") + 10, "y": F.col("y") + 10, "width": F.col("width") / 2, "height": F.col("height") / 2})
    return regions.without_contained(at.unionByName(inner)).select("doc_id", "page", "x", "width")


@query("""+ b as (select doc_id, page, x, y, width, height, width * height / (612.0 * 792.0) as share from block where width > 0), s as (select *, 100 + share * 20 + 1 as score from b), r as (select *, row_number() over (partition by doc_id, page order by score desc, y, x, width, height) as k from s)
select doc_id, page, y, floor(share * 1000 + 0.5) / 1000 as area_ratio, row_number() over (partition by doc_id, page order by y, x, width, height) as region from r where k <= 3""")
def region_topk(spark, d):
    at = blocks(spark, d).filter("width > 0").select("doc_id", "page", F.lit("block").alias("kind"), "x", "y", "width", "height", F.lit(1).alias("sources"), F.lit(1).alias("boxes"))
    return regions.ranked(at, W, H, 3).select("doc_id", "page", "y", "area_ratio", F.col("region").cast("long").alias("region"))


@query()
def visual_regions(spark, d):
    """Images and the words of pipe-parted lines as small vectors: merged, suppressed, captioned, ranked."""
    vectors = ev.spans(lines(spark, d).filter(F.contains("text", F.lit("|")))).filter(F.col("text") == "|").select("doc_id", "page", "x", "y", "width", "height")
    return regions.build(images(spark, d), vectors, lines(spark, d), W, H).drop("caption")


@query(f"select doc_id, page, region, kind, x::double as x, y::double as y, width::double as width, height::double as height, sources, coalesce(caption, '') as caption from documents, (values {planted.values(planted.REGIONS_EXPECTED)}) as v(page, region, kind, x, y, width, height, sources, caption)", evidence=False)
def planted_regions(spark, d):
    """Regions of every kind, and what suppresses, merges and labels them, on pages planted for each."""
    return planted.visual_regions(spark, docs(spark, d))


# -- orchestration and sinks -----------------------------------------------------------------------


@query()
def page_warnings(spark, d):
    """The warnings of the documents as they are laid out."""
    return process.process(docs(spark, d)).warnings


@query(f"select doc_id, page, code, severity, coalesce(cast(block as integer), -1) as block, cast(detail as varchar) as detail from documents, (values {planted.values(planted.EXPECTED)}) as v(page, code, severity, block, detail)", evidence=False)
def planted_warnings(spark, d):
    """Every warning code on a page planted for it, with the gates between rules."""
    return planted.warnings(spark, docs(spark, d))


@query("+ w as (select doc_id, page, 'off_page' as code, block from block where x + width > 560 union all select doc_id, page, 'late', block from block where n_lines > 3), r as (select *, row_number() over (partition by doc_id, page order by case when code = 'off_page' then 0 else 1 end, code, block) as rank from w) select doc_id, page, code, block, rank from r")
def warning_sort(spark, d):
    found = blocks(spark, d)
    a = rules.warning(found.filter("x + width > 560"), "off_page", F.lit(""), F.col("block"))
    b = rules.warning(found.filter("n_lines > 3"), "late", F.lit(""), F.col("block"))
    return rules.settle(rules.all_of(a, b)).select("doc_id", "page", "code", "block", F.col("rank").cast("long").alias("rank"))


@query("""+ s as (select doc_id, page, '## Page ' || page || chr(10) || chr(10) || text || chr(10) as section from page), r as (select *, sum(length(section)) over (partition by doc_id order by page) as upto from s) select doc_id, count(*) as kept, sum(length(section))::bigint as chars from r where upto <= 6000 group by all""")
def truncate_budget(spark, d):
    kept = report.within_budget(report.markdown_sections(pages(spark, d)), 6000)
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.length("section")).alias("chars"))


@query("""+ s as (select doc_id, page, '## Page ' || page || chr(10) || chr(10) || text || chr(10) as section from page) select doc_id, count(*) as pages, md5(string_agg(section, chr(10) order by page)) as digest from s group by all""")
def markdown_report(spark, d):
    """Whole documents, however long."""
    return report.markdown(report.markdown_sections(pages(spark, d))).select("doc_id", "pages", F.md5(F.col("markdown").cast("binary")).alias("digest"))


@query("""+ s as (select doc_id, page, '## Page ' || page || chr(10) || chr(10) || text || chr(10) as section from page), r as (select *, sum(length(section)) over (partition by doc_id order by page) as upto, count(*) over (partition by doc_id) as pages from s),
k as (select doc_id, any_value(pages) as pages, coalesce(string_agg(section, chr(10) order by page) filter (where upto <= 30000), '') as body, count(*) filter (where upto <= 30000) as kept from r group by all) select doc_id, pages, md5(body || case when pages > kept then chr(10) || '[... ' || (pages - kept) || ' more pages]' else '' end) as digest from k""")
def read_body(spark, d):
    """The read tool's body, whose budget is its feature."""
    return report.markdown(report.markdown_sections(pages(spark, d)), tools.BODY).select("doc_id", "pages", F.md5(F.col("markdown").cast("binary")).alias("digest"))


@query(r"""+ e as (select doc_id, page, replace(replace(replace(replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]', '�', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as t from page) select doc_id, md5('<document>' || string_agg('<page number="' || page || '">' || t || '</page>', '' order by page) || '</document>') as digest from e group by all""")
def xml_report(spark, d):
    return report.xml_pages(pages(spark, d)).select("doc_id", F.md5(F.col("xml").cast("binary")).alias("digest"))


@query("+" + _STATUS + " select doc_id, count(*) as pages, sum(char_count)::bigint as chars, md5(string_agg(text || '/' || native_text_status, chr(10) order by page)) as digest from status group by all")
def json_report(spark, d):
    """The plan's JSON, read back."""
    kind = "array<struct<page: int, text: string, char_count: long, native_text_status: string>>"
    read = process.process_to_text(docs(spark, d), process.Options(format="json")).select("doc_id", F.from_json("json", kind).alias("p"))
    said = F.array_join(F.transform("p", lambda p: F.concat_ws("/", p["text"], p["native_text_status"])), "\n")
    return read.select("doc_id", F.size("p").cast("long").alias("pages"), F.aggregate("p", F.lit(0).cast("long"), lambda n, p: n + p["char_count"]).alias("chars"), F.md5(said.cast("binary")).alias("digest"))


@query("+" + _STATUS + " select doc_id, 'pages[' || count(*) || ']{page,char_count,native_text_status}:' || chr(10) || string_agg('  ' || page || ',' || char_count || ',' || native_text_status, chr(10) order by page) as notation from status group by doc_id")
def table_notation_report(spark, d):
    return process.process_to_text(docs(spark, d), process.Options(format="table"))


@query("""+ i as (select doc_id, page, line as ord, case when line % 3 = 0 then null else line // 4 end as mcid, line % 7 = 0 as artifact, trim(text) as t from line) select doc_id, page, cast(mcid as integer) as mcid, md5(coalesce(string_agg(t, ' ' order by ord) filter (where not artifact and length(t) > 0), '')) as digest from i where mcid is not null group by all""")
def marked_content_text(spark, d):
    items = lines(spark, d).select("doc_id", "page", F.col("line").alias("ord"), F.when(F.col("line") % 3 != 0, F.floor(F.col("line") / 4).cast("int")).alias("mcid"), (F.col("line") % 7 == 0).alias("artifact"), "text")
    return document.marked_text(items).select("doc_id", "page", "mcid", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""with a as (select doc_id // 10 as doc_id, lang || '.txt' as name, sha256(text) as sha, row_number() over (partition by doc_id // 10, lang, text order by doc_id) as k from documents where text is not null), u as (select doc_id, name, sha from a where k = 1),
n as (select *, row_number() over (partition by doc_id, lower(name) order by name, sha) as i from u) select doc_id, count(*) as files, count(distinct case when i > 1 then replace(name, '.txt', '') || '-' || i || '.txt' else name end) as names from n group by all""", evidence=False)
def attachment_dedupe(spark, d):
    """Ten texts as the attachments of one document, named by language."""
    rows = docs(spark, d).filter("text is not null").select(F.floor(F.col("doc_id") / 10).alias("doc_id"), F.concat("lang", F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"))
    return document.merge_attachments(rows).groupBy("doc_id").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("file_name").alias("names"))


@query("""+ k as (select doc_id, page, line as field, x + 200.0 as x, y, 80.0 as width, height from line where line % 8 = 2 and width < 150 and width > 0) select doc_id, page, field from k""")
def form_fields(spark, d):
    """A field box right of every eighth line when it is short."""
    at = lines(spark, d).filter("line % 8 = 2 and width < 150 and width > 0").select("doc_id", "page", F.col("line").alias("field"), (F.col("x") + 200).alias("x"), "y", F.lit(80.0).alias("width"), "height")
    return forms.nearest_label(at, lines(spark, d)).select("doc_id", "page", "field")


# -- page text, rows, order ------------------------------------------------------------------------


@query(r"""+ l as (select doc_id, page, line, word, text, lag(text) over (partition by doc_id, page, line order by word) as b, lag(x + width) over (partition by doc_id, page, line order by word) as e, x, font_size from span),
s as (select *, case when b is null then '' when regexp_matches(b, '[\p{Latin}\p{Greek}\p{N})\].,;:!?]$') and regexp_matches(text, '^[\p{Latin}\p{Greek}\p{N}(]') and (x - e) / font_size >= 0.18 then ' ' when regexp_matches(b, '[\p{L}\p{N})\]]$') and regexp_matches(text, '(?i)^(?:https?://|www\.|doi:|arxiv:)') then ' ' else '' end as sep from l),
r as (select doc_id, page, line, string_agg(sep || text, '' order by word) as t from s group by all) select doc_id, page, md5(string_agg(ltrim(t), chr(10) order by line)) as digest from r group by all""")
def page_text_join(spark, d):
    """Words as text items; the last of a line ends it."""
    last = F.max("word").over(Window.partitionBy("doc_id", "page", "line"))
    # dealt out by page here, where words lie by line and by page afterwards
    items = spans(spark, d).repartition("doc_id", "page").withColumns({"has_eol": F.col("word") == last, "ord": F.col("line") * 1000 + F.col("word")}).withColumnRenamed("text", "str")
    return pagetext.page_text(items).select("doc_id", "page", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("select doc_id, page, md5(string_agg(t, chr(10) order by line)) as digest from (select doc_id, page, line, string_agg(text, ' ' order by word) as t from span group by all) group by all")
def layout_lines(spark, d):
    """The greedy fold from words back to lines."""
    found = layout.lines_from_spans(spans(spark, d).withColumn("ord", F.col("line") * 1000 + F.col("word")), gutter_em=1e6)
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "line", "text"))), lambda s: s["text"]), "\n")
    return found.groupBy("doc_id", "page").agg(F.md5(said.cast("binary")).alias("digest"))


@query(r"""+ g as (select doc_id, page, line, text, font_size, x * 4 as x, width, x * 4 - lag(x * 4 + width) over (partition by doc_id, page, line order by x, word) as gap from span),
r as (select doc_id, page, line, count(*) as n, bool_and(regexp_matches(text, '^\p{Latin}{1,16}$')) as latin, max(gap) as most, max(font_size) as em, max(x + width) - min(x) as across from g group by all)
select doc_id, page, line from r where latin and n between 3 and 6 and across <= 0.85 * 2448 and most <= 0.2 * 2448 and most > greatest(1.5 * em, 16)""")
def wide_word_rows(spark, d):
    """Words of lines set four times as far apart on a sheet as much wider."""
    return pagetext.wide_word_rows(spans(spark, d).withColumn("x", F.col("x") * 4), 4 * W)


@query("+ d as (select distinct doc_id, page, text, line, x from span) select doc_id, page, count(*) as items, count(*) * 2 as drawn from d group by all")
def text_item_dedupe(spark, d):
    """Every word drawn twice."""
    one = spans(spark, d).select("doc_id", "page", F.col("text").alias("str"), "width", "height", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), "x", "y").alias("transform"), F.lit("f").alias("font_name"), (F.col("line") * 1000 + F.col("word")).alias("ord"), F.lit(False).alias("has_eol"))
    both = one.unionByName(one.withColumn("has_eol", F.lit(True)))
    return layout.dedupe_items(both).filter("has_eol").groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("items"), (F.count(F.lit(1)) * 2).alias("drawn"))


@query("""+ b as (select *, trim(split_part(text, chr(10), 1)) as probe, row_number() over (partition by doc_id, page order by block) - 1 as k, count(*) over (partition by doc_id, page) as n from block),
p as (select b.doc_id, b.page, b.block, b.k, b.n, b.probe, strpos(page.text, b.probe) as pos, page.text as t, char_count from b join page using (doc_id, page))
select doc_id, page, block, k / greatest(n - 1, 1) as layout, coalesce(case when length(probe) >= 8 and pos > 0 and strpos(substr(t, pos + 1), probe) = 0 then (pos - 1) / greatest(char_count, 1) end, -1.0) as native from p""")
def reading_order_places(spark, d):
    ls = lines(spark, d)
    return reading.native_places(blocks(spark, d), pages(spark, d)).select("doc_id", "page", "block", "layout", F.coalesce("native", F.lit(-1.0)).alias("native"))


@query("""+ b as (select *, (block * 7) % 5 as k2 from block), o as (select *, row_number() over (partition by doc_id, page order by k2, block) - 1 as nb from b), c as (select *, trim(split_part(text, chr(10), 1)) as probe from o),
p as (select c.doc_id, c.page, c.nb, probe, strpos(page.text, probe) as pos, page.text as t, char_count from c join page using (doc_id, page)), v as (select *, case when length(probe) >= 8 and pos > 0 and strpos(substr(t, pos + 1), probe) = 0 then (pos - 1) / greatest(char_count, 1) end as native from p),
w as (select *, (native < lag(native) over (partition by doc_id, page order by nb))::int as back from v where native is not null), s as (select doc_id, page, sum(back) as back, count(*) as n from w group by all)
select doc_id, page, back::bigint as back, n from s where back >= 3 and back * 3 >= n""")
def reading_order_sequential(spark, d):
    """Blocks shuffled by their number against the text's own order."""
    ls = lines(spark, d)
    order = Window.partitionBy("doc_id", "page").orderBy((F.col("block") * 7) % 5, "block")
    shuffled = blocks(spark, d).withColumn("block", (F.row_number().over(order) - 1).cast("int"))
    found = reading.out_of_sequence(reading.native_places(shuffled, pages(spark, d)))
    return found.select("doc_id", "page", F.split("detail", "/")[0].cast("long").alias("back"), F.split("detail", "/")[1].cast("long").alias("n"))


# -- tables, forms, labels -------------------------------------------------------------------------


@query("""with g as (select l_orderkey as doc_id, l_linenumber as line, l_linenumber - row_number() over (partition by l_orderkey order by l_linenumber) as island from (select distinct l_orderkey, l_linenumber from lineitem))
select doc_id, cast(min(line) as integer) as first_line, cast(max(line) as integer) as last_line, count(*) as row_count from g group by doc_id, island having count(*) >= 5""", evidence=False)
def aligned_text_tables(spark, d):
    """Order lines as rows of three words at fixed places, 30 points apart."""
    cells = F.array("l_returnflag", "l_linestatus", F.lit("unit"))
    rows = ev.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").dropDuplicates(["l_orderkey", "l_linenumber"])
    rows = rows.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").cast("int").alias("line"), F.posexplode(cells).alias("word", "text"))
    placed = rows.withColumns({"x": 40.0 + 100 * F.col("word"), "y": 30.0 * F.col("line"), "width": F.lit(30.0), "height": F.lit(12.0)})
    return tables.aligned_text_tables(tables.rows_of(placed)).select("doc_id", "first_line", "last_line", "row_count")


@query("""+ f as (select doc_id, page, x, y, width, height from line where width between 1 and 300), m as (select *, max(y + height) over (partition by doc_id, page order by y, x rows between unbounded preceding and 1 preceding) as low from f),
n as (select *, sum(case when coalesce(y - low <= 18, false) then 0 else 1 end) over (partition by doc_id, page order by y, x) as part from m) select doc_id, page, min(y) as y, max(y + height) - min(y) as height, cast(count(*) as integer) as boxes from n group by doc_id, page, part""")
def form_regions(spark, d):
    """Short lines as fields."""
    return regions.form_candidates(lines(spark, d).filter("width between 1 and 300")).select("doc_id", "page", "y", "height", "boxes")


@query(r"""+ """ + _IMAGE + r""", l as (select doc_id, page, line, trim(text) as t, x, y, width, height from line where length(trim(text)) between 1 and 120 and regexp_matches(trim(text), '\p{L}') and len(regexp_extract_all(trim(text), '[^\p{L}\p{N}\s]')) < 0.5 * len(regexp_extract_all(trim(text), '\S')) and not regexp_matches(trim(text), '(?i)^(?:fig(?:ure)?\.?|table|tab\.|図|表)\s*[0-9]+')),
p as (select i.doc_id, i.page, l.line, l.t, case when i.y - (l.y + l.height) >= 0 then i.y - (l.y + l.height) when l.y - (i.y + i.height) >= 0 then l.y - (i.y + i.height) else 0.0 end as away,
 greatest(0, least(i.x + i.width, l.x + l.width) - greatest(i.x, l.x)) * greatest(0, least(i.y + i.height, l.y + l.height) - greatest(i.y, l.y)) >= 0.9 * l.width * l.height as inside, greatest(0, least(i.x + i.width, l.x + l.width) - greatest(i.x, l.x)) / least(i.width, l.width) as share from image i join l using (doc_id, page))
select i.doc_id, i.page, coalesce(arg_min(t, away * 1000 + line) filter (where not inside and away <= 28 and share >= 0.45), '') as label from image i left join p using (doc_id, page) group by all""")
def plain_labels(spark, d):
    """Page images with the nearest plain line."""
    at = images(spark, d).withColumnRenamed("image", "region")
    found = labels.attach(at, lines(spark, d), labels.RULES["plain_label"], W * H)
    return found.select("doc_id", "page", F.coalesce("plain_label", F.lit("")).alias("label"))


@query("""+ n as (select doc_id, page, case when doc_id % 2 = 0 then substr(text, 11, 20) else 'zzz' || page end as contents, text from page)
select doc_id, page from n where length(regexp_replace(contents, '\\s+', '', 'g')) > 0 and strpos(lower(regexp_replace(text, '\\s+', '', 'g')), lower(regexp_replace(contents, '\\s+', '', 'g'))) = 0""".replace("\\\\", "\\"))
def annotation_text_missing(spark, d):
    """A note on every page: words of it on pages of even documents, none of it on others."""
    ps = pages(spark, d)
    said = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 11, 20)).otherwise(F.concat(F.lit("zzz"), "page"))
    notes = ps.select("doc_id", "page", F.lit("FreeText").alias("subtype"), said.alias("contents"), F.array(F.lit("print")).alias("flag_names"))
    return forms.missing_annotation_text(notes, ps).select("doc_id", "page")


@query("""with recursive node as (select r_regionkey as node, null::integer as parent, r_regionkey as ord, r_name as title from region union all select 100 + n_nationkey, n_regionkey, n_nationkey, n_name from nation),
w as (select node, title, 1 as depth from node where parent is null union all select n.node, n.title, w.depth + 1 from w join node n on n.parent = w.node) select node, title, depth from w""", evidence=False)
def outline_tree(spark, d):
    """Regions as bookmarks with nations below them."""
    none = F.lit(None).cast("string")
    top = ev.table(spark, d, "region").select(F.lit(1).alias("doc_id"), F.col("r_regionkey").cast("int").alias("node"), F.lit(None).cast("int").alias("parent"), F.col("r_regionkey").cast("int").alias("ord"), F.col("r_name").alias("title"), none.alias("url"), none.alias("dest"))
    low = ev.table(spark, d, "nation").select(F.lit(1).alias("doc_id"), (F.col("n_nationkey") + 100).cast("int").alias("node"), F.col("n_regionkey").cast("int").alias("parent"), F.col("n_nationkey").cast("int").alias("ord"), F.col("n_name").alias("title"), none.alias("url"), none.alias("dest"))
    return document.outline(top.unionByName(low)).select("node", "title", "depth")


@query("""+ n as (select *, coalesce(abs(y - lag(y) over (partition by doc_id, page order by y, x, word)) > 0.75 * height, true)::int as new from span), s as (select *, sum(new) over (partition by doc_id, page order by y, x, word) - 1 as l from n)
select doc_id, page, cast(l as integer) as line, md5(string_agg(text, ' ' order by x, word, text)) as digest from s group by all""")
def ocr_word_lines(spark, d):
    """Words as an engine would give them."""
    return ocr.words_to_lines(spans(spark, d)).select("doc_id", "page", F.col("line").cast("int").alias("line"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("+" + _STATUS + ", c as (select doc_id, page, floor(least(1.0, greatest(0.0, ((doc_id * 13 + page * 7) % 110) / 100.0)) * 1000 + 0.5) / 1000 as confidence, char_count from status) select doc_id, page, confidence from c where confidence < 0.5 and char_count < 400")
def ocr_low_confidence(spark, d):
    """Confidences by number; short pages as the weak ones."""
    ps = pages(spark, d)
    seen = ps.select("doc_id", "page", ocr.confidence(((F.col("doc_id") * 13 + F.col("page") * 7) % 110).cast("double")).alias("confidence"))
    weak = ps.filter("char_count < 400")
    return rules.low_confidence_ocr(seen, weak).select("doc_id", "page", F.col("detail").cast("double").alias("confidence"))


@query("+ " + _FOUND + ", r as (select doc_id, page, line, query, start, dense_rank() over (partition by doc_id order by page, line) as ord from hit) select doc_id, page, line, count(*) as hits, any_value(ord)::bigint as ord from r where ord <= 5 group by all")
def search_tool(spark, d):
    """The search tool: places in order, five a document."""
    hits = search.collapse(search.crop_region(_hits(spark, d), lines(spark, d), W, H))
    return hits.filter("ord <= 5").select("doc_id", "page", F.col("first.line").alias("line"), "hits", F.col("ord").cast("long").alias("ord"))


@query("""+ s as (select doc_id, page, '## Page ' || page || chr(10) || chr(10) || text || chr(10) as section from page), r as (select *, sum(length(section)) over (partition by doc_id order by page) as upto, count(*) over (partition by doc_id) as pages from s),
k as (select doc_id, any_value(pages) as pages, coalesce(string_agg(section, chr(10) order by page) filter (where upto <= 30000), '') as body, count(*) filter (where upto <= 30000) as kept from r group by all)
select doc_id, case when pages <= 20 then 'body' else 'map' end as kind, case when pages <= 20 then md5(body || case when pages > kept then chr(10) || '[... ' || (pages - kept) || ' more pages]' else '' end) else 'text:' end as said from k""")
def read_tool(spark, d):
    """Documents of up to 20 pages are read within a budget; of others comes a map, which begins with their text status."""
    found = tools.read(docs(spark, d))
    return found.select("doc_id", "kind", F.when(F.col("kind") == "body", F.md5(F.col("body").cast("binary"))).otherwise(F.substring("body", 1, 5)).alias("said"))


@query()
def vertical_text(spark, d):
    """Letters of the first words, one under another, as glyphs of a column; ruby finds none here."""
    rows = spans(spark, d).filter("word = 0").withColumns({"text": F.translate(F.lower(F.substring("text", 1, 1)), "abcdefghijklmnopqrstuvwxyz", "日一国会人年大十二本中長出三同時政事自行社見月分議後"), "x": F.lit(300.0)})
    return vertical.vertical_blocks(vertical.vertical_runs(rows))


@query(r"+ m as (select doc_id, page, line, unnest(regexp_extract_all(text, '(?i)(?:the|of|and)(?: [a-z]+){0,3} (?:in|to) ')) as match from line) select doc_id, page, line, match, count(*) as n from m group by all")
def search_guarded(spark, d):
    """A pattern that backtracks, under its time limits."""
    found = search.matches_guarded(lines(spark, d), search.compile_queries(r"(?:the|of|and)(?: [a-z]+){0,3} (?:in|to) ", regex=True))
    return found.filter(~F.col("timed_out")).groupBy("doc_id", "page", "line", "match").agg(F.count(F.lit(1)).alias("n"))


@query(r"""+ t as (select doc_id, page, trim(text) as t, text from line) select doc_id, page, sum(regexp_matches(t, '^(?:\d+|[IVXLC]+)[.)]\s+\p{L}')::int)::bigint as numbered, sum(regexp_matches(t, '^\d+(?:\.\d+)+\.?\s+\p{L}')::int)::bigint as sections, sum(regexp_matches(t, '^(?:\d{1,2}[a-z]?|[a-z])[.)]?\s')::int)::bigint as items,
sum((length(t) between 1 and 220 and regexp_matches(t, '[\p{L}\p{N}]'))::int)::bigint as usable, sum(regexp_matches(t, '(?i)^(?:fig(?:ure)?\.?|table|tab\.|図|表)\s*[0-9]+')::int)::bigint as captions from t group by all""")
def line_predicates(spark, d):
    """Lines of each page that match the grammars of headings, items, labels and captions."""
    t = F.col("text")
    n = lambda c, name: F.sum(c.cast("int")).alias(name)
    return lines(spark, d).groupBy("doc_id", "page").agg(n(P.numbered_heading(t), "numbered"), n(P.decimal_section(t), "sections"), n(P.item_marker(t), "items"), n(P.usable_label(t), "usable"), n(P.caption(t), "captions"))


@query("+ " + _FOUND + """, b as (select doc_id, page, line, query, start, floor((x + width / length(text) * start) * 100 + 0.5) / 100 as bx, floor(width / length(text) * length(match) * 100 + 0.5) / 100 as bw from hit)
select b.doc_id, b.page, b.line, query, count(*) as parts, floor(sum(floor((least(bx + bw, s.x + s.width) - greatest(bx, s.x)) * 100 + 0.5) / 100) * 100 + 0.5) / 100 as across from b join span s on b.doc_id = s.doc_id and b.page = s.page and b.line = s.line and least(bx + bw, s.x + s.width) - greatest(bx, s.x) > 0.01 group by all""")
def search_owners(spark, d):
    """Matches cut into the words they run over."""
    found = search.owners(_hits(spark, d), spans(spark, d))
    return found.groupBy("doc_id", "page", "line", "query").agg(F.count(F.lit(1)).alias("parts"), G.half_up(F.sum("width")).alias("across"))


@query("""+ a as (select * from line where length(trim(text)) between 1 and 40), p as (select a.doc_id, a.page, a.line, a.text as t, b.text as bt, b.line as bl, b.y - (a.y + a.height) as gap from a join line b on a.doc_id = b.doc_id and a.page = b.page and b.line > a.line and b.line <= a.line + 24
where b.y - (a.y + a.height) >= 0 and b.y - (a.y + a.height) <= 1.6 * a.height and abs((a.x + a.width / 2) - (b.x + b.width / 2)) <= greatest(a.height, 4)),
n as (select doc_id, page, line, any_value(t) as t, arg_min(bt, gap * 1000 + bl) as bt from p group by all) select doc_id, page, line, trim(t) || ' ' || trim(bt) as text from n""")
def search_stacked_labels(spark, d):
    return search.stacked_labels(lines(spark, d)).select("doc_id", "page", "line", "text")


@query("+ " + _FOUND + """, c as (select doc_id, page, count(*) filter (where query = 0) as n from hit group by all), z as (select page.doc_id, page.page, coalesce(n, 0) as n from page left join c using (doc_id, page))
select doc_id, page, n as native, 1 as fields, 1 as notes, 1 as links, 1 as seen from z""")
def search_sources(spark, d):
    """A field's value, a note, a link's target (another's text says it already) and a word that only an engine saw, on every page."""
    ls, keys = lines(spark, d), page_keys(spark, d)
    box = lambda y: [F.lit(v).alias(n) for n, v in (("x", 400.0), ("y", y), ("width", 90.0), ("height", 12.0))]
    none = F.lit(None).cast("string")
    fields = keys.select("*", F.lit(0).alias("field"), F.lit("Gunder").alias("value"), none.alias("caption"), F.array().cast("array<string>").alias("options"), *box(770.0))
    notes = keys.select("*", F.lit(0).alias("annotation"), F.lit("under a tree").alias("contents"), F.lit("Note").alias("title"), *box(772.0))
    links = keys.select("*", F.lit(0).alias("link"), F.lit("click here").alias("text"), F.lit("https://a.b/under").alias("target"), *box(774.0)).unionByName(keys.select("*", F.lit(1).alias("link"), F.lit("under").alias("text"), F.lit("under").alias("target"), *box(776.0)))
    words = spans(spark, d).select("doc_id", "page", (F.col("line") * 1000 + F.col("word")).alias("word"), "text", "x", "y", "width", "height").unionByName(keys.select("*", F.lit(999_999).alias("word"), F.lit("wonder").alias("text"), *box(780.0)))
    found = search.everywhere(ls, search.compile_queries("nder"), fields, notes, links, words)
    n = lambda source, name: F.count(F.when(F.col("source") == source, 1)).alias(name)
    return found.groupBy("doc_id", "page").agg(n("native", "native"), *[n(a, b).cast("int").alias(b) for a, b in (("formField", "fields"), ("annotation", "notes"), ("link", "links"), ("ocr", "seen"))])


_FRAGMENT = f"not regexp_matches(t, '{P.NUMBERED}') and not (regexp_matches(t, '{P.LETTERED}') and length(t) <= 80) and (regexp_matches(t, '^\\p{{Ll}}') or regexp_matches(lower(t), '(^|[^\\p{{L}}\\p{{N}}_])et al\\.') or regexp_matches(t, '[\\p{{L}}\\p{{N}}]-$') or regexp_matches(t, '[.!?。！？]$') or (regexp_matches(t, '[,;、。，；]') and (length(t) > 24 or len(regexp_extract_all(t, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}]')) >= 12)) or len(regexp_extract_all(t, '\\S+')) > 16)"
_P = {
    "lettered": (lambda t: P.lettered_section(t), f"regexp_matches(t, '{P.LETTERED}') and length(t) <= 80"),
    "fragment": (lambda t: P.sentence_fragment(t), _FRAGMENT),
    "small": (lambda t: P.small_heading_fragment(t), f"({_FRAGMENT}) or (not regexp_matches(t, '{P.NUMBERED}') and (regexp_matches(t, '[,;:]') or len(regexp_extract_all(t, '\\S+')) > 7))"),
    "figures": (lambda t: P.caption_kind(t) == "figure", r"regexp_matches(t, '(?i)^(?:fig(?:ure)?\.?|図)\s*[0-9]')"),
    "tables": (lambda t: P.caption_kind(t) == "table", r"regexp_matches(t, '(?i)^(?:table|tab\.|表)\s*[0-9]') and not regexp_matches(t, '(?i)^(?:fig(?:ure)?\.?|図)\s*[0-9]')"),
    "chrome": (lambda t: P.label_chrome(t), r"regexp_matches(t, '(?i)^(?:page\s*\d+(?:\s+of\s+\d+)?|form\s+[\w-]+|omb\s+no\.?.*|\d{1,3}|rev\.?\s.*)$')"),
    "marker": (lambda t: P.field_marker(t), f"regexp_matches(t, '{P.FIELD_MARK}')"),
    "section": (lambda t: P.form_section(t), f"regexp_matches(t, '{P.FORM_SECTION}')"),
    "dotted": (lambda t: P.dotted_texture(t), "len(regexp_extract_all(t, '[.·•․‥…]')) >= 12 and len(regexp_extract_all(t, '[.·•․‥…]')) / greatest(1, len(regexp_extract_all(t, '\\S'))) >= 0.65 and len(regexp_extract_all(t, '[\\p{L}\\p{N}]')) / greatest(1, len(regexp_extract_all(t, '\\S'))) <= 0.2"),
    "numeric": (lambda t: T.numeric_line(t), r"length(t) between 1 and 80 and regexp_matches(t, '\d') and regexp_matches(t, '^[0-9.,()%+$¥€£\s-]+$')"),
    "currency": (lambda t: T.currency_only(t), "t in ('$', '¥', '€', '£')"),
    "cjk": (lambda t: T.cjk_leading(t), r"regexp_matches(t, '^[\x{2E80}-\x{2EFF}\x{3000}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]')"),
    "rtl": (lambda t: T.rtl_dominant(t), r"len(regexp_extract_all(t, '[\x{590}-\x{8FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]')) > 0 and len(regexp_extract_all(t, '[\x{590}-\x{8FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]')) >= len(regexp_extract_all(t, '[A-Za-z\x{C0}-\x{24F}]'))"),
}
#: Lines planted among the documents' own, by line number.
_SAID = ["A. Income of the year", "page 3 of 9", "12a.", "Part II of the form", "Figure 3", "Table 4 of 9", "................ .", "1,200 %", "€", "日本語", "שלום a", "Form W-2"]


@query("+ said as (select doc_id, page, case when line % 20 = 7 then (" + str(_SAID).replace('"', "'") + ")[1 + (doc_id + page + line) % 12] else trim(text) end as t from line) select doc_id, page, " + ", ".join(f"sum(coalesce({q}, false)::int)::bigint as {n}" for n, (_, q) in _P.items()) + " from said group by all")
def line_grammars(spark, d):
    """Lines of each page that match a grammar; every twentieth is planted."""
    at = ((F.col("doc_id") + F.col("page") + F.col("line")) % len(_SAID)).cast("int")
    said = F.when(F.col("line") % 20 == 7, F.get(F.array(*map(F.lit, _SAID)), at)).otherwise(F.trim("text"))
    return lines(spark, d).select("doc_id", "page", said.alias("t")).groupBy("doc_id", "page").agg(*[F.sum(F.coalesce(test(F.col("t")), F.lit(False)).cast("int")).alias(n) for n, (test, _) in _P.items()])


_B = {
    "usable": (P.usable_box, "width >= 18 and height >= 18"),
    "near_full": (lambda b: P.near_full_page(b, W, H), "width >= 0.9 * 612 and height >= 0.9 * 792"),
    "side": (lambda b: P.side_chrome(b, W, H), "width <= 0.08 * 612 and height >= 0.6 * 792 and (x <= 0.08 * 612 or x + width >= 0.92 * 612)"),
    "band": (lambda b: P.horizontal_chrome(b, W, H), "height <= 0.04 * 792 and width >= 0.5 * 612 and (y <= 0.12 * 792 or y + height >= 0.88 * 792)"),
    "background": (lambda b: P.background(b, W, H), "width * height >= 0.85 * 612 * 792"),
    "micro": (P.micro_vector, "width * height <= 100 and greatest(width, height) between 0.5 and 18"),
}
#: Boxes of every kind: a page, a rail, a band, a dot, and the page's own block.
_BOXES = [(6.0, 6.0, 600.0, 780.0), (4.0, 40.0, 30.0, 700.0), (40.0, 20.0, 500.0, 10.0), (100.0, 100.0, 5.0, 6.0), (570.0, 60.0, 40.0, 600.0)]
_BOXED = "boxed as (select doc_id, page, x, y, width, height from block union all select doc_id, page, bx, \"by\", bw, bh from page, (values " + ", ".join(map(str, _BOXES)) + ") as v(bx, \"by\", bw, bh))"


def boxed(spark: SparkSession, d: str) -> DataFrame:
    made = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("x", "y", "width", "height"), b, strict=True)]) for b in _BOXES])
    return blocks(spark, d).select("doc_id", "page", "x", "y", "width", "height").unionByName(page_keys(spark, d).select("doc_id", "page", F.inline(made)))


@query("+ " + _BOXED + " select doc_id, page, " + ", ".join(f"sum(({q})::int)::bigint as {n}" for n, (_, q) in _B.items()) + " from boxed group by all")
def box_predicates(spark, d):
    """Boxes of each page that are of a kind."""
    return boxed(spark, d).groupBy("doc_id", "page").agg(*[F.sum(test(G.box()).cast("int")).alias(n) for n, (test, _) in _B.items()])


@query("+ " + _BOXED + """, p as (select *, least(x + width, 400) - greatest(x, 100) as ox, least(y + height, 400) - greatest(y, 200) as oy from boxed), q as (select doc_id, page, greatest(0, ox) * greatest(0, oy) as area, least(width * height, 60000) as small, greatest(width * height, 60000) as large, ox, oy, x, y, width, height from p where width > 0)
select doc_id, page, floor(sum(small / large) * 100 + 0.5) / 100 as alike, floor(sum(greatest(0, ox) / least(width, 300)) * 100 + 0.5) / 100 as across, floor(sum(greatest(0, oy) / least(height, 200)) * 100 + 0.5) / 100 as down, sum((ox >= -10 and oy >= -10)::int)::bigint as touching,
floor(sum(area / small) * 100 + 0.5) / 100 as shared, floor(sum(greatest(0, least(300, x + width) - greatest(0, x)) * greatest(0, least(300, y + height) - greatest(0, y))) * 100 + 0.5) / 100 as shown from q group by all""")
def box_arithmetic(spark, d):
    """Each box against one of 300 by 200 points at (100, 200), and cut to a sheet of 300 by 300."""
    one = F.struct(F.lit(100.0).alias("x"), F.lit(200.0).alias("y"), F.lit(300.0).alias("width"), F.lit(200.0).alias("height"))
    b, seen = G.box(), G.visible(G.box(), F.lit(300.0), F.lit(300.0))
    total = lambda c, n: G.half_up(F.sum(c)).alias(n)
    rows = boxed(spark, d).filter("width > 0")
    return rows.groupBy("doc_id", "page").agg(
        total(G.area_similarity(b, one), "alike"), total(G.horizontal_overlap_ratio(b, one), "across"), total(G.vertical_overlap_ratio(b, one), "down"), F.sum(G.touches(b, one, 10).cast("int")).alias("touching"),
        total(G.overlap_of_smaller(b, one), "shared"), total(G.area(seen), "shown"),
    )


@query("""+ b as (select doc_id, page, block, x, 792 - (y + height) as low, x + width as r, 792 - y as high, n_lines, font_size from block) select doc_id, page, block, floor(x * 100 + 0.5) / 100 as x, floor((792 - high) * 100 + 0.5) / 100 as y, floor((r - x) * 100 + 0.5) / 100 as width, floor((high - low) * 100 + 0.5) / 100 as height,
array_to_string(list_filter([case when n_lines & 1 = 1 then 'invisible' end, case when n_lines & 2 = 2 then 'hidden' end, case when n_lines & 4 = 4 then 'print' end, case when n_lines & 8 = 8 then 'noZoom' end, case when n_lines & 16 = 16 then 'noRotate' end, case when n_lines & 32 = 32 then 'noView' end], lambda z: z is not null), '/') as flags,
font_size * 2 as font, floor((r - x + 4) * 100 + 0.5) / 100 as quad_width from b""")
def annotation_geometry(spark, d):
    """Blocks as annotations: rectangles from the bottom left with corners in any order, flags, a quadrilateral and a text matrix."""
    low, high, right = H - (F.col("y") + F.col("height")), H - F.col("y"), F.col("x") + F.col("width")
    rows = blocks(spark, d).select("doc_id", "page", "block", "font_size", F.array(right, high, "x", low).alias("rect"), F.array(F.col("x") - 2, low, right + 2, low, "x", high, right, high).alias("quad"), F.col("n_lines").cast("int").alias("flags"))
    found = forms.boxed(rows, H)
    matrix = F.array(F.col("font_size"), F.lit(0.0), F.lit(0.0), F.col("font_size") * 2, F.lit(0.0), F.lit(0.0))
    quads = G.quad_boxes(F.col("quad"), F.lit(H))
    return found.select("doc_id", "page", "block", "x", "y", "width", "height", F.array_join("flag_names", "/").alias("flags"), G.matrix_font_size(matrix).alias("font"), F.get(quads, F.lit(0))["width"].alias("quad_width"))


@query(r"""+ w as (select doc_id, page, line, text, list_filter(string_split(regexp_replace(lower(trim(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))), ' +', ' ', 'g'), ' '), lambda x: length(x) > 0) as t from line),
n as (select doc_id, page, case when line % 2 = 0 then t[1:2] else [t[1], 'zzz'] end as name, t from w where len(t) >= 2)
select doc_id, page, sum(list_has_all(t, name)::int)::bigint as matched, sum((len(list_filter(name, lambda x: length(x) >= 3)) > 0 and not list_has_any(list_filter(name, lambda x: length(x) >= 3), t))::int)::bigint as contradicted from n group by all""")
def field_names(spark, d):
    """Names made of a line's first words (or of its first and another) against the line as a label."""
    name = lambda t: F.when(F.col("line") % 2 == 0, F.concat_ws("_", F.get(t, F.lit(0)), F.get(t, F.lit(1)))).otherwise(F.concat(F.get(t, F.lit(0)), F.lit(".Zzz")))
    named = T.once(T.field_name_tokens(F.col("text")), lambda t: F.when(F.size(t) >= 2, name(t)))
    told = F.transform(F.filter(F.array(named), lambda n: n.isNotNull()), lambda n: P.name_and_label(n, F.col("text")))
    rows = lines(spark, d).select("doc_id", "page", F.inline(told))
    return rows.groupBy("doc_id", "page").agg(F.sum(F.col("matches").cast("int")).alias("matched"), F.sum(F.col("contradicts").cast("int")).alias("contradicted"))


@query("""with c as (select l_orderkey as doc_id, l_linenumber as line, unnest([cast(cast(l_quantity as integer) as varchar), case when l_partkey % 2 = 0 then '$' else '7%' end, case when l_suppkey % 3 = 0 then l_linestatus else cast(l_suppkey as varchar) end]) as text from lineitem),
r as (select doc_id, line, sum(regexp_full_match(text, '[0-9]+%?')::int) as n, bool_and(regexp_full_match(text, '[0-9]+%?') or text = '$') as ok from c group by all) select doc_id, cast(line as integer) as line from r where n >= 2 and ok""", evidence=False)
def numeric_only_rows(spark, d):
    """Order lines as rows of a number, a sign or share, and a number or letter."""
    cells = F.array(F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_partkey") % 2 == 0, "$").otherwise("7%"), F.when(F.col("l_suppkey") % 3 == 0, F.col("l_linestatus")).otherwise(F.col("l_suppkey").cast("string")))
    rows = ev.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").cast("int").alias("line"), F.explode(cells).alias("text"))
    return layout.numeric_rows(rows).select("doc_id", "line")


@query("select doc_id, page, page = 1 as grid, page in (1, 2) as fragment, page = 3 as legend from documents, (values (1), (2), (3), (4)) as v(page)", evidence=False)
def chart_numbers(spark, d):
    """A grid of tiny numbers, a piece of one, a legend's numbers far apart, and a table."""
    made = [(1, f"{i}.{j}", 50.0 + 20 * i, 100.0 + 10 * j, 8.0, 5.0, 5.0) for i in range(7) for j in range(7)] + [(2, t, 50.0 + 20 * (i % 4), 100.0 + 10 * (i // 4), 8.0, 5.0, 5.0) for i, t in enumerate(["1", "2", "3", "4", "5", "6", "a", "b"])]
    made += [(3, str(10 * i), 50.0 + 60 * (i % 4), 100.0 + 50 * (i // 4), 14.0, 7.0, 7.0) for i in range(8)] + [(4, str(10 * i), 50.0 + 90 * (i % 3), 100.0 + 16 * (i // 3), 30.0, 11.0, 11.0) for i in range(24)]
    rows = docs(spark, d).select("doc_id").crossJoin(F.broadcast(spark.createDataFrame(made, "page int, text string, x double, y double, width double, height double, font_size double")))
    return layout.chart_numbers(rows, ["doc_id", "page"])


@query(r"""+ w as (select doc_id, page, line, word, x, case when line % 2 = 0 and word % 3 > 0 then 'שלום' else text end as text from span), k as (select *, len(regexp_extract_all(text, '[\x{590}-\x{8FF}]')) > 0 as rtl, len(regexp_extract_all(text, '[\x{590}-\x{8FF}]')) = 0 and regexp_matches(text, '[A-Za-z\x{C0}-\x{24F}]') as ltr from w),
t as (select *, sum(rtl::int) over p > 0 and sum(rtl::int) over p >= sum(ltr::int) over p as turned from k window p as (partition by doc_id, page, line)) select doc_id, page, line, word, cast(row_number() over (partition by doc_id, page, line order by case when turned then -x else x end, text) - 1 as integer) as place from t""")
def text_order(spark, d):
    """Of every other line two words in three are Hebrew."""
    said = F.when((F.col("line") % 2 == 0) & (F.col("word") % 3 > 0), "שלום").otherwise(F.col("text"))
    return layout.text_order(spans(spark, d).withColumn("text", said), ["doc_id", "page", "line"]).select("doc_id", "page", "line", "word", "place")


@query(r"""+ s as (select *, case when line % 4 = 1 then (line * 7) || '' else text end as t, case when line % 4 = 1 then 20.0 else x end as x1, case when line % 4 = 1 then 30.0 else width end as w1 from line), p as (select *, lag(t) over o as bt, lag(x1) over o as bx, lag(w1) over o as bw from s window o as (partition by doc_id, page order by line))
select doc_id, page, line from p where regexp_full_match(trim(regexp_replace(t, '\s+', ' ', 'g')), '[\p{N}\s.-]{1,12}') and w1 <= 0.12 * 612 and regexp_matches(bt, '\p{L}') and (x1 < bx or least(bx + bw, x1 + w1) - greatest(bx, x1) < 0.5 * w1)""")
def lone_numbers(spark, d):
    """Every fourth line is a number set to the left of the others."""
    odd = F.col("line") % 4 == 1
    rows = lines(spark, d).withColumns({"text": F.when(odd, (F.col("line") * 7).cast("string")).otherwise(F.col("text")), "x": F.when(odd, 20.0).otherwise(F.col("x")), "width": F.when(odd, 30.0).otherwise(F.col("width"))})
    order = Window.partitionBy("doc_id", "page").orderBy("line")
    before = {c: F.lag(c).over(order) for c in ("text", "x", "width")}
    rows = rows.withColumns({f"b_{c}": v for c, v in before.items()})
    return rows.filter(P.lone_number(F.col("text"), F.col("width"), F.col("x"), F.col("b_text"), F.col("b_x"), F.col("b_width"), W)).select("doc_id", "page", "line")
