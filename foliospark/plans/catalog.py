"""The registered queries over the tables of a folder, and the equivalent SQL of each."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bridge
from ..functions import geometry as G
from ..functions import text as T
from ..operators import export, progress, quality, relational, rows, sections, spatial
from ..sources import files
from ..sources.files import table
from ..streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def shared_folder(spark: SparkSession) -> None:
    """A checkpoint folder for iterative queries: the session's own, or a temporary one on a single machine."""
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="foliospark-"))


# -- inputs ------------------------------------------------------------------
# Documents have no geometry of their own: a line's place on a page of 40 lines, and
# glyph and region boxes, are made from the tables' numbers, the same way in SQL.


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    page = F.floor(F.col("line_no") / 40).cast("int")
    return docs.select("doc_id", "lang", "line_no", "line", page.alias("page_index"), (F.col("line_no") % 40).alias("pos"), ((F.col("line_no") % 40) / F.lit(40.0)).alias("top"))


LINES = """lines as (select doc_id, lang, line_no, line, line_no // 40 as page_index, line_no % 40 as pos, (line_no % 40) / 40.0::double as top from (
    select doc_id, lang, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_no from documents))"""


def document_rows(spark: SparkSession, d: str) -> DataFrame:
    return text_lines(spark, d).select("doc_id", "page_index", "pos", F.col("line").alias("text"), F.lit("text").alias("kind"), F.lit(0.1).alias("left"), "top", F.lit(0.8).alias("width"), F.lit(0.02).alias("height"), F.lit(10.0).alias("font_size"), F.lit(False).alias("font_bold"))


def glyphs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    x, y = F.col("l_partkey") % 300, F.col("l_suppkey") % 200
    return t.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), ((F.col("l_linenumber").cast("long") * 10_000_000 + F.col("l_partkey")) * 10_000_000 + F.col("l_suppkey")).alias("glyph_id"), F.col("l_linenumber").alias("n"), (F.col("l_linenumber") % 3).alias("para_id"), (F.col("l_linenumber") % 2).alias("comp_id"), (F.col("l_linenumber") % 3).alias("row_id"), F.when(F.col("l_linenumber") % 5 == 0, "formula").otherwise("text").alias("kind"), F.col("l_returnflag").alias("ch"), x.cast("double").alias("x"), y.cast("double").alias("y"), (x + 6).cast("double").alias("x2"), (y + 10).cast("double").alias("y2"), (8 + F.col("l_linenumber") % 4).cast("double").alias("font_size"))


GLYPHS = """glyphs as (select l_orderkey as doc_id, 0 as page_index, (l_linenumber::bigint * 10000000 + l_partkey) * 10000000 + l_suppkey as glyph_id, l_linenumber as n, l_linenumber % 3 as para_id, l_linenumber % 2 as comp_id, l_linenumber % 3 as row_id,
    case when l_linenumber % 5 = 0 then 'formula' else 'text' end as kind, l_returnflag as ch, (l_partkey % 300)::double as x, (l_suppkey % 200)::double as y, (l_partkey % 300 + 6)::double as x2, (l_suppkey % 200 + 10)::double as y2, (8 + l_linenumber % 4)::double as font_size from lineitem)"""


def regions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    x, y = (F.col("o_custkey") * (F.col("k") + 1)) % 200, (F.col("o_custkey") * (F.col("k") + 3)) % 100
    name = F.element_at(F.array(F.lit("figure"), F.lit("table"), F.lit("figure_caption")), F.col("k") + 1)
    return t.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.col("k").alias("region_id"), name.alias("class_name"), ((F.col("o_custkey") % 10) / 10.0).alias("conf"), x.cast("double").alias("x"), y.cast("double").alias("y"), (x + 100 + 20 * F.col("k")).cast("double").alias("x2"), (y + 80).cast("double").alias("y2"))


REGIONS = """regions as (select o_orderkey as doc_id, 0 as page_index, k as region_id, ['figure', 'table', 'figure_caption'][k + 1] as class_name, (o_custkey % 10) / 10.0::double as conf,
    (o_custkey * (k + 1) % 200)::double as x, (o_custkey * (k + 3) % 100)::double as y, (o_custkey * (k + 1) % 200 + 100 + 20 * k)::double as x2, (o_custkey * (k + 3) % 100 + 80)::double as y2 from orders, (values (0), (1), (2)) v(k))"""

# -- lines, margins and quality ----------------------------------------------

_BODY_SQL = r"len(regexp_extract_all(line, '\p{L}')) >= 24 and not regexp_matches(line, '(?i)copyright|all rights reserved|publishing group|^ *[©®]')"


@query(f"""with {LINES}, n as (select *, {_BODY_SQL} as body, len(regexp_extract_all(line, '\\p{{L}}')) as letters from lines),
    r as (select lang, line from n where line <> '' group by lang, line having count(*) > 1), s as (select lang, count(*) as repeated_lines from r group by lang)
    select n.lang, count(distinct doc_id) as docs, count(*) as lines, count_if(body) as body_lines, sum(letters)::bigint as letters, coalesce(any_value(s.repeated_lines), 0) as repeated_lines from n left join s on s.lang = n.lang group by n.lang""")
def body_lines_by_lang(spark, d):
    # One pass over the texts; lines meet by their digest, summed up before they are shuffled.
    key = F.when(F.col("line") != "", F.unhex(F.md5("line"))).alias("key")
    marked = text_lines(spark, d).select("lang", key, T.is_body(F.col("line")).cast("long").alias("body"), T.letters(F.col("line")).cast("long").alias("letters"))
    kinds = marked.groupBy("lang", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("body").alias("body"), F.sum("letters").alias("letters"))
    sums = kinds.groupBy(F.col("lang").alias("own")).agg(F.sum("n").alias("lines"), F.sum("body").alias("body_lines"), F.sum("letters").alias("letters"), F.count_if(F.col("key").isNotNull() & (F.col("n") > 1)).alias("repeated_lines"))
    docs = table(spark, d, "documents").where("text is not null").groupBy("lang").agg(F.count_distinct("doc_id").alias("docs"))
    return docs.join(sums, F.col("lang").eqNullSafe(F.col("own"))).drop("own")


@query(f"""with {LINES}, b as (select *, case when length(line) > 180 then null when top + 0.02 <= 0.12 then 'header' when top >= 0.89 then 'footer' end as band from lines),
    k as (select *, band || ':' || regexp_replace(trim(regexp_replace(lower(line), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '[0-9]+', '#', 'g') as key from b where band is not null),
    c as (select doc_id, key, count(distinct page_index) as n from k group by all)
    select doc_id, page_index, pos, 'headersFooters' as reason, line as text from k join c using (doc_id, key) where n >= 2 or regexp_matches(line, '^ *[-–—]? *[0-9]+ *[-–—]? *$')""")
def margin_exclusions(spark, d):
    return sections.margin_exclusions(document_rows(spark, d))


@query(f"""with {LINES} select doc_id, count(*) as n_lines, sum(len(regexp_extract_all(line, '\\p{{L}}')))::bigint as letters, sum(len(regexp_extract_all(line, '\\p{{Lu}}')))::bigint as capitals, count_if(regexp_matches(line, '[.!?] *$')) as ended from lines group by doc_id""")
def letters_by_document(spark, d):
    n = text_lines(spark, d)
    return n.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(T.letters(F.col("line"))).cast("long").alias("letters"), F.sum(F.regexp_count("line", F.lit(r"\p{Lu}"))).cast("long").alias("capitals"), F.count_if(F.col("line").rlike("[.!?] *$")).alias("ended"))


_LETTERS_SQL, _BAD_SQL, _WORDS_SQL = (rf"len(regexp_extract_all(text, '{x}'))" for x in (r"\p{L}", r"\x{FFFD}|[\x00-\x08\x0E-\x1B]", r"[^ \t\n\x0B\f\r]+"))
_HEALTH_SQL = f"case when {_LETTERS_SQL} < 60 then 'sparse' when {_BAD_SQL} > 20 and 5 * {_BAD_SQL} > {_LETTERS_SQL} then 'broken' else 'healthy' end"


@query(f"select doc_id, {_HEALTH_SQL} as health from documents")
def text_health(spark, d):
    return table(spark, d, "documents").select("doc_id", T.text_health(F.col("text")).alias("health"))


_LOOSE_SQL = r"100 * len(list_filter(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'), lambda x: regexp_full_match(x, '[A-Za-z]')))"
_PAGES_SQL = f"""{LINES}, pages as (select doc_id, page_index, string_agg(line, chr(10) order by pos) as text, (doc_id % 10) / 10.0::double as image_share, (doc_id % 7) / 6.0::double as hidden_share, doc_id % 4 = 0 as bitmap_fonts, doc_id % 8 = 0 as unencoded from lines group by doc_id, page_index),
    judged as (select *, case when bitmap_fonts and length(text) > 20 and (unencoded or {_BAD_SQL} > 20 or {_LOOSE_SQL} > 35 * {_WORDS_SQL}) then 'bitmap-text' when image_share > 0.45 and {_HEALTH_SQL} <> 'healthy' then 'image-text' when image_share >= 0.45 and hidden_share > 0.8 then 'scanned' else 'healthy' end as quality from pages)"""


def text_pages(spark, d):
    lines = text_lines(spark, d).groupBy("doc_id", "page_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    share = (F.col("doc_id") % 10) / 10.0
    return lines.withColumn("image_share", share).withColumn("page_share", share).withColumn("hidden_share", (F.col("doc_id") % 7) / 6.0).withColumn("bitmap_fonts", F.col("doc_id") % 4 == 0).withColumn("unencoded", F.col("doc_id") % 8 == 0)


@query(f"with {_PAGES_SQL} select doc_id, page_index, quality from judged")
def page_quality(spark, d):
    return quality.page_quality(text_pages(spark, d)).select("doc_id", "page_index", "quality")


@query(f"""with {_PAGES_SQL} select doc_id, count_if(quality = 'scanned') as scanned, count_if(quality = 'image-text') as image_text, count_if(quality = 'bitmap-text') as bitmap_text, count_if(quality = 'healthy') as healthy, count(*) as n_pages from judged group by doc_id""")
def page_quality_rollup(spark, d):
    found = quality.quality_rollup(quality.page_quality(text_pages(spark, d)))
    return found.select("doc_id", *(F.size(c).cast("long").alias(c) for c in ("scanned", "image_text", "bitmap_text", "healthy")), "n_pages")


@query("""with v as (select doc_id, lang, coalesce(any_value(quality), -1) as label, any_value(len(regexp_extract_all(text, '[#*$%&|<>]'))) > 0.1 * any_value(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))) as symbols from documents left join labels using (doc_id) group by doc_id, lang)
    select lang, label, symbols, count(*) as n from v group by all""")
def predicate_against_labels(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    symbols = F.regexp_count("text", F.lit("[#*$%&|<>]")) > 0.1 * F.size(T.words(F.col("text")))
    return docs.groupBy("lang", F.coalesce("quality", F.lit(-1)).alias("label"), symbols.alias("symbols")).agg(F.count(F.lit(1)).alias("n"))


@query("""with c as (select user_id, event_type, count(*) as n, min(event_id) as f from events group by all)
    select user_id, arg_max(event_type, n * 1000000000 - f) as event_type from c group by user_id""")
def dominant_event(spark, d):
    return rows.dominant(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query("select event_type, median(value) as median_value, count(distinct user_id) as users from events group by event_type")
def medians(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.median("value").alias("median_value"), F.count_distinct("user_id").alias("users"))


@query("select doc_id, len(regexp_extract_all(text, '<[^>]*>')) as tags from (select conv_id * 1000 + turn as doc_id, text from conversations where turn >= 0)")
def tags_in_turns(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.regexp_count("text", F.lit("<[^>]*>")).cast("long").alias("tags"))


@query("""select conv_id, turn, case when role = 'user' and len(regexp_extract_all(text, '[A-Za-z]')) >= 12 then 'refused' end as problem from conversations""")
def reply_checks(spark, d):
    turns = table(spark, d, "conversations")
    reply = F.when(F.col("role") == "user", F.col("text")).otherwise(F.concat("text", F.lit(" x")))
    return bridge.checked(turns, reply).select("conv_id", "turn", "problem")


@query("""select conv_id, turn, array_to_string(list_reverse(string_split(text, ' ')), ' ') as reply from conversations""")
def translated_turns(spark, d):
    turns = table(spark, d, "conversations")
    return turns.select("conv_id", "turn", bridge.translation(bridge.reversed_words)("text").alias("reply"))


@query()
def compatibility_forms(spark, d):
    return table(spark, d, "documents").select("doc_id", bridge.nfkc("text").alias("text"))


@query("""select event_id, case when event_type = 'error' then 'timeout' when value > 75 then 'resource' when value > 50 then 'page' when value > 25 then 'environment' else 'engine' end as code from events""")
def failure_codes(spark, d):
    names = lambda *x: F.array(*map(F.lit, x))
    chain = F.when(F.col("event_type") == "error", names("ValueError", "TimeoutError")).when(F.col("value") > 75, names("KeyError", "PermissionError", "ENOSPC")).when(F.col("value") > 50, names("RuntimeError", "KeyError")).when(F.col("value") > 25, names("IndexError", "FileNotFoundError")).otherwise(names("RuntimeError"))
    return table(spark, d, "events").select("event_id", T.failure_code(chain).alias("code"))


# -- sequences ---------------------------------------------------------------


@query(f"""with {GLYPHS}, g as (select *, x - lag(x2) over (partition by doc_id, para_id order by x, glyph_id) as gap from glyphs)
    select doc_id, para_id as line, glyph_id, sum(case when gap > greatest(24, 3 * font_size) then 1 else 0 end) over (partition by doc_id, para_id order by x, glyph_id)::bigint as segment from g""")
def column_segments(spark, d):
    g = glyphs(spark, d).withColumn("line", F.col("para_id")).withColumn("pos", F.col("glyph_id"))
    return rows.segments(g).select("doc_id", "line", "glyph_id", F.col("segment").cast("long").alias("segment"))


@query("""with r as (select l_orderkey as doc_id, l_linenumber as pos, l_linenumber / 8.0::double as top, (l_partkey % 60) / 100.0::double as "left", case when l_suppkey % 5 = 0 then 0.7::double else 0.3::double end as width from lineitem),
    s as (select *, width >= 0.6 as span, "left" >= 0.45 as "right", "left" < 0.45 and "left" + width < 0.58 as compact from r),
    t as (select *, count_if(compact) over (partition by doc_id) >= 3 and count_if("right") over (partition by doc_id) >= 3 as two from s),
    b as (select *, case when two then count_if(span) over (partition by doc_id order by top) else 0 end as band from t)
    select doc_id, pos, row_number() over (partition by doc_id order by band, two and not span, two and not span and "right", top, "left", pos) as reading_pos from b""")
def reading_order(spark, d):
    t = table(spark, d, "lineitem")
    r = t.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.col("l_linenumber").alias("pos"), (F.col("l_linenumber") / 8.0).alias("top"), ((F.col("l_partkey") % 60) / 100.0).alias("left"), F.when(F.col("l_suppkey") % 5 == 0, 0.7).otherwise(0.3).alias("width"))
    return rows.reading_order(r).select("doc_id", "pos", F.col("reading_pos").cast("long").alias("reading_pos"))


@query("""with p as (select distinct user_id as doc_id, event_id // 1000 as page_index from events), n as (select *, case when page_index <> lag(page_index) over (partition by doc_id order by page_index) + 1 then 1 else 0 end as new from p)
    select doc_id, page_index, sum(new) over (partition by doc_id order by page_index)::bigint as run from n""")
def page_runs(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.floor(F.col("event_id") / 1000).alias("page_index")).distinct()
    return sections.page_runs(e).select("doc_id", "page_index", F.col("run").cast("long").alias("run"))


@query("""with p as (select distinct user_id as doc_id, event_id // 1000 as page_index from events), n as (select *, case when page_index <> lag(page_index) over (partition by doc_id order by page_index) + 1 then 1 else 0 end as new from p),
    r as (select *, sum(new) over (partition by doc_id order by page_index) as run from n), e as (select user_id as doc_id, event_id // 1000 as page_index, event_id as pos, case when event_type = 'error' then false when event_type = 'signup' then true end as m from events)
    select doc_id, pos, coalesce(last_value(m ignore nulls) over (partition by doc_id, run order by page_index, pos rows unbounded preceding), false) as state from e join r using (doc_id, page_index)""")
def toggled_state(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.floor(F.col("event_id") / 1000).alias("page_index"), F.col("event_id").alias("pos"), "event_type")
    return sections.toggled(e, F.col("event_type") == "signup", F.col("event_type") == "error").select("doc_id", "pos", "state")


@query(f"""with {LINES} select distinct doc_id, page_index, false as in_references from lines""")
def state_before_pages(spark, d):
    return sections.state_before_pages(document_rows(spark, d))


def structured_rows(spark: SparkSession, d: str) -> DataFrame:
    """A row a line of the documents, in the shape of references, contents, lists, plain text or references without a heading, by document."""
    n, pos, kind = F.char_length("line").cast("string"), F.col("pos"), F.col("doc_id") % 5
    number = lambda c: c.cast("int").cast("string")
    text = (
        F.when((kind == 0) & (F.col("page_index") == 0) & (pos == 0), "References")
        .when((kind == 0) & (pos % 2 == 1), F.concat(F.lit("["), number((pos + 1) / 2), F.lit("] Author "), n, F.lit(" words")))
        .when(kind == 0, F.concat(F.lit("and "), n, F.lit(" more words")))
        .when((kind == 1) & (pos == 0), "Contents")
        .when(kind == 1, F.concat(number(pos), F.lit(" Chapter "), n, F.lit(" ..... "), number(pos * 3)))
        .when(kind == 2, F.concat(number(pos + 1), F.lit(". item "), n, F.lit(" words")))
        .when(kind == 3, F.concat(F.lit("plain "), n, F.lit(" words")))
        .otherwise(F.concat(F.lit("["), number(pos + 1), F.lit("] Author 1999 "), n, F.lit(" words")))
    )
    place = [F.lit(0.1).alias("left"), (0.15 + pos * 0.0175).alias("top"), F.lit(0.8).alias("width"), F.lit(0.015).alias("height"), F.lit(0.88).alias("tail_left")]
    return text_lines(spark, d).select("doc_id", "page_index", "pos", text.alias("text"), F.lit("text").alias("kind"), *place, F.lit(10.0).alias("font_size"), F.lit(False).alias("font_bold"))


_STRUCTURED = f"""{LINES}, b as (select doc_id, page_index, pos, doc_id % 5 as k, length(line) as n, count(*) over (partition by doc_id, page_index) as on_page, count_if(page_index = 0) over (partition by doc_id) as on_first from lines),
    t as (select *, case when k = 0 and page_index = 0 and pos = 0 then 'References' when k = 0 and pos % 2 = 1 then '[' || ((pos + 1) // 2) || '] Author ' || n || ' words' when k = 0 then 'and ' || n || ' more words' when k = 1 and pos = 0 then 'Contents'
        when k = 1 then pos || ' Chapter ' || n || ' ..... ' || (pos * 3) when k = 2 then (pos + 1) || '. item ' || n || ' words' when k = 3 then 'plain ' || n || ' words' else '[' || (pos + 1) || '] Author 1999 ' || n || ' words' end as text from b)"""


@query(f"""with {_STRUCTURED}, g as (select *, sum(pos % 2) over (partition by doc_id, page_index order by pos) as grp from t where k = 0 and not (page_index = 0 and pos = 0)),
    e as (select doc_id, page_index, 'toc' as kind, pos::varchar as label, pos || ' Chapter ' || n as text, pos as first_pos, 1 as n_lines, false as continuation, 0 as rank from t where k = 1 and pos > 0 and on_page >= 3
        union all select doc_id, page_index, 'reference', case when grp > 0 then '[' || grp || ']' else '' end, string_agg(text, ' ' order by pos), min(pos), count(*), grp = 0, 1 from g group by doc_id, page_index, grp
        union all select doc_id, page_index, 'reference', '[' || (pos + 1) || ']', text, pos, 1, false, 1 from t where k = 4 and on_first >= 3
        union all select doc_id, page_index, 'list', (pos + 1) || '.', text, pos, 1, false, 2 from t where k = 2 and on_page >= 2)
    select doc_id, page_index, kind, label, text, first_pos, n_lines, continuation, kind || '-' || page_index || '-' || (row_number() over (partition by doc_id order by page_index, rank, first_pos) - 1) as id from e""")
def structure_entries(spark, d):
    return sections.structure(structured_rows(spark, d))[0].select("doc_id", "page_index", "kind", "label", "text", "first_pos", "n_lines", "continuation", "id")


@query(f"""with {_STRUCTURED} select doc_id, page_index, pos, 'references' as reason, text from t where k = 0 or (k = 4 and on_first >= 3)""")
def structure_exclusions(spark, d):
    return sections.structure(structured_rows(spark, d), references=False)[1]


@query(f"""with recursive {GLYPHS}, g as (select *, 'F' || (n % 2) as font_id, row_number() over (partition by doc_id, para_id order by y desc, x, glyph_id) as k from glyphs where kind <> 'formula'),
    l as (select doc_id, para_id, glyph_id, k, y as anchor, 0 as line from g where k = 1 union all
        select g.doc_id, g.para_id, g.glyph_id, g.k, case when abs(l.anchor - g.y) > 0.35 * greatest(1, g.font_size) then g.y else l.anchor end, l.line + case when abs(l.anchor - g.y) > 0.35 * greatest(1, g.font_size) then 1 else 0 end from l join g on g.doc_id = l.doc_id and g.para_id = l.para_id and g.k = l.k + 1),
    j as (select g.*, l.line, g.x - lag(g.x2) over w as gap, row_number() over w as r from g join l using (doc_id, para_id, k) window w as (partition by g.doc_id, g.para_id, l.line order by g.x, g.glyph_id)),
    s as (select *, sum(case when gap > greatest(24, 3 * font_size) then 1 else 0 end) over (partition by doc_id, para_id, line order by x, glyph_id) as segment, coalesce(gap > greatest(0.6, 0.16 * font_size) and gap <= greatest(24, 3 * font_size), false) as space from j),
    c as (select doc_id, para_id, line, segment, font_id, count(*) as c, min(r) as f from s group by all), f as (select doc_id, para_id, line, segment, font_id from c qualify row_number() over (partition by doc_id, para_id, line, segment order by c desc, f) = 1)
    select doc_id, para_id, line, segment::bigint as segment, string_agg(case when space then ' ' else '' end || ch, '' order by x, s.glyph_id) as text, any_value(f.font_id) as font_id, median(font_size) as font_size,
        min(x) / 320 as "left", (220 - max(y2)) / 220 as top, (max(x2) - min(x)) / 320 as width, (max(y2) - min(y)) / 220 as height, max(x) / 320 as tail_left from s join f using (doc_id, para_id, line, segment) group by doc_id, para_id, line, segment""")
def rows_from_glyphs(spark, d):
    pages = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.lit(320.0).alias("width"), F.lit(220.0).alias("height"))
    g = glyphs(spark, d).withColumn("pos", F.col("glyph_id")).withColumn("font_id", F.concat(F.lit("F"), (F.col("n") % 2).cast("string")))
    return rows.rows_from_glyphs(g, pages).select("doc_id", "para_id", "line", F.col("segment").cast("long").alias("segment"), "text", "font_id", "font_size", "left", "top", "width", "height", "tail_left")


@query(f"""with {LINES}, r as (select *, pos % 7 = 0 as bold, (10 + pos % 3 * 2)::double as size from lines), m as (select *, median(size) over (partition by doc_id, page_index) as body from r)
    select doc_id, page_index, pos from m where bold and size > 1.08 * body and len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+')) <= 12""")
def heading_rows(spark, d):
    r = document_rows(spark, d).withColumn("font_bold", F.col("pos") % 7 == 0).withColumn("font_size", (10 + F.col("pos") % 3 * 2).cast("double"))
    return sections.with_headings(r).where("heading").select("doc_id", "page_index", "pos")


@query(f"""with recursive {GLYPHS}, g as (select *, (y + y2) / 2 as m, y2 - y as h, row_number() over (partition by doc_id order by y2 desc, x, glyph_id) as k from glyphs),
    r as (select doc_id, k, glyph_id, 0 as row, 1 as n, [{{'i': 0, 'm': m, 'h': h}}] as seen from g where k = 1 union all
        select g.doc_id, g.k, g.glyph_id, coalesce(list_last(list_filter(r.seen, lambda s: abs(s.m - g.m) <= 0.35 * least(s.h, g.h))).i, r.n), r.n + case when len(list_filter(r.seen, lambda s: abs(s.m - g.m) <= 0.35 * least(s.h, g.h))) > 0 then 0 else 1 end,
            case when len(list_filter(r.seen, lambda s: abs(s.m - g.m) <= 0.35 * least(s.h, g.h))) > 0 then r.seen else list_slice(list_append(r.seen, {{'i': r.n, 'm': g.m, 'h': g.h}}), -3, -1) end from r join g on g.doc_id = r.doc_id and g.k = r.k + 1),
    f as (select g.*, r.row, case when g.x - max(g.x2) over (partition by g.doc_id, r.row order by g.x, g.y2 desc, g.glyph_id rows between unbounded preceding and 1 preceding) > greatest(3, 0.9 * font_size) then 1 else 0 end as far from g join r using (doc_id, k)),
    p as (select *, sum(far) over (partition by doc_id, row order by x, y2 desc) as part from f), t as (select doc_id, row, part, string_agg(ch, '' order by x, y2 desc, ch) as text from p group by all)
    select doc_id, 0 as page_index, row_number() over (partition by doc_id order by row, part) - 1 as "group", text from t""")
def label_groups(spark, d):
    return spatial.label_groups(glyphs(spark, d)).withColumn("group", F.col("group").cast("long"))


@query()
def merged_ocr_lines(spark, d):
    return spatial.merged_ocr_lines(glyphs(spark, d).select("doc_id", "page_index", F.col("para_id").alias("region_id"), F.col("glyph_id").alias("pos"), F.col("ch").alias("text"), "x", "y", "x2", "y2", "font_size"))


@query(f"""with recursive {GLYPHS}, g as (select doc_id, glyph_id as entry_id, kind, x, row_number() over (partition by doc_id order by x, y desc, glyph_id) as k from glyphs),
    r as (select doc_id, k, entry_id, 0 as col, [{{'k': kind, 'x': x}}] as heads from g where k = 1 union all
        select g.doc_id, g.k, g.entry_id, coalesce(nullif(list_position(list_transform(r.heads, lambda h: h.k = g.kind and abs(h.x - g.x) < 24), true), 0), len(r.heads) + 1) - 1,
            case when coalesce(list_position(list_transform(r.heads, lambda h: h.k = g.kind and abs(h.x - g.x) < 24), true), 0) > 0 then r.heads else list_append(r.heads, {{'k': g.kind, 'x': g.x}}) end from r join g on g.doc_id = r.doc_id and g.k = r.k + 1)
    select doc_id, entry_id, col::int as "column" from r""")
def entry_columns(spark, d):
    return spatial.columns_of(glyphs(spark, d).select("doc_id", "page_index", F.col("glyph_id").alias("entry_id"), "kind", "x", "y")).select("doc_id", "entry_id", "column")


@query(f"""with {GLYPHS} select doc_id, glyph_id as entry_id, lead(y2) over (partition by doc_id, para_id order by y2 desc, glyph_id) + 1.5 as floor from glyphs""")
def reserved_room(spark, d):
    g = glyphs(spark, d).withColumn("column", F.col("para_id")).withColumn("entry_id", F.col("glyph_id"))
    return spatial.reserved(g).select("doc_id", "entry_id", "floor")


@query("""select l_orderkey as doc_id, l_linenumber as entry, l_partkey as part, case when l_quantity > 25 then 10000000000000000 else 0 end + row_number() over (partition by l_orderkey, l_quantity > 25 order by l_linenumber, l_partkey, l_suppkey) as sub_order from lineitem""")
def draw_order(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.col("l_linenumber").alias("entry"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("pos"), F.when(F.col("l_quantity") <= 25, F.lit(1).cast("long")).alias("render_order"))
    return spatial.draw_order(t).select("doc_id", "entry", "part", F.col("sub_order").cast("long").alias("sub_order"))


@query("""select l_orderkey as doc_id, l_linenumber % 2 as entry_id, min(case when l_quantity <= 25 then l_linenumber end) as render_order from lineitem group by all""")
def entry_orders(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), (F.col("l_linenumber") % 2).alias("entry_id"), F.when(F.col("l_quantity") <= 25, F.col("l_linenumber")).alias("render_order"))
    return spatial.entry_orders(t).drop("page_index")


@query("""select l_orderkey as doc_id, l_linenumber as parent_id, case o_orderstatus when 'F' then 'list' when 'O' then 'toc' else 'reference' end as kind from lineitem left join orders on o_orderkey = l_orderkey""")
def entry_kinds(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.col("l_orderkey").alias("entry_id"), F.col("l_linenumber").alias("parent_id"))
    kinds = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.col("o_orderkey").alias("entry_id"), F.when(F.col("o_orderstatus") == "F", "list").when(F.col("o_orderstatus") == "O", "toc").alias("kind"))
    return spatial.entry_kinds(links, kinds).select("doc_id", "parent_id", "kind")


@query("""with s as (select l_orderkey as doc_id, lag(l_quantity) over (partition by l_orderkey order by l_quantity desc) - l_quantity as step from lineitem) select doc_id, 0 as page_index, median(step) / 1.2 as pitch from s where step > 4 and step < 50 group by doc_id""")
def line_pitch(spark, d):
    return quality.line_pitch(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.col("l_quantity").alias("y")))


@query("""select l_orderkey as doc_id, coalesce(median(case when l_returnflag = 'R' then l_quantity end) * 1.15, 'Infinity'::double) as threshold from lineitem group by l_orderkey""")
def reference_threshold(spark, d):
    return quality.reference_threshold(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_returnflag") == "R").alias("confirmed"), F.col("l_quantity").alias("font_size")))


@query(f"""with {LINES}, v as (select doc_id, page_index, (doc_id * 30 + line_no * 90) % 360 as a, len(regexp_extract_all(line, '\\p{{L}}')) as n from lines where top >= 0.06 and top + 0.02 <= 0.94),
    q as (select doc_id, page_index, a as q, sum(n) as n from v where n >= 3 and a % 90 = 0 group by all), b as (select doc_id, page_index, sum(n) as total, max(n) as most, arg_max(q, n) as q from q group by all)
    select p.doc_id, p.page_index, coalesce(case when total >= 80 and most >= 0.7 * total then q else 0 end, 0)::int as direction from (select distinct doc_id, page_index from lines) p left join b using (doc_id, page_index)""")
def text_direction(spark, d):
    n = text_lines(spark, d).withColumn("angle", (F.col("doc_id") * 30 + F.col("line_no") * 90) % 360)
    n = n.select("doc_id", "page_index", F.col("line").alias("text"), F.col("angle").cast("double").alias("angle"), F.lit(False).alias("vertical"), F.lit(0.1).alias("left"), "top", F.lit(0.8).alias("width"), F.lit(0.02).alias("height"))
    return quality.text_direction(n)


@query(f"""with {LINES} select doc_id, case when count_if({_BODY_SQL}) > 0 then null else 'document_no_body_text' end as error from lines group by doc_id""")
def body_gate(spark, d):
    return quality.body_gate(text_lines(spark, d).select("doc_id", T.is_body(F.col("line")).alias("is_body")))


# -- joins by place ----------------------------------------------------------

_IN = "g.x between r.x - {t} and r.x2 + {t} and g.y between r.y - {t} and r.y2 + {t}"


@query(f"""with {GLYPHS}, {REGIONS}, f as (select g.doc_id, glyph_id, region_id, class_name, conf, (r.x2 - r.x) * (r.y2 - r.y) as a from glyphs g join regions r using (doc_id, page_index)
    where greatest(least(g.x2, r.x2) - greatest(g.x, r.x), 0) * greatest(least(g.y2, r.y2) - greatest(g.y, r.y), 0) >= 0.8 * 60)
    select doc_id, glyph_id, arg_min(region_id, a * 10 + region_id) filter (class_name <> 'figure_caption' and conf >= 0.5) as region_id from f group by all having arg_min(class_name, a * 10 + region_id) <> 'figure_caption' and count_if(class_name <> 'figure_caption' and conf >= 0.5) > 0""")
def graphic_glyphs(spark, d):
    return spatial.graphic_glyphs(glyphs(spark, d), regions(spark, d)).select("doc_id", "glyph_id", "region_id")


@query(f"""with {GLYPHS}, {REGIONS}, h as (select g.doc_id, para_id, glyph_id, count(r.region_id) as n from glyphs g left join regions r on r.doc_id = g.doc_id and {_IN.format(t=2)} group by all)
    select doc_id, para_id, bool_and(n = 1) as covered from h group by all""")
def covered_paragraphs(spark, d):
    return spatial.covered_parents(glyphs(spark, d), regions(spark, d)).select("doc_id", "para_id", "covered")


@query(f"""with {GLYPHS}, {REGIONS}, h as (select g.doc_id, para_id, comp_id, glyph_id, count(r.region_id) > 0 as hit from glyphs g left join regions r on r.doc_id = g.doc_id and {_IN.format(t=0.6)} group by all)
    select doc_id, para_id, comp_id, case when bool_and(hit) then 'all' when not bool_or(hit) or (para_id = 1 and comp_id = 1) then 'none' else 'mixed' end as part from h group by doc_id, para_id, comp_id""")
def parts_by_exclusion(spark, d):
    kind = F.when((F.col("para_id") == 1) & (F.col("comp_id") == 1), "formula").otherwise("text")
    return spatial.parts_by_exclusion(glyphs(spark, d).withColumn("kind", kind), regions(spark, d)).select("doc_id", "para_id", "comp_id", "part")


@query(f"""with {GLYPHS}, {REGIONS}, f as (select g.doc_id, glyph_id, region_id as word_id, g.x as gx, g.x2 as gx2, r.x as wx, r.x2 as wx2, r.y as wy, r.y2 as wy2, abs((g.y + g.y2) / 2 - (r.y + r.y2) / 2) as d from glyphs g join regions r on r.doc_id = g.doc_id and (g.x + g.x2) / 2 between r.x - 2 and r.x2 + 2
      where floor((g.y + g.y2) / 2 / 8) between floor(r.y / 8) - 1 and floor(r.y2 / 8) + 1),
    b as (select *, greatest(wx, least(gx, wx2 - 0.1::double)) as x from f qualify row_number() over (partition by doc_id, glyph_id order by d, word_id) = 1)
    select doc_id, glyph_id, word_id, x, wy as y, greatest(x + 0.1::double, least(gx2, wx2)) as x2, wy2 as y2 from b where d <= greatest(8, wy2 - wy)""")
def nearest_words(spark, d):
    return spatial.nearest_words(glyphs(spark, d), regions(spark, d).withColumnRenamed("region_id", "word_id")).drop("page_index")


@query(f"""with {GLYPHS}, {REGIONS}, h as (select g.doc_id, row_id, glyph_id, count(r.region_id) > 0 as hit from glyphs g left join regions r on r.doc_id = g.doc_id and (g.x + g.x2) / 2 between r.x and r.x2 and (g.y + g.y2) / 2 between r.y and r.y2 group by all)
    select doc_id, row_id, count_if(hit) >= 0.7 * count(*) as covered from h group by all""")
def covered_rows(spark, d):
    return spatial.covered_rows(glyphs(spark, d), regions(spark, d)).select("doc_id", "row_id", "covered")


@query(f"""with {GLYPHS}, {REGIONS} select g.doc_id, g.glyph_id from glyphs g where not (para_id = 1 and exists (select 1 from regions r where r.doc_id = g.doc_id and (g.x + g.x2) / 2 between r.x and r.x2 and (g.y + g.y2) / 2 between r.y and r.y2))""")
def freed_exclusions(spark, d):
    ex = glyphs(spark, d).withColumn("reason", F.when(F.col("para_id") == 1, "references").otherwise("headersFooters")).withColumn("exclusion_id", F.col("glyph_id"))
    return spatial.freed_exclusions(ex, regions(spark, d)).select("doc_id", "glyph_id")


@query(f"""with {GLYPHS} select p.doc_id, p.glyph_id from glyphs p where exists (select 1 from glyphs b where b.doc_id = p.doc_id and b.n = 1 and (p.n // 4 > 0 or (p.n // 4 = 0 and p.y2 <= b.y2 + 2 and greatest(least(p.x2, b.x2) - greatest(p.x, b.x), 0) / 6 > 0.3)))""")
def after_biography(spark, d):
    g = glyphs(spark, d).withColumn("page_index", F.floor(F.col("n") / 4))
    return spatial.after_biography(g, g.where("n = 1")).select("doc_id", "glyph_id")


@query(r"""with p as (select conv_id as doc_id, turn // 3 as page_index, turn as para_id, case turn % 4 when 0 then '[1] Author 1999 ' || text when 1 then 'She was born in 1970. ' || text else text end as text, (8 + turn % 3 * 2)::double as font_size, (turn % 5 * 10)::double as x, (90 - turn % 7 * 10)::double as y from conversations),
    m as (select *, regexp_matches(text, '^ *(?:\[([0-9]{1,4})\]|([0-9]{1,4})[.)]) +[^ ]') as marker, len(regexp_extract_all(text, '\p{L}')) >= 24 and not regexp_matches(text, '(?i)copyright|all rights reserved|publishing group|^ *[©®]') as prose,
        regexp_matches(substr(regexp_replace(lower(text), '\s+', '', 'g'), 1, 300), 'wasborn|graduatedfrom|received(his|her|a|an|the)?(b\.?eng|b\.?sc|m\.?sc|ph\.?d|dipl|degree|d[’'']?ing)') as told from p),
    t as (select doc_id, median(font_size) * 1.15 as threshold from m where marker and regexp_matches(text, '(^|[^0-9A-Za-z_])(18|19|20)[0-9]{2}([^0-9A-Za-z_]|$)') group by doc_id),
    g as (select doc_id, page_index, count_if(prose and not marker and told) >= 2 as two, bool_or(marker) as marked from m group by all)
    select m.doc_id, m.page_index, m.para_id from m join g using (doc_id, page_index) left join t using (doc_id) where prose and not marker and (length(text) > 100 and font_size > coalesce(threshold, 'inf'::double) or two and not marked
        or exists (select 1 from m b where b.doc_id = m.doc_id and b.prose and not b.marker and b.told and (m.page_index > b.page_index or (m.page_index = b.page_index and m.y <= b.y + 2 and greatest(least(m.x + 50, b.x + 50) - greatest(m.x, b.x), 0) / 50 > 0.3))))""")
def protected_prose(spark, d):
    turn = F.col("turn")
    text = F.when(turn % 4 == 0, F.concat(F.lit("[1] Author 1999 "), "text")).when(turn % 4 == 1, F.concat(F.lit("She was born in 1970. "), "text")).otherwise(F.col("text"))
    x, y = (turn % 5 * 10).cast("double"), (90 - turn % 7 * 10).cast("double")
    p = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.floor(turn / 3).alias("page_index"), turn.alias("para_id"), text.alias("text"), F.lit("text").alias("label"), (8 + turn % 3 * 2).cast("double").alias("font_size"), x.alias("x"), y.alias("y"), (x + 50).alias("x2"), (y + 20).alias("y2"))
    return spatial.protected_prose(p).select("doc_id", "page_index", "para_id")


@query(f"""with {GLYPHS}, n as (select a.doc_id, a.glyph_id, max(b.y2) as ny from glyphs a join glyphs b on a.doc_id = b.doc_id and a.glyph_id <> b.glyph_id and abs(a.x - b.x) < 24 and b.y2 < a.y2 where a.kind = 'text' group by all)
    select g.doc_id, g.glyph_id as entry_id, case when g.y - ny > 0 and g.y - ny <= 16 then least(g.y, ny + 1.5) else g.y end as y from glyphs g left join n using (doc_id, glyph_id)""")
def extended_boxes(spark, d):
    e = glyphs(spark, d).withColumn("kind", F.when(F.col("kind") == "text", "reference").otherwise("list")).withColumn("entry_id", F.col("glyph_id"))
    return spatial.extended_boxes(e).select("doc_id", "entry_id", "y")


@query(f"""with {GLYPHS}, {REGIONS} select distinct r.doc_id, r.region_id as entry_id from regions r join glyphs g on g.doc_id = r.doc_id and {_IN.format(t=2)} where g.para_id <> 1""")
def entries_with_strangers(spark, d):
    g = glyphs(spark, d)
    parents = g.select("doc_id", "page_index", "para_id").distinct().withColumn("covered", F.col("para_id") == 1)
    return spatial.entries_with_strangers(regions(spark, d).withColumnRenamed("region_id", "entry_id"), g, parents).select("doc_id", "entry_id")


@query("""with recursive links as (select l_orderkey as e, l_partkey as p from lineitem where l_quantity > 47), r as (select o_orderkey as e from orders where o_totalprice > 300000 union select b.e from r join links a on a.e = r.e join links b on b.p = a.p) select e as entry_id from r""")
def rollback_closure(spark, d):
    shared_folder(spark)
    links = table(spark, d, "lineitem").where("l_quantity > 47").select(F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("parent_id"))
    bad = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("entry_id"))
    return spatial.closure(links, bad)


@query("""with recursive links as (select l_orderkey as e, l_partkey as p from lineitem where l_quantity > 47), r as (select distinct e from links where e not in (select o_orderkey from orders where o_totalprice <= 300000) union select b.e from r join links a on a.e = r.e join links b on b.p = a.p)
    select o_orderkey as entry_id from orders where o_totalprice <= 300000 and o_orderkey not in (select e from r)""")
def ready_entries(spark, d):
    shared_folder(spark)
    links = table(spark, d, "lineitem").where("l_quantity > 47").select(F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("parent_id"))
    return spatial.ready_entries(links, table(spark, d, "orders").where("o_totalprice <= 300000").select(F.col("o_orderkey").alias("entry_id")))


@query("""select l_orderkey as doc_id, l_linenumber as glyph_id, 1 - ((l_suppkey % 200) / 250.0 + 0.04) as "left", (l_partkey % 300) / 400.0 as top from lineitem""")
def rotated_rects(spark, d):
    t = table(spark, d, "lineitem")
    rect = F.struct(((F.col("l_partkey") % 300) / 400.0).alias("left"), ((F.col("l_suppkey") % 200) / 250.0).alias("top"), F.lit(0.1).alias("width"), F.lit(0.04).alias("height"))
    return t.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("glyph_id"), G.rotated(rect, F.lit(90)).alias("r")).select("doc_id", "glyph_id", (1 - ((1 - F.col("r.left")))).alias("left"), F.col("r.top").alias("top"))


@query(f"""with {GLYPHS}, r as (select doc_id, glyph_id, n % 2 = 0 as seen, least(greatest(case when n % 2 = 0 then x + 1 else x end / 310, 0), 1) as l, least(greatest(x2 / 310, 0), 1) as r, least(greatest(1 - y2 / 200, 0), 1) as t, least(greatest(1 - y / 200, 0), 1) as b from glyphs)
    select doc_id, glyph_id, round(l, 9) as "left", round(t, 9) as top, round(r - l, 9) as width, round(b - t, 9) as height, round(10 + l * 310, 6) as x, round(220 - t * 200, 6) as y2 from r""")
def page_rects(spark, d):
    """Glyphs' own boxes, or those they are seen in, as shares of their page and back in points of its crop box."""
    own = F.when(F.col("n") % 2 == 0, G.box(F.col("x") + 1, F.col("y"), F.col("x2"), F.col("y2")))
    g = glyphs(spark, d).select("doc_id", "glyph_id", F.struct(own.alias("visual_box"), G.box(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")).alias("box")).alias("g"))
    g = g.withColumn("r", G.rect(G.glyph_box(F.col("g")), F.lit(310.0), F.lit(200.0)))
    g = g.withColumn("b", G.page_box(F.col("r"), G.box(F.lit(10.0), F.lit(20.0), F.lit(320.0), F.lit(220.0))))
    return g.select("doc_id", "glyph_id", *(F.round(f"r.{c}", 9).alias(c) for c in ("left", "top", "width", "height")), F.round("b.x", 6).alias("x"), F.round("b.y2", 6).alias("y2"))


@query(f"""with {GLYPHS} select doc_id, para_id, min(x) as x, min(y) as y, max(x2) as x2, max(y2) as y2 from glyphs group by all""")
def paragraph_boxes(spark, d):
    boxes = glyphs(spark, d).groupBy("doc_id", "para_id").agg(G.union_box(*map(F.col, ("x", "y", "x2", "y2"))).alias("b"))
    return boxes.select("doc_id", "para_id", "b.*")


# -- pages, parts and resources ----------------------------------------------


@query("""select d.doc_id, 0 as page_index, coalesce(l.quality, d.n_chars)::bigint as n, l.doc_id is not null as replaced from documents d left join labels l using (doc_id)""")
def replaced_pages(spark, d):
    src = table(spark, d, "documents").select("doc_id", F.lit(0).alias("page_index"), F.col("n_chars").alias("n"))
    new = table(spark, d, "labels").select("doc_id", F.lit(0).alias("page_index"), F.col("quality").cast("long").alias("n"))
    return export.assembled_pages(src, new, ["n"])


@query("""select l_orderkey as doc_id, l_linenumber as page_index from lineitem l where not exists (select 1 from lineitem m where m.l_orderkey = l.l_orderkey and m.l_linenumber = l.l_linenumber and m.l_quantity = l.l_quantity and m.l_returnflag <> 'R')""")
def missing_links(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_index"), F.lit("goto").alias("kind"), F.struct("l_quantity").alias("rect"), "l_returnflag")
    return export.missing_links(s.drop("l_returnflag"), s.where("l_returnflag <> 'R'").drop("l_returnflag")).select("doc_id", "page_index")


@query("""select o_orderkey as doc_id, 1 as xobj_id, f as font_id, case when f = 'F1' then coalesce('form' || (o_custkey % 3), 'page') else 'page' end as name from orders, (values ('F1'), ('F2')) v(f)""")
def scoped_fonts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), "o_custkey")
    pages = o.select("doc_id", "page_index", F.explode(F.array(F.lit("F1"), F.lit("F2"))).alias("font_id"), F.lit("page").alias("name"))
    forms = o.select("doc_id", "page_index", F.lit(1).alias("xobj_id"), F.lit("F1").alias("font_id"), F.concat(F.lit("form"), (F.col("o_custkey") % 3).cast("string")).alias("name"))
    return export.scoped_fonts(pages, forms).select("doc_id", "xobj_id", "font_id", "name")


@query("""with p as (select conv_id as doc_id, turn, text from conversations), e as (select doc_id, min(turn) as pos from p where turn in (0, 1) group by doc_id)
    select doc_id, turn as pos, case when turn % 2 = 0 then 'S' || turn else text end as source, text as translation, 'body' as kind from p where turn not in (0, 1) union all select doc_id, pos, 'both', 'joined', 'reference' from e""")
def export_blocks(spark, d):
    p = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("page_index"), F.col("turn").cast("string").alias("debug_id"), F.col("turn").alias("pos"), "text")
    sources = p.where("pos % 2 = 0").select("doc_id", "page_index", "debug_id", F.concat(F.lit("S"), "debug_id").alias("source"))
    entries = p.select("doc_id", "page_index").distinct().select("doc_id", "page_index", F.lit("e").alias("entry_id"), F.array(F.lit("0"), F.lit("1")).alias("parents"), F.lit("both").alias("source"), F.lit("joined").alias("text"), F.lit("reference").alias("kind"))
    return export.export_blocks(p, sources, entries).drop("page_index")


@query("""with p as (select conv_id as doc_id, turn, text from conversations), e as (select doc_id, min(turn) as pos from p where turn in (0, 1) group by doc_id),
    b as (select doc_id, turn as pos, case when turn % 2 = 0 then 'S' || turn else text end as source, text as translation, 'body' as kind from p where turn not in (0, 1) union all select doc_id, pos, 'both', 'joined', 'reference' from e)
    select doc_id, (row_number() over (partition by doc_id order by pos, source, translation, kind) - 1)::int as n, source, translation, kind from b""")
def export_pages(spark, d):
    pages = export.export_pages(export_blocks(spark, d).withColumn("page_index", F.lit(0)))
    return pages.select("doc_id", F.posexplode("blocks").alias("n", "b")).select("doc_id", "n", "b.source", "b.translation", "b.kind")


@query("""select conv_id as doc_id, (row_number() over (partition by conv_id order by turn, coalesce(case when turn % 2 = 0 then 'S' || turn end, text)) - 1)::int as n, coalesce(case when turn % 2 = 0 then 'S' || turn end, text) as source, text as translation from conversations""")
def exported_snapshot(spark, d):
    t, key = table(spark, d, "conversations"), F.col("turn").cast("string").alias("debug_id")
    pages = t.groupBy(F.col("conv_id").alias("doc_id"), F.lit(0).alias("page_index")).agg(
        F.collect_list(F.struct(key, F.col("turn").alias("pos"), "text")).alias("paragraphs"),
        F.collect_list(F.when(F.col("turn") % 2 == 0, F.struct(key, F.concat(F.lit("S"), F.col("turn").cast("string")).alias("source")))).alias("sources"),
    )
    pages = pages.withColumn("entries", F.array().cast("array<struct<entry_id:string,parents:array<string>,source:string,text:string,kind:string>>"))
    return export.exported_pages(pages).select("doc_id", F.posexplode("blocks").alias("n", "b")).select("doc_id", "n", "b.source", "b.translation")


@query("""select doc_id, sha256(text) as sha256 from documents""")
def verified_parts(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.lit(0).alias("first"), F.lit(0).alias("last"), F.sha2("text", 256).alias("sha256"), F.col("text").cast("binary").alias("content"), F.lit(1).alias("page_count"))
    return export.verified_parts(t.select("doc_id", "first", "last", "sha256"), t, t).select("doc_id", "sha256")


_PARTS_SQL = "parts as (select l_orderkey as doc_id, (l_linenumber * 4 - 4)::int as first, (l_linenumber * 4 - 4 + l_quantity % 6)::int as last from lineitem)"


def _parts(spark, d):
    n = F.col("l_linenumber") * 4 - 4
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.cast("int").alias("first"), (n + F.col("l_quantity") % 6).cast("int").alias("last"), F.lit("x").alias("sha256"))


@query(f"""with {_PARTS_SQL}, m as (select *, max(last) over (partition by doc_id order by first, last rows between unbounded preceding and 1 preceding) as e from parts) select doc_id, first, last from m where first <= e""")
def overlapping_parts(spark, d):
    return export.overlapping_parts(_parts(spark, d)).select("doc_id", "first", "last")


@query(f"""with {_PARTS_SQL}, s as (select o_orderkey as doc_id, unnest(range(4))::int as page_index from orders) select s.doc_id, s.page_index from s where not exists (select 1 from parts p where p.doc_id = s.doc_id and s.page_index between first and last)""")
def uncovered_pages(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("page_index"))
    return export.uncovered_pages(s, _parts(spark, d))


@query(f"""with {_PARTS_SQL}, m as (select *, max(last) over (partition by doc_id order by first, last rows between unbounded preceding and 1 preceding) as e from parts),
    s as (select o_orderkey as doc_id, unnest(range(3))::int as page_index from orders), u as (select doc_id from s where not exists (select 1 from parts p where p.doc_id = s.doc_id and s.page_index between first and last)), b as (select doc_id from m where first <= e union select doc_id from u)
    select doc_id, count(*) as n_parts, sum(last - first + 1)::bigint as n_pages from parts where doc_id not in (select doc_id from b) group by doc_id""")
def manifests(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("page_index"))
    return export.manifest(s, _parts(spark, d)).select("doc_id", "n_parts", "n_pages")


@query(f"""with {LINES}, p as (select distinct doc_id, page_index from lines), m as (select *, min(page_index) over (partition by doc_id) as low, max(page_index) over (partition by doc_id) as high from p), g as (select distinct doc_id, low + (page_index - low) // 2 * 2 as first, high from m)
    select doc_id, first, least(high, first + 1) as last, row_number() over (partition by doc_id order by not (1 between first and least(high, first + 1)), first) as turn from g""")
def chunks(spark, d):
    pages = text_lines(spark, d).select("doc_id", F.col("page_index").cast("long").alias("page_index")).distinct()
    return export.chunks(pages, limit=2, focus=1).select("doc_id", "first", "last", F.col("turn").cast("long").alias("turn"))


@query("""select conv_id as doc_id, turn as page_index, case when role <> 'user' then length(text) end as result, case when role = 'user' then 'ValueError: no reply' end as error from conversations""")
def worked_pages(spark, d):
    """Each conversation is a part; its users' turns fail, and the others must not suffer."""

    def work(turns: list) -> list:
        if any(t.role == "user" for t in turns):
            raise ValueError("no reply")
        return [len(t.text) for t in turns]

    t = table(spark, d, "conversations").select(F.col("conv_id").cast("long").alias("doc_id"), F.col("turn").cast("int").alias("page_index"), F.lit(0).alias("part"), "role", "text")
    return export.worked(t, work, "long")


@query("""with s as (select o_custkey as root, o_orderkey as path, sum(o_totalprice::bigint) over (partition by o_custkey order by o_orderdate desc, o_orderkey rows unbounded preceding) as s, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as n from orders) select root, path from s where n > 1 and s > 400000""")
def evicted_files(spark, d):
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("root"), F.col("o_orderkey").alias("path"), F.bround("o_totalprice").cast("long").alias("bytes"), F.col("o_orderdate").alias("used_at"))
    return export.evicted(c, 400_000).select("root", "path")


@query("select sha256(text) as sha256, count(*) as copies from documents group by 1")
def resources_by_content(spark, d):
    return export.one_of_each(table(spark, d, "documents").select(F.col("text").cast("binary").alias("content"))).select("sha256", "copies")


@query("""select o_orderkey as doc_id, unnest(range(o_custkey % 5, o_custkey % 5 + 4))::int as page_index from orders where o_custkey % 3 > 0 union all select o_orderkey, unnest(range(12))::int from orders where o_custkey % 3 = 0""")
def selected_pages(spark, d):
    k = F.col("o_custkey") % 5
    spec = F.when(F.col("o_custkey") % 3 > 0, F.concat_ws(",", F.concat_ws("-", k + 1, k + 3), (k + 4).cast("string"), (k + 2).cast("string"))).otherwise("")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(export.selected_pages(spec, F.lit(12))).alias("page_index"))


@query("""select doc_id, n_chars, case when n_chars % 7 > 0 then 1000 // (n_chars % 7) end as result, case when n_chars % 7 = 0 then 'ZeroDivisionError: integer division or modulo by zero' end as error from documents""")
def isolated_pages(spark, d):
    return export.isolated(table(spark, d, "documents").select("doc_id", "n_chars"), lambda r: 1000 // (r["n_chars"] % 7), "long")


@query("""select doc_id, 0 as page_index from documents where length(trim(text)) >= 20 and not regexp_matches(text, '[0-9]')""")
def empty_outputs(spark, d):
    """The output is what a document has of digits: most have none."""
    p = table(spark, d, "documents").select("doc_id", F.lit(0).alias("page_index"), "text")
    return quality.empty_outputs(p, p.withColumn("text", F.regexp_replace("text", "[^0-9]+", "")))


# -- jobs ----------------------------------------------------------------------


@query("""select user_id as job_id, event_type as stage, max(event_id) as peak, sum(value::decimal(28,4))::double as elapsed from events group by all""")
def stage_costs(spark, d):
    return progress.stage_costs(table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("bytes"), F.col("value").alias("seconds")))


@query("""select user_id as job_id, count_if(event_type <> 'error') as done, count(*) as selected, floor(100 * count_if(event_type <> 'error') / count(*))::bigint as percent from events group by 1""")
def job_progress(spark, d):
    return progress.progress(table(spark, d, "events").select(F.col("user_id").alias("job_id"), (F.col("event_type") != "error").alias("done")))


@query("""select user_id as job_id, count_if(event_type = 'view') as pending, max(case when event_type = 'view' then 1000000 - event_id end) as oldest from events group by 1""")
def waiting_requests(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("asked_at"), F.when(F.col("event_type") != "view", F.col("event_id")).alias("answered_at"))
    return progress.waiting(e, 1_000_000)


@query("""with recursive f as (select user_id, event_id, value::double as v, row_number() over (partition by user_id order by event_id) as n, event_id * 0.1::double as t, event_type = 'signup' as complete from events),
    r as (select user_id, n, event_id, t as last, true as goes from f where n = 1 union all select f.user_id, f.n, f.event_id, case when f.complete or f.t - r.last >= 50 then f.t else r.last end, f.complete or f.t - r.last >= 50 from r join f on f.user_id = r.user_id and f.n = r.n + 1)
    select user_id as doc_id, event_id as revision from r where goes""")
def throttled_frames(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.lit(0).alias("page_index"), F.col("event_id").alias("revision"), (F.col("event_id") * 0.1).cast("double").alias("at"), (F.col("event_type") == "signup").alias("complete"))
    return progress.throttled(e, 50.0).select("doc_id", "revision")


@query("""select user_id as doc_id, event_id, 100 + row_number() over (partition by user_id, event_type order by event_id) as revision from events""")
def frame_revisions(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("page_index"), F.col("event_id").alias("pos"), "event_id")
    return progress.revisions(e, 100).select("doc_id", "event_id", F.col("revision").cast("long").alias("revision"))


@query("""with n as (select user_id as store, event_id as artifact_id, row_number() over (partition by user_id order by event_id // 10 desc, event_id) as n from events) select store, artifact_id from n where n <= 2""")
def kept_artifacts(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("store"), F.col("event_id").alias("artifact_id"), F.floor(F.col("event_id") / 10).alias("used_at"))
    return progress.kept_artifacts(e, 0).select("store", "artifact_id")


@query("""with f as (select user_id as doc_id, event_id as revision, event_id % 50 as page_index, abs(event_id % 50 - user_id % 50) as d from events) select doc_id, arg_min(page_index, d * 10000000 + revision) as page_index, arg_min(revision, d * 10000000 + revision) as revision from f group by doc_id""")
def next_frame(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("revision"), (F.col("event_id") % 50).alias("page_index"))
    return progress.next_frame(e, e.select("doc_id").distinct().withColumn("current", F.col("doc_id") % 50))


@query("""select user_id as job_id, event_id as seq, 3 as n, event_type as stage, (event_id % 100)::varchar as done from events""")
def reported_progress(spark, d):
    fields = F.create_map(F.lit("type"), F.lit("progress_update"), F.lit("stage"), F.col("event_type"), F.lit("overall_progress"), (F.col("event_id") % 100).cast("string"), F.lit("path"), F.lit("/private"))
    r = progress.reported(table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), fields.alias("event")))
    return r.select("job_id", "seq", F.size("report").alias("n"), F.col("report")["stage"].alias("stage"), F.col("report")["overall_progress"].alias("done"))


@query("""select user_id as job_id, event_id as seq from events where event_type = 'error' qualify row_number() over (partition by user_id order by event_id) <= 5""")
def first_warnings(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"))
    return progress.first_warnings(e, 5)


@query("""select event_id from events where event_id > 500""")
def changes_after(spark, d):
    return jobs.changes_after(table(spark, d, "events").withColumnRenamed("event_id", "revision"), 500).select(F.col("revision").alias("event_id"))


def _stream(spark, d, name):
    # A pattern, since a stream's plain path must be a folder and a table may be one file.
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _own_folder(spark) -> str:
    shared_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


@query("""with n as (select conv_id as doc_id, count(distinct turn) as n from conversations group by 1) select doc_id, 1::bigint as revision, 1::bigint as paragraphs, 1::bigint as changed from n union all select doc_id, 2, n, n - 1 from n where n > 1""")
def streamed_previews(spark, d):
    turns = _stream(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("page_index"), F.col("turn").cast("string").alias("para_id"), F.col("turn").alias("seq"), "text")
    return jobs.drained(spark, jobs.previews(turns), _own_folder(spark)).drop("page_index")


@query("""with e as (select user_id::varchar as scope, event_type as id, (value > 50)::varchar as digest, event_id from events), f as (select *, first_value(digest) over w as d, row_number() over w as n from e window w as (partition by scope, id order by event_id))
    select scope, id, case when n = 1 then 'accepted' when digest = d then 'repeat' else 'conflict' end as status from f""")
def streamed_replies(spark, d):
    e = _stream(spark, d, "events").select(F.col("user_id").cast("string").alias("scope"), F.col("event_type").alias("id"), (F.col("value") > 50).cast("string").alias("digest"), F.col("event_id").alias("seq"))
    return jobs.drained(spark, jobs.accepted_once(e), _own_folder(spark))


# -- checks on entries -----------------------------------------------------------


@query(f"""with {REGIONS} select doc_id, page_index, least(sum(greatest(least(x2, 300) - greatest(x, 0), 0) * greatest(least(y2, 187) - greatest(y, 13), 0)) / (300 * 174.0::double), 1.0)::double as image_share from regions group by all""")
def image_shares(spark, d):
    r = regions(spark, d)
    return quality.image_shares(r, r.select("doc_id", "page_index").distinct().withColumn("width", F.lit(300.0)).withColumn("height", F.lit(200.0)), (0.065, 0.935))


@query("""select l_orderkey as doc_id, coalesce(sum(case when l_linenumber % 4 = 3 then l_quantity::int else 0 end) / nullif(sum(l_quantity::int), 0)::double, 0) as hidden_share from lineitem group by all""")
def hidden_shares(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), (F.col("l_linenumber") % 4).alias("mode"), F.col("l_quantity").cast("int").alias("n_chars"))
    return quality.hidden_shares(t).drop("page_index")


@query("""select l_orderkey as doc_id, l_linenumber as formula_id from lineitem where l_linenumber % 2 = 0 and l_suppkey % 2 = 0 and l_returnflag <> 'N'""")
def text_formulas(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("formula_id"), (F.col("l_linenumber") % 2).alias("curves"), F.lit(0).alias("forms"), F.array(F.lit("a"), F.when(F.col("l_suppkey") % 2 == 1, "β").otherwise("b")).alias("chars"), F.array(F.when(F.col("l_returnflag") == "N", "CMMI10").otherwise("Times")).alias("fonts"))
    return quality.text_formulas(t).select("doc_id", "formula_id")


@query("""select l_orderkey as doc_id, l_linenumber as entry_id from lineitem where l_returnflag <> 'A' and l_linestatus = 'O'""")
def checked_entries(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("entry_id"), F.when(F.col("l_returnflag") == "A", "other").otherwise("list").alias("kind"), F.lit("x").alias("text"), F.when(F.col("l_linestatus") == "O", "1.").otherwise("not a label").alias("label"))
    return quality.checked_entries(t).select("doc_id", "entry_id")


@query("""select conv_id as doc_id, turn as entry_id, case when length(regexp_extract(text, '^[^ ]+')) > 0 then length(regexp_extract(text, '^[^ ]+')) end::int as n_label from conversations where regexp_matches(text, '^[A-Za-z]+ ')""")
def label_glyphs(spark, d):
    t = table(spark, d, "conversations").where(F.col("text").rlike("^[A-Za-z]+ ")).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("entry_id"), F.regexp_extract("text", "^[^ ]+", 0).alias("label"), F.split("text", "").alias("chars"))
    return quality.label_glyphs(t).select("doc_id", "entry_id", "n_label")


@query("""select conv_id as doc_id, turn, length(turn::varchar) as n_tail, turn % 4 + 2 as n_leaders from conversations""")
def tail_glyphs(spark, d):
    text = F.concat(F.lit("Title "), F.repeat(F.lit("."), (F.col("turn") % 4).cast("int")), F.lit(" "), F.col("turn").cast("string"))
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.col("turn").cast("string").alias("page_label"), F.regexp_extract_all(text, F.lit("."), F.lit(0)).alias("chars"))
    return quality.tail_glyphs(t).select("doc_id", "turn", "n_tail", "n_leaders")


@query()
def title_regions(spark, d):
    """A page a user: an event is a glyph, and every third one's place was recognised."""
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.lit(0).alias("page_index"), (F.col("event_id") * 37 % 400).cast("double").alias("x"), (F.col("event_id") * 13 % 300).cast("double").alias("y"), (4 + F.col("event_id") % 9).cast("double").alias("w"), "event_id")
    pages = e.select("doc_id", "page_index").distinct().withColumn("width", F.lit(400.0)).withColumn("height", F.lit(300.0))
    words = e.where("event_id % 3 = 0").select("doc_id", "page_index", "x", (F.col("y") - 2).alias("y"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + 2).alias("y2"))
    return quality.title_regions(e.drop("event_id"), pages, words)


@query(r"""with t as (select conv_id as doc_id, turn, text, case turn % 3 when 0 then 'figure_caption' when 1 then 'table_cell' else 'text' end as label, turn % 2 = 0 as graphics from conversations)
    select doc_id, turn, label = 'text' and len(regexp_extract_all(text, '\p{L}')) >= 24 and not regexp_matches(text, '(?i)copyright|all rights reserved|publishing group|^ *[©®]') or (label = 'figure_caption' or label = 'table_cell' and graphics) and len(regexp_extract_all(text, '\p{L}')) >= 2 as body from t""")
def body_requests(spark, d):
    label = F.when(F.col("turn") % 3 == 0, "figure_caption").when(F.col("turn") % 3 == 1, "table_cell").otherwise("text")
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", quality.body_request(F.col("turn") % 2 == 0, label, F.col("text")).alias("body"))


@query("""select conv_id as doc_id, turn from conversations where turn % 3 <> 1 and length(trim(text)) >= 20""")
def translatable_turns(spark, d):
    return table(spark, d, "conversations").where(quality.translatable(F.col("turn") % 3 == 1, F.nullif(F.trim("text"), F.lit("")), 20)).select(F.col("conv_id").alias("doc_id"), "turn")


@query("""select p_partkey, p_size % 5 < 4 as known, p_size % 5 in (1, 3) as bold, p_size % 5 in (2, 3) as italic, p_size % 5 in (1, 2, 3) as serif, p_size % 5 = 2 as monospace from part""")
def font_names(spark, d):
    names = F.array(*map(F.lit, ("ABCDEF+Helvetica", "Times-Bold", "XYZABC+Courier-Oblique", "TIMES-BOLDITALIC", "Arial-Bold")))
    traits = T.font_traits(F.element_at(names, (F.col("p_size") % 5 + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", traits.alias("t")).select("p_partkey", F.col("t").isNotNull().alias("known"), *(F.coalesce(f"t.{c}", F.lit(False)).alias(c) for c in ("bold", "italic", "serif", "monospace")))


@query("""select event_id, case when event_id % 2 = 0 then event_id % 100 else event_id % 26 + 1 end::int as n from events""")
def list_ordinals(spark, d):
    label = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 100).cast("string")).otherwise(F.char(F.col("event_id") % 26 + 65))
    return table(spark, d, "events").select("event_id", T.ordinal(label).alias("n"))


@query("""select conv_id, turn, case when turn % 2 = 0 then 'inline' else 'body' end as kind, text, case when turn % 2 = 0 then substr(text, 1, 16384) else '' end as latex, least(greatest(turn / 4.0::double, 0), 1) as score from conversations""")
def model_regions(spark, d):
    found = T.region(F.when(F.col("turn") % 2 == 0, "inline").otherwise("body"), F.lit(None), F.col("text"), F.col("turn") / 4.0)
    return table(spark, d, "conversations").select("conv_id", "turn", found.alias("r")).select("conv_id", "turn", "r.kind", "r.text", "r.latex", "r.score")


@query("""select event_id, least(greatest(event_id % 300, 70), 160) / 100.0::double as scale, case when event_type = 'view' then 'serif' when event_type = 'error' then 'sans-serif' end as family, value > 50 as refs, value <= 75 as rich from events""")
def document_options(spark, d):
    family = F.when(F.col("event_type") == "view", "serif").when(F.col("event_type") == "error", "sans").otherwise(F.col("event_type"))
    raw = F.concat(F.lit('{"fontScale": '), (F.col("event_id") % 300).cast("string"), F.lit(', "fontFamily": "'), family, F.lit('", "ignoreReferences": '), (F.col("value") > 50).cast("string"), F.lit(', "preserveRichText": '), (F.col("value") <= 75).cast("string"), F.lit("}"))
    found = table(spark, d, "events").select("event_id", T.options(raw).alias("o"))
    return found.select("event_id", F.col("o.fontScale").alias("scale"), F.col("o.fontFamily").alias("family"), F.col("o.ignoreReferences").alias("refs"), F.col("o.preserveRichText").alias("rich"))


@query("""select event_id, case when event_id % 2 = 0 then event_id % 9 end as x, case when event_id % 2 = 1 then event_type end as name from events""")
def typed_records(spark, d):
    record = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"type": "Box", "fields": {"x": '), (F.col("event_id") % 9).cast("string"), F.lit("}}"))).otherwise(F.concat(F.lit('{"type": "Style", "fields": {"name": "'), "event_type", F.lit('"}}')))
    found = table(spark, d, "events").select("event_id", files.typed_record(record, {"Box": "x long", "Style": "name string"}).alias("r"))
    return found.select("event_id", "r.Box.x", "r.Style.name")


@query("""select doc_id, text as left_text, upper(lang) as right_text from documents""")
def compared_pages(spark, d):
    t = table(spark, d, "documents").withColumn("page_index", F.lit(0))
    return export.compared(t, t.withColumn("text", F.upper("lang"))).select("doc_id", "left_text", "right_text")


@query("""select conv_id as doc_id, turn as page_index, 'body' as kind, text from conversations""")
def il_regions(spark, d):
    t = table(spark, d, "conversations")
    box = F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("x2"), F.lit(4.0).alias("y2"))
    paragraph = F.struct(box.alias("box"), F.col("text").alias("unicode"))
    page = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.array(F.struct(F.col("turn").alias("pageNumber"), F.array(paragraph).alias("pdfParagraph"))).alias("page")))).otherwise(F.to_json(F.struct(F.array(F.struct(F.col("turn").alias("page_number"), F.array(paragraph).alias("pdf_paragraph"))).alias("page"))))
    return export.il_regions(t.select(F.col("conv_id").alias("doc_id"), page.alias("json"))).select("doc_id", F.col("page_index").cast("long").alias("page_index"), "kind", "text")


# -- relational additions ------------------------------------------------------


@query("""select l_returnflag, l_linestatus, sum(l_quantity::decimal(28,4))::double as sum_qty, sum((l_extendedprice * (1 - l_discount))::decimal(28,4))::double as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def pricing_summary(spark, d):
    t = table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return t.groupBy("l_returnflag", "l_linestatus").agg(relational.exact_sum(F.col("l_quantity")).alias("sum_qty"), relational.exact_sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("""select l_orderkey, sum((l_extendedprice * (1 - l_discount))::decimal(28,4))::double as revenue, any_value(o_orderpriority) as priority from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' group by l_orderkey order by revenue desc, l_orderkey limit 10""")
def top_orders(spark, d):
    c, o, t = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), table(spark, d, "orders"), table(spark, d, "lineitem")
    j = c.join(o, F.col("c_custkey") == F.col("o_custkey")).join(t, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_orderkey").agg(relational.exact_sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.first("o_orderpriority").alias("priority")).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query("""select r_name, n_name, sum(o_totalprice::decimal(28,4))::double as total, count(*) as n from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by all""")
def sales_by_nation(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(relational.exact_sum(F.col("o_totalprice")).alias("total"), F.count(F.lit(1)).alias("n"))


@query("""select coalesce(s_nationkey, c_nationkey) as nation, count(distinct s_suppkey) as suppliers, count(distinct c_custkey) as customers from supplier full join customer on s_nationkey = c_nationkey group by all""")
def full_outer(spark, d):
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count_distinct("s_suppkey").alias("suppliers"))
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("customers"))
    both = s.join(c, F.col("s_nationkey") == F.col("c_nationkey"), "full")
    return both.groupBy(F.coalesce("s_nationkey", "c_nationkey").alias("nation")).agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("suppliers", "customers")))


@query("""select c_custkey from customer where c_acctbal > 0 and not exists (select 1 from orders where o_custkey = c_custkey) union all select c_custkey from customer where c_acctbal <= 0 and exists (select 1 from orders where o_custkey = c_custkey)""")
def semi_and_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.where("c_acctbal > 0").join(o, "c_custkey", "left_anti").select("c_custkey").unionByName(c.where("c_acctbal <= 0").join(o, "c_custkey", "left_semi").select("c_custkey"))


@query("""select o_custkey, count(*) as n from orders o where o_totalprice > (select avg(o_totalprice) from orders) and exists (select 1 from customer where c_custkey = o_custkey and c_acctbal > 0) group by o_custkey having count(*) >= (select min(n_regionkey) from nation)""")
def subqueries(spark, d):
    """Views and subqueries, scalar and correlated, in SQL."""
    frames = {n: table(spark, d, n) for n in ("orders", "customer", "nation")}
    return spark.sql("""
        with large as (select o_custkey from {orders} where o_totalprice > (select avg(o_totalprice) from {orders}))
        select o_custkey, count(*) as n from large
        where exists (select 1 from {customer} where c_custkey = o_custkey and c_acctbal > 0)
        group by o_custkey having count(*) >= (select min(n_regionkey) from {nation})""", **frames)  # fmt: skip


@query("""with s as (select user_id, ts, event_id, value from events where event_type = 'signup') select e.event_id, s.event_id as asof_event_id from (select * from events where event_type = 'error') e asof left join s on e.user_id = s.user_id and e.ts >= s.ts""")
def as_of_signup(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return relational.as_of(e.where("event_type = 'error'"), e.where("event_type = 'signup'"), "user_id", "ts", "ts", ["event_id"]).select("event_id", "asof_event_id")


@query("""with i as (select user_id, event_id as start_id, event_id + 500 as end_id from events where event_type = 'signup') select e.event_id, i.start_id from events e join i on i.user_id = e.user_id and e.event_id >= start_id and e.event_id < end_id where e.event_type = 'view'""")
def in_interval(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    i = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("start_id"), (F.col("event_id") + 500).alias("end_id"))
    return relational.in_interval(e.where("event_type = 'view'"), i, "user_id", "event_id", "start_id", "end_id", 500).select("event_id", "start_id")


_CUBE = "sum(l_quantity::decimal(28,4))::double as qty, count(*) as n from lineitem"


@query(f"select l_returnflag, l_linestatus, {_CUBE} group by cube (l_returnflag, l_linestatus)")
def cubed(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(relational.exact_sum(F.col("l_quantity")).alias("qty"), F.count(F.lit(1)).alias("n"))


@query(f"select l_returnflag, l_linestatus, {_CUBE} group by rollup (l_returnflag, l_linestatus)")
def rolled_up(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(relational.exact_sum(F.col("l_quantity")).alias("qty"), F.count(F.lit(1)).alias("n"))


@query(f"select l_returnflag, l_linestatus, {_CUBE} group by grouping sets ((l_returnflag), (l_linestatus))")
def grouping_sets(spark, d):
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, d, "lineitem").groupingSets([[a], [b]], a, b).agg(relational.exact_sum(F.col("l_quantity")).alias("qty"), F.count(F.lit(1)).alias("n"))


@query("""select o_orderpriority, count_if(o_orderstatus = 'F') as f, count_if(o_orderstatus = 'O') as o, count_if(o_orderstatus = 'P') as p from orders group by 1""")
def pivoted(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().select("o_orderpriority", *(F.coalesce(c, F.lit(0)).cast("long").alias(c.lower()) for c in "FOP"))


@query("""select o_orderkey, rank() over w as rnk, dense_rank() over w as dense, ntile(4) over (partition by o_custkey order by o_totalprice, o_orderkey) as quarter, percent_rank() over w as pct, cume_dist() over w as cume, lag(o_orderkey) over (partition by o_custkey order by o_totalprice, o_orderkey) as prev from orders window w as (partition by o_custkey order by o_totalprice)""")
def ranks(spark, d):
    w, u = Window.partitionBy("o_custkey").orderBy("o_totalprice"), Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("rnk"), F.dense_rank().over(w).cast("long").alias("dense"), F.ntile(4).over(u).cast("long").alias("quarter"), F.percent_rank().over(w).alias("pct"), F.cume_dist().over(w).alias("cume"), F.lag("o_orderkey").over(u).alias("prev"))


@query("""select event_id, sum(value::decimal(28,4)) over (partition by user_id order by event_id rows between 2 preceding and current row)::double as rows3, max(value) over (partition by user_id order by event_id range between 100 preceding and 100 following) as near from events""")
def frames(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("event_id", F.sum(F.col("value").cast("decimal(28,4)")).over(w.rowsBetween(-2, 0)).cast("double").alias("rows3"), F.max("value").over(w.rangeBetween(-100, 100)).alias("near"))


@query("""(select p_brand, p_type from part where p_size > 25 intersect select p_brand, p_type from part where p_size <= 25) union (select p_brand, p_type from part where p_retailprice > 1500 except select p_brand, p_type from part where p_size < 5)""")
def set_operations(spark, d):
    p = table(spark, d, "part")
    pick = lambda c: p.where(c).select("p_brand", "p_type")
    return pick("p_size > 25").intersect(pick("p_size <= 25")).union(pick("p_retailprice > 1500").subtract(pick("p_size < 5"))).distinct()


@query("""select year(o_orderdate)::int as y, quarter(o_orderdate)::int as q, strftime(date_trunc('month', o_orderdate), '%Y-%m') as month, count(*) as n, max(date_diff('day', o_orderdate::date, date '1999-01-01'))::int as age from orders group by all""")
def by_date(spark, d):
    o = F.col("o_orderdate")
    return table(spark, d, "orders").groupBy(F.year(o).alias("y"), F.quarter(o).alias("q"), F.date_format(F.date_trunc("month", o), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.max(F.datediff(F.lit("1999-01-01").cast("date"), o.cast("date"))).alias("age"))


@query("""select epoch(time_bucket(interval '1 hour', ts))::bigint as start, event_type, count(*) as n, sum(value::decimal(28,4))::double as total from events group by all""")
def tumbling(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), relational.exact_sum(F.col("value")).alias("total")).select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "total")


@query("""with b as (select event_type, epoch(time_bucket(interval '30 minutes', ts))::bigint as s from events), w as (select event_type, s as start from b union all select event_type, s - 1800 from b) select start, event_type, count(*) as n from w group by all""")
def sliding(spark, d):
    return jobs.windows(table(spark, d, "events"), "1 hour", "30 minutes").select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
    select user_id, floor(epoch(min(ts)))::bigint as start, count(*) as n from s group by user_id, k""")
def user_sessions(spark, d):
    return jobs.sessions(table(spark, d, "events"), "6 hours").select("user_id", F.unix_timestamp("start").alias("start"), "n")


@query("""with recursive e as (select l_partkey as src, l_suppkey as dst from lineitem where l_quantity > 49), r as (select 1::bigint as node union select e.dst from r join e on e.src = r.node) select node from r""")
def reachable(spark, d):
    shared_folder(spark)
    e = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return relational.reachable(e, spark.range(1, 2).withColumnRenamed("id", "node"))


@query()
def approximate(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("median_qty"))


@query("""select event_type, json_extract_string(props, '$.k')::int as k, count(*) as n from events group by all""")
def json_fields(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""select label, count(*) as n, round(avg(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 3) as norm from embeddings group by label""")
def vector_norms(spark, d):
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(norm), 3).alias("norm"))
