"""Site-relative line deduplication, in DataFrame expressions only.

A line is boilerplate on a host if it stands on more than ``ratio`` of the host's pages
and on at least ``min_pages`` of them; every occurrence on that host is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.staging import stage

RATIO = 0.1
#: A line that one page alone holds is no boilerplate, however few pages its host has.
MIN_PAGES = 2

#: Patterns that turn HTML into lines, understood alike by Java and RE2. What is not closed reaches to the
#: end, and a tag ends where the next one begins, so that no page is read more than a few times.
HTML_HIDDEN = r"(?is)<script[^<>]*>.*?(?:</script>|\z)|<style[^<>]*>.*?(?:</style>|\z)|<!--.*?(?:-->|\z)"
HTML_BREAK = r"(?i)</?(p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|title|head|body|nav|footer|header|article|section|aside|html)( [^<>]*)?/?>"
HTML_TAG = r"<[^<>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def html_lines(html: Column) -> Column:
    """Text of ``html``, a line for each block element, without blank lines at block edges."""
    shown = F.regexp_replace(html, HTML_HIDDEN, " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(shown, HTML_BREAK, "\n"), HTML_TAG, ""), r"[ \t]*\n[ \t\n]*", "\n")


def url_host(url: Column) -> Column:
    """Lower-cased host and port of an absolute URL, else an empty string."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def _bare(line: Column) -> Column:
    return F.trim(line)


def _mark(line: Column) -> Column:
    """Identity of a line on its host: a 64-bit hash, which only has to tell it from the host's few boilerplate lines."""
    return F.xxhash64(line)


def boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host, marks)``: each host's boilerplate lines by hash. At most (lines a page) / ``ratio`` a host."""
    lines = F.filter(F.transform(F.split(F.col(f"`{text_col}`"), "\n", -1), _bare), lambda x: x != "")
    marks = pages.select(F.col(f"`{host_col}`").alias("host"), F.array_distinct(F.transform(lines, _mark)).alias("marks"))
    # A row without a mark counts the page.
    each = marks.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), F.coalesce("marks", F.array()))).alias("mark"))
    counted = each.groupBy("host", "mark").agg(F.count("*").alias("n")).where((F.col("n") >= min_pages) | F.col("mark").isNull())
    counted = stage(counted, "line-counts")
    per_host = counted.where("mark is null").select("host", F.col("n").alias("pages"))
    often = counted.where("mark is not null")
    kept = often.join(per_host, often["host"].eqNullSafe(per_host["host"])).where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return kept.groupBy(often["host"]).agg(F.collect_list("mark").alias("marks"))


def drop_boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text_col`` and ``_dropped_lines`` (how many; a column of that name is replaced).

    Lines are split at ``\\n`` and compared without blanks at their ends; blank lines are
    never dropped. A page counts a line once. Null hosts form one host; null texts count as
    pages and stay null; a page that loses every line keeps an empty text. Repeated rows
    count as pages of their own. All rows and columns stay, whatever the columns' names; a page of any
    length is read whole. Pages are joined with their
    host's list: by a broadcast if what was written is below the session's threshold, so that
    no text moves, else by a sort-merge join that AQE splits where a host is hot. An empty table gives no rows.
    """
    # Written first, so that its size is known when the join is planned.
    found = stage(boilerplate(pages, host_col, text_col, ratio, min_pages), "boilerplate").select(F.coalesce("host", F.lit("")).alias("at"), F.col("host").isNull().alias("none"), "marks")
    text, host = F.col(f"`{text_col}`"), F.col(f"`{host_col}`")
    whole = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page")
    joined = pages.select(whole, F.coalesce(host, F.lit("")).alias("at"), host.isNull().alias("none"), text.alias("text")).join(found, ["at", "none"], "left")
    lines = F.split("text", "\n", -1)
    here = joined.withColumn("marks", F.array_intersect(F.transform(lines, lambda x: _mark(_bare(x))), "marks"))
    hit = F.coalesce(F.size("marks"), F.lit(0)) > 0
    kept = F.filter(lines, lambda x: ~F.array_contains("marks", _mark(_bare(x))) | (_bare(x) == ""))
    out = here.withColumn("kept", F.when(hit, kept))
    shown = F.when(hit, F.array_join("kept", "\n")).otherwise(F.col("text"))
    columns = [(shown if c == text_col else F.col("page").getField(c)).alias(c) for c in pages.columns if c != "_dropped_lines"]
    return out.select(*columns, F.when(hit, F.size(lines) - F.size("kept")).otherwise(0).alias("_dropped_lines"))


def dedup_pages(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(page_id, host, text, dropped_lines)`` for every row of ``pages`` (page_id, url, html).

    A null URL has a null host, one that is not absolute the empty one; a null page keeps a null text.
    """
    lined = pages.select("page_id", url_host(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text"))
    return drop_boilerplate(lined, "host", "text", ratio, min_pages).withColumnRenamed("_dropped_lines", "dropped_lines")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LINED = f"""lined as (select page_id, lower(regexp_extract(url, {_q(HOST)}, 1)) as host,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, {_q(HTML_HIDDEN)}, ' ', 'g'), {_q(HTML_BREAK)}, chr(10), 'g'), {_q(HTML_TAG)}, '', 'g'), '[ \\t]*\\n[ \\t\\n]*', chr(10), 'g') as text from pages)"""

ORACLE = f"""with {_LINED},
numbered as (select *, row_number() over () as r from lined),
lines as (select r, page_id, host, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from numbered),
hosts as (select host, count(*) as pages from numbered group by host),
often as (select l.host, trim(line, ' ') as bare, count(distinct r) as n from lines l where trim(line, ' ') <> '' group by all),
drops as (select o.host, o.bare from often o join hosts h on o.host is not distinct from h.host where n >= {MIN_PAGES} and n > {RATIO}::double * pages),
kept as (select l.r, string_agg(line, chr(10) order by i) filter (where d.bare is null) as text, count(d.bare) as dropped from lines l left join drops d on l.host is not distinct from d.host and trim(line, ' ') = d.bare group by l.r)
select n.page_id, n.host, case when n.text is null then null else coalesce(k.text, '') end as text, coalesce(k.dropped, 0)::int as dropped_lines
from numbered n left join kept k on n.r = k.r"""
