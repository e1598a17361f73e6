"""Site-relative line deduplication.

Lines are counted once per page within their host; a line that repeats there, on more than PERCENT of the host's pages,
is boilerplate and is dropped from its pages. A line of one page alone repeats nowhere: without that, the ratio would
empty every page of a host with few pages. Lines are compared after trimming, by md5; blank lines are never counted nor
dropped. DataFrame operations only.

Counting shuffles 16-byte digests that are summed map-side first, never the lines. A host's boilerplate has at most
(mean lines per page) / (ratio) entries, however many pages it has, so it is one small row; the table of hosts is
written, so the planner broadcasts it if it is small and joins by host, splitting skewed hosts, if it isn't.

Defined results: a null text has no lines and stays as it is; texts of any length are split whole; a null host is one
host; repeated rows are separate pages; other columns, whatever their names, are kept; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_nulls, staged, table

#: A line on more than this share of a host's pages, in hundredths, is boilerplate if it is on so many of them: if it repeats.
PERCENT, REPEATS = 10, 2
#: What a page's markup becomes, in order; tags that end a line.
HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
BREAKS = r"(?i)</?(?:a|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
TAGS = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def page_text(html: Column) -> Column:
    """The visible text of a page, a line for each block or link, without blank lines."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BREAKS, "\n"), TAGS, "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    lines = F.transform(F.split(F.translate(plain, "\r\t", "  "), "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def boilerplate(pages: DataFrame, host_col: str, text_col: str, percent: int = PERCENT) -> DataFrame:
    """(host, drop): the digests of each host's boilerplate lines."""
    two = pages.select(F.col(host_col).alias("host"), F.split(text_col, "\n").alias("lines"))
    full = F.filter("lines", lambda x: F.trim(x) != "")
    keys = two.select("host", F.explode(F.array_distinct(F.transform(full, _key))).alias("key"))
    often = keys.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= REPEATS)
    totals = pages.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    found = join_nulls(often, totals, ["host"]).where(100 * F.col("n") > percent * F.col("pages"))
    return staged(found.groupBy("host").agg(F.collect_list("key").alias("drop")), "boilerplate")


def drop_boilerplate(pages: DataFrame, host_col: str, text_col: str, percent: int = PERCENT, counts: tuple[str, str] | None = None) -> DataFrame:
    """The rows of pages with boilerplate lines dropped from the text.

    counts: names of two more columns, the lines that aren't blank and how many of them are dropped; names that pages has raise ValueError."""
    if counts and (taken := {c.lower() for c in counts} & {c.lower() for c in pages.columns}):
        raise ValueError(f"the table has columns {', '.join(sorted(taken))} already")
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), F.col(host_col).alias("host"))
    marked = join_nulls(rows, boilerplate(pages, host_col, text_col, percent), ["host"], "left")
    text = F.col(f"row.`{text_col}`")
    none = F.array().cast("array<string>")
    marked = marked.withColumn("lines", F.split(text, "\n"))
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("drop"), _key(x))))
    count = lambda c: F.size(F.filter(F.coalesce(c, none), lambda x: F.trim(x) != "")).cast("long")
    marked = marked.withColumn("kept", kept).withColumn("n_lines", count(F.col("lines"))).withColumn("n_dropped", F.col("n_lines") - count(F.col("kept")))
    new = F.when(F.col("n_dropped") > 0, F.array_join("kept", "\n")).otherwise(text)
    own = [new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in pages.columns]
    return marked.select(*own, *([] if counts is None else [F.col("n_lines").alias(counts[0]), F.col("n_dropped").alias(counts[1])]))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), page_text(F.col("html")).alias("text"))
    return drop_boilerplate(staged(pages, "pages"), "host", "text", counts=("n_lines", "n_dropped"))


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


OP4_SQL = rf"""
WITH t AS (SELECT page_id, lower(regexp_extract(url, '{_quoted(HOST)}', 1)) AS host, row_number() OVER () AS rid,
  list_filter(list_transform(string_split(translate(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(html, '{_quoted(HIDDEN)}', '', 'g'), '{_quoted(BREAKS)}', chr(10), 'g'), '{_quoted(TAGS)}', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), chr(13) || chr(9), '  '), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages),
n AS (SELECT host, count(*) AS pages FROM t GROUP BY host),
l AS (SELECT DISTINCT rid, host, unnest(lines) AS line FROM t),
o AS (SELECT host, line, count(*) AS n FROM l GROUP BY host, line HAVING count(*) >= {REPEATS}),
b AS (SELECT o.host, list(line) AS bad FROM o JOIN n ON o.host IS NOT DISTINCT FROM n.host WHERE 100 * o.n > {PERCENT} * n.pages GROUP BY o.host),
k AS (SELECT t.page_id, t.host, t.lines, CASE WHEN bad IS NULL THEN t.lines ELSE list_filter(t.lines, lambda x: NOT list_contains(bad, x)) END AS kept
      FROM t LEFT JOIN b ON t.host IS NOT DISTINCT FROM b.host)
SELECT page_id, host, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
       array_to_string(kept, chr(10)) AS text FROM k
"""
