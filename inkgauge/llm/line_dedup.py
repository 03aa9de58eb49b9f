"""Line dedup by site-relative frequency.

Pages are grouped by host; for each line the pages of the host that contain it are counted and divided by the
host's pages. Lines above `ratio` (and on `min_pages` pages at least) are the site's boilerplate and go.

Lines are compared trimmed, by a 64-bit hash within their host; blank lines are never counted or dropped. A page
counts once for a line it repeats. At most 1/ratio times a page's mean lines can be boilerplate of a host, so the
list of each host is short; it meets the pages by `join_small`, so a hot host is split.

Defined results: null text has no lines and stays null; a null host is a host; an empty table gives no rows; lines
of hosts with fewer than min_pages pages stay; repeated rows count as pages of their own; extra columns stay, but
for those named like what is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import join_small

#: Elements that end a line of a page's text.
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"


SCRIPTS = r"(?is)<(?:script\b.*?</script\s*>|style\b.*?</style\s*>|!--.*?-->)"
BROKEN = rf"(?i)</?(?:{BLOCKS})\b[^>]*>"
TAG = r"</?[A-Za-z!][^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"
BLANKS = " \t\r\f\v"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without user and port; null if there is none."""
    found = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(found != "", found)


def html_text(html: Column) -> Column:
    """A page's text with a line for each block element; scripts, styles and comments are left out."""
    bare = F.regexp_replace(html, SCRIPTS, "")
    broken = F.regexp_replace(bare, BROKEN, "\n")
    text = F.regexp_replace(broken, TAG, "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANKS)))


def boilerplate(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """pages(__host, __text) -> a row for each host that has boilerplate: __host, __drop (hashes of its lines)."""
    lines = F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    counts = (
        pages.select("__host", F.explode(F.array_distinct(F.transform(lines, _key))).alias("line"))
        .groupBy("__host", "line")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_pages)
    )
    totals = pages.groupBy("__host").agg(F.count("*").alias("__pages"))
    return (
        join_small(counts, totals, ["__host"])
        .where(F.col("n") > F.lit(float(ratio)) * F.col("__pages"))
        .groupBy("__host")
        .agg(F.sort_array(F.collect_list("line")).alias("__drop"))
    )


def drop_site_lines(
    pages: DataFrame, host: Column, text: Column, *, ratio: float = 0.1, min_pages: int = 5
) -> DataFrame:
    """pages with host, kept_text, n_lines (not blank), n_dropped."""
    base = pages.withColumn("__host", host).withColumn("__text", text)
    drop = boilerplate(base.select("__host", "__text"), ratio, min_pages)
    gone = lambda x: F.array_contains("__drop", _key(x))
    lines = F.split("__text", "\n")
    full = F.filter(lines, lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    added = ("host", "kept_text", "n_lines", "n_dropped")
    return join_small(base, drop, ["__host"]).select(
        *[c for c in pages.columns if c not in added],
        F.col("__host").alias("host"),
        F.when(F.col("__drop").isNull(), F.col("__text"))
        .otherwise(F.array_join(F.filter(lines, lambda x: (F.btrim(x, F.lit(BLANKS)) == "") | ~gone(x)), "\n"))
        .alias("kept_text"),
        F.coalesce(F.size(full), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("__drop").isNull() | F.col("__text").isNull(), F.lit(0)).otherwise(F.size(F.filter(full, gone))).cast("long").alias("n_dropped"),
    )
