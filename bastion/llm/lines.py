"""Operator 2: site-relative line deduplication of web pages.

Pages are cut into visible lines. Per host (the URL's host, lower-cased, without port) the pages
that contain a line are divided by the host's pages; a line whose ratio exceeds ``most`` is
boilerplate of that site and is dropped from all its pages. A line of one page only is none, whatever the ratio
(on a host of one page every ratio is 1), so hosts of any size are judged alike.

A line counts once per page. Counts are partial sums before their shuffle, keyed by host and a
128-bit line digest, so a hot host spreads over all tasks by its lines; texts travel once, with
their pages. Only boilerplate lines, at most 1 / ``most`` distinct ones per page on average, are
sent back to pages, as digests.

Defined cases: null html = empty page (no lines); null or unparsable url = host ``''``, a host like
any other; lines are compared after trimming and collapsing white space; blank lines vanish;
repeated page ids are separate rows and count as separate pages; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

RATIO = 0.3

HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</(script|style)>|<head\b[^>]*>.*?</head>"
BLOCK = r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>"
TAG = r"<[^>]*>"
#: Entities decoded in visible text; ``&amp;`` comes last so that nothing is decoded twice. Fixed values.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"),
            ("&middot;", "·"), ("&amp;", "&")]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def visible_lines(html: Column) -> Column:
    """Trimmed non-blank visible lines of a page, in order."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), TAG, "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    lines = F.split(F.regexp_replace(text, r"[ \t\r\f]+", " "), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def site_boilerplate(lines: DataFrame, most: float = RATIO) -> DataFrame:
    """(host, line digest, pages, host_pages) of lines over the ratio, from rows (host, digests array)."""
    totals = lines.groupBy("host").agg(F.count("*").alias("host_pages"))
    seen = (lines.select("host", F.explode(F.array_distinct("digests")).alias("digest"))
            .groupBy("host", "digest").agg(F.count("*").alias("pages")).where("pages > 1"))
    return seen.join(totals, "host").where(F.col("pages") / F.col("host_pages") > most)


def drop_boilerplate(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                     most: float = RATIO) -> DataFrame:
    """One row per page: id, host, text (kept lines joined by newline), n_lines, n_dropped."""
    page = df.select(F.col(id_col).alias("__llm_id"), host_of(F.col(url_col)).alias("host"),
                     visible_lines(F.col(html_col)).alias("lines"))
    # the lines are read by three branches: one written table instead of three runs of the markup patterns
    page = C.stage(page.withColumn("__llm_row", F.monotonically_increasing_id()), "lines")
    # digests are cheaper to compute again than to store: 16 bytes a line that nothing compresses
    page = page.withColumn("digests", F.transform("lines", lambda x: F.unhex(F.md5(x.cast("binary")))))
    bad = site_boilerplate(page.select("host", "digests"), most)
    hits = (page.select("__llm_row", "host", F.explode(F.array_distinct("digests")).alias("digest"))
            .join(bad.select("host", "digest"), ["host", "digest"])
            .groupBy("__llm_row").agg(F.collect_list("digest").alias("__llm_bad")))  # at most a page's own lines
    kept = F.filter(F.arrays_zip("lines", "digests"), lambda z: ~F.array_contains(F.col("__llm_bad"), z["digests"]))
    none = F.array().cast("array<binary>")
    return (page.join(hits, "__llm_row", "left").withColumn("__llm_bad", F.coalesce("__llm_bad", none))
            .withColumn("__llm_kept", F.transform(kept, lambda z: z["lines"]))
            .select(F.col("__llm_id").alias(id_col), "host", F.array_join("__llm_kept", "\n").alias("text"),
                    F.size("lines").cast("long").alias("n_lines"),
                    (F.size("lines") - F.size("__llm_kept")).cast("long").alias("n_dropped")))


def op2_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(C.read(spark, sf_dir, "pages"))


QUERIES = {"op2_site_line_dedup": op2_site_line_dedup}


def _sql_entities(expr: str) -> str:
    for name, char in ENTITIES:
        char = char.replace("'", "''")
        expr = f"replace({expr}, '{name}', '{char}')"
    return expr


ORACLE = {"op2_site_line_dedup": f"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    list_filter(list_transform(string_split(regexp_replace({_sql_entities(
        f"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{HIDDEN}', chr(10), 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g')")},
      '[ \\t\\r\\f]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM pages),
l AS (SELECT r, host, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM p),
t AS (SELECT host, count(*) AS host_pages FROM p GROUP BY host),
bad AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT r) AS pages FROM l GROUP BY host, line) s JOIN t USING (host)
  WHERE pages > 1 AND pages / host_pages > {RATIO}),
k AS (SELECT l.r, string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE b.line IS NULL) AS text,
    count(*) FILTER (WHERE b.line IS NOT NULL) AS n_dropped
  FROM l LEFT JOIN bad b ON l.host = b.host AND l.line = b.line GROUP BY l.r)
SELECT page_id, host, coalesce(text, '') AS text, CAST(len(lines) AS BIGINT) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM p LEFT JOIN k ON p.r = k.r
"""}
