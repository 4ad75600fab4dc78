"""Line deduplication by site-relative frequency, in DataFrame operations alone.

For each host, the pages that contain a line are divided by the host's pages; lines above a ratio are boilerplate and
are dropped from the host's pages. Boilerplate repeats: a line that is on one page of the host only is never dropped,
whatever the ratio (`least_pages`, 2). A page's own repeats of a line count once. A host has at most (lines of a mean
page) / ratio such lines, so they travel as one array a host, copied once for each salt of a hot host's pages.

Rows: a null text has no lines and stays null; a null host is a host of its own. Rows of one host with one page_id are
one page, with the lines of all of them; a row without a page_id is a page of its own. Each row gives a row. A line at
exactly the ratio stays. Lines without text are never boilerplate. An empty table gives an empty table. Extra columns
are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO, LEAST_PAGES, SALTS = 0.1, 2, 16
#: Tags that part lines.
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST_PATTERN, 1))


def lines_of_html(html: Column) -> Column:
    """Visible text of a page, one line for each block."""
    text = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "\n")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLOCKS})(?:[ \t\r\n/][^>]*)?>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    return F.btrim(F.regexp_replace(text, r"[ \t\r]*\n[ \t\r\n]*", "\n"), F.lit(" \t\r\n"))


def drop_boilerplate(df: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, salts: int = SALTS, id_col: str = "page_id", host_col: str = "host", text_col: str = "text") -> DataFrame:
    """(page_id, host, n_lines, n_kept, text) with the host's boilerplate lines taken out."""
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(host_col).cast("string").alias("host"), F.split(F.col(text_col).cast("string"), "\n").alias("lines"))
    site = F.coalesce(F.concat(F.lit("="), "host"), F.lit("")).alias("site")  # null is a host too
    pages = pages.select("*", site)
    lines = F.explode(F.filter(F.array_distinct("lines"), lambda x: x != "")).alias("line")
    again = pages.filter("page_id is not null").groupBy("site", "page_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    line, page = pages.select("site", lines), pages.select("site")
    if not again.isEmpty():
        once = pages.join(again, ["site", "page_id"], "left_anti")
        several = pages.join(again, ["site", "page_id"], "left_semi")
        line = once.select("site", lines).unionByName(several.select("site", "page_id", lines).distinct().drop("page_id"))
        page = once.select("site").unionByName(again.select("site"))
    often = line.groupBy("site", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_pages)
    totals = page.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    common = often.join(totals, "site").filter(F.col("n") > ratio * F.col("pages")).groupBy("site").agg(F.collect_list("line").alias("common"))
    common = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = pages.select("*", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int").alias("salt"))
    kept = F.when(F.col("common").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("common", x)))
    return salted.join(common, ["site", "salt"], "left").select(
        "page_id", "host", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(kept), F.lit(0)).cast("long").alias("n_kept"), F.array_join(kept, "\n").alias("text")
    )
