"""Boilerplate lines, by how many of a site's pages hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culprit.llm.shared import BROADCAST_ROWS, settled

# A line is boilerplate where more than this part of the site's pages hold it.
RATIO = 0.05

SPACES = " \t\n\u000b\f\r"

# Markup at which a page's text breaks into lines, and markup without text.
UNSEEN = r"(?is)<(?:script[^>]*>.*?</script>|style[^>]*>.*?</style>|!--.*?-->)"
BREAK = r"(?i)</?(p|br|div|li|ul|ol|h[1-6]|tr|table|nav|article|footer|header|section|title|head|body|html)([\x20\x09-\x0D][^>]*)?/?>"
TAG = r"<[^>]*>"


def page_text(html: Column) -> Column:
    """The visible text of a page, a line for each block of markup."""
    seen = F.regexp_replace(html, UNSEEN, "")
    return F.regexp_replace(F.regexp_replace(seen, BREAK, "\n"), TAG, "")


def url_host(url: Column) -> Column:
    """The host of a url in lower case; null if it has none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)
    return F.when(host != "", F.lower(host))


def told_lines(body: Column) -> Column:
    """Each line of a text with the digest of its trimmed form; blank lines have none."""
    return F.transform(
        F.split(body, "\n"),
        lambda line: F.struct(
            line.alias("line"),
            F.when(F.btrim(line, F.lit(SPACES)) != "", F.unhex(F.sha2(F.btrim(line, F.lit(SPACES)), 256))).alias("digest"),
        ),
    )


def line_counts(pages: DataFrame, least_pages: int = 1) -> DataFrame:
    """(site, digest, pages, site_pages) for each line that `least_pages` of a site hold.

    `pages` has site and body.  A line counts once per page.  Sums are taken before the
    shuffle, so neither a site nor a line that has most rows meets in one task.
    """
    lines = F.array_distinct(F.transform(told_lines(F.col("body")), lambda x: x["digest"]))
    counted = (
        pages.select("site", F.explode(lines).alias("digest"))
        .where("digest is not null")
        .groupBy("site", "digest")
        .agg(F.count("*").alias("pages"))
    )
    totals = settled(pages.groupBy("site").agg(F.count("*").alias("site_pages")))
    held = counted.where(F.col("pages") >= least_pages)
    return held.join(totals, held["site"].eqNullSafe(totals["site"])).select(
        held["site"], "digest", "pages", "site_pages"
    )


def line_dedup(
    df: DataFrame,
    site: Column,
    text: Column,
    into: str = "text",
    ratio: float = RATIO,
    least_pages: int = 1,
) -> DataFrame:
    """The rows of `df` with `into` (the text without boilerplate), n_lines, n_dropped.

    Lines are the \\n-separated parts that hold more than white space, compared without
    white space at their ends.  A line is dropped from all pages of a site when more than
    `ratio` of the site's pages hold it, whatever the size of the site: one of fewer than
    1 / `ratio` pages has no other lines and keeps none.  `least_pages` spares lines that
    fewer pages hold, for those who have such sites and want them.  Rows are pages, repeated
    ones too.  What stays, blank lines included, keeps its order.

    A site has at most (lines per page / ratio) such lines, however large it is, so they
    come to its pages as one set.  A null site is a site of its own.  A null text stays
    null and has no lines; an empty table gives an empty result.  Columns named like the
    new ones are replaced; names that begin with an underscore are the operator's own.
    """
    pages = df.select(site.alias("site"), text.alias("body"))
    common = settled(
        line_counts(pages, least_pages)
        .where(F.col("pages") > F.lit(float(ratio)) * F.col("site_pages"))
        .select(F.coalesce(F.concat(F.lit("s"), F.col("site")), F.lit("")).alias("_site"), "digest")
    )
    sets = common.groupBy("_site").agg(F.collect_set("digest").alias("_common"))
    if common.count() <= BROADCAST_ROWS:
        sets = F.broadcast(sets)
    added = (into, "n_lines", "n_dropped")
    rows = df.select(
        *(c for c in df.columns if c not in added),
        F.coalesce(F.concat(F.lit("s"), site), F.lit("")).alias("_site"),
        told_lines(text).alias("_lines"),
    ).join(sets, "_site", "left")
    kept = F.filter(
        "_lines",
        lambda x: x["digest"].isNull() | ~F.array_contains(F.col("_common"), x["digest"]),
    )
    lines = F.size(F.filter("_lines", lambda x: x["digest"].isNotNull()))
    return (
        rows.withColumn("_kept", F.when(F.col("_common").isNull(), F.col("_lines")).otherwise(kept))
        .withColumns(
            {
                into: F.array_join("_kept.line", "\n"),
                "n_lines": F.when(F.col("_lines").isNull(), 0).otherwise(lines).cast("long"),
                "n_dropped": F.coalesce(F.size("_lines") - F.size("_kept"), F.lit(0)).cast("long"),
            }
        )
        .select(*(c for c in df.columns if c not in added), *added)
    )
