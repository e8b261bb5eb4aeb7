"""What listing pages and crawled pages give, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def title(html: Column | str) -> Column:
    return F.regexp_extract(_c(html), "<title>([^<]*)", 1)


def links(html: Column | str) -> Column:
    """Targets of the page's anchors, in order."""
    return F.regexp_extract_all(_c(html), F.lit('<a href="([^"]*)"'), F.lit(1))


def listed_acts(pages: DataFrame, html: str, kind: str) -> DataFrame:
    """Addresses of acts on listing pages: links of the type that end in contents, without that segment."""
    found = pages.select("*", F.explode(links(html)).alias("link"))
    good = F.col("link").startswith(f"/{kind}") & F.col("link").rlike("/contents(/made)?$")
    return found.where(good).withColumn("link", F.regexp_replace("link", "/contents(/made)?$", ""))


def listed_cases(pages: DataFrame, html: str) -> DataFrame:
    """Addresses of judgments in a results table, without their query strings."""
    table = F.regexp_extract(F.col(html), r'(?s)class="judgments-table".*?<table.*?</tr>(.*?)</table>', 1)
    return pages.select("*", F.explode(links(table)).alias("link")).withColumn("link", F.get(F.split("link", r"\?"), F.lit(0)))


def feed_entries(feeds: DataFrame, xml: str, types: Sequence[str]) -> DataFrame:
    """``link, type, more`` of the entries of a feed's pages whose type is asked for; ``more`` counts the pages that follow."""
    ids = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<entry\b.*?<id>\s*(.*?)\s*</id>"), F.lit(1))
    more = F.regexp_extract(F.col(xml), r"<(?:\w+:)?morePages>\s*(\d+)", 1)
    found = feeds.select(F.explode(ids).alias("id"), F.when(more != "", more.cast("int")).otherwise(0).alias("more"))
    kind = F.get(F.split("id", "/"), F.lit(4))
    return found.select(F.concat(F.replace("id", F.lit("/id/"), F.lit("/")), F.lit("/data.xml")).alias("link"), kind.alias("type"), "more").where(F.col("type").isin(list(types)))


def next_page(html: Column | str) -> Column:
    found = F.regexp_extract(_c(html), r'(?i)<a[^>]*href="([^"]*)"[^>]*>\s*next(?: page)?\s*</a>', 1)
    return F.when(found != "", found)


def pdf_link(found: Column) -> Column:
    """The first English PDF, else the first PDF, with the site before a relative one."""
    english, every = (F.get(F.filter(found, f), F.lit(0)) for f in (lambda x: x.endswith("_en.pdf"), lambda x: x.endswith(".pdf")))
    chosen = F.coalesce(english, every)
    return F.when(chosen.startswith("http"), chosen).otherwise(F.concat(F.lit("https://www.legislation.gov.uk"), chosen))
