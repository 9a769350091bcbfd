"""Line dedup by site-relative frequency, with DataFrame functions only.

A line is boilerplate of a host if more than ``max_ratio`` of the host's pages, and ``min_pages`` at least, hold it.
Every page counts a line once. Lines are counted by a 64-bit hash of their trimmed text, so that the shuffle carries
no text, and are pre-aggregated before it, so that a host or a line with a third of all rows is no hot spot. The
boilerplate of one host is bounded (the mean number of lines of its pages over ``max_ratio``); the hosts' lists are
broadcast if their measured size is within ``broadcast_mb``. Otherwise pages and lists meet in a join by host that stands alone
between written tables, so that Spark splits the pages of a frequent host over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.support import free_name, materialize


def url_host(url: str | Column) -> Column:
    """Host of a URL in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def html_lines(html: str | Column) -> Column:
    """Text of a page, a line for each run between tags or line feeds."""
    return F.regexp_replace(html, r"[ \t\r\n]*(?:<[^>]*>|\n)[ \t\r\n]*", "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _filled(lines: Column) -> Column:
    return F.filter(lines, lambda x: F.trim(x) != "")


def boilerplate(pages: DataFrame, host: str, text: str, max_ratio: float, min_pages: int) -> DataFrame:
    """(host, lines): hashes of each host's boilerplate lines. Rows without a host or a text have none."""
    rows = pages.select(F.col(host).alias("host"), F.array_distinct(F.transform(_filled(F.split(text, "\n", -1)), _key)).alias("keys")).where(F.coalesce(F.col("host"), F.lit("")) != "")
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    counts = rows.select("host", F.explode("keys").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return counts.join(totals, "host").where(F.col("n") > F.lit(max_ratio) * F.col("pages")).groupBy("host").agg(F.array_sort(F.collect_list("line")).alias("lines"))


def drop_lines(pages: DataFrame, host: str, text: str, max_ratio: float = 0.1, min_pages: int = 2, out: str | None = None, broadcast_mb: int = 16) -> DataFrame:
    """All rows of ``pages`` with the boilerplate lines taken out of ``text`` (or of a copy named ``out``), and
    n_lines and n_dropped, which count lines that aren't blank.

    Blank lines stay. Null text stays null with zero lines; a row with a null or empty host keeps all its lines.
    Repeated rows count as pages of their own; a page of any length is taken whole. An empty table gives no rows. Taken names get leading underscores.
    """
    n_lines, n_dropped, site, drop = free_name(pages, "n_lines", "n_dropped", "site", "drop")
    found = materialize(boilerplate(pages, host, text, max_ratio, min_pages), "boilerplate")
    size = found.agg(F.sum(F.size("lines") * 8 + F.length("host") + 40)).first()[0] or 0
    found = found.select(F.col("host").alias(site), F.col("lines").alias(drop))
    joined = pages.join(F.broadcast(found) if size <= broadcast_mb << 20 else found, F.col(host) == F.col(site), "left")
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(drop), _key(x)))
    fresh = F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    before = F.coalesce(F.size(_filled(lines)), F.lit(0))
    after = F.when(F.col(drop).isNull(), before).otherwise(F.coalesce(F.size(_filled(kept)), F.lit(0)))
    count = F.when(F.col(text).isNull(), F.lit(0))
    place = [F.col(c) if c != text or out else fresh.alias(text) for c in pages.columns]
    extra = [fresh.alias(out)] if out else []
    return joined.select(*place, *extra, count.otherwise(before).cast("long").alias(n_lines), count.otherwise(before - after).cast("long").alias(n_dropped))
