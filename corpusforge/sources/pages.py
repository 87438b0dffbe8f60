"""Page files as a source and a sink, and HTML pages as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.sources.folders import exported, found_texts

#: Pages that list others.
LISTS = ("index", "log")


def write_pages(pages: DataFrame, folder: str) -> int:
    """One file for each page, ``section/stem.md``, with a line end behind it; gives the number of files."""
    path = F.concat("section", F.lit("/"), "stem", F.lit(".md"))
    return exported(pages.select(path.alias("path"), F.concat(F.coalesce("page_text", F.lit("")), F.lit("\n")).alias("content")), folder).count()


def scan_pages(spark: SparkSession, folder: str, pattern: str = "*.md", skipped: tuple[str, ...] = LISTS) -> DataFrame:
    """(path, section, stem, modified, page_text) of all page files below a folder but lists of pages."""
    rows = found_texts(spark, folder, pattern).select(
        "path", F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("section"), F.regexp_extract("path", "([^/]*)\\.[^./]*$", 1).alias("stem"),
        "modified", F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\\n\\z", "").alias("page_text"),
    )
    return rows.where(~F.col("stem").isin(*skipped))


def html_pages(pages: DataFrame) -> DataFrame:
    """HTML pages with what they say of themselves."""
    return pages.select(
        "page_id", "url", F.regexp_extract("url", "^[^:]+://([^/?#]*)", 1).alias("host"), F.regexp_extract("html", '(?i)<html[^>]* lang="([^"]*)"', 1).alias("lang"),
        F.size(F.regexp_extract_all("html", F.lit("(?i)<a\\s"), F.lit(0))).alias("n_links"), F.length("html").alias("chars"), "html",
    )
