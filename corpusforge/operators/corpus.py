"""Page health, link graph, snapshots, cache tables and candidate selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINK = "\\[\\[([^\\]|#]+)(?:[|#][^\\]]+)?\\]\\]"
REQUIRED = ("created", "tags", "type")
FATAL = ("script_placeholder", "login_required", "captcha_detected", "title_missing")
NEGATIVE, POSITIVE = ("comment", "user", "recommend"), ("article", "content", "post")


def frontmatter(page: Column) -> Column:
    """The block between two lines of dashes at the page's head, or null."""
    block = F.regexp_extract(page, "^---\\n((?s).*?)\\n---(?:\\n|$)", 1)
    return F.when(block != "", block)


def body(page: Column) -> Column:
    """The page behind its block."""
    return F.regexp_replace(page, "^---\\n(?s:.*?)\\n---(?:\\n|$)", "")


def tags(page: Column) -> Column:
    """The block's tags, separated by blanks; empty without any."""
    return F.coalesce(F.regexp_replace(F.regexp_extract(frontmatter(page), "(?m)^tags: \\[(.*)\\]$", 1), ",", " "), F.lit(""))


def frontmatter_issue(page: Column) -> Column:
    """missing, malformed, the missing keys in order, or null."""
    block = F.concat(F.lit("\n"), frontmatter(page))
    lacks = F.array_compact(F.array(*[F.when(~block.contains(f"\n{k}:"), F.lit(k)) for k in REQUIRED]))
    return (
        F.when(~page.startswith("---"), F.lit("MISSING frontmatter")).when(block.isNull(), F.lit("MALFORMED frontmatter"))
        .when(F.size(lacks) > 0, F.concat(F.lit("missing: "), F.array_join(lacks, ", ")))
    )


def title(page: Column) -> Column:
    """The first top heading, else a fixed text."""
    found = F.regexp_extract(page, "(?m)^# (.*)$", 1)
    return F.when(found == "", F.lit("[no-title]")).otherwise(F.trim(found))


def edges(pages: DataFrame) -> DataFrame:
    """(src, dst): every link of every page, inline code left out."""
    clean = F.regexp_replace("page_text", "`[^`]*`", "")
    return pages.select(F.col("stem").alias("src"), F.explode(F.regexp_extract_all(clean, F.lit(LINK), F.lit(1))).alias("dst"))


def broken_links(pages: DataFrame) -> DataFrame:
    """Links to no page; targets with a slash are exempt."""
    return edges(pages).where(~F.col("dst").contains("/")).join(pages.select(F.col("stem").alias("dst")), "dst", "left_anti").select("src", "dst")


def orphans(pages: DataFrame) -> DataFrame:
    """Pages that no other page links to."""
    inbound = edges(pages).where("src <> dst").select(F.col("dst").alias("stem"))
    return pages.join(inbound, "stem", "left_anti").select("stem")


def degrees(pages: DataFrame) -> DataFrame:
    """(stem, links_out, links_in) of every page."""
    links = edges(pages)
    out = links.groupBy(F.col("src").alias("stem")).agg(F.count("*").alias("links_out"))
    into = links.groupBy(F.col("dst").alias("stem")).agg(F.count("*").alias("links_in"))
    return pages.select("stem").join(out, "stem", "left").join(into, "stem", "left").fillna(0, ["links_out", "links_in"])


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, mtime: str) -> DataFrame:
    """new, modified or deleted, for each key that differs."""
    a, b = old.select(key, F.col(mtime).alias("was")), new.select(key, F.col(mtime).alias("now"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "modified")
    return a.join(b, key, "full_outer").withColumn("change", change).where("change IS NOT NULL").select(key, "change")


def latest(entries: DataFrame) -> DataFrame:
    """The newest entry of each (namespace, cache_key)."""
    return entries.groupBy("namespace", "cache_key").agg(F.max_by(F.struct("payload", "created", "expires"), F.struct("created", "event_id")).alias("e")).select("namespace", "cache_key", "e.*")


def negative_path(path: Column) -> Column:
    """Names a comment, user or recommendation field, and no article field."""
    low = F.lower(path)
    some = lambda words: F.greatest(*[low.contains(w) for w in words])
    return some(NEGATIVE) & ~some(POSITIVE)


def best_candidate(candidates: DataFrame, min_length: int = 100) -> DataFrame:
    """One candidate of each page: complete ones first, then no negative path, then by their scores."""
    usable = candidates.where((F.col("content_length") >= min_length) & ~F.col("issue").isin(*FATAL))
    first = F.when(F.col("quality_complete"), F.col("ranking_score")).otherwise(F.col("quality_score"))
    second = F.when(F.col("quality_complete"), F.col("quality_score")).otherwise(F.col("ranking_score"))
    order = Window.partitionBy("page_id").orderBy(F.desc("quality_complete"), negative_path(F.col("json_path")), first.desc(), second.desc(), "method")
    return usable.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def issn_valid(issn: Column) -> Column:
    """Check digit modulo 11, X for ten; eight characters of digits and X."""
    digits = F.regexp_replace(F.upper(issn), "[^0-9X]", "")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(7)), F.lit(0), lambda acc, i: acc + (9 - i) * F.coalesce(F.substring(digits, i, F.lit(1)).try_cast("int"), F.lit(0)))
    check = (11 - total % 11) % 11
    return (F.length(digits) == 8) & digits.rlike("^[0-9]{7}") & (F.substring(digits, 8, 1) == F.when(check == 10, "X").otherwise(check.cast("string")))


def verdict(seen_cap: int = 200) -> Column:
    """The first rule that a captured response fails, or accepted; ``position`` numbers a page's responses."""
    kind = F.lower(F.trim(F.split("content_type", ";")[0]))
    return (
        F.when(F.col("position") > seen_cap, "over_cap").when(F.col("status") != 200, "bad_status").when(F.col("method") == "OPTIONS", "preflight")
        .when(~(kind.contains("json") | kind.contains("html") | (kind == "text/plain")), "bad_type").when(F.col("declared_size") > 524288, "too_large").otherwise("accepted")
    )
