"""Tables of links, images and videos of pages, and the frontier of pages to visit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions import urls as U
from corpusforge.session import checkpointed


def tags(pages: DataFrame, html_col: str, name: str) -> DataFrame:
    """One row for each tag of a kind, with its place among them from 1."""
    found = F.regexp_extract_all(html_col, F.lit(f"(?i)<{name}\\s[^>]*>"), F.lit(0))
    return pages.select("*", F.posexplode(found).alias("pos", "tag")).withColumn("pos", F.col("pos") + 1)


def page_links(pages: DataFrame) -> DataFrame:
    """Every anchor of every page with its absolute address."""
    links = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return links.select("page_id", "url", (F.col("pos") + 1).alias("pos"), U.resolved(F.col("url"), F.col("href")).alias("target"))


def distinct_links(links: DataFrame) -> DataFrame:
    """The first place of each address on a page, fragments left out, without links to the page itself."""
    bare = links.withColumn("target", F.regexp_replace("target", "#.*$", ""))
    return bare.where(F.col("target") != F.regexp_replace("url", "#.*$", "")).groupBy("page_id", "target").agg(F.min("pos").alias("pos"))


def judged_links(links: DataFrame) -> DataFrame:
    """Links with the reason to skip them and the rule that makes them urgent (null for none)."""
    return links.withColumns({"skip": U.skip_reason(F.col("url")), "priority": U.priority_rule(F.col("url"))})


def first_priority(links: DataFrame, most: int = 5) -> DataFrame:
    """The first urgent links of each page that aren't skipped, by their place."""
    order = Window.partitionBy("page_id").orderBy("pos")
    return judged_links(links).where("skip IS NULL AND priority IS NOT NULL").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)


def images(pages: DataFrame) -> DataFrame:
    """Every image tag with its best address (empty for none) and whether it only decorates or tracks."""
    found = tags(pages, "media", "img").withColumn("src", U.best_image(F.col("tag"), F.col("url")))
    return found.withColumn("decorative", (F.col("src") != "") & U.decorative_image(F.col("tag"), F.col("src")))


def image_table(pages: DataFrame) -> DataFrame:
    """Images of tags and of style rules."""
    shown = images(pages).where("src <> '' AND NOT decorative").select("page_id", "src", F.lit("img").alias("origin"))
    rules = F.regexp_extract_all("media", F.lit("(?i)background(?:-image)?\\s*:\\s*url\\(([^)]*)\\)"), F.lit(1))
    backs = pages.select("page_id", "url", F.explode(rules).alias("back"))
    return shown.union(backs.select("page_id", U.resolved(F.col("url"), F.col("back")), F.lit("css")))


def video_table(pages: DataFrame) -> DataFrame:
    """Distinct video addresses of a page: video files and known players, from five kinds of tags."""
    kinds = (("video", "src"), ("source", "src"), ("iframe", "src"), ("embed", "src"), ("a", "href"))
    found = F.flatten(F.array(*[F.regexp_extract_all("media", F.lit(f'(?i)<{t}\\s[^>]*{a}="([^"]*)"'), F.lit(1)) for t, a in kinds]))
    targets = pages.select("page_id", "url", F.explode(found).alias("src")).select("page_id", U.resolved(F.col("url"), F.col("src")).alias("target"))
    return targets.withColumn("kind", U.video_kind(F.col("target"))).where("kind IS NOT NULL").distinct()


def frontier(seeds: DataFrame, edges: DataFrame, depth: int, most: int = 5) -> DataFrame:
    """Pages (stem) reachable from the seeds in at most ``depth`` steps over (src, dst), with their least distance.

    A page passes on to the first ``most`` of its links by target. Each level is one join and one anti join
    with the pages seen before; levels are cut with a checkpoint in the shared folder.
    """
    order = Window.partitionBy("src").orderBy("dst")
    followed = checkpointed(edges.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n"))
    level = seen = checkpointed(seeds.distinct().select("stem", F.lit(0).alias("depth")))
    for step in range(1, depth + 1):
        reached = followed.join(level, followed.src == level.stem, "left_semi").select(F.col("dst").alias("stem")).distinct()
        level = checkpointed(reached.join(seen, "stem", "left_anti").select("stem", F.lit(step).alias("depth")))
        seen = seen.union(level)
    return seen
