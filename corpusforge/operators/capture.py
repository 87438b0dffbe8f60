"""Page contents, reader output, Markdown images, and candidates harvested from JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.reading import noise
from corpusforge.functions.text import with_value
from corpusforge.session import ship

# Lines of a reader's output that aren't content, and the heading of a section that isn't.
READER_LINES = ("Don't miss what's happening", "People on X are the first to know.", "See new posts", "Sign up with Apple", "Create account", "Appearance settings", "Toggle navigation")
READER_LINK = "\\]\\(https://x\\.com/(login|i/flow/signup|tos|privacy)"
READER_SECTION = "(?m)(^|\\n)[ \\t]*(## )?New to X\\?[ \\t]*$(\\n[ \\t]*([^#\\s].*)?$|\\n[ \\t]*#.*[Nn]ew to [Xx].*$)*"
EDGE = "^\\s+|\\s+$"

# Tags whose regions aren't content.
NOISE_TAGS = ("script", "style", "noscript", "iframe", "object", "embed", "nav", "footer", "aside")
REGIONS = ("article", "main", "body")

# Field names that point to content, path words that speak for and against.
CONTENT_FIELDS = {
    "content": 5.0, "article": 5.0, "articlebody": 5.0, "body": 5.0, "post": 5.0, "story": 5.0, "html": 4.0, "richtext": 4.0, "richtextbody": 4.0, "markdown": 4.0,
    "article_body": 2.0, "text": 2.0, "description": 2.0, "detail": 2.0, "rich_text": 2.0, "summary": 2.0, "abstract": 2.0, "intro": 2.0, "introduction": 2.0, "message": 2.0, "msg": 2.0, "commenttext": 2.0,
}
POSITIVE_PATH = ("article", "post", "story", "detail", "content", "body", "document", "news", "page", "topic", "thread")
NEGATIVE_PATH = (
    "comment", "comments", "reply", "replies", "user", "author", "profile", "tag", "tags", "category", "categories", "recommend", "recommendation", "related", "advertisement", "ad", "ads", "sponsor",
    "analytics", "stat", "tracking", "config", "setting", "settings", "navigation", "nav", "menu", "footer", "header", "sidebar", "notification", "alert", "banner",
)
DETAIL_PATH = ("detail", "article", "post", "story", "content")
BLOCK_FIELDS = ("text", "content", "value")


def reader_title(raw: Column, fallback: Column) -> Column:
    """What stands behind ``Title:`` in one of the first 20 lines, else the fallback."""
    line = F.get(F.filter(F.slice(F.split(raw, "\n"), 1, 20), lambda x: x.startswith("Title:")), F.lit(0))
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(line, 7, 1_000_000), EDGE, ""), F.lit("")), fallback)


def reader_text(raw: Column) -> Column:
    """The content of a reader's output: no head, no sections or lines of the site around it, at most two blank lines."""
    marker = "Markdown Content:"
    at = F.locate(marker, raw)
    body = F.when(at > 0, F.regexp_replace(F.substring(raw, at + len(marker), F.length(raw)), EDGE, "")).otherwise(raw)
    kept = F.filter(
        F.split(F.regexp_replace(body, READER_SECTION, ""), "\n", -1),
        lambda x: ~F.trim(x).isin(*READER_LINES) & ~x.rlike(READER_LINK) & ~F.lower(F.trim(x)).startswith("by signing up, you agree"),
    )
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), "\\n{4,}", "\n\n\n"), EDGE, "")


def absolute_images(text: Column, base: str) -> Column:
    """Relative targets of Markdown images, made absolute."""
    return F.regexp_replace(text, "!\\[([^\\]]*)\\]\\((?!http://|https://|data:)[./]*([^)\\s]+)\\)", f"![$1]({base}$2)")


def markdown_images(pages: DataFrame, text_col: str, key: str) -> DataFrame:
    """(key, url, alt) of the absolute images of each text; of repeated ones the first."""
    pattern = "!\\[([^\\]]*)\\]\\(((?:https?:)?//[^)]+)\\)"
    found = lambda g: F.regexp_extract_all(text_col, F.lit(pattern), F.lit(g))
    each = pages.select(key, F.posexplode(F.arrays_zip(found(1).alias("alt"), found(2).alias("url"))).alias("n", "i")).select(key, "n", "i.*")
    return each.groupBy(key, "url").agg(F.min_by(F.trim("alt"), "n").alias("alt"))


def tagless(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), "&[a-zA-Z]+;|&#[0-9]+;", " "), "[ \\t\\n\\r\\f\\x0B]+", " ")


def main_content(html: Column, host: Column) -> Column:
    """(title, region, text) of a page: without noise, the first region with more than 100 characters, else the body."""
    title = F.coalesce(*[F.nullif(F.regexp_replace(tagless(F.regexp_extract(html, f"(?is)<{t}[^>]*>(.*?)</{t}>", 1)), EDGE, ""), F.lit("")) for t in ("title", "h1")], host)
    clean = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    for tag in NOISE_TAGS:
        clean = F.regexp_replace(clean, f"(?is)<{tag}(\\s[^>]*)?>.*?</{tag}>", " ")

    def pick(c: Column) -> Column:
        texts = F.array(*[F.struct(F.lit(r).alias("region"), F.regexp_replace(tagless(F.regexp_extract(c, f"(?is)<{r}(\\s[^>]*)?>(.*)</{r}>", 2)), EDGE, "").alias("text")) for r in REGIONS])
        return with_value(texts, lambda t: F.coalesce(F.get(F.filter(t, lambda x: F.length(x["text"]) > 100), F.lit(0)), F.element_at(t, -1)))

    return with_value(F.struct(title.alias("title"), with_value(clean, pick).alias("found")), lambda p: F.struct(p["title"], p["found"]["region"], p["found"]["text"]))


def with_html_function(pages: DataFrame, extract: Callable[[str], dict], schema: str) -> DataFrame:
    """Pages with what a user's function makes of their ``html``, in batches on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.concat([rows.reset_index(drop=True), pd.DataFrame([extract(h or "") for h in rows["html"]])], axis=1)

    return pages.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema) + ", " + schema)


def _strings(value: object, depth: int, nodes: int, strings: int, least: int) -> Iterator[tuple[str, str, str]]:
    """(path, field, content) of a JSON value's long strings in document order, within the budgets."""
    ahead: list[tuple[object, str, str, int]] = [(value, "$", "", 1)]
    seen = texts = 0
    while ahead and seen < nodes:
        at, path, field, level = ahead.pop()
        seen += 1
        if level > depth:
            continue
        if isinstance(at, str):
            texts += 1
            if texts > strings:
                return
            if len(own := at.strip()) >= least:
                yield path, field, own
        elif isinstance(at, dict):
            ahead += [(v, f"{path}.{k}", k, level + 1) for k, v in reversed(at.items())]
        elif isinstance(at, list):
            ahead += [(v, f"{path}[{i}]", str(i), level + 1) for i, v in zip(range(len(at) - 1, -1, -1), reversed(at), strict=True)]


def harvested(rows: DataFrame, key: str, json_col: str, depth: int = 12, nodes: int = 50_000, strings: int = 2_000, least: int = 200) -> DataFrame:
    """(key, path, field, content) of the long strings of JSON texts, trimmed, without those that look like noise.

    The budgets are part of the rule, for each text in document order: the root is the first node and the first level; nodes below
    ``depth`` levels count but aren't looked into; it ends with the ``nodes``-th node or the ``strings``-th string, short ones counted.
    The field is the last step of the path, in an array the place. Texts that aren't JSON give nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("path", "field", "content")
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                try:
                    found = list(_strings(json.loads(text.as_py()), depth, nodes, strings, least)) if text.is_valid else []
                except (ValueError, RecursionError):
                    continue
                if found:
                    parts = [pa.array(c, pa.string()) for c in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array([i] * len(found))), *parts], names=[key, *names])

    ship(rows.sparkSession)
    asked = rows.select(key, F.col(json_col).alias("text"))
    found = asked.mapInArrow(run, f"`{key}` {asked.schema[key].dataType.simpleString()}, path string, field string, content string")
    return found.where(~noise(F.col("content")))


def merged_blocks(blocks: Column) -> Column:
    """The texts of an array of block objects as one text, null unless there are 2 to 200 blocks with 2 texts and 200 characters."""
    texts = F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: F.length(F.trim(t)) >= 10)
    joined = F.array_join(texts, "\n\n")
    return F.when(F.size(blocks).between(2, 200) & (F.size(texts) >= 2) & (F.length(F.trim(joined)) >= 200), joined)


def field_bonus(name: Column) -> Column:
    """0 to 5 points for a field's name."""
    out = F.lit(0.0)
    for points in (2.0, 4.0, 5.0):
        out = F.when(F.lower(name).isin(*[n for n, p in CONTENT_FIELDS.items() if p == points]), points).otherwise(out)
    return out


def source_kind(hint: Column, content_type: Column, field: Column) -> Column:
    json = F.when(F.lower(field).contains("html"), "json_html").otherwise("json_string")
    kind = F.lower(content_type)
    return (
        F.when(hint == "merged_blocks", "json_block_array").when(hint.isin("html_document", "plain_text"), hint).when(kind.contains("json"), json)
        .when(kind.contains("html"), "html_document").otherwise("plain_text")
    )


def ranking_score(quality: Column, hint: Column, path: Column, content: Column, title: Column, kind: Column) -> Column:
    """0 to 120: quality, name and path of the field, and how many characters the title shares with the content's beginning."""
    low = F.lower(F.coalesce(path, F.lit("")))
    some = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    letters = lambda t: F.array_distinct(F.split(F.regexp_replace(F.lower(t), "\\s+", ""), ""))
    shared = F.size(F.array_remove(F.array_intersect(letters(title), letters(F.substring(content, 1, 1000))), ""))
    points = (
        quality.cast("double") + field_bonus(hint) + F.when(some(POSITIVE_PATH), 2.0).otherwise(0.0) - F.when(some(NEGATIVE_PATH), 3.0).otherwise(0.0)
        + F.when((F.length(title) > 2) & (shared > 5), F.least(F.lit(5.0), shared * 0.3)).otherwise(0.0) + F.when(kind.isin("json_string", "json_html") & some(DETAIL_PATH), 3.0).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(120.0), points))


def normal_content(text: Column) -> Column:
    """The form of a candidate that tells equal ones: line ends, blanks and blank lines made alike."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\\r\\n|\\r", "\n"), "[ \\t]+", " "), "\\n{3,}", "\n\n"))
