"""Titles, snippets and noise of page texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = "[ \\t\\n\\x0B\\f\\r]"
EDGES = f"^{SPACES}+|{SPACES}+$"
#: What a short string that carries no text looks like.
NOISE = ("(?i)^(?:[\\[{]|null|true|false|undefined|nan)$", "^https?://[^ \\t\\n\\x0B\\f\\r]+$", "^[a-f0-9]{32,}$")
#: Marks of log lines.
LOG_MARKS = "ERROR|WARN|DEBUG|INFO|TRACE"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def title(page_text: Column, stem: Column, lines: int = 20) -> Column:
    """The first ``title:`` line or heading among the first lines, else the stem. A null text has no lines."""
    first = F.get(F.filter(F.slice(F.split(page_text, "\n"), 1, lines), lambda x: x.startswith("title:") | x.startswith("# ")), F.lit(0))
    named = F.when(F.contains(first, F.lit(":")), F.regexp_replace(first, "^[^:]*:", "")).otherwise(F.regexp_replace(first, "^[# ]+", ""))
    return F.coalesce(trimmed(named), stem)


def snippet(body: Column, terms: tuple[str, ...], most: int = 200) -> Column:
    """The paragraph with the most hits of the (lower-case) terms, the first of equals, cut after ``most`` characters."""
    paragraphs = F.filter(F.transform(F.split(body, f"\\n{SPACES}*\\n"), trimmed), lambda p: p != "")

    def hits(p: Column) -> Column:
        low = F.lower(p)
        return sum((F.length(low) - F.length(F.replace(low, F.lit(t)))) / F.lit(len(t)) for t in terms).cast("int")

    ranked = F.transform(paragraphs, lambda p, i: F.struct(hits(p).alias("hits"), (-i).alias("before"), p.alias("text")))
    best = F.array_max(ranked)["text"]
    return F.when(F.length(best) > most, F.concat(F.left(best, F.lit(most)), F.lit("…"))).otherwise(F.coalesce(best, F.left(body, F.lit(most))))


def noise(text: Column) -> Column:
    """Empty, a short string without text, or over three tenths log lines. Null counts as empty."""
    own = trimmed(F.coalesce(text, F.lit("")))
    short = F.lit(False)
    for pattern in NOISE:
        short = short | own.rlike(pattern)
    lines = F.split(own, "\n")
    logged = F.size(F.filter(lines, lambda x: x.rlike(LOG_MARKS)))
    return (own == "") | ((F.length(own) < 50) & short) | ((F.size(lines) > 4) & (10 * logged > 3 * F.size(lines)))
