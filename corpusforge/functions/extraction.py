"""The gate for texts extracted from files, and how files of a repository are read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge.functions.reading import SPACES

#: Fixed values by type: least characters without spaces, least paragraphs, least share of visible text in tenths.
LIMITS = {".xlsx": (10, 0, 1), ".xls": (10, 0, 1), ".pptx": (30, 0, 3), "": (50, 1, 3)}
TABLES = (".xlsx", ".xls")
#: Marks of a failed conversion.
ERROR_MARKS = (
    "enable javascript", "javascript is not available", "this browser is no longer supported", "something went wrong", "please enable cookies",
    "access denied", "checking your browser", "just a moment", "performing security verification", "requiring captcha", "verify you are human",
    "log in to", "sign up now", "[unable to render", "conversion failed",
)
TABLE_WORDS = "(?i)sheet[ \\t\\n\\x0B\\f\\r]*[0-9]|工作表[0-9]|字段|field|column|row[ \\t\\n\\x0B\\f\\r]*[0-9]|table|表格"
HEADING = f"^#{{1,6}}{SPACES}+[^\\n]*$"
LINKED = f"https?://[^ \\t\\n\\x0B\\f\\r]+|!?\\[[^\\]]*\\]\\([^)]*\\)"
#: Files of a repository that are read first, and endings of those that can be read.
FIRST_FILES = (
    "README.md", "readme.md", "Readme.md", "SKILL.md", "skill.md", "AGENTS.md", "agents.md", "CLAUDE.md", "claude.md", "COMMANDS.md", "commands.md",
    "package.json", "pyproject.toml", "requirements.txt", "Cargo.toml", "go.mod", "Makefile", "Dockerfile",
)
READABLE = (".md", ".txt", ".py", ".js", ".ts", ".json", ".yaml", ".yml", ".toml", ".cfg", ".ini", ".html", ".css", ".rst", ".sh", ".bat", ".ps1", ".c", ".h", ".cpp", ".hpp", ".rs", ".go", ".java", ".rb")
LANGUAGES = {".md": "markdown", ".py": "python", ".json": "json", ".yaml": "yaml", ".yml": "yaml"}


def dense(text: Column) -> Column:
    """The text without spaces."""
    return F.regexp_replace(text, f"{SPACES}+", "")


def header_only(text: Column, least: Column) -> Column:
    """Fewer than ``least`` characters outside of headings."""
    return F.length(dense(F.regexp_replace(text, f"(?md){HEADING}", ""))) < least


def tabular(text: Column) -> Column:
    """A word of tables, or two lines or more that are neither blank, nor headings, nor rules."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, f"^{SPACES}+", "")), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("|--"))
    return text.rlike(TABLE_WORDS) | (F.size(lines) > 1)


def _limit(ext: Column, i: int) -> Column:
    out = F.lit(LIMITS[""][i])
    for kind, values in LIMITS.items():
        out = F.when(ext == kind, values[i]).otherwise(out) if kind else out
    return out


def extraction_warnings(text: Column, ext: Column) -> Column:
    """Codes of what is wrong with an extracted text, comma-joined; none if it is right. A null text is empty."""
    text = F.coalesce(text, F.lit(""))
    least, paragraphs = _limit(ext, 0), F.filter(F.split(text, f"\\n{SPACES}*\\n"), lambda p: F.length(dense(p)) >= 20)
    low, marked = F.lower(text), F.lit(False)
    for mark in ERROR_MARKS:
        marked = marked | low.contains(mark)
    found = F.concat_ws(
        ",",
        F.when(F.length(dense(text)) < least, "too_few_chars"),
        F.when(header_only(text, least), "header_only"),
        F.when(F.size(paragraphs) < _limit(ext, 1), "too_few_paragraphs"),
        F.when(10 * F.length(dense(F.regexp_replace(text, LINKED, ""))) < _limit(ext, 2) * F.length(dense(text)), "low_visible_ratio"),
        F.when(marked, "error_mark"),
        F.when(ext.isin(*TABLES) & ~tabular(text), "no_table"),
    )
    return F.when(dense(text) == "", "empty").otherwise(found)


def listing_class(name: Column) -> Column:
    """How a repository's file is treated: read first, read, or skipped."""
    readable = F.lit(False)
    for ending in READABLE:
        readable = readable | F.lower(name).endswith(ending)
    return F.when(name.isin(*FIRST_FILES), "first").when(readable, "readable").otherwise("skipped")


def code_language(name: Column) -> Column:
    out = F.lit("text")
    for ending, language in LANGUAGES.items():
        out = F.when(name.endswith(ending), language).otherwise(out)
    return out


def fenced(text: Column, language: Column) -> Column:
    """Code in a fence; Markdown as it is."""
    return F.when(language == "markdown", text).otherwise(F.concat(F.lit("```"), language, F.lit("\n"), text, F.lit("\n```")))
