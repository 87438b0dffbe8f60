"""Text expressions: Column in, Column out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that compatibility form (NFKC) leaves alone, whatever stands beside them: ASCII, letters of Latin, Greek, Cyrillic, kana and
#: CJK, and common punctuation. Texts of these alone need no normalisation.
SETTLED = "\\x00-\\x7F\\xA1-\\xA7\\xA9\\xAB-\\xAE\\xB0\\xB1\\xB6\\xB7\\xBB\\xBF-\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E\\u0391-\\u03A1\\u03A3-\\u03CE\\u0400-\\u0481\\u048A-\\u052F\\u2010\\u2012-\\u2016\\u2018-\\u201F\\u2020-\\u2023\\u20AC\\u3001-\\u3003\\u3008-\\u3011\\u3041-\\u3096\\u30A1-\\u30FA\\u4E00-\\u9FFF"


def compatible(text: Column) -> Column:
    """A text in compatibility form (NFKC); only texts that it can change go through Python."""

    def normalised(texts: pd.Series) -> pd.Series:
        import unicodedata

        return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))

    normalised.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    # ASCII is told apart first: a class of so many ranges is slow, and most characters need not be held against it.
    open_ones = text.rlike(f"[\\x{{80}}-\\x{{10FFFF}}&&[^{SETTLED}]]")
    return F.when(open_ones, F.pandas_udf(normalised, "string")(F.when(open_ones, text))).otherwise(text)


def tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits and underscores in compatibility form; each CJK character is a token.

    Tokens of one character (CJK apart) and of digits only are left out. Null text: no tokens.
    """
    spaced = F.regexp_replace(compatible(F.lower(F.coalesce(text, F.lit("")))), "([\\x{4E00}-\\x{9FFF}])", " $1 ")
    parts = F.split(spaced, "[^\\p{L}\\p{N}_]+")
    return F.filter(parts, lambda t: ((F.length(t) > 1) | t.rlike("^[\\x{4E00}-\\x{9FFF}]$")) & ~t.rlike("^\\p{Nd}+$"))


def occurrences(text: Column, term: Column) -> Column:
    """How often ``term`` occurs in ``text``, without overlaps."""
    return (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)


def visible_text(html: Column) -> Column:
    """What a reader sees of an HTML text: no scripts, styles, tags or entities, single blanks."""
    out = html
    for tag in ("script", "style", "noscript"):
        out = F.regexp_replace(out, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(F.regexp_replace(out, "<[^>]+>", " "), "&[a-zA-Z]+;|&#[0-9]+;", " ")
    return F.trim(F.regexp_replace(out, "[ \\t\\n\\r\\f\\x0B]+", " "))


def collapsed_sha(text: Column) -> Column:
    """Identity of a text under white-space normalisation."""
    return F.sha2(F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f\\x0B]+", " ")), 256)


def character_pairs(text: Column) -> Column:
    """The distinct pairs of neighbouring characters; one regex pass gives all, a substring would be sought from the text's beginning each time."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), F.lit(1)))


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of two texts' sets of character pairs; texts under two characters have none."""
    x, y = character_pairs(a), character_pairs(b)
    return F.when(F.size(x) + F.size(y) == 0, 0.0).otherwise(2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def with_value(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)
