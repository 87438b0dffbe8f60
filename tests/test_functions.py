"""Boundary cases of text functions and page operators."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusforge.functions.text import compatible, dice, tokens
from corpusforge.operators import corpus, retrieval, sensitive


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names))).first()[0]


def test_tokens(spark):
    assert one(spark, tokens, "A cat, 42 中文 x_1!") == ["cat", "中", "文", "x_1"]
    assert one(spark, tokens, None) == [] and one(spark, tokens, "") == []


def test_dice(spark):
    assert one(spark, dice, "night", "nacht") == 0.25 and one(spark, dice, "", "a") == 0.0


def test_frontmatter(spark):
    assert one(spark, corpus.frontmatter_issue, "---\ncreated: 1\ntype: a\n---\n# T") == "missing: tags"
    assert one(spark, corpus.frontmatter_issue, "# T") == "MISSING frontmatter"
    assert one(spark, corpus.frontmatter_issue, "---\ncreated: 1") == "MALFORMED frontmatter"
    assert one(spark, corpus.title, "x") == "[no-title]"


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="0123456789", min_size=7, max_size=7))
def test_issn(spark, body):
    total = sum((8 - i) * int(d) for i, d in enumerate(body))
    check = "0123456789X"[(11 - total % 11) % 11]
    assert one(spark, corpus.issn_valid, f"{body[:4]}-{body[4:]}{check}") is True
    assert one(spark, corpus.issn_valid, f"{body[:4]}-{body[4:]}{'0' if check != '0' else '1'}") is False


def test_snippet(spark):
    got = one(spark, lambda b: retrieval.snippet(b, F.array(F.lit("fox"))), "dog\n\na fox and a fox\n\nfox")
    assert got == "a fox and a fox"


def test_redaction(spark):
    assert one(spark, sensitive.redacted, "mail a@b.org now") == "mail [REDACTED_email] now"
    assert one(spark, lambda t: sensitive.gate(t)["blocked"], "password=12345678") is True


def test_page_texts_with_nulls_and_empty(spark):
    from corpusforge.functions import extraction as X
    from corpusforge.functions import reading as R

    rows = spark.createDataFrame([(0, None), (1, ""), (2, "title: A: b\nx"), (3, "null"), (4, "one data\n\ndata data " + "x" * 300)], "id int, text string")
    found = {
        r.id: r
        for r in rows.select(
            "id", R.noise(F.col("text")).alias("noise"), R.title(F.col("text"), F.lit("stem")).alias("title"), R.snippet(F.col("text"), ("data",)).alias("snippet"),
            X.extraction_warnings(F.col("text"), F.lit(".txt")).alias("warnings"),
        ).collect()
    }
    assert [found[i].noise for i in range(5)] == [True, True, False, True, False]
    assert [found[i].title for i in range(3)] == ["stem", "stem", "A: b"]
    assert found[0].snippet is None and found[1].snippet == "" and found[4].snippet.startswith("data data x") and len(found[4].snippet) == 201
    assert found[0].warnings == found[1].warnings == "empty" and found[3].warnings == "too_few_chars,header_only,too_few_paragraphs" and found[4].warnings == ""


def test_settled_characters():
    """No character that is left out of normalisation is changed by it or joins with the one before."""
    import re
    import unicodedata

    from corpusforge.functions.text import SETTLED

    held = re.compile(f"[{SETTLED}]")
    for c in (chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000):
        assert not held.match(c) or (unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c)), hex(ord(c))


def test_wide_words_meet_plain_ones(spark):
    from corpusforge.functions.text import tokens

    df = spark.createDataFrame([("Ｆｕｌｌ　ｗｏｒｄ ﬁne e\u0301t x２ １２",), ("full word fine ét x2 12",), (None,)], "t string")
    a, b, c = (r.w for r in df.select(tokens(F.col("t")).alias("w")).collect())
    assert a == b == ["full", "word", "fine", "ét", "x2"] and c == []


def test_label_scan_reads_whole_texts(spark):
    far = "x " * 40_000 + "password = 'abc' mail a@example.org"
    assert one(spark, sensitive.labels, far) == ["Password"]
    assert one(spark, lambda t: sensitive.labels(t, (*sensitive.CRITICAL, *sensitive.WARNING)), far) == ["credential", "email"]
    assert one(spark, sensitive.labels, "x" * (10 * 1024 * 1024) + " password='abc'") == ["Password"]


def test_characters_that_need_no_normalisation(spark):
    """The quick check finds just the characters outside of the settled ones."""
    codes = [c for c in [*range(0x3400), 0x4E00, 0x9FFF, *range(0xF900, 0xFFF0), 0x1D400, 0x10FFFF] if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c, f"a{chr(c)}b") for c in codes], "c int, t string")
    got = {r.c: r.n for r in rows.select("c", compatible(F.col("t")).alias("n")).collect()}
    assert got == {c: unicodedata.normalize("NFKC", f"a{chr(c)}b") for c in codes}
    assert "&&" in rows.select(compatible(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
