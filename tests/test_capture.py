"""Pages as files, user functions, numbering and odd inputs of the capture operators."""

import unicodedata

from pyspark.sql import functions as F

from corpusforge.operators import capture as K
from corpusforge.operators import files as A
from corpusforge.operators import linkage as L
from corpusforge.operators import scholarly as S
from corpusforge.operators import users
from corpusforge.operators.numbering import numbered
from corpusforge.sources import folders as FO
from corpusforge.sources import pages as P
from corpusforge.streaming import capture as stream


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names))).first()[0]


def test_scan_of_markdown_files(spark, tmp_path):
    for name, text in (("a/one.md", "# One\n\nx\n"), ("a/b/two.md", "two"), ("index.md", "[[one]]"), ("a/log.md", "l"), ("a/three.txt", "no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.stem: r.page_text for r in P.scan_pages(spark, str(tmp_path), "*.md").collect()}
    assert got == {"one": "# One\n\nx", "two": "two"}


def test_written_pages_come_back(spark, tmp_path):
    rows = [("s", "p1", "a\n\nb"), ("s", "p2", ""), ("t", "p1", "é\n")]
    P.write_pages(spark.createDataFrame(rows, "section string, stem string, page_text string"), str(tmp_path / "out"))
    got = {(r.section, r.stem): r.page_text for r in P.scan_pages(spark, str(tmp_path / "out")).collect()}
    assert got == {(s, p): t for s, p, t in rows}


def test_reader_text(spark):
    raw = "Title:  A b \nMarkdown Content:\nhead\n  See new posts\n## New to X?\nskip\n\n### new to X too\nskip\n# Kept\nx\n\n\n\n\ny\nBy signing up, you agree\n[a](https://x.com/privacy)\nend  "
    assert one(spark, K.reader_text, raw) == "head\n# Kept\nx\n\n\ny\nend"
    assert one(spark, K.reader_title, raw, "f") == "A b" and one(spark, K.reader_title, "x", "f") == "f"
    assert one(spark, K.reader_text, "") == "" and one(spark, K.reader_text, None) is None


def test_main_content(spark):
    page = "<html><head><title> T </title></head><body><nav>menu</nav><article class='a'><p>" + "word " * 30 + "</p><script>x</script></article></body></html>"
    got = one(spark, K.main_content, page, "host")
    assert (got.title, got.region, got.text) == ("T", "article", ("word " * 30).strip())
    got = one(spark, K.main_content, "<body><article>short</article>rest</body>", "host")
    assert (got.title, got.region) == ("host", "body") and "rest" in got.text
    assert one(spark, K.main_content, "", "host").text == ""


def test_harvest(spark):
    long = "z" * 250
    log = "\\n".join(["INFO " + "x" * 60] * 6)
    rows = [(1, '{"b":{"a":["' + long + '",{"c":"short"}]}, "a":" ' + long + ' "}'), (2, "not json"), (3, None), (4, '"' + long + '"'), (5, '{"x":"' + log + '"}'), (6, "[" * 5000 + "]" * 5000), (7, "{}"), (8, "null")]
    df = spark.createDataFrame(rows, "k int, j string")
    found = lambda **budgets: [(r.k, r.path, r.field) for r in K.harvested(df, "k", "j", **budgets).collect()]
    assert found() == [(1, "$.b.a[0]", "0"), (1, "$.a", "a"), (4, "$", "")]
    # Nodes: root, b, a, the first string, the object, c, the last string. Strings: the first, the short one, the last.
    assert found(nodes=4) == [(1, "$.b.a[0]", "0"), (4, "$", "")] == found(nodes=6) == found(strings=2)
    assert found(nodes=3) == [(4, "$", "")] and found(nodes=7) == found() == found(strings=3) == found(depth=4)
    assert found(depth=3) == [(1, "$.a", "a"), (4, "$", "")] and found(depth=1) == [(4, "$", "")] and found(strings=0) == []
    assert K.harvested(df, "k", "j").first().content == long


def test_user_functions(spark):
    seen = spark.createDataFrame([(i, "t", "Ａ" if i % 2 else "a") for i in range(70)] + [(99, None, None)], "id int, title string, text string")
    assert max(r.vector[0] for r in users.encoded(seen, "id", "title", "text", lambda ts: [[float(len(ts))] for _ in ts]).collect()) <= 32
    got = {r.id: r.text for r in users.compatible(seen, "text").collect()}
    assert got[1] == unicodedata.normalize("NFKC", "Ａ") == "A" and got[0] == "a" and got[99] is None and len(got) == 71


def test_numbers_of_a_large_group(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.when(F.col("id") % 300 == 1, "b").otherwise("a")).alias("g"), "id")
    got = numbered(rows, ["g"], ["id"]).groupBy("g").agg(F.count("*").alias("c"), F.countDistinct("n").alias("d"), F.max("n").alias("m")).collect()
    assert all(r.c == r.d == r.m for r in got) and len(got) == 3
    assert numbered(rows, ["g"], ["id"]).where("g = 'a'").orderBy("n").first().id == 2


def test_scholarly_text(spark):
    ids = lambda t: one(spark, lambda c: F.to_json(F.struct(*[x.alias(n) for n, x in S.identifiers(c).items()])), t)
    assert ids("see 10.1234/ab.c, and arXiv: 2401.12345v2; PMID: 1234567") == '{"doi":"10.1234/ab.c","arxiv_id":"arXiv: 2401.12345v2","pmid":"PMID: 1234567"}'
    assert ids(None) == ids("") == "{}"


def test_import_and_ledger(spark):
    rows = spark.createDataFrame([("S", "J", "e", "1"), ("S", "J", "e", "1"), ("", "J", "e", "1"), (None, None, None, None)], "scheme string, journal_name string, edition string, issn string")
    got = {r.outcome: r.n for r in L.import_outcomes(rows).collect()}
    assert got == {"inserted": 2, "invalid": 2}
    items = spark.createDataFrame([(i,) for i in range(6)], "item int")
    ledger = spark.createDataFrame([(0, "succeeded"), (1, "failed"), (0, "succeeded")], "item int, status string")
    back = {r.item: r.done_now for r in A.resumed(items, ledger, F.lit("succeeded")).collect()}
    assert back == {0: False, 1: True, 2: True, 3: True, 4: True, 5: True}


def test_latest_values(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "k string, t int").write.parquet(str(tmp_path / "t"))
    got = {r.k: r.t for r in stream.latest_values(stream.read_stream(spark, str(tmp_path / "t")), ["k"], "t").collect()}
    assert got == {"a": 5, "b": 2}


def test_pages_are_listed_by_tasks(spark, tmp_path):
    """Pages come as Spark's reader of files gives them, though the driver lists none."""
    for name in ("a/one.md", "a/b/two.md", "_no/x.md", ".no/x.md", "_metadata/x.md", "_k=v/x.md", "a/_no.md", "a/.no.md", "a/_k=v.md", "a/x.md._COPYING_", "a/three.txt", "a/é é.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("text\n")
    (tmp_path / "a/none.md").write_text("")
    columns = lambda rows, time: sorted((r.path, r[time], bytes(r.content)) for r in rows.collect())
    for pattern in ("*.md", "*", "{one,t*}.[mt]?*", "x.md"):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(str(tmp_path))
        assert columns(FO.found_texts(spark, str(tmp_path), pattern), "modified") == columns(reader, "modificationTime")
    plan = P.scan_pages(spark, f"file://{tmp_path}")._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and P.scan_pages(spark, f"file://{tmp_path}").count() == 6
