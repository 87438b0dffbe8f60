"""Registry matching where work ids and registry keys repeat."""

from pyspark.sql import functions as F

from corpusforge.operators import linkage as L

WORK = "work_id string, issn string, issn_l string, eissn string, journal_name string"


def test_repeated_work_ids(spark):
    registry = spark.createDataFrame(
        [(1, "0000-0019", "", "", "Alpha Journal of Letters"), (2, "0000-0019", "", "", "Alpha Journal of Letters"), (3, "", "", "0000-0027", "Beta Review of Studies and Notes")],
        "p_partkey long, issn string, issn_l string, eissn string, journal_name string",
    )
    works = spark.createDataFrame(
        [("w1", "0000-0019", "", "", "x"), ("w1", "", "", "0000-0027", "Alpha Journal of Letters"), ("w1", "0000-0019", "", "", "x"), ("w2", "", "", "", "alpha journal of letters"), ("w3", "", "", "", "Beta Review of Studies and Note"), ("w3", "", "", "", "Beta Review of Studies and Notes!")],
        WORK,
    )
    for parts in (1, 3, 5):
        got = {r.work_id: (r.p_partkey, r.method) for r in L.match_works(works.repartition(parts), registry).collect()}
        assert got == {"w1": (1, "issn"), "w2": (1, "name"), "w3": (3, "similar")}
    assert L.match_works(works.limit(0), registry).count() == 0


def test_names_of_one_beginning_are_not_all_compared(spark):
    """Thousands of names that begin alike: every similar one is found, and few pairs are looked at."""
    import random


    rng = random.Random(6)
    start = "international journal of applied "
    kinds = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(14, 40))) for _ in range(2500)]
    registry = spark.createDataFrame([(i, start + k) for i, k in enumerate(kinds)], "p_partkey long, journal_name string")
    asked = [start + k[:-1] + "q" for k in kinds[:300]] + [start + "".join(rng.choice("xyz0123456789") for _ in range(30)) for _ in range(50)]
    names = spark.createDataFrame([(n,) for n in asked], "name string")

    def pairs(t):
        t = "".join(t.split())
        return {t[i : i + 2] for i in range(len(t) - 1)}

    sets = [pairs(start + k) for k in kinds]
    want = {}
    for n in asked:
        own = pairs(n)
        score, i = max((2 * len(own & s) / (len(own) + len(s)), -i) for i, s in enumerate(sets))
        if score >= 0.8:
            want[n] = (-i, round(score, 6))
    assert {r.name: (r.p_partkey, round(r.score, 6)) for r in L.similar_names(names, registry).collect()} == want and len(want) > 250
    block = lambda df, c: df.withColumn("piece", F.substring(c, 1, 30))
    known = registry.select("p_partkey", F.col("journal_name").alias("known"))
    assert L.similar_pairs(block(names, "name"), block(known, "known")).count() < len(asked) * len(kinds) // 10


def test_parts_of_blocks_and_very_large_blocks(spark, monkeypatch):
    """Names of one block give the same whether they meet in one group, in parts, or by the set-similarity join."""
    registry = spark.createDataFrame([(i, f"red bolt brand#{i % 25} {i % 40}") for i in range(200)], "p_partkey long, journal_name string")
    names = spark.createDataFrame([(f"red bolt brand#{i % 25} {i % 40}x",) for i in range(150)] + [("red bolt brand#7",), ("",)], "name string")
    got = []
    for part, large in ((1_000, 100_000), (7, 100_000), (1_000, 3)):
        monkeypatch.setattr(L, "PART", part)
        monkeypatch.setattr(L, "LARGE", large)
        got.append({(r.name, r.p_partkey, round(r.score, 9)) for r in L.similar_names(names, registry).collect()})
    assert got[0] == got[1] == got[2] and len(got[0]) == 151


def test_works_are_read_once_for_equality(spark):
    """All identifiers and names of works go through one join: their table stands in the plan once."""
    works = spark.createDataFrame([("w1", "", "", "", "x")], WORK)
    registry = spark.createDataFrame([(1, "0000-0019", "", "", "x")], "p_partkey long, issn string, issn_l string, eissn string, journal_name string")
    found = L.exact_matches(works, registry)
    assert [tuple(r) for r in found.collect()] == [("w1", 1, "name", 0.92)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("work_id#") < 20


def test_works_meet_distinct_asks(spark, monkeypatch):
    """Many works that ask for few journals: each ask is looked up once, also if hashes of asks are equal at first, and rows without an id are one work in two ways."""
    registry = spark.createDataFrame([(1, "0000-0019", "", "", "Alpha Journal of Letters"), (2, "", "", "0000-0027", "Beta Review of Studies and Notes")], "p_partkey long, issn string, issn_l string, eissn string, journal_name string")
    rows = [(f"w{i}", "0000-0019", None, "", "x") for i in range(200)] + [(f"v{i % 50}", "", "", "", "beta review of  studies and Note") for i in range(100)] + [("v0", "", "", "0000-0027", "")]
    rows += [("u", "0000-0018", "", "", None), (None, "0000-0019", "", "", "Beta Review of Studies and Notes"), (None, "", "", "", "q")]
    works, asked, seeds = spark.createDataFrame(rows, WORK), [], []
    exact, hashed = L.exact_matches, L._hashed
    monkeypatch.setattr(L, "exact_matches", lambda works, registry: asked.append(works.count()) or exact(works, registry))
    monkeypatch.setattr(L, "_hashed", lambda seed: seeds.append(seed) or (hashed(seed) if seed else F.lit(5).cast("long")))
    found = L.match_works(works, registry)
    assert asked == [6] and set(seeds) == {0, 1} and found.count() == 252
    one = {(r.work_id, r.p_partkey, r.method, r.review) for r in found.where("work_id IS NULL OR work_id IN ('w7', 'v0', 'v1', 'u')").collect()}
    assert one == {("w7", 1, "issn", False), ("v0", 2, "eissn", False), ("v1", 2, "similar", False), (None, 1, "issn", False), (None, 2, "similar", False)}
    assert {tuple(r) for r in L.match_outcomes(works, registry).collect()} == {("issn", 200), ("similar", 98), ("eissn", 3), ("none", 3)}
