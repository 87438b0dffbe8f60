"""The pipeline's near-duplicate stage against brute force over all pairs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusforge.llm import jaccard

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_components(rows):
    made = []
    for i, t in rows:
        words = (t or "").lower().split()
        made.append((i, frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()))
    sets = list({s for _, s in made})
    root = {s: s for s in sets}

    def find(x):
        while root[x] is not x:
            x = root[x]
        return x

    for k, a in enumerate(sets):
        for b in sets[:k]:
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for i, s in made:
        if i is not None:
            least[find(s)].append(i)
    return sorted(((i, min(least[find(s)], default=None)) for i, s in made), key=str)


@pytest.fixture(scope="module")
def copies(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    common = [word() for _ in range(12)]
    texts = [None, "", " ", "one two", "One TWO", "one two three"]
    for size in (6, 9, 14, 30, 60, 200, 900):
        first = [word() for _ in range(size)]
        for _ in range(12):
            own = list(first)
            for _ in range(rng.randrange(1 + size // 40 + 1)):
                own[rng.randrange(size)] = word()
            texts.append(" ".join(own[: size - rng.randrange(1 + size // 8)]))
    texts += [" ".join([*common, *[word() for _ in range(rng.randrange(3, 30))]]) for _ in range(40)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    rows += [(3, texts[20], "en", "s", 1), (None, texts[30], "en", "s", 1), (None, "only here", "en", "s", 1)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.mark.parametrize("bucket", [2, 64])
def test_components(copies, bucket):
    want = plain_components([(r.doc_id, r.text) for r in copies.collect()])
    assert len({c for _, c in want}) < len(want) - 20
    assert sorted((tuple(r) for r in jaccard.near_duplicates(copies, bucket=bucket).collect()), key=str) == want


def test_stage_drops_near_copies(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join([*words[:100], "x", *words[101:200], "y", *words[201:]]), " ".join(words[:150])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [0, 2]
    assert corpus_pipeline.drop_near_duplicates(spark, docs.where(F.lit(False)), "").count() == 0


def test_stage_takes_links_of_fingerprints_first(spark):
    """Texts whose fingerprints are equal while their sets of shingles differ: operator 2 links them, so one stays."""
    texts = [" ".join(["a b c"] * 30 + [f"{side}{i}" for i in range(20)]) for side in "xy"] + ["quite another text of a few words"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [0, 2]
