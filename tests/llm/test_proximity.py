"""Proximity matches against a plain version over whole documents."""

import random
from collections import Counter

from corpusforge.llm import decontam, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string"


def test_anchor_met_again(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], ITEMS)
    words = ["pad"] * 60
    words[24], words[26], words[28], words[51] = "alpha", "beta", "gamma", "gamma"
    docs = spark.createDataFrame([(1, " ".join(words), "", "", 0)], DOCS)
    assert [tuple(r) for r in decontam.proximity_matches(docs, bench).collect()] == [(1, "1", 24, 29)]


def shortest(words, terms, reach):
    """Stretches with all terms, as often as given, that hold no shorter such stretch."""
    found = set()
    for s in range(len(words)):
        need, e = Counter(terms), s
        if words[s] not in need:
            continue
        while e < len(words) and sum(need.values()):
            if need.get(words[e]):
                need[words[e]] -= 1
            e += 1
        if not sum(need.values()):
            found.add((s, e))
    return {(s, e) for s, e in found if e - s <= reach and not any(s <= a and b <= e and (a, b) != (s, e) for a, b in found)}


def test_against_plain(spark):
    rng = random.Random(4)
    items = {"1": "alpha beta gamma", "2": "delta delta alpha", "3": "beta"}
    pool = "alpha beta gamma delta".split() + ["pad", "other", "more"] * 4
    texts = {i: [rng.choice(pool) for _ in range(rng.choice([5, 60, 300]))] for i in range(30)}
    docs = spark.createDataFrame([(i, " ".join(w), "", "", 0) for i, w in texts.items()] + [(0, " ".join(texts[0]), "", "", 0), (99, None, "", "", 0)], DOCS)
    bench = spark.createDataFrame([(int(k), t) for k, t in items.items()], ITEMS)
    want = {(i, k, s, e) for i, w in texts.items() for k, t in items.items() for s, e in shortest(w, t.split(), 26)}
    got = [tuple(r) for r in decontam.proximity_matches(docs, bench).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200


def test_query(spark):
    assert queries.queries()["op3_proximity_matches"](spark, "/root/testdata/sf0.001").columns == ["doc_id", "item_id", "start", "end"]
