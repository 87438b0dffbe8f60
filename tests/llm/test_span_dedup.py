"""Repeated spans against looking up every window in plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest

from corpusforge.llm import span_dedup as S

SCHEMA = "doc_id long, text string, shard int, whole string, start int, owner long"


def brute(rows):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    first = {}
    for (doc, _), w in zip(rows, words, strict=True):
        if doc is not None:
            for i in range(len(w) - 12):
                key = tuple(w[i : i + 13])
                first[key] = min(first.get(key, doc), doc)
    found = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        if doc is not None:
            for i in range(len(w) - 12):
                if first[tuple(w[i : i + 13])] < doc:
                    gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        found.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(found, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "A", "a", "\x1c", "\x85", "x y", "."]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [some(n) for n in (12, 13, 14, 40, 200)] + [["same"] * 30, ["a", "b"] * 20]
    texts = []
    for _ in range(120):
        parts = [some(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            parts += [p[rng.randint(0, 3) :], some(rng.randint(0, 6))]
        texts.append("".join(w + rng.choice([" ", " ", "\n", "\t ", "\x0b"]) for p in parts for w in p))
    texts += [texts[5], texts[5].replace("\n", " "), texts[7] + " more", None, "", " ", " ".join(passages[1]), " ".join(passages[0]), " ".join(passages[0]), "long " * 20000]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    found = list(zip(ids, texts, strict=True))
    # Ids that are there twice, with equal and with other texts, and rows without an id.
    return [*found, found[3], found[4], (found[8][0], found[9][1]), (found[2][0], found[122][1]), (None, found[5][1]), (None, None), (10**12, found[5][1])]


@pytest.mark.parametrize(("shard_words", "broadcast_bytes", "slice_windows"), [(50_000, 64 << 20, 1_000_000), (100, 64 << 20, 1_000_000), (100, 0, 200), (50_000, 0, 10**9)])
def test_against_brute_force(spark, rows, shard_words, broadcast_bytes, slice_windows):
    df = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], SCHEMA).repartition(3)
    found = S.without_repeats(df, shard_words=shard_words, broadcast_bytes=broadcast_bytes, slice_windows=slice_windows)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def test_full_tables_lose_nothing(spark, rows):
    """Tables of four cells are full; all windows pass, and the result is the same."""
    df = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], SCHEMA)
    assert sorted((tuple(r) for r in S.without_repeats(df, bits=2).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert S.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r)[1:3] for r in S.without_repeats(spark.createDataFrame([(1, None, 1, "", 1, 1)], SCHEMA)).collect()] == [(0, 0)]


def test_automaton():
    """Each sequence's state knows the smallest document that has it."""
    rng = random.Random(2)
    spans = [(rng.randint(0, 9), np.array([rng.randint(0, 3) for _ in range(rng.randint(1, 40))], np.uint64)) for _ in range(30)]
    a = S.Automaton.loaded(S.Automaton.built(spans).stored())
    for window in (1, 2, 4, 7):
        for own in (0, 3, 9, 10):
            text = np.array([rng.randint(0, 4) for _ in range(80)], np.uint64)
            held = {tuple(w[i : i + window]) for d, w in spans if d < own for i in range(len(w) - window + 1)}
            gone = {j for i in range(len(text) - window + 1) if tuple(text[i : i + window]) in held for j in range(i, i + window)}
            found = a.covered(own, text, window)
            assert {j for s, e in found for j in range(s, e)} == gone
            assert all(e < s for (_, e), (s, _) in zip(found, found[1:]))
