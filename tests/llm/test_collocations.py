"""Phrase collocations against counting every phrase in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusforge.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, k int, cell string, w1 string, name string"


def brute(rows, least, top=2000):
    """rows of (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang, low = lang or "und", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    found = []
    for lang, c in f.items():
        phrases = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p in phrases for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and phrases[p] >= phrases[p[i:j]]}
        rows = []
        for p, a in phrases.items():
            if p not in inside:
                score, cut = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:cut]], c[p[cut:]]))
        found += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(found)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["Ein", "zwei", "drei", "vier", "fünf", "sechs x", "b c", "#", "Ä", "der", "\x1c", "\x85y"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", "\n", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += ["one two three four five six"] * 40 + [None, "", " ", ".", "!?", "x " * 30000, "ONE Two three" * 3]
    return [(t, ["en", "de", None][i % 3]) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("least", "shards", "bits"), [(4, 3, 16), (8, 5, 3), (3, 1, 8)])
def test_against_brute_force(spark, rows, least, shards, bits):
    """With three bits nearly all phrases share a cell with others."""
    df = spark.createDataFrame([(i % 7 or None, t, lang, 1, "c", "w", "n") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    assert sorted(tuple(r) for r in C.collocations(df, least, 2000, shards, bits).collect()) == brute(rows, least)


def test_first_ones_only(spark, rows):
    df = spark.createDataFrame([(i, t, lang, 1, "c", "w", "n") for i, (t, lang) in enumerate(rows)], SCHEMA)
    assert sorted(tuple(r) for r in C.collocations(df, 4, 5, 2, 16).collect()) == brute(rows, 4, 5)


def test_empty(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA), shards=2, bits=8).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None, 1, "", "", "")], SCHEMA), shards=2, bits=8).count() == 0


def test_one_hash_of_two_phrases():
    """Phrases with equal keys are told apart by their words."""
    at = np.arange(4)
    places, counts = C._distinct(np.array([7, 7, 7, 9], np.uint64), at, [np.array([1, 1, 1, 2])])
    assert sorted(zip(places.tolist(), counts.tolist())) == [(0, 3), (3, 1)]
    places, counts = C._distinct(np.array([7, 7, 7], np.uint64), at[:3], [np.array([1, 2, 1])])
    assert sorted(zip(places.tolist(), counts.tolist())) == [(0, 2), (1, 1)]


def test_tally():
    """Phrases of many slices are given once, those of one key apart, and no more are held than allowed."""
    tally = C.Tally(most=3, fresh=4)
    some = list(np.array([[1, 1, 5], [2, 3, 5], [10, 10, 18]], np.uint64))
    given = []
    for _ in range(5):
        tally.add(np.array([7, 7, 9], np.uint64), some, np.array([1, 2, 3]))
        given += tally.taken()
    assert not given
    given += tally.taken(True)
    assert [sorted(tuple(map(int, row)) for row in zip(*x[0], x[1], strict=True)) for x in given] == [[(1, 2, 10, 5), (1, 3, 10, 10), (5, 5, 18, 15)]]
    tally.add(np.arange(5, dtype=np.uint64), [np.arange(5, dtype=np.uint64)] * 3, np.ones(5, np.int64))
    assert [len(c) for _, c in tally.taken()] == [5]
    assert not tally.parts


def test_a_task_gives_a_phrase_once(spark):
    """However many parts the words lie in, a phrase is given by two tasks for each core at most."""
    words = [C.xxhash.xxh64_intdigest(w) >> 1 for w in (b"a", b"b")]
    corpus = spark.createDataFrame([("en", words)] * 64, "lang string, words array<long>").repartition(64)
    found = C.spelled_out(corpus, spark.sparkContext.broadcast(np.ones(1 << 8, bool)), 8)
    assert {(r.k, r.w1, r.w2, r.c) for r in found.collect()} == {(0, 0, 0, 128), (1, words[0], 0, 64), (1, words[1], 0, 64), (2, *words, 64)}
    given = found._jdf.queryExecution().optimizedPlan()
    assert f"Repartition {2 * spark.sparkContext.defaultParallelism}, false" in given.toString()


def test_words_of_one_hash_start_again(spark, rows, monkeypatch):
    """With the first seed, hashes of two words are equal."""

    class Weak(C.WordCodes):
        def encoded(self, words):
            found, new = super().encoded(words)
            if self.seed == 0:
                self.hashes[[self.number[w] for w in (b"ein", b"zwei") if w in self.number]] = 77
                found = self.hashes[[self.number[w] for w in words]]
            return found, new

    monkeypatch.setattr(C, "WordCodes", Weak)
    df = spark.createDataFrame([(i, t, lang, 1, "c", "w", "n") for i, (t, lang) in enumerate(rows)], SCHEMA)
    assert sorted(tuple(r) for r in C.collocations(df, 4, 2000, 2, 16).collect()) == brute(rows, 4)
