"""Ranked search over treaps against scoring every document in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusforge.llm import ranked_search as R

DOCS = "doc_id long, text string, terms string, score long, rank int"
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    """docs: (doc_id, text); items: (item_id, text)."""
    held = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n_docs, n_words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(words(text))
    found = []
    for item, terms in asked.items():
        scores = []
        for doc, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s:
                scores.append((-s, doc is None, doc))
        found += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(found, key=lambda x: x[:2])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(400)] + ["é", "Ünï", "\x85", "日本", "A_b"]
    docs = [(i * 3 % 1009, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80)))) for i in range(400)]
    docs += [(5000 + i, "common copy of w1 w2 rareword") for i in range(150)] + [(7, "w1 w1"), (7, "w1 w1"), (None, "w1 w2 rareword"), (None, None), (9001, None), (9002, ""), (9003, "..., !"), (9004, "w1 " * 30000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))) for i in range(25)]
    items += [(100, "rareword"), (100, "w1"), (101, None), (102, ""), (103, "nosuchterm"), (None, "w1"), (104, "w1 W1 w1"), (105, "common copy of w1")]
    return docs, items


def found(spark, docs, items, **options):
    rows = spark.createDataFrame([(i, t, "x", 1, 1) for i, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, df long")
    return sorted((tuple(r) for r in R.ranked(rows, asked, **options).collect()), key=lambda x: x[:2])


@pytest.mark.parametrize("shard_words", [1 << 19, 300])
def test_against_brute_force(spark, corpus, shard_words):
    assert found(spark, *corpus, shard_words=shard_words) == brute(*corpus)


def test_blocks_and_small_k(spark, corpus, monkeypatch):
    whole = R.blocks
    monkeypatch.setattr(R, "blocks", lambda items: whole(items, 500))
    assert found(spark, *corpus, k=3) == brute(*corpus, k=3)


def test_empty(spark):
    docs, items = [(1, "a b")], [(1, "a")]
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []
    assert found(spark, docs, items) == brute(docs, items)


def test_treap_holds_every_point():
    rng = np.random.default_rng(1)
    points = np.unique(rng.integers(0, (300, 90), (2000, 2)), axis=0)
    impact = rng.integers(1, 10**6, len(points))
    treap = R.Treap(*R.built(points[:, 0], points[:, 1], impact))
    for r, c, v in zip(points[:, 0], points[:, 1], impact, strict=True):
        node = np.zeros(1, np.int64)
        for bit in range(treap.height - 1, -1, -1):
            assert treap.greatest[node[0]] >= v
            node = treap.children(node, np.array([(r >> bit) & 1]), int((c >> bit) & 1))
        assert treap.greatest[node[0]] == v


def test_few_ranges_are_opened(corpus, monkeypatch):
    """Documents far from the best ones aren't reached."""
    sizes = np.full(4096, 10)
    rows, cols = np.zeros(4096, np.int64), np.arange(4096)
    impact = np.where(cols == 1234, 900_000, 100 + cols % 7)
    treap, best, opened = R.Treap(*R.built(rows, cols, impact)), R.Best(1), []
    whole = treap.children
    treap.children = lambda nodes, bits, half: opened.append(len(nodes)) or whole(nodes, bits, half)
    R.descend(treap, np.arange(4096), np.zeros(1, np.int64), np.array([3]), best, width=1)
    assert (best.scores.tolist(), best.docs.tolist()) == ([2_700_000], [1234]) and sum(opened) < 4 * treap.height < len(sizes)
