"""Quality rules: fixed text statistics, then a hashed n-gram logistic regression.

Features are the shares of hashed word uni- and bigrams and of character 3- and 4-grams in a whole
text. The model is fitted on a bounded sample of labelled rows (``sample_rows``), its probabilities
are calibrated on a held-back quarter of them, and texts are scored in Arrow batches against a fixed
threshold. Weights have a fixed size (``2 ** bits`` floats), so what tasks receive doesn't grow.

Defined cases: a null or empty text has no words and fails the base rules; without labelled rows of
both kinds every text scores the labels' mean (0.5 without any label); repeated rows get the same result each;
other columns are ignored; empty tables give empty results. Texts are read whole, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import fit_logistic, labelled_sample, sigmoid, slices
from corpusforge.session import ship

SYMBOLS = "#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEATED_SHARE = 50, 0.5
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: PRIME times this is 1 modulo 2 ** 64.
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalising mix, so that the top bits depend on all."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hashed_grams(data: bytes, bits: int) -> list[np.ndarray]:
    """Slots of word unigrams, word bigrams, character 3-grams and 4-grams of one lower-case text."""
    raw = np.frombuffer(data, np.uint8)
    shift = np.uint64(64 - bits)
    space = np.isin(raw, np.frombuffer(SPACES, np.uint8))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(max(0, len(raw) - 1), PRIME)[: len(raw)], dtype=np.uint64)])
    words = (sums[ends] - sums[starts]) * powers(len(raw), INVERSE)[starts]
    out = [mixed(words) >> shift, mixed(words[:-1] * np.uint64(0x100000001B3) + words[1:]) >> shift]
    codes = np.where(space, np.uint8(32), raw).astype(np.uint64)
    for n in (3, 4):
        gram = np.zeros(max(0, len(codes) - n + 1), np.uint64)
        for k in range(n):
            gram = gram * np.uint64(257) + codes[k : k + len(gram)]
        out.append(mixed(gram * PRIME + np.uint64(n)) >> shift)
    return [x.astype(np.int64) for x in out]


#: Long texts go in pieces of about so many bytes, cut at white space; a word of more than two pieces is cut at that length.
PIECE = 1 << 20
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")


def pieces(data: bytes, size: int = 0) -> Iterator[tuple[int, int]]:
    """Start and end of each piece; a piece ends before white space."""
    size, at = size or PIECE, 0
    while at < len(data):
        end = min(len(data), at + size)
        if end < len(data):
            space = _SPACE.search(data, end, min(len(data), at + 2 * size))
            end = space.start() if space else min(len(data), at + 2 * size)
        yield at, end
        at = end


def gram_shares(data: bytes, bits: int, piece: int = 0) -> np.ndarray:
    """For each slot the sum of the four kinds' shares, so a text of any length has the same total.

    Grams that cross the edge of two pieces count: the second one begins with the last word of the first (for word pairs), or
    with its last three bytes (for character grams), and what lies wholly in those isn't counted again.
    """
    low, size = data.lower(), piece or PIECE
    if len(low) <= size:
        kinds = [k for k in hashed_grams(low, bits) if len(k)]
        weights = [np.full(len(k), 1 / len(k)) for k in kinds]
        return np.bincount(np.concatenate(kinds), np.concatenate(weights), minlength=1 << bits) if kinds else np.zeros(1 << bits)
    counts = np.zeros((4, 1 << bits))
    last = b""
    for at, end in pieces(low, size):
        own = low[at:end]
        words, pairs, _, _ = hashed_grams(own, bits)
        joint = hashed_grams(last + b" " + own, bits)[1]
        threes, fours = hashed_grams(low[max(0, at - 2) : end], bits)[2], hashed_grams(low[max(0, at - 3) : end], bits)[3]
        for kind, slots in enumerate((words, joint if last else pairs, threes, fours)):
            counts[kind] += np.bincount(slots, minlength=1 << bits)
        found = own.rsplit(None, 1)
        last = found[-1] if found else last
    total = counts.sum(axis=1, keepdims=True)
    return np.divide(counts, total, out=np.zeros_like(counts), where=total > 0).sum(axis=0)


def gram_vector(data: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text."""
    shares = gram_shares(data, bits)
    at = np.flatnonzero(shares)
    return at.astype(np.int32), np.sqrt(shares[at]).astype(np.float32)


@dataclass(frozen=True)
class HashedModel:
    """p = sigmoid(scale * (weights . features + bias) + shift)."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float
    bits: int

    def score(self, text: str | None) -> float:
        raw = float(self.weights @ np.sqrt(gram_shares((text or "").encode("utf-8", "surrogatepass"), self.bits))) + self.bias
        return float(sigmoid(np.array(self.scale * raw + self.shift)))


def _vectors(sample: DataFrame, bits: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The sample's feature vectors; made by the executors, so only they come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = [gram_vector(t.encode("utf-8", "surrogatepass"), bits) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([m[0].tobytes() for m in made], pa.binary()), pa.array([m[1].tobytes() for m in made], pa.binary())],
                names=["doc_id", "label", "slots", "vals"],
            )

    rows = sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "text").mapInArrow(run, "doc_id long, label int, slots binary, vals binary")
    found = sorted(rows.collect(), key=lambda r: (r.doc_id, bytes(r.slots), bytes(r.vals)))
    return [(np.frombuffer(r.slots, np.int32), np.frombuffer(r.vals, np.float32), r.label) for r in found]


def fit(sample: DataFrame, bits: int = 15, steps: int = 150, rate: float = 0.5, l2: float = 1e-5) -> HashedModel:
    """Fit on a bounded sample (doc_id, text, label); a quarter of it is held back for calibration."""
    rows = _vectors(sample, bits)
    labels = np.array([r[2] for r in rows], np.float64)
    mean = float(labels.mean()) if len(labels) else 0.5
    if len(rows) < 8 or not 0 < mean < 1:
        logit = np.log((mean + 1e-3) / (1 - mean + 1e-3))
        return HashedModel(np.zeros(1 << bits, np.float32), 0.0, 1.0, float(logit), bits)
    train = np.arange(len(rows)) % 4 != 3
    y = labels[train]
    chosen = [r for r, t in zip(rows, train, strict=True) if t]
    slots, values = np.concatenate([r[0] for r in chosen]), np.concatenate([r[1] for r in chosen])
    of = np.repeat(np.arange(len(chosen)), [len(r[0]) for r in chosen])
    w, bias, g2, b2 = np.zeros(1 << bits), 0.0, np.full(1 << bits, 1e-8), 1e-8
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(steps):
        p = sigmoid(np.bincount(of, w[slots] * values, len(chosen)) + bias)
        err = weight * (p - y) / len(chosen)
        slope = np.bincount(slots, err[of] * values, 1 << bits) + l2 * w
        g2, b2 = g2 + slope**2, b2 + err.sum() ** 2
        w -= rate * slope / np.sqrt(g2)
        bias -= rate * err.sum() / np.sqrt(b2)
    raw = np.array([float(w[r[0]] @ r[1]) + bias for r in rows])
    held = ~train if 0 < labels[~train].mean() < 1 else np.ones(len(rows), bool)
    scale, shift = fit_logistic(raw[held][:, None], labels[held], l2=1e-3)
    return HashedModel(w.astype(np.float32), bias, float(scale), float(shift), bits)


def text_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.split(None, 1)] if n else []
    repeated = 0
    if n >= 3:
        ids: dict[bytes, int] = {}
        number = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
        _, pair = np.unique(number[:-1] * len(ids) + number[1:], return_inverse=True)
        _, at, times = np.unique(pair[:-1].astype(np.int64) * len(ids) + number[2:], return_inverse=True, return_counts=True)
        again = times[at] > 1
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k : k + len(again)] |= again
        repeated = int(hit.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or n_repeat_words > MAX_REPEATED_SHARE * n_words


def quality_rules(documents: DataFrame, labels: DataFrame, threshold: float = 0.25, sample_rows: int = 2000, bits: int = 15) -> DataFrame:
    """One row per document: statistics, base_failed, the calibrated score, and the verdict.

    ``sample_rows`` bounds the labelled rows that the model is fitted on.
    """
    ship(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(fit(labelled_sample(documents, labels, "quality", sample_rows), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            stats = np.array([text_statistics(t) for t in texts], np.int64).reshape(-1, 5)
            failed = (stats[:, 0] < MIN_WORDS) | (stats[:, 4] > MAX_REPEATED_SHARE * stats[:, 0])
            score = np.array([model.score(t) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(stats[:, i], pa.int64()) for i in range(5)], pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score, pa.float64())],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")
