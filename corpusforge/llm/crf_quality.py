"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features describe the line and its neighbours; transitions link it to the
line before. Labels exist per document only, so lines of good documents are good, and lines of bad ones
are bad where a first, unlinked model finds them so (the worst line always). The field is fitted on
a bounded sample of labelled rows (``sample_rows``, ``sample_lines`` of each). A text's score is the length-weighted mean of its
lines' forward-backward marginals, calibrated against the documents' labels.

Defined cases: a null text is an empty one; a text without a word scores the labels' mean; without
labels of both kinds every text does (0.5 without any); repeated rows get the same result each; other
columns are ignored; an empty table gives an empty result. Texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import crc_fold, fit_logistic, labelled_sample, sigmoid, slices
from corpusforge.session import checkpointed, ship

OWN = 20


def line_features(line: bytes, seen: set[int]) -> list[float]:
    """What a line looks like by itself, and whether it was there before."""
    words = line.split()
    n, size = len(words), len(line)
    low = line.lower()
    share = lambda chars: (size - len(line.translate(None, chars))) / size
    upper = sum(a != b for a, b in zip(line[:2000], low[:2000], strict=True)) / min(size, 2000) if size <= 2000 else (size - len(line.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / size
    distinct = len(set(words)) / n
    same = sum(map(bytes.__eq__, words, words[1:])) / n
    symbols, pipes, bangs = share(b"#*$%&<>"), share(b"|"), share(b"!")
    key = hash(line)
    again = float(key in seen)
    seen.add(key)
    return [
        np.log1p(size), np.log1p(n), upper, symbols, pipes, bangs, share(b"0123456789"), share(b".,;:?"), size / n / 10, distinct, same, again,
        float(line.rstrip()[-1:] in b".?!"), float(upper > 0.5), float(symbols > 0.05), float(pipes > 0.05), float(bangs > 0.05), float(same > 0.2), float(distinct < 0.4), float(n < 3),
    ]


def own_features(text: str | None, block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lines x own features) and the lines' lengths, in blocks of lines; lines without a word are left out."""
    seen: set[int] = set()
    rows: list[list[float]] = []
    sizes: list[int] = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        if line.split(None, 1):
            rows.append(line_features(line, seen))
            sizes.append(len(line))
            if len(rows) == block:
                yield np.array(rows, np.float64), np.array(sizes, np.float64)
                rows, sizes = [], []
    if rows:
        yield np.array(rows, np.float64), np.array(sizes, np.float64)


def document_features(text: str | None, most: int | None = None, run: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features) with the neighbours' features, and the lines' lengths.

    Of a text with more than ``most`` lines, runs of ``run`` lines at even distances are taken, about ``most`` lines in all.
    """
    blocks = list(own_features(text))
    own = np.vstack([b[0] for b in blocks]) if blocks else np.zeros((0, OWN))
    lengths = np.concatenate([b[1] for b in blocks]) if blocks else np.zeros(0)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    ends = np.zeros((len(own), 2))
    if len(own):
        ends[0, 0] = ends[-1, 1] = 1
    at = np.arange(len(own))
    if most is not None and len(own) > most:
        starts = np.linspace(0, len(own) - run, max(1, most // run)).astype(np.int64)
        at = np.unique((starts[:, None] + np.arange(run)).ravel())
    return np.hstack([own[at], before[at], after[at], ends[at]]), lengths[at]


WIDTH = 3 * OWN + 2


def marginals(bad: np.ndarray, links: np.ndarray) -> np.ndarray:
    """P(line is good) of one chain; ``bad`` is each line's score for bad, good scores 0; links[from, to], 0 good, 1 bad."""
    n = len(bad)
    pull = np.exp(links - links.max())
    emit = np.stack([sigmoid(-bad), sigmoid(bad)], axis=1)
    forward, backward = np.empty((n, 2)), np.ones((n, 2))
    at = emit[0]
    forward[0] = at = at / at.sum()
    for i in range(1, n):
        at = (at @ pull) * emit[i]
        forward[i] = at = at / at.sum()
    at = np.ones(2)
    for i in range(n - 2, -1, -1):
        at = pull @ (emit[i + 1] * at)
        backward[i] = at = at / at.sum()
    both = forward * backward
    return both[:, 0] / both.sum(axis=1)


def _padded(chains: list[np.ndarray], fill: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(c) for c in chains)
    out = np.full((len(chains), longest, *chains[0].shape[1:]), fill)
    on = np.zeros((len(chains), longest), bool)
    for i, c in enumerate(chains):
        out[i, : len(c)], on[i, : len(c)] = c, True
    return out, on


def train_chain(rows: list[np.ndarray], states: list[np.ndarray], steps: int = 80, rate: float = 0.1, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (the last is the bias) and 2 x 2 links, by gradient steps on the log-likelihood."""
    x, on = _padded(rows)
    y = _padded([s.astype(float) for s in states])[0].astype(int)
    x = np.concatenate([x, on[..., None].astype(float)], axis=2)
    docs, n, width = x.shape
    w, links = np.zeros(width), np.zeros((2, 2))
    moments = [np.zeros(width + 4), np.zeros(width + 4)]
    onehot = np.eye(2)[y] * on[..., None]
    seen_links = np.einsum("dti,dtj->ij", onehot[:, :-1], onehot[:, 1:])
    lines = max(1, int(on.sum()))
    for step in range(1, steps + 1):
        bad = x @ w
        emit = np.stack([sigmoid(-bad), sigmoid(bad)], axis=2)
        pull = np.exp(links)
        f, b = np.zeros((docs, n, 2)), np.ones((docs, n, 2))
        f[:, 0] = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, n):
            f[:, t] = (f[:, t - 1] @ pull) * emit[:, t]
            f[:, t] /= f[:, t].sum(axis=1, keepdims=True)
        pairs = np.zeros((2, 2))
        for t in range(n - 2, -1, -1):
            live = on[:, t + 1, None]
            back = (emit[:, t + 1] * b[:, t + 1]) @ pull.T
            b[:, t] = np.where(live, back / back.sum(axis=1, keepdims=True), 1.0)
            joint = f[:, t, :, None] * pull * (emit[:, t + 1] * b[:, t + 1])[:, None, :]
            pairs += ((joint / joint.sum(axis=(1, 2), keepdims=True)) * live[..., None]).sum(axis=0)
        both = f * b
        p_bad = both[..., 1] / both.sum(axis=2)
        slope = np.concatenate([np.einsum("dt,dtk->k", (p_bad - y) * on, x) / lines + l2 * w, ((pairs - seen_links) / lines + l2 * links).ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.99 * moments[1] + 0.01 * slope**2
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w -= move[:width]
        links -= move[width:].reshape(2, 2)
    return w, links


@dataclass(frozen=True)
class LineField:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    links: np.ndarray
    scale: float
    shift: float
    prior: float

    def good_lines(self, features: np.ndarray) -> np.ndarray:
        bad = ((features - self.mean) / self.spread) @ self.weights[:-1] + self.weights[-1]
        return marginals(bad, self.links)

    def bad_lines(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Each line's score for bad and its length; of a block of lines only these numbers are kept."""
        w = self.weights[:-1] / self.spread
        parts = np.stack([w[:OWN], w[OWN : 2 * OWN], w[2 * OWN : 3 * OWN]], axis=1)
        made = [(x @ parts, n) for x, n in own_features(text)]
        if not made:
            return np.zeros(0), np.zeros(0)
        own, lengths = np.vstack([m[0] for m in made]), np.concatenate([m[1] for m in made])
        bad = own[:, 0] + self.weights[-1] - float(self.mean @ w)
        bad[1:] += own[:-1, 1]
        bad[:-1] += own[1:, 2]
        bad[0] += w[3 * OWN]
        bad[-1] += w[3 * OWN + 1]
        return bad, lengths

    def logit(self, good: np.ndarray, lengths: np.ndarray) -> float:
        share = float((good * lengths).sum() / lengths.sum())
        return float(np.log((share + 1e-3) / (1 - share + 1e-3)))

    def raw(self, features: np.ndarray, lengths: np.ndarray) -> float:
        return self.logit(self.good_lines(features), lengths)

    def score(self, text: str | None) -> float:
        bad, lengths = self.bad_lines(text)
        if not len(lengths) or not self.weights.any():
            return self.prior
        return float(sigmoid(np.array(self.scale * self.logit(marginals(bad, self.links), lengths) + self.shift)))


def fit(sample: DataFrame, sample_lines: int = 512) -> LineField:
    """Fit on a bounded sample (doc_id, text, label); label 1 is good. ``sample_lines`` bounds the lines taken of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = [document_features(t, sample_lines) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([m[0].astype(np.float32).tobytes() for m in made], pa.binary()), pa.array([m[1].tobytes() for m in made], pa.binary())],
                names=["doc_id", "label", "rows", "lengths"],
            )

    found = sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "text").mapInArrow(run, "doc_id long, label int, rows binary, lengths binary").collect()
    found.sort(key=lambda r: (r.doc_id, bytes(r.rows)))
    labels = np.array([r.label for r in found], np.float64)
    prior = float(labels.mean()) if len(labels) else 0.5
    docs = [(np.frombuffer(r.rows, np.float32).reshape(-1, WIDTH).astype(np.float64), np.frombuffer(r.lengths, np.float64), r.label) for r in found]
    docs = [d for d in docs if len(d[1])]
    flat = LineField(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + 1), np.zeros((2, 2)), 1.0, 0.0, prior)
    if len(docs) < 8 or not 0 < prior < 1:
        return flat
    every = np.vstack([d[0] for d in docs])
    mean, spread = every.mean(axis=0), every.std(axis=0) + 1e-3
    rows = [(d[0] - mean) / spread for d in docs]
    bad = np.concatenate([np.full(len(d[1]), 1.0 - d[2]) for d in docs])
    single = fit_logistic(np.vstack(rows), bad, l2=1e-3)
    states = []
    for d, x in zip(docs, rows, strict=True):
        raw = x @ single[:-1] + single[-1]
        states.append((raw >= min(0.0, raw.max())).astype(int) if d[2] == 0 else np.zeros(len(x), int))
    # Very long chains would pad all others, so training takes chains in runs of at most 64 lines.
    cut = [(x[i : i + 64], s[i : i + 64]) for x, s in zip(rows, states, strict=True) for i in range(0, len(x), 64)]
    weights, links = train_chain([c[0] for c in cut], [c[1] for c in cut])
    field = LineField(mean, spread, weights, links, 1.0, 0.0, prior)
    raw = np.array([field.raw(d[0], d[1]) for d in docs])
    scale, shift = fit_logistic(raw[:, None], np.array([d[2] for d in docs], np.float64), l2=1e-4)
    return LineField(mean, spread, weights, links, float(scale), float(shift), prior)


def classify(documents: DataFrame, labels: DataFrame, sample_rows: int = 1500, sample_lines: int = 512, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; fitted on labels outside the held-out fold.

    ``sample_rows`` bounds the labelled rows that the field is fitted on, ``sample_lines`` the lines of each.
    """
    ship(documents.sparkSession)
    sample = labelled_sample(documents, labels, "quality", sample_rows, crc_fold(F.col("doc_id"), folds) != held)
    sent = documents.sparkSession.sparkContext.broadcast(fit(checkpointed(sample), sample_lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in slices(batches, "text"):
            score = np.array([field.score(t) for t in batch.column("text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_fold(F.col("doc_id"), folds) == held).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
