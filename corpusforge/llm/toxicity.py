"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon maps words to classes (insult, threat, target, negation, reported speech, quote, end of clause).
Small transducers each read the classes in order and keep what matters of the clause so far:

- negation: how many of the next words a negation still covers (``SCOPE``);
- reported speech: whether a word of saying opened a span, which lasts to the end of the clause, or to the closing
  quote if a quote follows;
- target: how many of the next words are near a word for somebody (``NEAR``);
- match: an insult or threat that was met less than ``AFTER`` words ago and isn't aimed yet.

Their composition is one transducer, whose states are made when a text first needs them (there are a few
thousand at most). It writes a match with what held when it came: "not an idiot" is a negated insult, "idiot, not" isn't;
a target just before or just after a match aims it. Texts are scored by the weights of their matched clauses,
never by single words; a negated or reported match may speak against toxicity.

The lexicon begins with a few common words and is widened from labelled rows: words and word beginnings
that stand in many different contexts of toxic texts and (almost) none of the others. They are threats if a target
follows most of them, else insults. Words that mostly stand beside matches are targets. Clause weights
come from a logistic regression on the same rows. ``sample_rows`` bounds those rows for each class,
``lexicon_rows`` the learned entries.

Defined cases: a null or empty text has no clause and scores the rest's rate; without labels of both
kinds fixed clause weights apply; repeated rows get the same result each; other columns are ignored; an
empty table gives an empty result. Texts are read whole, however long.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import crc_fold, fit_logistic, labelled_sample, sigmoid, slices
from corpusforge.session import checkpointed, ship

INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, STOP, OTHER = "insult", "threat", "target", "negation", "report", "quote", "stop", "other"
SEEDS = {
    INSULT: "idiot idiots stupid moron morons loser losers scum trash worthless pathetic disgusting imbecile idiota estúpido imbécil idiote connard salaud blöd dummkopf arschloch",
    THREAT: "kill hurt destroy crush strangle tuer frapper töten schlagen matar golpear",
    TARGET: "you your he she they him her them this that these those tu toi vous il elle ils du dich ihr er sie tú usted él ella ellos",
    NEGATION: "not no never neither isn aren wasn don ne pas jamais nicht kein keine nie nunca jamás",
    REPORT: "said says say called calls wrote claimed quoted dit disait appelle sagte sagt nannte dijo dice llamó",
}
TOKENS = re.compile(r"[^\W_]+|[.!?;:\n\"\u00AB\u00BB\u201C\u201D\u201E]")
STOPS = frozenset(".!?;:\n")
QUOTES = frozenset("\"\u00AB\u00BB\u201C\u201D\u201E")
PREFIXES = (4, 5, 6)
SCOPE, NEAR, AFTER = 4, 5, 3
#: A task that learns entries reads so many bytes of texts at once, and holds the terms of so many words.
HELD_BYTES, HELD_WORDS = 1 << 17, 10_000


def negation(left: int, c: str) -> int:
    """How many of the next words the last negation covers."""
    return 0 if c == STOP else SCOPE if c == NEGATION else max(0, left - 1)


def reported(state: str, c: str) -> str:
    """"" or "said" (to the end of the clause) or "quoted" (to the closing quote)."""
    if state == "quoted":
        return "" if c == QUOTE else state
    if c == REPORT:
        return "said"
    if c == QUOTE and state == "said":
        return "quoted"
    return "" if c == STOP else state


def target(left: int, c: str) -> int:
    """How many of the next words are near the last target."""
    return 0 if c == STOP else NEAR if c == TARGET else max(0, left - 1)


State = tuple[int, str, int, str, int]
#: Nothing is negated, reported, near a target, or waiting to be aimed.
START: State = (0, "", 0, "", 0)


def step(state: State, c: str) -> tuple[State, str | None]:
    """The composed transducer: its next state, and the match it writes.

    A match without a target waits for one for ``AFTER`` words, and is written when it has one or the time or clause is over.
    """
    negated, said, near, waiting, left = state
    written = None
    if waiting:
        left -= 1
        if c == TARGET:
            written, waiting = f"{waiting}_aimed", ""
        elif c in (STOP, INSULT, THREAT) or left <= 0:
            written, waiting = waiting, ""
    if c in (INSULT, THREAT):
        mark = "_negated" if negated else "_reported" if said else ""
        if mark or near:
            written_now = c + (mark or "_aimed")
            # What waited is written first; at most one of the two can be lost from one output, so they are joined.
            written = f"{written} {written_now}" if written else written_now
        else:
            waiting, left = c, AFTER
    return (negation(negated, c), reported(said, c), target(near, c), waiting, left if waiting else 0), written


#: Kinds of matches; weights of each kind, of how many there are, and the bias, where nothing is learned.
EVENTS = ("insult", "insult_aimed", "insult_negated", "insult_reported", "threat", "threat_aimed", "threat_negated", "threat_reported")
FIXED = np.array([3.0, 4.0, -1.0, -0.5, 0.0, 2.0, -1.0, -0.5, 0.5, -2.5])


@dataclass
class Grammar:
    """Lexicon and clause weights (the last is the bias)."""

    words: dict[str, str]
    prefixes: dict[str, str]
    weights: np.ndarray
    cache: dict[str, str] = field(default_factory=dict)
    arcs: dict[tuple[State, str], tuple[State, str | None]] = field(default_factory=dict)

    def class_of(self, word: str) -> str:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > 50_000:
                self.cache.clear()
            found = STOP if word in STOPS else QUOTE if word in QUOTES else self.words.get(word) or next((self.prefixes[word[:n]] for n in PREFIXES if word[:n] in self.prefixes), OTHER)
            self.cache[word] = found
        return found

    def clauses(self, text: str | None) -> Counter:
        """How many matches of each kind a text has."""
        classes = list(map(self.class_of, TOKENS.findall((text or "").lower())))
        if INSULT not in classes and THREAT not in classes:
            return Counter()
        out, state, arcs = Counter(), START, self.arcs
        for c in [*classes, STOP]:
            arc = arcs.get((state, c))
            if arc is None:
                arc = arcs[state, c] = step(state, c)
            state, written = arc
            if written:
                out.update(written.split())
        return out

    def vector(self, text: str | None) -> list[float]:
        found = self.clauses(text)
        against = sum(found[e] for e in EVENTS if e.endswith(("_negated", "_reported")))
        return [*(float(found[e] > 0) for e in EVENTS), float(np.log1p(found.total() - against))]

    def score(self, text: str | None) -> float:
        return float(sigmoid(np.array(np.array(self.vector(text)) @ self.weights[:-1] + self.weights[-1])))


def seed_words() -> dict[str, str]:
    return {w: kind for kind, words in SEEDS.items() for w in words.split()}


SEEDED = frozenset(seed_words())


def _terms(word: str) -> list[str]:
    """A word and its beginnings; beginnings end with a star."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


def _contexts(text: str) -> Iterator[pa.RecordBatch]:
    """(term, context) of a text, each pair once in a part of ``HELD_WORDS`` words; a task holds one part at a time."""
    words = [w for w in TOKENS.findall(text.lower()) if w not in STOPS and w not in QUOTES]
    for start in range(0, len(words), HELD_WORDS):
        out: set[tuple[str, str]] = set()
        part = words[max(0, start - 1) : start + HELD_WORDS + 1]
        if start == 0:
            part = ["", *part]
        if start + HELD_WORDS >= len(words):
            part = [*part, ""]
        for before, word, after in zip(part, part[1:], part[2:], strict=False):
            if len(word) > 3:
                context = f"{before} {after}"
                out.update((t, context) for t in _terms(word))
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([c for _, c in out], pa.string())], names=["term", "context"])


def learned_entries(sample: DataFrame, lexicon_rows: int, chance: float = 1e-9, share: float = 0.999) -> list[tuple[str, int, int]]:
    """(term, toxic contexts, other contexts) of terms that mark toxic texts.

    A context is the pair of neighbouring words, so copies of one text count once. A term needs so many
    contexts that they would all fall in toxic texts by accident with less than ``chance``.
    """
    counts = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rate = min(0.9, (counts.get(1, 0) + 1) / (sum(counts.values()) + 1))
    contexts = max(6, int(np.ceil(np.log(chance) / np.log(rate))))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", HELD_BYTES):
            for text in batch.column("text").to_pylist():
                yield from _contexts(text)

    def held(wanted: frozenset[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                out: Counter = Counter()
                for text in batch.column("text").to_pylist():
                    out.update(t for w in TOKENS.findall(text.lower()) for t in _terms(w) if t in wanted)
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["term", "n"])

        return run

    rows = sample.where("label = 1").select("text").mapInArrow(seen, "term string, context string")
    strong = rows.distinct().groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= contexts).orderBy(F.desc("n"), "term").limit(lexicon_rows * 10).collect()
    many = {r.term: r.n for r in strong}
    wanted = frozenset(many)
    others = sample.where("label = 0").select("text").mapInArrow(held(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    against = {r.term: r.n for r in others}
    good = [(t, n, against.get(t, 0)) for t, n in many.items() if n >= share * (n + against.get(t, 0))]
    return sorted(good, key=lambda g: (-g[1], g[0]))[:lexicon_rows]


def beside(sample: DataFrame, words: dict[str, str], prefixes: dict[str, str], learned: list[str], least: int = 6) -> tuple[set[str], list[str]]:
    """Of the learned terms those that a target mostly follows; and the words that mostly stand beside a match.

    Counted over the toxic rows of the sample; "beside" is within two words, "mostly" more than half of at least ``least`` times.
    """
    grammar, wanted = Grammar(words, prefixes, FIXED), frozenset(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            seen: Counter = Counter()
            for text in batch.column("text").to_pylist():
                tokens = TOKENS.findall(text.lower())
                classes = list(map(grammar.class_of, tokens))
                for i, (word, c) in enumerate(zip(tokens, classes, strict=True)):
                    after, near = classes[i + 1 : i + 3], classes[max(0, i - 2) : i + 3]
                    if c == INSULT:
                        seen.update((t, "term", TARGET in after) for t in _terms(word) if t in wanted)
                    elif c == OTHER:
                        seen[word, "word", INSULT in near or THREAT in near] += 1
            rows = list(seen.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([n if k[2] else 0 for k, n in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())],
                names=["term", "kind", "met", "n"],
            )

    counts = sample.where("label = 1").select("text").mapInArrow(run, "term string, kind string, met long, n long").groupBy("term", "kind").agg(F.sum("met").alias("met"), F.sum("n").alias("n"))
    rows = counts.where((F.col("n") >= least) & (2 * F.col("met") > F.col("n"))).orderBy(F.desc("n"), "term").limit(10_000).collect()
    return {r.term for r in rows if r.kind == "term"}, [r.term for r in rows if r.kind == "word"]


def fit(sample: DataFrame, lexicon_rows: int = 2000) -> Grammar:
    """Lexicon and weights from a bounded sample (doc_id, text, label); label 1 is toxic."""
    words, prefixes = seed_words(), {}
    learned = [term for term, _, _ in learned_entries(sample, lexicon_rows)]

    def entered(threats: set[str] = frozenset(), targets=()) -> None:
        for term in learned:
            kind = THREAT if term in threats else INSULT
            if term.endswith("*"):
                prefixes[term[:-1]] = kind
            elif term not in SEEDED:
                words[term] = kind
        for word in targets:
            words.setdefault(word, TARGET)

    entered()
    entered(*beside(sample, dict(words), dict(prefixes), learned))
    grammar = Grammar(words, prefixes, FIXED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = [np.array(grammar.vector(t)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(made, pa.binary())], names=["doc_id", "label", "vector"])

    rows = sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "text").mapInArrow(run, "doc_id long, label int, vector binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.vector)))
    labels = np.array([r.label for r in rows], np.float64)
    if len(rows) < 8 or not 0 < labels.mean() < 1:
        return grammar
    vectors = np.array([np.frombuffer(r.vector) for r in rows])
    return Grammar(words, prefixes, fit_logistic(vectors, labels, l2=1e-3))


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = 2000, folds: int = 5, held: int = 0, lexicon_rows: int = 2000) -> Grammar:
    """Fit on labels outside the held-out fold: at most ``sample_rows`` rows of each class."""
    ship(documents.sparkSession)
    outside = crc_fold(F.col("doc_id"), folds) != held
    taken = [labelled_sample(documents, labels, "toxic", sample_rows, outside & (F.col("label") == v)) for v in (0, 1)]
    return fit(checkpointed(taken[0].union(taken[1])), lexicon_rows)


def classify(documents: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    sent = documents.sparkSession.sparkContext.broadcast(train(documents, labels, folds=folds, held=held, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = sent.value
        for batch in slices(batches, "text"):
            score = np.array([grammar.score(t) for t in batch.column("text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_fold(F.col("doc_id"), folds) == held).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that the grammar doesn't reject, with all their columns."""
    sent = documents.sparkSession.sparkContext.broadcast(train(documents, labels, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = sent.value
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array([grammar.score(t) < 0.5 for t in batch.column("text").to_pylist()], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
