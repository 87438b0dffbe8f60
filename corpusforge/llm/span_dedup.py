"""Repeated spans removed by suffix automata of reference shards.

A word goes if it lies in a window of 13 consecutive words whose sequence also starts in a document with a smaller id.

1. Repeated texts: of documents with the same words the one with the smallest id is looked at; in the others every window
   is found there.
2. Anchors: of each window the least hash of its 8-word sequences. Equal windows have the same anchor, and one anchor serves
   several windows. Those that stand in more than one document are kept as a bit table of fixed size; a full table only
   lets more windows pass. Runs of words with such windows are written, and no text moves.
3. Windows of runs are grouped by hash. The first document of a hash that several have is the *reference*, so each
   repeated window is referred to in one document, however many repeat it. References are dealt into shards of bounded size; a window
   of a later document is looked for in the shard that has its hash, so work grows with what is repeated, not with documents times shards.
4. Of each shard's reference spans one suffix automaton over words is built; each state knows the smallest document in which its
   sequences end. Automata are broadcast while all of them together stay under a limit in bytes; beyond it each is sent to the tasks that its shard's
   documents are dealt to (several if there are many).
5. Documents' spans are streamed through the automaton for matching statistics: the longest sequence that ends at a word and is in the
   reference. Where it has 13 words or more, and the sequence of these 13 is in a document with a smaller id, they are covered.
   So hashes only propose windows; the automaton decides on words.

Words go by 64-bit hashes inside of automata.

Defined cases: a null or empty text has no words; a document of fewer than 13 words keeps them; windows of rows with one id don't remove each
other; a row without an id loses nothing and isn't a reference; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import slices
from corpusforge.llm.wordcodes import WordCodes, as_bytes, flat, long_lists, mixed
from corpusforge.session import checkpoint_folder, checkpointed, removed, ship

WINDOW, GRAM = 13, 8
#: Bits of the tables of repeated anchors and of documents that are looked at (8 MB each).
BITS = 26
NO_WORDS = hashlib.sha256(b"").hexdigest()


def _coded(codes: WordCodes, texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, hashes of all in a row, and lengths."""
    words = [t.split() for t in texts]
    hashes, _ = codes.encoded([w for own in words for w in own])
    return words, hashes, np.array([len(w) for w in words], np.int64)


def _windows(x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window that lies within a text: its place in ``x``, its hash, its anchor and its text's number."""
    if len(x) < WINDOW:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    two = mixed(x[:-1], x[1:])
    four = mixed(two[:-2], two[2:])
    eight = mixed(four[:-4], four[4:])
    whole = mixed(eight[:-5], eight[5:])
    gram = mixed(four[:-1], four[1:])
    anchor = gram[: len(whole)].copy()
    for i in range(1, WINDOW - GRAM + 1):
        np.minimum(anchor, gram[i : i + len(whole)], out=anchor)
    text = np.repeat(np.arange(len(lengths)), lengths)
    at = np.flatnonzero(text[: len(whole)] == text[WINDOW - 1 :])
    return at, whole[at], anchor[at], text[at]


def _cell(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _table(cells: DataFrame, bits: int) -> np.ndarray:
    """One bit for each cell (``cell`` column) that is there: 2^bits / 8 bytes at most."""
    found = np.zeros(max(4096, (1 << bits) >> 3), np.uint8)
    cells = cells.select((F.col("cell") + 1).alias("cell"))
    for block, bitmap in cells.groupBy(F.bitmap_bucket_number("cell")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell"))).collect():
        found[(block - 1) * 4096 : block * 4096] = np.frombuffer(bitmap, np.uint8)
    return found


def _on(table: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (table[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1


def _id_cell(doc_id: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id), 64 - bits)


def _keyed(documents: DataFrame, text_col: str, id_col: str, bits: int) -> DataFrame:
    """(doc_id, text_key, id_cell, text)"""
    doc_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return documents.select(doc_id.alias("doc_id"), F.xxhash64(text).alias("text_key"), _id_cell(doc_id, bits).alias("id_cell"), text.alias("text"))


def _read(rows: DataFrame) -> DataFrame:
    """(doc_id, text_key, id_cell, n_words, whole, anchors): whole is the digest of all words, anchors are distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in slices(batches, "text"):
            words, x, lengths = _coded(codes, as_bytes(batch.column("text")))
            _, _, anchor, text = _windows(x, lengths)
            ends = np.cumsum(np.bincount(text, minlength=len(lengths)))
            own = [np.unique(anchor[a:b]) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
            digests = pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string())
            lists = long_lists(np.concatenate([np.zeros(0, np.uint64), *own]), [len(o) for o in own])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_key", "id_cell")), pa.array(lengths), digests, lists], names=["doc_id", "text_key", "id_cell", "n_words", "whole", "anchors"])

    return rows.mapInArrow(run, "doc_id long, text_key long, id_cell long, n_words long, whole string, anchors array<long>")


def _runs(rows: DataFrame, anchors, looked_at, bits: int) -> DataFrame:
    """(run, doc_id, text_key, at, words): the stretches of words that hold windows with an anchor of the table, and where they begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in slices(batches, "text"):
            batch = batch.take(pa.array(np.flatnonzero(_on(looked_at.value, batch.column("id_cell").to_numpy()))))
            _, x, lengths = _coded(codes, as_bytes(batch.column("text")))
            at, _, anchor, text = _windows(x, lengths)
            kept = np.flatnonzero(_on(anchors.value, _cell(anchor, bits)))
            at, text = at[kept], text[kept]
            first = np.ones(len(at) + 1, bool)
            first[1:-1] = (at[1:] > at[:-1] + WINDOW) | (text[1:] != text[:-1])
            cut = np.flatnonzero(first)
            begins, ends, of = at[cut[:-1]], at[cut[1:] - 1] + WINDOW, text[cut[:-1]]
            starts = np.cumsum(lengths) - lengths
            words = long_lists(np.concatenate([np.zeros(0, np.uint64), *(x[b:e] for b, e in zip(begins, ends, strict=True))]), ends - begins)
            own = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(own), batch.column("text_key").take(own), pa.array((begins - starts[of]).astype(np.int32)), words], names=["doc_id", "text_key", "at", "words"])

    found = rows.where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, text_key long, at int, words array<long>")
    return found.select(F.monotonically_increasing_id().alias("run"), "*")


def _windows_of(runs: DataFrame, repeated=None, bits: int = BITS) -> DataFrame:
    """(h, g, doc_id, run, place) of the windows in each run, if given of those in the table alone; g is half of the anchor, so that h and g have 96 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words"):
            x, lengths = flat(batch.column("words"))
            at, h, anchor, of = _windows(x, lengths)
            if repeated is not None:
                kept = np.flatnonzero(_on(repeated.value, _cell(h, bits)))
                at, h, anchor, of = at[kept], h[kept], anchor[kept], of[kept]
            place = (at - (np.cumsum(lengths) - lengths)[of]).astype(np.int32)
            own = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(anchor.astype(np.uint32).view(np.int32)), batch.column("doc_id").take(own), batch.column("run").take(own), pa.array(place)], names=["h", "g", "doc_id", "run", "place"]
            )

    return runs.mapInArrow(run, "h long, g int, doc_id long, run long, place int")


def _spans(asked: DataFrame) -> DataFrame:
    """(reference, shard, doc_id, text_key, start, words): the stretches of a run that hold the asked windows of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words", 4 << 20):
            x, lengths = flat(batch.column("words"))
            ends = np.cumsum(lengths)
            docs, keys, ats = (batch.column(c).to_pylist() for c in ("doc_id", "text_key", "at"))
            made: list[tuple] = []
            parts: list[np.ndarray] = []
            for i, windows in enumerate(batch.column("windows")):
                own, some = x[ends[i] - lengths[i] : ends[i]], windows.values
                w = np.stack([some.field(f).cast(pa.int64()).to_numpy() for f in ("reference", "shard", "place")], axis=1)
                w = w[np.lexsort((w[:, 2], w[:, 1], w[:, 0]))]
                cut = np.flatnonzero(np.concatenate([[True], (w[1:, :2] != w[:-1, :2]).any(axis=1) | (w[1:, 2] > w[:-1, 2] + WINDOW), [True]]))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    made.append((bool(w[a, 0]), int(w[a, 1]), docs[i], keys[i], ats[i] + int(w[a, 2])))
                    parts.append(own[w[a, 2] : w[b - 1, 2] + WINDOW])
            columns = list(zip(*made, strict=True)) if made else [[]] * 5
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            words = long_lists(np.concatenate([np.zeros(0, np.uint64), *parts]), [len(p) for p in parts])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), words], names=["reference", "shard", "doc_id", "text_key", "start", "words"])

    return asked.mapInArrow(run, "reference boolean, shard long, doc_id long, text_key long, start int, words array<long>")


def _held(rows: DataFrame, table) -> DataFrame:
    """The rows whose ``id_cell`` is in the table, so that other texts don't move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(np.flatnonzero(_on(table.value, batch.column("id_cell").to_numpy()))))

    return rows.mapInArrow(run, rows.schema)


class Automaton:
    """A suffix automaton of several word sequences. ``doc[s]`` is the smallest document in which the sequences of state s end."""

    def __init__(self, words: np.ndarray, length: list[int], link: list[int], doc: list[int], step: dict[int, int]) -> None:
        self.words, self.length, self.link, self.doc, self.step = words, length, link, doc, step

    @classmethod
    def built(cls, spans: list[tuple[int, np.ndarray]]) -> Automaton:
        """From (document, hashes)."""
        words = np.unique(np.concatenate([w for _, w in spans]))
        n, length, link, doc, nexts = len(words), [0], [-1], [np.iinfo(np.int64).max], [{}]

        def copied(of: int, p: int, c: int) -> int:
            """A state for the sequences of ``of`` that follow from ``p`` on; ``p`` and its suffixes lead there from now on."""
            length.append(length[p] + 1)
            link.append(link[of])
            doc.append(doc[of])
            nexts.append(dict(nexts[of]))
            link[of] = new = len(length) - 1
            while p >= 0 and nexts[p].get(c) == of:
                nexts[p][c] = new
                p = link[p]
            return new

        for own, span in spans:
            last = 0
            for c in np.searchsorted(words, span).tolist():
                p, q = last, nexts[last].get(c)
                if q is not None:
                    last = q if length[q] == length[p] + 1 else copied(q, p, c)
                else:
                    length.append(length[p] + 1)
                    link.append(0)
                    doc.append(own)
                    nexts.append({})
                    last = len(length) - 1
                    while p >= 0 and c not in nexts[p]:
                        nexts[p][c] = last
                        p = link[p]
                    if p >= 0:
                        q = nexts[p][c]
                        link[last] = q if length[q] == length[p] + 1 else copied(q, p, c)
                doc[last] = min(doc[last], own)
        for s in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
            doc[link[s]] = min(doc[link[s]], doc[s])
        return cls(words, length, link, doc, {s * n + c: t for s, row in enumerate(nexts) for c, t in row.items()})

    def stored(self) -> bytes:
        parts = [self.words, *(np.array(x, np.int64) for x in (self.length, self.link, self.doc, list(self.step), list(self.step.values())))]
        return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(p.tobytes() for p in parts)

    @classmethod
    def loaded(cls, stored: bytes) -> Automaton:
        sizes, at = np.frombuffer(stored, np.int64, 6), 48
        parts = []
        for i, n in enumerate(sizes):
            parts.append(np.frombuffer(stored, np.uint64 if i == 0 else np.int64, n, at))
            at += 8 * int(n)
        return cls(parts[0], parts[1].tolist(), parts[2].tolist(), parts[3].tolist(), dict(zip(parts[4].tolist(), parts[5].tolist(), strict=True)))

    def covered(self, own: int, span: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
        """Maximal stretches of windows that are in a document smaller than ``own``."""
        words, length, link, doc, step = self.words, self.length, self.link, self.doc, self.step
        n, state, matched = len(words), 0, 0
        found: list[tuple[int, int]] = []
        at = np.minimum(np.searchsorted(words, span), n - 1)
        for i, c in enumerate(np.where(words[at] == span, at, -1).tolist()):
            if c < 0:
                state = matched = 0
                continue
            while (to := step.get(state * n + c)) is None and state:
                state = link[state]
                matched = length[state]
            state, matched = (to, matched + 1) if to is not None else (0, 0)
            # The state of the last ``window`` words, if so many are matched.
            while state and length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            if matched >= window and doc[state] < own:
                start = i + 1 - window
                if found and found[-1][1] >= start:
                    found[-1] = (found[-1][0], i + 1)
                else:
                    found.append((start, i + 1))
        return found


COVERED = "doc_id long, text_key long, first int, last int"


def _streamed(spans: pa.RecordBatch | pa.Table, automaton) -> pa.RecordBatch:
    made = []
    columns = [spans.column(c).to_pylist() for c in ("shard", "doc_id", "text_key", "start")]
    for i, (shard, doc, key, start) in enumerate(zip(*columns, strict=True)):
        words = spans.column("words")[i].values.to_numpy().view(np.uint64)
        made += [(doc, key, start + a, start + b) for a, b in automaton(shard).covered(doc, words)]
    rows = list(zip(*made, strict=True)) if made else [[]] * 4
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["doc_id", "text_key", "first", "last"])


def _automata(spans: DataFrame) -> DataFrame:
    """(shard, stored): one automaton a shard."""

    def run(key, table):
        some = [(d, table.column("words")[i].values.to_numpy().view(np.uint64)) for i, d in enumerate(table.column("doc_id").to_pylist())]
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "stored": pa.array([Automaton.built(some).stored()], pa.binary())})

    return spans.where("reference").select("shard", "doc_id", "words").groupBy("shard").applyInArrow(run, "shard long, stored binary")


def _matched(spans: DataFrame, broadcast_bytes: int, slice_windows: int) -> DataFrame:
    """(doc_id, text_key, first, last): the covered stretches."""
    spark = spans.sparkSession
    automata = checkpointed(_automata(spans))
    later = spans.where("NOT reference")
    if (automata.agg(F.sum(F.octet_length("stored"))).first()[0] or 0) <= broadcast_bytes:
        held = spark.sparkContext.broadcast({r.shard: bytes(r.stored) for r in automata.toLocalIterator()})

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded: dict[int, Automaton] = {}

            def automaton(shard: int) -> Automaton:
                if shard not in loaded:
                    loaded[shard] = Automaton.loaded(held.value[shard])
                return loaded[shard]

            for batch in slices(batches, "words"):
                yield _streamed(batch, automaton)

        return later.select("shard", "doc_id", "text_key", "start", "words").mapInArrow(stream, COVERED)

    def meet(left, right):
        if not left.num_rows:
            return pa.Table.from_batches([], schema=pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))
        automaton = Automaton.loaded(right.column("stored")[0].as_py())
        return pa.Table.from_batches([_streamed(left.combine_chunks(), lambda _: automaton)])

    # A shard that many documents repeat is dealt to several tasks, and its automaton goes to each.
    sizes = checkpointed(later.groupBy("shard").agg(F.ceil(F.sum(F.size("words")) / slice_windows).cast("long").alias("n_slices")))
    slot = F.pmod(F.xxhash64("doc_id", "text_key", "start"), F.col("n_slices")).alias("slot")
    dealt = later.join(sizes, "shard").select("shard", slot, "doc_id", "text_key", "start", "words")
    sent = automata.join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slices") - 1)).alias("slot"), "stored")
    return dealt.groupBy("shard", "slot").cogroup(sent.groupBy("shard", "slot")).applyInArrow(meet, COVERED)


def _cut(texts: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_removed, kept_sha256) of texts with covered stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, digests = [], []
            for text, stretches in zip(as_bytes(batch.column("text")), batch.column("stretches").to_pylist(), strict=True):
                words = text.split()
                kept = np.ones(len(words), bool)
                for s in stretches:
                    kept[s["first"] : s["last"]] = False
                counts.append(len(words) - int(kept.sum()))
                digests.append(hashlib.sha256(b" ".join(words[i] for i in np.flatnonzero(kept))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "text_key", "n_removed", "kept_sha256"])

    return texts.mapInArrow(run, "doc_id long, text_key long, n_removed long, kept_sha256 string")


def _written(rows: DataFrame, path: str) -> DataFrame:
    """The rows as a table; what their shuffles left on disk goes at once, not when the driver collects its garbage."""
    spark, setting = rows.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.parquet(path)


def covered_spans(rows: DataFrame, read: DataFrame, known: DataFrame, folder: str, bits: int, shard_words: int, broadcast_bytes: int, slice_windows: int) -> DataFrame:
    """(doc_id, text_key, first, last) of the covered stretches in texts whose words no smaller document has as a whole."""
    broadcast = rows.sparkSession.sparkContext.broadcast
    owners = known.where("doc_id = owner")
    looked_at = broadcast(_table(owners.select(F.col("id_cell").alias("cell")), bits))
    anchors = _held(read.select("id_cell", "anchors"), looked_at).select(F.explode("anchors").alias("a")).groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    anchors = _written(anchors, f"{folder}/anchors")
    table = broadcast(_table(anchors.select(F.shiftrightunsigned("a", 64 - bits).alias("cell")), bits))
    runs = _written(_runs(rows, table, looked_at, bits), f"{folder}/runs")
    for done in ("read", "anchors"):
        removed(rows.sparkSession, f"{folder}/{done}")
    firsts = _windows_of(runs).groupBy("h", "g").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
    firsts = _written(firsts, f"{folder}/firsts")
    # A reference document lies in one shard; a very long one in several, by the windows' hashes.
    shards = max(1, -(-firsts.count() // shard_words))
    long = known.where(F.col("n_words") > 4 * shard_words).groupBy("doc_id").agg(F.max(F.ceil(F.col("n_words") / (4 * shard_words))).cast("long").alias("parts"))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod("h", "parts"))
    firsts = firsts.join(long.withColumnRenamed("doc_id", "low"), "low", "left").select("h", "g", "low", F.pmod(F.xxhash64("low", part), F.lit(shards)).alias("shard"))
    repeated = broadcast(_table(firsts.select(F.shiftrightunsigned("h", 64 - bits).alias("cell")), bits))
    both = _windows_of(runs, repeated, bits).join(firsts, ["h", "g"]).select("run", (F.col("doc_id") == F.col("low")).alias("reference"), "shard", "place")
    both = _written(both, f"{folder}/asked")
    asked = both.groupBy("run").agg(F.collect_set(F.struct("reference", "shard", "place")).alias("windows"))
    spans = _written(_spans(runs.join(asked, "run")), f"{folder}/spans")
    for done in ("runs", "firsts", "asked"):
        removed(rows.sparkSession, f"{folder}/{done}")
    return _matched(spans, broadcast_bytes, slice_windows)


def without_repeats(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", bits: int = BITS, shard_words: int = 50_000, broadcast_bytes: int = 64 << 20, slice_windows: int = 1_000_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row.

    ``bits`` sizes the two tables, ``shard_words`` the reference shards, ``broadcast_bytes`` bounds what is broadcast, and ``slice_windows`` is how
    many words of one shard's documents a task gets beyond that.
    """
    spark = ship(documents.sparkSession)
    folder = f"{checkpoint_folder(spark)}/spans-{uuid.uuid4().hex}"
    rows = _keyed(documents, text_col, id_col, bits)
    read = _written(_read(rows), f"{folder}/read")
    owner = read.groupBy("whole").agg(F.min("doc_id").alias("owner"))
    known = _written(read.drop("anchors").join(owner, "whole"), f"{folder}/known")
    covered = covered_spans(rows, read, known, folder, bits, shard_words, broadcast_bytes, slice_windows)
    stretches = checkpointed(covered.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "last")).alias("stretches")))
    hit = spark.sparkContext.broadcast(_table(stretches.select(_id_cell(F.col("doc_id"), bits).alias("cell")), bits))
    cut = _cut(_held(rows, hit).select("doc_id", "text_key", "text").join(stretches, ["doc_id", "text_key"])).dropDuplicates(["doc_id", "text_key"])
    copied = (F.col("doc_id") > F.col("owner")) & (F.col("n_words") >= WINDOW)
    found = known.join(cut, ["doc_id", "text_key"], "left").select(
        "doc_id", "n_words", F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(NO_WORDS)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )
    found = checkpointed(found)
    removed(spark, folder)
    return found
