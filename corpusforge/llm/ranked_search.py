"""Ranked lexical search over K2-treaps.

1. Each task that reads documents cuts them into shards of a bounded number of words and builds one treap for each: a quadtree over the
   grid of the shard's terms (rows, the most frequent first) and documents (columns, by id). A cell that holds a posting is a node;
   it stores which of its four quarters hold one, and the greatest impact in it as the difference to its parent's (nothing where it is an
   only child). Documents don't move, and every document with a word is in the index.
2. An impact is what a term's weight is multiplied by in the score, so cells don't depend on a query, and a row's weight times a cell's
   maximum is never less than what the row adds to the score of any document in the cell.
3. A search goes through all shards. For one item the paths of all its terms' rows go down together, from the whole range of documents to its halves: a range's
   bound is the sum of its rows' bounds, and ranges with the greatest bounds are opened first, some at a time. At one
   document the bound is its score. Ranges that can't reach the best documents so far (of all shards a task has seen) are left out.

Items are searched in blocks of bounded size, so what is broadcast is bounded, too.

Defined cases: a null or empty text has no terms and is in no result; documents without an id are ranked after all others of equal score;
repeated rows are ranked each; items without an id or terms are ignored, and several rows of one item id are one item; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import slices
from corpusforge.llm.wordcodes import as_bytes
from corpusforge.session import checkpointed, ship

#: Everything of ASCII but digits and letters separates terms; A-Z are lower-cased.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_POP = np.array([bin(m).count("1") for m in range(16)], np.int64)
#: How many children of a node with this mask stand before a quarter.
_BEFORE = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], np.int64)
NO_ID = np.iinfo(np.int64).max


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def impacts(tf: np.ndarray, cols: np.ndarray, sizes: np.ndarray, documents: int, words: int) -> np.ndarray:
    """What a term's weight is multiplied by, for its number in the document of this column; ``sizes`` are the documents' words."""
    m = np.array([50 + 50 * int(n) * documents // words for n in sizes], np.int64)[cols]
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _spread(x: np.ndarray) -> np.ndarray:
    """The low 32 bits, each with a zero before it."""
    x = x.astype(np.uint64)
    for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(by))) & np.uint64(mask)
    return x


def built(rows: np.ndarray, cols: np.ndarray, impact: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """(height, greatest impact, masks, differences) of a treap over distinct points."""
    height = max(1, int(max(rows.max(), cols.max())).bit_length())
    codes = (_spread(rows) << np.uint64(1)) | _spread(cols)
    order = np.argsort(codes)
    codes, values = codes[order], impact[order].astype(np.uint32)
    masks, less = [], []
    for _ in range(height):
        above = codes >> np.uint64(2)
        starts = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
        greatest = np.maximum.reduceat(values, starts)
        children = np.diff(np.append(starts, len(codes)))
        masks.append(np.bitwise_or.reduceat(np.left_shift(1, (codes & np.uint64(3)).astype(np.int64)), starts).astype(np.uint8))
        less.append((np.repeat(greatest, children) - values)[np.repeat(children, children) > 1])
        codes, values = above[starts], greatest
    return height, int(values[0]), np.concatenate(masks[::-1]).tobytes(), np.concatenate(less[::-1]).tobytes()


class Treap:
    """A treap in memory. Nodes of all levels are numbered through; the last number is the empty node."""

    def __init__(self, height: int, greatest: int, masks: bytes, less: bytes) -> None:
        stored, gaps = np.frombuffer(masks, np.uint8), np.frombuffer(less, np.uint32)
        at = used = 0
        values, firsts, level = [np.array([greatest], np.int64)], [], 1
        for _ in range(height):
            children = _POP[stored[at : at + level]]
            firsts.append(at + level + np.cumsum(children) - children)
            held = np.repeat(values[-1], children)
            several = np.repeat(children, children) > 1
            n = int(several.sum())
            held[several] -= gaps[used : used + n]
            at, used, level = at + level, used + n, len(held)
            values.append(held)
        self.height = height
        self.masks = np.concatenate([stored, np.zeros(level + 1, np.uint8)])
        self.first = np.concatenate([*firsts, np.zeros(level + 1, np.int64)])
        self.greatest = np.concatenate([*values, [0]])
        self.empty = len(self.greatest) - 1

    def children(self, nodes: np.ndarray, row_bits: np.ndarray, half: int) -> np.ndarray:
        """The nodes of the rows' quarters in one half of the columns."""
        quarter, masks = row_bits * 2 + half, self.masks[nodes]
        return np.where((masks >> quarter) & 1, self.first[nodes] + _BEFORE[masks, quarter], self.empty)


class Best:
    """The k greatest scores so far, equal ones by document."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.docs = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        scores, docs = np.concatenate([self.scores, scores]), np.concatenate([self.docs, docs])
        order = np.lexsort((docs, -scores))[: self.k]
        self.scores, self.docs = scores[order], docs[order]

    def admits(self, bounds: np.ndarray, first_docs: np.ndarray) -> np.ndarray:
        """Whether a range with this bound, that begins with this document, can change the result."""
        if len(self.scores) < self.k:
            return bounds > 0
        return (bounds > self.scores[-1]) | ((bounds == self.scores[-1]) & (first_docs < self.docs[-1]))


def descend(treap: Treap, docs: np.ndarray, rows: np.ndarray, weights: np.ndarray, best: Best, width: int = 128) -> None:
    """Open ranges of documents best-first, ``width`` at a time; the rows' paths go down together."""
    height = treap.height
    nodes = np.zeros((1, len(rows)), np.int64)
    bounds, levels, cols = (weights * treap.greatest[nodes]).sum(axis=1), np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        live = np.flatnonzero(best.admits(bounds, docs[cols << (height - levels)]))
        if not len(live):
            return
        if len(live) > width:
            live = live[np.argsort(-bounds[live], kind="stable")]
        opened, rest = live[:width], live[width:]
        bits = (rows[None, :] >> (height - 1 - levels[opened])[:, None]) & 1
        new = [(treap.children(nodes[opened], bits, half), levels[opened] + 1, cols[opened] * 2 + half) for half in (0, 1)]
        grown = np.concatenate([n for n, _, _ in new])
        below, right = (np.concatenate([x[i] for x in new]) for i in (1, 2))
        sums = (weights * treap.greatest[grown]).sum(axis=1)
        done = (below == height) & (sums > 0)
        if done.any():
            best.add(sums[done], docs[right[done]])
        on = (below < height) & (sums > 0)
        bounds, levels, cols, nodes = np.concatenate([bounds[rest], sums[on]]), np.concatenate([levels[rest], below[on]]), np.concatenate([cols[rest], right[on]]), np.concatenate([nodes[rest], grown[on]])


def totals(documents: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """How many documents have terms, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = words = 0
        for batch in slices(batches, "text"):
            sizes = [len(terms_of(t)) for t in as_bytes(batch.column("text"))]
            docs, words = docs + sum(n > 0 for n in sizes), words + sum(sizes)
        yield pa.RecordBatch.from_pydict({"docs": pa.array([docs], pa.int64()), "words": pa.array([words], pa.int64())})

    ship(documents.sparkSession)
    row = documents.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "docs long, words long").agg(F.sum("docs"), F.sum("words")).first()
    return row[0] or 0, row[1] or 0


INDEX = "docs array<long>, terms string, held array<int>, height int, greatest long, masks binary, less binary"


def _shard(ids: list[int], numbers: list[np.ndarray], vocabulary: list[bytes], n_docs: int, n_words: int) -> pa.RecordBatch:
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    numbers = [numbers[i] for i in order]
    sizes = np.array([len(x) for x in numbers], np.int64)
    keys = (np.repeat(np.arange(len(sizes)), sizes) << 32) | np.concatenate(numbers)
    keys, tf = np.unique(keys, return_counts=True)
    cols, number = keys >> 32, keys & 0xFFFFFFFF
    held = np.bincount(number, minlength=len(vocabulary))
    by_use = np.argsort(-held, kind="stable")
    row_of = np.empty(len(vocabulary), np.int64)
    row_of[by_use] = np.arange(len(vocabulary))
    height, greatest, masks, less = built(row_of[number], cols, impacts(tf, cols, sizes, n_docs, n_words))
    held = held[by_use]
    schema = pa.schema([("docs", pa.list_(pa.int64())), ("terms", pa.string()), ("held", pa.list_(pa.int32())), ("height", pa.int32()), ("greatest", pa.int64()), ("masks", pa.binary()), ("less", pa.binary())])
    row = {"docs": [np.array(ids, np.int64)[order]], "terms": [b" ".join(vocabulary[i] for i in by_use).decode()], "held": [held.astype(np.int32)], "height": [height], "greatest": [greatest], "masks": [masks], "less": [less]}
    return pa.RecordBatch.from_pydict(row, schema=schema)


def index(documents: DataFrame, n_docs: int, n_words: int, shard_words: int = 1 << 19, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a shard: its documents, terms with the number of documents they are in, and its treap. Every document with a term is in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh():
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            return number, [], [], 0

        number, ids, held, size = fresh()
        for batch in slices(batches, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                words = terms_of(text)
                if not words:
                    continue
                ids.append(NO_ID if doc is None else doc)
                held.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                size += len(words)
                if size >= shard_words:
                    yield _shard(ids, held, list(number), n_docs, n_words)
                    number, ids, held, size = fresh()
        if ids:
            yield _shard(ids, held, list(number), n_docs, n_words)

    ship(documents.sparkSession)
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, INDEX)


def blocks(items: DataFrame, most_bytes: int = 4 << 20) -> Iterator[dict[str, list[bytes]]]:
    """Items with their terms, in blocks of about so many bytes of text."""
    block: dict = {}
    size = 0
    for row in items.toLocalIterator():
        terms = sorted({t for text in row.texts for t in terms_of(text.encode())})
        if terms:
            block[row.item_id] = terms
            size += sum(map(len, terms)) + 64 * len(terms)
        if size >= most_bytes:
            yield block
            block, size = {}, 0
    if block:
        yield block


def _frequencies(stored: DataFrame, terms) -> dict[str, int]:
    """In how many documents each of the broadcast terms is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = terms.value
        for batch in batches:
            for words, held in zip(batch.column("terms").to_pylist(), batch.column("held"), strict=True):
                found = [(t, i) for i, t in enumerate(words.encode().split(b" ")) if t in wanted]
                counts = held.values.to_numpy()[[i for _, i in found]] if found else np.zeros(0)
                yield pa.RecordBatch.from_pydict({"term": pa.array([t.decode() for t, _ in found], pa.string()), "df": pa.array(counts, pa.int64())})

    return {r.term.encode(): r.df for r in stored.select("terms", "held").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator()}


def search(stored: DataFrame, items: DataFrame, n_docs: int, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents. ``items`` has item_id and texts, ``stored`` is an index that is written."""
    spark, found = stored.sparkSession, None
    for block in blocks(items):
        terms = spark.sparkContext.broadcast({t for own in block.values() for t in own})
        df = _frequencies(stored, terms)
        weighted = {item: [(t, weight(df[t], n_docs)) for t in own if t in df] for item, own in block.items()}
        part = _searched(stored, spark.sparkContext.broadcast(weighted), k, items.schema["item_id"].dataType.simpleString())
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _searched(stored: DataFrame, weighted, k: int, id_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: Best(k) for item in weighted.value}
        wanted = {t for own in weighted.value.values() for t, _ in own}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("docs", "terms", "height", "greatest", "masks", "less")}
                treap = Treap(row["height"].as_py(), row["greatest"].as_py(), row["masks"].as_py(), row["less"].as_py())
                docs = row["docs"].values.to_numpy()
                row_of = {t: r for r, t in enumerate(row["terms"].as_py().encode().split(b" ")) if t in wanted}
                for item, own in weighted.value.items():
                    here = [(row_of[t], w) for t, w in own if t in row_of]
                    if here:
                        rows, weights = np.array(here, np.int64).T
                        descend(treap, docs, rows, weights, best[item])
        for item, b in best.items():
            if len(b.scores):
                ids = pa.array(b.docs, pa.int64(), mask=b.docs == NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(b.docs)), ids, pa.array(b.scores)], names=["item_id", "doc_id", "score"])

    return stored.select("docs", "terms", "height", "greatest", "masks", "less").mapInArrow(run, f"item_id {id_type}, doc_id long, score long")


def ranked(documents: DataFrame, benchmark: DataFrame, k: int = 50, shard_words: int = 1 << 19) -> DataFrame:
    """The k best documents of every item."""
    items = benchmark.where("item_id IS NOT NULL").groupBy("item_id").agg(F.collect_set(F.coalesce("text", F.lit(""))).alias("texts"))
    n_docs, n_words = totals(documents)
    stored = checkpointed(index(documents, n_docs, n_words, shard_words)) if n_words else index(documents.limit(0), 1, 1)
    return search(stored, items, n_docs, k)
