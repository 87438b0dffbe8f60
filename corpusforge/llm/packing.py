"""Harmonic packing of tokenised documents into sequences of fixed length.

Lengths fall into reciprocal-capacity classes: a piece of n tokens is of class k = capacity // n, and a
sequence of class k holds k such pieces, whatever else there is. Pieces of a class are numbered by
slices, so workers fill sequences without each other. A remainder whose class would waste much is cut:
the largest reciprocal part of the capacity goes first, at most ``cuts`` times, and the tail is a piece
of its own. Each class's last, unfilled sequence is taken apart, and those pieces (fewer than k for each
of at most 127 classes, so a bounded number) are packed best fit, longest first.

Pieces are dealt into parts by their row's number in the input's files, so that rows with one id (or none) spread like
any others. Which sequence a piece lies in therefore depends on how the input is split; what holds of it doesn't.

Defined cases: a null or empty text is its end token alone; repeated rows are packed each by itself;
null ids are kept; an empty table gives an empty result; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import kept, parts_for, slices
from corpusforge.session import checkpointed, ship

END_ID = 2
END = np.array([END_ID], "<u4").tobytes()
#: Letters below U+0100 and the ASCII marks behind them.
PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-/:-@\[-`{-~]*)")


class WordCache:
    """Token ids of texts as little-endian bytes, by white-space separated chunks.

    This holds for a tokenizer that drops white space, never joins over it, ignores case and parts letters from the
    marks behind them (``parts_words`` asks its settings): a text's ids are then those of its chunks, and a plain
    word with marks takes the ids of the word and of the marks. Any other tokenizer gets whole texts.
    The last words and chunks are kept, if they have ``longest`` characters at most: twice ``limit`` of each at most, under
    200 MB in a worker (170 MB measured after 100 MB of text).
    """

    def __init__(self, path: str, limit: int = 300_000, longest: int = 48) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.encoder, self.limit, self.longest = Tokenizer.from_file(path), limit, longest
        self.by_words = parts_words(json.loads(self.encoder.to_str()))
        vocabulary = self.encoder.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words, self.chunks = Recent(), Recent()

    def encoded(self, texts: list[str]) -> Iterator[bytes]:
        for start in range(0, len(texts), 4_000):
            for e in self.encoder.encode_batch_fast(texts[start : start + 4_000], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()

    def encoded_words(self, words: list[str], at_once: int = 500) -> Iterator[bytes]:
        """The same for words of letters only: many at once, as the last token of each says that a word ends there."""
        for start in range(0, len(words), at_once):
            some = words[start : start + at_once]
            ids = next(self.encoded([" ".join(some)]))
            cuts = [0, *((np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1) * 4).tolist()]
            if len(cuts) == len(some) + 1:
                yield from (ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
            else:
                yield from self.encoded(some)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_words:
            return [b + END for b in self.encoded([t or "" for t in texts])]
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        new = self.chunks.missing(set().union(*split))
        parted, whole = [], []
        for c in new:
            m = PLAIN.fullmatch(c)
            if m:
                parted.append((c, m[1].lower(), m[2]))
            else:
                whole.append(c)
        plain = list(self.words.missing({word for _, word, _ in parted}))
        others = list(self.words.missing({*whole, *{marks for _, _, marks in parted}}))
        words, chunks = self.words.young, self.chunks.young
        words.update(zip(plain, self.encoded_words(plain), strict=True))
        words.update(zip(others, self.encoded(others), strict=True))
        chunks.update([(c, words[word] + words[marks]) for c, word, marks in parted])
        chunks.update([(c, words[c]) for c in whole])
        out = [b"".join(map(chunks.__getitem__, cs)) + END for cs in split]
        self.words.trim([*plain, *others], self.longest, self.limit)
        self.chunks.trim(new, self.longest, self.limit)
        return out


class Recent:
    """Values by key, in two generations: when the young one is full it becomes the old one, and what is asked for again moves on."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, keys: set[str]) -> set[str]:
        """The keys without a value; those with one are in the young generation afterwards."""
        absent, old = keys.difference(self.young), self.old
        found = {k: old[k] for k in absent if k in old}
        self.young.update(found)
        return absent.difference(found)

    def trim(self, added, longest: int, limit: int) -> None:
        for k in [k for k in added if len(k) > longest]:
            del self.young[k]
        if len(self.young) > limit:
            self.young, self.old = {}, self.young


def parts_words(settings: dict) -> bool:
    """Whether a tokenizer's settings are those that WordCache rests on."""
    normal = settings.get("normalizer") or {}
    steps = [n["type"] for n in normal.get("normalizers", [normal]) if n.get("type")]
    first = ((settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    split = first.get("pattern", {}).get("Regex", "")
    words = "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    return steps == ["NFC", "Replace", "Lowercase"] and first.get("behavior") == "Removed" and first.get("invert") is True and split.endswith(words)


def word_cache(path: str) -> WordCache:
    """The cache of this Python worker, which serves all its tasks that pack, one after the other."""
    return kept(path, lambda: WordCache(path))


def cut_lengths(n: int, capacity: int, cuts: int = 3, waste: float = 0.02) -> list[int]:
    """Piece lengths of a document of n tokens: full sequences, then reciprocal parts, then the tail."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    for _ in range(cuts):
        if not rest or capacity - (capacity // rest) * rest <= waste * capacity:
            break
        part = capacity // (capacity // rest + 1)
        out.append(part)
        rest -= part
    return out + [rest] * (rest > 0)


def pieces(documents: DataFrame, tokenizer: str, capacity: int = 4096, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and row (and the ids, if asked for) of every piece."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(tokenizer)
        for batch in slices(batches, "text", 2 << 20, keeps=tokenizer):
            out: list[list] = [[] for _ in range(6 + with_ids)]
            for doc, row, data in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), cache.ids(batch.column("text").to_pylist()), strict=True):
                total, at = len(data) // 4, 0
                for n in cut_lengths(total, capacity):
                    own = data[4 * at : 4 * (at + n)]
                    for column, value in zip(out, (doc, at, n, zlib.crc32(own), total, row, own), strict=False):
                        column.append(value)
                    at += n
            kinds = [pa.int64()] * 6 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    ship(documents.sparkSession)
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """A bin for each piece, the pieces taken in the given order."""
    room: list[int] = []
    out = np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths):
        fits = [(r, b) for b, r in enumerate(room) if r >= n]
        b = min(fits)[1] if fits else len(room)
        if not fits:
            room.append(capacity)
        room[b] -= int(n)
        out[i] = b
    return out


def pack(documents: DataFrame, tokenizer: str, capacity: int = 4096, parts: int | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every piece with its sequence_id and its offset there.

    A class's pieces are numbered in ``parts`` parts; by default that number grows with the pieces.
    """
    made = checkpointed(pieces(documents, tokenizer, capacity, text_col, id_col))
    parts = parts_for(made.count()) if parts is None else parts
    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    by = [*order, "row"]
    made = made.withColumn("k", F.floor(F.lit(capacity) / F.col("length"))).withColumn("part", F.pmod(F.xxhash64("row", "start"), F.lit(parts)))
    # Numbers within a class: within each of its parts, after the pieces of the parts before.
    counts = made.groupBy("k", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("k", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    classes = counts.groupBy("k").agg(F.floor(F.sum("n") / F.col("k")).alias("bins"))
    base = classes.select("k", "bins", F.coalesce(F.sum("bins").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("bins").over(Window.partitionBy()).cast("long").alias("after"))
    number = F.row_number().over(Window.partitionBy("k", "part").orderBy(*by)) - 1
    placed = made.withColumn("number", number).join(F.broadcast(firsts.join(base, "k")), ["k", "part"]).withColumn("bin", F.floor((F.col("first") + F.col("number")) / F.col("k")))
    full = placed.where("bin < bins").withColumn("sequence_id", F.col("base") + F.col("bin"))
    within = Window.partitionBy("sequence_id").orderBy(F.col("first") + F.col("number"))
    filled = full.withColumn("offset", F.coalesce(F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def finish(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), *[(c, "ascending") for c in by if c != "length"]])
        lengths = rows.column("length").to_numpy()
        own = best_fit(lengths, capacity)
        used, offset = np.zeros(len(own) + 1, np.int64), np.zeros(len(own), np.int64)
        for i, b in enumerate(own):
            offset[i] = used[b]
            used[b] += lengths[i]
        made = {c: rows.column(c) for c in order} | {"sequence_id": pa.array(rows.column("after").to_numpy() + own), "offset": pa.array(offset)}
        return pa.table(made)

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    left = placed.where("bin >= bins").select(*by, "after", F.lit(0).alias("one"))
    tail = left.groupBy("one").applyInArrow(finish, kinds)
    columns = [*order, "sequence_id", "offset"]
    return filled.select(*[F.col(c).cast("long").alias(c) for c in columns]).union(tail.select(*columns))
