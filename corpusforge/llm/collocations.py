"""Phrase collocations by dynamic itemset counting over cyclic shard scans.

1. Documents are split into pieces and words once. Each shard of the corpus holds word hashes by document (0 stands between
   pieces), and the words themselves are stored once for each task that met them.
2. Step t scans shard ``t mod shards``. Words are counted from step 0 on. A phrase of k words becomes active in the first step
   before which both of its parts of k-1 words have been counted ``least`` times, so lengths 1 to 5 are counted in the
   same scans. It is counted for exactly ``shards`` steps, that is once in each shard, and then its count is whole.
3. Which phrases have reached the threshold, and before which step, is told by a table of 2^``bits`` cells that all tasks get: a
   cell has the step in which the first phrase of its hash was there. Its size doesn't depend on the corpus. Phrases that share a cell
   become active early and are counted all the same for one whole cycle; a full table only counts more phrases.
4. It ends when no phrase is active any more. A frequent phrase has frequent parts, so none is missed.
5. So far phrases went by 64-bit hashes, whose counts are never too small. One more scan counts those that reached the threshold by their words.

Scores are exact: products are decimals of 38 digits. Words go by 64-bit hashes; if two words of the corpus have the same one,
all is done again with other hashes.

Defined cases: a null or empty text has no words; null languages are ``und``; repeated rows count each; ids are not used, so null and
repeated ids don't matter; an empty table, or one without frequent phrases, gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import slices
from corpusforge.llm.wordcodes import WordCodes, as_bytes, flat, long_lists, mixed
from corpusforge.session import checkpoint_folder, checkpointed, removed, ship

LONGEST = 5
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
PHRASE = ["lang", *WORDS]
NEVER = 255
_BREAKS = re.compile(rb"[.,;:!?\n-\r]+")
_BETWEEN = b"!"
_NAMES = 1000


def encoded(documents: DataFrame, shards: int, seed: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(shard, lang, words, names): a row of each document's word hashes, and in shard -1 rows of hashes and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, row = WordCodes(seed), 0
        for batch in slices(batches, "text", 2 << 20):
            tokens: list[bytes] = []
            lengths = []
            for text in as_bytes(batch.column("text")):
                some = _BREAKS.sub(b" ! ", text.lower()).split()
                tokens += some
                lengths.append(len(some))
            hashes, new = codes.encoded(tokens)
            if _BETWEEN in new:
                codes.hashes[codes.number[_BETWEEN]] = 0
                hashes = codes.hashes[[codes.number[w] for w in tokens]]
            n = batch.num_rows
            shard = pa.array((np.arange(row, row + n) % shards).astype(np.int32))
            row += n
            yield pa.RecordBatch.from_arrays([shard, batch.column("lang"), long_lists(hashes, lengths), pa.nulls(n, pa.list_(pa.string()))], names=["shard", "lang", "words", "names"])
            new = [w for w in new if w != _BETWEEN]
            for start in range(0, len(new), _NAMES):
                some = new[start : start + _NAMES]
                own = codes.hashes[[codes.number[w] for w in some]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1], pa.int32()), pa.nulls(1, pa.string()), long_lists(own, [len(own)]), pa.array([[w.decode() for w in some]], pa.list_(pa.string()))], names=["shard", "lang", "words", "names"]
                )

    rows = documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "shard int, lang string, words array<long>, names array<string>")


def _distinct(keys: np.ndarray, at: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of one of each phrase, and how often each is there; ``columns`` have the words of the phrase at each place.

    Phrases are told apart by ``keys``; should phrases of one key differ, by their words.
    """
    _, first, which, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    if all(bool((c == c[first][which]).all()) for c in columns):
        return at[first], counts
    _, first, counts = np.unique(np.stack(columns, axis=1), axis=0, return_index=True, return_counts=True)
    return at[first], counts


def _laid_out(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Words of all documents in a row with one 0 after each, their hashes with the language, the language's number, and the languages."""
    langs = batch.column("lang").dictionary_encode()
    names = langs.dictionary.to_pylist()
    values, lengths = flat(batch.column("words"))
    x = np.zeros(len(values) + len(lengths), np.uint64)
    x[np.arange(len(values)) + np.repeat(np.arange(len(lengths)), lengths)] = values
    lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), lengths + 1)
    salt = np.array([xxhash.xxh64_intdigest(n) for n in names] or [0], np.uint64)
    return x, mixed(salt[lang], x), lang, names


def counted(shard: DataFrame, step: int, shards: int, reached, bits: int) -> DataFrame:
    """(h, info, c): hashes of the phrases that are active in this step, the step they began in times 8 plus their length, and their number."""
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = reached.value
        for batch in slices(batches, "words", 4 << 20):
            x, h, _, _ = _laid_out(batch)
            known = steps[h >> shift]
            known[x == 0] = NEVER
            began = np.where(x == 0, NEVER, 0).astype(np.uint8)
            for k in range(1, LONGEST + 1):
                if k > 1:
                    began = np.maximum(known[:-1], known[1:])
                    live = began < NEVER
                    if not live.any():
                        break
                    h = mixed(h[:-1], x[k - 1 :])
                    # Not known before it began, even if another phrase's step stands in its cell: so its step never changes.
                    known = np.where(live, np.maximum(steps[h >> shift], began), NEVER).astype(np.uint8)
                for first in range(max(0, step - shards + 1), step + 1):
                    found, counts = np.unique(h[began == first], return_counts=True)
                    if len(found):
                        info = pa.array(np.full(len(found), first * 8 + k, np.int32))
                        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), info, pa.array(counts.astype(np.int64))], names=["h", "info", "c"])

    return shard.select("lang", "words").mapInArrow(run, "h long, info int, c long")


class Tally:
    """Phrases with their counts, each once; they are told apart by keys and, should phrases of one key differ, by their words.

    New ones lie apart until there are ``fresh`` of them. So a task holds ``most + fresh`` phrases of 64 bytes at most, and one column more while it adds up.
    """

    def __init__(self, most: int = 600_000, fresh: int = 100_000) -> None:
        self.most, self.fresh, self.waiting = most, fresh, 0
        #: Of each part its keys, its counts, and the columns of its phrases.
        self.parts: list[list[np.ndarray]] = []

    def add(self, keys: np.ndarray, phrases: list[np.ndarray], counts: np.ndarray) -> None:
        """``phrases`` has a column for each word and one for a number of the language and length."""
        self.parts.append([keys, counts, *phrases])
        self.waiting += len(keys)
        if self.waiting >= self.fresh:
            self.settle()

    def settle(self) -> None:
        parts, self.parts, self.waiting, whole = self.parts, [], 0, []
        for part in parts:
            part.reverse()
        while parts[0]:
            whole.append(np.concatenate([part.pop() for part in parts]))
        _, first, which = np.unique(whole[0], return_index=True, return_inverse=True)
        if not all(bool((column == column[first][which]).all()) for column in whole[2:]):
            _, first, which = np.unique(np.stack(whole[2:], axis=1), axis=0, return_index=True, return_inverse=True)
        sums = np.zeros(len(first), np.int64)
        np.add.at(sums, which.reshape(-1), whole[1])
        for i, column in enumerate(whole):
            whole[i] = sums if i == 1 else column[first]
        self.parts = [whole]

    def taken(self, all_of_it: bool = False) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """(phrases, counts) if there are more than ``most``, or at the end; they aren't held any more then."""
        if self.parts and (all_of_it or not self.waiting and len(self.parts[0][0]) > self.most):
            if self.waiting:
                self.settle()
            (_, counts, *phrases), self.parts = self.parts[0], []
            for start in range(0, len(counts), 100_000):
                yield [column[start : start + 100_000] for column in phrases], counts[start : start + 100_000]


def spelled_out(corpus: DataFrame, wanted, bits: int) -> DataFrame:
    """(lang, w1 .. w5, k, c): exact counts of the phrases whose cells, and those of all their parts, are in the table; k = 0 counts all words.

    A task gives each of its phrases once, or again after each ``most`` of the tally, and a frequent phrase is in nearly all tasks. So there are two tasks for each core and not one for
    each part of the files: the rows given grow with the phrases, not with the phrases times the parts.
    """
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tally, numbers, sizes = wanted.value, Tally(), {}, {}
        for batch in slices(batches, "words", 4 << 20):
            x, h, lang, names = _laid_out(batch)
            live = x != 0
            for name, n in zip(names, np.bincount(lang[live], minlength=len(names)).tolist(), strict=True):
                sizes[name] = sizes.get(name, 0) + n
            number = np.array([numbers.setdefault(name, len(numbers)) for name in names], np.uint64)
            on = live & table[h >> shift]
            for k in range(1, LONGEST + 1):
                if k > 1:
                    h = mixed(h[:-1], x[k - 1 :])
                    on = on[:-1] & on[1:] & table[h >> shift]
                at = np.flatnonzero(on)
                if not len(at):
                    break
                places, counts = _distinct(h[at], at, [*(x[at + j] for j in range(k)), lang[at]])
                words = [x[places + j] if j < k else np.zeros(len(places), np.uint64) for j in range(LONGEST)]
                tally.add(h[places], [*words, number[lang[places]] * np.uint64(8) + np.uint64(k)], counts)
                yield from (_phrases(list(numbers), *some) for some in tally.taken())
        yield from (_phrases(list(numbers), *some) for some in tally.taken(True))
        none = [np.zeros(len(sizes), np.uint64)] * LONGEST
        yield _phrases(list(numbers), [*none, np.array([numbers[name] * 8 for name in sizes], np.uint64)], np.array(list(sizes.values()), np.int64))

    words = ", ".join(f"{w} long" for w in WORDS)
    rows = corpus.select("lang", "words").coalesce(2 * corpus.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, f"lang string, {words}, k int, c long")
    return rows.groupBy(*PHRASE, "k").agg(F.sum("c").alias("c"))


def _phrases(names: list[str], phrases: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
    which = phrases[LONGEST].astype(np.int64)
    langs = pa.array(names, pa.string()).take(pa.array(which // 8))
    words = [pa.array(column.view(np.int64)) for column in phrases[:LONGEST]]
    return pa.RecordBatch.from_arrays([langs, *words, pa.array((which % 8).astype(np.int32)), pa.array(counts.astype(np.int64))], names=[*PHRASE, "k", "c"])


def _cells(rows: DataFrame, bits: int) -> np.ndarray:
    """The numbers of the cells that hashes ``h`` lie in; one bit a cell is sent, so 2^bits / 8 bytes at most."""
    cells = rows.select((F.shiftrightunsigned("h", 64 - bits) + 1).alias("cell"))
    maps = cells.groupBy(F.bitmap_bucket_number("cell").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bitmap"))
    found = [np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")) + (block - 1) * 32768 for block, bitmap in maps.collect()]
    return np.concatenate([np.zeros(0, np.int64), *found])


def frequent_phrases(documents: DataFrame, least: int = 100, shards: int = 4, bits: int = 24, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of 1 to 5 words found ``least`` times or more (lang, w1 .. w5, k, c), all words by lang (lang, n), and the words' names (h, name)."""
    spark = ship(documents.sparkSession)
    folder = f"{checkpoint_folder(spark)}/phrases-{uuid.uuid4().hex}"
    while True:
        encoded(documents, shards, seed).write.partitionBy("shard").parquet(f"{folder}/shards-{seed}")
        corpus = spark.read.schema("lang string, words array<long>, names array<string>, shard int").parquet(f"{folder}/shards-{seed}")
        names = corpus.where("shard = -1").select(F.explode(F.arrays_zip("words", "names")).alias("x")).select(F.col("x.words").alias("h"), F.col("x.names").alias("name"))
        names = checkpointed(names.groupBy("h").agg(F.min("name").alias("name"), F.max("name").alias("other")))
        if names.where("name <> other").isEmpty():
            break
        removed(spark, f"{folder}/shards-{seed}")
        seed += 1
    steps = np.full(1 << bits, NEVER, np.uint8)
    total, last, step = None, 0, 0
    while step < shards or step < last + shards:
        reached = spark.sparkContext.broadcast(steps)
        rows = counted(corpus.where(F.col("shard") == step % shards), step, shards, reached, bits)
        if total is not None:
            # A phrase whose cycle is over stays only if it is frequent.
            rows = rows.unionByName(total.where((F.expr("info div 8") + shards > step) | (F.col("c") >= least)))
        rows.groupBy("h").agg(F.max("info").alias("info"), F.sum("c").alias("c")).write.parquet(f"{folder}/step-{step}")
        total = spark.read.schema("h long, info int, c long").parquet(f"{folder}/step-{step}")
        if step:
            removed(spark, f"{folder}/step-{step - 1}")
        step += 1
        on = _cells(total.where((F.col("c") >= least) & (F.col("info") % 8 < LONGEST)), bits)
        on = on[steps[on] == NEVER]
        if len(on):
            last = step
            steps[on] = step
        reached.destroy()
    table = np.zeros(1 << bits, bool)
    table[_cells(total.where(F.col("c") >= least), bits)] = True
    exact = checkpointed(spelled_out(corpus.where("shard >= 0"), spark.sparkContext.broadcast(table), bits))
    removed(spark, folder)
    return exact.where((F.col("c") >= least) & (F.col("k") > 0)), exact.where("k = 0").select("lang", F.col("c").alias("n")), names


def _cut(first: int, end: Column | int) -> Column:
    """The words from ``first`` on up to ``end``, as w1 .. w5 of a phrase of their own."""
    end = F.lit(end) if isinstance(end, int) else end
    return F.struct(*[F.when(F.lit(first + i) <= end, F.col(WORDS[first + i - 1])).otherwise(F.lit(0)).alias(WORDS[i - 1]) if first + i <= LONGEST else F.lit(0).cast("long").alias(WORDS[i - 1]) for i in range(1, LONGEST + 1)])


def scored(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """Candidates (lang, w1 .. w5, k, a, l, r, n, score) by their lowest cut, without those held in a longer one as often."""
    counts = found.select(*PHRASE, "c")
    phrases = found.where("k > 1").withColumnRenamed("c", "a")
    # What is as frequent as one word more before or behind it.
    longer = phrases.where("k > 2").select("lang", "a", F.explode(F.array(_cut(0, F.col("k") - 1), _cut(1, F.col("k")))).alias("part"))
    longer = longer.select("lang", *[F.col(f"part.{w}").alias(w) for w in WORDS], "a").groupBy(*PHRASE).agg(F.max("a").alias("longer"))
    kept = phrases.join(longer, PHRASE, "left").where("longer IS NULL OR longer < a").drop("longer")
    cuts = kept.select("*", F.explode(F.array_compact(F.array(*[F.when(F.col("k") > i, F.struct(F.lit(i).alias("cut"), _cut(0, i).alias("first"), _cut(i, F.col("k")).alias("rest"))) for i in range(1, LONGEST)]))).alias("s"))
    for side, name in (("first", "l"), ("rest", "r")):
        part = counts.select(F.col("lang").alias("of"), *[F.col(w).alias(f"p{w}") for w in WORDS], F.col("c").alias(name))
        on = cuts.lang == part.of
        for w in WORDS:
            on = on & (F.col(f"s.{side}.{w}") == F.col(f"p{w}"))
        cuts = cuts.join(part, on).drop("of", *[f"p{w}" for w in WORDS])
    exact = lambda name: F.col(name).cast("decimal(19,0)")
    cuts = cuts.join(F.broadcast(sizes), "lang").withColumns({"over": exact("a") * exact("n") * F.lit(1000).cast("decimal(4,0)"), "under": exact("l") * exact("r")})
    cuts = cuts.withColumn("score", F.expr("over div under"))
    return cuts.groupBy(*PHRASE, "k", "a", "n").agg(F.min(F.struct("score", F.col("s.cut").alias("cut"), "l", "r")).alias("low")).select(*PHRASE, "k", "a", "low.l", "low.r", "n", "low.score")


def collocations(documents: DataFrame, least: int = 100, top: int = 2000, shards: int = 4, bits: int = 24) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    found, sizes, names = frequent_phrases(documents, least, shards, bits)
    rows = scored(found, sizes)
    # Ties at the end stay until the words are known.
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = rows.withColumn("place", F.rank().over(by_score)).where(F.col("place") <= top).drop("place")
    first = checkpointed(first)
    words = first.select(*PHRASE, F.posexplode(F.slice(F.array(*WORDS), F.lit(1), F.col("k"))).alias("i", "h"))
    spelled = words.join(names.select("h", "name"), "h").groupBy(*PHRASE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return first.join(spelled, PHRASE).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
