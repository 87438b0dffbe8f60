"""Near-duplicate documents by the Jaccard similarity of their word shingles, found exactly.

1. A document is the set of its 5-word shingles' hashes (of its whole word sequence if it is shorter). Equal
   sets are one node.
2. Sets x and y with similarity 0.8 share 0.8 of the larger one at least. So in any common order of the
   shingles they share one of the first ``|x| - ceil(0.8 |x|) + 1`` of x and of as many of y: its head. The order
   is by hash, with shingles that stand in many documents last, rarer ones first. How common a shingle is, a
   sample of the documents tells; that changes the order alone, and any order is right.
3. Similar sets share ``a = ceil(4/9 (|x| + |y|))`` shingles. All that they share up to the earlier end of their heads
   stand in both heads, so the heads share ``a - ceil(0.8 max(|x|, |y|)) + 1`` at least. Sets that share as many
   are candidates, and each is verified on the whole sets.
4. A shingle that stands in more than ``bucket`` heads is crowded. Of the sets of about one size that hold it, the one
   with the smallest share of other shingles in its head is the centre (most like what all of them are copies of), and the
   others are first linked to it alone. What these links connect needn't be paired any more; only sets of different
   components are, and only at shingles among the first ``|x| - a + 1`` of x and the first ``|y| - a + 1`` of y, as the
   first one that similar sets share stands there. In a group of near copies such pairs are few: a set that isn't like
   the centre has many shingles of its own, and those stand first.
   Where only the other shingles are paired, each crowded one of a head counts as shared.

So no link is lost and none is false; the order and step 4 only change how many candidates are looked at.

Defined cases: a null or empty text is the empty set, and equal to any other; repeated rows are linked like
any other; null ids take part in links but never name a component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import slices
from corpusforge.llm.simhash import components, shingle_hashes
from corpusforge.session import checkpointed, ship

WIDTH = 5
#: Of the shingles that are common, so many are sorted last at most; this changes the order alone.
COMMON = 500_000
#: One of so many texts tells which shingles are common.
SAMPLED = 16
#: So many sets' ids are sent to the tasks that give whole sets; if more are asked for, all sets are given and joined.
ASKED = 2_000_000


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def head_size(n: int) -> int:
    """How many shingles of n, in the common order, a set shares one of with each similar set."""
    return n - (4 * n + 4) // 5 + 1 if n else 0


def head(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles by the common order, and how many of them aren't ``common``.

    The order is by hash, but those of ``common`` (sorted) come last, by rank.
    """
    k = head_size(len(shingles))
    if not len(common):
        return shingles[:k], k
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    late = common[at] == shingles
    fresh = shingles[~late]
    if len(fresh) >= k:
        return fresh[:k], k
    return np.concatenate([fresh, shingles[late][np.argsort(rank[at[late]], kind="stable")][: k - len(fresh)]]), len(fresh)


NONE = np.zeros(0, np.uint64)


def _set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes())


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array((np.concatenate(values) if values else np.zeros(0, np.uint64)).view(np.int64), pa.int64()))


def _marked(documents: DataFrame, common, width: int) -> DataFrame:
    """(doc_id, node, n, part, fresh) of every row: its set, the set's size, its head and how many of that aren't common.

    A task gives a set's head once, with the first of its rows; several tasks may give it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, seen = common.value, set()
        for batch in slices(batches, "text", 2 << 20):
            nodes, sizes, parts, fresh = [], [], [], []
            for t in batch.column("text").to_pylist():
                shingles = shingle_set(t, width)
                node = _set_id(shingles)
                own, k = (NONE, 0) if node in seen else head(shingles, *late)
                seen.add(node)
                nodes.append(node)
                sizes.append(len(shingles))
                parts.append(own)
                fresh.append(k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _longs(nodes), pa.array(sizes, pa.int32()), _lists(parts), pa.array(fresh, pa.int32())], names=["doc_id", "node", "n", "part", "fresh"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, node long, n int, part array<long>, fresh int")


def _sets(documents: DataFrame, width: int, only=None) -> DataFrame:
    """(node, part): whole sets, of the nodes ``only`` (sorted) if given. A task gives a set once; several tasks may give it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = only.value if only is not None else None
        seen: set[int] = set()
        for batch in slices(batches, "text", 2 << 20):
            nodes, parts = [], []
            for t in batch.column("text").to_pylist():
                shingles = shingle_set(t, width)
                node = _set_id(shingles)
                if node in seen or wanted is not None and not _holds(wanted, node):
                    continue
                seen.add(node)
                nodes.append(node)
                parts.append(shingles)
            yield pa.RecordBatch.from_arrays([_longs(nodes), _lists(parts)], names=["node", "part"])

    return documents.select("text").mapInArrow(run, "node long, part array<long>")


def _holds(values: np.ndarray, x: int) -> bool:
    at = int(np.searchsorted(values, np.uint64(x)))
    return at < len(values) and int(values[at]) == x


def _common(documents: DataFrame, width: int, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that stand in most of the sampled texts (sorted), and their ranks, rarer ones first."""
    some = documents.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    keys = _sets(some, width).dropDuplicates(["node"]).select(F.explode("part").alias("key")).groupBy("key").agg(F.count("*").alias("held"))
    rows = keys.where(F.col("held") > max(2, bucket // SAMPLED)).orderBy(F.desc("held"), "key").limit(COMMON).collect()
    keys, held = np.array([r.key for r in rows], np.int64).view(np.uint64), np.array([r.held for r in rows], np.int64)
    order = np.argsort(keys)
    return keys[order], held[order]


def _verified(documents: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """The pairs (u, v) of which four fifths of all shingles are common."""
    pairs = checkpointed(pairs)
    asked = checkpointed(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
    only = None
    if asked.count() <= ASKED:
        only = documents.sparkSession.sparkContext.broadcast(np.sort(np.fromiter((r.node for r in asked.toLocalIterator()), np.int64).view(np.uint64)))
    whole = _sets(documents, width, only)
    if only is None:
        whole = whole.join(asked, "node", "left_semi")
    whole = checkpointed(whole.dropDuplicates(["node"]))
    a, b = whole.select(F.col("node").alias("u"), F.col("part").alias("x")), whole.select(F.col("node").alias("v"), F.col("part").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return checkpointed(pairs.join(a, "u").join(b, "v").where(5 * both >= 4 * (F.size("x") + F.size("y") - both)).select("u", "v"))


def _alike(a: str, b: str) -> Column:
    """Sets of these sizes may be similar."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _least_met(a: str = "n_u", b: str = "n_v") -> Column:
    return F.expr(f"(4 * ({a} + {b}) + 8) div 9 - (4 * greatest({a}, {b}) + 4) div 5 + 1")


def _early(side: str, other: str) -> Column:
    """The key stands so early in the first set that it can be the first one that two similar sets of these sizes share."""
    return F.expr(f"{side}.at <= {side}.n - (4 * ({side}.n + {other}.n) + 8) div 9")


def _pairs(keys: DataFrame, more: Column | None = None) -> DataFrame:
    """(u, v, n_u, n_v), u > v, for each key that two sets share, if their sizes allow similarity."""
    a, b = keys.alias("a"), keys.alias("b")
    fits = (F.col("a.key") == F.col("b.key")) & (F.col("a.node") > F.col("b.node")) & _alike("a.n", "b.n")
    return a.join(b, fits if more is None else fits & more).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"), F.col("a.n").alias("n_u"), F.col("b.n").alias("n_v"))


def _shared(marked: DataFrame) -> DataFrame:
    """(node, n, key, at, held): the heads' shingles that stand in more than one head, at which place, and in how many."""
    keys = marked.select("node", "n", "fresh", F.posexplode("part").alias("at", "key"))
    # By the key alone: dropping repeated sets and counting take one shuffle.
    fresh = keys.where(F.col("at") < F.col("fresh")).select("node", "n", "key", "at").repartition("key").dropDuplicates(["key", "node"])
    fresh = fresh.withColumn("held", F.count("*").over(Window.partitionBy("key"))).where("held > 1")
    # A common shingle may stand in a third of all heads: its rows stay apart, and only their counts meet. There are COMMON of these keys at most.
    late = checkpointed(keys.where(F.col("at") >= F.col("fresh")).select("node", "n", "key", "at").dropDuplicates(["key", "node"]))
    counts = late.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    return fresh.union(late.join(F.broadcast(counts), "key").select("node", "n", "key", "at", "held"))


def links(documents: DataFrame, marked: DataFrame, width: int = WIDTH, bucket: int = 64) -> DataFrame:
    """Edges (u, v), u > v, whose components are those of similarity 0.8 or more; ``marked`` as _marked() gives it."""
    shared = checkpointed(_shared(marked))
    small, crowded = shared.where(F.col("held") <= bucket), shared.where(F.col("held") > bucket)
    met = _pairs(small).groupBy("u", "v", "n_u", "n_v").agg(F.count("*").alias("met"))
    if crowded.isEmpty():
        return _verified(documents, met.where(F.col("met") >= _least_met()).select("u", "v"), width)
    loads = crowded.groupBy("node").agg(F.count("*").alias("load"))
    for side in "uv":
        met = met.join(loads.select(F.col("node").alias(side), F.col("load").alias(f"load_{side}")), side, "left")
    met = met.withColumn("met", F.col("met") + F.least(F.coalesce("load_u", F.lit(0)), F.coalesce("load_v", F.lit(0))))
    pairs = met.where(F.col("met") >= _least_met()).select("u", "v")
    crowded = checkpointed(crowded.join(loads, "node").select("node", "n", "key", "at", "load", F.floor(F.log("n") / F.log(F.lit(1.2))).alias("band")))
    centres = crowded.groupBy("key", "band").agg(F.max_by(F.struct("node", "n"), F.struct(F.col("load") / F.col("n"), F.xxhash64("node"), "node")).alias("f"))
    star = crowded.join(centres, ["key", "band"]).where((F.col("node") != F.col("f.node")) & _alike("n", "f.n"))
    star = star.where(F.col("load") >= _least_met("n", "f.n"))
    found = _verified(documents, pairs.union(star.select(F.greatest("node", "f.node").alias("u"), F.least("node", "f.node").alias("v"))).distinct(), width)
    tree = components(found).withColumnRenamed("root", "of")
    held = checkpointed(crowded.join(tree, "node", "left").select("key", "node", "n", "at", "load", F.coalesce("of", "node").alias("of")))
    # Of each key, the sizes of its sets: the greatest load and the first place of that size, and whether the sets are of one component.
    sizes = held.groupBy("key", "n").agg(F.max("load").alias("load"), F.min("at").alias("at"), F.min("of").alias("low"), F.max("of").alias("high"))
    enough = lambda a, b: (F.least(f"{a}.load", f"{b}.load") >= _least_met(f"{a}.n", f"{b}.n")) & _early(a, b) & _early(b, a)
    other = (F.col("a.of") != F.col("s.low")) | (F.col("a.of") != F.col("s.high"))
    live = held.alias("a").join(sizes.alias("s"), (F.col("a.key") == F.col("s.key")) & _alike("a.n", "s.n") & enough("a", "s") & other, "left_semi")
    across = _pairs(checkpointed(live), (F.col("a.of") != F.col("b.of")) & enough("a", "b")).distinct()
    # How many crowded keys they share in all; a pair that shares another key too was looked at above.
    own = crowded.groupBy("node").agg(F.collect_list("key").alias("keys"))
    for side in "uv":
        across = across.join(own.select(F.col("node").alias(side), F.col("keys").alias(f"keys_{side}")), side)
    across = across.where(F.size(F.array_intersect("keys_u", "keys_v")) >= _least_met())
    return found.union(_verified(documents, across.select("u", "v"), width)).distinct()


def near_duplicates(documents: DataFrame, width: int = WIDTH, bucket: int = 64) -> DataFrame:
    """(doc_id, component_id) for every row of ``documents``."""
    ship(documents.sparkSession)
    common = documents.sparkSession.sparkContext.broadcast(_common(documents, width, bucket))
    marked = checkpointed(_marked(documents, common, width))
    nodes = marked.groupBy("node").agg(F.min("doc_id").alias("least"))
    tree = components(links(documents, marked, width, bucket))
    linked = nodes.join(tree, "node").select("node", "root", "least")
    named = linked.groupBy("root").agg(F.min("least").alias("named"))
    of = linked.join(named, "root").select(F.col("node").alias("in_tree"), "named", F.lit(True).alias("found"))
    every = nodes.join(of, nodes.node == of.in_tree, "left").select("node", F.when(F.col("found"), F.col("named")).otherwise(F.col("least")).alias("component_id"))
    return marked.select("doc_id", "node").join(every, "node", "left").select("doc_id", "component_id")


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """One row of each near-duplicate component, with all its columns.

    That is the row with the component's smallest id (of repeated rows, any one). Rows without an id
    can't be named by a component, and all stay.
    """
    found = near_duplicates(documents, **options)
    lasting = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = documents.join(lasting, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.union(documents.where("doc_id IS NULL"))
