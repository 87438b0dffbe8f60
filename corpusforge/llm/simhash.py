"""Near-duplicate documents by SimHash and deletion-variant signatures.

A 64-bit fingerprint is cut into two segments. Two fingerprints that differ in at most two bits differ
in at most one bit of one segment, so with each single bit of a segment left out in turn ("wildcard")
they share a variant. Variants are joined by equality, and each pair is verified.

A variant shared by more than ``bucket`` fingerprints isn't paired up. Its fingerprints take an exact
way without pairs: each is filed under itself and its 64 one-bit neighbours, and all that share a file
are linked to the smallest there. Two fingerprints share such a file if and only if they differ in at
most two bits, so no link is lost and none is false.

Defined cases: a null or empty text has fingerprint zero, and is linked like any other; repeated rows
get the same result each; null ids take part in links but never name a component (a component of only
null ids has none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import slices
from corpusforge.session import checkpoint_folder, checkpointed, removed, ship

#: Fingerprints link at so many differing bits; the exact way below holds for this number alone.
BITS = 2


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle; of the whole word sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    ends = [words[i:] for i in range(width)]
    return np.fromiter((digest(s, seed) for s in map(b" ".join, zip(*ends, strict=False))), np.uint64, len(words) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 4096):
        part = hashes[start : start + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) with fp as a signed long, computed over whole texts in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = [fingerprint(shingle_hashes(t, width, seed)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(made, np.uint64).view(np.int64), pa.int64())], names=["doc_id", "fp"])

    ship(documents.sparkSession)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _variants(fps: DataFrame, segments: int = 2) -> DataFrame:
    """(key, fp): each segment with each of its bits left out; the key holds the bit's number and the rest of the segment."""
    width = 64 // segments
    made = []
    for s in range(segments):
        segment = F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit((1 << width) - 1))
        for p in range(width):
            made.append(F.lit((s * width + p) << width).bitwiseOR(segment.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << p)))).cast("long"))
    return fps.select("fp", F.explode(F.array(*made)).alias("key"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, bucket: int = 64) -> DataFrame:
    """Edges (u, v), u > v, whose components are those of "differ in at most two bits"."""
    # Each fingerprint becomes 64 rows, so few small partitions would become few large tasks.
    fps = checkpointed(fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # Counts are combined before they meet, and the join can split a hot variant: no task gets all of its fingerprints.
    counts = _variants(fps).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = checkpointed(_variants(fps).join(counts, "key"))
    small = shared.where(F.col("n") <= bucket)
    a, b = small.alias("a"), small.alias("b")
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") > F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= BITS)
    pairs = a.join(b, near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    # The exact way for crowded variants; see the module's docstring.
    crowded = shared.where(F.col("n") > bucket).select("fp").distinct()
    balls = crowded.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i)).cast("long")) for i in range(64)])).alias("file"))
    least = balls.groupBy("file").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("file", "v")
    stars = balls.join(least, "file").where("fp > v").select(F.col("fp").alias("u"), "v")
    return pairs.union(stars).distinct()


def _ways(*pairs: tuple[str, str]) -> Column:
    """Rows (u, v) of the pairs of columns given."""
    return F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs]))


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) for every node of an edge, root the smallest node it can reach.

    Alternating large-star and small-star steps; each halves distances, and no step gathers a
    neighbourhood in one place: minima are combined before the shuffle and joined back. It ends when a round
    changes nothing; should that not happen within ``rounds`` rounds, it raises an error rather than give less.

    A step's edges are written as Parquet in the shared folder and deleted as soon as the next step's lie there, so the disk holds two
    steps whatever the number of rounds, and few small files become few tasks.
    """
    spark = edges.sparkSession
    folder, steps, before = f"{checkpoint_folder(spark)}/components-{uuid.uuid4().hex}", 0, None

    def written(rows: DataFrame) -> DataFrame:
        nonlocal steps
        rows.write.parquet(f"{folder}/{steps}")
        if steps:
            removed(spark, f"{folder}/{steps - 1}")
        steps += 1
        return spark.read.schema("u long, v long").parquet(f"{folder}/{steps - 1}")

    edges = written(edges.select("u", "v"))
    for _ in range(rounds):
        both = edges.select(_ways(("u", "v"), ("v", "u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = written(large.join(low, "u").select(_ways(("v", "m"), ("u", "m"))).where("u > v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        removed(spark, folder)
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    edges = checkpointed(edges)
    removed(spark, folder)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def near_duplicates(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 3, bucket: int = 64) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``documents``."""
    marked = checkpointed(fingerprints(documents, text_col, id_col, width))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    tree = components(links(nodes.select("fp"), bucket))
    # Only fingerprints with a link are in the tree; the others are their own component.
    linked = nodes.join(tree, nodes.fp == tree.node).select("fp", "root", "least")
    named = linked.groupBy("root").agg(F.min("least").alias("named"))
    of = linked.join(named, "root").select("fp", "named")
    every = nodes.join(of, "fp", "left").select("fp", F.when(F.col("named").isNull(), F.col("least")).otherwise(F.col("named")).alias("component_id"))
    return marked.join(every, "fp", "left").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    """The fingerprint as 16 hex digits."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """One row of each near-duplicate component, with all its columns.

    That is the row with the component's smallest id (of repeated rows, any one). Rows without an id
    can't be named by a component, and all stay.
    """
    found = near_duplicates(documents, **options)
    lasting = found.where("doc_id = component_id").select("doc_id").distinct()
    # Both sides lie by id for the join, so dropping repeated ids takes no further shuffle.
    kept = documents.join(lasting, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.union(documents.where("doc_id IS NULL"))
