"""Sharding by vector bin packing over bytes, tokens and rows.

Equal texts form a group, and a group goes to one shard unless it has over half of a shard's fair share of bytes; such a
group is cut into pieces by a hash of its rows' numbers in the input's files, so equal rows spread, too. Other large groups are
units of their own, and small ones are bundled by a hash of their text. Bundles, groups and
pieces are a bounded number of units, whose loads are counted exactly over all rows; each unit, largest first,
goes where the dot product of its load with the shards' residual capacity is highest. The law that holds is ``bytes``: sizes
are near equal. Should whole groups leave them further apart than 1/64 of a shard (or one text, if that is larger), smaller groups are cut as well,
down to that size.

Defined cases: a null text has no bytes (size 1) and an unsigned crc of 0; null ids are placed like any
other; repeated rows are rows of their own, each with its own slot; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import parts_for
from corpusforge.session import checkpointed

LAW = "bytes"


def place(loads: np.ndarray, shards: int) -> np.ndarray:
    """A shard for each row of loads (units x dimensions): greedy by dot product with what is left."""
    total = loads.sum(axis=0)
    scaled = loads / np.maximum(total, 1) * shards
    left = np.ones((shards, loads.shape[1]))
    out = np.zeros(len(loads), np.int64)
    for i in np.lexsort((np.arange(len(loads)), -scaled.max(axis=1))):
        out[i] = int(np.argmax(left @ scaled[i]))
        left[out[i]] -= scaled[i]
    return out


def shard_documents(documents: DataFrame, shards: int = 16, bundles: int = 4096, pieces: int = 64, slices: int | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard and slot of every row.

    Groups with over 1/(shards * pieces) of all bytes or rows are large: there are at most 2 * shards * pieces of them. Pieces of cut
    groups have about that size, so units number at most bundles + 6 * shards * pieces, whatever the input. A shard's rows
    are numbered in ``slices`` slices; by default that number grows with the rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = checkpointed(
        documents.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.size(F.array_remove(F.split(text, "[ \\t-\\r]+"), "")).cast("long").alias("tokens"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("group"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    total = rows.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    if not total.n:
        return rows.select("doc_id", "size", "tokens", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    slices = parts_for(total.n // shards) if slices is None else slices
    part_size, part_rows = max(1, total.size // (shards * pieces)), max(1, total.n // (shards * pieces))
    large = checkpointed(
        rows.groupBy("group").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & ((F.col("s") > part_size) | (F.col("n") > part_rows)))
    )
    longest = rows.agg(F.max("size")).first()[0]
    share = pieces // 2
    while True:
        cuts = F.when(F.col("s") > share * part_size, F.greatest(F.ceil(F.col("s") / part_size), F.ceil(F.col("n") / part_rows))).otherwise(1)
        unit = F.when(F.col("cuts").isNull(), F.struct(F.lit(0).cast("long").alias("group"), F.pmod("group", F.lit(bundles)).alias("piece"))).otherwise(
            F.struct(F.col("group").alias("group"), F.pmod(F.xxhash64("row"), F.col("cuts")).alias("piece"))
        )
        marked = rows.join(F.broadcast(large.select("group", cuts.alias("cuts"))), "group", "left").select("doc_id", "size", "tokens", "text_crc32", "row", unit.alias("unit"))
        units = marked.groupBy("unit").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()
        units.sort(key=lambda u: tuple(u.unit))
        # Bytes are the law, so they weigh most; tokens and rows decide between shards that are alike in them.
        loads = np.array([[u.size, u.size, u.tokens, u.n] for u in units], np.float64)
        home = place(loads, shards)
        sizes = np.bincount(home, loads[:, 0], shards)
        if share <= 1 or sizes.max() - sizes.min() <= max(part_size, longest):
            break
        share //= 2
    placed = documents.sparkSession.createDataFrame([((u.unit.group, u.unit.piece), int(s)) for u, s in zip(units, home, strict=True)], "unit struct<group:bigint,piece:bigint>, shard int")
    homed = marked.join(F.broadcast(placed), "unit").withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)))
    # Slots: numbers within a slice of a shard, after the rows of the slices before it.
    counts = homed.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size", "row"))
    return (
        homed.withColumn("number", number).join(F.broadcast(offsets), ["shard", "slice"])
        .select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("first") + F.col("number") - 1).cast("long").alias("slot"))
    )


def digest(sharded: DataFrame) -> DataFrame:
    return sharded.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
