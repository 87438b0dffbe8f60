"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; texts without other letters take the faster built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds (null ids: fold of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def same(*names: str):
    """A null-safe join condition of l.name and r.name for each name."""
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))
    return condition


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, limit: int, keep: Column | None = None) -> DataFrame:
    """(text, label) of at most ``limit`` labelled documents, chosen by a hash of the id.

    ``limit`` bounds what classifiers are fitted on, and so what is broadcast here. Labels without an
    id or a value don't count; an id labelled twice takes the larger label; of several rows with one id the
    smallest text counts, so repeated ids never raise the number of rows.
    """
    chosen = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    if keep is not None:
        chosen = chosen.where(keep)
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = documents.select("doc_id", "text")
    found = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def before(values: Column, op, zero: Column, block: int = 256) -> Column:
    """What ``op`` makes of all earlier elements, for each element of an array (``zero`` for the first).

    Appending to an array copies it, so it is done in blocks: their cost grows with the array and the block, not
    with the array's square.
    """
    none = F.slice(F.array(zero), 2, 0)

    def scanned(some: Column, of) -> Column:
        start = F.struct(zero.alias("at"), none.alias("out"))
        return F.aggregate(some, start, lambda acc, v: F.struct(op(acc["at"], of(v)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def joined(blocks: Column) -> Column:
        starts = scanned(blocks, lambda b: b["at"])["out"]
        return F.flatten(F.zip_with(blocks, starts, lambda b, at: F.transform(b["out"], lambda v: op(at, v))))

    def whole(held: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(held), F.lit(1)), F.lit(block))
        return with_value(F.transform(firsts, lambda first: scanned(F.slice(held, first, F.lit(block)), lambda v: v)), joined)

    return with_value(values, whole)


def with_value(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def parts_for(n: int, least: int = 64, most: int = 16384, rows: int = 1_000_000) -> int:
    """Into how many parts n rows are dealt, so that one holds about ``rows`` of them."""
    return max(least, min(most, n // rows))


def fit_logistic(rows: np.ndarray, labels: np.ndarray, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (the last is the bias) of a dense logistic regression, by damped Newton steps."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2 * max(1, len(x)))
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) + ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


#: What this Python worker keeps between tasks: one value at most.
_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]):
    """A value that this Python worker keeps for all tasks that ask for it by name, until a task of another kind begins (see ``slices``)."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20, keeps: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the named text column has about ``max_bytes`` in each (one row at least).

    A worker serves tasks of all operators, so what it has kept under another name than ``keeps`` goes first.
    """
    if keeps not in _KEPT:
        _KEPT.clear()
    for batch in batches:
        size = batch.column(column).nbytes
        step = batch.num_rows if size <= max_bytes else max(1, batch.num_rows * max_bytes // max(size, 1))
        for start in range(0, batch.num_rows, max(step, 1)):
            yield batch.slice(start, step)
