"""A corpus pipeline of five stages over the documents table.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusforge.llm import decontam, jaccard, packing, secrets, simhash, toxicity
from corpusforge.llm.queries import tokenizer_path
from corpusforge.session import checkpoint_folder, removed, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar doesn't reject."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the smallest id both of those that operator 2's fingerprints link and of those linked by a 5-word Jaccard similarity of 0.8.

    Fingerprints of long near copies differ in more bits than operator 2 links, so similarity on whole sets follows it. The smallest id of
    whatever the two link together always stays. Rows without an id stay, too.
    """
    least = lambda found: found.where("doc_id = component_id").select("doc_id").distinct()
    lasting = least(simhash.near_duplicates(docs)).join(least(jaccard.near_duplicates(docs)), "doc_id", "left_semi")
    kept = docs.join(lasting, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.union(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret's span replaced by a mark."""
    return secrets.without_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its place in a training sequence."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written as Parquet in the shared folder and read again.

    A stage's table is deleted when the next one is written. The last stage reads its input when it is called
    and keeps what it made in checkpoints, so its input can go, too.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
        if i:
            removed(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    removed(spark, folder)
    return docs
