"""The corpus pipeline: toxicity, exact dedup, near-dedup, mixing, packing.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and works on all that the stage before
kept. :func:`run` applies them to ``documents``, each stage written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarnwell.llm.common import remove, shared_folder, table
from tarnwell.llm.exact_dedup import kept_documents
from tarnwell.llm.mixing import mixed_documents
from tarnwell.llm.near_dedup import representatives
from tarnwell.llm.packing import packed
from tarnwell.llm.toxicity import clean_documents

#: No SQL can say what the toxicity model, the draws of the mix and the tokenizer decide.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of labels.toxic does not reject, whole rows as they are.

    Null and empty texts hold no sentence and stay; repeated rows stay or go alike; rows without a
    doc_id are scored like any other; an empty table stays empty.
    """
    return clean_documents(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the least doc_id (a null one only where there is no other).

    Null texts count as empty and so are equal to empty ones; of repeated rows one stays; an empty table
    stays empty.
    """
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: the least doc_id (null last).

    Texts without words (null, empty) are linked with nothing and stay; rows that share doc_id and text
    are one document; rows that share a doc_id alone, or have none, are documents of their own; an empty
    table stays empty.
    """
    return representatives(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts that the mix of sources takes, once for each time that it takes them.

    A null source is a source of its own; texts without words are taken never, as the mix counts words;
    rows without a doc_id and repeated rows are documents of their own; an empty table stays empty.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in the training sequences.

    Null texts count as empty and make a piece of the end id alone; repeated rows and rows without a
    doc_id are packed like any other; an empty table gives no piece.
    """
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over ``documents``. A stage's table is removed once the next one is written."""
    docs, folder, before = table(spark, sf_dir, "documents"), shared_folder(spark), None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
