"""The queries opN_<name> of the corpus operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import alignment
from .chat_format import chat_examples, read_back
from .common import shared_folder, table
from .exact_dedup import exact_dedup
from .fingerprint import fingerprints
from .language_id import language_id, learn
from .mixing import mix
from .near_dedup import near_dedup
from .packing import packed
from .resampling import resample
from .simhash import simhash_dedup
from .token_count import token_counts
from .token_file import read_token_file, write_token_file
from .toxicity import fit, toxicity_scores

#: Said by both rows of conversation -1.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def byte_bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id(docs, learn(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    write_token_file(table(spark, sf_dir, "documents"), path, byte_bpe())
    return read_token_file(spark, path)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = [F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(CONTROL).alias("text")) for i, r in enumerate(("user", "assistant"))]
    return read_back(chat_examples(real.unionByName(spark.range(1).select(F.inline(F.array(*rows))))))


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), byte_bpe())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))[0].drop("u")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), k=4)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), byte_bpe(), with_ids=False).drop("ids")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit(docs, table(spark, sf_dir, "labels")))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"), k=3)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"), byte_bpe(), public_tokenizers.path("piece_bpe_32k.model"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS n FROM documents),
g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM t JOIN g USING (n)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_token_file, op3_exact_dedup, op4_chat_format, op5_token_count, op6_mixing, op7_near_dedup, op8_packing, op9_fingerprint, op10_toxicity, op11_simhash, op12_alignment, op13_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL}
