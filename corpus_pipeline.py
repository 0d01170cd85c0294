"""A corpus pipeline: five stages, each written as Parquet in the shared folder and read again.

1. toxicity: documents that the conditional random field scores at THRESHOLD or more go;
2. line dedup: lines of 40 characters or more in 5 documents or more stay in one of them;
3. MinHash near-dedup: of documents linked at a similarity of 0.8, the least id stays;
4. benchmark decontamination: documents that hold a benchmark item go;
5. byte-level BPE: ids of what is left, with the digests of ids and decoded bytes.

All but the last return the columns of documents. A null text becomes an empty one at the
second stage. SQL cannot express a trained model, so ORACLE_SQL is None; a test holds the
stages against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from cytoquilt.llm import bpe, decontaminate, lines, neardup, toxicity
from cytoquilt.llm.common import crc_mod, drop_dir, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SIMILARITY = (80, 100)


def clean_of_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below THRESHOLD, empty and null texts too. Without labels of both kinds nothing scores that high."""
    learn = lambda x: x.where(crc_mod("doc_id", toxicity.HELD_MOD) != toxicity.HELD_REST)
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"), learn, with_spans=False, carry=tuple(COLUMNS[1:]))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their recurring lines in one document only; n_chars is counted anew, and a null text is an empty one."""
    schema = StructType([StructField("text", StringType()), StructField("n_chars", LongType())])

    def each(kept: bytes, n: int, gone: int) -> tuple[str, int]:
        text = kept.decode("utf-8", "replace")
        return text, len(text)

    return lines.dedup_lines(docs, each, schema, carry=("lang", "source")).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of each group's least id, and all rows without an id.

    Rows that repeat an id and a text are one, with the least of their other columns; different
    texts of one id all stay, in a fixed way, so that a task that runs again gives the same rows.
    """
    docs = docs.select(*COLUMNS)
    kept = neardup.near_duplicates(docs, num=SIMILARITY[0], den=SIMILARITY[1]).where("kept and doc_id is not null").select(F.col("doc_id").alias("k")).distinct()
    real = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("k"), "left_semi")
    one = real.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest")).select("doc_id", "text", "rest.*")
    return one.select(*COLUMNS).union(docs.where("doc_id is null"))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item within its edit budget."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every row; an empty text has no ids."""
    schema = StructType([*bpe.DIGEST.fields, StructField("ids", ArrayType(IntegerType()))])
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.map_encoded(docs, "doc_id", "text", path, public_tokenizers.PATTERN, lambda ids, raw: (*bpe.digest(ids, raw), ids), schema)


STAGES = [
    ("toxicity", clean_of_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", clean_of_benchmark),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. A stage's table is deleted when the next one is written; the last one stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        where = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
        if before:
            drop_dir(spark, before)
        before = where
    return docs
