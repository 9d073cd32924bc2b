"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns documents again; the last returns their tokens. run() writes each
stage's result as Parquet to the shared checkpoint folder and reads it back as
the next one's input; only the last result stays there.

Defined results, in every stage: columns beside those of documents aren't read and
go; an empty table gives an empty one; rows that share an id are told apart unless a
stage says otherwise.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presentia.llm import bpe, line_dedup, mixing, quality_rules, simhash
from presentia.llm.common import read_table, remove, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def reject_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the quality rules reject go. Null, empty and short texts do; a null id or source doesn't matter, a null language is one of its own."""
    return _documents(quality_rules.accepted(docs))


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: blocks of lines that an earlier document has go, and documents of which no words are left by that. Null ids and texts stay as they are; rows that share an id and have different texts are documents of their own."""
    return _documents(line_dedup.line_dedup(docs, drop_emptied=True))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of near duplicates the document with the smallest id stays (of rows that share it, one text's). Null and blank texts are one group; rows without an id stay."""
    return _documents(simhash.deduplicate(docs))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: every document as often as the mix takes it. Null and empty texts stay once; a null source is a source of its own."""
    return _documents(mixing.repeat_documents(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token ids of every document (little-endian unsigned 32-bit), decoded again to prove them. A null text has none."""
    done = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"))
    digest = {"ids_sha256": F.sha2("token_ids", 256), "decoded_sha256": F.sha2("decoded", 256)}
    return done.withColumns(digest).select("doc_id", "lang", "source", "n_tokens", *digest, "token_ids")


STAGES = [
    ("quality rules", reject_by_quality),
    ("line dedup", delete_repeated_lines),
    ("SimHash near-dedup", keep_one_of_near_duplicates),
    ("mixing", mix_to_weights),
    ("byte-level BPE", tokenize),
]

#: SQL cannot express the stages; tests/llm compares them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    try:
        for i, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
            if i:
                remove(spark, f"{folder}/{i - 1}")
            docs = spark.read.parquet(f"{folder}/{i}")
    except BaseException:
        remove(spark, folder)
        raise
    return docs
