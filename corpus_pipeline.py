"""A corpus pipeline: language ID, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame;
all but the last return the columns of documents. run() writes each stage's result as Parquet in the
folder that spark.checkpoint.dir names, and reads it back for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import langid, mixing, nearjoin, packing, substring, tokens
from newsloom.llm.common import cut, fresh, named

#: Texts below this score resemble no learned language: noise of letters, not prose.
LEAST_SCORE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language: those without a letter (null and empty texts with them), and those near no profile, go.

    Where no row has a text and a lang nothing can be told, and every document stays. Rows that repeat share their fate; an
    empty table stays empty.
    """
    profiles = langid.learn(docs.where(~langid.held_out()))
    if not profiles.names:
        return docs
    name, score = fresh(docs, "lang_pred", "score")
    return langid.identify(docs, profiles).where((F.col(name) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(named(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates: that of the least doc_id (null first), of rows that repeat it one.

    Null and empty texts are one class. An empty table stays empty.
    """
    return nearjoin.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that occurred in an earlier document, or earlier in the same; documents that nothing is left of go.

    Earlier is by doc_id (null first), ties by a hash of the text. Null texts, and texts without words, stay as they are. An empty
    table stays empty.
    """
    return substring.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that the sources meet their target shares; a null source is one of them.

    Rows that repeat doc_id and text toss the same coin. Null texts have no words, and go by the rate of their source like others.
    An empty table stays empty.
    """
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences; a row for each piece. Null and empty texts are the end id alone, each row a document of its own.

    An empty table gives no piece.
    """
    return packing.packed(docs, tokens.public("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: The minima, rank orders and tokenizers of the stages are beyond SQL; tests/llm compares run() with a plain version on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut(spark.range(1))  # sets a folder where none is set
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
