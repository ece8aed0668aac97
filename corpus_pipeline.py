"""Corpus pipeline: documents are filtered, deduplicated, masked, mixed and encoded.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from salesengine.llm import mixing, quality_rules, secret_scan, simhash
from salesengine.llm.common import stored, table, unused
from salesengine.llm.queries import MIX_BLOCK, MIX_WEIGHTS, token_digests


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_first(docs, simhash.near_duplicates(docs, shingle=3, radius=3))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; n_chars counts the characters anew."""
    length = "n_chars" if "n_chars" in docs.columns else None
    return secret_scan.mask(docs, secret_scan.train(docs), length_col=length)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are brought into the order of the mix: files hold them as they are to be read."""
    return mixing.in_order(docs, MIX_WEIGHTS, other=1, block=MIX_BLOCK)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every text, as counts and digests, with its position in the mix.

    That is its number in the order in which the files of the stage before hold the texts.
    """
    position = unused(docs, "position")
    placed = mixing.file_positions(docs.select("doc_id", "text"), position)
    return token_digests(placed, carry=position)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_duplicates", near_duplicates),
    ("secret_scan", secrets),
    ("mixing", mixed),
    ("bpe", encoded),
]
#: SQL can express neither the trained network nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
