"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vialattice.llm import minhash, packing, pii, toxicity
from vialattice.llm.common import drop_path, materialize, table
from vialattice.llm.queries import pii_key


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the folder's labels, doesn't reject.

    A null or empty text is scored as an empty one; repeated rows are judged alike and stay; a folder
    without labels rejects nothing. The column named ``text`` is read, whatever differs from it by case.
    """
    return toxicity.keep_clean(docs, toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id.

    Documents without an id, or without words, have no near-duplicates and stay. Of rows that repeat
    an id one stays, the least by its other columns, text first.
    """
    judged = minhash.near_duplicates(docs)
    kept = judged.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    # joined in the same way at any size
    out = docs.join(kept.where("n = 1").hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    again = kept.where("n > 1")
    if again.limit(1).count():
        others = ["text", *(c for c in docs.columns if c not in ("doc_id", "text"))]
        first = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*others)).alias("row"))
        out = out.unionByName(first.select("doc_id", "row.*"))
    return out.unionByName(docs.where("doc_id is null"))


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; a null text stays null, and equal rows stay equal.

    Very long texts take time in proportion. The column named ``text`` is replaced, no other one.
    """
    return pii.replace_text(docs, pii_key(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens.

    A null or empty text has its end token alone; a null id stays null; repeated rows are packed as often
    as they occur. Other columns end here, whatever their names; an empty table has no pieces.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", keep_one_of_each), ("pii", pseudonymize), ("packing", pack)]

#: A learned model and a tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's documents; each one's result is written before the next, and goes after it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_path(spark, before)
        before = path
    return docs
