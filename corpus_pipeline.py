"""The training-data pipeline over ``documents``: each stage applies one operator
of :mod:`tendermatch.llm` to all that the stage before it kept. Stages are
functions of (spark, docs, sf_dir); the result of each is written as Parquet
to the shared checkpoint folder and read again for the next one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendermatch.llm import bpe, line_dedup, minhash_dedup, mixing, quality_mil
from tendermatch.llm.common import pin, read
from tendermatch.llm.queries import quality_model, rank_file


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    scored = quality_mil.score(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), "text"),
                               quality_model(spark, sf_dir))
    return scored.where("predicted = 1").select("own.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has too go; ``n_chars`` follows the text."""
    return line_dedup.drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash_dedup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights; a document comes once per epoch that it is drawn in."""
    return mixing.mix(docs).select("own.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the decoded bytes. The workers' tables are small:
    they share the executors with what the stages before have left in memory."""
    return bpe.encode_documents(docs, rank_file(), public_tokenizers.PATTERN, max_pieces=40_000, max_states=50_000)


STAGES = [("quality classifier", keep_quality), ("line dedup", drop_lines), ("MinHash near-dedup", drop_near_copies),
          ("mixing to target weights", mix), ("byte-level BPE", tokenise)]

#: The learned and sketched stages have no SQL form; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = pin(docs, f"stage-{k}")
    return docs
