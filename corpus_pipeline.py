"""The training-data pipeline over ``documents``: filter, deduplicate, cut repeats, mix, encode.

Every stage is (spark, docs, sf_dir) -> DataFrame over all rows of ``docs``; all but the last keep its columns. Duplicates
are decided row by row, so of rows that repeat a doc_id or have none one stays too; where the mix decides by id, such
rows count as one document. An empty table passes through as empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from runquarry.llm import bpe, minhash, queries, repeats
from runquarry.llm.common import WORD, fixed, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7, by a classifier trained on those that have a label."""
    scored = queries.with_toxicity(docs, spark, sf_dir)
    return scored.where(F.col("_rq_score") < queries.TOXIC_FROM).select(*[scored[c] for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Rows are told apart by a number that is fixed before use, so repeated and null ids link like any others. The row of
    the smallest doc_id stays, null last. Texts without words link with nothing; of these, one of each doc_id and text stays.
    """
    rows = fixed(docs.withColumn("_rq_row", F.monotonically_increasing_id()), "rows")
    judged = minhash.near_duplicate_texts(rows, key="_rq_row", words=5, percent=80, unique=True)
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_rq")))
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.xxhash64("text").alias("c"), F.xxhash64(rest).alias("d"), F.col("_rq_row").alias("row"))
    wordless = F.col("text").isNull() | ~F.col("text").rlike(WORD)
    group = F.when(wordless, F.struct(F.col("doc_id").alias("i"), F.col("text").alias("t")))
    named = rows.select(F.col("_rq_row").alias("_rq_id"), order.alias("_rq_order"), group.alias("_rq_wordless"))
    named = judged.join(named, F.col("_rq_row") == F.col("_rq_id"))
    component = F.when(F.col("_rq_wordless").isNull(), F.col("component_id"))
    stay = named.groupBy(component.alias("_rq_component"), "_rq_wordless").agg(F.min("_rq_order").alias("_rq_least")).select(F.col("_rq_least.row").alias("_rq_stays"))
    return rows.join(stay, F.col("_rq_row") == F.col("_rq_stays"), "left_semi").select(*[rows[c] for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes that also start elsewhere; ``n_chars`` follows."""
    left = repeats.remove_repeats(docs, length=200, keep="text")
    return left.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else left


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    mixed = queries.mixed(docs)
    times = F.explode(F.sequence(F.lit(1), F.col("_rq_rounds")))
    return mixed.where("_rq_rounds > 0").withColumn("_rq_pass", times).select(*[mixed[c] for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("minhash_neardup", drop_near_duplicates), ("suffix_array_dedup", cut_repeats), ("mixing", mix), ("bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = fixed(stage(spark, docs, sf_dir), name)
    return docs
