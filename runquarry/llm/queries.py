"""The queries of this subpackage with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from runquarry.functions.scale import scratch_path
from runquarry.llm import alignment, bpe, conversations, html, minhash, mixing, rank_bpe, repeats, token_files, topk, toxicity, urls, vectors
from runquarry.llm.common import read, word_count

SOURCE_WEIGHTS, SOURCE_SHARE = (5, 2, 1), 1.5
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
TOXIC_FROM = 0.7


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``rounds`` of the mix of sources, the size in words, and the size and target of the source."""
    size = word_count(F.col("text"))
    sizes: dict = {}
    targets: dict = {}

    def quota(capacity):
        sizes.update({p[0]: n for p, n in capacity.items()})
        targets.update(mixing.capped_targets(sizes, SOURCE_WEIGHTS, SOURCE_SHARE))
        return targets

    out = mixing.mix_sources(docs, F.array("source"), size, quota, passes=2, rounds="_rq_rounds")
    known = mixing.local_frame(docs.sparkSession, [(s, int(n), float(targets[s])) for s, n in sizes.items()], "_rq_source string, source_size bigint, target double")
    return out.join(known, F.col("source").eqNullSafe(F.col("_rq_source")), "left").select(
        *[out[c] for c in docs.columns], "_rq_rounds", size.alias("_rq_size"), F.coalesce("source_size", F.lit(0)).alias("_rq_source_size"),
        F.coalesce("target", F.lit(0.0)).alias("_rq_target"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixed(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return m.select("doc_id", F.col("_rq_size").alias("size"), F.col("_rq_source_size").alias("source_size"), F.col("_rq_target").alias("target"),
                    (F.col("_rq_size") * F.col("_rq_rounds")).alias("taken"))


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(read(spark, sf_dir, "embeddings"), threshold=0.98)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", topk.integer_terms(F.col("embedding"), 64).alias("terms"))
    return topk.top_k(rows, rows.where(F.col("vec_id") % 20 == 0), "vec_id", "terms", k=20)


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_texts(read(spark, sf_dir, "documents"), words=3, percent=85)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, read(spark, sf_dir, "labels"),
                             outcome_key="doc_id", outcome="quality")
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_token_files(spark, path, digest=True)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(read(spark, sf_dir, "pages"))


def with_toxicity(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``docs`` with ``_rq_score``, from a classifier trained on the labelled ones of these documents that are not held out."""
    labels = read(spark, sf_dir, "labels").where(F.col("toxic").isNotNull() & (toxicity.fold(F.col("doc_id")) != 1))
    labels = labels.groupBy(F.col("doc_id").alias("_rq_label_id")).agg(F.max("toxic").alias("_rq_toxic"))
    known = docs.join(labels, F.col("doc_id") == F.col("_rq_label_id"))
    model = toxicity.fit_toxicity(known.select("doc_id", "text", "_rq_toxic"), "doc_id", "text", "_rq_toxic")
    return toxicity.score_toxicity(docs, model, score="_rq_score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = with_toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), spark, sf_dir)
    return scored.select("doc_id", F.coalesce(toxicity.fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), F.col("_rq_score").alias("score"),
                         (F.col("_rq_score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"), length=200)


def op11_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_bpe.encode_words(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(read(spark, sf_dir, "conversations"))
    return conversations.repair_conversations(damaged, copies="copies")[0]


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                                      public_tokenizers.path("piece_bpe_32k.model"))[0]


_QUERIES = [op1_mix_sources, op2_embedding_neardup, op3_exact_topk, op4_bpe_roundtrip, op5_minhash_neardup, op6_url_filter, op7_token_files, op8_html_text, op9_toxicity, op10_repeated_passages,
            op11_rank_bpe, op12_conversation_repair, op13_tokenizer_alignment]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    from runquarry.llm.oracles import ORACLES

    return dict(ORACLES)
