"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, gifcols, jaccard, langid, licenses, mixing, ranges, secretscan, sharding, sql, sql_pairs, substring, topk, turns, whitening


def vocabulary_file(name: str) -> str:
    """Where the public vocabulary files are: a folder in the environment, or the installed package."""
    folder = os.environ.get("GEOQUILL_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.find(_documents(spark, sf_dir).select("doc_id", "text"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    return langid.identify(docs, vocabulary_file("piece_bpe_32k.model")).select("doc_id", "held_out", "lang_pred", "score")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "position")


def op4_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = gifcols.encode(_documents(spark, sf_dir).select("doc_id", "text"))
    read = gifcols.decode(media)
    frames = F.col("frames")
    levels = F.aggregate(F.slice("frames", 2, F.size(frames)), F.try_element_at(frames, F.lit(1))["histogram"], lambda a, f: F.zip_with(a, f["histogram"], lambda x, y: x + y))
    feature = F.concat_ws(";", F.size(frames).cast("string"), F.aggregate(frames, F.lit(0), lambda a, f: a + f["delay"]).cast("string"), F.array_join(F.transform(levels, lambda x: x.cast("string")), ","))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return bpe.encode(docs, vocabulary_file("byte_bpe_50k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(_documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op11_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.near(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_substring, op2_langid, op3_mix, op4_gif, op5_jaccard, op6_bpe, op7_secrets, op8_topk, op9_shard, op10_licenses, op11_ranges, op12_turns, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql() | sql_pairs.oracle_sql()
