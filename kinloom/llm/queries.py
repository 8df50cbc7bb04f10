"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import (
    decontamination,
    embedding_join,
    langid,
    merkle,
    mixing,
    ngram_join,
    pii,
    secret_scan,
    sharding,
    substring_dedup,
    suffix_index,
    warc,
    whitening,
)
from kinloom.llm.common import load, new_path
from kinloom.llm.oracles import ORACLE_SQL


__all__ = ["ORACLE_SQL", "QUERIES"]


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix at 150 % of all words takes from every document."""
    return mixing.taken_words(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op2_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes; equal texts share a shard."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumns({"size": sharding.text_size(F.col("text")), "text_crc32": F.crc32(text.cast("binary")),
                             "key": sharding.group_key(F.col("text"))})
    placed = sharding.assign_keyed(docs.drop("text"), 8, ("doc_id",))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the rows that are not held out."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = langid.learn(docs.filter(~langid.held_out()))
    return langid.identify(docs.select("doc_id", "text"), models).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected"
    )


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of benchmark items, and the most similar window for each item."""
    found = decontamination.leaks(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "first_word", F.round("similarity", 6).alias("similarity"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles overlap by 85 %."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.near_classes(docs, ngram_join.Options(width=4, similar=85))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: pattern spans and those that the random field adds."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.learn(docs)))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return embedding_join.near_vectors(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for their personal numbers, dates and addresses. The key is a placeholder."""
    return pii.pseudonymised(load(spark, sf_dir, "documents").select("doc_id", "text"), key="example key")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stay when 50-word passages of earlier documents go."""
    return substring_dedup.dedup_words(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archive back, and report each record."""
    path = new_path(spark, "warc")
    warc.write_archive(load(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.page_digests(spark, path)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on up to 16 whitened principal components, fitted on the distinct ones."""
    return whitening.whitened_rows(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof for every document in a Merkle tree over languages, and whether it bears out the row as it is claimed."""
    return merkle.manifest(load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that stay when strings of 400 bytes that also stand elsewhere go."""
    return suffix_index.dedup_bytes(load(spark, sf_dir, "documents").select("doc_id", "text"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of operator 1 SQL can say: sizes, and the targets of sources after all excess is dealt again."""
    return op1_source_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def shard_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of operator 2 SQL can say: sizes and checksums, and that its laws hold: equal texts together, slots without
    gaps, and no shard larger than an equal share and one group."""
    placed = op2_minimax_sharding(spark, sf_dir)
    group = placed.groupBy("text_crc32", "size").agg((F.countDistinct("shard") == 1).alias("together"), F.sum("size").alias("bytes"))
    shard = placed.groupBy("shard").agg((F.countDistinct("slot") == F.count("*")).alias("own"), (F.max("slot") + 1 == F.count("*")).alias("full"), (F.min("slot") == 0).alias("first"), F.sum("size").alias("shard_bytes"))
    bounds = group.agg(F.sum("bytes").alias("total"), F.max("bytes").alias("largest")).first()  # two numbers
    even = F.col("shard_bytes") <= (bounds["total"] or 0) / 8 + (bounds["largest"] or 0)
    out = placed.join(group.drop("bytes"), ["text_crc32", "size"]).join(F.broadcast(shard), "shard")  # a row a shard
    return out.select("doc_id", "size", "text_crc32", "together", (F.col("own") & F.col("full") & F.col("first")).alias("gapless"), even.alias("level"))


def language_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of operator 3 SQL can say: which documents are held out, which have no letter, and that scores are shares."""
    told = op3_language_id(spark, sf_dir)
    return told.select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("undecided"), F.col("score").between(0, 1).alias("in_range"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of operator 6 SQL can say: how many spans its patterns find."""
    return op6_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_minimax_sharding": op2_minimax_sharding,
    "op3_language_id": op3_language_id,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_secret_scan": op6_secret_scan,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_pii_pseudonyms": op8_pii_pseudonyms,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_warc_archive": op10_warc_archive,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_suffix_array_dedup": op13_suffix_array_dedup,
    "mix_targets": mix_targets,
    "shard_laws": shard_laws,
    "language_laws": language_laws,
    "secret_counts": secret_counts,
}
