"""The registered queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import oracles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    from rasterloom.llm.warc import archive_round_trip

    records = archive_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all whole texts; beside the model's own, those of the unigram reading of its vocabulary and their scores."""
    from rasterloom.llm.piece_model import UNIGRAM
    from rasterloom.llm.sentencepiece_codec import MODEL, read_model
    from rasterloom.llm.token_count import count_tokens

    counted = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), read_model(MODEL), kinds={"n_tokens": None, "n_unigram": UNIGRAM}, scores={"unigram_score": "n_unigram"}, double=True)
    return counted.select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tokens", "n_unigram", "unigram_score")))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 5-word shingle sets have a Jaccard similarity of 0.75 or more."""
    from rasterloom.llm.jaccard import components

    return components(table(spark, sf_dir, "documents").select("doc_id", "text"), size=5, num=75, den=100).select("doc_id", "n_shingles", "component_id")


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law ``rows``."""
    from rasterloom.llm.sharding import shuffle_into_shards

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return shuffle_into_shards(docs, n_shards=24).select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all whole texts, whether decoding gives the text again, and the best score of the unigram reading."""
    from rasterloom.llm.sentencepiece_codec import MODEL, encode, read_model

    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), read_model(MODEL), decoded=True, scored=True)
    return coded.select("doc_id", F.coalesce(F.array_size("token_ids"), F.lit(0)).cast("long").alias("n_tokens"), "token_ids", (F.col("decoded") == F.col("text")).alias("round_trip"), F.coalesce("path_score", F.lit(0.0)).alias("unigram_score"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all whole texts, learned from those that aren't held out."""
    from rasterloom.llm.langid import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    langs, model = fit(docs.where(~held_out()).select("lang", "text"))
    return identify(docs.select("doc_id", "text"), langs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "langs")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all other vectors for every vector whose id is divisible by 100."""
    from rasterloom.llm.topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of all whole texts, learned from labels of those that aren't held out."""
    from rasterloom.llm.common import stage
    from rasterloom.llm.langid import held_out
    from rasterloom.llm.quality import score_statistics, train, with_statistics

    stats = stage(with_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")), "stats")
    forest = train(stats.where(~held_out()), table(spark, sf_dir, "labels"))
    return score_statistics(stats, forest).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10-word windows of all benchmark items in all documents; n_near: items of which one of the phrases of 10 words into
    which they are cut, one behind the other, has its words in a stretch of 20 in any order (windows between two of these aren't searched)."""
    from rasterloom.llm.decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10, near=20)
    items = F.array_sort("items")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), "contaminated", F.size("near_items").cast("long").alias("n_near"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without bytes in 50-byte strings that also start in a document with a smaller id."""
    from rasterloom.llm.suffix_dedup import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=50, kept=None)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for every benchmark item."""
    from rasterloom.llm.lexical_search import build_index

    index = build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return index.search(table(spark, sf_dir, "benchmark").select("item_id", "text"), k=20)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors projected on the first 8 components of their covariance, with unit variance."""
    from rasterloom.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"), k=8, scale=1024, shift=100_000).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts as byte-level BPE ids, and the texts that decoding gives."""
    import public_tokenizers
    from rasterloom.llm.byte_bpe import encode, read_ranks

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = encode(docs, read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, results=("n_tokens", "token_data", "decoded_bytes"))
    return coded.select("doc_id", "n_tokens", F.sha2("token_data", 256).alias("ids_sha256"), F.sha2("decoded_bytes", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_langid, op3_top_k, op4_warc, op5_token_count, op6_jaccard, op7_shard, op8_quality, op9_decontaminate, op10_suffix_dedup, op11_lexical_search, op12_whitening, op13_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op3_top_k": oracles.TOP_K, "op4_warc": oracles.WARC, "op6_jaccard": oracles.JACCARD, "op10_suffix_dedup": oracles.SUFFIX_DEDUP, "op9_decontaminate": oracles.DECONTAMINATE, "op11_lexical_search": oracles.LEXICAL}
