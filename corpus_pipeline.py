"""From raw documents to token ids: five stages, each the next one's input.

Every stage but the last returns the columns of ``documents``. Defined results: an empty table passes through; null texts count
as empty in the first four stages and have null ids in the last; extra columns are carried along to the last stage. Of
near copies and repeated rows the one with the smallest id stays (of equal ids, the first in the order of set keys and texts). Extra
columns may have any name, also one that an operator's results have; very long texts are worked off whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import decontaminate, jaccard, quality, sentencepiece_codec, suffix_dedup
from rasterloom.llm.common import stage
from rasterloom.llm.langid import held_out

#: A document stays if its quality score is this or more.
LEAST_QUALITY = 0.7


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """docs with every column but doc_id and text under a name that no operator uses, and all columns by their own names."""
    other = {c: f"__own{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed(other), {c: F.col(other.get(c, c)).alias(c) for c in docs.columns}


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labels of documents that aren't held out."""
    stats = stage(quality.with_statistics(docs.where(~held_out()).select("doc_id", "text")), "stats")
    forest = quality.train(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs, own = _aside(docs)
    return quality.score_texts(docs, forest).where(F.col("score") >= LEAST_QUALITY).select(*own.values())


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (5-word shingles, Jaccard similarity 0.75)."""
    return jaccard.representatives(docs, size=5, num=75, den=100)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 50 bytes that a document with a smaller id has too; characters cut in two go as well."""
    kinds = dict(docs.dtypes)
    docs, own = _aside(docs)
    own["text"] = F.col("kept_text").alias("text")
    if "n_chars" in own:
        own["n_chars"] = F.length("kept_text").cast(kinds["n_chars"]).alias("n_chars")
    return suffix_dedup.remove_repeats(docs, length=50, kept="text").select(*own.values())


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a 10-word window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids and whether decoding gives the text again."""
    coded = sentencepiece_codec.encode(docs, sentencepiece_codec.read_model(sentencepiece_codec.MODEL), decoded=True, slice_bytes=512 << 10)
    return coded.select("doc_id", "lang", "source", F.coalesce(F.array_size("token_ids"), F.lit(0)).cast("long").alias("n_tokens"), "token_ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("suffix_array_dedup", remove_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", to_tokens),
]

#: The first stage is a learned classifier, which SQL can't express. Tests hold the operators against brute force, and of the stages
#: check columns, falling counts, that no linked pair is left and that ids decode to their texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
