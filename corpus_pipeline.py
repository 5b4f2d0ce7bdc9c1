"""From raw documents to token ids: five stages, each of one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import decontamination, exact_dedup, jaccard_join, piece_viterbi, quality_ftrl
from folium.llm.common import free_name, written

#: Documents below this quality go. A clean document scores near 1, and one in doubt stays.
LEAST_QUALITY = 0.5
#: Word shingles and percent of similarity of near duplicates.
SHINGLE, SIMILAR = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; without labels of both kinds it rejects none."""
    model = quality_ftrl.fitted(spark, sf_dir, docs)
    score = free_name(docs, "folium_score")
    return quality_ftrl.score_documents(docs, model, score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then of the smallest doc_id."""
    return exact_dedup.drop_duplicates(docs)


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest doc_id."""
    return jaccard_join.keep_one(docs, SHINGLE, SIMILAR)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_bytes, ids_crc32, round_trip and ids of every document."""
    import public_tokenizers

    return piece_viterbi.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", deduplicated),
    ("n-gram Jaccard join", near_deduplicated),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding and decoding", encoded),
]

#: SQL can't express the classifier or the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
