"""A training corpus from raw documents: classified, deduplicated, decontaminated, mixed and encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from citeloom.llm.common import stored
from citeloom.llm.decontaminate import drop_contaminated
from citeloom.llm.mixing import mix_sources
from citeloom.llm.quality_fm import fit_quality, score_quality
from citeloom.llm.queries import word_vocabulary
from citeloom.llm.simhash import keep_one_of_each
from citeloom.llm.token_output import token_digests, write_tokens
from citeloom.session import scratch_dir

#: Documents scored below this go.
MIN_QUALITY = 0.3
#: Chunks of text that a worker keeps encoded; fewer than by default, as it has served the stages before. The ids are the same.
CACHED_CHUNKS = 60_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on the labelled ones, does not reject."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, model)
    return scored.where(F.col(scored.columns[-1]) >= MIN_QUALITY).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id."""
    return keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target weights of sources, languages and topics."""
    return mix_sources(docs).where("_sampled").select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left; returns their digests per document."""
    path = scratch_dir(spark)
    write_tokens(docs, path, word_vocabulary(), cached_chunks=CACHED_CHUNKS)
    return token_digests(spark, path)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: Scores, fingerprints and subword ids are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


