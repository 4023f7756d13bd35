"""A corpus pipeline: reject toxic documents, near duplicates and leaks, mix sources, write token ids.

``STAGES`` lists the stages in order. A stage takes (spark, docs, sf_dir) and
returns a DataFrame; ``run`` writes each one as Parquet to the shared folder and
reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairweave.llm.decontaminate import without_leaks
from pairweave.llm.minmax_dedup import without_near_duplicates
from pairweave.llm.mixing import mixed_documents
from pairweave.llm.queries import public_tokenizer
from pairweave.llm.token_store import tokenised
from pairweave.llm.toxicity import fit, without_toxic
from pairweave.session import discard, materialize, work_scope


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network does not reject; it learns from the labels of these documents.

    Null, empty and wordless texts are not toxic. Without labels every text is kept.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels)
    return docs if model is None else without_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose runs of five words agree to 0.8 or more."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, edited or not."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document in the token files: ``doc_id, start, n_tokens, ids_crc32``."""
    return tokenised(docs, public_tokenizer())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", tokens),
]

# a trained network and a tokenizer are not SQL; tests compare with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with work_scope() as keep:  # what a stage wrote on its way goes when its result is written
            docs = keep(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before is not None:
            discard(before)
        before = docs
    return docs
