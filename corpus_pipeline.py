"""A corpus from raw documents to a mix: five stages, each on all that the one before kept.

Rules reject documents, repeated blocks of lines are cut from later documents, one document of each near-duplicate
group stays, documents with benchmark passages go, and the rest is mixed to target weights. Parameters are those of
the registered queries of the operators; near-duplicates are texts whose fingerprints of four-word shingles differ in
four bits or fewer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm.decontamination import without_items
from logsieve.llm.line_dedup import without_repeats
from logsieve.llm.mixing import mix, mixed, mixed_texts
from logsieve.llm.quality_rules import keep_good
from logsieve.llm.simhash import keep_one, near_duplicates
from logsieve.session import materialise


MIX = {"weights": (5, 2, 1), "share": 1.5, "most": 2.0}


def reject_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, policy="v1")


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less their repeated blocks; ``n_chars``, where there is one, follows the text."""
    cut = without_repeats(docs, min_words=50)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, near_duplicates(docs, shingle=4))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document with the words the mix takes of it, added up from the pieces of the mix."""
    return mix(docs, **MIX)


STAGES = [
    ("quality rules", reject_by_rules),
    ("line dedup", cut_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("source mix", mix_sources),
]

#: Chains of similar texts and edit distances are beyond SQL; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all stages before the mix keep; each writes to the shared folder and the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a row per document that is left, with the words the mix takes of it."""
    return STAGES[-1][1](spark, _kept(spark, sf_dir), sf_dir)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus itself: the pieces of text by ``slot`` and ``at``, only of documents the mix takes."""
    docs = _kept(spark, sf_dir)
    return mixed_texts(docs, mixed(docs, **MIX))
