"""A corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all but the last give the columns of
``documents``. ``run`` writes each stage's rows as Parquet in the shared folder and reads them again for the next.
SQL cannot express the stages (hashed shingle sets, keyed permutations, byte-pair ids); tests hold them against brute force.

Defined results, of each stage as of its operator: null texts have no words and go at the first stage, as do empty ones; ties and
repeated rows are settled the same way in every run; columns of any name pass through all stages but the last, and columns
besides ``doc_id``, ``text``, ``lang`` and ``n_chars`` are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontam, packing, pii, quality_rules, similar
from corvane.llm.common import materialize, table
from corvane.session import ship

ORACLE_SQL = None
#: Session setting of the secret key of pseudonyms.
KEY_SETTING = "spark.corvane.pseudonymKey"
#: Words that a packing task of the pipeline keeps the ids of.
PACKING_CACHE = 120_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules keep."""
    ship(spark)
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: SimHash of five-word shingles, similarity 0.8 or more by an exact check."""
    ship(spark)
    return similar.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the benchmark."""
    ship(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pseudonym_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data, under the key that ``KEY_SETTING`` holds."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with the demonstration key, which anyone can read", stacklevel=2)
    return pii.pseudonymize(docs, key or pii.DEMO_KEY)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences; a small word cache leaves memory for the stages before."""
    ship(spark)
    return packing.pack(docs, cache_words=PACKING_CACHE).drop("ids")


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pseudonyms", pseudonym_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
