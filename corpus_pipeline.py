"""A corpus pipeline over documents: language, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns a DataFrame that is written and
read again as the next one's docs; all but the last keep the columns of documents.

Null texts, and texts without a letter, go in the first stage; rows without an id go through all of them. Repeated rows of
one id are one document for the second stage, and rows of their own for all others; texts of any length are read whole; of
equal or similar texts the least doc_id stays; columns with clashing names pass through until the last stage, which gives
its own columns only. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from beamframe.llm import decontaminate, jaccard, language, packing, pii
from beamframe.llm.encode import vocabulary
from beamframe.llm.shared import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without a letter go; a code-switched text stays. Which label the CRF gives, and its score, reject no document."""
    model = language.learn(docs)
    if not model.labels:  # nothing to learn from: "und" then says nothing of a text
        return docs.where(language.has_letter(docs["text"]))
    found = language.identify(docs, model, docs.columns)
    return found.where("lang_pred != 'und'").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group of similar texts stays; rows without an id stay."""
    losers = jaccard.similar_groups(docs, (80, 100), 5).where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(losers, "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), size=1024, end_id=2, with_ids=True, free=True)


STAGES = [
    ("language_crf", identify_language),
    ("jaccard_trees", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("pii_boosting", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: Trained models, tokenizers and packing plans have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
