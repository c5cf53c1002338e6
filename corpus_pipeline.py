"""From raw documents to packed training sequences, one written table per stage.

Defined results of all stages: rows are judged each, whatever their doc_id, so null and repeated ids do no harm; of equal or
near-equal texts one row stays, that with the smallest doc_id (null last); null and empty texts are scored, grouped and packed
like any others (a null text is a sequence of the end token alone); further columns are kept up to the last stage, whatever
their names; an empty table stays empty, and without labels of both kinds no document is rejected. Each stage's table is
written to the shared folder that spark.checkpoint.dir names, under isobarn/, and stays there until its owner clears it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isobarn.llm import decontaminate, near, packing, pii, quality
from isobarn.llm.common import materialize, table, with_tag
from isobarn.llm.queries import tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Rows get the number by which later stages tell them apart."""
    return with_tag(quality.keep_good(docs, quality.trained(docs, table(spark, sf_dir, "labels"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates (five words, similarity 0.8) stays."""
    return near.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    return pii.redact(docs, pii.selector(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents that are left."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_filter),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Not expressible in SQL: the stages hold learned models, a tokenizer and a packing heuristic.
ORACLE_SQL = None
