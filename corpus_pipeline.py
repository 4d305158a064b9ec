"""A training corpus in five stages, each on all that the one before kept.

Language identification turns away what it cannot tell, one document of each near-duplicate group stays, private
data get pseudonyms, documents are sampled to the target mix, and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import common, op4_pseudonyms, op6_langid, op7_ngram_join, op9_mixing, op10_packing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is not rejected; a null or letterless text is."""
    return op6_langid.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones, that of the smallest id; rows are judged each by its own text, those without an id too."""
    return op7_ngram_join.first_of_each(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by pseudonyms of the same form; null texts stay null, repeated rows alike, an empty table empty."""
    count = common.fresh(docs, "n_pii")
    changed = op4_pseudonyms.pseudonymised(docs, op4_pseudonyms.key_of(spark), count)
    size = F.when(F.col(count) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return changed.select(*[size.alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the raked weights sample; nulls are values of their own, repeated rows share their fate, an empty table stays empty."""
    return op9_mixing.sample(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences; null texts are empty, repeated rows are packed each, an empty table gives none."""
    return op10_packing.pack(docs)


STAGES = [
    ("language_6", language),
    ("ngram_join_7", near_duplicates),
    ("pseudonyms_4", private_data),
    ("mixing_9", mixing),
    ("packing_10", packing),
]

#: The first stage's model is trained by gradient descent, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
