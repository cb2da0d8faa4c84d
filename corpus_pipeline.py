"""The corpus pipeline: documents through five operators, one table after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import mixing, packing, quality, simhash, substring
from tallyforge.llm._session import staged


# Every stage takes all rows of its predecessor, with columns of any further names. Null
# texts are empty ones and stay null where they stay; an empty table gives an empty one.


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier takes for good ones.

    Null texts and metadata are values like others; repeated rows are judged alike, and
    rows without an id too. Where no classifier can be fitted, all rows stay.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.kept(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8).

    The smallest id stays, nulls last, of one id's many texts that with the smallest
    digest. Empty and null texts are copies of each other. Rows that repeat an id with
    unlike texts are documents of their own.
    """
    return simhash.keep_one(docs, simhash.WIDE)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words and more that stand elsewhere too.

    Rows that lose every word go; rows without words, and null texts, stay as they are.
    Rows that repeat another wholly lose what they share, which is all windows.
    """
    return substring.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the curriculum.

    A null source is a source of its own, after all others. Rows that repeat an id, or
    have none, are taken and placed each by itself.
    """
    return mixing.curriculum(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all token pieces in training sequences.

    Null and empty texts are one piece of the end id alone; rows that repeat an id, or
    have none, give pieces of their own. Other columns are not read.
    """
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality_classifier", quality_filter),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]
#: The classifier, the wide fingerprints and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
