"""The thin opN queries over the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import ann, chat, filter_audit, media, mixing, ngram_lm, packing, periodic, quality, secrets, simhash, substring, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), simhash.RING)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(_table(spark, sf_dir, "documents"))
    columns = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return media.read(stored).select(*columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.told(_table(spark, sf_dir, "documents"))
    position = F.round(F.expr(mixing.place_sql()), 6)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies", position.alias("position"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_chats(turns.unionByName(extra)))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), packing.default_tokenizer())


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    rows = quality.scored(docs.select("doc_id", "text", "lang", "source", "n_chars"), model)
    return rows.select("doc_id", "text_score", "meta_score", "score", (F.col("score") >= quality.KEEP).alias("kept"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.parse(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", substring.sha256_of("kept").alias("kept_sha256"), "n_factors")


def op8_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(_table(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.find(periodic.bent(_table(spark, sf_dir, "documents"))))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(_table(spark, sf_dir, "documents")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_media": op2_media,
        "op3_mixing": op3_mixing,
        "op4_chat": op4_chat,
        "op5_packing": op5_packing,
        "op6_quality": op6_quality,
        "op7_substring": op7_substring,
        "op8_ngram_lm": op8_ngram_lm,
        "op9_ann": op9_ann,
        "op10_warc": op10_warc,
        "op11_periodic": op11_periodic,
        "op12_secrets": op12_secrets,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.oracle_sql(), "op4_chat": chat.oracle_sql(), "op10_warc": warc.oracle_sql(), "op11_periodic": periodic.oracle_sql(), "op12_secrets": secrets.oracle_sql(), "op13_filter_audit": filter_audit.oracle_sql()}
