"""The corpus pipeline: quality, language, near-duplicates, decontamination, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.llm import decontam, langid, packing, quality, simhash
from linework.llm.common import checked_broadcast, crc_mod
from linework.sources.scratch import fresh_path, put, remove, save, temporary


def _row(docs: DataFrame):
    """All columns of docs as one, so that no name of theirs meets one of an operator's."""
    return F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("__row")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts good; it learns from labels whose crc32 mod 3 isn't 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(docs, labels.where(crc_mod(F.col("doc_id"), 3) != 1))
    return quality.classify(docs, model, [_row(docs)], text_in="__row").where("predicted = 1").select("__row.*")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a text or a letter ('und') go."""
    samples = langid.learn(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    return langid.identify(docs, samples, [_row(docs)], text_in="__row").where(F.col("lang_pred") != langid.UNKNOWN).select("__row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest id, of those the one with the least text hash.

    Rows are told apart by id and text: ids that stand for several texts and rows without an id lose
    only the rows that their group can spare.  A row without an id stays only if its group has none with one.
    Rows equal in id and text become one, the least as JSON.
    """
    row_id, text_hash = docs["doc_id"], F.xxhash64(docs["text"].cast("string"))
    key = F.struct(row_id.isNull().alias("no_id"), row_id.alias("id"), text_hash.alias("th"))
    found = save(simhash.near_duplicates(docs.select(key.alias("key"), "text"), "key").select("key.id", "key.th", "kept"), "groups")

    def among(keys: DataFrame, name: str) -> tuple[DataFrame, Column]:
        keys = checked_broadcast(save(keys.select(F.col("id").alias("key_id"), F.col("th").alias("key_th")), name), 32)
        return keys, row_id.eqNullSafe(keys["key_id"]) & (text_hash == keys["key_th"])

    kept = docs.join(*among(found.where("not kept").distinct(), "spare"), "left_anti")
    repeated = found.where("kept").groupBy("id", "th").count().where("count > 1")
    twice, same = among(repeated, "repeated")
    if twice.isEmpty():
        return kept
    row = _row(docs)
    once = docs.join(twice, same, "left_semi").groupBy(row_id, text_hash).agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*")
    return kept.join(twice, same, "left_anti").unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no or hardly any benchmark text."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = save(found.where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), "contaminated")
    bad = checked_broadcast(bad, 24)
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["bad_hash"])
    return docs.join(bad, same, "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("language identification", keep_known_language),
    ("SimHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can express neither the trained stages nor XXH64; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are saved in the shared folder for the next.

    What a stage saved on its way goes with it, and its rows once the next one's stand; the last stage's tables
    stay, as its result reads them.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name.replace(" ", "-"))
        with temporary(spark):
            docs = put(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
