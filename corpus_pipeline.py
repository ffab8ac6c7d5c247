"""A corpus pipeline of five stages, each calling one operator of the library.

language ID -> near-duplicates -> personal data -> mixing -> packing. Every
stage gets what the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalmill.llm import langid, minhash, mixing, packing, pii
from evalmill.llm.common import shared_folder
from evalmill.llm.queries import tokenizer


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compressors tell; the rejected ones go.

    Null, empty and letterless texts are rejected; repeated rows and null ids are
    judged row by row; an empty table stays empty.
    """
    return langid.accepted(docs, langid.fit(docs, F.lit(True)))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the one with the smallest id.

    Rows without an id stay as they are. Different texts of one id are documents
    of their own, compared like others; of those that one group holds, and of
    repeated rows, the least stays. Empty and null texts are no copies.
    """
    key = F.coalesce(F.md5("text"), F.lit("null"))
    found = minhash.near_duplicates(docs, minhash.NearDup(), carry={"__key": key}).where("kept and doc_id is not null")
    alone = F.when(F.col("group").isNull(), F.col("__key"))  # without words
    least = found.groupBy("doc_id", "group", alone).agg(F.min("__key").alias("__key")).select("doc_id", "__key")
    kept = docs.withColumn("__key", key).join(least, ["doc_id", "__key"], "left_semi")
    # Of repeated rows the least by its other columns, whatever order they come in.
    order = Window.partitionBy("doc_id", "__key").orderBy(F.to_json(F.struct(*docs.columns)))
    once = kept.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").select(*docs.columns)
    return once.unionByName(docs.where("doc_id is null"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind.

    Null and empty texts stay; rows are judged one by one, repeated or without an
    id alike; an empty table stays empty.
    """
    return pii.redacted(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, rounded to whole documents.

    Documents without words (null and empty texts too) are not taken; rows of one
    id are told apart by source, size and text, equal ones count one by one; a
    null id or source is a value like others; an empty table stays empty.
    """
    size = F.col("size")
    rest = F.col("taken") % size
    times = F.when(size > 0, F.floor(F.col("taken") / size) + (2 * rest >= size).cast("long")).otherwise(0)
    taken = mixing.mix(docs).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__words"), F.col("same").alias("__same"), times.cast("int").alias("__times")).where("__times > 0")
    keyed = docs.withColumn("__size", mixing.word_count("text"))
    order = Window.partitionBy("doc_id", "source", "__size").orderBy(F.xxhash64("text"), "text")
    rows = keyed.withColumn("__number", F.row_number().over(order))
    same = rows["doc_id"].eqNullSafe(taken["__id"]) & rows["source"].eqNullSafe(taken["__source"]) & (rows["__size"] == taken["__words"]) & (rows["__number"] == taken["__same"])
    return rows.join(taken, same).withColumn("__again", F.explode(F.sequence(F.lit(1), "__times"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, ids included (little-endian unsigned 32-bit bytes).

    Null texts are empty documents; an empty table gives no pieces; other columns go.
    """
    return packing.packed(docs, **tokenizer(), with_ids=True, added_tokens=True)


STAGES = [("langid", identify), ("near_dedup", deduplicate), ("pii", redact), ("mixing", mix), ("packing", pack)]

#: Compression sizes, spans and token ids are beyond SQL; tests hold the near-duplicate stage against brute force and each operator against its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables go to the cluster's shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
