"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.session import cut_lineage


def fold(of: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(of.cast("string").cast("binary")), F.lit(parts))


def sample(documents: DataFrame, labels: DataFrame, label: str, taken: Column, size: int, shards: int) -> DataFrame:
    """``(doc_id, text, y, shard)`` of at most ``size`` labelled documents whose id passes ``taken``.

    Ids are taken in the order of a hash of the id. Null labels and ids are no labels; a document
    labelled both ways counts as 1. Of repeated rows of a document the smallest text counts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    known = known.filter(taken).groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Ids first: the top-k is narrow, and at most ``size`` of them meet the texts.
    present = cut_lineage(known.join(texts.select("doc_id").distinct(), "doc_id").withColumn("h", F.xxhash64("doc_id")))
    # Only the hashes that the first ``size`` ids can have are put in order.
    share = min(1.0, (2 * size + 1000) / max(1, present.count()))
    low = present.filter(F.col("h") <= int(-(2**63) + share * (2**64 - 2**12)))
    chosen = low.orderBy("h", "doc_id").limit(size).drop("h")
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return joined.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).cast("int"))
