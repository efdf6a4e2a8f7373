"""Joined views of the tables: an event's dossier, the evidence certificate's figures, the integrity list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def placed_events(raw: DataFrame, projection: DataFrame, leaves: DataFrame, batches: DataFrame) -> DataFrame:
    """Raw events with their bytes in hexadecimal, projection and place in the ledger; what is missing is null."""
    place = leaves.select("event_uid", "batch_id", "leaf_index").join(batches.select("batch_id", F.col("root").alias("batch_root")), "batch_id", "left")
    own = projection.drop(*(c for c in raw.columns if c in projection.columns and c != "event_uid"))
    return raw.withColumn("raw_hex", F.hex("raw_bytes")).join(own, "event_uid", "left").join(place, "event_uid", "left")


def certificate(batches: DataFrame, verified: DataFrame, raw: DataFrame) -> DataFrame:
    """One row: period, counts, chain head, and the first batch that doesn't verify with its reason. verified: ledger.verify()'s rows."""
    chain = batches.agg(F.count("*").alias("batch_count"), F.coalesce(F.sum("leaf_count"), F.lit(0)).alias("event_count"), F.max_by("root", "batch_id").alias("chain_head"))
    bad = verified.filter("reason IS NOT NULL").agg(F.min(F.struct("batch_id", "reason")).alias("first_bad"))
    period = raw.agg(F.min("received_at_ns").alias("from_ns"), F.max("received_at_ns").alias("until_ns"), F.array_sort(F.collect_set("source_id")).alias("sources"))
    # three single rows
    return chain.join(F.broadcast(bad), F.lit(True)).join(F.broadcast(period), F.lit(True)).withColumn("intact", F.col("first_bad").isNull())


def source_table(raw: DataFrame, registry) -> DataFrame:
    """The certificate's sources: events and period of each, with the mapping (version, content hash, who approved it) by which it is read."""
    per = raw.groupBy("source_id").agg(F.count("*").alias("events"), F.min("received_at_ns").alias("from_ns"), F.max("received_at_ns").alias("until_ns"))
    rows = [(s, m.format, m.version, m.content_hash(), m.approved_by) for s, m in sorted(registry.mappings().items())]
    known = raw.sparkSession.createDataFrame(rows, "source_id string, format string, version int, mapping_hash string, approved_by string")
    return per.join(F.broadcast(known), "source_id", "left")  # a row for each mapping


def last_batches(batches: DataFrame, limit: int = 40) -> DataFrame:
    return batches.orderBy(F.desc("batch_id")).limit(limit).orderBy("batch_id")
