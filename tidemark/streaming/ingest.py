"""Streaming ingest: micro-batches through capture, append and normalising, keyed re-observation, and template mining."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import identity, ledger, store, templates
from tidemark.plans.mapping import Registry
from tidemark.plans.normalize import normalize

REOBSERVE_MS = 60_000
#: What mine_stream() writes: lines with their templates, and with neither the trees.
MINED = "source string, size int, line_id bigint, template string, tree string"


def read_lines(spark, path: str) -> DataFrame:
    """Closed or rotated log files as a stream of byte rows; blank lines are left out."""
    lines = spark.readStream.format("text").load(path)
    return lines.filter(F.length(F.trim("value")) > 0).select(F.col("value").cast("binary").alias("raw_bytes"))


def scan_lines(spark, path: str) -> DataFrame:
    """The lines of files as bytes, with their file's `path`; blank lines are left out."""
    lines = spark.read.format("text").load(path).select(F.input_file_name().alias("path"), "value")
    return lines.filter(F.trim("value", F.lit(" \t\r\n")) != "").select("path", F.col("value").cast("binary").alias("raw_bytes"))


def ingest(
    lines: DataFrame, source_id: str | None, raw_path: str, registry: Registry, checkpoint: str, received_at_ns: Callable[[int], int], sink: Callable[[DataFrame, int], None],
    transport: str = "file", once: bool = True, seal: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Appends each micro-batch to the raw table, seals its events with `seal`, then hands its records to `sink`.

    Without a `source_id` the lines' own column counts, so one stream takes many sources (as sources.tail gives them).
    received_at_ns gives a batch's receipt time from its number, so a batch that is run
    again has the same keys, appends nothing and seals nothing; its records are handed on again, as the first run may have failed before
    its sink was done. Mappings are taken up between batches.
    """

    def batch(df: DataFrame, number: int) -> None:
        registry.refresh()
        raw = identity.capture(df, source_id or F.col("source_id"), F.lit(received_at_ns(number)), transport=transport)
        store.append(raw, raw_path)
        once_each = store.new_events(raw)
        if seal:
            seal(once_each, number)
        sources = [source_id] if source_id else [r[0] for r in raw.select("source_id").distinct().collect()]  # of one batch
        if sources:
            sink(normalize(once_each, registry, sources=sources), number)

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="3 seconds")).start()


def sealing(ledger_path: str, registry: Registry, now_ns: Callable[[], int], batch_size: int = ledger.BATCH_SIZE, batch_ns: int = ledger.BATCH_NS) -> Callable[[DataFrame, int], None]:
    """Seals the events of a micro-batch: full batches at once, the rest when it has waited long enough. Reads no other raw event."""

    def seal(raw: DataFrame, number: int) -> None:
        ledger.seal(raw, ledger_path, registry.hashes(), now_ns(), batch_size, flush=False, batch_ns=batch_ns)

    return seal


def reobserve(sightings: DataFrame, key_cols: list[str], timeout_ms: int = REOBSERVE_MS) -> DataFrame:
    """Sightings to report: a key's first, then each that is `timeout_ms` or more after the last reported.

    The rule is sequential, so a key's rows stream through one task in order; the task
    holds one time for the key and never its rows, whatever their number.
    """
    schema = sightings.schema
    ordered = sightings.repartition(*key_cols).sortWithinPartitions(*key_cols, "at_ms")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for part in parts:
            keep = []
            for own, at in zip(part[key_cols].itertuples(index=False, name=None), part["at_ms"], strict=True):
                new = own != key or at - last >= timeout_ms
                if new:
                    key, last = own, at
                keep.append(new)
            yield part[keep]

    return ordered.mapInPandas(run, schema)


def mined_parts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of MINED for rows (`source`, `size`, `line_id`, `line`, `tree`) that are sorted by group, a group's tree so far first; a part's rows leave before the next part is asked for."""
    names = ["source", "size", "line_id", "template", "tree"]

    def ended(group: tuple, miner: templates.Miner) -> pa.RecordBatch:
        rows = ([group[0]], [group[1]], [None], [None], [miner.dumps()])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True)], names=names)

    group, miner, texts = None, templates.Miner(), {}
    for part in parts:
        found, done = [], []
        for source, size, line, tree in zip(*(part.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
            if (source, size) != group:
                if group:
                    done.append(ended(group, miner))
                group, miner, texts = (source, size), templates.Miner.loads(tree) if tree else templates.Miner(), {}
            if tree:
                found.append(None)
                continue
            before = miner.changes
            at = miner.add_text(line)
            if miner.changes != before:
                texts.clear()
            if at not in texts:
                texts[at] = " ".join(miner.templates[at])
            found.append(texts[at])
        out = pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(found, pa.string()), pa.nulls(len(found), pa.string())], names=names)
        yield out.filter(part.column(4).is_null())
        yield from done
    if group:
        yield ended(group, miner)


def mine_stream(lines: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Template mining over a stream into the table that mined() reads: the template of each line's cluster as it is after the line. lines: source, line_id, text.

    Each (source, number of tokens) keeps its tree; within a micro-batch its lines are taken in order of `line_id`. Spark sorts them and spills, and they
    stream through a task that holds the tree and a batch of rows, so a micro-batch can be of any size. A micro-batch's lines, and the trees after it,
    are one folder, `batch=<number>`: one that is run again starts from the same trees and writes its folder anew. `path` belongs to `checkpoint`.
    """

    def batch(df: DataFrame, number: int) -> None:
        cut = F.coalesce(templates.tokens(templates.mask(F.col("text"))), F.array().cast("array<string>"))
        null = F.lit(None).cast("string")
        rows = df.select("source", "line_id", cut.alias("t")).select("source", F.size("t").alias("size"), "line_id", F.array_join("t", " ").alias("line"), null.alias("tree"))
        if number:
            before = df.sparkSession.read.schema(MINED).parquet(f"{path}/batch={number - 1}").filter("tree IS NOT NULL")
            rows = rows.unionByName(before.select("source", "size", "line_id", null.alias("line"), "tree"))
        dealt = rows.repartition("source", "size").sortWithinPartitions("source", "size", F.col("tree").isNull(), "line_id")
        dealt.mapInArrow(mined_parts, MINED).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="3 seconds")).start()


def mined(spark: SparkSession, path: str) -> DataFrame:
    """`source`, `size`, `line_id`, `template` of the lines that mine_stream() has written; each line once."""
    return store.read_projection(spark, path, MINED).filter("tree IS NULL").select("source", "size", "line_id", "template")
