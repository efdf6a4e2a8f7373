"""Sealing and verification: ordered Merkle batches of raw events, chained.

Events are numbered without a global sort in one task: ranges of (time, uid) are sorted
by the cluster and written, the ranges' sizes (one row for each) give their offsets, and
numbers within a range follow. Leaves are hashed by native expressions: subtrees of SPAN
leaves are folded as rows, and only their roots are shuffled again. Only the chain itself,
one root after the other, is a sequence; its task streams the sorted roots of one seal
and holds the last one.

A ledger is a folder of Parquet tables that only grow: `batches`, `leaves` (by day of receipt), `nodes` (the
batches' Merkle trees), and `steps`, the journal. Events that fill no batch yet wait in `open`. Each
call of seal() is a step with a name of its own: it writes leaves, nodes, batches and what is open now under
that name, and its row in `steps` last. What a step that failed left behind has no such row and counts for
nothing; a step that is run again seals the same events. A step reads the events it is given, the open batch, and of the
leaves only the days of these events, so its cost doesn't grow with the ledger. One
writer at a time is assumed.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import released, written
from tidemark.operators.identity import div

GENESIS = "0" * 64
BATCH_SIZE, BATCH_NS, SPAN = 5000, 1_000_000_000, 4096
BATCHES = "batch_id bigint, prev_root string, root string, leaf_count bigint, first_uid string, last_uid string, sealed_at_ns bigint, mapping_set string, seal string"
LEAVES = "batch_id bigint, leaf_index int, event_uid string, raw_hash string, seal string, day string"
NODES = "batch_id bigint, level int, i bigint, hash string, seal string"
OPEN = "event_uid string, raw_hash string, received_at_ns bigint"
#: seal: the step's name; open_since_ns: when the first event that is open now was added; the last batch and its root so far.
STEPS = "step bigint, seal string, batches bigint, last_batch bigint, head string, n_open bigint, open_since_ns bigint"
CHECKPOINTS = "checkpoint_id bigint, day string, first_batch bigint, last_batch bigint, chain_head string, batch_count bigint, event_count bigint, created_at_ns bigint"


def leaf_hash(uid: Column, raw_hash: Column) -> Column:
    """SHA-256 of 00, the uid, 1F and the hash's bytes."""
    return F.sha2(F.concat(F.unhex(F.lit("00")), uid.cast("binary"), F.unhex(F.lit("1f")), F.unhex(raw_hash)), 256)


def node_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)


def empty_root() -> Column:
    return F.sha2(F.lit(b""), 256)


def number(events: DataFrame, first: int = 0) -> DataFrame:
    """Adds `seq`: consecutive numbers in order of (received_at_ns, event_uid).

    The sorted ranges are written first: their sizes and their rows must come from one dealing.
    """
    order = ["received_at_ns", "event_uid"]
    ranged = written(events.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    at = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn("__at", at).join(F.broadcast(before.select("__part", "__before")), "__part").withColumn("seq", F.col("__before") + F.col("__at") + F.lit(first)).drop("__part", "__at", "__before")


def leaves(events: DataFrame, batch_size: int = BATCH_SIZE, first_batch: int = 1) -> DataFrame:
    """`batch_id`, `leaf_index`, `event_uid`, `raw_hash`, `leaf` of events in order."""
    at = number(events.select("event_uid", "raw_hash", "received_at_ns"))
    return at.select((F.floor(F.col("seq") / batch_size) + first_batch).alias("batch_id"), (F.col("seq") % batch_size).cast("int").alias("leaf_index"), "event_uid", "raw_hash", leaf_hash(F.col("event_uid"), F.col("raw_hash")).alias("leaf"))


def _up(level: Column) -> Column:
    """The level above an array of hashes; an odd last node is promoted."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: F.when(2 * i + 1 < F.size(level), node_hash(F.get(level, 2 * i), F.get(level, 2 * i + 1))).otherwise(F.get(level, 2 * i)))


def _fold(level: Column) -> Column:
    """The root over an array of hashes."""
    steps = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(F.greatest(F.size(level), F.lit(1)))).cast("int"), F.lit(1)))
    return F.get(F.aggregate(steps, level, lambda level, _: _up(level)), F.lit(0))


def merkle_roots(leaf_rows: DataFrame, span: int = SPAN) -> DataFrame:
    """`batch_id`, `root`, `leaf_count`. leaf_rows: batch_id, leaf_index (0, 1, ...), leaf.

    Subtrees of `span` (a power of two) leaves are folded in rows; their roots are the leaves of the tree above, which
    is folded alike, so a batch of span * span leaves takes two shuffles, and no row holds more than `span` hashes.
    """
    def folded(nodes: DataFrame, by: list[Column | str]) -> DataFrame:
        level = F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])
        return nodes.groupBy(*by).agg(level.alias("level"), F.sum("n").alias("n")).withColumn("h", _fold(F.col("level"))).drop("level")

    nodes = leaf_rows.select("batch_id", F.col("leaf_index").cast("bigint").alias("i"), F.col("leaf").alias("h"), F.lit(1).cast("bigint").alias("n"))
    nodes = folded(nodes, ["batch_id", F.floor(F.col("i") / span).alias("up")]).withColumnRenamed("up", "i")
    return folded(nodes, ["batch_id"]).select("batch_id", F.col("h").alias("root"), F.col("n").alias("leaf_count"))


def merkle_roots_of_arrays(leaf_rows: DataFrame) -> DataFrame:
    """As merkle_roots(), with a batch's leaves folded as one array: one shuffle, for batches that fit a row (BATCH_SIZE leaves do)."""
    rows = leaf_rows.groupBy("batch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("leaf_index", "leaf"))), lambda x: x["leaf"]).alias("level"), F.count("*").alias("leaf_count"))
    return rows.select("batch_id", _fold(F.col("level")).alias("root"), "leaf_count")


def nodes(leaf_rows: DataFrame) -> DataFrame:
    """The batches' Merkle trees: `batch_id`, `level` (0: leaves), `i`, `hash`. leaf_rows: batch_id, leaf_index, leaf; a batch is one array (BATCH_SIZE)."""
    rows = leaf_rows.groupBy("batch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("leaf_index", "leaf"))), lambda x: x["leaf"]).alias("level"))
    height = F.ceil(F.log2(F.size("level"))).cast("int")
    levels = F.aggregate(F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>")), F.array("level"), lambda made, _: F.concat(made, F.array(_up(F.element_at(made, -1)))))
    trees = rows.select("batch_id", F.posexplode(levels).alias("level", "hashes"))
    return trees.select("batch_id", "level", F.posexplode("hashes").alias("i", "hash")).withColumn("i", F.col("i").cast("bigint"))


def proofs(leaf_rows: DataFrame, events: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """Inclusion proofs of many events: `event_uid`, `batch_id`, `leaf_index`, `leaf`, `steps` (array of sibling, is_left), `root`.

    leaf_rows: batch_id, leaf_index, event_uid, leaf; events: event_uid. tree: the nodes() table, as a ledger keeps it. A proof is
    an equi-join with a row for each level of its tree; a node without sibling is promoted and has none.
    """
    tree = nodes(leaf_rows) if tree is None else tree
    wanted = leaf_rows.join(events.select("event_uid").distinct(), "event_uid", "left_semi").select("event_uid", "batch_id", "leaf_index", "leaf")
    tops = tree.groupBy("batch_id").agg(F.max_by("hash", "level").alias("root"), F.max("level").alias("height"))
    at = wanted.join(tops, "batch_id")
    below = at.filter("height > 0").select("event_uid", "batch_id", F.col("leaf_index").cast("bigint").alias("p"), F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("level"))
    place = F.expr("shiftright(p, level)")
    asked = below.select("event_uid", "batch_id", "level", place.bitwiseXOR(F.lit(1)).cast("bigint").alias("i"), (place % 2 == 1).alias("is_left"))
    found = asked.join(tree.select("batch_id", "level", "i", "hash"), ["batch_id", "level", "i"])
    steps = found.groupBy("event_uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", F.col("hash").alias("sibling"), "is_left"))), lambda x: F.struct(x["sibling"].alias("sibling"), x["is_left"].alias("is_left"))).alias("steps"))
    out = at.join(steps, "event_uid", "left")
    return out.select("event_uid", "batch_id", "leaf_index", "leaf", F.coalesce("steps", F.array().cast("array<struct<sibling:string,is_left:boolean>>")).alias("steps"), "root")


def _node(left: str, right: str) -> str:
    return hashlib.sha256(b"\x01" + bytes.fromhex(left) + bytes.fromhex(right)).hexdigest()


def proves(leaf: Column, steps: Column, root: Column) -> Column:
    """Whether steps (array of struct<sibling, is_left>) lead from a leaf to a root."""
    return F.aggregate(steps, leaf, lambda h, s: F.when(s["is_left"], node_hash(s["sibling"], h)).otherwise(node_hash(h, s["sibling"]))) == root


def chain(inner: DataFrame, head: str = GENESIS) -> DataFrame:
    """Chained roots of batches: root = node(previous root, inner root). inner: batch_id, root, leaf_count of one seal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = head
        for batch in batches:
            before, roots = [], []
            for own in batch.column(1).to_pylist():
                before.append(last)
                last = _node(last, own)
                roots.append(last)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before, pa.string()), batch.column(1), pa.array(roots, pa.string()), batch.column(2)], names=["batch_id", "prev_root", "inner", "root", "leaf_count"])

    ordered = inner.select(F.col("batch_id").cast("bigint").alias("batch_id"), "root", F.col("leaf_count").cast("bigint").alias("leaf_count")).repartition(1).sortWithinPartitions("batch_id")
    return ordered.mapInArrow(run, "batch_id bigint, prev_root string, inner string, root string, leaf_count bigint")


_SCHEMAS = {"batches": BATCHES, "leaves": LEAVES, "nodes": NODES, "steps": STEPS, "checkpoints": CHECKPOINTS}


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of a ledger (`batches`, `leaves`, `nodes`, `steps`, `checkpoints`); rows of steps that weren't finished are left out."""
    df = _stored(spark, f"{path}/{name}", _SCHEMAS[name])
    if name in ("steps", "checkpoints"):
        return df
    return df.join(_stored(spark, f"{path}/steps", STEPS).select("seal"), "seal", "left_semi").select(*df.columns)


def day_of(received_at_ns: Column) -> Column:
    return F.date_format(F.timestamp_millis(div(received_at_ns, 1_000_000)), "yyyy-MM-dd")


def sealed_on(spark: SparkSession, path: str, days: list[str]) -> DataFrame:
    """The leaves of events received on some days; only these days' files are read."""
    return read(spark, path, "leaves").filter(F.col("day").isin(days))


def state(spark: SparkSession, path: str) -> dict:
    """The last step: `step`, `seal`, `last_batch`, `head`, `n_open`, `open_since_ns`; of a new ledger, step 0."""
    last = read(spark, path, "steps").agg(F.max_by(F.struct("step", "seal", "last_batch", "head", "n_open", "open_since_ns"), "step").alias("s")).first()["s"]
    return last.asDict() if last else {"step": 0, "seal": None, "last_batch": 0, "head": GENESIS, "n_open": 0, "open_since_ns": None}


def open_events(spark: SparkSession, path: str) -> DataFrame:
    """Events that were added and fill no batch yet: `event_uid`, `raw_hash`, `received_at_ns`."""
    last = state(spark, path)
    return _stored(spark, f"{path}/open/{last['seal']}", OPEN) if last["n_open"] else spark.createDataFrame([], OPEN)


def seal(raw: DataFrame, path: str, mapping_set: dict[str, str], sealed_at_ns: int, batch_size: int = BATCH_SIZE, flush: bool = True, batch_ns: int = BATCH_NS) -> int:
    """Adds events to the ledger at `path` and seals full batches of `batch_size`, chained to the last one; returns the number of new batches.

    raw: the events to add (those of one ingest; those that are sealed or open already are left out, so a redelivery
    does no harm). What fills no batch waits with the open events, in order of receipt, until it does, until `flush`, or until the first of them
    was added `batch_ns` before `sealed_at_ns`. mapping_set: the content hashes by which records are derived, committed with each batch.
    """
    spark = raw.sparkSession
    last, name = state(spark, path), uuid.uuid4().hex
    once = raw.groupBy("event_uid").agg(F.min(F.struct("received_at_ns", "raw_hash")).alias("e")).select("event_uid", "e.raw_hash", "e.received_at_ns")
    given = written(once.withColumn("day", day_of(F.col("received_at_ns"))), "given")
    days = [r[0] for r in given.select("day").distinct().collect()]  # of one ingest
    waiting = open_events(spark, path)
    new = given.join(sealed_on(spark, path, days).select("event_uid"), "event_uid", "left_anti").join(waiting.select("event_uid"), "event_uid", "left_anti")
    pending = written(waiting.withColumn("new", F.lit(False)).unionByName(new.drop("day").withColumn("new", F.lit(True))), "pending")
    n = pending.count()
    since = last["open_since_ns"] if last["n_open"] else sealed_at_ns
    due = flush or (n > 0 and sealed_at_ns - since >= batch_ns)
    full = n if due else n - n % batch_size
    numbered = written(number(pending), "numbered") if n else pending.withColumn("seq", F.lit(0).cast("bigint"))
    rest, batches, head = numbered.filter(F.col("seq") >= full), -(-full // batch_size), last["head"]
    if batches:
        at = F.col("seq")
        own = numbered.filter(at < full).select((F.floor(at / batch_size) + last["last_batch"] + 1).alias("batch_id"), (at % batch_size).cast("int").alias("leaf_index"), "event_uid", "raw_hash", leaf_hash(F.col("event_uid"), F.col("raw_hash")).alias("leaf"), day_of(F.col("received_at_ns")).alias("day"))
        tree = written(nodes(own), "nodes")
        roots = tree.groupBy("batch_id").agg(F.max_by("hash", "level").alias("root"), F.count_if(F.col("level") == 0).alias("leaf_count"))
        ends = own.groupBy("batch_id").agg(F.min_by("event_uid", "leaf_index").alias("first_uid"), F.max_by("event_uid", "leaf_index").alias("last_uid"))
        own.select("batch_id", "leaf_index", "event_uid", "raw_hash", F.lit(name).alias("seal"), "day").repartition("day", "batch_id").write.mode("append").partitionBy("day").parquet(f"{path}/leaves")
        tree.withColumn("seal", F.lit(name)).write.mode("append").parquet(f"{path}/nodes")
        about = [F.lit(sealed_at_ns).cast("bigint").alias("sealed_at_ns"), F.lit(json.dumps(mapping_set, sort_keys=True)).alias("mapping_set"), F.lit(name).alias("seal")]
        out = written(chain(roots, head).join(ends, "batch_id").select("batch_id", "prev_root", "root", "leaf_count", "first_uid", "last_uid", *about), "batches")
        out.write.mode("append").parquet(f"{path}/batches")
        head = out.agg(F.max_by("root", "batch_id")).first()[0]
        released(tree, out)
    rest.select("event_uid", "raw_hash", "received_at_ns").write.parquet(f"{path}/open/{name}")
    # what waits now waits since it was added: since an earlier step, if one that had waited still does
    kept = n > full and last["n_open"] > 0 and not rest.filter("NOT new").isEmpty()
    row = (last["step"] + 1, name, batches, last["last_batch"] + batches, head, n - full, (since if kept else sealed_at_ns) if n > full else None)
    spark.createDataFrame([row], STEPS).coalesce(1).write.mode("append").parquet(f"{path}/steps")  # in one file: the step counts, or doesn't
    released(given, pending, *([numbered] if n else []))
    return batches


def tick(spark: SparkSession, path: str, mapping_set: dict[str, str], now_ns: int, batch_size: int = BATCH_SIZE, batch_ns: int = BATCH_NS) -> int:
    """Seals what is open if the first of it was added `batch_ns` ago or more; returns the number of new batches."""
    last = state(spark, path)
    if not last["n_open"] or now_ns - last["open_since_ns"] < batch_ns:
        return 0
    return seal(spark.createDataFrame([], OPEN), path, mapping_set, now_ns, batch_size)


def checkpoint(spark: SparkSession, path: str, day: str, created_at_ns: int) -> None:
    """Writes down the state of all batches so far; an empty ledger has nothing to write down."""
    state = totals(read(spark, path, "batches"))
    if state.first()["batch_count"] == 0:
        raise ValueError("the ledger is empty")
    known = read(spark, path, "checkpoints").agg((F.coalesce(F.max("checkpoint_id"), F.lit(0)) + 1).alias("checkpoint_id"))
    row = state.join(F.broadcast(known), F.lit(True)).select("checkpoint_id", F.lit(day).alias("day"), "first_batch", "last_batch", "chain_head", "batch_count", "event_count", F.lit(created_at_ns).cast("bigint").alias("created_at_ns"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/checkpoints")


def locate(leaf_rows: DataFrame, events: DataFrame) -> DataFrame:
    """`event_uid`, `batch_id`, `leaf_index` of events; null for those in no batch."""
    return events.select("event_uid").join(leaf_rows.select("event_uid", "batch_id", "leaf_index"), "event_uid", "left")


def batch_of(batches: DataFrame, batch_id: int) -> DataFrame:
    return batches.filter(F.col("batch_id") == batch_id)


def leaves_of(leaf_rows: DataFrame, batch_id: int) -> DataFrame:
    return leaf_rows.filter(F.col("batch_id") == batch_id).orderBy("leaf_index").select("leaf_index", "event_uid", "raw_hash")


def verify(batches: DataFrame, leaf_rows: DataFrame, raw: DataFrame | None = None, head: str = GENESIS, start: int = 1, end: int | None = None) -> DataFrame:
    """Every batch of a range with the first reason against it, or null: broken_link, leaf_count, missing_event, altered_event, root.

    batches: batch_id, prev_root, root, leaf_count. With `raw` (event_uid, raw_bytes) the leaves are hashed anew from the raw
    bytes; without, from their recorded hashes. The link of the first batch of a range that starts later isn't checked.
    """
    within = F.col("batch_id") >= start if end is None else F.col("batch_id").between(start, end)
    batches, leaf_rows = batches.filter(within), leaf_rows.filter(within).select("batch_id", "leaf_index", "event_uid", "raw_hash")
    before = batches.select((F.col("batch_id") + 1).alias("batch_id"), F.col("root").alias("expected"))
    links = batches.join(before, "batch_id", "left").withColumn("expected", F.when(F.col("batch_id") == 1, head).when(F.col("batch_id") == start, F.col("prev_root")).otherwise(F.coalesce("expected", F.lit(""))))
    if raw is None:
        again = leaf_rows.withColumns({"now": F.col("raw_hash"), "found": F.lit(True)})
    else:
        again = leaf_rows.join(raw.select("event_uid", F.sha2("raw_bytes", 256).alias("now"), F.lit(True).alias("found")), "event_uid", "left")
    state = again.groupBy("batch_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("found").isNull()).alias("missing"), F.count_if(F.col("now") != F.col("raw_hash")).alias("altered"),
        F.transform(F.array_sort(F.collect_list(F.struct("leaf_index", leaf_hash(F.col("event_uid"), F.coalesce("now", "raw_hash")).alias("leaf")))), lambda x: x["leaf"]).alias("level"),
    ).withColumn("now_root", _fold(F.col("level"))).drop("level")
    df = links.join(state, "batch_id", "left")
    reason = (
        F.when(F.col("prev_root") != F.col("expected"), "broken_link").when(F.coalesce("n", F.lit(0)) != F.col("leaf_count"), "leaf_count").when(F.col("missing") > 0, "missing_event")
        .when(F.col("altered") > 0, "altered_event").when(node_hash(F.col("prev_root"), F.coalesce("now_root", empty_root())) != F.col("root"), "root")
    )
    return df.select("batch_id", "root", "leaf_count", reason.alias("reason"))


def running(batches: DataFrame) -> DataFrame:
    """`batch_id`, `root`, and over all batches so far `b` (their number) and `e` (their events).

    Sorted ranges are written and summed, as number() does, so no task holds more than a range.
    """
    ranged = written(batches.select("batch_id", "root", "leaf_count").repartitionByRange("batch_id").withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("b"), F.sum("leaf_count").alias("e"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = sizes.select("__part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__{c}") for c in ("b", "e")))
    own = Window.partitionBy("__part").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.withColumns({"b": F.count("*").over(own), "e": F.sum("leaf_count").over(own)})
    return sums.join(F.broadcast(before), "__part").select("batch_id", "root", (F.col("b") + F.col("__b")).alias("b"), (F.col("e") + F.col("__e")).alias("e"))


def verify_checkpoints(checkpoints: DataFrame, batches: DataFrame) -> DataFrame:
    """Checkpoints with the first reason against them, or null: chain_head, event_count, batch_count.

    The state at a batch is a running sum, so a checkpoint is joined with its last batch and with the one before its first by their ids.
    """
    sums = written(running(batches), "running")
    last = sums.select(F.col("batch_id").alias("last_batch"), F.col("root").alias("r"), F.col("b").alias("b2"), F.col("e").alias("e2"))
    before = sums.select((F.col("batch_id") + 1).alias("first_batch"), F.col("b").alias("b1"), F.col("e").alias("e1"))
    now = checkpoints.join(last, "last_batch", "left").join(before, "first_batch", "left")
    count = lambda c: F.coalesce(f"{c}2", F.lit(0)) - F.coalesce(f"{c}1", F.lit(0))
    reason = F.when(~F.col("chain_head").eqNullSafe(F.col("r")), "chain_head").when(F.col("event_count") != count("e"), "event_count").when(F.col("batch_count") != count("b"), "batch_count")
    return now.select("checkpoint_id", "day", "last_batch", reason.alias("reason"))


def first_divergence(verified: DataFrame) -> DataFrame:
    """One row: `ok`, `batches_checked` and `events_checked` before the first batch that fails, its id and reason."""
    bad = verified.agg(F.min(F.when(F.col("reason").isNotNull(), F.struct("batch_id", "reason"))).alias("bad"))
    good = F.col("bad").isNull() | (F.col("batch_id") < F.col("bad.batch_id"))
    counted = verified.join(F.broadcast(bad), F.lit(True)).agg(F.count_if(good).alias("batches_checked"), F.coalesce(F.sum(F.when(good, F.col("leaf_count"))), F.lit(0)).alias("events_checked"), F.any_value("bad").alias("bad"))
    return counted.select(F.col("bad").isNull().alias("ok"), "batches_checked", "events_checked", F.col("bad.batch_id").alias("first_divergence"), F.col("bad.reason").alias("reason"))


def totals(batches: DataFrame) -> DataFrame:
    return batches.agg(F.count("*").alias("batch_count"), F.coalesce(F.sum("leaf_count"), F.lit(0)).alias("event_count"), F.min("batch_id").alias("first_batch"), F.max("batch_id").alias("last_batch"), F.max_by("root", "batch_id").alias("chain_head"))
