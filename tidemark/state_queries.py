"""Registered queries of what keeps state: ledgers that are sealed step by step, proofs, streams between triggers; with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lineage import new_path, written
from tidemark.operators import ledger, skipping, store
from tidemark.plans import mapping
from tidemark.plans.mapping import Mapping, Registry
from tidemark.queries import EVENT_MAPPING, event_lines, event_records, line, ms, query, table
from tidemark.sources import tail
from tidemark.streaming import ingest, state

SIZE = 700

# -- ledgers -----------------------------------------------------------------------------------------------------------


def plain_raw(spark, sf_dir) -> DataFrame:
    """The events as raw events whose uids SQL can name."""
    e = table(spark, sf_dir, "events")
    raw = line(F.col("event_id"), ",", F.col("event_type")).cast("binary")
    return e.select("event_id", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_uid"), raw.alias("raw_bytes"), F.sha2(raw, 256).alias("raw_hash"), (ms("ts") * 1_000_000).alias("received_at_ns"))


#: From `leaf` (batch_id, i, uid, hash, sealed_at_ns): nodes `t` up to level 10, and the chain `c` (batch_id, prev_root, root).
_TREE = """
l0 AS (SELECT batch_id, i, sha256(unhex('00') || encode(uid) || unhex('1F') || unhex(hash)) AS h FROM leaf), t AS (
  SELECT 0 AS lvl, batch_id, i, h FROM l0
  UNION ALL
  SELECT lvl + 1, batch_id, i // 2, CASE WHEN count(*) = 2 THEN sha256(unhex('01') || unhex(max(h) FILTER (i % 2 = 0)) || unhex(max(h) FILTER (i % 2 = 1))) ELSE max(h) END FROM t WHERE lvl < 10 GROUP BY lvl, batch_id, i // 2
), r AS (SELECT batch_id, h FROM t WHERE lvl = 10), c AS (
  SELECT CAST(0 AS BIGINT) AS batch_id, '' AS prev_root, repeat('0', 64) AS root
  UNION ALL
  SELECT r.batch_id, c.root, sha256(unhex('01') || unhex(c.root) || unhex(r.h)) FROM c JOIN r ON r.batch_id = c.batch_id + 1
)"""
_EVENTS = "e AS (SELECT event_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS uid, sha256(concat(event_id, ',', event_type)) AS hash, epoch_us(ts) // 1000 AS at_ms FROM events)"
#: Three ingests, each sealed whole in batches of SIZE.
_THREE = f"""{_EVENTS}, s AS (SELECT *, event_id % 3 AS step, row_number() OVER (PARTITION BY event_id % 3 ORDER BY at_ms, uid) - 1 AS n FROM e
), f AS (SELECT step, coalesce(sum(b) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM (SELECT step, (count(*) + {SIZE - 1}) // {SIZE} AS b FROM s GROUP BY step)
), leaf AS (SELECT CAST(first + n // {SIZE} + 1 AS BIGINT) AS batch_id, n % {SIZE} AS i, uid, hash, step AS sealed_at_ns FROM s JOIN f USING (step))"""


def three_ingests(spark, sf_dir):
    """A ledger that three ingests were sealed in; each redelivers what came before."""
    raw, path = written(plain_raw(spark, sf_dir)), new_path(spark, "ledger")
    for i in range(3):
        ledger.seal(raw.filter(F.col("event_id") % 3 <= i), path, {"app_events": "0" * 8}, i, SIZE)
        ledger.checkpoint(spark, path, f"2024-01-0{i + 1}", i)
    return raw, path


@query(f"""WITH RECURSIVE {_THREE}, {_TREE}
  SELECT leaf.batch_id, count(*) AS leaf_count, min(uid) FILTER (i = 0) AS first_uid, max_by(uid, i) AS last_uid, any_value(c.prev_root) AS prev_root, any_value(c.root) AS root, any_value(sealed_at_ns) AS sealed_at_ns, '{{"app_events": "00000000"}}' AS mapping_set, CAST(NULL AS VARCHAR) AS reason, count(*) AS located
  FROM leaf JOIN c ON c.batch_id = leaf.batch_id GROUP BY leaf.batch_id""")
def seal_batches(spark, sf_dir):
    """Everything is sealed once, though ingests overlap; every batch verifies from the raw bytes, and its events are found in it."""
    raw, path = three_ingests(spark, sf_dir)
    batches, leaf = ledger.read(spark, path, "batches"), ledger.read(spark, path, "leaves")
    reasons = ledger.verify(batches, leaf, raw).select("batch_id", "reason")
    found = ledger.locate(leaf, raw).groupBy("batch_id").agg(F.count("*").alias("located"))
    return batches.drop("seal").join(reasons, "batch_id").join(found, "batch_id")


@query(f"""WITH RECURSIVE {_THREE}, {_TREE}, b AS (SELECT batch_id, any_value(sealed_at_ns) AS step, count(*) AS n FROM leaf GROUP BY 1
), k AS (SELECT s.step, max(batch_id) AS last_batch, sum(n) AS events FROM range(3) s(step) JOIN b ON b.step <= s.step GROUP BY 1)
  SELECT step + 1 AS checkpoint_id, concat('2024-01-0', step + 1) AS day, 1 AS first_batch, last_batch, last_batch AS batch_count, CAST(events + CASE WHEN step = 1 THEN 1 ELSE 0 END AS BIGINT) AS event_count, CASE WHEN step = 2 THEN repeat('0', 64) ELSE c.root END AS chain_head, CASE step WHEN 1 THEN 'event_count' WHEN 2 THEN 'chain_head' END AS reason
  FROM k JOIN c ON c.batch_id = k.last_batch UNION ALL
  SELECT 4, '2024-01-04', 1, last_batch, last_batch + 1, CAST(events AS BIGINT), c.root, 'batch_count' FROM k JOIN c ON c.batch_id = k.last_batch WHERE step = 2""")
def checkpoint_totals(spark, sf_dir):
    """Checkpoints with what is against them; all but the first were altered."""
    _, path = three_ingests(spark, sf_dir)
    batches, at = ledger.read(spark, path, "batches"), F.col("checkpoint_id")
    points = ledger.read(spark, path, "checkpoints").drop("created_at_ns")
    more = points.filter(at == 3).withColumns({"checkpoint_id": F.lit(4).cast("bigint"), "day": F.lit("2024-01-04"), "batch_count": F.col("batch_count") + 1})
    forged = points.withColumns({"event_count": F.col("event_count") + F.when(at == 2, 1).otherwise(0), "chain_head": F.when(at == 3, ledger.GENESIS).otherwise(F.col("chain_head"))}).unionByName(more)
    return forged.join(ledger.verify_checkpoints(forged, batches).select("checkpoint_id", "reason"), "checkpoint_id")


@query(f"""WITH RECURSIVE {_EVENTS}, k0 AS (SELECT *, row_number() OVER (ORDER BY at_ms, uid) - 1 AS n, count(*) OVER () AS total FROM e WHERE event_id % 3 = 0
), p1 AS (SELECT event_id, uid, hash, at_ms FROM k0 WHERE n >= total - total % {SIZE} UNION ALL SELECT event_id, uid, hash, at_ms FROM e WHERE event_id % 3 = 1
), k1 AS (SELECT *, row_number() OVER (ORDER BY at_ms, uid) - 1 AS n, count(*) OVER () AS total FROM p1
), k2 AS (SELECT *, row_number() OVER (ORDER BY at_ms, uid) - 1 AS n FROM e WHERE event_id % 3 = 2
), a AS (SELECT (SELECT max(total) // {SIZE} FROM k0) AS b0, (SELECT (max(total) + {SIZE - 1}) // {SIZE} FROM k1) AS b1
), leaf AS (
  SELECT n // {SIZE} + 1 AS batch_id, n % {SIZE} AS i, uid, hash, 0 AS sealed_at_ns FROM k0 WHERE n < total - total % {SIZE}
  UNION ALL SELECT b0 + n // {SIZE} + 1, n % {SIZE}, uid, hash, CASE WHEN n < total - total % {SIZE} THEN 5 ELSE 20 END FROM k1, a
  UNION ALL SELECT b0 + b1 + n // {SIZE} + 1, n % {SIZE}, uid, hash, 30 FROM k2, a
), {_TREE}
  SELECT leaf.batch_id, count(*) AS leaf_count, min(uid) FILTER (i = 0) AS first_uid, max_by(uid, i) AS last_uid, any_value(c.prev_root) AS prev_root, any_value(c.root) AS root, any_value(sealed_at_ns) AS sealed_at_ns
  FROM leaf JOIN c ON c.batch_id = leaf.batch_id GROUP BY leaf.batch_id""")
def seal_open_batch(spark, sf_dir):
    """Size, time and flush: two ingests seal full batches and leave an open one, a tick comes too early and another seals it, a last ingest is flushed."""
    raw, path, part = written(plain_raw(spark, sf_dir)), new_path(spark, "ledger"), F.col("event_id") % 3
    ledger.seal(raw.filter(part == 0), path, {}, 0, SIZE, flush=False, batch_ns=10)
    ledger.seal(raw.filter((part == 1) | ((part == 0) & (F.col("event_id") % 2 == 0))), path, {}, 5, SIZE, flush=False, batch_ns=10)
    ledger.tick(spark, path, {}, 9, SIZE, 10)
    ledger.tick(spark, path, {}, 20, SIZE, 10)
    ledger.seal(raw.filter(part == 2), path, {}, 30, SIZE)
    return ledger.read(spark, path, "batches").drop("mapping_set", "seal")


@query(f"WITH RECURSIVE {_THREE} SELECT leaf.batch_id, i AS leaf_index, uid AS event_uid, hash AS raw_hash, b.leaf_count FROM leaf JOIN (SELECT batch_id, count(*) AS leaf_count FROM leaf GROUP BY 1) b ON b.batch_id = leaf.batch_id WHERE leaf.batch_id = 1")
def batch_and_leaves(spark, sf_dir):
    """A batch of the ledger with its leaves in order."""
    _, path = three_ingests(spark, sf_dir)
    leaf = ledger.leaves_of(ledger.read(spark, path, "leaves"), 1)
    return ledger.batch_of(ledger.read(spark, path, "batches"), 1).select("batch_id", "leaf_count").join(leaf, F.lit(True))


@query(f"""WITH RECURSIVE leaf AS (SELECT event_id // 1000 + 1 AS batch_id, event_id % 1000 AS i, CAST(event_id AS VARCHAR) AS uid, sha256(event_type) AS hash FROM events), {_TREE}
  , w AS (SELECT *, unnest(range(0, 10)) AS lvl FROM leaf WHERE CAST(uid AS BIGINT) % 10 = 3)
  SELECT w.uid AS event_uid, w.batch_id - 1 AS batch_id, string_agg(concat(CASE WHEN (w.i >> t.lvl) % 2 = 1 THEN 'L' ELSE 'R' END, t.h), ',' ORDER BY t.lvl) AS siblings, any_value(r.h) AS root, true AS proves
  FROM w JOIN t ON t.batch_id = w.batch_id AND t.lvl = w.lvl AND t.i = xor(w.i >> w.lvl, 1) JOIN r ON r.batch_id = w.batch_id GROUP BY ALL""")
def inclusion_proofs(spark, sf_dir):
    """Proofs of every tenth event with their siblings; they lead to the root, and those of another leaf don't."""
    e = table(spark, sf_dir, "events")
    uid = F.col("event_id").cast("string")
    leaf = e.select(F.expr("event_id DIV 1000").alias("batch_id"), (F.col("event_id") % 1000).cast("int").alias("leaf_index"), uid.alias("event_uid"), ledger.leaf_hash(uid, F.sha2("event_type", 256)).alias("leaf"))
    made = ledger.proofs(leaf, e.filter("event_id % 10 = 3").select(uid.alias("event_uid")), written(ledger.nodes(leaf), "nodes"))
    holds = ledger.proves(F.col("leaf"), F.col("steps"), F.col("root")) & ~ledger.proves(F.sha2("leaf", 256), F.col("steps"), F.col("root"))
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(F.when(s["is_left"], "L").otherwise("R"), s["sibling"])), ",")
    return made.select("event_uid", "batch_id", siblings.alias("siblings"), "root", holds.alias("proves"))


# -- tables ------------------------------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT event_id, event_type, epoch_us(ts) // 1000 AS at_ms, user_id % 3 AS u FROM events)
  SELECT event_type AS source_id, strftime(make_timestamp(at_ms * 1000), '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (u = 0 AND event_type <> 'view') AS resolved, count(*) FILTER (u <> 0 OR event_type = 'view') AS pending, 5 AS first_seen_ns FROM x GROUP BY 1, 2""")
def upsert_partitions(spark, sf_dir):
    """Two waves into a projection by source and day: the second resolves a third of the events of all sources but one, whose partitions it leaves."""
    e, path = table(spark, sf_dir, "events"), new_path(spark, "projection")
    records = event_records(spark, sf_dir).select(*(c for c in event_records(spark, sf_dir).columns if c not in ("event_uid", "source_id", "parse_status"))).limit(0)
    plain = e.select(F.col("event_id").cast("string").alias("event_uid"), F.col("event_type").alias("source_id"), ms("ts").alias("observed_time"), F.col("user_id") % 3 == 0)
    plain = plain.toDF("event_uid", "source_id", "observed_time", "again")
    every = {f.name: F.lit(None).cast(f.dataType) for f in records.schema.fields if f.name != "observed_time"}
    wave = lambda df, status: df.drop("again").withColumns({**every, "parse_status": F.lit(status)})
    store.upsert_table(wave(plain, "quarantined"), path, 5)
    store.upsert_table(wave(plain.filter("again AND source_id <> 'view'"), "full"), path, 9)
    return spark.read.parquet(path).groupBy("source_id", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("resolved_at_ns") == 9).alias("resolved"), F.count_if(F.col("parse_status") == "quarantined").alias("pending"), F.min("first_seen_ns").alias("first_seen_ns"))


@query("SELECT doc_id, lang FROM documents WHERE text ILIKE '%License%'")
def search_skipping(spark, sf_dir):
    """A search over a table of many files that reads those whose trigrams allow a match."""
    path = new_path(spark, "texts")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("summary"), F.col("lang").alias("source_id"))
    d.repartitionByRange(16, "doc_id").write.parquet(path)
    index = written(skipping.index(spark.read.parquet(path), ("summary", "source_id")), "index")
    return skipping.search(spark, path, index, "License").select("doc_id", "lang")


# -- mappings ----------------------------------------------------------------------------------------------------------


@query("""SELECT event_type AS source_id, count(*) AS n, CAST(count(*) FILTER (event_id % 4 = 0) AS BIGINT) AS blank, sum(length(concat('id=', event_id, ' user=', user_id))) FILTER (event_id % 4 <> 0) AS bytes,
  min(sha256(concat('id=', event_id, ' user=', user_id))) FILTER (event_id % 4 <> 0) AS least_sha256 FROM events GROUP BY 1""")
def line_scan(spark, sf_dir):
    """Log files written by the events' types, scanned as bytes; blank lines are left out."""
    e, folder = table(spark, sf_dir, "events"), new_path(spark, "lines")
    text = F.when(F.col("event_id") % 4 == 0, " \t ").otherwise(line("id=", F.col("event_id"), " user=", F.col("user_id")))
    e.select("event_type", text.alias("value")).write.partitionBy("event_type").text(folder)
    found = ingest.scan_lines(spark, folder).groupBy(F.regexp_extract("path", "event_type=([^/]+)/", 1).alias("source_id"))
    every = e.groupBy(F.col("event_type").alias("source_id")).agg(F.count("*").alias("n"))
    kept = found.agg(F.count("*").alias("kept"), F.sum(F.octet_length("raw_bytes")).alias("bytes"), F.min(F.sha2("raw_bytes", 256)).alias("least_sha256"))
    return every.join(kept, "source_id").select("source_id", "n", (F.col("n") - F.col("kept")).alias("blank"), "bytes", "least_sha256")


@query("""SELECT 'app_events' AS source_id, p AS place, [2004, 4001, 4002][p] AS class_uid, (SELECT count(*) FROM events WHERE CASE p WHEN 1 THEN event_type IN ('purchase', 'refund') WHEN 2 THEN event_type = 'view' ELSE event_type LIKE 'cl%' END) AS n FROM range(1, 4) t(p)""")
def mapping_classes(spark, sf_dir):
    """The classes of each known source in the order of its rules, with the records of each."""
    registry = Registry()
    registry.add(Mapping.from_yaml(EVENT_MAPPING))
    rows = [(s, i + 1, c) for s in registry.sources() for i, c in enumerate(registry.get(s).classes())]
    known = spark.createDataFrame(rows, "source_id string, place bigint, class_uid int")
    n = event_records(spark, sf_dir).groupBy("source_id", "class_uid").agg(F.count("*").alias("n"))
    return known.join(n, ["source_id", "class_uid"], "left").select("source_id", "place", "class_uid", F.coalesce("n", F.lit(0)).alias("n"))


#: A mapping and what is wrong with it, by a number.
_DEFECTS = (("version: 1", "version: 0"), ("time:", "tme:"), ("ocsf_class: 4001", "ocsf_class: 9"), ("equals:", "resembles:"), ("name: b", "name: a"), ("'(x)'", "'(x'"))


@query(f"WITH x AS (SELECT event_type, user_id % 8 AS d FROM events) SELECT concat('s', d, '_', event_type) AS source_id, d >= {len(_DEFECTS)} AS loads, count(*) AS n FROM x GROUP BY ALL")
def mapping_checks(spark, sf_dir):
    """Mappings rendered from the events' types and users, most with a defect, checked as a table of texts."""
    text = "source: {0}\nformat: kv\nversion: 1\nrules:\n  - {name: a, match: {field: $type, equals: x}, ocsf_class: 4001, fields: {time: $at}}\n  - {name: b, ocsf_class: 4001, fields: {time: {from: $at, regex: '(x)', group: 1}}}\n"
    d = F.col("d")
    yaml = F.lit(text)
    for i, (right, wrong) in enumerate(_DEFECTS):
        yaml = F.when(d == i, F.replace(F.lit(text), F.lit(right), F.lit(wrong))).otherwise(yaml)
    e = table(spark, sf_dir, "events").withColumn("d", F.col("user_id") % 8).withColumn("source_id", F.concat(F.lit("s"), d.cast("string"), F.lit("_"), F.col("event_type")))
    texts = e.groupBy("source_id", F.replace(yaml, F.lit("{0}"), F.col("source_id")).alias("yaml")).agg(F.count("*").alias("n"))
    return mapping.checked(texts, "yaml").select("source_id", F.col("error").isNull().alias("loads"), "n")


# -- streams -----------------------------------------------------------------------------------------------------------


def polled(spark, parts: list[DataFrame], start, name: str) -> None:
    """One trigger after each part that is added to a folder of Parquet files. start: makes and starts the query, from the stream and a checkpoint folder."""
    folder, checkpoint = new_path(spark, name), new_path(spark, f"{name}-state")
    with state.rocksdb(spark):
        for part in parts:
            part.write.mode("append").parquet(folder)
            start(spark.readStream.schema(part.schema).parquet(folder), checkpoint).awaitTermination()


def to_files(out: str, checkpoint: str, df: DataFrame):
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


@query("""WITH n AS (SELECT count(*) FILTER (event_id % 2 = 0) AS even, count(*) FILTER (event_id % 4 = 0) AS four, count(*) FILTER (event_id % 8 = 1) AS one, count(*) FILTER (event_id % 8 = 3) AS three, count(*) FILTER (event_id % 8 = 5) AS five FROM events)
  SELECT 0 AS poll, even AS submitted, even AS passed, even AS accepted FROM n UNION ALL SELECT 1, one + four, one, one FROM n UNION ALL SELECT 2, three, three, three FROM n UNION ALL SELECT 3, five, five, five FROM n UNION ALL SELECT 4, four + five, four, 0 FROM n""")
def dedup_stream(spark, sf_dir):
    """Redeliveries within the watermark are dropped by the stream, those outside it by the table; what each poll submitted, passed on and stored."""
    e, minute, out = table(spark, sf_dir, "events"), 60_000, new_path(spark, "raw")
    raw = plain_raw(spark, sf_dir).withColumns({"source_id": F.lit("app"), "idem_key": F.col("event_uid")})
    at = lambda test, minutes: raw.filter(test).withColumn("arrived_ms", F.lit(10**12 + minutes * minute))
    parts = [at("event_id % 2 = 0", 0), at("event_id % 8 = 1 OR event_id % 4 = 0", 10), at("event_id % 8 = 3", 100), at("event_id % 8 = 5", 110), at("event_id % 4 = 0 OR event_id % 8 = 5", 120)]
    counts: list[dict[str, int]] = []

    def start(stream, checkpoint):
        counts.append({"accepted": 0, "duplicates": 0})

        def add(number, found):
            for k, v in found.items():
                counts[-1][k] += v

        return state.append_stream(state.once_within(stream, delay="30 minutes"), out, checkpoint, add)

    polled(spark, parts, start, "dedup")
    passed = spark.createDataFrame([(i, c["accepted"] + c["duplicates"], c["accepted"]) for i, c in enumerate(counts)], "poll bigint, passed bigint, accepted bigint")
    tests = [F.expr(x) for x in ("event_id % 2 = 0", "event_id % 8 = 1 OR event_id % 4 = 0", "event_id % 8 = 3", "event_id % 8 = 5", "event_id % 4 = 0 OR event_id % 8 = 5")]
    submitted = e.select(F.posexplode(F.array(*(t.cast("int") for t in tests)))).groupBy(F.col("pos").cast("bigint").alias("poll")).agg(F.sum("col").alias("submitted"))
    return submitted.join(passed, "poll")


@query("""WITH m AS (SELECT max(event_id) AS top FROM events), x AS (SELECT event_type, event_id, top FROM events, m)
  SELECT event_type AS channel, count(*) AS n, count(*) AS distinct_ids, max(event_id) AS mark, sum(event_id) AS total FROM x GROUP BY 1""")
def marks_stream(spark, sf_dir):
    """Two polls, the second of which repeats half of the first: every record of a channel once, up to its mark."""
    e, out = table(spark, sf_dir, "events"), new_path(spark, "marks")
    records = e.select(F.col("event_type").alias("channel"), F.col("event_id").alias("record_id"))
    top = e.agg(F.max("event_id").alias("top"))
    at = records.join(F.broadcast(top), F.lit(True))
    parts = [at.filter("2 * record_id <= top").drop("top"), at.filter("4 * record_id > top").drop("top")]
    polled(spark, parts, lambda stream, checkpoint: to_files(out, checkpoint, state.marks(stream)), "marks")
    new = spark.read.parquet(out)
    return new.groupBy("channel").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("distinct_ids"), F.max("record_id").alias("mark"), F.sum("record_id").alias("total"))


@query("""WITH x AS (SELECT *, epoch_us(ts) // 1000 AS at_ms, user_id % 2 = 1 AND epoch_us(ts) // 1000 >= 1705708800000 AS late FROM events), w AS (SELECT max(at_ms) FILTER (NOT late) - 90000000 AS mark FROM x)
  SELECT at_ms // 3600000 * 3600000 AS start_ms, event_type AS source_id, count(*) AS n FROM x, w WHERE NOT late OR (at_ms // 3600000 + 1) * 3600000 > mark GROUP BY 1, 2""")
def timeline_stream(spark, sf_dir):
    """Hourly counts over two triggers; half of the last days' events come late, and count if their hour is not over by 25 hours."""
    e, out = table(spark, sf_dir, "events").select(F.col("event_type").alias("source_id"), "user_id", ms("ts").alias("observed_time")), new_path(spark, "timeline")
    late = (F.col("user_id") % 2 == 1) & (F.col("observed_time") >= 1705708800000)
    polled(spark, [e.filter(~late).drop("user_id"), e.filter(late).drop("user_id")], lambda stream, checkpoint: state.write_timeline(state.timeline(stream), out, checkpoint), "timeline")
    return state.read_timeline(spark, out)


@query("""
WITH RECURSIVE o AS (
  SELECT user_id, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events
), t AS (
  SELECT user_id, at_ms, n, at_ms AS last, true AS hit FROM o WHERE n = 1
  UNION ALL
  SELECT o.user_id, o.at_ms, o.n, CASE WHEN o.at_ms - t.last >= 7200000 THEN o.at_ms ELSE t.last END, o.at_ms - t.last >= 7200000 FROM t JOIN o ON o.user_id = t.user_id AND o.n = t.n + 1
)
SELECT user_id, count(*) AS n, sum(at_ms) AS total FROM t WHERE hit GROUP BY 1
""")
def reobserve_stream(spark, sf_dir):
    """Sightings in two triggers, the earlier half of the time first; a user's last report is kept between them until it can't matter any more."""
    e, out = table(spark, sf_dir, "events").select("user_id", ms("ts").alias("at_ms")), new_path(spark, "reobserve")
    half = F.lit(1705276800000)
    polled(spark, [e.filter(F.col("at_ms") < half), e.filter(F.col("at_ms") >= half)], lambda stream, checkpoint: to_files(out, checkpoint, state.reobserved(stream, ["user_id"], 7_200_000)), "reobserve")
    return spark.read.parquet(out).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("at_ms").alias("total"))


@query("""SELECT event_type AS source_id, count(*) FILTER (event_id % 5 <> 0) AS n, sum(length(concat('id=', event_id))) FILTER (event_id % 5 <> 0) AS bytes, min(sha256(concat('id=', event_id))) FILTER (event_id % 5 <> 0) AS least_sha256 FROM events GROUP BY 1""")
def tail_stream(spark, sf_dir):
    """Log files by the events' types are followed over two triggers with a byte limit; each line comes once, comments don't come."""
    e, folder, out, checkpoint = table(spark, sf_dir, "events"), new_path(spark, "logs"), new_path(spark, "tailed"), new_path(spark, "tail-state")
    lines = e.select("event_id", "event_type", F.when(F.col("event_id") % 5 == 0, "# comment").otherwise(line("id=", F.col("event_id"))).alias("value"))
    kinds = [r[0] for r in e.select("event_type").distinct().collect()]  # a folder each
    specs = json.dumps([[f"event_type={k}/part-*.txt", k, "#"] for k in kinds])
    spark.dataSource.register(tail.TailSource)
    for part in (0, 1):
        lines.filter(F.col("event_id") % 2 == part).drop("event_id").write.mode("append").partitionBy("event_type").text(folder)
        stream = spark.readStream.format("tail").options(path=folder.removeprefix("file://").removeprefix("file:"), specs=specs, maxBytesPerTrigger=1 << 26).load()
        to_files(out, checkpoint, stream).awaitTermination()
    found = spark.read.schema(tail.SCHEMA).parquet(out)
    return found.groupBy("source_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("raw_bytes")).alias("bytes"), F.min(F.sha2("raw_bytes", 256)).alias("least_sha256"))


@query("""SELECT p AS poll, CASE WHEN event_type = 'view' THEN 4001 WHEN event_type IN ('purchase', 'refund') THEN 2004 WHEN event_type LIKE 'cl%' THEN 4002 END AS class_uid, CASE WHEN event_type IN ('view', 'purchase', 'refund') OR event_type LIKE 'cl%' THEN [3, 4, 4][p + 1] END AS version, count(*) AS n
  FROM events, range(3) t(p) WHERE event_id % 3 = p GROUP BY ALL""")
def hot_reload(spark, sf_dir):
    """Three polls; the mapping is edited before the second, and broken before the third, which goes on with the second's."""
    import tempfile
    from pathlib import Path

    lines = event_lines(spark, sf_dir).select("event_id", "raw_bytes")
    folder, out, raw, checkpoint = new_path(spark, "reload"), new_path(spark, "records"), new_path(spark, "raw"), new_path(spark, "reload-state")
    file = Path(tempfile.mkdtemp(prefix="mappings-"), "app_events.yaml")  # the driver's own file
    registry = Registry(file.parent)
    edits = (EVENT_MAPPING, EVENT_MAPPING.replace("version: 3", "version: 4 "), "source: app_events\nrules: nonsense at all\n")
    for poll, text in enumerate(edits):
        file.write_text(text, encoding="utf-8")
        lines.filter(F.col("event_id") % 3 == poll).select("raw_bytes").write.mode("append").parquet(folder)
        sink = lambda df, n, poll=poll: df.select("class_uid", "mapping_version", F.col("mapping_hash").isNotNull().alias("mapped"), F.lit(poll).cast("bigint").alias("poll")).write.mode("append").parquet(out)
        stream = spark.readStream.schema("raw_bytes binary").parquet(folder)
        ingest.ingest(stream, "app_events", raw, registry, checkpoint, lambda n: 1_700_000_000_000_000_000 + n, sink).awaitTermination()
    version = F.when(F.col("mapped"), F.col("mapping_version"))
    return spark.read.parquet(out).groupBy("poll", "class_uid", version.alias("version")).agg(F.count("*").alias("n"))

