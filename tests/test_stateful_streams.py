"""Streams that keep state between triggers."""

import builtins
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.operators import identity, ledger, skipping, store, templates
from tidemark.plans.mapping import Registry
from tidemark.plans.normalize import normalize
from tidemark.sources import tail
from tidemark.streaming import ingest, state


def poll(spark, tmp_path, rows, schema, make, name="q", mode="append"):
    """One trigger of a stream that has had `rows` added; returns all it has written so far."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / name / "in"))
    out = str(tmp_path / name / "out")
    with state.rocksdb(spark):
        q = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / name / "cp")).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    return q, spark.read.parquet(out)


def test_redelivery_within_and_outside_the_watermark(spark, tmp_path):
    schema, minute = "idem_key string, arrived_ms long", 60_000
    make = lambda s: state.once_within(s, delay="30 minutes")
    polls = [[("a", 0), ("b", 0), ("a", 0)], [("a", 10 * minute), ("c", 10 * minute)], [("d", 100 * minute)], [("e", 110 * minute)], [("a", 120 * minute), ("e", 120 * minute)]]
    seen = []
    for rows in polls:
        _, out = poll(spark, tmp_path, [(k, t + 10**12) for k, t in rows], schema, make)
        seen.append(sorted(r.idem_key for r in out.collect()))
    assert seen[0] == ["a", "b"] and seen[1] == ["a", "b", "c"]
    assert seen[-1] == ["a", "a", "b", "c", "d", "e"]  # a was forgotten, e not yet; the table knows a


def test_marks_between_polls(spark, tmp_path):
    schema = "channel string, record_id long, text string"
    for rows, want in (
        ([("sys", 5, "x"), ("sys", 4, "y"), ("app", 9, "z")], 3),  # a first poll has all
        ([("sys", 5, "x"), ("sys", 6, "v"), ("app", 9, "z")], 4),
        ([("sys", 6, "v"), ("app", 8, "old"), ("new", 1, "n"), ("new", 1, "again")], 6),
    ):
        _, out = poll(spark, tmp_path, rows, schema, state.marks)
        assert out.count() == want


def test_reobservation_expires(spark, tmp_path):
    schema, t0 = "conn string, at_ms long", 10**12

    def seen(*rows):
        q, out = poll(spark, tmp_path, [(c, t0 + t) for c, t in rows], schema, lambda s: state.reobserved(s, ["conn"], 60_000, "1 second"))
        return q, sorted((r.conn, r.at_ms - t0) for r in out.collect())

    _, got = seen(*[("a", t) for t in (0, 30_000, 60_000, 119_000, 120_000)], ("b", 5))
    assert got == [("a", 0), ("a", 60_000), ("a", 120_000), ("b", 5)]
    _, got = seen(("a", 179_999), ("c", 400_000))
    assert got[-1] == ("c", 400_000) and len(got) == 5
    # the watermark is near 400 s: a and b are forgotten, and a's next sighting is reported as it would have been
    _, got = seen(("a", 500_000))
    assert ("a", 500_000) in got
    seen(("z", 10_000_000))
    q, got = seen(("z", 10_000_001))
    assert len(got) == 7 and q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3  # z alone, with its timer


def test_timeline_counts_late_events(spark, tmp_path):
    hour = 3_600_000
    schema, out, cp = "observed_time long, source_id string", str(tmp_path / "t"), str(tmp_path / "cp")
    for rows in ([(100 * hour, "s"), (100 * hour + 1, "s")], [(76 * hour, "s"), (100 * hour + 5, "s"), (70 * hour, "s")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        state.write_timeline(state.timeline(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), out, cp).awaitTermination()
    # 24 hours late counts, 30 hours late doesn't
    assert sorted(map(tuple, state.read_timeline(spark, out).collect())) == [(76 * hour, "s", 1), (100 * hour, "s", 3)]


@pytest.fixture
def tailed(spark, tmp_path):
    spark.dataSource.register(tail.TailSource)
    (tmp_path / "logs" / "squid").mkdir(parents=True)
    out = str(tmp_path / "out")

    def poll(**options):
        lines = spark.readStream.format("tail").option("path", str(tmp_path / "logs")).options(**options).load()
        lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(bytes(r.raw_bytes) for r in spark.read.schema(tail.SCHEMA).parquet(out).collect())

    return tmp_path / "logs" / "squid" / "access.log", poll


def test_tail_reads_a_renamed_file_to_its_end(tailed):
    log, poll = tailed
    log.write_bytes(b"one\ntw")
    assert poll() == [b"one"]
    with log.open("ab") as f:
        f.write(b"o\nthree\nfour")
    log.rename(log.with_name("access.log.1"))
    log.write_bytes(b"five\n")
    assert poll() == sorted([b"one", b"two", b"three", b"four", b"five"])
    assert len(poll()) == 5


def test_tail_driver_opens_no_file(tmp_path, monkeypatch):
    (tmp_path / "squid").mkdir()
    (tmp_path / "squid" / "access.log").write_bytes(b"x" * 1000 + b"\n")
    monkeypatch.setattr(builtins, "open", lambda *a, **k: pytest.fail("the driver opened a file"))
    reader = tail._Reader({"path": str(tmp_path), "maxBytesPerTrigger": "400"})
    start = reader.initialOffset()
    for want in (400, 800, 1001, 1001):
        offset = reader.latestOffset()
        assert [f["at"] for f in offset["files"].values()] == [want]
    assert sum(p.end - p.start for p in reader.partitions(start, offset)) == 1001


def test_tail_ranges_give_each_line_once(tmp_path, monkeypatch):
    (tmp_path / "squid").mkdir()
    log, lines = tmp_path / "squid" / "access.log", [b"l%d " % i + b"y" * (i * 37 % 91) for i in range(300)]
    log.write_bytes(b"\r\n".join(lines) + b"\r\nopen")
    monkeypatch.setattr(tail, "BLOCK", 64)
    for size in (1, 7, 100, 5000, 10**6):
        monkeypatch.setattr(tail, "RANGE_BYTES", size if size > 1 else 13)
        reader = tail._Reader({"path": str(tmp_path)})
        parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
        assert [x for p in parts for b in reader.read(p) for x in b.column(2).to_pylist()] == lines
    assert tail.shares({"a": 5, "b": 100, "c": 100}, 50) == {"a": 5, "b": 22, "c": 23}


def test_sealing_reads_only_what_is_new(spark, tmp_path):
    """Three micro-batches on three days, the last with a redelivery: a step reads the days of its own events."""
    day, path, sizes = 86_400 * 10**9, str(tmp_path / "ledger"), []
    raw = identity.capture(spark.createDataFrame([(f"{i}".encode(), (i // 10) * day + i) for i in range(30)], "raw_bytes binary, ns long"), "s", F.col("ns"))
    for step in range(3):
        own = raw.filter((F.col("received_at_ns") >= step * day) & (F.col("received_at_ns") < (step + 1) * day))
        sizes.append(ledger.seal(own if step < 2 else own.unionByName(raw.filter(F.col("received_at_ns") < 5)), path, {}, step, 4, flush=False, batch_ns=10))
    assert sizes == [2, 3, 2]
    others = [f for f in (tmp_path / "ledger" / "leaves").rglob("*.parquet") if "day=1970-01-02" not in str(f)]
    for f in others:  # files of other days can't even be opened
        f.rename(f.with_suffix(".away"))
        f.write_bytes(b"not parquet")
    assert ledger.sealed_on(spark, path, ["1970-01-02"]).select("event_uid", "seal").collect()
    for f in others:
        f.with_suffix(".away").rename(f)
    assert ledger.open_events(spark, path).count() == 2 and ledger.state(spark, path)["open_since_ns"] == 2
    assert ledger.tick(spark, path, {}, 11, 4, 10) == 0 and ledger.tick(spark, path, {}, 12, 4, 10) == 1
    assert ledger.open_events(spark, path).count() == 0 and ledger.tick(spark, path, {}, 99, 4, 10) == 0
    batches, leaf = ledger.read(spark, path, "batches"), ledger.read(spark, path, "leaves")
    assert [r.leaf_count for r in batches.orderBy("batch_id").collect()] == [4] * 7 + [2]
    assert ledger.verify(batches, leaf, raw).filter("reason IS NOT NULL").count() == 0
    made = ledger.proofs(leaf.withColumn("leaf", ledger.leaf_hash(F.col("event_uid"), F.col("raw_hash"))), raw, ledger.read(spark, path, "nodes"))
    inner = ledger.read(spark, path, "nodes").groupBy("batch_id").agg(F.max_by("hash", "level").alias("inner"))
    ok = made.join(inner, "batch_id").filter(ledger.proves(F.col("leaf"), F.col("steps"), F.col("inner")) & (F.col("root") == F.col("inner")))
    assert ok.count() == 30


def test_a_step_that_failed_counts_for_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    raw = identity.capture(spark.createDataFrame([(f"{i}".encode(), i) for i in range(10)], "raw_bytes binary, ns long"), "s", F.col("ns"))
    ledger.seal(raw.filter("received_at_ns < 5"), path, {}, 1, 2, flush=False)
    before = ledger.state(spark, path)
    # what a seal writes before its row in the journal
    lost = spark.createDataFrame([(before["last_batch"] + 1, 0, "u", "00", "lost", "1970-01-01")], ledger.LEAVES)
    lost.write.mode("append").partitionBy("day").parquet(f"{path}/leaves")
    assert ledger.read(spark, path, "leaves").filter("seal = 'lost'").count() == 0
    assert ledger.seal(raw, path, {}, 2, 2) == 3 and ledger.seal(raw, path, {}, 3, 2) == 0
    batches = ledger.read(spark, path, "batches")
    assert batches.agg(F.sum("leaf_count")).first()[0] == 10 and ledger.verify(batches, ledger.read(spark, path, "leaves"), raw).filter("reason IS NOT NULL").count() == 0


def test_ingest_seals_its_micro_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_bytes(b"".join(b"1789588800.%03d 342 10.0.0.5 TCP_MISS/200 8431 GET http://x/ - H/1 t\n" % i for i in range(5)))
    path, registry = str(tmp_path / "ledger"), Registry.bundled()
    for i in range(2):  # the second run has a new checkpoint: all is delivered again
        seal = ingest.sealing(path, registry, lambda: 10**18, 2)
        ingest.ingest(ingest.read_lines(spark, str(tmp_path / "in")), "squid_access", str(tmp_path / "raw"), registry, str(tmp_path / f"cp{i}"), lambda n: 1_789_588_900_000_000_000 + n, lambda df, n: df.count(), seal=seal).awaitTermination()
    assert ledger.read(spark, path, "batches").count() == 2 and ledger.open_events(spark, path).count() == 1


def _records(spark, rows):
    df = spark.createDataFrame(rows, "event_uid string, source_id string, observed_time long, parse_status string, title string")
    empty = normalize(identity.capture(spark.createDataFrame([], "raw_bytes binary, ns long"), "none", F.col("ns")), Registry(), sources=["none"])
    more = {f.name: F.lit(None).cast(f.dataType) for f in empty.schema.fields if f.name not in df.columns}
    return df.withColumns(more).drop("title")


def test_upsert_touches_only_its_partitions(spark, tmp_path):
    day, path = 86_400_000, str(tmp_path / "p")
    rows = [(f"{s}{d}{i}", s, d * day + i, "quarantined", "t") for s in ("a", "b") for d in (0, 1) for i in range(3)]
    assert store.upsert_table(_records(spark, rows), path, 1) == {"written": 12, "resolved": 0}
    files = lambda: {f.relative_to(tmp_path) for f in (tmp_path / "p").rglob("*.parquet")}
    before = files()
    assert store.upsert_table(_records(spark, [("a00", "a", 0, "full", "t"), ("a09", "a", 9, "full", "t")]), path, 2) == {"written": 2, "resolved": 1}
    changed = {str(f.parent) for f in before ^ files()}
    assert changed == {"p/source_id=a/day=1970-01-01"}
    got = {r.event_uid: (r.parse_status, r.first_status, r.first_seen_ns, r.resolved_at_ns) for r in spark.read.parquet(path).collect()}
    assert len(got) == 13 and got["a00"] == ("full", "quarantined", 1, 2) and got["a09"] == ("full", "full", 2, None) and got["b12"] == ("quarantined", "quarantined", 1, None)
    assert store.upsert_table(_records(spark, rows[:1]), path, 3)["resolved"] == 0  # a resolved event that goes back keeps its stamp
    assert store.upsert_table(_records(spark, []), path, 4) == {"written": 0, "resolved": 0}


def test_search_opens_only_files_that_may_match(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, f"event {i} by User{i % 10} at host{i // 10}.example", "src") for i in range(80)]
    spark.createDataFrame(rows, "id long, summary string, source_id string").repartitionByRange(8, "id").write.parquet(path)
    index = skipping.index(spark.read.parquet(path), ("summary", "source_id")).persist()
    for text, n in (("HOST3.exa", 1), ("user4 at host5", 1), ("ost7%ample", 1), ("nowhere", 0), ("by user", 8)):
        files = skipping.files_with(index, text)
        assert len(files) == n, text
        want = {r.id for r in store.where(spark.read.parquet(path), search=text).collect()}
        for f in set(spark.read.parquet(path).inputFiles()) - set(files):  # the others can't even be opened
            p = Path(f.removeprefix("file://"))
            p.rename(p.with_suffix(".away"))
        assert {r.id for r in skipping.search(spark, path, index, text).collect()} == want
        for p in (tmp_path / "t").glob("*.away"):
            p.rename(p.with_suffix(".parquet"))
    assert skipping.files_with(index, "a_b") is None and skipping.search(spark, path, index, "t_1").count() == store.where(spark.read.parquet(path), search="t_1").count()


def test_lookup_by_uid_skips_row_groups(spark, tmp_path):
    path = str(tmp_path / "raw")
    raw = identity.capture(spark.createDataFrame([(f"{i}".encode(), 10**18 + i * 10**9) for i in range(50)], "raw_bytes binary, ns long"), "s", F.col("ns"))
    assert store.append(raw, path) == {"accepted": 50, "duplicates": 0} and store.append(raw, path) == {"accepted": 0, "duplicates": 50}
    uid = raw.filter("received_at_ns = 1000000007000000000").first()["event_uid"]
    found = store.get(spark.read.parquet(path), uid)
    assert bytes(found.first()["raw_bytes"]) == b"7" and "EqualTo(event_uid" in found._jdf.queryExecution().toString()
    file = next((tmp_path / "raw").rglob("*.parquet"))
    meta = pq.read_metadata(file).row_group(0)
    assert meta.column(meta.to_dict()["columns"].index(next(c for c in meta.to_dict()["columns"] if c["path_in_schema"] == "event_uid"))).statistics.has_min_max


def test_mining_keeps_trees_between_triggers(spark, tmp_path):
    schema, out, cp = "source string, line_id long, text string", str(tmp_path / "mined"), str(tmp_path / "cp")
    polls = [[("a", i, f"{w} from x{i % 3} ok") for i, w in enumerate(["open", "shut", "open", "warn"] * 20)], [("a", 103, "open to y ok"), ("a", 102, "shut from z ok"), ("b", 1, "open from q ok"), ("a", 101, None)], [("b", 2, "open from r ok"), ("a", 104, "warn by me ok")]]
    miners, want = {}, {}
    for rows in polls:
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.mine_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), out, cp).awaitTermination()
        for source, line_id, text in sorted(rows):
            cut = (text or "").split()
            miner = miners.setdefault((source, len(cut)), templates.Miner())
            want[source, line_id] = (len(cut), " ".join(miner.templates[miner.add(cut)]))
        got = ingest.mined(spark, out).collect()
        assert len(got) == len(want) and {(r.source, r.line_id): (r.size, r.template) for r in got} == want
    assert ("a", 104) in want and any("<*>" in t for _, t in want.values())


def test_mining_holds_no_group_of_a_micro_batch():
    """Rows leave with the part they came in, so a group's lines are never together in a task."""
    taken = []

    def parts():
        for n in range(50):
            taken.append(n)
            ids = list(range(100 * n, 100 * n + 100))
            yield pa.RecordBatch.from_arrays([pa.array(["s"] * 100), pa.array([3] * 100, pa.int32()), pa.array(ids, pa.int64()), pa.array([f"user {i % 7} left" for i in ids]), pa.nulls(100, pa.string())], names=["source", "size", "line_id", "line", "tree"])

    seen = 0
    for out in ingest.mined_parts(parts()):
        seen += out.num_rows
        assert seen >= 100 * len(taken)
    assert seen == 5001  # and the tree
