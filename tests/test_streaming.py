from pyspark.sql import functions as F

from tidemark.operators import discovery, templates
from tidemark.plans.mapping import Registry
from tidemark.sources import tail
from tidemark.streaming import ingest


def test_ingest_is_idempotent_over_replays(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_bytes(b"1789588800.123 342 10.0.0.5 TCP_MISS/200 8431 GET http://x/ - H/1 t\n\nbroken \xff line\n")
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")

    def sink(df, number):
        df.write.mode("append").parquet(out)

    for i in range(2):  # the second run has a new checkpoint, so the same batch is delivered again
        ingest.ingest(ingest.read_lines(spark, str(tmp_path / "in")), "squid_access", raw, Registry.bundled(), str(tmp_path / f"cp{i}"), lambda n: 1_789_588_900_000_000_000 + n, sink).awaitTermination()
    assert spark.read.parquet(raw).count() == 2
    first = spark.read.parquet(out).filter("parse_status = 'full'").first()
    assert first.fields.http_response_code == 200 and first.fields.time == 1789588800123


def test_reobservation(spark):
    rows = [("a", t) for t in (0, 30_000, 60_000, 119_000, 120_000)] + [("b", 5)]
    got = ingest.reobserve(spark.createDataFrame(rows, "conn string, at_ms long"), ["conn"]).orderBy("conn", "at_ms").collect()
    assert [tuple(r) for r in got] == [("a", 0), ("a", 60_000), ("a", 120_000), ("b", 5)]


def test_common_keys(spark):
    rows = [("s", i, f"src=10.0.0.{i} n={i * 70000} only{i}=1") for i in range(1, 4)]
    values = discovery.key_values(spark.createDataFrame(rows, "source_id string, sample long, body string"))
    assert {(r.key, r.type) for r in discovery.common_keys(values).collect()} == {("src", "ip"), ("n", "integer")}
    assert values.filter(F.col("key") == "src").count() == 3


def test_integers_are_integers_at_any_length(spark):
    rows = [("s", i, f"n={i * 70000} big={10**20 + i} mixed={i if i % 2 else 'x'} port={i % 65535 + 1}") for i in (1, 99_999, 6_000_000)]
    values = discovery.key_values(spark.createDataFrame(rows, "source_id string, sample long, body string"))
    assert {(r.key, r.type) for r in discovery.common_keys(values).collect()} == {("n", "integer"), ("big", "integer"), ("mixed", "string"), ("port", "port")}


def test_tail_follows_appends_rotation_and_partial_lines(spark, tmp_path):
    logs, out = tmp_path / "logs" / "zeek", str(tmp_path / "out")
    logs.mkdir(parents=True)
    spark.dataSource.register(tail.TailSource)
    log = logs / "conn.log"

    def poll():
        lines = spark.readStream.format("tail").option("path", str(tmp_path / "logs")).load()
        lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(bytes(r.raw_bytes) for r in spark.read.parquet(out).collect())

    log.write_bytes(b"#head\none\r\n\ntw")
    assert poll() == [b"one"]
    with log.open("ab") as f:
        f.write(b"o\nthree\n")
    assert poll() == [b"one", b"three", b"two"]
    log.write_bytes(b"new\n")  # shorter than before: rotated
    assert poll() == [b"new", b"one", b"three", b"two"]
    assert poll() == [b"new", b"one", b"three", b"two"]
    assert {r.source_id for r in spark.read.parquet(out).collect()} == {"zeek_conn"}


def test_miner_state_round_trip():
    one, lines = templates.Miner(), [f"user {i} did {w} now".split() for i, w in enumerate(["a", "b", "c"] * 5)]
    two = templates.Miner()
    for line in lines:
        assert one.add(line) == two.add(line)
        two = templates.Miner.loads(two.dumps())
    assert one.templates == two.templates
