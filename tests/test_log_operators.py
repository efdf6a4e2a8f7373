import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark import more_queries  # noqa: F401  (it registers its queries)
from tidemark.functions import scalars as S
from tidemark.functions import clock
from tidemark.operators import frames, identity, ledger, store, templates, views
from tidemark.operators.parsers import parse, xml_values
from tidemark.plans.mapping import Mapping, MappingError, Ref, Registry
from tidemark.plans.normalize import NO_TIME, normalize
from tidemark.queries import QUERIES

NS = 1_789_650_000_000_000_000


def one(spark, expr, **columns):
    row = spark.createDataFrame([tuple(columns.values()) or (0,)], list(columns) or ["x"])
    return row.select(expr.alias("v")).first()["v"]


def events(spark, source, lines):
    df = spark.createDataFrame([(i, x.encode() if isinstance(x, str) else x) for i, x in enumerate(lines)], "i long, raw_bytes binary")
    return identity.capture(df, source, F.col("i") + NS)


def test_identity_matches_hashlib(spark):
    raw, src = bytes(range(256)), "sensor-ä"
    got = identity.capture(spark.createDataFrame([(raw,)], "raw_bytes binary"), src, F.lit(NS), transport="udp").first()
    s = src.encode()
    assert got["raw_hash"] == hashlib.sha256(raw).hexdigest()
    assert got["idem_key"] == hashlib.sha256(raw + b"\0" + len(s).to_bytes(4, "big") + s + NS.to_bytes(8, "big")).hexdigest()
    assert got["event_uid"][14] == "7" and got["event_uid"][19] in "89ab" and len(got["event_uid"]) == 36
    assert one(spark, identity.uid_ms(F.col("u")), u=got["event_uid"]) == NS // 10**6
    assert not got["truncated"] and got["byte_len"] == 256
    with pytest.raises(TypeError):
        identity.capture(spark.createDataFrame([("x",)], "raw_bytes string"), "s", F.lit(NS))


@pytest.mark.parametrize(
    ("kind", "text", "value"),
    [
        ("port", " 443 ", 443), ("port", "70000", None), ("port", "0", None), ("ip", "10.0.0.1:443", "10.0.0.1"), ("ip", "999.1.1.1", None), ("ip", "010.0.0.1", None),
        ("ip", "2001:DB8:0:0:0:0:0:1", "2001:db8::1"), ("ip", "::", "::"), ("ip", "1:0:0:2:0:0:0:3", "1:0:0:2::3"), ("ip", "::ffff:1.2.3.4", "::ffff:102:304"), ("ip", "1::2::3", None), ("ip", "fe80::0001:0", "fe80::1:0"),
        ("mac", "AA-BB-CC-DD-EE-FF", "aa:bb:cc:dd:ee:ff"), ("mac", "aabbccddeeff", "aa:bb:cc:dd:ee:ff"), ("mac", "zz", None), ("boolean", "ALLOW", True), ("boolean", "deny", False), ("boolean", "x", None),
        ("integer", "1.5", None), ("integer", "+5", 5), ("timestamp", "946684799999", None), ("timestamp", "946684800000", 946684800000), ("email", "a@b", None), ("email", "a@b.c", "a@b.c"),
        ("url", "http://x", "http://x"), ("url", "://x", None), ("hostname", "-a", None), ("hostname", "a.b-c", "a.b-c"), ("string", "", None), ("string", " a", " a"),
    ],
)
def test_coercions(spark, kind, text, value):
    assert one(spark, S.coerce(F.col("c"), kind), c=text) == value


def test_transforms_and_lookups(spark):
    t = S.TRANSFORMS
    assert one(spark, t["iso8601"](F.col("c")), c="2026-01-02T03:04:05.1234567+0530") == str(1767303245123)
    assert one(spark, t["epoch_seconds"](F.col("c")), c="1758100000.5") == "1758100000500"
    assert one(spark, t["epoch_seconds"](F.col("c")), c="inf") is None
    assert one(spark, t["after_slash"](F.col("c")), c="a/b/c") == "c"
    assert one(spark, t["basename"](F.col("c")), c="C:\\x\\y.exe") == "y.exe"
    assert one(spark, S.syslog_ms(F.col("c"), F.lit(1767312000000)), c="Dec 31 23:50:00") == 1767225000000
    assert one(spark, S.lookup("zeek_disposition", F.col("c"), F.lit("0")), c=" rej ") == "2"
    assert one(spark, S.is_global(F.col("c")), c="8.8.8.8") and not one(spark, S.is_global(F.col("c")), c="198.51.100.1")


def test_parsers(spark):
    def of(fmt, body, names=()):
        return one(spark, parse(fmt, F.col("b"), names), b=body)

    assert of("csv", '1,"a,""b""", ,x').positional == ["1", 'a,"b"', "", "x"]
    assert of("cef", "<1> CEF:0|v|p|1|deny\\|drop|n|5|src=1.1.1.1 msg=a b").positional[4] == "deny|drop"
    assert of("cef", "CEF:0|v").error
    assert of("leef", "LEEF:2.0|V|P|1.0|evt|^|src=1^dst=10.0.0.2").named == {"src": "1", "dst": "10.0.0.2"}
    assert of("leef", "LEEF:2.0|V|P|1.0|evt|x5E|src=1^dst=2").named["dst"] == "2"
    assert of("leef", "LEEF:1.0|V|P|1.0|evt|src=1\tdst=2").named["dst"] == "2"
    assert of("kv", 'a=1 a=2 q="x y"').named == {"a": "2", "q": "x y"}
    assert of("kv", "nothing").error
    assert of("json", '{"src.ip":"x","src":{"ip":"y"},"t":true}', ["src.ip", "t"]).named == {"src.ip": "x", "t": "True"}
    assert of("json", "[1]", ["a"]).error and of("json", "{", ["a"]).error
    assert of("raw", "  ").error and of("ssv", " a  b ").positional == ["a", "b"]
    assert xml_values("<a><b n='1'/><c Name='k'>x</c><c>y</c></a>") == {"b.@n": "1", "c.0.@Name": "k", "c.0": "x", "c.k.@Name": "k", "c.k": "x", "c.@Name": "k", "c": "x", "c.1": "y"}
    assert xml_values("<a>") is None


def test_framing_and_detection(spark):
    df = spark.createDataFrame([("\ufeff<13>1 2026-01-02T03:04:05Z h app 1 ID x=1",), ("<999>plain",), ("",), (None,)], "t string")
    rows = frames.detect(df, "t").collect()
    assert (rows[0].body, rows[0].syslog_pri, rows[0].syslog_tag) == ("x=1", 13, "app")
    assert (rows[1].body, rows[1].syslog_pri) == ("<999>plain", None)
    assert rows[2].format == "unknown"


def test_bundled_mappings_and_rejections():
    assert len(Registry.bundled().sources()) == 20
    good = {"source": "s", "format": "kv", "rules": [{"name": "r", "ocsf_class": 4001, "fields": {"src_endpoint.ip": "$a"}}]}
    assert Mapping.of(good).content_hash() == Mapping.of(good | {"description": "other"}).content_hash()
    for bad in ({"format": "nope"}, {"version": 0}, {"rules": []}, {"extra": 1}, {"rules": [good["rules"][0], {**good["rules"][0], "name": "b"}]}, {"rules": [{**good["rules"][0], "fields": {"no.such": 1}}]}, {"rules": [{**good["rules"][0], "fields": {"src_endpoint.ip": {"from": "$a", "regex": "("}}}]}):
        with pytest.raises(MappingError):
            Mapping.of(good | bad)
    assert Ref.of("$$x").value == "$x" and Ref.of("$7").value == 7 and Ref.of("$a.@b").kind == "named"
    with pytest.raises(MappingError):
        Ref.of("$0")


def test_registry_keeps_what_worked(tmp_path):
    path = tmp_path / "a.yaml"
    text = "source: a\nformat: raw\nrules:\n  - {name: r, ocsf_class: 2004, fields: {finding_info.title: $_raw}}\n"
    path.write_text(text)
    registry = Registry(tmp_path)
    assert registry.refresh().loaded == ["a"] and not registry.refresh().changed
    path.write_text("source: [")
    assert registry.refresh().errors and registry.get("a")
    path.unlink()
    assert registry.refresh().removed == ["a"] and registry.get("a") is None


def test_normalise_firewall_and_failures(spark):
    row = "<134>Sep 17 10:00:00 fw01 filterlog[1]: 5,,,1,em0,match,{},in,4,0x0,,64,1,0,DF,6,tcp,60,198.18.0.9,{},{},22,0"
    lines = [row.format("block", "10.0.0.5", 45332), row.format("pass", "10.0.0.5", 99999), row.format("other", "10.0.0.5", 1), ""]
    out = normalize(events(spark, "pfsense_filterlog", lines), Registry.bundled(), sources=["pfsense_filterlog"]).orderBy("observed_time", "event_uid").collect()
    by = {(r.rule_name, r.parse_status): r for r in out}
    full = by["block", "full"]
    assert full.fields.dst_endpoint_port == 22 and full.fields.severity_id == 3 and full.fields.disposition_id == 2 and full.notes == [NO_TIME] and full.fields.time == full.observed_time
    assert by["pass", "partial"].errors == ["src_endpoint.port: not a valid port"]
    assert sum(r.parse_status == "quarantined" for r in out) == 2
    unknown = normalize(events(spark, "nobody", ["a=1 b=2 c=3"]), Registry.bundled(), sources=["nobody"]).first()
    assert unknown.parse_status == "quarantined" and "key_value" in unknown.warnings[0]


def test_semantic_warnings(spark):
    text = "source: k\nformat: kv\nrules:\n  - {name: r, ocsf_class: 4001, fields: {time: {from: $t, transform: epoch_millis}, src_endpoint.ip: $s, dst_endpoint.ip: $d, src_endpoint.port: $sp, dst_endpoint.port: $dp, traffic.bytes: $b, traffic.bytes_in: $i, traffic.bytes_out: $o}}\n"
    registry = Registry()
    registry.add(Mapping.from_yaml(text))
    out = normalize(events(spark, "k", ["t=1789660800000 s=8.8.8.8 d=8.8.8.8 sp=80 dp=50000 b=1 i=1 o=1"]), registry, sources=["k"]).first()
    assert [w.split(":")[0] for w in out.warnings] == ["same_endpoint", "swapped_ports", "both_global", "byte_sum", "clock_drift"]


def test_append_and_upsert(spark, tmp_path):
    raw = events(spark, "pfsense_filterlog", ["a", "b", "b"])
    path = str(tmp_path / "raw")
    assert store.append(raw, path) == {"accepted": 3, "duplicates": 0}
    assert store.append(raw, path) == {"accepted": 0, "duplicates": 3}
    first = store.upsert(None, normalize(raw, Registry.bundled(), sources=["pfsense_filterlog"]), 1).persist()
    registry = Registry()
    registry.add(Mapping.from_yaml("source: pfsense_filterlog\nformat: raw\nrules:\n  - {name: r, ocsf_class: 2004, fields: {finding_info.title: $_raw}}\n"))
    second = store.upsert(first, normalize(raw.limit(2), registry, sources=["pfsense_filterlog"]), 2)
    got = store.quarantine_summary(second).first()
    assert (got.ever_quarantined, got.resolved, got.pending, got.total) == (3, 2, 1, 3)
    assert second.filter("resolved_at_ns = 2").count() == 2


def _root(leaves):
    while len(leaves) > 1:
        leaves = [hashlib.sha256(b"\1" + bytes.fromhex(leaves[i]) + bytes.fromhex(leaves[i + 1])).hexdigest() if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def test_merkle_roots_and_proofs(spark):
    rows = [(b, i, hashlib.sha256(f"{b}.{i}".encode()).hexdigest()) for b in (1, 2, 3, 5, 8, 13, 17) for i in range(b)]
    df = spark.createDataFrame(rows, "batch_id long, leaf_index int, leaf string")
    want = {b: _root([x for c, _, x in rows if c == b]) for b in (1, 2, 3, 5, 8, 13, 17)}
    for span in (8, 32):
        assert {r.batch_id: r.root for r in ledger.merkle_roots(df, span).collect()} == want
    assert {r.batch_id: r.root for r in ledger.merkle_roots_of_arrays(df).collect()} == want
    uids = df.withColumn("event_uid", F.concat_ws(".", "batch_id", "leaf_index"))
    made = ledger.proofs(uids, uids.filter("batch_id IN (1, 13, 17)").select("event_uid")).withColumn("ok", ledger.proves(F.col("leaf"), F.col("steps"), F.col("root"))).collect()
    assert len(made) == 31 and all(r.ok and r.root == want[r.batch_id] for r in made)


def test_sealing_waits_for_size_or_time(spark, tmp_path):
    raw = identity.capture(spark.createDataFrame([(str(i).encode(), i * 10**9) for i in range(1, 8)], "raw_bytes binary, ns long"), "s", F.col("ns"))
    path = str(tmp_path / "ledger")
    assert ledger.seal(raw, path, {"s": "h"}, 7 * 10**9, 3, flush=False) == 2  # the seventh waits
    assert ledger.seal(raw, path, {"s": "h"}, 7 * 10**9 + 1, 3, flush=False) == 0
    assert ledger.seal(raw, path, {"s": "h"}, 8 * 10**9, 3, flush=False) == 1  # it waited a second
    assert ledger.seal(raw, path, {"s": "h"}, 9 * 10**9, 3) == 0
    batches, leaf = ledger.read(spark, path, "batches"), ledger.read(spark, path, "leaves")
    assert [(r.batch_id, r.leaf_count, r.mapping_set) for r in batches.orderBy("batch_id").collect()] == [(1, 3, '{"s": "h"}'), (2, 3, '{"s": "h"}'), (3, 1, '{"s": "h"}')]
    assert ledger.verify(batches, leaf, raw).filter("reason IS NOT NULL").count() == 0 and ledger.verify(batches, leaf, start=2).count() == 2
    assert [r.leaf_index for r in ledger.leaves_of(leaf, 2).collect()] == [0, 1, 2] and ledger.batch_of(batches, 3).first().first_uid == ledger.batch_of(batches, 3).first().last_uid


def test_windows_and_dumps(spark):
    assert clock.window(10**12, "24H") == ("24h", 10**12 - 86_400_000, None) and clock.window(5, "all") == ("all", None, None) and clock.window(10**12, "?")[0] == "1h"
    assert one(spark, clock.bound_ms(F.lit("2026-09-17"))) == 1789583400000 and one(spark, clock.bound_ms(F.lit("nonsense"))) is None
    assert one(spark, views.hex_dump(F.lit(b"")) == "") and one(spark, views.hex_dump(F.lit(bytes(range(17))))).splitlines()[1] == "0010   10"
    assert one(spark, views.hex_dump(F.lit(b"x" * 400), 2)).splitlines()[-1] == "... (23 additional lines truncated for display)"


def test_verify_finds_tampering(spark):
    raw = events(spark, "s", [f"line {i}" for i in range(23)])
    leaf = ledger.leaves(raw, 5).persist()
    chained = ledger.chain(ledger.merkle_roots_of_arrays(leaf)).persist()
    reasons = lambda *a: [r.reason for r in ledger.verify(*a).orderBy("batch_id").collect()]
    assert reasons(chained, leaf, raw) == [None] * 5
    uid = leaf.filter("batch_id = 2 AND leaf_index = 1").first().event_uid
    assert reasons(chained, leaf, raw.filter(F.col("event_uid") != uid))[1] == "missing_event"
    assert reasons(chained, leaf, raw.withColumn("raw_bytes", F.when(F.col("event_uid") == uid, F.lit(b"x")).otherwise(F.col("raw_bytes"))))[1] == "altered_event"
    assert reasons(chained, leaf.filter(F.col("event_uid") != uid), raw)[1] == "leaf_count"
    assert reasons(chained.withColumn("root", F.when(F.col("batch_id") == 5, ledger.GENESIS).otherwise(F.col("root"))), leaf, raw)[4] == "root"


def test_dossiers_name_each_event_once(spark, tmp_path):
    """Beyond the 70,000 ports of the lines, and where lines of different events would be alike."""
    rows = [(i, datetime.datetime(2024, 1, 1), 3, "click", 1.0, "{}") for i in (5, 70_005, 99_999, 210_005)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["dossiers"](spark, str(tmp_path)).collect()
    assert sorted((r.event_id, r.received_ms, r.unplaced) for r in got) == [(i, 1_704_067_200_000, False) for i in (5, 70_005, 99_999, 210_005)]
    assert {r.cef_head for r in got} == {"CEF:0|Tidemark|Tidemark|3|4002|HTTP Activity|2|"} and {r.start for r in got} == {b"<134>Jan  2 03:0".hex()}


def test_mining(spark):
    lines = [("a", 0, "login ok for bob from 10.0.0.1"), ("a", 1, "login ok for eve from 10.0.0.2"), ("a", 2, "disk full on sda"), ("b", 3, "login ok for x from 1.1.1.1"), ("a", 4, "")]
    df = spark.createDataFrame(lines, "source string, line_id long, text string")
    mined = templates.mine(df).persist()
    assert {r.line_id: r.first_id for r in mined.collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    assert templates.templates(df, mined).filter("first_id = 0").first().template == "login ok for <*> from <*>"


def test_mining_in_shards_is_mining_in_one_tree(spark):
    rng = random.Random(4)
    words = ["open", "close", "read", "user", "é1", "a7", "<*>", "10", "x9y"]
    rows = []
    for n in range(3000):
        source = rng.choice(["plain", "digits", "many"])
        pick = words[:4] if source == "plain" else words
        first = f"{''.join(rng.choice('abcdefghij') for _ in range(2))}" if source == "many" else rng.choice(pick)
        rows.append((source, n, " ".join([first, *(rng.choice(pick) for _ in range(rng.randint(0, 5)))])))
    rows += [("plain", 5000, None), ("plain", 5001, "  ")]
    df = spark.createDataFrame(rows, "source string, line_id long, text string").repartition(3)
    cut = {r.line_id: (r.source, r.size, r.line) for r in templates.sharded(df).collect()}
    want, sizes, miners = {}, {}, {}
    for line_id in sorted(cut):
        source, size, text = cut[line_id]
        miner, firsts = miners.setdefault((source, size), (templates.Miner(), []))
        at = miner.add(text.split(" ") if text else [])
        if at == len(firsts):
            firsts.append(line_id)
        want[line_id] = firsts[at]
        sizes[firsts[at]] = sizes.get(firsts[at], 0) + 1
    assert {r.line_id: r.first_id for r in templates.mine(df).collect()} == want
    found = {r.first_id: (r.size, r.template) for r in templates.clusters(df).collect()}
    assert found == {f: (sizes[f], " ".join(m.templates[i])) for m, firsts in miners.values() for i, f in enumerate(firsts)}
    assert {r.first_id: (r.size, r.template or "") for r in templates.templates(df.fillna("", "text"), templates.mine(df)).collect()} == found
    shards = {r.source: r.n for r in templates.sharded(df).groupBy("source").agg(F.countDistinct("shard").alias("n")).collect()}
    assert shards["plain"] > 16 and shards["digits"] == 1  # first tokens with digits, and wildcards, keep a source's lines together
