"""Registered queries, continued: ledger state, discovery, the console's reads, validation, sources and streams, with their SQL."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.functions import scalars as S
from tidemark.functions.lineage import new_path, written
from tidemark.operators import discovery, frames, identity, ledger, report, store, templates, views
from tidemark.plans.catalogue import NAMES, SEVERITIES
from tidemark.plans.mapping import Mapping, Registry
from tidemark.plans.normalize import normalize
from tidemark.plans.validate import unknown_fields, validate
from tidemark.queries import _P, EVENT_MAPPING, _customer_records, _sealed, event_lines, event_records, line, ms, projection, query, table
from tidemark.sinks import render
from tidemark.sources import tail
from tidemark.streaming import ingest

_MS = "(epoch_us(ts) // 1000)"
_NAME = "CASE class_uid " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in NAMES.items()) + " END"
_SEV = "CASE severity " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in SEVERITIES.items()) + " END"


def _registry(*texts: str) -> Registry:
    out = Registry()
    for t in texts:
        out.add(Mapping.from_yaml(t))
    return out


def _raw(spark, sf_dir):
    return identity.capture(event_lines(spark, sf_dir), "app_events", F.col("received_at_ns"))


# -- raw store ---------------------------------------------------------------------------------------------------------


@query("SELECT event_id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '.', lpad(CAST(epoch_us(ts) % 1000000 * 1000 + event_id % 1000 AS VARCHAR), 9, '0'), 'Z') AS iso FROM events")
def iso_nanos(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000
    return e.select("event_id", identity.received_iso(ns).alias("iso"))


@query("SELECT sha256(concat(event_id, ',', event_type)) AS raw_hash, event_type AS source_id FROM events WHERE event_id = (SELECT max(event_id) // 2 FROM events)")
def raw_lookup(spark, sf_dir):
    """An event is looked up by its uid in a table by source and day, whose other days aren't read."""
    e, path = table(spark, sf_dir, "events"), new_path(spark, "raw")
    of = lambda x: identity.capture(x.select(line(F.col("event_id"), ",", F.col("event_type")).cast("binary").alias("raw_bytes"), "event_type", (ms("ts") * 1_000_000).alias("ns")), F.col("event_type"), F.col("ns"))
    store.append(of(e), path)
    middle = e.join(F.broadcast(e.agg(F.expr("max(event_id) DIV 2").alias("m"))), F.col("event_id") == F.col("m"))
    return store.get(spark.read.parquet(path), of(middle).first()["event_uid"]).select("raw_hash", "source_id")


@query("SELECT count(*) AS n FROM events")
def raw_count(spark, sf_dir):
    return store.count(_raw(spark, sf_dir))


@query("""SELECT CASE event_id % 12 WHEN 0 THEN 'nginx_access' WHEN 1 THEN 'nginx_error' WHEN 2 THEN 'squid_access' WHEN 3 THEN 'postfix_maillog' WHEN 4 THEN 'openssh_auth' WHEN 5 THEN 'suricata_eve' WHEN 6 THEN 'zeek_conn' WHEN 7 THEN 'iptables' WHEN 8 THEN 'linux_auditd' END AS source_id,
  count(*) AS n, count(*) FILTER (user_id % 4 <> 0 AND NOT (event_id % 12 = 6 AND user_id % 4 = 1)) AS kept FROM events GROUP BY 1""")
def watch_sources(spark, sf_dir):
    """Lines by the source of their file; blank lines and comments of one source aren't kept."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id") % 12
    paths = ["nginx/access.log", "nginx/error.log", "squid/access.log", "postfix/maillog", "ssh/a1.log", "suricata/eve.json", "zeek/conn.log", "netfilter/x.log", "auditd/audit.log", "ssh/deep/a.log", "other/access.log", "xnginx/access.log"]
    path = F.concat(F.lit("/var/log/"), F.element_at(F.array(*map(F.lit, paths)), (i + 1).cast("int")))
    text = F.when(F.col("user_id") % 4 == 0, " \t").when(F.col("user_id") % 4 == 1, "#fields").otherwise(F.col("event_type"))
    return e.select(tail.source_of(path).alias("source_id"), tail.kept(path, text).alias("kept")).groupBy("source_id").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"))


@query("WITH p AS (SELECT event_id // 3 AS k, event_type FROM events) SELECT count(*) AS submitted, count(DISTINCT (k, event_type)) AS accepted, count(DISTINCT (k, event_type)) FILTER (k % 2 = 0) AS before, count(DISTINCT (k, event_type)) AS stored FROM p")
def append_counts(spark, sf_dir):
    """Two appends to one table; what the first stored is found by the second in its partitions only."""
    e, k = table(spark, sf_dir, "events"), F.expr("event_id DIV 3")
    raw = identity.capture(e.select(k.alias("k"), "event_type", k.cast("string").cast("binary").alias("raw_bytes"), ((1_700_000_000 + k % 6 * 86_400) * 1_000_000_000).alias("ns")), F.col("event_type"), F.col("ns"))
    path = new_path(spark, "raw")
    one = store.append(raw.filter(F.decode("raw_bytes", "UTF-8").cast("long") % 2 == 0), path)
    two = store.append(raw, path)
    row = (two["accepted"] + two["duplicates"], one["accepted"] + two["accepted"], one["accepted"])
    return spark.createDataFrame([row], "submitted long, accepted long, before long").join(store.count(spark.read.parquet(path)).withColumnRenamed("n", "stored"), F.lit(True))


@query(f"WITH {_P} SELECT count(*) * 2 AS submitted, count(*) AS accepted, count(*) AS duplicates, count(*) FILTER (status = 'full') AS normalized, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'quarantined') AS quarantined, round(count(*) FILTER (status = 'full') / count(*), 4) AS coverage FROM p")
def ingest_outcome(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return store.ingest_outcome(raw.unionByName(raw), store.new_events(raw.unionByName(raw)), event_records(spark, sf_dir))


# -- console -----------------------------------------------------------------------------------------------------------

_LIST = f"SELECT strftime(make_timestamp(at_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS received_at, status AS parse_status, class_uid, {_NAME} AS class_name, severity, 1.0 AS coverage, 0 AS warnings FROM p WHERE status = 'full' AND at_ms BETWEEN 1704500000000 AND 1705500000000 ORDER BY at_ms DESC LIMIT 200"


@query(f"WITH {_P} SELECT received_at, parse_status, class_uid, class_name, severity, coverage, warnings, count(*) AS n FROM ({_LIST}) GROUP BY ALL")
def event_list(spark, sf_dir):
    found = views.event_list(projection(spark, sf_dir), 200, status="full", since_ms=1704500000000, until_ms=1705500000000)
    return found.groupBy("received_at", "parse_status", "class_uid", "class_name", "severity", "coverage", "warnings").agg(F.count("*").alias("n"))


@query(f"WITH {_P} SELECT status AS parse_status, count(*) FILTER (at_ms >= 1704500000000) AS n, max(CASE WHEN status = 'quarantined' AND user_id % 2 = 0 THEN true ELSE false END) AS resolved FROM p GROUP BY 1")
def event_counts(spark, sf_dir):
    """Filtered counts by status, and whether a status has rows that a later rule resolved."""
    p = projection(spark, sf_dir, "source_id", "parse_status", "first_status", "observed_time", "class_uid", "severity_id")
    rows = None
    for s in ("full", "partial", "quarantined"):
        n = views.event_count(p, status=s, since_ms=1704500000000).withColumn("parse_status", F.lit(s))
        rows = n if rows is None else rows.unionByName(n)
    later = p.withColumn("parse_status", F.when((F.col("parse_status") == "quarantined") & (F.col("observed_time") >= 0), "full").otherwise(F.col("parse_status")))
    flags = views.decoded(later).groupBy(F.col("first_status").alias("parse_status")).agg(F.bool_or("resolved").alias("resolved"))
    return rows.join(flags, "parse_status").select("parse_status", "n", "resolved")


@query(f"""WITH {_P}, x AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'web' ELSE 'app_events' END AS source_id FROM p), b AS (SELECT min(at_ms) AS lo, max(at_ms) AS hi FROM x), w AS (SELECT lo, greatest((hi - lo) // 40, 1000) AS width FROM b)
  SELECT (at_ms - lo) // width AS bucket, lo + (at_ms - lo) // width * width AS start_ms, count(*) FILTER (source_id = 'app_events') AS app_events, count(*) FILTER (source_id = 'web') AS web, count(*) AS total FROM x, w GROUP BY 1, 2""")
def timeline_wide(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, "web").otherwise("app_events").alias("source_id"), ms("ts").alias("observed_time"))
    return views.timeline_wide(e)


@query(f"WITH {_P} SELECT 'app_events' AS source_id, count(*) AS n FROM p WHERE status = 'quarantined'")
def quarantined_sources(spark, sf_dir):
    return store.quarantined_sources(projection(spark, sf_dir, "source_id", "parse_status"))


@query(f"WITH {_P} SELECT at_ms AS observed_time, count(*) AS n FROM (SELECT at_ms FROM p ORDER BY at_ms DESC LIMIT 50) GROUP BY 1")
def sample_uids(spark, sf_dir):
    p = projection(spark, sf_dir, "event_uid", "source_id", "observed_time")
    return p.select("event_uid", "observed_time").join(store.sample_uids(p, "app_events", 50), "event_uid").groupBy("observed_time").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, epoch_ms(d) - 19800000 AS start_ms, epoch_ms(d) + 86399999 - 19800000 AS end_ms, epoch_ms(d) + 3661000 AS zulu_ms, epoch_ms(d) + 3661500 - 19800000 AS plain_ms, epoch_ms(d) + 3660000 - 7200000 AS offset_ms, CAST(NULL AS BIGINT) AS bad_ms
  FROM (SELECT o_orderkey, date_trunc('day', o_orderdate) AS d FROM orders)""")
def window_bounds(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    texts = {"start_ms": clock.bound_ms(day), "end_ms": clock.bound_ms(line(" ", day, " "), is_end=True), "zulu_ms": clock.bound_ms(line(day, "T01:01:01Z")), "plain_ms": clock.bound_ms(line(day, "T01:01:01.500"), is_end=True), "offset_ms": clock.bound_ms(line(day, " 01:01+02:00")), "bad_ms": clock.bound_ms(line("x", day))}
    return table(spark, sf_dir, "orders").select("o_orderkey", *(c.alias(k) for k, c in texts.items()))


@query(f"""SELECT event_id, strftime(ts + INTERVAL '330 minutes', '%Y-%m-%d %H:%M:%S') || ' IST' AS ist, strftime(ts + INTERVAL '330 minutes', '%Y-%m-%d %H:%M:%S') || ' IST (' || strftime(ts, '%H:%M:%S') || 'Z)' AS both,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, {_MS} BETWEEN max({_MS}) OVER () - 21600000 AND max({_MS}) OVER () AS recent FROM events""")
def display_times(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", ms("ts").alias("t"))
    last = e.agg(F.max("t")).first()[0]
    _, since, until = clock.window(last, "6h")
    return e.select("event_id", clock.ist(F.col("t")).alias("ist"), clock.ist_utc(F.col("t")).alias("both"), clock.iso_ms(F.col("t")).alias("iso"), clock.within(F.col("t"), F.lit(since), F.lit(until)).alias("recent"))


@query(f"""WITH {_P} SELECT time, class, severity, parse_status, dst, available, short, count(*) AS n FROM (SELECT strftime(make_timestamp(at_ms * 1000) + INTERVAL '330 minutes', '%Y-%m-%d %H:%M:%S') || ' IST' AS time, coalesce({_NAME}, '-') AS class, coalesce({_SEV}, '-') AS severity, status AS parse_status,
  CASE WHEN dst_ip IS NULL THEN '' WHEN class_uid = 4001 AND event_id % 70000 BETWEEN 1 AND 65535 THEN concat(dst_ip, ':', event_id % 70000) ELSE dst_ip END AS dst, (SELECT count(*) FROM p) AS available, (SELECT count(*) FROM p) < 300 AS short FROM p ORDER BY at_ms DESC LIMIT 300) GROUP BY ALL""")
def log_report(spark, sf_dir):
    return views.log_report(projection(spark, sf_dir), 300).groupBy("time", "class", "severity", "parse_status", "dst", "available", "short").agg(F.count("*").alias("n"))


@query(f"""WITH {_P}, x AS (SELECT * FROM p WHERE at_ms >= 1704500000000) SELECT 'total' AS section, '' AS k, count(*) AS n FROM x UNION ALL SELECT 'source', 'app_events', count(*) FROM x UNION ALL SELECT 'class', {_NAME}, count(*) FROM x WHERE class_uid IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'severity', {_SEV}, count(*) FROM x WHERE severity IS NOT NULL GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM x GROUP BY 2 UNION ALL SELECT 'coverage', '', CAST(round(avg(CASE WHEN class_uid IS NULL THEN 0 ELSE 1 END) * 10000) AS BIGINT) FROM x""")
def report_bundle(spark, sf_dir):
    return views.report_bundle(projection(spark, sf_dir, "source_id", "class_uid", "severity_id", "parse_status", "mapping_coverage", "observed_time"), since_ms=1704500000000)


@query("""WITH b AS (SELECT event_id, event_type, 'id=' || event_id || ' ' || repeat(event_type || ' ', CAST(event_id % 60 AS INTEGER)) AS t FROM events), n AS (SELECT *, ceil(length(t) / 16) AS lines FROM b)
  SELECT event_id, CAST(least(lines, 20) + CASE WHEN lines > 20 THEN 1 ELSE 0 END AS BIGINT) AS n_lines, '0000   ' || regexp_replace(lower(hex(encode(t[1:15]))), '(..)', '\\1 ', 'g') || lower(hex(encode(t[16:16]))) AS first FROM n WHERE length(t) >= 16""")
def hex_dump(spark, sf_dir):
    text = line("id=", F.col("event_id"), " ", F.repeat(line(F.col("event_type"), " "), (F.col("event_id") % 60).cast("int")))
    e = table(spark, sf_dir, "events").withColumn("raw", text.cast("binary")).filter(F.length("raw") >= 16)
    lines = views.hex_lines(F.col("raw"))
    return e.select("event_id", F.size(lines).cast("long").alias("n_lines"), lines[0].alias("first"))


@query(f"""WITH {_P} SELECT event_id, concat('CEF:0|Tidemark|Tidemark|3|', class_uid, '|', {_NAME}, '|', list_element([0, 2, 3, 5, 7, 9, 10], severity + 1), '|') AS cef_head, at_ms AS received_ms, false AS unplaced, lower(hex(encode(substr(concat('<134>Jan  2 03:04:05 host'), 1, 16)))) AS start FROM p WHERE class_uid IS NOT NULL""")
def dossiers(spark, sf_dir):
    raw, leaf, chained = _sealed(spark, sf_dir, numbered=True)
    d = views.dossiers(raw, projection(spark, sf_dir, numbered=True), leaf, chained).filter("class_uid IS NOT NULL")
    at = F.regexp_extract("raw_text", r"at=(\d+)$", 1).cast("long")
    event = F.regexp_extract("raw_text", r" id=(-?\d+) at=", 1).cast("long")
    start = F.replace(F.substring(F.split("hex", "\n")[0], 8, 60), F.lit(" "), F.lit(""))
    return d.select(event.alias("event_id"), F.concat(F.array_join(F.slice(F.split("cef", "[|]"), 1, 7), "|"), F.lit("|")).alias("cef_head"), at.alias("received_ms"), F.col("batch_root").isNull().alias("unplaced"), start.alias("start"))


@query("""SELECT c_custkey, concat('{"class_uid":2004,"dst_endpoint.port":443,"event_uid":"', c_custkey, '","finding_info.title":"a=b|', c_name, '","mapping_coverage":0.9,"mapping_hash":null,"mapping_id":"m=1","mapping_version":2,"message":"","observed_time":5,"parse_status":"full","raw_hash":"h","rule_name":null,"severity_id":4,"source_id":"s","src_endpoint.ip":"10.0.0.1","src_endpoint.port":', c_nationkey, ',"time":', c_custkey, ',"unmapped":{"k":"v"}}') AS json FROM customer""")
def render_json(spark, sf_dir):
    from tidemark.plans.catalogue import FIELDS, column, spark_type

    r = _customer_records(spark, sf_dir)
    own = {f.name for f in r.schema["fields"].dataType.fields}
    whole = F.struct(*(F.col("fields")[column(n)].cast(spark_type(k)).alias(column(n)) if column(n) in own else F.lit(None).cast(spark_type(k)).alias(column(n)) for n, k in FIELDS.items()))
    null = F.lit(None).cast("string")
    r = r.withColumns({"fields": whole, "mapping_hash": null, "rule_name": null, "observed_time": F.lit(5), "parse_status": F.lit("full"), "source_id": F.lit("s"), "mapping_coverage": F.lit(0.9), "unmapped": F.create_map(F.lit("k"), F.lit("v"))})
    return r.select("c_custkey", render.adapter("ocsf-json").alias("json"))


@query(f"WITH {_P} SELECT concat('date=', strftime(ts, '%Y-%m-%d'), '/class=', coalesce(class_uid, 0)) AS partition, 2 * count(*) AS n, count(*) AS lines FROM p GROUP BY 1")
def lake_exports(spark, sf_dir):
    """Two exports to one lake add up; as lines of JSON the records are counted once more."""
    records = event_records(spark, sf_dir)
    root, lines = new_path(spark, "lake"), new_path(spark, "ndjson")
    counts = [render.export(records, root) for _ in range(2)]
    render.export_ndjson(records, lines)
    again = spark.read.text(lines).select(F.get_json_object("value", "$.observed_time").cast("long").alias("observed_time"), F.get_json_object("value", "$.class_uid").cast("int").alias("class_uid"))
    told = spark.createDataFrame([(k, v + counts[1][k]) for k, v in counts[0].items()], "partition string, n long")
    return told.join(render.partition_counts(again).withColumnRenamed("n", "lines"), "partition")


# -- ledger ------------------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT event_id, row_number() OVER (ORDER BY epoch_us(ts) // 1000, event_id) - 1 AS seq, epoch_us(ts) // 1000 AS at_ms FROM events), n AS (SELECT (count(*) + 499) // 500 AS b FROM events)
  SELECT seq // 500 + 1 AS batch_id, count(*) AS n, CAST(count(*) - 1 AS INTEGER) AS last_index, min(at_ms) AS from_ms, max(at_ms) AS until_ms FROM o, n WHERE seq // 500 + 1 > b - 40 GROUP BY 1""")
def locate_events(spark, sf_dir):
    """The last 40 batches with their leaves' places and times."""
    raw, leaf, chained = _sealed(spark, sf_dir)
    at = ledger.locate(leaf, raw).join(raw.select("event_uid", "received_at_ns"), "event_uid").join(report.last_batches(chained).select("batch_id"), "batch_id")
    return at.groupBy("batch_id").agg(F.count("*").alias("n"), F.max("leaf_index").alias("last_index"), F.min(identity.div(F.col("received_at_ns"), 1_000_000)).alias("from_ms"), F.max(identity.div(F.col("received_at_ns"), 1_000_000)).alias("until_ms"))


@query("""WITH o AS (SELECT event_id, row_number() OVER (ORDER BY epoch_us(ts) // 1000, event_id) - 1 AS seq FROM events), b AS (SELECT seq // 500 + 1 AS batch_id, count(*) AS n FROM o GROUP BY 1)
  SELECT batch_id, CASE batch_id WHEN 2 THEN 'root' WHEN 3 THEN 'broken_link' WHEN 4 THEN 'leaf_count' WHEN 5 THEN 'missing_event' WHEN 6 THEN 'altered_event' END AS reason, false AS ok, 1 AS batches_checked, 500 AS events_checked, 2 AS first_divergence FROM b""")
def verify_reasons(spark, sf_dir):
    """Each reason against a batch, and the first divergence. Batch 2 has another root, so batch 3's link is broken."""
    raw, leaf, chained = _sealed(spark, sf_dir)
    leaf = written(leaf)
    at = lambda k: F.col("batch_id") == k
    forged = chained.withColumns({"root": F.when(at(2), ledger.GENESIS).otherwise(F.col("root")), "leaf_count": F.when(at(4), F.col("leaf_count") + 1).otherwise(F.col("leaf_count"))})
    places = leaf.filter("batch_id IN (5, 6) AND leaf_index = 7").select("event_uid", F.col("batch_id").alias("b"))
    now = raw.join(F.broadcast(places), "event_uid", "left").filter("b IS NULL OR b <> 5").withColumn("raw_bytes", F.when(F.col("b") == 6, F.lit(b"other")).otherwise(F.col("raw_bytes")))
    verified = written(ledger.verify(forged, leaf, now))
    first = ledger.first_divergence(verified).drop("reason")
    return verified.select("batch_id", "reason").join(F.broadcast(first), F.lit(True))


@query("""SELECT (SELECT (count(*) + 499) // 500 FROM events) AS batches, (SELECT count(*) FROM events) AS events, strftime((SELECT min(ts) FROM events) + INTERVAL '330 minutes', '%Y-%m-%d %H:%M:%S') AS from_ist, 'INTACT' AS verdict, 'app_events' AS sources""")
def certificate_text(spark, sf_dir):
    raw, leaf, chained = _sealed(spark, sf_dir)
    c = report.certificate(chained, ledger.verify(chained, leaf, raw), raw)
    text = c.select(F.split(views.certificate_text(c), "\n").alias("t"))
    of = lambda p, i: F.regexp_extract(F.col("t")[i], p, 1)
    return text.select(of(r"Batches: (\d+)", 2).cast("long").alias("batches"), of(r"events: (\d+)", 2).cast("long").alias("events"), of(r"Period: (\S+ \S+) IST", 1).alias("from_ist"), of(r"Verification: (.*)", 4).alias("verdict"), of(r"Sources: (.*)", 5).alias("sources"))


# -- discovery ---------------------------------------------------------------------------------------------------------


def _vendor_raw(spark, sf_dir):
    """Each event type is an unknown source: purchase and click have keys, view has stable positions, error is prose, signup has ports that are none."""
    e = table(spark, sf_dir, "events")
    u, i = F.col("user_id") % 200, F.col("event_id")
    keyed = line("SRC=10.0.0.", u, " spt=", i % 60000 + 1, " dst=192.168.1.", u, " dpt=443 bytes=", i, " usr=u", F.col("user_id"), " zone=z")
    ports = line("src=10.0.0.", u, " spt=", F.lit(70000) + i, " dst=10.9.9.", u, " act=a", i % 7)
    cef = line("CEF:0|v|p|1|", i, "|n|5|src=10.0.0.", u, " dst=10.1.1.", u, " spt=", i % 1000 + 1, " msg=m")
    free = line("accepted from 10.0.0.", u, "/", i % 60000 + 1, " to 1.1.1.", u, "/443 in rule ", i)
    prose = line("something of ", F.col("event_type"), " went wrong for them today")
    t = F.col("event_type")
    text = F.when(t == "purchase", keyed).when(t == "click", cef).when(t == "view", free).when(t == "signup", ports).otherwise(prose)
    return identity.capture(e.select("event_id", "event_type", text.cast("binary").alias("raw_bytes"), (ms("ts") * 1_000_000).alias("ns")), F.col("event_type"), F.col("ns"))


_FIELDS = {
    "purchase": ("key_value", "kv", 4002, {"src_endpoint.ip": "$SRC", "src_endpoint.port": "$spt", "dst_endpoint.ip": "$dst", "dst_endpoint.port": "$dpt", "traffic.bytes": "$bytes", "user.name": "$usr"}),
    "click": ("cef", "cef", 4001, {"src_endpoint.ip": "$src", "dst_endpoint.ip": "$dst", "src_endpoint.port": "$spt", "message": "$msg"}),
    "view": ("syslog_text", "ssv", 4001, {"src_endpoint.ip": "{ from: $3, transform: before_slash }", "src_endpoint.port": "{ from: $3, transform: after_slash }", "dst_endpoint.ip": "{ from: $5, transform: before_slash }", "dst_endpoint.port": "{ from: $5, transform: after_slash }"}),
    "signup": ("key_value", "kv", 4001, {"src_endpoint.ip": "$src", "dst_endpoint.ip": "$dst", "message": "$act"}),
    "error": ("syslog_text", "ssv", 4001, {}),
}
_EXPECTED = " UNION ALL ".join(f"SELECT '{s}' AS source_id, '{d}' AS detected, '{f}' AS format, {c} AS class_uid, '{'; '.join(f'{k}={v}' for k, v in sorted(x.items()))}' AS fields, {len(x)} AS n_fields" for s, (d, f, c, x) in _FIELDS.items())


@query(f"WITH x AS ({_EXPECTED}), n AS (SELECT event_type AS source_id, least(count(*), 60) AS sample_count FROM events GROUP BY 1) SELECT x.source_id, detected, format, class_uid, fields, sample_count, CASE WHEN x.source_id IN ('signup', 'error', 'view') THEN 1 ELSE 0 END AS n_notes FROM x JOIN n USING (source_id)")
def proposal_fields(spark, sf_dir):
    found = discovery.propose(discovery.samples_of(_vendor_raw(spark, sf_dir)))
    fields = F.array_join(F.transform("fields", lambda f: F.concat(f["target"], F.lit("="), f["ref"])), "; ")
    return found.select("source_id", "detected", "format", "class_uid", fields.alias("fields"), "sample_count", F.size("notes").alias("n_notes"))


@query(f"""WITH x AS ({_EXPECTED}), n AS (SELECT event_type AS source_id, least(count(*), 60) AS c FROM events GROUP BY 1)
  SELECT x.source_id, concat('source: ', x.source_id) AS source_line, concat('format: ', format) AS format_line, n_fields AS field_lines, n_fields > 0 AS loads FROM x JOIN n USING (source_id) WHERE n_fields > 0""")
def proposal_yaml(spark, sf_dir):
    """Proposals as mapping files, which load again."""
    found = discovery.propose(discovery.samples_of(_vendor_raw(spark, sf_dir))).filter("yaml IS NOT NULL")
    texts = {r["source_id"]: r["yaml"] for r in found.select("source_id", "yaml").collect()}
    loads = spark.createDataFrame([(s, len(Mapping.from_yaml(t).rules[0].fields)) for s, t in texts.items()], "source_id string, n int")
    lines = found.select("source_id", F.split("yaml", "\n").alias("y"))
    return lines.join(loads, "source_id").select("source_id", F.col("y")[2].alias("source_line"), F.col("y")[3].alias("format_line"), F.size(F.filter("y", lambda x: x.startswith("      "))).alias("field_lines"), (F.col("n") == F.size(F.filter("y", lambda x: x.startswith("      ")))).alias("loads"))


@query(f"""WITH x AS ({_EXPECTED}), n AS (SELECT event_type AS source_id, least(count(*), 60) AS c FROM events GROUP BY 1), s AS (SELECT x.source_id, n_fields, least(c / 20, 1.0) AS support, least(n_fields / 3, 1.0) AS f FROM x JOIN n USING (source_id))
  SELECT source_id, round(CASE WHEN n_fields = 0 THEN 0 ELSE support END, 4) AS support, round(f, 4) AS fields, CASE WHEN n_fields = 0 THEN 0.0 ELSE 1.0 END AS fill, CASE WHEN n_fields = 0 THEN 0.0 ELSE 1.0 END AS valid,
  round(CASE WHEN n_fields = 0 THEN 0.0 ELSE least(support, f) END, 4) AS confidence, n_fields >= 3 AND support = 1 AS auto FROM s""")
def proposal_scores(spark, sf_dir):
    """The gate's checks; a source without known fields scores nothing."""
    samples = discovery.samples_of(_vendor_raw(spark, sf_dir))
    s = discovery.score(discovery.propose(samples), samples)
    return s.select("source_id", *(F.round(c, 4).alias(c) for c in ("support", "fields", "fill", "valid", "confidence")), "auto")


@query("SELECT event_type AS source_id, count(*) AS n, CASE event_type WHEN 'click' THEN 'awaiting review' WHEN 'error' THEN 'a previous proposal was rejected' END AS reason FROM events GROUP BY 1")
def discovery_sources(spark, sf_dir):
    """Sources to examine: one waits for review, one was refused before."""
    p = store.upsert(None, normalize(_vendor_raw(spark, sf_dir), Registry(), sources=["none"]), 0)
    queue = discovery.empty_store(spark).unionByName(spark.createDataFrame([(1, "click", "cef", 4001, "", 3, 0.9, 30, "pending", 1, None, None, None), (2, "error", "ssv", 4001, "", 3, 0.9, 30, "rejected", 1, 2, "ana", None)], discovery.STORE))
    return discovery.to_examine(p, queue)


@query("SELECT 'pending' AS state, 2 AS n, 'click,view' AS sources UNION ALL SELECT 'approved', 1, 'signup' UNION ALL SELECT 'rejected', 0, ''")
def proposal_states(spark, sf_dir):
    """The store after two rounds over the samples and one decision."""
    samples = discovery.samples_of(_vendor_raw(spark, sf_dir))
    found = discovery.propose(samples).filter("source_id IN ('click', 'view', 'signup')")
    scores = discovery.score(found, samples)
    queue = written(discovery.add(discovery.add(discovery.empty_store(spark), found, scores, 1), found, scores, 2))
    queue = discovery.decide(queue, queue.filter("source_id = 'signup'").first()["proposal_id"], "approved", "ana", 3)
    names = discovery.pending(queue).unionByName(discovery.history(queue)).groupBy("state").agg(F.array_join(F.array_sort(F.collect_list("source_id")), ",").alias("sources"))
    return discovery.state_counts(queue).join(names, "state", "left").select("state", "n", F.coalesce("sources", F.lit("")).alias("sources"))


@query("SELECT count(*) AS replayed, count(*) AS normalized, 0 AS still_quarantined, count(*) AS resolved, count(*) AS with_source FROM events WHERE event_type = 'view'")
def backfill_source(spark, sf_dir):
    """Discovery's proposal for a source is approved, written as a mapping, and the source's backlog replayed."""
    raw, folder = _vendor_raw(spark, sf_dir), tempfile.mkdtemp(prefix="mappings-")  # the driver's own files
    registry = Registry(folder)
    path = new_path(spark, "projection")
    store.upsert_table(normalize(raw, registry, sources=["none"]), path, 0)
    before = written(spark.read.parquet(path), "before")
    found, _ = discovery.run(raw.filter("source_id = 'view'"), before.filter("source_id = 'view'"), discovery.empty_store(spark), 1)
    row = found.first()
    discovery.activate(row["source_id"], row["yaml"], "ana", folder, registry)
    discovery.backfill_table(raw, path, registry, "view", 2)
    after = spark.read.parquet(path)
    n = after.filter("source_id = 'view'").agg(F.count(F.col("fields")["src_endpoint_ip"]).alias("with_source"))
    return discovery.backfill_counts(before, after, "view").join(n, F.lit(True))


# -- mappings and validation -------------------------------------------------------------------------------------------

PREDICATE_MAPPING = r"""
source: app_events
format: kv
version: 1
rules:
  - {name: long, match: {field: $user, regex: '^\d{3,}$'}, ocsf_class: 2004, fields: {finding_info.title: {from: $_raw, regex: 'type=(?P<t>\w+) user', group: t, transform: uppercase}, finding_info.uid: $type}}
  - {name: many, match: {field: $sev, in: [5, 6]}, ocsf_class: 2004, fields: {finding_info.title: {from: $src, regex: '(\d+)\.7$'}, finding_info.uid: {from: $type, transform: lowercase}}}
  - {name: inner, match: {field: $_raw, contains: 'pe=cl'}, ocsf_class: 2004, fields: {finding_info.title: $$type, finding_info.uid: $nothing}}
  - {name: known, match: {field: $nothing, exists: false}, ocsf_class: 2004, fields: {finding_info.title: {from: $url, transform: basename}, finding_info.uid: {from: $nothing, default: none}}}
"""


@query(r"""WITH x AS (SELECT *, CASE WHEN user_id >= 100 THEN 'long' WHEN user_id % 7 IN (5, 6) THEN 'many' WHEN event_type LIKE 'cl%' THEN 'inner' ELSE 'known' END AS rule FROM events)
  SELECT rule AS rule_name, CASE rule WHEN 'long' THEN upper(event_type) WHEN 'many' THEN CAST(event_id % 250 AS VARCHAR) WHEN 'inner' THEN '$type' ELSE CAST(user_id AS VARCHAR) END AS title, CASE rule WHEN 'long' THEN event_type WHEN 'many' THEN event_type WHEN 'inner' THEN '-' ELSE 'none' END AS uid, count(*) AS n FROM x GROUP BY ALL""")
def rule_predicates(spark, sf_dir):
    r = normalize(_raw(spark, sf_dir), _registry(PREDICATE_MAPPING), sources=["app_events"])
    return r.groupBy("rule_name", F.col("fields")["finding_info_title"].alias("title"), F.coalesce(F.col("fields")["finding_info_uid"], F.lit("-")).alias("uid")).agg(F.count("*").alias("n"))


NOT_MAPPING = """
source: app_events
format: raw
rules:
  - {name: other, match: {field: $1, not_equals: view}, ocsf_class: 2004, fields: {time: {from: $_raw, regex: 'at=(.*)', transform: syslog_time}, finding_info.title: $1}}
"""


@query(f"""SELECT CASE WHEN event_type <> 'view' THEN 'other' END AS rule_name, CASE WHEN event_type <> 'view' THEN {_MS} // 1000 * 1000 END AS time, count(*) AS n, count(*) FILTER (event_type <> 'view') AS titled FROM events GROUP BY 1, 2""")
def raw_and_syslog_time(spark, sf_dir):
    """Raw bodies: the whole body is the first cell; device times without a year take the receipt's."""
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "view", "view").otherwise(line("x at=", F.date_format("ts", "MMM d HH:mm:ss")))
    raw = identity.capture(e.select(text.cast("binary").alias("raw_bytes"), (ms("ts") * 1_000_000).alias("ns")), "app_events", F.col("ns"))
    r = normalize(raw, _registry(NOT_MAPPING), sources=["app_events"])
    f = F.col("fields")
    return r.groupBy("rule_name", F.when(F.col("rule_name").isNotNull(), f["time"]).alias("time")).agg(F.count("*").alias("n"), F.count_if(f["finding_info_title"].startswith("x at=")).alias("titled"))


SEMANTIC_MAPPING = """
source: s
format: csv
rules:
  - {name: r, ocsf_class: 4001, fields: {time: {from: $1, transform: epoch_millis}, src_endpoint.ip: $2, dst_endpoint.ip: $3, src_endpoint.port: $4, dst_endpoint.port: $5, traffic.bytes: $6, traffic.bytes_in: $7, traffic.bytes_out: $8}}
"""


@query("""SELECT event_id, event_id % 5 = 0 AS same_endpoint, user_id % 3 = 0 AS swapped_ports, event_id % 7 = 0 AND event_id % 5 <> 0 AS both_global, event_id % 4 = 0 AS byte_sum, event_id % 6 = 0 AS clock_drift FROM events""")
def semantic_checks(spark, sf_dir):
    e, i = table(spark, sf_dir, "events").withColumn("at", ms("ts")), F.col("event_id")
    src = F.when((i % 7 == 0) & (i % 5 != 0), line("8.8.", i % 200, ".1")).otherwise(line("10.0.", i % 200, ".1"))
    dst = F.when(i % 5 == 0, src).when(i % 7 == 0, "9.9.9.9").otherwise("10.9.9.9")
    port = lambda a, b: F.when(F.col("user_id") % 3 == 0, a).otherwise(b)
    at = F.col("at") + F.when(i % 6 == 0, 7_200_000).otherwise(60_000)
    text = line(at, ",", src, ",", dst, ",", port("443", "50000"), ",", port("50000", "443"), ",100,60,", F.when(i % 4 == 0, "50").otherwise("40"), ",", i)
    raw = written(identity.capture(e.select(text.cast("binary").alias("raw_bytes"), (F.col("at") * 1_000_000).alias("ns")), "s", F.col("ns")))
    r = written(normalize(raw, _registry(SEMANTIC_MAPPING), sources=["s"]).select("event_uid", "warnings"))
    said = lambda n: F.exists("warnings", lambda w: w.startswith(n + ":")).alias(n)
    own = raw.select("event_uid", F.substring_index(identity.text_of(F.col("raw_bytes")), ",", -1).cast("long").alias("event_id"))
    return own.join(r, "event_uid").select("event_id", *map(said, ("same_endpoint", "swapped_ports", "both_global", "byte_sum", "clock_drift")))


@query("""SELECT CASE event_id % 4 WHEN 0 THEN 'no mapping' WHEN 1 THEN 'parse failed' WHEN 2 THEN 'no rule' ELSE 'all fields' END AS reason, 'quarantined' AS parse_status, CASE event_id % 4 WHEN 0 THEN 'other' WHEN 1 THEN 'keys' ELSE 'cells' END AS source_id, count(*) AS n FROM events GROUP BY 1, 3""")
def quarantine_reasons(spark, sf_dir):
    """Three sources in one plan (one without mapping), each with a reason to be quarantined; the last event has no valid field, not even its receipt time."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 4
    text = F.when(k == 0, line("free text ", F.col("event_id"))).when(k == 1, "no pairs").when(k == 2, line("none,", F.col("event_id"))).otherwise(line("bad,", F.lit("not an ip"), ",", F.col("event_id")))
    source = F.when(k == 0, "other").when(k == 1, "keys").otherwise("cells")
    raw = identity.capture(e.select(text.cast("binary").alias("raw_bytes"), source.alias("s"), F.when(k == 3, F.lit(1)).otherwise(ms("ts") * 1_000_000).cast("long").alias("ns"), "event_id"), F.col("s"), F.col("ns"))
    keys = "source: keys\nformat: kv\nrules:\n  - {name: k, ocsf_class: 4001, fields: {src_endpoint.ip: $a}}\n"
    cells = "source: cells\nformat: csv\nrules:\n  - {name: c, match: {field: $1, equals: bad}, ocsf_class: 4001, fields: {src_endpoint.ip: $2}}\n"
    r = normalize(raw, _registry(keys, cells))
    w = F.get("warnings", F.lit(0))
    reason = F.when(F.size("errors") > 0, "all fields").when(w.startswith("no mapping"), "no mapping").when(w.startswith("parse failed"), "parse failed").when(w.startswith("no rule"), "no rule")
    return r.groupBy(reason.alias("reason"), "parse_status", "source_id").agg(F.count("*").alias("n"))


@query("""SELECT event_id, 3 + CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS n_coerced, 1 AS n_unmapped, CASE WHEN event_id % 3 = 0 THEN 'src_endpoint.port: not a valid port' ELSE '' END AS errors, CASE WHEN event_id % 3 = 0 THEN 0.75 ELSE 0.8 END AS coverage, CASE WHEN event_id % 3 = 0 THEN 'src_endpoint.port: not a valid port,vendor.x: not a field of the class' ELSE 'vendor.x: not a field of the class' END AS strict_errors, 'vendor.x' AS unknown FROM events""")
def validate_records(spark, sf_dir):
    """Records of any origin against a class: unknown fields are kept apart and count against coverage, or are errors."""
    e = table(spark, sf_dir, "events")
    record = F.create_map(F.lit("time"), ms("ts").cast("string"), F.lit("src_endpoint.ip"), F.lit("10.0.0.1"), F.lit("src_endpoint.port"), F.when(F.col("event_id") % 3 == 0, "70000").otherwise("443"), F.lit("traffic.bytes"), F.col("event_id").cast("string"), F.lit("vendor.x"), F.lit("v"))
    df = validate(e.select("event_id", F.lit(4001).alias("c"), record.alias("r")), "c", "r")
    strict = validate(df.select("event_id", "c", "r"), "c", "r", strict=True).select("event_id", F.array_join("errors", ",").alias("strict_errors"))
    names = unknown_fields(F.map_keys("r"), 4001)
    return df.select("event_id", F.size("coerced").alias("n_coerced"), F.size("unmapped").alias("n_unmapped"), F.array_join("errors", ",").alias("errors"), F.round("coverage", 4).alias("coverage"), F.array_join(names, ",").alias("unknown")).join(strict, "event_id")


_WORDS = {n: sorted(t)[0] for n, t in sorted(S.LOOKUPS.items())}
_CODES = " UNION ALL ".join(f"SELECT '{n}' AS name, '{S.LOOKUPS[n][w]}' AS known, '0' AS unknown" for n, w in _WORDS.items())


@query(f"WITH t AS ({_CODES}) SELECT name, CASE WHEN o_orderkey % 2 = 0 THEN known ELSE unknown END AS code, count(*) AS n FROM t, orders GROUP BY 1, 2")
def all_lookups(spark, sf_dir):
    """Every lookup table, by a word of it in another case, and by a word that it hasn't."""
    o = table(spark, sf_dir, "orders")
    word = lambda w: F.when(F.col("o_orderkey") % 2 == 0, line(" ", F.lit(w.swapcase()), " ")).otherwise("no such word")
    rows = o.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), S.lookup(n, word(w), F.lit("0")).alias("code")) for n, w in _WORDS.items()))).alias("x"))
    return rows.groupBy("x.name", "x.code").agg(F.count("*").alias("n"))


@query("SELECT event_id, concat('f', user_id, '.Log') AS base, lower(event_type) AS low, upper(event_type) AS up, strftime(ts, '%Y') = '2024' AS same_year FROM events")
def more_transforms(spark, sf_dir):
    e, t = table(spark, sf_dir, "events"), S.TRANSFORMS
    path = F.when(F.col("event_id") % 2 == 0, line("/var/x/f", F.col("user_id"), ".Log")).otherwise(line("C:\\x\\f", F.col("user_id"), ".Log"))
    at = S.TIMED_TRANSFORMS["syslog_time"](F.date_format("ts", "MMM  d HH:mm:ss"), ms("ts")).cast("bigint")
    return e.select("event_id", t["basename"](path).alias("base"), t["lowercase"](F.initcap("event_type")).alias("low"), t["uppercase"](F.col("event_type")).alias("up"), (at == F.expr("unix_millis(CAST(ts AS timestamp)) DIV 1000 * 1000")).alias("same_year"))


@query("""SELECT o_orderkey, ['keys', 'columns', 'pairs', 'reason', ''][o_orderkey % 5 + 1] AS hint, CASE o_orderkey % 5 WHEN 0 THEN 'a,b' WHEN 1 THEN '5' WHEN 2 THEN '4' WHEN 3 THEN 'empty payload' END AS value FROM orders""")
def format_hints(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    forms = [line('{"b": ', k, ', "a": [1]}'), line(k, ",1,x,", F.col("o_orderstatus"), ",z"), line("key=", k, ' c=1 note="a b" st=', F.col("o_orderstatus")), F.lit("  "), line("order ", k, " was placed")]
    d = frames.detect(o.withColumn("text", F.element_at(F.array(*forms), (k % 5 + 1).cast("int"))), "text")
    hints = frames.hints_of(F.col("format"), F.col("body"))
    return d.select("o_orderkey", F.coalesce(F.get(F.map_keys(hints), F.lit(0)), F.lit("")).alias("hint"), F.get(F.map_values(hints), F.lit(0)).alias("value"))


@query("SELECT event_id, round(CASE WHEN event_type = 'view' THEN 0.75 ELSE 0.5 END, 4) AS similarity, 0.0 AS other_length, 1.0 AS empty FROM events")
def template_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t, words = F.array(F.lit("view"), F.lit("of"), F.lit(templates.WILD), F.lit("done")), F.array("event_type", F.lit("of"), F.col("user_id").cast("string"), F.lit("done"))
    none = F.array().cast("array<string>")
    return e.select("event_id", templates.similarity(t, words).alias("similarity"), templates.similarity(t, F.slice(words, 1, 3)).alias("other_length"), templates.similarity(none, none).alias("empty"))


# -- streams -----------------------------------------------------------------------------------------------------------


@query("SELECT event_type AS source, concat('user <*> did ', event_type, ' on <*>') AS template, count(*) AS n FROM events GROUP BY 1")
def mine_stream(spark, sf_dir):
    """By one trigger that takes all there is."""
    e = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    lines = e.select(F.col("event_type").alias("source"), F.col("event_id").alias("line_id"), line("user ", F.col("user_id"), " did ", F.col("event_type"), " on 10.0.0.", F.col("user_id") % 200).alias("text"))
    out = new_path(spark, "mine")
    ingest.mine_stream(lines, out, new_path(spark, "mine-state")).awaitTermination()
    return ingest.mined(spark, out).groupBy("source", "template").agg(F.count("*").alias("n"))


@query(f"WITH {_P} SELECT status AS parse_status, count(*) AS n, (SELECT count(*) FROM p) AS stored FROM p GROUP BY 1")
def ingest_stream(spark, sf_dir):
    """Lines through the streaming ingest twice (a redelivery with a new checkpoint): they are stored once."""
    registry = _registry(EVENT_MAPPING)
    lines = event_lines(spark, sf_dir).select("raw_bytes")
    folder, raw, out = new_path(spark, "lines"), new_path(spark, "raw"), new_path(spark, "records")
    lines.write.parquet(folder)
    for turn in range(2):
        stream = spark.readStream.schema(lines.schema).parquet(folder)
        sink = lambda df, n, turn=turn: df.select("event_uid", "parse_status", F.lit(turn).alias("turn")).write.mode("append").parquet(out)
        ingest.ingest(stream, "app_events", raw, registry, new_path(spark, "ingest-state"), lambda n: 1_700_000_000_000_000_000, sink).awaitTermination()
    stored = store.count(spark.read.parquet(raw)).withColumnRenamed("n", "stored")
    return spark.read.parquet(out).filter("turn = 0").groupBy("parse_status").agg(F.count("*").alias("n")).join(stored, F.lit(True))
