"""Registered queries for the log operators, and their SQL.

The driver's tables hold no logs, so rows are rendered as log lines within Spark and go
through the operators; the SQL computes the answers from the tables' columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.lineage import spread, written
from tidemark.operators import discovery, frames, identity, ledger, report, store, templates
from tidemark.operators.parsers import parse
from tidemark.plans.mapping import Mapping, Registry
from tidemark.plans.normalize import normalize
from tidemark.sinks import render
from tidemark.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ms(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def line(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


EVENT_MAPPING = """
source: app_events
format: kv
version: 3
rules:
  - name: money
    match: {field: $type, in: [purchase, refund]}
    ocsf_class: 2004
    fields: {time: {from: $at, transform: epoch_millis}, finding_info.title: $type, user.uid: $user, severity_id: {from: $sev, default: 1}, src_endpoint.ip: $src, dst_endpoint.ip: $dst}
  - name: view
    match: {field: $type, equals: view}
    ocsf_class: 4001
    fields: {time: {from: $at, transform: epoch_millis}, src_endpoint.ip: $src, dst_endpoint.ip: $dst, dst_endpoint.port: $port, severity_id: {from: $sev, default: 1}, traffic.bytes: $size}
  - name: click
    match: {field: $type, startswith: cl}
    ocsf_class: 4002
    fields: {time: {from: $at, transform: epoch_millis}, http_request.http_method: {from: $type, lookup: http_method_activity, default: GET}, http_request.url.text: $url, src_endpoint.ip: $src, severity_id: 1}
"""


def event_lines(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """Events as log lines; `numbered` ones name their event_id, without which events of one time, user and type can have one line."""
    e = spread(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", ms("ts").alias("at")))
    text = line("<134>Jan  2 03:04:05 host app[7]: type=", F.col("event_type"), " user=", F.col("user_id"), " sev=", F.col("user_id") % 7, " src=10.", F.col("user_id") % 200, ".", F.col("event_id") % 250, ".7 dst=192.168.", F.col("user_id") % 5, ".1 port=", F.col("event_id") % 70000, " size=", F.col("event_id") % 1500, ' url="http://h/', F.col("user_id"), '"', *((" id=", F.col("event_id")) if numbered else ()), " at=", F.col("at"))
    return e.select("event_id", "event_type", "user_id", "at", text.cast("binary").alias("raw_bytes"), (F.col("at") * 1_000_000).alias("received_at_ns"))


def event_records(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """Events through capture and the compiled mapping; the uid carries no event id, so it is joined by order of the key."""
    raw = identity.capture(event_lines(spark, sf_dir, numbered), "app_events", F.col("received_at_ns"))
    registry = Registry()
    registry.add(Mapping.from_yaml(EVENT_MAPPING))
    return normalize(raw, registry, sources=["app_events"])


def projection(spark: SparkSession, sf_dir: str, *columns: str, numbered: bool = False) -> DataFrame:
    """The projection of the events as a table would hold it: written and read again, so that filters stop at it; only `columns`, if any are named."""
    out = store.upsert(None, event_records(spark, sf_dir, numbered), 0)
    return written(out.select(*columns) if columns else out, "projection")


_CLASS = "CASE WHEN event_type IN ('purchase', 'refund') THEN 2004 WHEN event_type = 'view' THEN 4001 WHEN event_type LIKE 'cl%' THEN 4002 END"
_STATUS = f"CASE WHEN ({_CLASS}) IS NULL THEN 'quarantined' WHEN event_type = 'view' AND event_id % 70000 NOT BETWEEN 1 AND 65535 THEN 'partial' ELSE 'full' END"
_SEVERITY = f"CASE WHEN ({_CLASS}) = 4002 THEN 1 WHEN ({_CLASS}) IS NOT NULL THEN CAST(user_id % 7 AS INTEGER) END"
_P = f"p AS (SELECT *, (epoch_us(ts) // 1000) AS at_ms, {_CLASS} AS class_uid, {_STATUS} AS status, {_SEVERITY} AS severity, CASE WHEN ({_CLASS}) IN (2004, 4001) THEN concat('192.168.', user_id % 5, '.1') END AS dst_ip FROM events)"


@query("SELECT event_id, sha256(concat(event_id, ',', event_type)) AS raw_hash, length(concat(event_id, ',', event_type)) AS byte_len, (epoch_us(ts) // 1000) AS uid_ms, true AS intact, false AS truncated FROM events")
def raw_capture(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", ms("ts"))
    raw = identity.capture(e.select("event_id", line(F.col("event_id"), ",", F.col("event_type")).cast("binary").alias("raw_bytes"), (F.col("at") * 1_000_000).alias("ns")), "app", F.col("ns"), transport="udp")
    at = F.split(identity.text_of(F.col("raw_bytes")), ",")
    return raw.select(at[0].cast("bigint").alias("event_id"), "raw_hash", "byte_len", identity.uid_ms(F.col("event_uid")).alias("uid_ms"), identity.intact(F.col("raw_bytes"), F.col("raw_hash")).alias("intact"), "truncated")


@query("SELECT event_type AS source_id, count(DISTINCT concat(user_id, '|', event_type)) AS n FROM events WHERE user_id % 2 = 1 GROUP BY 1")
def dedup_append(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").cast("binary").alias("raw_bytes"), "event_type", "user_id")
    all_ = identity.capture(e, F.col("event_type"), F.lit(1))
    stored = identity.capture(e.filter("user_id % 2 = 0"), F.col("event_type"), F.lit(1))
    return store.new_events(all_.unionByName(all_), stored).groupBy("source_id").agg(F.count("*").alias("n"))


@query("SELECT event_id, (epoch_us(ts) // 1000) AS received_ms FROM events WHERE event_type = 'view' AND (epoch_us(ts) // 1000) >= 1704500000000 AND (epoch_us(ts) // 1000) < 1705500000000 ORDER BY received_ms DESC, event_id DESC LIMIT 200")
def raw_range_scan(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_uid"), F.col("event_type").alias("source_id"), (ms("ts") * 1_000_000).alias("received_at_ns"))
    out = store.scan(e, "view", 1704500000000 * 10**6, 1705500000000 * 10**6, 200, newest_first=True)
    return out.select(F.col("event_uid").cast("bigint").alias("event_id"), F.expr("received_at_ns DIV 1000000").alias("received_ms"))


@query("""SELECT o_orderkey, concat('order ', o_orderkey, ' ', o_orderstatus) AS body, CASE WHEN o_orderkey % 300 <= 191 THEN o_orderkey % 300 END AS syslog_pri,
  CASE WHEN o_orderkey % 300 <= 191 THEN 'app' END AS syslog_tag, CASE WHEN o_orderkey % 300 <= 191 THEN o_orderkey % 300 % 8 END AS severity, CASE WHEN o_orderkey % 300 <= 191 THEN o_orderkey % 300 // 8 END AS facility
  FROM orders WHERE o_orderkey % 300 <= 191""")
def syslog_strip(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    pri = F.col("o_orderkey") % 300
    old = line("<", pri, ">Jan  2 03:04:05 host app[12]: order ", F.col("o_orderkey"), " ", F.col("o_orderstatus"))
    new = line("<", pri, ">1 2026-01-02T03:04:05.1Z host app 12 ID47 order ", F.col("o_orderkey"), " ", F.col("o_orderstatus"))
    out = frames.detect(o.withColumn("text", F.when(F.col("o_orderkey") % 2 == 0, old).otherwise(new)), "text").filter("syslog_pri IS NOT NULL")
    return out.select("o_orderkey", "body", F.col("syslog_pri").cast("bigint").alias("syslog_pri"), "syslog_tag", F.col("severity").cast("bigint").alias("severity"), F.col("facility").cast("bigint").alias("facility"))


@query("""SELECT ['cef', 'leef', 'json', 'xml', 'csv', 'key_value', 'syslog_text', 'unknown'][o_orderkey % 8 + 1] AS format,
  ['spec_parse', 'spec_parse', 'schema_walk', 'schema_walk', 'positional', 'spec_parse', 'template_mining', 'template_mining'][o_orderkey % 8 + 1] AS strategy, count(*) AS n FROM orders GROUP BY 1, 2""")
def detect_format(spark, sf_dir):
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    forms = [line("x CEF:0|v|p|1|", k, "|n|5|src=", c), line("LEEF:2.0|v|p|1|", k, "|cat=", c), line('{"a": ', k, ', "b": [', c, "]}"), line("<order id='", k, "'><c>", c, "</c></order>"), line(k, ",", c, ",x,", F.col("o_orderstatus"), ",z"), line("key=", k, " cust=", c, ' note="a b" st=', F.col("o_orderstatus")), line("order ", k, " was placed, by customer ", c, ", and it is fine"), line("   ")]
    text = F.element_at(F.array(*forms), (k % 8 + 1).cast("int"))
    return frames.detect(o.withColumn("text", text), "text").groupBy("format", "strategy").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, concat('a,\"', l_returnflag, '\" b') AS quoted, l_linestatus AS plain, CAST(l_quantity AS BIGINT) AS number, 5 AS cells FROM lineitem")
def parse_csv(spark, sf_dir):
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity"))
    text = line(F.col("l_orderkey"), ", ", F.col("l_linenumber"), ',"a,""', F.col("l_returnflag"), '"" b",', F.col("l_linestatus"), " , ", F.col("l_quantity").cast("bigint"))
    p = li.select(parse("csv", text).alias("x")).select("x.positional")
    cell = lambda i: F.get("positional", F.lit(i))
    return p.select(cell(0).cast("bigint").alias("l_orderkey"), cell(1).cast("int").alias("l_linenumber"), cell(2).alias("quoted"), cell(3).alias("plain"), cell(4).cast("bigint").alias("number"), F.size("positional").alias("cells"))


@query("SELECT c_custkey, c_name AS ssv_name, c_mktsegment AS tsv_segment, 3 AS n_ssv, 3 AS n_tsv FROM customer")
def parse_ssv_tsv(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = parse("ssv", line("  ", F.col("c_custkey"), "   ", F.col("c_name"), "\tx "))
    b = parse("tsv", line(F.col("c_custkey"), "\t", F.col("c_mktsegment"), " \t"))
    p = c.select(a["positional"].alias("a"), b["positional"].alias("b"))
    return p.select(F.col("a")[0].cast("bigint").alias("c_custkey"), F.col("a")[1].alias("ssv_name"), F.col("b")[1].alias("tsv_segment"), F.size("a").alias("n_ssv"), F.size("b").alias("n_tsv"))


@query("SELECT o_orderkey, o_orderpriority AS priority, o_orderstatus AS status, concat('last', o_custkey) AS repeated FROM orders")
def parse_kv(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = line("junk key=", F.col("o_orderkey"), ' prio="', F.col("o_orderpriority"), '" d.x=first d.x=last', F.col("o_custkey"), " st=", F.col("o_orderstatus"))
    n = o.select(parse("kv", text)["named"].alias("n"))
    return n.select(F.col("n")["key"].cast("bigint").alias("o_orderkey"), F.col("n")["prio"].alias("priority"), F.col("n")["st"].alias("status"), F.col("n")["d.x"].alias("repeated"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, concat('n', user_id) AS nested, event_type AS second, concat('lit', event_id) AS literal FROM events")
def parse_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = line('{"id": ', F.col("event_id"), ', "p": ', F.col("props"), ', "a": {"b": "n', F.col("user_id"), '"}, "l": ["x", "', F.col("event_type"), '"], "q.r": "lit', F.col("event_id"), '", "q": {"r": "no"}}')
    n = e.select(parse("json", text, ["id", "p.k", "a.b", "l.1", "q.r"])["named"].alias("n"))
    return n.select(F.col("n")["id"].cast("bigint").alias("event_id"), F.col("n")["p.k"].alias("k"), F.col("n")["a.b"].alias("nested"), F.col("n")["l.1"].alias("second"), F.col("n")["q.r"].alias("literal"))


@query("SELECT p_partkey, p_brand AS attribute, p_name AS named, p_type AS second, false AS bad FROM part")
def parse_xml(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    safe = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    text = line('<e xmlns="u:x"><s b="', safe("p_brand"), '"/><k>', F.col("p_partkey"), '</k><d><v Name="N">', safe("p_name"), "</v><v>", safe("p_type"), "</v></d></e>")
    n = p.select(parse("xml", text).alias("x")).select("x.named", "x.error")
    return n.select(F.col("named")["k"].cast("bigint").alias("p_partkey"), F.col("named")["s.@b"].alias("attribute"), F.col("named")["d.v.N"].alias("named"), F.col("named")["d.v.1"].alias("second"), F.col("error").isNotNull().alias("bad"))


@query("SELECT s_suppkey, concat('deny|drop ', s_name) AS cef_name, CAST(s_nationkey AS VARCHAR) AS cef_ext, s_name AS leef_id, CAST(s_nationkey AS VARCHAR) AS leef_ext FROM supplier")
def parse_cef_leef(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    c = parse("cef", line("host CEF:0|v|p|1|", F.col("s_suppkey"), "|deny\\|drop ", F.col("s_name"), "|5|n=", F.col("s_nationkey"), " x=1|2"))
    lf = parse("leef", line("LEEF:2.0|v|p|1|", F.col("s_name"), "|^|a=1^n=", F.col("s_nationkey"), "^z=9"))
    p = s.select(c.alias("c"), lf.alias("l"))
    return p.select(F.col("c.positional")[4].cast("bigint").alias("s_suppkey"), F.col("c.positional")[5].alias("cef_name"), F.col("c.named")["n"].alias("cef_ext"), F.col("l.positional")[4].alias("leef_id"), F.col("l.named")["n"].alias("leef_ext"))


@query("""SELECT event_id, (epoch_us(ts) // 1000) AS iso, (epoch_us(ts) // 1000) // 1000 * 1000 AS seconds, (epoch_us(ts) // 1000) AS millis, string_split(event_type, 'i')[1] AS head, concat('b', user_id) AS tail, concat('Q', event_type) AS bare, event_id AS number, '10.0.0.1' AS host FROM events""")
def transforms(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", ms("ts"))
    t = S.TRANSFORMS
    iso = F.concat(F.date_format(F.timestamp_millis("at"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("1234Z"))
    out = {
        "iso": t["iso8601"](iso).cast("bigint"), "seconds": t["epoch_seconds"](F.expr("at DIV 1000").cast("string")).cast("bigint"), "millis": t["epoch_millis"](F.col("at").cast("string")).cast("bigint"),
        "head": t["before_slash"](F.replace(F.col("event_type"), F.lit("i"), F.lit("/"))), "tail": t["after_slash"](line("a/x/b", F.col("user_id"))), "bare": t["strip_quotes"](line(' "Q', F.col("event_type"), '" ')),
        "number": t["to_int"](line(" +", F.col("event_id"), " ")).cast("bigint"), "host": t["strip_port"](line("10.0.0.1:", F.col("user_id"))),
    }
    return e.select("event_id", *(c.alias(n) for n, c in out.items()))


@query("SELECT o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN '2' WHEN o_orderkey % 3 = 1 THEN '1' ELSE '9' END AS code, count(*) AS n FROM orders GROUP BY 1, 2")
def lookup_codes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    word = F.when(F.col("o_orderkey") % 3 == 0, "DENY").when(F.col("o_orderkey") % 3 == 1, " allow ").otherwise("what")
    return o.select("o_orderpriority", S.lookup("firewall_disposition", word, F.lit("9")).alias("code")).groupBy("o_orderpriority", "code").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n, count(*) FILTER (l_partkey % 70000 BETWEEN 1 AND 65535) AS ports, count(*) FILTER (l_suppkey % 300 <= 255) AS ips, count(*) FILTER (l_linenumber % 2 = 0) AS macs,
  count(*) FILTER (l_linenumber % 3 = 0) AS emails, count(*) FILTER (epoch_ms(l_shipdate) >= 946684800000) AS times, count(*) FILTER (l_returnflag IN ('N', 'A')) AS flags, count(*) FILTER (l_linenumber <> 2) AS urls FROM lineitem""")
def coercions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    tests = {
        "ports": S.coerce(line(" ", F.col("l_partkey") % 70000), "port"), "ips": S.coerce(line("10.0.", F.col("l_suppkey") % 300, ".1:99"), "ip"), "macs": S.coerce(line(F.when(n % 2 == 0, "AA-bb:CC-00-11-").otherwise("AA-bb-CC-0-"), "2f"), "mac"),
        "emails": S.coerce(line(F.when(n % 3 == 0, "a@b.c").otherwise("a@b"), ""), "email"), "times": S.coerce(ms("l_shipdate").cast("string"), "timestamp"), "flags": S.coerce(F.when(F.col("l_returnflag") == "A", "ALLOW").when(F.col("l_returnflag") == "N", "n").otherwise("maybe"), "boolean"), "urls": S.coerce(F.when(n == 2, "://x").otherwise("h://x"), "url"),
    }
    return li.select(*(c.alias(k) for k, c in tests.items())).agg(F.count(F.lit(1)).alias("n"), *(F.count(k).alias(k) for k in tests))


@query(f"""WITH {_P} SELECT coalesce(CAST(class_uid AS VARCHAR), '-') AS class, CASE WHEN class_uid = 2004 THEN 'money' WHEN class_uid = 4001 THEN 'view' WHEN class_uid = 4002 THEN 'click' ELSE '-' END AS rule,
  status AS parse_status, count(*) AS n, count(severity) AS n_severity, coalesce(sum(severity), 0) AS severity, count(dst_ip) AS n_dst, count(*) FILTER (class_uid IS NOT NULL) AS n_time FROM p GROUP BY 1, 2, 3""")
def normalize_events(spark, sf_dir):
    f = F.col("fields")
    return event_records(spark, sf_dir).groupBy(F.coalesce(F.col("class_uid").cast("string"), F.lit("-")).alias("class"), F.coalesce("rule_name", F.lit("-")).alias("rule"), "parse_status").agg(
        F.count("*").alias("n"), F.count(f["severity_id"]).alias("n_severity"), F.coalesce(F.sum(f["severity_id"]), F.lit(0)).alias("severity"), F.count(f["dst_endpoint_ip"]).alias("n_dst"), F.count(f["time"]).alias("n_time"))


@query("""SELECT concat('10.0.', l_suppkey % 200, '.', l_linenumber) AS dst_ip, CASE WHEN l_returnflag = 'R' THEN 'block' ELSE 'pass' END AS rule_name, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 3 ELSE 1 END) AS severity FROM lineitem GROUP BY 1, 2""")
def firewall_by_destination(spark, sf_dir):
    """The flagship: firewall lines through the bundled mapping, counted by destination."""
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity"))
    action = F.when(F.col("l_returnflag") == "R", "block").otherwise("pass")
    text = line("<134>Sep 17 10:00:00 fw01 filterlog[1234]: 5,,,", F.col("l_orderkey"), ",em0,match,", action, ",in,4,0x0,,64,", F.col("l_partkey"), ",0,DF,6,tcp,60,198.18.0.9,10.0.", F.col("l_suppkey") % 200, ".", F.col("l_linenumber"), ",", F.col("l_partkey") % 60000 + 1, ",443,", F.col("l_quantity").cast("bigint"))
    raw = identity.capture(li.select(text.cast("binary").alias("raw_bytes"), (F.lit(1789650000000) * 1_000_000 + F.col("l_orderkey")).alias("ns")), "pfsense_filterlog", F.col("ns"))
    out = normalize(raw, Registry.bundled(), sources=["pfsense_filterlog"])
    return out.groupBy(F.col("fields")["dst_endpoint_ip"].alias("dst_ip"), "rule_name").agg(F.count("*").alias("n"), F.sum(F.col("fields")["severity_id"]).alias("severity"))


@query(f"WITH {_P} SELECT dst_ip AS k, count(*) AS n FROM p WHERE dst_ip IS NOT NULL GROUP BY 1 ORDER BY n DESC, k LIMIT 20")
def counts_by_destination(spark, sf_dir):
    return store.counts_by(projection(spark, sf_dir, "dst_ip"), "dst_ip")


@query(f"""WITH {_P} SELECT 'source_id' AS dimension, 'app_events' AS k, count(*) AS n FROM p UNION ALL SELECT 'parse_status', status, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'class_uid', CAST(class_uid AS VARCHAR), count(*) FROM p WHERE class_uid IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'severity_id', CAST(severity AS VARCHAR), count(*) FROM p WHERE severity IS NOT NULL GROUP BY 2 UNION ALL SELECT 'dst_ip', dst_ip, count(*) FROM p WHERE dst_ip IS NOT NULL GROUP BY 2""")
def overview_counts(spark, sf_dir):
    return store.overview_counts(projection(spark, sf_dir, *store.COUNTABLE[:5]))


@query(f"""WITH {_P}, w AS (SELECT status AS first_status, CASE WHEN status = 'quarantined' AND user_id % 3 = 0 THEN 'full' ELSE status END AS s FROM p)
  SELECT count(*) FILTER (first_status = 'quarantined') AS ever_quarantined, count(*) FILTER (first_status = 'quarantined' AND s <> 'quarantined') AS resolved, count(*) FILTER (s = 'quarantined') AS pending, count(*) AS total,
  round(count(*) FILTER (first_status = 'quarantined' AND s <> 'quarantined') / count(*) FILTER (first_status = 'quarantined'), 4) AS resolution_rate FROM w""")
def quarantine_after_upsert(spark, sf_dir):
    """A second wave resolves a third of the quarantined events; first statuses are carried."""
    records = written(event_records(spark, sf_dir), "records")
    wave = identity.capture(event_lines(spark, sf_dir).filter("user_id % 3 = 0"), "app_events", F.col("received_at_ns"))
    registry = Registry()
    registry.add(Mapping.from_yaml(EVENT_MAPPING + "  - name: rest\n    ocsf_class: 2004\n    fields: {finding_info.title: $type}\n"))
    again = written(normalize(wave, registry, sources=["app_events"]), "records")
    return store.quarantine_summary(store.upsert(store.upsert(None, records, 1), again, 2))


@query("""WITH b AS (SELECT min((epoch_us(ts) // 1000)) AS lo, max((epoch_us(ts) // 1000)) AS hi FROM events), w AS (SELECT lo, greatest((hi - lo) // 40, 1000) AS width FROM b)
  SELECT ((epoch_us(ts) // 1000) - lo) // width AS bucket, lo + ((epoch_us(ts) // 1000) - lo) // width * width AS start_ms, 'app_events' AS source_id, count(*) AS n FROM events, w GROUP BY 1, 2""")
def timeline_buckets(spark, sf_dir):
    return store.timeline(projection(spark, sf_dir, "source_id", "observed_time"))


@query(f"WITH {_P} SELECT round(avg(CASE WHEN class_uid IS NULL THEN 0 ELSE 1 END), 4) AS coverage FROM p")
def average_coverage(spark, sf_dir):
    return store.average_coverage(projection(spark, sf_dir, "mapping_coverage"))


@query(f"WITH {_P} SELECT severity AS severity_id, at_ms AS observed_time, count(*) AS n FROM (SELECT * FROM p WHERE severity >= 3 AND user_id % 10 <> 0 ORDER BY severity DESC, at_ms DESC LIMIT 500) GROUP BY 1, 2")
def findings_topk(spark, sf_dir):
    p = projection(spark, sf_dir, "event_uid", "class_uid", "severity_id", "observed_time", "summary", "fields")
    normal = p.filter(F.col("fields")["user_uid"].endswith("0")).select("event_uid", F.lit("normal").alias("triage_status"), F.lit("ana").alias("triaged_by"), F.lit(None).cast("string").alias("triage_note"), F.lit(1).cast("bigint").alias("triaged_ns"))
    views = p.filter("class_uid = 4001").select("event_uid", F.split("summary", "[.]")[1].cast("bigint").alias("u"))
    normal = normal.unionByName(views.filter("u % 10 = 0").select("event_uid", F.lit("normal").alias("triage_status"), F.lit("ana").alias("triaged_by"), F.lit(None).cast("string").alias("triage_note"), F.lit(1).cast("bigint").alias("triaged_ns")))
    top = store.findings(store.with_triage(p, normal))
    return top.groupBy("severity_id", "observed_time").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE text ILIKE '%the_and%' OR lang ILIKE '%the_and%'")
def search_ilike(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("summary"), F.col("lang").alias("source_id"))
    return store.where(d, search="the_AND").select("doc_id", "lang")


@query("SELECT event_id, sha256(unhex('00') || encode(CAST(event_id AS VARCHAR)) || unhex('1F') || unhex(sha256(event_type))) AS leaf FROM events")
def merkle_leaf(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", ledger.leaf_hash(F.col("event_id").cast("string"), F.sha2("event_type", 256)).alias("leaf"))


MERKLE_SQL = """
WITH RECURSIVE l0 AS (
  SELECT event_id // 1000 AS batch_id, event_id % 1000 AS i, sha256(unhex('00') || encode(CAST(event_id AS VARCHAR)) || unhex('1F') || unhex(sha256(event_type))) AS h FROM events
), n AS (SELECT batch_id, count(*) AS leaf_count FROM l0 GROUP BY 1), t AS (
  SELECT 0 AS lvl, batch_id, i, h FROM l0
  UNION ALL
  SELECT lvl + 1, batch_id, i // 2, CASE WHEN count(*) = 2 THEN sha256(unhex('01') || unhex(max(h) FILTER (i % 2 = 0)) || unhex(max(h) FILTER (i % 2 = 1))) ELSE max(h) END FROM t WHERE lvl < 10 GROUP BY lvl, batch_id, i // 2
)
SELECT t.batch_id, h AS root, leaf_count FROM t JOIN n USING (batch_id) WHERE lvl = 10
"""


@query(MERKLE_SQL)
def merkle_roots(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    leaf = e.select(F.expr("event_id DIV 1000").alias("batch_id"), (F.col("event_id") % 1000).alias("leaf_index"), ledger.leaf_hash(F.col("event_id").cast("string"), F.sha2("event_type", 256)).alias("leaf"))
    return ledger.merkle_roots(leaf, 1024)


def _sealed(spark, sf_dir, numbered=False):
    raw = written(identity.capture(event_lines(spark, sf_dir, numbered), "app_events", F.col("received_at_ns")), "raw")  # read for leaves and for their check
    leaf = written(ledger.leaves(raw, 500), "leaves")
    return raw, leaf, ledger.chain(ledger.merkle_roots_of_arrays(leaf))


@query("SELECT CASE WHEN b = 4 THEN 'broken_link' WHEN b = 3 THEN 'leaf_count' ELSE '-' END AS reason, count(*) AS n FROM range(1, (SELECT 1 + (count(*) + 499) // 500 FROM events)) t(b) GROUP BY 1")
def ledger_verify(spark, sf_dir):
    """Batches of 500 events, chained; batch 3 has another leaf count and batch 4 another predecessor than they should."""
    raw, leaf, chained = _sealed(spark, sf_dir)
    forged = chained.withColumn("leaf_count", F.when(F.col("batch_id") == 3, F.col("leaf_count") + 1).otherwise(F.col("leaf_count"))).withColumn("prev_root", F.when(F.col("batch_id") == 4, ledger.GENESIS).otherwise(F.col("prev_root")))
    return ledger.verify(forged, leaf, raw).groupBy(F.coalesce("reason", F.lit("-")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT (SELECT (count(*) + 499) // 500 FROM events) AS batch_count, (SELECT count(*) FROM events) AS event_count, 1 AS first_batch, (SELECT (count(*) + 499) // 500 FROM events) AS last_batch")
def ledger_totals(spark, sf_dir):
    return ledger.totals(_sealed(spark, sf_dir)[2]).drop("chain_head")


@query("""SELECT event_id, concat(event_type, ' from <*> port <*> id <*> blk_ xy') AS masked, 9 AS n_tokens FROM events""")
def mask_tokens(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = templates.mask(line(F.col("event_type"), " from 10.0.0.", F.col("user_id") % 200, ":", F.col("event_id") % 9999, " port ", F.col("user_id"), " id 0x", F.hex("event_id"), " blk_-", F.col("event_id"), " xy"))
    return e.select("event_id", text.alias("masked"), (F.size(templates.tokens(text))).alias("n_tokens"))


@query("SELECT event_type AS source, count(*) AS size, concat('user <*> did ', event_type, ' thing on <*>') AS template FROM events GROUP BY 1")
def mine_templates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lines = e.select(F.col("event_type").alias("source"), F.col("event_id").alias("line_id"), line("user ", F.col("user_id"), " did ", F.col("event_type"), " thing on 10.0.0.", F.col("user_id") % 200).alias("text"))
    return templates.clusters(lines).select("source", "size", "template")


@query("SELECT round(count(*) FILTER (event_type <> 'view' AND NOT (event_type = 'click' AND event_id % 4 = 1) AND event_type <> 'error') / count(*), 6) AS accuracy FROM events")
def template_accuracy(spark, sf_dir):
    """Views are split in two by their length, errors take in a quarter of the clicks: neither is a right group, nor are those clicks."""
    e = table(spark, sf_dir, "events")
    t, i = F.col("event_type"), F.col("event_id")
    tail = F.when((t == "view") & (i % 2 == 1), " long ms").otherwise(" ms")
    stray = (t == "click") & (i % 4 == 1)
    text = line(F.when(stray, "error").otherwise(t), " by user ", F.col("user_id"), " took ", i, tail)
    truth = F.when(stray, "strayed").otherwise(t)
    lines = e.select(F.lit("all").alias("source"), i.alias("line_id"), text.alias("text"), truth.alias("truth"))
    mined = templates.mine(lines).select("line_id", F.col("first_id").alias("predicted"))
    return templates.grouping_accuracy(mined.join(lines.select("line_id", "truth"), "line_id"))


def _customer_records(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    f = F.struct(F.lit(4).alias("severity_id"), F.lit("10.0.0.1").alias("src_endpoint_ip"), F.lit(None).cast("string").alias("dst_endpoint_ip"), F.col("c_nationkey").alias("src_endpoint_port"), F.lit(443).alias("dst_endpoint_port"), F.col("c_custkey").alias("time"), F.lit(None).cast("bigint").alias("traffic_bytes_in"), F.lit(None).cast("bigint").alias("traffic_bytes_out"), F.lit("").alias("message"), line("a=b|", F.col("c_name")).alias("finding_info_title"))
    return c.select("c_custkey", F.col("c_custkey").cast("string").alias("event_uid"), F.lit("h").alias("raw_hash"), F.lit("m=1").alias("mapping_id"), F.lit(2).alias("mapping_version"), F.lit(2004).alias("class_uid"), f.alias("fields"))


@query(r"""SELECT c_custkey, concat('CEF:0|Acme\|Co|T|2|2004|Detection Finding|7|src=10.0.0.1 spt=', c_nationkey, ' dpt=443 rt=', c_custkey, ' msg=a\=b|', c_name, ' cs1=', c_custkey, ' cs1Label=eventUid cs2=h cs2Label=rawHash cs3=m\=1 cs3Label=mappingId') AS cef,
  concat('LEEF:2.0|Acme\|Co|T|2|2004|', 'devTime=', c_custkey, chr(9), 'src=10.0.0.1', chr(9), 'srcPort=', c_nationkey, chr(9), 'dstPort=443', chr(9), 'sev=4', chr(9), 'eventUid=', c_custkey, chr(9), 'rawHash=h', chr(9), 'mappingId=m=1') AS leef FROM customer""")
def render_cef_leef(spark, sf_dir):
    return _customer_records(spark, sf_dir).select("c_custkey", render.cef("Acme|Co", "T").alias("cef"), render.leef("Acme|Co", "T").alias("leef"))


@query(f"WITH {_P} SELECT concat('date=', strftime(ts, '%Y-%m-%d'), '/class=', coalesce(class_uid, 0)) AS partition, count(*) AS n FROM p GROUP BY 1")
def lake_partitions(spark, sf_dir):
    return render.partition_counts(event_records(spark, sf_dir))


@query("SELECT event_id AS record_id, event_type AS channel FROM events WHERE event_type <> 'view' AND (event_type <> 'click' OR event_id > 5000)")
def high_water_mark(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("record_id"), F.col("event_type").alias("channel"))
    marks = e.filter("channel = 'view'").unionByName(e.filter("channel = 'click' AND record_id <= 5000"))
    return store.above_mark(e, store.new_marks(marks))


@query("SELECT event_type AS source_id, k.key AS key, k.type AS type FROM (SELECT DISTINCT event_type FROM events) e, (SELECT unnest([{'key': 'ip', 'type': 'ip'}, {'key': 'n', 'type': 'integer'}, {'key': 'who', 'type': 'string'}, {'key': 'mac', 'type': 'mac'}, {'key': 'port', 'type': 'port'}]) AS k)")
def common_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rare = F.when(F.col("event_id") % 2 == 0, line(" rare=", F.col("user_id"))).otherwise("")
    text = line("ip=10.0.0.", F.col("user_id") % 200, " n=", F.col("event_id") * 70000, " who=u", F.col("user_id"), " mac=aa:bb:cc:dd:ee:0", F.col("user_id") % 10, " port=", F.col("event_id") % 65535 + 1, rare)
    samples = e.select(F.col("event_type").alias("source_id"), F.col("event_id").alias("sample"), text.alias("body"))
    return discovery.common_keys(discovery.key_values(samples))


REOBSERVE_SQL = """
WITH RECURSIVE o AS (
  SELECT user_id, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events
), t AS (
  SELECT user_id, at_ms, n, at_ms AS last, true AS hit FROM o WHERE n = 1
  UNION ALL
  SELECT o.user_id, o.at_ms, o.n, CASE WHEN o.at_ms - t.last >= 36000000 THEN o.at_ms ELSE t.last END, o.at_ms - t.last >= 36000000 FROM t JOIN o ON o.user_id = t.user_id AND o.n = t.n + 1
)
SELECT user_id, count(*) AS n, sum(at_ms) AS total FROM t WHERE hit GROUP BY 1
"""


@query(REOBSERVE_SQL)
def reobserve(spark, sf_dir):
    seen = table(spark, sf_dir, "events").select("user_id", ms("ts").alias("at_ms"))
    return ingest.reobserve(seen, ["user_id"], 36_000_000).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("at_ms").alias("total"))


@query(f"""WITH {_P}, o AS (SELECT status, row_number() OVER (ORDER BY at_ms, event_id) AS n FROM p) SELECT (SELECT count(*) FROM o) AS events, (SELECT count(*) FROM o WHERE status = 'full') AS full_events, (SELECT (count(*) + 499) // 500 FROM o) AS batches, 0 AS unplaced""")
def dossier_totals(spark, sf_dir):
    raw, leaf, chained = _sealed(spark, sf_dir)
    d = report.placed_events(raw, projection(spark, sf_dir, "event_uid", "parse_status"), leaf, chained)
    return d.agg(F.count("*").alias("events"), F.count_if(F.col("parse_status") == "full").alias("full_events"), F.countDistinct("batch_root").alias("batches"), F.count_if(F.col("leaf_index").isNull()).alias("unplaced"))


@query("SELECT (SELECT (count(*) + 499) // 500 FROM events) AS batch_count, (SELECT count(*) FROM events) AS event_count, (SELECT min(epoch_us(ts) // 1000) FROM events) AS from_ms, (SELECT max(epoch_us(ts) // 1000) FROM events) AS until_ms, true AS intact")
def certificate_figures(spark, sf_dir):
    raw, leaf, chained = _sealed(spark, sf_dir)
    c = report.certificate(chained, ledger.verify(chained, leaf, raw), raw)
    return c.select("batch_count", "event_count", identity.div(F.col("from_ns"), 1_000_000).alias("from_ms"), identity.div(F.col("until_ns"), 1_000_000).alias("until_ms"), "intact")
