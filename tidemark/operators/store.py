"""The raw (bronze) and projected (silver) tables: appends without duplicates, upserts that carry state, analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import released, written
from tidemark.operators.identity import div
from tidemark.plans.normalize import summary

COUNTABLE = ("source_id", "parse_status", "class_uid", "severity_id", "dst_ip", "mapping_id", "first_status")
#: Files of a partition of a projection, at most; so many tasks write a hot source's day.
PARTS = 8
_CARRIED = ("first_status", "first_seen_ns", "resolved_at_ns")


def new_events(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Events whose idempotency key is neither repeated among them nor stored already."""
    once = events.dropDuplicates(["idem_key"])
    return once if existing is None else once.join(existing.select("idem_key"), "idem_key", "left_anti")


def append(events: DataFrame, path: str) -> dict[str, int]:
    """Appends what is new to a Parquet table by source and day; returns accepted and duplicate counts.

    Only the table's partitions of the batch's sources and days are read. The new rows are written to the shared folder
    first, so the counts and the table come from one evaluation.
    """
    spark = events.sparkSession
    seen = Observation()
    day = F.date_format(F.timestamp_millis(div(F.col("received_at_ns"), 1_000_000)), "yyyy-MM-dd")
    batch = written(events.withColumn("day", day).observe(seen, F.count("*").alias("submitted")), "batch")
    existing = None
    if _exists(spark, path):
        parts = batch.select("source_id", "day").distinct()  # of one batch: a row for each source and day
        existing = spark.read.parquet(path).withColumn("day", F.col("day").cast("string")).join(F.broadcast(parts), ["source_id", "day"], "left_semi")
    new = written(new_events(batch, existing), "new")
    # uids grow with time: in sorted files with Bloom filters get() skips row groups by both
    rows = new.sortWithinPartitions("source_id", "day", "event_uid").write.mode("append").option("parquet.bloom.filter.enabled#event_uid", "true")
    rows.partitionBy("source_id", "day").parquet(path)
    accepted = new.count()
    released(batch, new)
    return {"accepted": accepted, "duplicates": seen.get["submitted"] - accepted}


def ingest_outcome(submitted: DataFrame, accepted: DataFrame, records: DataFrame) -> DataFrame:
    """One row of counters: submitted, accepted, duplicates, normalized, partial, quarantined, and the share of accepted events that normalised fully."""
    n = submitted.agg(F.count("*").alias("submitted")).join(F.broadcast(accepted.agg(F.count("*").alias("accepted"))), F.lit(True))
    of = lambda s: F.count_if(F.col("parse_status") == s)
    out = n.join(F.broadcast(records.agg(of("full").alias("normalized"), of("partial").alias("partial"), of("quarantined").alias("quarantined"))), F.lit(True))
    coverage = F.when(F.col("accepted") > 0, F.round(F.col("normalized") / F.col("accepted"), 4)).otherwise(0.0)
    return out.select("submitted", "accepted", (F.col("submitted") - F.col("accepted")).alias("duplicates"), "normalized", "partial", "quarantined", coverage.alias("coverage"))


def get(raw: DataFrame, event_uid: str) -> DataFrame:
    """The raw event of a uid. The uid's time names its day, so a table by day is pruned to one or two."""
    ms = int(event_uid.replace("-", "")[:12], 16)
    if "day" in raw.columns:
        at = F.timestamp_millis(F.lit(ms))
        raw = raw.filter(F.col("day").cast("string") == F.date_format(at, "yyyy-MM-dd"))
    return raw.filter(F.col("event_uid") == event_uid)


def count(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count("*").alias("n"))


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan(raw: DataFrame, source_id: str | None = None, since_ns: int | None = None, until_ns: int | None = None, limit: int | None = None, newest_first: bool = False) -> DataFrame:
    """Raw events in order of receipt; since is inclusive, until exclusive."""
    for test, value in ((F.col("source_id") == source_id, source_id), (F.col("received_at_ns") >= (since_ns or 0), since_ns), (F.col("received_at_ns") < (until_ns or 0), until_ns)):
        raw = raw.filter(test) if value is not None else raw
    keys = ("received_at_ns", "event_uid")
    ordered = raw.orderBy(*(F.desc(k) if newest_first else F.asc(k) for k in keys))
    return ordered if limit is None else ordered.limit(limit)


def project(records: DataFrame) -> DataFrame:
    """Records with the columns that filters and groups use at top level."""
    f = F.col("fields")
    hot = {"event_time": f["time"], "severity_id": f["severity_id"], "src_ip": f["src_endpoint_ip"], "src_port": f["src_endpoint_port"], "dst_ip": f["dst_endpoint_ip"], "dst_port": f["dst_endpoint_port"]}
    return records.withColumns(hot | {"summary": summary(f)})


def upsert(prior: DataFrame | None, records: DataFrame, now_ns: int) -> DataFrame:
    """The projection after `records`: new rows replace prior ones, whose first status and time stay; a first way out of quarantine is stamped once."""
    new = project(records)
    if prior is None:
        return new.withColumns({"first_status": F.col("parse_status"), "first_seen_ns": F.lit(now_ns), "resolved_at_ns": F.lit(None).cast("bigint")})
    old = prior.select("event_uid", F.col("parse_status").alias("__status"), *(F.col(c).alias(f"__{c}") for c in _CARRIED))
    both = new.join(old, "event_uid", "left")
    resolved = (F.col("__status") == "quarantined") & (F.col("parse_status") != "quarantined")
    both = both.withColumns({
        "first_status": F.coalesce("__first_status", "parse_status"), "first_seen_ns": F.coalesce("__first_seen_ns", F.lit(now_ns)),
        "resolved_at_ns": F.coalesce("__resolved_at_ns", F.when(resolved, F.lit(now_ns))),
    }).drop("__status", *(f"__{c}" for c in _CARRIED))
    return both.unionByName(prior.join(new.select("event_uid"), "event_uid", "left_anti").select(*both.columns))


def day_of(observed_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(observed_ms), "yyyy-MM-dd")


def read_projection(spark, path: str, schema) -> DataFrame:
    """A projection table as upsert_table() keeps it; of a table that isn't there, no row."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def upsert_table(records: DataFrame, path: str, now_ns: int) -> dict[str, int]:
    """upsert() into a Parquet table by source and day of observation; returns the counts of rows written and resolved.

    An event keeps its source and its day, so only the partitions of `records` are read, and only these are written anew (dynamic
    partition overwrite); the files of all others stay. The result is written to the shared folder first, as it is made from what it replaces.
    """
    spark = records.sparkSession
    new = written(records.withColumn("day", day_of(F.col("observed_time"))), "records")
    touched: dict[str | None, list[str]] = {}
    for source, day in new.select("source_id", "day").distinct().collect():  # of one batch
        touched.setdefault(source, []).append(day)
    if not touched:
        released(new)
        return {"written": 0, "resolved": 0}
    within = F.lit(False)
    for source, days in touched.items():
        within = within | (F.col("source_id").eqNullSafe(F.lit(source)) & F.col("day").isin(days))
    schema = upsert(None, new, now_ns).schema
    prior = read_projection(spark, path, schema).filter(within) if _exists(spark, path) else None
    out = written(upsert(prior, new, now_ns), "upserted")
    out.repartition("source_id", "day", F.pmod(F.xxhash64("event_uid"), F.lit(PARTS))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id", "day").parquet(path)
    counts = new.agg(F.countDistinct("event_uid").alias("written")).join(out.agg(F.count_if(F.col("resolved_at_ns") == now_ns).alias("resolved")), F.lit(True)).first().asDict()
    released(new, out)
    return counts


def with_triage(projection: DataFrame, triage: DataFrame) -> DataFrame:
    """The projection with the last named verdict on each event; triage: event_uid, triage_status, triaged_by, triage_note, triaged_ns."""
    last = triage.groupBy("event_uid").agg(F.max_by(F.struct("triage_status", "triaged_by", "triage_note", "triaged_ns"), "triaged_ns").alias("t")).select("event_uid", "t.*")
    return projection.join(last, "event_uid", "left")


def where(p: DataFrame, source_id: str | None = None, status: str | None = None, since_ms: int | None = None, until_ms: int | None = None, search: str | None = None) -> DataFrame:
    """Filters of the projection; both time bounds are inclusive. `%` and `_` of a search are wildcards, case doesn't count."""
    tests: list[Column] = []
    tests += [F.col("source_id") == source_id] if source_id is not None else []
    tests += [F.col("parse_status") == status] if status is not None else []
    tests += [F.col("observed_time") >= since_ms] if since_ms is not None else []
    tests += [F.col("observed_time") <= until_ms] if until_ms is not None else []
    if search is not None:
        pattern = "%" + search.replace("\\", "\\\\") + "%"
        tests.append(F.col("summary").ilike(pattern) | F.col("source_id").ilike(pattern))
    for t in tests:
        p = p.filter(t)
    return p


def events(p: DataFrame, limit: int = 300, newest_first: bool = True, **filters) -> DataFrame:
    keys = ("observed_time", "event_uid")
    return where(p, **filters).orderBy(*(F.desc(k) if newest_first else F.asc(k) for k in keys)).limit(limit)


def counts_by(p: DataFrame, column: str, since_ms: int | None = None, until_ms: int | None = None, limit: int = 20) -> DataFrame:
    if column not in COUNTABLE:
        raise ValueError(f"not an aggregatable column: {column}")
    found = where(p, since_ms=since_ms, until_ms=until_ms).filter(F.col(column).isNotNull())
    return found.groupBy(F.col(column).cast("string").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(limit)


def overview_counts(p: DataFrame, columns: tuple[str, ...] = COUNTABLE[:5]) -> DataFrame:
    """Counts by each column in one pass (grouping sets): rows (`dimension`, `k`, `n`)."""
    sets = ", ".join(f"({c})" for c in columns)
    which = " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in columns)
    key = " ".join(f"WHEN grouping({c}) = 0 THEN CAST({c} AS string)" for c in columns)
    rows = p.sparkSession.sql(f"SELECT CASE {which} END AS dimension, CASE {key} END AS k, count(*) AS n FROM {{p}} GROUP BY GROUPING SETS ({sets})", p=p)
    return rows.filter("k IS NOT NULL")


def quarantine_summary(p: DataFrame) -> DataFrame:
    ever, resolved = F.count_if(F.col("first_status") == "quarantined"), F.count_if((F.col("first_status") == "quarantined") & (F.col("parse_status") != "quarantined"))
    rate = F.when(ever > 0, F.round(resolved / ever, 4)).otherwise(0.0)
    return p.agg(ever.alias("ever_quarantined"), resolved.alias("resolved"), F.count_if(F.col("parse_status") == "quarantined").alias("pending"), F.count("*").alias("total"), rate.alias("resolution_rate"))


def quarantined_sources(p: DataFrame) -> DataFrame:
    return p.filter("parse_status = 'quarantined'").groupBy("source_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_id")


def timeline(p: DataFrame, buckets: int = 40) -> DataFrame:
    """Counts by source and time bucket, long: `bucket`, `start_ms`, `source_id`, `n`; empty buckets don't appear.

    The bounds are one aggregate row joined to all rows, so the plan is one query.
    """
    bounds = p.agg(F.min("observed_time").alias("lo"), F.max("observed_time").alias("hi"))
    width = F.greatest(F.floor((F.col("hi") - F.col("lo")) / buckets), F.lit(1000))
    at = p.join(F.broadcast(bounds), F.lit(True)).withColumn("width", width).withColumn("bucket", F.floor((F.col("observed_time") - F.col("lo")) / F.col("width")))
    return at.groupBy("bucket", (F.col("lo") + F.col("bucket") * F.col("width")).alias("start_ms"), "source_id").agg(F.count("*").alias("n"))


def average_coverage(p: DataFrame) -> DataFrame:
    return p.agg(F.round(F.coalesce(F.avg("mapping_coverage"), F.lit(0.0)), 4).alias("coverage"))


def findings(p: DataFrame, min_severity: int = 3, limit: int = 500, include_triaged: bool = False) -> DataFrame:
    """The gravest events: severity, then time; those judged normal are left out."""
    p = p.filter(F.col("severity_id") >= min_severity)
    if not include_triaged and "triage_status" in p.columns:
        p = p.filter(~F.col("triage_status").eqNullSafe(F.lit("normal")))
    return p.orderBy(F.desc("severity_id"), F.desc("observed_time"), "event_uid").limit(limit)


def sample_uids(p: DataFrame, source_id: str, limit: int = 5) -> DataFrame:
    return p.filter(F.col("source_id") == source_id).orderBy(F.desc("observed_time"), F.desc("event_uid")).select("event_uid").limit(limit)


def above_mark(records: DataFrame, marks: DataFrame) -> DataFrame:
    """Records newer than their channel's high-water mark; channels without mark have all. marks: channel, last_id."""
    return records.join(marks, "channel", "left").filter(F.col("last_id").isNull() | (F.col("record_id") > F.col("last_id"))).select(*records.columns)


def new_marks(records: DataFrame) -> DataFrame:
    return records.groupBy("channel").agg(F.max("record_id").alias("last_id"))


def last_of(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
