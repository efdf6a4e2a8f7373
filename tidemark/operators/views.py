"""What a console reads of the tables: decoded rows, lists, windows, and the evidence report. One job each, no row on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.operators import store
from tidemark.operators.identity import text_of
from tidemark.plans.catalogue import CATEGORIES, NAMES, SEVERITIES, column
from tidemark.sinks import render

#: Bytes of a hex dump's line, and lines that are shown.
DUMP_BYTES, DUMP_LINES = 16, 20


def _named(table: dict[int, str], code: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), code)


def class_name(uid: Column) -> Column:
    return _named(NAMES, uid)


def category_name(uid: Column) -> Column:
    return _named(CATEGORIES, uid)


def severity_name(code: Column) -> Column:
    """The severity's name; a code without one stands as text."""
    return F.coalesce(_named(SEVERITIES, code), code.cast("string"))


def resolved(p: DataFrame) -> Column:
    """Whether an event left quarantine since it was first seen."""
    return (F.col("first_status") == "quarantined") & (F.col("parse_status") != "quarantined")


def decoded(p: DataFrame) -> DataFrame:
    """Rows of the projection with what is derived on reading: `resolved`, class, category and severity names."""
    return p.withColumns({"resolved": resolved(p), "class_name": class_name(F.col("class_uid")), "category_name": category_name(F.col("class_uid")), "severity_name": severity_name(F.col("severity_id"))})


def event_list(p: DataFrame, limit: int = 300, newest_first: bool = True, **filters) -> DataFrame:
    """The list of events that a console shows."""
    found = store.events(p, min(limit, 2000), newest_first, **filters)
    return found.select(
        "event_uid", "source_id", clock.iso_ms(F.col("observed_time")).alias("received_at"), "parse_status", "first_status", resolved(p).alias("resolved"), "class_uid", class_name(F.col("class_uid")).alias("class_name"),
        F.col("severity_id").alias("severity"), F.col("rule_name").alias("rule"), F.round("mapping_coverage", 3).alias("coverage"), F.size("warnings").alias("warnings"), "summary",
    )


def event_count(p: DataFrame, **filters) -> DataFrame:
    return store.where(p, **filters).agg(F.count("*").alias("n"))


def timeline_wide(p: DataFrame, sources: list[str] | None = None, buckets: int = 40) -> DataFrame:
    """The timeline with a column for each source (by their totals, then names), zeros filled in, and `total`; empty buckets don't appear.

    sources: those that the rows can have; without them they are counted first, and their number must fit a row.
    """
    if sources is None:
        sources = [r["source_id"] for r in p.groupBy("source_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_id").collect()]
    wide = store.timeline(p, buckets).groupBy("bucket", "start_ms").pivot("source_id", sources).agg(F.sum("n"))
    counts = [F.coalesce(F.col(f"`{s}`"), F.lit(0)) for s in sources]
    total = sum(counts[1:], counts[0]) if counts else F.lit(0).cast("long")
    return wide.select("bucket", "start_ms", *(c.alias(s) for c, s in zip(counts, sources, strict=True)), total.alias("total"))


def endpoint(p: str) -> Column:
    """`ip:port`, `ip` or nothing of a side of a record."""
    ip, port = F.col(f"{p}_ip"), F.col(f"{p}_port")
    return F.when(ip.isNull(), "").when(port.isNull(), ip).otherwise(F.concat(ip, F.lit(":"), port.cast("string")))


def log_report(p: DataFrame, count: int = 500, **filters) -> DataFrame:
    """The newest `count` rows as a console prints them, each with how many were there (`available`) and whether fewer than asked (`short`)."""
    count = max(1, count)
    rows = store.events(p, count, True, **filters).select(
        clock.ist(F.col("observed_time")).alias("time"), "source_id", F.coalesce(class_name(F.col("class_uid")), F.lit("-")).alias("class"), F.coalesce(severity_name(F.col("severity_id")), F.lit("-")).alias("severity"),
        "parse_status", endpoint("src").alias("src"), endpoint("dst").alias("dst"), "summary", "event_uid",
    )
    available = event_count(p, **filters).select(F.col("n").alias("available"))
    return rows.join(F.broadcast(available), F.lit(True)).withColumn("short", F.col("available") < count)  # the right side is one row


def hex_lines(raw: Column, most: int = DUMP_LINES) -> Column:
    """Lines of a hex dump: offset, then DUMP_BYTES bytes; what is beyond `most` lines is only counted."""
    n = F.ceil(F.octet_length(raw) / DUMP_BYTES).cast("int")
    shown = F.least(n, F.lit(most))
    at = lambda i: F.concat(F.lower(F.lpad(F.hex(i * DUMP_BYTES), 4, "0")), F.lit("   "), F.trim(F.regexp_replace(F.lower(F.hex(F.substr(raw, i * DUMP_BYTES + 1, F.lit(DUMP_BYTES)))), "(..)", "$1 ")))
    lines = F.when(shown > 0, F.transform(F.sequence(F.lit(0), F.greatest(shown, F.lit(1)) - 1), at)).otherwise(F.array().cast("array<string>"))
    more = F.when(n > most, F.array(F.concat(F.lit("... ("), (n - most).cast("string"), F.lit(" additional lines truncated for display)")))).otherwise(F.array().cast("array<string>"))
    return F.concat(lines, more)


def hex_dump(raw: Column, most: int = DUMP_LINES) -> Column:
    return F.array_join(hex_lines(raw, most), "\n")


def dossiers(raw: DataFrame, p: DataFrame, leaves: DataFrame, batches: DataFrame, vendor: str = "Tidemark", product: str = "Tidemark") -> DataFrame:
    """Raw events with their text and hex dump, their decoded projection, how they leave as CEF and LEEF, and their place in the ledger."""
    place = leaves.select("event_uid", "batch_id", "leaf_index").join(batches.select("batch_id", F.col("root").alias("batch_root")), "batch_id", "left")
    own = decoded(p).withColumns({"cef": render.cef(vendor, product), "leef": render.leef(vendor, product)})
    own = own.drop(*(c for c in raw.columns if c in own.columns and c != "event_uid"))
    return raw.withColumns({"raw_text": text_of(F.col("raw_bytes")), "hex": hex_dump(F.col("raw_bytes"))}).join(own, "event_uid", "left").join(place, "event_uid", "left")


def report_bundle(p: DataFrame, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """All counts of an evidence report in one window: rows (`section`, `k`, `n`), in one pass by grouping sets.

    Sections: total, source, class, severity, status, and coverage in ten-thousandths.
    """
    found = store.where(p, since_ms=since_ms, until_ms=until_ms).select(
        F.col("source_id").alias("source"), F.coalesce(class_name(F.col("class_uid")), F.col("class_uid").cast("string")).alias("class"), severity_name(F.col("severity_id")).alias("severity"), F.col("parse_status").alias("status"), "mapping_coverage",
    )
    names = ("source", "class", "severity", "status")
    which = " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in names)
    key = " ".join(f"WHEN grouping({c}) = 0 THEN {c}" for c in names)
    sets = ", ".join(f"({c})" for c in names)
    rows = p.sparkSession.sql(f"SELECT CASE {which} ELSE 'total' END AS section, CASE {key} ELSE '' END AS k, count(*) AS n, avg(mapping_coverage) AS c FROM {{p}} GROUP BY GROUPING SETS ({sets}, ())", p=found)
    rows = rows.filter("k IS NOT NULL")
    coverage = rows.filter("section = 'total'").select(F.lit("coverage").alias("section"), F.lit("").alias("k"), F.round(F.coalesce("c", F.lit(0.0)) * 10_000).cast("bigint").alias("n"))
    return rows.select("section", "k", "n").unionByName(coverage)


def certificate_text(certificate: DataFrame) -> Column:
    """The evidence certificate as text; certificate: report.certificate()'s row."""
    c = F.col
    day = lambda ns: clock.ist_utc(F.floor(ns / 1_000_000).cast("bigint"))
    verdict = F.when(c("intact"), "INTACT").otherwise(F.concat(F.lit("FAILED at batch "), c("first_bad.batch_id").cast("string"), F.lit(": "), c("first_bad.reason")))
    lines = [
        F.lit("CERTIFICATE OF INTEGRITY"), F.concat(F.lit("Period: "), day(c("from_ns")), F.lit(" to "), day(c("until_ns"))), F.concat(F.lit("Batches: "), c("batch_count").cast("string"), F.lit(", events: "), c("event_count").cast("string")),
        F.concat(F.lit("Chain head: "), c("chain_head")), F.concat(F.lit("Verification: "), verdict), F.concat(F.lit("Sources: "), F.array_join("sources", ", ")),
        F.concat(F.lit("Checkpoints: "), F.coalesce(c("checkpoints"), F.lit(0)).cast("string") if "checkpoints" in certificate.columns else F.lit("0")),
    ]
    return F.concat_ws("\n", *lines)


def field_list(record: Column, names: list[str]) -> Column:
    """The set fields of a record as `name=text`, in order of their names."""
    return F.array_compact(F.array(*(F.when(record[column(n)].isNotNull(), F.concat(F.lit(f"{n}="), record[column(n)].cast("string"))) for n in sorted(names))))
