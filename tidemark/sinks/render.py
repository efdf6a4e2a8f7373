"""Renderers of records to CEF, LEEF and JSON, and partitioned exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lineage import written
from tidemark.plans.catalogue import FIELDS, NAMES, column

#: OCSF severities on the CEF scale.
CEF_SEVERITY = {0: 0, 1: 2, 2: 3, 3: 5, 4: 7, 5: 9, 6: 10}


def header_escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"([\\|])", r"\\$1"), r"\r\n|[\r\n]", " ")


def extension_escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"([\\=])", r"\\$1"), r"\n", r"\\n"), r"\r", "")


def _map(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(default))


def _pair(key: str, value: Column, escape: Callable[[Column], Column]) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{key}="), escape(value.cast("string"))))


def _field(name: str) -> Column:
    return F.col("fields")[column(name)]


def cef(vendor: str = "Tidemark", product: str = "Tidemark") -> Column:
    severity = _map(CEF_SEVERITY, F.coalesce(_field("severity_id"), F.lit(0)), 0)
    head = F.concat_ws("|", *(header_escape(c) for c in (F.lit("CEF:0"), F.lit(vendor), F.lit(product), F.coalesce("mapping_version", F.lit(0)).cast("string"), F.coalesce("class_uid", F.lit(0)).cast("string"), _map(NAMES, F.coalesce("class_uid", F.lit(0)), "Unmapped"), severity.cast("string"))))
    values = {"src": _field("src_endpoint.ip"), "dst": _field("dst_endpoint.ip"), "spt": _field("src_endpoint.port"), "dpt": _field("dst_endpoint.port"), "rt": _field("time"), "in": _field("traffic.bytes_in"), "out": _field("traffic.bytes_out"), "msg": F.coalesce(F.nullif(_field("message"), F.lit("")), _field("finding_info.title")), "cs1": F.col("event_uid"), "cs1Label": F.lit("eventUid"), "cs2": F.col("raw_hash"), "cs2Label": F.lit("rawHash"), "cs3": F.col("mapping_id"), "cs3Label": F.lit("mappingId")}
    return F.concat(head, F.lit("|"), F.concat_ws(" ", *(_pair(k, v, extension_escape) for k, v in values.items())))


def leef(vendor: str = "Tidemark", product: str = "Tidemark") -> Column:
    head = F.concat_ws("|", *(header_escape(c) for c in (F.lit("LEEF:2.0"), F.lit(vendor), F.lit(product), F.coalesce("mapping_version", F.lit(0)).cast("string"), F.coalesce("class_uid", F.lit(0)).cast("string"))))
    values = {"devTime": _field("time"), "src": _field("src_endpoint.ip"), "dst": _field("dst_endpoint.ip"), "srcPort": _field("src_endpoint.port"), "dstPort": _field("dst_endpoint.port"), "sev": _field("severity_id"), "eventUid": F.col("event_uid"), "rawHash": F.col("raw_hash"), "mappingId": F.col("mapping_id")}
    return F.concat(head, F.lit("|"), F.concat_ws("\t", *(_pair(k, v, lambda c: F.replace(c, F.lit("\t"), F.lit(" "))) for k, v in values.items())))


LINEAGE = ("class_uid", "event_uid", "mapping_hash", "mapping_id", "mapping_version", "observed_time", "parse_status", "raw_hash", "rule_name", "source_id")


def flat() -> list[Column]:
    """A record's lineage columns and its fields, under their dotted names."""
    return [F.col(c) for c in LINEAGE] + [F.round("mapping_coverage", 4).alias("mapping_coverage")] + [_field(n).alias(n) for n in sorted(FIELDS) if n != "observed_time"]


def _merged(*parts: Column) -> Column:
    """JSON objects without common keys as one, its keys in order."""
    inner = lambda p: F.substr(p, F.lit(2), F.length(p) - 2)
    return F.to_json(F.parse_json(F.concat(F.lit("{"), F.concat_ws(",", *(F.nullif(inner(p), F.lit("")) for p in parts)), F.lit("}"))))


def ocsf_json(pretty: bool = False) -> Column:
    """A record as JSON, keys in order: lineage is always there (null or not), fields and `unmapped` only if they are set."""
    lineage = F.to_json(F.struct(*(F.col(c) for c in LINEAGE), F.round("mapping_coverage", 4).cast("decimal(5,4)").alias("mapping_coverage")), {"ignoreNullFields": "false"})
    fields = F.to_json(F.struct(*(_field(n).alias(n) for n in sorted(FIELDS) if n != "observed_time")))
    unmapped = F.when(F.size("unmapped") > 0, F.to_json(F.struct(F.col("unmapped").alias("unmapped")))).otherwise("{}")
    whole = _merged(lineage, fields, unmapped)
    if not pretty:
        return whole
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, r'([{,])("(?:[^"\\\\]|\\\\.)*":)', "$1\n  $2 "), r"\}$", "\n}"), r"^\{\n\}$", "{}")


ADAPTERS: dict[str, Callable[[], Column]] = {"ocsf-json": ocsf_json, "jsonl": ocsf_json, "cef": cef, "leef": leef}


def adapter(name: str, **options: str) -> Column:
    if name.lower() not in ADAPTERS:
        raise KeyError(f"unknown adapter {name!r}; known: {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[name.lower()](**options)


def partition_columns() -> dict[str, Column]:
    """The lake layout: UTC date of receipt, and class (0 if none)."""
    return {"date": F.date_format(F.timestamp_millis("observed_time"), "yyyy-MM-dd"), "class": F.coalesce("class_uid", F.lit(0))}


def export(records: DataFrame, root: str, fmt: str = "parquet", mode: str = "append") -> dict[str, int]:
    """Adds records to a lake by date and class; returns the rows written to each partition."""
    rows = written(records.withColumns(partition_columns()), "export")
    rows.write.mode(mode).partitionBy("date", "class").format(fmt).save(root)
    return {f"date={r['date']}/class={r['class']}": r["n"] for r in rows.groupBy("date", "class").agg(F.count("*").alias("n")).collect()}  # a row for each partition


def export_ndjson(records: DataFrame, path: str) -> int:
    """Writes records as lines of JSON; returns how many there were."""
    rows = written(records.select(ocsf_json().alias("value")), "ndjson")
    rows.write.mode("error").text(path)
    return rows.count()


def partition_counts(records: DataFrame) -> DataFrame:
    at = partition_columns()
    return records.groupBy(F.concat(F.lit("date="), at["date"], F.lit("/class="), at["class"].cast("string")).alias("partition")).agg(F.count("*").alias("n"))
