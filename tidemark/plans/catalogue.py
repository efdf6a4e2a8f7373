"""The target schema: four OCSF 1.5.0 classes with closed field lists, and one struct for all of them."""

from __future__ import annotations

from pyspark.sql import types as T

OCSF_VERSION = "1.5.0"
# Field names and types of the classes; only `time` is required.
BASE = {
    "time": "timestamp", "observed_time": "timestamp", "severity_id": "integer", "status_id": "integer", "activity_id": "integer",
    "message": "string", "metadata.product.name": "string", "metadata.product.vendor_name": "string", "metadata.log_name": "string",
}
ENDPOINTS = {f"{side}_endpoint.{part}": kind for side in ("src", "dst") for part, kind in (("ip", "ip"), ("port", "port"), ("hostname", "hostname"), ("mac", "mac"))}
USER = {"user.name": "string", "user.uid": "string", "user.domain": "string", "user.email_addr": "email"}
EXTRA = {
    4001: {
        "connection_info.protocol_num": "integer", "connection_info.direction_id": "integer", "connection_info.boundary_id": "integer",
        "traffic.bytes": "long", "traffic.bytes_in": "long", "traffic.bytes_out": "long", "traffic.packets": "long", "duration": "long", "disposition_id": "integer",
    },
    4002: {
        "http_request.url.text": "url", "http_request.url.path": "string", "http_request.http_method": "string", "http_request.user_agent": "string",
        "http_request.referrer": "string", "http_response.code": "integer", "http_response.length": "long", "duration": "long", "traffic.bytes": "long",
        "disposition_id": "integer", "user.name": "string", "user.uid": "string",
    },
    3002: {**USER, "auth_protocol_id": "integer", "logon_type_id": "integer", "is_mfa": "boolean", "session.uid": "string"},
    2004: {
        "finding_info.title": "string", "finding_info.uid": "string", "finding_info.desc": "string", "risk_level_id": "integer",
        "confidence_id": "integer", "impact_id": "integer", "malware.name": "string", **USER,
    },
}
NAMES = {4001: "Network Activity", 4002: "HTTP Activity", 3002: "Authentication", 2004: "Detection Finding"}
CATEGORIES = {4001: "Network Activity", 4002: "Network Activity", 3002: "Identity & Access Management", 2004: "Findings"}
SEVERITIES = {0: "Unknown", 1: "Informational", 2: "Low", 3: "Medium", 4: "High", 5: "Critical", 6: "Fatal"}

CLASSES = {uid: {**BASE, **ENDPOINTS, **extra} for uid, extra in EXTRA.items()}
#: All fields of all classes; a name has one type in every class.
FIELDS = {name: kind for fields in CLASSES.values() for name, kind in fields.items()}
_SPARK = {"integer": T.IntegerType(), "long": T.LongType(), "timestamp": T.LongType(), "port": T.IntegerType(), "boolean": T.BooleanType(), "float": T.DoubleType()}


def column(name: str) -> str:
    """The physical column of a field."""
    return name.replace(".", "_")


def spark_type(kind: str) -> T.DataType:
    return _SPARK.get(kind, T.StringType())


def required(uid: int) -> tuple[str, ...]:
    return tuple(n for n in CLASSES[uid] if n == "time")


def fields_struct() -> T.StructType:
    return T.StructType([T.StructField(column(n), spark_type(k)) for n, k in FIELDS.items()])
