"""Raw capture: immutable, hash-identified rows of bytes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Transports, and the size from which a UDP payload counts as truncated.
TRANSPORTS = ("tcp", "udp", "relp", "tls", "file", "test")
UDP_LIMIT = 1024


def div(c: Column, by: int) -> Column:
    """Integer division; nanoseconds don't fit a double."""
    return F.call_function("div", c, F.lit(by))


def raw_hash(raw: Column) -> Column:
    return F.sha2(raw, 256)


def idem_key(raw: Column, source_id: Column, received_at_ns: Column) -> Column:
    """SHA-256 over bytes, a zero byte, the source with its 32-bit length, and the 64-bit receipt time."""
    fixed = lambda c, n: F.unhex(F.lpad(F.hex(c), n, "0"))
    source = source_id.cast("binary")
    return F.sha2(F.concat(raw, F.unhex(F.lit("00")), fixed(F.octet_length(source), 8), source, fixed(received_at_ns, 16)), 256)


def event_uid(received_at_ns: Column, key: Column) -> Column:
    """A version 7 UUID whose random bits come from the idempotency key, so a retry names an event alike."""
    ms = F.lower(F.lpad(F.hex(div(received_at_ns, 1_000_000)), 12, "0"))
    variant = F.substr(F.lit("89ab"), (F.conv(F.substring(key, 4, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.substring(key, 1, 3), F.lit("-"), variant, F.substring(key, 5, 3), F.lit("-"), F.substring(key, 8, 12))


def uid_ms(uid: Column) -> Column:
    """The receipt time in a version 7 UUID."""
    return F.conv(F.substring(F.replace(uid, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("bigint")


def received_iso(ns: Column) -> Column:
    at = F.timestamp_seconds(div(ns, 1_000_000_000))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(F.pmod(ns, F.lit(1_000_000_000)).cast("string"), 9, "0"), F.lit("Z"))


def text_of(raw: Column) -> Column:
    """The bytes as text; invalid sequences become replacement characters."""
    return F.make_valid_utf8(raw.cast("string"))


def capture(df: DataFrame, source_id: str | Column, received_at_ns: Column, raw_col: str = "raw_bytes", transport: str = "test", source_ip: str | None = None, charset: str = "unknown") -> DataFrame:
    """Rows of bytes as raw events. Text columns are refused: what arrives is never decoded."""
    if df.schema[raw_col].dataType.simpleString() != "binary":
        raise TypeError(f"{raw_col} must be binary")
    if transport not in TRANSPORTS:
        raise ValueError(f"transport must be one of {', '.join(TRANSPORTS)}")
    if isinstance(source_id, str) and not source_id:
        raise ValueError("a source_id is needed")
    source, raw = (F.lit(source_id) if isinstance(source_id, str) else source_id), F.col(raw_col)
    length = F.octet_length(raw).cast("bigint")
    out = df.select(raw.alias("raw_bytes"), raw_hash(raw).alias("raw_hash"), source.alias("source_id"), F.lit(source_ip).cast("string").alias("source_ip"), F.lit(transport).alias("transport"), received_at_ns.cast("bigint").alias("received_at_ns"), length.alias("byte_len"), F.lit(charset).alias("charset"), ((F.lit(transport) == "udp") & (length >= UDP_LIMIT)).alias("truncated"))
    out = out.withColumn("idem_key", idem_key(F.col("raw_bytes"), F.col("source_id"), F.col("received_at_ns")))
    return out.withColumn("event_uid", event_uid(F.col("received_at_ns"), F.col("idem_key")))


def intact(raw: Column, known_hash: Column) -> Column:
    return raw_hash(raw) == known_hash
