"""Raw events to typed records: mappings compiled to column expressions, with validation, status and coverage.

Each source's rows get one plan with its rules as CASE branches; sources are united.
Constant parts (hashes, versions) are literals, and a source's plan only sees its rows
(a pushed-down filter). No Python runs but for XML bodies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.binding import built
from tidemark.operators.frames import STRATEGIES, format_of, with_body
from tidemark.operators.identity import div, text_of
from tidemark.operators.parsers import cell, cells, cells_error, group_index, java_regex, parse
from tidemark.plans.catalogue import CLASSES, FIELDS, column, spark_type
from tidemark.plans.mapping import Condition, Mapping, Ref, Registry, Spec

WELL_KNOWN_MAX, EPHEMERAL_MIN, DRIFT_MS = 1023, 49152, 3_600_000
NO_TIME = "no event time in the record: the receipt time stands in"
RECORD = ("event_uid", "raw_hash", "source_id", "observed_time", "parse_status", "class_uid", "mapping_id", "mapping_version", "mapping_hash", "rule_name", "mapping_coverage", "fields", "unmapped", "errors", "warnings", "notes")
_STRINGS = "array<string>"
_PLACES = {n: i for i, n in enumerate(FIELDS)}
#: What _semantic() looks at.
_CHECKED = ("src_endpoint.ip", "dst_endpoint.ip", "src_endpoint.port", "dst_endpoint.port", "traffic.bytes", "traffic.bytes_in", "traffic.bytes_out", "time", "observed_time")


def _resolve(ref: Ref) -> Column:
    """A reference's text in a row with `body`, `cells` and `named`."""
    if ref.kind == "literal":
        return F.lit(None if ref.value is None else str(ref.value)).cast("string")
    if ref.kind == "positional":
        return F.nullif(cell(F.col("cells"), ref.value), F.lit(""))
    return F.col("body") if ref.value == "_raw" else F.try_element_at(F.col("named"), F.lit(ref.value))


def predicate(c: Condition) -> Column:
    value = _resolve(c.ref)
    text = str(c.value)
    if c.op == "exists":
        return value.isNotNull() if c.value else value.isNull()
    test = {
        "equals": lambda: value == text, "not_equals": lambda: value != text, "contains": lambda: value.contains(text), "startswith": lambda: value.startswith(text),
        "regex": lambda: value.rlike(java_regex(text)), "in": lambda: value.isin(*map(str, c.value)),
    }[c.op]()
    return F.coalesce(test, F.lit(False))


def _given(spec: Spec) -> Column:
    """What a spec refers to, before its transform."""
    value = _resolve(spec.ref)
    if spec.regex:
        pattern, group = java_regex(spec.regex), group_index(spec.regex, spec.group)
        # no match, and an unmatched optional group, are no value
        value = F.when(value.rlike(pattern), F.nullif(F.regexp_extract(value, pattern, group), F.lit("")))
    return value


def _transformed(spec: Spec, value: Column) -> Column:
    if spec.transform is None:
        return value
    return S.TRANSFORMS[spec.transform](value) if spec.transform in S.TRANSFORMS else S.TIMED_TRANSFORMS[spec.transform](value, F.col("observed_time"))


def _text(spec: Spec, value: Column) -> Column:
    """A field's text: the transformed value through the spec's lookup, or its default."""
    default = F.lit(None if spec.default is None else str(spec.default)).cast("string")
    if spec.lookup:
        value = F.when(value.isNotNull(), S.lookup(spec.lookup, value, default))
    return F.coalesce(value, default)


def _case(rules: list[tuple[int, Column]]) -> Column:
    return reduce(lambda c, x: c.when(F.col("rule_at") == x[0], x[1]), rules, F)


def _by_spec(m: Mapping, target: str) -> list[tuple[Spec, Column]]:
    """The distinct specs of a target, each with whether the row's rule has it."""
    rules: list[tuple[Spec, list[int]]] = []
    for i, r in enumerate(m.rules):
        if spec := r.fields.get(target):
            known = next((at for s, at in rules if s == spec), None)
            known.append(i) if known else rules.append((spec, [i]))
    return [(s, F.col("rule_at").isin(*at)) for s, at in rules]


def _semantic(f: dict[str, Column]) -> Column:
    """Warnings about records whose shape suggests a wrong mapping; the addresses' numbers are columns."""
    src, dst, sport, dport = (f[f"{s}_endpoint.{p}"] for p in ("ip", "port") for s in ("src", "dst"))
    total, parts = f["traffic.bytes"], f["traffic.bytes_in"] + f["traffic.bytes_out"]
    drift = f["time"] - f["observed_time"]
    say = lambda test, *text: F.when(test, F.concat(*(t if isinstance(t, Column) else F.lit(t) for t in text)))
    return F.array_compact(F.array(
        say(src == dst, "same_endpoint: ", src),
        say((sport <= WELL_KNOWN_MAX) & (dport >= EPHEMERAL_MIN), "swapped_ports: ", sport.cast("string"), " ", dport.cast("string")),
        say(S.is_global(src, F.col("__src_number")) & S.is_global(dst, F.col("__dst_number")), "both_global: ", src, " ", dst),
        say(parts > total, "byte_sum: ", parts.cast("string"), " over ", total.cast("string")),
        say(F.abs(drift) > DRIFT_MS, "clock_drift: ", F.format_string("%+.1fh", drift / 3_600_000.0)),
    ))


def _parsed(raw: DataFrame, m: Mapping) -> DataFrame:
    """`body`, `cells`, `named` and `error` of a mapping's events."""
    df = with_body(raw.withColumn("__text", text_of(F.col("raw_bytes"))), "__text")
    if m.format in ("csv", "tsv", "ssv"):
        return df.withColumns({"cells": cells(m.format, F.col("body")), "named": F.create_map().cast("map<string,string>"), "error": cells_error(m.format, F.col("body"))})
    names = [r.value for r in m.refs() if r.kind == "named" and r.value != "_raw"]
    df = df.withColumn("parsed", parse(m.format, F.col("body"), names))
    return df.withColumns({"cells": F.col("parsed.positional"), "named": F.col("parsed.named"), "error": F.col("parsed.error")})


def _source(raw: DataFrame, m: Mapping, now_ms: int | None) -> DataFrame:
    """The records of one mapping's events.

    Values go through plain columns, one step after the other: what is used several times is a column of its own, which Catalyst doesn't
    copy into its uses, and columns that nobody reads are pruned with all their steps. Structs are made of columns alone, so reading one of
    their fields prunes the others.
    """
    df = _parsed(raw, m)
    chosen = F.coalesce(*(F.when(predicate(r.match) if r.match else F.lit(True), F.lit(i)) for i, r in enumerate(m.rules)), F.lit(-1))
    df = df.withColumn("rule_at", F.when(F.col("error").isNull(), chosen).otherwise(-2))
    targets = list(dict.fromkeys(t for r in m.rules for t in r.fields))
    specs = {t: _by_spec(m, t) for t in targets}
    at = {t: _PLACES[t] for t in targets}  # the same in all mappings, so that their expressions are
    kept = ["event_uid", "raw_hash", "source_id", "observed_time", "error", "rule_at"]
    steps: dict[str, Column] = {}  # of specs that transform: what they are given, by target and place
    for t in targets:
        steps |= {f"b{at[t]}_{k}": F.when(own, _given(s)) for k, (s, own) in enumerate(specs[t]) if s.transform}
    df = df.withColumns(steps) if steps else df
    done = {f"d{at[t]}_{k}": built((s.transform, f"b{at[t]}_{k}"), lambda s=s, name=f"b{at[t]}_{k}": _transformed(s, F.col(name))) for t in targets for k, (s, _) in enumerate(specs[t]) if s.transform}
    df = df.withColumns(done) if done else df
    texts, failed, constant = {}, [], {}
    for t in targets:
        values = [(own, s, F.col(f"d{at[t]}_{k}") if s.transform else _given(s)) for k, (s, own) in enumerate(specs[t])]
        texts[f"x{at[t]}"] = reduce(lambda c, v: c.when(v[0], _text(v[1], v[2])), values, F)
        failed += [F.when(F.col(f"b{at[t]}_{k}").isNotNull() & F.col(f"d{at[t]}_{k}").isNull(), F.lit(f"{t}: {s.transform} failed")) for k, (s, _) in enumerate(specs[t]) if s.transform]
        if all(s.ref.kind == "literal" and not s.transform and not s.regex for s, _ in specs[t]):
            constant[t] = values  # folded by Catalyst, whatever its kind
    df = df.select(*kept, *(c.alias(n) for n, c in texts.items()), (F.array_compact(F.array(*failed)) if failed else F.array().cast(_STRINGS)).alias("failed"))
    given = {t: F.col(f"x{at[t]}") for t in targets}
    coercions = {t: S.coercion(FIELDS[t], now_ms) for t in targets if t != "observed_time" and t not in constant}
    for step in range(max(map(len, coercions.values()), default=0)):
        of = {t: f"x{at[t]}" if step == 0 else f"t{at[t]}" for t, f in coercions.items() if len(f) > step}
        df = df.withColumns({f"t{at[t]}": built((FIELDS[t], now_ms, step, name), lambda t=t, name=name, step=step: coercions[t][step](F.col(name))) for t, name in of.items()})
    fixed = {f"t{at[t]}": reduce(lambda c, v, t=t: c.when(v[0], S.coerce(_text(v[1], v[2]), FIELDS[t], now_ms)), values, F) for t, values in constant.items() if t != "observed_time"}
    df = df.withColumns(fixed) if fixed else df
    typed = {t: F.col(f"t{at[t]}") for t in targets if t != "observed_time"}
    matched = F.col("rule_at") >= 0
    plausible = F.col("observed_time") >= S.LEAST_MS
    plausible = plausible if now_ms is None else plausible & (F.col("observed_time") <= now_ms + S.SKEW_MS)
    no_time = matched & (given["time"].isNull() if "time" in given else F.lit(True))
    out = {f"o{at[t]}": F.when(matched, c) for t, c in typed.items()} | {"o_observed": F.when(matched & plausible, F.col("observed_time"))}
    df = df.withColumns(out | {"o_time": F.when(no_time, F.when(plausible, F.col("observed_time"))).otherwise(F.when(matched, typed["time"]) if "time" in typed else F.lit(None).cast("bigint"))})
    names = {n: f"o{at[n]}" for n in typed} | {"time": "o_time", "observed_time": "o_observed"}
    fields = {n: F.col(names[n]) if n in names else built(("null", spark_type(k)), lambda k=k: F.lit(None).cast(spark_type(k))) for n, k in FIELDS.items()}
    df = df.withColumns({f"__{e}_number": S.ipv4_number(fields[f"{e}_endpoint.ip"]) for e in ("src", "dst")})
    wrong = F.array_compact(F.array(*(F.when(given[t].isNotNull() & typed[t].isNull(), F.lit(f"{t}: not a valid {FIELDS[t]}")) for t in typed)))
    missing = F.when(matched & fields["time"].isNull(), F.lit("time: required"))
    clock = F.when(~plausible, F.lit("observed_time: not a valid timestamp"))
    empty = F.array().cast(_STRINGS)
    df = df.withColumn("errors", F.when(matched, F.array_compact(F.concat(wrong, F.array(clock, missing)))).otherwise(empty))
    nothing = reduce(lambda a, n: a & fields[n].isNull(), dict.fromkeys([*typed, "time", "observed_time"]), F.lit(True))
    warnings = F.when(matched, F.concat(F.col("failed"), built(("semantic", *(names.get(n) for n in _CHECKED)), lambda: _semantic(fields)))).when(F.col("rule_at") == -1, F.array(F.lit(f"no rule in {m.source} matched this event"))).otherwise(F.array(F.concat(F.lit("parse failed: "), F.col("error"))))
    return df.select(
        "event_uid", "raw_hash", "source_id", "observed_time",
        F.when(~matched | ((F.size("errors") > 0) & nothing), "quarantined").when(F.size("errors") > 0, "partial").otherwise("full").alias("parse_status"),
        _case([(i, F.lit(r.ocsf_class)) for i, r in enumerate(m.rules)]).cast("int").alias("class_uid"),
        F.lit(m.source).alias("mapping_id"), F.lit(m.version).alias("mapping_version"), F.when(matched, F.lit(m.content_hash())).alias("mapping_hash"),
        _case([(i, F.lit(r.name)) for i, r in enumerate(m.rules)]).alias("rule_name"),
        F.when(matched, 1.0).otherwise(0.0).alias("mapping_coverage"),
        F.struct(*(c.alias(column(n)) for n, c in fields.items())).alias("fields"), F.create_map().cast("map<string,string>").alias("unmapped"), "errors", warnings.alias("warnings"),
        F.when(no_time, F.array(F.lit(NO_TIME))).otherwise(empty).alias("notes"),
    )


def _unknown(raw: DataFrame) -> DataFrame:
    """Events of sources without a mapping: quarantined, with what their format seems to be."""
    df = with_body(raw.withColumn("__text", text_of(F.col("raw_bytes"))), "__text").withColumn("__format", format_of(F.col("body")))
    strategy = F.create_map(*(F.lit(x) for kv in STRATEGIES.items() for x in kv))[F.col("__format")]
    none = F.struct(*(F.lit(None).cast(spark_type(k)).alias(column(n)) for n, k in FIELDS.items()))
    empty = F.array().cast(_STRINGS)
    return df.select(
        "event_uid", "raw_hash", "source_id", "observed_time", F.lit("quarantined").alias("parse_status"), F.lit(None).cast("int").alias("class_uid"),
        F.lit(None).cast("string").alias("mapping_id"), F.lit(None).cast("int").alias("mapping_version"), F.lit(None).cast("string").alias("mapping_hash"),
        F.lit(None).cast("string").alias("rule_name"), F.lit(0.0).alias("mapping_coverage"), none.alias("fields"), F.create_map().cast("map<string,string>").alias("unmapped"),
        empty.alias("errors"), F.array(F.concat(F.lit("no mapping for source "), F.col("source_id"), F.lit("; detected "), F.col("__format"), F.lit(", strategy "), strategy)).alias("warnings"), empty.alias("notes"),
    )


def normalize(raw: DataFrame, registry: Registry, now_ms: int | None = None, sources: list[str] | None = None) -> DataFrame:
    """Records of raw events (event_uid, raw_hash, source_id, raw_bytes, received_at_ns).

    sources: the sources that the rows can have, if known; their plans only are built.
    now_ms: the clock against which event times are plausible; without it they have no upper bound.
    """
    raw = raw.withColumn("observed_time", div(F.col("received_at_ns"), 1_000_000))
    known = {s: m for s, m in registry.mappings().items() if sources is None or s in sources}
    parts = [_source(raw.filter(F.col("source_id") == s), m, now_ms) for s, m in sorted(known.items())]
    if sources is None or set(sources) - set(known):
        rest = raw.filter(~F.col("source_id").isin(*known)) if known else raw
        parts.append(_unknown(rest))
    return reduce(DataFrame.unionByName, parts)


def summary(fields: Column) -> Column:
    """One line about a record: its title, request or endpoints."""
    text = lambda n: F.nullif(fields[column(n)], F.lit(""))
    port = F.when(fields["dst_endpoint_port"] > 0, F.concat(F.lit(":"), fields["dst_endpoint_port"].cast("string"))).otherwise("")
    request = F.when(text("http_request.url.text").isNotNull(), F.trim(F.concat(F.coalesce(text("http_request.http_method"), F.lit("")), F.lit(" "), text("http_request.url.text"))))
    ends = F.when(text("src_endpoint.ip").isNotNull() & text("dst_endpoint.ip").isNotNull(), F.concat(text("src_endpoint.ip"), F.lit(" -> "), text("dst_endpoint.ip"), port))
    return F.coalesce(text("finding_info.title"), request, ends, F.lit("unparsed - awaiting a mapping"))


__all__ = ["normalize", "predicate", "summary", "CLASSES"]
