"""Parsers of log bodies: a body column to a struct of positional cells, named values and an error.

`parse` is told which names are referred to, so JSON and XML paths become direct lookups
and nothing else is flattened. Everything but XML is a Catalyst expression; XML takes
one Arrow function that never raises.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.binding import let

FORMATS = ("csv", "ssv", "tsv", "json", "xml", "kv", "key_value", "cef", "leef", "raw")
_KV = r'([A-Za-z_][\w.\-]*)=("([^"]*)"|\S*)'
_STRINGS = "array<string>"
_WS = " \t\n\r\x0b\x0c"


def _empty() -> Column:
    return F.array().cast(_STRINGS)


def _strip(c: Column) -> Column:
    return F.trim(c, F.lit(_WS))


def first_csv_record(body: Column) -> Column:
    """Cells of the first record; doubled quotes within quotes stand for one. A body without quotes is split plainly."""
    plain = F.split(F.regexp_extract(body, r"^[^\r\n]*", 0), ",")
    line = F.concat(F.regexp_extract(body, r'^((?:"(?:[^"]|"")*"|[^\r\n])*)', 1), F.lit(","))
    cells = F.regexp_extract_all(line, F.lit(r'((?:"(?:[^"]|"")*")?[^,]*),'), F.lit(1))
    unquote = lambda c: F.when(c.startswith('"'), F.regexp_replace(F.regexp_replace(c, r'^"((?:[^"]|"")*)"', "$1"), '""', '"')).otherwise(c)
    return F.when(body.contains('"'), F.transform(cells, unquote)).otherwise(plain)


def kv_pairs(text: Column) -> Column:
    """All key=value pairs in order: array of (key, value)."""
    def pair(found: Column) -> Column:
        at = F.instr(found, "=")
        value = F.substr(found, at + 1, F.length(found))
        closed = value.endswith('"') & (F.length(value) > 1)
        bare = F.when(~value.startswith('"'), value).when(closed, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise("")
        return F.struct(F.substr(found, F.lit(1), at - 1).alias("key"), bare.alias("value"))

    return F.transform(F.regexp_extract_all(text, F.lit(f"(?U){_KV}"), F.lit(0)), pair)


def last_value(pairs: Column, key: str) -> Column:
    return F.get(F.filter(pairs, lambda p: p["key"] == key), F.size(F.filter(pairs, lambda p: p["key"] == key)) - 1)["value"]


def pairs_map(pairs: Column) -> Column:
    """The pairs as a map; the last of equal keys counts."""
    def of(found: Column) -> Column:
        keys = F.array_distinct(F.transform(found, lambda p: p["key"]))
        return F.map_from_entries(F.transform(keys, lambda k: F.element_at(F.filter(found, lambda p: p["key"] == k), -1)))

    return let(pairs, of)


def split_escaped(text: Column) -> Column:
    """Segments between unescaped pipes, without their escapes."""
    whole = F.concat(F.regexp_replace(text, r"(?s)((?:^|[^\\])(?:\\\\)*)\\$", "$1"), F.lit("|"))
    parts = F.regexp_extract_all(whole, F.lit(r"(?s)((?:\\.|[^|\\])*)\|"), F.lit(1))
    return F.transform(parts, lambda x: F.regexp_replace(x, r"(?s)\\(.)", "$1"))


def _json_path(ref: str) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in ref.split("."))


def _json_value(v: Column, ref: str) -> Column:
    def text(path: str) -> Column:
        # booleans as they are written in rule files: True and False
        at = F.try_variant_get(v, path, "string")
        return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BOOLEAN", F.initcap(at)).otherwise(at)

    literal = text("$['" + ref.replace("'", "\\'") + "']")
    return F.coalesce(literal, text(_json_path(ref))) if "." in ref else literal


def xml_values(body: str | None) -> dict[str, str] | None:
    """All addressable values of a document: paths without namespaces, @attributes, repeated elements by place and Name; null if it isn't XML."""
    try:
        root = ET.fromstring(body or "")
    except (ET.ParseError, ValueError):
        return None
    out: dict[str, str] = {}

    def visit(node: ET.Element, path: str) -> None:
        for k, v in node.attrib.items():
            out.setdefault(f"{path}.@{_local(k)}" if path else f"@{_local(k)}", v)
        if path and node.text and node.text.strip():
            out.setdefault(path, node.text.strip())
        groups: dict[str, list[ET.Element]] = {}
        for child in node:
            groups.setdefault(_local(child.tag), []).append(child)
        for tag, nodes in groups.items():
            base = f"{path}.{tag}" if path else tag
            for i, child in enumerate(nodes):
                if len(nodes) > 1:
                    visit(child, f"{base}.{i}")
                    if name := child.attrib.get("Name"):
                        visit(child, f"{base}.{name}")
                visit(child, base)

    visit(root, "")
    return out


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def xml_map(bodies: pd.Series) -> pd.Series:
    return bodies.map(xml_values)


def parse(fmt: str, body: Column, names: Iterable[str] = ()) -> Column:
    """struct(positional, named, error). names: what mappings refer to by name."""
    names = list(dict.fromkeys(names))
    none = F.create_map().cast("map<string,string>")

    def out(positional: Column, named: Column, error: Column) -> Column:
        return F.struct(positional.alias("positional"), named.alias("named"), error.cast("string").alias("error"))

    def chosen(value) -> Column:
        return F.create_map(*(x for n in names for x in (F.lit(n), value(n)))) if names else none

    if fmt == "csv":
        return out(F.transform(first_csv_record(body), _strip), none, F.when(_strip(body) == "", "no csv record"))
    if fmt == "ssv":
        return out(F.split(_strip(body), r"\s+"), none, F.when(_strip(body) == "", "empty body"))
    if fmt == "tsv":
        return out(F.transform(F.split(body, "\t"), _strip), none, F.lit(None))
    if fmt == "json":
        def of(v: Column) -> Column:
            is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
            return out(_empty(), F.when(is_object, chosen(lambda n: _json_value(v, n))), F.when(~is_object, "not a json object"))

        return let(F.try_parse_json(body), of)
    if fmt == "xml":
        return let(xml_map(body), lambda found: out(_empty(), found, F.when(found.isNull(), "not well-formed xml")))
    if fmt in ("kv", "key_value"):
        return let(kv_pairs(body), lambda pairs: out(_empty(), chosen(lambda n: last_value(pairs, n)) if names else pairs_map(pairs), F.when(F.size(pairs) == 0, "no key=value pairs found")))
    if fmt in ("cef", "leef"):
        return _spec(fmt, body, out)
    if fmt == "raw":
        return out(F.array(body), none, F.when(_strip(body) == "", "empty body"))
    raise ValueError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")


def cells(fmt: str, body: Column) -> Column:
    """The cells of csv, tsv and ssv bodies; white space around a cell is left to cell()."""
    return {"csv": lambda: first_csv_record(body), "tsv": lambda: F.split(body, "\t"), "ssv": lambda: F.split(_strip(body), r"\s+")}[fmt]()


def cell(cells: Column, place: int) -> Column:
    return _strip(F.get(cells, F.lit(place - 1)))


def cells_error(fmt: str, body: Column) -> Column:
    reason = {"csv": "no csv record", "ssv": "empty body", "tsv": None}[fmt]
    return F.when(_strip(body) == "", F.lit(reason).cast("string"))


def _spec(fmt: str, body: Column, out) -> Column:
    mark, least = fmt.upper() + ":", 8 if fmt == "cef" else 6
    start = F.instr(body, mark)

    def of(parts: Column) -> Column:
        head = F.concat(F.array(F.regexp_replace(F.get(parts, F.lit(0)), f"^{mark}", "")), F.slice(parts, 2, least - 2))
        bad = F.when(start == 0, f"no {mark} marker found").when(F.size(parts) < least, f"{fmt} needs {least} segments")
        rest = F.slice(parts, least, F.greatest(F.size(parts), F.lit(1)))
        return out(head, let(rest, lambda r: pairs_map(kv_pairs(F.array_join(r, "|") if fmt == "cef" else _leef_attributes(F.get(head, F.lit(0)), r)))), bad)

    return let(split_escaped(F.substr(body, start, F.length(body))), of)


def _leef_attributes(version: Column, rest: Column) -> Column:
    """Attributes with spaces between them, whatever delimiter a version 2 header names (a sign, or xNN in hexadecimal)."""
    first = F.get(rest, F.lit(0))
    coded = first.startswith("x") | first.startswith("0x")
    custom = version.startswith("2") & (F.size(rest) > 1) & (coded | (F.length(first) == 1))
    code = F.conv(F.regexp_extract(first, "^0?x([0-9A-Fa-f]{1,4})$", 1), 16, 10).try_cast("int")
    delimiter = F.when(custom & coded, F.when(code.between(1, 255), F.char(code)).otherwise("\t")).when(custom, first).otherwise("\t")
    kept = F.when(custom, F.slice(rest, 2, F.greatest(F.size(rest), F.lit(1)))).otherwise(rest)
    return F.replace(F.array_join(kept, "|"), delimiter, F.lit(" "))


def java_regex(pattern: str) -> str:
    """A pattern of the mapping language as a Java pattern; raises re.error where it is no pattern."""
    re.compile(pattern)
    return "(?U)" + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))


def group_index(pattern: str, group: int | str) -> int:
    """The number of a capture group; raises ValueError for one that the pattern hasn't."""
    compiled = re.compile(pattern)
    index = compiled.groupindex.get(group, -1) if isinstance(group, str) else group
    if not 0 <= index <= compiled.groups:
        raise ValueError(f"no group {group!r} in {pattern!r}")
    return index
