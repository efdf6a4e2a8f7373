"""The mapping language: YAML rules that say which event is of which class and where its fields come from.

    source: name            format: one of parsers.FORMATS     version: 1
    rules:                  the first rule that matches counts; one without match must be last
      - name: block
        match: {field: $7, equals: block}
        ocsf_class: 4001
        fields: {src_endpoint.ip: $19, severity_id: 3, user.name: {from: $_raw, regex: 'for (\\S+)', default: none}}

References: `$7` cell, `$a.b` name, `$_raw` the whole body, `$$x` the text "$x", anything else itself.
Everything is checked when a mapping is loaded: a mapping that loads also compiles.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import LOOKUPS, TIMED_TRANSFORMS, TRANSFORMS
from tidemark.operators.parsers import FORMATS, group_index
from tidemark.plans.catalogue import CLASSES

# The operators and keys of the mapping language.
OPERATORS = ("equals", "not_equals", "contains", "startswith", "regex", "exists", "in")
_SPEC_KEYS = {"from", "regex", "group", "transform", "lookup", "default", "tz"}
_RULE_KEYS = {"name", "match", "ocsf_class", "fields"}
_MAPPING_KEYS = {"source", "format", "ocsf_version", "version", "description", "author", "approved_by", "approved_at", "confidence", "rules"}
BUNDLED = Path(__file__).with_name("mappings")


class MappingError(ValueError):
    """A mapping that can't be used, and why."""


@dataclass(frozen=True)
class Ref:
    kind: str  # positional, named or literal
    value: Any

    @classmethod
    def of(cls, raw: Any) -> Ref:
        if not isinstance(raw, str) or not raw.startswith("$"):
            return cls("literal", raw)
        if raw.startswith("$$"):
            return cls("literal", raw[1:])
        name = raw[1:]
        if name.isdecimal() and name.isascii():
            if int(name) < 1:
                raise MappingError(f"{raw}: cells are counted from 1")
            return cls("positional", int(name))
        if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.\-@]*", name):
            return cls("named", name)
        raise MappingError(f"{raw}: write $7, $name or $$text")

    def text(self) -> Any:
        if self.kind == "literal":
            return "$" + self.value if isinstance(self.value, str) and self.value.startswith("$") else self.value
        return f"${self.value}"


@dataclass(frozen=True)
class Spec:
    ref: Ref
    regex: str | None = None
    group: int | str = 1
    transform: str | None = None
    lookup: str | None = None
    default: Any = None
    tz: str | None = None

    @classmethod
    def of(cls, raw: Any, where: str) -> Spec:
        if not isinstance(raw, dict):
            return cls(Ref.of(raw))
        if unknown := set(raw) - _SPEC_KEYS:
            raise MappingError(f"{where}: unknown keys {', '.join(sorted(unknown))}")
        if "from" not in raw:
            raise MappingError(f"{where}: a from is needed")
        out = cls(Ref.of(raw["from"]), raw.get("regex"), raw.get("group", 1), raw.get("transform"), raw.get("lookup"), raw.get("default"), raw.get("tz"))
        if out.regex is not None:
            try:
                group_index(out.regex, out.group)
            except (re.error, ValueError) as e:
                raise MappingError(f"{where}: {e}") from None
        if out.transform and out.transform not in TRANSFORMS and out.transform not in TIMED_TRANSFORMS:
            raise MappingError(f"{where}: unknown transform {out.transform}")
        if out.lookup and out.lookup not in LOOKUPS:
            raise MappingError(f"{where}: unknown lookup {out.lookup}")
        return out


@dataclass(frozen=True)
class Condition:
    ref: Ref
    op: str
    value: Any

    @classmethod
    def of(cls, raw: Any, where: str) -> Condition:
        ops = [k for k in raw if k in OPERATORS] if isinstance(raw, dict) else []
        if len(ops) != 1 or set(raw) - {"field", *ops} or "field" not in raw:
            raise MappingError(f"{where}: a match has a field and one of {', '.join(OPERATORS)}")
        out = cls(Ref.of(raw["field"]), ops[0], raw[ops[0]])
        if out.op == "regex":
            try:
                re.compile(str(out.value))
            except re.error as e:
                raise MappingError(f"{where}: {e}") from None
        if out.op == "in" and not isinstance(out.value, list):
            raise MappingError(f"{where}: in needs a list")
        return out


@dataclass(frozen=True)
class Rule:
    name: str
    ocsf_class: int
    fields: dict[str, Spec]
    match: Condition | None = None

    @classmethod
    def of(cls, raw: Any, source: str) -> Rule:
        if not isinstance(raw, dict) or not raw.get("name"):
            raise MappingError(f"{source}: every rule needs a name")
        where = f"{source}.{raw['name']}"
        if unknown := set(raw) - _RULE_KEYS:
            raise MappingError(f"{where}: unknown keys {', '.join(sorted(unknown))}")
        uid, fields = raw.get("ocsf_class"), raw.get("fields")
        if uid not in CLASSES:
            raise MappingError(f"{where}: unknown class {uid}; known: {', '.join(map(str, sorted(CLASSES)))}")
        if not isinstance(fields, dict) or not fields:
            raise MappingError(f"{where}: fields are needed")
        if bad := [f for f in fields if f not in CLASSES[uid]]:
            raise MappingError(f"{where}: not in class {uid}: {', '.join(bad)}")
        match = None if raw.get("match") is None else Condition.of(raw["match"], where)
        return cls(str(raw["name"]), uid, {k: Spec.of(v, f"{where}.{k}") for k, v in fields.items()}, match)


@dataclass(frozen=True)
class Mapping:
    source: str
    format: str
    version: int
    rules: tuple[Rule, ...]
    ocsf_version: str = "1.5.0"
    approved_by: str | None = None
    about: dict[str, Any] = field(default_factory=dict, compare=False)

    @classmethod
    def of(cls, raw: Any) -> Mapping:
        if not isinstance(raw, dict) or not raw.get("source"):
            raise MappingError("a mapping needs a source")
        source = str(raw["source"])
        if unknown := set(raw) - _MAPPING_KEYS:
            raise MappingError(f"{source}: unknown keys {', '.join(sorted(unknown))}")
        if raw.get("format") not in FORMATS:
            raise MappingError(f"{source}: unknown format {raw.get('format')}")
        version, confidence = raw.get("version", 1), raw.get("confidence")
        if not isinstance(version, int) or isinstance(version, bool) or version < 1:
            raise MappingError(f"{source}: version must be 1 or more")
        if confidence is not None and not 0 <= float(confidence) <= 1:
            raise MappingError(f"{source}: confidence must be between 0 and 1")
        rules = tuple(Rule.of(r, source) for r in raw.get("rules") or [])
        if not rules:
            raise MappingError(f"{source}: a rule is needed")
        names = [r.name for r in rules]
        if len(set(names)) < len(names):
            raise MappingError(f"{source}: rule names must differ")
        if any(r.match is None for r in rules[:-1]):
            raise MappingError(f"{source}: a rule without match hides the rules after it")
        about = {k: raw.get(k) for k in ("description", "author", "approved_at", "confidence")}
        return cls(source, raw["format"], version, rules, str(raw.get("ocsf_version", "1.5.0")), raw.get("approved_by"), about)

    @classmethod
    def from_yaml(cls, text: str) -> Mapping:
        try:
            return cls.of(yaml.safe_load(text))
        except yaml.YAMLError as e:
            raise MappingError(f"not YAML: {e}") from None

    def content_hash(self) -> str:
        """SHA-256 of what the mapping means; descriptions, authors and approvals don't count."""
        def condition(c: Condition | None) -> dict | None:
            return c and {"field": c.ref.text(), "op": c.op, "value": c.value}

        def spec(s: Spec) -> dict:
            return {"from": s.ref.text(), "regex": s.regex, "group": s.group, "transform": s.transform, "lookup": s.lookup, "default": s.default, "tz": s.tz}

        rules = [{"name": r.name, "ocsf_class": r.ocsf_class, "match": condition(r.match), "fields": {k: spec(s) for k, s in r.fields.items()}} for r in self.rules]
        meaning = {"source": self.source, "format": self.format, "ocsf_version": self.ocsf_version, "version": self.version, "rules": rules}
        return hashlib.sha256(json.dumps(meaning, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def refs(self) -> list[Ref]:
        return [x.ref for r in self.rules for x in [*r.fields.values(), *([r.match] if r.match else [])]]

    def classes(self) -> tuple[int, ...]:
        return tuple(dict.fromkeys(r.ocsf_class for r in self.rules))


@dataclass
class LoadReport:
    loaded: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)

    @property
    def changed(self) -> bool:
        return bool(self.loaded or self.removed)


class Registry:
    """Mappings by source, from a folder of YAML files; refresh() takes up edits and keeps what worked when an edit is broken."""

    def __init__(self, folder: str | Path | None = None) -> None:
        self.folder = Path(folder) if folder else None
        self._by_file: dict[Path, tuple[tuple[int, int], Mapping | None]] = {}
        self._added: dict[str, Mapping] = {}

    @classmethod
    def bundled(cls) -> Registry:
        out = cls(BUNDLED)
        if errors := out.refresh().errors:
            raise MappingError(str(errors))
        return out

    def refresh(self) -> LoadReport:
        report = LoadReport()
        files = sorted(p for p in self.folder.iterdir() if p.suffix in (".yaml", ".yml")) if self.folder else []
        for gone in set(self._by_file) - set(files):
            if old := self._by_file.pop(gone)[1]:
                report.removed.append(old.source)
        for path in files:
            stamp = (path.stat().st_mtime_ns, path.stat().st_size)
            before = self._by_file.get(path)
            if before and before[0] == stamp:
                continue
            try:
                mapping = Mapping.from_yaml(path.read_text(encoding="utf-8"))
                if any(m and m.source == mapping.source for p, (_, m) in self._by_file.items() if p != path):
                    raise MappingError(f"{mapping.source} is defined twice")
                self._by_file[path] = (stamp, mapping)
                report.loaded.append(mapping.source)
            except MappingError as e:
                self._by_file[path] = (stamp, before[1] if before else None)
                report.errors[path.name] = str(e)
        return report

    def add(self, mapping: Mapping) -> None:
        self._added[mapping.source] = mapping

    def mappings(self) -> dict[str, Mapping]:
        return {m.source: m for _, m in self._by_file.values() if m} | self._added

    def get(self, source: str) -> Mapping | None:
        return self.mappings().get(source)

    def sources(self) -> tuple[str, ...]:
        return tuple(sorted(self.mappings()))

    def hashes(self) -> dict[str, str]:
        return {s: m.content_hash() for s, m in sorted(self.mappings().items())}


def checked(texts: DataFrame, yaml_col: str) -> DataFrame:
    """Rows of mappings' texts with `error`: why a text wouldn't load, or null."""

    @F.pandas_udf("string")
    def error(texts: pd.Series) -> pd.Series:
        def of(text: str | None) -> str | None:
            try:
                Mapping.from_yaml(text or "")
            except MappingError as e:
                return str(e)
            return None

        return texts.map(of)

    return texts.withColumn("error", error(F.col(yaml_col)))
