"""Append-following log files as a Structured Streaming source.

`spark.readStream.format("tail")` follows files that grow. Its offset holds, for each file, the
identity (inode) and the size that is taken; the driver only lists files and never opens one. A planned
partition is a byte range of a file, and gives the lines that end in it: the task that has the range looks back
for the start of its first line. So every line comes once, wherever ranges are cut; bytes
after the last newline come with the range that brings their newline; a long backlog is many
tasks; and a batch that is run again reads the same bytes.

A file that shrank, or whose path now names another inode, is read from its start. What the former file held
beyond its offset is read to its end, if it was renamed within its folder. Files are read
by the executors, which must see the folder as the driver does.

Options: `path` (a folder), `specs` (JSON list of [pattern, source_id, skip_prefix]; default
SPECS), `maxBytesPerTrigger` (dealt fairly over the files that have grown).
"""

from __future__ import annotations

import fnmatch
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Which product's log a file holds by its path, and the mark of lines that are no events.
SPECS = (
    ("nginx/access.log", "nginx_access", None),
    ("nginx/error.log", "nginx_error", None),
    ("squid/access.log", "squid_access", None),
    ("postfix/maillog", "postfix_maillog", None),
    ("ssh/*.log", "openssh_auth", None),
    ("suricata/eve.json", "suricata_eve", None),
    ("zeek/conn.log", "zeek_conn", "#"),
    ("netfilter/*.log", "iptables", None),
    ("auditd/audit.log", "linux_auditd", None),
)
SCHEMA = "source_id string, path string, raw_bytes binary"
#: Bytes of a trigger, of a partition, and of one read.
MOST_BYTES, RANGE_BYTES, BLOCK = 1 << 30, 32 << 20, 1 << 18


def source_of(path: Column, specs=SPECS) -> Column:
    """The source of a file by its path's end; null if no pattern fits."""
    rule = lambda p: path.rlike("(^|/)" + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() else c for c in p) + "$")
    return F.coalesce(*(F.when(rule(p), F.lit(s)) for p, s, _ in specs))


def kept(path: Column, line: Column, specs=SPECS) -> Column:
    """Whether a line of a file is an event: not blank, and without its source's mark of comments."""
    marks = {s: m for _, s, m in specs if m}
    source = source_of(path, specs)
    comment = F.coalesce(*(F.when(source == s, line.startswith(m)) for s, m in marks.items()), F.lit(False)) if marks else F.lit(False)
    return (F.trim(line, F.lit(" \t\r\n")) != "") & ~comment


class _Range(InputPartition):
    """Bytes [start, end) of a file; `last`: the file has ended, so its last line needs no newline."""

    def __init__(self, path: str, name: str, source: str, skip: str | None, start: int, end: int, last: bool) -> None:
        self.path, self.name, self.source, self.skip, self.start, self.end, self.last = path, name, source, skip, start, end, last


def shares(wanted: dict[str, int], most: int) -> dict[str, int]:
    """`most` dealt over what is wanted: small wishes are met, the others get equal parts of the rest."""
    out, left = {}, most
    for i, (key, n) in enumerate(sorted(wanted.items(), key=lambda x: (x[1], x[0]))):
        out[key] = min(n, max(0, left) // (len(wanted) - i))
        left -= out[key]
    return out


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.specs = [tuple(s) for s in json.loads(options["specs"])] if "specs" in options else list(SPECS)
        self.most = int(options.get("maxbytespertrigger", options.get("maxBytesPerTrigger", MOST_BYTES)))
        self.known: dict[str, dict] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def _spec(self, path: str) -> tuple | None:
        inner = os.path.relpath(path, self.folder)
        return next((s for s in self.specs if fnmatch.fnmatch(inner, s[0]) and inner.count("/") == s[0].count("/")), None)

    def _files(self) -> dict[str, os.stat_result]:
        found = {}
        for folder, _, names in os.walk(self.folder):
            for name in names:
                path = os.path.join(folder, name)
                try:
                    if self._spec(path):
                        found[path] = os.stat(path)
                except OSError:  # it went meanwhile
                    continue
        return found

    def _renamed(self, path: str, old: dict) -> tuple[str, int] | None:
        """Where a file went that `path` named before, and its size."""
        with os.scandir(os.path.dirname(path)) as entries:
            return next(((e.path, e.stat().st_size) for e in entries if e.inode() == old["inode"] and e.path != path), None)

    def latestOffset(self) -> dict:
        # a former file stays for the one offset that takes its rest
        files = {key: f for key, f in self.known.items() if "of" not in f}
        wanted: dict[str, int] = {}
        for path, st in self._files().items():
            old = files.get(path)
            if old is None or old["inode"] != st.st_ino or st.st_size < old["at"]:
                if old is not None and old["inode"] != st.st_ino and (rest := self._renamed(path, old)) and rest[1] > old["at"]:
                    files[f"{path}\n{old['inode']}"] = {"of": path, "inode": old["inode"], "path": rest[0], "from": old["at"], "at": rest[1]}
                old = {"inode": st.st_ino, "at": 0, "turn": old["turn"] + 1 if old else 0}
            files[path] = old
            if st.st_size > old["at"]:
                wanted[path] = st.st_size - old["at"]
        for path, n in shares(wanted, self.most).items():
            files[path] = files[path] | {"at": files[path]["at"] + n}
        self.known = files
        return {"files": files}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        self.known = self.known or dict(end["files"])
        out = []
        for key, now in sorted(end["files"].items()):
            old, name = start["files"].get(key), now.get("of", key)
            if "of" in now:
                begin = now["at"] if old else now["from"]
            else:
                begin = old["at"] if old and old["turn"] == now["turn"] else 0
            spec = self._spec(name)
            for low in range(begin, now["at"], RANGE_BYTES):
                high = min(now["at"], low + RANGE_BYTES)
                out.append(_Range(now.get("path", key), name, spec[1], spec[2], low, high, "of" in now and high == now["at"]))
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        skip = partition.skip.encode() if partition.skip else None
        with open(partition.path, "rb") as f:
            held = [_before(f, partition.start)]  # pieces of a line that hasn't ended
            f.seek(partition.start)
            left = partition.end - partition.start
            while left > 0 and (block := f.read(min(BLOCK, left))):
                left -= len(block)
                first, newline, rest = block.partition(b"\n")
                held.append(first)
                if newline:
                    *lines, last = rest.split(b"\n")
                    yield _lines(partition, [b"".join(held), *lines], skip)
                    held = [last]
            if partition.last and any(held):
                yield _lines(partition, [b"".join(held)], skip)

    def commit(self, end: dict) -> None:
        self.known = {key: f for key, f in self.known.items() if os.path.exists(f.get("path", key))} or self.known


def _before(f, at: int) -> bytes:
    """The bytes between the last newline before a place and the place."""
    pieces: list[bytes] = []
    while at > 0:
        low = max(0, at - BLOCK)
        f.seek(low)
        _, newline, own = f.read(at - low).rpartition(b"\n")
        pieces.append(own)
        if newline:
            break
        at = low
    return b"".join(reversed(pieces))


def _lines(partition: _Range, lines: list[bytes], skip: bytes | None) -> pa.RecordBatch:
    lines = [x for x in (y.rstrip(b"\r") for y in lines) if x.strip() and not (skip and x.startswith(skip))]
    return pa.RecordBatch.from_arrays([pa.array([partition.source] * len(lines), pa.string()), pa.array([partition.name] * len(lines), pa.string()), pa.array(lines, pa.binary())], names=["source_id", "path", "raw_bytes"])


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(dict(self.options))
