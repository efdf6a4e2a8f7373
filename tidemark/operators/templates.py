"""Template mining: masking, tokens, and order-dependent clustering of log lines by a fixed-depth tree.

Clusters never hold lines of different lengths, and a line only meets clusters of the
tree's leaf that it is led to. So lines are mined in shards of (source, token count, first tokens), in
order of their line numbers, streamed batch by batch: a task holds the templates of a shard, not its
lines. A shard goes one token deeper as long as the tree can't lead a line elsewhere than to its own token's branch,
which is when no token of that place has a digit or is a wildcard and there are not more of them than a node's children:
the result is that of one tree over all lines. A line that was met before, with no change since, costs one lookup.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import written

WILD = "<*>"
#: What is masked, in this order, and what stands for it.
MASKS = (
    (r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b", WILD),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b", WILD),
    (r"\b[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}\b", WILD),
    (r"(?<=blk_)-?\d+", ""),
    (r"\b0[xX][0-9A-Fa-f]+\b", WILD),
    (r"(?<![A-Za-z])-?\d+(?:\.\d+)?(?![A-Za-z])", WILD),
)
DEPTH, SIMILARITY, CHILDREN = 4, 0.4, 100
#: Lines that a miner remembers between two changes, at most.
MET = 100_000


def mask(line: Column) -> Column:
    return reduce(lambda c, m: F.regexp_replace(c, *m), MASKS, line)


def tokens(line: Column) -> Column:
    bare = F.regexp_replace(line, r"^\s+|\s+$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"\s+"))


def similarity(template: Column, line: Column) -> Column:
    """The share of equal tokens that aren't wildcards; 0 for different lengths, 1 for empty ones."""
    same = F.aggregate(F.zip_with(template, line, lambda a, b: ((a == b) & (a != WILD)).cast("int")), F.lit(0), lambda a, b: a + b)
    return F.when(F.size(template) != F.size(line), 0.0).when(F.size(template) == 0, 1.0).otherwise(same / F.size(template))


class Miner:
    """The templates of one group of lines of equal length."""

    def __init__(self, depth: int = DEPTH, threshold: float = SIMILARITY, children: int = CHILDREN) -> None:
        if depth < 3:
            raise ValueError("depth must be at least 3")
        self.levels, self.threshold, self.children = depth - 2, threshold, children
        self.leaves: dict[tuple[str, ...], list[int]] = {}
        self.branches: dict[tuple[str, ...], set[str]] = {}
        self.templates: list[list[str]] = []
        self.changes = 0
        self.met: dict[str, int] = {}  # lines since the last change, and their clusters

    def add_text(self, line: str) -> int:
        """As add(), of tokens with one space between them."""
        at = self.met.get(line)
        if at is None:
            before = self.changes
            at = self.add(line.split(" ") if line else [])
            if self.changes != before or len(self.met) >= MET:
                self.met.clear()
            if self.changes == before:  # a template that has just changed may rank otherwise for the same line
                self.met[line] = at
        return at

    def _path(self, line: list[str], grow: bool) -> tuple[str, ...] | None:
        path: tuple[str, ...] = ()
        for token in line[: self.levels]:
            known = self.branches.setdefault(path, set())
            if grow:
                step = WILD if any(c.isdigit() for c in token) else token
                if step not in known and len(known) >= self.children:
                    step = WILD
                known.add(step)
            else:
                step = token if token in known else WILD
                if step not in known:
                    return None
            path += (step,)
        return path

    def add(self, line: list[str]) -> int:
        """The number of the line's cluster."""
        path, best, at = self._path(line, grow=False), (-1.0, 0), -1
        for i in self.leaves.get(path, ()) if path is not None else ():
            wild = self.templates[i].count(WILD)
            equal = sum(a == b and a != WILD for a, b in zip(self.templates[i], line, strict=True))
            rank = (equal / len(line) if line else 1.0, -wild)
            if rank > best or at < 0:
                best, at = rank, i
        if at < 0 or best[0] < self.threshold:
            self.templates.append(list(line))
            at = len(self.templates) - 1
            self.leaves.setdefault(self._path(line, grow=True), []).append(at)
            self.changes += 1
        else:
            merged = [a if a in (b, WILD) else WILD for a, b in zip(self.templates[at], line, strict=True)]
            if merged != self.templates[at]:
                self.templates[at] = merged
                self.changes += 1
        return at

    def dumps(self) -> str:
        """The tree as JSON, for state kept between micro-batches."""
        flat = lambda d: [[list(k), sorted(v) if isinstance(v, set) else v] for k, v in d.items()]
        return json.dumps({"levels": self.levels, "threshold": self.threshold, "children": self.children, "templates": self.templates, "leaves": flat(self.leaves), "branches": flat(self.branches)})

    @classmethod
    def loads(cls, text: str) -> Miner:
        held = json.loads(text)
        out = cls(held["levels"] + 2, held["threshold"], held["children"])
        out.templates = held["templates"]
        out.leaves = {tuple(k): v for k, v in held["leaves"]}
        out.branches = {tuple(k): set(v) for k, v in held["branches"]}
        return out


def sharded(lines: DataFrame, depth: int = DEPTH, children: int = CHILDREN) -> DataFrame:
    """`source`, `size`, `shard`, `line_id`, `line` (tokens with one space between them): lines of different shards never meet in the tree."""
    cut = tokens(mask(F.col("text")))
    df = lines.select("source", "line_id", F.coalesce(cut, F.array().cast("array<string>")).alias("t"))
    df = df.select("source", F.size("t").alias("size"), "line_id", F.array_join("t", " ").alias("line"), *(F.get("t", F.lit(i)).alias(f"t{i}") for i in range(depth - 2)))
    df = written(df, "masked").withColumn("shard", F.lit(""))  # read once for each token, masked once
    key = ["source", "size", "shard"]
    for i in range(depth - 2):
        token = F.col(f"t{i}")
        seen = df.groupBy(*key, token).agg(F.lit(1).alias("one"))
        apart = seen.groupBy(*key).agg((~F.bool_or(F.coalesce(token.rlike(r"[0-9]|[^\x00-\x7F]") | (token == WILD), F.lit(False))) & (F.count("*") <= children)).alias("apart"))
        if i:  # a shard that wasn't cut at a place isn't cut behind it
            apart = apart.filter(F.length("shard") - F.length(F.replace("shard", F.lit("\n"), F.lit(""))) == i)
        df = df.join(apart, key, "left").withColumn("shard", F.when(F.col("apart"), F.concat("shard", F.coalesce(token, F.lit("")), F.lit("\n"))).otherwise(F.col("shard"))).drop("apart")
    return df.select("source", "size", "shard", "line_id", "line")


def _mined(lines: DataFrame, depth: int, threshold: float, each: bool) -> DataFrame:
    """Rows (`source`, `line_id`, `first_id`) of lines if `each`, and of clusters, without `line_id`, with `template` and `n`."""
    def batch(source: list, line_id: list, first_id: list, template: list, n: list) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((source, line_id, first_id, template, n), kinds, strict=True)], names=["source", "line_id", "first_id", "template", "n"])

    def ended(group: tuple, miner: Miner, firsts: list[int], counts: list[int]) -> pa.RecordBatch:
        return batch([group[0]] * len(firsts), [None] * len(firsts), firsts, [" ".join(t) for t in miner.templates], counts)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, miner, firsts, counts = None, Miner(depth, threshold), [], []
        for part in parts:  # sorted by shard and line, so one shard is open at a time
            first, (sources, sizes, shards, ids, texts) = [], (part.column(i).to_pylist() for i in range(5))
            for source, size, shard, line_id, line in zip(sources, sizes, shards, ids, texts, strict=True):
                if (source, size, shard) != group:
                    if group:
                        yield ended(group, miner, firsts, counts)
                    group, miner, firsts, counts = (source, size, shard), Miner(depth, threshold), [], []
                at = miner.add_text(line)
                if at == len(firsts):
                    firsts.append(line_id)
                    counts.append(0)
                counts[at] += 1
                first.append(firsts[at])
            if each:
                yield batch(sources, ids, first, [None] * len(ids), [None] * len(ids))
        if group:
            yield ended(group, miner, firsts, counts)

    dealt = sharded(lines, depth).repartition("source", "size", "shard").sortWithinPartitions("source", "size", "shard", "line_id")
    return dealt.mapInArrow(run, "source string, line_id bigint, first_id bigint, template string, n bigint")


def mine(lines: DataFrame, depth: int = DEPTH, threshold: float = SIMILARITY) -> DataFrame:
    """`source`, `line_id`, `first_id`: each line's cluster, named by its first line. lines: source, line_id, text."""
    return _mined(lines, depth, threshold, each=True).filter("line_id IS NOT NULL").select("source", "line_id", "first_id")


def clusters(lines: DataFrame, depth: int = DEPTH, threshold: float = SIMILARITY) -> DataFrame:
    """`source`, `first_id`, `size`, `template`, `cluster_id`: each cluster's tokens on which all its lines agree, wildcards elsewhere; numbered by first line. Lines are read once and not joined again."""
    found = _mined(lines, depth, threshold, each=False).select("source", "first_id", F.col("n").alias("size"), "template")
    return found.withColumn("cluster_id", F.row_number().over(Window.partitionBy("source").orderBy("first_id")) - 1)


def templates(lines: DataFrame, mined: DataFrame) -> DataFrame:
    """As clusters(), from assignments that are at hand: `source`, `line_id`, `first_id`."""
    both = lines.select("source", "line_id", tokens(mask(F.col("text"))).alias("line")).join(mined, ["source", "line_id"])
    places = both.select("source", "first_id", "line_id", F.posexplode("line").alias("i", "t")).groupBy("source", "first_id", "i").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    text = places.groupBy("source", "first_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(WILD).alias("t")))), lambda x: x["t"]), " ").alias("template"))
    sizes = mined.groupBy("source", "first_id").agg(F.count("*").alias("size"))
    order = Window.partitionBy("source").orderBy("first_id")
    return sizes.join(text, ["source", "first_id"], "left").withColumn("cluster_id", F.row_number().over(order) - 1)


def grouping_accuracy(labelled: DataFrame) -> DataFrame:
    """The share of lines whose predicted group is exactly their true group. labelled: line_id, predicted, truth."""
    both = labelled.groupBy("predicted", "truth").agg(F.count("*").alias("n"))
    by = lambda c: both.groupBy(c).agg(F.sum("n").alias(f"n_{c}"))
    right = both.join(by("predicted"), "predicted").join(by("truth"), "truth")
    hit = F.sum(F.when((F.col("n") == F.col("n_predicted")) & (F.col("n") == F.col("n_truth")), F.col("n")).otherwise(0))
    return right.agg(F.coalesce(F.round(hit / F.sum("n"), 6), F.lit(0.0)).alias("accuracy"))
