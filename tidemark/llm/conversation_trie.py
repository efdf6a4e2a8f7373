"""The trie of conversations' prefixes, with totals of its subtrees passed to parents in order of time.

A node is a distinct sequence of first turns, named by a chained SHA-256 (128 bits). Text never
leaves the task that reads it: a turn is its digest and its number of words. A conversation's turns are
sorted by Spark and chained as they stream by, whatever their number.

Time-forward processing: nodes are sorted by reverse level, so that a node comes after all
its children, and a priority queue holds what children have sent to parents that are still to come.
Shards: a node is of class k if LIMIT**k to LIMIT**(k + 1) - 1 conversations start with it,
so classes never rise with depth, and a subtree of class k hangs below a node of a higher class. A shard holds
whole such subtrees, each keyed by its top node; on each of its levels a subtree has fewer than LIMIT
nodes. Shards of class 0 come first; what their roots send is summed by Spark for each parent (a parent of a third of
all conversations gets a message from each task), and goes to the shards of the next class, log(conversations) /
log(LIMIT) rounds in all. Sorting spills in Spark; the queue is of two levels of one subtree, so
it has LIMIT messages each at most and needs no file.

Turns are ordered by `turn` (null first), then role, then their digests. A null role or text is empty; rows without a
conversation's id belong to no conversation; repeated rows are repeated turns; other columns are ignored; an empty table has no
node. A conversation is chained in one task, in constant memory, as its prefixes need each other; nothing else of
a hot conversation, turn or prefix meets in one task but blocks of digits that a digest of its members streams over.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written

#: Conversations of a subtree of class 0, at most; members in a block of a digest.
LIMIT, BLOCK = 1024, 4096
ROOT = bytes(16)
#: How conversations of the registered query are forked: families, and fewer turns than this are taken over.
FAMILY, MOST_TAKEN = 20, 4
_ROWS = "node binary, parent binary, depth bigint, conv bigint, words bigint, last boolean"
_PLACED = "node binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, words bigint, class int, top binary"
_TOTALS = "node binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, is_top boolean"


def placed(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns as rows (`conv`, `pos` from 0, `digest`, `words`)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), words.alias("words")).filter("conv IS NOT NULL")
    at = F.row_number().over(Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "digest"))
    return rows.select("conv", (at - 1).cast("long").alias("pos"), "digest", "words")


def starts(turns: DataFrame) -> DataFrame:
    """`turns` with a row at place -1 for each conversation, where its empty prefix stands."""
    return turns.unionByName(turns.select("conv").distinct().select("conv", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words")))


def forked(turns: DataFrame) -> DataFrame:
    """Conversations that take over the first turns of their family's first one, as starts() has them.

    A conversation c takes the first h turns of c - c % FAMILY (all if it has fewer, none if it is absent), h being the checksum of
    its decimal id modulo MOST_TAKEN, and goes on with its own turns after its first h. A family has FAMILY members, so no key of the joins is hot.
    """
    taken = (F.crc32(F.col("conv").cast("string").cast("binary")) % MOST_TAKEN).cast("int")
    head = F.array_sort(F.collect_list(F.when(F.col("pos") < MOST_TAKEN - 1, F.struct("pos", "digest", "words"))))
    base = F.col("conv") - F.pmod(F.col("conv"), F.lit(FAMILY))
    each = turns.groupBy("conv").agg(head.alias("head")).withColumn("base", base)
    heads = each.filter("conv = base").select("base", "head")
    family = each.select("conv", "base", taken.alias("h")).join(heads, "base", "left").select("conv", "h", F.coalesce(F.expr("slice(head, 1, h)"), F.expr("slice(array(), 1, 0)").cast("array<struct<pos:bigint,digest:binary,words:bigint>>")).alias("head"))
    first = family.select("conv", F.explode("head").alias("x")).select("conv", "x.pos", "x.digest", "x.words")
    rest = turns.join(family.select("conv", "h", F.size("head").alias("k")), "conv").filter("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "digest", "words")
    empty = family.select("conv", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return first.unionByName(rest).unionByName(empty)


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def _kinds(schema: str) -> list[tuple[str, pa.DataType]]:
    types = {"binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    return [(n, types[t]) for n, t in (x.split() for x in schema.split(", "))]


def prefixes(turns: DataFrame) -> DataFrame:
    """Every prefix of every conversation: `node`, `parent`, `depth`, `conv`, `words` of its last turn, and whether it is the whole conversation."""
    kinds = _kinds(_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, node, held = None, ROOT, None
        for batch in batches:
            out = []
            for c, digest, words in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held is not None:
                    out.append((*held, c != conv))
                if c != conv:
                    conv, node, depth, parent = c, ROOT, 0, None
                else:
                    parent, node, depth = node, hashlib.sha256(node + digest).digest()[:16], depth + 1
                held = (node, parent, depth, c, words)
            yield _batch(out, kinds)
        if held is not None:
            yield _batch([(*held, True)], kinds)

    return turns.repartition("conv").sortWithinPartitions("conv", "pos").select("conv", "digest", "words").mapInArrow(run, _ROWS)


def _tops(rows: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """A row for each node, made where its first member's prefixes stream by: with its class and the top of its subtree of that class."""
    kinds = _kinds(_PLACED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = np.array([limit**k for k in range(1, 1 + int(63 // np.log2(limit)))])
        conv, cls, top, above = None, None, None, None
        for batch in batches:
            out = []
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            classes = np.searchsorted(powers, np.asarray(batch.column(batch.schema.names.index("n_convs"))), "right").tolist()
            for c, node, parent, depth, words, first, n, k in zip(*(columns[x] for x in ("conv", "node", "parent", "depth", "words", "conv_id", "n_convs")), classes, strict=True):
                if c != conv:
                    conv, cls, above = c, None, None
                if k != cls:
                    cls, top = k, node
                if first == c:
                    out.append((node, parent, depth, first, above, n, words, k, top))
                above = first
            yield _batch(out, kinds)

    joined = rows.select("node", "parent", "depth", "conv", "words").join(nodes.select("node", "conv_id", "n_convs"), "node")
    return joined.repartition("conv").sortWithinPartitions("conv", "depth").mapInArrow(run, _PLACED)


def _pass(shard: DataFrame) -> DataFrame:
    """The totals of a class's nodes: subtrees in reverse level order, with a queue of messages. shard: _tops() rows with what came from lower classes."""
    kinds = _kinds(_TOTALS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue: list[tuple[int, bytes, int, int]] = []
        for batch in batches:
            out = []
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for node, parent, depth, first, above, n, words, top, children, leaves, saved in zip(*(columns[x] for x in ("node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "words", "top", "n_children", "n_leaves", "saved_tokens")), strict=True):
                saved += (n - 1) * words
                while queue and queue[0][1] == node and queue[0][0] == -depth:
                    _, _, below, more = heapq.heappop(queue)
                    children, leaves, saved = children + 1, leaves + below, saved + more
                leaves = leaves or 1
                if node != top:
                    heapq.heappush(queue, (1 - depth, parent, leaves, saved))
                out.append((node, parent, depth, first, above, n, children, leaves, saved, node == top))
            yield _batch(out, kinds)

    return shard.repartition("top").sortWithinPartitions("top", F.desc("depth"), "node").mapInArrow(run, _TOTALS)


def _ends(rows: DataFrame) -> DataFrame:
    """`node`, `ends_sha256` of the nodes where conversations end: their ids ascending, joined by commas."""
    block = F.floor(F.col("conv") / BLOCK)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    blocks = rows.filter("last").groupBy("node", block.alias("block")).agg(ids.alias("ids"))
    kinds = _kinds("node binary, ends_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = state = None
        for batch in batches:
            out = []
            for own, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own == node:
                    state.update(b",")
                else:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = own, hashlib.sha256()
                state.update(part.encode())
            yield _batch(out, kinds)
        if node is not None:
            yield _batch([(node, state.hexdigest())], kinds)

    return blocks.repartition("node").sortWithinPartitions("node", "block").select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def trie_of(turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of `turns` (`conv`, `pos`, `digest`, `words`, with a row at -1 for each conversation).

    Rows (`node`, `parent`: hex, `conv_id`: smallest member, `depth`, `parent_conv_id`, `n_convs`: members, `n_children`, `n_leaves`: childless nodes of the
    subtree, `saved_tokens`: of the subtree, each node's members but one times its last turn's words, `ends_sha256`: of the ids of conversations that end there).
    """
    rows = written(prefixes(turns))
    nodes = written(rows.groupBy("node").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")))  # so that the join can split a hot node
    tops = written(_tops(rows, nodes, limit))
    most, classes, sent, done = tops.agg(F.max("class")).first()[0], [], None, None
    for k in range((most or 0) + 1):
        own = tops.filter(F.col("class") == k).drop("class")
        zero = F.lit(0).cast("bigint")
        if sent is None:
            own = own.withColumns({"n_children": zero, "n_leaves": zero, "saved_tokens": zero})
        else:
            own = own.join(sent, F.col("node") == F.col("to"), "left").drop("to").withColumns({c: F.coalesce(c, zero) for c in ("n_children", "n_leaves", "saved_tokens")})
        done = written(_pass(own))
        classes.append(done)
        new = done.filter("is_top AND parent IS NOT NULL").select(F.col("parent").alias("to"), F.lit(1).alias("n_children"), "n_leaves", "saved_tokens")
        # what a class sends may be for any higher class
        sent = new if k == 0 else new.unionByName(sent)
        sent = sent.groupBy("to").agg(*(F.sum(c).cast("bigint").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")))
    out = classes[0]
    for more in classes[1:]:
        out = out.unionByName(more)
    out = out.join(_ends(rows), "node", "left")
    return out.select(
        F.lower(F.hex("node")).alias("node"), F.lower(F.hex("parent")).alias("parent"), "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """The trie of a table of turns, as trie_of() has it."""
    return trie_of(starts(placed(conversations, conv_col, turn_col, role_col, text_col)), limit)
