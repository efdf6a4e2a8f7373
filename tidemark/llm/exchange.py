"""Packed questions and answers between batches of documents and buckets of keys.

A corpus operator often has to know, of millions of fingerprints in each document,
which ones other documents have. One Spark row for each fingerprint costs more than
the fingerprint. Here documents are dealt into batches by a hash of id and text (so rows
without id, or with one id, are no batch of their own), a task
packs what a batch asks of a bucket (a range of key hashes) into one row, the bucket
answers every batch that asked with one packed row, and a cogroup brings the answers
back to the batch, where the question is derived again from the text to line up with
them. Equal keys of a batch are sent once, so a key that a third of all documents
hold costs a bucket one entry for each batch. Spark does all moving and spilling.

Batches and buckets are counted from the bytes of text (one cheap aggregate), so
their sizes stay the same as the corpus grows. Nothing is collected on the driver
but that sum. Lost tasks are recomputed: every step is a pure function of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import NO_ID, U64, byte_view

BATCH_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: A question or an answer: the other side's number and its packed columns.
Packed = tuple[int, list[bytes]]


@dataclass(frozen=True)
class Corpus:
    """Documents (`batch`, `doc`, `text`) dealt into batches, and how many buckets their keys go to."""

    df: DataFrame
    n_buckets: int


@dataclass(frozen=True)
class Batch:
    """The documents of one batch in the order of their ids (equal ids: of their texts)."""

    ids: np.ndarray
    null_ids: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def corpus(docs: DataFrame, id_col: str, text_col: str, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> Corpus:
    df = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = df.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    batch = F.pmod(F.xxhash64("doc", "text"), F.lit(max(1, -(-size // batch_bytes)))).cast("int")
    return Corpus(df.select(batch.alias("batch"), "doc", "text"), max(1, -(-size // bucket_bytes)))


def _open(table: pa.Table) -> Batch:
    table = table.sort_by("doc")
    ids = table["doc"].combine_chunks() if table["doc"].num_chunks != 1 else table["doc"].chunk(0)
    values = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
    if len(values) > 1 and (values[1:] == values[:-1]).any():
        table = table.sort_by([("doc", "ascending"), ("text", "ascending")])
    data, offsets = byte_view(table["text"])
    return Batch(values.astype(np.int64), np.asarray(ids.is_null()), data, offsets)


def _fields(names: str) -> list[str]:
    return names.split()


def _rows(own: str, number: int, other: str, found: Iterable[Packed], names: list[str]) -> pa.Table:
    found = list(found)
    columns = {own: pa.array([number] * len(found), pa.int32()), other: pa.array([k for k, _ in found], pa.int32())}
    return pa.table(columns | {n: pa.array([x[i] for _, x in found], pa.binary()) for i, n in enumerate(names)})


def _schema(first: str, second: str, names: str) -> str:
    return f"{first} int, {second} int, " + ", ".join(f"{n} binary" for n in _fields(names))


def ask(c: Corpus, make: Callable[[Batch], Iterable[Packed]], names: str) -> DataFrame:
    """Each batch's questions: rows (batch, bucket, packed columns)."""
    fields = _fields(names)

    def run(table: pa.Table) -> pa.Table:
        return _rows("batch", table["batch"][0].as_py(), "bucket", make(_open(table)), fields)

    return c.df.groupBy("batch").applyInArrow(run, _schema("batch", "bucket", names))


def ask_again(c: Corpus, answers: DataFrame, make: Callable[[Batch, dict], Iterable[Packed]], names: str) -> DataFrame:
    """As ask(), by batches that have had answers to an earlier question."""
    fields = _fields(names)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows("batch", 0, "bucket", [], fields)
        return _rows("batch", left["batch"][0].as_py(), "bucket", make(_open(left), _by_bucket(right)), fields)

    return c.df.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, _schema("batch", "bucket", names))


def answer(questions: DataFrame, reply: Callable[[list[int], list[list[bytes]]], Iterable[Packed]], names: str, phase: int = 0) -> DataFrame:
    """Each bucket's answers: rows (bucket, batch, packed columns, phase). reply: gets the batches and their packed columns."""
    fields, asked = _fields(names), [x for x in questions.columns if x not in ("batch", "bucket")]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("batch")
        columns = [table[x].to_pylist() for x in asked]
        return _rows("bucket", table["bucket"][0].as_py(), "batch", reply(table["batch"].to_pylist(), columns), fields)

    return questions.groupBy("bucket").applyInArrow(run, _schema("bucket", "batch", names)).withColumn("phase", F.lit(phase))


def _by_bucket(table: pa.Table) -> dict[tuple[int, int], list[bytes]]:
    names = [x for x in table.column_names if x not in ("batch", "bucket", "phase")]
    return {(p, b): list(x) for p, b, *x in zip(table["phase"].to_pylist(), table["bucket"].to_pylist(), *(table[n].to_pylist() for n in names), strict=True)}


def finish(c: Corpus, answers: DataFrame, make: Callable[[Batch, dict], pa.Table], schema: str) -> DataFrame:
    """The rows that batches make of their documents and the answers (keyed by phase and bucket)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # cannot be: only batches that asked are answered
            return pa.table({n: pa.array([], t) for n, t in empty})
        return make(_open(left), _by_bucket(right))

    empty: list = []
    return c.df.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, schema)


def split(keys: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets of distinct 64-bit keys, each with the places of its keys, in a repeatable order."""
    bucket = (keys % U64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(bucket[part[0]]), part


def short_keys(keys: np.ndarray, n_buckets: int) -> bytes:
    """Keys of one bucket cut to 32 bits: enough to screen, as a bucket's size doesn't grow with the corpus."""
    return (keys // U64(n_buckets)).astype(np.uint32).tobytes()


def elsewhere(batches: list[int], columns: list[list[bytes]]) -> Iterator[Packed]:
    """For each batch's distinct 32-bit keys, a bit that says whether another batch has the key."""
    parts = [np.frombuffer(x, np.uint32) for x in columns[0]]
    _, at, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    shared, start = n[at] > 1, 0
    for batch, part in zip(batches, parts, strict=True):
        yield batch, [np.packbits(shared[start : start + len(part)]).tobytes()]
        start += len(part)


def read_bits(keys: np.ndarray, n_buckets: int, answers: dict, phase: int) -> np.ndarray:
    """The bits that answer a batch's distinct keys."""
    out = np.zeros(len(keys), bool)
    for bucket, part in split(keys, n_buckets):
        out[part] = np.unpackbits(np.frombuffer(answers[phase, bucket][0], np.uint8), count=len(part)).astype(bool)
    return out


def smaller_elsewhere(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Of entries of one bucket: whether an equal key stands with a smaller document. keys: distinct values' numbers."""
    least = np.full(int(keys.max()) + 1 if len(keys) else 0, NO_ID)
    np.minimum.at(least, keys, docs)
    return least[keys] < docs
