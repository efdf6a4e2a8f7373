"""Removal of repeated byte strings with run-length compressed Burrows-Wheeler indexes.

A string of WIDTH bytes repeats if it also starts in a document with a smaller id.
Strings are dealt to index shards by content: the least fingerprint of the string's
K-byte substrings (its anchor) names the shard, so all occurrences of a string meet in
one shard. Neighbouring strings with one anchor make a phrase; a document's phrases
cover it and overlap by WIDTH - 1 bytes (a prefix-free parse).

Spark exchange 1 tells each batch of documents which anchors other documents have;
only their phrases go on, each distinct one of a batch once, with its least document.
In exchange 2 a shard holds the phrase dictionary of its anchors; phrases of one fingerprint are
compared byte by byte. An anchor with one
phrase needs no index: every string of the phrase has the phrase's documents. The
phrases of the other anchors are laid end to end and their Burrows-Wheeler transform,
sorted by contexts of WIDTH bytes, is kept as runs, with each run's first rank. Rows
with one context are an interval; its sampled end holds the least document. Matching
statistics stream each phrase backward through the index: a step drops the context's
last byte and takes the next byte before by one rank query, which leads to the next
string's interval. A string whose interval's document is smaller than the asking
batch's least one is marked in the answer, one bit for each string.

Matches never cross documents, as phrases don't, and strings that straddle two phrases
of an index have no document.

Defined results: null and empty texts have no bytes; texts shorter than WIDTH keep all;
of repeated rows (equal ids) neither is smaller; a null id counts as the largest; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange as x
from tidemark.llm.bpe import gather
from tidemark.llm.tokens import BASE_BYTES, NO_ID, U64, byte_sums, mix, pieces, sliding_min, span_hashes, window_hashes

WIDTH, K = 50, 20
PIECE_BYTES = 1 << 18


class RunLengthIndex:
    """A context-bounded Burrows-Wheeler transform kept as runs, with the least document at each interval's end."""

    def __init__(self, text: np.ndarray, docs: np.ndarray, width: int = WIDTH) -> None:
        """text: bytes; docs: for each place the document of the string that starts there, or NO_ID."""
        n = self.n = len(text)
        self.width = width
        rank, span = _first_ranks(text), 1
        while 8 * span < width - 1 and 16 * span <= width - 1:
            rank = _dense(rank, np.roll(rank, -8 * span))
            span *= 2
        reach = 8 * span  # of the ranks: below the width, and over half of it
        full = _pair(rank, np.roll(rank, -(width - reach)))
        order = np.argsort(full, kind="stable")
        shorter = _pair(rank, np.roll(rank, -(width - 1 - reach)))[order]
        new_full, new_short = (np.append(True, k[1:] != k[:-1]) for k in (full[order], shorter))
        # intervals of equal contexts, and of contexts equal but for their last byte
        heads = np.flatnonzero(new_full)
        self.interval = np.cumsum(new_full) - 1
        self.least = np.minimum.reduceat(docs[order], heads)
        self.short_head = np.flatnonzero(new_short)[np.cumsum(new_short) - 1]
        self.row_of = np.empty(n, np.int64)
        self.row_of[order] = heads[self.interval]
        # runs of the transform, by byte and place, with the rank of each run's first row
        last = text[order - 1]
        starts = np.flatnonzero(np.append(True, last[1:] != last[:-1]))
        sizes = np.diff(np.append(starts, n))
        by_byte = np.argsort(last[starts], kind="stable")
        self.run_byte, self.run_start, self.run_size = last[starts][by_byte].astype(np.int64), starts[by_byte], sizes[by_byte]
        before = np.cumsum(self.run_size) - self.run_size  # as bytes are in order, this is the row of the first context that begins with the run's byte and row
        self.run_row, self.run_key = before, self.run_byte * (n + 1) + self.run_start
        self.first_row = np.searchsorted(np.sort(text), np.arange(257))

    def step(self, rows: np.ndarray, before: np.ndarray) -> np.ndarray:
        """From the interval heads of strings to those of the strings that start one byte before."""
        at = self.short_head[rows]
        run = np.searchsorted(self.run_key, before.astype(np.int64) * (self.n + 1) + at, "right") - 1
        inside = (run >= 0) & (self.run_byte[run] == before)
        return np.where(inside, self.run_row[run] + np.minimum(at - self.run_start[run], self.run_size[run]), self.first_row[before])

    def matches(self, text: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The least documents of all strings of phrases that start at `starts` and have `counts` strings."""
        begin = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        at = starts + counts - 1
        rows, slot, floor = self.row_of[at], begin + counts - 1, begin
        while len(rows):
            out[slot] = self.least[self.interval[rows]]
            more = slot > floor
            rows, slot, floor, at = rows[more], slot[more] - 1, floor[more], at[more] - 1
            rows = self.step(rows, text[at])
        return out


def _first_ranks(text: np.ndarray) -> np.ndarray:
    """Ranks of the places by their next eight bytes (the text goes round)."""
    key = np.zeros(len(text), U64)
    for i in range(8):
        key = (key << U64(8)) | np.roll(text, -i).astype(U64)
    return _rank(key)


def _rank(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    of = key[order]
    out = np.empty(len(key), U64)
    out[order] = np.cumsum(np.append(False, of[1:] != of[:-1])).astype(U64)
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << U64(32)) | b


def _dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _rank(_pair(a, b))


class _Phrases:
    """Phrases of a batch's documents: row, first byte (in the batch), number of strings, anchor, fingerprint."""

    def __init__(self, batch: x.Batch, width: int, k: int) -> None:
        parts = [p for a, b in pieces(batch.offsets, PIECE_BYTES) if (p := _parse(batch, a, b, width, k)) is not None]
        self.row, self.start, self.count, self.anchor, self.print = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3 + (np.empty(0, U64),) * 2


def _parse(batch: x.Batch, a: int, b: int, width: int, k: int) -> tuple[np.ndarray, ...] | None:
    base = batch.offsets[a]
    data, off = batch.data[base : batch.offsets[b]], batch.offsets[a : b + 1] - base
    n = len(data) - width + 1
    if n <= 0:
        return None
    sums = byte_sums(data)
    anchor = sliding_min(window_hashes(sums, k, BASE_BYTES), width - k + 1)[:n]
    new = np.zeros(n + 1, bool)
    new[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=new[1:n])
    # strings that would cross the end of their document belong to none
    full = np.diff(off) >= width
    new[np.minimum(off[:-1][full], n)] = True
    ends = np.minimum(np.maximum(off[1:] - width + 1, off[:-1]), n)
    new[ends] = True
    cuts = np.flatnonzero(new[:n])
    row = np.searchsorted(off, cuts, "right") - 1
    after = np.append(cuts[1:], n)
    real = cuts + width <= off[row + 1]
    row, start, count = row[real], cuts[real], (after - cuts)[real]
    return row + a, start + base, count, anchor[start], span_hashes(sums, start, start + count + width - 1, BASE_BYTES)


def _shared(batch: x.Batch, p: _Phrases, n_buckets: int, answers: dict) -> np.ndarray:
    """Places of the phrases whose anchors other documents have."""
    distinct, within, at = _anchors(p)
    return np.flatnonzero((within | x.read_bits(distinct, n_buckets, answers, 1))[at])


def _anchors(p: _Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    distinct, at = np.unique(p.anchor, return_inverse=True)
    least, most = np.full(len(distinct), NO_ID), np.full(len(distinct), -1)
    np.minimum.at(least, at, p.row)
    np.maximum.at(most, at, p.row)
    return distinct, least < most, at


def _distinct(batch: x.Batch, p: _Phrases, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place for each distinct shared phrase, its least document, and each shared phrase's number."""
    _, first, at = np.unique(p.print[shared], return_index=True, return_inverse=True)
    least = np.full(len(first), NO_ID)
    np.minimum.at(least, at, batch.ids[p.row[shared]])
    return shared[first], least, at


def _split(p: _Phrases, picks: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    bucket = (p.anchor[picks] % U64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
        yield int(bucket[part[0]]), part


def _reply(batches: list[int], columns: list[list[bytes]], width: int) -> Iterator[x.Packed]:
    anchor, count, doc = (np.concatenate([np.frombuffer(b, t) for b in col]) for col, t in zip(columns[:3], (U64, np.int32, np.int64), strict=True))
    count = count.astype(np.int64)
    text = np.frombuffer(b"".join(columns[3]), np.uint8)
    off = np.concatenate([[0], np.cumsum(count + width - 1)])
    prints = mix(_prints(text, off)) + count.astype(U64)
    prints = _told_apart(text, off, prints)
    _, first, at = np.unique(prints, return_index=True, return_inverse=True)
    least = np.full(len(first), NO_ID)
    np.minimum.at(least, at, doc)
    # the dictionary: anchors with several phrases are indexed
    _, group, size = np.unique(anchor[first], return_inverse=True, return_counts=True)
    many = np.flatnonzero(size[group] > 1)
    begin = np.cumsum(count[first]) - count[first]
    found = np.repeat(least, count[first])
    if len(many):
        found_many = _indexed(text, off, first[many], count[first[many]], least[many], width)
        where, _ = gather(np.arange(len(found)), np.append(begin, len(found)), many)
        found[where] = found_many
    bits_at, start = np.append(begin, len(found)), 0
    for batch, col in zip(batches, columns[0], strict=True):
        own = np.arange(start, start + len(col) // 8)
        start += len(own)
        docs, _ = gather(found, bits_at, at[own])
        yield batch, [np.packbits(docs < np.repeat(doc[own], count[own])).tobytes()]


def _told_apart(text: np.ndarray, off: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Names of phrases that are equal only for equal bytes: phrases with one fingerprint are compared, those that differ get names of their own."""
    _, first, at = np.unique(prints, return_index=True, return_inverse=True)
    size = np.diff(off)
    rest = np.flatnonzero(first[at] != np.arange(len(prints)))
    bad = []
    for a in range(0, len(rest), 1 << 12):
        own, other = rest[a : a + (1 << 12)], first[at[rest[a : a + (1 << 12)]]]
        same = size[own] == size[other]
        own, other, wrong = own[same], other[same], own[~same]
        n = size[own]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        equal = text[np.repeat(off[own], n) + inner] == text[np.repeat(off[other], n) + inner]
        ok = np.logical_and.reduceat(equal, np.cumsum(n) - n) if len(own) else np.empty(0, bool)
        bad += [*wrong.tolist(), *own[~ok].tolist()]
    if bad:
        prints = prints.copy()
        names: dict[bytes, int] = {}
        for i in bad:
            prints[i] = names.setdefault(text[off[i] : off[i + 1]].tobytes(), int(mix(np.array([i + 1], U64))[0] ^ prints[i]))
    return prints


def _prints(text: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = []
    for a, b in pieces(off, PIECE_BYTES):
        sums = byte_sums(text[off[a] : off[b]])
        out.append(span_hashes(sums, off[a:b] - off[a], off[a + 1 : b + 1] - off[a], BASE_BYTES))
    return np.concatenate(out) if out else np.empty(0, U64)


def _indexed(text: np.ndarray, off: np.ndarray, picks: np.ndarray, count: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    own, at = gather(text, off, picks)
    starts = at[:-1]
    docs = np.full(len(own), NO_ID)
    where = np.arange(int(count.sum())) + np.repeat(starts - (np.cumsum(count) - count), count)
    docs[where] = np.repeat(least, count)
    return RunLengthIndex(own, docs, width).matches(own, starts, count)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = K, batch_bytes: int = x.BATCH_BYTES, bucket_bytes: int = x.BUCKET_BYTES) -> DataFrame:
    """Every document without the bytes of strings of `width` bytes that start in a document with a smaller id too.

    Returns the id, `n_bytes`, `n_removed`, `spans` (start and end of each removed run) and `kept` (the other bytes).
    """
    if not 8 <= k < width or not 17 <= width <= 64:
        raise ValueError("8 <= k < width and 17 <= width <= 64 are needed")
    c = x.corpus(docs, id_col, text_col, batch_bytes, bucket_bytes)
    n = c.n_buckets

    def ask_anchors(batch: x.Batch) -> Iterator[x.Packed]:
        distinct = np.unique(_Phrases(batch, width, k).anchor)
        for bucket, part in x.split(distinct, n):
            yield bucket, [x.short_keys(distinct[part], n)]

    def ask_phrases(batch: x.Batch, answers: dict) -> Iterator[x.Packed]:
        p = _Phrases(batch, width, k)
        picks, least, _ = _distinct(batch, p, _shared(batch, p, n, answers))
        for bucket, part in _split(p, picks, n):
            at = picks[part]
            sizes = p.count[at] + width - 1
            where = np.arange(int(sizes.sum())) + np.repeat(p.start[at] - (np.cumsum(sizes) - sizes), sizes)
            yield bucket, [p.anchor[at].tobytes(), p.count[at].astype(np.int32).tobytes(), least[part].tobytes(), batch.data[where].tobytes()]

    def make(batch: x.Batch, answers: dict) -> pa.Table:
        p = _Phrases(batch, width, k)
        shared = _shared(batch, p, n, answers)
        picks, least, at = _distinct(batch, p, shared)
        bits, bit_off = [np.empty(0, bool)], np.zeros(len(picks), np.int64)
        total = 0
        for bucket, part in _split(p, picks, n):
            counts = p.count[picks[part]]
            bits.append(np.unpackbits(np.frombuffer(answers[2, bucket][0], np.uint8), count=int(counts.sum())).astype(bool))
            bit_off[part] = total + np.cumsum(counts) - counts
            total += len(bits[-1])
        count = p.count[shared]
        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        gone = np.concatenate(bits)[np.repeat(bit_off[at], count) + inner] | np.repeat(batch.ids[p.row[shared]] > least[at], count)
        strings = (np.repeat(p.start[shared], count) + inner)[gone]
        step = np.zeros(len(batch.data) + 1, np.int32)
        np.add.at(step, strings, 1)
        np.add.at(step, strings + width, -1)
        return _table(batch, np.cumsum(step[:-1]) > 0)

    def _table(batch: x.Batch, gone: np.ndarray) -> pa.Table:
        off = batch.offsets
        edge = np.zeros(len(gone) + 1, bool)
        edge[off] = True
        begins = np.flatnonzero(gone & (np.append(False, ~gone[:-1])[: len(gone)] | edge[:-1] | (np.arange(len(gone)) == 0)))
        ends = np.flatnonzero(gone & (np.append(~gone[1:], True)[: len(gone)] | edge[1:])) + 1
        row = np.searchsorted(off, begins, "right") - 1
        span_off = np.searchsorted(row, np.arange(len(off))).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(begins - off[row]), pa.array(ends - off[row])], names=["start", "end"])
        sums = np.concatenate([[0], np.cumsum(gone)])
        removed = sums[off[1:]] - sums[off[:-1]]
        sizes = np.diff(off)
        kept_off = np.concatenate([[0], np.cumsum(sizes - removed)]).astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(kept_off), pa.py_buffer(np.ascontiguousarray(batch.data[~gone]))])
        return pa.table({id_col: pa.array(batch.ids, pa.int64(), mask=batch.null_ids), "n_bytes": pa.array(sizes), "n_removed": pa.array(removed), "spans": pa.ListArray.from_arrays(span_off, spans), "kept": kept})

    first = x.answer(x.ask(c, ask_anchors, "anchors"), x.elsewhere, "bits", phase=1)
    second = x.answer(x.ask_again(c, first, ask_phrases, "anchor count doc text"), lambda b, cols: _reply(b, cols, width), "bits", phase=2)
    return x.finish(c, first.unionByName(second), make, f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def digests(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return removed.select(id_col, "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
