"""Removal of repeated passages of words, found by recompression.

Rounds of recompression give token sequences names: runs of one symbol become a
symbol, then neighbours whose names fall in the left and the right half of the
alphabet become one (halves are drawn anew in each round from the names). A name is a
64-bit fingerprint of what it stands for, so that every task gives equal substrings
equal names without a table of names, and a round needs no exchange. Each symbol
also carries the interval of words on which its making depends. So a symbol whose
interval lies within a window of words stands in every occurrence of that window, at
the same place.

Spark exchange 1 tells each batch which of its high-level symbols other documents
have. A window can only repeat if all such symbols within it are shared; a window
without any (in long runs of one word, or in periodic text) always stays a
candidate, so no repeat is lost. Exchange 2 verifies candidates by a 96-bit
fingerprint of their words and says whether a smaller document holds the window.

Defined results: null and empty texts have no words; texts shorter than a window keep
all words; of repeated rows (equal ids) neither is smaller, so both keep what only
they hold; a null id counts as the largest; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange as x
from tidemark.llm.tokens import BASE_WORDS, BASE_WORDS_2, NO_ID, U64, mix, pieces, prefix_sums, window_hashes, word_bounds, word_hashes

WINDOW, ROUNDS, LONGEST = 50, 5, 12
PIECE_BYTES = 1 << 19
_FAR = 1 << 40


def symbols(names: np.ndarray, offsets: np.ndarray, rounds: int = ROUNDS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """High-level symbols of rows of token fingerprints: names, and the intervals on which they depend.

    Symbols that depend on a row's edge, or stand in a run too long to be named, have endless intervals.
    """
    n = len(names)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    size = np.ones(n, np.int64)
    low = np.arange(n)
    high = low + 1
    for turn in range(rounds):
        if len(names) < 2:
            break
        # runs
        same = np.zeros(len(names), bool)
        same[1:] = (names[1:] == names[:-1]) & (row[1:] == row[:-1])
        start = np.flatnonzero(~same)
        count = np.diff(np.append(start, len(names)))
        left = np.full(len(names), -_FAR)
        right = np.full(len(names), _FAR)
        next_to = row[1:] == row[:-1]
        left[1:][next_to] = low[:-1][next_to]
        right[:-1][next_to] = high[1:][next_to]
        if len(start) < len(names):
            over = np.repeat((count > 1) & (count * size[start] > longest), count)
            begins = ~same | over
            left[over], right[over] = -_FAR, _FAR
            start = np.flatnonzero(begins)
            count = np.diff(np.append(start, len(names)))
            low, high = np.minimum.reduceat(np.minimum(low, left), start), np.maximum.reduceat(np.maximum(high, right), start)
            names = np.where(count > 1, mix(names[start] + U64(2 * turn + 1) * count.astype(U64)), names[start])
            size, row = size[start] * count, row[start]
        else:
            low, high = np.minimum(low, left), np.maximum(high, right)
        # pairs
        to_right = (mix(names ^ U64(0xA24BAED4963EE407 + turn)) & U64(1)).astype(bool)
        next_to = row[1:] == row[:-1]
        pair = np.zeros(len(names), bool)
        pair[:-1] = ~to_right[:-1] & to_right[1:] & next_to & (size[:-1] + size[1:] <= longest)
        second = np.append(False, pair[:-1])
        alone = ~pair & ~second
        left = np.full(len(names), -_FAR)
        right = np.full(len(names), _FAR)
        left[1:][next_to] = low[:-1][next_to]
        right[:-1][next_to] = high[1:][next_to]
        ends = alone & ~to_right
        high[ends] = np.maximum(high[ends], right[ends])
        starts = alone & to_right
        low[starts] = np.minimum(low[starts], left[starts])
        at = np.flatnonzero(pair)
        names[at] = mix(names[at] * U64(0x9FB21C651E98DF25) + names[at + 1] + U64(turn))
        size[at] += size[at + 1]
        low[at] = np.minimum(low[at], low[at + 1])
        high[at] = np.maximum(high[at], high[at + 1])
        keep = ~second
        names, size, row, low, high = names[keep], size[keep], row[keep], low[keep], high[keep]
    return names, low, high


class _Windows:
    """Windows of the rows of a piece of a batch, and the symbols that stand in them."""

    def __init__(self, batch: x.Batch, a: int, b: int, width: int) -> None:
        self.data = batch.data[batch.offsets[a] : batch.offsets[b]]
        self.starts, self.ends, self.words = word_bounds(self.data, batch.offsets[a : b + 1] - batch.offsets[a])
        self.row = np.repeat(np.arange(a, b), np.diff(self.words))
        self.tokens = word_hashes(self.data, self.starts, self.ends)
        n = max(0, len(self.tokens) - width + 1)
        self.valid = self.row[:n] == self.row[width - 1 :][:n] if n else np.zeros(0, bool)
        names, low, high = symbols(self.tokens.copy(), self.words)
        first, last = np.repeat(self.words[:-1], np.diff(self.words)), np.repeat(self.words[1:], np.diff(self.words))
        within = (high - low <= width) & (low >= 0)
        names, low, high = names[within], low[within], high[within]
        within = high <= last[low] if len(low) else within[:0]
        self.names, self.low, self.high = names[within], low[within], high[within]
        self.first, self.width = first, width

    def holding(self, marked: np.ndarray) -> np.ndarray:
        """How many of the marked symbols each window holds."""
        step = np.zeros(len(self.valid) + 1, np.int64)
        low, high = self.low[marked], self.high[marked]
        begin = np.maximum(high - self.width, self.first[low]) if len(low) else low
        inside = begin < len(self.valid)
        np.add.at(step, begin[inside], 1)
        np.add.at(step, np.minimum(low[inside] + 1, len(self.valid)), -1)
        return np.cumsum(step[:-1])

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = window_hashes(prefix_sums(self.tokens, BASE_WORDS), self.width, BASE_WORDS)
        two = window_hashes(prefix_sums(mix(self.tokens), BASE_WORDS_2), self.width, BASE_WORDS_2)
        return one[at], two[at]


def _pieces(batch: x.Batch, width: int) -> Iterator[_Windows]:
    for a, b in pieces(batch.offsets, PIECE_BYTES):
        yield _Windows(batch, a, b, width)


def _names(found: list[_Windows]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct symbols of a batch, whether two of its documents have them, and each occurrence's number."""
    names = np.concatenate([w.names for w in found])
    rows = np.concatenate([w.row[w.low] for w in found])
    distinct, at = np.unique(names, return_inverse=True)
    least, most = np.full(len(distinct), _FAR), np.full(len(distinct), -1)
    np.minimum.at(least, at, rows)
    np.maximum.at(most, at, rows)
    return distinct, least < most, at


def _candidates(batch: x.Batch, found: list[_Windows], n_buckets: int, answers: dict) -> list[np.ndarray]:
    """Places of the windows all of whose symbols other documents have."""
    distinct, within, at = _names(found)
    shared = (within | x.read_bits(distinct, n_buckets, answers, 1))[at]
    out, start = [], 0
    for w in found:
        own = shared[start : start + len(w.names)]
        start += len(w.names)
        out.append(np.flatnonzero(w.valid & (w.holding(~own) == 0)))
    return out


def _window_keys(batch: x.Batch, found: list[_Windows], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a batch's candidates with their second halves and least documents; each candidate's number and document."""
    both = [w.keys(p) for w, p in zip(found, places, strict=True)]
    one = np.concatenate([k for k, _ in both])
    docs = np.concatenate([batch.ids[w.row[p]] for w, p in zip(found, places, strict=True)]) if len(one) else np.empty(0, np.int64)
    distinct, first, at = np.unique(one, return_index=True, return_inverse=True)
    least = np.full(len(distinct), NO_ID)
    np.minimum.at(least, at, docs)
    return distinct, np.concatenate([k for _, k in both])[first], least, at, docs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, batch_bytes: int = x.BATCH_BYTES, bucket_bytes: int = x.BUCKET_BYTES) -> DataFrame:
    """Every document without the words of windows that start in a document with a smaller id too.

    Returns the id, `n_words`, `n_removed` and `kept` (the other words joined by one space).
    """
    c = x.corpus(docs, id_col, text_col, batch_bytes, bucket_bytes)
    n = c.n_buckets

    def ask_symbols(batch: x.Batch) -> Iterator[x.Packed]:
        distinct, _, _ = _names(list(_pieces(batch, window)))
        for bucket, part in x.split(distinct, n):
            yield bucket, [x.short_keys(distinct[part], n)]

    def ask_windows(batch: x.Batch, answers: dict) -> Iterator[x.Packed]:
        found = list(_pieces(batch, window))
        one, two, least, _, _ = _window_keys(batch, found, _candidates(batch, found, n, answers))
        for bucket, part in x.split(one, n):
            yield bucket, [one[part].tobytes(), two[part].astype(np.uint32).tobytes(), least[part].tobytes()]

    def reply(batches: list[int], columns: list[list[bytes]]) -> Iterator[x.Packed]:
        one, two, least = (np.concatenate([np.frombuffer(b, t) for b in col]) for col, t in zip(columns, (U64, np.uint32, np.int64), strict=True))
        _, key = np.unique(mix(one) + two.astype(U64), return_inverse=True)  # 96 bits meet in 64: a bucket is small
        bits, start = x.smaller_elsewhere(key, least), 0
        for batch, part in zip(batches, columns[0], strict=True):
            yield batch, [np.packbits(bits[start : start + len(part) // 8]).tobytes()]
            start += len(part) // 8

    def make(batch: x.Batch, answers: dict) -> pa.Table:
        found = list(_pieces(batch, window))
        places = _candidates(batch, found, n, answers)
        one, _, least, at, docs = _window_keys(batch, found, places)
        gone = x.read_bits(one, n, answers, 2)[at] | (docs > least[at])
        counts, removed, texts, start = [], [], [], 0
        for w, p in zip(found, places, strict=True):
            marks = p[gone[start : start + len(p)]]
            start += len(p)
            step = np.zeros(len(w.tokens) + 1, np.int64)
            np.add.at(step, marks, 1)
            np.add.at(step, marks + window, -1)
            keep = np.cumsum(step[:-1]) == 0
            rows = len(w.words) - 1
            row = np.repeat(np.arange(rows), np.diff(w.words))
            left = np.bincount(row[keep], minlength=rows)
            counts.append(np.diff(w.words))
            removed.append(counts[-1] - left)
            texts.append(_join(w, keep, left))
        table = {id_col: pa.array(batch.ids, pa.int64(), mask=batch.null_ids), "n_words": pa.array(np.concatenate(counts)), "n_removed": pa.array(np.concatenate(removed))}
        return pa.table(table | {"kept": pa.chunked_array(texts, pa.string())})

    first = x.answer(x.ask(c, ask_symbols, "symbols"), x.elsewhere, "bits", phase=1)
    second = x.answer(x.ask_again(c, first, ask_windows, "one two least"), reply, "bits", phase=2)
    return x.finish(c, first.unionByName(second), make, f"`{id_col}` bigint, n_words bigint, n_removed bigint, kept string")


def _join(w: _Windows, keep: np.ndarray, left: np.ndarray) -> pa.Array:
    """The kept words of each row joined by one space."""
    begin, sizes = w.starts[keep], (w.ends - w.starts)[keep] + 1
    out = np.concatenate([[0], np.cumsum(sizes)])
    where = np.arange(out[-1]) + np.repeat(begin - out[:-1], sizes)
    data = w.data[np.minimum(where, max(len(w.data) - 1, 0))]
    data[out[1:] - 1] = 32
    row_ends = out[np.cumsum(left)]
    full = left > 0
    mask = np.ones(len(data), bool)
    mask[row_ends[full] - 1] = False
    offsets = np.concatenate([[0], row_ends - np.cumsum(full)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(left), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[mask]))])


def digests(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return removed.select(id_col, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
