"""Runs of periodic words, found by suffix trees, and texts without the repetition.

A run is a stretch of consecutive words with smallest period q and length max(6, 4 * q)
or more that no neighbouring word extends keeping the period. All runs of every text are
found: for each of a text's two alphabet orders, a run contains the longest Lyndon word
that starts at some place as its root (the runs theorem). So the candidates are two
Lyndon words for each place, found from the order of the suffixes. Each is extended to the right by the
longest common extension of its start and end, to the left by that of the reversal.

The extensions come from suffix trees that Ukkonen's algorithm builds of a document's words
and of their reversal. An Euler tour of a tree and a table of minima over the tour's string
depths answer each extension in constant time, for all candidates at once.

Only stretches that may hold a run go into the trees. All words of a run but those of its
last period are followed by themselves within q places, so a run with q in
(2**(k - 1), 2**k] lies within a stretch of 3 * (2**(k - 1) + 1) words or more that
recur within 2**k places, continued by 2**k words. What isn't in such a stretch is in no
run, and the word before or after a stretch extends none. A document's stretches are laid end to end with
separators that occur once.

Rows are independent: there is no shuffle, and a task holds PIECE_BYTES of text or one
document. A tree needs some 500 bytes a word of the stretches. Null and empty texts have no
words and no run; a null id is kept as it is; repeated rows give repeated rows; an empty table gives an
empty result; columns other than id and text are ignored, whatever their names. Words are compared by
64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.binding import let
from tidemark.llm.tokens import U64, byte_view, mix, pieces, word_bounds, word_hashes

MIN_LENGTH, MIN_EXPONENT = 6, 4
PIECE_BYTES = 1 << 19
#: Java's pattern of the white space between words.
GAP = r"[\x20\x09-\x0D]+"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class SuffixTree:
    """The suffix tree of a list of symbols whose last one occurs once; leaf j is the j-th that was made."""

    def __init__(self, symbols: list[int]) -> None:
        self.symbols = symbols
        start, end, link, kids = [0], [0], [0], [{}]
        self.start, self.end, self.kids = start, end, kids
        self.leaves: list[int] = []
        n, node, edge, length, waiting = len(symbols), 0, 0, 0, 0
        for i, c in enumerate(symbols):
            waiting += 1
            made = 0  # the inner node that waits for its suffix link
            while waiting:
                if not length:
                    edge = i
                first = symbols[edge]
                child = kids[node].get(first)
                if child is None:
                    kids[node][first] = len(start)
                    self.leaves.append(len(start))
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    kids.append(None)
                    if made:
                        link[made] = node
                        made = 0
                else:
                    own = (end[child] if end[child] <= i else i + 1) - start[child]
                    if length >= own:  # down the edge
                        edge += own
                        length -= own
                        node = child
                        continue
                    at = start[child] + length
                    if symbols[at] == c:
                        length += 1
                        if made:
                            link[made] = node
                        break
                    split = len(start)
                    kids[node][first] = split
                    start += (start[child], i)
                    end += (at, n)
                    link += (0, 0)
                    kids += ({symbols[at]: child, c: split + 1}, None)
                    start[child] = at
                    self.leaves.append(split + 1)
                    if made:
                        link[made] = split
                    made = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1

    def tour(self, sort: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The Euler tour's string depths, each suffix's first place in it, and (with `sort`) the suffixes' ranks."""
        start, end, kids = self.start, self.end, self.kids
        depth, order, tour, first, stack = [0] * len(start), [], [], [0] * len(start), [0]
        while stack:
            node = stack.pop()
            if node < 0:
                tour.append(depth[~node])
                continue
            below = kids[node]
            if below is None:
                first[node] = len(tour)
                order.append(node)
            else:
                own = depth[node]
                for symbol in sorted(below, reverse=True) if sort else below:
                    child = below[symbol]
                    depth[child] = own + end[child] - start[child]
                    stack += (~node, child)
            tour.append(depth[node])
        leaves = np.array(self.leaves)
        rank = np.zeros(len(start), np.int64)
        rank[order] = np.arange(len(order))
        return np.array(tour, np.int32), np.array(first, np.int64)[leaves], rank[leaves]

    def reverse_ranks(self) -> np.ndarray:
        """The suffixes' ranks under the reversed alphabet, where the least symbol (the last one) stays least."""
        kids, order, stack = self.kids, [], [0]
        least = self.symbols[-1]
        while stack:
            node = stack.pop()
            below = kids[node]
            if below is None:
                order.append(node)
                continue
            stack += [below[s] for s in sorted(below) if s != least]
            if least in below:
                stack.append(below[least])
        rank = np.zeros(len(kids), np.int64)
        rank[order] = np.arange(len(order))
        return rank[np.array(self.leaves)]


class Extensions:
    """Longest common extensions of suffixes: least depths between their places in an Euler tour."""

    def __init__(self, tour: np.ndarray, first: np.ndarray) -> None:
        self.first, self.table = first, [tour]
        span = 1
        while 2 * span <= len(tour):
            low = self.table[-1]
            self.table.append(np.minimum(low[:-span], low[span:]))
            span *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.first[a], self.first[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            own = level == k
            row = self.table[k]
            out[own] = np.minimum(row[low[own]], row[high[own] + 1 - (1 << int(k))])
        return out


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next place with a smaller rank (the end if there is none): the end of the longest Lyndon word that starts at a place."""
    values, out, stack = rank.tolist(), [len(rank)] * len(rank), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(symbols: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of a list of symbols, positive numbers, by start and period."""
    n = len(symbols)
    forward = SuffixTree([*symbols.tolist(), 0])
    tour, first, rank = forward.tour(sort=True)
    right = Extensions(tour, first)
    ends = np.concatenate([_next_smaller(rank)[:n], _next_smaller(forward.reverse_ranks())[:n]])
    del forward
    i = np.tile(np.arange(n), 2)
    left = Extensions(*SuffixTree([*symbols[::-1].tolist(), 0]).tour(sort=False)[:2])
    p = ends - i
    wide = np.flatnonzero(2 * p <= n)  # a longer root isn't met again
    i, p = i[wide], p[wide]
    after = np.where(ends[wide] < n, right(i, np.minimum(ends[wide], n - 1)), 0)
    # the reversal has the place x at n - 1 - x; the place before the first one is its sentinel
    before = np.where(i > 0, left(n - np.maximum(i, 1), n - i - p), 0)
    length = before + p + after
    ok = length >= np.maximum(MIN_LENGTH, MIN_EXPONENT * p)
    return np.unique(np.stack([(i - before)[ok], p[ok], length[ok]], axis=1), axis=0)[:, [0, 2, 1]]


def stretches(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which words of the texts (hashes end to end, len + 1 offsets) may stand in a run."""
    n = len(hashes)
    marks = np.zeros(n + 1, np.int32)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.argsort(mix(hashes ^ row.astype(U64) * U64(0x9E3779B97F4A7C15)), kind="stable")
    again = np.full(n, np.iinfo(np.int64).max)
    same = (hashes[order[1:]] == hashes[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    ends = offsets[1:]
    most, k = int(np.diff(offsets).max(initial=0)) // MIN_EXPONENT, 0
    while n and (1 << k >> 1) < most:  # some period in (2**(k - 1), 2**k] fits
        least_q = (1 << k >> 1) + 1
        need = max(MIN_LENGTH - (1 << k), (MIN_EXPONENT - 1) * least_q)
        alive = again <= 1 << k
        # a text's last word recurs nowhere, so a stretch ends with its text
        edge = np.diff(alive.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - begin >= need
        begin, end = begin[long], end[long]
        if len(begin):
            np.add.at(marks, begin, 1)
            np.add.at(marks, np.minimum(end + (1 << k), ends[row[begin]]), -1)
        k += 1
    return np.cumsum(marks[:n]) > 0


def _runs_of_texts(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (start, length, period) of each text's runs end to end, places counted from its first word, and len + 1 offsets."""
    within = stretches(hashes, offsets)
    places = np.flatnonzero(within)
    counts, found = np.zeros(len(offsets) - 1, np.int64), []
    cuts = np.searchsorted(places, offsets)
    for row in np.flatnonzero(np.diff(cuts)):
        own = places[cuts[row] : cuts[row + 1]]
        _, symbols = np.unique(hashes[own], return_inverse=True)
        gaps = np.flatnonzero(np.diff(own) > 1) + 1
        # a separator after each stretch but the last
        at = np.arange(len(own)) + np.searchsorted(gaps, np.arange(len(own)), "right")
        laid = np.arange(len(own) + len(gaps)) + len(own) + 1
        laid[at] = symbols + 1
        runs = runs_of(laid)
        if len(runs):
            runs[:, 0] = own[np.searchsorted(at, runs[:, 0])] - offsets[row]
            counts[row] = len(runs)
            found.append(runs)
    return np.concatenate(found) if found else np.empty((0, 3), np.int64), np.concatenate([[0], np.cumsum(counts)])


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    before = np.concatenate([[0], np.cumsum(kept)])[offsets]
    starts, ends = starts[kept], ends[kept]
    last = np.zeros(len(starts) + 1, bool)
    last[before[1:] - 1] = True  # of a text without words: the last one of some text before it, or the spare place
    room = ends - starts + ~last[:-1]
    to = np.concatenate([[0], np.cumsum(room)])
    out = np.full(int(to[-1]), 0x20, np.uint8)
    size = ends - starts
    put = np.repeat(to[:-1] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    out[put] = data[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(to[before])), pa.py_buffer(out)).cast(pa.string())


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: its id, `n_words`, `runs` (array of start, length, period, by start and period) and `collapsed`.

    `collapsed` has the words, joined by one space, that no run contains after that run's first period.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(byte_view(batch.column(1))[1], PIECE_BYTES):
                data, off = byte_view(batch.column(1).slice(a, b - a))
                starts, ends, words = word_bounds(data, off)
                runs, at = _runs_of_texts(word_hashes(data, starts, ends), words)
                first = runs[:, 0] + np.repeat(words[:-1], np.diff(at))
                cover = np.zeros(len(starts) + 1, np.int32)
                np.add.at(cover, first + runs[:, 2], 1)
                np.add.at(cover, first + runs[:, 1], -1)
                kept = np.cumsum(cover[:-1]) == 0
                items = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in range(3)], names=["start", "length", "period"])
                listed = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), items)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(words)), listed.cast(_RUNS), _joined(data, starts, ends, kept, words)], names=["doc", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return found.withColumnRenamed("doc", id_col)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of which a tenth, chosen by the ids' checksums, repeats itself from some word on; rows (id, text).

    With h the checksum of the decimal id and g = h div 10: if h is divisible by 10, each of the n words from a = g % n on becomes word
    a + (i - a) % p of the original, p = 1 + (n - a) div (3 + g % 8). Texts of other ids, of null ids and texts without words stay.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    text = F.col(text_col).cast("string")

    def repeated(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    words = F.filter(F.split(text, GAP), lambda x: x != "")
    return docs.select(F.col(id_col), F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), let(words, repeated)).otherwise(text).alias(text_col))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """find_runs() with the longest run and digests of all runs and of the collapsed text."""
    runs = F.col("runs")
    longest = F.get(F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    listed = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    out = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), "n_words", longest.alias("best"), F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").alias("listed"), "collapsed")
    length = -F.col("best.minus")
    return out.select(
        id_col, "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.expr("(1000 * -best.minus) div best.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
