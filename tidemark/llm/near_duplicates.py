"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's set holds its distinct shingles of words. Its signature has SYMBOLS
MinHash symbols of 16 bits, and the distance of two signatures is the number of symbols
that differ. It is cut into CHUNKS chunks of CHUNK symbols: by the pigeonhole principle
two signatures at distance 2 * CHUNKS - 1 or less have a chunk with one error at most.
Every chunk enumerates that error's place: a key is the chunk without one symbol. So
all pairs within distance 31 of 64 meet under a key, for sure; no other screen drops a
pair. At similarity 0.8 the distance is 12.8 on average and above 31 in about one pair of
10**8.

Documents with equal sets are one class from the start (an aggregation); only class
representatives go on. Links are sought in two steps, so that a key with many copies
costs no pair of copies. First each member of a key meets the key's hub, the member
nearest to the majority of the members' bits; a document's BEST most frequent hubs are
compared on full sets, which gives components. Then only keys whose members are in
several components are open: members outside a key's largest component meet all its members
of other components, in cells of bounded size. Cells of signatures come first: they
leave those members that have a pair within the distance under no earlier key. These are
compared on full sets, and a cell returns a spanning forest of what it links. So every
pair within the distance is either compared on full sets or already in one component, in
one round, without a cap.

Hot keys: a list that may exceed HOT members is dealt over salts before any task holds it
(counted beforehand by ranges of keys); its parts' hubs meet in a second grouping.

Defined results: a null or empty text, or one without words, has an empty set and is
linked with nothing; fewer words than a shingle make one shingle; rows with one id
count as one document for links; rows without id are returned, unlinked; an empty
table gives an empty result; other columns are ignored. `docs` is read three times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bitmap, components, in_bitmap, released, written
from tidemark.llm.tokens import BASE_WORDS, U64, ascii_lower, byte_view, mix, pieces, prefix_sums, span_hashes, word_bounds, word_hashes

SHINGLE, SIMILARITY = 5, 80
SYMBOLS, CHUNK = 64, 4
CHUNKS = SYMBOLS // CHUNK
#: Hubs of a document that are compared first, of those whose lowest bits differ from its own in NEAR_BITS places at most (others are left to the second step).
BEST, NEAR_BITS = 2, 20
PIECE_BYTES, BUCKET_ENTRIES, HOT, SALTS, HUB_LINKS = 1 << 19, 200_000, 100_000, 16, 500
DISTANCE = 2 * CHUNKS - 1
#: A cell's rows and bytes on each side, about; bytes of a set's fingerprint in a cell (40 bits: a cell has 10**6 of them at most).
BLOCK_ROWS, BLOCK_BYTES, SLICE, FINGERPRINT = 2048, 1 << 21, 1 << 14, 5
_A = mix(np.arange(1, SYMBOLS + 1, dtype=U64)) | U64(1)
_X = mix(np.arange(SYMBOLS + 1, 2 * SYMBOLS + 1, dtype=U64))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the distinct shingles of each text end to end, and len + 1 offsets."""
    data, off = byte_view(texts)
    data = ascii_lower(data)
    starts, ends, words = word_bounds(data, off)
    sums = prefix_sums(word_hashes(data, starts, ends), BASE_WORDS)
    sizes = np.diff(words)
    count = np.where(sizes > 0, np.maximum(sizes - width + 1, 1), 0)
    row = np.repeat(np.arange(len(sizes)), count)
    begin = np.repeat(words[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    hashes = span_hashes(sums, begin, begin + np.repeat(np.minimum(sizes, width), count), BASE_WORDS)
    _, first = np.unique(mix(hashes ^ row.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)
    first.sort()
    return hashes[first], np.searchsorted(row[first], np.arange(len(sizes) + 1))


def _symbols(sets: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the non-empty sets: their rows, and their symbols."""
    rows = np.flatnonzero(np.diff(off) > 0)
    out = np.empty((len(rows), SYMBOLS), np.uint16)
    for i in range(SYMBOLS if len(rows) else 0):
        out[:, i] = mix(np.minimum.reduceat((sets ^ _X[i]) * _A[i], off[rows])) & U64(0xFFFF)
    return rows, out


def _keys(symbols: np.ndarray) -> np.ndarray:
    """The keys of signatures: each chunk without each of its symbols."""
    wide, keys = symbols.astype(U64), np.empty((len(symbols), SYMBOLS), U64)
    for at in range(SYMBOLS):
        key = np.full(len(symbols), at + 1, U64)
        for i in range(at - at % CHUNK, at - at % CHUNK + CHUNK):
            if i != at:
                key = (key << U64(16)) | wide[:, i]
        keys[:, at] = mix(key)
    return keys


def _lowest(symbols: np.ndarray) -> np.ndarray:
    """The lowest bits of all symbols."""
    return np.packbits((symbols & 1).astype(bool), axis=1, bitorder="little").view(U64).ravel()


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Rows (`doc`, `n`, `p1`, `p2`, `symbols`): set size, set fingerprint (two sums), packed symbols (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in pieces(byte_view(texts)[1], PIECE_BYTES):
                sets, off = shingle_sets(texts.slice(a, b - a), width)
                rows, symbols = _symbols(sets, off)
                sums = np.zeros((2, b - a), np.int64)
                packed: list[bytes | None] = [None] * (b - a)
                if len(rows):
                    for i in range(2):
                        sums[i, rows] = np.add.reduceat(mix(sets + U64(i)), off[rows]).view(np.int64)
                    for i, row in enumerate(rows.tolist()):
                        packed[row] = symbols[i].tobytes()
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(off)), pa.array(sums[0]), pa.array(sums[1]), pa.array(packed, pa.binary())], names=["doc", "n", "p1", "p2", "symbols"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc bigint, n bigint, p1 bigint, p2 bigint, symbols binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))


def _picked(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The `texts` of documents in `ids` (`doc`), and of few others; no text is shuffled for it, a bitmap of the ids is broadcast (bounded)."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("doc").alias("key")).distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(shared.value, np.asarray(batch.column(2)).view(U64)))).select([0, 1])

    return texts.filter("doc IS NOT NULL").select("doc", "text", F.xxhash64("doc").alias("key")).mapInArrow(run, "doc bigint, text string")


_ENTRY = np.dtype([("key", "<u4"), ("doc", "<i8"), ("bits", "<u8"), ("n", "<u4"), ("at", "u1")])


def _signed(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("symbols").to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _hot_ranges(classes: DataFrame, n_ranges: int, hot: int) -> dict[int, int]:
    """Ranges of keys with more than `hot` entries, and how many salts they need: no key outside has a longer list.

    The ranges are counted in the tasks and summed by Spark. With entries / hot * 8 ranges only those
    with a hot key come out, so what reaches the driver is bounded by the number of such keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ranges, np.int64)
        for batch in batches:
            total += np.bincount((_keys(_signed(batch)) % U64(n_ranges)).astype(np.int64).ravel(), minlength=n_ranges)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["at", "n"])

    found = classes.select("symbols").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).filter(F.col("n") > hot)
    return {r["at"]: -(-r["n"] // hot) for r in found.collect()}


def _entries(classes: DataFrame, n_buckets: int, n_ranges: int, hot: dict[int, int]) -> DataFrame:
    """The representatives' keys, packed by bucket; salt is 0, or 1 and more for parts of hot ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = np.zeros(n_ranges, np.int64)
        salts[list(hot)] = list(hot.values())
        for batch in batches:
            docs, n, symbols = np.asarray(batch.column("doc")), np.asarray(batch.column("n")), _signed(batch)
            keys = _keys(symbols)
            out = np.empty(keys.shape, _ENTRY)
            out["key"] = (keys // U64(n_buckets)).astype(np.uint32)
            out["doc"], out["bits"], out["n"], out["at"] = docs[:, None], _lowest(symbols)[:, None], np.minimum(n, 0xFFFFFFFF)[:, None], np.arange(SYMBOLS)[None]
            parts = salts[(keys % U64(n_ranges)).astype(np.int64)]
            salt = np.where(parts > 0, 1 + (mix(docs.astype(U64))[:, None] % np.maximum(parts, 1).astype(U64)).astype(np.int64), 0)
            yield _dealt((keys % U64(n_buckets)).astype(np.int64).ravel(), salt.ravel(), out.ravel())

    return classes.select("doc", "n", "symbols").mapInArrow(run, "bucket int, salt int, entries binary")


def _dealt(bucket: np.ndarray, salt: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((salt, bucket))
    cuts = np.flatnonzero((np.diff(bucket[order]) != 0) | (np.diff(salt[order]) != 0)) + 1
    parts = np.split(order, cuts) if len(order) else []
    first = np.array([p[0] for p in parts], np.int64)
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(salt[first].astype(np.int32)), pa.array([entries[p].tobytes() for p in parts], pa.binary())], names=["bucket", "salt", "entries"])


def _hubs(e: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The place of each key's member nearest to the majority of its members' bits (the least document of two)."""
    major = np.zeros(len(start), U64)
    for i in range(64 if len(e) else 0):
        ones = np.add.reduceat(((e["bits"] >> U64(i)) & U64(1)).astype(np.int64), start)
        major |= (2 * ones > size).astype(U64) << U64(i)
    away = np.bitwise_count(e["bits"] ^ np.repeat(major, size)).astype(np.int64)
    return np.minimum.reduceat(np.where(np.repeat(size > 2, size), away, 0) << 40 | np.arange(len(e)), start) & ((1 << 40) - 1) if len(e) else start


def _groups(entries: DataFrame, percent: int) -> DataFrame:
    """Of each bucket and salt: packed first links (`u`, `v`), member lists (`docs`, `sizes`, `names`, places of their keys `ats`), and for salted ones the hubs as entries."""

    def run(table: pa.Table) -> pa.Table:
        bucket, salt = table["bucket"][0].as_py(), table["salt"][0].as_py()
        e = np.frombuffer(b"".join(table["entries"].to_pylist()), _ENTRY)
        # lists are of a key at its place: entries keep 32 bits of a key, so that keys of two places may be equal
        e = e[np.lexsort((e["doc"], e["at"], e["key"]))]
        other = np.append(True, (e["key"][1:] != e["key"][:-1]) | (e["at"][1:] != e["at"][:-1]))
        e, other = (x[other | np.append(True, e["doc"][1:] != e["doc"][:-1])] for x in (e, other))
        start = np.flatnonzero(other)
        size = np.diff(np.append(start, len(e)))
        hubs = _hubs(e, start, size)
        leader = e[np.repeat(hubs, size)]
        small, large = (f(leader["n"], e["n"]).astype(np.int64) for f in (np.minimum, np.maximum))
        ok = (leader["doc"] != e["doc"]) & (100 * small >= percent * large) & (np.bitwise_count(leader["bits"] ^ e["bits"]) <= NEAR_BITS)
        # a whole list is named by its members, so equal lists of other keys come once; a part of a list by its key
        names = mix(np.add.reduceat(mix(e["doc"].astype(U64)), start)) if salt == 0 else mix(mix(U64(bucket << 32) ^ e["key"][start].astype(U64)) ^ e["at"][start].astype(U64))
        listed = size > (1 if salt == 0 else 0)
        if salt == 0:  # the one of the first key
            order = np.flatnonzero(listed)[np.lexsort((e["at"][start[listed]], names[listed]))]
            listed[order[1:][names[order[1:]] == names[order[:-1]]]] = False
        packed = (leader["doc"][ok], e["doc"][ok], e["doc"][np.repeat(listed, size)], size[listed].astype(np.int64), names[listed], e["at"][start[listed]], e[hubs] if salt else e[:0])
        return pa.table({"bucket": pa.array([bucket], pa.int32())} | {k: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for k, x in zip(("u", "v", "docs", "sizes", "names", "ats", "hubs"), packed, strict=True)})

    return entries.groupBy("bucket", "salt").applyInArrow(run, "bucket int, u binary, v binary, docs binary, sizes binary, names binary, ats binary, hubs binary")


def _first_links(groups: DataFrame) -> DataFrame:
    """Each document with its BEST hubs: those of most of its keys (`u`: hub, `v`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.int64) for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    times = groups.select("u", "v").mapInArrow(run, "u bigint, v bigint").groupBy("u", "v").agg(F.count("*").alias("n"))
    # a document has SYMBOLS hubs at most
    best = times.groupBy("v").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "u")), False), 1, BEST).alias("best"))
    return best.select("v", F.explode("best.u").alias("u"))


def _members(groups: DataFrame) -> DataFrame:
    """Rows (`name`, `at`, `doc`) of the lists with two members or more; equal lists come once, for their first key."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, sizes, names, ats in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ends = 8 * np.cumsum(np.frombuffer(sizes, np.int64))
                parts = [docs[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)] if len(ends) else []
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(names, np.int64)), pa.array(np.frombuffer(ats, np.uint8).astype(np.int32)), pa.array(parts, pa.binary())], names=["name", "at", "docs"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(2).to_pylist()
            name, at = (np.repeat(np.asarray(batch.column(i)), [len(d) // 8 for d in docs]) for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(at), pa.array(np.frombuffer(b"".join(docs), np.int64))], names=["name", "at", "doc"])

    packed = groups.select("docs", "sizes", "names", "ats").mapInArrow(lists, "name bigint, at int, docs binary")
    once = packed.groupBy("name", "docs").agg(F.min("at").alias("at")).select("name", "at", "docs")
    return once.mapInArrow(rows, "name bigint, at int, doc bigint")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """`doc`, `shingles`: packed fingerprints of the documents' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(byte_view(batch.column(1))[1], PIECE_BYTES):
                sets, off = shingle_sets(batch.column(1).slice(a, b - a), width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([np.ascontiguousarray(sets[off[i] : off[i + 1]].view(np.uint8).reshape(-1, 8)[:, :FINGERPRINT]).tobytes() for i in range(b - a)], pa.binary())], names=["doc", "shingles"])

    return texts.select("doc", "text").mapInArrow(run, "doc bigint, shingles binary")


def common_counts(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """The sizes of the intersections of packed sets: a row for each of `one`, a column for each of `two`."""
    size = [np.array([len(x) // FINGERPRINT for x in side], np.int64) for side in (one, two)]
    flat = np.zeros((int(size[0].sum() + size[1].sum()), 8), np.uint8)
    flat[:, :FINGERPRINT] = np.frombuffer(b"".join([*one, *two]), np.uint8).reshape(-1, FINGERPRINT)
    flat = flat.view(U64).ravel()
    distinct, at = np.unique(flat, return_inverse=True)
    cut = int(size[0].sum())
    at, row = (at[:cut], at[cut:]), [np.repeat(np.arange(len(s)), s) for s in size]
    times = [np.bincount(a, minlength=len(distinct)) for a in at]
    out = np.zeros((len(one), len(two)), np.int32)
    pairs = times[0] * times[1]
    dense = pairs * 512 > len(one) * len(two)  # bits of a slice cost less than pairs
    number = np.cumsum(dense) - 1
    for low in range(0, int(dense.sum()), SLICE):
        bits = []
        for a, r, s in zip(at, row, (one, two), strict=True):
            own = dense[a] & (number[a] >= low) & (number[a] < low + SLICE)
            grid = np.zeros((len(s), min(SLICE, -(-(int(dense.sum()) - low) // 64) * 64)), bool)
            grid[r[own], number[a[own]] - low] = True
            bits.append(np.packbits(grid, axis=1).view(U64))
        step = max(1, (1 << 22) // max(1, bits[1].size))
        for i in range(0, len(one), step):
            out[i : i + step] += np.bitwise_count(bits[0][i : i + step, None] & bits[1][None]).sum(2, dtype=np.int32)
    # the others: pairs of rows by shingle
    rest = (pairs > 0) & ~dense
    own = [np.flatnonzero(rest[a]) for a in at]
    left, right = (r[o][np.argsort(a[o], kind="stable")] for a, r, o in zip(at, row, own, strict=True))
    n_left, n_right = times[0][rest], times[1][rest]
    first_left, first_right = np.cumsum(n_left) - n_left, np.cumsum(n_right) - n_right
    total = np.concatenate([[0], np.cumsum(n_left * n_right)])
    a = 0
    while a < len(n_left):
        b = max(a + 1, int(np.searchsorted(total, total[a] + (1 << 20), "right")) - 1)
        m = (n_left * n_right)[a:b]
        inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        width = np.repeat(n_right[a:b], m)
        x, y = left[np.repeat(first_left[a:b], m) + inner // width], right[np.repeat(first_right[a:b], m) + inner % width]
        np.add.at(out, (x, y), 1)
        a = b
    return out


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (`u`, `v`) as stars: each node that isn't the least of its component, with the least."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = np.minimum(new, new[label])
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[label[moved]], nodes[moved]


def _cell_links(cells: DataFrame, percent: int) -> DataFrame:
    """Links between components (`u`, `v`: roots) of the cells' rows: `name`, `a`, `b`, `asks`, `root`, `shingles`."""

    def run(table: pa.Table) -> pa.Table:
        asks = np.asarray(table["asks"])
        root = [np.asarray(table["root"].filter(pa.array(m))) for m in (asks, ~asks)]
        sets = [table["shingles"].filter(pa.array(m)).to_pylist() for m in (asks, ~asks)]
        u = v = np.empty(0, np.int64)
        if len(sets[0]) and len(sets[1]):
            common = common_counts(*sets)
            n = [np.array([len(x) // FINGERPRINT for x in s], np.int32) for s in sets]
            union = n[0][:, None] + n[1][None] - common
            i, j = np.nonzero((root[0][:, None] != root[1][None]) & (common > 0) & (100 * common >= percent * union))
            u, v = forest(root[0][i], root[1][j])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return cells.groupBy("name", "a", "b").applyInArrow(run, "u bigint, v bigint")


def _candidates(cells: DataFrame, percent: int) -> DataFrame:
    """Rows (`name`, `doc`) of the cells that have a pair of two components within DISTANCE, under no earlier key. cells: `asks`, `at`, `doc`, `root`, `n`, `symbols`."""

    def run(table: pa.Table) -> pa.Table:
        asks = np.asarray(table["asks"])
        one, two = ({c: np.asarray(part[c]) for c in ("doc", "root", "n")} | {"symbols": _signed(part)} for part in (table.filter(pa.array(m)) for m in (asks, ~asks)))
        at, flagged = table["at"][0].as_py(), [np.zeros(len(one["doc"]), bool), np.zeros(len(two["doc"]), bool)]
        step = max(1, (1 << 17) // max(1, len(two["doc"])))
        for i in range(0, len(one["doc"]) if len(two["doc"]) else 0, step):
            x = {c: v[i : i + step] for c, v in one.items()}
            near = x["root"][:, None] != two["root"][None]
            near &= 100 * np.minimum(x["n"][:, None], two["n"][None]) >= percent * np.maximum(x["n"][:, None], two["n"][None])
            a, b = np.nonzero(near)
            same = x["symbols"][a] == two["symbols"][b]
            by_chunk = same.reshape(-1, CHUNKS, CHUNK)
            count = by_chunk.sum(2)
            first = np.argmax(count >= CHUNK - 1, axis=1)
            within = by_chunk[np.arange(len(a)), first]
            key = first * CHUNK + np.where(within.all(1), 0, np.argmin(within, axis=1))
            ok = (count.sum(1) >= SYMBOLS - DISTANCE) & (key >= at)  # equal lists stand under the first of their keys
            flagged[0][i + a[ok]] = True
            flagged[1][b[ok]] = True
        docs = np.unique(np.concatenate([one["doc"][flagged[0]], two["doc"][flagged[1]]]))
        return pa.table({"name": pa.array([table["name"][0].as_py()] * len(docs), pa.int64()), "doc": pa.array(docs)})

    return cells.groupBy("name", "a", "b").applyInArrow(run, "name bigint, doc bigint")


def _several(rows: DataFrame, row_bytes: int, entry_bytes: int) -> DataFrame:
    """The rows (`name`, `doc`, `root`, `n`, ...) of the lists whose rows are of several components, with each list's largest component and numbers of blocks."""
    by_root = rows.groupBy("name", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    lists = by_root.groupBy("name").agg(F.count("*").alias("roots"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.max(F.struct("c", "s", "root")).alias("big")).filter("roots > 1")
    blocks = lambda c, s: F.greatest(F.ceil(c / BLOCK_ROWS), F.ceil((c * row_bytes + s * entry_bytes) / BLOCK_BYTES), F.lit(1)).cast("int")
    lists = lists.select("name", F.col("big.root").alias("big"), blocks(F.col("c") - F.col("big.c"), F.col("s") - F.col("big.s")).alias("na"), blocks(F.col("c"), F.col("s")).alias("nb"))
    return rows.join(lists, "name")


def _cells(rows: DataFrame, *payload: str) -> DataFrame:
    """Cells of _several()'s rows: blocks of members outside the largest component (`asks`) against blocks of all members."""
    at = lambda n: F.pmod(F.xxhash64("doc"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    one = rows.filter("root <> big").select("name", at(F.col("na")).alias("a"), every(F.col("nb")).alias("b"), F.lit(True).alias("asks"), *payload)
    two = rows.select("name", every(F.col("na")).alias("a"), at(F.col("nb")).alias("b"), F.lit(False).alias("asks"), *payload)
    return one.unionByName(two)


def _links_between(members: DataFrame, nodes: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components (`u`, `v`: roots) that members of a common list have. nodes: `doc`, `n`, `root`; classes: `doc`, `symbols`."""
    rooted = written(members.join(nodes, "doc"))
    open_ = written(_several(rooted, 2 * SYMBOLS, 0))
    signed = open_.join(classes.select("doc", "symbols"), "doc")
    found = written(_candidates(_cells(signed, "at", "doc", "root", "n", "symbols"), percent).distinct())
    released(rooted, open_)
    sets = written(_sets(_picked(texts, found.select("doc")), width))
    rows = _several(found.join(nodes, "doc"), 0, FINGERPRINT).join(sets, "doc")
    links = written(_cell_links(_cells(rows, "root", "shingles"), percent))
    released(found, sets)
    return links


def confirm(links: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The links (`u`: hub, `v`) whose full sets are similar enough. texts: `doc`, `text`. A hub is copied once for each HUB_LINKS of its links, as many link with one."""
    parts = links.groupBy("u").agg(F.ceil(F.count("*") / HUB_LINKS).cast("int").alias("parts"))
    dealt = links.join(parts, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("salt"))
    one = dealt.join(texts.select(F.col("doc").alias("v"), F.col("text").alias("tv")), "v")
    hubs = texts.join(parts.withColumnRenamed("u", "doc"), "doc").select(F.col("doc").alias("u"), F.col("text").alias("tu"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    both = one.join(hubs, ["u", "salt"]).select("u", "v", "tu", "tv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = byte_view(batch.column(2))[1] + byte_view(batch.column(3))[1]
            for a, b in pieces(sizes, 2 * PIECE_BYTES):
                part = batch.slice(a, b - a)
                (one, off_one), (two, off_two) = shingle_sets(part.column(2), width), shingle_sets(part.column(3), width)
                n = np.arange(b - a)
                rows = np.concatenate([np.repeat(n, np.diff(off_one)), np.repeat(n, np.diff(off_two))])
                _, first, times = np.unique(mix(np.concatenate([one, two]) ^ rows.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
                common = np.bincount(rows[first[times == 2]], minlength=b - a)
                union = np.diff(off_one) + np.diff(off_two) - common
                keep_rows = (100 * common >= percent * union) & (common > 0)
                yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(keep_rows)) for i in range(2)], names=["u", "v"])

    return both.mapInArrow(run, "u bigint, v bigint")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = SIMILARITY, hot: int = HOT) -> DataFrame:
    """Every document with the size of its set, its component (the least id it reaches) and whether it is the one that stays."""
    sig = written(signatures(docs, id_col, text_col, width))
    known = sig.filter("n > 0 AND doc IS NOT NULL")
    classes = known.groupBy("p1", "p2", "n").agg(F.min(F.struct("doc", "symbols")).alias("m"), F.count("*").alias("members"))
    classes = written(classes.select("p1", "p2", "n", "members", "m.*"))
    n_classes = classes.count()
    n_buckets, n_ranges = max(1, -(-n_classes * SYMBOLS // BUCKET_ENTRIES)), max(1 << 10, -(-n_classes * SYMBOLS * 8 // hot))
    ranges = _hot_ranges(classes, n_ranges, hot) if n_classes > hot else {}  # a list has n_classes members at most
    groups = written(_groups(_entries(classes, n_buckets, n_ranges, ranges), percent))
    if ranges:
        hubs = written(_groups(groups.filter(F.length("hubs") > 0).select("bucket", F.lit(0).alias("salt"), F.col("hubs").alias("entries")), percent))
        both = groups.unionByName(hubs)
    else:
        both = groups
    first, members = written(_first_links(both)), written(_members(both))
    released(groups)
    asked = first.select(F.col("u").alias("doc")).union(first.select(F.col("v").alias("doc")))
    texts = written(_picked(_texts(docs, id_col, text_col), asked))
    links = written(confirm(first, texts, width, percent))
    released(texts, first)
    roots = written(components(links))
    nodes = classes.select("doc", "n").join(roots.withColumnRenamed("node", "doc"), "doc", "left").select("doc", "n", F.coalesce("root", "doc").alias("root"))
    more = _links_between(members, nodes, classes, _texts(docs, id_col, text_col), width, percent)
    joined = written(components(more.unionByName(roots.select(F.col("root").alias("u"), F.col("node").alias("v")))))
    released(members, links, roots, more)
    roots = joined
    # equal sets: only classes with several members are joined, each copied SALTS times so that one large class meets many tasks
    several = classes.filter("members > 1").select("p1", "p2", "n", F.col("doc").alias("first"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = sig.select("doc", "n", "p1", "p2", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt"))
    firsts = own.join(several, ["p1", "p2", "n", "salt"], "left").select("doc", "n", F.when(F.col("n") > 0, F.coalesce("first", "doc")).otherwise(F.col("doc")).alias("first"), "salt")
    spread = roots.filter("node <> root").select(F.col("node").alias("first"), "root", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = firsts.join(spread, ["first", "salt"], "left")
    component = F.coalesce("root", "first")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """The rows of `docs` without those of near-duplicates of a document with a smaller id."""
    gone = classify(docs, id_col, text_col, width, percent).filter("NOT kept").select(F.col(id_col).alias("__near_doc")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__near_doc"), "left_anti")
