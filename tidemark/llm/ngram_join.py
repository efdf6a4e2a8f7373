"""Exact Jaccard self-join of sets of word n-grams by pigeonhole over a partition of their universe.

Sets x and y with |x| >= |y| and similarity p link only if their symmetric difference has H =
2 |x| (1 - p) / (1 + p) members at most. Sizes fall into bands; a band has a fixed number of
segments, one more than the H of its largest size, and a hash deals every n-gram to a segment. A larger
set x (the query) allocates to each segment one of: nothing; its own subset, which finds sets whose subset
of that segment is equal; or its subset and all subsets that lack one member (the one-deletion
neighbourhood), which finds sets whose subset differs by one n-gram at most. Were a linked set y found
by none of them, y would differ from x in a member of every segment with a subset and in two of every one with a
neighbourhood, so an allocation of H + 1 such units in all finds every link: no link is lost.

Costs: all keys of the index are counted in a table of COUNTERS sums. A set takes the H + 1 cheapest units,
by the counts of the keys that a unit looks up, so empty subsets and those that many sets share are looked
up only where nothing else is left. The costs steer what is compared, never what is found. Every set is indexed by the
subsets of all segments and the neighbourhoods of the first few, which alone may be allocated as such; in
its own band and, where a larger set of the next band may link with it, there too.

Equal sets are one class (an aggregation), represented by its least document. Documents of one key are a list; a list that no query
looks up is dropped. Links inside lists are verified on full sets, in two steps, so that a list of many copies costs no pair of copies:
members with the list's hub, the member of most lists; then, of lists whose members are still in several components, the
members outside the largest one with all others, in cells of bounded size. Before full sets move, a sketch rules pairs out for sure: the
parities of a set's members in as many bits as fit its band, of which no more differ than the symmetric difference has members.
Long lists are dealt over salts.

Null and empty texts, and those without words, have empty sets and link with nothing; texts with fewer words than an n-gram have one of all
their words. Rows that repeat an id are
compared each, and get the component of their set. A null id takes no part
(its row is returned with its set's size, without component). Texts of any length are whole; an empty table gives an empty result; other columns
are ignored. `docs` is read three times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.near_duplicates import FINGERPRINT, PIECE_BYTES, _cell_links, _cells, _picked, _sets, _several, _texts, confirm, shingle_sets
from tidemark.llm.shared import components, released, written
from tidemark.llm.tokens import U64, byte_view, mix, pieces

WIDTH, SIMILARITY = 4, 85
#: A band's largest size over its smallest; segments of a band that are indexed with their neighbourhoods: FEW and one of each SHARE.
RATIO, FEW, SHARE = 1.3, 3, 12
#: Counters of keys (a power of two: 4 MB), in slices; entries of a bucket; entries that a task packs at once; members of a list that aren't salted; copies of a class that is looked up.
COUNTERS, SLICE, BUCKET_ENTRIES, PACK, HOT, SALTS = 1 << 20, 1 << 16, 500_000, 1 << 19, 100_000, 16
#: Hubs that a document is compared with first; members of each side of a cell whose pairs are told apart, others are told as members.
BEST, PAIRED = 2, 64
#: Bits of a sketch for each member of the largest symmetric difference, and pairs' sketch words that are compared at once.
BITS, WORDS_AT_ONCE = 4, 1 << 21


def distance(size, percent: int):
    """The largest symmetric difference of a set of `size` and one no larger that link."""
    return 2 * size * (100 - percent) // (100 + percent)


class Bands:
    """Bands of set sizes: their least sizes, numbers of segments, and of segments with neighbourhoods."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        bound = [-(-(100 + percent) // (2 * (100 - percent)))]  # smaller sets link with equal ones alone
        while bound[-1] < 1 << 40:
            bound.append(int(bound[-1] * max(RATIO, 1.02 * 100 / percent)) + 1)
        self.least = np.array(bound)
        self.segments = distance(self.least[1:] - 1, percent) + 1
        self.near = np.minimum(self.segments, FEW + self.segments // SHARE)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        """The band of each size; -1 below the first."""
        return np.searchsorted(self.least, sizes, "right") - 1

    def reaches_up(self, sizes: np.ndarray) -> np.ndarray:
        """Whether a larger set of the next band may link with a set of the size."""
        return 100 * sizes >= self.percent * self.least[self.of(sizes) + 1]


def sketches(bands: Bands, sets: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Parities of each set's members by their lowest bits; the number of bits is the power of two of the set's band."""
    size = np.diff(off)
    bits = 1 << np.ceil(np.log2(np.maximum(64, BITS * (bands.segments[np.maximum(bands.of(size), 0)] - 1)))).astype(np.int64)
    first = np.cumsum(bits) - bits
    at = np.repeat(first, size) + (sets & np.repeat(bits - 1, size).astype(U64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(bool), bitorder="little").tobytes()
    return [packed[a : a + n] for a, n in zip((first // 8).tolist(), (bits // 8).tolist(), strict=True)]


def _words(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), U64).reshape(len(sketches), -1)


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """Sketches with fewer bits: parities add up."""
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def near(one: list[bytes], two: list[bytes], n: tuple[np.ndarray, np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in `one`, in `two`) of the pairs that sizes and sketches don't rule out. n: the sets' sizes."""
    width = [np.array([len(x) // 8 for x in side], np.int64) for side in (one, two)]
    for a in np.unique(width[0]):
        for b in np.unique(width[1]):
            if max(a, b) > 2 * min(a, b):  # two bands apart at least
                continue
            i, j = np.flatnonzero(width[0] == a), np.flatnonzero(width[1] == b)
            x, y = (_folded(_words([side[k] for k in at]), int(min(a, b))) for side, at in ((one, i), (two, j)))
            step = max(1, WORDS_AT_ONCE // max(1, y.size))
            for low in range(0, len(i), step):
                own = i[low : low + step]
                s, t = n[0][own][:, None], n[1][j][None]
                away = np.bitwise_count(x[low : low + step, None] ^ y[None]).sum(2, dtype=np.int64)
                u, v = np.nonzero((100 * np.minimum(s, t) >= percent * np.maximum(s, t)) & ((100 + percent) * away <= (100 - percent) * (s + t)))
                yield own[u], j[v]


class Subsets:
    """The keys of sets (n-grams end to end, len + 1 offsets) in given bands: of each segment's subset (a slot), and of those without one member."""

    def __init__(self, bands: Bands, sets: np.ndarray, off: np.ndarray, band: np.ndarray) -> None:
        size = np.diff(off)
        row = np.repeat(np.arange(len(size)), size)
        m, near = bands.segments[band], bands.near[band]
        self.first = np.cumsum(m) - m
        segment = ((sets >> U64(20)) % m[row].astype(U64)).astype(np.int64)
        slot = self.first[row] + segment
        own = mix(sets)
        self.sums = np.zeros(int(m.sum()), U64)
        np.add.at(self.sums, slot, own)
        self.row = np.repeat(np.arange(len(size)), m)
        number = np.arange(len(self.row)) - self.first[self.row]
        salt = mix((band[self.row].astype(U64) << U64(40)) + number.astype(U64))
        self.keys = mix(self.sums + salt)
        self.near = number < near[self.row]
        lack = np.flatnonzero(segment < near[row])
        self.slot_without = slot[lack]
        self.keys_without = mix(self.sums[self.slot_without] - own[lack] + salt[self.slot_without])
        self.row_without = row[lack]

    def allocate(self, counts: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots whose subsets, and those whose neighbourhoods, are looked up: the cheapest `units` of each row."""
        cost = counts[(self.keys & U64(len(counts) - 1)).astype(np.int64)].astype(np.float64)
        more = np.zeros(len(cost))
        np.add.at(more, self.slot_without, counts[(self.keys_without & U64(len(counts) - 1)).astype(np.int64)])
        near = np.flatnonzero(self.near)
        # a neighbourhood comes after its own subset
        costs, rows = np.concatenate([cost, np.maximum(more, cost)[near]]), np.concatenate([self.row, self.row[near]])
        order = np.lexsort((np.arange(len(costs)), costs, rows))
        rank = np.empty(len(order), np.int64)
        every = np.bincount(rows, minlength=len(units))
        rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(every) - every, every)
        taken = rank < units[rows]
        wide = np.zeros(len(cost), bool)
        wide[near] = taken[len(cost) :]
        return taken[: len(cost)], wide


def _schemes(bands: Bands, sets: np.ndarray, off: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray, Subsets]]:
    """The sets' own bands, then the next ones where they may matter: whether it is those, rows, their sizes, their keys."""
    size = np.diff(off)
    for up in (False, True):
        rows = np.flatnonzero(bands.reaches_up(size) if up else bands.of(size) >= 0)
        if len(rows):
            inner = np.repeat(off[rows] - np.cumsum(size[rows]) + size[rows], size[rows]) + np.arange(int(size[rows].sum()))
            yield up, rows, size[rows], Subsets(bands, sets[inner], np.concatenate([[0], np.cumsum(size[rows])]), bands.of(size[rows]) + up)


def signed(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Rows (`doc`, `n`, `p1`, `p2`, `sketch`): set size and fingerprint (two sums); and rows (`slice`, `counts`): each task's counts of keys."""
    bands = Bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in pieces(byte_view(texts)[1], PIECE_BYTES):
                sets, off = shingle_sets(texts.slice(a, b - a), width)
                sums, rows = np.zeros((2, b - a), np.int64), np.flatnonzero(np.diff(off))
                for i in range(2 if len(rows) else 0):
                    sums[i, rows] = np.add.reduceat(mix(sets + U64(i)), off[rows]).view(np.int64)
                for _, _, _, s in _schemes(bands, sets, off):
                    for keys in (s.keys, s.keys_without):
                        total += np.bincount((keys & U64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(off)), pa.array(sums[0]), pa.array(sums[1]), pa.array(sketches(bands, sets, off), pa.binary()), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())], names=names)
        parts = total.reshape(-1, SLICE)
        some = np.flatnonzero(parts.any(axis=1))
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(some), pa.binary()), pa.array(some.astype(np.int32)), pa.array([np.minimum(parts[i], (1 << 31) - 1).astype(np.uint32).tobytes() for i in some], pa.binary())], names=names)

    names = ["doc", "n", "p1", "p2", "sketch", "slice", "counts"]
    return _texts(docs, id_col, text_col).mapInArrow(run, "doc bigint, n bigint, p1 bigint, p2 bigint, sketch binary, slice int, counts binary")


def key_counts(sig: DataFrame) -> np.ndarray:
    """The sums of all tasks' counts; what reaches the driver has COUNTERS numbers, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                total[at] = total.get(at, 0) + np.frombuffer(counts, np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, (1 << 31) - 1).astype(np.int32).tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])

    summed = sig.filter("slice IS NOT NULL").select("slice", "counts").repartition(COUNTERS // SLICE, "slice").mapInArrow(run, "slice int, counts binary")
    out = np.zeros((COUNTERS // SLICE, SLICE), np.int32)
    for row in summed.collect():
        out[row["slice"]] = np.frombuffer(row["counts"], np.int32)
    return out.ravel()


_ENTRY = np.dtype([("bucket", "<i4"), ("salt", "<i4"), ("key", "<u4"), ("doc", "<i8"), ("asks", "u1")])


def _entries(texts: DataFrame, width: int, percent: int, counts: np.ndarray, n_buckets: int, hot: int) -> DataFrame:
    """All keys, packed by bucket: rows (`bucket`, `salt`, `keys`, `docs`, `asks`); salt is 0, or 1 and more for parts of keys that may be hot."""
    bands, shared = Bands(percent), texts.sparkSession.sparkContext.broadcast(counts)

    def of(keys: np.ndarray, docs: np.ndarray, asks: np.ndarray) -> np.ndarray:
        out = np.empty(len(keys), _ENTRY)
        parts = -(-shared.value[(keys & U64(COUNTERS - 1)).astype(np.int64)].astype(np.int64) // hot)
        out["bucket"], out["key"], out["doc"], out["asks"] = (keys % U64(n_buckets)).astype(np.int32), (keys // U64(n_buckets)).astype(np.uint32), docs, asks
        out["salt"] = np.where(parts > 1, 1 + (mix(docs.astype(U64)) % np.maximum(parts, 1).astype(U64)).astype(np.int64), 0)
        return out

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        e = np.concatenate(held) if held else np.empty(0, _ENTRY)
        e = e[np.lexsort((e["salt"], e["bucket"]))]
        first = np.flatnonzero(np.append(True, (e["bucket"][1:] != e["bucket"][:-1]) | (e["salt"][1:] != e["salt"][:-1]))) if len(e) else np.empty(0, np.int64)
        ends = np.append(first[1:], len(e)).tolist()
        packed = [pa.array([e[f][a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)], pa.binary()) for f in ("key", "doc", "asks")]
        return pa.RecordBatch.from_arrays([pa.array(e["bucket"][first]), pa.array(e["salt"][first]), *packed], names=["bucket", "salt", "keys", "docs", "asks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids, texts = np.asarray(batch.column(0)), batch.column(1)
            for a, b in pieces(byte_view(texts)[1], PIECE_BYTES):
                sets, off = shingle_sets(texts.slice(a, b - a), width)
                for up, rows, size, s in _schemes(bands, sets, off):
                    docs = ids[a:b][rows]
                    none = np.zeros(len(s.keys), bool)
                    exact, wide = (none, none) if up else s.allocate(shared.value, distance(size, percent) + 1)
                    held += [of(s.keys, docs[s.row], exact), of(s.keys_without, docs[s.row_without], wide[s.slot_without])]
                    n += len(s.keys) + len(s.keys_without)
                if n > PACK:
                    yield dealt(held)
                    held, n = [], 0
        if held:
            yield dealt(held)

    return texts.mapInArrow(run, "bucket int, salt int, keys binary, docs binary, asks binary")


def _lists(entries: DataFrame) -> DataFrame:
    """The lists of two documents or more that a query looks up: rows (`name`, `docs`). A whole list is named by its members, a part of one by its key."""

    def run(table: pa.Table) -> pa.Table:
        bucket, salt = table["bucket"][0].as_py(), table["salt"][0].as_py()
        key, doc, asks = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("keys", np.uint32), ("docs", np.int64), ("asks", np.uint8)))
        order = np.lexsort((doc, key))
        key, doc, asks = key[order], doc[order], asks[order]
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
        key, doc, asks = key[new], doc[new], np.maximum.reduceat(asks, new)
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        kept = np.flatnonzero((size > 1) & (np.maximum.reduceat(asks, start) > 0)) if salt == 0 else np.arange(len(start))
        names = mix(np.add.reduceat(mix(doc.astype(U64)), start)) if salt == 0 else mix(U64(bucket << 32) ^ key[start].astype(U64))
        return pa.table({"name": pa.array(names[kept].view(np.int64)), "docs": pa.array([doc[a : a + n].tobytes() for a, n in zip(start[kept].tolist(), size[kept].tolist(), strict=True)], pa.binary())})

    return entries.groupBy("bucket", "salt").applyInArrow(run, "name bigint, docs binary")


def _members(lists: DataFrame) -> DataFrame:
    """Rows (`name`, `times`, `doc`); equal lists are one, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(2).to_pylist()
            name, times = (np.repeat(np.asarray(batch.column(i)), [len(d) // 8 for d in docs]) for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(times), pa.array(np.frombuffer(b"".join(docs), np.int64))], names=["name", "times", "doc"])

    return lists.groupBy("name", "docs").agg(F.count("*").alias("times")).select("name", "times", "docs").mapInArrow(run, "name bigint, times bigint, doc bigint")


def _sketched(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (`u`, `v`, `times`) that sizes and sketches don't rule out. classes: `doc`, `n`, `sketch`."""
    of = lambda c: classes.select(F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(of("u"), "u").join(of("v"), "v").filter(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")).select("u", "v", "times", "nu", "nv", "su", "sv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t = np.asarray(batch.column(3)), np.asarray(batch.column(4))
            away = np.empty(len(s), np.int64)
            for i, (x, y) in enumerate(zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True)):
                width = min(len(x), len(y)) // 8
                away[i] = np.bitwise_count(_folded(_words([x]), width) ^ _folded(_words([y]), width)).sum()
            ok = pa.array((100 + percent) * away <= (100 - percent) * (s + t))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(ok) for i in range(3)], names=["u", "v", "times"])

    return both.mapInArrow(run, "u bigint, v bigint, times bigint")


def _hub_links(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Each document with its BEST hubs (`u`: hub, `v`). members: `name`, `times`, `doc`; classes: `doc`, `n`, `sketch`."""
    degree = members.groupBy("doc").agg(F.sum("times").alias("degree"))
    hubs = members.join(degree, "doc").groupBy("name").agg(F.max_by("doc", F.struct("degree", -F.col("doc"))).alias("u"))
    pairs = members.join(hubs, "name").filter("doc <> u").groupBy("u", F.col("doc").alias("v")).agg(F.sum("times").alias("times"))
    # a document has no more hubs than keys
    best = _sketched(pairs, classes, percent).groupBy("v").agg(F.slice(F.sort_array(F.collect_list(F.struct("times", "u")), False), 1, BEST).alias("best"))
    return best.select("v", F.explode("best.u").alias("u"))


def _candidates(cells: DataFrame, percent: int) -> DataFrame:
    """What sketches don't rule out between components: pairs (`u`, `v`, without `name`) of small cells, members (`name`, `u`) of larger ones. cells: `asks`, `doc`, `root`, `n`, `sketch`."""

    def run(table: pa.Table) -> pa.Table:
        asks = np.asarray(table["asks"])
        one, two = (table.filter(pa.array(m)) for m in (asks, ~asks))
        doc, root, n = (tuple(np.asarray(t[c]) for t in (one, two)) for c in ("doc", "root", "n"))
        small, found = max(len(one), len(two)) <= PAIRED, []
        flagged = (np.zeros(len(one), bool), np.zeros(len(two), bool))
        for i, j in near(one["sketch"].to_pylist(), two["sketch"].to_pylist(), n, percent):
            apart = root[0][i] != root[1][j]
            i, j = i[apart], j[apart]
            found.append((np.minimum(doc[0][i], doc[1][j]), np.maximum(doc[0][i], doc[1][j])))
            flagged[0][i] = flagged[1][j] = True
            found = found if small else []
        if small:
            u, v = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
            return pa.table({"name": pa.nulls(len(u), pa.int64()), "u": pa.array(u), "v": pa.array(v)})
        u = np.unique(np.concatenate([doc[0][flagged[0]], doc[1][flagged[1]]]))
        return pa.table({"name": pa.array([table["name"][0].as_py()] * len(u), pa.int64()), "u": pa.array(u), "v": pa.nulls(len(u), pa.int64())})

    return cells.groupBy("name", "a", "b").applyInArrow(run, "name bigint, u bigint, v bigint").distinct()


def _links_between(members: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components (`u`, `v`) that members of a common list have. nodes: `doc`, `n`, `sketch`, `root`."""
    rooted = _several(members.select("name", "doc").join(nodes.drop("sketch"), "doc"), 0, 1)
    found = written(_candidates(_cells(rooted.join(nodes.select("doc", "sketch"), "doc"), "doc", "root", "n", "sketch"), percent))
    pairs, rows = found.filter("name IS NULL").select("u", "v"), found.filter("name IS NOT NULL").select("name", F.col("u").alias("doc"))
    picked = written(_picked(texts, found.select(F.explode(F.array("u", "v")).alias("doc")).filter("doc IS NOT NULL")))
    sets = _sets(picked, width)
    cells = _cells(_several(rows.join(nodes.drop("sketch"), "doc"), 0, FINGERPRINT).join(sets, "doc"), "root", "shingles")
    links = written(confirm(pairs, picked, width, percent).unionByName(_cell_links(cells, percent)))
    released(found, picked)
    return links


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = SIMILARITY, hot: int = HOT) -> DataFrame:
    """Every document with the size of its set and its component: the least id that it reaches by links."""
    both = written(signed(docs, id_col, text_col, width, percent))
    counts, sig = key_counts(both), both.filter("slice IS NULL").drop("slice", "counts")
    classes = sig.filter("n > 0 AND doc IS NOT NULL").groupBy("p1", "p2", "n").agg(F.min(F.struct("doc", "sketch")).alias("m"), F.count("*").alias("members"))
    classes = written(classes.select("p1", "p2", "n", "members", "m.*"))
    least = int(Bands(percent).least[0])
    asked = classes.filter(100 * F.col("n") >= percent * F.lit(least))
    n_buckets = max(1, -(-int(counts.sum(dtype=np.int64)) // BUCKET_ENTRIES))
    members = written(_members(_lists(_entries(_picked(_texts(docs, id_col, text_col), asked.select("doc")), width, percent, counts, n_buckets, hot))))
    first = written(_hub_links(members, asked, percent))
    texts = written(_picked(_texts(docs, id_col, text_col), first.select(F.col("u").alias("doc")).union(first.select(F.col("v").alias("doc")))))
    links = written(confirm(first, texts, width, percent))
    released(texts, first)
    roots = written(components(links))
    nodes = asked.select("doc", "n", "sketch").join(roots.withColumnRenamed("node", "doc"), "doc", "left").select("doc", "n", "sketch", F.coalesce("root", "doc").alias("root"))
    more = _links_between(members, nodes, _texts(docs, id_col, text_col), width, percent)
    joined = written(components(more.unionByName(roots.select(F.col("root").alias("u"), F.col("node").alias("v")))))
    released(members, links, roots, more)
    return _spread(sig, classes, joined, id_col)


def _spread(sig: DataFrame, classes: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """The components of classes' representatives, given to all documents. Only classes with several members are joined, each copied SALTS times so that a large one meets many tasks."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    several = classes.filter("members > 1").select("p1", "p2", "n", F.col("doc").alias("first"), salts)
    own = sig.select("doc", "n", "p1", "p2", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt"))
    firsts = own.join(several, ["p1", "p2", "n", "salt"], "left").select("doc", "n", F.when(F.col("doc").isNotNull(), F.coalesce("first", "doc")).alias("first"), "salt")
    out = firsts.join(roots.filter("node <> root").select(F.col("node").alias("first"), "root", salts), ["first", "salt"], "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "first").alias("component_id"))
