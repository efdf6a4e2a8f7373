"""Language-model scores of a hierarchical Pitman-Yor model, seated by Gibbs sampling.

A token is drawn in the restaurant of its context: the whole word before it (at a text's
start the end token, so that contexts and tokens are the same keys), or only that word's
last `context_bytes` bytes where a caller asks for so coarse a model. However many
contexts the corpus has, each has its restaurant. All share one parent, the restaurant of
single tokens, whose base is uniform over the V known tokens and one unknown. Customers
of a context restaurant are the training tokens that follow its context; each of its
tables sends a customer to the parent.

Batches of documents send the counts of their distinct (token, context) pairs to buckets:
a pair to its token's bucket, so all contexts of a token are in one. Tokens so frequent that
their contexts would fill HOT of a bucket are hot: their pairs are dealt over all buckets by
context. A bucket's seating of the pairs of several customers is one packed row (a lone
customer always sits alone). A sweep runs over the buckets in parallel and is a random scan:
in each of STEPS steps a share of every pair's customers, drawn evenly from all of them,
leaves and sits down again given the others, so as many move in a sweep as there are, some
twice and about a third not at all (those of one share don't see each other, which adds a few
percent of tables to pairs of many customers, as a test measures); closed and opened tables
take customers from the parent and send some. So the work of a sweep grows with the tokens.

What couples the buckets is summed by Spark between sweeps and stays fixed within one: the
tables of each context go to the context's bucket, which answers every bucket that has pairs
of it; the driver gets the parent's totals and a number for each hot token (n / HOT at most
for n buckets), whose tables in the parent it draws anew. SAMPLES seatings are kept, and a token's
probability is the mean of their predictive probabilities. Buckets answer each batch
with what is known of its keys and pairs, from which the batch works out the probabilities.

Draws are seeded by bucket and sweep, so a task that is run again seats alike. Tokens, contexts and
pairs are told apart by 64-bit fingerprints.

Defined results: null and empty texts have only the end token; rows without id are
training rows; repeated rows count each; an empty training set gives N = V = 0 and
uniform scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange as x
from tidemark.llm.shared import released, written
from tidemark.llm.tokens import U64, ascii_lower, byte_view, mix, pieces, word_bounds, word_hashes

#: Discount and concentration of the contexts and of their parent; sweeps before samples, samples, steps of a sweep.
DISCOUNT, STRENGTH, ROOT_DISCOUNT, ROOT_STRENGTH = 0.8, 1.0, 0.7, 1.0
BURN_IN, SAMPLES, STEPS = 1, 2, 16
FOLDS, HELD_OUT = 7, 2
END = mix(np.array([0x5EED], U64))[0]
PIECE_BYTES = 1 << 19
#: A token with more than this share of a bucket's mean number of tokens is dealt over all buckets.
HOT = 0.25


def held_out(ids: np.ndarray, null_ids: np.ndarray) -> np.ndarray:
    """Whether the crc32 of each id as text leaves HELD_OUT when divided by FOLDS."""
    return np.fromiter((zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids.tolist()), bool, len(ids)) & ~null_ids


def _planes(values: np.ndarray) -> bytes:
    """Numbers packed byte plane by byte plane."""
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes).tobytes())


def _read_planes(packed: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _small(values: np.ndarray) -> bytes:
    """Mostly small numbers under 2**32."""
    return _planes(values.astype("<u4"))


def _read_small(packed: bytes) -> np.ndarray:
    return _read_planes(packed, "<u4").astype(np.int64)


def _ascending(values: np.ndarray) -> bytes:
    """Ascending 64-bit values."""
    return _planes(np.diff(values, prepend=U64(0)).astype("<u8"))


def _read_ascending(packed: bytes) -> np.ndarray:
    return np.cumsum(_read_planes(packed, "<u8"), dtype=U64)


def _folded(change: np.ndarray) -> np.ndarray:
    """Changes of either sign as small numbers."""
    return (change << 1) ^ (change >> 63)


def _unfolded(folded: np.ndarray) -> np.ndarray:
    return (folded >> 1) ^ -(folded & 1)


def _distinct(values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """np.unique() with the inverse, of numbers in a range; sorted together with their places where both fit 63 bits."""
    bits = len(values).bit_length()
    if below.bit_length() + bits > 63:
        return np.unique(values, return_inverse=True)
    both = np.sort(values << bits | np.arange(len(values)))
    ordered = both >> bits
    first = np.append(True, ordered[1:] != ordered[:-1])[: len(values)]
    inverse = np.empty(len(values), np.int64)
    inverse[both & ((1 << bits) - 1)] = np.cumsum(first) - 1
    return ordered[first], inverse


def _joined(parts: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *parts])


def _in(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys among sorted known ones (0 for others), and which are known."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    found = known[at] == keys
    return np.where(found, at, 0), found


def _pair_names(token: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(token + mix(context ^ U64(0xC0)))


class _Tokens:
    """A batch's tokens: places among its distinct keys (tokens and contexts), rows; its distinct pairs."""

    def __init__(self, batch: x.Batch, context_bytes: int | None) -> None:
        n = len(batch.ids)
        parts = [_tokens(batch.data, batch.offsets, a, b, context_bytes) for a, b in pieces(batch.offsets, PIECE_BYTES)]
        token, context, self.row = (np.concatenate(c) for c in zip(*parts, strict=True))
        self.whole = context_bytes is None
        self.keys, at = np.unique(token if self.whole else np.concatenate([token, context]), return_inverse=True)
        if self.whole:  # the token before; before a text's first stands the end of another
            before = np.append(np.searchsorted(self.keys, END), at[:-1])
        else:
            at, before = at[: len(token)], at[len(token) :]
        pair, self.pair_at = _distinct(at * len(self.keys) + before, len(self.keys) ** 2)
        self.token, self.context = pair // len(self.keys), pair % len(self.keys)
        self.held = held_out(batch.ids, batch.null_ids)
        self.trained = np.bincount(self.pair_at[~self.held[self.row]], minlength=len(pair))
        self.n_tokens = np.bincount(self.row, minlength=n)

    def split(self, n_buckets: int, hot: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Each bucket's keys and pairs (places), its hot tokens, and how many of the pairs each key and hot token has."""
        is_hot = _in(self.keys, hot)[1]
        home = (self.keys % U64(n_buckets)).astype(np.int64)
        spread = is_hot[self.token]
        to = home[self.token]
        to[spread] = (_pair_names(self.keys[self.token[spread]], self.keys[self.context[spread]]) % U64(n_buckets)).astype(np.int64)
        keys, pairs = np.argsort(home, kind="stable"), np.argsort(2 * to + spread, kind="stable")
        numbers = np.arange(n_buckets + 1)
        key_cuts, pair_cuts = np.searchsorted(home[keys], numbers), np.searchsorted(to[pairs], numbers)
        place = np.empty(len(keys), np.int64)
        place[keys] = np.arange(len(keys)) - key_cuts[home[keys]]
        for bucket in np.flatnonzero((np.diff(key_cuts) > 0) | (np.diff(pair_cuts) > 0)).tolist():
            k, p = keys[key_cuts[bucket] : key_cuts[bucket + 1]], pairs[pair_cuts[bucket] : pair_cuts[bucket + 1]]
            token, far = self.token[p], spread[p]
            hots, n_far = np.unique(token[far], return_counts=True)
            yield bucket, k, p, hots, np.append(np.bincount(place[token[~far]], minlength=len(k)), n_far)


def _tokens(all_data: np.ndarray, offsets: np.ndarray, a: int, b: int, context_bytes: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, contexts (none are made of whole words: they are the tokens before) and rows of texts a to b."""
    data = ascii_lower(all_data[offsets[a] : offsets[b]])
    starts, ends, words = word_bounds(data, offsets[a : b + 1] - offsets[a])
    n = np.diff(words) + 1
    row = np.repeat(np.arange(b - a), n)
    last = np.cumsum(n) - 1  # places of the end tokens
    is_word = np.ones(len(row), bool)
    is_word[last] = False
    token = np.full(len(row), END, U64)
    token[is_word] = word_hashes(data, starts, ends)
    context = np.empty(0, U64)
    if context_bytes is not None:
        suffix = np.full(len(row), END, U64)
        suffix[is_word] = mix(word_hashes(data, np.maximum(starts, ends - context_bytes), ends))
        context = np.append(END, suffix[:-1])
    return token, context, row + a


def _hot(docs: DataFrame, text_col: str, n_buckets: int) -> np.ndarray:
    """The tokens to deal over all buckets, sorted.

    A token with some share of all tokens has that share in one of the batches at least, so each
    batch names only its own; what a token's other batches leave out matters only for balance.
    """
    share = HOT / n_buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column(0))
            found, counts, n = [], [], 0
            for a, b in pieces(offsets, 8 * PIECE_BYTES):
                token = _tokens(data, offsets, a, b)[0]
                slot = (token >> U64(48)).astype(np.int64)
                token = token[np.bincount(slot, minlength=1 << 16)[slot] > share * len(token)]
                keys, count = np.unique(token, return_counts=True)
                often = count > share * len(slot)
                found, counts, n = [*found, keys[often]], [*counts, count[often]], n + len(slot)
            keys, counts = np.append(_joined(found, U64).view(np.int64), 0), np.append(_joined(counts), n)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["token", "n"])

    if n_buckets == 1:
        return np.empty(0, U64)
    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    found = written(found)
    total = found.filter("token = 0").agg(F.sum("n")).first()[0] or 0
    hot = [r["token"] for r in found.filter((F.col("token") != 0) & (F.col("n") > share * total)).select("token").collect()]
    released(found)
    return np.sort(np.array(hot, np.int64).view(U64))


def fresh_tables(customers: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """How many tables customers take who are seated one after the other (in blocks of a sixteenth of the seated once there are many)."""
    seated, tables = np.minimum(customers, 1), np.minimum(customers, 1)
    active = np.flatnonzero(customers > seated)
    while len(active):
        block = np.minimum(np.maximum(seated[active] // 16, 1), customers[active] - seated[active])
        weight = new[active] / (new[active] + seated[active] - discount * tables[active])
        tables[active] += rng.binomial(block, np.clip(weight, 0, 1))
        seated[active] += block
        active = active[customers[active] > seated[active]]
    return tables


class Seats:
    """Tables of many dishes: tables of each dish, and their sizes dish by dish."""

    def __init__(self, tables: np.ndarray, sizes: np.ndarray, discount: float) -> None:
        self.tables, self.sizes, self.discount = tables.astype(np.int64), sizes.astype(np.int64), discount
        ends = np.cumsum(self.tables)
        sums = np.concatenate([[0], np.cumsum(self.sizes)])
        self.customers = sums[ends] - sums[ends - self.tables]

    def _places(self) -> tuple[np.ndarray, np.ndarray]:
        """The customers up to each table and before each dish."""
        return np.cumsum(self.sizes), np.cumsum(self.customers) - self.customers

    def _pick(self, dishes: np.ndarray, rng: np.random.Generator, places: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """A customer of each dish drawn evenly, and its table."""
        sums, before = places
        who = before[dishes] + (rng.random(len(dishes)) * self.customers[dishes]).astype(np.int64)
        return who, np.searchsorted(sums, who, "right")

    def leave(self, dishes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """A customer of each named dish leaves (a dish may be named often); how many tables of each dish close."""
        places = self._places()
        who, table = self._pick(dishes, rng, places)
        first, turns = np.empty(int(self.customers.sum()), np.int32), np.arange(len(who), dtype=np.int32)
        while True:  # nobody leaves twice
            first[who[::-1]] = turns[::-1]
            again = np.flatnonzero(first[who] != turns)
            if not len(again):
                break
            who[again], table[again] = self._pick(dishes[again], rng, places)
        np.subtract.at(self.sizes, table, 1)
        np.subtract.at(self.customers, dishes, 1)
        empty = np.flatnonzero(self.sizes == 0)
        closed = np.bincount(np.searchsorted(np.cumsum(self.tables), empty, "right"), minlength=len(self.tables))
        self.sizes = np.delete(self.sizes, empty)
        self.tables -= closed
        return closed

    def sit(self, dishes: np.ndarray, new: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """A customer of each named dish sits down, at a new table by the weight `new` against the seated; how many tables of each dish open."""
        old = np.maximum(self.customers[dishes] - self.discount * self.tables[dishes], 0)
        opens = (rng.random(len(dishes)) * (old + new) < new) | (self.customers[dishes] == 0)
        rest = np.flatnonzero(~opens)
        joined, places = [np.empty(0, np.int64)], self._places()
        while len(rest):
            _, table = self._pick(dishes[rest], rng, places)
            size = self.sizes[table]
            ok = rng.random(len(rest)) * size < size - self.discount
            joined.append(table[ok])
            rest = rest[~ok]
        np.add.at(self.sizes, np.concatenate(joined), 1)
        opened = np.bincount(dishes[opens], minlength=len(self.tables))
        self.sizes = np.insert(self.sizes, np.repeat(np.cumsum(self.tables), opened), 1)
        self.tables += opened
        np.add.at(self.customers, dishes, 1)
        return opened

    @staticmethod
    def fresh(customers: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> Seats:
        """Customers seated one after the other."""
        tables = fresh_tables(customers, new, discount, rng)
        # given their number, tables share the customers as by a Dirichlet draw, one each at least
        owner = np.repeat(np.arange(len(customers)), tables)
        share = rng.gamma(1 - discount, size=len(owner)) + 1e-9
        total = np.bincount(owner, share, minlength=len(customers))
        rest = customers - tables
        extra = np.floor(share / total[owner] * rest[owner]).astype(np.int64)
        first = (np.cumsum(tables) - tables)[customers > 0]
        extra[first] += (rest - np.bincount(owner, extra, minlength=len(customers)).astype(np.int64))[customers > 0]
        return Seats(tables, 1 + extra, discount)


def _turns(count: np.ndarray) -> np.ndarray:
    """In how many steps of a sweep customers of a pair move."""
    share = np.maximum(-(-count // STEPS), 1)
    return -(-count // share)


class _Asked:
    """What batches ask of a bucket, put together: distinct keys, hot tokens and pairs, with counts of the training set."""

    def __init__(self, table: pa.Table, n_buckets: int) -> None:
        small = lambda name: [_read_small(b) for b in table[name].to_pylist()]
        number = U64(table["bucket"][0].as_py())
        keys = [_read_ascending(b) * U64(n_buckets) + number for b in table["keys"].to_pylist()]
        hots, sizes = [np.frombuffer(b, U64) for b in table["hots"].to_pylist()], small("contexts_of")
        self.key_sizes, self.pair_sizes = [len(k) for k in keys], [int(n.sum()) for n in sizes]
        self.keys, self.key_at = np.unique(_joined(keys, U64), return_inverse=True)
        self.hots, hot_at = np.unique(_joined(hots, U64), return_inverse=True)
        self.as_token = self._sum(self.key_at, small("as_token"), len(self.keys))
        as_context = small("as_context")
        self.whole = not any(len(a) for a in as_context)
        self.as_context = self.as_token if self.whole else self._sum(self.key_at, as_context, len(self.keys))
        owners, key_from, hot_from = [], 0, 0
        for k, h in zip(keys, hots, strict=True):
            owners += [self.key_at[key_from : key_from + len(k)], len(self.keys) + hot_at[hot_from : hot_from + len(h)]]
            key_from, hot_from = key_from + len(k), hot_from + len(h)
        owner = np.repeat(_joined(owners), _joined(sizes))
        context = _joined([_read_ascending(b)[_read_small(at)] for b, at in zip(table["contexts"].to_pylist(), table["context_at"].to_pylist(), strict=True)], U64)
        names = _pair_names(np.append(self.keys, self.hots)[owner], context)
        order = np.argsort(names)
        first = np.append(True, names[order][1:] != names[order][:-1])[: len(order)]
        self.pair_at = np.empty(len(order), np.int64)
        self.pair_at[order] = np.cumsum(first) - 1
        self.owner, self.context = owner[order[first]], context[order[first]]
        self.count = self._sum(self.pair_at, small("count"), int(first.sum()))
        several = np.flatnonzero(self.count > 1)
        self.several = several[np.argsort(-_turns(self.count[several]), kind="stable")]  # those of most steps first

    @staticmethod
    def _sum(at: np.ndarray, values: list[np.ndarray], n: int) -> np.ndarray:
        return np.bincount(at, _joined(values), minlength=n).astype(np.int64)


class Totals:
    """Sums over all buckets: customers and tables of the parent, numbers of tokens and types; hot tokens' customers and tables in the parent."""

    TABLES, CUSTOMERS, TYPES, TOKENS = -1, -2, -3, -4

    def __init__(self, rows: list, hot: np.ndarray, turn: int) -> None:
        n = {r["what"]: int(r["n"]) for r in rows}
        self.tokens, self.types = n.get(self.TOKENS, 0), n.get(self.TYPES, 0)
        self.hot_customers = np.array([n.get(i, 0) for i in range(len(hot))], np.int64)
        self.root_customers = n.get(self.CUSTOMERS, 0) + int(self.hot_customers.sum())
        tables = n.get(self.TABLES, 0)
        base = (ROOT_STRENGTH + ROOT_DISCOUNT * (tables + len(hot))) / (self.types + 1)
        self.hot_tables = fresh_tables(self.hot_customers, np.full(len(hot), base), ROOT_DISCOUNT, np.random.default_rng([turn + 1, 1 << 40]))
        self.root_tables = tables + int(self.hot_tables.sum())
        self.base = (ROOT_STRENGTH + ROOT_DISCOUNT * self.root_tables) / (self.types + 1)

    def chance(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent's probability of tokens with so many customers and tables in it."""
        return (customers - ROOT_DISCOUNT * tables + self.base) / (ROOT_STRENGTH + self.root_customers)


class _Bucket:
    """A bucket's seating: pairs of several customers, and its tokens in the parent, as packed in a row.

    Pairs whose customers move in most steps of a sweep come first. An owner of pairs is a key (by its place among the bucket's) or, after them, a hot token (`hots`:
    places among all hot ones). `contexts` are those of the pairs, ordered by their buckets; `kept` sums the samples' tables.
    After the last sweep a row has only what answers are made of (ANSWERED).
    """

    FIELDS = {"owner": np.uint32, "context_at": np.uint32, "count": np.uint32, "tables": np.uint32, "sizes": np.uint32, "kept": np.uint32, "contexts": U64, "lone": np.uint32, "hots": np.uint32, "as_token": np.uint32, "root_tables": np.uint32, "root_sizes": np.uint32, "root_kept": np.uint32}
    ANSWERED = ("kept", "root_kept")

    def __init__(self, **arrays: np.ndarray) -> None:
        for name, kind in self.FIELDS.items():
            setattr(self, name, arrays.get(name, np.empty(0, kind)))

    @classmethod
    def read(cls, packed: bytes) -> _Bucket:
        arrays, at = {}, 8 * len(cls.FIELDS)
        for (name, kind), n in zip(cls.FIELDS.items(), np.frombuffer(packed, np.int64, len(cls.FIELDS)).tolist(), strict=True):
            arrays[name] = _read_small(packed[at : at + n]) if kind is np.uint32 else _read_planes(packed[at : at + n], "<u8")
            at += n
        return cls(**arrays)

    def packed(self, last: bool = False) -> bytes:
        arrays = [_planes(np.ascontiguousarray(getattr(self, n)[: 0 if last and n not in self.ANSWERED else None]).astype(k)) for n, k in self.FIELDS.items()]
        return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(arrays)

    def customers(self) -> np.ndarray:
        """Each owner's customers in the parent (a hot token's: those that this bucket sends)."""
        return self.lone + np.bincount(self.owner, self.tables, minlength=len(self.lone)).astype(np.int64)

    def sample(self, totals: Totals, context_tables: np.ndarray, rng: np.random.Generator, fresh: bool, kept: bool) -> None:
        count, keys = self.count, len(self.as_token)
        open_context = STRENGTH + DISCOUNT * context_tables[self.context_at]
        hot_chance = totals.chance(totals.hot_customers, totals.hot_tables)[self.hots]
        near = self.owner < keys
        if fresh:
            guess = np.append(self.as_token / max(1, totals.tokens), hot_chance)
            seats = Seats.fresh(count, open_context * guess[self.owner], DISCOUNT, rng)
            self.tables = seats.tables
            root = Seats.fresh(self.customers()[:keys], np.full(keys, totals.base), ROOT_DISCOUNT, rng)
        else:
            seats, root = Seats(self.tables, self.sizes, DISCOUNT), Seats(self.root_tables, self.root_sizes, ROOT_DISCOUNT)
            share, turns, done = -(-count // STEPS), _turns(count), []
            for step in range(turns.max(initial=0)):
                n = int(np.searchsorted(-turns, -step))  # pairs whose customers haven't all had their turn
                if n < len(seats.tables):
                    last = int(seats.tables[:n].sum())
                    done.append((seats.tables[n:], seats.sizes[last:]))
                    seats = Seats(seats.tables[:n], seats.sizes[:last], DISCOUNT)
                several, owner = np.repeat(np.arange(n), share[:n]), self.owner[:n]
                closed = seats.leave(several, rng) * near[:n]
                if closed.any():
                    root.leave(np.repeat(owner, closed), rng)
                chance = np.append(totals.chance(root.customers, root.tables), hot_chance)
                opened = seats.sit(several, (open_context[:n] * chance[owner])[several], rng) * near[:n]
                if opened.any():
                    dishes = np.repeat(owner, opened)
                    root.sit(dishes, np.full(len(dishes), totals.base), rng)
            tables, sizes = zip((seats.tables, seats.sizes), *done[::-1], strict=True)
            seats = Seats(np.concatenate(tables), np.concatenate(sizes), DISCOUNT)
        self.tables, self.sizes, self.root_tables, self.root_sizes = seats.tables, seats.sizes, root.tables, root.sizes
        if kept:
            self.kept = seats.tables + (self.kept if len(self.kept) else 0)
            self.root_kept = np.concatenate([self.root_kept, root.customers, root.tables])

    def rows(self, number: int, n_buckets: int, last: bool = False) -> list[tuple]:
        """The bucket's state (after the last sweep: what answers need of it), its share of the totals, and each context's tables for the context's bucket."""
        keys, customers = len(self.as_token), self.customers()
        sums = {Totals.TABLES: self.root_tables.sum(), Totals.CUSTOMERS: customers[:keys].sum(), Totals.TYPES: np.count_nonzero(self.as_token), Totals.TOKENS: self.as_token.sum()}
        sums |= dict(zip(self.hots.tolist(), customers[keys:], strict=True))
        tables = np.bincount(self.context_at, self.tables, minlength=len(self.contexts)).astype(np.int64)
        return [(number, None, self.packed(last), None, None, None, None), *((number, None, None, None, None, w, int(n)) for w, n in sums.items()), *_messages(number, self.contexts, tables, n_buckets)]


_ROWS = "bucket int, home int, state binary, contexts binary, tables binary, what int, n bigint"
_TYPES = {"bucket": pa.int32(), "home": pa.int32(), "state": pa.binary(), "contexts": pa.binary(), "tables": pa.binary(), "what": pa.int32(), "n": pa.int64()}


def _table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_TYPES)
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(_TYPES.items(), columns, strict=True)})


def _messages(number: int, contexts: np.ndarray, tables: np.ndarray, n_buckets: int) -> Iterator[tuple]:
    """Tables of contexts (ordered by bucket) for the contexts' buckets."""
    cuts = np.searchsorted((contexts % U64(n_buckets)).astype(np.int64), np.arange(n_buckets + 1))
    for home in np.flatnonzero(np.diff(cuts)).tolist():
        part = slice(cuts[home], cuts[home + 1])
        yield number, home, None, _ascending(contexts[part]), _small(tables[part]), None, None


def _by_home(contexts: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct contexts ordered by bucket, and the places of all in them."""
    distinct, at = np.unique(contexts, return_inverse=True)
    order = np.argsort(distinct % U64(n_buckets), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[at]


#: Senders of a context's tables that want no answer: its lone customers; the context's bucket itself.
LONE, OWN = -1, -2


def _build(table: pa.Table, n_buckets: int, hot: np.ndarray) -> pa.Table:
    """A bucket's first state (each pair's customers at one table), and messages of its lone customers."""
    asked, number = _Asked(table, n_buckets), table["bucket"][0].as_py()
    several, lone = asked.several, asked.count == 1
    owners = len(asked.keys) + len(asked.hots)
    contexts, at = _by_home(asked.context[several], n_buckets)
    count = asked.count[several]
    ones = np.ones(len(count), np.int64)
    bucket = _Bucket(
        owner=asked.owner[several], context_at=at, count=count, tables=ones, sizes=count, contexts=contexts, lone=np.bincount(asked.owner[lone], minlength=owners),
        hots=np.searchsorted(hot, asked.hots), as_token=asked.as_token,
    )
    root = bucket.customers()[: len(asked.keys)]
    bucket.root_tables, bucket.root_sizes = np.minimum(root, 1), root[root > 0]
    contexts, at = _by_home(asked.context[lone], n_buckets)
    return _table([*bucket.rows(number, n_buckets), *_messages(LONE, contexts, np.bincount(at, minlength=len(contexts)), n_buckets)])


def _summed(table: pa.Table, answers: bool = True) -> pa.Table:
    """Tables of a bucket's contexts over all that sent some, as answers to the senders (if wanted) and as a row of its own."""
    home = table["home"][0].as_py()
    parts = [_read_ascending(b) for b in table["contexts"].to_pylist()]
    contexts, at = np.unique(_joined(parts, U64), return_inverse=True)
    total = np.bincount(at, _joined([_read_small(b) for b in table["tables"].to_pylist()]), minlength=len(contexts)).astype(np.int64)
    rows, start = [(OWN, home, None, _ascending(contexts), _small(total), None, None)], 0
    for bucket, part in zip(table["bucket"].to_pylist(), parts, strict=True):
        if answers and bucket >= 0:
            rows.append((bucket, home, None, None, _small(total[at[start : start + len(part)]]), None, None))
        start += len(part)
    return _table(rows)


def _sweep(rows: DataFrame, sums: DataFrame, totals: Totals, turn: int, fresh: bool, kept: bool, last: bool, n_buckets: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(totals)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # cannot be: only buckets that asked are answered
            return _table([])
        number, b = left["bucket"][0].as_py(), _Bucket.read(left["state"][0].as_py())
        tables = _joined([_read_small(t) for t in right.sort_by("home")["tables"].to_pylist()])
        b.sample(shared.value, tables, np.random.default_rng([turn, number]), fresh, kept)
        return _table(b.rows(number, n_buckets, last))

    answers = sums.filter("bucket >= 0").select("bucket", "home", "tables")
    return rows.filter("state IS NOT NULL").select("bucket", "state").groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(run, _ROWS)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = x.BATCH_BYTES, bucket_bytes: int = x.BUCKET_BYTES, context_bytes: int | None = 2) -> DataFrame:
    """Every document's tokens, base score and log10 probability under the model learnt from the documents that are not held out.

    context_bytes: how many last bytes of the word before make a token's context; None: the whole word.
    """
    c = x.corpus(docs, id_col, text_col, batch_bytes, bucket_bytes)
    n = c.n_buckets
    hot = _hot(docs, text_col, n)

    def ask_pairs(batch: x.Batch) -> Iterator[x.Packed]:
        t = _Tokens(batch, context_bytes)
        as_token, as_context = (np.bincount(at, t.trained, minlength=len(t.keys)).astype(np.int64) for at in (t.token, t.context))
        for bucket, keys, pairs, hots, sizes in t.split(n, hot):
            contexts, at = _distinct(t.context[pairs], len(t.keys))
            yield bucket, [_ascending(t.keys[keys] // U64(n)), t.keys[hots].tobytes(), _small(as_token[keys]), _small(as_context[[] if t.whole else keys]), _small(sizes), _ascending(t.keys[contexts]), _small(at), _small(t.trained[pairs])]

    questions = x.ask(c, ask_pairs, "keys hots as_token as_context contexts_of contexts context_at count")
    rows = written(questions.groupBy("bucket").applyInArrow(lambda table: _build(table, n, hot), _ROWS))
    lone = written(rows.filter(F.col("bucket") == LONE).groupBy("home").applyInArrow(lambda table: _summed(table), _ROWS))

    def sums_of(rows: DataFrame, turn: int) -> tuple[DataFrame, Totals]:
        found = written(rows.filter("home IS NOT NULL").filter("bucket >= 0").unionByName(lone).groupBy("home").applyInArrow(lambda table: _summed(table, turn < BURN_IN + SAMPLES), _ROWS))
        return found, Totals(rows.filter("what IS NOT NULL").groupBy("what").agg(F.sum("n").alias("n")).collect(), hot, turn)

    (sums, totals), samples, kept = sums_of(rows, -1), [], []
    for turn in range(1 + BURN_IN + SAMPLES):
        before = [rows, *([] if sums in kept else [sums])]
        rows = written(_sweep(rows, sums, totals, turn, turn == 0, turn > BURN_IN, turn == BURN_IN + SAMPLES, n))
        released(*before)
        sums, totals = sums_of(rows, turn)
        if turn > BURN_IN:
            samples.append(totals)
            kept.append(sums)  # its answers are for the next sweep
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    tokens, known_types = totals.tokens, totals.types
    known = rows.filter("state IS NOT NULL").select("bucket", F.lit(-1).alias("sample"), "state", "contexts", "tables")
    for i, s in enumerate(kept):
        known = known.unionByName(s.filter(F.col("bucket") == OWN).select(F.col("home").alias("bucket"), F.lit(i).alias("sample"), "state", "contexts", "tables"))
    known = written(known)  # the messages of the last sweep and the sums' answers would stay on disk while all batches ask again
    released(lone, rows, *kept)

    def reply(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, right = _Asked(left, n), right.sort_by("sample").to_pylist()
        b = _Bucket.read(right[0]["state"])
        n_keys = len(asked.keys)
        of_key = [asked.as_token, *([] if asked.whole else [asked.as_context])]
        at, is_hot = _in(asked.keys, hot)
        for i, s in enumerate(shared.value):
            root = (b.root_kept[(2 * i + j) * n_keys :][:n_keys] for j in range(2))
            of_key += [np.where(is_hot, far[at], near) if len(far) else near for near, far in zip(root, (s.hot_customers, s.hot_tables), strict=True)]
        for i in range(len(shared.value)):
            found = [r for r in right if r["sample"] == i]
            tables = np.zeros(n_keys, np.int64)
            for r in found:
                where, ok = _in(asked.keys, _read_ascending(r["contexts"]))
                tables = np.where(ok, _read_small(r["tables"])[where], 0)
            of_key.append(tables)
        first = 2 - asked.whole
        roots, tables = of_key[first : -len(shared.value)], of_key[-len(shared.value) :]
        of_key[first:] = [v if i < few else _folded(v - group[i - few]) for group, few in ((roots, 2), (tables, 1)) for i, v in enumerate(group)]
        of_pair = [asked.count, np.zeros(len(asked.count), np.int64)]
        of_pair[1][asked.several] = b.kept - len(shared.value)
        out = []
        for at, sizes, columns in ((asked.key_at, asked.key_sizes, of_key), (asked.pair_at, asked.pair_sizes, of_pair)):
            ends = np.cumsum(sizes).tolist()
            out.append([_small(np.concatenate([v[at[e - m : e]] for v in columns])) for e, m in zip(ends, sizes, strict=True)])
        return pa.table({"bucket": left["bucket"], "batch": left["batch"], "of_key": pa.array(out[0], pa.binary()), "of_pair": pa.array(out[1], pa.binary())})

    answers = questions.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(reply, "bucket int, batch int, of_key binary, of_pair binary").withColumn("phase", F.lit(1))

    def make(batch: x.Batch, found: dict) -> pa.Table:
        t = _Tokens(batch, context_bytes)
        of_key, of_pair = np.zeros((2 - t.whole + 3 * len(samples), len(t.keys)), np.int64), np.zeros((2, len(t.token)), np.int64)
        for bucket, keys, pairs, _, _ in t.split(n, hot):
            for into, places, packed in zip((of_key, of_pair), (keys, pairs), found[1, bucket], strict=True):
                into[:, places] = _read_small(packed).reshape(len(into), len(places))
        count, customers, roots, tables = of_key[0], of_key[1 - t.whole], of_key[2 - t.whole : -len(samples)], of_key[-len(samples) :]
        for group, few in ((roots, 2), (tables, 1)):  # samples after the first are changes
            for i in range(few, len(group)):
                group[i] = group[i - few] + _unfolded(group[i])
        chance = of_pair[0] - DISCOUNT * ((of_pair[0] > 0) + of_pair[1] / len(samples))
        for i, s in enumerate(samples):
            chance += (STRENGTH + DISCOUNT * tables[i])[t.context] * s.chance(roots[2 * i], roots[2 * i + 1])[t.token] / len(samples)
        chance = np.log10(chance / (STRENGTH + customers[t.context]))
        base = np.log10(count + 1.0) - np.log10(tokens + known_types + 1.0)
        by_row = lambda w: np.bincount(t.row, w, minlength=len(batch.ids))
        of_token = t.token[t.pair_at]
        return pa.table({
            id_col: pa.array(batch.ids, pa.int64(), mask=batch.null_ids), "held_out": pa.array(t.held), "n_tokens": pa.array(t.n_tokens),
            "n_known": pa.array(by_row(count[of_token] > 0).astype(np.int64)), "train_tokens": pa.array(np.full(len(batch.ids), tokens, np.int64)),
            "base_score": pa.array(by_row(base[of_token])), "score": pa.array(by_row(chance[t.pair_at])),
        })

    return x.finish(c, answers, make, f"`{id_col}` bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
