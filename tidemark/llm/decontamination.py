"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select some of a few neighbouring tokens; the selected tokens' fingerprint is
a seed, so a substitution at an unselected place leaves the seed alike. Around each place
where a seed of a document equals a seed of a test item, both are compared token by token
along the diagonal: an overlap of `overlap` tokens (or the whole item, if shorter) with at
least `percent` equal tokens marks the document. Any such overlap has a hit under some mask,
wherever its substitutions are: with a fifth of the tokens changed or fewer, a run of four
equal ones is left in any window of SPAN tokens or more, but for 15 tokens changed at places
3, 7 and 11, which the second mask hits. Limits for which that doesn't hold are refused.

1. Documents' seeds are joined with those of the items by Spark, on the seed. Before the join a
   bitmap of the items' seeds (summed by Spark, of a fixed size at most) leaves out documents'
   seeds that no item has; beyond that size more rows reach the join, and the result stays.
   Frequent seeds are dealt over SALTS.
2. What meets is a text, an item and a diagonal, once each. Candidates go to batches of
   texts of bounded size (a bitmap of the candidate texts leaves out the others before the
   shuffle), each item with its diagonals in a batch as one row, and are verified there.
3. Texts with overlaps are joined back to the documents by two 64-bit hashes.

Equal texts are searched once, so copies cost one row in each step. Hits and compared tokens
are taken in parts of at most MOST_HITS and MOST_COMPARED (or one place's). Only the two
bitmaps, of 2**26 bits at most, and the lengths of short items (seven at most) reach the driver.

Tokens are words, A-Z lower-cased, ASCII marks at their ends dropped. Defined results:
null and empty texts match nothing; items of fewer than SPAN tokens match only as a
whole, those of fewer than LEAST_TOKENS never; repeated rows and rows without id are judged
alike; without items nothing is marked; other columns pass through untouched, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bitmap, in_bitmap, written
from tidemark.llm.tokens import BASE_WORDS, U64, ascii_lower, byte_view, mix, pieces, prefix_sums, span_hashes, word_bounds, word_hashes

#: Places of a seed's tokens. Items of fewer than SPAN tokens match as a whole.
MASKS = ("1111", "1110111")
SPAN = 12
OVERLAP, PERCENT, LEAST_TOKENS = 20, 80, 5
PIECE_BYTES, BATCH_BYTES, SALTS = 1 << 19, 4 << 20, 16
MOST_HITS, MOST_COMPARED = 1 << 18, 1 << 22
_P = "__over_"
_POINTS = np.zeros(256, bool)
_POINTS[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token fingerprints of the texts end to end, and len + 1 offsets; words of marks only stay as they are."""
    data, off = byte_view(texts)
    data = ascii_lower(data)
    starts, ends, words = word_bounds(data, off)
    if len(starts):
        plain = np.flatnonzero(~_POINTS[data])
        first, last = np.searchsorted(plain, starts), np.searchsorted(plain, ends)
        some = last > first
        starts, ends = starts.copy(), ends.copy()
        starts[some], ends[some] = plain[first[some]], plain[last[some] - 1] + 1
    return word_hashes(data, starts, ends), words


def seeds_of(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The seed that starts at each place."""
    n = max(0, len(tokens) - len(mask) + 1)
    out = np.full(n, len(mask), U64)
    for i, c in enumerate(mask):
        if c == "1":
            out = out * U64(0x9E3779B97F4A7C15) + tokens[i : i + n]
    return mix(out)


def seed_places(tokens: np.ndarray, words: np.ndarray, short: list[int], items: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Seeds of rows of tokens and the places where they start, mask by mask and then by lengths of short items.

    An item has seeds of masks if it has SPAN tokens or more, else its whole is one seed.
    """
    row, size = np.repeat(np.arange(len(words) - 1), np.diff(words)), np.diff(words)
    for mask in MASKS:
        seeds = seeds_of(tokens, mask)
        at = np.flatnonzero(row[: len(seeds)] == row[len(mask) - 1 :]) if len(seeds) else np.empty(0, np.int64)
        at = at[size[row[at]] >= SPAN] if items else at
        yield seeds[at], at
    sums = prefix_sums(tokens, BASE_WORDS) if short else None
    for n in short:
        if items:
            at = words[:-1][size == n]
        else:
            at = np.flatnonzero(row[: max(0, len(row) - n + 1)] == row[n - 1 :]) if len(row) >= n else np.empty(0, np.int64)
        yield span_hashes(sums, at, at + n, BASE_WORDS), at


def verified(tokens: np.ndarray, words: np.ndarray, item_tokens: np.ndarray, item_off: np.ndarray, row: np.ndarray, item: np.ndarray, begin: np.ndarray, overlap: int, percent: int) -> Iterator[np.ndarray]:
    """Row, item and most equal tokens of the diagonals (`begin`: where the item's first token would stand) that hold an overlap."""
    size = np.diff(item_off)
    low, high = np.maximum(words[row], begin), np.minimum(words[row + 1], begin + size[item])
    need = np.minimum(overlap, size[item])
    fits = np.flatnonzero(high - low >= need)
    for a, z in parts((high - low)[fits], MOST_COMPARED):
        at = fits[a:z]
        room = (high - low)[at]
        start = np.cumsum(room) - room
        place = np.arange(int(room.sum())) - np.repeat(start, room) + np.repeat(low[at], room)
        same = tokens[place] == item_tokens[place - np.repeat(begin[at], room) + np.repeat(item_off[item[at]], room)]
        sums = np.concatenate([[0], np.cumsum(same)])
        windows = room - need[at] + 1
        first = np.arange(int(windows.sum())) + np.repeat(start - (np.cumsum(windows) - windows), windows)
        equal = sums[first + np.repeat(need[at], windows)] - sums[first]
        most = np.maximum.reduceat(equal, np.cumsum(windows) - windows)
        good = 100 * most >= np.where(size[item[at]] < SPAN, 100, percent) * need[at]
        yield np.stack([row[at], item[at], most], axis=1)[good]


def parts(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Neighbouring ranges whose sizes sum up to about `most`."""
    if not len(sizes):
        return []
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - 1) // most)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True))


def _keyed(df: DataFrame, text_col: str) -> DataFrame:
    """`t1`, `t2`, `text`: texts with their two hashes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))


def _seeds(texts: DataFrame, short: list[int], items: bool, known: np.ndarray | None = None) -> DataFrame:
    """Rows (`seed`, `t1`, `t2`, `place`): seeds of texts (`t1`, `t2`, `text`), in the bitmap if there is one."""
    shared = None if known is None else texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for a, b in pieces(byte_view(batch.column(2))[1], PIECE_BYTES):
                tokens, words = tokens_of(batch.column(2).slice(a, b - a))
                for seeds, at in seed_places(tokens, words, short, items):
                    if shared is not None:
                        some = in_bitmap(shared.value, seeds)
                        seeds, at = seeds[some], at[some]
                    row = np.searchsorted(words, at, "right") - 1
                    for i, j in parts(np.ones(len(at), np.int64), MOST_HITS):
                        columns = (seeds[i:j].view(np.int64), one[a + row[i:j]], two[a + row[i:j]], (at - words[row])[i:j])
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["seed", "t1", "t2", "place"])

    return texts.mapInArrow(run, "seed bigint, t1 bigint, t2 bigint, place bigint")


def _tokens(items: DataFrame) -> DataFrame:
    """`u1`, `u2`, `tokens` (packed fingerprints) of items with LEAST_TOKENS tokens or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, words = tokens_of(batch.column(2))
            keep = np.flatnonzero(np.diff(words) >= LEAST_TOKENS)
            packed = pa.array([tokens[words[i] : words[i + 1]].tobytes() for i in keep], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), packed], names=["u1", "u2", "tokens"])

    return items.mapInArrow(run, "u1 bigint, u2 bigint, tokens binary")


def _verify(texts: DataFrame, candidates: DataFrame, overlap: int, percent: int) -> DataFrame:
    """`t1`, `t2`, `u1`, `u2`, `matched` of verified overlaps. candidates: `batch`, `u1`, `u2`, `tokens`, `at` (array of t1, t2, begin)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        one, two = np.asarray(left["t1"]), np.asarray(left["t2"])
        row_of = {k: i for i, k in enumerate(zip(one.tolist(), two.tolist(), strict=True))}
        tokens, words = tokens_of(left["text"])
        packed = right["tokens"].to_pylist()
        item_off = np.concatenate([[0], np.cumsum([len(p) // 8 for p in packed])]).astype(np.int64)
        found = [np.empty((0, 3), np.int64)]
        hits = [(row_of.get((h["t1"], h["t2"]), -1), i, h["begin"]) for i, at in enumerate(right["at"].to_pylist()) for h in at]
        if hits and len(one):
            row, item, begin = np.array([h for h in hits if h[0] >= 0], np.int64).reshape(-1, 3).T
            found += verified(tokens, words, np.frombuffer(b"".join(packed), U64), item_off, row, item, begin + words[row], overlap, percent)
        row, item, most = np.concatenate(found).T
        u = [np.asarray(right[c]) for c in ("u1", "u2")]
        return pa.table({"t1": pa.array(one[row]), "t2": pa.array(two[row]), "u1": pa.array(u[0][item]), "u2": pa.array(u[1][item]), "matched": pa.array(most)})

    return texts.groupBy("batch").cogroup(candidates.groupBy("batch")).applyInArrow(run, "t1 bigint, t2 bigint, u1 bigint, u2 bigint, matched bigint")


def overlapping(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", overlap: int = OVERLAP, percent: int = PERCENT) -> DataFrame:
    """The texts of `docs` that verifiably overlap items: two hashes (`t1`, `t2`), the items' ids in order (`items`), most equal tokens of a window (`matched`)."""
    if overlap < SPAN or percent < PERCENT:
        raise ValueError(f"seeds find all overlaps of {SPAN} tokens or more and {PERCENT} percent or more only")
    named = _keyed(items, item_text_col).withColumnsRenamed({"t1": "u1", "t2": "u2"})
    own = named.dropDuplicates(["u1", "u2"])
    tokens = written(_tokens(own))
    size = F.expr("octet_length(tokens) DIV 8")
    short = sorted(r[0] for r in tokens.filter(size < SPAN).select(size.cast("int")).distinct().collect())
    of_items = written(_seeds(own.join(tokens.select("u1", "u2"), ["u1", "u2"], "left_semi").select("u1", "u2", "text"), short, True).withColumnsRenamed({"t1": "u1", "t2": "u2", "place": "item_place"}))
    every = _keyed(docs, text_col)
    total = every.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hits = _seeds(every, short, False, bitmap(of_items.select(F.col("seed").alias("key")).distinct())).withColumn("salt", F.pmod(F.xxhash64("t1", "place"), F.lit(SALTS)).cast("int"))
    met = hits.join(of_items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["seed", "salt"])
    met = written(met.select("t1", "t2", "u1", "u2", (F.col("place") - F.col("item_place")).alias("begin")).distinct())
    n = F.lit(max(1, -(-total // BATCH_BYTES)))
    batch = F.pmod("t1", n).cast("int").alias("batch")
    at = met.groupBy(batch, "u1", "u2").agg(F.collect_list(F.struct("t1", "t2", "begin")).alias("at"))  # of one batch of texts, one item
    candidates = at.join(tokens, ["u1", "u2"])
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(met.select(F.col("t1").alias("key")).distinct()))

    def candidate_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_bitmap(shared.value, np.asarray(b.column(0)).view(U64))))

    texts = every.mapInArrow(candidate_texts, every.schema).dropDuplicates(["t1", "t2"]).select(batch, "t1", "t2", "text")
    found = _verify(texts, candidates, overlap, percent).groupBy("t1", "t2", "u1", "u2").agg(F.max("matched").alias("matched"))
    ids = items.select(F.col(item_id_col).cast("long").alias("item"), F.xxhash64(F.coalesce(F.col(item_text_col).cast("string"), F.lit(""))).alias("u1"), F.xxhash64(F.lit(1), F.coalesce(F.col(item_text_col).cast("string"), F.lit(""))).alias("u2"))
    return written(found.join(ids, ["u1", "u2"]).groupBy("t1", "t2").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("matched").alias("matched")))


#: Texts whose overlaps are broadcast to be joined with the documents (some 50 bytes each); more are joined by a salted shuffle.
MOST_BROADCAST = 200_000


def _with_overlaps(docs: DataFrame, items: DataFrame, text_col: str, **options) -> DataFrame:
    """`docs` with the hashed text's overlaps in `__over_items` and `__over_matched`, null without any."""
    found = overlapping(docs, items, text_col, **options).withColumnsRenamed({c: f"{_P}{c}" for c in ("t1", "t2", "items", "matched")})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.withColumns({f"{_P}t1": F.xxhash64(text), f"{_P}t2": F.xxhash64(F.lit(1), text)})
    keys = [f"{_P}t1", f"{_P}t2"]
    if found.count() <= MOST_BROADCAST:
        return df.join(F.broadcast(found), keys, "left")
    salt = f"{_P}salt"  # copies of one text are many rows with one key
    df = df.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return df.join(found.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, salt], "left")


def judge(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Every document's overlapped items in order, most matched tokens, and whether it is free of them (`kept`)."""
    df = _with_overlaps(docs.select(id_col, text_col), items, text_col, **options)
    return df.select(
        id_col,
        F.coalesce(f"{_P}items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce(f"{_P}matched", F.lit(0)).cast("long").alias("n_matched"),
        F.col(f"{_P}items").isNull().alias("kept"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` without those that overlap an item."""
    return _with_overlaps(docs, items, text_col, **options).filter(F.col(f"{_P}items").isNull()).select(*docs.columns)
