"""Operators of tidemark.llm against brute force, the tokenizers library and edge cases."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontamination, line_spread, near_duplicates, pitman_yor, quality, recompression, run_length_index, surrogates, tool_calls
from tidemark.llm.queries import op10_pitman_yor
from tidemark.llm.tokens import byte_view, pieces

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = [
    (10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n\t "), (10**6 + 3, "a " * 200), (10**6 + 4, "b " + "a " * 150), (10**6 + 5, "a b " * 100), (10**6 + 6, "x " + "a b " * 90 + " y"),
    (10**6 + 7, " ".join(str(i % 7) for i in range(300))), (10**6 + 8, " ".join(str((i + 3) % 7) for i in range(100))), (10**6 + 9, "a" * 49), (10**6 + 10, "a" * 51), (10**6 + 11, "a" * 500), (10**6 + 12, "é" * 26 + "\0" * 60), (10**6 + 13, "\0" * 70), (10**6 + 14, "one"), (10**6 + 15, "ONE"),
]


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(120)
    return [tuple(r) for r in docs.collect()] + ODD


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", f"s{d % 5}", "x", "y") for d, t in rows], "doc_id long, text string, lang string, source string, batch string, n_words string").repartition(5)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def as_dict(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def test_run_length_index(spark, rows, docs):
    first, want = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        want[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g)))
    assert as_dict(run_length_index.digests(run_length_index.remove_repeats(docs, batch_bytes=20_000, bucket_bytes=20_000))) == want
    assert run_length_index.remove_repeats(empty(spark)).count() == 0


def test_run_length_index_repeated_and_null_ids(spark):
    t = "passage " * 20
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, "z" + t)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in run_length_index.remove_repeats(df).collect())
    assert got == [("1", 0), ("1", 0), ("2", 160), ("None", 160)]


def test_recompression(spark, rows, docs):
    first, want = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    for d, t in rows:
        w = words(t)
        keep = [True] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                keep[i : i + 50] = [False] * 50
        want[d] = (len(w), len(w) - sum(keep), sha(" ".join(x for x, k in zip(w, keep) if k)))
    assert as_dict(recompression.digests(recompression.remove_repeats(docs, batch_bytes=20_000, bucket_bytes=20_000))) == want
    assert recompression.remove_repeats(empty(spark)).count() == 0


def test_bpe_matches_the_library(spark, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(TOKENIZER)
    lib.no_truncation()
    lib.no_padding()
    odd = ["<|endoftext|>a<|startoftext|> b<|endoftext|>", "ΑΣ ΟΔΟΣ", "aaaaaaaaaaaaaaaa", "İstanbul ǅ", "é   x\x1c\x1dz\x85q", "it's we'LL I'd 123 ½ Ⅷ _foo__", "\x1ca'b' ''s <|endoftext", "日本 😀👍🏽", "a\x00b ﬁ Å"]
    data = rows + list(enumerate(odd, 2 * 10**6))
    got = as_dict(bpe.encode(spark.createDataFrame(data, "doc_id long, text string").repartition(3), TOKENIZER))
    for d, t in data:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert bytes(got[d][0]) == b"".join(i.to_bytes(4, "little") for i in ids), t
        assert got[d][1] == lib.decode(ids, skip_special_tokens=False), t
    enc = bpe.encode(spark.createDataFrame(data, "doc_id long, text string"), TOKENIZER)
    assert enc.join(bpe.decode_ids(enc, TOKENIZER).withColumnRenamed("decoded", "d2"), "doc_id").filter("decoded <> d2").count() == 0


def test_bpe_memory_of_a_task_is_bounded():
    """A task that meets 300,000 distinct words holds some pieces' worth, not all of them."""
    memory, rng = bpe._Memory(bpe.Tokenizer(Path(TOKENIZER).read_text(encoding="utf-8"))), random.Random(5)
    texts = pa.array([" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(300)) for _ in range(1000)])
    tracemalloc.start()
    try:
        for a, b in pieces(byte_view(texts)[1], bpe.PIECE_BYTES):
            memory.decode(*memory.encode(texts.slice(a, b - a).to_pylist()))
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, rows, docs, width):
    sets, parent = {}, {}
    for d, t in rows:
        w = words(lower(t))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        parent[d] = d

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = {d: (len(sets[d]), find(d), find(d) == d) for d in ids}
    assert as_dict(near_duplicates.classify(docs, width=width)) == want


def test_near_duplicates_hot_groups(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(100)] + [(1000 + i, " ".join(base[:i] + ["q"] + base[i + 1 :])) for i in range(60)] + [(5000 + i, f"u{i} v{i} w{i} x{i}") for i in range(50)]
    got = as_dict(near_duplicates.classify(spark.createDataFrame(rows, "doc_id long, text string"), width=2))
    assert all(got[d][1] == 0 for d in got if d < 5000) and all(got[d][1] == d for d in got if d >= 5000)
    assert near_duplicates.classify(empty(spark)).count() == 0


def test_near_duplicates_split_hot_lists(spark):
    """Lists longer than `hot` are dealt over salts, with the same result."""
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(base[:k] + [f"q{i}"] + base[k + 1 :])) for i in range(90) for k in (i % 40,)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_dict(near_duplicates.classify(df, width=2, hot=20)) == as_dict(near_duplicates.classify(df, width=2))
    assert {x[1] for x in as_dict(near_duplicates.classify(df, width=2, hot=20)).values()} == {0}


def test_near_duplicate_keys_of_two_places(spark):
    """Keys of two places that agree in the 32 bits that entries keep make two lists, each under its own place."""
    e = np.zeros(6, near_duplicates._ENTRY)
    e["key"], e["doc"], e["at"], e["n"] = 7, [1, 2, 3, 4, 5, 1], [3, 9, 9, 9, 3, 9], 10
    for salt in (0, 1):
        df = spark.createDataFrame([(0, salt, bytearray(e.tobytes()))], "bucket int, salt int, entries binary")
        got = near_duplicates._members(near_duplicates._groups(df, 80)).collect()
        assert sorted((r["at"], r["doc"]) for r in got) == [(3, 1), (3, 5), (9, 1), (9, 2), (9, 3), (9, 4)]
        assert len({r["name"] for r in got}) == 2


def test_near_duplicates_family_below_the_threshold(spark):
    """A thousand pages of one template, every two of them a little less similar than the threshold: none is linked, and no round limit is met."""
    rows = [(i, " ".join([f"t{j}" for j in range(75)] + [f"own{i}x{j}" for j in range(10)])) for i in range(1000)]
    got = as_dict(near_duplicates.classify(spark.createDataFrame(rows, "doc_id long, text string"), width=2))
    assert all(got[d] == (84, d, True) for d in got) and len(got) == 1000


def test_near_duplicates_edges(spark):
    long = " ".join(f"v{i % 5000}" for i in range(60_000))
    rows = [(1, long, "x"), (1, long, "x"), (2, long + " end", "x"), (None, long, "x"), (None, None, None), (3, "", "x"), (4, "one", None), (5, "ONE", "x")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_duplicates.classify(spark.createDataFrame(rows, "doc_id long, text string, symbols string"), width=2).collect())
    assert got == sorted([("1", 5000, "1", True)] * 2 + [("2", 5001, "1", False), ("None", 5000, "1", True), ("None", 0, "None", True), ("3", 0, "3", True), ("4", 1, "4", True), ("5", 1, "4", False)])


def test_common_counts():
    rng = random.Random(7)
    sets = [sorted(rng.sample(range(300 if i % 2 else 4000), rng.randint(0, 250))) for i in range(90)]
    packed = [np.ascontiguousarray(np.array(s, np.uint64).view(np.uint8).reshape(-1, 8)[:, : near_duplicates.FINGERPRINT]).tobytes() for s in sets]
    got = near_duplicates.common_counts(packed[:40], packed[40:])
    assert got.tolist() == [[len(set(a) & set(b)) for b in sets[40:]] for a in sets[:40]]


def test_near_duplicate_recall(spark):
    """Every document whose id is divisible by 50 against all: the share of linked pairs that share a component."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: words(lower(r.text)) for r in docs.select("doc_id", "text").collect()}
    sets = {d: {tuple(w[i : i + 2]) for i in range(len(w) - 1)} or ({tuple(w)} if w else set()) for d, w in text.items()}
    pairs = [(a, b) for a in sets if a % 50 == 0 for b in sets if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    of = {d: x[1] for d, x in as_dict(near_duplicates.classify(docs, width=2)).items()}
    assert pairs and sum(of[a] == of[b] for a, b in pairs) == len(pairs)


def test_pitman_yor(spark, rows, docs):
    tokens = {d: [*words(lower(t)), None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = Counter(w for d in tokens if not held[d] for w in tokens[d])
    n, v = sum(c.values()), len(c)
    got = as_dict(pitman_yor.score(docs, batch_bytes=30_000, bucket_bytes=30_000))
    for d, t in tokens.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        assert got[d][:4] == (held[d], len(t), sum(c[w] > 0 for w in t), n) and got[d][4] == pytest.approx(base)
    out = [d for d in tokens if held[d] and tokens[d] and len(tokens[d]) > 50]
    assert sum(got[d][5] for d in out) > sum(got[d][4] for d in out)
    assert pitman_yor.score(empty(spark)).count() == 0


def test_pitman_yor_is_a_distribution(spark):
    """Probabilities of all known tokens, the end and the unknown token sum to one, at a text's start and after a word.

    All words end in "aa", so every word leads to one context; its end probability follows from its sum, and the start's sum is then known.
    """
    rng = random.Random(3)
    vocabulary = [f"{c}aa" for c in "bcdfghklm"]
    free = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 7 == 2]
    train = [(10_000 + i, " ".join(rng.choices(vocabulary, range(1, 10), k=rng.randint(1, 12)))) for i in range(300)]
    probes = ["", "zzaa", *vocabulary, *(f"baa {w}" for w in [*vocabulary, "zzaa"])]
    got = as_dict(pitman_yor.score(spark.createDataFrame([*train, *zip(free, probes)], "doc_id long, text string"), bucket_bytes=600))
    p = {t: 10 ** got[d][5] for d, t in zip(free, probes)}
    assert all(got[d][0] for d, _ in zip(free, probes))
    end = 1 - sum(p[f"baa {w}"] for w in [*vocabulary, "zzaa"]) / p["baa"]
    assert 0 < end < 1 and p[""] + (sum(p[w] for w in vocabulary) + p["zzaa"]) / end == pytest.approx(1, abs=1e-4)
    assert end == pytest.approx(1 / 7.5, abs=0.05)  # a text has 6.5 words on average


def test_pitman_yor_query_learns_whole_words(spark, tmp_path):
    """Words that end alike are contexts of their own: what follows each is learnt, also of words outside ASCII."""
    train = [(10_000 + i, f"{a} {b}") for i in range(200) for a, b in (("nation", "one"), ("station", "two"), ("ration", "three"), ("доля", "four"), ("воля", "five"))]
    free = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 7 == 2]
    probes = [f"{a} {b}" for a in ("nation", "station", "ration", "доля", "воля") for b in ("one", "two", "three", "four", "five")]
    spark.createDataFrame([*train, *zip(free, probes)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = as_dict(op10_pitman_yor(spark, str(tmp_path)))
    score = {t: got[d][5] for d, t in zip(free, probes)}
    seen = {t for _, t in train}
    assert min(score[t] for t in seen) > max(score[t] for t in set(probes) - seen) + 2
    assert all(abs(score[t] - math.log10(1 / 5)) < 0.1 for t in seen)


@pytest.mark.parametrize("bucket_bytes", [10**6, 1000])
def test_pitman_yor_of_whole_words_is_a_distribution(spark, bucket_bytes):
    """Scores of texts of no, one and two words fix every context's end probability; the start's probabilities then sum to one.

    p[w v] = s[w] a[w, v] e[v] and p[w] = s[w] e[w], so from e[w] + sum of a[w, v] = 1 follows 1 / e = 1 + (p[w v] / p[w]) (1 / e).
    """
    rng = random.Random(3)
    vocabulary = [f"{c}aa" for c in "bcdfghklm"]
    free = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 7 == 2]
    train = [(10_000 + i, " ".join(rng.choices(vocabulary, range(1, 10), k=rng.randint(1, 12)))) for i in range(300)]
    every = [*vocabulary, "zzaa"]
    probes = ["", *every, *(f"{a} {b}" for a in every for b in every)]
    docs = spark.createDataFrame([*train, *zip(free, probes)], "doc_id long, text string")
    assert bucket_bytes > 1000 or len(pitman_yor._hot(docs, "text", 10)) > 5
    got = as_dict(pitman_yor.score(docs, batch_bytes=4000, bucket_bytes=bucket_bytes, context_bytes=None))
    p = {t: 10 ** got[d][5] for d, t in zip(free, probes)}
    step = np.array([[p[f"{a} {b}"] / p[a] for b in every] for a in every])
    ends = 1 / np.linalg.solve(np.eye(len(every)) - step, np.ones(len(every)))
    assert ((0 < ends) & (ends < 1)).all()
    assert p[""] + sum(p[w] / e for w, e in zip(every, ends)) == pytest.approx(1, abs=1e-9)


def test_pitman_yor_of_lone_pairs_is_exact(spark):
    """Pairs that occur once sit alone whatever is drawn, so scores follow from counts but for the parent's tables, which lie between one and all customers of a token."""
    train = [(10_000 + i, t) for i, t in enumerate(("a b c", "b a", "c é"))]
    assert not any(zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in train)
    texts = {d: [None, *t.split(), None] for d, t in train}
    follows = {(u, w) for t in texts.values() for u, w in zip(t, t[1:])}
    assert len(follows) == sum(len(t) - 1 for t in texts.values())
    joins, types = Counter(w for _, w in follows), len({w for _, w in follows})
    opens = Counter(u for u, _ in follows)
    got = as_dict(pitman_yor.score(spark.createDataFrame(train, "doc_id long, text string"), context_bytes=None))
    d, s, rd, rs = pitman_yor.DISCOUNT, pitman_yor.STRENGTH, pitman_yor.ROOT_DISCOUNT, pitman_yor.ROOT_STRENGTH
    total = sum(joins.values())
    for i, t in texts.items():
        bounds = []
        for few in (True, False):  # least and greatest probability of a token in the parent
            p = 0.0
            for u, w in zip(t, t[1:]):
                root = (joins[w] - rd * (joins[w] if few else 1) + (rs + rd * (types if few else total)) / (types + 1)) / (rs + total)
                p += math.log10((1 - d + (s + d * opens[u]) * root) / (s + opens[u]))
            bounds.append(p)
        assert bounds[0] - 1e-9 <= got[i][5] <= bounds[1] + 1e-9


def test_pitman_yor_keeps_no_message_while_batches_ask_again(spark, docs, monkeypatch):
    """What is on disk besides the last questions is one table, of each bucket's samples and its contexts' tables."""
    tables, real = {}, (pitman_yor.written, pitman_yor.released)

    def written(df):
        out = real[0](df)
        tables[out.inputFiles()[0].rsplit("/", 1)[0]] = out
        return out

    def released(*dfs):
        for df in dfs:
            del tables[df.inputFiles()[0].rsplit("/", 1)[0]]
        real[1](*dfs)

    monkeypatch.setattr(pitman_yor, "written", written)
    monkeypatch.setattr(pitman_yor, "released", released)
    got = pitman_yor.score(docs, batch_bytes=30_000, bucket_bytes=30_000, context_bytes=None)
    (known,) = tables.values()
    states = [pitman_yor._Bucket.read(r["state"]) for r in known.filter("state IS NOT NULL").collect()]
    assert any(len(s.kept) for s in states) and all(len(s.root_kept) for s in states)
    assert not any(len(getattr(s, n)) for s in states for n in s.FIELDS if n not in s.ANSWERED)
    assert known.filter("sample >= 0").count() == pitman_yor.SAMPLES * len(states) == known.count() - len(states)
    assert got.count() == docs.count()


@pytest.mark.parametrize("customers", [6, 60])
def test_gibbs_sweeps_reach_the_exact_distribution(customers):
    """Tables of dishes after sweeps from one table each, against their exact distribution: new ** tables times generalised Stirling numbers."""
    d, new, n = 0.8, 2.0, 3000
    ways = {1: 1.0}
    for i in range(1, customers):
        ways = {t: (ways.get(t - 1, 0) + max(i - d * t, 0) * ways.get(t, 0)) / i for t in range(1, i + 2)}
    weight = {t: w * new**t for t, w in ways.items()}
    exact = sum(t * w for t, w in weight.items()) / sum(weight.values())
    rng, count = np.random.default_rng(5), np.full(n, customers)
    seats = pitman_yor.Seats(np.ones(n), count, d)
    several = np.repeat(np.arange(n), -(-customers // pitman_yor.STEPS))
    for _ in range(25 * pitman_yor.STEPS):
        seats.leave(several, rng)
        seats.sit(several, np.full(len(several), new), rng)
    assert (seats.customers == customers).all() and seats.tables.sum() == len(seats.sizes) and seats.sizes.sum() == n * customers
    assert seats.tables.mean() == pytest.approx(exact, rel=0.05)


def test_equal_fingerprints_of_unequal_phrases_are_told_apart():
    text, off = np.frombuffer(b"aaaabbbbaaaacc", np.uint8), np.array([0, 4, 8, 12, 14])
    names = run_length_index._told_apart(text, off, np.array([7, 7, 7, 7], np.uint64)).tolist()
    assert names[0] == names[2] and len(set(names)) == 3


def test_quality(spark, rows, docs):
    got = {r.doc_id: r.quality for r in quality.assess(docs).select("doc_id", "quality").collect()}
    for d, t in rows:
        t = t or ""
        w = words(t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if words(x)]
        q = got[d]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)), d
        assert q.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w)) and (not q.base_failed or not q.kept)
    assert quality.keep(docs).columns == docs.columns
    assert quality.assess(empty(spark)).count() == 0


def test_js_distance(spark):
    row = spark.range(1).select(quality.js_distance(F.array(F.lit(1), F.lit(0)).cast("array<bigint>"), F.array(F.lit(0), F.lit(1)).cast("array<bigint>")).alias("far"), quality.js_distance(F.array(F.lit(1), F.lit(2)).cast("array<bigint>"), F.array(F.lit(2), F.lit(4)).cast("array<bigint>")).alias("same")).first()
    assert row.far == pytest.approx(1) and row.same == pytest.approx(0)


def test_line_spread(spark):
    rows = [(i, f"own {i}\nshared line\n\nrare {i % 2}", f"s{i % 6}") for i in range(60)] + [(100, None, "s1"), (101, "", None), (102, "  shared line\r", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("line", F.lit(1))
    got = {r.doc_id: r.text for r in line_spread.remove_boilerplate(df).collect()}
    assert got[0] == "own 0\nshared line\n\nrare 0" and got[1] == "own 1\n\nrare 1" and got[2] == "own 2\n"
    assert got[100] is None and got[101] == "" and got[102] == ""
    assert {r.by_sketch for r in line_spread.spreads(df, min_sites=3).collect()} <= {True, False}
    assert line_spread.remove_boilerplate(empty(spark)).count() == 0


def test_decontamination(spark):
    item = " ".join(f"word{i}" for i in range(30))
    changed = " ".join(f"word{i}" if i % 6 else "other" for i in range(30))
    docs = [(1, f"x y {item} z"), (2, f"p {changed.upper()}, q"), (3, " ".join(f"word{i}" for i in range(19))), (4, None), (5, "five words stand here alone"), (6, "clean text " * 30)]
    items = [(7, item), (8, "Five words stand, here alone!"), (9, "a b"), (10, None)]
    got = as_dict(decontamination.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert {d: v[0] for d, v in got.items()} == {1: [7], 2: [7], 3: [], 4: [], 5: [8], 6: []}
    assert {d: v[2] for d, v in got.items()} == {1: False, 2: False, 3: True, 4: True, 5: False, 6: True}


@pytest.mark.parametrize("size", range(12, 21))
def test_seeds_hit_every_accepted_overlap(size):
    changes = size * (100 - decontamination.PERCENT) // 100
    seeds = [sum(1 << at + i for i, c in enumerate(m) if c == "1") for m in decontamination.MASKS for at in range(size - len(m) + 1)]
    for n in range(changes + 1):
        for places in combinations(range(size), n):
            changed = sum(1 << i for i in places)
            assert any(not s & changed for s in seeds), places


def test_decontamination_finds_substitutions_anywhere(spark):
    items = [(n, [f"w{n}x{i}" for i in range(n)]) for n in (12, 15, 20, 24, 30)]
    changes = [(12, (0, 11)), (12, (4,)), (12, (3, 7)), (15, (3, 7, 11)), (20, (9, 10)), (20, (4, 8, 12, 16)), (24, (4, 9, 14, 19)), (30, (4, 9, 14, 19, 24, 29)), (20, (0, 4, 8, 12, 16)), (12, (0, 5, 11))]
    docs = [(d, " ".join(["before", *("other" if i in at else w for i, w in enumerate(dict(items)[n])), "after"])) for d, (n, at) in enumerate(changes)]
    got = as_dict(decontamination.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(n, " ".join(x)) for n, x in items], "item_id long, text string")))
    assert {d: v[0] for d, v in got.items()} == {d: [n] if d < 8 else [] for d, (n, _) in enumerate(changes)}
    with pytest.raises(ValueError, match="percent"):
        decontamination.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"), percent=70)


def test_decontamination_against_all_pairs(spark, monkeypatch):
    """All documents against all items, diagonal by diagonal; small parts give the same."""
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    number = {}
    bare = lambda w: w.strip("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())) or w
    tokens = lambda t: np.array([number.setdefault(bare(w), len(number)) for w in words(lower(t))], np.int64)
    own = {r.item_id: tokens(r.text) for r in items.select("item_id", "text").collect()}
    want = {}
    for r in docs.select("doc_id", "text").collect():
        x, found, most = tokens(r.text), [], 0
        for item, y in own.items():
            need = min(20, len(y))
            if len(y) < 5 or len(x) < need or not np.isin(y, x).sum() >= 0.8 * need:
                continue
            same = x[:, None] == y[None]
            for k in range(need - len(x), len(y) - need + 1):
                diagonal = np.convolve(np.diagonal(same, k), np.ones(need, int), "valid")
                if 100 * diagonal.max() >= (100 if len(y) < 12 else 80) * need:
                    most = max(most, int(diagonal.max()))
                    found += [item] if item not in found else []
        want[r.doc_id] = (sorted(found), most, not found)
    assert as_dict(decontamination.judge(docs, items)) == want and sum(not k for _, _, k in want.values()) > 2
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", 0)
    kept = decontamination.keep_clean(docs.withColumn("overlaps", F.lit(1)).withColumn("t1", F.lit(1)), items)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, x in want.items() if x[2]) and kept.columns == [*docs.columns, "overlaps", "t1"]


def test_decontamination_edges(spark):
    long = " ".join(f"v{i % 900}" for i in range(100_000))
    docs = spark.createDataFrame([(None, "five words stand here alone"), (1, None), (1, ""), (2, long), (2, long), (3, "a " * 500)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Five words stand here alone"), (1, "Five words stand here alone"), (2, " ".join(f"v{i}" for i in range(100, 160))), (None, "a " * 40), (4, None), (5, "")], "item_id long, text string")
    got = sorted((str(r.doc_id), r["items"], r.n_matched, r.kept) for r in decontamination.judge(docs, items).collect())
    assert got == [("1", [], 0, True), ("1", [], 0, True), ("2", [2], 20, False), ("2", [2], 20, False), ("3", [], 20, False), ("None", [1], 5, False)]
    assert decontamination.judge(docs.limit(0), items).count() == 0
    assert decontamination.keep_clean(docs, items.limit(0)).count() == 6


def test_surrogates(spark):
    rows = [(1, "Call +1 (743) 555-3824 or 743-555-3824, card 4785 3805-9239 1139, Hein.19@mail5.example.com"), (2, 'Mr. John Smith met Mrs Anna SMITH at 10.2.3.4. token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'), (3, None), (4, "no 1 2"), (5, "hein.19@MAIL5.example.com Господин Иванов")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = as_dict(surrogates.pseudonymise(df, "k", count=True))
    assert got[3] == (None, 0) and got[4] == ("no 1 2", 0)
    for secret in ("555-3824", "9239", "ohn", "mith", "10.2.3.4", "24be64", "ein.19", "Иванов"):
        assert not any(secret.lower() in (t or "").lower() for t, _ in got.values()), secret
    one = re.match(r"Call \+1 \((\d{3})\) (\d{3}-\d{4}) or (\d{3})-(\d{3}-\d{4}), card ([\d -]+), (\S+)$", got[1][0])
    assert one[1] == one[3] and one[2] == one[4] and got[5][0].startswith(one[6] + " Господин ")
    digits = [int(x) for x in re.sub(r"\D", "", one[5])]
    assert len(digits) == 16 and sum(sum(divmod(2 * x, 10)) if i % 2 == 0 else x for i, x in enumerate(digits)) % 10 == 0
    two = re.match(r'Mr\. (\w+n) (\w+) met Mrs (\w+a) (\w+) at 2[45]\d\.', got[2][0])
    assert two and two[2].lower() == two[4].lower()
    table = surrogates.assign(spark.createDataFrame([(i, f"user{i}@x.org 10.{i // 250}.{i % 250}.9") for i in range(1500)], "doc_id long, text string"), "k")
    assert table.filter("kind = 'domain'").count() == 1
    table = table.filter("kind <> 'domain'")
    assert table.count() == 3000 and table.select("kind", "surrogate").distinct().count() == 3000


def test_surrogates_keep_checks_ranges_and_domains(spark):
    import ipaddress

    rows = [
        (1, "anna@acme.com bob@ACME.com carl@other.org x@mail.acme.com"), (2, "IBAN DE89 3704 0044 0532 0130 00 or DE89370400440532013000, GB29NWBK60161331926819"),
        (3, "SSN 123-45-6789, call 212-555-0199 or +1 (212) 555-0199"), (4, "from 2a02:8108::1:F, 2A02:8108:0:0:0:0:1:f and fe80::1%eth0; std::vector a::b ::1 10:20:30"), (5, "see fdab:cdef:abcd:abcd:abcd:abcd:abcd:abcd and fdaa::bb."),
    ]
    got = {d: t for d, t in surrogates.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    one, two, three, four = (x.split("@")[1] for x in got[1].split())
    assert one == two and len({one, three, four}) == 3 and all(x.endswith(".example") for x in (one, three, four))
    assert len({x.split("@")[0] for x in got[1].split()[:3]}) == 3
    spaced, plain, british = re.fullmatch(r"IBAN (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) or (DE\d{20}), (GB\d\d[A-Z]{4}\d{14})", got[2]).groups()
    assert spaced.replace(" ", "") == plain != "DE89370400440532013000"
    for x in (plain, british):
        assert int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    assert re.fullmatch(r"SSN 9\d\d-\d\d-\d{4}, call ([01]\d\d)-(\d{3}-\d{4}) or \+1 \(\1\) \2", got[3])
    net = ipaddress.ip_network("2001:db8::/32")
    a, b, c = re.fullmatch(r"from (\S+), (\S+) and (\S+)%eth0; std::vector a::b ::1 10:20:30", got[4]).groups()
    assert a == b != c and all(ipaddress.ip_address(x) in net for x in (a, c))
    assert all(ipaddress.ip_address(x) in net for x in re.fullmatch(r"see (\S+) and (\S+)\.", got[5]).groups())


def test_surrogates_find_secrets_without_digits_alone_in_a_text(spark):
    rows = [(1, "key " + "abcdef" * 6), (2, "key sk-" + "Qwertz" * 4), (3, "skin and bones: nothing"), (4, "see fdab::cdef")]
    got = as_dict(surrogates.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k", count=True))
    assert [got[i][1] for i in (1, 2, 3, 4)] == [1, 1, 0, 1] and "abcdef" * 6 not in got[1][0] and got[2][0].startswith("key sk-") and "Qwertz" not in got[2][0]


def test_surrogates_of_a_mention_are_drawn_once(spark):
    """A mention's values are bound: as many hashes stand in what renders it as parts are drawn, not as its characters are filled."""
    mentions = spark.createDataFrame([("+1 (212) 555-0199",)], "m string")
    none = F.array().cast("array<struct<kind:string,form:string,attempt:int>>")
    plan = mentions.select(surrogates._render(F.col("m"), none, "k"))._jdf.queryExecution().analyzed().toString()
    assert 1 <= plan.count("sha2(") <= 4


def test_surrogates_resolve_collisions(spark, monkeypatch):
    real = surrogates.surrogate
    monkeypatch.setattr(surrogates, "surrogate", lambda kind, form, attempt, key: F.when(attempt == 0, F.lit("same")).otherwise(real(kind, form, attempt, key)))
    df = spark.createDataFrame([(1, "10.0.0.1 and 10.0.0.2"), (2, "10.0.0.2")], "doc_id long, text string")
    got = as_dict(surrogates.pseudonymise(df, "k"))
    assert got[1][0].startswith("same and ") and got[2][0] == got[1][0].removeprefix("same and ") != "same"


def test_surrogates_widen_until_they_are_distinct(spark, monkeypatch):
    """Draws that collide for ever in their format end by getting longer."""
    monkeypatch.setattr(surrogates, "_draw", lambda text, h: F.regexp_replace(F.regexp_replace(text, "[0-9]", "7"), "[a-zA-Z]", "x"))
    monkeypatch.setattr(surrogates, "WIDER", 2)
    df = spark.createDataFrame([(i, f"mail u{i:02}@a.org, call 555-10{i:02}-4444 ") for i in range(12)], "doc_id long, text string")
    got = as_dict(surrogates.pseudonymise(df, "k", count=True))
    assert len({x for x, _ in got.values()}) == 12 and all(n == 1 for _, n in got.values())


def test_surrogates_against_a_plain_search(spark):
    """Mentions found by another regular-expression engine are replaced, in place, by distinct surrogates of their kind; all else stays."""
    import regex

    extra = [(10**6, "Anna Smith met John Doe, Mr Doe and Frau Anna Schmidt; Anna left."), (10**6 + 1, None), (10**6 + 1, "12 x@y.org"), (None, "x@y.org x@y.org"), (10**6 + 2, "AKIA" + "A1" * 10 + " " + "word " * 50_000 + "10.1.2.3")]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + extra
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "row long, doc_id long, text string, n_replaced string")
    out = {r.row: r for r in surrogates.pseudonymise(df, "k", count=True).collect()}
    pattern, to, back = regex.compile(surrogates.ANY), {}, {}
    shapes = {k: regex.compile(surrogates.PATTERNS[k]) for k in ("email", "ip")}
    assert len(out) == len(rows)
    for i, (_, text) in enumerate(rows):
        if text is None:
            assert out[i].text is None and out[i].n_replaced == 0
            continue
        gaps, at = pattern.split(text), 0
        assert out[i].n_replaced == len(gaps) - 1 and out[i].text.startswith(gaps[0]) and out[i].text.endswith(gaps[-1])
        for gap in gaps:  # what is between mentions stays, in order
            assert (at := out[i].text.find(gap, at)) >= 0
            at += len(gap)
        found = pattern.findall(text)
        for kind, shape in shapes.items():
            before, after = [m.lower() for m in found if shape.fullmatch(m)], shape.findall(out[i].text)
            assert len(before) == len(after)
            for x, y in zip(before, after, strict=True):
                assert x != y and to.setdefault(x, y) == y and back.setdefault(y, x) == x
                assert y.endswith(".example") if kind == "email" else int(y.split(".")[0]) >= 240
    one = regex.fullmatch(r"(\w+a) (\w+) met (\w+n) (\w+), Mr (\w+) and Frau (\w+a) (\w+); Anna left\.", out[len(rows) - 5].text)
    assert one and one[4] == one[5] and one[1] == one[6] and one[2] != one[7]


TOOL_CALL = '{"tool_calls": [{"id": "%s", "name": "%s", "arguments": %s}]}'


def linked(spark, rows, schemas):
    schemas = spark.createDataFrame(schemas, "name string, argument string, type string, required boolean")
    out = tool_calls.link(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, text string, level string"), schemas)
    return {(r.conv_id, r.call_id): r for r in out.collect()}


def test_tool_calls(spark):
    rows = [
        (1, 0, TOOL_CALL % ("a", "add", '{"y": 2, "x": 1}')), (1, 1, '{"tool_call_id": "a", "content": "3"}'), (1, 2, TOOL_CALL % ("b", "add", '{"y": {"$ref": "a"}, "x": "1"}')), (1, 2, TOOL_CALL % ("c", "add", '{"x": [{"deep": {"$ref": "b"}}], "y": 1}')),
        (2, 0, TOOL_CALL % ("a", "nope", "{}")), (2, 0, TOOL_CALL % ("p", "add", '{"x": {"$ref": "q"}, "y": 1}')), (2, 0, TOOL_CALL % ("q", "add", '{"x": {"$ref": "p"}, "y": 1, "z": "\\"é\\""}')),
        (2, 3, None), (2, 4, '"tool_calls" {'), (2, 4, ""), (2, 5, TOOL_CALL % ("r", "add", '{"x": {"$ref": "later"}}')), (2, 6, TOOL_CALL % ("a", "add", '{"x": 1}')), (2, 6, TOOL_CALL % ("a", "add", '{"x": 1}')),
    ]
    got = linked(spark, rows, [("add", "x", "integer", True), ("add", "y", "integer", True)])
    assert got[1, "a"].linked and got[1, "a"].content == "3" and got[1, "a"].valid and got[1, "a"].json == '{"arguments":{"x":1,"y":2},"id":"a","name":"add"}'
    assert [(got[1, k].level, got[1, k].place, got[1, k].problems) for k in "abc"] == [(0, 1, ""), (1, 2, "type:x"), (2, 3, "type:x")]
    assert got[2, "a"].problems == "unknown_tool" and got[2, "a"].repeats == 2 and all(got[2, k].level is None and got[2, k].place is None for k in "pqr")
    assert got[2, "q"].problems == "unknown:z" and '"z":"\\"é\\""' in got[2, "q"].json and got[2, "r"].problems == "missing:y"
    assert tool_calls.malformed(spark.createDataFrame(rows, "conv_id long, turn long, text string")).select("turn").collect() == [(4,)]
    assert linked(spark, [], [("add", "x", "integer", True)]) == {}


def test_tool_call_types(spark):
    """JSON types are kept; a text that begins with $ is a text, and nested values are written in order."""
    schemas = [("f", "s", "string", False), ("f", "i", "integer", False), ("f", "n", "number", False), ("f", "b", "boolean", False), ("f", "a", "array", False), ("f", "o", "object", False), ("f", "o.k", "integer", True)]
    cases = {
        '{"s": "$100"}': "missing:o.k", '{"s": true, "o": {"k": 1}}': "type:s", '{"i": "5", "o": {"k": 1}}': "type:i", '{"i": 5.5, "n": 5, "o": {"k": "1"}}': "type:i,type:o.k",
        '{"n": 1e3, "b": false, "a": [], "o": {"k": {"$ref": "c0"}}}': "", '{"b": "true", "a": {}, "o": {"k": 1, "j": 2}}': "type:a,type:b,unknown:o.j", '{"i": null, "o": [1]}': "missing:o.k,type:i,type:o", "[1]": "missing:o.k",
    }
    got = linked(spark, [(1, i, TOOL_CALL % (f"c{i}", "f", a)) for i, a in enumerate(cases)] + [(2, 0, TOOL_CALL % ("z", "f", '{"o": {"z": [1.50, {"b": 1, "a": "é\\n"}], "k": 1}}'))], schemas)
    assert [got[1, f"c{i}"].problems for i in range(len(cases))] == list(cases.values())
    assert got[2, "z"].json == '{"arguments":{"o":{"k":1,"z":[1.5,{"a":"é\\n","b":1}]}},"id":"z","name":"f"}' and got[1, "c0"].level == 0


def test_tool_calls_are_ordered_over_all_turns(spark):
    ref = lambda x: '{"$ref": "%s"}' % x
    chain = [(1, i, TOOL_CALL % (f"c{i}", "add", '{"x": %s}' % ref(f"c{i - 1}") if i else "{}")) for i in range(10_000)]
    one_turn = [(2, 0, TOOL_CALL % (f"c{i:03}", "add", '{"x": %s}' % ref(f"c{i - 1:03}") if i else "{}")) for i in range(100)]
    needs = {"a": "", "b": "a", "c": "ab", "d": "bc", "e": "da", "p": "q", "q": "p", "r": "pa", "s": "r", "t": "?", "u": "te", "v": "v", "w": "z", "z": "a"}
    mixed = [(3, i, TOOL_CALL % (k, "add", "{%s}" % ", ".join(f'"{n}": {ref(x)}' for n, x in enumerate(v)))) for i, (k, v) in enumerate(needs.items())]
    got = linked(spark, chain + one_turn + mixed, [("add", "x", "string", False)])
    assert all((got[1, f"c{i}"].level, got[1, f"c{i}"].place) == (i, i + 1) for i in range(10_000))
    assert all((got[2, f"c{i:03}"].level, got[2, f"c{i:03}"].place) == (i, i + 1) for i in range(100))
    level = {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4, "w": 2, "z": 1}
    assert {k: got[3, k].level for k in needs} == {k: level.get(k) for k in needs}
    assert {k: got[3, k].place for k in needs} == dict.fromkeys(needs) | {"a": 1, "b": 2, "z": 3, "c": 4, "w": 5, "d": 6, "e": 7}
