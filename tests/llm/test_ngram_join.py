"""The exact Jaccard self-join of word n-grams against brute force."""

import random
import re

import numpy as np
import pytest

from tidemark.llm import ngram_join


def sets_of(rows, width):
    out = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((d, {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()))
    return out


def brute(rows, width=4, percent=85):
    sets = sets_of(rows, width)
    root = {d: d for d, _ in sets if d is not None}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= percent * len(x | y):
                u, v = sorted((top(a), top(b)))
                root[v] = u
    return sorted(((d, len(x), top(d) if d is not None else None) for d, x in sets), key=repr)


def collected(df):
    return sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()], key=repr)


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_every_linked_pair_meets(percent):
    """Sets at every distance that links share a key of what the larger one looks up and the smaller one is indexed by, whatever the counts."""
    rng, bands = np.random.default_rng(percent), ngram_join.Bands(percent)
    seen = 0
    for _ in range(600):
        s = int(rng.integers(1, 500))
        u, h = rng.integers(1, 2**63, size=2 * s + 2, dtype=np.uint64), int(ngram_join.distance(s, percent))
        drop = int(rng.integers(0, h + 1))
        x, y = u[:s], np.concatenate([u[drop:s], u[s : s + h - drop]])
        if not len(y) or 100 * (s - drop) < percent * (s + h - drop) or set(x) == set(y):
            continue
        large, small = (x, y) if len(x) >= len(y) else (y, x)
        counts, asked, held = rng.integers(0, 100, size=1 << 12).astype(np.int32), [], []
        for up, _, size, keys in ngram_join._schemes(bands, large, np.array([0, len(large)])):
            if not up:
                exact, wide = keys.allocate(counts, ngram_join.distance(size, percent) + 1)
                asked = [*keys.keys[exact].tolist(), *keys.keys_without[wide[keys.slot_without]].tolist()]
        for _, _, _, keys in ngram_join._schemes(bands, small, np.array([0, len(small)])):
            held += [*keys.keys.tolist(), *keys.keys_without.tolist()]
        assert set(asked) & set(held)
        (one, two), n = (ngram_join.sketches(bands, z, np.array([0, len(z)])) for z in (large, small)), tuple(np.array([len(z)]) for z in (large, small))
        assert sum(len(i) for i, _ in ngram_join.near(one, two, n, percent)) == 1
        seen += 1
    assert seen > 100


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, d = [], 0
    for n in (3, 4, 6, 9, 12, 20, 45, 80, 150, 400, 900):
        for _ in range(3):
            base = [rng.choice(vocabulary) for _ in range(n)]
            for edits in (0, 0, 1, 1, 2, 3, 5, 9):
                w = list(base)
                for _ in range(edits):
                    at = rng.randrange(len(w))
                    kind = rng.random()
                    w[at : at + 1] = [] if kind < 0.3 and len(w) > 1 else [rng.choice(vocabulary)] if kind < 0.6 else [w[at], rng.choice(vocabulary)]
                rows.append((d, " ".join(w).upper() if rng.random() < 0.2 else "  ".join(w)))
                d += 1
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows += [(d + i, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    long = [rng.choice(vocabulary) for _ in range(12_000)]
    odd = [None, "", " \n\t", "a", "A", "a b", "a b c", "a b c d", "x " * 50, "X " * 60, " ".join(long), " ".join(long[:11_000]), " ".join(long[:10_000])]
    rows += [(10**6 + i, t) for i, t in enumerate(odd)] + [(None, "a b c d"), (None, passage)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "percent", "hot"), [(4, 85, 100_000), (4, 85, 20), (2, 70, 100_000)])
def test_join(spark, rows, width, percent, hot):
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n int, name int").repartition(4)
    assert collected(ngram_join.join(docs, width=width, percent=percent, hot=hot)) == brute(rows, width, percent)


def test_join_of_an_empty_table(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert collected(ngram_join.join(spark.createDataFrame([(1, None), (2, "a")], "doc_id long, text string"))) == [(1, 0, 1), (2, 1, 2)]


def test_rows_with_one_id(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (3, "q")]
    assert collected(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"))) == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 1, 3)]
