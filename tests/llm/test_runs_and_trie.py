"""Periodic runs and the conversation trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import conversation_trie, periodic_runs

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                s = w[i : i + length]
                if not any(all(s[x] == s[x + r] for x in range(length - r)) for r in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc, w):
    h, n = zlib.crc32(str(doc).encode()), len(w)
    if doc is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_runs_of_symbols():
    rng = random.Random(5)
    for _ in range(500):
        w = [rng.randint(1, rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(1, 50))]
        base, at = [rng.randint(1, 9) for _ in range(rng.randint(1, 5))], rng.randint(0, len(w))
        w = w[:at] + base * rng.randint(1, 7) + base[: rng.randint(0, len(base))] + w[at:]
        assert [tuple(r) for r in periodic_runs.runs_of(np.array(w)).tolist()] == brute_runs(w)


def test_suffix_tree_has_every_suffix():
    rng = random.Random(6)
    for _ in range(100):
        s = [rng.randint(1, 3) for _ in range(rng.randint(0, 40))] + [0]
        tree = periodic_runs.SuffixTree(s)
        _, _, rank = tree.tour(sort=True)
        assert np.argsort(rank).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        assert np.argsort(tree.reverse_ranks()).tolist() == sorted(range(len(s)), key=lambda i: [-x if x else -9 for x in s[i:]])


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    odd = [None, "", " \n\t ", "a " * 200, "b " + "a " * 150, "a b " * 100, "x " + "a b " * 90 + " y", "a a a a a", "a a a a a a", " ".join("ab cd ef".split() * 4), "é\x85 é\x85 " * 6, "A a " * 5, "a\x0bb\x0c" * 9]
    odd += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 300))) for _ in range(20)]
    odd.append(" ".join(str(i % 977) for i in range(30_000)) + " end " + " ".join(rng.choice(["on", "off"]) for _ in range(5000)))
    # also repeated rows and a null id
    return rows + list(enumerate(odd, 10**6)) + [(5 * 10**6, "a b " * 9)] * 2 + [(None, "c " * 9)]


def test_find_runs(spark, texts):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in texts], "doc_id long, text string, runs string, collapsed int").repartition(3)
    got = defaultdict(list)
    for r in periodic_runs.find_runs(docs).collect():
        got[r["doc_id"]].append((r["n_words"], [(x["start"], x["length"], x["period"]) for x in r["runs"]], r["collapsed"]))
    want = defaultdict(list)
    for d, t in texts:
        w = words(t)
        runs = brute_runs(w) if len(w) < 20_000 else None
        want[d].append((len(w), runs, collapsed(w, runs) if runs is not None else None))
    assert got.keys() == want.keys()
    for d, rows in want.items():
        for own, (n, runs, text) in zip(got[d], rows, strict=True):
            assert own[0] == n
            if runs is None:  # the long one: its first run is known
                assert (0, 30_000, 977) in own[1] and own[2].startswith(" ".join(map(str, range(977))) + " end ")
            else:
                assert own[1:] == (runs, text), d


def test_planted_runs_and_digests(spark, texts):
    texts = [x for x in texts if x[1] is None or len(x[1]) < 50_000]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_planted_runs(docs))).collect()
    got = sorted([tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in rows], key=repr)
    want = []
    for d, t in texts:
        w = planted(d, words(t))
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want.append((d, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapsed(w, runs))))
    assert got == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 10


def test_runs_of_an_empty_table(spark):
    assert periodic_runs.digests(periodic_runs.find_runs(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def brute_trie(rows, fork):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append((t is not None, t or 0, r, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest(), x))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in turns.items()}
    built = {c: own.get(c - c % 20, [])[:h] + v[h:] for c, v in own.items() for h in [zlib.crc32(str(c).encode()) % 4 if fork else 0]}
    members, kids, totals, out = defaultdict(list), defaultdict(list), {}, []
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(words(p[-1][1])) if p else 0
        totals[p] = (sum(totals[k][0] for k in kids[p]) or 1, saved + sum(totals[k][1] for k in kids[p]))
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *totals[p], sha(ends)))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def collected(df):
    return sorted([tuple(r) for r in df.select(*COLUMNS).collect()], key=repr)


@pytest.mark.parametrize("limit", [2, 7, 1024])
def test_trie(spark, limit):
    rng = random.Random(limit)
    rows = [(rng.randint(-30, 200), rng.choice([None, *range(6)]), rng.choice(["u", "a", None]), rng.choice([None, "", "a b", "c\td e", "f"])) for _ in range(900)]
    rows += [(None, 1, "u", "x"), *[(300, t, "u", f"long {t % 5}") for t in range(2000)], *[(c, 0, "u", "hot") for c in range(400, 700)]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pos int").repartition(3)
    assert collected(conversation_trie.trie(df, limit=limit)) == brute_trie(rows, fork=False)
    assert collected(conversation_trie.trie_of(conversation_trie.forked(conversation_trie.placed(df)), limit)) == brute_trie(rows, fork=True)


def test_trie_of_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.trie(df).collect() == []
    assert conversation_trie.trie(spark.createDataFrame([(None, 1, "u", "x")], df.schema)).collect() == []
