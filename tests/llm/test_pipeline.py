"""The corpus pipeline against a plain Python version of its five stages."""

import math
import re
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from tidemark.llm.quality import ALLOWANCE, CLASSES, COMMON_WORDS, MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def histograms(t, lang):
    counts, rest = [], t
    for p in CLASSES.values():
        left = re.sub(p.replace("\\t-\\r", "\t-\r"), "", rest)
        counts.append(len(rest) - len(left))
        rest = left
    known = COMMON_WORDS.get(lang, [])
    c = Counter(w.lower() for w in words(t))
    hits = [c[w] for w in known]
    return [*counts, len(rest)], [*hits, sum(c.values()) - sum(hits)]


def distance(p, q):
    p, q = ([x / sum(v) for x in v] for v in (p, q))
    h = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0
    return math.sqrt(max(0, sum(h(x, y) + h(y, x) for x, y in zip(p, q)) / 2))


def quality(docs):
    refs = {}
    for d in docs:
        if len(words(d["text"])) >= 50:
            a, b = refs.setdefault(d["lang"], ([0] * 7, [0] * 13))
            x, y = histograms(d["text"], d["lang"])
            refs[d["lang"]] = [i + j for i, j in zip(a, x)], [i + j for i, j in zip(b, y)]
    out = []
    for d in docs:
        w = words(d["text"])
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        if len(w) < 10 or 100 * len(hit) > 20 * len(w):
            continue
        far = [distance(x, r) for x, r in zip(histograms(d["text"], d["lang"]), refs[d["lang"]])] if len(w) >= 50 else [0, 0]
        slack = ALLOWANCE / math.sqrt(len(w))
        if len(w) < 50 or far[0] <= MOST_CLASS_DISTANCE + slack and far[1] <= MOST_WORD_DISTANCE + slack:
            out.append(d)
    return out


def lines(docs):
    sites, first = defaultdict(set), {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        for i, x in enumerate(d["text"].split("\n")):
            bare = x.strip(" \t\r\x0b\x0c")
            sites[bare].add(d["source"])
            first.setdefault(bare, (d["doc_id"], i))
    def keeps(d, i, x):
        bare = x.strip(" \t\r\x0b\x0c")
        return not bare or len(sites[bare]) < 3 or first[bare] == (d["doc_id"], i)

    return [d | {"text": "\n".join(x for i, x in enumerate(d["text"].split("\n")) if keeps(d, i, x))} for d in docs]


def near(docs):
    sets = {d["doc_id"]: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))(words(lower(d["text"]))) for d in docs}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [d for d in docs if find(d["doc_id"]) == d["doc_id"]]


def clean(docs, items):
    points = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    tokens = lambda t: [w.strip(points) or w for w in words(lower(t))]
    items = [x for x in map(tokens, items) if len(x) >= 12]

    def overlaps(x, y):
        need = min(20, len(y))
        seen = defaultdict(list)
        for j, w in enumerate(y):
            seen[w].append(j)
        starts = {i - j for i, w in enumerate(x) for j in seen.get(w, ())}
        for b in starts:
            same = [x[p] == y[p - b] for p in range(max(0, b), min(len(x), b + len(y)))]
            if any(10 * sum(same[k : k + need]) >= 8 * need for k in range(len(same) - need + 1)):
                return True
        return False

    return [d for d in docs if not any(overlaps(tokens(d["text"]), y) for y in items)]


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = clean(near(lines(quality(docs))), items)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {d["doc_id"]: b"".join(i.to_bytes(4, "little") for i in lib.encode(d["text"], add_special_tokens=False).ids) for d in want}
    assert 0 < len(want) < len(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "tokenise"]


def test_last_stage_decodes(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(50)
    texts = {r.doc_id: r.text or "" for r in docs.collect()} | {-1: "", -2: "Ab<|endoftext|> é 日本"}
    odd = spark.createDataFrame([(-1, None), (-2, texts[-2])], "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES[-1][1](spark, docs.select("doc_id", "text").union(odd), SF).select("doc_id", "decoded").collect())
    assert got == {d: lib.decode(lib.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for d, t in texts.items()}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string, overlaps string, t1 string, keys string, salt string, n_lines string"


def edge_rows():
    good = " ".join(f"the {w} of" for w in ("river", "house", "garden", "winter", "letter", "market", "window", "bridge"))
    long = " ".join(f"word{i % 4000}" for i in range(30_000))
    rows = [(1, good), (1, good), (2, good), (None, good), (3, None), (4, ""), (5, " \n "), (6, "one two"), (7, long), (8, long + " end")]
    return [(d, t, "en" if i % 2 else None, None if i % 3 else "s", 1, "q", "o", "t", "k", "s", "n") for i, (d, t) in enumerate(rows)]


@pytest.mark.parametrize("stage", range(5))
def test_stages_handle_edges(spark, stage):
    """Nulls, empty and very long texts, repeated rows and clashing columns don't fail a stage; all but the last keep the columns."""
    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, docs, SF)
    rows = out.collect()
    assert f(spark, docs.limit(0), SF).count() == 0
    ids = sorted((str(r.doc_id) for r in rows), key=str)
    if stage < 4:
        assert out.columns == docs.columns
    every = sorted(str(r[0]) for r in edge_rows())
    want = {"line_dedup": every, "decontaminate": every, "tokenise": every, "near_dedup": ["1", "1", "3", "4", "5", "6", "7", "None"]}
    assert ids == want.get(name, ids) and (name != "quality_rules" or not {"3", "4", "5", "6"} & set(ids))


def test_stages_bound_arrow_batches(spark):
    """3,000 texts of 5,000 bytes don't reach a Python worker in one batch, as Spark's default has it; a bound that the session has stays."""
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 1000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    corpus_pipeline.tokenise(spark, docs, "")
    assert max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) < 2 * corpus_pipeline.ARROW_BYTES
    spark.conf.set(corpus_pipeline.ARROW_BOUND, "9999999")
    try:
        corpus_pipeline.tokenise(spark, docs, "")
        assert spark.conf.get(corpus_pipeline.ARROW_BOUND) == "9999999"
    finally:
        spark.conf.unset(corpus_pipeline.ARROW_BOUND)
