"""BPE encoding and decoding by batched numpy merge rounds.

The tokenizer file (JSON of the `tokenizers` library; its path is a parameter)
names the normaliser, the word pattern, the byte alphabet and the ranked merges.
Only this family is read: NFC, white space to one space, lower case, a regular
expression for words, the byte-level alphabet and a BPE model with a word-end
suffix. Anything else in the file raises ValueError.

A task collects the distinct words of a piece of its Arrow batches and lays their
symbols in one flat array. A merge round looks up every adjacent pair in the sorted
pair keys by binary search, takes the lowest rank of each word, and merges all its
occurrences from left to right; words without a mergeable pair leave. No shuffle.

Defined results: null and empty texts give no tokens and the empty string; special
token strings in a text become their own ids, as in the library; repeated rows each
give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import byte_view, pieces

#: Text bytes whose words are encoded together, and words kept between pieces: some 40 MB of a task, besides its Arrow batch and the tables.
PIECE_BYTES, KEPT_WORDS = 1 << 18, 50_000
_NO_RANK = np.iinfo(np.int64).max
#: The word pattern of the public tokenizer file, and ASCII separators that Python takes for white space and the file does not.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ODD_SPACE, _SPACE = re.compile("[\x1c-\x1f]"), regex.compile(r"\s+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Tokenizer:
    """The tables of a tokenizer file, and its merge rounds."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        model, suffix = data["model"], data["model"].get("end_of_word_suffix") or ""
        kinds = [x["type"] for x in (data["normalizer"] or {}).get("normalizers", [])]
        steps = (data["pre_tokenizer"] or {}).get("pretokenizers", [])
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"] or data.get("decoder"):
            raise ValueError("a word-end BPE tokenizer file with NFC, white space and lower case is needed")
        vocab: dict[str, int] = model["vocab"]
        self.word = regex.compile(steps[0]["pattern"]["Regex"])
        # for ASCII chunks the same words: the alternatives other than the clitics start with different characters
        self.ascii_word = re.compile(r"[a-z]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^a-z0-9]+") if self.word.pattern == WORD_PATTERN else self.word
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        chars = byte_alphabet()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.base = max(max(vocab.values()), *self.special.values(), 0) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.names = [""] * self.base
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name

    def words(self, chunk: str) -> list[str]:
        """Normalised words of a chunk without white space and special tokens."""
        if chunk.isascii():
            return self.ascii_word.findall(chunk.lower())
        # capital sigma has no final form in this normaliser
        return self.word.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NO_RANK)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words, and len + 1 offsets."""
        raw = [w.encode() for w in words]
        length = np.array([len(w) for w in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(length)
        symbols = self.inner[data]
        symbols[ends - 1] = self.final[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), length)
        ranks = self.pair_ranks(symbols, word, np.arange(len(symbols)))
        done_ids, done_words = [], []
        while len(symbols):
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.repeat(np.minimum.reduceat(ranks, start), np.diff(np.append(start, len(word))))
            over = low == _NO_RANK
            if over.any():
                done_ids.append(symbols[over])
                done_words.append(word[over])
                keep = ~over
                symbols, word, ranks, low = symbols[keep], word[keep], ranks[keep], low[keep]
                if not len(symbols):
                    break
            hit = ranks == low
            # of pairs that overlap (as in "aaa") every second one merges, from the left
            place = np.arange(len(hit))
            run = place - np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, 0))
            at = np.flatnonzero(hit & (run % 2 == 0))
            symbols[at] = self.merged[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            now = at - np.arange(len(at))  # places of the merged symbols once their right halves are gone
            symbols, word, ranks = symbols[keep], word[keep], ranks[keep]
            stale = np.zeros(len(symbols), bool)
            stale[now] = stale[np.maximum(now - 1, 0)] = True
            stale = np.flatnonzero(stale)
            ranks[stale] = self.pair_ranks(symbols, word, stale)
        ids, owner = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (done_ids, done_words))
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.uint32), np.searchsorted(owner[order], np.arange(len(words) + 1))

    def pair_ranks(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that start at the given places; a word's last symbol starts none."""
        out = np.full(len(at), _NO_RANK)
        inside = at < len(symbols) - 1
        inside[inside] = word[at[inside]] == word[at[inside] + 1]
        out[inside] = self.ranks_of(symbols[at[inside]], symbols[at[inside] + 1])
        return out


def gather(values: np.ndarray, offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked ragged rows end to end, and their len + 1 offsets."""
    sizes = offsets[picks + 1] - offsets[picks]
    out = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.arange(out[-1]) + np.repeat(offsets[picks] - out[:-1], sizes)], out


class _Index(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class _Memory:
    """Chunks and words met so far in a task with their ids; forgets them all when there are many."""

    def __init__(self, tok: Tokenizer) -> None:
        self.tok = tok
        names = [x.encode() + b" " for x in tok.names]
        self.names = np.frombuffer(b"".join(names), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in names])])
        self.forget()

    def forget(self) -> None:
        self.chunks, self.words = _Index(), _Index()
        self.chunk_ids, self.chunk_off = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.word_ids, self.word_off = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def learn(self) -> None:
        """Encodes the chunks that were asked for since the last call."""
        new, special = list(islice(self.chunks, len(self.chunk_off) - 1, None)), self.tok.special
        picks, sizes, get, words = [], [], self.words.__getitem__, self.tok.words
        for chunk in new:
            n = len(picks)
            picks += [get(chunk)] if chunk in special else map(get, words(chunk))
            sizes.append(len(picks) - n)
        fresh = list(islice(self.words, len(self.word_off) - 1, None))
        plain = [w for w in fresh if w not in special]
        ids, off = self.tok.encode_words(plain) if plain else (np.empty(0, np.uint32), np.zeros(1, np.int64))
        if len(plain) < len(fresh):
            at = [i for i, w in enumerate(fresh) if w in special]
            sides = np.array([i - n for n, i in enumerate(at)])
            ids = np.insert(ids, off[sides], [special[fresh[i]] for i in at]).astype(np.uint32)
            lengths = np.insert(np.diff(off), sides, 1)
            off = np.concatenate([[0], np.cumsum(lengths)])
        self.word_ids, self.word_off = np.concatenate([self.word_ids, ids]), np.concatenate([self.word_off, off[1:] + self.word_off[-1]])
        ids, off = gather(self.word_ids, self.word_off, np.array(picks, np.int64))
        ends = off[np.cumsum(sizes, dtype=np.int64)] if sizes else np.empty(0, np.int64)
        self.chunk_ids, self.chunk_off = np.concatenate([self.chunk_ids, ids]), np.concatenate([self.chunk_off, ends + self.chunk_off[-1]])

    def indices(self, text: str) -> list[int]:
        """Numbers of the text's chunks: what white space and special tokens part."""
        get, tok = self.chunks.__getitem__, self.tok
        cut = _SPACE.split if _ODD_SPACE.search(text) else str.split
        if tok.at_special is None or "<" not in text or not tok.at_special.search(text):
            return list(map(get, cut(text)))
        out = []
        for part in tok.at_special.split(text):
            out += [get(part)] if part in tok.special else map(get, cut(part))
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and len + 1 offsets."""
        rows = [self.indices(x) if x else [] for x in texts]
        self.learn()
        ids, off = gather(self.chunk_ids, self.chunk_off, np.fromiter(chain.from_iterable(rows), np.int64, sum(map(len, rows))))
        off = off[np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)]
        if len(self.chunks) > KEPT_WORDS:
            self.forget()
        return ids, off

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the token strings joined by one space for each row, and len + 1 offsets."""
        data, at = gather(*self.names, ids.astype(np.int64))
        at, full = at[off], np.diff(off) > 0
        keep = np.ones(len(data), bool)
        keep[at[1:][full] - 1] = False  # no space after a row's last token
        return data[keep], np.concatenate([[0], np.cumsum(np.diff(at) - full)])


def _ragged(kind: pa.DataType, values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """Ids of every whole text (`ids`: little-endian unsigned 32-bit integers), and with `decode` the decoded text.

    The tokenizer file is read on the driver and broadcast; it is a fixed file of a few MB.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    key_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # of earlier tasks, as Spark uses a worker again
        memory = _Memory(Tokenizer(spec.value))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in pieces(byte_view(texts)[1], PIECE_BYTES):
                flat, off = memory.encode(texts.slice(a, b - a).to_pylist())
                out = [ids.slice(a, b - a), _ragged(pa.binary(), flat, off * 4)]
                if decode:
                    out.append(_ragged(pa.string(), *memory.decode(flat, off)))
                yield pa.RecordBatch.from_arrays(out, names=[id_col, "ids", "decoded"][: len(out)])

    schema = f"`{id_col}` {key_type}, ids binary" + ", decoded string" * decode
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Token strings of little-endian unsigned 32-bit ids joined by one space; null ids give the empty text."""
    spec = encoded.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    key_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(Tokenizer(spec.value))
        for batch in batches:
            rows = [np.frombuffer(x or b"", "<u4") for x in batch.column(1).to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
            texts = _ragged(pa.string(), *memory.decode(np.concatenate([*rows, np.empty(0, np.uint32)]), off))
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {key_type}, decoded string")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of encode()'s rows."""
    return encoded.select(
        id_col,
        F.expr("CAST(octet_length(ids) DIV 4 AS bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
