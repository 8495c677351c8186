"""Byte-level BPE by backtracking over longest matches.

A sequence of tokens is the merge result of its text exactly if each two neighbours are: if the merges of both
tokens' bytes together give these two again. So a text is encoded from left to right by the longest token that is
compatible with the one before; where none is, the last token is taken back and shortened. A place in the text that
was left once can never be reached by another valid sequence, so each is tried once and the time is linear.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files of public tokenizers are.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges of the byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces and token pairs kept per worker; the caches start anew beyond it, results are the same.
CACHE = 500_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id."""
    out: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                tok, rank = line.split()
                out[int(rank)] = base64.b64decode(tok)
    return [out[i] for i in range(len(out))]


class Encoder:
    def __init__(self, tokens: list[bytes], pattern: str = PATTERN):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.length = [len(t) for t in tokens]
        self.split = regex.compile(pattern).findall
        self.matches = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.matches.add_word(t.decode("latin-1"), i)
        self.matches.make_automaton()
        # the longest token that is a proper prefix of each token; -1 for none
        self.shorter = [next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1) for t in tokens]
        self.fits: dict[int, bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, text: bytes) -> list[int]:
        """The merges done one by one, least rank first; only for the few bytes of a token pair."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ids.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ids:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ids[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        k = a << 32 | b
        ok = self.fits.get(k)
        if ok is None:
            if len(self.fits) >= CACHE:
                self.fits.clear()
            ok = self.fits[k] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return ok

    def encode_piece(self, text: bytes) -> list[int]:
        whole = self.ids.get(text)
        if whole is not None:
            return [whole]
        n, length = len(text), self.length
        longest = [0] * n
        for end, t in self.matches.iter(text.decode("latin-1")):
            longest[end + 1 - length[t]] = t  # ends ascend, so the last one written is the longest
        out: list[int] = []
        left = bytearray(n + 1)
        at, t = 0, longest[0]
        while at < n:
            while t >= 0:
                end = at + length[t]
                if not left[end] and (not out or self.compatible(out[-1], t)):
                    break
                t = self.shorter[t]
            if t >= 0:
                out.append(t)
                at += length[t]
                t = longest[at] if at < n else -1
            else:
                left[at] = 1
                last = out.pop()
                at -= length[last]
                t = self.shorter[last]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids without special tokens; text that looks like one is plain text."""
        out: list[int] = []
        cache = self.cache
        for piece in self.split(text):
            ids = cache.get(piece)
            if ids is None:
                ids = tuple(self.encode_piece(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[piece] = ids
            out.extend(ids)
        return out


class Decoder:
    """All tokens' bytes in one run, and each token's offset in it."""

    def __init__(self, tokens: list[bytes]):
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64)

    def decode(self, ids) -> str:
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return ""
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        first = np.cumsum(size) - size
        at = np.repeat(start - first, size) + np.arange(size.sum())
        return self.bytes[at].tobytes().decode("utf-8", "replace")


_loaded: dict[tuple, Encoder | Decoder] = {}


def _get(kind, key: str, tokens: list[bytes]):
    k = (kind, key)
    if k not in _loaded:
        _loaded[k] = kind(tokens)
    return _loaded[k]


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary as a broadcast; its size is fixed (about a megabyte), whatever the data."""
    return df.sparkSession.sparkContext.broadcast(read_ranks(path))


def encode_column(df: DataFrame, keep: list[str], text: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns `keep` and ids (array<bigint>) of each text, in one pass without a shuffle.

    Null and empty texts have an empty list. Whole texts are encoded, however long. Other columns are not read.
    """
    voc, key = _vocabulary(df, f"{folder}/{vocabulary}.tiktoken"), vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _get(Encoder, key, voc.value)
        for b in batches:
            lists = [enc.encode(t) if t else [] for t in b.column(len(keep)).to_pylist()]
            ends = np.cumsum([0] + [len(x) for x in lists])
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int64, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=keep + ["ids"])

    src = df.select(*keep, F.col(text).alias("_text"))
    return src.mapInArrow(run, ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", ids array<bigint>")


def count_tokens(df: DataFrame, keep: list[str], text: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns `keep` and n_tokens (bigint) of each text; 0 for null and empty texts."""
    voc, key = _vocabulary(df, f"{folder}/{vocabulary}.tiktoken"), vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _get(Encoder, key, voc.value)
        for b in batches:
            n = [len(enc.encode(t)) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(n, pa.int64())], names=keep + ["n_tokens"])

    src = df.select(*keep, F.col(text).alias("_text"))
    return src.mapInArrow(run, ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens bigint")


def decode_column(df: DataFrame, keep: list[str], ids: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns `keep` and text of each list of ids; an empty text for an empty or null list."""
    voc, key = _vocabulary(df, f"{folder}/{vocabulary}.tiktoken"), vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = _get(Decoder, key, voc.value)
        for b in batches:
            texts = [dec.decode(x) if x else "" for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(texts, pa.string())], names=keep + ["text"])

    src = df.select(*keep, F.col(ids).alias("_ids"))
    return src.mapInArrow(run, ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", text string")
