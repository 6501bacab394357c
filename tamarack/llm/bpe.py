"""Byte-level BPE encoding and decoding by batched merge rounds in numpy.

The texts are cut into words as the vocabulary's pattern says, and every distinct word is encoded
once: the symbols of many words lie in one flat array, each round looks up the ranks of all
neighbouring pairs by binary search over the sorted pair keys, and merges each word's lowest-rank
pair wherever it stands in the word, until no word has a known pair.

Null text counts as empty: no tokens. Special tokens of the vocabulary found in a text are single
ids, as the tokenizers library has it. Very long texts and words are encoded whole.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: The words of byte-level BPE: contractions, letters, numbers, other signs (each with one space before at most), white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    def __init__(self, path: str, keep: int = 400_000):
        spec = json.load(open(path, encoding="utf-8"))
        vocab: dict[str, int] = spec["model"]["vocab"]
        signs = byte_characters()
        back = {c: b for b, c in enumerate(signs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes.update({i: t.encode() for t, i in self.special.items()})
        self.decimal = {i: str(i) for i in self.bytes}
        self.first = np.array([vocab[c] for c in signs], dtype=np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        every = np.arange(1 << 16)
        self.byte_ranks = self.lookup(self.first[every >> 8], self.first[every & 255])
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.keep = keep
        self.known: dict[str, tuple[int, str, bytes]] = {}

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols by binary search over the sorted pair keys; unknown pairs get the number of merges."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], len(self.merged))

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word."""
        data = [w.encode("utf-8") for w in words]
        sizes = np.array([len(d) for d in data], dtype=np.int64)
        symbols = self.first[np.frombuffer(b"".join(data), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.merged)
        rank = np.full(len(symbols), none, dtype=np.int64)
        if len(symbols):
            raw = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.int64)
            inside = owner[:-1] == owner[1:]
            rank[:-1][inside] = self.byte_ranks[(raw[:-1][inside] << 8) | raw[1:][inside]]
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, len(symbols)))
            over = np.repeat(lowest == none, length)
            if over.any():  # words without a known pair leave
                done.append((owner[over], symbols[over]))
                symbols, owner, rank = symbols[~over], owner[~over], rank[~over]
                length, lowest = length[lowest < none], lowest[lowest < none]
                if not len(symbols):
                    break
            spots = np.flatnonzero(rank == np.repeat(lowest, length))
            # a pair that overlaps one merged just before it waits: every other one in a run of neighbours
            run = np.append(True, (np.diff(spots) != 1) | (owner[spots[1:]] != owner[spots[:-1]]))
            place = np.arange(len(spots))
            spots = spots[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            symbols[spots] = self.merged[rank[spots]]
            left = np.ones(len(symbols), dtype=bool)
            left[spots + 1] = False
            symbols, owner, rank = symbols[left], owner[left], rank[left]
            spots -= np.arange(len(spots))
            # only pairs with a new symbol need their rank again
            stale = np.zeros(len(symbols), dtype=bool)
            stale[spots] = True
            stale[spots[spots > 0] - 1] = True
            again = np.flatnonzero(stale)
            rank[again] = none
            again = again[again + 1 < len(symbols)]
            again = again[owner[again] == owner[again + 1]]
            rank[again] = self.lookup(symbols[again], symbols[again + 1])
        out: list[list[int]] = [[]] * len(words)
        for who, ids in done:
            cuts = np.flatnonzero(np.append(True, who[1:] != who[:-1])).tolist()
            flat = ids.tolist()
            for w, a, b in zip(who[cuts].tolist(), cuts, [*cuts[1:], len(flat)]):
                out[w] = flat[a:b]
        return out

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > self.keep:
            self.known = {}
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for w, ids in zip(part, self.encode_words(part)):
                self.known[w] = (len(ids), ",".join(map(self.decimal.__getitem__, ids)), b"".join(map(self.bytes.__getitem__, ids)))

    def split(self, text: str) -> list[str]:
        """The words of a text; special tokens are words of their own."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                out.append(part)
                self.known[part] = (1, str(self.special[part]), part.encode())
            else:
                out.extend(self.words.findall(part))
        return out

    def encoded(self, texts: list[str | None]) -> list[tuple[int, str, bytes]]:
        """Number of tokens, ids in decimal joined by commas, and the bytes that the ids decode to."""
        docs = [self.split(t or "") for t in texts]
        self._learn([w for d in docs for w in d if w not in self.special])
        for s, i in self.special.items():
            self.known[s] = (1, str(i), s.encode())
        out = []
        for d in docs:
            got = list(map(self.known.__getitem__, d))
            out.append((sum(g[0] for g in got), ",".join([g[1] for g in got]), b"".join([g[2] for g in got])))
        return out

    def ids(self, text: str | None) -> list[int]:
        joined = self.encoded([text])[0][1]
        return [int(x) for x in joined.split(",")] if joined else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def digests(documents: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256.

    ``path`` names a vocabulary file that every executor has, such as one of an installed package.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        bpe = Bpe(path)
        for batch in batches:
            for part in slices(batch, most=2 << 20):
                got = bpe.encoded(part.column(1).to_pylist())
                decoded = [_sha(g[2].decode("utf-8", "replace").encode("utf-8")) for g in got]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([_sha(g[1].encode()) for g in got]), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def encode(documents: DataFrame, path: str) -> DataFrame:
    """The rows of ``documents`` with a column ``token_ids`` (an array of int; it replaces a column of that name)."""
    kept = [c for c in documents.columns if c.lower() != "token_ids"]
    frame = documents.select(*kept)
    schema = T.StructType([*frame.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    at = kept.index("text")

    def run(batches):
        bpe = Bpe(path)
        for batch in batches:
            for part in slices(batch, most=2 << 20):
                got = bpe.encoded(part.column(at).to_pylist())
                ids = [[int(x) for x in g[1].split(",")] if g[1] else [] for g in got]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*kept, "token_ids"])

    return frame.mapInArrow(run, schema)
