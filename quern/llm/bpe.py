"""Problem 7: the whole corpus encoded with a public byte-level BPE tokenizer.

The distinct words of a batch form one sequence of symbols. An index maps every pair of neighbouring
symbols to all its positions; active pairs are taken in ascending order of rank, all their positions are
merged, and only the position lists of the pairs next to a merge change. Each distinct word is merged
once for the batch, however often it occurs.

Edge cases, all covered by tests: null and empty texts have no ids (an empty list); strings of special
tokens are ordinary text; texts of any length are read whole; repeated rows are each encoded; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame

#: Folder of the public tokenizers' files; a parameter, since clusters keep them elsewhere.
TOKENIZERS = "/opt/tokenizers"
#: Words kept merged between batches; when full, the memory is cleared (only speed depends on it).
MEMORY = 500_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabulary files of byte-level BPE."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Vocabulary:
    """Ids and merges of a byte-level BPE file of the ``tokenizers`` library.

    ``pairs`` maps (left id, right id) to (rank, merged id).
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids: dict[str, int] = model["vocab"]
        self.bytes = [ids[c] for _, c in sorted(byte_letters().items())]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs.setdefault((ids[a], ids[b]), (rank, ids[a + b]))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# How byte-level BPE vocabularies of this kind cut a text into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def merge_words(words: list[bytes], vocab: Vocabulary) -> list[list[int]]:
    """Ids of each word, all words merged together through one pair occurrence index."""
    symbol: list[int] = []
    end_of: list[int] = []
    for w in words:
        symbol += [vocab.bytes[b] for b in w]
        symbol.append(-1)  # keeps words apart: no pair holds it
        end_of.append(len(symbol))
    n = len(symbol)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = vocab.pairs
    places: dict[tuple[int, int], list[int]] = {}
    for i in range(n - 1):
        pair = (symbol[i], symbol[i + 1])
        if pair in places:
            places[pair].append(i)
        elif pair in pairs:
            places[pair] = [i]
    active = [(pairs[p][0], p) for p in places]
    heapq.heapify(active)
    while active:
        _, pair = heapq.heappop(active)
        at = places.pop(pair, None)
        if at is None:
            continue
        left, right = pair
        merged = pairs[pair][1]
        if len(at) > 1:
            at.sort()
        for i in at:
            if symbol[i] != left:
                continue
            j = after[i]
            if j >= n or symbol[j] != right:
                continue
            k = after[j]
            symbol[i], symbol[j] = merged, -2  # gone
            after[i] = k
            if k < n:
                before[k] = i
                new = (merged, symbol[k])
                if new in places:
                    places[new].append(i)
                elif new in pairs:
                    places[new] = [i]
                    heapq.heappush(active, (pairs[new][0], new))
            h = before[i]
            if h >= 0:
                new = (symbol[h], merged)
                if new in places:
                    places[new].append(h)
                elif new in pairs:
                    places[new] = [h]
                    heapq.heappush(active, (pairs[new][0], new))
    out, start = [], 0
    for end in end_of:
        out.append([s for s in symbol[start : end - 1] if s >= 0])
        start = end
    return out


class Encoder:
    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.known: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; none for null and empty texts."""
        cut = [WORDS.findall(t) if t else [] for t in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        fresh = [w for w in dict.fromkeys(w for words in cut for w in words) if w not in self.known]
        if fresh:
            self.known.update(zip(fresh, merge_words([w.encode("utf-8", "replace") for w in fresh], self.vocab)))
        known = self.known
        return [[i for w in words for i in known[w]] for words in cut]


def _encode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in batches:
            ids = encoder.encode_batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in batches:
            n = [len(i) for i in encoder.encode_batch(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return run


def encode(documents: DataFrame, did: Column, text: Column, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``doc_id, ids``: one row per row, without special tokens. Rows don't move."""
    rows = documents.select(did.cast("bigint").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(_encode_batches(f"{folder}/{name}.json"), "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, did: Column, text: Column, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``doc_id, tokens``: number of ids of each text."""
    rows = documents.select(did.cast("bigint").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(_count_batches(f"{folder}/{name}.json"), "doc_id bigint, tokens bigint")
