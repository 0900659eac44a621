"""Byte-level BPE encoding of whole texts with a public rank file.

Merges of a pre-token are picked from a rank queue: a three-level bitmap over the merge ranks, whose
lowest set bit is the next rank to apply, and per rank a list of the positions where that pair began.
Positions form a doubly linked list; entries that an earlier merge made stale are skipped. A merge
costs a few word operations, so the work on a pre-token of n bytes grows with n and not with n squared.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 300_000
LONG = 64


class RankQueue:
    """Positions by rank; pop() gives the smallest rank that holds any, in order of insertion."""

    __slots__ = ("levels", "lists")

    def __init__(self, ranks: int):
        self.levels = []
        n = ranks
        while True:
            n = (n + 63) >> 6
            self.levels.append([0] * n)
            if n == 1:
                break
        self.lists: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        waiting = self.lists.get(rank)
        if waiting is not None:
            waiting.append(position)
            return
        self.lists[rank] = [position]
        at = rank
        for level in self.levels:
            bit = 1 << (at & 63)
            at >>= 6
            old = level[at]
            level[at] = old | bit
            if old:
                return

    def pop(self) -> tuple[int, list[int]] | None:
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return None
            at = (at << 6) | ((word & -word).bit_length() - 1)
        rank = at
        for level in self.levels:
            bit = 1 << (at & 63)
            at >>= 6
            level[at] &= ~bit
            if level[at]:
                break
        return rank, self.lists.pop(rank)


class _Pieces(dict):
    """Ids by pre-token; short pre-tokens are kept, and the whole is emptied at CACHE entries."""

    def __init__(self, owner: Encoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, piece: str) -> list[int]:
        ids = self.owner.merge(piece.encode("utf-8", "replace"))
        if len(piece) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encodes text with the ranks of one vocabulary file."""

    def __init__(self, path: str):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.bytes = {r: t for t, r in self.ranks.items()}
        self.size = max(self.ranks.values()) + 1
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.split = regex.compile(PATTERN)
        self.pairs: dict[tuple[int, int], int] = {}
        self.queue = RankQueue(self.size)  # empty again after every merge
        self.cache = _Pieces(self)

    def _rank(self, a: int, b: int) -> int:
        """The id that a followed by b merges to, or -1."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            got = self.pairs[a, b] = self.ranks.get(self.bytes[a] + self.bytes[b], -1)
        return got

    def merge(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids = [self.single[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = self.queue
        for i in range(n - 1):
            if (r := self._rank(ids[i], ids[i + 1])) >= 0:
                queue.push(r, i)
        while (top := queue.pop()) is not None:
            rank, waiting = top
            waiting.sort()
            for k, i in enumerate(waiting):
                j = after[i] if ids[i] >= 0 else n
                if j >= n or self._rank(ids[i], ids[j]) != rank:
                    continue  # stale: a neighbour was merged since
                ids[i], ids[j] = rank, -1
                after[i] = nxt = after[j]
                if nxt < n:
                    before[nxt] = i
                smaller = False
                if (p := before[i]) >= 0 and (r := self._rank(ids[p], rank)) >= 0:
                    queue.push(r, p)
                    smaller |= r < rank
                if nxt < n and (r := self._rank(rank, ids[nxt])) >= 0:
                    queue.push(r, i)
                    smaller |= r < rank
                if smaller:  # a lower rank came up: the rest of this rank waits again
                    for rest in waiting[k + 1 :]:
                        queue.push(rank, rest)
                    break
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; special-token look-alikes are plain text, null and empty texts have none."""
        if not text:
            return []
        return list(chain.from_iterable(map(self.cache.__getitem__, self.split.findall(text))))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker and vocabulary."""
    return Encoder(path)


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of every row of df; null and empty texts give an empty list.

    Rows keep their number: repeated rows come out as often as they went in. Text is read whole.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            ids = [enc.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("key"), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
