"""Byte-level BPE encoding and decoding with a rank queue in a hierarchical bitmap.

The bytes of a pre-token are a linked list. Each pair of neighbours that has a merge rank waits in the bucket of its
rank, as the position of its left part; three levels of 64-bit words say which buckets are filled, so the next rank is
three find-first-set steps away however many pairs wait. Merging changes two pairs and pushes them anew; what they leave
behind in other buckets is stale and skipped when it comes up. n bytes cost O(n log n) at most, also in one pre-token of
a whole document. Documents are independent: encoding is one pass without a shuffle, pre-tokens seen before by the same
worker come from a bounded memo.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from maskline.llm.common import id_and_text

#: Three levels of 64 bits hold ranks up to here.
MOST_RANKS = 64**3


class RankQueue:
    """Positions by rank; the smallest rank first, and within it the smallest position. Empty again after use."""

    def __init__(self) -> None:
        self.low, self.middle, self.top = [0] * 64**2, [0] * 64, 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        if rank in self.buckets:
            heappush(self.buckets[rank], position)
            return
        self.buckets[rank] = [position]
        word, part = rank >> 6, rank >> 12
        if not self.low[word]:
            self.middle[part] |= 1 << (word & 63)
            self.top |= 1 << part
        self.low[word] |= 1 << (rank & 63)

    def pop(self) -> tuple[int, int]:
        """The queue must not be empty: top says so."""
        part = (self.top & -self.top).bit_length() - 1
        bits = self.middle[part]
        word = (part << 6) | ((bits & -bits).bit_length() - 1)
        bits = self.low[word]
        lowest = bits & -bits
        rank = (word << 6) | (lowest.bit_length() - 1)
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        self.low[word] = bits ^ lowest
        if bits == lowest:
            self.middle[part] ^= 1 << (word & 63)
            if not self.middle[part]:
                self.top ^= 1 << part
        return rank, bucket[0]


def merge(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """Ids of one pre-token. All single bytes must have a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    rank_of, push, pop = ranks.get, queue.push, queue.pop
    after = list(range(1, n + 1))  # start of the next part; n ends the list
    before = list(range(-1, n - 1))
    waiting = [rank_of(piece[i : i + 2], -1) for i in range(n - 1)]  # rank of the pair that starts here
    waiting.append(-1)
    for i, rank in enumerate(waiting):
        if rank >= 0:
            push(rank, i)
    while queue.top:
        rank, i = pop()
        if waiting[i] != rank:
            continue  # stale
        gone = after[i]
        end = after[i] = after[gone]
        waiting[gone] = -1
        if end < n:
            before[end] = i
            new = waiting[i] = rank_of(piece[i : after[end]], -1)
            if new >= 0:
                push(new, i)
        else:
            waiting[i] = -1
        left = before[i]
        if left >= 0:
            new = waiting[left] = rank_of(piece[left:end], -1)
            if new >= 0:
                push(new, left)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec(dict):
    """Encodes and decodes by a rank file; as a dict, the memo of pre-tokens, emptied when it holds `most`."""

    def __init__(self, rank_file: str, pattern: str, most: int = 1_200_000):
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        if max(self.ranks.values()) >= MOST_RANKS:
            raise ValueError(f"ranks must be below {MOST_RANKS}")
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.name_of = {rank: str(rank) for rank in self.bytes_of}
        self.split = regex.compile(pattern).findall
        self.queue, self.most = RankQueue(), most

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(merge(piece.encode(), self.ranks, self.queue))
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(rank_file: str, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def encoded(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of docs (doc_id, text), one row per row; a null or empty text has no ids. Other columns are ignored.

    The rank file must be at the same path on all executors.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for part in parts:
            ids = [own.encode(t) for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(ids, schema.field("ids").type)], schema=schema)

    return id_and_text(docs).mapInArrow(encode, "doc_id bigint, ids array<int>")


def decoded(encoded_docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of (doc_id, ids); null ids give no bytes. The bytes need not be valid UTF-8: ids may end within a letter."""
    schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for part in parts:
            texts = [own.decode(ids or ()) for ids in part["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(texts, pa.binary())], schema=schema)

    return encoded_docs.select(encoded_docs["doc_id"].cast("bigint").alias("doc_id"), "ids").mapInArrow(
        decode, "doc_id bigint, bytes binary"
    )


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids, and of the bytes they decode to.

    One row per row of docs (doc_id, text), repeated or null ids included; a null text counts as empty. Ids and bytes
    are made and digested document by document within the task, so neither is held or shuffled.
    """
    out = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    )

    def digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for part in parts:
            counts, of_ids, of_bytes = [], [], []
            for text in part["text"].to_pylist():
                ids = own.encode(text)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(own.name_of.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], schema=schema
            )

    return id_and_text(docs).mapInArrow(digest, out)
