"""Packing of tokenised documents into sequences by the sum-of-squares rule.

A document is its ids and a closing id. A longer one than a sequence is cut into whole sequences, the first piece taking
what is over. Other pieces are packed by groups of bounded size, each a fair sample of all pieces by a hash of the id:
within a group every piece goes where the sum, over the residual gaps, of the squared number of open sequences with that
gap becomes smallest. A new sequence counts as one more place to go until there are as many as the ids alone would fill;
from then on it is opened only for a piece that fits nowhere. Pieces come in falling length, so what is open when the
short ones come is what they can fill.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.llm.common import id_and_text, slices
from maskline.session import materialize

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)


def byte_of_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """An encoder with the ids of a byte-level BPE vocabulary file (json); merges of such files rank as their ids do."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        file = json.load(f)
    letters = byte_of_letter()
    special = {t["content"] for t in file["added_tokens"]}
    ranks = {bytes(letters[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def encode_as_file(vocabulary: str) -> Callable[[str], list[int]]:
    """The ids that tokenizers.Tokenizer gives without special tokens added: added tokens of the file that a text quotes
    are ids of their own (the longest of those that start at a place), and what lies between them is encoded by itself."""
    with open(vocabulary, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that take blanks along, or only match words or normalized text, are not read")
    ordinary, special = encoder(vocabulary).encode_ordinary, {t["content"]: t["id"] for t in added}
    if not special:
        return ordinary
    cuts = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")

    def encode(text: str) -> list[int]:
        parts = cuts.split(text)
        if len(parts) == 1:
            return ordinary(text)
        return [i for k, part in enumerate(parts) for i in ([special[part]] if k % 2 else ordinary(part))]

    return encode


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    at = n % capacity or min(n, capacity)
    yield 0, at
    while at < n:
        yield at, capacity
        at += capacity


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, closing: int = 0) -> DataFrame:
    """PIECES of docs (doc_id, text)."""

    def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encode_as_file(vocabulary)
        for part in slices(parts, 2048):
            out: list[tuple] = []
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                ids = np.array([*encode(text), closing], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    out.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(_PIECES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES
            )

    return id_and_text(docs).mapInArrow(pieces, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of each length in the given order, and how many sequences there are."""
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    n_open = np.zeros(capacity + 1, np.int64)  # by gap; full sequences are closed and count 0
    where, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    fewest = -(-int(lengths.sum()) // capacity)
    for i, s in enumerate(lengths.tolist()):
        # Growth of the sum when a sequence with gap g (s..capacity-1) takes s: g loses one, g - s wins one.
        growth = n_open[: capacity - s] - n_open[s:capacity]
        growth = np.where(n_open[s:capacity] > 0, 2 * growth + 2, np.iinfo(np.int64).max)
        if len(growth) and n_open[s]:
            growth[0] = 1 - 2 * n_open[s]  # it becomes full
        fresh = 2 * n_open[capacity - s] + 1 if s < capacity else 0
        # Of equal growths the smallest gap, an open sequence before a new one.
        best = int(np.argmin(growth)) if len(growth) else -1
        if best >= 0 and growth[best] != np.iinfo(np.int64).max and (growth[best] <= fresh or made >= fewest):
            gap = best + s
            sequence = open_by_gap[gap].pop()
            n_open[gap] -= 1
        else:
            gap, sequence, made = capacity, made, made + 1
        where[i], offset[i] = sequence, capacity - gap
        if gap > s:
            open_by_gap[gap - s].append(sequence)
            n_open[gap - s] += 1
    return where, offset, made


def packed(docs: DataFrame, vocabulary: str, capacity: int = 2048, closing: int = 0, group_pieces: int = 100_000) -> DataFrame:
    """PIECES with sequence_id and offset for docs (doc_id, text).

    A null or empty text is the closing id alone. Rows that repeat an id are packed each for itself, a null id stays null.
    Sequence numbers are unique, not gapless. `group_pieces` bounds the rows of one packing task, not the result: every
    piece is packed. An empty table gives no rows; other columns are ignored.
    """
    # Dealt by row, so that equal rows don't meet in one group.
    pieces = materialize(token_pieces(docs, vocabulary, capacity, closing).withColumn("row", F.monotonically_increasing_id()))
    n_groups = max(1, -(-pieces.count() // group_pieces))
    grouped = pieces.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(n_groups)))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        where, offset, _ = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=where * n_groups + key[0], offset=offset).drop(columns=["g", "row"])

    return grouped.groupBy("g").applyInPandas(pack, PIECES + ", sequence_id bigint, offset bigint")
