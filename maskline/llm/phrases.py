"""Substring dedup with automata of recurring phrases.

1. Recurring phrases: the anchors (anchors.py) of all windows of words are phrases of a few words; any window that
   occurs twice has such a phrase, and it recurs. Blocks of documents send each of their phrases once, as a hash; shards
   answer with those that several blocks, or one block several times, hold.
2. Automata: the recurring phrases that a block holds are a shard of all there are, whose size the block bounds. Their
   texts are compiled into an Aho-Corasick automaton, and all documents of the block are streamed through it. Nothing else
   says where phrases are: it gives the place of every occurrence, and of texts only, whatever the hashes said.
3. Windows that hold an occurrence are compared, the first one of a block standing for the others, to find which one starts
   first. All others are taken out. Windows are compared by a 64-bit hash of their words under a key of the run's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from maskline.llm.anchors import CHUNK, anchors, hashes, ladder
from maskline.llm.blocks import (
    SPANS, SPANS_DDL, Block, by_block, by_shard, covered, each_block, pack, span_row, spread, total_bytes, unstep, write_blocks,
)
from maskline.llm.words import Words, key

#: Words of a phrase; bytes of text per block (its automaton is in memory) and per shard of an exchange.
PHRASE, BLOCK, SHARD = 5, 4 << 20, 16 << 20


def phrase_automaton(phrases: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in phrases:
        found.add_word(phrase, len(phrase))
    found.make_automaton()
    return found


def spaced(data: np.ndarray, words: Words, chosen: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(the chosen words with one space before each and one at the end, the byte places of the spaces before)."""
    size = words.end[chosen] - words.start[chosen] + 1
    begins = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(begins - words.start[chosen] + 1, size)
    out = data[np.maximum(place, 0)]
    out[begins] = 0x20
    return out.tobytes() + b" ", begins


def occurrences(text: bytes, places: np.ndarray, automaton: ahocorasick.Automaton) -> np.ndarray:
    """Numbers of the words (each after the space at its place) at which a phrase of the automaton starts."""
    begins = np.unique([end - length + 1 for end, length in automaton.iter(text.decode())])
    if not text.isascii():
        # The automaton counts letters: bytes that don't continue one.
        letters = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        places = (np.cumsum(letters) - 1)[places]
    return np.searchsorted(places, begins)


def named_phrases(block: Block, words: Words, grams: np.ndarray, window: int, phrase: int) -> list[str]:
    """The text of each of the recurring phrases (sorted hashes) that the block holds, with a space around each word."""
    text = lambda at: block.data[words.start[at] : words.end[at]].tobytes().decode()
    named: dict[int, str] = {}
    for a in anchors(words.hash, words.of_doc, window, phrase):
        known = np.flatnonzero(grams[np.minimum(np.searchsorted(grams, a.gram), len(grams) - 1)] == a.gram)
        _, first = np.unique(a.gram[known], return_index=True)
        for k in known[first].tolist():
            if (gram := int(a.gram[k])) not in named:
                at = int(words.of_doc[a.doc[k]] + a.place[k])
                named[gram] = f" {' '.join(text(at + i) for i in range(phrase))} "
    return list(named.values())


def covering(met: np.ndarray, n: int, window: int, phrase: int) -> np.ndarray:
    """Starts of the windows of a text of n words that hold a phrase met at one of the places (sorted, distinct)."""
    first, last = np.maximum(met - (window - phrase), 0), np.minimum(met, n - window)
    change = np.zeros(n + 1, np.int32)
    some = first <= last
    np.add.at(change, first[some], 1)
    np.add.at(change, last[some] + 1, -1)
    return np.flatnonzero(np.cumsum(change) > 0)


def later_windows(blocks: DataFrame, shards: int, window: int, phrase: int) -> DataFrame:
    """SPANS rows, in words: the windows whose words also start earlier."""
    own_key = key()

    def recurring(block: Block) -> Iterator[dict]:
        words = Words(block.data, block.starts, key=own_key)
        grams = [a.gram for a in anchors(words.hash, words.of_doc, window, phrase)]
        found, counts = np.unique(np.concatenate(grams or [np.zeros(0, np.uint64)]), return_counts=True)
        yield from pack(block.number, found, shards, {"often": counts > 1})

    def settle(rows: list[dict]) -> Iterator[dict]:
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
        often = np.concatenate([spread(r["often"], bool) for r in rows])
        _, number, counts = np.unique(keys, return_inverse=True, return_counts=True)
        hit = (counts > 1)[number] | (np.bincount(number, weights=often) > 0)[number]
        at = 0
        for r in rows:
            n = len(r["keys"]) // 8
            own = hit[at : at + n]
            if own.any():
                yield {"block": r["block"], "grams": keys[at : at + n][own].tobytes()}
            at += n

    first = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("often", pa.binary())])
    entries = each_block(blocks, recurring, first, "shard int, block bigint, keys binary, often binary")
    answer = pa.schema([("block", pa.int64()), ("grams", pa.binary())])
    phrases = by_shard(entries, settle, answer, "block bigint, grams binary")

    # Spans known within the block pass the exchange as a shard of their own; the first window of each kind is compared.
    last = pa.schema(
        [("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("doc_id", pa.binary()), ("doc", pa.binary()), ("start", pa.binary()), ("end", pa.binary())]
    )
    last_ddl = "shard bigint, block bigint, keys binary, doc_id binary, doc binary, start binary, end binary"

    def locate(block: Block, rows: list[dict]) -> Iterator[dict]:
        if not rows:
            return
        grams = np.sort(np.concatenate([np.frombuffer(r["grams"], np.uint64) for r in rows]))
        words = Words(block.data, block.starts, key=own_key)
        automaton = phrase_automaton(named_phrases(block, words, grams, window, phrase))
        parts = []
        for doc in range(len(block.doc_ids)):
            a, b = int(words.of_doc[doc]), int(words.of_doc[doc + 1])
            if b - a >= window:
                met = occurrences(*spaced(block.data, words, np.arange(a, b)), automaton)
                start = covering(met, b - a, window, phrase)
                # Long texts in pieces, each with what its last windows need of the next one.
                for at in range(0, b - a, CHUNK):
                    own = start[np.searchsorted(start, at) : np.searchsorted(start, at + CHUNK)]
                    if len(own):
                        rungs = ladder(words.hash[a + at : min(b, a + at + CHUNK + window - 1)], window)
                        parts.append((hashes(rungs, window, own - at), np.full(len(own), doc), own))
        if not parts:
            return
        hashed, doc, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        # A null id is later than any other.
        ids = np.array([2**63 - 1 if i is None else i for i in block.doc_ids], np.int64)
        order = np.lexsort((start, doc, ids[doc], hashed))
        later = np.concatenate([[False], hashed[order][1:] == hashed[order][:-1]])
        if later.any():
            gone = order[later]
            yield {"shard": -1 - block.number, **span_row(block.number, doc[gone], start[gone], start[gone] + window)}
        kept = order[~later]
        kept = kept[np.lexsort((start[kept], doc[kept]))]
        columns = {"doc_id": ids[doc[kept]], "doc": doc[kept], "start": start[kept]}
        yield from pack(block.number, hashed[kept], shards, columns, ("doc_id", "doc", "start"))

    def compare(rows: list[dict]) -> Iterator[dict]:
        if rows[0]["shard"] < 0:
            yield from ({c: r[c] for c in SPANS.names} for r in rows)
            return
        sizes = [len(r["keys"]) // 8 for r in rows]
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
        block = np.repeat(np.array([r["block"] for r in rows]), sizes)
        doc_id, doc, start = (np.concatenate([unstep(r[c]) for r in rows]) for c in ("doc_id", "doc", "start"))
        order = np.lexsort((start, doc, block, doc_id, keys))
        later = np.zeros(len(keys), bool)
        later[order[1:]] = keys[order][1:] == keys[order][:-1]
        at = 0
        for r, n in zip(rows, sizes, strict=True):
            own = np.flatnonzero(later[at : at + n]) + at
            at += n
            if len(own):
                yield span_row(r["block"], doc[own], start[own], start[own] + window)

    located = by_block(blocks, phrases, locate, last, last_ddl)
    return by_shard(located, compare, SPANS, SPANS_DDL)


def without_repeated_phrases(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per row of docs (doc_id, text).

    Words are runs of bytes other than blanks. A word goes when a window of `window` words that covers it has the same
    words as one that starts earlier: in a row with a smaller id, or in the same row before it. Rows without an id come
    last; rows that repeat an id follow each other in the order of the written blocks. Windows are judged on the input. A null
    or empty text has no words. Other columns are ignored.
    """
    shards = max(1, -(-total_bytes(docs) // SHARD))
    blocks = write_blocks(docs, BLOCK)
    spans = later_windows(blocks, shards, window, min(PHRASE, window))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def cut(block: Block, rows: list[dict]) -> Iterator[dict]:
        words = Words(block.data, block.starts)
        gone = covered(len(words.start), words.of_doc, rows)
        for k, doc_id in enumerate(block.doc_ids):
            a, b = int(words.of_doc[k]), int(words.of_doc[k + 1])
            own = np.flatnonzero(~gone[a:b]) + a
            text = spaced(block.data, words, own)[0][1:-1]
            yield {"doc_id": doc_id, "n_words": b - a, "n_removed": b - a - len(own), "kept_sha256": hashlib.sha256(text).hexdigest()}

    return by_block(blocks, spans, cut, schema, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")

