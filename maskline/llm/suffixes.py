"""Suffix-array dedup: suffixes ordered only through `window` bytes, by most-significant-digit passes.

What repeats is wanted, not the order of all suffixes, so after each pass groups of one are dropped and only suffixes of
larger groups get their next digit. Equal windows have the same anchor at the same offset (anchors.py), which makes the
anchor's gram the first digit: one suffix stands for a run of windows. Its passes:

1. The gram. Groups of one are unique; that ends nearly all suffixes.
2. The whole run of windows around the anchor: of an equal group only the first and the last window go on, as they cover
   the run. And, where a group of the first digit falls apart here, half of a window's other bytes, after the gram and
   before it. A window holds one of the two halves, so that its group must be one of several for the window to go on.
3. The windows that are left, through all `window` bytes. Equal groups are the repeated ones, and nothing else is taken out.

The digits of the first two passes are 64-bit hashes, and only say what goes on. The last pass has two digits of 64 bits for
each window, of all its bytes, by two tables of numbers that are drawn for the run: windows are equal if both agree. Blocks
send each distinct digit once, however often it occurs in them.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from maskline.llm.anchors import BYTES, anchors, hashes, ladder, mix
from maskline.llm.blocks import (
    SPANS, SPANS_DDL, Block, by_block, by_shard, covered, each_block, pack, span_row, spread, squeeze, steps, total_bytes, unstep,
    write_blocks,
)

#: Bytes of an anchor's gram; bytes of text per block and per shard of an exchange.
GRAM, BLOCK, SHARD = 32, 4 << 20, 16 << 20
REPEATED, AFTER, BEFORE = 1, 2, 4
#: Windows that are hashed at once.
PIECE = 1 << 18


class Runs(NamedTuple):
    """Of a block's anchors: document, first and last window start, place of the anchor, hashes of the gram, of all bytes
    of the run, and of the bytes after and before the gram that make up half of the rest of a window."""

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    gram: np.ndarray
    whole: np.ndarray
    after: np.ndarray
    before: np.ndarray


def runs(block: Block, window: int, gram: int) -> Runs:
    half = (window - gram) // 2
    parts = [Runs(*[np.zeros(0, np.int64)] * 4, *[np.zeros(0, np.uint64)] * 2, *[np.zeros(0, np.uint32)] * 2)]
    for a in anchors(block.data, block.starts, window, gram):
        at = a.place + a.base
        # The first and the last window cover the run: they are less than a window apart.
        whole = hashes(a.rungs, window, a.first + a.base)
        whole = mix(whole ^ mix(hashes(a.rungs, window, a.last + a.base)))
        whole = mix(whole ^ ((a.last - a.first) << 32 | (a.place - a.first)).astype(np.uint64))
        # Where the text ends before, there are no windows that need this digit.
        after, before = hashes(a.rungs, half, at + gram), hashes(a.rungs, half, np.maximum(at - half, 0))
        parts.append(Runs(a.doc, a.first, a.last, a.place, a.gram, whole, after.astype(np.uint32), before.astype(np.uint32)))
    return Runs(*map(np.concatenate, zip(*parts, strict=True)))


def drawn() -> tuple[np.ndarray, np.ndarray]:
    """Two tables of a number for each byte."""
    return tuple(np.frombuffer(secrets.token_bytes(2048), np.uint64) for _ in range(2))


def windows(
    block: Block, begin: np.ndarray, n: np.ndarray, window: int, tables: tuple[np.ndarray, np.ndarray], chosen: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two digits, place in the block) of n windows on from each begin; only their bytes are hashed, and only the windows at
    the chosen places (sorted; all if none are given) are told."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    # About a megabyte of bytes at once, long stretches in pieces.
    pieces = -(-n // PIECE)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, n = np.repeat(begin, pieces) + nth * PIECE, np.minimum(np.repeat(n, pieces) - nth * PIECE, PIECE)
    for at in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n + window) >> 20)) + 1):
        size = n[at] + window - 1
        ends = np.cumsum(size)
        if not len(at):
            continue
        inside = np.arange(ends[-1]) - np.repeat(ends - size, size)
        place = np.repeat(begin[at], size) + inside
        whole = np.flatnonzero(inside <= np.repeat(size - window, size))
        if chosen is not None:
            whole = whole[np.isin(place[whole], chosen, assume_unique=False)]
        digits = [hashes(ladder(table[block.data[place]], window), window, whole) for table in tables]
        parts.append((*digits, place[whole]))
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def stretches(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first, last) of runs that follow each other put together, in order."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] > last[:-1] + 1)
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1) if len(doc) else np.zeros(0, np.int64)
    return doc[new], first[new], last[ends]


def distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of one member of each distinct pair, in the order of the pairs; number of each member's pair; counts)."""
    order = np.lexsort((second, first))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number, np.bincount(number)


def repeated_spans(blocks: DataFrame, shards: int, window: int, gram: int, tables: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """SPANS rows: every byte of a window that also starts elsewhere lies in one of them."""
    entry = pa.schema(
        [("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("run", pa.binary()), ("after", pa.binary()), ("before", pa.binary()), ("often", pa.binary()), ("number", pa.binary())]
    )

    def first_digits(block: Block) -> Iterator[dict]:
        found = runs(block, window, gram)
        chosen, _, counts = distinct(found.gram, found.whole)
        columns = {"run": found.whole[chosen], "after": found.after[chosen], "before": found.before[chosen]}
        columns |= {"often": counts > 1, "number": np.arange(len(chosen))}
        yield from pack(block.number, found.gram[chosen], shards, columns, ("number",))

    def settle(rows: list[dict]) -> Iterator[dict]:
        rows.sort(key=lambda r: r["block"])
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
        run = np.concatenate([spread(r["run"], np.uint64) for r in rows])
        often = np.concatenate([spread(r["often"], bool) for r in rows])
        chosen, pair, counts = distinct(keys, run)
        again = (counts > 1) | (np.bincount(pair, weights=often) > 0)
        told = np.where(again[pair], REPEATED, 0)
        # Of equal entries one, the first, goes on to the next pass.
        for name, bit in (("after", AFTER), ("before", BEFORE)):
            half = np.concatenate([spread(r[name], np.uint32) for r in rows])[chosen]
            _, group, members = distinct(keys[chosen], half)
            told[chosen] |= np.where(members[group] > 1, bit, 0)
        at = 0
        for r in rows:
            number = unstep(r["number"])
            status = told[at : at + len(number)].astype(np.uint8)
            at += len(number)
            if status.any():
                yield {"block": r["block"], "number": steps(number[status > 0]), "status": squeeze(status[status > 0])}

    answer = pa.schema([("block", pa.int64()), ("number", pa.binary()), ("status", pa.binary())])
    entries = each_block(blocks, first_digits, entry, "shard int, block bigint, keys binary, run binary, after binary, before binary, often binary, number binary")
    statuses = by_shard(entries, settle, answer, "block bigint, number binary, status binary")

    # Spans known within the block pass the exchange as a shard of their own.
    last = pa.schema(
        [("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("checks", pa.binary()), ("asks", pa.binary()), ("doc", pa.binary()), ("start", pa.binary()), ("end", pa.binary())]
    )
    last_ddl = "shard bigint, block bigint, keys binary, checks binary, asks binary, doc binary, start binary, end binary"

    def last_digits(block: Block, rows: list[dict]) -> Iterator[dict]:
        if not rows:
            return
        found = runs(block, window, gram)
        chosen, number, _ = distinct(found.gram, found.whole)
        status = np.zeros(len(chosen), np.uint8)
        for row in rows:
            status[unstep(row["number"])] |= spread(row["status"])
        settled = (status[number] & REPEATED) > 0
        # Of runs that seem to be equal, the first and the last window: they cover the run.
        doc, first, last = stretches(found.doc[settled], found.first[settled], found.last[settled])
        base = block.starts[found.doc[settled]]
        edges = np.unique(np.concatenate([base + found.first[settled], base + found.last[settled]]))
        edge = windows(block, block.starts[doc] + first, last - first + 1, window, tables, edges)
        some = chosen[(status & (AFTER | BEFORE)) > 0]
        bits = status[(status & (AFTER | BEFORE)) > 0]
        # Up to here windows end with half of their other bytes or more after the gram.
        middle = found.place[some] - (window - gram - (window - gram) // 2)
        first = np.where(bits & BEFORE, found.first[some], np.maximum(found.first[some], middle))
        last = np.where(bits & AFTER, found.last[some], np.minimum(found.last[some], middle - 1))
        some, first, last = some[first <= last], first[first <= last], last[first <= last]
        n = last - first + 1
        inner = windows(block, block.starts[found.doc[some]] + first, n, window, tables)
        digit, check, place = (np.concatenate(x) for x in zip(edge, inner, strict=True))
        if not len(digit):
            return
        doc = np.searchsorted(block.starts, place, side="right") - 1
        start = place - block.starts[doc]
        # The other windows of such runs are witnesses. A place that is there twice is one window.
        asking = np.concatenate([np.ones(len(edge[0]), bool), np.repeat(~settled[some], n)])
        order = np.lexsort((~asking, place))
        order = order[np.concatenate([[True], place[order][1:] != place[order][:-1]])]
        digit, check, doc, start, asking = (x[order] for x in (digit, check, doc, start, asking))
        chosen, pair, counts = distinct(digit, check)
        # Within the block: those that repeat here are spans at once, and stay as witnesses.
        here = (counts > 1)[pair] & asking
        if here.any():
            yield {"shard": -1 - block.number, **span_row(block.number, doc[here], start[here], start[here] + window)}
        asks = np.bincount(pair, weights=asking).astype(bool) & (counts == 1)
        order = chosen[np.lexsort((start[chosen], doc[chosen]))]
        columns = {"checks": check[order], "asks": asks[pair[order]], "doc": doc[order], "start": start[order]}
        yield from pack(block.number, digit[order], shards, columns, ("doc", "start"))

    def compare(rows: list[dict]) -> Iterator[dict]:
        if rows[0]["shard"] < 0:
            yield from ({c: r[c] for c in SPANS.names} for r in rows)
            return
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
        checks = np.concatenate([spread(r["checks"], np.uint64) for r in rows])
        asks = np.concatenate([spread(r["asks"], bool) for r in rows])
        _, number, counts = distinct(keys, checks)
        hit = (counts[number] > 1) & asks
        at = 0
        for r in rows:
            n = len(r["keys"]) // 8
            own = hit[at : at + n]
            at += n
            if own.any():
                doc, start = unstep(r["doc"])[own], unstep(r["start"])[own]
                yield span_row(r["block"], doc, start, start + window)

    passed = by_block(blocks, statuses, last_digits, last, last_ddl)
    return by_shard(passed, compare, SPANS, SPANS_DDL)


def without_repeats(
    docs: DataFrame, window: int = 400, texts: bool = False, tables: tuple[np.ndarray, np.ndarray] | None = None
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) and, if `texts`, kept_text: one row per row of docs (doc_id, text).

    Every byte of the UTF-8 text that lies in a `window`-byte string which also starts anywhere else, in another row or
    in the same one (overlaps count), is taken out; strings are judged on the input. Rows that repeat an id are different
    rows, so equal long texts lose all their bytes. A null or empty text, or one shorter than the window, loses nothing.
    kept_text leaves out what remains of letters that were cut in two; the digest does not. Other columns are ignored.
    tables are the numbers of the last digits (`drawn`).
    """
    shards = max(1, -(-total_bytes(docs) // SHARD))
    blocks = write_blocks(docs, BLOCK)
    spans = repeated_spans(blocks, shards, window, min(GRAM, window), tables or drawn())
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    ddl = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    if texts:
        fields, ddl = [*fields, ("kept_text", pa.string())], ddl + ", kept_text string"

    def cut(block: Block, rows: list[dict]) -> Iterator[dict]:
        gone = covered(len(block.data), block.starts, rows)
        for doc_id, a, b in zip(block.doc_ids, block.starts[:-1].tolist(), block.starts[1:].tolist(), strict=True):
            own = gone[a:b]
            kept = block.data[a:b][~own].tobytes() if own.any() else block.data[a:b].tobytes()
            row = {
                "doc_id": doc_id, "n_bytes": b - a, "n_removed": b - a - len(kept),
                "n_spans": int(np.count_nonzero(np.diff(own.astype(np.int8), prepend=0) == 1)),
                "kept_sha256": hashlib.sha256(kept).hexdigest(),
            }
            yield row | {"kept_text": kept.decode(errors="ignore")} if texts else row

    return by_block(blocks, spans, cut, pa.schema(fields), ddl)
