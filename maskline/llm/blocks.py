"""Documents in blocks of bounded size, and packed exchanges between blocks and shards.

A block holds some whole documents, their texts compressed together. Work on hashes (grams, windows, signatures) is done
block by block with numpy; a block sends each shard one row of packed entries, already made distinct within the block, so
a value that a third of the documents hold arrives once per block. A shard decides and answers the blocks. Number and
order of documents in a block are fixed by the written table, so entries can name documents by their place in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.llm.common import id_and_text, release, slices, utf8
from maskline.session import materialize

#: Documents of a block, however short they are.
MOST_DOCS = 1 << 16
BLOCK_FIELDS = "doc_ids array<bigint>, lengths array<bigint>, texts binary"


def squeeze(values: np.ndarray | bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(values if isinstance(values, bytes) else values.tobytes())


def spread(packed: bytes, kind: type = np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind)


def steps(values: np.ndarray) -> bytes:
    """Packs integers that mostly rise by a little."""
    return squeeze(np.diff(values.astype(np.int64), prepend=0))


def unstep(packed: bytes) -> np.ndarray:
    return np.cumsum(spread(packed, np.int64))


def write_blocks(docs: DataFrame, size: int) -> DataFrame:
    """(block, doc_ids, lengths, texts) of docs (doc_id, text).

    Blocks have at least `size` bytes, or MOST_DOCS documents, but for the last one of a task. Empty texts take part; a
    text that is longer than `size` ends its block.
    """

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        lengths: list[int] = []
        total = 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([squeeze(b"".join(texts), 3)], pa.binary()),
                ],
                names=["doc_ids", "lengths", "texts"],
            )

        for part in slices(parts):
            data, starts = utf8(part["text"])
            for k, doc_id in enumerate(part["doc_id"].to_pylist()):
                ids.append(doc_id)
                texts.append(data[starts[k] : starts[k + 1]].tobytes())
                lengths.append(len(texts[-1]))
                total += lengths[-1]
                if total >= size or len(ids) >= MOST_DOCS:
                    yield block()
                    ids, texts, lengths, total = [], [], [], 0
        if ids:
            yield block()
        release()

    blocks = id_and_text(docs).mapInArrow(gather, BLOCK_FIELDS)
    return materialize(blocks.withColumn("block", F.monotonically_increasing_id()))


class Block:
    """One row of write_blocks, opened."""

    def __init__(self, row: dict):
        self.number, self.doc_ids = row["block"], row["doc_ids"]
        self.lengths = np.array(row["lengths"], np.int64)
        self.data = spread(row["texts"])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)


def total_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))))).first()[0] or 0


def shards_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys >> np.uint64(33)).astype(np.int64) % shards


def pack(block: int, keys: np.ndarray, shards: int, columns: dict[str, np.ndarray], stepped: tuple[str, ...] = ()) -> Iterator[dict]:
    """A row per shard that gets entries: keys as they are, columns compressed (`stepped` ones as differences)."""
    shard = shards_of(keys, shards)
    order = np.argsort(shard, kind="stable")
    bounds = np.flatnonzero(np.diff(shard[order], prepend=-1, append=shards)) if len(order) else []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True) if len(order) else ():
        some = order[a:b]
        row = {"shard": int(shard[some[0]]), "block": block, "keys": keys[some].tobytes()}
        for name, values in columns.items():
            row[name] = steps(values[some]) if name in stepped else squeeze(values[some])
        yield row


def by_block(
    blocks: DataFrame, answers: DataFrame, work: Callable[[Block, list[dict]], Iterator[dict]], schema: pa.Schema, ddl: str
) -> DataFrame:
    """work(block, its answers) for every block, those without answers included."""

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        rows = told.to_pylist()
        out = [x for row in block.to_pylist() for x in work(Block(row), rows)]
        release()
        return pa.Table.from_pylist(out, schema=schema)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, ddl)


def each_block(blocks: DataFrame, work: Callable[[Block], Iterator[dict]], schema: pa.Schema, ddl: str) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts, 1):
            yield pa.RecordBatch.from_pylist([x for row in part.to_pylist() for x in work(Block(row))], schema=schema)
            release()

    return blocks.mapInArrow(run, ddl)


def by_shard(entries: DataFrame, decide: Callable[[list[dict]], Iterator[dict]], schema: pa.Schema, ddl: str) -> DataFrame:
    def run(entry: pa.Table) -> pa.Table:
        out = list(decide(entry.to_pylist()))
        release()
        return pa.Table.from_pylist(out, schema=schema)

    return entries.groupBy("shard").applyInArrow(run, ddl)


#: Spans to take out: place of the document in its block, start and end, each packed as one column.
SPANS = pa.schema([("block", pa.int64()), ("doc", pa.binary()), ("start", pa.binary()), ("end", pa.binary())])
SPANS_DDL = "block bigint, doc binary, start binary, end binary"


def span_row(block: int, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict:
    """One row of SPANS, spans that touch made one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    until = np.maximum.accumulate(doc << 40 | end)
    new = np.concatenate([[True], (doc << 40 | start)[1:] > until[:-1]])
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1)
    return {"block": block, "doc": steps(doc[new]), "start": steps(start[new]), "end": steps(until[ends] & (1 << 40) - 1)}


def covered(n: int, at: np.ndarray, rows: list[dict]) -> np.ndarray:
    """Which of n places (documents one after the other, starting at `at`) the spans of rows cover."""
    change = np.zeros(n + 1, np.int32)
    for row in rows:
        doc, start, end = unstep(row["doc"]), unstep(row["start"]), unstep(row["end"])
        np.add.at(change, at[doc] + start, 1)
        np.add.at(change, at[doc] + end, -1)
    return np.cumsum(change[:n], dtype=np.int32) > 0
