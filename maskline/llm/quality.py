"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text, and thresholds per language.

Words are read as symbols: every word that learned text has is one of its own, however many there are; a few symbols
stand for words that repeat the one before, once or more often. A word that learned text lacks is in no count, and is read as
unseen. Unigrams, bigrams and trigrams grow with the corpus, and all of them are sharded.

Documents are told whether they are trusted, encoded, and written as blocks of about a million words: the distinct symbols
of the block (63-bit hashes of words), and places among them. Counts come from the learned documents of the blocks, by
shuffles. Blocks ask shards for the counts of their distinct trigrams, pairs and words in packed exchanges (blocks.py), and get
whole numbers back for those that learned text has; probabilities are worked out in the block, and give every document its
perplexity. Trigrams are counted and asked for in parts, by their middle word: a part has all counts that its trigrams need
but those of single words, and what one part moves is gone before the next one starts. A closed inventory of the
most frequent words of a bounded sample, with a symbol per shape (letters, digits, other signs, length) for all others, can be
asked for instead.
One trusted document of a few, by a hash of its id, is held out: the model doesn't learn it. A document is rejected when
its perplexity is above what all but a share of the held-out ones of its language and length reach, by a margin.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.llm.anchors import mix
from maskline.llm.blocks import shards_of, spread, squeeze
from maskline.llm.common import release, slices
from maskline.llm.words import Words, key
from maskline.session import forget, freed_shuffles, materialize, recorded

START, END, REPEAT = 0, 1, 2
#: A word that is the same as the one before it has the symbol REPEAT, the next such one REPEAT + 1, and so on to the last.
#: The last is never learned, even where trusted text has it: a model would find long runs of one word easy to predict.
REPEATS = 4
SHAPES = REPEAT + REPEATS
#: Shapes: letters, digits, signs inside, sign at the end (a bit each) and four lengths.
N_SHAPES = 64
FIRST_WORD = SHAPES + N_SHAPES
#: Roles of documents: not trusted, learned, held out.
OTHER, LEARNED, HELD_OUT = 0, 1, 2
#: log perplexities are counted in steps of this size for the quantiles.
STEP = 0.001
#: Documents of 2 ** LENGTHS[1] words or more share a class of length, those of fewer than 2 ** LENGTHS[0] another.
LENGTHS = (3, 9)
#: Parts that the trigrams of an open vocabulary are counted and asked for in; bytes of questions per shard.
PARTS, SHARD = 8, 16 << 20


def shape(word: str) -> int:
    letters, digits = any(map(str.isalpha, word)), any(map(str.isdigit, word))
    signs, ends = any(not c.isalnum() for c in word[:-1]), not word[-1].isalnum()
    length = (len(word) > 3) + (len(word) > 7) + (len(word) > 12)
    return SHAPES + (letters | digits << 1 | signs << 2 | ends << 3 | length << 4)


def repeats(again: np.ndarray) -> np.ndarray:
    """Which repeat in a row, from 0 to the last one told apart, each word is that is the same as the one before it."""
    place = np.arange(len(again))
    run = place - np.maximum.accumulate(np.where(again, -1, place))
    return np.minimum(run[again], REPEATS) - 1


class Symbols(dict):
    """Symbol of a lower-cased word; as a dict, the memo of words, emptied to the inventory when it holds `most`."""

    def __init__(self, words: list[str], most: int = 200_000):
        super().__init__()
        self.words, self.most = {w: FIRST_WORD + i for i, w in enumerate(words)}, most
        self.update(self.words)

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.words)
        found = shape(word)
        if len(word) <= 64:
            self[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        words = text.lower().split()
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(words) > 1:
            again = np.fromiter(map(str.__eq__, words, words[1:]), bool, len(words) - 1)
            out[1:][again] = REPEAT + repeats(again)
        return out

    def settled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct symbols in order, place among them of each code)."""
        return np.unique(codes, return_inverse=True)


class OpenSymbols:
    """Words of one block: numbers as they come, settled as the order of their symbols, negative 64-bit hashes under a key."""

    def __init__(self, key: tuple[int, int]):
        self.key, self.numbers = key, defaultdict(count(REPEATS).__next__)

    def encode(self, text: str) -> np.ndarray:
        words = text.lower().split()
        out = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        again = out[1:] == out[:-1]
        if again.any():
            out[1:][again] = repeats(again)
        return out

    def settled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # No blank byte is left in a word that Python has split off.
        hashed = np.zeros(0, np.uint64)
        if self.numbers:
            data = np.frombuffer(" ".join(self.numbers).encode("utf-8", "surrogatepass"), np.uint8)
            hashed = Words(data, np.zeros(1, np.int64), key=self.key).hash
        symbols = np.concatenate([REPEAT + np.arange(REPEATS), (hashed | np.uint64(1 << 63)).view(np.int64)])
        self.numbers = defaultdict(count(REPEATS).__next__)
        order = np.argsort(symbols)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return symbols[order], place[codes]


def inventory(docs: DataFrame, trusted: DataFrame, words: int, sample: int) -> list[str]:
    """The `words` most frequent words of at most `sample` trusted documents (those with the smallest digests)."""
    # Bounded by `sample` ids.
    chosen = trusted.orderBy(F.xxhash64(F.col("doc_id"), F.lit(3)), "doc_id").limit(sample)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found: Counter[str] = Counter()
            for some in slices(iter([part])):
                for text in some["text"].to_pylist():
                    found.update(text.lower().split())
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    counted = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select("text").mapInArrow(count, "word string, n bigint")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(words)
    return [r["word"] for r in top.collect()]


def write_blocks(docs: DataFrame, trusted: DataFrame, words: list[str] | None, block_words: int, key: tuple[int, int]) -> DataFrame:
    """(block, doc_ids, langs, roles, lengths, symbols, codes, cuts): documents as places (codes) among the distinct symbols of
    their block, in blocks of about block_words; the places where parts begin, and behind them the number of symbols."""
    # Hashes of words fill the negative numbers.
    edges = [-(1 << 63) + (1 << 63) // PARTS * k for k in range(1, PARTS)] if words is None else []
    pack = "doc_id bigint, lang string, text binary"

    def shrink(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3)
        for part in slices(parts):
            texts = pa.array([compress.compress(t.encode()) for t in part["text"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["lang"], texts], names=["doc_id", "lang", "text"])
        release()

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, spread = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        symbols = OpenSymbols(key) if words is None else Symbols(words)
        held: list[tuple] = []
        total = 0

        def block() -> pa.RecordBatch:
            ids, langs, roles, codes = zip(*held, strict=True)
            distinct, places = symbols.settled(np.concatenate(codes))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([ids], pa.list_(pa.int64())), pa.array([langs], pa.list_(pa.string())),
                    pa.array([roles], pa.list_(pa.int32())), pa.array([list(map(len, codes))], pa.list_(pa.int32())),
                    pa.array([compress.compress(distinct.tobytes())], pa.binary()),
                    pa.array([compress.compress(places.astype(np.uint32).tobytes())], pa.binary()),
                    pa.array([[0, *np.searchsorted(distinct, edges).tolist(), len(distinct) + 2]], pa.list_(pa.int32())),
                ],
                names=["doc_ids", "langs", "roles", "lengths", "symbols", "codes", "cuts"],
            )

        for part in slices(parts):
            for doc_id, lang, text, role in zip(*(part[c].to_pylist() for c in ("doc_id", "lang", "text", "role")), strict=True):
                held.append((doc_id, lang, role, symbols.encode(spread.decompress(text).decode())))
                total += len(held[-1][-1]) + 1
                if total >= block_words:
                    yield block()
                    held, total = [], 0
        if held:
            yield block()
        release()

    told = docs.mapInArrow(shrink, pack).join(trusted, "doc_id", "left").withColumn("role", F.coalesce("role", F.lit(OTHER)))
    blocks = told.mapInArrow(
        gather, "doc_ids array<bigint>, langs array<string>, roles array<int>, lengths array<int>, symbols binary, codes binary, cuts array<int>"
    )
    return materialize(blocks.withColumn("block", F.monotonically_increasing_id()))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers that are mostly small, not negative, in rows of the same length: a byte for each, then the larger ones."""
    values = np.atleast_2d(values)
    large = values[values >= 255]
    head = np.array([*values.shape, len(large)], np.int64)
    return squeeze(head.tobytes() + large.astype(np.int64).tobytes() + np.minimum(values, 255).astype(np.uint8).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    """The rows that `packed` packed."""
    data = spread(data)
    rows, n, large = data[:24].view(np.int64).tolist()
    values = data[24 + 8 * large :].astype(np.int64).reshape(rows, n)
    values[values == 255] = data[24 : 24 + 8 * large].view(np.int64)
    return values


def codes_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(places of all words among the distinct symbols, words of each document) of a block."""
    return spread(row["codes"], np.uint32).astype(np.int64), np.array(row["lengths"], np.int64)


def symbols_of(row: dict) -> np.ndarray:
    """The distinct symbols of a block, START and END behind them."""
    return np.concatenate([spread(row["symbols"], np.int64), [START, END]])


_SALTS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


class Grams:
    """Distinct trigrams of a block whose middle word's place is in [low, high), of all documents or of some: symbols u, v and w
    by place, the distinct pairs (u, v) and (v, w) and which of them a trigram has, the distinct v; for the words in question
    and ends of documents, the place of the trigram that ends there and the document."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, n_symbols: int, low: int, high: int, some: np.ndarray | None = None):
        start, end, size = n_symbols, n_symbols + 1, n_symbols + 2
        doc = np.repeat(np.arange(len(lengths)), lengths + 1)
        ends = np.cumsum(lengths + 1) - 1
        is_end = np.zeros(len(doc), bool)
        is_end[ends] = True
        word = np.full(len(doc), end, np.int64)
        word[~is_end] = codes
        # A document's end stands before the next one, so that its first two words have it in sight.
        before = np.concatenate([[end], word[:-1]])
        earlier = np.concatenate([[end], before[:-1]])
        earlier[(before == end) | (earlier == end)] = start
        before[before == end] = start
        asked = (before >= low) & (before < high)
        if some is not None:
            asked &= some[doc]
        asked = np.flatnonzero(asked)
        self.doc, word, before = doc[asked], word[asked], before[asked]
        # Two numbers in one, twice: a pair by its place has room beside a word.
        first, pair = np.unique(earlier[asked] * size + before, return_inverse=True)
        found, self.place = np.unique(pair * size + word, return_inverse=True)
        self.first, self.w = found // size, found % size
        self.first_u, self.first_v = first // size, first % size
        self.u, self.v = self.first_u[self.first], self.first_v[self.first]
        second, self.second = np.unique(self.v * size + self.w, return_inverse=True)
        self.second_v, self.second_w = second // size, second % size
        self.middles = np.unique(self.v)
        #: Questions about trigrams, pairs (u, v), pairs (v, w) and words v come in this order.
        self.kinds = np.cumsum([len(found), len(first), len(second), len(self.middles)])

    def keys(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """64-bit keys of what a shard is asked for, kind by kind; that of a word is its symbol."""
        hashed = mix(mix(symbols.view(np.uint64) ^ _SALTS[0]) * _SALTS[1])

        def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return mix(mix(a * _SALTS[1] + b) * _SALTS[2])

        first = joined(hashed[self.first_u], hashed[self.first_v])
        second = joined(hashed[self.second_v], hashed[self.second_w])
        # A pair is asked for as a context and as what has one.
        return joined(first[self.first], hashed[self.w] ^ _SALTS[3]), mix(first ^ _SALTS[2]), second, symbols[self.middles].view(np.uint64)


def learned_grams(blocks: DataFrame, part: int) -> DataFrame:
    """(t, x, b, v, w, n): keys of the distinct trigrams of each block's learned documents, of their pairs (u, v) and (v, w),
    their symbols v and w, and how often they are there."""

    def name(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(parts, 1):
            for row in batch.to_pylist():
                codes, lengths = codes_of(row)
                symbols, cuts = symbols_of(row), row["cuts"]
                found = Grams(codes, lengths, len(symbols) - 2, cuts[part], cuts[part + 1], np.array(row["roles"]) == LEARNED)
                t, x, b, _ = found.keys(symbols)
                n = np.bincount(found.place, minlength=len(t))
                w = symbols[found.w]
                held = np.flatnonzero(w != REPEAT + REPEATS - 1)
                columns = [t.view(np.int64), x.view(np.int64)[found.first], b.view(np.int64)[found.second], symbols[found.v], w, n]
                yield pa.RecordBatch.from_arrays([pa.array(c[held]) for c in columns], names=["t", "x", "b", "v", "w", "n"])
                release()

    learned = blocks.where(F.array_contains("roles", LEARNED)).select("roles", "lengths", "symbols", "codes", "cuts")
    return learned.mapInArrow(name, "t bigint, x bigint, b bigint, v bigint, w bigint, n bigint")


def tally(counts: DataFrame) -> np.ndarray:
    """How many counts (c) are 1, 2, 3 and 4."""
    return np.array(counts.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first(), np.int64)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of one order from how many of its counts are 1 to 4, for counts of 1, 2 and more."""
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9  # too few counts to estimate from
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def _contexts(counts: DataFrame, by: str) -> DataFrame:
    """(key, a, b, c, d): the sum of the counts after a context, and how many of them are 1, 2 and more."""
    return counts.groupBy(F.col(by).alias("key")).agg(
        F.sum("c").alias("a"), F.count_if(F.col("c") == 1).alias("b"), F.count_if(F.col("c") == 2).alias("c"), F.count_if(F.col("c") > 2).alias("d")
    )


def _plain(counts: DataFrame, by: str) -> DataFrame:
    none = F.lit(0).cast("bigint")
    return counts.select(F.col(by).alias("key"), F.col("c").alias("a"), none.alias("b"), none.alias("c"), none.alias("d"))


class Part(NamedTuple):
    """What a part of the learned trigrams teaches: (key, a, b, c, d) of trigrams, of their contexts, of pairs and of their
    contexts, and the table that has it; (w, c) how many v stand before w; tallies of the counts of trigrams and of pairs."""

    model: DataFrame
    written: list[str]
    single: DataFrame
    trigrams: np.ndarray
    pairs: np.ndarray


def counted(blocks: DataFrame, part: int) -> Part:
    spark = blocks.sparkSession
    with recorded() as own:
        tri = materialize(learned_grams(blocks, part).groupBy("t", "x", "b", "v", "w").agg(F.sum("n").alias("c")))
        bi = materialize(tri.groupBy("b", "v", "w").agg(F.count("*").alias("c")))
    told = [_plain(tri, "t"), _contexts(tri, "x"), _plain(bi, "b"), _contexts(bi, "v")]
    with recorded() as written:
        model = materialize(reduce(DataFrame.unionByName, told))
    single = materialize(bi.groupBy("w").agg(F.count("*").alias("c")))
    found = Part(model, written, single, tally(tri), tally(bi))
    forget(spark, own)
    return found


def questions(blocks: DataFrame, part: int | None, shards: int) -> DataFrame:
    """(shard, block, keys, number): what blocks ask for in a part, and the questions' numbers; without one, all of their symbols."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("number", pa.binary())])

    def dealt(block: int, keys: np.ndarray) -> Iterator[dict]:
        shard = shards_of(keys, shards)
        order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
        ends = np.cumsum(np.bincount(shard, minlength=shards))
        for k, (end, n) in enumerate(zip(ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True)):
            if n:
                some = order[end - n : end]
                yield {"shard": k, "block": block, "keys": keys[some].tobytes(), "number": packed(np.diff(some, prepend=0))}

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(parts, 1):
            for row in batch.to_pylist():
                symbols, cuts = symbols_of(row), row["cuts"]
                keys = symbols.view(np.uint64)
                if part is not None:
                    codes, lengths = codes_of(row)
                    keys = np.concatenate(Grams(codes, lengths, len(symbols) - 2, cuts[part], cuts[part + 1]).keys(symbols))
                yield pa.RecordBatch.from_pylist(list(dealt(row["block"], keys)), schema)
                release()

    return blocks.select("block", "lengths", "symbols", "codes", "cuts").mapInArrow(ask, "shard int, block bigint, keys binary, number binary")


def answers(asked: DataFrame, model: DataFrame, part: int, shards: int) -> DataFrame:
    """(block, part, number, told): which of its questions (numbers) learned text has counts for, and these four by four."""

    def answer(rows: pa.Table, known: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        asked = [np.frombuffer(row["keys"], np.int64) for row in rows]
        found = pc.index_in(pa.array(np.concatenate([np.zeros(0, np.int64), *asked])), value_set=known["key"].combine_chunks())
        found = found.fill_null(-1).to_numpy()
        counts = np.stack([known[c].to_numpy() for c in "abcd"])
        out = []
        for row, at in zip(rows, np.split(found, np.cumsum(list(map(len, asked)))[:-1]) if rows else (), strict=True):
            hit = np.flatnonzero(at >= 0)
            if len(hit):
                number = np.cumsum(unpacked(row["number"])[0])[hit]
                out.append({"block": row["block"], "part": part, "number": packed(np.diff(number, prepend=0)), "told": packed(counts[:, at[hit]])})
        release()
        return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("part", pa.int32()), ("number", pa.binary()), ("told", pa.binary())]))

    known = model.withColumn("shard", (F.shiftrightunsigned("key", 33) % shards).cast("int"))
    return asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(answer, "block bigint, part int, number binary, told binary")


class Model(NamedTuple):
    """Discounts of words, pairs and trigrams; sum of the counts of words, how many of them are 1, 2 and more; all symbols."""

    discounts: list[tuple[float, float, float]]
    total: int
    words: tuple[int, int, int]
    symbols: int

    def over(self, order: int, counts: np.ndarray) -> np.ndarray:
        """Counts less their discounts; 0 where there are none."""
        return counts - np.array([0.0, *self.discounts[order - 1]])[np.minimum(counts, 3)]

    def rest(self, order: int, of: np.ndarray) -> np.ndarray:
        """What discounting leaves over of the counts after contexts, from how many of them are 1, 2 and more."""
        return np.array(self.discounts[order - 1]) @ of

    def logp(self, found: Grams, told: np.ndarray, single: np.ndarray) -> np.ndarray:
        """Log probabilities of trigrams by the counts told of what was asked, and by those of all words (single)."""
        if not self.total:
            return np.full(len(found.u), -math.log(self.symbols))
        three, contexts, two, middles = np.split(told, found.kinds[:-1], axis=1)
        unseen = self.rest(1, np.array(self.words)) / self.total / self.symbols
        p1 = self.over(1, single)[found.second_w] / self.total + unseen
        p2 = self._with(2, two[0], middles[:, np.searchsorted(found.middles, found.second_v)], p1)
        return np.log(self._with(3, three[0], contexts[:, found.first], p2[found.second]))

    def _with(self, order: int, counts: np.ndarray, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
        all_ = np.maximum(context[0], 1)
        return np.where(context[0] > 0, self.over(order, counts) / all_ + self.rest(order, context[1:]) / all_ * lower, lower)


def scores(blocks: DataFrame, told: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, role, n_words, log_perplexity) of all documents of blocks by what their questions were told."""

    def score(block: pa.Table, answered: pa.Table) -> pa.Table:
        by_part = defaultdict(list)
        for row in answered.to_pylist():
            by_part[row["part"]].append((np.cumsum(unpacked(row["number"])[0]), unpacked(row["told"])))

        def counts(part: int, n: int) -> np.ndarray:
            out = np.zeros((4, n), np.int64)
            for number, some in by_part.pop(part, ()):
                out[:, number] = some
            return out

        row, = block.to_pylist()
        codes, lengths = codes_of(row)
        cuts = row["cuts"]
        single = counts(len(cuts) - 1, cuts[-1])[0]
        sums = np.zeros(len(lengths))
        for part, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
            found = Grams(codes, lengths, cuts[-1] - 2, low, high)
            logp = model.logp(found, counts(part, found.kinds[-1]), single)
            sums += np.bincount(found.doc, weights=logp[found.place], minlength=len(lengths))
        release()
        return pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "lang": pa.array(row["langs"], pa.string()),
                "role": pa.array(row["roles"], pa.int32()), "n_words": pa.array(lengths), "log_perplexity": pa.array(-sums / (lengths + 1)),
            }
        )

    coded = blocks.select("block", "doc_ids", "langs", "roles", "lengths", "codes", "cuts")
    return coded.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        score, "doc_id bigint, lang string, role int, n_words bigint, log_perplexity double"
    )


def perplexities(docs: DataFrame, trusted: DataFrame, words: int | None = None, sample: int = 20_000, block_words: int = 1_000_000) -> DataFrame:
    """(doc_id, lang, role, n_words, log_perplexity) of docs (doc_id, text, lang) by what trusted (doc_id, role) ones teach.

    Every learned word counts; `words` asks for a closed inventory of that many, from at most `sample` trusted documents."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    chosen = None if words is None else inventory(docs, trusted.select("doc_id"), words, sample)
    parts = range(PARTS if words is None else 1)
    spark = docs.sparkSession
    with freed_shuffles(spark):
        with recorded() as own:
            blocks = write_blocks(docs, trusted, chosen, block_words, key())
            size = blocks.selectExpr("sum(aggregate(lengths, 0L, (a, n) -> a + n + 1)) as n").first()[0] or 0
            # About 2.7 questions of eight bytes a word.
            shards = max(1, -(-size * 22 // len(parts) // SHARD))
            learned, told = [], []
            for part in parts:
                learned.append(counted(blocks, part))
                told.append(materialize(answers(questions(blocks, part, shards), learned[-1].model, part, shards)))
                forget(spark, learned[-1].written)
            single = materialize(reduce(DataFrame.unionByName, [x.single for x in learned]).groupBy("w").agg(F.sum("c").alias("c")))
            told.append(materialize(answers(questions(blocks, None, shards), _plain(single, "w"), len(parts), shards)))
        found = [tally(single), sum(x.pairs for x in learned), sum(x.trigrams for x in learned)]
        total, one, two, more, n_words = single.agg(
            F.sum("c"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2), F.count_if(F.col("c") > 2), F.count_if(F.col("w") < 0)
        ).first()
        model = Model([discounts(*x.tolist()) for x in found], total or 0, (one, two, more), FIRST_WORD + (n_words if words is None else words))
        scored = materialize(scores(blocks, reduce(DataFrame.unionByName, told), model))
    forget(spark, own)
    return scored
def quality(
    docs: DataFrame, trusted: DataFrame, quantile: float = 0.99, margin: float = 1.5, fold: int = 5, held_by: str = "doc_id",
    short: bool = True, **model: int | None
) -> DataFrame:
    """(doc_id, lang, n_words, perplexity, threshold, kept), one row per row of docs (doc_id, text, lang).

    trusted (doc_id) names the documents whose text is trusted; ids that docs lacks do nothing. One of `fold` is held out,
    by a hash of the id, or of another column `held_by` of trusted. Where learned text is so little that counts of one, two and
    three are not all there, discounts are fixed ones (`discounts`).
    threshold is `margin` times the `quantile` of the perplexities of held-out documents of the same language and class of
    length, or the widest of the language where a class has none; in a language without any (null is a language of its own)
    nothing is rejected. Perplexities of shorter documents spread wider: with `short` off nothing is rejected either in classes
    that are shorter than all with held-out documents of the language. A document without
    words has the perplexity of an end at once, and is kept. A repeated id is scored row by row; rows without an id are
    scored and never trusted. Other columns are ignored.
    """
    held = F.pmod(F.xxhash64(F.col(held_by).cast("bigint"), F.lit(17)), F.lit(fold)) == 0
    trusted = trusted.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(held, HELD_OUT).otherwise(LEARNED).alias("role"))
    trusted = materialize(trusted.where("doc_id is not null").distinct())  # read twice
    scores = perplexities(docs, trusted, **model)
    size = F.least(F.lit(LENGTHS[1]), F.greatest(F.lit(LENGTHS[0]), F.floor(F.log2(F.col("n_words") + 1)))).cast("int")
    scores = scores.withColumn("size", size).withColumn("step", F.floor(F.col("log_perplexity") / STEP))
    # At most 20 / STEP rows per language and class of length: counts, not documents.
    steps = scores.where(f"role = {HELD_OUT} and n_words > 0").groupBy("lang", "size", "step").agg(F.count("*").alias("n"))
    by_class = "partition by lang, size"
    reached = steps.selectExpr("lang", "size", "step", f"sum(n) over ({by_class} order by step) as up_to", f"sum(n) over ({by_class}) as total")
    limits = (
        reached.where(F.col("up_to") >= quantile * F.col("total"))
        .groupBy("lang", "size")
        .agg((F.exp((F.min("step") + 1) * STEP) * margin).alias("threshold"))
        .select(F.col("lang").alias("of_lang"), F.col("size").alias("of_size"), "threshold")
    )
    limits = materialize(limits)
    # One row per language.
    widest = limits.groupBy(F.col("of_lang").alias("any_lang")).agg(F.max("threshold").alias("widest"), F.min("of_size").alias("shortest"))
    met = scores.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & (F.col("size") == F.col("of_size")), "left")
    met = met.join(widest, F.col("lang").eqNullSafe(F.col("any_lang")), "left")
    met = met.withColumn("threshold", F.coalesce("threshold", F.when(F.lit(short) | (F.col("size") >= F.col("shortest")), F.col("widest"))))
    perplexity = F.exp("log_perplexity")
    return met.select(
        "doc_id", "lang", "n_words", perplexity.alias("perplexity"), "threshold",
        ((F.col("n_words") == 0) | F.coalesce(perplexity <= F.col("threshold"), F.lit(True))).alias("kept"),
    )
