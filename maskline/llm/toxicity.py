"""Toxicity by a factorization machine over hashed terms.

A text is the set of its words and of their beginnings, hashed into buckets. Its score is sigmoid(bias + sum of weights + sum over pairs of the
inner products of the pair's factors): a pair of terms (an insult and a group that it is aimed at) may say what neither of
them says alone, and what one pair teaches holds for words with like factors. All pairs cost no more than the terms, as
the sum over pairs is half of (square of the sum of factors less the sum of squares).

The machine is fitted on a bounded sample of labelled rows, in one task; the buckets it may use are those that tell most
about the labels, counted by Spark over the sample. Scoring reads every whole text, a few rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline.llm.anchors import mix
from maskline.llm.common import id_and_text, release, slices, utf8
from maskline.llm.words import LOWER, Words
from maskline.session import materialize

#: Beginnings of words that are terms as well, in bytes: insults are inflected.
STEMS = (4, 5, 6, 7)
#: Letters, digits and all bytes of other than ASCII characters belong to a term.
TERM = np.array([chr(b).isalnum() or b > 127 for b in range(256)])
#: Labelled rows that the machine is fitted on at most, buckets that terms are hashed into, and buckets that it may use.
SAMPLE, BUCKETS, KEPT = 20_000, 1 << 20, 512
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 30, 128, 0.1, 1e-4


def held_out(doc_id: Column) -> Column:
    """Is crc32(id as text) a multiple of 5? Rows without an id are held out as well."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def buckets(column: pa.ChunkedArray | pa.Array) -> Iterator[np.ndarray]:
    """The distinct buckets of each text's terms, in order: words, and the beginnings of longer ones."""
    data, starts = utf8(column)
    words = Words(LOWER[data], starts, TERM)
    size = words.end - words.start
    down = np.uint64(64 - BUCKETS.bit_length() + 1)
    for a, b in zip(words.of_doc[:-1].tolist(), words.of_doc[1:].tolist(), strict=True):
        own, at = np.unique(words.hash[a:b], return_index=True)
        first, length = words.first[a + at], size[a + at]
        found = [own]
        for n in STEMS:
            stems = np.unique(first[length > n] & np.uint64((1 << 8 * n) - 1))
            found.append(mix(mix(stems ^ np.uint64(n << 56)) ^ np.uint64(n)))
        yield np.unique((np.concatenate(found) >> down).astype(np.int32))


class Machine:
    """Weights and factors, one row for each of the buckets `used`, and a bias."""

    def __init__(self, bias: float, used: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[used] = np.arange(len(used), dtype=np.int32)

    def margin(self, own: np.ndarray) -> float:
        at = self.place[own]
        at = at[at >= 0]
        part = self.factors[at]
        return self.bias + self.weights[at].sum() + 0.5 * (part.sum(axis=0) ** 2 - (part**2).sum(axis=0)).sum()

    def score(self, own: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(own), -700, 700))))


def fitted(rows: list[np.ndarray], toxic: np.ndarray, used: np.ndarray, factors: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, weights, factors) for rows of places in `used`: logistic loss, AdaGrad over batches in a fixed order."""
    rng = np.random.Generator(np.random.PCG64(13))
    n = len(used)
    # With few rows the bias leans to 'not toxic'.
    share = (toxic.sum() + 0.01) / (len(toxic) + 1)
    bias, weights = float(np.log(share / (1 - share))), np.zeros(n)
    v = rng.normal(0, 0.1, (n, factors))
    seen_w, seen_v, seen_b = np.full(n, 1e-8), np.full((n, factors), 1e-8), 1e-8
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), BATCH):
            some = order[k : k + BATCH]
            x = np.zeros((len(some), n))
            for i, r in enumerate(some):
                x[i, rows[r]] = 1
            here = np.flatnonzero(x.any(axis=0))
            x, own, w = x[:, here], v[here], weights[here]
            sums = x @ own
            margin = bias + x @ w + 0.5 * (sums**2 - x @ own**2).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - toxic[some]) / len(some)
            by_term = x.T @ error
            grad_w = by_term + DECAY * w
            grad_v = x.T @ (error[:, None] * sums) - by_term[:, None] * own + DECAY * own
            seen_w[here] += grad_w**2
            seen_v[here] += grad_v**2
            seen_b += error.sum() ** 2
            weights[here] -= RATE * grad_w / np.sqrt(seen_w[here])
            v[here] -= RATE * grad_v / np.sqrt(seen_v[here])
            bias -= RATE * error.sum() / np.sqrt(seen_b)
    return float(bias), weights, v


def fit(texts: DataFrame, kept: int = KEPT, factors: int = FACTORS) -> Machine:
    """The machine fitted on texts (doc_id, text, toxic); their number must be bounded."""

    def featured(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            lists = list(buckets(part["text"]))
            ends = np.cumsum([0, *(len(x) for x in lists)]).astype(np.int32)
            values = np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["toxic"], pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["doc_id", "toxic", "terms"])

    rows = materialize(texts.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(featured, "doc_id bigint, toxic int, terms array<int>"))
    # At most BUCKETS rows, of which `kept` are read: those whose presence tells most (chi-square of the two-by-two table).
    whole = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic_rows"))
    counts = rows.select("toxic", F.explode("terms").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    expected = F.expr("n * toxic_rows / rows")
    chi = F.when((F.col("toxic_rows") > 0) & (F.col("n") < F.col("rows")), F.pow(F.col("k") - expected, F.lit(2)) * F.col("rows") * F.col("rows") / (F.col("n") * (F.col("rows") - F.col("n")))).otherwise(0)
    told = counts.where("n > 1").crossJoin(F.broadcast(whole)).withColumn("chi", chi).where("chi > 0")  # `whole` is one row
    used = np.sort(np.array([r.bucket for r in told.orderBy(F.desc("chi"), "bucket").limit(kept).select("bucket").collect()], np.int64))

    def train(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS, -1, np.int32)
        place[used] = np.arange(len(used), dtype=np.int32)
        ids: list[int] = []
        toxic: list[int] = []
        lists: list[np.ndarray] = []
        for part in slices(parts):
            ids += part["doc_id"].to_pylist()
            toxic += part["toxic"].to_pylist()
            for terms in part["terms"]:
                at = place[terms.values.to_numpy()]
                lists.append(at[at >= 0].astype(np.int16 if len(used) < 1 << 15 else np.int32))
        order = sorted(range(len(ids)), key=lambda i: (ids[i], toxic[i], lists[i].tobytes()))  # whatever order they came in
        bias, weights, v = fitted([lists[i] for i in order], np.array([toxic[i] for i in order], float), used, factors)
        yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([weights.tolist()], pa.list_(pa.float64())), pa.array([v.ravel().tolist()], pa.list_(pa.float64()))], names=["bias", "weights", "factors"])
        release()

    model = rows.coalesce(1).mapInArrow(train, "bias double, weights array<double>, factors array<double>").first()
    if model is None:  # no partition, no row
        return Machine(float(np.log(0.01 / 0.99)), used, np.zeros(0), np.zeros((0, factors)))
    return Machine(model.bias, used, np.array(model.weights, float), np.array(model.factors, float).reshape(len(used), factors))


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of at most `sample` labelled documents that are not held out, the first by a hash of the id.

    An id with both labels, or with none, teaches nothing; of rows that repeat an id one text is read."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic").where("toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").select("doc_id", "toxic")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = id_and_text(docs).join(F.broadcast(known), "doc_id")  # `sample` ids at most
    # One row of an id, wherever copies of it lie: a hash decides before texts move.
    firsts = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))).alias("one"))
    chosen = texts.join(firsts, "doc_id").where((F.xxhash64("text") == F.col("one.h")) & (F.octet_length("text") == F.col("one.n")))
    return chosen.dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs (doc_id, text).

    Learns from labels (doc_id, toxic) of ids that are not held out (`held_out`), at most `sample` of them; nothing but the
    text is an input of a score. Null and empty texts, and texts without a known term, get the score of the bias; without
    labels every score is 0.01. Rows that repeat an id are scored each; other columns are ignored.
    """
    machine = fit(sampled(docs, labels, sample))

    def scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            found = np.array([machine.score(own) for own in buckets(part["text"])], float)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])
        release()

    rows = id_and_text(docs).mapInArrow(scored, "doc_id bigint, score double, predicted int")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
