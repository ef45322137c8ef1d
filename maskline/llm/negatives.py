"""Hard negatives: of an anchor's rows of other labels, the best that score clearly below one of its positives.

Components become whole numbers, so that scores are exact. Many candidates are scored at once by Kronecker packing: for
each component, the candidates' values, moved up until none is negative, stand side by side in fields of one wide integer.
Multiplying that integer by the anchor's component multiplies every field; the sum over the components holds all scores,
each in its field, since fields are wide enough for the largest sum. What the moves added is taken off again.

Anchors are a stated share of the rows, and meet all rows in cells of bounded size: first the rows of their own label, for
the positives, then all others. A cell returns a bounded number of rows for each anchor, and ranks end the work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskline.session import materialize

#: Anchors and candidates of a cell, about; candidates that one wide integer holds.
ANCHORS, CANDIDATES, PACKED = 1024, 8192, 512
#: Longer vectors (squared length, in whole numbers) have scores that a long can't hold.
LONGEST = 9e18


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of all anchors (rows) with all candidates (rows), as int64; they must fit into it."""
    out = np.zeros((len(anchors), len(candidates)), np.int64)
    if not out.size or not anchors.shape[1]:
        return out
    up_a, up_c = min(0, int(anchors.min())), min(0, int(candidates.min()))
    raised = (anchors - up_a).tolist()
    most = anchors.shape[1] * (int(anchors.max()) - up_a) * (int(candidates.max()) - up_c)
    width = 4 if most < 2**32 else 8 if most < 2**64 else 24
    # What raising added: fields hold sum((a - up_a) * (c - up_c)). Sums wrap around; what fits into 64 bits is right.
    added = up_c * (anchors - up_a).sum(axis=1)[:, None] + up_a * candidates.sum(axis=1)[None, :]
    for at in range(0, len(candidates), PACKED):
        some = (candidates[at : at + PACKED] - up_c).T
        fields = np.zeros((*some.shape, width // 4), np.uint32)
        fields[:, :, 0] = some & 0xFFFFFFFF
        if width > 4:
            fields[:, :, 1] = some >> 32
        packed = [int.from_bytes(row.tobytes(), "little") for row in fields]
        size = some.shape[1] * width
        for k, own in enumerate(raised):
            total = sum(map(int.__mul__, own, packed)).to_bytes(size, "little")
            low = np.frombuffer(total, np.uint32) if width == 4 else np.frombuffer(total, np.uint64)[:: width // 8]
            out[k, at : at + PACKED] = low.astype(np.uint64).view(np.int64)
    return out + added


def best(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k allowed ones: higher scores first, then smaller ids, then rows."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        least = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= least]
    return at[np.lexsort((rows[at], ids[at], -score[at]))][:k]


class Cell:
    """The anchors or the candidates of a cell: vectors as matrices, by their lengths."""

    def __init__(self, table: pa.Table):
        self.id, self.row, self.label = (table[c].to_numpy() for c in ("vec_id", "row", "label"))
        values = table["values"].combine_chunks()
        ends = values.offsets.to_numpy()
        flat = values.flatten().to_numpy()
        lengths = np.diff(ends)
        self.parts = {}
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            self.parts[n] = at, flat[(ends[at] - ends[0])[:, None] + np.arange(n)] if n else np.zeros((len(at), 0), np.int64)

    def against(self, other: Cell):
        """(place of an anchor, its scores, the places of the candidates that they are of), anchor by anchor."""
        for n, (at, own) in self.parts.items():
            if n in other.parts:
                there, theirs = other.parts[n]
                for k in range(0, len(at), 64):
                    for place, found in zip(at[k : k + 64], scores(own[k : k + 64], theirs), strict=True):
                        yield place, found, there


def _ranked(df: DataFrame, keys: list[str], of: str, k: int) -> DataFrame:
    """The first k of each group, with their rank: higher scores first, then smaller ids, then rows."""
    order = W.partitionBy(*keys).orderBy(F.desc(f"{of}_score"), f"{of}_id", f"{of}_row")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding, label).

    A component x is taken as floor(scale * x). Anchors are the rows whose id `every` divides, their positives the first
    `positives` other rows of the same label. For each, the first `negatives` rows of another label whose score lies
    between low and high per cent of the positive's, both included, are returned; a positive with a score below 0 has none.

    Rows without an id, a label or a vector take no part, nor do those with a component that is null or not finite or
    with a squared length (of whole numbers) of 9e18 or more, whose scores would not fit. Vectors of different lengths
    don't meet; those without components score 0. Rows that repeat an id are rows of their own: each can be an anchor, a
    positive of the other and a negative, with its id. Ties go by id. Other columns are ignored.
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    usable = F.expr(
        "vec_id is not null and label is not null and coalesce(forall(embedding, x -> x is not null and not isnan(x) and"
        f" abs(x) < double('Infinity')) and aggregate(embedding, 0D, (s, x) -> s + pow(floor(double(x) * {scale}D), 2)) < {LONGEST}D, false)"
    )
    rows = vectors.where(usable).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), whole.alias("values")
    )
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    is_anchor = F.col("vec_id") % every == 0
    # Two numbers; how many cells there are follows from them.
    total, asked = rows.agg(F.count("*"), F.count_if(is_anchor)).first()
    blocks, groups = -(-total // CANDIDATES) or 1, -(-asked // ANCHORS) or 1
    # As columns of their own, since they meet the rows that they are.
    again = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])
    anchors = again(rows.where(is_anchor))

    # Own labels: those that fit into a cell share cells, larger ones are cut into several.
    sizes = materialize(rows.groupBy("label").agg(F.expr(f"cast(ceil(count(*) / {CANDIDATES}) as int)").alias("cuts")))
    place = F.pmod(F.xxhash64("label"), F.lit(blocks)).alias("bin")
    homes = rows.join(sizes, "label").select("*", place, F.expr("pmod(xxhash64(row), cuts)").alias("cut"))
    asks = anchors.join(again(sizes), "label").select("*", place, F.explode(F.expr("sequence(0L, cuts - 1L)")).alias("cut"))

    def first_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        a, c = Cell(left), Cell(right)
        for k, found, there in a.against(c):
            allowed = (c.label[there] == a.label[k]) & (c.row[there] != a.row[k])
            for i in best(found, c.id[there], c.row[there], allowed, positives).tolist():
                out.append((a.row[k], c.id[there[i]], c.row[there[i]], found[i]))
        names = ["row", "positive_id", "positive_row", "positive_score"]
        return pa.table({n: pa.array([x[i] for x in out], pa.int64()) for i, n in enumerate(names)})

    near = asks.groupBy("bin", "cut").cogroup(homes.groupBy("bin", "cut")).applyInArrow(
        first_positives, "row bigint, positive_id bigint, positive_row bigint, positive_score bigint"
    )
    near = _ranked(near, ["row"], "positive", positives)
    of_anchor = near.groupBy("row").agg(F.collect_list(F.struct("positive_id", "positive_row", "positive_score")).alias("of"))

    candidates = rows.select(
        "*", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), F.explode(F.expr(f"sequence(0L, {groups - 1}L)")).alias("group")
    )
    asks = materialize(anchors.join(of_anchor, "row")).select(
        "*", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(groups)).alias("group"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block")
    )

    def first_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        a, c = Cell(left), Cell(right)
        of = left["of"].to_pylist()
        for k, found, there in a.against(c):
            ids, numbers, other = c.id[there], c.row[there], c.label[there] != a.label[k]
            for p in of[k]:
                score = p["positive_score"]
                allowed = other & (found >= -(-low * score // 100)) & (found <= high * score // 100)
                for i in best(found, ids, numbers, allowed, negatives).tolist():
                    out.append((a.id[k], a.row[k], p["positive_id"], p["positive_row"], score, ids[i], numbers[i], found[i]))
        names = ["anchor_id", "row", "positive_id", "positive_row", "positive_score", "negative_id", "negative_row", "negative_score"]
        return pa.table({n: pa.array([x[i] for x in out], pa.int64()) for i, n in enumerate(names)})

    found = asks.groupBy("group", "block").cogroup(candidates.groupBy("group", "block")).applyInArrow(
        first_negatives,
        "anchor_id bigint, row bigint, positive_id bigint, positive_row bigint, positive_score bigint,"
        " negative_id bigint, negative_row bigint, negative_score bigint",
    )
    found = _ranked(found, ["row", "positive_row"], "negative", negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
