"""Embedding near-dedup as an exact metric range join.

On unit vectors a cosine of at least t is a distance of at most e = sqrt(2 - 2 t). Pivots, a bounded sample of the
vectors, cut space into cells: a vector's home is the cell of its nearest pivot, and it is a guest wherever something
within e of it can be at home. Two bounds, both exact, say where: the triangle inequality with the cell's radius, and the
distance to the plane half way between two pivots (what the triangle inequality gives for the two distances, sharpened
for flat space). Cells then join independently, a home vector with all guests, so each vector has all its links in its
home cell. Cells of many vectors are dealt out as blocks of bounded size, home by guests, and multiplied as matrices.
Identical vectors are one row with a weight before anything is compared, and links inside a block leave it as counts and
as a spanning forest, never as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.llm.graph import components
from maskline.session import materialize

#: Vectors at home in a cell, aimed at; rows of a block, at most about.
CELL, HOME_BLOCK, GUEST_BLOCK = 8192, 4096, 8192
MAX_PIVOTS = 512
#: Rounding of distances; only adds guests.
SLACK = 1e-6


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(unit rows as doubles, padded with zeros to the longest; lengths before padding) of an Arrow list column."""
    lengths = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    # Scaled first: squares of very large or small components stay finite.
    out /= np.abs(out).max(axis=1, initial=0, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True), lengths


def padded(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, max(0, width - rows.shape[1]))))


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(rows.shape[1], pivots.shape[1])
    dots = padded(rows, width) @ padded(pivots, width).T
    return np.sqrt(np.maximum(0, 2 - 2 * dots))


def block_links(home: np.ndarray, guests: np.ndarray, alike: np.ndarray, threshold: float) -> np.ndarray:
    """Which home (row) links with which guest (column)."""
    out = np.empty((len(home), len(guests)), bool)
    for at in range(0, len(guests), 1024):
        out[:, at : at + 1024] = home @ guests[at : at + 1024].T >= threshold
    out &= alike
    return out


def roots(links: np.ndarray, home_ids: np.ndarray, guest_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each home and guest the smallest id it is joined to by links of this block."""
    of_home, of_guest, most = home_ids.copy(), guest_ids.copy(), np.iinfo(np.int64).max
    rows, columns = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
    part = links[np.ix_(rows, columns)]
    while len(rows):
        before = of_home[rows].copy(), of_guest[columns].copy()
        for at in range(0, len(rows), 256):
            some = rows[at : at + 256]
            of_home[some] = np.minimum(of_home[some], np.where(part[at : at + 256], of_guest[columns], most).min(axis=1))
        for at in range(0, len(columns), 256):
            some = columns[at : at + 256]
            of_guest[some] = np.minimum(
                of_guest[some], np.where(part[:, at : at + 256].T, of_home[rows], most).min(axis=1)
            )
        if np.array_equal(before[0], of_home[rows]) and np.array_equal(before[1], of_guest[columns]):
            break
    return of_home, of_guest


def near_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and stay; so do vectors of
    different lengths among each other. Equal vectors link. Of a component the smallest vec_id stays; rows that repeat it
    all do. A row without an id is linked and counted, and is kept only if it has no links. Other columns are ignored.
    """
    reach = math.sqrt(2 - 2 * threshold)
    usable = F.expr(
        "coalesce(size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
        " and exists(embedding, x -> x <> 0), false)"
    )
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").withColumn("usable", usable)
    alone = rows.where("not usable").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    rows = rows.where("usable").drop("usable")
    # Numbered once and written, so that a number always means the same vector.
    classes = rows.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    n_pivots = max(1, min(MAX_PIVOTS, -(-classes.count() // CELL)))
    # A sample of at most MAX_PIVOTS vectors.
    sample = classes.orderBy(F.xxhash64(F.col("first_id"), F.lit(11)), "cid").limit(n_pivots).select("embedding").toArrow()
    if not sample.num_rows:
        return alone
    pivots, _ = matrix(sample["embedding"].combine_chunks())
    between = distances(pivots, pivots)

    def homes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = distances(matrix(part["embedding"])[0], pivots)
            home = found.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(home.astype(np.int32)), pa.array(found[np.arange(len(home)), home])], names=["cell", "away"]
            )

    radii = np.full(len(pivots), -np.inf)
    # One row per pivot.
    for cell, most in classes.select("embedding").mapInArrow(homes, "cell int, away double").groupBy("cell").agg(F.max("away")).collect():
        radii[cell] = most

    def guests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            unit, _ = matrix(part["embedding"])
            found = distances(unit, pivots)
            home = found.argmin(axis=1)
            nearest = found[np.arange(len(home)), home]
            # Distance to the plane between the pivot and the home pivot; equal pivots have none.
            apart = np.maximum(between[home], 1e-12)
            plane = (found**2 - nearest[:, None] ** 2) / (2 * apart)
            there = (found <= radii + reach + SLACK) & ((plane <= reach + SLACK) | (between[home] < SLACK))
            there[np.arange(len(home)), home] = True
            which, cell = np.nonzero(there)
            taken = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cell.astype(np.int32)),
                    pa.array(home[which] == cell),
                    part["cid"].take(taken),
                    part["weight"].take(taken),
                    part["embedding"].take(taken),
                ],
                names=["cell", "at_home", "cid", "weight", "embedding"],
            )

    kind = dict(vectors.dtypes)["embedding"]
    dealt = classes.select("embedding", "cid", "weight").mapInArrow(
        guests, f"cell int, at_home boolean, cid bigint, weight bigint, embedding {kind}"
    )
    dealt = materialize(dealt)
    # One row per pivot.
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("guests"), F.count_if("at_home").alias("homes"))
    cuts = sizes.select(
        F.col("cell").alias("of"),
        F.expr(f"cast(ceil(homes / {HOME_BLOCK}) as int)").alias("hs"),
        F.expr(f"cast(ceil(guests / {GUEST_BLOCK}) as int)").alias("gs"),
    ).where("hs > 0")
    dealt = dealt.join(F.broadcast(cuts), F.col("cell") == F.col("of")).drop("of")
    as_home = dealt.where("at_home").select(
        "cell", F.expr("pmod(xxhash64(cid), hs)").alias("h"), F.explode(F.expr("sequence(0L, gs - 1L)")).alias("g"),
        F.lit(True).alias("asks"), "cid", "weight", "embedding",
    )
    as_guest = dealt.select(
        "cell", F.explode(F.expr("sequence(0L, hs - 1L)")).alias("h"), F.expr("pmod(xxhash64(cid), gs)").alias("g"),
        F.lit(False).alias("asks"), "cid", "weight", "embedding",
    )

    def join(block: pa.Table) -> pa.Table:
        unit, lengths = matrix(block["embedding"].combine_chunks())
        asks = block["asks"].to_numpy(zero_copy_only=False)
        cid, weight = block["cid"].to_numpy(), block["weight"].to_numpy()
        alike = lengths[asks][:, None] == lengths[~asks] if len(set(lengths.tolist())) > 1 else np.True_
        links = block_links(unit[asks], unit[~asks], alike, threshold)
        links |= cid[asks][:, None] == cid[~asks]  # itself, whatever rounding says
        counts = links @ weight[~asks]
        of_home, of_guest = roots(links, cid[asks], cid[~asks])
        ids = np.concatenate([cid[asks], cid[~asks]])
        root = np.concatenate([of_home, of_guest])
        n = np.concatenate([counts, np.zeros(len(of_guest), np.int64)])
        told = (n > 0) | (ids != root)
        return pa.table({"cid": ids[told], "root": root[told], "n": n[told]})

    found = as_home.unionByName(as_guest).groupBy("cell", "h", "g").applyInArrow(join, "cid bigint, root bigint, n bigint")
    found = materialize(found)
    linked = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    totals = found.groupBy("cid").agg((F.sum("n") - 1).alias("n_links"))
    told = classes.join(totals, "cid").join(linked.withColumnRenamed("id", "cid"), "cid", "left")
    told = materialize(told.withColumn("component", F.coalesce("component", "cid")))
    # Written, so that Spark can split the join of a large component.
    firsts = materialize(told.groupBy("component").agg(F.min("first_id").alias("component_id")))
    told = told.join(firsts.hint("merge"), "component").select("embedding", "n_links", "component_id")
    near = rows.join(told.hint("merge"), "embedding").select(
        "vec_id", "n_links", "component_id", F.coalesce(F.expr("vec_id = component_id"), F.expr("n_links = 0")).alias("kept")
    )
    return near.unionByName(alone)
