"""Exact Jaccard self-join of shingle sets with a token-group matrix.

Candidates. Two sets with a Jaccard similarity of at least t and at most `hi` tokens each differ in at most k =
2 hi (1 - t) / (1 + t) tokens. Each set is cut by token hash into parts, k + 1 and some more; similar sets agree in all but
k of their parts. A part's signature is a hash of its tokens. Parts that hold nothing but very common tokens (found in a
bounded sample) say little and are not sent as long as more than k others are left, which keeps the join exact whatever
the sample held. A set whose partner may be in the next class of sizes is cut for that class too. Sets of a block that
are equal are one before they are cut. A set that has a similar one meets it in all signatures it sent but k: those that
meet anything less often are done.

Links. Sets that share a signature are compared with the first of them; that links nearly all copies. Clusters of sets
that share signatures but are not all linked by that are partitioned into groups of similar documents, of bounded size.
The matrix of groups and tokens, stored as each group's token union, bounds the overlap of a set with any member of a
group: every set outside the largest linked part of its cluster asks the groups of like sizes, and is compared with the
members of those whose union holds enough of its tokens.

Only links that connect are kept: groups of copies are never written out as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.llm.anchors import hashes, ladder, mix
from maskline.llm.blocks import Block, by_block, by_shard, each_block, pack, spread, squeeze, steps, total_bytes, unstep, write_blocks
from maskline.llm.common import release, slices, utf8
from maskline.llm.graph import components
from maskline.llm.words import FIXED, LOWER, Words, key
from maskline.session import forget, freed_shuffles, materialize, recorded

#: Bytes of text per block, and per shard of the exchange of signatures.
BLOCK, SHARD = 2 << 20, 8 << 20
#: Documents in the sample for common tokens; a token is common in 1 / COMMON of them or more.
SAMPLE, COMMON = 5000, 500
#: Members of a group; queries and groups that are compared at once.
GROUP, QUERIES, GROUPS = 256, 512, 32
#: Tokens of members that are counted at once.
HELD = 1 << 20
#: Ratio of set sizes from one band to the next.
BAND = 1.1


class Rule:
    """Similarity of at least num / den on shingles of `words` words."""

    def __init__(self, words: int, num: int, den: int):
        self.words, self.num, self.den = words, num, den
        # Words are hashed under a key of this run's own.
        self.key = key()

    def least_overlap(self, size: int) -> int:
        """Tokens that a set of this size shares with any similar one."""
        return -(-size * self.num // self.den)

    @cache  # noqa: B019
    def tops(self, upto: int) -> list[int]:
        """Largest set sizes of the classes, until one is `upto` or more."""
        found = [1]
        while found[-1] < upto:
            found.append(max(found[-1] + 1, found[-1] * 3 // 2))
        return found

    def classes(self, size: int) -> list[tuple[int, int, int]]:
        """(class, most differing tokens, parts) for all classes in which a set of this size may be the smaller partner."""
        tops = self.tops(-(-size * self.den // self.num) + 1)
        found = []
        for number, top in enumerate(tops):
            below = tops[number - 1] if number else 0
            # The larger partner has below + 1 tokens at least and top at most.
            if top >= size and size * self.den >= self.num * (below + 1):
                apart = 2 * top * (self.den - self.num) // (self.den + self.num)
                found.append((number, apart, apart + 1 + max(-(-apart // 5), min(apart + 1, 4))))
        return found


class Group:
    """Sets that are asked together: their token union, and which of them hold each of its tokens."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(tokens, kind="stable")
        self.holder = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        tokens = tokens[order]
        self.first = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
        self.union, self.times = tokens[self.first], np.diff(self.first, append=len(tokens))

    def similar(self, tokens: np.ndarray, own: int | None, rule: Rule) -> list[int]:
        """Places of the sets that are similar to this one, which is the set at `own` where that is not None."""
        if not len(tokens) or not len(self.union):
            return []
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        first, times = self.first[at], self.times[at]
        # What the union of the others holds bounds the overlap with any of them.
        if (times > (own is not None)).sum() < rule.least_overlap(len(tokens)):
            return []
        shared = np.zeros(len(self.sizes), np.int64)
        step = -(-HELD // len(self.sizes))
        for k in range(0, len(at), step):
            start, n = first[k : k + step], times[k : k + step]
            held = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared += np.bincount(self.holder[held], minlength=len(self.sizes))
        similar = (self.sizes > 0) & (rule.den * shared >= rule.num * (len(tokens) + self.sizes - shared))
        if own is not None:
            similar[own] = False
        return np.flatnonzero(similar).tolist()


def shingle_sets(data: np.ndarray, starts: np.ndarray, k: int, key: tuple[int, int] = FIXED) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: of k words, or of all words of a shorter one."""
    words = Words(LOWER[data], starts, key=key)
    rungs = ladder(words.hash, k) if len(words.hash) else []
    shingles = hashes(rungs, k) if rungs else words.hash
    found = []
    for a, b in zip(words.of_doc[:-1].tolist(), words.of_doc[1:].tolist(), strict=True):
        if b - a >= k:
            found.append(np.unique(shingles[a : b - k + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for h in words.hash[a:b]:
                whole = mix(np.array([whole]))[0] ^ h
            found.append(mix(np.array([whole])))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def signatures(tokens: np.ndarray, common: np.ndarray, rule: Rule) -> Iterator[tuple[int, int, np.ndarray]]:
    """(class, how many signatures a set with a similar one shares at least, signatures) of a set that isn't empty."""
    rare = np.ones(len(tokens), bool)
    if len(common):
        rare = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] != tokens
    for number, apart, parts in rule.classes(len(tokens)):
        mixed = mix(tokens ^ np.uint64(number + 1))
        part = (mixed >> np.uint64(32)).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        filled, first = np.unique(part[order], return_index=True)
        sums = np.zeros(parts, np.uint64)
        sums[filled] = np.add.reduceat(mixed[order], first)
        telling = np.bincount(part[rare], minlength=parts) > 0
        signs = mix(sums ^ mix(np.arange(parts, dtype=np.uint64) | np.uint64(number << 32)))
        if telling.sum() > apart:
            yield number, int(telling.sum()) - apart, signs[telling]
        else:
            yield number, 1, signs


def common_tokens(docs: DataFrame, rule: Rule) -> np.ndarray:
    """Sorted hashes of the tokens that at least one in COMMON of at most SAMPLE documents has."""
    # Bounded by SAMPLE ids.
    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64(F.col("doc_id"), F.lit(5)), "doc_id").limit(SAMPLE)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            sets = shingle_sets(*utf8(part["text"]), rule.words, rule.key)
            found, n = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["token", "n"])

    sample = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select("text")
    least = max(3, SAMPLE // COMMON)
    # At most as many as the tokens of the sample, divided by the least count.
    rows = sample.mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r["token"] for r in rows.select("token").collect()], np.int64).view(np.uint64))


def node_of(block: int, doc: np.ndarray | int):
    """A number for each document: 23 bits of the task that wrote its block, 16 of the block, 24 of its place there."""
    task, number = block >> 33, block & (1 << 33) - 1
    if task >> 23 or number >> 16:
        raise ValueError("too many blocks")
    return (task << 40 | number << 24) + doc


def signed(blocks: DataFrame, shards: int, common: np.ndarray, rule: Rule) -> DataFrame:
    """Rows of three kinds, by which columns are null: documents (node, doc_id, size, first), where first is the node of
    the first equal set of the block; promises (node, class, least), the signatures a node with a similar one shares; and
    meetings (node, class, sign, block) of nodes that share a signature."""
    entry = pa.schema(
        [("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("doc", pa.binary()), ("class", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("firsts", pa.binary()), ("promises", pa.binary())]
    )
    entry_ddl = "shard bigint, block bigint, keys binary, doc binary, class binary, doc_ids array<bigint>, sizes binary, firsts binary, promises binary"

    def sign(block: Block) -> Iterator[dict]:
        sets = shingle_sets(block.data, block.starts, rule.words, rule.key)
        firsts, seen, promises = [], {}, []
        keys, docs, classes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
        for doc, tokens in enumerate(sets):
            first = seen.setdefault(tokens.tobytes(), doc) if len(tokens) else doc
            firsts.append(first)
            if first == doc and len(tokens):
                for number, least, signs in signatures(tokens, common, rule):
                    keys.append(signs)
                    docs.append(np.full(len(signs), doc))
                    classes.append(np.full(len(signs), number, np.uint8))
                    promises += [doc, number, least]
        # Each block's documents are a shard of their own.
        yield {
            "shard": -1 - block.number, "block": block.number, "doc_ids": block.doc_ids, "sizes": squeeze(np.array([len(s) for s in sets], np.int64)),
            "firsts": squeeze(np.array(firsts, np.int64)), "promises": squeeze(np.array(promises, np.int64)),
        }
        yield from pack(block.number, np.concatenate(keys), shards, {"doc": np.concatenate(docs), "class": np.concatenate(classes)}, ("doc",))

    def meet(rows: pa.Table) -> pa.Table:
        if rows["shard"][0].as_py() < 0:
            return pa.concat_tables([documents(row) for row in rows.to_pylist()])
        rows = rows.select(["block", "keys", "doc", "class"]).to_pylist()
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
        node = np.concatenate([node_of(r["block"], unstep(r["doc"])) for r in rows])
        number = np.concatenate([spread(r["class"]) for r in rows]).astype(np.int32)
        block = np.repeat(np.array([r["block"] for r in rows]), [len(r["keys"]) // 8 for r in rows])
        order = np.argsort(keys, kind="stable")
        same = np.concatenate([[False], keys[order][1:] == keys[order][:-1], [False]])
        some = order[same[1:] | same[:-1]]
        release()
        return table({"node": node[some], "class": number[some], "sign": keys[some].view(np.int64), "block": block[some]})

    def documents(row: dict) -> pa.Table:
        sizes, firsts = spread(row["sizes"], np.int64), spread(row["firsts"], np.int64)
        promised = spread(row["promises"], np.int64).reshape(-1, 3)
        nodes = node_of(row["block"], np.arange(len(sizes)))
        own = table({"node": nodes, "doc_id": pa.array(row["doc_ids"], pa.int64()), "size": sizes, "first": nodes[firsts]})
        told = table({"node": nodes[promised[:, 0]], "class": promised[:, 1].astype(np.int32), "least": promised[:, 2]})
        return pa.concat_tables([own, told])

    fields = [("node", pa.int64()), ("doc_id", pa.int64()), ("size", pa.int64()), ("first", pa.int64()), ("class", pa.int32()), ("least", pa.int64()), ("sign", pa.int64()), ("block", pa.int64())]

    def table(columns: dict) -> pa.Table:
        n = len(columns["node"])
        return pa.table([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in fields], schema=pa.schema(fields))

    entries = each_block(blocks, sign, entry, entry_ddl)
    return materialize(
        entries.groupBy("shard").applyInArrow(
            meet, "node bigint, doc_id bigint, size bigint, first bigint, class int, least bigint, sign bigint, block bigint"
        )
    )


def token_sets(blocks: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """(node, tokens) for nodes (node, block)."""
    schema = pa.schema([("node", pa.int64()), ("tokens", pa.binary())])

    def work(block: Block, rows: list[dict]) -> Iterator[dict]:
        if not rows:
            return
        wanted = np.sort(np.array([r["node"] for r in rows])) - node_of(block.number, 0)
        own = [block.data[block.starts[d] : block.starts[d + 1]] for d in wanted.tolist()]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        sets = shingle_sets(np.concatenate(own), starts, rule.words, rule.key)
        for doc, tokens in zip(wanted.tolist(), sets, strict=True):
            yield {"node": node_of(block.number, doc), "tokens": tokens.tobytes()}

    return materialize(by_block(blocks, nodes, work, schema, "node bigint, tokens binary"))


def compared(asks: DataFrame, members: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) between each asking set (node, of, part, home) and the members (node, of, part) of the group it asks.

    Sets with the same home ask much the same groups. The queries and the groups of a home are dealt to cells of bounded
    numbers of both, and a cell gets the tokens of each of its sets once, however many groups it asks or is in.
    """
    asks = materialize(asks)  # read several times
    # Sizes that cells are cut by, near enough.
    homes = asks.groupBy("home").agg(F.approx_count_distinct("node").alias("q"), F.approx_count_distinct(F.struct("of", "part")).alias("g"))
    homes = homes.select("home", F.ceil(F.col("q") / QUERIES).cast("bigint").alias("qs"), F.ceil(F.col("g") / GROUPS).cast("bigint").alias("gs"))
    cell = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("qs")), F.pmod(F.xxhash64("of", "part"), F.col("gs"))).alias("cell")
    queries = materialize(asks.join(homes, "home").select(cell, "of", "part", "node", F.lit(True).alias("asks")))
    opened = queries.select("cell", "of", "part").distinct().join(members, ["of", "part"])
    roles = queries.unionByName(opened.select("cell", "of", "part", "node", F.lit(False).alias("asks")))
    told = roles.groupBy("cell", "node").agg(F.collect_list(F.struct("of", "part", "asks")).alias("roles"))  # GROUPS groups at most
    tasks = F.lit(max(1, -(-asks.count() // (2 * QUERIES))))

    def open_groups(rows: pa.Table) -> pa.Table:
        node, cells = rows["node"].to_pylist(), rows["cell"].to_pylist()
        tokens = [np.frombuffer(x, np.uint64) for x in rows["tokens"].to_pylist()]
        groups: dict[tuple, tuple[list[int], list[int]]] = {}
        for k, roles in enumerate(rows["roles"].to_pylist()):
            for r in roles:
                groups.setdefault((cells[k], r["of"], r["part"]), ([], []))[r["asks"]].append(k)
        found = []
        for group, asking in groups.values():
            opened = Group([tokens[k] for k in group])
            place = {k: m for m, k in enumerate(group)}
            for q in asking:
                # One that asks its own group is compared with the others.
                found += [(node[q], node[group[m]]) for m in opened.similar(tokens[q], place.get(q), rule)]
        release()
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    rows = told.join(sets.hint("merge"), "node")
    dealt = rows.withColumn("task", F.pmod(F.col("cell"), tasks))
    return dealt.groupBy("task").applyInArrow(open_groups, "a bigint, b bigint")


def opened_groups(clusters: DataFrame, labels: DataFrame, sizes: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) between sets of one cluster (node, cluster: joined by shared signatures) that have no label (node, label:
    joined by links) in common yet; sizes has (node, size).

    A cluster is cut into groups by label, where that is large, and by bands of set sizes; similar sets are at most a few
    bands apart. All but those of the largest label ask: the groups of the largest label on both sides, others upwards.
    """
    known = labels.join(clusters, "node").join(sizes, "node").withColumn("band", F.floor(F.log("size") / math.log(BAND)).cast("bigint"))
    counts = known.groupBy("cluster", "label").agg(F.count("*").alias("members"))
    largest = counts.groupBy("cluster").agg(F.count("*").alias("labels"), F.max(F.struct("members", "label")).alias("l"))
    counts = counts.join(largest.where("labels > 1").select("cluster", F.col("l.label").alias("largest")), "cluster")
    alone = (F.col("members") > GROUP) | (F.col("label") == F.col("largest"))
    counts = materialize(counts.withColumn("of", F.when(alone, F.col("label")).otherwise(-1 - F.col("cluster"))))
    told = materialize(known.join(counts.hint("merge"), ["cluster", "label"]).select("node", "label", "cluster", "largest", "of", "band"))
    cuts = materialize(told.groupBy("of", "band").agg(F.ceil(F.count("*") / GROUP).cast("bigint").alias("cuts")))
    # At most 2 ** 20 groups in a band of a label: sixty million sets.
    part = F.col("band") * (1 << 20) + F.pmod(F.xxhash64("node"), F.col("cuts"))
    grouped = told.join(cuts.hint("merge"), ["of", "band"]).select("node", "label", "cluster", "largest", "of", "band", part.alias("part"))
    grouped = materialize(grouped)
    groups = materialize(grouped.select("cluster", "of", "part", F.col("band").alias("there"), (F.col("of") == F.col("largest")).alias("both")).distinct())
    apart = int(math.log(rule.den / rule.num) / math.log(BAND)) + 1
    # Those of a cluster and band ask the same groups.
    home = F.xxhash64("cluster", "band").alias("home")
    asking = grouped.where("label <> largest").select("node", "label", "cluster", "band", home)
    near = f"of <> label AND there <= band + {apart} AND there >= IF(both, band - {apart}, band)"
    asks = asking.join(groups.hint("merge"), "cluster").where(near).select("node", "of", "part", "home")
    return compared(asks, grouped.select("node", "of", "part"), sets, rule)


def central_links(meetings: DataFrame, clusters: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) of the sets of a cluster with its central one: the one whose signatures the most others share. Copies
    that are edited apart from each other are near the text that they are all edited from."""
    met = meetings.groupBy("sign").agg(F.count("*").alias("n"))
    weights = meetings.select("sign", "node").join(met.hint("merge"), "sign").groupBy("node").agg(F.sum("n").alias("weight"))
    central = weights.join(clusters, "node").groupBy("cluster").agg(F.max(F.struct("weight", "node")).alias("c"))
    one = F.lit(0).cast("bigint").alias("part")
    central = materialize(central.select("cluster", F.col("c.node").alias("of"), one))
    asks = clusters.join(central.hint("merge"), "cluster").where("node <> of").select("node", "of", "part", F.col("of").alias("home"))
    return materialize(compared(asks, central.select(F.col("of").alias("node"), "of", "part"), sets, rule))


def _linked(met: DataFrame, sizes: DataFrame, sets: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """((node, label), links (a, b)) of the sets (node, tokens) that meet (node, sign): those that links with first and central
    ones join have a label in common, and links of opened groups join these."""
    pivots = met.groupBy("sign").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("sign", "b")
    # The first one is a group of its own.
    one = F.lit(0).cast("bigint").alias("part")
    asks = met.select("sign", "node").join(pivots.hint("merge"), "sign").where("node <> b").select("node", F.col("b").alias("of"), one)
    firsts = pivots.select(F.col("b").alias("node"), F.col("b").alias("of"), one).distinct()
    asks = materialize(asks.distinct())
    links = materialize(compared(asks.withColumn("home", F.col("of")), firsts, sets, rule))
    clusters = components(asks.select(F.col("node").alias("a"), F.col("of").alias("b")))
    clusters = materialize(clusters.select(F.col("id").alias("node"), F.col("component").alias("cluster")))
    links = links.unionByName(central_links(met, clusters, sets, rule))
    labels = components(links).select(F.col("id").alias("node"), F.col("component").alias("label"))
    labels = met.select("node").distinct().join(labels, "node", "left")
    labels = materialize(labels.select("node", F.coalesce("label", "node").alias("label")))
    return labels, materialize(opened_groups(clusters, labels, sizes, sets, rule))


def near_documents(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, node), one row per row of docs (doc_id, text).

    A-Z are lower-cased and words are runs of bytes other than blanks. Rows link when their sets of shingles of `words`
    words have a Jaccard similarity of num / den or more; a text of fewer words is one shingle; one without words, or a
    null one, has an empty set and links with nothing. component_id is the smallest id that can be reached by links; null
    ids are not counted, so it is null only if all ids there are. Rows that repeat an id are rows of their own, and link as
    their texts do. node numbers the rows. Shingles are compared as 64-bit hashes. Other columns are ignored.
    """
    rule = Rule(words, num, den)
    spark = docs.sparkSession
    # What a step has written, shuffles and tables, goes as soon as no later step reads it.
    with freed_shuffles(spark):
        shards = max(1, -(-total_bytes(docs) // SHARD))
        common = common_tokens(docs, rule)
        with recorded() as cut:
            blocks = write_blocks(docs, BLOCK)
        with recorded() as marked:
            rows = signed(blocks, shards, common, rule)
        with recorded() as passing:
            documents = materialize(rows.where("first is not null").select("node", "doc_id", "size", "first"))
            promises = rows.where("least is not null").select("node", "class", "least")
            met = rows.where("sign is not null").select("node", "class", "sign", "block")
            often = met.groupBy("node", "class").agg(F.count("*").alias("n")).join(promises, ["node", "class"]).where("n >= least")
            met = materialize(met.join(often.select("node", "class").hint("merge"), ["node", "class"]))
            forget(spark, marked)
            with recorded() as opened:
                sets = token_sets(blocks, met.select("node", "block").distinct(), rule)
            forget(spark, cut)
            labels, more = _linked(met, documents.select("node", "size"), sets, rule)
            forget(spark, opened)
            edges = (
                documents.select(F.col("node").alias("a"), F.col("first").alias("b"))
                .unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
                .unionByName(more)
            )
            told = documents.join(components(edges).withColumnRenamed("id", "node"), "node", "left")
            told = told.select("node", "doc_id", "size", F.coalesce("component", "node").alias("component"))
        told = materialize(told)
        forget(spark, passing)
        # Written, so that Spark can split the join of a large component.
        smallest = materialize(told.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    return told.join(smallest.hint("merge"), "component").select(
        "doc_id", F.col("size").alias("n_shingles"), "component_id", "node"
    )
