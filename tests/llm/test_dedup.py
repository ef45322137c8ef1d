import hashlib
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskline import session
from maskline.llm import exact, graph, jaccard, phrases, suffixes
from maskline.llm.graph import components
from maskline.llm.words import Words
from maskline.session import materialize
from texts import corpus, repeated_starts, shingles, smallest, word_list


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def normal(text):
    return re.sub(r"[ \t-\r]+", " ", text or "")


@pytest.mark.parametrize("hash_of", [F.xxhash64, lambda c: F.length(c).cast("bigint")], ids=["hash", "collisions"])
def test_exact_groups(documents, hash_of):
    rows = corpus(1)
    got = exact.exact_groups(documents(rows), capacity=5, hash_of=hash_of).collect()
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(normal(text), []).append(doc_id)
    want = sorted(
        (d, min(ids), len(ids), d == min(ids), hashlib.sha256(norm.encode()).hexdigest()) for norm, ids in groups.items() for d in ids
    )
    assert sorted(map(tuple, got)) == want


def test_exact_groups_with_repeated_and_null_ids(documents):
    got = exact.exact_groups(documents([(None, "a"), (3, "a "), (3, "a "), (None, "b"), (None, "b")])).collect()
    # "a" and "a " differ
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in got) == [
        (0, 0, 1, True), (0, 0, 2, True), (0, 0, 2, True), (3, 3, 2, True), (3, 3, 2, True),
    ]


@pytest.mark.parametrize("crowd", ["none", "half", "one slot", "all"])
def test_directory_splits_only_overfull_buckets(spark, crowd):
    """Even hashes, half of them in an eighth of the range, many behind one long beginning, and all behind one."""
    bits = {"none": "0", "half": "IF(id % 2 = 0, 3, 0)", "one slot": "IF(id % 3 = 0, 40, 0)", "all": "52"}[crowd]
    hashes = spark.range(4000).select(F.expr(f"shiftrightunsigned(xxhash64(id), {bits})").alias("h")).distinct()
    slots, depth = exact.directory(hashes, 100)
    told = {r["slot"]: r["local_depth"] for r in slots.collect()}
    assert len(told) <= 2**depth
    own = [r["h"] % 2**64 for r in hashes.collect()]
    local = {h: told[h >> (64 - depth)] for h in own}
    sizes, parents = {}, {}
    for h in own:
        sizes.setdefault((local[h], h >> (64 - local[h])), []).append(h)
    assert all(len(x) <= 100 for x in sizes.values()) and len(sizes) > 1
    for (d, _), members in sizes.items():
        if d <= depth:  # what it was split from did not fit
            parent = members[0] >> (65 - d)
            assert sum(h >> (65 - d) == parent for h in own) > 100
        else:  # with a bit less, something in its slot did not
            slot = members[0] >> (64 - depth)
            for h in own:
                if h >> (64 - depth) == slot:
                    parents.setdefault(h >> (65 - d), []).append(h)
            assert max(map(len, parents.values())) > 100
            parents = {}
    assert (max(local.values()) > depth) == (crowd in ("one slot", "all"))
    looked = {(r["h"] % 2**64): (r["local_depth"], r["bucket"]) for r in exact.in_bucket(hashes, slots, depth).collect()}
    assert looked == {h: (local[h], h >> (64 - local[h])) for h in own}


def test_rows_are_looked_up_through_the_directory(documents, monkeypatch):
    """Rows that are sent to another bucket than their entry find nothing."""
    docs = documents([(i, f"text {i % 30}") for i in range(90)])
    assert {r["group_size"] for r in exact.exact_groups(docs, capacity=4).collect()} == {3}
    right = exact.in_bucket
    calls = []

    def wrong(rows, slots, depth):
        calls.append(1)
        found = right(rows, slots, depth)
        return found if len(calls) == 1 else found.withColumn("bucket", F.col("bucket") + 1)  # the index is right, the look isn't

    monkeypatch.setattr(exact, "in_bucket", wrong)
    assert exact.exact_groups(docs, capacity=4).collect() == [] and len(calls) == 2


@pytest.mark.parametrize(("words", "num"), [(3, 90), (5, 80), (1, 50)])
def test_near_documents(documents, words, num):
    rows = corpus(2, 150)
    sets = {d: shingles(t, words) for d, t in rows}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    ]
    want = smallest(sets, links)
    got = by_id(jaccard.near_documents(documents(rows), words, num, 100))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == {d: (len(s), want[d]) for d, s in sets.items()}
    assert len(links) > 100


def test_near_documents_that_no_first_one_links(documents):
    """A chain: each text is near the next one only, so that comparing with one text of a group finds few links."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*(f"v{j}" for j in range(i * 4)), *words[i * 4 :]])) for i in range(30)]
    sets = {d: shingles(t, 1) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 97 * len(sets[a] | sets[b])]
    got = by_id(jaccard.near_documents(documents(rows), 1, 97, 100))
    assert {d: r["component_id"] for d, r in got.items()} == smallest(sets, links)


def test_common_tokens_do_not_change_links(documents, monkeypatch):
    rows = corpus(3, 100)
    monkeypatch.setattr(jaccard, "SAMPLE", 40)
    monkeypatch.setattr(jaccard, "COMMON", 40)
    assert len(jaccard.common_tokens(documents(rows), jaccard.Rule(2, 80, 100)))
    few = by_id(jaccard.near_documents(documents(rows), 2, 80, 100).drop("node"))
    monkeypatch.setattr(jaccard, "COMMON", 1)
    assert few == by_id(jaccard.near_documents(documents(rows), 2, 80, 100).drop("node"))


@pytest.mark.parametrize("window", [20, 6, 3])
def test_repeated_phrases(documents, window):
    rows = corpus(4)
    got = by_id(phrases.without_repeated_phrases(documents(rows), window))
    seen = set()
    for doc_id, text in rows:
        words, gone = word_list(text), set()
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            if key in seen:
                gone.update(range(p, p + window))
            seen.add(key)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        assert tuple(got[doc_id]) == (doc_id, len(words), len(gone), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("window", [400, 50, 33])
def test_repeated_bytes(documents, window):
    rows = corpus(5)
    texts = {d: (t or "").encode() for d, t in rows}
    again = repeated_starts(texts.values(), window)
    got = by_id(suffixes.without_repeats(documents(rows), window, texts=True))
    for doc_id, text in texts.items():
        gone = bytearray(len(text))
        for p in range(len(text) - window + 1):
            if text[p : p + window] in again:
                gone[p : p + window] = b"\1" * window
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        want = (doc_id, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore"))
        assert tuple(got[doc_id]) == want


@pytest.mark.parametrize("broken", [0, 1])
def test_windows_are_equal_only_if_both_digits_are(documents, broken):
    """A table of zeros gives all windows the same digit: nothing else is taken out for it."""
    rows = corpus(6)
    tables = [*suffixes.drawn()]
    tables[broken] = np.zeros(256, np.uint64)
    plain = {d: (r["n_removed"], r["kept_sha256"]) for d, r in by_id(suffixes.without_repeats(documents(rows), 60)).items()}
    found = {d: (r["n_removed"], r["kept_sha256"]) for d, r in by_id(suffixes.without_repeats(documents(rows), 60, tables=tuple(tables))).items()}
    assert found == plain and sum(n for n, _ in plain.values()) > 1000


def test_long_stretches_are_hashed_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 5000).astype(np.uint8)

    class Whole:
        pass

    block = Whole()
    block.data = data
    tables = suffixes.drawn()
    begin, n = np.array([3, 2000, 4000]), np.array([1500, 1, 900])
    want = suffixes.windows(block, begin, n, 50, tables)
    monkeypatch.setattr(suffixes, "PIECE", 64)
    got = suffixes.windows(block, begin, n, 50, tables)
    assert all((a == b).all() for a, b in zip(want, got, strict=True)) and len(got[0]) == n.sum()
    some = suffixes.windows(block, begin, n, 50, tables, np.array([3, 1502, 2000, 4899]))
    assert some[2].tolist() == [3, 1502, 2000, 4899]


def test_rows_that_repeat_an_id_are_rows(documents):
    long = "word " * 200
    rows = [(1, long), (1, long), (None, long), (2, "short")]
    assert sorted(r["n_removed"] for r in suffixes.without_repeats(documents(rows)).collect()) == [0, 1000, 1000, 1000]
    # each has its first 20 words' window repeated within itself
    assert len(phrases.without_repeated_phrases(documents(rows)).collect()) == 4
    near = jaccard.near_documents(documents(rows)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in near) == [(0, 1), (1, 1), (1, 1), (2, 2)]


def test_empty_tables(documents):
    none = documents([(1, "a")]).where("false")
    for made in (
        exact.exact_groups(none), jaccard.near_documents(none), phrases.without_repeated_phrases(none), suffixes.without_repeats(none)
    ):
        assert made.collect() == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 7), (20, 20), (3, 1), (None, 4)] + [(100 + i, 101 + i) for i in range(50)] + [(500, 600 + i) for i in range(40)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    whole = [e for e in edges if None not in e and e[0] != e[1]]
    assert got == smallest({x for e in whole for x in e}, whole)


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_a_query_is_counted_against_a_whole_group(monkeypatch, held):
    monkeypatch.setattr(jaccard, "HELD", held)
    rng, rule = np.random.default_rng(2), jaccard.Rule(3, 80, 100)
    base = rng.integers(0, 2**64, 60, np.uint64)
    edited = [np.unique(np.concatenate([rng.choice(base, 60 - n, replace=False), rng.integers(0, 2**64, n, np.uint64)])) for n in rng.integers(0, 30, 40)]
    sets = [np.sort(base), np.sort(base), np.zeros(0, np.uint64), rng.integers(0, 2**64, 1, np.uint64), *edited]
    group = jaccard.Group(sets[:-6])
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 0
    for q, tokens in enumerate(sets):
        own = q if q < len(sets) - 6 else None
        want = [m for m, s in enumerate(sets[:-6]) if m != own and 100 * share({*tokens.tolist()}, {*s.tolist()}) >= 80]
        assert group.similar(tokens, own, rule) == want
    assert jaccard.Group([]).similar(sets[0], None, rule) == [] and jaccard.Group([sets[2]]).similar(sets[0], None, rule) == []


@pytest.mark.parametrize("piece", [1 << 18, 16])
def test_components_of_contracted_pieces(spark, monkeypatch, piece):
    tables = []
    monkeypatch.setattr(graph, "PIECE", piece)
    monkeypatch.setattr(graph, "materialize", lambda df: tables.append(1) or materialize(df))
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 150, (100, 2))] + [(1000 - i, 999 - i) for i in range(60)] + [(-5, 2**60)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(3)).collect()}
    whole = [e for e in edges if e[0] != e[1]]
    assert got == smallest({x for e in whole for x in e}, whole)
    # Written once as they are and once contracted; pieces that meet need rounds.
    assert len(tables) == 2 if piece > len(edges) else len(tables) > 2


def test_windows_come_from_what_the_automaton_meets():
    text = "a b c d e f g b c d h i j k l m n o p q b c d r".encode()
    data, starts = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    words = Words(data, starts)
    n = len(words.hash)
    automaton = phrases.phrase_automaton([" b c d ", " x y z "])
    met = phrases.occurrences(*phrases.spaced(data, words, np.arange(n)), automaton)
    assert met.tolist() == [1, 7, 20]
    for window in (3, 6, 10, n):
        want = [s for s in range(n - window + 1) if any(s <= p and p + 3 <= s + window for p in met.tolist())]
        assert phrases.covering(met, n, window, 3).tolist() == want
    assert phrases.covering(met[:0], n, 6, 3).tolist() == []
    none = phrases.phrase_automaton([" x y z "])
    assert phrases.occurrences(*phrases.spaced(data, words, np.arange(n)), none).tolist() == []


def test_phrases_of_long_texts(documents, monkeypatch):
    """Longer than the pieces that windows are hashed in."""
    rng = np.random.default_rng(3)
    long_ = " ".join(f"w{i}" for i in rng.integers(0, 10**6, 600_000))
    passage = long_[2_000_000:2_001_000].split(" ", 1)[1].rsplit(" ", 1)[0]
    got = by_id(phrases.without_repeated_phrases(documents([(1, long_), (2, f"start {passage} end")])))
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == len(passage.split())


def test_near_documents_leaves_what_its_result_reads(spark, documents):
    """Tables of steps that are over are gone before the rows are asked for."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{base} {'end ' * (i % 3)}" if i % 2 else " ".join(f"v{i}x{j}" for j in range(40))) for i in range(60)]
    folder = session.shared_folder(spark)
    before = set(os.listdir(folder.removeprefix("file:")))
    near = jaccard.near_documents(documents(rows))
    assert len(set(os.listdir(folder.removeprefix("file:"))) - before) == 2
    assert len({r.component_id for r in near.collect()}) == 31
