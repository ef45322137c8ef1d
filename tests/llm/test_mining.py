"""Hard negatives, spelling variants and toxicity against plain definitions; words made to collide."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskline.llm import jaccard, licenses, negatives, phrases, toxicity, variants
from maskline.llm.words import Words, key

# Hard negatives


@pytest.mark.parametrize("top", [0, 5, 300, 2**20, 2**31, 2**45])
def test_packed_scores_are_exact(top):
    rng = random.Random(top)
    make = lambda n: np.array([[rng.randint(-top, top) for _ in range(3)] for _ in range(n)], np.int64)
    a, c = make(7), make(1100)
    if top == 2**45:  # only scores have to fit
        a[:, 1:], c[:, 0] = 0, rng.randint(0, 2**16)
    want = [[sum(x * y for x, y in zip(r, s, strict=True)) for s in c.tolist()] for r in a.tolist()]
    assert negatives.scores(a, c).tolist() == want
    assert negatives.scores(a[:0], c).shape == (0, 1100)
    assert negatives.scores(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)).tolist() == [[0] * 3] * 2


def plain_negatives(rows, every, positives, count, low, high):
    usable = []
    for n, (vec_id, vector, label) in enumerate(rows):
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own = [math.floor(256 * x) for x in vector]
        if sum(x * x for x in own) < 9e18:
            usable.append((vec_id, n, label, own))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for a in usable:
        if a[0] % every:
            continue
        scored = sorted((-dot(a[3], r[3]), r[0], r[1], r[2]) for r in usable if r[1] != a[1] and len(r[3]) == len(a[3]))
        for p in [s for s in scored if s[3] == a[2]][:positives]:
            hard = [s for s in scored if s[3] != a[2] and low * -p[0] <= 100 * -s[0] <= high * -p[0]][:count]
            out += [(a[0], p[1], k, s[1], -p[0], -s[0]) for k, s in enumerate(hard, 1)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 9)
    monkeypatch.setattr(negatives, "CANDIDATES", 40)
    rng = random.Random(3)
    rows = []
    for vec_id in range(260):
        label = rng.choice([0, 0, 0, 0, 1, 2, 3, 10**9])
        vector = [rng.choice([-0.3, 0.1, 0.2, 0.25, 1.0]) if rng.random() < 0.8 else rng.uniform(-1, 1) for _ in range(4)]
        rows.append((vec_id, vector, label))
    rows += [(i, rows[i][1], rows[i][2]) for i in (0, 10, 11, 20, 33)]  # repeated rows
    rows += [(400, None, 1), (410, [], 1), (411, [], 2), (420, [1.0, None, 0.0, 0.0], 1), (430, [float("nan")] * 4, 1), (None, [1.0] * 4, 1)]
    rows += [(440, [1.0] * 4, None), (450, [0.5, 0.5], 1), (451, [0.5, 0.4], 1), (452, [0.2, 0.2], 2), (460, [1e300] * 4, 1), (470, [float("inf")] + [0.0] * 3, 2), (480, [0.0] * 4, 0)]
    rows += [(500, [3e6, 0.0, 0.0, 2e6], 7), (501, [3e6, 0.0, 0.0, 1e6], 7), (502, [1e6, -1e6, 0.0, 1.5e6], 8)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, row bigint, rank string").repartition(3)
    got = negatives.hard_negatives(table, every=10, positives=4, negatives=6)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    want = plain_negatives(rows, 10, 4, 6, 30, 90)
    assert len(want) > 200
    assert sorted(map(tuple, got.collect())) == want
    assert negatives.hard_negatives(table.limit(0)).collect() == []


# Spelling variants


def plain_variants(rows, shortest, least, times, wear):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if wear and h % wear == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= shortest and k >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, total = {}, {}
    for w in n:
        others = sorted((-n[o], o) for o in n if o != w and near(w, o))
        total[w] = len(others)
        form[w] = others[0][1] if others and -others[0][0] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], total[w], form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def test_spelling_variants(documents, monkeypatch):
    monkeypatch.setattr(variants, "LONG", 9)  # shorter and longer words, and pairs over the edge
    rng = random.Random(5)
    bases = ["letter", "aabba", "aaaaa", "aaaaaa", "éàÿñö", "thirteens", "abcdefghij", "abcdefghijk", "xyxyxyxyxyxyxy"]
    words = set(bases)
    for base in bases:
        for _ in range(14):
            at, c = rng.randrange(len(base)), rng.choice("abéz")
            words.add(rng.choice([base[:at] + base[at + 1 :], base[:at] + c + base[at:], base[:at] + c + base[at + 1 :]]))
    words = sorted(words)
    rows = [(k, None if k % 9 == 0 else rng.choice([" ", "\n", "-", "1"]).join(rng.choices(words, [1 + 3 * (w in bases) for w in words], k=60))) for k in range(40)]
    rows += [(7, " ".join(words)), (None, "Letter LETTER letter ÉÀÿñö"), (90, ""), (91, "x" * 3000), (92, "x" * 3000), (93, "x" * 2999 + " " + "x" * 3000), (94, "x" * 2999), (95, "x" * 2999)]
    for wear in (0, 7):
        got = variants.spelling_variants(documents(rows), wear=wear)
        want = plain_variants(rows, 5, 3, 2, wear)
        assert len({r[5] for r in want}) > 5 and any(r[3] for r in want)
        assert sorted(map(tuple, got.collect())) == want
    assert variants.spelling_variants(documents(rows).limit(0)).collect() == []


def test_pairs_meet_once_in_the_rotations():
    bases = (2**33 + 1, 2**35 + 3)
    for long_, short in (("aab", "ab"), ("aab", "aa"), ("abcabc", "abcab"), ("bookkeeper", "bokkeeper")):
        skipped = [key for key, whole, first in variants.rotations(long_, bases) if first]
        whole = {key for key, is_whole, _ in variants.rotations(short, bases) if is_whole}
        assert sum(key in whole for key in skipped) == 1


# Toxicity


def labelled(spark, rows):
    """documents and labels of (doc_id, text, toxic or None)."""
    docs = spark.createDataFrame([(i, t, "en", "a", 1.0) for i, t, _ in rows], "doc_id bigint, text string, lang string, toxic string, score double")
    known = [(i, 1, y) for i, _, y in rows if y is not None]
    return docs.repartition(3), spark.createDataFrame(known, "doc_id bigint, quality int, toxic int")


def test_pairs_teach_what_single_terms_do_not(spark):
    """An insult is toxic only where a group is mentioned, a group only where it is insulted."""
    rng = random.Random(1)
    insults, groups = [f"insult{c}" for c in "abcd"], [f"group{c}" for c in "abcd"]
    plain = [f"{a}{b}word" for a in "xyzwvu" for b in "rstq"]
    rows = []
    for doc_id in range(1500):
        own = rng.sample(plain, 6)
        kind = doc_id % 4
        own += [rng.choice(insults)] * (kind in (1, 3)) + [rng.choice(groups)] * (kind in (2, 3))
        rng.shuffle(own)
        rows.append((doc_id, " ".join(own), int(kind == 3)))
    docs, labels = labelled(spark, rows)
    got = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert len(got) > 200
    assert all(r.predicted == r.toxic for r in got)


def test_scores_and_odd_rows(spark):
    rows = [(k, f"nice day number{k}" + " you moron" * (k % 3 == 0), int(k % 3 == 0)) for k in range(200)]
    odd = [(1000, None, None), (1001, "", None), (None, "moron", None), (1002, "MORON", None), (1003, "a " * 50000 + "moron", None), (5, "moron moron", None), (1004, "中文 é", None)]
    docs, labels = labelled(spark, rows + odd)
    again = labels.unionByName(labels.where("doc_id in (1, 2)").withColumn("toxic", 1 - F.col("toxic")))  # labelled both ways
    again = again.unionByName(spark.createDataFrame([(3, 1, None), (None, 1, 1)], labels.schema))
    got = toxicity.toxicity(docs, again)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    found = got.collect()
    assert len(found) == len(rows) + len(odd)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    by_id = {r.doc_id: r for r in found if r.doc_id != 5}
    assert by_id[1002].predicted and by_id[1003].predicted and by_id[None].predicted
    assert not by_id[1000].predicted and by_id[1000].score == by_id[1001].score == by_id[1004].score
    assert sorted(r.predicted for r in found if r.doc_id == 5) == [0, 1]
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == len(found) and {round(r.score, 9) for r in none} == {0.01}
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_held_out_labels_teach_nothing(spark):
    rows = [(k, "good bad"[5 * (k % 2) :][:4] + f" text{k}", k % 2) for k in range(100)]
    docs, labels = labelled(spark, rows)
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(toxicity.toxicity(docs, labels)) == plain(toxicity.toxicity(docs, other))
    assert toxicity.sampled(docs, labels, 7).count() == 7


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables here")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    told = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    toxic = told.toxic == 1
    assert told.predicted[toxic].mean() > 0.8 and told.predicted[~toxic].mean() < 0.01


# Words that collide under a hash without mixing


def thue_morse(n=1024):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_no_text_breaks_the_word_hash(documents):
    one, other = thue_morse()
    for n in (8, 9, 64, 512, 1024, 2048):
        data = " ".join(thue_morse(n)).encode()
        hashed = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), key=key()).hash
        assert hashed[0] != hashed[1]
    rest = [f"w{i}" for i in range(60)]
    pair = [(k, " ".join([*rest[:10], w, *rest[10:19]])) for k, w in enumerate((one, other))]
    near = jaccard.near_documents(documents(pair), words=3, num=90, den=100).collect()
    assert sorted((r.doc_id, r.component_id) for r in near) == [(0, 0), (1, 1)]
    cut = phrases.without_repeated_phrases(documents(pair)).collect()
    assert [r.n_removed for r in cut] == [0, 0]
    found = licenses.license_spans(documents(pair), templates={"x": pair[0][1]}, coverage=1.0).collect()
    assert [r.doc_id for r in found] == [0]


def test_hashes_of_words_depend_on_bytes_alone():
    texts = ["abc", "x abc", "abcdefgh abc", "long " + "y" * 5000 + " abc", "é abc\x00", "abc"]
    raw = [t.encode() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    own = key()
    words = Words(np.frombuffer(b"".join(raw), np.uint8), starts, key=own)
    named = {}
    for a, b, h in zip(words.start, words.end, words.hash, strict=True):
        assert named.setdefault(b"".join(raw)[a:b], h) == h
    assert len(set(named.values())) == len(named)
    assert {h.item() for h in Words(np.frombuffer(raw[0], np.uint8), np.array([0, 3]), key=own).hash} == {named[b"abc"].item()}
