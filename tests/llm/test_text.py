import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from maskline import session
from maskline.llm import bpe, interleave, licenses, metric, packing, quality
from maskline.llm.words import LOWER, Words
from texts import ODD, corpus, smallest, word_list

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
CODEC = bpe.codec(RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# Byte-level BPE


@settings(deadline=None, max_examples=300)
@given(st.one_of(st.text(), st.text("ab "), st.text("the quick\n '"), st.text("é中🙂x")))
def test_bpe_is_the_library_s(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_bpe_of_very_long_pre_tokens():
    rng = random.Random(1)
    for letters in ("a", "ab", "etaoin", "中é"):
        text = "".join(rng.choice(letters) for _ in range(30_000))
        assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)


@given(st.lists(st.tuples(st.integers(0, 50255), st.integers(0, 50)), max_size=60))
def test_rank_queue_gives_pairs_in_order(pairs):
    queue = bpe.RankQueue()
    for rank, position in pairs:
        queue.push(rank, position)
    got = []
    while queue.top:
        got.append(queue.pop())
    assert got == sorted(pairs) and not queue.buckets and not any(queue.low) and not any(queue.middle)


def test_bpe_round_trip(documents):
    rows = corpus(6, 60)
    frame = documents(rows)
    got = by_id(bpe.round_trip(frame, RANKS, public_tokenizers.PATTERN))
    encoded = bpe.encoded(frame, RANKS, public_tokenizers.PATTERN)
    ids = {d: r["ids"] for d, r in by_id(encoded).items()}
    back = {d: bytes(r["bytes"]) for d, r in by_id(bpe.decoded(encoded, RANKS, public_tokenizers.PATTERN)).items()}
    for doc_id, text in rows:
        want = LIBRARY.encode_ordinary(text or "")
        assert ids[doc_id] == want and back[doc_id] == (text or "").encode()
        digest = hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert tuple(got[doc_id]) == (doc_id, len(want), digest, hashlib.sha256((text or "").encode()).hexdigest())
    assert bpe.round_trip(frame.where("false"), RANKS, public_tokenizers.PATTERN).collect() == []


def test_memo_is_bounded():
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN, most=5)
    for text in ("one two three four five six seven eight nine", "nine ten"):
        assert codec.encode(text) == LIBRARY.encode_ordinary(text)
    assert len(codec) <= 5


# Sharding


def test_interleaved_shards(documents):
    rng = random.Random(2)
    rows = [(i, rng.choice(ODD), None, rng.choice(["a"] * 6 + ["b", "c", "c", None])) for i in range(500)] + [(None, "x"), (7, "x"), (7, "x")]
    got = interleave.interleaved_shards(documents(rows), shards=8).collect()
    assert len(got) == len(rows)
    counts = Counter(r["shard"] for r in got)
    assert sorted(counts) == list(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    source = {i: r[3] for i, r in enumerate(rows[:500])}
    for name, total in Counter(source.values()).items():
        per_shard = Counter(r["shard"] for r in got if r["doc_id"] is not None and r["doc_id"] != 7 and source[r["doc_id"]] == name)
        assert all(abs(per_shard[s] - total / 8) <= 2 for s in range(8))
    assert interleave.interleaved_shards(documents(rows).where("false")).collect() == []


# Packing


@settings(deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_sum_of_squares_places(lengths):
    lengths = sorted(lengths, reverse=True)
    where, offset, made = packing.sum_of_squares(np.array(lengths, np.int64), 20)
    rows = defaultdict(list)
    for s, w, o in zip(lengths, where.tolist(), offset.tolist(), strict=True):
        rows[w].append((o, s))
    assert len(rows) == made
    for row in rows.values():
        at = 0
        for o, s in sorted(row):
            assert o == at
            at += s
        assert at <= 20
    assert made <= max(1, 2 * math.ceil(sum(lengths) / 20)) or not lengths


def test_packing_takes_the_smallest_sum_of_squares():
    # Open gaps 4, 4 and 2 after 6, 6 and 8 of 10: a 2 closes the gap of 2 (-1) or halves a 4 (2 * (1 - 2) + 2 = 0).
    where, offset, made = packing.sum_of_squares(np.array([8, 6, 6, 2]), 10)
    assert (where.tolist(), offset.tolist(), made) == ([0, 1, 2, 0], [0, 0, 0, 8], 3)


def test_packed_documents(documents):
    rows = [*corpus(7, 40, words=3000), (None, "without an id"), (3, "again"), (3, "again")]
    got = packing.packed(documents(rows), JSON, capacity=256, group_pieces=30).collect()
    library = Tokenizer.from_file(JSON)
    want = Counter()
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= 256 else len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids), 256), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for row in sequences.values():
        at = 0
        for o, n in sorted(row):
            assert o == at
            at += n
        assert at <= 256
    total = sum(n for row in sequences.values() for _, n in row)
    assert len(sequences) <= 1.1 * total / 256 + 4
    assert packing.packed(documents(rows).where("false"), JSON).collect() == []


def test_quoted_added_tokens_have_the_library_s_ids(documents):
    quoted = ["hello <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", " <|endoftext|>'s  ", "<|ENDOFTEXT|> <|endoftext|", "é<|endoftext|>中 <|<|endoftext|>|>"]
    rng = random.Random(14)
    quoted += ["".join(rng.choice(["<|endoftext|>", "<|", "|>", "endoftext", " ", "  ", "\n", "it's", "12", "é"]) for _ in range(30)) for _ in range(100)]
    library, encode = Tokenizer.from_file(JSON), packing.encode_as_file(JSON)
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(quoted)}
    assert all(encode(t) == want[i] for i, t in enumerate(quoted)) and sum(50256 in ids for ids in want.values()) > 50
    for i, r in by_id(packing.packed(documents(list(enumerate(quoted))), JSON)).items():
        ids = np.array([*want[i], 0], "<u4")
        assert (r["length"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


# Embeddings


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_vectors(spark, kind):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 12))
    near = base[rng.integers(0, 12, 120)] + rng.normal(size=(120, 12)) * 0.12
    rows = [(i, list(map(float, v)), "c") for i, v in enumerate(np.concatenate([base, near, base[:10], 3 * base[:5]]))]
    odd = [None, [], [0.0] * 12, [None] + [1.0] * 11, [math.nan] * 12, [math.inf] + [0.0] * 11, [1.0, 0.0], [1.0, 0.0, 0.0], [2.0, 0.0]]
    rows += [(1000 + i, v, "c") for i, v in enumerate(odd)] + [(None, rows[0][1], "c"), (5, rows[5][1], "c")]
    frame = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, cell string").repartition(3)
    got = metric.near_vectors(frame, 0.95).collect()
    width = np.float32 if kind == "float" else np.float64
    usable = [(i, np.array(v, width).astype(float)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    number = [k for k, _ in enumerate(usable)]
    links = [
        (a, b)
        for a in number
        for b in number
        if a < b and len(usable[a][1]) == len(usable[b][1])
        and usable[a][1] @ usable[b][1] / np.linalg.norm(usable[a][1]) / np.linalg.norm(usable[b][1]) >= 0.95
    ]
    degree = Counter(x for link in links for x in link)
    group = smallest(number, links)
    first = {}
    for k in number:
        if usable[k][0] is not None:
            first[group[k]] = min(first.get(group[k], 10**9), usable[k][0])
    want = Counter((usable[k][0], degree[k], first[group[k]], usable[k][0] == first[group[k]] if usable[k][0] is not None else False) for k in number)
    want += Counter((i, 0, i, True) for i, v, _ in rows if not (v and None not in v and np.isfinite(v).all() and any(v)))
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], bool(r["kept"])) for r in got) == want
    assert metric.near_vectors(frame.where("false")).collect() == []


# Quality


def kneser_ney(sequences, symbols):
    """log P(w | u, v) by the textbook definition over trusted sequences of symbols."""
    three = Counter()
    for s in sequences:
        padded = [quality.START, quality.START, *s, quality.END]
        three.update(zip(padded, padded[1:], padded[2:], strict=False))
    three = Counter({k: c for k, c in three.items() if k[2] != quality.REPEAT + quality.REPEATS - 1})
    two = Counter((v, w) for _, v, w in three)
    one = Counter(w for _, w in two)

    def d(counts):
        n = Counter(counts.values())
        if not (n[1] and n[2] and n[3]):
            return (0.5, 0.75, 0.9)
        y = n[1] / (n[1] + 2 * n[2])
        raw = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3])
        return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(raw, 1))

    d1, d2, d3 = d(one), d(two), d(three)

    def level(counts, discount, context, key, lower):
        own = {k: c for k, c in counts.items() if (k[:-1] if isinstance(k, tuple) else ()) == context}
        if not own:
            return lower
        total = sum(own.values())
        rest = sum(discount[min(c, 3) - 1] for c in own.values()) / total
        c = own.get(key, 0)
        return (c - discount[min(c, 3) - 1] if c else 0) / total + rest * lower

    def logp(u, v, w):
        p1 = level(one, d1, (), w, 1 / symbols)
        p2 = level(two, d2, (v,), (v, w), p1)
        return math.log(level(three, d3, (u, v), (u, v, w), p2))

    return logp


def test_perplexities_are_modified_kneser_ney(documents, spark):
    rows = [(i, (t or "")[:600]) for i, t in corpus(8, 50, words=60)]
    trusted = spark.createDataFrame([(i,) for i in range(10, 40)] + [(9999,)], "doc_id bigint")
    frame = documents(rows)
    ids = trusted.where("doc_id < 100")
    words = quality.inventory(frame, ids, 30, 1000)
    counted = Counter(w for i, t in rows if 10 <= i < 40 for w in t.lower().split())
    assert words == [w for w, _ in sorted(counted.items(), key=lambda x: (-x[1], x[0]))[:30]]
    symbols = quality.Symbols(words)
    coded = {i: symbols.encode(t).tolist() for i, t in rows}
    logp = kneser_ney([coded[i] for i in range(10, 40) if i % 4], quality.FIRST_WORD + 30)
    roles = trusted.selectExpr("doc_id", f"if(doc_id % 4 = 0, {quality.HELD_OUT}, {quality.LEARNED}) as role")
    got = by_id(quality.perplexities(frame, roles, words=30, sample=1000, block_words=300))
    for i, _ in rows:
        padded = [quality.START, quality.START, *coded[i], quality.END]
        sums = -sum(logp(*x) for x in zip(padded, padded[1:], padded[2:], strict=False))
        assert got[i]["n_words"] == len(coded[i]) and got[i]["role"] == (0 if not 10 <= i < 40 else 1 if i % 4 else 2)
        assert math.isclose(got[i]["log_perplexity"], sums / (len(coded[i]) + 1), rel_tol=1e-9)


def test_repeats_have_symbols_of_their_own():
    symbols = quality.Symbols(["the", "of"])
    repeat, last = quality.REPEAT, quality.REPEAT + quality.REPEATS - 1
    the, of = quality.FIRST_WORD, quality.FIRST_WORD + 1
    assert symbols.encode("The the THE the the the the of of").tolist() == [the, repeat, repeat + 1, repeat + 2, last, last, last, of, repeat]
    assert symbols.encode("").tolist() == [] and symbols.encode("the").tolist() == [the]


def test_quality_rejects_what_is_unlike_trusted_text(documents, spark):
    rng = random.Random(4)
    plain = lambda: " ".join(rng.choice(["the", "of", "a", "sea", "and", "wind", "turns"]) for _ in range(60))
    rows = [(i, plain(), "en", "a") for i in range(80)]
    rows += [(100, "$$%% " * 60, "en", "a"), (101, "wind " * 80, "en", "a"), (102, "$$%% " * 60, "xx", "a"), (103, None, "en", "a"), (104, "", None, "a"), (None, plain(), "en", "a"), (105, "x" * 3000, "fr", "a")]
    trusted = spark.createDataFrame([(i,) for i in range(0, 80, 2)] + [(None,)], "doc_id bigint")
    got = quality.quality(documents(rows), trusted, words=20).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"] for r in got if not r["kept"]} == {100, 101}
    nobody = quality.quality(documents(rows), trusted.where("doc_id < 0"), words=20).collect()
    assert len(nobody) == len(rows) and all(r["kept"] for r in nobody)
    assert quality.quality(documents(rows).where("false"), trusted).collect() == []


def test_shuffled_and_scrambled_trusted_text_is_worse(documents, spark):
    rng = random.Random(11)
    # Far more words than a closed inventory of the frequent ones would hold, in phrases that recur.
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    phrases = [[rng.choice(words) for _ in range(6)] for _ in range(150)]
    text = lambda: [w for _ in range(15) for w in rng.choice(phrases)]
    plain = [text() for _ in range(300)]
    others = [text() for _ in range(20)]
    shuffled = [rng.sample(t, len(t)) for t in others]
    scrambled = [["".join(rng.choice("abcdefghij") for _ in w) for w in t] for t in others]
    rows = list(enumerate(" ".join(t) for t in [*plain, *others, *shuffled, *scrambled]))
    trusted = spark.createDataFrame([(i,) for i in range(300)], "doc_id bigint")
    got = by_id(quality.quality(documents(rows), trusted, block_words=5000))
    as_is, mixed, random_ = ([got[i] for i in range(a, a + 20)] for a in (300, 320, 340))
    assert all(r["kept"] for r in as_is) and not any(r["kept"] for r in mixed + random_)
    for a, b, c in zip(as_is, mixed, random_, strict=True):
        assert 3 * a["perplexity"] < min(b["perplexity"], c["perplexity"])


def test_open_vocabulary_is_modified_kneser_ney(documents, spark):
    rows = [(i, (t or "")[:600]) for i, t in corpus(12, 50, words=60)]
    roles = spark.createDataFrame([(i, quality.LEARNED) for i in range(10, 40)], "doc_id bigint, role int")
    learned = {w for i, t in rows if 10 <= i < 40 for w in t.lower().split()}
    symbols = quality.Symbols(sorted(learned))
    coded = {i: symbols.encode(t).tolist() for i, t in rows}
    logp = kneser_ney([coded[i] for i in range(10, 40)], quality.FIRST_WORD + len(learned))
    got = by_id(quality.perplexities(documents(rows), roles, block_words=300))
    for i, _ in rows:
        padded = [quality.START, quality.START, *coded[i], quality.END]
        sums = -sum(logp(*x) for x in zip(padded, padded[1:], padded[2:], strict=False))
        assert math.isclose(got[i]["log_perplexity"], sums / (len(coded[i]) + 1), rel_tol=1e-9)


def test_parts_and_shards_change_nothing_and_leave_nothing(documents, spark, monkeypatch):
    rows = [*((i, (t or "")[:600]) for i, t in corpus(13, 50, words=60)), (20, "again and again"), (20, "again and again"), (None, "a b c")]
    roles = spark.createDataFrame([(i, quality.LEARNED if i % 3 else quality.HELD_OUT) for i in range(10, 40)], "doc_id bigint, role int")
    told = []
    for parts, shard in ((1, 16 << 20), (5, 500)):
        monkeypatch.setattr(quality, "PARTS", parts)
        monkeypatch.setattr(quality, "SHARD", shard)
        with session.recorded() as written:
            got = quality.perplexities(documents(rows), roles, block_words=300)
        assert len(written) == 1 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
        told.append(sorted((r["doc_id"] is None, r["doc_id"], r["role"], r["n_words"], round(r["log_perplexity"], 9)) for r in got.collect()))
        session.forget(spark, written)
    assert told[0] == told[1] and len(told[0]) == len(rows)


@given(st.lists(st.lists(st.integers(0, 2**62) | st.integers(0, 300), min_size=3, max_size=3), min_size=1, max_size=4))
def test_packed_numbers(rows):
    assert quality.unpacked(quality.packed(np.array(rows, np.int64))).tolist() == rows


# Licenses


def best_place(template, words):
    """Matches of the best local alignment without a band, by the plain recurrence."""
    best, above = (0, 0), [(0, 0)] * (len(words) + 1)
    for t in template:
        row = [(0, 0)]
        for j, w in enumerate(words, 1):
            diagonal = (above[j - 1][0] + (2 if t == w else -1), above[j - 1][1] + (t == w))
            cell = max(diagonal, (above[j][0] - 1, above[j][1]), (row[j - 1][0] - 1, row[j - 1][1]), key=lambda c: c[0])
            row.append(cell if cell[0] > 0 else (0, 0))
            best = max(best, row[j])
        above = row
    return best[1]


def test_license_spans(documents):
    rng = random.Random(5)
    noise = lambda n: " ".join(rng.choice(["sea", "the", "License", "to", "copy", "héron"]) for _ in range(n))
    rows, want = list(enumerate(ODD)), set()
    for doc_id, (name, text) in enumerate([*licenses.TEMPLATES.items()] * 3, 100):
        words = text.split()
        if doc_id % 3 == 0 and len(words) > 20:
            words[7] = "changed"
            del words[15]
        rows.append((doc_id, f"{noise(rng.randrange(60))}\n{' '.join(words).upper() if doc_id % 2 else ' '.join(words)} {noise(9)}"))
        want.add((doc_id, name))
    got = licenses.license_spans(documents(rows)).collect()
    texts = dict(rows)
    assert {(r["doc_id"], r["license"]) for r in got} >= want
    assert not {r["doc_id"] for r in got} - {d for d, _ in want}

    def hashed(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return licenses.words_of(data, np.array([0, len(data)])).hash.tolist()

    for r in got:
        template = hashed(licenses.TEMPLATES[r["license"]])
        assert r["template_words"] == len(template) and r["coverage"] == r["matched_words"] / len(template) >= 0.75
        assert best_place(template, hashed(texts[r["doc_id"]])) == r["matched_words"]
        assert best_place(template, hashed(texts[r["doc_id"]][r["start"] : r["end"]])) == r["matched_words"]
    for doc_id, text in rows:
        for name, template in licenses.TEMPLATES.items():
            # Whole texts of the same family differ by paragraphs, which are wider than the band.
            if name in licenses.WHOLE and (doc_id, name) not in want:
                continue
            if best_place(hashed(template), hashed(text or "")) >= 0.75 * len(hashed(template)):
                assert (doc_id, name) in {(r["doc_id"], r["license"]) for r in got}
    assert licenses.license_spans(documents(rows).where("false")).collect() == []


def test_adjacent_copies_are_a_row_each(documents):
    rows, want = [], {}
    for name, text in licenses.TEMPLATES.items():
        for n in (1, 2, 3, 7):
            want[len(rows)] = (name, n, len(text))
            rows.append((len(rows), "sea wind " + " ".join([text] * n) + " sea wind"))
    found = defaultdict(list)
    for r in licenses.license_spans(documents(rows)).collect():
        if r["license"] == want[r["doc_id"]][0]:
            found[r["doc_id"]].append((r["coverage"], r["start"]))
    for doc_id, (name, n, length) in want.items():
        assert sorted(found[doc_id]) == [(1.0, 9 + k * (length + 1)) for k in range(n)], (name, n)


def test_very_many_notices_take_time_in_proportion(documents):
    """Four times the notices, in one text and on one line each, take about four times as long."""
    notice = licenses.TEMPLATES["All rights reserved"]

    def seconds(n):
        began = time.time()
        found = licenses.license_spans(documents([(1, "\n".join([notice] * n))], slices=1)).count()
        assert found == n
        return time.time() - began

    seconds(10)
    few, many = seconds(5000), seconds(20000)
    assert many < 8 * few + 2


def test_whole_texts_with_edits(documents):
    rows = []
    for doc_id, (name, text) in enumerate(licenses.WHOLE.items()):
        words = text.split()
        words[30:33] = ["other"]
        rows.append((doc_id, "Copyright 2020 A. Person\n" + " ".join(words) + "\n\nsea wind"))
    found = {(r["doc_id"], r["license"]) for r in licenses.license_spans(documents(rows)).collect()}
    assert found >= set(enumerate(licenses.WHOLE))


def test_one_changed_word_does_not_hide_a_short_notice(documents):
    rows, want = [], []
    for name, text in licenses.TEMPLATES.items():
        data = np.frombuffer(text.encode(), np.uint8)
        words = licenses.words_of(data, np.array([0, len(data)]))
        n = len(words.hash)
        for k in range(n) if 4 <= n <= 20 else ():
            changed = text[: words.start[k]] + "changed" + text[words.end[k] :]
            rows.append((len(rows), f"sea wind {changed} sea wind"))
            # A place ends with words that match, so one at the end is left out.
            want.append((len(rows) - 1, name, n - 1))
    got = {(r["doc_id"], r["license"], r["matched_words"]) for r in licenses.license_spans(documents(rows)).collect()}
    assert len(want) > 25 and got >= set(want)


# Words


@settings(deadline=None)
@given(st.lists(st.text("aB é\n\t\x0b", max_size=20), max_size=8))
def test_words_of_many_texts(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    words = Words(LOWER[data], np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    known = {}
    for k, text in enumerate(texts):
        a, b = words.of_doc[k], words.of_doc[k + 1]
        own = [data[s:e].tobytes() for s, e in zip(words.start[a:b], words.end[a:b], strict=True)]
        assert own == word_list(text)
        for w, h in zip(own, words.hash[a:b].tolist(), strict=True):
            assert known.setdefault(w.replace(b"B", b"b"), h) == h
    assert len(set(known.values())) == len(known)


def test_vocabulary_file_is_read_as_the_library_does():
    encode, library = packing.encoder(JSON).encode_ordinary, Tokenizer.from_file(JSON)
    for text in [t or "" for t in ODD] + [t or "" for _, t in corpus(9, 60)]:
        assert encode(text) == library.encode(text, add_special_tokens=False).ids
