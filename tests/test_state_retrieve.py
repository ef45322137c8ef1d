"""Actions applied to a state, and passages cut to tokens."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest

from maskline.operators import retrieve, state

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def tables(spark):
    declared = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "c", 7), (4, "d", 8)], "id int, name string, n int")
    actual = spark.createDataFrame([(1, "a", 5, "k1"), (2, "x", 6, "k2"), (4, None, 8, "k4"), (9, "z", 0, "k9")], "id int, name string, n int, own string")
    return declared, actual


def test_right_actions_leave_nothing_to_do(spark):
    declared, actual = tables(spark)
    actions = state.conditional_upsert(declared, actual, ["id"], ["name", "n"])
    after = state.apply_actions(declared, actual, actions, ["id"], ["name", "n"])
    assert rows_of(after) == sorted([(1, "a", 5, "k1"), (2, "b", None, "k2"), (3, "c", 7, None), (4, "d", 8, "k4"), (9, "z", 0, "k9")], key=str)
    assert state.second_run_is_noop(declared, actual, ["id"], ["name", "n"]).collect() == []


def test_broken_actions_show_in_the_second_run(spark):
    declared, actual = tables(spark)
    keys, fields = ["id"], ["name", "n"]
    run = lambda *actions: {r.id: r.action for r in state.second_run_is_noop(declared, actual, keys, fields, spark.createDataFrame(actions, "id int, action string")).collect()}
    right = [(1, "unchanged"), (2, "updated"), (3, "created"), (4, "updated")]
    assert run(*right) == {}
    for i, (key, action) in enumerate(right[1:], 1):
        lost = [a for k, a in enumerate(right) if k != i]
        assert run(*lost) == {key: action}  # not done
        assert run(*lost, (key, "unchanged")) == {key: action}  # not seen
    assert run(*right[:2], (3, "updated"), right[3]) == {3: "created"}  # an update of what isn't there
    assert run(right[0], (2, "created"), *right[2:]) == {}  # written over
    # An action on the wrong field: only name is written.
    after = state.apply_actions(declared, actual, spark.createDataFrame(right, "id int, action string"), keys, ["name"])
    assert {r.id for r in state.conditional_upsert(declared, after, keys, fields).where("action <> 'unchanged'").collect()} == {2}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_passages_fit_in_tokens(spark, tokenizer):
    rng = random.Random(7)
    pieces = ["word", " the", "été", "中文", "𝄞", "👩‍👩‍👧", "\n\n", "   ", "'s", "1234567", "antidisestablishmentarianism", "<|endoftext|>", "a" * 90, "\t", ".", " x"]
    pairs = [(i, "".join(rng.choices(pieces, k=rng.randint(0, 12))), "".join(rng.choices(pieces, k=rng.randint(0, 80))), "kept") for i in range(300)]
    pairs += [(1000, None, "some text", "kept"), (1001, "q", None, "kept"), (1002, "q " * 50, "text", "kept"), (1003, "", "x " * 30000, "kept")]
    budget, special = 40, 3
    table = spark.createDataFrame(pairs, "id long, query string, text string, n string").repartition(3)
    got = {r.id: r for r in retrieve.truncate_pairs_to_tokens(table, VOCABULARY, budget, special).collect()}
    assert len(got) == len(pairs)
    size = lambda text: len(tokenizer.encode(text, add_special_tokens=False))
    exact = 0
    for i, query, text, _ in pairs:
        row, asked = got[i], size(query or "")
        assert (row.query, row.n) == (query, "kept")
        if text is None:
            assert row.text is None and row.n_tokens == asked + special
            continue
        assert text.startswith(row.text) and row.n_tokens == asked + size(row.text) + special
        assert row.n_tokens <= budget or row.text == ""
        room = max(0, budget - special - asked)
        if size(text) <= room:
            assert row.text == text
        elif room:
            # What the library keeps, unless it ends within a letter or reads otherwise by itself.
            library = text[: tokenizer.encode(text, add_special_tokens=False).offsets[room - 1][1]]
            assert len(row.text) <= len(library)
            if size(library) <= room:
                assert row.text == library
                exact += 1
    assert exact > 100
    assert retrieve.truncate_pairs_to_tokens(table.limit(0), VOCABULARY).collect() == []


def odd_candidates(n):
    rng = random.Random(11)
    scores = [None, math.nan, math.inf, -math.inf, 0.0, 0.5, 1.0, 2.0]
    # Queries in turn, one of them without an id, and one that has most rows; a passage that has none.
    return [(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice(scores), None if i == 7 else i) for i in range(n)] + [(9, 1.0, 1)]


def test_first_candidates_in_the_order_of_spark(spark):
    rows = [(q, p, s) for q, s, p in odd_candidates(3000)]
    table = spark.createDataFrame(rows, "query_id long, passage_id long, score double").repartition(3).cache()
    wanted = table.selectExpr("*", "row_number() over (partition by query_id order by score desc, passage_id) as rank").where("rank <= 4")
    told = lambda df: sorted(map(str, df.collect()))  # noqa: E731 - a score that is no number equals none
    assert told(retrieve.rerank(table, 4)) == told(wanted)
    assert retrieve.rerank(table, 0).collect() == []
    # Columns that Arrow doesn't order as Spark does go another way.
    listed = table.selectExpr("query_id", "passage_id", "score", "array(1) as more")
    assert told(retrieve.rerank(listed, 4).drop("more")) == told(wanted)
    table.unpersist()


@pytest.mark.parametrize("held", [1 << 20, 1000])
def test_a_task_hands_on_only_the_first_candidates(monkeypatch, held):
    monkeypatch.setattr(retrieve, "PIECE", 64)
    monkeypatch.setattr(retrieve, "HELD", held)
    rng = random.Random(3)
    rows = [(q, p, rng.randint(0, 5)) for p in range(2000) for q in range(4)]
    parts = [pa.RecordBatch.from_pylist([dict(zip(("query_id", "passage_id", "score"), r, strict=True)) for r in rows[at : at + 50]]) for at in range(0, len(rows), 50)]
    left = [tuple(r.values()) for part in retrieve._first(iter([*parts, parts[0].slice(0, 0)]), 5) for r in part.to_pylist()]
    best = {r for q in range(4) for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))[:5]}
    assert best <= set(left) and len(left) == len(set(left)) < len(rows)
    if held > 1000:
        assert Counter(r[0] for r in left) == dict.fromkeys(range(4), 5)
    assert list(retrieve._first(iter([]), 5)) == []


@pytest.mark.parametrize("whole", [4_000_000, 400])
def test_ranks_of_all_candidates(spark, monkeypatch, whole):
    monkeypatch.setattr(retrieve, "WHOLE", whole)  # one of the queries has more than 400
    rows = [(q, p, s) for q, s, p in odd_candidates(1000)]
    table = spark.createDataFrame(rows, "query_id long, passage_id long, score double").repartition(3).cache()
    wanted = table.selectExpr("*", "cast(row_number() over (partition by query_id order by -score, passage_id) as bigint) as rank")
    told = lambda df: sorted(map(str, df.collect()))  # noqa: E731 - a score that is no number equals none
    assert told(retrieve.rerank(table)) == told(wanted) and retrieve.rerank(table).schema["rank"].dataType == wanted.schema["rank"].dataType
    table.unpersist()


def test_candidates_of_a_query_are_ranked_where_they_are(spark):
    vectors = spark.range(2000).selectExpr("id as vec_id", "cast(id % 3 as int) as label", "array(cast(id as float), 1.0f) as embedding")
    from suite import jobs

    pairs = jobs.candidates(lambda name: vectors)
    assert pairs.count() == 100 * 1999
    plan = retrieve.rerank(pairs)._jdf.queryExecution().executedPlan().toString()
    # The queries once, and what all tasks get; no pair is moved.
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan and "Window" in plan
    assert plan.index("Exchange hashpartitioning") > plan.index("BroadcastNestedLoopJoin")
