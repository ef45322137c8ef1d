"""Plans that must hold at scale: narrow detection, limits before the shuffle, pruned scans, no cartesian products."""

from pyspark.sql import functions as F

from maskline import schemas
from maskline.operators import detect, evaluate, jobs, mask, retrieve, spans, usage
from maskline.plans import masking
from maskline.sources import files
from suite import jobs as cross

SPANS = "doc_id long, entity_type string, start int, end int, score double, value string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def written(spark, tmp_path, name, rows, schema):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.read.parquet(path)


def test_detection_reads_and_searches_without_a_shuffle(spark, tmp_path):
    docs = written(spark, tmp_path, "docs", [(1, "fr", "x", "unused")], "doc_id long, lang string, text string, other string")
    p = plan(detect.detect_all(docs, entities=["EMAIL_ADDRESS", "IBAN_CODE"]))
    assert "Exchange" not in p and "other" not in p and "ArrowEvalPython" not in p


def test_merging_shuffles_once(spark, tmp_path):
    found = written(spark, tmp_path, "spans", [(1, "PERSON", 0, 2, 0.5, "ab")], SPANS)
    assert plan(spans.merge_overlaps(found)).count("Exchange") == 1


def test_overlap_tests_and_scores_have_no_pairs(spark, tmp_path):
    found = written(spark, tmp_path, "spans", [(1, "PERSON", 0, 2, 0.5, "ab")], SPANS)
    p = plan(evaluate.scores_per_type(found, found))
    assert "Join" not in p and "Cartesian" not in p
    assert "NestedLoop" not in plan(evaluate.match_spans(found, found))


def test_failures_and_top_k_are_limited_before_the_shuffle(spark, tmp_path):
    attempts = written(spark, tmp_path, "attempts", [], schemas.ATTEMPT)
    assert "WindowGroupLimit" in plan(jobs.job_ends(jobs.classify_outcome(attempts)))
    candidates = written(spark, tmp_path, "candidates", [], "query_id long, passage_id long, score double")
    assert "WindowGroupLimit" in plan(retrieve.rerank(candidates, 5))


def test_candidates_are_cut_to_the_first_before_they_are_sorted(spark, tmp_path):
    candidates = written(spark, tmp_path, "candidates", [], "query_id long, passage_id long, score double")
    p = plan(retrieve.rerank(candidates, 5))
    assert p.rindex("Sort") < p.index("MapInArrow")


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "observations")
    files.write_observations(spark.createDataFrame([], schemas.OBSERVATION), path)
    spark.createDataFrame([("f", "t", "n", "GENERATION", "f", "a", 1, 1, None, 0.1, "DEFAULT", None)], schemas.OBSERVATION).write.mode("append").partitionBy("project").parquet(path)
    p = plan(files.read_observations(spark, path, ["trace_id"], project="f", alias="a"))
    assert "PartitionFilters: [isnotnull(project" in p and "EqualTo(alias,a)" in p and "latency" not in p


def test_calls_are_not_shuffled_for_their_price(spark, tmp_path):
    calls = written(spark, tmp_path, "calls", [], "call_id long, alias string, tokens_in long, tokens_out long, ts timestamp")
    prices = spark.sql("SELECT * FROM VALUES ('a', 0.1, 0.2) AS p(alias, price_in, price_out)")
    p = plan(usage.price_calls(calls, prices))
    assert "BroadcastHashJoin" in p and "Exchange hashpartitioning" not in p
    history = spark.sql("SELECT * FROM VALUES ('a', timestamp '2024-01-01', 0.1, 0.2) AS p(alias, valid_from, price_in, price_out)")
    assert "SortMergeJoin" not in plan(usage.price_as_of(calls, history))


def test_answers_meet_their_markers_on_both_keys(spark, tmp_path):
    answers = written(spark, tmp_path, "answers", [], "answer_id long, conv_id long, text string")
    markers = written(spark, tmp_path, "markers", [], "conv_id long, marker string, value string")
    assert "Cartesian" not in plan(mask.unmask_answers(answers, markers).select(F.col("unmasked_text")))


def test_message_spans_are_shuffled_once(spark, tmp_path):
    messages = written(spark, tmp_path, "messages", [(1, 1, "x")], "conv_id long, turn long, text string")
    p = plan(masking.message_spans(messages))
    assert p.count("Exchange hashpartitioning") == 1
    names = spark.sql("SELECT * FROM VALUES ('Jean') AS n(name)")
    policy = spark.sql("SELECT * FROM VALUES ('EMAIL_ADDRESS', 'MASK', 0.4D), ('IP_ADDRESS', 'KEEP', 0.4D) AS p(entity_type, action, threshold)")
    masked, markers = masking.mask_conversations(
        spark.createDataFrame([(1, 1, "jo@site.ai, 10.1.2.3, Jean")], "conv_id long, turn long, text string"), names, policy=policy
    )
    assert [r.masked_text for r in masked.collect()] == ["<EMAIL_ADDRESS_1>, 10.1.2.3, Jean"] and markers.count() == 1


def test_pairs_of_many_vectors_are_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    """Vectors too many to send: parts of the queries by parts of the others, not every query's share by every part."""
    monkeypatch.setattr(cross, "SENT", 0)
    monkeypatch.setattr(cross, "PAIRS_A_TASK", 100)
    vectors = spark.range(200).select(F.col("id").alias("vec_id"), F.lit(1).alias("label")).repartition(8, "vec_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = cross.paired(*cross.sides(vectors, "vec_id", "label"), 4, 32)
        assert pairs.rdd.getNumPartitions() <= 24
        assert sorted((r.q_vec_id, r.p_vec_id) for r in pairs.collect()) == [(q, p) for q in range(0, 200, 20) for p in range(200) if p != q]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
