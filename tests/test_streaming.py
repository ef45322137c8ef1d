"""Streams over several micro-batches: state, timers, late and repeated rows."""

import os
import random
import time
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from maskline import schemas
from maskline.operators import jobs as j
from maskline import session
from maskline.operators import limits
from maskline.plans.masking import mask_conversations
from maskline.streaming import jobs as sj
from maskline.streaming import late as sd
from maskline.streaming import limits as sl
from maskline.streaming import masking as sm

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def batches(spark, folder, schema, *rows):
    """One file per micro-batch, in order."""
    os.makedirs(folder)  # with its parents
    for i, some in enumerate(rows):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)  # the file source orders by modification time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(spark, stream, tmp_path, name):
    out = str(tmp_path / name)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).collect()


def test_job_lifecycle_over_batches(spark, tmp_path):
    row = lambda *r: (*r, None, None)
    first = [row(1, 1, at(0), 500), row(2, 2, at(1), 429), row(3, 3, at(2), 403), row(4, 4, at(2), None), (5, 11, at(2), 429, None, "50"), (6, 12, at(2), 429, "2024-01-01 00:00:32 UTC", "1")]
    second = [row(1, 5, at(10), 503), row(2, 6, at(11), 200), row(3, 7, at(12), 200)]
    third = [row(1, 8, at(20), 408), row(1, 9, at(21), 200)]
    # The watermark is a minute behind: at 41 s after this, when job 6 is due and job 5 is not.
    fourth = [row(8, 13, at(101), 200)]
    later = [row(9, 10, at(90000), 200)]
    between = [row(9, 16, at(150000), 200)]
    last = [row(4, 14, at(180000), 503), row(10, 15, at(200000), 200)]
    stream = sj.job_lifecycle_stream(batches(spark, tmp_path / "in", schemas.ATTEMPT, first, second, third, fourth, later, between, last), late="1 minute")
    rows = drain(spark, stream, tmp_path, "out")
    ended = {r.job_id: (r.state, r.attempts, r.failures, r.backoffs) for r in rows if r.state != "due"}
    assert ended == {1: ("dead", 3, 3, 0), 2: ("done", 2, 0, 1), 3: ("dead", 1, 0, 0), 8: ("done", 1, 0, 0), 9: ("done", 1, 0, 0), 10: ("done", 1, 0, 0)}
    # Jobs whose next attempt is due when event time has passed; job 4 is forgotten after that, and starts anew.
    due = [(r.job_id, r.failures, r.at.timestamp() - T0.timestamp()) for r in rows if r.state == "due"]
    assert sorted((j, f) for j, f, _ in due) == [(4, 1), (4, 1), (5, 0), (6, 0)]
    assert {j: seconds <= 41 for j, _, seconds in due if j in (5, 6)} == {5: False, 6: True}


def test_answers_are_joined_in_order_and_sent_once(spark, tmp_path):
    first = [(1, 5, 2, "ON_1>", False, at(0)), (1, 5, 0, "Bonjour ", False, at(0)), (2, 5, 0, "never ends <PERSON_1>", False, at(0))]
    second = [(1, 5, 1, "<PERS", False, at(1)), (1, 5, 0, "Bonjour ", False, at(1)), (1, 5, 3, " !", True, at(2))]
    later = [(3, 6, 0, "x", True, at(90000))]
    chunks = batches(spark, tmp_path / "in", schemas.CHUNK, first, second, later)
    markers = spark.createDataFrame([(5, "<PERSON_1>", "Luc")], "conv_id long, marker string, value string")
    out = str(tmp_path / "answers")
    sm.unmask_stream(chunks, markers, out, str(tmp_path / "check"), availableNow=True).awaitTermination()
    found = {r.answer_id: (r.unmasked_text, r.complete) for r in spark.read.parquet(out).collect()}
    assert found == {1: ("Bonjour Luc !", True), 2: ("never ends Luc", False), 3: ("x", True)}


def test_limits_keep_their_state_between_batches(spark, tmp_path):
    one = Decimal("1.0000000000")
    call = lambda i, seconds, team, alias="x", provider="p": (i, at(seconds), team, alias, provider, 9, 1, one)
    first = [call(3, 2, "a", "y"), call(1, 0, "a"), call(2, 1, "a"), call(10, 3, None)]
    second = [call(6, 63, "a"), call(4, 61, "a"), call(5, 62, "b"), call(11, 1, "b"), call(12, 64, "zz", "x", None)]
    third = [call(7, 3 * 86400, "a"), call(8, 3 * 86400 + 1, "b"), call(9, 3 * 86400 + 2, "b")]
    teams = spark.createDataFrame([("a", Decimal("2"), 2, 1000), ("b", None, 9, 1000)], "team_id string, max_budget decimal(18,6), rpm_limit int, tpm_limit int")
    access = spark.createDataFrame([("a", "x"), ("b", "x"), ("zz", "x")], "team_id string, alias string")
    caps = spark.createDataFrame([("p", Decimal("2.5"))], "provider string, cap decimal(18,6)")
    calls = batches(spark, tmp_path / "in", schemas.CALL, first, second, third)
    out = str(tmp_path / "out")
    sl.limits_stream(calls, teams, access, caps, out, str(tmp_path / "check"), days=2, availableNow=True).awaitTermination()
    assert {r.call_id: r.reason for r in spark.read.parquet(f"{out}/decisions").collect()} == {
        1: "accepted", 2: "accepted", 3: "access", 10: "access", 4: "budget", 5: "accepted", 6: "budget", 12: "accepted",
        7: "accepted", 8: "accepted", 9: "accepted",
    }
    assert [r.call_id for r in spark.read.parquet(f"{out}/late").collect()] == [11]


def test_limits_over_batches_equal_the_batch_answer(spark, tmp_path):
    rng = random.Random(8)
    seconds, rows = 0, []
    for i in range(900):
        seconds += rng.choice([0, 1, 5, 40, 900])
        rows.append((i, at(seconds), rng.choice(["a", "a", "a", "b", None]), rng.choice("xy"), rng.choice(["p", "q", None]), rng.randrange(90), 5, Decimal(rng.randrange(900)) / 10**6))
    teams = spark.createDataFrame([("a", Decimal("0.02"), 4, 250), ("b", Decimal("0.03"), None, 90)], "team_id string, max_budget decimal(18,6), rpm_limit int, tpm_limit int")
    access = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "team_id string, alias string")
    caps = spark.createDataFrame([("p", Decimal("0.015"))], "provider string, cap decimal(18,6)")
    parts = [rows[a:b] for a, b in ((0, 200), (200, 210), (210, 600), (600, 900))]
    calls = batches(spark, tmp_path / "in", schemas.CALL, *[rng.sample(p, len(p)) for p in parts])
    out = str(tmp_path / "out")
    sl.limits_stream(calls, teams, access, caps, out, str(tmp_path / "check"), days=1, availableNow=True).awaitTermination()
    found = {r.call_id: (r.decision, r.reason) for r in spark.read.parquet(f"{out}/decisions").collect()}
    whole = limits.admission(spark.createDataFrame(rows, schemas.CALL), teams, access, caps, 1).collect()
    assert found == {r.call_id: (r.decision, r.reason) for r in whole} and len(found) == 900
    assert {why for _, why in found.values()} == {"access", "rate", "budget", "provider cap", "accepted"}


@pytest.mark.parametrize(
    ("status", "expected"),
    [(200, "done"), (400, "dead"), (401, "dead"), (403, "dead"), (408, "retry"), (429, "backoff"), (500, "retry"), (304, "dead"), (100, "dead"), (503, "retry"), (None, "retry")],
)
def test_outcome(spark, status, expected):
    df = spark.createDataFrame([(status,)], "status int")
    assert j.classify_outcome(df).first().outcome == expected


def test_backoff(spark):
    now = datetime(2031, 2, 3, 4, 5, 6)
    rows = [
        (1, 1, now, "2031-02-03 04:05:51 UTC", "7", 45.0), (1, 2, now, "2031-02-03 04:05:01 UTC", None, 1.0), (1, 3, now, None, "23.5", 23.5),
        (1, 4, now, None, "900", 60.0), (1, 5, now, None, None, 10.0), (1, 6, now, "tomorrow", "a while", 10.0), (1, 7, now, None, "0.2", 1.0),
    ]
    df = spark.createDataFrame(rows, "job_id long, attempt_id long, ts timestamp, reset_at string, retry_after string, expected double")
    assert all(r.wait == pytest.approx(r.expected) for r in j.backoff_seconds(df, jitter=0).collect())
    assert all(0 <= r.wait - r.expected <= 2 for r in j.backoff_seconds(df).collect())


def test_one_job_with_most_attempts(spark):
    """Twenty thousand back-offs of one job are counted, and its third failure still ends it."""
    rows = [(1, i, at(i), 429, None, None) for i in range(20000)] + [(1, 20000 + i, at(20000 + i), 500, None, None) for i in range(5)] + [(2, 1, at(0), 200, None, None)]
    df = spark.createDataFrame(rows, schemas.ATTEMPT).repartition(8)
    found = {r.job_id: (r.attempts, r.failures, r.backoffs, r.state) for r in j.job_lifecycle(df).collect()}
    assert found == {1: (20003, 3, 20000, "dead"), 2: (1, 0, 0, "done")}


# Masking a live stream of messages

MESSAGE = "conv_id long, turn int, text string, ts timestamp, channel string"


def names(spark):
    return spark.createDataFrame([(n,) for n in ("Paul", "Luc", "Anne")], "name string")


def masked_stream(spark, tmp_path, *parts, **options):
    out = str(tmp_path / "masked")
    stream = batches(spark, tmp_path / "in", MESSAGE, *parts)
    sm.mask_stream(stream, names(spark), out, str(tmp_path / "check"), availableNow=True, **options).awaitTermination()
    rows = lambda name: spark.read.parquet(f"{out}/{name}").drop("batch").collect()
    return out, rows


def test_masked_stream_equals_the_batch_answer(spark, tmp_path):
    rng = random.Random(11)
    people = [f"M. {a} {b}" for a in ("Paul", "Luc", "Anne") for b in ("Martin", "Durand", "Petit")]
    talks = []
    for conv_id in (*range(12), None):
        for turn in range(rng.randint(1, 30 if conv_id == 3 else 7)):
            parts = [rng.choice([*people, "m@example.com", "x.y@example.org", "06 12 34 56 78", "rien"]) for _ in range(rng.randint(0, 4))]
            talks.append((conv_id, turn, None if rng.random() < 0.05 else " puis ".join(parts), at(turn * 60), "web"))
    ends = [0, 1, 2, 5, 9, 40]
    steps = [rng.sample(p, len(p)) for p in ([r for r in talks if a <= r[1] < b] for a, b in zip(ends[:-1], ends[1:], strict=True))]
    left = lambda: [f for f in os.listdir(session.shared_folder(spark).removeprefix("file:")) if f.startswith("maskline-")]
    before = left()
    out, rows = masked_stream(spark, tmp_path, *steps, compact=2)
    assert left() == before
    known = spark.createDataFrame([r for r in talks if r[0] is not None], MESSAGE)
    want, markers = mask_conversations(known, names(spark))
    assert {(r.conv_id, r.turn): (r.text, r.ts, r.channel, r.masked_text) for r in rows("masked")} == {
        (r.conv_id, r.turn): (r.text, r.ts, r.channel, r.masked_text) for r in want.collect()
    }
    assert sorted((r.conv_id, r.value, r.marker, r.n) for r in rows("markers")) == sorted((r.conv_id, r.value, r.marker, r.n) for r in markers.collect())
    assert len(rows("masked")) + len(rows("bad")) + len(rows("late")) == len(talks) and len(rows("bad")) >= 1
    # State: what was before the last two bases is gone.
    assert sorted(os.listdir(f"{out}/state/talks")) == ["batch=2", "batch=3", "batch=4"]


def test_masked_conversations_are_forgotten(spark, tmp_path):
    say = lambda conv_id, turn, text, hours: (conv_id, turn, text, at(3600 * hours), "web")
    out, rows = masked_stream(
        spark, tmp_path,
        [say(1, 0, "M. Paul Martin", 0), say(2, 0, "M. Luc Petit et M. Paul Martin", 0)],
        [say(2, 1, "M. Paul Martin", 20)],
        [say(1, 1, "M. Luc Petit", 30), say(2, 2, "M. Anne Durand", 41)],
        [say(1, 2, "M. Paul Martin", 2), say(1, 3, "M. Paul Martin", 42), say(2, 2, "M. Anne Durand", 42)],
        [say(3, 0, "x", 200)],
        [say(2, 9, "M. Luc Petit", 201)],
        keep="24 hours", compact=2,
    )
    found = sorted((r.conv_id, r.turn, r.masked_text) for r in rows("masked"))
    # Conversation 1 was silent for longer than the first horizon allows only once it came back at hour 30: then the
    # horizon was hour 20, so it went on.
    assert found == [
        (1, 0, "M. <PERSON_1>"), (1, 1, "M. <PERSON_2>"), (1, 3, "M. <PERSON_1>"),
        (2, 0, "M. <PERSON_1> et M. <PERSON_2>"), (2, 1, "M. <PERSON_2>"), (2, 2, "M. <PERSON_3>"), (2, 2, "M. <PERSON_3>"), (2, 9, "M. <PERSON_1>"),
        (3, 0, "x"),
    ]
    assert [(r.conv_id, r.turn) for r in rows("late")] == [(1, 2)]
    alive = spark.read.parquet(f"{out}/state/base_talks/batch=6").collect()
    assert sorted((r.conv_id, r.life, r.numbered) for r in alive) == [(2, 5, 1), (3, 4, 0)]
    assert [r.value for r in spark.read.parquet(f"{out}/state/base_markers/batch=6").collect()] == ["Luc Petit"]


# Late and bad rows


def dealt(spark, tmp_path, schema, late, *parts, ts="ts", required=()):
    """What the ledger gives of some micro-batches, and the rows of its tables."""
    out = str(tmp_path / "ledger")
    sd.sort_out(batches(spark, tmp_path / "raw", schema, *parts), ts, late, out, str(tmp_path / "ledger-check"), required, availableNow=True).awaitTermination()
    rows = {name: spark.read.parquet(f"{out}/{name}").drop("batch").collect() for name in ("on_time", "late", "bad")}
    assert sum(map(len, rows.values())) == sum(map(len, parts))
    return sd.on_time(spark, out, schema), rows


def test_ledger_is_never_behind_the_watermark(spark, tmp_path):
    """Rows are late by the latest time of all batches before; Spark, whose watermark follows some time after, drops no other."""
    rng = random.Random(4)
    schema = "id long, ts timestamp, k string"
    parts = [[(100 * b + i, None if rng.random() < 0.1 else at(rng.uniform(-200, 100) + 60 * b), "k") for i in range(100)] for b in range(5)]
    stream, rows = dealt(spark, tmp_path, schema, "1 minute", *parts, required=("k",))
    assert rows["late"] and {r.reason for r in rows["bad"]} == {"ts"}
    # The same files straight into Spark: one file a batch, rows behind the watermark dropped by a stateful operator.
    plain = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "raw"))
    kept = drain(spark, plain.where("ts IS NOT NULL").withWatermark("ts", "1 minute").dropDuplicatesWithinWatermark(["id"]), tmp_path, "plain")
    newest, late = None, set()
    for part in parts:
        late |= {r[0] for r in part if r[1] and newest and r[1] <= newest - timedelta(minutes=1)}
        newest = max([r[1] for r in part if r[1]] + [newest or T0])
    assert {r.id for r in rows["late"]} == late
    assert {r.id for r in kept} >= {r.id for r in rows["on_time"]}
    again = drain(spark, stream.withWatermark("ts", "1 minute").dropDuplicatesWithinWatermark(["id"]), tmp_path, "again")
    assert sorted(r.id for r in again) == sorted(r.id for r in rows["on_time"])


def test_a_batch_that_runs_again_publishes_once(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    for _ in range(2):
        session.publish(spark, df, str(tmp_path / "staging"), str(tmp_path / "out/batch=0"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_attempts_decided_or_late_or_bad(spark, tmp_path):
    row = lambda *r: (*r, None, None)
    first = [row(1, 1, at(0), 200), row(2, 2, None, 200), row(None, 3, at(0), 200), row(4, 4, at(100), 403)]
    second = [row(5, 5, at(30), 200), row(6, 6, at(95), 200), row(7, None, at(99), 200)]
    stream, rows = dealt(spark, tmp_path, schemas.ATTEMPT, "10 seconds", first, second, required=("job_id",))
    assert {r.reason for r in rows["bad"]} == {"ts", "job_id"} and [r.job_id for r in rows["late"]] == [5]
    ended = drain(spark, sj.job_lifecycle_stream(stream, late="10 seconds"), tmp_path, "out")
    assert sorted((r.job_id, r.attempts) for r in ended if r.state != "due") == [(1, 1), (4, 1), (6, 1), (7, 1)]
    # Without the ledger such rows do no harm either.
    plain = sj.job_lifecycle_stream(spark.readStream.schema(schemas.ATTEMPT).parquet(str(tmp_path / "raw")), late="10 seconds")
    assert {r.job_id for r in drain(spark, plain, tmp_path, "plain") if r.state != "due"} == {1, 4, 5, 6, 7}


def test_chunks_without_parts(spark, tmp_path):
    first = [(1, None, 0, "a", None, at(0)), (1, 5, 1, None, False, at(1)), (2, None, 0, "b <PERSON_1>", True, at(1)), (None, 5, 0, "x", True, at(1)), (3, 5, None, "x", True, at(1)), (4, 5, 0, "x", True, None)]
    second = [(1, 5, 2, " <PERSON_1>", True, at(2)), (9, 5, 0, "late", True, at(-4000))]
    stream, rows = dealt(spark, tmp_path, schemas.CHUNK, "10 minutes", first, second, required=sm.CHUNK_NEEDS)
    assert sorted(r.reason for r in rows["bad"]) == ["answer_id", "seq", "ts"] and [r.answer_id for r in rows["late"]] == [9]
    markers = spark.createDataFrame([(5, "<PERSON_1>", "Luc")], "conv_id long, marker string, value string")
    out = str(tmp_path / "answers")
    sm.unmask_stream(stream, markers, out, str(tmp_path / "check"), availableNow=True).awaitTermination()
    found = {r.answer_id: (r.conv_id, r.unmasked_text, r.complete) for r in spark.read.parquet(out).collect()}
    assert found == {1: (5, "a Luc", True), 2: (None, "b <PERSON_1>", True)}


def test_replies_results_and_metrics_lose_nothing(spark, tmp_path):
    schema = "job_id long, team string, alias string, ts timestamp, status int, seconds double"
    first = [(1, "a", "x", at(7200), 200, 1.0)]
    second = [(2, "a", "x", at(10), 200, 2.0), (3, "a", "x", at(7000), 200, 3.0), (3, "a", "x", at(7000), 200, 3.0)]
    third = [(4, "a", "x", at(90000), 200, 4.0)]
    stream, rows = dealt(spark, tmp_path, schema, "10 minutes", first, second, third, required=("job_id",))
    assert [r.job_id for r in rows["late"]] == [2]
    results = drain(spark, sj.job_results_stream(stream, late="10 minutes"), tmp_path, "results")
    assert sorted(r.job_id for r in results) == [1, 3, 4]
    metrics = drain(spark, sj.job_metrics_stream(stream, every="1 hour"), tmp_path, "metrics")
    assert sum(r.attempts for r in metrics) == 3  # the last window is open


def test_late_replies_are_in_the_ledger(spark, tmp_path):
    jobs = [[(1, "q", at(0)), (2, "q", at(3600))]]
    replies = [[(1, "one", at(60)), (2, "two", at(3700))], [(1, "again", at(50))]]
    left, _ = dealt(spark, tmp_path / "a", "message_id long, reply_to string, ts timestamp", "10 minutes", *jobs)
    right, rows = dealt(spark, tmp_path / "b", "correlation_id long, content string, replied_ts timestamp", "10 minutes", *replies, ts="replied_ts", required=("correlation_id",))
    assert [r.content for r in rows["late"]] == ["again"]
    met = drain(spark, sj.match_replies_stream(left, right), tmp_path, "out")
    assert sorted(r.content for r in met) == ["one", "two"]


# Sinks and metrics


def test_a_message_that_comes_again_is_written_once(spark, tmp_path):
    body = '{"team": "a", "alias": "x", "messages": [{"role": "user", "content": "Hi"}]}'
    row = lambda i, n, b=body: (i, b, "q", n, at(0), None)
    first = [row(1, 0), row(1, 0), row(2, 0, "no"), row(None, 0), row(None, 0)]
    second = [row(1, 0), row(1, 1), row(2, 0, "no"), row(2, 1, "no"), row(3, None), row(None, 0)]
    third = [row(3, 0), row(2, 1, "no"), row(4, 2)]
    out = str(tmp_path / "out")
    stream = batches(spark, tmp_path / "in", schemas.JOB_MESSAGE, first, second, third)
    sj.job_sinks(stream, out, str(tmp_path / "check"), availableNow=True).awaitTermination()
    rows = lambda name: sorted((r.message_id or 0, r.attempt) for r in spark.read.parquet(f"{out}/{name}").collect())
    assert rows("jobs") == [(0, 1)] * 3 + [(1, 1), (1, 2), (3, 1), (4, 3)]
    assert rows("dead") == [(2, 1), (2, 2)]


def test_live_percentiles_are_near(spark, tmp_path):
    rng = random.Random(5)
    row = lambda i, hours, value: (i % 4000, "a" if i % 3 else None, "x", at(3600 * hours + i % 3500), 200 if i % 5 else 429, value)
    schema = "job_id long, team string, alias string, ts timestamp, status int, seconds double"
    parts = [[row(i, h, rng.expovariate(1) if i % 50 else None) for i in range(9000)] for h in range(3)]
    stream = batches(spark, tmp_path / "in", schema, *parts, [(0, "z", "x", at(90000), None, None)], [(0, "z", "x", at(190000), 200, None)])
    rows = drain(spark, sj.job_metrics_stream(stream, every="1 hour"), tmp_path, "out")
    assert len(rows) == 7
    merged = sj.merged_metrics(spark.read.parquet(str(tmp_path / "out"))).collect()

    def check(found, own):
        values = sorted(r[5] for r in own if r[5] is not None)
        for share, value in ((0.5, found.p50), (0.95, found.p95)):
            below, upto = (sum(v < value for v in values) / len(values), sum(v <= value for v in values) / len(values))
            assert below - 2 * sj.RANK_ERROR <= share <= upto + 2 * sj.RANK_ERROR
        exact = len({r[0] for r in own})
        assert abs(found.jobs - exact) <= 4 * sj.JOBS_ERROR * exact
        assert (found.attempts, found.backoff) == (len(own), sum(r[4] == 429 for r in own))

    everything = [r for p in parts for r in p]
    for found in rows:
        hour = (found.window.start - T0).total_seconds() / 3600
        own = [r for r in everything if r[1] == found.team and hour <= (r[3] - T0).total_seconds() / 3600 < hour + 1]
        if own:
            check(found, own)
        else:
            assert (found.team, found.attempts, found.retry, found.jobs, found.p50, found.p95) == ("z", 1, 1, 1, None, None)
    for found in merged:
        if found.team != "z":
            check(found, [r for r in everything if r[1] == found.team])
    assert {r.team for r in merged} == {"a", None, "z"}


def test_calls_out_of_order_over_batches(spark, tmp_path):
    """Calls that come up to a minute late are held back and decided in order; the last minute waits for more."""
    rng = random.Random(21)
    rows = [(i, at(7 * i), rng.choice("ab"), "x", rng.choice(["p", None]), rng.randrange(90), 5, Decimal(rng.randrange(900)) / 10**6) for i in range(300)]
    teams = spark.createDataFrame([("a", Decimal("0.03"), 4, 250), ("b", Decimal("0.02"), None, 200)], "team_id string, max_budget decimal(18,6), rpm_limit int, tpm_limit int")
    access = spark.createDataFrame([("a", "x"), ("b", "x")], "team_id string, alias string")
    caps = spark.createDataFrame([("p", Decimal("0.02"))], "provider string, cap decimal(18,6)")
    arrived = sorted(rows, key=lambda r: r[1].timestamp() + rng.uniform(0, 60))
    parts = [arrived[a : a + 60] for a in range(0, 300, 60)]
    out = str(tmp_path / "out")
    stream = batches(spark, tmp_path / "in", schemas.CALL, *parts, [(999, at(90000), "a", "x", None, 1, 1, Decimal(0))])
    sl.limits_stream(stream, teams, access, caps, out, str(tmp_path / "check"), days=1, hold="1 minute", availableNow=True).awaitTermination()
    found = {r.call_id: (r.decision, r.reason) for r in spark.read.parquet(f"{out}/decisions").collect()}
    whole = limits.admission(spark.createDataFrame(rows, schemas.CALL), teams, access, caps, 1).collect()
    assert found == {r.call_id: (r.decision, r.reason) for r in whole}
    assert spark.read.parquet(f"{out}/late").count() == 0
    assert [r.call_id for r in spark.read.parquet(f"{out}/state/pending/batch=5").collect()] == [999]
    assert sorted(os.listdir(f"{out}/state/spent")) == ["batch=4", "batch=5"]


def test_a_job_that_goes_on_yields_no_frame():
    import pandas as pd

    from maskline.streaming.jobs import _life

    class State:
        exists, hasTimedOut, get = False, False, None

        def update(self, value):
            self.get = value

        def setTimeoutTimestamp(self, at):
            self.at = at

        def getCurrentWatermarkMs(self):
            return 0

    ts = pd.Timestamp("2024-01-01 00:00:00")
    chunk = pd.DataFrame({"attempt_id": [None, 2.0, 1.0], "ts": [ts, ts, ts], "outcome": ["backoff", "backoff", "retry"], "wait": [7.0, 9.0, 5.0]})
    state = State()
    assert list(_life(1000)((1,), iter([chunk]), state)) == []
    # Equal times go by id, the attempt without one last: its wait counts.
    assert state.get == (3, 1, 2, "open") and state.at == ts.timestamp() * 1000 + 7000
    done = pd.DataFrame({"attempt_id": [3], "ts": [ts], "outcome": ["done"], "wait": [0.0]})
    state.exists = True
    assert [tuple(r)[:5] for frame in _life(1000)((1,), iter([done]), state) for r in frame.itertuples(index=False)] == [(1, "done", 4, 1, 2)]
