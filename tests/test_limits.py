"""Limits and scans against call-by-call folds, with one team holding most calls."""

import random
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from maskline.operators import evaluate, limits, scan

DAYS = 3


@pytest.fixture(scope="module")
def calls():
    rng = random.Random(3)
    start, rows = datetime(2024, 1, 1), []
    for i in range(4000):
        team = "a" if rng.random() < 0.6 else rng.choice("bcd")
        start += timedelta(seconds=rng.choice([0, 1, 5, 40, 300]))
        alias = rng.choice(["small", "large", "hosted"])
        rows.append((i, start, team, alias, "pro" if alias == "hosted" else "local", rng.randrange(1, 200), rng.randrange(1, 50), Decimal(rng.randrange(1, 900)) / 10**6))
    return rows


def frames(spark, calls):
    schema = "call_id long, ts timestamp, team string, alias string, provider string, tokens_in long, tokens_out long, cost decimal(30,10)"
    teams = spark.createDataFrame(
        [("a", Decimal("0.2"), 6, 900), ("b", Decimal("0.05"), 2, 300), ("c", Decimal("0.02"), 4, 500), ("d", Decimal("9"), 1, 100)],
        "team_id string, max_budget decimal(18,6), rpm_limit int, tpm_limit int",
    )
    access = spark.createDataFrame([(t, x) for t in "abcd" for x in ("small", "large", "hosted") if (t, x) != ("c", "large")], "team_id string, alias string")
    caps = spark.createDataFrame([("pro", Decimal("0.06"))], "provider string, cap decimal(18,6)")
    return spark.createDataFrame(calls, schema).repartition(6), teams, access, caps


NO_LIMITS = Row(max_budget=None, rpm_limit=None, tpm_limit=None)


def reached(used, limit):
    return limit is not None and used >= limit


def sequential(calls, teams, access, caps):
    """One call after the other."""
    limits_of = {t.team_id: t for t in teams.collect()}
    allowed = {(r.team_id, r.alias) for r in access.collect()}
    cap = {r.provider: r.cap for r in caps.collect()}
    team_first, provider_first = {}, {}
    for _, ts, team, _, provider, *_ in calls:
        team_first.setdefault(team, ts)
        provider_first.setdefault(provider, ts)
    minute, team_spend, provider_spend, out = defaultdict(lambda: [0, 0]), defaultdict(Decimal), defaultdict(Decimal), {}
    for call_id, ts, team, alias, provider, tin, tout, cost in sorted(calls, key=lambda c: (c[1], c[0])):
        limit = limits_of.get(team, NO_LIMITS)
        key = (team, ts.replace(second=0, microsecond=0))
        tp = (team, (ts - team_first[team]) // timedelta(days=DAYS))
        pp = (provider, (ts - provider_first[provider]) // timedelta(days=DAYS))
        if (team, alias) not in allowed:
            out[call_id] = (403, "access")
        elif reached(minute[key][0], limit.rpm_limit) or reached(minute[key][1], limit.tpm_limit):
            out[call_id] = (429, "rate")
        else:
            minute[key][0] += 1
            minute[key][1] += tin + tout
            if reached(team_spend[tp], limit.max_budget):
                out[call_id] = (422, "budget")
            elif provider in cap and provider_spend[pp] >= cap[provider]:
                out[call_id] = (429, "provider cap")
            else:
                team_spend[tp] += cost
                provider_spend[pp] += cost
                out[call_id] = (200, "accepted")
    return out


def test_admission_equals_the_fold(spark, calls):
    df, teams, access, caps = frames(spark, calls)
    expected = sequential(calls, teams, access, caps)
    found = {r.call_id: (r.decision, r.reason) for r in limits.admission(df, teams, access, caps, DAYS).collect()}
    assert found == expected
    assert {reason for _, reason in expected.values()} == {"access", "rate", "budget", "provider cap", "accepted"}


def partial_limits(spark, calls):
    """Calls without a team, of an unknown one, without a provider; limits that are null or missing."""
    df, teams, access, caps = frames(spark, calls)
    odd = [(i, ts, None if i % 17 == 0 else "zz" if i % 17 == 1 else team, alias, None if i % 13 == 0 else provider, *rest) for i, ts, team, alias, provider, *rest in calls]
    rows = [("a", None, 6, None), ("b", Decimal("0.05"), None, 300), ("c", Decimal("0.02"), None, None)]
    teams = spark.createDataFrame(rows, teams.schema)
    access = access.unionByName(spark.createDataFrame([("zz", "small")], access.schema))
    return odd, spark.createDataFrame(odd, df.schema).repartition(5), teams, access, caps


def test_every_call_gets_one_decision(spark, calls):
    odd, df, teams, access, caps = partial_limits(spark, calls)
    expected = sequential(odd, teams, access, caps)
    found = limits.admission(df, teams, access, caps, DAYS).collect()
    assert len(found) == len(odd) and {r.call_id: (r.decision, r.reason) for r in found} == expected
    rates = limits.rate_decisions(df, teams).collect()
    assert len(rates) == len(odd) and all(r.decision == 200 for r in rates if r.team not in ("a", "b"))
    assert {r.decision for r in rates if r.team == "a"} == {200, 429} and all(r.reset_at for r in rates if r.decision == 429)
    budgets = limits.budget_decisions(df, teams, DAYS).collect()
    assert len(budgets) == len(odd) and all(r.decision == 200 for r in budgets if r.team not in ("b", "c"))
    assert {r.decision for r in budgets if r.team == "c"} == {200, 422}


def test_running_totals_in_blocks(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else str(i % 7), rng.randrange(100), Decimal(rng.randrange(1000)) / 1000) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, key string, v long, d decimal(30,10)")
    blocked = scan.ordered_blocks(df, ["id"], 7)
    assert blocked.select(scan.BLOCK).distinct().count() == 7
    found = {r.id: (r.before, r.spent) for r in scan.running_before(blocked, ["key"], ["id"], {"before": F.col("v"), "spent": F.col("d")}).collect()}
    sums, spent, expected = defaultdict(int), defaultdict(Decimal), {}
    for i, key, v, d in sorted(rows):
        expected[i] = (sums[key], spent[key])
        sums[key] += v
        spent[key] += d
    assert found == expected


def test_positions_without_keys(spark):
    df = spark.range(1000).withColumn("x", -F.col("id"))
    assert {r.id: r.n for r in scan.positions(df, [], ["x"], "n").collect()} == {i: 1000 - i for i in range(1000)}


@pytest.mark.parametrize("n", [1, 2, 3, 19, 20, 100])
def test_exclusive_percentiles(spark, n):
    import statistics

    values = [float((i * 37) % 101) for i in range(n)]
    df = spark.createDataFrame([("x", v) for v in values], "variant string, ms double")
    row = evaluate.latency_percentiles(df).first()
    assert row.p50 == pytest.approx(statistics.median(values))
    if n > 1:
        # Beyond the last pair the method extends the line, as statistics.quantiles does.
        assert row.p95 == pytest.approx(statistics.quantiles(values, n=20)[18])


def alternating(n):
    """Calls in which budgets and caps run out in turn: each stop leaves what the next one needs, with periods of a day."""
    rows, start = [], datetime(2024, 1, 1)
    for k in range(n):
        team, provider = f"t{k}", f"p{k}"
        for i in range(6):
            # The team spends on its provider, which the next team shares; that one's budget lasts until this provider stops.
            rows.append((team, provider, 2))
            rows.append((f"t{k + 1}", provider, 1 if i < 3 else 2))
    return [(i, start + timedelta(seconds=7 * i), t, "x", p, 1, 1, Decimal(c)) for i, (t, p, c) in enumerate(rows)]


def admitted_with_jobs(spark, n):
    rows = alternating(n)
    schema = "call_id long, ts timestamp, team string, alias string, provider string, tokens_in long, tokens_out long, cost decimal(30,10)"
    names = sorted({r[2] for r in rows})
    teams = spark.createDataFrame([(t, Decimal(9), None, None) for t in names], "team_id string, max_budget decimal(18,6), rpm_limit int, tpm_limit int")
    access = spark.createDataFrame([(t, "x") for t in names], "team_id string, alias string")
    caps = spark.createDataFrame([(p, Decimal(11)) for p in sorted({r[4] for r in rows})], "provider string, cap decimal(18,6)")
    group = f"admission-{n}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = {r.call_id: (r.decision, r.reason) for r in limits.admission(spark.createDataFrame(rows, schema).repartition(3), teams, access, caps, 1).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    assert found == sequential(rows, teams, access, caps)
    return jobs, len({(r[2], found[r[0]][1]) for r in rows if found[r[0]][0] != 200})


def test_jobs_do_not_grow_with_stops(spark, monkeypatch):
    monkeypatch.setattr(limits, "ordered_blocks", lambda df, order: scan.ordered_blocks(df, order, rows=40))
    monkeypatch.setitem(sequential.__globals__, "DAYS", 1)
    few, stops = admitted_with_jobs(spark, 3)
    many, more = admitted_with_jobs(spark, 100)
    assert stops >= 4 and more >= 100
    assert many <= few + 3


@pytest.mark.parametrize("seed", range(3))
def test_coupled_stops_equal_the_fold(spark, monkeypatch, seed):
    """Many small blocks, short periods, tight limits, equal times, free and null costs."""
    monkeypatch.setattr(limits, "ordered_blocks", lambda df, order: scan.ordered_blocks(df, order, rows=25))
    rng = random.Random(seed)
    start, rows = datetime(2024, 1, 1), []
    for i in range(2500):
        start += timedelta(seconds=rng.choice([0, 0, 60, 600, 3600]))
        rows.append((i, start, rng.choice("aaaabcde"), "x", rng.choice(["p", "p", "q", "r", None]), 1, 1, Decimal(rng.choice([0, 1, 1, 2, 5, 9]))))
    schema = "call_id long, ts timestamp, team string, alias string, provider string, tokens_in long, tokens_out long, cost decimal(30,10)"
    teams = spark.createDataFrame([(t, None if b is None else Decimal(b), None, None) for t, b in zip("abcde", (150, 30, 45, 0, None), strict=True)], "team_id string, max_budget decimal(18,6), rpm_limit int, tpm_limit int")
    access = spark.createDataFrame([(t, "x") for t in "abcde"], "team_id string, alias string")
    caps = spark.createDataFrame([("p", Decimal(120)), ("q", Decimal(rng.choice([0, 60])))], "provider string, cap decimal(18,6)")
    found = {r.call_id: (r.decision, r.reason) for r in limits.admission(spark.createDataFrame(rows, schema).repartition(3), teams, access, caps, DAYS).collect()}
    assert found == sequential(rows, teams, access, caps)
    assert {why for _, why in found.values()} == {"budget", "provider cap", "accepted"}


def test_blocks_are_bounded(spark):
    blocked = scan.ordered_blocks(spark.range(5000).repartition(5), ["id"], rows=300)
    sizes = blocked.groupBy(scan.BLOCK).agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).orderBy(scan.BLOCK).collect()
    assert max(r.n for r in sizes) <= 300 and sum(r.n for r in sizes) == 5000
    assert all(a.high < b.low for a, b in zip(sizes, sizes[1:], strict=False))
