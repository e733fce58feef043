from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from wareflow.functions.sequence import numbered, rolling
from wareflow.plans import control

T0 = dt.datetime(2024, 1, 1, 1, 59, 59)


def signals(spark, outcomes, stage="s"):
    return spark.createDataFrame([(i, T0 + dt.timedelta(minutes=7 * i), stage, o) for i, o in enumerate(outcomes)], "event_id int, ts timestamp_ntz, stage string, failed boolean")


def test_rates_need_five_samples_and_forget_after_thirty(spark):
    rows = control.fail_rates(signals(spark, [True] * 5 + [False] * 40), "stage", "ts", "event_id", "failed").orderBy("seq").collect()
    assert [r.fail_rate for r in rows[:5]] == [None] * 4 + [1.0]
    assert rows[29].fail_rate == 5 / 30 and rows[34].fail_rate == 0


def test_numbers_and_windows_do_not_depend_on_blocks(spark):
    rows = spark.range(200).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 200).alias("v"))
    got = numbered(rows, ["k"], F.floor(F.col("v") / 9), ["v"])
    for k in range(3):
        values = [r.seq for r in got.where(f"k = {k}").orderBy("v").collect()]
        assert values == list(range(1, len(values) + 1))
    sums = {b: sorted((r.k, r.seq, r.s) for r in rolling(got, ["k"], "seq", 5, {"s": lambda w: F.sum("v").over(w)}, b).collect()) for b in (3, 7, 1000)}
    assert sums[3] == sums[7] == sums[1000]


@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 64))
@settings(max_examples=60, deadline=None)
def test_caps_stay_within_their_bounds(path, cap):
    jumped = False
    for s in path:
        cap, jumped = control.next_cap(cap, jumped, s, 1, 64)
        assert 1 <= cap <= 64


def test_cap_steps():
    assert control.next_cap(8, False, 0, 1, 64) == (36, True)
    assert control.next_cap(36, True, 0, 1, 64) == (45, True)
    assert control.next_cap(45, True, 1, 1, 64) == (36, True)
    assert control.next_cap(36, True, 2, 1, 64) == (18, True)
    assert control.next_cap(1, True, 0, 1, 64) == (2, True)


def test_cap_path_is_the_same_in_blocks_and_for_other_cooldowns(spark):
    rates = control.fail_rates(signals(spark, [i % 9 == 0 or 40 < i < 60 for i in range(160)]), "stage", "ts", "event_id", "failed")
    paths = {b: [(r.decision, r.cap) for r in control.cap_path(rates, "stage", block=b).orderBy("decision").collect()] for b in (2, 1000)}
    assert paths[2] == paths[1000] and len(paths[2]) == 32
    assert len(control.cap_path(rates, "stage", cooldown=10).collect()) == 16
    assert len(control.cap_path(rates, "stage", cooldown=20).collect()) == 8
    assert dict(control.permits(control.cap_path(rates, "stage"), "stage")) == {"s": paths[2][-1][1]}


def test_start_cap(spark):
    row = spark.range(1).select(control.start_cap(F.lit(100.0), F.lit(0.5), F.lit(4), 1, 64).alias("a"), control.start_cap(F.lit(1000.0), F.lit(1.0), F.lit(0), 1, 64).alias("b"), control.start_cap(F.lit(1.0), F.lit(0.1), F.lit(5), 2, 64).alias("c")).first()
    assert (row.a, row.b, row.c) == (12, 64, 2)


def operations(spark, rows):
    return spark.createDataFrame([("t", dt.datetime(2024, 1, d, h), k, p, o == "refund") for k, (d, h, p, o) in enumerate(rows)], "tenant string, ts timestamp_ntz, key int, product bigint, refund boolean")


def test_quota_days_start_at_two_utc(spark):
    rows = spark.createDataFrame([(T0,), (T0 + dt.timedelta(seconds=1),)], "ts timestamp_ntz").select(control.quota_day(F.col("ts")).alias("d")).collect()
    assert [r.d for r in rows] == [dt.date(2023, 12, 31), dt.date(2024, 1, 1)]


def test_ledger(spark):
    ops = operations(spark, [(1, 5, 1, "consume"), (1, 6, 1, "consume"), (1, 7, 2, "consume"), (1, 8, 3, "consume"), (1, 9, 3, "refund"), (1, 10, 2, "refund"), (1, 11, 2, "refund"), (1, 12, 4, "consume"), (3, 5, 1, "refund")])
    placed = control.attributed(ops, "tenant", "ts", "key", "product", F.col("refund"))
    got = [(str(r.quota_day), r.used, r.denied, r.refunded) for r in control.ledger(placed, 2).collect()]
    assert got == [("2024-01-01", 1, 1, 2)]
    assert control.ledger(placed).first().used == 1


def test_usage_counts_products_once(spark):
    ops = operations(spark, [(1, 5, 1, "consume"), (1, 6, 1, "consume"), (1, 7, 2, "consume")])
    assert control.day_usage(ops, "tenant", "ts", "product", ~F.col("refund")).first().units == 2
    assert control.day_usage(ops, "tenant", "ts", "product", F.col("refund")).count() == 0


def folded(rows, limit):
    """The ledger's days one operation at a time; rows (tenant, day, seq, product, refund)."""
    days = {}
    for tenant, day, _, product, refund in sorted(rows, key=lambda r: r[2]):
        d = days.setdefault((tenant, day), [set(), 0, 0])
        if refund and product in d[0]:
            d[0].discard(product)
            d[2] += 1
        elif not refund and product not in d[0]:
            if len(d[0]) < limit:
                d[0].add(product)
            else:
                d[1] += 1
    return sorted(((*k, len(a), n, r) for k, (a, n, r) in days.items()), key=str)


def ledger_rows(seed, n=900):
    rng = random.Random(seed)
    # A tenant with a third of all rows, one without a name, and products without one.
    tenants = [7] * 10 + [None] * 4 + list(range(8, 24))
    return [(rng.choice(tenants), rng.choice(["d1", "d2", None]), k, rng.choice([None, *range(seed % 5 + 3)]), rng.random() < (0.1, 0.3, 0.5)[seed % 3]) for k in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_ledger_by_blocks_equals_the_fold(spark, seed):
    rows = ledger_rows(seed)
    ops = spark.createDataFrame([(t, d, T0 + dt.timedelta(minutes=13 * k), k, p, r) for t, d, k, p, r in rows], "tenant long, quota_day string, ts timestamp_ntz, key long, product long, refund boolean").repartition(5)
    for limit, block in ((1, "minute"), (3, "hour"), (4, "day"), (2000, "hour"), (0, "week"), (2, "year")):
        got = sorted((tuple(r) for r in control.ledger(ops, limit, block).collect()), key=str)
        assert got == folded(rows, limit), (limit, block)


def test_a_ledger_gathers_no_day_in_a_row(spark):
    ops = spark.createDataFrame([(1, "d", T0, 1, 1, False)], "tenant long, quota_day string, ts timestamp_ntz, key long, product long, refund boolean")
    plan = control.ledger(ops)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "collect_set" not in plan


def test_blocks_are_cut_down_to_what_may_change_something(spark):
    rows = [(0, "a", False), (1, "a", False), (2, "b", False), (3, "a", False), (4, "a", True), (5, "a", True), (6, "b", False), (7, "b", False), (8, "b", True)]
    last, out = {}, []
    for seq, product, refund in rows:
        out.append(("x", 0, seq, product, refund, last.get(product)))
        last[product] = refund
    df = spark.createDataFrame(out, "of string, block long, at long, product string, refund boolean, before boolean")
    got = sorted((r["at"], r["product"], r["refund"], r["times"]) for r in control.decisive(df).collect())
    assert got == [(0, "a", False, 3), (2, "b", False, 1), (4, "a", True, 1), (6, "b", False, 2), (8, "b", True, 1)]


def test_no_row_of_a_null_stage_is_lost(spark):
    rows = signals(spark, [i % 3 == 0 for i in range(60)]).withColumn("stage", F.when(F.col("event_id") % 2 == 0, F.col("stage")))
    rates = control.fail_rates(rows, "stage", "ts", "event_id", "failed")
    assert rates.count() == 60 and rates.where("stage is null").agg(F.max("seq")).first()[0] == 30
    path = control.cap_path(rates, "stage")
    assert sorted(((r.stage, r.decision) for r in path.collect()), key=str) == sorted(((s, d) for s in ("s", None) for d in range(1, 7)), key=str)
    null_time = rows.withColumn("ts", F.when(F.col("event_id") > 9, F.col("ts")))
    assert control.fail_rates(null_time, "stage", "ts", "event_id", "failed").count() == 60
