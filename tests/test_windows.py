"""Windows dealt by blocks of time against those of one task per account and a plain count."""

import random

import pytest
from pyspark.sql import functions as F

from paytrail.operators import detectors, windows

DAY = 100


def payments(seed, n=400):
    """Half of the rows are one account's, and a quarter one pair's."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "busy" if i % 2 else f"a{rng.randrange(6)}"
        who = "always" if i % 4 == 1 else f"w{rng.randrange(12)}"
        rows.append((f"t{i:04d}", key, who, rng.random() < 0.5, rng.choice([rng.randrange(30 * DAY), 500, 501])))
    return rows


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("forward", [True, False])
def test_counts_by_block_equal_a_plain_count(spark, seed, forward):
    rows, span = payments(seed), 3 * DAY
    frame = spark.createDataFrame(rows, "txn_ref string, k string, who string, flow boolean, us long")
    want = []
    for _, k, _, flow, us in rows:
        lo, hi = (us, us + span) if forward else (us - span, us)
        inside = [r for r in rows if r[1] == k and lo <= r[4] <= hi]
        want.append((k, flow, us, len(inside), len({r[2] for r in inside if r[3]}), len({r[2] for r in inside if not r[3]})))
    for block in (None, DAY, 7):
        got = windows.window_counts(frame, "k", "who", F.col("flow"), span, forward, block)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_runs_by_block_equal_those_of_one_task(spark):
    frame = spark.createDataFrame(payments(5), "txn_ref string, k string, who string, flow boolean, us long")
    pick = ["txn_ref", "k", "rn", "run_s", "run_e"]
    want = sorted(map(tuple, windows.maximal_runs(frame, ["k"], 3, DAY).select(*pick).collect()))
    assert want and all(sorted(map(tuple, windows.maximal_runs(frame, ["k"], 3, DAY, block).select(*pick).collect())) == want for block in (DAY, 13))


def test_a_busy_account_fills_several_tasks(spark):
    rows = [(*r[:4], i) for i, r in enumerate(payments(1, 3000))]
    frame = spark.createDataFrame(rows, "txn_ref string, k string, who string, flow boolean, at long")
    summed = windows.running_sums(frame, ["k"], {"n": F.lit(1)}, DAY)
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert "k#" in plan and "block#" in plan
    most = frame.groupBy("k", F.floor(F.col("at") / DAY)).count().agg(F.max("count")).first()[0]
    assert most <= DAY / 2 and {tuple(r) for r in summed.where("k = 'busy'").select("at", "n").collect()} == {tuple(r) for r in windows.running_sums(frame, ["k"], {"n": F.lit(1)}, None).where("k = 'busy'").select("at", "n").collect()}


def test_the_number_of_rows_decides(spark):
    assert windows.time_block(spark.range(10)) is None and windows.time_block(spark.range(10), 5) == windows.DAY_US


def test_structuring_by_block_equals_that_of_one_task(spark, monkeypatch):
    """Larger ledgers number rows by blocks of time, as longs; the claims' fold has to take them."""
    rows = [(f"t{i:02d}", f"a{i % 3}", f"b{i % 2}", 9_000.0 + i, i * windows.DAY_US // 2) for i in range(24)]
    frame = spark.createDataFrame(rows, "txn_ref string, sender_account string, receiver_account string, amount double, us long").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    pick = lambda: sorted((r["anchor"], r["side"], tuple(r["refs"])) for r in detectors.structuring(frame).collect())
    want = pick()
    monkeypatch.setattr(detectors, "time_block", lambda rows: windows.DAY_US)
    assert want and pick() == want


def test_a_large_ledger_without_busy_accounts_needs_no_blocks(spark):
    rows = spark.range(2000).select((F.col("id") % 500).cast("string").alias("k"))
    assert windows.time_block(rows, 100) == windows.DAY_US and windows.account_block(rows, "k", 100) is None
    assert windows.account_block(rows.unionByName(rows.where("k = '7'").crossJoin(spark.range(30)).select("k")), "k", 100) == windows.DAY_US
    assert windows.account_block(rows.limit(0), "k", 100) is None


def test_gather_scatter_by_block_equals_that_of_one_task(spark, monkeypatch):
    rows = [(f"t{i:02d}", f"a{i % 5}", f"a{(i * 7 + 1) % 6}", 100.0 + i, i * windows.DAY_US // 3) for i in range(90)]
    frame = spark.createDataFrame(rows, "txn_ref string, sender_account string, receiver_account string, amount double, us long").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    pick = lambda: sorted((r["anchor"], tuple(r["refs"]), r["distinct_senders"], r["distinct_recipients"]) for r in detectors.gather_scatter(frame).collect())
    want = pick()
    monkeypatch.setattr(detectors, "account_block", lambda rows, key: windows.DAY_US)
    assert want and pick() == want


def test_structuring_of_a_large_ledger_without_busy_accounts_takes_no_blocks(spark, monkeypatch):
    """Its runs are written once for each side, by accounts alone; with a busy account by blocks, with the same result."""
    rows = [(f"t{i:02d}", f"a{i % 3}", f"b{i % 2}", 9_000.0 + i, i * windows.DAY_US // 2) for i in range(24)]
    frame = spark.createDataFrame(rows, "txn_ref string, sender_account string, receiver_account string, amount double, us long").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    wrote, cut, busy = [], detectors.cut, detectors.account_block
    monkeypatch.setattr(detectors, "cut", lambda df, label: wrote.append((label, df._jdf.queryExecution().analyzed().toString())) or cut(df, label))
    pick = lambda: sorted((r["anchor"], r["side"], tuple(r["refs"])) for r in detectors.structuring(frame).collect())
    want = pick()
    monkeypatch.setattr(detectors, "time_block", lambda rows: windows.DAY_US)
    assert want and pick() == want
    assert [label for label, _ in wrote] == ["runs"] * 4 and not any("block#" in plan for _, plan in wrote)
    monkeypatch.setattr(detectors, "account_block", lambda rows, key: busy(rows, key, 3))
    assert pick() == want and all("block#" in plan for _, plan in wrote[4:])
