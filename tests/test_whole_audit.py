"""The audit over a ledger with what the published bounds leave out: a level of 201 accounts, receivers of 51 senders, a chain of 27 hops."""

import datetime as dt
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from paytrail import catalog
from paytrail.operators import adjudicate, detectors
from paytrail.plans import ledger_queries
from paytrail.plans.params import Params

from .test_catalog import plain
from .test_detectors import edges

P = 499
WIDE = [(b, 0) for b in range(1, 202)] + [(300 + 3 * b + i, b + 1) for b in range(2) for i in range(3)] + [(3, 1)]
SIDES = [(s, r) for r, first in ((400, 100), (401, 150), (402, 20)) for s in (310, 311, *range(first, first + 49))]
CHAIN = [(450 + i, 451 + i) for i in range(27)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """``events`` whose ledger has these payments: the numbers of sender and receiver are linear in both ids, modulo half the rows."""
    path, back = str(tmp_path_factory.mktemp("wide")), pow(7919 * 15485863 - 31 * 104729, -1, P)
    start, rows = dt.datetime(2024, 1, 1), []
    for k, (s, r) in enumerate(WIDE + SIDES + CHAIN):
        e, u = (7919 * r - 31 * s) * back % P, (15485863 * s - 104729 * r) * back % P
        rows.append((e + P * k, start + dt.timedelta(hours=k), u, "view", 5.0))
    rows += [(-1 - k, start, 0, "view", -1.0) for k in range(2 * P - len(rows))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


def test_the_crafted_ledger(spark, folder):
    rows = {(r.sender_account, r.receiver_account) for r in ledger_queries._edges(spark, folder).collect()}
    assert {(f"A{s}", f"A{r}") for s, r in WIDE + SIDES + CHAIN} <= rows


def test_detect_all_raw_takes_wide_levels_wide_sides_and_long_chains(spark, folder):
    found = [(r.pattern_type, r.anchor, json.loads(r.attributes)) for r in catalog.queries()["detect_all_raw"](spark, folder).collect()]
    assert [(x["branch_count"], x["leaf_count"]) for p, a, x in found if (p, a) == ("layered_fan", "A0")] == [(2, 6)]
    assert [x["receivers"] for p, a, x in found if (p, a) == ("bipartite", "A310")] == ["A400,A401,A402"]
    assert [x["hops"] for p, a, x in found if (p, a) == ("cycle", "A450")] == [27]


WHOLE = ["detect_all", "detect_all_raw", "adjudicated_findings", "compliance_report", "report_invariants", "reconcile"]
#: The bounds (max_frontier, max_block_side, cycle_max_hops) of each query of the audit.
BOUNDS = {**dict.fromkeys(WHOLE, (None, None, None)), **dict.fromkeys(["recall_by_pattern", "recall_summary"], (None, 50, 25))}


@pytest.mark.parametrize("name", BOUNDS)
def test_bounds_of_the_queries(spark, folder, monkeypatch, name):
    class Seen(Exception):
        pass

    def stop(edges, params, *_):
        raise Seen(params)

    monkeypatch.setattr(detectors, "detect_raw", stop)
    with pytest.raises(Seen) as seen:
        catalog.queries()[name](spark, folder)
    params = seen.value.args[0]
    assert (params.max_frontier, params.max_block_side, params.cycle_max_hops) == BOUNDS[name]


@pytest.mark.parametrize("most", [200, 3])
def test_wide_levels_by_join_equal_those_by_array(spark, monkeypatch, most):
    """Beyond ``WIDE_LEVEL`` a level doesn't travel as an array; its accounts are no leaves either way."""
    legs = [(f"x{b}{i}", f"b{b}", 1500, i) for b in range(5) for i in range(3)] + [(f"b{b}", "root", 4400, 5) for b in range(5)]
    legs += [("b4", "b0", 10, 1), ("b3", "b0", 10, 2), ("root", "b1", 10, 3), *((f"x{i}0", "small", 5, 6) for i in range(2)), ("b0", "x00", 5, 5), ("b1", "x00", 5, 5), ("b2", "x10", 5, 5), ("b3", "x10", 5, 5)]
    monkeypatch.setattr(detectors, "WIDE_LEVEL", most)
    out = {r.anchor: (r.branch_count, r.leaf_count, r.n) for r in detectors.layered_fan(edges(spark, legs), "in", Params(max_frontier=None)).collect()}
    assert out["root"] == (5, 15, 20) and out["small"] == (2, 4, 6)


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["recall_by_pattern", "reconcile"])
def test_sql_and_code_lift_the_same_bounds(spark, folder, duck, name):
    df = catalog.queries()[name](spark, folder)
    columns = sorted(df.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str) == sorted(([plain(w[i]) for i in at] for w in want.fetchall()), key=str)


def test_the_bounds_that_the_sql_states(spark, folder, duck):
    """Shapes of the made-up ledger that each SQL finds: recall takes levels of any width, reconcile receivers and chains of any size too."""

    def found(sql):
        rows = duck.sql(f"with recursive {sql} select pattern_type, candidate_id, len(refs) from decided").fetchall()
        return [sum(p == shape and f":{anchor}:" in i and n >= least for p, i, n in rows) for shape, anchor, least in (("layered_fan", "A0", 1), ("bipartite", "A310", 1), ("cycle", "A450", 27))]

    assert [found(sql) for sql in (ledger_queries.DECIDED, ledger_queries.DECIDED_LEVELS, ledger_queries.DECIDED_ALL)] == [[0, 0, 0], [1, 0, 0], [1, 1, 1]]


def test_candidates_are_not_dealt_by_shape(spark):
    """Nine shapes would make nine tasks of all candidates, with the most common shape in one of them."""
    found = spark.range(1000).select(F.col("id").cast("string").alias("candidate_id"), F.when(F.col("id") % 10 == 0, "cycle").otherwise("layered_fan").alias("pattern_type"))
    law = spark.createDataFrame([("cycle", "law:1"), ("cycle", "law:2")], "pattern_type string, chunk_id string")
    hints = spark.createDataFrame([("layered_fan", "hint:1", 1), ("layered_fan", "hint:9", 9)], "pattern_type string, chunk_id string, rank int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = adjudicate.bundles(found, law, hints)
        assert out._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 2
        assert {(r.pattern_type, tuple(r.shown), r.needs_law) for r in out.collect()} == {("cycle", ("law:1", "law:2"), False), ("layered_fan", ("hint:1",), True)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
