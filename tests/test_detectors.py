import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from paytrail.operators import detectors, evaluate, graph, greedy, windows
from paytrail.operators.components import connected_components
from paytrail.plans.params import Params, Weights
from paytrail.sources import ledger

SCHEMA = "pos long, txn_ref string, sender_account string, receiver_account string, amount decimal(18,2), ts timestamp_ntz, payment_kind string, sender_country string, receiver_country string, currency string, us long"
START = dt.datetime(2024, 1, 1)


def edges(spark, legs):
    """Legs: (sender, receiver, amount, day) with an optional kind."""
    from decimal import Decimal

    rows = []
    for i, (s, r, amount, day, *kind) in enumerate(legs):
        ts = START + dt.timedelta(days=day)
        us = int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
        rows.append((i, f"T{i:04d}", s, r, Decimal(str(amount)), ts, kind[0] if kind else "wire", "US", "US", "USD", us))
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return {r.anchor: r for r in df.collect()}


def test_fan_in_needs_distinct_senders_inside_the_window(spark):
    e = edges(spark, [(f"s{i}", "hub", 100, i) for i in range(4)] + [("s0", "few", 1, d) for d in range(6)] + [(f"q{i}", "slow", 5, 10 * i) for i in range(4)])
    out = found(detectors.fan_in(e))
    assert set(out) == {"hub"} and out["hub"].refs == ["T0000", "T0001", "T0002", "T0003"] and out["hub"].distinct_senders == 4


def test_window_is_closed_at_both_ends(spark):
    assert set(found(detectors.fan_out(edges(spark, [("hub", f"r{i}", 1, d) for i, d in enumerate((0, 1, 2, 14))])))) == {"hub"}
    assert not found(detectors.fan_out(edges(spark, [("hub", f"r{i}", 1, d) for i, d in enumerate((0, 1, 2, 14.001))])))


def test_structuring_claims_the_originators_rows_first(spark):
    e = edges(spark, [("a", "b", 9000, d) for d in range(3)] + [(f"s{d}", "c", 2500, d) for d in range(4)] + [("x", f"y{d}", 10000, d) for d in range(3)])
    out = detectors.structuring(e).collect()
    assert sorted((r.anchor, r.side, r.threshold) for r in out) == [("a", "originator", 10000), ("c", "beneficiary", 3000)]


def structuring_brute(legs, span=14, least=3):
    """The fold as stated: sides in turn, accounts in turn, runs in order of their start."""
    claimed, out = set(), []
    for threshold in (10000, 3000):
        band = [(i, leg) for i, leg in enumerate(legs) if threshold * 0.8 <= leg[2] < threshold]
        for side in (0, 1):
            for account in sorted({leg[side] for _, leg in band}):
                rows = sorted((leg[3], i) for i, leg in band if leg[side] == account)
                best = {}
                for end in range(len(rows)):
                    start = next(k for k in range(end + 1) if rows[end][0] - rows[k][0] <= span)
                    if end - start + 1 >= least:
                        best[start] = end
                for start in sorted(best):
                    refs = {f"T{i:04d}" for _, i in rows[start : best[start] + 1]}
                    if not refs & claimed:
                        claimed |= refs
                        out.append((account, ("originator", "beneficiary")[side], tuple(sorted(refs))))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_structuring_against_brute_force(spark, seed):
    rng = random.Random(seed)
    legs = [(f"a{rng.randrange(4)}", f"b{rng.randrange(4)}", rng.choice([9000, 2600, 500]), rng.randrange(60)) for _ in range(90)]
    got = sorted((r.anchor, r.side, tuple(r.refs)) for r in detectors.structuring(edges(spark, legs)).collect())
    assert got == structuring_brute(legs)


def test_ring_and_open_chain(spark):
    e = edges(spark, [("a", "b", 100, 0), ("b", "c", 90, 1), ("c", "a", 80, 2), ("p", "q", 100, 0), ("q", "r", 95, 3), ("r", "s", 90, 6), ("m", "n", 100, 0), ("n", "o", 50, 1), ("o", "m", 10, 2)])
    out = detectors.cycle(e).collect()
    assert sorted((r.anchor, r.hops, tuple(r.refs)) for r in out) == [("a", 3, ("T0000", "T0001", "T0002")), ("p", 3, ("T0003", "T0004", "T0005"))]


def keep_brute(sets, overlap):
    kept, out = [], {}
    for i, (_, refs) in sorted(sets.items(), key=lambda x: (x[1][0], x[0])):
        by = next((k for k in kept if len(set(refs) & set(sets[k][1])) / len(set(refs)) > overlap), None)
        out[i] = by
        if by is None:
            kept.append(i)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_rounds_equal_the_ordered_fold(spark, seed):
    rng = random.Random(seed)
    sets = {f"c{i:02d}": (rng.randrange(5), [f"t{x}" for x in rng.sample(range(14), rng.randint(1, 7))]) for i in range(40)}
    df = spark.createDataFrame([(k, r, refs) for k, (r, refs) in sets.items()], "id string, rank int, refs array<string>")
    for most in (10**6, 0):  # in one task, and in rounds
        got = {r.id: r.absorber for r in greedy.keep_first(df, 0.6, most).collect()}
        assert got == keep_brute(sets, 0.6)


def test_greedy_with_equal_sets_and_hot_refs(spark):
    rng = random.Random(8)
    base = [[f"t{x}" for x in rng.sample(range(9), rng.randint(1, 4))] for _ in range(15)]
    sets = {f"c{i:03d}": (rng.randrange(3), rng.choice(base) + ["hot"] * rng.randint(0, 1)) for i in range(150)}
    df = spark.createDataFrame([(k, r, [*refs, refs[0]]) for k, (r, refs) in sets.items()] + [("none", 0, [])], "id string, rank int, refs array<string>")
    for most in (10**6, 0):
        got = {r.id: r.absorber for r in greedy.keep_first(df, 0.6, most).collect()}
        assert got.pop("none") is None and got == keep_brute(sets, 0.6)
    assert all(r.kept for r in greedy.keep_first(df, 1.0).collect())


def test_a_ref_in_thousands_of_sets_makes_no_pair_list(spark):
    sets = spark.range(5000).select(F.col("id").alias("no"), F.array(F.lit("hot"), *(F.concat(F.lit(c), F.col("id").cast("string")) for c in "abc")).alias("refs"))
    sets = sets.unionByName(spark.createDataFrame([(6000, ["a7", "b7", "hot"]), (6001, ["hot"]), (6002, ["hot", "new"])], sets.schema))
    # 6001 asks for the hot ref itself, whose 5001 earlier holders all cover it; 6002 needs both its refs and asks for the rare one
    pairs = {tuple(r) for r in greedy.candidate_pairs(sets, 0.6, hot_ref=100).collect()}
    assert {p for p in pairs if p[1] != 6001} == {(7, 6000)} and len(pairs) == 5002
    got = {(r["sup"], r["sub"]) for r in greedy.covering_pairs(sets, 0.6).collect()}
    assert got == pairs


def deposit_brute(legs):
    out, accounts = set(), {leg[1] for leg in legs}
    for a in accounts:
        used = set()
        for d in sorted((leg[3], i) for i, leg in enumerate(legs) if leg[1] == a and leg[4] == "cash_deposit"):
            for s in sorted((leg[3], i) for i, leg in enumerate(legs) if leg[0] == a and leg[4] == "wire"):
                if s[1] not in used and 0 <= s[0] - d[0] <= 3 and abs(legs[s[1]][2] / legs[d[1]][2] - 1) <= 0.05:
                    used.add(s[1])
                    out |= {(a, f"T{d[1]:04d}"), (a, f"T{s[1]:04d}")}
                    break
    return out


@pytest.mark.parametrize("seed", range(3))
def test_deposit_send_against_brute_force(spark, seed):
    rng = random.Random(seed)
    legs = []
    for _ in range(80):
        cash = rng.random() < 0.5
        legs.append((f"x{rng.randrange(3)}" if cash else f"a{rng.randrange(2)}", f"a{rng.randrange(2)}" if cash else f"y{rng.randrange(3)}", rng.choice([100, 103, 200]), rng.randrange(40) / 2, "cash_deposit" if cash else "wire"))
    got = {(r.anchor, ref) for r in detectors.deposit_send(edges(spark, legs)).collect() for ref in r.refs}
    assert got == deposit_brute(legs)


def test_scatter_gather_absorbs_its_fan_out(spark):
    e = edges(spark, [("a", f"m{i}", 100, 0) for i in range(4)] + [(f"m{i}", "z", 99, 1) for i in range(4)])
    out = greedy.reconcile(detectors.detect_raw(e), Params().precedence, 0.6).collect()
    assert [r.pattern_type for r in out if r.kept] == ["scatter_gather"]
    absorber = next(r.candidate_id for r in out if r.kept)
    assert {r.absorber for r in out if not r.kept} == {absorber}


def test_funnel_and_hub(spark):
    e = edges(spark, [(f"l{b}{i}", f"b{b}", 10, i) for b in range(3) for i in range(3)] + [(f"b{b}", "root", 30, 6) for b in range(3)])
    out = found(detectors.layered_fan(e, "in"))
    assert set(out) == {"root"} and (out["root"].branch_count, out["root"].leaf_count, out["root"].n) == (3, 9, 12)
    hub = edges(spark, [(f"i{k}", "h", 100, k) for k in range(3)] + [("h", f"o{k}", 100, 5 + k) for k in range(3)])
    assert found(detectors.gather_scatter(hub))["h"].conservation == 1.0
    assert not found(detectors.gather_scatter(hub.withColumn("amount", F.when(F.col("sender_account") == "h", F.col("amount") / 10).otherwise(F.col("amount")).cast("decimal(18,2)"))))


def test_blocks_and_stacks(spark):
    block = edges(spark, [(f"s{i}", f"r{j}", 10, 1) for i in range(2) for j in range(7)])
    one = detectors.bipartite_blocks(block).collect()
    assert len(one) == 1 and one[0].density == 1.0 and len(one[0].refs) == 14
    stack = edges(spark, [(f"a{i}", f"b{j}", 10, 0) for i in range(2) for j in range(5)] + [(f"b{i}", f"c{j}", 10, 3) for i in range(3) for j in range(5)])
    out = detectors.bipartite(stack).collect()
    assert len(out) == 1 and out[0].layers == 2
    hub = edges(spark, [(f"s{i}", "hub", 1, 0) for i in range(51)] + [(f"s{i}", f"own{i}", 1, 0) for i in range(51)])
    assert detectors.bipartite_blocks(hub).count() == 0
    apart = edges(spark, [(f"x{i}", f"y{i}", 1, 0) for i in range(200)])
    assert detectors.bipartite_blocks(apart).count() == 0


def test_levels_stop_at_a_wide_frontier(spark):
    e = edges(spark, [(f"s{i}", "hub", 1, 0) for i in range(201)] + [("s1", "small", 1, 0), ("u", "s1", 1, 0), ("small", "s1", 1, 0)])
    roots = spark.createDataFrame([("hub",), ("small",)], "root string")
    out = graph.multi_hop_layers(e, roots, "in").collect()
    assert [(r.level, r.truncated) for r in out if r.root == "hub"] == [(0, True)]
    assert sorted((r.level, r.account) for r in out if r.root == "small") == [(1, "s1"), (2, "u")]


def test_components(spark):
    pairs = [("a", "b"), ("c", "b"), ("x", "y")] + [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got["c"] == "a" and got["y"] == "x" and {got[f"n{i:02d}"] for i in range(31)} == {"n00"}


def test_planted_shapes_are_found_and_ids_are_stable(spark):
    e = ledger.ledger(spark, "/root/testdata/sf0.001")
    raw = detectors.detect_raw(e).collect()
    assert [r.candidate_id for r in raw] and {r.candidate_id for r in raw} == {r.candidate_id for r in detectors.detect_raw(e.repartition(7)).collect()}
    known = {r.txn_ref for r in e.select("txn_ref").collect()}
    assert all(set(r.refs) <= known for r in raw)
    kept = greedy.reconcile(spark.createDataFrame(raw), Params().precedence, 0.6).where("kept")
    rec = {r["shape"]: r for r in evaluate.recall(kept, ledger.labels(spark)).collect()}
    assert all(r.found == r.instances for r in rec.values()) and sum(r.named for r in rec.values()) >= 10


def test_the_audit_by_blocks_of_time_equals_that_of_one_task(spark, monkeypatch, tmp_path):
    """Ledgers of millions of rows are dealt by blocks of time in every shape that has windows; what follows takes their candidates as they come."""
    spark.createDataFrame([(i, START, 1, "view", -1.0) for i in range(4)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    e, params = ledger.ledger(spark, str(tmp_path)), Params()

    def audit():
        decided = greedy.reconcile(detectors.detect_raw(e, params), params.precedence, params.overlap)
        recalled = evaluate.summary(evaluate.recall(decided.where("kept"), ledger.labels(spark))).first()
        return sorted((r.candidate_id, r.kept, r.absorber or "", r.confidence) for r in decided.collect()), tuple(recalled)

    want = audit()
    for module, name in ((detectors, "time_block"), (detectors, "account_block"), (windows, "account_block")):
        monkeypatch.setattr(module, name, lambda *_: windows.DAY_US)
    assert len(want[0]) > 10 and want[1][1] == 1.0 and audit() == want


def test_tables_of_detectors_in_threads_belong_to_the_caller(spark):
    from paytrail.plans import cut

    before = list(cut._left)
    with cut.owned() as own:
        detectors.detect_raw(edges(spark, [("a", "b", 100, 0), ("b", "c", 90, 1), ("c", "a", 80, 2)])).count()
    assert len(own) >= 9 and cut._left == before
    cut.release(spark, own)


def test_empty_ledger(spark):
    none = edges(spark, [])
    assert detectors.detect_raw(none).count() == 0
    assert all(f(none, Params()).count() == 0 for f in detectors.detectors().values())


def test_settings_are_checked():
    assert Params.from_yaml("fan_min: 6\nthresholds: [5000]").thresholds == (5000,)
    for bad in ("fan_size: 3", "band_fraction: 2", "window_days: 0", "precedence: [cycle]", "conservation: [3, 1]"):
        with pytest.raises(ValueError):
            Params.from_yaml(bad)
    with pytest.raises(ValueError):
        Weights(tightness=0.9)
    assert list(detectors.detectors()) == list(Params().precedence) and len(list(itertools.chain(Params().precedence))) == 9


def paths_brute(legs, least=1, span=14, most=25):
    """(positions, closed) of all simple paths forward in time, and those of them that no open one goes on from."""
    every, open_ones = [], [([i], [*dict.fromkeys(leg[:2])], leg) for i, leg in enumerate(legs)]
    kept = []
    every += [(p, False) for p, _, _ in open_ones]
    while open_ones:
        longer = []
        for path, visited, last in open_ones:
            goes_on = False
            for i, (s, r, _, day) in enumerate(legs):
                if s == last[1] and 0 <= day - last[3] <= span and len(path) < most:
                    home = r == legs[path[0]][0]
                    if home:
                        every.append(([*path, i], True))
                        kept.append(every[-1])
                    elif r not in visited:
                        goes_on = True
                        longer.append(([*path, i], [*visited, r], legs[i]))
                        every.append(([*path, i], False))
            if not goes_on:
                kept.append((path, False))
        open_ones = longer
    order = lambda rows: sorted((tuple(p), c) for p, c in rows if len(p) >= least)
    return order(every), order(kept)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("most", [None, 4])
def test_paths_and_chains_against_brute_force(spark, seed, most):
    rng = random.Random(seed)
    legs = [(f"a{rng.randrange(13)}", f"a{rng.randrange(13)}", 100, rng.randrange(45)) for _ in range(44)] + [("s", "s", 1, 0), ("s", "s", 1, 1), ("s", "a1", 1, 2), ("a1", "s", 1, 3)]
    e, params = edges(spark, legs), Params(cycle_max_hops=most)
    every, kept = paths_brute(legs, most=most or 99)
    got = detectors.temporal_paths(e, params, refs=True).collect()
    assert sorted((tuple(r.path), r.closed) for r in got) == every and all(r.refs == [f"T{i:04d}" for i in r.path] and r.hops == len(r.path) for r in got)
    assert sorted((tuple(r.path), r.closed) for r in detectors.chains(e, params).collect()) == [k for k in kept if len(k[0]) >= 3]
    assert any(len(p) > 4 for p, _ in paths_brute(legs, most=99)[0])


def test_the_ledger_is_read_for_the_first_joins_only(spark, monkeypatch):
    """Later hops take their legs from the paths found so far."""
    wrote, cut = [], detectors.counted_cut
    monkeypatch.setattr(detectors, "counted_cut", lambda df, label: wrote.append(df._jdf.queryExecution().analyzed().toString()) or cut(df, label))
    detectors.chains(edges(spark, [(f"a{i}", f"a{i + 1}", 100, i) for i in range(7)]))
    assert len(wrote) == 6 and "LogicalRDD" in wrote[0] and not any("LogicalRDD" in w for w in wrote[1:])


def test_a_layered_fan_joins_the_ledger_with_itself_once(spark, monkeypatch):
    """What follows reads the legs from a table; the ledger gives only the hand-offs and the roots again."""
    legs = [(f"x{b}{i}", f"b{b}", 1500, i) for b in range(2) for i in range(3)] + [(f"b{b}", "root", 4400, 5) for b in range(2)]
    wrote, cut = [], detectors.cut
    monkeypatch.setattr(detectors, "cut", lambda df, label: wrote.append(label) or cut(df, label))
    out = detectors.layered_fan(edges(spark, legs), "in")
    assert wrote == ["legs", "branches"] and out._jdf.queryExecution().analyzed().toString().count("LogicalRDD") == 2
    (row,) = out.collect()
    assert (row.anchor, row.branch_count, row.leaf_count, row.n) == ("root", 2, 6, 8)
