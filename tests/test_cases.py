"""Case selection and walks against plain restatements."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from paytrail.operators import cases
from paytrail.operators.windows import running_total


def chosen_brute(rows, total, priority, share, min_size):
    ranks = {p: k for k, p in enumerate(priority)}
    used, kept = set(), []
    for case, shape, size, accounts in sorted((r for r in rows if r[1] in ranks and r[2] >= min_size), key=lambda r: (ranks[r[1]], -r[2], r[0])):
        if used.isdisjoint(accounts):
            used.update(accounts)
            kept.append((case, shape, size))
    out, running = [], 0
    for place, (case, shape, size) in enumerate(kept, 1):
        running += size
        if running > total * share + 1e-9:
            break
        out.append((place, case, shape, size, running))
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("fold", [10**6, 0])
def test_selection_against_brute_force(spark, seed, fold):
    rng = random.Random(seed)
    rows = [(f"c{i:03d}", rng.choice("xyzw"), rng.randint(1, 9), [f"a{rng.randrange(80)}" for _ in range(rng.randint(0, 4))]) for i in range(120)]
    rows += [(f"h{i:03d}", "x", 5, ["hot", f"a{i}"]) for i in range(60)]  # an account of a third of the cases
    frame = spark.createDataFrame(rows, "case_id string, shape string, size long, accounts array<string>")
    for total, rotation in ((10_000, 0), (400, 1), (0, 2)):
        got = cases.select_cases(frame, total, "xyz", 0.1, rotation, 3, fold)
        want = chosen_brute(rows, total, cases.rotated("xyz", rotation), 0.1, 3)
        assert [tuple(r) for r in got.orderBy("place").collect()] == want
        assert sum(r[3] for r in want) <= total * 0.1
    assert cases.select_cases(frame.limit(0), 100, "xyz").count() == 0 == cases.select_cases(frame, 100, "").count()


def walks_brute(edges, hops):
    outs = defaultdict(list)
    for pos, s, r in sorted(edges):
        outs[s].append((pos, r))
    found = {}
    for start in list(outs):
        node, visited, path, closed = start, {start}, [], False
        while len(path) < hops and not closed:
            step = next((x for x in outs[node] if x[1] == start or x[1] not in visited), None)
            if step is None:
                break
            path.append(step[0])
            closed, node = step[1] == start, step[1]
            visited.add(node)
        found[start] = (path, closed)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_walks_against_brute_force(spark, seed):
    rng = random.Random(seed)
    n = (8, 25, 60)[seed]
    edges = [(i, f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for i in range(90)] + [(1000 + i, "busy", f"n{i % n}") for i in range(40)]
    frame = spark.createDataFrame(edges, "pos long, sender_account string, receiver_account string")
    for hops in (3, 10):
        assert {r.start: (r.path, r.closed) for r in cases.walks(frame, hops).collect()} == walks_brute(edges, hops)
    left, want = edges, []
    for place in range(1, 4):
        best = max(walks_brute(left, 6).items(), key=lambda x: (len(x[1][0]), -x[1][0][0]))
        if len(best[1][0]) < 3:
            break
        want.append((place, best[0], best[1][0]))
        left = [e for e in left if e[0] not in best[1][0]]
    assert [(r.place, r.start, r.path) for r in cases.longest_walks(frame, 3, 3, 6).orderBy("place").collect()] == want
    assert cases.longest_walks(frame.limit(0), 3).count() == 0


def test_admissible_cases(spark):
    rows = spark.createDataFrame([("structuring", True, "k"), ("structuring", False, "k"), ("structuring", None, "k"), ("fan_in", True, "k"), ("fan_in", True, None), (None, None, "k")], "shape string, aligned boolean, key string")
    rule = lambda *a: [r[0] for r in rows.select(cases.admissible(F.col("shape"), F.col("aligned"), F.col("key"), *a)).collect()]
    own = [r[0] for r in rows.select(F.coalesce(cases.partition_of(F.col("key")) == "dev", F.lit(False))).collect()]
    assert rule() == [True] * 6 and rule("any", "dev") == own
    assert rule("aligned") == [True, False, False, True, True, True] and rule("aligned", "dev") == [True, False, False, *own[3:]]
    assert rule("exclude_aligned") == [False, True, True, True, True, True]
    with pytest.raises(ValueError):
        cases.admissible(F.col("shape"), F.col("aligned"), F.col("key"), "some")


def test_running_totals_over_many_tasks(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(-5, 9)) for i in rng.sample(range(10_000), 3000)]
    got = running_total(spark.createDataFrame(rows, "k long, x long").repartition(7), [F.col("k")], {"t": F.col("x"), "n": F.lit(1)})
    total, want = 0, []
    for n, (k, x) in enumerate(sorted(rows), 1):
        total += x
        want.append((k, x, total, n))
    assert sorted(map(tuple, got.collect())) == want


def test_longest_walks_from_early_starts_are_those_of_all(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(i, f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for i in range(60)]
    frame = spark.createDataFrame(edges, "pos long, sender_account string, receiver_account string")
    best = max(walks_brute(edges, 3).items(), key=lambda x: (len(x[1][0]), -x[1][0][0]))
    whole, walked = [], cases._walks
    monkeypatch.setattr(cases, "_walks", lambda *a: whole.append(1) or walked(*a))
    for early in (1, 12):  # the first start alone may not get that far, then all are tried
        assert [(r.place, r.start, r.path) for r in cases.longest_walks(frame, 1, 1, 3, early).collect()] == [(1, best[0], best[1][0])]
    assert len(best[1][0]) == 3 and len(whole) < 2
