"""Queries over the ledger: views, graph questions, detectors, baseline, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytrail.operators import baseline, detectors, evaluate, graph, greedy
from paytrail.sources import ledger as source

from .cut import cut
from .params import DAY_US, HOUR_US, PRECEDENCE, Params
from .registry import ORACLES, query

P = Params()
#: The same without bounds on hops, levels and sides.
ALL = Params(cycle_max_hops=None, max_frontier=None, max_block_side=None)
#: The same without a bound on levels.
LEVELS = Params(max_frontier=None)
WITH = f"with recursive ledger as ({source.ledger_sql('duckdb')})"
FAN_DAYS, HUB_DAYS, FUNNEL_DAYS = P.window_days * DAY_US, P.hub_days * DAY_US, P.funnel_days * DAY_US
REFS = "array_to_string(list_sort(list(distinct txn_ref)), '|')"


def _edges(spark, sf_dir) -> DataFrame:
    return source.ledger(spark, sf_dir)


def _flat(found: DataFrame, *extra: str) -> DataFrame:
    """Candidates with arrays as text and sums as doubles, so that values compare across engines."""
    return found.select("candidate_id", "anchor", F.array_join("refs", "|").alias("refs"), "n", F.col("total").cast("double").alias("total"), "confidence", *extra)


def _score(minimum: int, ratio: str = "0.5") -> str:
    return f"""round(least(1, greatest(0, 0.4 * greatest(0, 1 - least(case when count(*) < 2 or avg(amount::double) = 0 then 0 else coalesce(stddev_samp(amount::double) / avg(amount::double), 0) end, 1))
      + 0.2 * case when count(*) <= {minimum} then 0 else least(1, (count(*) - {minimum}) / {float(minimum)}) end
      + 0.2 * case when count(*) < 2 then 1 else greatest(0, 1 - least((max(us) - min(us)) / {float(DAY_US)} / {P.window_days}, 1)) end
      + 0.2 * {ratio})), 4)"""


def _candidates(pattern: str, source_sql: str, group: str, minimum: int, extra: str = "", having: str = "", ratio: str = "0.5") -> str:
    """SQL that turns member rows into candidates."""
    return f"""select '{pattern}:' || anchor || ':' || sha256({REFS})[1:10] as candidate_id, anchor, {REFS} as refs, count(*) as n, sum(amount)::double as total,
      {_score(minimum, ratio)} as confidence{extra} from ({source_sql}) members group by {group} {having}"""


@query(f"{WITH} select pos, txn_ref, sender_account, receiver_account, amount, ts, payment_kind, sender_country, receiver_country, currency, us from ledger")
def ledger_view(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"{WITH} select txn_ref, amount from ledger where ts >= timestamp '2024-01-01' and ts < timestamp '2024-02-01'")
def period_slice(spark, sf_dir):
    return source.period_slice(_edges(spark, sf_dir), "2024-01").select("txn_ref", "amount")


@query(f"{WITH} select strftime(min(ts), '%Y-%m') as period, count(*) as n, sum(amount) as total from ledger")
def period_of_batch(spark, sf_dir):
    return _edges(spark, sf_dir).agg(F.date_format(F.min("ts"), "yyyy-MM").alias("period"), F.count("*").alias("n"), F.sum("amount").alias("total"))


@query(f"{WITH} select payment_kind, count(*) as n, sum(amount) as total from ledger group by 1")
def payment_kind_counts(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("payment_kind").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@query(f"{WITH} select sender_country || '->' || receiver_country as corridor, sender_country <> receiver_country as cross_border, count(*) as n, sum(amount) as total from ledger group by 1, 2")
def corridor_totals(spark, sf_dir):
    s, r = F.col("sender_country"), F.col("receiver_country")
    return _edges(spark, sf_dir).groupBy(F.concat_ws("->", s, r).alias("corridor"), (s != r).alias("cross_border")).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


DEGREES = """i as (select receiver_account as node, count(distinct sender_account) as payers from ledger where sender_account <> receiver_account group by 1),
o as (select sender_account as node, count(distinct receiver_account) as payees from ledger where sender_account <> receiver_account group by 1),
degrees as (select coalesce(i.node, o.node) as node, coalesce(payers, 0) as payers, coalesce(payees, 0) as payees from i full join o on i.node = o.node)"""


@query(f"{WITH}, {DEGREES} select * from degrees")
def account_degrees(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@query(f"{WITH}, {DEGREES} select * from degrees where payers >= 3 and payees >= 3")
def hub_nodes(spark, sf_dir):
    return graph.hub_nodes(_edges(spark, sf_dir), P.hub_min_in, P.hub_min_out)


@query(f"{WITH} select sender_account, receiver_account, string_agg(txn_ref, '|' order by us, txn_ref) as refs from ledger group by 1, 2")
def edge_refs(spark, sf_dir):
    return graph.edge_refs(_edges(spark, sf_dir)).withColumn("refs", F.array_join("refs", "|"))


def _layers_sql(bound: str) -> str:
    return f"""{WITH}, {DEGREES},
pay as (select distinct receiver_account as node, sender_account as other from ledger where sender_account <> receiver_account),
l0 as (select node as root, node as account from degrees where payers >= 6),
n1 as (select distinct root, other as account from l0 join pay on pay.node = l0.account where other <> root),
l1 as (select * from n1 where root in (select root from n1 group by root {bound})),
n2 as (select distinct root, other as account from l1 join pay on pay.node = l1.account where other <> root and (root, other) not in (select (root, account) from l1)),
l2 as (select * from n2 where root in (select root from n2 group by root {bound})),
n3 as (select distinct root, other as account from l2 join pay on pay.node = l2.account where other <> root and (root, other) not in (select (root, account) from l1) and (root, other) not in (select (root, account) from l2)),
l3 as (select * from n3 where root in (select root from n3 group by root {bound}))
select root, 1 as level, account from l1 union all select root, 2, account from l2 union all select root, 3, account from l3"""


def _layers(spark, sf_dir, params: Params) -> DataFrame:
    edges = _edges(spark, sf_dir)
    roots = graph.degrees(edges).where("payers >= 6").select(F.col("node").alias("root"))
    return graph.multi_hop_layers(edges, roots, "in", 3, params).where("level > 0").select("root", "level", "account")


@query(_layers_sql("having count(*) <= 200"))
def multi_hop_layers(spark, sf_dir):
    return _layers(spark, sf_dir, P)


@query(_layers_sql(""))
def multi_hop_layers_unbounded(spark, sf_dir):
    """Levels of any width."""
    return _layers(spark, sf_dir, ALL)


def _fan_sql(pattern: str, key: str, other: str, count: str) -> str:
    members = f"""select l.{key} as anchor, l.txn_ref, l.amount, l.us, l.{other} as other from ledger l join best b on l.{key} = b.k and l.us between b.lo and b.hi"""
    return f"""{WITH}, seen as (select {key} as k, us as hi, min(us) over w as lo, count(*) over w as c, len(list_distinct(list({other}) over w)) as d from ledger window w as (partition by {key} order by us range between {FAN_DAYS} preceding and current row)),
best as (select k, arg_max(lo, c * 100000000000000000::hugeint - hi) as lo, arg_max(hi, c * 100000000000000000::hugeint - hi) as hi from seen where d >= {P.fan_min} group by k)
{_candidates(pattern, members, "anchor", P.fan_min, f", count(distinct other) as {count}")}"""


@query(_fan_sql("fan_in", "receiver_account", "sender_account", "distinct_senders"))
def fan_in(spark, sf_dir):
    return _flat(detectors.fan_in(_edges(spark, sf_dir), P), "distinct_senders")


@query(_fan_sql("fan_out", "sender_account", "receiver_account", "distinct_recipients"))
def fan_out(spark, sf_dir):
    return _flat(detectors.fan_out(_edges(spark, sf_dir), P), "distinct_recipients")


RUNS = f"""banded as (
  select side, case side when 'originator' then sender_account else receiver_account end as anchor, t as threshold, txn_ref, amount, us
  from ledger cross join (values ('originator'), ('beneficiary')) s(side) cross join (values {", ".join(f"({t}, {P.band(t)[0]}, {P.band(t)[1]})" for t in P.thresholds)}) b(t, lo, hi)
  where amount >= lo and amount < hi),
numbered as (select *, row_number() over (partition by side, anchor, threshold order by us, txn_ref) as rn from banded),
starts as (select *, min(rn) over (partition by side, anchor, threshold order by us range between {FAN_DAYS} preceding and current row) as run_s from numbered),
runs as (select side, anchor, threshold, run_s, max(rn) as run_e from starts group by all having max(rn) - run_s + 1 >= {P.structuring_min})"""


@query(f"""{WITH}, {RUNS} select side, anchor, threshold, run_s, run_e, string_agg(txn_ref, '|' order by rn) as refs, sum(amount) as total
from runs join numbered using (side, anchor, threshold) where rn between run_s and run_e group by all""")
def structuring_runs(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    rows = detectors.structuring_runs(edges, "originator", P).unionByName(detectors.structuring_runs(edges, "beneficiary", P))
    refs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "txn_ref"))), lambda x: x["txn_ref"]), "|")
    return rows.groupBy("side", "anchor", "threshold", "run_s", "run_e").agg(refs.alias("refs"), F.sum("amount").alias("total"))


def _chosen(name: str, spans: str) -> str:
    """Recursive CTE ``name``: of an account's runs in order, those that don't reach back into the last one taken."""
    return f"""{name}_o as (select *, row_number() over (partition by anchor, threshold order by run_s, run_e) as k from ({spans})),
{name}_f as (select anchor, threshold, k, run_s, run_e, true as taken, run_e as last from {name}_o where k = 1
  union all select o.anchor, o.threshold, o.k, o.run_s, o.run_e, o.run_s > f.last, case when o.run_s > f.last then o.run_e else f.last end
  from {name}_f f join {name}_o o on o.anchor = f.anchor and o.threshold = f.threshold and o.k = f.k + 1),
{name} as (select r.side, r.anchor, r.threshold, f.run_s, r.txn_ref, r.amount, r.us from {name}_f f join numbered r on r.anchor = f.anchor and r.threshold = f.threshold and r.rn between f.run_s and f.run_e where taken and r.side = """


@query(f"""{WITH}, {RUNS}, {_chosen("first", "select * from runs where side = 'originator'")}'originator'),
touched as (select distinct r.anchor, r.threshold, r.run_s from runs r join numbered n on n.side = r.side and n.anchor = r.anchor and n.threshold = r.threshold and n.rn between r.run_s and r.run_e
  where r.side = 'beneficiary' and n.txn_ref in (select txn_ref from first)),
{_chosen("second", "select * from runs r where side = 'beneficiary' and not exists (select 1 from touched t where t.anchor = r.anchor and t.threshold = r.threshold and t.run_s = r.run_s)")}'beneficiary')
{_candidates("structuring", "select * from first union all select * from second", "anchor, threshold, side, run_s", P.structuring_min, ", threshold, side", ratio="least(1, sum(amount)::double / threshold / 2)")}""")
def structuring(spark, sf_dir):
    return _flat(detectors.structuring(_edges(spark, sf_dir), P), "threshold", "side")


@query(f"""{WITH}, hops as (select a.sender_account as source, b.receiver_account as sink, a.receiver_account as mid, a.txn_ref as r1, a.amount as m1, a.us as u1, b.txn_ref as r2, b.amount as m2, b.us as u2
  from ledger a join ledger b on a.receiver_account = b.sender_account and b.us between a.us and a.us + {FAN_DAYS} and b.receiver_account <> a.sender_account),
wide as (select source, sink, count(distinct mid) as fan from hops group by 1, 2 having count(distinct mid) >= {P.scatter_min})
{_candidates("scatter_gather", "select source as anchor, sink, fan, r1 as txn_ref, m1 as amount, u1 as us from hops join wide using (source, sink) union select source, sink, fan, r2, m2, u2 from hops join wide using (source, sink)", "anchor, sink, fan", 2 * P.scatter_min, ", sink, fan")}""")
def scatter_gather(spark, sf_dir):
    return _flat(detectors.scatter_gather(_edges(spark, sf_dir), P), "sink", "fan")


@query(f"""{WITH}, legs as (select receiver_account as anchor, sender_account as other, txn_ref, amount, us, true as inflow from ledger where sender_account <> receiver_account
  union all select sender_account, receiver_account, txn_ref, amount, us, false from ledger where sender_account <> receiver_account),
seen as (select anchor, inflow, us as lo, count(*) over w as c, len(list_distinct(list(case when inflow then other end) over w)) as i, len(list_distinct(list(case when not inflow then other end) over w)) as o
  from legs window w as (partition by anchor order by us range between current row and {HUB_DAYS} following)),
best as (select anchor, arg_max(lo, c * 100000000000000000::hugeint - lo) as lo from seen where inflow and i >= {P.hub_min_in} and o >= {P.hub_min_out} group by 1)
{_candidates("gather_scatter", f"select legs.* from legs join best using (anchor) where us between lo and lo + {HUB_DAYS}", "anchor", P.hub_min_in + P.hub_min_out, ", count(distinct other) filter (inflow) as distinct_senders, count(distinct other) filter (not inflow) as distinct_recipients, round(sum(amount) filter (not inflow)::double / sum(amount) filter (inflow)::double, 4) as conservation", f"having sum(amount) filter (not inflow)::double / sum(amount) filter (inflow)::double between {P.conservation[0]} and {P.conservation[1]}")}""")
def gather_scatter(spark, sf_dir):
    return _flat(detectors.gather_scatter(_edges(spark, sf_dir), P), "distinct_senders", "distinct_recipients", "conservation")


PAIRS = f"""pairs as (select d.receiver_account as account, d.txn_ref as d_ref, s.txn_ref as s_ref, d.us as d_us, s.us as s_us, d.amount as d_amount, s.amount as s_amount,
    s.payment_kind = 'cross_border' or s.sender_country <> s.receiver_country as cross_leg
  from ledger d join ledger s on d.receiver_account = s.sender_account and d.payment_kind = 'cash_deposit' and s.payment_kind in ({", ".join(f"'{k}'" for k in P.send_kinds)})
    and s.us between d.us and d.us + {P.send_hours * HOUR_US} and abs(s.amount::double / d.amount::double - 1) <= {P.send_tolerance})"""


@query(f"{WITH}, {PAIRS} select account, d_ref, s_ref, s_us - d_us as gap_us from pairs")
def deposit_send_candidates(spark, sf_dir):
    return detectors.deposit_pairs(_edges(spark, sf_dir), P).select("account", F.col("d_txn_ref").alias("d_ref"), F.col("s_txn_ref").alias("s_ref"), (F.col("s_us") - F.col("d_us")).alias("gap_us"))


@query(f"""{WITH}, {PAIRS}, ordered as (select *, row_number() over (partition by account order by d_us, d_ref, s_us, s_ref) as k from pairs),
fold as (select account, k, d_ref, s_ref, true as taken, [d_ref, s_ref] as used from ordered where k = 1
  union all select o.account, o.k, o.d_ref, o.s_ref, not (list_contains(f.used, o.d_ref) or list_contains(f.used, o.s_ref)),
    case when list_contains(f.used, o.d_ref) or list_contains(f.used, o.s_ref) then f.used else f.used || [o.d_ref, o.s_ref] end
  from fold f join ordered o on o.account = f.account and o.k = f.k + 1),
taken as (select o.* from fold f join ordered o using (account, k) where taken)
{_candidates("deposit_send", "select account as anchor, d_ref as txn_ref, d_amount as amount, d_us as us, true as d, cross_leg, (s_us - d_us) / 3600000000.0 as gap from taken union all select account, s_ref, s_amount, s_us, false, cross_leg, (s_us - d_us) / 3600000000.0 from taken", "anchor", 2 * P.send_min_pairs, ", count(*) filter (d) as pairs, round(max(gap), 2)::double as max_gap_hours, bool_or(cross_leg) as cross_border")}""")
def deposit_send(spark, sf_dir):
    return _flat(detectors.deposit_send(_edges(spark, sf_dir), P), "pairs", "max_gap_hours", "cross_border")


def _layered_sql(near: str, far: str, direction: str) -> str:
    return f"""{WITH}, e as (select {near} as near, {far} as far, txn_ref, amount, us from ledger where sender_account <> receiver_account),
level as (select distinct near as root, far as branch from e),
roots as (select root from level group by 1 having count(*) between {P.branch_min} and {P.max_frontier}),
legs as (select distinct t.near as root, t.far as branch, l.far as leaf, l.txn_ref, l.amount, l.us from e t join roots on roots.root = t.near join e l on l.near = t.far and abs(l.us - t.us) <= {FUNNEL_DAYS}
  where l.far <> t.near and not exists (select 1 from level v where v.root = t.near and v.branch = l.far)),
branches as (select root, branch from legs group by 1, 2 having count(distinct leaf) >= {P.branch_min_leaves}),
own as (select legs.* from legs join branches using (root, branch)),
fine as (select root, count(distinct branch) as branch_count, count(distinct leaf) as leaf_count from own group by 1 having count(distinct branch) >= {P.branch_min} and count(distinct leaf) >= {P.leaves_min})
{_candidates("layered_fan", "select root as anchor, branch_count, leaf_count, txn_ref, amount, us from own join fine using (root) union all select b.root, branch_count, leaf_count, e.txn_ref, e.amount, e.us from branches b join fine using (root) join e on e.near = b.root and e.far = b.branch", "anchor, branch_count, leaf_count", P.leaves_min + P.branch_min, f", '{direction}' as direction, branch_count, leaf_count")}"""


@query(_layered_sql("receiver_account", "sender_account", "in"))
def layered_fan_in(spark, sf_dir):
    return _flat(detectors.layered_fan(_edges(spark, sf_dir), "in", P), "direction", "branch_count", "leaf_count")


@query(_layered_sql("sender_account", "receiver_account", "out"))
def layered_fan_out(spark, sf_dir):
    return _flat(detectors.layered_fan(_edges(spark, sf_dir), "out", P), "direction", "branch_count", "leaf_count")


PATHS = f"""paths as (
  select [txn_ref] as refs, list_distinct([sender_account, receiver_account]) as visited, sender_account as origin, receiver_account as cur, us, 1 as hops, false as closed, amount as first_amount, amount as last_amount from ledger
  union all select p.refs || [e.txn_ref], p.visited || [e.receiver_account], p.origin, e.receiver_account, e.us, p.hops + 1, e.receiver_account = p.origin, p.first_amount, e.amount
  from paths p join ledger e on e.sender_account = p.cur
  where not p.closed and p.hops < {P.cycle_max_hops} and e.us between p.us and p.us + {FAN_DAYS} and (e.receiver_account = p.origin or not list_contains(p.visited, e.receiver_account)))"""


@query(f"{WITH}, {PATHS} select array_to_string(refs, '|') as refs, hops, closed from paths")
def temporal_paths(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return detectors.temporal_paths(edges, P, refs=True).select(F.array_join("refs", "|").alias("refs"), "hops", "closed")


@query(f"{WITH}, {PATHS} select origin, array_to_string(refs, '|') as refs, hops from paths where closed and hops >= {P.cycle_min_hops}")
def cycle_rings(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return detectors.with_refs(detectors.chains(edges, P).where("closed"), edges).select("origin", F.array_join("refs", "|").alias("refs"), "hops")


@query(f"{WITH}, {PATHS.replace(f'and p.hops < {P.cycle_max_hops} ', '')} select origin, array_to_string(refs, '|') as refs, hops from paths where closed and hops >= {P.cycle_min_hops}")
def cycle_rings_unbounded(spark, sf_dir):
    """Rings of any length: the bound on hops lifted."""
    edges = _edges(spark, sf_dir)
    return detectors.with_refs(detectors.chains(edges, ALL).where("closed"), edges).select("origin", F.array_join("refs", "|").alias("refs"), "hops")


@query(f"""{WITH}, {PATHS}, longer as (select distinct refs[1:hops - 1] as refs from paths where not closed and hops > 1)
select origin, array_to_string(refs, '|') as refs, hops, closed from paths p where hops >= {P.cycle_min_hops} and (closed or not exists (select 1 from longer l where l.refs = p.refs))""")
def cycle_chains(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return detectors.chains(edges, P, refs=True).select("origin", F.array_join("refs", "|").alias("refs"), "hops", "closed")


def _kept_sql(sets: str) -> str:
    """SQL of the ordered fold over ``sets`` (``no`` from 1, ``refs``): ``no`` of those that stay."""
    return f"""pick as (select 0::bigint as no, []::varchar[][] as kept, false as took
  union all
  select no, case when goes then kept else kept || [refs] end, not goes from (
    select c.no, p.kept, c.refs, len(list_filter(p.kept, lambda k: len(list_intersect(k, c.refs)) / len(c.refs)::double > {P.overlap})) > 0 as goes from pick p join {sets} c on c.no = p.no + 1)),
stay as (select no from pick where took)"""


CYCLES = f"""longer as (select distinct refs[1:hops - 1] as refs from paths where not closed and hops > 1),
rings as (select *, row_number() over (order by hops desc, refs) as no from paths p where hops >= {P.cycle_min_hops} and last_amount::double / first_amount::double >= {P.retained}
  and (closed or not exists (select 1 from longer l where l.refs = p.refs)))"""


@query(f"""{WITH}, {PATHS}, {CYCLES}, {_kept_sql('rings')},
legs as (select no, origin as anchor, hops, round(last_amount::double / first_amount::double, 4) as retained_fraction, unnest(refs) as txn_ref from rings join stay using (no))
{_candidates("cycle", "select legs.*, amount, us from legs join ledger using (txn_ref)", "no, anchor, hops, retained_fraction", P.cycle_min_hops, ", hops, retained_fraction")}""")
def cycle(spark, sf_dir):
    return _flat(detectors.cycle(_edges(spark, sf_dir), P), "hops", "retained_fraction")


LINKS = f"""pairs as (select distinct sender_account, receiver_account from ledger where sender_account <> receiver_account),
modest as (select receiver_account from pairs group by 1 having count(*) <= {P.max_block_side}),
eligible as (select * from pairs where receiver_account in (select receiver_account from modest)),
able as (select sender_account from eligible group by 1 having count(*) >= {P.block_min_dst}),
own as (select * from eligible where sender_account in (select sender_account from able)),
links as (select a.sender_account as a, b.sender_account as b, count(*) as shared from own a join own b on a.receiver_account = b.receiver_account and a.sender_account < b.sender_account group by 1, 2 having count(*) >= {P.block_min_dst})"""
BLOCKS = f"""{LINKS},
reach as (select a as x, a as y from links union select b, b from links union select r.x, case when l.a = r.y then l.b else l.a end from reach r join links l on l.a = r.y or l.b = r.y),
grp as (select x as sender_account, min(y) as root from reach group by 1),
sized as (select root from grp group by 1 having count(*) >= {P.block_min_src}),
hit as (select g.root, o.sender_account, o.receiver_account from own o join grp g using (sender_account) where g.root in (select root from sized)),
shared as (select root, receiver_account from hit h group by 1, 2 having count(*) >= 2 and not exists (select 1 from grp g where g.root = h.root and g.sender_account = h.receiver_account)),
wide as (select root from shared group by 1 having count(*) >= {P.block_min_dst}),
bp as (select h.* from hit h join shared using (root, receiver_account) where h.root in (select root from wide)),
sides as (select root, array_to_string(list_sort(list(distinct receiver_account)), ',') as receivers, count(distinct receiver_account) as r, count(*) as p from bp group by 1),
send as (select root, array_to_string(list_sort(list(distinct sender_account)), ',') as senders, count(*) as s from grp where root in (select root from wide) group by 1),
brefs as (select root, {REFS} as refs from bp join ledger using (sender_account, receiver_account) group by 1)"""


@query(f"{WITH}, {LINKS} select * from links")
def bipartite_pairs(spark, sf_dir):
    return detectors.sender_pairs(_edges(spark, sf_dir), P)[1]


@query(f"{WITH}, {LINKS.replace(f' having count(*) <= {P.max_block_side}', '')} select * from links")
def bipartite_pairs_unbounded(spark, sf_dir):
    """Linked senders, receivers of any number of senders among them."""
    return detectors.sender_pairs(_edges(spark, sf_dir), ALL)[1]


@query(f"{WITH}, {BLOCKS} select root as block, senders, receivers, refs, round(p / (s * r), 4) as density from sides join send using (root) join brefs using (root)")
def bipartite_blocks(spark, sf_dir):
    found = detectors.bipartite_blocks(_edges(spark, sf_dir), P)
    return found.select("block", F.array_join("senders", ",").alias("senders"), F.array_join("receivers", ",").alias("receivers"), F.array_join("refs", "|").alias("refs"), "density")


STACKS = f"""{BLOCKS},
dense as (select root as block, senders, receivers, refs, round(p / (s * r), 4) as density from sides join send using (root) join brefs using (root) where p / (s * r) >= {P.block_density}),
met as (select distinct a, b from (select block as a, unnest(string_split(receivers, ',')) as x from dense) u join (select block as b, unnest(string_split(senders, ',')) as x from dense) d using (x) where a <> b),
climb as (select block as x, block as y from dense union select x, case when m.a = y then m.b else m.a end from climb join met m on m.a = y or m.b = y),
stacks as (select x as block, min(y) as stack from climb group by 1),
bodies as (select stack, count(*) as layers, array_to_string(list_sort(list_distinct(flatten(list(string_split(senders, ','))))), ',') as senders,
  array_to_string(list_sort(list_distinct(flatten(list(string_split(receivers, ','))))), ',') as receivers, min(density) as density from dense join stacks using (block) group by 1),
parts as (select distinct stack, txn_ref from (select stack, unnest(string_split(refs, '|')) as txn_ref from dense join stacks using (block)))"""


@query(f"""{WITH}, {STACKS} {_candidates("bipartite", "select stack, string_split(senders, ',')[1] as anchor, layers, senders, receivers, density, txn_ref, amount, us from parts join ledger using (txn_ref) join bodies using (stack)",
  "stack, anchor, layers, senders, receivers, density", P.block_min_src * P.block_min_dst, ", layers, senders, receivers, density", f"having max(us) - min(us) <= {P.block_days * DAY_US}")}""")
def bipartite(spark, sf_dir):
    return _flat(detectors.bipartite(_edges(spark, sf_dir), P), "layers", "senders", "receivers", "density")


def _audit(spark, sf_dir, params: Params = ALL):
    edges = cut(_edges(spark, sf_dir), "ledger")
    return edges, greedy.reconcile(detectors.detect_raw(edges, params), params.precedence, params.overlap)


@query()
def detect_all_raw(spark, sf_dir):
    return _flat(detectors.detect_raw(cut(_edges(spark, sf_dir), "ledger"), ALL), "pattern_type", "attributes")


SHAPES = {**{p: (p,) for p in PRECEDENCE}, "layered_fan": ("layered_fan_in", "layered_fan_out")}
#: All candidates in order, each with the first one before it that stays and covers it.
DECIDED = f"""found as ({" union all ".join(f"select candidate_id, '{p}' as pattern_type, string_split(refs, '|') as refs from ({ORACLES[q]})" for p, qs in SHAPES.items() for q in qs)}),
ordered as (select *, row_number() over (order by list_position([{", ".join(f"'{p}'" for p in PRECEDENCE)}], pattern_type), -len(refs), candidate_id) as no from found),
pick as (select 0::bigint as no, []::varchar[][] as kept, []::varchar[] as ids, null::varchar as absorber
  union all
  select no, case when hit is null then kept || [refs] else kept end, case when hit is null then ids || [candidate_id] else ids end, ids[hit] from (
    select c.no, p.kept, p.ids, c.refs, c.candidate_id, nullif(list_position(list_transform(p.kept, lambda k: len(list_intersect(k, c.refs)) / len(c.refs)::double > {P.overlap}), true), 0) as hit from pick p join ordered c on c.no = p.no + 1)),
decided as (select candidate_id, pattern_type, refs, absorber is null as kept, absorber from ordered join pick using (no))"""


#: The same with levels of any width.
DECIDED_LEVELS = DECIDED.replace(f"between {P.branch_min} and {P.max_frontier}", f">= {P.branch_min}")
#: The same without any bound.
DECIDED_ALL = DECIDED_LEVELS.replace(f" having count(*) <= {P.max_block_side}", "").replace(f"and p.hops < {P.cycle_max_hops} ", "")


@query(f"with recursive {DECIDED_ALL} select candidate_id, pattern_type, kept, absorber from decided")
def reconcile(spark, sf_dir):
    return _audit(spark, sf_dir)[1].select("candidate_id", "pattern_type", "kept", "absorber")


@query()
def detect_all(spark, sf_dir):
    """Kept candidates with their evidence and a sentence about the shape."""
    edges, found = _audit(spark, sf_dir)
    kept = cut(found.where("kept").drop("kept", "absorber"), "kept")
    shown = kept.join(graph.edge_lines(graph.subgraph(edges, kept)), "candidate_id")
    return shown.select("candidate_id", "pattern_type", "anchor", F.array_join("refs", "|").alias("refs"), "n", F.col("total").cast("double").alias("total"), "confidence", "attributes", evaluate.describe().alias("shape"), F.col("lines").alias("evidence"))


BASE = f"""sides as (select txn_ref, amount, cast(ts as date) as day, sender_account as account, receiver_account as other from ledger union all select txn_ref, amount, cast(ts as date), receiver_account, sender_account from ledger),
days as (select account, day from sides group by 1, 2 having sum(amount) >= {baseline.REPORT} and count(*) > 1),
busy as (select account from sides group by 1 having count(distinct other) >= {baseline.PARTIES}),
alerts as (select 'R1' as rule, txn_ref, sender_account as account from ledger where amount >= {baseline.REPORT}
  union all select 'R2', txn_ref, sender_account from ledger where amount >= {baseline.BAND} and amount < {baseline.REPORT}
  union all select 'R5', txn_ref, sender_account from ledger where amount >= {baseline.RECORD}
  union all select 'R3', txn_ref, account from sides join days using (account, day)
  union all select 'R4', txn_ref, account from sides where account in (select account from busy))"""


@query(f"{WITH}, {BASE} select * from alerts")
def baseline_alerts(spark, sf_dir):
    return baseline.baseline_alerts(_edges(spark, sf_dir))


@query(f"{WITH}, {BASE} select rule, count(*) as alerts, count(distinct txn_ref) as rows_flagged from alerts group by 1")
def baseline_by_rule(spark, sf_dir):
    return baseline.baseline_alerts(_edges(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("alerts"), F.countDistinct("txn_ref").alias("rows_flagged"))


@query(f"{WITH}, {BASE} select (select count(distinct txn_ref) from alerts) as flagged, (select count(*) from ledger) as total, round((select count(distinct txn_ref) from alerts) / (select count(*) from ledger), 6) as share")
def baseline_alert_volume(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    flagged = baseline.baseline_alerts(edges).agg(F.countDistinct("txn_ref").alias("flagged"))
    return flagged.crossJoin(edges.agg(F.count("*").alias("total"))).withColumn("share", F.round(F.col("flagged") / F.col("total"), 6))  # one row each


RECALLED = f"""{DECIDED_LEVELS}, planted as ({source.labels_sql()}),
hits as (select pattern_type, shape, instance, txn_ref from (select pattern_type, unnest(refs) as txn_ref from decided where kept) join planted using (txn_ref)),
reached as (select instance, count(distinct txn_ref) as n, count(distinct txn_ref) filter (pattern_type = shape) as own from hits group by 1),
sizes as (select instance, shape, count(*) as size from planted group by 1, 2),
recalled as (select shape, count(*) as instances, count(*) filter (coalesce(n, 0) >= size * 0.5) as found, count(*) filter (coalesce(own, 0) >= size * 0.5) as named from sizes left join reached using (instance) group by 1)"""


@query(f"with recursive {RECALLED} select * from recalled")
def recall_by_pattern(spark, sf_dir):
    edges, found = _audit(spark, sf_dir, LEVELS)
    return evaluate.recall(found.where("kept"), source.labels(spark))


@query(f"with recursive {RECALLED} select (select sum(instances)::bigint from recalled) as instances, (select round(sum(found) / sum(instances), 6) from recalled) as recall, (select round(sum(named) / sum(instances), 6) from recalled) as named_recall, shape as weakest, round(found / instances, 6) as weakest_recall from recalled order by found / instances, shape limit 1")
def recall_summary(spark, sf_dir):
    """Recall over all shapes, and the shape that is found least (one row is the feature)."""
    return evaluate.summary(recall_by_pattern(spark, sf_dir))


@query(f"""{WITH}, {DECIDED}, flagged as (select count(distinct r) as flagged from (select unnest(refs) as r from decided where kept))
select flagged, (select count(*) from ledger) as total, round(flagged / (select count(*) from ledger), 6) as share from flagged""")
def alert_volume(spark, sf_dir):
    edges, found = _audit(spark, sf_dir, P)
    return evaluate.alert_volume(found.where("kept"), edges)


@query(f"""{WITH}, sides as (select sender_account as account, 's' as side, count(*) as c from ledger group by 1 union all select receiver_account, 'r', count(*) from ledger group by 1)
select account, case when max(case when side = 's' then c else 0 end) >= max(case when side = 'r' then c else 0 end) then 'sender' else 'receiver' end as anchor_side from sides group by 1""")
def anchor_sides(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    side = F.explode(F.array(F.struct(F.col("sender_account").alias("account"), F.lit(True).alias("s")), F.struct(F.col("receiver_account").alias("account"), F.lit(False).alias("s")))).alias("x")
    return edges.select(side).select("x.*").groupBy("account").agg(F.when(F.count_if("s") >= F.count_if(~F.col("s")), "sender").otherwise("receiver").alias("anchor_side"))


@query(f"{WITH} select sender_account, case when ('0x' || sha256(sender_account)[1:2])::int % 2 = 0 then 'dev' else 'eval' end as part, count(*) as n from ledger group by 1, 2")
def dev_eval_partition(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("sender_account", evaluate.partition_of(F.col("sender_account")).alias("part")).agg(F.count("*").alias("n"))


@query(f"{WITH} select l.txn_ref, l.amount from ledger l where not exists (select 1 from ({source.labels_sql()}) p where p.txn_ref = l.txn_ref)")
def background_rows(spark, sf_dir):
    return _edges(spark, sf_dir).join(source.labels(spark).select("txn_ref"), "txn_ref", "left_anti").select("txn_ref", "amount")


@query(f"""{WITH}, drawn as (select shape, instance, txn_ref, row_number() over (partition by shape, instance order by us, txn_ref) as depth from ledger join ({source.labels_sql()}) l using (txn_ref))
select * from (select *, row_number() over (partition by shape order by depth, instance) as place from drawn) where place <= 5""")
def golden_round_robin(spark, sf_dir):
    """The first five rows of every shape, one of each of its instances in turn, as a labelled set draws them (the limit is the feature)."""
    rows = _edges(spark, sf_dir).select("txn_ref", "us").join(source.labels(spark), "txn_ref")
    return evaluate.round_robin_batches(rows, "shape", "instance", ["us", "txn_ref"], 5).select("shape", "instance", "txn_ref", "depth", "place")


@query(f"""{WITH}, seen as (select distinct l.txn_ref from ledger l), planted as ({source.labels_sql()}) select 'missing' as kind, txn_ref from planted where txn_ref not in (select txn_ref from seen)
union all select 'unlabelled', txn_ref from seen where txn_ref not in (select txn_ref from planted)""")
def dataset_drift(spark, sf_dir):
    """What a labelled set and the ledger don't share: EXCEPT both ways."""
    planted, seen = source.labels(spark).select("txn_ref"), _edges(spark, sf_dir).select("txn_ref")
    return planted.exceptAll(seen).select(F.lit("missing").alias("kind"), "txn_ref").unionByName(seen.exceptAll(planted).select(F.lit("unlabelled").alias("kind"), "txn_ref"))


QUERY_TERMS = {  # our wording for an indicator search of each shape
    "structuring": "deposits kept just under a reporting threshold", "fan_in": "many payers, one collecting account", "fan_out": "one account paying many others", "cycle": "money that returns to where it started",
    "scatter_gather": "split over intermediaries and collected again", "gather_scatter": "collected and passed on at once", "deposit_send": "cash paid in and sent on", "layered_fan": "collection in two layers", "bipartite": "a group paying the same group",
}
