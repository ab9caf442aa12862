"""Queries of the ledger generator: which cases a month plants, and the walks that chained cases are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytrail.operators import cases, detectors, evaluate

from .cut import cut
from .ledger_queries import QUERY_TERMS, WITH, P, _edges, _fan_sql
from .registry import query

FANS = (("fan_in", "receiver_account", "sender_account", "distinct_senders"), ("fan_out", "sender_account", "receiver_account", "distinct_recipients"))
PRIORITY = ("fan_in", "fan_out")
CASES = f"""found as ({" union all ".join(f"select candidate_id as case_id, '{f[0]}' as shape, n as size, anchor, refs from ({_fan_sql(*f)})" for f in FANS)}),
legs as (select case_id, unnest(string_split(refs, '|')) as txn_ref from found),
held as (select case_id, list(distinct account) as accounts from (select case_id, sender_account as account from legs join ledger using (txn_ref) union all select case_id, receiver_account from legs join ledger using (txn_ref)) group by 1),
cases as (select found.*, accounts from found join held using (case_id))"""


def fan_cases(edges: DataFrame) -> DataFrame:
    """Fans of the ledger as cases."""
    found = detectors.fan_in(edges, P).select("candidate_id", "anchor", "n", "refs", F.lit("fan_in").alias("shape")).unionByName(detectors.fan_out(edges, P).select("candidate_id", "anchor", "n", "refs", F.lit("fan_out").alias("shape")))
    found = cut(found.select(F.col("candidate_id").alias("case_id"), "shape", F.col("n").alias("size"), "anchor", "refs"), "cases")
    legs = found.select("case_id", F.explode("refs").alias("txn_ref")).join(edges.select("txn_ref", F.explode(F.array("sender_account", "receiver_account")).alias("account")), "txn_ref")
    return found.join(legs.groupBy("case_id").agg(F.collect_set("account").alias("accounts")), "case_id")


@query(f"""{WITH}, {CASES},
ordered as (select *, row_number() over (order by case shape when 'fan_out' then 0 else 1 end, size desc, case_id) as no from cases where size >= 3),
pick as (select 0::bigint as no, []::varchar[] as used, false as took
  union all select p.no + 1, case when list_has_any(p.used, c.accounts) then p.used else p.used || c.accounts end, not list_has_any(p.used, c.accounts) from pick p join ordered c on c.no = p.no + 1),
summed as (select row_number() over (order by no) as place, case_id, shape, size, sum(size) over (order by no)::bigint as running from ordered join pick using (no) where took)
select * from summed where running <= floor((select count(*) from ledger) * 0.1 + 1e-9)""")
def case_selection(spark, sf_dir):
    """The fans that a month plants, fan-out first: no two share an account, and together they are a tenth of the rows at most."""
    edges = cut(_edges(spark, sf_dir), "ledger")
    return cases.select_cases(fan_cases(edges), edges.count(), PRIORITY, 0.1, rotation=1)


@query(f"""{WITH}, {CASES} select case_id, case when ('0x' || sha256(anchor)[1:2])::int % 2 = 0 then 'dev' else 'eval' end = 'eval' as plant, shape = 'fan_in' and size % 2 = 0 as aligned,
  case when shape = 'structuring' then size % 2 = 0 else ('0x' || sha256(anchor)[1:2])::int % 2 = 1 end as golden from cases""")
def case_admissible(spark, sf_dir):
    found = fan_cases(cut(_edges(spark, sf_dir), "ledger"))
    aligned = F.col("size") % 2 == 0
    rule = lambda selection: cases.admissible(F.col("shape"), aligned, F.col("anchor"), selection, "eval")
    return found.select("case_id", rule("any").alias("plant"), ((F.col("shape") == "fan_in") & aligned).alias("aligned"), rule("aligned").alias("golden"))


@query(f"""{WITH}, outs as (select sender_account as node, receiver_account as onward, min(pos) as pos from ledger group by 1, 2),
walk as (select distinct sender_account as start, sender_account as node, [sender_account] as visited, []::bigint[] as path, false as closed, 0 as hops from ledger
  union all
  select start, onward, visited || [onward], path || [pos], onward = start, hops + 1 from (
    select w.*, o.onward, o.pos, row_number() over (partition by w.start order by o.pos) as r from walk w join outs o on o.node = w.node
    where not w.closed and w.hops < 10 and (o.onward = w.start or not list_contains(w.visited, o.onward))) where r = 1)
select start, hops, closed, array_to_string(path, '-') as path from walk qualify row_number() over (partition by start order by hops desc) = 1""")
def chain_walks(spark, sf_dir):
    """From every account that pays, the walk along first payments."""
    return cases.walks(_edges(spark, sf_dir)).select("start", "hops", "closed", F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"))


@query()
def longest_chains(spark, sf_dir):
    """The three longest walks that share no payment (the limit is the feature)."""
    return cases.longest_walks(cut(_edges(spark, sf_dir), "ledger"), 3).select("place", "start", "hops", "closed", F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"))


@query(f"""{WITH}, drawn as (select payment_kind, sender_country as batch, txn_ref, row_number() over (partition by payment_kind, sender_country order by ts, txn_ref) as depth from ledger)
select payment_kind, batch, txn_ref, depth, place from (select *, row_number() over (partition by payment_kind order by depth, batch) as place from drawn) where place <= 15""")
def round_robin_by_batch(spark, sf_dir):
    """Of each kind of payment 15 rows (the limit is the feature), one of every batch in turn; a sender's country is the batch."""
    return evaluate.round_robin_batches(_edges(spark, sf_dir), "payment_kind", "sender_country", ["ts", "txn_ref"], 15).select("payment_kind", F.col("sender_country").alias("batch"), "txn_ref", "depth", "place")


@query(f"""{WITH}, {CASES}, crossing as (select case_id, bool_or(sender_country <> receiver_country) as c from legs join ledger using (txn_ref) group by 1)
select case_id, case shape when 'fan_in' then '{QUERY_TERMS['fan_in']}' else '{QUERY_TERMS['fan_out']}' end || '; ' || size::varchar || ' payments' || case when c then '; cross-border' else '' end as query_text from cases join crossing using (case_id)""")
def query_templates(spark, sf_dir):
    """The words that an indicator search asks for each fan with."""
    edges = cut(_edges(spark, sf_dir), "ledger")
    found = fan_cases(edges)
    legs = found.select("case_id", F.explode("refs").alias("txn_ref")).join(edges.select("txn_ref", (F.col("sender_country") != F.col("receiver_country")).alias("c")), "txn_ref")
    crossing = legs.groupBy("case_id").agg(F.bool_or("c").alias("c"))
    return found.join(crossing, "case_id").select("case_id", evaluate.query_text(F.col("shape"), QUERY_TERMS, F.concat(F.col("size").cast("string"), F.lit(" payments")), F.col("c")).alias("query_text"))
