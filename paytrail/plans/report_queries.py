"""Queries over messages, findings, reports, reviews, jobs and costs, on data in the shape of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paytrail.operators import report, retrieval
from paytrail.sources import ledger as source
from paytrail.sources import mt103

from .cut import new_path
from .ledger_queries import WITH
from .registry import query, table

PARSED = f"""{WITH} select txn_ref as reference, '1' || regexp_replace(sender_account, '[^0-9]', '', 'g') as sender_account, '1' || regexp_replace(receiver_account, '[^0-9]', '', 'g') as receiver_account,
  amount, currency, date_trunc('second', ts) as ts, sender_country, receiver_country, upper(replace(payment_kind, '_', ' ')) as instrument, 'Payment ' || txn_ref as memo from ledger"""


@query(PARSED)
def mt103_parse(spark, sf_dir):
    """Round trip: the ledger written as message logs and read back."""
    logs = mt103.render_logs(source.ledger(spark, sf_dir))
    good, _, _ = mt103.ingest(logs)
    return good.select("reference", "sender_account", "receiver_account", "amount", "currency", "ts", "sender_country", "receiver_country", "instrument", "memo")


@query(PARSED)
def mt103_split_parse(spark, sf_dir):
    """Round trip through four log files, each read in byte ranges."""
    path = new_path(spark, "logs")
    mt103.write_logs(source.ledger(spark, sf_dir), path, 4)
    good = mt103.parse_messages(mt103.read_lines(spark, path)).where("reason is null")
    return good.select("reference", "sender_account", "receiver_account", "amount", "currency", "ts", "sender_country", "receiver_country", "instrument", "memo")


@query(f"""{WITH} select txn_ref, ':32A:' || strftime(ts, '%y%m%d') || currency || replace(amount::varchar, '.', ',') as money from ledger""")
def mt103_render(spark, sf_dir):
    return mt103.render(source.ledger(spark, sf_dir)).select("txn_ref", F.regexp_extract("message", r"(?m)^(:32A:.*)$", 1).alias("money"))


@query(f"{WITH} select count(*) as declared, count(*) as parsed, count(distinct txn_ref) as distinct_references, 0::bigint as refused, 0::bigint as rescued, true as complete from ledger")
def ingest_validation(spark, sf_dir):
    return mt103.ingest(mt103.render_logs(source.ledger(spark, sf_dir)))[2]


BREAKS = {  # one fault for every seventh message, by position
    0: ("missing 32A", r"\n:32A:[^\n]*", ""), 1: ("amount has a dot", r"(:32A:[^\n]*),(\d+)", "$1.$2"), 2: ("no reference", r":20:[^\n]*", ":20:"), 3: ("no such value date", r":32A:\d{6}", ":32A:230231"),
    4: ("not terminated", r"\n-\}$", ""), 5: ("52A is not a BIC", r":52A:[^\n]*", ":52A:X1"), 6: ("no such time", r"\d{2}:\d{2}:\d{2}\n-\}$", "25:00:00\n-}"),
}


@query(f"{WITH} select 'log-' || txn_ref as file, case pos % 7 " + " ".join(f"when {k} then '{v[0]}'" for k, v in BREAKS.items()) + f" end as reason from ledger")
def mt103_quarantine(spark, sf_dir):
    """Every message with one fault, each in a log of its own, and the reason it is refused for."""
    rows = mt103.render(source.ledger(spark, sf_dir))
    broken = F.col("message")
    for k, (_, pattern, to) in BREAKS.items():
        broken = F.when(F.col("pos") % 7 == k, F.regexp_replace("message", pattern, to)).otherwise(broken)
    logs = rows.select(F.concat(F.lit("log-"), F.col("txn_ref")).alias("file"), broken.alias("text"))
    return mt103.ingest(logs)[1].select("file", "reason")


#: Ways to write an amount, by position: as it should be, with a dot, without a comma, with two, as zero, without digits.
WAYS = ("replace(amount::varchar, '.', ',')", "amount::varchar", "replace(amount::varchar, '.', '')", "replace(amount::varchar, '.', ',') || ',0'", "'0,00'", "','")
REASONS = (None, "amount has a dot", "amount needs one decimal comma", "amount needs one decimal comma", "amount is not positive", "amount is not a number")


@query(f"{WITH} select pos, case pos % 6 " + " ".join(f"when {k} then {w}" for k, w in enumerate(WAYS)) + " end as raw, case pos % 6 when 0 then amount when 4 then 0.00::decimal(18,2) end as amount, case pos % 6 "
       + " ".join(f"when {k} then {repr(w) if w else 'null::varchar'}" for k, w in enumerate(REASONS)) + " end as reason from ledger")
def swift_amount_cases(spark, sf_dir):
    """Every amount of the ledger, well or badly written by its position, read back or refused."""
    rows, text = source.ledger(spark, sf_dir), F.col("amount").cast("string")
    comma = F.replace(text, F.lit("."), F.lit(","))
    ways = F.array(comma, text, F.replace(text, F.lit("."), F.lit("")), F.concat(comma, F.lit(",0")), F.lit("0,00"), F.lit(","))
    raw = rows.select("pos", ways[(F.col("pos") % 6).cast("int")].alias("raw"))
    return raw.select("pos", "raw", mt103.parse_amount(F.col("raw")).alias("amount"), mt103.amount_reason(F.col("raw")).alias("reason"))


#: Findings in the shape of the service's, from the labelled documents.
FINDINGS_SQL = """findings as (select 'f-' || doc_id::varchar as finding_id, 'r-' || (doc_id % 50)::varchar as report_id, case when toxic = 1 then 'high' when quality = 0 then 'medium' else 'low' end as risk_level,
  (doc_id % 11) / 10.0 as confidence, case when doc_id % 4 = 0 then 'needs_review' else 'pending_review' end as status, doc_id as ordinal from labels)"""


def _findings(spark, sf_dir):
    x = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("f-"), x.cast("string")).alias("finding_id"), F.concat(F.lit("r-"), (x % 50).cast("string")).alias("report_id"), F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "medium").otherwise("low").alias("risk_level"),
        ((x % 11) / 10.0).alias("confidence"), F.when(x % 4 == 0, "needs_review").otherwise("pending_review").alias("status"), x.alias("ordinal"))


@query(f"""with {FINDINGS_SQL}, reports as (select 'r-' || i::varchar as report_id from range(60) r(i)),
a as (select report_id, bool_or(risk_level = 'high' and confidence >= 0.9 and status <> 'needs_review') as sure, bool_or(risk_level in ('high', 'medium')) as some_risk from findings group by 1)
select report_id, case when sure is null then 'none' when sure then 'high' when some_risk then 'medium' else 'low' end as rating from reports left join a using (report_id)""")
def risk_rating(spark, sf_dir):
    return report.rating(_findings(spark, sf_dir), spark.range(60).select(F.concat(F.lit("r-"), F.col("id").cast("string")).alias("report_id")))


@query(f"with {FINDINGS_SQL} select report_id, count(*) as findings, count(*) filter (status = 'needs_review') as needs_review, min(ordinal) as first_ordinal from findings group by 1")
def report_listing(spark, sf_dir):
    return _findings(spark, sf_dir).groupBy("report_id").agg(F.count("*").alias("findings"), F.count_if(F.col("status") == "needs_review").alias("needs_review"), F.min("ordinal").alias("first_ordinal"))


@query(f"with {FINDINGS_SQL} select report_id, finding_id, row_number() over (partition by report_id order by ordinal) as ordinal from findings")
def finding_ordinals(spark, sf_dir):
    from pyspark.sql import Window

    return _findings(spark, sf_dir).select("report_id", "finding_id", F.row_number().over(Window.partitionBy("report_id").orderBy("ordinal")).cast("long").alias("ordinal"))


@query(f"with {FINDINGS_SQL} select report_id, min(ordinal) as first_seen, risk_level || ':' || (ordinal % 7)::varchar as chunk_id from findings group by 1, 3")
def report_sources(spark, sf_dir):
    """What a report rests on: each source once, where it is first cited."""
    cited = F.concat_ws(":", "risk_level", (F.col("ordinal") % 7).cast("string"))
    return _findings(spark, sf_dir).groupBy("report_id", cited.alias("chunk_id")).agg(F.min("ordinal").alias("first_seen"))


ACTIONS_SQL = """acts as (select conv_id as finding_id, row_number() over (partition by conv_id order by turn) as k, case role when 'user' then 'escalate' when 'assistant' then 'approve' else 'clear' end as action from conversations)"""


def _actions(spark, sf_dir):
    role = F.col("role")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("finding_id"), F.col("turn").alias("seq"), F.when(role == "user", "escalate").when(role == "assistant", "approve").otherwise("clear").alias("action"))


TO = " ".join(f"when '{s}>{a}' then '{t}'" for (s, a), t in report.STEPS.items())


@query(f"""with recursive {ACTIONS_SQL}, walk as (
  select finding_id, 0::bigint as k, 'pending_review' as status, 0 as accepted, 0 as refused from (select distinct finding_id from acts)
  union all select w.finding_id, a.k, coalesce(case w.status || '>' || a.action {TO} end, w.status), w.accepted + (case w.status || '>' || a.action {TO} end is not null)::int, w.refused + (case w.status || '>' || a.action {TO} end is null)::int
  from walk w join acts a on a.finding_id = w.finding_id and a.k = w.k + 1)
select finding_id, arg_max(status, k) as status, max(accepted) as accepted, max(refused) as refused from walk group by 1""")
def review_fold(spark, sf_dir):
    return report.review_fold(_actions(spark, sf_dir))


JOBS_SQL = """jobs as (select o_orderkey as job_id, sha256((o_custkey % 200)::varchar) as batch_sha256, case o_orderstatus when 'F' then 'failed' when 'O' then 'running' else 'complete' end as status, o_orderdate as submitted_at from orders)"""


@query(f"with {JOBS_SQL} select job_id, batch_sha256, status, submitted_at from jobs where status in ('running', 'complete') qualify row_number() over (partition by batch_sha256 order by submitted_at desc, job_id desc) = 1")
def job_dedupe(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "running").otherwise("complete")
    return report.reusable_job(o.select(F.col("o_orderkey").alias("job_id"), F.sha2((F.col("o_custkey") % 200).cast("string"), 256).alias("batch_sha256"), status.alias("status"), F.col("o_orderdate").alias("submitted_at")))


MODELS = ["gpt-4o-2024-08-06", "gpt-4o-mini-2024-07-18", "gpt-4o", "other-1"]


def _usage(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    names = F.array(*map(F.lit, MODELS))
    return c.select("conv_id", "role", F.get(names, (F.col("conv_id") % 4).cast("int")).alias("model"), F.length("text").cast("long").alias("tokens_in"), (F.length("text").cast("long") % 97).alias("tokens_out"))


def _prices(spark):
    return spark.createDataFrame([(k, *v) for k, v in report.PRICES.items()], "name string, per_in double, per_out double")


USAGE_SQL = f"""usage as (select role, [{", ".join(f"'{m}'" for m in MODELS)}][(conv_id % 4)::int + 1] as model, length(text) as tokens_in, length(text) % 97 as tokens_out from conversations),
prices as (select * from (values {", ".join(f"('{k}', {a}::double, {b}::double)" for k, (a, b) in report.PRICES.items())}) p(name, per_in, per_out)),
best as (select model, arg_max(per_in, length(name)) as per_in, arg_max(per_out, length(name)) as per_out from (select distinct model from usage) left join prices on model = name or starts_with(model, name || '-') group by 1)"""


@query(f"with {USAGE_SQL} select model, per_in, per_out from best")
def longest_prefix_price(spark, sf_dir):
    one = _usage(spark, sf_dir).select("model").distinct().withColumns({"tokens_in": F.lit(1_000_000), "tokens_out": F.lit(0)})
    a = report.priced(one, _prices(spark)).select("model", F.col("cost").alias("per_in"))
    b = report.priced(one.withColumns({"tokens_in": F.lit(0), "tokens_out": F.lit(1_000_000)}), _prices(spark)).select("model", F.col("cost").alias("per_out"))
    return a.join(b, "model")


@query(f"""with {USAGE_SQL}, c as (select u.*, (per_in * tokens_in + per_out * tokens_out) / 1000000 as cost from usage u join best using (model))
select role as node, count(*) as calls, sum(tokens_in) as tokens_in, sum(tokens_out) as tokens_out, case when count(*) = count(cost) then round(sum(cost), 6) end as cost from c group by 1""")
def usage_cost(spark, sf_dir):
    rows = report.priced(_usage(spark, sf_dir), _prices(spark))
    total = F.when(F.count("*") == F.count("cost"), F.round(F.sum("cost"), 6))
    return rows.groupBy(F.col("role").alias("node")).agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), total.alias("cost"))


DRAFTS = """drafts as (select l.txn_ref, case when l.pos % 5 = 0 then 'see FGO9999999999 and ' else 'see ' end || l.txn_ref || ' under guide:' || md5(l.payment_kind)[1:16] as narrative,
  ['guide:' || md5(l.payment_kind)[1:16]] || case when l.pos % 3 = 0 then ['guide:0000000000000000'] else [] end as cited, ['guide:' || md5(l.payment_kind)[1:16]] as shown from ledger l)"""


@query(rf"""{WITH}, {DRAFTS}, bad as (select txn_ref, list_filter(list_distinct(cited || regexp_extract_all(narrative, '\b([a-z0-9][a-z0-9._-]*:[0-9a-f]{{16}})\b', 1)), lambda c: not list_contains(shown, c)) as ids,
  list_filter(list_distinct(regexp_extract_all(narrative, '\b([A-Z]{{2,5}}[0-9]{{8,}})\b', 1)), lambda r: r <> txn_ref) as refs from drafts)
select txn_ref, array_to_string(list_sort(ids), ',') as bad_ids, array_to_string(list_sort(refs), ',') as bad_refs, len(ids) = 0 and len(refs) = 0 as faithful from bad""")
def faithfulness_gate(spark, sf_dir):
    e = source.ledger(spark, sf_dir)
    guide = F.concat(F.lit("guide:"), F.substring(F.md5("payment_kind"), 1, 16))
    narrative = F.concat(F.when(F.col("pos") % 5 == 0, "see FGO9999999999 and ").otherwise("see "), F.col("txn_ref"), F.lit(" under "), guide)
    cited = F.concat(F.array(guide), F.when(F.col("pos") % 3 == 0, F.array(F.lit("guide:0000000000000000"))).otherwise(F.array().cast("array<string>")))
    drafts = e.select("txn_ref", narrative.alias("narrative"), cited.alias("cited"), F.array(guide).alias("shown"), F.array("txn_ref").alias("refs"))
    return report.gate(drafts).select("txn_ref", F.array_join("bad_ids", ",").alias("bad_ids"), F.array_join("bad_refs", ",").alias("bad_refs"), "faithful")


WANTED = [("structuring", "src1", "en"), ("structuring", "src2", "de"), ("cycle", "src3", "fr"), ("cycle", "nowhere", "en"), ("fan_in", "src4", "xx")]
WANTED_SQL = "wanted as (select * from (values " + ", ".join(map(str, WANTED)) + ") w(pattern_type, source_id, section_ref)), chunks as (select source as source_id, lang as section_ref, min('c' || lpad(doc_id::varchar, 8, '0')) as chunk_id from documents group by 1, 2)"


def _resolved(spark, sf_dir):
    wanted = spark.createDataFrame(WANTED, "pattern_type string, source_id string, section_ref string")
    chunk = F.concat(F.lit("c"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return retrieval.resolve(wanted, table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("lang").alias("section_ref"), chunk.alias("chunk_id")))


@query(f"with {WANTED_SQL} select pattern_type, source_id, section_ref, chunk_id from wanted left join chunks using (source_id, section_ref)")
def obligation_resolve(spark, sf_dir):
    return _resolved(spark, sf_dir).select("pattern_type", "source_id", "section_ref", "chunk_id")


@query(f"with {WANTED_SQL} select pattern_type, count(*) filter (chunk_id is null) as misses, bool_and(chunk_id is null) as needs_review from wanted left join chunks using (source_id, section_ref) group by 1")
def obligation_misses(spark, sf_dir):
    return _resolved(spark, sf_dir).groupBy("pattern_type").agg(F.count_if(F.col("chunk_id").isNull()).alias("misses"), F.bool_and(F.col("chunk_id").isNull()).alias("needs_review"))


@query("select lang, source, count(*) as n, sum(n_chars)::bigint as chars from documents group by grouping sets ((lang, source), (lang), ())")
def corpus_counts_grouping_sets(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupingSets([["lang", "source"], ["lang"], []], "lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""select 'events' as name, count(*) as n from events union all select 'documents', count(*) from documents union all select 'labels', count(*) from labels union all select 'orders', count(*) from orders""")
def store_counts(spark, sf_dir):
    parts = [table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("events", "documents", "labels", "orders")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("select o.o_orderkey, n.n_name as nation, r.r_name as region from orders o join customer c on c.c_custkey = o.o_custkey join nation n on n.n_nationkey = c.c_nationkey join region r on r.r_regionkey = n.n_regionkey")
def order_corridors(spark, sf_dir):
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("o_orderkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
