"""Queries over adjudication, generated ledgers and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from paytrail.operators import adjudicate, generate, grounding, retrieval
from paytrail.sources import ledger as source

from .cut import cut
from .ledger_queries import QUERY_TERMS, WITH, _audit
from .registry import query, table


def _law(spark):
    return spark.createDataFrame([(p, f"law:{k:016x}") for k, p in enumerate(QUERY_TERMS)], "pattern_type string, chunk_id string"), spark.createDataFrame([(p, f"hint:{10 * k + r:016x}", r) for k, p in enumerate(QUERY_TERMS) for r in range(1, 8)], "pattern_type string, chunk_id string, rank int")


def _findings(spark, sf_dir):
    edges, found = _audit(spark, sf_dir)
    kept = cut(found.where("kept").drop("kept", "absorber"), "kept")
    return edges, adjudicate.adjudicate(adjudicate.bundles(kept, *_law(spark)))


@query()
def adjudicated_findings(spark, sf_dir):
    _, findings = _findings(spark, sf_dir)
    return findings.select("candidate_id", "pattern_type", "risk_level", F.round("judged", 4).alias("judged"), "status", "notes", "loops", "faithful", F.array_join("cited", ",").alias("cited"))


@query()
def compliance_report(spark, sf_dir):
    edges, findings = _findings(spark, sf_dir)
    return adjudicate.assemble(findings, edges)


@query()
def report_invariants(spark, sf_dir):
    """Empty, if every finding in doubt says why and rests on rows of the ledger."""
    edges, findings = _findings(spark, sf_dir)
    return adjudicate.broken_invariants(findings, edges)


CASES = f"""{WITH}, cases as (select shape || ':' || sender_account as a, shape || ':' || receiver_account as b, ts from ledger join ({source.labels_sql()}) l using (txn_ref) where sender_account <> receiver_account),
sym as (select a, b from cases union select b, a from cases), reach as (select a as x, a as y from sym union select r.x, s.b from reach r join sym s on s.a = r.y), c as (select x, min(y) as root from reach group by 1)"""


def _cases(spark, sf_dir):
    """All labelled payments, the accounts of each shape apart."""
    rows = source.ledger(spark, sf_dir).join(source.labels(spark), "txn_ref")
    return rows.withColumns({c: F.concat_ws(":", "shape", c) for c in ("sender_account", "receiver_account")})


@query(f"{CASES} select x as node, root from c")
def typology_components(spark, sf_dir):
    """Clusters of the labelled cases, shape by shape."""
    return generate.clusters(_cases(spark, sf_dir))


@query(f"""{CASES} select root, count(*) as n, count(distinct strftime(ts, '%Y-%m')) as months, count(distinct strftime(ts, '%Y-%m')) = 1 as inside from cases join c on c.x = cases.a group by 1""")
def cluster_containment(spark, sf_dir):
    return generate.contained(_cases(spark, sf_dir))


@query(f"{WITH} select txn_ref, 'FGO' || strftime(ts, '%y%m%d') || lpad(row_number() over (partition by ts::date order by us, txn_ref)::varchar, 5, '0') as reference from ledger")
def minted_references(spark, sf_dir):
    return generate.mint_references(source.ledger(spark, sf_dir), ["us", "txn_ref"]).select("txn_ref", "reference")


NAMES = lambda words, salt: f"[{', '.join(repr(w) for w in words)}][('0x' || md5('{salt}' || account)[1:7])::bigint % {len(words)} + 1]"


@query(f"{WITH}, a as (select distinct sender_account as account from ledger) select account, {NAMES(generate.FIRST, 'first')} || ' ' || {NAMES(generate.LAST, 'last')} as holder from a")
def synthetic_parties(spark, sf_dir):
    return source.ledger(spark, sf_dir).select(F.col("sender_account").alias("account")).distinct().select("account", generate.party(F.col("account")).alias("holder"))


@query(f"{WITH}, m as (select txn_ref from ({source.labels_sql()}) l where shape = 'deposit_send') select txn_ref, case when txn_ref in (select txn_ref from m) then 'MX' else receiver_country end as receiver_country, case when txn_ref in (select txn_ref from m) then 'MXN' else currency end as currency from ledger")
def redomiciled(spark, sf_dir):
    moved = source.labels(spark).where("shape = 'deposit_send'")
    return generate.redomicile(source.ledger(spark, sf_dir), moved, "MX", "MXN").select("txn_ref", "receiver_country", "currency")


@query(f"{WITH} select count(l.txn_ref) as flagged, count(*) as total, round(count(l.txn_ref) / count(*), 6) as share, round(count(l.txn_ref) / count(*), 6) <= 0.1 as within_cap from ledger left join ({source.labels_sql()}) l using (txn_ref)")
def flagged_share(spark, sf_dir):
    return generate.share_of(source.ledger(spark, sf_dir), source.labels(spark))


@query(f"{WITH} select sender_account, avg((amount between 8000 and 9999.99)::int) >= 0.5 as aligned from ledger group by 1")
def threshold_alignment(spark, sf_dir):
    return generate.threshold_aligned(source.ledger(spark, sf_dir), "sender_account")


@query("""with f as (select 'p' || page_id::varchar as artifact, sha256(html) as have from pages),
m as (select 'p' || page_id::varchar as artifact, case when page_id % 9 = 0 then 'x' else sha256(html) end as sha256, ['statute', 'regulation', 'guidance', 'blog'][(page_id % 4)::int + 1] as tier, case when page_id % 2 = 0 then 'binding' else 'illustrative' end as authority from pages
  union all select 'gone', 'x', 'guidance', 'illustrative')
select artifact, unnest(list_filter([case when have is null then 'missing' end, case when have <> sha256 then 'changed' end, case when tier not in ('statute', 'regulation', 'guidance') then 'tier' end,
  case when (authority = 'binding') <> (tier in ('statute', 'regulation')) then 'authority' end], lambda p: p is not null)) as problem from m left join f using (artifact)""")
def manifest_check(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    tier = F.element_at(F.array(*map(F.lit, ("statute", "regulation", "guidance", "blog"))), (F.col("page_id") % 4 + 1).cast("int"))
    said = pages.select(name.alias("artifact"), F.when(F.col("page_id") % 9 == 0, "x").otherwise(F.sha2("html", 256)).alias("sha256"), F.lit("text").alias("role"), tier.alias("tier"), F.when(F.col("page_id") % 2 == 0, "binding").otherwise("illustrative").alias("authority"))
    said = said.unionByName(spark.createDataFrame([("gone", "x", "text", "guidance", "illustrative")], said.schema))
    return generate.manifest_problems(said, pages.select(name.alias("artifact"), F.col("html").cast("binary").alias("content")))


CORPUS = {"$and": [{"lang": {"$in": ["en", "de"]}}, {"$or": [{"n_chars": {"$gte": 2000}}, {"source": {"$ne": "web"}}]}], "doc_id": {"$gt": 3}}


@query("select doc_id, lang, source, n_chars from documents where lang in ('en', 'de') and (n_chars >= 2000 or source <> 'web') and doc_id > 3")
def filtered_corpus(spark, sf_dir):
    """Documents that a nested filter document lets through."""
    return table(spark, sf_dir, "documents").where(retrieval.where(CORPUS)).select("doc_id", "lang", "source", "n_chars")


SECTIONS = """chunks as (select source as source_id, lang as section_ref, min(doc_id) as chunk_id from documents where text is not null group by 1, 2),
curated as (select distinct source as pattern_type, source as source_id, lang as section_ref from documents union all select distinct source, source, 'repealed' from documents
  union all select distinct source, source, 'en' from documents union all select 'uncurated', null, null)"""


def _curated(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    own = docs.select(F.col("source").alias("pattern_type"), F.col("source").alias("source_id"), F.col("lang").alias("section_ref")).distinct()
    more = [own.select("pattern_type", "source_id", F.lit(x).alias("section_ref")).distinct() for x in ("repealed", "en")]
    none = spark.createDataFrame([("uncurated", None, None)], own.schema)
    chunks = docs.where("text is not null").select(F.col("source").alias("source_id"), F.col("lang").alias("section_ref"), F.col("doc_id").alias("chunk_id"))
    return own.unionByName(more[0]).unionByName(more[1]).unionByName(none), chunks


@query(f"with {SECTIONS} select distinct pattern_type, chunk_id from curated join chunks using (source_id, section_ref)")
def obligations_by_key(spark, sf_dir):
    """Curated keys of every source resolved to documents, each once though keys repeat."""
    return retrieval.obligations(*_curated(spark, sf_dir))[0]


@query(f"""with {SECTIONS} select pattern_type, count(*) filter (source_id is not null and chunk_id is null) as missing, case when count(chunk_id) = 0 then 'OBLIGATION_MAP_MISS' end as code
from curated left join chunks using (source_id, section_ref) group by 1 having count(*) filter (source_id is not null and chunk_id is null) > 0 or count(chunk_id) = 0""")
def obligation_notes(spark, sf_dir):
    """Sources of whose curated keys some, or all, don't resolve."""
    return retrieval.obligations(*_curated(spark, sf_dir))[1]


REPLIES = "doc_id % 4 = 0 or (doc_id % 4 = 1 and {attempt} > 1) or (doc_id % 4 = 2 and {attempt} > 2)"


def _reply(rows, attempt: int):
    """A drafter that needs as many attempts as the row's number says, or never gets it right."""
    right = F.to_json(F.struct(F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("narrative"), F.when(F.col("toxic") == 1, "high").otherwise("low").alias("risk_level"), F.array(F.lit("law:1")).alias("cited")))
    wrong = F.when(F.col("doc_id") % 3 == 0, "I would say low.").when(F.col("doc_id") % 3 == 1, '{"narrative": "n", "risk_level": "dire", "cited": []}').otherwise('{"narrative": "n", "risk_level": "low"}')
    return rows.withColumn("reply", F.when(F.expr(REPLIES.format(attempt=attempt)), right).otherwise(wrong))


@query(f"""select doc_id, case when a <= 3 then 'Document ' || doc_id::varchar end as narrative, case when a <= 3 then case when toxic = 1 then 'high' else 'low' end end as risk_level, least(a, 3)::int as attempts,
  case when a > 3 then 'SCHEMA_PARSE_FAILURE: ' || case doc_id % 3 when 0 then 'not an object of the schema' when 1 then 'no such risk level' else 'no list of citations' end end as note
from (select *, doc_id % 4 + 1 as a from labels)""")
def grounded_drafts(spark, sf_dir):
    """A draft for every labelled document, repaired up to three times."""
    return grounding.ground(table(spark, sf_dir, "labels").select("doc_id", "toxic"), _reply).select("doc_id", "narrative", "risk_level", "attempts", "note")


@query()
def trimmed_payloads(spark, sf_dir):
    """A nested payload of every conversation, cut down."""
    turns = table(spark, sf_dir, "conversations")
    entry = F.struct("turn", "role", F.struct(F.split("text", " ").alias("words"), F.lit("bulk").alias("batch_graph")).alias("body"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("t"))
    payload = F.to_json(F.struct("conv_id", F.col("t").alias("records"), F.col("t").alias("turns")))
    return grounding.trimmed(rows.select("conv_id", payload.alias("payload")), "payload")
