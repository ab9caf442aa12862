"""Queries over documents, pages, benchmark passages and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from paytrail.functions import chunks, redact, text
from paytrail.operators import embed
from paytrail.operators import passages as passages_of
from paytrail.operators import retrieval

from .registry import query, table

PEPPER = "example-pepper"


@query(r"select doc_id, md5(regexp_replace(text, '[\p{Cf}\p{Co}]', '', 'g')) as digest, length(regexp_replace(text, '[\p{Cf}\p{Co}]', '', 'g')) as n from documents")
def strip_invisibles(spark, sf_dir):
    clean = text.strip_invisibles(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean).alias("digest"), F.length(clean).cast("long").alias("n"))


@query()
def normalize_text(spark, sf_dir):
    clean = text.normalize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean).alias("digest"), F.length(clean).alias("n"))


@query(r"""with a as (select doc_id, regexp_replace(replace(text, chr(9), ' '), '[ \x{00A0}]+', ' ', 'g') as t from documents),
b as (select doc_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '(?m)[ \r\f]+$', '', 'g') as t from a)
select doc_id, md5(regexp_replace(regexp_replace(t, '\A\s+', ''), '\s+\z', '')) as digest from b""")
def tidy_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.tidy(F.col("text"))).alias("digest"))


SHORT = ", ".join(f"'{a}'" for a in sorted(text.ABBREVIATIONS))


@query(rf"""with lines as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as ln from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)),
words as (select doc_id, ln, unnest(w) as w, generate_subscripts(w, 1) as k from (select doc_id, ln, regexp_extract_all(line, '[^\s]+\s*') as w from lines)),
ends as (select *, regexp_matches(rtrim(w), '[.!?]+["'')\]]*$') and regexp_matches(lead(w) over o, '^[\p{{Lu}}(‘“"'']') and lower(regexp_extract(rtrim(w), '([^(\[]*?)[.!?]+["'')\]]*$', 1)) not in ({SHORT})
  and not regexp_full_match(regexp_extract(rtrim(w), '([^(\[]*?)[.!?]+["'')\]]*$', 1), '\p{{L}}') as e from words window o as (partition by doc_id, ln order by k)),
numbered as (select *, coalesce(sum(e::int) over (partition by doc_id, ln order by k rows between unbounded preceding and 1 preceding), 0) as s from ends),
found as (select doc_id, ln, s, rtrim(string_agg(w, '' order by k)) as piece from numbered group by 1, 2, 3)
select doc_id, (row_number() over (partition by doc_id order by ln, s) - 1)::int as ordinal, piece from found""")
def split_sentences(spark, sf_dir):
    return chunks.sentences(table(spark, sf_dir, "documents"), "doc_id")


@query()
def semantic_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", text.normalize(F.col("text")))
    return chunks.chunk(docs, "doc_id")


@query()
def chunk_sizes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", text.normalize(F.col("text")))
    n = F.length("piece")
    return chunks.chunk(docs, "doc_id").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.min(n).alias("shortest"), F.max(n).alias("longest"))


STRIP = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(?:p|div|li|h[1-6]|tr)>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g')"""


@query(f"select page_id, md5({STRIP}) as digest from pages")
def html_strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_tags(F.col("html"))).alias("digest"))


@query()
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("body"))


LINES = r"""lines as (select doc_id, trim(l, ' ') as line from (select doc_id, unnest(string_split(text, chr(10))) as l from documents) where trim(l, ' ') <> '')"""


@query(rf"""with {LINES}, shaped as (select *, regexp_replace(line, '[0-9]+', '#', 'g') as shape from lines), many as (select doc_id, shape, count(*) as times from shaped group by 1, 2 having count(*) >= 2)
select distinct doc_id, line, times from shaped join many using (doc_id, shape)""")
def page_chrome(spark, sf_dir):
    return text.repeated_lines(table(spark, sf_dir, "documents"), "doc_id")


@query(rf"with {LINES} select line, count(distinct doc_id) as pages from lines group by 1 having count(distinct doc_id) >= 3")
def page_furniture(spark, sf_dir):
    return text.furniture(table(spark, sf_dir, "documents"), "doc_id")


@query(rf"with {LINES} select doc_id, count(*) filter (length(line) >= 40) as clauses, count(*) filter (length(line) < 40) as bare from lines group by 1")
def bare_headings(spark, sf_dir):
    rows = text.lines_of(table(spark, sf_dir, "documents"), "doc_id")
    return rows.groupBy("doc_id").agg(F.count_if(F.length("line") >= text.HEADING_CHARS).alias("clauses"), F.count_if(F.length("line") < text.HEADING_CHARS).alias("bare"))


@query(rf"""with {LINES} select doc_id, count(*) filter (not regexp_matches(line, '^\s*[•●▪·*-]\s+') and len(regexp_split_to_array(line, '\s+')) <= 10 and line not like '%,%' and not regexp_matches(line, '[.;:]$') and regexp_matches(line, '^\p{{Lu}}')) as headings from lines group by 1""")
def heading_lines(spark, sf_dir):
    return text.lines_of(table(spark, sf_dir, "documents"), "doc_id").groupBy("doc_id").agg(F.count_if(text.is_heading(F.col("line"))).alias("headings"))


@query("select sha256(text) as digest, min(doc_id) as first_doc, count(*) as copies from documents group by 1")
def embedding_cache_keys(spark, sf_dir):
    """What a content-addressed cache would encode: each distinct text once."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("select item_id, source_key || ':' || sha256(source_key || '|' || item_id::varchar || '|1')[1:16] as chunk_id from (select item_id, 'benchmark' as source_key from benchmark)")
def chunk_ids(spark, sf_dir):
    section = F.col("item_id").cast("string")
    return table(spark, sf_dir, "benchmark").select("item_id", text.chunk_id(F.lit("benchmark"), section, F.lit("1")).alias("chunk_id"))


BARE = lambda t: rf"regexp_replace({t}, '\A{text.SPACE}+|{text.SPACE}+\z', '', 'g')"


@query(f"with t as (select doc_id, {BARE('text')} as t from documents) select doc_id, case when length(t) > 400 then {BARE('t[1:399]')} || '…' else t end as excerpt from t")
def citation_excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


@query()
def redact_scrub(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", redact.scrub(F.col("text")).alias("clean"), redact.has_identifier(F.col("text")).alias("had"))


@query(f"select o_orderkey, case when o_custkey is null then '' else 'ACCT-' || sha256('{PEPPER}|' || o_custkey::varchar)[1:8] end as account from orders")
def pseudonymise(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", redact.pseudonym(F.col("o_custkey").cast("string"), PEPPER).alias("account"))


@query()
def redacted_ledger(spark, sf_dir):
    from paytrail.sources import ledger

    rows = ledger.ledger(spark, sf_dir).select("txn_ref", "sender_account", "receiver_account", "amount", F.concat(F.lit("paid to "), F.col("receiver_account"), F.lit(" on 2024-01-05 ref 12345678")).alias("memo"))
    return redact.redact(rows, PEPPER)


@query("select b.item_id, d.doc_id from documents d join benchmark b on contains(d.text, b.text)")
def probe_containment(spark, sf_dir):
    passages = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return passages_of.containment(passages, table(spark, sf_dir, "documents"), "passage", "text", "doc_id").select("item_id", "doc_id")


@query("""with items as (select item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as probe from benchmark where text is not null),
bodies as (select doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as body from documents),
hits as (select item_id, doc_id, count(*) as hits from items join bodies on contains(body, probe) group by 1, 2),
won as (select item_id, hits, min(doc_id) as name, count(*) as winners from (select *, max(hits) over (partition by item_id) as most from hits) where hits = most group by 1, 2),
claims as (select name, min(item_id) as low, max(item_id) as high from won where winners = 1 group by 1),
found as (select i.item_id as doc, count(*) as probes, any_value(w.name) as name, coalesce(any_value(w.hits), 0) as hits, coalesce(any_value(w.winners), 0) as winners,
  any_value(case when w.winners = 1 and c.low <> c.high then case when i.item_id = c.low then c.high else c.low end end) as rival
  from items i left join won w using (item_id) left join claims c on c.name = w.name group by 1)
select *, case when hits = 0 then 'no text' when winners > 1 then 'ambiguous' when rival is not null then 'not injective' end as problem from found""")
def passage_map(spark, sf_dir):
    """Which document each item of the benchmark is a part of, and where that isn't one to one."""
    return passages_of.document_map(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "text", "doc_id", "text")


KNN = """ranked as (select a.vec_id as query_id, b.vec_id as vec_id, a.label as query_label, b.label as label, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as score,
  row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) desc, b.vec_id) as rank
  from embeddings a join embeddings b on a.vec_id <> b.vec_id {more} where a.vec_id % 100 = 0)"""


@query(f"with {KNN.format(more='')} select query_id, rank::int as rank, vec_id, round(score, 6) as score from ranked where rank <= 15")
def knn_topk(spark, sf_dir):
    return retrieval.knn(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 15).withColumn("score", F.round("score", 6))


@query(f"with {KNN.format(more='and a.label = b.label')} select query_id, rank::int as rank, vec_id, round(score, 6) as score from ranked where rank <= 5")
def knn_filtered(spark, sf_dir):
    return retrieval.knn(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 5, same="label").withColumn("score", F.round("score", 6))


@query(f"""with {KNN.format(more='')}, firsts as (select query_id, min(rank) filter (label = query_label) as f from ranked where rank <= 15 group by 1)
select count(*) as queries, round(avg(case when f <= 1 then 1.0 else 0.0 end), 6)::double as hit_at_1, round(avg(case when f <= 4 then 1.0 else 0.0 end), 6)::double as hit_at_4, round(avg(case when f <= 8 then 1.0 else 0.0 end), 6)::double as hit_at_8,
  round(avg(case when f <= 15 then 1.0 else 0.0 end), 6)::double as hit_at_15, round(avg(coalesce(1 / f::double, 0)), 6) as mrr from firsts""")
def retrieval_measures(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    ranked = retrieval.knn(v, F.col("vec_id") % 100 == 0, 15)
    kinds = v.select("vec_id", "label")
    own = ranked.join(kinds, "vec_id").join(kinds.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q")), "query_id").withColumn("hit", F.col("label") == F.col("q"))
    return retrieval.rank_measures(own, kinds.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id")))


@query("""with p as (select label, vec_id, embedding as e, lag(embedding) over (partition by label order by vec_id) as b from embeddings)
select label, vec_id, round(1 - list_cosine_similarity(e::double[], b::double[]), 6) as distance from p""")
def adjacent_distance(spark, sf_dir):
    return text.adjacent_distance(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").withColumn("distance", F.round("distance", 6))


@query("""with p as (select label, 1 - list_cosine_similarity(embedding::double[], lag(embedding) over (partition by label order by vec_id)::double[]) as d from embeddings)
select label, round(quantile_cont(d, 0.95), 6) as threshold from p group by 1""")
def semantic_boundaries(spark, sf_dir):
    away = text.adjacent_distance(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return away.groupBy("label").agg(F.round(F.percentile("distance", 0.95), 6).alias("threshold"))


WORDS = lambda c: rf"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))"


@query(f"""with c as (select conv_id as query_id, turn as rank, text, first_value(text) over (partition by conv_id order by turn) as q from conversations),
s as (select query_id, rank, round(len(list_intersect({WORDS("q")}, {WORDS("text")})) / greatest(len({WORDS("q")}), 1), 6) as overlap from c)
select query_id, rank, overlap, row_number() over (partition by query_id order by overlap desc, rank)::int as new_rank from s qualify new_rank <= 5""")
def rerank_lexical(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text", F.first("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("q"))
    return retrieval.lexical_rerank(c, F.col("q"), F.col("text")).select("query_id", "rank", "overlap", "new_rank")


@query("""with l as (select vec_id, label, row_number() over (partition by label order by vec_id) as a, row_number() over (partition by vec_id % 10 order by vec_id) as b from embeddings), r as (select vec_id, unnest([a, b]) as rank from l)
select vec_id, round(sum(1 / (60 + rank)), 9) as fused from r group by 1""")
def rank_fusion(spark, sf_dir):
    from pyspark.sql import Window

    v = table(spark, sf_dir, "embeddings")
    both = [v.select("vec_id", F.row_number().over(Window.partitionBy(k).orderBy("vec_id")).alias("rank")) for k in (F.col("label"), F.col("vec_id") % 10)]
    return retrieval.fuse(both[0].unionByName(both[1]), ["vec_id"]).select("vec_id", F.round("fused", 9).alias("fused"))


@query("""select o_orderkey, case o_orderkey % 6 when 0 then strftime(o_orderdate, '20%y-%m-%d') when 1 then strftime(o_orderdate, '20%y-%m-%d') when 2 then strftime(o_orderdate, '%Y-%m-%d')
  when 3 then strftime(o_orderdate, '%Y-%m') when 4 then strftime(o_orderdate, '%Y') end as dated from orders""")
def document_dates(spark, sf_dir):
    """Dates read back from file names that are made from the orders' dates in six styles."""
    orders, day = table(spark, sf_dir, "orders"), F.col("o_orderdate")
    styles = [
        F.concat(F.lit("Manual_VER02."), F.date_format(day, "ddMMyy"), F.lit(".txt")), F.concat(F.lit("CIR_"), F.date_format(day, "ddMMyy"), F.lit(".pdf")), F.concat(F.lit("Guidance-"), F.date_format(day, "d MMMM yyyy"), F.lit(".pdf")),
        F.concat(F.lit("Tax Rules 2017 (Revised_"), F.date_format(day, "MMMM yyyy"), F.lit(").txt")), F.concat(F.lit("Framework "), F.date_format(day, "yyyy"), F.lit(".txt")), F.lit("notes.txt"),
    ]
    return orders.select("o_orderkey", text.document_date(F.get(F.array(*styles), F.col("o_orderkey") % 6)).alias("dated"))


INDICATORS = """docs as (select doc_id, text from documents where lang = 'en' and text is not null),
asked as (select item_id as query_id, text from benchmark),
words as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from docs),
freq as (select term, count(distinct doc_id) as df from words group by 1), n as (select count(*)::double as n from docs),
tf as (select 'd' as side, doc_id as id, term, count(*) as tf from words group by all
  union all select 'q', query_id, term, count(*) from (select query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from asked) group by all),
raw as (select side, id, ('0x' || md5(term)[1:7])::bigint % 512 as bucket, sum(tf * ln(1 + n / coalesce(df, 1))) as w from tf left join freq using (term), n group by all),
unit as (select side, id, bucket, w / sqrt(sum(w * w) over (partition by side, id)) as w from raw),
scored as (select q.id as query_id, d.id as chunk_id, sum(q.w * d.w) as score from unit q join unit d using (bucket) where q.side = 'q' and d.side = 'd' group by 1, 2),
near as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id)::int as rank from scored qualify rank <= 15),
bags as (select query_id, chunk_id, rank, score, list_distinct(list_filter(regexp_split_to_array(lower(a.text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) as own,
  list_distinct(list_filter(regexp_split_to_array(lower(d.text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) as other from near join asked a using (query_id) join docs d on d.doc_id = chunk_id),
shared as (select query_id, chunk_id, rank, score, round(len(list_intersect(own, other)) / greatest(len(own), 1), 6) as overlap from bags)"""


@query(f"""with {INDICATORS} select query_id, chunk_id, rank, round(score, 6) as score, overlap, row_number() over (partition by query_id order by overlap desc, rank)::int as new_rank from shared qualify new_rank <= 5""")
def indicator_search(spark, sf_dir):
    """The English documents nearest to every item of the benchmark by hashed terms, reranked."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en' and text is not null").select(F.col("doc_id").alias("chunk_id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found, _ = embed.indicators(asked, docs, embed.HashedTerms(docs), degrade=False)
    return found.withColumn("score", F.round("score", 6))
