"""The queries of this subpackage and, where SQL can express them, the DuckDB SQL for the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, hard_negatives, html_cut, mixing, ngram_join, packing, quality, sharding, token_codes, token_counts, toxicity, turn_repair


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    """The vocabulary file; its place is the same on every machine that has the package."""
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(table(spark, sf_dir, "documents"))


def op5_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.read_codes(spark, token_codes.write_codes(table(spark, sf_dir, "documents"), tokenizer()))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.equal_groups(table(spark, sf_dir, "documents"), null_keys=True)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer())


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_conversations(table(spark, sf_dir, "conversations"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_cut.extract(pages, html_cut.fit(pages))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


#: Exact for the whole table, though by grouping whole texts, not by radix.
EXACT_DEDUP_SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, max(doc_id) over w = doc_id as kept, sha256(t) as text_sha256
from d window w as (partition by t)"""

#: All pairs that share an n-gram, counted; the banding of the query misses a pair at the threshold with probability 1e-4.
NGRAM_JOIN_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') as w from documents),
grams as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) end) as g from words),
sizes as (select doc_id, count(*) as n from grams group by 1),
links as (
  select a.doc_id as x, b.doc_id as y from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id
  join sizes p on p.doc_id = a.doc_id join sizes q on q.doc_id = b.doc_id
  group by 1, 2, p.n, q.n having count(*) >= 0.8 * (p.n + q.n - count(*)) - 1e-9),
reach as (select doc_id as x, doc_id as y from documents union select r.x, l.y from reach r join links l on l.x = r.y),
classes as (select x as doc_id, min(y) as class_id from reach group by 1),
sets as (select doc_id, list(g order by g) as s from grams group by 1)
select d.doc_id, c.class_id, coalesce(k.n_links, 0)::bigint as n_links, case when s.s is null then d.doc_id else min(d.doc_id) over (partition by s.s) end as set_id,
  case when s.s is null then 1 else count(*) over (partition by s.s) end as set_size, coalesce(len(s.s), 0)::int as n_grams
from documents d join classes c using (doc_id) left join sets s using (doc_id) left join (select x as doc_id, count(*) as n_links from links group by 1) k using (doc_id)"""


def queries() -> dict:
    own = (op1_source_mixing, op2_nearest_neighbours, op3_rendezvous_shards, op4_ngram_join, op5_token_codes, op6_token_counts, op7_toxicity, op8_exact_dedup, op9_quality, op10_best_fit_packing, op11_turn_repair, op12_html_extraction, op13_hard_negatives)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_rendezvous_shards": sharding.oracle(), "op4_ngram_join": NGRAM_JOIN_SQL, "op8_exact_dedup": EXACT_DEDUP_SQL, "op11_turn_repair": turn_repair.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
