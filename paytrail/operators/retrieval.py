"""Exact nearest neighbours for a stated query set, rank measures, and keyed look-ups."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors held at a time; more are searched in further passes over the data.
QUERY_BLOCK = 20_000
#: Scores held at a time; a batch is compared with as many queries at once as keep to this.
SCORES = 2_000_000
#: Scores closer than this may tie in the order, which goes by nine digits.
TIE = 2e-9


def _unit(column: pa.Array) -> np.ndarray:
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def search(asked: DataFrame, rows: DataFrame, k: int, ask_key: str, key: str, column: str, same: str | None = None, own: bool = False) -> DataFrame:
    """``ask_key``, ``rank``, ``key``, ``score``: the ``k`` of ``rows`` nearest to each of ``asked`` by cosine (ties to the smaller key), both
    with vectors in ``column``; with ``same``, only among rows that share the query's value of that column. With
    ``own``, keys are of one kind and a row doesn't answer its own. Vectors that are null, empty, hold a null, or aren't of the
    commonest length take no part.

    Queries are taken in blocks of ``QUERY_BLOCK``; each block is one pass over the rows that keeps ``k`` rows per query and
    batch, so what shuffles doesn't grow with the pairs compared.
    """
    spark, out = asked.sparkSession, None
    whole = lambda df: df.where(F.col(column).isNotNull() & (F.size(column) > 0) & ~F.exists(column, lambda x: x.isNull()))
    asked, rows = whole(asked), whole(rows)
    dims = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    kinds = f"`{ask_key}` {asked.schema[ask_key].dataType.simpleString()}, rank int, `{key}` {rows.schema[key].dataType.simpleString()}, score double"
    if not dims:
        return spark.createDataFrame([], kinds)
    asked, rows = (df.where(F.size(column) == dims[0]["d"]) for df in (asked, rows))
    n = asked.count()
    numbered = asked.withColumn("__b", F.expr(f"pmod(xxhash64(`{ask_key}`), {max(1, -(-n // QUERY_BLOCK))})"))
    for block in range(max(1, -(-n // QUERY_BLOCK))):
        held = numbered.where(F.col("__b") == block).select(ask_key, column, *([same] if same else [])).toArrow()  # at most about QUERY_BLOCK rows
        if not held.num_rows:
            continue
        sent = spark.sparkContext.broadcast((held[ask_key].combine_chunks(), _unit(held[column].combine_chunks()), held[same].to_numpy() if same else None))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, groups = sent.value
            names = ids.to_numpy(zero_copy_only=False)
            for b in batches:
                if not b.num_rows:
                    continue
                own_names, own_unit = b.column(0).to_numpy(zero_copy_only=False), _unit(b.column(1)).T
                own_groups = None if groups is None else b.column(2).to_numpy()
                step = max(1, SCORES // b.num_rows)
                for at in range(0, len(q), step):
                    some = slice(at, at + step)
                    score = q[some] @ own_unit
                    if own:
                        score[names[some, None] == own_names[None, :]] = -np.inf
                    if groups is not None:
                        score[groups[some, None] != own_groups[None, :]] = -np.inf
                    # as many as reach the k-th score of the batch, with all that tie with it once rounded
                    edge = np.partition(score, -k, axis=1)[:, -k] if b.num_rows > k else np.full(len(score), -np.inf)
                    i, j = np.nonzero((score >= edge[:, None] - TIE) & np.isfinite(score))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + at)), b.column(0).take(pa.array(j)), pa.array(score[i, j])], names=[ask_key, key, "score"])

        found = rows.select(key, column, *([same] if same else [])).mapInArrow(run, kinds.replace(" rank int,", ""))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], kinds)
    order = Window.partitionBy(ask_key).orderBy(F.desc(F.round("score", 9)), key)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(ask_key, "rank", key, "score")


def knn(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", column: str = "embedding", same: str | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``key``, ``score``: the ``k`` nearest rows of each row for which ``is_query`` holds, its own left out; see
    ``search``."""
    rows = vectors.select(F.col(key).cast("long").alias(key), column, *([same] if same else []))
    asked = vectors.where(is_query).select(F.col(key).cast("long").alias("query_id"), column, *([same] if same else []))
    return search(asked, rows, k, "query_id", key, column, same, own=True)


def rank_measures(ranked: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = (1, 4, 8, 15)) -> DataFrame:
    """One row: hit rate at each cut and mean reciprocal rank. ``gold``: all queries, ``ranked``: ``query_id``, ``rank``,
    ``hit`` (a relevant row)."""
    first = ranked.where("hit").groupBy("query_id").agg(F.min("rank").alias("first"))
    each = gold.select("query_id").join(first, "query_id", "left")
    return each.agg(F.count("*").alias("queries"), *(F.round(F.avg(F.when(F.col("first") <= c, 1.0).otherwise(0.0)), 6).alias(f"hit_at_{c}") for c in cuts), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def fuse(ranked: DataFrame, by: list[str], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of several rankings."""
    return ranked.groupBy(*by).agg(F.sum(1 / (k + F.col("rank"))).alias("fused"))


#: Comparisons of a filter document.
COMPARE = {
    "$eq": lambda c, v: c.isNull() if v is None else c == v, "$ne": lambda c, v: c.isNotNull() if v is None else c != v, "$in": lambda c, v: c.isin(*v), "$nin": lambda c, v: ~c.isin(*v),
    "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v,
}


def where(document: Mapping) -> Column:
    """A filter document as one condition, of comparisons only, so that a scan can take it: a field with a value or with
    comparisons, ``$and`` and ``$or`` of documents, ``$not`` of one. Several entries must all hold; an empty document holds for all
    rows, an empty ``$and`` too, an empty ``$or`` or ``$in`` for none. What it doesn't know is refused."""
    parts = []
    for name, value in document.items():
        if name in ("$and", "$or"):
            each = [where(d) for d in value]
            parts.append(reduce(Column.__and__ if name == "$and" else Column.__or__, each) if each else F.lit(name == "$and"))
        elif name == "$not":
            parts.append(~where(value))
        elif name.startswith("$"):
            raise ValueError(f"no such operator: {name}")
        elif isinstance(value, Mapping):
            unknown = set(value) - set(COMPARE)
            if unknown:
                raise ValueError(f"no such comparison: {', '.join(sorted(unknown))}")
            parts += [COMPARE[op](F.col(name), list(x) if op in ("$in", "$nin") else x) for op, x in value.items()]
        else:
            parts.append(COMPARE["$eq"](F.col(name), value))
    return reduce(Column.__and__, parts) if parts else F.lit(True)


def obligations(curated: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``pattern_type``, ``chunk_id``, each once; notes: ``pattern_type``, ``missing``, ``code``).

    ``curated``: ``pattern_type`` and the ``source_id`` and ``section_ref`` of each obligation, null for a shape without any. Keys
    outlive the chunks' ids, so they are resolved here; two keys of one chunk give it once. A shape of whose keys some don't
    resolve is noted with their number, one that has none left with a code.
    """
    found = resolve(curated.where("source_id is not null"), chunks)
    hits = found.where("chunk_id is not null").select("pattern_type", "chunk_id").distinct()
    missed = found.groupBy("pattern_type").agg(F.count_if(F.col("chunk_id").isNull()).alias("missing"))
    some = hits.select("pattern_type").distinct().withColumn("some", F.lit(True))
    each = curated.select("pattern_type").distinct().join(missed, "pattern_type", "left").join(some, "pattern_type", "left")
    notes = each.select("pattern_type", F.coalesce("missing", F.lit(0)).alias("missing"), F.when(F.col("some").isNull(), "OBLIGATION_MAP_MISS").alias("code"))
    return hits, notes.where("missing > 0 or code is not null")


def resolve(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """``wanted`` (``source_id``, ``section_ref``) with ``chunk_id``, null where the corpus has none; a section with several
    chunks gives the first."""
    one = chunks.groupBy("source_id", "section_ref").agg(F.min("chunk_id").alias("chunk_id"))
    return wanted.join(one, ["source_id", "section_ref"], "left")


def lexical_rerank(ranked: DataFrame, query_text: Column, passage: Column, n: int = 5) -> DataFrame:
    """The first ``n`` of each query by the share of its words that the passage holds, then by the old rank."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    share = F.size(F.array_intersect(words(query_text), words(passage))) / F.greatest(F.size(words(query_text)), F.lit(1))
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "rank")
    return ranked.withColumn("overlap", F.round(share, 6)).withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= n)
