"""Texts as vectors by hashed words, a table of vectors that are already known, and the search for indicators that uses both.

The encoder is a backend like any other: a callable from (``id``, ``text``) to (``id``, ``vector``). It needs no model: a word falls
into one of ``dims`` buckets by its hash and weighs what it is rare, which one aggregate over the corpus tells.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paytrail.plans.cut import counted_cut, cut

from .retrieval import lexical_rerank, search
from .store import with_retry

Encoder = Callable[[DataFrame], DataFrame]
#: Note of a query that found no indicator.
EMPTY = "EMPTY_INDICATOR_RETRIEVAL"
#: Note of a query whose search failed: whether it has indicators isn't known.
FAILED = "FAILED_INDICATOR_RETRIEVAL"


def terms(text: Column) -> Column:
    """Words of letters and digits, in lower case, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bucket(term: Column, dims: int) -> Column:
    return (F.conv(F.substring(F.md5(term), 1, 7), 16, 10).cast("long") % dims).cast("int")


class HashedTerms:
    """An encoder fitted on a corpus: a term weighs its count times ln(1 + texts / texts that have it); terms that the corpus
    lacks weigh as if one had it. Vectors have length one, and zeros for a text without a term."""

    def __init__(self, corpus: DataFrame, text: str = "text", dims: int = 512):
        self.dims = dims
        own = corpus.select(F.array_distinct(terms(F.col(text))).alias("t"))
        self.texts = own.count()
        self.frequencies = cut(own.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "frequencies")

    def weights(self, rows: DataFrame) -> DataFrame:
        """``id``, ``bucket``, ``w``: the vectors, sparse. ``rows``: ``id`` (told apart, null or not), ``text``."""
        each = rows.select("id", F.explode(terms(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
        rare = F.log(1 + F.lit(self.texts) / F.coalesce("df", F.lit(1)))
        summed = each.join(self.frequencies, "term", "left").groupBy("id", bucket(F.col("term"), self.dims).alias("bucket")).agg(F.sum(F.col("tf") * rare).alias("w"))
        return summed.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id"))))

    def __call__(self, rows: DataFrame) -> DataFrame:
        held = self.weights(rows).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("bucket", "w"))).alias("m"))  # ``dims`` entries at most
        known = rows.select("id").join(held.withColumnRenamed("id", "of"), F.col("id").eqNullSafe(F.col("of")), "left").select("id", "m")
        zeros = lambda n: F.array_repeat(F.lit(0.0), n)
        at = lambda own, i: F.coalesce(F.when(i >= 0, F.get(own, i)["bucket"]), F.lit(-1))
        # each weight behind the zeros since the one before it: linear, where a look-up by bucket scans all weights
        filled = lambda own: F.flatten(F.transform(own, lambda e, i: F.concat(zeros(e["bucket"] - at(own, i - 1) - 1), F.array(e["w"]))))
        dense = F.transform(F.array("m"), lambda own: F.concat(filled(own), zeros(self.dims - 1 - at(own, F.size(own) - 1))))[0]
        return known.select("id", F.when(F.col("m").isNull(), zeros(F.lit(self.dims))).otherwise(dense).alias("vector"))


class VectorCache:
    """Vectors by the digest of their texts, in a table that only grows. Only digests without a vector are encoded. Writers may
    overlap: a digest that two of them file has two rows, of which the newest counts, ties by its text's vector."""

    def __init__(self, spark: SparkSession, path: str, backend: str, encode: Encoder):
        self.spark, self.path, self.backend, self.encode, self.encoded = spark, path, backend, encode, 0

    def _known(self) -> DataFrame:
        try:
            rows = self.spark.read.parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return self.spark.createDataFrame([], "digest string, vector array<double>")
        own = rows.where(F.col("backend") == self.backend)
        return own.groupBy("digest").agg(F.max_by("vector", F.struct("cached_at", "vector")).alias("vector"))

    def vectors(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """``rows`` with ``vector``; a null text counts as empty. ``encoded`` is then how many texts were new."""
        named = rows.withColumn("digest", F.sha2(F.coalesce(text, F.lit("")), 256))
        new = named.select("digest", F.coalesce(text, F.lit("")).alias("text")).groupBy("digest").agg(F.min("text").alias("text"))
        new, self.encoded = counted_cut(new.join(self._known(), "digest", "left_anti"), "new-texts")
        if self.encoded:
            fresh = self.encode(new.select(F.col("digest").alias("id"), "text"))
            out = cut(fresh.select(F.col("id").alias("digest"), F.col("vector").cast("array<double>").alias("vector"), F.lit(self.backend).alias("backend"), F.current_timestamp().alias("cached_at")), "new-vectors")
            with_retry(lambda: out.write.mode("append").parquet(self.path))
        return named.join(self._known(), "digest").drop("digest")


def indicators(queries: DataFrame, chunks: DataFrame, encode: Encoder, where: Column | None = None, k: int = 15, keep: int = 5, hint: DataFrame | None = None, degrade: bool = True) -> tuple[DataFrame, DataFrame]:
    """(``query_id``, ``chunk_id``, ``rank`` of the search, ``score``, ``overlap``, ``new_rank``; notes: ``query_id``, ``code``).

    The ``k`` chunks of ``where`` nearest to each query by cosine, put in order anew by the words they share with it, of which
    ``keep`` stay. A ``hint`` (``query_id``, ``text``) takes the place of a query's text. Queries that find nothing are noted. A failing
    encoder or search gives no indicators and notes every query as failed: what rests on them goes on without. Whoever doesn't read the notes sets
    ``degrade`` to False, and gets the failure.
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", "text")
    if hint is not None:
        told = hint.select("query_id", F.col("text").alias("hint"))
        asked = asked.join(told, "query_id", "left").select("query_id", F.coalesce("hint", "text").alias("text"))
    pool = chunks.where(where) if where is not None else chunks
    pool = pool.select("chunk_id", "text")
    code = EMPTY
    try:
        # encoded once: the search reads them more than once
        vectors = lambda rows, key: cut(encode(rows.select(F.col(key).alias("id"), "text")).withColumnRenamed("id", key), "vectors")
        near = cut(search(vectors(asked, "query_id"), vectors(pool, "chunk_id"), k, "query_id", "chunk_id", "vector"), "indicators").where("score > 0")
        texts = near.join(asked.withColumnRenamed("text", "asked"), "query_id").join(pool, "chunk_id")
        found = cut(lexical_rerank(texts, F.col("asked"), F.col("text"), keep).select("query_id", "chunk_id", "rank", "score", "overlap", "new_rank"), "reranked")
    except Exception as e:  # for a caller that reads the notes, indicators are worth having, not worth failing for
        if not degrade:
            raise
        code = FAILED
        warnings.warn(f"indicator search failed: {type(e).__name__}", stacklevel=2)
        kinds = {f.name: f.dataType.simpleString() for f in (*asked.schema.fields, *pool.schema.fields)}
        found = spark.createDataFrame([], f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, rank int, score double, overlap double, new_rank int")
    missing = asked.select("query_id").join(found.select("query_id").distinct(), "query_id", "left_anti")
    return found, missing.withColumn("code", F.lit(code))
