"""Which texts hold which passages, letter by letter, by an index of anchors; and a map from documents to texts built on it.

A passage is looked up by one n-gram of its inner words, the rarest that it has: its first and last word may be parts of a
text's words, those between are whole ones. Passages of one or two words have no inner word; their longest word is found
within the words of the texts first, by the letters it starts with, and those words are their anchors. Every look-up is an
equi-join on a hash, and what it finds is verified on the whole text.

The n-grams of the texts are made once and met where they are made: as long as the passages' keys are few, neither n-grams nor
texts are shuffled. Only n-grams that a passage has are written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from paytrail.plans.cut import cut

#: Inner words that an anchor has, where the passage has as many.
GRAM = 5
#: Letters by which a word is looked up inside other words.
LETTERS = 3
#: Bytes of keys, or of passages with the texts to be searched for them, that may be broadcast; more are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _keys(own: Column, n: int) -> Column:
    """Hashes of the distinct n-grams of a list of words. Each word is hashed once; the list of hashes is a lambda's variable, so it is made once,
    not once a gram."""
    grams = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(F.lit(n), *(F.get(h, i + j) for j in range(n))))
    hashes = F.transform(own, lambda w: F.xxhash64(w))
    return F.transform(F.array(hashes), lambda h: F.when(F.size(h) >= n, F.array_distinct(grams(h))).otherwise(F.array().cast("array<bigint>")))[0]


def _asked(passages: DataFrame, passage: str) -> DataFrame:
    """Distinct passages with a word: ``p``, their ``inner`` words and ``n``, the words of an anchor."""
    own = passages.select(F.col(passage).alias("p")).where(F.rlike("p", F.lit(r"\S"))).distinct().withColumn("words", words(F.col("p")))
    own = own.withColumn("inner", F.slice("words", 2, F.greatest(F.size("words") - 2, F.lit(0))))
    return own.withColumn("n", F.when(F.size("inner") >= GRAM, GRAM).when(F.size("inner") >= 1, 1).otherwise(0))


def _short(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """``p``, ``k``: for passages without inner words, the key of every word of the texts that has their longest word in it."""
    longest = F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    mine = asked.where("n = 0").select("p", longest.alias("w")).withColumn("q", F.least(F.lit(LETTERS), F.length("w"))).withColumn("gram", F.substring("w", 1, LETTERS))
    known = texts.select(F.explode(words(F.col("body"))).alias("word")).distinct()
    starts = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(LETTERS)), lambda q: F.struct(q.alias("q"), F.substring(F.col("word"), i, q).alias("gram"))))
    grams = known.select("word", F.explode(F.array_distinct(F.flatten(starts))).alias("g")).select("word", "g.q", "g.gram")
    found = mine.join(grams, ["q", "gram"]).where(F.contains("word", F.col("w")))
    return found.select("p", F.xxhash64(F.lit(1), F.xxhash64("word")).alias("k")).distinct()


def _inner_keys(asked: DataFrame) -> DataFrame:
    """``p``, ``k``: the keys of each passage's inner n-grams."""
    keys = F.when(F.col("n") == GRAM, _keys(F.col("inner"), GRAM)).otherwise(_keys(F.col("inner"), 1))
    return asked.where("n > 0").select("p", F.explode(keys).alias("k"))


def _rarest(own: DataFrame, hits: DataFrame) -> DataFrame:
    """``p``, ``k``: the key of each passage's rarest inner n-gram; one that no text has finds nothing, as it should."""
    times = hits.groupBy("k").agg(F.count("*").alias("f"))
    return own.join(times, "k", "left").groupBy("p").agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "k")).alias("x")).select("p", "x.k")


def _sent(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` as a table, which joins are told to broadcast if it is small; its bytes are counted while it is written."""
    seen, size = Observation(), reduce(Column.__add__, (F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in rows.columns))
    table = cut(rows.observe(seen, F.sum(size + 16).alias("bytes")), label)
    return F.broadcast(table) if (seen.get["bytes"] or 0) <= BROADCAST_BYTES else table


def containment(passages: DataFrame, docs: DataFrame, passage: str, text: str, key: str) -> DataFrame:
    """``passages`` with ``key`` of each row of ``docs`` whose text holds the passage.

    Null texts and passages hold and are nothing, as are passages without a word. Rows that repeat a key or a passage each
    have their rows; a null key stays null.
    """
    texts = docs.select(F.col(key).alias("d"), F.col(text).alias("body")).where("body is not null")
    asked = cut(_asked(passages, passage), "asked")
    sizes = {r["n"] for r in asked.select("n").distinct().collect()}  # three at most
    if not sizes:
        return passages.limit(0).crossJoin(docs.select(key).limit(0))  # no rows
    lists = [_keys(words(F.col("body")), n) for n in (1, GRAM) if n in sizes or (n == 1 and 0 in sizes)]
    held = texts.select("d", F.explode(F.concat(*lists)).alias("k"))
    own = cut(_inner_keys(asked), "inner-keys")
    short = [cut(_short(asked, texts), "short-keys")] * (0 in sizes)
    keys = _sent(reduce(DataFrame.unionByName, [own, *short]).select("k").distinct(), "keys")
    hits = cut(held.join(keys, "k", "left_semi"), "hits")
    found = _sent(reduce(DataFrame.unionByName, [_rarest(own, hits), *short]), "anchors")
    met = _sent(hits.join(found, "k").select(F.col("d").alias("at"), "p").distinct(), "met")
    sure = texts.join(met, F.col("d").eqNullSafe(F.col("at"))).where(F.contains("body", F.col("p"))).select("d", "p")
    return passages.join(sure, F.col(passage) == F.col("p")).drop("p").withColumnRenamed("d", key)


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def probes(passages: DataFrame, doc: str, passage: str, most: int = 5, long: int = 200) -> DataFrame:
    """``doc``, ``probe``: the longest passages of each document, of those over ``long`` characters if it has any."""
    own = passages.where(F.col(passage).isNotNull()).select(F.col(doc).alias("doc"), F.col(passage).alias("passage"))
    n, by = F.length("passage"), Window.partitionBy("doc")
    own = own.withColumn("some", F.max(n > long).over(by)).where((n > long) | ~F.col("some"))
    own = own.withColumn("place", F.row_number().over(by.orderBy(F.desc(n), "passage"))).where(F.col("place") <= most)
    return own.select("doc", normal(F.col("passage")).alias("probe"))


def document_map(passages: DataFrame, texts: DataFrame, doc: str, passage: str, name: str, text: str, most: int = 5) -> DataFrame:
    """Which of ``texts`` each document is: ``doc``, ``probes``, ``name`` (the text with most of its probes, the least on ties),
    ``hits``, ``winners`` (texts with as many), ``rival`` (another document that the same text is the only winner of), and
    ``problem``: no text, ambiguous, not injective, or null."""
    asked = probes(passages, doc, passage, most)
    bodies = texts.select(F.col(name).alias("name"), normal(F.col(text)).alias("body"))
    hits = containment(asked, bodies, "probe", "body", "name").groupBy("doc", "name").agg(F.count("*").alias("hits"))
    best = hits.groupBy("doc").agg(F.max("hits").alias("hits"))
    won = hits.join(best, ["doc", "hits"]).groupBy("doc", "hits").agg(F.min("name").alias("name"), F.count("*").alias("winners"))
    # who claims a text alone: its least and greatest document name both sides of a clash, however many there are
    claims = won.where("winners = 1").groupBy("name").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    every = asked.groupBy("doc").agg(F.count("*").alias("probes")).join(won, "doc", "left").join(claims.where("low <> high"), "name", "left")
    rival = F.when(F.col("winners") == 1, F.when(F.col("doc") == F.col("low"), F.col("high")).otherwise(F.col("low")))
    problem = F.when(F.col("hits").isNull(), "no text").when(F.col("winners") > 1, "ambiguous").when(F.col("rival").isNotNull(), "not injective")
    found = every.withColumn("rival", rival).withColumn("problem", problem)
    return found.select("doc", "probes", "name", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("winners", F.lit(0)).alias("winners"), "rival", "problem")
