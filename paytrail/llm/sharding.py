"""Rendezvous hashing of stable keys over weighted shards, in SQL functions only.

Every (key, shard) pair has a pseudo-random u in (0, 1) that depends on nothing else; a key goes to the shard with the
least ``-ln(u) / weight``. A new shard only ever takes keys for itself, in proportion to its weight.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paytrail.plans.cut import cut


#: A Mersenne prime; 5 is coprime to P - 1, so the fifth power permutes the residues. Products stay below 2**62.
P = 2**31 - 1
#: Odd multipliers that spread shard numbers over the residues.
SPREAD = (1_103_515_245, 1_597_334_677, 747_796_405)


def _seed(shard: int, k: int) -> int:
    return (shard + 1) * SPREAD[k] % P


def _power5(x: Column) -> Column:
    """Of a lambda's variable, which costs nothing to name again."""
    two = x * x % P
    return two * two % P * x % P


def key_parts(key: Column) -> tuple[Column, Column]:
    """Two 28-bit numbers from the key as text; a null key is the text ``\\u0000null``."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("\x00null")))
    return tuple(F.conv(F.substring(digest, a, 7), 16, 10).cast("long") for a in (1, 8))


def bids(a: Column, b: Column, weights: Sequence[float]) -> Column:
    """An array of (bid, shard), one for each weight; the least bid wins. A weight of 0 never wins against a positive one.

    Three stages of fifth powers over the shards' seeds, each a ``transform`` of the one before: the plan has as many nodes
    for a thousand shards as for one.
    """
    seeds = lambda k: F.array(*(F.lit(_seed(s, k)).cast("long") for s in range(len(weights))))
    x = F.transform(F.transform(seeds(0), lambda s: (a + s) % P), _power5)
    x = F.transform(F.zip_with(x, seeds(1), lambda x, s: (x + b + s) % P), _power5)
    x = F.transform(F.zip_with(x, seeds(2), lambda x, s: (x + s) % P), _power5)
    spread = F.zip_with(x, F.array(*(F.lit(float(w)) for w in weights)), lambda x, w: F.when(w > 0, -F.log((x + 0.5) / P) / w).otherwise(F.lit(math.inf)))
    return F.transform(spread, lambda bid, shard: F.struct(bid.alias("bid"), shard.alias("shard")))


def check_weights(weights: Sequence[float]) -> list[float]:
    weights = [float(w) for w in weights]
    if not weights or min(weights) < 0 or sum(weights) == 0:
        raise ValueError("weights must be nonnegative, and one positive")
    return weights


def assign(docs: DataFrame, key: str, weights: Sequence[float]) -> DataFrame:
    """``docs`` with ``shard`` and ``grown_shard``, the shard if one more of the mean weight is added."""
    weights = check_weights(weights)
    n, mean = len(weights), sum(weights) / len(weights)
    own, other = key_parts(F.col(key))
    rows = docs.select("*", bids(own, other, [*weights, mean]).alias("__bids"))
    best = lambda k: F.array_min(F.slice("__bids", 1, k))["shard"]
    return rows.withColumns({"shard": best(n), "grown_shard": best(n + 1)}).drop("__bids")


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 40, key: str = "doc_id", text: str = "text", block_rows: int = 500_000) -> DataFrame:
    """Every row with ``key``, ``size`` (UTF-8 bytes of the text plus 16), ``text_crc32``, ``law`` (``key``), ``shard``,
    ``slot`` (gapless from 0 in each shard, by key, size and crc; nulls first) and ``grown_shard``.

    A null text has size 16 and crc 0, as an empty one; a null key is a key of its own. Rows that repeat a key share its
    shard and get slots of their own. Rows are sorted in ranges of about ``block_rows``, which part equal rows too, and
    slots are numbered within the ranges and carried on from one to the next, so neither a shard nor a repeated key meets
    in one task. An empty table gives no rows.
    """
    weights = check_weights(weights)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = docs.select(F.col(key).alias("__k"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.monotonically_increasing_id().alias("__row"))
    order = ["shard", "__k", "size", "text_crc32", "__row"]
    ranged = assign(slim, "__k", weights).repartitionByRange(max(1, math.ceil(docs.count() / block_rows)), *order).sortWithinPartitions(*order)
    rows = cut(ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "shards")
    # a row for each shard and range
    runs = rows.groupBy("shard", "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("shard", "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    placed = rows.join(runs, ["shard", "__part"])
    return placed.select(F.col("__k").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__at") + F.col("__shift")).cast("long").alias("slot"), "grown_shard")


def oracle(shards: int = 40) -> str:
    """The same rows for equal weights, as DuckDB SQL over ``documents``."""
    power = lambda x: f"(({x}) * ({x}) % {P})"
    fifth = lambda x: f"({power(power(x))} * ({x}) % {P})"
    seed = lambda k: f"((s + 1) * {SPREAD[k]} % {P})"
    return f"""
with bytes as (select i, case when i < 0 then 0 else i end as c from range(256) r(i)),
steps as (select i, list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), i) as c from bytes),
crc_table as (select list(c order by i) as t from steps),
base as (select doc_id, strlen(coalesce(text, '')) + 16 as size, hex(encode(coalesce(text, ''))) as h, md5(coalesce(cast(doc_id as varchar), chr(0) || 'null')) as m from documents),
parts as (select doc_id, size, h, ('0x' || m[1:7])::bigint as a, ('0x' || m[8:14])::bigint as b from base),
crc as (select *, xor(list_reduce(list_transform(range(strlen(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) as text_crc32 from parts, crc_table),
one as (select *, {fifth(f"(a + {seed(0)}) % {P}")} as x from crc, range({shards + 1}) r(s)),
two as (select * replace ({fifth(f"(x + b + {seed(1)}) % {P}")} as x) from one),
three as (select * replace (-ln(({fifth(f"(x + {seed(2)}) % {P}")} + 0.5) / {P}) as x) from two),
best as (select doc_id, size, text_crc32, arg_min(s, x) filter (s < {shards}) as shard, arg_min(s, x) as grown_shard from three group by all)
select doc_id, size, text_crc32, 'key' as law, shard::int as shard, row_number() over (partition by shard order by doc_id nulls first, size, text_crc32) - 1 as slot, grown_shard::int as grown_shard from best"""
