"""Exact duplicates by distributed MSD radix partitioning.

Texts are compared as byte strings, never by digest. Three steps:

1. Each task groups what it has read, a bounded buffer at a time, by successive bytes until every group is a singleton or
   has ended. Only one representative of each local group carries its text on, so a text that fills a third of the table
   leaves a task once per buffer.
2. The bytes of the representatives are counted by prefix. A prefix whose texts together exceed ``leaf_bytes`` is split by
   its next bytes, and so on; the longest common prefix of a heavy group is skipped in one step. Texts that end at a
   prefix are equal; where they alone exceed ``leaf_bytes``, sums of their numbers take the place of their bytes. Only
   heavy prefixes reach the driver: at most (total bytes / ``leaf_bytes``) per level.
3. Each leaf (a prefix that isn't heavy) fits a task, which splits it to the end as in step 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytrail.plans.cut import cut

from .storage import bound_batches

#: Bytes by which a heavy prefix is extended in one round.
STEP = 2
#: First bytes of a text in a column of their own: rounds that need no more read nothing else.
HEAD = 160
#: Bytes of a heavy group's texts that are compared at least to skip its common prefix beyond ``HEAD``.
LOOK = 1024


def radix_groups(values: list[bytes]) -> Iterator[list[int]]:
    """Indices of equal values, by splitting on successive bytes (more at a time the longer a group stays together)."""
    todo = [(list(range(len(values))), 0, 1)] if values else []
    while todo:
        rows, depth, width = todo.pop()
        if len(rows) == 1:
            yield rows
            continue
        buckets: dict[bytes, list[int]] = {}
        for r in rows:
            buckets.setdefault(values[r][depth : depth + width], []).append(r)
        for chunk, own in buckets.items():
            if len(own) == 1 or len(chunk) < width:
                yield own
            else:
                todo.append((own, depth + width, min(2 * width, 4096)))


def _rank(key: int | None, row: int) -> tuple[bool, int, int]:
    """Order of equal rows: the greatest stays. A null key comes before all others; of one key's rows the first is greatest."""
    return key is not None, key or 0, -row


def _local(batches: Iterator[pa.RecordBatch], buffer_bytes: int) -> Iterator[pa.RecordBatch]:
    """(row number, key, text bytes, and perhaps rest) -> row_id, key, rep, n, size, head, body, rest: the representative of a
    local group is its greatest row by ``_rank`` and alone has a size, its first ``HEAD`` bytes, all of them, and a rest."""
    ids: list[int] = []
    keys: list[int | None] = []
    texts: list[bytes] = []
    rest: list[pa.Array] = []
    held = 0

    def flush() -> pa.RecordBatch:
        rep, n, body = [0] * len(ids), [0] * len(ids), [None] * len(ids)
        for rows in radix_groups(texts):
            top = max(rows, key=lambda r: _rank(keys[r], ids[r]))
            for r in rows:
                rep[r] = ids[top]
            n[top], body[top] = len(rows), texts[top]
        size, head = [None if b is None else len(b) for b in body], [None if b is None else b[:HEAD] for b in body]
        cols = {"row_id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.int64()), "rep": pa.array(rep, pa.int64()), "n": pa.array(n, pa.int64()), "size": pa.array(size, pa.int64()), "head": pa.array(head, pa.binary()), "body": pa.array(body, pa.binary())}
        if rest:
            cols["rest"] = pa.concat_arrays(rest).take(pa.array([r if n[r] else None for r in range(len(ids))], pa.int64()))
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    for b in batches:
        start = 0
        for at, (i, k, t) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True), 1):
            ids.append(i)
            keys.append(k)
            texts.append(t)
            held += len(t) + 64
            if held >= buffer_bytes or at == b.num_rows:
                if b.num_columns > 3:
                    rest.append(b.column(3).slice(start, at - start))
                start = at
            if held >= buffer_bytes:
                yield flush()
                ids, keys, texts, rest, held = [], [], [], [], 0
    if ids:
        yield flush()


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


def heavy_prefixes(reps: DataFrame, leaf_bytes: int | None) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """(heavy, ended): prefixes whose texts exceed ``leaf_bytes``, each with the length of the prefixes that split it, and
    texts whose copies alone exceed it, numbered. Groups of up to 8 rows count as light whatever their size."""
    spark, size = reps.sparkSession, F.col("size")
    whole = reps.agg(F.sum(size).alias("b"), F.count("*").alias("c")).first()
    leaf_bytes = leaf_bytes or max(4 << 20, (whole["b"] or 0) // 400_000)
    heavy: dict[bytes, int] = {}
    ended: dict[bytes, int] = {}
    front = {b"": STEP} if (whole["b"] or 0) > leaf_bytes and whole["c"] > 8 else {}
    while front:
        heavy |= front
        now, front = front, {}
        for short in (True, False):
            own = [(len(p), bytearray(p), n) for p, n in now.items() if (n + 32 <= HEAD) == short]
            if not own:
                continue
            # each text starts with at most one of the prefixes, of which there are at most (total bytes / leaf_bytes)
            here = spark.createDataFrame(own, "m int, p binary, n int")
            starts = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.expr(f"substring(__x, 1, {m})").alias("p")) for m in sorted({m for m, _, _ in own}))))
            rows = reps.select("size", F.col("head" if short else "body").alias("__x")).withColumn("k", starts).select("size", "__x", "k.*")
            parts = rows.join(F.broadcast(here), ["m", "p"]).select("size", "__x", "n", F.expr("substring(__x, 1, n)").alias("__c"))
            big = parts.groupBy("__c", "n").agg(F.sum(size).alias("b"), F.count("*").alias("c"), F.max(size).alias("longest")).where((F.col("b") > leaf_bytes) & (F.col("c") > 8))
            found = big.select("__c", "n", "longest").collect()
            split = [(r["__c"], r["n"]) for r in found if r["longest"] > r["n"] and len(r["__c"]) == r["n"]]
            for r in found:
                if r["longest"] <= r["n"]:
                    ended[bytes(r["__c"])] = len(ended)
            if not split:
                continue
            # the common prefix of a group is that of its least and its greatest text
            width = f"{HEAD} - n" if short else f"greatest({LOOK}, n)"
            look = parts.join(F.broadcast(spark.createDataFrame(split, "__c binary, n int")), ["__c", "n"]).select("__c", "n", F.expr(f"substring(__x, n + 1, {width})").alias("w"))
            for r in look.groupBy("__c", "n").agg(F.min("w").alias("lo"), F.max("w").alias("hi")).collect():
                front[bytes(r["__c"])] = r["n"] + _common(bytes(r["lo"]), bytes(r["hi"])) + STEP
    return heavy, ended


def leaf_of(text: bytes, heavy: dict[bytes, int]) -> bytes:
    """The shortest prefix of ``text`` that isn't heavy; equal texts have one leaf."""
    p = b""
    while (n := heavy.get(p)) is not None:
        p = text[:n]
        if len(p) < n:
            return p + b"\x00ended"
    return p


def _groups(docs: DataFrame, key: str, text: str, carry: list[str], leaf_bytes: int | None, buffer_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(rows, groups). ``rows``: what ``_local`` yields for each input row, numbered once by place, so that repeated keys stay
    apart. ``groups``: for each representative ``rep`` its group's ``keep_row``, ``keep_id``, ``group_size``, ``text_sha256``."""
    bound_batches(docs.sparkSession)
    own = [F.monotonically_increasing_id().alias("row_id"), F.col(key).cast("long").alias("key"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("body")]
    kind = T.StructType.fromDDL("row_id long, key long, rep long, n long, size long, head binary, body binary")
    if carry:
        own.append(F.struct(F.col(text).isNull().alias("none"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry))).alias("rest"))
    slim = docs.select(*own)
    if carry:
        kind = kind.add("rest", slim.schema["rest"].dataType)
    table = cut(slim.mapInArrow(lambda it: _local(it, buffer_bytes), kind), "radix")
    reps = table.where(F.col("n") > 0)
    heavy, ended = heavy_prefixes(reps.select("size", "head", "body"), leaf_bytes)
    reps = reps.select("row_id", "key", "n", "body")
    sent = reps.sparkSession.sparkContext.broadcast((heavy, ended))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, ended = sent.value
        for b in batches:
            texts = b.column(3).to_pylist()
            own = [ended.get(t) if ended else None for t in texts]
            leaf = [leaf_of(t, heavy) if e is None else None for t, e in zip(texts, own, strict=True)]
            body = [t if e is None else None for t, e in zip(texts, own, strict=True)]
            sha = [None if e is None else hashlib.sha256(t).hexdigest() for t, e in zip(texts, own, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.binary()), pa.array(own, pa.int64()), b.column(0), b.column(1), b.column(2), pa.array(body, pa.binary()), pa.array(sha, pa.string())], names=["leaf", "ended", "row_id", "key", "n", "body", "sha"])

    def finish(rows: pa.Table) -> pa.Table:
        ids, keys, n, body = (rows[c].to_pylist() for c in ("row_id", "key", "n", "body"))
        out: list[tuple] = []
        for own in radix_groups(body):
            top, size = max(own, key=lambda r: _rank(keys[r], ids[r])), sum(n[r] for r in own)
            sha = hashlib.sha256(body[own[0]]).hexdigest()
            out += [(ids[r], ids[top], keys[top], size, sha) for r in own]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.table({k: pa.array([x[i] for x in out], kinds[i]) for i, k in enumerate(("rep", "keep_row", "keep_id", "group_size", "text_sha256"))})

    routed = reps.mapInArrow(route, "leaf binary, ended long, row_id long, key long, n long, body binary, sha string")
    if ended:
        routed = cut(routed, "radix-leaves")
    final = routed.where(F.col("leaf").isNotNull()).groupBy("leaf").applyInArrow(finish, "rep long, keep_row long, keep_id long, group_size long, text_sha256 string")
    if ended:
        over = routed.where(F.col("ended").isNotNull())
        top = F.max(F.struct(F.col("key").isNotNull().alias("has"), F.col("key"), (-F.col("row_id")).alias("row")))
        whole = over.groupBy("ended").agg(top.alias("top"), F.sum("n").alias("group_size"), F.first("sha").alias("text_sha256"))
        whole = whole.select("ended", (-F.col("top.row")).alias("keep_row"), F.col("top.key").alias("keep_id"), "group_size", "text_sha256")
        # one row for each text in ``ended``, of which there are at most (total bytes / leaf_bytes)
        final = final.unionByName(over.select("ended", F.col("row_id").alias("rep")).join(F.broadcast(whole), "ended").drop("ended"))
    return table, final


def equal_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", leaf_bytes: int | None = None, buffer_bytes: int = 8 << 20, null_keys: bool = False) -> DataFrame:
    """One row per input row: ``key``, ``keep_id`` (largest key of its equals), ``group_size``, ``kept``, ``text_sha256``.

    ``key`` is an integer. Rows with a null key take part if ``null_keys`` says so, as in the query and the pipeline: they are
    grouped and counted like any other, and null is the smallest key. A null text counts as empty, and all empty texts are
    equal. A leaf has at most ``leaf_bytes`` of distinct texts (by default a 400,000th of all, 4 MB at least). Rows that repeat with the same key count each, and the first
    stays: each group has one row that is ``kept``. ``text_sha256`` only labels the result. An
    empty table gives no rows; other columns may have any names.
    """
    table, final = _groups(docs if null_keys else docs.where(F.col(key).isNotNull()), key, text, [], leaf_bytes, buffer_bytes)
    out = table.select("row_id", "key", "rep").join(final, "rep")
    return out.select(F.col("key").alias(key), "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", leaf_bytes: int | None = None, buffer_bytes: int = 8 << 20) -> DataFrame:
    """One row of ``docs`` for each text, the one that ``equal_groups`` keeps, all columns; one with a null key only if no
    equal row has a key. A row that stays is its own
    representative, so it comes from the rows that are written anyway."""
    carry = [c for c in docs.columns if c != text]
    table, final = _groups(docs, key, text, carry, leaf_bytes, buffer_bytes)
    kept = final.where(F.col("rep") == F.col("keep_row")).select(F.col("rep").alias("row_id"))
    own = {c: F.col(f"rest.c{i}") for i, c in enumerate(carry)} | {text: F.when(~F.col("rest.none"), F.col("body").cast("string"))}
    return table.where(F.col("n") > 0).join(kept, "row_id", "left_semi").select(*(own[c].alias(c) for c in docs.columns))
