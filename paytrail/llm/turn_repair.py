"""Conversation structure repair by a rank-compressed dynamic programme.

The roles that a repaired conversation takes are ``(s?(ua)+)?``. A layer of the programme has, for each state of that
pattern, the least cost so far and the *rank* of the cheapest audit string among those of the layer, never the string. A
step is a macro edit: a run of inserts and then what happens to one row, written ``I*[DKR]``. These codes are free of
prefixes and numbered in ASCII order, and all audits of a layer consist of as many codes, so audits compare as (rank of
the layer before, code) pairs do. Parent pointers give the string at the end. Layers are few once their costs are taken
relative to the least, so a row costs one look-up.

A conversation of up to ``block_rows`` rows and ``block_bytes`` bytes streams through one task. A larger one is dealt into
blocks by turn: each block gives the cost and rank of every way from state to state, these compose (block after block, a
few numbers each), and then every block writes its own piece of the audit and of the text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytrail.plans.cut import counted_cut, cut

from .storage import bound_batches

#: States of the role pattern: nothing yet, a system turn alone, a user turn without its answer, whole pairs.
EMPTY, SYSTEM, OPEN, CLOSED = range(4)
#: Inserts that make a state final.
CLOSING = (0, 2, 1, 0)
DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
#: Macro edits in ASCII order. Two inserts lead from any state to any other that inserts reach.
MACROS = sorted("I" * run + edit for run in range(3) for edit in "DKR")
#: Kinds of rows: one that must go, or 1 + 2 * (place of its initial here, or 3) + (whether it is cut off).
INITIALS = "sua"
GONE = 0
LEGAL = {"su", "ua", "au"}
#: White space of a text: space and the controls 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
MOST = 2**63 - 1
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"

Layer = tuple[tuple[int, int] | None, ...]


def alone(state: int) -> Layer:
    """The layer whose only state is ``state``."""
    return tuple((0, 0) if s == state else None for s in range(4))


def _move(state: int, macro: str, kind: int) -> tuple[int, int] | None:
    """(state, price) after a macro edit, None where it can't be applied."""
    price = 0
    for _ in macro[:-1]:
        state, price = CLOSED if state == OPEN else OPEN, price + INSERT
    if macro[-1] == "D":
        return state, price + DELETE
    if kind == GONE:
        return None
    initial, cut_off = divmod(kind - 1, 2)
    price += CUT_OFF * cut_off
    if macro[-1] == "R":
        return CLOSED if state == OPEN else OPEN, price + REROLE
    fits = (state == EMPTY, state != OPEN, state == OPEN, False)[initial]
    return ((SYSTEM, OPEN, CLOSED)[initial], price) if fits else None


@lru_cache(maxsize=None)  # relative costs are below a dozen, so layers are few
def step(layer: Layer, kind: int) -> tuple[int, Layer, tuple]:
    """(least cost added, next layer, the (state before, code) of each state) for a row of ``kind``.

    A start that costs more than the closed pairs' by over a deletion can't win any more (all that follows it follows
    them, but for one kept system row), nor can a lone system turn that costs more than they do; both leave the layer.
    """
    best: dict[int, tuple] = {}
    for state, seen in enumerate(layer):
        if seen is None:
            continue
        for code, macro in enumerate(MACROS):
            moved = _move(state, macro, kind)
            if moved:
                found = (seen[0] + moved[1], seen[1], code, state)
                best[moved[0]] = min(best.get(moved[0], found), found)
    if CLOSED in best:
        for state, room in ((EMPTY, DELETE), (SYSTEM, 0)):
            if state in best and best[state][0] > best[CLOSED][0] + room:
                del best[state]
    base = min(f[0] for f in best.values())
    ranks = {key: i for i, key in enumerate(sorted({f[1:3] for f in best.values()}))}
    new = tuple((best[s][0] - base, ranks[best[s][1:3]]) if s in best else None for s in range(4))
    return base, new, tuple((best[s][3], best[s][2]) if s in best else None for s in range(4))


def forward(layer: Layer, kinds: Iterable[int]) -> tuple[int, Layer, list[tuple]]:
    cost, pointers = 0, []
    for kind in kinds:
        more, layer, back = step(layer, kind)
        cost += more
        pointers.append(back)
    return cost, layer, pointers


def finish(cost: int, layer: Layer) -> tuple[int, int]:
    """(cost, state) of the cheapest whole audit, the ASCII-least of several."""
    total, _, state = min((cost + seen[0] + INSERT * CLOSING[s], seen[1], s) for s, seen in enumerate(layer) if seen)
    return total, state


def backward(pointers: list[tuple], state: int) -> list[str]:
    """The macro edits that lead to ``state``."""
    out = []
    for back in reversed(pointers):
        state, code = back[state]
        out.append(MACROS[code])
    return out[::-1]


def rewrite(rows: Iterable[tuple[str, str]], edits: list[str], state: int) -> Iterator[str]:
    """Lines of the repaired conversation."""
    for (role, text), macro in zip(rows, edits, strict=True):
        for _ in macro[:-1]:
            yield "assistant:" if state == OPEN else "user:"
            state = CLOSED if state == OPEN else OPEN
        if macro[-1] == "R":
            role = "assistant" if state == OPEN else "user"
        if macro[-1] != "D":
            yield f"{role}:{text}"
            state = {"s": SYSTEM, "u": OPEN, "a": CLOSED}[role[0]]


def closers(state: int) -> list[str]:
    return ["user:", "assistant:"][2 - CLOSING[state] :]


class Tally:
    """Counts over rows in their order, and what the programme and the rewriting need of them."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.kinds: list[int] = []
        self.rows: list[tuple[str, str]] = []
        self.first = self.last = None
        self.low = self.high = None

    def add(self, turn, role: str, text: str, blank: bool, first: bool, cut_off: bool, n: int) -> None:
        """``n`` equal rows, the first of which is the first of its role and text if ``first``."""
        initial = role[:1]
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += n - 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        if blank:
            self.blank += n
        else:
            self.duplicate += n - first
            self.truncated += first and cut_off
        place = INITIALS.find(initial) if initial else -1
        kept = first and not blank
        self.kinds += [1 + 2 * (place if place >= 0 else 3) + cut_off if kept else GONE, *(GONE,) * (n - 1)]
        self.rows += ((role, text),) * n

    def counts(self) -> tuple[int, ...]:
        gaps = 0 if self.low is None else min(MOST, self.high - self.low + 1 - self.turns)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


def damage(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows as the contract of the query damages them: ``c``, ``t``, ``role``, ``text`` and ``n``, how often a row stays."""
    name = F.concat_ws(":", *(F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in (key, turn)))
    rows = turns.select(F.col(key).alias("c"), F.col(turn).alias("t"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("k"))
    broken = F.when(F.col("k") <= 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("c", "t", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), broken.alias("text"), F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).alias("n"))


def as_rows(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows as they are, in the same shape."""
    return turns.select(F.col(key).alias("c"), F.col(turn).alias("t"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), F.lit(1).alias("n"))


def _faults(rows: DataFrame) -> DataFrame:
    end = F.rtrim("text", F.lit(SPACE))
    stops = F.endswith(end, F.lit(".")) | F.endswith(end, F.lit("!")) | F.endswith(end, F.lit("?"))
    return rows.withColumns({"blank": end == "", "cut_off": ~stops})


def _whole(rows: DataFrame, kind: str, texts: bool) -> DataFrame:
    """Conversations that one task may hold, one after the other in sorted partitions."""

    def close(key, tally: Tally) -> tuple:
        cost, layer, pointers = forward(alone(EMPTY), tally.kinds)
        total, state = finish(cost, layer)
        edits = backward(pointers, state)
        body = "\n".join([*rewrite(tally.rows, edits, EMPTY), *closers(state)])
        return key, *tally.counts(), total, "".join(edits) + "I" * CLOSING[state], body if texts else None, hashlib.sha256(body.encode()).hexdigest()

    def emit(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

    names = ["c", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired", "repaired_sha256"]
    types = [None, *(pa.int64(),) * 6, pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tally, seen, done, held = None, None, set(), [], 0
        for b in batches:
            types[0] = b.schema.field(0).type
            for key, turn, role, text, n, blank, cut_off in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if tally is None or key != now:
                    if tally is not None:
                        done.append(close(now, tally))
                        held += len(done[-1][-2] or "")
                        if held > 4_000_000 or len(done) >= 4096:
                            yield emit(done)
                            done, held = [], 0
                    now, tally, seen = key, Tally(), set()
                if n:
                    tally.add(turn, role, text, blank, (role, text) not in seen, cut_off, n)
                    seen.add((role, text))
        if tally is not None:
            done.append(close(now, tally))
            yield emit(done)

    order = [F.col("c"), F.col("t").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = rows.withColumn("text", F.when(F.col("n") > 0, F.col("text"))).repartition("c").sortWithinPartitions(*order)
    return dealt.select("c", "t", "role", "text", "n", "blank", "cut_off").mapInArrow(run, f"c {kind}, {COUNTS}, audit string, repaired string, repaired_sha256 string")


def _blocks(rows: DataFrame, parts: int) -> DataFrame:
    """Rows of large conversations with ``g`` (the conversation), ``pid`` and ``place``: equal rows are one with their number,
    ``first`` marks the first of a role and text, and the order of (``pid``, ``place``) is the conversation's."""
    length = F.octet_length("role").cast("string")
    one = rows.where("n > 0").groupBy("g", "t", "role", "text", "blank", "cut_off").agg(F.sum("n").alias("n"))
    one = one.withColumns({"o": F.col("t").isNotNull(), "z": F.coalesce("t", F.lit(0)), "d": F.sha2(F.concat(length, F.lit(":"), "role", "text"), 256)})
    one = cut(one, "turns")
    firsts = one.groupBy("g", "d").agg(F.min(F.struct("o", "z")).alias("f")).select("g", "d", "f.o", "f.z", F.lit(True).alias("first"))
    known = one.join(firsts, ["g", "d", "o", "z"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
    ranged = known.withColumn("head", F.substring("text", 1, 256)).repartitionByRange(parts, "g", "o", "z", "role", "head")
    placed = ranged.sortWithinPartitions("g", "o", "z", "role", "text").withColumns({"pid": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    return cut(placed.select("g", "pid", "place", "t", "role", "text", "blank", "first", "cut_off", "n"), "turn-blocks")


def _tally(block: pa.Table) -> Tally:
    tally, block = Tally(), block.sort_by("place")
    for turn, role, text, blank, first, cut_off, n in zip(*(block[c].to_pylist() for c in ("t", "role", "text", "blank", "first", "cut_off", "n")), strict=True):
        tally.add(turn, role, text, blank, first, cut_off, n)
    return tally


SUMMARY = "g string, pid int, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, moves array<long>"
RESOLVED = f"g string, pid int, start int, finish int, ends boolean, {COUNTS}"


def _summarise(block: pa.Table) -> pa.Table:
    """A block's counts and ``moves``: cost and rank (-1: no way) from each state to each other."""
    tally, moves = _tally(block), []
    for state in range(4):
        cost, layer, _ = forward(alone(state), tally.kinds)
        for seen in layer:
            moves += [cost + seen[0], seen[1]] if seen else [-1, -1]
    low, high = (None, None) if tally.low is None else (tally.low, tally.high)
    row = dict(g=block["g"][0].as_py(), pid=block["pid"][0].as_py(), blank=tally.blank, duplicate=tally.duplicate, truncated=tally.truncated, illegal=tally.illegal, turns=tally.turns, low=low, high=high, first=tally.first, last=tally.last, moves=moves)
    kinds = {"g": pa.string(), "pid": pa.int32(), "low": pa.int64(), "high": pa.int64(), "first": pa.string(), "last": pa.string(), "moves": pa.list_(pa.int64())}
    return pa.table({k: pa.array([v], kinds.get(k, pa.int64())) for k, v in row.items()})


def _resolve(summaries: pa.Table) -> pa.Table:
    """The state before and after each block of one conversation (a row of 44 numbers for each), and its totals."""
    rows = summaries.sort_by("pid").to_pylist()
    layer: dict[int, tuple[int, int]] = {EMPTY: (0, 0)}
    back, total, high, last = [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0), None, None
    for r in rows:
        for name in total:
            total[name] += r[name]
        total["illegal"] += last is not None and last + r["first"] not in LEGAL
        total["turns"] -= high is not None and r["low"] == high
        last, high = r["last"], r["high"] if r["high"] is not None else high
        best: dict[int, tuple] = {}
        for s, (cost, rank) in layer.items():
            for t in range(4):
                more, own = r["moves"][8 * s + 2 * t : 8 * s + 2 * t + 2]
                if own >= 0:
                    best[t] = min(best.get(t, (math.inf,)), (cost + more, rank, own, s))
        ranks = {key: i for i, key in enumerate(sorted({f[1:3] for f in best.values()}))}
        layer = {t: (f[0], ranks[f[1:3]]) for t, f in best.items()}
        back.append({t: f[3] for t, f in best.items()})
    cost, state = finish(0, tuple(layer.get(s) for s in range(4)))
    ways = []
    for at in reversed(back):
        ways.append((at[state], state))
        state = at[state]
    low = next((r["low"] for r in rows if r["low"] is not None), None)
    gaps = 0 if low is None else min(MOST, high - low + 1 - total.pop("turns"))
    counts = {"gaps": gaps, **{k: total[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost}
    out = [dict(g=r["g"], pid=r["pid"], start=a, finish=b, ends=r is rows[-1], **counts) for r, (a, b) in zip(rows, ways[::-1], strict=True)]
    kinds = [("g", pa.string()), ("pid", pa.int32()), ("start", pa.int32()), ("finish", pa.int32()), ("ends", pa.bool_()), *((c, pa.int64()) for c in counts)]
    return pa.Table.from_pylist(out, pa.schema(kinds))


def _pieces(block: pa.Table, way: pa.Table) -> pa.Table:
    """The block's piece of the audit and of the text."""
    tally, start, state = _tally(block), way["start"][0].as_py(), way["finish"][0].as_py()
    edits = backward(forward(alone(start), tally.kinds)[2], state)
    lines, audit = list(rewrite(tally.rows, edits, start)), "".join(edits)
    if way["ends"][0].as_py():
        lines, audit = lines + closers(state), audit + "I" * CLOSING[state]
    return pa.table({"g": block["g"][:1].cast(pa.string()), "pid": block["pid"][:1], "audit": [audit], "lines": ["\n".join(lines)]})


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order, joined: the audit, and the hash of the text, which is never held whole."""
    now, audit, digest, begun = None, [], None, False

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"g": [now], "audit": ["".join(audit)], "repaired_sha256": [digest.hexdigest()]})

    for b in batches:
        for key, piece, lines in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if key != now:
                if now is not None:
                    yield close()
                now, audit, digest, begun = key, [], hashlib.sha256(), False
            audit.append(piece)
            if lines:
                digest.update(("\n" * begun + lines).encode())
                begun = True
    if now is not None:
        yield close()


def _split(rows: DataFrame, large: DataFrame, parts: int) -> DataFrame:
    blocks = _blocks(rows.join(large.select("g"), "g", "left_semi"), parts)
    grouped = blocks.groupBy("g", "pid")
    ways = cut(grouped.applyInArrow(_summarise, SUMMARY).groupBy("g").applyInArrow(_resolve, RESOLVED), "turn-ways")
    pieces = cut(grouped.cogroup(ways.groupBy("g", "pid")).applyInArrow(_pieces, "g string, pid int, audit string, lines string"), "turn-pieces")
    joined = pieces.repartition("g").sortWithinPartitions("g", "pid").mapInArrow(_joined, "g string, audit string, repaired_sha256 string")
    counts = [c.split()[0] for c in COUNTS.split(", ")]
    totals = ways.where("ends").select("g", *counts)
    found = large.select("g", "c").join(totals, "g", "left").join(joined, "g", "left")
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in counts}
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select("c", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.lit(None).cast("string").alias("repaired"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def repair(rows: DataFrame, texts: bool = True, block_rows: int = 100_000, block_bytes: int = 32_000_000) -> DataFrame:
    """Each conversation of ``rows`` (``c``, ``t``, ``role``, ``text``, ``n`` as ``damage`` and ``as_rows`` give them) with its
    counts of faults, the cheapest repair and its text: ``c``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``,
    ``cost``, ``audit``, ``repaired`` (if ``texts``; null for a conversation that is dealt into blocks), ``repaired_sha256``.

    Rows go by turn, nulls first; rows of one turn by role and text. Null ids are one conversation; one whose rows are all
    gone (``n`` of 0) has zeros, an empty audit and the hash of the empty text. A gap count beyond a long is the largest
    long. An empty table gives no rows. The audit of a conversation is one string, a letter for each edit, so that alone
    grows with a conversation; its text doesn't meet in one task, and its hash, which is sequential, is taken piece by piece.
    """
    bound_batches(rows.sparkSession)
    kind = rows.schema["c"].dataType.simpleString()
    rows = _faults(rows)
    size = rows.groupBy("c").agg(F.sum("n").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    named = F.coalesce(F.concat(F.lit("="), F.col("c").cast("string")), F.lit(""))
    large, n = counted_cut(size.where((F.col("n") > block_rows) | (F.col("bytes") > block_bytes)).withColumn("g", named), "large-conversations")
    if not n:
        return _whole(rows, kind, texts)
    sums = large.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    parts = math.ceil(max(sums["n"] / block_rows, sums["bytes"] / block_bytes)) + 1
    rows = rows.withColumn("g", named)
    return _whole(rows.join(large.select("g"), "g", "left_anti"), kind, texts).unionByName(_split(rows, large, parts))


def repair_conversations(turns: DataFrame, key: str = "conv_id", **sizes) -> DataFrame:
    """The digest of the damaged conversations: ``key``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``,
    ``audit``, ``repaired_sha256``. Null roles and texts count as one space, as do null ids and turns in the damage; extra
    columns are left out. See ``repair``."""
    return repair(damage(turns, key), texts=False, **sizes).drop("repaired").withColumnRenamed("c", key)


#: Rows of the query by a plain recursion over audit strings.
ORACLE = r"""
with recursive bytes as (select i from range(256) r(i)),
steps as (select i, list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), i) as c from bytes),
crc_table as (select list(c order by i) as t from steps),
named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, hex(encode(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '))) as h from conversations),
marked as (select *, xor(list_reduce(list_transform(range(strlen(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) % 20 as k from named, crc_table),
damaged as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from (select *, unnest(range(case when k = 3 then 2 else 1 end)) from marked where k <> 0)),
ordered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged),
seen as (
  select *, left(role, 1) as c, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
    not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as cut_off, lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair from ordered),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (not blank and again) as duplicate,
    count(*) filter (not blank and not again and cut_off) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, max(i) as n from seen group by 1),
macros as (select run, edit from range(3) r(run), (values ('D'), ('K'), ('R')) e(edit)),
ways as (select s, run, edit, case when run = 0 then s when (s = 2) = (run = 1) then 3 else 2 end as mid,
  list_transform(range(run), lambda j: case when (s = 2) = (j = 0) then 'assistant:' else 'user:' end) as lines from range(4) r(s), macros),
paths as (
  select conv_id, 0::bigint as i, 0::bigint as s, 0::bigint as cost, '' as audit, []::varchar[] as lines from counts
  union all
  select conv_id, i, s, cost, audit, lines from (
    select p.conv_id, o.i, case w.edit when 'D' then w.mid when 'R' then (case when w.mid = 2 then 3 else 2 end) else (case o.c when 's' then 1 when 'u' then 2 else 3 end) end as s,
      p.cost + 3 * w.run + case w.edit when 'D' then 4 when 'R' then 3 else 0 end + case when w.edit <> 'D' and o.cut_off then 3 else 0 end as cost,
      p.audit || repeat('I', w.run) || w.edit as audit,
      p.lines || w.lines || case w.edit when 'D' then [] when 'K' then [o.role || ':' || o.text] else [(case when w.mid = 2 then 'assistant:' else 'user:' end) || o.text] end as lines
    from paths p join seen o on o.conv_id is not distinct from p.conv_id and o.i = p.i + 1 join ways w on w.s = p.s
    where w.edit = 'D' or (not o.blank and not o.again and (w.edit = 'R' or (o.c = 's' and w.mid = 0) or (o.c = 'u' and w.mid <> 2) or (o.c = 'a' and w.mid = 2)))
  ) qualify row_number() over (partition by conv_id, i, s order by cost, audit) = 1),
closed as (
  select p.conv_id, p.cost + 3 * n_close as cost, p.audit || repeat('I', n_close) as audit, p.lines || (case n_close when 0 then [] when 1 then ['assistant:'] else ['user:', 'assistant:'] end) as lines
  from (select *, case s when 1 then 2 when 2 then 1 else 0 end as n_close from paths) p join counts k on k.conv_id is not distinct from p.conv_id and k.n = p.i
  qualify row_number() over (partition by p.conv_id order by p.cost + 3 * n_close, p.audit || repeat('I', n_close)) = 1)
select a.conv_id, coalesce(k.gaps, 0) as gaps, coalesce(k.blank, 0) as blank, coalesce(k.duplicate, 0) as duplicate, coalesce(k.truncated, 0) as truncated, coalesce(k.illegal, 0) as illegal,
  coalesce(c.cost, 0) as cost, coalesce(c.audit, '') as audit, sha256(coalesce(array_to_string(c.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) a left join counts k on k.conv_id is not distinct from a.conv_id left join closed c on c.conv_id is not distinct from a.conv_id"""
