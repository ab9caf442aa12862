"""Sliding windows over one account's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paytrail.plans.cut import cut
from paytrail.plans.params import DAY_US


def widest_window(rows: DataFrame, key: str, minimum: Column, order: Column, size: Column, backward: bool) -> DataFrame:
    """Per ``key``: ``w_from``, ``w_to`` of the window with the most rows (earliest on ties) among those that qualify.

    ``rows`` carries ``w_from`` and ``w_to`` of the window that each row ends (``backward``) or starts.
    """
    edge = F.col("w_to") if backward else F.col("w_from")
    best = F.max_by(F.struct("w_from", "w_to"), F.struct(size, -edge))
    return rows.where(minimum).groupBy(key).agg(best.alias("w")).select(key, "w.w_from", "w.w_to")


#: Rows of a table up to which an account's rows go to one task; in larger ones they are dealt by blocks of time.
BUSY_ROWS = 2_000_000


def time_block(rows: DataFrame, busy_rows: int = BUSY_ROWS) -> int | None:
    """Length of the blocks of time by which an account's rows are dealt, a day; None where no account can be too busy."""
    return None if rows.count() <= busy_rows else DAY_US


#: Shares that accounts are dealt to, to see whether one of them can be busy.
SHARES = 65_536


def account_block(rows: DataFrame, key: str, busy_rows: int = BUSY_ROWS) -> int | None:
    """The same, by the fullest share of the accounts (``key``), which no account of it passes: a large ledger without busy accounts needs no
    blocks."""
    shares = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(SHARES)).alias("share")).agg(F.count("*").alias("n"))
    return DAY_US if (shares.agg(F.max("n")).first()[0] or 0) > busy_rows else None


def _sums_before(rows: DataFrame, keys: list[str], aggregates: dict[str, Column], forward: bool = False) -> DataFrame:
    """``keys``, ``block``: of each block the ``aggregates`` (sums, or a least or greatest) over all earlier (``forward``: later) blocks of its
    key, from one row for each block."""
    order = Window.partitionBy(*keys).orderBy(F.desc("block") if forward else "block").rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy(*keys, "block").agg(*(c.alias(k) for k, c in aggregates.items()))
    over = {k: {"n": F.sum, "d": F.sum, "before": F.max, "after": F.min}[k.split("_")[0]](k).over(order) for k in aggregates}
    return each.select(*keys, "block", *(c.alias(f"{k}_carried") for k, c in over.items()))


def running_sums(events: DataFrame, keys: list[str], sums: dict[str, Column], block_us: int | None) -> DataFrame:
    """``events`` with running sums by ``at``, events of one instant together. With ``block_us`` each block of time of a key is summed by a
    task of its own, and what lies before it is carried over."""
    if block_us is None:
        window = Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
        return events.select("*", *(F.sum(c).over(window).alias(k) for k, c in sums.items()))
    placed = events.select("*", *(c.alias(f"__{k}") for k, c in sums.items()), F.floor(F.col("at") / block_us).alias("block"))
    carried = _sums_before(placed, keys, {f"n_{k}": F.sum(f"__{k}") for k in sums})
    window = Window.partitionBy(*keys, "block").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    within = placed.join(carried, [*keys, "block"]).select("*", *(F.sum(f"__{k}").over(window).alias(f"__own_{k}") for k in sums))
    return within.select(*events.columns, *((F.col(f"__own_{k}") + F.coalesce(f"n_{k}_carried", F.lit(0))).alias(k) for k in sums))


def _neighbours(rows: DataFrame, keys: list[str], block_us: int | None) -> DataFrame:
    """``rows`` with ``before`` and ``after``, the times of the rows of their keys on both sides, null at the ends."""
    if block_us is None:
        own = Window.partitionBy(*keys).orderBy("us")
        return rows.select("*", F.lag("us").over(own).alias("before"), F.lead("us").over(own).alias("after"))
    placed = rows.withColumn("block", F.floor(F.col("us") / block_us))
    ends = _sums_before(placed, keys, {"before_us": F.max("us")}).join(_sums_before(placed, keys, {"after_us": F.min("us")}, True), [*keys, "block"])
    own = Window.partitionBy(*keys, "block").orderBy("us")
    near = placed.join(ends, [*keys, "block"]).select(*rows.columns, F.lag("us").over(own).alias("l"), F.lead("us").over(own).alias("r"), "before_us_carried", "after_us_carried")
    return near.select(*rows.columns, F.coalesce("l", "before_us_carried").alias("before"), F.coalesce("r", "after_us_carried").alias("after"))


def window_counts(rows: DataFrame, key: str, other: str, flow: Column, span_us: int, forward: bool, block_us: int | None = None) -> DataFrame:
    """``key``, ``flow``, ``us`` of each row with ``w_n``, rows of its key in the window of ``span_us`` that it ends
    (``forward``: starts), and ``w_true``, ``w_false``: distinct ``other`` there among rows whose ``flow`` holds or doesn't.

    A row counts in the windows of some stretch of time, and a counterparty in those of its rows' stretches taken together.
    So each count is a running sum of what enters and leaves, and the work is linear however many rows a window has. With
    ``block_us`` (see ``account_block``) a busy account fills several tasks.
    """
    own = _neighbours(rows.select(key, F.col(other).alias("who"), flow.alias("flow"), "us"), [key, "flow", "who"], block_us)
    far = F.lit(span_us + 1)
    marked = own.select(key, "flow", "us", (F.coalesce(F.col("us") - F.col("before"), far) > span_us).cast("int").alias("opens"), (F.coalesce(F.col("after") - F.col("us"), far) > span_us).cast("int").alias("shuts"))
    begin, end = (F.col("us") - span_us, F.col("us") + 1) if forward else (F.col("us"), F.col("us") + span_us + 1)
    event = lambda at, n, d, row: F.struct(at.alias("at"), F.lit(n).alias("n"), d.alias("d"), F.lit(row).alias("row"))
    events = [event(begin, 1, F.col("opens"), not forward), event(end, -1, -F.col("shuts"), False), *([event(F.col("us"), 0, F.lit(0), True)] if forward else [])]
    flat = marked.select(key, "flow", F.explode(F.array(*events)).alias("e")).select(key, "flow", "e.*")
    side = lambda f: F.when(F.col("flow") == f, F.col("d")).otherwise(0)
    summed = running_sums(flat, [key], {"w_n": F.col("n"), "w_true": side(True), "w_false": side(False)}, block_us)
    return summed.where("row").select(key, "flow", F.col("at").alias("us"), "w_n", "w_true", "w_false")


def fan_windows(edges: DataFrame, key: str, other: str, minimum: int, span_us: int) -> DataFrame:
    """Members of each account's widest trailing window with ``minimum`` distinct counterparties.

    Accounts with too few counterparties in all are left out before the window, which keeps busy keys off the sort; the
    semi-join is on the window's own key, so it costs no shuffle of its own beyond the aggregate.
    """
    able = edges.groupBy(key).agg(F.countDistinct(other).alias("d")).where(F.col("d") >= minimum).select(key)
    seen = window_counts(edges.join(able, key, "left_semi"), key, other, F.lit(True), span_us, False, account_block(edges, key))
    seen = seen.select(key, "w_n", "w_true", (F.col("us") - span_us).alias("w_from"), F.col("us").alias("w_to"))
    best = widest_window(seen, key, F.col("w_true") >= minimum, F.col("w_to"), F.col("w_n"), True)
    return edges.join(best, key).where(F.col("us").between(F.col("w_from"), F.col("w_to")))


def maximal_runs(rows: DataFrame, key: list[str], minimum: int, span_us: int, block_us: int | None = None) -> DataFrame:
    """``rows`` that lie in maximal runs within ``span_us``: one per distinct start, ``run_s`` to ``run_e`` in the key's
    order (``rn`` from 1); a row in several runs comes once for each. With ``block_us`` a busy key fills several tasks."""
    if block_us is None:
        order = Window.partitionBy(*key).orderBy("us", "txn_ref")
        numbered = rows.withColumn("rn", F.row_number().over(order).cast("long"))
        frame = Window.partitionBy(*key).orderBy("us").rangeBetween(-span_us, 0)
        starts = numbered.withColumn("run_s", F.min("rn").over(frame)).select(*key, "run_s", "rn")
    else:
        placed = rows.withColumn("block", F.floor(F.col("us") / block_us))
        carried = _sums_before(placed, key, {"n_rows": F.count("*")})
        own = F.row_number().over(Window.partitionBy(*key, "block").orderBy("us", "txn_ref"))
        numbered = placed.join(carried, [*key, "block"]).withColumn("rn", own + F.coalesce("n_rows_carried", F.lit(0))).select(*rows.columns, "rn")
        # a run starts behind all rows that lie more than the span before: a running count, asked for at that instant
        event = lambda at, n, rn: F.struct(at.alias("at"), F.lit(n).alias("n"), rn.alias("rn"))
        events = F.array(event(F.col("us"), 1, F.lit(None).cast("long")), event(F.col("us") - span_us - 1, 0, F.col("rn").cast("long")))
        flat = numbered.select(*key, F.explode(events).alias("e")).select(*key, "e.*")
        starts = running_sums(flat, key, {"past": F.col("n")}, block_us).where("rn is not null").select(*key, (F.col("past") + 1).alias("run_s"), "rn")
    runs = starts.groupBy(*key, "run_s").agg(F.max("rn").alias("run_e")).where(F.col("run_e") - F.col("run_s") + 1 >= minimum)
    return numbered.join(runs, key).where(F.col("rn").between(F.col("run_s"), F.col("run_e")))


def running_total(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running sums (of whole numbers) in a global order that tells all rows apart. Rows are sorted over many tasks; each sums its
    own, and what lies before a task comes from one row for each of them."""
    placed = rows.select("*", *(c.alias(f"__{k}") for k, c in sums.items())).orderBy(*order)
    placed = cut(placed.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "sorted")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    parts = placed.groupBy("__part").agg(*(F.sum(f"__{k}").alias(f"__{k}") for k in sums))
    parts = parts.select("__part", *(F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__before_{k}") for k in sums))
    own = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumns({f"__own_{k}": F.sum(f"__{k}").over(own) for k in sums}).join(parts, "__part")
    return summed.select(*rows.columns, *((F.col(f"__own_{k}") + F.col(f"__before_{k}")).alias(k) for k in sums))
