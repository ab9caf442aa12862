"""The ledger: payments as rows, which are also the edges of a directed temporal multigraph.

``events`` stands in for a month of messages, and a fixed overlay plants at least one instance of every shape and a few
near misses. One SQL text serves Spark and DuckDB, so an oracle sees the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "pos, txn_ref, sender_account, receiver_account, amount, ts, payment_kind, sender_country, receiver_country, currency"
#: The payment vocabulary, by lower-cased name.
PAYMENT_KINDS = {
    "cash deposit": "cash_deposit", "cash withdrawal": "cash_withdrawal", "cross-border": "cross_border", "ach": "ach",
    "wire": "wire", "cheque": "cheque", "credit card": "card", "debit card": "card",
}


def planted() -> list[tuple[str, str, str, str, str, float, int, int, str]]:
    """(instance, shape, ref, sender, receiver, amount, day of January 2024, hour, kind); shape '' for near misses."""
    rows: list[tuple] = []

    def add(instance: str, shape: str, *legs: tuple) -> None:
        for s, r, amount, day, hour, *kind in legs:
            rows.append((instance, shape, f"PLT{len(rows):05d}", s, r, amount, day, hour, kind[0] if kind else "wire"))

    add("structuring-a", "structuring", *(("PS1", f"PS1R{i}", 9100 + 110 * i, 3 + 2 * i, 10, "ach") for i in range(4)))
    add("structuring-b", "structuring", *((f"PS2S{i}", "PS2", 2450 + 90 * i, 4 + i, 11, "cash_deposit") for i in range(5)))
    add("fan-in", "fan_in", *((f"PF1S{i}", "PF1", 400 + 350 * i, 5 + i, 9) for i in range(6)))
    add("fan-out", "fan_out", *(("PF2", f"PF2R{i}", 700 + 275 * i, 6 + i, 15) for i in range(6)))
    add("cycle", "cycle", *((f"PC{i}", f"PC{(i + 1) % 5}", 20000 * 0.9**i, 2 + 3 * i, 12) for i in range(5)))
    add("scatter-gather", "scatter_gather", *(("PG0", f"PGM{i}", 5000 + 40 * i, 3, 8 + i) for i in range(4)), *((f"PGM{i}", "PG9", 4900 + 40 * i, 5 + i, 9) for i in range(4)))
    add("gather-scatter", "gather_scatter", *((f"PHI{i}", "PH", 3100 + 100 * i, 7 + i, 9) for i in range(4)), *(("PH", f"PHO{i}", 3000 + 100 * i, 12 + i, 16) for i in range(4)))
    add("deposit-send", "deposit_send", ("PDC0", "PD", 4000, 9, 9, "cash_deposit"), ("PD", "PDX0", 3960, 10, 9), ("PDC1", "PD", 4010, 9, 10, "cash_deposit"), ("PD", "PDX1", 4010, 11, 8, "cross_border"))
    add("layered-in", "layered_fan", *((f"PLL{b}{i}", f"PLB{b}", 1500 + 10 * i, 8 + i, 9 + b) for b in range(2) for i in range(3)), *((f"PLB{b}", "PL", 4400, 13, 9 + b) for b in range(2)))
    add("block", "bipartite", *((f"PBS{s}", f"PBR{r}", 1200 + 10 * s + r, 10 + s, 9 + r) for s in range(3) for r in range(4)))
    add("stack", "bipartite", *((f"PKA{s}", f"PKB{r}", 2100 + 10 * s + r, 10, 9 + r) for s in range(2) for r in range(3)), *((f"PKB{s}", f"PKC{r}", 2050 + 10 * s + r, 14, 9 + r) for s in range(3) for r in range(3)))
    add("miss-fan", "", *((f"PM1S{i}", "PM1", 500 + i, 5, 9 + i) for i in range(3)))
    add("miss-send", "", ("PM2C", "PM2", 5000, 3, 9, "cash_deposit"), ("PM2", "PM2X", 5000, 8, 9))
    add("miss-cycle", "", ("PM3A", "PM3B", 9000, 3, 9), ("PM3B", "PM3C", 4000, 4, 9), ("PM3C", "PM3A", 900, 5, 9))
    add("miss-band", "", *(("PM4", f"PM4R{i}", 10000 + i, 3 + i, 9, "ach") for i in range(3)))
    return rows


def _values(stamp: str) -> str:
    out = []
    for k, (_, _, ref, s, r, amount, day, hour, kind) in enumerate(planted()):
        there = "MX" if kind == "cross_border" else "US"
        out.append(f"({1_000_000_000_000 + k}, '{ref}', '{s}', '{r}', cast({amount:.2f} as decimal(18,2)), {stamp} '2024-01-{day:02d} {hour:02d}:00:00', '{kind}', 'US', '{there}', 'USD')")
    return ",\n".join(out)


def ledger_sql(dialect: str) -> str:
    """The ledger as a query over ``events``; ``dialect`` is ``spark`` or ``duckdb``."""
    text, stamp = ("string", "timestamp_ntz") if dialect == "spark" else ("varchar", "timestamp")
    micros = "timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', ts)" if dialect == "spark" else "epoch_us(ts)"
    nation = lambda n: f"case {n} % 5 when 0 then 'US' when 1 then 'GB' when 2 then 'DE' when 3 then 'AE' else 'US' end"
    return f"""
with size as (select cast(floor(count(*) / 2) as bigint) as m from events),
numbered as (
  select event_id, value, event_type, ts, (user_id * 7919 + event_id * 104729) % m as s, (event_id * 15485863 + user_id * 31) % m as r
  from events cross join size),
raw as (
  select event_id as pos, concat('FGO', lpad(cast(event_id as {text}), 10, '0')) as txn_ref, concat('A', cast(s as {text})) as sender_account,
    concat('A', cast(r as {text})) as receiver_account,
    cast((cast(round(value * 100) as bigint) * 200 + event_id % 100) / 100.0 as decimal(18,2)) as amount, ts,
    case event_type when 'signup' then 'cash_deposit' when 'purchase' then 'wire' when 'click' then 'ach' when 'view' then 'cheque' else 'card' end as payment_kind,
    {nation("s")} as sender_country, {nation("r")} as receiver_country, 'USD' as currency
  from numbered),
all_rows as (
  select {COLUMNS} from raw where amount > 0
  union all select * from (values {_values(stamp)}) as planted({COLUMNS}))
select {COLUMNS}, {micros} as us from all_rows"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of a data folder, with ``us``, microseconds since 1970."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(ledger_sql("spark").replace("from events", "from {events}"), events=events)


def labels(spark: SparkSession) -> DataFrame:
    """Planted instances: ``instance``, ``shape``, ``txn_ref``."""
    return spark.createDataFrame([(r[0], r[1], r[2]) for r in planted() if r[1]], "instance string, shape string, txn_ref string")


def labels_sql() -> str:
    rows = ", ".join(f"('{r[0]}', '{r[1]}', '{r[2]}')" for r in planted() if r[1])
    return f"select * from (values {rows}) as l(instance, shape, txn_ref)"


def period_slice(edges: DataFrame, month: str) -> DataFrame:
    """Rows of one month (``yyyy-MM``); a range on ``ts``, so a partitioned or sorted table is pruned."""
    first = F.to_timestamp_ntz(F.lit(f"{month}-01 00:00:00"))
    return edges.where((F.col("ts") >= first) & (F.col("ts") < F.add_months(first.cast("date"), 1).cast("timestamp_ntz")))


def payment_kind(name: Column) -> Column:
    """Vocabulary entry of a payment type, whatever its case and spacing; ``other`` for the rest."""
    known = F.create_map(*(F.lit(x) for kv in PAYMENT_KINDS.items() for x in kv))
    return F.coalesce(known[F.lower(F.regexp_replace(F.trim(name), r"\s+", " "))], F.lit("other"))
