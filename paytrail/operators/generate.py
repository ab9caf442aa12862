"""Synthetic ledgers: identities, references, clusters, and the background they are set in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components

# Fixed values of the ISO lists that the generator knows.
COUNTRIES = {"UK": "GB", "USA": "US", "UAE": "AE", "Germany": "DE", "France": "FR", "Spain": "ES", "Mexico": "MX"}
CURRENCIES = {"UK pounds": "GBP", "US dollar": "USD", "Dirham": "AED", "Euro": "EUR", "Mexican Peso": "MXN"}
FIRST = ("Ada", "Ben", "Cem", "Dia", "Eli", "Fay", "Gus", "Hana")
LAST = ("Arlen", "Brook", "Castle", "Dover", "Ember", "Frost", "Grove", "Heath")


def iso(name: Column, table: dict[str, str]) -> Column:
    """The code of a name; a name that the list lacks fails the query."""
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(known[name], F.when(name.isNotNull(), F.raise_error(F.concat(F.lit("no code for "), name))))


def _pick(words: tuple[str, ...], account: Column, salt: str) -> Column:
    h = F.conv(F.substring(F.md5(F.concat(F.lit(salt), account)), 1, 7), 16, 10).cast("long")
    return F.element_at(F.array(*map(F.lit, words)), (h % len(words) + 1).cast("int"))


def party(account: Column) -> Column:
    """A holder's name, the same for an account in every run."""
    return F.concat_ws(" ", _pick(FIRST, account, "first"), _pick(LAST, account, "last"))


def uetr(ref: Column) -> Column:
    h = F.md5(ref)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def mint_references(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``reference``: FGO, the date, and a number that starts anew every day."""
    place = F.row_number().over(Window.partitionBy(F.to_date("ts")).orderBy(*order))
    return rows.withColumn("reference", F.concat(F.lit("FGO"), F.date_format("ts", "yyMMdd"), F.lpad(place.cast("string"), 5, "0")))


def clusters(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: accounts that payments connect."""
    return connected_components(edges.where("sender_account <> receiver_account").select(F.col("sender_account").alias("a"), F.col("receiver_account").alias("b")).distinct())


def contained(edges: DataFrame) -> DataFrame:
    """``root``, ``n``, ``months``, ``inside`` (all in one month) of every cluster."""
    rows = edges.where("sender_account <> receiver_account").join(clusters(edges).withColumnRenamed("node", "sender_account"), "sender_account")
    return rows.groupBy("root").agg(F.count("*").alias("n"), F.countDistinct(F.date_format("ts", "yyyy-MM")).alias("months")).withColumn("inside", F.col("months") == 1)


def redomicile(edges: DataFrame, abroad: DataFrame, country: str, currency: str) -> DataFrame:
    """One leg moved: the rows of ``abroad`` (``txn_ref``) get another receiving country and currency."""
    moved = edges.join(abroad.select("txn_ref").distinct().withColumn("__m", F.lit(True)), "txn_ref", "left")
    return moved.withColumns({"receiver_country": F.when(F.col("__m"), country).otherwise(F.col("receiver_country")), "currency": F.when(F.col("__m"), currency).otherwise(F.col("currency"))}).drop("__m")


def share_of(edges: DataFrame, flagged: DataFrame) -> DataFrame:
    """One row: ``flagged``, ``total``, ``share``, and whether the share keeps to a cap of a tenth."""
    own = edges.join(flagged.select("txn_ref").distinct().withColumn("__f", F.lit(1)), "txn_ref", "left")
    out = own.agg(F.count("__f").alias("flagged"), F.count("*").alias("total"))
    return out.withColumn("share", F.round(F.col("flagged") / F.col("total"), 6)).withColumn("within_cap", F.col("share") <= 0.1)


def threshold_aligned(edges: DataFrame, key: str, low: float = 8000, high: float = 10000) -> DataFrame:
    """``key``, ``aligned``: at least half of its rows lie in the band."""
    return edges.groupBy(key).agg((F.avg(F.col("amount").between(low, high - 0.01).cast("int")) >= 0.5).alias("aligned"))


def manifest_problems(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``artifact``, ``problem``: what a manifest (artifact, sha256, role, tier, authority) says against the files (artifact,
    content): missing, changed, or classified against the rules."""
    have = files.select("artifact", F.sha2("content", 256).alias("have"))
    both = manifest.join(have, "artifact", "left")
    checks = F.array_compact(F.array(
        F.when(F.col("have").isNull(), "missing"), F.when(F.col("have") != F.col("sha256"), "changed"), F.when(~F.col("tier").isin("statute", "regulation", "guidance"), "tier"),
        F.when((F.col("authority") == "binding") != F.col("tier").isin("statute", "regulation"), "authority"), F.when(F.col("role").isNull(), "role"),
    ))
    return both.select("artifact", F.explode(checks).alias("problem"))
