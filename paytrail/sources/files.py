"""Files beside the message logs: transaction CSV, passages and questions as JSON, chunks as JSON lines, labels, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the transaction CSV and of a chunk.
CSV_SCHEMA = (
    "Time string, Date date, Sender_account string, Receiver_account string, Amount decimal(18,2), Payment_currency string, Received_currency string, Sender_bank_location string, Receiver_bank_location string, "
    "Payment_type string, Is_laundering int, Laundering_type string"
)
CHUNK_SCHEMA = "chunk_id string, text string, tier string, authority string, source_id string, section_ref string, jurisdiction string, topic_tags array<string>, effective_date string, version string, source_file string"
TIERS = ("statute", "regulation", "guidance")


def read_transactions(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """The CSV with its declared types, only the named months (``yyyy-MM``); a malformed value is null, the row stays."""
    rows = spark.read.schema(CSV_SCHEMA).option("header", True).option("mode", "PERMISSIVE").csv(path)
    rows = rows.withColumn("period", F.date_format("Date", "yyyy-MM"))
    return rows.where(F.col("period").isin(*months)) if months else rows


def as_ledger(rows: DataFrame) -> DataFrame:
    """Transactions in the shape of the ledger, numbered in order of time and parties."""
    from .ledger import payment_kind

    ts = F.to_timestamp_ntz(F.concat_ws(" ", F.col("Date").cast("string"), F.col("Time")), F.lit("yyyy-MM-dd HH:mm:ss"))
    ref = F.concat(F.lit("FGO"), F.substring(F.md5(F.concat_ws("|", "Date", "Time", "Sender_account", "Receiver_account", F.col("Amount").cast("string"))), 1, 12))
    return rows.select(
        ref.alias("txn_ref"), F.col("Sender_account").alias("sender_account"), F.col("Receiver_account").alias("receiver_account"), F.col("Amount").alias("amount"), ts.alias("ts"),
        payment_kind(F.col("Payment_type")).alias("payment_kind"), F.col("Sender_bank_location").alias("sender_country"), F.col("Receiver_bank_location").alias("receiver_country"), F.col("Payment_currency").alias("currency"),
    )


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """Passages of JSON documents (arrays of ID, DocumentID, PassageID, Passage); a missing passage is an empty one."""
    schema = "ID string, DocumentID int, PassageID string, Passage string"
    return spark.read.schema(schema).option("multiLine", True).json(path).fillna("", ["Passage"])


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """``question``, ``document``, ``passage``: one row per passage that answers."""
    schema = "Question string, Passages array<struct<DocumentID: int, PassageID: string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("p", F.explode("Passages"))
    return rows.select(F.col("Question").alias("question"), F.col("p.DocumentID").alias("document"), F.col("p.PassageID").alias("passage"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK_SCHEMA).json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines, after the checks of ``chunk_problems``."""
    bad = chunk_problems(chunks).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['chunk_id']}: {r['problem']}" for r in bad))
    chunks.write.mode("overwrite").json(path)


def chunk_problems(chunks: DataFrame) -> DataFrame:
    """``chunk_id``, ``problem``: repeated ids, empty texts, unknown tiers, law that isn't binding, another jurisdiction."""
    binding = F.col("tier").isin("statute", "regulation")
    checks = F.array_compact(F.array(
        F.when(F.trim("text") == "", "empty"), F.when(~F.col("tier").isin(*TIERS), "tier"), F.when((F.col("authority") == "binding") != binding, "authority"), F.when(F.col("jurisdiction") != "US", "jurisdiction"),
    ))
    rows = chunks.select("chunk_id", F.explode(checks).alias("problem"))
    return rows.unionByName(chunks.groupBy("chunk_id").count().where("count > 1").select("chunk_id", F.lit("repeated").alias("problem")))


def write_labels(labels: DataFrame, path: str) -> None:
    """Labels by log file: the files that ``labels`` names are replaced, others stay."""
    labels.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("log_file").csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``artifact`` and its fields, of a JSON object of objects."""
    kind = "map<string, struct<url: string, sha256: string, bytes: long, role: string, tier: string, authority: string, source_id: string, version: string, effective_date: string>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    return raw.select(F.explode("m").alias("artifact", "f")).select("artifact", "f.*")
