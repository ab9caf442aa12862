"""SWIFT MT103 message logs: writing them, and reading them back exactly or not at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the format.
REQUIRED_TAGS = ("20", "23B", "32A", "50K", "52A", "57A", "59")
OPEN, CLOSE = "{1:", "-}"
TAG = r"^:(\d{2}[A-Z]?):(.*)$"
MONEY = r"^(\d{6})([A-Z]{3})([\d.,]+)$"
CLOCK = r"\b(\d{2}):(\d{2}):(\d{2})\b"
FIELDS = ["file", "ordinal", "reference", "value_date", "currency", "amount", "sender_account", "sender_name", "sender_address", "sender_bic", "sender_country",
          "receiver_account", "receiver_name", "receiver_address", "receiver_bic", "receiver_country", "operation", "memo", "charges", "instruction", "uetr"]


def read_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file``, ``text`` of log files: UTF-8, or Latin-1 where the bytes aren't; no bytes are refused, and an
    empty file gives no row."""
    raw = spark.read.format("binaryFile").load(paths)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return raw.select(F.col("path").alias("file"), text.alias("text"))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file``, ``ln``, ``line``, ``ordinal`` (messages begun so far) of log files of any size.

    The files are split over tasks by byte ranges. Each range counts its own lines and messages; what the ranges before it
    hold is added from sums of one row for each range, so a message that crosses a border is one message. A file whose
    bytes aren't UTF-8 is Latin-1 as a whole. An empty file gives no row.
    """
    raw = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), "value")
    raw = raw.withColumn("opens", F.startswith("value", F.lit(OPEN)).cast("int"))
    ranges = raw.groupBy("file", "block").agg(F.count("*").alias("lines"), F.sum("opens").alias("opens"), F.bool_and(F.try_validate_utf8("value").isNotNull()).alias("utf8"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("file", "block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("lines", "opens")), F.min("utf8").over(Window.partitionBy("file")).alias("utf8"))
    own = Window.partitionBy("file", "block").orderBy("k")
    rows = raw.withColumns({"n": F.row_number().over(own) - 1, "m": F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0))}).join(ranges, ["file", "block"])
    line = F.when(F.col("utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    return rows.select("file", (F.col("n") + F.col("lines_before")).alias("ln"), F.rtrim(line).alias("line"), (F.col("m") + F.col("opens_before")).alias("ordinal"))


def text_lines(logs: DataFrame) -> DataFrame:
    """The same of ``file``, ``text``, whole texts in rows."""
    lines = logs.select("file", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("ln", "raw")).select("file", "ln", F.rtrim("raw").alias("line"))
    flow = Window.partitionBy("file").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("ordinal", F.count_if(F.startswith("line", F.lit(OPEN))).over(flow))


def as_lines(logs: DataFrame) -> DataFrame:
    """Lines of logs that are lines already, or texts."""
    return logs if "line" in logs.columns else text_lines(logs)


def header(logs: DataFrame) -> DataFrame:
    """``file``, ``statement``, ``declared`` of each log (texts or lines); null where the log doesn't say."""
    says = {"statement": r"^Statement reference\s*:\s*(\S+)", "declared": r"^Messages in batch\s*:\s*(\d+)"}
    if "line" not in logs.columns:
        picked = {k: F.nullif(F.regexp_extract("text", f"(?m){p}", 1), F.lit("")) for k, p in says.items()}
        return logs.select("file", picked["statement"].alias("statement"), picked["declared"].try_cast("long").alias("declared"))
    first = {k: F.min(F.when(F.rlike("line", F.lit(p)), F.struct("ln", F.regexp_extract("line", p, 1).alias("x")))) for k, p in says.items()}
    return logs.groupBy("file").agg(first["statement"]["x"].alias("statement"), first["declared"]["x"].try_cast("long").alias("declared"))


def split_messages(logs: DataFrame) -> DataFrame:
    """``file``, ``ordinal`` (from 1), ``ln``, ``line`` of every line in a message; what lies between messages is dropped,
    an unterminated message is kept."""
    before = F.count_if(F.col("line") == CLOSE).over(Window.partitionBy("file", "ordinal").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1))
    return as_lines(logs).where("ordinal > 0").withColumn("closed", before).where("coalesce(closed, 0) = 0").select("file", "ordinal", "ln", "line")


def messages(logs: DataFrame) -> DataFrame:
    """``file``, ``ordinal`` (from 1), ``lines`` of every message, up to its end if it has one. A whole text is cut within its row, so nothing is
    shuffled; lines are brought together by message once."""
    if "line" in logs.columns:
        listed = F.array_sort(F.collect_list(F.struct("ln", "line")))
        return split_messages(logs).groupBy("file", "ordinal").agg(F.transform(listed, lambda x: x["line"]).alias("lines"))
    parts = F.split(F.concat(F.lit("\n"), "text"), r"(?:\r\n|\r|\n)(?=\{1:)")  # the first is what stands before all messages
    own = logs.select("file", F.posexplode(parts).alias("ordinal", "part")).where("ordinal > 0")
    lines = F.transform(F.split("part", r"\r\n|\r|\n"), lambda x: F.rtrim(x))  # the lambda keeps the index from it
    return own.select("file", F.col("ordinal").cast("long").alias("ordinal"), _let(lines, _until_close).alias("lines"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _until_close(lines: Column) -> Column:
    end = F.array_position(lines, CLOSE).cast("int")
    return F.when(end > 0, F.slice(lines, F.lit(1), end)).otherwise(lines)


def _fields(lines: Column) -> Column:
    """Map of tag to its lines, of the lines of a message."""
    tag = lambda x: F.nullif(F.regexp_extract(x, TAG, 1), F.lit(""))
    read = lambda x: _let(tag(x), lambda t: F.struct(t.alias("tag"), F.trim(F.when(t.isNotNull(), F.regexp_extract(x, TAG, 2)).otherwise(x)).alias("value")))
    inner = F.transform(F.filter(lines, lambda x: (x != CLOSE) & ~F.startswith(x, F.lit(OPEN))), read)

    def by_tag(own: Column) -> Column:
        starts = F.filter(F.transform(own, lambda x, i: F.when(x["tag"].isNotNull(), i)), lambda i: i.isNotNull())
        return _let(starts, lambda at: last(own, at))

    def last(own: Column, at: Column) -> Column:
        said = lambda part: F.transform(F.filter(part, lambda x: x["tag"].isNotNull() | (x["value"] != "")), lambda x: x["value"])
        lines_of = F.transform(at, lambda i, k: said(F.slice(own, i + 1, F.coalesce(F.get(at, k + 1), F.size(own)) - i)))
        tags = F.transform(at, lambda i: F.get(own, i)["tag"])
        return _let(F.struct(tags.alias("tags"), F.reverse(tags).alias("back"), lines_of.alias("lines")), picked)

    def picked(x: Column) -> Column:
        names = F.array_distinct(x["tags"])
        return F.map_from_arrays(names, F.transform(names, lambda t: F.get(x["lines"], F.size(x["tags"]) - F.array_position(x["back"], t).cast("int"))))

    return _let(inner, by_tag)


def read_fields(messages: DataFrame) -> DataFrame:
    """One row per message (``file``, ``ordinal``, ``lines``): ``first`` line, ``ended``, ``raw`` and ``fields``, a map of tag to its lines. A line without
    a tag continues the tag above; a tag that comes again takes the place of the first."""
    read = lambda x: F.struct(F.get(x, F.lit(0)).alias("first"), (F.element_at(x, -1) == CLOSE).alias("ended"), F.array_join(x, "\n").alias("raw"), _fields(x).alias("fields"))
    # generated, so that no filter on what follows reads a message again
    return messages.select("file", "ordinal", F.explode(F.transform(F.array("lines"), read)).alias("m")).select("file", "ordinal", "m.*")


def amount_reason(raw: Column) -> Column:
    """Why an amount is refused: exactly one decimal comma, no dot, a number, above zero. Null if it is fine."""
    commas = F.length(raw) - F.length(F.replace(raw, F.lit(","), F.lit("")))
    value = parse_amount(raw)
    return F.when(F.contains(raw, F.lit(".")), "amount has a dot").when(commas != 1, "amount needs one decimal comma").when(value.isNull(), "amount is not a number").when(value <= 0, "amount is not positive")


def parse_amount(raw: Column) -> Column:
    """Digits with one decimal comma and no dot; null for anything else."""
    one = F.length(raw) - F.length(F.replace(raw, F.lit(","), F.lit(""))) == 1
    return F.when(one & ~F.contains(raw, F.lit(".")), F.replace(raw, F.lit(","), F.lit(".")).try_cast("decimal(18,2)"))


def parse_value_date(raw: Column) -> Column:
    return F.try_to_timestamp(F.concat(F.lit("20"), raw), F.lit("yyyyMMdd")).cast("date")


def country_of(bic: Column) -> Column:
    """Characters 5 and 6 of a BIC; null if they aren't letters."""
    return F.when(F.rlike(bic, F.lit(r"^.{4}\p{L}{2}")), F.upper(F.substring(bic, 5, 2)))


def instruction_type(text: Column) -> Column:
    """All of the payment type after ``/INS/``, without the time."""
    body = F.element_at(F.split(text, "/INS/"), -1)
    return F.when(F.contains(text, F.lit("/INS/")), F.trim(F.regexp_replace(F.regexp_replace(body, CLOCK, " "), r"\s+", " "))).otherwise(F.lit(""))


def instruction_seconds(text: Column) -> Column:
    """Seconds of the day in an instruction; 0 without a time, null for a time that doesn't exist."""
    h, m, s = (F.regexp_extract(text, CLOCK, k).try_cast("int") for k in (1, 2, 3))
    return F.when(~F.rlike(text, F.lit(CLOCK)), 0).when((h < 24) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)


def parse_messages(logs: DataFrame) -> DataFrame:
    """One row per message of ``logs`` (``read_lines``, or texts) with all of ``FIELDS``, ``ts``, ``instrument``, ``raw`` and ``reason``, null if it is accepted.

    The first fault in reading order is the reason. An empty reference and an impossible time are faults too.
    """
    f = lambda tag: F.col("fields")[tag]
    first = lambda tag: F.coalesce(f(tag)[0], F.lit(""))
    part = lambda k: F.regexp_extract(first("32A"), MONEY, k)
    account = lambda tag: F.trim(F.regexp_replace(first(tag), "^/+", ""))
    address = lambda tag: F.coalesce(F.array_join(F.slice(f(tag), 3, 1000), ", "), F.lit(""))
    clock = instruction_seconds(F.coalesce(F.array_join(f("72"), " "), F.lit("")))
    missing = F.filter(F.array(*map(F.lit, REQUIRED_TAGS)), lambda t: ~F.map_contains_key("fields", t))
    reason = (
        F.when(~F.col("ended"), "not terminated").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ",")))
        .when(~F.rlike(first("32A"), F.lit(MONEY)), "32A is not date, currency and amount").when(~F.rlike(account("50K"), F.lit(r"^\d+$")), "50K has no account number")
        .when(~F.rlike(account("59"), F.lit(r"^\d+$")), "59 has no account number").when(parse_value_date(part(1)).isNull(), "no such value date")
        .when(amount_reason(part(3)).isNotNull(), amount_reason(part(3))).when(country_of(first("52A")).isNull(), "52A is not a BIC").when(country_of(first("57A")).isNull(), "57A is not a BIC")
        .when(first("20") == "", "no reference").when(clock.isNull(), "no such time")
    )
    joined = lambda tag: F.coalesce(F.array_join(f(tag), " "), F.lit(""))
    rows = read_fields(messages(logs)).select(
        "file", "ordinal", F.nullif(first("20"), F.lit("")).alias("reference"), parse_value_date(part(1)).alias("value_date"), part(2).alias("currency"), parse_amount(part(3)).alias("amount"),
        account("50K").alias("sender_account"), F.coalesce(F.get(f("50K"), F.lit(1)), F.lit("")).alias("sender_name"), address("50K").alias("sender_address"), first("52A").alias("sender_bic"), country_of(first("52A")).alias("sender_country"),
        account("59").alias("receiver_account"), F.coalesce(F.get(f("59"), F.lit(1)), F.lit("")).alias("receiver_name"), address("59").alias("receiver_address"), first("57A").alias("receiver_bic"), country_of(first("57A")).alias("receiver_country"),
        first("23B").alias("operation"), joined("70").alias("memo"), first("71A").alias("charges"), joined("72").alias("instruction"), F.regexp_extract("first", r"\{3:\{121:([0-9a-fA-F-]{36})\}\}", 1).alias("uetr"), "raw", reason.alias("reason"),
    )
    seconds = instruction_seconds(F.col("instruction"))
    kind = F.coalesce(F.nullif(instruction_type(F.col("instruction")), F.lit("")), F.nullif("operation", F.lit("")), F.lit("UNKNOWN"))
    stamp = F.expr("cast(value_date as timestamp_ntz)") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return rows.withColumns({"ts": F.when(F.col("reason").isNull(), stamp), "instrument": kind})


def ingest(logs: DataFrame, rescue=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted rows, quarantine, one validation row). ``rescue`` gets the refused rows and returns those it could repair,
    in the shape of ``parse_messages``; each message is tried once."""
    rows = parse_messages(logs)
    good, bad = rows.where("reason is null"), rows.where("reason is not null")
    saved = rescue(bad) if rescue else rows.limit(0)
    left = bad.join(saved.select("file", "ordinal"), ["file", "ordinal"], "left_anti")
    declared = header(logs).agg(F.sum("declared").alias("declared"))
    counts = rows.agg(F.count_if(F.col("reason").isNull()).alias("parsed"), F.countDistinct(F.when(F.col("reason").isNull(), F.col("reference"))).alias("distinct_references"), F.count_if(F.col("reason").isNotNull()).alias("refused"))
    report = declared.crossJoin(counts).crossJoin(saved.agg(F.count("*").alias("rescued")))  # one row each
    report = report.withColumn("complete", F.coalesce(F.col("declared") == F.col("parsed") + F.col("rescued"), F.lit(False)))
    return good.unionByName(saved), left.select("file", "ordinal", "reference", "reason", "raw", F.lit(rescue is not None).alias("fallback_attempted")), report


def render(ledger: DataFrame) -> DataFrame:
    """``pos``, ``txn_ref``, ``message``: an MT103 block for each row; accounts come out as their digits behind a 1."""
    digits = lambda c: F.concat(F.lit("1"), F.regexp_replace(c, r"\D", ""))
    bic = lambda account, country: F.concat(F.lit("BANK"), country, F.lpad(F.pmod(F.crc32(account.cast("binary")), F.lit(100)).cast("string"), 2, "0"))
    s, r = F.col("sender_account"), F.col("receiver_account")
    kind = F.upper(F.replace("payment_kind", F.lit("_"), F.lit(" ")))
    hexed = F.md5("txn_ref")
    uetr = F.concat_ws("-", *(F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    lines = [
        F.concat(F.lit("{1:F01"), bic(s, F.col("sender_country")), F.lit("AXXX0000000000}{2:I103"), bic(r, F.col("receiver_country")), F.lit("XXXXN}{3:{121:"), uetr, F.lit("}}{4:")),
        F.concat(F.lit(":20:"), F.col("txn_ref")), F.lit(":23B:CRED"),
        F.concat(F.lit(":32A:"), F.date_format("ts", "yyMMdd"), F.col("currency"), F.replace(F.col("amount").cast("string"), F.lit("."), F.lit(","))),
        F.concat(F.lit(":50K:/"), digits(s)), F.concat(F.lit("Holder "), s), F.lit("1 Main Street"), F.col("sender_country"),
        F.concat(F.lit(":52A:"), bic(s, F.col("sender_country"))), F.concat(F.lit(":57A:"), bic(r, F.col("receiver_country"))),
        F.concat(F.lit(":59:/"), digits(r)), F.concat(F.lit("Holder "), r), F.lit("2 Side Street"), F.col("receiver_country"),
        F.concat(F.lit(":70:Payment "), F.col("txn_ref")), F.lit(":71A:SHA"), F.concat(F.lit(":72:/INS/"), kind, F.lit(" "), F.date_format("ts", "HH:mm:ss")), F.lit(CLOSE),
    ]
    return ledger.select("pos", "txn_ref", F.concat_ws("\n", *lines).alias("message"))


def render_logs(ledger: DataFrame, per_file: int = 500) -> DataFrame:
    """``file``, ``text`` of logs of at most ``per_file`` consecutive positions, with a statement header."""
    named = render(ledger).withColumn("file", F.concat(F.lit("batch-"), F.lpad(F.expr(f"cast(pos div {per_file} as string)"), 12, "0")))
    joined = named.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "message"))), lambda x: x["message"]), "\n\n").alias("body"), F.count("*").alias("n"))
    return joined.select("file", F.concat(F.lit("Statement reference : STMT-"), F.col("file"), F.lit("\nMessages in batch   : "), F.col("n").cast("string"), F.lit("\n\n"), F.col("body"), F.lit("\n")).alias("text"))


def write_logs(ledger: DataFrame, path: str, files: int) -> None:
    """The ledger's messages as ``files`` text files, in the order of their positions."""
    messages = render(ledger).repartitionByRange(files, "pos").sortWithinPartitions("pos")
    messages.select(F.concat("message", F.lit("\n")).alias("value")).write.text(path)
