"""Masking what could name a customer before anything leaves the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fields by what they hold, and the shapes that are masked in free text.
ACCOUNT_FIELDS = {
    "account", "sender_account", "receiver_account", "anchor", "anchor_account", "originator", "beneficiary", "counterparty", "counterparties", "collector_account",
    "route", "sink", "intermediaries", "source", "target", "nodes", "hub", "senders", "receivers", "collectors", "feeders", "layers",
}
FREE_TEXT_FIELDS = {"memo", "narrative", "summary", "reason", "note", "notes", "review_notes", "text_excerpt"}
#: Fields that hold a JSON object as text, whose own fields are masked by their names.
JSON_FIELDS = {"attributes"}
EMAIL = r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
IBAN = r"(?U)\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b"
DIGITS = r"(?<![\d.])(?!\d{4}-\d{2}-\d{2})\+?(?:\d[ -]?){6,}\d(?![\d.])"


def pseudonym(account: Column, pepper: str) -> Column:
    """A stable token for an account; blank stays blank."""
    clean = F.trim(account)
    token = F.concat(F.lit("ACCT-"), F.substring(F.sha2(F.concat(F.lit(pepper + "|"), clean), 256), 1, 8))
    return F.when(account.isNull() | (clean == ""), F.lit("")).otherwise(token)


def scrub(text: Column) -> Column:
    """Addresses, bank account numbers and runs of seven digits or more masked; dates and decimals stay."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, EMAIL, "[EMAIL]"), IBAN, "[REDACTED]"), DIGITS, "[REDACTED]")


def has_identifier(text: Column) -> Column:
    return F.rlike(text, F.lit(EMAIL)) | F.rlike(text, F.lit(IBAN)) | F.rlike(text, F.lit(DIGITS))


def _masked_json(value: Column, pepper: str) -> Column:
    """A JSON object as text, masked field by field; lists of accounts are text with commas. Values come back as text."""
    each = lambda v: F.array_join(F.transform(F.split(v, ","), lambda x: pseudonym(x, pepper)), ",")
    named = lambda k, names: F.lower(k).isin(sorted(names))
    masked = F.transform_values(F.from_json(value, "map<string,string>"), lambda k, v: F.when(named(k, ACCOUNT_FIELDS), each(v)).when(named(k, FREE_TEXT_FIELDS), scrub(v)).otherwise(v))
    return F.when(value.isNotNull(), F.coalesce(F.to_json(masked), F.lit("{}")))  # what isn't an object says nothing


def _masked(value: Column, kind: T.DataType, name: str, pepper: str) -> Column:
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_masked(value[f.name], f.dataType, f.name, pepper).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _masked(x, kind.elementType, name, pepper))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: F.when(F.lower(k).isin(sorted(ACCOUNT_FIELDS)), _masked(v, kind.valueType, "account", pepper)).when(F.lower(k).isin(sorted(FREE_TEXT_FIELDS)), _masked(v, kind.valueType, "memo", pepper)).otherwise(_masked(v, kind.valueType, name, pepper)))
    if isinstance(kind, T.StringType) and name.lower() in ACCOUNT_FIELDS:
        return pseudonym(value, pepper)
    if isinstance(kind, T.StringType) and name.lower() in JSON_FIELDS:
        return _masked_json(value, pepper)
    if isinstance(kind, T.StringType) and name.lower() in FREE_TEXT_FIELDS:
        return scrub(value)
    return value


def redact(rows: DataFrame, pepper: str) -> DataFrame:
    """Every column, at any depth, by its field's name; a candidate's id loses its account, too. Sentences and evidence lines
    are masked by rendering them from masked rows (``describe`` and ``edge_lines`` of what this returns)."""
    cols = [_masked(F.col(f"`{f.name}`"), f.dataType, f.name, pepper).alias(f.name) for f in rows.schema.fields]
    out = rows.select(*cols)
    if "candidate_id" in rows.columns:
        parts = F.split("candidate_id", ":")
        out = out.withColumn("candidate_id", F.concat_ws(":", parts[0], pseudonym(parts[1], pepper), parts[2]))
    return out
