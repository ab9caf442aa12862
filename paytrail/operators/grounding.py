"""Drafts that must keep to a schema, and payloads cut down to what a trace is for."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytrail.plans.cut import counted_cut

#: The schema of a draft, and its levels of risk.
SCHEMA = "narrative string, risk_level string, cited array<string>"
LEVELS = ("low", "medium", "high")
FAILED = "SCHEMA_PARSE_FAILURE"
#: Fields of a payload that are left out, or told by their number; entries that other lists keep.
OMITTED, SUMMARISED, MOST = frozenset({"batch_graph"}), frozenset({"records", "wires", "transactions"}), 25


def read_reply(reply: Column) -> tuple[Column, Column]:
    """(the draft, null unless the reply keeps to the schema; why it doesn't, null if it does)."""
    read = F.from_json(reply, f"{SCHEMA}, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    why = (
        F.when(reply.isNull(), "no reply").when(read.isNull() | read["broken"].isNotNull(), "not an object of the schema").when(read["narrative"].isNull(), "no narrative")
        .when(F.coalesce(~read["risk_level"].isin(*LEVELS), F.lit(True)), "no such risk level").when(read["cited"].isNull() | F.exists(read["cited"], lambda c: c.isNull()), "no list of citations")
    )
    return F.when(why.isNull(), F.struct(*(read[c].alias(c) for c in ("narrative", "risk_level", "cited")))), why


def ground(rows: DataFrame, draft: Callable[[DataFrame, int], DataFrame], attempts: int = 3) -> DataFrame:
    """``rows`` with ``narrative``, ``risk_level``, ``cited``, ``attempts`` and ``note`` (null for a draft that keeps to the schema).

    ``draft`` takes rows with ``error`` (why the last reply was refused; null at first) and the number of the attempt, and returns them
    with ``reply``, JSON as text. Only refused rows are drafted again, at most ``attempts`` times in all; those that never
    keep to the schema have nulls, and a note on which they wait for review.
    """
    names, left, done, n = rows.columns, rows.withColumn("error", F.lit(None).cast("string")), [], 1
    for attempt in range(1, attempts + 1):
        read, why = read_reply(F.col("reply"))
        tried, n = counted_cut(draft(left, attempt).select(*names, read.alias("draft"), why.alias("error"), F.lit(attempt).alias("attempts")), "drafts")
        last = attempt == attempts
        done.append(tried if last else tried.where("error is null"))
        left = tried.where("error is not null").select(*names, "error")
        if last or not n or not left.limit(1).count():
            break
    found = reduce(DataFrame.unionByName, done)
    return found.select(*names, *(F.col(f"draft.{c}").alias(c) for c in ("narrative", "risk_level", "cited")), "attempts", F.when(F.col("error").isNotNull(), F.concat(F.lit(f"{FAILED}: "), "error")).alias("note"))


def cut_down(value, most: int = MOST):
    """A JSON value without bulk: some fields left out or counted, other lists cut to ``most`` entries and a line on the rest."""
    if isinstance(value, dict):
        out = {}
        for key, item in value.items():
            name = key.lower()
            if name in OMITTED:
                out[key] = "[left out of the trace]"
            elif name in SUMMARISED and isinstance(item, list):
                out[key] = f"[{len(item)} entries left out of the trace]"
            else:
                out[key] = cut_down(item, most)
        return out
    if isinstance(value, list):
        rest = len(value) - most
        return [cut_down(x, most) for x in value[:most]] + ([f"{rest} more left out"] if rest > 0 else [])
    return value


def trimmed(rows: DataFrame, column: str, most: int = MOST) -> DataFrame:
    """``rows`` with the JSON text in ``column`` cut down, at any depth; masks by field name come first (``redact``). What can't be read
    becomes a placeholder rather than going out as it is; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = b.schema.get_field_index(column), []
            for text in b.column(at).to_pylist():
                try:
                    out.append(None if text is None else json.dumps(cut_down(json.loads(text), most), ensure_ascii=False, separators=(",", ":")))
                except (ValueError, RecursionError):
                    out.append('"[unreadable payload left out]"')
            yield b.set_column(at, b.schema.field(at), pa.array(out, pa.string()))

    return rows.mapInArrow(run, rows.schema)
