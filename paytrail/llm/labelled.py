"""Bounded samples of labelled rows, on which the models of this subpackage are fitted."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bound_batches


def fold(key: str, folds: int = 5) -> Column:
    """crc32 of the key's text, modulo ``folds``; 0 is held out. A null key is in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds, F.lit(0))


def labelled_texts(docs: DataFrame, labels: DataFrame, columns: list[str], key: str = "doc_id", text: str = "text", rows: int = 4000, chars: int = 30_000_000) -> DataFrame:
    """Whole texts of labelled rows that aren't held out: ``text``, ``columns`` of ``labels`` and ``fold``, in one partition.

    A sample of at most ``rows`` rows that ``docs`` has, in the order of a hash of the key. Their texts have ``chars`` characters
    at most: one that exceeds what is left of them is passed over, and those after it have their turn.
    Rows with a null label or key are left out; a key that repeats counts once, with the label that sorts first.
    """
    own = labels.select(F.col(key).alias("k"), *columns).where(F.col("k").isNotNull()).dropna()
    own = own.groupBy("k").agg(*(F.min(c).alias(c) for c in columns)).withColumn("fold", fold("k")).where("fold <> 0")
    held = docs.select(F.col(key).alias("k"))
    chosen = own.join(held, "k", "left_semi").orderBy(F.xxhash64("k"), "k").limit(rows)
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # the sample has at most ``rows`` rows
    found = texts.join(F.broadcast(chosen), "k").groupBy("k", *columns, "fold").agg(F.min("text").alias("text"))
    bound_batches(docs.sparkSession)
    found = found.repartition(1).sortWithinPartitions(F.xxhash64("k"), "k").select("text", *columns, "fold")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = chars
        for b in batches:
            own = []
            for n in pc.utf8_length(b.column(0)).to_pylist():
                own.append(n <= left)
                left -= n if own[-1] else 0
            yield b.filter(pa.array(own, pa.bool_()))

    return found.mapInArrow(within, found.schema)


class Packed:
    """A fitted model as bytes, which each worker unpacks once."""

    def __init__(self, data: bytes):
        self.data, self.mark = data, uuid.uuid4().hex

    @classmethod
    def of(cls, model) -> Packed:
        return model if isinstance(model, cls) else cls(pickle.dumps(model))

    def load(self):
        if self.mark not in _unpacked:
            _unpacked.clear()
            _unpacked[self.mark] = pickle.loads(self.data)
        return _unpacked[self.mark]


_unpacked: dict = {}


def fit_in_task(sample: DataFrame, build) -> Packed:
    """``build(rows)`` run in one task of the cluster, whose memory it takes, over the bounded ``sample`` (rows as dicts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(build(rows))], pa.binary())], names=["model"])

    found = sample.coalesce(1).mapInArrow(run, "model binary").collect()
    return Packed(bytes(found[0]["model"])) if found else Packed.of(build([]))  # an empty table may have no task
