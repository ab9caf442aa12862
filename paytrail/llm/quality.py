"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import Packed, fit_in_task, fold, labelled_texts
from .networks import TwoLayer
from .pieces import text_blocks
from .storage import bound_batches
from .word_vectors import Pooler, fit_context


#: Bytes of text that are scored at once: what a task needs beside its cache grows with this alone.
BLOCK = 1_000_000


class TextModel:
    """Word vectors and the network on top of them."""

    def __init__(self, texts: list[str], y: np.ndarray, spare: np.ndarray, classes: int):
        self.words = fit_context([t for t, s in zip(texts, spare, strict=True) if not s])
        pooler = Pooler(self.words)
        arr = pa.array(texts, pa.string())
        x = np.concatenate([pooler.pool(arr[s]) for s in text_blocks(arr, 1_000_000)]) if texts else np.zeros((0, Pooler.width), np.float32)
        self.net = TwoLayer(classes).fit(x, y, spare) if len(texts) else None
        self.classes = classes

    def scorer(self):
        pooler = Pooler(self.words)
        return lambda texts: self.net.predict(pooler.pool(texts)) if self.net else np.full((len(texts), self.classes), 1 / self.classes)


def _build(rows: list[dict]) -> TextModel:
    return TextModel([r["text"] for r in rows], np.array([int(r["quality"]) for r in rows], dtype=np.int64), np.array([r["fold"] == 1 for r in rows], dtype=bool), 2)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = 4000) -> Packed:
    """A model of ``labels.quality``, from at most ``rows`` labelled rows outside fold 0; fold 1 sets the temperature."""
    return fit_in_task(labelled_texts(docs, labels, ["quality"], key, text, rows), _build)


def score_quality(docs: DataFrame, model: TextModel | Packed, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``key``, ``held_out``, ``score`` (calibrated probability of quality 1) and ``predicted`` (score >= ``threshold``).

    Whole texts in one narrow pass. A null text is scored as an empty one; repeated rows and null keys come back as they
    are; without labelled rows every score is 0.5; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(Packed.of(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value.load().scorer()
        for b in batches:
            for s in text_blocks(b.column(2), BLOCK):
                score = own(b.column(2)[s])[:, 1]
                part = b.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    slim = docs.select(F.col(key), (fold(key) == 0).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return slim.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: TextModel | Packed, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, all columns, in one narrow pass."""
    bound_batches(docs.sparkSession)
    sent, at, schema = docs.sparkSession.sparkContext.broadcast(Packed.of(model)), docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value.load().scorer()
        for b in batches:
            for s in text_blocks(b.column(at).fill_null(""), BLOCK):
                part = b.slice(s.start, s.stop - s.start)
                yield part.filter(pa.array(own(part.column(at).fill_null(""))[:, 1] >= threshold))

    return docs.mapInArrow(run, schema)
