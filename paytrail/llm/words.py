"""White-space separated words of a block of texts, numbered by Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def strings(column: pa.Array) -> list[str]:
    """The column's values as a list (made in one go, several times as fast as ``to_pylist``)."""
    return column.to_numpy(zero_copy_only=False).tolist()


def word_numbers(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word of all texts in order, bounds of the texts in it); a blank text has no words."""
    texts = texts.cast(pa.large_string())
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts) if lower else texts))
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    at = coded.indices.to_numpy().astype(np.int64)
    blank = pc.index(coded.dictionary, "").as_py()
    if blank >= 0:
        own = at != blank
        at, bounds = at[own], np.r_[0, np.cumsum(own)][bounds]
    return coded.dictionary, at, bounds
