"""Words of whole batches by Arrow kernels: no Python per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def word_table(texts: pa.Array, lower: bool = True, between: str = r"[^\p{L}\p{N}]+") -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, vocabulary): the words of text i are ``vocabulary[codes[offsets[i]:offsets[i + 1]]]``, in order.

    A word is a maximal run of letters and digits (of what ``between`` does not match), lower-cased unless ``lower``
    is false. A null text has no words."""
    t = pc.fill_null(texts, "")
    t = pc.utf8_lower(t) if lower else t
    t = pc.replace_substring_regex(t, pattern=between, replacement=" ")
    lists = pc.split_pattern(pc.utf8_trim(t, characters=" "), " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = lists.flatten().dictionary_encode()
    codes, vocabulary = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary
    empty = pc.index(vocabulary, "").as_py()
    if empty >= 0:  # a text without words has been cut into one empty word
        real = codes != empty
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    return offsets, codes, vocabulary


def per_word(vocabulary: pa.Array, value, kind=np.float64) -> np.ndarray:
    """``value`` of each word of a vocabulary, called once for each distinct word."""
    return np.fromiter(map(value, vocabulary.to_pylist()), kind, len(vocabulary))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of ``values`` in each stretch of ``offsets``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]
