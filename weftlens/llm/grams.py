"""Words, n-gram hashes, and columns of lists as flat arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Maximal runs of letters and digits of any script, in lower case; null stays null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists of long after one another, and the length of each list."""
    return np.asarray(lists.flatten()).astype(np.int64, copy=False), np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64, copy=False)


def places(values: np.ndarray, bits: int) -> np.ndarray:
    """Place of each value in a table of 2^bits."""
    return ((values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values, each spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def by_record(record: np.ndarray, values: np.ndarray, step: np.ndarray | None = None) -> np.ndarray:
    """Order of 64-bit values by record, which ascends, then by step (a byte), then by value without sign.

    One number holds all three, but for the last bits of the values; where they decide, the order is made again from the whole.
    """
    of = values.view(np.uint64)
    bits = max(1, int(record.max(initial=0)).bit_length())
    rest = 64 - bits - 8 * (step is not None)
    one = record.astype(np.uint64) << np.uint64(64 - bits) | of >> np.uint64(64 - rest)
    if step is not None:
        one |= step.astype(np.uint64) << np.uint64(rest)
    order = np.argsort(one)
    a, b = order[:-1], order[1:]
    alike = np.flatnonzero(one[a] == one[b])
    if (of[a[alike]] != of[b[alike]]).any():
        return np.lexsort((of, record) if step is None else (of, step, record))
    return order


def text_grams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes, sorted, of the runs of ``n`` words of texts with one blank between words, and their number in each text."""
    tokens = pc.split_pattern(texts.fill_null(""), " ")
    coded = tokens.flatten().dictionary_encode()
    lengths = np.asarray(tokens.value_lengths()).astype(np.int64)
    h = pd.util.hash_array(np.asarray(coded.dictionary, object), categorize=False)[np.asarray(coded.indices)]
    x, ends = h.copy(), np.repeat(np.cumsum(lengths), lengths)
    for k in range(1, n):
        x[:-k] = mixed(x[:-k]) + h[k:]
    whole = np.flatnonzero(np.arange(len(x)) + n <= ends)
    grams, record = mixed(x[whole]).view(np.int64), np.repeat(np.arange(len(lengths)), lengths)[whole]
    grams = grams[by_record(record, grams)]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (record[1:] != record[:-1])
    return grams[new], np.bincount(record[new], minlength=len(lengths))
