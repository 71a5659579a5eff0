"""Evaluation passages in training texts (problem 8).

Seeds are word n-grams of the test items, the rarest in the corpus of every
``intact`` words of an item: whatever stretch of that many words a text shares
with an item, unbroken, holds a seed, and common phrases are seeds nowhere a
rarer one stands beside them. A text that holds two seeds of an item is a
candidate; a Smith-Waterman alignment of the item with the text around them
scores it, insertions and changed words included, and tells the longest
unbroken run.

The corpus is read twice, once to count how many texts hold each n-gram of the
items and once to look for seeds and align; no text is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import flat, words

#: Item words in one block, which every worker holds (about 60 bytes each); more items are looked for block by block.
MOST_BLOCK_WORDS = 2_000_000

_OUT = "item_id long, doc_id long, score int, item_end int, doc_end int, longest_run int, item_share double"
_NAMES = ["item_id", "doc_id", "score", "item_end", "doc_end", "longest_run", "item_share"]


def align_many(items: list[np.ndarray], texts: list[np.ndarray], match: int = 2, mismatch: int = -1, gap: int = 1) -> list[tuple[int, int, int, int]]:
    """Smith-Waterman of each item with its text: best score, its end in each, and the longest run of equal words.

    All pairs advance together, one word of the items at a time, vectorised
    over the words of the texts: a gap along the row is a running maximum of
    the cells plus what their distance costs. Memory is linear in the texts.
    """
    if not items:
        return []
    p, width, height = len(items), max(map(len, texts)), max(map(len, items))
    text, held = np.zeros((p, width), np.int64), np.zeros((p, width), bool)
    item, known = np.zeros((p, height), np.int64), np.zeros((p, height), bool)
    for k, (a, b) in enumerate(zip(items, texts)):
        item[k, : len(a)], known[k, : len(a)] = a, True
        text[k, : len(b)], held[k, : len(b)] = b, True
    slope = np.arange(1, width + 1, dtype=np.int32) * gap
    h, r = np.zeros((p, width + 1), np.int32), np.zeros((p, width + 1), np.int32)
    best, item_end, text_end, longest = (np.zeros(p, np.int32) for _ in range(4))
    every = np.arange(p)
    for i in range(height if width else 0):
        equal = (text == item[:, i : i + 1]) & held & known[:, i : i + 1]
        cell = np.maximum(np.maximum(h[:, :-1] + np.where(equal, match, mismatch), h[:, 1:] - gap), 0)
        cell = np.maximum.accumulate(cell + slope, axis=1) - slope
        r[:, 1:] = (r[:, :-1] + 1) * equal
        h[:, 1:] = cell
        at = cell.argmax(1)
        top = cell[every, at]
        better = top > best
        best[better], item_end[better], text_end[better] = top[better], i + 1, at[better] + 1
        np.maximum(longest, r.max(1), out=longest)
    return list(zip(best.tolist(), item_end.tolist(), text_end.tolist(), longest.tolist()))


def _grams(words: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words of lists of word hashes, the list of each and its position."""
    count = max(0, len(words) - n + 1)
    h = np.zeros(count, np.uint64)
    for k in range(n):
        h = (h ^ words[k : k + count].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    row = np.repeat(np.arange(len(sizes)), sizes)
    whole = row[:count] == row[n - 1 :] if count else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    return h[at], row[at], at - (np.cumsum(sizes) - sizes)[row[at]]


class Items:
    """The n-grams of a block of items: sorted distinct hashes and, of each, the items and positions that hold it."""

    def __init__(self, ids: list[int], words: list[np.ndarray], n: int):
        self.ids, self.words, self.n = ids, words, n
        sizes = np.array([len(w) for w in words], np.int64)
        hashes, self.owner, self.position = _grams(np.concatenate([np.zeros(0, np.int64), *words]), sizes, n)
        self.hashes, self.code = np.unique(hashes, return_inverse=True)

    def hits(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, its position and the n-gram's code, of each n-gram of the texts that an item holds."""
        hashes, row, position = _grams(words, sizes, self.n)
        if not len(self.hashes):
            return row[:0], position[:0], row[:0]
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = np.flatnonzero(self.hashes[at] == hashes)
        return row[found], position[found], at[found]

    def choose(self, frequency: np.ndarray, intact: int) -> None:
        """Keeps as seeds the rarest n-gram of every ``intact`` words, of those that the corpus holds."""
        seen = frequency[self.code]
        weight = np.where(seen > 0, seen, np.iinfo(np.int64).max)
        seed = np.zeros(len(self.code), bool)
        width, first = max(1, intact - self.n + 1), np.flatnonzero(self.position == 0)
        for a, b in zip(first, [*first[1:], len(self.code)]):
            if b - a <= width:
                starts, span = np.array([a]), b - a
            else:
                starts, span = np.arange(a, b - width + 1), width
            seed[starts + np.lib.stride_tricks.sliding_window_view(weight[a:b], span).argmin(1)] = True
        keep = np.flatnonzero(seed & (seen > 0))
        order = keep[np.argsort(self.code[keep], kind="stable")]
        self.start = np.searchsorted(self.code[order], np.arange(len(self.hashes) + 1))
        self.owner, self.position = self.owner[order], self.position[order]


def _candidates(items: Items, row: np.ndarray, position: np.ndarray, code: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, from, to): parts of texts around at least two seeds of an item."""
    held = items.start[code + 1] - items.start[code]
    hit = np.repeat(np.arange(len(code)), held)
    seed = np.arange(len(hit)) - np.repeat(np.cumsum(held) - held, held) + np.repeat(items.start[code], held)
    text, item, begin, at = row[hit], items.owner[seed], position[hit] - items.position[seed], items.position[seed]
    order = np.lexsort((begin, item, text))
    text, item, begin, at = text[order], item[order], begin[order], at[order]
    size = np.array([len(w) for w in items.words], np.int64)[item]
    # Seeds of a pair that start the item within its length of each other belong to one part.
    apart = np.ones(len(text), bool)
    apart[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > size[1:])
    edges = np.flatnonzero(apart)
    for a, b in zip(edges, [*edges[1:], len(text)]):
        if b - a > 1 and (at[a:b] != at[a]).any():
            slack = int(size[a]) // 2
            yield int(text[a]), int(item[a]), max(0, int(begin[a]) - slack), int(begin[b - 1] + size[a]) + slack


def find_leaks(items: DataFrame, documents: DataFrame, seed: int = 4, intact: int = 5, least_score: int = 16) -> DataFrame:
    """(item_id, doc_id, score, item_end, doc_end, longest_run, item_share) of items (item_id, item_text) and documents (doc_id, text).

    Of every pair that shares two unbroken stretches of ``intact`` words, or
    one of twice as many, the best alignment of at least ``least_score`` (two a
    word in common, less one for each word changed, put in or left out).
    Frequencies only choose between seeds that stand together: no copy is lost
    for being common. ``item_share`` is the score over that of the whole item.
    Null, blank and shorter texts have no seed. Repeated rows of an id count
    once.
    """
    hashed = lambda c: F.transform(words(F.coalesce(F.col(c), F.lit(""))), lambda w: F.xxhash64(w))
    once = items.filter("item_id is not null").groupBy("item_id").agg(F.min("item_text").alias("item_text")).select("item_id", hashed("item_text").alias("w"))
    texts = documents.filter("doc_id is not null and text is not null").select("doc_id", hashed("text").alias("w"))
    size = once.agg(F.coalesce(F.sum(F.size("w")), F.lit(0))).first()[0]
    blocks = -(-size // MOST_BLOCK_WORDS) or 1
    context, out = documents.sparkSession.sparkContext, None
    for block in range(blocks):
        rows = once.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        found = Items([r["item_id"] for r in rows], [np.array(r["w"], np.int64) for r in rows], seed)
        shared = context.broadcast(found)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(shared.value.hashes), np.int64)
            for batch in batches:
                row, _, code = shared.value.hits(*flat(batch.column("w")))
                once = np.unique(row * len(sums) + code)  # a text counts once
                sums += np.bincount(once % max(1, len(sums)), minlength=len(sums))
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["code", "n"])

        counts = texts.select("w").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
        frequency = np.zeros(len(found.hashes), np.int64)
        frequency[counts["code"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
        found.choose(frequency, intact)
        chosen = context.broadcast(found)

        def scan(batches: Iterator[pa.RecordBatch], chosen=chosen) -> Iterator[pa.RecordBatch]:
            block = chosen.value
            for batch in batches:
                flat_words, sizes = flat(batch.column("w"))
                start = np.cumsum(sizes) - sizes
                row, position, code = block.hits(flat_words, sizes)
                parts = [(t, i, a, min(b, int(sizes[t]))) for t, i, a, b in _candidates(block, row, position, code)]
                parts.sort(key=lambda x: x[3] - x[2])
                ids, out = batch.column("doc_id").to_pylist(), []
                for k in range(0, len(parts), 128):
                    some = parts[k : k + 128]
                    scores = align_many([block.words[i] for _, i, _, _ in some], [flat_words[start[t] + a : start[t] + b] for t, _, a, b in some])
                    out += [(block.ids[i], ids[t], s, ie, a + te, run, s / (2 * len(block.words[i]))) for (t, i, a, _), (s, ie, te, run) in zip(some, scores) if s >= least_score]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 7, [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.float64()])], _NAMES)

        scored = texts.mapInArrow(scan, _OUT)
        out = scored if out is None else out.unionByName(scored)
    best = F.max_by(F.struct(*_NAMES[2:5], "item_share"), F.struct("score", -F.col("doc_end"))).alias("b")
    merged = out.groupBy("item_id", "doc_id").agg(best, F.max("longest_run").alias("longest_run"))
    return merged.select("item_id", "doc_id", "b.score", "b.item_end", "b.doc_end", "longest_run", "b.item_share")


def leak_report(leaks: DataFrame, items: DataFrame, run: int = 12) -> DataFrame:
    """Per leaked item: documents that hold part of it, those with ``run`` unbroken words, those with most of it, and the best score and share."""
    sums = leaks.groupBy("item_id").agg(
        F.count("*").alias("n_documents"), F.count_if(F.col("longest_run") >= run).alias("n_unbroken"), F.count_if(F.col("item_share") >= 0.5).alias("n_mostly"), F.max("score").alias("best_score"), F.max("item_share").alias("best_share")
    )
    return sums.join(items.select("item_id", *[c for c in items.columns if c not in ("item_id", "item_text")]).dropDuplicates(["item_id"]), "item_id", "left")
