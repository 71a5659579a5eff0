"""Same or near-same records across splits (problem 5).

Word n-gram hashes of evaluation records are partitioned by hash and training
records are scanned for hits; every hit is verified on the whole sets, which
gives the similarity and the containment of the evaluation record in the
training record. Records with equal n-gram sets are one class: copies take
part once, and only a listing of pairs expands them.

Which hashes have to meet is exact. Two sets with Jaccard ``t`` or more share
at least two of the first ``n - ceil(2t/(1+t) n) + 2`` hashes of the smaller
and ``n - ceil(t n) + 2`` of the larger in any common order. The order here is
by how many pairs a hash could make, from a table of fixed size, so hashes on
one side only come first and make no key at all. Rare hashes are keys by
themselves; common ones are keys only two together, so that candidates don't
grow with the square of their frequency. What is rare is chosen by what keys
and pairs cost, and makes no difference to the result. A contained set lacks at
most ``n - ceil(c n)`` of its hashes, so one of its ``n - ceil(c n) + 1``
rarest is in the record that contains it.

Disk is the bound. Sets are larger than their texts, so one text a class is
kept, packed, and its hashes are made again at every use. Each key carries 128
bits of its set, and pairs that these rule out are never written. Keys come in
parts, and the shuffle files of each step go when it is done.
"""

from __future__ import annotations

import contextlib
import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlens.session import cut, default_parallelism, release_shuffles

from .grams import by_record, mixed, places, text_grams, words

# Spellings of the splits, without case, blanks, hyphens and underscores.
TRAINING = ["train", "training"]
VALIDATION = ["val", "valid", "validation"]
TEST = ["test", "testing", "eval", "evaluation"]
EVALUATION = VALIDATION + TEST

#: Bits of the table of frequencies and of the table of keys on the evaluation side; their size is fixed, whatever the records.
BITS, KEY_BITS = 20, 23
#: A hash that makes up to this many pairs, or so many times 8, is a key by itself.
RARE = 32
#: What a key costs, in pairs that are looked at.
KEY_COST = 60
#: Keys of so many a class are on disk at once; fewer classes than these aren't divided.
PART_KEYS, LEAST_IN_PARTS = 8, 20_000
#: Classes packed together.
BLOCK = 8192
#: Sets above this size have their common hashes as single keys: two together would be too many.
MOST_PAIRED = 64

_EPS = 1e-9


def split_role(split_sets: Column, names: list[str]) -> Column:
    """Whether any membership's ``split_type`` is one of ``names``; false for null and empty lists."""
    plain = lambda s: F.regexp_replace(F.lower(s["split_type"]), r"[\s_-]+", "")
    return F.coalesce(F.exists(split_sets, lambda s: F.coalesce(plain(s).isin(names), F.lit(False))), F.lit(False))


def _packed(**columns: pa.Array) -> bytes:
    batch, sink = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch.column(0):
            yield from pa.ipc.open_stream(packed.as_buffer())


def _digests(n: int) -> Callable:
    """128 bits for each set of hashes: 64 would merge different texts of a large corpus."""
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, sizes = text_grams(batch.column("plain"), n)
            held = np.flatnonzero(sizes)
            if len(held):
                starts = (np.cumsum(sizes) - sizes)[held]
                sums = [pa.array(np.add.reduceat(mixed(grams.view(np.uint64) ^ np.uint64(seed)), starts).view(np.int64)) for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                yield pa.RecordBatch.from_arrays([*sums, *batch.take(pa.array(held)).columns], ["d1", "d2", *batch.schema.names])

    return digests


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of classes, with one text each, and of members, from rows sorted by class; a class may run over any number of batches."""
    following, last, pending = TaskContext.get().partitionId() << 32, None, []

    def block(c: np.ndarray, train: np.ndarray, evaluation: np.ndarray, plain: list[pa.Array]) -> tuple:
        return _packed(c=pa.array(c), has_train=pa.array(train), has_eval=pa.array(evaluation), plain=pa.concat_arrays(plain)), len(c), int(train.sum()), int(evaluation.sum())

    def row(members: bytes | None, classes: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([classes[0]], pa.binary()), pa.array([members], pa.binary()), *(pa.array([x], pa.int64()) for x in classes[1:])], ["classes", "members", "n", "n_train", "n_eval"])

    for batch in batches:
        d1, d2, train, evaluation = (np.asarray(batch.column(x)) for x in ("d1", "d2", "is_train", "is_eval"))
        if not len(d1):
            continue
        new = np.ones(len(d1), bool)
        new[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
        starts = np.flatnonzero(new)
        goes_on = (d1[0], d2[0]) == last
        c = following - goes_on + np.cumsum(new) - 1
        last, following = (d1[-1], d2[-1]), int(c[-1]) + 1
        has_train, has_eval = np.logical_or.reduceat(train, starts), np.logical_or.reduceat(evaluation, starts)
        if goes_on:
            pending[-1][1][-1] |= has_train[0]
            pending[-1][2][-1] |= has_eval[0]
        if len(starts) > goes_on:
            pending.append([c[starts][goes_on:], has_train[goes_on:], has_eval[goes_on:], batch.column("plain").take(pa.array(starts[goes_on:]))])
        members = _packed(class_id=pa.array(c), id=batch.column("id"), is_train=batch.column("is_train"), is_eval=batch.column("is_eval"))
        if sum(len(x[0]) for x in pending) > BLOCK:
            # The last class may go on in the next batch.
            *arrays, plain = zip(*pending)
            c, has_train, has_eval = (np.concatenate(x) for x in arrays)
            plain = pa.concat_arrays(plain)
            yield row(members, block(c[:-1], has_train[:-1], has_eval[:-1], [plain[:-1]]))
            pending = [[c[-1:], has_train[-1:], has_eval[-1:], plain.take(pa.array([len(plain) - 1]))]]
        else:
            yield row(members, (None, 0, 0, 0))
    if pending:
        *arrays, plain = zip(*pending)
        yield row(None, block(*(np.concatenate(x) for x in arrays), list(plain)))


def _classes(batches: Iterator[pa.RecordBatch], n: int, *sides: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks of the classes on all of ``sides``, with their hashes and sizes."""
    for block in _unpacked(batches):
        for side in sides:
            block = block.filter(block.column(side))
        if len(block):
            yield block, *text_grams(block.column("plain"), n)


def _frequencies(store: DataFrame, n: int, bits: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Per table place, in steps, the classes of training and the pairs they make with those of evaluation; the number of all hashes in training. Each core sends one table at most."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << bits), np.int64)
        for block, grams, sizes in _classes(batches, n):
            at = places(grams, bits)
            for row, side in zip(sums, ("has_train", "has_eval")):
                row += np.bincount(at[np.repeat(np.asarray(block.column(side)), sizes)], minlength=1 << bits)
        used = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[0, used]), pa.array(sums[1, used])], ["place", "t", "e"])

    counted = store.coalesce(default_parallelism(store.sparkSession)).mapInArrow(count, "place int, t long, e long")
    # What counts is the order: above 2^31 all are as frequent.
    most = lambda c: F.least(F.sum(c), F.lit(2**31 - 1)).cast("int").alias(c)
    summed = counted.groupBy("place").agg(most("t"), most("e"))
    rows = summed.toArrow()
    release_shuffles(summed)
    table, total = np.zeros((2, 1 << bits), np.uint8), 0.0
    for batch in rows.to_batches():
        place, t, e = (np.asarray(batch.column(c)) for c in ("place", "t", "e"))
        table[0, place], table[1, place] = _steps(t), _steps(t.astype(np.int64) * e)
        total += t.sum(dtype=np.float64)
    return *table, total


def _steps(frequencies: np.ndarray) -> np.ndarray:
    """Frequencies in steps of a quarter of a power of 2, in a byte each, as every worker holds them: what counts is the order."""
    return np.where(frequencies > 0, 4 * np.log2(np.maximum(frequencies, 1)) + 1, 0).astype(np.uint8)


@contextlib.contextmanager
def _sent(spark: SparkSession, table: np.ndarray) -> Iterator[Broadcast]:
    """A table on the executors, once for all steps inside; each must be computed there."""
    sent = spark.sparkContext.broadcast(table)
    try:
        yield sent
    finally:
        sent.unpersist(blocking=True)


def _signs(grams: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """128 bits of each set, as two numbers: each hash sets one. A bit that one set has and another lacks is a hash that the other lacks."""
    bit, starts = places(grams, 7), np.cumsum(sizes) - sizes
    one = np.int64(1) << (bit & 63)
    return [np.bitwise_or.reduceat(np.where(bit >> 6 == half, one, 0), starts) for half in (0, 1)]


def _has(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the places of ``values`` are taken in a packed table."""
    at = places(values, len(table).bit_length() + 2)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _keyed(store: DataFrame, n: int, side: str, choose: Callable, part: tuple[int, int] = (0, 1), wanted: Broadcast | None = None) -> DataFrame:
    """(key, c, n, small, s0, s1) of the classes on one side; ``choose`` takes hashes and sizes and gives keys, their record and the flag.

    Only keys of one ``part`` of so many; keys whose place isn't ``wanted`` meet nothing and are left out.
    """
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, grams, sizes in _classes(batches, n, side):
            key, record, small = choose(grams, sizes)
            met = key % part[1] == part[0]
            if wanted is not None:
                met &= _has(wanted.value, key)
            key, record, small = key[met], record[met], small[met]
            signs = [pa.array(s[record]) for s in _signs(grams, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(key), block.column("c").take(pa.array(record)), pa.array(sizes[record].astype(np.int32)), pa.array(small), *signs], ["key", "c", "n", "small", "s0", "s1"])

    return store.mapInArrow(keys, "key long, c long, n int, small boolean, s0 long, s1 long")


def _held(values: DataFrame, bits: int) -> np.ndarray:
    """Which places of a table are taken by one column of long, packed: what the other side has elsewhere need not be shuffled."""
    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            seen[places(np.asarray(batch.column(0)), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen) + 1)], ["place"])

    # Bitmaps of 32,768 places each: 2^bits bits come to the driver.
    bitmaps = values.mapInArrow(used, "place long").groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    held = np.zeros((1 << bits >> 15, 1 << 12), np.uint8)
    for r in bitmaps.collect():
        held[r["bucket"] - 1] = np.frombuffer(bytes(r["bits"]), np.uint8)
    release_shuffles(bitmaps)
    return held.reshape(-1)


def _ranked(grams: np.ndarray, sizes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each record in the common order, with weight, record and rank."""
    record = np.repeat(np.arange(len(sizes)), sizes)
    w = weight[places(grams, len(weight).bit_length() - 1)]
    order = by_record(record, grams, w)
    return grams[order], w[order], record, np.arange(len(grams)) - (np.cumsum(sizes) - sizes)[record]


def _prefix(grams: np.ndarray, sizes: np.ndarray, weight: np.ndarray, t: float) -> tuple[np.ndarray, ...]:
    """Hashes with weight and record that may have to meet, whether also in the shorter prefix, whether single whatever the weight, whether paired if common."""
    g, w, record, rank = _ranked(grams, sizes, weight)
    n = sizes[record]
    least = np.ceil(n * t - _EPS)
    keep = np.flatnonzero((rank < n - least + 2) & (w > 0))
    small = rank < n - np.ceil(n * 2 * t / (1 + t) - _EPS) + 2
    return g[keep], w[keep], record[keep], small[keep], n[keep] > MOST_PAIRED, least[keep] <= MOST_PAIRED


def _similar_keys(weight: Broadcast, t: float, rare: int) -> Callable:
    def choose(grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, w, record, small, alone, paired = _prefix(grams, sizes, weight.value, t)
        single = np.flatnonzero((w <= rare) | alone)
        parts = [(g[single], record[single], small[single])]
        # Sorted by weight, the common hashes of a record are the last of its prefix: neighbours at each distance make all its pairs.
        common = np.flatnonzero((w > rare) & paired)
        for d in range(1, int(np.bincount(record[common]).max(initial=0)) if len(common) else 0):
            a, b = common[:-d], common[d:]
            a, b = a[record[a] == record[b]], b[record[a] == record[b]]
            parts.append((places(g[a] * np.int64(31) ^ g[b], 63), record[a], small[b]))
        return tuple(np.concatenate(x) for x in zip(*parts))

    return choose


def _rare(store: DataFrame, n: int, weight: Broadcast, train: Broadcast, t: float, sides: float) -> tuple[int, float]:
    """Up to which step of weight a hash shall be a key by itself, so that keys and the pairs they make cost least, and how many keys the evaluation side then has.

    Any limit gives the same candidates in the end.
    """
    limits = sorted({int(x) for x in _steps(np.array([RARE * 8**k for k in range(12)]))})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, pairs = np.zeros(len(limits), np.int64), np.zeros(len(limits))
        for _, grams, sizes in _classes(batches, n, "has_eval"):
            g, w, record, _, alone, paired = _prefix(grams, sizes, weight.value, t)
            met = 2 ** (train.value[places(g, len(train.value).bit_length() - 1)] / 4)
            for i, limit in enumerate(limits):
                single = (w <= limit) | alone
                common = np.bincount(record[(w > limit) & paired])
                keys[i] += single.sum() + (common * (common - 1) // 2).sum()
                pairs[i] += met[single].sum()
        yield pa.RecordBatch.from_arrays([pa.array(limits), pa.array(keys), pa.array(pairs)], ["step", "keys", "pairs"])

    rows = store.mapInArrow(count, "step long, keys long, pairs double").groupBy("step").agg(F.sum("keys").alias("keys"), F.sum("pairs").alias("pairs")).collect()
    best = min(rows, key=lambda r: (r["keys"] * sides * KEY_COST + r["pairs"], r["step"]), default=None)
    return (best["step"], float(best["keys"])) if best else (limits[0], 0.0)


def _lacks(a: str, b: str) -> Column:
    """At least so many hashes of set ``a`` are not in set ``b``."""
    bits = [F.bit_count(F.col(f"{a}.s{i}").bitwiseAND(F.bitwise_not(F.col(f"{b}.s{i}")))) for i in (0, 1)]
    return bits[0] + bits[1]


def _meeting(e: DataFrame, t: DataFrame, fits: Column) -> DataFrame:
    """(e, t) of the classes of two sides, aliased e and t, that have a key in common and fit."""
    return e.alias("e").join(t.alias("t"), F.col("e.key") == F.col("t.key")).filter(fits & (F.col("e.c") != F.col("t.c"))).select(F.col("e.c").alias("e"), F.col("t.c").alias("t")).distinct()


def _in_parts(store: DataFrame, n: int, of_eval: Callable, of_train: Callable, keys: float, classes: int, fits: Column, bits: int) -> list[DataFrame]:
    """Candidates part by part of the keys, so that no more than PART_KEYS a class are on disk at once."""
    parts = max(1, math.ceil(keys / max(classes, LEAST_IN_PARTS) / PART_KEYS))
    with _sent(store.sparkSession, _held(_keyed(store, n, "has_eval", of_eval).select("key"), bits)) as held:
        return [cut(_meeting(_keyed(store, n, "has_eval", of_eval, (i, parts)), _keyed(store, n, "has_train", of_train, (i, parts), held), fits), release=True) for i in range(parts)]


def _similar(store: DataFrame, n: int, weight: Broadcast, train: Broadcast, t: float, counts: tuple[int, int], bits: int) -> list[DataFrame]:
    """(e, t) of the evaluation and training classes that may be that similar, every such pair among them."""
    sides = sum(counts) / max(counts[1], 1)
    rare, keys = _rare(store, n, weight, train, t, sides)
    choose = _similar_keys(weight, t, rare)
    en, tn = F.col("e.n"), F.col("t.n")
    shared = F.ceil((en + tn) * (t / (1 + t)) - _EPS)
    fits = (F.least(en, tn) >= F.greatest(en, tn) * t - _EPS) & F.when(en <= tn, F.col("e.small")).otherwise(F.col("t.small")) & (_lacks("e", "t") <= en - shared) & (_lacks("t", "e") <= tn - shared)
    return _in_parts(store, n, choose, choose, keys * sides, sum(counts), fits, bits)


def _containing(store: DataFrame, n: int, train: Broadcast, c: float, keys: float, counts: tuple[int, int], bits: int) -> list[DataFrame]:
    """(e, t) of the evaluation classes that may be contained in training classes, every such pair among them; ``keys`` are the hashes of training."""
    def rarest(grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, w, record, rank = _ranked(grams, sizes, train.value)
        n = sizes[record]
        keep = np.flatnonzero((rank < n - np.ceil(n * c - _EPS) + 1) & (w > 0))
        return g[keep], record[keep], np.ones(len(keep), bool)

    def every(grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return grams, np.repeat(np.arange(len(sizes)), sizes), np.ones(len(grams), bool)

    fits = _lacks("e", "t") <= F.col("e.n") - F.ceil(F.col("e.n") * c - _EPS)
    return _in_parts(store, n, rarest, every, keys, sum(counts), fits, bits)


def _sets(store: DataFrame, n: int, wanted: Broadcast) -> DataFrame:
    """(c, grams) of the classes whose place is wanted."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _unpacked(batches):
            block = block.filter(pa.array(_has(wanted.value, np.asarray(block.column("c")))))
            if len(block):
                grams, sizes = text_grams(block.column("plain"), n)
                yield pa.RecordBatch.from_arrays([block.column("c"), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(grams))], ["c", "grams"])

    return store.mapInArrow(sets, "c long, grams array<long>")


def _in_both(store: DataFrame, n: int) -> DataFrame:
    """(c, n) of the classes in training and evaluation."""
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, sizes in _classes(batches, n, "has_train", "has_eval"):
            yield pa.RecordBatch.from_arrays([block.column("c"), pa.array(sizes.astype(np.int32))], ["c", "n"])

    return store.mapInArrow(both, "c long, n int")


def overlap_classes(records: DataFrame, n: int = 3, similarity: float = 0.6, containment: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Members (class_id, id, is_train, is_eval) and links (e, t, shared, jaccard, containment) between classes of records.

    A link joins the class ``e`` of evaluation records to the class ``t`` of
    training records whose sets of ``n``-word runs have at least ``similarity``
    in common or, if asked for, that hold at least ``containment`` of the
    runs of ``e``. A class in both splits is linked to itself.
    """
    role = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    plain = records.filter("(is_train or is_eval) and id is not null").select("id", role("is_train"), role("is_eval"), F.array_join(words(F.col("text")), " ").alias("plain"))
    kind = plain.schema["id"].dataType.simpleString()
    sets = plain.mapInArrow(_digests(n), f"d1 long, d2 long, id {kind}, is_train boolean, is_eval boolean, plain string")
    # One text a class, packed, is the smallest form of its hashes: written once, they are made again at every use.
    store = cut(sets.repartition("d1").sortWithinPartitions("d1", "d2").mapInArrow(_settled, "classes binary, members binary, n long, n_train long, n_eval long"), release=True)
    members = store.filter("members is not null").select("members").mapInArrow(_unpacked, f"class_id long, id {kind}, is_train boolean, is_eval boolean")
    total = store.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n_train", "n_eval")]).collect()[0]
    counts, large = (total["n_train"], total["n_eval"]), 2 * (total["n"] > 1 << 18)
    classes = store.filter("classes is not null").select("classes")
    train, both, all_train = _frequencies(classes, n, BITS + large)
    with _sent(records.sparkSession, train) as of_train:
        with _sent(records.sparkSession, both) as weight:
            found = _similar(classes, n, weight, of_train, similarity, counts, KEY_BITS + large)
        if containment is not None:
            found += _containing(classes, n, of_train, containment, all_train, counts, KEY_BITS + large)
    candidates = cut(functools.reduce(DataFrame.unionByName, found).distinct(), release=True)
    with _sent(records.sparkSession, _held(candidates.select(F.explode(F.array("e", "t"))), KEY_BITS + large)) as wanted:
        held = cut(_sets(classes, n, wanted))
    left, right = held.select(F.col("c").alias("e"), F.col("grams").alias("eg")), held.select(F.col("c").alias("t"), F.col("grams").alias("tg"))
    shared = F.size(F.array_intersect("eg", "tg"))
    near = candidates.join(left, "e").join(right, "t").select("e", "t", shared.alias("shared"), F.size("eg").alias("en"), F.size("tg").alias("tn"))
    near = near.withColumns({"jaccard": F.col("shared") / (F.col("en") + F.col("tn") - F.col("shared")), "containment": F.col("shared") / F.col("en")})
    near = near.filter((F.col("jaccard") >= similarity - _EPS) | (F.col("containment") >= (containment if containment is not None else 2) - _EPS)).select("e", "t", "shared", "jaccard", "containment")
    same = _in_both(classes, n).select(F.col("c").alias("e"), F.col("c").alias("t"), F.col("n").alias("shared"), F.lit(1.0).alias("jaccard"), F.lit(1.0).alias("containment"))
    return members, cut(near.unionByName(same), release=True)


def cross_split_overlaps(records: DataFrame, n: int = 3, similarity: float = 0.6, containment: float | None = None) -> DataFrame:
    """Pairs (id_a, id_b, shared, jaccard, containment) of records (id, text, is_train, is_eval), id_a < id_b.

    One of the two is in training, the other in evaluation, and they are linked
    as in ``overlap_classes``. ``containment`` is the share of the evaluation
    record's runs in the training record (the larger share where both are
    both). Null and blank texts and texts of fewer than ``n`` words have no
    runs and no pairs; repeated rows of an id must have been settled before.
    """
    members, links = overlap_classes(records, n, similarity, containment)
    in_eval = members.filter("is_eval").select(F.col("class_id").alias("e"), F.col("id").alias("eval_id"))
    in_train = members.filter("is_train").select(F.col("class_id").alias("t"), F.col("id").alias("train_id"))
    pairs = links.join(in_eval, "e").join(in_train, "t").filter("eval_id <> train_id")
    return pairs.groupBy(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")).agg(
        F.max("shared").alias("shared"), F.max("jaccard").alias("jaccard"), F.max("containment").alias("containment")
    )


def split_records(files: DataFrame) -> DataFrame:
    """Records of ``project_files`` once each, with their split roles: (id, text, is_train, is_eval, splits, project_key, dataset_name)."""
    held = lambda names: split_role(F.col("split_sets"), names)
    splits = F.filter(F.array(F.when(held(VALIDATION), F.lit("validation")), F.when(held(TEST), F.lit("test"))), lambda s: s.isNotNull())
    # The first row as a whole, so that its text is shuffled once.
    row = F.struct(F.coalesce("received_at", F.lit("9999-12-31").cast("timestamp")).alias("at"), F.col("remark").alias("text"), held(TRAINING).alias("is_train"), held(EVALUATION).alias("is_eval"), splits.alias("splits"), *[c for c in ("project_key", "dataset_name") if c in files.columns])
    once = files.groupBy(F.col("file_uid").alias("id")).agg(F.min(row).alias("row"))
    return once.select("id", "row.*").drop("at")


def overlap_report(records: DataFrame, n: int = 3, similarity: float = 0.6, containment: float | None = 0.8) -> DataFrame:
    """Per split, project and dataset of the evaluation records: (split, project_key, dataset_name, n_records, n_pairs, most_contained).

    ``n_records`` of them overlap with training, in ``n_pairs`` pairs;
    ``most_contained`` is the largest containment. Pairs are counted from the
    sizes of classes and never listed: copies cost nothing. A record in two
    evaluation splits counts in both; one that is also in training is no pair
    with itself.
    """
    members, links = overlap_classes(records.select("id", "text", "is_train", "is_eval"), n, similarity, containment)
    held = members.filter("is_train").groupBy(F.col("class_id").alias("t")).agg(F.count("*").alias("held"))
    own = F.col("e") == F.col("t")
    partners = links.join(held, "t").groupBy(F.col("e").alias("class_id")).agg(F.sum("held").alias("partners"), F.max(F.when(~own, F.col("containment"))).alias("others"), F.max(F.when(own, F.col("held"))).alias("copies"))
    copies = F.coalesce("copies", F.lit(0)) - F.col("is_train").cast("int")
    per_record = members.filter("is_eval").join(partners, "class_id").select("id", (F.col("partners") - F.col("is_train").cast("int")).alias("n_pairs"), F.when(copies > 0, 1.0).otherwise(F.col("others")).alias("most")).filter("n_pairs > 0")
    located = per_record.join(records.select("id", "splits", "project_key", "dataset_name"), "id").withColumn("split", F.explode("splits"))
    return located.groupBy("split", "project_key", "dataset_name").agg(F.count("*").alias("n_records"), F.sum("n_pairs").alias("n_pairs"), F.max("most").alias("most_contained"))
