"""Mixing sources to target weights (problem 9).

Texts that stand in several sources under different ids have a membership
pattern. Patterns are aggregated to their size in tokens (at most 2^sources - 1
patterns, whatever the corpus), and a min-cost flow routes what their documents
hold in each source to the source quotas: the r-th use of a text costs r - 1,
so nothing is repeated before everything has been used that could serve
instead. Seeded documents are then selected to each flow, by hash, without
sorting the corpus; of copies within a source one comes before the others.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftlens.functions.columns import set_aside
from weftlens.session import cut

#: Hash buckets of a text selection: a window sorts one bucket at a time.
BUCKETS = 4096
#: Membership patterns that are routed as such, the largest first. Up to 16 sources have no more; of more sources, the
#: documents of smaller patterns are routed by their source alone: quotas and caps hold all the same, only uses of one
#: text under several sources aren't told apart from others.
MOST_PATTERNS = 1 << 16


def with_token_counts(documents: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """``documents`` with ``n_tokens`` of the rank file ``tokenizer`` (a path every executor can read); null and blank texts count 0."""
    documents, name = set_aside(documents, ["n_tokens"])
    text = name("text")
    schema = documents.withColumn("n_tokens", F.lit(0).cast("long")).schema

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(tokenizer).read_bytes().splitlines() if line)}
        encoding = tiktoken.Encoding(Path(tokenizer).stem, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if isinstance(t, str) and t.strip() else 0 for t in batch[text]]
            yield batch.assign(n_tokens=pd.Series(sizes, index=batch.index, dtype="int64"))

    return documents.mapInPandas(count, schema)


def route(capacity: dict[tuple[str, ...], int], quota: dict[str, int], repeats: dict[str, int], held: dict[tuple[tuple[str, ...], str], int] | None = None) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens from each pattern to each of its sources: min-cost flow by successive shortest paths.

    A pattern whose texts have T tokens offers T at cost 0, T at cost 1 and so
    on up to the largest ``repeats`` of its sources, and what its documents
    hold beyond that at the cost after; a source draws at most ``repeats``
    times what it has ``held`` of the pattern (T if not given), and its quota
    in all.
    """
    patterns, sources = sorted(p for p in capacity if capacity[p] > 0), sorted(quota)
    arcs: list[list[int]] = []
    out: dict = {}

    def arc(a, b, room: int, cost: int) -> None:
        for node, other, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            out.setdefault(node, []).append(len(arcs))
            arcs.append([other, r, c])

    at: dict = {}
    for p in patterns:
        most = max((repeats[s] for s in p), default=0)
        rooms = {s: repeats[s] * (held or {}).get((p, s), capacity[p]) for s in p}
        for r in range(most):
            arc("from", ("p", p), capacity[p], r)
        arc("from", ("p", p), max(0, sum(rooms.values()) - most * capacity[p]), most)
        for s, room in rooms.items():
            at[p, s] = len(arcs)
            arc(("p", p), ("s", s), room, 0)
    for s in sources:
        arc(("s", s), "to", quota[s], 0)
    while True:
        distance, via, queue = {"from": 0}, {}, ["from"]
        for node in queue:  # Bellman-Ford with a queue: residual arcs have negative costs
            for k in out.get(node, ()):
                other, room, cost = arcs[k]
                if room > 0 and distance[node] + cost < distance.get(other, 1 << 60):
                    distance[other], via[other] = distance[node] + cost, k
                    queue.append(other)
        if "to" not in distance:
            break
        path, node = [], "to"
        while node != "from":
            path.append(via[node])
            node = arcs[via[node] ^ 1][0]
        push = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= push
            arcs[k ^ 1][1] += push
    return {ps: arcs[k ^ 1][1] for ps, k in at.items() if arcs[k ^ 1][1] > 0}


def mix_selection(documents: DataFrame, targets: DataFrame, total_tokens: int | None, seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, repeats): how often each document is used, of documents (doc_id, text, source, n_tokens).

    ``targets`` is (source, target_weight, max_repeats); shares are weights
    over their sum; ``total_tokens`` None asks for as many as the listed
    sources hold, so that small ones are repeated and large ones drawn from.
    Each source's tokens meet its quota but for less than the
    size of one document, or fall short where ``max_repeats`` forbids more. No
    document is used more often than its own source's ``max_repeats``. Sources
    not listed are not used; a source without documents gets nothing. Null and
    blank texts have no tokens and aren't selected.
    """
    listed = {r["source"]: (float(r["target_weight"]), int(r["max_repeats"])) for r in targets.filter("source is not null and target_weight > 0 and max_repeats > 0").collect()}
    spark, total = documents.sparkSession, sum(w for w, _ in listed.values())
    empty = spark.createDataFrame([], "doc_id long, source string, n_tokens long, repeats int")
    if not listed:
        return empty
    used = documents.filter(F.col("source").isin(*listed) & (F.col("n_tokens") > 0)).select("doc_id", "source", "n_tokens", F.xxhash64("text").alias("text_id"))
    # Repeated rows of a document in a source count once. Written once: texts are counted in tokens once.
    held = cut(used.groupBy("doc_id", "source").agg(F.min_by(F.struct("text_id", "n_tokens"), "text_id").alias("t")).select("doc_id", "source", "t.*"))
    if total_tokens is None:
        total_tokens = held.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    texts = held.groupBy("text_id").agg(F.array_join(F.array_sort(F.collect_set("source")), "\u0001").alias("pattern_key"), F.max("n_tokens").alias("text_tokens"))
    if len(listed) > MOST_PATTERNS.bit_length() - 1:
        largest = cut(texts.groupBy("pattern_key").agg(F.sum("text_tokens").alias("t")).orderBy(F.desc("t"), "pattern_key").limit(MOST_PATTERNS)).select("pattern_key")
        alone = held.join(texts.join(largest, "pattern_key", "left_anti").select("text_id"), "text_id", "left_semi")
        alone = alone.groupBy("text_id", "source").agg(F.max("n_tokens").alias("text_tokens")).select("text_id", "source", F.col("source").alias("pattern_key"), "text_tokens")
        together = held.select("text_id", "source").distinct().join(texts.join(largest, "pattern_key", "left_semi"), "text_id").select("text_id", "source", "pattern_key", "text_tokens")
        by_source = together.unionByName(alone)
        texts = together.drop("source").distinct().unionByName(alone.drop("source"))
    else:
        by_source = texts
    first = held.groupBy("text_id", "source").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source", F.lit(0).alias("copy"))
    placed = held.join(first, ["doc_id", "source"], "left").fillna(1, ["copy"]).join(by_source.drop("text_tokens"), ["text_id", "source"] if "source" in by_source.columns else "text_id")
    # Copies are ordered by their own hashes: many of one text don't meet in one bucket.
    placed = placed.withColumn("order", F.xxhash64(F.lit(seed), F.when(F.col("copy") == 0, F.col("text_id")).otherwise(F.col("doc_id"))))
    placed = placed.withColumn("bucket", F.pmod("order", F.lit(BUCKETS)).cast("int"))
    key = ["pattern_key", "source", "copy", "bucket"]
    sizes = placed.groupBy(*key).agg(F.sum("n_tokens").alias("tokens"))
    names = lambda k: tuple(k.split("\u0001"))
    capacity = {names(r["pattern_key"]): int(r["t"]) for r in texts.groupBy("pattern_key").agg(F.sum("text_tokens").alias("t")).collect()}
    in_source = {(names(r["pattern_key"]), r["source"]): int(r["t"]) for r in sizes.groupBy("pattern_key", "source").agg(F.sum("tokens").alias("t")).collect()}
    quota = {s: round(total_tokens * w / total) for s, (w, _) in listed.items()}
    flows = route(capacity, quota, {s: n for s, (_, n) in listed.items()}, in_source)
    rows = [("\u0001".join(p), s, f // in_source[p, s], f % in_source[p, s]) for (p, s), f in flows.items()]
    plan = F.broadcast(spark.createDataFrame(rows, "pattern_key string, source string, every long, part long")) if rows else None  # at most MOST_PATTERNS by their sources, and the sources alone
    if plan is None:
        return empty
    # Each pattern and source starts at its own place in the order, so that sources don't all take the same texts once more.
    place = Window.partitionBy("pattern_key", "source").orderBy("copy", "turned").rowsBetween(Window.unboundedPreceding, -1)
    start = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(BUCKETS)).cast("int")
    buckets = sizes.join(plan, ["pattern_key", "source"]).withColumn("turned", F.pmod(F.col("bucket") - start, F.lit(BUCKETS)))
    buckets = buckets.withColumn("before", F.coalesce(F.sum("tokens").over(place), F.lit(0))).select(*key, "every", "part", "before")
    within = Window.partitionBy(*key).orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    picked = placed.join(buckets, key)
    once_more = (F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)) < F.col("part")).cast("long")
    return picked.withColumn("repeats", (F.col("every") + once_more).cast("int")).filter("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")


def mix_report(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: target and actual share, tokens, documents, uses and the most repeats of one document."""
    share = targets.select("source", (F.col("target_weight") / F.sum("target_weight").over(Window.partitionBy(F.lit(1)))).alias("target_share"), "max_repeats")
    sums = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("n_documents"), F.sum("repeats").alias("n_uses"), F.max("repeats").alias("most_repeats"))
    joined = share.join(sums, "source", "left").fillna(0, ["tokens", "n_documents", "n_uses", "most_repeats"])
    return joined.withColumn("actual_share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(1))))


def default_tokenizer(spark: SparkSession, folder: str = "/opt/tokenizers", name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path of the rank file and its splitting pattern; both are parameters of ``with_token_counts``."""
    # Fixed value: the splitting pattern that the vocabulary's publisher gives for byte-level BPE.
    return f"{folder}/{name}", r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
