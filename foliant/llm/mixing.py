"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source's documents, in a seeded order, form shards of one token stream
each; a shard's stream is cut into blocks of (nearly) ``block_tokens`` tokens, of a
source with less than ``LEAST_BLOCKS`` such blocks into as many smaller ones (but
of a word at least). A source's votes are its target in blocks of its own; blocks
are allocated to sources by highest quotients ``votes / (2 seats + 1)``, then each
source's blocks to its shards the same way, so a source gets its target but for
half a block or so. A shard with quota q and n blocks takes every block ``q // n``
times and ``q % n`` seeded ones once more.

Null sources are one source, last in order; null or word-less texts have size 0
and are never taken. Repeated rows are separate documents. If no document has
a word, all targets are 0. Sources are held on the driver (one row each, at
most ``MAX_SOURCES``, else an error); shards and documents never are.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, let, stage, words

#: Sources one mix may have: the mix's own configuration, one weight each.
MAX_SOURCES = 100_000
#: Words in a shard's stream, and shards that a source may have at most.
SHARD_TOKENS, MAX_SHARDS = 65_536, 65_536
BLOCK_TOKENS, LEAST_BLOCKS, CAP, WEIGHTS = 64, 64, 3, (5, 2, 1)


def targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Share the total by weight; what exceeds ``cap`` times a size is shared again by weight."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s > 0], total
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * share > cap * sizes[i]]
        for i in full or open_:
            out[i] = float(cap * sizes[i]) if full else weights[i] * share
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)] if full else []
    return out


def sainte_lague(votes, seats: int, most=None) -> np.ndarray:
    """Seats by highest quotients vote / (2 seats + 1); ties go to the earlier one; ``most`` bounds each."""
    votes = np.asarray(votes, float)
    got = np.zeros(len(votes), np.int64)
    most = np.full(len(votes), np.iinfo(np.int64).max) if most is None else np.asarray(most, np.int64)
    if seats <= 0 or not votes.sum():
        return got
    got = np.minimum(np.maximum(np.floor(votes * seats / votes.sum() - 0.5), 0).astype(np.int64), most)  # all these are within the highest quotients
    heap = [(-v / (2 * g + 1), i) for i, (v, g, m) in enumerate(zip(votes, got, most, strict=True)) if v > 0 and g < m]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def _shard_quotas(shards: pa.Table) -> pa.Table:
    """One source's blocks to its shards, and each shard's rotation: a step coprime to its blocks, and a turn."""
    shards = shards.sort_by("_shard")
    blocks = shards["_blocks"].to_numpy()
    quota = sainte_lague(shards["_stream"].to_numpy(), shards["_seats"][0].as_py(), CAP * blocks)
    step = [next(s for s in range(max(1, int(n * 0.618)), 2 * n + 2) if math.gcd(s, n) == 1) for n in blocks.tolist()]
    return shards.select(["_source", "_shard", "_stream", "_blocks"]).append_column("_quota", pa.array(quota)).append_column("_step", pa.array(step, pa.int64())).append_column("_turn", shards["_turn"])


def block_size(size: int, block_tokens: int) -> float:
    """Words of a block of a source, so that it has LEAST_BLOCKS or all its words for blocks."""
    blocks = max(1, round(size / block_tokens), min(size, LEAST_BLOCKS))
    return size / blocks if size else float(block_tokens)


def allocate(docs: DataFrame, seed: int = 17, block_tokens: int = BLOCK_TOKENS, weights: tuple = WEIGHTS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, and ``takes``:
    how often each of its block parts is taken, as (first word, words, times)."""
    spark = docs.sparkSession
    # Null and every string as one non-null key, in code point order with null last.
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col("source")))
    sized = docs.select("doc_id", "source", key.alias("_source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = stage(spark, sized, "mix-sizes")

    found = sized.groupBy("_source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"a mix has at most {MAX_SOURCES} sources")
    found = sorted(((("b" if r["_source"] == "n" else "a") + r["_source"], r["_source"], r["n"]) for r in found), key=lambda r: r[0].encode())
    sizes = [n for *_, n in found]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(found))])
    block = [block_size(n, block_tokens) for n in sizes]
    votes = [t / b for t, b in zip(wanted, block, strict=True)]
    seats = sainte_lague(votes, round(sum(votes)))
    shards = [max(1, min(MAX_SHARDS, -(-n // SHARD_TOKENS))) for n in sizes]
    plan = spark.createDataFrame(
        [(s, int(n), float(t), int(q), int(k), b) for (_, s, n), t, q, k, b in zip(found, wanted, seats, shards, block, strict=True)],
        "_source string, source_size long, target double, _seats long, _shards int, _block double",
    )

    dealt = sized.join(F.broadcast(plan), "_source").withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), F.col("_shards")).cast("int"))
    streams = dealt.groupBy("_source", "_shard").agg(F.sum("size").alias("_stream"), F.first("_seats").alias("_seats"), F.first("_block").alias("_block"))
    blocks = F.greatest(F.lit(1), F.round(F.col("_stream") / F.col("_block"))).cast("long")
    streams = streams.withColumn("_blocks", blocks).withColumn("_turn", F.pmod(F.xxhash64(F.lit(seed + 2), "_source", "_shard"), F.col("_blocks")))
    quotas = streams.groupBy("_source").applyInArrow(_shard_quotas, "_source string, _shard int, _stream long, _blocks long, _quota long, _step long, _turn long")

    order = Window.partitionBy("_source", "_shard").orderBy(F.xxhash64(F.lit(seed), "doc_id", "size"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_start", F.coalesce(F.sum("size").over(order), F.lit(0)))
    joined = placed.join(quotas, ["_source", "_shard"])

    # Block b holds the words from ceil(b * stream / blocks) up to the next block's first.
    n, stream, quota = F.col("_blocks"), F.col("_stream"), F.col("_quota")
    start, end = F.col("_start"), F.col("_start") + F.col("size")
    div = lambda a, b: F.call_function("div", a, b)

    def block(b):
        low = F.greatest(start, div(b * stream + n - 1, n))
        high = F.least(end, div((b + 1) * stream + n - 1, n))
        # The rotation visits every block once, so exactly quota % n of them come among the first.
        once_more = F.pmod(b * F.col("_step") + F.col("_turn"), n) < F.pmod(quota, n)
        return F.struct((low - start).alias("first"), (high - low).alias("words"), (div(quota, n) + once_more.cast("long")).cast("int").alias("times"))

    spans = F.transform(F.sequence(div(start * n, stream), div((end - 1) * n, stream)), block)
    takes = F.when(F.col("size") > 0, spans).otherwise(F.array().cast("array<struct<first:bigint,words:bigint,times:int>>"))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x["words"] * x["times"])
    return joined.withColumn("takes", takes).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "takes")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: copy r of a document holds the
    blocks taken at least r times; a copy that takes all of it keeps the text as it is."""
    keys = ["doc_id", "source", "size"]
    # Rows alike in id, source and size are numbered, so each meets its own allocation.
    same = Window.partitionBy(*keys)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    allocated = allocate(docs, **options).filter("taken > 0").withColumn("_n", F.row_number().over(same.orderBy("taken"))).select(*[F.col(k).alias(f"_{k}") for k in keys], "takes", "_n")
    rows = docs.select(*[F.col(c).alias(f"_in_{i}") for i, c in enumerate(docs.columns)], F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.col("text").alias("_text"), size.alias("size"))
    rows = rows.withColumn("_m", F.row_number().over(same.orderBy(F.xxhash64("_text"))))
    match = (F.col("doc_id").eqNullSafe(F.col("_doc_id"))) & (F.col("source").eqNullSafe(F.col("_source"))) & (F.col("size") == F.col("_size")) & (F.col("_m") == F.col("_n"))
    copies = rows.join(allocated, match).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("takes", lambda x: x["times"])))))
    parts = F.filter("takes", lambda x: x["times"] >= F.col("_copy"))
    cut = let(words(F.col("_text")), lambda w: F.array_join(F.flatten(F.transform(parts, lambda x: F.slice(w, (x["first"] + 1).cast("int"), x["words"].cast("int")))), " "))
    text = F.when(F.size(parts) == F.size("takes"), F.col("_text")).otherwise(cut)
    values = {"text": text, "n_chars": F.length(text).cast("long")}
    return copies.select(*[values.get(c, F.col(f"_in_{i}")).alias(c) for i, c in enumerate(docs.columns)])
