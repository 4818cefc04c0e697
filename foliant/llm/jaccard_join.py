"""Jaccard similarity self-join of word n-gram sets by PartEnum signatures.

Two sets of at most ``hi`` elements with similarity of ``percent`` / 100 or more
differ in at most k elements. Sets are dealt into bands of sizes so that
partners lie in the same or in neighbouring bands; for each pair of bands the
feature domain is hashed into n1 groups of n2 parts, and each group is
enumerated over the subsets of n2 - k2 parts. Since some group holds at most k2
of the k differences, two similar sets share a signature: the sum of the
elements of one such subset. Spare groups let a set leave out the signatures of
empty subsets unless it has too many of them, so no signature is shared by
chance between small projections. Equal sets are one class from the start.

Sets that share signatures, directly or through others, form a family. A family's
sets meet in one task (families of many elements or sets in tasks by pairs of
blocks, so that no pair of blocks is left out), which counts intersections by
products of 0/1 matrices in stripes of rows, so memory doesn't follow the square
of the sets, and hands on a spanning forest of the links, never the pairs. Before signatures are shuffled, each batch keeps one member a signature
and turns the others into edges to it, so a common signature doesn't gather in one task.
Near copies share hundreds of signatures, which lie in as many buckets as there are, and each of these would tell of them. So the least few
signatures of each set are joined first; sets that share one stand for one set, by its label, when all signatures are dealt.

Null and word-less texts have an empty set and link with nothing. A row with a
null id takes part and gets its group's smallest id, null if there is none. Ties
and repeated rows fall into the same class; texts that share an id are told apart by
their hash. Sets are told apart by a 64-bit
digest: two different sets out of n are confused with probability n^2 / 2^65.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, maybe_broadcast, mix, skew_join, small_batches, stage, tidy

#: Words a shingle has, and the least similarity in percent.
N, PERCENT = 4, 85
#: Text that one bucket of signatures stands for, signatures a task holds before it hands them on, elements and sets of a block of a family, columns and cells of a matrix.
BUCKET_CHARS, HELD, GROUP_ELEMENTS, GROUP_SETS, COLUMNS, CELLS = 4_000_000, 400_000, 400_000, 16_384, 4096, 1 << 21
#: Least signatures of a set that are joined before all are.
FEW = 16
#: Elements that a signature should cover on average.
LEAST_COVER = 3.5
#: An element is common if several sets of so many batches have it; of these, the most frequent are set aside in
#: signatures, so that passages that many documents share don't bring them together. That changes no result.
COMMON_BATCHES, MOST_COMMON = 4, 200_000
#: Words whose digest a worker remembers; tasks that buckets of signatures are dealt to at most.
MEMO, MOST_TASKS = 100_000, 20_000


class WordDigests(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


DIGESTS = WordDigests()


def shingle_sets(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """Each text's sorted distinct shingles as 64-bit digests."""
    out = []
    for t in texts:
        # Text by text, so that the words of one are held as strings, not those of a batch.
        words = t.encode().lower().split() if t else []
        c = len(words)
        w = np.fromiter(map(DIGESTS.__getitem__, words), np.uint64, c)
        k = min(n, c)
        h = np.full(c - k + 1 if c else 0, k, np.uint64)
        for i in range(k):
            h = mix(h + w[i : c - k + 1 + i]) if c else h
        out.append(np.unique(h))
    return out


def digest(elements: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(elements.tobytes()) - (1 << 63)


# Signatures -----------------------------------------------------------------


@cache
def bands(percent: int) -> list[int]:
    """First size of each band; a partner's size is in the same or a neighbouring band."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(starts[-1] * 100 // percent + 1)
    return starts


@cache
def scheme(band: int, percent: int) -> tuple[int, int, int, int]:
    """(groups n1, parts n2, tolerated k2, spare groups) for sets of this band and the next; n1 = 0 if only equal sets match."""
    low, high = bands(percent)[band], bands(percent)[band + 1] - 1
    top = high + high * 100 // percent
    apart = lambda total: total - 2 * -(-percent * total // (100 + percent))  # noqa: E731  most differences of two sets with so many elements in all
    k = max(apart(t) for t in range(max(2 * low, top - 60), top + 1))
    if k <= 0:
        return 0, 0, 0, 0
    found = []
    for k2 in range(min(k, 3) + 1):
        groups = k // (k2 + 1) + 1
        for n2 in range(k2 + 1, k2 + 5):
            lam = groups * math.comb(n2, k2) * math.exp(-low * (n2 - k2) / (groups * n2))
            spare = math.ceil(lam + 4 * math.sqrt(lam) + 1) if groups > 4 else 0
            n1 = groups + spare
            cover, many = low * (n2 - k2) / (n1 * n2), n1 * math.comb(n2, k2)
            found.append((cover < LEAST_COVER, many if cover >= LEAST_COVER else -min(cover, 2 * cover / (many / 8)), n1, n2, k2, spare))
    return min(found)[2:]


def signatures(sets: list[np.ndarray], percent: int = PERCENT, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All signatures, and the index of the set that each is of.

    Without the ``common`` elements two sets differ in no more elements than with
    them, so signatures are of the rest; a set of which that leaves too many
    subsets empty has signatures of all its elements besides, in a space of their own.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    band = np.searchsorted(bands(percent), sizes, side="right") - 1
    of, found = [], []
    for lower in np.unique(np.concatenate([band[sizes > 0], band[sizes > 0] - 1])):
        who = np.flatnonzero((sizes > 0) & ((band == lower) | (band == lower + 1)))
        if lower < 0 or not len(who) or not scheme(int(lower), percent)[0]:
            continue
        if common is not None and len(common):
            sig, index, short = _signed([sets[i] for i in who], int(lower), percent, common)
            found.append(sig)
            of.append(who[index])
            who = who[short]
        if len(who):
            sig, index, _ = _signed([sets[i] for i in who], int(lower), percent, None)
            found.append(sig)
            of.append(who[index])
    return (np.concatenate(found), np.concatenate(of)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _signed(sets: list[np.ndarray], lower: int, percent: int, common: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, the sets they are of, and which sets have more empty groups than are spare."""
    n1, n2, k2, spare = scheme(lower, percent)
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if common is not None:
        at = np.minimum(np.searchsorted(common, elements), len(common) - 1)
        rare = common[at] != elements
        elements, owner = elements[rare], owner[rare]
    spread = mix(elements ^ np.uint64(0xA5A5 + 2 * lower))
    part = owner * (n1 * n2) + (spread % np.uint64(n1 * n2)).astype(np.int64)
    sums = np.zeros(len(sets) * n1 * n2, np.uint64)
    np.add.at(sums, part, mix(spread))
    full = np.bincount(part, minlength=len(sums)).reshape(-1, n1, n2)
    sums = sums.reshape(-1, n1, n2)
    subsets = list(combinations(range(n2), n2 - k2))
    sig = np.stack([sums[:, :, s].sum(axis=2, dtype=np.uint64) for s in map(list, subsets)], axis=2)
    held = np.stack([full[:, :, s].sum(axis=2) > 0 for s in map(list, subsets)], axis=2)
    # Among spare + 1 groups with few differences, not all can be empty unless the set has that many empty ones.
    short = (~held).any(axis=2).sum(axis=1) > spare
    wanted = held if common is not None else held | short[:, None, None]
    label = np.arange(n1 * len(subsets), dtype=np.uint64).reshape(1, n1, -1) + np.uint64((2 * lower + (common is None)) << 32)
    sig = mix(sig + mix(label))
    return sig[wanted], np.broadcast_to(np.arange(len(sets))[:, None, None], sig.shape)[wanted], short


def packed(left: np.ndarray, right: np.ndarray) -> bytes:
    return np.stack([left.view(np.int64), right.view(np.int64)]).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.int64).reshape(2, -1)


def star(sig: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first member of each signature (sorted), and distinct edges from it to the others."""
    first = np.append(True, sig[1:] != sig[:-1])[: len(sig)]
    centre = sid[first][np.cumsum(first) - 1] if len(sig) else sid
    other = ~first & (centre != sid)
    return first, np.unique(np.stack([centre[other], sid[other]]), axis=1)


def forest(edges: np.ndarray) -> np.ndarray:
    """A spanning forest of the edges (two rows): from each node but the least of its component to that."""
    nodes, at = np.unique(edges, return_inverse=True)
    a, b = at.reshape(2, -1)
    label, before = np.arange(len(nodes)), None
    while before is None or (label != before).any():
        before = label.copy()
        least = np.minimum(label[a], label[b])
        # The labels' own labels as well, so that long chains take few rounds.
        for x in (a, b, before[a], before[b]):
            np.minimum.at(label, x, least)
        label = label[label]
    moved = label != np.arange(len(nodes))
    return np.stack([nodes[label[moved]], nodes[moved]])


@tidy(DIGESTS)
def _base(batches, n):
    """A row for each document; and, with ``seen`` set, for each element that several distinct sets of a batch have."""
    for b in batches:
        sets = shingle_sets(b.column(1).to_pylist(), n)
        sids = [digest(s) for s in sets]
        elements, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *dict(zip(sids, sets, strict=True)).values()]), return_counts=True)
        many = count >= 2
        k, extra = len(sets), int(many.sum())
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([b.column(0).cast(pa.int64()), pa.nulls(extra, pa.int64())]),
                pa.array(np.concatenate([[len(s) for s in sets], np.zeros(extra, np.int64)]).astype(np.int64)),
                pa.array(np.concatenate([np.array(sids, np.int64), elements[many].view(np.int64)])),
                pa.concat_arrays([b.column(2), pa.nulls(extra, pa.int64())]),
                pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(count[many].astype(np.int64))]),
            ],
            names=["doc_id", "n_shingles", "sid", "hash", "seen"],
        )


@tidy(DIGESTS)
def _few(batches, n, percent, common):
    """The FEW least signatures of each distinct set of a batch."""
    for b in batches:
        distinct = {digest(s): s for s in shingle_sets(b.column(1).to_pylist(), n)}
        sids = np.fromiter(distinct, np.int64, len(distinct))
        sig, of = signatures(list(distinct.values()), percent, common.value)
        order = np.lexsort((sig, of))
        sig, of = sig[order], of[order]
        least = np.arange(len(of)) - np.searchsorted(of, of) < FEW
        yield pa.RecordBatch.from_arrays([pa.array(sig[least].view(np.int64)), pa.array(sids[of[least]])], names=["sig", "sid"])


@tidy(DIGESTS)
def _blobs(batches, n, percent, buckets, common):
    """Signature members by bucket, one a signature; the others that the task held at the time as edges to it. A set with a label goes by that, and has an edge to it."""
    held, labelled, size, turn = [], [np.zeros((2, 0), np.int64)], 0, 0

    def flush():
        sig, sid = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
        held.clear()
        order = np.argsort(sig, kind="stable")
        sig, sid = sig[order], sid[order]
        first, edges = star(sig, sid)
        edges = forest(np.concatenate([edges, *labelled], axis=1))
        del labelled[1:]
        sig, sid = sig[first], sid[first]
        bucket = (sig >> np.uint64(33)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        present, starts = np.unique(bucket[order], return_index=True)
        ends = np.append(starts, len(order))[1:]
        out = [(i, False, packed(sig[order[a:z]], sid[order[a:z]])) for i, a, z in zip(present.tolist(), starts, ends, strict=True)]
        if edges.size:
            out.append(((turn * 7919 + int(edges[0, 0] & 0xFFFF)) % buckets, True, packed(*edges)))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.bool_()), pa.array([x[2] for x in out], pa.binary())], names=["bucket", "known", "members"])

    for b in batches:
        distinct, label = {}, {}
        for s, known in zip(shingle_sets(b.column(1).to_pylist(), n), b.column(3).to_pylist(), strict=True):
            sid = digest(s)
            distinct[sid] = s
            if known is not None:
                label[sid] = known
        sids = np.fromiter(distinct, np.int64, len(distinct))
        sig, of = signatures(list(distinct.values()), percent, common.value)
        labelled.append(np.array(list(label.items()), np.int64).reshape(-1, 2).T)
        held.append((sig, np.array([label.get(i, i) for i in distinct], np.int64)[of]))
        size += len(sig)
        if size >= HELD:
            yield flush()
            size, turn = 0, turn + 1
    if held:
        yield flush()


@tidy()
def _edges(batches):
    """A spanning forest of each bucket's edges (rows come sorted by bucket): those known, and the star of each signature."""
    bucket, held, known = None, [], []

    def close():
        sig, sid = np.concatenate([np.zeros((2, 0), np.int64), *held], axis=1)
        held.clear()
        order = np.argsort(sig, kind="stable")
        _, edges = star(sig[order], sid[order])
        edges = forest(np.concatenate([*known, edges], axis=1))
        known.clear()
        for a in range(0, edges.shape[1], 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(edges[0, a : a + 100_000]), pa.array(edges[1, a : a + 100_000])], names=["a", "b"])

    for b in batches:
        for i, k, blob in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
            if i != bucket and bucket is not None:
                yield from close()
            bucket = i
            (known if k else held).append(unpacked(blob))
    if bucket is not None:
        yield from close()


@tidy(DIGESTS)
def _sets(batches, n):
    for b in batches:
        sets = shingle_sets(b.column(1).to_pylist(), n)
        ids = pa.array([digest(s) for s in sets], pa.int64())
        out = pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s in sets], pa.binary()), b.column(2), b.column(0)], names=["sid", "elements", "root", "wanted"])
        yield out.filter(pc.equal(out["sid"], out["wanted"])).select(["sid", "elements", "root"])


def linked_pairs(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets; no matrix has more than CELLS cells (or a row, if that is longer)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (sizes.sum() - both) else []
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = (np.bincount(column, minlength=len(values)) > 1)[column]
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    label, out = np.arange(len(sets)), []
    rows = max(1, CELLS // len(sets))
    for top in range(0, len(sets) - 1, rows):
        if (label == label[0]).all():
            break  # no link would join anything more
        common = common_counts(row, column, top, min(top + rows, len(sets)), len(sets))
        for i in range(top, min(top + rows, len(sets) - 1)):
            both = common[i - top, i + 1 - top :].astype(np.int64)
            j = np.flatnonzero(100 * both >= percent * (sizes[i] + sizes[i + 1 :] - both)) + i + 1
            j = j[label[j] != label[i]]
            if len(j):
                met, first = np.unique(label[j], return_index=True)
                out += [(i, k) for k in j[first].tolist()]
                label[np.isin(label, met)] = label[i]
    return out


def common_counts(row: np.ndarray, column: np.ndarray, top: int, end: int, n: int) -> np.ndarray:
    """Common elements of the sets top to end (rows) with the sets from top to n, from entries sorted by column."""
    inside = (row >= top) & (row < end)
    used = np.zeros(int(column[-1]) + 1 if len(column) else 0, bool)
    used[column[inside]] = True
    chosen = used[column] & (row >= top) if len(column) else inside
    row, column = row[chosen] - top, (np.cumsum(used) - 1)[column[chosen]]
    common = np.zeros((end - top, n - top), np.float32)
    width = max(1, min(COLUMNS, CELLS // (n - top)))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (a, a + width))
        part = np.zeros((n - top, min(width, int(column[-1]) + 1 - a)), np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1
        common += part[: end - top] @ part.T  # counts under 2^24 are exact
    return common


@tidy()
def _links(batches, percent):
    """Links within each group of rows (sorted by group): its sets are held together, no others."""
    group, sids, sets = None, [], []

    def close():
        found = linked_pairs(sets, percent) if len(sets) > 1 else []
        return [(sids[i], sids[j]) for i, j in found]

    for b in batches:
        out = []
        for key, sid, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if key != group:
                out += close()
                group, sids, sets = key, [], []
            sids.append(sid)
            sets.append(np.frombuffer(blob.as_buffer(), np.uint64))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
    if out := close():
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])


# Components -----------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for the nodes of links ``(a, b)``: alternating large and small stars until nothing moves."""
    spark = links.sparkSession
    edges = stage(spark, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before, rows = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("_n"))
        large = skew_join(both.filter("v > u"), low, "u", "_n", 2 * rows).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stage(spark, large, "large-stars")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        small = skew_join(large, lowest, "u", "_n", large.count()).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = stage(spark, small.filter("u <> v").distinct(), "stars")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, rows = now, now[0]


def classes(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id of its component)."""
    spark = docs.sparkSession
    base, rooted = _rooted(docs, n, percent)
    least = rooted.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("sets"))
    named = stage(spark, skew_join(rooted, least, "root", "sets", rooted.count()).select("sid", "copies", "least"), "named")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return skew_join(base, named, "sid", "copies", base.count()).select("doc_id", "n_shingles", component.alias("component_id"))


def _rooted(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """A row for each document ``(doc_id, n_shingles, sid, hash)``, and one for each distinct set ``(sid, first, pick, copies, root)``."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    base = docs.mapInArrow(lambda it: _base(it, n), "doc_id long, n_shingles long, sid long, hash long, seen long")
    base = stage(spark, base, "sets")
    frequent = base.filter("seen is not null").groupBy("sid").agg(F.sum("seen").alias("seen"), F.count("*").alias("batches")).filter(F.col("batches") >= COMMON_BATCHES)
    # At most batch rows x elements a set: an element in two sets of most batches is in a fixed share of all sets.
    frequent = frequent.orderBy(F.desc("seen"), "sid").limit(MOST_COMMON).select("sid").collect()
    common = spark.sparkContext.broadcast(np.sort(np.array([r["sid"] for r in frequent], np.int64).view(np.uint64)))
    base = base.filter("seen is null").drop("seen")

    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(chars / BUCKET_CHARS))
    few = stage(spark, docs.mapInArrow(lambda it: _few(it, n, percent, common), "sig long, sid long").distinct(), "few")
    lowest = few.groupBy("sig").agg(F.min("sid").alias("least"), F.count("*").alias("_n")).filter("_n > 1")
    near = skew_join(few, lowest, "sig", "_n", few.count()).groupBy("sid").agg(F.min("least").alias("label")).filter("label <> sid")
    near = stage(spark, near, "near")
    further = maybe_broadcast(near.join(near.select(F.col("label").alias("sid")).distinct(), "sid", "left_semi").select(F.col("sid").alias("_sid"), F.col("label").alias("_label")))
    near = near.join(further, F.col("label") == F.col("_sid"), "left").select("sid", F.coalesce("_label", "label").alias("label"))
    # By hash: a label of another text would merge two families, which compares more sets and links no others.
    label = base.select("sid", "hash").distinct().join(near, "sid").groupBy("hash").agg(F.min("label").alias("label"))
    label = stage(spark, label, "labels")
    blobs = docs.join(maybe_broadcast(label, 500_000), "hash", "left").select("doc_id", "text", "hash", "label")
    blobs = blobs.mapInArrow(lambda it: _blobs(it, n, percent, buckets, common), "bucket int, known boolean, members binary")
    edges = blobs.repartition(min(buckets, MOST_TASKS), "bucket").sortWithinPartitions("bucket").mapInArrow(_edges, "a long, b long")
    labels = components(_linked(spark, docs, base, components(edges), n, percent))
    # A row for each distinct set; then for each class; both go back where they came from, common ones by broadcast.
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "hash")).alias("pick")
    own = base.groupBy("sid").agg(F.min("doc_id").alias("first"), pick, F.count("*").alias("copies"), F.max("n_shingles").alias("n"))
    rooted = own.join(labels, own["sid"] == labels["node"], "left").select("sid", "first", "pick", "copies", "n", F.coalesce("root", "sid").alias("root"))
    return base, stage(spark, rooted, "rooted")


def _linked(spark, docs, base, families, n, percent) -> DataFrame:
    """Links ``(a, b)`` between the set digests of each family ``(node, root)``, as spanning forests."""
    families = families.unionByName(families.select(F.col("root").alias("node"), "root").distinct())
    # Of a set's documents one is read again, known by its id and its text's hash: neither alone tells documents apart.
    chosen = base.join(families, F.col("sid") == F.col("node")).groupBy("sid", "root").agg(F.min(F.struct("doc_id", "hash")).alias("one"), F.max("n_shingles").alias("n"))
    chosen = stage(spark, chosen, "chosen")
    # Families of many elements or sets are dealt into blocks, and each pair of blocks is a group.
    size = F.greatest(F.ceil(F.sum("n") / GROUP_ELEMENTS), F.ceil(F.count("*") / GROUP_SETS))
    blocks = chosen.groupBy("root").agg(size.cast("int").alias("blocks")).filter("blocks > 1").select(F.col("root").alias("_root"), "blocks")
    wanted = chosen.select(F.col("sid").alias("wanted"), F.col("one.doc_id").alias("_id"), F.col("one.hash").alias("_hash"), "root")
    texts = docs.join(maybe_broadcast(wanted), (F.col("hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("wanted", "text", "root")
    sets = texts.mapInArrow(lambda it: _sets(it, n), "sid long, elements binary, root long").dropDuplicates(["sid"])
    dealt = sets.join(blocks, F.col("root") == F.col("_root"), "left").withColumn("_n", F.coalesce("blocks", F.lit(1))).withColumn("_b", F.pmod(F.xxhash64("sid"), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    group = F.xxhash64("root", F.least("_b", "_o"), F.greatest("_b", "_o"))
    grouped = dealt.withColumn("_o", other).select(group.alias("group"), "sid", "elements")
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return grouped.repartition(tasks, "group").sortWithinPartitions("group").mapInArrow(lambda it: _links(it, percent), "a long, b long")


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The documents without near duplicates: of each component that with the smallest id, null ids last,
    and of several texts with that id the one with the least hash; of rows with that id and text, one
    (that with the least hash of all columns). Rows without a word are copies of nothing and stay, as
    do those whose own text is no copy, whoever shares their id."""
    base, rooted = _rooted(docs, n, percent)
    picks = rooted.groupBy("root").agg(F.min("pick").alias("kept"), F.sum("copies").alias("rows"))
    # Few rows are copies, so those are looked for, not the ones to keep.
    copies = skew_join(rooted, picks.filter("rows > 1"), "root", "rows", base.count()).select("sid", "copies", "kept")
    rows = skew_join(base.filter("n_shingles > 0"), copies, "sid", "copies", base.count()).select("doc_id", "hash", "kept")
    rows = stage(docs.sparkSession, rows, "copies")
    is_kept = F.col("hash").eqNullSafe(F.col("kept.hash")) & F.col("doc_id").eqNullSafe(F.col("kept.doc_id"))
    own_hash, row, one, gone_id, gone_hash = (fresh(docs, name) for name in ("_hash", "_row", "_one", "_gone_id", "_gone_hash"))
    hashed = docs.withColumn(own_hash, F.xxhash64("text"))
    alike = (F.col(own_hash) == F.col(gone_hash)) & F.col("doc_id").eqNullSafe(F.col(gone_id))
    named = [F.col("doc_id").alias(gone_id), F.col("hash").alias(gone_hash)]
    left = hashed.join(maybe_broadcast(rows.filter(~is_kept).select(*named).distinct(), 500_000), alike, "left_anti")
    repeated = rows.filter(is_kept).groupBy(*named).count().filter("count > 1").drop("count")
    if repeated.isEmpty():
        return left.drop(own_hash)
    repeated = maybe_broadcast(repeated)
    again = left.join(repeated, alike, "left_semi").withColumn(row, F.xxhash64(*docs.columns))
    first = again.groupBy("doc_id", own_hash).agg(F.min_by(F.struct(*docs.columns), row).alias(one)).select(*(F.col(one)[c].alias(c) for c in docs.columns))
    return left.join(repeated, alike, "left_anti").select(*docs.columns).unionByName(first)


# The same classes for DuckDB, by all pairs that share a shingle and plain reachability.
ORACLE = f"""
with recursive d as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select r, doc_id, case when len(w) = 0 then [] when len(w) < {N} then [array_to_string(w, ' ')] else list_distinct([array_to_string(w[i : i + {N - 1}], ' ') for i in range(1, len(w) - {N - 2})]) end as g from d),
e as (select r, len(g) as n, unnest(g) as shingle from s),
links as (select a.r as a, b.r as b from e a join e b on a.shingle = b.shingle and a.r <> b.r group by a.r, b.r, a.n, b.n having 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
reach as (select r, r as at from s union select reach.r, links.b from reach join links on links.a = reach.at),
least as (select reach.r, min(s.doc_id) as component_id from reach join s on s.r = reach.at group by reach.r)
select s.doc_id, cast(len(g) as bigint) as n_shingles, component_id from s join least using (r)
"""
