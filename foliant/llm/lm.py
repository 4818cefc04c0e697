"""Masked pseudo-likelihood of a bidirectional window network with a corpus-wide memory.

Every token is predicted from the tokens on both sides of it: a table row for
each neighbour's token and place, a tanh layer, and a two-level softmax (class,
then token within class). The vocabulary grows with the corpus (``side_for``):
three quarters of its ids are the commonest words, the others hash buckets of
all remaining words, and within its bucket each word has the probability of its
spelling under a byte-pair chain counted over the corpus's words. So each token
has a conditional probability of its own.

The network is trained in numpy on all tokens: documents are dealt to shards of
about ``SHARD_TOKENS`` by a hash of id and text and trained in the hash's order,
each shard from the same seeded start, and the parameters are averaged in fixed
point. So the same rows give the same network however they are partitioned.

Besides, the output layer has direct connections from both neighbours to the
token, one for every (left, token, right) of the corpus: with c occurrences of
the triple and n of its (left, right) elsewhere in the corpus, the network's p
becomes ``(c + PRIOR p) / (n + PRIOR)``. That table is as large as the corpus; it
never leaves its shuffle partitions. Tokens travel to their context's bucket as
packed keys, and sums come back by document; contexts that are frequent within a
task are counted there first, so a common one doesn't gather in a bucket.

A document's score is the sum of its conditional log probabilities, and their
mean. Null, empty and word-less texts have no token: both are 0. Repeated rows
count as often as they occur, each has a row. A null id stays null. Long texts
are scored whole. An empty table gives no rows. Columns but ``doc_id`` and
``text`` are not looked at. Contexts are told apart by 32 bits within a bucket
of about ``BUCKET_TOKENS`` tokens (a token in some 2,000 shares another's), tokens
of a context by 16; the network's log probabilities are kept to 11 bits, document
sums are exact sums of these.
"""

from __future__ import annotations

from bisect import bisect
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, small_batches, stage

#: Neighbours on each side, hidden units.
SIDE, HIDDEN = 2, 16
#: Tokens in a step, learning rate, tokens of a shard, shards whose networks are averaged at most (beyond, shards are larger).
STEP, RATE, SHARD_TOKENS, MOST_SHARDS = 16_384, 0.05, 1_000_000, 4096
#: Distinct words that a task counts before it lets go of them; words whose byte pairs are counted at once.
COUNTED, PAIRED = 200_000, 50_000
#: Weight of the network against the counts; tokens a task hands on at once, occurrences in them that make a context frequent.
PRIOR, FLUSH_TOKENS, FLUSH_DOCS, FREQUENT = 1.0, 1_000_000, 60_000, 32
#: Tokens, and parts, of a bucket whose corrections are summed at once.
SUMMED_TOKENS, SUMMED_PARTS = 250_000, 60_000
#: Tokens a bucket of contexts stands for; bytes of text that a bucket of words stands for, and word buckets at most (beyond, they are larger).
BUCKET_TOKENS, WORD_BUCKET_BYTES, MOST_BUCKETS = 2_000_000, 8 << 20, 20_000
#: Parts of one that scores and weights are kept in.
SEED, FIXED, FIXED_NET = 11, float(1 << 16), float(1 << 20)
#: Stand for what is before a document's first and after its last token.
BEGIN, END = np.uint64(0x5BF03635), np.uint64(0x1F83D9AB)


def word_table(texts: pa.Array) -> tuple[list[bytes], bytes, np.ndarray, np.ndarray]:
    """The distinct words of a column of texts, these joined by line feeds, the number of each token's word, and how many tokens each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    coded = split.flatten().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # No word holds a line feed.
    line = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar("\n", pa.large_string()))[0].as_buffer().to_pybytes()
    words = line.split(b"\n") if len(coded.dictionary) else []
    real = index != words.index(b"") if b"" in words else np.ones(len(index), bool)  # what stands beside spaces at an end
    before = np.concatenate([[0], np.cumsum(real)])
    offsets = split.offsets.to_numpy()
    return words, line, index[real], before[offsets[1:]] - before[offsets[:-1]]


def side_for(total: int) -> int:
    """Classes, and members of each: the vocabulary's ids are the square, about 1.4 times the cube root of the corpus's tokens."""
    return max(8, round(1.2 * total ** (1 / 6)))


# Corpus counts -----------------------------------------------------------------


def _counted(batches, buckets):
    """The task's words with their counts, packed by bucket of the word. Python touches a batch's distinct words only."""
    seen: dict[bytes, int] = {}

    def flush():
        words = list(seen)
        bucket = np.fromiter(map(xxhash.xxh32_intdigest, words), np.int64, len(words)) % buckets
        order = np.argsort(bucket, kind="stable")
        counts = np.fromiter(seen.values(), np.int64, len(words))[order]
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        ordered = [words[k] for k in order.tolist()]
        rows = [(i, b"\n".join(ordered[a:z]), whole(counts[a:z])) for i, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if z > a]
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "words", "counts"])

    for b in batches:
        words, _, index, _ = word_table(b.column(0))
        for w, n in zip(words, np.bincount(index, minlength=len(words)).tolist(), strict=True):
            if n:
                seen[w] = seen.get(w, 0) + n
        if len(seen) > COUNTED:
            yield flush()
    yield flush()


def byte_pairs(words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """How often each byte follows each, as a line feed stands before and after every word."""
    pairs = np.zeros(1 << 16, np.int64)
    for a in range(0, len(words), PAIRED):
        steps, starts = chain(b"\n".join(words[a : a + PAIRED]))
        pairs += np.bincount(steps, np.repeat(counts[a : a + PAIRED], np.diff(starts, append=len(steps))), 1 << 16).astype(np.int64)
    return pairs


def _merged(batches, most):
    """Of each bucket (rows come sorted by bucket) the commonest words with their counts; then the byte pairs of all words."""
    bucket, seen, pairs = None, {}, np.zeros(1 << 16, np.int64)

    def close():
        nonlocal pairs
        words, n = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
        seen.clear()
        pairs += byte_pairs(words, n)
        # Words rarer than the last that is handed on needn't be sorted.
        least = np.partition(n, len(n) - most)[len(n) - most] if len(n) > most else 0
        best = sorted(((words[i], int(n[i])) for i in np.flatnonzero(n >= least)), key=lambda x: (-x[1], x[0]))[:most]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.binary()), pa.array([k for _, k in best], pa.int64())], names=["word", "n"])

    for b in batches:
        for i, words, counts in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if i != bucket and seen:
                yield close()
            bucket = i
            split = words.split(b"\n")
            for w, n in zip(split, np.frombuffer(counts, np.int32 if len(counts) == 4 * len(split) else np.int64).tolist(), strict=True):
                seen[w] = seen.get(w, 0) + n
    if seen:
        yield close()
    at = np.flatnonzero(pairs)
    yield pa.RecordBatch.from_arrays([pa.array([b"\n" + bytes((int(i) >> 8, int(i) & 255)) for i in at], pa.binary()), pa.array(pairs[at])], names=["word", "n"])


def learn_lexicon(docs: DataFrame) -> tuple[Lexicon, int]:
    """The lexicon and the number of tokens, from one pass over the corpus: words counted by task, then by bucket, and there the byte pairs of each.

    A bucket hands on as many of its commonest words as any vocabulary of a corpus with so many characters would know.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, min(MOST_BUCKETS, chars // WORD_BUCKET_BYTES))
    most = 3 * side_for(chars) ** 2 // 4
    counted = docs.select("text").mapInArrow(lambda it: _counted(it, buckets), "bucket int, words binary, counts binary")
    counts = counted.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _merged(it, most), "word binary, n long")
    counts = stage(spark, counts.withColumn("pair", F.octet_length("word") == 3), "lm-words")
    # No word begins with a line feed, so what does is a byte pair.
    pair = F.col("pair") & (F.substring("word", 1, 1) == F.lit(b"\n"))
    table, total = np.ones((256, 256)), 0
    for key, n in zip(*counts.filter(pair).groupBy("word").agg(F.sum("n").alias("n")).toArrow().to_pydict().values(), strict=True):
        table[key[1], key[2]] += n
        total += n if key[1] == 10 else 0  # every word begins once
    side = side_for(total)
    words = [bytes(r["word"]) for r in counts.filter(~pair).orderBy(F.desc("n"), "word").limit(3 * side * side // 4).collect()]
    return Lexicon(words, side, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)), total


def chain(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of words joined by line feeds each two bytes that follow one another, from the line feed before the first to that after the last; and where each word's begin."""
    chars = np.frombuffer(b"\n" + line + b"\n", np.uint8)
    return chars[:-1].astype(np.int64) << 8 | chars[1:], np.flatnonzero(chars[:-1] == 10)


@dataclass
class Lexicon:
    """The commonest words, best first, the side of the vocabulary, and the spelling chain."""

    known: list[bytes]
    side: int
    spelled: np.ndarray

    def __post_init__(self):
        # Neighbours in frequency are dealt to different classes.
        self.ids = {w: (i % self.side) * self.side + i // self.side for i, w in enumerate(self.known)}
        used = set(self.ids.values())
        self.rest = np.array([i for i in range(self.side**2) if i not in used], np.int64)


def encode(lexicon: Lexicon, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' token ids and hashes, and which of them the lexicon doesn't know."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    ids = np.fromiter(map(lexicon.ids.get, words, repeat(-1)), np.int64, len(words))
    rare = ids < 0
    ids[rare] = lexicon.rest[(h[rare] % np.uint64(len(lexicon.rest))).astype(np.int64)]
    return ids, h, rare


def spelling(lexicon: Lexicon, line: bytes, rare: np.ndarray) -> np.ndarray:
    """The spelling terms of words joined by line feeds; those that the lexicon knows have none."""
    if not len(rare):
        return np.zeros(0, np.float32)
    steps, starts = chain(line)
    term = np.add.reduceat(lexicon.spelled.ravel().take(steps), starts) + np.float32(np.log(len(lexicon.rest)))
    return np.where(rare, term, np.float32(0))


# The network -------------------------------------------------------------------


def shapes(side: int) -> dict[str, tuple[int, ...]]:
    return {
        "near": (2 * SIDE, side * side + 1, HIDDEN), "bias": (HIDDEN,),
        "classes": (HIDDEN, side), "class_bias": (side,),
        "members": (side, HIDDEN, side), "member_bias": (side, side),
    }


def start(side: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return {k: (rng.normal(0, 0.1, s) if "bias" not in k else np.zeros(s)).astype(np.float32) for k, s in shapes(side).items()}


def flat(net: dict) -> np.ndarray:
    return np.concatenate([v.ravel() for v in net.values()])


def unflat(values: np.ndarray, side: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes(side).items():
        n = int(np.prod(s))
        out[k] = values[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def windows(ids: np.ndarray, lengths: np.ndarray, beyond: int) -> np.ndarray:
    """The neighbours of each token (places x tokens); beyond a document's ends stands one id of its own."""
    end = np.cumsum(lengths)
    out = np.full((2 * SIDE, len(ids)), beyond, np.int64)
    for p, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        if d < 0:
            out[p, -d:] = ids[:d]
        else:
            out[p, :-d] = ids[d:]
        for k in range(abs(d)):
            out[p, ((end - lengths + k) if d < 0 else (end - 1 - k))[lengths > k]] = beyond
    return out


def exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of exp(z), each but for a factor, and their sums. One shift for all columns does as long as none of them vanishes."""
    e = z - z.max()
    np.exp(e, out=e)
    total = e.sum(axis=0)
    if total.min() < 1e-30:
        e = np.exp(z - z.max(axis=0))
        total = e.sum(axis=0)
    return e, total


def softmax(z: np.ndarray) -> np.ndarray:
    e, total = exponentials(z)
    e /= total
    return e


def at_rows(z: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of each column the value in one row."""
    return z.ravel().take(rows * z.shape[1] + np.arange(z.shape[1]))


def log_softmax_at(z: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of each column's log softmax the value in one row."""
    e, total = exponentials(z)
    chosen = at_rows(e, rows)
    if chosen.min() < 1e-30:
        z = z - z.max(axis=0)
        return at_rows(z, rows) - np.log(np.exp(z).sum(axis=0))
    return np.log(chosen / total)


def by_class(ids: np.ndarray, side: int):
    """An order of the tokens by class, their classes and members in that order, and each class that occurs with its slice."""
    c = ids // side
    order = np.argsort(c.astype(np.uint16), kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(c, minlength=side))]).tolist()
    ids = ids[order]
    c = ids // side
    return order, c, ids - c * side, [(k, slice(ends[k], ends[k + 1])) for k in range(side) if ends[k + 1] > ends[k]]


def layers(net: dict, near: np.ndarray, slices: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hidden layer of tokens in their classes' order and what goes into both softmaxes, a column each token."""
    h = net["near"][0].take(near[0], axis=0)
    for p in range(1, len(near)):
        h += net["near"][p].take(near[p], axis=0)
    h += net["bias"]
    h = np.ascontiguousarray(h.T)
    np.tanh(h, out=h)
    members = np.empty((len(net["class_bias"]), h.shape[1]), np.float32)
    for k, own in slices:
        members[:, own] = net["members"][k].T @ h[:, own]
        members[:, own] += net["member_bias"][k][:, None]
    return h, net["classes"].T @ h + net["class_bias"][:, None], members


def log_probs(net: dict, ids: np.ndarray, near: np.ndarray) -> np.ndarray:
    order, c, m, slices = by_class(ids, len(net["class_bias"]))
    _, classes, members = layers(net, near.take(order, axis=1), slices)
    out = np.empty(len(ids), np.float32)
    out[order] = log_softmax_at(classes, c) + log_softmax_at(members, m)
    return out


def step(net: dict, seen: dict, ids: np.ndarray, near: np.ndarray) -> None:
    """One Adagrad step on the mean log loss."""
    n, side = len(ids), len(net["class_bias"])
    order, c, m, slices = by_class(ids, side)
    near = near.take(order, axis=1)
    h, dc, dm = layers(net, near, slices)
    dc, dm = softmax(dc), softmax(dm)
    for d, rows in ((dc, c), (dm, m)):
        d[rows, np.arange(n)] -= 1
        d /= n
    grad = {k: np.zeros_like(v) for k, v in net.items()}
    grad["classes"], grad["class_bias"] = h @ dc.T, dc.sum(axis=1)
    dh = net["classes"] @ dc
    for k, own in slices:
        grad["members"][k], grad["member_bias"][k] = h[:, own] @ dm[:, own].T, dm[:, own].sum(axis=1)
        dh[:, own] += net["members"][k] @ dm[:, own]
    dh *= 1 - h * h
    grad["bias"] = dh.sum(axis=1)
    columns = dh.astype(np.float64)
    for p in range(len(near)):
        for j in range(HIDDEN):
            grad["near"][p, :, j] = np.bincount(near[p], columns[j], net["near"].shape[1])
    for k, g in grad.items():
        seen[k] += g * g
        net[k] -= RATE * g / (np.sqrt(seen[k]) + 1e-8)


def id_type(side: int):
    return np.uint16 if side <= 256 else np.uint32


def _encoded(batches, lexicon):
    """A row for each document: its hash, which deals and orders it, and its token ids."""
    small = id_type(lexicon.value.side)
    for b in batches:
        texts = b.column(1).to_pylist()
        words, _, index, lengths = word_table(b.column(1))
        ids, at, out = encode(lexicon.value, words)[0].astype(small)[index], 0, []
        for doc_id, text, n in zip(b.column(0).to_pylist(), texts, lengths.tolist(), strict=True):
            if n:
                out.append((xxhash.xxh3_64_intdigest((text or "").encode(), seed=0 if doc_id is None else doc_id & 0x7FFFFFFFFFFFFFFF) - (1 << 63), ids[at : at + n].tobytes()))
            at += n
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["h", "ids"])


def _trained(batches, side):
    """The network of each shard (rows come sorted by shard and hash), in fixed point."""
    shard, net, seen = None, None, None

    def done():
        values = np.round(flat(net).astype(np.float64) * FIXED_NET).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary()), pa.array([1], pa.int64())], names=["w", "n"])

    for b in batches:
        shards = b.column(0).to_numpy()
        for s in np.unique(shards):
            if s != shard:
                if net is not None:
                    yield done()
                shard, net = s, start(side)
                seen = {k: np.zeros_like(v) for k, v in net.items()}
            docs = [np.frombuffer(x, id_type(side)).astype(np.int64) for x in b.filter(pa.array(shards == s)).column(1).to_pylist()]
            ids = np.concatenate(docs)
            near = windows(ids, np.array([len(d) for d in docs]), side * side)
            for a in range(0, len(ids), STEP):
                step(net, seen, ids[a : a + STEP], near[:, a : a + STEP])
    if net is not None:
        yield done()


def _summed(batches):
    total, n = None, 0
    for b in batches:
        for w, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            part = np.frombuffer(w, np.int64)
            total = part.copy() if total is None else total + part
            n += k
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["w", "n"])


def train(docs: DataFrame, lexicon: Lexicon, total: int) -> dict[str, np.ndarray]:
    """The mean of the shards' networks. Sums are of integers, so their order doesn't matter."""
    spark, side = docs.sparkSession, lexicon.side
    small_batches(spark)
    shared = spark.sparkContext.broadcast(lexicon)
    shards = max(1, min(MOST_SHARDS, -(-total // SHARD_TOKENS)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _encoded(it, shared), "h long, ids binary")
    rows = rows.select(F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("shard"), "h", "ids")
    nets = rows.repartition(shards, "shard").sortWithinPartitions("shard", "h", "ids").select("shard", "ids").mapInArrow(lambda it: _trained(it, side), "w binary, n long")
    # Networks have a size of their own, so a few tasks, then one, can add them up a row at a time.
    if shards > 64:
        nets = nets.repartition(64).mapInArrow(_summed, "w binary, n long")
    found = nets.repartition(1).mapInArrow(_summed, "w binary, n long").first()
    return start(side) if found is None else unflat(np.frombuffer(found["w"], np.int64) / FIXED_NET / found["n"], side)


# Scores ------------------------------------------------------------------------


def context_keys(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token: bits of its context, which choose the bucket, and 32 others of the context with 16 of the token."""
    end = np.cumsum(lengths)
    some = lengths > 0
    left, right = np.empty_like(hashes), np.empty_like(hashes)
    left[1:], right[:-1] = hashes[:-1], hashes[1:]
    left[(end - lengths)[some]], right[(end - 1)[some]] = BEGIN, END
    context = mix(left + mix(right + np.uint64(0x9E37)))
    return (context & np.uint64(0xFFFFFFFF)).astype(np.int64), (context >> np.uint64(32) << np.uint64(16)) | (mix(context ^ hashes) >> np.uint64(48))


def keys_out(key: np.ndarray) -> bytes:
    """Keys of 48 bits in six bytes each."""
    return (key >> np.uint64(16)).astype(np.uint32).tobytes() + key.astype(np.uint16).tobytes()


def keys_in(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, np.uint32, n).astype(np.uint64) << np.uint64(16) | np.frombuffer(data, np.uint16, n, 4 * n)


def whole(values: np.ndarray) -> bytes:
    """Integers in four bytes each if they fit, else in eight."""
    return values.astype(np.int32 if not len(values) or np.abs(values).max() < 1 << 31 else np.int64).tobytes()


def packed(lp: np.ndarray) -> np.ndarray:
    """Log probabilities in two bytes; of a word of many millions of bytes they are bounded."""
    return (np.maximum(lp, -6.5e7) / 1024).astype(np.float16)


def unpacked(values: np.ndarray) -> np.ndarray:
    return values.astype(np.float64) * 1024


def corrections(triples: np.ndarray, contexts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """What the memory adds to each log probability, in fixed point: counts include the token itself, which is left out."""
    c, n, lp = triples - 1.0, contexts - 1.0, unpacked(values)
    elsewhere = np.log(np.maximum(c, 1.0) + PRIOR * np.exp(lp)) - lp
    return np.round((np.where(c > 0, elsewhere, np.log(PRIOR)) - np.log(n + PRIOR)) * FIXED).astype(np.int64)


def runs(values: np.ndarray) -> np.ndarray:
    """The number of the run of equal values that each place is in."""
    return np.cumsum(np.append(True, values[1:] != values[:-1])[: len(values)]) - 1


PART = "uid long, bucket int, kind int, keys binary, docs binary, values binary"
NAMES = [x.split()[0] for x in PART.split(", ")]
KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
#: Kinds of parts: a flush's documents, its frequent contexts' tokens; tokens and counts by bucket; what comes back of these.
DOCS, HELD, TOKENS, COUNTS, SUMS, TOTALS = range(6)


def parts(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, KINDS, strict=True)], names=NAMES)


def _spread(batches, shared, buckets, flush_tokens):
    """Scores by the network, packed by context bucket. A flush's uid is the same whenever its task runs again."""
    lexicon, values = shared.value
    net, turn = unflat(values, lexicon.side), 0
    held: list = []

    def flush():
        nonlocal turn
        uid, turn = (TaskContext.get().partitionId() << 32) + turn, turn + 1
        doc_ids, hashes, lps, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        doc = np.repeat(np.arange(len(lengths), dtype=np.uint16), lengths)
        ends = np.concatenate([[0], np.cumsum(np.round(unpacked(lps) * FIXED).astype(np.int64))])
        sums, anywhere = ends[np.cumsum(lengths)] - ends[np.cumsum(lengths) - lengths], uid * 7919 % buckets
        out = [(uid, anywhere, DOCS, doc_ids.tobytes(), lengths.tobytes(), sums.tobytes())]
        low, key = context_keys(hashes, lengths)
        bucket = low % buckets
        order = np.argsort(bucket.astype(np.uint64) << np.uint64(48) | key) if buckets <= 1 << 16 else np.lexsort((key, bucket))
        bucket, key, doc, lp = bucket[order], key[order], doc[order], lps[order]
        run = runs((key >> np.uint64(16)) | (bucket.astype(np.uint64) << np.uint64(32)))
        often = (np.bincount(run) >= FREQUENT)[run] if len(run) else run.astype(bool)
        bounds = np.searchsorted(bucket[~often], np.arange(buckets + 1))
        k, d, v = key[~often], doc[~often], lp[~often]
        out += [(uid, i, TOKENS, keys_out(k[a:z]), d[a:z].tobytes(), v[a:z].tobytes()) for i, (a, z) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if z > a]
        if often.any():
            # One key a frequent (context, token) goes to its bucket with its count; the tokens wait for what comes back.
            k, b = key[often], bucket[often]
            first = np.append(True, (k[1:] != k[:-1]) | (b[1:] != b[:-1]))
            at = np.cumsum(first) - 1
            k, b, count = k[first], b[first], np.bincount(at)
            # The totals of a bucket come back in the order of its keys; with the bucket's number they find their place.
            out.append((uid, anywhere, HELD, b.astype(np.int32).tobytes(), at.astype(np.int32).tobytes() + doc[often].tobytes(), lp[often].tobytes()))
            bounds = np.searchsorted(b, np.arange(buckets + 1))
            out += [(uid, i, COUNTS, keys_out(k[a:z]), b"", count[a:z].tobytes()) for i, (a, z) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if z > a]
        return parts(out)

    size = docs = 0
    for b in batches:
        words, line, index, lengths = word_table(b.column(1))
        ids, hashes, rare = encode(lexicon, words)
        term, ids, hashes = spelling(lexicon, line, rare)[index], ids[index], hashes[index]
        near = windows(ids, lengths, lexicon.side**2)
        lp = np.concatenate([np.zeros(0, np.float32), *(log_probs(net, ids[a : a + STEP], near[:, a : a + STEP]) for a in range(0, len(ids), STEP))])
        doc_id = b.column(0)
        held.append((np.array([np.iinfo(np.int64).min if x is None else x for x in doc_id.to_pylist()], np.int64), hashes, packed(lp + term), lengths))
        size, docs = size + len(ids), docs + len(lengths)
        if size >= flush_tokens or docs >= FLUSH_DOCS:
            yield flush()
            size = docs = 0
    if held:
        yield flush()


def document_sums(held: list[tuple], triples: np.ndarray, contexts: np.ndarray) -> list[tuple]:
    """Of parts of tokens, all at once, the sums of corrections by document."""
    more = np.flatnonzero(contexts > 1)
    doc, values = (np.frombuffer(b"".join(x), t)[more] for x, t in (([r[3] for r in held], np.uint16), ([r[4] for r in held], np.float16)))
    part = np.repeat(np.arange(len(held), dtype=np.uint16), [len(r[4]) // 2 for r in held])[more]
    delta = corrections(triples[more], contexts[more], values)
    order = np.argsort(doc, kind="stable")
    order = order[np.argsort(part[order], kind="stable")]
    doc, part = doc[order], part[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (part[1:] != part[:-1]))[: len(doc)])
    doc, part, sums = doc[first], part[first], np.add.reduceat(delta[order], first) if len(first) else delta
    bounds = np.searchsorted(part, np.arange(len(held) + 1)).tolist()
    return [(uid, bucket, SUMS, b"", doc[a:z].tobytes(), whole(sums[a:z])) for (uid, bucket, *_), a, z in zip(held, bounds[:-1], bounds[1:], strict=True) if z > a]


def _settled(batches):
    """Each bucket's counts (parts come sorted by bucket), as sums of corrections by document and as totals of frequent keys.
    Other parts are handed on."""
    bucket, tokens, often = None, [], []

    def close():
        keys = [keys_in(r[2]) for r in tokens + often]
        ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        size, ends = ends[len(tokens)], ends.tolist()
        counts = np.concatenate([np.ones(size, np.int64), *(np.frombuffer(r[4], np.int64) for r in often)])
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        run, outer = runs(key[order]), runs(key[order] >> np.uint64(16))
        triples, contexts = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        triples[order] = np.bincount(run, counts[order])[run].astype(np.int64)
        contexts[order] = np.bincount(outer, counts[order])[outer].astype(np.int64)
        del keys, counts, key, order, run, outer
        out, i = [], 0
        while i < len(tokens):
            # Where buckets are many, a part is small; what is done for each would outweigh its tokens.
            z = max(i + 1, min(bisect(ends, ends[i] + SUMMED_TOKENS) - 1, i + SUMMED_PARTS, len(tokens)))
            own = slice(ends[i], ends[z])
            out += document_sums(tokens[i:z], triples[own], contexts[own])
            i = z
        for (uid, *_), a, z in zip(often, ends[len(tokens) : -1], ends[len(tokens) + 1 :], strict=True):
            out.append((uid, bucket, TOTALS, b"", b"", np.stack([triples[a:z], contexts[a:z]]).tobytes()))
        tokens.clear()
        often.clear()
        return parts(out)

    for b in batches:
        for uid, i, kind, keys, docs, values in zip(*(b.column(n).to_pylist() for n in NAMES), strict=True):
            if i != bucket and (tokens or often):
                yield close()
            bucket = i
            if kind in (DOCS, HELD):
                yield parts([(uid, i, kind, keys, docs, values)])
            else:
                (tokens if kind == TOKENS else often).append((uid, i, keys, docs, values))
    if tokens or often:
        yield close()


OUT = "doc_id long, n_tokens long, log_prob double, mean_log_prob double"


def _gathered(batches):
    """A row for each document once all parts of its flush (sorted by uid and kind) are seen."""
    uid, state = None, {}

    def close():
        if "held" in state:
            b, at, doc, lp = state["held"]
            totals = np.zeros((2, len(b)), np.int64)
            for i, found in state["totals"]:
                a, z = np.searchsorted(b, (i, i + 1))
                totals[:, a:z] = found
            np.add.at(state["sums"], doc, corrections(totals[0, at], totals[1, at], lp))
        total = np.round(state["sums"] / FIXED, 4)
        n = state["lengths"]
        return pa.RecordBatch.from_arrays(
            [pa.array(state["ids"], mask=state["ids"] == np.iinfo(np.int64).min), pa.array(n), pa.array(total), pa.array(np.where(n > 0, total / np.maximum(n, 1), 0.0))],
            names=[x.split()[0] for x in OUT.split(", ")],
        )

    for b in batches:
        for own, i, kind, keys, docs, values in zip(*(b.column(n).to_pylist() for n in NAMES), strict=True):
            if own != uid:
                if uid is not None:
                    yield close()
                uid, state = own, {"totals": []}
            if kind == DOCS:
                state |= {"ids": np.frombuffer(keys, np.int64), "lengths": np.frombuffer(docs, np.int64), "sums": np.frombuffer(values, np.int64).copy()}
            elif kind == HELD:
                n = len(values) // 2
                state["held"] = np.frombuffer(keys, np.int32), np.frombuffer(docs, np.int32, n), np.frombuffer(docs, np.uint16, n, 4 * n), np.frombuffer(values, np.float16)
            elif kind == SUMS:
                at = np.frombuffer(docs, np.uint16)
                state["sums"][at] += np.frombuffer(values, np.int32 if len(values) == 4 * len(at) else np.int64)
            else:
                state["totals"].append((i, np.frombuffer(values, np.int64).reshape(2, -1)))
    if uid is not None:
        yield close()


def score(docs: DataFrame, lexicon: Lexicon, net: dict, total: int, flush_tokens: int = FLUSH_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """``(doc_id, n_tokens, log_prob, mean_log_prob)`` of every whole text; ``total`` tokens set the number of buckets."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((lexicon, flat(net)))
    buckets = max(1, -(-total // bucket_tokens))
    spread = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _spread(it, shared, buckets, flush_tokens), PART)
    settled = spread.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_settled, PART)
    return settled.repartition("uid").sortWithinPartitions("uid", "kind").mapInArrow(_gathered, OUT)


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Count the corpus's words, train on all of it, score all of it."""
    small_batches(docs.sparkSession)
    lexicon, total = learn_lexicon(docs)
    return score(docs, lexicon, train(docs, lexicon, total), total)
