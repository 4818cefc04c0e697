"""What op8's tasks do, against plain forms."""

import random
import time
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import lm

from .conftest import passage


def batches(texts, rows):
    return [pa.RecordBatch.from_arrays([pa.array(texts[a : a + rows], pa.string())], names=["text"]) for a in range(0, len(texts), rows)]


def counted(texts, rows, buckets=4):
    """Rows of bucket, words and counts, sorted by bucket, as ``_merged`` gets them."""
    found = [r for b in lm._counted(iter(batches(texts, rows)), buckets) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    found.sort(key=lambda r: r[0])
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "words", "counts"])


@pytest.fixture(autouse=True)
def task(monkeypatch):
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))


@pytest.mark.parametrize(("kept", "paired"), [(10_000, 50_000), (3, 2), (1, 1)])
def test_words_and_byte_pairs_are_counted_as_by_a_plain_pass(monkeypatch, kept, paired):
    monkeypatch.setattr(lm, "COUNTED", 20)
    monkeypatch.setattr(lm, "PAIRED", paired, raising=False)
    rnd = random.Random(3)
    texts = [passage(rnd, rnd.randint(1, 30)) for _ in range(40)] + [None, "", " \n\t", " Élan\x0bÉLAN éLAN ", "zq" * 3000, "a\x00b \x1f c"]
    rnd.shuffle(texts)
    words = Counter(w for t in texts for w in (t or "").encode().lower().split())
    pairs = Counter()
    for w, n in words.items():
        for a, z in zip(b"\n" + w, w + b"\n", strict=True):
            pairs[b"\n" + bytes((a, z))] += n
    rows = counted(texts, 7)
    found = [list(zip(*(c.to_pylist() for c in b.columns), strict=True)) for b in lm._merged(iter([rows]), kept)]
    assert dict(found[-1]) == pairs
    got = [x for bucket in found[:-1] for x in bucket]
    assert len({w for w, _ in got}) == len(got) and all(words[w] == n for w, n in got)
    # Of each bucket the commonest, ties by the word.
    of = {w: i for i, line in zip(rows["bucket"].to_pylist(), rows["words"].to_pylist(), strict=True) for w in (line or b"").split(b"\n") if line}
    for bucket in set(of.values()):
        best = sorted((w for w in words if of[w] == bucket), key=lambda w: (-words[w], w))[:kept]
        assert best in [[w for w, _ in f] for f in found[:-1]]


def test_a_short_text_has_no_cost_of_its_own_when_words_are_counted():
    rnd = random.Random(4)
    words = [f"{rnd.randrange(500)}" for _ in range(16_384)]
    apart, together = 9.0, 9.0
    for _ in range(3):
        began = time.thread_time()
        counted(words, 512)
        apart = min(apart, time.thread_time() - began)
        began = time.thread_time()
        counted([" ".join(words[a : a + 512]) for a in range(0, len(words), 512)], 1)
        together = min(together, time.thread_time() - began)
    assert apart < 10 * together


def test_windows_equal_a_plain_pass():
    rnd = np.random.default_rng(2)
    for lengths in ([5, 0, 1, 2, 3, 0, 1, 1], [1], [2], [0, 0], [], [3, 40]):
        ids, at = rnd.integers(0, 64, sum(lengths)), 0
        near = lm.windows(ids, np.array(lengths, np.int64), 64)
        for n in lengths:
            for i in range(n):
                wanted = [int(ids[at + i + d]) if 0 <= i + d < n else 64 for d in (-2, -1, 1, 2)]
                assert near[:, at + i].tolist() == wanted
            at += n
        assert near.shape == (4, at)


def plain_softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def plain_step(net, seen, ids, near):
    """A row a token, each class's rows picked from and put back among all."""
    n, side = len(ids), len(net["class_bias"])
    h = np.tanh(net["bias"] + sum(net["near"][p][near[p]] for p in range(len(near))))
    c, m = np.divmod(ids, side)
    dc = plain_softmax(h @ net["classes"] + net["class_bias"])
    dc[np.arange(n), c] -= 1
    dc /= n
    grad = {k: np.zeros_like(v) for k, v in net.items()}
    grad["classes"], grad["class_bias"] = h.T @ dc, dc.sum(axis=0)
    dh = dc @ net["classes"].T
    for k in np.unique(c):
        rows = np.flatnonzero(c == k)
        dm = plain_softmax(h[rows] @ net["members"][k] + net["member_bias"][k])
        dm[np.arange(len(rows)), m[rows]] -= 1
        dm /= n
        grad["members"][k], grad["member_bias"][k] = h[rows].T @ dm, dm.sum(axis=0)
        dh[rows] += dm @ net["members"][k].T
    dh *= 1 - h * h
    grad["bias"] = dh.sum(axis=0)
    for p in range(len(near)):
        for j in range(lm.HIDDEN):
            grad["near"][p, :, j] = np.bincount(near[p], dh[:, j].astype(np.float64), net["near"].shape[1])
    for k, g in grad.items():
        seen[k] += g * g
        net[k] -= lm.RATE * g / (np.sqrt(seen[k]) + 1e-8)


def test_a_step_equals_a_plain_one():
    side, rnd = 25, np.random.default_rng(1)
    ids = (side * side * rnd.random(lm.STEP) ** 3).astype(np.int64)
    near = lm.windows(ids, np.full(lm.STEP // 512, 512), side * side)
    nets = []
    for f in (lm.step, plain_step):
        net = lm.start(side)
        seen = {k: np.zeros_like(v) for k, v in net.items()}
        for _ in range(12):
            f(net, seen, ids, near)
        nets.append(net)
    for k in nets[0]:
        assert np.abs(nets[0][k] - nets[1][k]).max() < 1e-3, k


def test_scores_far_apart_are_finite():
    """Where one shift for all columns would make some of them vanish."""
    z = np.array([[0, -300, -90], [-200, -310, 0]], np.float32)
    found = lm.log_softmax_at(z, np.array([1, 0, 0]))
    assert np.allclose(found, [-200, -4.54e-5, -90], rtol=1e-3) and np.allclose(lm.softmax(z).sum(axis=0), 1)


@pytest.mark.parametrize(("size", "tokens", "most"), [(5000, 250_000, 60_000), (7, 250_000, 60_000), (7, 30, 3), (1, 1, 1)])
def test_corrections_are_summed_alike_however_a_bucket_is_dealt(monkeypatch, size, tokens, most):
    monkeypatch.setattr(lm, "SUMMED_TOKENS", tokens)
    monkeypatch.setattr(lm, "SUMMED_PARTS", most)
    rnd = np.random.default_rng(7)
    n = 2000
    key = rnd.integers(0, 300, n).astype(np.uint64) << np.uint64(16) | rnd.integers(0, 3, n).astype(np.uint64)
    doc, lp = rnd.integers(0, 40, n).astype(np.uint16), lm.packed(rnd.uniform(-9, -1, n).astype(np.float32))
    own, outer = Counter(key.tolist()), Counter((key >> np.uint64(16)).tolist())
    wanted = Counter()
    for k, d, x in zip(key.tolist(), doc.tolist(), lp, strict=True):
        if outer[k >> 16] > 1:
            wanted[d] += int(lm.corrections(np.array([own[k]]), np.array([outer[k >> 16]]), np.array([x]))[0])
    rows = [(a % 3, 5, lm.TOKENS, lm.keys_out(key[a : a + size]), doc[a : a + size].tobytes(), lp[a : a + size].tobytes()) for a in range(0, n, size)]
    found = Counter()
    for b in lm._settled(iter([lm.parts(rows)])):
        for _, bucket, kind, _, docs, values in zip(*(c.to_pylist() for c in b.columns), strict=True):
            at = np.frombuffer(docs, np.uint16)
            assert bucket == 5 and kind == lm.SUMS and len(set(at.tolist())) == len(at)
            for d, v in zip(at.tolist(), np.frombuffer(values, np.int32 if len(values) == 4 * len(at) else np.int64).tolist(), strict=True):
                found[d] += v
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in wanted.items() if v}
