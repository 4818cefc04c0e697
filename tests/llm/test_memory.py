"""What a Python worker holds once a task has ended, as it lives on for other stages."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import bpe, jaccard_join
from foliant.llm.catalog import vocabulary
from foliant.llm.common import tidy


class Shared:
    value = np.zeros(0, np.uint64)


def batches():
    texts = [" ".join(f"word{i}x{k}" for k in range(50)) for i in range(40)]
    yield pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts), pa.array(range(40), pa.int64()), pa.nulls(40, pa.int64())], names=["doc_id", "text", "hash", "label"])


@pytest.mark.parametrize("task", [lambda: jaccard_join._base(batches(), 5), lambda: jaccard_join._few(batches(), 5, 80, Shared), lambda: jaccard_join._blobs(batches(), 5, 80, 3, Shared), lambda: jaccard_join._sets(batches(), 5)])
def test_words_of_a_task_are_forgotten(task):
    assert list(task())
    assert not jaccard_join.DIGESTS


def held() -> int:
    """Own memory of this process in MB."""
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="reads /proc")
def test_freed_memory_goes_back_when_a_task_ends():
    seen = {}

    @tidy()
    def task():
        parts = [bytes([1]) * 4000 for _ in range(50_000)]
        seen["last"] = parts[-1]  # pins the end of the heap, so freeing alone gives nothing back
        seen["most"] = held()
        del parts
        yield 1

    assert list(task()) == [1]
    assert seen["most"] - held() > 100


def test_pieces_are_remembered_once():
    codec = bpe.codec(vocabulary())
    codec.of_chunk.forget()
    first = codec.encode(["plain words, and marks; plain words again", "words"])
    assert codec.of_chunk.place
    assert not codec.of_piece.place
    again = codec.encode(["plain words, and marks; plain words again", "words"])
    assert all(np.array_equal(a, b) for a, b in zip(first, again, strict=True))


def test_workers_keep_no_words_of_a_past_task(spark):
    docs = spark.range(200).selectExpr("id as doc_id", "concat('some text of row ', id, ', and ', id * 7) as text")
    assert bpe.encode(docs, vocabulary()).count() == 200 and len(bpe.encode(docs, vocabulary()).collect()) == 200
    jaccard_join.classes(docs).collect()

    def left(rows):
        from foliant.llm import bpe, jaccard_join

        for b in rows:
            n = len(jaccard_join.DIGESTS) + sum(len(c.of_chunk.place) + len(c.of_piece.place) for c in bpe._CODECS.values())
            yield pa.RecordBatch.from_arrays([pa.array([n] * b.num_rows, pa.int64())], names=["n"])

    assert {r["n"] for r in spark.range(0, 64, 1, 8).mapInArrow(left, "n long").collect()} == {0}
