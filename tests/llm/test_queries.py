"""Every opN query on awkward and on empty tables, against DuckDB or a plain version."""

import hashlib
import zlib
from collections import Counter

import duckdb
import pytest

from foliant.llm import bpe
from foliant.llm.catalog import ORACLE_SQL, QUERIES, vocabulary
from tests.compare import difference

from . import brute

SMALL = "/root/testdata/sf0.001"


def read(folder):
    name = folder if folder == SMALL else f"{folder}"
    path = f"{name}/documents.parquet" if folder == SMALL else f"{name}/documents.parquet/*.parquet"
    return duckdb.sql(f"select doc_id, text, source from '{path}'").fetchall()


@pytest.fixture(params=["awkward", "small"])
def folder(request):
    return SMALL if request.param == "small" else request.getfixturevalue("awkward")


def rows(spark, name, folder, *columns):
    return Counter(tuple(r) for r in QUERIES[name](spark, folder).select(*columns).collect())


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables_give_no_rows(spark, nothing, name):
    assert QUERIES[name](spark, nothing).collect() == []


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_oracle(spark, folder, name, tmp_path):
    if folder != SMALL:  # DuckDB reads Spark's folders by a pattern
        con = duckdb.connect()
        for t in ("documents", "pages", "conversations"):
            con.execute(f"copy (select * from '{folder}/{t}.parquet/*.parquet') to '{tmp_path}/{t}.parquet' (format parquet)")
    assert difference(QUERIES[name](spark, folder), ORACLE_SQL[name], SMALL if folder == SMALL else str(tmp_path)) == ""


def test_mixing(spark, folder):
    found = QUERIES["op1_mixing"](spark, folder).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, QUERIES["op1_mixing"](spark, folder).collect()))
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((i, len(brute.words(t))) for i, t, _ in read(folder))
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in found)
    taken = Counter()
    for r in found:
        taken[r["target"], r["source_size"]] += r["taken"]
    for (target, size), n in taken.items():
        assert abs(n - target) <= max(1, min(64, size / 64)) + 0.002 * target  # a block of the source, and shards' uneven blocks


def test_bpe(spark, folder):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    tok.no_truncation()
    tok.no_padding()
    wanted = Counter()
    for i, t, _ in read(folder):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        wanted[i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(tok.decode(ids, skip_special_tokens=False))] += 1
    assert rows(spark, "op2_bpe", folder, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == wanted


def test_toxicity(spark, folder):
    found = QUERIES["op3_toxicity"](spark, folder).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, *_ in read(folder))
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_jaccard_join(spark, folder):
    wanted = brute.components([(i, t) for i, t, _ in read(folder)], 4, 85)
    assert rows(spark, "op7_jaccard_join", folder, "doc_id", "n_shingles", "component_id") == Counter(wanted)


def test_lm_scoring(spark, folder):
    found = QUERIES["op8_lm_scoring"](spark, folder).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in found) == Counter((i, len((t or "").encode().split())) for i, t, _ in read(folder))
    assert all(r["log_prob"] <= 0 and (r["log_prob"] < 0) == (r["n_tokens"] > 0) for r in found)


def test_media(spark, folder):
    wanted = Counter()
    for i, t, _ in read(folder):
        raw = (t or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        wanted[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    assert rows(spark, "op9_media", folder, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == wanted


def test_pii(spark, folder):
    wanted = Counter()
    for i, t, _ in read(folder):
        spans = brute.base_spans(t)
        n = Counter(k for k, *_ in spans)
        wanted[(i, *(n[k] for k in brute.KINDS), brute.sha(",".join(f"{k}:{a}:{z}" for k, a, z in spans)))] += 1
    found = QUERIES["op10_pii"](spark, folder).collect()
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in found) == wanted
    assert all(r["n_spans"] == len([s for s in r["spans"].split(",") if s]) for r in found)
    listed = {(r["doc_id"], s) for r in found for s in r["spans"].split(",") if s}
    assert {(i, f"{k}:{a}:{z}") for i, t, _ in read(folder) for k, a, z in brute.base_spans(t)} <= listed


def test_codec_survives_odd_texts():
    import random

    from tokenizers import Tokenizer

    tok, rnd = Tokenizer.from_file(vocabulary()), random.Random(1)
    parts = [" ", "  ", "\n", "\t ", " ", "　", "\x1c", "a", "The", "'s", "'", "12", "½", "é", "你", "🎉", "<|endoftext|>", "", "\x85", "--", "x" * 40, "zqxj"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 40))) for _ in range(3000)]
    ids, n = bpe.codec(vocabulary()).encode(texts)
    at = 0
    for t, k in zip(texts, n.tolist(), strict=True):
        assert ids[at : at + k].tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)
        at += k


def test_codec_takes_long_words():
    import random
    import time

    from tokenizers import Tokenizer

    tok, rnd = Tokenizer.from_file(vocabulary()), random.Random(2)
    texts = ["".join(rnd.choices("etaoinshrdlu", k=n)) for n in (150, 199, 200, 201, 5000, 60_000)]
    texts += ["ab" * 700, "你好" * 900, "".join(rnd.choices("0123456789abcdef", k=3000)), "a" * 999]
    ids, n = bpe.codec(vocabulary()).encode(texts)
    at = 0
    for t, k in zip(texts, n.tolist(), strict=True):
        assert ids[at : at + k].tolist() == tok.encode(t, add_special_tokens=False).ids
        at += k
    million = "".join(rnd.choices("etaoinshrdlu", k=1_000_000))
    began = time.time()
    ids, _ = bpe.codec(vocabulary()).encode([million])
    assert time.time() - began < 60 and bpe.codec(vocabulary()).decode(ids).decode() == million
    assert ids.tolist() == tok.encode(million, add_special_tokens=False).ids


def test_codec_forgets_and_cuts_without_changing_ids(monkeypatch):
    import random

    monkeypatch.setattr(bpe, "TABLE_WORDS", 20)
    monkeypatch.setattr(bpe, "SEGMENT_CHARS", 50)
    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choices("abcde ", k=rnd.randint(1, 9))) for _ in range(60)) for _ in range(40)]
    plain, n = bpe.Codec(vocabulary()).encode(texts)
    codec, got = bpe.Codec(vocabulary()), []
    for _, parts in bpe._chunks(texts):
        got += codec.encode(parts)[0].tolist()
    assert got == plain.tolist()
