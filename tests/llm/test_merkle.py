"""The Merkle manifest on trees of several blocks, and its paths."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliant.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """(root, siblings of each node) by the plain definition."""
    siblings, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(own):
            siblings[i] += nodes[at // 16 * 16 : at] + nodes[at + 1 : at // 16 * 16 + 16]
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        own = [at // 16 for at in own]
    return nodes[0], siblings


def plain(rows):
    """Leaf, subroot, root and proof of each row (doc_id, text, lang, source, n_chars)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    made = {}
    for doc_id, text, lang, source, n in rows:
        made.setdefault(source, []).append((doc_id is not None, doc_id or 0, h(*map(field, (doc_id, source, lang, n, text)))))
    trees = []
    for source in sorted(made, key=lambda s: (s is not None, (s or "").encode())):
        leaves = sorted(made[source])
        trees.append((leaves, *tree([x[2] for x in leaves])))
    root, over = tree([t[1] for t in trees])
    return Counter((d if known else None, leaf, sub, root, h(*own, *up)) for (leaves, sub, proofs), up in zip(trees, over, strict=True) for (known, d, leaf), own in zip(leaves, proofs, strict=True))


@pytest.fixture(scope="module")
def rows():
    made = [(i, f"Text {i} é" if i % 7 else None, "en", "hot", i) for i in range(700)]
    made += [(i, "Same", None, None if i % 2 else f"s{i % 40}", None) for i in range(700, 900)]
    return [*made, made[0], made[0], (None, "x", "en", "hot", 1), (None, "y", "en", "hot", 1), (5, "another text of id 5", "en", "hot", 1)]


@pytest.mark.parametrize("k", [1, 2, None])
def test_blocks_of_any_size_give_the_plain_trees(spark, rows, k):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    found = merkle.manifest(docs, k=k, paths=True).withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in found) == plain(rows)
    assert all(r["folded_root"] == r["root"] == r["again"] for r in found)


def test_tampering_is_seen(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wanted = Counter(d is None or t is None or t == t.lower() or zlib.crc32(str(d).encode()) % 5 != 0 for d, t, *_ in rows)
    assert Counter(r["verified"] for r in merkle.tampering(docs).collect()) == wanted and wanted[False] > 50
