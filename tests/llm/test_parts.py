"""The operators' own parts against plain versions."""

import io
import math
import random
import re
import struct
import time
import zipfile
from collections import Counter

import numpy as np
import pytest
import xxhash

from foliant.llm import jaccard_join, licenses, lm, media, mixing, pii, toxicity, warc

from . import brute
from .conftest import passage


def test_sainte_lague_gives_the_highest_quotients():
    rnd = random.Random(2)
    for _ in range(200):
        votes, seats = [rnd.choice((0, rnd.random() * 100)) for _ in range(rnd.randint(1, 8))], rnd.randint(0, 60)
        got = mixing.sainte_lague(votes, seats)
        plain = [0] * len(votes)
        for _ in range(seats if any(votes) else 0):
            i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * plain[i] + 1), -i))
            plain[i] += 1
        assert got.tolist() == plain


def test_targets_reshare_what_exceeds_the_cap():
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == [30.0, 120.0, 60.0]
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0]


def test_mixed_documents_hold_the_words_taken(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet").filter("doc_id is not null").dropDuplicates(["doc_id"])
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(brute.words(r["text"]))
    assert words == {r["doc_id"]: r["taken"] for r in mixing.allocate(docs).collect() if r["taken"]}


def osa(a, b):
    """Edits between two words; swaps of neighbours count as one."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_edits_are_found_anywhere_by_the_length_of_the_term(monkeypatch):
    monkeypatch.setattr(toxicity, "ABREAST", 500)
    lexicon = toxicity.Lexicon(toxicity.SEED_TERMS, (), frozenset({"crash"}))
    lexicon.learn_words({"xidiot", "ztupid", "tsupid", "1diot", "diot", "moro", "crash", "harbour", "pif", "arbage"})
    assert set(lexicon.hits) == {"xidiot", "ztupid", "tsupid", "1diot", "diot", "moro", "arbage"}
    rnd, words = random.Random(6), set()
    for _ in range(3000):
        w = list(rnd.choice(toxicity.SEED_TERMS))
        for _ in range(rnd.randint(0, 3)):
            i = rnd.choice((0, rnd.randrange(len(w) + 1)))
            w[i : i + rnd.randint(0, 2)] = rnd.choice(("", "a", "s", "o", "ed"))
        if len(w) >= 4:
            words.add("".join(w))
    plain = {w for w in words if any(osa(w, t) <= toxicity.edits_allowed(len(t)) for t in toxicity.SEED_TERMS)}
    assert set(lexicon.misspelled(sorted(words))) == plain
    other = plain - set(toxicity.SEED_TERMS)  # words that are terms as they stand aren't looked up so
    assert other <= set(lexicon.reachable(sorted(words))) and len(lexicon.reachable(sorted(words))) < len(words)
    assert set(lexicon.misspelled(lexicon.reachable(sorted(words)))) - set(toxicity.SEED_TERMS) == other


def test_terms_that_a_stem_covers_are_found_with_an_edit_in_the_stem(spark):
    ends = ("ando", "eria", "osum", "ilar", "uten")
    toxic = ["plain text here " + " ".join(f"grobul{ends[(i + k) % 5]}" for k in range(3)) + f" number{i}" for i in range(40)]
    rows = [(t, 1) for t in toxic] + [(f"plain text here of quiet harbours number{i}", 0) for i in range(60)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "text string, label int")).lexicon
    lexicon.learn_words({"grxbulando", "harbours"})
    assert any("grobulando".startswith(s) for s in lexicon.stems) and set(lexicon.hits) == {"grxbulando"}


def test_toxicity_tells_abuse_from_quotation():
    model = toxicity.Model(toxicity.Lexicon(toxicity.SEED_TERMS, (), frozenset()), *toxicity.DEFAULT)
    abuse, spelled, quoted, clean, empty, none = model.scores(["you are a pathetic idiot", "you are a pahtetic id1ot", 'the word "idiot" is an insult', "a quiet harbour", "", None])
    inside, outside = model.scores(['"the idiot came here" it read', "the idiot came here it read"])
    assert inside < 0.3 < outside
    assert abuse > 0.7 and spelled > 0.5 and quoted < spelled and clean == empty == none < 0.2


def plain_score(text, model):
    """A text's score by plain edit distances to every term and a walk over its tokens."""
    lx, tokens = model.lexicon, (text or "").lower().split()

    def kind(token):
        word = token.strip(toxicity.EDGE)
        exact = lambda w: w in lx.terms or any(w.startswith(s) for s in lx.stems)
        if exact(word):
            return 1
        if word in lx.clean or (not word.isalpha() and 2 * sum(map(str.isalpha, word)) < len(word)):
            return 0
        plain = word if word.isalpha() else word.translate(toxicity.LEET)
        near = any(0 < toxicity.edits_allowed(len(t)) >= osa(plain, t) for t in lx.terms if abs(len(t) - len(plain)) < 3)
        return 2 if near or (plain != word and exact(plain)) else 0

    kinds = [kind(t) for t in tokens]
    between, x = toxicity.quotations(tokens), np.zeros(len(toxicity.FEATURES))
    for i, k in enumerate(kinds):
        if k:
            around = range(max(0, i - toxicity.WINDOW), min(len(tokens), i + toxicity.WINDOW + 1))
            near = [tokens[j].strip(toxicity.EDGE) for j in around]
            x += (1, k == 1, k == 2, i in between, any(w in toxicity.SAYING for w in near), any(w in toxicity.ADDRESS for w in near), sum(kinds[j] > 0 for j in around) > 1, 0)
            x[-1] = 1
    x[:-1] = np.log1p(x[:-1])
    return 1 / (1 + math.exp(-(float(x @ model.weights) + model.bias)))


def test_toxicity_scores_equal_a_plain_version(spark):
    from foliant.llm.common import table

    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    model = toxicity.learn(toxicity.training_rows(docs, table(spark, "/root/testdata/sf0.001", "labels")))
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(60).collect()] + ["you pathetik id1ot", 'the "moron" said', None, "", "harbour " * 30 + "stupdi"]
    found = model.scores([t and t[:3000] for t in texts])
    for t, got in zip(texts, found, strict=True):
        assert abs(got - plain_score(t and t[:3000], model)) < 1e-9


def test_toxicity_on_held_out_labels(spark):
    from foliant.llm.catalog import QUERIES

    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in QUERIES["op3_toxicity"](spark, sf).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    caught = sum(p and t for p, t in held)
    assert caught >= 0.75 * sum(t for _, t in held) and caught >= 0.8 * sum(p for p, _ in held)


def near_copies(rnd, families, size):
    texts = []
    for _ in range(families):
        base = passage(rnd, rnd.choice((3, 6, 20, 60, 200))).split()
        for _ in range(rnd.randint(1, size)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 15))):
                w[rnd.randrange(len(w))] = rnd.choice(("changed", "other", "word"))
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 95)])
def test_similar_sets_share_a_signature(n, percent):
    texts = near_copies(random.Random(n), 60, 8)
    sets = list({s.tobytes(): s for s in jaccard_join.shingle_sets(texts, n) if len(s)}.values())
    sig, of = jaccard_join.signatures(sets, percent)
    own = [set(sig[of == i].tolist()) for i in range(len(sets))]
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                assert own[i] & own[j]


def test_jaccard_candidates_do_not_grow_with_the_buckets(spark, documents, monkeypatch):
    rnd = random.Random(31)
    texts = []
    for _ in range(20):
        words = passage(rnd, 200).split()
        texts += [" ".join(words[:at] + ["changed"] + words[at + 1 :]) for at in (20, 100, 180)]
    monkeypatch.setattr(jaccard_join, "BUCKET_CHARS", 1000)
    seen = []
    components = jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", lambda links: (seen.append(links.count()), components(links))[1])
    found = jaccard_join.classes(documents(texts).repartition(30), 5, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: i - i % 3 for i in range(60)}
    # Each bucket told of each pair again: thousands.
    assert len(seen) == 2 and seen[0] <= 4 * len(texts)


def test_forest_spans_each_component_once():
    rnd = random.Random(32)
    for n in (0, 1, 5, 300):
        pairs = [(rnd.randint(-60, 60), rnd.randint(-60, 60)) for _ in range(n)] + [(1000 + i, 1001 + i) for i in range(n)]
        found = jaccard_join.forest(np.array(pairs, np.int64).reshape(-1, 2).T)
        nodes = {x for p in pairs for x in p}
        least = {x: x for x in nodes}
        for _ in nodes:
            for a, b in pairs:
                least[a] = least[b] = min(least[a], least[b])
        assert sorted(zip(*found.tolist(), strict=True)) == sorted((r, x) for x, r in least.items() if r != x)


@pytest.mark.parametrize("elements", [2_000_000, 500])
def test_jaccard_classes_of_near_copies(spark, documents, monkeypatch, elements):
    monkeypatch.setattr(jaccard_join, "GROUP_ELEMENTS", elements)  # few: families are dealt into pairs of blocks
    texts = near_copies(random.Random(7), 25, 30)
    random.Random(8).shuffle(texts)
    found = jaccard_join.classes(documents(texts).repartition(5), 5, 80).collect()
    assert sorted(map(tuple, found)) == sorted(brute.components(list(enumerate(texts)), 5, 80))


def test_memory_of_a_family_does_not_follow_its_sets_squared():
    import tracemalloc

    same = np.arange(12, dtype=np.uint64)
    sets = [np.append(same, np.uint64(100 + i)) for i in range(8000)]  # each two have 12 of 14 elements in common
    tracemalloc.start()
    try:
        found = jaccard_join.linked_pairs(sets, 80)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == 7999 and len({i for pair in found for i in pair}) == 8000
    assert peak < 200_000_000


@pytest.mark.parametrize("cells", [1, 300, 1 << 23])
def test_stripes_of_rows_find_the_classes_of_all_pairs(monkeypatch, cells):
    monkeypatch.setattr(jaccard_join, "CELLS", cells)
    texts = near_copies(random.Random(cells), 25, 6)
    sets = list({s.tobytes(): s for s in jaccard_join.shingle_sets(texts, 3) if len(s)}.values())

    def classes(pairs):
        label = list(range(len(sets)))
        for i, j in pairs:
            label = [label[i] if x == label[j] else x for x in label]
        return {frozenset(k for k, x in enumerate(label) if x == y) for y in label}

    both = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    plain = [(i, j) for j in range(len(sets)) for i in range(j) if 100 * both(i, j) >= 80 * (len(sets[i]) + len(sets[j]) - both(i, j))]
    found = jaccard_join.linked_pairs(sets, 80)
    assert classes(found) == classes(plain) and len(found) == len(sets) - len(classes(plain))


def test_families_of_many_sets_are_dealt_into_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_SETS", 10)
    texts = [" ".join(["notice"] * 3 + [f"w{k}" for k in range(16)] + [f"last{i}"]) for i in range(60)]
    docs = documents(texts)
    assert {r["component_id"] for r in jaccard_join.classes(docs, 4, 80).collect()} == {0}


def test_one_document_of_each_group_stays(spark, documents):
    texts = near_copies(random.Random(9), 10, 6) + [None, "", "lone words here"]
    kept = [r["doc_id"] for r in jaccard_join.keep_one(documents(texts), 5, 80).collect()]
    wanted = {c if n else i for i, n, c in brute.components(list(enumerate(texts)), 5, 80)}
    assert sorted(kept) == sorted(wanted)


PROSE = " ".join(f"plain{i % 90}" for i in range(120))


def test_texts_that_share_an_id_are_judged_apart(spark):
    other = " ".join(f"w{i}" for i in range(40))
    near = other + " more words"
    rows = [(1, PROSE, "a"), (1, other, "b"), (1, other, "c"), (2, near, "d"), (None, near, "e"), (None, PROSE + " end", "f"), (None, "alone and without an id", "g"), (3, None, "h"), (3, None, "h"), (None, "", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hash string")
    kept = Counter(tuple(r) for r in jaccard_join.keep_one(docs, 3, 80).collect())
    assert kept == Counter(tuple(r) for r in jaccard_join.keep_one(docs.repartition(7, "text"), 3, 80).collect())
    assert sum(n for (i, t, _), n in kept.items() if t == other) == 1 and kept[1, PROSE, "a"] == 1
    assert sum(kept.values()) == 6 and kept[3, None, "h"] == 2 and kept[None, "alone and without an id", "g"] == 1


def test_many_rows_without_an_id_join_in_time_by_their_number(spark):
    rnd = random.Random(6)
    texts = near_copies(rnd, 900, 4) * 5
    make = lambda ids: spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(16)
    docs = make([None] * len(texts))
    began = time.time()
    found = jaccard_join.classes(docs, 4, 80).collect()
    assert time.time() - began < 60 and len(found) == len(texts) and all(r["component_id"] is None for r in found)
    groups = {r["component_id"] for r in jaccard_join.classes(make(range(len(texts))), 4, 80).collect()}
    assert jaccard_join.keep_one(docs, 4, 80).count() == len(groups)


def test_words_of_any_length(spark, documents):
    rnd = random.Random(8)
    long = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1200))
    huge = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    rows = [(f"some words {i} {long} and {huge if i % 2 else 'more'}", 1) for i in range(15)] + [(f"plain text number {i} of many", 0) for i in range(60)]
    model = toxicity.learn(spark.createDataFrame(rows, "text string, label int"))
    found = {r["doc_id"]: r["score"] for r in toxicity.score(documents([f"x {long}", f"x {long[:-1]}y", f"x {huge}", "you idiot, you moron", "you idoit, you mroon", None]), model).collect()}
    assert found[0] > found[5] and found[1] == found[5] and found[3] > found[5] and found[4] > found[5]


def test_licence_templates_match_themselves_and_small_changes(spark, documents):
    texts = [t for _, t in licenses.TEMPLATES] + ["x " + licenses.TEMPLATES[1][1].replace("compliance", "accord"), "all rights"]
    found = {r["doc_id"]: r for r in licenses.scan(documents(texts)).collect()}
    for i, (name, _) in enumerate(licenses.TEMPLATES):
        assert name in found[i]["licences"].split(",") and found[i]["best"] == 1.0
    assert "Apache-2.0" in found[len(texts) - 2]["licences"] and found[len(texts) - 1]["n_units"] == 0


def test_wrapped_and_commented_licences_are_found_inside_files(spark, documents):
    import textwrap

    full = {name: max((t for n, t in licenses.TEMPLATES if n == name), key=len) for name, _ in licenses.TEMPLATES}
    code = "\n".join(f"value_{i} = compute(value_{i - 1}, {i})" for i in range(1, 300))
    texts, names = [], []
    for name, text in full.items():
        for mark, width in (("# ", 72), (" * ", 50), ("", 300)):
            notice = "\n".join(mark + line for line in textwrap.wrap(" ".join(text.split()), width))
            texts.append(f"{mark}Copyright (c) 2019 A. Holder\n{notice}\n{code}\nend")
            names.append(name)
    texts += [code, "the software is provided to any person who has a copy of the notice", "a " * 5000]
    found = {r["doc_id"]: r for r in licenses.scan(documents(texts)).collect()}
    for i, name in enumerate(names):
        assert name in found[i]["licences"].split(",") and found[i]["best"] >= 0.9, (name, i, found[i])
    assert all(found[i]["licences"] == "" for i in range(len(names), len(texts)))


@pytest.mark.parametrize("share", [0.02, 0.05, 0.08, 0.1])
def test_no_window_above_the_threshold_is_missed(spark, documents, share):
    """Notices in one line of other words, some of theirs replaced: named wherever a window of the template's length matches, and counted as a plain scan does."""
    rnd = random.Random(int(share * 100))
    templates = [(n, t) for n, t in licenses.TEMPLATES if 18 <= len(licenses.normal_words(t)) <= 120]
    texts, wanted = [], []
    for name, text in [rnd.choice(templates) for _ in range(60)]:
        own = [rnd.choice(("changed", "other", "software")) if rnd.random() < share else w for w in licenses.normal_words(text)]
        words = passage(rnd, rnd.randint(0, 60)).split() + own + passage(rnd, rnd.randint(0, 60)).split()
        texts.append(" ".join(words))
        matches, grams = 0, set(licenses.template_bigrams(text))
        n = len(own)
        for at in range(max(1, len(words) - n + 1)):
            d = {f"{a} {b}" for a, b in zip(words[at : at + n], words[at + 1 : at + n], strict=False)}
            matches += 2 * len(d & grams) >= 0.8 * (len(d) + len(grams)) - 1e-12 and len(d) <= 1.5 * len(grams) and 1.5 * len(d) >= len(grams)
        wanted.append((name, matches))
    found = {r["doc_id"]: r for r in licenses.scan(documents(texts), templates).collect()}
    assert sum(m > 0 for _, m in wanted) > 20
    for i, (name, matches) in enumerate(wanted):
        assert (name in found[i]["licences"].split(",")) or not matches, (i, name, matches)
    # Alone, a template has just as many windows as the plain scan counts.
    name, text = templates[0]
    own = [(i, t, m) for i, (t, (n, m)) in enumerate(zip(texts, wanted, strict=True)) if n == name and [x for x, _ in templates].count(name) == 1]
    for (_, _, m), r in zip(own, licenses.scan(documents([t for _, t, _ in own]), [(name, text)]).orderBy("doc_id").collect(), strict=True):
        assert r["n_windows"] == m


def test_archives_are_zip_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a" * 150), (2, "v", "a" * 150), (3, "w", "b")], "page_id long, url string, html string").coalesce(1)
    archive = warc.write_archives(warc.plan(pages).coalesce(1), f"file://{tmp_path}/z").first()["archive"]
    with zipfile.ZipFile(archive.removeprefix("file://")) as z:
        assert z.namelist() == [warc.DATA, warc.INDEX] and z.testzip() is None
        assert len(z.read(warc.INDEX).splitlines()) == 3
    assert {r[0]: (r[3], r[4]) for r in warc.read_archive(archive)} == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None)}


def test_zip64_directory():
    """A central directory whose sizes and offset are only in ZIP64 fields."""
    name, data = b"m", b"stored bytes"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 0) + name + data
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(local) + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    whole = local + central + end64 + locator + end
    entries = warc.directory(io.BytesIO(whole), len(whole))
    at, n = warc.stored(io.BytesIO(whole), entries["m"])
    assert whole[at : at + n] == data


def test_media_rows_point_into_tar_shards(spark, documents, tmp_path):
    import tarfile

    texts = ["abc", "abc", "", "y" * 1000]
    rows = media.store(documents(texts).coalesce(1), f"file://{tmp_path}/t").collect()
    (shard,) = {r["shard"] for r in rows}
    with tarfile.open(shard.removeprefix("file://")) as tar:
        members = {m.name.split("/")[1][:-4]: tar.extractfile(m).read() for m in tar}
    assert set(members) == {r["digest"] for r in rows} and len(members) == 3
    for r, t in zip(sorted(rows, key=lambda r: r["doc_id"]), texts, strict=True):
        assert media.from_png(members[r["digest"]]).tobytes().rstrip(b" ") == t.encode()


def test_lm_gradient_and_scores():
    rnd, side = np.random.default_rng(1), 8
    ids = rnd.integers(0, side * side, 30)
    near = lm.windows(ids, np.array([10, 0, 20]), side * side)
    assert near[0, 10] == near[1, 10] == near[2, 9] == side * side and near[1, 11] == ids[10] and near[2, 11] == ids[12]
    net = lm.start(side)
    h = np.tanh(net["bias"] + sum(net["near"][p][near[p, 4]] for p in range(2 * lm.SIDE)))
    c, m = divmod(int(ids[4]), side)
    top, low = h @ net["classes"] + net["class_bias"], h @ net["members"][c] + net["member_bias"][c]
    wanted = top[c] - np.log(np.exp(top).sum()) + low[m] - np.log(np.exp(low).sum())
    assert abs(lm.log_probs(net, ids, near)[4] - wanted) < 1e-4
    every = lm.log_probs(net, np.arange(side * side), np.repeat(near[:, 4:5], side * side, axis=1))
    assert abs(np.exp(every).sum() - 1) < 1e-4
    seen = {k: np.zeros_like(v) for k, v in net.items()}
    before = lm.log_probs(net, ids, near).mean()
    for _ in range(20):
        lm.step(net, seen, ids, near)
    assert lm.log_probs(net, ids, near).mean() > before + 0.5


def plain_lm(texts, lexicon, net):
    """Each text's sum by dictionaries of whole contexts, a token at a time."""
    split = [(t or "").encode().lower().split() for t in texts]
    triples, contexts = Counter(), Counter()
    framed = [[None, *w, None] for w in split]
    for w in framed:
        for i in range(1, len(w) - 1):
            triples[w[i - 1], w[i], w[i + 1]] += 1
            contexts[w[i - 1], w[i + 1]] += 1
    out = []
    for w, f in zip(split, framed, strict=True):
        ids = [lexicon.ids[x] if x in lexicon.ids else int(lexicon.rest[xxhash.xxh3_64_intdigest(x) % len(lexicon.rest)]) for x in w]
        lp = lm.log_probs(net, np.array(ids, np.int64), lm.windows(np.array(ids, np.int64), np.array([len(ids)]), lexicon.side**2)) if w else []
        total = 0.0
        for i, x in enumerate(w):
            spelled = 0.0
            if x not in lexicon.ids:
                chain = b"\n" + x + b"\n"
                spelled = math.log(len(lexicon.rest)) + sum(float(lexicon.spelled[a, z]) for a, z in zip(chain, chain[1:], strict=False))
            c, n = triples[f[i], x, f[i + 2]] - 1, contexts[f[i], f[i + 2]] - 1
            p = lp[i] + spelled
            total += math.log((c + lm.PRIOR * math.exp(p)) / (n + lm.PRIOR)) if c else p - math.log((n + lm.PRIOR) / lm.PRIOR)
        out.append(total)
    return out


@pytest.mark.parametrize(("flush", "bucket"), [(1_000_000, 1_000_000), (700, 900)])
def test_lm_scores_equal_a_plain_pass(spark, documents, flush, bucket):
    rnd = random.Random(5)
    texts = [passage(rnd, rnd.randint(1, 120)) for _ in range(60)]
    texts += [texts[3]] * 12 + [texts[4]] + [None, "", " \n", "zzqx" * 5000, "Unïq " + texts[5], "one"]
    docs = documents(texts).repartition(3)
    lexicon, total = lm.learn_lexicon(docs)
    seen = Counter(w for t in texts for w in (t or "").encode().lower().split())
    assert total == sum(seen.values()) and lexicon.known == sorted(seen, key=lambda w: (-seen[w], w))[: len(lexicon.known)]
    net = lm.train(docs, lexicon, total)
    found = {r["doc_id"]: r for r in lm.score(docs, lexicon, net, total, flush, bucket).collect()}
    assert len(found) == len(texts)
    for i, wanted in enumerate(plain_lm(texts, lexicon, net)):
        n = len((texts[i] or "").split())
        assert found[i]["n_tokens"] == n and abs(found[i]["log_prob"] - wanted) <= 0.001 * abs(wanted) + 1e-3
        assert found[i]["mean_log_prob"] == (found[i]["log_prob"] / n if n else 0)
    # A text that occurs elsewhere too is likelier than others.
    others = [found[i]["mean_log_prob"] for i in range(60) if i not in (3, 4, 5) and found[i]["n_tokens"] > 20]
    assert min(found[3]["mean_log_prob"], found[4]["mean_log_prob"]) > max(others)


def test_lm_network_does_not_depend_on_partitions(spark, documents, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 2000)  # several shards
    rnd = random.Random(6)
    docs = documents([passage(rnd, 100) for _ in range(80)])
    nets = []
    for n in (1, 5):
        nets.append(lm.flat(lm.train(docs.repartition(n), lm.learn_lexicon(docs.repartition(n))[0], 8000)))
    assert np.array_equal(*nets)


def test_boosted_trees_on_new_examples():
    model = pii.train()
    made = pii.examples(random.Random(99), 2000)
    x, y = np.array([f for f, _ in made], float), np.array([t for _, t in made])
    p = model.probability(x)
    chosen = p >= np.array([model.thresholds[int(k)] for k in x[:, 0]])
    assert (y[chosen] == 1).mean() > 0.95 and chosen[y == 1].mean() > 0.8
    assert abs(p.mean() - y.mean()) < 0.03  # calibrated


def test_redaction_replaces_spans():
    text = "write to a.b@c.org or (605) 555-9305 now"
    (found,) = pii.find([text], pii.train())
    assert re.fullmatch(r"write to \[EMAIL\] or \[PHONE\] now", pii.redact_text(text, found))


def test_redaction_counts_characters_whatever_the_case_of_their_column(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c-d.org now", 20), (2, None, 7)], "doc_id long, text string, N_CHARS long")
    assert [tuple(r) for r in pii.redact(docs).orderBy("doc_id").collect()] == [(1, "mail [EMAIL] now", 16), (2, None, 7)]


def test_spans_of_one_text_are_found_in_time_by_their_number():
    import time

    text = " ".join(f"write to user{i} at host{i} dot com or a{i}.b@mail.org now" for i in range(10_000))
    began = time.time()
    (found,) = pii.find([text], pii.train())
    assert len(found) >= 20_000 and time.time() - began < 60
    ends = [0]
    for s in found:
        assert s["start"] >= ends[-1]
        ends.append(s["end"])


def test_taken_stretches_stay_apart():
    rnd = random.Random(3)
    for _ in range(200):
        first = [(a, a + rnd.randint(1, 6)) for a in rnd.sample(range(60), 4)]
        taken, plain = pii.Taken(first), set(i for a, z in first for i in range(a, z))
        for _ in range(20):
            a = rnd.randrange(60)
            z = a + rnd.randint(1, 5)
            free = plain.isdisjoint(range(a, z))
            assert taken.add(a, z) == free
            plain |= set(range(a, z)) if free else set()


def test_small_sources_meet_their_targets(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(n)), s) for i, (n, s) in enumerate([(20, "tiny"), (40, "less"), (100, "some"), *[(rnd.randint(1, 400), "big") for _ in range(300)]])]
    found = mixing.allocate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target, size = Counter(), {}, Counter()
    for r in found:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        size[r["source"]] += r["size"]
    for s in size:
        assert abs(taken[s] - target[s]) <= max(1, min(64, size[s] / 64)), s


def test_secrets_of_the_tables_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = {r["doc_id"]: len(re.findall(r'token = "[0-9a-f]{40}"', r["text"] or "")) for r in docs.select("doc_id", "text").collect()}
    found = {r["doc_id"]: r["n_secret"] for r in pii.digest(docs).collect()}
    wanted = {i for i, n in planted.items() if n}
    assert len(wanted) > 5 and sum(found[i] >= planted[i] for i in wanted) >= 0.95 * len(wanted)
    assert sum(found[i] > 0 for i in planted if i not in wanted) <= 0.01 * len(planted)


def test_media_features_equal_plain_ones(spark, documents, tmp_path):
    texts = ["abc", "", "x" * 500, "Ünïcödé 你好 " * 40]
    for r in media.round_trip(documents(texts)).collect():
        raw = texts[r["doc_id"]].encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        n, mean = len(payload), sum(payload) / len(payload)
        share = [payload.count(b) / n for b in set(payload)]
        deviation, step = math.sqrt(sum((b - mean) ** 2 for b in payload) / n), sum(abs(a - b) for a, b in zip(payload, payload[1:], strict=False)) / (n - 1)
        assert r["feature"] == f"mean={mean:.4f};deviation={deviation:.4f};entropy={-sum(p * math.log2(p) for p in share):.4f};step={step:.4f}"
        image = media.to_png(payload)
        assert (r["media_bytes"], r["media_sha256"], r["width"], r["height"]) == (len(image), brute.hashlib.sha256(image).hexdigest(), 192, n // 192)
