"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon holds a few plain insults and the terms learned from labelled
rows: words, and stems at a word's start, that occur in several toxic documents
and hardly in clean ones. Each distinct word whose deletions meet those of a
term walks the lexicon's trie together with the Levenshtein automaton of the word
(its rows are the automaton's states; numpy steps many words at once) from the
trie's root, so misspelled terms are found within the edits that the term's
length allows, wherever the edits are; a variant that is itself a common clean
word does not count. Two words within d edits of each other have a string in
common that leaves d or fewer letters out of each, so the words that don't walk
have no match. Terms of more than ``FUZZY`` letters are matched as they stand only;
quotations of more than ``QUOTATION`` words count as plain text. Terms that a stem covers are in the trie too, for edits inside the
stem. For each hit a window of words around it tells quotation (between quotes,
words of saying or of discussing language) from abuse (second person, more hits).
A logistic model over the document's hit counts gives the score.

Null and empty texts score as texts without a hit; long texts are scored whole.
A document's score depends on its text alone, so ties and repeated rows score
alike; an empty table gives no rows. Rows without a label, or held out, never
shape the model; if nothing is labelled, the model is the plain lexicon's with
default weights. Other columns are kept; helper columns step aside for them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_at, let, maybe_broadcast, mix, small_batches, stage, tidy

# Plain insults that seed the lexicon.
SEED_TERMS = (
    "idiot", "idiots", "idiotic", "imbecile", "moron", "morons", "moronic", "stupid", "loser", "losers",
    "pathetic", "worthless", "disgusting", "scum", "scumbag", "trash", "clown", "garbage", "filth", "vermin",
    "dumbass", "bastard", "asshole", "retard", "freak", "degenerate", "pig", "parasite", "subhuman", "cretin",
)
# Words that tell that a term is spoken about.
SAYING = frozenset("say says said saying call called calls calling quote quotes quoted wrote writes written term terms word words means mean meaning phrase dictionary insult insults slur sagt sagte wort dit mot mots dijo dice palabra".split())
# Words that address a reader.
ADDRESS = frozenset("you your you're youre u ur du dein ihr euch tu te ton vous votre eres usted vosotros".split())
QUOTES = "\"'`«»‘’“”„"
EDGE = ".,;:!?()[]{}<>*_-…¿¡/\\|~" + QUOTES
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
LEET = str.maketrans("013457@$!|", "oleastasil")

#: Words on each side of a hit, words that a quotation has at most; labelled rows of a class used at most to learn.
WINDOW, QUOTATION, FIT_ROWS = 8, 60, 5_000
#: For a learned term: largest share of clean documents, least share of toxic ones, and false terms expected.
MOST_CLEAN, LEAST_PURITY, CHANCE = 0.002, 0.95, 0.5
#: Characters of learned stems.
STEMS = (4, 5, 6, 7)
#: Letters of a term that misspelled words are looked for of; longer ones are found as they stand. Rows of automata hold numbers to 127.
FUZZY = 60
#: Words whose verdict a worker remembers, characters of the texts whose words are looked up at once, words that walk side by side.
MEMO, RUN_CHARS, ABREAST = 200_000, 2_000_000, 8_192
#: Bits of a filter's address, and the multiplier of its string hashes.
FILTER_BITS, MULTIPLIER = 24, 0x9E3779B97F4A7C15


def edits_allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


def letters_of(words: list[str], width: int) -> np.ndarray:
    return np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)


def deletions(letters: np.ndarray, most: int):
    """Hashes of the words (a row each, of one length) without up to ``most`` (0 to 2) letters, some variants at a time."""
    n, width = letters.shape
    power = np.multiply.accumulate(np.append(np.uint64(1), np.full(width, MULTIPLIER, np.uint64)))
    value = mix(letters.astype(np.uint64) + np.uint64(0x1F3D))

    def sums(gone: int):
        """Sum of the letters before each place, each where it stands once ``gone`` letters before it are."""
        out = np.zeros((n, width + 1), np.uint64)
        np.cumsum(value[:, gone:] * power[: max(0, width - gone)], axis=1, out=out[:, gone + 1 :])
        return out

    at = [sums(k) for k in range(most + 1)]
    yield at[0][:, -1:]
    if most:
        yield at[0][:, :-1] + at[1][:, -1:] - at[1][:, 1:]
    if most == 2:
        for i in range(width - 1):
            yield (at[0][:, i] - at[1][:, i + 1] + at[2][:, -1])[:, None] + at[1][:, i + 1 : -1] - at[2][:, i + 2 :]


class Near:
    """What is left of the terms of some length without up to ``edits`` letters, to look words up in."""

    def __init__(self, terms: list[str], edits: int):
        self.edits, self.lengths = edits, {n for t in terms for n in range(len(t) - edits, len(t) + edits + 1)}
        found = [np.unique(h) for n in {len(t) for t in terms} for h in deletions(letters_of([t for t in terms if len(t) == n], n), edits)]
        self.hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))
        self.bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
        at = self.hashes >> np.uint64(64 - FILTER_BITS)
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))

    def meets(self, letters: np.ndarray) -> np.ndarray:
        """Which words (rows of one length) have something in common with a term."""
        hit = np.zeros(len(letters), bool)
        for h in deletions(letters, self.edits):
            at = h >> np.uint64(64 - FILTER_BITS)
            maybe = (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            row, column = np.nonzero(maybe)
            if len(row):
                wanted = h[row, column]
                place = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
                hit[row[self.hashes[place] == wanted]] = True
        return hit


@dataclass
class Lexicon:
    """Terms and stems, the terms' trie, and the clean words that no fuzzy match may claim."""

    terms: tuple[str, ...]
    stems: tuple[str, ...]
    clean: frozenset[str]
    trie: dict = field(default_factory=dict)
    known: set = field(default_factory=set)
    hits: dict = field(default_factory=dict)

    def __post_init__(self):
        fuzzy = [t for t in self.terms if len(t) <= FUZZY]
        for term in fuzzy:
            node = self.trie
            for c in term:
                node["most"] = max(node.get("most", 0), edits_allowed(len(term)))
                node = node.setdefault(c, {})
            node["term"] = term
            node["most"] = max(node.get("most", 0), edits_allowed(len(term)))
        self.plain, self.begin = frozenset(self.terms), frozenset(self.stems)
        self.near = [Near([t for t in fuzzy if edits_allowed(len(t)) == e], e) for e in (1, 2)]
        self.longest = max(map(len, fuzzy), default=0) + 2
        self.shortest = min((len(t) - edits_allowed(len(t)) for t in fuzzy if edits_allowed(len(t))), default=self.longest + 1)

    def learn_words(self, tokens: set[str]) -> None:
        """Find out which of the tokens are hits: ``hits`` has 1 for a term or stem as it stands, 2 for a misspelled term."""
        if len(self.known) > MEMO:
            self.known, self.hits = set(), {}
        new = list(tokens - self.known)
        self.known.update(new)
        bare = [w.strip(EDGE) for w in new]
        fuzzy: dict[str, list[str]] = {}
        for token, word in zip(new, bare, strict=True):
            if self.exact(word):
                self.hits[token] = 1
            elif len(word) >= self.shortest and word not in self.clean:
                plain = word if word.isalpha() else word.translate(LEET)
                if plain is not word and 2 * sum(map(str.isalpha, word)) < len(word):
                    continue
                if plain != word and self.exact(plain):
                    self.hits[token] = 2
                elif len(plain) <= self.longest:
                    fuzzy.setdefault(plain, []).append(token)
        for word in self.misspelled(self.reachable(list(fuzzy))):
            for token in fuzzy[word]:
                self.hits[token] = 2

    def exact(self, word: str) -> bool:
        return word in self.plain or not self.begin.isdisjoint([word[:k] for k in STEMS])

    def reachable(self, words: list[str]) -> list[str]:
        """The words that may be within the allowed edits of a term; no match is left out."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        found: list[str] = []
        for n, own in by_length.items():
            tried = [x for x in self.near if n in x.lengths]
            for a in range(0, len(own) if tried else 0, ABREAST):
                run = own[a : a + ABREAST]
                letters = letters_of(run, n)
                hit = np.any([x.meets(letters) for x in tried], axis=0)
                found += [run[i] for i in np.flatnonzero(hit)]
        return found

    def misspelled(self, words: list[str]) -> list[str]:
        """The words within the allowed edits of a term: the words' automata walk the trie side by side,
        a row of each for each node; a word leaves where its state is dead. The term's length tells the edits."""
        found: list[str] = []
        words = sorted(words, key=len)
        for a in range(0, len(words), ABREAST):
            own = words[a : a + ABREAST]
            width = max(map(len, own))
            lengths = np.array([len(w) for w in own])
            hit = np.zeros(len(own), bool)
            row = np.arange(width + 1, dtype=np.int8)[None].repeat(len(own), axis=0)
            self.walk(np.arange(len(own)), row, letters_of(own, width), lengths, hit)
            found += [own[i] for i in np.flatnonzero(hit)]
        return found

    def walk(self, at, row, letters, lengths, hit) -> None:
        """``row[k, i]``: edits (swaps of neighbours count as one) from the trie's path to the first i letters of word ``at[k]``."""
        steps = np.arange(row.shape[1], dtype=np.int8)
        open_: list[tuple] = [(self.trie, at, row, None, "")]
        while open_:
            node, at, row, above, last = open_.pop()
            term = node.get("term")
            if term is not None:
                hit[at[row[np.arange(len(at)), lengths[at]] <= edits_allowed(len(term))]] = True
            for c, child in node.items():
                if len(c) > 1:
                    continue
                same = letters[at] == ord(c)
                new = row + np.int8(1)
                np.minimum(new[:, 1:], row[:, :-1] + ~same, out=new[:, 1:])
                if above is not None:
                    swapped = same[:, :-1] & (letters[at, 1:] == ord(last))
                    np.minimum(new[:, 2:], np.where(swapped, above[:, :-2] + np.int8(1), np.int8(99)), out=new[:, 2:])
                new = np.minimum.accumulate(new - steps, axis=1) + steps
                live = np.flatnonzero((new.min(axis=1) <= child["most"]) & ~hit[at])
                if len(live):
                    open_.append((child, at[live], new[live], row[live], c))


FEATURES = ("hits", "exact", "fuzzy", "quoted", "saying", "address", "crowded", "any")
NOT_QUOTES = EDGE.translate({ord(q): None for q in QUOTES})


def quotations(tokens: list[str]) -> set[int]:
    """Places between quotes: from a word that begins with one to the next that ends with one, QUOTATION words or fewer."""
    inside: set[int] = set()
    begun = None
    for i, w in enumerate(tokens):
        if w[0] in QUOTES or w.lstrip(NOT_QUOTES)[:1] in QUOTES and w.strip(EDGE):
            begun = i
        if begun is not None and w.rstrip(NOT_QUOTES)[-1:] in QUOTES and (i > begun or len(w) > 1 and w.strip(EDGE)):
            if i - begun < QUOTATION:
                inside.update(range(begun, i + 1))
            begun = None
    return inside


def features(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """Counts of hits by kind and context, a row a document, on a log scale."""
    out = np.zeros((len(texts), len(FEATURES)))
    split = [(t or "").lower().split() for t in texts]
    lexicon.learn_words(set().union(*split))
    hits = lexicon.hits
    for k, tokens in enumerate(split):
        if hits.keys().isdisjoint(tokens):
            continue
        between = quotations(tokens)
        for i, w in enumerate(tokens):
            if w not in hits:
                continue
            around = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
            near = [x.strip(EDGE) for x in around]
            out[k] += (1, hits[w] == 1, hits[w] == 2, i in between, any(x in SAYING for x in near), any(x in ADDRESS for x in near), sum(x in hits for x in around) > 1, 0)
            out[k, -1] = 1
    out[:, :-1] = np.log1p(out[:, :-1])
    return out


def grouped(texts: list[str | None]):
    """Places in the list, run by run of at most RUN_CHARS characters or one text."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > RUN_CHARS and i > a:
            yield a, i
            a, size = i, len(t or "")
    if a < len(texts):
        yield a, len(texts)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.concatenate([np.zeros((0, len(FEATURES))), *(features(texts[a:z], self.lexicon) for a, z in grouped(texts))])
        return 1 / (1 + np.exp(-(x @ self.weights + self.bias)))


#: Used where no labels are given: abuse pulls up, quotation down.
DEFAULT = np.array([0.5, 2.0, 1.0, -3.0, -2.0, 0.5, 0.5, 2.0]), -3.0


def learn(rows: DataFrame) -> Model:
    """A model from labelled rows ``(text, label)`` such as ``training_rows`` chooses."""
    spark = rows.sparkSession
    rows = stage(spark, rows.select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label")).filter(F.col("label").isin(0, 1)), "toxic-rows")
    used = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not used.get(1) or not used.get(0):
        return Model(Lexicon(SEED_TERMS, (), frozenset()), *DEFAULT)

    bare = F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, EDGES, ""))
    listed = rows.select("label", F.array_distinct(F.filter(bare, lambda w: F.length(w) >= 3)).alias("words"))
    listed = stage(spark, listed, "toxic-sample")
    stem = lambda k: F.transform(F.filter("words", lambda w: F.length(w) > k), lambda w: F.substring(w, 1, k))
    stems_of = [stem(k) for k in STEMS]
    counts = [F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")]
    by_word = listed.select("label", F.explode("words").alias("term")).groupBy("term").agg(*counts)
    # A stem counts where three or more of a text's words share it.
    repeated = let(F.sort_array(F.concat(*stems_of)), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 1) & (x == F.get(s, i - 2)))))
    by_stem = listed.select("label", F.explode(repeated).alias("term")).groupBy("term").agg(*counts)
    by_word, by_stem = stage(spark, by_word, "toxic-words"), stage(spark, by_stem, "toxic-stems")
    best = [F.desc("toxic"), F.length("term"), "term"]

    base = used[1] / (used[0] + used[1])

    def good(found: DataFrame) -> list:
        """Terms that chance would hardly give: with its documents' labels dealt at random, less
        than one in CHANCE terms of about its frequency would be as toxic."""
        n, t, c = F.col("toxic") + F.col("clean"), F.col("toxic") / used[1], F.col("clean") / used[0]
        tried = {r["n"]: r["count"] for r in found.groupBy(n.alias("n")).count().collect()}
        like = {k: sum(x for m, x in tried.items() if k <= m <= 2 * k) for k in tried}
        # The classes weighed alike. What is collected are words of at most 2 x FIT_ROWS texts.
        pure = found.filter((F.col("toxic") >= 2) & (F.col("clean") <= MOST_CLEAN * used[0]) & (t / (t + c) >= LEAST_PURITY))
        rows = pure.orderBy(*best).toArrow().to_pylist()
        return [r for r in rows if like[r["toxic"] + r["clean"]] * math.comb(r["toxic"] + r["clean"], r["clean"]) * base ** r["toxic"] < CHANCE]

    words_found = good(by_word)
    most_of: dict[str, int] = {}
    for r in by_word.filter("toxic >= 2").select("term", "toxic").toArrow().to_pylist():
        for k in STEMS:
            most_of[r["term"][:k]] = max(most_of.get(r["term"][:k], 0), r["toxic"])
    stems: list[str] = []
    for r in sorted(good(by_stem), key=lambda r: (len(r["term"]), -r["toxic"], r["term"])):
        # A stem is learned where many words share it, not where one word does.
        if most_of.get(r["term"], 0) <= 0.8 * r["toxic"] and not r["term"].startswith(tuple(stems)):
            stems.append(r["term"])
    terms = tuple(dict.fromkeys([*SEED_TERMS, *(r["term"] for r in words_found)]))
    # Of the clean words, those matter that would pass for a misspelled term.
    clean = by_word.filter("clean >= 2 and clean > toxic").filter(F.length("term") >= 4).select("term").toArrow()["term"].to_pylist()
    lexicon = Lexicon(terms, tuple(stems), frozenset())
    lexicon.learn_words(set(clean))
    lexicon = Lexicon(terms, tuple(stems), frozenset(w for w in clean if lexicon.hits.get(w) == 2))

    shared = spark.sparkContext.broadcast(lexicon)

    @tidy()
    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            x = np.concatenate([np.zeros((0, len(FEATURES))), *(features(texts[a:z], shared.value) for a, z in grouped(texts))])
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), b.column(1)], names=["x", "label"])

    seen = rows.mapInArrow(run, "x array<double>, label int").groupBy("x", "label").count().collect()
    x, y, n = np.array([r["x"] for r in seen]), np.array([r["label"] for r in seen], float), np.array([r["count"] for r in seen], float)
    return Model(lexicon, *fit_logistic(x, y, n))


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Newton steps on the ridge-penalised likelihood, both classes weighed alike."""
    weight = np.where(y == 1, n / max(1, n[y == 1].sum()), n / max(1, n[y == 0].sum())) * 100
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (weight * p * (1 - p))[:, None]).T @ x1 + penalty, x1.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """The rows of ``docs`` with a score from 0 to 1 for each whole text, in a column that ``docs`` must not have."""
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the rows have a column {out} already")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = column_at(docs, "text")

    @tidy()
    def run(batches):
        m = shared.value
        for b in batches:
            scores = m.scores(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{out}` double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts and labels of the rows that may be learned from; copies of an id with differing labels count as each.

    At most about ``FIT_ROWS`` labels of each class are used, chosen by a hash of
    the id before any text is read; with fewer labels all are.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"))).distinct()
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, F.lit(min(1.0, FIT_ROWS / sizes.get(1, 1)))).otherwise(F.lit(min(1.0, FIT_ROWS / sizes.get(0, 1))))
    known = known.filter(F.pmod(F.xxhash64(F.lit(3), "_id"), F.lit(1_000_000)) < share * 1_000_000)
    return docs.select("doc_id", "text").join(maybe_broadcast(known), F.col("doc_id") == F.col("_id")).select("text", "label")
