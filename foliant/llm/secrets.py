"""Secret scan: character Markov models of random strings and of ordinary ones.

Base spans follow fixed patterns and always stay. Candidates for further ones are
runs of ``LEAST`` or more key characters, and shorter values after words such as
``pwd:`` or ``bearer``. Each is scored by the logarithm of the ratio of its
likelihoods under the models of random strings (one for each alphabet that keys
are written in) and under those of ordinary ones (identifiers, paths, numbers,
lines of one sign); a naming word before it adds a prior. Those above a threshold
become spans of kind ``random``, two with but a dot between them one. Ids in the
form 8-4-4-4-12 are public by their nature and no candidates.

A model has the probability of a character after the two before it, smoothed by
shorter contexts down to the sort of the last one (upper case, lower case, digit);
``UNSEEN`` of it is for words spelled like none seen, so by that sort alone. It is trained on labelled samples: seeded random strings, and
identifiers made of words that documents hold. Words come from the ``FIT_DOCS``
documents whose ids have the least hashes, ``FIT_WORDS`` of them at most; that is the
only bound, all else is done on every whole text. A third of the samples sets the
threshold: half way between what ``TAIL`` of the random ones fall short of and what
``TAIL`` of the ordinary ones exceed.

Null and empty texts have no span; long texts are searched whole, in time by their
length, and a run of any length is one candidate. Positions are code points,
ends exclusive. Added spans never overlap base ones. Rows are independent;
repeated rows give repeated spans, an empty table none. ``redact`` keeps all
other columns, ``spans`` drops them.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_at, gather, small_batches
from .pii import Taken, redact_text

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(?ai:(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+))")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters of a value after ``password =`` at least, of a run without and with a naming word.
LEAST_VALUE, LEAST, LEAST_NAMED = 6, 16, 8


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind's pattern that are long enough."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
NAMED = re.compile(
    r"(?ai:(?<![a-z0-9])(?:pwd|pass(?:word|wd|phrase)?|auth(?:orization)?|credentials?|private|secret|session|signature|sig|access|api|client|token|key)(?:[_-]?(?:key|token|secret|id|hash))?[\"']?\x20{0,3}[:=]\x20{0,3}[\"']?|\b(?:bearer|basic)\x20{1,3})"
    rf"([A-Za-z0-9+/_-]{{{LEAST_NAMED},}}={{0,2}})"
)
UNIQUE = re.compile(r"(?ai:[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})")


def candidates(text: str) -> list[tuple[int, int, bool]]:
    """``(start, end, whether a naming word stands before)`` of what may be a secret; letters of other scripts bound no run."""
    found = {m.span(): False for m in RUN.finditer(text)}
    if ":" in text or "=" in text or "earer" in text or "asic" in text:
        found |= {m.span(1): True for m in NAMED.finditer(text)}
    free = [(a, z, named) for (a, z), named in sorted(found.items()) if not (a and text[a - 1].isalnum()) and not text[z : z + 1].isalnum()]
    return [c for c in free if c[1] - c[0] != 36 or not UNIQUE.fullmatch(text, *c[:2])]


# Models -----------------------------------------------------------------------

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
SIGNS = "+/_=-"
#: Codes: 0 bounds a string, the last is any other character.
ALPHABET = UPPER + LOWER + DIGITS + SIGNS
SIZE = len(ALPHABET) + 2
CODES = np.full(128, SIZE - 1, np.int64)
CODES[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)
#: Each code's sort: an upper-case letter, a lower-case one, a digit, or any other.
SORTS = np.array([3, *[0] * 26, *[1] * 26, *[2] * 10, *[3] * (len(SIGNS) + 1)])
#: Labels of random strings, with the characters they are made of; the other labels are of ordinary ones.
RANDOM = {
    "hex": DIGITS + "abcdef", "upper hex": DIGITS + "ABCDEF", "base32": UPPER + "234567", "base36": LOWER + DIGITS, "upper base36": UPPER + DIGITS,
    "base62": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/", "url-safe base64": UPPER + LOWER + DIGITS + "-_",
}
ORDINARY = ("identifier", "path", "number", "line")
SMOOTH, UNSEEN, TAIL, FIT_DOCS, FIT_WORDS, FIT_SAMPLES, NAMED_PRIOR = 2.0, 0.3, 0.005, 1000, 20_000, 1500, 8.0
#: Words to go on with where documents have none.
SEED_WORDS = ("user", "name", "config", "file", "index", "value", "data", "result", "get", "set", "update", "list", "item", "default", "service", "request", "handler", "number", "total", "page", "version", "build", "local", "server", "main", "test", "module", "count", "length", "buffer")


def flat_codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all strings, each with two bounds before it and one behind, and their lengths so."""
    raw = np.frombuffer("".join(f"\x00\x00{s}\x00" for s in strings).encode("utf-32-le"), np.uint32)
    codes = np.where(raw < 128, CODES[np.minimum(raw, 127)], SIZE - 1)
    codes[raw == 0] = 0
    return codes, np.fromiter((len(s) + 3 for s in strings), np.int64, len(strings))


def contexts(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all (two before, character), string by string, and where each string's begin."""
    codes, lengths = flat_codes(strings)
    triples = (codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:]
    starts = np.cumsum(lengths) - lengths
    return gather(triples, starts, lengths - 2), np.cumsum(lengths - 2) - (lengths - 2)


def chain(strings: list[str]) -> np.ndarray:
    """Log probabilities of every (two before, character)."""
    n3 = np.bincount(contexts(strings)[0], minlength=SIZE**3).reshape(SIZE, SIZE, SIZE).astype(float)
    n2 = n3.sum(axis=0)
    after = np.stack([n2[SORTS == k].sum(axis=0) for k in range(4)]) + 0.5  # a character after any of a sort
    p1 = (after / after.sum(axis=1, keepdims=True))[SORTS]
    p2 = (n2 + SMOOTH * p1) / (n2.sum(axis=1, keepdims=True) + SMOOTH)
    p3 = (n3 + SMOOTH * p2) / (n3.sum(axis=2, keepdims=True) + SMOOTH)
    return np.log((1 - UNSEEN) * p3 + UNSEEN * p1).astype(np.float32).ravel()


@dataclass
class Model:
    """A chain for each label, those of random strings first, and the least score of a secret."""

    chains: list[np.ndarray]
    randoms: int
    threshold: float = 0.0

    def score(self, strings: list[str]) -> np.ndarray:
        """Log ratio of a string's mean likelihoods under the random and the ordinary models."""
        triples, starts = contexts(strings)
        logs = np.stack([np.add.reduceat(c[triples].astype(float), starts) for c in self.chains])
        mean = lambda part: np.logaddexp.reduce(part, axis=0) - np.log(len(part))
        return mean(logs[: self.randoms]) - mean(logs[self.randoms :])


def learn(samples: list[tuple[str, str]]) -> Model:
    """Models from ``(string, label)``; labels in ``RANDOM`` are of random strings. Every third sample of a label sets the threshold."""
    by_label: dict[str, list[str]] = {}
    for text, label in samples:
        by_label.setdefault(label, []).append(text)
    order = sorted(by_label, key=lambda label: (label not in RANDOM, label))
    model = Model([chain([s for i, s in enumerate(by_label[label]) if i % 3]) for label in order], sum(label in RANDOM for label in order))
    held = lambda random: [s for label in order if (label in RANDOM) == random for s in by_label[label][::3]]
    secret = np.sort(model.score([s for s in held(True) if len(s) >= LEAST]))
    ordinary = np.sort(model.score(held(False)))
    model.threshold = max(0.0, float(secret[int(len(secret) * TAIL)] + ordinary[int(len(ordinary) * (1 - TAIL))]) / 2)
    return model


def samples(words: list[str], n: int = FIT_SAMPLES, seed: int = 12) -> list[tuple[str, str]]:
    """``n`` strings of each label; identifiers and paths are made of the words."""
    rnd, words = random.Random(seed), [*words, *SEED_WORDS]
    digits = lambda k: "".join(rnd.choices(DIGITS, k=k))

    def identifier() -> str:
        parts = [rnd.choice(words) for _ in range(rnd.randint(1, 5))]
        style = rnd.randrange(6)
        if style == 0:
            parts = [p.lower() for p in parts]
        elif style == 1:
            parts = [p.upper() for p in parts]
        elif style == 2:
            parts = [p.capitalize() for p in parts]
        elif style == 3:
            parts = [p.lower() if not i else p.capitalize() for i, p in enumerate(parts)]
        return rnd.choice(("_", "-", "", "")).join(parts) + rnd.choice(("", "", "", digits(rnd.randint(1, 4)), f"_{digits(2)}", "="))

    def route() -> str:
        parts = ["".join(c for c in identifier() if c != "=") for _ in range(rnd.randint(2, 5))]
        return rnd.choice(("", "/", "//")) + "/".join(p if rnd.random() < 0.8 else digits(rnd.randint(1, 6)) for p in parts)

    def number() -> str:
        return rnd.choice((digits(rnd.randint(8, 30)), f"20{digits(2)}-{digits(2)}-{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)}T{digits(6)}Z", "-".join(digits(rnd.randint(2, 5)) for _ in range(rnd.randint(3, 5))), "/".join(digits(rnd.randint(1, 4)) for _ in range(3)), f"{digits(4)}_{digits(4)}"))

    def line() -> str:
        return rnd.choice(ALPHABET) * rnd.randint(8, 60)

    out = [("".join(rnd.choices(alphabet, k=rnd.randint(8, 64))), label) for label, alphabet in RANDOM.items() for _ in range(n)]
    for label, make in zip(ORDINARY, (identifier, route, number, line), strict=True):
        out += [(make(), label) for _ in range(n * (4 if label == "identifier" else 1))]
    return out


def fit_words(docs: DataFrame) -> list[str]:
    """Distinct words of the ``FIT_DOCS`` documents with the least hashes of their ids, at most ``FIT_WORDS``, in the order of their hashes."""
    hashed = docs.select("text", F.xxhash64("doc_id").alias("_h")).filter(F.col("text").isNotNull())
    last = [r[0] for r in hashed.select("_h").distinct().orderBy("_h").limit(FIT_DOCS).collect()]
    if not last:
        return []
    found = hashed.filter(F.col("_h") <= last[-1])
    word = F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}0-9+/_=-])([A-Za-z]{3,40})(?![\p{L}0-9+/_=-])"), 1)).alias("word")
    ordered = found.select(word).distinct().orderBy(F.xxhash64("word"), "word").limit(FIT_WORDS)
    return [r[0] for r in ordered.collect()]


def train(docs: DataFrame) -> Model:
    return learn(samples(fit_words(docs)))


# On documents -------------------------------------------------------------------

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())])


def find(texts: list[str | None], model: Model) -> list[list[dict]]:
    """All spans of each text, by start and kind; ``score`` is the log ratio, without the prior (of base spans 0)."""
    out, rows = [], []
    for i, text in enumerate(texts):
        base = base_spans(text or "")
        out.append([{"kind": k, "start": a, "end": z, "score": 0.0, "base": True} for k, a, z in base])
        taken = Taken((a, z) for _, a, z in base)
        rows += [(i, a, z, named) for a, z, named in candidates(text or "") if taken.free(a, z)]
    if rows:
        scores = model.score([texts[i][a:z] for i, a, z, _ in rows])
        for (i, a, z, named), score in zip(rows, scores.tolist(), strict=True):
            if score + NAMED_PRIOR * named > model.threshold:
                last = out[i][-1] if out[i] and not out[i][-1]["base"] else None
                if last and (last["end"] > a or (last["end"] + 1 == a and texts[i][a - 1] == ".")):
                    last["end"], last["score"] = max(z, last["end"]), max(score, last["score"])
                else:
                    out[i].append({"kind": "random", "start": a, "end": z, "score": score, "base": False})
    return [sorted(s, key=lambda s: (s["start"], KINDS.index(s["kind"]))) for s in out]


def spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, spans array<struct<kind, start, end, score, base>>)`` of every whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model or train(docs))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(find(b.column(1).to_pylist(), shared.value), pa.list_(SPAN))], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int,score:double,base:boolean>>")


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` with the tags of their kinds in place of spans in ``text``; null stays null."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model or train(docs))
    at = column_at(docs, "text")

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            columns = list(b.columns)
            columns[at] = pa.array([t if t is None else redact_text(t, s) for t, s in zip(texts, find(texts, shared.value), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def digest(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Counts of base spans, their digest, all spans as text, and the count of added ones."""
    found = spans(docs, model)
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
