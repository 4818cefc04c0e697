"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Base spans follow fixed patterns and always stay. High-recall generators
propose further spans, overlapping ones included: spelled-out and loose mail
addresses, colon-grouped addresses, any run of digit groups, account numbers,
and values after words like ``password``. Gradient-boosted trees score each
candidate by its format and its context; Platt scaling on held-out examples and
a threshold per kind (the least with the wanted precision there) select the
redactions, the likelier first, none overlapping a base span or another.

The trees are trained here on examples rendered from seeded templates, since no
table labels spans. Null and empty texts have no span; long texts are searched
whole, in time by their length and spans. Positions are code points, ends
exclusive. Of candidates that score alike the first by start, kind and end is
tried first. Rows are independent; repeated rows give repeated spans, an empty
table none. ``redact`` keeps all other columns, ``spans`` drops them.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_at, small_batches, tidy

#: Kinds in their order: the base ones first.
KINDS = ("email", "ip", "card", "phone", "secret", "iban")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind's pattern that pass its test."""
    out = []
    if "@" in text:
        end = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                end = m.end()
                out.append(("email", start, end))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits(m.group())) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(digits(m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# Candidates and their features ------------------------------------------------

SPELLED = re.compile(r"\b[\w.+-]{1,64}\s?[\[({]?\s?(?:at|AT)\s?[\])}]?\s?[\w-]{1,64}\s?[\[({]?\s?(?:dot|DOT)\s?[\])}]?\s?[A-Za-z]{2,12}\b")
LOOSE = re.compile(r"[^\s@<>()\[\],;:\"]{1,64}\s?@\s?[^\s@<>()\[\],;:\"]{1,64}")
COLONS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
GROUPS = re.compile(r"(?<![0-9A-Za-z])[(+]?[0-9](?:[\x20().,/:-]{0,2}[0-9]){6,24}(?![0-9A-Za-z])")
ACCOUNT = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![0-9A-Za-z])")
KEYED = re.compile(r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b\x20{0,3}[=:]\x20{0,3}[\"']?([^\s\"']{6,128})")
ACCESS = re.compile(r"(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])")
KEY_WORDS = ("passw", "pwd", "token", "secret", "key")

# Words that speak for or against a kind when they come before a candidate.
HINTS = {
    "phone": ("tel", "phone", "call", "mobile", "cell", "fax", "telefon", "teléfono", "rufen", "contact", "whatsapp", "sms"),
    "email": ("mail", "contact", "write", "reach", "correo", "courriel"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "karte", "carte", "tarjeta"),
    "ip": ("ip", "host", "server", "address", "client", "from", "login"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "secret": ("password", "token", "secret", "key", "credential"),
}
AGAINST = ("isbn", "issn", "order", "invoice", "version", "page", "price", "total", "serial", "ticket", "doi", "date", "time", "figure", "section", "population", "$", "€", "no.", "nr.", "#")


def candidates(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "@" in text:
        out += [("email", *m.span()) for m in LOOSE.finditer(text)]
    if ("dot" in text or "DOT" in text) and ("at" in text or "AT" in text) and re.search(r"\b(?:dot|DOT)\b", text):
        out += [("email", *m.span()) for m in SPELLED.finditer(text)]
    if DIGIT.search(text):
        for m in GROUPS.finditer(text):
            out += [("phone", *m.span()), ("card", *m.span())]
        out += [("iban", *m.span()) for m in ACCOUNT.finditer(text)]
        if text.count(":") >= 3:
            out += [("ip", *m.span()) for m in COLONS.finditer(text)]
        if "KIA" in text or "SIA" in text:
            out += [("secret", *m.span()) for m in ACCESS.finditer(text)]
    low = text.lower()
    if any(w in low for w in KEY_WORDS):
        out += [("secret", *m.span(1)) for m in KEYED.finditer(text)]
    return out


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, span: tuple[str, int, int]) -> list[float]:
    """Format of the candidate and what stands around it."""
    kind, a, z = span
    s, before, after = text[a:z], text[max(0, a - 40) : a].lower(), text[z : z + 12].lower()
    d = digits(s)
    groups = re.findall(r"[0-9]+", s)
    counts = np.unique(list(s), return_counts=True)[1] / len(s)
    date_like = bool(re.match(r"[(+]?(?:(?:19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}|[0-9]{1,2}[-/. ][0-9]{1,2}[-/. ](?:19|20)[0-9]{2})", s))
    return [
        KINDS.index(kind), len(s), len(d), len(groups), len(d) / len(s), max(map(len, groups), default=0), min(map(len, groups), default=0),
        s.startswith("+"), "(" in s, s.count("-"), s.count("."), s.count(" "), s.count(":"), s.count("/"), s.count(","),
        luhn(d) if len(d) >= 13 else 0, d[:1] in "3456" if d else 0, date_like, d.startswith("0"), d.startswith("97") and len(d) == 13,
        sum(c.isupper() for c in s) / len(s), sum(c.isalpha() for c in s) / len(s), -float((counts * np.log2(counts)).sum()),
        iban_ok(s) if kind == "iban" else 0, "." in s[s.find("@") :] if "@" in s else 0, s[-1:].isalnum(),
        any(w in before for w in HINTS[kind]), any(w in before for w in AGAINST), after[:1] in "%€$°" and after[:1] != "", before[-1:].isalnum(), len(set(d)),
    ]


# Training examples ------------------------------------------------------------


def examples(rnd: random.Random, n: int) -> list[tuple[list[float], int]]:
    """Candidates in rendered sentences, with 1 where the span is the personal datum planted."""
    pick = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice("abcdefghiklmnoprstuvwz") for _ in range(rnd.randint(2, 9)))

    def card(good: bool) -> str:
        body = rnd.choice("3456") + pick(14)
        last = next(c for c in "0123456789" if luhn(body + c) == good)
        s = body + last
        return rnd.choice((s, " ".join(s[i : i + 4] for i in range(0, 16, 4)), "-".join(s[i : i + 4] for i in range(0, 16, 4))))

    def iban(good: bool) -> str:
        country, body = rnd.choice(("DE", "FR", "ES", "GB")), pick(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        s = f"{country}{(check if good else (check + rnd.randint(1, 90)) % 97):02d}{body}"
        return rnd.choice((s, " ".join(s[i : i + 4] for i in range(0, len(s), 4))))

    mail = lambda: f"{word()}{rnd.choice(('', '.', '_'))}{word()}"
    hexa = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    good = (
        ("phone", lambda: f"({pick(3)}) {pick(3)}-{pick(4)}"), ("phone", lambda: f"{pick(3)}-{pick(3)}-{pick(4)}"), ("phone", lambda: f"{pick(3)}.{pick(3)}.{pick(4)}"), ("phone", lambda: f"0{pick(3)} {pick(7)}"), ("phone", lambda: f"+{rnd.randint(1, 99)} {pick(3)} {pick(3)} {pick(4)}"),
        ("card", lambda: card(True)), ("email", lambda: f"{mail()} at {word()} dot {rnd.choice(('com', 'org', 'net'))}"), ("email", lambda: f"{mail()}[at]{word()}[dot]com"), ("email", lambda: f"{mail()} @ {word()}.org"), ("email", lambda: f"{mail()}ü@{word()}.de"),
        ("ip", lambda: ":".join(hexa(4) for _ in range(8))), ("ip", lambda: "2001:db8:" + ":".join(hexa(rnd.randint(1, 4)) for _ in range(6))), ("iban", lambda: iban(True)),
        ("secret", lambda: f"{rnd.choice(('password', 'token', 'secret', 'api_key'))} = {hexa(rnd.randint(16, 40))}"), ("secret", lambda: "AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))), ("secret", lambda: f"password={hexa(rnd.randint(8, 16))}"),
    )
    bad = (
        lambda: f"{rnd.randint(1900, 2030)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}", lambda: f"{rnd.randint(1, 28):02d}/{rnd.randint(1, 12):02d}/{rnd.randint(1900, 2030)}", lambda: f"978-{pick(1)}-{pick(4)}-{pick(4)}-{pick(1)}", lambda: pick(rnd.randint(7, 20)), lambda: f"{rnd.randint(1, 99)},{pick(3)},{pick(3)}", lambda: f"{pick(2)}:{pick(2)}:{pick(2)}.{pick(3)}",
        lambda: card(False), lambda: iban(False), lambda: " ".join(pick(rnd.randint(1, 2)) for _ in range(rnd.randint(5, 9))), lambda: f"{rnd.randint(1950, 2030)} {rnd.randint(1950, 2030)}", lambda: f"{pick(1)}.{pick(8)}", lambda: f"{word()} at the {word()} dot {word()}", lambda: f"price@{pick(2)}", lambda: f"@ {word()}", lambda: f"token: {word()}{word()}", lambda: f"key = {word()}{word()}",
        lambda: f"{pick(2)}:{pick(2)}:{pick(2)}:{pick(2)}", lambda: f"{rnd.choice(('order', 'invoice', 'ticket', 'serial', 'isbn'))} {pick(rnd.randint(7, 16))}", lambda: f"{pick(3)}/{pick(4)}/{pick(3)}",
    )
    out = []
    while len(out) < n:
        kind, planted = rnd.choice(good) if rnd.random() < 0.5 else (None, rnd.choice(bad))
        datum = planted()
        lead = " ".join(word() for _ in range(rnd.randint(2, 6)))
        if kind is not None and rnd.random() < 0.4:
            lead += " " + rnd.choice(HINTS[kind]) + rnd.choice((" ", ": "))
        elif rnd.random() < 0.2:
            lead += " " + rnd.choice(AGAINST) + " "
        text = f"{lead} {datum}{rnd.choice(('', '.', ','))} {word()} {word()}"
        a = text.find(datum, len(lead))
        for c in candidates(text):
            inside = max(0, min(c[2], a + len(datum)) - max(c[1], a))
            whole = kind == c[0] and inside >= 0.8 * (c[2] - c[1]) and (inside >= 0.8 * len(datum) or kind == "secret")
            out.append((features(text, c), int(whole)))
    return out


# Boosted trees ----------------------------------------------------------------


@dataclass
class Boosted:
    """Trees of depth ``DEPTH`` on numeric features, stored level by level."""

    feature: np.ndarray  # tree x inner node
    cut: np.ndarray
    leaf: np.ndarray  # tree x leaf
    start: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, ...] = ()

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        row = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, f[node]] > c[node])
            out += leaf[node - len(f)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.shift)))


DEPTH, TREES, RATE, L2, BINS = 4, 60, 0.25, 1.0, 24
#: Examples to train and calibrate on, and the precision that a threshold must reach.
EXAMPLES, PRECISION, LEAST_THRESHOLD = 6000, 0.98, 0.8


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Newton boosting of the logistic loss on quantile cuts."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    inner = 2**DEPTH - 1
    start = math.log(y.mean() / (1 - y.mean()))
    margin = np.full(len(y), start)
    features_, cuts_, leaves_ = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        f, c, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first = 2**level - 1
            for k in range(first, 2 * first + 1):
                rows = np.flatnonzero(node == k)
                best = (1e-6, 0, np.inf, BINS)
                if len(rows) >= 8:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for j in range(x.shape[1]):
                        if not len(cuts[j]):
                            continue
                        gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(cuts[j]) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(cuts[j]) + 1))[:-1]
                        gain = gl**2 / (hl + L2) + (gs - gl) ** 2 / (hs - hl + L2) - gs**2 / (hs + L2)
                        i = int(gain.argmax())
                        if gain[i] > best[0]:
                            best = (gain[i], j, cuts[j][i], i)
                f[k], c[k] = best[1], best[2]
                node[rows] = 2 * k + 1 + (x[rows, f[k]] > c[k])
        leaf_of = node - inner
        leaf = RATE * np.bincount(leaf_of, g, 2**DEPTH) / (np.bincount(leaf_of, h, 2**DEPTH) + L2)
        margin += leaf[leaf_of]
        features_.append(f)
        cuts_.append(c)
        leaves_.append(leaf)
    return Boosted(np.stack(features_), np.stack(cuts_), np.stack(leaves_), start)


@cache
def train(seed: int = 5) -> Boosted:
    """Trees from rendered examples; a third is held out to calibrate and to choose thresholds."""
    made = examples(random.Random(seed), EXAMPLES)
    x, y = np.array([f for f, _ in made], float), np.array([t for _, t in made], float)
    held = np.arange(len(y)) % 3 == 0
    model = boost(x[~held], y[~held])
    m, t = model.margin(x[held]), y[held]
    for _ in range(50):  # Platt scaling by Newton steps
        p = 1 / (1 + np.exp(-(model.slope * m + model.shift)))
        z = np.stack([m, np.ones_like(m)], axis=1)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (t - p) - 1e-3 * np.array([model.slope - 1, model.shift]))
        model.slope, model.shift = model.slope + step[0], model.shift + step[1]
    p = model.probability(x[held])
    chosen = []
    for k in range(len(KINDS)):
        own = x[held][:, 0] == k
        order = np.argsort(-p[own])
        precision = np.cumsum(t[own][order]) / np.arange(1, len(order) + 1)
        enough = np.flatnonzero(precision >= PRECISION)
        chosen.append(max(LEAST_THRESHOLD, float(p[own][order][enough[-1]])) if len(enough) else 2.0)
    model.thresholds = tuple(chosen)
    return model


# On documents -----------------------------------------------------------------

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())])


class Taken:
    """Stretches of a text that spans have taken, apart from each other and in order."""

    def __init__(self, spans):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, z in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], z)
            else:
                self.starts.append(a)
                self.ends.append(z)

    def free(self, a: int, z: int) -> bool:
        at = bisect.bisect_right(self.starts, a)
        return not (at and self.ends[at - 1] > a or at < len(self.starts) and self.starts[at] < z)

    def add(self, a: int, z: int) -> bool:
        """Take a stretch if it is free; else False."""
        if not self.free(a, z):
            return False
        at = bisect.bisect_right(self.starts, a)
        self.starts.insert(at, a)
        self.ends.insert(at, z)
        return True


def find(texts: list[str | None], model: Boosted) -> list[list[dict]]:
    """All selected spans of each text, by start and kind."""
    base = [base_spans(t or "") for t in texts]
    found = [candidates(t or "") for t in texts]
    rows = [(i, c, features(texts[i], c)) for i, cs in enumerate(found) for c in cs]
    out = [[{"kind": k, "start": a, "end": z, "score": 1.0, "base": True} for k, a, z in b] for b in base]
    if rows:
        p = model.probability(np.array([f for *_, f in rows], float))
        wanted = [(float(q), i, c) for q, (i, c, _) in zip(p, rows, strict=True) if q >= model.thresholds[KINDS.index(c[0])]]
        taken: dict[int, Taken] = {}
        for q, i, (k, a, z) in sorted(wanted, key=lambda w: (-w[0], w[1], w[2][1], KINDS.index(w[2][0]), w[2][2])):
            if i not in taken:
                taken[i] = Taken((s["start"], s["end"]) for s in out[i])
            if taken[i].add(a, z):
                out[i].append({"kind": k, "start": a, "end": z, "score": q, "base": False})
    return [sorted(s, key=lambda s: (s["start"], KINDS.index(s["kind"]))) for s in out]


def spans(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """``(doc_id, spans array<struct<kind, start, end, score, base>>)`` of every whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model or train())

    @tidy()
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(find(b.column(1).to_pylist(), shared.value), pa.list_(SPAN))], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double,base:boolean>>")


def redact_text(text: str, found: list[dict]) -> str:
    """Each run of overlapping spans becomes the tag of its first span's kind."""
    out, at = [], 0
    for s in found:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """The rows of ``docs`` with spans replaced in ``text`` (null stays null) and ``n_chars`` counted anew."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model or train())
    at, n_at = column_at(docs, "text"), column_at(docs, "n_chars") if "n_chars" in {c.lower() for c in docs.columns} else None

    @tidy()
    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            new = [t if t is None else redact_text(t, s) for t, s in zip(texts, find(texts, shared.value), strict=True)]
            columns = list(b.columns)
            columns[at] = pa.array(new, pa.string())
            if n_at is not None:
                n = [old if t is None else len(t) for t, old in zip(new, columns[n_at].to_pylist(), strict=True)]
                columns[n_at] = pa.array(n, columns[n_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def digest(docs: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, all spans as text, and counts of all spans and of those of the added kinds."""
    found = spans(docs)
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in KINDS[:4]]
    added = [F.size(F.filter("spans", _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS[4:]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), *added)
