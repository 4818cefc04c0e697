"""Plain versions of what the operators compute, for small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def words(text):
    return WORD.findall(text or "")


def shingles(text, n):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(rows, n, percent):
    """{row: (set size, smallest id reachable)} over rows (id, text), by all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (own, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((own, len(sets[i]), min(group, default=None)))
    return out


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(n):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(n))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_spans(text):
    test = {
        "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s)), "phone": lambda s: 10 <= len(digits(s)) <= 15,
    }
    found = [(k, *m.span()) for k in KINDS for m in PATTERNS[k].finditer(text or "") if test[k](m[0])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
