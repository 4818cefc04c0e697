"""The conversation repair against a search through all edits, and the rows it gives."""

import random
import re
from collections import Counter, defaultdict

import pytest

from foliant.llm import conversations as c

DONE = re.compile("(s?(ua)+)?")
#: What can still become a whole pattern.
BEGUN = re.compile("s?(ua)*u?")


def search(letters):
    """(cost, edits) by trying every edit of every row and up to two inserted rows before each."""
    found = []

    def go(at, roles, cost, edits, free):
        if not BEGUN.fullmatch(roles):
            return
        if free:
            for role in "ua":
                go(at, roles + role, cost + 3, edits + "I", free - 1)
        if at == len(letters):
            if DONE.fullmatch(roles):
                found.append((cost, edits))
            return
        role, fault = divmod(ord(letters[at]) - c.FIRST, 4)
        go(at + 1, roles, cost + 4, edits + "D", 2)
        if fault in (0, 3):
            extra = 3 if fault else 0
            if role < 3:
                go(at + 1, roles + "sua"[role], cost + extra, edits + "K", 2)
            for new in "ua":
                go(at + 1, roles + new, cost + 3 + extra, edits + "R", 2)

    go(0, "", 0, "", 2)
    return min(found)


def test_least_edits():
    rnd = random.Random(1)
    made = sorted({"".join(chr(c.FIRST + 4 * rnd.choice((0, 1, 1, 2, 2, 3)) + rnd.choice((0, 0, 0, 1, 2, 3))) for _ in range(rnd.randint(0, 5))) for _ in range(400)})
    trie = c.Trie()
    for letters in made:
        *_, cost, audit = trie.insert(letters)
        assert (cost, audit) == search(letters), letters
    assert trie.layers < sum(map(len, made))  # prefixes are shared


def test_layers_depend_on_no_neighbour():
    rnd = random.Random(2)
    made = sorted("".join(chr(c.FIRST + rnd.randrange(16)) for _ in range(rnd.randint(0, 40))) for _ in range(500))
    trie = c.Trie()
    assert [trie.insert(s) for s in made] == [c.Trie().insert(s) for s in made]
    assert c.step.cache_info().currsize < 5000  # shapes of layers are few, however long a conversation is


def test_a_long_conversation():
    letters = "".join(chr(c.FIRST + random.Random(3).randrange(16)) for _ in range(200_000))
    assert sum(x != "I" for x in c.Trie().insert(letters)[-1]) == len(letters)


@pytest.fixture(scope="module")
def rows(spark, awkward):
    return spark.read.parquet(f"{awkward}/conversations.parquet")


def test_repaired_rows(spark, rows):
    """Repaired conversations have legal roles; kept rows are the given ones; other ranges and orders give the same."""
    found = c.diagnose(rows).collect()
    lines = defaultdict(list)
    for r in sorted(c.repaired(rows).collect(), key=lambda r: r["place"]):
        lines[r["conv_id"]].append((r["place"], r["role"], r["text"]))
    given = Counter((r["conv_id"], r["text"]) for r in rows.collect())
    for r in found:
        mended, edits = lines[r["conv_id"]], r["audit"]
        assert [place for place, *_ in mended] == list(range(1, len(edits) - edits.count("D") + 1))
        assert DONE.fullmatch("".join(role[0] for _, role, _ in mended))
        assert sum(not text for *_, text in mended) == edits.count("I")
        assert all(given[r["conv_id"], text] for *_, text in mended if text)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = c.diagnose(rows.repartition(11)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))


def test_a_conversation_parted_by_ranges(spark):
    """Half of all rows belong to one conversation, its turns repeat at the borders of ranges."""
    made = [(1, t // 3, "user" if t % 2 else "assistant", f"{t % 50}.") for t in range(4000)] + [(t, 0, "user", "x.") for t in range(2, 4000)]
    rows = spark.createDataFrame(made, "conv_id long, turn long, role string, text string")
    own = {r["conv_id"]: r for r in c.signatures(rows).collect()}
    assert len(own) == 3999 and len(own[1]["signature"]) == 4000 and own[1]["gaps"] == 0
    assert {r["signature"] for i, r in own.items() if i > 1} == {chr(c.FIRST + 4)}
