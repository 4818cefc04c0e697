import random

import pytest
from pyspark.sql import types as T

WORDS = "the quick brown fox jumps over lazy dogs while seven bright stars shine above our quiet little harbour town".split()
#: Columns that the operators use as names of their own.
CLASHING = "score _score size source_size target taken ids spans label host line kept sid elements _source _shard root component_id words digest _kept _id _text decoded n_words".split()


def passage(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) + rnd.choice(("", "", "s", "ly")) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empty and very long texts, ties, repeated rows, near copies."""
    rnd = random.Random(3)
    texts = [None, "", " \t\n\x0b ", "one", "one two three", "   ", "a\x00b", "Ünïcödé 你好 🎉 <|endoftext|> x", "line\nline\nother line\nline"]
    texts += [passage(rnd, 40) for _ in range(12)]
    near = passage(rnd, 120).split()
    texts += [" ".join(near), " ".join(near[:60] + ["changed"] + near[61:]), " ".join(near), " ".join(near + ["more"])]
    texts += [passage(rnd, 30_000), "x" * 300_000, "All rights reserved.\nLicensed under the MIT License.\n" + passage(rnd, 20)]
    texts += ["mail a.b@c-d.org or call +1 (605) 555-9305, 10.1.2.3, 4111 1111 1111 1111, 1.2.3.999, é@x.y"]
    texts += [passage(rnd, 30) + " you pathetic idiot, you stupid moron", passage(rnd, 30) + ' he said "idiot" is a word']
    shared = "a line that many documents of one host have in common"
    texts += [shared + "\n" + passage(rnd, 25 if i % 2 else 6) for i in range(14)]
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else "hot" if i % 2 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[10], rows[10], (None, texts[11], None, None, None), (None, None, None, None, None)]


def turns() -> list[tuple]:
    """(conv_id, turn, role, text): every fault, nulls, ties, repeated rows, a long conversation, odd roles."""
    rnd = random.Random(4)
    rows = [(c, t, ("user", "assistant")[t % 2], f"Turn {t} of {c}.") for c in range(40) for t in range(c % 7)]
    rows += [(100 + c, rnd.choice((None, 1, 2, 3, 9)), rnd.choice(("user", "assistant", "system", "System", "", None, "tool")), rnd.choice((None, "", " \n", "a.", "b", "c! ", "é?\n"))) for c in range(60) for _ in range(rnd.randint(1, 9))]
    rows += [(7000, t, rnd.choice(("user", "assistant")), f"{t % 400} words" + "." * (t % 3)) for t in range(3000)]
    rows += [(None, t, "user", "no id.") for t in (None, 1, 1, 2)] + [(8000, 1, "user", "long " * 50_000)] + [(8001, None, None, None)]
    return [*rows, rows[5], rows[5]]


def write(spark, folder, rows, pages, labels, conversations=()) -> str:
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    spark.createDataFrame([(*r, *["clash"] * len(CLASHING)) for r in rows], kinds).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string, digest string, payload string, first string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, label string").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(conversations), "conv_id long, turn long, role string, text string, audit string, letters string, gaps string, _row string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def awkward(spark, tmp_path_factory):
    """A folder of tables with every awkward case."""
    long_page = "<html>" + "y" * 200_000 + "</html>"
    pages = [(5, "u", "x" * 200), (3, None, "x" * 200), (9, "u v", "x" * 200), (3, "dup", "x" * 200), (1, "a", None), (2, "a", ""), (4, "s", "short"), (6, "s", "short"), (7, "l", long_page), (8, "l", long_page), (None, "n", "x" * 200), (None, "n", "z" * 150), (None, "n", "z" * 150), (10, "ü\r\nX: y", "é" * 60 + "\r\n\r\n")]
    labels = [(i, i % 2, int(i in (29, 30))) for i in range(0, 40)] + [(None, 1, 1), (5, None, None), (7, 1, 1), (7, 0, 0)]
    return write(spark, tmp_path_factory.mktemp("awkward"), awkward_rows(), [(*p, "c", "c", "c") for p in pages], [(*x, "c") for x in labels], [(*t, "c", "c", "c", "c") for t in turns()])


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    """The same tables without a row."""
    return write(spark, tmp_path_factory.mktemp("nothing"), [], [], [])


@pytest.fixture
def documents(spark):
    def make(texts, first: int = 0):
        kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
        return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], kind)

    return make
