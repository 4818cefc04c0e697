"""Quality rules with cross-document line frequency, in DataFrame operations only.

A document's base figures come from its own words and lines. Across documents,
lines are normalised (lower case, digits as 0, runs of white space and of
punctuation as one space) and hashed; a line in more distinct documents of a
host than its limit is removed, and a document is rejected when too little
remains: less than ``least_left`` of its words, or fewer than ``least_words``.

The limit is a count of documents, the same whatever a host's size. Documents are
distinct by id, host and text, so repeated rows count once and get the same
verdict; a null host is a host of its own; null texts and texts without a word
fail the base rules. Lines without a word are never counted. Long texts count
whole, an empty table gives no rows. Columns but ``doc_id``, ``text`` and
``source`` are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, stage, words

#: Documents of a host that may share a line.
LIMIT = 10
#: What must remain after removal.
LEAST_LEFT, LEAST_WORDS = 0.5, 10
#: Ways that one common line's rows are dealt.
SALTS = 32


def normal(line):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{Nd}", "0"), r"[\s\p{P}]+", " "))


def repeat_words(tokens):
    """Words in 5-word windows that occur twice or more in the text, the first included."""
    digests = F.transform(tokens, lambda w: F.xxhash64(w))

    def windows(h):
        return F.transform(F.sequence(F.lit(1), F.size(h) - 4), lambda i: F.xxhash64(*[F.get(h, i + k - 1) for k in range(5)]))

    def covered(g):
        # Windows sorted by digest, then place; places next to an equal digest are repeats.
        ranked = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s):
            twin = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"]))

        def total(p):
            start = F.struct(F.lit(-5).alias("at"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(p, start, lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(5), x - a["at"])).alias("n")))["n"]

        return let(let(ranked, places), total)

    def counted(g):
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g))

    return F.when(F.size(tokens) < 6, F.lit(0).cast("long")).otherwise(let(let(digests, windows), counted))


def base(docs: DataFrame) -> DataFrame:
    """doc_id, host key columns, the base figures, and the lines with their words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", F.col("source").alias("host"), F.xxhash64(text).alias("h1"), F.crc32(text.cast("binary")).alias("h2"), text.alias("t"), words(F.col("text")).alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    n_words = F.size("w").cast("long")
    chars = F.length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")).cast("long")
    symbols = (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long")
    repeated = repeat_words(F.col("w"))
    listed = F.transform("lines", lambda x: F.struct(F.xxhash64(normal(x)).alias("line"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("n")))
    return split.select(
        "doc_id", "host", "h1", "h2", n_words.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated.alias("n_repeat_words"), listed.alias("lines"),
    )


def common_lines(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(host, line, rows) of the lines above the limit, from ``base`` rows; ``rows`` counts documents."""
    once = rows.select("doc_id", "host", "h1", "h2", F.array_distinct(F.transform("lines", lambda x: x["line"])).alias("own")).distinct()
    return once.select("host", F.explode("own").alias("line")).groupBy("host", "line").agg(F.count("*").alias("in_docs")).filter(F.col("in_docs") > limit)


def verdicts(docs: DataFrame, limit: int = LIMIT, least_left: float = LEAST_LEFT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, the base figures, base_failed, n_left (words that remain) and kept."""
    rows = stage(docs.sparkSession, base(docs), "quality")
    common = common_lines(rows, limit)
    salted = common.select(F.col("host").alias("_host"), F.col("line").alias("_line"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    lines = rows.select("doc_id", "host", "h1", "h2", "lines").distinct().select("doc_id", "host", "h1", "h2", F.explode("lines").alias("x")).select("doc_id", "host", "h1", "h2", "x.line", "x.n")
    lines = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "h1"), F.lit(SALTS)).cast("int"))
    hit = lines.join(salted, F.col("host").eqNullSafe(F.col("_host")) & (F.col("line") == F.col("_line")) & (F.col("salt") == F.col("_salt")))
    removed = hit.groupBy("doc_id", "host", "h1", "h2").agg(F.sum("n").alias("removed")).select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "host", "h1", "h2")], "removed")
    same = F.lit(True)
    for c in ("doc_id", "host", "h1", "h2"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    n = F.col("n_words")
    left = n - F.coalesce("removed", F.lit(0))
    failed = (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)
    judged = rows.drop("lines").join(removed, same, "left").withColumn("base_failed", failed).withColumn("n_left", left)
    kept = ~F.col("base_failed") & (F.col("n_left") >= least_words) & (F.col("n_left") >= least_left * n)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left", kept.alias("kept"))


# The same rules for DuckDB; lines are told apart by their text.
ORACLE = rf"""
with d as (select row_number() over () as r, doc_id, source as host, coalesce(text, '') as t from documents),
w as (select r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from d),
l as (select r, unnest(string_split(t, chr(10))) as line from d),
lw as (select r, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as n from l),
wl as (select r, line, n, trim(regexp_replace(regexp_replace(lower(line), '\p{{Nd}}', '0', 'g'), '[\t\n\x0B\f\r \p{{P}}]+', ' ', 'g'), ' ') as norm from lw where n > 0),
dup as (select r, count(*) - count(distinct line) as n_dup_lines from wl group by r),
g as (select r, i, list_aggregate(w[i:i+4], 'string_agg', chr(10)) as gram from (select r, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
rg as (select r, i from (select r, i, count(*) over (partition by r, gram) as c from g) where c >= 2),
rep as (select r, count(distinct i + k) as n_repeat_words from rg, (select unnest(range(5)) as k) group by r),
seen as (select d.host, norm, count(distinct (d.doc_id, d.t)) as in_docs from wl join d using (r) group by d.host, norm),
common as (select host, norm from seen where in_docs > {LIMIT}),
gone as (select wl.r, sum(n) as removed from wl join d using (r) join common c on c.norm = wl.norm and c.host is not distinct from d.host group by wl.r),
f as (select doc_id, cast(len(w) as bigint) as n_words,
  cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
  cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols,
  cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, cast(len(w) - coalesce(removed, 0) as bigint) as n_left
  from d join w using (r) left join dup using (r) left join rep using (r) left join gone using (r)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from f)
select *, not base_failed and n_left >= {LEAST_WORDS} and n_left >= {LEAST_LEFT} * n_words as kept from b
"""
