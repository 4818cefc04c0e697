"""Repair of damaged conversations by a dynamic programme that conversations share.

A row is read as one letter: whose turn it is (by the first character of its
role: system, user, assistant or another) and its first fault (blank text, a
role and text seen earlier, an unfinished last sentence). A conversation's
letters, in order, are its signature. Equal signatures are counted once; the
distinct ones are dealt into ranges, sorted, and inserted into a prefix trie of
which a task holds only the path to the latest one, so the layer of a prefix is
computed once however many signatures share it. Where a signature ends its
answers are read off the layers: counts of faults, the least cost, and the edits.

Edits keep a row (K, 0), give it the role user or assistant (R, 3), delete it
(D, 4; blank and duplicate rows must go) or insert an empty row of either (I, 3);
an unfinished row that stays costs 3 more. The roles' initials must then match
``(s?(ua)+)?``. Of the cheapest edits those whose letters are least count.

A layer has, for each state of that pattern, the least cost, the rank of its
letters among the states' and where it came from. Letters of all states end in
the same row's K, R or D, so none is a prefix of another, and ranks suffice.

Shuffled are narrow rows (a digest for a text) for the signatures, by ranges that
part a long conversation too, and texts once, to be repaired. What a
conversation holds in one place is its signature and its edits, a byte a row;
its repaired text streams through one task, as a digest of it must.

Null ids are one conversation; null turns come first and leave no gap; null
roles and texts are one space, so faulty. Rows of one turn come by role, then the
text's first ``HEAD`` characters, then its digest; equal rows are duplicates. An
empty or unknown role can't be kept. A conversation without rows has no faults,
cost 0, no edits and an empty repaired text. Empty tables give no rows; other
columns are ignored; texts are read whole.
"""

from __future__ import annotations

import hashlib
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, skew_join, small_batches, stage
from .merkle import CRC_TABLE, crc32_sql

SPACE = r"\x20\x09-\x0D"
#: Characters of a text by which rows of one turn and role are ordered before its digest is looked at.
HEAD = 32
ROLES, FAULTS = "sua", ("blank", "duplicate", "truncated")
#: A row's letter is this one plus four times its role plus its fault.
FIRST = ord("a")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a role leads from a state; inserting may go on from there.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3


# The dynamic programme --------------------------------------------------------


def inserted(state: int) -> list[tuple[int, str]]:
    """States that at most two inserted rows lead to; more lead back to one of these."""
    out = [(state, "")]
    for _ in range(2):
        last, letters = out[-1]
        out.append((NEXT["a" if last == USER else "u"][last], letters + "I"))
    return out


@cache
def step(shape: tuple, letter: str):
    """The layer after a row: ``(shape, cost added, origins)``.

    A shape has for each state None or (cost over the least, rank of its letters);
    an origin is (state before, letters of the edits). A state is let go where another
    does all it can for strictly less: the start beyond the assistant's cost and a deletion
    (of a system row it could have kept), a lone system row beyond the assistant's.
    """
    role, fault = divmod(ord(letter) - FIRST, 4)
    found: list[list] = [[] for _ in range(4)]
    for state, now in enumerate(shape):
        if now is None:
            continue
        cost, rank = now
        for at, letters in inserted(state):
            paid = cost + INSERT * len(letters)
            found[at].append((paid + DELETE, (rank, letters + "D"), state))
            if fault in (0, 3):
                extra = UNFINISHED if fault else 0
                for name, edges in NEXT.items():
                    if at in edges and ROLES[role : role + 1] == name:
                        found[edges[at]].append((paid + extra, (rank, letters + "K"), state))
                    if at in edges and name != "s":
                        found[edges[at]].append((paid + REROLE + extra, (rank, letters + "R"), state))
    best = [min(f, default=None) for f in found]
    if (a := best[ASSISTANT]) is not None:
        if best[START] is not None and best[START][0] > a[0] + DELETE:
            best[START] = None
        if best[SYSTEM] is not None and best[SYSTEM][0] > a[0]:
            best[SYSTEM] = None
    low = min(b[0] for b in best if b is not None)
    ranks = {letters: i for i, letters in enumerate(sorted(b[1] for b in best if b is not None))}
    new = tuple(None if b is None else (b[0] - low, ranks[b[1]]) for b in best)
    return new, low, tuple(None if b is None else (b[2], b[1][1]) for b in best)


@cache
def ending(shape: tuple) -> tuple[int, int, str]:
    """The best way to end at a layer: ``(cost, state, letters)``."""
    found = []
    for state, now in enumerate(shape):
        if now is not None:
            found += [(now[0] + INSERT * len(letters), (now[1], letters), state) for at, letters in inserted(state) if at in (START, ASSISTANT)]
    cost, (_, letters), state = min(found)
    return cost, state, letters


LEGAL = {(0, 1), (1, 2), (2, 1)}


class Trie:
    """The path of a prefix trie that leads to the latest signature; signatures must come sorted."""

    def __init__(self):
        self.letters = ""
        self.shapes, self.costs, self.origins = [((0, 0), None, None, None)], [0], [()]
        self.counts = [(0, 0, 0, 0)]
        self.layers = 0

    def insert(self, letters: str) -> tuple[int, int, int, int, int, str]:
        """Blank, duplicate, unfinished and illegal rows, least cost, edits."""
        shared = 0
        for x, y in zip(self.letters, letters, strict=False):
            if x != y:
                break
            shared += 1
        for kept in (self.shapes, self.costs, self.origins, self.counts):
            del kept[shared + 1 :]
        role = (ord(letters[shared - 1]) - FIRST) // 4 if shared else None
        for letter in letters[shared:]:
            shape, cost, origin = step(self.shapes[-1], letter)
            before, (role, fault) = role, divmod(ord(letter) - FIRST, 4)
            blank, duplicate, truncated, illegal = self.counts[-1]
            self.shapes.append(shape)
            self.costs.append(self.costs[-1] + cost)
            self.origins.append(origin)
            self.counts.append((blank + (fault == 1), duplicate + (fault == 2), truncated + (fault == 3), illegal + (before is not None and (before, role) not in LEGAL)))
        self.layers += len(letters) - shared
        self.letters = letters
        cost, state, edits = ending(self.shapes[-1])
        audit = [edits]
        for origin in reversed(self.origins[1:]):
            state, edits = origin[state]
            audit.append(edits)
        return (*self.counts[-1], self.costs[-1] + cost, "".join(reversed(audit)))


# Signatures ---------------------------------------------------------------------


ORDER = ("turn", "role", "_head", "_digest")


def _order(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_first() for n in names]


def filled(rows: DataFrame) -> DataFrame:
    """The four columns, null roles and texts as one space."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with what tells the order of a turn's rows, and one text from another."""
    return rows.withColumn("_head", F.substring("text", 1, HEAD)).withColumn("_digest", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))


def chunks(batches):
    """From ``(conv_id, turn, letters)`` in order: ``(conv_id, part, letters, low, high, turns)`` of each conversation's rows here."""
    part, now, kind = TaskContext.get().partitionId(), None, None

    def made(done):
        ids, letters, low, high, turns = zip(*done, strict=True)
        columns = (ids, [part] * len(ids), ["".join(x) for x in letters], low, high, turns)
        kinds = (kind, pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv_id", "part", "letters", "low", "high", "turns"])

    for b in batches:
        done, kind = [], b.column(0).type
        for conv_id, turn, letters in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if now is None or now[0] != conv_id:
                if now is not None:
                    done.append(now)
                now = [conv_id, [], None, None, 0]
            now[1].append(letters)
            if turn is not None and turn != now[3]:
                now[2:] = [turn if now[2] is None else now[2], turn, now[4] + 1]
        if done:
            yield made(done)
    if now is not None:
        yield made([now])


def signatures(rows: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """``(conv_id, signature, gaps)`` of each conversation, of those of ``also`` (conv_id) as well."""
    blank, closed = ~F.col("text").rlike(f"[^{SPACE}]"), F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    narrow = keyed(filled(rows)).withColumn("_fault", F.when(blank, 1).when(closed, 0).otherwise(3)).drop("text")
    # The earliest row of each role and text is marked by a row of its own, so no join meets a text that is everywhere.
    earliest = narrow.groupBy("conv_id", "role", "_head", "_digest", "_fault").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn"))["turn"].alias("turn"))
    both = narrow.withColumn("_n", F.lit(1)).unionByName(earliest.withColumn("_n", F.lit(0)))
    groups = both.groupBy("conv_id", "turn", "role", "_head", "_digest", "_fault").agg(F.sum("_n").alias("_n"), (F.min("_n") == 0).alias("_first"))
    role = F.when(F.length("role") == 0, 0).otherwise(F.instr(F.lit(ROLES), F.substring("role", 1, 1)))  # from 1; 0: another
    letter = lambda fault: F.char((FIRST + 4 * F.when(role == 0, 3).otherwise(role - 1) + fault).cast("long"))
    again = F.when(F.col("_fault") == 1, 1).otherwise(2)
    first = F.when(F.col("_first"), F.col("_fault")).otherwise(again)
    lettered = groups.select("conv_id", *ORDER, F.concat(letter(first), F.repeat(letter(again), (F.col("_n") - 1).cast("int"))).alias("letters"))
    dealt = lettered.repartitionByRange(*_order("conv_id", *ORDER)).sortWithinPartitions(*_order("conv_id", *ORDER))
    id_type = rows.schema["conv_id"].dataType.simpleString()
    found = dealt.select("conv_id", "turn", "letters").mapInArrow(chunks, f"conv_id {id_type}, part int, letters string, low long, high long, turns long")
    if also is not None:
        found = found.unionByName(also.select("conv_id").distinct().selectExpr("conv_id", "-1 as part", "'' as letters", "cast(null as long) as low", "cast(null as long) as high", "0L as turns"))
    parts = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "letters", "low", "high", "turns"))).alias("parts"))
    begin = F.struct(F.lit(0).cast("long").alias("turns"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    # A turn whose rows two ranges share is counted by both.
    span = F.aggregate("parts", begin, lambda a, p: F.struct((a["turns"] + p["turns"] - F.when(a["high"] == p["low"], 1).otherwise(0)).alias("turns"), F.coalesce(a["low"], p["low"]).alias("low"), F.coalesce(p["high"], a["high"]).alias("high")))
    gaps = let(span, lambda s: F.coalesce(s["high"] - s["low"] + 1 - s["turns"], F.lit(0)))
    return parts.select("conv_id", F.array_join(F.transform("parts", lambda p: p["letters"]), "").alias("signature"), gaps.alias("gaps"))


ANSWERS = ("blank", "duplicate", "truncated", "illegal", "cost")


def answers(distinct: DataFrame) -> DataFrame:
    """``(signature, n, blank, duplicate, truncated, illegal, cost, audit)`` of distinct signatures with a count ``n``."""

    def run(batches):
        trie = Trie()
        for b in batches:
            out = [trie.insert(s) for s in b.column(0).to_pylist()]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string())], names=["signature", "n", *ANSWERS, "audit"])

    dealt = distinct.select("signature", "n").repartitionByRange("signature").sortWithinPartitions("signature")
    return dealt.mapInArrow(run, "signature string, n long, " + ", ".join(f"{a} long" for a in ANSWERS) + ", audit string")


def diagnose(rows: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of each conversation."""
    spark = rows.sparkSession
    small_batches(spark)
    own = stage(spark, signatures(rows, also), "conversations")
    found = stage(spark, answers(own.groupBy("signature").agg(F.count("*").alias("n"))), "conversations-answers")
    return skew_join(own, found, "signature", "n", own.count()).select("conv_id", "gaps", *ANSWERS, "audit")


# Repair ---------------------------------------------------------------------------


class Mender:
    """Rows of one conversation, in order, on their way to the repaired ones."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, ""

    def _next(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def _inserted(self):
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            role = self._next()
            self.last = role[0]
            yield role, ""

    def row(self, role: str, text: str):
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            role = self._next() if edit == "R" else role
            self.last = role[0]
            yield role, text

    def end(self):
        yield from self._inserted()


def _mended(rows: DataFrame, found: DataFrame, out: str, make) -> DataFrame:
    """``make(batches)`` over each conversation's row of ``found``, followed by its own rows in order: ``(conv_id, audit, role, text, ...)``."""
    carried = ("gaps", *ANSWERS)
    texts = filled(rows).withColumn("audit", F.lit(None).cast("string")).withColumns({c: F.lit(None).cast("long") for c in carried})
    answered = found.select("conv_id", "audit", *carried, F.lit(None).cast("long").alias("turn"), *(F.lit(None).cast("string").alias(c) for c in ("role", "text")))
    dealt = keyed(texts.unionByName(answered).repartition("conv_id")).withColumn("_row", F.col("audit").isNull())
    ordered = dealt.sortWithinPartitions(*_order("conv_id", "_row", *ORDER))
    return ordered.select("conv_id", "audit", "role", "text", *carried).mapInArrow(make, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {out}")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def repaired(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: ``(conv_id, place, role, text)``; ``found`` is what ``diagnose`` gave."""

    def make(batches):
        conv, mender, place, kind = None, Mender(""), 0, None
        for b in batches:
            out, kind = [], b.column(0).type
            for conv_id, audit, role, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                for line in mender.end() if audit is not None else mender.row(role, text):
                    place += 1
                    out.append((conv, place, *line))
                if audit is not None:
                    conv, mender, place = conv_id, Mender(audit), 0
            if out:
                yield _batch(out, ["conv_id", "place", "role", "text"], [kind, pa.int64(), pa.string(), pa.string()])
        out = [(conv, place + i, *line) for i, line in enumerate(mender.end(), 1)]
        if out:
            yield _batch(out, ["conv_id", "place", "role", "text"], [kind, pa.int64(), pa.string(), pa.string()])

    return _mended(rows, diagnose(rows) if found is None else found, "place long, role string, text string", make)


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``found`` with ``repaired_sha256``, the digest of the repaired ``role:text`` lines."""
    names = ["conv_id", "audit", "gaps", *ANSWERS, "repaired_sha256"]

    def make(batches):
        now, mender, digest, lines, kinds = None, None, None, 0, []

        def take(repaired_rows):
            nonlocal lines
            for role, text in repaired_rows:
                digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1

        for b in batches:
            out, kinds = [], [b.column(0).type, pa.string(), *[pa.int64()] * 6, pa.string()]
            for conv_id, audit, role, text, *carried in zip(*(b.column(i).to_pylist() for i in range(4 + 6)), strict=True):
                if audit is None:
                    take(mender.row(role, text))
                    continue
                if now is not None:
                    take(mender.end())
                    out.append((*now, digest.hexdigest()))
                now, mender, digest, lines = (conv_id, audit, *carried), Mender(audit), hashlib.sha256(), 0
            if out:
                yield _batch(out, names, kinds)
        if now is not None:
            take(mender.end())
            yield _batch([(*now, digest.hexdigest())], names, kinds)

    return _mended(rows, found, "audit string, " + ", ".join(f"{c} long" for c in ("gaps", *ANSWERS)) + ", repaired_sha256 string", make)


def damage(conversations: DataFrame) -> DataFrame:
    """Every row by the check sum of its id and turn: one in twenty is dropped, emptied, stripped of sentence ends, repeated or given to the user."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    marked = filled(conversations).withColumn("_k", F.crc32(key) % 20).filter("_k <> 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("_k") == 3, 2).otherwise(1))).alias("_c")).drop("_c")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """What damage does to every conversation, and what its repair comes to."""
    rows = damage(conversations)
    return digests(rows, diagnose(rows, also=conversations))


# DuckDB --------------------------------------------------------------------------


def _oracle() -> str:
    never = "{'cost': 1000000000, 't': ''}"
    plus = lambda p, cost, letters: f"{{'cost': {p}.cost + {cost}, 't': {p}.t || '{letters}'}}"
    kept = lambda when, p, letters="K": f"case when {when} then {plus(p, 'x.extra', letters)} else {never} end"
    rerole = lambda p, letters="R": f"case when x.stays then {plus(p, '3 + x.extra', letters)} else {never} end"
    far = lambda p, role: [
        f"case when x.stays and x.r = '{role}' then {plus(p, '3 + x.extra', 'IK')} else {never} end",
        f"case when x.stays then {plus(p, '6 + x.extra', 'IR')} else {never} end",
    ]
    u = [plus("c.u", 4, "D"), *(kept("x.stays and x.r = 'u'", f"c.{p}") for p in "esa"), *(rerole(f"c.{p}") for p in "esa"), *far("c.u", "u")]
    a = [plus("c.a", 4, "D"), kept("x.stays and x.r = 'a'", "c.u"), rerole("c.u"), *(f for p in "esa" for f in far(f"c.{p}", "a"))]
    s = [plus("c.s", 4, "D"), kept("x.stays and x.r = 's'", "c.e")]
    pick = lambda found: f"list_min([{', '.join(found)}])"
    return f"""
with {CRC_TABLE},
marked as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  {crc32_sql("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as k from conversations, crc_table),
damaged as (select conv_id, turn, case when k = 4 then 'user' else role end as role,
  case k when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when k = 3 then 2 else 1 end)) as copy
  from marked where k <> 0),
ordered as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role, left(text, {HEAD}), sha256(text)) as i from damaged),
faulty as (select *, case left(role, 1) when 's' then 's' when 'u' then 'u' when 'a' then 'a' else 'o' end as r,
  case when not regexp_matches(text, '[^{SPACE}]') then 1
    when row_number() over (partition by conv_id, role, text order by i) > 1 then 2
    when regexp_matches(text, '[.!?][{SPACE}]*$') then 0 else 3 end as fault from ordered),
pairs as (select *, lag(r) over (partition by conv_id order by i) || r as pair from faulty),
counted as (select conv_id, cast(coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as bigint) as gaps,
  count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
  count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal,
  list({{'r': r, 'stays': fault in (0, 3), 'extra': case when fault = 3 then 3 else 0 end, 'e': {{'cost': 0, 't': ''}}, 's': {never}, 'u': {never}, 'a': {never}}} order by i) as marks
  from pairs group by conv_id),
solved as (select *, list_reduce(list_prepend({{'r': '', 'stays': false, 'extra': 0, 'e': {{'cost': 0, 't': ''}}, 's': {never}, 'u': {never}, 'a': {never}}}, marks),
  lambda c, x: {{'r': x.r, 'stays': x.stays, 'extra': x.extra, 'e': {plus("c.e", 4, "D")},
    's': {pick(s)},
    'u': {pick(u)},
    'a': {pick(a)}}}) as z from counted),
best as (select *, {pick(["z.e", "z.a", plus("z.u", 3, "I"), plus("z.s", 6, "II")])} as b from solved),
edits as (select conv_id, j, b.t[j] as op, length(replace(left(b.t, j), 'I', '')) as i, length(replace(left(b.t, j), 'D', '')) as place
  from (select conv_id, b, unnest(range(1, length(b.t) + 1)) as j from best)),
lined as (select e.conv_id, e.j, e.op, e.place, f.role, f.text, f.r,
  coalesce(max(case when e.place = 1 and e.op = 'K' and f.r = 's' then 1 end) over (partition by e.conv_id), 0) as began
  from edits e left join faulty f on f.conv_id is not distinct from e.conv_id and f.i = e.i and e.op <> 'I' where e.op <> 'D'),
texts as (select conv_id, string_agg(case when op = 'K' then role when (place - began) % 2 = 1 then 'user' else 'assistant' end || ':' || case when op = 'I' then '' else text end, chr(10) order by j) as repaired
  from lined group by conv_id),
ids as (select distinct conv_id from conversations)
select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  cast(coalesce(b.cost, 0) as bigint) as cost, coalesce(b.t, '') as audit, sha256(coalesce(repaired, '')) as repaired_sha256
from ids left join best on best.conv_id is not distinct from ids.conv_id left join texts on texts.conv_id is not distinct from ids.conv_id
"""


ORACLE = _oracle()
