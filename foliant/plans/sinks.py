"""Queries that write and read back: the mirror, statements, exports."""

from __future__ import annotations

import contextlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import outstandings as bills
from ..operators import telemetry
from ..sinks import reports, workbooks
from ..sinks.mirror import Mirror, MirrorConflict
from ..sources import shared
from .outstandings import OPEN
from .registry import query
from .windows import LATENCY, _place


def _records(v, changed):
    k = F.col("o_orderkey")
    return v.table("orders").select(k.alias("k"), k.cast("string").alias("key"), F.sha2(F.concat(k.cast("string"), changed), 256).alias("hash"), F.col("o_orderstatus").alias("payload"))


@query("select batch, verdict, count(*) as records from (select 'b1' as batch, 'inserted' as verdict from orders where o_orderkey % 3 > 0 union all select 'b1-again', 'replayed' from orders where o_orderkey % 3 > 0 union all select 'b2', case when o_orderkey % 3 = 0 then 'inserted' when o_orderkey % 7 = 0 then 'conflict' else 'replayed' end from orders union all select 'stored', 'observed' from orders) group by 1, 2")
def observation_staging(v):
    """Three batches: new records, the same again, and changed ones among replays; then what is stored."""
    mirror = Mirror(v.spark, shared.folder(v.spark, "mirror"))
    rows = _records(v, F.lit(""))
    first = mirror.observe("b1", rows.filter("k % 3 > 0").drop("k")).withColumn("batch", F.lit("b1"))
    again = mirror.observe("b1-again", rows.filter("k % 3 > 0").drop("k")).withColumn("batch", F.lit("b1-again"))
    changed = _records(v, F.when((F.col("o_orderkey") % 7 == 0) & (F.col("o_orderkey") % 3 > 0), "x").otherwise(""))
    second = mirror.observe("b2", changed.drop("k")).withColumn("batch", F.lit("b2"))
    mirror.observe("b1", rows.filter("k % 3 > 0").drop("k"))  # a batch that runs again
    stored = mirror.observed().select(F.lit("stored").alias("batch"), F.lit("observed").alias("verdict"))
    seen = first.select("batch", "verdict").unionByName(again.select("batch", "verdict")).unionByName(second.select("batch", "verdict")).unionByName(stored)
    return seen.groupBy("batch", "verdict").agg(F.count("*").cast("long").alias("records"))


@query("""with n as (select count(*) filter (where o_orderkey % 3 > 0) as a, count(*) filter (where o_orderkey % 3 = 0) as b, count(*) as t from orders),
p as (select sha256('genesis|inserted=' || a) as h1, a, b, t from n)
select * from (select 'proof' as kind, 'b1' as name, 'committed' as state, h1 as hash from p union all select 'proof', 'b1 twice', 'already_committed', null from p union all select 'proof', 'b2', 'committed', sha256(h1 || '|inserted=' || b || ',replayed=' || a) from p union all select 'proof', 'b3', 'conflict', null from p
union all select 'checkpoint', 'core', '2', 'at b2' from p union all select 'checkpoint', 'tax', '1', 'at b1' from p union all select 'outbox', 'o' || r_regionkey, '1', 'pending' from region where r_regionkey % 2 = 0)""")
def mirror_commits(v):
    """Commits with their proofs, a second commit, a refused one; checkpoints by pair; what an outbox still holds."""
    spark = v.spark
    mirror = Mirror(spark, shared.folder(spark, "mirror"))
    rows = _records(v, F.lit(""))
    states = []
    mirror.observe("b1", rows.filter("k % 3 > 0").drop("k"))
    states += [("b1", mirror.commit("b1")), ("b1 twice", mirror.commit("b1"))]
    mirror.observe("b2", rows.drop("k"))
    states.append(("b2", mirror.commit("b2")))
    mirror.observe("b3", rows.filter("k = 1").drop("k").withColumn("hash", F.lit("other")))
    states.append(("b3", mirror.commit("b3")))
    for batch, packs in (("b1", ("core", "tax")), ("b2", ("core",))):
        mirror.checkpoint(batch, spark.createDataFrame([("c", p, f"at {batch}") for p in packs], "company string, pack string, position string"))
    item = F.concat(F.lit("o"), F.col("r_regionkey").cast("string")).alias("stream")
    region = v.table("region")
    mirror.log("l1", region.select(item, F.lit(1).cast("long").alias("at"), F.lit("pending").alias("kind"), F.lit("").alias("body")))
    mirror.log("l2", region.filter("r_regionkey % 2 = 1").select(item, F.lit(2).cast("long").alias("at"), F.lit("sent").alias("kind"), F.lit("").alias("body")))
    tried = spark.createDataFrame(states, "name string, state string")
    proofs = mirror.table("proofs", "seq long, batch string, prev_hash string, payload string, entry_hash string").select(F.col("batch").alias("_b"), "entry_hash")
    out = tried.join(proofs, F.col("name") == F.col("_b"), "left").select(F.lit("proof").alias("kind"), "name", "state", F.col("entry_hash").alias("hash"))
    marks = mirror.checkpoints().select(F.lit("checkpoint").alias("kind"), F.col("pack").alias("name"), F.col("generation").cast("string").alias("state"), F.col("position").alias("hash"))
    pending = mirror.pending().select(F.lit("outbox").alias("kind"), F.col("stream").alias("name"), F.col("events").cast("string").alias("state"), F.col("kind").alias("hash"))
    return out.unionByName(marks).unionByName(pending)


@query("""with n as (select count(*) filter (where o_orderkey % 2 = 0) as even, count(*) filter (where o_orderkey % 2 = 1) as odd from orders),
h as (select *, sha256('genesis|inserted=' || even) as h1 from n)
select * from (select 'b1' as batch, 'killed before its entry' as step, 'no rows' as state, cast(0 as bigint) as records from h union all select 'b1', 'run again', 'stored', even from h union all select 'b1', 'run a third time', 'stored', even from h
union all select 'b1', 'with other rows', 'refused', even from h union all select 'b1', 'killed before its proof', 'no proof', 0 from h union all select 'b1', 'committed', h1, 1 from h union all select 'b1', 'committed again', h1, 1 from h
union all select 'b2', 'lost a race', 'stored', even + odd from h union all select 'b3', 'won the race', 'stored', even + odd from h union all select 'b2', 'committed', sha256(h1 || '|inserted=' || (odd - 1) || ',replayed=1'), 2 from h
union all select 'b3', 'behind the checkpoint', 'concurrent_checkpoint', 2 from h union all select 'c', 'core', 'at b2', 2 from h)""")
def mirror_recovery(v):
    """Every step killed, run again and raced: what the mirror holds after each."""
    spark, out = v.spark, []
    folder = shared.folder(spark, "mirror")
    mirror, killed, raced = Mirror(spark, folder), Mirror(spark, folder), Mirror(spark, folder)
    rows = _records(v, F.lit("")).filter("k % 2 = 0").drop("k")
    # Of two batches that hold order 1 as new, one is published while the other is on its way.
    first = v.table("orders").filter("o_orderkey % 2 = 1").agg(F.min("o_orderkey")).first()[0]
    odd = _records(v, F.lit("")).filter("k % 2 = 1")
    one = odd.filter(F.col("k") == first).drop("k")
    at = lambda batch: spark.createDataFrame([("c", "core", f"at {batch}")], "company string, pack string, position string")

    def stored(batch, step, state="stored"):
        out.append((batch, step, state, mirror.observed().count()))

    def proofs(batch, step, state=None):
        chain = [e["proof"] for e in mirror.entries() if e["kind"] == "commit"]
        out.append((batch, step, state or chain[-1]["entry_hash"], len(chain)))

    def die(entry):
        raise InterruptedError

    killed._publish = die
    with contextlib.suppress(InterruptedError):
        killed.observe("b1", rows)
    stored("b1", "killed before its entry", "no rows")
    mirror.observe("b1", rows)
    stored("b1", "run again")
    mirror.observe("b1", rows)
    stored("b1", "run a third time")
    try:
        mirror.observe("b1", rows.limit(1))
    except MirrorConflict:
        stored("b1", "with other rows", "refused")
    with contextlib.suppress(InterruptedError):
        killed.commit("b1", at("b1"))
    proofs("b1", "killed before its proof", "no proof")
    mirror.commit("b1", at("b1"), {("c", "core"): None})
    proofs("b1", "committed")
    mirror.commit("b1", at("b1"), {("c", "core"): None})
    proofs("b1", "committed again")

    def overtaken(entry, publish=raced._publish):
        raced._publish = publish
        mirror.observe("b3", one)
        return publish(entry)

    raced._publish = overtaken
    raced.observe("b2", odd.drop("k"))
    stored("b2", "lost a race")
    stored("b3", "won the race")
    mirror.commit("b2", at("b2"), {("c", "core"): "at b1"})
    proofs("b2", "committed")
    proofs("b3", "behind the checkpoint", mirror.commit("b3", at("b3"), {("c", "core"): "at b1"}))
    made = spark.createDataFrame(out, "batch string, step string, state string, records long")
    return made.unionByName(mirror.checkpoints().select(F.col("company").alias("batch"), F.col("pack").alias("step"), F.col("position").alias("state"), F.col("generation").alias("records")))


SLUG = "left(regexp_replace(regexp_replace(lower(party), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 120)"
CELL = "case when regexp_matches({0}, '^[=+\\-@\t\r]') then '''' || {0} else {0} end"


@query(f"""with o as (select *, row_number() over (partition by party order by age desc nulls last, due_date, reference, kind) as r from ({OPEN})),
lines as (select party, r + 2 as n, {CELL.format('reference')} || ',' || bill_date || ',' || due_date || ',' || amount || ',' || coalesce(cast(age as varchar), '') || ',' || kind as line from o
union all select party, 1, chr(65279) || 'Statement,' || party from o group by party union all select party, 2, 'Reference,Bill date,Due date,Amount,Days overdue,Direction' from o group by party
union all select party, count(*) + 3, 'Total receivable,,,' || cast(coalesce(sum(amount) filter (where kind = 'receivable'), 0) as decimal(18,2)) from o group by party
union all select party, count(*) + 4, 'Total payable,,,' || cast(coalesce(sum(amount) filter (where kind = 'payable'), 0) as decimal(18,2)) from o group by party)
select {SLUG} as file, count(*) as lines, sha256(string_agg(line, chr(10) order by n)) as digest from lines group by party""")
def statement_files(v):
    """A CSV file for each party, written and read back whole."""
    rows = bills.open_bill_rows(v.bill, v.as_of)
    folder = shared.folder(v.spark, "statements")
    written = shared.staged(reports.write_statements(reports.statement_lines(rows, "Statement"), folder), "statements-written")
    back = reports.read_statements(written)
    text = F.regexp_replace("value", "\n$", "")
    return back.select("file", F.size(F.split(text, "\n")).cast("long").alias("lines"), F.sha2(text, 256).alias("digest"))


@query(f"""with o as (select * from ({OPEN}))
select party, '{{"bills":' || count(*) || ',"file":"' || {SLUG} || '","party":"' || party || '","payable":"' || cast(coalesce(sum(amount) filter (where kind = 'payable'), 0) as decimal(18,2)) || '","receivable":"' || cast(coalesce(sum(amount) filter (where kind = 'receivable'), 0) as decimal(18,2)) || '"}}' as json from o group by party""")
def statement_manifest_json(v):
    rows = bills.open_bill_rows(v.bill, v.as_of)
    return reports.manifest(rows, reports.statement_lines(rows, "Statement"))


CHAIN = "(select user_id as chain, row_number() over (partition by user_id order by ts, event_id) as seq, event_type as code, 'p' || event_id as payload from events)"


@query(f"""with c as (select * from {CHAIN} where seq <= 3), h1 as (select chain, sha256('genesis|' || payload) as h from c where seq = 1), h2 as (select c.chain, sha256(h || '|' || payload) as h from c join h1 on h1.chain = c.chain where seq = 2), h3 as (select c.chain, sha256(h || '|' || payload) as h from c join h2 on h2.chain = c.chain where seq = 3),
e as (select c.chain, seq, code, case seq when 1 then h1.h when 2 then h2.h else h3.h end as h from c left join h1 on h1.chain = c.chain left join h2 on h2.chain = c.chain left join h3 on h3.chain = c.chain),
s as (select chain, case when chain % 11 = 0 then 'chain_broken' when bool_or(code = 'error') then 'code_not_allowed' else 'exported' end as state, '[' || string_agg('{{"code":"' || code || '","entry_hash":"' || h || '","seq":' || seq || '}}', ',' order by seq) || ']' as json from e group by chain)
select chain, state, case when state = 'exported' then json end as json, case when state = 'exported' then sha256(json) end as checksum from s""")
def proof_exports(v):
    """Chains of three proofs exported as JSON; broken ones, and those with a code that isn't allowed, are refused."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = v.table("events").select(F.col("user_id").alias("chain"), seq.cast("long").alias("seq"), F.col("event_type").alias("code"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("payload")).filter("seq <= 3")
    w = Window.partitionBy("chain").orderBy("seq")
    one = lambda before, payload: F.sha2(F.concat_ws("|", before, payload), 256)
    a, b = F.lag("payload", 1).over(w), F.lag("payload", 2).over(w)
    h1 = one(F.lit("genesis"), F.coalesce(b, a, F.col("payload")))
    h2 = one(h1, F.when(b.isNotNull(), a).otherwise(F.col("payload")))
    before = F.when(F.col("seq") == 1, "genesis").when(F.col("seq") == 2, h1).otherwise(h2)
    rows = rows.withColumn("prev_hash", before).withColumn("entry_hash", one(F.col("prev_hash"), F.col("payload")))
    rows = rows.withColumn("entry_hash", F.when(F.col("chain") % 11 == 0, F.reverse("entry_hash")).otherwise(F.col("entry_hash")))
    allowed = [r[0] for r in v.table("events").select("event_type").distinct().limit(1000).collect() if r[0] != "error"]
    return reports.proof_export(rows, allowed)


@query(f"""select '[' || string_agg('{{"class":"' || class || '","outcome":"' || outcome || '","bucket":' || bucket || ',"attempts":' || attempts || '}}', ',' order by class, outcome, bucket, attempts) || ']' as json, true as exported from (select class, outcome, cast({_place('latency_us', LATENCY)} as bigint) as bucket, count(*) as attempts from v_attempt group by 1, 2, 3)""")
def telemetry_json(v):
    return reports.telemetry_export(telemetry.histogram(v.attempt, "latency_us", LATENCY))


LARGE = "case when party like '%3' and reference like '%7' then cast(amount + 9007199254740993.01 as decimal(18,2)) else amount end"
AGED = "case when age is null then 'Not yet due' when age <= 30 then '0-30 days' when age <= 60 then '31-60 days' when age <= 90 then '61-90 days' else '90+ days' end"
SUBTOTALS = " union all ".join(
    f"select party, n + {3 + 5 * j + i} as r, 0 as c, 'text' as kind, '{k} {b}' as value from p union all select party, n + {3 + 5 * j + i}, 4, 'number', cast((select coalesce(sum(amount), 0) from o where o.party = p.party and kind = '{k}' and {AGED} = '{b}') as varchar) from p"
    for j, k in enumerate(("receivable", "payable"))
    for i, b in enumerate(workbooks.BUCKETS)
)


@query(f"""with a as (select party, reference, bill_date, due_date, {LARGE} as amount, age, kind from ({OPEN})), s as (select *, row_number() over (partition by party order by age desc nulls last, due_date, reference, kind) + 2 as r from a),
q as (select party, case when max(amount) > 9007199254740992 then 'amount_not_exact' end as reason, count(*) as n, sum(amount) as total from a group by party), p as (select * from q where reason is null), o as (select s.* from s join p using (party)),
cells as (select party, r, 0 as c, 'text' as kind, reference as value from o union all select party, r, 1, 'date', cast(bill_date as varchar) from o union all select party, r, 2, 'date', cast(due_date as varchar) from o union all select party, r, 3, 'text', kind from o
union all select party, r, 4, 'number', cast(amount as varchar) from o union all select party, r, 5, case when age is null then 'text' else 'number' end, coalesce(cast(age as varchar), 'Not due') from o union all select party, r, 6, 'text', {AGED} from o
union all select party, 1, 0, 'text', 'Statement' from p union all select party, 1, 1, 'text', party from p union all select party, 2, i - 1, 'text', ({list(workbooks.HEAD)})[i] from p, range(1, 8) as t(i) union all {SUBTOTALS}
union all select party, n + 13, 0, 'text', 'Total bill magnitudes (not net)' from p union all select party, n + 13, 4, 'number', cast(total as varchar) from p),
d as (select party, count(*) as cells, sha256(string_agg(r || ':' || c || ':' || kind || ':' || case when kind = 'number' then cast(cast(value as decimal(38,2)) as varchar) else value end, chr(10) order by r, c)) as digest from cells group by party)
select q.party, case when reason is null then n + 13 end as rows, cells, digest, reason from q left join d using (party)""")
def statement_workbooks(v):
    """A workbook for each party, read back cell by cell; amounts that a double doesn't hold leave a party without one, with a code."""
    rows = bills.open_bill_rows(v.bill, v.as_of)
    rows = rows.withColumn("amount", F.when(F.col("party").endswith("3") & F.col("reference").endswith("7"), (F.col("amount") + F.lit("9007199254740993.01").cast("decimal(18,2)")).cast("decimal(18,2)")).otherwise(F.col("amount")))
    written = shared.staged(workbooks.write_workbooks(rows, shared.folder(v.spark, "workbooks")), "workbooks-written")
    cells = workbooks.read_cells(written.filter("path is not null"))
    value = F.when(F.col("kind") == "number", F.col("value").cast("decimal(38,2)").cast("string")).otherwise(F.col("value"))
    line = F.concat_ws(":", F.col("r").cast("string"), F.col("c").cast("string"), "kind", value)
    per = cells.groupBy("file").agg(F.count("*").alias("cells"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "c", line.alias("line")))), lambda x: x["line"]), "\n"), 256).alias("digest"))
    return written.join(per, "file", "left").select("party", "rows", "cells", "digest", "reason")
