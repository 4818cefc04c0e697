"""Queries on reads, their evidence and their order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import reads as op
from ..operators import windows
from ..sources import shared
from .registry import query


@query("select l_orderkey as voucher, count(*) as entries, declared, count(distinct l_linenumber) = count(*) as unique_positions, max(ord) as last_ordinal, case when count(*) = declared then 'ok' else 'entry_count_mismatch' end as state from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as ord, n + case when l_orderkey % 29 = 0 then 1 else 0 end as declared from lineitem join (select l_orderkey as k, count(*) as n from lineitem group by 1) on k = l_orderkey) group by l_orderkey, declared")
def entry_ordinals(v):
    """Entries numbered within their voucher, and the voucher's declared count against them."""
    k = F.col("l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = shared.dealt(v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey")
    place = F.col("l_linenumber")
    again = place.isNull() | F.coalesce(F.lag("l_linenumber").over(w) == place, F.lit(False))
    rows = lines.select("l_orderkey", F.row_number().over(w).alias("ord"), again.alias("again"))
    per = rows.groupBy(k.alias("voucher")).agg(F.count("*").cast("long").alias("entries"), (~F.bool_or("again")).alias("unique_positions"), F.max("ord").cast("long").alias("last_ordinal"))
    declared = (F.col("entries") + F.when(F.col("voucher") % 29 == 0, 1).otherwise(0)).cast("long")
    return per.withColumn("declared", declared).withColumn("state", F.when(F.col("entries") == F.col("declared"), "ok").otherwise("entry_count_mismatch"))


@query("select n_nationkey as series, case n_nationkey % 4 when 1 then 'date_partitions_incomplete' when 2 then 'date_partitions_differ' else 'equal' end as state from nation")
def date_partitions(v):
    """Recorded partitions of a period against its deterministic tiles; some lack the last, some are shifted."""
    first = F.lit("1997-04-01").cast("date")
    rows = v.table("nation").select(F.col("n_nationkey").alias("series"), dates.tiles(first, F.date_add(first, F.col("n_nationkey") * 17)).alias("tiles"))
    k = F.col("series") % 4
    moved = F.transform("tiles", lambda t: F.struct(F.date_add(t["from"], 1).alias("from"), t["to"].alias("to")))
    recorded = F.when(k == 1, F.slice("tiles", 1, F.size("tiles") - 1)).when(k == 2, moved).otherwise(F.col("tiles"))
    state = F.when(F.sort_array(recorded) == F.sort_array("tiles"), "equal").when(F.size(recorded) != F.size("tiles"), "date_partitions_incomplete").otherwise("date_partitions_differ")
    return rows.select("series", state.alias("state"))


LEAVES = "(select o_custkey as series, o_orderkey as leaf, cast(o_orderdate as date) as f, cast(cast(o_orderdate as date) + to_days(cast(o_orderkey % 60 as integer)) as date) as t from orders)"


@query(f"select series, count(*) as leaves, count(*) filter (where f <= prev) as overlaps from (select *, lag(t) over (partition by series order by f, t, leaf) as prev from {LEAVES}) group by series")
def leaf_overlaps(v):
    """Leaf windows that begin before the one before has ended."""
    day = F.to_date("o_orderdate")
    rows = v.table("orders").select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("leaf"), day.alias("f"), F.date_add(day, (F.col("o_orderkey") % 60).cast("int")).alias("t"))
    before = F.lag("t").over(Window.partitionBy("series").orderBy("f", "t", "leaf"))
    return rows.withColumn("prev", before).groupBy("series").agg(F.count("*").cast("long").alias("leaves"), F.count_if(F.col("f") <= F.col("prev")).cast("long").alias("overlaps"))


OBSERVED = "(select user_id as series, row_number() over (partition by user_id order by ts, event_id) as seq, 1000 + (event_id % 3) * 100 as width, 200 + event_id % 40 as rows, 9000000 + (event_id % 7) * 4000000 as bytes, cast(12000 + event_id % 9000 as bigint) as ms from events)"
_like = " and ".join(f"abs(p.{c} - o.{c}) * 100 <= greatest(p.{c}, o.{c}, 1) * 25" for c in ("width", "rows", "bytes"))


@query(f"""with o as (select * from {OBSERVED}), c as (select o.series, o.seq, p.width, p.bytes, p.ms, row_number() over (partition by o.series, o.seq order by p.seq desc) as k from o join o p on p.series = o.series and p.seq between o.seq - 32 and o.seq and {_like}),
t as (select series, seq, count(*) as n, max(ms) filter (where k = 3) as a, max(ms) filter (where k = 2) as b, max(ms) filter (where k = 1) as c, min(width) as w, max(ms) as slow, max(bytes) as big from c where k <= 3 group by series, seq)
select series, seq, coalesce(n = 3 and a < b and b < c and c >= 15000 and c - a >= 1000, false) as stop, cast(case when n = 3 then greatest(least(w, greatest(w * 15000 // slow, 1), greatest(w * 29360128 // big, 1)), 1) end as bigint) as next_width from t""")
def read_pace(v):
    """Where comparable reads become slower reading stops, and how wide the next one may be."""
    e = F.col("event_id")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = v.table("events").select(F.col("user_id").alias("series"), seq.alias("seq"), (1000 + (e % 3) * 100).alias("width"), (200 + e % 40).alias("rows"), (9_000_000 + (e % 7) * 4_000_000).alias("bytes"), (12_000 + e % 9000).alias("ms"))
    return op.pace(rows).select("series", F.col("seq").cast("long").alias("seq"), "stop", "next_width")


@query("select code, id, 'record-' || lpad(cast(row_number() over (partition by code order by first, id) as varchar), 4, '0') as alias from (select p_brand as code, p_type as id, min(p_partkey) as first from part group by 1, 2)")
def record_aliases(v):
    rows = v.table("part").select(F.col("p_brand").alias("code"), F.col("p_type").alias("id"), "p_partkey")
    return op.aliases(rows, ["code"], "id", F.col("p_partkey"), "record-")


@query("select user_id as key, arg_max(event_type, stamp) as value, max(stamp) as stamp, count(*) as issued from (select *, row_number() over (partition by user_id order by ts, event_id) as stamp from events) group by user_id")
def last_writer(v):
    """Of the answers under a key only that to the latest stamp applies."""
    stamp = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = v.table("events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), stamp.cast("long").alias("stamp"))
    return rows.groupBy("key").agg(F.max_by("value", "stamp").alias("value"), F.max("stamp").alias("stamp"), F.count("*").cast("long").alias("issued"))


@query("select o_custkey as batch, count(*) as observed, count(*) filter (where o_orderstatus = 'F') as accepted, count(*) filter (where o_orderstatus = 'P') as rejected, count(distinct o_orderpriority) as windows from orders group by 1")
def batch_counts(v):
    s = F.col("o_orderstatus")
    return v.table("orders").groupBy(F.col("o_custkey").alias("batch")).agg(F.count("*").cast("long").alias("observed"), F.count_if(s == "F").cast("long").alias("accepted"), F.count_if(s == "P").cast("long").alias("rejected"), F.count_distinct("o_orderpriority").cast("long").alias("windows"))


@query("select batch, sha256('counts' || chr(0) || string_agg(length(kind) || ':' || kind || length(cast(n as varchar)) || ':' || n, '' order by kind)) as digest from (select o_custkey as batch, o_orderpriority as kind, count(*) as n from orders group by 1, 2) group by batch")
def record_count_digest(v):
    """One digest of each batch's record counts by kind, kinds in order; lists hold a row for each kind."""
    counts = v.table("orders").groupBy(F.col("o_custkey").alias("batch"), F.col("o_orderpriority").alias("kind")).agg(F.count("*").cast("string").alias("n"))
    framed = F.concat(F.length("kind").cast("string"), F.lit(":"), F.col("kind"), F.length("n").cast("string"), F.lit(":"), F.col("n"))
    return counts.groupBy("batch").agg(F.sha2(F.concat(F.lit("counts\x00"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", framed.alias("x")))), lambda r: r["x"]), "")), 256).alias("digest"))


@query("select win, sha256(string_agg(low, '' order by p)) as digest, cast(sum(n) as bigint) as records from (select win, d[:3] as p, sha256(string_agg(d, '' order by d)) as low, count(*) as n from (select win, sha256(length(cast(sid as varchar)) || ':' || sid) as d from v_window) group by win, p) group by win")
def membership_digest(v):
    """One digest of a window's members, whatever their content."""
    return windows.ordered_digest(v.window, ["win"], F.col("sid").cast("string"))


@query("select company, members, members > 100000 as exceeded from (select n_nationkey as company, sum(case when n_nationkey % 3 = 0 then 40 else 1 end * c_custkey % 5000) as members from nation join customer on c_nationkey = n_nationkey group by 1)")
def record_budget(v):
    """Members of a run's batches against the budget of 100,000."""
    n = F.when(F.col("c_nationkey") % 3 == 0, 40).otherwise(1) * F.col("c_custkey") % 5000
    return v.table("customer").groupBy(F.col("c_nationkey").alias("company")).agg(F.sum(n).cast("long").alias("members")).withColumn("exceeded", F.col("members") > 100_000)


@query("select c_custkey as company, coalesce(n, 0) as records, coalesce(batches, 0) as batches, case when n is null then 'empty' when batches = 0 then 'legacy_only' when c_custkey % 9 = 0 then 'checkpoint_missing' else 'ready' end as state from customer left join (select o_custkey, count(*) as n, count(*) filter (where o_orderstatus <> 'P') as batches from orders group by 1) on o_custkey = c_custkey")
def incremental_evidence(v):
    """What a company has for incremental reads: records, committed batches, a checkpoint."""
    per = v.table("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") != "P").alias("b"))
    rows = v.table("customer").select(F.col("c_custkey").alias("company")).join(per, F.col("company") == F.col("o_custkey"), "left")
    state = F.when(F.col("n").isNull(), "empty").when(F.col("b") == 0, "legacy_only").when(F.col("company") % 9 == 0, "checkpoint_missing").otherwise("ready")
    return rows.select("company", F.coalesce("n", F.lit(0)).alias("records"), F.coalesce("b", F.lit(0)).alias("batches"), state.alias("state"))


@query("select company, guid from (select c_custkey as company, nullif(case when c_custkey % 4 > 0 then 'g' || c_custkey else '' end, '') as guid, c_name from customer) where coalesce(guid, 'name:' || c_name) in (select case when s_suppkey % 4 > 0 then 'g' || s_suppkey else 'name:Customer#' || lpad(cast(s_suppkey as varchar), 9, '0') end from supplier where s_suppkey % 2 = 0)")
def current_companies(v):
    """Known companies whose key, by id or else by name, is among those that the source lists."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    known = v.table("customer").select(k.alias("company"), F.when(k % 4 > 0, F.concat(F.lit("g"), k.cast("string"))).alias("guid"), "c_name")
    live = v.table("supplier").filter("s_suppkey % 2 = 0").select(F.when(s % 4 > 0, F.concat(F.lit("g"), s.cast("string"))).otherwise(F.concat(F.lit("name:Customer#"), F.lpad(s.cast("string"), 9, "0"))).alias("_k"))
    return known.join(live, F.coalesce("guid", F.concat(F.lit("name:"), F.col("c_name"))) == F.col("_k"), "left_semi").select("company", "guid")


@query("select o_orderkey as win, case when o_orderkey % 19 = 0 then 'unpaired' when o_orderkey % 23 = 0 or o_orderkey % 31 = 0 then 'mismatch' else 'passed' end as state from orders")
def paired_reads(v):
    """Two reads of each window: some missing once, some with other bytes or hashes."""
    k = F.col("o_orderkey")
    rows = v.table("orders").select(k.alias("win"), (k % 10).alias("rows"), (k * 7).alias("bytes"), F.sha2(k.cast("string"), 256).alias("hash"))
    again = rows.filter("win % 19 <> 0").withColumn("bytes", F.col("bytes") + F.when(F.col("win") % 23 == 0, 1).otherwise(0)).withColumn("hash", F.when(F.col("win") % 31 == 0, "other").otherwise(F.col("hash")))
    return op.paired(rows, again, "win")


@query("select k as run, string_agg(distinct code, ',' order by code) as codes, coalesce(string_agg(distinct code, ',' order by code) filter (where code not in ('a1', 'b2', 'c3')), '') as not_allowed from (select p_partkey % 97 as k, ['a1', 'b2', 'c3', 'd4'][1 + p_size % 3] as code from part union all select p_partkey % 97, 'd4' from part where p_partkey % 194 = 5) group by k")
def code_sets(v):
    """Codes of a run from two sources as one set, and those outside an allow-list."""
    run = (F.col("p_partkey") % 97).alias("run")
    gaps = v.table("part").select(run, F.get(F.array(*map(F.lit, ("a1", "b2", "c3"))), F.col("p_size") % 3).alias("code"))
    warnings = v.table("part").filter("p_partkey % 194 = 5").select(run, F.lit("d4").alias("code"))
    per = lambda d, n: d.groupBy("run").agg(F.collect_set("code").alias(n))
    none = F.array().cast("array<string>")
    both = per(gaps, "g").join(per(warnings, "w"), "run", "full_outer").withColumn("u", F.array_sort(F.array_union(F.coalesce("g", none), F.coalesce("w", none))))
    return both.select("run", F.array_join("u", ",").alias("codes"), F.array_join(F.array_except("u", F.array(*map(F.lit, ("a1", "b2", "c3")))), ",").alias("not_allowed"))


@query("select c_custkey as company, coalesce(v, 0) as voucher_mark, coalesce(m, 0) as master_mark, case when c_custkey % 17 = 0 then 'unavailable' when c_custkey % 13 = 0 then 'changed' else 'stable' end as bracket from customer left join (select o_custkey, max(o_orderkey) as v, count(*) as m from orders group by 1) on o_custkey = c_custkey")
def bracketed_reads(v):
    """High-water marks of vouchers and masters before and after a company's reads."""
    marks = v.table("orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("v"), F.count("*").alias("m"))
    rows = v.table("customer").select(F.col("c_custkey").alias("company")).join(marks, F.col("company") == F.col("o_custkey"), "left")
    a, b = F.coalesce("v", F.lit(0)).cast("long"), F.coalesce("m", F.lit(0)).cast("long")
    moved = b + F.when(F.col("company") % 13 == 0, 1).otherwise(0)
    rows = rows.select("company", a.alias("voucher_mark"), b.alias("master_mark"), F.struct(a.alias("v"), b.alias("m")).alias("opened"), F.when(F.col("company") % 17 != 0, F.struct(a.alias("v"), moved.alias("m"))).alias("closed"))
    return op.bracket(rows).select("company", "voucher_mark", "master_mark", "bracket")


@query("select o_custkey as company, cast(case when day >= date '1993-01-01' then day end as varchar) as cutoff, case when day < date '1993-01-01' then 'as_of_precedes_books_from' end as reason from (select o_custkey, cast(least(max(o_orderdate), date '1997-06-30') as date) as day from orders group by 1)")
def as_of_cutoffs(v):
    last = v.table("orders").groupBy(F.col("o_custkey").alias("company")).agg(F.max(F.to_date("o_orderdate")).alias("last"))
    c = op.cutoff(F.col("last"), F.lit("1997-06-30").cast("date"), F.lit("1993-01-01").cast("date"))
    return last.select("company", c.alias("c")).select("company", F.col("c.cutoff").cast("string").alias("cutoff"), "c.reason")


@query("select o_custkey as company, cast(pairs as bigint) as pairs, pairs <= 128 as admitted from (select o_custkey, d * cast(ceil(h / 40.0) as bigint) + case when h > 0 then d * 3 else 0 end as pairs from (select o_custkey, count(distinct strftime(o_orderdate, '%Y-%m')) as d, o_custkey % 900 as h from orders group by 1))")
def plan_admission(v):
    """Whether a company's scan stays within the pairs of reads allowed."""
    per = v.table("orders").groupBy(F.col("o_custkey").alias("company")).agg(F.count_distinct(F.date_format("o_orderdate", "yyyy-MM")).alias("d"))
    pairs = op.planned_pairs(F.col("d"), F.col("company") % 900, F.lit(40)).cast("long")
    return per.select("company", pairs.alias("pairs"), (pairs <= op.MOST_PAIRS).alias("admitted"))


@query("select p as partition, case when p % 11 = 0 then 'segment_incomplete' when p % 7 = 0 then 'segments_not_contiguous' when p % 5 = 0 then 'duplicate_voucher_guid' when p % 3 = 0 then 'duplicate_alter_id' else 'complete' end as state from (select distinct o_custkey as p from orders)")
def scan_assembly(v):
    """Segments and rows of a partition put together: incomplete, apart, with repeated ids, or complete."""
    p, k = F.col("o_custkey"), F.col("o_orderkey")
    rows = v.table("orders").select(p.alias("partition"), k.cast("string").alias("guid"), k.alias("alter_id"))
    first = rows.groupBy("partition").agg(F.min("guid").alias("guid"), F.min("alter_id").alias("alter_id"))
    again = first.filter("partition % 5 = 0").select("partition", "guid", (-F.col("alter_id")).alias("alter_id")).unionByName(first.filter("partition % 3 = 0").select("partition", F.concat(F.lit("x"), F.col("guid")).alias("guid"), "alter_id"))
    parts = rows.select("partition").distinct()
    at = F.explode(F.array(*[F.lit(x) for x in (0, 100, 200)])).alias("at")
    segments = parts.select("partition", at).select("partition", (F.col("at") + F.when((F.col("partition") % 7 == 0) & (F.col("at") == 200), 1).otherwise(0)).alias("low"), (F.col("at") + 100).alias("high"), (~((F.col("partition") % 11 == 0) & (F.col("at") == 100))).alias("complete"))
    return op.assembly(segments, rows.unionByName(again))


#: A read of three orders in a hundred, one of ten that should hold it, and the first again without some rows.
NARROW, WIDE, AGAIN = "o_orderkey % 100 < 3", "o_orderkey % 100 < 10", "o_orderkey % 7 > 0"
READS = f"""o as (select o_custkey % 40 as series, o_orderkey as guid, cast(o_orderdate as date) as day, date_trunc('month', cast(o_orderdate as date)) as win_from, o_orderkey from orders),
n as (select * from o where {NARROW}), w as (select * from o where {WIDE}),
m as (select series, cast(f as date) as win_from, last_day(cast(f as date)) as win_to from (select distinct series from o), generate_series(timestamp '1992-01-01', timestamp '1998-12-01', interval 1 month) as g(f)),
empty as (select * from m where (series, win_from) not in (select series, win_from from n)), filled as (select * from m where (series, win_from) in (select series, win_from from n))"""


def _reads(v):
    """Empty and filled months of forty series, and the rows of the narrow and the wide read."""
    day = F.to_date("o_orderdate")
    rows = v.table("orders").select((F.col("o_custkey") % 40).alias("series"), F.col("o_orderkey").alias("guid"), day.alias("day"), F.trunc(day, "month").alias("win_from"), "o_orderkey")
    narrow, wide = rows.filter(NARROW), rows.filter(WIDE)
    months = F.explode(F.sequence(F.lit("1992-01-01").cast("date"), F.lit("1998-12-01").cast("date"), F.expr("interval 1 month")))
    windows_ = rows.select("series").distinct().select("series", months.alias("win_from")).withColumn("win_to", F.last_day("win_from"))
    seen = narrow.select("series", "win_from").distinct()
    return windows_.join(seen, ["series", "win_from"], "left_anti"), windows_.join(seen, ["series", "win_from"], "left_semi"), narrow, wide


@query(f"""with {READS},
near as (select e.series, e.win_from, f.win_from as near_from, row_number() over (partition by e.series, e.win_from order by case when f.win_to < e.win_from then date_diff('day', f.win_to, e.win_from) else date_diff('day', e.win_to, f.win_from) end, f.win_from) as r from empty e join filled f on f.series = e.series),
control as (select near.series, near.win_from, min(n.guid) as guid from near join n on n.series = near.series and n.win_from = near.near_from where r = 1 group by 1, 2)
select e.series, cast(e.win_from as varchar) as win_from, case when c.guid is null then 'empty_date_partition_no_control' when c.guid % 7 = 0 then 'empty_date_witness_control_missing_row'
  when exists (select 1 from w where w.series = e.series and w.win_from = e.win_from) then 'empty_date_window_contradicted_by_wider_read' else 'corroborated' end as state
from empty e left join control c on c.series = e.series and c.win_from = e.win_from""")
def empty_corroboration(v):
    """Months without rows in one read: no control, a control row that isn't seen again, a row inside seen by a wider read, or corroborated."""
    empty, filled, narrow, wide = _reads(v)
    near = windows.nearest(empty, filled).filter("nearest_from is not null")
    first = narrow.groupBy(F.col("series").alias("_s"), F.col("win_from").alias("_w")).agg(F.min("guid").alias("guid"))
    control = near.join(first, (F.col("series") == F.col("_s")) & (F.col("nearest_from") == F.col("_w"))).select("series", "win_from", "guid")
    return op.corroborated(empty, control, narrow.filter(AGAIN), wide).select("series", F.col("win_from").cast("string").alias("win_from"), "state")


@query(f"with {READS} select w.series, w.guid, cast(e.win_from as varchar) as win from w join empty e on e.series = w.series and e.win_from = w.win_from")
def contradictions(v):
    """Rows of a wide read inside months that a narrow one gave as empty."""
    empty, _, _, wide = _reads(v)
    return op.contradicting(empty, wide.drop("win_from")).select("series", "guid", F.col("win_from").cast("string").alias("win"))


@query("select state, count(*) as windows from (select case when sid % 100 = 0 then 'mismatch' else 'passed' end as state from v_window where sid % 50 = 0 and strftime(odate, '%Y-%m') <> win union all select 'unavailable' from v_window_own where sid % 50 <> 0) group by state")
def stability_states(v):
    """Windows read again, field by field: passed, mismatch, or unavailable where there is no second read."""
    own = F.date_format("odate", "yyyy-MM") == F.col("win")
    first, again = v.window.filter(own).select("sid", "hash"), v.window.filter(~own).select(F.col("sid").alias("_sid"), F.col("hash").alias("_hash"))
    state = F.when(F.col("_hash").isNull(), "unavailable").when(F.col("hash") == F.col("_hash"), "passed").otherwise("mismatch")
    return first.join(again, F.col("sid") == F.col("_sid"), "left").groupBy(state.alias("state")).agg(F.count("*").cast("long").alias("windows"))
