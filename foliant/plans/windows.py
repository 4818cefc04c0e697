"""Queries on windows, proofs, the mirror, telemetry and formats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, exact, ident
from ..operators import telemetry
from ..operators import splits
from ..operators import windows as op
from .registry import query

AS_OF = "date '1998-12-31'"


@query("with t as (select n_nationkey as series, date '1997-04-01' as first, cast(date '1997-04-01' + to_days(cast(n_nationkey * 17 as integer)) as date) as last from nation), u as (select series, first, last, unnest(range(0, date_diff('day', first, last) + 1, 31)) as k from t) select series, cast(cast(first + to_days(cast(k as integer)) as date) as varchar) as \"from\", cast(least(cast(first + to_days(cast(k + 30 as integer)) as date), last) as varchar) as \"to\" from u")
def date_tiles(v):
    """Tiles of at most 31 days, for periods of several lengths."""
    first = F.lit("1997-04-01").cast("date")
    rows = v.table("nation").select(F.col("n_nationkey").alias("series"), F.explode(dates.tiles(first, F.date_add(first, F.col("n_nationkey") * 17))).alias("t"))
    return rows.select("series", F.col("t.from").cast("string").alias("from"), F.col("t.to").cast("string").alias("to"))


@query("select o_orderkey as window_key, cast(f as varchar) as \"from\", cast(t as varchar) as \"to\", cast(case when t > f then cast(f + to_days(cast(date_diff('day', f, t) // 2 as integer)) as date) end as varchar) as left_to, cast(case when t > f then cast(f + to_days(cast(date_diff('day', f, t) // 2 + 1 as integer)) as date) end as varchar) as right_from from (select o_orderkey, cast(o_orderdate as date) as f, cast(cast(o_orderdate as date) + to_days(cast(o_orderkey % 40 as integer)) as date) as t from orders)")
def midpoint_split(v):
    f = F.to_date("o_orderdate")
    rows = v.table("orders").select(F.col("o_orderkey").alias("window_key"), f.alias("f"), F.date_add(f, (F.col("o_orderkey") % 40).cast("int")).alias("t"))
    mid = dates.midpoint(F.col("f"), F.col("t"))
    return rows.select("window_key", F.col("f").cast("string").alias("from"), F.col("t").cast("string").alias("to"), mid.cast("string").alias("left_to"), F.date_add(mid, 1).cast("string").alias("right_from"))


@query("select k // 1000 as tile, k // 1000 * 1000 as range_start, k // 1000 * 1000 + 1000 as range_end, count(*) as vouchers from (select o_orderkey - 1 as k from orders) group by 1, 2, 3")
def alter_ranges(v):
    """Vouchers per half-open id range (start, end]."""
    tile = F.call_function("div", F.col("o_orderkey") - 1, F.lit(1000).cast("long"))
    return v.table("orders").groupBy(tile.alias("tile")).agg(F.count("*").cast("long").alias("vouchers")).select("tile", (F.col("tile") * 1000).alias("range_start"), (F.col("tile") * 1000 + 1000).alias("range_end"), "vouchers")


TILES = "(select c_nationkey as series, c_custkey * 10 + case when c_custkey % 211 = 0 then 1 else 0 end as s, n * 10 as e, last from (select c_nationkey, c_custkey, coalesce(lead(c_custkey) over (partition by c_nationkey order by c_custkey), c_custkey + 1) as n, max(c_custkey) over (partition by c_nationkey) * 10 + 10 as last from customer))"


@query(f"select series, count(*) as tiles, count(*) filter (where case when prev is null then s <> first else s <> prev end) as gaps, max(e) = max(last) as complete from (select *, lag(e) over (partition by series order by s, e) as prev, 10 as first from {TILES}) group by series")
def contiguity(v):
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    k = F.col("c_custkey")
    tiles = v.table("customer").select(F.col("c_nationkey").alias("series"), (k * 10 + F.when(k % 211 == 0, 1).otherwise(0)).alias("s"), (F.coalesce(F.lead(k).over(w), k + 1) * 10).alias("e"), (F.max(k).over(Window.partitionBy("c_nationkey")) * 10 + 10).alias("last"))
    return op.contiguity(tiles, ["series"], "s", "e", 10, F.col("last"))


MONTHS = "(select n_nationkey as series, unnest(range(0, 24)) as m from nation)"
WINS = f"(select series, cast(date '1997-01-01' + to_months(cast(m as integer)) as date) as win_from, cast(date '1997-01-01' + to_months(cast(m + 1 as integer)) - to_days(1) as date) as win_to, (m * 7 + series) % 3 = 0 as filled from {MONTHS})"


@query(f"select e.series, cast(e.win_from as varchar) as win_from, cast(f.win_from as varchar) as nearest_from, cast(greatest(date_diff('day', f.win_to, e.win_from), date_diff('day', e.win_to, f.win_from)) as bigint) as gap_days from (select * from {WINS} where not filled) e join (select * from {WINS} where filled) f on f.series = e.series qualify row_number() over (partition by e.series, e.win_from order by greatest(date_diff('day', f.win_to, e.win_from), date_diff('day', e.win_to, f.win_from)), f.win_from) = 1")
def nearest_partition(v):
    """Empty months with the nearest month that has vouchers."""
    first = F.lit("1997-01-01").cast("date")
    rows = v.table("nation").select(F.col("n_nationkey").alias("series"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("m"))
    rows = rows.select("series", F.add_months(first, F.col("m")).alias("win_from"), F.date_sub(F.add_months(first, F.col("m") + 1), 1).alias("win_to"), ((F.col("m") * 7 + F.col("series")) % 3 == 0).alias("filled"))
    found = op.nearest(rows.filter("not filled"), rows.filter("filled"))
    return found.select("series", F.col("win_from").cast("string").alias("win_from"), F.col("nearest_from").cast("string").alias("nearest_from"), "gap_days")


COVER = "case when date_diff('day', win_from, win_to) < 30 then [{'f': win_from, 't': cast(win_from + to_days(30) as date)}] else [{'f': cast(win_from - to_days(1) as date), 't': cast(win_from + to_days(29) as date)}, {'f': cast(win_from + to_days(1) as date), 't': cast(win_from + to_days(31) as date)}] end"


@query(f"select series, cast(win_from as varchar) as win_from, cast(win_to as varchar) as win_to, array_to_string([strftime(x.f, '%Y-%m-%d') || '..' || strftime(x.t, '%Y-%m-%d') for x in {COVER}], ',') as slices, date_diff('day', win_from, win_to) + 1 as days, date_diff('day', win_from, win_to) + 1 as covered from {WINS}")
def interval_cover(v):
    """One or two other windows of at most 31 days that jointly cover a month: their slices, and the month's days they hold."""
    first = F.lit("1997-01-01").cast("date")
    rows = v.table("nation").select(F.col("n_nationkey").alias("series"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("m"))
    rows = rows.select("series", F.add_months(first, F.col("m")).alias("win_from"), F.date_sub(F.add_months(first, F.col("m") + 1), 1).alias("win_to"))
    rows = rows.withColumn("c", dates.witness_cover(F.col("win_from"), F.col("win_to")))
    days = F.sequence("win_from", "win_to")
    held = F.filter(days, lambda d: F.exists("c", lambda x: (d >= x["from"]) & (d <= x["to"])))
    text = F.array_join(F.transform("c", lambda x: F.concat_ws("..", x["from"].cast("string"), x["to"].cast("string"))), ",")
    return rows.select("series", F.col("win_from").cast("string").alias("win_from"), F.col("win_to").cast("string").alias("win_to"), text.alias("slices"), F.size(days).cast("long").alias("days"), F.size(held).cast("long").alias("covered"))


@query("select distinct 'window:' || substr(sha256('window' || chr(0) || 'core' || chr(0) || strftime(o_orderdate, '%Y-%m-01') || chr(0) || strftime(o_orderdate, '%Y-%m-%d')), 1, 24) as id from orders")
def window_ids(v):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return v.table("orders").select(ident.window_id(F.lit("core"), F.date_format("o_orderdate", "yyyy-MM-01"), day).alias("id")).distinct()


@query("select win, sha256(string_agg(low, '' order by p)) as digest, cast(sum(n) as bigint) as records from (select win, d[:3] as p, sha256(string_agg(d, '' order by d)) as low, count(*) as n from (select win, sha256(length(cast(sid as varchar)) || ':' || sid || length(hash) || ':' || hash) as d from v_window) group by win, p) group by win")
def canonical_window_hash(v):
    """One digest a window, whatever the order of its records."""
    return op.ordered_digest(v.window, ["win"], F.col("sid").cast("string"), F.col("hash"))


@query("select win, count(*) as parsed, count(distinct sid) as identities, count(*) filter (where strftime(odate, '%Y-%m') <> win) as out_of_range, case when count(*) > count(distinct sid) then 'duplicates' else 'unique' end as state from v_window group by win")
def window_counts(v):
    n, d = F.count("*"), F.count_distinct("sid")
    return v.window.groupBy("win").agg(n.cast("long").alias("parsed"), d.cast("long").alias("identities"), F.count_if(F.date_format("odate", "yyyy-MM") != F.col("win")).cast("long").alias("out_of_range"), F.when(n > d, "duplicates").otherwise("unique").alias("state"))


@query("select sid, case when hashes > 1 then 'source_changed_during_snapshot' else 'duplicate_record_across_windows' end as code from (select sid, count(distinct win) as windows, count(distinct hash) as hashes from v_window group by sid) where windows > 1")
def cross_window_duplicates(v):
    return op.across(v.window)


EVIDENCE = """(select p_partkey % 97 as run, p_partkey, p_size + 10 as parsed, p_size + 10 - case when p_partkey % 13 = 0 then 1 else 0 end as accepted, case when p_partkey % 13 = 0 and p_partkey % 2 = 0 then 1 else 0 end as rejected,
p_size + 10 - case when p_partkey % 13 = 0 then 1 else 0 end - case when p_partkey % 17 = 0 then 2 else 0 end as deduped, case when p_partkey % 17 = 0 and p_partkey % 3 <> 0 then 2 else 0 end as duplicates, case when p_partkey % 19 = 0 then 1 else 0 end as out_of_range,
case when p_partkey % 23 <> 0 then p_size + 10 end as source_count, case when p_partkey % 5 = 0 then 'window' else 'complete' end as source_scope, case p_partkey % 97 % 3 when 0 then 'passed' when 1 then 'mismatch' else 'unavailable' end as stability from part)"""


@query(f"""with e as (select * from {EVIDENCE}), g as (select run, 'parse_accept_count_mismatch' as gap from e where parsed <> accepted + rejected union select run, 'accept_dedupe_count_mismatch' from e where accepted < deduped or accepted - deduped <> duplicates union select run, 'rejected_snapshot_records' from e where rejected > 0
union select run, 'duplicate_source_identity' from e where duplicates > 0 union select run, 'response_date_outside_window' from e where out_of_range > 0 union select run, 'source_count_unavailable' from e where source_count is null union select run, 'window_source_accepted_count_mismatch' from e where source_scope = 'window' and source_count <> deduped
union select run, 'source_count_window_only' from e where source_scope = 'window' union select run, case stability when 'passed' then 'source_cut_atomicity_unavailable' when 'mismatch' then 'source_changed_during_run' else 'source_cut_consistency_unavailable' end from e)
select r.run, coalesce(gaps, '') as gaps, case when gaps is null then 'verified' else 'partial' end as state from (select distinct run from e) r left join (select run, string_agg(distinct gap, ',' order by gap) as gaps from g group by run) s on s.run = r.run""")
def reconciliation_gaps(v):
    """Gap codes of runs; a passed stability read still leaves the cut's atomicity open, so no run is verified."""
    k, n = F.col("p_partkey"), F.col("p_size") + 10
    off = lambda c, a: F.when(c, a).otherwise(0)
    accepted = n - off(k % 13 == 0, 1)
    run = k % 97
    rows = v.table("part").select(
        run.alias("run"), n.alias("parsed"), accepted.alias("accepted"), off((k % 13 == 0) & (k % 2 == 0), 1).alias("rejected"), (accepted - off(k % 17 == 0, 2)).alias("deduped"), off((k % 17 == 0) & (k % 3 != 0), 2).alias("duplicates"), off(k % 19 == 0, 1).alias("out_of_range"),
        F.when(k % 23 != 0, n).alias("source_count"), F.when(k % 5 == 0, "window").otherwise("complete").alias("source_scope"), F.when(run % 3 == 0, "passed").when(run % 3 == 1, "mismatch").otherwise("unavailable").alias("stability"),
    )
    return op.gap_codes(rows)


@query("select user_id as company, count(*) as proofs, count(*) filter (where event_type = 'error') as failed, case when count(*) filter (where event_type = 'error') > 0 then 'unverified' when count(*) filter (where event_type = 'view') > 0 then 'partial' else 'verified' end as state from events group by user_id")
def proof_state(v):
    """Per company: failed runs make it unverified, gaps partial, neither verified."""
    bad, gap = F.count_if(F.col("event_type") == "error"), F.count_if(F.col("event_type") == "view")
    return v.table("events").groupBy(F.col("user_id").alias("company")).agg(F.count("*").cast("long").alias("proofs"), bad.cast("long").alias("failed"), F.when(bad > 0, "unverified").when(gap > 0, "partial").otherwise("verified").alias("state"))


CHAIN = "(select o_custkey as chain, o_orderkey as seq, cast(o_orderkey as varchar) as payload, sha256('e' || o_orderkey) as base from orders)"
CHAINED = f"(select chain, seq, payload, coalesce(lag(own) over (partition by chain order by seq), 'genesis') as before, own, case when seq % 211 = 0 then 'forged' else coalesce(lag(own) over (partition by chain order by seq), 'genesis') end as prev_hash from (select *, base as own from {CHAIN}))"


@query(f"select chain, count(*) as entries, count(*) filter (where prev_hash <> before) as broken_links, count(*) filter (where own <> sha256(prev_hash || '|' || payload)) as broken_entries from {CHAINED} group by chain")
def hash_chain_check(v):
    """Chains of proofs: links and own digests verified against the entry before."""
    w = Window.partitionBy("chain").orderBy("seq")
    rows = v.table("orders").select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("payload"), F.sha2(F.concat(F.lit("e"), F.col("o_orderkey").cast("string")), 256).alias("entry_hash"))
    linked = rows.withColumn("prev_hash", F.when(F.col("seq") % 211 == 0, "forged").otherwise(F.coalesce(F.lag("entry_hash").over(w), F.lit("genesis"))))
    return op.chain(linked)


@query("with o as (select sid, win, hash, row_number() over (partition by sid order by hash, win) as n, count(*) over (partition by sid) as c from v_window) select sid, win, hash, c - 1 as dropped from o where n = 1")
def staged_dedupe(v):
    """Of an identity's observations the first by digest is staged."""
    rows = v.window.withColumn("dropped", (F.count("*").over(Window.partitionBy("sid")) - 1).cast("long"))
    return op.latest(rows, ["sid"], [F.col("hash"), F.col("win")]).select("sid", "win", "hash", "dropped")


@query("select event_id, user_id, row_number() over (partition by user_id, event_type order by ts, event_id) as attempt from events")
def attempt_ordinals(v):
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return v.table("events").select("event_id", "user_id", n.cast("long").alias("attempt"))


@query("select sid, win from v_window a where sid % 10 < 7 and not exists (select 1 from v_window b where b.sid = a.sid and b.win = a.win and b.sid % 10 > 2)")
def disappeared_members(v):
    """Members of the attempt before that the present one has not seen again."""
    before, now = v.window.filter("sid % 10 < 7").select("sid", "win"), v.window.filter("sid % 10 > 2").select("sid", "win")
    return before.join(now, ["sid", "win"], "left_anti")


@query("select company, cast(epoch(timestamp '2024-01-15 00:00:00') - floor(epoch(last)) as bigint) as age_s, case when last is null then 'never_verified' when epoch(timestamp '2024-01-15 00:00:00') - floor(epoch(last)) < 0 then 'clock_moved_backwards' when epoch(timestamp '2024-01-15 00:00:00') - floor(epoch(last)) <= 86400 then 'fresh' else 'stale' end as freshness from (select c_custkey as company, max(ts) as last from customer left join events on user_id = c_custkey and event_type = 'purchase' group by c_custkey)")
def freshness(v):
    """Age of the last verified run against the target of a day."""
    last = v.table("events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last"))
    rows = v.table("customer").select(F.col("c_custkey").alias("company")).join(last, F.col("company") == F.col("user_id"), "left")
    return op.freshness(rows, "last", F.lit("2024-01-15 00:00:00").cast("timestamp"), 86_400).select("company", "age_s", "freshness")


@query("select user_id, event_id, n as place from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n <= 3")
def latest_proofs(v):
    """The last three proofs of each company."""
    return op.latest(v.table("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "place")


@query("select o_orderkey, o_custkey from orders order by o_orderkey limit 100 offset 200")
def mirror_page(v):
    """A page of the mirror, by key."""
    return v.table("orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").offset(200).limit(100)


LATENCY = (1_000, 5_000, 10_000, 50_000, 100_000, 500_000, 1_000_000, 5_000_000)
BYTES = (1_024, 8_192, 16_384, 65_536, 262_144, 1_048_576)


def _place(column: str, bounds: tuple[int, ...]) -> str:
    return "case " + " ".join(f"when {column} <= {b} then {i}" for i, b in enumerate(bounds)) + f" else {len(bounds)} end"


@query(f"select class, outcome, cast({_place('latency_us', LATENCY)} as bigint) as bucket, count(*) as attempts from v_attempt group by 1, 2, 3")
def latency_histogram(v):
    return telemetry.histogram(v.attempt, "latency_us", LATENCY)


@query(f"select class, outcome, cast({_place('bytes', BYTES)} as bigint) as bucket, count(*) as attempts from v_attempt group by 1, 2, 3")
def byte_histogram(v):
    return telemetry.histogram(v.attempt, "bytes", BYTES)


@query("select case when n = 0 then '0' when n = 1 then '1' when n <= 5 then '2-5' when n <= 20 then '6-20' when n <= 100 then '21-100' when n <= 1000 then '101-1000' else '>1000' end as bucket, count(*) as companies from (select c_custkey, count(event_id) as n from customer left join events on user_id = c_custkey group by c_custkey) group by 1")
def count_buckets(v):
    n = v.table("events").groupBy("user_id").agg(F.count("*").alias("n"))
    rows = v.table("customer").join(n, F.col("c_custkey") == F.col("user_id"), "left")
    return rows.groupBy(telemetry.count_bucket(F.coalesce("n", F.lit(0))).alias("bucket")).agg(F.count("*").cast("long").alias("companies"))


@query("select user_id as series, count(*) filter (where coalesce(a < b and b < c and c >= 0.5 and c - a >= 0.1, false)) as stops from (select user_id, lag(value, 2) over w as a, lag(value) over w as b, value as c from events window w as (partition by user_id order by ts, event_id)) group by user_id")
def trend_guard(v):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = v.table("events").select(F.col("user_id").alias("series"), F.row_number().over(w).alias("seq"), F.col("value").alias("seconds"))
    return op.trend(rows, 0.1, 0.5).groupBy("series").agg(F.count_if("stop").cast("long").alias("stops"))


@query("select source, lang, count(*) as files, cast(sum(octet_length(encode(coalesce(text, '')))) as bigint) as bytes, count(*) filter (where octet_length(encode(coalesce(text, ''))) = 0) as skipped from documents group by source, lang")
def document_scan(v):
    """Documents admitted, by source and language; empty ones are skipped."""
    n = F.octet_length(F.coalesce("text", F.lit("")))
    return v.table("documents").groupBy("source", "lang").agg(F.count("*").cast("long").alias("files"), F.sum(n).cast("long").alias("bytes"), F.count_if(n == 0).cast("long").alias("skipped"))


@query("select sha256(coalesce(text, '')) as digest, count(*) as copies, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def document_duplicates(v):
    return v.table("documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).agg(F.count("*").cast("long").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


NEED = (("core", "ledger", "name"), ("core", "voucher", "date"), ("core", "voucher", "number"), ("bills", "bill", "reference"), ("bills", "bill", "due_date"), ("tax", "registration", "gstin"), ("inventory", "item", "name"), ("inventory", "item", "unit"))
SEEN = "select 'ledger' as object, 'name' as field, count(c_name) as n from customer union all select 'voucher', 'date', count(o_orderdate) from orders union all select 'voucher', 'number', count(o_orderkey) from orders union all select 'bill', 'reference', count(reference) from v_bill union all select 'bill', 'due_date', count(due_date) from v_bill union all select 'item', 'name', count(p_name) from part"


@query(f"with need as (select * from (values {', '.join(map(str, NEED))}) t(pack, object, field)), seen as ({SEEN}) select pack, count(*) as required, count(*) filter (where coalesce(n, 0) = 0) as missing, case when count(*) filter (where coalesce(n, 0) = 0) = 0 then 'supported' else 'unobserved' end as state from need left join seen s on s.object = need.object and s.field = need.field group by pack")
def pack_coverage(v):
    """Required fields of each pack that no record of the books has."""
    need = v.spark.createDataFrame(list(NEED), "pack string, object string, field string")

    def seen(table, object_, **fields):
        counts = table.agg(*[F.count(c).alias(f) for f, c in fields.items()])
        pairs = F.array(*[F.struct(F.lit(object_).alias("object"), F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields])
        return counts.select(F.explode(pairs).alias("x")).select("x.*")

    found = seen(v.table("customer"), "ledger", name="c_name").unionByName(seen(v.table("orders"), "voucher", date="o_orderdate", number="o_orderkey"))
    found = found.unionByName(seen(v.bill, "bill", reference="reference", due_date="due_date")).unionByName(seen(v.table("part"), "item", name="p_name"))
    lost = F.count_if(F.coalesce("n", F.lit(0)) == 0)
    return need.join(found, ["object", "field"], "left").groupBy("pack").agg(F.count("*").cast("long").alias("required"), lost.cast("long").alias("missing"), F.when(lost == 0, "supported").otherwise("unobserved").alias("state"))


CELLS = "(select p_partkey, case p_partkey % 6 when 0 then '=' || p_name when 1 then '+1' when 2 then '@' || p_brand when 3 then p_name || ', \"' || p_brand || '\"' when 4 then '-' || p_size else p_name end as cell from part)"


@query(f"select p_partkey, cell, case when regexp_matches(g, '[\",\r\n]') then '\"' || replace(g, '\"', '\"\"') || '\"' else g end as written from (select *, case when regexp_matches(cell, '^[=+\\-@\t\r]') then '''' || cell else cell end as g from {CELLS})")
def csv_guard(v):
    """Text cells as written to CSV: formula starts are guarded, quotes doubled."""
    k = F.col("p_partkey") % 6
    size = F.col("p_size").cast("string")
    cell = F.when(k == 0, F.concat(F.lit("="), "p_name")).when(k == 1, "+1").when(k == 2, F.concat(F.lit("@"), "p_brand")).when(k == 3, F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))).when(k == 4, F.concat(F.lit("-"), size)).otherwise(F.col("p_name"))
    return v.table("part").select("p_partkey", cell.alias("cell")).withColumn("written", ident.csv_cell(ident.csv_guard(F.col("cell"))))


@query("select key, case when amount < 0 then '-' else '' end || case when length(w) <= 3 then w else regexp_replace(reverse(regexp_replace(reverse(left(w, length(w) - 3)), '(\\d{2})', '\\1,', 'g')), '^,', '') || ',' || right(w, 3) end || '.' || c as formatted, case when abs(amount) >= 10000000 then cast(cast(abs(amount) / 10000000 as decimal(18,2)) as varchar) || ' cr' when abs(amount) >= 100000 then cast(cast(abs(amount) / 100000 as decimal(18,2)) as varchar) || ' L' else cast(abs(amount) as varchar) end as compact from (select *, split_part(cast(abs(amount) as varchar), '.', 1) as w, split_part(cast(abs(amount) as varchar), '.', 2) as c from (select o_orderkey as key, cast(case when o_orderkey % 2 = 0 then -1 else 1 end * case o_orderkey % 4 when 0 then 1000 when 1 then 1 when 2 then 100000000 else 10 end * cast(o_totalprice as decimal(18,2)) as decimal(18,2)) as amount from orders where o_orderkey % 4 <> 0 or true))")
def inr_format(v):
    k = F.col("o_orderkey")
    scale = F.when(k % 4 == 0, 1000).when(k % 4 == 1, 1).when(k % 4 == 2, 100_000_000).otherwise(10)
    amount = (F.when(k % 2 == 0, -1).otherwise(1) * scale * F.col("o_totalprice").cast(exact.MONEY)).cast(exact.MONEY)
    rows = v.table("orders").select(k.alias("key"), amount.alias("amount"))
    return rows.select("key", exact.grouped_indian(F.col("amount")).alias("formatted"), exact.compact_indian(F.col("amount")).alias("compact"))


LEXEMES = "(select o_orderkey as key, case o_orderkey % 7 when 0 then '00' || cast(cast(o_totalprice as decimal(18,2)) as varchar) when 1 then '-0.00' when 2 then cast(o_orderkey as varchar) || '00.500' when 3 then '-' || o_orderkey || '.0' when 4 then '+5' when 5 then '1e3' else o_orderkey || '000' end as lexeme from orders)"


@query(f"select key, lexeme, case when regexp_full_match(lexeme, '-?[0-9]+(\\.[0-9]+)?') then case when s2 in ('-0', '0', '-') then '0' else s2 end end as canonical from (select *, case when contains(s1, '.') then regexp_replace(s1, '\\.?0+$', '') else s1 end as s2 from (select *, regexp_replace(lexeme, '^(-?)0+([0-9])', '\\1\\2') as s1 from {LEXEMES}))")
def canonical_decimal(v):
    k = F.col("o_orderkey")
    t = k.cast("string")
    lexeme = F.when(k % 7 == 0, F.concat(F.lit("00"), F.col("o_totalprice").cast(exact.MONEY).cast("string"))).when(k % 7 == 1, "-0.00").when(k % 7 == 2, F.concat(t, F.lit("00.500"))).when(k % 7 == 3, F.concat(F.lit("-"), t, F.lit(".0"))).when(k % 7 == 4, "+5").when(k % 7 == 5, "1e3").otherwise(F.concat(t, F.lit("000")))
    return v.table("orders").select(k.alias("key"), lexeme.alias("lexeme")).withColumn("canonical", exact.canonical(F.col("lexeme")))


IDS = "(select c_custkey as key, case c_custkey % 5 when 0 then '27ABCDE' || lpad(cast(c_custkey % 10000 as varchar), 4, '0') || 'F1Z5' when 1 then '27abcde1234f1z5' when 2 then 'ABCDE1234F' when 3 then ' padded' else sha256(c_name) end as id from customer)"


@query(f"select key, regexp_full_match(id, '[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][0-9A-Z]Z[0-9A-Z]') as tax_number, regexp_full_match(upper(id), '[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][0-9A-Z]Z[0-9A-Z]') as tax_number_any_case, regexp_full_match(id, '[A-Z]{{5}}[0-9]{{4}}[A-Z]') as permanent_number, trim(id) = id and length(id) between 1 and 512 as canonical_text, regexp_full_match(id, '[0-9a-f]{{64}}') as sha256_shape from {IDS}")
def id_validators(v):
    """Shape checks; two checks of tax numbers differ in case, on purpose."""
    k = F.col("c_custkey")
    made = F.when(k % 5 == 0, F.concat(F.lit("27ABCDE"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("F1Z5"))).when(k % 5 == 1, "27abcde1234f1z5").when(k % 5 == 2, "ABCDE1234F").when(k % 5 == 3, " padded").otherwise(F.sha2("c_name", 256))
    c = F.col("id")
    return v.table("customer").select(k.alias("key"), made.alias("id")).select("key", ident.tax_number(c).alias("tax_number"), ident.tax_number_any_case(c).alias("tax_number_any_case"), ident.permanent_number(c).alias("permanent_number"), ident.canonical_text(c).alias("canonical_text"), ident.sha256_shape(c).alias("sha256_shape"))


@query("select o_orderkey as key, case o_orderkey % 4 when 0 then cast(cast(o_orderdate as date) as varchar) when 1 then cast(cast(o_orderdate as date) as varchar) end as compact_date, cast(case when o_orderkey % 4 <> 3 and cast(o_orderdate as date) between date '1995-01-01' and date '1999-12-31' then cast(o_orderdate as date) end as varchar) as display_date from orders")
def date_parsing(v):
    """Both wire forms of a date; those outside the books, or malformed, give null."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    compact = F.when(k % 4 <= 1, F.date_format(d, "yyyyMMdd")).when(k % 4 == 2, "20260230").otherwise("2026")
    display = F.when(k % 4 == 3, "31-Foo-98").otherwise(F.date_format(d, "d-MMM-yy"))
    rows = v.table("orders").select(k.alias("key"), dates.parse_compact(compact).cast("string").alias("compact_date"), dates.parse_display(display, F.lit("1995-01-01").cast("date"), F.lit("1999-12-31").cast("date")).cast("string").alias("display_date"))
    return rows


@query("select s_suppkey as key, regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from supplier")
def party_slugs(v):
    return v.table("supplier").select(F.col("s_suppkey").alias("key"), ident.slug(F.col("s_name")).alias("slug"))


@query(
    """with o as (select o_orderkey % 5 as run, cast(o_orderdate as date) as day from orders), m as (select count(*) // 200 + 1 as most from orders),
t as (select run, sha256('window' || chr(0) || 'plan' || chr(0) || '1992-01-01' || chr(0) || '1998-12-31') as h, cast(null as varchar) as parent, 0 as depth, date '1992-01-01' as first, date '1998-12-31' as last from (select distinct run from o)
union all select run, sha256('window' || chr(0) || 'window:' || left(h, 24) || chr(0) || a || chr(0) || z), 'window:' || left(h, 24), depth + 1, a, z
from (select t.*, unnest([first, cast(first + to_days(cast(date_diff('day', first, last) // 2 + 1 as integer)) as date)]) as a, unnest([cast(first + to_days(cast(date_diff('day', first, last) // 2 as integer)) as date), last]) as z
  from t where last > first and (select count(*) from o where o.run = t.run and o.day between t.first and t.last) > (select most from m))),
n as (select t.*, (select count(*) from o where o.run = t.run and o.day between t.first and t.last) as records from t)
select run, 'window:' || left(h, 24) as id, parent, depth, cast(first as varchar) as first, cast(last as varchar) as last, records, case when records <= (select most from m) then 'leaf' when last = first then 'minimum_reached' else 'split' end as state from n""",
    recursive=True,
)
def split_trees(v):
    """Five runs over seven years, split until no window has more than a two-hundredth of all orders."""
    orders = v.table("orders").select((F.col("o_orderkey") % 5).alias("run"), F.to_date("o_orderdate").alias("day"))
    days = orders.groupBy("run", "day").agg(F.count("*").alias("n"))
    planned = orders.select("run").distinct().select("run", F.lit("1992-01-01").cast("date").alias("first"), F.lit("1998-12-31").cast("date").alias("last"))
    most = orders.count() // 200 + 1
    return splits.split_tree(planned, days, most).withColumns({c: F.col(c).cast("string") for c in ("first", "last")})
