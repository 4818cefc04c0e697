"""Queries on raw captures and on the attempt stream; captures are rendered from the tables first."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import captures, chunks, shared, strict
from ..streaming import breaker, snapshot
from .registry import query

DAY_US = 86_400_000_000
NUMBERS = (0, 8, 9, 10, 11, 12, 13, 14, 31, 32, 55295, 55296, 57343, 57344, 65533, 65534, 65535, 65536, 1114111, 1114112, 99999999)


def _money(column: str):
    return F.col(column).cast("decimal(18,2)")


@query("select c_name as name, 'Nation ' || c_nationkey as parent, cast(case when c_custkey % 10 = 0 then 0 else c_acctbal end as decimal(18,2)) as closing_balance, cast(0 as decimal(18,2)) as opening_balance, case when c_custkey % 17 <> 0 then c_custkey % 3 <> 0 end as bill_wise_on, case when c_custkey % 17 = 0 then 'missing_flag' end as reason from customer")
def xml_ledger_rows(v):
    """Ledger snapshots of 100 customers each, written as XML and read back."""
    k = F.col("c_custkey")
    balance = F.when(k % 10 == 0, "").otherwise(_money("c_acctbal").cast("string"))
    flag = F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("<ISBILLWISEON>"), F.when(k % 3 == 0, "No").otherwise("Yes"), F.lit("</ISBILLWISEON>")))
    row = F.concat(F.lit('<LEDGER NAME="'), "c_name", F.lit('"><PARENT TYPE="String">Nation '), F.col("c_nationkey").cast("string"), F.lit("</PARENT>"), flag, F.lit('<CLOSINGBALANCE TYPE="Amount">'), balance, F.lit("</CLOSINGBALANCE><OPENINGBALANCE></OPENINGBALANCE></LEDGER>"))
    xml = F.concat(F.lit("<ENVELOPE><BODY><DESC><CMPINFO><LEDGER>0</LEDGER></CMPINFO></DESC><DATA><COLLECTION>"), F.array_join(F.collect_list("row"), ""), F.lit("</COLLECTION></DATA></BODY></ENVELOPE>"))
    return captures.ledgers(v.table("customer").select((k / 100).cast("long").alias("file"), row.alias("row")).groupBy("file").agg(xml.alias("xml")))


_legal = "(n in (9, 10, 13) or n between 32 and 55295 or n between 57344 and 65533 or n between 65536 and 1114111)"


@query(f"select n, case when {_legal} then '&#' || n || ';' else chr(65533) || '#' || n || ';' end as repaired, case when {_legal} then '&#x' else chr(65533) || '#x' end || format('{{:x}}', n) || ';' as repaired_hex, cast(case when {_legal} then 0 else 1 end as bigint) as replaced from (select distinct b + n_nationkey as n from nation, (select unnest([{', '.join(map(str, NUMBERS))}]) as b))")
def xml_repair(v):
    """References around the bounds of what XML allows, in decimal and hexadecimal."""
    rows = v.table("nation").select("n_nationkey", F.explode(F.array(*map(F.lit, NUMBERS))).alias("b")).select((F.col("b") + F.col("n_nationkey")).alias("n")).distinct()
    text, hexadecimal = (F.concat(F.lit(a), b, F.lit(";")) for a, b in (("&#", F.col("n").cast("string")), ("&#x", F.lower(F.hex("n")))))
    return rows.select("n", captures.repair(text).alias("repaired"), captures.repair(hexadecimal).alias("repaired_hex"), captures.repairs(text).alias("replaced"))


@query("select doc_id, case when text is not null then case doc_id % 4 when 0 then 'utf-8' when 2 then 'utf-16-be' else 'utf-16-le' end end as encoding, case when doc_id % 4 <> 3 then sha256(text) end as decoded_sha256, case when text is null then 'missing' when doc_id % 4 = 3 then 'malformed' end as reason from documents")
def utf16_decode(v):
    """Whole texts in three encodings, and some cut within a character."""
    kind, text = F.col("doc_id") % 4, F.col("text")
    mark = lambda b: F.unhex(F.lit(b))
    raw = (
        F.when(kind == 0, F.encode(text, "UTF-8"))
        .when(kind == 1, F.concat(mark("FFFE"), F.encode(text, "UTF-16LE")))
        .when(kind == 2, F.concat(mark("FEFF"), F.encode(text, "UTF-16BE")))
        .otherwise(F.concat(mark("FFFE"), F.encode(text, "UTF-16LE"), mark("41")))
    )
    found = captures.decode(v.table("documents").select("doc_id", raw.alias("raw")))
    return found.select("doc_id", "encoding", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"), "reason")


_step = f"o.failures >= {breaker.THRESHOLD} and a.at_us < o.last + {DAY_US}"


@query(
    f"""with a as (select cast(user_id as varchar) as endpoint, epoch_us(ts) as at_us, event_id as attempt_id, class = 'error' as failed, row_number() over (partition by user_id order by ts, event_id) as seq from v_attempt),
    o as (select endpoint, cast(0 as bigint) as seq, cast(0 as bigint) as at_us, cast(0 as bigint) as attempt_id, 'closed' as phase, cast(0 as bigint) as failures, cast(0 as bigint) as last from (select distinct endpoint from a)
    union all select a.endpoint, a.seq, a.at_us, a.attempt_id, case when {_step} then 'open' when o.failures >= {breaker.THRESHOLD} then 'half_open' else 'closed' end,
    case when {_step} then o.failures when a.failed then o.failures + 1 else 0 end, case when not ({_step}) and a.failed then a.at_us else o.last end from o join a on a.endpoint = o.endpoint and a.seq = o.seq + 1)
    select endpoint, at_us, attempt_id, phase, failures from o where seq > 0""",
    recursive=True,
)
def circuit_breaker_states(v):
    """Attempts as a stream of files in order of time, one a micro-batch, until all are read; the circuit stays open for a day."""
    spark = v.spark
    folder = shared.folder(spark, "breaker")
    rows = v.attempt.select(F.col("user_id").cast("string").alias("endpoint"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.col("event_id").alias("attempt_id"), F.when(F.col("class") == "error", "failure").otherwise("success").alias("outcome"))
    first, last = rows.agg(F.min("at_us"), F.max("at_us")).first()
    slices, width = 4, (0 if first is None else last - first) // 4 + 1
    for i in range(slices):
        rows.filter(F.call_function("div", F.col("at_us") - F.lit(first), F.lit(width)) == i).coalesce(1).write.mode("append").parquet(f"{folder}/attempts")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/attempts")
    found = breaker.states(stream, cooldown_us=DAY_US)
    found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(f"{folder}/states").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/states")


@query("""with d as (select doc_id, coalesce(text, '') as text, doc_id % 4 as how, doc_id % 10 = 7 as cut from documents),
w as (select *, len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) as pairs, strlen(text) as n from d),
s as (select *, case when how < 2 then n + 3 * how else 2 * (length(text) + pairs) + 2 end as bytes from w)
select doc_id, case when how < 2 then 'utf-8' when how = 2 then 'utf-16-le' else 'utf-16-be' end as encoding, how > 0 as marked, cast((bytes + case when cut then 1 else 0 end) // (97 + doc_id % 7) + 1 as bigint) as chunks,
case when not cut then cast(bytes as bigint) end as encoded_bytes, case when not cut then cast(n as bigint) end as decoded_bytes, case when not cut then sha256(text) end as decoded_sha256,
case when cut then case when how < 2 then 'invalid_utf8' when how = 2 then 'invalid_utf16le' else 'invalid_utf16be' end end as reason from s""")
def chunked_decode(v):
    """Documents as captures in four encodings, cut every hundred bytes or so, characters included; of every tenth the last one is cut short."""
    text, how = F.coalesce("text", F.lit("")), F.col("doc_id") % 4
    mark = lambda x: F.unhex(F.lit(x))
    raw = F.when(how == 0, F.encode(text, "UTF-8")).when(how == 1, F.concat(mark("EFBBBF"), F.encode(text, "UTF-8"))).when(how == 2, F.concat(mark("FFFE"), F.encode(text, "UTF-16LE"))).otherwise(F.concat(mark("FEFF"), F.encode(text, "UTF-16BE")))
    raw = F.when(F.col("doc_id") % 10 == 7, F.concat(raw, mark("C3"))).otherwise(raw)
    size = (97 + F.col("doc_id") % 7).cast("int")
    docs = v.table("documents").select("doc_id", raw.alias("raw"), size.alias("size"))
    number = F.explode(F.sequence(F.lit(0), F.call_function("div", F.octet_length("raw"), F.col("size")).cast("int")))
    cut = docs.select("doc_id", "raw", "size", number.alias("number")).select("doc_id", "number", F.substring("raw", F.col("number") * F.col("size") + 1, F.col("size")).alias("data"))
    return chunks.evidence(cut, "doc_id").drop("encoded_sha256")


STRICT = """case file % 16 when 3 then 'duplicate_field' when 4 then 'malformed_json' when 5 then 'resource_limit_exceeded' when 6 then 'too_large' when 7 then 'status_missing' when 8 then 'status_invalid' when 9 then 'application_rejected'
  when 10 then 'wrong_container' when 11 then 'profile_mismatch' when 12 then 'record_limit_exceeded' end"""


def _envelopes(rows, record, metadata):
    """``(file, json)`` of rows ``(k, file, ...)``; each sixteenth file has a fault of its own."""
    f = F.col("file") % 16
    per = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("k", record.alias("r")))).alias("l"))
    records = F.array_join(F.transform("l", lambda x: x["r"]), ",")
    more = F.when(f == 3, '"status":"1",').when(f == 5, F.concat(F.lit('"deep":'), F.repeat(F.lit("["), 40), F.repeat(F.lit("]"), 40), F.lit(","))).when(f == 6, F.concat(F.lit('"pad":"'), F.repeat(F.lit("x"), 70_000), F.lit('",'))).when(f == 10, '"extra":1,').otherwise("")
    status = F.when(f == 7, "").when(f == 8, '"status":1,').when(f == 9, '"status":"0",').otherwise('"status":"1",')
    own = F.when(f == 11, F.replace(metadata, F.lit("true"), F.lit("false"))).otherwise(metadata)
    twice = F.when(f == 12, F.concat(F.lit(","), F.array_join(F.array_repeat(records, 3), ","))).otherwise("")
    json = F.concat(F.lit("{"), more, status, F.lit('"data":{"metadata":'), own, F.lit(',"collection":['), records, twice, F.lit("]}"), F.when(f == 4, "").otherwise("}"))
    return per.select("file", json.alias("json"))


def _cell(kind, value):
    return F.concat(F.lit(f'{{"type":"{kind}","value":"'), value, F.lit('"}'))


@query(f"""with c as (select c_custkey as k, c_custkey // 9 as file, c_name, c_nationkey, c_acctbal, row_number() over (partition by c_custkey // 9 order by c_custkey) as n from customer), r as (select *, {STRICT} as bad from c)
select file, n as ordinal, case when k % 10 < 8 then c_name end as name, case when k % 10 < 8 and k % 3 > 0 then case when k % 3 = 1 then '' else 'nation ' || c_nationkey end end as parent, case when k % 10 < 8 then cast(cast(c_acctbal as decimal(18,2)) as varchar) end as closing,
cast(null as varchar) as opening, case when k % 10 < 8 then k % 4 end as languages, case k % 10 when 8 then 'profile_mismatch' when 9 then 'typed_value_mismatch' end as reason from r where bad is null
union all select distinct file, null, null, null, null, null, null, bad from r where bad is not null""")
def json_ledger_rows(v):
    """Ledgers in strict JSON: repeated keys, depth, size, status, containers and cells of another type are typed rows."""
    k = F.col("k")
    rows = v.table("customer").select(F.col("c_custkey").alias("k"), F.call_function("div", F.col("c_custkey"), F.lit(9)).alias("file"), "c_name", "c_nationkey", F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("bal"))
    parent = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(',"parent":'), _cell("String", F.when(k % 3 == 1, "").otherwise(F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))))))
    names = F.array_join(F.array_repeat(F.lit('"name"'), (k % 4).cast("int")), ",")
    languages = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(',"languagename":[{"name":[{"metadata":true,"type":"String"},'), names, F.lit("]}]")))
    closing = F.when(k % 10 == 9, _cell("Number", F.col("bal"))).otherwise(_cell("Amount", F.col("bal")))
    record = F.concat(F.lit('{"metadata":{"type":"'), F.when(k % 10 == 8, "Group").otherwise("Ledger"), F.lit('","name":"'), F.col("c_name"), F.lit('","reservedname":""}'), parent, F.lit(',"closingbalance":'), closing, languages, F.lit("}"))
    return strict.ledgers(_envelopes(rows, record, F.lit('{"is_mst_dep_type":true,"mst_dep_type":"8"}')), "file", limits=strict.Limits(bytes=60_000, records=18))


@query(f"""with o as (select o_orderkey as k, o_orderkey // 9 as file, *, row_number() over (partition by o_orderkey // 9 order by o_orderkey) as n from orders), r as (select *, {STRICT} as bad from o)
select file, n as ordinal, case when k % 10 < 7 then 'g' || k end as guid, case when k % 10 < 7 then 'r' || k end as remote_id, case when k % 10 < 7 then strftime(cast(o_orderdate as date), '%Y-%m-%d') end as vdate, case when k % 10 < 7 then 'Sales' end as kind, case when k % 10 < 7 then cast(cast(o_totalprice as decimal(18,2)) as varchar) end as amount,
case when k % 10 < 7 then k % 3 end as entries, case when k % 10 < 7 then 1 end as invoice_entries, case when k % 10 < 7 then k % 2 end as items, case when k % 10 < 7 then 2 * (k % 2) end as batches, case when k % 10 < 7 then k % 2 end as accounts, case when k % 10 < 7 then k % 4 end as bills,
case k % 10 when 7 then 'profile_mismatch' when 8 then 'typed_value_mismatch' when 9 then 'typed_value_mismatch' end as reason from r where bad is null
union all select distinct file, null, null, null, null, null, null, null, null, null, null, null, null, bad from r where bad is not null""")
def json_strict_vouchers(v):
    """Vouchers in strict JSON with nested lists; some have an unknown field, a date that is none, or an entry with an amount of another type."""
    k = F.col("k")
    rows = v.table("orders").select(F.col("o_orderkey").alias("k"), F.call_function("div", F.col("o_orderkey"), F.lit(9)).alias("file"), F.date_format(F.col("o_orderdate").cast("date"), "yyyyMMdd").alias("d"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("p"))
    many = lambda x, n: F.concat(F.lit("["), F.array_join(F.array_repeat(x, n.cast("int")), ","), F.lit("]"))
    amount = F.concat(F.lit('{"amount":'), _cell("Amount", F.col("p")), F.lit("}"))
    invoice = F.concat(F.lit('{"amount":'), F.when(k % 10 == 9, _cell("String", F.col("p"))).otherwise(_cell("Amount", F.col("p"))), F.lit(',"billallocations":'), many(amount, k % 4), F.lit("}"))
    item = F.concat(F.lit('{"batchallocations":'), many(amount, F.lit(2)), F.lit(',"accountingallocations":'), many(amount, F.lit(1)), F.lit("}"))
    record = F.concat(
        F.lit('{"metadata":{"type":"Voucher","remoteid":"r'), k.cast("string"), F.lit('","vchkey":"","vchtype":"Sales","objview":""},"guid":"g'), k.cast("string"), F.lit('","vouchertypename":"Sales","date":'),
        _cell("Date", F.when(k % 10 == 8, "19991332").otherwise(F.col("d"))), F.lit(',"amount":'), _cell("Amount", F.col("p")), F.when(k % 10 == 7, ',"unknown":1').otherwise(""),
        F.lit(',"allledgerentries":'), many(amount, k % 3), F.lit(',"ledgerentries":'), many(invoice, F.lit(1)), F.lit(',"allinventoryentries":'), many(item, k % 2), F.lit("}"),
    )
    found = strict.vouchers(_envelopes(rows, record, F.lit('{"is_cmp_dep_type":true,"cmp_locus":4,"cmp_dep_type":64}')), "file", limits=strict.Limits(bytes=60_000, records=18))
    return found.withColumn("vdate", F.col("vdate").cast("string"))


SCRIPT = ("prepare", "capability", "identity", "plan", "extract", "normalize", "validate", "stage", "reconcile", "commit_pending", snapshot.RECEIPT, "completed")
ALLOWED = ", ".join(f"('{a}', '{b}')" for a, follows in snapshot.FOLLOWS.items() for b in follows)


@query(
    f"""with e as (select cast(user_id as varchar) as run, row_number() over (partition by user_id order by ts, event_id) as seq, event_id from events),
    v as (select run, seq, event_id, case when event_id % 29 = 3 then 'extract' when event_id % 97 = 5 then 'cancelled' else ([{", ".join(f"'{s}'" for s in SCRIPT)}])[(seq - 1) % {len(SCRIPT)} + 1] end as event, 'f' || run || case when event_id % 5 = 0 then 'x' else '' end as facts from e),
    a as (select * from (values {ALLOWED}) as t(before, after)),
    s as (select run, cast(0 as bigint) as seq, '' as event, '' as phase, '' as outcome, cast(null as varchar) as held from (select distinct run from v)
    union all select v.run, v.seq, v.event,
    case when s.phase in {snapshot.TERMINAL} then s.phase when v.event in ('failed', 'cancelled') then v.event when v.event = 'receipt' and s.phase = 'commit_pending' then case when v.facts = s.held then 'proof' else 'failed' end when a.after is not null then v.event else s.phase end,
    case when s.phase in {snapshot.TERMINAL} then 'terminal' when v.event in ('failed', 'cancelled') then 'moved' when v.event = 'receipt' and s.phase = 'commit_pending' then case when v.facts = s.held then 'moved' else 'receipt_mismatch' end when a.after is not null then 'moved' else 'refused' end,
    case when a.after = 'commit_pending' then v.facts else s.held end
    from s join v on v.run = s.run and v.seq = s.seq + 1 left join a on a.before = s.phase and a.after = v.event)
    select run, seq, event, phase, outcome from s where seq > 0 union all select run, seq, event, 'any', 'replayed' from v where seq % 10 = 1 and event_id % 2 = 0""",
    recursive=True,
)
def snapshot_runs(v):
    """Events of runs in four parts, read by a stream that is started anew for each; some events come again in a later part."""
    spark = v.spark
    before = spark.conf.get(snapshot.STATE_STORE[0])
    spark.conf.set(*snapshot.STATE_STORE)
    folder = shared.folder(spark, "snapshot")
    place = Window.partitionBy("user_id").orderBy("ts", "event_id")
    script = F.element_at(F.array(*map(F.lit, SCRIPT)), ((F.col("seq") - 1) % len(SCRIPT) + 1).cast("int"))
    event = F.when(F.col("event_id") % 29 == 3, "extract").when(F.col("event_id") % 97 == 5, "cancelled").otherwise(script)
    rows = v.table("events").withColumn("seq", F.row_number().over(place).cast("long"))
    rows = rows.select(F.col("user_id").cast("string").alias("run"), "seq", F.col("ts").cast("timestamp").alias("at"), event.alias("event"), F.concat(F.lit("f"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 5 == 0, "x").otherwise("")).alias("facts"), "event_id")
    rows = shared.staged(rows, "snapshot-events")
    first, last = rows.agg(F.min("at"), F.max("at")).first()
    part = F.least(F.floor((F.unix_micros("at") - F.unix_micros(F.lit(first))) * 4 / (F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(first)) + 1)), F.lit(3)) if first else F.lit(0)
    again = rows.filter("seq % 10 = 1 and event_id % 2 = 0").withColumn("_part", F.lit(4))
    dealt = shared.staged(rows.withColumn("_part", part.cast("int")).unionByName(again), "snapshot-parts")
    out = None
    for i in range(5):
        dealt.filter(F.col("_part") == i).drop("_part", "event_id").write.mode("append").parquet(f"{folder}/events")
        stream = snapshot.outcomes(spark.readStream.schema(rows.drop("event_id").schema).parquet(f"{folder}/events"))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(f"{folder}/outcomes").awaitTermination()
        out = stream.schema
    spark.conf.set(snapshot.STATE_STORE[0], before)
    found = spark.read.schema(out).parquet(f"{folder}/outcomes")
    return found.withColumn("phase", F.when(F.col("outcome") == "replayed", "any").otherwise(F.col("phase")))
