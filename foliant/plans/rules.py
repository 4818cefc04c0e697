"""Queries on row rules and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exact, ident
from ..operators import order, rules, telemetry
from ..operators import outstandings as op
from .outstandings import CLIENT, PARTY, _clients
from .registry import query

M = "decimal(18,2)"
GUID = "case c_custkey % 5 when 0 then 'COMPANY-7-' || c_custkey when 1 then 'company-7-' when 2 then 'company-77-' || c_custkey when 3 then 'company-7-' || c_custkey else 'other-' || c_custkey end"


@query(f"select c_custkey as key, guid, lower(guid) like 'company-7-%' as native_bound, lower(guid) like 'company-7-%' and length(guid) > 10 as scan_bound from (select c_custkey, {GUID} as guid from customer)")
def company_binding(v):
    """Records of a company by the prefix of their id; a scan wants something after it."""
    k, s = F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    guid = F.when(k == 0, F.concat(F.lit("COMPANY-7-"), s)).when(k == 1, "company-7-").when(k == 2, F.concat(F.lit("company-77-"), s)).when(k == 3, F.concat(F.lit("company-7-"), s)).otherwise(F.concat(F.lit("other-"), s))
    rows = v.table("customer").select(F.col("c_custkey").alias("key"), guid.alias("guid"))
    company = F.lit("Company-7")
    return rows.select("key", "guid", ident.belongs_to(F.col("guid"), company, suffix=False).alias("native_bound"), ident.belongs_to(F.col("guid"), company).alias("scan_bound"))


@query("""with a as (select case vid % 6 when 0 then 'Advance' when 1 then 'Unclassified' else kind end as kind, case when vid % 2 = 0 then 'receivable' else 'payable' end as direction, amount from v_alloc),
m as (select kind, direction, case when kind in ('New Ref', 'On Account') then case direction when 'receivable' then amount < 0 else amount > 0 end when kind = 'Advance' then case direction when 'receivable' then amount > 0 else amount < 0 end else false end as ok from a)
select kind, direction, count(*) as allocations, count(*) filter (where ok) as matching from m group by kind, direction""")
def reference_directions(v):
    kind = F.when(F.col("vid") % 6 == 0, "Advance").when(F.col("vid") % 6 == 1, "Unclassified").otherwise(F.col("kind"))
    rows = v.alloc.select(kind.alias("kind"), F.when(F.col("vid") % 2 == 0, "receivable").otherwise("payable").alias("direction"), "amount")
    ok = rules.reference_direction_matches(F.col("kind"), F.col("amount"), F.col("direction"))
    return rows.groupBy("kind", "direction").agg(F.count("*").cast("long").alias("allocations"), F.count_if(ok).cast("long").alias("matching"))


_KINDS = ("On Account", "New Ref", "Agst Ref", "Advance", "Unclassified")


@query(f"""with r as (select o_orderkey as k, ['On Account', 'New Ref', 'Agst Ref', 'Advance', 'Unclassified'][1 + o_orderkey % 5] as kind, case when o_orderkey % 3 > 0 then 'B' || o_orderkey end as name, case when o_orderkey % 7 >= 4 then 'odd' end as raw,
case when o_orderkey % 4 > 0 then o_orderdate end as due, ['unavailable', 'observed', 'derived'][1 + o_orderkey % 3] as evidence, o_orderkey % 2 = 1 as complete, o_orderkey % 10 + o_orderkey % 3 as reported, o_orderkey % 10 + 1 as parsed from orders)
select kind, count(*) as bills, count(*) filter (where case kind when 'On Account' then name is null and raw is null when 'Unclassified' then raw is not null else name is not null and raw is null end) as reference_valid,
count(*) filter (where (evidence = 'unavailable') = (due is null)) as due_valid, count(*) filter (where case when complete then reported = parsed else reported >= parsed end) as count_valid from r group by kind""")
def bill_evidence(v):
    """Validity of references, of due dates and their evidence, and of source counts."""
    k = F.col("o_orderkey")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (k % n).cast("int"))
    rows = v.table("orders").select(
        pick(_KINDS, 5).alias("kind"), F.when(k % 3 > 0, F.concat(F.lit("B"), k.cast("string"))).alias("name"), F.when(k % 7 >= 4, "odd").alias("raw"),
        F.when(k % 4 > 0, F.col("o_orderdate")).alias("due"), pick(("unavailable", "observed", "derived"), 3).alias("evidence"),
        (k % 2 == 1).alias("complete"), (k % 10 + k % 3).alias("reported"), (k % 10 + 1).alias("parsed"),
    )
    c = F.col
    counts = {"reference_valid": rules.reference_valid(c("kind"), c("name"), c("raw")), "due_valid": rules.due_evidence_valid(c("due"), c("evidence")), "count_valid": rules.source_count_valid(c("complete"), c("reported"), c("parsed"))}
    return rows.groupBy("kind").agg(F.count("*").cast("long").alias("bills"), *[F.count_if(x).cast("long").alias(n) for n, x in counts.items()])


@query("""select n_nationkey as key, control, case when n_nationkey % 5 = 0 then 'À la ' || n_name end as suggestion from (select *, n_nationkey % 5 <> 4 as control from nation)""")
def foreign_text(v):
    """Misread text: characters that are bytes of UTF-8, with controls among them; plain controls; other scripts; broken bytes; clean text."""
    k, name = F.col("n_nationkey") % 5, F.col("n_name")
    text = (
        F.when(k == 0, F.concat(F.lit("Ã\u0080 la "), name)).when(k == 1, F.concat(name, F.lit("\tx")))
        .when(k == 2, F.concat(F.lit("你\u0001"), name)).when(k == 3, F.concat(F.lit("Ã\u0007"), name)).otherwise(name)
    )
    return v.table("nation").select(F.col("n_nationkey").alias("key"), text.rlike(r"\p{Cc}").alias("control"), rules.likely_spelling(text).alias("suggestion"))


@query("""with a as (select n_nationkey as key, n_nationkey % 5 as done, n_nationkey * 37 as entropy from nation), b as (select *, least(2000, case done when 0 then 250 else 250 * cast(pow(2, done - 1) as bigint) end) as base from a)
select key, case when done >= 3 then 0 else base + entropy % (base * 20 // 100 + 1) end as retry_ms, case done when 0 then 30 when 1 then 120 when 2 then 600 end as sync_s from b""")
def retry_delays(v):
    done, entropy = F.col("n_nationkey") % 5, F.col("n_nationkey") * 37
    return v.table("nation").select(F.col("n_nationkey").alias("key"), telemetry.retry_delay_ms(done, entropy).cast("long").alias("retry_ms"), telemetry.sync_backoff_s(done).alias("sync_s"))


@query("select c_custkey as key, case when c_custkey % 3 = 0 then 'g' || c_custkey when c_custkey % 5 = 0 then 'r' || c_custkey when c_custkey % 7 > 0 then 'm' || c_custkey end as identity, case when c_custkey % 3 = 0 then 'guid' when c_custkey % 5 = 0 then 'remote_id' when c_custkey % 7 > 0 then 'master_id' end as kind from customer")
def identity_preference(v):
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    guid, remote, master = F.when(k % 3 == 0, F.concat(F.lit("g"), s)).otherwise(" "), F.when(k % 5 == 0, F.concat(F.lit("r"), s)), F.when(k % 7 > 0, F.concat(F.lit("m"), s)).otherwise("")
    return v.table("customer").select(k.alias("key"), rules.preferred_identity(guid, remote, master).alias("x")).select("key", "x.identity", "x.kind")


@query(f"select c_custkey as key, case when c_custkey % 4 > 0 then cast(c_acctbal as {M}) end as scanned, case when c_custkey % 4 > 0 then cast(c_acctbal as {M}) else 0 end::{M} as snapshot, true as small_trips, c_custkey % 200 = 199 as large_trips from customer")
def money_forms(v):
    """An empty amount is absent in a scan and zero in a snapshot; a double gives small amounts back exactly, of large ones even whole numbers only."""
    text = F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal").cast(M).cast("string")).otherwise("")
    value = F.col("c_acctbal").cast(M)
    large = (F.lit("9999999999999999.99").cast(M) - F.col("c_custkey").cast(M) / 100).cast(M)
    return v.table("customer").select(F.col("c_custkey").alias("key"), exact.absent(text).alias("scanned"), exact.or_zero(text).alias("snapshot"), exact.rounds_trip(value).alias("small_trips"), exact.rounds_trip(large).alias("large_trips"))


@query("select n_nationkey as key, [' Yes', 'TRUE', '1', 'no', 'y', 'NO '][1 + n_nationkey % 6] as text, n_nationkey % 6 < 3 as loose, case n_nationkey % 6 when 0 then true when 3 then false when 5 then false end as strict from nation")
def boolean_forms(v):
    """Yes, true and 1 in a loose reading; yes and no only in a strict one."""
    text = F.get(F.array(*map(F.lit, (" Yes", "TRUE", "1", "no", "y", "NO "))), (F.col("n_nationkey") % 6).cast("int"))
    return v.table("nation").select(F.col("n_nationkey").alias("key"), text.alias("text"), ident.yes_true_one(text).alias("loose"), ident.yes_no(text).alias("strict"))


JSON = """'{"a":' || c_custkey || ',"inner":{"list":[{"x":' || c_nationkey || ',"y":null}],"name":"' || c_name || '"},"z":' || case when c_custkey % 2 = 0 then 'true' else 'null' end || '}'"""


@query(f"select key, json, sha256(json) as digest from (select c_custkey as key, {JSON} as json from customer)")
def canonical_json_rows(v):
    """Compact JSON with sorted keys at every depth, and its digest."""
    item = F.struct(F.lit(None).cast("string").alias("y"), F.col("c_nationkey").alias("x"))
    value = F.struct(F.when(F.col("c_custkey") % 2 == 0, True).alias("z"), F.struct(F.col("c_name").alias("name"), F.array(item).alias("list")).alias("inner"), F.col("c_custkey").alias("a"))
    rows = v.table("customer").select(F.col("c_custkey").alias("key"), value.alias("v"))
    json = rules.canonical_json(F.col("v"), rows.schema["v"].dataType)
    return rows.select("key", json.alias("json")).withColumn("digest", F.sha2("json", 256))


NAMES = "['report.PDF', 'sheet.xlsx', '.hidden.txt', 'tool.exe', 'photo.jpeg', 'noext', 'notes.tar.gz', 'run.LOG', 'a.b/data.json', 'page.xml', 'dir.d/.git/x.csv', 'pic.JPG'][1 + k % 12]"


@query(f"""with f as (select doc_id, n_chars, {NAMES} as path, doc_id as k from (select *, doc_id as k from documents)),
e as (select *, nullif(lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)), '') as ext from f)
select doc_id, path, ext, case ext when '.pdf' then 'application/pdf' when '.xlsx' then 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' when '.txt' then 'text/plain' when '.jpeg' then 'image/jpeg' when '.jpg' then 'image/jpeg' when '.json' then 'application/json' when '.xml' then 'application/xml' when '.csv' then 'text/csv' else 'application/octet-stream' end as mime,
case when n_chars <= 0 then 'empty' when n_chars > 4000 then 'too_large' when k % 12 in (2, 10) then 'hidden' when ext in ('.exe', '.log') then 'excluded_extension' end as left_out from e""")
def document_admission(v):
    """Documents as files: extension, type, and why a scan leaves one out."""
    names = ("report.PDF", "sheet.xlsx", ".hidden.txt", "tool.exe", "photo.jpeg", "noext", "notes.tar.gz", "run.LOG", "a.b/data.json", "page.xml", "dir.d/.git/x.csv", "pic.JPG")
    path = F.get(F.array(*map(F.lit, names)), (F.col("doc_id") % 12).cast("int"))
    rows = v.table("documents").select("doc_id", "n_chars", path.alias("path"))
    ext = rules.extension(F.col("path"))
    return rows.select("doc_id", "path", ext.alias("ext"), rules.mime_type(ext).alias("mime"), rules.admission(F.col("path"), F.col("n_chars"), 4000).alias("left_out"))


# Orders ------------------------------------------------------------------------


@query(f"""with p as ({PARTY}) select *, row_number() over (order by max_age asc nulls last, party) as by_age_up, row_number() over (order by max_age desc nulls last, party) as by_age_down, row_number() over (order by total desc, party) as by_total from p""")
def parties_sorted(v):
    """Places in three orders; parties without an age come last in both directions."""
    rows = op.parties(v.bill, v.as_of)
    rows = order.placed(rows, F.asc_nulls_last("max_age"), F.asc("party"), name="by_age_up")
    rows = order.placed(rows, F.desc_nulls_last("max_age"), F.asc("party"), name="by_age_down")
    return order.placed(rows, F.desc("total"), F.asc("party"), name="by_total")


CLIENT_ORDERS = {"by_client": "client", "by_receivable": "receivable desc, client", "by_overdue": "overdue desc, client", "by_parties": "parties desc nulls last, client", "by_oldest": "coalesce(oldest, -1) desc, client"}


@query(f"{CLIENT} select client, {', '.join(f'row_number() over (order by {o}) as {n}' for n, o in CLIENT_ORDERS.items())} from c")
def client_orders(v):
    """Each client's place in five orders."""
    rows = _clients(v)
    orders = {
        "by_client": [F.asc("client")], "by_receivable": [F.desc("receivable"), F.asc("client")], "by_overdue": [F.desc("overdue"), F.asc("client")],
        "by_parties": [F.desc_nulls_last("parties"), F.asc("client")], "by_oldest": [F.desc(F.coalesce("oldest", F.lit(-1))), F.asc("client")],
    }
    for name, columns in orders.items():
        rows = order.placed(rows, *columns, name=name)
    return rows.select("client", *orders)


@query("select label, row_number() over (order by lower(label), label) as place from (select distinct trim(r_name) as label from region)")
def group_labels(v):
    """Labels in order, whatever their case."""
    rows = v.table("region").select(F.trim("r_name").alias("label")).distinct()
    return order.placed(rows, F.lower("label"), F.asc("label"))


@query("select code, string_agg(id, ',' order by id) as ids, max(found) as found from (select code, id, row_number() over (partition by code order by id) as n, count(*) over (partition by code) as found from (select distinct 'C' || lpad(cast(p_size % 40 as varchar), 2, '0') as code, 'P' || lpad(cast(p_partkey as varchar), 8, '0') as id from part) where code in (select distinct 'C' || lpad(cast(p_size % 40 as varchar), 2, '0') as c from part order by c limit 32)) where n <= 20 group by code")
def mismatch_list(v):
    """Mismatches by code: the first 32 codes, the first 20 ids of each, and how many there are.

    Ids past the twentieth are dropped before any list is gathered."""
    rows = v.table("part").select(F.concat(F.lit("C"), F.lpad((F.col("p_size") % 40).cast("string"), 2, "0")).alias("code"), F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("id")).distinct()
    codes = rows.select("code").distinct().orderBy("code").limit(32)
    w = Window.partitionBy("code")
    kept = rows.join(F.broadcast(codes), "code").withColumn("n", F.row_number().over(w.orderBy("id"))).withColumn("found", F.count("*").over(w)).filter("n <= 20")
    return kept.groupBy("code").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"), F.max("found").cast("long").alias("found"))


@query("select o_orderkey as key, o_custkey as owner from orders where o_orderkey > 1000 order by o_orderkey limit 512")
def keyset_page(v):
    """A page of 512 rows after a key."""
    rows = v.table("orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("owner"))
    return order.page_after(rows, "key", 1000, 512)


GROUPS = """(select 'G' || p_partkey as name, case when p_partkey % 50 = 0 then 'Primary' when p_partkey % 50 = 7 then 'gone' when p_partkey % 50 = 11 then 'G' || (p_partkey + 2) when p_partkey % 50 between 12 and 13 then 'G' || (p_partkey - 1) when p_partkey % 50 = 30 then '' else ' g' || (p_partkey - 1) || ' ' end as parent,
case when p_partkey % 50 in (3, 16, 40) then 'Sundry Debtors' else '' end as reserved_name, p_partkey % 50 as k from part)"""


@query(f"""with g as (select lower(name) as name, lower(trim(parent)) as parent, reserved_name from {GROUPS}),
up as (select name, name as seen, 0 as depth, reserved_name, parent from g union all select up.name, g.name, up.depth + 1, coalesce(g.reserved_name, ''), g.parent from up left join g on g.name = up.parent where up.parent is not null and up.parent not in ('primary', '') and up.depth <= 40),
e as (select name, depth, case when reserved_name = 'Sundry Debtors' then 'party' when seen is null then 'ledger_group_parent_unresolved' when depth > 32 then 'group_parent_cycle' end as event from up)
select g.name, coalesce(arg_min(event, depth) filter (where event is not null), 'other') as status from g left join e on e.name = g.name group by g.name""", recursive=True)
def group_errors(v):
    """Groups whose walk up meets a party group, the root, an unknown parent or a cycle."""
    k, name = F.col("p_partkey"), lambda n: F.concat(F.lit("G"), n.cast("string"))
    m = k % 50
    parent = (
        F.when(m == 0, "Primary").when(m == 7, "gone").when(m == 11, name(k + 2)).when(m.between(12, 13), name(k - 1))
        .when(m == 30, "").otherwise(F.concat(F.lit(" g"), (k - 1).cast("string"), F.lit(" ")))
    )
    groups = v.table("part").select(name(k).alias("name"), parent.alias("parent"), F.when(m.isin(3, 16, 40), "Sundry Debtors").otherwise("").alias("reserved_name"))
    return op.group_status(groups)


@query(f"""with s as (select 'gone' as p, 'ledger_group_parent_unresolved' as e), l as (select name, closing, bill_wise, case when key % 5 = 0 then 'gone' when key % 5 = 1 then 'loop a' else 'Primary' end as parent from v_ledger),
b as (select party, sum(closing) as billed from v_bill group by party)
select name as party, case when bill_wise then cast(closing - coalesce(billed, 0) as {M}) end as residual, case when bill_wise then 'complete' when parent = 'gone' then 'ledger_group_parent_unresolved' else 'group_parent_cycle' end as status from l left join b on b.party = name where bill_wise or parent <> 'Primary'""")
def partial_residuals(v):
    """Residuals where groups can't be told: bill-wise ledgers are complete, others below an unknown group or a cycle partial."""
    groups = v.spark.createDataFrame([("Loop A", "Loop B", ""), ("Loop B", "loop a", "")], "name string, parent string, reserved_name string")
    parent = F.when(F.col("key") % 5 == 0, "gone").when(F.col("key") % 5 == 1, "loop a").otherwise("Primary")
    return op.residuals(v.ledger.withColumn("parent", parent), groups, v.bill)


TYPES = ("text/xml", "Text/XML; charset=UTF-8", "text/xml;charset=utf-16", "application/json", "text/xml; charset", "text/xml; charset=utf-8; charset=utf-8", "text/xml; charset=latin-1", "text/xml; boundary=x", " text/xml ; charset = utf-8 ", "")


@query(f"""select c_custkey as key, case when c_custkey % 20 >= 10 then 'utf-16' else 'utf-8' end as expected, case c_custkey % 10 when 0 then null when 1 then case when c_custkey % 20 >= 10 then 'declared_encoding_mismatch' end when 2 then case when c_custkey % 20 < 10 then 'declared_encoding_mismatch' end
when 8 then case when c_custkey % 20 >= 10 then 'declared_encoding_mismatch' end else 'unsupported_content_type' end as reason from customer""")
def content_types(v):
    k = F.col("c_custkey")
    value = F.get(F.array(*map(F.lit, TYPES)), (k % 10).cast("int"))
    expected = F.when(k % 20 >= 10, "utf-16").otherwise("utf-8")
    return v.table("customer").select(k.alias("key"), expected.alias("expected"), rules.content_type(value, expected).alias("reason"))


@query("""select c_custkey as key, case c_custkey % 8 when 0 then 'missing' when 1 then 'empty_file' when 2 then 'corrupt_file' when 3 then 'unsupported_version' when 4 then 'corrupt_file' when 5 then 'corrupt_file' else 'loaded' end as state, case when c_custkey % 8 >= 6 then c_name end as label, case when c_custkey % 8 >= 6 then 1 else 0 end as labels from customer""")
def label_files(v):
    """Label files: missing, empty, cut, of another version, with an unknown field or a label that is no text, and whole ones with a blank label."""
    k = F.col("c_custkey")
    whole = F.concat(F.lit('{"version":'), F.when(k % 8 == 3, "2").otherwise("1"), F.when(k % 8 == 4, ',"more":1').otherwise(""), F.lit(',"labels":{" g":" '), F.col("c_name"), F.lit(' ","h":'), F.when(k % 8 == 5, "1").otherwise('" "'), F.lit("}}"))
    json = F.when(k % 8 == 0, F.lit(None)).when(k % 8 == 1, " ").when(k % 8 == 2, F.substring(whole, 1, 20)).otherwise(whole)
    found = rules.label_file(json)
    return v.table("customer").select(k.alias("key"), found["state"].alias("state"), F.try_element_at(found["labels"], F.lit("g")).alias("label"), F.size(found["labels"]).cast("long").alias("labels"))
