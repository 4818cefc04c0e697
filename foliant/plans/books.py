"""Queries on captured books: responses rendered from the tables, a file for some hundred rows each, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import books
from .registry import query

M = "decimal(18,2)"


def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _join(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _files(rows, row, size: int, key: str = "k", around=("<ENVELOPE><BODY><DATA><COLLECTION>", "</COLLECTION></DATA></BODY></ENVELOPE>")):
    """``(file, xml)``: the rows' texts, ``size`` to a file."""
    per = rows.select((F.col(key) / size).cast("long").alias("file"), F.col(key).alias("_k"), row.alias("row")).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("_k", "row"))).alias("l"))
    return per.select("file", _join(around[0], F.array_join(F.transform("l", lambda x: x["row"]), ""), around[1]).alias("xml"))


@query(f"""with o as (select o_orderkey as k, 'Party & ' || o_custkey as party, o_orderkey // 500 as file, cast(o_orderdate as date) as d, cast(cast(o_orderdate as date) + to_days(30) as date) as due, cast(-o_totalprice as {M}) as closing from orders),
r as (select *, case when file % 10 = 9 then case when file % 20 = 9 then 'source_reported_failure' else 'bills_xml_malformed' end when k % 50 = 7 then 'bills_fixed_row_missing_billoverdue' when k % 50 = 8 then 'bills_duplicate_billcl' when k % 50 = 9 then 'bills_fixed_empty_billparty' when k % 50 = 10 then 'bills_amount_invalid' when k % 50 = 11 then 'bills_date_invalid' end as reason from o)
select file, party, 'B' || k as reference, cast(d as varchar) as bill_date, cast(due as varchar) as due_date, closing, case when k % 3 > 0 then k % 3 end as overdue, reason from r where reason is null
union all select file, null, null, null, null, null, null, reason from r where reason is not null and file % 10 <> 9 union all select distinct file, null, null, null, null, null, null, reason from r where file % 10 = 9""")
def native_bill_rows(v):
    """Bills reports of flat siblings: good rows, rows with a missing, repeated, empty or wrong field, and failed captures."""
    k = F.col("k")
    rows = v.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").cast(M).alias("total"))
    shown = lambda d: F.date_format(d, "d-MMM-yy")
    m = k % 50
    party = F.when(m == 9, " ").otherwise(_join("Party &amp; ", _s("c")))
    amount = F.when(m == 10, "1,000.00").otherwise(_s((-F.col("total")).cast(M)))
    row = _join(
        "<BILLFIXED><BILLDATE>", F.when(m == 11, "31-Feb-95").otherwise(shown(F.col("d"))), "</BILLDATE><BILLREF>B", _s("k"), "</BILLREF><BILLPARTY>", party, "</BILLPARTY></BILLFIXED><BILLCL>", amount, "</BILLCL>",
        F.when(m == 8, "<BILLCL>0</BILLCL>").otherwise(""), "<BILLDUE>", shown(F.date_add("d", 30)), "</BILLDUE>",
        F.when(m == 7, "").otherwise(_join("<BILLOVERDUE>", F.when(k % 3 > 0, _s(k % 3)).otherwise(""), "</BILLOVERDUE>")),
    )
    files = _files(rows, row, 500, around=("<ENVELOPE>", "</ENVELOPE>"))
    xml = F.when(F.col("file") % 20 == 9, "<ENVELOPE><HEADER><STATUS>0</STATUS></HEADER></ENVELOPE>").when(F.col("file") % 20 == 19, "<ENVELOPE><BILLFIXED>").otherwise(F.col("xml"))
    found = books.bills(files.select("file", xml.alias("xml")), F.lit("1990-01-01").cast("date"), F.lit("2005-12-31").cast("date"), kept=("file",))
    return found.select("file", "party", "reference", F.col("bill_date").cast("string").alias("bill_date"), F.col("due_date").cast("string").alias("due_date"), "closing", "overdue", "reason")


@query("select p_partkey // 200 as file, 'G' || p_partkey as name, 'P' || p_size as parent, case when p_partkey % 3 = 1 then '' when p_partkey % 3 = 2 then 'Sundry Debtors' end as reserved_name, p_partkey % 7 > 0 as own, cast(null as varchar) as reason from part")
def group_rows(v):
    """Groups: a reserved name that wasn't exported is null, an empty one is empty."""
    k = F.col("k")
    rows = v.table("part").select(F.col("p_partkey").alias("k"), "p_size")
    attribute = F.when(k % 3 == 1, ' RESERVEDNAME=""').when(k % 3 == 2, ' RESERVEDNAME="Sundry Debtors"').otherwise("")
    row = _join('<GROUP NAME="G', _s("k"), '"', attribute, "><PARENT>P", _s("p_size"), "</PARENT><GUID>", F.when(k % 7 > 0, "Co-1").otherwise("co-2"), "-", _s("k"), "</GUID></GROUP>")
    return books.groups(_files(rows, row, 200), F.lit("CO-1"), kept=("file",))


@query("select n_nationkey as company, 1 + n_nationkey % 2 as masters, n_nationkey % 4 = 0 as inr from nation")
def company_currencies(v):
    k = F.col("n_nationkey")
    first = _join('<CURRENCY NAME="x"><MAILINGNAME>', F.when(k % 4 == 0, "Indian Rupees").otherwise("Rupees"), "</MAILINGNAME></CURRENCY>")
    xml = _join("<ENVELOPE><BODY><DATA><COLLECTION>", first, F.when(k % 2 == 1, '<CURRENCY NAME="y"><MAILINGNAME>Indian Rupees</MAILINGNAME></CURRENCY>').otherwise(""), "</COLLECTION></DATA></BODY></ENVELOPE>")
    return books.currency(v.table("nation").select(k.alias("company"), xml.alias("xml")), "company").drop("reason")


VOUCHERS = f"""(select o_orderkey as k, cast(o_orderdate as date) as d, l_linenumber, row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as ordinal, l_suppkey, cast(l_extendedprice as {M}) as price from orders join lineitem on l_orderkey = o_orderkey)"""
VREASON = "case when k % 9 = 4 then 'company_mismatch' when d > date '1998-06-30' then 'row_outside_date_window' when k >= 400000 then 'row_outside_alter_range' end"


def _voucher_files(v):
    lines = v.table("orders").join(v.table("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    price = _s(F.col("l_extendedprice").cast(M))
    bill = _join("<BILLALLOCATIONS.LIST><NAME>B", _s("l_linenumber"), "</NAME><BILLTYPE>New Ref</BILLTYPE><AMOUNT>", price, "</AMOUNT></BILLALLOCATIONS.LIST>")
    entry = _join(
        "<ALLLEDGERENTRIES.LIST>", F.when(F.col("l_linenumber") % 2 == 0, _join(bill, bill)).otherwise(""), "<LEDGERNAME>S", _s("l_suppkey"), "</LEDGERNAME><ISDEEMEDPOSITIVE>",
        F.when(F.col("l_linenumber") % 2 == 1, "Yes").otherwise("No"), "</ISDEEMEDPOSITIVE><AMOUNT>", price, "</AMOUNT></ALLLEDGERENTRIES.LIST>",
    )
    per = lines.groupBy(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", entry.alias("x")))).alias("l"))
    guid = _join(F.when(F.col("k") % 9 == 4, "other").otherwise("CO-1"), "-", _s("k"))
    row = _join("<VOUCHER><GUID>", guid, "</GUID><ALTERID> ", _s("k"), "</ALTERID><DATE>", F.date_format("d", "yyyyMMdd"), "</DATE>", F.array_join(F.transform("l", lambda x: x["x"]), ""), "</VOUCHER>")
    return _files(per, row, 400)


@query(f"select case when k % 9 = 4 then 'other-' else 'CO-1-' end || k as guid, k as alter_id, cast(d as varchar) as vdate, ordinal, 'S' || l_suppkey as ledger, case when l_linenumber % 2 = 1 then 'debit' else 'credit' end as polarity, price as amount, case when l_linenumber % 2 = 0 then 2 else 0 end as allocations, cast(case when l_linenumber % 2 = 0 then 2 * price else 0 end as {M}) as allocated, {VREASON} as reason from {VOUCHERS}")
def voucher_entries(v):
    """Vouchers with nested entries and allocations: places, amounts of their own, and rows outside the read's company, window or range."""
    d = lambda x: F.lit(x).cast("date")
    found = books.vouchers(_voucher_files(v), F.lit("co-1"), d("1990-01-01"), d("1998-06-30"), F.lit(0), F.lit(400_000))
    return found.withColumn("vdate", F.col("vdate").cast("string"))


@query(f"select case when k % 9 = 4 then 'other-' else 'CO-1-' end || k as guid, k as alter_id, cast(d as varchar) as vdate from (select distinct k, d from {VOUCHERS})")
def witness_rows(v):
    """Ids, alteration numbers and dates alone."""
    return books.witnesses(_voucher_files(v)).withColumn("vdate", F.col("vdate").cast("string")).drop("reason")


@query("select id, vouchers, reason from (select 'g' || (o_orderkey - o_orderkey % 64) as id, count(*) as vouchers, 'duplicate_voucher_guid' as reason from orders group by 1 having count(*) > 1 union all select cast(o_orderkey // 50 as varchar), count(*), 'duplicate_alter_id' from orders group by 1 having count(*) > 1)")
def repeated_voucher_ids(v):
    k = F.col("o_orderkey")
    rows = v.table("orders").select(_join("g", _s(k - k % 64)).alias("guid"), F.call_function("div", k, F.lit(50)).alias("alter_id"), k.alias("n"))
    # Here each order is a voucher of its own, so equal pairs count as well.
    twice = lambda c, code: rows.groupBy(F.col(c).cast("string").alias("id")).agg(F.count("*").cast("long").alias("vouchers")).filter("vouchers > 1").withColumn("reason", F.lit(code))
    return twice("guid", "duplicate_voucher_guid").unionByName(twice("alter_id", "duplicate_alter_id"))


@query(f"select c_custkey // 100 as file, case when c_custkey % 100 in (5, 6) then 'twice' else c_name end as name, cast(0 as {M}) as opening, case when c_custkey % 100 = 50 then null else cast(c_acctbal as {M}) end as closing, case when c_custkey % 100 = 50 then 'bad_amount' when c_custkey % 100 in (5, 6) then 'duplicate_identity' end as reason from customer")
def period_balances(v):
    k = F.col("k")
    rows = v.table("customer").select(F.col("c_custkey").alias("k"), "c_name", F.col("c_acctbal").cast(M).alias("bal"))
    row = _join('<LEDGER NAME="', F.when((k % 100).isin(5, 6), "twice").otherwise(F.col("c_name")), '"><OPENINGBALANCE></OPENINGBALANCE><CLOSINGBALANCE>', F.when(k % 100 == 50, "n/a").otherwise(_s("bal")), "</CLOSINGBALANCE></LEDGER>")
    return books.balances(_files(rows, row, 100), "file")


@query("select parent as company, count(*) as ledgers, count(distinct name) as ids, count(*) filter (where bill_wise and closing <> 0) as bill_wise_opening from v_ledger group by parent")
def opening_coverage(v):
    return books.opening_coverage(v.ledger.select(F.col("parent").alias("company"), F.col("name").alias("guid"), F.col("closing").alias("opening"), "bill_wise"), "company")


@query("select n_nationkey as company, cast(date '1990-04-01' as varchar) as books_from, cast(date '1998-03-31' as varchar) as last_voucher, n_nationkey * 10 as voucher_mark, n_nationkey as master_mark, case when n_nationkey % 5 = 1 then 'company_extent_not_unique' when n_nationkey % 5 = 2 then 'company_mismatch' end as reason from nation")
def company_extents(v):
    k = F.col("n_nationkey")
    one = _join("<COMPANY><GUID>", F.when(k % 5 == 2, "other").otherwise("CO-1"), "</GUID><BOOKSFROM>19900401</BOOKSFROM><LASTVOUCHERDATE>19980331</LASTVOUCHERDATE><ALTVCHID> ", _s(k * 10), "</ALTVCHID><ALTMSTID>", _s(k), "</ALTMSTID></COMPANY>")
    xml = _join("<ENVELOPE><BODY><DATA><COLLECTION>", one, F.when(k % 5 == 1, one).otherwise(""), "</COLLECTION></DATA></BODY></ENVELOPE>")
    found = books.extents(v.table("nation").select(k.alias("company"), xml.alias("xml")), "company", F.lit("co-1"))
    return found.withColumn("books_from", F.col("books_from").cast("string")).withColumn("last_voucher", F.col("last_voucher").cast("string"))


@query(f"select s_suppkey as file, case when s_suppkey % 10 <> 9 then 'g' || s_suppkey end as guid, case when s_suppkey % 10 not in (8, 9) then cast(s_acctbal as {M}) end as amount, case when s_suppkey % 10 <> 9 then 2 else 0 end as items, case when s_suppkey % 10 <> 9 then 3 else 0 end as batches, case when s_suppkey % 10 <> 9 then 1 else 0 end as entries, case when s_suppkey % 10 <> 9 then s_suppkey % 3 else 0 end as bills, case s_suppkey % 10 when 9 then 'malformed_json' when 8 then 'wrong_type' end as reason from supplier")
def json_voucher_rows(v):
    """JSON collections with typed cells and nested lists; some are cut, some have an amount of another type."""
    k = F.col("s_suppkey")
    cell = lambda t, x: _join('{"type":"', t, '","value":"', x, '"}')
    bills = _join("[", F.array_join(F.array_repeat(cell("text", F.lit("b")), (k % 3).cast("int")), ","), "]")
    amount = cell(F.when(k % 10 == 8, "text").otherwise("amount"), _s(F.col("s_acctbal").cast(M)))
    batch = cell("text", F.lit("t"))
    json = _join('{"vouchers":[{"guid":', cell("text", _join("g", _s(k))), ',"amount":', amount, ',"inventory":[{"batches":[', batch, ",", batch, ']},{"batches":[', batch, ']}],"entries":[{"amount":', amount, ',"bills":', bills, "}]}]}")
    return books.json_vouchers(v.table("supplier").select(k.alias("file"), F.when(k % 10 == 9, F.substring(json, 1, 40)).otherwise(json).alias("json")), "file")


FAILED = "case c_custkey % 6 when 1 then 'source_reported_failure' when 2 then 'malformed_xml' when 3 then 'collection_missing' when 4 then 'empty_collection' when 5 then 'missing' end"
READERS = ("groups", "currency", "witnesses", "extents", "opening", "companies", "catalogue", "balances")


@query(f"""with c as (select c_custkey, {FAILED} as failed from customer)
select reader, coalesce(reason, 'good') as reason, count(*) as captures from (select reader, case when failed = 'empty_collection' and reader = 'extents' then 'company_extent_not_unique' when failed is null and reader = 'catalogue' and c_custkey % 12 = 6 then 'context_mismatch' when failed is null and reader = 'opening' and c_custkey % 12 = 6 then 'bad_ledger'
  when failed is null and reader = 'groups' and c_custkey % 12 = 6 then 'company_mismatch' when failed is null and reader = 'companies' and c_custkey % 12 = 6 then 'duplicate_company' else failed end as reason
  from c, (select unnest({list(READERS)}) as reader) where not (reader = 'witnesses' and coalesce(failed, '') = 'empty_collection')) group by 1, 2""")
def capture_failures(v):
    """Every collection reader on failed, cut, bare, empty and missing captures: one row with a reason for each; an empty witness is none."""
    k = F.col("k")
    f, odd = k % 6, k % 12 == 6
    captures = v.table("customer").select(F.col("c_custkey").alias("k"))

    def rendered(rows):
        whole = _join("<ENVELOPE><HEADER><STATUS>", F.when(f == 1, "0").otherwise("1"), "</STATUS></HEADER><BODY>", F.when((f == 1) | (f == 3), "").when(f == 4, "<DATA><COLLECTION></COLLECTION></DATA>").otherwise(_join("<DATA><COLLECTION>", rows, "</COLLECTION></DATA>")), "</BODY></ENVELOPE>")
        return captures.select("k", F.when(f == 5, F.lit(None)).when(f == 2, F.substring(whole, 1, 40)).otherwise(whole).alias("xml"))

    guid = _join("<GUID>", F.when(odd, "other").otherwise("CO-1"), "-1</GUID>")
    own = _join("<COMPANY NAME=\"c\"><GUID>CO-1</GUID><BOOKSFROM>19920401</BOOKSFROM><LASTVOUCHERDATE>19980331</LASTVOUCHERDATE><ALTVCHID>1</ALTVCHID><ALTMSTID>1</ALTMSTID></COMPANY>")
    ledger = _join("<LEDGER NAME=\"l\"><GUID>g</GUID><COMPANYGUID>", F.when(odd, "other").otherwise("CO-1"), "</COMPANYGUID><ISBILLWISEON>", F.when(odd, "?").otherwise("Yes"), "</ISBILLWISEON><OPENINGBALANCE>1</OPENINGBALANCE><CLOSINGBALANCE>2</CLOSINGBALANCE></LEDGER>")
    found = {
        "groups": books.groups(rendered(_join("<GROUP NAME=\"g\"><PARENT>p</PARENT>", guid, "</GROUP>")), F.lit("co-1"), kept=("k",)), "currency": books.currency(rendered(_join("<CURRENCY NAME=\"x\"><MAILINGNAME>Rupees</MAILINGNAME></CURRENCY>")), "k"),
        "witnesses": books.witnesses(rendered(_join("<VOUCHER><GUID>g</GUID><ALTERID>1</ALTERID><DATE>19950131</DATE></VOUCHER>")), kept=("k",)), "extents": books.extents(rendered(own), "k", F.lit("co-1")), "opening": books.opening_coverages(rendered(ledger), "k"),
        "companies": books.companies(rendered(_join(own, F.when(odd, own).otherwise(""))), "k").select("k", "reason").distinct(), "catalogue": books.catalogue(rendered(ledger), "k", F.lit("co-1")), "balances": books.balances(rendered(ledger), "k"),
    }
    out = None
    for name, rows in found.items():
        own_rows = rows.select(F.lit(name).alias("reader"), F.coalesce("reason", F.lit("good")).alias("reason"))
        out = own_rows if out is None else out.unionByName(own_rows)
    return out.groupBy("reader", "reason").agg(F.count("*").cast("long").alias("captures"))
