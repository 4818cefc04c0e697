"""Queries on scoped exports as tables of elements: the guard, counts against headers, fragments as evidence, repaired offsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import captures, elements, shared
from .books import _join, _s
from .registry import query

#: Orders of a capture.
SIZE = 40
#: Every tenth capture has a fault of its own.
FAULT = f"case when o_orderkey // {SIZE} % 10 = 9 then o_orderkey // {SIZE} // 10 % 8 end"


def _elements(captures, key, xml):
    """The element table, written once: readers look at it several times."""
    return shared.staged(elements.elements(captures, key, xml), "elements")


def _row():
    k = F.col("k")
    name = _join("Order ", _s(k), " &#4; ", F.col("o_orderpriority"))
    guid = F.when(k % 5 == 4, "xx-").otherwise("CO-1-")
    text = F.when(k % 3 == 0, _join("<NOTE>", F.col("o_custkey").cast("string"), " &#x1; é</NOTE>")).otherwise("<NOTE/>")
    return _join('<VOUCHER NAME="', name, '" GUID="', guid, _s(k), '" ALTERID="', _s(k), '">', text, "<AMOUNT>", _s(F.col("o_totalprice").cast("decimal(18,2)")), "</AMOUNT></VOUCHER>")


def _captures(v):
    """``(file, xml)``: a capture for each run of orders; some have a wrong count, schema or status, an element, attribute or text that isn't allowed, or are cut."""
    file = F.call_function("div", F.col("k"), F.lit(SIZE))
    rows = shared.dealt(v.table("orders").withColumn("k", F.col("o_orderkey")).withColumn("file", file), "file")
    per = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("k", _row().alias("row")))).alias("l"))
    f = F.when(F.col("file") % 10 == 9, F.call_function("div", F.col("file"), F.lit(10)) % 8).otherwise(-1)
    n = F.size("l")
    twice = F.when(f == 4, F.get("l", 0)["row"]).otherwise("")
    count = _s(n + F.when(f == 0, 1).when(f == 4, 1).otherwise(0))
    context = _join('<COMPANYCONTEXT SCHEMA="', F.when(f == 1, "other").otherwise("vouchers-2"), '" OBJECTTYPE="VOUCHER" RECORDCOUNT="', count, '"/>')
    xml = _join("<ENVELOPE", F.when(f == 5, ' LANG="en"').otherwise(""), "><HEADER><VERSION>1</VERSION><STATUS>", F.when(f == 2, "0").otherwise("1"), "</STATUS></HEADER><BODY>", F.when(f == 6, "<EXTRA>x</EXTRA>").otherwise(""), "<DATA>", context, F.when(f == 7, "loose text").otherwise(""), "<COLLECTION>", F.array_join(F.transform("l", lambda x: x["row"]), ""), twice, "</COLLECTION></DATA></BODY></ENVELOPE>")
    return per.select("file", F.when(f == 3, F.substring(xml, 1, 200)).otherwise(xml).alias("xml"))


ORDERS = f"(select o_orderkey as k, o_orderkey // {SIZE} as file, *, {FAULT} as fault from orders)"
XML = "'<VOUCHER NAME=\"Order ' || k || ' &#4; ' || o_orderpriority || '\" GUID=\"' || case when k % 5 = 4 then 'xx-' else 'CO-1-' end || k || '\" ALTERID=\"' || k || '\">' || case when k % 3 = 0 then '<NOTE>' || o_custkey || ' &#x1; é</NOTE>' else '<NOTE/>' end || '<AMOUNT>' || cast(o_totalprice as decimal(18,2)) || '</AMOUNT></VOUCHER>'"


@query(f"""with f as (select file, max(fault) as fault, count(*) as n, count(*) filter (where k % 5 <> 4) as m, min(k) as k from {ORDERS} group by file)
select file, case when fault = 3 then 0 else n + case when fault = 4 then 1 else 0 end end as records, case when fault = 3 then 0 else n + case when fault = 4 then 1 else 0 end end as identified,
case when fault = 3 then 0 else m + case when fault = 4 and k % 5 <> 4 then 1 else 0 end end as matching, case when fault = 3 then 0 else n - m + case when fault = 4 and k % 5 = 4 then 1 else 0 end end as other, case when fault = 4 then 1 else 0 end as duplicates,
case fault when 0 then 'count_mismatch' when 1 then 'schema_mismatch' when 2 then 'source_reported_failure' when 3 then 'malformed_xml' when 4 then 'duplicate_identity' end as reason from f""")
def scoped_exports(v):
    """Captures whose header's schema, kind and count are held against their rows."""
    return elements.scoped_exports(_elements(_captures(v), "file", "xml"), "file", "vouchers-2", "VOUCHER", F.lit("co-1"))


@query(f"""with f as (select distinct file, fault from {ORDERS} where fault in (3, 5, 6, 7))
select file, case fault when 5 then 0 when 6 then 71 when 7 then 71 end as place, case fault when 5 then '/ENVELOPE' when 6 then '/ENVELOPE/BODY/EXTRA' when 7 then '/ENVELOPE/BODY/DATA' end as path,
case fault when 3 then 'malformed_xml' when 5 then 'unexpected_attribute' when 6 then 'unexpected_element' when 7 then 'unexpected_text' end as reason, case fault when 5 then 'LANG' when 6 then 'EXTRA' when 7 then 'loose text' end as detail from f""")
def structure_guard(v):
    """Elements, attributes and texts outside a selected export's skeleton, a row each."""
    return elements.violations(_elements(_captures(v), "file", "xml"), "file", elements.export_structure("VOUCHER"))


@query(f"""with r as (select file, 0 as again, k, o_orderpriority, {XML} as x from {ORDERS} where fault is null or fault <> 3
union all select file, 1, k, o_orderpriority, x from (select file, fault, k, o_orderpriority, {XML} as x, row_number() over (partition by file order by k) as n from {ORDERS}) where fault = 4 and n = 1)
select file, row_number() over (partition by file order by again, k) as ordinal, 'Order ' || k || ' ' || chr(65533) || '#4; ' || o_orderpriority as name, case when k % 5 = 4 then 'xx-' else 'CO-1-' end || k as guid, k as alter_id, octet_length(encode(x)) as bytes, sha256(x) as sha256 from r""")
def export_fragments(v):
    """Each row's own bytes in its capture, by length and digest, though its name had to be repaired to be read."""
    return elements.fragments(_elements(_captures(v), "file", "xml"), "file", "VOUCHER")


@query(f"""with r as (select file, k, {XML} as x from {ORDERS} where fault is null),
c as (select file, k, x, coalesce(sum(octet_length(encode(x))) over (partition by file order by k rows between unbounded preceding and 1 preceding), 0) as before,
  octet_length(encode('<ENVELOPE><HEADER><VERSION>1</VERSION><STATUS>1</STATUS></HEADER><BODY><DATA><COMPANYCONTEXT SCHEMA="vouchers-2" OBJECTTYPE="VOUCHER" RECORDCOUNT="' || count(*) over (partition by file) || '"/><COLLECTION>')) as head from r),
m as (select file, k, '&#4;' as reference, head + before + octet_length(encode(x[:instr(x, '&#4;') - 1])) as spot from c
  union all select file, k, '&#x1;', head + before + octet_length(encode(x[:instr(x, '&#x1;') - 1])) from c where k % 3 = 0),
n as (select *, row_number() over (partition by file order by spot) as ordinal from m)
select file, ordinal, reference, spot + 2 * (ordinal - 1) as repaired_at, spot as original_at, true as same from n""")
def repaired_offsets(v):
    """Where each illegal reference stood before and stands after the repair; the bytes there are the reference and its marker."""
    # A capture is rendered and repaired once, not for each of its references.
    rows = _captures(v).filter((F.col("file") % 10 < 9))
    rows = shared.staged(rows.withColumn("fixed", captures.repair(F.col("xml"))), "captures")
    found = elements.marker_offsets(rows, "file").withColumnRenamed("file", "_f")
    joined = found.join(rows, F.col("_f") == F.col("file"))
    raw = lambda text, at, like: F.substring(text.cast("binary"), at + 1, F.octet_length(like)).cast("string") == like
    marker = captures.repair(F.col("reference"))
    same = raw(F.col("xml"), F.col("original_at").cast("int"), F.col("reference")) & raw(F.col("fixed"), F.col("repaired_at").cast("int"), marker)
    return joined.select("file", "ordinal", "reference", "repaired_at", "original_at", same.alias("same"))
